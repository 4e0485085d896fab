"""GeoPackage layers as a Spark data source.

``spark.read.format("gpkg").option("layer", name).load(path)`` reads one
feature layer from one GeoPackage file, a directory of them, or a glob.  The
scan is split into feature-id ranges of at most ``rowsPerPartition`` rows of
one file (default 200 000), however sparse the ids are, so many files or one
large file are read in parallel; every executor opens its file read-only with
the standard ``sqlite3`` module (the files must be on storage every executor
can see).  Planning reads the layer's schema and the least and greatest id and
cuts between them; only ranges wider than ``rowsPerPartition`` ids are walked.

Filters go to the file with ``read_layer``: comparisons of ``fid`` also choose
the ranges; equality, order and null tests of attributes and ``contains`` /
``startswith`` of text become conditions of its SELECT.  A stored value need not
have its declared type, so every condition lets through what it cannot judge and
Spark evaluates all filters again: the rows are the same, fewer are read.  The
options ``matchColumn`` and ``matchParts`` (a JSON list of texts that every wanted
row holds in any case) do the same for a wildcard search.  Filters are options of
one load and not taken from the plan (``pushFilters``): all plans of one DataFrame
share a reader there, and a later query without filters got the rows of an earlier
one's (seen with PySpark 4.1.2: 25 rows counted instead of 199).

Spark does not prune the columns of such a source: give ``.schema(...)`` with
the first four columns and the attributes you need, and only these are read.
A value that does not fit its declared type is null.

Rows: ``fid``, ``geom`` (WKT), ``srs_id``, ``authid`` (for example
``EPSG:4326``), then the layer's attribute columns.  A layer that is not
registered in ``gpkg_geometry_columns`` (attributes only) is refused, as the
reference offers only layers with geometry.
"""

from __future__ import annotations

import glob
import json
import math
import os
import sqlite3
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# WKB geometry type codes and their WKT names.
WKB_TYPES = {
    1: "POINT",
    2: "LINESTRING",
    3: "POLYGON",
    4: "MULTIPOINT",
    5: "MULTILINESTRING",
    6: "MULTIPOLYGON",
    7: "GEOMETRYCOLLECTION",
}
# GeoPackage binary header: envelope size in doubles per envelope indicator.
ENVELOPE_DOUBLES = {0: 0, 1: 4, 2: 6, 3: 6, 4: 8}
DEFAULT_ROWS_PER_PARTITION = 200_000
# A stored feature takes more bytes than this, so a file's size bounds its rows.
LEAST_ROW_BYTES = 32


# --------------------------------------------------------------------------- WKB -> WKT


def _num(v: float) -> str:
    text = repr(float(v))
    return text[:-2] if text.endswith(".0") else text


class _Wkb:
    def __init__(self, data: bytes, offset: int = 0):
        self.data = data
        self.pos = offset

    def _read(self, fmt: str):
        values = struct.unpack_from(fmt, self.data, self.pos)
        self.pos += struct.calcsize(fmt)
        return values

    def geometry(self) -> str:
        (order,) = self._read("B")
        end = "<" if order == 1 else ">"
        (code,) = self._read(end + "I")
        has_z = bool(code & 0x80000000) or (code % 10000) // 1000 in (1, 3)
        has_m = bool(code & 0x40000000) or (code % 10000) // 1000 in (2, 3)
        if code & 0x20000000:  # EWKB with embedded SRID
            self._read(end + "I")
        base = (code & 0x0FFFFFFF) % 1000
        dims = 2 + has_z + has_m
        name = WKB_TYPES.get(base)
        if name is None:
            raise ValueError(f"unsupported WKB type {code}")
        suffix = (" Z" if has_z else "") + ("M" if has_m and has_z else (" M" if has_m else ""))
        body = self._body(base, end, dims)
        return f"{name}{suffix} {body}" if body != "EMPTY" else f"{name}{suffix} EMPTY"

    def _coords(self, end: str, dims: int) -> str:
        values = self._read(end + "d" * dims)
        return " ".join(_num(v) for v in values)

    def _seq(self, end: str, dims: int) -> str:
        (n,) = self._read(end + "I")
        if n == 0:
            return "EMPTY"
        return "(" + ", ".join(self._coords(end, dims) for _ in range(n)) + ")"

    def _body(self, base: int, end: str, dims: int) -> str:
        if base == 1:
            values = self._read(end + "d" * dims)
            if all(math.isnan(v) for v in values):
                return "EMPTY"
            return "(" + " ".join(_num(v) for v in values) + ")"
        if base == 2:
            return self._seq(end, dims)
        if base == 3:
            (rings,) = self._read(end + "I")
            if rings == 0:
                return "EMPTY"
            return "(" + ", ".join(self._seq(end, dims) for _ in range(rings)) + ")"
        (n,) = self._read(end + "I")
        if n == 0:
            return "EMPTY"
        members = [self.geometry() for _ in range(n)]
        if base == 7:
            return "(" + ", ".join(members) + ")"
        # strip the member type words: MULTIPOINT ((1 2), (3 4))
        return "(" + ", ".join(m[m.index(" ") + 1 :].lstrip("ZM ") for m in members) + ")"


def wkb_to_wkt(data: bytes, offset: int = 0) -> str:
    return _Wkb(data, offset).geometry()


def gpkg_blob_to_wkt(blob: bytes | None) -> str | None:
    """GeoPackage geometry blob (header + WKB) -> WKT; null blob -> null."""
    if blob is None:
        return None
    blob = bytes(blob)
    if blob[:2] != b"GP":
        return wkb_to_wkt(blob)
    flags = blob[3]
    envelope = ENVELOPE_DOUBLES.get((flags >> 1) & 0x07)
    if envelope is None:
        raise ValueError("bad GeoPackage envelope indicator")
    return wkb_to_wkt(blob, 8 + 8 * envelope)


# --------------------------------------------------------------------------- metadata


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _spark_type(declared: str):
    t = (declared or "").upper()
    if t in ("INTEGER", "INT", "MEDIUMINT", "SMALLINT", "TINYINT", "BIGINT"):
        return LongType()
    if t == "BOOLEAN":
        return BooleanType()
    if t in ("REAL", "DOUBLE", "FLOAT"):
        return DoubleType()
    if t == "BLOB":
        return BinaryType()
    return StringType()


def layer_info(path: str, layer: str) -> dict:
    """Primary key, geometry column, SRS and attribute columns of a layer."""
    with _connect(path) as con:
        geo = con.execute(
            "SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)
        ).fetchone()
        if geo is None:
            raise ValueError(f"{path}: layer {layer!r} has no geometry (attribute-only layers are not searchable)")
        geom_col, srs_id = geo
        srs = con.execute(
            "SELECT organization, organization_coordsys_id FROM gpkg_spatial_ref_sys WHERE srs_id = ?", (srs_id,)
        ).fetchone()
        authid = f"{srs[0].upper()}:{srs[1]}" if srs else None
        cols = con.execute(f"PRAGMA table_info({_quote(layer)})").fetchall()
    pk = next((c[1] for c in cols if c[5] == 1), None)
    if pk is None:
        raise ValueError(f"{path}: layer {layer!r} has no primary key")
    attrs = [(c[1], c[2]) for c in cols if c[1] not in (pk, geom_col)]
    return {"pk": pk, "geom": geom_col, "srs_id": srs_id, "authid": authid, "attrs": attrs}


def list_layers(path: str) -> list[str]:
    """Feature layers of a file (attribute-only tables are left out)."""
    with _connect(path) as con:
        return [r[0] for r in con.execute("SELECT table_name FROM gpkg_geometry_columns ORDER BY table_name")]


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(path, "*.gpkg")))
    return sorted(glob.glob(path)) or [path]


# --------------------------------------------------------------------------- data source


def _fitting(value, kind):
    """A stored value as its declared type, or null: SQLite columns hold any type."""
    try:
        if value is None or isinstance(kind, BinaryType):
            return value if value is None or isinstance(value, bytes) else None
        if isinstance(kind, BooleanType):
            return bool(value) if value in (0, 1) else None
        if isinstance(kind, LongType):
            return int(value) if float(value).is_integer() and abs(int(value)) < 1 << 63 else None
        if isinstance(kind, DoubleType):
            return float(value)
        return value.decode() if isinstance(value, bytes) else str(value)
    except (TypeError, ValueError, OverflowError):
        return None


# A filter is (column, one of these, value); the null tests have no value, ``in`` has a list.
COMPARISONS = ("=", "<", "<=", ">", ">=")
FILTERS = (*COMPARISONS, "in", "is null", "is not null", "contains", "startswith")
_LEAST, _GREATEST = -(1 << 63), (1 << 63) - 1


def _fid_bounds(filters: list[tuple]) -> tuple[int, int]:
    """Least and greatest feature id that the filters leave."""
    lo, hi = _LEAST, _GREATEST
    for column, test, value in filters:
        if column != "fid":
            continue
        if test == "in":
            lo, hi = (max(lo, min(value)), min(hi, max(value))) if value else (1, 0)
        if test in ("=", ">", ">="):
            lo = max(lo, value + (test == ">"))
        if test in ("=", "<", "<="):
            hi = min(hi, value - (test == "<"))
    return lo, hi


def _value_condition(column: str, kind, test: str, value) -> tuple[str, list] | None:
    """A condition that holds wherever the filter holds for the converted value; None if there is none."""
    if test == "is not null":
        return f"{column} IS NOT NULL", []
    own = {"LongType": "integer", "DoubleType": "real", "StringType": "text"}.get(type(kind).__name__)
    if own is None:
        return None
    other = f"typeof({column}) <> '{own}'"  # null, or converted: for Spark to judge
    if test == "is null":
        # the least integer does not convert
        return f"({other} OR {column} = {_LEAST})" if own == "integer" else other, []
    if test in ("contains", "startswith"):
        return (f"({other} OR instr({column}, ?) {'> 0' if test == 'contains' else '= 1'})", [value]) if own == "text" and value else None
    values = value if test == "in" else [value]
    if own == "text" and test in COMPARISONS[1:]:
        return None  # the order of text is the file's encoding's
    if not values or len(values) > 500 or any(v != v for v in values):
        return None
    marks = f"({', '.join('?' * len(values))})"
    return f"({other} OR {column} COLLATE BINARY {'IN' if test == 'in' else test} {marks})", list(values)


def _column_condition(column: str, test: str, value) -> Column:
    """The filter as Spark evaluates it."""
    c = F.col(_backquoted(column))
    if test == "in":
        return c.isin(list(value))
    if test in ("is null", "is not null"):
        return c.isNull() if test == "is null" else c.isNotNull()
    if test in ("contains", "startswith"):
        return getattr(c, test)(value)
    return {"=": c == value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[test]


def _backquoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _match_condition(column: str, parts: list[str]) -> tuple[str, list] | None:
    """A condition that holds wherever a text holds all ``parts``, whatever its case and accents.

    SQLite folds the case of ASCII only, so a text with any other character passes.
    """
    plain = [p for p in parts if p.isascii() and "\0" not in p and 0 < len(p) < 1000]
    if not plain:
        return None
    likes = " AND ".join([f"{column} LIKE ? ESCAPE '\\'"] * len(plain))
    values = ["%" + p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%" for p in plain]
    unsure = f"typeof({column}) <> 'text' OR {column} GLOB ? OR instr({column}, ?) > 0"
    return f"({unsure} OR ({likes}))", ["*[^\x01-\x7f]*", "\0", *values]


class FidRange(InputPartition):
    """Feature ids from ``lo`` to ``hi``, both included, of one file."""

    def __init__(self, path: str, lo: int, hi: int):
        super().__init__((path, lo, hi))
        self.path, self.lo, self.hi = path, lo, hi


def _starts(con: sqlite3.Connection, layer: str, pk: str, rows: int, lo: int, hi: int) -> tuple[list[int], int]:
    """First ids of ranges of at most ``rows`` rows that hold all rows from ``lo`` to ``hi``, and the last id."""
    least, greatest = con.execute(f"SELECT min({pk}), max({pk}) FROM {layer} WHERE {pk} BETWEEN ? AND ?", (lo, hi)).fetchone()
    if least is None:
        return [], 0
    size = con.execute("PRAGMA page_count").fetchone()[0] * con.execute("PRAGMA page_size").fetchone()[0]
    span = greatest - least + 1
    step = -(-span // min(-(-span // rows), -(-size // (rows * LEAST_ROW_BYTES))))
    starts, at = [], least
    while at <= greatest:
        first = con.execute(f"SELECT min({pk}) FROM {layer} WHERE {pk} >= ?", (at,)).fetchone()[0]
        at = min(least + ((first - least) // step + 1) * step, greatest + 1)
        while first is not None:
            starts.append(first)
            if at - first <= rows:
                break
            cut = con.execute(f"SELECT {pk} FROM {layer} WHERE {pk} >= ? AND {pk} <= ? ORDER BY {pk} LIMIT 1 OFFSET ?", (first, at - 1, rows))
            first = next((r[0] for r in cut), None)
    return starts, greatest


class GeoPackageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options = options
        self.schema = schema
        self.layer = options["layer"]
        self.rows = int(options.get("rowsPerPartition", DEFAULT_ROWS_PER_PARTITION))
        self.filters = [tuple(f) for f in json.loads(options.get("filters", "[]"))]

    def partitions(self):
        parts = []
        lo, hi = _fid_bounds(self.filters)
        for path in _files(self.options["path"]) if lo <= hi else []:
            pk = _quote(layer_info(path, self.layer)["pk"])
            with _connect(path) as con:
                starts, last = _starts(con, _quote(self.layer), pk, self.rows, lo, hi)
            parts += [FidRange(path, a, b) for a, b in zip(starts, [*(s - 1 for s in starts[1:]), last], strict=bool(starts))]
        return parts or [FidRange("", 0, 0)]

    def conditions(self, info: dict) -> list[tuple[str, list]]:
        """What the filters and the search ask of a file's rows."""
        kinds = {f.name: f.dataType for f in self.schema.fields[4:]}
        stored = {a for a, _ in info["attrs"]} & set(kinds)
        found = []
        for name, test, value in self.filters:
            if name in stored:
                found.append(_value_condition(_quote(name), kinds[name], test, value))
            elif name == "geom" and test == "is not null":
                found.append((f"{_quote(info['geom'])} IS NOT NULL", []))
            elif name == "fid" and test == "in":
                found.append(_value_condition(_quote(info["pk"]), LongType(), test, value))
        column = self.options.get("matchColumn")
        if column in stored and isinstance(kinds[column], StringType):
            found.append(_match_condition(_quote(column), json.loads(self.options.get("matchParts", "[]"))))
        return [c for c in found if c is not None]

    def read(self, partition: FidRange):
        if not partition.path:
            return
        info = layer_info(partition.path, self.layer)
        present = {a for a, _ in info["attrs"]}
        wanted = [(f.name, f.dataType) for f in self.schema.fields[4:]]
        read = [a for a, _ in wanted if a in present]
        names = [info["pk"], info["geom"], *read]
        conditions = [(f"{_quote(info['pk'])} BETWEEN ? AND ?", [partition.lo, partition.hi]), *self.conditions(info)]
        sql = f"SELECT {', '.join(_quote(n) for n in names)} FROM {_quote(self.layer)} WHERE {' AND '.join(c for c, _ in conditions)}"
        position = {a: i + 2 for i, a in enumerate(read)}
        with _connect(partition.path) as con:
            for row in con.execute(sql, [v for _, values in conditions for v in values]):
                attrs = (_fitting(row[position[a]], t) if a in position else None for a, t in wanted)
                yield (row[0], gpkg_blob_to_wkt(row[1]), info["srs_id"], info["authid"], *attrs)


class GeoPackageDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> StructType:
        if "layer" not in self.options:
            raise ValueError("gpkg source needs option 'layer'")
        first = _files(self.options["path"])[0]
        info = layer_info(first, self.options["layer"])
        fields = [
            StructField("fid", LongType()),
            StructField("geom", StringType()),
            StructField("srs_id", IntegerType()),
            StructField("authid", StringType()),
        ]
        fields += [StructField(a, _spark_type(t)) for a, t in info["attrs"]]
        return StructType(fields)

    def reader(self, schema: StructType) -> GeoPackageReader:
        return GeoPackageReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoPackageDataSource)


def read_layer(
    spark: SparkSession, path: str, layer: str, filters: list[tuple] = (), *, schema: StructType | None = None, **options
) -> DataFrame:
    """The rows of a layer that pass all ``filters``, (column, test, value) each (tests: ``FILTERS``).

    The files leave out what they can tell, Spark the rest.  Values are numbers or texts; a
    comparison with null, which no row passes, is an error.
    """
    asked = [(*f, None)[:3] for f in filters]
    for column, test, value in asked:
        bare = test in ("is null", "is not null")
        values = value if test == "in" else [] if bare else [value]
        fits = str if test in ("contains", "startswith") else int if column == "fid" else (int, float, str)
        if test not in FILTERS or any(isinstance(v, bool) or not isinstance(v, fits) for v in values):
            raise ValueError(f"not a filter: {(column, test, value)!r}")
    register(spark)
    reader = spark.read.format("gpkg").option("layer", layer).option("filters", json.dumps(asked)).options(**options)
    df = (reader if schema is None else reader.schema(schema)).load(path)
    for column, test, value in asked:
        df = df.where(_column_condition(column, test, value))
    return df
