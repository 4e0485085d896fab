"""JDBC options for the reference's three databases.

Only option assembly lives here; Spark's JDBC source does the reading.  None
of the three drivers ships with Spark, so the matching jar must be on the
cluster classpath.  Connection settings follow the reference's rules:

* PostgreSQL: empty host / port / database / user / password are left out so
  a named service can supply them; the port is an integer.
* SQL Server: a service (here: a complete JDBC URL) overrides everything; no
  password means integrated (trusted) authentication.
* Oracle: ``host[:port][/database]``; the default port 1521 is left out.

With a geometry column the relation is a subquery that projects it to WKT and
its SRID to the column that ``srid`` names (``epsg`` if it names none), with the
database's own functions.  All identifiers are quoted; the search text never
enters it (DEC-8).  Columns that only a scale or box expression uses are named in
``connection["columns"]``.

For parallel reads of a large table set ``partition_column``,
``lower_bound``, ``upper_bound`` and ``num_partitions`` in the connection
mapping; Spark then issues one range query per partition.
"""

from __future__ import annotations

from collections.abc import Mapping

from ..config import SearchConfig
from ..functions.suggest import parse_display_columns

JDBC_TYPES = ("jdbc", "postgres", "mssql", "oracle")
# Driver classes and Oracle's default listener port.
DRIVERS = {
    "postgres": "org.postgresql.Driver",
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "oracle": "oracle.jdbc.OracleDriver",
}
ORACLE_DEFAULT_PORT = 1521

_PARALLEL = {
    "partition_column": "partitionColumn",
    "lower_bound": "lowerBound",
    "upper_bound": "upperBound",
    "num_partitions": "numPartitions",
    "fetch_size": "fetchsize",
}


def _s(conn: Mapping[str, object], key: str) -> str:
    value = conn.get(key)
    return "" if value is None else str(value)


def postgres_url(conn: Mapping[str, object]) -> str:
    host, port, db, service = _s(conn, "host"), _s(conn, "port"), _s(conn, "database"), _s(conn, "service")
    authority = ""
    if host:
        authority = "//" + host + (f":{int(port)}" if port else "") + "/"
    url = f"jdbc:postgresql:{authority}{db}" if authority else f"jdbc:postgresql:{db or '/'}"
    if service:
        url += ("&" if "?" in url else "?") + f"service={service}"
    return url


def mssql_url(conn: Mapping[str, object]) -> str:
    service = _s(conn, "service")
    if service:
        return service
    host, port, db = _s(conn, "host"), _s(conn, "port"), _s(conn, "database")
    url = "jdbc:sqlserver://" + host + (f":{int(port)}" if port else "")
    if db:
        url += f";databaseName={db}"
    if not _s(conn, "password"):
        url += ";integratedSecurity=true"
    return url


def oracle_url(conn: Mapping[str, object]) -> str:
    host, port, db = _s(conn, "host"), _s(conn, "port"), _s(conn, "database")
    target = host
    if port and int(port) != ORACLE_DEFAULT_PORT:
        target += f":{int(port)}"
    if db:
        target += f"/{db}"
    return f"jdbc:oracle:thin:@//{target}"


def quote_table(kind: str, schema: str | None, table: str) -> str:
    if kind == "mssql":
        parts = [f"[{p.replace(']', ']]')}]" for p in (schema, table) if p]
    else:
        parts = ['"' + p.replace('"', '""') + '"' for p in (schema, table) if p]
    return ".".join(parts)


def quote_name(kind: str, name: str) -> str:
    return f"[{name.replace(']', ']]')}]" if kind == "mssql" else '"' + name.replace('"', '""') + '"'


def _geometry(kind: str, column: str) -> tuple[str, str]:
    """SQL of a geometry column's WKT and SRID."""
    name = quote_name(kind, column)
    if kind == "postgres":
        return f"ST_AsText(s.{name})", f"ST_SRID(s.{name})"
    if kind == "mssql":
        return f"s.{name}.STAsText()", f"s.{name}.STSrid"
    return f"SDO_UTIL.TO_WKTGEOMETRY(s.{name})", f"s.{name}.SDO_SRID"


def relation(cfg: SearchConfig) -> str:
    """The ``dbtable`` option: the table, or a subquery that projects its geometry."""
    kind = cfg.data_type
    name = quote_table(kind, cfg.schema, cfg.table)
    if not cfg.geom_column or kind not in DRIVERS:
        return name
    srid = cfg.srid if isinstance(cfg.srid, str) else "epsg"
    more = parse_display_columns(cfg.connection.get("columns") or "")
    plain = dict.fromkeys([*cfg.required_columns, *cfg.extra_columns, *more])
    columns = [f"s.{quote_name(kind, c)}" for c in plain if c not in (cfg.geom_column, srid)]
    wkt, number = _geometry(kind, cfg.geom_column)
    columns += [f"{wkt} AS {quote_name(kind, cfg.geom_column)}", f"{number} AS {quote_name(kind, srid)}"]
    return f"(SELECT {', '.join(columns)} FROM {name} s) {quote_name(kind, 'lookout')}"


def jdbc_options(cfg: SearchConfig) -> dict[str, str]:
    """``spark.read.format("jdbc").options(**jdbc_options(cfg))``."""
    kind = cfg.data_type
    conn = dict(cfg.connection)
    if kind == "jdbc":
        url = _s(conn, "url")
        if not url:
            raise ValueError("jdbc source needs connection['url']")
    elif kind == "postgres":
        url = postgres_url(conn)
    elif kind == "mssql":
        url = mssql_url(conn)
    elif kind == "oracle":
        url = oracle_url(conn)
    else:
        raise ValueError(f"{kind!r} is not a JDBC source")
    if not cfg.table:
        raise ValueError("JDBC source needs table")
    opts = {"url": url, "dbtable": relation(cfg)}
    if kind in DRIVERS:
        opts["driver"] = _s(conn, "driver") or DRIVERS[kind]
    for key in ("user", "password"):
        if _s(conn, key):
            opts[key] = _s(conn, key)
    for key, option in _PARALLEL.items():
        if _s(conn, key):
            opts[option] = _s(conn, key)
    return opts
