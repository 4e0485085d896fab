"""One display line per hit.

Three policies reproduce the three ways the reference's back ends build the
line; they differ only in how nulls, empty strings and separators behave.

``coalesce_sep``  (PostgreSQL, Oracle)  echo column, then ``", " + value`` for
    every non-null display value.  Without echo the first display column gets
    no separator and every later one does, even when the first was null, so a
    line can start with ``", "``.  ``empty_is_null`` turns ``''`` into null as
    Oracle does.
``concat_all``    (SQL Server)  no column -> ``''``; one column -> its text
    (null stays null, ``truncate30`` cuts to 30 characters like an unsized
    NVARCHAR); several -> joined with ``", "``, nulls as empty text, separators
    kept.
``skip_falsy``    (GeoPackage; default)  echo value, then every display value
    that is "truthy", joined with ``", "``; never a stray separator.  Truthy
    means not null and not ``''``; with ``drop_zero`` also not 0 / false.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Separator and policy names.
SEPARATOR = ", "
POLICIES = ("coalesce_sep", "concat_all", "skip_falsy")


def _as_text(df: DataFrame | None, name: str) -> Column:
    return F.col(name).cast("string")


def _truthy(df: DataFrame | None, name: str, drop_zero: bool) -> Column:
    c = F.col(name)
    dtype = df.schema[name].dataType if df is not None and name in df.columns else T.StringType()
    if isinstance(dtype, T.StringType):
        return c.isNotNull() & (c != F.lit(""))
    if drop_zero and isinstance(dtype, T.BooleanType):
        return c.isNotNull() & c
    if drop_zero and isinstance(dtype, T.NumericType):
        return c.isNotNull() & (c != F.lit(0))
    return c.isNotNull() & (c.cast("string") != F.lit(""))


def suggestion(
    df: DataFrame | None,
    search_column: str,
    display_columns: Sequence[str] = (),
    *,
    policy: str = "skip_falsy",
    echo: bool = True,
    empty_is_null: bool = False,
    truncate30: bool = False,
    drop_zero: bool = False,
) -> Column:
    """Column holding the display line; ``df`` supplies column types."""
    display = [d for d in display_columns if d]
    if policy == "coalesce_sep":
        if echo:
            line, sep = _as_text(df, search_column), SEPARATOR
        else:
            line, sep = F.lit(""), ""
        for d in display:
            piece = F.when(F.col(d).isNotNull(), F.concat(F.lit(sep), _as_text(df, d))).otherwise(F.lit(""))
            line = F.concat(line, piece)
            sep = SEPARATOR
        if empty_is_null:
            line = F.when(line == F.lit(""), F.lit(None).cast("string")).otherwise(line)
        return line
    if policy == "concat_all":
        cols = ([search_column] if echo else []) + display
        if not cols:
            return F.lit("")
        if len(cols) == 1:
            text = _as_text(df, cols[0])
            return F.substring(text, 1, 30) if truncate30 else text
        return F.concat_ws(SEPARATOR, *[F.coalesce(_as_text(df, c), F.lit("")) for c in cols])
    if policy == "skip_falsy":
        pieces = []
        if echo:
            pieces.append(F.coalesce(_as_text(df, search_column), F.lit("None")))
        for d in display:
            pieces.append(F.when(_truthy(df, d, drop_zero), _as_text(df, d)))
        if not pieces:
            return F.lit("")
        return F.concat_ws(SEPARATOR, *pieces)
    raise ValueError(f"unknown suggestion policy {policy!r}; expected one of {POLICIES}")


def parse_display_columns(value: str | Sequence[str] | None) -> list[str]:
    """``"column1,column2"`` -> ``["column1", "column2"]``; empty -> ``[]``."""
    if value is None:
        return []
    if isinstance(value, str):
        return [p for p in value.split(",") if p != ""]
    return [p for p in value if p]
