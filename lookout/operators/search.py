"""Single search and multi-config search.

``search(df, text, cfg)`` is the reference's whole per-keystroke query as one
lazy DataFrame: wildcard match on the text form of the search column ->
display line -> geometry + SRID -> extra columns -> order -> limit.  The text
is a bound literal, never spliced into SQL (DEC-8).

Plan shape (``explain``): the parquet scan reads only the referenced columns,
and the match is a filter in the scan's codegen stage (``Contains`` for one
literal part, an ordered ``locate`` chain for several, LIKE only with ``_``).
Every task keeps its own best ``n`` rows, which are merged through a two-level
tree (:func:`top_k`), so no single task receives ``n`` rows from every map task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.collation import fold_accents, fold_accents_text
from ..functions.expressions import with_expression
from ..functions.geometry import srid_from_authid
from ..functions.patterns import resolve_limit, wildcard_pattern_text
from ..functions.suggest import suggestion

HIT_COLUMNS = ("geom", "epsg", "suggestion")
SCALE_COLUMN = "scale_denom"
BBOX_COLUMN = "bbox_text"
# Fixed value: zoom scale used when no scale expression is set or it fails.
DEFAULT_SCALE = 2000.0


def ordered_parts(pattern: str) -> list[str] | None:
    """Literal parts of ``%a%b%``-shaped patterns, else None.

    Only patterns that start and end with ``%`` and contain no ``_`` qualify;
    backslash-escaped characters are literal.
    """
    parts, current, i = [], [], 0
    if not (pattern.startswith("%") and pattern.endswith("%")) or len(pattern) < 2:
        return None
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 >= len(pattern):
                return None
            current.append(pattern[i + 1])
            i += 2
            continue
        if c == "_":
            return None
        if c == "%":
            if current:
                parts.append("".join(current))
                current = []
        else:
            current.append(c)
        i += 1
    if current:  # the pattern ended with an escaped "%"
        return None
    return parts


def _ordered_contains(text: Column, parts: list[str], case_sensitive: bool) -> Column:
    """``%a%b%`` as a chain of ``locate`` calls: each part found after the end of
    the previous one.  Taking the leftmost occurrence of every part leaves the
    most room for the rest, so this equals the LIKE semantics, in linear time
    and inside whole-stage codegen (a multi-part LIKE is a backtracking regex)."""
    if not case_sensitive:
        text = F.lower(text)
    start: Column = F.lit(1)
    cond: Column = F.lit(True)
    for part in parts:
        needle = F.lit(part) if case_sensitive else F.lower(F.lit(part))
        found = _locate(needle, text, start)
        cond = cond & (found > 0)
        start = found + F.length(needle)
    return text.isNotNull() & cond


def _locate(needle: Column, text: Column, start: Column) -> Column:
    # F.locate takes a Python string and an int; the SQL function takes columns
    return F.call_function("locate", needle, text, start)


def match_condition(
    column: Column | str, pattern: Column | str, case_sensitive: bool = False, accent_sensitive: bool = True
) -> Column:
    """Wildcard match on the text form of any column.

    Null values never match.  A Python-string pattern stays a literal: one
    literal part lets Catalyst turn it into ``Contains``; several parts become
    an ordered ``locate`` chain; anything with ``_`` stays LIKE.  A Column
    pattern is matched per row.  Without ``accent_sensitive`` both sides lose their accents first.
    """
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    if not accent_sensitive:
        text = fold_accents(text)
        pattern = fold_accents_text(pattern) if isinstance(pattern, str) else fold_accents(pattern)
    if isinstance(pattern, str):
        parts = ordered_parts(pattern)
        if parts is not None and len(parts) >= 2:
            return _ordered_contains(text, parts, case_sensitive)
        return text.like(pattern) if case_sensitive else text.ilike(pattern)
    return F.like(text, pattern) if case_sensitive else F.ilike(text, pattern)


def validate(df: DataFrame, cfg: SearchConfig) -> None:
    """Check every configured column against ``df.schema`` before planning."""
    present = set(df.columns)
    missing = [c for c in cfg.required_columns if c not in present]
    if missing:
        raise ValueError(f"config {cfg.name or cfg.search_column!r}: columns not in source: {missing}")
    if cfg.on_missing_extra == "error":
        absent = [c for c in cfg.extra_columns if c not in present]
        if absent:
            raise ValueError(f"config {cfg.name or cfg.search_column!r}: extra columns not in source: {absent}")
    clash = [c for c in cfg.extra_columns if c in HIT_COLUMNS]
    if clash:
        raise ValueError(f"extra columns clash with hit columns: {clash}")


def dedup(columns: Iterable[str]) -> list[str]:
    seen: dict[str, None] = {}
    for c in columns:
        seen.setdefault(c, None)
    return list(seen)


def geom_column(cfg: SearchConfig) -> Column:
    if cfg.geom_column:
        return F.col(cfg.geom_column).cast("string").alias("geom")
    return F.lit(None).cast("string").alias("geom")


def srid_column(cfg: SearchConfig) -> Column:
    if cfg.authid_column:
        return srid_from_authid(cfg.authid_column).alias("epsg")
    if isinstance(cfg.srid, str):
        return F.col(cfg.srid).cast("int").alias("epsg")
    return F.lit(cfg.srid).cast("int").alias("epsg")


def hit_columns(df: DataFrame, cfg: SearchConfig, extra_struct: bool = False) -> list[Column]:
    """Projection of a matched source row onto the hit schema."""
    line = suggestion(
        df,
        cfg.search_column,
        cfg.display_columns,
        policy=cfg.policy,
        echo=cfg.echo_search_column,
        empty_is_null=cfg.empty_is_null,
        truncate30=cfg.truncate30,
        drop_zero=cfg.drop_zero,
    ).alias("suggestion")
    extras = []
    for c in dedup(cfg.extra_columns):
        extras.append(F.col(c).alias(c) if c in df.columns else F.lit("").alias(c))
    cols = [geom_column(cfg), srid_column(cfg), line]
    if extra_struct:
        cols.append((F.struct(*extras) if extras else F.struct()).alias("extra"))
    else:
        cols.extend(extras)
    if cfg.scale_expr is not None:
        cols.append(F.col(SCALE_COLUMN))
    if cfg.bbox_expr is not None:
        cols.append(F.col(BBOX_COLUMN))
    return cols


def with_user_expressions(df: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Evaluate the configured scale / bbox expressions on source rows."""
    if cfg.scale_expr is not None:
        df = with_expression(df, SCALE_COLUMN, cfg.scale_expr, DEFAULT_SCALE, "double")
    if cfg.bbox_expr is not None:
        df = with_expression(df, BBOX_COLUMN, cfg.bbox_expr, None, "string")
    return df


def order_columns(cfg: SearchConfig, prefix: str = "") -> list[Column]:
    """Search column ascending (raw type, nulls last), then the tie-break."""
    key = F.col(prefix + cfg.search_column)
    if cfg.collation:
        key = F.collate(key, cfg.collation)
    return [key.asc_nulls_last(), *[F.col(prefix + t).asc_nulls_last() for t in cfg.tie_break]]


# Parallel groups of the first merge of a top-n; the last merge reads n rows of each.
MERGE_GROUPS = 64


def top_k(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in ``order``, merged as a two-level tree.

    ``orderBy().limit(n)`` alone is ``TakeOrderedAndProject``: every map task
    keeps its best ``n`` rows and ONE task (or the driver, on collect) merges
    ``n`` x tasks rows, which on a scan of 10^5 tasks is the bottleneck.  So the
    map tasks are grouped by ``spark_partition_id() mod MERGE_GROUPS`` first;
    each forwards at most ``n`` rows (partial ``WindowGroupLimit``), the groups
    are merged in parallel, and the final top-n reads ``n`` rows per group.
    The same plan serves every input; planning it runs no job.
    """
    if n == 0:
        return df.limit(0)
    grouped = df.withColumn("__lk_grp", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    rank = F.row_number().over(Window.partitionBy("__lk_grp").orderBy(*order))
    merged = grouped.withColumn("__lk_rn", rank).where(F.col("__lk_rn") <= F.lit(n)).drop("__lk_grp", "__lk_rn")
    return merged.orderBy(*order).limit(n)


def apply_limit(df: DataFrame, cfg: SearchConfig, limit=None, ordered: bool = True) -> DataFrame:
    """Order and cut according to the limit mode.

    "Any n" rows are always those of the n smallest tie-break keys, so they do
    not depend on how the input is partitioned.  ``ordered=False`` spares the
    global sort where nothing is cut.
    """
    n = resolve_limit(cfg.limit if limit is None else limit, cfg.limit_mode)
    if cfg.limit_mode == "top_k" and n is not None:
        return top_k(df, order_columns(cfg), n)
    if n is not None:
        df = top_k(df, [F.col(t).asc_nulls_last() for t in cfg.tie_break], n)
    if cfg.limit_mode == "unordered" or (n is None and not ordered):
        return df
    return df.orderBy(*order_columns(cfg))


def search(
    df: DataFrame, text: str, cfg: SearchConfig, *, limit=None, extra_struct: bool = False, ordered: bool = True
) -> DataFrame:
    """All hits of ``text`` in ``df`` as ``[geom, epsg, suggestion, extra...]``.

    Text shorter than ``cfg.min_length`` raw characters gives no rows (B14g).
    ``ordered=False``: a search without a limit is not sorted.
    """
    validate(df, cfg)
    if text is None or len(text) < cfg.min_length:
        matched = df.where(F.lit(False))
    else:
        pattern = wildcard_pattern_text(text, cfg.escape_spec_chars, cfg.backslash)
        matched = df.where(match_condition(cfg.search_column, pattern, cfg.case_sensitive, cfg.accent_sensitive))
    # user expressions after the cut: evaluated for the returned rows only
    limited = with_user_expressions(apply_limit(matched, cfg, limit, ordered), cfg)
    return limited.select(*hit_columns(limited, cfg, extra_struct))


def multi_search(sources: Sequence[tuple[SearchConfig, DataFrame]], text: str) -> DataFrame:
    """The same text over several configured relations.

    Each branch keeps its own limit and its own scale and box expressions, whose
    values are the typed columns ``scale_denom`` and ``bbox_text`` (the default scale
    and null where a config has none).  ``extra`` becomes a JSON string so the branches
    share one schema.
    """
    if not sources:
        raise ValueError("multi_search needs at least one (config, DataFrame) pair")
    frames = []
    for cfg, df in sources:
        hits = search(df, text, cfg, extra_struct=True)
        scale = F.col(SCALE_COLUMN) if cfg.scale_expr is not None else F.lit(DEFAULT_SCALE)
        bbox = F.col(BBOX_COLUMN) if cfg.bbox_expr is not None else F.lit(None)
        extra = F.to_json(F.col("extra")) if cfg.extra_columns else F.lit("{}")
        frames.append(
            hits.select(
                F.lit(cfg.name).alias("config_name"),
                "geom",
                "epsg",
                "suggestion",
                extra.alias("extra"),
                scale.cast("double").alias(SCALE_COLUMN),
                bbox.cast("string").alias(BBOX_COLUMN),
            )
        )
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
