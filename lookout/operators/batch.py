"""Batch search: many search strings against one relation.

The reference runs one search per keystroke pause.  In bulk, a table of
search strings ``(query_id, text, k)`` is matched against the relation and each
query keeps its own top ``k`` hits ordered by the search column and the
tie-break key.  Two physical strategies return the same rows:

``scan``  for a handful of distinct patterns (counted first): one pass over
    the relation with each pattern as a literal matcher; a row yields only the
    patterns it matches.  No join.

``blocked``  (default at scale)  a row can only match a pattern if it contains
    every literal stretch of the pattern, so each pattern is reduced to one
    n-gram (n = 12, 6, 3 or shorter, as far as its longest literal stretch
    reaches; patterns without any literal character use the empty gram, which
    every row has).  Which of its n-grams is rarest is judged on a sample drawn by
    hash from the whole table (``SAMPLE_CHARS`` characters, ``SAMPLE_ROWS`` rows at
    least), or on ``gram_stats``; the choice changes the work, never the result.  Then one pass over the relation: up to ``MAX_LITERAL_GRAMS``
    chosen grams are looked for in the row itself; beyond, the row's distinct
    n-grams are exploded and equi-joined with the patterns on (n, gram) or,
    beyond ``max_broadcast_patterns``, on (n, gram, salt).  The full wildcard match
    verifies each candidate.  Grams whose document frequency exceeds
    ``rows_per_salt`` are salted: the pattern side is replicated over
    ``ceil(df / rows_per_salt)`` salts and the row side hashes its key into one
    of them, so a gram held by a third of all rows still spreads over many tasks.

Both strategies deduplicate patterns first (case-folded for case-insensitive
search), match on the search value and tie key only, keep the per-pattern top
``max(k)`` with a window whose ``WindowGroupLimit`` runs before the shuffle
(each task forwards at most ``k`` rows per pattern), build the hit columns for
those top rows only (late materialization), and join them back to the query
ids.  The driver sees only bounded, query-derived things: counts and small
summaries, the pattern literals of ``scan`` (at most ``max_scan_patterns``).
The query set and the per-pattern gram choice are checkpointed into
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.collation import accent_table, fold_accents
from ..functions.patterns import literal_runs, resolve_limit, wildcard_pattern
from ..session import ensure_checkpoint_dir
from .search import hit_columns, validate, with_user_expressions

STRATEGIES = ("auto", "scan", "blocked")
# n-gram lengths; a pattern may use those that its longest literal stretch reaches
GRAM_STEPS = (3, 6, 12)
GRAM = GRAM_STEPS[0]
# rows on which the rarest gram of a pattern is judged, at least; more while texts are short
SAMPLE_ROWS = 512
SAMPLE_CHARS = 1_000_000
# chosen grams that are looked for one by one in every row
MAX_LITERAL_GRAMS = 256
# k of a query without a limit
UNLIMITED = 2_147_483_647
# rows that a task writes where queries have no limit
ROWS_PER_TASK = 4_000_000
# tasks of such a search; beyond, each writes more rows
MOST_TASKS = 2000
# queries that are repeated together for hit after hit
RUN = 2048
# copies of queries or hits that a task makes
COPIES_PER_TASK = 500_000
# groups of patterns whose rows are summed on their own
STRETCHES = 256
# candidate pairs of row and pattern that a task verifies and sorts, where a row meets many patterns
PAIRS_PER_TASK = 2_000_000
# patterns that a row meets on average from which rows are dealt by pairs
PAIRS_PER_ROW = 32

_S = "__lk_search"
_T = "__lk_tie"
_P = "__lk_pattern"
_K = "__lk_k"
_PARTS = "__lk_parts"
_N = "__lk_n"
_G = "__lk_g"
_SALT = "__lk_salt"
_DF = "__lk_df"
_NSALT = "__lk_nsalt"
_BEST = "__lk_best"
_CHAIN = "__lk_chain"


def _tie_names(cfg: SearchConfig) -> list[str]:
    return [f"{_T}{i}" for i in range(len(cfg.tie_break))]


def prepare_queries(
    queries: DataFrame,
    cfg: SearchConfig,
    *,
    id_col: str = "query_id",
    text_col: str = "text",
    k_col: str | None = "k",
) -> DataFrame:
    """``(query_id, pattern, k)`` for every query long enough to run (B14g).

    A null ``k`` takes the config's limit, read as in single search; a config
    without a limit (DEC-9) gives ``UNLIMITED``.
    """
    default_k = resolve_limit(cfg.limit, cfg.limit_mode)
    default_k = UNLIMITED if default_k is None else default_k
    k = F.col(k_col) if k_col and k_col in queries.columns else F.lit(None)
    text = F.col(text_col)
    return queries.where(text.isNotNull() & (F.length(text) >= cfg.min_length)).select(
        F.col(id_col).alias("query_id"),
        wildcard_pattern(text, cfg.escape_spec_chars, cfg.backslash).alias("pattern"),
        F.coalesce(k.cast("int"), F.lit(default_k)).alias("k"),
    )


def _fold(text: Column, cfg: SearchConfig) -> Column:
    """``text`` as the config's case and accent rules see it."""
    if not cfg.accent_sensitive:
        text = fold_accents(text)
    return text if cfg.case_sensitive else F.lower(text)


def _pattern_key(pattern: Column, cfg: SearchConfig) -> Column:
    return _fold(pattern, cfg)


def _target(df: DataFrame, cfg: SearchConfig, with_hits: bool = False) -> DataFrame:
    """Searchable rows reduced to what matching needs: search value and tie key.

    Normally the hit columns (display line, geometry, extras, user
    expressions) are built later, only for the rows that make some pattern's
    top k (late materialization, :func:`_materialize`), so the n-gram explode
    and the candidate shuffle carry two narrow columns.  ``with_hits`` builds
    them here instead; that is used when the top set is too large to
    broadcast, because joining it back would reshuffle the whole source.
    """
    validate(df, cfg)
    clash = [c for c in cfg.extra_columns if c in ("query_id", "rank")]
    if clash:
        raise ValueError(f"extra columns clash with batch output columns: {clash}")
    src = df.where(F.col(cfg.search_column).isNotNull())
    keys = [F.col(cfg.search_column).alias(_S)] + [F.col(t).alias(n) for t, n in zip(cfg.tie_break, _tie_names(cfg))]
    if not with_hits:
        return src.select(*keys)
    src = with_user_expressions(src, cfg)
    return src.select(*keys, *hit_columns(src, cfg))


def _hit_names(target: DataFrame) -> list[str]:
    return [c for c in target.columns if c != _S and not c.startswith(_T)]


def _materialize(
    top: DataFrame, df: DataFrame, cfg: SearchConfig, top_bound: int, max_broadcast_hits: int
) -> tuple[DataFrame, list[str]]:
    """Hit columns for the per-pattern top rows only.

    ``top`` has at most ``top_bound`` rows (distinct patterns x largest k);
    within ``max_broadcast_hits`` it is broadcast and the source is probed
    map-side by search value and tie key (null-safe), so the source is scanned
    but not shuffled.  That key is unique: :func:`_top_k_per_pattern` checks it.
    """
    names = [_S, *_tie_names(cfg)]
    keys = top.select(_P, F.col("rank").alias("__lk_rank"), *[F.col(n).alias(f"{n}_k") for n in names])
    # only a counted bound may broadcast; otherwise a shuffle join, never a planner guess
    keys = F.broadcast(keys) if top_bound <= max_broadcast_hits else keys.hint("merge")
    src = df.select("*", *[F.col(t).alias(n) for t, n in zip((cfg.search_column, *cfg.tie_break), names)])
    joined = src.join(keys, [src[n].eqNullSafe(keys[f"{n}_k"]) for n in names])
    joined = with_user_expressions(joined, cfg)
    out = joined.select(_P, F.col("__lk_rank").alias("rank"), *hit_columns(joined, cfg))
    return out, out.columns[2:]


def _order(cfg: SearchConfig) -> list[Column]:
    key = F.col(_S)
    if cfg.collation:
        key = F.collate(key, cfg.collation)
    return [key.asc_nulls_last(), *[F.col(n).asc_nulls_last() for n in _tie_names(cfg)]]


def _top_k_per_pattern(candidates: DataFrame, cfg: SearchConfig, k_max: int) -> DataFrame:
    """Rank within each pattern.  The literal bound ``k_max`` lets Catalyst put a
    partial ``WindowGroupLimit`` before the shuffle, so no task forwards more
    than ``k_max`` rows of one pattern even when a third of all rows match it."""
    w = Window.partitionBy(_P).orderBy(*_order(cfg))
    ranked = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(k_max + 1))
    # equal keys are neighbours in this order, so the first k + 1 rows show every repeat that matters
    key = F.struct(_S, *_tie_names(cfg))
    error = F.raise_error(F.lit(f"tie_break {list(cfg.tie_break)} is not unique among rows of one search value (DEC-4)"))
    repeated = F.lag(key).over(w).eqNullSafe(key)
    rank = F.when((F.col("rank") > 1) & repeated, error.cast("int")).otherwise(F.col("rank"))
    return ranked.withColumn("rank", rank).where((F.col("rank") <= F.lit(k_max)) & (F.col("rank") <= F.col(_K)))


def _ranked(candidates: DataFrame, cfg: SearchConfig, k_max: int, limited: bool) -> DataFrame:
    """Top rows of limited patterns with their rank; all rows of others, rank null."""
    if limited:
        return _top_k_per_pattern(candidates, cfg, k_max)
    return candidates.withColumn("rank", F.lit(None).cast("int"))


def _met_in_tiles(top: DataFrame, q: DataFrame, cfg: SearchConfig, hit_names: list[str]) -> DataFrame:
    """Every query of a pattern without a limit with every hit of it: ``(query_id, rank, hits)``.

    Hits are saved once and the rows that each pattern makes are counted: it owns a stretch of all
    those rows.  Its queries and hits are dealt by hash into blocks, and a block of each is a tile of
    the stretch, so both sides are shuffled and copied once per block of the other, and neither is
    broadcast.  Every ``ROWS_PER_TASK`` rows are one task, more beyond ``MOST_TASKS``; a tile is half
    of one on average.  Within a tile runs of ``RUN`` queries are repeated hit by hit: a task writes
    few distinct values in short cycles, which a columnar file packs well.
    """
    ensure_checkpoint_dir(top.sparkSession)
    top = top.select(_P, "rank", *hit_names).checkpoint(eager=True)
    asked = q.groupBy(_P).agg(F.count(F.lit(1)).alias("__lk_qn"))
    found = top.groupBy(_P).agg(F.count(F.lit(1)).alias("__lk_hn"))
    made = found.join(asked, _P).select(
        _P,
        "__lk_qn",
        "__lk_hn",
        (F.col("__lk_qn").cast("double") * F.col("__lk_hn")).alias("__lk_made"),
        F.pmod(F.xxhash64(_P), F.lit(STRETCHES)).cast("int").alias("__lk_part"),
    )
    # at most STRETCHES rows reach the driver
    sums = {r["__lk_part"]: r["n"] for r in made.groupBy("__lk_part").agg(F.sum("__lk_made").alias("n")).collect()}
    rows = max(sum(sums.values()), 1.0)
    tasks = int(-(-rows // max(ROWS_PER_TASK, rows / MOST_TASKS)))
    side = max(1.0, math.sqrt(rows / tasks / 2))
    shares = int(-(-rows / side // COPIES_PER_TASK))
    begins = F.array(*[F.lit(float(x)) for x in accumulate((sums.get(k, 0.0) for k in range(STRETCHES - 1)), initial=0.0)])
    before = Window.partitionBy("__lk_part").orderBy(_P).rowsBetween(Window.unboundedPreceding, -1)
    start = F.get(begins, F.col("__lk_part")) + F.coalesce(F.sum("__lk_made").over(before), F.lit(0.0))
    blocks = [F.ceil(F.col(n) / F.lit(side)).cast("int").alias(b) for n, b in (("__lk_qn", "__lk_qb"), ("__lk_hn", "__lk_hb"))]
    # counted by the caller: the patterns are few enough
    owned = F.broadcast(made.select(_P, "__lk_made", start.alias("__lk_start"), *blocks))

    def in_blocks(df: DataFrame, item: Column, own: str, other: str, name: str) -> DataFrame:
        # by place, not by value, as ids may repeat; both sides are read from checkpoints, so places hold
        placed = df.select(_P, item.alias(name), F.xxhash64(F.monotonically_increasing_id()).alias("__lk_at"))
        placed = placed.repartition(shares, "__lk_at") if shares > 1 else placed
        return placed.join(owned, _P).select(
            "__lk_made",
            "__lk_start",
            "__lk_qb",
            "__lk_hb",
            F.pmod(F.col("__lk_at"), F.col(own)).cast("int").alias(f"{own}_i"),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_i"),
            name,
        )

    asks = in_blocks(q, F.struct("query_id"), "__lk_qb", "__lk_hb", "__lk_q")
    hits = [F.col(_q(c)).alias(f"c{i}") for i, c in enumerate(("rank", *hit_names))]
    gives = in_blocks(top, F.struct(*hits), "__lk_hb", "__lk_qb", "__lk_h")
    tile = F.col("__lk_qb_i").cast("double") * F.col("__lk_hb") + F.col("__lk_hb_i") + F.lit(0.5)
    middle = F.col("__lk_start") + tile / (F.col("__lk_qb").cast("double") * F.col("__lk_hb")) * F.col("__lk_made")
    task = F.least(F.floor(middle * F.lit(tasks / rows)).cast("int"), F.lit(tasks - 1))
    both = asks.unionByName(gives, allowMissingColumns=True).withColumn("__lk_task", task).repartitionById(tasks, "__lk_task")
    tiles = both.groupBy("__lk_task", "__lk_start", "__lk_qb_i", "__lk_hb_i").agg(
        F.collect_list("__lk_q").alias("__lk_qs"), F.collect_list("__lk_h").alias("__lk_hs")
    )
    begin = F.sequence(F.lit(0), F.greatest(F.size("__lk_qs") - 1, F.lit(0)), F.lit(RUN))
    runs = F.transform(begin, lambda x: F.transform(F.slice("__lk_qs", x + 1, F.lit(RUN)), lambda y: y["query_id"]))
    run = tiles.select("__lk_hs", F.explode(runs).alias("__lk_run"))
    # a row for each hit and run, so that no task holds more than a run of finished rows
    pairs = F.transform("__lk_hs", lambda h: F.struct(h.alias("h"), F.col("__lk_run").alias("run")))
    pair = run.select(F.explode(pairs).alias("__lk_pair"))
    out = [F.col(f"__lk_pair.h.c{i}").alias(c) for i, c in enumerate(("rank", *hit_names))]
    return pair.select(F.explode("__lk_pair.run").alias("query_id"), "__lk_pair").select("query_id", *out)


def _finish(
    top: DataFrame,
    prepared: DataFrame,
    cfg: SearchConfig,
    hit_names: list[str],
    top_bound: int,
    max_broadcast_hits: int,
    queries_per_salt: int = 1_000_000,
    max_hot_patterns: int = 100_000,
    limited: bool = True,
) -> DataFrame:
    """Join per-pattern top rows back to query ids; cut at each query's own k.

    ``top_bound`` (distinct patterns x largest k) is a proven upper bound on the
    rows of ``top``.  Within ``max_broadcast_hits`` the top rows are broadcast,
    so the query side is never shuffled.  Above it both sides shuffle on
    (pattern, salt): patterns with more than ``queries_per_salt`` queries (found
    with a partial-aggregated count; at most ``max_hot_patterns`` of them, so
    that set is broadcast) split their queries over
    ``ceil(queries / queries_per_salt)`` salts by query id, and their top rows
    are replicated to every salt.  A pattern typed by a third of all users thus
    spreads over many tasks.  Without a limit (``top_bound`` is patterns x ``UNLIMITED``) and with no
    more than ``max_broadcast_hits`` patterns, queries and hits meet in tiles (:func:`_met_in_tiles`).
    """
    q = prepared.select("query_id", _pattern_key(F.col("pattern"), cfg).alias(_P), F.col("k").alias("__lk_qk"))
    if top_bound <= max_broadcast_hits:
        joined = q.join(F.broadcast(top), _P)
    elif not limited and top_bound <= max_broadcast_hits * UNLIMITED:
        return _met_in_tiles(top, q, cfg, hit_names).select("query_id", "rank", *hit_names)
    else:
        total = prepared.count()
        per_salt = max(queries_per_salt, -(-total // max(max_hot_patterns, 1)))  # bounds the hot set
        counts = q.groupBy(_P).agg(F.count(F.lit(1)).alias("__lk_qn"))
        hot = counts.where(F.col("__lk_qn") > per_salt).select(
            _P, F.ceil(F.col("__lk_qn") / F.lit(per_salt)).cast("int").alias("__lk_qs")
        )
        hot = F.broadcast(hot)  # at most total / per_salt <= max_hot_patterns rows
        salts = F.coalesce(F.col("__lk_qs"), F.lit(1))
        q_side = q.join(hot, _P, "left").select(
            "query_id", _P, "__lk_qk", F.pmod(F.xxhash64("query_id"), salts).cast("int").alias("__lk_qsalt")
        )
        t_side = top.join(hot, _P, "left").select(
            "*", F.explode(F.sequence(F.lit(0), salts - 1)).alias("__lk_qsalt")
        ).drop("__lk_qs")
        joined = q_side.join(t_side.hint("merge"), [_P, "__lk_qsalt"])
    if limited:
        joined = joined.where(F.col("rank") <= F.col("__lk_qk"))
    return joined.select("query_id", "rank", *hit_names)


def _distinct_patterns(prepared: DataFrame, cfg: SearchConfig) -> DataFrame:
    """One row per distinct (case-folded) pattern, with its largest k and the
    pieces of its verification: literal parts and whether they suffice."""
    pats = prepared.groupBy(_pattern_key(F.col("pattern"), cfg).alias(_P)).agg(F.max("k").alias(_K))
    tokens = F.regexp_extract_all(F.col(_P), F.lit(r"(?s)(\\.|%|_|[^%_\\]+)"), 1)
    chain = (
        ~F.array_contains(tokens, "_")
        & (F.size(tokens) > 0)
        & (F.get(tokens, 0) == F.lit("%"))
        & (F.element_at(tokens, -1) == F.lit("%"))
    )
    parts = F.transform(literal_runs(F.col(_P)), lambda r: _fold(r, cfg))
    return pats.select(_P, _K, parts.alias(_PARTS), chain.alias(_CHAIN))


def _q(name: str) -> str:
    return "`" + name + "`"


def verify(cfg: SearchConfig) -> Column:
    """Exact match of a candidate row against its pattern.

    Patterns made only of ``%``-separated literal parts (the usual case) are
    checked with an ordered ``locate`` chain over the once-folded text, in
    linear time; others (``_`` wildcards) use LIKE / ILIKE, which compiles the
    row's pattern into a backtracking regex.
    """
    text = f"CAST({_q(_S)} AS STRING)"
    if not cfg.accent_sensitive:
        accented, bases = accent_table()
        text = f"regexp_replace(translate({text}, '{accented}', '{bases}'), '\\\\p{{M}}+', '')"
    fold = text if cfg.case_sensitive else f"lower({text})"
    chain = (
        f"transform(array({fold}), vt -> aggregate({_q(_PARTS)}, named_struct('ok', true, 'f', 1, 'l', 0), "
        "(acc, part) -> named_struct('ok', acc.ok AND acc.f > 0, 'f', locate(part, vt, acc.f + acc.l), "
        "'l', length(part)), acc -> acc.ok AND acc.f > 0))[0]"
    )
    op = "LIKE" if cfg.case_sensitive else "ILIKE"
    like = f"{text} {op} {_q(_P)}"
    return F.expr(f"{_q(_S)} IS NOT NULL AND CASE WHEN {_q(_CHAIN)} THEN {chain} ELSE {like} END")


def scan_search(
    df: DataFrame,
    prepared: DataFrame,
    cfg: SearchConfig,
    *,
    listed: list[tuple[str, int]],
    k_max: int,
    max_broadcast_hits: int = 1_000_000,
    queries_per_salt: int = 1_000_000,
    spread_to: int | None = None,
    limited: bool = True,
) -> DataFrame:
    """Few distinct patterns: one pass over the relation, no join.

    The distinct patterns and their k (``listed``, a counted few) become
    literals of the plan; every row gets the array of patterns it matches
    (each literal matcher is a ``Contains`` or an ordered ``locate`` chain, as
    in single search) and that array is exploded, so only matching
    (row, pattern) pairs are ever produced.
    """
    from .search import match_condition

    n = len(listed)
    late = limited and n * k_max <= max_broadcast_hits
    target = spread(_target(df, cfg, with_hits=not late), _tie_names(cfg), spread_to)
    matched = F.array(
        *[
            F.when(match_condition(F.col(_S), p, cfg.case_sensitive, cfg.accent_sensitive), F.struct(F.lit(p).alias(_P), F.lit(k).alias(_K)))
            for p, k in listed
        ]
    ) if listed else F.array().cast(f"array<struct<{_P}:string,{_K}:int>>")
    hits = target.select(*target.columns, F.explode(F.filter(matched, lambda m: m.isNotNull())).alias("__lk_m"))
    cand = hits.select(*target.columns, F.col(f"__lk_m.{_P}").alias(_P), F.col(f"__lk_m.{_K}").alias(_K))
    top = _ranked(cand, cfg, k_max, limited)
    if late:
        hits, hit_names = _materialize(top, df, cfg, n * k_max, max_broadcast_hits)
    else:
        hits, hit_names = top, _hit_names(target)
    return _finish(hits, prepared, cfg, hit_names, n * k_max, max_broadcast_hits, queries_per_salt, limited=limited)


def _gram_regex(n: Column | int) -> Column:
    """Zero-width look-ahead capturing the next ``n`` characters at every position:
    one linear regex pass yields all n-grams (``substring`` per position would
    rescan the string from its start each time)."""
    if isinstance(n, int):
        return F.lit(f"(?s)(?=(.{{{n}}}))")
    return F.concat(F.lit("(?s)(?=(.{"), n.cast("string"), F.lit("}))"))


def _grams(text: Column, n: Column | int) -> Column:
    """Distinct substrings of length ``n`` (``n`` = 0 gives the empty gram)."""
    grams = F.array_distinct(F.regexp_extract_all(text, _gram_regex(n), 1))
    if isinstance(n, int):
        return F.array(F.lit("")) if n == 0 else grams
    return F.when(n == 0, F.array(F.lit(""))).otherwise(grams)


def spread(df: DataFrame, keys: list[str], to: int | None) -> DataFrame:
    """``df`` hash-spread to ``to`` partitions, or as it is for None.

    For a relation that is read in a few large tasks (one small file, one
    database connection) and then exploded.  Only the caller can know that.
    """
    return df if to is None else df.repartition(to, *[F.col(k) for k in keys])


def _longest_run() -> Column:
    """Length of a pattern's longest literal stretch."""
    return F.coalesce(F.array_max(F.transform(F.col(_PARTS), F.length)), F.lit(0))


def pair_tasks(pairs: float, rows: float) -> int | None:
    """Tasks that ``rows`` are to be spread to before they meet their patterns: each match is sorted
    where its row is read, so where a row meets many patterns tasks are cut by pairs, not by bytes."""
    if pairs < PAIRS_PER_ROW * rows or pairs <= PAIRS_PER_TASK:
        return None
    return int(-(-pairs // PAIRS_PER_TASK))


def pattern_grams(patterns: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Every candidate blocking gram of every pattern: ``(pattern, k, parts, chain, n, g)``."""
    longest = _longest_run()
    steps = F.filter(F.array(*map(F.lit, GRAM_STEPS)), lambda n: n <= longest)
    steps = F.when(longest >= GRAM, steps).otherwise(F.array(longest.cast("int")))
    staged = patterns.select(_P, _K, _PARTS, _CHAIN, F.explode(steps).alias(_N))
    usable = F.filter(F.col(_PARTS), lambda r: F.length(r) >= F.col(_N))
    grams = F.array_distinct(F.flatten(F.transform(usable, lambda r: _grams(r, F.col(_N)))))
    # a pattern without any literal character (blank text -> "%") uses the empty gram
    grams = F.when(F.col(_N) == 0, F.array(F.lit(""))).otherwise(grams)
    return staged.select(_P, _K, _PARTS, _CHAIN, _N, F.explode(grams).alias(_G))


def table_grams(target: DataFrame, sizes: list[int], cfg: SearchConfig, columns: list[str]) -> DataFrame:
    """Rows exploded into their distinct n-grams for each needed ``n``."""
    folded = target.select(*columns, _fold(F.col(_S).cast("string"), cfg).alias("__lk_fold"))
    frames = []
    for n in sizes:
        frames.append(folded.select(*columns, F.lit(n).alias(_N), F.explode(_grams(F.col("__lk_fold"), n)).alias(_G)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def gram_frequencies(df: DataFrame, cfg: SearchConfig, sizes=(0, 1, 2, GRAM)) -> DataFrame:
    """Document frequency of every n-gram of the search column: ``(n, g, df)``.

    One pass with partial aggregation.  Save it next to the table and pass it
    as ``gram_stats`` to repeated batch searches to skip their frequency pass;
    it must be built with the same case rule as the search.
    """
    grams = table_grams(_target(df, cfg), list(sizes), cfg, [])
    counted = grams.groupBy(_N, _G).agg(F.count(F.lit(1)).alias(_DF))
    return counted.select(F.col(_N).alias("n"), F.col(_G).alias("g"), F.col(_DF).alias("df"))


def sampled(target: DataFrame, total: int, cfg: SearchConfig) -> tuple[DataFrame, int]:
    """About one row in ``every``, and ``every``: drawn by hash from all ``total`` rows, because the first
    rows of a sorted table hold other n-grams than the rest."""
    names = [_S, *_tie_names(cfg)]
    length = F.avg(F.length(F.col(_S).cast("string"))).alias("n")
    mean = target.select(_S).limit(SAMPLE_ROWS).agg(length).first()["n"] or 0
    wanted = max(SAMPLE_ROWS, int(SAMPLE_CHARS / max(mean, 1)))
    every = max(1, total // wanted)
    if every == 1:
        return target.select(*names), 1
    drawn = F.pmod(F.xxhash64(F.lit("sample"), *[F.col(n) for n in names]), F.lit(every)) == 0
    # keys that repeat may be drawn together: the sample is bounded all the same
    return target.select(*names).where(drawn).limit(4 * wanted), every


def choose_grams(
    target: DataFrame,
    pats: DataFrame,
    cfg: SearchConfig,
    *,
    sizes: list[int],
    gram_stats: DataFrame | None = None,
) -> DataFrame:
    """Per pattern its rarest gram: ``(pattern, k, parts, chain, n, g, df)``, checkpointed.

    ``df`` counts the rows of ``target``, a sample (:func:`sampled`), or those of ``gram_stats`` where
    that has the gram's length; among equally rare grams the longest is taken.  ``sizes`` are the
    lengths that the patterns use.
    """
    ensure_checkpoint_dir(target.sparkSession)
    own = pattern_grams(pats, cfg)
    freq = table_grams(target, sizes or [GRAM], cfg, []).groupBy(_N, _G).agg(F.count(F.lit(1)).alias(_DF))
    if gram_stats is not None:
        exact = gram_stats.select(F.col("n").alias(_N), F.col("g").alias(_G), F.col("df").alias(_DF))
        freq = freq.where(F.col(_N) > GRAM).unionByName(exact)
    # grams that many patterns share would be a hot key of a shuffled join: each is looked up once
    needed = own.select(_N, _G).distinct().join(freq.hint("merge"), [_N, _G], "left")
    scored = own.join(needed.hint("merge"), [_N, _G], "left").withColumn(_DF, F.coalesce(F.col(_DF), F.lit(0)))
    # by hash among equals: the least in order would be the one with leading zeros, which many rows hold
    rarest = F.min_by(F.struct(_N, _G, _DF), F.struct(_DF, -F.col(_N), F.xxhash64(_G), _G)).alias(_BEST)
    best = scored.groupBy(_P, _K, _PARTS, _CHAIN).agg(rarest)
    return best.select(_P, _K, _PARTS, _CHAIN, f"{_BEST}.*").checkpoint(eager=True)


def literal_grams(target: DataFrame, grams: list[tuple[int, str]], cfg: SearchConfig, columns: list[str]) -> DataFrame:
    """Rows with those of a few grams that they contain: ``(columns, n, g)``, without listing all of a row's grams."""
    listed = F.array(*[F.struct(F.lit(n).alias(_N), F.lit(g).alias(_G)) for n, g in grams])
    folded = target.select(*columns, _fold(F.col(_S).cast("string"), cfg).alias("__lk_fold"))
    held = F.filter(listed, lambda x: F.contains(F.col("__lk_fold"), x[_G]))
    return folded.select(*columns, F.explode(held).alias("__lk_x")).select(*columns, f"__lk_x.{_N}", f"__lk_x.{_G}")


def blocked_search(
    df: DataFrame,
    prepared: DataFrame,
    cfg: SearchConfig,
    *,
    patterns: int,
    k_max: int,
    sizes: list[int],
    rows_per_salt: int = 1_000_000,
    max_broadcast_hits: int = 1_000_000,
    gram_stats: DataFrame | None = None,
    queries_per_salt: int = 1_000_000,
    max_broadcast_patterns: int = 50_000,
    max_literal_grams: int = MAX_LITERAL_GRAMS,
    spread_to: int | None = None,
    limited: bool = True,
) -> DataFrame:
    """n-gram blocking, then exact verification (same rows as ``scan``).

    ``patterns``, ``k_max`` and ``sizes``: the counted distinct patterns, the largest k and the
    gram lengths they use (:func:`_summary`).
    """
    pats = _distinct_patterns(prepared, cfg).where(F.col(_K) > 0)
    target = _target(df, cfg)
    total = target.count()
    some, every = sampled(target, total, cfg)
    chosen = choose_grams(some, pats, cfg, sizes=sizes, gram_stats=gram_stats)
    target = spread(target, _tie_names(cfg), spread_to)
    listed = chosen.select(_N, _G).distinct().limit(max_literal_grams + 1).collect()
    bound = patterns * k_max
    late = limited and bound <= max_broadcast_hits
    in_all = None
    if patterns > max_broadcast_patterns or (spread_to is None and patterns >= PAIRS_PER_ROW):
        share = float(every)  # frequencies in the sample, scaled to the table
        in_all = F.when(F.col(_N) <= GRAM, F.col(_DF)).otherwise(F.col(_DF) * share) if gram_stats is not None else (
            F.col(_DF) * share
        )
        if spread_to is None and patterns <= max_broadcast_patterns:
            spread_to = pair_tasks(chosen.agg(F.sum(in_all).alias("n")).first()["n"] or 0, total)
            if late:
                target = spread(target, _tie_names(cfg), spread_to)
    if not late:
        target = spread(_target(df, cfg, with_hits=True), _tie_names(cfg), spread_to)
    if 0 < len(listed) <= max_literal_grams:
        rows = literal_grams(target, [(r[_N], r[_G]) for r in listed], cfg, target.columns)
    else:
        rows = table_grams(target, sizes or [GRAM], cfg, target.columns)
    if patterns <= max_broadcast_patterns:
        # counted: the patterns go to the rows, and only verified matches are shuffled
        cand = rows.join(F.broadcast(chosen), [_N, _G]).where(verify(cfg))
    else:
        nsalt = F.greatest(F.lit(1), F.ceil(in_all / F.lit(rows_per_salt)).cast("int"))
        cand = _salted_candidates(rows, chosen.withColumn(_NSALT, nsalt), cfg)
    top = _ranked(cand, cfg, k_max, limited)
    if late:
        hits, hit_names = _materialize(top, df, cfg, bound, max_broadcast_hits)
    else:
        hits, hit_names = top, _hit_names(target)
    return _finish(hits, prepared, cfg, hit_names, bound, max_broadcast_hits, queries_per_salt, limited=limited)


def _salted_candidates(rows: DataFrame, chosen: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Verified matches by a shuffled join; a frequent gram's rows are spread over its salts."""
    gram_salts = chosen.groupBy(_N, _G).agg(F.max(_NSALT).alias(_NSALT))
    rows = rows.join(gram_salts.hint("merge"), [_N, _G])
    tie = [F.col(n) for n in _tie_names(cfg)]
    rows = rows.withColumn(_SALT, F.pmod(F.xxhash64(*tie), F.col(_NSALT)).cast("int")).drop(_NSALT)
    salts = F.explode(F.sequence(F.lit(0), F.col(_NSALT) - 1)).alias(_SALT)
    salted = chosen.drop(_NSALT).join(gram_salts.hint("merge"), [_N, _G]).select(_P, _K, _PARTS, _CHAIN, _N, _G, salts)
    # the salted shuffle join is the design: never let a size estimate of the
    # exploded rows (which undershoots after explode) turn it into a broadcast
    return rows.join(salted.hint("merge"), [_N, _G, _SALT]).where(verify(cfg))


def _summary(prepared: DataFrame, cfg: SearchConfig, most: int) -> dict[bool, dict]:
    """For queries with and without a limit: ``patterns`` (distinct ones that ask for rows), their
    largest ``k_max``, the gram ``sizes`` that they may use, and the patterns ``listed`` themselves
    if there are at most ``most`` in all.  One small job; a second one where there are more."""
    limited = (F.col("k") < UNLIMITED).alias("limited")
    pats = prepared.groupBy(limited, _pattern_key(F.col("pattern"), cfg).alias(_P)).agg(F.max("k").alias(_K))
    run = F.array_max(F.transform(literal_runs(F.col(_P)), lambda r: F.length(_fold(r, cfg))))
    pats = pats.withColumn("run", F.least(F.coalesce(run, F.lit(0)), F.lit(GRAM_STEPS[-1])))
    first = pats.limit(most + 1).collect()
    if len(first) <= most:
        rows = []
        for flag in {r["limited"] for r in first}:
            own = [r for r in first if r["limited"] == flag]
            asking = [r for r in own if r[_K] > 0]
            rows.append((flag, len(asking), max((r[_K] for r in own), default=0), {r["run"] for r in asking},
                         [(r[_P], r[_K]) for r in asking]))
    else:
        asking = F.col(_K) > 0
        grouped = pats.groupBy("limited").agg(
            F.count_if(asking).alias("n"), F.max(_K).alias("k"), F.collect_set(F.when(asking, F.col("run"))).alias("runs")
        )
        rows = [(r["limited"], r["n"], r["k"], set(r["runs"]), None) for r in grouped.collect()]  # two rows
    out = {}
    for flag, n, k_max, runs, listed in rows:
        sizes = {size for run in runs for size in (GRAM_STEPS if run >= GRAM else (run,)) if size <= run}
        out[flag] = {"patterns": n, "k_max": int(k_max or 0), "sizes": sorted(sizes), "listed": listed}
    return out or {True: {"patterns": 0, "k_max": 0, "sizes": [], "listed": []}}


def batch_search(
    df: DataFrame,
    queries: DataFrame,
    cfg: SearchConfig,
    *,
    strategy: str = "auto",
    id_col: str = "query_id",
    text_col: str = "text",
    k_col: str | None = "k",
    scan_max_patterns: int = 16,
    max_scan_patterns: int = 64,
    max_literal_grams: int = MAX_LITERAL_GRAMS,
    rows_per_salt: int = 1_000_000,
    max_broadcast_hits: int = 1_000_000,
    gram_stats: DataFrame | None = None,
    queries_per_salt: int = 1_000_000,
    max_broadcast_patterns: int = 50_000,
    spread_to: int | None = None,
) -> DataFrame:
    """Top ``k`` hits per query: ``[query_id, rank, geom, epsg, suggestion, extra...]``.

    ``auto`` scans once with literal matchers for at most ``scan_max_patterns``
    distinct patterns and uses n-gram blocking otherwise; ``scan`` beyond
    ``max_scan_patterns`` is blocked as well.  A query without a limit (null k and a
    config without one, DEC-9) keeps all its hits, with a null rank.  ``spread_to``
    spreads a relation that is read in too few tasks.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    # The query side feeds several small planning actions (pattern counts, gram
    # choice, k bound); checkpoint it once so an expensive upstream (a debounced
    # stream, a join) is not recomputed for each, and lineage stays short.
    ensure_checkpoint_dir(df.sparkSession)
    prepared = prepare_queries(queries, cfg, id_col=id_col, text_col=text_col, k_col=k_col).checkpoint(eager=True)
    return search_patterns(
        df,
        prepared,
        cfg,
        strategy=strategy,
        scan_max_patterns=scan_max_patterns,
        max_scan_patterns=max_scan_patterns,
        max_literal_grams=max_literal_grams,
        rows_per_salt=rows_per_salt,
        max_broadcast_hits=max_broadcast_hits,
        gram_stats=gram_stats,
        queries_per_salt=queries_per_salt,
        max_broadcast_patterns=max_broadcast_patterns,
        spread_to=spread_to,
    )


def search_patterns(
    df: DataFrame,
    prepared: DataFrame,
    cfg: SearchConfig,
    *,
    strategy: str = "auto",
    scan_max_patterns: int = 16,
    max_scan_patterns: int = 64,
    max_literal_grams: int = MAX_LITERAL_GRAMS,
    rows_per_salt: int = 1_000_000,
    max_broadcast_hits: int = 1_000_000,
    gram_stats: DataFrame | None = None,
    queries_per_salt: int = 1_000_000,
    max_broadcast_patterns: int = 50_000,
    spread_to: int | None = None,
) -> DataFrame:
    """:func:`batch_search` for queries that are patterns already: ``(query_id, pattern, k)``,
    a null k for no limit.  ``prepared`` is read several times."""
    prepared = prepared.withColumn("k", F.coalesce("k", F.lit(UNLIMITED)))
    found = _summary(prepared, cfg, max(scan_max_patterns, max_scan_patterns))
    parts = []
    for limited, about in sorted(found.items(), reverse=True):
        own = prepared.where(F.col("k") < UNLIMITED) if limited else prepared.where(F.col("k") == UNLIMITED)
        most = scan_max_patterns if strategy == "auto" else max_scan_patterns
        shared = dict(
            k_max=about["k_max"], limited=limited, spread_to=spread_to,
            max_broadcast_hits=max_broadcast_hits, queries_per_salt=queries_per_salt,
        )
        if strategy != "blocked" and about["listed"] is not None and about["patterns"] <= most:
            parts.append(scan_search(df, own, cfg, listed=about["listed"], **shared))
            continue
        parts.append(
            blocked_search(
                df,
                own,
                cfg,
                patterns=about["patterns"],
                sizes=about["sizes"],
                rows_per_salt=rows_per_salt,
                gram_stats=gram_stats,
                max_broadcast_patterns=max_broadcast_patterns,
                max_literal_grams=max_literal_grams,
                **shared,
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
