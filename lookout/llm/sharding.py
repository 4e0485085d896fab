"""Operator 2: sharding by a k-d tree of weighted medians, in DataFrame operations only.

Equal texts form a group, weighed by its bytes.  The metadata columns are mapped to positions
of 30 bits (numbers by their range, strings by a hash) with 32 bits of the text's hash below,
so that ties can be cut.  A node of the tree owns a range of shards; it is split along its widest
dimension where the left shards' bytes are reached.  That weighted quantile is found by
histograms of at most ``BINS`` bins a node, refined round by round, so the driver sees a bounded
number of sums and nothing is sorted.

Groups heavier than a 64th of a shard, at most 64 a shard, would spoil the medians.  They are
dealt first, the heaviest to the emptiest shard, and the tree fills what the shards have left.
Only a group that no shard has room for is cut, between copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, written

SHARDS = 8
HEAVY = 64
BINS = 1024
#: A quantile is refined until the bin it falls into is at most this share of a shard.
TOLERANCE = 0.0005
_TOP = (1 << 30) - 1


def _positions(docs: DataFrame, dimensions: list[str]) -> list[Column]:
    """Every dimension as a number from 0 to 2^30 - 1; null is 0."""
    numeric = [c for c in dimensions if isinstance(docs.schema[c].dataType, T.NumericType)]
    range_of = {}
    if numeric:
        row = docs.agg(*(f(F.col(c).cast("double")) for c in numeric for f in (F.min, F.max))).first()
        range_of = {c: (row[2 * k], row[2 * k + 1]) for k, c in enumerate(numeric)}
    out = []
    for c in dimensions:
        if c in range_of:
            low, high = range_of[c]
            if low is None or not high > low:
                at = F.lit(0)
            else:
                at = F.floor((F.col(c).cast("double") - low) / (high - low) * _TOP)
        else:
            at = F.shiftright(F.crc32(F.col(c).cast("string").cast("binary")), 2)
        out.append(F.coalesce(at.cast("long"), F.lit(0)))
    return out


def _deal(heavy: list[tuple[int, int, int]], shards: int, target: float) -> tuple[list[tuple], list[float]]:
    """Places of the heavy groups (key, bytes, rows): (key, first row, end row, shard); and loads."""
    load, places = [0.0] * shards, []
    for key, size, rows in sorted(heavy, key=lambda x: (-x[1], x[0])):
        each, done = size / rows, 0
        while done < rows:
            shard = min(range(shards), key=load.__getitem__)
            room = target * (1 + 1 / HEAVY) - load[shard]
            left = rows - done
            take = left if left * each <= room else max(1, min(left, int((target - load[shard]) / each)))
            places.append((key, done, done + take, shard))
            load[shard] += take * each
            done += take
    return places, load


def _cuts(groups: DataFrame, node: Column, wanted: dict[int, tuple[str, int, int, float]], least: float) -> dict[int, int]:
    """For each node (dimension, lowest, highest key, bytes): the key up to which the bytes go left."""
    ranges = {n: (low, high, 0.0) for n, (_, low, high, _) in wanted.items()}
    done: dict[int, int] = {}
    while len(done) < len(wanted):
        live = [n for n in wanted if n not in done]
        bin_of, width = F.lit(None).cast("long"), {}
        for n in live:
            low, high, _ = ranges[n]
            width[n] = max(1, -(-(high - low + 1) // BINS))
            key = F.col(wanted[n][0])
            inside = (node == n) & (key >= low) & (key <= high)
            bin_of = F.when(inside, F.expr(f"({wanted[n][0]} - {low}) div {width[n]}")).otherwise(bin_of)
        sums = groups.select(node.alias("node"), bin_of.cast("long").alias("bin"), "w").where("bin is not null")
        found: dict[int, list] = {n: [] for n in live}
        for r in sums.groupBy("node", "bin").agg(F.sum("w").alias("w")).collect():  # at most nodes * BINS rows
            found[r["node"]].append((r["bin"], r["w"]))
        for n in live:
            low, high, before = ranges[n]
            goal = wanted[n][3]
            for at, w in sorted(found[n]):
                if before + w >= goal:
                    break
                before += w
            first, last = low + at * width[n], min(high, low + (at + 1) * width[n] - 1)
            if width[n] == 1 or w <= least:
                done[n] = last if before + w - goal <= goal - before else first - 1
            else:
                ranges[n] = (first, last, before)
    return done


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small table of whole numbers."""
    body = ", ".join("(" + ", ".join(f"CAST({int(v)} AS BIGINT)" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dimensions: tuple[str, ...] = ("source", "lang", "n_chars"),
    *,
    shards: int = SHARDS,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    The law is ``bytes``: shards of nearly equal bytes, equal texts together.  Size is the UTF-8
    length plus 1; a null text has no bytes and groups with other nulls.  Null ids and repeated
    rows are sharded like any row; null dimensions sit at position 0.  Dimensions that ``docs``
    lacks are left out; columns not named are ignored, whatever their names.  Empty input: empty
    result.
    """
    spark = docs.sparkSession
    dimensions = [c for c in dimensions if c in docs.columns]
    axes = [f"axis{k}" for k in range(len(dimensions) + 1)]
    text = F.col(text_col).cast("string")
    low = F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))
    positions = [*_positions(docs, dimensions), F.pmod(F.xxhash64(text, F.lit(1)), F.lit(_TOP + 1))]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("g"),
        *((F.shiftleft(p, 32) + low).alias(a) for p, a in zip(positions, axes, strict=True)),
    )
    rows = written(rows, "rows")
    groups = rows.groupBy("g").agg(F.sum("size").alias("w"), F.count("*").alias("n"), *(F.min(a).alias(a) for a in axes))
    groups = written(groups, "groups")
    total = groups.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    target = total["w"] / shards
    # fewer than HEAVY * shards rows, because each weighs more than a HEAVY-th of a shard
    heavy = [tuple(r) for r in groups.where(F.col("w") > target / HEAVY).select("g", "w", "n").collect()]
    places, load = _deal(heavy, shards, target)
    light = groups.where(F.col("w") <= target / HEAVY)

    free = [max(target - x, 0.0) for x in load]
    node, spans = F.lit(0), {0: (0, shards)}
    while any(b - a > 1 for a, b in spans.values()):
        stats = light.groupBy(node.alias("node")).agg(F.sum("w").alias("w"), *(f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max)))
        wanted, halves, new = {}, {}, {}
        for r in stats.collect():  # at most one row a shard
            a, b = spans[r["node"]]
            if b - a > 1:
                axis = max(axes, key=lambda x: r[f"max_{x}"] - r[f"min_{x}"])
                share = sum(free[a : (a + b) // 2]) / (sum(free[a:b]) or 1.0)
                wanted[r["node"]] = (axis, r[f"min_{axis}"], r[f"max_{axis}"], share * r["w"])
        cuts = _cuts(light, node, wanted, target * TOLERANCE)
        step = F.lit(None).cast("int")
        for k, (n, (a, b)) in enumerate(sorted(spans.items())):
            halves[n] = (2 * k, 2 * k + 1)
            if n in cuts:
                middle = (a + b) // 2
                new[2 * k], new[2 * k + 1] = (a, middle), (middle, b)
                side = F.when(F.col(wanted[n][0]) <= cuts[n], 2 * k).otherwise(2 * k + 1)
            else:  # a leaf, or nothing in it
                new[2 * k], side = (a, a + 1), F.lit(2 * k)
            step = F.when(node == n, side).otherwise(step)
        light = written(light.withColumn("_node", step), "level")
        node, spans = F.col("_node"), new
    of_node = F.coalesce(*(F.when(node == n, F.lit(a)) for n, (a, _) in spans.items()))
    placed = rows.select("doc_id", "size", "text_crc32", "g")
    out = placed.join(light.select("g", of_node.alias("shard")), "g").select("doc_id", "size", "text_crc32", "shard")
    whole = [(g, s) for g, first, end, s in places if first == 0 and end == next(n for k, _, n in heavy if k == g)]
    parts = [p for p in places if (p[0], p[3]) not in set(whole)]
    if whole:
        own = placed.join(F.broadcast(_values(spark, whole, "g, shard")), "g")
        out = out.unionByName(own.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard")))
    if parts:
        table = F.broadcast(_values(spark, parts, "g, first, end, shard"))
        cut = written(placed.join(F.broadcast(_values(spark, sorted({(p[0],) for p in parts}), "g")), "g"), "cut")
        cut = numbered(cut, ["g"], ["doc_id", "text_crc32"], "place", cut.count())
        own = cut.join(table, "g").where("place >= first and place < end")
        out = out.unionByName(own.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard")))
    out = written(out, "placed")
    out = numbered(out, ["shard"], ["doc_id", "text_crc32"], "slot", total["n"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
