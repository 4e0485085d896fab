"""Operator 1: near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: ``DEPTH * BANDS * ROWS`` coordinates.  In round i every shingle is thrown into one
hashed bin with value (i, hash); a bin keeps its least value.  Rounds go on until no
bin is empty; after as many rounds as bins, round i fills bin i - t from all
shingles, so at most 2t rounds are needed and every coordinate fills.  Two sets agree
in a coordinate with probability equal to their Jaccard similarity, with Chernoff-type
concentration, at a cost of O(t log t + set size) instead of t * set size.

Banding: sets that agree on all ROWS coordinates of a band share a bucket.  At the
threshold of 0.75 a pair misses every one of 60 bands of 6 with probability 8e-6,
and more similar pairs far less.

Equal sets are one node from the start, so exact copies never meet pairwise.  Only
connectivity is asked for, so links are looked for in rounds: in every bucket the members
outside the largest component meet one hub of that component, first the member that shares
most buckets overall, later a hashed choice.  Each round is linear in the bucket sizes and a
group of near-copies melts into one component within a few.  At last the members of one bucket
that are still in different components meet each other.  That is complete for banding, since
members of one component need no further link.

Before texts are read, a pair must agree in enough sketch coordinates, compared by their lowest
``PLANES`` bits: a pair at the threshold is dropped with probability 1e-5, about that of missing
all bands.  All others are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import within, without, written
from .components import components
from .words import U, Texts, constants, mix, released, texts

SHINGLE = 5
PERCENT = 75
ROWS = 6
BANDS = 60
#: Sketches have so many times the coordinates that the bands use; all of them sift pairs.
DEPTH = 2
#: Hub rounds at most; what they leave is met pairwise in the last one.
ROUNDS = 2
#: Bits of a coordinate that are compared before texts are read.
PLANES = 2
#: Standard deviations below the expected agreement at which a pair is dropped.
SIGMAS = 4.2
#: Pairs of one hub that one task verifies at most; a hub with more is replicated.
PAIRS_PER_SALT = 4096

_EMPTY = U(0xFFFFFFFFFFFFFFFF)
_SIGNATURE = "doc_id bigint, n bigint, h1 bigint, h2 bigint, bits array<bigint>, bands array<bigint>"


def sketch(shingles: np.ndarray, counts: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch, a row of ``t`` values for each non-empty set."""
    sets = len(counts)
    out = np.full(sets * t, _EMPTY, U)
    home = np.repeat(np.arange(sets, dtype=np.int64) * t, counts)
    rounds = constants(2 * t, 11)
    for i in range(2 * t):
        x = mix(shingles ^ rounds[i])
        at = ((x >> U(32)) * U(t) >> U(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, home + at, (U(i) << U(32)) | (x & U(0xFFFFFFFF)))
        open_sets = (out.reshape(sets, t) == _EMPTY).any(1)
        if not open_sets.any():
            break
        if i < 4 or i % 8 == 0:
            live = open_sets[home // t]
            shingles, home = shingles[live], home[live]
    return out.reshape(sets, t)


def _digests(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set; 0 for the empty one."""
    out = []
    limits = np.concatenate(([0], np.cumsum(counts)))
    for seed in (0x51ED27, 0xC0FFEE):
        sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(shingles ^ U(seed)), dtype=U)))
        out.append((mix(sums[limits[1:]] - sums[limits[:-1]]) * (counts > 0).astype(U)).view(np.int64))
    return out[0], out[1]


def _signatures(shingle: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixers = constants(rows, 13) | U(1)
        marks = constants(bands, 17)
        for batch in batches:
            for lo, hi, part in texts(batch.column(1)):
                found, counts = part.shingles(shingle)
                h1, h2 = _digests(found, counts)
                full = np.flatnonzero(counts)
                lists = bits = np.zeros(0, np.int64)
                if len(full):
                    cells = sketch(found, counts[full], DEPTH * rows * bands).reshape(len(full), DEPTH * rows, bands)
                    planes = (cells[:, :, None, :] >> np.arange(PLANES, dtype=U)[:, None]) & U(1)
                    bits = (planes << np.arange(bands, dtype=U)).sum(axis=3, dtype=U).view(np.int64).ravel()
                    keys = (cells[:, :rows] * mixers[:, None]).sum(axis=1, dtype=U)
                    lists = mix(keys ^ marks).view(np.int64).ravel()
                some = np.concatenate(([0], np.cumsum(counts > 0)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(counts),
                        pa.array(h1),
                        pa.array(h2),
                        pa.ListArray.from_arrays(pa.array((some * DEPTH * rows * PLANES).astype(np.int32)), pa.array(bits)),
                        pa.ListArray.from_arrays(pa.array((some * bands).astype(np.int32)), pa.array(lists)),
                    ],
                    names=["doc_id", "n", "h1", "h2", "bits", "bands"],
                )

    return run


def _verify(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            left, right = batch.column(2), batch.column(3)
            for lo, hi, part in texts(left):
                x, nx = part.shingles(shingle)
                y, ny = _all(right.slice(lo, hi - lo), shingle)
                pair = np.concatenate((np.repeat(np.arange(hi - lo), nx), np.repeat(np.arange(hi - lo), ny)))
                h = np.concatenate((x, y))
                order = np.lexsort((h, pair))
                pair, h = pair[order], h[order]
                same = (pair[1:] == pair[:-1]) & (h[1:] == h[:-1])
                both = np.bincount(pair[1:][same], minlength=hi - lo)
                linked = 100 * both >= percent * (nx + ny - both)
                yield pa.RecordBatch.from_arrays([pa.array(a[lo:hi][linked]), pa.array(b[lo:hi][linked])], names=["a", "b"])

    return run


def _all(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [part.shingles(shingle) for _, _, part in texts(column)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; a is the side that may repeat often."""
    # only texts of some pair move
    docs = within(docs, pairs.select("a").union(pairs.select("b")))
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PAIRS_PER_SALT)).cast("int").alias("salts"))
    hubs = hubs.join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    hubs = hubs.withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)")))
    sides = pairs.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    sides = sides.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PAIRS_PER_SALT)).cast("int").alias("salts")), "a")
    sides = sides.withColumn("salt", F.pmod(F.hash("b"), F.col("salts"))).drop("salts")
    both = sides.join(hubs, ["a", "salt"]).select("a", "b", "ta", "tb")
    return both.mapInArrow(released(_verify(shingle, percent)), "a bigint, b bigint").distinct()


def _may_link(percent: int, rows: int, bands: int):
    """The condition on two nodes that their sizes and low bits allow the similarity."""
    chance = 0.5**PLANES
    agree = percent / 100 * (1 - chance) + chance

    def most(groups: int) -> int:
        t = groups * bands
        return int(t * (1 - agree) + SIGMAS * (t * agree * (1 - agree)) ** 0.5)

    def near(x: str, y: str):
        def differ(low: int, high: int):
            total = F.lit(0)
            for k in range(low * PLANES, high * PLANES, PLANES):
                any_bit = F.lit(0).cast("long")
                for p in range(k, k + PLANES):
                    any_bit = any_bit.bitwiseOR(F.col(f"{x}.bits")[p].bitwiseXOR(F.col(f"{y}.bits")[p]))
                total = total + F.bit_count(any_bit)
            return total

        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        fits = 100 * F.least(n, m) >= percent * F.greatest(n, m)
        groups = DEPTH * rows
        # the first half alone rules most pairs out
        return fits & (differ(0, groups // 2) <= most(groups // 2)) & (differ(0, groups) <= most(groups))

    return near


def _hub_pairs(placed: DataFrame, turn: int) -> DataFrame:
    """(a, b): in every bucket, a hub of its largest component and each member of another one."""
    priority = F.col("popularity") if turn == 0 else F.xxhash64("node", F.lit(turn))
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("size"), F.max(F.struct(priority.alias("p"), F.col("node").alias("a"))).alias("pick"))
    hubs = parts.groupBy("bucket").agg(F.max(F.struct("size", "pick", "component")).alias("top"))
    hubs = hubs.select("bucket", F.col("top.component").alias("c"), F.col("top.pick.a").alias("a"))
    return placed.join(hubs, "bucket").where("component <> c").select("a", F.col("node").alias("b")).distinct()


def _sifted(pairs: DataFrame, nodes: DataFrame, near) -> DataFrame:
    """The pairs whose sketches allow a link."""
    nodes = nodes.select("node", "n", "bits")
    met = pairs.join(nodes.alias("x"), F.col("a") == F.col("x.node")).join(nodes.alias("y"), F.col("b") == F.col("y.node"))
    return met.where(near("x", "y")).select("a", "b")


def _still_mixed(placed: DataFrame, label: DataFrame) -> DataFrame:
    """Members with their components, of the buckets that hold more than one."""
    now = placed.drop("component").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = now.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1")
    return written(now.join(mixed.select("bucket"), "bucket"), "mixed")


def _cross_pairs(placed: DataFrame, nodes: DataFrame, near) -> DataFrame:
    """(a, b): members of one bucket in different components whose sketches allow a link.

    Every bucket that such two members share holds two components, so all of them are in ``placed``:
    a pair meets in the least of them, and there only.  Of the sketches only the members' move, and
    their bands stay behind.
    """
    own = placed.groupBy("node").agg(F.first("component").alias("component"), F.collect_set("bucket").alias("buckets"))
    own = within(nodes.select("node", "n", "bits"), placed.select("node"), "node").join(own, "node")
    own = written(own, "cross_nodes").withColumn("bucket", F.explode("buckets"))
    left, right = own.alias("l"), own.alias("r")
    meet = F.expr("l.bucket = r.bucket and l.node < r.node and l.component <> r.component") & near("l", "r")
    meet = meet & F.expr("array_min(array_intersect(l.buckets, r.buckets)) = l.bucket")
    return left.join(right, meet).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    rows: int = ROWS,
    bands: int = BANDS,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Null or wordless text: no shingles, linked with nothing, kept.  A null id: the row
    is returned unlinked, component_id null, kept.  Repeated rows: one group, as any
    copies; rows that repeat an id are judged by their own text.  Other columns of
    ``docs`` are ignored, whatever their names.  Empty input: empty result.
    """
    if not 0 < bands <= 64:
        raise ValueError("bands must be 1 to 64")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signatures = written(docs.mapInArrow(released(_signatures(shingle, rows, bands)), _SIGNATURE), "signatures")
    full = signatures.where("n > 0 and doc_id is not null")
    sets = written(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "sets")
    copies = full.select("h1", "h2", "doc_id").join(sets.where("copies > 1"), ["h1", "h2"]).where("doc_id <> node")
    # an id that is no copy keeps all its rows, so later joins by node read the signatures themselves
    nodes = full.withColumnRenamed("doc_id", "node")

    members = without(nodes.select("node", "bands"), copies.select("doc_id"), "node")
    members = members.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = written(members.join(shared, "bucket"), "members")
    popularity = members.groupBy("node").agg(F.sum("size").alias("popularity"))
    placed = written(members.drop("size").join(popularity, "node").withColumn("component", F.col("node")), "placed")

    near = _may_link(percent, rows, bands)
    tested = links = None
    for turn in range(ROUNDS):
        pairs = _hub_pairs(placed, turn)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "hub_pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = written(_confirmed(written(_sifted(pairs, nodes, near), "sifted"), docs, shingle, percent), "hub_links")
        links = found if links is None else links.union(found)
        placed = _still_mixed(placed, components(links))
        if placed.isEmpty():
            break
    cross = _cross_pairs(placed.select("bucket", "node", "component"), nodes, near)
    tested = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = written(cross.distinct().join(tested, ["a", "b"], "left_anti"), "cross_pairs")
    label = components(links.union(_confirmed(cross, docs, shingle, percent)))
    sets = sets.join(label, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))
    out = signatures.select("doc_id", "n", "h1", "h2").join(sets, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
