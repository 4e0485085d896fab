"""Operator 13: a Merkle manifest of a table, as append logs in postorder.

Every row is a leaf of the tree of its group, and the roots of the groups, in the groups' order,
are the leaves of one tree above.  Two consecutive nodes become their hash; a last node without
a neighbour becomes the hash of itself.

*Building.*  Leaves get gapless numbers over the cluster.  Blocks of ``2 ** LEVELS`` consecutive
nodes, aligned to their size, go to builders, each of which reads its nodes in order and writes
every inner node the moment it is complete; the roots of blocks are the nodes of the next tier.
The log of a tree is its nodes by postorder position, and that position needs no counting: a
node (level, index) of a tree over n leaves ends at leaf ``end = min((index + 1) << level, n)``
and begins at ``start = index << level``, so ``ceil(end / 2^m)`` nodes of each level m up to its
own and ``floor(start / 2^m)`` nodes of each level m above precede or equal it.

*Proofs.*  A leaf's siblings have known levels and indexes, hence known positions, and are read
from the log.  Those within a block lie in the segment of that block; those above are the same
for all of the block's leaves, so paths are made tier by tier from the top and handed down, a
row a block.  No task ever holds more than one block and its path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_OFFSETS, ROWS_PER_CHUNK, written

#: A block has 2 ** LEVELS leaves.
LEVELS = 10

_LOG = "tree string, n bigint, level int, idx bigint, position bigint, digest string"
_PATHS = "tree string, idx bigint, n bigint, path string, subroot string, root string"
_RESULT = (
    "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def positions(level: int, index: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Postorder positions, from 0, of the nodes of one level in trees over ``n`` leaves."""
    start, end = index << level, np.minimum((index + 1) << level, n)
    out = np.full(len(index), -1, np.int64)
    for m in range(int(np.max(n, initial=1)).bit_length() + 1):
        out += (end + (1 << m) - 1) >> m if m <= level else start >> m
    return out


def field(column: Column) -> Column:
    """A value of a leaf: ``-`` for null, else its length in UTF-8 bytes, a colon, the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def _height(n: Column) -> Column:
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def numbered_leaves(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``idx``, their place in their ``tree`` by ``order`` (nulls first), and its size ``n``.

    The rows are sorted over the cluster by ranges of (tree, order), so a tree may hold any share
    of them; ``leaves`` should be a written table.  Rows equal in ``order`` follow in any order.
    """
    keys = ["tree", *order]
    parts = max(1, -(-leaves.count() // ROWS_PER_CHUNK))
    rows = leaves.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # this id is the partition's number times 2^33 plus the row's place in the partition
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn(
        "_part", F.shiftright("_at", 33)
    )
    sizes = rows.groupBy("tree", "_part").agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    sizes = written(sizes, "sizes")
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "tree",
        "_part",
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_size").over(tree).alias("n"),
    )
    starts = F.broadcast(starts) if sizes.count() <= MAX_OFFSETS else starts.hint("merge")
    out = rows.join(starts, ["tree", "_part"]).withColumn("idx", F.col("_at") + F.col("_shift"))
    return out.drop("_at", "_part", "_shift")


def _builders(tier: int, levels: int):
    base, inside = levels * tier, (1 << levels) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, str] = {}  # by level, the left node whose neighbour is still to come
        for batch in batches:
            rows: list[tuple] = []
            for tree, i, n, digest in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if tier == 0:
                    rows.append((tree, n, 0, i, digest))
                if i & inside == 0:
                    waiting.clear()
                level, index, top = base, i, min(base + levels, (n - 1).bit_length())
                while level < top:
                    if index & 1:
                        digest = sha256(waiting.pop(level) + digest)
                    elif i == (n - 1) >> base:  # the last node of this level has no neighbour
                        digest = sha256(digest)
                    else:
                        waiting[level] = digest
                        break
                    level, index = level + 1, index >> 1
                    rows.append((tree, n, level, index, digest))
            tree, n, level, idx, digest = map(list, zip(*rows, strict=True)) if rows else ([],) * 5
            level, idx, n = (np.array(x, np.int64) for x in (level, idx, n))
            position = np.zeros(len(idx), np.int64)
            for k in np.unique(level).tolist():
                at = np.flatnonzero(level == k)
                position[at] = positions(k, idx[at], n[at])
            columns = [
                pa.array(tree, pa.string()),
                pa.array(n),
                pa.array(level.astype(np.int32)),
                pa.array(idx),
                pa.array(position),
                pa.array(digest, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "n", "level", "idx", "position", "digest"])

    return run


def append_log(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The logs of all trees over ``leaves`` (tree, idx, n, digest): a written table of nodes.

    tree, n (leaves of that tree), level (0: leaves), idx (from 0 within the level), position (in
    postorder, gapless from 0), digest.  Every builder writes its block's nodes by position.
    """
    most = leaves.agg(F.max("n").alias("n")).first()["n"] or 1
    nodes, log = leaves.select("tree", "idx", "n", "digest"), None
    for tier in range(max(1, -(-(most - 1).bit_length() // levels))):
        blocks = nodes.repartition("tree", F.shiftright("idx", levels)).sortWithinPartitions("tree", "idx")
        made = written(blocks.mapInArrow(_builders(tier, levels), _LOG), f"log-{tier}")
        log = made if log is None else log.unionByName(made)
        above = levels * (tier + 1)
        nodes = made.where((F.col("level") == above) & (_height(F.col("n")) > above)).select("tree", "idx", "n", "digest")
    return log


def roots(log: DataFrame) -> DataFrame:
    """(tree, n, digest): the root of every tree."""
    return log.where(F.col("level") == _height(F.col("n"))).select("tree", "n", "digest")


def _steps(base: int, top: int, idx: np.ndarray, n: int, at: np.ndarray, digests: list[str]) -> list[list[str]]:
    """For each node of a block its steps to the block's root: ``L`` or ``R`` (the side where the
    sibling stands) and the sibling's digest, or ``-`` where there is none."""
    steps: list[list[str]] = [[] for _ in idx]
    for level in range(base, min(top, (n - 1).bit_length())):
        own = idx >> (level - base)
        sibling = own ^ 1
        there = (sibling << level) < n
        found = np.searchsorted(at, positions(level, sibling, n)).tolist()
        for path, right, some, k in zip(steps, (own & 1).tolist(), there.tolist(), found, strict=True):
            path.append(("L" if right else "R") + digests[k] if some else "-")
    return steps


def _walk(tier: int, levels: int, names: list[str], finish):
    """Reads, block by block, its path from above (kind 0), its log (1) and the nodes asked for (2)."""
    base, top = levels * tier, levels * (tier + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, above, at, digests = None, None, [], []
        for batch in batches:
            c = {name: batch.column(k).to_pylist() for k, name in enumerate(names)}
            rows, asked = [], []

            def answer():
                if asked:
                    idx = np.array([c["at"][k] for k in asked], np.int64)
                    steps = _steps(base, top, idx, c["n"][asked[0]], np.array(at, np.int64), digests)
                    rows.extend(finish(c, k, [*own, *above[0]], above) for k, own in zip(asked, steps, strict=True))
                    asked.clear()

            for k, kind in enumerate(c["kind"]):
                if (c["tree"][k], c["block"][k]) != key:
                    answer()
                    key, above, at, digests = (c["tree"][k], c["block"][k]), None, [], []
                if kind == 0:
                    above = (c["digest"][k].split(",") if c["digest"][k] else [], c["subroot"][k], c["root"][k])
                elif kind == 1:
                    at.append(c["at"][k])
                    digests.append(c["digest"][k])
                else:
                    asked.append(k)
            answer()
            yield rows

    return run


def _to_paths(c: dict, k: int, steps: list[str], above: tuple) -> tuple:
    return c["tree"][k], c["at"][k], c["n"][k], ",".join(steps), above[1], above[2]


def _to_result(c: dict, k: int, steps: list[str], above: tuple) -> tuple:
    proof, folded = sha256("".join(s[1:] for s in steps)), c["tampered"][k]
    for step in steps:
        sibling = step[1:]
        folded = sha256(sibling + folded if step[0] == "L" else folded + sibling)
    return c["doc_id"][k], c["digest"][k], above[1], above[2], proof, folded, folded == above[2]


def _answers(asked: DataFrame, log: DataFrame, above: DataFrame, tier: int, levels: int, finish, schema: str) -> DataFrame:
    """``asked`` (tree, idx, n, digest, tampered, doc_id) nodes of a tier, each with its whole path."""
    base, text, long = levels * tier, F.lit(None).cast("string"), F.lit(None).cast("long")
    block = F.shiftright(F.col("idx"), levels)
    path = above.select("tree", "block", F.lit(0).alias("kind"), long.alias("at"), "n", F.col("path").alias("digest"),
                        "subroot", "root", text.alias("tampered"), long.alias("doc_id"))
    in_block = F.expr(f"shiftright(idx, CAST({base + levels} - level AS INT))")
    segment = log.where(F.col("level").between(base, base + levels) & (_height(F.col("n")) >= base))
    # a block's own root is no sibling within the block
    segment = segment.where(F.col("level") < base + levels).select(
        "tree", in_block.alias("block"), F.lit(1).alias("kind"), F.col("position").alias("at"), "n", "digest",
        text.alias("subroot"), text.alias("root"), text.alias("tampered"), long.alias("doc_id"))
    asked = asked.select("tree", block.alias("block"), F.lit(2).alias("kind"), F.col("idx").alias("at"), "n", "digest",
                         text.alias("subroot"), text.alias("root"), "tampered", "doc_id")
    both = path.unionByName(segment).unionByName(asked)
    both = both.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "at")
    walk, names = _walk(tier, levels, both.columns, finish), both.columns
    fields = [f.split(" ") for f in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in walk(batches):
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
            arrays = [pa.array(x, kinds[kind]) for x, (_, kind) in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])

    assert names[0] == "tree"
    return both.mapInArrow(run, schema)


def _proved(leaves: DataFrame, log: DataFrame, above: DataFrame, levels: int, finish, schema: str) -> DataFrame:
    """``leaves`` with their paths; ``above`` (tree, n, path, subroot, root) continues that of every tree's root."""
    most = leaves.agg(F.max("n").alias("n")).first()["n"] or 1
    top = max(1, -(-(most - 1).bit_length() // levels)) - 1
    above = above.withColumn("block", F.lit(0).cast("long")).withColumn(
        "tier", F.greatest(F.lit(0), F.ceil(_height(F.col("n")) / F.lit(levels)).cast("int") - 1)
    )
    columns, handed = ["tree", "block", "n", "path", "subroot", "root"], None
    for tier in range(top, 0, -1):
        here = above.where(F.col("tier") == tier).select(*columns)
        here = here if handed is None else here.unionByName(handed)
        nodes = log.where((F.col("level") == levels * tier) & (_height(F.col("n")) > levels * tier))
        nodes = nodes.select("*", F.lit(None).cast("string").alias("tampered"), F.lit(None).cast("long").alias("doc_id"))
        paths = written(_answers(nodes, log, here, tier, levels, _to_paths, _PATHS), f"paths-{tier}")
        handed = paths.withColumnRenamed("idx", "block").select(*columns)
    here = above.where(F.col("tier") == 0).select(*columns)
    here = here if handed is None else here.unionByName(handed)
    return _answers(leaves, log, here, 0, levels, finish, schema)


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    *,
    tampered: Column | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of ``fields``.  ``tampered`` is the leaf of the row as somebody else hands
    it over (default: as it is); ``folded_root`` is what it and the original siblings come to, and
    ``verified`` tells whether that is the root.  ``proof_sha256`` is the hash of the siblings,
    from the leaf's to the topmost.

    Null values are leaves' ``-``; a null group is a group and comes first; null ids come first in
    their group.  Equal ids are ordered by leaf, and rows equal in both, which are the same leaf,
    in any order.  Empty and very long texts are hashed like any.  Other columns are ignored,
    whatever their names.  Empty input: empty result.
    """
    own = leaf([F.col(f) for f in fields])
    rows = written(
        docs.select(
            F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0")).alias("tree"),
            F.col(id_col).cast("long").alias("doc_id"),
            own.alias("digest"),
            (own if tampered is None else F.coalesce(tampered, own)).alias("tampered"),
        ),
        "leaves",
    )
    leaves = written(numbered_leaves(rows, ["doc_id", "digest", "tampered"]), "numbered")
    log = append_log(leaves, levels)
    groups = roots(log)
    upper = groups.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest", F.col("n").alias("leaves"))
    upper = written(numbered_leaves(written(upper, "subroots"), ["group"]), "groups")
    upper_log = append_log(upper, levels)
    top = roots(upper_log).select(
        "tree", "n", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root")
    )
    asked = upper.select("tree", "idx", "n", "digest", F.lit("").alias("tampered"), F.lit(None).cast("long").alias("doc_id"))
    found = _proved(asked, upper_log, top, levels, _to_paths, _PATHS).select("idx", "path", "root")
    # a row a group on both sides
    above = upper.select("idx", "group", "leaves", F.col("digest").alias("subroot")).join(found.hint("merge"), "idx")
    above = above.select(F.col("group").alias("tree"), F.col("leaves").alias("n"), "path", "subroot", "root")
    return _proved(leaves, log, written(above, "above"), levels, _to_result, _RESULT)
