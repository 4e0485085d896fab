"""Operator 11: exact top-k by inner product with Fagin's threshold algorithm.

Vectors are turned into integers and dealt into blocks of about ``BLOCK`` rows.  A task reads one
block, sorts its rows once along every dimension, and then reads the queries one after another.
For a query, the list of a dimension is walked from its largest values if the query is positive
there and from its smallest if negative; a list where the query is zero adds nothing.  All lists
are walked to the same depth, every row met is scored in full, and the walk ends when the sum of
the values standing at that depth, times the query, is below the kth best score: no row that has
not been met can beat or tie it.  The k best of every block meet in one ranking a query.

The lists are as exact as the scores (integers), so results do not depend on the blocks.  Vectors
of which no single dimension tells much make the walk long; it never reads a list past its end,
so a query costs at most one scoring of each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a block, on average.
BLOCK = 8192
#: Depth of the first look at the threshold; it doubles from look to look.
FIRST_DEPTH = 16

_LONG = 2**63
_BEST = "key bigint, query_id bigint, vec_id bigint, score bigint"


class Lists:
    """The rows of one block and their order along every dimension."""

    def __init__(self, ids: list[int | None], vectors: list[list[int]]):
        width = max(map(len, vectors), default=0)
        filled = [v + [0] * (width - len(v)) for v in vectors]
        most = max((abs(x) for v in filled for x in (min(v), max(v))), default=0) if width else 0
        self.wide = most >= 1 << 23  # products and sums might not fit into 64 bits: Python's integers
        self.rows = np.array(filled, object if self.wide else np.int64).reshape(len(vectors), width)
        self.missing = np.array([i is None for i in ids], bool)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.order = np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32, order="C")

    def best(self, query: list[int], own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``k`` best rows of other ids than ``own``, ties to the smaller id, null ids last."""
        n, width = self.rows.shape
        query = (query + [0] * width)[:width]
        wide = self.wide or max(map(abs, query), default=0) >= 1 << 23
        q = np.array(query, object if wide else np.int64)
        rows = self.rows.astype(object) if wide and not self.wide else self.rows
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        met = np.zeros(n, bool)
        found, scores = np.zeros(0, np.int64), q[:0]
        low, high = 0, min(FIRST_DEPTH, n)
        if not len(up) + len(down):
            low = high = n  # no list at all: every score is 0
        while True:
            fresh = np.zeros(n, bool)
            if high == n:
                fresh[:] = True
            else:
                fresh[self.order[up, n - high : n - low]] = True
                fresh[self.order[down, low:high]] = True
            fresh &= ~met
            met |= fresh
            new = np.flatnonzero(fresh)
            new = new[(self.ids[new] != own) | self.missing[new]]
            found = np.concatenate([found, new])
            own_scores = rows[new] @ q if len(q) else np.zeros(len(new), np.int64)
            scores = np.concatenate([scores, np.clip(own_scores, -_LONG, _LONG - 1) if wide else own_scores])
            if len(found) > k:
                if len(found) > 4 * k:  # all ties with the kth are kept for the exact order
                    cut = np.partition(scores, len(scores) - k)[len(scores) - k] if not wide else sorted(scores)[-k]
                    kept = np.flatnonzero(scores >= cut)
                    found, scores = found[kept], scores[kept]
                first = np.lexsort((self.ids[found], self.missing[found], -scores))[:k]
                found, scores = found[first], scores[first]
            if high == n:
                return found, scores
            bound = (q[up] * rows[self.order[up, n - high], up]).sum() + (q[down] * rows[self.order[down, high - 1], down]).sum()
            if len(found) >= k and bound < scores.min():
                return found, scores
            low, high = high, min(2 * high, n)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors, lists = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            c = [batch.column(x) for x in range(5)]
            kinds, own = c[1].to_pylist(), c[0].to_pylist()
            keys, names, values = c[2].to_pylist(), c[3].to_pylist(), c[4].to_pylist()
            for at, kind in enumerate(kinds):
                if own[at] != block:
                    block, ids, vectors, lists = own[at], [], [], None
                if kind == 0:  # the block's rows come before its queries
                    ids.append(names[at])
                    vectors.append(values[at])
                    continue
                if lists is None:
                    lists = Lists(ids, vectors)
                    vectors = []
                rows, scores = lists.best(values[at], names[at], k)
                for r, s in zip(rows.tolist(), scores.tolist(), strict=True):
                    out.append((keys[at], names[at], ids[r], s))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in columns], names=["key", "query_id", "vec_id", "score"]
            )

    return run


def integers(vector: Column, scale: int = 256) -> Column:
    """Every component times ``scale``, rounded down; null for a null vector and for one that holds
    a null or a value that is not finite."""
    real = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(usable, F.transform(real, lambda x: F.floor(F.lit(float(scale)) * x).cast("long")))


def exact_top_k(
    vectors: DataFrame,
    asked: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    scale: int = 256,
    block: int = BLOCK,
) -> DataFrame:
    """The ``k`` best rows for every row where ``asked`` holds: query_id, rank, vec_id, score.

    ``score`` is the inner product of the integer vectors; a component that one of the two lacks
    counts as 0.  Ties go to the smaller id, null ids last.  A query never finds rows of its own
    id.  Rows that repeat an id are queries and candidates one by one; a null id is a candidate
    and no query.  Vectors that ``integers`` makes null take no part.  Components and scores
    beyond 64 bits saturate before they are ranked.  Other columns are ignored, whatever their names.  Empty input:
    empty result.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(asked & F.col(id_col).isNotNull(), F.lit(False)).alias("asked"),
        integers(F.col(vector_col), scale).alias("vector"),
    ).where(F.col("vector").isNotNull())
    rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "vectors")
    blocks = max(1, -(-rows.count() // block))
    # whatever the ids and vectors are, a block gets its share of rows
    own = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    inside = rows.select(own.alias("block"), F.lit(0).alias("kind"), "key", "id", "vector")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = rows.where("asked").select(every.alias("block"), F.lit(1).alias("kind"), "key", "id", "vector")
    met = inside.unionByName(queries).repartition("block").sortWithinPartitions("block", "kind", "key")
    best = met.mapInArrow(_search(k), _BEST)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
