"""Operator 3: quality classifier by hierarchical empirical Bayes.

A document classifier (logistic regression on hashed words, word beginnings and a few measures
of form) gives each document's evidence for two targets: good quality and toxicity.  Its
evidence is calibrated on labelled documents it was not fitted on.  Soft labels are summed by
host and by path of a host; a host's rate is shrunk towards the global one and a path's towards
its host's, with strengths estimated from the spread between groups beyond chance (method of
moments), so sparse sites follow their parents.  A document's posterior joins its evidence with
the rate of its path, from which its own share is taken out first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .words import released

#: Labelled documents that the classifier is fitted on at most (expected number of a hashed choice).
MAX_LABELLED = 16_000
BITS = 18
#: A feature is used for a target if it has so many documents, its association is no chance
#: (squared standard errors) and no trifle (squared correlation).
LEAST_DOCUMENTS = 5
LEAST_CHI2 = 20.0
LEAST_EFFECT = 0.01
EPOCHS = 20
BATCH = 64
RATE = 0.2
DECAY = 1e-5
#: Groups (a few dozen bytes each) that are broadcast at most; beyond, a shuffled join.
MAX_BROADCAST = 200_000
CACHED_WORDS = 100_000

TARGETS = ("quality", "toxic")
_MASK = (1 << BITS) - 1
_WORD = re.compile(r"\w+")
_SYMBOLS = re.compile(r"[#*$%&|<>!]")


def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) & _MASK


class WordFeatures(dict):
    """Word -> its features: the word and its beginnings of four to six letters."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = (_hash("w" + word), *(_hash(f"{n}{word[:n]}") for n in (4, 5, 6) if len(word) >= n))
        if len(word) <= 64:
            self[word] = out
        return out


def _step(share: float) -> int:
    return int(min(share, 1.0) * 10)


def _form(text: str, words: list[str]) -> tuple[int, ...]:
    """Measures of form, in steps."""
    n = max(1, len(words))
    parts = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    marks = len(_SYMBOLS.findall(text)) / max(1, len(parts))
    upper = sum(x.isupper() for x in parts) / max(1, len(parts))
    repeats = 1 - len(set(lines)) / max(1, len(lines))
    variety = len(set(words)) / n
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    names = [f"marks{_step(marks / 2)}", f"upper{_step(upper)}", f"repeats{_step(repeats)}"]
    names += [f"variety{_step(variety)}", f"length{n.bit_length()}", f"runs{_step(runs * 2)}"]
    names += [f"bare{sum(len(x) == 1 and not x.isalnum() for x in parts) * 10 // max(1, len(parts))}"]
    return tuple(_hash("f" + x) for x in names)


def features(text: str, known: WordFeatures) -> np.ndarray:
    words = _WORD.findall(text.lower())
    out = list(_form(text, words))
    for word in set(words):
        out += known[word]
    return np.array(out, np.int32)


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents, of good quality, toxic); feature -1 counts the documents."""
    known, counts = WordFeatures(), np.zeros((1 + (1 << BITS), 3), np.int64)
    for batch in batches:
        labels = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        for (quality, toxic), text in zip(labels, batch.column(2), strict=True):
            found = np.append(np.unique(features(text.as_py() or "", known)), -1)
            counts[found] += (1, quality, toxic)
    some = np.flatnonzero(counts[:, 0])
    columns = [np.where(some == 1 << BITS, -1, some), *counts[some].T]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "n", *TARGETS])


def _extract(used: np.ndarray):
    """The features of every document that are used for any target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()
        for batch in batches:
            lists = [f[used[f]] for f in (features(x.as_py() or "", known) for x in batch.column(2))]
            limits = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            values = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(limits), values)], names=["quality", "toxic", "features"]
            )

    return run


def _telling(n: np.ndarray, hits: np.ndarray, total: int, positive: int) -> np.ndarray:
    """Which features are associated with a target beyond chance."""
    rate = positive / max(total, 1)
    chi2 = (hits - n * rate) ** 2 / np.maximum(n * rate * (1 - rate) * (1 - n / max(total, 1)), 1e-9)
    return (n >= LEAST_DOCUMENTS) & (chi2 >= max(LEAST_CHI2, LEAST_EFFECT * total))


def _fit(at: np.ndarray, limits: np.ndarray, y: np.ndarray, telling: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on the telling features by adaptive mini-batch steps."""
    rng = np.random.default_rng(0)
    used = np.flatnonzero(telling)
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    doc, at = np.repeat(np.arange(len(y)), np.diff(limits)), place[at]
    doc, at = doc[at >= 0], at[at >= 0]
    limits = np.searchsorted(doc, np.arange(len(y) + 1))
    weights, size = np.zeros(len(used)), np.full(len(used), 1e-8)
    bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            docs = order[lo : lo + BATCH]
            own = np.concatenate([at[limits[d] : limits[d + 1]] for d in docs])
            row = np.repeat(np.arange(len(docs)), limits[docs + 1] - limits[docs])
            score = np.bincount(row, weights[own], len(docs)) + bias
            slope = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[docs]) / len(docs)
            step = np.bincount(own, slope[row], len(used)) + DECAY * weights
            size += step**2
            weights -= RATE * step / np.sqrt(size)
            bias -= float(slope.sum())
    out = np.zeros(1 << BITS)
    out[used] = weights
    return out, bias


def _calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic map from score to label, by a few Newton steps."""
    a, b = 1.0, 0.0
    x = np.stack((score, np.ones(len(score))), axis=1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ (a, b), -30, 30)))
        w = p * (1 - p) + 1e-6
        grad = x.T @ (p - y) + 0.01 * np.array((a - 1, b))
        step = np.linalg.solve(x.T @ (x * w[:, None]) + 0.01 * np.eye(2), grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -3, 3)
    return float(max(a, 1e-3)), float(b)


class Classifier:
    """For each target: weights, and the map of a document's score to calibrated log-odds."""

    def __init__(self, rows: pa.Table, telling: dict[str, np.ndarray]):
        lists = rows["features"].combine_chunks()
        limits = lists.offsets.to_numpy().astype(np.int64)
        at = lists.values.to_numpy()
        self.weights, self.maps, self.rates = [], [], []
        fitted = np.arange(len(rows)) % 4 > 0
        for name in TARGETS:
            y = rows[name].to_numpy().astype(float)
            train, test = np.flatnonzero(fitted), np.flatnonzero(~fitted)
            if len(y) < 8 or y.min() == y.max():
                # nothing to tell apart: the evidence is nil
                self.weights.append(np.zeros(1 << BITS, np.float32))
                self.maps.append((0.0, 0.0))
                self.rates.append(float(y.mean()) if len(y) else float(name == "quality"))
                continue
            own = np.concatenate([at[limits[d] : limits[d + 1]] for d in train])
            ends = np.concatenate(([0], np.cumsum(limits[train + 1] - limits[train])))
            weights, bias = _fit(own, ends, y[train], telling[name])
            sums = np.concatenate(([0.0], np.cumsum(weights[at])))
            score = sums[limits[1:]] - sums[limits[:-1]] + bias
            a, b = _calibrate(score[test], y[test])
            self.weights.append(weights.astype(np.float32))
            self.maps.append((a, a * bias + b))
            self.rates.append(float(np.clip(y.mean(), 1e-3, 1 - 1e-3)))

    def log_odds(self, found: np.ndarray) -> list[float]:
        return [float(np.clip(a * w[found].sum(dtype=float) + b, -30, 30)) for w, (a, b) in zip(self.weights, self.maps, strict=True)]


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int = MAX_LABELLED) -> Classifier:
    """Fit on a bounded, hashed choice of the labelled documents.

    Features are counted over the cluster; of the chosen documents, only the telling ones
    reach the driver.
    """
    labels = labels.where("quality is not null and toxic is not null").select(
        F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")
    )
    total = labels.count()
    if total > most:
        labels = labels.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(1_000_000 * most / total))
    chosen = labels.dropDuplicates(["label_id"])
    rows = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "label_id")
    rows = written(rows.select("quality", "toxic", "text"), "labelled")
    counted = rows.mapInArrow(released(_feature_counts), "feature bigint, n bigint, quality bigint, toxic bigint").groupBy("feature")
    # at most one row a hashed feature
    counted = counted.agg(*(F.sum(c).alias(c) for c in ("n", *TARGETS))).where(
        (F.col("n") >= LEAST_DOCUMENTS) | (F.col("feature") == -1)
    ).toArrow()
    place = counted["feature"].to_numpy()
    dense = {c: np.zeros(1 + (1 << BITS), np.int64) for c in ("n", *TARGETS)}
    for c, values in dense.items():
        values[place] = counted[c].to_numpy()
    total = int(dense["n"][-1])
    telling = {t: _telling(dense["n"][:-1], dense[t][:-1], total, int(dense[t][-1])) for t in TARGETS}
    used = telling["quality"] | telling["toxic"]
    schema = "quality int, toxic int, features array<int>"
    return Classifier(rows.mapInArrow(released(_extract(used)), schema).toArrow(), telling)


def _evidence(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, WordFeatures()
        for batch in batches:
            odds = [model.log_odds(features(x.as_py() or "", known)) for x in batch.column(3)]
            columns = [pa.array([o[k] for o in odds], pa.float64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["doc_id", "host", "path", "quality", "toxic"])

    return run


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, name: str, parent: Column) -> float:
    """How many documents a parent's rate is worth: p(1-p) / variance between groups, less one.

    Only groups of two documents or more tell; the sampling variance is taken out.
    """
    p = F.greatest(F.least(parent, F.lit(0.999)), F.lit(0.001))
    chance = p * (1 - p)
    row = (
        groups.where("n > 1")
        .agg(
            F.sum(F.col("n") * (F.pow(F.col(name) / F.col("n") - p, F.lit(2)) - chance / F.col("n"))).alias("extra"),
            F.sum(F.col("n") * chance).alias("chance"),
        )
        .first()
    )
    if not row["chance"] or row["extra"] is None or row["extra"] <= 0:
        return 1000.0
    return float(min(max(row["chance"] / row["extra"] - 1, 1.0), 1000.0))


def quality_posteriors(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    *,
    max_labelled: int = MAX_LABELLED,
    threshold: float = 0.5,
    key_col: str | None = None,
) -> DataFrame:
    """doc_id, p_quality, p_toxic, the rates they start from, and kept, of every row.

    ``labels`` has doc_id, quality and toxic (0 or 1); rows with a null are ignored, of repeated
    ids one counts.  Null text counts as empty, null hosts as one host, null paths as one path of
    their host; a null id is judged like any.  Repeated rows are judged one by one.  Without
    labels of both kinds there is no evidence on a target, and nothing is rejected by it.
    With ``key_col``, a whole number of every row, doc_id in the result is that number.
    Other columns are ignored, whatever their names.  Empty input: empty result.
    """
    spark = docs.sparkSession
    keys = F.col(key_col or id_col).cast("long").alias("key")
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
        F.col(text_col).cast("string").alias("text"),
        keys,
    )
    model = train(docs, labels, "doc_id", "text", max_labelled)
    docs = docs.select(F.col("key").alias("doc_id"), "host", "path", "text")
    shared = spark.sparkContext.broadcast(model)
    schema = "doc_id bigint, host string, path string, quality double, toxic double"
    rows = written(docs.mapInArrow(released(_evidence(shared)), schema), "evidence")

    soft = [F.sum(_sigmoid(F.col(t))).alias(t) for t in TARGETS]
    paths = written(rows.groupBy("host", "path").agg(F.count("*").alias("n"), *soft), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(t).alias(t) for t in TARGETS))
    total = hosts.agg(F.sum("n").alias("n"), *(F.sum(t).alias(t) for t in TARGETS)).first()
    overall = {t: (total[t] / total["n"]) if total["n"] else 0.5 for t in TARGETS}
    for t in TARGETS:
        strength = _strength(hosts, t, F.lit(overall[t]))
        hosts = hosts.withColumn(f"host_{t}", (F.col(t) + strength * overall[t]) / (F.col("n") + strength))
    paths = paths.join(hosts.select("host", *(f"host_{t}" for t in TARGETS)), "host")
    strengths = {t: _strength(paths, t, F.col(f"host_{t}")) for t in TARGETS}
    sums = paths.select("host", "path", F.col("n"), *(F.col(t).alias(f"sum_{t}") for t in TARGETS), *(f"host_{t}" for t in TARGETS))
    sums = F.broadcast(sums) if paths.count() <= MAX_BROADCAST else sums.hint("merge")
    out = rows.join(sums, ["host", "path"])
    for k, t in enumerate(TARGETS):
        strength, rate = strengths[t], model.rates[k]
        others = F.col(f"sum_{t}") - _sigmoid(F.col(t)) + strength * F.col(f"host_{t}")
        start = F.greatest(F.least(others / (F.col("n") - 1 + strength), F.lit(0.999)), F.lit(0.001))
        evidence = F.col(t) - float(np.log(rate / (1 - rate))) if model.maps[k] != (0.0, 0.0) else F.lit(0.0)
        sure = F.lit(1.0 if t == "quality" else 0.0)
        posterior = _sigmoid(evidence + _logit(start)) if model.maps[k] != (0.0, 0.0) else sure
        out = out.withColumn(f"path_{t}", start).withColumn(f"p_{t}", posterior)
    return out.select(
        "doc_id",
        *(f"p_{t}" for t in TARGETS),
        *(f"host_{t}" for t in TARGETS),
        *(f"path_{t}" for t in TARGETS),
        ((F.col("p_quality") >= threshold) & (F.col("p_toxic") < threshold)).alias("kept"),
    )
