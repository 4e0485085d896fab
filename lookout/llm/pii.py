"""Operator 10: personal data by a skip-chain conditional random field.

Base patterns find e-mail addresses, IP addresses, card and phone numbers.  The field adds what
they miss: parts or other spellings of such data.  Its nodes are a document's tokens that hold a
digit or an at sign, and those without that equal the local part of an address found anywhere in
the document.  Neighbouring tokens are linked in a chain; tokens that repeat, wherever they are,
or are similar (equal digits, equal last ten digits, equal local part) are linked by skip edges:
each to the occurrence before it and to the first observed one, so the edges stay linear and
evidence reaches every occurrence.  Tokens inside base spans are observed; loopy sum-product
message passing, until the messages settle, gives the others their labels.

Training is maximum likelihood by counting over all documents, with the base spans as labels:
label by token shape, label by label of neighbours, and agreement over skip edges of consecutive
occurrences.  Local parts without digits have no label there and are not counted.  Shapes are
hashed into ``SHAPES`` classes, so the model has a fixed size.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import released, runs

SHAPES = 4096
#: Messages that change by less have settled.
SETTLED = 1e-3
DAMPING = 0.5
SMOOTHING = 0.5
#: Pairs that agree, one against one, before any is counted: the belief in consistency.
SKIP_PRIOR = 50
#: Bound of a skip edge's log-odds for agreement.
MAX_SKIP = 8.0
#: What makes two tokens similar, the strongest first.
SIMILAR = ("same", "digits", "last", "local")

KINDS = ("email", "ip", "card", "phone")
_LABELS = len(KINDS) + 1  # 0: none

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+")
_DIGITS = re.compile(r"[^0-9]")
_TAIL = ".,;:!?\"'"
_AROUND = _TAIL + "()[]<>"

Span = tuple[int, int, int]  # start, end, kind number


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """The leftmost match before each at sign: the whole run of local characters in front of it.

    Same matches as a search for the full pattern, without rescanning long runs.
    """
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL_END.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            done = domain.end()
            yield start, done, 0
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass the kind's check."""
    out = list(_emails(text))
    if not _MARK.search(text):
        return out
    out += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() <= 37 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), 2))
    if "+" in text:
        out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _tokens(text: str) -> list[tuple[int, int]]:
    """Words that hold a digit or an at sign."""
    flat = text
    for c in "\t\n\x0b\x0c\r":
        flat = flat.replace(c, " ")
    out, m = [], _MARK.search(flat)
    while m:
        start = flat.rfind(" ", 0, m.start()) + 1
        end = flat.find(" ", m.start())
        end = len(flat) if end < 0 else end
        out.append((start, end))
        m = _MARK.search(flat, end)
    return out


def shape(token: str) -> int:
    """The token's form: digit runs by length, letter runs, other characters, and checks."""
    token = token.rstrip(_TAIL)
    form = _RUN.sub(lambda m: f"9{min(m.end() - m.start(), 20)}" if m.group()[0].isdecimal() else "a", token)
    digits = _DIGITS.sub("", token)
    if 14 <= len(digits) <= 19 and not token.strip("0123456789-"):
        form += "/ok" if luhn(digits) else "/bad"
    parts = token.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        values = [p.lstrip("0") for p in parts]
        form += "/ok" if all(len(v) <= 3 and int(v or 0) <= 255 for v in values) else "/bad"
    return zlib.crc32(form.encode()) % SHAPES


def _locals(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Words without digits that equal the local part of an address in ``spans``."""
    known = {key for a, b, kind in spans if kind == 0 for what, key in _keys(text[a:b]) if what == "local" and not _MARK.search(key)}
    if not known:
        return []
    words = (m for m in _WORD.finditer(text) if not _MARK.search(m.group()))
    return [m.span() for m in words if m.group().strip(_AROUND).lower() in known]


class Graph:
    """A document's tokens, their shapes and base labels, and the edges between them.

    Without ``whole`` only what is counted: tokens with a digit or an at sign, and skip edges of
    consecutive occurrences.
    """

    def __init__(self, text: str, spans: list[Span], whole: bool = True):
        self.places = _tokens(text)
        if whole:
            self.places = sorted(self.places + _locals(text, spans))
        n = len(self.places)
        self.shapes = np.fromiter((shape(text[a:b]) for a, b in self.places), np.int64, n)
        self.base = np.zeros(n, np.int64)
        inside: dict[int, Span] = {}
        k = 0
        ordered = sorted(spans)
        for j, (a, b) in enumerate(self.places):
            while k < len(ordered) and ordered[k][1] <= a:
                k += 1
            if k < len(ordered) and ordered[k][0] < b:
                self.base[j] = ordered[k][2] + 1
                if ordered[k][2] == 0:
                    inside[j] = ordered[k]
        starts = np.fromiter((a for a, _ in self.places), np.int64, n)
        ends = np.fromiter((b for _, b in self.places), np.int64, n)
        near = np.flatnonzero(starts[1:] - ends[:-1] == 1)
        self.chain = np.stack((near, near + 1), axis=1)
        keys = [list(_keys(text[a:b])) for a, b in self.places]
        seen: dict[tuple, int] = {}
        if whole:
            for j, (a, b, _) in inside.items():
                keys[j] += [key for key in _keys(text[a:b]) if key not in keys[j]]
            for j in np.flatnonzero(self.base).tolist():
                for key in keys[j]:
                    seen.setdefault(key, j)
        last: dict[tuple, int] = {}
        skips: dict[tuple, int] = {}
        for j, own in enumerate(keys):
            for key in own:
                if last.get(key, j) != j:
                    skips.setdefault((last[key], j), SIMILAR.index(key[0]))
                last[key] = j
                i = seen.get(key, j)
                if i != j and not self.base[j]:
                    skips.setdefault((min(i, j), max(i, j)), SIMILAR.index(key[0]))
        self.skips = np.array(list(skips), np.int64).reshape(-1, 2)
        self.why = np.array(list(skips.values()), np.int64)


def _keys(token: str) -> Iterator[tuple]:
    """Tokens that share a key are similar."""
    bare = token.strip(_AROUND).lower()
    digits = _DIGITS.sub("", bare)
    if len(bare) >= 5:
        yield "same", bare
    if len(digits) >= 7:
        yield "digits", digits
        if 10 <= len(digits) <= 15:
            yield "last", digits[-10:]
    if "@" in bare[1:]:
        bare = bare[: bare.index("@", 1)]
    if len(bare) >= 5 and not bare.isdigit():
        yield "local", bare


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(what, a, b, n): 0: shape and label; 1: labels of neighbours; 2: kind of skip edge and agreement."""
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            if not text or not _MARK.search(text):
                continue
            g = Graph(text, base_spans(text), whole=False)
            counts.update(zip([0] * len(g.base), g.shapes.tolist(), g.base.tolist(), strict=True))
            counts.update((1, int(g.base[i]), int(g.base[j])) for i, j in g.chain)
            counts.update((2, int(w), int(g.base[i] == g.base[j])) for (i, j), w in zip(g.skips, g.why, strict=True) if g.base[i] or g.base[j])
    columns = list(zip(*((*k, n) for k, n in counts.items()), strict=True)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["what", "a", "b", "n"])


class Model:
    """Log potentials: by shape, between neighbours, and for agreement over a skip edge."""

    def __init__(self, counts: list[tuple[int, int, int, int]]):
        shapes = np.zeros((SHAPES, _LABELS))
        pairs = np.zeros((_LABELS, _LABELS))
        agree = np.zeros((len(SIMILAR), 2))
        for what, a, b, n in counts:
            (shapes, pairs, agree)[what][a, b] += n
        prior = (shapes.sum(axis=0) + SMOOTHING) / (shapes.sum() + SMOOTHING * _LABELS)
        prior = np.where(np.arange(_LABELS) == 0, max(prior[0], 0.5), prior)
        self.unary = np.log((shapes + SMOOTHING * prior) / (shapes.sum(axis=1, keepdims=True) + SMOOTHING))
        joint = (pairs + SMOOTHING) / (pairs + SMOOTHING).sum()
        self.chain = np.log(joint) - np.log(joint.sum(axis=1, keepdims=True)) - np.log(joint.sum(axis=0, keepdims=True))
        self.skip = np.clip(np.log((agree[:, 1] + SKIP_PRIOR) / (agree[:, 0] + 1)), 0, MAX_SKIP)

    def labels(self, g: Graph) -> np.ndarray:
        """The most likely label of every token after loopy message passing."""
        unary = self.unary[g.shapes].copy()
        seen = np.flatnonzero(g.base)
        unary[seen] = -1e9  # stays below whatever many neighbours say
        unary[seen, g.base[seen]] = 0.0
        edges = np.concatenate((g.chain, g.skips))
        if not len(edges):
            return unary.argmax(axis=1)
        potential = np.concatenate(
            (np.broadcast_to(self.chain, (len(g.chain), _LABELS, _LABELS)), np.eye(_LABELS) * self.skip[g.why][:, None, None])
        )
        # a message each way over every edge; row e + E is the way back of row e
        source = np.concatenate((edges[:, 0], edges[:, 1]))
        target = np.concatenate((edges[:, 1], edges[:, 0]))
        potential = np.concatenate((potential, potential.transpose(0, 2, 1)))
        back = np.roll(np.arange(len(source)), len(edges))
        message = np.zeros((len(source), _LABELS))
        active = np.arange(len(source))
        # only messages from nodes whose belief still moves are computed again; a path has at most
        # as many edges as there are nodes, and damping needs some steps for each
        for _ in range(64 + 8 * len(unary)):
            out = potential[active] + (unary[source[active]] - message[back[active]])[:, :, None]
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = (1 - DAMPING) * (new - message[active])
            message[active] += change
            np.add.at(unary, target[active], change)
            moved = active[np.abs(change).max(axis=1) > SETTLED]
            if not len(moved):
                break
            again = np.zeros(len(unary), bool)
            again[target[moved]] = True
            again = again[source]
            again[moved] = True
            active = np.flatnonzero(again)
        return unary.argmax(axis=1)

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans of tokens that the field labels and the base patterns missed."""
        if not _MARK.search(text):
            return []
        g = Graph(text, base)
        labels = np.where(g.base > 0, 0, self.labels(g))
        joined = set(map(tuple, g.chain))
        out, k = [], 0
        while k < len(labels):
            last = k
            while labels[k] and (last, last + 1) in joined and labels[last + 1] == labels[k]:
                last += 1
            if labels[k]:
                start, end = g.places[k][0], g.places[last][1]
                end = start + len(text[start:end].rstrip(_TAIL))
                kind, found = int(labels[k]) - 1, text[start:end]
                if len(_DIGITS.sub("", found)) >= (0, 4, 13, 7)[kind] and (kind != 1 or found.count(".") >= 3):
                    out.append((start, end, kind))
            k = last + 1
        return out


def _named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def _find(model: Model):
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = model.added(text, base)
                counts = Counter(k for _, _, k in base)
                rows.append((*(counts[k] for k in range(4)), hashlib.sha256(_named(base).encode()).hexdigest(), _named(base + more), len(more)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return run


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts over all documents; at most 5 * SHAPES + 33 rows reach the driver."""
    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(released(_count), "what bigint, a bigint, b bigint, n bigint")
    return Model([tuple(r) for r in counts.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: Model | None = None) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every row.

    Without ``model`` one is trained on ``docs``.  Null text counts as empty: no spans.  Null
    ids and repeated rows are treated like any row.  Other columns are ignored, whatever their
    names.  Empty input: empty result.
    """
    model = model or train(docs, text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    return docs.mapInArrow(released(_find(model)), schema)


def redacted(text: str, model: Model) -> str:
    """``text`` with every span replaced by its kind in brackets; spans that overlap merge."""
    base = base_spans(text)
    spans = sorted(base + model.added(text, base))
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][1])
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", *, model: Model | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; all other columns stay."""
    model = model or train(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            for part in runs(batch, k):
                new = [t if t is None else redacted(t, model) for t in (x.as_py() for x in part.column(k))]
                columns = [*part.columns[:k], pa.array(new, pa.string()), *part.columns[k + 1 :]]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(released(run), docs.schema)
