"""Operator 7: benchmark decontamination by pigeonhole edit matching.

Texts are compared with A-Z lower-cased and white space collapsed.  A test item of m characters
may differ from a passage by k = m * budget insertions, deletions and substitutions.  Cut into
k + 1 pieces, at least one piece must occur unchanged, so every exact piece hit (one automaton
finds all pieces of all items in one pass) marks a window.  Windows that share too few short
substrings with the item for any match are passed over; in the others Myers' bit-parallel
search gives the least distance of the item to any substring.

Items of fewer than ``MIN_CHARS`` characters must occur unchanged and between word limits.

Items go out in blocks of bounded size, and every block meets every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import released

BUDGET = 0.08
#: Shorter items are searched for without errors, as whole words: near them is too much by chance.
MIN_CHARS = 40
#: Characters of items in one block.
BLOCK_CHARS = 4_000_000

#: Length of the substrings that windows are sifted by.
GRAM = 4

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LEAKS = "doc_id bigint, item_id bigint, start bigint, end bigint, distance bigint"


def normalised(text: str | None) -> str:
    return b" ".join(text.encode().translate(_LOWER).split()).decode() if text else ""


class Item:
    """A test item with the bit masks of Myers' algorithm."""

    def __init__(self, item_id: int, text: str, budget: float, min_chars: int = 0):
        self.item_id, self.text, self.size = item_id, text, len(text)
        self.short = self.size < min_chars
        self.errors = 0 if self.short else int(self.size * budget)
        self.masks: dict[str, int] = {}
        for k, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << k
        self.grams = {text[k : k + GRAM] for k in range(self.size - GRAM + 1)}
        #: one edit spoils GRAM of the size - GRAM + 1 substrings at most
        self.shared = self.size - GRAM + 1 - self.errors * GRAM

    def pieces(self) -> Iterator[tuple[int, str]]:
        """k + 1 pieces of equal length, give or take one, with their offsets."""
        n = self.errors + 1
        for k in range(n):
            low, high = self.size * k // n, self.size * (k + 1) // n
            yield low, self.text[low:high]

    def may_hold(self, text: str) -> bool:
        """False only if no substring of ``text`` is within the error budget."""
        grams = self.grams
        return sum(text[k : k + GRAM] in grams for k in range(len(text) - GRAM + 1)) >= self.shared

    def search(self, text: str) -> tuple[int, int]:
        """Least edit distance of the item to a substring of ``text``, and where that ends first."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, distance = full, 0, self.size
        best, end = distance, 0
        for at, c in enumerate(text, 1):
            same = self.masks.get(c, 0)
            diagonal = (((same & plus) + plus) ^ plus) | same | minus
            up, down = minus | ~(diagonal | plus) & full, diagonal & plus
            if up & top:
                distance += 1
            elif down & top:
                distance -= 1
            up, down = up << 1 & full, down << 1 & full
            plus, minus = down | ~(diagonal | up) & full, diagonal & up
            if distance < best:
                best, end = distance, at
        return best, end


def _whole_words(text: str, start: int, end: int) -> bool:
    """No letter or digit goes on beyond either end of the span."""
    before = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    return not before and not (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


def _automaton(items: list[Item]):
    import ahocorasick

    found: dict[str, list[tuple[int, int]]] = {}
    for k, item in enumerate(items):
        for low, piece in item.pieces():
            found.setdefault(piece, []).append((k, low))
    machine = ahocorasick.Automaton()
    for piece, places in found.items():
        machine.add_word(piece, (len(piece), places))
    machine.make_automaton()
    return machine


def _leaks_in(text: str, machine, items: list[Item], backward: list[Item]) -> list[tuple[int, int, int, int]]:
    """(item index, start, end, distance): the nearest passage of every item that leaks."""
    tried: dict[int, list[int]] = {}
    best: dict[int, tuple[int, int, int]] = {}
    for last, (length, places) in machine.iter(text):
        for k, low in places:
            item = items[k]
            if k in best and best[k][0] == 0:
                continue
            first = last + 1 - length - low  # where the item would begin without errors before the piece
            if item.short:
                if _whole_words(text, first, last + 1):
                    best[k] = (0, first, last + 1)
                continue
            starts = tried.setdefault(k, [])
            if starts and first in starts[-8:]:
                continue  # the same window
            starts.append(first)
            lo = max(0, first - item.errors)
            window = text[lo : first + item.size + item.errors]
            if not item.may_hold(window):
                continue
            distance, end = item.search(window)
            if distance <= item.errors and (k not in best or distance < best[k][0]):
                back, size = backward[k].search(window[:end][::-1])
                best[k] = (distance, lo + end - size, lo + end)
    return [(k, start, end, distance) for k, (distance, start, end) in best.items()]


def _original(text: str, start: int, end: int) -> tuple[int, int]:
    """Where a span of the normalised text lies in the text itself."""
    at, low, high = 0, None, 0
    for m in _WORD.finditer(text):
        size = m.end() - m.start()
        if low is None and start < at + size:
            low = m.start() + max(0, start - at)
        if at < end:
            high = m.start() + min(size, end - at)
        else:
            break
        at += size + 1
    return low if low is not None else 0, high


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, budget, min_chars = shared.value
        items = [Item(i, t, budget, min_chars) for i, t in rows]
        backward = [Item(i, t[::-1], budget, min_chars) for i, t in rows]
        machine = _automaton(items)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                for k, start, end, distance in _leaks_in(normalised(text), machine, items, backward):
                    out.append((doc, items[k].item_id, *_original(text, start, end), distance))
            columns = zip(*out, strict=True) if out else [[]] * 5
            names = ["doc_id", "item_id", "start", "end", "distance"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    *,
    budget: float = BUDGET,
    min_chars: int = MIN_CHARS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, start, end, distance) for every document and test item found in it.

    The span, in code points of the text, is the nearest passage.  Null or empty texts and items
    match nothing.  Items of fewer than ``min_chars`` characters match unchanged, as whole words.  Repeated items each have
    their rows, and so have repeated rows and rows with a null id.  Other columns are ignored,
    whatever their names.  No document or no item: empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    items = items.where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    parts = []
    for k in range(blocks):
        # one block: about block_chars characters
        own = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == k).collect()
        rows = [(r.item_id, normalised(r.text)) for r in own]
        rows = sorted(((i, t) for i, t in rows if t), key=str)
        if rows:
            shared = spark.sparkContext.broadcast((rows, budget, min_chars))
            parts.append(docs.mapInArrow(released(_scan(shared)), _LEAKS))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], _LEAKS)

