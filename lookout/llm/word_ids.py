"""Ids of whole texts under a byte-pair tokenizer with word ends.

The tokenizer cuts a text into words, digits and runs of marks, lower-cases them, drops white
space and merges the bytes of each by rank, its last byte carrying the word's end.  Merging is
what costs.  ``tiktoken`` merges by rank as well, in one call a text, once every word is
followed by one space that stands for its end: a vocabulary entry with a word end is the entry's
bytes and a space there, and the ranks of single bytes with a space come before all merges.

Both libraries agree on every text when each entry, merged alone, comes out as itself; entries
that do not are looked for when the tables are built, and then, or when the tokenizer file has
other rules than these, its own library encodes whole texts.  It also encodes the words that
hold characters from U+0100 on or a special token.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from .words import release

# The rules of the tokenizer file that the tables below follow.
_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_CUTTERS = [
    {
        "type": "Split",
        "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
        "behavior": "Removed",
        "invert": True,
    },
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]

# the classes of those rules among the characters below U+0100
_WHITE = "\t-\r \x85\xa0"
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PART = re.compile(f"('s|'t|'re|'ve|'m|'ll|'d|[{_DIGITS}]|[^{_WHITE}{_LETTERS}{_DIGITS}]+)")
_SPACES = "\t\n\x0b\x0c\r\x85\xa0"


def shown_bytes() -> dict[str, int]:
    """Byte-level vocabularies show a byte that does not print as the next free character from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class WordIds:
    """``encode(text)``: the ids of a text as an array of unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.fast = self._tables(rules)
        self.special = [t["content"] for t in rules["added_tokens"]]
        odd = "|".join(["[^\\x00-\\xff]", *map(re.escape, self.special)])
        self.odd = re.compile(f"([^{_WHITE}]*(?:{odd})[^{_WHITE}]*)")

    def _tables(self, rules: dict):
        """The merging of ``tiktoken``, or None if this file has other rules."""
        import tiktoken
        from tokenizers.models import BPE

        model = rules["model"]
        known = (
            rules["normalizer"] == {"type": "Sequence", "normalizers": _NORMALIZERS}
            and rules["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": _CUTTERS}
            and model["end_of_word_suffix"] == "</w>"
            and not (model["dropout"] or model["byte_fallback"] or model["ignore_merges"])
        )
        if not known:
            return None
        byte, special = shown_bytes(), {t["content"] for t in rules["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        inner = BPE(vocab=model["vocab"], merges=merges)  # the same merges without word ends
        ranks, merge = {}, self.tokenizer.model.tokenize
        for shown, rank in model["vocab"].items():
            ended = shown.endswith("</w>")
            text = shown[:-4] if ended else shown
            if shown in special or "\u0120" in text:  # a space, which the tokenizer drops
                continue
            if [t.id for t in (merge if ended else inner.tokenize)(text)] != [rank]:
                return None
            ranks[bytes(byte[c] for c in text) + b" " * ended] = rank
        single = {own: rank for own, rank in ranks.items() if len(own.rstrip(b" ")) == 1}
        if len(single) != 510 or max(single.values()) > min(r for own, r in ranks.items() if own not in single):
            return None  # a byte and a byte with an end must come before all merges
        ranks[b" "] = max(ranks.values()) + 1  # never in a result: every space follows a word
        return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def _merged(self, text: str) -> np.ndarray:
        parts = _PART.sub(r" \1 ", text.lower()) + " "
        for white in _SPACES:
            parts = parts.replace(white, " ")
        return np.array(self.fast.encode_ordinary(parts), np.uint32)  # what matches no pattern, more spaces, has no id

    def _own(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _ordinary(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(s in text for s in self.special)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None:
            return self._own(text)
        if self._ordinary(text):
            return self._merged(text)
        stretches = self.odd.split(text)  # ordinary and odd ones in turn
        return np.concatenate([self._own(x) if k % 2 else self._merged(x) for k, x in enumerate(stretches)])


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One for each Python worker."""
    made = WordIds(path)
    release()  # the file's rules and the tables' checks
    return made
