import time
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lookout.llm.cutting_stock import solve
from lookout.llm.packing import pack
from lookout.llm.registry import tokenizer_path
from lookout.llm.word_ids import WordIds

PATH = tokenizer_path("word_bpe_49k.json")
ODD = [
    "á É  İstanbul ΑΣ ΟΔΟΣ x　y\x1cz <|endoftext|> foo<|endoftext|>bar don't DON'T I'M",
    "ẹ́ ́x ﬁ Å 12 3４ ①  Straße. ÀÉÎ, ªº! µm",
    "",
    " \n",
    "hello, World. hello world?!",
]


def test_ids_are_the_tokenizers():
    words, tokenizer = WordIds(PATH), Tokenizer.from_file(PATH)
    assert words.fast is not None
    rng = np.random.default_rng(5)
    letters = [*"aAbeEnstTz019'\".,$- \n\t\x1c\x1f\x85\xa0éÉßªµ²½ÿ", "'s", "'LL", "ā", "<|endoftext|>"]
    mixed = ["".join(rng.choice(letters, 60)) for _ in range(500)]
    for text in [*ODD, *mixed, "ab" * 50_000, "x" * 3000 + " 'll"]:
        assert words.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_entries_merge_as_the_tokenizer_does():
    words, tokenizer = WordIds(PATH), Tokenizer.from_file(PATH)
    shown = [w[:-4] for w in tokenizer.get_vocab() if w.endswith("</w>")]
    text = " ".join(a + b for a, b in zip(shown, shown[1000:], strict=False) if (a + b).isascii() and (a + b).isalpha())
    assert words.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_take_their_own_way():
    path = tokenizer_path("byte_bpe_50k.json")
    words, tokenizer = WordIds(path), Tokenizer.from_file(path)
    assert words.fast is None
    assert words.encode("Foo  bar\n").tolist() == tokenizer.encode("Foo  bar\n", add_special_tokens=False).ids


def test_many_classes_end_in_a_started_session(spark):
    rng = np.random.default_rng(11)
    demand = {k: int(rng.integers(1, 4000)) for k in range(1, 257)}
    begun = time.monotonic()
    patterns = solve(demand, 256)
    assert time.monotonic() - begun < 120
    bins, units = sum(n for _, n in patterns), sum(k * n for k, n in demand.items())
    large = sum(n for k, n in demand.items() if k > 128)  # no two of these share a sequence
    assert bins <= 1.002 * max(units / 256, large)


def test_arguments():
    with pytest.raises(ValueError, match="multiple"):
        pack(None, PATH, length=2047, quantum=8)
    with pytest.raises(ValueError, match="capacity"):
        solve({9: 1}, 8)


def test_patterns_hold_every_item_once():
    rng = np.random.default_rng(3)
    for capacity in (1, 7, 64):
        demand = {k: int(rng.integers(0, 400)) for k in range(1, capacity + 1)}
        patterns = solve(demand, capacity)
        held = dict.fromkeys(demand, 0)
        for pattern, times in patterns:
            assert sum(c * n for c, n in pattern.items()) <= capacity and times > 0
            for c, n in pattern.items():
                held[c] += n * times
        assert held == demand
    assert solve({}, 8) == []
    assert sum(n for _, n in solve({3: 1000, 5: 1000}, 8)) == 1000
    assert sum(n for _, n in solve({5: 300, 4: 300, 3: 600}, 10)) <= 485  # 4500 units in bins of 10


def test_packing_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate([*ODD, None, "word " * 5000])], docs.schema)
    docs = docs.union(odd)
    tokenizer = Tokenizer.from_file(PATH)
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = pack(docs, PATH).collect()
    at, sequences = dict.fromkeys(ids, 0), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and len(own) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        at[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(at[d] == len(x) for d, x in ids.items())
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    tokens = sum(map(len, ids.values()))
    assert tokens / (2048 * len(sequences)) > 0.97
