import hashlib
from collections import defaultdict

import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lookout.llm import alignment
from lookout.llm.alignment import Aligner, align_tokens, overlaps
from lookout.llm.word_ids import shown_bytes

PATHS = (public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, public.path("piece_bpe_32k.model"))
ODD = [
    "Hello world, don't stop\n\n\tnow  ",
    "naïve café — “quotes” … 漢字かな交じり文 🙂👩‍👩‍👧 ẹ́",
    " leading and trailing ",
    "<|endoftext|> <s> </s> <0x0A> <unk>",
    "a▁b",  # the piece vocabulary's own mark for a space: bytes differ
    "\x00\x01 control \x7f\x85 ",
    "x" * 5000 + " " * 3000 + "\n" * 2000,
    "مرحبا بالعالم नमस्ते दुनिया สวัสดีชาวโลก",
]


def brute(rows):
    """{doc: the columns after doc_id}, token by token."""
    a_of = Tokenizer.from_file(PATHS[0])
    a_of.encode_special_tokens = True
    byte = shown_bytes()
    b_of = sentencepiece.SentencePieceProcessor(model_file=PATHS[3])
    docs, held = {}, defaultdict(set)
    for d, text in rows:
        groups = []
        if text:
            a = a_of.encode(" " + text, add_special_tokens=False)
            whole = (" " + text).encode()
            ids_a, ids_b = a.ids, b_of.encode(text)
            spelled_a = [bytes(byte[c] for c in t) for t in a.tokens]
            spelled_b = []
            for piece in map(b_of.id_to_piece, ids_b):
                hexa = len(piece) == 6 and piece.startswith("<0x") and piece[-1] == ">"
                spelled_b.append(bytes([int(piece[3:5], 16)]) if hexa else piece.replace("▁", " ").encode())
            if b"".join(spelled_a) == whole == b"".join(spelled_b):
                i = j = end_a = end_b = 0
                one, other = [], []
                while i < len(ids_a) or j < len(ids_b):
                    if end_a <= end_b and i < len(ids_a):
                        one.append(ids_a[i])
                        end_a += len(spelled_a[i])
                        i += 1
                    else:
                        other.append(ids_b[j])
                        end_b += len(spelled_b[j])
                        j += 1
                    if end_a == end_b and one and other:
                        groups.append((one, other))
                        one, other = [], []
                assert not one and not other
        docs[d] = groups
        for one, other in groups:
            for x in one:
                for y in other:
                    held[x, y].add(d)
    most = defaultdict(int)
    for (x, _), where in held.items():
        most[x] = max(most[x], len(where))
    out = {}
    for d, groups in docs.items():
        links = [(x, y) for one, other in groups for x in one for y in other]
        counts = [len(held[p]) for p in links]
        text = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, other)) for one, other in groups)
        out[d] = (
            sum(len(one) for one, _ in groups),
            sum(len(other) for _, other in groups),
            len(groups),
            len(links),
            sum(c == most[x] for c, (x, _) in zip(counts, links, strict=True)),
            sum(counts),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        )
    return out


def _rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in docs] + [(10**6 + k, t) for k, t in enumerate([*ODD, None, ""])]


@pytest.mark.parametrize("head", [alignment.HEAD, 50, 0])
def test_equals_brute_force(spark, head):
    rows = _rows(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.selectExpr("*", "'clash' AS key", "1 AS pairs", "2 AS n", "3 AS a", "'x' AS times", "4 AS best")
    got = {r.doc_id: tuple(r)[1:] for r in align_tokens(df, *PATHS, head=head).collect()}
    assert got == brute(rows)
    assert got[10**6 + 4] == (0, 0, 0, 0, 0, 0, "") == got[10**6 + 8] == got[10**6 + 9]


def test_edges(spark):
    long = "word " * 300_000 + "x" * 100_000
    rows = [(None, "no id"), (1, "twice"), (1, "twice"), (2, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in align_tokens(df, *PATHS).collect()), key=str)
    assert [r[0] for r in got] == [1, 1, 2, None] and got[0] == got[1]
    assert got[2][3] >= 300_000 and got[2][1] > 0
    assert align_tokens(df.limit(0), *PATHS).count() == 0


def test_overlaps_are_all_pairs_that_share_a_byte():
    batch = Aligner(*PATHS).align([ODD[0], None, ODD[1], ODD[7]])
    a, b = batch.a, batch.b
    one, other = overlaps(a, b)
    want = {
        (i, j)
        for i in range(len(a.ids))
        for j in range(len(b.ids))
        if a.doc[i] == b.doc[j] and a.start[i] < b.end[j] and b.start[j] < a.end[i]
    }
    got = list(zip(one.tolist(), other.tolist(), strict=True))
    assert set(got) == want and len(got) == len(want)
