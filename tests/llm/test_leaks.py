import random

import pytest

from lookout.llm import decontaminate as D


def _distance(item, text):
    """Least edit distance of ``item`` to a substring of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(n))


def _edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], [rng.choice("abcdé")], [out[k], rng.choice("abc")]])
    return "".join(out)


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(200):
        item, text = _words(rng, 3), _words(rng, rng.randrange(1, 9))
        distance, end = D.Item(0, item, 0.1).search(text)
        assert distance == _distance(item, text)
        if distance < len(item):
            assert _distance(item, text[:end]) == distance


@pytest.mark.parametrize("block", [4_000_000, 500])
def test_finds_what_brute_force_finds(spark, block):
    rng = random.Random(4)
    items = [(k, _words(rng, 25)) for k in range(12)]
    docs = []
    for k in range(60):
        body = _words(rng, 40)
        if k % 2:
            leak = _edited(rng, items[k % 12][1], rng.randrange(0, 14))
            body += "\n" + leak.replace(" ", " \n ").upper().replace("É", "é") + " " + _words(rng, 20)
        docs.append((k, body))
    want = set()
    for d, text in docs:
        for i, item in items:
            if _distance(D.normalised(item), D.normalised(text)) <= int(len(D.normalised(item)) * D.BUDGET):
                want.add((d, i))
    df = spark.createDataFrame([*docs, (100, None), (101, "")], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "short")], "item_id long, text string")
    rows = D.leaks(df, bench, block_chars=block).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) > 10
    texts = dict(docs)
    for r in rows:
        span = D.normalised(texts[r.doc_id][r.start : r["end"]])
        assert _distance(span, D.normalised(dict(items)[r.item_id])) <= r.distance
