import hashlib
import random
import re

import pyarrow as pa

from lookout.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(*m.span(), 0) for m in EMAIL.finditer(text)]
    out += [(*m.span(), 1) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(*m.span(), 2) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and _luhn(digits(m))]
    out += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_equals_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a1@.+- ()2%3.@\n0é") for _ in range(rng.randrange(0, 40)))
        assert pii.base_spans(text) == _base(text), text
    for text in ("4111 1111 1111 1111 x 4111-1111-1111-1112", "0000300.1.2.3 1.2.3.4.5.6.7.8", "a" * 3000 + "@b.c", "9" * 3000):
        assert pii.base_spans(text) == _base(text)


def test_field_spreads_labels_over_a_document(spark):
    rows = [(k, f"call +1 ({200 + k}) 555-{1000 + k} or mail u{k}x.{k:02d}@mail{k}.example.com today 10.0.0.{k} or 4111111111111111 ok 3. and 4.0.") for k in range(60)]
    model = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    text = "his name is bosbt.42 and bosbt.42@mail8.example.com , card 4041.8949.7460.8795 or 4041894974608795 ; version 3. of 4.0."
    found = [text[a:b] for a, b, _ in model.added(text, pii.base_spans(text))]
    assert found == ["bosbt.42", "4041.8949.7460.8795"]
    assert "4041" not in pii.redacted(text, model) and "bosbt" not in pii.redacted(text, model)
    clean = "version 3. of 2024, page 12 of 4.0."
    assert model.added(clean, []) == [] and pii.redacted(clean, model) == clean


def test_query_columns_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        base, row = _base(r.text), got[r.doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[2] == k for s in base) for k in range(4)]
        named = [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base]
        assert row.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(row.spans.split(",")) | {""} and len(list(filter(None, row.spans.split(",")))) == len(named) + row.n_added


class _Docs:
    """Stands for a table: hands out the function that tasks run."""

    schema = "doc_id bigint, text string"

    def mapInArrow(self, run, schema):
        return run


def test_redacted_texts_are_handed_on_bit_by_bit():
    rows = ["write to ann@example.org " + "word " * 400, None, ""] * 1000
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(rows))), "text": rows})
    model = pii.Model([])
    out = list(pii.redact(_Docs(), model=model)(iter([batch, batch.slice(0, 0), batch.slice(1, 2)])))
    assert max(part.nbytes for part in out) < 1.1 * 2**20
    got = pa.Table.from_batches(out)
    assert got["doc_id"].to_pylist() == [*range(len(rows)), 1, 2]
    assert got["text"].to_pylist() == [t and pii.redacted(t, model) for t in rows] + [None, ""]
