import pytest

from lookout.llm import pii


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, f"call +1 ({200 + k}) 555-{1000 + k} or mail u{k}x.{k:02d}@mail{k}.example.com today 10.0.0.{k} or 4111111111111111 ok 3. and 4.0.") for k in range(60)]
    return pii.train(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("address", ["john.smith@example.com", "<mailto:John.Smith@example.com>"])
def test_local_parts_without_digits(model, address):
    text = f"john.smith wrote, said (John.Smith), and {address} answered jane.smith and john.smith. So it was."
    assert [text[a:b].strip("(),") for a, b, _ in model.added(text, pii.base_spans(text))] == ["john.smith", "John.Smith", "john.smith"]
    assert "ohn.smith" not in pii.redacted(text, model).lower().replace("[email]", "") and "jane.smith" in pii.redacted(text, model)


@pytest.mark.parametrize("n", [1, 12, 13, 40, 3000])
def test_every_repeat_is_found(model, n):
    text = "bosbt.42@mail8.example.com" + " of bosbt.42 that" * n + " , card 4041894974608795" + " and so 4041.8949.7460.8795 too" * n
    found = [text[a:b] for a, b, _ in model.added(text, pii.base_spans(text))]
    assert found == ["bosbt.42"] * n + ["4041.8949.7460.8795"] * n
    before = "of bosbt.42 that " * n + "bosbt.42@mail8.example.com"
    assert len(model.added(before, pii.base_spans(before))) == n


def test_messages_settle_along_chains(model):
    """Evidence passes from repeat to repeat over links that no observed token has."""
    g = pii.Graph("x", [])
    n = 60
    g.shapes, g.base = pii.np.full(n, 7), pii.np.zeros(n, int)
    g.base[0] = 3
    g.chain = pii.np.zeros((0, 2), int)
    g.skips, g.why = pii.np.stack((pii.np.arange(n - 1), pii.np.arange(1, n)), axis=1), pii.np.zeros(n - 1, int)
    flat = pii.Model([])
    flat.unary[:], flat.skip[:] = 0, 8.0
    flat.unary[:, 0] = 0.001
    assert (flat.labels(g)[1:] == 3).all()


def test_shape_reads_whole_tokens():
    from lookout.llm.pii import shape

    long = "x1-" * 40
    assert shape(long + "a") != shape(long + "12345@")
    assert shape("010.0.0.1") == shape("010.0.0.2") != shape("999.0.0.1")
    assert isinstance(shape("9" * 10_000 + ".1.1.1"), int)
