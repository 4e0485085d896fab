from lookout.llm import decontaminate as D


def test_short_items_match_unchanged_as_whole_words(spark):
    docs = [
        (1, "They asked: WHAT is\n the capital of Peru? Nobody knew."),
        (2, "what is the capitol of peru?"),
        (3, "somewhat is the capital of peru? and 42"),
        (4, "x 142 and 421"),
        (5, "142, (42) 421"),
        (6, None),
    ]
    bench = spark.createDataFrame([(1, "What is the capital of Peru?"), (2, "42"), (3, ""), (4, None)], "item_id long, text string")
    rows = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    got = {(r.doc_id, r.item_id): (r.start, r["end"], r.distance) for r in rows}
    assert got == {(1, 1): (12, 41, 0), (3, 2): (37, 39, 0), (5, 2): (6, 8, 0)} and len(rows) == 3
