import zlib

from lookout.llm.sharding import shard


def _check(rows, got, shards=8):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows
    )
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return [sum(r.size for r in got if r.shard == k) for k in range(shards)]


def test_shards_are_even_and_groups_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = shard(docs).collect()
    sizes = _check(rows, got)
    assert max(sizes) < 1.1 * min(sizes)
    home = {}
    for r in got:
        home.setdefault(dict(rows)[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in home.values())


def test_many_light_documents_use_the_tree(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "concat('text ', id, repeat('x', cast(id % 13 as int))) AS text", "concat('s', id % 3) AS source", "id % 97 AS n_chars")
    sizes = _check([(r.doc_id, r.text) for r in df.collect()], shard(df).collect())
    assert max(sizes) < 1.05 * min(sizes)
    sizes = _check([(r.doc_id, r.text) for r in df.collect()], shard(df, shards=5).collect(), 5)
    assert max(sizes) < 1.05 * min(sizes)


def test_a_hot_group_is_cut(spark):
    rows = [(k, "the same text") for k in range(900)] + [(k, f"text {k}") for k in range(900, 1800)]
    sizes = _check(rows, shard(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert max(sizes) < 1.1 * min(sizes)
