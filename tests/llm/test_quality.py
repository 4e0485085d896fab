from pyspark.sql import functions as F

from lookout.llm.quality import quality_posteriors


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0
    found = quality_posteriors(docs, labels.where(~held)).join(labels.where(held), "doc_id")
    rows = [(r.quality, r.toxic, r.kept) for r in found.collect()]
    clean = [k for q, t, k in rows if q and not t]
    toxic = [k for _, t, k in rows if t]
    poor = [k for q, t, k in rows if not q]
    assert sum(clean) / len(clean) > 0.98 and sum(toxic) / len(toxic) < 0.15 and sum(poor) / len(poor) < 0.15


def test_sparse_sites_shrink_to_their_parents(spark):
    good, bad = "a fine text about rivers and hills", "junk junk spam junk"
    rows = [(k, "good" if k % 2 else "bad", "p", good if k % 2 else bad) for k in range(400)]
    rows += [(1000, "new", "p", "words unseen so far"), (1001, "good", "q", "words unseen so far"), (1002, "bad", "q", "words unseen so far")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    labels = df.where("doc_id < 300").selectExpr("doc_id", "cast(source = 'good' as int) AS quality", "0 AS toxic")
    got = {r.doc_id: r for r in quality_posteriors(df, labels).collect()}
    assert got[1].kept and not got[0].kept
    assert got[1002].p_quality < got[1000].p_quality < got[1001].p_quality
    assert all(r.p_toxic == 0 for r in got.values())
