import pytest
from pyspark.sql import functions as F

from lookout import SearchConfig, batch_search, search
from lookout.functions.collation import collation_rules, fold_accents, fold_accents_text
from lookout.operators import postings

TEXTS = ["École Été", "E\u0301cole", "ecole ete", "straße ÅNGSTRÖM", "Ñandú 漢字", "ệ ǖ ﬁ", "İstanbul", None, ""]
CFG = SearchConfig(search_column="name", tie_break=("key",), extra_columns=("key",))


def _df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "key long, name string")


def test_folding_is_the_same_in_spark_and_python(spark):
    for r in _df(spark).select("name", fold_accents(F.col("name")).alias("f")).collect():
        assert r.f == (None if r.name is None else fold_accents_text(r.name))
    assert fold_accents_text("École E\u0301 ệ Å ñ ß ø") == "Ecole E e A n ß ø"


def test_rules_of_collation_names():
    assert collation_rules("Latin1_General_CI_AI") == {"case_sensitive": False, "accent_sensitive": False}
    assert collation_rules("SQL_Latin1_General_CP1_CI_AS") == {"case_sensitive": False, "accent_sensitive": True}
    assert collation_rules("Latin1_General_CS_AS") == {"case_sensitive": True, "accent_sensitive": True}
    assert collation_rules("Latin1_General_BIN2") == {"case_sensitive": True, "accent_sensitive": True}


@pytest.mark.parametrize("case", [True, False])
def test_searches_ignore_accents(spark, scratch, case):
    cfg = CFG.replace(accent_sensitive=False, case_sensitive=case)
    df = _df(spark)
    keys = lambda hits: sorted(r.key for r in hits.collect())
    for text, some, all_cases in (("Écolé", [0, 1], [0, 1, 2]), ("ecole ete", [2], [0, 2]), ("angstrom", [], [3]), ("E_ole", [0, 1], [0, 1, 2])):
        want = some if case else all_cases
        assert keys(search(df, text, cfg)) == want
        q = spark.createDataFrame([(1, text, 9)], "query_id long, text string, k int")
        for strategy in ("scan", "blocked"):
            assert keys(batch_search(df, q, cfg, strategy=strategy)) == want
        if text == "Écolé":
            index = postings.build(df, cfg, f"{scratch}/index", rows_per_part=2)
            assert keys(postings.batch_search_indexed(index, q, cfg)) == want == keys(postings.search_indexed(index, text, cfg))
    assert keys(search(df, "Écolé", CFG)) == []
