"""Operator 8 against SQL where hosts exceed both limits, so that lines go."""

import duckdb

from lookout.llm import registry

MENU = "Home  about contact and the terms of service"


def test_removal_equals_sql(spark, scratch):
    rows = []
    # distinct texts of a host, how many of them hold the line: at and beyond 10, at and beyond 5 %
    for host, texts, held in (("at ten", 10, 10), ("eleven", 11, 11), ("ten of many", 40, 10), ("at the share", 240, 12), ("above it", 239, 12)):
        for k in range(texts):
            own = " ".join(f"{host.replace(' ', '')}{k}x{j}" for j in range(30 if k % 3 else 4))
            rows.append((len(rows), own + (f"\n{MENU.lower() if k % 2 else MENU}" if k < held else ""), host))
    rows += [(len(rows) + k, rows[0][1], "at ten") for k in range(20)]
    path = f"{scratch}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    cursor = con.execute(registry.ORACLE["op8_quality_rules"])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(tuple, cursor.fetchall()))
    got = registry.QUERIES["op8_quality_rules"](spark, scratch).select(*columns).collect()
    assert sorted(map(tuple, got)) == want
    removed = {r.doc_id for r in got if r.n_removed_words}
    hosts = {h: sum(1 for d, _, x in rows if x == h and d in removed) for h in {x for *_, x in rows}}
    assert hosts == {"at ten": 0, "eleven": 11, "ten of many": 0, "at the share": 0, "above it": 12}
