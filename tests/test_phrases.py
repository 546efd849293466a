"""declared_phrases with phrases that have no inner word, against its oracle."""

import duckdb

from fieldsift import registry


def test_short_phrases_are_found(spark, tmp_path):
    docs = [(1, "alpha beta gamma delta"), (2, "xalpha betax"), (3, "gamma"), (4, ""), (5, None), (6, "alpha  beta"), (7, "delta alpha beta gamma delta")]
    items = [(1, "alpha"), (2, "alpha beta"), (3, "alpha beta gamma"), (4, "a b"), (5, ""), (6, None), (7, " beta "), (8, "t"), (9, " ")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    wanted = sorted(db.execute(registry.ORACLES["declared_phrases"]).fetchall())
    assert {1, 2, 3, 4, 7, 8, 9} == {i for _, i in wanted}
    assert sorted(tuple(r) for r in registry.QUERIES["declared_phrases"](spark, str(tmp_path)).select("doc_id", "item_id").collect()) == wanted
