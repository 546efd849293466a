"""Page differencing from end to end where pages stand next to their own copies."""

import pytest

html_text = pytest.importorskip("fieldsift.llm.html_text")


def test_copies_keep_their_text(spark):
    page = lambda story: f"<div>logo</div><div>{story}</div><div>imprint</div>"
    urls = ["a.org/x/1", "a.org/x/1", "a.org/x/1", "a.org/x/2", "a.org/x/3", "b.org/1", "b.org/1", "c.org/1"]
    stories = ["one", "one", "one", "two", "two", "alone", "alone", "alone"]
    table = spark.createDataFrame([(i, f"http://{u}", page(s)) for i, (u, s) in enumerate(zip(urls, stories))], "page_id long, url string, html string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.page_id: r.text for r in html_text.extract_text(table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {0: "one", 1: "one", 2: "one", 3: "two", 4: "two", **{i: "logo alone imprint" for i in (5, 6, 7)}}
