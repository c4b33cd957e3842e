"""Pages go through Python one by one, so a worker holds few of them whatever the size of the table."""

from pyspark.sql import functions as F

from newsops.sources import pages


def test_no_batch_of_whole_pages(spark):
    html = "<body><article><p>One paragraph of some length.</p><p>x</p></article></body>"
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id int, html string")
    got = df.select("page_id", pages.page_paragraphs("html").alias("p"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" in plan
    rows = got.select("page_id", "p", pages.body_text(F.col("p")).alias("body")).orderBy("page_id").collect()
    assert [r.p for r in rows] == [["One paragraph of some length.", "x"], [], []]
    assert [r.body for r in rows] == ["One paragraph of some length.", "", ""]
