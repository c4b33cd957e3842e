"""The planted bundle has the faults of its statement and no others, whatever the tables hold."""

from pyspark.sql import functions as F

from newsops.queries import bundles


def test_violations_equal_the_statement_on_odd_rows(spark, monkeypatch):
    """Blank texts, missing languages and sources, odd links and ids that a double cannot hold came out with rules of their own."""
    text, far = "text long enough", 2 ** 60
    rows = [(1, text, "en", "src1", "https://a.example/1"), (2, None, "en", "src1", "https://a.example/2"), (3, "", "", "src1", "https://a.example/3"),
            (4, " " * 1300, "en", "src1", "https://a.example/4"), (5, text, None, "src1", None), (6, text, "en", None, "odd"),
            (7, text, "de", "src3", "https://a.example/7"), (8, text, "es", "src2", "https://a.example/" + "y" * 5000),
            *[(far + i, "x" * 1300, "en", "src1", "https://a.example/b") for i in range(4)], (-1, text, "en", "src1", "ftp://a.example"), (0, text, "en", "src1", "https://a.example/0")]
    frame = spark.createDataFrame(rows, "article_id long, full_text string, lang string, source_id string, url string").withColumn("title", F.lit("abcd"))
    names = spark.createDataFrame([(f"src{i}",) for i in range(4)], "source_id string").select(
        "source_id", F.col("source_id").alias("name"), F.lit("https://s.example/").alias("url"), *[F.lit(False).alias(c) for c in ("enabled", "archived", "user_modified")])
    monkeypatch.setattr(bundles.V, "articles", lambda spark, sf_dir: frame)
    monkeypatch.setattr(bundles.V, "sources", lambda spark, sf_dir: names)
    got = {(r.entity, r.rule): (r.rows, r.ids) for r in bundles.bundle_violations(spark, "").collect()}
    scores = {k: got.pop(k, None) for k in list(got) if k[1].startswith("score")}
    assert scores
    assert got == {
        ("article", "title is too long"): (5, 3), ("article", "url is not http(s)"): (2, 2), ("article", "duplicate id"): (6, 6),
        ("article", "unknown topic_id"): (1, 1), ("article", "unknown source_id"): (1, 1),
    }
