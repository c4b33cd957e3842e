"""An excerpt beyond the limit of a feed's entry, whole where it is asked for."""

from newsops.sources import feeds


def test_long_excerpts_stay_whole_on_demand(spark):
    words = " ".join(["word"] * 2000)
    item = f"<item><title>T</title><link>https://f.example/a</link><description>{words}</description></item>"
    df = spark.createDataFrame([("https://f.example/f", "s", "s", f"<rss><channel>{item}</channel></rss>")],
                               "feed_url string, source_id string, source_name string, document string")
    assert feeds.feed_articles(df, max_excerpt=None).first().excerpt == words
    assert len(feeds.feed_articles(df).first().excerpt) == feeds.MAX_EXCERPT
