"""RSS and Atom documents to article rows, with per-feed isolation and health checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text, urls

# Limits of one feed and of the health sample.
MAX_ENTRIES, MAX_TITLE, MAX_EXCERPT, MAX_BODY, MAX_BYTES = 100, 500, 4000, 24000, 5 * 1024 * 1024
SAMPLE, MAX_AGE_DAYS, MAX_AHEAD_DAYS = 20, 60, 2

_RSS_ITEM = (
    "struct<title:string,link:string,description:string,summary:string,pubDate:string,updated:string,"
    "`content:encoded`:array<string>>"
)
_ATOM_ENTRY = (
    "struct<title:string,link:array<struct<_href:string,_rel:string>>,summary:string,published:string,"
    "updated:string,content:array<string>>"
)


def read_feed_files(spark, path: str) -> DataFrame:
    """Landed feed documents, one row per file: feed_url, document."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("feed_url"), F.decode("content", "UTF-8").alias("document"))


def feed_format(document) -> Column:
    """``rss``, ``atom`` or NULL, from the root element."""
    root = F.lower(F.regexp_extract(document, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(?:\w+:)?(\w+)", 1))
    return F.when(root.isin("rss", "rdf"), "rss").when(root == "feed", "atom")


def _plain_names(document):
    """The document without its root's own prefix; elements of extensions keep theirs and stay apart."""
    prefix = F.regexp_extract(document, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(\w+):\w+", 1)
    own = F.concat(F.lit("<(/?)"), prefix, F.lit(":"))
    return F.when(prefix == "", document).otherwise(F.regexp_replace(document, own, F.lit("<$1")))


def feed_entries(feeds: DataFrame) -> DataFrame:
    """(feed_url, pos, title, link, summary, published, bodies) for every entry of every feed.

    source_id and source_name come along where ``feeds`` has them.
    """
    base = ["feed_url", *[c for c in ("source_id", "source_name") if c in feeds.columns]]
    doc = feeds.withColumn("_format", feed_format(F.col("document"))).withColumn("_doc", _plain_names(F.col("document")))
    rss = doc.where("_format = 'rss'").withColumn(
        "_x", F.from_xml("_doc", f"struct<channel:struct<item:array<{_RSS_ITEM}>>,item:array<{_RSS_ITEM}>>", {"rowTag": "rss"})
    ).select(*base, F.posexplode(F.coalesce("_x.channel.item", "_x.item")).alias("pos", "e")).select(
        *base, "pos", F.col("e.title").alias("title"), F.col("e.link").alias("link"),
        F.coalesce("e.summary", "e.description").alias("summary"), F.coalesce("e.pubDate", "e.updated").alias("published"),
        F.col("e").getField("content:encoded").alias("bodies"),
    )
    atom = doc.where("_format = 'atom'").withColumn(
        "_x", F.from_xml("_doc", f"struct<entry:array<{_ATOM_ENTRY}>>", {"rowTag": "feed"})
    ).select(*base, F.posexplode("_x.entry").alias("pos", "e"))
    alternate = F.filter("e.link", lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    atom = atom.select(
        *base, "pos", F.col("e.title").alias("title"), F.try_element_at(alternate, F.lit(1))["_href"].alias("link"),
        F.col("e.summary").alias("summary"), F.coalesce("e.published", "e.updated").alias("published"),
        F.col("e.content").alias("bodies"),
    )
    return rss.unionByName(atom)


def longest_body(bodies):
    """Longest plain text among the embedded bodies; the first wins a tie."""
    plain = F.transform(F.coalesce(bodies, F.array().cast("array<string>")), lambda b: text.plain_text(b, MAX_BODY))
    return F.aggregate(plain, F.lit(""), lambda best, b: F.when(F.length(b) > F.length(best), b).otherwise(best))


def feed_articles(feeds: DataFrame, max_excerpt: int | None = MAX_EXCERPT) -> DataFrame:
    """Article rows of the first 100 entries per feed; rows without title or safe link drop out.

    ``feeds``: feed_url, source_id, source_name, document.  With ``max_excerpt`` None excerpts stay whole.
    """
    first = feed_entries(feeds).where(F.col("pos") < MAX_ENTRIES)
    rows = first.select(
        "feed_url", "source_id", "source_name", "pos", text.plain_text("title", MAX_TITLE).alias("title"),
        urls.resolve_link("feed_url", F.coalesce("link", F.lit(""))).alias("url"), F.trim(F.coalesce("link", F.lit(""))).alias("_raw"),
        text.plain_text("summary", max_excerpt).alias("excerpt"), F.nullif(F.trim("published"), F.lit("")).alias("published_at"),
        longest_body(F.col("bodies")).alias("full_text"),
    ).where((F.col("title") != "") & (F.col("_raw") != "")).where(urls.is_public_url(urls.folded_url("url")))
    return rows.drop("_raw")


def feed_errors(feeds: DataFrame, articles: DataFrame) -> DataFrame:
    """Feeds that gave no article; the other feeds of the run are not affected."""
    return feeds.join(articles.select("feed_url").distinct(), "feed_url", "left_anti").select(
        "feed_url", "source_id", F.lit("no usable article in the feed").alias("error")
    )


def feed_check(feeds: DataFrame, articles: DataFrame) -> DataFrame:
    """ok, entry count and first title per feed; a feed without articles is not ok."""
    seen = articles.groupBy("feed_url").agg(F.count(F.lit(1)).alias("entry_count"), F.min_by("title", "pos").alias("sample_title"))
    return feeds.select("feed_url").distinct().join(seen, "feed_url", "left").select(
        "feed_url", F.col("entry_count").isNotNull().alias("ok"), F.coalesce("entry_count", F.lit(0)).alias("entry_count"), "sample_title"
    )


def feed_health(feeds: DataFrame, as_of, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Completeness, freshness and format of each feed over its first 20 entries."""
    entries = feed_entries(feeds)
    sample = entries.where(F.col("pos") < SAMPLE).withColumn("_ts", dates.published_timestamp("published"))
    total = entries.groupBy("feed_url").agg(F.count(F.lit(1)).alias("entries"))
    seen = sample.groupBy("feed_url").agg(
        F.count(F.lit(1)).alias("sample_size"), F.count_if(F.trim("title") != "").alias("sample_titles"),
        F.count_if(F.trim("link").rlike(r"(?i)^https?:")).alias("sample_links"), F.count("_ts").alias("sample_dates"),
        F.max("_ts").alias("latest"),
    )
    j = feeds.select("feed_url", feed_format(F.col("document")).alias("format"), F.octet_length("document").alias("bytes")).join(
        total, "feed_url", "left").join(seen, "feed_url", "left").na.fill(0, ["entries", "sample_size", "sample_titles", "sample_links", "sample_dates"])
    some = F.col("sample_size") > 0
    errors = F.array_compact(F.array(
        F.when(F.col("format").isNull(), "not a recognized feed"),
        F.when(F.col("bytes") > MAX_BYTES, "document too large"),
        F.when(F.col("entries") == 0, "no entries"),
        F.when(some & (F.col("sample_titles") < F.col("sample_size")), "entry without title"),
        F.when(some & (F.col("sample_links") < F.col("sample_size")), "entry without link"),
        F.when(some & (F.col("sample_dates") < F.col("sample_size")), "entry without date"),
        F.when(some & F.col("latest").isNull(), "no dated entry"),
        F.when(F.col("latest") < as_of - F.make_interval(days=F.lit(max_age_days)), "latest entry too old"),
        F.when(F.col("latest") > as_of + F.make_interval(days=F.lit(MAX_AHEAD_DAYS)), "latest entry in the future"),
    ))
    return j.withColumn("errors", errors).withColumn("ok", F.size("errors") == 0)
