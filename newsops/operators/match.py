"""Keyword include/exclude matching of articles against many topics, with evidence.

The topic set is configuration.  While it is small (checked), it travels as a literal and
the match is a narrow, map-side projection: no shuffle, no join, every text read once.
A larger topic set takes the anchor join: article tokens meet keywords on the one token a
matching text must contain, and only those candidates are tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut

FIELDS = ("title", "excerpt", "full_text")
MAX_LITERAL_KEYWORDS = 2000
MAX_SOUGHT = 64                # anchors that one expression looks for; more are met by the tokens of the text


def active_topics(topics: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """Enabled, unarchived topics; a requested id that is not among them is an error."""
    active = topics.where(F.col("enabled") & ~F.col("archived"))
    if requested is None:
        return active
    spark = topics.sparkSession
    wanted = spark.createDataFrame([(t,) for t in requested], "topic_id string")
    unknown = [r.topic_id for r in wanted.join(active, "topic_id", "left_anti").take(5)]
    if unknown:
        raise ValueError(f"unknown or disabled topics: {unknown}")
    return active.join(wanted, "topic_id", "left_semi")


def topic_keywords(topics: DataFrame) -> DataFrame:
    """One row per topic keyword: role, position, spelling, pattern and anchor token."""
    words = topics.select(
        "topic_id",
        text.parse_keyword_array(
            F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(F.array("name"))
        ).alias("include"),
        text.parse_keyword_array("exclusion_keywords").alias("exclude"),
    )
    rows = words.select("topic_id", F.lit("include").alias("role"), F.posexplode("include").alias("pos", "word")).unionByName(
        words.select("topic_id", F.lit("exclude").alias("role"), F.posexplode("exclude").alias("pos", "word"))
    )
    folded = rows.withColumn("folded", F.trim(text.searchable_text("word"))).where("folded <> ''")
    return folded.select(
        "topic_id", "role", "pos", "word",
        text.keyword_pattern("folded").alias("pattern"),
        text.keyword_anchor("folded").alias("anchor"),
    )


def keyword_rule_violations(topics: DataFrame) -> DataFrame:
    """Topics with more keywords than the data model allows."""
    counted = topic_keywords(topics).groupBy("topic_id", "role").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > text.MAX_KEYWORDS)


def in_scope(source_ids, source_id) -> Column:
    """An empty scope means every source; a scope of retired ids matches nothing."""
    return (F.size(source_ids) == 0) | F.array_contains(source_ids, source_id)


def _searchable(articles: DataFrame) -> DataFrame:
    return articles.withColumns(
        {f"_{f}": text.searchable_text(F.coalesce(F.col(f), F.lit(""))) for f in FIELDS}
    )


def _hit_fields(pattern: Column) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.rlike(F.col(f"_{f}"), pattern), F.lit(f)) for f in FIELDS])
    )


def _evidence(hits: Column) -> dict[str, Column]:
    """Evidence columns from hits ``array<struct<role,pos,word,fields>>`` of one pair."""
    ordered = F.array_sort(F.filter(hits, lambda h: F.size(h["fields"]) > 0))
    inc = F.filter(ordered, lambda h: h["role"] == "include")
    exc = F.filter(ordered, lambda h: h["role"] == "exclude")
    words = lambda a: F.transform(a, lambda h: h["word"])                        # noqa: E731
    fields = lambda a: F.array_distinct(F.flatten(F.transform(a, lambda h: h["fields"])))
    return {
        "matched": (F.size(inc) > 0) & (F.size(exc) == 0),
        "matched_keywords": words(inc),
        "matched_fields": fields(inc),
        "keyword_fields": F.map_from_arrays(words(inc), F.transform(inc, lambda h: h["fields"])),
        "excluded_keywords": words(exc),
        "excluded_fields": fields(exc),
    }


def _scope_pairs(articles: DataFrame, topics: DataFrame) -> DataFrame:
    """article x topic pairs inside each topic's source scope (topics are few and narrow)."""
    scope = topics.select(
        "topic_id",
        F.explode_outer(F.when(F.size("source_ids") > 0, F.col("source_ids"))).alias("only"),
    )
    everywhere = [r.topic_id for r in scope.where("only IS NULL").select("topic_id").collect()]
    limited = scope.where("only IS NOT NULL")
    open_pairs = articles.withColumn(
        "topic_id", F.explode(F.array(*[F.lit(t) for t in everywhere]).cast("array<string>"))
    )
    limited_pairs = articles.join(
        limited, F.col("source_id") == F.col("only"), "inner"
    ).drop("only")
    return open_pairs.unionByName(limited_pairs)


def match_topics(
    articles: DataFrame, topics: DataFrame, keep_unmatched: bool = False,
    literal_limit: int = MAX_LITERAL_KEYWORDS,
) -> DataFrame:
    """Rows (article, topic) with evidence: hits and exclusions, or every pair in scope.

    ``articles`` needs ``article_id``, ``source_id`` and the three text fields.
    """
    keywords = topic_keywords(topics)
    config = keywords.take(literal_limit + 1)
    if len(config) <= literal_limit:
        scopes = {r.topic_id: list(r.source_ids or []) for r in topics.select("topic_id", "source_ids").collect()}
        return _match_literal(articles, config, scopes, keep_unmatched, topics)
    return _match_by_anchor(articles, topics, keywords, keep_unmatched)


def _match_literal(articles, config, scopes, keep_unmatched, topics) -> DataFrame:
    def lit_or_null(value):
        return F.lit(value)

    by_topic: dict[str, list] = {t: [] for t in scopes}
    for row in config:
        by_topic[row.topic_id].append(row)
    topic_literals = []
    for topic_id, rows in by_topic.items():
        scope = scopes[topic_id]
        keyword_literals = [
            F.struct(
                lit_or_null(r.role).alias("role"), F.lit(r.pos).alias("pos"),
                F.lit(r.word).alias("word"), F.lit(r.pattern).alias("pattern"),
                F.lit(r.anchor).alias("anchor"),
            )
            for r in rows
        ]
        topic_literals.append(
            F.struct(
                F.lit(topic_id).alias("topic_id"),
                F.array(*[F.lit(s) for s in scope]).cast("array<string>").alias("scope"),
                F.array(*keyword_literals).alias("kws"),
            )
        )
    if not topic_literals:                              # the join route has the columns and no rows
        return _match_by_anchor(articles.limit(0), topics, topic_keywords(topics), keep_unmatched)
    anchors = sorted({r.anchor for r in config})
    known = F.array(*[F.lit(a) for a in anchors]).cast("array<string>")
    # anchors present in the article: the only keywords that need a regular expression
    if len(anchors) <= MAX_SOUGHT:
        found = F.concat(*[text.tokens_among(f"_{f}", anchors) for f in FIELDS])
    else:
        found = F.concat(*[text.text_tokens(f"_{f}") for f in FIELDS])
    present = F.array_intersect(F.array_distinct(found), known)
    ready = _searchable(articles).withColumn("_present", present)
    scoped = F.filter(F.array(*topic_literals), lambda t: in_scope(t["scope"], F.col("source_id")))
    hits = F.transform(
        scoped,
        lambda t: F.struct(
            t["topic_id"].alias("topic_id"),
            F.transform(
                F.filter(t["kws"], lambda k: F.array_contains(F.col("_present"), k["anchor"])),
                lambda k: F.struct(
                    k["role"].alias("role"), k["pos"].alias("pos"), k["word"].alias("word"),
                    _hit_fields(k["pattern"]).alias("fields"),
                ),
            ).alias("hits"),
        ),
    )
    if not keep_unmatched:
        hits = F.filter(hits, lambda t: F.exists(t["hits"], lambda h: F.size(h["fields"]) > 0))
    pairs = ready.withColumn("_pair", F.explode(hits))
    return (
        pairs.withColumn("topic_id", F.col("_pair.topic_id"))
        .withColumns(_evidence(F.col("_pair.hits")))
        .drop("_pair", "_present", *[f"_{f}" for f in FIELDS])
    )


def _match_by_anchor(articles, topics, keywords, keep_unmatched) -> DataFrame:
    """Rows equal in id, source and texts are tested once; each of them gets the evidence."""
    keyed = articles.withColumn("_row", F.sha2(F.to_json(F.struct("article_id", "source_id", *FIELDS)), 256))
    # written once: the tokens and the tests read the folded texts
    ready = cut(_searchable(keyed.select("_row", "source_id", *FIELDS).dropDuplicates(["_row"])).drop(*FIELDS))
    tokens = ready.select(
        "_row", "source_id",
        F.explode(F.array_distinct(F.concat(*[text.text_tokens(f"_{f}") for f in FIELDS]))).alias("anchor"),
    )
    scope = topics.select("topic_id", "source_ids")
    candidates = (
        tokens.join(keywords, "anchor")
        .join(scope, "topic_id")
        .where(in_scope(F.col("source_ids"), F.col("source_id")))
        .select("_row", "topic_id", "role", "pos", "word", "pattern")
    )
    tested = ready.select("_row", *[f"_{f}" for f in FIELDS]).join(candidates, "_row")
    grouped = (
        tested.select(
            "_row", "topic_id",
            F.struct("role", "pos", "word", _hit_fields(F.col("pattern")).alias("fields")).alias("hit"),
        )
        .where(F.size("hit.fields") > 0)
        .groupBy("_row", "topic_id")
        .agg(F.collect_list("hit").alias("_hits"))       # at most one row per keyword of a topic
    )
    if keep_unmatched:
        base = _scope_pairs(keyed, topics).join(grouped, ["_row", "topic_id"], "left")
    else:
        base = keyed.join(grouped, "_row")
    empty = F.array().cast("array<struct<role:string,pos:int,word:string,fields:array<string>>>")
    return base.withColumn("_hits", F.coalesce("_hits", empty)).withColumns(
        _evidence(F.col("_hits"))
    ).drop("_hits", "_row")


def keyword_score(matched_keywords="matched_keywords", keyword_fields="keyword_fields") -> Column:
    """58, plus 7 per keyword, plus 8 per keyword found in the title; at most 95."""
    in_title = F.size(
        F.filter(F.map_values(keyword_fields), lambda f: F.array_contains(f, "title"))
    )
    return F.least(F.lit(95), F.lit(58) + 7 * F.size(matched_keywords) + 8 * in_title)
