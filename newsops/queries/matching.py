"""Keyword matching, scores, reasons and the funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import funnel, match, score
from ..plans import digest as D
from . import views as V
from .registry import query

_BASE = (V.ARTICLES, V.TOPICS, V.SOURCES, V.MATCHES)


def _live(spark, sf_dir):
    return V.sources(spark, sf_dir).where("enabled AND NOT archived")


def _fresh_live(spark, sf_dir):
    live = _live(spark, sf_dir).select("source_id", "source_ord")
    return V.fresh_articles(spark, sf_dir).join(live, "source_id")


def matches(spark, sf_dir, keep_unmatched=False):
    topics = match.active_topics(V.topics(spark))
    df = match.match_topics(_fresh_live(spark, sf_dir), topics, keep_unmatched)
    return df.withColumn("lexical_score", match.keyword_score()).join(D.settings(topics), "topic_id")


@query("keyword_hits", V.sql(*_BASE, select="""
SELECT topic_id, count(*) FILTER (n_in > 0 AND n_ex = 0) AS hits, count(*) FILTER (n_ex > 0) AS excluded
FROM verdict WHERE n_in + n_ex > 0 GROUP BY topic_id"""))
def keyword_hits(spark, sf_dir):
    return matches(spark, sf_dir).groupBy("topic_id").agg(
        F.count_if("matched").alias("hits"), F.count_if(F.size("excluded_keywords") > 0).alias("excluded")
    )


_EVIDENCE = V.sql(*_BASE, select="""
SELECT v.topic_id, v.article_id, v.words AS keywords, f.fields, f.n_fields FROM verdict v JOIN (
  SELECT article_id, topic_id,
    concat_ws('|', CASE WHEN min(p) FILTER (field = 'title') IS NOT NULL THEN 'title' END,
      CASE WHEN min(p) FILTER (field = 'excerpt') IS NOT NULL THEN 'excerpt' END,
      CASE WHEN min(p) FILTER (field = 'full_text') IS NOT NULL THEN 'full_text' END) AS fields,
    count(*) AS n_fields
  FROM (SELECT article_id, topic_id, pos * 10 AS p, 'title' AS field FROM hit WHERE role = 'in' AND in_title
    UNION ALL SELECT article_id, topic_id, pos * 10 + 1, 'excerpt' FROM hit WHERE role = 'in' AND in_excerpt
    UNION ALL SELECT article_id, topic_id, pos * 10 + 2, 'full_text' FROM hit WHERE role = 'in' AND in_full)
  GROUP BY ALL) f USING (article_id, topic_id)
WHERE v.n_in > 0 AND v.n_ex = 0""")


def _evidence(df):
    return df.where("matched").select(
        "topic_id", "article_id", F.array_join("matched_keywords", "|").alias("keywords"),
        # compared as a set in fixed order; the first-seen order is tested on fixtures
        F.array_join(F.filter(
            F.array(*[F.lit(f) for f in match.FIELDS]), lambda f: F.array_contains("matched_fields", f)
        ), "|").alias("fields"),
        F.aggregate(F.map_values("keyword_fields"), F.lit(0), lambda a, f: a + F.size(f)).cast("bigint").alias("n_fields"),
    )


@query("keyword_evidence", _EVIDENCE)
def keyword_evidence(spark, sf_dir):
    return _evidence(matches(spark, sf_dir))


@query("keyword_evidence_anchor", _EVIDENCE)
def keyword_evidence_anchor(spark, sf_dir):
    """The route of large topic sets, over rows that each occur twice: the same evidence on every row."""
    rows = _fresh_live(spark, sf_dir)
    topics = match.active_topics(V.topics(spark))
    return _evidence(match.match_topics(rows.unionByName(rows), topics, literal_limit=0)).distinct()


@query("keyword_scores", V.sql(*_BASE, select="""
SELECT topic_id, article_id, score, CASE WHEN score >= 80 THEN '80-100' WHEN score >= 60 THEN '60-79'
  WHEN score >= 40 THEN '40-59' ELSE '0-39' END AS band FROM verdict WHERE n_in > 0 AND n_ex = 0"""))
def keyword_scores(spark, sf_dir):
    return matches(spark, sf_dir).where("matched").select(
        "topic_id", "article_id", F.col("lexical_score").alias("score"), score.score_band(F.col("lexical_score")).alias("band")
    )


@query("exclusion_rejects", V.sql(*_BASE, select="""
SELECT topic_id, source_id, count(*) AS rejected, count(*) FILTER (n_in > 0) AS with_hit
FROM verdict WHERE n_ex > 0 GROUP BY ALL"""))
def exclusion_rejects(spark, sf_dir):
    return (
        matches(spark, sf_dir).where(F.size("excluded_keywords") > 0).groupBy("topic_id", "source_id")
        .agg(F.count(F.lit(1)).alias("rejected"), F.count_if(F.size("matched_keywords") > 0).alias("with_hit"))
    )


@query("keyword_pools", V.sql(*_BASE, select="""
SELECT topic_id, CASE WHEN n_ex > 0 THEN 'excluded' WHEN n_in > 0 THEN 'literal' ELSE 'semantic' END AS pool,
  count(*) AS articles FROM verdict GROUP BY ALL"""))
def keyword_pools(spark, sf_dir):
    """Literal and semantic pools of every topic, with what the exclusions removed."""
    pool = (
        F.when(F.size("excluded_keywords") > 0, "excluded").when(F.col("matched"), "literal").otherwise("semantic")
    )
    return matches(spark, sf_dir, keep_unmatched=True).groupBy("topic_id", pool.alias("pool")).agg(
        F.count(F.lit(1)).alias("articles")
    )


@query("selection_tiers", V.sql(*_BASE, select="""
SELECT topic_id, CASE WHEN score >= threshold THEN 'core' WHEN score >= least(threshold, greatest(40, threshold - 15))
  THEN 'supplement' ELSE 'rejected' END AS tier, count(*) AS articles, sum(score) AS total_score
FROM verdict WHERE n_in > 0 AND n_ex = 0 GROUP BY ALL"""))
def selection_tiers(spark, sf_dir):
    tier = F.when(F.col("lexical_score") < F.col("supplement_threshold"), "rejected").otherwise(
        score.selection_tier(F.col("lexical_score"), F.col("threshold"))
    )
    return matches(spark, sf_dir).where("matched").groupBy("topic_id", tier.alias("tier")).agg(
        F.count(F.lit(1)).alias("articles"), F.sum("lexical_score").alias("total_score")
    )


@query("freshness_by_source", V.sql(V.ARTICLES, V.TOPICS, V.SOURCES, select=f"""
SELECT t.topic_id, r.reason, sum(n) AS rejected FROM (
  SELECT source_id, reason, count(*) AS n FROM (
    SELECT a.source_id, CASE WHEN date_kind = 'missing' THEN 'date_missing' WHEN date_kind = 'invalid' THEN 'date_invalid'
      WHEN published > TIMESTAMP '{V.AS_OF}' + INTERVAL 1 DAY THEN 'date_future'
      WHEN published < TIMESTAMP '{V.AS_OF}' - INTERVAL 7 DAY THEN 'date_stale' END AS reason FROM articles a)
  WHERE reason IS NOT NULL GROUP BY ALL) r
JOIN sources s ON s.source_id = r.source_id AND s.enabled AND NOT s.archived
JOIN topics t ON t.enabled AND NOT t.archived AND (len(t.source_ids) = 0 OR list_contains(t.source_ids, r.source_id))
GROUP BY ALL"""))
def freshness_by_source(spark, sf_dir):
    topics = match.active_topics(V.topics(spark))
    scope = D.topic_scope(topics, V.sources(spark, sf_dir)).select("topic_id", "source_id")
    per_source = (
        V.dated_articles(spark, sf_dir).where("date_reason IS NOT NULL")
        .groupBy("source_id", F.col("date_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    )
    return per_source.join(scope, "source_id").groupBy("topic_id", "reason").agg(F.sum("n").alias("rejected"))


def _items_sql() -> str:
    return f"""
items AS (
  SELECT a.source_id, CASE WHEN date_kind = 'missing' THEN 'date_missing' WHEN date_kind = 'invalid' THEN 'date_invalid'
      WHEN published > TIMESTAMP '{V.AS_OF}' + INTERVAL 1 DAY THEN 'date_future'
      WHEN published < TIMESTAMP '{V.AS_OF}' - INTERVAL 7 DAY THEN 'date_stale' END AS reason
  FROM articles a JOIN sources s ON s.source_id = a.source_id AND s.enabled AND NOT s.archived),
item_events AS (
  SELECT source_id, unnest(CASE WHEN reason IS NULL THEN ['feed_items', 'discovered', 'fresh']
    ELSE ['feed_items', 'discovered', 'date_rejected', reason] END) AS counter FROM items),
item_counts AS (
  SELECT 'global' AS scope, '' AS scope_id, counter, count(*) AS value FROM item_events GROUP BY ALL
  UNION ALL SELECT 'source', source_id, counter, count(*) FROM item_events GROUP BY ALL
  UNION ALL SELECT 'topic', t.topic_id, counter, count(*) FROM item_events e JOIN topics t
    ON t.enabled AND NOT t.archived AND (len(t.source_ids) = 0 OR list_contains(t.source_ids, e.source_id)) GROUP BY ALL)"""


@query("funnel_item_counts", V.sql(V.ARTICLES, V.TOPICS, V.SOURCES, _items_sql(), select="SELECT * FROM item_counts"))
def funnel_item_counts(spark, sf_dir):
    """Item counters are counted once globally, and once per topic that reads the source."""
    srcs = V.sources(spark, sf_dir)
    scope = D.topic_scope(match.active_topics(V.topics(spark)), srcs).select("topic_id", "source_id")
    items = (
        V.dated_articles(spark, sf_dir).join(_live(spark, sf_dir).select("source_id"), "source_id")
        .select(F.lit("run").alias("run_id"), "source_id", "date_reason")
    )
    return funnel.with_aliases(funnel.item_counts(items, scope)).drop("run_id")


@query("funnel_grouping_sets", V.sql(*_BASE, """
ev AS (
  SELECT topic_id, source_id, unnest(CASE WHEN n_ex > 0 THEN ['exclusion_rejected']
    WHEN score >= least(threshold, greatest(40, threshold - 15)) THEN ['keyword_hits', 'qualified']
    ELSE ['keyword_hits', 'threshold_rejected', 'below_supplement', 'below_extended'] END) AS counter
  FROM verdict WHERE n_in + n_ex > 0)""", select="""
SELECT CASE WHEN grouping(topic_id) = 0 THEN 'topic' WHEN grouping(source_id) = 0 THEN 'source' ELSE 'global' END AS scope,
  coalesce(topic_id, source_id, '') AS scope_id, counter, count(*) AS value
FROM ev GROUP BY GROUPING SETS ((counter), (topic_id, counter), (source_id, counter))"""))
def funnel_grouping_sets(spark, sf_dir):
    m = matches(spark, sf_dir)
    low = F.col("lexical_score") < F.col("supplement_threshold")
    names = (
        F.when(F.size("excluded_keywords") > 0, F.array(F.lit("exclusion_rejected")))
        .when(low, F.array(F.lit("keyword_hits"), F.lit("threshold_rejected")))
        .otherwise(F.array(F.lit("keyword_hits"), F.lit("qualified")))
    )
    events = m.select(F.lit("run").alias("run_id"), "topic_id", "source_id", F.explode(names).alias("counter"))
    return funnel.with_aliases(funnel.count_events(events)).drop("run_id")


@query("reason_breakdown", V.sql(*_BASE, """
reasons AS (
  SELECT v.topic_id, v.source_id, CASE WHEN v.n_ex > 0 THEN 'exclusion_match' WHEN l.quality IS NULL THEN 'insufficient_evidence'
    WHEN l.toxic = 1 THEN 'Nonsense' WHEN l.quality = 1 AND v.n_title > 0 THEN ' Direct_Match ' WHEN l.quality = 1 THEN 'contextual_match'
    ELSE 'off_topic' END AS reason
  FROM verdict v LEFT JOIN labels l ON l.doc_id = v.article_id WHERE v.n_in + v.n_ex > 0)""", select="""
SELECT topic_id, source_id, count(*) FILTER (reason = ' Direct_Match ') AS reason_direct_match,
  count(*) FILTER (reason = 'contextual_match') AS reason_contextual_match,
  count(*) FILTER (reason = 'background_context') AS reason_background_context,
  count(*) FILTER (reason = 'off_topic') AS reason_off_topic, count(*) FILTER (reason = 'exclusion_match') AS reason_exclusion_match,
  count(*) FILTER (reason = 'insufficient_evidence') AS reason_insufficient_evidence,
  count(*) FILTER (reason = 'Nonsense') AS reason_other
FROM reasons GROUP BY ALL"""))
def reason_breakdown(spark, sf_dir):
    labels = V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), "quality", "toxic")
    in_title = F.exists(F.map_values("keyword_fields"), lambda f: F.array_contains(f, "title"))
    reason = (
        F.when(F.size("excluded_keywords") > 0, "exclusion_match").when(F.col("quality").isNull(), "insufficient_evidence")
        .when(F.col("toxic") == 1, "Nonsense").when((F.col("quality") == 1) & in_title, " Direct_Match ")
        .when(F.col("quality") == 1, "contextual_match").otherwise("off_topic")
    )
    names = [f"reason_{r}" for r in funnel.REASON_COUNTERS] + ["reason_other"]
    counted = matches(spark, sf_dir).join(labels, "article_id", "left").withColumn("counter", funnel.reason_counter(reason))
    return counted.groupBy("topic_id", "source_id").agg(*[F.count_if(F.col("counter") == n).alias(n) for n in names])


@query("run_outcomes", V.sql(V.ARTICLES, V.SOURCES, """
per AS (
  SELECT a.source_id || '-' || a.lang AS run_id, count(*) AS feed_items, count(f.article_id) AS fresh,
    count(*) FILTER (f.article_id IS NOT NULL AND regexp_matches(a.f_full, '(^|[^a-z0-9])onor($|[^a-z0-9])')) AS keyword_hits,
    count(*) FILTER (f.article_id IS NOT NULL AND regexp_matches(a.f_title, '(^|[^a-z0-9])onor($|[^a-z0-9])')) AS selected,
    count(*) FILTER (f.article_id IS NOT NULL AND l.quality IS NOT NULL) AS ai_success,
    count(*) FILTER (f.article_id IS NOT NULL AND l.quality = 0) AS ai_irrelevant,
    count(*) FILTER (f.article_id IS NOT NULL AND l.toxic = 1) AS threshold_rejected
  FROM articles a LEFT JOIN fresh f USING (article_id) LEFT JOIN labels l ON l.doc_id = a.article_id GROUP BY 1)""", select="""
SELECT run_id, CASE WHEN selected > 0 THEN 'complete' WHEN fresh = 0 THEN 'no_fresh_articles'
  WHEN keyword_hits > 0 AND ai_success > 0 AND ai_irrelevant = ai_success AND threshold_rejected = 0 THEN 'no_relevant_after_ai'
  WHEN keyword_hits = 0 THEN 'no_keyword_match' WHEN threshold_rejected > 0 THEN 'below_threshold'
  WHEN feed_items > fresh THEN 'no_new_after_dedup' ELSE 'no_keyword_match' END AS outcome,
  CASE WHEN feed_items > 3 * fresh OR threshold_rejected > 0 THEN 'degraded' ELSE 'complete' END AS status,
  nullif(concat_ws(' ', CASE WHEN fresh = 0 THEN 'nothing fresh' END, CASE WHEN keyword_hits = 0 THEN 'no hit' END,
    CASE WHEN threshold_rejected > 0 THEN 'low scores' END), '') AS warning
FROM per"""))
def run_outcomes(spark, sf_dir):
    """Outcome, status and warning of one run per (source, language)."""
    from ..functions import text

    df = V.dated_articles(spark, sf_dir).join(
        V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), "quality", "toxic"), "article_id", "left"
    )
    pattern = r"(?<![a-z0-9])onor(?![a-z0-9])"
    fresh = F.col("date_reason").isNull()
    per = df.select(
        F.concat_ws("-", "source_id", "lang").alias("run_id"), fresh.alias("ok"), "quality", "toxic",
        text.searchable_text("full_text").rlike(pattern).alias("in_full"), text.searchable_text("title").rlike(pattern).alias("in_title"),
    ).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("feed_items"), F.count_if("ok").alias("fresh"),
        F.count_if(F.col("ok") & F.col("in_full")).alias("keyword_hits"), F.count_if(F.col("ok") & F.col("in_title")).alias("selected"),
        F.count_if(F.col("ok") & F.col("quality").isNotNull()).alias("ai_success"),
        F.count_if(F.col("ok") & (F.col("quality") == 0)).alias("ai_irrelevant"),
        F.count_if(F.col("ok") & (F.col("toxic") == 1)).alias("threshold_rejected"),
    )
    per = per.withColumns({
        "semantic_reviewed": F.lit(0), "unique_candidates": F.col("keyword_hits"),
        "duplicates_skipped": F.col("feed_items") - F.col("fresh"),
    })
    return per.select(
        "run_id", funnel.outcome().alias("outcome"),
        funnel.run_status(F.col("feed_items") - 3 * F.col("fresh"), F.col("threshold_rejected") > 0, F.lit(False)).alias("status"),
        funnel.warning_text(
            F.when(F.col("fresh") == 0, "nothing fresh"), F.when(F.col("keyword_hits") == 0, "no hit"),
            F.when(F.col("threshold_rejected") > 0, "low scores"), F.when(F.col("threshold_rejected") > 0, "low scores"),
        ).alias("warning"),
    )
