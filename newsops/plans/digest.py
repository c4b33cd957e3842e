"""A whole curation run as one chain of DataFrame operators.

feed items -> freshness -> topic match -> history and run duplicates -> shortlist ->
score -> review and selection -> counters and outcome

With a scorer or page bodies the run is demand-driven: texts are completed and scores asked for only where
a topic is still short of articles, and articles without a keyword are reviewed after the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dates, text, urls
from ..operators import dedup, funnel, match, rank, review, score
from ..session import cut

# Defaults of a run.
DEFAULT_THRESHOLD, DEFAULT_LIMIT, DEFAULT_WINDOW = 60, 20, 7


@dataclass
class Digest:
    """Frames of one run.  ``selected`` and ``events`` are durable; counts derive from them."""

    selected: DataFrame
    rejected: DataFrame
    counts: DataFrame
    outcome: DataFrame
    cache_rows: DataFrame | None = None         # new scores, to be added to the score cache


def fingerprint(df: DataFrame) -> DataFrame:
    folded = text.folded_title("title")
    return (
        df.withColumn("_folded", folded)
        .withColumn("canonical_url", urls.canonical_url(urls.folded_url("url")))
        .withColumn("norm_title", text.normalize_title("_folded"))
        .withColumn("material", text.material_key(text.material_signature("_folded")))
        .drop("_folded")
    )


def topic_scope(topics: DataFrame, sources: DataFrame) -> DataFrame:
    """(topic_id, topic_ord, source_id, source_ord, thresholds, limit) of active pairs."""
    live = sources.where(F.col("enabled") & ~F.col("archived")).select("source_id", "source_ord")
    open_topics = topics.select("topic_id", F.explode_outer(
        F.when(F.size("source_ids") > 0, F.col("source_ids"))).alias("only"))
    named = open_topics.where("only IS NOT NULL").select("topic_id", F.col("only").alias("source_id"))
    # topic ids are configuration, read once on the driver
    every = [r.topic_id for r in open_topics.where("only IS NULL").select("topic_id").collect()]
    everywhere = F.explode(F.array(*[F.lit(t) for t in every]).cast("array<string>"))
    return live.withColumn("topic_id", everywhere).unionByName(
        named.join(live, "source_id").select("source_id", "source_ord", "topic_id")
    )


def settings(topics: DataFrame, run_limit: int | None = None) -> DataFrame:
    threshold = score.effective("threshold", F.lit(DEFAULT_THRESHOLD))
    limit = score.effective(F.lit(run_limit).cast("int"), "article_limit", F.lit(DEFAULT_LIMIT))
    return topics.select(
        "topic_id", "topic_ord", "name", threshold.alias("threshold"),
        score.supplement_threshold(threshold).alias("supplement_threshold"),
        limit.alias("article_limit"),
    )


def body() -> Column:
    return F.when(F.coalesce(F.col("full_text"), F.lit("")) != "", F.col("full_text")).otherwise(F.col("excerpt"))


def preference() -> list[Column]:
    """Which of several duplicates stays: score, text length, newest, URL."""
    return [
        (-F.col("lexical_score")).alias("by_score"), (-F.length(body())).alias("by_length"),
        (-F.col("published_rank")).alias("by_date"), F.col("canonical_url").alias("by_url"),
    ]


def by_length() -> list[Column]:
    """:func:`preference` of rows without their texts, which carry ``body_length``."""
    return [preference()[0], (-F.col("body_length")).alias("by_length"), *preference()[2:]]


def digest(
    articles: DataFrame, topics: DataFrame, sources: DataFrame, history: DataFrame | None, as_of: Column,
    run_id: str = "run", days: int | None = DEFAULT_WINDOW, run_limit: int | None = None,
    fuzzy: bool = True, page_bodies: DataFrame | None = None, scorer: score.Scorer | None = None,
    cache: DataFrame | None = None, model: str = "", semantic: bool = True, max_calls: int = score.MAX_CALLS_PER_RUN,
) -> Digest:
    """A run over any DataFrame with the feed-article columns plus ``article_id``.

    ``history`` holds canonical_url, norm_title and material of recent stored rows.
    ``fuzzy=False`` limits duplicate removal to the exact rules.  Without ``scorer`` and ``page_bodies``
    (canonical_url, body) the keyword score decides; see :func:`demand_digest` for the rest.
    """
    if scorer is not None or page_bodies is not None:
        return demand_digest(
            articles, topics, sources, history, as_of, run_id, days, run_limit, fuzzy, page_bodies, scorer, cache, model, semantic, max_calls
        )
    active = match.active_topics(topics)
    config = settings(active, run_limit)
    scope = topic_scope(active, sources)
    live = sources.where(F.col("enabled") & ~F.col("archived")).select("source_id", "source_ord")

    dated = (
        articles.join(live, "source_id")
        .withColumn("published", dates.published_timestamp("published_at"))
        .withColumn("date_reason", dates.date_reason("published_at", "published", as_of, days))
        .withColumn("run_id", F.lit(run_id))
    )
    fresh = dated.where("date_reason IS NULL").withColumn("published_rank", dates.published_rank("published"))
    items = funnel.item_counts(dated.select("run_id", "source_id", "date_reason"), scope.select("topic_id", "source_id"))

    hits = match.match_topics(fresh, active).withColumn("lexical_score", match.keyword_score())
    whole = cut(fingerprint(hits).withColumn("content_hash", score.content_hash()).withColumn("body_length", F.length(body())).withColumn(
        "row_id", F.concat_ws("|", "topic_id", F.col("article_id").cast("string"))))
    texts = whole.select("row_id", "excerpt", "full_text")     # joined to the selected rows; all others stay narrow
    hits = whole.drop("excerpt", "full_text")
    excluded = hits.where(F.size("excluded_keywords") > 0)
    matched = hits.where("matched")

    old = matched.limit(0).select("row_id")
    if history is not None:
        if fuzzy:
            old = dedup.history_duplicates(matched, history, "row_id").select("row_id")
        else:
            new = dedup.new_against_history(matched, history)
            old = matched.join(new.select("row_id"), "row_id", "left_anti").select("row_id")
        old = cut(old)
    candidates = matched.join(old, "row_id", "left_anti")
    if fuzzy:
        judged = dedup.keep_first(candidates, "row_id", by_length(), group=["topic_id"])
    else:
        judged = same_hash(candidates, by_length())
    judged = cut(judged)
    kept = judged.where("is_kept").join(config, "topic_id")

    order = rank.newest_first()
    shortlist = rank.round_robin(kept, ["topic_id"], "source_id", "source_ord", order, rank.SHORTLIST_MAX, "review_pos")
    shortlist = shortlist.where(F.col("review_pos") <= rank.shortlist_limit(F.col("article_limit")))
    scored = cut(
        shortlist.withColumn("score", F.col("lexical_score"))
        .withColumn("qualifies", F.col("score") >= F.col("supplement_threshold"))
    )
    verdict = cut(rank.select_for_run(scored))
    chosen = scored.join(verdict, ["run_id", "topic_id", "article_id"])
    selected = chosen.where("status = 'selected'").drop("body_length").withColumn(
        "selection_tier", score.selection_tier(F.col("score"), F.col("threshold"))
    )
    reviewed_low = chosen.where("status = 'reviewed' AND NOT qualifies")
    repeated = chosen.where("status = 'run_duplicate'")

    key = ["run_id", "topic_id", "source_id", "article_id"]
    run_copies = judged.where("NOT is_kept").select(*key).unionByName(repeated.select(*key))
    history_copies = matched.join(old, "row_id", "left_semi").select(*key)
    rejected = (
        excluded.select(*key, F.lit("exclusion_rejected").alias("reason"))
        .unionByName(history_copies.withColumn("reason", F.lit("history_duplicates")))
        .unionByName(run_copies.withColumn("reason", F.lit("run_duplicates")))
        .unionByName(reviewed_low.select(*key, F.lit("threshold_rejected").alias("reason")))
    )
    dims = ["run_id", "topic_id", "source_id"]
    events = rejected.select(*dims, F.col("reason").alias("counter"))
    for frame, name in (
        (hits.where("matched"), "keyword_hits"), (history_copies.unionByName(run_copies), "duplicates_skipped"),
        (judged.where("is_kept"), "unique_candidates"), (chosen, "processed"), (chosen, "reason_direct_match"),
        (selected, "selected"), (selected.where("selection_tier = 'core'"), "core_selected"),
        (selected.where("selection_tier = 'supplement'"), "supplement_selected"),
    ):
        events = events.unionByName(frame.select(*dims, F.lit(name).alias("counter")))
    counts = funnel.with_aliases(items.unionByName(funnel.count_events(events)))
    totals = funnel.run_totals(counts, funnel.OUTCOME_INPUTS)
    return Digest(
        selected=selected.join(texts, "row_id"), rejected=rejected, counts=counts,
        outcome=totals.select("run_id", funnel.outcome().alias("outcome"), *funnel.OUTCOME_INPUTS),
    )


def same_hash(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Mark the preferred row per topic: first of equal (URL, title), then of equal long titles and material.

    The first step looks at the content hash alone, whatever the material, as :func:`dedup.keep_first`
    does; a row that falls there does not count in the second step.
    """
    pref = [*(order or preference()), F.col("row_id")]
    by_hash = F.row_number().over(W.partitionBy("topic_id", "content_hash").orderBy(*pref))
    marked = df.withColumn("_first", by_hash == 1)
    identity = F.when(
        F.col("_first") & (F.length("norm_title") >= dedup.MIN_CROSS_URL_TITLE), F.concat_ws("\n", "norm_title", "material")
    ).otherwise(F.concat(F.lit("\n\n"), "row_id"))
    by_title = F.row_number().over(W.partitionBy("topic_id", "_identity").orderBy(*pref))
    return marked.withColumn("_identity", identity).withColumn(
        "is_kept", F.col("_first") & (by_title == 1)
    ).drop("_first", "_identity")


# ---------------------------------------------------------------------------
# Demand-driven runs
# ---------------------------------------------------------------------------
_EVIDENCE = ["matched", "matched_keywords", "matched_fields", "keyword_fields", "excluded_keywords", "excluded_fields"]
_TEXTS = ["title", "excerpt", "full_text"]
_DIMS = ["run_id", "topic_id", "source_id"]


class Pages:
    """Completes missing full texts from pages and matches those rows again.

    A URL is tried once in a run, whatever the number of topics, and at most ``limit`` URLs are tried.  What is
    remembered of a run is those URLs and the ones that came too late.
    """

    def __init__(self, bodies: DataFrame | None, topics: DataFrame, limit: int = rank.ENRICHMENT_MAX):
        self.bodies = None if bodies is None else bodies.groupBy("canonical_url").agg(F.max("body").alias("body"))
        self.topics, self.left, self.tried, self.events, self.topic_events = topics, limit, None, [], []

    def __call__(self, rows: DataFrame) -> DataFrame:
        if self.bodies is None:
            return rows.withColumn("dropped", F.lit(False))
        empty = F.coalesce(F.col("full_text"), F.lit("")) == ""
        wanted = rows.where(empty).groupBy("run_id", "canonical_url").agg(F.min(F.struct("review_pos", "topic_ord", "row_id")).alias("first"))
        if self.tried is not None:
            wanted = wanted.join(self.tried.select("canonical_url"), "canonical_url", "left_anti")
        order = W.partitionBy("run_id").orderBy("first", "canonical_url")
        new = wanted.withColumn("attempted", F.row_number().over(order) <= self.left).join(self.bodies, "canonical_url", "left")
        new = cut(new.select("canonical_url", "attempted", F.when(F.col("attempted"), F.coalesce("body", F.lit(""))).otherwise("").alias("body"),
                             F.col("first.row_id").alias("by")))
        self.left -= new.where("attempted").count()
        known = new.withColumn("fresh", F.lit(True))
        if self.tried is not None:
            known = known.unionByName(self.tried.withColumn("fresh", F.lit(False)))
        self.tried = cut(known.drop("fresh"))
        looked = cut(rows.join(known, "canonical_url", "left").withColumn("_empty", empty).withColumn(
            "full_text", F.when(F.col("_empty"), F.coalesce("body", F.lit(""))).otherwise(F.col("full_text"))))
        first = F.col("fresh") & (F.col("by") == F.col("row_id"))
        got = F.when(F.trim("full_text") != "", "fulltext_success").otherwise("fulltext_failure")
        due = looked.where("_empty")
        for frame, counter in (
            (due.where(first & F.col("attempted")), F.lit("fulltext_fetches")), (due.where(first & F.col("attempted")), got),
            (due.where(first & ~F.col("attempted")), F.lit("fulltext_recovery_budget_exhausted")),
        ):
            self.events.append(frame.select(*_DIMS, counter.alias("counter")))
        self.topic_events.append(due.where(~first & F.col("attempted")).select("run_id", "topic_id", got.alias("counter")))

        again = F.col("_empty") & (F.col("full_text") != "")
        changed = looked.where(again).drop(*_EVIDENCE, "lexical_score").withColumnRenamed("topic_id", "_topic")
        renewed = match.match_topics(changed, self.topics, keep_unmatched=True).where("topic_id = _topic").drop("_topic").withColumn(
            "lexical_score", F.when(F.col("matched"), match.keyword_score()).otherwise(F.lit(0)))
        old = looked.where(~again).withColumn("_new", F.lit(False))
        done = cut(old.unionByName(renewed.withColumn("_new", F.col("matched") & ~F.col("literal"))).withColumn(
            "dropped", F.size("excluded_keywords") > 0))
        for name in ("exclusion_rejected", "reason_exclusion_match"):
            self.events.append(done.where("dropped").select(*_DIMS, F.lit(name).alias("counter")))
        for name in ("keyword_hits", "fulltext_keyword_hits"):
            self.events.append(done.where("_new").select(*_DIMS, F.lit(name).alias("counter")))
        return done.drop("_new", "_empty", "fresh", "attempted", "body", "by")


class Scores:
    """Scores reviewed rows: cached, else asked of the scorer while the run has calls left, else by the rule."""

    def __init__(self, scorer: score.Scorer | None, cache: DataFrame | None, as_of: Column, model: str, topics: DataFrame, max_calls: int):
        self.scorer, self.cache, self.as_of, self.model, self.left = scorer, cache, as_of, model, max_calls
        self.config = topics.select("topic_id", score.topic_config().alias("_config"))
        self.answers: list[DataFrame] = []

    def __call__(self, rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        if self.scorer is None:
            scored = rows.withColumns({
                "score": F.when(F.col("matched"), F.col("lexical_score")).cast("int"), "relevant": F.col("matched"),
                "reason": F.when(F.col("matched"), F.lit("direct_match")), "analysis_mode": F.lit("rules"), "cache_hit": F.lit(False),
                "ai_status": F.lit(None).cast("string"),
            })
        else:
            keyed = rows.join(self.config, "topic_id").withColumn(
                "cache_key", score.cache_key(score.analysis_fingerprint(), F.col("_config"), F.lit(self.model))
            ).withColumn("literal_match", F.col("matched")).drop("_config")
            cache = self.cache if self.cache is not None else spark.createDataFrame(
                [], "cache_key string, analysis string, created_at timestamp, expires_at timestamp")
            asked = cut(score.score_with_cache(
                keyed, cache, self.as_of, self.scorer, order=[F.col("review_pos"), F.col("topic_ord")], cap=self.left, keep_answers=True))
            self.left -= asked.where("ai_status IN ('success', 'invalid', 'failure')").select("cache_key").distinct().count()
            self.answers.append(asked.where("ai_status = 'success'").select("cache_key", "fresh_score").dropDuplicates(["cache_key"]))
            scored = asked.drop("cache_key", "literal_match", "fresh_score").withColumn("score", F.col("score").cast("int"))
        counted = F.col("cache_hit") | F.coalesce(F.col("ai_status") != "over_cap", F.lit(False))
        fits = F.coalesce(F.col("relevant") & (F.col("score") >= F.col("supplement_threshold")), F.lit(False))
        return scored.withColumn("counted", counted).withColumn("qualifies", fits)


def demand_digest(
    articles: DataFrame, topics: DataFrame, sources: DataFrame, history: DataFrame | None, as_of: Column, run_id: str, days: int | None,
    run_limit: int | None, fuzzy: bool, page_bodies: DataFrame | None, scorer: score.Scorer | None, cache: DataFrame | None, model: str,
    semantic: bool, max_calls: int,
) -> Digest:
    """A run that completes texts and asks for scores on demand (:func:`review.review_run`).

    Fingerprints are made once for each article; the pairs of article and topic carry ids, evidence and
    lengths, and texts are joined to the rows under review only.
    """
    active = match.active_topics(topics)
    config = cut(settings(active, run_limit))
    scope = topic_scope(active, sources)
    live = sources.where(F.col("enabled") & ~F.col("archived")).select("source_id", "source_ord")
    dated = (
        articles.join(live, "source_id")
        .withColumn("published", dates.published_timestamp("published_at"))
        .withColumn("date_reason", dates.date_reason("published_at", "published", as_of, days))
        .withColumn("run_id", F.lit(run_id))
    )
    items = funnel.item_counts(dated.select("run_id", "source_id", "date_reason"), scope.select("topic_id", "source_id"))
    fresh = cut(fingerprint(dated.where("date_reason IS NULL").withColumn("published_rank", dates.published_rank("published"))).withColumn(
        "content_hash", score.content_hash()).withColumn("body_length", F.length(body())))
    texts = fresh.select("article_id", *_TEXTS, "published_at")

    narrow = [c for c in fresh.columns if c not in ("title", "excerpt", "full_text", "published_at", "date_reason", "published")]
    hits = cut(match.match_topics(fresh, active, keep_unmatched=semantic).withColumn(
        "lexical_score", F.when(F.col("matched"), match.keyword_score()).otherwise(F.lit(0))
    ).select(*narrow, "topic_id", *_EVIDENCE, "lexical_score").withColumn("row_id", F.concat_ws("|", "topic_id", F.col("article_id").cast("string"))))
    excluded = hits.where(F.size("excluded_keywords") > 0)
    free = hits.where(F.size("excluded_keywords") == 0)

    old = fresh.limit(0).select("article_id")
    if history is not None:                               # whether an article is known does not depend on the topic
        if fuzzy:
            old = dedup.history_duplicates(fresh, history, "article_id").select("article_id")
        else:
            old = fresh.select("article_id").join(dedup.new_against_history(fresh, history).select("article_id"), "article_id", "left_anti")
        old = cut(old)
    known = free.join(old, "article_id", "left_semi")
    fit = free.join(old, "article_id", "left_anti")

    def unique(rows: DataFrame, order: list[Column]) -> DataFrame:
        if fuzzy:
            return cut(dedup.keep_first(rows, "row_id", order, group=["topic_id"]))
        return cut(same_hash(rows, order))

    direct = unique(fit.where("matched"), by_length())
    latest = rank.newest_first()
    shortlist = rank.round_robin(direct.where("is_kept").join(config, "topic_id"), ["topic_id"], "source_id", "source_ord", latest, rank.SHORTLIST_MAX, "review_pos")
    shortlist = cut(shortlist.where(F.col("review_pos") <= rank.shortlist_limit(F.col("article_limit"))))
    judged = [direct]
    pool = None
    if semantic:
        placed = rank.round_robin_all(fit.where("NOT matched"), ["topic_id"], "source_id", "source_ord", latest, "review_pos")
        other = unique(cut(placed.drop("turn")), [F.col("review_pos").alias("by_place")])
        judged.append(other.drop("review_pos"))
        pool = cut(other.where("is_kept").withColumn("turn", F.lit(0)).join(config, "topic_id").select(*shortlist.columns))

    pages, scores = Pages(page_bodies, active), Scores(scorer, cache, as_of, model, active, max_calls)
    rules = dedup.ALL_RULES if fuzzy else ("same_url_exact", "cross_url_exact")

    def prepare(rows: DataFrame) -> DataFrame:
        return pages(rows.withColumn("literal", F.col("matched")).join(texts, "article_id"))

    done = review.review_run(
        shortlist, cut(config.select(F.lit(run_id).alias("run_id"), "topic_id", "topic_ord", "article_limit")),
        scores if page_bodies is not None else lambda rows: scores(rows.withColumn("literal", F.col("matched")).join(texts, "article_id")),
        lambda rows: rank.cross_topic_twins(rows, "run_id", "row_id", rules), pool, prepare if page_bodies is not None else None,
        (lambda: pages.left) if page_bodies is not None else None,
        *((rank.REVIEW_INITIAL, rank.REVIEW_ADDITIONAL) if scorer is not None else (0, 0)),
    )
    return _told(done, items, hits, excluded, known, judged, pages, scores, as_of)


def _told(
    done: review.Review, items: DataFrame, hits: DataFrame, excluded: DataFrame, known: DataFrame, judged: list[DataFrame], pages: Pages,
    scores: Scores, as_of: Column,
) -> Digest:
    """The frames of a demand-driven run out of what its steps kept and counted."""
    seen, key = done.seen, [*_DIMS, "article_id"]
    selected = seen.where("status = 'selected'").withColumn("selection_tier", score.selection_tier(F.col("score"), F.col("threshold")))
    copies = judged[0].where("NOT is_kept").select(*key)
    uniques = judged[0].where("is_kept").select(*_DIMS)
    for more in judged[1:]:
        copies = copies.unionByName(more.where("NOT is_kept").select(*key))
        uniques = uniques.unionByName(more.where("is_kept").select(*_DIMS))
    copies = copies.unionByName(seen.where("status = 'run_duplicate'").select(*key))
    answered = F.col("cache_hit") | (F.col("ai_status") == "success")
    answered = F.coalesce(answered, F.lit(False))
    vetoed = seen.where(answered & ~F.col("relevant"))
    low = seen.where(F.coalesce(F.col("relevant"), F.lit(False)) & (F.col("score") < F.col("supplement_threshold")))
    rejected = None
    for frame, reason in (
        (excluded, "exclusion_rejected"), (done.dropped, "exclusion_rejected"), (known, "history_duplicates"), (copies, "run_duplicates"),
        (vetoed, "ai_irrelevant"), (low, "threshold_rejected"),
    ):
        part = frame.select(*key, F.lit(reason).alias("reason"))
        rejected = part if rejected is None else rejected.unionByName(part)
    asked, reviewed = seen.where("counted"), seen.where("counted AND NOT matched")
    events = seen.where(F.col("reason").isNotNull() & (answered | F.col("matched"))).select(*_DIMS, funnel.reason_counter(F.col("reason")).alias("counter"))
    frames = [
        (excluded, "exclusion_rejected"), (hits.where("matched"), "keyword_hits"), (known, "history_duplicates"), (copies, "run_duplicates"),
        (known.select(*key).unionByName(copies), "duplicates_skipped"), (uniques, "unique_candidates"), (low, "threshold_rejected"),
        (seen.where("stage IN ('direct', 'fulltext')"), "processed"), (done.dropped, "processed"), (asked, "ai_candidates"),
        (seen.where(answered), "ai_success"), (seen.where("cache_hit"), "ai_cache_hits"), (vetoed, "ai_irrelevant"),
        (seen.where("ai_status IN ('success', 'invalid', 'failure')"), "ai_requests"), (seen.where("ai_status IN ('invalid', 'failure')"), "ai_failure"),
        (reviewed, "semantic_reviewed"), (reviewed.where("stage = 'initial'"), "semantic_initial_reviewed"),
        (reviewed.where("stage = 'additional'"), "semantic_additional_reviewed"), (selected, "selected"),
        (selected.where("selection_tier = 'core'"), "core_selected"), (selected.where("selection_tier = 'supplement'"), "supplement_selected"),
    ]
    if done.prepared is not None:
        frames += [(done.prepared, "processed"), (done.prepared, "semantic_candidates")]
    for frame, name in frames:
        events = events.unionByName(frame.select(*_DIMS, F.lit(name).alias("counter")))
    for frame in pages.events:
        events = events.unionByName(frame)
    counts = items.unionByName(funnel.count_events(events))
    by_topic = [x.select("run_id", F.col("topic_id").alias("scope_id"), "counter", F.lit(1).cast("bigint").alias("value")) for x in pages.topic_events]
    if done.prepared is not None and scores.scorer is not None:
        by_topic.append(_left_over(done, seen))
    for frame in by_topic:
        counts = counts.unionByName(frame.select("run_id", F.lit("topic").alias("scope"), "scope_id", "counter", "value"))
    counts = cut(funnel.with_aliases(counts.groupBy("run_id", "scope", "scope_id", "counter").agg(F.sum("value").alias("value"))))
    fresh = None
    for part in scores.answers:
        fresh = part if fresh is None else fresh.unionByName(part)
    return Digest(
        selected=selected, rejected=rejected, counts=counts,
        outcome=funnel.run_totals(counts, funnel.OUTCOME_INPUTS).select("run_id", funnel.outcome().alias("outcome"), *funnel.OUTCOME_INPUTS),
        cache_rows=None if fresh is None else score.put_cache(fresh, as_of),
    )


def _left_over(done: review.Review, seen: DataFrame) -> DataFrame:
    """Topics that are still short with candidates left when both review budgets are used up."""
    budgets = seen.where("stage IN ('initial', 'additional')")
    used = budgets.where("counted").groupBy("run_id").agg(F.count(F.lit(1)).alias("used")).where(
        F.col("used") >= rank.REVIEW_INITIAL + rank.REVIEW_ADDITIONAL)
    left = done.prepared.join(budgets.select("row_id"), "row_id", "left_anti").join(done.short, review.TOPIC, "left_semi")
    return left.join(used, "run_id", "left_semi").groupBy("run_id", F.col("topic_id").alias("scope_id")).agg(
        F.lit("semantic_budget_exhausted").alias("counter"), F.count(F.lit(1)).alias("value"))
