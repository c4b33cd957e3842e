"""Fair ranking, budgets, duplicate removal and the whole digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import dedup, rank, review, score
from ..plans import digest as D
from ..session import cut
from . import views as V
from .matching import matches
from .registry import query

_BASE = (V.ARTICLES, V.TOPICS, V.SOURCES, V.MATCHES)
_FULL = (*_BASE, V.titled("verdict", "named"))


def _ranked(df):
    return D.fingerprint(df).withColumn("published_rank", dates.published_rank("published"))


def literal_pool(spark, sf_dir):
    return _ranked(matches(spark, sf_dir).where("matched"))


def semantic_pool(spark, sf_dir):
    pool = matches(spark, sf_dir, keep_unmatched=True)
    return _ranked(pool.where("size(matched_keywords) = 0 AND size(excluded_keywords) = 0"))


_TURNS = """
turns AS (
  SELECT *, row_number() OVER (PARTITION BY topic_id, source_id ORDER BY published DESC, canonical_url, article_id) AS turn
  FROM named WHERE {where}),
placed AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY turn, source_ord, source_id) AS position FROM turns)"""
_LITERAL, _SEMANTIC = "n_in > 0 AND n_ex = 0", "n_in = 0 AND n_ex = 0"


@query("round_robin", V.sql(*_FULL, _TURNS.format(where=_LITERAL), select="""
SELECT topic_id, position, article_id, source_id, turn FROM placed WHERE position <= 50"""))
def round_robin(spark, sf_dir):
    return rank.round_robin(
        literal_pool(spark, sf_dir), ["topic_id"], "source_id", "source_ord", rank.newest_first(), 50
    ).select("topic_id", "position", "article_id", "source_id", "turn")


@query("round_robin_all", V.sql(*_FULL, _TURNS.format(where=_SEMANTIC), select="""
SELECT topic_id, position, article_id, source_id FROM placed"""))
def round_robin_all(spark, sf_dir):
    # positions are made in two written steps, so only their keys go through
    keys = semantic_pool(spark, sf_dir).select("topic_id", "source_id", "source_ord", "published_rank", "canonical_url", "article_id")
    return rank.round_robin_all(
        keys, ["topic_id"], "source_id", "source_ord", rank.newest_first()
    ).select("topic_id", "position", "article_id", "source_id")


@query("shortlist", V.sql(*_FULL, _TURNS.format(where=_LITERAL), select="""
SELECT topic_id, count(*) AS candidates, max(position) AS last_position FROM placed
WHERE position <= least(100, greatest(20, 3 * article_limit)) GROUP BY topic_id"""))
def shortlist(spark, sf_dir):
    placed = rank.round_robin(
        literal_pool(spark, sf_dir), ["topic_id"], "source_id", "source_ord", rank.newest_first(), rank.SHORTLIST_MAX
    )
    return placed.where(F.col("position") <= rank.shortlist_limit(F.col("article_limit"))).groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.max("position").alias("last_position")
    )


@query("first_n_qualifying", V.sql(*_FULL, _TURNS.format(where=_LITERAL), """
taken AS (
  SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY position) AS review_rank FROM placed
  WHERE score >= least(threshold, greatest(40, threshold - 15)))""", select="""
SELECT topic_id, article_id, score, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, published DESC, article_id) AS rank
FROM taken WHERE review_rank <= article_limit"""))
def first_n_qualifying(spark, sf_dir):
    placed = rank.round_robin(
        literal_pool(spark, sf_dir), ["topic_id"], "source_id", "source_ord", rank.newest_first(), 100
    )
    return rank.first_n_qualifying(
        placed, ["topic_id"], [F.col("position")], F.col("lexical_score") >= F.col("supplement_threshold"),
        F.col("article_limit"),
        [F.col("lexical_score").desc(), F.col("published_rank").desc(), F.col("article_id")],
    ).select("topic_id", "article_id", F.col("lexical_score").alias("score"), "rank")


_BUDGET = """
rounds AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY published DESC, canonical_url, article_id) AS round
  FROM named WHERE n_in = 0 AND n_ex = 0),
budget AS (SELECT *, row_number() OVER (ORDER BY round, topic_ord) AS review_no FROM rounds)"""


@query("review_budget", V.sql(*_FULL, _BUDGET, select="""
SELECT topic_id, article_id, review_no, CASE WHEN review_no <= 20 THEN 'initial' ELSE 'additional' END AS stage
FROM budget WHERE review_no <= 35"""))
def review_budget(spark, sf_dir):
    pool = semantic_pool(spark, sf_dir).withColumn("run_id", F.lit("run"))
    return rank.review_budget(pool, "run_id", "topic_id", "topic_ord", rank.newest_first()).select(
        "topic_id", "article_id", "review_no", "stage"
    )


@query("budget_remainder", V.sql(*_FULL, _BUDGET, select="""
SELECT topic_id, count(*) AS candidates, count(*) FILTER (review_no <= 35) AS processed,
  count(*) FILTER (review_no > 35) AS remaining FROM budget GROUP BY topic_id"""))
def budget_remainder(spark, sf_dir):
    pool = semantic_pool(spark, sf_dir).withColumn("run_id", F.lit("run"))
    done = rank.review_budget(pool, "run_id", "topic_id", "topic_ord", rank.newest_first())
    return rank.unprocessed_remainder(pool, done, ["topic_id"])


@query("coupled_review_budget", V.sql(*_FULL, """
rounds AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY published DESC, canonical_url, article_id) AS round
  FROM named WHERE n_in = 0 AND n_ex = 0),
lists AS (SELECT topic_id, topic_ord, any_value(article_limit) // 3 AS need,
    list(struct_pack(id := article_id, counted := l.quality IS NOT NULL, fits := coalesce(l.quality, 0) = 1) ORDER BY round) AS queue
  FROM rounds LEFT JOIN labels l ON l.doc_id = article_id GROUP BY topic_id, topic_ord),
run AS (SELECT list(struct_pack(topic_id := topic_id, need := need, queue := queue) ORDER BY topic_ord) AS topics FROM lists),
walk AS (
  SELECT 0 AS step, 1 AS stage, 1 AS turn, 0 AS used, FALSE AS moved, list_transform(topics, lambda t: 0) AS place, list_transform(topics, lambda t: 0) AS got,
    NULL::VARCHAR AS topic_id, NULL::BIGINT AS article_id, NULL::INTEGER AS reviewed_in FROM run
  UNION ALL
  SELECT step + 1, CASE WHEN ends THEN stage + 1 ELSE stage END, CASE WHEN ends OR turn = n THEN 1 ELSE turn + 1 END,
    CASE WHEN ends THEN 0 ELSE used + uses END, NOT ends AND turn < n AND (moved OR can),
    list_transform(place, lambda x, i: CASE WHEN can AND i = turn THEN x + 1 ELSE x END),
    list_transform(got, lambda x, i: CASE WHEN can AND i = turn AND item.fits THEN x + 1 ELSE x END),
    CASE WHEN can THEN topic.topic_id END, CASE WHEN can THEN item.id END, CASE WHEN can THEN stage END
  FROM (SELECT *, used + uses >= budget OR (turn = n AND NOT moved AND NOT can) AS ends FROM (
    SELECT *, CASE WHEN can AND item.counted THEN 1 ELSE 0 END AS uses FROM (
      SELECT w.*, len(r.topics) AS n, r.topics[turn] AS topic, r.topics[turn].queue[place[turn] + 1] AS item, CASE stage WHEN 1 THEN 20 ELSE 15 END AS budget,
        got[turn] < r.topics[turn].need AND place[turn] < len(r.topics[turn].queue) AS can
      FROM walk w, run r WHERE stage <= 2))))""", select="""
SELECT topic_id, article_id, CASE reviewed_in WHEN 1 THEN 'initial' ELSE 'additional' END AS stage FROM walk
WHERE article_id IS NOT NULL""").replace("WITH ", "WITH RECURSIVE ", 1))
def coupled_review_budget(spark, sf_dir):
    """Topics share 20 and then 15 reviews, each until it is full; rows without a label use a turn but no review."""
    labels = V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), "quality")
    pool = semantic_pool(spark, sf_dir).withColumn("run_id", F.lit("run")).withColumn("row_id", F.concat_ws("|", "topic_id", F.col("article_id").cast("string")))
    pool = rank.distributed_position(pool.select("run_id", "topic_id", "topic_ord", "row_id", "article_id", "article_limit", "published_rank", "canonical_url"),
                                     ["topic_id"], rank.newest_first(), "review_pos")
    need = pool.groupBy("run_id", "topic_id").agg(F.floor(F.max("article_limit") / 3).cast("int").alias("missing"))

    def judge(rows):
        labelled = rows.join(labels, "article_id", "left")
        return labelled.withColumn("counted", F.col("quality").isNotNull()).withColumn("qualifies", F.coalesce(F.col("quality") == 1, F.lit(False)))

    return review.coupled_budget(cut(pool), judge, cut(need)).select("topic_id", "article_id", "stage")


@query("enrichment_budget", V.sql(*_FULL, _BUDGET, """
urls AS (SELECT canonical_url, min(round * 1000 + topic_ord) AS first_seen FROM budget GROUP BY 1)""", select="""
SELECT canonical_url, row_number() OVER (ORDER BY first_seen, canonical_url) AS fetch_no FROM urls
QUALIFY row_number() OVER (ORDER BY first_seen, canonical_url) <= 100"""))
def enrichment_budget(spark, sf_dir):
    pool = semantic_pool(spark, sf_dir).withColumn("run_id", F.lit("run"))
    # only the first 100 of a topic can be among the first 100 URLs of the run
    ordered = rank.top_per_group(pool, ["topic_id"], rank.newest_first(), rank.ENRICHMENT_MAX, "round")
    return rank.enrichment_budget(
        ordered, "run_id", "canonical_url", [F.col("round"), F.col("topic_ord")]
    ).select("canonical_url", "fetch_no")


@query("preference_order", V.sql(*_FULL, select="""
SELECT topic_id, article_id, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC,
  length(CASE WHEN full_text <> '' THEN full_text ELSE excerpt END) DESC, published DESC, canonical_url) AS pref
FROM named WHERE n_in > 0 AND n_ex = 0"""))
def preference_order(spark, sf_dir):
    return rank.distributed_position(literal_pool(spark, sf_dir), ["topic_id"], D.preference(), "pref").select(
        "topic_id", "article_id", "pref"
    )


@query("dedup_same_hash", V.sql(*_FULL, select="""
SELECT topic_id, article_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_id,
    CASE WHEN first_of_hash = 1 AND length(norm_title) >= 12 THEN norm_title || chr(10) || material ELSE 'row ' || article_id END
    ORDER BY score DESC, length(full_text) DESC, published DESC, canonical_url, topic_id || '|' || article_id) AS rn
  FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, canonical_url, norm_title
      ORDER BY score DESC, length(full_text) DESC, published DESC, canonical_url, topic_id || '|' || article_id) AS first_of_hash
    FROM named WHERE n_in > 0 AND n_ex = 0)) WHERE first_of_hash = 1 AND rn = 1"""))
def dedup_same_hash(spark, sf_dir):
    pool = literal_pool(spark, sf_dir).withColumn("content_hash", score.content_hash()).withColumn(
        "row_id", F.concat_ws("|", "topic_id", F.col("article_id").cast("string"))
    )
    return D.same_hash(pool).where("is_kept").select("topic_id", "article_id", F.col("lexical_score").alias("score"))


# -- against history: the last week before day -3 is the memory, later articles are new --
_SPLIT = f"TIMESTAMP '{V.AS_OF}' - INTERVAL 3 DAY"
_PAST = f"created_at < {_SPLIT} AND created_at >= {_SPLIT} - INTERVAL 7 DAY"


def new_and_past(spark, sf_dir):
    df = V.fingerprints(V.articles(spark, sf_dir).drop("full_text", "excerpt"))
    split = V.as_of() - F.expr("INTERVAL 3 DAYS")
    past = df.where((F.col("created_at") < split) & (F.col("created_at") >= split - F.expr("INTERVAL 7 DAYS")))
    return df.where(F.col("created_at") >= split), past


@query("recent_history", V.sql(V.ARTICLES, select=f"""
SELECT a.article_id, a.url, a.title FROM articles a JOIN (
  SELECT source_id || '-' || strftime(created_at, '%Y%m%d') AS run_id, count(*) % 4 AS state FROM articles GROUP BY 1) r
  ON r.run_id = a.source_id || '-' || strftime(a.created_at, '%Y%m%d')
WHERE a.created_at >= TIMESTAMP '{V.AS_OF}' - INTERVAL 7 DAY AND r.state IN (1, 2)"""))
def recent_history(spark, sf_dir):
    """Rows of the last seven days whose run ended complete or degraded."""
    from ..operators.history import recent_fingerprints

    df = V.articles(spark, sf_dir).withColumn(
        "run_id", F.concat_ws("-", "source_id", F.date_format("created_at", "yyyyMMdd"))
    )
    state = F.count(F.lit(1)) % 4
    runs = df.groupBy("run_id").agg(
        F.when(state == 1, "complete").when(state == 2, "degraded").when(state == 3, "failed").otherwise("cancelled").alias("status")
    )
    return recent_fingerprints(df, runs, V.as_of()).select("article_id", "url", "title")


@query("history_anti_join", V.sql(V.ARTICLES, V.TITLED, select=f"""
SELECT article_id FROM titled n WHERE created_at >= {_SPLIT} AND NOT EXISTS (
  SELECT 1 FROM titled p WHERE {_PAST.replace('created_at', 'p.created_at')} AND p.norm_title <> '' AND p.norm_title = n.norm_title
    AND p.material = n.material AND (length(n.norm_title) >= 12 OR p.canonical_url = n.canonical_url))"""))
def history_anti_join(spark, sf_dir):
    new, past = new_and_past(spark, sf_dir)
    return dedup.new_against_history(new, past).select("article_id")


@query("contained_titles", V.sql(V.ARTICLES, V.TITLED, select=f"""
SELECT n.article_id, CASE min(CASE WHEN p.canonical_url = n.canonical_url AND p.norm_title = n.norm_title THEN 1
    WHEN p.norm_title = n.norm_title THEN 2 ELSE 3 END) WHEN 1 THEN 'same_url_exact' WHEN 2 THEN 'cross_url_exact' ELSE 'cross_url_contained' END AS rule
FROM (SELECT * FROM titled WHERE created_at >= {_SPLIT}) n JOIN (SELECT * FROM titled WHERE {_PAST}) p
ON p.material = n.material AND p.norm_title <> '' AND n.norm_title <> ''
  AND ((p.canonical_url = n.canonical_url AND p.norm_title = n.norm_title)
    OR (length(n.norm_title) >= 12 AND length(p.norm_title) >= 12
      AND least(length(n.norm_title), length(p.norm_title)) >= 0.78 * greatest(length(n.norm_title), length(p.norm_title))
      AND (contains(p.norm_title, n.norm_title) OR contains(n.norm_title, p.norm_title))))
GROUP BY n.article_id"""))
def contained_titles(spark, sf_dir):
    new, past = new_and_past(spark, sf_dir)
    found = dedup.history_duplicates(
        new, past, "article_id", rules=("same_url_exact", "cross_url_exact", "cross_url_contained")
    )
    return found.select("article_id", "rule")


@query("near_duplicates")
def near_duplicates(spark, sf_dir):
    """Every rule against a second corpus: history plus the benchmark passages."""
    new, past = new_and_past(spark, sf_dir)
    bench = V.fingerprints(V.table(spark, sf_dir, "benchmark").select(
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 500).alias("title"),
        F.concat(F.lit("https://benchmark.example.org/"), F.col("item_id").cast("string")).alias("url"),
    ))
    cols = ["canonical_url", "norm_title", "material"]
    return dedup.history_duplicates(new, past.select(*cols).unionByName(bench.select(*cols)), "article_id")


@query("dedup_keep_first")
def dedup_keep_first(spark, sf_dir):
    """Greedy removal over all articles, newest first."""
    df = V.fingerprints(V.articles(spark, sf_dir).drop("full_text", "excerpt"))
    return dedup.keep_first(df, "article_id", [(-F.unix_micros("created_at")).alias("newest")]).select(
        "article_id", "is_kept", "duplicate_of"
    )


@query("dedup_keep_first_exact_contained", V.sql(V.ARTICLES, V.TITLED, """
ranked AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, article_id) AS n FROM titled),
before AS (SELECT b.n, list(a.n) AS earlier FROM ranked a JOIN ranked b ON a.n < b.n AND (
    (a.canonical_url = b.canonical_url AND a.norm_title = b.norm_title)
    OR (a.material = b.material AND length(a.norm_title) >= 12 AND length(b.norm_title) >= 12
      AND least(length(a.norm_title), length(b.norm_title)) >= 0.78 * greatest(length(a.norm_title), length(b.norm_title))
      AND (contains(a.norm_title, b.norm_title) OR contains(b.norm_title, a.norm_title)))) GROUP BY b.n),
walk AS (
  SELECT 0::BIGINT AS n, []::BIGINT[] AS kept, []::BIGINT[] AS causes
  UNION ALL
  SELECT r.n, CASE WHEN list_has_any(w.kept, coalesce(b.earlier, [])) THEN w.kept ELSE list_append(w.kept, r.n) END,
    list_intersect(w.kept, coalesce(b.earlier, []))
  FROM walk w JOIN ranked r ON r.n = w.n + 1 LEFT JOIN before b ON b.n = r.n)""", select="""
SELECT r.article_id, len(w.causes) = 0 AS is_kept, d.article_id AS duplicate_of
FROM ranked r JOIN walk w USING (n) LEFT JOIN ranked d ON d.n = list_min(w.causes)""").replace("WITH ", "WITH RECURSIVE ", 1))
def dedup_keep_first_exact_contained(spark, sf_dir):
    """The greedy pass with the rules that SQL can say; the similarity rules are tested on fixtures."""
    df = V.fingerprints(V.articles(spark, sf_dir).drop("full_text", "excerpt"))
    return dedup.keep_first(
        df, "article_id", [(-F.unix_micros("created_at")).alias("newest")],
        rules=("same_url_exact", "cross_url_exact", "cross_url_contained"),
    ).select("article_id", "is_kept", "duplicate_of")


# -- whole runs ---------------------------------------------------------------
@query("topic_digest", V.sql(
    V.ARTICLES.replace("INTERVAL 7 DAY", "INTERVAL 3 DAY"), V.TOPICS, V.SOURCES, V.MATCHES, V.titled("verdict", "named"), V.titled("articles", "past_all"), f"""
newer AS (
  SELECT n.* FROM named n WHERE n_in > 0 AND n_ex = 0 AND topic_id = 't1' AND NOT EXISTS (
    SELECT 1 FROM past_all p WHERE {_PAST.replace('created_at', 'p.created_at')} AND p.norm_title <> '' AND p.norm_title = n.norm_title
      AND p.material = n.material AND (length(n.norm_title) >= 12 OR p.canonical_url = n.canonical_url))),
hashed AS (SELECT *, row_number() OVER (PARTITION BY canonical_url, norm_title
    ORDER BY score DESC, length(full_text) DESC, published DESC, canonical_url, article_id) AS first_of_hash FROM newer),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY
    CASE WHEN first_of_hash = 1 AND length(norm_title) >= 12 THEN norm_title || chr(10) || material ELSE 'row ' || article_id END
    ORDER BY score DESC, length(full_text) DESC, published DESC, canonical_url, article_id) AS rn FROM hashed)
  WHERE first_of_hash = 1 AND rn = 1),
turns AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published DESC, canonical_url, article_id) AS turn FROM uniq),
placed AS (SELECT *, row_number() OVER (ORDER BY turn, source_ord, source_id) AS position FROM turns),
taken AS (SELECT *, row_number() OVER (ORDER BY position) AS review_rank FROM placed
  WHERE position <= least(100, greatest(20, 3 * article_limit)) AND score >= least(threshold, greatest(40, threshold - 15)))""", select="""
SELECT row_number() OVER (ORDER BY score DESC, published DESC, position) AS rank, article_id, title, score, words AS keywords,
  CASE WHEN score >= threshold THEN 'core' ELSE 'supplement' END AS tier
FROM taken WHERE review_rank <= article_limit"""))
def topic_digest(spark, sf_dir):
    """A run for one topic, exact duplicate rules, three-day window, seven-day memory."""
    _, past = new_and_past(spark, sf_dir)
    run = D.digest(
        V.articles(spark, sf_dir), V.topics(spark).where("topic_id = 't1'"), V.sources(spark, sf_dir), past,
        V.as_of(), days=3, fuzzy=False,
    )
    return run.selected.select(
        "rank", "article_id", "title", "score", F.array_join("matched_keywords", "|").alias("keywords"),
        F.col("selection_tier").alias("tier"),
    )


def _full_run(spark, sf_dir):
    _, past = new_and_past(spark, sf_dir)
    return D.digest(
        V.articles(spark, sf_dir), V.topics(spark), V.sources(spark, sf_dir), past, V.as_of(), days=3, fuzzy=True
    )


@query("fair_selection")
def fair_selection(spark, sf_dir):
    """All topics take turns; no topic shows what another one already shows."""
    return _full_run(spark, sf_dir).selected.select("topic_id", "rank", "article_id", "score", "selection_tier")


def _scored_run(spark, sf_dir):
    """All topics, exact duplicate rules, and a scorer that is asked while topics are short."""
    from .intake import _sample_scorer

    _, past = new_and_past(spark, sf_dir)
    return D.digest(
        V.articles(spark, sf_dir), V.topics(spark), V.sources(spark, sf_dir), past, V.as_of(), days=3, fuzzy=False, scorer=_sample_scorer, model="sample"
    )


@query("digest_with_scorer")
def digest_with_scorer(spark, sf_dir):
    """Selection of a demand-driven run: candidates with a keyword first, then the shared reviews of the others."""
    return _scored_run(spark, sf_dir).selected.select("topic_id", "rank", "article_id", "score", "selection_tier", "stage", "analysis_mode")


@query("digest_scorer_funnel")
def digest_scorer_funnel(spark, sf_dir):
    run = _scored_run(spark, sf_dir)
    return run.counts.join(run.outcome.select("run_id", "outcome"), "run_id")


@query("digest_funnel")
def digest_funnel(spark, sf_dir):
    run = _full_run(spark, sf_dir)
    return run.counts.join(run.outcome.select("run_id", "outcome"), "run_id")
