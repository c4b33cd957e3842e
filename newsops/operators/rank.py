"""Fair ranking: round robin over sources, budgets, first-N-qualifying, fair selection.

Every limited form filters on ``row_number() <= n`` right above its window, which Spark
executes as a per-task group limit before the shuffle: a hot topic or source sends at most
``n`` rows per task.  The unlimited form spreads one group over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut
from .dedup import ALL_RULES, duplicate_edges

# Budgets of one run.
SHORTLIST_MAX, SHORTLIST_MIN, SHORTLIST_FACTOR = 100, 20, 3
REVIEW_INITIAL, REVIEW_ADDITIONAL = 20, 15
ENRICHMENT_MAX = 100


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n, name: str = "position") -> DataFrame:
    """First ``n`` rows per group.  ``n`` may be a number or a per-row limit column.

    A per-row limit may be 100 at most, which is the group limit that applies before the shuffle; a
    greater one is an error.
    """
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    if isinstance(n, int):
        return ranked.where(F.col(name) <= n)
    allowed = F.when(n > SHORTLIST_MAX, F.raise_error(F.lit(f"a row limit is at most {SHORTLIST_MAX}")).cast("boolean"))
    return ranked.where(F.col(name) <= SHORTLIST_MAX).where(allowed.otherwise(F.col(name) <= n))


def newest_first(published="published_rank", url="canonical_url", id_col="article_id") -> list[Column]:
    return [F.col(published).desc(), F.col(url), F.col(id_col)]


def round_robin(
    df: DataFrame, group: list[str], source: str, source_ord: str, order: list[Column], limit: int,
    name: str = "position",
) -> DataFrame:
    """Take sources in turn, each giving its next best row, up to ``limit`` rows per group."""
    turns = top_per_group(df, [*group, source], order, limit, "turn")
    return top_per_group(turns, group, [F.col("turn"), F.col(source_ord), F.col(source)], limit, name)


def distributed_position(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "position"
) -> DataFrame:
    """``row_number`` per group without putting a whole group into one task.

    Rows are range-partitioned on (keys, order) and pinned by a checkpoint; each partition
    ranks its own slice and adds the sizes of the group's earlier slices.
    """
    placed = cut(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_slice", F.spark_partition_id())
    )
    sizes = placed.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn(
        "_before",
        F.coalesce(F.sum("_n").over(
            W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
        ), F.lit(0)),
    ).drop("_n")
    local = placed.withColumn(
        "_local", F.row_number().over(W.partitionBy("_slice", *keys).orderBy(*order))
    )
    return (
        local.join(before, [*keys, "_slice"])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_slice", "_before", "_local")
    )


def round_robin_all(
    df: DataFrame, group: list[str], source: str, source_ord: str, order: list[Column],
    name: str = "position",
) -> DataFrame:
    """Round robin that keeps every row, equal identities included."""
    turns = distributed_position(df, [*group, source], order, "turn")
    return distributed_position(turns, group, [F.col("turn"), F.col(source_ord), F.col(source)], name)


def shortlist_limit(limit) -> Column:
    return F.least(F.lit(SHORTLIST_MAX), F.greatest(F.lit(SHORTLIST_MIN), F.lit(SHORTLIST_FACTOR) * limit))


def first_n_qualifying(
    df: DataFrame, keys: list[str], review_order: list[Column], qualifies: Column, limit,
    final_order: list[Column],
) -> DataFrame:
    """Review rows in order, stop at ``limit`` qualifying ones, then rank those.

    Exact for groups that share no duplicates; :func:`select_for_run` covers the rest.
    """
    taken = top_per_group(df.where(qualifies), keys, review_order, limit, "review_rank")
    return taken.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*final_order)))


def review_budget(
    df: DataFrame, run: str, topic: str, topic_ord: str, order: list[Column],
    initial: int = REVIEW_INITIAL, additional: int = REVIEW_ADDITIONAL,
) -> DataFrame:
    """Label the rows of a run that get a review, topics alternating, in two stages."""
    total = initial + additional
    rounds = top_per_group(df, [run, topic], order, total, "round")
    picked = top_per_group(rounds, [run], [F.col("round"), F.col(topic_ord)], total, "review_no")
    return picked.withColumn(
        "stage", F.when(F.col("review_no") <= initial, "initial").otherwise("additional")
    )


def enrichment_budget(
    df: DataFrame, run: str, url: str, order: list[Column], limit: int = ENRICHMENT_MAX
) -> DataFrame:
    """The first ``limit`` distinct URLs of a run in review order; repeats are free."""
    first = df.groupBy(run, url).agg(F.min(F.struct(*order)).alias("first_seen"))
    return top_per_group(first, [run], [F.col("first_seen"), F.col(url)], limit, "fetch_no")


def unprocessed_remainder(df: DataFrame, reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates left over per group once the budget is used up."""
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"))
    done = reviewed.groupBy(*keys).agg(F.count(F.lit(1)).alias("processed"))
    return total.join(done, keys, "left").select(
        *keys, "candidates", F.coalesce("processed", F.lit(0)).alias("processed"),
        (F.col("candidates") - F.coalesce("processed", F.lit(0))).alias("remaining"),
    )


# ---------------------------------------------------------------------------
# Selection of one run
# ---------------------------------------------------------------------------
def cross_topic_twins(df: DataFrame, run: str, id_col: str, rules: tuple[str, ...] = ALL_RULES) -> DataFrame:
    """(a, b): rows of a run of which b would duplicate a if a were taken first.

    Input is a shortlist capped per topic and free of repeats inside a topic.
    """
    return duplicate_edges(df, id_col, [run], _judged_with(rules)).where(F.col("rule").isin(*rules)).select("a", "b").distinct()


def _judged_with(rules: tuple[str, ...]) -> tuple[str, ...]:
    """The rules that can name a pair in place of one of ``rules``; the exact ones never give way to the others."""
    exact = ("same_url_exact", "cross_url_exact")
    return exact if set(rules) <= set(exact) else ALL_RULES


def planned(pool: DataFrame, twins: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """``pool`` with trial (the turn in which its topic reaches the row) and skipped.

    Topics take turns; in its turn a topic takes its best row that no row taken before it makes a
    repeat.  A row's turn follows from the number of unskipped rows ranked before it, so for a given set
    of skipped rows all turns are one window, and the rows that then meet an earlier taken twin are one
    join.  From whatever set (``skipped``, of an earlier plan; else none) the rounds start, each settles at
    least the earliest open turn, so the plan is the one set that reproduces itself.
    """
    best = [F.col("score").desc(), F.col("published_rank").desc(), F.col("review_pos")]
    before = W.partitionBy("run_id", "topic_id").orderBy(*best).rowsBetween(W.unboundedPreceding, -1)
    skipped = pool.select("row_id").limit(0) if skipped is None else skipped.select("row_id")
    while True:
        marked = pool.join(skipped.withColumn("skipped", F.lit(True)), "row_id", "left").withColumn(
            "skipped", F.coalesce("skipped", F.lit(False))
        )
        turn = F.coalesce(F.sum((~F.col("skipped")).cast("int")).over(before), F.lit(0)) + 1
        plan = cut(marked.withColumn("trial", turn).withColumn("reached", F.col("trial") <= F.col("article_limit")))
        at = F.struct("trial", "topic_ord", "topic_id").alias("at")
        taken = plan.where("reached AND NOT skipped").select(F.col("row_id").alias("a"), at)
        meets = plan.where("reached").select(F.col("row_id").alias("b"), at.alias("own")).join(twins, "b").join(taken, "a")
        again = cut(meets.where(F.col("at") < F.col("own")).select(F.col("b").alias("row_id")).distinct())
        moved = again.withColumn("now", F.lit(True)).join(
            plan.where("skipped").select("row_id", F.lit(True).alias("was")), "row_id", "full_outer").where("now IS NULL OR was IS NULL")
        if moved.isEmpty():
            return plan
        skipped = again


def select_for_run(shortlist: DataFrame) -> DataFrame:
    """Review and selection, all runs and topics at once: (run_id, topic_id, article_id, status, rank).

    A topic reviews its shortlist in order until it has as many qualifying rows as its limit, then the
    topics take turns.  Topics that other topics' picks leave short review on until they have the
    missing number of further qualifying rows, and the turns are planned anew.  ``shortlist`` must be
    capped per topic (:func:`shortlist_limit`).
    """
    rows = cut(shortlist.select(
        "run_id", "topic_id", "topic_ord", "article_id", "review_pos", "score", "published_rank", "qualifies", "article_limit",
        F.concat_ws("|", "run_id", "topic_id", F.col("article_id").cast("string")).alias("row_id"),
        F.coalesce(F.sum(F.col("qualifies").cast("int")).over(
            W.partitionBy("run_id", "topic_id").orderBy("review_pos").rowsBetween(W.unboundedPreceding, -1)
        ), F.lit(0)).alias("_before"),
    ))
    twins = cut(cross_topic_twins(shortlist.withColumn(
        "row_id", F.concat_ws("|", "run_id", "topic_id", F.col("article_id").cast("string"))), "run_id", "row_id"))
    topic = ["run_id", "topic_id"]
    wanted = cut(rows.groupBy(*topic).agg(F.max("article_limit").alias("wanted")))
    while True:                                    # ends: every round reviews more rows or leaves no topic short
        reviewed = rows.join(wanted, topic).where(F.col("_before") < F.col("wanted"))
        plan = planned(reviewed.where("qualifies"), twins)
        chosen = plan.where("reached AND NOT skipped").groupBy(*topic).agg(F.count(F.lit(1)).alias("chosen"))
        left = rows.join(wanted, topic).where(F.col("_before") >= F.col("wanted")).select(*topic).distinct()
        short = rows.groupBy(*topic).agg(F.max("article_limit").alias("limit")).join(left, topic, "left_semi").join(
            chosen, topic, "left").select(*topic, (F.col("limit") - F.coalesce("chosen", F.lit(0))).alias("missing")).where("missing > 0")
        short = cut(short)
        if short.isEmpty():
            break
        wanted = cut(wanted.join(short, topic, "left").select(*topic, (F.col("wanted") + F.coalesce("missing", F.lit(0))).alias("wanted")))
    status = F.when(F.col("reached") & ~F.col("skipped"), "selected").when(F.col("reached") & F.col("skipped"), "run_duplicate")
    done = reviewed.select(*topic, "article_id", "row_id").join(
        plan.select("row_id", status.alias("status"), F.when(status == "selected", F.col("trial")).alias("rank")), "row_id", "left"
    )
    return done.select(
        *topic, "article_id", F.coalesce("status", F.lit("reviewed")).alias("status"),
        F.coalesce("rank", F.lit(0)).cast("int").alias("rank"),
    )
