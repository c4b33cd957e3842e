"""Idempotent merge of another installation's history.

Every step yields an id map (incoming id -> local id, state), so preview and apply read the
same frames.  Local settings win, runs are immutable, articles keep the local copy and
favourites are OR-ed.  Applying the same bundle twice adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import top_per_group

NOT_CONTENT = ("run_id", "article_count")       # what a run may differ in and still be the same run


def import_hash(supplied, url="canonical_url", title="norm_title") -> Column:
    """Content hash of an imported row: the supplied one, else the same one a run computes."""
    computed = F.sha2(F.concat_ws("\n", F.col(url), F.col(title)), 256)
    return F.coalesce(F.nullif(F.trim(supplied), F.lit("")), computed)


def match_sources(incoming: DataFrame, local: DataFrame) -> DataFrame:
    """(source_id, local_id, state, conflict): preset id, else same id, else same URL.

    Rows need source_id, name, canonical_url and preset_id.  Contradicting matches and an id
    that names a different source are conflicts and must stop the merge.
    """
    l = local.select(
        F.col("source_id").alias("l_id"), F.lower("name").alias("l_name"), F.col("canonical_url").alias("l_url"), F.col("preset_id").alias("l_preset")
    )
    by_preset = l.where("l_preset IS NOT NULL").groupBy("l_preset").agg(F.min("l_id").alias("p_id"), F.count(F.lit(1)).alias("p_n"))
    by_id = l.select(F.col("l_id").alias("i_id"), F.col("l_name").alias("i_name"))
    by_url = l.groupBy("l_url").agg(F.min("l_id").alias("u_id"), F.count(F.lit(1)).alias("u_n"))
    j = (
        incoming.join(by_preset, F.col("preset_id") == F.col("l_preset"), "left")
        .join(by_id, (F.col("source_id") == F.col("i_id")) & F.col("preset_id").isNull(), "left")
        .join(by_url, F.col("canonical_url") == F.col("l_url"), "left")
    )
    stable = F.coalesce("p_id", "i_id")
    other_name = F.col("i_id").isNotNull() & (F.col("i_name") != F.lower("name")) & F.col("u_id").isNull()
    conflict = (
        F.when(F.col("p_n") > 1, "preset is not unique").when(F.col("u_n") > 1, "url is not unique")
        .when(other_name, "id names another source")
        .when(stable.isNotNull() & F.col("u_id").isNotNull() & (stable != F.col("u_id")), "identity and url disagree")
    )
    local_id = F.coalesce(stable, "u_id")
    return j.select(
        "source_id", F.coalesce(local_id, F.col("source_id")).alias("local_id"),
        F.when(local_id.isNull(), "new").otherwise("matched").alias("state"), conflict.alias("conflict"),
    )


def merge_sources(incoming: DataFrame, local: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sources after the merge: edited or archived local rows stay; others take the edit."""
    cols = ["name", "url", "category", "enabled", "archived", "user_modified"]
    into = incoming.join(mapping.select("source_id", "local_id", "state"), "source_id").select(
        "local_id", "state", *[F.col(c).alias(f"in_{c}") for c in cols]
    )
    matched = into.where("state = 'matched'").drop("state")
    merged = local.join(matched, F.col("source_id") == F.col("local_id"), "left")
    touched = F.col("local_id").isNotNull() & ~F.col("user_modified") & ~F.col("archived")
    edited = touched & F.col("in_user_modified")
    kept = merged.select(
        "source_id",
        *[F.when(edited, F.col(f"in_{c}")).otherwise(F.col(c)).alias(c) for c in ("name", "url", "category")],
        F.when(touched, F.col("in_enabled") & ~F.col("in_archived")).otherwise(F.col("enabled")).alias("enabled"),
        F.when(touched, F.col("in_archived")).otherwise(F.col("archived")).alias("archived"),
        (F.col("user_modified") | edited).alias("user_modified"),
    )
    added = into.where("state = 'new'").select(
        F.col("local_id").alias("source_id"), F.col("in_name").alias("name"), F.col("in_url").alias("url"), F.col("in_category").alias("category"),
        (F.col("in_enabled") & ~F.col("in_archived")).alias("enabled"), F.col("in_archived").alias("archived"),
        (F.col("in_user_modified") | F.col("in_archived")).alias("user_modified"),
    )
    return kept.unionByName(added)


def match_names(incoming: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """(key, local_id, state, conflict) by case-insensitive name; an ambiguous name conflicts."""
    names = local.groupBy(F.lower("name").alias("_name")).agg(F.min(key).alias("_id"), F.count(F.lit(1)).alias("_n"))
    return incoming.join(names, F.lower("name") == F.col("_name"), "left").select(
        key, F.coalesce("_id", key).alias("local_id"), F.when(F.col("_id").isNull(), "new").otherwise("matched").alias("state"),
        F.when(F.col("_n") > 1, "name is not unique").alias("conflict"),
    )


def run_fingerprint(columns: list[str]) -> Column:
    """Content of a run: all given columns but its id and its article count, which the merge recomputes."""
    return F.sha2(F.to_json(F.struct(*sorted(set(columns) - set(NOT_CONTENT))), {"ignoreNullFields": "false"}), 256)


def remapped_id(run_id, fingerprint) -> Column:
    """A free id that depends only on the incoming run, so a second merge finds it again."""
    return F.substring(F.sha2(F.concat(run_id, F.lit("/"), fingerprint), 256), 1, 32)


def match_runs(incoming: DataFrame, local: DataFrame) -> DataFrame:
    """(run_id, local_id, state, conflict): matched, new, or remapped when the id is taken."""
    both = [c for c in incoming.columns if c in local.columns]
    mine = local.select(F.col("run_id").alias("l_id"), run_fingerprint(both).alias("l_print"))
    j = incoming.select("run_id", run_fingerprint(both).alias("print")).withColumn("new_id", remapped_id(F.col("run_id"), F.col("print")))
    j = j.join(mine, F.col("run_id") == F.col("l_id"), "left")
    again = mine.select(F.col("l_id").alias("r_id"), F.col("l_print").alias("r_print"))
    j = j.join(again, F.col("new_id") == F.col("r_id"), "left")
    same = F.col("l_print").eqNullSafe(F.col("print"))
    state = (
        F.when(F.col("l_id").isNull(), "new").when(same, "matched").when(F.col("r_id").isNull(), "remapped").otherwise("matched")
    )
    return j.select(
        "run_id", F.when(F.col("l_id").isNull() | same, F.col("run_id")).otherwise(F.col("new_id")).alias("local_id"),
        state.alias("state"),
        F.when(F.col("l_id").isNotNull() & ~same & (F.col("r_print") != F.col("print")), "remapped id is taken").alias("conflict"),
    )


def map_articles(incoming: DataFrame, run_map: DataFrame | None, topic_map: DataFrame, source_map: DataFrame) -> DataFrame:
    """Incoming articles with local ids; without runs they all belong to one synthetic run."""
    def renamed(mapping, key):
        return mapping.select(key, F.col("local_id").alias(f"local_{key}"))

    df = incoming.join(renamed(topic_map, "topic_id"), "topic_id").join(renamed(source_map, "source_id"), "source_id")
    df = df.drop("topic_id", "source_id").withColumnsRenamed({"local_topic_id": "topic_id", "local_source_id": "source_id"})
    if run_map is None:
        return df.withColumn("run_id", F.lit("imported"))
    return df.join(renamed(run_map, "run_id"), "run_id").drop("run_id").withColumnRenamed("local_run_id", "run_id")


def merge_articles(incoming: DataFrame, local: DataFrame, by_run: bool = True) -> DataFrame:
    """Articles after the merge with their state: local, matched (favourite OR-ed) or new.

    Key is (run, topic, content hash), or (topic, content hash) for bundles without runs.
    Repeats inside the bundle fold into their first row.
    """
    key = ["run_id", "topic_id", "content_hash"] if by_run else ["topic_id", "content_hash"]
    folded = incoming.groupBy(*key).agg(F.bool_or("favorite").alias("in_favorite"), F.count(F.lit(1)).alias("in_rows"))
    mine = local.join(folded, key, "left").withColumn(
        "state", F.when(F.col("in_rows").isNotNull(), "matched").otherwise("local")
    )
    mine = mine.withColumn("flipped", F.coalesce(F.col("in_favorite") & ~F.col("favorite"), F.lit(False))).withColumn(
        "favorite", F.col("favorite") | F.coalesce("in_favorite", F.lit(False))
    ).drop("in_favorite", "in_rows")
    first = top_per_group(incoming, key, [F.col("created_at"), F.col("id")], 1, "_rn").drop("_rn", "favorite")
    fresh = first.join(local.select(*key).distinct(), key, "left_anti").join(folded, key).withColumn(
        "favorite", F.col("in_favorite")
    ).drop("in_favorite", "in_rows")
    taken = local.select(F.col("id").alias("_taken"))
    free = F.when(F.col("_taken").isNull(), F.col("id")).otherwise(
        F.substring(F.sha2(F.concat_ws("/", "id", *key), 256), 1, 32)
    )
    fresh = fresh.join(taken, F.col("id") == F.col("_taken"), "left").withColumn("id", free).drop("_taken")
    fresh = fresh.withColumn("state", F.lit("new")).withColumn("flipped", F.lit(False))
    return mine.unionByName(fresh)


def article_changes(incoming: DataFrame, local: DataFrame, by_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """What a merge changes: the rows to add, and (id, created_at) of local rows that become favourites.

    Of ``local`` only id, key, favorite and created_at are read, and only rows with an incoming key or an
    incoming id travel; :func:`merge_articles` gives the whole table instead.
    """
    key = ["run_id", "topic_id", "content_hash"] if by_run else ["topic_id", "content_hash"]
    folded = incoming.groupBy(*key).agg(F.bool_or("favorite").alias("in_favorite"))
    met = local.select("id", "created_at", "favorite", *key).join(folded, key)
    flips = met.where(F.col("in_favorite") & ~F.col("favorite")).select("id", "created_at")
    first = top_per_group(incoming, key, [F.col("created_at"), F.col("id")], 1, "_rn").drop("_rn", "favorite")
    fresh = first.join(met.select(*key).distinct(), key, "left_anti").join(folded, key).withColumnRenamed("in_favorite", "favorite")
    taken = local.select(F.col("id").alias("_taken")).join(incoming.select(F.col("id").alias("_taken")).distinct(), "_taken", "left_semi")
    free = F.when(F.col("_taken").isNull(), F.col("id")).otherwise(F.substring(F.sha2(F.concat_ws("/", "id", *key), 256), 1, 32))
    fresh = fresh.join(taken, F.col("id") == F.col("_taken"), "left").withColumn("id", free).drop("_taken")
    return fresh, flips


def recount(runs: DataFrame, articles: DataFrame) -> DataFrame:
    """Runs with the number of articles they now have."""
    n = articles.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    return runs.join(n, "run_id", "left").withColumn("article_count", F.coalesce("_n", F.lit(0))).drop("_n")


def latest_imported(runs: DataFrame, merged: DataFrame) -> DataFrame:
    """Newest usable run that received new articles; ties go to the later ordinal."""
    usable = runs.where(F.col("status").isin("complete", "degraded"))
    got = merged.where("state = 'new'").select("run_id")
    return usable.join(got, "run_id", "left_semi").agg(
        F.max_by("run_id", F.struct(F.coalesce("finished_at", "started_at"), "started_at", "ordinal")).alias("run_id")
    )


def preview(entity: str, mapping: DataFrame) -> DataFrame:
    """(entity, incoming, new, matched, remapped, conflicts) of one id map."""
    return mapping.agg(
        F.count(F.lit(1)).alias("incoming"), F.count_if(F.col("state") == "new").alias("new"),
        F.count_if(F.col("state") == "matched").alias("matched"), F.count_if(F.col("state") == "remapped").alias("remapped"),
        F.count_if(F.col("conflict").isNotNull()).alias("conflicts"),
    ).withColumn("entity", F.lit(entity))


def union_with_precedence(frames: list[DataFrame], key: str) -> DataFrame:
    """Union by id where earlier frames win."""
    ranked = frames[0].withColumn("_from", F.lit(0))
    for i, frame in enumerate(frames[1:], 1):
        ranked = ranked.unionByName(frame.withColumn("_from", F.lit(i)))
    return top_per_group(ranked, [key], [F.col("_from")], 1, "_rn").drop("_rn", "_from")
