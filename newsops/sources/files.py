"""Run artifacts, bounded part files with a manifest, and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import catalog
from ..session import cut

MAX_ROWS, MAX_PART_BYTES = 50000, 4 << 20


def write_artifact(articles: DataFrame, path: str, run_id: str) -> str:
    """One immutable JSON report per run: no full texts, an existing report is never replaced.

    Files become visible through Spark's commit protocol; ``_SUCCESS`` marks a finished report.
    """
    target = f"{path.rstrip('/')}/run_id={run_id}"
    articles.drop("full_text").write.mode("errorifexists").json(target)
    return target


def write_audit(checks: DataFrame, path: str) -> int:
    """Write an audit's rows (source_id, ok, errors, ...) as JSON; the exit status is 1 if any source failed or none was checked."""
    checks.write.mode("errorifexists").json(path)
    told = catalog.audit_report(checks.sparkSession.read.schema(checks.schema).json(path).withColumn("audit", F.lit(1)), ["audit"]).first()
    return told.exit_status if told else 1


def write_parts(df: DataFrame, path: str, rows_per_part: int) -> DataFrame:
    """JSON part files of at most ``rows_per_part`` rows; returns the manifest (part, rows).

    The manifest is counted once, right after writing, and stored beside the parts, so that a later
    check compares the files with what was written and not with themselves.
    """
    df.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_part).json(path)
    index = f"{path.rstrip('/')}_index"
    actual_parts(df.sparkSession, path).write.mode("errorifexists").parquet(index)
    return df.sparkSession.read.parquet(index)


def actual_parts(spark, path: str) -> DataFrame:
    lines = spark.read.text(f"{path.rstrip('/')}/*.json")
    return lines.groupBy(F.col("_metadata.file_name").alias("part")).agg(F.count(F.lit(1)).alias("rows"))


def reconcile_parts(manifest: DataFrame, actual: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(part, rule) where manifest and files disagree; empty means the parts may be read."""
    listed = manifest.groupBy("part").agg(F.count(F.lit(1)).alias("listed"), F.max("rows").alias("expected"))
    j = listed.join(actual.withColumnRenamed("rows", "found"), "part", "full_outer")
    rules = F.array_compact(F.array(
        F.when(F.col("listed") > 1, "listed twice"), F.when(F.col("listed").isNull(), "not listed"),
        F.when(F.col("found").isNull(), "missing"), F.when(F.col("expected") != F.col("found"), "row count differs"),
        F.when(F.col("found") > max_rows, "too many rows"),
    ))
    return j.select("part", F.explode(rules).alias("rule"))


def read_parts(spark, path: str, manifest: DataFrame, schema: str, max_rows: int = MAX_ROWS) -> DataFrame:
    problems = reconcile_parts(manifest, actual_parts(spark, path), max_rows).take(5)
    if problems:
        raise ValueError(f"parts do not match the manifest: {problems}")
    return spark.read.schema(schema).json(path)


# ---------------------------------------------------------------------------
# Parts bounded by bytes
# ---------------------------------------------------------------------------
def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("line")).alias("checksum")]


def assign_parts(df: DataFrame, order: list[Column], max_bytes: int = MAX_PART_BYTES) -> DataFrame:
    """(part, place, line, size): each row as a JSON line, and the part that it belongs to.

    Lines are laid end to end in the given order, by prefix sums over range partitions, and cut every half bound;
    what begins before a cut belongs to the part before it, so no part exceeds the bound.  A line of more than half
    the bound is a part of its own, and one beyond the bound is alone in a part above it.
    """
    half = max(1, max_bytes // 2)
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"), F.struct(*order).alias("at"))
    rows = rows.withColumn("size", F.octet_length("line") + 1)
    placed = cut(cut(rows).repartitionByRange("at", "line").withColumn("slice", F.spark_partition_id()))
    small = F.when(F.col("size") <= half, F.col("size")).otherwise(0).cast("bigint")
    sums = placed.groupBy("slice").agg(F.sum(small).alias("of"), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)     # one row for each slice
    sums = sums.select("slice", F.coalesce(F.sum("of").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"))
    inside = W.partitionBy("slice").orderBy("at", "line")
    own = placed.withColumn("place", F.row_number().over(inside)).withColumn(
        "begin", F.sum(small).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - small)
    own = own.join(sums, "slice").withColumn("place", F.col("rows_before") + F.col("place"))
    number = F.floor((F.col("bytes_before") + F.col("begin")) / half)
    part = F.when(F.col("size") <= half, F.format_string("part-%012d", number)).otherwise(F.format_string("single-%012d", F.col("place")))
    return own.select(part.alias("part"), "place", "line", "size")


def write_bounded_parts(df: DataFrame, path: str, order: list[Column], max_bytes: int = MAX_PART_BYTES) -> DataFrame:
    """JSON parts of at most ``max_bytes``, one file each; returns the manifest (part, rows, bytes, checksum).

    The manifest is made of the rows as they go to the writer, never of the files; what the writer saw
    is observed on the way and must add up to it.
    """
    assigned = cut(assign_parts(df, order, max_bytes))
    manifest = cut(assigned.groupBy("part").agg(*_sums()))
    seen = Observation()
    assigned.observe(seen, *_sums()).repartition("part").sortWithinPartitions("part", "place").select("line", "part").write.mode(
        "errorifexists").partitionBy("part").text(path)
    told = manifest.agg(F.sum("rows"), F.sum("bytes"), F.bit_xor("checksum")).first()
    if told[0] is not None and tuple(told) != tuple(seen.get[c] for c in ("rows", "bytes", "checksum")):
        raise ValueError(f"written rows differ from the manifest: {seen.get} against {tuple(told)}")
    return manifest


def actual_bounded_parts(spark, path: str) -> DataFrame:
    """(part, files, rows, bytes, checksum) of the files that are there."""
    lines = spark.read.text(path).select(
        F.col("part").cast("string").alias("part"), F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"),
        (F.octet_length("value") + 1).alias("size"))
    return lines.groupBy("part").agg(F.count_distinct("file").alias("files"), *_sums())


def check_bounded_parts(manifest: DataFrame, actual: DataFrame, max_bytes: int = MAX_PART_BYTES) -> DataFrame:
    """(part, rule) where manifest and files disagree; empty means the parts may be read."""
    listed = manifest.groupBy("part").agg(F.count(F.lit(1)).alias("listed"), *[F.max(c).alias(f"m_{c}") for c in ("rows", "bytes", "checksum")])
    j = listed.join(actual, "part", "full_outer")
    both = F.col("listed").isNotNull() & F.col("rows").isNotNull()
    rules = F.array_compact(F.array(
        F.when(F.col("listed") > 1, "listed twice"), F.when(F.col("listed").isNull(), "not listed"), F.when(F.col("rows").isNull(), "missing"),
        F.when(F.col("files") > 1, "several files"), F.when(both & (F.col("m_rows") != F.col("rows")), "row count differs"),
        F.when(both & (F.col("m_rows") == F.col("rows")) & ((F.col("m_bytes") != F.col("bytes")) | (F.col("m_checksum") != F.col("checksum"))), "content differs"),
        F.when((F.col("bytes") > max_bytes) & (F.col("rows") > 1), "too many bytes"),
    ))
    return j.select("part", F.explode(rules).alias("rule"))


def read_bounded_parts(spark, path: str, manifest: DataFrame, schema: str, max_bytes: int = MAX_PART_BYTES) -> DataFrame:
    problems = check_bounded_parts(manifest, actual_bounded_parts(spark, path), max_bytes).take(5)
    if problems:
        raise ValueError(f"parts do not match the manifest: {problems}")
    return spark.read.text(path).select(F.from_json("value", schema).alias("row")).select("row.*")
