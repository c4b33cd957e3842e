"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row's content, defined for nulls; rows equal in these columns share it."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\u0000", *parts)))


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """(_row, _key): whole rows as one struct, so that no column of theirs can clash with a helper column."""
    return docs.select(F.struct("*").alias("_row"), row_key(*columns).alias("_key"))


def sized(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` out of ``_row``; ``n_chars``, where there is one, follows the text."""
    kept = rows.select("_row.*")
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


class Scratch:
    """Intermediate tables of one operator in the shared folder, removed as soon as they are used up."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df``, which also cuts its lineage, and read it back with real statistics."""
        path = f"{shared_folder(self.spark).rstrip('/')}/newsops-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            self._remove(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                self._remove(path)

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(rows: DataFrame, group: str, order: list[str], scratch: Scratch, name: str = "numbered") -> DataFrame:
    """``rows`` with ``pos`` (0, 1, ... in the order of the columns ``order``) and ``n``, the rows of the group.

    Rows are range-partitioned on group and order and written; each slice numbers its own rows and adds
    the sizes of the group's slices before it, so no task holds a whole group.  ``rows`` should be
    narrow and already written, as range partitioning reads them twice.
    """
    placed = scratch.keep(name, rows.repartitionByRange(group, *order).withColumn("_slice", F.spark_partition_id()))
    sizes = placed.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        group, "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(W.partitionBy(group)).alias("n"),
    )
    own = F.row_number().over(W.partitionBy(group, "_slice").orderBy(*order))
    return placed.withColumn("_own", own).join(offsets, [group, "_slice"]).withColumn(
        "pos", F.col("_before") + F.col("_own") - 1
    ).drop("_slice", "_before", "_own")
