"""Merkle manifest of a table: a proof for every row, by lag and lead windows.

A row is a leaf, the hash of its fields with their lengths.  The leaves of a source, in the order of
their ids, are hashed in runs of ``ARITY`` consecutive nodes, level by level, to the source's subroot,
and the subroots likewise to the root.

Leaves are numbered per source without gathering a source (:func:`numbered`), then dealt to blocks of
``ARITY ** LEVELS`` consecutive places.  Runs never cross a block, so a source of any size spreads over
its blocks.  In a block the node of a level sits on the row of its first leaf: its siblings are the rows
a fixed offset (``ARITY ** level`` and multiples) before and after, which lag and lead columns fetch,
masked by the node's slot in its run and by the run's length; the row of a run's first child hashes
the parent.  One running window then hands each level's siblings down to all leaves of the block.  The
blocks' own nodes, ``ARITY ** LEVELS`` times fewer, go through the same step until every source has
one node, and the sources through it again; on the way back each block takes over the path above it.

Equal ids follow the order of their hashes, a null id comes first; a null source is a source of its
own, before all others; equal rows are leaves of their own.  Null fields count as absent, an empty text as
a text of length 0.  An empty table has no root and gives no rows.  Extra columns play no part unless
named in ``fields``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, numbered

ARITY, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


def leaf_hash(fields: list[Column]) -> Column:
    """The hash of a row's fields: ``-`` for a null, else the UTF-8 byte count, ``:`` and the value."""
    said = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def without_line_breaks(id_col: str = "doc_id", text: str = "text") -> Column:
    """The text as a tamperer leaves it: without line breaks where the CRC of the id is even."""
    even = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(even, F.translate(F.col(text), "\n", "")).otherwise(F.col(text))


def _block(arity: int, levels: int) -> Column:
    return F.expr(f"pos div {arity ** levels}").alias("block")


def climbed(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """``nodes`` (g, pos, n, h, ...) with ``block``, ``h_<levels>`` on the first row of a block, and
    ``side_<level>`` on the row of each node: what stands left and right of it in its run."""
    inside = W.partitionBy("g", "block").orderBy("pos")
    rows = nodes.withColumn("block", _block(arity, levels)).withColumn("h_0", F.col("h"))
    for level in range(levels):
        step, own = arity ** level, F.col(f"h_{level}")
        of = F.expr(f"(n + {step - 1}) div {step}")                        # nodes of this level
        slot = F.expr(f"pos div {step} % {arity}")
        run = F.least(F.lit(arity), of - F.expr(f"pos div {step * arity} * {arity}"))
        before = [F.when(slot >= d, F.lag(own, d * step).over(inside)) for d in range(arity - 1, 0, -1)]
        after = [F.when(slot + d < run, F.lead(own, d * step).over(inside)) for d in range(1, arity)]
        side = F.struct(F.concat_ws("", *before).alias("left"), F.concat_ws("", *after).alias("right"))
        rows = rows.withColumn(f"side_{level}", F.when((F.col("pos") % step == 0) & (of > 1), side))
        parent = F.when(of > 1, F.sha2(F.concat(own, F.col(f"side_{level}.right")).cast("binary"), 256)).otherwise(own)
        rows = rows.withColumn(f"h_{level + 1}", F.when(F.col("pos") % (step * arity) == 0, parent))
    return rows


def proofs(
    nodes: DataFrame, scratch: Scratch, finish: Callable[[DataFrame], DataFrame], arity: int = ARITY, levels: int = LEVELS, name: str = "tops"
) -> DataFrame:
    """``nodes`` (g, pos, n, h, ...) with ``path``, the siblings on the way up, and what ``finish`` adds.

    ``finish`` gets the groups' last nodes (g, pos = 0, n = 1, h) and gives (g, pos, path, ...).
    """
    span = arity ** levels
    top = climbed(nodes.select("g", "pos", "n", "h"), arity, levels).where(F.col("pos") % span == 0)
    tops = scratch.keep(name, top.select(
        "g", F.col("block").alias("pos"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), F.col(f"h_{levels}").alias("h")
    ))
    above = finish(tops) if tops.where("n > 1").isEmpty() else proofs(tops, scratch, finish, arity, levels, name + "+").drop("n", "h")
    handed = W.partitionBy("g", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    sides = [F.last(f"side_{k}", ignorenulls=True).over(handed) for k in range(levels)]
    own = climbed(nodes, arity, levels).withColumn("own", F.array_compact(F.array(*sides)))
    above = above.withColumnRenamed("pos", "block").withColumnRenamed("path", "above")
    own = own.drop(*[f"h_{k}" for k in range(levels + 1)], *[f"side_{k}" for k in range(levels)])
    return own.join(above, ["g", "block"]).withColumn("path", F.concat("own", "above").cast(PATH)).drop("own", "above", "block")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, side: F.sha2(F.concat(side["left"], h, side["right"]).cast("binary"), 256))


def manifest(
    docs: DataFrame, altered: Column | None = None, id_col: str = "doc_id", source: str = "source",
    fields: tuple[str, ...] = FIELDS, text: str = "text", arity: int = ARITY, levels: int = LEVELS, scratch: Scratch | None = None,
) -> DataFrame:
    """One row per document: its id, source, pos, leaf, path, subroot, root, and altered_leaf.

    ``altered`` is the text whose leaf is to be held against the manifest (the text itself if not given).
    """
    scratch = scratch or Scratch(docs.sparkSession)
    changed = [altered if altered is not None and f == text else F.col(f) for f in fields]
    leaves = scratch.keep("leaves", docs.select(
        F.col(id_col).alias("id"), F.col(source).alias("of"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-")).alias("g"),
        leaf_hash([F.col(f) for f in fields]).alias("h"), leaf_hash(changed).alias("altered_leaf"),
    ))
    nodes = scratch.keep("nodes", numbered(leaves, "g", ["id", "h"], scratch))
    scratch.drop("leaves", "numbered")

    def at_root(tops: DataFrame) -> DataFrame:
        return tops.select("g", "pos", F.array().cast(PATH).alias("path"), F.col("h").alias("root"))

    def at_subroots(tops: DataFrame) -> DataFrame:
        sources = numbered(tops.select(F.lit("").alias("all"), "g", "h"), "all", ["g"], scratch, "sources")
        sources = scratch.keep("subroots", sources.select(F.col("all").alias("g"), F.col("g").alias("source"), "pos", "n", "h"))
        return proofs(sources, scratch, at_root, arity, levels, "roots").select(
            F.col("source").alias("g"), F.lit(0).cast("bigint").alias("pos"), "path", F.col("h").alias("subroot"), "root"
        )

    return proofs(nodes, scratch, at_subroots, arity, levels).select(
        F.col("id").alias(id_col), F.col("of").alias(source), "pos", F.col("h").alias("leaf"), "path", "subroot", "root", "altered_leaf"
    )


def verified(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`manifest` with proof_sha256, folded_root (of the altered leaf) and verified."""
    proof = F.array_join(F.transform("path", lambda side: F.concat(side["left"], side["right"])), "")
    return rows.withColumn("proof_sha256", F.sha2(proof.cast("binary"), 256)).withColumn(
        "folded_root", folded(F.col("altered_leaf"), F.col("path"))
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
