"""Near-duplicate detection: fast similarity sketching, banding, exact verification, components.

A document is the set of its distinct word shingles.  Sketching throws the whole set into the
coordinates round after round, each round with its own hash, until every coordinate is filled; the
rounds after the number of coordinates go to one fixed coordinate each, so filling is guaranteed and
the estimate keeps the concentration of independent minima.  ``BANDS`` bands make candidates; a band
takes as many coordinates as keep the chance that two sets at the limit miss all bands under ``MISS``
(7 at 85 percent: 3e-8; 5 at 80 percent: 2e-8).

Documents of equal sets are one node.  Within a bucket not every pair is compared:

* stars: a bucket's members are compared with leaders, the set with most copies or else one drawn by
  a hash, several hashes over the bands; two such rounds connect large groups of near copies with few
  comparisons each;
* rest: documents of buckets that then still hold several components.  A pair at the limit must share
  one of the rarest shingles of either side (as many as a side can miss, and one), so those shingles are
  the keys on which the rest meets, and only across components.

Every link is confirmed on full shingle sets, so no link between components is lost and none is
assumed.  Null texts and texts without a word have no set and stay alone; fewer words than a shingle
are one shingle; repeated rows and equal ids are kept as rows of their own; extra columns are left
out here and kept by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, packed, row_key
from .components import components
from .hashing import U64, Words, mix, windows

SHINGLE, PERCENT = 5, 80
BANDS, MISS = 45, 1e-7
PAIRS = 256                     # pairs of texts that a task answers at once
STARS = (4, 12)                 # leaders drawn for a bucket's bands, one number for each round


class Sketcher:
    """Shingle sets and band keys of texts; holds tables, so make one per task."""

    def __init__(self, shingle: int, percent: int = PERCENT, bands: int = BANDS):
        self.words, self.shingle, self.bands = Words(), shingle, bands
        self.rows = max(r for r in range(1, 33) if r == 1 or (1 - (percent / 100) ** r) ** bands <= MISS)
        self.size = bands * self.rows
        self.seeds = mix(np.arange(1, 2 * self.size + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
        self.band_seeds = mix(np.arange(1, bands + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingle hashes; A-Z count as a-z."""
        return np.unique(windows(self.words((text or "").encode().lower())[2], self.shingle))

    def _round(self, elements: np.ndarray, rounds: np.ndarray):
        drawn = mix(elements[None, :] ^ self.seeds[rounds][:, None])
        return drawn, (rounds.astype(U64) << U64(54))[:, None] | drawn >> U64(10)

    def sketch(self, elements: np.ndarray) -> np.ndarray:
        least = np.full(self.size, np.iinfo(np.uint64).max, dtype=U64)
        some = max(1, 4096 // elements.size)
        for begin in range(0, self.size, some):
            drawn, value = self._round(elements, np.arange(begin, min(begin + some, self.size)))
            where = ((drawn & U64(0xFFFFFFFF)) * U64(self.size)) >> U64(32)
            np.minimum.at(least, where.astype(np.int64).ravel(), value.ravel())
            if (least >> U64(54) < U64(min(begin + some, self.size))).all():
                return least
        for j in np.flatnonzero(least == np.iinfo(np.uint64).max):
            least[j] = self._round(elements, np.array([self.size + j]))[1].min()
        return least

    def band_keys(self, elements: np.ndarray) -> np.ndarray:
        total = self.band_seeds.copy()
        for column in self.sketch(elements).reshape(self.bands, self.rows).T:
            total = mix(total * U64(0x9E3779B97F4A7C15) + column)
        return total.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text: str, shingle: int, percent: int) -> DataFrame:
    """(id, _key, n_shingles, digest, bands) of every document; digest and bands are null without a set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sketched(batches):
        sketcher = Sketcher(shingle, percent)
        for batch in batches:
            sizes, digests, bands = [], [], []
            for value in batch.column(2):
                found = sketcher.shingles(value.as_py())
                sizes.append(found.size)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if found.size else None)
                bands.append(sketcher.band_keys(found) if found.size else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))],
                [id_col, "_key", "n_shingles", "digest", "bands"],
            )

    return docs.select(F.col(id_col), row_key(id_col, text).alias("_key"), F.col(text)).mapInArrow(
        sketched, f"`{id_col}` {kind}, _key binary, n_shingles bigint, digest binary, bands array<bigint>"
    )


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b, apart, linked) for pairs of nodes: one minus the Jaccard similarity of the full sets."""

    def compared(batches):
        sketcher, last, last_set = Sketcher(shingle), None, None
        for batch in batches:
            for begin in range(0, batch.num_rows, PAIRS):
                some = batch.slice(begin, PAIRS)
                apart, linked = [], []
                for b, own, other in zip(*[some.column(i) for i in (1, 2, 3)], strict=True):
                    if b.as_py() != last:
                        last, last_set = b.as_py(), sketcher.shingles(other.as_py())
                    mine = sketcher.shingles(own.as_py())
                    common = np.intersect1d(mine, last_set, assume_unique=True).size
                    union = mine.size + last_set.size - common
                    apart.append(1 - common / union)
                    linked.append(100 * common >= percent * union)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(apart, pa.float64()), pa.array(linked, pa.bool_())],
                    ["a", "b", "apart", "linked"],
                )

    mine = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("own")), "a")
    both = mine.join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
    return both.select("a", "b", "own", "other").mapInArrow(compared, "a bigint, b bigint, apart double, linked boolean")


def _fits(n: str, m: str, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept, _key and _group.

    ``component_id`` is the least id reachable over links, ``kept`` whether it is the document's own.
    ``_group`` is equal for documents of one component and null for those without a set.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep("rows", sketches(docs, id_col, text, shingle, percent))
    nodes = scratch.keep("nodes", rows.where("digest is not null").groupBy("digest").agg(
        F.min(F.struct(F.col(id_col), "_key")).getField("_key").alias("_key"), F.min(id_col).alias("least_id"),
        F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"),
    ).withColumn("node", F.monotonically_increasing_id()))

    spread = nodes.select("node", "n", "copies", F.posexplode("bands").alias("band", "bucket"))
    shared = spread.groupBy("bucket").count().where("count > 1").select("bucket")
    members = scratch.keep("members", spread.join(shared, "bucket", "left_semi"))
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "_key")
    texts = scratch.keep("texts", docs.select(row_key(id_col, text).alias("_key"), F.col(text).alias("text")).join(
        wanted, "_key"
    ).dropDuplicates(["node"]).select("node", "text"))

    known, labels = None, None
    for number, draws in enumerate(STARS):
        drawn = F.struct(
            (-F.col("copies")).alias("c"), F.xxhash64(F.lit(number), F.col("band") % draws, "node").alias("o"), F.col("node"), F.col("n")
        )
        leaders = members.groupBy("bucket").agg(F.min(drawn).alias("leader")).select(
            "bucket", F.col("leader.node").alias("b"), F.col("leader.n").alias("m")
        )
        pairs = members.join(leaders, "bucket").where(F.col("node") != F.col("b")).where(_fits("n", "m", percent)).select(
            F.col("node").alias("a"), "b"
        ).distinct()
        if known is not None:
            pairs = _unjoined(pairs, labels).join(_both_ways(known), ["a", "b"], "left_anti")
        found = verified(pairs, texts, shingle, percent)
        known = scratch.keep("known", found if known is None else known.unionAll(found))
        labels = components(known.where("linked"), scratch)

    mixed = scratch.keep("mixed", _mixed(members, labels))
    sets = scratch.keep("sets", _sets(mixed.join(texts, "node"), shingle))
    rest = scratch.keep("rest", _rest(_rare(sets, percent).join(mixed, "node"), known, percent))
    found = scratch.keep("found", verified(rest, texts, shingle, percent).where("linked").select("a", "b"))
    if found.take(1):
        labels = components(known.where("linked").select("a", "b").unionAll(found), scratch)
    scratch.drop("members", "texts", "mixed", "sets", "rest", "found", "known")

    labelled = nodes.join(labels, "node", "left").select(
        "digest", "least_id", F.coalesce("component", "node").alias("_group")
    )
    labelled = scratch.keep("labelled", labelled)
    scratch.drop("nodes", "labels")
    least = labelled.groupBy("_group").agg(F.min("least_id").alias("component_id"))
    placed = labelled.select("digest", "_group").join(least, "_group")
    alone = F.col("digest").isNull()
    result = rows.select(id_col, "_key", "n_shingles", "digest").join(placed, "digest", "left")
    component = F.when(alone, F.col(id_col)).otherwise(F.col("component_id"))
    return result.select(
        id_col, "n_shingles", component.alias("component_id"),
        F.col(id_col).eqNullSafe(component).alias("kept"), "_key", "_group",
    )


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _unjoined(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    of = {end: labels.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")) for end in "ab"}
    joined = pairs.join(of["a"], "a", "left").join(of["b"], "b", "left")
    return joined.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, n, component): members of buckets that still hold several components."""
    placed = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return placed.join(several.select("bucket"), "bucket", "left_semi").select("node", "n", "component").distinct()


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, h): the shingle hashes of each node as an array."""

    def split(batches):
        sketcher = Sketcher(shingle)
        for batch in batches:
            sets = [sketcher.shingles(x.as_py()).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "h"])

    return texts.select("node", "text").mapInArrow(split, "node bigint, h array<bigint>")


def _rare(sets: DataFrame, percent: int) -> DataFrame:
    """(node, h, pos): the rarest shingles of each node, as many as it can miss and one, without those it
    alone has; ``pos`` is the place in the node's order, rarest first."""
    flat = sets.select("node", F.size("h").alias("of"), F.explode("h").alias("h"))
    shared = flat.groupBy("h").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    ranked = flat.join(shared, "h").groupBy("node", "of").agg(
        F.sort_array(F.collect_list(F.struct("held", "h"))).alias("ranked")          # bounded by the document
    )
    alone = F.col("of") - F.size("ranked")
    take = (F.col("of") - F.ceil(percent * F.col("of") / 100) + 1 - alone).cast("int")
    return ranked.where(take > 0).select(
        "node", alone.alias("alone"), F.posexplode(F.slice("ranked", F.lit(1), take)).alias("i", "r")
    ).select("node", "r.h", (F.col("alone") + F.col("i") + 1).alias("pos"))


def _rest(rare: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that can reach the limit and have not been compared.

    Sets of n and m shingles at the limit share at least o(n, m) of them, so they share one among the
    first n - o + 1 of one side and the first m - o + 1 of the other.
    """
    def overlap(n, m):
        return F.ceil(percent * (F.col(n) + F.col(m)) / (100 + percent))

    def reaches(n, pos, m):
        return F.col(pos) <= F.col(n) - overlap(n, m) + 1

    # The smaller side's places are those that a partner of its own size leaves.  Groups of a shingle,
    # component and size meet first, their members after.
    small = rare.where(reaches("n", "pos", "n"))
    group = ["h", "component", "n"]
    x = small.groupBy(*group).agg(F.min("pos").alias("i")).select("h", F.col("component").alias("x"), "n", "i")
    y = rare.groupBy(*group).agg(F.min("pos").alias("j")).select("h", F.col("component").alias("y"), F.col("n").alias("m"), "j")
    fits = (F.col("n") <= F.col("m")) & _fits("n", "m", percent)
    meeting = x.join(y, "h").where((F.col("x") != F.col("y")) & fits & reaches("n", "i", "m") & reaches("m", "j", "n"))
    left = small.select("h", F.col("component").alias("x"), "n", F.col("node").alias("a"), F.col("pos").alias("p"))
    right = rare.select("h", F.col("component").alias("y"), F.col("n").alias("m"), F.col("node").alias("b"), F.col("pos").alias("q"))
    pairs = meeting.join(left, ["h", "x", "n"]).where(reaches("n", "p", "m")).join(right, ["h", "y", "m"]).where(reaches("m", "q", "n"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(_both_ways(known), ["a", "b"], "left_anti")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each component, the one with the least id, and every document without a set; all columns stay.

    A narrow table says how many rows of a content key stay; the rows themselves are shuffled once.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep("found", near_duplicates(docs, id_col, text, **how).select(F.col(id_col).alias("id"), "_key", "_group"))
    first = found.where("_group is not null").groupBy("_group").agg(
        F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("_key").alias("k"))).getField("k").alias("_key")
    )
    alone = found.where("_group is null").groupBy("_key").agg(F.count(F.lit(1)).alias("stay"))
    stay = scratch.keep("stay", first.select("_key", F.lit(1).cast("bigint").alias("stay")).unionAll(alone))
    scratch.drop("found")
    rows = packed(docs, id_col, text).join(stay, "_key")
    nth = F.row_number().over(W.partitionBy("_key").orderBy("_key"))              # the join's own order: nothing is sorted again
    return rows.withColumn("_nth", nth).where("_nth <= stay").select("_row.*")
