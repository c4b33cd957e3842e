"""Importance resampling towards a target distribution, with an Aho-Corasick dictionary.

Texts are lower-cased (A-Z), and everything in ASCII but letters and digits becomes a delimiter.  The
distinct words of a batch join a dictionary, each bounded by a delimiter on both sides and carrying
its CRC-32 and its length.  One scan of the automaton over a text emits the payloads of its words in
order; the payloads of adjacent words compose to the CRC of the run they make (the CRC of a
concatenation follows from the CRCs and the second length), and its remainder is the run's bucket.
The buckets of a document are written once, two bytes each, and serve both counting and scoring.

A bucket's gain is the log ratio of its share in the target to its share in the documents, add-one
smoothed; a document's weight is the mean gain of its features.  Scores add Gumbel noise drawn from
the id, so that the highest scores are a sample without replacement in proportion to the weights.

Null and empty texts have no features, weight 0 and are not drawn.  Ties go to the smaller id, a null
id comes last.  Repeated rows are documents of their own with equal scores.  Empty tables give an empty result, an
empty target equal gains by smoothing.  Extra columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered

# Parameters: longest run of words, buckets, words a drawn document has, percent drawn, seed.
ORDER, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
KNOWN = 200_000                 # words a task's dictionary holds before it starts again with a batch's own
DELIMITER = b" "
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def _shift_tables(powers: int = 32) -> np.ndarray:
    """``[k, j, v]``: what byte ``j`` with value ``v`` of a CRC gives after ``2 ** k`` zero bytes."""
    def after(crc: np.ndarray) -> np.ndarray:
        for _ in range(8):
            crc = (crc >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (crc & np.uint32(1)))
        return crc

    values = np.arange(256, dtype=np.uint32)
    tables = np.stack([after(values << np.uint32(8 * j)) for j in range(4)])[None]
    while len(tables) < powers:
        tables = np.concatenate((tables, _shifted(tables[-1], tables[-1])[None]))
    return tables


def _shifted(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


class Composer:
    """CRCs of concatenations; holds the tables, so make one per task."""

    def __init__(self):
        self.tables = _shift_tables()

    def __call__(self, crc: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The CRCs of pairs, from both CRCs and the length of the second."""
        for k in range(int(length.max(initial=0)).bit_length()):
            crc = np.where(length >> k & 1, _shifted(crc, self.tables[k]), crc)
        return crc ^ other


class Dictionary:
    """An automaton over delimited words whose payload is ``length << 32 | crc``; one per task."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        import ahocorasick

        self.words: set[bytes] = set()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)     # its own integers have 32 bits

    def learn(self, texts: list[bytes]) -> None:
        """Add the distinct words of texts whose words are separated by one delimiter."""
        new = set().union(*[t.split() for t in texts])
        if len(self.words) + len(new) > KNOWN:
            self._clear()
        new -= self.words
        if new:
            for word in new:
                self.automaton.add_word(f" {word.decode('latin-1')} ", len(word) << 32 | zlib.crc32(word))
            self.words |= new
            self.automaton.make_automaton()

    def payloads(self, text: bytes) -> np.ndarray:
        """The payloads of the words of ``text`` in order."""
        if not text:
            return np.empty(0, np.int64)
        return np.fromiter([x for _, x in self.automaton.iter(f" {text.decode('latin-1')} ")], np.int64)


def delimited(text: str | None) -> bytes:
    """The words of a text, one delimiter between them."""
    return DELIMITER.join((text or "").encode().translate(_BYTES).split())


def run_crcs(payloads: np.ndarray, order: int, compose: Composer) -> np.ndarray:
    """The CRCs of all runs of 1 to ``order`` words, joined by one delimiter."""
    crc, length = (payloads & 0xFFFFFFFF).astype(np.uint32), payloads >> 32
    gap = np.uint32(zlib.crc32(DELIMITER))
    runs, out = crc, [crc]
    for k in range(1, min(order, len(crc))):
        spaced = compose(runs[:-1], np.broadcast_to(gap, runs[:-1].shape), np.ones(len(runs) - 1, np.int64))
        runs = compose(spaced, crc[k:], length[k:])
        out.append(runs)
    return np.concatenate(out)


def bucketed(docs: DataFrame, id_col: str, text: str, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, buckets): the buckets of a text's features, packed little-endian."""
    kind = docs.schema[id_col].dataType.simpleString()
    packed = "<u2" if buckets <= 1 << 16 else "<u4"

    def scanned(batches):
        known, compose = Dictionary(), Composer()
        for batch in batches:
            texts = [delimited(x.as_py()) for x in batch.column(1)]
            known.learn(texts)
            n_words, n_features, found = [], [], []
            for text_ in texts:
                payloads = known.payloads(text_)
                crcs = run_crcs(payloads, order, compose)
                n_words.append(len(payloads))
                n_features.append(len(crcs))
                found.append((crcs % np.uint32(buckets)).astype(packed).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(found, pa.binary())],
                ["id", "n_words", "n_features", "buckets"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        scanned, f"id {kind}, n_words bigint, n_features bigint, buckets binary"
    )


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features fall in each bucket; a task adds its own up before the shuffle."""
    packed = "<u2" if buckets <= 1 << 16 else "<u4"

    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), packed), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return rows.select("buckets").mapInArrow(counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket from the counts of documents and target, in thousandths of a nat."""
    spark = own.sparkSession
    of_own, of_target = [int(x.agg(F.sum("n")).first()[0] or 0) for x in (own, target)]
    table = spark.range(buckets).withColumnRenamed("id", "bucket")
    table = table.join(own.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = [F.coalesce(F.col(c), F.lit(0)).cast("double") + 1 for c in ("s", "t")]
    ratio = t * F.lit(float(of_own + buckets)) / (s * F.lit(float(of_target + buckets)))
    return table.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, drawn from the first 32 bits of the hash of seed and id."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER, buckets: int = BUCKETS,
    min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (null if not drawn) and n_words."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = scratch.keep("buckets", bucketed(docs, id_col, text, order, buckets))
    aim = target.select(F.lit(0).alias("id"), text)
    counts = [scratch.keep(name, bucket_counts(rows, buckets)) for name, rows in (
        ("own", own), ("aim", bucketed(aim, "id", text, order, buckets)))]
    table = np.zeros(buckets, np.int64)
    for bucket, gain in gains(*counts, buckets).collect():          # one number a bucket, however large the tables
        table[bucket] = gain
    shipped = spark.sparkContext.broadcast(table.tobytes())
    packed = "<u2" if buckets <= 1 << 16 else "<u4"

    def weighed(found: pa.Array) -> pa.Array:
        gain = np.frombuffer(shipped.value, np.int64)
        out = []
        for value in found:
            at = np.frombuffer(value.as_buffer(), packed)
            out.append(int(gain[at].sum()) // at.size if at.size else 0)
        return pa.array(out, pa.int64())

    weighed.__annotations__ = {"found": pa.Array, "return": pa.Array}
    scored = own.select("id", "n_words", "n_features", F.arrow_udf(weighed, "bigint")("buckets").alias("weight"))
    scored = scratch.keep("scored", scored.select(
        "*", (F.col("weight") + noise("id", seed)).alias("score"), (F.col("n_words") < min_words).alias("short"), F.lit("").alias("all"),
        F.col("id").isNull().alias("unnamed"),
    ).withColumn("down", -F.col("score")))
    drawn = scored.where(~F.col("short")).count() * percent // 100
    ranked = numbered(scored, "all", ["short", "down", "unnamed", "id"], scratch)
    scratch.drop("buckets", "own", "aim")
    rank = F.when(~F.col("short") & (F.col("pos") < drawn), F.col("pos") + 1)
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"), "n_words")
