"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

The five-word shingles of a text are hashed once; the hash's high bits choose one of ``BINS`` bins
and each bin keeps its least hash.  An empty bin takes the value of a filled bin that a universal
hash of (bin, attempt) reaches first, so two sets borrow alike.  Of every bin ``BITS`` low bits are
stored, packed; the share of equal bins is corrected for chance agreement of those bits.

Null and empty texts, and texts of white space, have the empty fingerprint: likeness 1 to another
empty one and 0 to any other.  A text of fewer than five words is one shingle.  Repeated rows and
ties of the id are ordered by text; a table of one row is its own successor; extra columns are
left out.  Ids are numbers: the limits of the id ranges are quantiles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width
from .hashing import U64, Words, mix, windows

SHINGLE, BINS, BITS = 5, 256, 4


class Sketcher:
    """Fingerprints of texts; holds tables, so make one per task."""

    attempts = 64

    def __init__(self, shingle: int = SHINGLE, bins: int = BINS):
        if bins & (bins - 1) or bins < 2:
            raise ValueError("bins must be a power of two")
        self.words, self.shingle, self.bins = Words(), shingle, bins
        self.shift = U64(64 - bins.bit_length() + 1)

    def minima(self, data: bytes) -> np.ndarray | None:
        """The densified bin values of a text, or None if it has no word."""
        hashes = windows(self.words(data)[2], self.shingle)
        if not hashes.size:
            return None
        least = np.full(self.bins, np.iinfo(np.uint64).max, dtype=U64)
        where = (hashes >> self.shift).astype(np.int64)
        np.minimum.at(least, where, hashes)
        filled = np.zeros(self.bins, dtype=bool)
        filled[where] = True
        empty, attempt = np.flatnonzero(~filled), 0
        while empty.size:
            tries = np.arange(attempt, attempt + self.attempts, dtype=U64)
            reach = mix((empty.astype(U64) << U64(32))[:, None] + tries[None, :] + U64(1)) >> self.shift
            hit = filled[reach.astype(np.int64)]
            found = hit.any(axis=1)
            least[empty[found]] = least[reach[found, hit[found].argmax(axis=1)].astype(np.int64)]
            empty, attempt = empty[~found], attempt + self.attempts
        return least

    def fingerprint(self, text: str | None) -> bytes:
        least = self.minima((text or "").encode())
        if least is None:
            return b""
        low = mix(least).astype(np.uint8) & np.uint8((1 << BITS) - 1)
        return (low[0::2] << np.uint8(4) | low[1::2]).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1."""
    if not a or not b:
        return float(a == b)
    both = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    same = int(((both >> 4) == 0).sum() + ((both & 15) == 0).sum())
    chance = 1 / (1 << BITS)
    return min(1.0, max(0.0, (same / (2 * both.size) - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint) of every document, one Arrow pass without a shuffle."""

    def sketched(batches):
        sketcher = Sketcher()
        for batch in batches:
            prints = [sketcher.fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], [id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(sketched, f"`{id_col}` {kind}, fingerprint binary")


def ranged(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows dealt into id ranges, each range closed by the first row of the next one.

    Range limits are ids of the table, so a range's first row is known by its id alone and is sent
    to the range before it as well; the table's first row closes the last range.  Columns: _range,
    _ahead (0 own row, 1 closing row), id, text; sorted within each partition.
    """
    ranges = 4 * shuffle_width(docs.sparkSession)
    shares = [k / ranges for k in range(1, ranges)]
    limits = sorted(set(docs.agg(F.percentile_approx(id_col, shares, 100 * ranges)).first()[0] or []))

    def place(ids: pa.Array) -> pa.Array:
        known = np.array(limits)
        return pa.array([0 if x is None else int(np.searchsorted(known, x, side="right")) for x in ids.to_pylist()], pa.int32())

    place.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    at = F.arrow_udf(place, "int")(F.col(id_col)) if limits else F.lit(0)
    rows = docs.select(at.alias("_range"), F.lit(0).alias("_ahead"), id_col, text)
    edge = F.col(id_col).isin(limits) if limits else F.lit(False)
    copies = F.when(edge, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = rows.select("*", F.explode(copies).alias("_copy")).select(
        (F.col("_range") - F.col("_copy")).alias("_range"), F.col("_copy").alias("_ahead"), id_col, text
    )
    first = docs.select(F.lit(len(limits)).alias("_range"), F.lit(1).alias("_ahead"), id_col, text)
    dealt = dealt.unionAll(first.orderBy(id_col, text).limit(1))
    return dealt.repartition(shuffle_width(docs.sparkSession), "_range").sortWithinPartitions(
        "_range", "_ahead", id_col, text
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document against its edited text: the last quarter replaced by the next one's start.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited and
    near_next.  One shuffle of the texts; every range is streamed, one row held at a time.
    """

    def compared(batches):
        sketcher, held = Sketcher(), None
        for batch in batches:
            out = []
            for at, ahead, key, value in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                value = value or ""
                if held is not None and held[0] != at:
                    held = None
                if ahead and held is None:
                    continue                                  # a range without rows of its own, or a tie of its end
                own = sketcher.fingerprint(value)
                if held is not None:
                    _, old_key, old, old_print = held
                    cut = len(old) // 4
                    new = old[: len(old) - cut] + value[:cut]
                    new_print = sketcher.fingerprint(new)
                    out.append((
                        old_key, len(old), hashlib.sha256(new.encode()).hexdigest(), old_print.hex(), new_print.hex(),
                        likeness(old_print, new_print), likeness(old_print, own),
                    ))
                held = None if ahead else (at, key, value, own)
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

    field = docs.schema[id_col]
    from pyspark.sql.pandas.types import to_arrow_type

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [to_arrow_type(field.dataType), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    return ranged(docs, id_col, text).mapInArrow(
        compared,
        f"`{id_col}` {field.dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
