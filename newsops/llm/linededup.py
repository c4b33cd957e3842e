"""Line dedup: a deletion-neighbourhood join over the units of lines.

A line's units are its words; every character of a script without spaces (Chinese, Japanese, Thai and
the like) is a unit of its own.  Lines with the same units are equal.  Lines of weight ``MIN_WEIGHT`` or
more, where a word weighs two and a character of its own one, are duplicates too if one unit inserted,
deleted or replaced turns one into the other.  Emitting a line with each single unit deleted makes
equal keys exactly for such pairs: two lines differ by a replacement at place i if they are equal
without unit i, and by an insertion if one is equal to the other without a unit.  So every key needs
only the earliest line that holds it, an aggregate that combines before the shuffle, and no pairs of
a group are ever formed.

Variants are emitted only for lines that can have a partner.  Before that, every line gives two
coarse variants, itself without its last part and without its first part (``p`` units from either
end, ``p`` the largest power of two up to half the line): one edit leaves one of them whole.  Lines
none of whose coarse keys is shared by another line are done.

Texts are taken apart in chunks of about ``CHUNK`` bytes, many short texts at once.  Lines that stand in
very many places, of which there can be only a few for each shuffle partition, are looked up in a
table of their own, so that no task gathers the places of one line.

Order is (id, content key, line number); a line goes if an earlier duplicate exists, with that line
as witness, and the edit is verified on the units.  Of exactly equal lines the first place stays.
Blank lines always stay.  Null ids come first; null texts have no lines; rows equal in id and text are
one document and keep the same lines; extra columns are kept by :func:`drop_lines`, which lets a
document go when no unit of it is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, packed, row_key, shuffle_width, sized
from .hashing import U64, Words, mix

MIN_WEIGHT, CHUNK = 16, 1 << 20
HEAVY = 4                       # a heavy line holds more than its share of all places, cut in this many parts a partition
WHOLE = -1                      # the place of a key that is the line itself

# The blocks of scripts without spaces.
UNSPACED_RANGES = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF), (0x20000, 0x3FFFF),
)
UNSPACED = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED_RANGES) + "]")
_EDGES = np.array([x for a, b in UNSPACED_RANGES for x in (a, b + 1)])
_LEADS = np.zeros(256, dtype=bool)
for _a, _b in UNSPACED_RANGES:
    _LEADS[chr(_a).encode()[0]:chr(_b).encode()[0] + 1] = True


def _alone(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which units are one character of a script without spaces."""
    alone, length = np.zeros(len(starts), dtype=bool), ends - starts
    for n, lead in ((3, 0x0F), (4, 0x07)):
        at = np.flatnonzero((length == n) & _LEADS[raw[starts]])
        code = raw[starts[at]].astype(np.int64) & lead
        for k in range(1, n):
            code = code << 6 | raw[starts[at] + k] & 0x3F
        alone[at] = np.searchsorted(_EDGES, code, side="right") % 2 == 1
    return alone


class Lines:
    """The lines with a unit of several texts: ``row``, ``line_no`` and unit range of each, and the units' hashes."""

    def __init__(self, words: Words, texts: list[bytes]):
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        split = bool(_LEADS[raw].any())
        if split:
            self.data = UNSPACED.sub(r" \g<0> ", self.data.decode()).encode()
            raw = np.frombuffer(self.data, np.uint8)
        self.starts, self.ends, self.hashes = words(self.data)
        line = np.searchsorted(np.flatnonzero(raw == 10), self.starts)
        self.begins = np.flatnonzero(np.diff(line, prepend=-1))
        self.stops = np.append(self.begins[1:], len(line)).astype(np.int64)[: len(self.begins)]
        self.number = line[self.begins]
        weight = self.stops - self.begins
        if split and len(line):
            weight = 2 * weight - np.add.reduceat(_alone(raw, self.starts, self.ends).astype(np.int64), self.begins)
        else:
            weight = 2 * weight
        self.long = weight >= MIN_WEIGHT
        self.first = np.concatenate(([0], np.cumsum([t.count(b"\n") + 1 for t in texts])))
        self.row = np.searchsorted(self.first, self.number, side="right") - 1
        self.line_no = self.number - self.first[self.row]

    def said(self, i: int) -> str:
        """The units of a line, one blank between them."""
        return b" ".join(self.data[self.starts[self.begins[i]]:self.ends[self.stops[i] - 1]].split()).decode()


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``CHUNK`` bytes, at least one row each."""
    size = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]).astype(np.int64)
    chunk = np.cumsum(size + 1) // CHUNK
    cuts = np.flatnonzero(np.diff(chunk)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True)


def _utf8(text: str):
    return F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))


def coarse_lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(_id, _key, line_no, h, keys): every line with a unit, with its coarse keys if it is long enough for edits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def keyed(batches):
        words = Words()
        for batch in batches:
            if not batch.num_rows:
                continue
            for begin, end in _chunks(batch.column(2)):
                some = batch.slice(begin, end - begin)
                lines = Lines(words, some.column(2).to_pylist())
                whole = words.runs(lines.hashes, lines.begins, lines.stops)
                begins, stops = lines.begins[lines.long], lines.stops[lines.long]
                n = stops - begins
                half = np.int64(1) << (np.frexp(n // 2)[1] - 1).astype(np.int64)
                less = np.int64(1) << (np.frexp((n - 1) // 2)[1] - 1).astype(np.int64)      # as the line one unit shorter
                differ = half != less
                keys = np.zeros((len(n), 4), dtype=U64)
                keys[:, 0] = words.runs(lines.hashes, begins, begins + half)
                keys[:, 1] = mix(words.runs(lines.hashes, stops - half, stops) + U64(1))
                keys[differ, 2] = words.runs(lines.hashes, begins[differ], (begins + less)[differ])
                keys[differ, 3] = mix(words.runs(lines.hashes, (stops - less)[differ], stops[differ]) + U64(1))
                given = np.ones((len(n), 4), dtype=bool)
                given[:, 2:] = differ[:, None]
                counts = np.zeros(len(whole), dtype=np.int64)
                counts[lines.long] = given.sum(axis=1)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                at = pa.array(lines.row)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(at), some.column(1).take(at), pa.array(lines.line_no, pa.int64()), pa.array(whole.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[given].view(np.int64)))],
                    ["_id", "_key", "line_no", "h", "keys"],
                )

    rows = docs.select(F.col(id_col), row_key(id_col, text), _utf8(text))
    return rows.mapInArrow(keyed, f"_id {kind}, _key binary, line_no bigint, h bigint, keys array<bigint>")


def _deleted(words: Words, own: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the unit hashes ``own`` of lines of ``n`` units: line, place, and the line's hash without the unit at that place."""
    line, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    place = np.arange(len(own)) - first[line]
    table = words.table - 1
    before = own * words.powers[place & table]
    before = np.cumsum(before, dtype=U64) - before
    after = np.where(place > 0, own * words.powers[(place - 1) & table], U64(0))
    after = np.cumsum(after, dtype=U64)
    last = first + n - 1
    total = (before - before[first][line]) + (after[last][line] - after) + (n - 1).astype(U64)[line]
    return line, place, mix(total)


def unit_variants(rows: DataFrame) -> DataFrame:
    """(h, key, place, line) for the chosen lines of ``rows`` (text, chosen): the line itself, with its
    units, and each line with one unit deleted."""

    def varied(batches):
        words = Words()
        for batch in batches:
            if not batch.num_rows:
                continue
            for begin, end in _chunks(batch.column(0)):
                lines = Lines(words, batch.column(0).slice(begin, end - begin).to_pylist())
                wanted = batch.column(1).slice(begin, end - begin)
                number = np.concatenate([lines.first[i] + np.sort(x) for i, x in enumerate(wanted.to_numpy(zero_copy_only=False))]).astype(np.int64)
                at = np.searchsorted(lines.number, number)
                begins, n = lines.begins[at], (lines.stops - lines.begins)[at]
                whole = words.runs(lines.hashes, begins, begins + n)
                own = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())
                line, place, keys = _deleted(words, lines.hashes[own], n)
                size, heads = len(line) + len(at), np.cumsum(n) - n + np.arange(len(at))
                places, key = np.full(size, WHOLE, dtype=np.int64), np.empty(size, dtype=U64)
                key[heads] = whole
                tails = np.arange(len(line)) + line + 1
                key[tails], places[tails] = keys, place
                said, blank = np.zeros(size, dtype=np.int64), np.ones(size, dtype=bool)
                said[heads], blank[heads] = np.arange(len(at)), False
                texts = pa.array([lines.said(i) for i in at.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(whole, n + 1).view(np.int64)), pa.array(key.view(np.int64)), pa.array(places),
                     texts.take(pa.array(said, mask=blank))],
                    ["h", "key", "place", "line"],
                )

    return rows.mapInArrow(varied, "h bigint, key bigint, place bigint, line string")


def within_one_unit(a: str, b: str) -> bool:
    """Whether two lines of units are equal or one inserted, deleted or replaced unit apart."""
    a, b = sorted((a.split(" "), b.split(" ")), key=len)
    if len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def duplicate_lines(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", scratch: Scratch | None = None
) -> DataFrame:
    """(_id, _key, line_no, exact, kept_id, kept_line): every line that goes, and the earlier one it repeats."""
    scratch = scratch or Scratch(docs.sparkSession)
    lines = scratch.keep("lines", coarse_lines(docs, id_col, text))
    order = F.struct("_id", "_key", "line_no").alias("first")
    distinct = scratch.keep("distinct", lines.groupBy("h").agg(
        F.min(order).alias("first"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("places")
    ))

    spread = distinct.select("h", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").count().where("count > 1").select("key")
    partnered = spread.join(shared, "key", "left_semi").select("h").distinct()
    chosen = distinct.join(partnered, "h", "left_semi").groupBy("first._key").agg(
        F.collect_list("first.line_no").alias("chosen")                        # lines of one document
    )
    sources = docs.select(row_key(id_col, text).alias("_key"), _utf8(text).alias("text")).join(chosen, "_key")
    variants = scratch.keep("variants", unit_variants(sources.select("text", "chosen")))

    met = variants.groupBy("key").count().where("count > 1").select("key")
    meeting = scratch.keep("meeting", variants.drop("line").join(met, "key", "left_semi").join(
        distinct.select("h", "first"), "h"
    ).withColumn("own", F.struct("first", "h")).select("key", "place", "own").distinct())
    least = meeting.where(F.col("place") != WHOLE).groupBy("key", "place").agg(F.min("own").alias("least"))
    ends = meeting.groupBy("key").agg(
        F.min(F.when(F.col("place") == WHOLE, F.col("own"))).alias("whole"),
        F.min(F.when(F.col("place") != WHOLE, F.col("own"))).alias("longer"),
    )
    replaced = meeting.join(least, ["key", "place"]).where("least < own").select("own", "least")
    moved = meeting.join(ends, "key").select(
        "own", F.when(F.col("place") == WHOLE, F.col("longer")).otherwise(F.col("whole")).alias("least")
    ).where("least < own")
    witnesses = replaced.unionAll(moved).select(
        F.col("own.h").alias("h"), F.col("least.first").alias("kept"), F.col("least.h").alias("kept_h")
    ).distinct()

    def checked(own: pa.Array, kept: pa.Array) -> pa.Array:
        return pa.array([within_one_unit(a, b) for a, b in zip(own.to_pylist(), kept.to_pylist(), strict=True)])

    checked.__annotations__ = {"own": pa.Array, "kept": pa.Array, "return": pa.Array}
    said = variants.where(F.col("place") == WHOLE).select("h", "line").dropDuplicates(["h"])
    near = witnesses.join(said, "h").join(said.select(F.col("h").alias("kept_h"), F.col("line").alias("kept_line")), "kept_h").where(
        F.arrow_udf(checked, "boolean")(F.col("line"), F.col("kept_line"))
    ).groupBy("h").agg(F.min("kept").alias("near"))

    judged = scratch.keep("judged", distinct.join(near, "h", "left").where("places > 1 OR near IS NOT NULL").select("h", "first", "near", "places"))
    every = lines.select("_id", "_key", "line_no", "h")
    share = max(1, every.count() // (HEAVY * shuffle_width(docs.sparkSession)))
    heavy = F.broadcast(judged.where(F.col("places") > share).drop("places"))     # at most HEAVY lines for each shuffle partition
    light = every.join(heavy.select("h"), "h", "left_anti").join(judged.where(F.col("places") <= share).drop("places"), "h")
    exact = F.struct("_id", "_key", "line_no") != F.col("first")
    gone = light.unionByName(every.join(heavy, "h")).where(exact | F.col("near").isNotNull())
    kept = F.coalesce("near", "first")
    return gone.select(
        "_id", "_key", "line_no", F.col("near").isNull().alias("exact"), kept.getField("_id").alias("kept_id"),
        kept.getField("line_no").alias("kept_line"),
    )


def line_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_dropped, n_near and the dropped line numbers."""
    gone = duplicate_lines(docs, id_col, text).distinct().groupBy("_key").agg(
        F.sort_array(F.collect_list("line_no")).alias("dropped_lines"), F.count(F.when(~F.col("exact"), 1)).alias("n_near")
    )
    rows = docs.select(F.col(id_col), row_key(id_col, text).alias("_key")).join(gone, "_key", "left")
    return rows.select(
        id_col, F.coalesce(F.size("dropped_lines"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("dropped_lines", F.array().cast("array<bigint>")).alias("dropped_lines"),
    )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their duplicate lines; all columns stay, ``n_chars`` follows the text."""
    gone = duplicate_lines(docs, id_col, text).select("_key", "line_no").distinct().groupBy("_key").agg(
        F.collect_list("line_no").alias("_gone")
    )

    def shortened(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for value, numbers in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
            if numbers:
                drop = set(numbers)
                value = "\n".join(x for i, x in enumerate(value.split("\n")) if i not in drop)
            out.append(value)
        return pa.array(out, pa.string())

    shortened.__annotations__ = {"texts": pa.Array, "gone": pa.Array, "return": pa.Array}
    rows = packed(docs, id_col, text).join(gone, "_key", "left")
    touched, whole = F.col("_gone").isNotNull(), F.col("_row").getField(text)
    row = F.when(touched, F.col("_row").withField(text, F.arrow_udf(shortened, "string")(F.when(touched, whole), F.col("_gone")))).otherwise(F.col("_row"))
    rows = rows.select(touched.alias("_touched"), row.alias("_row"))
    rows = rows.where(~F.col("_touched") | F.col("_row").getField(text).rlike("[^\\x20\\x09-\\x0D]"))
    return sized(rows, docs, text)
