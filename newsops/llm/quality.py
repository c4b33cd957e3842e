"""Quality rules: word and line figures of each text, and line frequency across a host's documents.

Every line's white space is normalised and the line hashed.  For each host, the distinct documents
(by content, so that exact copies count once) that hold a line are counted; a line held by at least
``MIN_DOCUMENTS`` of them and by more than ``MAX_SHARE`` of the host's documents is boilerplate.
Such lines are removed; a document that keeps less than ``MIN_LEFT`` of its words is depleted and is
rejected, as is one that fails the base rules (too few words, or too many repeated word windows).

A null text has no words and fails the base rules; null and empty hosts are one host; repeated rows
each get the verdict; extra columns are left out of the figures and kept by :func:`apply_rules`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import packed, row_key, sized
from .hashing import Words, windows

# Parameters of the rules.
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 50, 50, 3
MIN_DOCUMENTS, MAX_SHARE, MIN_LEFT = 20, 0.01, 0.30
SYMBOLS = b"#*$%&|<>"

_COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
_LINES = "array<struct<h: bigint, words: bigint>>"


def line_spans(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every line with a word: its number, and the range of its words."""
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line = np.searchsorted(breaks, starts)
    begins = np.flatnonzero(np.diff(line, prepend=-1))
    return line[begins], begins, np.append(begins[1:], len(starts)).astype(np.int64)[: len(begins)]


def _figures(words: Words, symbol: np.ndarray, data: bytes):
    raw = np.frombuffer(data, np.uint8)
    starts, ends, hashes = words(data)
    n = len(starts)
    if not n:
        return (0, 0, int(symbol[raw].sum()), 0, 0), []
    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    grams = windows(hashes, WINDOW) if n >= WINDOW else hashes[:0]
    covered = np.zeros(n, dtype=bool)
    if grams.size:
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(grams.size, dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(WINDOW):
            covered[k:k + grams.size] |= twice
    number, begins, stops = line_spans(data, starts)
    lines = data.split(b"\n")
    raw_lines = [lines[i] for i in number]
    whole = words.runs(hashes, begins, stops).view(np.int64)
    sizes: dict[int, int] = {}
    for h, k in zip(whole.tolist(), (stops - begins).tolist(), strict=True):
        sizes[h] = sizes.get(h, 0) + k
    counts = (
        n, int((heads[ends] - heads[starts]).sum()), int(symbol[raw].sum()),
        len(raw_lines) - len(set(raw_lines)), int(covered.sum()),
    )
    return counts, [{"h": h, "words": k} for h, k in sizes.items()]


def figures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: id, _key, _host, _content, the five figures, base_failed, _lines."""
    field = docs.schema[id_col]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = docs.select(
        F.col(id_col), row_key(id_col, host, text).alias("_key"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"),
        row_key(text).alias("_content"), F.col(text).cast("binary").alias("_text"),
    )

    def measured(batches):
        words, symbol = Words(), np.zeros(256, dtype=np.int64)
        symbol[list(SYMBOLS)] = 1
        kind = pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int64())]))
        for batch in batches:
            found = [_figures(words, symbol, x.as_py() or b"") for x in batch.column(4)]
            counts = list(zip(*[x[0] for x in found], strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(4)], *[pa.array(c, pa.int64()) for c in counts],
                 pa.array([x[1] for x in found], kind)],
                [id_col, "_key", "_host", "_content", *names, "_lines"],
            )

    rows = kept.mapInArrow(
        measured,
        f"`{id_col}` {field.dataType.simpleString()}, _key binary, _host string, _content binary, {_COUNTS}, _lines {_LINES}",
    )
    return rows.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")),
    )


def frequent_lines(
    rows: DataFrame, min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE
) -> DataFrame:
    """(_host, h, documents): lines above the limits.  Counts are pre-aggregated per task."""
    held = rows.select("_host", "_content", F.explode("_lines.h").alias("h"))
    lines = held.groupBy("_host", "h").agg(F.count_distinct("_content").alias("documents"))
    hosts = rows.groupBy("_host").agg(F.count_distinct("_content").alias("of"))
    return (
        lines.where(F.col("documents") >= min_documents)
        .join(hosts, "_host")
        .where(F.col("documents") > max_share * F.col("of"))
        .select("_host", "h", "documents")
    )


def verdicts(rows: DataFrame, min_left: float = MIN_LEFT) -> DataFrame:
    """``rows`` of :func:`figures` with lost_words, _frequent (hashes of removed lines) and kept."""
    rows = cut(rows)
    frequent = frequent_lines(rows)
    held = rows.select("_key", "_host", F.explode("_lines").alias("line")).select("_key", "_host", "line.*")
    lost = (
        held.join(frequent, ["_host", "h"])
        .groupBy("_key", "h").agg(F.max("words").alias("words"))      # repeated rows share a key
        .groupBy("_key").agg(F.sum("words").alias("lost_words"), F.collect_set("h").alias("_frequent"))
    )
    judged = rows.drop("_lines", "_content", "_host").join(lost, "_key", "left").withColumn(
        "lost_words", F.coalesce("lost_words", F.lit(0))
    )
    depleted = (F.col("n_words") - F.col("lost_words")) < min_left * F.col("n_words")
    return judged.withColumn("kept", ~F.col("base_failed") & ~depleted)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The documents that the rules keep, without their boilerplate lines; all columns stay.

    ``n_chars``, where the table has it, follows the new text.
    """
    judged = verdicts(figures(docs, id_col, text, host)).select("_key", "kept", "_frequent").where("kept")
    judged = judged.groupBy("_key").agg(F.first("_frequent").alias("_frequent"))

    def cleaned(texts: pa.Array, frequent: pa.Array) -> pa.Array:
        words, out = Words(), []
        for value, hashes in zip(texts.to_pylist(), frequent.to_pylist(), strict=True):
            if value and hashes:
                data = value.encode()
                starts, _, own = words(data)
                number, begins, stops = line_spans(data, starts)
                gone = np.isin(words.runs(own, begins, stops).view(np.int64), np.array(hashes, dtype=np.int64))
                drop = set(number[gone].tolist())
                value = "\n".join(x for i, x in enumerate(value.split("\n")) if i not in drop)
            out.append(value)
        return pa.array(out, pa.string())

    cleaned.__annotations__ = {"texts": pa.Array, "frequent": pa.Array, "return": pa.Array}
    rows = packed(docs, id_col, host, text).join(judged, "_key")
    whole = F.col("_row").getField(text)
    row = F.when(F.col("_frequent").isNull(), F.col("_row")).otherwise(
        F.col("_row").withField(text, F.arrow_udf(cleaned, "string")(F.when(F.col("_frequent").isNotNull(), whole), F.col("_frequent")))
    )
    return sized(rows.select(row.alias("_row")), docs, text)
