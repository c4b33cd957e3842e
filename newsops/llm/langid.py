"""Language identification by the nearest of several clustered centroids per language.

A text is lower-cased, ASCII characters that are no letters become blanks, and its byte n-grams of
two to four bytes are counted in ``DIMENSIONS`` hashed cells.  The vector is (1 + log count) times the
inverse document frequency, scaled to length one.  Each language's training vectors are clustered
into ``CENTROIDS`` centroids by cosine; a text takes the language of the nearest centroid.  A text
whose cosine falls below the language's learned limit is marked as rejected.

Training reads at most ``SAMPLE`` documents of each language, those with the least seeded hash.  A
null text, or one without a letter, is ``und`` with score 0 and is rejected.  Without any labelled
document every text is ``und``.  Rows are independent, so repeated rows repeat; extra columns are
left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DIMENSIONS, CENTROIDS, SAMPLE, ROUNDS, SEED = 4096, 4, 400, 12, 29
BLOCK = 1 << 20
UNKNOWN = "und"


class Grams:
    """Hashed n-gram counts of texts; holds the byte table, so make one per task."""

    def __init__(self):
        table = bytearray(range(256))
        for b in range(128):
            if not chr(b).isalpha():
                table[b] = 32
        self.table = bytes(table)

    def counts(self, text: str) -> np.ndarray:
        total = np.zeros(DIMENSIONS, dtype=np.float32)
        data = b" " + text.lower().encode().translate(self.table) + b" "
        for begin in range(0, len(data) - 1, BLOCK):
            raw = np.frombuffer(data[begin:begin + BLOCK + 3], np.uint8).astype(np.uint32)
            value = raw
            for n in (1, 2, 3):                        # grams of n + 1 bytes
                value = value[:-1] + (raw[n:] << np.uint32(8 * n)) if raw.size > n else raw[:0]
                own = value[: max(0, min(BLOCK, len(data) - begin - n))]
                cells = (own * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20)
                total += np.bincount(cells, minlength=DIMENSIONS)
        return total


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _scaled(np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf)


@dataclass
class Model:
    languages: list[str]            # one for each centroid
    centroids: np.ndarray
    limits: np.ndarray
    idf: np.ndarray


def training_rows(docs: DataFrame, id_col: str, text: str, lang: str, sample: int = SAMPLE) -> DataFrame:
    """The ``sample`` labelled documents of each language with the least seeded hash.

    Languages are counted first (one small row each), and only hashes below a limit that leaves about
    four times the sample are ranked, so no task gathers more, however many documents there are.
    """
    rows = docs.select(
        F.xxhash64(F.lit(SEED), id_col).alias("_order"), F.col(text).alias("text"), F.col(lang).alias("lang")
    ).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return rows.select("lang", "text")
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], 4.0 * sample / r["count"])])
    near = rows.where(F.pmod(F.col("_order"), F.lit(1 << 30)) / (1 << 30) < F.element_at(shares, F.col("lang")))
    order = W.partitionBy("lang").orderBy("_order", F.xxhash64("text"))
    return near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample).select("lang", "text")


def fit(rows: DataFrame) -> Model:
    """Learn from a bounded table (lang, text): one task per language, then one small row each."""

    def vectors(texts) -> np.ndarray:
        grams = Grams()
        return np.stack([grams.counts(t) for t in texts])

    def frequencies(key, part: pd.DataFrame) -> pd.DataFrame:
        found = (vectors(part["text"]) > 0).sum(axis=0).astype(np.int64)
        return pd.DataFrame({"lang": [key[0]], "n": [len(part)], "found": [found.tobytes()]})

    held = rows.groupBy("lang").applyInPandas(frequencies, "lang string, n bigint, found binary").collect()
    if not held:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0), np.zeros(DIMENSIONS, np.float32))
    n = sum(r.n for r in held)
    found = np.sum([np.frombuffer(r.found, np.int64) for r in held], axis=0)
    idf = np.log((1 + n) / (1 + found)).astype(np.float32) + np.float32(1)

    def clustered(key, part: pd.DataFrame) -> pd.DataFrame:
        data = _weighted(vectors(part["text"].sort_values()), idf)
        k = min(CENTROIDS, len(data))
        centres = data[[0]]
        while len(centres) < k:                        # the vector farthest from all centres so far
            centres = np.vstack([centres, data[[(data @ centres.T).max(axis=1).argmin()]]])
        for _ in range(ROUNDS):
            nearest = (data @ centres.T).argmax(axis=1)
            centres = np.stack([
                _scaled(data[nearest == c].mean(axis=0)) if (nearest == c).any() else centres[c] for c in range(k)
            ])
        best = (data @ centres.T).max(axis=1)
        limit = max(0.0, float(np.quantile(best, 0.01)) / 2)
        return pd.DataFrame({"lang": key[0], "centre": [c.astype(np.float32).tobytes() for c in centres], "limit": limit})

    centres = rows.groupBy("lang").applyInPandas(clustered, "lang string, centre binary, limit double").collect()
    centres.sort(key=lambda r: (r.lang, r.centre))
    return Model(
        [r.lang for r in centres], np.stack([np.frombuffer(r.centre, np.float32) for r in centres]),
        np.array([r.limit for r in centres]), idf,
    )


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``prediction`` (lang, score, rejected) made from the text alone."""
    # Centroids of the learned languages, as plain values: the executors need not have this package.
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.centroids, model.limits, model.idf))

    def nearest(texts):
        import regex

        letter, grams, (languages, centroids, limits, idf) = regex.compile(r"\p{L}"), Grams(), shipped.value
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
        for column in texts:
            out = []
            for begin in range(0, len(column), 256):
                values = column.slice(begin, 256).to_pylist()
                usable = [i for i, v in enumerate(values) if v is not None and languages and letter.search(v)]
                row = [{"lang": UNKNOWN, "score": 0.0, "rejected": True} for _ in values]
                if usable:
                    data = _weighted(np.stack([grams.counts(values[i]) for i in usable]), idf)
                    near = data @ centroids.T
                    best = near.argmax(axis=1)
                    score = np.clip(near[np.arange(len(best)), best], 0, 1)
                    for i, c, s in zip(usable, best.tolist(), score.tolist(), strict=True):
                        row[i] = {"lang": languages[c], "score": round(s, 6), "rejected": s < limits[c]}
                out += row
            yield pa.array(out, kind)

    from collections.abc import Iterator

    nearest.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    returns = "struct<lang: string, score: double, rejected: boolean>"
    return docs.withColumn("prediction", F.arrow_udf(nearest, returns)(F.col(text)))


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the documents outside the held-out third and predict every document."""
    third = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))
    held_out = F.coalesce(third == 1, F.lit(False))
    model = fit(training_rows(docs.where(third != 1), id_col, text, lang))
    rows = predict(docs.select(F.col(id_col), held_out.alias("held_out"), F.col(text).alias("text")), model)
    return rows.select(
        id_col, "held_out", F.col("prediction.lang").alias("lang_pred"), F.col("prediction.score").alias("score"),
        F.col("prediction.rejected").alias("rejected"),
    )
