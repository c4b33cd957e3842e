"""Mixing sources to target weights by subset-sum budget fitting.

Targets: the budget is shared among the sources by weight; what exceeds a source's limit is shared
again until no source is above its limit.  Fitting: a source's documents are counted by exact
length.  Whole passes over the source come first; of the remaining budget every length gives the
same share of its documents, rounded down, then the longest that still fit, and a bounded-knapsack
dynamic programme over the lengths fills what is left exactly, or as nearly as any subset can.
Which documents of a length are taken follows a seeded hash.

Documents of size 0 are never taken.  Null sources form one group, after all others.  Repeated rows
are documents of their own.  An empty table gives an empty mix.  Extra columns are kept by
:func:`apply_mix`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import cut
from .common import packed, row_key

WEIGHTS, BUDGET_SHARE, MAX_REPEATS = (3, 1, 2), 1.5, 2
SEED, CELLS, DP_SPAN = 17, 1 << 12, 1 << 16


def text_size(text: str = "text") -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = BUDGET_SHARE, most: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) for a table (source, source_size), one row per source.

    Sources are ranked in code-point order, null last; the ranking is a running count over a range
    partitioning, so it does not gather all sources in one task.
    """
    from ..operators.rank import distributed_position

    placed = distributed_position(
        sizes.select("source", "source_size", F.lit(0).alias("_all")), ["_all"],
        [F.col("source").isNull(), F.col("source").cast("binary")], "_place",
    )
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = cut(placed.select(
        "source", "source_size",
        F.element_at(cycle, ((F.col("_place") - 1) % len(weights) + 1).cast("int")).alias("_weight"),
        (most * F.col("source_size")).cast("double").alias("_limit"),
    ))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    budget, level, full = share * total, 0.0, F.lit(False)
    while True:                                       # ends: each round closes at least one more source
        full = F.col("_limit") <= level * F.col("_weight")
        closed, open_weight, n_closed = table.agg(
            F.coalesce(F.sum(F.when(full, F.col("_limit"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0)),
            F.count(F.when(full, 1)),
        ).first()
        if not open_weight:
            break
        rise = max(0.0, budget - closed) / open_weight
        if rise <= level:
            break
        level = rise
    return table.select(
        "source", "source_size",
        F.when(full, F.col("_limit")).otherwise(level * F.col("_weight")).alias("target"),
    )


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come nearest to ``budget``."""
    whole = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= whole:
        return list(counts)
    taken = [max(0, c * budget // whole - 1) for c in counts]        # one less, so that exact sums have room
    left = budget - sum(n * k for n, k in zip(lengths, taken, strict=True))
    longest_first = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    span = max(DP_SPAN, 2 * max(lengths))
    for i in longest_first:                           # down to what the programme's table holds
        if left > span:
            more = min(counts[i] - taken[i], -(-(left - span) // lengths[i]))
            taken[i] += more
            left -= more * lengths[i]
    open_lengths = [i for i in longest_first if taken[i] < counts[i]]
    limit = left + lengths[open_lengths[-1]]          # one shortest document over the budget at most
    mask, reach, steps = (1 << (limit + 1)) - 1, 1, []
    for i in open_lengths:
        spare, size = counts[i] - taken[i], 1
        while spare and lengths[i] * size <= limit and not reach >> left & 1:
            size = min(size, spare)
            steps.append((i, size, reach))
            reach |= (reach << (lengths[i] * size)) & mask
            spare -= size
            size *= 2
    near = (d for gap in range(limit + 1) for d in (left - gap, left + gap) if 0 <= d <= limit)
    at = next(d for d in near if reach >> d & 1)
    for i, size, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += size
            at -= lengths[i] * size
    return taken


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, **how) -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies and _key."""
    rows = cut(docs.select(
        F.col(id_col), F.col(source).cast("string").alias("source"), text_size(text).alias("size"),
        row_key(id_col, source, text).alias("_key"),
    ))
    counted = cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("documents")))
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("documents")).alias("source_size"))
    aims = cut(targets(sizes, **how))

    def fitted(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", ignore_index=True)
        whole, aim = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        passes = int(aim // whole) if whole else 0
        usable = part["size"] > 0
        extra = [0] * len(part)
        if usable.any():
            chosen = fit(part["size"][usable].tolist(), part["documents"][usable].tolist(), round(aim - passes * whole))
            extra = [0] * (len(part) - len(chosen)) + chosen
        return pd.DataFrame({"source": part["source"], "size": part["size"], "passes": passes * usable, "extra": extra})

    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    plan = counted.alias("a").join(aims.alias("b"), same).select("a.source", "size", "documents", "source_size", "target")
    plan = plan.groupBy("source").applyInPandas(fitted, "source string, size bigint, passes bigint, extra bigint")

    # A length's documents are spread over cells by a seeded hash; whole cells come first and only
    # the last one is ranked, so that one very common length is never gathered in one task.
    group = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    placed = rows.withColumn("_group", group).withColumn("_order", F.xxhash64(F.lit(seed), F.col(id_col)))
    placed = placed.withColumn("_cell", F.pmod(F.col("_order"), F.lit(CELLS)))
    cells = placed.groupBy("_group", "size", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_group", "size").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    shares = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(
        plan.select(group.alias("_group"), "size", "passes", "extra"), ["_group", "size"]
    ).select("_group", "size", "_cell", "passes", (F.col("extra") - F.col("_before")).alias("_take"))
    rank = F.row_number().over(W.partitionBy("_group", "size", "_cell").orderBy("_order", id_col, "_key"))
    chosen = placed.withColumn("_rank", rank).join(shares, ["_group", "size", "_cell"]).select(
        id_col, "source", "size", "_key", (F.col("passes") + (F.col("_rank") <= F.col("_take")).cast("bigint")).alias("copies")
    )
    return chosen.alias("a").join(aims.alias("b"), same).select(
        id_col, "size", "a.source", "source_size", "target", "copies", "_key"
    )


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: every document as many times as it is taken; all columns stay."""
    copies = mix(docs, id_col, text, source, **how).groupBy("_key").agg(
        F.sort_array(F.collect_list(F.col("copies").cast("int"))).alias("_copies")     # rows of equal content
    )
    rows = packed(docs, id_col, source, text).join(copies, "_key")
    rows = rows.withColumn("_place", F.row_number().over(W.partitionBy("_key").orderBy("_key")))
    times = F.element_at("_copies", F.col("_place"))
    return rows.select("_row", F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).select("_row.*")
