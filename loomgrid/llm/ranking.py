"""One ranking from several differently scaled scores, by robust rank aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.ordering import running_total
from loomgrid.session import stage

#: A value held by at least one in HOT of all rows is joined by broadcast; there are at most HOT of them per score.
HOT = 1000


def _power(x: Column, n: int) -> Column:
    out = F.lit(1.0)
    for _ in range(n):
        out = out * x
    return out


def order_probability(x: Column, k: int, m: int) -> Column:
    """P(the k-th smallest of m uniform ranks is at most x), the beta distribution function with parameters k, m-k+1."""
    out = F.lit(0.0)
    for j in range(k, m + 1):
        out = out + F.lit(float(comb(m, j))) * _power(x, j) * _power(1.0 - x, m - j)
    return out


def normalised_ranks(items: DataFrame, id: str, scores: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """``id`` and per score ``r_<score>`` in (0, 1], 1 the worst: average rank from the greatest value down / number of values.

    Ranks are made from distinct values and their counts, which are pre-aggregated, laid out in one global order
    and summed up; a value that a third of all rows share is one row there. Values then rejoin the items:
    those shared by many through a broadcast of at most HOT per score, all others by a shuffle on the value.
    Missing values (null or NaN) get rank 1.
    """
    scores, within = list(scores), list(within)
    wn = [f"_w{i}" for i in range(len(within))]
    cells = F.array(*[F.struct(F.lit(i).alias("s"), F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + 0.0).alias("v")) for i, c in enumerate(scores)])
    long = items.select(F.col(id).alias("_id"), *[F.col(w).alias(n) for w, n in zip(within, wn)], F.explode(cells).alias("_x")).select("_id", *wn, F.col("_x.s").alias("_s"), F.col("_x.v").alias("_v"))
    held = long.where(F.col("_v").isNotNull())
    counts = held.groupBy(*wn, "_s", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_total(counts, [*wn, "_s"], [F.col("_v").desc()], "_c", "_before", "_n")
    ranked = stage(ranked.withColumn("_r", (F.col("_before") + (F.col("_c") + 1) / 2.0) / F.col("_n")).select(*[F.col(n).alias(f"_j{n}") for n in wn], F.col("_s").alias("_js"), F.col("_v").alias("_jv"), "_c", "_r"), "ranks")
    whole = ranked.groupBy().agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("t")).first().t
    on = [F.col("_s") == F.col("_js"), F.col("_v") == F.col("_jv"), *[F.col(n).eqNullSafe(F.col(f"_j{n}")) for n in wn]]
    hot = ranked.where(F.col("_c") * HOT >= F.lit(whole) / len(scores))
    common = held.join(F.broadcast(hot), on, "left")
    found = common.where(F.col("_r").isNotNull()).select("_id", "_s", "_r")
    rest = common.where(F.col("_r").isNull()).select("_id", *wn, "_s", "_v").join(ranked, on).select("_id", "_s", "_r")
    lost = long.where(F.col("_v").isNull()).select("_id", "_s", F.lit(1.0).alias("_r"))
    wide = found.unionByName(rest).unionByName(lost).groupBy("_id")
    return wide.agg(*[F.max(F.when(F.col("_s") == i, F.col("_r"))).alias(f"r_{c}") for i, c in enumerate(scores)]).withColumnRenamed("_id", id)


def aggregate_ranking(items: DataFrame, id: str, scores: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """All items in one order: ``position`` (from 1), ``id``, ``r_<score>``, ``significance``, ``mean_rank``.

    Robust rank aggregation: an item's m normalised ranks are sorted; for the k-th smallest the probability that
    the k-th of m uniform ranks is as small is evaluated; the smallest of these times m (at most 1) is its
    significance. Items are ordered by significance, then mean rank, then id. Only ranks enter, so no
    monotone change of a score's scale changes anything; with ``within``, ranks are taken inside each such group,
    so neither does a scale that differs between groups.

    Nulls and NaN: a missing score counts as the worst rank; an item without any score has significance 1. Ties get
    average ranks. Exact duplicate rows are one item; rows with a null id are no items; of an id with
    contradicting rows each score counts with its worst rank. Empty in, empty out.
    """
    scores, within = list(scores), list(within)
    rows = items.where(F.col(id).isNotNull()).select(id, *within, *scores).dropDuplicates()
    ranks = normalised_ranks(rows, id, scores, within)
    m = len(scores)
    ordered = F.array_sort(F.array(*[F.col(f"r_{c}") for c in scores]))
    ranks = ranks.withColumn("_sorted", ordered)
    least = F.least(*[order_probability(F.col("_sorted")[k - 1], k, m) for k in range(1, m + 1)]) if m > 1 else F.col("_sorted")[0]
    mean = F.col(f"r_{scores[0]}")
    for c in scores[1:]:
        mean = mean + F.col(f"r_{c}")
    done = ranks.withColumn("significance", F.least(least * m, F.lit(1.0))).withColumn("mean_rank", mean / m).drop("_sorted")
    placed = running_total(done, [], [F.col("significance"), F.col("mean_rank"), F.col(id)], None, "_before")
    return placed.select((F.col("_before") + 1).cast("bigint").alias("position"), id, *[f"r_{c}" for c in scores], "significance", "mean_rank")
