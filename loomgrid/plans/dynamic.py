"""A composite refitted every day on what was known: expanding moments, daily choice of factors, least squares."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.plans.evaluation import DAILY, _rounded, daily_ic, signal_table

#: Days between the last day fitted on and the day predicted: the horizon of the target and one.
SHIFT = 21


def dynamic_combination(signals: DataFrame, names: Sequence[str], top: int = 10, shift: int = SHIFT, least_ic: float = 0.02, least_ratio: float = 0.2) -> DataFrame:
    """``market, asset, date, score``: each day's standardised factors combined with coefficients fitted up to ``shift`` days before.

    Per day the factors are ranked by |mean rank IC / its deviation| so far; those with a mean above ``least_ic`` and a ratio
    above ``least_ratio``, up to ``top``, enter, or the first one alone. Coefficients with an intercept come from the
    expanding sums of cross-products, which are daily sums accumulated by one window per market; the small systems
    of all days are solved in batches. Days without a rank IC count 0; missing factor values are 0 after standardising.
    """
    k, names = len(names), list(names)
    rows = signals.where(F.col("factor").isin(names))
    day = Window.partitionBy(*DAILY)
    z = F.when(F.max("value").over(day) > F.min("value").over(day), (F.col("value") - F.avg("value").over(day)) / F.stddev_samp("value").over(day))
    wide = rows.withColumn("z", z).groupBy("market", "asset", "date").agg(F.max("target").alias("y"), *[F.coalesce(F.max(F.when(F.col("factor") == n, F.col("z"))), F.lit(0.0)).alias(f"z{i}") for i, n in enumerate(names)])
    x = [*[F.col(f"z{i}") for i in range(k)], F.lit(1.0)]
    known = F.col("y").isNotNull()
    sums = wide.groupBy("market", "date").agg(
        *[F.sum(F.when(known, x[i] * x[j]).otherwise(0.0)).alias(f"g{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)],
        *[F.sum(F.when(known, x[i] * F.col("y")).otherwise(0.0)).alias(f"b{i}") for i in range(k + 1)],
    )
    ric = daily_ic(rows).groupBy("market", "date").agg(*[F.coalesce(F.max(F.when(F.col("factor") == n, F.col("rank_ic"))), F.lit(0.0)).alias(f"r{i}") for i, n in enumerate(names)])
    sums = sums.join(ric, ["market", "date"], "left").fillna(0.0)
    past = Window.partitionBy("market").orderBy("date").rowsBetween(Window.unboundedPreceding, -shift - 1)
    grams = [c for c in sums.columns if c[0] in "gb" and c[1].isdigit()]
    state = sums.select("market", "date", *[F.sum(c).over(past).alias(c) for c in grams], *[f(f"r{i}").over(past).alias(f"{a}{i}") for i in range(k) for f, a in ((F.avg, "m"), (F.stddev_samp, "s"))]).where("s0 IS NOT NULL")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            coefs = []
            for r in pdf.to_dict("records"):
                m, s = (np.array([r[f"{a}{i}"] for i in range(k)], float) for a in "ms")
                ratio = np.divide(m, s, out=np.zeros(k), where=s > 0)
                order = np.argsort(-np.abs(ratio), kind="stable")
                good = [i for i in order if m[i] > least_ic and ratio[i] > least_ratio][:top] or [order[0]]
                use = [*good, k]
                gram = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in use] for i in use], float)
                c = np.zeros(k + 1)
                c[use] = np.linalg.pinv(gram, hermitian=True) @ np.array([r[f"b{i}"] for i in use], float)
                coefs.append(c.tolist())
            yield pd.DataFrame({"market": pdf["market"], "date": pdf["date"], "coef": coefs})

    fits = state.mapInPandas(solve, "market string, date date, coef array<double>")
    score = F.col("coef")[k]
    for i in range(k):
        score = score + F.col("coef")[i] * F.col(f"z{i}")
    return wide.join(fits, ["market", "date"]).select("market", "asset", "date", score.alias("score"))


NAMES = ("momentum", "reversal", "volume_shock", "range")
QUERIES = {"dynamic_combination": lambda s, d: _rounded(dynamic_combination(signal_table(s, d, NAMES), NAMES), 7)}
SQL: dict[str, str] = {}
