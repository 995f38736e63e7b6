"""Inference over backtest curves: runs on a common calendar, block bootstrap, step-down adjustment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.plans.evaluation import SQL as EVALUATION
from loomgrid.plans.evaluation import _rounded, _sql, ic_table, signal_table
from loomgrid.plans.portfolio import LONG, SHORT, TRADING_DAYS, _BM, _backtest, _returns, backtest, benchmark, composite_scores
from loomgrid.session import stage
from loomgrid.sources.panel import market_grid


def run_panel(curves: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """``market, seed, date, ret`` of runs; with a benchmark, in excess of it, a gap in which counts 0. An absent row is no return."""
    rows = curves.select("market", "seed", "date", "net")
    if bench is None:
        return rows.withColumnRenamed("net", "ret")
    return rows.join(bench, ["market", "date"], "left").select("market", "seed", "date", (F.col("net") - F.coalesce("bench", F.lit(0.0))).alias("ret"))


def statistic(rows: DataFrame, stat: str, by: list[str]) -> DataFrame:
    """Annualised mean or Sharpe ratio per run, averaged over a market's seeds, then over markets."""
    if stat == "mean":
        value = F.avg("ret") * TRADING_DAYS
    elif stat == "sharpe":
        value = F.when(F.max("ret") > F.min("ret"), F.avg("ret") / F.stddev_samp("ret") * TRADING_DAYS**0.5)
    else:
        raise ValueError(f"unknown statistic {stat}")
    runs = rows.groupBy(*by, "market", "seed").agg(value.alias("v"))
    return runs.groupBy(*by, "market").agg(F.avg("v").alias("v")).groupBy(*by).agg(F.avg("v").alias("v"))


def block_indices(n: int, block: int, draws: int, seed: int) -> np.ndarray:
    """Rows of each draw: blocks of consecutive rows from random starts, wrapping, cut to n."""
    if n < 1 or block < 1:
        raise ValueError("n and block must be positive")
    starts = np.random.default_rng(seed).integers(0, n, size=(draws, -(-n // block)))
    return ((starts[:, :, None] + np.arange(block)) % n).reshape(draws, -1)[:, :n]


def block_bootstrap(panel: DataFrame, stat: str = "mean", block: int = 20, draws: int = 2000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Pooled statistic with a percentile interval and the shift-method p-value: one row.

    Draws are of days of the common calendar. A draw is the number of times that each day occurs in it, and the
    statistics of a curve are sums over its days with those weights, one matrix product per curve and hundred draws; the drawn
    rows are not materialised. Days and draws are few by nature; curves may be many.
    """
    days = [r[0] for r in panel.select("date").distinct().orderBy("date").collect()]  # trading days
    place, idx = {d: t for t, d in enumerate(days)}, block_indices(len(days), block, draws, seed).astype("int32")

    def curve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at, ret, n = pdf["date"].map(place).to_numpy(), pdf["ret"].to_numpy(float), len(place)
        sums = np.column_stack([np.bincount(at, x, n) for x in (np.ones(len(ret)), ret, ret * ret)])
        parts = []
        for lo in range(0, len(idx), 100):
            rows = idx[lo : lo + 100]
            times = np.bincount((rows + n * np.arange(len(rows))[:, None]).ravel(), minlength=n * len(rows)).reshape(len(rows), n)
            parts.append(times @ sums)
        out = pd.DataFrame(np.concatenate(parts), columns=["n", "s", "q"])
        out.insert(0, "draw", np.arange(len(out), dtype="int32"))
        return out[out["n"] > 0].assign(market=key[0], seed=key[1])

    kinds = {f.name: f.dataType.simpleString() for f in panel.schema}
    rows = panel.where(F.col("ret").isNotNull()).select("market", "seed", "date", "ret")
    sums = rows.groupBy("market", "seed").applyInPandas(curve, f"draw int, n double, s double, q double, market {kinds['market']}, seed {kinds['seed']}")
    mean = F.col("s") / F.col("n")
    if stat == "mean":
        value = mean * TRADING_DAYS
    else:
        variance = (F.col("q") - F.col("n") * mean * mean) / F.when(F.col("n") > 1, F.col("n") - 1)
        value = F.when(variance > 1e-18, mean / F.sqrt(variance) * TRADING_DAYS**0.5)
    drawn = sums.withColumn("v", value).groupBy("draw", "market").agg(F.avg("v").alias("v")).groupBy("draw").agg(F.avg("v").alias("v")).where("v IS NOT NULL")
    estimate = statistic(panel.withColumn("_one", F.lit(1)), stat, ["_one"]).first().v
    return drawn.withColumn("estimate", F.lit(estimate).cast("double")).groupBy("estimate").agg(F.percentile("v", F.lit(alpha / 2)).alias("ci_low"), F.percentile("v", F.lit(1 - alpha / 2)).alias("ci_high"), ((1 + F.count_if(F.abs(F.col("v") - F.col("estimate")) >= F.abs("estimate"))) / (1 + F.count(F.lit(1)))).alias("p_value"), F.count(F.lit(1)).alias("n_boot"))


def holm(tests: DataFrame, by: list[str], p: str = "p_value") -> DataFrame:
    """Adds ``p_holm``: the step-down adjusted p-value, at most 1; NULL stays NULL. A family of tests, ``by``, is one partition."""
    if not by:
        raise ValueError("name the columns of a family")
    known = tests.where(F.col(p).isNotNull())
    family = Window.partitionBy(*by)
    line = family.orderBy(p)
    step = (F.count(F.lit(1)).over(family) - F.row_number().over(line) + 1) * F.col(p)
    adjusted = known.withColumn("_s", step).withColumn("p_holm", F.least(F.max("_s").over(line.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_s")
    return adjusted.unionByName(tests.where(F.col(p).isNull()).withColumn("p_holm", F.lit(None).cast("double")))


def _curves(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs per market: the long-only and the long-short book of the composite."""
    scores, returns = stage(composite_scores(spark, folder), "scores"), stage(_returns(spark, folder), "returns")
    one, two = (backtest(scores, returns, b).select("market", F.lit(seed).alias("seed"), "date", "net") for seed, b in ((0, LONG), (1, SHORT)))
    return one.unionByName(two)


# The published rational approximation of the error function, good to 1.5e-7.
ERROR_P, ERROR_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def two_sided(t: F.Column) -> F.Column:
    """Probability that a standard normal value is as far from 0 as ``t``."""
    x = F.abs(t) / F.sqrt(F.lit(2.0))
    k = 1 / (1 + ERROR_P * x)
    series = F.lit(0.0)
    for a in reversed(ERROR_A):
        series = (series + a) * k
    return F.least(series * F.exp(-x * x), F.lit(1.0))


def holm_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Every signal's HAC t as a two-sided test, adjusted over the signals of a market and segment."""
    rows = _rounded(ic_table(signal_table(spark, folder))).select("factor", "market", "segment", F.round(two_sided(F.col("t_hac")), 10).alias("p_value"))
    return holm(rows, ["market", "segment"])


QUERIES = {
    "run_panel": lambda s, d: _rounded(run_panel(_curves(s, d), benchmark(market_grid(s, d))), 7),
    "pooled_sharpe": lambda s, d: _rounded(statistic(run_panel(_curves(s, d), benchmark(market_grid(s, d))).withColumn("one", F.lit(1)), "sharpe", ["one"]), 6),
    "block_bootstrap": lambda s, d: _rounded(block_bootstrap(stage(run_panel(_curves(s, d), benchmark(market_grid(s, d))), "panel")), 6),
    "holm": lambda s, d: _rounded(holm_signals(s, d)),
}
_SERIES = "0.0::DOUBLE"
for _a in reversed(ERROR_A):
    _SERIES = f"(({_SERIES}) + {_a}::DOUBLE) * k"
_RP = f"{_backtest(LONG)}, {_BM}"
_SHORT = _backtest(SHORT)
_TWO = f"lo AS (WITH {_RP} SELECT market, 0 AS seed, date, net FROM bt), sh AS (WITH {_SHORT} SELECT market, 1 AS seed, date, net FROM bt), bb AS (WITH {_RP} SELECT * FROM bm), cu AS (SELECT * FROM lo UNION ALL SELECT * FROM sh), rp AS (SELECT cu.market, seed, cu.date, net - coalesce(bench, 0.0) AS ret FROM cu LEFT JOIN bb ON cu.market = bb.market AND cu.date = bb.date)"
SQL = {
    "run_panel": _sql(_TWO, "SELECT * FROM rp", ["ret"], ["market", "seed", "date"], 7),
    "pooled_sharpe": _sql(f"{_TWO}, a AS (SELECT market, seed, CASE WHEN max(ret) > min(ret) THEN avg(ret) / stddev_samp(ret) * sqrt(252.0::DOUBLE) END AS v FROM rp GROUP BY ALL), b AS (SELECT market, avg(v) AS v FROM a GROUP BY ALL)", "SELECT 1 AS one, avg(v) AS v FROM b", ["v"], ["one"], 6),
    "holm": _sql(
        f"i AS ({EVALUATION['ic_table']}), x AS (SELECT *, abs(t_hac) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + {ERROR_P} * abs(t_hac) / sqrt(2.0::DOUBLE)) AS k FROM i), t AS (SELECT factor, market, segment, round(least({_SERIES} * exp(-x * x), 1.0), 10) AS p_value FROM x), o AS (SELECT *, row_number() OVER (PARTITION BY market, segment ORDER BY p_value) AS k, count(*) OVER (PARTITION BY market, segment) AS m FROM t WHERE p_value IS NOT NULL), a AS (SELECT factor, market, segment, p_value, least(max((m - k + 1) * p_value) OVER (PARTITION BY market, segment ORDER BY k), 1.0) AS p_holm FROM o UNION ALL SELECT factor, market, segment, p_value, NULL FROM t WHERE p_value IS NULL)",
        "SELECT * FROM a",
        ["p_value", "p_holm"],
        ["factor", "market", "segment"],
    ),
}
