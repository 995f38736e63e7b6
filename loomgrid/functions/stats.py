"""Statistics as column expressions: correlation, ranks, HAC t-statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def centred_corr(x: Column, y: Column, least: int = 2) -> Column:
    """Pearson correlation of a group; NULL with fewer than ``least`` pairs or a constant side. Pairs must be complete."""
    moves = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(moves & (F.count(x) >= least), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def average_rank(x: Column, by: Sequence[str]) -> Column:
    """Rank with ties averaged among the rows of ``by``; x must not be NULL."""
    order = Window.partitionBy(*by).orderBy(x)
    return F.rank().over(order) + (F.count(x).over(order.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / F.lit(2.0)


def percent_rank_avg(x: Column, by: Sequence[str]) -> Column:
    """Average rank over the number of values, in (0, 1]; NULL for NULL."""
    order = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    ties = F.count(x).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(order) + (ties - 1) / F.lit(2.0)) / F.count(x).over(Window.partitionBy(*by)))


def ordinal_rank(x: Column, by: Sequence[str], then: str) -> Column:
    """0-based position without tie averaging, ties in the order of ``then``."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(x.asc_nulls_last(), F.col(then))) - 1


def newey_west(series: DataFrame, by: Sequence[str], day: str, value: str, lags: int = 25) -> DataFrame:
    """Per group: n, mean and the t-statistic of the mean with a Bartlett-kernel long-run variance.

    Lags are positions among the rows that have a value. NULL with fewer than 3 values or a variance that is not positive.
    """
    rows = series.where(F.col(value).isNotNull()).select(*by, day, F.col(value).alias("_v"))
    whole, line = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(day)
    rows = rows.withColumn("_c", F.col("_v") - F.avg("_v").over(whole)).withColumn("_n", F.count("_v").over(whole))
    top = F.least(F.lit(lags), F.col("_n") - 1)
    rows = rows.withColumns({f"_l{k}": F.lag("_c", k).over(line) for k in range(1, lags + 1)})
    terms = F.col("_c") * F.col("_c")
    for k in range(1, lags + 1):
        terms = terms + F.when(top >= k, 2 * (1 - k / (top + 1)) * F.col("_c") * F.coalesce(F.col(f"_l{k}"), F.lit(0.0))).otherwise(F.lit(0.0))
    out = rows.withColumn("_t", terms).groupBy(*by).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.sum("_t").alias("_s"))
    variance = F.col("_s") / F.col("n")
    return out.select(*by, "n", "mean", F.when((F.col("n") >= 3) & (variance > 1e-18), F.col("mean") / F.sqrt(variance / F.col("n"))).alias("t_hac"))
