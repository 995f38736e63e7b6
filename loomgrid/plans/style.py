"""Ordinary style exposure: five standardised styles, and what a signal keeps after regressing them out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions.stats import centred_corr, newey_west, ordinal_rank
from loomgrid.plans.evaluation import _rounded, _sql, signal_sql, signal_table
from loomgrid.session import stage
from loomgrid.sources.panel import DEFAULT_SPLIT, ENTITY, GRID_SQL, Split, market_grid

STYLES = ("beta", "volatility", "momentum", "reversal", "liquidity")
WINSOR = (0.01, 0.99)
#: Fewest names of a date in the registered regressions: one degree of freedom is left beside the styles and the intercept.
LEAST = len(STYLES) + 2


def raw_styles(grid: DataFrame) -> DataFrame:
    """beta 252/200, volatility 60/45, momentum 252 to 21, reversal 21, liquidity 20/15, per asset on its market's grid.

    The market's return is the equal-weight mean over members; its variance is taken on the market's own calendar, and
    joined by market and date, of which there is one row per trading day.
    """
    member = F.coalesce("tradable", F.lit(False))
    daily = grid.groupBy("market", "date").agg(F.avg(F.when(member, F.col("returns"))).alias("mkt"))
    line = Window.partitionBy("market").orderBy("date").rowsBetween(-251, 0)
    daily = daily.withColumn("mvar", F.when((F.count("mkt").over(line) >= 200) & (F.max("mkt").over(line) > F.min("mkt").over(line)), F.var_samp("mkt").over(line)))
    rows = grid.join(daily, ["market", "date"])
    w = Window.partitionBy(*ENTITY).orderBy("date")

    def back(n: int) -> Window:
        return w.rowsBetween(-(n - 1), 0)

    both = F.col("returns").isNotNull() & F.col("mkt").isNotNull()
    r, m = F.when(both, F.col("returns")), F.when(both, F.col("mkt"))
    beta = F.when(F.count(r).over(back(252)) >= 200, F.try_divide(F.covar_samp(r, m).over(back(252)), F.col("mvar")))
    vol = F.when(F.count("returns").over(back(60)) >= 45, F.stddev_samp("returns").over(back(60)))
    dollar = F.when(F.col("close") * F.col("volume") > 0, F.col("close") * F.col("volume"))
    liq = F.when(F.count(dollar).over(back(20)) >= 15, F.ln(F.avg(dollar).over(back(20))))
    momentum = F.try_divide(F.lag("close", 21).over(w), F.lag("close", 252).over(w)) - 1
    reversal = -(F.try_divide(F.col("close"), F.lag("close", 21).over(w)) - 1)
    values = dict(zip(STYLES, (beta, vol, momentum, reversal, liq)))
    return rows.withColumns(values).where(F.col("present") & member).select(*ENTITY, "date", *[F.round(s, 9).alias(s) for s in STYLES])


def winsor_z(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ("market", "date"), tails: tuple[float, float] = WINSOR) -> DataFrame:
    """Per group each column clipped to its own quantiles and standardised (sample deviation); NULL where it has no spread."""
    cuts = rows.groupBy(*by).agg(*[F.percentile(c, F.lit(q)).alias(f"_{c}_{k}") for c in columns for k, q in zip("lh", tails)])
    rows = rows.join(cuts, list(by))
    clipped = {c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_{c}_h")), F.col(f"_{c}_l"))) for c in columns}
    rows = rows.withColumns(clipped)
    w = Window.partitionBy(*by)
    return rows.withColumns({c: F.when(F.max(c).over(w) > F.min(c).over(w), (F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w)) for c in columns}).drop(*[f"_{c}_{k}" for c in columns for k in "lh"])


def style_panel(spark: SparkSession, folder: str) -> DataFrame:
    return winsor_z(stage(raw_styles(market_grid(spark, folder)), "raw_styles"), STYLES)


def residuals(signals: DataFrame, styles: DataFrame, names: Sequence[str] = STYLES, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """OLS with intercept of each factor on the styles, per factor, market and date, over assets with all values.

    Moments of a date are summed in the engine; the (1 + k) x (1 + k) systems are then solved in batches, each row
    of which is one regression, by the pseudo-inverse (minimum norm where styles are collinear). Returns the rows with
    their residual, and per regression n, r2, adj_r2.
    """
    key = ["factor", "market", "date"]
    rows = signals.where(F.col("value").isNotNull()).join(styles.dropna(subset=list(names)), ["market", "asset", "date"])
    x = [F.lit(1.0), *[F.col(s) for s in names]]
    k = len(x)
    grams = F.array(*[F.sum(x[i] * x[j]) for i in range(k) for j in range(k)]).alias("gram")
    sums = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), grams, F.array(*[F.sum(v * F.col("value")) for v in x]).alias("xy"), F.avg("value").alias("mean")).where(F.col("n") >= least)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                g = np.stack(pdf["gram"].to_numpy()).reshape(-1, k, k).astype(float)
                b = np.stack(pdf["xy"].to_numpy()).astype(float)
                pdf["coef"] = list(np.einsum("nij,nj->ni", np.linalg.pinv(g, hermitian=True), b))
                yield pdf[[*key, "n", "mean", "coef"]]

    fits = stage(sums.mapInPandas(solve, "factor string, market string, date date, n bigint, mean double, coef array<double>"), "fits")
    fitted = F.col("coef")[0]
    for i, s in enumerate(names):
        fitted = fitted + F.col("coef")[i + 1] * F.col(s)
    out = rows.join(fits, key).withColumn("residual", F.col("value") - fitted)
    quality = out.groupBy(*key).agg(F.first("n").alias("n"), F.sum(F.col("residual") * F.col("residual")).alias("sse"), F.sum((F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean"))).alias("sst"), (F.max("value") > F.min("value")).alias("moves"))
    r2 = F.when(F.col("moves") & (F.col("sst") > 0), 1 - F.col("sse") / F.col("sst"))
    quality = quality.select(*key, "n", r2.alias("r2"), (1 - (1 - r2) * (F.col("n") - 1) / F.greatest(F.col("n") - k, F.lit(1))).alias("adj_r2"))
    return out.select(*key, "asset", "value", "target", "residual"), quality


def style_summary(signals: DataFrame, styles: DataFrame, split: Split = DEFAULT_SPLIT, least: int = 30, lags: int = 25, names: Sequence[str] = STYLES) -> DataFrame:
    """Per factor, market and segment: valid dates, mean R2, IC and rank IC before and after, their difference and its HAC t.

    Ranks here are ordinal (ties in asset order), over assets with a target.
    """
    at = ["market", "asset", "date"]
    styles = styles.dropna(subset=list(names)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("market", "date")))
    styles = stage(styles.where(F.col("_n") >= least).drop("_n"), "styles")  # no other row enters a regression
    signals = signals.where(F.col("value").isNotNull()).join(styles.select(*at), at, "left_semi")
    rows, quality = residuals(stage(signals, "signals"), styles, names, least)
    key = ["factor", "market", "date"]
    both = rows.where(F.col("target").isNotNull())
    both = both.withColumns({f"r_{c}": ordinal_rank(F.col(c), key, "asset") for c in ("value", "residual", "target")})
    daily = both.groupBy(*key).agg(
        centred_corr(F.col("value"), F.col("target")).alias("ic_raw"),
        F.when(F.stddev_samp("residual") > 1e-9 * F.stddev_samp("value"), centred_corr(F.col("residual"), F.col("target"))).alias("ic_res"),
        centred_corr(F.col("r_value"), F.col("r_target")).alias("rank_ic_raw"),
        centred_corr(F.col("r_residual"), F.col("r_target")).alias("rank_ic_res"),
        (F.stddev_samp("residual") <= 1e-9 * F.stddev_samp("value")).cast("double").alias("degenerate"),
        (F.max("value") == F.min("value")).cast("double").alias("flat"),
    )
    daily = daily.join(quality, key).withColumn("segment", split.segment()).where("segment IS NOT NULL").withColumn("delta", F.col("ic_res") - F.col("ic_raw"))
    daily = stage(daily, "style")  # one row per regression, read by three aggregations
    by = ["factor", "market", "segment"]
    out = daily.groupBy(*by).agg(F.count("ic_res").alias("valid_dates"), F.avg("n").alias("mean_obs"), F.avg("degenerate").alias("degenerate_rate"), F.avg("flat").alias("flat_rate"), *[F.avg(c).alias(c) for c in ("r2", "adj_r2", "ic_raw", "ic_res", "rank_ic_raw", "rank_ic_res")], F.avg("delta").alias("delta_ic"))
    for c, name in (("ic_res", "t_hac_ic_res"), ("delta", "t_hac_delta")):
        out = out.join(newey_west(daily, by, "date", c, lags).select(*by, F.col("t_hac").alias(name)), by, "left")
    return out


def coverage(styles: DataFrame) -> DataFrame:
    """Share of a date's members that have all five styles."""
    full = F.lit(True)
    for s in STYLES:
        full = full & F.col(s).isNotNull()
    return styles.groupBy("market", "date").agg(F.avg(full.cast("double")).alias("share"))


def one_style_r2(signals: DataFrame, styles: DataFrame, name: str, least: int = 3) -> DataFrame:
    """R2 on a single style in closed form, the squared correlation."""
    rows = signals.where(F.col("value").isNotNull()).join(styles.where(F.col(name).isNotNull()).select("market", "asset", "date", name), ["market", "asset", "date"])
    c = centred_corr(F.col("value"), F.col(name), least)
    return rows.groupBy("factor", "market", "date").agg(F.count(F.lit(1)).alias("n"), (c * c).alias("r2"))


NAMES = ("momentum", "volume_shock", "range")
QUERIES = {
    "style_raw": lambda s, d: _rounded(raw_styles(market_grid(s, d)), 6),
    "style_panel": lambda s, d: _rounded(style_panel(s, d), 6),
    "style_coverage": lambda s, d: _rounded(coverage(style_panel(s, d))),
    "style_r2_volatility": lambda s, d: _rounded(one_style_r2(signal_table(s, d, NAMES), style_panel(s, d), "volatility"), 6),
    "style_summary": lambda s, d: _rounded(style_summary(signal_table(s, d), style_panel(s, d), least=LEAST), 6),
}

_B = lambda n: f"OVER (PARTITION BY g.market, asset ORDER BY g.date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_STYLE = f"""mk AS (SELECT market, date, avg(CASE WHEN coalesce(tradable, false) THEN returns END) AS mkt FROM grid GROUP BY ALL),
mv AS (SELECT *, CASE WHEN count(mkt) OVER w >= 200 AND max(mkt) OVER w > min(mkt) OVER w THEN var_samp(mkt) OVER w END AS mvar FROM mk WINDOW w AS (PARTITION BY market ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
gm AS (SELECT grid.*, mkt, mvar, CASE WHEN returns IS NOT NULL AND mkt IS NOT NULL THEN returns END AS rr, CASE WHEN returns IS NOT NULL AND mkt IS NOT NULL THEN mkt END AS mm, CASE WHEN close * volume > 0 THEN close * volume END AS dollar FROM grid JOIN mv ON grid.market = mv.market AND grid.date = mv.date),
rs AS (SELECT market, asset, date, present, tradable,
  CASE WHEN count(rr) {_B(252)} >= 200 THEN covar_samp(rr, mm) {_B(252)} / nullif(mvar, 0) END AS beta, CASE WHEN count(returns) {_B(60)} >= 45 THEN stddev_samp(returns) {_B(60)} END AS volatility,
  lag(close, 21) OVER o / nullif(lag(close, 252) OVER o, 0) - 1 AS momentum, -(close / nullif(lag(close, 21) OVER o, 0) - 1) AS reversal, CASE WHEN count(dollar) {_B(20)} >= 15 THEN ln(avg(dollar) {_B(20)}) END AS liquidity
  FROM gm g WINDOW o AS (PARTITION BY market, asset ORDER BY date)),
st AS (SELECT market, asset, date, {', '.join(f'round({s}, 9) AS {s}' for s in STYLES)} FROM rs WHERE present AND coalesce(tradable, false)),
ct AS (SELECT market, date, {', '.join(f'quantile_cont({s}, {q}) AS {s}_{k}' for s in STYLES for k, q in zip('lh', WINSOR))} FROM st GROUP BY ALL),
cl AS (SELECT st.market, asset, st.date, {', '.join(f'CASE WHEN {s} IS NOT NULL THEN greatest(least({s}, {s}_h), {s}_l) END AS {s}' for s in STYLES)} FROM st JOIN ct ON st.market = ct.market AND st.date = ct.date),
sp AS (SELECT market, asset, date, {', '.join(f'CASE WHEN max({s}) OVER w > min({s}) OVER w THEN ({s} - avg({s}) OVER w) / stddev_samp({s}) OVER w END AS {s}' for s in STYLES)} FROM cl WINDOW w AS (PARTITION BY market, date))"""
_K = ["market", "asset", "date"]
SQL = {
    "style_raw": _sql(f"{GRID_SQL}, {_STYLE}", "SELECT * FROM st", list(STYLES), _K, 6),
    "style_panel": _sql(f"{GRID_SQL}, {_STYLE}", "SELECT * FROM sp", list(STYLES), _K, 6),
    "style_coverage": _sql(f"{GRID_SQL}, {_STYLE}", "SELECT market, date, avg((" + " AND ".join(f"{s} IS NOT NULL" for s in STYLES) + ")::INT) AS share FROM sp GROUP BY ALL", ["share"], ["market", "date"]),
    "style_r2_volatility": _sql(f"{signal_sql(NAMES)}, {_STYLE}", "SELECT factor, s.market, s.date, count(*) AS n, CASE WHEN max(value) > min(value) AND max(volatility) > min(volatility) AND count(*) >= 3 THEN (covar_pop(value, volatility) / nullif(stddev_pop(value) * stddev_pop(volatility), 0)) ** 2 END AS r2 FROM sig s JOIN sp ON s.market = sp.market AND s.asset = sp.asset AND s.date = sp.date WHERE volatility IS NOT NULL GROUP BY ALL", ["r2"], ["factor", "market", "date", "n"], 6),
}
