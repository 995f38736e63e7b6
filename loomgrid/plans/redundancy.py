"""How alike are signals? Pairwise correlations per date and on average, diversity, turnover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.stats import average_rank, centred_corr, percent_rank_avg
from loomgrid.plans.evaluation import DAILY, _rounded, _sql, signal_sql, signal_table
from loomgrid.session import stage
from loomgrid.sources.panel import DEFAULT_SPLIT, Split


def _ranked(signals: DataFrame) -> DataFrame:
    """Values with their ranks by date, written once."""
    rows = signals.where(F.col("value").isNotNull()).withColumn("rank", average_rank(F.col("value"), DAILY))
    return stage(rows.select("market", "date", "asset", "factor", "value", "rank"), "ranked")


def pair_corr(signals: DataFrame, least: int = 20, ranked: bool = False) -> DataFrame:
    """Per market, date and pair f_i <= f_j: shared assets, Pearson and Spearman correlation, pairwise complete.

    Ranks are each factor's own over all its assets of the date. NULL below ``least`` shared assets or where a side is flat.
    The factors of an asset and date meet in one row, which makes its pairs; these are summed up before they are shuffled.
    """
    rows = signals if ranked else _ranked(signals)
    cells = rows.groupBy("market", "date", "asset").agg(F.sort_array(F.collect_list(F.struct("factor", "value", "rank"))).alias("c"))
    pairs = "flatten(transform(c, (x, i) -> transform(slice(c, i + 1, size(c) - i), y -> struct(x.factor AS f_i, y.factor AS f_j, x.value AS x, y.value AS y, x.rank AS rx, y.rank AS ry))))"
    both = cells.select("market", "date", F.explode(F.expr(pairs)).alias("p")).select("market", "date", "p.*")
    return both.groupBy("market", "date", "f_i", "f_j").agg(F.count(F.lit(1)).alias("n"), centred_corr(F.col("x"), F.col("y"), least).alias("pearson"), centred_corr(F.col("rx"), F.col("ry"), least).alias("spearman"))


def _matrix(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared counts and pairwise-complete correlations of the columns, from products of masked and centred matrices."""
    m = ~np.isnan(x)
    a = np.where(m, x - np.nanmean(np.where(m.any(axis=0), x, 0.0), axis=0), 0.0)
    w = m.astype(float)
    n = w.T @ w
    with np.errstate(invalid="ignore", divide="ignore"):
        sx, sxx = a.T @ w, (a * a).T @ w
        cov = a.T @ a - sx * sx.T / n
        vx = sxx - sx * sx / n
        c = cov / np.sqrt(vx * vx.T)
    # a side is flat if all its shared values are equal, as in pair_corr; only pairs with next to no variance need the look
    for i, j in np.argwhere((n >= least) & (vx <= 1e-9 * sxx)):
        shared = x[m[:, i] & m[:, j], i]
        if shared.max() == shared.min():
            c[i, j] = c[j, i] = np.nan
    c[(n < least) | ~np.isfinite(c)] = np.nan
    return n, np.clip(c, -1, 1)


def pair_corr_matrix(signals: DataFrame, least: int = 20, ranked: bool = False) -> DataFrame:
    """The same as ``pair_corr`` for hundreds of factors: one matrix of assets by factors per date.

    Dates lie sorted in their partitions and are multiplied one after the other; a task holds one date and one batch.
    """
    names = ["market", "date", "f_i", "f_j", "n", "pearson", "spearman"]

    def of_date(pdf: pd.DataFrame) -> pd.DataFrame:
        factor, factors = pd.factorize(pdf["factor"].to_numpy(dtype=object), sort=True)
        asset, assets = pd.factorize(pdf["asset"].to_numpy(dtype=object))
        cube = np.full((2, len(assets), len(factors)), np.nan)
        cube[0, asset, factor] = pdf["value"].to_numpy(float)
        cube[1, asset, factor] = pdf["rank"].to_numpy(float)
        i, j = np.triu_indices(len(factors))
        n, p = _matrix(cube[0], least)
        _, s = _matrix(cube[1], least)
        columns = (pdf["market"].iloc[0], pdf["date"].iloc[0], factors[i], factors[j], n[i, j].astype("int64"), p[i, j], s[i, j])
        return pd.DataFrame(dict(zip(names, columns)))[n[i, j] > 0]

    def correlate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for pdf in batches:
            pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
            if not len(pdf):
                continue
            edges = np.flatnonzero((pdf["market"] != pdf["market"].shift()) | (pdf["date"] != pdf["date"].shift())).tolist()
            done = [of_date(pdf.iloc[low:high]) for low, high in zip(edges, edges[1:])]
            if done:
                yield pd.concat(done, ignore_index=True)
            left = pdf.iloc[edges[-1] :]
        if left is not None:
            yield of_date(left)

    rows = (signals if ranked else _ranked(signals)).select("market", "date", "asset", "factor", "value", "rank")
    out = rows.repartition("market", "date").sortWithinPartitions("market", "date").mapInPandas(correlate, "market string, date date, f_i string, f_j string, n bigint, pearson double, spearman double")
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("pearson", "spearman")})


def mean_corr(signals: DataFrame, split: Split = DEFAULT_SPLIT, least: int = 20, share: float = 0.5, many: bool = False) -> DataFrame:
    """Per market, segment and pair: mean daily correlations over valid dates and the number of Spearman values.

    A date is valid with at least two factors of ``least`` assets; a factor takes part if it has ``least`` assets on at
    least ``share`` of the valid dates, otherwise its correlations are NULL. ``many`` chooses the matrix form, for
    hundreds of factors; both give the same.
    """
    seg = split.segment()
    ranked = _ranked(signals)
    per = stage(ranked.groupBy("market", "date", "factor").agg((F.count("value") >= least).alias("enough")), "enough")
    dates = per.groupBy("market", "date").agg(F.count_if("enough").alias("k")).where("k >= 2").withColumn("segment", seg).where("segment IS NOT NULL").drop("k")
    valid = dates.groupBy("market", "segment").agg(F.count(F.lit(1)).alias("valid_dates"))
    kept = per.where("enough").join(dates, ["market", "date"]).groupBy("market", "segment", "factor").agg(F.count(F.lit(1)).alias("c")).join(valid, ["market", "segment"]).where(F.col("c") >= share * F.col("valid_dates")).select("market", "segment", "factor")
    daily = (pair_corr_matrix if many else pair_corr)(ranked, least, True).join(dates, ["market", "date"])
    mean = daily.groupBy("market", "segment", "f_i", "f_j").agg(F.avg("pearson").alias("pearson"), F.avg("spearman").alias("spearman"), F.count("spearman").alias("n_pairs"))
    for side in ("f_i", "f_j"):
        mean = mean.join(kept.select("market", "segment", F.col("factor").alias(side), F.lit(True).alias(f"_{side}")), ["market", "segment", side], "left")
    both = F.col("_f_i") & F.col("_f_j")
    return mean.select("market", "segment", "f_i", "f_j", F.when(both, F.col("pearson")).alias("pearson"), F.when(both, F.col("spearman")).alias("spearman"), "n_pairs")


def diversity(signals: DataFrame, zoo: list[str], least: int = 3) -> DataFrame:
    """Largest absolute mean daily correlation of each other factor with one of the zoo, by market; 0 where there is none."""
    pairs = pair_corr(signals, least).groupBy("market", "f_i", "f_j").agg(F.avg("pearson").alias("c"))
    flat = pairs.select("market", F.col("f_i").alias("factor"), F.col("f_j").alias("member"), "c").unionByName(pairs.select("market", F.col("f_j").alias("factor"), F.col("f_i").alias("member"), "c"))
    flat = flat.where(F.col("member").isin(zoo) & ~F.col("factor").isin(zoo))
    return flat.groupBy("market", "factor").agg(F.coalesce(F.max(F.abs("c")), F.lit(0.0)).alias("max_correlation"))


def turnover(signals: DataFrame) -> DataFrame:
    """Mean daily change of the rank-demeaned book with unit gross weight, over days that have a book before them.

    A day's change is taken between consecutive dates of a market, over assets held on both.
    """
    rows = signals.withColumn("p", percent_rank_avg(F.col("value"), DAILY))
    day = Window.partitionBy(*DAILY)
    rows = rows.withColumn("c", F.col("p") - F.avg("p").over(day))
    gross = F.sum(F.abs("c")).over(day)
    rows = rows.withColumn("w", F.when(gross > 1e-12, F.col("c") / gross))
    calendar = rows.select("market", "date").distinct().withColumn("t", F.row_number().over(Window.partitionBy("market").orderBy("date")))
    rows = rows.select("factor", "market", "asset", "date", "w").join(calendar, ["market", "date"])
    line = Window.partitionBy("factor", "market", "asset").orderBy("t")
    rows = rows.withColumn("before", F.when(F.lag("t").over(line) == F.col("t") - 1, F.lag("w").over(line)))
    per = rows.groupBy("factor", "market", "t").agg(F.sum(F.abs(F.col("w") - F.col("before"))).alias("d"), F.bool_or(F.col("w").isNotNull()).alias("live"))
    before = Window.partitionBy("factor", "market").orderBy("t")
    ok = F.col("live") & F.lag("live").over(before) & (F.lag("t").over(before) == F.col("t") - 1)
    return per.withColumn("ok", ok).where("ok").groupBy("factor", "market").agg(F.avg(F.coalesce("d", F.lit(0.0))).alias("turnover"), F.count(F.lit(1)).alias("n_days"))


def return_series_score(signals: DataFrame, zoo: list[str], ceiling: float = 0.5, finite: float = 0.8, unique: float = 0.01) -> DataFrame:
    """|mean IC| of a factor, 0 where too few values are present or distinct, or where its daily book return follows one of the zoo.

    The book's return of a date is the mean target weighted by the demeaned value over its gross; series are correlated over dates.
    """
    day = Window.partitionBy(*DAILY)
    rows = signals.where(F.col("target").isNotNull())
    cover = rows.groupBy("factor", "market").agg((F.count("value") / F.count("target")).alias("filled"), (F.countDistinct("value") / F.countDistinct("target")).alias("kinds"))
    live = rows.where(F.col("value").isNotNull()).withColumn("d", F.col("value") - F.avg("value").over(day))
    daily = live.groupBy(*DAILY).agg(centred_corr(F.col("value"), F.col("target")).alias("ic"), F.try_divide(F.sum(F.col("d") * F.col("target")), F.sum(F.abs("d"))).alias("ret"))
    ic = daily.groupBy("factor", "market").agg(F.abs(F.avg("ic")).alias("ic"))
    held = daily.where(F.col("factor").isin(zoo)).select("market", "date", F.col("factor").alias("member"), F.col("ret").alias("other"))
    like = daily.join(held, ["market", "date"]).where("factor <> member AND ret IS NOT NULL AND other IS NOT NULL").groupBy("factor", "market", "member").agg(F.abs(centred_corr(F.col("ret"), F.col("other"))).alias("c")).groupBy("factor", "market").agg(F.max("c").alias("max_ret_corr"))
    out = ic.join(cover, ["factor", "market"]).join(like, ["factor", "market"], "left")
    bad = (F.col("filled") < finite) | (F.col("kinds") < unique) | (F.coalesce("max_ret_corr", F.lit(0.0)) > ceiling)
    return out.select("factor", "market", F.when(bad | F.col("ic").isNull(), 0.0).otherwise(F.col("ic")).alias("score"), "filled", "kinds", "max_ret_corr")


LEAST = 4
ZOO = ["momentum", "range"]
_q = lambda f: lambda s, d: _rounded(f(signal_table(s, d)))
QUERIES = {
    "pair_corr": _q(lambda t: pair_corr(t, LEAST)),
    "mean_corr": _q(lambda t: mean_corr(t, least=LEAST, many=False)),
    "mean_corr_matrix": _q(lambda t: mean_corr(t, least=LEAST, many=True)),
    "zoo_max_corr": _q(lambda t: diversity(t, ZOO)),
    "turnover": _q(turnover),
    "zoo_score": _q(lambda t: return_series_score(t, ZOO)),
}


def _c(x: str, y: str, least: int) -> str:
    return f"CASE WHEN max({x}) > min({x}) AND max({y}) > min({y}) AND count(*) >= {least} THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END"


_RK = f"{signal_sql()}, rk AS (SELECT *, rank() OVER (PARTITION BY factor, market, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, market, date, value) - 1) / 2.0::DOUBLE AS r FROM sig)"


def _pairs(least: int) -> str:
    return f"{_RK}, pr AS (SELECT a.market, a.date, a.factor AS f_i, b.factor AS f_j, count(*) AS n, {_c('a.value', 'b.value', least)} AS pearson, {_c('a.r', 'b.r', least)} AS spearman FROM rk a JOIN rk b ON a.market = b.market AND a.date = b.date AND a.asset = b.asset AND a.factor <= b.factor GROUP BY ALL)"


_MEAN = f"""{_pairs(LEAST)}, per AS (SELECT market, date, factor, count(*) >= {LEAST} AS enough, {DEFAULT_SPLIT.sql()} AS segment FROM sig GROUP BY ALL),
dt AS (SELECT market, date, segment FROM per WHERE segment IS NOT NULL GROUP BY ALL HAVING count_if(enough) >= 2), va AS (SELECT market, segment, count(*) AS v FROM dt GROUP BY ALL),
kp AS (SELECT p.market, p.segment, p.factor FROM per p JOIN dt ON p.market = dt.market AND p.date = dt.date JOIN va ON p.market = va.market AND p.segment = va.segment WHERE enough GROUP BY p.market, p.segment, p.factor, v HAVING count(*) >= 0.5 * v),
mn AS (SELECT pr.market, segment, f_i, f_j, avg(pearson) AS pearson, avg(spearman) AS spearman, count(spearman) AS n_pairs FROM pr JOIN dt ON pr.market = dt.market AND pr.date = dt.date GROUP BY ALL),
me AS (SELECT m.market, m.segment, f_i, f_j, CASE WHEN a.factor IS NOT NULL AND b.factor IS NOT NULL THEN pearson END AS pearson, CASE WHEN a.factor IS NOT NULL AND b.factor IS NOT NULL THEN spearman END AS spearman, n_pairs FROM mn m
  LEFT JOIN kp a ON m.market = a.market AND m.segment = a.segment AND f_i = a.factor LEFT JOIN kp b ON m.market = b.market AND m.segment = b.segment AND f_j = b.factor)"""
_IN = "('momentum', 'range')"
SQL = {
    "pair_corr": _sql(_pairs(LEAST), "SELECT * FROM pr", ["pearson", "spearman"], ["market", "date", "f_i", "f_j", "n"]),
    "mean_corr": _sql(_MEAN, "SELECT * FROM me", ["pearson", "spearman"], ["market", "segment", "f_i", "f_j", "n_pairs"]),
    "mean_corr_matrix": _sql(_MEAN, "SELECT * FROM me", ["pearson", "spearman"], ["market", "segment", "f_i", "f_j", "n_pairs"]),
    "zoo_max_corr": _sql(f"{_pairs(3)}, m AS (SELECT market, f_i, f_j, avg(pearson) AS c FROM pr GROUP BY ALL), fl AS (SELECT market, f_i AS factor, f_j AS member, c FROM m UNION ALL SELECT market, f_j, f_i, c FROM m)", f"SELECT market, factor, coalesce(max(abs(c)), 0.0) AS max_correlation FROM fl WHERE member IN {_IN} AND factor NOT IN {_IN} GROUP BY ALL", ["max_correlation"], ["market", "factor"]),
    "turnover": _sql(
        signal_sql().replace("WHERE value IS NOT NULL AND abs(value) < 'inf'::DOUBLE)", ")").replace("sig AS (SELECT * FROM", "sig AS (SELECT factor, market, asset, date, CASE WHEN abs(value) < 'inf'::DOUBLE THEN value END AS value, target FROM")
        + """, pp AS (SELECT *, CASE WHEN value IS NOT NULL THEN (rank() OVER (PARTITION BY factor, market, date ORDER BY value NULLS LAST) + (count(*) OVER (PARTITION BY factor, market, date, value) - 1) / 2.0::DOUBLE) / count(value) OVER (PARTITION BY factor, market, date) END AS p FROM sig),
  cc AS (SELECT *, p - avg(p) OVER (PARTITION BY factor, market, date) AS c FROM pp), ww AS (SELECT factor, market, asset, date, CASE WHEN sum(abs(c)) OVER (PARTITION BY factor, market, date) > 1e-12 THEN c / sum(abs(c)) OVER (PARTITION BY factor, market, date) END AS w FROM cc),
  ca AS (SELECT market, date, row_number() OVER (PARTITION BY market ORDER BY date) AS t FROM (SELECT DISTINCT market, date FROM ww)), wt AS (SELECT factor, ww.market, asset, t, w FROM ww JOIN ca ON ww.market = ca.market AND ww.date = ca.date),
  lv AS (SELECT factor, market, t, bool_or(w IS NOT NULL) AS live FROM wt GROUP BY ALL), ds AS (SELECT a.factor, a.market, a.t, sum(abs(a.w - b.w)) AS d FROM wt a LEFT JOIN wt b ON a.factor = b.factor AND a.market = b.market AND a.asset = b.asset AND b.t = a.t - 1 GROUP BY ALL)""",
        "SELECT ds.factor, ds.market, avg(coalesce(d, 0.0)) AS turnover, count(*) AS n_days FROM ds JOIN lv x ON ds.factor = x.factor AND ds.market = x.market AND ds.t = x.t AND x.live JOIN lv y ON ds.factor = y.factor AND ds.market = y.market AND y.t = ds.t - 1 AND y.live GROUP BY ALL",
        ["turnover"],
        ["factor", "market", "n_days"],
    ),
    "zoo_score": _sql(
        signal_sql().replace("WHERE value IS NOT NULL AND abs(value) < 'inf'::DOUBLE)", ")").replace("sig AS (SELECT * FROM", "sig AS (SELECT factor, market, asset, date, CASE WHEN abs(value) < 'inf'::DOUBLE THEN value END AS value, target FROM")
        + f""", tt AS (SELECT * FROM sig WHERE target IS NOT NULL), cv AS (SELECT factor, market, count(value) / count(target) AS filled, count(DISTINCT value) / count(DISTINCT target) AS kinds FROM tt GROUP BY ALL),
  dm AS (SELECT *, value - avg(value) OVER (PARTITION BY factor, market, date) AS d FROM tt WHERE value IS NOT NULL), dy AS (SELECT factor, market, date, {_c('value', 'target', 2)} AS ic, sum(d * target) / nullif(sum(abs(d)), 0) AS ret FROM dm GROUP BY ALL),
  lk AS (SELECT a.factor, a.market, b.factor AS member, abs({_c('a.ret', 'b.ret', 2)}) AS c FROM dy a JOIN dy b ON a.market = b.market AND a.date = b.date AND b.factor IN {_IN} AND a.factor <> b.factor WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY ALL), mx AS (SELECT factor, market, max(c) AS max_ret_corr FROM lk GROUP BY ALL), ii AS (SELECT factor, market, abs(avg(ic)) AS ic FROM dy GROUP BY ALL)""",
        "SELECT factor, market, CASE WHEN filled < 0.8 OR kinds < 0.01 OR coalesce(max_ret_corr, 0.0) > 0.5 OR ic IS NULL THEN 0.0 ELSE ic END AS score, filled, kinds, max_ret_corr FROM ii JOIN cv USING (factor, market) LEFT JOIN mx USING (factor, market)",
        ["score", "filled", "kinds", "max_ret_corr"],
        ["factor", "market"],
    ),
}
