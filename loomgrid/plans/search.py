"""What a search over signals judges its candidates by: fitness, backtest metrics, scores against a zoo, gates; and how a signal table fits its panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.plans.evaluation import _ALL_ROWS, DAILY_SQL, _rounded, _sql, daily_ic, mutual_information, signal_sql, signal_table
from loomgrid.plans.evaluation import SQL as EVALUATION
from loomgrid.plans.redundancy import SQL as REDUNDANCY
from loomgrid.plans.redundancy import ZOO, _pairs, pair_corr, turnover
from loomgrid.session import stage
from loomgrid.sources.panel import DEFAULT_SPLIT, Split, current_bars
from loomgrid.sources.tables import table

KEY = ["factor", "market"]
# The gates of a candidate in their order, and the largest share of the zoo that may beat it.
RANK_IC, RANK_IR, TURNOVER, CORRELATION, ABOVE = 0.015, 0.3, 1.6, 0.8, 0.95


def _ratio(c: str) -> Column:
    return F.when((F.count(c) > 1) & (F.max(c) > F.min(c)), F.avg(c) / F.stddev_samp(c)).otherwise(0.0)


def signal_fitness(signals: DataFrame) -> DataFrame:
    """Per factor and market: mean IC and rank IC with their ratios, mutual information, scored days and their share; 0 where nothing can be scored."""
    signals = stage(signals, "signals")
    daily = stage(daily_ic(signals), "daily")
    dates = signals.groupBy(*KEY).agg(F.countDistinct("date").alias("dates"))
    out = daily.groupBy(*KEY).agg(F.avg("ic").alias("ic"), _ratio("ic").alias("icir"), F.avg("rank_ic").alias("rank_ic"), _ratio("rank_ic").alias("rank_icir"), F.count("ic").alias("n_days"))
    out = dates.join(out, KEY, "left").join(mutual_information(signals).select(*KEY, "mi"), KEY, "left")
    return out.fillna(0.0, ["ic", "icir", "rank_ic", "rank_icir", "mi"]).fillna(0, ["n_days"]).withColumn("coverage", F.col("n_days") / F.col("dates")).drop("dates")


def search_metrics(signals: DataFrame, zoo: Sequence[str], least: int = 3) -> DataFrame:
    """Per factor and market: rank IC, its ratio, turnover (NULL if it never holds a book), largest correlation with another member of the zoo, scored days."""
    signals = stage(signals, "signals")
    ics = daily_ic(signals).groupBy(*KEY).agg(F.avg("rank_ic").alias("rank_ic"), _ratio("rank_ic").alias("rank_ir"), F.count("rank_ic").alias("n_days"))
    pairs = pair_corr(signals, least).where("f_i <> f_j").groupBy("market", "f_i", "f_j").agg(F.avg("pearson").alias("c"))
    pairs = stage(pairs, "pairs")
    with_zoo = pairs.select("market", F.col("f_i").alias("factor"), F.col("f_j").alias("member"), "c").unionByName(pairs.select("market", F.col("f_j").alias("factor"), F.col("f_i").alias("member"), "c"))
    closest = with_zoo.where(F.col("member").isin(list(zoo))).groupBy(*KEY).agg(F.max(F.abs("c")).alias("max_correlation"))
    out = signals.select(*KEY).distinct().join(ics, KEY, "left").join(turnover(signals).select(*KEY, "turnover"), KEY, "left").join(closest, KEY, "left")
    return out.fillna(0.0, ["rank_ic", "rank_ir", "max_correlation"]).fillna(0, ["n_days"])


def search_scores(metrics: DataFrame, zoo: Sequence[str], temperature: float = 1.0) -> DataFrame:
    """Metrics with four scores in 0..1 (1 - the share of the zoo that is better), their softmax of weakness, and the first gate that fails (empty: none).

    Turnover and correlation are better when lower. An absent turnover is worse than all. The zoo's values of a
    market travel as one array, as long as the zoo.
    """
    rows = metrics.withColumns({"effectiveness": F.col("rank_ic"), "stability": F.col("rank_ir"), "turnover_low": -F.col("turnover"), "diversity": -F.col("max_correlation")})
    dims = ["effectiveness", "stability", "turnover_low", "diversity"]
    zoos = rows.where(F.col("factor").isin(list(zoo))).groupBy("market").agg(*[F.collect_list(d).alias(f"_{d}") for d in dims])
    rows = rows.join(F.broadcast(zoos), "market", "left")
    beaten = {}
    for d in dims:
        held = F.size(F.coalesce(F.col(f"_{d}"), F.array().cast("array<double>")))
        above = F.expr(f"size(filter(_{d}, z -> z > {d}))")
        beaten[d] = F.when(held == 0, 0.5).when(F.col(d).isNull(), 1.0).otherwise(above / held)
    rows = rows.withColumns({f"above_{d}": b for d, b in beaten.items()})
    scores = {d: 1 - F.col(f"above_{d}") for d in dims}
    top = F.greatest(*[F.col(f"above_{d}") for d in dims])
    weights = {d: F.exp((F.col(f"above_{d}") - top) / temperature) for d in dims}
    whole = sum(weights.values(), F.lit(0.0))
    gate = F.when(F.col("rank_ic") < RANK_IC, "rank_ic").when(F.col("rank_ir") < RANK_IR, "rank_ir").when(F.col("turnover").isNull() | (F.col("turnover") > TURNOVER), "turnover")
    gate = gate.when(F.col("max_correlation") >= CORRELATION, "correlation").when(F.col("above_effectiveness") > ABOVE, "rank_ic_pct").when(F.col("above_stability") > ABOVE, "rank_ir_pct").otherwise("")
    return rows.select(*KEY, *[s.alias(f"e_{d}") for d, s in scores.items()], *[(w / whole).alias(f"p_{d}") for d, w in weights.items()], gate.alias("failed_gate"))


def alignment(signals: DataFrame, bars: DataFrame, factor: str, day: Column, split: Split = DEFAULT_SPLIT) -> DataFrame:
    """Per factor and market of a delivered signal table: rows, assets and dates (within the split) that the panel does not have, infinite and finite values.

    Assets and dates are compared as sets, so a dense signal of a sparse panel is no fault. Rows without an asset are counted alone.
    """
    rows = stage(signals.select(F.col(factor).alias("factor"), "market", "asset", day.alias("date"), "value"), "signals")
    assets = bars.select("market", "asset").distinct().withColumn("known_asset", F.lit(True))
    dates = bars.select("market", "date").distinct().withColumn("known_date", F.lit(True))
    counts = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("asset").isNull()).alias("no_asset"), F.count_if(F.abs("value") == float("inf")).alias("n_inf"), F.count_if((F.abs("value") < float("inf")) & ~F.isnan("value")).alias("n_finite"))
    strange = rows.select(*KEY, "asset").where("asset IS NOT NULL").distinct().join(assets, ["market", "asset"], "left_anti").groupBy(*KEY).agg(F.count(F.lit(1)).alias("assets_unknown"))
    lost = rows.where(split.window("date")).select(*KEY, "date").distinct().join(dates, ["market", "date"], "left_anti").groupBy(*KEY).agg(F.count(F.lit(1)).alias("dates_unknown"))
    return counts.join(strange, KEY, "left").join(lost, KEY, "left").fillna(0, ["assets_unknown", "dates_unknown"])


def _alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment(table(spark, folder, "signals"), current_bars(spark, folder), "factor_id", F.to_date("signal_at"))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return search_scores(_rounded(search_metrics(signal_table(spark, folder), ZOO)), ZOO)


QUERIES = {
    "signal_fitness": lambda s, d: _rounded(signal_fitness(signal_table(s, d))),
    "search_metrics": lambda s, d: _rounded(search_metrics(signal_table(s, d), ZOO)),
    "search_scores": lambda s, d: _rounded(_scores(s, d)),
    "signal_alignment": _alignment,
}

_DAYS = f"(WITH {_ALL_ROWS} SELECT factor, market, count(DISTINCT date) AS dates FROM sig GROUP BY ALL)"
_DAILY = f"(WITH {signal_sql()},\n{DAILY_SQL} SELECT * FROM daily)"
_R = lambda c: f"CASE WHEN count({c}) > 1 AND max({c}) > min({c}) THEN avg({c}) / stddev_samp({c}) ELSE 0.0 END"
_FITNESS = f"""SELECT d.factor, d.market, coalesce(i.ic, 0.0) AS ic, coalesce(icir, 0.0) AS icir, coalesce(rank_ic, 0.0) AS rank_ic, coalesce(rank_icir, 0.0) AS rank_icir, coalesce(mi, 0.0) AS mi, coalesce(n_days, 0) AS n_days, coalesce(n_days, 0) / dates AS coverage
  FROM {_DAYS} d LEFT JOIN (SELECT factor, market, avg(ic) AS ic, {_R('ic')} AS icir, avg(rank_ic) AS rank_ic, {_R('rank_ic')} AS rank_icir, count(ic) AS n_days FROM {_DAILY} GROUP BY ALL) i USING (factor, market) LEFT JOIN ({EVALUATION['mutual_info']}) m USING (factor, market)"""
_ZOO = ", ".join(f"'{z}'" for z in ZOO)
_METRICS = f"""SELECT d.factor, d.market, coalesce(rank_ic, 0.0) AS rank_ic, coalesce(rank_ir, 0.0) AS rank_ir, turnover, coalesce(max_correlation, 0.0) AS max_correlation, coalesce(i.n_days, 0) AS n_days FROM {_DAYS} d
  LEFT JOIN (SELECT factor, market, avg(rank_ic) AS rank_ic, {_R('rank_ic')} AS rank_ir, count(rank_ic) AS n_days FROM {_DAILY} GROUP BY ALL) i USING (factor, market) LEFT JOIN ({REDUNDANCY['turnover']}) t USING (factor, market)
  LEFT JOIN (WITH {_pairs(3)}, m AS (SELECT market, f_i, f_j, avg(pearson) AS c FROM pr WHERE f_i <> f_j GROUP BY ALL), fl AS (SELECT market, f_i AS factor, f_j AS member, c FROM m UNION ALL SELECT market, f_j, f_i, c FROM m) SELECT factor, market, max(abs(c)) AS max_correlation FROM fl WHERE member IN ({_ZOO}) GROUP BY ALL) z USING (factor, market)"""
_M = ["rank_ic", "rank_ir", "turnover", "max_correlation"]
_METRIC_SQL = _sql(f"mt AS ({_METRICS})", "SELECT * FROM mt", _M, [*KEY, "n_days"])
_D = {"effectiveness": "rank_ic", "stability": "rank_ir", "turnover_low": "-turnover", "diversity": "-max_correlation"}
_ABOVE = ", ".join(f"CASE WHEN (SELECT count({v}) FROM x z WHERE z.market = x.market AND z.factor IN ({_ZOO})) = 0 THEN 0.5 WHEN {v.replace('-', '-x.') if v[0] == '-' else 'x.' + v} IS NULL THEN 1.0 ELSE (SELECT count_if({v.replace('-', '-z.') if v[0] == '-' else 'z.' + v} > {v.replace('-', '-x.') if v[0] == '-' else 'x.' + v}) / count({v.replace('-', '-z.') if v[0] == '-' else 'z.' + v}) FROM x z WHERE z.market = x.market AND z.factor IN ({_ZOO})) END AS a_{d}" for d, v in _D.items())
_TOP = "greatest(" + ", ".join(f"a_{d}" for d in _D) + ")"
_WHOLE = " + ".join(f"exp(a_{d} - {_TOP})" for d in _D)
_GATE = f"CASE WHEN rank_ic < {RANK_IC} THEN 'rank_ic' WHEN rank_ir < {RANK_IR} THEN 'rank_ir' WHEN turnover IS NULL OR turnover > {TURNOVER} THEN 'turnover' WHEN max_correlation >= {CORRELATION} THEN 'correlation' WHEN a_effectiveness > {ABOVE} THEN 'rank_ic_pct' WHEN a_stability > {ABOVE} THEN 'rank_ir_pct' ELSE '' END"
_CUR = "cur AS (SELECT DISTINCT market, asset, date FROM download_all WHERE date IS NOT NULL AND asset IS NOT NULL)"
SQL = {
    "signal_fitness": _sql(f"ft AS ({_FITNESS})", "SELECT * FROM ft", ["ic", "icir", "rank_ic", "rank_icir", "mi", "coverage"], [*KEY, "n_days"]),
    "search_metrics": _METRIC_SQL,
    "search_scores": _sql(f"x AS ({_METRIC_SQL}), ab AS (SELECT x.*, {_ABOVE} FROM x), sc AS (SELECT factor, market, " + ", ".join(f"1 - a_{d} AS e_{d}, exp(a_{d} - {_TOP}) / ({_WHOLE}) AS p_{d}" for d in _D) + f", {_GATE} AS failed_gate FROM ab)", "SELECT * FROM sc", [f"{k}_{d}" for d in _D for k in "ep"], [*KEY, "failed_gate"]),
    "signal_alignment": f"WITH {_CUR}, sg AS (SELECT factor_id AS factor, market, asset, signal_at::DATE AS date, value FROM signals), ct AS (SELECT factor, market, count(*) AS n_rows, count_if(asset IS NULL) AS no_asset, coalesce(count_if(isinf(value)), 0) AS n_inf, coalesce(count_if(isfinite(value)), 0) AS n_finite FROM sg GROUP BY ALL), ua AS (SELECT factor, market, count(DISTINCT asset) AS u FROM sg WHERE asset IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cur WHERE cur.market = sg.market AND cur.asset = sg.asset) GROUP BY ALL), ud AS (SELECT factor, market, count(DISTINCT date) AS u FROM sg WHERE date BETWEEN DATE '{DEFAULT_SPLIT.train[0]}' AND DATE '{DEFAULT_SPLIT.test[1]}' AND NOT EXISTS (SELECT 1 FROM cur WHERE cur.market = sg.market AND cur.date = sg.date) GROUP BY ALL) SELECT ct.*, coalesce(ua.u, 0) AS assets_unknown, coalesce(ud.u, 0) AS dates_unknown FROM ct LEFT JOIN ua ON ct.factor = ua.factor AND ct.market = ua.market LEFT JOIN ud ON ct.factor = ud.factor AND ct.market = ud.market",
}
