"""Does a signal predict? Daily and segment information coefficients, tests, admission and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions.stats import average_rank, centred_corr, newey_west, percent_rank_avg
from loomgrid.plans.compile import evaluate
from loomgrid.plans.dialect import to_sql
from loomgrid.plans.factors import SIGNALS, stable, stable_sql
from loomgrid.session import stage
from loomgrid.sources.panel import DEFAULT_SPLIT, GRID_SQL, Split, market_grid

DAILY = ("factor", "market", "date")


def signal_table(spark: SparkSession, folder: str, names: Sequence[str] = tuple(SIGNALS), members: bool = True) -> DataFrame:
    """Signals in long form on the rows of the panel: factor, market, asset, date, value, target; outside the universe there is none."""
    wide = evaluate(market_grid(spark, folder), {n: SIGNALS[n] for n in names}, keep=["present", "tradable", "target"])
    wide = wide.where(F.col("present") & F.coalesce("tradable", F.lit(False)) if members else F.col("present"))
    pairs = F.array(*[F.struct(F.lit(n).alias("factor"), stable(F.col(n)).alias("value")) for n in names])
    long = wide.select("market", "asset", "date", F.round("target", 10).alias("target"), F.explode(pairs).alias("s"))
    return long.select("s.factor", "market", "asset", "date", F.when(F.abs("s.value") < float("inf"), F.col("s.value")).alias("value"), "target")


def signal_sql(names: Sequence[str] = tuple(SIGNALS), members: bool = True) -> str:
    """The same as CTEs ending in ``sig``, without rows that have no value."""
    each = " UNION ALL ".join(f"SELECT '{n}' AS factor, market, asset, date, {stable_sql(n)} AS value, round(target, 10) AS target FROM factors WHERE present{' AND coalesce(tradable, false)' if members else ''}" for n in names)
    return f"{GRID_SQL},\n{to_sql({n: SIGNALS[n] for n in names}, 'grid', keep=['present', 'tradable', 'target'])},\nsig AS (SELECT * FROM ({each}) WHERE value IS NOT NULL AND abs(value) < 'inf'::DOUBLE)"


def daily_ic(signals: DataFrame, least: int = 2) -> DataFrame:
    """Per factor, market and date: pairs, Pearson and Spearman correlation of signal and target."""
    return daily_with_flat(signals, least).where("n_assets > 0").drop("flat")


def daily_with_flat(signals: DataFrame, least: int = 2) -> DataFrame:
    """The same, with dates without pairs, and whether a date has two or more values of which all are equal; one exchange."""
    rows = signals.where(F.col("value").isNotNull()).withColumn("pair", F.col("target").isNotNull()).repartition(*DAILY)
    ranked = rows.withColumns({"rv": average_rank(F.col("value"), [*DAILY, "pair"]), "rt": average_rank(F.col("target"), [*DAILY, "pair"])})
    v, t, rv, rt = (F.when(F.col("pair"), F.col(c)) for c in ("value", "target", "rv", "rt"))
    flat = (F.count("value") >= 2) & (F.max("value") == F.min("value"))
    return ranked.groupBy(*DAILY).agg(F.count("target").alias("n_assets"), (F.round(centred_corr(v, t, least), 10) + 0.0).alias("ic"), (F.round(centred_corr(rv, rt, least), 10) + 0.0).alias("rank_ic"), flat.alias("flat"))


_PAIRS = """pairs AS (SELECT *, rank() OVER (PARTITION BY factor, market, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, market, date, value) - 1) / 2.0 AS rv,
  rank() OVER (PARTITION BY factor, market, date ORDER BY target) + (count(*) OVER (PARTITION BY factor, market, date, target) - 1) / 2.0 AS rt FROM sig WHERE target IS NOT NULL)"""


def _corr_sql(x: str, y: str, least: int = 2) -> str:
    return f"CASE WHEN max({x}) > min({x}) AND max({y}) > min({y}) AND count(*) >= {least} THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END"


DAILY_SQL = f"{_PAIRS},\ndaily AS (SELECT factor, market, date, count(*) AS n_assets, round({_corr_sql('value', 'target')}, 10) + 0.0 AS ic, round({_corr_sql('rv', 'rt')}, 10) + 0.0 AS rank_ic FROM pairs GROUP BY factor, market, date)"


def segment_ic(daily: DataFrame, split: Split = DEFAULT_SPLIT, by: Sequence[str] = ("factor", "market"), population: bool = False) -> DataFrame:
    """Per segment: mean IC, mean rank IC, their ratio to the deviation (NULL where that is 0), and scorable dates.

    The deviation is that of a sample; composites are summarised with that of the population.
    """
    rows = daily.withColumn("segment", split.segment()).where(F.col("segment").isNotNull())

    def ratio(c: str) -> F.Column:
        return F.when(F.max(c) > F.min(c), F.avg(c) / (F.stddev_pop(c) if population else F.stddev_samp(c)))

    return rows.groupBy(*by, "segment").agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), ratio("ic").alias("icir"), ratio("rank_ic").alias("rank_icir"), F.count("ic").alias("n_dates"))


SEGMENT_SQL = f"""segs AS (SELECT * FROM (SELECT *, {DEFAULT_SPLIT.sql()} AS segment FROM daily) WHERE segment IS NOT NULL),
seg AS (SELECT factor, market, segment, avg(ic) AS ic, avg(rank_ic) AS rank_ic, CASE WHEN max(ic) > min(ic) THEN avg(ic) / stddev_samp(ic) END AS icir,
  CASE WHEN max(rank_ic) > min(rank_ic) THEN avg(rank_ic) / stddev_samp(rank_ic) END AS rank_icir, count(ic) AS n_dates FROM segs GROUP BY factor, market, segment)"""


def train_sign(segments: DataFrame) -> DataFrame:
    """+1 or -1 per factor and market by the mean training IC; +1 where it is missing or 0."""
    return segments.groupBy("factor", "market").agg(F.max(F.when(F.col("segment") == "train", F.col("ic"))).alias("train_ic")).withColumn("sign", F.when(F.col("train_ic") < 0, -1).otherwise(1))


def full_coverage_sign(signals: DataFrame, split: Split = DEFAULT_SPLIT, least: int = 30) -> DataFrame:
    """+1 or -1 by the mean training IC over dates on which the factor has a value for every asset with a target, at least ``least``; +1 without any."""
    rows = signals.where(F.col("target").isNotNull()).withColumn("segment", split.segment()).where("segment = 'train'")
    daily = rows.groupBy(*DAILY).agg(F.count("target").alias("n"), F.count("value").alias("k"), centred_corr(F.col("value"), F.when(F.col("value").isNotNull(), F.col("target"))).alias("ic"))
    good = F.when((F.col("n") >= least) & (F.col("k") == F.col("n")), F.col("ic"))
    return daily.groupBy("factor", "market").agg(F.count(good).alias("n_dates"), F.when(F.round(F.avg(good), 12) < 0, -1).otherwise(1).alias("sign"))


def flat_dates(signals: DataFrame, split: Split = DEFAULT_SPLIT) -> DataFrame:
    """Dates on which a signal has two or more values and all are equal."""
    per = signals.where(F.col("value").isNotNull()).groupBy(*DAILY).agg((F.count("value") >= 2).alias("two"), (F.max("value") == F.min("value")).alias("flat"))
    return per.withColumn("segment", split.segment()).where(F.col("segment").isNotNull()).groupBy("factor", "market", "segment").agg(F.count_if(F.col("two") & F.col("flat")).alias("flat_dates"))


def ic_table(signals: DataFrame, split: Split = DEFAULT_SPLIT, lags: int = 25, least_dates: int = 100) -> DataFrame:
    """One row per factor, market and segment with the sign of the training segment applied, HAC and naive t, and admission.

    A factor is admitted in a market if every one of the three segments has at least ``least_dates`` scorable dates.
    """
    every = stage(daily_with_flat(signals), "daily")  # one row per factor, market and date, read by all that follows
    daily = every.where("n_assets > 0").drop("flat")
    segments = segment_ic(daily, split)
    signed = train_sign(segments).select("factor", "market", "sign")
    rows = daily.withColumn("segment", split.segment()).where(F.col("segment").isNotNull())
    hac = newey_west(rows, ["factor", "market", "segment"], "date", "ic", lags).select("factor", "market", "segment", "t_hac")
    still = every.withColumn("segment", split.segment()).where("segment IS NOT NULL").groupBy("factor", "market", "segment").agg(F.count_if("flat").alias("flat_dates"))
    out = segments.join(signed, ["factor", "market"]).join(hac, ["factor", "market", "segment"], "left").join(still, ["factor", "market", "segment"], "left")
    whole = Window.partitionBy("factor", "market")
    admitted = (F.min("n_dates").over(whole) >= least_dates) & (F.count(F.lit(1)).over(whole) == 3)
    s = F.col("sign")
    return out.select("factor", "market", "segment", "sign", (s * F.col("ic")).alias("ic"), (s * F.col("rank_ic")).alias("rank_ic"), (s * F.col("icir")).alias("icir"), (s * F.col("t_hac")).alias("t_hac"), (s * F.col("icir") * F.sqrt("n_dates")).alias("t_naive"), "n_dates", F.coalesce("flat_dates", F.lit(0)).alias("flat_dates"), admitted.alias("admitted"))


HAC_SQL = """cen AS (SELECT factor, market, segment, ic - avg(ic) OVER w AS c, row_number() OVER (PARTITION BY factor, market, segment ORDER BY date) AS rn, count(*) OVER w AS n FROM segs WHERE ic IS NOT NULL WINDOW w AS (PARTITION BY factor, market, segment)),
lagged AS (SELECT a.factor, a.market, a.segment, sum(a.c * b.c * CASE WHEN a.rn = b.rn THEN 1.0 ELSE 2 * (1 - (a.rn - b.rn)::DOUBLE / (least(25, a.n - 1) + 1)) END) AS s, any_value(a.n) AS n
  FROM cen a JOIN cen b ON a.factor = b.factor AND a.market = b.market AND a.segment = b.segment AND b.rn <= a.rn AND a.rn - b.rn <= least(25, a.n - 1) GROUP BY ALL),
hac AS (SELECT l.factor, l.market, l.segment, CASE WHEN l.n >= 3 AND s / l.n > 1e-18 THEN g.ic / sqrt(s / l.n / l.n) END AS t_hac FROM lagged l JOIN seg g ON l.factor = g.factor AND l.market = g.market AND l.segment = g.segment)"""


def long_short(signals: DataFrame, horizon: int = 20, quantile: float = 0.2, least: int = 10) -> DataFrame:
    """Top minus bottom quantile return on every ``horizon``-th scorable date; annualised return, its ratio and the worst drawdown."""
    both = signals.where(F.col("value").isNotNull() & F.col("target").isNotNull())
    ranked = both.withColumns({"p": percent_rank_avg(F.col("value"), DAILY), "n": F.count(F.lit(1)).over(Window.partitionBy(*DAILY))})
    spread = ranked.where(F.col("n") >= least).groupBy(*DAILY).agg((F.avg(F.when(F.col("p") >= 1 - quantile, F.col("target"))) - F.avg(F.when(F.col("p") <= quantile, F.col("target")))).alias("r")).where(F.col("r").isNotNull())
    line = Window.partitionBy("factor", "market").orderBy("date")
    picked = spread.withColumn("k", F.row_number().over(line) - 1).where(F.col("k") % horizon == 0)
    run = picked.withColumn("sum", F.sum("r").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("down", F.col("sum") - F.greatest(F.max("sum").over(line.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    per_year = 252.0 / horizon
    return run.groupBy("factor", "market").agg(F.count("r").alias("n_periods"), (F.avg("r") * per_year).alias("ann_return"), F.when(F.max("r") > F.min("r"), F.avg("r") / F.stddev_samp("r") * per_year**0.5).alias("ratio"), F.min("down").alias("max_drawdown"))


def mutual_information(signals: DataFrame, bins: int = 10, least: int = 100) -> DataFrame:
    """Mutual information of the pooled per-date percent ranks of signal and target on a bins x bins histogram; 0 below ``least`` pairs."""
    both = signals.where(F.col("value").isNotNull() & F.col("target").isNotNull())
    ranked = both.withColumns({"pv": percent_rank_avg(F.col("value"), DAILY), "pt": percent_rank_avg(F.col("target"), DAILY)})

    def cell(c: str) -> F.Column:
        return F.least(F.floor(F.col(c) * bins + 1e-9), F.lit(bins - 1))

    counts = ranked.groupBy("factor", "market", cell("pv").alias("i"), cell("pt").alias("j")).count()
    m = Window.partitionBy("factor", "market")
    counts = counts.withColumns({"n": F.sum("count").over(m), "ni": F.sum("count").over(Window.partitionBy("factor", "market", "i")), "nj": F.sum("count").over(Window.partitionBy("factor", "market", "j"))})
    term = F.col("count") / F.col("n") * F.ln(F.col("count") * F.col("n") / (F.col("ni") * F.col("nj")))
    return counts.groupBy("factor", "market").agg(F.max("n").alias("n_pairs"), F.greatest(F.sum(term), F.lit(0.0)).alias("mi")).withColumn("mi", F.when(F.col("n_pairs") >= least, F.col("mi")).otherwise(F.lit(0.0)))


def audit_diagnostics(signals: DataFrame, split: Split = DEFAULT_SPLIT) -> DataFrame:
    """Per factor and market: rows, values, coverage, dates, scorable dates per segment, all missing, constant."""
    per = signals.groupBy(*DAILY).agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    per = per.withColumns({"segment": split.segment(), "scorable": F.coalesce((F.col("n") >= 2) & (F.col("hi") > F.col("lo")), F.lit(False))})
    seg = [x for s in ("train", "valid", "test") for x in (F.count_if(F.col("segment") == s).alias(f"{s}_dates"), F.count_if((F.col("segment") == s) & F.col("scorable")).alias(f"{s}_scorable"))]
    out = per.groupBy("factor", "market").agg(F.sum("rows").alias("window_rows"), F.sum("n").alias("n_obs"), *seg, F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    return out.select("factor", "market", "window_rows", "n_obs", (F.col("n_obs") / F.col("window_rows")).alias("coverage"), *[f"{s}_{k}" for s in ("train", "valid", "test") for k in ("dates", "scorable")], *[F.try_divide(F.col(f"{s}_scorable"), F.col(f"{s}_dates")).alias(f"frac_{s}_scorable") for s in ("train", "valid", "test")], (F.col("n_obs") == 0).alias("all_nan"), F.coalesce(F.col("hi") == F.col("lo"), F.lit(False)).alias("constant"))


def stability(signals: DataFrame) -> DataFrame:
    """Missing share, mean distinct share of live values per date, and whether both are acceptable; live-day share; constancy."""
    per = signals.groupBy(*DAILY).agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("n"), F.countDistinct("value").alias("kinds"), (F.max("value") - F.min("value")).alias("spread"), F.avg(F.abs("value")).alias("size"))
    live = (F.col("n") >= 3) & (F.col("spread") > 1e-9 * F.col("size"))
    out = per.groupBy("factor", "market").agg((1 - F.sum("n") / F.sum("rows")).alias("missing"), F.avg(F.try_divide(F.col("kinds"), F.col("n"))).alias("distinct_share"), F.avg("kinds").alias("kinds"), F.avg(live.cast("double")).alias("live_days"), F.avg((F.col("spread") <= 1e-12).cast("double")).alias("still_days"))
    ok = (F.col("missing") <= 0.30) & (F.col("distinct_share") >= 0.10) & (F.col("kinds") > 1)
    return out.select("factor", "market", "missing", "distinct_share", "live_days", F.coalesce(ok, F.lit(False)).alias("stable"), F.coalesce(F.col("still_days") > 0.5, F.lit(True)).alias("constant"))


def _rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[(F.round(F.col(c) + 3.3e-12, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sql(ctes: str, final: str, doubles: Sequence[str], others: Sequence[str], digits: int = 8) -> str:
    cols = ", ".join([*others, *[f"round({d} + 3.3e-12, {digits}) + 0.0 AS {d}" for d in doubles]])
    return f"WITH {ctes}\nSELECT {cols} FROM ({final})"


def _q(f):
    return lambda spark, folder: _rounded(f(signal_table(spark, folder)))


_BASE = f"{signal_sql()},\n{DAILY_SQL}"
QUERIES = {
    "daily_ic": lambda s, d: daily_ic(signal_table(s, d)),
    "segment_ic": _q(lambda t: segment_ic(daily_ic(t))),
    "train_sign": _q(lambda t: train_sign(segment_ic(daily_ic(t)))),
    "full_coverage_sign": _q(lambda t: full_coverage_sign(t, least=4)),
    "composite_icir": _q(lambda t: segment_ic(daily_ic(t), population=True)),
    "flat_dates": _q(flat_dates),
    "ic_table": _q(ic_table),
    "newey_west": _q(lambda t: newey_west(daily_ic(t).withColumn("segment", DEFAULT_SPLIT.segment()).where("segment IS NOT NULL"), ["factor", "market", "segment"], "date", "ic")),
    "long_short_horizon": _q(lambda t: long_short(t, least=4)),
    "mutual_info": _q(mutual_information),
    "audit_diag": lambda s, d: _rounded(audit_diagnostics(signal_table(s, d))),
    "stability": _q(stability),
}
_KEY = ["factor", "market", "segment"]
_RANKED = """rk AS (SELECT *, (rank() OVER (PARTITION BY factor, market, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, market, date, value) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY factor, market, date) AS pv,
  (rank() OVER (PARTITION BY factor, market, date ORDER BY target) + (count(*) OVER (PARTITION BY factor, market, date, target) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY factor, market, date) AS pt, count(*) OVER (PARTITION BY factor, market, date) AS n FROM sig WHERE target IS NOT NULL)"""
_ALL_ROWS = signal_sql().replace("WHERE value IS NOT NULL AND abs(value) < 'inf'::DOUBLE)", ")").replace("sig AS (SELECT * FROM", "sig AS (SELECT factor, market, asset, date, CASE WHEN abs(value) < 'inf'::DOUBLE THEN value END AS value, target FROM")
SQL = {
    "daily_ic": f"WITH {_BASE} SELECT * FROM daily",
    "segment_ic": _sql(f"{_BASE},\n{SEGMENT_SQL}", "SELECT * FROM seg", ["ic", "rank_ic", "icir", "rank_icir"], [*_KEY, "n_dates"]),
    "train_sign": _sql(f"{_BASE},\n{SEGMENT_SQL}", "SELECT factor, market, max(CASE WHEN segment = 'train' THEN ic END) AS train_ic, CASE WHEN max(CASE WHEN segment = 'train' THEN ic END) < 0 THEN -1 ELSE 1 END AS sign FROM seg GROUP BY factor, market", ["train_ic"], ["factor", "market", "sign"]),
    "full_coverage_sign": _sql(
        f"{_ALL_ROWS},\ndc AS (SELECT factor, market, date, count(*) AS n, count(value) AS k, CASE WHEN max(value) > min(value) AND max(CASE WHEN value IS NOT NULL THEN target END) > min(CASE WHEN value IS NOT NULL THEN target END) AND count(value) >= 2 THEN covar_pop(value, target) / nullif(stddev_pop(value) * stddev_pop(CASE WHEN value IS NOT NULL THEN target END), 0) END AS ic FROM sig WHERE target IS NOT NULL AND {DEFAULT_SPLIT.sql()} = 'train' GROUP BY ALL)",
        "SELECT factor, market, count(CASE WHEN n >= 4 AND k = n THEN ic END) AS n_dates, CASE WHEN round(avg(CASE WHEN n >= 4 AND k = n THEN ic END), 12) < 0 THEN -1 ELSE 1 END AS sign FROM dc GROUP BY ALL",
        [],
        ["factor", "market", "n_dates", "sign"],
    ),
    "composite_icir": _sql(f"{_BASE},\n{SEGMENT_SQL.replace('stddev_samp', 'stddev_pop')}", "SELECT * FROM seg", ["ic", "rank_ic", "icir", "rank_icir"], [*_KEY, "n_dates"]),
    "flat_dates": f"WITH {signal_sql()}, per AS (SELECT factor, market, date, count(*) >= 2 AND max(value) = min(value) AS flat FROM sig GROUP BY ALL) SELECT factor, market, {DEFAULT_SPLIT.sql()} AS segment, count_if(flat) AS flat_dates FROM per WHERE {DEFAULT_SPLIT.sql()} IS NOT NULL GROUP BY ALL",
    "newey_west": _sql(f"{_BASE},\n{SEGMENT_SQL},\n{HAC_SQL}", "SELECT g.factor, g.market, g.segment, g.n_dates AS n, g.ic AS mean, h.t_hac FROM seg g JOIN hac h USING (factor, market, segment)", ["mean", "t_hac"], [*_KEY, "n"]),
    "ic_table": _sql(
        f"{_BASE},\n{SEGMENT_SQL},\n{HAC_SQL}, sg AS (SELECT factor, market, CASE WHEN max(CASE WHEN segment = 'train' THEN ic END) < 0 THEN -1 ELSE 1 END AS sign FROM seg GROUP BY ALL),\nfl AS (SELECT factor, market, segment, count_if(flat) AS flat_dates FROM (SELECT factor, market, date, {DEFAULT_SPLIT.sql()} AS segment, count(*) >= 2 AND max(value) = min(value) AS flat FROM sig GROUP BY ALL) GROUP BY ALL)",
        "SELECT g.factor, g.market, g.segment, sign, sign * g.ic AS ic, sign * g.rank_ic AS rank_ic, sign * g.icir AS icir, sign * t_hac AS t_hac, sign * g.icir * sqrt(n_dates) AS t_naive, n_dates, coalesce(flat_dates, 0) AS flat_dates, min(n_dates) OVER w >= 100 AND count(*) OVER w = 3 AS admitted FROM seg g JOIN sg USING (factor, market) LEFT JOIN hac USING (factor, market, segment) LEFT JOIN fl USING (factor, market, segment) WINDOW w AS (PARTITION BY g.factor, g.market)",
        ["ic", "rank_ic", "icir", "t_hac", "t_naive"],
        [*_KEY, "sign", "n_dates", "flat_dates", "admitted"],
    ),
    "long_short_horizon": _sql(
        f"{signal_sql()},\n{_RANKED},\nsp AS (SELECT factor, market, date, avg(target) FILTER (pv >= 0.8) - avg(target) FILTER (pv <= 0.2) AS r FROM rk WHERE n >= 4 GROUP BY ALL),\npk AS (SELECT *, row_number() OVER (PARTITION BY factor, market ORDER BY date) - 1 AS k FROM sp WHERE r IS NOT NULL),\nsm AS (SELECT *, sum(r) OVER (PARTITION BY factor, market ORDER BY date) AS s FROM pk WHERE k % 20 = 0),\ndn AS (SELECT *, s - greatest(max(s) OVER (PARTITION BY factor, market ORDER BY date), 0.0) AS down FROM sm)",
        "SELECT factor, market, count(*) AS n_periods, avg(r) * 12.6 AS ann_return, CASE WHEN max(r) > min(r) THEN avg(r) / stddev_samp(r) * sqrt(12.6::DOUBLE) END AS ratio, min(down) AS max_drawdown FROM dn GROUP BY ALL",
        ["ann_return", "ratio", "max_drawdown"],
        ["factor", "market", "n_periods"],
    ),
    "mutual_info": _sql(
        f"{signal_sql()},\n{_RANKED},\nh AS (SELECT factor, market, least(floor(pv * 10 + 1e-9), 9) AS i, least(floor(pt * 10 + 1e-9), 9) AS j, count(*) AS c FROM rk GROUP BY ALL),\nm AS (SELECT *, sum(c) OVER (PARTITION BY factor, market)::DOUBLE AS n, sum(c) OVER (PARTITION BY factor, market, i)::DOUBLE AS ni, sum(c) OVER (PARTITION BY factor, market, j)::DOUBLE AS nj FROM h)",
        "SELECT factor, market, max(n)::BIGINT AS n_pairs, CASE WHEN max(n) >= 100 THEN greatest(sum(c / n * ln(c * n / (ni * nj))), 0.0) ELSE 0.0 END AS mi FROM m GROUP BY ALL",
        ["mi"],
        ["factor", "market", "n_pairs"],
    ),
    "audit_diag": _sql(
        f"{_ALL_ROWS},\nper AS (SELECT factor, market, date, {DEFAULT_SPLIT.sql()} AS segment, count(*) AS r, count(value) AS n, min(value) AS lo, max(value) AS hi, coalesce(count(value) >= 2 AND max(value) > min(value), false) AS sc FROM sig GROUP BY ALL)",
        "SELECT factor, market, sum(r)::BIGINT AS window_rows, sum(n)::BIGINT AS n_obs, sum(n) / sum(r) AS coverage, " + ", ".join(f"count_if(segment = '{s}') AS {s}_dates, count_if(segment = '{s}' AND sc) AS {s}_scorable, count_if(segment = '{s}' AND sc) / nullif(count_if(segment = '{s}'), 0) AS frac_{s}_scorable" for s in ("train", "valid", "test")) + ", sum(n) = 0 AS all_nan, coalesce(max(hi) = min(lo), false) AS constant FROM per GROUP BY factor, market",
        ["coverage", "frac_train_scorable", "frac_valid_scorable", "frac_test_scorable"],
        ["factor", "market", "window_rows", "n_obs", *[f"{s}_{k}" for s in ("train", "valid", "test") for k in ("dates", "scorable")], "all_nan", "constant"],
    ),
    "stability": _sql(
        f"{_ALL_ROWS},\nper AS (SELECT factor, market, date, count(*) AS r, count(value) AS n, count(DISTINCT value) AS kinds, max(value) - min(value) AS spread, avg(abs(value)) AS size FROM sig GROUP BY ALL),\no AS (SELECT factor, market, 1 - sum(n) / sum(r) AS missing, avg(kinds / nullif(n, 0)) AS distinct_share, avg(kinds) AS kinds, avg((n >= 3 AND spread > 1e-9 * size)::INT) AS live_days, avg((spread <= 1e-12)::INT) AS still FROM per GROUP BY ALL)",
        "SELECT factor, market, missing, distinct_share, live_days, coalesce(missing <= 0.3 AND distinct_share >= 0.1 AND kinds > 1, false) AS stable, coalesce(still > 0.5, true) AS constant FROM o",
        ["missing", "distinct_share", "live_days"],
        ["factor", "market", "stable", "constant"],
    ),
}
