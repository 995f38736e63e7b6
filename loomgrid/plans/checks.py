"""Panel derivation and checks: derived columns, target, universe spells, look-ahead by tampering, executors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions.expr import FIELDS, Node, walk
from loomgrid.plans.arrays import WEIGHT, active_grid, evaluate_active, lookback
from loomgrid.plans.compile import DATE, evaluate, need_of
from loomgrid.plans.evaluation import _rounded
from loomgrid.plans.factors import SIGNALS
from loomgrid.plans.problems import p7_versions
from loomgrid.session import stage
from loomgrid.sources.panel import ENTITY, FORWARD, GRID_SQL, MARKETS, current_bars, dense_grid, market_grid

PRICES = ("open", "high", "low", "close")


def derive(grid: DataFrame) -> DataFrame:
    """vwap, one-day return, forward returns over 1, 5 and 20 slots, 20-slot mean volume (at least 5) and market value, on the grid."""
    w = Window.partitionBy(*ENTITY).orderBy("date")
    back = w.rowsBetween(-19, 0)
    ahead = {f"forward_return_{k}d": F.try_divide(F.lead("close", k).over(w), F.col("close")) - 1 for k in (1, 5, 20)}
    out = grid.withColumns({"vwap": (F.col("high") + F.col("low") + F.col("close")) / 3, "return_1d": F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, **ahead, "adv": F.when(F.count("volume").over(back) >= 5, F.avg("volume").over(back))})
    return out.withColumn("market_cap", F.col("close") * F.col("adv"))


def panel_violations(bars: DataFrame) -> DataFrame:
    """Counts of rows that break the panel's contract, by check; all are 0 on a sound panel."""
    tests = {"unknown_market": ~F.col("market").isin(*MARKETS), "missing_key": F.col("asset").isNull() | F.col("date").isNull(), **{f"{c}_not_positive": F.col(c) <= 0 for c in PRICES}, "crossed": F.col("high") < F.col("low")}
    per = bars.groupBy(*ENTITY, "date").agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(t).alias(n) for n, t in tests.items()])
    return per.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in tests], F.count_if(F.col("_n") > 1).alias("repeated_key"))


def target_validate(bars: DataFrame, atol: float = 1e-10, rtol: float = 1e-5) -> DataFrame:
    """Per market the rows whose delivered 20-day target and the recomputed one are both present, and those that differ by more than atol + rtol x the recomputed one."""
    grid = dense_grid(bars, ["close", "forward_return_20d"])
    w = Window.partitionBy(*ENTITY).orderBy("date")
    again = F.try_divide(F.lead("close", 20).over(w), F.col("close")) - 1
    both = grid.withColumn("again", again).where("forward_return_20d IS NOT NULL AND again IS NOT NULL")
    return both.groupBy("market").agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.abs(F.col("forward_return_20d") - F.col("again")) > atol + rtol * F.abs("again")).alias("differ"))


# --- membership spells ---------------------------------------------------------


def read_spells(spark: SparkSession, path: str) -> DataFrame:
    """Membership spells from CSV: market, index_code, yahoo_symbol, start, end; an empty end is open."""
    rows = spark.read.option("header", True).schema("market string, index_code string, yahoo_symbol string, start string, end string").csv(path)
    return rows.select("market", "index_code", F.coalesce("yahoo_symbol", F.lit("")).alias("yahoo_symbol"), F.to_date("start").alias("start"), F.to_date(F.nullif(F.col("end"), F.lit(""))).alias("end"))


def member_rows(bars: DataFrame, spells: DataFrame) -> DataFrame:
    """Rows inside one of their asset's spells, each once however many spells overlap; spells without a symbol hold nobody."""
    named = spells.where("yahoo_symbol <> ''").select(F.col("market").alias("_m"), F.col("yahoo_symbol").alias("_s"), "start", F.coalesce("end", F.lit(date(9999, 12, 31))).alias("end"))
    return bars.join(named, (F.col("market") == F.col("_m")) & (F.col("asset") == F.col("_s")) & F.col("date").between(F.col("start"), F.col("end")), "left_semi")


def mining_panel(bars: DataFrame, spells: DataFrame, history: date = date(2016, 1, 1), cutoff: date = date(2023, 11, 29)) -> DataFrame:
    """What a search may see: members only; spells open at the start of history reach back to its beginning, and assets that first joined after ``cutoff`` are left out."""
    first = spells.groupBy("market").agg(F.min("start").alias("_first"))
    warm = spells.join(first, "market").withColumn("start", F.when(F.col("start") <= F.col("_first"), F.lit(history)).otherwise(F.col("start"))).drop("_first")
    joined = spells.where(F.col("start") <= F.lit(cutoff)).select("market", F.col("yahoo_symbol").alias("asset")).distinct()
    return member_rows(bars, warm).join(joined, ["market", "asset"], "left_semi")


def _spells(spark: SparkSession, folder: str) -> DataFrame:
    """Spells of the snapshots: the versions in which an asset is tradable."""
    rows = p7_versions(spark, folder).where("tradable")
    return rows.select("market", F.lit("X").alias("index_code"), F.col("asset").alias("yahoo_symbol"), F.col("valid_from").alias("start"), F.col("valid_to").alias("end"))


# --- look-ahead ----------------------------------------------------------------


def tamper(bars: DataFrame, cut: date, seed: int = 0) -> DataFrame:
    """The panel with every price and volume after ``cut`` multiplied by its own noise in [0.5, 1.5); the past is untouched.

    The noise is a hash of column, asset, date and seed, so it does not depend on partitions or order.
    """
    after = F.col("date") > F.lit(cut)

    def noise(c: str) -> F.Column:
        word = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(c), "market", "asset", F.date_format("date", "yyyy-MM-dd"), F.lit(str(seed)))), 1, 5), 16, 10).cast("double")
        return 0.5 + word / 2**20

    out = bars.withColumns({c: F.when(after, F.col(c) * noise(c)).otherwise(F.col(c)) for c in (*PRICES, "volume")})
    return out.withColumn("vwap", F.when(after, (F.col("high") + F.col("low") + F.col("close")) / 3).otherwise(F.col("vwap")))


def scale_future(bars: DataFrame, cut: date, price: float = 3.0, volume: float = 7.0) -> DataFrame:
    """The panel with prices and volumes after ``cut`` multiplied by fixed numbers: a second, scale-only form of tampering."""
    after = F.col("date") > F.lit(cut)
    return bars.withColumns({**{c: F.when(after, F.col(c) * price).otherwise(F.col(c)) for c in (*PRICES, "vwap")}, "volume": F.when(after, F.col("volume") * volume).otherwise(F.col("volume"))})


def compare_window(real: DataFrame, tampered: DataFrame, names: Sequence[str], cut: date, window: int = 60, rtol: float = 1e-7, atol: float = 1e-12) -> DataFrame:
    """Per market and factor over the last ``window`` dates up to ``cut``: clean, lookahead or no_signal, with what changed.

    A value that is missing on one side only has changed.
    """

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias(name)) for n in names])
        return df.where(F.col("date") <= F.lit(cut)).select("market", "asset", "date", F.explode(pairs).alias("p")).select("market", "asset", "date", "p.*")

    last = real.select("market", "date").where(F.col("date") <= F.lit(cut)).distinct().withColumn("_k", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("date")))).where(F.col("_k") <= window).select("market", "date")
    both = long(real, "a").join(long(tampered, "b"), ["market", "asset", "date", "factor"], "full").join(last, ["market", "date"])
    missing = F.col("a").isNull() != F.col("b").isNull()
    diff = F.abs(F.col("a") - F.col("b"))
    changed = missing | F.coalesce(diff > atol + rtol * F.abs("a"), F.lit(False))
    out = both.groupBy("market", "factor").agg(F.countDistinct("date").alias("n_dates"), F.countDistinct(F.when(changed, F.col("date"))).alias("n_changed_dates"), F.min(F.when(changed, F.col("date"))).alias("first_changed_date"), F.count_if(changed).alias("n_changed_values"), F.max(diff).alias("max_abs_diff"), F.count_if(missing).alias("nan_mismatch"), F.count("a").alias("n_a"), F.count("b").alias("n_b"))
    status = F.when((F.col("n_a") == 0) & (F.col("n_b") == 0), "no_signal").when(F.col("n_changed_values") > 0, "lookahead").otherwise("clean")
    return out.select("market", "factor", status.alias("status"), "n_dates", "n_changed_dates", "first_changed_date", "n_changed_values", "max_abs_diff", "nan_mismatch")


def lookahead(bars: DataFrame, factors: dict[str, Node], cuts: Sequence[date], extra: Callable[[DataFrame], DataFrame] | None = None, change: Callable[[DataFrame, date], DataFrame] = tamper, window: int = 60) -> DataFrame:
    """The tampering test of compiled factors, or of ``extra`` added to them, at every cut.

    All panels are evaluated whole; of their values only the dates that are compared are kept. Cells that no bar reaches can
    differ only through cross-sections, so without those and ``extra`` one asset per market stands for them.
    """
    fields = [f for f in FIELDS]
    bars = stage(bars, "bars")
    back = F.row_number().over(Window.partitionBy("market").orderBy(F.desc("date")))
    days = bars.select("market", "date").distinct()
    compared = {cut: stage(days.where(F.col("date") <= F.lit(cut)).withColumn("_k", back).where(F.col("_k") <= window).select("market", "date"), "days") for cut in cuts}
    sparse = extra is None and all(need_of(n) != DATE for root in factors.values() for n in walk(root))
    reach = max(map(lookback, factors.values()), default=0)

    def run(df: DataFrame, only: DataFrame) -> DataFrame:
        if sparse:
            out = evaluate_active(active_grid(df, reach), factors, keep=["close"]).where(F.col(WEIGHT) != 0)
            out = out.join(F.broadcast(only), ["market", "date"], "left_semi")
            others = F.sum(WEIGHT).over(Window.partitionBy("market", "date")) < 0
            out = out.withColumn("_others", others).where((F.col(WEIGHT) > 0) | F.col("_others"))
            return out.select("market", F.coalesce("asset", F.lit("\0")).alias("asset"), "date", "close", *factors)
        grid = dense_grid(df, fields)
        w = Window.partitionBy(*ENTITY).orderBy("date")
        grid = grid.withColumn("returns", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
        out = evaluate(grid, factors, keep=["close"])
        return (extra(out) if extra else out).join(F.broadcast(only), ["market", "date"], "left_semi")

    every, out = None, None
    for only in compared.values():
        every = only if every is None else every.unionByName(only)
    real = stage(run(bars, every.distinct()), "real")
    names = [c for c in real.columns if c not in ("market", "asset", "date", "close")]
    for cut, only in compared.items():
        mine = real.join(F.broadcast(only), ["market", "date"], "left_semi")
        part = compare_window(mine, run(change(bars, cut), only), names, cut, window).withColumn("cut", F.lit(cut))
        out = part if out is None else out.unionByName(part)
    return out


# The days after which panels are tampered with.
CUTS = (date(2019, 6, 28), date(2022, 12, 30), date(2024, 12, 31))


def _peek(df: DataFrame) -> DataFrame:
    """A factor that reads the close of five slots later."""
    w = Window.partitionBy(*ENTITY).orderBy("date")
    return df.withColumn("peek", F.try_divide(F.lead("close", 5).over(w), F.col("close"))).withColumn("nothing", F.lit(None).cast("double"))


# --- factors as functions ------------------------------------------------------


def code_factor(bars: DataFrame, function: Callable[[pd.DataFrame], pd.Series], by: Sequence[str] = ENTITY, columns: Sequence[str] = FIELDS) -> DataFrame:
    """A signal from a pandas function over the existing rows of each group, by asset unless declared otherwise.

    The function gets the rows sorted by date, without any forward-looking column, and returns one value per row.
    """
    if set(columns) & set(FORWARD):
        raise ValueError("forward columns are not for factors")
    keys = list(dict.fromkeys([*ENTITY, "date"]))

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["date", "asset"], ignore_index=True)
        value = function(pdf)
        if not isinstance(value, pd.Series) or len(value) != len(pdf):
            raise ValueError("a factor returns one value per row")
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "value": pd.to_numeric(value.to_numpy(), errors="coerce").astype(float)})

    out = bars.select(*keys, *columns).groupBy(*by).applyInPandas(call, "market string, asset string, date date, value double")
    return out.withColumn("value", F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value")))


def _bars(spark: SparkSession, folder: str) -> DataFrame:
    return current_bars(spark, folder, ["tradable"])


QUERIES = {
    "panel_current": lambda s, d: _bars(s, d),
    "panel_grid": lambda s, d: market_grid(s, d).select("market", "asset", "date", "close", "present", F.round("returns", 8).alias("returns"), F.round("target", 8).alias("target")),
    "panel_derived": lambda s, d: _rounded(derive(dense_grid(_bars(s, d), [c for c in FIELDS if c != "vwap"])).where("present").select("market", "asset", "date", "vwap", "return_1d", *FORWARD, F.round("adv", 2).alias("adv"), F.round("market_cap", 0).alias("market_cap")), 6),
    "panel_violations": lambda s, d: panel_violations(_bars(s, d)),
    "target_validate": lambda s, d: target_validate(stage(current_bars(s, d, ["forward_return_20d"]), "bars")),
    "membership": lambda s, d: member_rows(_bars(s, d), _spells(s, d)).select("market", "asset", "date", "close"),
    "mining_panel": lambda s, d: mining_panel(_bars(s, d), _spells(s, d)).select("market", "asset", "date", "close"),
    "tampered_panel": lambda s, d: _rounded(tamper(_bars(s, d), CUTS[0]).select("market", "asset", "date", "close", "volume"), 6),
    "lookahead_clean": lambda s, d: _rounded(lookahead(_bars(s, d), SIGNALS, CUTS)),
    "lookahead_scaled": lambda s, d: lookahead(_bars(s, d), {"range": SIGNALS["range"]}, CUTS[1:2], _peek, scale_future).select("market", "factor", "cut", "status"),
    "lookahead_caught": lambda s, d: lookahead(_bars(s, d), {"range": SIGNALS["range"]}, CUTS[:1], _peek).select("market", "factor", "cut", "status"),
    "code_factor": lambda s, d: _rounded(code_factor(_bars(s, d), lambda g: g["close"].rolling(5, min_periods=5).mean() / g["close"].where(g["close"] > 0) - 1), 6),
}
_CUR = "WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, asset, date ORDER BY loaded_at DESC, row_id) AS rn FROM download_all WHERE date IS NOT NULL AND asset IS NOT NULL) WHERE rn = 1)"
_VER = """one AS (SELECT market, asset, snapshot_date, coalesce(tradable, false) AS tradable, upper(regexp_replace(coalesce(yahoo_symbol, ''), '^\\s+|\\s+$', '', 'g')) AS sym, row_number() OVER (PARTITION BY market, asset, snapshot_date ORDER BY received_at DESC, snapshot_id) AS rn FROM membership_snapshots),
sq AS (SELECT *, lag(tradable) OVER w AS pt, lag(sym) OVER w AS ps FROM one WHERE rn = 1 WINDOW w AS (PARTITION BY market, asset ORDER BY snapshot_date)),
ve AS (SELECT market, asset, tradable, snapshot_date AS s, lead(snapshot_date) OVER (PARTITION BY market, asset ORDER BY snapshot_date) - 1 AS e FROM sq WHERE pt IS NULL OR pt <> tradable OR ps <> sym), spells AS (SELECT market, asset, s, e FROM ve WHERE tradable)"""
_NOISE = lambda c: f"(0.5 + ('0x' || substr(md5('{c}' || '|' || market || '|' || asset || '|' || strftime(date, '%Y-%m-%d') || '|0'), 1, 5))::BIGINT::DOUBLE / 1048576)"
_r6 = lambda c: f"round({c} + 3.3e-12, 6) + 0.0"
SQL = {
    "panel_current": f"{_CUR} SELECT market, asset, date, open, high, low, close, volume, vwap, tradable FROM cur",
    "panel_grid": f"WITH {GRID_SQL} SELECT market, asset, date, close, present, round(returns, 8) AS returns, round(target, 8) AS target FROM grid",
    "panel_derived": f"WITH {GRID_SQL}, d AS (SELECT *, (high + low + close) / 3 AS v, close / nullif(lag(close) OVER w, 0) - 1 AS return_1d, lead(close, 1) OVER w / nullif(close, 0) - 1 AS f1, lead(close, 5) OVER w / nullif(close, 0) - 1 AS f5, lead(close, 20) OVER w / nullif(close, 0) - 1 AS f20, CASE WHEN count(volume) OVER b >= 5 THEN avg(volume) OVER b END AS adv FROM grid WINDOW w AS (PARTITION BY market, asset ORDER BY date), b AS (PARTITION BY market, asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT market, asset, date, {_r6('v')} AS vwap, {_r6('return_1d')} AS return_1d, {_r6('f1')} AS forward_return_1d, {_r6('f5')} AS forward_return_5d, {_r6('f20')} AS forward_return_20d, {_r6('round(adv, 2)')} AS adv, round(close * adv, 0) AS market_cap FROM d WHERE present",
    "panel_violations": f"{_CUR} SELECT count_if(market NOT IN {MARKETS}) AS unknown_market, count_if(asset IS NULL OR date IS NULL) AS missing_key, " + ", ".join(f"count_if({c} <= 0) AS {c}_not_positive" for c in PRICES) + ", count_if(high < low) AS crossed, 0 AS repeated_key FROM cur",
    "target_validate": f"WITH {GRID_SQL}, j AS (SELECT g.market, g.target, c.forward_return_20d AS f FROM grid g JOIN cur c ON g.market = c.market AND g.asset = c.asset AND g.date = c.date) SELECT market, count(*) AS compared, count_if(abs(f - target) > 1e-10 + 1e-5 * abs(target)) AS differ FROM j WHERE f IS NOT NULL AND target IS NOT NULL GROUP BY market",
    "membership": f"{_CUR}, {_VER} SELECT market, asset, date, close FROM cur c WHERE EXISTS (SELECT 1 FROM spells p WHERE p.market = c.market AND p.asset = c.asset AND c.date BETWEEN s AND coalesce(e, DATE '9999-12-31'))",
    "mining_panel": f"{_CUR}, {_VER}, fs AS (SELECT market, min(s) AS f FROM spells GROUP BY ALL) SELECT market, asset, date, close FROM cur c WHERE EXISTS (SELECT 1 FROM spells p JOIN fs ON p.market = fs.market WHERE p.market = c.market AND p.asset = c.asset AND c.date BETWEEN CASE WHEN s <= f THEN DATE '2016-01-01' ELSE s END AND coalesce(e, DATE '9999-12-31')) AND EXISTS (SELECT 1 FROM spells p WHERE p.market = c.market AND p.asset = c.asset AND s <= DATE '2023-11-29')",
    "tampered_panel": f"{_CUR} SELECT market, asset, date, " + ", ".join(f"{_r6(f'CASE WHEN date > DATE {chr(39)}{CUTS[0]}{chr(39)} THEN {c} * {_NOISE(c)} ELSE {c} END')} AS {c}" for c in ("close", "volume")) + " FROM cur",
    "code_factor": f"{_CUR}, m AS (SELECT market, asset, date, close, count(close) OVER w AS n, avg(close) OVER w AS a FROM cur WINDOW w AS (PARTITION BY market, asset ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT market, asset, date, {_r6('CASE WHEN n = 5 AND close > 0 THEN a / close - 1 END')} AS value FROM m",
}
