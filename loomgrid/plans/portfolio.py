"""From signals to a portfolio: selection, composite, books, a backtest without a day loop, performance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions.stats import centred_corr, percent_rank_avg
from loomgrid.plans.evaluation import DAILY_SQL, SEGMENT_SQL, _rounded, _sql, daily_ic, ic_table, segment_ic, signal_sql, signal_table, train_sign
from loomgrid.plans.factors import SIGNALS
from loomgrid.plans.redundancy import mean_corr
from loomgrid.plans.style import LEAST, STYLES, residuals, style_panel, style_summary
from loomgrid.session import stage
from loomgrid.sources.panel import DEFAULT_SPLIT, GRID_SQL, market_grid

TRADING_DAYS = 252


@dataclass(frozen=True)
class Book:
    """Settings of a strategy."""

    kind: str = "long_only"
    quantile: float = 0.2
    least: int = 10
    rebalance: int = 20
    lag: int = 1
    cost_bps: float = 10.0
    borrow_bps: float = 50.0
    long: float = 1.0
    short: float = 0.5

    def __post_init__(self) -> None:
        if self.kind not in ("long_only", "long_short"):
            raise ValueError(f"unknown strategy {self.kind}")


# --- selection ---------------------------------------------------------------


def candidates(table: DataFrame, ic: str = "ic", least_dates: int = 100, positive: bool = True) -> DataFrame:
    """Validation rows that may be selected, best first within a market: ``market, factor, ic, rank``."""
    rows = table.where((F.col("segment") == "valid") & F.col(ic).isNotNull() & (F.col("n_dates") >= least_dates))
    if positive:
        rows = rows.where(F.col(ic) > 0)
    return rows.select("market", "factor", F.col(ic).alias("ic"), F.row_number().over(Window.partitionBy("market").orderBy(F.desc(ic), "factor")).alias("rank"))


def greedy_selection(pool: DataFrame, correlations: DataFrame, ceiling: float = 0.8, cap: int | None = 10) -> DataFrame:
    """In rank order, every candidate less correlated than ``ceiling`` with all accepted ones, up to ``cap`` per market.

    A candidate without correlations to the pool, or with none to the accepted, is left out. The walk is sequential
    by nature; a task holds the candidates of one market and the pairs among them, some 100 bytes each, so a market may
    have a few thousand candidates.
    """
    pairs = correlations.select("market", "f_i", "f_j", F.col("spearman").alias("c")).where("c IS NOT NULL")
    edges = pairs.unionByName(pairs.select("market", F.col("f_j").alias("f_i"), F.col("f_i").alias("f_j"), "c"))
    near = pool.join(edges.withColumnRenamed("f_i", "factor").where("factor <> f_j"), ["market", "factor"], "left")
    names = pool.select("market", F.col("factor").alias("f_j"), F.lit(True).alias("inside"))
    near = near.join(names, ["market", "f_j"], "left").withColumn("c", F.when(F.col("inside"), F.abs("c"))).select("market", "factor", "ic", "rank", "f_j", "c")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        known = {(f, g): c for f, g, c in zip(pdf["factor"], pdf["f_j"], pdf["c"]) if g is not None and c == c}
        order = pdf.drop_duplicates("factor").sort_values("rank")
        vetted = {f for f, _ in known}
        out: list[tuple[str, float]] = []
        for f, ic in zip(order["factor"], order["ic"]):
            if cap is not None and len(out) >= cap:
                break
            if f not in vetted and len(order) > 1:
                continue
            with_accepted = [known[f, g] for g, _ in out if (f, g) in known]
            if out and (not with_accepted or max(with_accepted) >= ceiling):
                continue
            out.append((f, ic))
        return pd.DataFrame({"market": pdf["market"].iloc[0], "factor": [f for f, _ in out], "ic": [i for _, i in out], "position": np.arange(1, len(out) + 1, dtype="int64")})

    return near.groupBy("market").applyInPandas(walk, "market string, factor string, ic double, position bigint")


# --- composite ---------------------------------------------------------------


def composite(signals: DataFrame, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of weight x sign x (percent rank - 0.5) over a market's factors; missing ones are skipped, all missing is NULL.

    ``weights``: market, factor, sign, weight, and ``by``, which names portfolios where there are many; ranks are made once for all.
    """
    rows = signals.where(F.col("value").isNotNull()).withColumn("z", percent_rank_avg(F.col("value"), ["factor", "market", "date"]) - 0.5)
    return rows.join(weights, ["market", "factor"]).groupBy(*by, "market", "asset", "date").agg(F.round(F.sum(F.col("weight") * F.col("sign") * F.col("z")), 10).alias("score"))


def equal_weights(selected: DataFrame) -> DataFrame:
    return selected.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("market")))


def ic_weights(selected: DataFrame) -> DataFrame:
    """By positive validation IC; equal where none is positive."""
    w = Window.partitionBy("market")
    part = F.greatest(F.coalesce("ic", F.lit(0.0)), F.lit(0.0))
    return selected.withColumn("weight", F.when(F.sum(part).over(w) > 0, part / F.sum(part).over(w)).otherwise(1.0 / F.count(F.lit(1)).over(w)))


def ridge_weights(signals: DataFrame, selected: DataFrame, alphas: Sequence[float] = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0), least: int = 50) -> DataFrame:
    """Ridge on the training segment's complete rows, the penalty with the best mean validation IC, scaled to unit gross.

    Moments are summed by the engine per market; only the K x K system of a market, K its selected factors, is solved
    outside. Validation predictions of all penalties are scored in the engine.
    """
    names = sorted(r.factor for r in selected.select("factor").distinct().collect())  # the chosen factors of a portfolio
    if not names:
        return equal_weights(selected)
    z = signals.where(F.col("value").isNotNull()).withColumn("z", percent_rank_avg(F.col("value"), ["factor", "market", "date"]) - 0.5)
    z = z.join(selected.select("market", "factor", "sign"), ["market", "factor"])
    wide = z.groupBy("market", "asset", "date").agg(F.max("target").alias("y"), *[F.max(F.when(F.col("factor") == n, F.col("z") * F.col("sign"))).alias(f"z{i}") for i, n in enumerate(names)])
    wide = wide.withColumn("segment", DEFAULT_SPLIT.segment()).where("y IS NOT NULL AND segment IN ('train', 'valid')")
    held = selected.groupBy("market").agg(F.sort_array(F.collect_set("factor")).alias("own"))
    wide = wide.join(held, "market")
    complete = F.lit(True)
    for i, n in enumerate(names):
        complete = complete & (F.col(f"z{i}").isNotNull() | ~F.array_contains("own", n))
    wide = wide.where(complete).fillna(0.0, [f"z{i}" for i in range(len(names))])
    wide = stage(wide, "wide")
    k = len(names)
    x = [F.col(f"z{i}") for i in range(k)]
    sums = wide.where("segment = 'train'").groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.covar_pop(a, b) for a in x for b in x]).alias("g"), F.array(*[F.covar_pop(a, F.col("y")) for a in x]).alias("b"), F.first("own").alias("own")).where(F.col("n") >= least)

    def solve(batches):
        for pdf in batches:
            rows = []
            for market, n, g, b, own in zip(pdf["market"], pdf["n"], pdf["g"], pdf["b"], pdf["own"]):
                keep = [i for i, name in enumerate(names) if name in set(own)]
                gram = np.asarray(g, float).reshape(k, k)[np.ix_(keep, keep)] * n
                for a in alphas:
                    w = np.zeros(k)
                    w[keep] = np.linalg.solve(gram + a * np.eye(len(keep)), np.asarray(b, float)[keep] * n)
                    rows.append((market, float(a), w.tolist()))
            yield pd.DataFrame(rows, columns=["market", "alpha", "w"])

    fits = stage(sums.mapInPandas(solve, "market string, alpha double, w array<double>"), "ridge")
    valid = wide.where("segment = 'valid'").join(fits, "market")
    predicted = sum((F.col("w")[i] * x[i] for i in range(k)), F.lit(0.0))
    scored = valid.select("market", "alpha", "date", predicted.alias("p"), "y").groupBy("market", "alpha", "date").agg(centred_corr(F.col("p"), F.col("y")).alias("ic"))
    best = scored.groupBy("market", "alpha").agg(F.avg("ic").alias("ic")).where("ic IS NOT NULL").withColumn("rn", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("ic"), "alpha"))).where("rn = 1")
    chosen = fits.join(best.select("market", "alpha"), ["market", "alpha"])
    gross = F.aggregate("w", F.lit(0.0), lambda s, v: s + F.abs(v))
    each = chosen.select("market", gross.alias("gross"), F.posexplode("w").alias("i", "raw")).withColumn("factor", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1))
    fitted = each.select("market", "factor", F.when(F.col("gross") > 0, F.col("raw") / F.col("gross")).otherwise(F.col("raw")).alias("fit"))
    out = equal_weights(selected).join(fitted, ["market", "factor"], "left")
    return out.withColumn("weight", F.coalesce("fit", "weight")).drop("fit")


# --- books -------------------------------------------------------------------


def target_books(scores: DataFrame, book: Book, by: Sequence[str] = ("market",)) -> DataFrame:
    """Weights of every date that has enough names: the top share long, and for long-short the bottom share short.

    Ties go to the first asset; where both ends overlap the short side wins.
    """
    day = [*by, "date"]
    rows = scores.where(F.col("score").isNotNull())
    rows = rows.withColumns({
        "n": F.count(F.lit(1)).over(Window.partitionBy(*day)),
        "up": F.row_number().over(Window.partitionBy(*day).orderBy(F.desc("score"), "asset")),
        "down": F.row_number().over(Window.partitionBy(*day).orderBy("score", "asset")),
    })
    k = F.greatest(F.floor(F.col("n") * book.quantile), F.lit(1))
    if book.kind == "long_only":
        weight = F.when(F.col("up") <= k, F.lit(book.long) / k)
        rows = rows.where(F.col("n") >= book.least)
    else:
        weight = F.when(F.col("down") <= k, -F.lit(book.short) / k).when(F.col("up") <= k, F.lit(book.short) / k)
        rows = rows.where(F.col("n") >= 2 * book.least)
    return rows.withColumn("weight", weight).where("weight IS NOT NULL").select(*day, "asset", "weight")


def backtest(scores: DataFrame, returns: DataFrame, book: Book = Book(), by: Sequence[str] = ("market",)) -> DataFrame:
    """Daily book of every market: returns, turnover, costs, exposures. ``scores``: ``by``, asset, date, score; ``returns``: market, asset, date, ret.

    A book formed on every ``rebalance``-th trading day is held from ``lag`` + 1 days later until the next non-empty one.
    Between those days a position is its weight times the asset's compounded return, scaled to keep the gross exposure,
    which has a closed form: one window product per (book, asset), and no loop over days. Turnover is half the absolute
    difference to the drifted old book. A missing return is 0 for the drift and adds nothing to the return.

    ``by`` holds ``market`` and, where many portfolios are run in one plan, what names them. Scores and returns are read
    several times, so give them written.
    """
    by = list(by)
    calendar = returns.select("market", "date").distinct().withColumn("t", F.row_number().over(Window.partitionBy("market").orderBy("date")) - 1)
    length = calendar.groupBy("market").agg(F.max("t").alias("last"))
    formed = target_books(scores, book, by).join(calendar, ["market", "date"]).where(F.col("t") % book.rebalance == 0)
    weights = stage(formed.withColumn("e", F.col("t") + book.lag + 1).join(length, "market").where(F.col("e") <= F.col("last")).select(*by, "asset", "e", "weight"), "weights")
    starts = weights.select(*by, "e").distinct()
    starts = starts.withColumn("next", F.lead("e").over(Window.partitionBy(*by).orderBy("e"))).join(length, "market")
    # one more day than it is held: there the drifted book is what is traded away from
    held = starts.withColumn("t", F.explode(F.sequence("e", F.coalesce("next", F.col("last"))))).withColumn("closing", F.coalesce(F.col("t") == F.col("next"), F.lit(False)))
    days = returns.join(calendar, ["market", "date"]).select("market", "asset", "t", "ret")
    cells = held.join(weights, [*by, "e"]).join(days, ["market", "asset", "t"], "left")
    line = Window.partitionBy(*by, "e", "asset").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    grown = F.coalesce(F.product(1 + F.coalesce("ret", F.lit(0.0))).over(line), F.lit(1.0))
    cells = cells.withColumn("g", F.col("weight") * grown)
    one = Window.partitionBy(*by, "e", "t")
    total = F.sum(F.abs("g")).over(one)
    cells = cells.withColumn("h", F.when(total > 0, F.col("g") / total * F.sum(F.abs("weight")).over(one)).otherwise(F.col("g")))
    # an asset has at most one held and one closing position on a day
    is_open = ~F.col("closing")
    positions = cells.groupBy(*by, "t", "asset").agg(
        F.sum(F.when(is_open, F.col("h"))).alias("h"),
        F.sum(F.when(is_open, F.col("h") * F.col("ret"))).alias("earned"),
        F.sum(F.when(F.col("closing"), -F.col("h")).when(F.col("t") == F.col("e"), F.col("h"))).alias("d"),
    )
    daily = positions.groupBy(*by, "t").agg(
        F.coalesce(F.sum("earned"), F.lit(0.0)).alias("gross"),
        F.sum(F.when(F.col("h") < 0, -F.col("h")).otherwise(F.lit(0.0))).alias("short"),
        F.count_if(F.col("h") > 0).alias("n_long"),
        F.count_if(F.col("h") < 0).alias("n_short"),
        F.sum(F.abs("h")).alias("gross_exposure"),
        F.sum("h").alias("net_exposure"),
        (F.sum(F.abs("d")) / 2).alias("turnover"),
    )
    every = calendar if by == ["market"] else scores.select(*by).distinct().join(calendar, "market")
    out = every.join(daily, [*by, "t"], "left").fillna(0.0, ["gross", "short", "gross_exposure", "net_exposure", "turnover"]).fillna(0, ["n_long", "n_short"])
    trade, borrow = F.col("turnover") * (book.cost_bps / 1e4), F.col("short") * (book.borrow_bps / 1e4 / TRADING_DAYS)
    return out.select(*by, "date", "gross", "turnover", trade.alias("trade_cost"), borrow.alias("borrow_cost"), (F.col("gross") - trade - borrow).alias("net"), "n_long", "n_short", "gross_exposure", "net_exposure")


def benchmark(grid: DataFrame) -> DataFrame:
    """Mean return of a day's members, a missing one counting 0."""
    return grid.where(F.coalesce("tradable", F.lit(False))).groupBy("market", "date").agg(F.avg(F.coalesce("returns", F.lit(0.0))).alias("bench"))


def performance(daily: DataFrame, bench: DataFrame | None = None, by: Sequence[str] = ("market",)) -> DataFrame:
    """CAGR, Sharpe and drawdown gross and net, turnover, exposures, borrowing; active return and information ratio with a benchmark."""
    line = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily
    if bench is not None:
        rows = rows.join(bench, ["market", "date"], "left").withColumn("active", F.col("net") - F.coalesce("bench", F.lit(0.0)))
    for tag in ("gross", "net"):
        rows = rows.withColumn(f"_w_{tag}", F.product(1 + F.col(tag)).over(line))
        rows = rows.withColumn(f"_d_{tag}", F.col(f"_w_{tag}") / F.max(f"_w_{tag}").over(line) - 1)
    years = F.count(F.lit(1)) / F.lit(float(TRADING_DAYS))
    aggs = []
    for tag in ("gross", "net"):
        end = F.max_by(f"_w_{tag}", "date")
        aggs += [F.when(end > 0, F.pow(end, 1 / years) - 1).alias(f"{tag}_cagr"), F.when(F.max(tag) > F.min(tag), F.avg(tag) / F.stddev_samp(tag) * TRADING_DAYS**0.5).alias(f"{tag}_sharpe"), F.min(f"_d_{tag}").alias(f"{tag}_max_dd")]
    aggs += [F.coalesce(F.avg(F.when(F.col("turnover") > 0, F.col("turnover"))), F.lit(0.0)).alias("turnover_per_rebalance"), (F.sum("turnover") / years).alias("turnover_annual"), F.avg("gross_exposure").alias("avg_gross_exposure"), F.avg("net_exposure").alias("avg_net_exposure"), (F.sum("borrow_cost") / years).alias("borrow_cost_annual"), F.count(F.lit(1)).alias("days")]
    if bench is not None:
        aggs += [(F.avg("active") * TRADING_DAYS).alias("net_active_return"), F.when(F.max("active") > F.min("active"), F.avg("active") / F.stddev_samp("active") * TRADING_DAYS**0.5).alias("information_ratio")]
    return rows.groupBy(*by).agg(*aggs)


# --- queries -----------------------------------------------------------------

NAMES = ("momentum", "reversal", "range")
# The grid of the backtests. Days between rebalancing, costs in basis points, the period and cost at which the
# other axis varies, caps on selected factors, whether only positive validation ICs are selected, weightings, and the share
# of variance from which a residual is noise.
REBALANCE, COSTS = (1, 5, 10, 15, 20), (0.0, 5.0, 10.0, 20.0, 50.0)
MAIN_REBALANCE, MAIN_COST = 20, 10.0
CAPS, GATES, WEIGHTINGS = {"full": None, "top10": 10}, {"off": False, "on": True}, ("equal", "ic", "ridge")
NOISE_R2 = 0.999
LONG, SHORT = Book(least=3, quantile=0.34), Book("long_short", least=2, quantile=0.34)


def _selected(spark: SparkSession, folder: str, names: Sequence[str] = NAMES) -> tuple[DataFrame, DataFrame]:
    signals = stage(signal_table(spark, folder, names), "signals")
    segments = segment_ic(daily_ic(signals))
    sign = train_sign(segments).select("factor", "market", "sign")
    ic = segments.where("segment = 'valid'").select("factor", "market", "ic").join(sign, ["factor", "market"], "right").withColumn("ic", F.round(F.col("sign") * F.col("ic"), 10))
    return signals, ic.select("market", "factor", "sign", "ic")


def composite_scores(spark: SparkSession, folder: str, how: str = "equal") -> DataFrame:
    signals, selected = _selected(spark, folder, tuple(SIGNALS) if how == "ridge" else NAMES)
    selected = stage(selected, "selected")
    weights = {"equal": equal_weights, "ic": ic_weights}[how](selected) if how != "ridge" else ridge_weights(signals, selected)
    return composite(signals, weights.select("market", "factor", "sign", "weight"))


def _traded(spark: SparkSession, folder: str, book: Book) -> DataFrame:
    return backtest(stage(composite_scores(spark, folder), "scores"), stage(_returns(spark, folder), "returns"), book)


def _returns(spark: SparkSession, folder: str) -> DataFrame:
    return market_grid(spark, folder).select("market", "asset", "date", F.round("returns", 10).alias("ret"))


def select_greedy(spark: SparkSession, folder: str) -> DataFrame:
    signals = signal_table(spark, folder)
    return greedy_selection(candidates(ic_table(signals), least_dates=50), mean_corr(signals, least=3).where("segment = 'valid'"), cap=4)


def composite_style(spark: SparkSession, folder: str, names: Sequence[str] = STYLES, least: int = LEAST) -> DataFrame:
    """What the composite keeps after the styles are regressed out, on matched dates."""
    targets = market_grid(spark, folder).where("present").select("market", "asset", "date", F.round("target", 10).alias("target"))
    scores = composite_scores(spark, folder).join(targets, ["market", "asset", "date"]).select(F.lit("composite").alias("factor"), "market", "asset", "date", F.col("score").alias("value"), "target")
    return style_summary(scores, style_panel(spark, folder), least=least, names=names)


def grid_weights(signals: DataFrame, table: DataFrame, related: DataFrame, least_dates: int = 50) -> DataFrame:
    """Weights of all portfolios of the grid, named cap/gate/weighting: ``portfolio, market, factor, sign, weight, n_selected``.

    ``table`` is an IC table and ``related`` mean correlations of the validation segment, both written.
    """
    signs = table.select("market", "factor", "sign").distinct()
    out = None
    for gate, positive in GATES.items():
        pool = stage(candidates(table, least_dates=least_dates, positive=positive), "pool")
        for cap, most in CAPS.items():
            chosen = stage(greedy_selection(pool, related, cap=most).join(signs, ["market", "factor"]), "chosen")
            for name, weigh in (("equal", equal_weights), ("ic", ic_weights), ("ridge", lambda c: ridge_weights(signals, c))):
                part = weigh(chosen).withColumn("n_selected", F.count(F.lit(1)).over(Window.partitionBy("market")))
                part = part.select(F.lit(f"{cap}/{gate}/{name}").alias("portfolio"), "market", "factor", "sign", "weight", "n_selected")
                out = part if out is None else out.unionByName(part)
    return out


def style_neutral(scores: DataFrame, styles: DataFrame, least: int, names: Sequence[str] = STYLES) -> DataFrame:
    """Scores without their exposure to the styles, by portfolio; a portfolio that the styles explain almost wholly is left out."""
    rows = scores.select(F.col("portfolio").alias("factor"), "market", "asset", "date", F.col("score").alias("value"), F.lit(None).cast("double").alias("target"))
    rest, quality = residuals(rows, styles, names, least)
    noise = quality.groupBy("factor", "market").agg(F.avg("r2").alias("r2")).where(F.col("r2") >= NOISE_R2).select("factor", "market")
    kept = rest.join(noise, ["factor", "market"], "left_anti")
    return kept.select(F.col("factor").alias("portfolio"), "market", "asset", "date", F.round("residual", 10).alias("score"))


def backtest_grid(spark: SparkSession, folder: str, least_names: int = LEAST) -> DataFrame:
    """All portfolios of caps, gates and weightings, as they are and without style exposure, over the test segment.

    One axis at a time: rebalancing periods at the default cost, and costs at the default period. Signals are selected by
    their validation ICs and correlations. All portfolios run in one plan per kind and period, in which they are rows; a cost
    is a projection of a curve. A market without a selected factor, and a portfolio that holds nothing, say so in ``status``.
    """
    signals = stage(signal_table(spark, folder), "signals")
    table = stage(ic_table(signals), "ics")
    related = stage(mean_corr(signals, least=3).where("segment = 'valid'"), "related")
    weights = stage(grid_weights(signals, table, related), "weights")
    test = F.col("date").between(*map(F.lit, DEFAULT_SPLIT.test))
    raw = stage(composite(signals.where(test), weights, ["portfolio"]), "scores")
    neutral = style_neutral(raw, style_panel(spark, folder).where(test), least_names)
    scores = stage(raw.withColumn("signal", F.lit("raw")).unionByName(neutral.withColumn("signal", F.lit("style_neutral"))), "scores")
    grid = stage(market_grid(spark, folder).where(test).select("market", "asset", "date", "tradable", "returns"), "grid")
    returns, bench = grid.select("market", "asset", "date", F.round("returns", 10).alias("ret")), benchmark(grid)
    key = ["portfolio", "signal", "market"]
    curves = None
    for kind, base in (("long_only", LONG), ("long_short", SHORT)):
        for r in REBALANCE:
            daily = backtest(scores, returns, Book(kind, base.quantile, base.least, r), key)
            daily = stage(daily.withColumns({"kind": F.lit(kind), "rebalance": F.lit(r)}), "curve")
            curves = daily if curves is None else curves.unionByName(daily)
    costs = F.when(F.col("rebalance") == MAIN_REBALANCE, F.array(*map(F.lit, COSTS))).otherwise(F.array(F.lit(MAIN_COST)))
    curves = curves.withColumn("cost_bps", F.explode(costs)).withColumn("net", F.col("gross") - F.col("turnover") * (F.col("cost_bps") / 1e4) - F.col("borrow_cost"))
    of = [*key, "kind", "rebalance", "cost_bps"]
    active = F.when(F.col("kind") == "long_only", F.col("net_active_return")).alias("net_active_return")  # a book without net exposure has no benchmark
    cells = stage(performance(curves, bench, of).select(*of, "net_cagr", "net_sharpe", active, "turnover_annual", "avg_gross_exposure"), "cells")
    sizes = weights.select("portfolio", "market", "n_selected").distinct()
    cells = cells.join(sizes, ["portfolio", "market"]).withColumn("status", F.when(F.col("avg_gross_exposure") > 0, "ok").otherwise("degenerate"))
    named = F.explode(F.array(*[F.lit(f"{c}/{g}/{w}") for c in CAPS for g in GATES for w in WEIGHTINGS])).alias("portfolio")
    empty = table.select("market").distinct().select("market", named).join(sizes, ["portfolio", "market"], "left_anti")
    cells = cells.unionByName(empty.select("portfolio", "market", F.lit(0).cast("bigint").alias("n_selected"), F.lit("no qualifying composite").alias("status")), allowMissingColumns=True)
    part = F.split("portfolio", "/")
    return _rounded(cells.select(*[part[i].alias(n) for i, n in enumerate(("cap", "gate", "weighting"))], *[c for c in cells.columns if c != "portfolio"]), 6)


QUERIES = {
    "select_greedy": lambda s, d: _rounded(select_greedy(s, d)),
    "composite_equal": lambda s, d: _rounded(composite_scores(s, d), 7),
    "composite_ic": lambda s, d: _rounded(composite_scores(s, d, "ic"), 7),
    "composite_ridge": lambda s, d: _rounded(composite_scores(s, d, "ridge"), 7),
    "book_long_only": lambda s, d: _rounded(target_books(composite_scores(s, d), LONG)),
    "book_long_short": lambda s, d: _rounded(target_books(composite_scores(s, d), SHORT)),
    "backtest_long_only": lambda s, d: _rounded(_traded(s, d, LONG), 7),
    "backtest_long_short": lambda s, d: _rounded(_traded(s, d, SHORT), 7),
    "benchmark_returns": lambda s, d: _rounded(benchmark(market_grid(s, d))),
    "perf_metrics": lambda s, d: _rounded(performance(_traded(s, d, LONG), benchmark(market_grid(s, d))), 6),
    "composite_style": lambda s, d: _rounded(composite_style(s, d), 6),
    "backtest_grid": backtest_grid,
}

_COMP = f"""{signal_sql(NAMES)}, {DAILY_SQL}, {SEGMENT_SQL}, sg AS (SELECT factor, market, CASE WHEN max(CASE WHEN segment = 'train' THEN ic END) < 0 THEN -1 ELSE 1 END AS sign, max(CASE WHEN segment = 'valid' THEN ic END) AS vic FROM seg GROUP BY ALL),
zz AS (SELECT market, asset, date, factor, (rank() OVER (PARTITION BY factor, market, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, market, date, value) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY factor, market, date) - 0.5 AS z FROM sig)"""
_WEIGHT = {
    "equal": "wt AS (SELECT market, factor, sign, 1.0::DOUBLE / count(*) OVER (PARTITION BY market) AS weight FROM sg)",
    "ic": "wp AS (SELECT *, greatest(coalesce(round(sign * vic, 10), 0.0), 0.0) AS p FROM sg), wt AS (SELECT market, factor, sign, CASE WHEN sum(p) OVER (PARTITION BY market) > 0 THEN p / sum(p) OVER (PARTITION BY market) ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY market) END AS weight FROM wp)",
}


def _comp(how: str) -> str:
    return f"{_COMP}, {_WEIGHT[how]}, sc AS (SELECT zz.market, asset, date, round(sum(weight * sign * z), 10) AS score FROM zz JOIN wt ON zz.market = wt.market AND zz.factor = wt.factor GROUP BY ALL)"


def _books(b: Book) -> str:
    k = f"greatest(floor(n * {b.quantile}), 1)"
    weight = f"CASE WHEN up <= {k} THEN {b.long} / {k} END" if b.kind == "long_only" else f"CASE WHEN dn <= {k} THEN -{b.short} / {k} WHEN up <= {k} THEN {b.short} / {k} END"
    return f"{_comp('equal')}, rk AS (SELECT *, count(*) OVER (PARTITION BY market, date) AS n, row_number() OVER (PARTITION BY market, date ORDER BY score DESC, asset) AS up, row_number() OVER (PARTITION BY market, date ORDER BY score, asset) AS dn FROM sc WHERE score IS NOT NULL), bk AS (SELECT * FROM (SELECT market, date, asset, ({weight})::DOUBLE AS weight FROM rk WHERE n >= {b.least if b.kind == 'long_only' else 2 * b.least}) WHERE weight IS NOT NULL)"


def _backtest(b: Book) -> str:
    return f"""{_books(b)}, rt AS (SELECT market, asset, date, round(returns, 10) AS ret FROM grid), cd AS (SELECT market, date, row_number() OVER (PARTITION BY market ORDER BY date) - 1 AS t FROM (SELECT DISTINCT market, date FROM rt)), ln AS (SELECT market, max(t) AS last FROM cd GROUP BY ALL),
w AS (SELECT bk.market, asset, t + {b.lag + 1} AS e, weight FROM bk JOIN cd ON bk.market = cd.market AND bk.date = cd.date JOIN ln ON bk.market = ln.market WHERE t % {b.rebalance} = 0 AND t + {b.lag + 1} <= last),
ss AS (SELECT s.market, e, lead(e) OVER (PARTITION BY s.market ORDER BY e) AS nx, last FROM (SELECT DISTINCT market, e FROM w) s JOIN ln ON s.market = ln.market),
hd AS (SELECT market, e, nx, unnest(generate_series(e, coalesce(nx, last))) AS t FROM ss), rd AS (SELECT rt.market, asset, t, ret FROM rt JOIN cd ON rt.market = cd.market AND rt.date = cd.date),
ce AS (SELECT hd.market, hd.e, hd.t, coalesce(hd.t = nx, false) AS closing, w.asset, weight, ret FROM hd JOIN w ON hd.market = w.market AND hd.e = w.e LEFT JOIN rd ON hd.market = rd.market AND w.asset = rd.asset AND hd.t = rd.t),
gr AS (SELECT *, weight * coalesce(product(1 + coalesce(ret, 0.0)) OVER (PARTITION BY market, e, asset ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS g FROM ce),
hh AS (SELECT *, CASE WHEN sum(abs(g)) OVER o > 0 THEN g / sum(abs(g)) OVER o * sum(abs(weight)) OVER o ELSE g END AS h FROM gr WINDOW o AS (PARTITION BY market, e, t)),
dy AS (SELECT market, t, coalesce(sum(h * ret), 0.0) AS gross, sum(CASE WHEN h < 0 THEN -h ELSE 0.0 END) AS short, count_if(h > 0) AS n_long, count_if(h < 0) AS n_short, sum(abs(h)) AS ge, sum(h) AS ne FROM hh WHERE NOT closing GROUP BY ALL),
tv AS (SELECT market, t, sum(abs(d)) / 2 AS turnover FROM (SELECT market, t, asset, sum(h) AS d FROM (SELECT market, t, asset, h FROM hh WHERE NOT closing AND t = e UNION ALL SELECT market, t, asset, -h FROM hh WHERE closing) GROUP BY ALL) GROUP BY ALL),
bt AS (SELECT cd.market, cd.date, coalesce(gross, 0.0) AS gross, coalesce(turnover, 0.0) AS turnover, coalesce(turnover, 0.0) * {b.cost_bps / 1e4} AS trade_cost, coalesce(short, 0.0) * {b.borrow_bps / 1e4 / TRADING_DAYS} AS borrow_cost,
  coalesce(gross, 0.0) - coalesce(turnover, 0.0) * {b.cost_bps / 1e4} - coalesce(short, 0.0) * {b.borrow_bps / 1e4 / TRADING_DAYS} AS net, coalesce(n_long, 0) AS n_long, coalesce(n_short, 0) AS n_short, coalesce(ge, 0.0) AS gross_exposure, coalesce(ne, 0.0) AS net_exposure
  FROM cd LEFT JOIN dy ON cd.market = dy.market AND cd.t = dy.t LEFT JOIN tv ON cd.market = tv.market AND cd.t = tv.t)"""


_BM = "bm AS (SELECT market, date, avg(coalesce(returns, 0.0)) AS bench FROM grid WHERE coalesce(tradable, false) GROUP BY ALL)"
_DAILY_COLS = ["gross", "turnover", "trade_cost", "borrow_cost", "net", "gross_exposure", "net_exposure"]
_PERF = f"""{_backtest(LONG)}, {_BM}, p1 AS (SELECT bt.*, net - coalesce(bench, 0.0) AS active, product(1 + gross) OVER o AS wg, product(1 + net) OVER o AS wn FROM bt LEFT JOIN bm ON bt.market = bm.market AND bt.date = bm.date WINDOW o AS (PARTITION BY bt.market ORDER BY bt.date)),
p2 AS (SELECT *, wg / max(wg) OVER o - 1 AS dg, wn / max(wn) OVER o - 1 AS dn FROM p1 WINDOW o AS (PARTITION BY market ORDER BY date)),
pf AS (SELECT market, """ + ", ".join(f"CASE WHEN arg_max(w{t[0]}, date) > 0 THEN pow(arg_max(w{t[0]}, date), 1 / (count(*) / 252.0::DOUBLE)) - 1 END AS {t}_cagr, CASE WHEN max({t}) > min({t}) THEN avg({t}) / stddev_samp({t}) * sqrt(252.0::DOUBLE) END AS {t}_sharpe, min(d{t[0]}) AS {t}_max_dd" for t in ("gross", "net")) + """, coalesce(avg(CASE WHEN turnover > 0 THEN turnover END), 0.0) AS turnover_per_rebalance, sum(turnover) / (count(*) / 252.0::DOUBLE) AS turnover_annual, avg(gross_exposure) AS avg_gross_exposure, avg(net_exposure) AS avg_net_exposure, sum(borrow_cost) / (count(*) / 252.0::DOUBLE) AS borrow_cost_annual, count(*) AS days, avg(active) * 252 AS net_active_return, CASE WHEN max(active) > min(active) THEN avg(active) / stddev_samp(active) * sqrt(252.0::DOUBLE) END AS information_ratio FROM p2 GROUP BY market)"""
SQL = {
    "composite_equal": _sql(_comp("equal"), "SELECT * FROM sc", ["score"], ["market", "asset", "date"], 7),
    "composite_ic": _sql(_comp("ic"), "SELECT * FROM sc", ["score"], ["market", "asset", "date"], 7),
    "book_long_only": _sql(_books(LONG), "SELECT * FROM bk", ["weight"], ["market", "date", "asset"]),
    "book_long_short": _sql(_books(SHORT), "SELECT * FROM bk", ["weight"], ["market", "date", "asset"]),
    "backtest_long_only": _sql(_backtest(LONG), "SELECT * FROM bt", _DAILY_COLS, ["market", "date", "n_long", "n_short"], 7),
    "backtest_long_short": _sql(_backtest(SHORT), "SELECT * FROM bt", _DAILY_COLS, ["market", "date", "n_long", "n_short"], 7),
    "benchmark_returns": _sql(f"{GRID_SQL}, {_BM}", "SELECT * FROM bm", ["bench"], ["market", "date"]),
    "perf_metrics": _sql(_PERF, "SELECT * FROM pf", ["gross_cagr", "gross_sharpe", "gross_max_dd", "net_cagr", "net_sharpe", "net_max_dd", "turnover_per_rebalance", "turnover_annual", "avg_gross_exposure", "avg_net_exposure", "borrow_cost_annual", "net_active_return", "information_ratio"], ["market", "days"], 6),
}
