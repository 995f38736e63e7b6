"""The registered queries use the reference's draws, penalties, grids and cuts."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import loomgrid.plans.checks as checks
import loomgrid.plans.portfolio as portfolio
from loomgrid.plans.factors import SIGNALS
from loomgrid.plans.inference import block_bootstrap
from loomgrid.plans.style import STYLES


def test_bootstrap_draws(spark):
    rows = [("m", 0, date(2020, 1, 1) + timedelta(i), 0.01 + (i % 3) / 1000) for i in range(30)]
    got = block_bootstrap(spark.createDataFrame(rows, "market string, seed int, date date, ret double")).first()
    assert got.n_boot == 2000 and got.p_value < 1 / 201


def test_ridge_may_choose_the_ends():
    assert portfolio.ridge_weights.__defaults__[0] == (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)


def test_backtest_grid(spark, monkeypatch):
    rng = random.Random(5)
    cells = [(f"a{a}", date(2024, 1, 1) + timedelta(d)) for a in range(9) for d in range(45)]
    signals = spark.createDataFrame([(f, "m", a, d, rng.random(), rng.random()) for f in ("f", "g") for a, d in cells], "factor string, market string, asset string, date date, value double, target double")
    table = spark.createDataFrame([("m", "f", "valid", 1, 0.2, 300), ("m", "g", "valid", -1, -0.1, 300), ("n", "f", "valid", 1, -0.1, 9)], "market string, factor string, segment string, sign int, ic double, n_dates bigint")
    related = spark.createDataFrame([("m", "valid", "f", "g", 0.1)], "market string, segment string, f_i string, f_j string, spearman double")
    styles = spark.createDataFrame([("m", a, d, *[rng.random() for _ in STYLES]) for a, d in cells], "market string, asset string, date date, " + ", ".join(f"{s} double" for s in STYLES))
    grid = spark.createDataFrame([("m", a, d, True, rng.random() / 50) for a, d in cells], "market string, asset string, date date, tradable boolean, returns double")
    for name, value in {"signal_table": signals, "ic_table": table, "mean_corr": related, "style_panel": styles, "market_grid": grid}.items():
        monkeypatch.setattr(portfolio, name, lambda *a, _v=value, **k: _v)
    monkeypatch.setattr(portfolio, "ridge_weights", lambda signals, chosen: portfolio.equal_weights(chosen))
    got = portfolio.backtest_grid(spark, "").collect()
    held = [r for r in got if r.market == "m"]
    axes = {(r, 10.0) for r in (1, 5, 10, 15, 20)} | {(20, c) for c in (0.0, 5.0, 10.0, 20.0, 50.0)}
    names = {(c, g, w) for c in ("full", "top10") for g in ("off", "on") for w in ("equal", "ic", "ridge")}
    assert {(r.cap, r.gate, r.weighting) for r in held} == names and len(held) == 12 * 2 * 2 * 9
    assert {(r.kind, r.rebalance, r.cost_bps) for r in held} == {(k, *c) for k in ("long_only", "long_short") for c in axes}
    assert {r.n_selected for r in held if r.gate == "off"} == {2} and {r.n_selected for r in held if r.gate == "on"} == {1}
    assert {r.status for r in held} == {"ok"} and {r.signal for r in held} == {"raw", "style_neutral"}
    assert {(r.cap, r.gate, r.weighting) for r in got if r.market == "n"} == names and {r.status for r in got if r.market == "n"} == {"no qualifying composite"}
    # one cell against a backtest of its own
    weights = portfolio.equal_weights(spark.createDataFrame([("m", "f", 1), ("m", "g", -1)], "market string, factor string, sign int"))
    base = portfolio.LONG
    daily = portfolio.backtest(portfolio.composite(signals, weights), grid.select("market", "asset", "date", F.round("returns", 10).alias("ret")), portfolio.Book("long_only", base.quantile, base.least, 5))
    own = portfolio.performance(daily).first()
    cell = next(r for r in held if (r.cap, r.gate, r.weighting, r.signal, r.kind, r.rebalance) == ("full", "off", "equal", "raw", "long_only", 5))
    assert cell.net_sharpe == pytest.approx(own.net_sharpe, abs=1e-5) and cell.turnover_annual == pytest.approx(own.turnover_annual, abs=1e-5)


def test_a_portfolio_without_positions_is_degenerate(spark):
    flat = spark.createDataFrame([("m", date(2024, 1, d), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for d in range(1, 9)], "market string, date date, gross double, turnover double, borrow_cost double, net double, gross_exposure double, net_exposure double")
    assert portfolio.performance(flat).first().avg_gross_exposure == 0


def test_look_ahead_of_all_signals_at_all_cuts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(checks, "_bars", lambda s, d: None)
    monkeypatch.setattr(checks, "lookahead", lambda bars, factors, cuts, *a: seen.update(factors=set(factors), cuts=list(map(str, cuts))) or spark.range(1).select(F.lit(1.0).alias("x")))
    checks.QUERIES["lookahead_clean"](spark, "")
    assert seen == {"factors": set(SIGNALS), "cuts": ["2019-06-28", "2022-12-30", "2024-12-31"]}
