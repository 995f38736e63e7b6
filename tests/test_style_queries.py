"""The registered style queries regress on all five styles."""

import random
from datetime import date, timedelta

import numpy as np
import pytest

import loomgrid.plans.portfolio as portfolio
import loomgrid.plans.style as style
from loomgrid.plans.factors import SIGNALS

DAYS = [date(2018, 1, 1) + timedelta(i) for i in range(3)]
ASSETS = [f"a{i:02}" for i in range(style.LEAST + 5)]


@pytest.fixture(scope="module")
def panel():
    rng = random.Random(6)
    return [("m", a, d, *[rng.gauss(0, 1) for _ in range(len(style.STYLES) + 2)]) for d in DAYS for a in ASSETS]


def _r2(panel, names):
    at, out = [3 + style.STYLES.index(n) for n in names], []
    for d in DAYS:
        rows = [r for r in panel if r[2] == d]
        y = np.array([r[-2] for r in rows])
        x = np.column_stack([np.ones(len(rows)), *[[r[i] for r in rows] for i in at]])
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        out.append(1 - e @ e / ((y - y.mean()) @ (y - y.mean())))
    return np.mean(out)


def _styles(spark, panel):
    return spark.createDataFrame([r[:-2] for r in panel], "market string, asset string, date date, " + ", ".join(f"{s} double" for s in style.STYLES))


def test_style_summary_has_five_styles_and_all_signals(spark, panel, monkeypatch):
    def signals(s, folder, names=tuple(SIGNALS)):
        return spark.createDataFrame([(n, *r[:3], r[-2], r[-1]) for n in names for r in panel], "factor string, market string, asset string, date date, value double, target double")

    monkeypatch.setattr(style, "signal_table", signals)
    monkeypatch.setattr(style, "style_panel", lambda s, d: _styles(spark, panel))
    got = {r.factor: r for r in style.QUERIES["style_summary"](spark, "").collect()}
    assert set(got) == set(SIGNALS) and all(r.r2 == pytest.approx(_r2(panel, style.STYLES), abs=1e-5) for r in got.values())


def test_composite_style_has_five_styles(spark, panel, monkeypatch):
    monkeypatch.setattr(portfolio, "market_grid", lambda s, d: spark.createDataFrame([(*r[:3], r[-1], True) for r in panel], "market string, asset string, date date, target double, present boolean"))
    monkeypatch.setattr(portfolio, "composite_scores", lambda s, d: spark.createDataFrame([(*r[:3], r[-2]) for r in panel], "market string, asset string, date date, score double"))
    monkeypatch.setattr(portfolio, "style_panel", lambda s, d: _styles(spark, panel))
    assert portfolio.QUERIES["composite_style"](spark, "").first().r2 == pytest.approx(_r2(panel, style.STYLES), abs=1e-5)
    two = portfolio.composite_style(spark, "", ("volatility", "reversal"), 4).first()
    assert two.r2 == pytest.approx(_r2(panel, ("volatility", "reversal")), abs=1e-5)
