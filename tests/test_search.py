"""Search metrics, scores against a zoo and their gates, and the fit of a signal table to its panel."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from loomgrid.plans.search import alignment, search_metrics, search_scores, signal_fitness

S = "factor string, market string, asset string, date date, value double, target double"
DAYS = [date(2020, 1, 1) + timedelta(d) for d in range(6)]


def _signals(spark):
    rows = [("up", "m", f"a{a}", d, float(a), a / 10 + (0.01 if (a + d.day) % 3 else 0)) for a in range(5) for d in DAYS]
    rows += [("down", "m", f"a{a}", d, -float(a), a / 10) for a in range(5) for d in DAYS]
    rows += [("odd", "m", f"a{a}", d, float((a * 7 + d.day * 3) % 5), a / 10) for a in range(5) for d in DAYS]
    rows += [("none", "m", f"a{a}", d, None, a / 10) for a in range(5) for d in DAYS]
    return spark.createDataFrame(rows, S)


def test_fitness_and_metrics(spark):
    fit = {r.factor: r for r in signal_fitness(_signals(spark)).collect()}
    assert fit["down"].rank_ic == pytest.approx(-1) and fit["down"].rank_icir == 0 and fit["down"].n_days == 6 and fit["down"].coverage == 1
    assert (fit["none"].ic, fit["none"].n_days, fit["none"].coverage) == (0, 0, 0)
    got = {r.factor: r for r in search_metrics(_signals(spark), ["up"]).collect()}
    assert got["down"].max_correlation == pytest.approx(1) and got["down"].turnover == pytest.approx(0)
    assert got["none"].turnover is None and got["none"].max_correlation == 0 and got["up"].max_correlation == 0
    assert got["odd"].turnover > 0.5


def test_scores_and_gates(spark):
    m = "factor string, market string, rank_ic double, rank_ir double, turnover double, max_correlation double, n_days bigint"
    rows = [("z1", "m", 0.02, 0.4, 0.5, 0.1, 9), ("z2", "m", 0.04, 0.8, 1.0, 0.2, 9), ("good", "m", 0.03, 0.9, 0.4, 0.3, 9), ("low", "m", 0.01, 0.9, 0.4, 0.3, 9), ("shaky", "m", 0.03, 0.1, 0.4, 0.3, 9)]
    rows += [("busy", "m", 0.03, 0.9, 1.7, 0.3, 9), ("idle", "m", 0.03, 0.9, None, 0.3, 9), ("twin", "m", 0.03, 0.9, 0.4, 0.8, 9), ("late", "m", 0.016, 0.9, 0.4, 0.3, 9), ("alone", "n", 0.03, 0.9, 0.4, 0.3, 9)]
    got = {r.factor: r for r in search_scores(spark.createDataFrame(rows, m), ["z1", "z2"]).collect()}
    assert {f: r.failed_gate for f, r in got.items()} == {"z1": "", "z2": "", "good": "", "low": "rank_ic", "shaky": "rank_ir", "busy": "turnover", "idle": "turnover", "twin": "correlation", "late": "rank_ic_pct", "alone": ""}
    good = got["good"]
    assert (good.e_effectiveness, good.e_stability, good.e_turnover_low, good.e_diversity) == (0.5, 1, 1, 0)
    whole = 2 + math.exp(0.5) + math.e
    assert good.p_diversity == pytest.approx(math.e / whole) and got["alone"].e_stability == 0.5 and got["idle"].e_turnover_low == 0


def test_alignment(spark):
    bars = spark.createDataFrame([("m", "a", DAYS[0]), ("m", "b", DAYS[1])], "market string, asset string, date date")
    rows = [("f", "m", "a", DAYS[0], 1.0), ("f", "m", "x", DAYS[1], float("inf")), ("f", "m", None, DAYS[5], None), ("f", "m", "b", date(2010, 1, 1), float("nan")), ("g", "k", "a", DAYS[0], 2.0)]
    df = spark.createDataFrame(rows, "id string, market string, asset string, day date, value double")
    got = {r.factor: (r.n_rows, r.no_asset, r.n_inf, r.n_finite, r.assets_unknown, r.dates_unknown) for r in alignment(df, bars, "id", F.col("day")).collect()}
    assert got == {"f": (4, 1, 1, 1, 1, 1), "g": (1, 0, 0, 1, 1, 1)}
    assert alignment(df.limit(0), bars, "id", F.col("day")).count() == 0
