"""Impossible, frozen and spiking readings on small hand-made series."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from loomgrid.operators.anomalies import Rules, implausible

SCHEMA = "row_id bigint, asset string, date date, close double, high double, low double, volume double, loaded_at timestamp, _n string, spike string"
T0 = datetime(2020, 6, 1)


def _series(asset, n, start=0, seed=1, level=100.0):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        c = round(level * (1 + 0.01 * rng.uniform(-1, 1)), 4)
        rows.append([start + k, asset, date(2020, 1, 1) + timedelta(k), c, c * 1.01, c * 0.99, float(rng.randint(900, 1100)), T0])
    return rows


def _flags(spark, rows, rules=None):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    bad = F.coalesce(F.col("low") > F.col("high"), F.lit(False)) | F.coalesce(F.col("close") <= 0, F.lit(False))
    out = implausible(df, ["asset"], "date", "row_id", [F.col("loaded_at"), F.bitwise_not("row_id")], bad, rules)
    return {r.row_id: "".join(k for k, f in (("i", r.impossible), ("f", r.frozen), ("s", r.spike)) if f) for r in out.collect()}


def test_ordinary_series_are_left_alone(spark):
    assert _flags(spark, _series("A", 120) + _series("B", 60, 1000, 2, 5.0)) == {}
    assert _flags(spark, []) == {}


def test_spikes_of_one_and_two_bars_but_no_lasting_changes(spark):
    rows = _series("A", 120)
    rows[30][3] *= 3
    for k in (50, 51):
        rows[k][6] *= 40
    for k in range(80, 120):
        rows[k][3], rows[k][4], rows[k][5] = rows[k][3] * 2, rows[k][4] * 2, rows[k][5] * 2
    for k in (65, 66, 67):  # three bars are no spike
        rows[k][6] *= 40
    rows[10][5] = None
    assert _flags(spark, rows) == {30: "s", 50: "s", 51: "s"}


def test_spike_beside_an_impossible_reading_and_at_the_ends(spark):
    rows = _series("A", 60)
    rows[20][3] = -5.0
    rows[21][3] *= 4
    rows[0][3] *= 4
    rows[59][3] *= 4
    assert _flags(spark, rows) == {20: "i", 21: "s"}


def test_frozen_runs_need_eight_and_nulls_end_them(spark):
    rows = _series("A", 100)
    for k in range(10, 18):
        rows[k][3] = 100.0
    for k in range(30, 37):
        rows[k][3] = 100.0
    for k in range(50, 60):
        rows[k][6] = 1000.0
    rows[54][6] = None
    for k in range(70, 86):
        rows[k][6] = None
    del rows[12:13]  # an absent day does not interrupt, but now only seven are left
    assert _flags(spark, rows) == {}
    rows.insert(12, [12, "A", date(2020, 1, 13), 100.0, 101.0, 99.0, 950.0, T0])
    assert _flags(spark, rows) == {k: "f" for k in range(10, 18)}


def test_a_replaced_delivery_is_judged_by_its_own_values(spark):
    rows = _series("A", 60)
    rows += [[500, "A", rows[30][2], rows[30][3] * 5, rows[30][4], rows[30][5], rows[30][6], T0 - timedelta(1)]]  # replaced, bad
    rows += [[501, "A", rows[40][2], *rows[40][3:7], T0 - timedelta(1)]]  # replaced, same as current
    rows += [[502, "A", rows[41][2], 1.0, 0.5, 0.7, 1000.0, T0 - timedelta(1)]]
    rows += [list(rows[5]), [503, "A", None, -1.0, 1.0, 2.0, 1.0, T0], [None, "A", rows[3][2], -1.0, 1.0, 2.0, 1.0, T0]]
    assert _flags(spark, rows) == {500: "s", 502: "is", 503: "i"}


def test_null_keys_and_constant_sources(spark):
    rows = _series(None, 40) + [[900 + k, "C", date(2020, 1, 1) + timedelta(k), 7.0, 7.0, 7.0, None, T0] for k in range(9)]
    rows[20][3] *= 9
    assert _flags(spark, rows) == {20: "s", **{900 + k: "f" for k in range(9)}}
    assert _flags(spark, rows, Rules(frozen=10)) == {20: "s"}


def test_spikes_of_two_bars_with_one_bar_beside_them(spark):
    rows = _series("A", 60) + _series("B", 60, 1000, 3)
    for k in (57, 58):  # one ordinary bar after them
        rows[k][3] *= 4
    for k in (1, 2):  # one ordinary bar before them
        rows[60 + k][6] *= 50
    rows[60 + 57][3] *= 4  # a lone spike with two bars after it
    assert _flags(spark, rows) == {57: "s", 58: "s", 1001: "s", 1002: "s", 1057: "s"}
