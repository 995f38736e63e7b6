"""Batches on arrays over the cells that bars can reach, against the same over the dense grid."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import loomgrid.plans.checks as checks
import loomgrid.plans.factors as factors
from loomgrid.functions.expr import FIELDS, parse_formula
from loomgrid.plans.arrays import _round, active_grid, evaluate_active, lookback
from loomgrid.plans.checks import compare_window as kept_window
from loomgrid.plans.compile import evaluate
from loomgrid.sources.panel import dense_grid


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, days = random.Random(3), [], [date(2020, 1, 1) + timedelta(d) for d in range(420)]
    for market, n in (("m", 14), ("n", 5)):
        for a in range(n):
            first = rng.randrange(0, 380)
            for d in range(first, min(420, first + rng.randrange(3, 140))):
                if rng.random() < 0.9 and not (a % 3 == 0 and first + 20 < d < first + 50):
                    o, c, v = (float(rng.randrange(10, 40)) for _ in range(3))
                    rows.append((len(rows), market, days[d], f"a{a}", o, max(o, c) + rng.randrange(3), min(o, c), None if rng.random() < 0.05 else c, v * 1000, (o + c) / 2, True, days[d]))
    path = str(tmp_path_factory.mktemp("active"))
    spark.createDataFrame(rows, "row_id bigint, market string, date date, asset string, open double, high double, low double, close double, volume double, vwap double, tradable boolean, loaded_at date").write.parquet(f"{path}/download_all.parquet")
    return path


def _rows(df):
    return sorted(map(str, df.collect()))


def _same(spark, folder, name):
    got = factors.QUERIES[name](spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "_n" in plan
    assert _rows(got) == _rows(factors.factor_query(factors._FACTORS[name])(spark, folder))


def test_f1_wide_windows(spark, folder):
    _same(spark, folder, "alphas_034_040")


def test_f2_correlations_of_ranks(spark, folder):
    _same(spark, folder, "alphas_065_075")


def test_f3_ranks_of_products(spark, folder):
    _same(spark, folder, "alphas_077_085")


def test_operators(spark, folder):
    texts = ["covariance(rank(close), rank(volume), 5)", "correlation(close, volume, 7)", "scale(corr0(open, volume, 4))", "ts_rank(close - delay(close, 2), 6)", "where(ts_min(close, 3) > open, high / (close - open), -1 * vwap)", "stddev(rank(fill(volume / (close - open), 1)), 9)", "ts_max(rank(log(ts_sum(volume, 3))), 4)"]
    trees = {f"f{i}": parse_formula(t) for i, t in enumerate(texts)}
    bars = factors.current_bars(spark, folder, [])
    got = evaluate_active(active_grid(bars, max(map(lookback, trees.values()))), trees).where("present")
    want = factors.factor_query(trees)(spark, folder)
    assert _rows(got.select("market", "asset", "date", *[factors.stable(F.col(n)).alias(n) for n in trees])) == _rows(want)


def test_the_grid_holds_what_bars_can_reach(spark, folder):
    bars = factors.current_bars(spark, folder, [])
    grid = active_grid(bars, 4, FIELDS)
    assert grid.where("present").count() == bars.count()
    assert grid.where("asset IS NOT NULL").count() < 0.3 * (14 + 5) * 420
    number = {r.market: r.n for r in bars.groupBy("market").agg(F.count_distinct("asset").alias("n")).collect()}
    assert {(r.market, -r._w) for r in grid.where("asset IS NULL").collect()} == set(number.items())


def test_rounding_is_that_of_the_engine(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-9, 14, 500), rng.integers(-999, 999, 200) / 2.0**9, [0.0000000005, 2.5e-10, 1.0000000015, 5e6 + 1 / 3, -0.5, 0.0, np.inf]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    for digits in (9, 10, 12):
        want = np.array([r.y for r in df.select("i", F.round("x", digits).alias("y")).orderBy("i").collect()])
        with np.errstate(all="ignore"):
            np.testing.assert_array_equal(_round(x, digits), want)


def test_f4_look_ahead_over_the_compared_dates(spark, folder, monkeypatch):
    bars, cuts = factors.current_bars(spark, folder, []), [date(2020, 6, 1), date(2020, 12, 1)]
    kept = []
    monkeypatch.setattr(checks, "compare_window", lambda a, b, *rest, f=checks.compare_window: kept.append((a, b)) or f(a, b, *rest))
    got = checks.lookahead(bars, factors.SIGNALS, cuts)
    assert all(r.n <= 60 for pair in kept for df in pair for r in df.groupBy("market").agg(F.count_distinct("date").alias("n")).collect())
    # the same over the dense grid with all dates
    real, want = evaluate(factors.market_grid(spark, folder), factors.SIGNALS), None
    for cut in cuts:
        grid = dense_grid(checks.tamper(bars, cut), FIELDS)
        grid = grid.withColumn("returns", F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy("market", "asset").orderBy("date"))) - 1)
        part = kept_window(real, evaluate(grid, factors.SIGNALS), list(factors.SIGNALS), cut).withColumn("cut", F.lit(cut))
        want = part if want is None else want.unionByName(part)
    assert _rows(got) == _rows(want) and {r.status for r in got.collect()} <= {"clean", "no_signal"}
    # a change of the past is seen
    late = checks.lookahead(bars, factors.SIGNALS, cuts[1:], None, lambda df, cut: checks.scale_future(df, cut - timedelta(20)))
    assert "lookahead" in {r.status for r in late.where("factor = 'level'").collect()}
