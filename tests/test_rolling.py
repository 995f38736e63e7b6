"""Trailing totals against a day-by-day loop."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgrid.operators.rolling import trailing_totals

SCHEMA = "row_id bigint, asset string, date date, close double, volume double, loaded_at timestamp, asset_sum_7 string, _n int"


def _run(spark, rows, periods=(7, 30)):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return trailing_totals(df, ["asset"], "date", ["close", "volume"], [F.col("loaded_at"), F.bitwise_not("row_id")], periods).collect()


def _brute(rows, periods=(7, 30)):
    best = {}
    for i, a, d, c, v, t in rows:
        if d is not None and ((a, d) not in best or (t, -i) > best[a, d][0]):
            best[a, d] = ((t, -i), c, v)
    out = {}
    for a in {k[0] for k in best}:
        days = sorted(d for x, d in best if x == a)
        d = days[0]
        while d <= days[-1]:
            for w in periods:
                for k, name in ((1, "close"), (2, "volume")):
                    vals = [best[a, e][k] for j in range(w) if (a, e := d - timedelta(j)) in best]
                    vals = [x for x in vals if x is not None and x == x]
                    out[a, d, name, w] = (round(sum(vals), 4), len(vals))
            d += timedelta(1)
    return out


def _check(got, want, periods=(7, 30)):
    assert len(got) == len({k[:2] for k in want})
    for r in got:
        for name in ("close", "volume"):
            for w in periods:
                total, n = want[r.asset, r.date, name, w]
                assert r[f"{name}_sum_{w}"] == pytest.approx(total, abs=1e-6) and r[f"{name}_n_{w}"] == n
                assert (r[f"{name}_avg_{w}"] is None) == (n == 0)
                if n:
                    assert r[f"{name}_avg_{w}"] == pytest.approx(total / n)


@pytest.mark.parametrize("periods", [(7, 30), (1, 5), (4,)])
def test_random_bars_with_gaps_nulls_and_redeliveries(spark, periods):
    rng = random.Random(3)
    rows, i = [], 0
    for a, start, n in (("A", date(2019, 12, 20), 700), ("B", date(2020, 2, 27), 40), (None, date(2020, 1, 1), 9)):
        for k in range(n):
            if rng.random() < 0.3 or (a == "A" and 300 < k < 540):  # a gap longer than a chunk
                continue
            for _ in range(rng.choice([1, 1, 1, 2])):
                i += 1
                v = rng.choice([None, float("nan"), 5.0, rng.random() * 100])
                rows.append((i, a, start + timedelta(k), round(rng.random() * 9, 3), v, datetime(2021, 1, 1) + timedelta(hours=rng.randrange(3))))
    rows += rows[:20]  # exact repetitions
    rows.append((9999, "A", None, 1.0, 1.0, datetime(2021, 1, 1)))
    _check(_run(spark, rows, periods), _brute(rows, periods), periods)


def test_one_bar_and_none(spark):
    assert _run(spark, []) == []
    (r,) = _run(spark, [(1, "A", date(1969, 12, 30), None, 2.0, datetime(2020, 1, 1))])
    assert (r.close_sum_7, r.close_n_7, r.close_avg_7, r.volume_sum_30) == (0.0, 0, None, 2.0)
