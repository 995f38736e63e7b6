"""Version history against a loop over snapshots."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgrid.operators.history import version_history

SCHEMA = "snapshot_id bigint, asset string, sym string, flag boolean, day date, received_at timestamp, _row string"


def _history(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    out = version_history(df, ["asset"], "day", [F.col("received_at"), F.bitwise_not("snapshot_id")], {"flag": F.coalesce("flag", F.lit(False)), "sym": F.upper(F.trim(F.coalesce("sym", F.lit(""))))}, **kw)
    return sorted(((r.asset, r.valid_from, r.valid_to, r.flag, r.sym) for r in out.collect()), key=str)


def _brute(rows):
    best = {}
    for i, a, s, f, d, t in rows:
        if d is not None and ((a, d) not in best or (t, -i) > best[a, d][0]):
            best[a, d] = ((t, -i), bool(f), (s or "").strip().upper())
    out = []
    for a in {k[0] for k in best}:
        versions = []
        for d in sorted(d for x, d in best if x == a):
            if not versions or versions[-1][1:] != best[a, d][1:]:
                versions.append((d, *best[a, d][1:]))
        for k, (d, f, s) in enumerate(versions):
            out.append((a, d, versions[k + 1][0] - timedelta(1) if k + 1 < len(versions) else None, f, s))
    return sorted(out, key=str)


@pytest.mark.parametrize("leaves,fan_out", [(4096, 16), (4, 2), (1, 2), (None, 16)])
def test_against_brute_force(spark, leaves, fan_out):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        a = rng.choice(["A", "B", "C", "D", "E", None, *["A"] * 5])
        day = date(2020, 1, 1) + timedelta(7 * rng.randrange(30)) if rng.random() > 0.02 else None
        rows.append((i, a, rng.choice(["x", " X ", "y", None, ""]) if rng.random() < 0.3 else "x", rng.choice([True, None, False]) if rng.random() < 0.2 else True, day, datetime(2021, 1, 1) + timedelta(hours=rng.randrange(4))))
    rows += rows[:30]
    assert _history(spark, rows, leaves=leaves, fan_out=fan_out) == _brute(rows)


def test_no_snapshots_and_one(spark):
    assert _history(spark, []) == []
    row = (1, "A", None, None, date(2020, 1, 1), None)
    assert _history(spark, [row, row]) == [("A", date(2020, 1, 1), None, False, "")]


def test_node_of_many_entities(spark):
    """Ten thousand entities a day below a node: sums of their hashes have more than 20 digits."""
    n, days = 20_000, [date(2020, 1, 1), date(2020, 1, 8), date(2020, 1, 15)]
    ids = spark.range(n).crossJoin(spark.createDataFrame([(d,) for d in days], "day date"))
    changed = (F.col("id") == 77) & (F.col("day") == F.lit(days[1]))
    df = ids.select((F.col("id") * 10 + F.dayofmonth("day")).alias("snapshot_id"), F.col("id").cast("string").alias("asset"), F.when(changed, "b").otherwise("a").alias("sym"), "day")
    out = version_history(df, ["asset"], "day", [F.col("snapshot_id")], {"sym": F.col("sym")}, leaves=4, fan_out=2)
    assert out.count() == n + 2
    assert sorted((r.valid_from, r.valid_to, r.sym) for r in out.where("asset = '77'").collect()) == [(days[0], date(2020, 1, 7), "a"), (days[1], date(2020, 1, 14), "b"), (days[2], None, "a")]
    assert out.where("valid_from = date'2020-01-01' AND valid_to IS NULL").count() == n - 1


def test_several_levels_above_the_buckets(spark):
    rng = random.Random(3)
    rows = [(i, f"E{rng.randrange(60)}" if rng.random() > 0.3 else None, rng.choice("xy") if rng.random() < 0.2 else "x", True, date(2020, 1, 1) + timedelta(rng.randrange(12)), datetime(2021, 1, 1)) for i in range(1500)]
    assert _history(spark, rows, leaves=64, fan_out=2) == _brute(rows)


def test_settings_stay_as_they_are(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    _history(spark, [(1, "A", "x", True, date(2020, 1, 1), None)])
    assert spark.conf.get(key) == before
