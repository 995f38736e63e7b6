"""Attributes as known at event time against a scan over all versions."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from loomgrid.operators.bitemporal import as_known, rectangles

V = "row_id bigint, asset string, date date, loaded_at timestamp, cap double, value double, _t string"
E = "signal_id bigint, asset string, signal_at timestamp, value double, _cell int"


def _frames(spark, events, versions):
    return spark.createDataFrame([(*e, 1.5, 7) for e in events], E), spark.createDataFrame([(*v, v[0] / 2, "c") for v in versions], V)


def _known(spark, events, versions, **kw):
    e, v = _frames(spark, events, versions)
    out = as_known(e, v.withColumnRenamed("row_id", "rid"), ["asset"], "signal_at", "date", "loaded_at", "rid", ["rid", "cap", "value"], **kw)
    assert out.columns == ["signal_id", "asset", "signal_at", "value", "_cell", "rid", "cap", "value_known"]
    return sorted((r.signal_id, r.rid, r.value_known) for r in out.collect())


def _brute(events, versions):
    out = []
    for s, a, t in events:
        fit = [v for v in versions if None not in (a, t, v[1], v[2], v[3], v[0]) and v[1] == a and v[3] <= t]
        if fit:
            best = max(fit, key=lambda v: (v[2], v[3], -v[0]))
            out.append((s, best[0], best[0] / 2))
    return sorted(out)


def _data(seed, n=300):
    rng = random.Random(seed)
    base = datetime(2020, 1, 1)
    when = lambda: rng.choice([None, *[base + timedelta(days=rng.randrange(200), hours=rng.randrange(3))] * 8])
    versions = [(i, rng.choice(["A", "A", "A", "B", None]), (date(2020, 1, 1) + timedelta(rng.randrange(150))) if rng.random() > 0.05 else None, when(), rng.choice([None, 2.0])) for i in range(n)]
    versions += [(1000 + i, "A", date(2019, 1, 1) + timedelta(i), base, None) for i in range(50)]  # history in bulk
    events = [(i, rng.choice(["A", "B", "C", None]), when()) for i in range(n)]
    return events + events[:10], versions


def test_against_brute_force(spark):
    for seed, cell in ((1, 86_400), (2, 16 * 86_400), (3, 10_000 * 86_400)):
        events, versions = _data(seed)
        assert _known(spark, events, versions, cell_seconds=cell) == _brute(events, versions)


def test_same_instant_and_ties(spark):
    t = datetime(2020, 1, 2)
    versions = [(5, "A", date(2020, 1, 1), t, None), (3, "A", date(2020, 1, 1), t, 1.0), (9, "A", date(2019, 1, 1), datetime(2021, 1, 1), None)]
    events = [(1, "A", t), (2, "A", t - timedelta(microseconds=1)), (3, "A", datetime(2022, 1, 1))]
    assert _known(spark, events, versions) == [(1, 3, 1.5), (3, 3, 1.5)]


def test_empty_sides(spark):
    events, versions = _data(4, 5)
    assert _known(spark, [], versions) == [] and _known(spark, events, []) == []


def test_rectangles_are_disjoint_and_locate_the_same_version(spark):
    events, versions = _data(5)
    _, v = _frames(spark, events, versions)
    until = max(t for *_, t in events if t)
    rects = rectangles(v, ["asset"], "date", "loaded_at", "row_id", F.lit(until), cell_seconds=5 * 86_400).collect()
    for a in ("A", "B"):
        own = sorted((r for r in rects if r.asset == a), key=lambda r: r.recorded_from)
        assert all(x.recorded_to == y.recorded_from for x, y in zip(own, own[1:])) and own[-1].recorded_to > until
        assert all(x.recorded_to - x.recorded_from <= timedelta(days=5) for x in own)
    want = {s: r for s, r, _ in _brute(events, versions)}
    for s, a, t in events:
        hit = [r.tie for r in rects if a is not None and t is not None and r.asset == a and r.recorded_from <= t and t < r.recorded_to]
        assert hit == ([want[s]] if s in want else [])


def test_bounded_valid_time_against_brute_force(spark):
    rng = random.Random(7)
    events, versions = _data(6)
    asked = [(s, a, t, date(2019, 1, 1) + timedelta(rng.randrange(600)) if rng.random() > 0.1 else None) for s, a, t in events]
    e = spark.createDataFrame(asked, "signal_id bigint, asset string, signal_at timestamp, day date")
    _, v = _frames(spark, [], versions)
    out = as_known(e, v, ["asset"], "signal_at", "date", "loaded_at", "row_id", ["row_id"], valid_at="day").collect()
    want = []
    for s, a, t, day in asked:
        best = _brute([(s, a, t)], [x for x in versions if day and x[2] and x[2] <= day])
        want += [(b[0], b[1]) for b in best]
    assert sorted((r.signal_id, r.row_id) for r in out) == sorted(want) and len(want) > 80


def test_valid_days_beyond_the_blocks(spark):
    rows = [(1, "A", date(1700, 1, 1), datetime(2020, 1, 1), None), (2, "A", date(2020, 1, 1), datetime(2020, 1, 1), None)]
    _, v = _frames(spark, [], rows)
    e = spark.createDataFrame([(i, "A", datetime(2021, 1, 1), d) for i, d in enumerate([date(1650, 1, 1), date(2019, 12, 31), date(2020, 1, 1), date(9999, 12, 31)])], "signal_id bigint, asset string, signal_at timestamp, day date")
    out = as_known(e, v, ["asset"], "signal_at", "date", "loaded_at", "row_id", ["row_id"], valid_at="day").collect()
    assert sorted((r.signal_id, r.row_id) for r in out) == [(1, 1), (2, 2), (3, 2)]
