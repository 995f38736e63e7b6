"""Rank aggregation against an evaluation by the beta distribution's integral."""

import random
from math import comb

import pytest

from loomgrid.llm.ranking import aggregate_ranking

SCHEMA = "id bigint, grp string, a double, b double, c double, _before string, r_a string"


def _rank(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(aggregate_ranking(df, "id", ["a", "b", "c"], **kw).collect())


def _brute(rows, within):
    rows = list({r for r in map(str, rows)}) and list(dict.fromkeys(r for r in rows if r[0] is not None))
    ok = lambda x: x is not None and x == x
    ranks = {}
    for r in rows:
        out = []
        for k in (2, 3, 4):
            pool = [s[k] for s in rows if ok(s[k]) and (not within or s[1] == r[1])]
            out.append(((sum(v > r[k] for v in pool)) + (sum(v == r[k] for v in pool) + 1) / 2) / len(pool) if ok(r[k]) else 1.0)
        x = sorted(out)
        rho = min(sum(comb(3, j) * x[k - 1] ** j * (1 - x[k - 1]) ** (3 - j) for j in range(k, 4)) for k in (1, 2, 3))
        ranks[r[0]] = (min(1.0, 3 * rho), sum(out) / 3)
    order = sorted(ranks, key=lambda i: (round(ranks[i][0], 12), round(ranks[i][1], 12), i))
    return order, ranks


@pytest.mark.parametrize("within", [(), ("grp",)])
def test_against_brute_force(spark, within):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        g = rng.choice(["x", "y", None])
        rows.append((i, g, rng.choice([None, float("nan"), rng.gauss(0, 1)]), rng.gauss(0, 1000 if g == "x" else 1), 0.0 if rng.random() < 0.4 else rng.choice([-0.0, 1.0, rng.random()])))
    rows += rows[:40] + [(None, "x", 1.0, 1.0, 1.0)]
    order, ranks = _brute(rows, within)
    got = _rank(spark, rows, within=within)
    assert [r.position for r in got] == list(range(1, len(order) + 1))
    assert {r.id for r in got} == set(order)
    for r in got:
        assert (r.significance, r.mean_rank) == pytest.approx(ranks[r.id])
    assert [r.id for r in got][:20] == order[:20]


def test_scale_does_not_matter(spark):
    rng = random.Random(6)
    rows = [(i, "x", rng.random(), rng.random(), rng.random()) for i in range(50)]
    other = [(i, g, a * 1e6, b**3, c) for i, g, a, b, c in rows]
    assert [r.id for r in _rank(spark, rows)] == [r.id for r in _rank(spark, other)]


def test_empty(spark):
    assert _rank(spark, []) == []
