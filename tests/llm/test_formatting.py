"""Canonical formulas and collapsed copies."""

import random

import pytest

from loomgrid.llm.formatting import canonical, collapse, copies


@pytest.mark.parametrize(
    "a,b",
    [
        ("Kurt(x=Ref(x=$low, d=186d), d=57d)", "kurt{ d: 57d,\n x: ref[x=LOW; d = 186D] }"),
        ("Std(Sub(Cov($low,$close,56d),Tanh($high)),223d)", "std sub cov $low $close 56d tanh $high 223d"),
        ("f(1, b=2, a=3)", "(F(1; a=3; b=2));"),
        ("mean [ts_corr [$high , inv [$low] , 216d] , 55d])", "Mean(TsCorr(high,Inv(low),216d),55d"),
        ("df['low'].shift(periods=3,fill_value=None)", 'DF["low"].shift(fill_value=None, periods=3)\n'),
        ("", " ._-() "),
    ],
)
def test_same(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize("a,b", [("f(a,b)", "f(b,a)"), ("f(x=1,y=2)", "f(x=2,y=1)"), ("f(x==1,y)", "f(y,x==1)"), ("f(x=1)", "f(x=1,x=1)"), ("a=1; b=2", "b=2; a=1")])
def test_different(a, b):
    assert canonical(a) != canonical(b)


def _pairs(spark, rows):
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "id bigint, kind string, text string, key string, part int")
    return {(r.id, r.first_id) for r in collapse(df, "id", "kind", "text").collect()}, {r.first_id: r.n_copies for r in copies(df, "id", "kind", "text").collect()}


def test_hot_group_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(i, "e", "Hot( a )" if rng.random() < 0.4 else f"f(x={rng.randrange(40)})" if rng.random() < 0.9 else None) for i in range(3000)]
    rows += [(i, "c", "hot(a)") for i in range(4000, 4100)] + [(5000 + i, None, "hot a") for i in range(3)] + [(None, "e", "hot(a)")]
    rows += rows[:500]
    groups = {}
    for i, k, t in rows:
        if i is not None and t is not None:
            groups.setdefault((k, canonical(t)), set()).add(i)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found, counts = _pairs(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {(i, min(g)) for g in groups.values() for i in g}
    assert counts == {min(g): len(g) for g in groups.values()}


def test_empty_and_long(spark):
    assert _pairs(spark, []) == (set(), {})
    long = "f(" + "x=" * 0 + ",".join(f"a{i}={i}" for i in range(20_000)) + ")"
    back = "F[" + ";".join(f"a{i} = {i}" for i in reversed(range(20_000))) + "]"
    assert _pairs(spark, [(2, "e", long), (1, "e", back), (3, "e", "("), (4, "e", "")])[0] == {(1, 1), (2, 1), (3, 3), (4, 3)}
