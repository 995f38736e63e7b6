"""Top N by bisection against a sort."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from loomgrid.llm.topn import score_code, top_n

SCHEMA = "g string, i bigint, v double, c string, d string, need int"


def _top(spark, rows, n, **kw):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    return {(r.g, r.i) for r in top_n(df, "g", "i", "v", n, **kw).collect()}


def _brute(rows, n):
    best = {}
    for g, i, v in rows:
        if None not in (g, i, v) and v == v:
            best[g, i] = max(v, best.get((g, i), v))
    out = set()
    for g in {k[0] for k in best}:
        out |= {(g, i) for _, i in sorted((-v, i) for (h, i), v in best.items() if h == g)[:n]}
    return out


@pytest.mark.parametrize("n,bits", [(10, 8), (1, 1), (3, 3), (0, 8), (10_000, 8)])
def test_against_sort(spark, n, bits):
    rng = random.Random(n)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(30)}", rng.randrange(-50, 600), rng.choice([rng.gauss(0, 1), round(rng.gauss(0, 1), 1), 0.0, -0.0, 5e-324, -1e308, float("inf"), float("-inf"), None, float("nan")])) for _ in range(800)]
    rows += [("ties", i, 0.25) for i in range(300)] + [("ids", 2**62 + i, 1.0) for i in range(40)] + [("ids", -(2**63), 1.0), (None, 1, 1.0), ("one", 1, 2.0)]
    rows += rows[:100]
    assert _top(spark, rows, n, bits=bits) == _brute(rows, n)


def test_empty(spark):
    assert _top(spark, [], 3) == set()


def test_code_keeps_the_order_of_doubles(spark):
    rng = random.Random(2)
    xs = [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    xs = sorted({x for x in xs if x == x} | {0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 1.0, 0.9999999999999999, 1.0000000000000002, 2.0, 1.9999999999999998})
    codes = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(score_code(F.col("x"))).collect()]
    assert codes == sorted(codes) and len(set(codes)) == len(codes)
