"""Contracts, resumable sinks, fingerprints, round tags, splits and streaming bars."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from loomgrid.plans.audits import dedup_rounds
from loomgrid.plans.genes import frequent_structures
from loomgrid.sources.contract import append_missing, load_with_fingerprint, read_contracts, save_with_fingerprint, write_contracts
from loomgrid.sources.panel import Split
from loomgrid.streaming.bars import TICKS, bars, read_ticks, write_bars


def test_contracts_with_null_metrics_and_a_broken_file(spark, tmp_path):
    for run, text in {"r1": json.dumps({"schema_version": "1", "method": "gp", "market": "hsi", "seed": 3, "split": {"train": ["2017-01-01", "2021-11-30"]}, "factors": [{"type": "expression", "name": "a", "expression": "x", "train_metrics": {"ic": None, "icir": 0.5}}, {"type": "code", "name": "b", "source": "s"}]}, indent=1), "bad": "{not json"}.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "factors.json").write_text(text)
    good, bad = read_contracts(spark, str(tmp_path / "*" / "factors.json"))
    row = good.first()
    assert (row.run, row.method, row.seed, len(row.factors)) == ("r1", "gp", 3, 2) and row.factors[0].train_metrics == {"ic": None, "icir": 0.5} and row.factors[1].expression is None
    assert bad.count() == 1
    write_contracts(good.drop("file"), str(tmp_path / "out"))
    again, none = read_contracts(spark, str(tmp_path / "out" / "*" / "*.json"))
    assert again.first().factors == row.factors and none.count() == 0


def test_append_missing_and_retry(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, "k int, status string")
    assert append_missing(df([(1, "ok"), (2, "fail")]), path, ["k"]) == 2
    assert append_missing(df([(1, "ok"), (2, "ok"), (3, "ok")]), path, ["k"]) == 1
    assert append_missing(df([(1, "ok"), (2, "ok")]), path, ["k"], retry_failed=True) == 1
    assert spark.read.parquet(path).count() == 4


def test_fingerprint(spark, tmp_path):
    path = str(tmp_path / "cube")
    save_with_fingerprint(spark.range(3), path, "abc")
    assert load_with_fingerprint(spark, path, "abc").count() == 3 and load_with_fingerprint(spark, path, "xyz") is None


def test_rounds(spark):
    names = ["x_s0_r0_a", "x_s0_r2_a", "x_s0_r10_a", "x_s0_r1_b", "plain", "x_s0_rr_c"]
    df = spark.createDataFrame([("run", n) for n in names], "run string, name string")
    keep = lambda k: {r.name for r in dedup_rounds(df, "name", ["run"], k).collect()}
    assert keep("last") == {"x_s0_r10_a", "x_s0_r1_b", "plain", "x_s0_rr_c"} and keep("first") == {"x_s0_r0_a", "x_s0_r1_b", "plain", "x_s0_rr_c"}


def test_split_is_chronological():
    with pytest.raises(ValueError):
        Split(train=(date(2020, 1, 1), date(2022, 6, 1)))


def test_frequent_structures(spark):
    zoo = spark.createDataFrame([(t,) for t in ["Ma(Div(close,open),20)", "Ma(Div(close,open),5)", "Std(Div(close,open),9)", "Abs(Neg(close))", "broken("]], "e string")
    got = [(r.gene, r.size, r.support) for r in frequent_structures(zoo, "e", 3).collect()]
    assert got == [("Div(close,open)", 3, 0.6), ("Ma(Div(close,open),t)", 4, 0.4), ("Std(Div(close,open),t)", 4, 0.2)]


def test_stream_of_bars_equals_the_batch(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1 + i % 5, i % 24), i, "ab"[i % 2], float(i % 7), "{}") for i in range(200)] + [(999, datetime(2024, 2, 1), 1, "a", 1.0, "{}")]
    df = spark.createDataFrame(rows, TICKS)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        write_bars(bars(read_ticks(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    want = bars(df).where(F.col("date") < "2024-01-20")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == want.count() == 10 and got.exceptAll(want).count() == 0
