"""Frequent structures of the repository's own expressions."""

import pytest

from loomgrid.functions.expr import ExpressionError, read_expression
from loomgrid.plans.genes import QUERIES

SPELLINGS = ["TsMean(Sub($close,open),20d)", "ts_mean[x=sub[y=$open, x=$close]; d=20d]", "TSMEAN{D:20D,X:SUB(X:$CLOSE,Y:$OPEN)};", " tsmean sub @close open 20d", "(TsMean(Sub($close;\topen), 20)"]


@pytest.mark.parametrize("text", SPELLINGS)
def test_spellings_of_one_tree(text):
    assert str(read_expression(text)) == "TsMean(Sub(close,open),20)"
    assert read_expression(str(read_expression(text))) == read_expression(text)


@pytest.mark.parametrize("text", ["", "20d", "Foo(close)", "Sub(close)", "Sub(x=close, x=open)", "Ref(close, open)", "close open", "Neg(d=3d)", "Sub(close,open)!"])
def test_unreadable(text):
    with pytest.raises(ExpressionError):
        read_expression(text)


def test_query_reads_the_folder(spark, tmp_path):
    texts = [*SPELLINGS, "Neg(Sub($close, $open))", "Neg(Sub($high, $low))", "nonsense", None]
    rows = [([("expression", t) for t in texts] + [("code", "Neg(close)")],)]
    spark.createDataFrame(rows, "factors array<struct<type: string, expression: string>>").write.parquet(str(tmp_path / "mining_run.parquet"))
    got = {r.gene: (r.support, r.unreadable) for r in QUERIES["frequent_structures"](spark, str(tmp_path)).collect()}
    assert got["Sub(close,open)"] == (0.5, 1) and got["TsMean(Sub(close,open),t)"] == (0.25, 1) and "Sub(high,low)" not in got
