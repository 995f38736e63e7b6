"""The driver's contract, with and without the llm subpackage, and queries beside their SQL."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_names_and_sql_belong_together():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(f"p{n}_found" in e.queries() for n in (3, 6, 7)) and "p2_rolling" in e.queries()


def test_the_rest_works_without_llm(tmp_path):
    shutil.copytree(f"{ROOT}/loomgrid", tmp_path / "loomgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'p1_found' in q, 'p3_found' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    n, one, three = out.stdout.split()
    assert int(n) > 50 and one == "False" and three == "True"


def test_a_library_that_only_llm_needs_may_be_absent(tmp_path):
    (tmp_path / "xxhash.py").write_text("raise ImportError('absent')\n")
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'p9_found' in q, 'p3_found' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, "PYTHONPATH": f"{tmp_path}:{ROOT}"}, capture_output=True, text=True, check=True)
    n, nine, three = out.stdout.split()
    assert int(n) > 50 and nine == "False" and three == "True"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def _plain(x):
    if x is None or str(x) in ("nan", "NaT", "<NA>"):
        return ""
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"{float(x):.9g}"
    return str(x).removesuffix(" 00:00:00").removesuffix("+00:00")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["p2_rolling", "p3_found", "p3_attributes", "p3_as_of", "p6_found", "p7_found", "p7_versions", "daily_ic", "ts_arrays", "alphas_001_006", "audit_rollup", "membership", "backtest_long_only"])
def test_query_equals_its_sql(spark, duck, name):
    import __spark_entry__ as e

    got, want = e.queries()[name](spark, DATA).toPandas(), duck.execute(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(_plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)
