"""Running totals in a global order, and the folder in which lineage is cut."""

import random

from pyspark.sql import functions as F

import pytest

from loomgrid import session
from loomgrid.operators.ordering import running_total
from loomgrid.session import shared_dir, stage


def test_running_totals_of_skewed_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), i, rng.choice([None, 1, 2, 3])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, i int, w bigint").withColumn("w", F.coalesce("w", F.lit(0))).repartition(5)
    got = {r.i: (r.before, r.total) for r in running_total(df, ["g"], [F.col("i").desc()], "w", "before", "total").collect()}
    for g in ("hot", "x", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])
        total = sum(r[2] or 0 for r in own)
        for k, r in enumerate(own):
            assert got[r[1]] == (sum(s[2] or 0 for s in own[:k]), total)


def test_positions_without_groups_and_empty(spark):
    df = spark.range(500).repartition(7)
    assert sorted((r.id, r.before) for r in running_total(df, [], [F.col("id")], None, "before").collect()) == [(i, i) for i in range(500)]
    assert running_total(df.limit(0), [], [F.col("id")], None, "before").count() == 0


def test_stage_writes_into_the_sessions_folder(spark, tmp_path, monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return f"file://{tmp_path}/" if name == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert shared_dir(Session()) == f"file://{tmp_path}"
    assert shared_dir(spark) == shared_dir(spark)  # unset there: one folder of our own
    monkeypatch.setattr(session, "shared_dir", lambda s: f"file://{tmp_path}")
    assert stage(spark.range(9), "t").count() == 9
    assert any(p.name.startswith("loomgrid-t-") for p in tmp_path.iterdir())


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_released_tables_are_gone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda s: f"file://{tmp_path}")
    kept, gone = stage(spark.range(9), "a"), stage(spark.range(5), "b")
    session.release(gone)
    assert kept.count() == 9 and [p.name.startswith("loomgrid-a") for p in tmp_path.iterdir() if not p.name.startswith(".")] == [True]
