"""Running totals in a global order, without gathering the order in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.session import stage


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[Column], weight: str | None, before: str, total: str | None = None) -> DataFrame:
    """Adds ``before``: the weight (1 where None) of the rows that precede a row within ``by``; and ``total`` of ``by``.

    Rows are range-partitioned and sorted by (by, order) once and written; running sums inside a partition are
    then joined with the sums of the partitions before, of which there is one row per partition and group
    present in it. ``order`` should be total, since ties get an arbitrary order. A group of any size is
    spread over as many partitions as its share of the rows. Null groups are groups.
    """
    by = list(by)
    part, place = "_part", "_place"
    laid = df.repartitionByRange(*[F.col(b).asc() for b in by], *order).sortWithinPartitions(*by, *order)
    laid = laid.withColumn("_at", F.monotonically_increasing_id())
    laid = stage(laid.withColumn(part, F.shiftright("_at", 33)).withColumn(place, F.col("_at")).drop("_at"), "order")
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    kn = [f"_b{i}" for i in range(len(by))]
    here = laid.withColumn("_w", w).withColumns({n: F.col(b) for n, b in zip(kn, by)})
    inside = Window.partitionBy(part, *kn).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    here = here.withColumn("_run", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    sums = here.groupBy(part, *kn).agg(F.sum("_w").alias("_sum"))
    line = Window.partitionBy(*kn) if kn else Window.partitionBy(F.lit(0))
    sums = sums.withColumn("_off", F.coalesce(F.sum("_sum").over(line.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_sum").over(line))
    sums = sums.select(F.col(part).alias("_jp"), *[F.col(n).alias(f"_j{n}") for n in kn], "_off", "_all")
    on = [F.col(part) == F.col("_jp"), *[F.col(n).eqNullSafe(F.col(f"_j{n}")) for n in kn]]
    joined = here.join(sums, on)
    out = [F.col(c) for c in df.columns] + [(F.col("_off") + F.col("_run")).alias(before)]
    return joined.select(*out, *([F.col("_all").alias(total)] if total else []))


def quantiles(df: DataFrame, by: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact interpolated quantiles per group, ``by`` and one column per entry of ``wanted`` (name: column, share).

    Values are counted with partial aggregation, laid out in one global order and summed up, so a group with a large part of
    all rows, or of all distinct values, is spread over many tasks. Nulls and NaN are left out; a group or
    column without values gives NULL; null groups are groups.
    """
    by, columns = list(by), list(dict.fromkeys(c for c, _ in wanted.values()))
    kn = [f"_g{i}" for i in range(len(by))]
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias("v")) for i, c in enumerate(columns)])
    long = df.select(*[F.col(b).alias(n) for b, n in zip(by, kn)], F.explode(cells).alias("_x")).select(*kn, F.col("_x.c").alias("_c"), F.col("_x.v").alias("_v"))
    counts = long.groupBy(*kn, "_c", "_v").agg(F.count(F.lit(1)).alias("_k"))
    seen = running_total(counts.withColumn("_k", F.when(F.col("_v").isNotNull(), F.col("_k")).otherwise(0)), [*kn, "_c"], [F.col("_v")], "_k", "_before", "_n")
    picks = []
    for name, (c, share) in wanted.items():
        place = (F.col("_n") - 1) * F.lit(share)
        for end, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            held = (F.col("_c") == columns.index(c)) & (F.col("_before") <= at) & (at < F.col("_before") + F.col("_k"))
            picks.append(F.max(F.when(held, F.col("_v"))).alias(f"{end}_{name}"))
        picks.append(F.max(F.when(F.col("_c") == columns.index(c), place - F.floor(place))).alias(f"at_{name}"))
    found = seen.groupBy(*kn).agg(*picks)
    return found.select(*[F.col(n).alias(b) for n, b in zip(kn, by)], *[(F.col(f"lo_{n}") + (F.col(f"hi_{n}") - F.col(f"lo_{n}")) * F.col(f"at_{n}")).alias(n) for n in wanted])


def with_groups(df: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` with the columns of ``groups``, which has one row per ``by``; null groups meet."""
    return df.join(groups.withColumnsRenamed({b: f"_on_{b}" for b in by}), [F.col(b).eqNullSafe(F.col(f"_on_{b}")) for b in by], how).drop(*[f"_on_{b}" for b in by])
