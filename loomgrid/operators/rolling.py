"""Totals and averages over trailing calendar periods by block decomposition."""

from __future__ import annotations

from collections.abc import Sequence
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "1970-01-01"


def trailing_totals(
    bars: DataFrame,
    keys: Sequence[str],
    day: str,
    values: Sequence[str],
    latest: Sequence[Column],
    periods: Sequence[int] = (7, 30),
    digits: int = 4,
) -> DataFrame:
    """For every entity and calendar day from its first to its last bar: totals, counts and averages over trailing days.

    ``latest`` orders the deliveries of one bar; the greatest is the current bar. For each period W the
    calendar is cut into blocks of W days; prefix sums and suffix sums are built inside the blocks, and a
    trailing total is the suffix of the block before plus the prefix of its own block (the prefix alone on a
    block's last day). No row is added more than twice a period, and nothing is subtracted.

    Distribution: rows go to (entity, chunk), a chunk being a common multiple of the periods; the last
    max(W) - 1 days of a chunk are sent to the next one as well. So one exchange serves all periods, and a
    group holds at most one chunk of days however long or hot the entity is.

    Columns out: keys, day, and per value v and period W ``v_sum_W`` (0 when nothing was observed, rounded to
    ``digits`` so that it does not depend on the order of addition), ``v_n_W`` (observed values) and
    ``v_avg_W`` (total / observed values, NULL when none).

    Nulls: a null or NaN value is not observed; a null key is an entity of its own; rows with a null day are
    no bars. Repeated deliveries count once. An empty table gives an empty result. Other columns are ignored.
    """
    keys, values, periods = list(keys), list(values), sorted(periods)
    halo = periods[-1] - 1
    chunk = lcm(*periods)
    while chunk < 6 * halo:
        chunk *= 2
    ks = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    kn = [f"_k{i}" for i in range(len(keys))]
    clean = [F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double")).alias(f"_v{i}") for i, v in enumerate(values)]
    rows = bars.where(F.col(day).isNotNull()).select(
        *ks,
        F.datediff(F.to_date(F.col(day)), F.lit(EPOCH).cast("date")).alias("_n"),
        F.struct(*[c.alias(f"o{i}") for i, c in enumerate(latest)], *clean).alias("_bar"),
    )
    home = F.floor(F.col("_n") / chunk).cast("int")
    delivered = rows.withColumn("_c", F.explode(F.when(F.pmod("_n", F.lit(chunk)) >= chunk - halo, F.array(home, home + 1)).otherwise(F.array(home)))).select(
        *kn, "_c", F.col("_n").alias("_from"), F.col("_n").alias("_to"), F.lit(None).cast("int").alias("_first"), "_bar"
    )
    spans = (
        rows.groupBy(*kn)
        .agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
        .withColumn("_c", F.explode(F.sequence(F.floor(F.col("_lo") / chunk).cast("int"), F.floor(F.col("_hi") / chunk).cast("int"))))
        .select(
            *kn,
            "_c",
            (F.greatest("_lo", F.col("_c") * chunk) - halo).alias("_from"),
            F.least("_hi", F.col("_c") * chunk + chunk - 1).alias("_to"),
            F.greatest("_lo", F.col("_c") * chunk).alias("_first"),
            F.lit(None).cast(delivered.schema["_bar"].dataType).alias("_bar"),
        )
    )
    days = (
        delivered.unionByName(spans)
        .repartition(*kn, "_c")
        .withColumn("_n", F.explode(F.sequence("_from", "_to")))
        .groupBy(*kn, "_c", "_n")
        .agg(F.max("_bar").alias("_bar"), F.max(F.col("_n") >= F.col("_first")).alias("_out"), F.max(F.col("_first").isNotNull()).alias("_day"))
        .where("_day")
    )
    cols = []
    for i in range(len(values)):
        v = F.col(f"_bar._v{i}")
        cols += [F.coalesce(v, F.lit(0.0)).alias(f"_s{i}"), F.when(v.isNotNull(), 1).otherwise(0).alias(f"_m{i}")]
    days = days.select(*kn, "_c", "_n", "_out", *cols)
    parts = [x for i in range(len(values)) for x in (f"_s{i}", f"_m{i}")]
    for w in periods:
        days = days.withColumn(f"_b{w}", F.floor(F.col("_n") / w))
        block = Window.partitionBy(*kn, "_c", f"_b{w}").rowsBetween(Window.unboundedPreceding, 0)
        days = days.withColumns({f"{x}p{w}": F.sum(x).over(block.orderBy("_n")) for x in parts})
        days = days.withColumns({f"{x}q{w}": F.sum(x).over(block.orderBy(F.desc("_n"))) for x in parts})
    line = Window.partitionBy(*kn, "_c").orderBy("_n")
    for w in periods:
        days = days.withColumns(
            {
                f"{x}t{w}": F.when(F.pmod("_n", F.lit(w)) == w - 1, F.col(f"{x}p{w}")).otherwise(
                    F.col(f"{x}p{w}") + F.coalesce(F.lag(f"{x}q{w}", w - 1).over(line), F.lit(0))
                )
                for x in parts
            }
        )
    out = [F.col(n).alias(k) for n, k in zip(kn, keys)]
    out.append(F.date_add(F.lit(EPOCH).cast("date"), F.col("_n")).alias(day))
    for i, v in enumerate(values):
        for w in periods:
            total, seen = F.round(F.col(f"_s{i}t{w}"), digits), F.col(f"_m{i}t{w}")
            out += [total.alias(f"{v}_sum_{w}"), seen.cast("bigint").alias(f"{v}_n_{w}"), F.when(seen > 0, total / seen).alias(f"{v}_avg_{w}")]
    return days.where(F.col("_out")).select(*out)
