"""The N best items of every group, by bisecting all groups' cutoffs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.session import release, stage

#: Bits of a code that one pass settles: each counts above 2**BITS - 1 midpoints of every open group.
BITS = 8


def score_code(x: Column) -> Column:
    """An integer in the order of finite or infinite doubles: exponent and mantissa of the absolute value, with the sign."""
    size = F.abs(x)
    finite = F.least(size, F.lit(1.7976931348623157e308))
    guess = F.least(F.floor(F.log2(F.greatest(finite, F.lit(2.0**-1022)))), F.lit(1023)).cast("double")
    over = F.pow(F.lit(2.0), guess) > finite  # the logarithm may be rounded across a power of two
    under = (guess < 1023) & (F.pow(F.lit(2.0), F.least(guess + 1.0, F.lit(1023.0))) <= finite)
    exponent = F.greatest(guess - F.when(over, 1.0).when(under, -1.0).otherwise(0.0), F.lit(-1022.0))
    mantissa = finite / F.pow(F.lit(2.0), exponent)
    code = (exponent + 1022.0).cast("bigint") * F.lit(2**52) + (mantissa * F.lit(2.0**52)).cast("bigint")
    code = F.when(size == F.lit(float("inf")), F.lit(2**63 - 1)).otherwise(code)
    return F.when(x < 0, -code).otherwise(code)


def top_n(items: DataFrame, group: str, id: str, score: str, n: int, bits: int = BITS) -> DataFrame:
    """The ``n`` items of every group with the highest score, ties by the smaller id: ``group, id, score``.

    An item's code is its score as an order-preserving integer, followed by its id. All groups bisect their cutoff
    together: a pass counts, with partial aggregation, the items of each open group between 2**bits - 1
    evenly spaced midpoints (bits bisection steps in one pass); what lies above the interval with the cutoff is
    chosen, what lies below is done with, and only the interval itself stays open. A group is finished when its
    chosen items and a whole interval make exactly ``n``. Passes go over scores first and over ids where scores are equal,
    so there are at most 128 / bits of them, over rapidly falling numbers of rows.

    Distribution: counts are per (group, interval); intervals and cutoffs, one row per open group, rejoin the open items by
    group, where a hot group is a skewed side that adaptive execution splits. A pass writes the items that stay open and
    those it has chosen, once each. No group is sorted or gathered.

    Nulls: items with a null group, id or score, or a NaN score, never come out. An item that occurs several times counts
    once, with its highest score. A group with fewer items comes out whole. -0.0 equals 0.0. Empty in, empty out.
    """
    if not 1 <= bits <= 16 or n < 0:
        raise ValueError("bits must be 1 to 16 and n not negative")
    value = F.col(score).cast("double") + 0.0
    rows = items.where(F.col(group).isNotNull() & F.col(id).isNotNull() & value.isNotNull() & ~F.isnan(value))
    rows = rows.groupBy(F.col(group).alias("g"), F.col(id).cast("bigint").alias("i")).agg(F.max(value).alias("v"))
    open_rows = stage(rows.withColumn("c", score_code(F.col("v"))).withColumn("d", F.bitwise_not("i")), "items")
    need = open_rows.select("g").distinct().withColumn("need", F.lit(n).cast("bigint"))
    chosen: list[DataFrame] = []
    turn = 0
    while True:
        span = open_rows.groupBy("g").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("d").alias("d0"), F.max("d").alias("d1"), F.count(F.lit(1)).alias("held"))
        span = span.join(need, "g").withColumn("by_id", F.col("c0") == F.col("c1"))
        low, high = F.when(F.col("by_id"), F.col("d0")).otherwise(F.col("c0")), F.when(F.col("by_id"), F.col("d1")).otherwise(F.col("c1"))
        width = high.cast("double") - low.cast("double") + 1.0
        shift = F.greatest(F.ceil(F.log2(width)).cast("int") - bits, F.lit(0))
        span = span.withColumn("low", low).withColumn("shift", F.when(F.col("held") <= F.col("need"), F.lit(-1)).otherwise(shift))
        span = stage(span.select(F.col("g").alias("h"), "need", "by_id", "low", "shift"), "spans")
        slot = F.when(F.col("shift") < 0, F.lit(0)).otherwise(F.expr("shiftright(CASE WHEN by_id THEN d ELSE c END, shift) - shiftright(low, shift)"))
        placed = open_rows.join(span, F.col("g") == F.col("h")).select("g", "i", "v", "c", "d", "need", "shift", slot.alias("slot"))
        above = Window.partitionBy("g").orderBy(F.desc("slot"))
        cuts = placed.groupBy("g", "slot").agg(F.count(F.lit(1)).alias("k"), F.first("need").alias("need"), F.first("shift").alias("shift"))
        cuts = cuts.withColumn("top", F.sum("k").over(above)).withColumn("left", F.col("need") - F.col("top") + F.col("k"))
        cuts = cuts.where((F.col("left") > 0) & ((F.col("top") >= F.col("need")) | (F.col("shift") < 0)))
        cuts = cuts.select(F.col("g").alias("h"), F.col("slot").alias("cut"), "left", ((F.col("top") == F.col("need")) | (F.col("shift") < 0)).alias("whole"))
        cuts = stage(cuts, "cuts")
        settled = placed.join(cuts, F.col("g") == F.col("h")).withColumn("taken", (F.col("slot") > F.col("cut")) | ((F.col("slot") == F.col("cut")) & F.col("whole")))
        settled = stage(settled.where(F.col("slot") >= F.col("cut")).select("g", "i", "v", "c", "d", "taken"), "settled")
        chosen.append(settled.where("taken").select("g", "i", "v"))
        still = cuts.where(~F.col("whole"))
        last = still.isEmpty()
        release(open_rows, span) if turn == 0 else release(span)
        if last:
            release(cuts)
            break
        open_rows, turn = settled.where(~F.col("taken")).select("g", "i", "v", "c", "d"), turn + 1
        need = still.select(F.col("h").alias("g"), F.col("left").alias("need"))
    out = chosen[0]
    for part in chosen[1:]:
        out = out.unionByName(part)
    return out.select(F.col("g").alias(group), F.col("i").alias(id), F.col("v").alias(score))
