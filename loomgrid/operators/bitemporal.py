"""Attributes as known at event time: rectangles of valid and recorded time on a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.session import stage

#: Width of a cell of the grid over recorded time.
CELL_SECONDS = 16 * 86_400
#: Blocks of valid time have 1, 2, 4, ... days; days are told apart from this one on, for 2**LEVELS days.
FIRST_DAY, LEVELS = "1900-01-01", 17


def _day(c: str) -> Column:
    return F.least(F.greatest(F.datediff(F.to_date(F.col(c)), F.lit(FIRST_DAY).cast("date")), F.lit(-1)), F.lit(2**LEVELS - 2))


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _openings(versions: DataFrame, keys: Sequence[str], valid_from: str, recorded: str, tie: str, attributes: Sequence[str], cell: int, split: bool) -> DataFrame:
    """Versions that are greater than all before in their (entity, block of valid time, cell of recorded time)."""
    kn = [f"_k{i}" for i in range(len(keys))]
    rows = versions.where(F.col(valid_from).isNotNull() & F.col(recorded).isNotNull() & F.col(tie).isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    fields = [F.col(a).alias(f"a{i}") for i, a in enumerate(attributes)]
    rows = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, kn)], _day(valid_from).alias("_d"), _micros(recorded).alias("_t"), F.struct(F.col(valid_from).alias("v"), _micros(recorded).alias("r"), F.bitwise_not(F.col(tie)).alias("i"), *fields).alias("_version"))
    if split:
        rows = rows.withColumn("_block", F.explode(F.expr(f"transform(sequence(0, {LEVELS - 1}), l -> l * 4294967296L + shiftright(greatest(_d, 0), l))")))
    else:
        rows = rows.withColumn("_block", F.lit(0).cast("bigint"))
    rows = rows.withColumn("_cell", F.floor(F.col("_t") / cell)).groupBy(*kn, "_block", "_cell", "_t").agg(F.max("_version").alias("_version"))
    before = Window.partitionBy(*kn, "_block", "_cell").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_past", F.max("_version").over(before))
    return stage(rows.where(F.col("_past").isNull() | (F.col("_version") > F.col("_past"))).drop("_past"), "openings")


def _regions(openings: DataFrame, kn: Sequence[str], cell: int, until: int) -> DataFrame:
    """The current-version rectangles, cut at the lines of the grid: each has its version from ``_t`` to before ``_to``.

    A cell begins with the version that is current when the cells before end; in it, each greater version opens a rectangle and
    closes the one before. Cells without openings hold the arriving version alone, up to the cell of ``until``.
    """
    line = Window.partitionBy(*kn, "_block").orderBy("_cell")
    cells = openings.groupBy(*kn, "_block", "_cell").agg(F.max("_version").alias("_top"))
    cells = cells.withColumn("_top", F.max("_top").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead("_cell").over(line))
    stop = F.least(F.coalesce("_next", F.lit(until // cell)), F.lit(until // cell))
    arriving = cells.where(F.col("_cell") < stop).withColumn("_cell", F.explode(F.sequence(F.col("_cell") + 1, stop))).select(*kn, "_block", "_cell", (F.col("_cell") * cell).alias("_t"), F.col("_top").alias("_version"), F.lit(0).alias("_new"))
    inside = Window.partitionBy(*kn, "_block", "_cell").orderBy("_t", "_new")
    both = arriving.unionByName(openings.withColumn("_new", F.lit(1))).withColumn("_past", F.max("_version").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    opened = both.where(F.col("_past").isNull() | (F.col("_version") > F.col("_past"))).drop("_past")
    opened = opened.withColumn("_to", F.coalesce(F.lead("_t").over(inside), (F.col("_cell") + 1) * cell))
    return opened.where(F.col("_t") < F.col("_to")).select(*kn, "_block", "_cell", "_t", "_to", "_version")


def as_known(
    events: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    event_time: str,
    valid_from: str,
    recorded: str,
    tie: str,
    attributes: Sequence[str],
    cell_seconds: int = CELL_SECONDS,
    valid_at: str | None = None,
) -> DataFrame:
    """Every event with the attributes of its entity that were current when it happened.

    The current version at a point of valid and recorded time is, among the versions recorded by then and valid from then
    or earlier, the one with the latest ``valid_from``, then the latest ``recorded``, then the smallest ``tie`` (an
    integer). An event stands at recorded time ``event_time``, and at the day ``valid_at`` of valid time; without
    ``valid_at`` it stands at the open edge, beyond all valid_from.

    Valid time is split into one block at the open edge, or else into blocks of 1, 2, 4, ... days, and recorded time into
    cells. In a block, as seen from beyond its end, the versions in it make disjoint current-version rectangles: each
    reaches from the instant at which it becomes the greatest recorded to the instant of the next greater one. Rectangles
    are cut at the lines of the grid and indexed by (entity, block, cell); an event point is located in the one rectangle of
    its cell that holds it. The blocks that tie together all days up to ``valid_at`` give a version each, and the greatest is current.

    Distribution: versions are reduced to one per instant with partial aggregation, and to the openings of their cell,
    which are written; rectangles and events then meet in (entity, block, cell), sorted by time, so an entity with a third of
    all rows spreads over its cells. One row per cell carries the current version on. No pairs are formed. The last event
    time is read first, one column, since the last rectangles stay open until then. With ``valid_at`` each version stands in
    17 blocks and each event asks about 8 of them on average.

    Returns the columns of ``events`` followed by ``attributes`` (named ``<name>_known`` where an event column
    has that name). Events without a version, with a null key, time or ``valid_at`` are absent. Versions with a
    null key, valid_from, recorded or tie are never current. Repeated events stay repeated; attributes may be
    null. Attributes must be of orderable types (no maps). Events or versions may be empty. With ``valid_at``, days before
    1900 and after 2258 are not told apart.
    """
    keys, attributes = list(keys), list(attributes)
    kn = [f"_k{i}" for i in range(len(keys))]
    cell = cell_seconds * 1_000_000
    named = [c if c not in events.columns else f"{c}_known" for c in attributes]
    asked = events.where(F.col(event_time).isNotNull())
    for k in keys:
        asked = asked.where(F.col(k).isNotNull())
    until = asked.agg(F.max(_micros(event_time)).alias("t")).first().t or 0
    asked = asked.select(*[F.col(k).alias(n) for k, n in zip(keys, kn)], _micros(event_time).alias("_t"), (_day(valid_at) if valid_at else F.lit(0)).alias("_d"), F.struct(*[F.col(c) for c in events.columns]).alias("_event"))
    if valid_at:
        tiles = f"transform(filter(sequence(0, {LEVELS - 1}), l -> shiftright(_d + 1, l) % 2 = 1), l -> l * 4294967296L + shiftright(_d + 1, l) - 1)"
        asked = asked.withColumn("_e", F.monotonically_increasing_id()).withColumn("_block", F.explode(F.expr(tiles)))
    else:
        asked = asked.withColumn("_e", F.lit(0).cast("bigint")).withColumn("_block", F.lit(0).cast("bigint"))
    asked = asked.withColumn("_cell", F.floor(F.col("_t") / cell)).drop("_d")
    regions = _regions(_openings(versions, keys, valid_from, recorded, tie, attributes, cell, valid_at is not None), kn, cell, until)
    regions = regions.select(*kn, "_block", "_cell", "_t", F.struct("_to", "_version").alias("_region"))
    both = regions.withColumns({"_event": F.lit(None).cast(asked.schema["_event"].dataType), "_e": F.lit(None).cast("bigint")}).unionByName(asked.withColumn("_region", F.lit(None).cast(regions.schema["_region"].dataType)))
    line = Window.partitionBy(*kn, "_block", "_cell").orderBy("_t", F.col("_e").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    located = both.withColumn("_region", F.last("_region", ignorenulls=True).over(line)).where(F.col("_e").isNotNull() & (F.col("_t") < F.col("_region._to")))
    found = located.select("_e", "_event", F.col("_region._version").alias("_version"))
    if valid_at:
        found = found.groupBy("_e").agg(F.first("_event").alias("_event"), F.max("_version").alias("_version"))
    return found.select("_event.*", *[F.col(f"_version.a{i}").alias(n) for i, n in enumerate(named)])


def rectangles(versions: DataFrame, keys: Sequence[str], valid_from: str, recorded: str, tie: str, until: Column, cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """The disjoint rectangles at the open edge themselves, cut at the lines of the grid, up to the cell of the time ``until``.

    Columns: keys, valid_from, tie, recorded_from, recorded_to. From an entity's first opening on they tile recorded time.
    """
    kn, cell = [f"_k{i}" for i in range(len(keys))], cell_seconds * 1_000_000
    stop = versions.sparkSession.range(1).select(F.unix_micros(until.cast("timestamp")).alias("t")).first().t
    regions = _regions(_openings(versions, keys, valid_from, recorded, tie, [], cell, False), kn, cell, stop)
    return regions.select(
        *[F.col(n).alias(k) for k, n in zip(keys, kn)],
        F.col("_version.v").alias("valid_from"),
        F.bitwise_not(F.col("_version.i")).alias("tie"),
        F.timestamp_micros("_t").alias("recorded_from"),
        F.timestamp_micros("_to").alias("recorded_to"),
    )
