"""The market panel: current bars, dense grid, target, splits, universe and leakage-safe fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions.expr import FIELDS
from loomgrid.session import stage
from loomgrid.sources.tables import table

ENTITY = ("market", "asset")
# Fixed value: the markets.
MARKETS = ("sp100", "hsi", "csi300", "ftse100", "nikkei225")
#: Columns that look ahead; never handed to a factor.
FORWARD = ("forward_return_1d", "forward_return_5d", "forward_return_20d")


@dataclass(frozen=True)
class Split:
    """Three inclusive, chronological date ranges; the published ones are fixed values."""

    train: tuple[date, date] = (date(2017, 1, 1), date(2021, 11, 30))
    valid: tuple[date, date] = (date(2022, 1, 1), date(2023, 11, 29))
    test: tuple[date, date] = (date(2024, 1, 1), date(2025, 10, 31))

    def __post_init__(self) -> None:
        edges = [d for s in (self.train, self.valid, self.test) for d in s]
        if edges != sorted(edges) or len(set(edges)) != 6:
            raise ValueError("segments must follow each other")

    def segment(self, day: str = "date") -> F.Column:
        """The name of the segment that holds a day, NULL in the gaps."""
        out = F.lit(None).cast("string")
        for name in ("test", "valid", "train"):
            low, high = getattr(self, name)
            out = F.when(F.col(day).between(F.lit(low), F.lit(high)), F.lit(name)).otherwise(out)
        return out

    def window(self, day: str = "date") -> F.Column:
        return F.col(day).between(F.lit(self.train[0]), F.lit(self.test[1]))

    def sql(self, day: str = "date") -> str:
        return "CASE " + " ".join(f"WHEN {day} BETWEEN DATE '{getattr(self, n)[0]}' AND DATE '{getattr(self, n)[1]}' THEN '{n}'" for n in ("train", "valid", "test")) + " END"


DEFAULT_SPLIT = Split()


def current_bars(spark: SparkSession, folder: str, extra: Sequence[str] = ("tradable",)) -> DataFrame:
    """One row per (market, asset, date): the delivery with the latest loaded_at, ties by the smallest row_id. Forward columns stay out."""
    wanted = [*FIELDS, *extra]
    rows = table(spark, folder, "download_all").where(F.col("date").isNotNull() & F.col("asset").isNotNull())
    best = F.max(F.struct("loaded_at", F.bitwise_not("row_id").alias("i"), *wanted)).alias("b")
    return rows.groupBy(*ENTITY, "date").agg(best).select(*ENTITY, "date", *[F.col(f"b.{c}").alias(c) for c in wanted])


def dense_grid(bars: DataFrame, values: Sequence[str], entity: Sequence[str] = ENTITY, market: str = "market", day: str = "date") -> DataFrame:
    """Every trading day of a market times every asset of it; absent cells hold nulls and ``present`` is false.

    One row per market carries its calendar (bounded by its trading days), which is exploded per asset. Cells and bars
    meet in one exchange by entity, in which later asset windows stay.
    """
    calendar = bars.groupBy(market).agg(F.collect_set(day).alias("_days"))
    cells = bars.select(*entity).distinct().join(calendar, market).select(*entity, F.explode("_days").alias(day))
    empty = [F.lit(None).cast(bars.schema[v].dataType).alias(v) for v in values]
    both = cells.select(*entity, day, *empty, F.lit(False).alias("present")).unionByName(bars.select(*entity, day, *values, F.lit(True).alias("present")))
    return both.repartition(*entity).groupBy(*entity, day).agg(*[F.max(v).alias(v) for v in values], F.max("present").alias("present"))


def market_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The grid with fields, returns and the 20-day target; everything that the evaluation queries start from.

    Deliveries are read once; the current bars are written, as calendar, cells and bars are all taken from them.
    """
    line = Window.partitionBy(*ENTITY).orderBy("date")
    grid = dense_grid(stage(current_bars(spark, folder), "bars"), [*FIELDS, "tradable"])
    grid = grid.withColumn("returns", F.try_divide(F.col("close"), F.lag("close").over(line)) - 1)
    return grid.withColumn("target", F.try_divide(F.lead("close", 20).over(line), F.col("close")) - 1)


#: The same grid as SQL.
GRID_SQL = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, asset, date ORDER BY loaded_at DESC, row_id) AS rn FROM download_all WHERE date IS NOT NULL AND asset IS NOT NULL) WHERE rn = 1),
cells AS (SELECT a.market, a.asset, d.date FROM (SELECT DISTINCT market, asset FROM cur) a JOIN (SELECT DISTINCT market, date FROM cur) d ON a.market = d.market),
raw AS (SELECT c.market, c.asset, c.date, open, high, low, close, volume, vwap, tradable, cur.date IS NOT NULL AS present FROM cells c LEFT JOIN cur ON c.market = cur.market AND c.asset = cur.asset AND c.date = cur.date),
grid AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS returns, lead(close, 20) OVER w / nullif(close, 0) - 1 AS target FROM raw WINDOW w AS (PARTITION BY market, asset ORDER BY date))"""


# --- stored panels ---------------------------------------------------------------

UNIVERSES = ("static", "pit", "pit-mining")
COLUMNS = (*FIELDS, "return_1d", *FORWARD, "adv", "market_cap", "tradable")


class PanelError(ValueError):
    """A stored panel that is not what was asked for."""


def write_panel(panel: DataFrame, path: str, universe: str = "static") -> None:
    """A panel as parquet under ``universe=/market=``, so that reads of one market touch its files only."""
    if universe not in UNIVERSES:
        raise PanelError(f"unknown universe {universe}")
    panel.withColumn("universe", F.lit(universe)).repartition("market").sortWithinPartitions("asset", "date").write.mode("overwrite").partitionBy("universe", "market").parquet(path)


def load_panel(spark: SparkSession, path: str, market: str, universe: str | None = None, split: Split = DEFAULT_SPLIT, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """One market of a stored panel, checked: known market, present, columns complete, and of the wanted universe.

    For ``pit-mining`` no row from the start of training on may be outside the universe.
    """
    if market not in MARKETS:
        raise PanelError(f"unknown market {market}")
    rows = spark.read.parquet(path).where(F.col("market") == market)
    missing = [c for c in ("date", "asset", *columns) if c not in rows.columns]
    if missing:
        raise PanelError(f"columns missing: {missing}")
    found = rows.select("universe").first()
    if found is None:
        raise PanelError(f"no rows of {market}")
    if universe is not None:
        if rows.where(F.col("universe") != universe).limit(1).count():
            raise PanelError(f"not of universe {universe}")
        outside = (F.col("date") >= F.lit(split.train[0])) & ~F.coalesce("tradable", F.lit(False))
        if universe == "pit-mining" and rows.where(outside).limit(1).count():
            raise PanelError("rows outside the universe")
    return rows.select("market", "asset", "date", *columns)


def backfill(new: DataFrame, old: DataFrame, failed: DataFrame, key: str = "asset") -> DataFrame:
    """New rows, and of the assets that failed the rows of an older panel; an asset with new rows keeps those alone."""
    rescued = old.join(failed.select(key).distinct(), key, "left_semi").join(new.select(key).distinct(), key, "left_anti")
    return new.unionByName(rescued.select(*new.columns))


def exported(panel: DataFrame, prefix: str = "$") -> DataFrame:
    """The columns a factor may read, renamed with a prefix; forward columns never leave."""
    return panel.select("market", "asset", "date", *[F.col(c).alias(f"{prefix}{c}") for c in FIELDS])


def restrict_to_universe(signal: DataFrame, panel: DataFrame, value: str = "value") -> DataFrame:
    """A signal aligned to the panel's rows, NULL outside the universe; a missing flag is outside."""
    keys = [*ENTITY, "date"]
    rows = panel.select(*keys, F.coalesce("tradable", F.lit(False)).alias("_member")).join(signal.select(*keys, value), keys, "left")
    return rows.select(*keys, F.when(F.col("_member"), F.col(value)).alias(value))


def float32_range(x: F.Column) -> F.Column:
    """NULL for values that single precision cannot hold."""
    return F.when(F.abs(x) <= 3.4028234663852886e38, x)
