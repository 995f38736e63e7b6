"""Impossible, frozen and spiking readings, measured against each source's ordinary behaviour."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.session import stage

#: Points of the distribution read from a source's sketch; every half percent.
_GRID = [i / 200 for i in range(201)]


@dataclass(frozen=True)
class Rules:
    """Thresholds. Fences and rates are in natural logarithms of the reading.

    rate: multiple of the median absolute change between readings, for ``rated`` series.
    fence: multiple of the median absolute deviation from the median, for ``fenced`` series.
    frozen: readings without variance in a row. back: how near the level after an excursion is to the one
    before it, as a share of the excursion.
    """

    rated: Sequence[str] = ("close", "high", "low")
    fenced: Sequence[str] = ("volume",)
    still: Sequence[str] = ("close", "volume")
    rate: float = 15.0
    fence: float = 10.0
    frozen: int = 8
    back: float = 0.5
    accuracy: int = 10_000
    context: Sequence[str] = field(default_factory=tuple)

    @property
    def series(self) -> list[str]:
        return list(dict.fromkeys([*self.rated, *self.fenced, *self.still]))


def _log(c: Column) -> Column:
    return F.when((c > 0) & ~F.isnan(c) & (c < F.lit(float("inf"))), F.ln(c))


def _middle(a: Column, b: Column, c: Column) -> Column:
    """The median of three; NULL where one is absent."""
    return F.when(c.isNotNull(), F.greatest(F.least(a, b), F.least(F.greatest(a, b), c)))


def _excursion(v: Column, p: Column, n: Column, far: Column, back: float) -> Column:
    """v departs from p and n to the same side by more than ``far``, while p and n agree."""
    a, b = v - p, v - n
    return (F.abs(a) > far) & (F.abs(b) > far) & (F.signum(a) == F.signum(b)) & (F.abs(p - n) < back * F.least(F.abs(a), F.abs(b)))


def _levels(s: str) -> dict[str, Column]:
    """The level of the readings before and of those after, where there are three: their medians."""
    p1, p2, p3, n1, n2, n3 = (F.col(f"_{a}{i}_{s}") for a in "pn" for i in (1, 2, 3))
    return {f"_before_{s}": _middle(p1, p2, p3), f"_after_{s}": _middle(n1, n2, n3)}


def _level(s: str, three: str, side: str) -> Column:
    """The level on one side; of two neighbours the one farther from the reading, as the nearer may be part of its spike."""
    x, a, b = F.col(f"_x_{s}"), F.col(f"_{side}1_{s}"), F.col(f"_{side}2_{s}")
    return F.coalesce(F.col(f"_{three}_{s}"), F.when(F.abs(x - b) > F.abs(x - a), b).otherwise(a))


def _off_level(s: str) -> Column:
    """A cheap test that every spike passes: off both levels, to the same side."""
    a, b, far = F.col(f"_x_{s}") - _level(s, "before", "p"), F.col(f"_x_{s}") - _level(s, "after", "n"), F.col(f"_far_{s}")
    return F.coalesce((F.abs(a) > far) & (F.abs(b) > far) & (F.signum(a) == F.signum(b)), F.lit(False))


def _sides(s: str, back: float) -> dict[str, Column]:
    """Whether the next or the preceding reading departs too, and to which side."""
    p1, p2, n1, n2, far = (F.col(f"_{a}_{s}") for a in ("p1", "p2", "n1", "n2", "far"))
    up = F.coalesce(F.when(_excursion(n1, p1, n2, far, back), F.signum(n1 - p1)), F.lit(0.0))
    down = F.coalesce(F.when(_excursion(p1, p2, n1, far, back), F.signum(p1 - n1)), F.lit(0.0))
    return {f"_opens_{s}": up, f"_closes_{s}": down}


def _departs(s: str, back: float) -> Column:
    """A reading, alone or with one neighbour, departs from the readings on both sides and from their levels, and these agree."""
    x, far = F.col(f"_x_{s}"), F.col(f"_far_{s}")
    p1, p2, n1, n2 = (F.col(f"_{a}{i}_{s}") for a in "pn" for i in (1, 2))
    opens = (F.col(f"_opens_{s}") == F.signum(x - p1)) & _excursion(x, p1, n2, far, back)
    closes = (F.col(f"_closes_{s}") == F.signum(x - n1)) & _excursion(x, p2, n1, far, back)
    return _off_level(s) & (_excursion(x, p1, n1, far, back) | opens | closes)


def implausible(
    readings: DataFrame,
    keys: Sequence[str],
    day: str,
    row_id: str,
    latest: Sequence[Column],
    impossible: Column,
    rules: Rules | None = None,
) -> DataFrame:
    """Every delivered reading that is impossible, frozen or a spike: ``row_id, impossible, frozen, spike``.

    Normal behaviour of a source: a quantile sketch per source (and ``context``, such as the hour of day)
    of its log readings and of its absolute log changes, built per partition and merged; the fences are the
    median plus or minus a multiple of the spread read from the sketch, the rate limit is a multiple of the
    median absolute change. Zero variance is a run of ``rules.frozen`` or more equal current readings. A
    spike leaves the fence or breaks the rate limit for one or two readings and comes back.

    The sequence of a source consists of its current readings, the greatest by ``latest`` of each day; a
    delivery that was replaced is judged by its own values at its place in that sequence.

    Distribution: deliveries are reduced to current readings with partial aggregation, after which a source
    has one row per calendar day, however many rows were delivered; sequences are windows over those. Sketches
    merge by partial aggregation. Replaced deliveries rejoin by (source, day) only the days with a case or with
    differing deliveries.

    Nulls: a null, NaN or non-positive reading has no logarithm; it is no spike and the next usable reading
    stands in for it as a neighbour. A null ends a frozen run. A null key is a source of its own. Rows with a
    null day are judged for impossibility only; rows with a null row_id are left out. One row per row_id comes out,
    however often it was delivered. Empty in, empty out. Other columns are ignored.
    """
    r = rules or Rules()
    keys, series = list(keys), r.series
    kn = [f"_k{i}" for i in range(len(keys))]
    context = [f"_c{i}" for i in range(len(r.context))]

    def key(c: str) -> Column:
        """Never null, so that joins keep the partitioning of the windows."""
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))

    rows = readings.where(F.col(row_id).isNotNull()).select(
        *[key(k).alias(n) for k, n in zip(keys, kn)],
        F.datediff(F.to_date(F.col(day)), F.lit("1970-01-01").cast("date")).alias("_n"),
        F.col(row_id).alias("_id"),
        F.coalesce(impossible, F.lit(False)).alias("_impossible"),
        *[F.col(s).cast("double").alias(s) for s in series],
        *[key(c).alias(n) for c, n in zip(r.context, context)],
        F.struct(*[c.alias(f"o{i}") for i, c in enumerate(latest)]).alias("_o"),
    )
    values = F.struct(*series)
    bars = rows.where(F.col("_n").isNotNull()).groupBy(*kn, "_n").agg(F.max(F.struct("_o", *series, *context, "_id")).alias("_b"), F.min(values).alias("_least"), F.max(values).alias("_most"))
    current = bars.select(*kn, "_n", *[F.col(f"_b.{c}").alias(c) for c in [*series, *context, "_id"]], (~F.col("_least").eqNullSafe(F.col("_most"))).alias("_varied"))

    line = "PARTITION BY " + ", ".join(kn) + " ORDER BY _n"
    logs = current.withColumns({f"_x_{s}": _log(F.col(s)) for s in [*r.rated, *r.fenced]})
    near = {}
    for s in [*r.rated, *r.fenced]:
        for i in (1, 2, 3):
            near[f"_p{i}_{s}"] = F.expr(f"lag(_x_{s}, {i}) IGNORE NULLS OVER ({line})")
            near[f"_n{i}_{s}"] = F.expr(f"lead(_x_{s}, {i}) IGNORE NULLS OVER ({line})")
    w = Window.partitionBy(*kn).orderBy("_n")
    for s in r.still:
        near[f"_same_{s}"] = F.coalesce(F.col(s) == F.lag(s).over(w), F.lit(False))
    seq = logs.withColumns({**near, "_rn": F.row_number().over(w)})
    for s in r.still:
        seq = seq.withColumn(f"_start_{s}", F.max(F.when(~F.col(f"_same_{s}"), F.col("_rn"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        long = F.when(F.col("_rn") - F.col(f"_start_{s}") + 1 >= r.frozen, F.col(f"_start_{s}"))
        seq = seq.withColumn(f"_frozen_{s}", F.col(s).isNotNull() & F.coalesce(F.min(long).over(w.rowsBetween(0, r.frozen - 1)) <= F.col("_rn"), F.lit(False)))

    sketches = [F.percentile_approx(F.abs(F.col(f"_x_{s}") - F.col(f"_p1_{s}")), F.lit(0.5), r.accuracy).alias(f"_rate_{s}") for s in r.rated]
    sketches += [F.percentile_approx(f"_x_{s}", F.array(*[F.lit(q) for q in _GRID]), r.accuracy).alias(f"_q_{s}") for s in r.fenced]
    normal = seq.groupBy(*kn, *context).agg(*sketches)
    half = len(_GRID) // 2
    for s in r.fenced:
        normal = normal.withColumn(f"_mid_{s}", F.expr(f"get(_q_{s}, {half})")).withColumn(f"_mad_{s}", F.expr(f"get(array_sort(transform(_q_{s}, x -> abs(x - _mid_{s}))), {half})"))
    normal = normal.drop(*[f"_q_{s}" for s in r.fenced])
    judged = seq.join(normal, [*kn, *context])
    far = {f"_far_{s}": F.when(F.col(f"_rate_{s}") > 0, F.col(f"_rate_{s}") * r.rate) for s in r.rated}
    far |= {f"_far_{s}": F.when(F.col(f"_mad_{s}") > 0, F.col(f"_mad_{s}") * (r.fence / 2)) for s in r.fenced}
    judged = judged.withColumns(far)
    off = F.lit(False)
    for s in [*r.rated, *r.fenced]:
        judged = judged.withColumns(_levels(s))
        off = off | _off_level(s)

    def spike() -> Column:
        found = F.lit(False)
        for s in [*r.rated, *r.fenced]:
            test = _departs(s, r.back)
            if s in r.fenced:
                test = test & (F.abs(F.col(f"_x_{s}") - F.col(f"_mid_{s}")) > 2 * F.col(f"_far_{s}"))
            found = found | F.coalesce(test, F.lit(False))
        return found

    stuck = [F.col(f"_frozen_{s}") for s in r.still]
    judged = judged.withColumn("_frozen", F.greatest(*stuck) if len(stuck) > 1 else stuck[0])
    places = [f"_{c}_{s}" for s in [*r.rated, *r.fenced] for c in ("p1", "p2", "n1", "n2", "before", "after", "far")] + [f"_mid_{s}" for s in r.fenced]
    # the few days that are off level, frozen or delivered differently; only these get the full test
    days = stage(
        judged.where(off | F.col("_frozen") | F.col("_varied")).select(*kn, "_n", F.col("_id").alias("_chosen"), "_frozen", *places, *[f"_x_{s}" for s in [*r.rated, *r.fenced]], *[F.when(F.col(f"_frozen_{s}"), F.col(s)).alias(f"_stuck_{s}") for s in r.still]),
        "days",
    )
    for s in [*r.rated, *r.fenced]:
        days = days.withColumns(_sides(s, r.back))
    days = days.withColumn("_spike", spike())
    own = days.where("_spike OR _frozen").select(F.col("_chosen").alias("_id"), F.lit(False).alias("_impossible"), "_frozen", "_spike")
    replaced = rows.select(*kn, "_n", "_id", *series).join(days.drop("_spike", "_frozen", *[f"_x_{s}" for s in [*r.rated, *r.fenced]]), [*kn, "_n"]).where(F.col("_id") != F.col("_chosen"))
    replaced = replaced.withColumns({f"_x_{s}": _log(F.col(s)) for s in [*r.rated, *r.fenced]})
    held = F.lit(False)
    for s in r.still:
        held = held | F.coalesce(F.col(s) == F.col(f"_stuck_{s}"), F.lit(False))
    replaced = replaced.select("_id", F.lit(False).alias("_impossible"), held.alias("_frozen"), spike().alias("_spike"))
    alone = rows.where("_impossible").select("_id", "_impossible", F.lit(False).alias("_frozen"), F.lit(False).alias("_spike"))
    every = own.unionByName(replaced.where("_frozen OR _spike")).unionByName(alone).groupBy("_id")
    return every.agg(F.bool_or("_impossible").alias("impossible"), F.bool_or("_frozen").alias("frozen"), F.bool_or("_spike").alias("spike")).withColumnRenamed("_id", row_id)
