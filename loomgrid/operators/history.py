"""History of changing attributes from periodic snapshots, by Merkle comparison of key buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.session import stage

#: Nodes below a node.
FAN_OUT = 16
#: Entities of a leaf, on average, where no number of leaves is given.
LEAF_ENTITIES = 4
#: Levels from the leaves to the buckets, whose rows are together in a task.
BUCKET_LEVELS = 2


def version_history(
    snapshots: DataFrame,
    keys: Sequence[str],
    taken: str,
    latest: Sequence[Column],
    attributes: dict[str, Column],
    leaves: int | None = None,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """Every version of an entity's attributes with its period: keys, attributes, ``valid_from``, ``valid_to`` (NULL: open).

    ``taken`` is the day of a snapshot; of several rows of an entity and day the greatest by ``latest`` counts.
    A version starts at the entity's first snapshot and wherever a snapshot differs from the preceding one;
    an absent snapshot changes nothing. ``valid_to`` is the day before the next version's ``valid_from``.

    Merkle comparison: entities are hashed into leaves, and ``fan_out`` nodes of a level into one of the level above, up to one
    root. A node's hash for a day combines the hashes of its rows of that day. Consecutive days of a node are compared; from the
    root down, below a node whose hash is that of its preceding snapshot nothing is looked at, since the same entities were there
    with the same attributes. Only the rows of differing leaves are compared with their entity's preceding compared row, and
    changed ones become versions.

    A node hash is a pair of independent 64-bit hashes, combined by exclusive or (its rows are all different, and no number of them
    can overflow), so two different contents agree with probability 2**-128.

    Distribution: the snapshots are read once, reduced to one row per entity and day with partial aggregation, and written. Their
    hashes are dealt once to tasks by bucket, the node two levels above the leaves (at most ``fan_out ** 2`` leaves, with as many
    rows as their entities have days); there leaves are compared, and a bucket's row of a day lists its differing ones. Buckets are
    written, and so is each level above, which combines the one below. The descent is a semi join on (node, day) per level, the
    last one with the rows themselves; the comparison is a window per entity over days, bounded by the calendar. The shuffle
    files of what is written are removed at once. ``leaves`` is by default a quarter of the (approximate) number of entities, so
    that a leaf holds a few.

    Nulls: attributes are compared null-safely, as prepared by the given expressions. A null key is an entity of its
    own; a row with a null day is no snapshot. Repeated rows count once. Empty in, empty out.
    """
    if fan_out < 2:
        raise ValueError("fan_out must be at least 2")
    keys, names = list(keys), list(attributes)
    kn = [f"_k{i}" for i in range(len(keys))]
    an = [f"_a{i}" for i in range(len(names))]
    rows = snapshots.where(F.col(taken).isNotNull()).select(
        *[F.col(k).alias(n) for k, n in zip(keys, kn)],
        F.to_date(F.col(taken)).alias("_day"),
        F.struct(*[c.alias(f"o{i}") for i, c in enumerate(latest)], *[c.alias(n) for n, c in zip(an, attributes.values())]).alias("_row"),
    )
    state = rows.groupBy(*kn, "_day").agg(F.max("_row").alias("_row")).select(*kn, "_day", *[F.col(f"_row.{a}").alias(a) for a in an])
    state = stage(state, "state", once=True)
    content = [x for c in [*kn, *an] for x in (F.col(c).isNull(), F.col(c))]
    entity = F.xxhash64(*kn)
    if leaves is None:
        leaves = state.agg(F.approx_count_distinct(entity).alias("n")).first().n // LEAF_ENTITIES
    depth = 0
    while fan_out**depth < max(leaves, 1):
        depth += 1
    span = fan_out ** min(BUCKET_LEVELS, depth)
    placed = state.withColumn("_leaf", F.pmod(F.xxhash64(entity), F.lit(fan_out**depth)))
    hashed = placed.select(F.expr(f"_leaf div {span}").alias("_node"), "_leaf", "_day", F.xxhash64(*content).alias("_h1"), F.xxhash64(F.lit(0x5BD1E995), *content).alias("_h2"), F.lit(1).cast("bigint").alias("_rows"))

    def digest(df: DataFrame, by: Sequence[str], *more: Column) -> DataFrame:
        """Hashes by exclusive or, so that neither order nor number can change or overflow them; whether each is that of the node's preceding day."""
        w = Window.partitionBy(*by).orderBy("_day")
        same = F.lit(True)
        for c in ("_h1", "_h2", "_rows"):
            same = same & (F.col(c) == F.lag(c).over(w))
        return df.groupBy(*by, "_day").agg(F.bit_xor("_h1").alias("_h1"), F.bit_xor("_h2").alias("_h2"), F.sum("_rows").alias("_rows"), *more).withColumn("_same", F.coalesce(same, F.lit(False)))

    lowest = digest(hashed.repartition("_node"), ["_node", "_leaf"])
    levels = [stage(digest(lowest, ["_node"], F.collect_list(F.when(~F.col("_same"), F.col("_leaf"))).alias("_differing")), "buckets", once=True)]
    while span < fan_out**depth:
        levels.append(stage(digest(levels[-1].withColumn("_node", F.expr(f"_node div {fan_out}")), ["_node"]), "level", once=True))
        span *= fan_out
    levels[0] = levels[0].where(F.size("_differing") > 0)
    changed = levels[-1].where("NOT _same")
    for nodes in levels[-2::-1]:
        below = nodes.where("NOT _same").withColumn("_above", F.expr(f"_node div {fan_out}"))
        changed = below.join(changed.select(F.col("_node").alias("_above"), "_day"), ["_above", "_day"], "left_semi")
    compared = placed.join(changed.select("_day", F.explode("_differing").alias("_leaf")), ["_leaf", "_day"], "left_semi").select(*kn, "_day", F.struct(*an).alias("_now"))
    w = Window.partitionBy(*kn).orderBy("_day")
    differs = F.lag("_day").over(w).isNull() | ~F.col("_now").eqNullSafe(F.lag("_now").over(w))
    versions = compared.withColumn("_new", differs).where("_new").withColumn("_end", F.date_sub(F.lead("_day").over(w), 1))
    return versions.select(*[F.col(n).alias(k) for n, k in zip(kn, keys)], *[F.col(f"_now.{a}").alias(n) for a, n in zip(an, names)], F.col("_day").alias("valid_from"), F.col("_end").alias("valid_to"))
