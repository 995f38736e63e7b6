"""Wide windows and many ranks: runs of asset or date levels over NumPy arrays, on the cells that bars can reach.

Of the dense grid only the cells are kept that have a bar of their asset within the look-back of the batch (active), and as
many before them (weight 0) as their windows read. All other cells of a market and day hold the same values, those of an asset
without bars: one such asset per market stands for them, in cross-sections with their number as weight. Results are those of
``evaluate`` over the dense grid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.expr import FIELDS, Node
from loomgrid.plans.compile import ASSET, DATE, ROW, _row, levels, need_of
from loomgrid.sources.panel import ENTITY

WEIGHT, PLACE = "_w", "_at"
_BOOL = {"lt", "le", "gt", "ge", "or", "and"}
#: Values and where they are not missing.
Values = tuple[np.ndarray, np.ndarray]


def lookback(node: Node) -> int:
    """Rows before its own that a value depends on."""
    if node.op == "field":
        return int(node.params[0] == "returns")
    own = 0
    if need_of(node) == ASSET:
        own = int(node.params[0]) - (node.op not in ("delay", "delta"))
    return own + max((lookback(c) for c in node.inputs), default=0)


def active_grid(bars: DataFrame, reach: int, values: Sequence[str] = FIELDS) -> DataFrame:
    """The kept cells with ``values``, returns, ``present`` and weight: 1, 0, or of the asset without bars (NULL) minus the number of assets."""
    line = Window.partitionBy(*ENTITY).orderBy("date")
    days = F.broadcast(bars.groupBy("market").agg(F.array_sort(F.collect_set("date")).alias("_days")))
    places = F.broadcast(days.select("market", F.posexplode("_days").alias("_i", "date")))
    known = bars.join(places, ["market", "date"]).select(*ENTITY, *values, (F.col("_i") + 1).alias("_k"), "date")
    known = known.withColumns({"_p": F.lag("_k").over(line), "_n": F.lead("_k").over(line)})
    first = F.least("_k", F.greatest(F.lit(1), F.col("_k") - reach, F.col("_p") + reach + 1))
    last = F.least(F.col("_n") - 1, F.col("_k") + reach, F.size("_days"))
    cells = known.join(days, "market").select(*ENTITY, *values, F.col("date").alias("_own"), F.slice("_days", first, last - first + 1).alias("_cells"))
    cells = cells.select(*ENTITY, *values, "_own", F.explode("_cells").alias("date"))
    present = F.col("date") == F.col("_own")
    cells = cells.select(*ENTITY, "date", *[F.when(present, F.col(v)).alias(v) for v in values], present.alias("present"), F.when(F.col("date") < F.col("_own"), 0.0).otherwise(1.0).alias(WEIGHT))
    cells = cells.withColumn("returns", F.try_divide(F.col("close"), F.lag("close").over(line)) - 1)
    number = bars.select(*ENTITY).distinct().groupBy("market").agg((-F.count(F.lit(1))).cast("double").alias(WEIGHT))
    empty = {v: F.lit(None).cast("double") for v in (*values, "returns")}
    rest = days.join(F.broadcast(number), "market").select("market", F.lit(None).cast("string").alias("asset"), F.explode("_days").alias("date"), WEIGHT).withColumns({**empty, "present": F.lit(False)})
    return cells.unionByName(rest)


# --- arrays --------------------------------------------------------------------


def _round(x: np.ndarray, digits: int) -> np.ndarray:
    """Half up on the shortest decimal form of a double, as the engine rounds."""
    t = np.abs(x) * 10.0**digits
    whole = np.floor(t)
    part = t - whole
    out = np.copysign((whole + (part >= 0.5)) / 10.0**digits, x)
    fixed = ~(t < 2.0**54)
    out[fixed] = x[fixed]
    close = np.flatnonzero(~fixed & ((np.abs(part - 0.5) < 1e-6 * np.maximum(1, t * 1e-9)) | (t >= 2.0**50)))
    unit = Decimal(1).scaleb(-digits)
    for i in close:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(unit, ROUND_HALF_UP))
    return out + 0.0


def _key(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles, NaN last."""
    bits = (np.where(np.isnan(x), np.nan, x) + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits, bits)


def _truth(x: Values) -> np.ndarray:
    return x[0] & x[1]


def _row_values(n: Node, a: list[Values]) -> Values | None:
    """A row operator; None for those whose last bit may differ between libraries."""
    op, x = n.op, a[0]
    both = np.logical_and.reduce([v for _, v in a])
    if op in ("add", "sub", "mul"):
        out = x[0] + a[1][0] if op == "add" else x[0] - a[1][0] if op == "sub" else x[0] * a[1][0]
        return out, both & ~np.isnan(out)
    if op == "div":
        y = a[1][0]
        out = np.where(y != 0, x[0] / y, np.where(x[0] > 0, np.inf, np.where(x[0] < 0, -np.inf, np.nan)))
        return out, both & ~np.isnan(out)
    if op == "pow":
        out = x[0]
        for _ in range(int(n.inputs[1].params[0]) - 1):
            out = out * x[0]
        return out, x[1] & ~np.isnan(out)
    if op in ("lt", "le", "gt", "ge"):
        p, q = _key(x[0]), _key(a[1][0])
        held = p < q if op == "lt" else p <= q if op == "le" else p > q if op == "gt" else p >= q
        return held & both, np.ones(len(held), bool)
    if op == "or":
        return _truth(x) | _truth(a[1]), np.ones(len(both), bool)
    if op == "and":
        return _truth(x) & _truth(a[1]), np.ones(len(both), bool)
    if op == "flag":
        return _truth(x).astype(float), np.ones(len(both), bool)
    if op == "where":
        c = _truth(x)
        return np.where(c, a[1][0], a[2][0]), np.where(c, a[1][1], a[2][1])
    if op == "neg":
        return -x[0], x[1]
    if op == "abs":
        return np.abs(x[0]), x[1]
    if op == "sign":
        return np.sign(x[0]), x[1]
    if op == "fill":
        good = x[1] & np.isfinite(x[0])
        return np.where(good, x[0], float(n.params[0])), np.ones(len(good), bool)
    if op == "finite":
        return x[0], x[1] & np.isfinite(x[0])
    if op == "zero":
        k = n.params[0]
        return np.where(x[0] == 0, np.nan if k is None else float(k), x[0]), x[1] & ((x[0] != 0) if k is None else True)
    if op == "min2":
        return np.fmin(x[0], a[1][0]), both
    return None


def _in_arrays(n: Node) -> bool:
    if need_of(n) != ROW:
        return True
    if n.op == "pow":
        return n.inputs[1].op == "const" and n.inputs[1].params[0] in (2.0, 4.0, 5.0)
    return n.op in _BOOL or n.op in ("add", "sub", "mul", "div", "flag", "where", "neg", "abs", "sign", "fill", "finite", "zero", "min2")


class _Lines:
    """Windows over rows sorted by asset and day; ``place`` counts from 1 in each asset. Sums run from the oldest row on."""

    def __init__(self, place: np.ndarray):
        self.place, self.size = place, len(place)

    def before(self, x: np.ndarray, j: int, fill: float | bool = 0) -> np.ndarray:
        """``x`` of j rows before; at the start of the first asset ``fill``."""
        if not j:
            return x
        out = np.full(self.size, fill, x.dtype)
        out[j:] = x[: max(0, self.size - j)]
        return out

    def oldest_first(self, n: int, v: np.ndarray, *x: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For the rows of the window one after another: whether a value is there, and the values."""
        n = min(n, int(self.place.max()))
        padded = [np.concatenate([np.zeros(n - 1, c.dtype), c]) for c in (v, *x)]
        for j in range(n - 1, -1, -1):
            ok, *values = [c[n - 1 - j : n - 1 - j + self.size] for c in padded]
            yield ok & (self.place > j), *values

    def count(self, n: int, v: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(v)])
        at = np.arange(1, self.size + 1)
        return total[at] - total[at - np.minimum(n, self.place)]

    def best(self, n: int, x: Values, largest: bool) -> np.ndarray:
        """The largest or smallest in the window by doubling; NaN is largest."""
        f, none = (np.maximum, -np.inf) if largest else (np.fmin, np.nan)
        out, p = np.where(x[1], x[0], none), 1
        while p < n:
            step = min(p, n - p)
            out = np.where(self.place > step, f(out, self.before(out, step)), out)
            p += step
        return out

    def moments(self, n: int, x: Values) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of squared deviations."""
        k, mean, m2 = (np.zeros(self.size) for _ in range(3))
        for ok, v in self.oldest_first(n, x[1], x[0]):
            k += ok
            d = np.where(ok, v - mean, 0.0)
            dn = d / np.maximum(k, 1)
            mean += dn
            m2 += d * (d - dn)
        return k, m2

    def moves(self, n: int, x: Values) -> np.ndarray:
        return _key(self.best(n, x, True)) > _key(self.best(n, x, False))

    def pair(self, n: int, x: Values, y: Values) -> tuple[np.ndarray, np.ndarray, Values]:
        """Pairs, their co-moment, and their correlation before its limits are applied."""
        both = x[1] & y[1]
        px, py = (np.where(both, x[0], 0.0), both), (np.where(both, y[0], 0.0), both)
        k, mx, my, sx, sy, c = (np.zeros(self.size) for _ in range(6))
        for ok, v, u in self.oldest_first(n, both, px[0], py[0]):
            k += ok
            kk = np.maximum(k, 1)
            dx, dy = np.where(ok, v - mx, 0.0), np.where(ok, u - my, 0.0)
            dxn, dyn = dx / kk, dy / kk
            mx += dxn
            my += dyn
            sx += dx * (dx - dxn)
            sy += dy * (dy - dyn)
            c += np.where(ok, dx * (u - my), 0.0)
        some = np.maximum(k, 1)
        spread = np.sqrt(sx / some) * np.sqrt(sy / some)
        moves = self.moves(n, px) & self.moves(n, py)
        out = np.where(k == 2, np.sign(c / some), _round(np.where(spread != 0, c / some / np.where(spread != 0, spread, 1), np.nan), 10))
        return k, c, (out, moves & (k >= 2) & (np.abs(out) <= 1 + 1e-6))

    def value(self, node: Node, a: list[Values]) -> Values:
        op, x, n = node.op, a[0], int(node.params[0])
        full = op.startswith("full_")
        op = op[5:] if full else op
        least = n if full else 1
        if op in ("delay", "delta"):
            old = self.before(x[0], n), self.before(x[1], n, False) & (self.place > n)
            if op == "delay":
                return old
            out = x[0] - old[0]
            return out, x[1] & old[1] & ~np.isnan(out)
        if op in ("correlation", "corr0", "corr", "covariance", "cov"):
            k, c, (corr, good) = self.pair(n, *a)
            if op in ("covariance", "cov"):
                return _round(c / np.maximum(k - 1, 1), 12), k >= max(n if full else 3, 2)
            good = good & (k >= (n if full else min(3, n)))
            return (np.where(good, corr, 0.0), np.ones(self.size, bool)) if op == "corr0" else (corr, good)
        held = self.count(n, x[1])
        enough = held >= least
        if op in ("ts_sum", "sum", "sma", "ma"):
            total = np.zeros(self.size)
            for ok, v in self.oldest_first(n, x[1], x[0]):
                np.add(total, v, out=total, where=ok)
            return _round(total if op in ("ts_sum", "sum") else total / np.maximum(held, 1), 9), enough
        if op in ("ts_min", "min", "ts_max", "max"):
            return self.best(n, x, op in ("ts_max", "max")), enough
        if op in ("stddev", "std"):
            k, m2 = self.moments(n, x)
            return np.where(self.moves(n, x), np.sqrt(m2 / np.maximum(k - 1, 1)), 0.0), k >= max(n if full else 2, 2)
        if op in ("ts_rank", "rank"):
            own = _key(x[0])
            below, same = np.zeros(self.size), np.zeros(self.size)
            for ok, v in self.oldest_first(n, x[1], own):
                below += (v < own) & ok
                same += (v == own) & ok
            return (below + (same + 1) / 2.0) / np.maximum(held, 1), enough & x[1]
        rows = np.minimum(n, self.place)
        if op == "product":
            out = np.ones(self.size)
            for ok, v in self.oldest_first(n, x[1], x[0]):
                np.multiply(out, v, out=out, where=ok)
            return out, held == rows
        if op == "decay_linear":
            out = np.zeros(self.size)
            for j in range(n):
                np.add(out, (rows - j) * self.before(x[0], j), out=out, where=rows > j)
            return out / (rows * (rows + 1) / 2.0), held == rows
        raise KeyError(node.op)


class _Days:
    """Cross-sections over rows sorted by market and day, each row with a weight."""

    def __init__(self, place: np.ndarray, weight: np.ndarray):
        self.group = np.cumsum(place == 1) - 1
        taken = np.bincount(self.group, np.maximum(weight, 0.0), self.group[-1] + 1)
        self.weight = np.where(weight < 0, -weight - taken[self.group], weight)

    def value(self, node: Node, a: list[Values]) -> Values:
        x, v = a[0]
        w = np.where(v, self.weight, 0.0)
        if node.op == "scale":
            total = np.bincount(self.group, np.where(w > 0, np.abs(x), 0.0) * w)[self.group]
            out = x / np.where(total > 1e-10, total, 1.0)
            return out, v & (total > 1e-10) & ~np.isnan(out)
        key = _key(x)
        at = np.lexsort((key, ~v, self.group))
        g, k, missing, ws = self.group[at], key[at], ~v[at], w[at]
        new = np.r_[True, (g[1:] != g[:-1])]
        tie = new | np.r_[True, (k[1:] != k[:-1]) | (missing[1:] != missing[:-1])]
        sums = np.r_[0.0, np.cumsum(ws)]
        starts = np.flatnonzero(tie)
        ends = np.r_[starts[1:], len(at)]
        run = np.cumsum(tie) - 1
        ties = (sums[ends] - sums[starts])[run]
        opened = np.flatnonzero(new)
        base = sums[opened][np.cumsum(new) - 1]
        count = np.bincount(self.group, w)[g]
        out = np.empty(len(at))
        out[at] = (sums[starts][run] - base + 1 + (ties - 1) / 2.0) / np.where(count > 0, count, 1.0)
        return out, v


def _kernel(kind: str, nodes: list[Node], names: dict[Node, str], out: list[Node], through: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The nodes over record batches that hold assets or days one after another, sorted; carries the last one over."""

    def of(column: pa.Array) -> Values:
        valid = np.asarray(column.is_valid())
        if pa.types.is_boolean(column.type):
            return np.asarray(column.fill_null(False)), valid
        return np.asarray(column.fill_null(0.0)), valid

    def whole(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks().to_batches()[0]
        place = np.asarray(rows.column(PLACE))
        frame = _Lines(place) if kind == ASSET else _Days(place, np.asarray(rows.column(WEIGHT)))
        known: dict[Node, Values] = {}

        def get(n: Node) -> Values:
            if n not in known:
                if n.op == "const":
                    known[n] = np.full(len(place), float(n.params[0])), np.ones(len(place), bool)
                else:
                    known[n] = of(rows.column(str(n.params[0]) if n.op == "field" else names[n]))
            return known[n]

        with np.errstate(all="ignore"):
            for n in nodes:
                a = [get(c) for c in n.inputs]
                known[n] = _row_values(n, a) if need_of(n) == ROW else frame.value(n, a)
        made = [pa.array(known[n][0], mask=~known[n][1]) for n in out]
        return pa.RecordBatch.from_arrays([*[rows.column(c) for c in through], *made], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(np.asarray(batch.column(PLACE)) == 1)
            if len(starts) and (held or starts[-1]):
                ready = [*held, batch.slice(0, starts[-1])]
                held = [batch.slice(starts[-1])]
                if sum(b.num_rows for b in ready):
                    yield whole(pa.Table.from_batches(ready))
            elif batch.num_rows:
                held.append(batch)
        if held:
            yield whole(pa.Table.from_batches(held))

    return run


def evaluate_active(grid: DataFrame, factors: dict[str, Node], day: str = "date", keep: Sequence[str] = ("present",)) -> DataFrame:
    """All factors over an ``active_grid`` of at least their look-back; rows of weight 0 are not results.

    Operators on the same distribution run one after another on arrays, so the plan shuffles once per change of it.
    """
    specs = {ASSET: Window.partitionBy(*ENTITY).orderBy(day), DATE: Window.partitionBy("market", day).orderBy(day)}
    order = [n for _, nodes in levels(list(factors.values())) for n in nodes]
    runs: list[tuple[str, list[Node]]] = []
    while order:  # what can be done in the open run, as far as it goes; else a run of the first kind that is ready
        done = {n for _, nodes in runs for n in nodes}
        ready = lambda n, d: all(c in d or c.op in ("field", "const") for c in n.inputs)
        kind = next(k for k in (ROW, ASSET, DATE) if any(need_of(n) == k and ready(n, done) for n in order))
        mine: list[Node] = []
        for n in order:
            if ready(n, done) and (need_of(n) == kind or (kind != ROW and need_of(n) == ROW and _in_arrays(n))):
                mine.append(n)
                done.add(n)
        runs.append((kind, mine))
        order = [n for n in order if n not in done]
    names = {n: f"_n{i}" for i, n in enumerate(n for _, nodes in runs for n in nodes)}
    keys = [*ENTITY, day, *keep, WEIGHT]
    wanted = set(factors.values())
    df = grid

    def ref(n: Node) -> F.Column:
        return F.lit(float(n.params[0])) if n.op == "const" else F.col(n.params[0] if n.op == "field" else names[n])

    for i, (kind, nodes) in enumerate(runs):
        made = {n for _, ns in runs[:i] for n in ns}
        later = wanted | {c for _, ns in runs[i + 1 :] for n in ns for c in n.inputs}
        now = {c for n in nodes for c in n.inputs}
        column = lambda ns: sorted({str(n.params[0]) if n.op == "field" else names[n] for n in ns})
        through = [*keys, *[c for c in column(n for n in later if n in made or n.op == "field") if c not in keys]]
        if kind == ROW:
            df = df.select(*through, *[_row(n, [ref(c) for c in n.inputs]).alias(names[n]) for n in nodes])
            continue
        if kind == DATE and all(k != ASSET for k, _ in runs[i + 1 :]):
            df = df.where(F.col(WEIGHT) != 0)
        out = [n for n in nodes if n in later]
        inputs = [c for c in column(n for n in now if n in made or n.op == "field") if c not in through]
        df = df.select(*through, *inputs, F.row_number().over(specs[kind]).alias(PLACE))
        types = {c: t for c, t in df.dtypes}
        ddl = ", ".join([*[f"{c} {types[c]}" for c in through], *[f"{names[n]} {'boolean' if n.op in _BOOL else 'double'}" for n in out]])
        arrow = {"string": pa.string(), "date": pa.date32(), "double": pa.float64(), "boolean": pa.bool_()}
        schema = pa.schema([*[(c, arrow[types[c]]) for c in through], *[(names[n], pa.bool_() if n.op in _BOOL else pa.float64()) for n in out]])
        df = df.mapInArrow(_kernel(kind, nodes, names, out, through, schema), ddl)
    return df.select(*keys, *[ref(n).cast("double").alias(name) for name, n in factors.items()])
