"""Leveled compilation: many factor expressions into one plan of alternating asset and date levels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomgrid.functions.expr import Node

ASSET, DATE, ROW = "asset", "date", "row"
_ASSET_OPS = set("delay delta ts_sum sma stddev ts_rank ts_min ts_max ts_argmax ts_argmin product decay_linear correlation corr0 covariance".split())
_DATE_OPS = {"rank", "scale"}
INF = float("inf")


def need_of(node: Node) -> str:
    """The distribution of rows that an operator needs."""
    if node.op in _DATE_OPS:
        return DATE
    if node.op in _ASSET_OPS or (node.op.startswith("full_")):
        return ASSET
    return ROW


def levels(roots: Sequence[Node]) -> list[tuple[str, list[Node]]]:
    """Every distinct node once, in levels: row and asset levels until nothing is left but date operators, then those."""
    nodes: dict[Node, None] = {}

    def visit(n: Node) -> None:
        if n not in nodes:
            for c in n.inputs:
                visit(c)
            nodes[n] = None

    for r in roots:
        visit(r)
    left = [n for n in nodes if n.op not in ("field", "const")]
    done = {n for n in nodes if n.op in ("field", "const")}
    out: list[tuple[str, list[Node]]] = []
    while left:
        for kind in (ROW, ASSET, DATE):
            ready = [n for n in left if need_of(n) == kind and all(c in done for c in n.inputs)]
            if ready:
                break
        out.append((kind, ready))
        done.update(ready)
        left = [n for n in left if n not in done]
    return out


def alternations(roots: Sequence[Node]) -> int:
    """Times the plan changes between asset and date distribution: the shuffles beyond the first."""
    kinds = [k for k, _ in levels(roots) if k != ROW]
    return sum(a != b for a, b in zip([ASSET, *kinds], kinds))


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(INF), x)


def _number(x: Column) -> Column:
    """NULL instead of NaN."""
    return F.nullif(x, F.lit(float("nan")))


def ieee_div(x: Column, y: Column) -> Column:
    """x / y with signed infinities for a zero denominator and NULL for 0 / 0."""
    return F.when(y != 0, _number(x / y)).when((y == 0) & (x > 0), F.lit(INF)).when((y == 0) & (x < 0), F.lit(-INF))


def _row(node: Node, a: list[Column]) -> Column:
    op = node.op
    if op in ("add", "sub", "mul"):
        return _number(a[0] + a[1] if op == "add" else a[0] - a[1] if op == "sub" else a[0] * a[1])
    if op == "div":
        return ieee_div(*a)
    if op == "pow":
        if node.inputs[1].op == "const" and node.inputs[1].params[0] in (2.0, 4.0, 5.0):
            out = a[0]
            for _ in range(int(node.inputs[1].params[0]) - 1):
                out = out * a[0]
            return _number(out)
        if node.inputs[1].op == "const" and node.inputs[1].params[0] == 0.5:
            return F.when(a[0] >= 0, F.sqrt(a[0]))
        return _number(F.pow(*a))
    if op in ("lt", "le", "gt", "ge"):
        c = {"lt": a[0] < a[1], "le": a[0] <= a[1], "gt": a[0] > a[1], "ge": a[0] >= a[1]}[op]
        return F.coalesce(c, F.lit(False))
    simple: dict[str, Callable[[], Column]] = {
        "neg": lambda: -a[0],
        "abs": lambda: F.abs(a[0]),
        "sign": lambda: F.signum(a[0]),
        "sin": lambda: F.sin(a[0]),
        "cos": lambda: F.cos(a[0]),
        "tanh": lambda: F.tanh(a[0]),
        "ln": lambda: F.when(a[0] > 0, F.ln(a[0])),
        "log": lambda: F.ln(F.greatest(F.abs(a[0]), F.when(a[0].isNotNull(), F.lit(1e-10)))),
        "finite": lambda: _finite(a[0]),
        "or": lambda: a[0] | a[1],
        "and": lambda: a[0] & a[1],
        "flag": lambda: F.when(a[0], F.lit(1.0)).otherwise(F.lit(0.0)),
        "flag_or_null": lambda: F.when(a[1].isNotNull() & a[2].isNotNull(), F.when(a[0], F.lit(1.0)).otherwise(F.lit(0.0))),
        "where": lambda: F.when(a[0], a[1]).otherwise(a[2]),
        "fill": lambda: F.coalesce(_finite(a[0]), F.lit(float(node.params[0]))),
        "zero": lambda: F.when(a[0] != 0, a[0]).when(a[0] == 0, F.lit(node.params[0]).cast("double")),
        "min2": lambda: F.when(a[0].isNotNull() & a[1].isNotNull(), F.least(*a)),
    }
    return simple[op]()


def pair_stats(x: Column, y: Column, w: WindowSpec) -> tuple[Column, Column, Column]:
    """Pairs in the window, their sample covariance, and their correlation: NULL where a side is constant.

    Rounded far below any meaning, so that ties between assets do not hang on the order of addition.
    """
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    n = F.count(px).over(w)
    moves = (F.max(px).over(w) > F.min(px).over(w)) & (F.max(py).over(w) > F.min(py).over(w))
    spread = F.stddev_pop(px).over(w) * F.stddev_pop(py).over(w)
    corr = F.when(moves & (n == 2), F.signum(F.covar_pop(px, py).over(w))).when(moves & (n > 2), F.round(F.try_divide(F.covar_pop(px, py).over(w), spread), 10))
    return n, F.round(F.covar_samp(px, py).over(w), 12), F.when(F.abs(corr) <= F.lit(1.0 + 1e-6), corr)


def _asset(node: Node, a: list[Column], line: WindowSpec) -> Column:
    op, x = node.op, a[0]
    n = int(node.params[0])
    w = line.rowsBetween(-(n - 1), 0)
    full = op.startswith("full_")
    op = op[5:] if full else op

    def enough(value: Column, least: int, of: Column | None = None) -> Column:
        return F.when(F.count(x if of is None else of).over(w) >= least, value)

    least = n if full else 1
    if op == "delay":
        return F.lag(x, n).over(line)
    if op == "delta":
        return _number(x - F.lag(x, n).over(line))
    if op in ("ts_sum", "sum"):
        return enough(F.round(F.sum(x).over(w), 9), least)
    if op in ("sma", "ma"):
        return enough(F.round(F.avg(x).over(w), 9), least)
    if op in ("ts_min", "min"):
        return enough(F.min(x).over(w), least)
    if op in ("ts_max", "max"):
        return enough(F.max(x).over(w), least)
    if op == "med":
        return enough(F.percentile(x, F.lit(0.5)).over(w), least)
    if op in ("stddev", "std"):
        moves = F.max(x).over(w) > F.min(x).over(w)
        return enough(F.when(moves, F.stddev_samp(x).over(w)).otherwise(F.lit(0.0)), max(n if full else 2, 2))
    if op in ("skew", "kurt"):
        k = F.count(x).over(w).cast("double")
        moves = (F.max(x).over(w) > F.min(x).over(w)) & (k >= (3 if op == "skew" else 4))
        if op == "skew":
            value = F.skewness(x).over(w) * F.sqrt(k * (k - 1)) / (k - 2)
        else:
            value = ((k + 1) * F.kurtosis(x).over(w) + 6) * (k - 1) / ((k - 2) * (k - 3))
        still = F.lit(0.0) if op == "skew" else F.lit(-3.0)
        return enough(F.when(moves, value).when(k >= (3 if op == "skew" else 4), still), n)
    if op in ("correlation", "corr0", "corr", "covariance", "cov"):
        pairs, cov, corr = pair_stats(a[0], a[1], w)
        if op in ("covariance", "cov"):
            return F.when(pairs >= (n if full else 3), cov)
        corr = F.when(pairs >= (n if full else min(3, n)), corr)
        return F.coalesce(corr, F.lit(0.0)) if op == "corr0" else corr
    if op in ("ts_rank", "rank"):
        held = F.collect_list(x).over(w)
        below = F.size(F.filter(held, lambda v: v < x))
        same = F.size(F.filter(held, lambda v: v == x))
        return enough(F.when(x.isNotNull(), (below + (same + 1) / F.lit(2.0)) / F.size(held)), least)
    if op in ("ts_argmax", "ts_argmin"):
        raw = F.collect_list(F.coalesce(x, F.lit(float("nan")))).over(w)
        missing = F.array_position(raw, F.lit(float("nan")))
        best = F.max(x).over(w) if op == "ts_argmax" else F.min(x).over(w)
        return enough(F.when(missing > 0, missing).otherwise(F.array_position(raw, best)).cast("double"), 1)
    if op in ("product", "decay_linear"):
        rows = F.count(F.lit(1)).over(w)
        if op == "product":
            value = F.aggregate(F.collect_list(x).over(w), F.lit(1.0), lambda s, v: s * v)
        else:
            value = F.lit(0.0)
            for j in range(n):
                value = value + F.when(rows > j, (rows - j) * F.lag(x, j).over(line) if j else rows * x).otherwise(F.lit(0.0))
            value = value / (rows * (rows + 1) / F.lit(2.0))
        return F.when(F.count(x).over(w) == rows, value)
    raise KeyError(node.op)


def _date(node: Node, a: list[Column], group: list[str]) -> Column:
    x = a[0]
    whole = Window.partitionBy(*group)
    if node.op == "rank":
        order = whole.orderBy(x.asc_nulls_last())
        ties = F.count(x).over(order.rangeBetween(Window.currentRow, Window.currentRow))
        return F.when(x.isNotNull(), (F.rank().over(order) + (ties - 1) / F.lit(2.0)) / F.count(x).over(whole))
    total = F.sum(F.abs(x)).over(whole)
    return F.when(total > 1e-10, _number(x / total))


def evaluate(grid: DataFrame, factors: dict[str, Node], entity: Sequence[str] = ("market", "asset"), group: Sequence[str] = ("market", "date"), day: str = "date", keep: Sequence[str] = ()) -> DataFrame:
    """All factors over the dense grid as columns: entity, ``day``, ``keep`` and one column per factor.

    Distinct nodes of the whole batch are computed once. Each level is one projection of named columns, so shared
    inputs are never nested; the plan shuffles once per change between asset and date levels, however many factors.
    """
    line = Window.partitionBy(*entity).orderBy(day)
    keys = [*dict.fromkeys([*entity, day, *group, *keep])]
    order = levels(list(factors.values()))
    last_use: dict[Node, int] = {}
    for k, (_, nodes) in enumerate(order):
        for n in nodes:
            for c in n.inputs:
                last_use[c] = k
    for root in factors.values():
        last_use[root] = len(order)
    names: dict[Node, str] = {}
    df = grid

    def ref(n: Node) -> Column:
        if n.op == "const":
            return F.lit(float(n.params[0]))
        return F.col(n.params[0] if n.op == "field" else names[n])

    for k, (kind, nodes) in enumerate(order):
        new = []
        for n in nodes:
            args = [ref(c) for c in n.inputs]
            value = _row(n, args) if kind == ROW else _asset(n, args, line) if kind == ASSET else _date(n, args, list(group))
            names[n] = f"_n{len(names)}"
            new.append(value.alias(names[n]))
        live = [names[n] for n in names if n not in nodes and last_use.get(n, -1) >= k]
        fields = {n.params[0] for n in last_use if n.op == "field" and last_use[n] >= k}
        df = df.select(*keys, *sorted(fields - set(keys)), *live, *new)
    return df.select(*keys, *[ref(n).cast("double").alias(name) for name, n in factors.items()])
