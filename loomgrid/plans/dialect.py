"""Factor expressions as standard SQL with window functions, for checking the compiler in another engine."""

from __future__ import annotations

from collections.abc import Sequence

from loomgrid.functions.expr import Node
from loomgrid.plans.compile import ASSET, ROW, levels


def _nan(x: str) -> str:
    return f"nullif({x}, 'nan'::DOUBLE)"


def _row(n: Node, a: list[str]) -> str:
    op = n.op
    if op in ("add", "sub", "mul"):
        return _nan(f"({a[0]} {'+-*'[('add', 'sub', 'mul').index(op)]} {a[1]})")
    if op == "div":
        return f"CASE WHEN {a[1]} <> 0 THEN {_nan(f'({a[0]} / {a[1]})')} WHEN {a[1]} = 0 AND {a[0]} > 0 THEN 'inf'::DOUBLE WHEN {a[1]} = 0 AND {a[0]} < 0 THEN '-inf'::DOUBLE END"
    if op == "pow":
        if n.inputs[1].op == "const" and n.inputs[1].params[0] in (2.0, 4.0, 5.0):
            return _nan("(" + " * ".join([a[0]] * int(n.inputs[1].params[0])) + ")")
        if n.inputs[1].op == "const" and n.inputs[1].params[0] == 0.5:
            return f"CASE WHEN {a[0]} >= 0 THEN sqrt({a[0]}) END"
        return _nan(f"pow({a[0]}, {a[1]})")
    if op in ("lt", "le", "gt", "ge"):
        return f"coalesce({a[0]} {dict(lt='<', le='<=', gt='>', ge='>=')[op]} {a[1]}, false)"
    return {
        "neg": lambda: f"(-{a[0]})",
        "abs": lambda: f"abs({a[0]})",
        "sign": lambda: f"sign({a[0]})::DOUBLE",
        "sin": lambda: f"sin({a[0]})",
        "cos": lambda: f"cos({a[0]})",
        "tanh": lambda: f"tanh({a[0]})",
        "ln": lambda: f"CASE WHEN {a[0]} > 0 THEN ln({a[0]}) END",
        "log": lambda: f"CASE WHEN {a[0]} IS NOT NULL THEN ln(greatest(abs({a[0]}), 1e-10)) END",
        "finite": lambda: f"CASE WHEN abs({a[0]}) < 'inf'::DOUBLE THEN {a[0]} END",
        "or": lambda: f"({a[0]} OR {a[1]})",
        "and": lambda: f"({a[0]} AND {a[1]})",
        "flag": lambda: f"CASE WHEN {a[0]} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
        "flag_or_null": lambda: f"CASE WHEN {a[1]} IS NOT NULL AND {a[2]} IS NOT NULL THEN CASE WHEN {a[0]} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END",
        "where": lambda: f"CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END",
        "fill": lambda: f"coalesce(CASE WHEN abs({a[0]}) < 'inf'::DOUBLE THEN {a[0]} END, {float(n.params[0])}::DOUBLE)",
        "zero": lambda: f"CASE WHEN {a[0]} <> 0 THEN {a[0]} WHEN {a[0]} = 0 THEN {'NULL' if n.params[0] is None else repr(n.params[0])}::DOUBLE END",
        "min2": lambda: f"CASE WHEN {a[0]} IS NOT NULL AND {a[1]} IS NOT NULL THEN least({a[0]}, {a[1]}) END",
    }[op]()


def _asset(node: Node, a: list[str], by: str) -> str:
    op, x, n = node.op, a[0], int(node.params[0])
    full = op.startswith("full_")
    op = op[5:] if full else op
    line = f"OVER (PARTITION BY {by} ORDER BY date)"
    w = f"OVER (PARTITION BY {by} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    least = n if full else 1

    def enough(value: str, k: int) -> str:
        return f"CASE WHEN count({x}) {w} >= {k} THEN {value} END"

    if op == "delay":
        return f"lag({x}, {n}) {line}"
    if op == "delta":
        return _nan(f"({x} - lag({x}, {n}) {line})")
    if op in ("ts_sum", "sum", "sma", "ma", "ts_min", "min", "ts_max", "max", "med"):
        f = {"ts_sum": "sum", "sma": "avg", "ma": "avg", "ts_min": "min", "ts_max": "max", "med": "median"}.get(op, op)
        return enough(f"round({f}({x}) {w}, 9)" if f in ("sum", "avg") else f"{f}({x}) {w}", least)
    if op in ("stddev", "std"):
        return enough(f"CASE WHEN max({x}) {w} > min({x}) {w} THEN stddev_samp({x}) {w} ELSE 0.0 END", max(n if full else 2, 2))
    if op in ("skew", "kurt"):
        f, k, still = ("skewness", 3, 0.0) if op == "skew" else ("kurtosis", 4, -3.0)
        return enough(f"CASE WHEN count({x}) {w} >= {k} THEN CASE WHEN max({x}) {w} > min({x}) {w} THEN {f}({x}) {w} ELSE {still} END END", n)
    if op in ("correlation", "corr0", "corr", "covariance", "cov"):
        px, py = (f"(CASE WHEN {a[0]} IS NOT NULL AND {a[1]} IS NOT NULL THEN {v} END)" for v in a[:2])
        if op in ("covariance", "cov"):
            return f"CASE WHEN count({px}) {w} >= {n if full else 3} THEN round(covar_samp({px}, {py}) {w}, 12) END"
        raw = f"CASE WHEN count({px}) {w} >= {n if full else min(3, n)} AND count({px}) {w} >= 2 AND max({px}) {w} > min({px}) {w} AND max({py}) {w} > min({py}) {w} THEN CASE WHEN count({px}) {w} = 2 THEN sign(covar_pop({px}, {py}) {w})::DOUBLE ELSE round(covar_pop({px}, {py}) {w} / nullif(stddev_pop({px}) {w} * stddev_pop({py}) {w}, 0), 10) END END"
        raw = f"CASE WHEN abs({raw}) <= 1.000001 THEN {raw} END"
        return f"coalesce({raw}, 0.0)" if op == "corr0" else raw
    if op in ("ts_rank", "rank"):
        held = f"list({x}) FILTER ({x} IS NOT NULL) {w}"
        return enough(f"CASE WHEN {x} IS NOT NULL THEN (len(list_filter({held}, lambda v: v < {x})) + (len(list_filter({held}, lambda v: v = {x})) + 1) / 2.0::DOUBLE) / count({x}) {w} END", least)
    if op in ("ts_argmax", "ts_argmin"):
        best = f"{'max' if op == 'ts_argmax' else 'min'}({x}) {w}"
        raw = f"list({x}) {w}"
        return enough(f"CASE WHEN count({x}) {w} < count(*) {w} THEN list_position(list_transform({raw}, lambda v: v IS NULL), true) ELSE list_position({raw}, {best}) END", 1) + "::DOUBLE"
    if op in ("product", "decay_linear"):
        rows = f"count(*) {w}"
        if op == "product":
            value = f"list_reduce(list_prepend(1.0::DOUBLE, list({x}) {w}), lambda s, v: s * v)"
        else:
            terms = "0.0::DOUBLE"
            for j in range(n):
                at = x if not j else f"lag({x}, {j}) {line}"
                terms = f"({terms} + CASE WHEN {rows} > {j} THEN ({rows} - {j}) * {at} ELSE 0.0::DOUBLE END)"
            value = f"{terms} / ({rows} * ({rows} + 1) / 2.0::DOUBLE)"
        return f"CASE WHEN count({x}) {w} = {rows} THEN {value} END"
    raise KeyError(node.op)


def _date(node: Node, a: list[str], by: str) -> str:
    x = a[0]
    if node.op == "rank":
        return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY {by}) END"
    total = f"sum(abs({x})) OVER (PARTITION BY {by})"
    return f"CASE WHEN {total} > 1e-10 THEN {_nan(f'({x} / {total})')} END"


def to_sql(factors: dict[str, Node], source: str, entity: Sequence[str] = ("market", "asset"), group: Sequence[str] = ("market", "date"), keep: Sequence[str] = ()) -> str:
    """CTEs ending in one named ``factors``: entity, date, ``keep`` and one column per factor, over the table ``source``."""
    keys = list(dict.fromkeys([*entity, "date", *group, *keep]))
    names: dict[Node, str] = {}

    def ref(n: Node) -> str:
        if n.op == "const":
            return f"({n.params[0]}::DOUBLE)"
        return str(n.params[0]) if n.op == "field" else names[n]

    out, last = [], source
    for k, (kind, nodes) in enumerate(levels(list(factors.values()))):
        cols = []
        for n in nodes:
            a = [ref(c) for c in n.inputs]
            text = _row(n, a) if kind == ROW else _asset(n, a, ", ".join(entity)) if kind == ASSET else _date(n, a, ", ".join(group))
            cols.append((n, text))
        for n, _ in cols:
            names[n] = f"n{len(names)}"
        out.append(f"f{k} AS (SELECT *, {', '.join(f'{t} AS {names[n]}' for n, t in cols)} FROM {last})")
        last = f"f{k}"
    final = ", ".join([*keys, *[f"({ref(n)})::DOUBLE AS {name}" for name, n in factors.items()]])
    return ",\n".join([*out, f"factors AS (SELECT {final} FROM {last})"])
