"""Queries over factor expressions: the published formulas in batches, and the tree grammar operator by operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.expr import Node, field, lower, parse_formula, parse_tree
from loomgrid.functions.formulas import FORMULAS, formula
from loomgrid.plans.arrays import active_grid, evaluate_active, lookback
from loomgrid.plans.compile import evaluate
from loomgrid.plans.dialect import to_sql
from loomgrid.session import stage
from loomgrid.sources.panel import GRID_SQL, current_bars, market_grid

#: Formulas of one query.
BATCH = 6
#: Keeps values that were rounded before away from the halves of the last rounding.
_OFF = 3.3e-12


def stable(x: Column) -> Column:
    """A value free of the last bits that depend on the order of addition; from a million on, by its logarithm."""
    small = F.round(x + _OFF, 6) + 0.0
    return F.when(F.abs(x) < 1e6, small).when(F.abs(x) < float("inf"), F.signum(x) * (1e6 + F.round(F.ln(F.abs(x)), 6))).otherwise(x)


def stable_sql(x: str) -> str:
    return f"CASE WHEN abs({x}) < 1e6 THEN round({x} + {_OFF}, 6) + 0.0 WHEN abs({x}) < 'inf'::DOUBLE THEN sign({x}) * (1e6 + round(ln(abs({x})), 6)) ELSE {x} END"


def factor_query(factors: dict[str, Node]) -> Callable[[SparkSession, str], DataFrame]:
    """The factors on the rows of the panel."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        values = evaluate(market_grid(spark, folder), factors, keep=["present"]).where("present")
        return values.select("market", "asset", "date", *[stable(F.col(n)).alias(n) for n in factors])

    return query


def active_query(factors: dict[str, Node]) -> Callable[[SparkSession, str], DataFrame]:
    """The same on arrays over the cells that bars can reach, for batches of wide windows and many ranks."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        bars = stage(current_bars(spark, folder, []), "bars")
        values = evaluate_active(active_grid(bars, max(map(lookback, factors.values()))), factors).where("present")
        return values.select("market", "asset", "date", *[stable(F.col(n)).alias(n) for n in factors])

    return query


def factor_sql(factors: dict[str, Node]) -> str:
    cols = ", ".join(f"{stable_sql(n)} AS {n}" for n in factors)
    return f"WITH {GRID_SQL},\n{to_sql(factors, 'grid', keep=['present'])}\nSELECT market, asset, date, {cols} FROM factors WHERE present"


_TREES = {
    "tree_scalar": ["Neg(Abs(close))", "Square(Inv(high))", "Sign(Diff(close,2))", "Sin(Log(close))", "Cos(Log(volume))", "Tanh(Pct(close,5))", "Add(Sub(close,open),Mul(high,low))", "Div(Sub(close,open),Sub(high,low))", "Greater(Delay(close,3),close)", "Less(Delay(volume,2),volume)"],
    "tree_rolling": ["Ma(Pct(close,2),10)", "Med(Pct(close,2),10)", "Sum(Log(volume),7)", "Std(Pct(close,2),20)", "Max(Diff(close,2),12)", "Min(Diff(close,2),12)", "Rank(Pct(close,3),10)"],
    "tree_moments": ["Skew(Pct(close,2),20)", "Kurt(Pct(close,2),20)", "Vari(Abs(close),15)", "Zscore(Log(volume),20)"],
    "tree_pairs": ["Autocorr(Pct(close,2),20,3)", "Cov(Pct(close,2),Log(volume),20)", "Corr(Pct(close,2),Log(volume),20)", "Corr(Ma(close,5),Delay(vwap,2),10)"],
}


def _trees(texts: list[str]) -> dict[str, Node]:
    return {f"f{i}": lower(parse_tree(t)) for i, t in enumerate(texts)}


_WINDOW = {
    "ts_basic": ["delay(close, 3)", "delta(close, 2)", "ts_sum(volume, 10)", "sma(close, 10)", "stddev(close, 10)", "ts_min(low, 10)", "ts_max(high, 10)"],
    "ts_pairs": ["correlation(close, volume, 10)", "corr0(high, volume, 5)", "covariance(returns, open / close, 10)"],
    "ts_arrays": ["ts_rank(volume, 10)", "ts_argmax(close, 10)", "ts_argmin(close, 10)", "product(1 + returns, 5)", "decay_linear(returns, 8)"],
    "xs_basic": ["rank(close)", "scale(returns)", "rank(sign(returns))", "flag(rank(close) < rank(volume))", "fill(open / close, 1)", "zero(high - low, 0.0001)", "min2(open, close)", "log(returns)"],
}


def _windows(texts: list[str]) -> dict[str, Node]:
    return {f"f{i}": parse_formula(t) for i, t in enumerate(texts)}


_BATCHES = {f"alphas_{names[0][5:]}_{names[-1][5:]}": {n: formula(n) for n in names} for names in [list(FORMULAS)[i : i + BATCH] for i in range(0, len(FORMULAS), BATCH)]}
_FACTORS: dict[str, dict[str, Node]] = {**{k: _trees(v) for k, v in _TREES.items()}, **{k: _windows(v) for k, v in _WINDOW.items()}, **_BATCHES}

#: Batches that take too long over the dense grid.
_ACTIVE = {"alphas_034_040", "alphas_065_075", "alphas_077_085"}

QUERIES = {name: (active_query if name in _ACTIVE else factor_query)(f) for name, f in _FACTORS.items()}
SQL = {name: factor_sql(f) for name, f in _FACTORS.items()}

#: Signals that the evaluation queries score.
SIGNALS: dict[str, Node] = {
    "momentum": parse_formula("close / delay(close, 20) - 1"),
    "reversal": parse_formula("-1 * (close / delay(close, 5) - 1)"),
    "volume_shock": parse_formula("log(volume) - log(adv20)"),
    "range": parse_formula("(high - low) / close"),
    "formula_012": formula("alpha012"),
    "formula_101": formula("alpha101"),
    "tree_corr": lower(parse_tree("Corr(Pct(close,2),Log(volume),20)")),
    "level": field("close"),
}
