"""Stored panels, code scan, JSON in text, and the daily refitted composite."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.functions.scan import extract_json, findings, scan
from loomgrid.plans.dynamic import dynamic_combination
from loomgrid.sources.panel import COLUMNS, PanelError, backfill, exported, float32_range, load_panel, restrict_to_universe, write_panel

D0 = date(2017, 1, 2)


def _panel(spark, member=True):
    rows = [("hsi", f"a{a}", D0 + timedelta(d), *[1.0 + a] * (len(COLUMNS) - 1), member) for a in range(2) for d in range(3)]
    return spark.createDataFrame(rows, "market string, asset string, date date, " + ", ".join(f"{c} {'boolean' if c == 'tradable' else 'double'}" for c in COLUMNS))


def test_stored_panels_are_checked(spark, tmp_path):
    path = str(tmp_path / "p")
    write_panel(_panel(spark, None), path, "pit-mining")
    assert load_panel(spark, path, "hsi").count() == 6
    for market, universe in (("nyse", None), ("sp100", None), ("hsi", "pit"), ("hsi", "pit-mining")):
        with pytest.raises(PanelError):
            load_panel(spark, path, market, universe)
    with pytest.raises(PanelError):
        load_panel(spark, path, "hsi", columns=["nothing"])
    with pytest.raises(PanelError):
        write_panel(_panel(spark), path, "other")
    write_panel(_panel(spark), path, "pit-mining")
    assert load_panel(spark, path, "hsi", "pit-mining").count() == 6


def test_alignment_export_and_backfill(spark):
    panel = _panel(spark)
    sig = panel.where("asset = 'a0'").select("market", "asset", "date", F.lit(2.0).alias("value"))
    assert restrict_to_universe(sig, panel).where("value IS NULL").count() == 3 and restrict_to_universe(sig, _panel(spark, None)).where("value IS NOT NULL").count() == 0
    assert exported(panel).columns == ["market", "asset", "date", "$open", "$high", "$low", "$close", "$volume", "$vwap"]
    new = panel.where("asset = 'a0'")
    assert backfill(new, panel, spark.createDataFrame([("a1",), ("a0",)], "asset string")).count() == 6
    assert spark.range(1).select(float32_range(F.lit(1e39))).first()[0] is None


HEAD = 'def factor_a(df):\n    "What it does."\n    '


@pytest.mark.parametrize(
    "source,want",
    [
        (HEAD + "return df['close'].shift(-1)", ["negative_shift"]),
        (HEAD + "return df['close'].shift(1, -2)", ["negative_shift"]),
        (HEAD + "return df.diff(periods=-n)", ["negative_shift"]),
        (HEAD + "return df.diff(periods=2 * -3)", ["negative_shift"]),
        (HEAD + "return df.diff(-(-3)).shift(2, fill_value=-1)", []),
        (HEAD + "return df.shift(1).rolling(3, center=True).mean()[::-1]", ["centred_window", "reversed_slice"]),
        (HEAD + "for a in df:\n        while 1:\n            pass", ["endless_loop", "nested_loop"]),
        (HEAD + "for a in df:\n        pass\n    for b in df:\n        pass", []),
        (HEAD + "return eval('df')", ["forbidden_name"]),
        ("import os\n" + HEAD + "return 1", ["import"]),
        ("def f(df, n):\n    return df.shift(periods=2)", ["function_name", "argument_count", "no_docstring"]),
        ("x = 1", ["function_count"]),
        ("def (", ["unparsable"]),
        ("", ["unparsable"]),
        (None, ["unparsable"]),
    ],
)
def test_code_scan(source, want):
    assert findings(source) == want


def test_code_scan_finds_planted_faults(spark):
    sound = [f"{HEAD}return df['close'].rolling({i}).mean()" for i in range(2, 40)]
    faults = {"negative_shift": ".shift(-{i})", "centred_window": ".rolling({i}, center=True).sum()", "reversed_slice": "[::-{i}]"}
    planted = {(f"{HEAD}return df['close']" + text.format(i=i)): rule for rule, text in faults.items() for i in range(2, 12)}
    df = spark.createDataFrame([(x,) for x in [*sound, *planted, None]], "source string")
    got = {r.source: r.findings for r in scan(df, "source").collect()}
    assert all(got[s] == [] for s in sound) and all(got[s] == [rule] for s, rule in planted.items()) and got[None] == ["unparsable"]


def test_json_in_text():
    assert extract_json('so:\n```json\n{"a": 1}\n```') == {"a": 1} and extract_json('well {"a": [2]} then') == {"a": [2]} and extract_json("[1]") == [1]
    for bad in ("", None, "none", "{broken"):
        with pytest.raises(ValueError):
            extract_json(bad)


def test_daily_refit_uses_only_the_past(spark):
    rng = random.Random(1)
    names, shift, days, assets = ["f", "g"], 3, 14, 8
    data = {(n, d, a): rng.gauss(0, 1) for n in names for d in range(days) for a in range(assets)}
    y = {(d, a): 0.5 * data["f", d, a] + rng.gauss(0, 0.3) for d in range(days) for a in range(assets)}
    frame = lambda y: spark.createDataFrame([(n, "m", f"a{a}", D0 + timedelta(d), v, y[d, a]) for (n, d, a), v in data.items()], "factor string, market string, asset string, date date, value double, target double")
    run = lambda y: {(r.date, r.asset): r.score for r in dynamic_combination(frame(y), names, shift=shift).collect()}
    got = run(y)
    assert {k[0] for k in got} == {D0 + timedelta(d) for d in range(shift + 2, days)}
    z = {}
    for n in names:
        for d in range(days):
            v = np.array([data[n, d, a] for a in range(assets)])
            z[n, d] = (v - v.mean()) / v.std(ddof=1)
    rank = lambda v: np.argsort(np.argsort(v))
    for t in (shift + 2, days - 1):
        past = range(t - shift)
        ric = {n: [np.corrcoef(rank(z[n, d]), rank([y[d, a] for a in range(assets)]))[0, 1] for d in past] for n in names}
        ratio = {n: np.mean(ric[n]) / np.std(ric[n], ddof=1) for n in names}
        order = sorted(names, key=lambda n: -abs(ratio[n]))
        use = [n for n in order if np.mean(ric[n]) > 0.02 and ratio[n] > 0.2] or order[:1]
        x = np.column_stack([np.concatenate([z[n, d] for d in past]) for n in use] + [np.ones(len(past) * assets)])
        c = np.linalg.lstsq(x, np.concatenate([[y[d, a] for a in range(assets)] for d in past]), rcond=None)[0]
        want = np.column_stack([z[n, t] for n in use] + [np.ones(assets)]) @ c
        np.testing.assert_allclose([got[D0 + timedelta(t), f"a{a}"] for a in range(assets)], want, atol=1e-8)
    late = {k: (v if k[0] < days - shift - 1 else v * 9 + 1) for k, v in y.items()}
    changed = run(late)
    assert all(changed[k] == pytest.approx(v) for k, v in got.items())
