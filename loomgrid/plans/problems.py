"""Queries p2, p3, p6 and p7 over the test tables, with their SQL."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators.anomalies import implausible
from loomgrid.operators.bitemporal import as_known
from loomgrid.operators.history import version_history
from loomgrid.operators.rolling import trailing_totals
from loomgrid.sources.tables import table

ENTITY = ["market", "asset"]


def _latest() -> list:
    return [F.col("loaded_at"), F.bitwise_not(F.col("row_id"))]


def p2_rolling(spark: SparkSession, folder: str) -> DataFrame:
    return trailing_totals(table(spark, folder, "download_all"), ENTITY, "date", ["close", "volume", "adv"], _latest(), (7, 30))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    versions = table(spark, folder, "download_all").withColumn("version_row", F.col("row_id"))
    known = as_known(table(spark, folder, "signals").select("signal_id", "market", "asset", "signal_at"), versions, ENTITY, "signal_at", "date", "loaded_at", "row_id", ["version_row"])
    return known.select("signal_id", F.col("version_row").alias("row_id"))


def p3_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Every signal with the attributes known by its time; those without any keep nulls."""
    signals = table(spark, folder, "signals")
    known = as_known(signals.select("signal_id", *ENTITY, "signal_at"), table(spark, folder, "download_all"), ENTITY, "signal_at", "date", "loaded_at", "row_id", ["date", "tradable", "market_cap", "forward_return_20d"])
    wanted = known.select("signal_id", F.col("date").alias("known_date"), "tradable", "market_cap", "forward_return_20d")
    return signals.select("signal_id", "factor_id", *ENTITY, "signal_at", "value").join(wanted, "signal_id", "left")


def p3_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """What was known by each signal's time about its asset's state of four weeks before."""
    signals = table(spark, folder, "signals").select("signal_id", *ENTITY, "signal_at", F.date_sub(F.to_date("signal_at"), 28).alias("day"))
    versions = table(spark, folder, "download_all").withColumnRenamed("date", "known_date").withColumnRenamed("row_id", "version_row")
    known = as_known(signals, versions, ENTITY, "signal_at", "known_date", "loaded_at", "version_row", ["version_row", "known_date", "close"], valid_at="day")
    return known.select("signal_id", "day", "version_row", "known_date", "close")


def p6_flags(spark: SparkSession, folder: str) -> DataFrame:
    price, volume = [F.col(c) for c in ("close", "high", "low")], F.col("volume")
    tests = [*(p <= 0 for p in price), volume < 0, F.col("low") > F.col("high"), F.col("close") < F.col("low"), F.col("close") > F.col("high")]
    bad = reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests])
    return implausible(table(spark, folder, "download_all"), ENTITY, "date", "row_id", _latest(), bad)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_flags(spark, folder).select("row_id")


def _membership() -> dict:
    return {"tradable": F.coalesce(F.col("tradable"), F.lit(False)), "yahoo_symbol": F.upper(F.regexp_replace(F.coalesce(F.col("yahoo_symbol"), F.lit("")), r"^\s+|\s+$", ""))}


def p7_versions(spark: SparkSession, folder: str) -> DataFrame:
    return version_history(table(spark, folder, "membership_snapshots"), ENTITY, "snapshot_date", [F.col("received_at"), F.bitwise_not(F.col("snapshot_id"))], _membership())


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_versions(spark, folder).select(*ENTITY, F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.coalesce(F.date_format("valid_to", "yyyy-MM-dd"), F.lit("")).alias("valid_to"))


QUERIES = {"p2_rolling": p2_rolling, "p3_found": p3_found, "p3_attributes": p3_attributes, "p3_as_of": p3_as_of, "p6_found": p6_found, "p6_flags": p6_flags, "p7_found": p7_found, "p7_versions": p7_versions}

_CURRENT = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, asset, date ORDER BY loaded_at DESC, row_id) AS rn FROM download_all) WHERE rn = 1"
_P3 = """SELECT s.signal_id, d.row_id, d.date, d.tradable, d.market_cap, d.forward_return_20d,
  row_number() OVER (PARTITION BY s.signal_id ORDER BY d.date DESC, d.loaded_at DESC, d.row_id) AS rn
FROM signals s JOIN download_all d ON s.market = d.market AND s.asset = d.asset AND d.loaded_at <= s.signal_at"""
_P7 = """WITH one AS (SELECT market, asset, snapshot_date, coalesce(tradable, false) AS tradable, upper(regexp_replace(coalesce(yahoo_symbol, ''), '^\\s+|\\s+$', '', 'g')) AS yahoo_symbol,
    row_number() OVER (PARTITION BY market, asset, snapshot_date ORDER BY received_at DESC, snapshot_id) AS rn FROM membership_snapshots),
  seq AS (SELECT *, lag(tradable) OVER w AS pt, lag(yahoo_symbol) OVER w AS ps FROM one WHERE rn = 1 WINDOW w AS (PARTITION BY market, asset ORDER BY snapshot_date)),
  ver AS (SELECT market, asset, tradable, yahoo_symbol, snapshot_date AS valid_from, lead(snapshot_date) OVER (PARTITION BY market, asset ORDER BY snapshot_date) - 1 AS valid_to
    FROM seq WHERE pt IS NULL OR pt <> tradable OR ps <> yahoo_symbol)"""


def _p2_sql() -> str:
    out, parts = [], []
    for v in ("close", "volume", "adv"):
        for w in (7, 30):
            parts.append(f"sum(coalesce({v}, 0)) OVER w{w} AS {v}_s{w}, count({v}) OVER w{w} AS {v}_n_{w}")
            out.append(f"round({v}_s{w}, 4) AS {v}_sum_{w}, {v}_n_{w}, CASE WHEN {v}_n_{w} > 0 THEN round({v}_s{w}, 4) / {v}_n_{w} END AS {v}_avg_{w}")
    return f"""WITH cur AS ({_CURRENT}),
  cal AS (SELECT market, asset, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM cur GROUP BY market, asset),
  d AS (SELECT cal.market, cal.asset, cal.date, CASE WHEN NOT isnan(close) THEN close END AS close, CASE WHEN NOT isnan(volume) THEN volume END AS volume, CASE WHEN NOT isnan(adv) THEN adv END AS adv
    FROM cal LEFT JOIN cur ON cal.market = cur.market AND cal.asset = cur.asset AND cal.date = cur.date),
  t AS (SELECT market, asset, date, {", ".join(parts)} FROM d
    WINDOW w7 AS (PARTITION BY market, asset ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY market, asset ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT market, asset, date, {", ".join(out)} FROM t"""


def _p6_sql() -> str:
    series = ("close", "high", "low", "volume")
    logs = ", ".join(f"CASE WHEN {s} > 0 THEN ln({s}) END AS l_{s}" for s in series)
    near = ", ".join(f"{f}(l_{s}, {i} IGNORE NULLS) OVER w AS {a}{i}_{s}" for s in series for f, a in (("lag", "p"), ("lead", "n")) for i in (1, 2, 3))
    same = ", ".join(f"CASE WHEN {s} = lag({s}) OVER w THEN 0 ELSE 1 END AS ch_{s}" for s in ("close", "volume"))
    rates = ", ".join(f"median(abs(l_{s} - p1_{s})) AS r_{s}" for s in series[:3])

    def out(v: str, p: str, n: str, far: str) -> str:
        return f"(abs({v} - {p}) > {far} AND abs({v} - {n}) > {far} AND sign({v} - {p}) = sign({v} - {n}) AND abs({p} - {n}) < 0.5 * least(abs({v} - {p}), abs({v} - {n})))"

    def mid(a: str, s: str, x: str) -> str:
        one, two, three = f"{a}1_{s}", f"{a}2_{s}", f"{a}3_{s}"
        return f"(CASE WHEN {three} IS NOT NULL THEN greatest(least({one}, {two}), least(greatest({one}, {two}), {three})) WHEN abs({x} - {two}) > abs({x} - {one}) THEN {two} ELSE {one} END)"

    tests = []
    for s in series:
        x = f"(CASE WHEN d.{s} > 0 THEN ln(d.{s}) END)"
        far = f"15 * r_{s}" if s != "volume" else "5 * mad"
        p1, p2, n1, n2 = f"p1_{s}", f"p2_{s}", f"n1_{s}", f"n2_{s}"
        run = f"({out(x, p1, n1, far)} OR ({out(x, p1, n2, far)} AND {out(n1, p1, n2, far)} AND sign({x} - {p1}) = sign({n1} - {p1})) OR ({out(x, p2, n1, far)} AND {out(p1, p2, n1, far)} AND sign({x} - {n1}) = sign({p1} - {n1})))"
        level = f"(abs({x} - {mid('p', s, x)}) > {far} AND abs({x} - {mid('n', s, x)}) > {far} AND sign({x} - {mid('p', s, x)}) = sign({x} - {mid('n', s, x)}))"
        own = f" AND abs({x} - med) > 10 * mad AND mad > 0" if s == "volume" else f" AND r_{s} > 0"
        tests.append(f"coalesce({run} AND {level}{own}, false)")
    return f"""WITH cur AS ({_CURRENT}),
  a AS (SELECT market, asset, date, close, high, low, volume, {logs} FROM cur),
  b AS (SELECT *, {near}, {same} FROM a WINDOW w AS (PARTITION BY market, asset ORDER BY date)),
  c AS (SELECT *, sum(ch_close) OVER w AS g_close, sum(ch_volume) OVER w AS g_volume FROM b WINDOW w AS (PARTITION BY market, asset ORDER BY date)),
  e AS (SELECT *, count(*) OVER (PARTITION BY market, asset, g_close) AS k_close, count(*) OVER (PARTITION BY market, asset, g_volume) AS k_volume FROM c),
  m AS (SELECT market, asset, {rates}, median(l_volume) AS med FROM e GROUP BY market, asset),
  v AS (SELECT m.market, m.asset, median(abs(l_volume - med)) AS mad FROM e JOIN m USING (market, asset) GROUP BY m.market, m.asset),
  j AS (SELECT d.row_id,
      coalesce(d.close <= 0, false) OR coalesce(d.high <= 0, false) OR coalesce(d.low <= 0, false) OR coalesce(d.volume < 0, false) OR coalesce(d.low > d.high, false) OR coalesce(d.close < d.low, false) OR coalesce(d.close > d.high, false) AS impossible,
      coalesce(k_close >= 8 AND e.close IS NOT NULL AND d.close = e.close, false) OR coalesce(k_volume >= 8 AND e.volume IS NOT NULL AND d.volume = e.volume, false) AS frozen,
      {" OR ".join(tests)} AS spike
    FROM download_all d JOIN e ON d.market = e.market AND d.asset = e.asset AND d.date = e.date JOIN m ON d.market = m.market AND d.asset = m.asset JOIN v ON d.market = v.market AND d.asset = v.asset)
"""


SQL = {
    "p2_rolling": _p2_sql(),
    "p3_found": f"SELECT signal_id, row_id FROM ({_P3}) WHERE rn = 1",
    "p3_attributes": f"SELECT s.signal_id, s.factor_id, s.market, s.asset, s.signal_at, s.value, k.date AS known_date, k.tradable, k.market_cap, k.forward_return_20d FROM signals s LEFT JOIN (SELECT * FROM ({_P3}) WHERE rn = 1) k ON s.signal_id = k.signal_id",
    "p3_as_of": """SELECT signal_id, day, row_id AS version_row, date AS known_date, close FROM (SELECT s.signal_id, s.signal_at::DATE - 28 AS day, d.row_id, d.date, d.close,
    row_number() OVER (PARTITION BY s.signal_id ORDER BY d.date DESC, d.loaded_at DESC, d.row_id) AS rn
  FROM signals s JOIN download_all d ON s.market = d.market AND s.asset = d.asset AND d.loaded_at <= s.signal_at AND d.date <= s.signal_at::DATE - 28) WHERE rn = 1""",
    "p6_found": _p6_sql() + "SELECT row_id FROM j WHERE impossible OR frozen OR spike",
    "p6_flags": _p6_sql() + "SELECT row_id, impossible, frozen, spike FROM j WHERE impossible OR frozen OR spike",
    "p7_found": _P7 + " SELECT market, asset, strftime(valid_from, '%Y-%m-%d') AS valid_from, coalesce(strftime(valid_to, '%Y-%m-%d'), '') AS valid_to FROM ver",
    "p7_versions": _P7 + " SELECT market, asset, tradable, yahoo_symbol, valid_from, valid_to FROM ver",
}
