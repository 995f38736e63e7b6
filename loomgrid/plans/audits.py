"""Audit tables, mining contracts and candidate fitness: rollups, admission, funnel, floor, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.operators.ordering import quantiles, running_total, with_groups
from loomgrid.session import stage
from loomgrid.sources.contract import factor_rows
from loomgrid.sources.panel import current_bars
from loomgrid.sources.tables import table

SEGMENTS = ("train", "valid", "test")


def latest_audit(spark: SparkSession, folder: str) -> DataFrame:
    """One row per factor: its latest audit, exact repetitions merged."""
    rows = table(spark, folder, "factor_audit").dropDuplicates()
    cols = [c for c in rows.columns if c not in ("run", "factor_id", "audited_at")]
    best = F.max(F.struct("audited_at", F.col("status"), *[c for c in cols if c != "status"])).alias("b")
    return rows.groupBy("run", "factor_id").agg(best).select("run", "factor_id", "b.audited_at", *[f"b.{c}" for c in cols])


def audit_rollup(audit: DataFrame) -> DataFrame:
    """Per method: sizes, failures, unusable signals, medians."""
    audit = stage(audit.select("method", "status", "all_nan", "constant", "assets_unknown", "dates_unknown", "coverage", "seconds", *[f"frac_{s}_scorable" for s in SEGMENTS]), "audit")
    out = audit.groupBy("method").agg(
        F.count(F.lit(1)).alias("factors"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if("all_nan").alias("all_nan"),
        F.count_if("constant").alias("constant"),
        F.count_if((F.col("assets_unknown") > 0) | (F.col("dates_unknown") > 0)).alias("misaligned"),
    )
    halves = {"median_coverage": ("coverage", 0.5), **{f"med_{s}_scorable": (f"frac_{s}_scorable", 0.5) for s in SEGMENTS}, "sec_per_factor": ("seconds", 0.5)}
    out = with_groups(out, quantiles(audit, ["method"], halves), ["method"])
    return out.withColumn("fail_rate", F.col("failed") / F.col("factors")).withColumn("unusable", F.col("failed") + F.col("all_nan") + F.col("constant"))


def admitted(least: int = 100) -> Column:
    """Executed, and scorable on at least ``least`` dates of every segment."""
    out = F.col("status") == "ok"
    for s in SEGMENTS:
        out = out & (F.coalesce(F.col(f"{s}_scorable"), F.lit(0)) >= least)
    return out


def admission_rate(audit: DataFrame, least: int = 100) -> DataFrame:
    """Per method: factors, executed, admitted, those that never ranked anything, and the admitted percentage."""
    never = F.col("status") == "ok"
    for s in SEGMENTS:
        never = never & (F.col(f"{s}_scorable") == 0)
    out = audit.groupBy("method").agg(F.count(F.lit(1)).alias("factors"), F.count_if(F.col("status") == "ok").alias("executed"), F.count_if(admitted(least)).alias("admitted"), F.count_if(never).alias("constant"))
    return out.withColumn("admitted_pct", F.round(F.col("admitted") * 100.0 / F.col("factors"), 1))


def funnel(audit: DataFrame, least: int = 100) -> DataFrame:
    """Per method and in TOTAL: harvested, computing (no parse or execution error), admitted, admitted and stable on the test segment."""
    broken = (F.col("status") != "ok") & F.col("error_type").isin("FactorExecutionError", "SyntaxError", "IndentationError")
    rows = audit.select("method", (~broken).alias("computes"), admitted(least).alias("adm"), F.col("frac_test_scorable").alias("fr"))
    out = rows.rollup("method").agg(F.count(F.lit(1)).alias("harvested"), F.count_if("computes").alias("computes"), F.count_if("adm").alias("admitted"), F.count_if(F.col("adm") & (F.col("fr") >= 0.95)).alias("eligible"))
    return out.withColumn("kept_pct", F.round(F.col("admitted") * 100.0 / F.col("harvested"), 1)).withColumn("method", F.coalesce("method", F.lit("TOTAL")))


def floor_comparison(rows: DataFrame, floor: str, choose: str, judge: str) -> tuple[DataFrame, DataFrame]:
    """Each pool of a method, market and seed against as many of the floor's best by ``choose`` in the same market, judged by ``judge``.

    Returns the pools and their rollup by method. The floor's ranks are joined to pools by market with rank <= size.
    """
    usable = stage(rows.where(F.col(choose).isNotNull() & F.col(judge).isNotNull()), "usable")
    top = running_total(usable.where(F.col("method") == floor).select("market", "factor_id", choose, judge), ["market"], [F.desc(choose), F.col("factor_id")], None, "_before")
    top = top.select(F.col("market").alias("fm"), (F.col("_before") + 1).alias("rn"), F.col(judge).alias("fv"))
    of = ["method", "market", "seed"]
    rest = usable.where(F.col("method") != floor)
    pools = rest.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.max(judge).alias("best"), F.avg((F.col(judge) > 0).cast("double")).alias("frac_positive"), F.avg((F.abs(judge) > 2).cast("double")).alias("frac_above_2"))
    pools = with_groups(pools, quantiles(rest, of, {"median": (judge, 0.5)}), of)
    matched = pools.select(*of, "n").join(top, (F.col("market") == F.col("fm")) & (F.col("rn") <= F.col("n")))
    matched = with_groups(matched.groupBy(*of).agg(F.max("fv").alias("floor_best")), quantiles(matched, of, {"floor_median": ("fv", 0.5)}), of)
    pools = pools.join(matched, ["method", "market", "seed"]).withColumn("beats_floor", F.col("median") > F.col("floor_median"))
    half = lambda c: F.percentile(c, F.lit(0.5))  # noqa: E731  one value per pool
    rolled = pools.groupBy("method").agg(F.count(F.lit(1)).alias("pools"), half("n").alias("median_n"), half("median").alias("median_judged"), half("floor_median").alias("floor_median_judged"), F.avg(F.col("beats_floor").cast("double")).alias("beats_floor"), half("frac_above_2").alias("frac_above_2"))
    return pools, rolled


# Fixed value: how a factor's name states the run, the round and the rest.
ROUND = r"^(.+?_s\d+)_r(\d+)_(.+)$"


def dedup_rounds(factors: DataFrame, name: str, by: list[str], keep: str = "last", order: str | None = None) -> DataFrame:
    """Of factors whose names differ only in the round, the last (or first) one; names without a round all stay."""
    tagged = F.regexp_extract(name, ROUND, 2) != ""
    rank = F.regexp_extract(name, ROUND, 2).cast("int")
    then = [F.col(order)] if order else [F.col(name)]
    if keep == "last":
        w = Window.partitionBy(*by, F.regexp_extract(name, ROUND, 3)).orderBy(rank.desc(), *[c.desc() for c in then])
    else:
        w = Window.partitionBy(*by, F.regexp_extract(name, ROUND, 3)).orderBy(rank, *then)
    out = factors.where(tagged).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return out.unionByName(factors.where(~tagged))


def universe_key(bars: DataFrame) -> DataFrame:
    """A fingerprint of each market's assets and memberships that does not depend on row order; ``static`` where all are members."""
    member = F.coalesce("tradable", F.lit(False))
    word = F.conv(F.substring(F.md5(F.concat_ws("|", "asset", F.date_format("date", "yyyy-MM-dd"), member.cast("string"))), 1, 12), 16, 10).cast("decimal(38,0)")
    out = bars.groupBy("market").agg(F.sum(word).cast("decimal(38,0)").alias("k"), F.bool_and(member).alias("all"), F.countDistinct("asset").alias("assets"))
    return out.select("market", "assets", F.when(F.col("all"), F.lit("static")).otherwise(F.col("k").cast("string")).alias("universe_key"))


METRICS = ("ic", "icir", "rank_ic", "rank_icir", "mi")


# Published lower bounds for qualified and elite candidates by market (* for all others) and metric, and the
# percentiles of a generation that each metric must reach.
BOUNDS = """
    csi300 qualified ic 0.005
    csi300 qualified icir 0.05
    csi300 qualified rank_ic 0.005
    csi300 qualified rank_icir 0.05
    csi300 qualified mi 0.02
    csi300 elite ic 0.01
    csi300 elite icir 0.1
    csi300 elite rank_ic 0.01
    csi300 elite rank_icir 0.1
    csi300 elite mi 0.02
    * qualified ic 0.005
    * qualified icir 0.05
    * qualified rank_ic 0.005
    * qualified rank_icir 0.05
    * qualified mi 0.012
    * elite ic 0.01
    * elite icir 0.1
    * elite rank_ic 0.01
    * elite rank_icir 0.1
    * elite mi 0.012
"""
PERCENTILES = {"qualified": 0.65, "elite": 0.80}


def bounds_by_market(level: str) -> dict[str, dict[str, float]]:
    """The bounds of a level by metric, then by market."""
    out: dict[str, dict[str, float]] = {}
    for line in BOUNDS.split("\n"):
        if line.strip():
            market, named, metric, bound = line.split()
            if named == level:
                out.setdefault(metric, {})[market] = float(bound)
    return out


def classify_fitness(fitness: DataFrame, generation: list[str]) -> DataFrame:
    """Whether a candidate is qualified or elite: every metric at its generation's percentile and at its market's floor, and finite."""
    number = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in METRICS]
    rows = stage(fitness.dropDuplicates().select("candidate_id", "market", *[g for g in generation if g != "market"], *number), "candidates")
    both = with_groups(rows, quantiles(rows, generation, {f"_{c}_{level}": (c, q) for c in METRICS for level, q in PERCENTILES.items()}), generation)

    def passes(level: str) -> Column:
        out = F.lit(True)
        for metric, by_market in bounds_by_market(level).items():
            least = F.lit(by_market["*"])
            for market, bound in by_market.items():
                if market != "*":
                    least = F.when(F.col("market") == market, bound).otherwise(least)
            out = out & (F.col(metric) >= least) & (F.col(metric) >= F.col(f"_{metric}_{level}"))
        return F.coalesce(out, F.lit(False))

    both = both.withColumn("qualified", passes("qualified"))
    return both.select("candidate_id", *generation, "qualified", (F.col("qualified") & passes("elite")).alias("elite"))


def dimension_scores(fitness: DataFrame, zoo: list[str], temperature: float = 1.0) -> DataFrame:
    """Per candidate and dimension 1 - the share of its zoo strictly above it, and the softmax of the gaps to 1.

    What is above a value is counted once per distinct value in one global order, so a large zoo is spread over many tasks.
    """
    dims = {"effectiveness": "rank_ic", "stability": "rank_icir", "information": "mi"}
    rows = fitness.dropDuplicates(["candidate_id"])
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.when(~F.isnan(c), F.col(c) + 0.0).alias("v")) for d, c in dims.items()]))
    long = stage(rows.select("candidate_id", *zoo, cells.alias("_x")).select("candidate_id", *zoo, "_x.*"), "dimensions")
    counts = long.where("v IS NOT NULL").groupBy(*zoo, "d", "v").agg(F.count(F.lit(1)).alias("k"))
    counts = stage(running_total(counts, [*zoo, "d"], [F.desc("v")], "k", "above", "n").drop("k"), "above")
    scored = with_groups(long, counts.drop("n"), [*zoo, "d", "v"])
    scored = with_groups(scored, counts.groupBy(*zoo, "d").agg(F.max("n").alias("n")), [*zoo, "d"])
    score = 1 - F.when(F.col("n").isNull(), 0.5).when(F.col("v").isNull(), 1.0).otherwise(F.col("above") / F.col("n"))
    rows = scored.groupBy("candidate_id", *zoo).agg(*[F.max(F.when(F.col("d") == d, score)).alias(d) for d in dims])
    gaps = {d: (1 - F.col(d)) / temperature for d in dims}
    top = F.greatest(*gaps.values())
    weights = {d: F.exp(g - top) for d, g in gaps.items()}
    whole = sum(weights.values(), F.lit(0.0))
    return rows.select("candidate_id", *zoo, *dims, *[(w / whole).alias(f"p_{d}") for d, w in weights.items()])


# Gates of the effective check, in their order.
GATES = (("rank_ic", 0.015), ("rank_icir", 0.3), ("coverage", 0.5))


def effective_check(fitness: DataFrame, zoo: list[str], share: float = 0.95) -> DataFrame:
    """The first gate a candidate fails (empty: none): absolute floors in order, then at most ``share`` of the zoo above it by rank IC and its ratio."""
    rows = dimension_scores(fitness, zoo).select("candidate_id", F.col("effectiveness").alias("_e"), F.col("stability").alias("_s"))
    base = fitness.dropDuplicates(["candidate_id"]).join(rows, "candidate_id")
    reason = F.lit("")
    for name, score in (("rank_icir_pct", "_s"), ("rank_ic_pct", "_e")):
        reason = F.when(1 - F.col(score) > share, F.lit(name)).otherwise(reason)
    for name, least in reversed(GATES):
        v = F.when(~F.isnan(name), F.col(name))
        reason = F.when(v.isNull() | (v < least), F.lit(name)).otherwise(reason)
    return base.select("candidate_id", *zoo, reason.alias("failed_gate"))


def _r(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[(F.round(F.col(c) + 3.3e-12, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    rows = factor_rows(table(spark, folder, "mining_run"))
    pick = lambda k: F.expr(f"CASE WHEN NOT isnan(try_element_at(train_metrics, '{k}')) THEN try_element_at(train_metrics, '{k}') END")
    return rows.select("method", "market", "seed", "factor_id", pick("ic").alias("ic"), pick("icir").alias("icir"))


def contract_explode(spark: SparkSession, folder: str) -> DataFrame:
    rows = factor_rows(table(spark, folder, "mining_run"))
    return rows.select("run", "method", "market", "seed", "factor_id", "type", "name", "grammar", "language", F.length(F.coalesce("expression", "source")).alias("n_text"), F.expr("try_element_at(train_metrics, 'ic')").alias("ic"), F.to_date(F.element_at(F.element_at("split", "train"), 1)).alias("train_start"))


def _tagged(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "mining_run").select("run", "shard_no", F.explode("factors").alias("f"))
    head = F.regexp_extract(F.coalesce("f.expression", F.lit("")), r"^\W*([A-Za-z]+)", 1)
    name = F.when(head != "", F.concat_ws("_", F.col("run"), F.concat(F.lit("r"), F.col("shard_no")), F.lower(head))).otherwise(F.col("f.name"))
    return rows.select("run", "shard_no", F.col("f.factor_id").alias("factor_id"), name.alias("name")).distinct()


QUERIES = {
    "audit_latest": lambda s, d: latest_audit(s, d).select("run", "factor_id", "audited_at", "status", "n_obs", "coverage"),
    "audit_rollup": lambda s, d: _r(audit_rollup(latest_audit(s, d))),
    "audit_failures": lambda s, d: latest_audit(s, d).where("status = 'fail'").groupBy("method", "error_type").agg(F.count(F.lit(1)).alias("n"), F.min("error").alias("example")),
    "audit_worst_runs": lambda s, d: latest_audit(s, d).where("status = 'fail'").groupBy("method", "run").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "run").limit(15),
    "admission": lambda s, d: admission_rate(latest_audit(s, d)),
    "funnel": lambda s, d: funnel(latest_audit(s, d)),
    "floor_pools": lambda s, d: _r(floor_comparison(_scored(s, d), "gp", "ic", "icir")[0]),
    "floor_compare": lambda s, d: _r(floor_comparison(_scored(s, d), "gp", "ic", "icir")[1]),
    "contract_explode": contract_explode,
    "dedup_rounds": lambda s, d: dedup_rounds(_tagged(s, d), "name", ["run"], order="factor_id"),
    "universe_key": lambda s, d: universe_key(current_bars(s, d)),
    "fitness_classify": lambda s, d: classify_fitness(table(s, d, "fitness"), ["market", "run", "generation"]),
    "fitness_dimensions": lambda s, d: _r(dimension_scores(table(s, d, "fitness"), ["market"])),
    "effective_check": lambda s, d: effective_check(table(s, d, "fitness"), ["market"]),
}

_LATEST = """la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, factor_id ORDER BY audited_at DESC, status DESC) AS rn FROM (SELECT DISTINCT * FROM factor_audit)) WHERE rn = 1)"""
_ADM = "(status = 'ok' AND " + " AND ".join(f"coalesce({s}_scorable, 0) >= 100" for s in SEGMENTS) + ")"
_ROWS = "cr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, shard_no ORDER BY delivered_at DESC) AS rn FROM mining_run) WHERE rn = 1), fr AS (SELECT DISTINCT ON (run, f.factor_id) run, method, market, seed, split, f.* FROM (SELECT run, method, market, seed, split, shard_no, unnest(factors) AS f FROM cr) ORDER BY run, f.factor_id, shard_no)"
_SC = f"WITH {_ROWS}, u AS (SELECT method, market, seed, factor_id, CASE WHEN NOT isnan(train_metrics['ic']) THEN train_metrics['ic'] END AS ic, CASE WHEN NOT isnan(train_metrics['icir']) THEN train_metrics['icir'] END AS icir FROM fr), us AS (SELECT * FROM u WHERE ic IS NOT NULL AND icir IS NOT NULL), tp AS (SELECT market, icir AS fv, row_number() OVER (PARTITION BY market ORDER BY ic DESC, factor_id) AS rn FROM us WHERE method = 'gp'), po AS (SELECT method, market, seed, count(*) AS n, median(icir) AS md, max(icir) AS best, avg((icir > 0)::INT) AS frac_positive, avg((abs(icir) > 2)::INT) AS frac_above_2 FROM us WHERE method <> 'gp' GROUP BY ALL), ma AS (SELECT p.method, p.market, p.seed, median(fv) AS floor_median, max(fv) AS floor_best FROM po p JOIN tp t ON p.market = t.market AND t.rn <= p.n GROUP BY ALL), pl AS (SELECT method, market, seed, n, md, best, frac_positive, frac_above_2, floor_median, floor_best, md > floor_median AS beats_floor FROM po JOIN ma USING (method, market, seed))"
_o = lambda c: f"round({c} + 3.3e-12, 8) + 0.0"
_FIT = "fit AS (SELECT DISTINCT candidate_id, run, market, generation, coverage, " + ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in METRICS) + " FROM fitness)"


def _class_sql() -> str:
    cuts = ", ".join(f"quantile_cont({c}, {q}) AS {c}_{level}" for c in METRICS for level, q in PERCENTILES.items())

    def passes(level: str) -> str:
        return "coalesce(" + " AND ".join(f"{c} >= CASE WHEN market = 'csi300' THEN {b['csi300']} ELSE {b['*']} END AND {c} >= {c}_{level}" for c, b in bounds_by_market(level).items()) + ", false)"

    return f"WITH {_FIT}, cu AS (SELECT market, run, generation, {cuts} FROM fit GROUP BY ALL), b AS (SELECT fit.*, cu.* EXCLUDE (market, run, generation) FROM fit JOIN cu ON fit.market IS NOT DISTINCT FROM cu.market AND fit.run IS NOT DISTINCT FROM cu.run AND fit.generation IS NOT DISTINCT FROM cu.generation) SELECT candidate_id, market, run, generation, {passes('qualified')} AS qualified, {passes('qualified')} AND {passes('elite')} AS elite FROM b"


_DIMS = {"effectiveness": "rank_ic", "stability": "rank_icir", "information": "mi"}
_DIM_SQL = f"{_FIT}, dm AS (SELECT candidate_id, market, rank_ic, rank_icir, coverage, " + ", ".join(f"1 - CASE WHEN count({c}) OVER (PARTITION BY market) = 0 THEN 0.5 WHEN {c} IS NULL THEN 1.0 ELSE (rank() OVER (PARTITION BY market ORDER BY {c} DESC NULLS LAST) - 1)::DOUBLE / count({c}) OVER (PARTITION BY market) END AS {d}" for d, c in _DIMS.items()) + " FROM fit)"
_TOP = "greatest(" + ", ".join(f"1 - {d}" for d in _DIMS) + ")"
_SUM = " + ".join(f"exp(1 - {d} - {_TOP})" for d in _DIMS)
SQL = {
    "audit_latest": f"WITH {_LATEST} SELECT run, factor_id, audited_at, status, n_obs, coverage FROM la",
    "audit_rollup": f"WITH {_LATEST} SELECT method, count(*) AS factors, count_if(status = 'fail') AS failed, count_if(all_nan) AS all_nan, count_if(constant) AS constant, count_if(assets_unknown > 0 OR dates_unknown > 0) AS misaligned, {_o('median(coverage)')} AS median_coverage, " + ", ".join(f"{_o(f'median(frac_{s}_scorable)')} AS med_{s}_scorable" for s in SEGMENTS) + f", {_o('median(seconds)')} AS sec_per_factor, {_o('failed / factors')} AS fail_rate, count_if(status = 'fail') + count_if(all_nan) + count_if(constant) AS unusable FROM la GROUP BY method",
    "audit_failures": f"WITH {_LATEST} SELECT method, error_type, count(*) AS n, min(error) AS example FROM la WHERE status = 'fail' GROUP BY ALL",
    "audit_worst_runs": f"WITH {_LATEST} SELECT method, run, count(*) AS n FROM la WHERE status = 'fail' GROUP BY ALL ORDER BY n DESC, run LIMIT 15",
    "admission": f"WITH {_LATEST} SELECT method, count(*) AS factors, count_if(status = 'ok') AS executed, count_if({_ADM}) AS admitted, count_if(status = 'ok' AND train_scorable = 0 AND valid_scorable = 0 AND test_scorable = 0) AS constant, round(count_if({_ADM}) * 100.0::DOUBLE / count(*), 1) AS admitted_pct FROM la GROUP BY method",
    "funnel": f"WITH {_LATEST} SELECT coalesce(method, 'TOTAL') AS method, count(*) AS harvested, count_if(NOT (status <> 'ok' AND error_type IN ('FactorExecutionError', 'SyntaxError', 'IndentationError'))) AS computes, count_if({_ADM}) AS admitted, count_if({_ADM} AND frac_test_scorable >= 0.95) AS eligible, round(count_if({_ADM}) * 100.0::DOUBLE / count(*), 1) AS kept_pct FROM la GROUP BY ROLLUP (method)",
    "floor_pools": f"{_SC} SELECT method, market, seed, n, {_o('md')} AS median, {_o('best')} AS best, {_o('frac_positive')} AS frac_positive, {_o('frac_above_2')} AS frac_above_2, {_o('floor_median')} AS floor_median, {_o('floor_best')} AS floor_best, beats_floor FROM pl",
    "floor_compare": f"{_SC} SELECT method, count(*) AS pools, {_o('median(n)')} AS median_n, {_o('median(md)')} AS median_judged, {_o('median(floor_median)')} AS floor_median_judged, {_o('avg(beats_floor::INT)')} AS beats_floor, {_o('median(frac_above_2)')} AS frac_above_2 FROM pl GROUP BY method",
    "contract_explode": f"WITH {_ROWS} SELECT run, method, market, seed, factor_id, type, name, grammar, language, length(coalesce(expression, source)) AS n_text, train_metrics['ic'] AS ic, split['train'][1]::DATE AS train_start FROM fr",
    "dedup_rounds": """WITH t AS (SELECT DISTINCT run, shard_no, f.factor_id AS factor_id, CASE WHEN regexp_extract(coalesce(f.expression, ''), '^\\W*([A-Za-z]+)', 1) <> '' THEN concat_ws('_', run, 'r' || shard_no, lower(regexp_extract(coalesce(f.expression, ''), '^\\W*([A-Za-z]+)', 1))) ELSE f.name END AS name FROM (SELECT run, shard_no, unnest(factors) AS f FROM mining_run)),
  x AS (SELECT *, regexp_extract(name, '^(.+?_s\\d+)_r(\\d+)_(.+)$', 2) AS rd, regexp_extract(name, '^(.+?_s\\d+)_r(\\d+)_(.+)$', 3) AS st FROM t),
  y AS (SELECT *, row_number() OVER (PARTITION BY run, st ORDER BY try_cast(rd AS INT) DESC, factor_id DESC) AS rn FROM x WHERE rd <> '')
SELECT run, shard_no, factor_id, name FROM y WHERE rn = 1 UNION ALL SELECT run, shard_no, factor_id, name FROM x WHERE rd = ''""",
    "universe_key": "WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, asset, date ORDER BY loaded_at DESC, row_id) AS rn FROM download_all WHERE asset IS NOT NULL AND date IS NOT NULL) WHERE rn = 1) SELECT market, count(DISTINCT asset) AS assets, CASE WHEN bool_and(coalesce(tradable, false)) THEN 'static' ELSE sum(('0x' || substr(md5(asset || '|' || strftime(date, '%Y-%m-%d') || '|' || CASE WHEN coalesce(tradable, false) THEN 'true' ELSE 'false' END), 1, 12))::BIGINT)::VARCHAR END AS universe_key FROM cur GROUP BY market",
    "fitness_classify": _class_sql(),
    "fitness_dimensions": f"WITH {_DIM_SQL} SELECT candidate_id, market, " + ", ".join(f"{_o(d)} AS {d}, {_o(f'exp(1 - {d} - {_TOP}) / ({_SUM})')} AS p_{d}" for d in _DIMS) + " FROM dm",
    "effective_check": f"WITH {_DIM_SQL} SELECT candidate_id, market, CASE WHEN rank_ic IS NULL OR rank_ic < 0.015 THEN 'rank_ic' WHEN rank_icir IS NULL OR rank_icir < 0.3 THEN 'rank_icir' WHEN coverage IS NULL OR coverage < 0.5 THEN 'coverage' WHEN 1 - effectiveness > 0.95 THEN 'rank_ic_pct' WHEN 1 - stability > 0.95 THEN 'rank_icir_pct' ELSE '' END AS failed_gate FROM dm",
}
