"""Queries p1, p4, p5, p8, p9 and p10 over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.formatting import collapse, copies
from loomgrid.llm.leakage import leaks
from loomgrid.llm.packing import pack, token_counts
from loomgrid.llm.ranking import aggregate_ranking
from loomgrid.llm.spam import spam_pages
from loomgrid.llm.topn import top_n
from loomgrid.sources.tables import table

SCORES = ["rank_ic", "rank_icir", "mi"]
#: Tokens of a container in p8.
CAPACITY = 2048


def _formulas(spark: SparkSession, folder: str) -> DataFrame:
    factors = table(spark, folder, "mining_run").select(F.explode("factors").alias("f"))
    text = F.when(F.col("f.type") == "expression", F.col("f.expression")).when(F.col("f.type") == "code", F.col("f.source"))
    return factors.select(F.col("f.factor_id").alias("factor_id"), F.col("f.type").alias("type"), text.alias("text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = collapse(_formulas(spark, folder), "factor_id", "type", "text")
    return found.where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))


def p1_formulas(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct formula with its number of copies."""
    return copies(_formulas(spark, folder), "factor_id", "type", "text").select(F.col("first_id").alias("factor_id"), "n_copies")


def p4_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Scales differ by market, so ranks are taken within each market before they are aggregated into one order."""
    return aggregate_ranking(table(spark, folder, "fitness"), "candidate_id", SCORES, ["market"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    ok = table(spark, folder, "factor_audit").where("status = 'ok'").select("run", "factor_id").distinct()
    scored = table(spark, folder, "mining_run").select(F.explode("factors").alias("f")).select(F.col("f.factor_id").alias("factor_id"), F.try_element_at("f.train_metrics", F.lit("ic")).alias("ic"))
    scored = scored.where(F.col("ic").isNotNull() & ~F.isnan("ic")).distinct()
    return top_n(ok.join(scored, "factor_id"), "run", "factor_id", "ic", 10).select("run", "factor_id")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack(token_counts(table(spark, folder, "documents"), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam_pages(table(spark, folder, "documents"), "doc_id", "text").select("doc_id")


def p10_measured(spark: SparkSession, folder: str) -> DataFrame:
    return spam_pages(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p1_formulas": p1_formulas, "p4_ranking": p4_ranking, "p5_found": p5_found, "p8_containers": p8_containers, "p9_found": p9_found, "p10_found": p10_found, "p10_measured": p10_measured}


def _p4_sql() -> str:
    """Average ranks by market, then the beta order statistics with products in the same order as in the engine."""
    m = len(SCORES)
    dedup = f"SELECT DISTINCT candidate_id, market, {', '.join(f'CASE WHEN NOT isnan({c}) THEN {c} END AS {c}' for c in SCORES)} FROM fitness WHERE candidate_id IS NOT NULL"
    ranks = ", ".join(
        f"CASE WHEN {c} IS NULL THEN 1.0 ELSE ((count(*) FILTER ({c} IS NOT NULL) OVER (PARTITION BY market) - count({c}) OVER (PARTITION BY market ORDER BY {c} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) + (count(*) OVER (PARTITION BY market, {c}) + 1) / 2.0) / count(*) FILTER ({c} IS NOT NULL) OVER (PARTITION BY market) END AS r_{c}"
        for c in SCORES
    )
    terms = []
    for k in range(1, m + 1):
        x = f"s[{k}]"
        total = "0.0::DOUBLE"
        for j in range(k, m + 1):
            up, down = "1.0::DOUBLE" + f" * {x}" * j, "1.0::DOUBLE" + f" * (1.0 - {x})" * (m - j)
            total = f"({total} + {float(comb(m, j))}::DOUBLE * ({up}) * ({down}))"
        terms.append(total)
    return f"""WITH d AS ({dedup}), r AS (SELECT candidate_id, {ranks} FROM d),
  t AS (SELECT *, list_sort([{', '.join(f'r_{c}::DOUBLE' for c in SCORES)}]) AS s FROM r),
  g AS (SELECT candidate_id, {', '.join(f'r_{c}::DOUBLE AS r_{c}' for c in SCORES)}, least(least({', '.join(terms)}) * {m}, 1.0::DOUBLE) AS significance, ({' + '.join(f'r_{c}::DOUBLE' for c in SCORES)}) / {m} AS mean_rank FROM t)
SELECT row_number() OVER (ORDER BY significance, mean_rank, candidate_id) AS position, * FROM g"""


def _p9_sql() -> str:
    """All runs of thirteen words of both sides, joined as text."""
    runs = lambda t, k: f"SELECT DISTINCT {k}, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) AS g FROM (SELECT {k}, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)) AS w FROM {t} WHERE text IS NOT NULL AND {k} IS NOT NULL) WHERE len(w) >= 13"
    return f"WITH d AS ({runs('documents', 'doc_id')}), i AS ({runs('eval_items', 'item_id')}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)"


SQL = {
    "p9_found": _p9_sql(),
    "p4_ranking": _p4_sql(),
    "p5_found": """WITH ok AS (SELECT DISTINCT run, factor_id FROM factor_audit WHERE status = 'ok' AND run IS NOT NULL),
  f AS (SELECT DISTINCT x.factor_id, x.train_metrics['ic'] AS ic FROM (SELECT unnest(factors) AS x FROM mining_run)),
  s AS (SELECT factor_id, max(ic) AS ic FROM f WHERE ic IS NOT NULL AND NOT isnan(ic) GROUP BY factor_id),
  r AS (SELECT ok.run, ok.factor_id, row_number() OVER (PARTITION BY ok.run ORDER BY s.ic DESC, ok.factor_id) AS rn FROM ok JOIN s ON ok.factor_id = s.factor_id)
SELECT run, factor_id FROM r WHERE rn <= 10""",
}
