"""Frequent substructures of a factor repository, and the streaming bars as a batch query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.expr import ExpressionError, read_expression, structures
from loomgrid.session import stage
from loomgrid.sources.tables import table
from loomgrid.streaming.bars import bars


def readings(zoo: DataFrame, expression: str) -> DataFrame:
    """Every distinct expression with its tree in one spelling, NULL where it cannot be read: ``expression, tree``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            trees = []
            for text in pdf["expression"]:
                try:
                    trees.append(str(read_expression(text)))
                except (ExpressionError, TypeError, RecursionError):
                    trees.append(None)
            yield pd.DataFrame({"expression": pdf["expression"], "tree": pd.Series(trees, dtype=object)})

    return zoo.select(F.col(expression).alias("expression")).distinct().mapInPandas(each, "expression string, tree string")


def gene_table(trees: DataFrame, tree: str) -> DataFrame:
    """One row per tree and distinct gene: ``expression, gene, size, inner`` (the genes inside it)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["e"]:
                rows += [(text, gene, size, sorted(inside)) for gene, (size, inside) in structures(read_expression(text)).items()]
            yield pd.DataFrame(rows, columns=["expression", "gene", "size", "inner"])

    return trees.select(F.col(tree).alias("e")).mapInPandas(each, "expression string, gene string, size int, inner array<string>")


def frequent_structures(zoo: DataFrame, expression: str, top: int = 10) -> DataFrame:
    """The most frequent closed genes: support is the share of expressions that have the gene; a gene is closed if no larger one around it is as frequent.

    Spellings of one tree are one expression. Unreadable texts count among the expressions; their number is in ``unreadable``.
    """
    read = stage(readings(zoo, expression), "readings")
    trees = read.where("tree IS NOT NULL").select("tree").distinct()
    rows = stage(gene_table(trees, "tree"), "genes")
    unread = read.where("tree IS NULL").count()
    n = trees.count() + unread
    support = rows.groupBy("gene", "size").agg(F.count(F.lit(1)).alias("c"))
    around = rows.select("gene", F.explode("inner").alias("part")).distinct().join(support.select("gene", "c"), "gene").select("part", F.col("c").alias("oc")).distinct()
    closed = support.join(around, (F.col("gene") == F.col("part")) & (F.col("c") == F.col("oc")), "left_anti")
    return closed.select("gene", "size", (F.col("c") / F.lit(n)).alias("support"), F.lit(unread).cast("bigint").alias("unreadable")).orderBy(F.desc("support"), F.desc("size"), "gene").limit(top)


def _zoo(spark: SparkSession, folder: str) -> DataFrame:
    factors = table(spark, folder, "mining_run").select(F.explode("factors").alias("f"))
    return factors.where("f.type = 'expression' AND f.expression IS NOT NULL").select("f.expression")


QUERIES = {
    "frequent_structures": lambda s, d: frequent_structures(_zoo(s, d), "expression"),
    "event_bars": lambda s, d: bars(table(s, d, "events")),
}
SQL = {
    "event_bars": "SELECT date_trunc('day', ts)::DATE AS date, event_type AS asset, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(value) AS volume FROM events GROUP BY ALL",
}
