"""Payment graph: node measures from edges, node filter, surviving edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_measures(edges: DataFrame) -> DataFrame:
    """Totals per endpoint from edges (source, target, amount, n, n_returned, flags).

    Risk is the share of returned payments; flags are the union of the edges' flags,
    whose number is that of the transaction types.
    """
    ends = F.explode(
        F.array(
            F.struct(F.col("source").alias("id"), F.lit("payer").alias("side")),
            F.struct(F.col("target").alias("id"), F.lit("payee").alias("side")),
        )
    )
    rows = edges.select(ends.alias("e"), "amount", "n", "n_returned", "flags")
    return rows.groupBy(F.col("e.id").alias("id"), F.col("e.side").alias("side")).agg(
        F.sum("amount").cast("double").alias("total_amount"),
        F.sum("n").alias("transaction_count"),
        (F.sum("n_returned") / F.sum("n")).alias("risk_score"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))), ",").alias("flags"),
    )


def filter_nodes(
    nodes: DataFrame, search: str = "", entity_types: Sequence[str] = (), min_risk: float = 0.0,
    min_amount: float = 0.0, max_amount: float = float("inf"),
) -> DataFrame:
    keep = F.contains(F.lower("entity_name"), F.lit(search.lower())) if search else F.lit(True)
    return nodes.where(
        keep
        & F.col("entity_type").isin(*entity_types)
        & (F.col("risk_score") >= min_risk)
        & F.col("total_amount").between(min_amount, max_amount)
    )


def surviving_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two endpoints are both among ``nodes``."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )
