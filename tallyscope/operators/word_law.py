"""Rank-frequency (Zipf) tests for words and for vendor payments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.scores import correlation
from tallyscope.functions.text import words
from tallyscope.operators.ordered import down, scan
from tallyscope.session import reliable


def word_counts(df: DataFrame, keys: Sequence[str], text: str, min_length: int = 3, drop_stopwords: bool = False) -> DataFrame:
    """(keys, word, count) over whole texts."""
    tokens = df.select(*keys, F.explode(words(F.col(text), min_length, drop_stopwords)).alias("word"))
    return tokens.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("count"))


def ranked(counts: DataFrame, keys: Sequence[str], item: str, weight: str) -> DataFrame:
    """Rank by weight; equal weights in name order. Adds rank, items and frequency."""
    keys = list(keys)
    counts = reliable(counts)  # far smaller than the texts, and read by three steps
    out = scan(counts, keys, [down(F.col(weight)), F.col(item)], number="rank", total="items")
    totals = counts.groupBy(*keys).agg(F.sum(weight).alias("_all"))
    out = out.join(totals, keys) if keys else out.crossJoin(F.broadcast(totals))
    return out.withColumn("frequency", F.col(weight).cast("double") / F.col("_all").cast("double")).drop("_all")


def harmonic(n: Column, alpha: float = 1.0, exact: int = 64) -> Column:
    """1 + 1/2^alpha + ... + 1/n^alpha to double precision, from ``n`` alone (Euler-Maclaurin beyond ``exact`` terms)."""
    sums, total = [], 0.0
    for r in range(1, exact + 1):
        total += r**-alpha
        sums.append(total)
    x, m = n.cast("double"), float(exact)
    area = F.ln(x / m) if alpha == 1 else (F.pow(x, F.lit(1 - alpha)) - m ** (1 - alpha)) / (1 - alpha)

    def term(power: float, scale: float) -> Column:
        return (F.lit(m**-power) - F.pow(x, F.lit(-power))) * scale

    tail = area + (F.pow(x, F.lit(-alpha)) - m**-alpha) / 2 + term(alpha + 1, alpha / 12) - term(alpha + 3, alpha * (alpha + 1) * (alpha + 2) / 720)
    return F.when(n <= exact, F.element_at(F.array(*map(F.lit, sums)), F.least(n, F.lit(exact)).cast("int"))).otherwise(sums[-1] + tail)


def with_expected(ranks: DataFrame, keys: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """Expected share C / rank^alpha, with C from the harmonic sum over the group's ``items``."""
    raw = 1 / F.pow(F.col("rank").cast("double"), F.lit(alpha))
    return ranks.withColumn("expected", raw / harmonic(F.col("items"), alpha))


def _log_corr(head: Column, freq: str) -> Column:
    return correlation(F.when(head, F.ln(freq)), F.when(head, F.ln(1 / F.col("rank"))))


def zipf_test(table: DataFrame, keys: Sequence[str], weight: str = "count", top: int = 100, checked: int = 50) -> DataFrame:
    """Correlation of logs over the top items, largest gap, p-value, risk and odd items."""
    head = F.col("rank") <= top
    gap = F.abs(F.col("frequency") - F.col("expected"))
    out = table.groupBy(*keys).agg(
        F.sum(weight).alias("sample_size"),
        F.max("items").alias("items"),
        _log_corr(head, "frequency").alias("_r"),
        F.max(gap).alias("ks_statistic"),
        F.count_if((F.col("rank") <= checked) & (gap / F.col("expected") > 0.5)).alias("anomalous_items"),
    )
    out = out.withColumn("correlation", F.when(F.col("items") >= top, F.col("_r")).otherwise(0.0)).drop("_r")
    p = F.when(F.col("ks_statistic") > 0, 2 * F.exp(-2 * F.col("items") * F.pow("ks_statistic", F.lit(2.0)))).otherwise(1.0)
    return out.withColumn("p_value", p).withColumn(
        "risk_score", F.greatest(F.lit(0.0), 1 - F.abs("correlation"))
    )


def zipf_correlation(table: DataFrame, keys: Sequence[str], weight: str = "count", top: int = 100, least: int = 10) -> DataFrame:
    """Correlation of log count with log 1/rank over the top items; 0 below ``least`` items."""
    head = F.col("rank") <= top
    out = table.groupBy(*keys).agg(F.count_if(head).alias("items_used"), _log_corr(head, weight).alias("_r"))
    return out.withColumn(
        "correlation", F.when(F.col("items_used") < least, 0.0).otherwise(F.coalesce("_r", F.lit(0.0)))
    ).drop("_r")


def vendor_zipf(ledger: DataFrame, keys: Sequence[str], least: int = 20) -> DataFrame:
    """Zipf test of vendor payment totals for groups of at least ``least`` vendors."""
    keys = list(keys)
    totals = (
        ledger.where(F.col("vendor_name").isNotNull() & (F.col("vendor_name") != ""))
        .groupBy(*keys, "vendor_name")
        .agg(F.sum("amount").cast("double").alias("paid"))
    )
    table = with_expected(ranked(totals, keys, "vendor_name", "paid"), keys)
    out = zipf_test(table, keys, "paid")
    top = table.groupBy(*keys).agg(
        F.max("frequency").alias("top_share"), correlation(F.ln("frequency"), F.ln(1 / F.col("rank"))).alias("all_correlation")
    )
    out = out.join(top, keys) if keys else out.crossJoin(top)
    return out.where(F.col("items") >= least)
