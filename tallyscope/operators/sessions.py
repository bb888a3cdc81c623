"""Session-level ledger queries: selections, summaries, vendor patterns, pages, histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.constants import WORKFLOW_STEPS
from tallyscope.functions.digits import text_digit
from tallyscope.operators.ordered import Down, ntile, ranked_between, scan, top_n


def transactions(ledger: DataFrame, session: str | None = None, minimum: float | None = None) -> DataFrame:
    """Transactions of a session with ``amount >= minimum`` (0 is a real bound), largest first."""
    out = ledger
    if session is not None:
        out = out.where(F.col("session_id") == session)
    if minimum is not None:
        out = out.where(F.col("amount") >= minimum)
    return out.orderBy(F.col("amount").desc(), "txn_id")


def transaction_stats(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    total, n = F.sum("amount").cast("double"), F.count(F.lit(1))
    return ledger.groupBy(*keys).agg(
        n.alias("total_transactions"),
        total.alias("total_amount"),
        (total / n).alias("avg_amount"),
        F.min("amount").cast("double").alias("min_amount"),
        F.max("amount").cast("double").alias("max_amount"),
    )


def finding_stats(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_findings"),
        F.count_if(F.col("severity") == "high").alias("high_severity"),
        F.count_if(F.col("severity") == "critical").alias("critical_findings"),
        F.count_if(F.col("status") == "resolved").alias("resolved_findings"),
    )


def document_stats(documents: DataFrame, contents: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Document counts of the documents a session's transactions refer to, per session.

    The distinct (session, document) pairs are the semi-join side; content joins by document.
    """
    used = ledger.select(*keys, "document_id").distinct()
    docs = documents.select("document_id", "processing_status", "confidence_score").join(
        contents.select("document_id"), "document_id"
    )
    return docs.join(used, "document_id").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if(F.col("processing_status") == "completed").alias("processed_docs"),
        F.avg("confidence_score").alias("avg_confidence"),
    )


def vendor_patterns(ledger: DataFrame, keys: Sequence[str], least: int = 3) -> DataFrame:
    """Payment pattern of vendors with at least ``least`` transactions, largest total first."""
    total, n = F.sum("amount").cast("double"), F.count(F.lit(1))
    out = (
        ledger.where(F.col("vendor_name").isNotNull() & (F.col("vendor_name") != ""))
        .groupBy(*keys, "vendor_name")
        .agg(
            n.alias("transaction_count"),
            total.alias("total_amount"),
            (total / n).alias("avg_amount"),
            F.stddev_samp(F.col("amount").cast("double")).alias("amount_std_dev"),
            F.min("transaction_date").alias("first_transaction"),
            F.max("transaction_date").alias("last_transaction"),
        )
    )
    return out.where(F.col("transaction_count") >= least).orderBy(F.col("total_amount").desc(), *keys, "vendor_name")


def digit_frequencies(ledger: DataFrame, keys: Sequence[str], least: float = 10) -> DataFrame:
    """First text digit with frequency per (digit, amount), amounts of at least ``least``."""
    rows = ledger.where(F.col("amount") >= least)
    return rows.groupBy(*keys, text_digit(F.col("amount")).alias("first_digit"), "amount").agg(
        F.count(F.lit(1)).alias("frequency")
    )


def amount_distribution(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Decile by amount and rank by amount descending, positive amounts.

    Sessions may hold a third of all rows, so the ranks come from the range-cut scan.
    """
    rows = ledger.where(F.col("amount") > 0)
    up = scan(rows, keys, [F.col("amount"), F.col("txn_id")], number="_up", total="_n")
    # rank descending is the mirror of the ascending number under a total order
    return up.withColumn("decile", ntile(F.col("_up"), F.col("_n"), 10)).withColumn(
        "rank", F.col("_n") - F.col("_up") + 1
    ).drop("_up", "_n")


def visible_sessions(sessions: DataFrame, user: Column, role: Column) -> DataFrame:
    """Sessions the user created, audits, or may see as an admin; latest access first."""
    seen = (F.col("created_by") == user) | (F.col("auditor_id") == user) | (role == "admin")
    return sessions.where(seen).orderBy(F.col("last_accessed").desc(), "session_id")


def portfolio_counts(sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = sessions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_audits"),
        F.count_if(F.col("status") == "in_progress").alias("active_audits"),
        F.count_if(F.col("status") == "completed").alias("completed_audits"),
        F.count_if(F.col("status") == "failed").alias("failed_audits"),
    )
    rate = F.coalesce(F.try_divide(F.col("completed_audits") * 100.0, F.col("total_audits")), F.lit(0.0))
    return out.withColumn("success_rate", rate)


def page(df: DataFrame, order: Sequence[Column | Down], number: int, per_page: int) -> DataFrame:
    """One numbered page with the paging columns; a page of any depth sorts only the buckets that hold its ranks."""
    ranked = ranked_between(df, order, (number - 1) * per_page, number * per_page)
    pages = F.ceil(F.col("total") / per_page).cast("bigint")
    return (
        ranked.withColumn("page", F.lit(number))
        .withColumn("pages", pages)
        .withColumn("has_next", F.col("page") < F.col("pages"))
        .withColumn("has_prev", F.lit(number > 1))
    )


def next_page(df: DataFrame, key: str, after, per_page: int) -> DataFrame:
    """Keyset paging: the cheap form for deep pages."""
    rows = df if after is None else df.where(F.col(key) < after)
    return rows.orderBy(F.col(key).desc()).limit(per_page)


def history(entries: DataFrame, keys: Sequence[str], time: str, key: str, n: int = 10) -> DataFrame:
    """Newest ``n`` entries per thread."""
    return top_n(entries, keys, [F.col(time).desc(), F.col(key).desc()], n)


def progress(steps: DataFrame, keys: Sequence[str], step: str, time: str) -> DataFrame:
    """Latest step and progress (distinct steps / 9) per session."""
    known = F.when(F.col(step).isin(WORKFLOW_STEPS), F.col(step))
    return steps.groupBy(*keys).agg(
        F.max_by(step, time).alias("current_step"),
        F.size(F.collect_set(known)).alias("steps_completed"),  # nine steps at most
        (F.size(F.collect_set(known)) / F.lit(float(len(WORKFLOW_STEPS))) * 100).alias("progress_percentage"),
    )


def health(activity: DataFrame, keys: Sequence[str], session: str, seconds: str, failed: Column) -> DataFrame:
    return activity.groupBy(*keys).agg(
        F.count_distinct(session).alias("active_sessions"),
        F.count(F.lit(1)).alias("total_documents_processed"),
        F.avg(seconds).alias("average_processing_time"),
        (F.count_if(failed) / F.count(F.lit(1))).alias("error_rate"),
    )
