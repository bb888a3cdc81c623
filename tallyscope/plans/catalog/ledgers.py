"""Ledger queries: tables, selections, session summaries, vendors, ranks, pages, graph, fraud panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.operators import fraud, graph, ordered, sessions as ops
from tallyscope.operators.features import amount_frequency, account_map, frequency, hashed_sample, running_balance
from tallyscope.plans import views as v
from tallyscope.plans.registry import query
from tallyscope.session import scratch_path
from tallyscope.sources import contracts, files, tables


def r(col, n=6):
    return F.round(F.col(col) if isinstance(col, str) else col, n)


def day(col):
    return F.col(col).cast("string").alias(col)


@query(
    "s1_table_integrity",
    """
    SELECT 'duplicate_line_keys' AS check_name, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'duplicate_document_ids', count(*) FROM (SELECT 1 FROM documents GROUP BY doc_id HAVING count(*) > 1)
    UNION ALL SELECT 'transactions_without_document', count(*) FROM ledger WHERE document_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'labels_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    """,
    ["ledger"],
)
def s1(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id")
    lines = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    parts = {
        "duplicate_line_keys": tables.duplicate_keys(lines, ["l_orderkey", "l_linenumber"]),
        "duplicate_document_ids": tables.duplicate_keys(docs, ["doc_id"]),
        "transactions_without_document": tables.orphans(v.ledger(spark, d, "document_id"), docs, "document_id", "doc_id"),
        "labels_without_document": tables.orphans(v.table(spark, d, "labels"), docs, "doc_id", "doc_id"),
    }
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "s2_append_transactions",
    """
    SELECT 'USD' AS currency, false AS extracted_from_table, '{}' AS anomaly_flags, session_id AS audit_session_id,
           count(*) AS n, round(CAST(sum(amount) AS DOUBLE), 2) AS total
    FROM ledger GROUP BY session_id
    """,
    ["ledger"],
)
def s2(spark, d):
    rows = v.ledger(spark, d, "txn_id", "session_id", "document_id", "transaction_date", "description", "amount",
                    "account_code", "transaction_type", "vendor_name")
    rows = rows.withColumnsRenamed({"txn_id": "id", "session_id": "audit_session_id"})
    path = scratch_path(spark, "transactions")
    tables.append(rows, "transactions", path)
    return tables.read(spark, "transactions", path).groupBy(
        "currency", "extracted_from_table", "anomaly_flags", "audit_session_id"
    ).agg(F.count(F.lit(1)).alias("n"), r(F.sum("amount").cast("double"), 2).alias("total"))


@query(
    "s3_append_documents",
    """
    SELECT CASE WHEN n_chars >= 300 THEN 'completed' ELSE 'pending' END AS processing_status, '{}' AS metadata,
           source AS document_type, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes
    FROM documents GROUP BY ALL
    """,
)
def s3(spark, d):
    docs = v.table(spark, d, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        name.alias("filename"),
        name.alias("original_filename"),
        name.alias("file_path"),
        F.col("source").alias("document_type"),
        F.col("n_chars").alias("file_size"),
        F.when(F.col("n_chars") < 300, "pending").alias("processing_status"),
    )
    path = scratch_path(spark, "documents")
    tables.append(rows, "documents", path)
    return tables.read(spark, "documents", path).groupBy("processing_status", "metadata", "document_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes")
    )


@query(
    "s4_append_content",
    """
    SELECT lang, count(*) AS n, '[]' AS tables_data, CAST(sum(length(text)) AS BIGINT) AS characters,
           count(*) FILTER (contains(text, '$')) AS with_entities
    FROM documents GROUP BY lang
    """,
)
def s4(spark, d):
    docs = v.table(spark, d, "documents")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("text").alias("content_text"),
        F.struct(F.col("lang"), F.col("n_chars")).alias("content_structure"),
        F.struct(F.contains("text", F.lit("$")).alias("has_money")).alias("financial_entities"),
    )
    path = scratch_path(spark, "content")
    tables.append(rows, "content", path)
    return tables.read(spark, "content", path).groupBy(
        F.get_json_object("content_structure", "$.lang").alias("lang"), "tables_data"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("content_text")).alias("characters"),
        F.count_if(F.get_json_object("financial_entities", "$.has_money") == "true").alias("with_entities"),
    )


@query(
    "s5_append_sessions",
    """
    SELECT 'financial' AS audit_type, 'active' AS status, '[]' AS audit_scope, fiscal_year, count(*) AS n,
           round(CAST(sum(materiality_threshold) AS DOUBLE), 2) AS threshold_total
    FROM sessions GROUP BY fiscal_year
    """,
    ["sessions"],
)
def s5(spark, d):
    rows = v.sessions(spark, d).select(
        F.col("session_id").cast("string").alias("id"),
        F.concat(F.lit("Audit "), F.col("session_id").cast("string")).alias("session_name"),
        "client_name", "auditor_id", "fiscal_year", "materiality_threshold",
    )
    path = scratch_path(spark, "sessions")
    tables.append(rows, "sessions", path)
    return tables.read(spark, "sessions", path).groupBy("audit_type", "status", "audit_scope", "fiscal_year").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("materiality_threshold").cast("double"), 2).alias("threshold_total")
    )


@query(
    "s8_table_profile",
    """
    SELECT 'value' AS "column", count(*) AS row_count, count(value) AS "count", round(avg(value), 6) AS mean,
           round(stddev_samp(value), 6) AS std, min(value) AS "min", max(value) AS "max" FROM events
    UNION ALL SELECT 'user_id', count(*), count(user_id), round(avg(user_id), 6), round(stddev_samp(user_id), 6),
           CAST(min(user_id) AS DOUBLE), CAST(max(user_id) AS DOUBLE) FROM events
    UNION ALL SELECT 'event_id', count(*), count(event_id), round(avg(event_id), 6), round(stddev_samp(event_id), 6),
           CAST(min(event_id) AS DOUBLE), CAST(max(event_id) AS DOUBLE) FROM events
    """,
)
def s8(spark, d):
    stats, _ = files.profile(v.table(spark, d, "events"), ["event_id"])
    return stats.withColumn("mean", r("mean")).withColumn("std", r("std"))


@query(
    "s17_parameterised_sql",
    "SELECT o_orderstatus, count(*) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DOUBLE), 2) AS total "
    "FROM orders WHERE o_totalprice >= 250000 GROUP BY o_orderstatus",
)
def s17(spark, d):
    v.table(spark, d, "orders").createOrReplaceTempView("orders_in")
    text = (
        "SELECT o_orderstatus, count(*) AS n, round(cast(sum(cast(o_totalprice AS DECIMAL(20,2))) AS DOUBLE), 2) AS total "
        "FROM orders_in WHERE o_totalprice >= :least GROUP BY o_orderstatus"
    )
    return tables.run_sql(spark, text, {"least": 250000}).data


@query(
    "s18_record_contracts",
    """
    SELECT status, concat_ws(',', CASE WHEN NOT (fiscal_year BETWEEN 2000 AND 2030) THEN 'fiscal_year_between_2000_2030' END,
                        CASE WHEN NOT materiality_threshold > 0 THEN 'materiality_threshold_positive' END) AS broken,
           count(*) AS n
    FROM sessions GROUP BY ALL
    """,
    ["sessions"],
)
def s18(spark, d):
    rows = contracts.checked(v.sessions(spark, d), contracts.session_contract())
    return rows.groupBy("status", F.array_join("broken", ",").alias("broken")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p1_session_transactions",
    """
    SELECT txn_id, CAST(amount AS DOUBLE) AS amount, CAST(transaction_date AS VARCHAR) AS transaction_date, description,
           account_code, vendor_name, transaction_type
    FROM ledger WHERE session_id = '1-URGENT' AND amount >= 50000
    """,
    ["ledger"],
)
def p1(spark, d):
    rows = ops.transactions(v.ledger(spark, d), "1-URGENT", 50000)
    return rows.select("txn_id", F.col("amount").cast("double").alias("amount"), day("transaction_date"), "description",
                       "account_code", "vendor_name", "transaction_type")


@query(
    "p6_visible_sessions",
    """
    SELECT session_id, client_name, status, CAST(last_accessed AS VARCHAR) AS last_accessed
    FROM sessions WHERE created_by = 'auditor_3' OR auditor_id = 'auditor_3' OR 'auditor' = 'admin'
    """,
    ["sessions"],
)
def p6(spark, d):
    return ops.visible_sessions(v.sessions(spark, d), F.lit("auditor_3"), F.lit("auditor")).select("session_id", "client_name", "status", day("last_accessed"))


@query(
    "p10_hashed_sample",
    """
    WITH h AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || id), id) AS i, count(*) OVER () AS n FROM activity)
    SELECT id, account_id, amount FROM h WHERE i <= least(1000, n // 5)
    """,
    ["activity"],
)
def p10(spark, d):
    return hashed_sample(v.activity(spark, d), "id").select("id", "account_id", "amount")


@query(
    "j1_referenced_documents",
    """
    SELECT u.session_id, count(*) AS total_documents, count(*) FILTER (processing_status = 'completed') AS processed_docs,
           round(avg(confidence_score), 6) AS avg_confidence
    FROM docs JOIN documents c ON docs.document_id = c.doc_id
    JOIN (SELECT DISTINCT session_id, document_id FROM ledger) u ON u.document_id = docs.document_id
    GROUP BY u.session_id
    """,
    ["docs", "ledger"],
)
def j1(spark, d):
    docs = v.documents(spark, d)
    contents = v.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    out = ops.document_stats(docs, contents, v.ledger(spark, d, "session_id", "document_id"), ["session_id"])
    return out.withColumn("avg_confidence", r("avg_confidence"))


@query(
    "a1_transaction_stats",
    """
    SELECT session_id, count(*) AS total_transactions, round(CAST(sum(amount) AS DOUBLE), 2) AS total_amount,
           round(CAST(sum(amount) AS DOUBLE) / count(*), 6) AS avg_amount, CAST(min(amount) AS DOUBLE) AS min_amount,
           CAST(max(amount) AS DOUBLE) AS max_amount
    FROM ledger GROUP BY session_id
    """,
    ["ledger"],
)
def a1(spark, d):
    out = ops.transaction_stats(v.ledger(spark, d, "session_id", "amount"), ["session_id"])
    return out.withColumn("total_amount", r("total_amount", 2)).withColumn("avg_amount", r("avg_amount"))


@query(
    "a2_finding_stats",
    """
    SELECT session_id, count(*) AS total_findings, count(*) FILTER (severity = 'high') AS high_severity,
           count(*) FILTER (severity = 'critical') AS critical_findings, count(*) FILTER (status = 'resolved') AS resolved_findings
    FROM findings GROUP BY session_id
    """,
    ["findings"],
)
def a2(spark, d):
    return ops.finding_stats(v.findings(spark, d), ["session_id"])


@query(
    "a3_vendor_pattern",
    """
    SELECT session_id, vendor_name, count(*) AS transaction_count, round(CAST(sum(amount) AS DOUBLE), 2) AS total_amount,
           round(CAST(sum(amount) AS DOUBLE) / count(*), 6) AS avg_amount, round(stddev_samp(CAST(amount AS DOUBLE)), 4) AS amount_std_dev,
           CAST(min(transaction_date) AS VARCHAR) AS first_transaction, CAST(max(transaction_date) AS VARCHAR) AS last_transaction
    FROM ledger WHERE vendor_name <> '' GROUP BY session_id, vendor_name HAVING count(*) >= 3
    """,
    ["ledger"],
)
def a3(spark, d):
    out = ops.vendor_patterns(v.ledger(spark, d, "session_id", "vendor_name", "amount", "transaction_date"), ["session_id"])
    return out.select("session_id", "vendor_name", "transaction_count", r("total_amount", 2).alias("total_amount"),
                      r("avg_amount").alias("avg_amount"), r("amount_std_dev", 4).alias("amount_std_dev"),
                      day("first_transaction"), day("last_transaction"))


@query(
    "a4_session_summary",
    """
    WITH t AS (SELECT account_id AS session_id, count(*) AS total_transactions, round(sum(amount), 4) AS total_amount FROM activity GROUP BY 1),
         f AS (SELECT session_id, count(*) AS total_findings, count(*) FILTER (severity IN ('high','critical')) AS severe FROM findings GROUP BY 1),
         n AS (SELECT session_id, count(*) AS total_anomalies FROM anomalies GROUP BY 1),
         o AS (SELECT DISTINCT account_id AS session_id, account_id AS document_id FROM activity),
         c AS (SELECT o.session_id, count(*) AS total_documents FROM o JOIN documents d ON d.doc_id = o.document_id GROUP BY 1)
    SELECT t.session_id, total_transactions, total_amount, coalesce(total_findings, 0) AS total_findings, coalesce(severe, 0) AS severe_findings,
           coalesce(total_anomalies, 0) AS total_anomalies, coalesce(total_documents, 0) AS total_documents
    FROM t LEFT JOIN f USING (session_id) LEFT JOIN n USING (session_id) LEFT JOIN c USING (session_id)
    """,
    ["activity", "findings", "anomalies"],
)
def a4(spark, d):
    act = v.activity(spark, d).withColumnRenamed("account_id", "session_id")
    tx = act.groupBy("session_id").agg(F.count(F.lit(1)).alias("total_transactions"), r(F.sum("amount"), 4).alias("total_amount"))
    fs = ops.finding_stats(v.findings(spark, d), ["session_id"]).select(
        "session_id", "total_findings", (F.col("high_severity") + F.col("critical_findings")).alias("severe_findings")
    )
    an = v.anomalies(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("total_anomalies"))
    docs = v.documents(spark, d)
    used = act.select("session_id", F.col("session_id").alias("document_id"))
    dc = ops.document_stats(docs, docs.select("document_id"), used, ["session_id"]).select("session_id", "total_documents")
    out = tx.join(fs, "session_id", "left").join(an, "session_id", "left").join(dc, "session_id", "left")
    return out.na.fill(0, subset=["total_findings", "severe_findings", "total_anomalies", "total_documents"])


@query(
    "a12_portfolio_counts",
    """
    SELECT fiscal_year, count(*) AS total_audits, count(*) FILTER (status = 'in_progress') AS active_audits,
           count(*) FILTER (status = 'completed') AS completed_audits, count(*) FILTER (status = 'failed') AS failed_audits,
           round(count(*) FILTER (status = 'completed') * 100.0::DOUBLE / count(*), 6) AS success_rate
    FROM sessions GROUP BY fiscal_year
    """,
    ["sessions"],
)
def a12(spark, d):
    return ops.portfolio_counts(v.sessions(spark, d), ["fiscal_year"]).withColumn("success_rate", r(F.col("success_rate").cast("double")))


@query(
    "a26_digit_frequencies",
    """
    SELECT session_id, CAST(left(CAST(amount AS VARCHAR), 1) AS INTEGER) AS first_digit, CAST(amount AS DOUBLE) AS amount, count(*) AS frequency
    FROM ledger WHERE amount >= 10 GROUP BY ALL
    """,
    ["ledger"],
)
def a26(spark, d):
    out = ops.digit_frequencies(v.ledger(spark, d, "session_id", "amount"), ["session_id"])
    return out.withColumn("amount", F.col("amount").cast("double"))


@query(
    "a29_period_rollup",
    """
    WITH q AS (SELECT account_code, CAST(date_trunc('quarter', transaction_date) AS DATE) AS quarter,
                      CAST(coalesce(sum(amount) FILTER (kind = 'revenue'), 0) AS DOUBLE) AS revenue,
                      CAST(coalesce(sum(amount) FILTER (kind = 'expense'), 0) AS DOUBLE) AS expenses
               FROM ledger GROUP BY ALL),
         p AS (SELECT *, lag(revenue) OVER (PARTITION BY account_code ORDER BY quarter) AS before FROM q)
    SELECT account_code, CAST(quarter AS VARCHAR) AS quarter, round(revenue, 2) AS revenue, round(expenses, 2) AS expenses,
           round(revenue - expenses, 2) AS net_income, round((revenue - expenses) / nullif(revenue, 0), 6) AS net_margin,
           round((revenue - before) / nullif(before, 0), 6) AS revenue_change
    FROM p
    """,
    ["ledger"],
)
def a29(spark, d):
    from tallyscope.operators.ratios import period_rollup

    out = period_rollup(v.ledger(spark, d, "account_code", "transaction_date", "amount", "kind"), ["account_code"],
                        "transaction_date", "amount", "kind")
    return out.select("account_code", day("quarter"), *[r(c, 2).alias(c) for c in ("revenue", "expenses", "net_income")],
                      *[r(c).alias(c) for c in ("net_margin", "revenue_change")])


@query(
    "w1_amount_distribution",
    """
    SELECT session_id, txn_id, CAST(amount AS DOUBLE) AS amount, ntile(10) OVER (PARTITION BY session_id ORDER BY amount, txn_id) AS decile,
           row_number() OVER (PARTITION BY session_id ORDER BY amount DESC, txn_id DESC) AS rank
    FROM ledger WHERE amount > 0
    """,
    ["ledger"],
)
def w1(spark, d):
    out = ops.amount_distribution(v.ledger(spark, d, "session_id", "txn_id", "amount"), ["session_id"])
    return out.withColumn("amount", F.col("amount").cast("double"))


@query(
    "w2_running_balance",
    """
    SELECT id, account_id,
           round(CAST(sum(CAST(amount AS DECIMAL(20,2))) OVER (PARTITION BY account_id ORDER BY ts, id) AS DOUBLE), 2) AS account_balance,
           round(CAST(sum(CAST(amount AS DECIMAL(20,2))) OVER (ORDER BY id) AS DOUBLE), 2) AS running_balance
    FROM activity
    """,
    ["activity"],
)
def w2(spark, d):
    rows = v.activity(spark, d).select("id", "account_id", "ts", "amount")
    rows = running_balance(rows, ["account_id"], [F.col("ts"), F.col("id")], "amount").withColumnRenamed("running_balance", "account_balance")
    rows = running_balance(rows, [], [F.col("id")], "amount")
    return rows.select("id", "account_id", *[r(F.col(c).cast("double"), 2).alias(c) for c in ("account_balance", "running_balance")])


@query(
    "w15_vendor_share",
    """
    SELECT session_id, vendor_name, round(CAST(sum(amount) AS DOUBLE), 2) AS paid,
           round(CAST(sum(amount) AS DOUBLE) / CAST(sum(sum(amount)) OVER (PARTITION BY session_id) AS DOUBLE), 9) AS share
    FROM ledger GROUP BY session_id, vendor_name
    """,
    ["ledger"],
)
def w15(spark, d):
    out = fraud.vendor_share(v.ledger(spark, d, "session_id", "vendor_name", "amount"), ["session_id"], "vendor_name", "amount")
    return out.select("session_id", "vendor_name", r(F.col("paid").cast("double"), 2).alias("paid"), r("share", 9).alias("share"))


@query(
    "t1_largest_by_account",
    """
    SELECT account_code, txn_id, CAST(amount AS DOUBLE) AS amount, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY account_code ORDER BY amount DESC, txn_id) AS rank FROM ledger) WHERE rank <= 20
    """,
    ["ledger"],
)
def t1(spark, d):
    out = ordered.top_n(v.ledger(spark, d, "account_code", "txn_id", "amount"), ["account_code"], [F.col("amount").desc(), F.col("txn_id")], 20)
    return out.withColumn("amount", F.col("amount").cast("double"))


@query(
    "t9_sessions_by_access",
    """
    SELECT created_by, session_id, CAST(last_accessed AS VARCHAR) AS last_accessed, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY created_by ORDER BY last_accessed DESC, session_id) AS rank FROM sessions)
    """,
    ["sessions"],
)
def t9(spark, d):
    rows = v.sessions(spark, d).select("created_by", "session_id", "last_accessed")
    out = ordered.scan(rows, ["created_by"], [ordered.down(F.col("last_accessed")), F.col("session_id")], number="rank")
    return out.select("created_by", "session_id", day("last_accessed"), "rank")


@query(
    "t12_page",
    """
    WITH n AS (SELECT *, row_number() OVER (ORDER BY amount DESC, txn_id) AS "row", count(*) OVER () AS total FROM ledger)
    SELECT "row", txn_id, CAST(amount AS DOUBLE) AS amount, total, 3 AS page, CAST(ceil(total / 50.0) AS BIGINT) AS pages,
           3 < ceil(total / 50.0) AS has_next, true AS has_prev
    FROM n WHERE "row" > 100 AND "row" <= 150
    """,
    ["ledger"],
)
def t12(spark, d):
    out = ops.page(v.ledger(spark, d, "txn_id", "amount"), [ordered.down(F.col("amount")), F.col("txn_id")], 3, 50)
    return out.withColumn("amount", F.col("amount").cast("double"))


@query(
    "w14_checkpoint_history",
    """
    SELECT account_id, id, category, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, id DESC) AS rank FROM activity) WHERE rank <= 10
    """,
    ["activity"],
)
def w14(spark, d):
    return ops.history(v.activity(spark, d), ["account_id"], "ts", "id", 10).select("account_id", "id", "category", "rank")


@query(
    "t10_audit_trail",
    """
    SELECT account_id, id, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, id DESC) AS rank FROM activity) WHERE rank <= 100
    """,
    ["activity"],
)
def t10(spark, d):
    return ops.history(v.activity(spark, d), ["account_id"], "ts", "id", 100).select("account_id", "id", "rank")


@query(
    "j2_account_map",
    """
    SELECT id, count(*) OVER (PARTITION BY account_id) AS account_transaction_count,
           round(avg(amount) OVER (PARTITION BY account_id), 9) AS account_avg_amount FROM activity
    """,
    ["activity"],
)
def j2(spark, d):
    out = account_map(v.activity(spark, d), "account_id", "amount")
    return out.select("id", "account_transaction_count", r("account_avg_amount", 9).alias("account_avg_amount"))


@query(
    "j3_vendor_frequency",
    "SELECT txn_id, round(count(*) OVER (PARTITION BY vendor_name) / CAST(count(*) OVER () AS DOUBLE), 9) AS vendor_frequency FROM ledger",
    ["ledger"],
)
def j3(spark, d):
    return frequency(v.ledger(spark, d, "txn_id", "vendor_name"), "vendor_name").select("txn_id", r("vendor_frequency", 9).alias("vendor_frequency"))


@query(
    "j4_amount_frequency",
    """
    WITH a AS (SELECT account_code, amount, count(*) AS c FROM ledger GROUP BY ALL),
         n AS (SELECT account_code, sum(c) AS n FROM a GROUP BY 1),
         s AS (SELECT x.account_code, x.amount, sum(y.c) AS near FROM a x JOIN a y ON x.account_code = y.account_code
               AND y.amount BETWEEN x.amount - x.amount * 0.01::DECIMAL(6,4) AND x.amount + x.amount * 0.01::DECIMAL(6,4) GROUP BY 1, 2)
    SELECT l.txn_id, round(near / CAST(n AS DOUBLE), 9) AS amount_frequency
    FROM ledger l JOIN s USING (account_code, amount) JOIN n USING (account_code)
    """,
    ["ledger"],
)
def j4(spark, d):
    rows = v.ledger(spark, d, "account_code", "txn_id", "amount")
    out = amount_frequency(rows, ["account_code"], "amount")
    return out.select("txn_id", r("amount_frequency", 9).alias("amount_frequency"))


@query(
    "a23_fraud_indicators",
    """
    WITH s AS (SELECT session_id, count(*) AS total, count(*) FILTER (amount % 1000 = 0) AS round_count,
                      count(*) FILTER (dayofweek(transaction_date) IN (0, 6)) AS weekend_count,
                      count(*) - count(DISTINCT amount) AS duplicate_count FROM ledger GROUP BY 1)
    SELECT *, round(least(CASE WHEN round_count / CAST(total AS DOUBLE) > 0.1 THEN 0.3 ELSE 0 END + CASE WHEN weekend_count > 0 THEN 0.2 ELSE 0 END
           + CASE WHEN duplicate_count > total * 0.05 THEN 0.4 ELSE 0 END, 1)::DOUBLE, 6) AS risk_score,
           concat_ws(',', CASE WHEN round_count / CAST(total AS DOUBLE) > 0.1 THEN 'round_numbers' END,
               CASE WHEN weekend_count > 0 THEN 'weekend' END, CASE WHEN duplicate_count > total * 0.05 THEN 'duplicate_amounts' END) AS indicators
    FROM s
    """,
    ["ledger"],
)
def a23(spark, d):
    rows = v.ledger(spark, d, "session_id", "amount", "transaction_date")
    out = fraud.indicators(rows, ["session_id"], "amount", F.dayofweek("transaction_date") - 1)
    return out.withColumn("risk_score", r("risk_score")).withColumn("indicators", F.array_join("indicators", ","))


@query(
    "a24_fraud_panel",
    """
    WITH c AS (SELECT account_code, vendor_name, transaction_type, transaction_date, count(*) AS c FROM ledger GROUP BY ALL),
         k AS (SELECT account_code, CAST(sum(c - 1) AS BIGINT) AS duplicate_transactions FROM c GROUP BY 1),
         b AS (SELECT account_code, round(count(*) FILTER (amount % 100 = 0) / CAST(count(*) AS DOUBLE), 9) AS round_number_bias,
                      count(*) FILTER (dayofweek(transaction_date) IN (0, 6)) AS time_pattern_anomalies FROM ledger GROUP BY 1),
         s AS (SELECT account_code, vendor_name, CAST(sum(amount) AS DOUBLE) / CAST(sum(sum(amount)) OVER (PARTITION BY account_code) AS DOUBLE) AS share
               FROM ledger GROUP BY 1, 2),
         m AS (SELECT account_code, round(max(share), 9) AS vendor_concentration_risk FROM s GROUP BY 1)
    SELECT *, duplicate_transactions > 0 AS duplicates_found, round_number_bias > 0.15 AS round_high,
           time_pattern_anomalies > 10 AS time_high, vendor_concentration_risk > 0.6 AS concentration_high
    FROM b JOIN k USING (account_code) JOIN m USING (account_code)
    """,
    ["ledger"],
)
def a24(spark, d):
    rows = v.ledger(spark, d, "account_code", "vendor_name", "transaction_type", "transaction_date", "amount")
    unusual = F.weekday("transaction_date").isin(5, 6)
    out = fraud.panel(rows, ["account_code"], ["vendor_name", "transaction_type", "transaction_date"], "amount", "vendor_name", unusual)
    return out.withColumn("round_number_bias", r("round_number_bias", 9)).withColumn("vendor_concentration_risk", r("vendor_concentration_risk", 9))


NODES_SQL = """
    e AS (SELECT 'C' || customer_id AS source, 'S' || supplier_id AS target, amount, n, n_returned, flags FROM payments),
    ends AS (SELECT source AS id, 'payer' AS side, * EXCLUDE (source, target) FROM e UNION ALL SELECT target, 'payee', * EXCLUDE (source, target) FROM e),
    measures AS (SELECT id, side, CAST(sum(amount) AS DOUBLE) AS total_amount, CAST(sum(n) AS BIGINT) AS transaction_count,
                        sum(n_returned) / CAST(sum(n) AS DOUBLE) AS risk_score,
                        array_to_string(list_sort(list_distinct(flatten(list(flags)))), ',') AS flags FROM ends GROUP BY 1, 2),
    nodes AS (SELECT m.*, coalesce(c_name, s_name) AS entity_name, CASE WHEN side = 'payer' THEN 'individual' ELSE 'company' END AS entity_type
              FROM measures m LEFT JOIN customer ON m.id = 'C' || c_custkey LEFT JOIN supplier ON m.id = 'S' || s_suppkey),
    kept AS (SELECT * FROM nodes WHERE contains(lower(entity_name), '1') AND entity_type IN ('individual', 'company')
             AND risk_score >= 0.3 AND total_amount BETWEEN 100000 AND 1e12)
"""


def _edges(spark, d):
    return v.payments(spark, d).select(
        F.concat(F.lit("C"), F.col("customer_id").cast("string")).alias("source"),
        F.concat(F.lit("S"), F.col("supplier_id").cast("string")).alias("target"),
        "amount", "n", "n_returned", "flags",
    )


def _nodes(spark, d, edges):
    names = (
        v.table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("entity_name"))
        .unionByName(v.table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("entity_name")))
    )
    kind = F.when(F.col("side") == "payer", "individual").otherwise("company")
    return graph.node_measures(edges).join(names, "id", "left").withColumn("entity_type", kind)


@query(
    "a25_node_measures",
    f"WITH {NODES_SQL} SELECT id, side, round(total_amount, 2) AS total_amount, transaction_count, round(risk_score, 6) AS risk_score, flags FROM measures",
    ["payments"],
)
def a25(spark, d):
    out = graph.node_measures(_edges(spark, d))
    return out.withColumn("total_amount", r("total_amount", 2)).withColumn("risk_score", r("risk_score"))


def _kept(spark, d, edges):
    return graph.filter_nodes(_nodes(spark, d, edges), "1", ["individual", "company"], 0.3, 100000, 1e12)


@query(
    "p5_node_filter",
    f"WITH {NODES_SQL} SELECT id, entity_name, entity_type, round(total_amount, 2) AS total_amount, round(risk_score, 6) AS risk_score FROM kept",
    ["payments"],
)
def p5(spark, d):
    out = _kept(spark, d, _edges(spark, d))
    return out.select("id", "entity_name", "entity_type", r("total_amount", 2).alias("total_amount"), r("risk_score").alias("risk_score"))


@query(
    "j5_surviving_edges",
    f"WITH {NODES_SQL} SELECT source, target, CAST(amount AS DOUBLE) AS amount, n FROM e "
    "WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)",
    ["payments"],
)
def j5(spark, d):
    edges = _edges(spark, d)
    out = graph.surviving_edges(edges, _kept(spark, d, edges))
    return out.select("source", "target", F.col("amount").cast("double").alias("amount"), "n")
