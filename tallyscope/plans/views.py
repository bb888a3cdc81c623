"""Canonical audit views over the given tables, as DataFrames and as the SQL they equal.

Every DataFrame view takes the columns it must deliver and joins only the dimension
tables those columns need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(20,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key():
    return F.concat_ws(
        "-",
        *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        F.col("l_extendedprice").cast(MONEY).cast("string"),
    )


# column -> (expression, table it needs beyond lineitem)
_LEDGER = {
    "txn_id": (_key, None),
    "session_id": (lambda: F.col("o_orderpriority"), "orders"),
    "document_id": (lambda: F.col("l_partkey"), None),
    "amount": (lambda: F.col("l_extendedprice").cast(MONEY), None),
    "transaction_date": (lambda: F.to_date("l_shipdate"), None),
    "vendor_name": (lambda: F.col("s_name"), "supplier"),
    "account_code": (lambda: F.col("p_brand"), "part"),
    "transaction_type": (lambda: F.col("l_returnflag"), None),
    "description": (lambda: F.col("p_name"), "part"),
    # inputs of the compliance rules, derived in a fixed way from keys and flags
    "gross": (lambda: (F.col("l_extendedprice").cast(MONEY) * F.col("l_quantity").cast("int")).cast(MONEY), None),
    "kind": (
        lambda: F.when(F.col("l_returnflag") == "R", "revenue")
        .when(F.col("l_returnflag") == "A", "expense")
        .otherwise("other"),
        None,
    ),
    "management_approved": (lambda: F.col("l_linestatus") == "F", None),
    "authorized_by": (
        lambda: F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.lit("auditor_"), F.col("l_suppkey").cast("string"))),
        None,
    ),
    "service_date": (
        lambda: F.when(F.col("l_orderkey") % 17 != 0, F.date_add(F.to_date("o_orderdate"), 60)),
        "orders",
    ),
    "contract_id": (
        lambda: F.when(F.col("l_partkey") % 11 != 0, F.concat(F.lit("C-"), F.col("l_partkey").cast("string"))),
        None,
    ),
    "related_revenue_id": (
        lambda: F.when(F.col("l_orderkey") % 5 != 0, F.concat(F.lit("R-"), F.col("l_orderkey").cast("string"))),
        None,
    ),
    "category": (
        lambda: F.when(F.col("l_returnflag") == "N", "financial_asset").otherwise("operating"),
        None,
    ),
    "classification": (
        lambda: F.when(F.col("l_partkey") % 13 != 0, F.lit("amortised_cost")),
        None,
    ),
    "quantity": (lambda: F.col("l_quantity"), None),
    "discount": (lambda: F.col("l_discount"), None),
    "tax": (lambda: F.col("l_tax"), None),
    "customer_id": (lambda: F.col("o_custkey"), "orders"),
    "supplier_id": (lambda: F.col("l_suppkey"), None),
}


def ledger(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Transactions: one row per line item."""
    columns = columns or ("txn_id", "session_id", "amount", "transaction_date", "vendor_name", "account_code",
                          "transaction_type", "description")
    needed = {_LEDGER[c][1] for c in columns} - {None}
    df = table(spark, sf_dir, "lineitem")
    if "orders" in needed:
        df = df.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if "supplier" in needed:
        df = df.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    if "part" in needed:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return df.select(*[_LEDGER[c][0]().alias(c) for c in columns])


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed account activity: one row per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("account_id"),
        F.col("event_type").alias("category"),
        F.col("value").alias("amount"),
        "props",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit findings read from the error, sign-up and purchase events."""
    k = F.col("k")
    return (
        activity(spark, sf_dir)
        .where(F.col("category").isin("error", "signup", "purchase"))
        .select(
            F.col("id").alias("finding_id"),
            F.col("account_id").alias("session_id"),
            F.when(k < 5, "critical").when(k < 20, "high").when(k < 60, "medium").otherwise("low").alias("severity"),
            F.when(F.col("category") == "error", "open")
            .when(F.col("category") == "signup", "resolved")
            .otherwise("in_progress")
            .alias("status"),
            F.when(F.col("category") == "error", "regulatory_compliance")
            .when(F.col("category") == "signup", "controls")
            .otherwise("payments")
            .alias("category"),
            F.concat(F.lit("Finding "), F.col("id").cast("string")).alias("title"),
            F.concat_ws(" ", F.lit("Observed"), F.col("category"), F.lit("with"), F.col("props")).alias("description"),
            F.concat(F.lit("Review account "), F.col("account_id").cast("string")).alias("recommendation"),
            (k / F.lit(100.0)).alias("confidence"),
            F.when(k % 3 != 0, F.col("amount") * 1000).alias("financial_impact"),
            F.when(F.col("category") == "error", "SOX").alias("regulatory_reference"),
            "ts",
        )
    )


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected anomalies read from the view and click events."""
    k = F.col("k")
    return (
        activity(spark, sf_dir)
        .where(F.col("category").isin("view", "click"))
        .select(
            F.col("id").alias("anomaly_id"),
            F.col("account_id").alias("session_id"),
            F.when(F.col("category") == "view", "statistical_deviation").otherwise("rl_anomaly").alias("type"),
            F.when(k >= 80, "high").when(k >= 60, "medium").when(k >= 40, "low").otherwise("very_low").alias("severity"),
            (k / F.lit(100.0)).alias("confidence"),
            F.concat_ws(" ", F.lit("Flagged"), F.col("category"), F.col("props")).alias("description"),
            "ts",
        )
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit sessions: one per order."""
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.select(
        F.col("o_orderkey").alias("session_id"),
        F.col("c_name").alias("client_name"),
        F.concat(F.lit("auditor_"), F.col("c_nationkey").cast("string")).alias("auditor_id"),
        F.concat(F.lit("user_"), (F.col("o_custkey") % 40).cast("string")).alias("created_by"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "in_progress")
        .otherwise("failed")
        .alias("status"),
        F.year("o_orderdate").alias("fiscal_year"),
        (F.col("o_totalprice").cast(MONEY) - 1000).cast(MONEY).alias("materiality_threshold"),
        F.to_date("o_orderdate").alias("last_accessed"),
        F.col("c_mktsegment").alias("risk_tolerance"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed document records, with the labelled quality as confidence."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kinds = F.array(*[F.lit(x) for x in ("invoice_", "bill_", "balance_sheet_", "statement_", "receipt_")])
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("document_id"),
        F.concat(F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")), F.col("doc_id").cast("string"),
                 F.lit(".pdf")).alias("filename"),
        F.col("lang").alias("language"),
        F.col("source"),
        F.col("n_chars").alias("file_size"),
        F.when(F.col("n_chars") >= 300, "completed").otherwise("failed").alias("processing_status"),
        F.col("quality").cast("double").alias("confidence_score"),
        "text",
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly statement per supplier with derived totals."""
    price, disc, tax = F.col("amount"), F.col("discount").cast("decimal(4,2)"), F.col("tax").cast("decimal(4,2)")
    rows = ledger(
        spark, sf_dir, "supplier_id", "transaction_date", "amount", "discount", "tax", "transaction_type", "management_approved"
    )

    def total(expr, when=None):
        return F.sum(expr if when is None else F.when(when, expr)).cast("double")

    out = rows.groupBy("supplier_id", F.year("transaction_date").alias("fiscal_year")).agg(
        total(price * (1 - disc)).alias("revenue"),
        total(price * disc + price * tax).alias("expenses"),
        total(price).alias("total_assets"),
        total(price, F.col("transaction_type") == "R").alias("total_liabilities"),
        total(price, ~F.col("management_approved")).alias("current_assets"),
        total(price, F.col("transaction_type") == "A").alias("current_liabilities"),
        total(price * disc).alias("interest_expense"),
        total(price, (F.col("transaction_type") == "N") & ~F.col("management_approved")).alias("cash"),
    )
    return (
        out.withColumn("net_income", F.col("revenue") - F.col("expenses"))
        .withColumn("total_equity", F.col("total_assets") - F.col("total_liabilities"))
        .withColumn("gross_profit", F.col("revenue") - F.col("interest_expense"))
        .withColumn("ebit", F.col("net_income") + F.col("interest_expense"))
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer-to-supplier payment edges with sum and count."""
    rows = ledger(spark, sf_dir, "customer_id", "supplier_id", "amount", "transaction_type")
    return rows.groupBy("customer_id", "supplier_id").agg(
        F.sum("amount").cast(MONEY).alias("amount"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("transaction_type") == "R").alias("n_returned"),
        F.collect_set("transaction_type").alias("flags"),
    )


SQL_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "ledger": (
        """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(20,2))) AS txn_id,
               o_orderpriority AS session_id, l_partkey AS document_id,
               CAST(l_extendedprice AS DECIMAL(20,2)) AS amount, CAST(l_shipdate AS DATE) AS transaction_date,
               s_name AS vendor_name, p_brand AS account_code, l_returnflag AS transaction_type, p_name AS description,
               CAST(CAST(l_extendedprice AS DECIMAL(20,2)) * CAST(l_quantity AS INTEGER) AS DECIMAL(20,2)) AS gross,
               CASE l_returnflag WHEN 'R' THEN 'revenue' WHEN 'A' THEN 'expense' ELSE 'other' END AS kind,
               l_linestatus = 'F' AS management_approved,
               CASE WHEN l_suppkey % 7 <> 0 THEN 'auditor_' || l_suppkey END AS authorized_by,
               CASE WHEN l_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) + 60 END AS service_date,
               CASE WHEN l_partkey % 11 <> 0 THEN 'C-' || l_partkey END AS contract_id,
               CASE WHEN l_orderkey % 5 <> 0 THEN 'R-' || l_orderkey END AS related_revenue_id,
               CASE WHEN l_returnflag = 'N' THEN 'financial_asset' ELSE 'operating' END AS category,
               CASE WHEN l_partkey % 13 <> 0 THEN 'amortised_cost' END AS classification,
               l_quantity AS quantity, l_discount AS discount, l_tax AS tax,
               o_custkey AS customer_id, l_suppkey AS supplier_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
        """,
        (),
    ),
    "activity": (
        """
        SELECT event_id AS id, ts, user_id AS account_id, event_type AS category, value AS amount, props,
               CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events
        """,
        (),
    ),
    "findings": (
        """
        SELECT id AS finding_id, account_id AS session_id,
               CASE WHEN k < 5 THEN 'critical' WHEN k < 20 THEN 'high' WHEN k < 60 THEN 'medium' ELSE 'low' END AS severity,
               CASE category WHEN 'error' THEN 'open' WHEN 'signup' THEN 'resolved' ELSE 'in_progress' END AS status,
               CASE category WHEN 'error' THEN 'regulatory_compliance' WHEN 'signup' THEN 'controls' ELSE 'payments' END AS category,
               'Finding ' || id AS title,
               'Observed ' || category || ' with ' || props AS description,
               'Review account ' || account_id AS recommendation,
               k / 100.0::DOUBLE AS confidence,
               CASE WHEN k % 3 <> 0 THEN amount * 1000 END AS financial_impact,
               CASE WHEN category = 'error' THEN 'SOX' END AS regulatory_reference, ts
        FROM activity WHERE category IN ('error', 'signup', 'purchase')
        """,
        ("activity",),
    ),
    "anomalies": (
        """
        SELECT id AS anomaly_id, account_id AS session_id,
               CASE category WHEN 'view' THEN 'statistical_deviation' ELSE 'rl_anomaly' END AS type,
               CASE WHEN k >= 80 THEN 'high' WHEN k >= 60 THEN 'medium' WHEN k >= 40 THEN 'low' ELSE 'very_low' END AS severity,
               k / 100.0::DOUBLE AS confidence, 'Flagged ' || category || ' ' || props AS description, ts
        FROM activity WHERE category IN ('view', 'click')
        """,
        ("activity",),
    ),
    "sessions": (
        """
        SELECT o_orderkey AS session_id, c_name AS client_name, 'auditor_' || c_nationkey AS auditor_id,
               'user_' || (o_custkey % 40) AS created_by,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'failed' END AS status,
               year(o_orderdate) AS fiscal_year,
               CAST(CAST(o_totalprice AS DECIMAL(20,2)) - 1000 AS DECIMAL(20,2)) AS materiality_threshold,
               CAST(o_orderdate AS DATE) AS last_accessed, c_mktsegment AS risk_tolerance
        FROM orders JOIN customer ON o_custkey = c_custkey
        """,
        (),
    ),
    "docs": (
        """
        SELECT d.doc_id AS document_id,
               ['invoice_', 'bill_', 'balance_sheet_', 'statement_', 'receipt_'][d.doc_id % 5 + 1] || d.doc_id || '.pdf' AS filename,
               lang AS language, source, n_chars AS file_size,
               CASE WHEN n_chars >= 300 THEN 'completed' ELSE 'failed' END AS processing_status,
               CAST(quality AS DOUBLE) AS confidence_score, text
        FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id
        """,
        (),
    ),
    "statements": (
        """
        SELECT *, revenue - expenses AS net_income, total_assets - total_liabilities AS total_equity,
               revenue - interest_expense AS gross_profit, revenue - expenses + interest_expense AS ebit
        FROM (SELECT supplier_id, year(transaction_date) AS fiscal_year,
                     CAST(sum(amount * (1 - CAST(discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue,
                     CAST(sum(amount * CAST(discount AS DECIMAL(4,2)) + amount * CAST(tax AS DECIMAL(4,2))) AS DOUBLE) AS expenses,
                     CAST(sum(amount) AS DOUBLE) AS total_assets,
                     CAST(sum(amount) FILTER (transaction_type = 'R') AS DOUBLE) AS total_liabilities,
                     CAST(sum(amount) FILTER (NOT management_approved) AS DOUBLE) AS current_assets,
                     CAST(sum(amount) FILTER (transaction_type = 'A') AS DOUBLE) AS current_liabilities,
                     CAST(sum(amount * CAST(discount AS DECIMAL(4,2))) AS DOUBLE) AS interest_expense,
                     CAST(sum(amount) FILTER (transaction_type = 'N' AND NOT management_approved) AS DOUBLE) AS cash
              FROM ledger GROUP BY ALL)
        """,
        ("ledger",),
    ),
    "payments": (
        """
        SELECT customer_id, supplier_id, CAST(sum(amount) AS DECIMAL(20,2)) AS amount, count(*) AS n,
               count(*) FILTER (transaction_type = 'R') AS n_returned, list(DISTINCT transaction_type) AS flags
        FROM ledger GROUP BY ALL
        """,
        ("ledger",),
    ),
}
