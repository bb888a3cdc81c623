"""Document, extraction and text-safety queries. All read whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.constants import FINANCIAL_PATTERNS, SCAN_PATTERNS, SECRET_PATTERNS, SENSITIVE_KEYWORDS
from tallyscope.functions import scores as sc
from tallyscope.functions import text as tx
from tallyscope.operators import safety as sf
from tallyscope.plans import views as v
from tallyscope.plans.catalog.measures import rounded
from tallyscope.plans.registry import query


def q(text):
    """Quote a pattern for SQL."""
    return "'" + text.replace("'", "''") + "'"


def _texts(spark, d):
    return v.table(spark, d, "documents").select("doc_id", "text")


# ---- flattening -------------------------------------------------------------------------------

NESTED_SQL = """
    n AS (SELECT txn_id AS document_id, transaction_type, management_approved, amount, vendor_name AS vendor, CAST(amount * CAST(tax AS DECIMAL(4,2)) AS DECIMAL(20,2)) AS tax_amount FROM ledger)
"""


def nested(spark, d):
    """Nested documents, one per ledger row: a list of transactions or of invoices, and a balance map."""
    rows = v.ledger(spark, d, "txn_id", "transaction_type", "management_approved", "amount", "vendor_name", "tax")
    tax = (F.col("amount") * F.col("tax").cast("decimal(4,2)")).cast(v.MONEY)
    items = F.array(*[F.struct(a.alias("amount"), F.col("vendor_name").alias("vendor")) for a in (F.col("amount"), tax)])
    returned = F.col("transaction_type") == "A"
    approved = F.col("management_approved")
    return rows.select(
        F.col("txn_id").alias("document_id"),
        F.when(returned, items).alias("transactions"),
        F.when(~returned, items).alias("invoices"),
        F.create_map(F.lit("open"), F.when(~approved, F.col("amount")), F.lit("final"), F.when(approved, F.col("amount"))).alias("current_assets"),
    )


@query(
    "p2_flatten_amounts",
    f"""WITH {NESTED_SQL} SELECT document_id, 'invoice' AS kind, vendor AS account, CAST(amount AS DOUBLE) AS amount FROM n WHERE transaction_type <> 'A' AND amount > 0
    UNION ALL SELECT document_id, 'invoice', vendor, CAST(tax_amount AS DOUBLE) FROM n WHERE transaction_type <> 'A' AND tax_amount > 0
    UNION ALL SELECT document_id, 'current_asset', CASE WHEN management_approved THEN 'final' ELSE 'open' END, CAST(amount AS DOUBLE) FROM n WHERE amount > 0""",
    ["ledger"],
)
def p2(spark, d):
    docs = nested(spark, d)
    inv = docs.select("document_id", F.inline("invoices")).select("document_id", F.lit("invoice").alias("kind"), F.col("vendor").alias("account"), "amount")
    bal = docs.select("document_id", F.explode("current_assets").alias("account", "amount")).select("document_id", F.lit("current_asset").alias("kind"), "account", "amount")
    return inv.unionByName(bal).where(F.col("amount") > 0).withColumn("amount", F.col("amount").cast("double"))


@query(
    "p3_flatten_transactions",
    f"WITH {NESTED_SQL} SELECT document_id, vendor, CAST(amount AS DOUBLE) AS amount FROM n UNION ALL SELECT document_id, vendor, CAST(tax_amount AS DOUBLE) FROM n",
    ["ledger"],
)
def p3(spark, d):
    out = nested(spark, d).select("document_id", F.inline(F.coalesce("transactions", "invoices")))
    return out.select("document_id", "vendor", F.col("amount").cast("double").alias("amount"))


@query(
    "p4_parsed_documents",
    "SELECT document_id, filename FROM docs WHERE starts_with(filename, 'invoice_') AND processing_status = 'completed'",
    ["docs"],
)
def p4(spark, d):
    return v.documents(spark, d).where((tx.document_class(F.col("filename")) == "invoice") & F.col("filename").startswith("invoice_") & (F.col("processing_status") == "completed")).select("document_id", "filename")


# ---- scalar text functions --------------------------------------------------------------------

@query(
    "f11_sanitized_text",
    "SELECT doc_id, md5(trim(translate(text, '<>\"''&;()|`', ''), ' ')) AS digest, length(trim(translate(text, '<>\"''&;()|`', ''), ' ')) AS n FROM documents",
)
def f11(spark, d):
    clean = sc.sanitized(F.col("text"))
    return _texts(spark, d).select("doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("bigint").alias("n"))


@query(
    "f12_json_fields",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{\"k\":' || json_extract(props, '$.k') || ',\"t\":\"' || event_type || '\"}' AS encoded FROM events",
)
def f12(spark, d):
    e = v.table(spark, d, "events").withColumn("p", F.from_json("props", "k int"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("t"))).alias("encoded"))


@query(
    "f13_document_class",
    """
    SELECT document_id, CASE WHEN regexp_matches(lower(filename), 'balance_sheet|financial_position') THEN 'balance_sheet'
           WHEN regexp_matches(lower(filename), 'invoice|inv_|bill|receipt') THEN 'invoice' ELSE 'other' END AS document_class FROM docs
    """,
    ["docs"],
)
def f13(spark, d):
    return v.documents(spark, d).select("document_id", tx.document_class(F.col("filename")).alias("document_class"))


INVOICE_TEXT_SQL = """
    inv AS (SELECT o_orderkey AS document_id, 'Invoice #INV-' || o_orderkey || chr(10) || 'Acme Trading Inc' || chr(10) || 'Date: ' || strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || chr(10)
                   || 'Due: ' || strftime(CAST(o_orderdate AS DATE) + 30, '%m/%d/%Y') || chr(10) || 'Total: $' || CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR) || chr(10)
                   || 'Net: ' || CAST(CAST(o_totalprice AS DECIMAL(20,2)) - 100 AS VARCHAR) || ' EUR' AS text FROM orders)
"""


def invoice_texts(spark, d):
    """Invoice texts written out from the orders."""
    o = v.table(spark, d, "orders")
    total = F.col("o_totalprice").cast(v.MONEY)
    day = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("document_id"),
        F.concat(
            F.lit("Invoice #INV-"), F.col("o_orderkey").cast("string"), F.lit("\nAcme Trading Inc\nDate: "), day.cast("string"),
            F.lit("\nDue: "), F.date_format(F.date_add(day, 30), "MM/dd/yyyy"), F.lit("\nTotal: $"), total.cast("string"),
            F.lit("\nNet: "), (total - 100).cast(v.MONEY).cast("string"), F.lit(" EUR"),
        ).alias("text"),
    )


def _amounts_sql(table, key):
    forms = [tx.MONEY, tx.MONEY_CODE_AFTER, tx.MONEY_CODE_BEFORE]
    parts = " UNION ALL ".join(
        f"SELECT {key}, unnest(regexp_extract_all(text, {q(p)}, 1)) AS a FROM {table}" for p in forms
    )
    return f"SELECT {key}, CAST(CAST(replace(a, ',', '') AS DECIMAL(20,2)) AS DOUBLE) AS amount FROM ({parts})"


@query("f14_text_amounts", _amounts_sql("documents", "doc_id"))
def f14(spark, d):
    return _texts(spark, d).select("doc_id", F.explode(tx.amounts(F.col("text"))).alias("amount")).withColumn("amount", F.col("amount").cast("double"))


# every form of an amount, made of the event's value
FORMS_SQL = "frm AS (SELECT id, 'Paid $' || format('{:,.2f}', amount * 1000) || ' at once, EUR ' || format('{:.2f}', amount) || ' later and ' || format('{:,.2f}', amount * 100) || ' USD on ' || CAST(k AS VARCHAR) || ' days' AS text FROM activity)"


@query("f14_amount_forms", f"WITH {FORMS_SQL} {_amounts_sql('frm', 'id')}", ["activity"])
def f14_forms(spark, d):
    money = lambda c: F.format_number(c, 2)
    plain = F.replace(F.format_number("amount", 2), F.lit(","), F.lit(""))
    text = F.concat(F.lit("Paid $"), money(F.col("amount") * 1000), F.lit(" at once, EUR "), plain, F.lit(" later and "), money(F.col("amount") * 100), F.lit(" USD on "), F.col("k").cast("string"), F.lit(" days"))
    rows = v.activity(spark, d).select("id", text.alias("text"))
    return rows.select("id", F.explode(tx.amounts(F.col("text"))).alias("amount")).withColumn("amount", F.col("amount").cast("double"))


@query("f14_invoice_amounts", f"WITH {INVOICE_TEXT_SQL} {_amounts_sql('inv', 'document_id')}")
def f14_invoices(spark, d):
    return invoice_texts(spark, d).select("document_id", F.explode(tx.amounts(F.col("text"))).alias("amount")).withColumn("amount", F.col("amount").cast("double"))


@query(
    "f15_text_dates",
    f"""WITH {INVOICE_TEXT_SQL} SELECT document_id, CAST(CAST(strptime(unnest(regexp_extract_all(text, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}')), '%m/%d/%Y') AS DATE) AS VARCHAR) AS found FROM inv
    UNION ALL SELECT document_id, CAST(CAST(unnest(regexp_extract_all(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS DATE) AS VARCHAR) FROM inv""",
)
def f15(spark, d):
    return invoice_texts(spark, d).select("document_id", F.explode(tx.dates(F.col("text"))).alias("found")).withColumn("found", F.col("found").cast("string"))


@query(
    "f16_invoice_number",
    f"""WITH {INVOICE_TEXT_SQL}, a AS (SELECT document_id, text FROM inv UNION ALL SELECT doc_id, text FROM documents)
    SELECT document_id, CASE WHEN regexp_extract(text, '#(INV-[A-Za-z0-9]+)', 1) <> '' THEN regexp_extract(text, '#(INV-[A-Za-z0-9]+)', 1) ELSE 'INV-' || left(sha256(text), 8) END AS invoice_number FROM a""",
)
def f16(spark, d):
    both = invoice_texts(spark, d).unionByName(_texts(spark, d).withColumnRenamed("doc_id", "document_id"))
    return both.select("document_id", tx.invoice_number(F.col("text")).alias("invoice_number"))


@query(
    "f17_vendors_currencies",
    f"""WITH {INVOICE_TEXT_SQL} SELECT document_id, array_to_string(list_distinct(regexp_extract_all(text, {q(tx.COMPANY)}, 1)), ',') AS vendors,
        CASE WHEN contains(text, 'EUR') THEN 'EUR,USD' ELSE 'USD' END AS currencies FROM inv""",
)
def f17(spark, d):
    return invoice_texts(spark, d).select("document_id", F.array_join(tx.vendor_names(F.col("text")), ",").alias("vendors"), F.array_join(tx.currencies(F.col("text")), ",").alias("currencies"))


@query(
    "f18_line_items",
    """
    SELECT o_orderkey AS document_id, 2 AS line_number, 'Goods ' || o_orderstatus AS description, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS DOUBLE) AS amount FROM orders
    UNION ALL SELECT o_orderkey, 4, 'Freight', CAST(o_custkey + 0.5 AS DOUBLE) FROM orders
    """,
)
def f18(spark, d):
    # an invoice table written out from each order, then read back as text
    o = v.table(spark, d, "orders")
    text = F.concat(
        F.lit("Description\tTotal\nGoods "), F.col("o_orderstatus"), F.lit("\t$"), F.col("o_totalprice").cast(v.MONEY).cast("string"),
        F.lit("\nno money here\nFreight\t1\t"), (F.col("o_custkey") + F.lit(0.5).cast("decimal(3,2)")).cast(v.MONEY).cast("string"), F.lit("\n"),
    )
    return o.select(F.col("o_orderkey").alias("document_id"), text.alias("text")).select("document_id", F.inline(tx.line_items(F.col("text"))))


@query(
    "f19_clipped_text",
    "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS clip_500, left(text, 200) AS clip_200, left(text, 150) AS clip_150, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents",
)
def f19(spark, d):
    t = F.col("text")
    return _texts(spark, d).select("doc_id", sc.clipped(t, 500).alias("clip_500"), sc.clipped(t, 200, False).alias("clip_200"), sc.clipped(t, 150, False).alias("clip_150"), sc.token_estimate(t).alias("tokens"))


@query("f20_token_estimate", "SELECT lang, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def f20(spark, d):
    return v.table(spark, d, "documents").groupBy("lang").agg(F.sum(sc.token_estimate(F.col("text"))).alias("tokens"))


@query(
    "f21_titles",
    "SELECT DISTINCT status, CASE status WHEN 'in_progress' THEN 'In Progress' WHEN 'completed' THEN 'Completed' ELSE 'Failed' END AS title, CASE status WHEN 'in_progress' THEN 'in, progress' ELSE status END AS joined FROM sessions",
    ["sessions"],
)
def f21(spark, d):
    s = v.sessions(spark, d).select("status").distinct()
    return s.select("status", sc.title_case(F.col("status")).alias("title"), F.array_join(F.split("status", "_"), ", ").alias("joined"))


# ---- text safety ------------------------------------------------------------------------------

def _spans_sql(name, pattern, severity):
    p = q("(?i)" + pattern)
    return f"""SELECT doc_id, {q(name)} AS data_type, {q(severity)} AS severity, unnest(list_transform(range(1, len(m) + 1),
        lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))) AS start,
        unnest(list_transform(m, lambda x: length(x))) AS width
        FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS m, regexp_split_to_array(text, {p}) AS g FROM documents) WHERE len(m) > 0"""


SCAN_SQL = "sc AS (" + " UNION ALL ".join(_spans_sql(*p) for p in SCAN_PATTERNS) + ")"


@query("x1_sensitive_scan", f"WITH {SCAN_SQL} SELECT doc_id, data_type, severity, CAST(start AS BIGINT) AS start, CAST(start + width AS BIGINT) AS stop FROM sc")
def x1(spark, d):
    out = sf.scan_text(_texts(spark, d), ["doc_id"], "text")
    return out.select("doc_id", "data_type", "severity", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))


def _mask_sql(expr):
    pat = {n: p for n, p, _ in SCAN_PATTERNS}
    for n in ("ssn", "credit_card", "bank_account"):
        expr = f"regexp_replace({expr}, {q(pat[n])}, '***MASKED***', 'gi')"
    mail = r"\b([A-Za-z0-9._%+-]{1,2})[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b"
    expr = f"regexp_replace({expr}, {q(mail)}, '\\1***@\\2', 'gi')"
    phone = r"\b([0-9]{3})-?[0-9]{3}-?([0-9]{4})\b"
    return f"regexp_replace({expr}, {q(phone)}, '\\1-***-\\2', 'g')"


@query("x2_masked_text", f"SELECT doc_id, md5({_mask_sql('text')}) AS digest, length({_mask_sql('text')}) AS n FROM documents")
def x2(spark, d):
    m = sf.masked(F.col("text"))
    return _texts(spark, d).select("doc_id", F.md5(m).alias("digest"), F.length(m).cast("bigint").alias("n"))


@query(
    "x7_sanitized_masked",
    f"""WITH s AS (SELECT conv_id, turn, trim(translate(text, '<>"''&;()|`', ''), ' ') AS text FROM conversations) SELECT conv_id, turn, md5({_mask_sql('text')}) AS digest FROM s""",
)
def x7(spark, d):
    out = sf.sanitize_and_mask(v.table(spark, d, "conversations").select("conv_id", "turn", "text"))
    return out.select("conv_id", "turn", F.md5("text").alias("digest"))


def _hits_sql(table="documents", key="doc_id"):
    fin = [
        f"SELECT {key}, 'pii_detected' AS violation_type, {q(n)} AS detail, {q(s)} AS severity, CASE WHEN length(m) > 4 THEN left(m, 4) || '***' ELSE '***' END AS evidence, 0.85::DOUBLE AS confidence "
        f"FROM (SELECT {key}, unnest(regexp_extract_all(text, {q(p)})) AS m FROM {table})"
        for n, p, s in FINANCIAL_PATTERNS
    ]
    sec = [
        f"SELECT {key}, 'secrets_exposed', {q(n)}, 'critical', CASE WHEN length(m) > 10 THEN left(m, 10) || '...' ELSE m END, 0.8::DOUBLE FROM (SELECT {key}, unnest(regexp_extract_all(text, {q(p)}, 1)) AS m FROM {table})"
        for n, p in SECRET_PATTERNS
    ]
    kw = [f"SELECT {key}, 'toxic_content', '{k}', 'medium', '{k}', 0.6::DOUBLE FROM {table} WHERE contains(lower(text), '{k}')" for k in SENSITIVE_KEYWORDS]
    return "h AS (" + " UNION ALL ".join(fin + sec + kw) + ")"


HIT_COLUMNS = "doc_id, violation_type, detail, severity, evidence, confidence"


def _hit_query(name, scan, violation):
    @query(name, f"WITH {_hits_sql()} SELECT {HIT_COLUMNS} FROM h WHERE violation_type = '{violation}'")
    def run(spark, d):
        return sf.hits(_texts(spark, d), ["doc_id"], "text", scan)


_hit_query("x3_financial_patterns", "financial", "pii_detected")
_hit_query("x4_secrets", "secrets", "secrets_exposed")
_hit_query("x5_keywords", "keywords", "toxic_content")

WEIGHT_SQL = "CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.7 WHEN 'medium' THEN 0.3 ELSE 0.1 END"


@query(
    "x6_verdicts",
    f"""WITH {_hits_sql()}, a AS (SELECT doc_id, count(*) AS n, least(avg({WEIGHT_SQL} * confidence), 1) AS risk, bool_or(severity = 'critical') AS crit FROM h GROUP BY 1)
    SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS violations, round(coalesce(risk, 0), 9) AS risk_score, coalesce(risk, 0) < 0.3 AND NOT coalesce(crit, false) AS is_safe FROM documents LEFT JOIN a USING (doc_id)""",
)
def x6(spark, d):
    return rounded(sf.verdicts(_texts(spark, d), ["doc_id"], "text"), 9)


@query(
    "r17_security_risk",
    f"""WITH {_hits_sql()}, a AS (SELECT lang, h.* FROM h JOIN documents USING (doc_id)) SELECT lang, count(*) AS violations, round(least(avg({WEIGHT_SQL} * confidence), 1), 9) AS risk_score,
        bool_or(severity = 'critical') AS has_critical, least(avg({WEIGHT_SQL} * confidence), 1) < 0.3 AND NOT bool_or(severity = 'critical') AS is_safe FROM a GROUP BY lang""",
)
def r17(spark, d):
    return rounded(sf.risk_rollup(sf.hits(v.table(spark, d, "documents"), ["lang"], "text"), ["lang"]), 9)


@query(
    "x9_event_summary",
    f"""WITH {SCAN_SQL} SELECT doc_id, count(*) AS violations_count, string_agg(DISTINCT data_type, ',' ORDER BY data_type) AS violation_types,
        CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS max_severity FROM sc GROUP BY doc_id""",
)
def x9(spark, d):
    return sf.event_summary(sf.scan_text(_texts(spark, d), ["doc_id"], "text"), ["doc_id"])


@query("u5_violation_types", f"WITH {_hits_sql()} SELECT lang, string_agg(DISTINCT violation_type, ',' ORDER BY violation_type) AS types FROM h JOIN documents USING (doc_id) GROUP BY lang")
def u5(spark, d):
    h = sf.hits(v.table(spark, d, "documents"), ["lang"], "text")
    return h.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("violation_type")), ",").alias("types"))  # three types


@query(
    "t11_security_advice",
    f"""WITH {_hits_sql()}, g AS (SELECT lang, bool_or(violation_type = 'pii_detected') AS p, bool_or(violation_type = 'secrets_exposed') AS s, bool_or(violation_type = 'toxic_content') AS t,
        bool_or(severity = 'critical') AS c FROM h JOIN documents USING (doc_id) GROUP BY 1),
    l AS (SELECT lang, list_filter([CASE WHEN p THEN 'Implement data anonymization before processing' END, CASE WHEN p THEN 'Review PII handling procedures' END, CASE WHEN s THEN 'Immediate secret rotation required' END,
        CASE WHEN s THEN 'Implement secrets scanning in CI/CD pipeline' END, CASE WHEN t THEN 'Content moderation review required' END, CASE WHEN t THEN 'Update content filtering policies' END,
        CASE WHEN c THEN 'Halt processing until critical security issues resolved' END], lambda x: x IS NOT NULL) AS a FROM g)
    SELECT lang, array_to_string(a[1:5], '|') AS advice FROM l""",
)
def t11(spark, d):
    from tallyscope.operators.risk import advise

    h = sf.hits(v.table(spark, d, "documents"), ["lang"], "text")
    # one scan of the texts; both metrics come from its few counts
    few = h.groupBy("lang", "violation_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"))
    metrics = F.array(
        F.struct(F.col("violation_type").alias("metric"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit("critical").alias("metric"), F.col("critical").cast("double").alias("value")),
    )
    counts = few.select("lang", F.inline(metrics)).groupBy("lang", "metric").agg(F.sum("value").alias("value"))
    return advise(counts, ["lang"], "security", 5).select("lang", F.array_join("texts", "|").alias("advice"))
