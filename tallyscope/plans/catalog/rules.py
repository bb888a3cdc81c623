"""Compliance, policy and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.operators import compliance as co
from tallyscope.operators import policies as po
from tallyscope.operators import safety as sf
from tallyscope.plans import views as v
from tallyscope.plans.catalog.measures import rounded
from tallyscope.plans.registry import query

COLUMNS = ("txn_id", "session_id", "gross", "kind", "management_approved", "authorized_by", "transaction_date",
           "service_date", "contract_id", "related_revenue_id", "category", "classification")

CHECKS_SQL = """
    chk AS (
      SELECT txn_id, session_id, 'SOX Section 302' AS rule, 'SOX' AS regulation, CASE WHEN gross > 1000000 AND NOT management_approved THEN 'violation' ELSE 'pass' END AS outcome,
             'high' AS severity, 'High-value transaction without management certification' AS description FROM ledger
      UNION ALL SELECT txn_id, session_id, 'SOX Section 404', 'SOX', CASE WHEN authorized_by IS NULL THEN 'violation' ELSE 'pass' END, 'medium',
             'Transaction lacks proper authorization documentation' FROM ledger
      UNION ALL SELECT txn_id, session_id, 'GAAP Revenue Recognition', 'GAAP', CASE WHEN service_date IS NULL THEN 'warning' WHEN transaction_date < service_date THEN 'violation' ELSE 'pass' END, 'medium',
             CASE WHEN service_date IS NULL THEN 'Missing date information for revenue recognition validation' ELSE 'Revenue recognized before service performance' END
             FROM ledger WHERE kind = 'revenue'
      UNION ALL SELECT txn_id, session_id, 'GAAP Matching Principle', 'GAAP', CASE WHEN related_revenue_id IS NULL AND gross > 10000 THEN 'warning_pass' ELSE 'pass' END, NULL,
             'Large expense without clear revenue matching' FROM ledger WHERE kind = 'expense'
      UNION ALL SELECT txn_id, session_id, 'IFRS 15', 'IFRS', CASE WHEN contract_id IS NULL THEN 'violation' ELSE 'pass' END, 'medium',
             'Revenue transaction without contract identification' FROM ledger WHERE kind = 'revenue'
      UNION ALL SELECT txn_id, session_id, 'IFRS 9', 'IFRS', CASE WHEN classification IS NULL THEN 'violation' ELSE 'pass' END, 'medium',
             'Financial instrument without proper classification' FROM ledger WHERE category IN ('financial_asset', 'financial_liability'))
"""
ISSUES_SQL = CHECKS_SQL + """,
    iss AS (SELECT txn_id, session_id, rule, regulation, description, CASE WHEN outcome = 'violation' THEN 'violation' ELSE 'warning' END AS kind,
                   CASE WHEN outcome = 'violation' THEN severity END AS severity FROM chk WHERE outcome <> 'pass')
"""
RATES_SQL = CHECKS_SQL + """,
    rates AS (SELECT s.session_id, f.regulation, coalesce(checks_performed, 0) AS checks_performed, coalesce(passed_checks, 0) AS passed_checks, coalesce(violations, 0) AS violations,
                     coalesce(warnings, 0) AS warnings, coalesce(passed_checks / CAST(nullif(checks_performed, 0) AS DOUBLE), 1) AS compliance_rate
              FROM (SELECT DISTINCT session_id FROM ledger) s CROSS JOIN (SELECT unnest(['SOX', 'GAAP', 'IFRS']) AS regulation) f
              LEFT JOIN (SELECT session_id, regulation, count(*) AS checks_performed, count(*) FILTER (outcome IN ('pass', 'warning_pass')) AS passed_checks,
                                count(*) FILTER (outcome = 'violation') AS violations, count(*) FILTER (outcome IN ('warning', 'warning_pass')) AS warnings FROM chk GROUP BY 1, 2) c
              ON c.session_id = s.session_id AND c.regulation = f.regulation)
"""


def _ledger(spark, d):
    return v.ledger(spark, d, *COLUMNS)


def _issues(spark, d):
    return co.issues(_ledger(spark, d), ["txn_id", "session_id"], amount="gross")


def _rule_query(name, rule, kind):
    sql = f"WITH {ISSUES_SQL} SELECT txn_id, severity, kind, description FROM iss WHERE rule = '{rule}'"

    @query(name, sql, ["ledger"])
    def run(spark, d):
        return _issues(spark, d).where(F.col("rule") == rule).select("txn_id", "severity", "kind", "description")

    return run


_rule_query("c1_sox_certification", "SOX Section 302", "violation")
_rule_query("c2_sox_authorization", "SOX Section 404", "violation")
_rule_query("c3_gaap_revenue_timing", "GAAP Revenue Recognition", "violation")
_rule_query("c4_gaap_matching", "GAAP Matching Principle", "warning")
_rule_query("c5_ifrs_contract", "IFRS 15", "violation")
_rule_query("c6_ifrs_instruments", "IFRS 9", "violation")


@query("u1_all_issues", f"WITH {ISSUES_SQL} SELECT session_id, rule, regulation, kind, severity, count(*) AS n FROM iss GROUP BY ALL", ["ledger"])
def u1(spark, d):
    return _issues(spark, d).groupBy("session_id", "rule", "regulation", "kind", "severity").agg(F.count(F.lit(1)).alias("n"))


def _rates(spark, d):
    return co.framework_rates(_ledger(spark, d), ["session_id"], amount="gross")


@query(
    "c7_framework_rates",
    f"WITH {RATES_SQL} SELECT session_id, regulation, checks_performed, passed_checks, violations, warnings, round(compliance_rate, 6) AS compliance_rate FROM rates",
    ["ledger"],
)
def c7(spark, d):
    return rounded(_rates(spark, d))


OVERALL_SQL = RATES_SQL + """,
    ov AS (SELECT session_id, avg(compliance_rate) AS rate, CAST(sum(violations) AS BIGINT) AS v, CAST(sum(warnings) AS BIGINT) AS w FROM rates GROUP BY 1),
    nt AS (SELECT session_id, count(*) AS total_transactions FROM ledger GROUP BY 1)
"""


@query(
    "c8_overall_compliance",
    f"""WITH {OVERALL_SQL} SELECT session_id, round(rate, 6) AS overall_compliance_rate, v AS total_violations, w AS total_warnings, total_transactions,
        CASE WHEN rate >= 0.95 AND v = 0 THEN 'excellent' WHEN rate >= 0.85 AND v <= 2 THEN 'good' WHEN rate >= 0.70 THEN 'acceptable' ELSE 'poor' END AS compliance_level,
        round(v / CAST(total_transactions AS DOUBLE), 6) AS violation_rate FROM ov JOIN nt USING (session_id)""",
    ["ledger"],
)
def c8(spark, d):
    totals = v.ledger(spark, d, "session_id").groupBy("session_id").agg(F.count(F.lit(1)).alias("total_transactions"))
    return rounded(co.overall(_rates(spark, d), totals, ["session_id"]))


@query(
    "c9_compliance_advice",
    f"""WITH {RATES_SQL}, g AS (SELECT session_id, max(violations) FILTER (regulation = 'SOX') AS sox, max(violations) FILTER (regulation = 'GAAP') AS gaap,
        max(violations) FILTER (regulation = 'IFRS') AS ifrs, sum(violations) AS v, sum(warnings) AS w FROM rates GROUP BY 1)
    SELECT session_id, coalesce(nullif(concat_ws('|', CASE WHEN sox > 0 THEN 'Strengthen internal controls and management oversight processes|Implement enhanced authorization requirements for high-value transactions' END,
        CASE WHEN gaap > 0 THEN 'Review revenue recognition policies and procedures|Improve expense matching documentation and controls' END,
        CASE WHEN ifrs > 0 THEN 'Enhance contract management and identification processes|Review financial instrument classification procedures' END,
        CASE WHEN w > v THEN 'Address data quality issues to enable complete compliance validation' END), ''), 'Maintain current compliance monitoring and control procedures') AS recommendations FROM g""",
    ["ledger"],
)
def c9(spark, d):
    return co.advice(_rates(spark, d), ["session_id"]).withColumn("recommendations", F.array_join("recommendations", "|"))


CONTROLS_SQL = """
    ctl AS (SELECT account_id AS company, count(*) FILTER (category = 'signup') >= 12 AS ceo_certification, count(*) FILTER (category = 'purchase') >= 12 AS cfo_certification,
                   count(*) FILTER (category = 'error') < 14 AS icfr_assessment, CAST(count(*) FILTER (k < 8) AS INTEGER) AS disclosure_days FROM activity GROUP BY 1)
"""


def controls(spark, d):
    """Company controls read from each account's event counts."""
    c = F.col("category")
    return v.activity(spark, d).groupBy(F.col("account_id").alias("company")).agg(
        (F.count_if(c == "signup") >= 12).alias("ceo_certification"),
        (F.count_if(c == "purchase") >= 12).alias("cfo_certification"),
        (F.count_if(c == "error") < 14).alias("icfr_assessment"),
        F.count_if(F.col("k") < 8).cast("int").alias("disclosure_days"),
    )


@query(
    "c10_company_controls",
    f"""WITH {CONTROLS_SQL}, x AS (SELECT company, concat_ws('|', CASE WHEN NOT ceo_certification THEN 'Section 302: CEO certification' END, CASE WHEN NOT cfo_certification THEN 'Section 302: CFO certification' END,
        CASE WHEN NOT icfr_assessment THEN 'Section 404: ICFR assessment' END, CASE WHEN disclosure_days > 4 THEN 'Section 409: late disclosure' END) AS violations,
        (NOT ceo_certification)::INT + (NOT cfo_certification)::INT + (NOT icfr_assessment)::INT + (disclosure_days > 4)::INT AS n FROM ctl)
    SELECT company, violations, greatest(100 - 20 * n, 0) AS compliance_score FROM x""",
    ["activity"],
)
def c10(spark, d):
    out = co.company_controls(controls(spark, d))
    return out.select("company", F.array_join("violations", "|").alias("violations"), "compliance_score")


DISCLOSURE_NOTES = [("accounting_policies", 0), ("significant_estimates", 1), ("contingencies", 2), ("subsequent_events", 3),
                    ("related_party_transactions", 4), ("segment_information", 5), ("fair_value_measurements", 6)]


def disclosed(spark, d):
    """Disclosure items per source, each noted from the documents assigned to the item by key."""
    docs = v.table(spark, d, "documents")
    note = F.concat(F.lit("note "), F.col("n_chars").cast("string"))
    return docs.groupBy("source").agg(*[F.max(F.when(F.col("doc_id") % 11 == i, note)).alias(c) for c, i in DISCLOSURE_NOTES])


@query(
    "c11_disclosures",
    "WITH s AS (SELECT source, "
    + ", ".join(f"max(CASE WHEN doc_id % 11 = {i} THEN 'note ' || n_chars END) AS {c}" for c, i in DISCLOSURE_NOTES)
    + " FROM documents GROUP BY 1) SELECT source, concat_ws('|', "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN 'Missing disclosure: {c.replace('_', ' ').title()}' END" for c, _ in DISCLOSURE_NOTES)
    + ") AS missing_disclosures, coalesce(length(accounting_policies) < 100, false) AS insufficient_policies, greatest(100 - 10 * ("
    + " + ".join(f"({c} IS NULL)::INT" for c, _ in DISCLOSURE_NOTES)
    + "), 0) AS completeness_score FROM s",
)
def c11(spark, d):
    out = co.disclosures(disclosed(spark, d))
    return out.select("source", F.array_join("missing_disclosures", "|").alias("missing_disclosures"), "insufficient_policies", "completeness_score")


@query(
    "c12_threshold_rules",
    """
    SELECT txn_id, 'large_amount' AS rule_id, 'amount' AS "column", CAST(amount AS DOUBLE) AS "value" FROM ledger WHERE amount > 100000
    UNION ALL SELECT txn_id, 'bulk', 'quantity', quantity FROM ledger WHERE quantity >= 50
    UNION ALL SELECT txn_id, 'no_tax', 'tax', tax FROM ledger WHERE tax <= 0
    """,
    ["ledger"],
)
def c12(spark, d):
    rules = [("large_amount", "amount", ">", 100_000), ("bulk", "quantity", ">=", 50), ("no_tax", "tax", "<=", 0)]
    return co.threshold_rules(v.ledger(spark, d, "txn_id", "amount", "quantity", "tax"), ["txn_id"], rules)


@query(
    "c12_catalogue_coverage",
    f"""WITH {CHECKS_SQL}, n AS (SELECT regulation, rule, count(*) AS checks FROM chk GROUP BY ALL),
    k AS (SELECT * FROM (VALUES ('SOX', 'section_302', 'SOX Section 302'), ('SOX', 'section_404', 'SOX Section 404'), ('SOX', 'section_409', NULL), ('GAAP', 'revenue_recognition', 'GAAP Revenue Recognition'),
        ('GAAP', 'expense_matching', 'GAAP Matching Principle'), ('GAAP', 'asset_valuation', NULL), ('IFRS', 'ifrs_15', 'IFRS 15'), ('IFRS', 'ifrs_9', 'IFRS 9'), ('IFRS', 'ifrs_16', NULL)) t(regulation, section, rule))
    SELECT k.regulation, section, k.rule IS NOT NULL AS implemented, coalesce(checks, 0) AS checks FROM k LEFT JOIN n ON n.rule = k.rule""",
    ["ledger"],
)
def c12_coverage(spark, d):
    names = {"SOX Section 302": "section_302", "SOX Section 404": "section_404", "GAAP Revenue Recognition": "revenue_recognition",
             "GAAP Matching Principle": "expense_matching", "IFRS 15": "ifrs_15", "IFRS 9": "ifrs_9"}
    from tallyscope.functions.scores import mapped

    done = co.results(_ledger(spark, d), ["session_id"], amount="gross").groupBy(mapped(F.col("rule"), names).alias("section")).agg(F.count(F.lit(1)).alias("checks"))
    return co.rule_catalogue(spark).join(done, "section", "left").select("regulation", "section", "implemented", F.coalesce("checks", F.lit(0)).alias("checks"))


@query(
    "c13_findings_from_violations",
    f"""WITH {ISSUES_SQL} SELECT session_id AS audit_session_id, 'regulatory_compliance' AS category, severity, 'Regulatory Violation' AS title, description, 0.8::DOUBLE AS confidence_score,
        regulation AS regulatory_reference, 'open' AS status, count(*) AS n FROM iss WHERE kind = 'violation' GROUP BY ALL""",
    ["ledger"],
)
def c13(spark, d):
    out = co.to_findings(_issues(spark, d).where(F.col("kind") == "violation"), "session_id")
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


INPUT_SQL = """
    x AS (SELECT txn_id, CASE WHEN contract_id IS NOT NULL THEN amount - 2000 END AS amount, service_date, authorized_by FROM ledger)
"""


def _inputs(spark, d):
    rows = v.ledger(spark, d, "txn_id", "amount", "contract_id", "service_date", "authorized_by")
    return rows.select("txn_id", F.when(F.col("contract_id").isNotNull(), (F.col("amount") - 2000).cast(v.MONEY)).alias("amount"), "service_date", "authorized_by")


@query(
    "c14_input_violations",
    f"""WITH {INPUT_SQL} SELECT txn_id, 'missing_required_field:amount' AS violation FROM x WHERE amount IS NULL
    UNION ALL SELECT txn_id, 'missing_required_field:transaction_date' FROM x WHERE service_date IS NULL
    UNION ALL SELECT txn_id, 'missing_required_field:account_id' FROM x WHERE authorized_by IS NULL
    UNION ALL SELECT txn_id, 'invalid_amount' FROM x WHERE amount < 0 UNION ALL SELECT txn_id, 'suspicious_amount' FROM x WHERE amount > 10000000""",
    ["ledger"],
)
def c14(spark, d):
    return _inputs(spark, d).select("txn_id", F.explode(co.input_violations("amount", "service_date", "authorized_by")).alias("violation"))


@query("c15_amount_range", f"WITH {INPUT_SQL} SELECT txn_id, CAST(amount AS DOUBLE) AS amount FROM x WHERE NOT (amount BETWEEN 0 AND 1000000000)", ["ledger"])
def c15(spark, d):
    return co.out_of_range(_inputs(spark, d), "amount").select("txn_id", F.col("amount").cast("double").alias("amount"))


POLICY_VALUES = """(VALUES ('DC-001','data_classification','sarbanes_oxley gaap','blocking'),('DC-002','data_classification','sarbanes_oxley gdpr','blocking'),('AC-001','access_control','sarbanes_oxley soc2','blocking'),
    ('AC-002','access_control','sarbanes_oxley soc2','blocking'),('AC-003','access_control','sarbanes_oxley','warning'),('EN-001','encryption','sarbanes_oxley gdpr','blocking'),
    ('EN-002','encryption','sarbanes_oxley iso27001','blocking'),('AL-001','audit_logging','sarbanes_oxley soc2','blocking'),('AL-002','audit_logging','sarbanes_oxley','blocking'),
    ('CP-001','compliance','sarbanes_oxley','blocking'),('CP-002','compliance','sarbanes_oxley gaap','blocking')) p(policy_id, policy_type, frameworks, enforcement_level)"""
CONTEXT_SQL = """
    ctx AS (SELECT id, k % 2 = 0 AS data_classified, k % 3 <> 0 AS user_authenticated, k % 5 <> 0 AS mfa_verified, k % 7 <> 0 AS data_encrypted,
                   CASE WHEN k % 11 <> 0 THEN true END AS audit_logged FROM activity)
"""


def contexts(spark, d):
    k = F.col("k")
    return v.activity(spark, d).select(
        "id", (k % 2 == 0).alias("data_classified"), (k % 3 != 0).alias("user_authenticated"), (k % 5 != 0).alias("mfa_verified"),
        (k % 7 != 0).alias("data_encrypted"), F.when(k % 11 != 0, F.lit(True)).alias("audit_logged"),
    )


VIOLATIONS_SQL = f"""{CONTEXT_SQL}, j AS (SELECT * FROM ctx CROSS JOIN {POLICY_VALUES}),
    pv AS (SELECT id, policy_id, 'Data must be classified according to policy' AS violation FROM j WHERE policy_type = 'data_classification' AND NOT data_classified
    UNION ALL SELECT id, policy_id, 'User must be authenticated' FROM j WHERE policy_type = 'access_control' AND NOT user_authenticated
    UNION ALL SELECT id, policy_id, 'Multi-factor authentication required' FROM j WHERE policy_id = 'AC-002' AND NOT mfa_verified
    UNION ALL SELECT id, policy_id, 'Data must be encrypted according to policy' FROM j WHERE policy_type = 'encryption' AND NOT data_encrypted
    UNION ALL SELECT id, policy_id, 'Action must be audit logged' FROM j WHERE policy_type = 'audit_logging' AND audit_logged IS NULL)"""


@query("j8_policy_checks", f"WITH {VIOLATIONS_SQL} SELECT * FROM pv", ["activity"])
def j8(spark, d):
    return po.check(contexts(spark, d), po.policy_dimension(spark), ["id"])


@query(
    "p7_policy_lookup",
    f"""WITH {VIOLATIONS_SQL} SELECT pv.policy_id, policy_type, count(*) AS n FROM pv JOIN {POLICY_VALUES} ON p.policy_id = pv.policy_id
    WHERE enforcement_level = 'blocking' AND list_contains(string_split(frameworks, ' '), 'soc2') GROUP BY ALL""",
    ["activity"],
)
def p7(spark, d):
    chosen = po.lookup(po.policy_dimension(spark), framework="soc2", blocking=True)
    return po.check(contexts(spark, d), chosen, ["id"]).join(F.broadcast(chosen.select("policy_id", "policy_type")), "policy_id").groupBy("policy_id", "policy_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "x8_encryption_required",
    """
    SELECT id, CASE k % 6 WHEN 0 THEN 'ssn' WHEN 1 THEN 'credit_card' WHEN 2 THEN 'bank_account' WHEN 3 THEN 'api_key' WHEN 4 THEN 'email' ELSE 'phone' END AS data_type
    FROM activity WHERE k % 6 < 4 AND NOT (k % 5 = 0)
    """,
    ["activity"],
)
def x8(spark, d):
    names = F.array(*[F.lit(x) for x in ("ssn", "credit_card", "bank_account", "api_key", "email", "phone")])
    catalog = v.activity(spark, d).select("id", F.element_at(names, F.col("k") % 6 + 1).alias("data_type"), (F.col("k") % 5 == 0).alias("encrypted"))
    return sf.needs_encryption(catalog, "data_type", "encrypted").select("id", "data_type")


@query(
    "x10_access_rules",
    """
    WITH q AS (SELECT id, CASE WHEN account_id % 10 = 0 THEN 'admin_' WHEN account_id % 3 = 0 THEN 'auditor_' ELSE 'user_' END || account_id AS user_id,
                      CASE category WHEN 'view' THEN 'read' WHEN 'click' THEN 'analyze' WHEN 'purchase' THEN 'write' ELSE 'audit' END AS action,
                      CASE WHEN k % 3 = 0 THEN 'dashboard' WHEN k % 3 = 1 THEN 'reports' ELSE 'ledger' END AS resource FROM activity)
    SELECT id, user_id, action, resource, CASE WHEN starts_with(user_id, 'admin_') THEN true WHEN starts_with(user_id, 'auditor_') THEN action IN ('read', 'audit', 'analyze')
           ELSE action = 'read' AND resource IN ('dashboard', 'reports') END AS allowed FROM q
    """,
    ["activity"],
)
def x10(spark, d):
    q = requests(spark, d)
    return q.withColumn("allowed", sf.allowed(F.col("user_id"), F.col("resource"), F.col("action"))).select("id", "user_id", "action", "resource", "allowed")


def requests(spark, d):
    """Access requests read from the events: user by account, action by type, resource by attribute."""
    a, k, c = F.col("account_id"), F.col("k"), F.col("category")
    prefix = F.when(a % 10 == 0, "admin_").when(a % 3 == 0, "auditor_").otherwise("user_")
    return v.activity(spark, d).select(
        "id", "ts", F.concat(prefix, a.cast("string")).alias("user_id"),
        F.when(c == "view", "read").when(c == "click", "analyze").when(c == "purchase", "write").otherwise("audit").alias("action"),
        F.when(k % 3 == 0, "dashboard").when(k % 3 == 1, "reports").otherwise("ledger").alias("resource"),
    )


@query(
    "u4_anomaly_union",
    f"""WITH {ISSUES_SQL} SELECT type, count(*) AS n FROM (SELECT 'regulatory' AS type FROM iss WHERE kind = 'violation' UNION ALL SELECT type FROM anomalies) GROUP BY 1""",
    ["ledger", "anomalies"],
)
def u4(spark, d):
    reg = _issues(spark, d).where(F.col("kind") == "violation").select(F.lit("regulatory").alias("type"), F.col("txn_id").alias("item"))
    return reg.unionByName(v.anomalies(spark, d).select("type", F.col("anomaly_id").cast("string").alias("item"))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
