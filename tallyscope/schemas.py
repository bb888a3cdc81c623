"""Schemas of the seven audit tables and of the update stream."""

from pyspark.sql import types as T

MONEY = T.DecimalType(20, 2)


def _schema(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


_S, _L, _F, _B, _TS, _D = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(), T.DateType()
_I = T.IntegerType()

DOCUMENTS = _schema(
    ("id", _S, False), ("filename", _S, False), ("original_filename", _S, False), ("file_path", _S, False),
    ("document_type", _S, False), ("file_size", _L, False), ("mime_type", _S), ("upload_timestamp", _TS),
    ("processing_status", _S), ("extraction_method", _S), ("confidence_score", _F), ("metadata", _S),
    ("created_at", _TS), ("updated_at", _TS),
)
CONTENT = _schema(
    ("id", _S, False), ("document_id", _S), ("content_text", _S), ("content_structure", _S), ("tables_data", _S),
    ("images_data", _S), ("financial_entities", _S), ("extraction_timestamp", _TS), ("created_at", _TS),
)
SESSIONS = _schema(
    ("id", _S, False), ("session_name", _S, False), ("client_name", _S, False), ("auditor_id", _S, False),
    ("audit_type", _S), ("fiscal_year", _I, False), ("status", _S), ("materiality_threshold", MONEY),
    ("risk_tolerance", _S), ("compliance_frameworks", _S), ("audit_scope", _S), ("progress_percentage", _F),
    ("created_at", _TS), ("updated_at", _TS), ("completed_at", _TS),
)
TRANSACTIONS = _schema(
    ("id", _S, False), ("audit_session_id", _S), ("document_id", _S), ("transaction_date", _D), ("description", _S),
    ("amount", MONEY, False), ("account_code", _S), ("account_name", _S), ("transaction_type", _S), ("currency", _S),
    ("vendor_name", _S), ("reference_number", _S), ("extracted_from_table", _B), ("confidence_score", _F),
    ("anomaly_flags", _S), ("created_at", _TS),
)
STATISTICS = _schema(
    ("id", _S, False), ("audit_session_id", _S), ("analysis_type", _S, False), ("dataset_description", _S),
    ("sample_size", _I), ("test_statistic", _F), ("p_value", _F), ("chi_square_statistic", _F),
    ("degrees_of_freedom", _I), ("anomaly_detected", _B), ("confidence_level", _F), ("analysis_results", _S),
    ("analysis_timestamp", _TS), ("created_at", _TS),
)
FINDINGS = _schema(
    ("id", _S, False), ("audit_session_id", _S), ("finding_type", _S, False), ("severity", _S, False),
    ("title", _S, False), ("description", _S, False), ("recommendation", _S), ("financial_impact", MONEY),
    ("affected_accounts", _S), ("source_documents", _S), ("ai_confidence", _F), ("human_reviewed", _B), ("status", _S),
    ("assigned_to", _S), ("due_date", _D), ("created_at", _TS), ("updated_at", _TS), ("resolved_at", _TS),
)
CHECKS = _schema(
    ("id", _S, False), ("audit_session_id", _S), ("framework", _S, False), ("rule_name", _S, False),
    ("rule_description", _S), ("check_result", _S, False), ("severity", _S), ("details", _S), ("recommendations", _S),
    ("checked_at", _TS), ("created_at", _TS),
)
UPDATES = _schema(("audit_id", _S), ("timestamp", _TS), ("event_type", _S), ("payload", _S))

TABLES = {
    "documents": DOCUMENTS, "content": CONTENT, "sessions": SESSIONS, "transactions": TRANSACTIONS,
    "statistics": STATISTICS, "findings": FINDINGS, "checks": CHECKS,
}

# Value of a column the caller leaves out or null. JSON columns get an empty object or list.
DEFAULTS = {
    "documents": {"processing_status": "completed", "metadata": "{}"},
    "content": {"content_structure": "{}", "tables_data": "[]", "images_data": "[]", "financial_entities": "{}"},
    "sessions": {
        "audit_type": "financial", "status": "active", "risk_tolerance": "medium", "compliance_frameworks": "[]",
        "audit_scope": "[]", "progress_percentage": 0.0,
    },
    "transactions": {"currency": "USD", "extracted_from_table": False, "anomaly_flags": "{}"},
    "statistics": {"anomaly_detected": False, "analysis_results": "{}"},
    "findings": {"human_reviewed": False, "status": "open"},
    "checks": {},
}
