"""Thresholds, weights, word lists, patterns and message texts.

These must hold exactly for results to agree, so they stand here together as data.
"""

# Chi-square critical values by degrees of freedom and confidence.
CHI2_CRITICAL = {
    (8, 0.90): 13.362, (8, 0.95): 15.507, (8, 0.99): 20.090,
    (9, 0.90): 14.684, (9, 0.95): 16.919, (9, 0.99): 21.666,
}
# Rounded df-8 values the engine-style test uses at both digit positions.
ENGINE_CRITICAL = {0.95: 15.51, 0.99: 20.09}

# Minimum score for (medium, high, critical) on each of the level scales.
RISK_SCALES = {
    "utility": (0.6, 0.8, 0.9),
    "calculator": (0.5, 0.7, 0.85),
    "workflow": (0.4, 0.6, 0.8),
    "assessment": (0.2, 0.5, 0.8),
    "engine": (0.3, 0.6, 0.8),
}

METHOD_WEIGHTS = {
    "benford_1": 0.25, "benford_2": 0.15, "zipf": 0.15, "isolation_forest": 0.20,
    "pyod_ensemble": 0.25, "reinforcement_learning": 0.30,
}
METHOD_CONFIDENCE = {
    "benford_1": 0.9, "benford_2": 0.9, "zipf": 0.8, "isolation_forest": 0.85,
    "pyod_ensemble": 1.0, "reinforcement_learning": 0.5,
}

OVERALL_RISK_WEIGHTS = {
    "statistical_deviation": 0.25, "regulatory_violations": 0.30, "anomaly_detection": 0.25,
    "volume_analysis": 0.10, "trend_analysis": 0.10,
}

FINDING_SEVERITY_SCORE = {"critical": 0.9, "high": 0.7, "medium": 0.5, "low": 0.3}
ANOMALY_SEVERITY_SCORE = {"high": 0.8, "medium": 0.5, "low": 0.3, "very_low": 0.1}
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "unknown": 0}
SAFETY_WEIGHT = {"low": 0.1, "medium": 0.3, "high": 0.7, "critical": 1.0}

STOPWORDS = [
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be",
    "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can",
    "shall", "must", "a", "an",
]

SENSITIVE_KEYWORDS = ["fraud", "steal", "embezzle", "corrupt", "illegal"]

DANGEROUS_CHARACTERS = "<>\"'&;()|`"

# Sensitive-data scan: (name, pattern, severity), matched without case.
SCAN_PATTERNS = [
    ("ssn", r"\b[0-9]{3}-?[0-9]{2}-?[0-9]{4}\b", "critical"),
    ("credit_card", r"\b(?:[0-9]{4}[-\s]?){3}[0-9]{4}\b", "critical"),
    ("bank_account", r"\b[0-9]{8,17}\b", "critical"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "high"),
    ("phone", r"\b[0-9]{3}-?[0-9]{3}-?[0-9]{4}\b", "high"),
    ("ip_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "medium"),
    ("api_key", r"\b[A-Za-z0-9]{32,}\b", "critical"),
    ("aws_key", r"\bAKIA[0-9A-Z]{16}\b", "critical"),
]

# Financial patterns: (name, pattern, severity), matched with case.
FINANCIAL_PATTERNS = [
    ("credit_card", r"\b(?:[0-9]{4}[-\s]?){3}[0-9]{4}\b", "high"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "high"),
    ("bank_account", r"\b[0-9]{8,17}\b", "medium"),
    ("routing_number", r"\b[0-9]{9}\b", "medium"),
    ("suspicious_amounts", r"\$\s*(?:9{4,}|0\.01)\b", "medium"),
]

# Secret assignments: (name, pattern); group 1 is the secret.
SECRET_PATTERNS = [
    ("api_key", r"""[aA][pP][iI]_?[kK][eE][yY]\s*[:=]\s*["']?([a-zA-Z0-9_-]{20,})["']?"""),
    ("password", r"""[pP][aA][sS][sS][wW][oO][rR][dD]\s*[:=]\s*["']?([^"'\s]{8,})["']?"""),
    ("token", r"""[tT][oO][kK][eE][nN]\s*[:=]\s*["']?([a-zA-Z0-9_-]{20,})["']?"""),
]

ENCRYPTED_TYPES = ["ssn", "credit_card", "bank_account", "api_key"]

WORKFLOW_STEPS = [
    "initialize", "ingest_and_parse", "statistical_analysis", "regulatory_validation", "rl_anomaly_detection",
    "consolidate_results", "human_review_mcp", "deep_dive_investigation", "generate_report",
]

FILE_EXTENSIONS = [".pdf", ".csv", ".xlsx", ".xls", ".txt", ".json"]
MAX_FILE_BYTES = 50 * 1024 * 1024

RETENTION_DAYS = 2555

DISCLOSURE_ITEMS = [
    "accounting_policies", "significant_estimates", "contingencies", "subsequent_events",
    "related_party_transactions", "segment_information", "fair_value_measurements",
]

REWARD = {"tp": 10, "tn": 1, "fp": -5, "fn": -20}

STRESS_SCENARIOS = [
    ("economic_downturn", {"revenue_change": -0.25, "cost_increase": 0.15, "credit_loss_rate": 0.08}),
    ("interest_rate_shock", {"interest_rate_increase": 0.03, "debt_refinancing_cost": 0.02}),
    ("market_crash", {"asset_value_decline": -0.40, "liquidity_constraints": 1.0}),
]

# Security policies: id, name, type, frameworks, enforcement, review date, owner.
POLICIES = [
    ("DC-001", "Financial Data Classification", "data_classification", ["sarbanes_oxley", "gaap"], "blocking", "2024-12-31", "CISO"),
    ("DC-002", "Sensitive Data Handling", "data_classification", ["sarbanes_oxley", "gdpr"], "blocking", "2024-12-31", "Data Protection Officer"),
    ("AC-001", "Role-Based Access Control", "access_control", ["sarbanes_oxley", "soc2"], "blocking", "2024-06-30", "Security Team"),
    ("AC-002", "Multi-Factor Authentication", "access_control", ["sarbanes_oxley", "soc2"], "blocking", "2024-12-31", "Identity Management Team"),
    ("AC-003", "Session Management", "access_control", ["sarbanes_oxley"], "warning", "2024-12-31", "Application Security Team"),
    ("EN-001", "Data Encryption Standards", "encryption", ["sarbanes_oxley", "gdpr"], "blocking", "2024-12-31", "Cryptography Team"),
    ("EN-002", "Key Management", "encryption", ["sarbanes_oxley", "iso27001"], "blocking", "2024-06-30", "Cryptography Team"),
    ("AL-001", "Comprehensive Audit Logging", "audit_logging", ["sarbanes_oxley", "soc2"], "blocking", "2024-12-31", "Security Operations Team"),
    ("AL-002", "Log Retention and Protection", "audit_logging", ["sarbanes_oxley"], "blocking", "2024-12-31", "Records Management Team"),
    ("CP-001", "SOX IT General Controls", "compliance", ["sarbanes_oxley"], "blocking", "2024-12-31", "Compliance Team"),
    ("CP-002", "Financial Reporting Controls", "compliance", ["sarbanes_oxley", "gaap"], "blocking", "2024-12-31", "Financial Controller"),
]

# Rule catalogue: framework, section, title. Three entries have no check behind them.
RULE_CATALOGUE = [
    ("SOX", "section_302", "CEO/CFO Certification", True),
    ("SOX", "section_404", "Internal Controls Assessment", True),
    ("SOX", "section_409", "Real-time Disclosure", False),
    ("GAAP", "revenue_recognition", "Revenue Recognition", True),
    ("GAAP", "expense_matching", "Matching Principle", True),
    ("GAAP", "asset_valuation", "Asset Valuation", False),
    ("IFRS", "ifrs_15", "Revenue from Contracts with Customers", True),
    ("IFRS", "ifrs_9", "Financial Instruments", True),
    ("IFRS", "ifrs_16", "Leases", False),
]

# Contamination rates by mode: (conservative, standard, aggressive) sensitivity.
CONTAMINATION = {
    "standard": (0.05, 0.10, 0.15),
    "conservative": (0.03, 0.05, 0.08),
    "aggressive": (0.08, 0.15, 0.20),
    "custom": (0.05, 0.10, 0.15),
}

COMPLIANCE_ADVICE = [
    ("SOX", "Strengthen internal controls and management oversight processes"),
    ("SOX", "Implement enhanced authorization requirements for high-value transactions"),
    ("GAAP", "Review revenue recognition policies and procedures"),
    ("GAAP", "Improve expense matching documentation and controls"),
    ("IFRS", "Enhance contract management and identification processes"),
    ("IFRS", "Review financial instrument classification procedures"),
]
COMPLIANCE_MORE_WARNINGS = "Address data quality issues to enable complete compliance validation"
COMPLIANCE_ALL_CLEAR = "Maintain current compliance monitoring and control procedures"

# Advice rules: (set, sequence, metric, comparison, bound, text).
ADVICE_RULES = [
    ("risk_factors", 1, "benford", ">", 0.6, "Unusual digit distribution patterns"),
    ("risk_factors", 2, "zipf", ">", 0.6, "Atypical text patterns"),
    ("risk_factors", 3, "isolation_forest", ">", 0.7, "Statistical outliers detected"),
    ("risk_factors", 4, "pyod_ensemble", ">", 0.7, "Multiple ML methods agree on anomalies"),
    ("risk_factors", 5, "reinforcement_learning", ">", 0.7, "Adaptive AI flagged unusual patterns"),
    ("risk_factors", 6, "overall", ">", 0.8, "Multiple detection methods in agreement"),
    ("portfolio", 1, "level_critical", ">=", 1.0, "Immediate escalation to senior management required"),
    ("portfolio", 2, "level_critical", ">=", 1.0, "Consider suspending related transactions pending investigation"),
    ("portfolio", 3, "level_critical", ">=", 1.0, "Engage external audit specialists if needed"),
    ("portfolio", 4, "level_high", ">=", 1.0, "Prioritize investigation of high-risk findings"),
    ("portfolio", 5, "level_high", ">=", 1.0, "Implement enhanced monitoring controls"),
    ("portfolio", 6, "level_high", ">=", 1.0, "Schedule follow-up review within 30 days"),
    ("portfolio", 7, "level_medium", ">=", 1.0, "Review and validate medium-risk findings"),
    ("portfolio", 8, "level_medium", ">=", 1.0, "Consider implementing additional controls"),
    ("portfolio", 9, "level_medium", ">=", 1.0, "Monitor for trend development"),
    ("portfolio", 10, "level_low", ">=", 1.0, "Continue routine monitoring and controls"),
    ("portfolio", 11, "concentration_risk", ">", 0.1, "Address concentration of issues in specific areas"),
    ("portfolio", 12, "finding_count", ">", 10.0, "Consider process improvements to reduce finding frequency"),
    ("portfolio", 13, "max_finding_risk", ">", 0.8, "Focus immediate attention on highest-risk finding"),
    ("security", 1, "pii_detected", ">", 0.0, "Implement data anonymization before processing"),
    ("security", 2, "pii_detected", ">", 0.0, "Review PII handling procedures"),
    ("security", 3, "secrets_exposed", ">", 0.0, "Immediate secret rotation required"),
    ("security", 4, "secrets_exposed", ">", 0.0, "Implement secrets scanning in CI/CD pipeline"),
    ("security", 5, "toxic_content", ">", 0.0, "Content moderation review required"),
    ("security", 6, "toxic_content", ">", 0.0, "Update content filtering policies"),
    ("security", 7, "fraud_indicator", ">", 0.0, "Enhanced security monitoring required"),
    ("security", 8, "fraud_indicator", ">", 0.0, "Consider manual fraud investigation"),
    ("security", 9, "critical", ">", 0.0, "Halt processing until critical security issues resolved"),
]

NEXT_STEPS = {
    "critical": ["pause_workflow", "trigger_human_review_mcp", "escalate_to_management", "prepare_emergency_report"],
    "high": ["trigger_human_review_mcp", "deep_dive_investigation", "expand_sample_size", "additional_testing"],
    "medium": ["flag_for_review", "continue_standard_procedures", "monitor_trends", "document_findings"],
    "low": ["continue_standard_procedures", "document_findings", "proceed_to_next_phase"],
}
METHOD_STEPS = [
    (["benford_1", "benford_2"], "detailed_digit_analysis"),
    (["isolation_forest", "pyod_ensemble"], "anomaly_investigation"),
    (["reinforcement_learning"], "adaptive_model_review"),
]
PRIORITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}

# Recommendations by what triggers them: (trigger, priority, category, title, timeline).
RECOMMENDATIONS = [
    ("severe_level", "CRITICAL", "Immediate Action", "Emergency Review Required", "24 hours"),
    ("benford_1", "HIGH", "Digit Analysis", "Benford's Law Deviation Investigation", "3-5 days"),
    ("benford_2", "HIGH", "Digit Analysis", "Benford's Law Deviation Investigation", "3-5 days"),
    ("isolation_forest", "HIGH", "Anomaly Detection", "Statistical Outlier Investigation", "2-4 days"),
    ("pyod_ensemble", "HIGH", "Anomaly Detection", "Statistical Outlier Investigation", "2-4 days"),
    ("reinforcement_learning", "MEDIUM", "Adaptive Analysis", "AI-Detected Behavioral Anomalies", "1 week"),
    ("low_success", "MEDIUM", "Data Quality", "Improve Data Quality for Analysis", "2 weeks"),
    ("always", "LOW", "Continuous Monitoring", "Establish Ongoing Statistical Monitoring", "1 month"),
]

LEVEL_ACTIONS = {
    "critical": ["IMMEDIATE ACTION REQUIRED", "Halt processing and conduct emergency review",
                 "Escalate to senior management and compliance team", "Consider external forensic audit"],
    "high": ["Urgent review required within 24 hours", "Increase sampling and testing procedures", "Implement additional controls"],
    "medium": ["Schedule detailed review within one week", "Monitor closely for trend development", "Consider additional testing"],
    "low": ["Continue standard monitoring procedures", "Document findings for trend analysis"],
}

DIGIT_ADVICE = {
    "first": "First digit distribution shows significant deviation from Benford's Law",
    "second": "Second digit distribution suggests potential data manipulation",
    "clear": "Data appears to conform well to Benford's Law",
    "follow_up": ["Consider investigating transactions contributing to digit anomalies",
                  "Review data collection and entry processes for potential issues"],
}

# Alert rules: name, metric, window seconds, statistic, comparison, bound, hold seconds, severity.
ALERT_RULES = [
    ("ServiceDown", "up", 60, "min", "<=", 0.0, 60, "critical"),
    ("HighErrorRate", "http_5xx", 300, "rate", ">", 0.1, 120, "warning"),
    ("HighLatency", "http_request_duration_seconds", 300, "p95", ">", 2.0, 120, "warning"),
    ("DatabaseConnectionsHigh", "database_connection_share", 60, "avg", ">", 0.8, 120, "warning"),
    ("DatabaseSlowQueries", "database_row_efficiency", 300, "avg", "<", 0.1, 300, "warning"),
    ("RedisMemoryHigh", "cache_memory_share", 60, "avg", ">", 0.9, 120, "warning"),
    ("RedisConnectionsHigh", "cache_clients", 60, "avg", ">", 100.0, 60, "warning"),
    ("HighCPUUsage", "cpu_percent", 300, "avg", ">", 85.0, 300, "warning"),
    ("HighMemoryUsage", "memory_percent", 60, "avg", ">", 90.0, 300, "critical"),
    ("LowDiskSpace", "disk_percent", 60, "avg", ">", 85.0, 120, "warning"),
    ("AuditProcessingStalled", "audits_started", 600, "count", "<=", 0.0, 300, "warning"),
    ("HighAnomalyDetectionLatency", "anomaly_detection_seconds", 300, "p95", ">", 30.0, 180, "warning"),
    ("MLModelAccuracyDrop", "model_accuracy", 60, "avg", "<", 0.85, 60, "critical"),
    ("ComplianceViolationDetected", "compliance_violations", 60, "count", ">", 0.0, 0, "critical"),
    ("SecurityScanFailure", "security_scan_failures", 300, "count", ">", 0.0, 0, "critical"),
    ("UnauthorizedAccess", "http_401", 60, "count", ">", 10.0, 60, "warning"),
    ("PrometheusTargetDown", "target_up", 60, "min", "<=", 0.0, 60, "warning"),
    ("JaegerDown", "tracing_up", 60, "min", "<=", 0.0, 120, "warning"),
    ("OtelCollectorDown", "collector_up", 60, "min", "<=", 0.0, 60, "warning"),
]
