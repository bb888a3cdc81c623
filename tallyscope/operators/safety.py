"""Personal-data, secret and keyword scans over whole texts, masking and access rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.constants import (
    ENCRYPTED_TYPES,
    FINANCIAL_PATTERNS,
    SAFETY_WEIGHT,
    SCAN_PATTERNS,
    SECRET_PATTERNS,
    SENSITIVE_KEYWORDS,
    SEVERITY_RANK,
)
from tallyscope.functions.scores import mapped, sanitized


def _hits(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _running(pieces: Column) -> Column:
    """Start and end of the matches among ``(gap, match)`` lengths.

    Adding to an array copies it, so the pieces are taken in blocks of their number's root: lengths run
    within each block, blocks' totals run over the blocks, and n matches cost n times the root of n at most.
    """
    none = F.array().cast("array<struct<start:int,stop:int>>")
    size = F.ceil(F.sqrt(F.size(pieces))).cast("int")

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + piece["gap"]
        one = F.array(F.struct(start.alias("start"), (start + piece["match"]).alias("stop")))
        return F.struct((start + piece["match"]).alias("at"), F.concat(acc["spans"], one).alias("spans"))

    def of_block(b: Column) -> Column:
        return F.aggregate(F.slice(pieces, b * size + 1, size), F.struct(F.lit(0).alias("at"), none.alias("spans")), step)

    def shifted(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        offsets = F.aggregate(blocks, start, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))
        move = lambda b, at: F.transform(b["spans"], lambda s: F.struct((s["start"] + at).alias("start"), (s["stop"] + at).alias("stop")))
        return F.flatten(F.zip_with(blocks, offsets["all"], move))

    return _let(F.transform(F.sequence(F.lit(0), F.ceil(F.size(pieces) / size).cast("int") - 1), of_block), shifted)


def _spans(text: Column, pattern: str) -> Column:
    """Start and end of every match; texts without a match are read once for the pattern, others twice."""
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def located(found: Column) -> Column:
        lengths = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        pieces = F.zip_with(F.slice(lengths, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("match")))
        return F.when(F.size(found) > 0, _let(pieces, _running)).otherwise(none)

    return _let(_hits(text, pattern), located)


def scan_text(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per match of the eight sensitive-data patterns: type, severity, start, stop."""

    def found(name: str, pattern: str, severity: str) -> Column:
        return F.transform(
            _spans(F.col(text), "(?i)" + pattern),
            lambda s: F.struct(
                F.lit(name).alias("data_type"), F.lit(severity).alias("severity"), s["start"].alias("start"), s["stop"].alias("stop")
            ),
        )

    parts = [found(*entry) for entry in SCAN_PATTERNS]
    return df.select(*keys, F.explode(F.concat(*parts)).alias("h")).select(*keys, "h.*")


def masked(text: Column) -> Column:
    """Mask in pattern order: numbers fully, then e-mail and phone in part."""
    pattern = {name: "(?i)" + p for name, p, _ in SCAN_PATTERNS}
    for name in ("ssn", "credit_card", "bank_account"):
        text = F.regexp_replace(text, pattern[name], "***MASKED***")
    text = F.regexp_replace(
        text,
        r"(?i)\b([A-Za-z0-9._%+-]{1,2})[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b",
        r"$1***@$2",
    )
    return F.regexp_replace(text, r"\b([0-9]{3})-?[0-9]{3}-?([0-9]{4})\b", "$1-***-$2")


def sanitize_and_mask(df: DataFrame) -> DataFrame:
    """Strip dangerous characters from every string column and mask what remains."""
    return df.select(
        *[
            masked(sanitized(F.col(f.name))).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def sanitize_nested(value: Column, data_type: T.DataType) -> Column:
    """Sanitise strings inside arrays, maps and structs."""
    if isinstance(data_type, T.StringType):
        return sanitized(value)
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda x: sanitize_nested(x, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(value, lambda k, v: sanitize_nested(v, data_type.valueType))
    if isinstance(data_type, T.StructType):
        return F.struct(*[sanitize_nested(value[f.name], f.dataType).alias(f.name) for f in data_type.fields])
    return value


def _hit(violation: str, detail: str, severity: str, evidence: Column, confidence: float) -> Column:
    return F.struct(
        F.lit(violation).alias("violation_type"),
        F.lit(detail).alias("detail"),
        F.lit(severity).alias("severity"),
        evidence.alias("evidence"),
        F.lit(confidence).alias("confidence"),
    )


def financial_hits(text: Column) -> Column:
    def clip(m: Column) -> Column:
        return F.when(F.length(m) > 4, F.concat(F.substring(m, 1, 4), F.lit("***"))).otherwise("***")

    def found(name: str, pattern: str, severity: str) -> Column:
        return F.transform(_hits(text, pattern), lambda m: _hit("pii_detected", name, severity, clip(m), 0.85))

    return F.concat(*[found(*entry) for entry in FINANCIAL_PATTERNS])


def secret_hits(text: Column) -> Column:
    def clip(m: Column) -> Column:
        return F.when(F.length(m) > 10, F.concat(F.substring(m, 1, 10), F.lit("..."))).otherwise(m)

    def found(name: str, pattern: str) -> Column:
        return F.transform(_hits(text, pattern, 1), lambda m: _hit("secrets_exposed", name, "critical", clip(m), 0.8))

    return F.concat(*[found(*entry) for entry in SECRET_PATTERNS])


def keyword_hits(text: Column) -> Column:
    low = F.lower(text)
    found = F.filter(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in SENSITIVE_KEYWORDS]), lambda k: k.isNotNull())
    return F.transform(
        found,
        lambda k: F.struct(
            F.lit("toxic_content").alias("violation_type"),
            k.alias("detail"),
            F.lit("medium").alias("severity"),
            k.alias("evidence"),
            F.lit(0.6).alias("confidence"),
        ),
    )


SCANS = {"financial": financial_hits, "secrets": secret_hits, "keywords": keyword_hits}


def hits(df: DataFrame, keys: Sequence[str], text: str, *scans: str) -> DataFrame:
    """Rows of the chosen scans (all three by default), each text read once."""
    found = F.concat(*[SCANS[s](F.col(text)) for s in (scans or SCANS)])
    return df.select(*keys, F.explode(found).alias("h")).select(*keys, "h.*")


def verdicts(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Risk and verdict per text: mean of weight times confidence; safe below 0.3 with nothing critical.

    The hits of one row are folded in place, so no grouping shuffle is needed.
    """
    found = F.concat(*[s(F.col(text)) for s in SCANS.values()])
    out = df.select(*keys, found.alias("_h"))
    score = F.aggregate(
        "_h", F.lit(0.0), lambda s, h: s + mapped(h["severity"], SAFETY_WEIGHT, 0.3) * h["confidence"]
    )
    critical = F.exists("_h", lambda h: h["severity"] == "critical")
    risk = F.when(F.size("_h") > 0, F.least(score / F.size("_h"), F.lit(1.0))).otherwise(0.0)
    return out.select(
        *keys, F.size("_h").alias("violations"), risk.alias("risk_score"), ((risk < 0.3) & ~critical).alias("is_safe")
    )


def risk_rollup(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same score from already exploded hits."""
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("violations"),
        F.least(F.avg(mapped(F.col("severity"), SAFETY_WEIGHT, 0.3) * F.col("confidence")), F.lit(1.0)).alias("risk_score"),
        F.bool_or(F.col("severity") == "critical").alias("has_critical"),
    )
    return out.withColumn("is_safe", (F.col("risk_score") < 0.3) & ~F.col("has_critical"))


def event_summary(rows: DataFrame, keys: Sequence[str], kind: str = "data_type") -> DataFrame:
    """Hit count, sorted distinct types and the worst severity by rank."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("violations_count"),
        F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("violation_types"),  # one entry per pattern
        F.max_by("severity", mapped(F.col("severity"), SEVERITY_RANK, 0)).alias("max_severity"),
    )


def needs_encryption(catalog: DataFrame, data_type: str, encrypted: str) -> DataFrame:
    return catalog.where(F.col(data_type).isin(ENCRYPTED_TYPES) & ~F.coalesce(F.col(encrypted), F.lit(False)))


def allowed(user: Column, resource: Column, action: Column) -> Column:
    """Access by user prefix: admins all, auditors read/audit/analyze, others read two resources."""
    return (
        F.when(user.startswith("admin_"), True)
        .when(user.startswith("auditor_"), action.isin("read", "audit", "analyze"))
        .otherwise((action == "read") & resource.isin("dashboard", "reports"))
    )
