"""Security policy dimension, lookups and checks of usage contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.constants import POLICIES


def policy_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        POLICIES,
        "policy_id string, name string, policy_type string, frameworks array<string>, enforcement_level string, "
        "review_date string, owner string",
    )


def lookup(policies: DataFrame, policy_type=None, framework=None, policy_id=None, blocking=False) -> DataFrame:
    out = policies
    if policy_type:
        out = out.where(F.col("policy_type") == policy_type)
    if framework:
        out = out.where(F.array_contains("frameworks", framework))
    if policy_id:
        out = out.where(F.col("policy_id") == policy_id)
    return out.where(F.col("enforcement_level") == "blocking") if blocking else out


def check(contexts: DataFrame, policies: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of the policies by the contexts.

    Contexts carry data_classified, user_authenticated, mfa_verified, data_encrypted and
    audit_logged; a missing flag counts as false. Compliance policies have no check. A
    context yields its failed checks first, and those meet the policies of their type.
    """

    def failed(flag, policy_type, text, only=None):
        hit = F.struct(F.lit(policy_type).alias("policy_type"), F.lit(only).cast("string").alias("only"), F.lit(text).alias("violation"))
        return F.when(~F.coalesce(F.col(flag), F.lit(False)), hit)

    found = F.array(
        failed("data_classified", "data_classification", "Data must be classified according to policy"),
        failed("user_authenticated", "access_control", "User must be authenticated"),
        failed("mfa_verified", "access_control", "Multi-factor authentication required", "AC-002"),
        failed("data_encrypted", "encryption", "Data must be encrypted according to policy"),
        failed("audit_logged", "audit_logging", "Action must be audit logged"),
    )
    rows = contexts.select(*keys, F.explode(F.filter(found, lambda h: h.isNotNull())).alias("h")).select(*keys, "h.*")
    met = rows.join(policies.select("policy_id", "policy_type"), "policy_type")
    return met.where(F.col("only").isNull() | (F.col("only") == F.col("policy_id"))).select(*keys, "policy_id", "violation")
