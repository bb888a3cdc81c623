"""Record contracts: every row is checked against named constraints and routed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.scores import flags


def non_negative(c: str) -> tuple[Column, str]:
    return F.col(c).isNull() | (F.col(c) >= 0), f"{c}_non_negative"


def unit_range(c: str) -> tuple[Column, str]:
    return F.col(c).isNull() | F.col(c).between(0, 1), f"{c}_in_0_1"


def between(c: str, low, high) -> tuple[Column, str]:
    return F.col(c).isNotNull() & F.col(c).between(low, high), f"{c}_between_{low}_{high}"


def filled(c: str) -> tuple[Column, str]:
    return F.col(c).isNotNull() & (F.trim(c) != ""), f"{c}_filled"


def positive(c: str) -> tuple[Column, str]:
    return F.col(c).isNotNull() & (F.col(c) > 0), f"{c}_positive"


def session_contract() -> list[tuple[Column, str]]:
    return [filled("client_name"), between("fiscal_year", 2000, 2030), positive("materiality_threshold")]


def finding_contract() -> list[tuple[Column, str]]:
    return [unit_range("confidence"), non_negative("financial_impact")]


def invoice_contract() -> list[tuple[Column, str]]:
    return [non_negative("amount"), non_negative("tax_amount"), non_negative("discount_amount")]


def checked(df: DataFrame, contract: list[tuple[Column, str]]) -> DataFrame:
    """Add ``broken``: the names of the constraints the row violates."""
    return df.withColumn("broken", flags(*[(~F.coalesce(ok, F.lit(False)), name) for ok, name in contract]))


def split(df: DataFrame, contract: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reasons)."""
    rows = checked(df, contract)
    return rows.where(F.size("broken") == 0).drop("broken"), rows.where(F.size("broken") > 0)
