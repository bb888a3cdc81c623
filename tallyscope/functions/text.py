"""Tokens and field extraction from financial text, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyscope.constants import STOPWORDS

MONEY = r"\$\s?([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
MONEY_CODE_AFTER = r"([0-9][0-9,]*\.[0-9]{2})\s(?:USD|EUR|GBP)"
MONEY_CODE_BEFORE = r"(?:USD|EUR|GBP)\s([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
COMPANY = r"([A-Z][A-Za-z0-9&]*(?: [A-Z][A-Za-z0-9&]*)* (?:Inc|Ltd|LLC|Corp|Corporation|Company)\b)"


def words(text: Column, min_length: int = 3, drop_stopwords: bool = False) -> Column:
    """Lower-case words of ASCII letters only; a word with any other letter or digit is no word."""
    pieces = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    kept = F.filter(pieces, lambda w: w.rlike("^[a-z]{%d,}$" % min_length))
    if drop_stopwords:
        kept = F.filter(kept, lambda w: ~w.isin(STOPWORDS))
    return kept


def _numbers(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("decimal(20,2)"))


def amounts(text: Column) -> Column:
    """Amounts written ``$1,234.56``, ``2,500.00 USD`` or ``EUR 999.99``, in that order of form."""
    found = F.concat(*[_numbers(text, p) for p in (MONEY, MONEY_CODE_AFTER, MONEY_CODE_BEFORE)])
    return F.filter(found, lambda x: x.isNotNull())


def dates(text: Column) -> Column:
    """Dates written ``12/15/2023``, ``2024-01-15`` or ``Jan 15, 2024`` (long months too)."""

    def all_of(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def parsed(found: Column, fmt: str) -> Column:
        return F.transform(found, lambda x: F.try_to_timestamp(x, F.lit(fmt)).cast("date"))

    short = F.transform(
        all_of(rf"(?:{MONTHS})[a-z]* [0-9]{{1,2}}, [0-9]{{4}}"),
        lambda x: F.regexp_replace(x, "^([A-Z][a-z]{2})[a-z]* ", "$1 "),
    )
    found = F.concat(
        parsed(all_of("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"), "M/d/yyyy"),
        parsed(all_of("[0-9]{4}-[0-9]{2}-[0-9]{2}"), "yyyy-MM-dd"),
        parsed(short, "MMM d, yyyy"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def invoice_number(text: Column) -> Column:
    """Number after ``#INV-``; otherwise one derived from the text's hash."""
    found = F.regexp_extract(text, "#(INV-[A-Za-z0-9]+)", 1)
    return F.when(found != "", found).otherwise(F.concat(F.lit("INV-"), F.left(F.sha2(text, 256), F.lit(8))))


def vendor_names(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(COMPANY), F.lit(1)))


def currencies(text: Column) -> Column:
    codes = F.regexp_extract_all(text, F.lit(r"\b(USD|EUR|GBP|JPY)\b"), F.lit(1))
    signs = F.filter(F.array(F.when(F.contains(text, F.lit("$")), F.lit("USD"))), lambda x: x.isNotNull())
    return F.sort_array(F.array_distinct(F.concat(codes, signs)))


def line_items(text: Column) -> Column:
    """Rows (line_number, description, amount) of tab-separated lines that end in a money field."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda line, i: F.struct(
            (i + 1).alias("line_number"),
            F.trim(F.element_at(F.split(line, "\t"), 1)).alias("description"),
            F.regexp_replace(F.regexp_extract(line, r"\t\$?([0-9][0-9,]*\.[0-9]{2})\s*$", 1), ",", "")
            .try_cast("double")
            .alias("amount"),
        ),
    )
    return F.filter(lines, lambda x: x["amount"].isNotNull())


def document_class(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.rlike("balance_sheet|financial_position"), "balance_sheet")
        .when(low.rlike("invoice|inv_|bill|receipt"), "invoice")
        .otherwise("other")
    )
