"""Leading-digit expressions. All are native columns over doubles or decimals."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _integer_text(x: Column) -> Column:
    # cast through bigint: a large double prints in exponent form
    return F.abs(x.cast("double")).cast("bigint").cast("string")


def _plain_text(x: Column) -> Column:
    return F.abs(x.cast("double")).cast("decimal(38,10)").cast("string")


def _usable(x: Column) -> Column:
    return x.isNotNull() & (x != 0)


def integer_digit(x: Column, position: int = 1) -> Column:
    """Digit of the integer part at ``position``; null when absent. Values in (0,1) give 0."""
    if position not in (1, 2):
        raise ValueError("only digit positions 1 and 2 are supported")
    text = _integer_text(x)
    return F.when(_usable(x) & (F.length(text) >= position), F.substring(text, position, 1).cast("int"))


def significant_digit(x: Column) -> Column:
    """First non-zero digit of the value written with ten decimals."""
    text = F.regexp_extract(_plain_text(x), "[1-9]", 0)
    return F.when(_usable(x) & (text != ""), text.cast("int"))


def digit_pair(x: Column) -> Column:
    """First two digits as written; values below 1 have no pair."""
    text = F.regexp_replace(_plain_text(x), "[.]", "")
    pair = F.substring(text, 1, 2)
    return F.when(
        _usable(x) & (F.substring(text, 1, 1) != "0"),
        F.struct(F.substring(pair, 1, 1).cast("int").alias("d1"), F.substring(pair, 2, 1).cast("int").alias("d2")),
    )


def leading_two(x: Column) -> Column:
    """First two digits of the integer part as a number 10..99; null below 10."""
    text = _integer_text(x)
    return F.when(_usable(x) & (F.length(text) >= 2), F.substring(text, 1, 2).cast("int"))


def text_digit(amount: Column) -> Column:
    """First character of a decimal's text as a digit (positive amounts)."""
    return F.left(amount.cast("string"), F.lit(1)).cast("int")
