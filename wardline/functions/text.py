"""Text and number columns: trimming, missing tokens, safe parsing, formatting."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value in delimited files.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ``translate`` deletes the characters without a counterpart and spoils letters that a cast would
# accept (exponents in decimals; inf, nan, hexadecimal and type suffixes in doubles). One call per
# value keeps the generated code small enough for the JIT compiler, unlike a chain of patterns.
DECIMAL_GUARD = ("eE,$\r", "??")
DOUBLE_GUARD = ("dDfFnNiIxXpP,$", "????????????")


def blank_to_null(c: Column) -> Column:
    """Trim spaces; an empty rest is null."""
    return F.nullif(F.trim(c), F.lit(""))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def missing_to_null(c: Column, tokens: Iterable[str] = MISSING_TOKENS) -> Column:
    return F.when(~c.isin(*tokens), c)


def remove(c: Column, *parts: str) -> Column:
    for part in parts:
        c = F.replace(c, F.lit(part), F.lit(""))
    return c


def to_int(c: Column, dtype: str = "int") -> Column:
    """Whole-number text to an integer type; fractions, other text and overflow are null."""
    return c.try_cast(dtype)


def to_decimal(c: Column, dtype: str = "decimal(14,2)") -> Column:
    """Amount text (``,`` and ``$`` ignored) to decimal; an exponent or other text is null."""
    return F.translate(c, *DECIMAL_GUARD).try_cast(dtype)


def to_double(c: Column) -> Column:
    """Amount text (``,`` and ``$`` ignored) to a finite double; other text and overflow are null."""
    return F.nullif(F.translate(c, *DOUBLE_GUARD).try_cast("double"), F.lit(float("inf")))


def plain_double(c: Column) -> Column:
    """Like :func:`to_double`, but ``$`` is not a number and only ``,`` is ignored."""
    return F.nullif(F.translate(c, "$" + DOUBLE_GUARD[0].rstrip("$"), "?" + DOUBLE_GUARD[1]).try_cast("double"), F.lit(float("inf")))


def not_negative(c: Column) -> Column:
    """Negative values become null."""
    return F.when(c >= 0, c)


def whole(c: Column, dtype: str) -> Column:
    """A double that holds a whole number as an integer type; fractions are null."""
    return F.when(c == F.floor(c), c.try_cast(dtype))


def first_digits(c: Column) -> Column:
    """The first run of digits as an integer, null without one."""
    return F.regexp_extract(c, "([0-9]+)", 1).try_cast("int")


def at_least_zero(c: Column) -> Column:
    """Negative values become zero, null stays null."""
    return F.when(c < 0, F.lit(0).cast("double")).otherwise(c)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """True where the text holds one of the words."""
    found = F.lit(False)
    for word in words:
        found = found | c.contains(word)
    return found


def one(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is null."""
    return F.when(condition, 1).otherwise(0).cast("bigint")


def ratio(part: Column, total: Column) -> Column:
    """``part / total`` as double, 0 for an empty total."""
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")), F.lit(0.0))


def plain_decimals(c: Column, digits: int) -> Column:
    """A number as text with fixed decimals and no thousands separator."""
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def iso_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
