"""Checks of identifiers by their digits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the nine-digit taxpayer number.
TAXPAYER_WEIGHTS = (7, 9, 8, 6, 5, 4, 3, 2)


def compact(value: Column) -> Column:
    """An identifier without blanks and hyphens."""
    return F.regexp_replace(value, r"[\s-]", "")


def taxpayer(value: Column) -> Column:
    """Whether nine digits end in their modulo-11 check digit; null on null."""
    digits = compact(value)
    weighed = sum(digits.substr(i + 1, 1).try_cast("int") * w for i, w in enumerate(TAXPAYER_WEIGHTS))
    return F.when(digits.rlike(r"^\d{9}$"), digits.substr(9, 1).try_cast("int") == F.pmod(10 - F.pmod(weighed, F.lit(11)), F.lit(9)) + 1).when(value.isNotNull(), F.lit(False))


def citizen(value: Column) -> Column:
    """Whether eleven digits pass the Luhn check; null on null."""
    digits = compact(value)
    return F.when(digits.rlike(r"^\d{11}$"), F.call_function("luhn_check", digits)).when(value.isNotNull(), F.lit(False))


def receipt(value: Column) -> Column:
    """Whether a text has the shape of a fiscal receipt number: B and ten digits, or E and twelve."""
    return compact(F.upper(value)).rlike(r"^(B\d{10}|E\d{12})$")
