"""Machine-readable zone of passports (ICAO Doc 9303, TD3) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published standard: line length, weights, and the last digit of every
# character's value (digits 0-9, letters 10-35, filler 0).
LINE_LENGTH = 44
WEIGHTS = (7, 3, 1)
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ<"
LAST_DIGITS = "012345678901234567890123450"


def cut(text: Column, start: int, end: int) -> Column:
    """Characters ``[start, end)``, counted from zero."""
    return F.substring(text, start + 1, end - start)


def last_digits(text: Column) -> Column:
    """Last digit of every character's value. Only that matters for a sum modulo 10."""
    return F.transform(F.split(F.translate(text, LETTERS, LAST_DIGITS), ""), lambda c: F.ascii(c) - ord("0"))


def weighted_digit(digits: Column, length: int) -> Column:
    """Weighted sum modulo 10 over ``length`` last digits, as text."""
    weights = F.array(*[F.lit(WEIGHTS[i % 3]) for i in range(length)])
    products = F.zip_with(digits, weights, lambda d, w: d * w)
    return (F.aggregate(products, F.lit(0), lambda total, p: total + p) % 10).cast("string")


def check_digit(text: Column, length: int) -> Column:
    """Check digit of a text of ``length`` characters."""
    return weighted_digit(last_digits(text), length)


def short_date(raw: Column, birth: bool, current_year: int) -> Column:
    """``YYMMDD`` as a date, null when it is none. Only birth dates can lie in the last century."""
    last_century = F.when(cut(raw, 0, 2) > f"{current_year % 100:02d}", F.lit("19"))
    century = last_century.otherwise(F.lit("20")) if birth else F.lit("20")
    text = F.concat(century, cut(raw, 0, 2), F.lit("-"), cut(raw, 2, 4), F.lit("-"), cut(raw, 4, 6))
    return F.when(raw.rlike("^[0-9]{6}$"), text.try_cast("date"))


def filled_name(field: Column) -> Column:
    """``SURNAME<<GIVEN<NAMES`` as ``GIVEN NAMES SURNAME``."""
    halves = F.transform(F.split(field, "<<", 2), lambda half: F.trim(F.translate(half, "<", " ")))
    return F.trim(F.array_join(F.reverse(halves), " "))
