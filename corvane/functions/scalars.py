"""Scalar helpers that Spark has no function of its own for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_last(text: Column, sep: str = "_") -> tuple[Column, Column]:
    """What stands before and after the last separator."""
    pattern = rf"^(.*){sep}([^{sep}]*)$"
    return F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)


def count_items(text: Column, sep: str = "|") -> Column:
    """Items of a delimited list; 0 for empty, None and null."""
    return F.when(text.isNull() | text.isin("", "None"), 0).otherwise(F.size(F.split(text, "[" + sep + "]")))


def safe_divide(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def ppm_error(a: Column, b: Column, miss: float = 50.0) -> Column:
    """Parts per million between a and b; `miss` where there is no b."""
    return F.coalesce(F.abs(a - b) / a * 1e6, F.lit(miss))


def clean_number(text: Column) -> Column:
    """A number read from text, 0 where there is none or it is NaN."""
    number = text.try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def decibel_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def spaced(low: float, high: float, n: int, geometric: bool = False) -> Column:
    """An array of n values from low to high at even distances or ratios."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    if geometric:
        return F.transform(steps, lambda i: low * F.pow(F.lit(high / low), i / float(n - 1)))
    return F.transform(steps, lambda i: low + (high - low) * i / float(n - 1))


def half(value: Column) -> Column:
    """A number as half precision holds it, as a double: 11 significant bits, halves to even, 2 ** -24 apart below 2 ** -14, infinite from 65520 on."""
    v = value.cast("double")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-14)) - 10)
    held = F.when(v == 0, v).otherwise(F.rint(v / step) * step)
    return F.when(F.abs(v) >= 65520, F.signum(v) * float("inf")).when(F.isnan(v), v).otherwise(held)


def formula_mass(formula: Column) -> Column:
    """Monoisotopic mass of a formula text such as C6H12O6; null for null, empty or other text and for elements of unknown mass."""
    from .kernels import MASSES

    known = F.create_map(*[F.lit(x) for pair in MASSES.items() for x in pair])
    parts = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9]*)"), F.lit(0))
    count = lambda x: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(x, "[0-9]+", 0), F.lit("")), F.lit("999999")), F.lit(1)).cast("double")
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + F.try_element_at(known, F.regexp_extract(x, "[A-Za-z]+", 0)) * count(x))
    return F.when(formula.rlike("^([A-Z][a-z]?[0-9]*)+$"), total)
