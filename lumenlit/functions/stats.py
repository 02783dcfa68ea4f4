"""Statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: two-sided 1 % bar of a standard normal
Z99 = 2.576
#: uses in an edition from which an entry that had none counts as appearing
APPEARS = 8


def percentage(k: Column, n: Column, places: int = 1) -> Column:
    """Exact share in percent, halves rounded up; null without a denominator."""
    exact = k.cast("decimal(20,0)") * 100 / n.cast("decimal(10,0)")
    return F.when(n > 0, F.round(exact, places).cast("double"))


def per_1000(k: Column, n: Column, places: int = 3) -> Column:
    return F.when(n > 0, F.round(k / n * 1000, places))


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Pooled z of the second share against the first; 0 if its error is 0."""
    p = (k1 + k2) / (n1 + n2)
    se = F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    return F.when((n1 > 0) & (n2 > 0), F.when(se > 0, (k2 / n2 - k1 / n1) / se).otherwise(0.0))


def trend_state(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    z = two_proportion_z(k1, n1, k2, n2)
    return (
        F.when(~((n1 > 0) & (n2 > 0)) | n1.isNull(), "insufficient_scope")
        .when((k1 == 0) & (k2 >= APPEARS), "appearing")
        .when(z >= Z99, "rising")
        .when(z <= -Z99, "falling")
        .otherwise("no_detected_change")
    )


def p_value(z: Column) -> Column:
    """Two-sided p of z: erfc by a rational approximation (error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    # Coefficients of the approximation 7.1.26 of Abramowitz and Stegun.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def idf(n: Column, df: Column) -> Column:
    return F.ln(n / df)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length_of(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), length_of(a) * length_of(b))


def quantise_unit(x: Column) -> Column:
    """A similarity from 0 to 1 as a byte."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.round(x * 255))).cast("int")


def quantise_signed(x: Column, scale: Column) -> Column:
    """A component as a signed byte under this scale."""
    return F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x / scale * 127))).cast("int")
