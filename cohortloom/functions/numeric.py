"""Scalar expressions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Training weight per severity grade (comparison runs, then network training runs).
COMPARISON_MULTIPLIER = {0: 1.0, 1: 1.0, 2: 2.0, 3: 3.0}
TRAINING_MULTIPLIER = {0: 1.0, 1: 1.0, 2: 1.5, 3: 2.0}
# Soft label per severity grade; an unknown grade counts as 1.0.
SOFT_LABEL = {0: 0.0, 1: 0.6, 2: 0.8, 3: 1.0}
# Sensor range in degrees Celsius.
RANGE_LOW = 15.0
RANGE_HIGH = 40.0


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def coerce_numeric(text: Column) -> Column:
    """Text to double; `missing`, empty, malformed and NaN become NULL.

    The JVM parser also takes type suffixes (`1d`) and hex floats; those are not numbers here.
    """
    plain = F.when(~text.rlike(r"(?i)[0-9.][df]\s*$|x"), text)
    return null_if_nan(plain.try_cast("double"))


def prefer(primary: Column, fallback: Column) -> Column:
    """Primary text unless it is NULL, empty or `missing`; else the fallback; else empty text."""
    return F.coalesce(F.when(~primary.isin("", "missing"), primary), fallback, F.lit(""))


def logit(prob: Column, eps: float = 1e-6) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), prob))
    return F.ln(p / (F.lit(1.0) - p))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def mean_of_present(*parts: Column) -> Column:
    """Mean of the non-NULL arguments, NULL when all are missing."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    count = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.try_divide(total, count.cast("double"))


def grade_lookup(grade: Column, table: dict[int, float], default: float) -> Column:
    chain = F
    for key, value in table.items():
        chain = chain.when(grade == key, F.lit(value))
    return chain.otherwise(F.lit(default))


def severity_multiplier(severity: Column, table: dict[int, float] | None = None, missing_grade: int = 1) -> Column:
    grade = F.coalesce(severity.cast("int"), F.lit(missing_grade))
    return grade_lookup(grade, table or COMPARISON_MULTIPLIER, 1.0)


def soft_label(severity: Column) -> Column:
    return grade_lookup(severity.cast("int"), SOFT_LABEL, 1.0)


def regression_target(severity: Column) -> Column:
    return F.when(severity >= 3, 1.0).when(severity >= 2, 0.5).otherwise(0.0)


def range_normalise(value: Column, low: float = RANGE_LOW, high: float = RANGE_HIGH) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - F.lit(low)) / F.lit(high - low)))


def blend(a: Column, b: Column, alpha: Column | float) -> Column:
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return alpha * a + (F.lit(1.0) - alpha) * b
