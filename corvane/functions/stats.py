"""Summary expressions that treat missing values, single values and zero denominators alike everywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# 0.975 quantiles of Student's t for 1 to 30 degrees of freedom.
T_975 = [12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963, 2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272]
NORMAL_975 = 1.96


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clean(x: Column) -> Column:
    """A double that is never NaN."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def t_quantile(n: Column) -> Column:
    """The two-sided 95 % quantile for n values; the normal one beyond the table; null for fewer than two."""
    table = F.array(*(F.lit(q) for q in T_975))
    return F.when(n < 2, None).when(n - 1 <= len(T_975), F.element_at(table, (n - 1).cast("int"))).otherwise(NORMAL_975)


def half_width_t(x: Column) -> Column:
    n = F.count(x)
    return t_quantile(n) * F.stddev_samp(x) / F.sqrt(n)


def half_width_normal(x: Column) -> Column:
    """By 1.96 standard errors, 0 for fewer than two values."""
    return F.when(F.count(x) <= 1, 0.0).otherwise(NORMAL_975 * F.stddev_samp(x) / F.sqrt(F.count(x)))


def five_numbers(x: Column) -> dict[str, Column]:
    q = F.percentile(x, F.array(*(F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0))))
    return {name: F.get(q, F.lit(i)) for i, name in enumerate(("minimum", "q1", "median", "q3", "maximum"))}


def describe(x: Column) -> dict[str, Column]:
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return {"n": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "minimum": F.min(x), "p25": F.get(q, F.lit(0)), "p50": F.get(q, F.lit(1)), "p75": F.get(q, F.lit(2)), "maximum": F.max(x)}


def confusion(truth: Column, predicted: Column) -> dict[str, Column]:
    """Accuracy, precision, recall, f1 and Matthews' correlation of 0/1 columns; 0 where undefined."""
    tp, fp, fn, tn = (F.count_if((truth == t) & (predicted == p)).cast("double") for t, p in ((1, 1), (0, 1), (1, 0), (0, 0)))
    zero = F.lit(0.0)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "accuracy": F.coalesce(F.try_divide(tp + tn, tp + fp + fn + tn), zero),
        "precision": F.coalesce(F.try_divide(tp, tp + fp), zero),
        "recall": F.coalesce(F.try_divide(tp, tp + fn), zero),
        "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero),
        "mcc": F.coalesce(F.try_divide(tp * tn - fp * fn, root), zero),
    }


def pairs_of(n: Column) -> Column:
    """How many pairs n things make."""
    return (n * (n - 1) / 2).cast("long")


def is_close(x: Column, to: float, within: float = 1e-8) -> Column:
    return F.abs(x - to) <= within


def nearest_rank_count(n: int, fraction: float, least: int) -> int:
    """How many of n a fraction is: rounded up, at least `least`, at most n."""
    return min(n, max(least, math.ceil(n * fraction)))
