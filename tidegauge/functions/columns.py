"""Column expressions that several operators share; all are JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054
#: Weights of peak, RMS and mean absolute value in the blended block score.
BLEND = (0.45, 0.35, 0.20)


def median(x: Column) -> Column:
    return F.percentile(x, 0.5)


def ratio(a: Column, b: Column, otherwise=None) -> Column:
    """a / b as double, or ``otherwise`` where b is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(otherwise))


def rate(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def huber(r: Column, delta: float = 1.345) -> Column:
    return F.when(r <= delta, 0.5 * r * r).otherwise(delta * (r - 0.5 * delta))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval of k successes in n trials; exactly 0 and 1 at the ends, null without trials."""
    k, n, z2 = k.cast("double"), n.cast("double"), Z95 * Z95
    centre, spread = (k / n + z2 / (2 * n)) / (1 + z2 / n), Z95 * F.sqrt(k / n * (1 - k / n) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    low = F.when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - spread))
    high = F.when(k == n, 1.0).otherwise(F.least(F.lit(1.0), centre + spread))
    return F.when(n > 0, low), F.when(n > 0, high)


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where a denominator is 0."""
    p, r = ratio(tp, tp + fp, 0.0), ratio(tp, tp + fn, 0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def status(count: Column, blocks: int, fraction: float = 0.5) -> Column:
    """Class of a frame by how many of its blocks alarm, first match wins."""
    least = max(1, -int(-(fraction * blocks - 1e-9) // 1))
    return F.when(count == 0, "STABLE").when(count == 1, "LOCALIZED_ALERT").when(count >= least, "GLOBAL_SHOCK").otherwise("DISTRIBUTED_ALERT")
