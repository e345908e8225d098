"""Numeric column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def bounded(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def norm(c, scale: float) -> Column:
    """min(1, |x| / scale), with nothing, NaN and infinities counting as zero."""
    x = F.coalesce(dbl(c), F.lit(0.0))
    finite = ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(finite, F.least(F.lit(1.0), F.abs(x) / F.lit(scale + 1e-9))).otherwise(F.lit(0.0))


def floor_div(x: Column, n: int) -> Column:
    """Integer floor division, also below zero."""
    return ((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("bigint")


def pin(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns that later expressions may reference freely without being recomputed.

    A generator over one element is a point the optimiser does not substitute expressions through,
    so chains of derived columns stay linear in size.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def merge_moments(parts: Column) -> Column:
    """Fold an array of (n, mean, m2, m3, m4) partials into one, m_k being central power sums.

    The pairwise update formulas are numerically stable, unlike raw power sums.
    """
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"),
                     F.lit(0.0).alias("m3"), F.lit(0.0).alias("m4"))

    def step(a: Column, b: Column) -> Column:
        na, nb = a["n"], b["n"]
        n = na + nb
        d = b["mean"] - a["mean"]
        m2 = a["m2"] + b["m2"] + d * d * na * nb / n
        m3 = (a["m3"] + b["m3"] + d * d * d * na * nb * (na - nb) / (n * n)
              + F.lit(3.0) * d * (na * b["m2"] - nb * a["m2"]) / n)
        m4 = (a["m4"] + b["m4"]
              + d * d * d * d * na * nb * (na * na - na * nb + nb * nb) / (n * n * n)
              + F.lit(6.0) * d * d * (na * na * b["m2"] + nb * nb * a["m2"]) / (n * n)
              + F.lit(4.0) * d * (na * b["m3"] - nb * a["m3"]) / n)
        merged = F.struct(n.alias("n"), (a["mean"] + d * nb / n).alias("mean"),
                          m2.alias("m2"), m3.alias("m3"), m4.alias("m4"))
        return F.when(nb == 0, a).when(na == 0, F.struct(
            b["n"].alias("n"), b["mean"].alias("mean"), b["m2"].alias("m2"),
            b["m3"].alias("m3"), b["m4"].alias("m4"))).otherwise(merged)

    return F.aggregate(parts, start, step)


def moment_partial(x) -> Column:
    """Aggregate expression: one (n, mean, m2, m3, m4) partial of a double column."""
    n = F.count(x).cast("double")
    m2 = F.coalesce(F.var_pop(x), F.lit(0.0)) * n
    flat = m2 <= 0
    skew = F.when(flat, F.lit(0.0)).otherwise(F.coalesce(F.skewness(x), F.lit(0.0)))
    kurt = F.when(flat, F.lit(0.0)).otherwise(F.coalesce(F.kurtosis(x), F.lit(0.0)) + 3.0)
    return F.struct(
        n.alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), m2.alias("m2"),
        F.when(flat, F.lit(0.0)).otherwise(skew * F.pow(m2, F.lit(1.5)) / F.sqrt(n)).alias("m3"),
        F.when(flat, F.lit(0.0)).otherwise(kurt * m2 * m2 / n).alias("m4"),
    )
