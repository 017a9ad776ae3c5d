"""Statistics as column formulas: tests, sampling error, scores, richness of unseen values."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of the two polynomial approximations.
NORMAL = (0.2316419, 0.3989423, (0.3193815, -0.3565638, 1.781478, -1.821256, 1.330274))
ERF = (0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429))
# Bounds of web vitals, needs improvement and poor.
VITALS = {"lcp": (2500.0, 4000.0), "cls": (0.1, 0.25), "inp": (200.0, 500.0), "ttfb": (800.0, 1800.0)}
Z95 = 1.96


def _poly(t: Column, coefficients) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = t * (F.lit(c) + out)
    return out


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def standard_normal_cdf(x: Column) -> Column:
    k, d, coefficients = NORMAL
    p = F.lit(d) * F.exp(-x * x / 2) * _poly(1 / (1 + F.lit(k) * F.abs(x)), coefficients)
    return F.when(x > 0, 1 - p).otherwise(p)


def erf(x: Column) -> Column:
    k, coefficients = ERF
    y = 1 - _poly(1 / (1 + F.lit(k) * F.abs(x)), coefficients) * F.exp(-x * x)
    return F.when(x < 0, -y).otherwise(y)


def z_test_p_value(z: Column) -> Column:
    return 2 * (1 - standard_normal_cdf(F.abs(z)))


def z_test_two_proportions(n1: Column, c1: Column, n2: Column, c2: Column) -> Column:
    """p-value of equal conversion rates by the pooled z-test; 1 if the rates are equal, null without samples."""
    p1, p2 = F.try_divide(c1, n1), F.try_divide(c2, n2)
    pooled = F.try_divide(c1 + c2, n1 + n2)
    z = F.try_divide(p1 - p2, F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))))
    return F.when(p1 == p2, 1.0).otherwise(z_test_p_value(z))


def t_test(mean1: Column, var1: Column, n1: Column, mean2: Column, var2: Column, n2: Column) -> Column:
    """One-sided p-value from population means and variances; null if both are constant."""
    spread = F.sqrt((var1 + var2) / 2 * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return 1 - (0.5 + 0.5 * erf(F.try_divide(mean1 - mean2, spread) / math.sqrt(2)))


def sampling_error(total: Column, samples: Column) -> Column:
    weight = F.try_divide(total, samples)
    return F.when(samples == 0, 0).otherwise(round_half_up(Z95 * F.sqrt(weight * weight * samples)))


def regression(df: DataFrame, value: str, index: str, *keys: str) -> DataFrame:
    """Slope and intercept of least squares of value on a 0-based index column, per keys; null for fewer than two rows."""
    agg = (F.regr_slope(value, index).alias("slope"), F.regr_intercept(value, index).alias("intercept"))
    return df.groupBy(*keys).agg(*agg) if keys else df.agg(*agg)


def score_vital(value: Column, name: str) -> Column:
    fair, poor = VITALS.get(name.lower(), (math.inf, math.inf))
    return F.when(value >= poor, "poor").when(value >= fair, "ni").when(value.isNotNull(), "good")


def score_bundle(lcp: Column, cls: Column, inp: Column) -> Column:
    """good, ni or poor over the vitals that are there and not 0; null without any."""
    scores = F.array_compact(F.array(*[F.when(v != 0, score_vital(v, n)) for v, n in ((lcp, "lcp"), (cls, "cls"), (inp, "inp"))]))
    return F.when(F.size(scores) == 0, F.lit(None)).when(F.array_contains(scores, "poor"), "poor").when(F.array_contains(scores, "ni"), "ni").otherwise("good")


def conversion_rate(conversions: Column, visits: Column) -> Column:
    """Percent within 0 and 100; 100 for anything else, division by 0 included."""
    rate = F.try_divide(100.0 * conversions, visits)
    return F.coalesce(F.when((rate >= 0) & (rate <= 100), rate), F.lit(100.0))


def samples_of_error(total: Column, error: Column, z: float = Z95) -> Column:
    """How many samples give a margin of error; 0 if it can't be told."""
    return F.coalesce(F.when((total > 0) & (error > 0), round_half_up(F.pow(z * total / F.when(error > 0, error), 2))), F.lit(0)).cast("long")


def sampling_rate(total: Column, error: Column, z: float = Z95) -> Column:
    sampled = samples_of_error(total, error, z)
    return F.struct(F.try_divide(sampled.cast("double"), total).alias("rate"), sampled.alias("sampled"))


def counts_of_counts(df: DataFrame, count: str) -> DataFrame:
    """k and how often it occurs among positive finite counts, cut to integers."""
    c = F.col(count).cast("double")
    ok = df.where((c > 0) & (c < float("inf")) & ~F.isnan(c))
    return ok.groupBy(F.floor(c).alias("k")).agg(F.count("*").alias("n")).where("k > 0")


def chao1(df: DataFrame, count: str, z: float = Z95) -> DataFrame:
    """One row: observed and estimated richness from the counts of each value, with variance and intervals."""
    coc = counts_of_counts(df, count)
    base = coc.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("sObs"),
        F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("n"))), F.lit(0)).cast("double").alias("f1"),
        F.coalesce(F.sum(F.when(F.col("k") == 2, F.col("n"))), F.lit(0)).cast("double").alias("f2"),
    )
    f1, f2, s = F.col("f1"), F.col("f2"), F.col("sObs")
    more = F.when(f2 > 0, f1 * f1 / (2 * F.when(f2 > 0, f2))).otherwise(f1 * (f1 - 1) / 2)
    corrected = f1 * (f1 - 1) / (2 * (f2 + 1))
    variance = corrected + f1 * F.pow(2 * f1 - 1, 2) / (4 * F.pow(f2 + 1, 2)) + f1 * f1 * f2 * F.pow(f1 - 1, 2) / (4 * F.pow(f2 + 1, 4))
    base = base.withColumns({"sHat": s + more, "sUnseen": round_half_up(more).cast("double"), "variance": F.when(s == 0, 0.0).otherwise(variance)})
    delta = F.greatest(F.lit(sys.float_info.epsilon), F.col("sHat") - s)
    spread = F.exp(z * F.sqrt(F.log(1 + F.col("variance") / (delta * delta))))
    low, high = delta / spread, delta * spread
    return base.select(
        "sObs", "sHat", "sUnseen", "f1", "f2", "variance",
        F.when(s == 0, 0.0).otherwise(s + low).alias("lower"), F.when(s == 0, 0.0).otherwise(s + high).alias("upper"),
        F.when(s == 0, 0.0).otherwise(low).alias("darkLower"), F.when(s == 0, 0.0).otherwise(high).alias("darkUpper"),
        F.when(s != 0, corrected).alias("deltaBC"),
    )


def dark_matter(df: DataFrame, total: str, error: str, z: float = Z95) -> DataFrame:
    """chao1 over the samples that (total, margin of error) rows imply."""
    return chao1(df.select(samples_of_error(F.col(total), F.col(error)).alias("samples")).where("samples > 0"), "samples", z)
