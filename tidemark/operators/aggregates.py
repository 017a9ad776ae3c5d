"""Aggregates of series: one pass for all metrics, exact percentiles by ranks of pre-aggregated values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("count", "sum", "weight", "min", "max", "mean", "variance", "stddev", "stderr")
#: Metrics that compare a group with its totals; null where there is nothing to compare with.
RELATIVE = ("share", "percentage")
RANGES, SAMPLE = 256, 4096


def metric(name: str, series: str, weight: str = "weight") -> Column:
    """A metric of a series column; empty groups give 0 for counts, sums and spreads, null for the rest."""
    s = F.col(series)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return {
        "count": lambda: F.count(s),
        "sum": lambda: F.coalesce(F.sum(s), F.lit(0)),
        "weight": lambda: F.coalesce(F.sum(F.when(s.isNotNull(), F.col(weight))), F.lit(0)),
        "min": lambda: F.min(s),
        "max": lambda: F.max(s),
        "mean": lambda: F.avg(s),
        "variance": lambda: zero(F.var_pop(s)),
        "stddev": lambda: zero(F.stddev_pop(s)),
        "stderr": lambda: zero(F.try_divide(F.stddev_pop(s), F.sqrt(F.count(s)))),
        **{m: lambda: F.max(F.lit(None).cast("double")) for m in RELATIVE},
    }[name]().alias(f"{series}__{name}")


def metrics(series: Sequence[str], names: Sequence[str] = METRICS) -> list[Column]:
    return [metric(n, s) for s in series for n in names]


def _joined(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    if not on:  # b is one row
        return a.withColumn("__one", F.lit(1)).join(F.broadcast(b.withColumn("__one", F.lit(1))), "__one").drop("__one")
    other = b.select(*[F.col(k).alias(f"__{k}") for k in on], *[c for c in b.columns if c not in on])
    match = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in on]
    return a.join(other, match).drop(*[f"__{k}" for k in on])


def _place(limits: Column, v: Column) -> Column:
    """How many of the ascending limits are below v, by binary search."""
    def half(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        below, more = F.get(limits, mid) < v, at["lo"] < at["hi"]
        return F.struct(F.when(more & below, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(more & ~below, mid).otherwise(at["hi"]).alias("hi"))

    steps = F.array(*map(F.lit, range(RANGES.bit_length())))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(limits).alias("hi")), half)["lo"]


def ranked(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, v, n, total and end: the sum of n up to v, within keys, of distinct (keys, v).

    Ranks are found in two levels: RANGES ranges between quantiles of a group's values, and
    values within a range. So no task sorts a whole group, wherever its values lie. The plan
    holds the limits of ranges twice, so they must not depend on the order of rows, as sketches
    do: they are quantiles of a sample, in each of SAMPLE slots of hashes the value of the smallest.
    """
    keys, hashed = list(keys), F.xxhash64("v")
    slots = counted.groupBy(*keys, F.pmod(hashed, F.lit(SAMPLE)).alias("slot")).agg(F.min_by("v", hashed).alias("v"), F.sum("n").alias("n"))
    limits = slots.groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("limits"), F.sum("n").alias("total"))
    limits = limits.withColumn("limits", F.filter("limits", lambda _, i: (i + 1) * RANGES % F.size("limits") < RANGES))
    placed = _joined(counted, limits, keys).select(*keys, "v", "n", "total", _place(F.col("limits"), F.col("v")).alias("range"))
    sums = placed.groupBy(*keys, "range").agg(F.sum("n").alias("inside"))
    before = F.sum("inside").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "range", F.coalesce(before, F.lit(0)).alias("base"))
    up_to = F.col("base") + F.sum("n").over(Window.partitionBy(*keys, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return _joined(placed, sums, [*keys, "range"]).withColumn("end", up_to)


def percentiles(rows: DataFrame, keys: Sequence[str], series: str, points: Sequence[float]) -> DataFrame:
    """keys and series__p<point>: the value at index floor(p n / 100) of the sorted values, null for p = 100."""
    keys = list(keys)
    counted = rows.where(F.col(series).isNotNull()).groupBy(*keys, F.col(series).cast("double").alias("v")).agg(F.count("*").alias("n"))
    found = ranked(counted, keys).withColumn("begin", F.col("end") - F.col("n"))
    at = lambda p: F.floor(F.lit(p) * F.col("total") / 100)
    return found.groupBy(*keys).agg(*[F.max(F.when((at(p) >= F.col("begin")) & (at(p) < F.col("end")), F.col("v"))).alias(f"{series}__p{p:g}") for p in points])


def shares(groups: DataFrame, totals: DataFrame, series: Sequence[str], names: Sequence[str] = RELATIVE) -> DataFrame:
    """Adds series__share (of the total count) and series__percentage (of the total sum); totals is one row."""
    of = {"share": "count", "percentage": "sum"}
    parent = totals.select(F.lit(1).alias("__one"), *[F.col(f"{s}__{of[m]}").alias(f"__{s}__{of[m]}") for s in series for m in names])
    both = groups.withColumn("__one", F.lit(1)).join(F.broadcast(parent), "__one")
    return both.select(*groups.columns, *[F.try_divide(F.col(f"{s}__{of[m]}"), F.col(f"__{s}__{of[m]}")).alias(f"{s}__{m}") for s in series for m in names])
