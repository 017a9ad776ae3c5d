"""The engine: an immutable description of measures, dimensions and filters over a DataFrame of bundles.

Views are lazy DataFrames built from column expressions; each `with_` method returns a
new Explorer. Only with_histogram, with_clusters, thresholds and top_clusters run jobs at once:
they look at the data to learn a few numbers or names, which become part of a facet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..functions.formats import significant
from ..functions.rules import let
from ..operators import aggregates as A
from ..operators import predicates as P
from ..sources import bundles as B


@dataclass(frozen=True)
class Facet:
    values: Column
    combiner: str = "some"


@dataclass(frozen=True)
class Explorer:
    bundles: DataFrame
    series: Mapping[str, Column] = field(default_factory=dict)
    facets: Mapping[str, Facet] = field(default_factory=dict)
    spec: Mapping = field(default_factory=dict)
    interpolations: tuple[tuple[str, tuple[str, ...], Callable[[dict[str, Column]], Column]], ...] = ()
    strict: bool = False

    # registration

    @staticmethod
    def empty(spark: SparkSession) -> Explorer:
        return Explorer(B.empty(spark))

    def load(self, bundles: DataFrame) -> Explorer:
        """Other data, same registrations."""
        return replace(self, bundles=bundles)

    def append(self, bundles: DataFrame) -> Explorer:
        """More data; duplicates stay."""
        return replace(self, bundles=B.append(self.bundles, bundles))

    def with_series(self, name: str, value: Column) -> Explorer:
        return replace(self, series={**self.series, name: value})

    def with_facet(self, name: str, values: Column, combiner: str = "some", negative: str | None = None) -> Explorer:
        """A dimension; with a negative combiner also `name!`, its negated twin."""
        unknown = {combiner, negative} - {None, *P.COMBINERS}
        if unknown:
            raise ValueError(f"unknown combiner {unknown}")
        more = {f"{name}!": Facet(self._array(values), negative)} if negative else {}
        return replace(self, facets={**self.facets, name: Facet(self._array(values), combiner), **more})

    def with_filter(self, spec: Mapping) -> Explorer:
        return replace(self, spec=dict(spec))

    def with_interpolation(self, name: str, sources: Sequence[str], f: Callable[[dict[str, Column]], Column]) -> Explorer:
        """A value per group from the aggregates' weights of sources (series or earlier interpolations)."""
        return replace(self, interpolations=(*self.interpolations, (name, tuple(sources), f)))

    def reset_series(self) -> Explorer:
        return replace(self, series={}, interpolations=())

    def reset_facets(self) -> Explorer:
        return replace(self, facets={}, spec={})

    def _array(self, values: Column) -> Column:
        """Values as array<string>: a lone null, '', 0 or false is no value; null elements are dropped."""
        kind = self.bundles.select(values.alias("x")).schema["x"].dataType
        none = F.array().cast("array<string>")
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.filter(values.cast("array<string>"), lambda x: x.isNotNull()), none)
        zero = {T.StringType: F.lit(""), T.BooleanType: F.lit(False)}.get(type(kind), F.lit(0))
        falsy = (lambda v: F.lit(False)) if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else (lambda v: v == zero)
        return let(values, lambda v: F.when(v.isNull() | falsy(v), none).otherwise(F.array(v.cast("string"))))

    # caching is Spark's: views are plans, and what is worth keeping is kept as a table

    def persist(self) -> Explorer:
        """Keeps the bundles in memory and on disk for several views."""
        return replace(self, bundles=self.bundles.persist())

    def unpersist(self) -> Explorer:
        return replace(self, bundles=self.bundles.unpersist())

    def cache_stats(self) -> dict[str, bool]:
        """Whether the bundles are kept, and where."""
        level = self.bundles.storageLevel
        return {"memory": level.useMemory, "disk": level.useDisk}

    # filters

    def _conditions(self, spec: Mapping | None = None, combiner: str | None = None) -> dict[str, Column]:
        combiners = {k: combiner or f.combiner for k, f in self.facets.items()}
        return P.conditions(self.spec if spec is None else spec, {k: f.values for k, f in self.facets.items()}, combiners, self.strict)

    def filtered(self) -> DataFrame:
        """Bundles that meet the filter; all if no facet is registered."""
        if not self.facets or not P.active(self.spec):
            return self.bundles
        return self.bundles.where(P.conjunction(self._conditions().values()))

    def filter_by(self, spec: Mapping) -> DataFrame:
        return self.with_filter(spec).filtered()

    def has_conversion(self, spec: Mapping, combiner: str = "every") -> Column:
        """Whether a bundle meets a spec, with one combiner for all its facets."""
        return P.conjunction(self._conditions(spec, combiner).values())

    def selectivity(self, spec: Mapping | None = None) -> dict[str, int]:
        """How many matches each facet of a spec may have: bundles by desired value, added up; an unknown facet counts its values."""
        spec = P.active(self.spec if spec is None else spec)
        known = {k: v for k, v in spec.items() if k in self.facets}
        hits = [F.sum(F.size(F.filter(self.facets[k].values, _among(v)))).alias(k) for k, v in known.items()]
        row = self.bundles.agg(*hits).first() if hits else {}
        return {k: int(row[k] or 0) if k in known else len(v) for k, v in spec.items()}

    def ordered(self) -> Explorer:
        """The same filter with the facet first that fewest bundles match: conditions are tested in order."""
        score = self.selectivity()
        return self.with_filter(dict(sorted(self.spec.items(), key=lambda kv: score.get(kv[0], 0))))

    def _skipped(self, name: str) -> set[str]:
        twin = self.facets.get(f"{name}!")
        return ({name} if self.facets[name].combiner in P.SKIPS_OWN else set()) | ({f"{name}!"} if twin and twin.combiner in P.SKIPS_NEGATED else set())

    # views

    def _rows(self, source: DataFrame, *more: Column) -> DataFrame:
        """Weight and series of each bundle: all that aggregates read."""
        return source.select(F.col("weight").cast("double").alias("weight"), *[v.cast("double").alias(k) for k, v in self.series.items()], *more)

    def totals(self, names: Sequence[str] = A.METRICS) -> DataFrame:
        """One row, series__metric columns, over the filtered bundles."""
        return self._rows(self.filtered()).agg(F.count("*").alias("bundles"), *A.metrics(list(self.series), names))

    def total_percentiles(self, series: str, points: Sequence[float]) -> DataFrame:
        return A.percentiles(self._rows(self.filtered()), [], series, points)

    def _keyed(self, key: Column) -> DataFrame:
        return self._rows(self.filtered(), F.explode(self._array(key)).alias("key"))

    def group(self, key: Column, spine: DataFrame | None = None, names: Sequence[str] = (*A.METRICS, *A.RELATIVE)) -> DataFrame:
        """A row per key: bundles, series__metric, interpolations.

        A bundle counts once per element of an array key. With a spine (a column key)
        the result has exactly its keys, empty groups included. share and percentage
        compare with the totals, which are aggregated only if one of them is asked for.
        """
        relative = [m for m in A.RELATIVE if m in names]
        names = list(dict.fromkeys([*[m for m in names if m not in A.RELATIVE], "count", "sum", "weight"]))
        series = list(self.series)
        out = self._keyed(key).groupBy("key").agg(F.count("*").alias("bundles"), *A.metrics(series, names))
        if spine is not None:
            zeros = ["bundles", *[f"{s}__{m}" for s in series for m in names if m in ("count", "sum", "weight", "variance", "stddev", "stderr")]]
            out = spine.select(F.col("key").cast("string").alias("key")).distinct().join(out, "key", "left").fillna(0, zeros)
        if series and relative:
            out = A.shares(out, self.totals(("count", "sum")), series, relative)
        known = {s: F.col(f"{s}__weight") for s in series}
        for name, sources, f in self.interpolations:
            value = f({s: known[s] for s in sources}).cast("double")
            out = out.withColumn(name, F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)))
            known[name] = F.col(name)
        return out

    def group_percentiles(self, key: Column, series: str, points: Sequence[float]) -> DataFrame:
        return A.percentiles(self._keyed(key), ["key"], series, points)

    def facet_view(self, names: Sequence[str] | None = None, metrics: Sequence[str] | None = None) -> DataFrame:
        """A row per facet and value: count, weight and series metrics, in one scan and one exchange.

        A facet's own filter doesn't narrow its values (for some and none). Facet values
        and conditions are projected once per row; a row gives only the values of facets
        whose other conditions it meets.
        """
        names = list(self.facets) if names is None else list(names)
        needed = list(dict.fromkeys([*names, *[k for k in P.active(self.spec) if k in self.facets]]))
        place = {k: f"__v{i}" for i, k in enumerate(needed)}
        rows = self._rows(self.bundles, *[self.facets[k].values.alias(place[k]) for k in needed])
        found = {k: F.col(v) for k, v in place.items()}
        conditions = P.conditions(self.spec, found, {k: f.combiner for k, f in self.facets.items()}, self.strict)
        holds = {k: f"__p{i}" for i, k in enumerate(conditions)}
        if conditions:
            rows = rows.select("*", *[c.alias(holds[k]) for k, c in conditions.items()])
        nothing = F.array().cast("array<struct<facet:string,value:string>>")
        parts = []
        for k in names:
            keep = P.conjunction(F.col(holds[c]) for c in conditions if c not in self._skipped(k))
            parts.append(F.when(keep, F.transform(found[k], _pair(k))).otherwise(nothing))
        exploded = rows.select("weight", *self.series, F.explode(F.flatten(F.array(*parts)) if parts else nothing).alias("p")).select("p.*", "weight", *self.series)
        more = A.metrics(list(self.series), metrics) if metrics else []
        return exploded.groupBy("facet", "value").agg(F.count("*").alias("count"), F.sum("weight").alias("weight"), *more)

    def facet_order(self, name: str, metrics: Sequence[str] | None = None) -> DataFrame:
        """One facet's values, heaviest first; ties by value."""
        return self.facet_view([name], metrics).orderBy(F.desc("weight"), "value")

    def estimators(self, name: str) -> DataFrame | None:
        """Chao1 richness of a facet's values by their bundle counts; None for an unknown facet."""
        from ..functions.stats import chao1

        return chao1(self.facet_view([name]), "count") if name in self.facets else None

    # derived facets; their thresholds and clusters are those of the data under the filters at registration

    def _snapshot(self, base: str) -> Column:
        skipped = self._skipped(base)
        return P.conjunction(c for k, c in self._conditions().items() if k not in skipped)

    def with_histogram(self, name: str, base: str, count: int = 10, low: float = -math.inf, high: float = math.inf, steps: str = "linear", formatter: Callable[[float], str] | None = None) -> Explorer:
        """Ranges of a facet's integer values as a facet: `<t` for the first threshold above, else `>=t` of the last.

        A bundle with several values is placed by the first of them.
        """
        limits = self.thresholds(base, count, low, high, steps)
        label = formatter or two_digits
        first = integer(F.get(self.facets[base].values, F.lit(0)))
        bucket = F.lit(">=" + label(limits[-1])) if limits else F.lit(None).cast("string")
        for t in reversed(limits):
            bucket = F.when(first < F.lit(t), "<" + label(t)).otherwise(bucket)
        return self.with_facet(name, F.when(self._snapshot(base) & first.isNotNull(), bucket))

    def thresholds(self, base: str, count: int = 10, low: float = -math.inf, high: float = math.inf, steps: str = "linear") -> list[float]:
        """`count` thresholds: linear, logarithmic or quantiles."""
        values = self.facet_view([base]).select(integer(F.col("value")).cast("double").alias("v"), "weight").where("v is not null")
        lo, hi = values.agg(F.min("v"), F.max("v")).first()
        if lo is None and math.isinf(low) and math.isinf(high):
            return []
        lo = max(low, min([x for x in (lo, high) if x is not None]))
        hi = min(high, max([x for x in (hi, low) if x is not None]))
        if steps == "linear":
            return [(hi - lo) / count * i + lo for i in range(count)]
        if steps == "logarithmic":
            return [math.exp((math.log(hi - lo) if hi > lo else -math.inf) / count * i if i else 0.0) + lo for i in range(count)]
        if steps != "quantiles":
            raise ValueError(f"unknown steps {steps}")
        inside = values.where((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy("v").agg(F.sum("weight").alias("n"))
        ranked = A.ranked(inside, []).select("v", "n", "end", "total").persist()
        total = ranked.agg(F.first("total")).first()[0] or 0.0
        # the first value whose weights since the last threshold exceed a step is the next one
        step, out, since = total / (count + 1 / count), [], 0.0
        while len(out) < count and (found := ranked.where(F.col("end") - F.lit(float(since)) > F.lit(float(step))).agg(F.min(F.struct("v", "end"))).first()[0]):
            out.append(found["v"])
            since = found["end"]
        ranked.unpersist()
        return [(out[i] if i < len(out) else 0) or hi for i in range(count)]

    def top_clusters(self, base: str, count: int | None = None, producer: Callable[[Column], Column] = urls.url_segments) -> list[str]:
        """The clusters that most distinct values of a facet belong to; by default log10 of their number."""
        values = self.facet_view([base]).select("value")
        if count is None:
            n = values.count()
            count = math.floor(math.log10(n)) if n else 0
        ranked = values.select(F.explode(producer(F.col("value"))).alias("cluster")).groupBy("cluster").count().orderBy(F.desc("count"), "cluster")
        return [r["cluster"] for r in ranked.limit(max(0, int(count))).collect()]

    def with_clusters(self, name: str, base: str, count: int | None = None, producer: Callable[[Column], Column] = urls.url_segments, combiner: str = "some", negative: str | None = None) -> Explorer:
        """A facet's values and those of its top clusters that they belong to."""
        top = self.top_clusters(base, count, producer)
        values = F.transform(self.facets[base].values, lambda x: F.concat(F.array(x), F.filter(producer(x), lambda c: c.isin(top))) if top else F.array(x))
        return self.with_facet(name, F.when(self._snapshot(base), F.array_distinct(F.flatten(values))), combiner, negative)


def _among(values: Sequence[str]):
    return lambda x: x.isin(*values)


def _pair(facet: str):
    return lambda v: F.named_struct(F.lit("facet"), F.lit(facet), F.lit("value"), v)


def integer(text: Column) -> Column:
    """The integer that a text begins with; null if none."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def two_digits(x: float) -> str:
    """At most two significant digits, halves away from zero, thousands grouped."""
    if not x or math.isinf(x) or math.isnan(x):
        return "0" if not x else "∞" if x > 0 else "-∞" if x < 0 else "NaN"
    y = f"{significant(Decimal(repr(float(x))), 2):,f}"
    return y.rstrip("0").rstrip(".") if "." in y else y
