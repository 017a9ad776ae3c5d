"""Registered queries over the tables' page views: one per operator or view of the engine."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats, stats, urls
from ..functions.events import reclassified
from ..functions.rules import acquisition, consent, referrer
from ..operators import facets as fa
from ..operators import series as se
from ..sources.bundles import append, enrich, page_views, read_chunks, write_chunks
from ..sources.scratch import scratch
from .explorer import Explorer
from .trace import broken, profile, read_trace, report, top

YEAR = 2026
SPREADS = ("variance", "stddev", "stderr")
KEYS = ["url", "url!", "userAgent~", "click.source", "click.other", "cwv-lcp", "404", "checkpoint.histogram", "nothing", "enter.target!", "a.b.c", "error."]


def explorer(spark: SparkSession, sf_dir: str, *facets: str, series: tuple[str, ...] = ("pageViews", "visits", "bounces")) -> Explorer:
    out = Explorer(page_views(spark, sf_dir))
    for s in series:
        out = out.with_series(s, se.SERIES[s]())
    for f in facets:
        out = out.with_facet(f, fa.url(YEAR) if f == "url" else fa.FACETS[f]())
    return out


def _tall(row: DataFrame, series, metrics) -> DataFrame:
    """series__metric columns as a row per series; spreads and means rounded."""
    value = lambda s, m: F.round(F.col(f"{s}__{m}"), 6) if m in (*SPREADS, "mean") else F.col(f"{s}__{m}").cast("long") if m == "count" else F.col(f"{s}__{m}").cast("double")
    return row.select(F.inline(F.array(*[F.struct(F.lit(s).alias("series"), *[value(s, m).alias(m) for m in metrics]) for s in series])))


def daily_traffic(spark, sf_dir):
    x = explorer(spark, sf_dir).group(F.col("timeSlot"), names=("sum",))
    return x.select(F.col("key").alias("slot"), F.col("bundles").alias("n"), *[F.col(f"{s}__sum").cast("long").alias(s) for s in ("pageViews", "visits", "bounces")])


def totals_metrics(spark, sf_dir):
    from ..operators.aggregates import METRICS

    return _tall(explorer(spark, sf_dir, series=tuple(se.SERIES)).totals(), se.SERIES, METRICS)


def group_metrics(spark, sf_dir):
    x = explorer(spark, sf_dir, series=("pageViews", "bounces", "lcp")).group(F.col("userAgent"))
    cols = [F.round(F.col(f"{s}__{m}").cast("double"), 6).alias(f"{s}_{m}") for s in ("pageViews", "bounces", "lcp") for m in ("count", "sum", "weight", "mean", "share", "percentage")]
    return x.select(F.col("key").alias("ua"), *cols)


def group_percentiles(spark, sf_dir):
    x = explorer(spark, sf_dir, series=("lcp",))
    groups = x.group_percentiles(F.col("userAgent"), "lcp", (0, 50, 75, 99, 100))
    total = x.total_percentiles("lcp", (0, 50, 75, 99, 100)).select(F.lit("all").alias("key"), "*")
    return groups.unionByName(total).select(F.col("key").alias("ua"), *[F.col(f"lcp__p{p}").alias(f"p{p}") for p in (0, 50, 75, 99, 100)])


def _filter(combiner):
    def query(spark, sf_dir):
        x = explorer(spark, sf_dir).with_facet("checkpoint", fa.checkpoint(), combiner)
        return x.filter_by({"checkpoint": ["click", "viewmedia"]}).select("id")

    return query


def filter_conjunction(spark, sf_dir):
    x = explorer(spark, sf_dir, "userAgent").with_facet("checkpoint", fa.checkpoint(), "every")
    return x.filter_by({"userAgent": "desktop", "checkpoint": ["enter", "click"], "unknown": []}).select("id", "weight")


def filter_unknown(spark, sf_dir):
    return explorer(spark, sf_dir, "userAgent").filter_by({"unknown": ["x"]}).agg(F.count("*").alias("n"))


def conversions(spark, sf_dir):
    x = explorer(spark, sf_dir, "checkpoint", "userAgent")
    met = x.has_conversion({"checkpoint": ["click", "enter"], "userAgent": ["mobile"]})
    x = x.with_facet("conversions", F.when(met, "converted").otherwise("not-converted"))
    return x.facet_view(["conversions"]).select("value", "count", F.col("weight").cast("long").alias("weight"))


def conversion_rates(spark, sf_dir):
    x = explorer(spark, sf_dir, series=("visits", "engagement")).group(F.col("userAgent"), names=("sum",))
    return x.select(F.col("key").alias("ua"), F.round(stats.conversion_rate(F.col("engagement__sum"), F.col("visits__sum")), 6).alias("rate"))


def _view(view: DataFrame) -> DataFrame:
    return view.select("facet", "value", "count", F.col("weight").cast("long").alias("weight"))


def facets_plain(spark, sf_dir):
    return _view(explorer(spark, sf_dir, "userAgent", "checkpoint", "vitals").facet_view())


def facets_drilldown(spark, sf_dir):
    x = explorer(spark, sf_dir, "userAgent").with_facet("checkpoint", fa.checkpoint(), "every", "never").with_facet("vitals", fa.vitals(), "some", "none")
    return _view(x.with_filter({"userAgent": ["desktop"], "checkpoint": ["click"], "checkpoint!": ["error"]}).facet_view())


def facet_metrics(spark, sf_dir):
    x = explorer(spark, sf_dir, "userAgent", series=("pageViews", "lcp")).facet_view(metrics=("sum", "mean"))
    return x.select("value", *[F.round(f"{s}__{m}", 6).alias(f"{s}_{m}") for s in ("pageViews", "lcp") for m in ("sum", "mean")])


def _facet(name):
    return lambda spark, sf_dir: _view(explorer(spark, sf_dir, name, series=()).facet_view())


def checkpoint_sources(spark, sf_dir):
    x = explorer(spark, sf_dir, series=())
    for cp in ("click", "enter", "utm"):
        x = x.with_facet(f"{cp}.source", fa.checkpoint_source(cp))
    for cp in ("consent", "utm", "viewmedia"):
        x = x.with_facet(f"{cp}.target", fa.checkpoint_target(cp))
    return _view(x.facet_view())


def series_sums(spark, sf_dir):
    x = explorer(spark, sf_dir, series=tuple(se.SERIES)).group(F.col("userAgent"), names=("sum",))
    return x.select(F.col("key").alias("ua"), *[F.col(f"{s}__sum").cast("double").alias(s) for s in se.SERIES])


def enriched(spark, sf_dir):
    return page_views(spark, sf_dir).select("id", "visit", F.col("cwvLCP").alias("lcp"), F.col("cwvCLS").alias("cls"), F.col("cwvINP").alias("inp"), F.col("cwvTTFB").alias("ttfb"))


def reclassified_events(spark, sf_dir):
    rows = page_views(spark, sf_dir).select(F.explode(reclassified()).alias("e")).select("e.*")
    return rows.groupBy("checkpoint", "source", "target").agg(F.count("*").alias("n"))


def _events(spark, sf_dir) -> DataFrame:
    return page_views(spark, sf_dir).select(F.explode("events").alias("e")).select("e.*")


def classify_acquisition(spark, sf_dir):
    origins = _events(spark, sf_dir).select(F.col("target").alias("origin")).where("origin is not null").distinct()
    return origins.select("origin", acquisition(F.col("origin")).alias("told"), acquisition(F.col("origin"), True).alias("paid"))


def classify_referrer(spark, sf_dir):
    found = _events(spark, sf_dir).select("source").where("source is not null").distinct()
    return found.select("source", referrer(F.col("source"))["type"].alias("kind"), referrer(F.col("source"))["vendor"].alias("vendor"))


def classify_consent(spark, sf_dir):
    found = _events(spark, sf_dir).select("source").where("source is not null").distinct()
    return found.select("source", consent(F.col("source"))["vendor"].alias("vendor"), consent(F.col("source"))["target"].alias("action"))


def filled_days(spark, sf_dir):
    x = explorer(spark, sf_dir)
    ends = x.bundles.agg(F.min("timeSlot").cast("date").alias("a"), F.max("timeSlot").cast("date").alias("b"))
    spine = ends.select(F.explode(F.sequence(F.date_sub("a", 2), F.date_add("b", 2))).alias("key"))
    out = x.group(F.col("timeSlot"), spine, names=("count", "sum"))
    return out.select(F.col("key").alias("slot"), F.col("bundles").alias("n"), F.col("pageViews__sum").cast("long").alias("pageViews"))


def interpolated_ratio(spark, sf_dir):
    x = explorer(spark, sf_dir, series=("pageViews", "lcp", "cls"))
    x = x.with_interpolation("lcpShare", ["lcp", "pageViews"], lambda s: F.try_divide(s["lcp"], s["pageViews"])).with_interpolation("double", ["lcpShare"], lambda s: s["lcpShare"] * 2)
    return x.group(F.col("timeSlot"), names=("weight",)).select(F.col("key").alias("slot"), F.round("lcpShare", 6).alias("lcp_share"), F.round("double", 6).alias("twice"))


def _histogram(steps):
    def query(spark, sf_dir):
        x = explorer(spark, sf_dir, series=()).with_facet("lcp", F.col("cwvLCP").cast("long").cast("string"))
        x = x.with_histogram("bins", "lcp", 6, 0, 30_000, steps, lambda t: str(math.floor(t + 0.5)))
        return _view(x.facet_view(["bins"]))

    return query


def url_clusters(spark, sf_dir):
    x = explorer(spark, sf_dir, "plainURL", series=())
    return _view(x.with_clusters("clusters", "plainURL", 5).facet_view(["clusters"]))


def histogram_filtered(spark, sf_dir):
    """Ranges of what passed the filter at registration; other bundles have none, also without the filter."""
    x = explorer(spark, sf_dir, "userAgent", series=()).with_facet("lcp", F.col("cwvLCP").cast("long").cast("string")).with_filter({"userAgent": ["mobile"]})
    x = x.with_histogram("bins", "lcp", 6, 0, 30_000, "linear", lambda t: str(math.floor(t + 0.5)))
    return _view(x.with_filter({}).facet_view(["bins"]))


def clusters_filtered(spark, sf_dir):
    x = explorer(spark, sf_dir, "userAgent", "plainURL", series=()).with_filter({"userAgent": ["desktop:mac"]}).with_clusters("clusters", "plainURL", 5)
    return _view(x.with_filter({}).facet_view(["clusters"]))


def facet_order(spark, sf_dir):
    """The ten heaviest checkpoints, in order."""
    x = _view(explorer(spark, sf_dir, "checkpoint", series=()).facet_order("checkpoint").limit(10))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("weight"), "value")).cast("long"))


def chunks(spark, sf_dir):
    """Page views written as JSON chunks, read again and enriched."""
    path = f"{scratch(spark)}/chunks"
    write_chunks(page_views(spark, sf_dir), path)
    rows = enrich(read_chunks(spark, path))
    return rows.groupBy(F.col("timeSlot").alias("slot")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum(F.size("events")).cast("long").alias("events"), F.count("cwvLCP").alias("lcps"))


def lifecycle(spark, sf_dir):
    """Bundles that an Explorer holds after its operations: rows, series and facets of each."""
    x = explorer(spark, sf_dir, "userAgent").with_filter({"userAgent": ["mobile"]})
    clicks = x.bundles.where(F.exists("events", lambda e: e["checkpoint"] == "click"))
    steps = {"empty": Explorer.empty(spark), "filtered": x, "reset_facets": x.reset_facets(), "reset_series": x.reset_series(), "load": x.load(clicks), "append": x.append(clicks)}
    out = [e.filtered().agg(F.count("*").alias("n")).select(F.lit(k).alias("step"), "n", F.lit(len(e.series)).alias("series"), F.lit(len(e.facets)).alias("facets")) for k, e in steps.items()]
    return functools.reduce(DataFrame.unionByName, out)


def richness(spark, sf_dir):
    x = explorer(spark, sf_dir, "plainURL", series=()).estimators("plainURL")
    return x.select(*[F.round(c, 6).alias(c.lower()) for c in x.columns])


def richness_of_visits(spark, sf_dir):
    """Richness of pairs of a page's host and a day, of which many occur once or twice."""
    pair = F.concat("host", F.lit(" "), F.col("timeSlot"))
    x = explorer(spark, sf_dir, series=()).with_facet("visit", pair).estimators("visit")
    return x.select(*[F.round(c, 6).alias(c.lower()) for c in x.columns])


def dark_matter(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.floor("p_retailprice").cast("double").alias("total"), (F.floor("p_retailprice") * (1 + F.col("p_size") % 2)).cast("double").alias("moe"))
    x = stats.dark_matter(part, "total", "moe")
    return x.select(*[F.round(c, 6).alias(c.lower()) for c in ("sObs", "sHat", "sUnseen", "f1", "f2", "variance", "lower", "upper")])


def sampling(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.floor("p_retailprice").cast("double").alias("total"), (F.col("p_size") % 7).cast("double").alias("samples"))
    rate = stats.sampling_rate(F.col("total"), F.lit(100.0))
    return part.select("p_partkey", stats.sampling_error(F.col("total"), F.col("samples")).cast("long").alias("error"), rate["sampled"].alias("sampled"), F.round(rate["rate"], 6).alias("rate"))


def z_test(spark, sf_dir):
    x = explorer(spark, sf_dir, series=("visits", "bounces")).group(F.col("userAgent"), names=("sum",))
    total = x.agg(F.sum("visits__sum").alias("n"), F.sum("bounces__sum").alias("c")).withColumn("one", F.lit(1))
    both = x.withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    p = stats.z_test_two_proportions(F.col("visits__sum"), F.col("bounces__sum"), F.col("n"), F.col("c"))
    return both.select(F.col("key").alias("ua"), F.round(p, 6).alias("p"))


def t_test(spark, sf_dir):
    rows = page_views(spark, sf_dir).select(F.substring_index("userAgent", ":", 1).alias("device"), F.col("cwvLCP").alias("v"))
    side = lambda d: (F.avg(F.when(F.col("device") == d, F.col("v"))), F.var_pop(F.when(F.col("device") == d, F.col("v"))), F.count(F.when(F.col("device") == d, F.col("v"))))
    names = [f"{d}{k}" for d in ("desktop", "mobile") for k in ("m", "v", "n")]
    one = rows.agg(*[c.alias(n) for n, c in zip(names, [*side("desktop"), *side("mobile")])])
    return one.select(F.round(stats.t_test(*[F.col(n) for n in names]), 6).alias("p"))


def trend(spark, sf_dir):
    days = daily_traffic(spark, sf_dir).select("slot", "pageViews")
    first = days.agg(F.min("slot").cast("date").alias("first")).withColumn("one", F.lit(1))
    rows = days.withColumn("one", F.lit(1)).join(F.broadcast(first), "one").select(F.datediff(F.col("slot").cast("date"), "first").cast("double").alias("i"), F.col("pageViews").cast("double").alias("v"))
    x = stats.regression(rows, "v", "i")
    return x.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


def scores(spark, sf_dir):
    b = page_views(spark, sf_dir)
    score = stats.score_bundle(F.col("cwvLCP"), F.col("cwvCLS"), F.col("cwvINP"))
    return b.groupBy(score.alias("score"), stats.score_vital(F.col("cwvTTFB"), "ttfb").alias("ttfb")).agg(F.count("*").alias("n"))


def append_bundles(spark, sf_dir):
    b = page_views(spark, sf_dir)
    both = append(b, b.where("visit").withColumn("extra", F.lit(1)))
    return both.groupBy("userAgent").agg(F.count("*").alias("n"), F.count("extra").alias("again"))


def url_masks(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("url", F.lit("#z")).alias("u"))
    longer = F.regexp_replace("u", "^([^:]+://[^/?#]+)", r"$1/20241234567/00deadbeef")
    return pages.select("page_id", urls.masked(longer, YEAR).alias("masked"), urls.plain(F.col("u")).alias("plain"), F.array_join(urls.url_segments(F.col("u")), " ").alias("segments"))


def known_facets(spark, sf_dir):
    keys = spark.createDataFrame([(k,) for k in KEYS], "key string")
    return keys.select("key", fa.known_facet(F.col("key")).alias("known"))


def readable(spark, sf_dir):
    """Final output as short numbers."""
    return daily_traffic(spark, sf_dir).select("slot", formats.human_readable(F.col("pageViews"), 3).alias("pageViews"))


def rounded_to_confidence(spark, sf_dir):
    """Totals cut to the digits that their sampling error leaves."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.floor(F.col("p_retailprice") * F.col("p_partkey") * F.col("p_size")).alias("total"), (10 + F.col("p_size") * F.col("p_size") * F.col("p_partkey")).alias("samples"))
    return part.select("p_partkey", formats.rounded_to_confidence(F.col("total"), F.col("samples")).alias("shown"), formats.human_readable(F.col("total")).alias("short"))


def _traces(spark, sf_dir) -> DataFrame:
    """A trace file per nation, with a sample per supplier, written and read again."""
    frames = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.struct(F.lit(None if i == 4 else f"u{i % 2}.js").cast("string").alias("url"), F.lit(None if i == 5 else f"f{i}").cast("string").alias("functionName")).alias("callFrame")) for i in range(6)])
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("k"))
    data = F.struct(F.struct(frames.alias("nodes"), F.transform("k", lambda x: x % 7).alias("samples")).alias("cpuProfile"), F.transform(F.slice("k", 1, F.greatest(F.size("k") - 1, F.lit(0))), lambda x: x % 13).alias("timeDeltas"))
    event = lambda cat: F.struct(F.lit(cat).alias("cat"), F.lit("ProfileChunk").alias("name"), F.struct(data.alias("data")).alias("args"))
    path = f"{scratch(spark)}/traces"
    file = F.to_json(F.struct(F.array(event("disabled-by-default-v8.cpu_profiler"), event("other")).alias("traceEvents")))
    file = F.when(F.col("s_nationkey") == 24, F.substring(file, 1, 40)).otherwise(file)  # a broken file
    rows.select("s_nationkey", file.alias("value")).write.partitionBy("s_nationkey").text(path)
    return read_trace(spark, path)


def trace_profile(spark, sf_dir):
    return profile(_traces(spark, sf_dir))


def trace_report(spark, sf_dir):
    traces = _traces(spark, sf_dir)
    lost = broken(traces).select(F.lit("broken").alias("key"), F.concat(F.lit("nation "), F.regexp_extract("file", r"s_nationkey=(\d+)", 1)).alias("line"))
    return report(profile(traces)).unionByName(lost)


def selectivity(spark, sf_dir):
    """How many matches the facets of a filter may have, and where `ordered` puts them."""
    x = explorer(spark, sf_dir, "userAgent", "checkpoint", series=()).with_filter({"checkpoint": ["click", "enter"], "userAgent": "mobile:ios", "unknown": ["a", "b"]})
    order = list(x.ordered().spec)
    return spark.createDataFrame([(k, n, order.index(k)) for k, n in x.selectivity().items()], "facet string, score long, place int")


def trace_top(spark, sf_dir):
    """Two functions of one file with most time; then of all, as no key matches."""
    entries = profile(_traces(spark, sf_dir))
    return top(entries, "u1", 2).withColumn("of", F.lit("own")).unionByName(top(entries, "nowhere", 2).withColumn("of", F.lit("all")))


QUERIES = {
    f.__name__: f
    for f in (
        daily_traffic, totals_metrics, group_metrics, group_percentiles, filter_conjunction, filter_unknown, conversions, conversion_rates, facets_plain, facets_drilldown, facet_metrics,
        checkpoint_sources, series_sums, enriched, reclassified_events, classify_acquisition, classify_referrer, classify_consent, filled_days, interpolated_ratio, url_clusters, richness,
        histogram_filtered, clusters_filtered, facet_order, chunks, lifecycle, richness_of_visits, rounded_to_confidence, trace_top, trace_report, selectivity, dark_matter, sampling, z_test, t_test, trend, scores, append_bundles, url_masks, known_facets, readable, trace_profile,
    )
}
QUERIES |= {f"filter_{c}": _filter(c) for c in ("some", "every", "none", "never")}
QUERIES |= {f"facet_{n}": _facet(n) for n in fa.FACETS}
QUERIES |= {f"histogram_{s}": _histogram(s) for s in ("linear", "logarithmic", "quantiles")}
