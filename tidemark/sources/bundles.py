"""Page views as rows ("bundles") of nested events: schema, readers, derived columns, and a view over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("checkpoint", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("timeDelta", T.DoubleType()),
])
BUNDLE = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("id", "host", "time", "timeSlot", "url", "userAgent", "hostType")),
    T.StructField("weight", T.LongType()),
    T.StructField("domain", T.StringType()),
    T.StructField("events", T.ArrayType(EVENT)),
])
CHUNK = T.StructType([T.StructField("date", T.StringType()), T.StructField("rumBundles", T.ArrayType(BUNDLE))])


def flatten(chunks: DataFrame) -> DataFrame:
    """The bundles of chunks (date, rumBundles)."""
    return chunks.select(F.explode("rumBundles").alias("b")).select("b.*")


def read_chunks(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Bundles of JSON chunks, one to a line; gzip is read as such.

    With multi_line a file is one chunk, or an array of them, over any number of lines; it
    is then the work of one task, so large inputs should have a chunk to a line.
    """
    return flatten(spark.read.schema(CHUNK).option("multiLine", multi_line).json(path))


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Bundles stored as Parquet."""
    return spark.read.parquet(path)


def write_chunks(bundles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON chunks, one to a line: the bundles of a time slot that one task has."""
    raw = F.struct(*[F.col(f.name) for f in BUNDLE])
    chunks = bundles.groupBy(F.col("timeSlot").alias("date"), F.spark_partition_id().alias("part")).agg(F.collect_list(raw).alias("rumBundles"))
    chunks.drop("part").write.mode(mode).json(path)


def write_bundles(bundles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet partitioned by day, so that reads of a span of time prune."""
    bundles.withColumn("date", F.substring("timeSlot", 1, 10)).write.mode(mode).partitionBy("date").parquet(path)


def append(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both, duplicates kept; missing columns become null."""
    return left.unionByName(right, allowMissingColumns=True)


def empty(spark: SparkSession) -> DataFrame:
    return enrich(spark.createDataFrame([], BUNDLE))


def _of(checkpoint: str) -> Column:
    return F.filter("events", lambda e: e["checkpoint"] == checkpoint)


def enrich(bundles: DataFrame) -> DataFrame:
    """Adds visit and the web vitals; an empty source of an enter event becomes (direct).

    INP and TTFB are those of the last such event, LCP and CLS the largest with a
    missing value as 0; null where there is no such event.
    """
    named = F.transform("events", lambda e: e.withField("source", F.when((e["checkpoint"] == "enter") & (e["source"] == ""), "(direct)").otherwise(e["source"])))
    last = lambda cp: F.try_element_at(_of(cp), F.lit(-1))["value"]
    largest = lambda cp: F.array_max(F.transform(_of(cp), lambda e: F.greatest(F.coalesce(e["value"], F.lit(0.0)), F.lit(0.0))))
    return bundles.withColumns({
        "events": named,
        "visit": F.coalesce(F.exists("events", lambda e: e["checkpoint"] == "enter"), F.lit(False)),
        "cwvINP": last("cwv-inp"), "cwvLCP": largest("cwv-lcp"), "cwvCLS": largest("cwv-cls"), "cwvTTFB": last("cwv-ttfb"),
    })


#: Events of the tables as page-view events; runs unchanged in Spark and ANSI databases.
EVENTS_SQL = """
SELECT e.event_id, e.ts,
  concat(cast(e.user_id AS varchar(20)), '-', cast(cast(e.ts AS date) AS varchar(20))) AS id,
  cast(cast(e.ts AS date) AS varchar(20)) AS slot, p.url AS url, cast(100 * (1 + e.user_id % 3) AS bigint) AS weight,
  CASE e.user_id % 4 WHEN 0 THEN 'desktop:windows' WHEN 1 THEN 'desktop:mac' WHEN 2 THEN 'mobile:ios' ELSE 'mobile:android' END AS ua,
  CASE e.event_type
    WHEN 'view' THEN CASE e.event_id % 10 WHEN 6 THEN 'viewmedia' WHEN 7 THEN 'viewblock' WHEN 8 THEN 'prerender' WHEN 9 THEN 'navigate' ELSE 'enter' END
    WHEN 'click' THEN 'click'
    WHEN 'signup' THEN CASE WHEN e.event_id % 10 < 6 THEN 'utm' WHEN e.event_id % 10 < 8 THEN 'paid' ELSE 'email' END
    WHEN 'purchase' THEN CASE WHEN e.event_id % 10 < 4 THEN 'cwv-lcp' WHEN e.event_id % 10 < 6 THEN 'cwv-cls' WHEN e.event_id % 10 < 8 THEN 'cwv-inp' ELSE 'cwv-ttfb' END
    ELSE CASE WHEN e.event_id % 10 < 7 THEN 'viewblock' ELSE 'error' END END AS checkpoint,
  CASE
    WHEN e.event_type = 'view' AND e.event_id % 10 < 6 THEN
      CASE e.event_id % 7 WHEN 0 THEN 'https://www.google.com/' WHEN 1 THEN 'https://l.facebook.com/' WHEN 2 THEN '' WHEN 3 THEN 'https://News.Example.org/a#top'
        WHEN 4 THEN 'not a url' WHEN 5 THEN 'https://chatgpt.com/?q=1' ELSE 'https://www.bing.com' END
    WHEN e.event_type = 'signup' AND e.event_id % 10 < 6 THEN CASE e.event_id % 3 WHEN 0 THEN 'utm_source' WHEN 1 THEN 'UTM_medium' ELSE 'utm_campaign' END
    WHEN e.event_type = 'signup' THEN CASE e.event_id % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'marketo' WHEN 2 THEN 'x' END
    WHEN e.event_type = 'click' THEN CASE e.event_id % 5 WHEN 0 THEN '#onetrust-accept-btn' WHEN 1 THEN '#truste .close' ELSE '.hero a' END
    WHEN e.event_type = 'purchase' AND e.event_id % 2 = 0 THEN '.hero img' END AS source,
  CASE
    WHEN e.event_type = 'signup' THEN CASE e.event_id % 8 WHEN 0 THEN 'google' WHEN 1 THEN 'facebook' WHEN 2 THEN 'newsletter' WHEN 3 THEN 'cpc' WHEN 4 THEN 'tiktok'
        WHEN 5 THEN 'sfmc' WHEN 6 THEN 'organic_social' ELSE 'gmb' END
    WHEN e.event_type = 'view' AND e.event_id % 10 = 9 AND e.event_id % 4 = 1 THEN 'prerendered'
    WHEN e.event_type = 'view' AND e.event_id % 10 = 6 THEN CASE e.event_id % 7 WHEN 0 THEN '/media/a.png?width=750#x' WHEN 1 THEN '../b.png#x'
        WHEN 2 THEN concat(split_part(p.url, '/', 1), '//', split_part(p.url, '/', 3), '/own/c.png?q') WHEN 3 THEN '//cdn.example.com/d.png'
        ELSE concat('https://media.example.com/image-', cast(e.event_id % 7 AS varchar(20)), '.png?width=750#x') END
    WHEN e.event_type = 'purchase' AND e.event_id % 3 = 0 THEN 'https://media.example.com/hero.png' END AS target,
  CASE WHEN e.event_type = 'purchase' THEN
    CASE WHEN e.event_id % 10 < 4 THEN floor(e.value * 100) WHEN e.event_id % 10 < 6 THEN floor(e.value) / 256 WHEN e.event_id % 10 < 8 THEN floor(e.value * 8) ELSE floor(e.value * 32) END END AS value
FROM (SELECT *, (user_id * 31 + extract(DAY FROM ts)) % (SELECT nullif(count(*), 0) FROM {pages}) AS page FROM {events}) e JOIN {pages} p ON p.page_id = e.page
"""


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched bundles over the events and pages tables: one per user and day, events in order of time and id."""
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("events", "pages")}
    rows = spark.sql(EVENTS_SQL, **tables)
    event = F.struct("ts", "event_id", "checkpoint", "source", "target", F.col("value").cast("double").alias("value"))
    first = lambda c: F.min(c).alias(c)  # noqa: E731  the same in all rows of an id
    bundles = rows.groupBy("id").agg(first("slot"), first("url"), first("weight"), first("ua"), F.array_sort(F.collect_list(event)).alias("events"))
    events = F.transform("events", lambda e: F.struct(e["checkpoint"].alias("checkpoint"), e["source"].alias("source"), e["target"].alias("target"), e["value"].alias("value"), F.lit(None).cast("double").alias("timeDelta")))
    host = F.lower(F.regexp_extract("url", r"^[^:]+://([^/?#]+)", 1))
    return enrich(bundles.select(
        "id", host.alias("host"), F.col("slot").alias("timeSlot"), F.col("slot").alias("time"), "url", F.col("ua").alias("userAgent"), F.lit("external").alias("hostType"),
        "weight", F.lit(None).cast("string").alias("domain"), events.alias("events"),
    ))
