"""CPU profiles of browser traces: time by function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import milliseconds

TRACE = (
    "traceEvents array<struct<cat:string,name:string,args:struct<data:struct<cpuProfile:struct<nodes:array<struct<id:long,callFrame:struct<url:string,functionName:string>>>,samples:array<long>>,"
    "timeDeltas:array<long>>>>>"
)


BROKEN = "_corrupt_record"


def read_trace(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Trace files as JSON, gzipped or not, with their names; a malformed file gives no events and is told by `broken`."""
    rows = spark.read.schema(f"{TRACE}, {BROKEN} string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path)
    bad = F.col(BROKEN).isNotNull()
    return rows.select(F.when(~bad, F.col("traceEvents")).alias("traceEvents"), F.input_file_name().alias("file"), bad.alias("broken"))


def broken(traces: DataFrame) -> DataFrame:
    """Names of files that couldn't be read; the others are profiled all the same."""
    # the events are named too: Spark refuses to read nothing but what it couldn't parse
    return traces.where(F.col("broken") & F.col("traceEvents").isNull()).select("file").distinct()


def profile(traces: DataFrame) -> DataFrame:
    """key (url#function), time in microseconds and samples, most time first."""
    events = traces.select(F.explode("traceEvents").alias("e")).where("e.cat = 'disabled-by-default-v8.cpu_profiler' AND e.name = 'ProfileChunk'")
    data = F.col("e.args.data")
    chunks = events.select(data["cpuProfile"]["nodes"].alias("nodes"), F.coalesce(data["cpuProfile"]["samples"], F.array().cast("array<long>")).alias("samples"), data["timeDeltas"].alias("deltas")).where("nodes IS NOT NULL AND deltas IS NOT NULL")
    frames = F.map_from_entries(F.transform(F.array_distinct(F.transform("nodes", lambda n: n["id"])), lambda i: F.struct(i, F.try_element_at(F.filter("nodes", lambda n: n["id"] == i), F.lit(-1))["callFrame"])))
    rows = chunks.select(frames.alias("frames"), "deltas", F.posexplode("samples").alias("i", "node"))
    frame = F.try_element_at(F.col("frames"), F.col("node"))
    rows = rows.select(frame.alias("f"), F.coalesce(F.get("deltas", F.col("i")), F.lit(0)).alias("t")).where("f IS NOT NULL")
    key = F.concat(F.coalesce("f.url", F.lit("(inline)")), F.lit("#"), F.coalesce("f.functionName", F.lit("(anonymous)")))
    return rows.groupBy(key.alias("key")).agg(F.sum("t").alias("time"), F.count("*").alias("samples")).orderBy(F.desc("time"), "key")


def top(entries: DataFrame, own: str, n: int = 25) -> DataFrame:
    """The n largest entries whose key matches a pattern, or the n largest of all if none does."""
    ours = entries.where(F.col("key").rlike(own))
    return (ours if ours.limit(1).count() else entries).orderBy(F.desc("time"), "key").limit(n)


def report(entries: DataFrame) -> DataFrame:
    """Entries as lines of text: time in milliseconds, samples and key."""
    return entries.select("key", F.concat(milliseconds(F.col("time")), F.lit("\t(samples="), F.col("samples").cast("string"), F.lit(")\t"), F.col("key")).alias("line"))
