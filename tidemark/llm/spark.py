"""What the operators share on the Spark side."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES, LEAST_BYTES = 8 << 20, 1 << 20
OWNERS, OWNER_BYTES, TASKS = 48, 128 << 20, 20_000


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where they see the driver's folders; clusters get it by --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(mod: int, rest: int, col: str = "doc_id"):
    """crc32 of the id as text, mod, compared; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod) == rest


def shared_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which all executors reach."""
    base = reachable(spark).conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and found.isDefined():
        base = found.get()
    elif not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
    if found.isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again; as many files as its bytes need, not as it had tasks."""
    shared_dir(df.sparkSession)
    return df.hint("rebalance").checkpoint()


@dataclass(frozen=True)
class Chunks:
    """Documents by chunk; how many chunks there are, and owners of hash ranges."""

    docs: DataFrame
    n: int
    owners: int

    def home(self, df: DataFrame) -> DataFrame:
        """Rows dealt by chunk, as many chunks to each task."""
        return df.repartitionById(min(self.n, TASKS), "chunk")

    def owned(self, df: DataFrame) -> DataFrame:
        """Rows dealt by owner, as many owners to each task."""
        return df.repartitionById(min(self.owners, TASKS), "part")

    def with_docs(self, right: DataFrame, f, schema: str) -> DataFrame:
        """f(documents, rows) for every chunk; the documents' shuffle is the same for all uses."""
        return self.docs.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(f, schema)


def chunked(docs: DataFrame, *more) -> Chunks:
    """Documents dealt by a hash of doc_id and text into chunks of about CHUNK_BYTES.

    The number of chunks follows the bytes of text, so a chunk fits a task at any size; a
    small table gets as many as there are shuffle partitions, of LEAST_BYTES at least.
    Rows that share a doc_id, or have none, are dealt by their texts. Owners are a fixed
    number until a range would exceed what OWNER_BYTES of text give; what a chunk sends
    to an owner is one packed row, and there are never more rows than entries in them.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-total // CHUNK_BYTES), min(partitions, total // LEAST_BYTES))
    base = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk"), *more)
    return Chunks(base.repartitionById(min(n, TASKS), "chunk"), n, max(OWNERS, -(-total // OWNER_BYTES)))
