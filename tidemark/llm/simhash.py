"""SimHash fingerprints of documents, and their neighbours within a Hamming radius.

Terms are pairs of consecutive lower-case words (one word alone: itself), hashed
to 64 bits; a term votes on every bit with weight 1 + log2 of its occurrences,
rounded down to an integer, so sums are exact in any order. A bit is 1 if its
votes are positive; no terms gives 0. Fingerprints are 16 hexadecimal digits,
likeness is 1 - differing bits / 64. Null texts count as empty.

Permuted block tables find all fingerprints within a Hamming radius: of BLOCKS blocks of
bits, BLOCKS - radius at least agree; every choice of so many blocks is a table whose key
is those bits. A search posts its queries and all distinct fingerprints under the keys,
and counts or links within each list, without a row per pair.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .components import joined
from .spark import checkpointed

RADIUS, BLOCKS = 3, 5
QUERIES = 50


def votes(h: np.ndarray) -> int:
    """The fingerprint of term hashes."""
    if not len(h):
        return 0
    u, c = np.unique(h, return_counts=True)
    w = 1 + np.floor(np.log2(c))
    total, bits = np.zeros(64), None
    for k in range(0, len(u), 1 << 16):
        bits = np.unpackbits(u[k : k + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        part = w[k : k + (1 << 16)].astype(np.float32)  # exact: sums stay far below 2 ** 24
        total += 2 * (part @ bits.astype(np.float32)).astype(float) - part.sum(dtype=float)
    return int.from_bytes(np.packbits(total > 0).tobytes(), "big")


def fingerprints(buf: np.ndarray, off: np.ndarray) -> list[int]:
    buf = T.LOWER[buf]
    st, en, row = T.words(buf, off)
    h = T.span_hashes(buf, st, en)
    pair = T.rolling(h, 2)
    cut = np.searchsorted(row, np.arange(len(off)))
    return [votes(pair[i : j - 1] if j - i > 1 else h[i:j]) for i, j in zip(cut, cut[1:])]


def of_texts(texts: list[bytes]) -> list[int]:
    out = []
    for _, buf, off in T.pieces(pa.array([x.decode() for x in texts], pa.large_string())):
        out += fingerprints(buf, off)
    return out


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / 64


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text."""

    def run(batches):
        for b in batches:
            out = [f"{x:016x}" for _, buf, off in T.pieces(b["text"]) for x in fingerprints(buf, off)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """Documents by bucket of ascending ids, each bucket with its predecessor as a guest.

    Buckets are ranges of ids with about as many rows each, between quantiles, eight for
    every task, however ids are spread. A bucket's first document has its neighbour in
    the bucket before; that one document, of rows with its id the last by text, comes along.
    The lowest bucket's guest is the highest document of all. Only a row per bucket goes
    to the driver. Rows without an id are dealt by their texts.
    """
    n = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted({int(x) for x in docs.approxQuantile("doc_id", [k / (8 * n) for k in range(1, 8 * n)], 1 / (32 * n))})
    limits = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>") if bounds else F.array().cast("array<long>")  # a literal once folded

    def half(at, _):  # a step of a binary search: how many limits are below the id
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        more = F.get(limits, mid) < F.col("doc_id")
        open_ = at["lo"] < at["hi"]
        return F.struct(F.when(open_ & more, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(open_ & ~more, mid).otherwise(at["hi"]).alias("hi"))

    steps = F.array(*map(F.lit, range(len(bounds).bit_length() + 1)))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), half)["lo"]
    bucket = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(8 * n)).cast("int")).otherwise(found)
    docs = docs.select("doc_id", "text", bucket.alias("bucket"))
    tops = [r[0] for r in docs.where("doc_id is not null").groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("top").select(F.struct("bucket", "top")).collect()]
    hosts = [(t["top"], h["bucket"]) for t, h in zip([*tops[-1:], *tops[:-1]], tops)]
    hosts = docs.sparkSession.createDataFrame(hosts, "top long, host int")  # a row per bucket
    last = docs.join(F.broadcast(hosts.select("top").distinct()), F.col("doc_id") == F.col("top"), "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    guests = last.join(F.broadcast(hosts), F.col("doc_id") == F.col("top")).select("doc_id", "text", F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    both = docs.withColumn("guest", F.lit(False)).unionByName(guests)
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", F.desc("guest"), "doc_id", "text")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text and of the next document.

    The edit replaces the last third of the code points by the first as many of
    the next document in descending doc_id; the lowest document's next is the
    highest, a lone document's next is itself. Of rows with one doc_id, each counts
    as a document, ordered by text; a null doc_id is followed by the empty text.
    """

    def run(batches):
        bucket = before = None
        for b in batches:
            rows, texts = [], []
            for doc, text, home, guest in zip(b["doc_id"].to_pylist(), T.strings(b["text"]).to_pylist(), b["bucket"].to_pylist(), b["guest"].to_pylist()):
                if home != bucket or doc is None:
                    bucket, before = home, ""
                if not guest:
                    n = len(text)
                    edited = (text[: n - n // 3] + before[: n // 3]).encode()
                    rows.append((doc, n, hashlib.sha256(edited).hexdigest()))
                    texts += [text.encode(), edited, before.encode()]
                before = text
            out = []
            for k in range(0, len(rows), 256):
                out += of_texts(texts[3 * k : 3 * k + 768])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [[]] * 3, (pa.int64(), pa.int64(), pa.string()))]
                + [pa.array([f"{x:016x}" for x in out[k::3]], pa.string()) for k in (0, 1)]
                + [pa.array([likeness(a, x) for a, x in zip(out[::3], out[k::3])], pa.float64()) for k in (1, 2)],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _tables(radius: int, blocks: int) -> list[int]:
    """Masks of the bits that make each table's key."""
    edges = [round(k * 64 / blocks) for k in range(blocks + 1)]
    part = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(part[k] for k in c) for c in itertools.combinations(range(blocks), blocks - radius)]


def _lists(prints: DataFrame, masks: list[int], *more: str) -> DataFrame:
    """Distinct `bits` (a long) under every table's key, dealt and sorted by list."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    n = max(8, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = prints.select("bits", *more, F.posexplode(F.array(*[F.col("bits").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("tab", "key"))
    return keyed.repartition(n, "tab", "key").sortWithinPartitions("tab", "key")


def _bits(c: str):
    """A fingerprint's 64 bits as a long."""
    part = lambda k: F.conv(F.substring(c, k, 8), 16, 10).cast("long")
    return F.shiftleft(part(1), 32).bitwiseOR(part(9))


def _near(x: np.uint64, all_: np.ndarray, tab: int, masks: np.ndarray, radius: int) -> np.ndarray:
    """Which of a list's fingerprints are within radius of x, and in no earlier table's list with it."""
    d = all_ ^ x
    near = np.bitwise_count(d) <= radius
    near[near] = ((d[near, None] & masks[:tab]) != 0).all(axis=1)
    return near


def neighbours(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS + 1) -> DataFrame:
    """Pairs (a, b, distance) of distinct fingerprints within radius, a below b; one row for each such pair."""
    masks = np.array(_tables(radius, blocks), np.uint64)

    def pairs(batches):
        for (tab, _), (bits,) in T.runs(batches, ("tab", "key"), ("bits",), 2):
            bits = np.sort(bits.view(np.uint64))
            for k in range(len(bits) - 1):
                got = bits[k + 1 :][_near(bits[k], bits[k + 1 :], int(tab), masks, radius)]
                if len(got):
                    yield pa.RecordBatch.from_arrays([pa.array([f"{bits[k]:016x}"] * len(got)), pa.array([f"{x:016x}" for x in got]), pa.array(np.bitwise_count(got ^ bits[k]).astype(np.int32))], ["a", "b", "distance"])

    found = prints.select(_bits("fingerprint").alias("bits")).distinct()
    return _lists(found, masks.tolist()).mapInArrow(pairs, "a string, b string, distance int")


def count_near(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fingerprint, n (rows that have it) and n_near of each distinct fingerprint of queries: how many other distinct ones of prints are within radius."""
    masks = np.array(_tables(radius, blocks), np.uint64)

    def counts(batches):
        out: list = []
        for (tab, _), (bits, asked) in T.runs(batches, ("tab", "key"), ("bits", "asked"), 2):
            if asked.any():
                mine, all_ = bits.view(np.uint64)[asked], bits.view(np.uint64)[~asked]
                out += [(x, n) for x in mine if (n := int(_near(x, all_[all_ != x], int(tab), masks, radius).sum()))]
            if len(out) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.array([x for x, _ in out], np.uint64).view(np.int64)), pa.array([n for _, n in out], pa.int64())], ["bits", "found"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(np.array([x for x, _ in out], np.uint64).view(np.int64)), pa.array([n for _, n in out], pa.int64())], ["bits", "found"])

    asked = queries.groupBy("fingerprint").agg(F.count("*").alias("n"))
    both = prints.select("fingerprint").distinct().withColumn("asked", F.lit(False)).unionByName(asked.select("fingerprint", F.lit(True).alias("asked")))
    found = _lists(both.select(_bits("fingerprint").alias("bits"), "asked"), masks.tolist(), "asked").mapInArrow(counts, "bits long, found long").groupBy("bits").agg(F.sum("found").alias("found"))
    return asked.join(found, _bits("fingerprint") == F.col("bits"), "left").select("fingerprint", "n", F.coalesce("found", F.lit(0)).cast("long").alias("n_near"))


def fingerprint_and_search(docs: DataFrame) -> DataFrame:
    """fingerprint_edits, and n_near of every document whose id is divisible by QUERIES (null for the others).

    n_near counts the other distinct fingerprints of all documents within RADIUS bits of the document's own.
    """
    rows = checkpointed(fingerprint_edits(docs))
    asked = rows.where(F.col("doc_id") % QUERIES == 0)
    return joined(asked, count_near(asked, rows), "fingerprint").select(*rows.columns, "n_near").unionByName(rows.where(F.coalesce(F.col("doc_id") % QUERIES != 0, F.lit(True))).withColumn("n_near", F.lit(None).cast("long")))
