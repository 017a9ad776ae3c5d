"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Fingerprints that differ in at most 4 bits agree in
at least 4 bytes at their positions, so a pair is kept only if its tally of shared
positional bytes reaches 4, and then verified by its differing bits. Posting lists of
single bytes would hold a 256th of all fingerprints each, and tallies all pairs within
them; so the lists are those of four positional bytes together, 70 for each fingerprint,
and every pair whose tally can reach 4 shares one. Only distinct fingerprints are posted:
copies are members of one class.

Within a posting list a breadth-first walk tallies the shared bytes of a fingerprint with
each of those not reached yet, a vector at a time, and emits links of a spanning forest:
never all pairs, and no connection is lost. Lists are read as sorted streams of 8-byte
values. Components come from star contraction over the links.

Null texts count as empty and, as all texts without a word, have fingerprint 0,
which links like any other. Rows with one doc_id are members alike; a null doc_id
gets a fingerprint and no part in a component's least id. Extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .components import components, joined
from .spark import checkpointed

RADIUS, SHINGLE, SEED = 4, 4, 42
BYTES = 8 - RADIUS


def fingerprint(text: bytes) -> int:
    """Bits set in over half of the shingles' hashes, repeats included."""
    ws = text.lower().split()  # bytes: A-Z only, and exactly the six white-space bytes
    if not ws:
        return 0
    line = b" ".join(ws)
    lens = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    ends = np.cumsum(lens) - 1
    starts = (ends - lens + 1)[: max(1, len(ws) - SHINGLE + 1)].tolist()
    ends = ends[min(SHINGLE, len(ws)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 14):
        raw = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[k : k + (1 << 14)], ends[k : k + (1 << 14)])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The column key and the text's fingerprint as a signed long."""

    def run(batches):
        for b in T.slices(batches):
            col = T.strings(b["text"])
            off, buf = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1].tolist(), memoryview(col.buffers()[2] or b"")
            out = np.array([fingerprint(bytes(buf[i:j])) for i, j in zip(off, off[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([b[key], pa.array(out.view(np.int64))], [key, "bits"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, bits long")


def forest(x: np.ndarray) -> list[tuple[int, int]]:
    """Links within RADIUS that connect what such links connect, by breadth-first search."""
    links, left = [], x
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            d = left ^ at
            near = (d.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= BYTES  # the tally
            near[near] = np.bitwise_count(d[near]) <= RADIUS
            if near.any():
                new = left[near]
                left = left[~near]
                links += [(at, y) for y in new]
                queue += list(new)
    return links


def _linked(batches):
    """Streams of (tab, key, bits) sorted by tab and key: links of each posting list of two or more."""
    out: list = []
    for _, (bits,) in T.runs(batches, ("tab", "key"), ("bits",), 2):
        out += forest(bits.view(np.uint64))
        if len(out) > 1 << 16:
            yield _rows(out)
            out = []
    if out:
        yield _rows(out)


def _rows(links: list) -> pa.RecordBatch:
    got = np.array(links, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints `bits` within RADIUS."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    masks = [signed(sum(0xFF << 8 * k for k in c)) for c in itertools.combinations(range(8), BYTES)]
    n = max(8, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    postings = prints.select("bits").distinct().repartition(n, F.xxhash64("bits")).select(F.posexplode(F.array(*[F.col("bits").bitwiseAND(F.lit(m)) for m in masks])).alias("tab", "key"), "bits")
    sorted_lists = postings.repartition(n, "tab", "key").sortWithinPartitions("tab", "key")
    return sorted_lists.mapInArrow(_linked, "a long, b long").distinct()


def _rooted(of_bits: DataFrame) -> DataFrame:
    """Rows of distinct fingerprints `bits` with the root of their component."""
    roots = components(links(of_bits))
    return of_bits.join(roots, of_bits["bits"] == roots["node"], "left").select(*of_bits.columns, F.coalesce("root", "bits").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id reachable)."""
    prints = checkpointed(fingerprints(docs))
    total = prints.count()
    of_bits = _rooted(prints.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    classes = of_bits.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = checkpointed(joined(of_bits, classes, "root", total).select("bits", "component_id", F.col("rows").alias("n")))
    return joined(prints, named, "bits", total).select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the least doc_id (nulls last), then of the least digest.

    A row is known by a digest of all its columns, so rows that share a doc_id or have
    none are told apart, and which one stays depends on nothing but the rows.
    """
    # to_json leaves nulls out, so null and empty differ
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.unhex(F.sha2(F.to_json(F.struct("*")), 256)).alias("digest")).alias("key"), "text")
    prints = checkpointed(fingerprints(rows, "key"))
    of_bits = _rooted(prints.groupBy("bits").agg(F.min("key").alias("first")))
    keep = of_bits.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.digest").alias("digest"))
    rows = rows.select("row", F.col("key.digest").alias("digest"))
    return rows.dropDuplicates(["digest"]).join(keep, "digest", "left_semi").select("row.*")
