"""Substring dedup by De Bruijn compaction.

Words make a graph: K consecutive words are an edge, from the node of its first K - 1 words
to that of its last K - 1. Documents are dealt into chunks of about 8 MB (see spark.chunked).

1. Edges. A chunk sends its distinct edges, as 48-bit hashes, sorted and packed, to the
   owners of ranges of the hash space. An owner tells each chunk which of them another chunk
   has too; with those that two of its own documents have, these are the repeated edges
   (and, by accident of hashing, a few more: that costs work, not results).
2. Nodes. For each node at a repeated edge a chunk sends the node's hash and one of its
   neighbours, the words before and after. A node has one edge in and one out if all its
   neighbours are alike; else it branches. A document's begin and end count as neighbours,
   so between branching nodes the same documents run along all edges.
3. Paths. Runs of repeated edges whose inner nodes don't branch are compacted: a chunk sends
   each of its distinct paths as a digest of its words (BLAKE2b, 128 bits) and coordinates
   (least document, position). The digest's least coordinates of all chunks are the path's
   source; its digest comes from its own words there, so equal digests verify the path
   word for word. Chunks that have the path in a greater document are told the source.
4. Words covered by paths whose source is a smaller document go.

A chunk sends edges, nodes and paths once however often it has them, and keeps the places
where they stand to itself. So a passage that all documents share is no hot key: it is a
row per chunk, and no row per copy or pair of copies. Neighbours are compared by 48-bit
hashes of the strong hashes of their words, told apart by their bytes: if two neighbours
of one node agreed (one in 2.8e14 branching nodes), its paths would have different digests
and a repeat could stay; nothing is removed wrongly.

Words are runs of bytes that aren't white space (0x20, 0x09-0x0D), compared unchanged. Null
texts count as empty; a document with a null doc_id neither covers nor loses words; rows that
share a doc_id are judged alike against smaller ids, not against each other. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .spark import Chunks, chunked

K = 13
NONE = np.iinfo(np.int64).max
SHIFT = np.uint64(16)  # of 64-bit hashes 48 bits are sent
EDGE, NODE, PATH = 0, 1, 2
SENT = pa.schema([("part", pa.int32()), ("src", pa.int32()), ("keys", pa.binary()), ("near", pa.binary())])
TOLD = pa.schema([("part", pa.int32()), ("src", pa.int32()), ("kind", pa.int32()), ("bits", pa.binary())])
PATHS = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int32()), ("last", pa.int64()), ("chunk", pa.int32())])
FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("source_doc", pa.int64()), ("source_start", pa.int32())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    names = {"int32": "int", "int64": "long", "double": "double", "bool": "boolean"}
    return ", ".join(f"{f.name} " + (f"array<{names[str(f.type.value_type)]}>" if pa.types.is_list(f.type) else names.get(str(f.type), str(f.type))) for f in schema)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(list(c), f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)


class Graph:
    """A chunk's rows by doc_id (null last) and text, its words, and the distinct edges of rows that have a doc_id."""

    def __init__(self, docs: pa.Table, k: int):
        self.k, self.docs = k, docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = self.docs["doc_id"].combine_chunks().fill_null(NONE).to_numpy(zero_copy_only=False) if len(docs) else np.zeros(0, np.int64)
        off, buf = T.layout(T.strings(self.docs["text"]).cast(pa.large_binary()))
        st, en, self.row = T.words(buf, off)
        number, words = T.dictionary(buf, st, en)
        self.hash = T.strong_hashes(words)[number] if len(words) else np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.row, np.arange(len(off)))
        del st, en, number, words, buf
        n = max(0, len(self.row) - k + 1)
        self.at = np.flatnonzero((self.row[:n] == self.row[k - 1 :]) & (self.ids[self.row[:n]] != NONE)) if n else np.zeros(0, np.int64)
        edges = T.rolling(self.hash, k)[self.at] >> SHIFT
        self.order = np.argsort(edges)
        edges = edges[self.order]
        self.begin = np.flatnonzero(np.append(True, edges[1:] != edges[:-1])) if len(edges) else np.zeros(0, np.int64)
        self.edges = edges[self.begin]

    def repeated(self, told: np.ndarray) -> np.ndarray:
        """Which of the words begin a repeated edge: told by owners, or in two rows of the chunk."""
        out = np.zeros(len(self.row) + 1, bool)
        if len(self.at):
            rows = self.row[self.at][self.order]
            more = np.minimum.reduceat(rows, self.begin) != np.maximum.reduceat(rows, self.begin)
            out[self.at[self.order]] = np.repeat(more | told, np.diff(np.append(self.begin, len(self.order))))
        return out

    def nodes(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes at repeated edges: word positions, hashes, and hashes of both neighbours."""
        spot = repeated.copy()
        spot[1:] |= repeated[:-1]
        at = np.flatnonzero(spot)  # edges lie within rows, so their end nodes do
        row, m = self.row[at] if len(at) else at, len(self.row)
        before, after = at - 1, at + self.k - 1
        into = np.where((before >= 0) & (self.row[np.maximum(before, 0)] == row), self.hash[np.maximum(before, 0)], np.uint64(1)) if len(at) else np.zeros(0, np.uint64)
        last = np.minimum(after, m - 1)
        out = np.where((after < m) & (self.row[last] == row), self.hash[last], np.uint64(2)) if len(at) else np.zeros(0, np.uint64)
        return at, T.rolling(self.hash, self.k - 1)[at], T.mix(into * T._ROLL + T.mix(out)) >> SHIFT


def _distinct(h: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct nodes in order, their neighbours' hash, and which of them branch."""
    o = np.argsort(h)
    s, x = h[o], near[o]
    at = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    if not len(s):
        return s, x, np.zeros(0, bool)
    least, most = np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)
    return s[at], least, least != most


def _blocks(key, keys: np.ndarray, shift: np.uint64, owners: int, near=lambda i, j: b"") -> pa.Table:
    """Ascending keys by owner; shift makes them fill 64 bits."""
    cut = T.ranges(keys << shift, owners)
    return _table(SENT, [(p, key[0].as_py(), T.pack_sorted(keys[i:j]), near(i, j)) for p, (i, j) in enumerate(zip(cut, cut[1:])) if j > i])


def _send_edges(key, docs: pa.Table, owners: int, k: int) -> pa.Table:
    return _blocks(key, Graph(docs, k).edges, SHIFT, owners)


def _told(key, sent: pa.Table, kind: int, keys: list[np.ndarray], flag: np.ndarray) -> pa.Table:
    cut = np.cumsum([len(x) for x in keys])[:-1]
    return _table(TOLD, [(key[0].as_py(), s, kind, T.pack(np.packbits(x))) for s, x in zip(sent["src"].to_pylist(), np.split(flag, cut))])


def _tell_edges(key, sent: pa.Table) -> pa.Table:
    """For each chunk's edges whether another chunk has them."""
    keys = [T.unpack_sorted(x) for x in sent["keys"].to_pylist()]
    h = np.concatenate(keys)
    o = np.argsort(h)
    s = h[o]
    same, flag = s[1:] == s[:-1], np.empty(len(h), bool)
    flag[o] = np.append(False, same) | np.append(same, False)
    return _told(key, sent, EDGE, keys, flag)


def _bits(told: pa.Table, kind: int, keys: np.ndarray, shift: np.uint64, owners: int) -> np.ndarray:
    """A flag for each of the ascending keys, from what their owners told."""
    mine = told.filter(pa.compute.equal(told["kind"], kind)).sort_by("part")
    sizes = np.diff(T.ranges(keys << shift, owners))
    out = [np.unpackbits(T.unpack(x, np.uint8), count=int(n)).astype(bool) for x, n in zip(mine["bits"].to_pylist(), sizes[sizes > 0])]
    return np.concatenate([np.zeros(0, bool), *out])


def _send_nodes(key, docs: pa.Table, told: pa.Table, owners: int, k: int) -> pa.Table:
    g = Graph(docs, k)
    _, h, near = g.nodes(g.repeated(_bits(told, EDGE, g.edges, SHIFT, owners)))
    h, near, branch = _distinct(h, near)
    # a node that branches here needs no neighbours: 0 is told apart from all others
    near = np.where(branch, np.uint64(0), np.maximum(near, np.uint64(1)))
    return _blocks(key, h, np.uint64(0), owners, lambda i, j: T.pack(near[i:j]))


def _tell_nodes(key, sent: pa.Table) -> pa.Table:
    """For each chunk's nodes whether they branch."""
    keys = [T.unpack_sorted(x) for x in sent["keys"].to_pylist()]
    h, near = np.concatenate(keys), np.concatenate([T.unpack(x, np.uint64) for x in sent["near"].to_pylist()])
    s, least, branch = _distinct(h, near)
    return _told(key, sent, NODE, keys, (branch | (least == 0))[np.searchsorted(s, h)])


def _paths(g: Graph, told: pa.Table, owners: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Digests, rows, first words and lengths of every path of every row: runs of repeated edges whose inner nodes don't branch."""
    repeated = g.repeated(_bits(told, EDGE, g.edges, SHIFT, owners))
    at, h, _ = g.nodes(repeated)
    keys, which = np.unique(h, return_inverse=True)
    ends = np.ones(len(g.row) + 1, bool)
    ends[at] = _bits(told, NODE, keys, np.uint64(0), owners)[which] if len(at) else True
    hit = np.flatnonzero(repeated)
    if not len(hit):
        return [], hit, hit, hit
    new = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (g.row[hit[1:]] != g.row[hit[:-1]]) | ends[hit[1:]]))
    n = np.diff(np.append(new, len(hit))) + g.k - 1
    row = g.row[hit[new]]
    start = hit[new] - g.first[row]
    texts, now, ws, digests = T.strings(g.docs["text"]), -1, [], []
    for r, a, m in zip(row.tolist(), start.tolist(), n.tolist()):
        if r != now:
            now, ws = r, texts[r].as_py().encode().split()
        digests.append(hashlib.blake2b(b" ".join(ws[a : a + m]), digest_size=16).digest())
    return digests, row, start, n


def _send_paths(key, docs: pa.Table, told: pa.Table, owners: int, k: int) -> pa.Table:
    """The chunk's distinct paths: least document and position, and the greatest document."""
    g = Graph(docs, k)
    digests, row, start, _ = _paths(g, told, owners)
    found: dict[bytes, tuple] = {}
    last: dict[bytes, int] = {}
    for d, i, s in zip(digests, g.ids[row].tolist(), start.tolist()):  # rows ascend by doc_id
        found.setdefault(d, (i, s))
        last[d] = i
    return _table(PATHS, [(d, *at, last[d], key[0].as_py()) for d, at in found.items()])


def _find(g: Graph, told: pa.Table, owners: int) -> pa.Table:
    """row, start and n of paths whose source is a smaller document, and the source."""
    digests, row, start, n = _paths(g, told, owners)
    mine = told.filter(pa.compute.equal(told["kind"], PATH))
    source = dict(zip(mine["bits"].to_pylist(), zip(mine["doc"].to_pylist(), mine["start"].to_pylist())))
    doc, begin = (np.array(x, np.int64) for x in zip(*[source.get(d, (NONE, 0)) for d in digests])) if digests else (row, row)
    hit = doc < g.ids[row]
    return pa.table({"row": row[hit], "start": start[hit], "n": n[hit], "source_doc": doc[hit], "source_start": begin[hit]})


def _spans(docs: pa.Table, told: pa.Table, owners: int, k: int) -> pa.Table:
    g = Graph(docs, k)
    got = _find(g, told, owners)
    return pa.table([pa.array(g.ids[got["row"].to_numpy()]), *got.columns[1:]], FOUND.names).cast(FOUND)


def _remove(docs: pa.Table, told: pa.Table, owners: int, k: int, texts: bool) -> pa.Table:
    g = Graph(docs, k)
    docs, spans = g.docs, _find(g, told, owners)
    del g
    row, start, n = (spans[c].to_numpy() for c in ("row", "start", "n"))
    cut = np.searchsorted(row, np.arange(len(docs) + 1))
    out = []
    for k, (doc, t) in enumerate(zip(docs["doc_id"].to_pylist(), T.strings(docs["text"]))):
        ws, gone = t.as_py().encode().split(), 0
        total = len(ws)
        if cut[k + 1] > cut[k]:
            edge = np.zeros(total + 1, np.int64)
            np.add.at(edge, start[cut[k] : cut[k + 1]], 1)
            np.add.at(edge, start[cut[k] : cut[k + 1]] + n[cut[k] : cut[k + 1]], -1)
            stay = np.cumsum(edge)[:total] == 0
            gone = total - int(stay.sum())
            ws = list(compress(ws, stay.tolist()))
        line = b" ".join(ws)
        out.append((doc, total, gone, hashlib.sha256(line).hexdigest(), line.decode() if texts else None))
    return _table(RESULT, out)


def _told_paths(c: Chunks, k: int) -> DataFrame:
    """All that chunks need to know: which edges are repeated, which nodes branch, and the sources of paths."""
    n = c.owners
    edges = c.owned(c.docs.groupBy("chunk").applyInArrow(lambda key, t: T.freed(_send_edges, key, t, n, k), _ddl(SENT)))
    told = edges.groupBy("part").applyInArrow(lambda key, t: T.freed(_tell_edges, key, t), _ddl(TOLD)).withColumnRenamed("src", "chunk")
    nodes = c.owned(c.with_docs(c.home(told), lambda key, a, b: T.freed(_send_nodes, key, a, b, n, k), _ddl(SENT)))
    told = told.unionByName(nodes.groupBy("part").applyInArrow(lambda key, t: T.freed(_tell_nodes, key, t), _ddl(TOLD)).withColumnRenamed("src", "chunk"))
    paths = c.with_docs(c.home(told), lambda key, a, b: T.freed(_send_paths, key, a, b, n, k), _ddl(PATHS))
    source = F.min(F.struct("doc_id", "start")).over(Window.partitionBy("digest"))
    sources = paths.withColumn("source", source).where(F.col("source.doc_id") < F.col("last"))
    sources = sources.select("chunk", F.lit(PATH).alias("kind"), F.col("digest").alias("bits"), F.col("source.doc_id").alias("doc"), F.col("source.start").alias("start"))
    return c.home(told.unionByName(sources, allowMissingColumns=True))


def find_repeats(docs: DataFrame, k: int = K) -> DataFrame:
    """Paths of words that a smaller document has too: doc_id, start, n (words), source_doc, source_start."""
    c = chunked(docs)
    n = c.owners
    return c.with_docs(_told_paths(c, k), lambda key, a, b: T.freed(_spans, a, b, n, k), _ddl(FOUND))


def remove_repeats(docs: DataFrame, k: int = K, texts: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and with texts the kept words as `kept`."""
    c = chunked(docs)
    n = c.owners
    out = c.with_docs(_told_paths(c, k), lambda key, a, b: T.freed(_remove, a, b, n, k, texts), _ddl(RESULT))
    return out if texts else out.drop("kept")
