"""SentencePiece encoding and decoding by a max-plus parallel scan.

For a BPE vocabulary, a sequence of pieces is the encoding of its text exactly if
each piece encodes to itself and each neighbouring pair of pieces encodes to that
pair. Over positions and last pieces this is a lattice whose edges weigh 0 (allowed)
or minus infinity, and the one path of weight 0 is the encoding: the same ids as
the public library gives for the vocabulary.

A text of more than CHUNK characters is cut into chunks of that size, wherever that falls,
and each chunk is a row of its own, with as many characters of its neighbours as the
longest piece has. A chunk yields a transfer matrix from boundary states at its start to
boundary states at its end: a state is how far the piece that crosses or touches the cut
reaches over it, and which piece it is. A text's matrices are multiplied in the max-plus
algebra as a tree, which fixes the state at every cut; then each chunk is traced back on
its own between its two states, and the ids are joined in order. So a giant document is
the work of many tasks, whether it has spaces or not. A shorter text is one chunk, whose
states are its begin and end.

Within a chunk no piece crosses a space that follows another character, or the edges of
characters that no piece combines. All paths meet there, so segments between such places
are solved by themselves, and short ones remembered; a cut at such a place has one state.

Decoding joins pieces (byte pieces give bytes), U+2581 gives a space, and the
leading space that encoding adds is dropped. It is an exact round trip for texts
without U+2581, which decodes to a space as in the library. A null text encodes to
no ids, as the empty one does. The vocabulary file's path is a parameter; its bytes
(a fixed file) are broadcast. Other columns pass through untouched; repeated rows are repeated.
"""

from __future__ import annotations

import gc
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import text as T
from .spark import checkpointed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, REMEMBER, PAIRS, TAIL = 1 << 16, 350_000, 300_000, 4
SPACE = "▁"


class Vocabulary:
    """Pieces of a SentencePiece BPE model, with the lattice's edges."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.unk, self.bytes, self.ids, self.rank, self.out = sp.unk_id(), {}, {}, {}, [b""] * size
        for k in range(size):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.bytes[int(piece[3:-1], 16)] = k
                self.out[k] = bytes([int(piece[3:-1], 16)])
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                self.ids[piece], self.rank[piece] = k, sp.get_score(k)
                self.out[k] = piece.replace(SPACE, " ").encode()
        self.names = {k: p for p, k in self.ids.items()}
        self.longest = max(map(len, self.ids))
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # what no piece crosses: a space after another character (unless some piece has one inside), lone characters
        self.single, self.crossing = {c for c in map(chr, range(128)) if c not in inner and c != " "}, crossing
        single = "".join(map(re.escape, sorted(self.single)))
        self.cut = re.compile(f"[{single}]|[^{single}]+" if crossing else f"[{single}]| +[^ {single}]*|[^ {single}]+", re.S)
        self.pairs: dict[tuple[str, str], bool] = {}
        # pieces that encode to themselves, and "" for what only begins a piece
        self.known: dict[str, str] = {}
        for p in self.ids:
            for n in range(1, len(p)):
                self.known.setdefault(p[:n], "")
            if self.merge(p) == [p]:
                self.known[p] = p

    def merge(self, s: str) -> list[str]:
        """BPE by definition: the best-scored adjacent pair merges first, leftmost among equals."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, p: str) -> bool:
        return len(p) == 1 or bool(self.known.get(p))

    def edge(self, a: str, b: str) -> bool:
        """Weight 0 (True) or minus infinity of piece b after piece a."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return ok

    def scan(self, s: str, begin: int, end: int, start: int, last: str | None) -> dict[int, str]:
        """The last piece of the path to each position in start .. that begins before end, given the piece before start.

        Positions up to end + longest - 1 may be reached: pieces crossing the cut.
        """
        path: dict[int, str] = {start: last}  # type: ignore[dict-item]
        known, pairs, n = self.known.get, self.pairs.get, len(s)
        for q in range(start, end):
            if q not in path:
                continue
            a = path[q]
            e = q + 1
            b = known(s[q:e])
            more = b is not None
            if not b:
                b = s[q]  # a character without a piece stands alone
            while True:
                if b and e not in path:
                    ok = a is None or pairs((a, b))
                    if ok is None:
                        ok = self.edge(a, b)
                    if ok:
                        path[e] = b
                if not more or e == n:
                    break
                e += 1
                b = known(s[q:e])
                if b is None:
                    break
        return path

    def trace(self, path: dict[int, str], start: int, p: int) -> list[str]:
        out = []
        while p > start:
            out.append(path[p])
            p -= len(path[p])
        return out[::-1]

    def segment(self, s: str) -> list[str]:
        """The pieces of a segment: its one path of weight 0, longer pieces tried first, no state twice."""
        known, pairs, n = self.known.get, self.pairs.get, len(s)
        pairs_ = self.pairs
        out: list[str] = []
        ways: list[list[str]] = []  # pieces left to try after each of out, the longest last
        dead: set[tuple[int, str]] = set()
        q, a = 0, ""
        while q < n:
            if dead and (q, a) in dead:
                ways.append([])
            else:
                e = q + 1
                b = known(s[q:e])
                found = [b or s[q]]  # a character without a piece stands alone
                while b is not None and e < n:
                    e += 1
                    b = known(s[q:e])
                    if b:
                        found.append(b)
                ways.append(found)
            left = ways[-1]
            while True:
                if not left:  # a dead end
                    dead.add((q, a))
                    ways.pop()
                    left = ways[-1]
                    q -= len(out.pop())
                    a = out[-1] if out else ""
                    continue
                b = left.pop()
                if not a or pairs((a, b)) or ((a, b) not in pairs_ and self.edge(a, b)):
                    break
            out.append(b)
            q += len(b)
            a = b
        return out

    def parts(self, s: str, at: int) -> bool:
        """Whether no piece crosses a place in a text."""
        a, b = s[at - 1], s[at]
        return a in self.single or b in self.single or (not self.crossing and b == " " and a != " ")

    def states(self, s: str, cut: int) -> list[tuple[int, str | None]]:
        """Boundary states at a cut: how far the piece that covers or ends at it reaches over, and the piece."""
        if cut in (0, len(s)) or self.parts(s, cut):
            return [(0, None)]
        s = s.replace(" ", SPACE)
        return [(r, s[cut + r - n : cut + r]) for r in range(min(self.longest, len(s) - cut + 1)) for n in range(r + 1 if r else 1, min(self.longest, cut + r) + 1) if self.whole(s[cut + r - n : cut + r])]

    def encode_segment(self, segment: str) -> list[int]:
        return self.coded(self.segment(segment.replace(" ", SPACE)))

    def coded(self, pieces: list[str]) -> list[int]:
        ids = []
        for p in pieces:
            k = self.ids.get(p)
            ids += [k] if k is not None else [self.bytes.get(x, self.unk) for x in p.encode()] if self.bytes else [self.unk]
        return ids


class Chunk:
    """One chunk of a text: what stands in it, and as many characters before and after it as the longest piece has.

    Places count in `whole`, the three joined; the text begins or ends there if left or right is empty.
    """

    def __init__(self, v: Vocabulary, left: str, mid: str, right: str):
        self.v, self.whole, self.begin, self.end = v, left + mid + right, len(left), len(left) + len(mid)
        self.before, self.after = v.states(self.whole, self.begin), v.states(self.whole, self.end)
        self.text = self.whole.replace(" ", SPACE)
        # the first and the last place that no piece crosses; None if there is none
        inner = (q for q in range(self.begin + 1, self.end) if v.parts(self.whole, q))
        self.first = self.begin if self.before == [(0, None)] else next(inner, self.end if self.after == [(0, None)] else None)
        self.last = self.first
        if self.first is not None:
            back = (q for q in range(self.end - 1, self.first, -1) if v.parts(self.whole, q))
            self.last = self.end if self.after == [(0, None)] else next(back, self.first)

    def _to(self, end: int, state: tuple[int, str | None]) -> dict[int, str]:
        r, last = state
        return self.v.scan(self.text, self.begin, end, self.begin + r, last)

    def _ends(self, path: dict[int, str], row: np.ndarray) -> None:
        for j, (over, piece) in enumerate(self.after):
            if path.get(self.end + over) == piece:
                row[j] = 0

    def transfer(self) -> np.ndarray:
        """Max-plus matrix: 0 where a path leads from a state at the start to one at the end, else minus infinity."""
        m = np.full((len(self.before), len(self.after)), -np.inf)
        if self.first is None:  # one segment goes through the whole chunk
            for i, state in enumerate(self.before):
                if self.begin + state[0] <= self.end:
                    self._ends(self._to(self.end, state), m[i])
                else:
                    m[i, [j for j, x in enumerate(self.after) if x == (self.begin + state[0] - self.end, state[1])]] = 0
            return m
        into = [self.first == self.begin or (self.begin + x[0] <= self.first and self.first in self._to(self.first, x)) for x in self.before]
        out = np.full(len(self.after), -np.inf)
        if self.last == self.end:
            out[0] = 0
        else:
            self._ends(self.v.scan(self.text, self.last, self.end, self.last, None), out)
        m[into] = out
        return m

    def ids(self, a: int, b: int, memory: Memory) -> list[int]:
        """The ids between two states: the path is traced back, remembered segments are looked up."""
        (r, _), (over, _) = self.before[a], self.after[b]
        start, stop = self.begin + r, self.end + over
        if self.first is None:
            return self.v.coded(self.v.trace(self._to(self.end, self.before[a]), start, stop)) if stop > start else []
        out = self.v.coded(self.v.trace(self._to(self.first, self.before[a]), start, self.first)) if start < self.first else []
        out += chain.from_iterable(map(memory.__getitem__, self.v.cut.findall(self.whole, self.first, self.last)))
        if self.last < stop:
            out += self.v.coded(self.v.trace(self.v.scan(self.text, self.last, self.end, self.last, None), self.last, stop))
        return out


def cuts(text: str, size: int, margin: int) -> list[tuple[str, str, str]]:
    """Chunks of a text, each with `margin` characters before and after it."""
    text = " " + text
    return [(text[max(0, k - margin) : k], text[k : k + size], text[k + size : k + size + margin]) for k in range(0, len(text), size)]


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in the max-plus algebra."""
    out = np.full((a.shape[0], b.shape[1]), -np.inf)
    for k in range(a.shape[1]):
        np.maximum(out, a[:, k, None] + b[None, k], out=out)
    return out


def encode_by_chunks(text: str, m: Memory, size: int) -> list[int]:
    """The ids of a text by the parallel scan, in one process."""
    chunks = [Chunk(m.vocabulary, *x) for x in cuts(text, size, m.vocabulary.longest)]
    at = states_on_path([x.transfer() for x in chunks])
    return [i for x, a, b in zip(chunks, at, at[1:]) for i in x.ids(a, b, m)]


def states_on_path(matrices: list[np.ndarray]) -> list[int]:
    """The state at every cut on the best path from the one state before to the best after.

    Products of neighbours form a tree; going down it, the state between two halves
    is the one that maximises the sum of both.
    """
    levels = [matrices]
    while len(levels[-1]) > 1:
        m = levels[-1]
        levels.append([max_plus(m[k], m[k + 1]) if k + 1 < len(m) else m[k] for k in range(0, len(m), 2)])
    at = [0, int(levels[-1][0][0].argmax())]
    for m in reversed(levels[:-1]):
        new = [at[0]]
        for k in range(0, len(m), 2):
            if k + 1 < len(m):
                new.append(int((m[k][new[-1]] + m[k + 1][:, at[k // 2 + 1]]).argmax()))
            new.append(at[k // 2 + 1])
        at = new
    return at


class Memory(dict):
    """Encodings of segments; when there are REMEMBER, those not met since the last time are forgotten."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, segment: str) -> tuple[int, ...]:
        ids = self.older.get(segment)
        if ids is None:
            ids = self.extended(segment)
            if ids is None:
                ids = tuple(self.vocabulary.encode_segment(segment))
        if len(segment) <= 64:
            if len(self) > REMEMBER:
                self.older = dict(self)
                self.clear()
            self[segment] = ids
        return ids

    def extended(self, segment: str) -> tuple[int, ...] | None:
        """A remembered segment's path and one more edge of weight 0, if there is such."""
        v = self.vocabulary
        new, old, known = self.get, self.older.get, v.known.get
        for n in range(1, min(TAIL, len(segment) - 2) + 1):
            tail = known(segment[-n:])
            if tail:
                ids = new(head := segment[:-n]) or old(head)
                if ids and (last := v.names.get(ids[-1])) is not None and v.edge(last, tail):
                    return (*ids, v.ids[tail])
        return None


_memory: dict[bytes, Memory] = {}


def memory(model: bytes) -> Memory:
    key = hashlib.sha256(model).digest()
    if key not in _memory:
        _memory[key] = Memory(Vocabulary(model))
    return _memory[key]


def encode(text: str, m: Memory) -> list[int]:
    return list(chain.from_iterable(map(m.__getitem__, m.vocabulary.cut.findall(" " + text)))) if text else []


def decode(ids, m: Memory) -> str:
    raw = b"".join(map(m.vocabulary.out.__getitem__, ids)).decode(errors="replace")
    return raw[1:] if raw[:1] == " " else raw


def _model(spark, path: str):
    """The file's bytes, read where the driver or Spark finds it, broadcast (a fixed vocabulary)."""
    try:
        with open(path, "rb") as f:
            raw = f.read()
    except OSError:
        raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return spark.sparkContext.broadcast(raw)


def _scanned(texts: DataFrame, shared, size: int) -> DataFrame:
    """key and ids of long texts (key, text) by the parallel scan over rows of chunks."""
    kind = texts.schema["key"].dataType.simpleString()

    def split(batches):
        margin = memory(shared.value).vocabulary.longest
        for b in batches:
            for key, text in zip(b["key"].to_pylist(), b["text"].to_pylist()):
                rows = cuts(text, size, margin)
                for k in range(0, len(rows), 256):  # 8 million characters at a time
                    part = rows[k : k + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part)), pa.array(range(k, k + len(part)), pa.int32()), *(pa.array(list(c), pa.string()) for c in zip(*part))], ["key", "k", "left", "mid", "right"])

    def matrices(batches):
        v = memory(shared.value).vocabulary
        for b in T.slices(batches, 64):
            got = [Chunk(v, *x).transfer() for x in zip(*(b[c].to_pylist() for c in ("left", "mid", "right")))]
            yield pa.RecordBatch.from_arrays([b["key"], b["k"], pa.array([x.shape[1] for x in got], pa.int32()), pa.array([np.packbits(x == 0).tobytes() for x in got], pa.binary())], ["key", "k", "ends", "allowed"])

    def path(key, t: pa.Table) -> pa.Table:
        t, starts, all_ = t.sort_by("k"), 1, []
        for ends, allowed in zip(t["ends"].to_pylist(), t["allowed"].to_pylist()):
            bits = np.unpackbits(np.frombuffer(allowed, np.uint8), count=starts * ends).reshape(starts, ends)
            all_.append(np.where(bits, 0.0, -np.inf))
            starts = ends
        at = states_on_path(all_)
        return pa.table({"key": t["key"], "k": t["k"], "a": pa.array(at[:-1], pa.int32()), "b": pa.array(at[1:], pa.int32())})

    def trace(batches):
        m = memory(shared.value)
        for b in T.slices(batches, 64):
            got = [np.array(Chunk(m.vocabulary, *x[:3]).ids(x[3], x[4], m), np.int32) for x in zip(*(b[c].to_pylist() for c in ("left", "mid", "right", "a", "b")))]
            yield pa.RecordBatch.from_arrays([b["key"], b["k"], _lists(got)], ["key", "k", "ids"])

    tasks = max(8, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = texts.mapInArrow(split, f"key {kind}, k int, left string, mid string, right string").repartition(tasks, "key", "k")
    states = rows.mapInArrow(matrices, f"key {kind}, k int, ends int, allowed binary").groupBy("key").applyInArrow(lambda key, t: path(key, t), f"key {kind}, k int, a int, b int")
    coded = rows.join(states, ["key", "k"]).mapInArrow(trace, f"key {kind}, k int, ids array<int>")
    return coded.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def _by_length(docs: DataFrame, shared, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows with texts of one chunk, and rows with longer ones, these with ids."""
    long = F.coalesce(F.length("text") > size, F.lit(False))
    # long texts are few but are read again; equal ones are scanned once
    rows = checkpointed(docs.where(long).select(F.struct("*").alias("row"), F.unhex(F.sha2("text", 256)).alias("key")))
    ids = _scanned(rows.groupBy("key").agg(F.min("row.text").alias("text")), shared, size)
    return docs.where(~long), rows.join(ids, "key").select("row.*", "ids")


def tokenize(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """Documents with ids array<int> added (an ids column already there is replaced)."""
    docs, shared = docs.drop("ids"), _model(docs.sparkSession, model)
    schema = S.StructType([*docs.schema, S.StructField("ids", S.ArrayType(S.IntegerType()))])

    def run(batches):
        m = memory(shared.value)
        gc.freeze()  # millions of remembered ids hold no cycles
        for b in T.slices(batches):
            got = [np.array(encode(t, m), np.int32) for t in T.strings(b["text"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(got)], [*b.schema.names, "ids"])

    short, long = _by_length(docs, shared, chunk)
    return short.mapInArrow(run, schema).unionByName(long)


def _lists(got: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(got) + 1, np.int32)
    np.cumsum([len(x) for x in got], out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, np.int32), *got])))


def detokenize(coded: DataFrame, model: str = MODEL, into: str = "decoded") -> DataFrame:
    """Rows with ids, and their text as a column; null ids decode to the empty text."""
    coded, shared = coded.drop(into), _model(coded.sparkSession, model)
    schema = S.StructType([*coded.schema, S.StructField(into, S.StringType())])

    def run(batches):
        m = memory(shared.value)
        for b in T.slices(batches):
            k = b.schema.get_field_index("ids")
            ids, off = b.column(k).flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum([len(x) if x.is_valid else 0 for x in b.column(k)])).astype(int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([decode(ids[i:j].tolist(), m) for i, j in zip(off, off[1:])], pa.string())], [*b.schema.names, into])

    return coded.mapInArrow(run, schema)


def encode_decode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_sha256 (little-endian int32), decoded_sha256, round_trip."""
    docs, shared = docs.select("doc_id", "text"), _model(docs.sparkSession, model)
    schema = "doc_id long, n_chars long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"

    def run(batches):
        m = memory(shared.value)
        gc.freeze()
        for b in T.slices(batches):
            rows, known = [], b.schema.get_field_index("ids")
            for k, t in enumerate(T.strings(b["text"]).to_pylist()):
                ids = encode(t, m) if known < 0 else b.column(known)[k].values.to_pylist()
                back = decode(ids, m)
                rows.append((len(t), len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == t))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(list(c), k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds))], ["doc_id", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    short, long = _by_length(docs, shared, chunk)
    return short.mapInArrow(run, schema).unionByName(long.mapInArrow(run, schema))
