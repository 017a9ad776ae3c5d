"""Benchmark decontamination by q-gram lemma filtering.

A region within e edits of a passage of m bytes shares at least m - Q + 1 - Q e of
its Q-grams, all within e diagonals of each other. Documents are scanned once for
Q-grams of the benchmark; hits are counted per passage in diagonal bands of width
2 e at every multiple of e (so some band holds all of them); bands that reach the
bound are verified by an alignment confined to the band, passages against regions,
whole batches at a time.

Texts are compared in lower case (A-Z) with runs of white space as one space; m, e
and distances count bytes of that form. e is RATE of m, or less for short passages
where the bound would fall below 1. Passages of fewer than Q bytes share no Q-gram and
are found by their own bytes, without edits, where no letter, digit or other byte of a
word touches them; empty and null passages match nothing. Overlapping matches of one
passage count once, the closest first. Passages are broadcast in blocks of at most BLOCK
bytes, a scan per block, so a benchmark of any size is served with bounded memory.

A Q-gram that recurs gives a hit per place in the document and place in the passage. Hits
are made SLICE at a time and go into counters of bands; where one Q-gram alone would make
more in a document, its hits per diagonal come from a convolution of its places. So
memory stays bounded for texts that repeat one character a million times.

Null texts have no matches; repeated rows of documents are reported alike; a null
doc_id is reported as null; repeated passages count once; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

Q, RATE, BLOCK = 12, 0.06, 4 << 20
CELLS, SLICE, MANY = 1 << 20, 1 << 21, 64
SCHEMA = "doc_id long, item_id long, start long, end long, distance int, shared int, needed int, passage_bytes int"


def normal(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised buffer, its offsets, and where each of its bytes stood."""
    space = T.SPACE[buf]
    out = np.where(space, np.uint8(32), T.LOWER[buf])
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    keep = np.ones(len(buf), bool)
    keep[1:] = ~(space[1:] & space[:-1]) | first[1 : len(buf)]
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return out[keep], total[off], np.flatnonzero(keep)


def qgrams(buf: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes at each place, from an 8-byte and a 4-byte load."""
    n = len(buf) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(buf)
    a = np.ndarray((n,), "<u8", raw, strides=(1,))
    b = np.ndarray((n,), "<u4", raw, offset=8, strides=(1,))
    return a * np.uint64(T._BASE) ^ T.mix(b.astype(np.uint64))


class Index:
    """Q-grams of a block of passages: sorted hashes and postings, and a bit table before them; short passages by length."""

    def __init__(self, items: list[tuple[int, str]]):
        got = [(k, normal(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]) for k, t in items if t]
        got = [(k, p[int(p[0] == 32) : len(p) - int(p[-1] == 32)]) for k, p in got]
        got = [(k, p) for k, p in got if len(p)]
        self.ids = np.array([k for k, _ in got], np.int64)
        self.text = [p for _, p in got]
        self.m = np.array([len(p) for p in self.text], np.int64)
        self.e = np.maximum(0, np.minimum((self.m * RATE).astype(np.int64), (self.m - Q) // Q))
        self.need = np.maximum(0, self.m - Q + 1 - Q * self.e)
        grams = [qgrams(p) for p in self.text]
        h = np.concatenate([np.zeros(0, np.uint64), *grams])
        o = np.argsort(h, kind="stable")
        self.item = np.repeat(np.arange(len(got)), [len(g) for g in grams]).astype(np.int64)[o]
        self.pos = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)]).astype(np.int64)[o]
        self.keys, self.first = np.unique(h[o], return_index=True)
        self.last = np.append(self.first[1:], len(h))
        self.shift = np.uint64(64 - 22)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[T.mix(self.keys) >> self.shift] = True
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for k in np.flatnonzero(self.m < Q).tolist():
            self.short.setdefault(int(self.m[k]), {}).setdefault(self.text[k].tobytes(), []).append(k)

    def places(self, buf: np.ndarray, off: np.ndarray):
        """(row, place in buf, number of the Q-gram) where a Q-gram of a passage stands, by row."""
        h = qgrams(buf)
        if not len(h) or not len(self.keys):
            return (np.zeros(0, np.int64),) * 3
        at = np.flatnonzero(self.bits[T.mix(h) >> self.shift])
        row = np.searchsorted(off, at, side="right") - 1
        good = at + Q <= off[row + 1]
        at, row = at[good], row[good]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        good = self.keys[k] == h[at]
        return row[good], at[good], k[good]

    def _banded(self, row, item, diagonal, hits):
        """Distinct (row, item, band) and their hits; a diagonal (made positive) lies in two bands, or in one if no edits are allowed."""
        step = np.maximum(1, self.e[item])
        also = self.e[item] > 0
        band = diagonal // step
        row, item, band, hits = (np.concatenate(x) for x in ((row, row[also]), (item, item[also]), (band, band[also] - 1), (hits, hits[also])))
        return _added(row, item, band, hits)

    def bands(self, buf: np.ndarray, off: np.ndarray):
        """(row, item, first diagonal within the row, hits) of bands that reach the bound."""
        row, at, k = self.places(buf, off)
        none = (np.zeros(0, np.int64),) * 4
        if not len(row):
            return none
        found, n = none, self.last[k] - self.first[k]
        # one Q-gram in one row, when it recurs in both: its hits by diagonal are a convolution
        o = np.lexsort((k, row))
        new = np.flatnonzero(np.append(True, (row[o][1:] != row[o][:-1]) | (k[o][1:] != k[o][:-1])))
        size = np.diff(np.append(new, len(o)))
        heavy = np.flatnonzero(size * n[o[new]] > SLICE)
        light = np.ones(len(row), bool)
        for g in heavy.tolist():
            mine = o[new[g] : new[g] + size[g]]
            light[mine] = False
            r, post = int(row[mine[0]]), slice(self.first[k[mine[0]]], self.last[k[mine[0]]])
            for i in np.unique(self.item[post]).tolist():
                pos, every = self.pos[post][self.item[post] == i], np.sort(at[mine]) - off[r]
                m, step = int(self.m[i]), max(1, int(self.e[i]))
                for there in np.split(every, np.searchsorted(every, np.arange(SLICE, int(every[-1]) + 1, SLICE))):
                    if len(there):
                        low = int(there[0])  # counts[x]: hits on diagonal low + x - (m - 1)
                        counts = _correlate(there - low, m - 1 - pos)
                        x = np.flatnonzero(counts)
                        found = _added(*map(np.concatenate, zip(found, self._banded(np.full(len(x), r), np.full(len(x), i), low + x + 1 + step, counts[x]))))
        row, at, k, n = row[light], at[light], k[light], n[light]
        total = np.cumsum(n)
        for a in range(0, int(total[-1]) if len(total) else 0, SLICE):
            part = slice(np.searchsorted(total, a, side="right"), np.searchsorted(total, a + SLICE, side="right"))
            if part.stop > part.start:
                m = n[part]
                post = np.repeat(self.first[k[part]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                r, item, diagonal = np.repeat(row[part], m), self.item[post], np.repeat(at[part] - off[row[part]], m) - self.pos[post]
                diagonal += self.m[item] + np.maximum(1, self.e[item])
                found = _added(*map(np.concatenate, zip(found, self._banded(r, item, diagonal, np.ones(len(r), np.int64)))))
        row, item, band, hits = (x[found[3] >= self.need[found[1]]] for x in found)
        step = np.maximum(1, self.e[item])
        return row, item, band * step - self.m[item] - step, hits

    def verbatim(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, start, end) within rows of the short passages that stand alone in a text."""
        out = []
        ink = _INK[buf] if self.short else buf
        for m, texts in self.short.items():
            n = len(buf) - m + 1
            if n <= 0:
                continue
            windows = np.ndarray((n,), f"V{m}", np.ascontiguousarray(buf), strides=(1,))
            first = np.zeros(256, bool)
            first[[t[0] for t in texts]] = True
            at = np.flatnonzero(first[buf[:n]])
            row = np.searchsorted(off, at, side="right") - 1
            begin, end = at == off[row], at + m == off[row + 1]
            good = (at + m <= off[row + 1]) & (begin | ~(ink[np.maximum(at - 1, 0)] & ink[at])) & (end | ~(ink[np.minimum(at + m, len(buf) - 1)] & ink[np.minimum(at + m, len(buf)) - 1]))
            for a, r in zip(at[good].tolist(), row[good].tolist()):
                out += [(r, i, a - int(off[r]), a - int(off[r]) + m) for i in texts.get(windows[a].tobytes(), ())]
        return out


# bytes of words: letters, digits, _ and all of other alphabets
_INK = np.zeros(256, bool)
_INK[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def _added(row, item, band, hits):
    """Distinct (row, item, band) in order, with their hits added."""
    if not len(row):
        return row, item, band, hits
    o = np.lexsort((band, item, row))
    row, item, band = row[o], item[o], band[o]
    at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])))
    return row[at], item[at], band[at], np.add.reduceat(hits[o], at)


def _correlate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How often each sum a + b occurs, by Fourier transform; exact, as counts stay far below 2 ** 50."""
    size = 1 << int(a.max() + b.max() + 1).bit_length()
    x, y = np.zeros(size), np.zeros(size)
    x[a], y[b] = 1, 1
    return np.rint(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), size)).astype(np.int64)


def align(passages: list[np.ndarray], texts: list[np.ndarray], first: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of each passage against its text within diagonals first .. first + width - 1, with start and end.

    One dynamic programme for all: rows are passage bytes, columns diagonals. A
    cell is (edits << 24) + column of the start, so the least cell also tells where
    its alignment began.
    """
    c, rows, w = len(passages), max(map(len, passages)), int(widths.max())
    pat = np.full((c, rows), 300, np.int16)
    area = np.full((c, rows + w), 301, np.int16)
    for k, (p, t, f) in enumerate(zip(passages, texts, first)):
        pat[k, : len(p)] = p
        lo, hi = max(0, -f), min(rows + w, len(t) - f)
        if hi > lo:
            area[k, lo:hi] = t[f + lo : f + hi]
    one, far = np.int64(1 << 24), np.int64(1 << 60)
    col = np.arange(w, dtype=np.int64)
    d = np.where(col < widths[:, None], col, far)
    done = np.zeros((c, w), np.int64)
    size = np.array([len(p) for p in passages])
    for i in range(rows):
        down = np.full_like(d, far)
        down[:, :-1] = d[:, 1:] + one
        new = np.minimum(d + one * (area[:, i : i + w] != pat[:, i : i + 1]), down)
        new = np.where(col < widths[:, None], new, far)
        d = np.minimum.accumulate(new - one * col, axis=1) + one * col
        d = np.where(col < widths[:, None], d, far)
        last = size == i + 1
        done[last] = d[last]
    best = done.argmin(axis=1)
    cell = done[np.arange(c), best]
    return (cell >> np.int64(24)).astype(int), first + (cell & np.int64((1 << 24) - 1)), first + best + size


def _runs(order: np.ndarray, m: np.ndarray, e: np.ndarray):
    """Parts of order, by ascending m, whose alignments share about CELLS cells: long passages go few at a time."""
    begin = 0
    for k in range(len(order)):
        last = order[k]
        if k > begin and (k - begin + 1) * (m[last] + 2 * e[last]) > CELLS:
            yield order[begin:k]
            begin = k
    if len(order):
        yield order[begin:]


def _settled(index: Index, buf: np.ndarray, at: np.ndarray, row, item, diag, count):
    """For passages with MANY bands in a row: matches without edits, and the bands that are still to be verified.

    Such matches come first whatever the others are, so a band need not be verified if all that it
    can find overlaps one of them. Nor need one whose region lacks more of the passage's bytes,
    each counted as often as it is there, than edits are allowed.
    """
    found, keep = [], np.ones(len(row), bool)
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))) if len(row) else np.zeros(0, np.int64)
    for a, b in zip(new, np.append(new[1:], len(row))):
        if b - a > MANY:
            r, i = int(row[a]), int(item[a])
            text, p, m, e = buf[at[r] : at[r + 1]].tobytes(), index.text[i].tobytes(), int(index.m[i]), int(index.e[i])
            begin, end = (np.clip(x, 0, len(text)) for x in (diag[a:b], diag[a:b] + 2 * e + m))
            missing = np.zeros(b - a, np.int64)
            for byte, n in zip(*np.unique(index.text[i], return_counts=True)):
                sums = np.append(0, np.cumsum(buf[at[r] : at[r + 1]] == byte))
                missing += np.maximum(0, n - (sums[end] - sums[begin]))
            keep[a:b] = missing <= e
            starts, s = [], text.find(p)
            while s >= 0:
                starts.append(s)
                s = text.find(p, s + m)
            found += [(r, i, s, s + m) for s in starts]
            if starts:
                # the exact match that begins last before the end of what the band can find
                lo, hi = diag[a:b], diag[a:b] + 2 * e
                k = np.searchsorted(starts, lo + m - e) - 1
                s = np.array(starts)[np.maximum(k, 0)]
                keep[a:b] &= (k < 0) | (hi >= s + m)
    return found, keep


def _matches(index: Index, texts):
    """(row, item, start, end, distance, shared) of an Arrow column's texts, by row and start; places in code points."""
    for lo, raw, off in T.pieces(texts):
        buf, at, place = normal(raw, off)
        row, item, diag, count = index.bands(buf, at)
        found: dict = {}
        settled, keep = _settled(index, buf, at, row, item, diag, count)
        row, item, diag, count = row[keep], item[keep], diag[keep], count[keep]
        for r, i, s, e in settled:
            found.setdefault((r, i), []).append((0, s, e, int(index.m[i]) - Q + 1))
        for r, i, s, e in index.verbatim(buf, at):
            found.setdefault((r, i), []).append((0, s, e, 0))
        order = np.argsort(index.m[item], kind="stable")
        for o in _runs(order, index.m[item], index.e[item]):
            parts = [buf[at[r] : at[r + 1]] for r in row[o]]
            dist, start, end = align([index.text[i] for i in item[o]], parts, diag[o], np.maximum(1, 2 * index.e[item[o]] + 1))
            for j, d, s, e in zip(o, dist, start, end):
                if d <= index.e[item[j]]:
                    found.setdefault((int(row[j]), int(item[j])), []).append((int(d), max(0, int(s)), int(e), int(count[j])))
        for (r, i), list_ in sorted(found.items()):
            taken: list = []  # by start; they don't overlap
            for d, s, e, n in sorted(list_):
                e = min(e, int(at[r + 1] - at[r]))
                k = bisect.bisect_left(taken, s, key=lambda x: x[1])
                if (k == 0 or taken[k - 1][2] <= s) and (k == len(taken) or e <= taken[k][1]):
                    taken.insert(k, (d, s, e, n))
            whole, spot = raw[off[r] : off[r + 1]], place[at[r] : at[r + 1]] - off[r]
            # code points: bytes that don't continue one
            points = np.append(0, np.cumsum((whole & 0xC0) != 0x80))
            for d, s, e, n in taken:
                yield lo + r, i, int(points[spot[s]]), int(points[spot[e - 1] + 1]), d, n


def _scan(index: Index, batches):
    for b in batches:
        out = [(b["doc_id"][r].as_py(), int(index.ids[i]), s, e, d, n, int(index.need[i]), int(index.m[i])) for r, i, s, e, d, n in _matches(index, b["text"])]
        kinds = [pa.int64()] * 4 + [pa.int32()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*out)) or [[]] * 8, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])


def _clean(index: Index, batches):
    for b in batches:
        keep = np.ones(len(b), bool)
        keep[[x[0] for x in _matches(index, b["text"])]] = False
        yield b.filter(pa.array(keep))


def _indexes(benchmark: DataFrame, block: int) -> list:
    """A broadcast index of each block of about `block` bytes of passages."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = max(1, -(-total // block)), []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()  # about block bytes
        out.append(benchmark.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in rows])))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per match: doc_id, item_id, start, end (code points of the text), distance, shared, needed, passage_bytes.

    shared and needed count Q-grams; both are 0 for passages that are too short to have any.
    """
    docs = docs.select("doc_id", "text")
    return functools.reduce(DataFrame.unionByName, [docs.mapInArrow(lambda it, x=x: _scan(x.value, it), SCHEMA) for x in _indexes(benchmark, block)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows whose text holds no match, each judged by itself whatever its doc_id; rows and columns stay as they are."""
    for x in _indexes(benchmark, block):
        docs = docs.mapInArrow(lambda it, x=x: _clean(x.value, it), docs.schema)
    return docs
