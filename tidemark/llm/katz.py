"""Language-model scoring: a Katz backoff bigram model with Good-Turing discounts.

P(w | h) = d(c(h, w)) c(h, w) / c(h) if the pair was seen, else alpha(h) P(w), and
P(w) = d(c(w)) c(w) / N, or what the discounts leave for one unknown word. d(r) is
Katz's discount for r up to 5, else 1, and at most 1 - FLOOR / r, so each history
leaves mass to back off to. alpha(h) makes the probabilities of all words, the
unknown one included, sum to 1 exactly, for every history.

The counts are tables dealt to owners, built and asked chunk by chunk (about 8 MB of
documents each, see spark.chunked):

1. a chunk sends its distinct words, as they are spelt, with their training counts;
   a word's owner tells every chunk that has it the total, and the word's number;
2. a chunk sends its distinct pairs as two numbers each, with their counts and the
   word's total; a pair's owner tells the totals to the chunks that have it, and
   sums up, by history, the classes of its pairs' counts and their words' P;
3. those sums, added by history, give alpha, which a word's owner returns to the
   chunks that have the word as a history;
4. a chunk scores its documents by the totals and alphas it was told.

Identity is exact: words by their bytes, pairs by their words' numbers; hashes only
deal. A chunk sends a word or pair once however often it has it, and the pairs of a
history are dealt over owners in proportion to its count, so nothing frequent is a hot
key; one row per history and owner at most is added up for alpha.

Tokens are runs of bytes other than white space, A-Z in lower case, and an end per
document; the first token's history is a start symbol. Null texts count as empty
(one end token); a null doc_id is scored, and counts as the empty text for the
split; repeated rows count and score each. Without training rows every token is
unknown with probability 1. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .spark import chunked, held_out
from .substring import _ddl, _table

CLASSES, FLOOR, SPREAD = 5, 0.1, 4
END, START = b" ", -1
WORD, PAIR, ALPHA = 0, 1, 2
TOP = CLASSES + 1  # counts up to here are told apart
SENT = pa.schema([("part", pa.int32()), ("src", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("counts", pa.binary()), ("of", pa.binary())])
TOLD = pa.schema([("part", pa.int32()), ("src", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
COUNTED = pa.schema([("numbers", pa.list_(pa.int64()))])
MASS = pa.schema([("h", pa.int64()), *((f"t{r}", pa.int64()) for r in range(1, TOP + 2)), ("more", pa.int64()), ("lower", pa.float64())])
SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def discounts(counts: np.ndarray) -> np.ndarray:
    """d(0) .. d(CLASSES) from the numbers of types seen 1 .. CLASSES + 1 times."""
    d = np.ones(CLASSES + 1)
    n = np.append(0, counts).astype(float)
    lost = (CLASSES + 1) * n[CLASSES + 1] / n[1] if n[1] else 1.0
    for r in range(1, CLASSES + 1):
        ok = n[r] and n[r + 1] and lost < 1
        x = ((r + 1) * n[r + 1] / n[r] / r - lost) / (1 - lost) if ok else 0
        d[r] = min(x, 1 - FLOOR / r) if 0 < x else r / (r + 0.5)
    return d


def discounted(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(r) r of counts."""
    r = np.asarray(r, float)
    return np.where(r > CLASSES, r - FLOOR, d[np.minimum(r, CLASSES).astype(int)] * r)


def unigrams(stats: np.ndarray) -> tuple[np.ndarray, float]:
    """Discounts of words, and the unknown word's probability; stats are N, V and the numbers of words by count."""
    n, v, ones = stats[0], stats[1], stats[2 : 2 + TOP]
    d = discounts(ones)
    if not n:
        return d, 1.0
    small = np.arange(1, CLASSES + 1)
    seen = float((d[1:] * small * ones[:CLASSES]).sum()) + float(n - (small * ones[:CLASSES]).sum()) - FLOOR * float(v - ones[:CLASSES].sum())
    return d, max(1e-12, 1 - seen / n)


class Tokens:
    """A chunk's tokens: numbers of distinct words (the end is the last), rows, and where documents begin."""

    def __init__(self, docs: pa.Table):
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.rows, self.ids = len(docs), docs["doc_id"].to_pylist()
        self.held = docs["held_out"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool) if len(docs) else np.zeros(0, bool)
        off, buf = T.layout(T.strings(docs["text"]).cast(pa.large_binary()))
        buf = T.LOWER[buf]
        st, en, row = T.words(buf, off)
        number, words = T.dictionary(buf, st, en)
        self.words = pa.concat_arrays([words, pa.array([END], pa.large_binary())])
        n = len(off) - 1
        self.last = np.searchsorted(row, np.arange(1, n + 1)) + np.arange(n)  # an end after each row's words
        self.tok, self.row = np.empty(len(st) + n, np.int64), np.empty(len(st) + n, np.int32)
        spot = np.arange(len(st)) + row
        self.tok[spot], self.tok[self.last] = number, len(words)
        self.row[spot], self.row[self.last] = row, np.arange(n)
        self.begin = np.zeros(len(self.tok), bool)
        self.begin[np.append(0, self.last[:-1] + 1) if n else []] = True
        self.learn = ~self.held[self.row]

    def dealt(self, owners: int) -> tuple[np.ndarray, np.ndarray]:
        """Words in order of their owners, and where each owner's begin; the end is the last owner's, in every chunk."""
        off, data = T.layout(self.words)
        part = (T.span_hashes(data, off[:-1], off[1:]) % np.uint64(owners)).astype(np.int64)
        part[-1] = owners - 1
        order = np.argsort(part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(owners + 1))

    def told(self, rows: pa.Table, owners: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and totals of the words, as their owners told."""
        order, _ = self.dealt(owners)
        out = []
        for col in "ab":
            x = np.empty(len(order), np.int64)
            x[order] = np.concatenate([T.unpack(v, np.int64) for v in rows[col].to_pylist()])
            out.append(x)
        return tuple(out)  # type: ignore[return-value]


class Pairs:
    """A chunk's distinct pairs by owner: numbers of history and word, and each token's pair."""

    def __init__(self, t: Tokens, number: np.ndarray, total: np.ndarray, n: int, starts: int, owners: int):
        order = np.argsort(number)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)  # 0 is the start symbol
        number, total = np.append(START, number[order]), np.append(starts, total[order])
        w = rank[t.tok]
        h = np.empty_like(w)
        h[1:] = w[:-1]
        h[t.begin] = 0
        keys, which = np.unique(h * len(number) + w, return_inverse=True)
        h, w = keys // len(number), keys % len(number)
        spread = 1 + SPREAD * owners * total[h] // max(1, n)  # a history with a share of all tokens has that share of owners
        part = (T.mix((number[h] * 31 + number[w] % spread).astype(np.uint64)) % np.uint64(owners)).astype(np.int32)
        o = np.argsort(part, kind="stable")
        self.cut = np.searchsorted(part[o], np.arange(owners + 1))
        back = np.empty(len(o), np.int64)
        back[o] = np.arange(len(o))
        self.which = back[which]
        self.h, self.w, self.of = number[h[o]], number[w[o]], total[w[o]]


def _send_words(key, docs: pa.Table, owners: int) -> pa.Table:
    t = Tokens(docs)
    order, cut = t.dealt(owners)
    counts = np.bincount(t.tok[t.learn], minlength=len(t.words))
    out = [(p, key[0].as_py(), *T.pack_words(t.words.take(pa.array(order[i:j]))), T.pack(counts[order[i:j]]), b"") for p, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
    return _table(SENT, out)


def _merge_words(sent: pa.Table) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """Senders, each one's words as numbers from 0, and totals by number."""
    sent = sent.sort_by("src")
    words = [T.unpack_words(a, b) for a, b in zip(sent["a"].to_pylist(), sent["b"].to_pylist())]
    number = pa.concat_arrays(words).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    total = np.bincount(number, np.concatenate([T.unpack(x, np.int64) for x in sent["counts"].to_pylist()])).astype(np.int64)  # exact below 2 ** 53
    return sent["src"].to_pylist(), np.split(number, np.cumsum([len(x) for x in words])[:-1]), total


def _tell_words(key, sent: pa.Table, owners: int) -> pa.Table:
    src, numbers, total = _merge_words(sent)
    part = key[0].as_py()
    out = [(part, s, WORD, T.pack(x.astype(np.int64) * owners + part), T.pack(total[x])) for s, x in zip(src, numbers)]
    return _table(TOLD, out)


def _count_words(key, sent: pa.Table) -> pa.Table:
    total = _merge_words(sent)[2]
    some = total[total > 0]
    return _table(COUNTED, [([int(some.sum()), len(some), *np.bincount(some[some <= TOP], minlength=TOP + 1)[1:].tolist()],)])


def _stats(rows: pa.Table) -> tuple[np.ndarray, int]:
    """Numbers of words (see unigrams), and of training documents."""
    x = np.array(rows["stats"][0].as_py(), np.int64)
    return x[:-1], int(x[-1])


def _send_pairs(key, docs: pa.Table, told: pa.Table, owners: int) -> pa.Table:
    if not len(docs):
        return _table(SENT, [])
    told = told.sort_by("part")
    stats, starts = _stats(told)
    t = Tokens(docs)
    p = Pairs(t, *t.told(told, owners), int(stats[0]), starts, owners)
    counts = np.bincount(p.which[t.learn], minlength=len(p.h))
    out = [(k, key[0].as_py(), T.pack(np.diff(p.h[i:j], prepend=0)), T.pack(p.w[i:j]), T.pack(counts[i:j]), T.pack(p.of[i:j])) for k, (i, j) in enumerate(zip(p.cut, p.cut[1:])) if j > i]
    return _table(SENT, out)


def _merge_pairs(sent: pa.Table, more: bool):
    """Senders' sizes, the order of all their pairs, where each distinct pair begins in it, and its total; with more also history and word's total."""
    h = np.concatenate([np.cumsum(T.unpack(x, np.int64)) for x in sent["a"].to_pylist()] or [np.zeros(0, np.int64)])
    w = [T.unpack(x, np.int64) for x in sent["b"].to_pylist()]
    sizes, w = [len(x) for x in w], np.concatenate(w)
    base = int(w.max()) + 1
    o = np.argsort((h + 1) * base + w) if (int(h.max()) + 2) * base < 1 << 63 else np.lexsort((w, h))
    hs, ws = h[o], w[o]
    at = np.flatnonzero(np.append(True, (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])))
    total = np.add.reduceat(np.concatenate([T.unpack(x, np.int64) for x in sent["counts"].to_pylist()])[o], at)
    of = np.concatenate([T.unpack(x, np.int64) for x in sent["of"].to_pylist()])[o[at]] if more else None
    return sizes, o, at, total, hs[at] if more else None, of


def _tell_pairs(key, sent: pa.Table) -> pa.Table:
    sent = sent.sort_by("src")
    sizes, o, at, total, *_ = _merge_pairs(sent, False)
    whole = np.empty(len(o), np.int64)
    whole[o] = np.repeat(total, np.diff(np.append(at, len(o))))
    out = [(key[0].as_py(), s, PAIR, T.pack(x), b"") for s, x in zip(sent["src"].to_pylist(), np.split(whole, np.cumsum(sizes)[:-1]))]
    return _table(TOLD, out)


def _masses(key, sent: pa.Table) -> pa.Table:
    """By history: pairs seen 1 .. TOP times and more often, what the latter sum to, and P of all pairs' words."""
    stats, _ = _stats(sent)
    *_, total, h, of = _merge_pairs(sent, True)
    h, of, r = h[total > 0], of[total > 0], total[total > 0]
    if not len(h):
        return _table(MASS, [])
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    kinds = [np.add.reduceat((r == k).astype(np.int64), at) for k in range(1, TOP + 1)]
    kinds += [np.add.reduceat(x, at) for x in ((r > TOP).astype(np.int64), np.where(r > TOP, r, 0))]
    lower = np.add.reduceat(discounted(of, unigrams(stats)[0]) / max(1, stats[0]), at)
    return pa.table([pa.array(x) for x in (h[at], *kinds, lower)], schema=MASS)


def alpha(kinds: np.ndarray, lower: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Backoff weights of histories: a row of t1 .. , more for each (see _masses), and its words' P."""
    r = np.append(np.arange(1, TOP + 1), 0)
    c = kinds[:, :-1] @ r + kinds[:, -1]
    kept = kinds[:, : TOP + 1] @ np.append(discounted(np.arange(1, TOP + 1), d), -FLOOR) + kinds[:, -1]
    return (1 - kept / np.maximum(1, c)) / np.maximum(1e-12, 1 - lower)


def _tell_alphas(key, sent: pa.Table, mass: pa.Table, owners: int) -> pa.Table:
    """log10 alpha of each word sent (0 if it is no history), and by the last owner of the start symbol."""
    if not len(sent):
        return _table(TOLD, [])
    src, numbers, total = _merge_words(sent)
    part, logs, first = key[0].as_py(), np.zeros(len(total)), []
    if len(mass):
        d = discounts(np.array(mass["pairs"][0].as_py(), np.int64))
        h = mass["h"].to_numpy()
        got = np.log10(alpha(np.stack([mass[c].to_numpy() for c in MASS.names[1:-1]], axis=1).astype(float), mass["lower"].to_numpy(), d))
        logs[h[h != START] // owners] = got[h != START]
        first = got[h == START].tolist()
    out = [(part, s, ALPHA, T.pack(logs[x]), np.array(first).tobytes()) for s, x in zip(src, numbers)]
    return _table(TOLD, out)


def _score(key, docs: pa.Table, told: pa.Table, owners: int) -> pa.Table:
    if not len(docs):
        return _table(SCORE, [])
    told = told.sort_by("part")
    stats, starts = _stats(told)
    n, v = int(stats[0]), int(stats[1])
    d1, unknown = unigrams(stats)
    d2 = discounts(np.array(told["pairs"][0].as_py(), np.int64))
    words, pairs, alphas = (told.filter(pa.compute.equal(told["kind"], k)) for k in (WORD, PAIR, ALPHA))
    t = Tokens(docs)
    number, total = t.told(words, owners)
    p = Pairs(t, number, total, n, starts, owners)
    r = np.concatenate([T.unpack(x, np.int64) for x in pairs["a"].to_pylist()])[p.which]
    order, _ = t.dealt(owners)
    logs = np.empty(len(order))
    logs[order] = np.concatenate([T.unpack(x, np.float64) for x in alphas["a"].to_pylist()])
    first = np.frombuffer(alphas["b"][-1].as_py() or b"", np.float64)
    c, back = total[t.tok], logs[t.tok]
    before, weight = np.empty_like(c), np.empty_like(back)
    before[1:], weight[1:] = c[:-1], back[:-1]
    before[t.begin], weight[t.begin] = starts, first[0] if len(first) else 0
    p1 = np.where(c > 0, discounted(c, d1) / max(1, n), unknown)
    with np.errstate(divide="ignore"):
        score = np.where(r > 0, np.log10(discounted(r, d2) / np.maximum(before, 1)), np.log10(p1) + np.where(before > 0, weight, 0))
        base = np.log10((c + 1) / (n + (v + 1)))
    base_score, score, known = (np.bincount(t.row, x, t.rows) for x in (base, score, c > 0))
    cols = (t.ids, t.held, np.bincount(t.row, minlength=t.rows), known.astype(np.int64), np.full(t.rows, n), base_score, score)
    return pa.table([pa.array(x, f.type) for x, f in zip(cols, SCORE)], schema=SCORE)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, for every document."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(7, 2).alias("held_out"))
    c = chunked(docs, "held_out")
    n = c.owners
    words = c.owned(c.docs.groupBy("chunk").applyInArrow(lambda k, t: T.freed(_send_words, k, t, n), _ddl(SENT)))
    counted = words.groupBy("part").applyInArrow(lambda k, t: T.freed(_count_words, k, t), _ddl(COUNTED))
    starts = c.docs.where("not held_out").agg(F.count("*").alias("n")).scalar()
    total = lambda k: F.coalesce(F.sum(F.col("numbers")[k]), F.lit(0))
    stats = counted.agg(F.array(*[total(k) for k in range(2 + TOP)]).alias("x")).select(F.array_append("x", starts).alias("x")).scalar()
    told = words.groupBy("part").applyInArrow(lambda k, t: T.freed(_tell_words, k, t, n), _ddl(TOLD)).withColumnRenamed("src", "chunk")
    pairs = c.owned(c.with_docs(c.home(told.withColumn("stats", stats)), lambda k, a, b: T.freed(_send_pairs, k, a, b, n), _ddl(SENT)))
    mass = pairs.withColumn("stats", stats).groupBy("part").applyInArrow(lambda k, t: T.freed(_masses, k, t), _ddl(MASS)).groupBy("h").agg(*[F.sum(x).alias(x) for x in MASS.names[1:]])
    classes = mass.agg(F.array(*[F.coalesce(F.sum(f"t{r}"), F.lit(0)) for r in range(1, TOP + 1)]).alias("x")).scalar()
    dealt = mass.withColumns({"part": F.pmod("h", F.lit(n)).cast("int"), "pairs": classes})
    alphas = words.groupBy("part").cogroup(c.owned(dealt).groupBy("part")).applyInArrow(lambda k, a, b: T.freed(_tell_alphas, k, a, b, n), _ddl(TOLD))
    more = pairs.groupBy("part").applyInArrow(lambda k, t: T.freed(_tell_pairs, k, t), _ddl(TOLD)).unionByName(alphas).withColumnRenamed("src", "chunk")
    every = told.unionByName(more).withColumns({"stats": stats, "pairs": classes})
    return c.with_docs(c.home(every), lambda k, a, b: T.freed(_score, k, a, b, n), _ddl(SCORE))
