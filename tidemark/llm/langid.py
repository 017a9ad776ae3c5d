"""Language identification: language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: every slot holds a bitmask of
languages, so k gathers and an AND return all languages that contain an n-gram.
A document counts, per language, its n-grams whose mask has that bit; the count
is corrected for the filter's false positives, (c - n f) / (1 - f) with f the
fill to the power k, and the largest corrected count decides.

Filters hold the n-grams of at most SAMPLE documents per language (the smallest
hashes of doc_id) that occur in SHARE of them and in two at least (a language with one
document keeps all of its own), and in NEAR of the share that the n-gram has in any
other language of two documents or more. A text that no learned n-gram matches, say of
one or two bytes, goes by its pairs of neighbouring bytes, a blank before and after it,
and the languages' numbers of documents: its score is the posterior of naive Bayes.
Results are `und` with score 0 for a null text or a text without a letter only; ties go
to the first language in code point order. Null langs
aren't learned; without training rows all is `und`. Extra columns are ignored;
repeated rows give repeated results. Samples count distinct ids, so a repeated id is no
hot key; rows with a null doc_id are predicted but not learned.

score compares the learned languages with each other only, and so says nothing of a
text in none of them; `known` does: the share of all the text's n-grams that the
predicted language's filter holds (0 for `und` and where pairs decide), of the number
`grams`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import text as T
from .spark import held_out

GRAMS, SLOTS, PROBES, SAMPLE, SHARE, NEAR = (3, 4), 1 << 20, 3, 400, 0.02, 0.5


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    got = [T.byte_ngrams(T.LOWER[buf], off, n) for n in GRAMS]
    return np.concatenate([h for h, _ in got]), np.concatenate([r for _, r in got])


def pairs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring bytes as numbers, white space and both ends of a row as a blank, and their rows."""
    b = np.insert(np.where(T.SPACE[buf], np.uint8(32), T.LOWER[buf]), off, 32).astype(np.int64)
    return b[:-1] << 8 | b[1:], np.repeat(np.arange(len(off) - 1), np.diff(off) + 1)


def slots(h: np.ndarray, size: int = SLOTS):
    """The probes of hashes, by double hashing."""
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for j in range(PROBES):
        yield ((a + np.uint64(j) * b) % np.uint64(size)).astype(np.int64)


def _distinct(batches):
    for b in batches:
        for lo, buf, off in T.pieces(b["text"]):
            h, row = grams(buf, off)
            o = np.lexsort((h, row))
            h, row = h[o], row[o]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            pair, at = pairs(buf, off)
            pair, times = np.unique(at << 16 | pair, return_counts=True)
            row = np.concatenate([row[new], pair >> 16])
            gram, n = np.concatenate([h[new].view(np.int64), pair & 0xFFFF]), np.concatenate([np.ones(new.sum(), np.int64), times])
            yield pa.RecordBatch.from_arrays([b["lang"].take(pa.array(row + lo)), pa.array(gram), pa.array(np.arange(len(gram)) >= new.sum()), pa.array(n)], ["lang", "gram", "pair", "n"])


class Filters:
    """Bit-sliced Bloom filters: one byte of languages per slot and slice of eight; pairs of bytes as a last resort."""

    def __init__(self, found: dict[str, np.ndarray], size: int = SLOTS, seen: dict[str, tuple[np.ndarray, np.ndarray]] | None = None, sizes: dict[str, int] | None = None):
        self.langs, self.size = sorted(found), size
        self.masks = np.zeros((-(-len(found) // 8), size), np.uint8)
        for k, lang in enumerate(self.langs):
            for at in slots(found[lang], size):
                self.masks[k // 8, at] |= np.uint8(1 << k % 8)
        self.false = np.array([float(np.mean(self.masks[k // 8] >> (k % 8) & 1)) ** PROBES for k in range(len(found))])

        # pairs that no language has say nothing: row 0
        known = np.unique(np.concatenate([np.zeros(0, np.int64), *(keys for keys, _ in (seen or {}).values())]))
        self.at = np.zeros(1 << 16, np.int64)
        self.at[known] = np.arange(len(known)) + 1
        self.logs = np.zeros((len(known) + 1, len(found)), np.float32)
        for k, lang in enumerate(self.langs if seen else []):
            times = np.ones(len(known))
            times[self.at[seen[lang][0]] - 1] += seen[lang][1]
            self.logs[1:, k] = np.log(times / max(1, times.sum()))
        self.prior = np.log([(sizes or {}).get(lang, 1) for lang in self.langs])

    def guess(self, pair: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Posteriors of the languages by row, from pairs of bytes and the prior."""
        out = np.stack([np.bincount(row, self.logs[self.at[pair], k], rows) for k in range(len(self.langs))], axis=1) + self.prior
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)

    def counts(self, h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Corrected numbers of n-grams by row and language."""
        out, probes = np.zeros((rows, len(self.langs))), list(slots(h, self.size))
        bits = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(float)
        for s, masks in enumerate(self.masks):
            got = masks[probes[0]]
            for at in probes[1:]:
                got = got & masks[at]
            seen = np.bincount(row * 256 + got, minlength=rows * 256).reshape(rows, 256) @ bits
            out[:, s * 8 : s * 8 + 8] = seen[:, : len(self.langs) - s * 8]
        n = np.bincount(row, minlength=rows)[:, None]
        return np.maximum(0, (out - n * self.false) / np.maximum(1e-9, 1 - self.false))


def fit(docs: DataFrame, sample: int = SAMPLE, size: int = SLOTS, fewest: int = 1) -> Filters:
    """Learn filters from documents with lang, for languages with `fewest` documents at least."""
    docs = docs.where("lang is not null and text is not null")
    ids = docs.where("doc_id is not null").select("doc_id", "lang").distinct()
    sizes = {r[0]: r[1] for r in ids.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return Filters({}, size)
    # few more rows than asked for are ranked, however many there are: hashes under a bound that the language's size sets
    bound = F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1 << 31, (4 * sample << 31) // v))]), F.col("lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) <= bound).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample)
    ids = ids.select("doc_id").distinct()
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(ids) if len(sizes) * sample <= 100_000 else ids, "doc_id", "left_semi").select("lang", "text")
    n = {r[0]: r[1] for r in rows.groupBy("lang").count().collect() if r[1] >= fewest}
    if not n:
        return Filters({}, size)
    seen = rows.mapInArrow(_distinct, "lang string, gram long, pair boolean, n long").groupBy("lang", "gram", "pair").agg(F.sum("n").alias("count"))
    least = F.element_at(F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, max(min(2, v), int(np.ceil(SHARE * v))))]), F.col("lang"))
    kept = seen.where(F.col("pair") & F.col("lang").isin(*n) | (F.col("count") >= least)).toArrow().to_pandas()  # at most 1 / SHARE of a text's n-grams and 65,536 pairs per language
    pair, kept = kept[kept["pair"]], kept[~kept["pair"]]
    share, rival = kept["count"] / kept["lang"].map(n), kept["lang"].map(n) > 1  # one document says little of what is frequent
    kept = kept[share >= NEAR * share.where(rival, 0).groupby(kept["gram"]).transform("max")]
    of = lambda df, c, k: df[c][df["lang"] == k].to_numpy(np.int64)
    return Filters({k: of(kept, "gram", k).view(np.uint64) for k in n}, size, {k: (of(pair, "gram", k), of(pair, "count", k)) for k in n}, sizes)


def predict(docs: DataFrame, filters: Filters, *keep: str) -> DataFrame:
    """A struct `row` of the columns keep, and lang_pred, score, known and grams: apart, so no column's name matters."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text", letter.alias("letter"))
    schema = S.StructType([docs.schema["row"], S.StructField("lang_pred", S.StringType()), S.StructField("score", S.DoubleType()), S.StructField("known", S.DoubleType()), S.StructField("grams", S.LongType())])

    def run(batches):
        f = shared.value
        names = np.array([*f.langs, "und"], dtype=object)
        for b in batches:
            best, sure, known, count = [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0)], [np.zeros(0, int)]
            for lo, buf, off in T.pieces(b["text"]):
                h, row = grams(buf, off)
                c = f.counts(h, row, len(off) - 1) if f.langs else np.zeros((len(off) - 1, 1))
                good = b["letter"].slice(lo, len(c)).to_numpy(zero_copy_only=False) & bool(f.langs)
                n, most = np.bincount(row, minlength=len(c)), c.max(axis=1)
                weak = good & (most <= 0)
                if weak.any():
                    pair, row = pairs(buf, off)
                    c[weak] = f.guess(pair[weak[row]], row[weak[row]], len(c))[weak]
                best.append(np.where(good, c.argmax(axis=1), len(f.langs)))
                sure.append(np.where(good, c.max(axis=1) / np.maximum(c.sum(axis=1), 1e-9), 0))
                known.append(np.where(good, most / np.maximum(1, n), 0))
                count.append(n)
            cols = (pa.array(names[np.concatenate(best)], pa.string()), *(pa.array(np.concatenate(x)) for x in (sure, known, count)))
            yield pa.RecordBatch.from_arrays([b["row"], *cols], ["row", "lang_pred", "score", "known", "grams"])

    return docs.mapInArrow(run, schema)


def identify_language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, known; learns outside the held-out fifth."""
    docs = docs.select("doc_id", "text", "lang", held_out(5, 0).alias("held_out"))
    return predict(docs, fit(docs.where("not held_out"), sample), "doc_id", "held_out").select("row.*", "lang_pred", "score", "known")
