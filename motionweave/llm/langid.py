"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, every other run of characters becomes one space, and n-grams of
1 to 3 characters are hashed to ``BUCKETS``.  Term frequencies are relative to the text's
n-grams, so any length is scored alike, in one pass over the whole text.  Weights come
from follow-the-regularised-leader (FTRL-Proximal) with L1 and L2 penalties; a
temperature, fitted on a fifth of the sample that training does not see, calibrates the
probabilities.

The model is fitted on a bounded sample: at most ``MAX_TRAIN`` documents with a language
(equal shares, one document at least, chosen by a hash of the id; texts of over ``LONG``
characters only where a language has too few others).  Its inverse document frequencies are
part of that fit.  The weights have ``CELLS`` cells at most: with many languages n-grams share
fewer buckets (65,536 for up to 512 languages), so memory stays bounded for any number of
them; over ``MAX_LANGUAGES`` is an error, as the column then holds something else.

Null texts and texts without letters are ``und`` with score 0; without any labelled
document every text is.  Very long texts are read whole, in pieces of bounded memory.  Ties
go to the language that sorts first.  Repeated rows get equal results; an empty table gives
none.  lang, source and doc_id are never inputs of a prediction, and other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionweave.llm.common import column, is_held_out, record, slices, table

ORDERS, BUCKETS, SCALE = (1, 2, 3), 1 << 16, 20.0
MAX_TRAIN, LONG, MAX_LANGUAGES = 4000, 20_000, 5000
#: Cells of the weights, and of those that are gathered at once for the n-grams of a piece.
CELLS, GATHER = 1 << 25, 1 << 19
#: Text bytes that are taken apart at once (one text at least).
SLICE = 1 << 20
#: FTRL-Proximal: learning rate, its offset, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 3
MIN_SCORE = 0.4
UNKNOWN = "und"
_STEP = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, else 32."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the bucket and the row of every n-gram; rows rise."""
    size = [0 if t is None else len(t) for t in texts]
    raw = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), "<u4")
    c, row = _letters()[raw], np.repeat(np.arange(len(texts), dtype=np.int32), size)
    gap = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(gap[1:] & gap[:-1] & (row[1:] == row[:-1]))
    c, row = c[keep], row[keep]
    for n in ORDERS:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ c[k : len(c) - n + 1 + k]) * _STEP[k]
            h ^= h >> np.uint32(15)
        same = row[: len(c) - n + 1] == row[n - 1 :]
        if n == 1:
            same &= c != 32
        yield (h[same] >> np.uint32(16)).astype(np.int32), row[: len(c) - n + 1][same]


def has_letters(texts: list[str | None]) -> np.ndarray:
    return np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)


@dataclass
class Model:
    languages: list[str]
    #: (buckets x languages) weight times inverse document frequency, and the bias.
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str | None]) -> np.ndarray:
        k, mask = len(self.languages), len(self.weights) - 1
        sums, total = np.zeros((len(texts), k)), np.zeros(len(texts))
        step = max(1, GATHER // k)
        for buckets, rows in ngrams(texts):
            total += np.bincount(rows, minlength=len(texts))
            for at in range(0, len(rows), step):
                bucket, row = buckets[at : at + step], rows[at : at + step]
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                sums[row[first]] += np.add.reduceat(self.weights.take(bucket & mask, axis=0).astype(np.float64), first, axis=0)
        return SCALE * sums / np.maximum(total, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = softmax(self.logits(texts) / self.temperature)
        known, best = has_letters(texts), p.argmax(axis=1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, p.max(axis=1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def bucket_count(languages: int) -> int:
    """A power of two, so that the weights have at most ``CELLS`` cells."""
    return min(BUCKETS, 1 << (CELLS // max(1, languages)).bit_length() - 1)


def _shared(b: np.ndarray, c: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts when n-grams share fewer buckets."""
    if buckets == BUCKETS:
        return b, c
    once, at = np.unique(b & (buckets - 1), return_inverse=True)
    return once, np.bincount(at, c, len(once))


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], languages: list[str]) -> Model:
    """Train on (language, buckets, counts) rows; every fifth row calibrates the temperature."""
    k = len(languages)
    if not k:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    buckets = bucket_count(k)
    samples = [(x, *_shared(b, c, buckets)) for x, b, c in samples]
    spare = [s for i, s in enumerate(samples) if i % 5 == 4]
    train = [s for i, s in enumerate(samples) if i % 5 != 4]
    df = np.zeros(buckets)
    for _, b, _ in train:
        df[b] += 1
    idf = np.log((1 + len(train)) / (1 + df)) + 1
    code = {x: i for i, x in enumerate(languages)}
    z, n = np.zeros((buckets + 1, k)), np.zeros((buckets + 1, k))  # the last row is the bias

    def solve(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    def features(b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return SCALE * c / max(1, c.sum()) * idf[b]

    for _ in range(EPOCHS):
        for lang, b, c in train:
            at, x = np.append(b, buckets), np.append(features(b, c), 1.0)
            w = solve(at)
            p = softmax(x @ w)
            p[code[lang]] -= 1
            g = x[:, None] * p[None, :]
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    w = solve(slice(None))
    model = Model(languages, (w[:-1] * idf[:, None]).astype(np.float32), w[-1])
    if spare:
        x = np.array([features(b, c) @ w[b] + w[-1] for _, b, c in spare])
        y = np.array([code[s[0]] for s in spare])
        grid = np.exp(np.linspace(np.log(0.1), np.log(10), 81))
        model.temperature = float(min(grid, key=lambda t: -np.log(softmax(x / t)[np.arange(len(y)), y] + 1e-12).sum()))
    return model


def train(docs: DataFrame) -> Model:
    """Fit on a bounded sample of the documents that have a language.

    The shares are thinned by a hash of id and text before any ranking, so a ranking task gets
    about twice the documents that are kept, however large a language is.  The document of the
    smallest hash is always in, so no language is left without one.  Repeated rows count once.
    """
    labelled = docs.filter("lang is not null and text is not null")
    draw = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text", F.lit("langid"))
    labelled = labelled.select("text", "lang", draw.alias("draw"))
    found = labelled.groupBy("lang").agg(F.count("draw").alias("n"), F.min("draw").alias("first")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    sizes = {r.lang: r.n for r in found}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not sizes:
        return fit([], [])
    share = max(1, MAX_TRAIN // len(sizes))
    rates = [(r.lang, min(1.0, 2 * share / r.n + 20 / r.n) * 1_000_000, r.first) for r in found]
    rates = F.broadcast(docs.sparkSession.createDataFrame(rates, "lang string, rate double, first long"))  # at most MAX_LANGUAGES rows
    thinned = labelled.join(rates, "lang").filter((F.pmod("draw", F.lit(1_000_000)) < F.col("rate")) | (F.col("draw") == F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                texts = column(batch, "text").to_pylist()
                cells, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *(r.astype(np.int64) * BUCKETS + b for b, r in ngrams(texts))]), return_counts=True)
                cuts = np.searchsorted(cells, np.arange(len(texts) + 1) * BUCKETS)
                rows = [((cells[a:z] % BUCKETS).astype("<i4").tobytes(), counts[a:z].astype("<i4").tobytes()) for a, z in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "lang"), column(batch, "draw"), pa.array([len(t) > LONG for t in texts]), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                    names=["lang", "draw", "long", "buckets", "counts"],
                )

    vectors = thinned.select("text", "lang", "draw").mapInArrow(run, "lang string, draw long, long boolean, buckets binary, counts binary").dropDuplicates(["lang", "draw"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "draw"))
    chosen = vectors.withColumn("rank", rank).filter(F.col("rank") <= share).orderBy("draw", "lang").collect()
    return fit([(r.lang, np.frombuffer(r.buckets, "<i4"), np.frombuffer(r.counts, "<i4")) for r in chosen], sorted(sizes))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                lang, score = shared.value.predict(column(batch, "text").to_pylist())
                yield record(out, doc_id=column(batch, "doc_id").cast(pa.int64()), lang_pred=lang, score=score)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents with a language of at least ``min_score``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                lang, score = shared.value.predict(column(batch, "text").to_pylist())
                yield batch.filter(pa.array([a != UNKNOWN and b >= min_score for a, b in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~is_held_out("doc_id", 4, 2)))
    return predict(docs, model).select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_language": op6_language}
SQL: dict[str, str] = {}
