"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are counted over *all*
documents of a language: one over all of them, one over the trusted target (documents
labelled as of good quality).  The language is op6's prediction, so like is compared with
like and a verdict does not hang on how labels are spread over languages.  A document's
score is the mean, over its n-grams, of log(P_target / P_raw); it is kept if the base rules
pass and the score is at least a fixed threshold.  The ratio tables are rounded to integers
(millionths), so sums do not depend on order and every run gives the same verdicts.

Every language is judged by its ratio, however few trusted documents it has: a language's
ratio is smoothed towards that of the other languages together, and that towards one.  They
compare the trusted n-grams with those that as many n-grams of the same languages would
hold, so a language without trusted documents is no evidence against its words.

Very long texts are judged whole; an empty table gives no rows.  Null and empty texts have no words and fail the base rules.  Repeated rows are judged alike
(each counts in the corpus); only doc_id, text and (to learn the languages) lang are read,
so extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from motionweave.llm import langid
from motionweave.llm.common import column, materialise, record, slices, table, text_bytes
from motionweave.llm.tokens import Words, mix

BUCKETS = 1 << 16
#: Pseudo-counts in every bucket: a bucket of fewer expected n-grams tells little.
EVIDENCE = 8
#: Mean log ratio in millionths below which a document is rejected.
THRESHOLD = -200_000
#: Text bytes judged at once; their languages take most of the memory.
SLICE = 1 << 20
#: Trusted ids are broadcast up to this many bytes (64 for each); beyond it they are joined.
BROADCAST_BYTES, ID_BYTES = 16 << 20, 64
MIN_WORDS, REPEAT_PERCENT = 10, 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def buckets(w: Words, size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and their rows."""
    h = w.hashes()
    pairs, at = w.windows(h, 2)
    grams = np.concatenate([mix(h, 1), mix(pairs, 2)]) & np.uint64(size - 1)
    return grams.astype(np.int64), np.concatenate([w.doc, w.doc[at]])


def with_languages(docs: DataFrame, model: langid.Model, name: str) -> DataFrame:
    """``docs`` with the number of each text's language as ``name`` (the last number: texts of none)."""
    shared, code = docs.sparkSession.sparkContext.broadcast(model), {x: k for k, x in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                found = shared.value.predict(column(batch, "text").to_pylist())[0]
                yield batch.append_column(name, pa.array([code.get(x, len(code)) for x in found], pa.int32()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, IntegerType())]))


def count_grams(docs: DataFrame, trusted: DataFrame, language: str, size: int) -> DataFrame:
    """Counts over all documents, one row a language: sorted buckets, and target and raw counts, as little-endian int64.

    A task sends one row per language and bucket at most; a row packs at most ``size`` buckets.
    """
    marked = docs.select("doc_id", "text", F.col(language).alias("language")).join(trusted.withColumn("trusted", F.lit(True)), "doc_id", "left").select("text", "language", "trusted")
    out = pa.schema([("language", pa.int32()), ("bucket", pa.int32()), ("target", pa.int64()), ("raw", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                good = np.array([bool(x) for x in column(batch, "trusted").to_pylist()])
                grams, doc = buckets(Words(column(batch, "text")), size)
                spoken = column(batch, "language").to_numpy()
                for k in np.unique(spoken).tolist():
                    held, mine = sums.setdefault(k, np.zeros((2, size), np.int64)), spoken[doc] == k
                    held[0] += np.bincount(grams[mine & good[doc]], minlength=size)
                    held[1] += np.bincount(grams[mine], minlength=size)
        for k, (target, raw) in sums.items():
            at = np.flatnonzero(raw)
            yield record(out, language=np.full(len(at), k, np.int32), bucket=at.astype(np.int32), target=target[at], raw=raw[at])

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("bucket")
        cells = [pa.array([t[c].to_numpy().astype("<i8").tobytes()], pa.binary()) for c in ("bucket", "target", "raw")]
        return pa.table([pa.array([t["language"][0].as_py()], pa.int32()), *cells], names=["language", "bucket", "target", "raw"])

    cells = marked.mapInArrow(run, "language int, bucket int, target long, raw long").groupBy("language", "bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    return cells.groupBy("language").applyInArrow(pack, "language int, bucket binary, target binary, raw binary")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled as of good quality by every label they have; broadcast only if few."""
    ids = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    return F.broadcast(ids) if ID_BYTES * ids.count() <= BROADCAST_BYTES else ids


def smooth(counts: Callable[[], Iterable[tuple[int, np.ndarray, np.ndarray]]], languages: int, size: int) -> np.ndarray:
    """log(P_target / P_raw) in millionths, a row for each language, from (language, target, raw) counts in order.

    A language's raw multinomial q has add-one smoothing, and E = n * q is what its n trusted
    n-grams would hold by it.  A bucket's ratio in the other languages is (T + EVIDENCE) / (E +
    EVIDENCE), with T and E summed over them; its ratio in the language itself is (T + EVIDENCE
    * that) / (E + EVIDENCE), scaled so that P_target sums to one.  A document's own n-grams add
    at most one to E each time, so that alone does not lower its ratio below the threshold.
    ``counts`` is gone through twice; one language is held at a time.
    """
    held, expected = np.zeros(size), np.zeros(size)
    for _, target, raw in counts():
        held += target
        expected += target.sum() * (raw + 1) / (raw.sum() + size)
    out = np.zeros((languages, size), np.int32)
    for k, target, raw in counts():
        q = (raw + 1) / (raw.sum() + size)
        own = target.sum() * q
        others = (held - target + EVIDENCE) / (np.maximum(expected - own, 0) + EVIDENCE)
        ratio = (target + EVIDENCE * others) / (own + EVIDENCE)
        out[k] = np.rint(1e6 * np.log(ratio / (q * ratio).sum()))
    return out


def fit(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str, np.ndarray]:
    """The documents with their languages' numbers (written once), that column's name, and the ratios of every language."""
    name = "_language"
    while name in map(str.lower, docs.columns):
        name += "_"
    model = langid.train(docs)
    rows, size = len(model.languages) + 1, min(BUCKETS, langid.bucket_count(len(model.languages) + 1))
    known = materialise(with_languages(docs, model, name), "languages")
    packed = materialise(count_grams(known, trusted_ids(labels), name, size).orderBy("language"), "grams")

    def counts() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for r in packed.orderBy("language").toLocalIterator():
            target, raw = np.zeros(size), np.zeros(size)
            at = np.frombuffer(r.bucket, "<i8")
            target[at], raw[at] = np.frombuffer(r.target, "<i8"), np.frombuffer(r.raw, "<i8")
            yield r.language, target, raw

    return known, name, smooth(counts, rows, size)


def rate(texts: pa.Array, language: np.ndarray, ratios: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts, score and verdicts of a column of texts in the given languages."""
    w = Words(texts)
    n = w.counts
    n_chars = w.per_doc(((w.data[: w.size] & 0xC0) != 0x80) & ~w.space)
    symbols = w.per_doc(_SYMBOL[w.data[: w.size]])
    lines = np.zeros(w.rows, np.int64)
    for k, t in enumerate(text_bytes(texts)):
        if b"\n" in t:
            full = [x for x in t.split(b"\n") if x.strip()]
            lines[k] = len(full) - len(set(full))
    five, at = w.windows(w.hashes(), 5)
    five = mix(five, w.doc[at].astype(np.uint64))
    order = np.argsort(five, kind="stable")
    same = five[order][1:] == five[order][:-1]
    twice = np.zeros(len(five), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(w.doc) + 1, np.int64)
    for k in range(5):
        cover[at[twice] + k] = 1
    repeats = np.bincount(w.doc[cover[:-1] > 0], minlength=w.rows)
    grams, doc = buckets(w, ratios.shape[1])
    # Exact: integers below 2^53 in every document of under 10^9 n-grams.
    total = np.bincount(doc, ratios[language[doc], grams].astype(np.float64), minlength=w.rows)
    score = np.floor(total / np.maximum(np.bincount(doc, minlength=w.rows), 1)).astype(np.int64)
    failed = (n < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n)
    return {
        "n_words": n, "word_chars": n_chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeats,
        "base_failed": failed, "kept": ~failed & (score >= THRESHOLD), "score": score / 1e6,
    }


_OUT = pa.schema(
    [("doc_id", pa.int64())] + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())]
)
_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document with counts, verdict and score."""
    known, name, ratios = fit(docs.select("doc_id", "text", "lang"), labels)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                yield record(_OUT, doc_id=column(batch, "doc_id").cast(pa.int64()), **rate(column(batch, "text"), column(batch, name).to_numpy(), shared.value))

    return known.select("doc_id", "text", name).mapInArrow(run, _DDL)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    known, name, ratios = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                kept = rate(column(batch, "text"), column(batch, name).to_numpy(), shared.value)["kept"]
                yield batch.drop_columns([name]).filter(pa.array(kept))

    return known.mapInArrow(run, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_quality_rules": op8_quality_rules}
SQL: dict[str, str] = {}
