"""Quality classifier: a generalised additive model with pairwise interactions.

Every whole text gets ``FEATURES``.  The model is boosted cyclically: round after round,
each feature in turn gets a shallow tree on the current residual, whose leaves are added
to that feature's lookup table over its bins; then the same is done for the pairs of
features with most residual gain.  Scoring is a sum of table look-ups, so it is
vectorised and every term can be read off.

It is fitted on a bounded sample: at most ``MAX_TRAIN`` labelled documents, chosen by a
hash of the id; the ids of that sample (bounded by the same number) are broadcast, so no
text is shuffled.  Conflicting labels of an id count as the lowest.  labels, lang, source
and doc_id are never inputs of a score, and other columns are not read.  An id that several
documents have trains with one of them.  Repeated rows get equal scores; empty tables give
no rows, and very long texts are read whole.  Null texts are empty and get a score like any
other; with no labelled document every score is 0.5, with one class all are the smoothed
share of that class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionweave.llm.common import column, is_held_out, record, slices, table, text_bytes
from motionweave.llm.tokens import Words, mix

MAX_TRAIN = 12_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 64, 8, 8, 150, 60, 0.1, 1.0
FEATURES = (
    "log_words", "word_chars", "upper", "digits", "symbols", "exclamations", "stops", "pipes", "other_ascii",
    "lines_per_word", "duplicate_lines", "repeated_words", "distinct_words", "line_words", "marked_words", "non_ascii",
    "short_words", "long_words", "top_word", "capital_words",
)


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER, _DIGIT = _bytes(bytes(range(65, 91))), _bytes(bytes(range(97, 123))), _bytes(b"0123456789")
_SYMBOL, _STOP = _bytes(b"#*$%&|<>@=_~^\\{}[]/+"), _bytes(b".,;:?")


def features(texts: pa.Array) -> np.ndarray:
    """(rows x len(FEATURES)) of whole texts."""
    w = Words(texts)
    data, n = w.data[: w.size], w.counts
    words, size = np.maximum(n, 1), np.maximum(np.diff(w.offsets), 1)
    chars = np.maximum(w.per_doc((data & 0xC0) != 0x80), 1)
    upper, lower = w.per_doc(_UPPER[data]), w.per_doc(_LOWER[data])
    breaks = w.per_doc(data == 10)
    length = w.ends - w.starts
    last, head = (w.data[w.ends - 1], w.data[w.starts]) if len(w.doc) else (np.zeros(0, np.uint8), np.zeros(0, np.uint8))

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc[mask], minlength=w.rows) / words

    dup, full = np.zeros(w.rows), np.ones(w.rows)
    for k, t in enumerate(text_bytes(texts)):
        lines = [x for x in t.split(b"\n") if x.strip()]
        if lines:
            full[k], dup[k] = len(lines), len(lines) - len(set(lines))
    h = w.hashes()
    five, at = w.windows(h, 5)
    five = mix(five, w.doc[at].astype(np.uint64))
    _, where, count = np.unique(five, return_inverse=True, return_counts=True)
    cover = np.zeros(len(w.doc), bool)
    for k in range(5):
        cover[at[count[where] > 1] + k] = True
    _, first, count = np.unique(mix(h, w.doc.astype(np.uint64)), return_index=True, return_counts=True)
    distinct = np.bincount(w.doc[first], minlength=w.rows)
    top = np.zeros(w.rows)
    np.maximum.at(top, w.doc[first], count)
    return np.stack(
        [
            np.log1p(n), w.per_doc(((data & 0xC0) != 0x80) & ~w.space) / words, upper / np.maximum(upper + lower, 1), w.per_doc(_DIGIT[data]) / chars,
            w.per_doc(_SYMBOL[data]) / chars, w.per_doc(data == 33) / words, share(_STOP[last]), w.per_doc(data == 124) / words,
            w.per_doc((data > 32) & (data < 127) & ~(_UPPER | _LOWER | _DIGIT)[data]) / chars, breaks / words, dup / full, share(cover),
            distinct / words, np.log1p(n / full), share(_SYMBOL[last] | _SYMBOL[head]), w.per_doc(data > 127) / size,
            share(length <= 3), share(length >= 12), top / words, share(_UPPER[head]),
        ],
        axis=1,
    )


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, k], "right")]
        for (a, b), g in zip(self.pairs, self.grids):
            out += g[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x))


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut of a histogram; gain 0: none."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of every bin of a tree of that depth."""
    gain, k = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), -g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _grid_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The same over two features: each cut takes the better axis."""
    (a, i), (b, j) = (_best_cut(g.sum(1), h.sum(1)), _best_cut(g.sum(0), h.sum(0))) if depth else ((0.0, 0), (0.0, 0))
    # An interaction shows only after the second cut, so the first may have no gain of its own.
    if max(a, b) <= 1e-9:
        return np.full(g.shape, -g.sum() / (h.sum() + RIDGE))
    if a >= b:
        return np.concatenate([_grid_tree(g[:i], h[:i], depth - 1), _grid_tree(g[i:], h[i:], depth - 1)], axis=0)
    return np.concatenate([_grid_tree(g[:, :j], h[:, :j], depth - 1), _grid_tree(g[:, j:], h[:, j:], depth - 1)], axis=1)


def _interaction(g: np.ndarray, h: np.ndarray) -> float:
    """Most gain of any cut of both features into four quadrants."""
    G, H = (np.pad(v, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for v in (g, h))
    total = 0.0
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            q = [(m[i, j], m[i, -1] - m[i, j], m[-1, j] - m[i, j], m[-1, -1] - m[i, -1] - m[-1, j] + m[i, j]) for m in (G, H)]
            total = max(total, sum(_gain(a, b) for a, b in zip(*q)))
    return total


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the lookup tables on features ``x`` and labels ``y`` (0 or 1)."""
    model = Model()
    if not len(y):
        return model
    share = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    model.edges = [_cuts(x[:, k], BINS) for k in range(x.shape[1])]
    model.coarse = [_cuts(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.coarse)]
    f = np.full(len(y), model.intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(f)
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for k, t in enumerate(model.tables):
            g, h = residual()
            step = RATE * _tree(np.bincount(at[k], g, len(t)), np.bincount(at[k], h, len(t)))
            t += step
            f += step[at[k]]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        m, n = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        return np.bincount(rough[a] * n + rough[b], v, m * n).reshape(m, n)

    g, h = residual()
    gains = sorted(((-_interaction(grid(a, b, g), grid(a, b, h)), (a, b)) for a, b in combinations(range(x.shape[1]), 2)))
    model.pairs = [p for gain, p in gains[:PAIRS] if gain < 0]
    model.grids = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), t in zip(model.pairs, model.grids):
            g, h = residual()
            step = RATE * _grid_tree(grid(a, b, g), grid(a, b, h))
            t += step
            f += step[rough[a], rough[b]]
    return model


def _with_features(docs: DataFrame, extra: list[str], ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = features(column(batch, "text"))
                yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in extra), pa.array(x.tolist(), pa.list_(pa.float64()))], names=[*extra, "features"])

    return docs.select(*extra, "text").mapInArrow(run, f"{ddl}, features array<double>")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most ``max_train`` labelled documents; of several texts of an id, the one with the smallest hash."""
    known = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000))
    rate = min(1.0, 1.5 * max_train / max(1, known.select("doc_id").distinct().count()) + 0.001)
    thinned = known.withColumn("draw", draw).filter(F.col("draw") < rate * 1_000_000)
    chosen = thinned.groupBy("doc_id", "draw").agg(F.min("quality").alias("quality")).orderBy("draw", "doc_id").limit(max_train).drop("draw")
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash")).join(F.broadcast(chosen), "doc_id")
    rows = _with_features(joined, ["doc_id", "quality", "hash"], "doc_id long, quality int, hash long")
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct("hash", "features"))["features"].alias("features")).orderBy("doc_id").collect()
    x = np.array([r.features for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([min(1, max(0, r.quality)) for r in rows], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                s = shared.value.score(features(column(batch, "text")))
                yield record(out, doc_id=column(batch, "doc_id").cast(pa.int64()), score=s, predicted=(s >= 0.5).astype(np.int32))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~is_held_out("doc_id", 3, 1))
    return score(docs, train(docs, labels)).select("doc_id", is_held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_quality_model": op7_quality_model}
SQL: dict[str, str] = {}
