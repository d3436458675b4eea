"""Benchmark decontamination with spaced seeds.

Tokens are lower-cased runs of word characters.  A document overlaps a benchmark item
if, aligned without gaps, some window of ``WINDOW`` item tokens (the whole item if it is
shorter) agrees with the document in at least 80 % of its places.  Items of under 8
tokens must agree in all places.  Items of under 5 tokens are matched whole, at their first
place, and reported as ``short``; they are too common to be evidence, so ``keep_clean``
drops no document for them.  An item without a token overlaps nothing.

Three fixed masks of weight 5 ignore some token positions.  Every window that fulfils the
rule holds a seed of one of them (all patterns of allowed substitutions are enumerated
in the tests), so the hash join loses nothing; each hit's whole diagonal is then
verified token by token, so hash collisions do not matter.  Short items have a solid mask
of their own length.

Benchmark texts are handled in blocks of bounded size, each sent to the workers once;
documents are scanned where they lie, without a shuffle.  Null or empty texts overlap
nothing.  Rows without an id are searched like others.  Repeated rows (of either table)
give one result per distinct (doc_id, item_id).  Very long texts are searched whole; of
windows that tie, the first is reported.  Empty tables give no overlaps.  Only doc_id,
item_id and the two text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionweave.llm.common import column, materialise, record, slices, table
from motionweave.llm.tokens import mix

WINDOW, PERCENT, SHORT, LEAST = 13, 80, 8, 5
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
SOLID = tuple(tuple(range(n)) for n in range(1, LEAST))
#: Characters of benchmark text in a block that is sent to all workers.
BLOCK_CHARS = 32_000_000
#: Text bytes whose tokens are held at once (one text at least).
SLICE = 1 << 20
_WORD = re.compile(r"\w+")
_PAD = 16


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def rule(n: int) -> tuple[int, int]:
    """(window, tokens that must agree) for an item of n tokens."""
    window = min(n, WINDOW)
    return window, window if n < SHORT else -(-window * PERCENT // 100)


def _seed(ids: np.ndarray, at: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    h = mix(ids[at].astype(np.uint64), mask[-1])
    for k in mask[1:]:
        h = mix(h, ids[at + k].astype(np.uint64))
    return h


class Benchmark:
    """Item tokens as numbers, and the seeds of all items, sorted by hash for each mask."""

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        self.vocab: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        for item_id, text in items:
            words = tokens(text)
            if words:
                self.items.append((item_id, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int64)))
        size = np.array([len(t) for _, t in self.items], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *(t for _, t in self.items)])
        item, start = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size) - size, size)
        place = np.arange(len(flat)) - start
        self.seeds = []
        for mask in (*MASKS, *SOLID):
            fits = size[item] >= LEAST if mask in MASKS else size[item] == len(mask)
            at = np.flatnonzero(fits & (place + mask[-1] < size[item]))
            h = _seed(flat, at, mask)
            order = np.argsort(h, kind="stable")
            self.seeds.append((h[order], item[at][order], place[at][order]))

    def overlaps(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first doc token, tokens aligned, tokens equal) of the best window per row and item."""
        words = [tokens(t) for t in texts]
        size = np.array([len(w) for w in words], np.int64)
        get, pad = self.vocab.get, [""] * _PAD
        ids = np.fromiter(map(get, chain.from_iterable(w + pad for w in words), repeat(0)), np.int64, int(size.sum()) + _PAD * len(words))
        base = np.cumsum(size + _PAD) - size - _PAD
        found: set[tuple[int, int, int]] = set()
        for mask, (seeds, item, place) in zip((*MASKS, *SOLID), self.seeds):
            if not len(seeds):
                continue
            live = ids[: max(0, len(ids) - mask[-1])] > 0
            for k in mask[1:]:
                live &= ids[k : k + len(live)] > 0
            at = np.flatnonzero(live)
            h = _seed(ids, at, mask)
            low, high = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
            hit = np.flatnonzero(high > low)
            # Hits are expanded in blocks: a seed may occur in many items.
            for part in np.array_split(hit, max(1, int((high - low)[hit].sum()) >> 20)):
                n = (high - low)[part]
                k = np.repeat(low[part] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                pos = np.repeat(at[part], n)
                row = np.searchsorted(base, pos, "right") - 1
                triples = np.unique(np.stack([row, item[k], pos - base[row] - place[k]]), axis=1)
                if mask in SOLID:  # equal seeds are equal items, but for collisions: the first place of each suffices
                    exact = self._whole(ids, triples, base, len(mask))
                    triples = triples[:, exact]
                    triples = triples[:, np.unique(triples[:2], axis=1, return_index=True)[1]]
                found.update(zip(*triples.tolist()))
        by: dict[tuple[int, int], list[int]] = {}
        for row, k, shift in found:
            by.setdefault((row, k), []).append(shift)
        out = []
        for (row, k), shifts in sorted(by.items()):
            best = self._verify(ids[base[row] : base[row] + size[row]], self.items[k][1], np.array(sorted(shifts)))
            if best:
                out.append((row, k, *best))
        return out

    def _whole(self, ids: np.ndarray, triples: np.ndarray, base: np.ndarray, n: int) -> np.ndarray:
        """Which of the (row, item, place) hold all ``n`` tokens of the item."""
        row, item, at = triples
        held = np.array([self.items[k][1] for k in item.tolist()]).reshape(len(item), n)
        return (ids[(base[row] + at)[:, None] + np.arange(n)] == held).all(1)

    @staticmethod
    def _verify(doc: np.ndarray, item: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int] | None:
        """The best window over all diagonals, if it fulfils the rule."""
        window, least = rule(len(item))
        best, place = 0, 0
        for k in range(0, len(shifts), max(1, (1 << 20) // len(item))):
            at = shifts[k : k + max(1, (1 << 20) // len(item)), None] + np.arange(len(item))
            inside = (at >= 0) & (at < len(doc))
            same = inside & (doc[np.where(inside, at, 0)] == item)
            sums = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1)
            score = sums[:, window:] - sums[:, :-window]
            top = int(score.max())
            if top > best:
                best = top
                r, c = np.unravel_index(int(score.argmax()), score.shape)
                place = int(at[r, c])
        return (place, window, best) if best >= least else None


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()


def count_blocks(benchmark: DataFrame) -> int:
    """How many blocks of about ``BLOCK_CHARS`` characters the benchmark has; a text counts once for every id."""
    return -(-(_items(benchmark).agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS)


def blocks(benchmark: DataFrame, n: int) -> Iterator[Benchmark]:
    """The benchmark's ``n`` blocks, one after the other; no item is left out."""
    items = _items(benchmark)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n or 1))
    for k in range(n):
        yield Benchmark([tuple(r) for r in items.filter(block == k).orderBy("item_id", "text").collect()])


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_token", pa.int64()), ("n_aligned", pa.int32()), ("n_equal", pa.int32()), ("short", pa.bool_())])


_DDL = "doc_id long, item_id long, doc_token long, n_aligned int, n_equal int, short boolean"


def _block_step(docs: DataFrame, block: Benchmark, several: bool, step: Callable[[DataFrame, Broadcast], DataFrame]) -> DataFrame:
    """``step`` with one block.  A single block stays lazy; of several, each is written and its
    broadcast freed before the next one is sent, so memory does not grow with their number."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    out = step(docs, shared)
    if several:
        out = materialise(out, "benchmark-block")
        shared.destroy()
    return out


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that overlap, with the best window; ``short`` marks items of under five tokens."""

    def search(docs: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            for whole in batches:
                for batch in slices(whole, "text", SLICE):
                    ids = column(batch, "doc_id").to_pylist()
                    rows = bench.overlaps(column(batch, "text").to_pylist())
                    yield record(
                        _OUT, doc_id=[ids[r[0]] for r in rows], item_id=[bench.items[r[1]][0] for r in rows],
                        doc_token=[r[2] for r in rows], n_aligned=[r[3] for r in rows], n_equal=[r[4] for r in rows], short=[r[3] < LEAST for r in rows],
                    )

        return docs.select("doc_id", "text").mapInArrow(run, _DDL)

    n = count_blocks(benchmark)
    parts = [_block_step(docs, b, n > 1, search) for b in blocks(benchmark, n)]
    found = reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], _DDL)
    best = F.max(F.struct("n_equal", (-F.col("doc_token")).alias("at"), "n_aligned", "short")).alias("b")
    found = found.groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", (-F.col("b.at")).alias("doc_token"), F.col("b.n_aligned").alias("n_aligned"), F.col("b.n_equal").alias("n_equal"), F.col("b.short").alias("short"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no item of five tokens or more, with all their columns; nothing is shuffled."""

    def without(docs: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text", SLICE):
                    clean = np.ones(batch.num_rows, bool)
                    clean[[r[0] for r in shared.value.overlaps(column(batch, "text").to_pylist()) if r[3] >= LEAST]] = False
                    yield batch.filter(pa.array(clean))

        return docs.mapInArrow(run, docs.schema)

    n = count_blocks(benchmark)
    for block in blocks(benchmark, n):
        docs = _block_step(docs, block, n > 1, without)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_decontaminate": op3_decontaminate}
SQL: dict[str, str] = {}
