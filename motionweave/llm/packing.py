"""Best-two-fit packing of tokenised documents into sequences of bounded length.

``cut`` tokenises every document, appends the end id and cuts what is longer than a sequence.
Lengths are whole numbers up to the capacity, so the packing is decided on their histogram
(at most ``capacity`` numbers, whatever the data): ``best_two_fit`` fills one bin after another,
largest piece first, then replaces the bin's smallest piece with the two unpacked ones that
fill the room best, and repeats the bin's pattern for as long as the same choice comes up
again, which is what packing bin by bin would do.  ``place`` gives each piece its slot: its
number among all pieces of its length is its number within the task that cut it plus the
counts of the tasks before, so no length, however frequent, meets in one task.

``sequences`` puts the ids of placed pieces together.

Null texts are empty (a single end id).  Rows without an id are packed like others.  Repeated
rows are pieces of their own.  An empty table gives no rows.  Only the id and text columns are
read, so others may have any name.  Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionweave.llm.common import column, materialise, record, slices, table
from motionweave.llm.tokens import LOWER

CAPACITY, END = 2048, 0
#: Words, and characters of words, that a Python worker keeps with their ids; beyond that it begins anew.
KEPT_WORDS, KEPT_CHARS = 500_000, 1 << 23
#: Plain words that go through the tokenizer as one text.
JOINED = 500
#: Bytes that part words, marks that are split off a letter before white space, and letters.
_SPACE, _IS_MARK, _LETTER = np.zeros((3, 256), bool)
_SPACE[[10, 32]], _IS_MARK[list(b",.;:!?")], _LETTER[[*range(65, 91), *range(97, 123)]] = True, True, True
#: Below these characters nothing composes, and case has no context.
_WIDE = re.compile("[\u0130\u0300-\U0010ffff]")


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of a column of texts (null: none), the number of each word in order, and how many a text has.

    Words are runs of bytes between spaces and line feeds; a mark after a letter is a word of
    its own.  A-Z are lower-cased in texts in which nothing composes.
    """
    col = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    size, offsets = int(ends[-1] - ends[0]), ends - ends[0]
    if not size:
        return [], np.zeros(0, np.int64), np.zeros(len(col), np.int64)
    raw = np.frombuffer(col.buffers()[2], np.uint8, size, int(ends[0]))
    wide = raw >= 0xCC
    wide[:-1] |= (raw[:-1] == 0xC4) & (raw[1:] == 0xB0)
    data = LOWER[raw]
    if wide.any():
        sums = np.concatenate([[0], np.cumsum(wide)])
        composed = np.repeat(sums[offsets[1:]] > sums[offsets[:-1]], np.diff(offsets))
        data = np.where(composed, raw, data)
    space = _SPACE[raw]
    edge = np.ones(size + 1, bool)  # a word may start here
    edge[1:size] = space[:-1]
    edge[1 : size - 1] |= _IS_MARK[raw[1:-1]] & _LETTER[raw[:-2]] & space[2:]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1] & ~space)
    stops = np.flatnonzero(~space & (edge[1:] | np.append(space[1:], True))) + 1
    at = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[~space])]).dictionary_encode()
    return words.dictionary.cast(pa.string()).to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(), np.diff(np.searchsorted(starts, offsets))


class Encoder:
    """Ids of whole texts, word by word: the tokenizer drops white space and joins nothing over it.

    Most words are letters below U+0300: their ids are those of the lower-cased letters, which go
    through the tokenizer many at a time; an id that ends a word tells them apart.
    """

    def __init__(self, path: str, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = self.plain.encode_special_tokens = True
        #: For lower-cased words of letters that do not compose, which the file's own normalizer and pattern leave as they are.
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.end = end
        self.clear()

    def clear(self) -> None:
        self.index: dict[str | None, int] = {None: 0}
        self.flat, self.ends, self.chars = np.array([self.end], np.uint32), np.array([0, 1]), 0

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.ends) - 1, len(self.ends) - 1 + len(words))))
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int64)])
        self.chars += sum(map(len, words))

    def _add_each(self, words: list[str]) -> None:
        own = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self._add(words, np.array([i for ids in own for i in ids], np.uint32), np.array([len(ids) for ids in own], np.int64))

    def _add_letters(self, words: list[str]) -> None:
        for at in range(0, len(words), JOINED * 64):
            some = words[at : at + JOINED * 64]
            joined = self.plain.encode_batch_fast([" ".join(some[k : k + JOINED]) for k in range(0, len(some), JOINED)], add_special_tokens=False)
            ids = np.array([i for e in joined for i in e.ids], np.uint32)
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                self._add(some, ids, np.diff(stops, prepend=0))
            else:
                self._add_each(some)

    def learn(self, words: list[str]) -> None:
        """Add words that are not there yet."""
        self._add_letters([w for w in words if w.isascii() and w.isalpha() and w.islower()])
        rest = [w for w in words if w not in self.index]
        letters = {w: w.lower() for w in rest if w.isalpha() and not _WIDE.search(w)}
        letters = {w: low for w, low in letters.items() if low.isalpha()}
        self._add_letters(list(set(letters.values()) - self.index.keys()))
        self.index.update((w, self.index[low]) for w, low in letters.items() if w != low)
        if other := [w for w in rest if w not in letters]:
            self._add_each(other)

    def __call__(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by the end id, and where each text's ids begin (and the end)."""
        words, number, size = words_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        new = [w for w in words if w not in self.index]
        if new and (len(self.index) + len(new) > KEPT_WORDS or self.chars > KEPT_CHARS):
            self.clear()
            new = words
        self.learn(new)
        stops = np.cumsum(size + 1)
        word = np.ones(len(number) + len(size), bool)
        word[stops - 1] = False
        at = np.zeros(len(word), np.int64)  # 0 is the end of a text
        at[word] = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))[number]
        begin, length = self.ends[at], self.ends[at + 1] - self.ends[at]
        last = np.cumsum(length)
        ids = self.flat[np.repeat(begin - (last - length), length) + np.arange(last[-1])]
        return ids, np.concatenate([[0], last[stops - 1]])


@lru_cache(maxsize=2)
def encoder(path: str, end: int) -> Encoder:
    """One encoder for the life of a Python worker."""
    return Encoder(path, end)


def _ranks(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Number of every piece among those of its length so far; ``seen`` counts on."""
    order = np.argsort(lengths, kind="stable")
    run = lengths[order]
    first = np.searchsorted(run, run)
    rank = np.empty(len(run), np.int64)
    rank[order] = np.arange(len(run)) - first + seen[run]
    np.add.at(seen, lengths, 1)
    return rank


def cut(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32 and (``keep_ids``) ids.

    ``task`` and ``rank`` number the pieces of one length within the task that made them; they
    hold for one run, so write the rows before using them twice.
    """
    key = docs.schema[id_col].dataType.simpleString()
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())]
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(tokenizer_file, end), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, text_col):
                ids, first = encode(column(batch, text_col))
                tokens = np.diff(first)
                pieces = -(-tokens // capacity)
                doc = np.repeat(np.arange(len(tokens)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(tokens[doc] - start, capacity)
                begin = first[doc] + start
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                more = {"ids": pa.ListArray.from_arrays(pa.array(np.append(begin, first[-1]).astype(np.int32)), pa.array(ids.view(np.int32)))} if keep_ids else {}
                yield record(
                    pa.schema([batch.schema.field(id_col), *fields]),
                    **{id_col: column(batch, id_col).take(pa.array(doc)), "piece": piece, "start": start, "length": length, "ids_crc32": crc, "task": [task] * len(doc), "rank": _ranks(length, seen), **more},
                )

    schema = f"{id_col} {key}, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<int>" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _best_pair(counts: np.ndarray, room: int) -> tuple[int, int]:
    """The two unpacked sizes of greatest sum up to ``room``, the larger one as large as can be; (0, 0) if there are none."""
    sizes = np.arange(len(counts))
    below = np.maximum.accumulate(np.where(counts > 0, sizes, 0))
    x = np.flatnonzero(counts[:room] > 0)
    if not len(x):
        return 0, 0
    most = np.minimum(room - x, x)
    most -= (most == x) & (counts[x] < 2)
    y = below[most]
    total = np.where(y > 0, x + y, 0)
    k = len(x) - 1 - int(total[::-1].argmax())
    return (int(x[k]), int(y[k])) if total[k] else (0, 0)


def best_two_fit(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """(pattern, bins) for ``counts[size]`` pieces of every size; the capacity is the largest index.

    A pattern maps sizes to how many of them a bin takes.  Each entry uses up a size (or leaves
    too few for its pattern), so there are few, and a bin takes time only per entry.
    """
    counts, capacity = counts.astype(np.int64).copy(), len(counts) - 1
    counts[0] = 0
    plan = []
    while counts.any():
        left, room, filled = counts.copy(), capacity, {}
        while room and len(fits := np.flatnonzero(left[: room + 1])):
            size = int(fits[-1])
            filled[size] = int(min(left[size], room // size))
            left[size] -= filled[size]
            room -= size * filled[size]
        final, smallest = dict(filled), min(filled)
        if room and sum(filled.values()) > 1:
            x, y = _best_pair(left, room + smallest)
            if x + y > smallest:
                final[smallest] -= 1
                for size in (x, y):
                    final[size] = final.get(size, 0) + 1
        needed = {s: max(filled.get(s, 0), final.get(s, 0)) for s in final}
        final = {s: k for s, k in final.items() if k}
        bins = min((int(counts[s]) - needed[s]) // k + 1 for s, k in final.items())
        for s, k in final.items():
            counts[s] -= k * bins
        plan.append((final, bins))
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """The plan by size: rows (size, first rank, first sequence, pieces of the size a bin, offset), ascending."""
    out, used, sequence = [], {}, 0
    for pattern, bins in plan:
        offset = 0
        for size, k in sorted(pattern.items(), reverse=True):
            out.append((size, used.get(size, 0), sequence, k, offset))
            used[size] = used.get(size, 0) + k * bins
            offset += size * k
        sequence += bins
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Written pieces with their sequence_id and offset."""
    counts = materialise(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[r.length] = r.n
    where = slots(best_two_fit(histogram))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    ranked = pieces.join(counts.select("task", "length", before.alias("_before")).hint("merge"), ["task", "length"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("_before")).drop("_before")
    names = [c for c in pieces.columns if c not in ("task", "rank")]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*names).schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = np.searchsorted(where[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = column(batch, "length").to_numpy(), column(batch, "rank").to_numpy()
            at = np.empty(len(length), np.int64)
            for size in np.unique(length):
                own = length == size
                at[own] = begin[size] + np.searchsorted(where[begin[size] : begin[size + 1], 1], rank[own], side="right") - 1
            t, k = rank - where[at, 1], where[at, 3]
            placed = [pa.array(where[at, 2] + t // k), pa.array(where[at, 4] + t % k * length)]
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in names], *placed], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(run, out)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids of every sequence, from placed pieces with their ids (a sequence is at most the capacity)."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(rows, lambda r: r["ids"])).alias("ids"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = materialise(cut(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False), "pieces")
    return place(pieces)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_best_fit": op12_best_fit}
SQL: dict[str, str] = {}
