"""N-gram language model in a sharded Elias-Fano trie.

Counting takes one pass over the corpus per order and keeps every n-gram.  Tasks count
their own n-grams first and send them on packed.

Level 1 holds the word hashes in Elias-Fano code and the exact counts.  A node of level
n > 1 is the pair (id of its first n-1 words, id of its last n-1 words) in level n-1: the
successor of a context is named by its own id in the shorter context.  Each shard of a
level codes its sorted contexts and their successors, made monotone by adding the context's
rank times the universe; a query finds the context and searches the successor, whose code
tells its context too, so that no pointers to a context's range are needed.  Shards are
dealt by a hash of the context; contexts that occur ``HOT`` times or more (their number
is bounded by the tokens over ``HOT``) are dealt by the whole n-gram, so a frequent one is
spread over all shards.  Where shards are is a written table, which workers read; neither
the driver nor a task's closure holds a row per shard.

Probabilities are smoothed by interpolated absolute discounting,
``p(w|h) = max(c(hw) - D, 0) / c(h) + gamma(h) p(w|h')`` with ``gamma(h) = D n(h) / c(h)`` for the
n(h) different successors of h, down to ``(c + 1) / (N + V + 1)`` for single words, known or
not; they sum to one.  Their logarithms are quantised to 16 bits, so a text's score is an
exact integer sum, whatever the order.

Texts are lower-cased (A-Z); the end of a text is a token.  Null texts are empty and have
the end alone.  Repeated rows count as often as they occur and get equal scores.  Rows without an id are
training rows and are scored.  With no training text N = V = 0 and every token has
probability 1; an empty table gives no rows.  Only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionweave.llm.common import column, fresh_dir, is_held_out, record, remove, slices, table, written
from motionweave.llm.elias_fano import encode, load, nested, pick, save
from motionweave.llm.tokens import Words, mix

ORDER, DISCOUNT = 3, 0.75
#: Text bytes per shard of a level, and rows that a counting task holds before it sends them on.
SHARD_TEXT, HELD_ROWS = 16 << 20, 3_000_000
#: Occurrences from which a context is spread over all shards, and shuffle partitions at most (each then takes several shards, one after the other).
HOT, MAX_PARTS = 1 << 20, 1 << 14
#: Shards that a worker keeps open.
OPEN_SHARDS = 1 << 12
END = np.uint64(0x454E442D4F462D54)
#: log10 probabilities are coded in 65,536 steps from 0 down to -LOWEST.
LOWEST = 16.0
_PART = "kind int, shard int, suffix string, n long, total long, blob binary"
_PART_PA = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("suffix", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("blob", pa.binary())])


def quantise(p: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(-np.log10(np.maximum(p, 1e-300)), 0, LOWEST) * (65535 / LOWEST)).astype(np.uint16)


def restore(code: np.ndarray | int) -> np.ndarray:
    return 10.0 ** (np.asarray(code, np.float64) * (-LOWEST / 65535))


# --- packed rows ------------------------------------------------------------------------


def _pack(*columns: np.ndarray) -> bytes:
    """Equally long unsigned columns; the first one is sorted and stored by differences."""
    parts = [np.array([len(columns[0])], "<i8").tobytes()]
    for k, c in enumerate(columns):
        if k == 0 and len(c):
            c = np.concatenate([c[:1], c[1:] - c[:-1]])
        top = int(c.max()) if c.dtype.kind != "f" and len(c) else 0
        kind = "<f8" if c.dtype.kind == "f" else next(t for t in ("<u1", "<u2", "<u4", "<u8") if top < 1 << 8 * int(t[2]))
        parts += [kind.encode(), np.ascontiguousarray(c.astype(kind)).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes, n_columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for k in range(n_columns):
        kind = raw[at : at + 3].decode()
        c = np.frombuffer(raw, kind, n, at + 3)
        at += 3 + c.nbytes
        out.append(np.cumsum(c, dtype=np.uint64) if k == 0 else c)
    return out


def _sorted(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (a, b), and a mask of the first ones of equal rows in that order."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    if b is not None and int(a.max()) < 1 << 32 and int(b.max()) < 1 << 32:
        a, b = a << np.uint64(32) | b, None
    order = np.argsort(a) if b is None else np.lexsort((b, a))
    a = a[order]
    new = a[1:] != a[:-1]
    if b is not None:
        b = b[order]
        new |= b[1:] != b[:-1]
    return order, np.concatenate([[True], new])


def _merge(a: np.ndarray, b: np.ndarray | None, v: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Sort rows by (a, b) and add up ``v`` of equal ones."""
    if not len(a):
        return a, b, v
    order, new = _sorted(a, b)
    once = order[new]
    return a[once], None if b is None else b[once], np.add.reduceat(v[order], np.flatnonzero(new))


# --- the model --------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Where the levels are: ``folder/level-k`` is the table of level k's shards."""

    folder: str
    levels: int
    shards: int  # a power of two
    total: int  # N
    vocabulary: int  # V
    #: Of each level, whether some of its contexts are spread over all shards.
    spread: tuple[bool, ...] = (False,)


def _read(uri: str) -> pa.Table:
    where, path = fs.FileSystem.from_uri(uri)
    return pyarrow.dataset.dataset(path, filesystem=where, format="parquet").to_table()


class _Level:
    """The table of a level's shards, as a worker holds it."""

    def __init__(self, model: Model, level: int) -> None:
        t = _read(f"{model.folder}/level-{level}").select(["shard", "suffix", "n", "blob"])
        shard = t["shard"].to_numpy()
        self.prefix, self.suffix = f"{model.folder}/shard-{level}-", np.full(model.shards, "", "U8")
        self.suffix[shard] = t["suffix"].to_numpy(zero_copy_only=False).astype("U8")
        sizes = np.zeros(model.shards, np.int64)
        sizes[shard] = t["n"].to_numpy()
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        #: Ids of the nodes that are frequent contexts, in order.
        found = [_unpack(b, 1)[0].astype(np.int64) + self.offsets[s] for s, b in zip(shard.tolist(), t["blob"].to_pylist()) if b is not None]
        self.hot = np.sort(np.concatenate([np.zeros(0, np.int64), *found]))

    def path(self, shard: int) -> str | None:
        return f"{self.prefix}{shard}-{self.suffix[shard]}" if self.suffix[shard] else None


class Reader:
    """Memory-mapped levels, opened shard by shard as queries reach them."""

    def __init__(self, model: Model) -> None:
        self.model, self.open = model, {}
        self.levels = [_Level(model, k) for k in range(model.levels)]

    def _arrays(self, level: int, shard: int) -> dict | None:
        """A shard's arrays and codes; None if it has no node."""
        key = (level, shard)
        if key not in self.open:
            if len(self.open) >= OPEN_SHARDS:
                self.open.clear()
            path = self.levels[level].path(shard)
            arrays = load(path) if path else None
            self.open[key] = arrays and arrays | {p: pick(p, arrays) for p in ("words", "contexts", "successors") if f"{p}.meta" in arrays}
        return self.open[key]

    @cached_property
    def hot_gamma(self) -> dict[int, np.ndarray]:
        """Quantised back-off weights of each level's spread contexts, in the order of their ids."""
        out = {}
        for level in range(1, self.model.levels):
            ids = self.levels[level - 1].hot
            if len(ids):
                t = _read(f"{self.model.folder}/hot-{level}")
                n = np.zeros(len(ids))
                n[np.searchsorted(ids, t["id"].to_numpy())] = t["n"].to_numpy()
                out[level] = quantise(DISCOUNT * n / self.counts(level - 1, ids))
        return out

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1 if unknown) and count of every word hash."""
        asked, where = np.unique(hashes, return_inverse=True)
        ids, count = np.full(len(asked), -1, np.int64), np.zeros(len(asked), np.int64)
        shards, offsets = self.model.shards, self.levels[0].offsets
        shift = np.uint64(64 - (shards.bit_length() - 1))
        cuts = np.searchsorted(asked, np.arange(1, shards, dtype=np.uint64) << shift)
        for s, (a, z) in enumerate(zip([0, *cuts], [*cuts, len(asked)])):
            if z > a and (arrays := self._arrays(0, s)):
                at, same = arrays["words"].successor(asked[a:z] - (np.uint64(s) << shift))
                ids[a:z][same] = at[same] + offsets[s]
                count[a:z][same] = arrays["counts"][at[same]]
        return ids[where], count[where]

    def nodes(self, level: int, first: np.ndarray, last: np.ndarray, codes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the nodes (first, last) of ``level`` (from 1 on): id (-1 if there is none) and, with
        ``codes``, quantised log probability and the context's back-off weight (0: no such context).

        Equal nodes are looked up once, and in order, so that neighbours meet the same pages."""
        order, new = _sorted(first.astype(np.uint64), last.astype(np.uint64))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        once = order[new]
        return tuple(v[place] for v in self._nodes(level, first[once], last[once], codes))

    def _nodes(self, level: int, first: np.ndarray, last: np.ndarray, codes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``nodes``, for different nodes in order."""
        out, code, gamma = np.full(len(first), -1, np.int64), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        hot, offsets = self.levels[level - 1].hot, self.levels[level].offsets
        order, cuts = _dealt(node_shard(first, last, self.model.shards, hot), self.model.shards)
        universe = np.uint64(self.levels[level - 1].offsets[-1])
        for s in np.flatnonzero(np.diff(cuts)):
            arrays = self._arrays(level, s)
            if arrays is None:
                continue
            # Nodes come sorted, so each context is looked up once for the run of its nodes.
            at = order[cuts[s] : cuts[s + 1]]
            begin = np.flatnonzero(np.concatenate([[True], first[at[1:]] != first[at[:-1]]]))
            size = np.diff(np.append(begin, len(at)))
            rank, known = arrays["contexts"].successor(first[at[begin]].astype(np.uint64))
            at, size, rank = at[np.repeat(known, size)], size[known], rank[known]
            if not len(at):
                continue
            if codes:
                gamma[at] = np.repeat(arrays["gamma"][rank], size)
            rank = np.repeat(rank, size)
            place, same = arrays["successors"].successor(rank.astype(np.uint64) * universe + last[at].astype(np.uint64))
            at, place = at[same], place[same]
            out[at] = place + offsets[s]
            if codes:
                code[at] = arrays["codes"][place]
        if codes and len(hot):
            at, spread = _among(first, hot)
            gamma[spread] = self.hot_gamma[level][at[spread]]
        return out, code, gamma

    def _stored(self, level: int, ids: np.ndarray, name: str) -> np.ndarray:
        out, offsets = np.zeros(len(ids), np.int64), self.levels[level].offsets
        order, cuts = _dealt(np.searchsorted(offsets, ids, "right") - 1, self.model.shards)
        for s in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[s] : cuts[s + 1]]
            out[at] = self._arrays(level, s)[name][ids[at] - offsets[s]]
        return out

    def counts(self, level: int, ids: np.ndarray) -> np.ndarray:
        return self._stored(level, ids, "counts")

    def codes(self, level: int, ids: np.ndarray) -> np.ndarray:
        """Quantised log probability of nodes."""
        return self._stored(level, ids, "codes") if level else self.word_codes(self.counts(0, ids))

    def word_codes(self, count: np.ndarray) -> np.ndarray:
        """The same of single words, from their counts (0 for unknown ones)."""
        return quantise((count + 1) / (self.model.total + self.model.vocabulary + 1)).astype(np.int64)

    def ends(self, w: Words, upto: int) -> np.ndarray:
        """Id of the n-gram of ``upto`` words that ends at each token, or -1."""
        ids, start = self.words(token_hashes(w))[0], token_starts(w)
        for level in range(1, upto):
            ids = self.longer(level, ids, start)[0]
        return ids

    def longer(self, level: int, below: np.ndarray, start: np.ndarray, codes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the ids of the n-grams that end at each token, those one word longer, as ``nodes`` has them.

        Where only the context is known, its weight is there; contexts end one token before."""
        out = np.full(len(below), -1, np.int64), np.zeros(len(below), np.int64), np.zeros(len(below), np.int64)
        # An unknown last part still needs the context's weight; its number is beyond all ids.
        at = np.flatnonzero((below[:-1] >= 0) & ~start[1:] & ((below[1:] >= 0) | codes)) + 1
        last = below[at]
        for whole, part in zip(out, self.nodes(level, below[at - 1], np.where(last >= 0, last, self.levels[level - 1].offsets[-1] - 1), codes)):
            whole[at] = part
        out[0][at[last < 0]] = -1
        return out


@lru_cache(maxsize=2)
def _reader(model: Model) -> Reader:
    return Reader(model)


def _dealt(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by shard, and the bounds of every shard in it (short numbers sort in linear time)."""
    shard = shard.astype(np.uint16) if shards <= 1 << 16 else shard
    return np.argsort(shard, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def _among(values: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in the sorted ``ids``, and whether it is there."""
    at = np.minimum(np.searchsorted(ids, values), max(0, len(ids) - 1))
    return at, ids[at] == values if len(ids) else np.zeros(len(values), bool)


def node_shard(first: np.ndarray, last: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    h = mix(first.astype(np.uint64), 3)
    if len(hot):
        spread = np.flatnonzero(_among(first.astype(np.int64), hot)[1])
        h[spread] = mix(h[spread], last[spread].astype(np.uint64))
    return (h >> np.uint64(40)).astype(np.int64) & (shards - 1)


def token_starts(w: Words) -> np.ndarray:
    out = np.zeros(len(w.doc) + w.rows, bool)
    out[w.first[:-1] + np.arange(w.rows)] = True
    return out


def token_hashes(w: Words) -> np.ndarray:
    """Hashes of all tokens: a text's words, then its end."""
    out = np.full(len(w.doc) + w.rows, END, np.uint64)
    out[np.arange(len(w.doc)) + w.doc] = w.hashes()
    return out


# --- counting ---------------------------------------------------------------------------


class _Counts:
    """Rows of one task, added up now and then; ``rows`` gives them packed for each shard."""

    def __init__(self, pairs: bool, shards: int) -> None:
        self.pairs, self.shards, self.held, self.size = pairs, shards, [], 0

    def add(self, a: np.ndarray, b: np.ndarray | None = None) -> bool:
        """True when it is time to send."""
        self.held.append((a, b, np.ones(len(a), np.int64)))
        self.size += len(a)
        if self.size >= HELD_ROWS:
            self._fold()
        return self.size >= HELD_ROWS // 2

    def _fold(self) -> None:
        a, b, v = zip(*self.held)
        self.held = [_merge(np.concatenate(a), np.concatenate(b) if self.pairs else None, np.concatenate(v))]
        self.size = len(self.held[0][0])

    def rows(self, shard_of: Callable) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        self._fold()
        a, b, v = self.held[0]
        order, cuts = _dealt(shard_of(a, b), self.shards)
        for s in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[s] : cuts[s + 1]]
            yield _part(0, s, blob=_pack(*((a[at], b[at], v[at]) if self.pairs else (a[at], v[at]))))
        self.held, self.size = [], 0


def _part(kind: int, shard: int, suffix: str | None = None, n: int = 0, total: int = 0, blob: bytes | None = None) -> pa.RecordBatch:
    return record(_PART_PA, kind=[kind], shard=[int(shard)], suffix=[suffix], n=[int(n)], total=[int(total)], blob=[blob])


def _by_shard(batches: Iterator[pa.RecordBatch], n_columns: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """All rows of each shard, columns put together; a task's rows come sorted by shard, so it holds one at a time."""

    def whole(blobs: list[bytes]) -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*(_unpack(b, n_columns) for b in blobs))]

    shard, blobs = None, []
    for batch in batches:
        for s, b in zip(column(batch, "shard").to_pylist(), column(batch, "blob").to_pylist()):
            if s != shard and blobs:
                yield shard, whole(blobs)
                blobs = []
            shard = s
            blobs.append(b)
    if blobs:
        yield shard, whole(blobs)


def _to_shards(packed: DataFrame, shards: int) -> DataFrame:
    parts = min(shards, MAX_PARTS)
    return packed.repartitionById(parts, F.col("shard") % F.lit(parts)).sortWithinPartitions("shard")


def _narrow(c: np.ndarray) -> np.ndarray:
    return c.astype(np.uint32 if int(c.max(initial=0)) < 1 << 32 else np.uint64)


def _frequent(c: np.ndarray, hot: int) -> bytes | None:
    at = np.flatnonzero(c >= hot)
    return _pack(at.astype(np.uint64)) if len(at) else None


def _count_words(docs: DataFrame, shards: int, out: str, hot: int) -> None:
    shift = np.uint64(64 - (shards.bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard_of = _Counts(False, shards), lambda a, _: (a >> shift).astype(np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                if held.add(token_hashes(Words(column(batch, "text"), lower=True))):
                    yield from held.rows(shard_of)
        yield from held.rows(shard_of)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, (h, c) in _by_shard(batches, 2):
            h, _, c = _merge(h, None, c.astype(np.int64))
            suffix = uuid.uuid4().hex[:8]
            save(f"{out}/shard-0-{s}-{suffix}", nested("words", encode(h - (np.uint64(s) << shift), 1 << int(shift), for_get=False)) | {"counts": _narrow(c)})
            yield _part(0, s, suffix, len(h), int(c.sum()), _frequent(c, hot))

    _to_shards(docs.select("text").mapInArrow(count, _PART), shards).mapInArrow(build, _PART).write.parquet(f"{out}/level-0")


def _count_nodes(docs: DataFrame, model: Model, last: bool, frequent: int) -> Model:
    """Add the next level; the last one needs no counts."""
    level, shards, out, spark = model.levels, model.shards, model.folder, docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = _reader(model), _Counts(True, shards)
        hot = reader.levels[-1].hot
        shard_of = lambda a, b: node_shard(a, b, shards, hot)
        for whole in batches:
            for batch in slices(whole, "text"):
                w = Words(column(batch, "text"), lower=True)
                ids, start = reader.ends(w, level), token_starts(w)
                at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & ~start[1:])
                if len(at) and held.add(ids[at].astype(np.uint64), ids[at + 1].astype(np.uint64)):
                    yield from held.rows(shard_of)
        yield from held.rows(shard_of)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for s, (a, b, c) in _by_shard(batches, 3):
            yield s, *_merge(a, b.astype(np.uint64), c.astype(np.int64))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = _reader(model).levels[-1].hot
        for s, a, b, c in add_up(batches):
            yield _part(0, s, n=len(a), blob=_pack(a, b, c))
            ids, n = np.unique(a[_among(a.astype(np.int64), hot)[1]], return_counts=True)
            if len(ids):
                yield _part(1, s, blob=_pack(ids, n))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in column(batch, "blob").to_pylist():
                ids, n = _unpack(blob, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(n.astype(np.int64))], names=["id", "n"])

    def build(rows: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        reader = _reader(model)
        hot, universe = reader.levels[-1].hot, int(reader.levels[-1].offsets[-1])
        if len(hot):
            t = _read(f"{out}/hot-{level}")
            spread_n = np.zeros(len(hot), np.int64)
            spread_n[np.searchsorted(hot, t["id"].to_numpy())] = t["n"].to_numpy()
        for s, a, b, c in rows:
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            size = np.diff(np.append(first, len(a)))
            context, n = a[first].astype(np.int64), size
            if len(hot):
                at, spread = _among(context, hot)
                n = np.where(spread, spread_n[at], size)
            count = reader.counts(level - 1, context)
            gamma = quantise(DISCOUNT * n / count)
            p = (c - DISCOUNT) / np.repeat(count, size) + np.repeat(restore(gamma), size) * restore(reader.codes(level - 1, b.astype(np.int64)))
            rank, suffix = np.repeat(np.arange(len(first), dtype=np.uint64), size), uuid.uuid4().hex[:8]
            save(
                f"{out}/shard-{level}-{s}-{suffix}",
                nested("contexts", encode(a[first], universe, for_get=False))
                | nested("successors", encode(rank * np.uint64(universe) + b, len(first) * universe, for_get=False))
                | {"codes": quantise(np.minimum(p, 1)), "gamma": gamma}
                | ({} if last else {"counts": _narrow(c)}),
            )
            yield _part(0, s, suffix, len(a), 0, None if last else _frequent(c, frequent))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s, *_unpack(b, 3)) for batch in batches for s, b in zip(column(batch, "shard").to_pylist(), column(batch, "blob").to_pylist()))
        yield from build(rows)

    counted, target = _to_shards(docs.select("text").mapInArrow(count, _PART), shards), f"{out}/level-{level}"
    if not model.spread[-1]:  # every context is whole in its shard
        counted.mapInArrow(lambda batches: build(add_up(batches)), _PART).write.parquet(target)
    else:  # the successors of contexts that are spread are counted over all shards first
        raw = f"{out}/raw-{level}"
        parts = written(counted.mapInArrow(collect, _PART), raw)
        parts.filter("kind = 1").select("blob").mapInArrow(partial, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).write.parquet(f"{out}/hot-{level}")
        parts.filter("kind = 0").select("shard", "blob").mapInArrow(unpacked, _PART).write.parquet(target)
        remove(spark, raw)
    spread = bool(spark.read.parquet(target).filter("blob is not null").head(1))
    return replace(model, levels=level + 1, spread=(*model.spread, spread))


def train(docs: DataFrame, order: int = ORDER, shard_text: int = SHARD_TEXT, hot: int = HOT) -> Model:
    """Count all of ``docs`` (column text) and write the model below the shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(2, (size // shard_text).bit_length())
    out = fresh_dir(spark, "lm")
    where, path = fs.FileSystem.from_uri(out)
    where.create_dir(path)
    _count_words(docs, shards, out, hot)
    level = spark.read.parquet(f"{out}/level-0")
    sums = level.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("blob").alias("hot")).first()
    model = Model(out, 1, shards, sums.total or 0, sums.n or 0, (sums.hot > 0,))
    for n in range(1, order):
        model = _count_nodes(docs, model, n == order - 1, hot)
    return model


# --- scoring ----------------------------------------------------------------------------


def score_words(w: Words, reader: Reader) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of every row."""
    model, start = reader.model, token_starts(w)
    ids, count = reader.words(token_hashes(w))
    known, code = ids >= 0, reader.word_codes(count)
    for level in range(1, model.levels):
        # From lower to higher order: the node itself, or the context's weight on what is there.
        ids, stored, gamma = reader.longer(level, ids, start, codes=True)
        code = np.where(ids >= 0, stored, code + gamma)
    first = np.flatnonzero(start)
    add = (lambda v: np.add.reduceat(v, first)) if w.rows else (lambda v: np.zeros(0))
    base = np.log10((count + 1) / (model.total + model.vocabulary + 1))
    return {"n_tokens": w.counts + 1, "n_known": add(known.astype(np.int64)), "base_score": add(base), "score": -LOWEST / 65535 * add(code)}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(model)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = score_words(Words(column(batch, "text"), lower=True), reader)
                yield record(out, doc_id=column(batch, "doc_id").cast(pa.int64()), train_tokens=np.full(batch.num_rows, model.total), **found)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = is_held_out("doc_id", 7, 2)
    found = score(docs, train(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_ngram_lm": op2_ngram_lm}
SQL: dict[str, str] = {}
