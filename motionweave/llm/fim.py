"""Fill-in-middle: texts cut at two token boundaries and put in prefix-suffix-middle order.

Tokens are runs of ASCII letters and single other characters.  One automaton over UTF-8 bytes
says where they begin and whether a marker occurs (``automaton.scan``), so chunks are scanned
without what is before them:

* Texts of up to ``giant`` bytes are scanned whole, many at a time, in the task that reads them.
* A longer text is cut into chunks that Spark deals over tasks, each distinct text once.  A
  chunk gives its transition function and its counts for every entry state; composing them
  gives the entry state of each chunk and the tokens before it; a cut is then looked for in
  the one chunk that holds it.

``transform`` keeps the texts and adds n (tokens), form, prefix_chars, middle_chars and output;
``restore`` rebuilds the text from output and form alone.  Chance comes from the id: units are
the 8-digit groups of the hex SHA-256 of ``1:`` and the decimal id, so a null id (empty text
there) draws like any other and equal ids draw alike.  Null and empty texts are plain and
empty; repeated rows get equal results; an empty table gives none; other columns are not read
and may have any name.

A giant text's chunk summaries meet in one task: a value of Spark has at most 2 GB, so they
are at most 32,768 rows of 80 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionweave.llm import automaton
from motionweave.llm.common import column, materialise, record, slices, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes above which a text is scanned in chunks of ``CHUNK`` bytes by several tasks.
GIANT = CHUNK = 1 << 16
#: Bytes of chunks a scanning task should get.
TASK_BYTES = 1 << 24
#: Of 100: texts that stay plain, and how many of the others have the suffix first.
PLAIN, SPM = 10, 20
_OTHER, _LETTER, _OPEN, _NAME, _FOUND, _FOUND_LETTER = range(6)


@cache
def machine() -> automaton.Automaton:
    """States: after another character, a letter, ``<``, ``<`` and a marker's letter; the first two once more after a marker."""
    classes = np.full(256, 4, np.uint8)
    classes[[*range(65, 91), *range(97, 123)]] = 0
    classes[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = 1
    classes[ord("<")], classes[ord(">")] = 2, 3
    classes[128:192] = 5  # later bytes of a character, and padding
    plain = [[_LETTER, _LETTER, _OPEN, _OTHER, _OTHER, s] for s in (_OTHER, _LETTER, _OPEN, _NAME)]
    plain[_OPEN][1], plain[_NAME][3] = _NAME, _FOUND
    step = np.array([*plain, *[[_FOUND_LETTER, _FOUND_LETTER, _FOUND, _FOUND, _FOUND, s] for s in (_FOUND, _FOUND_LETTER)]])
    emit = np.array([[s not in (_LETTER, _NAME, _FOUND_LETTER)] * 2 + [True] * 3 + [False] for s in range(6)]).astype(np.int64)
    return automaton.Automaton(classes, step, emit)


def _buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column and where its values begin (nulls are empty)."""
    col = col.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[: offsets[-1]], offsets


def _chars(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters before every byte from the first offset on, and all of them."""
    return np.concatenate([[0], np.cumsum((data[offsets[0] : offsets[-1]] & 0xC0) != 0x80)])


def draws(doc_id: Column) -> dict[str, Column]:
    """h1 to h4: the first four 8-digit groups of the id's digest."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return {f"h{k + 1}": F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)}


def _cut_small(docs: DataFrame, id_type: str) -> DataFrame:
    """n, marked, prefix_chars and middle_chars of texts that are scanned whole."""
    out = pa.schema([("text", pa.string()), ("n", pa.int64()), ("marked", pa.bool_()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine()
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = _buffer(column(batch, "text"))
                rows, start = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                s = automaton.scan(m, data, offsets)
                n = automaton.totals(m, s)[:, 0]
                h1, h2 = (column(batch, h).to_numpy() % (n + 1) for h in ("h1", "h2"))
                chars, begin = _chars(data, offsets), offsets[:-1] - offsets[0]
                a, b = (chars[begin + automaton.select(m, s, rows, start, k)] - chars[begin] for k in (np.minimum(h1, h2), np.maximum(h1, h2)))
                marked = m.maps[s.function, 0] >= _FOUND
                yield record(pa.schema([batch.schema.field("_id"), *out]), _id=column(batch, "_id"), text=column(batch, "text"), n=n, marked=marked, prefix_chars=a, middle_chars=b - a)

    return docs.select("_id", "text", "h1", "h2").mapInArrow(run, f"_id {id_type}, text string, n long, marked boolean, prefix_chars long, middle_chars long")


def chunked(texts: DataFrame, size: int = CHUNK) -> DataFrame:
    """key, chunk, data: the UTF-8 of every text in pieces of ``size`` bytes or a few less, at characters."""
    out = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                for key, text in zip(column(batch, "key").to_pylist(), column(batch, "text").cast(pa.large_binary())):
                    raw, at, k = text.as_buffer(), 0, 0
                    view = memoryview(raw)
                    while at < len(view):
                        stop = min(at + size, len(view))
                        while stop < len(view) and view[stop] & 0xC0 == 0x80:
                            stop -= 1
                        yield record(out, key=[key], chunk=[k], data=[bytes(view[at:stop])])
                        at, k = stop, k + 1

    return texts.select("key", "text").mapInArrow(run, "key string, chunk long, data binary")


def scan_chunks(chunks: DataFrame) -> DataFrame:
    """key, chunk, function, counts (of every entry state) and chars of every chunk."""
    out = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("function", pa.int64()), ("counts", pa.list_(pa.int64())), ("chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine()
        for whole in batches:
            for batch in slices(whole, "data"):
                data, offsets = _buffer(column(batch, "data"))
                s, chars = automaton.scan(m, data, offsets), _chars(data, offsets)
                at = offsets - offsets[0]
                yield record(out, key=column(batch, "key"), chunk=column(batch, "chunk"), function=s.function, counts=automaton.totals(m, s).tolist(), chars=chars[at[1:]] - chars[at[:-1]])

    return chunks.mapInArrow(run, "key string, chunk long, function long, counts array<bigint>, chars long")


def directory(scans: DataFrame) -> DataFrame:
    """One row per text: n, marked, and per chunk its entry state and the tokens and characters before it."""
    out = pa.schema([("key", pa.string()), ("n", pa.int64()), ("all_chars", pa.int64()), ("marked", pa.bool_()), *[(c, pa.list_(pa.int64())) for c in ("entry", "tokens", "chars")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine()
        t = pa.Table.from_batches(list(batches)).sort_by("chunk")
        state, n, chars = 0, 0, 0
        entry, tokens, before = [], [], []
        for f, counts, c in zip(t["function"].to_pylist(), t["counts"].to_pylist(), t["chars"].to_pylist()):
            entry.append(state)
            tokens.append(n)
            before.append(chars)
            n, chars, state = n + counts[state], chars + c, int(m.maps[f, state])
        yield record(out, key=[t["key"][0].as_py()], n=[n], all_chars=[chars], marked=[state >= _FOUND], entry=[entry], tokens=[tokens], chars=[before])

    schema = "key string, n long, all_chars long, marked boolean, entry array<bigint>, tokens array<bigint>, chars array<bigint>"
    return scans.groupBy("key").applyInArrow(run, schema)


def select_cuts(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """key, token, at: characters before the token, for rows (key, token, chunk, entry, local token, chars before the chunk)."""
    out = pa.schema([("key", pa.string()), ("token", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine()
        for whole in batches:
            for batch in slices(whole, "data"):
                data, offsets = _buffer(column(batch, "data"))
                s, chars = automaton.scan(m, data, offsets), _chars(data, offsets)
                begin = offsets[:-1] - offsets[0]
                at = automaton.select(m, s, np.arange(batch.num_rows), column(batch, "entry").to_numpy(), column(batch, "local").to_numpy())
                yield record(out, key=column(batch, "key"), token=column(batch, "token"), at=chars[begin + at] - chars[begin] + column(batch, "before").to_numpy())

    return wanted.join(chunks, ["key", "chunk"]).select("key", "token", "entry", "local", "before", "data").mapInArrow(run, "key string, token long, at long")


def _cut_giant(docs: DataFrame, size: int) -> DataFrame:
    """The same as ``_cut_small`` for giant texts, by chunks that Spark deals out."""
    keyed = docs.withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    chunks = materialise(chunked(keyed.select("key", "text").dropDuplicates(["key"]), size), "fim-chunks")
    tasks = max(1, -(-int(chunks.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // TASK_BYTES))
    texts = materialise(directory(scan_chunks(chunks.repartition(tasks, "key", "chunk"))), "fim-directory")
    units = F.struct(F.least(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)).alias("a"), F.greatest(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)).alias("b"))
    ids = keyed.select("_id", "key", "h1", "h2").distinct().join(texts.select("key", "n", "marked", "all_chars"), "key").withColumn("u", units)
    asked = ids.select("key", "n", F.explode(F.array("u.a", "u.b")).alias("token")).filter("token < n").select("key", "token").distinct()
    held = F.size(F.filter("tokens", lambda t: t <= F.col("token"))) - 1  # empty chunks do not occur, and ones without a token come before
    at = asked.join(texts.select("key", "tokens", "entry", "chars"), "key").withColumn("c", held)
    wanted = at.select("key", "token", F.col("c").cast("long").alias("chunk"), F.col("entry")[F.col("c")].alias("entry"), (F.col("token") - F.col("tokens")[F.col("c")]).alias("local"), F.col("chars")[F.col("c")].alias("before"))
    cuts = materialise(select_cuts(wanted, chunks), "fim-cuts")
    a, b = (cuts.select("key", F.col("token").alias(x), F.col("at").alias(f"at_{x}")) for x in "ab")
    found = ids.select("_id", "key", "n", "marked", "all_chars", "u.a", "u.b").join(a, ["key", "a"], "left").join(b, ["key", "b"], "left")
    first, second = F.coalesce("at_a", "all_chars"), F.coalesce("at_b", "all_chars")
    row = F.sha2(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("-")), F.lit(":"), F.col("key")), 256)
    found = found.select(row.alias("row"), "n", "marked", first.alias("prefix_chars"), (second - first).alias("middle_chars"))
    return keyed.withColumn("row", row).select("_id", "text", "row").join(found, "row").select("_id", "text", "n", "marked", "prefix_chars", "middle_chars")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """id, text, n, form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumns(draws(F.col("_id")))
    long = F.octet_length("text") > giant
    cut = _cut_small(rows.filter(~long), id_type).unionByName(_cut_giant(rows.filter(long), chunk))
    h = draws(F.col("_id"))
    plain = (F.col("text") == "") | F.col("marked") | (h["h3"] % 100 >= 100 - PLAIN)
    form = F.when(plain, "plain").when(h["h4"] % 100 < SPM, "spm").otherwise("psm")
    p, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle, suffix = F.substring("text", 1, p), F.substring("text", p + 1, m), F.substring("text", p + m + 1, F.char_length("text"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    cut = cut.withColumn("form", form).withColumn("output", output.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))
    known = {c: F.when(F.col("form") != "plain", F.col(c)) for c in ("prefix_chars", "middle_chars")}
    return cut.withColumns(known).select(F.col("_id").alias(id_col), "text", "n", "form", "prefix_chars", "middle_chars", "output")


def restore(output: str | Column, form: str | Column) -> Column:
    """The text that became ``output``; its markers are the only ones there."""
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    size, third = F.char_length(out), F.instr(out, MIDDLE)

    def parts(marker: str) -> tuple[Column, Column]:
        at = F.instr(out, marker)
        return F.substring(out, 4, at - 4), F.substring(out, at + 3, third - at - 3)

    middle, (prefix, suffix), (last, first) = F.substring(out, third + 3, size), parts(SUFFIX), parts(PREFIX)
    return F.when(form == "plain", out).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(first, middle, last))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore("output", "form")).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_fim": op11_fim}
SQL: dict[str, str] = {}
