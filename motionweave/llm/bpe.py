"""Byte-level BPE encoding and decoding with a local tiktoken rank file.

``encode`` turns texts into token ids, ``decode`` turns ids back into raw bytes.
A text longer than ``PIECE`` characters is cut first.  The split pattern must match runs
of white space by its last two alternatives alone (``\\s+(?!\\S)|\\s+``), which is checked.
Then there are two kinds of safe cuts:

* A run of over ``RUN`` white-space characters: no match reaches into it from the left, and
  the pattern takes it as one match, less its last character if text follows (which then
  begins the next match).  That match is encoded by itself, without the pattern, since the
  library's matcher goes back over such a run with a stack that a million characters exceed.
* A single space between two word characters: no alternative reaches from a word character
  over white space, and none looks behind, so a match always ends before such a space.

So the pieces give the ids of the whole text, whatever its length and make-up.

Null texts count as empty (no tokens) and so do not fail; repeated rows get equal results;
an empty table gives no rows; only the id and text columns are read, so others may have any
name.  Ids may be null.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from motionweave.llm.common import column, record, slices, table

PIECE, RUN = 1 << 16, 1 << 12
_SAFE = re.compile(r"(?<=\w) (?=\w)")
_WHITE_TAIL = r"|\s+(?!\S)|\s+"
#: White space as the library's patterns have it (Unicode White_Space).
_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; kept for the life of a Python worker."""
    head = pattern.removesuffix(_WHITE_TAIL)
    if head == pattern or r"\s" in head.replace(r"[^\s", "["):
        raise ValueError("the split pattern must match white space by its last two alternatives only")
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """Cut ``text`` at safe spaces into pieces of ``limit`` characters or a little more."""
    start = 0
    while len(text) - start > limit:
        m = _SAFE.search(text, start + limit)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def parts(text: str, run: int = RUN) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one match of the pattern): long runs of white space, and what is between them."""
    start = 0
    for m in re.finditer(f"{_WHITE}{{{run + 1},}}", text):
        stop = m.end() if m.end() == len(text) else m.end() - 1
        yield text[start : m.start()], False
        yield text[m.start() : stop], True
        start = stop
    yield text[start:], False


def encode_text(text: str, enc: tiktoken.Encoding) -> list[int]:
    """Ids of a text of any length."""
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part, single in parts(text):
        if single:
            ids += enc._encode_single_piece(part.encode())
        else:
            for piece in safe_pieces(part):
                ids += enc.encode_ordinary(piece)
    return ids


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``ids`` (array of int); null text: no ids."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for whole in batches:
            for batch in slices(whole, text_col):
                ids = [encode_text(t or "", enc) for t in column(batch, text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([column(batch, id_col), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, ids array<int>")


def decode(tokens: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document: its id and ``bytes``, the raw bytes of its ids."""
    id_type = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            raw = [enc.decode_bytes(ids or []) for ids in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, id_col), pa.array(raw, pa.binary())], names=[id_col, "bytes"])

    return tokens.select(id_col, "ids").mapInArrow(run, f"{id_col} {id_type}, bytes binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Encode, then decode, every text in one pass over the data.

    Returns doc_id, n_tokens, ids_sha256 (decimal ids joined by one space) and
    decoded_sha256.  The ids of a document never leave its batch, so nothing is
    shuffled and memory is bounded by a batch; a text that repeats within a batch is
    encoded once.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        decimal = [str(i) for i in range(enc.n_vocab)]
        for whole in batches:
            for batch in slices(whole, "text"):
                seen: dict[str, tuple[int, str, str]] = {}
                rows = []
                for text in column(batch, "text").to_pylist():
                    text = text or ""
                    row = seen.get(text)
                    if row is None:
                        ids = encode_text(text, enc)
                        row = seen[text] = (
                            len(ids),
                            hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest(),
                            hashlib.sha256(enc.decode_bytes(ids)).hexdigest(),
                        )
                    rows.append(row)
                n, a, b = zip(*rows)
                yield record(out, doc_id=column(batch, "doc_id").cast(pa.int64()), n_tokens=n, ids_sha256=a, decoded_sha256=b)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_byte_bpe": op9_byte_bpe}
SQL: dict[str, str] = {}
