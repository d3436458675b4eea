"""Packing against the tokenizer itself and a bin-by-bin reimplementation."""

import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from motionweave.llm import packing
from motionweave.llm.common import materialise

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


def bin_by_bin(sizes, capacity):
    """One bin at a time: greedy, then the smallest against the best pair."""
    left, bins = sorted(sizes), []
    while left:
        bin_, room = [], capacity
        while (fits := [s for s in left if s <= room]):
            s = fits[-1]
            left.remove(s)
            bin_.append(s)
            room -= s
        low = min(bin_)
        if room and len(bin_) > 1:
            pairs = [(x + y, x, y) for k, x in enumerate(left) for y in left[:k] if low < x + y <= room + low]
            if pairs:
                _, x, y = max(pairs)
                bin_.remove(low)
                left.append(low)
                for s in (x, y):
                    left.remove(s)
                    bin_.append(s)
                left.sort()
        bins.append(sorted(bin_))
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_is_bin_by_bin(sizes):
    counts = np.bincount(np.array(sizes, int), minlength=31)
    plan = packing.best_two_fit(counts)
    got = [sorted(s for s, k in p.items() for _ in range(k)) for p, bins in plan for _ in range(bins)]
    assert got == bin_by_bin(sizes, 30)


def test_plan_of_many_pieces_is_short_and_tight():
    rng = np.random.default_rng(5)
    counts = np.bincount(np.minimum(rng.lognormal(5.5, 0.9, 2_000_000).astype(int) + 1, 2048), minlength=2049)
    plan = packing.best_two_fit(counts)
    bins, least = sum(b for _, b in plan), -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert sum(k * b for p, b in plan for k in p.values()) == counts.sum()
    assert len(plan) < 8192 and bins <= least * 1.001 + 1


def test_words_give_the_ids_of_whole_texts(tokenizer):
    rng, encode = random.Random(6), packing.Encoder(FILE, 0)
    signs = list("ab'sé漢 \t\n\r  ́İΣσ0½.,!<|>") + ["don't", "<|endoftext|>", "é", "\x1c", " ", "  "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(4000)] + ["", None, "y" * 3000]
    ids, first = encode(texts)
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("folder", ["small", "odd", "empty"])
def test_query(spark, folder, request, tokenizer):
    path = request.getfixturevalue(folder)
    got = packing.op12_best_fit(spark, path).toPandas()
    docs = pd.read_parquet(f"{path}/documents.parquet")
    want = []
    for i, t in zip(docs["doc_id"], docs["text"]):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want.append((str(None if pd.isna(i) else int(i)), p, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    have = [(str(None if pd.isna(r.doc_id) else int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(have) == sorted(want)
    for _, bin_ in got.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert bin_["offset"].tolist() == [0, *bin_["length"].cumsum().tolist()[:-1]] and bin_["length"].sum() <= 2048
    assert got["sequence_id"].nunique() == len(bin_by_bin([w[3] for w in want], 2048))


def test_sequences_hold_the_ids(spark, tokenizer):
    """Real output: ids of sequences of 16 tokens, over many tasks and with one length on most rows."""
    rng = random.Random(9)
    texts = ["river stone light"] * 150 + [" ".join(rng.choice(["river", "stone", "unbelievable", "x9"]) for _ in range(rng.randrange(40))) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    placed = materialise(packing.place(materialise(packing.cut(docs, FILE, 16), "p"), 16), "q")
    rows, bins = placed.collect(), {r.sequence_id: r.ids for r in packing.sequences(placed).collect()}
    found = {}
    for r in rows:
        assert bins[r.sequence_id][r.offset : r.offset + r.length] == r.ids
        found.setdefault(r.doc_id, []).append((r.piece, r.ids))
    for k, t in enumerate(texts):
        assert sum((ids for _, ids in sorted(found[k])), []) == tokenizer.encode(t, add_special_tokens=False).ids + [0]
    assert sum(map(len, bins.values())) == sum(r.length for r in rows) and max(map(len, bins.values())) <= 16


def test_words_are_found_in_the_buffer():
    """Words of a slice with nulls and empty texts: each once, marks off letters, capitals kept where something composes."""
    texts = pa.array(["skipped", "Two  words, and\nmore. 3, x;y É, end.", None, "", "Ω Big, İx", " , a", ", b"], pa.string())[1:]
    words, number, size = packing.words_of(texts)
    assert len(set(words)) == len(words) and size.tolist() == [10, 0, 0, 4, 2, 2]
    assert [words[k] for k in number] == ["two", "words", ",", "and", "more", ".", "3,", "x;y", "É,", "end.", "Ω", "Big", ",", "İx", ",", "a", ",", "b"]
