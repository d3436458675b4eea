"""The pipeline's stages on small, odd and empty tables."""

import random

import pandas as pd
import pytest

import corpus_pipeline
from motionweave.llm import simhash
from motionweave.llm.common import materialise, table
from tests.llm.test_contracts import fingerprint


def walk(spark, folder):
    docs, kept = table(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        out = materialise(stage(spark, docs, folder), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = out
        kept.append([r.doc_id for r in out.collect()])
    return kept


def test_small(spark, small):
    language, quality, dedup, clean, last = walk(spark, small)
    every = set(pd.read_parquet(f"{small}/documents.parquet").doc_id)
    assert set(language) == every
    assert len(quality) > 0.7 * len(language) and set(quality) <= set(language)
    assert 240 not in dedup and 0 in dedup and len(dedup) == len(set(dedup))
    assert 242 not in clean and len(clean) >= len(dedup) - 3
    assert sorted(last) == sorted(clean)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, small).collect()) == sorted(last)


def survivors(rows):
    """Brute force: of each component of fingerprints, the row of the smallest id."""
    fps = [fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    return fps, label


def test_near_dedup_loses_no_text(spark):
    texts = [f"{w} one two three four five six seven eight {w} nine ten" for w in "ABCD"]
    a, b, c, d = texts
    rows = [(1, a), (5, a), (5, b), (7, c), (7, d), (None, "a text without an id that occurs nowhere else"), (None, d)]
    got = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", a), ("5", b), ("7", c), ("7", d), ("None", rows[5][1])])
    rng = random.Random(2)
    words = "river stone light garden morning winter letter window street paper".split()
    base = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    rows = []
    for _ in range(150):
        w = rng.choice(base).split()
        if rng.random() < 0.5:
            w[rng.randrange(60)] = rng.choice(words)
        rows.append((rng.choice([None, *range(30)]), " ".join(w) if rng.random() < 0.95 else None))
    got = [(r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    fps, label = survivors(rows)
    big = lambda i: float("inf") if i is None else i
    want = {x: min((big(rows[k][0]), (fps[k] ^ 1 << 63) - (1 << 63)) for k in range(len(rows)) if label[k] == x) for x in set(label)}
    assert len(got) == len(want)
    assert sorted((big(i), fingerprint(t)) for i, t in got) == sorted((i, f % (1 << 64)) for i, f in want.values())


def test_odd(spark, odd):
    language, quality, dedup, clean, last = walk(spark, odd)
    assert 0 not in language and 1 not in language and 4 not in language
    assert len([k for k in dedup if k is not None]) == len({k for k in dedup if k is not None})
    assert len(last) == len(clean)


def test_empty(spark, empty):
    assert walk(spark, empty) == [[], [], [], [], []]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_keeps_rows_whole(spark, small, name):
    docs = table(spark, small, "documents")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, small)
    before = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in before for r in out.collect())
