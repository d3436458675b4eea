"""The manifest against a plain tree."""

import hashlib
import random
import zlib

import pandas as pd
import pytest

from motionweave.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(v):
    s = None if v is None else str(v)
    return "-" if s is None else f"{len(s.encode())}:{s}"


def tree(leaves):
    """Root, and every leaf's siblings per level as (left, right)."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i // 8 * 8
            steps[k].append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], steps


def plain(rows):
    """Rows of FIELDS -> the query's rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, h(*map(value, r))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[g] = tree([leaf for _, leaf in groups[g]])
    root, tops = tree([trees[g][0] for g in order]) if order else (None, [])
    out = []
    for g, top in zip(order, tops):
        for (r, leaf), steps in zip(groups[g], trees[g][1]):
            steps = steps + top
            bad = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                bad = h(*map(value, (*r[:4], low)))
            for left, right in steps:
                bad = h(left, bad, right)
            out.append((r[0], leaf, trees[g][0], root, h(*[a + b for a, b in steps]), bad, bad == root))
    return sorted(out, key=repr)


def rows_of(path):
    t = pd.read_parquet(f"{path}/documents.parquet")[FIELDS].astype(object)
    return [tuple(None if pd.isna(v) else int(v) if k in (0, 3) else v for k, v in enumerate(r)) for r in t.itertuples(index=False)]


@pytest.mark.parametrize("folder", ["small", "odd", "empty"])
def test_query_equals_plain(spark, folder, request):
    path = request.getfixturevalue(folder)
    got = [tuple(r) for r in merkle.op13_merkle(spark, path).collect()]
    assert sorted(got, key=repr) == plain(rows_of(path))


@pytest.mark.parametrize("height,part", [(1, 37), (2, 300)])
def test_ragged_parts(spark, height, part):
    """Several rounds of finishing, parts that split groups anywhere, one id on a third of the rows."""
    rng = random.Random(height)
    rows = [(5 if k % 3 == 0 else rng.randrange(3000), "s", "abc"[min(2, k % 7)], k % 11, f"T {rng.randrange(50)}") for k in range(2500)]
    rows += [(1, None, None, None, None), (2, "s", "zz", 1, "X"), *rows[:40]]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    leaves = docs.select(docs["lang"].alias("g"), "doc_id", "text", merkle.digest(*[docs[c] for c in FIELDS]).alias("leaf"))
    done = merkle.manifest(leaves, ["doc_id"], part, height).withColumn("folded", merkle.fold("leaf", "steps")).collect()
    want = plain(rows)
    assert {r.folded for r in done} == {r.root for r in done} == {want[0][3]}
    got = sorted((r.doc_id, r.leaf, r.subroot, h(*[s.left + s.right for s in r.steps])) for r in done)
    assert got == sorted((w[0], w[1], w[2], w[4]) for w in want)
    for g in {r.g for r in done}:
        assert sorted(r.position for r in done if r.g == g) == list(range(sum(r.g == g for r in done)))


@pytest.mark.parametrize("total", [1, 2, 7, 8, 9, 63, 64, 65, 513, 700])
def test_subtrees_and_finish(total):
    leaves = [h(str(k)) for k in range(total)]
    root, steps = tree(leaves)
    cuts = sorted({0, total, *[random.Random(total).randrange(total + 1) for _ in range(4)]})
    nodes = {}
    for a, b in zip(cuts, cuts[1:]):
        nodes |= {(level, i): d for level, i, d in merkle.ragged(merkle.subtrees(a, leaves[a:b], total, 9))}
    height = merkle._height(total)
    known, found = merkle.finish(nodes, height)
    assert known[height, 0] == root
    for (level, i), own in found.items():
        assert [(s["left"], s["right"]) for s in own] == steps[min(i * 8**level, total - 1)][level:]
