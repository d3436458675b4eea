"""Fill-in-middle against a plain reimplementation."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from motionweave.llm import automaton, fim


def plain(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(out), sha(text))


def rows(df):
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("folder", ["small", "odd", "empty"])
def test_query_equals_plain(spark, folder, request):
    path = request.getfixturevalue(folder)
    docs = pd.read_parquet(f"{path}/documents.parquet").astype({"doc_id": object})
    want = [plain(None if pd.isna(i) else int(i), t) for i, t in zip(docs["doc_id"], docs["text"])]
    assert rows(fim.op11_fim(spark, path)) == sorted(want, key=repr)


def test_giant_texts_in_small_chunks(spark):
    """Chunks of a few bytes: markers, letters and wide characters lie across their borders."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB<PSM> .é漢😀\n") for _ in range(rng.randrange(0, 300))) for _ in range(60)]
    texts += ["a" * 500, "<" * 40, "x" * 30 + "<P>" + "y" * 30, "x" * 33 + "<P" + "y" * 30, "long word " * 60, "", None]
    data = [(None if k % 17 == 0 else k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (5, texts[6]), (900, texts[6])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    done = fim.transform(docs, giant=20, chunk=7)
    assert done.filter("form = 'plain' or text = ''").filter("output != text").count() == 0
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, hashlib.sha256(r.output.encode()).hexdigest(), hashlib.sha256(r.back.encode()).hexdigest()) for r in done.withColumn("back", fim.restore("output", "form")).collect()]
    assert sorted(got, key=repr) == sorted((plain(*r) for r in data), key=repr)


def test_functions_compose_as_runs():
    """A scan of parts, composed, equals a step-by-step run from every state."""
    m, rng = fim.machine(), random.Random(4)
    for _ in range(50):
        raw = np.frombuffer("".join(rng.choice("ab<PSM> .é漢") for _ in range(rng.randrange(0, 700))).encode(), np.uint8)
        cut = sorted(rng.randrange(len(raw) + 1) for _ in range(3))
        offsets = np.array([0, *cut, len(raw)])
        s = automaton.scan(m, raw, offsets)
        totals = automaton.totals(m, s)
        for start in range(m.states):
            f, count, state = 0, 0, start
            for k in range(len(offsets) - 1):
                count += totals[k, m.maps[f, start]]
                f = m.compose[f, s.function[k]]
            want = 0
            for c in m.classes[raw]:
                want += m.emit[state, c]
                state = m.step[state, c]
            assert (count, m.maps[f, start]) == (want, state)


def test_padding_must_be_neutral():
    m = fim.machine()
    with pytest.raises(ValueError):
        automaton.Automaton(m.classes, m.step[:, ::-1], m.emit[:, ::-1])
