import random

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
WORDS = {
    "en": "the of and in that with was for river stone light garden morning winter letter window".split(),
    "de": "der die und das nicht mit für fluß stein licht garten morgen winter brief fenster straße".split(),
    "fr": "le la et les des pour être rivière pierre lumière jardin matin hiver lettre fenêtre été".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def write(folder, name, schema, rows):
    pq.write_table(pa.table({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)}, schema=schema), f"{folder}/{name}.parquet")


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    """A folder of small tables with ordinary rows."""
    rng, folder = random.Random(7), tmp_path_factory.mktemp("small")
    docs = []
    for k in range(240):
        lang = ("en", "de", "fr")[k % 3]
        text = ". ".join(sentence(rng, lang, rng.randrange(8, 30)).capitalize() for _ in range(rng.randrange(2, 8)))
        if k % 6 == 5:
            text = " ".join(w.upper() + "###" for w in text.split())
        docs.append((k, text, lang, f"s{k % 5}", len(text)))
    bench = [(k, sentence(rng, "en", 20 + k) + f" unique{k}") for k in range(6)]
    docs.append((240, docs[0][1], "en", "s0", docs[0][4]))
    words = docs[3][1].split()
    docs.append((241, " ".join(words[:-1] + ["other"]), "en", "s1", 1))
    docs.append((242, docs[6][1] + " " + bench[2][1] + " " + docs[9][1], "en", "s1", 1))
    write(folder, "documents", DOCS, docs)
    write(folder, "labels", pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]), [(k, int(k % 6 != 5), 0) for k in range(240) if k % 4 != 1])
    write(folder, "benchmark", pa.schema([("item_id", pa.int64()), ("text", pa.string())]), bench)
    body = "<html><body><nav><a href='/'>home</a></nav><article><h1>T {0}</h1><p>{1}<p>{1}</article><footer>foot</footer></body></html>"
    pages = [(k, f"http://h{k % 3}.example.org/{k}", body.format(k, sentence(rng, "en", 40))) for k in range(30)] + [(30, "http://h0.example.org/30", None), (31, None, "a &amp; b")]
    pages += [(40 + k, "http://h1.example.org/x", pages[k][2]) for k in range(4)]
    write(folder, "pages", pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]), pages)
    return str(folder)


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rng, folder = random.Random(8), tmp_path_factory.mktemp("odd")
    extra = [pa.field(c, pa.string()) for c in ("score", "held_out", "lang_pred", "kept", "fp", "features", "trusted", "rank", "ids", "grp", "bucket", "rows", "n", "root", "node", "a", "b", "host", "path")]
    long = " ".join(sentence(rng, "en", 1000) + f" w{k}" for k in range(60))
    texts = [None, "", " \n\t ", "x", "..", "É", long, "y" * 200_000, "a b c d", "a b c d", None, "\x00 zero", "ab\n\nab\nab", "😀 emoji 漢字 text", "start" + " " * 1_000_000 + "end" + "\n" * 700_000, sentence(rng, "de", 50), sentence(rng, "fr", 50)]
    rows = [(k, t, (None, "en", "de")[k % 3], None if k % 4 == 0 else "s", None) for k, t in enumerate(texts)]
    rows += [rows[6], rows[8], rows[8], (None, "no id here at all", None, None, None), (None, None, None, None, None)]
    write(folder, "documents", pa.schema([*DOCS, *extra]), [r + tuple("clash" for _ in extra) for r in rows])
    write(folder, "labels", pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32()), ("text", pa.string())]), [(1, 1, 0, "z"), (1, 0, 0, "z"), (None, 1, 0, "z"), (6, None, None, None), (14, 1, 0, None), (14, 1, 0, None)])
    write(folder, "benchmark", pa.schema([("item_id", pa.int64()), ("text", pa.string()), ("doc_id", pa.string())]), [(1, None, "q"), (2, "", "q"), (None, "a b", "q"), (3, "one two three four five six", "q"), (3, "one two three four five six", "q")])
    pages = [(1, None, None), (2, "", ""), (3, "not a url", "<p"), (4, "http://h.example/", "<!-- open"), (None, "http://h.example/", "x" * 200), (5, "http://h.example/", "x" * 200), (5, "http://h.example/", "x" * 200), (6, "http://H.example/", "<div>" * 3000 + "deep"), (7, "http://h.example/\r\nX: y", "<script>never closed")]
    write(folder, "pages", pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("host", pa.string()), ("path", pa.string())]), [p + ("clash", "clash") for p in pages])
    return str(folder)


@pytest.fixture(scope="session")
def empty(tmp_path_factory, odd):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "benchmark", "pages"):
        t = pq.read_table(f"{odd}/{name}.parquet")
        pq.write_table(t.slice(0, 0), f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def documents(small):
    return pd.read_parquet(f"{small}/documents.parquet")
