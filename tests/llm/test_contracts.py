"""Every query against a brute-force version of its contract on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash

from motionweave.llm import bpe, langid, ngram_lm, quality_rules, queries
from motionweave.llm.common import table
from motionweave.llm.tokens import Words
from tests.llm.conftest import write
from tests.llm.test_kernels import linear_ids
from tests.oracle import rows_of, spark_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def result(spark, name, folder):
    return pd.DataFrame([r.asDict() for r in queries.QUERIES[name](spark, folder).collect()])


def crc(i, m):
    return zlib.crc32(str(int(i)).encode()) % m


def lower(t):
    return t.encode().lower().decode()


@pytest.mark.parametrize("name", sorted(queries.SQL))
@pytest.mark.parametrize("where", ["small", "odd", "empty"])
def test_sql(spark, request, name, where):
    folder = request.getfixturevalue(where)
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(queries.SQL[name]).fetchall()
    columns = [d[0] for d in con.description]
    got = spark_rows(queries.QUERIES[name](spark, folder))
    if where == "odd" and name.startswith("op5"):
        # Rows that repeat the smallest id, and rows without an id, are as the docstring says.
        assert len(got[1]) == len(found)
    assert got == (sorted(columns), rows_of(columns, found))


class Smoothed:
    """Interpolated absolute discounting over all n-grams, by plain counters."""

    def __init__(self, texts, d=ngram_lm.DISCOUNT):
        self.c = Counter(w for t in texts for w in t)
        self.b = Counter(x for t in texts for x in zip(t, t[1:]))
        self.t = Counter(x for t in texts for x in zip(t, t[1:], t[2:]))
        self.after1, self.after2 = Counter(x for x, _ in self.b), Counter((x, y) for x, y, _ in self.t)
        self.n, self.v, self.d = sum(self.c.values()), len(self.c), d

    def p1(self, w):
        return (self.c.get(w, 0) + 1) / (self.n + self.v + 1)

    def p2(self, x, y):
        if not self.after1[x]:
            return self.p1(y)
        return max(self.b[x, y] - self.d, 0) / self.c[x] + self.d * self.after1[x] / self.c[x] * self.p1(y)

    def p3(self, x, y, z):
        if not self.after2[x, y]:
            return self.p2(y, z)
        return max(self.t[x, y, z] - self.d, 0) / self.b[x, y] + self.d * self.after2[x, y] / self.b[x, y] * self.p2(y, z)

    def score(self, w):
        return sum(math.log10(self.p1(x) if k == 0 else self.p2(w[0], x) if k == 1 else self.p3(w[k - 2], w[k - 1], x)) for k, x in enumerate(w))


def tokens_of(documents):
    return {i: WORD.findall(lower(t)) + ["</s>"] for i, t in zip(documents.doc_id, documents.text)}


def test_op2_is_the_smoothed_model(spark, small, documents):
    got = result(spark, "op2_ngram_lm", small).set_index("doc_id")
    toks = tokens_of(documents)
    m = Smoothed([toks[i] for i in toks if crc(i, 7) != 2])
    # A proper distribution: over all known words and the unknown one it sums to one.
    for h in [("the", "of"), ("der", "die"), ("never seen", "of")]:
        assert sum(m.p3(*h, w) for w in [*m.c, "never seen"]) == pytest.approx(1)
    for i, w in toks.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 7) == 2, len(w), sum(x in m.c for x in w), m.n)
        assert r.base_score == pytest.approx(sum(math.log10(m.p1(x)) for x in w), abs=1e-9)
        assert r.score == pytest.approx(m.score(w), abs=5e-4 * len(w))


def test_op2_spreads_frequent_contexts(spark, small, documents):
    docs = table(spark, small, "documents")
    model = ngram_lm.train(docs.filter("doc_id % 3 > 0"), shard_text=4000, hot=12)
    assert model.shards > 8 and model.spread[0] and model.spread[1] and not model.spread[2]
    toks = tokens_of(documents)
    m = Smoothed([w for i, w in toks.items() if i % 3])
    for r in ngram_lm.score(docs, model).collect():
        assert r.score == pytest.approx(m.score(toks[r.doc_id]), abs=5e-4 * len(toks[r.doc_id]))
    four = ngram_lm.train(docs.filter("doc_id % 3 > 0"), order=4)
    better = {r.doc_id: r.score for r in ngram_lm.score(docs, four).collect()}
    assert sum(better[i] for i in toks if i % 3) > sum(m.score(w) for i, w in toks.items() if i % 3)


def test_op3_finds_the_planted_passage(spark, small):
    got = result(spark, "op3_decontaminate", small)
    assert (242, 2) in set(zip(got.doc_id, got.item_id))
    assert (got.n_equal * 100 >= 80 * got.n_aligned).all()


def fingerprint(text):
    w = lower(text or "").encode().split()
    s = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("where", ["small", "odd"])
def test_op4_components(spark, request, where):
    folder = request.getfixturevalue(where)
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    got = result(spark, "op4_simhash", folder)
    fps = [fingerprint(t if isinstance(t, str) else "") for t in docs.text]
    ids = [None if pd.isna(i) else int(i) for i in docs.doc_id]
    label = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    want = []
    for k, fp in enumerate(fps):
        named = [ids[j] for j in range(len(fps)) if label[j] == label[k] and ids[j] is not None]
        want.append((str(ids[k]), f"{fp:016x}", str(min(named) if named else None)))
    as_id = lambda v: "None" if pd.isna(v) else str(int(v))
    assert sorted((as_id(r.doc_id), r.fingerprint, as_id(r.component_id)) for r in got.itertuples()) == sorted(want)


def test_op6_held_out_accuracy(spark, small, documents):
    got = result(spark, "op6_language", small).merge(documents[["doc_id", "lang"]], on="doc_id")
    assert (got.held_out == [crc(i, 4) == 2 for i in got.doc_id]).all()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_op7_held_out_accuracy(spark, small):
    labels = pd.read_parquet(f"{small}/labels.parquet")
    got = result(spark, "op7_quality_model", small).merge(labels, on="doc_id")
    held = got[got.held_out]
    assert (got.held_out == [crc(i, 3) == 1 for i in got.doc_id]).all()
    assert (held.predicted == held.quality).mean() > 0.95
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()


def base(text):
    t = text if isinstance(text, str) else ""
    w = WORD.findall(t)
    win = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {k + j for k in range(len(w) - 4) if win[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed


@pytest.mark.parametrize("where", ["small", "odd"])
def test_op8_base_counts(spark, request, where):
    folder = request.getfixturevalue(where)
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    got = result(spark, "op8_quality_rules", folder)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(base(t) for t in docs.text)
    assert not (got.kept & got.base_failed).any()
    if where == "small":
        assert got[got.doc_id % 6 != 5].kept[lambda k: ~got.base_failed].all()


def test_op8_keeps_clean_documents_of_a_thinly_labelled_language(spark, tmp_path):
    rng, rows = np.random.default_rng(5), []
    words = {
        "en": "the of and in that with was for river stone light garden morning winter letter window".split(),
        "de": "der die und das nicht mit für fluß stein licht garten morgen winter brief fenster straße".split(),
    }
    junk = "click here buy cheap now offer win cash prize deal".split()
    for k in range(900):
        lang, bad = "de" if k >= 700 else "en", k % 7 == 0
        text = " ".join(rng.choice(junk if bad else words[lang], 90))
        rows.append((k, text if not bad else " ".join([*words[lang], text]), lang, bad))
    pd.DataFrame([r[:3] for r in rows], columns=["doc_id", "text", "lang"]).to_parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(not bad)) for k, _, lang, bad in rows if k % 4 and (lang == "en" or k % 40 == 1)]
    pd.DataFrame(labels, columns=["doc_id", "quality"]).astype({"quality": "int32"}).to_parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in quality_rules.op8_quality_rules(spark, str(tmp_path)).collect()}
    clean = [k for k, _, _, bad in rows if not bad and not got[k].base_failed]
    assert sum(rows[k][2] == "de" for k in clean) > 100 and all(got[k].kept for k in clean)
    # Where there is evidence, the ratio still decides.
    junk = [k for k, _, lang, bad in rows if bad and lang == "en"]
    assert not any(got[k].kept for k in junk)
    # Score and verdict by plain counting, one text at a time, within op6's languages.
    docs, grams = table(spark, str(tmp_path), "documents"), {}
    model = langid.train(docs)
    for k, text, _, _ in rows:
        b = quality_rules.buckets(Words(pa.array([text])))[0].tolist()
        grams[k] = (model.predict([text])[0][0], b)
    good = {k for k, q in labels if q == 1}
    raw, target = {}, {}
    for k, (lang, b) in grams.items():
        raw.setdefault(lang, Counter()).update(b)
        target.setdefault(lang, Counter()).update(b if k in good else [])
    size = quality_rules.BUCKETS
    few = quality_rules.EVIDENCE

    def q(lang, x):
        return (raw[lang][x] + 1) / (sum(raw[lang].values()) + size)

    def expected(lang, x):
        return sum(target[lang].values()) * q(lang, x)

    def smoothed(lang, x):
        others = [k for k in raw if k != lang]
        prior = (sum(target[k][x] for k in others) + few) / (sum(expected(k, x) for k in others) + few)
        return (target[lang][x] + few * prior) / (expected(lang, x) + few)

    used = {x for _, b in grams.values() for x in b}
    # Buckets that no text has are not looked at one by one: they are alike in a language.
    other = next(x for x in range(size) if x not in used)
    norm = {lang: sum(q(lang, x) * smoothed(lang, x) for x in used) + (size - len(used)) * q(lang, other) * smoothed(lang, other) for lang in raw}
    seen = set()
    for k, (lang, b) in grams.items():

        def ratio(x):
            return round(1e6 * math.log(smoothed(lang, x) / norm[lang]))

        score = math.floor(sum(map(ratio, b)) / len(b))
        seen.add(score)
        assert abs(got[k].score * 1e6 - score) <= 1 and got[k].kept == (not got[k].base_failed and round(got[k].score * 1e6) >= quality_rules.THRESHOLD)
    assert 0 not in seen


def test_op8_ratios_of_languages_with_and_without_evidence():
    size = 8
    trusted, none = np.array([80, 40, 0, 0, 0, 0, 0, 0]), np.zeros(size)
    raw = np.array([80, 40, 60, 20, 0, 0, 0, 0])
    foreign = np.array([0, 0, 0, 0, 9, 9, 9, 9])
    rows = [(0, trusted, raw), (1, none, raw), (2, none, foreign)]
    r = quality_rules.smooth(lambda: iter(rows), 4, size)
    assert r[0][0] > 0 > r[0][2]
    # Without trusted documents of its own, a language takes the others' ratio of the words it shares.
    assert r[1][0] > 0 > r[1][2]
    # Words that only such a language has are neither good nor bad.
    q = (foreign + 1) / (foreign.sum() + size)
    assert abs((r[2] / 1e6 * q)[4:].sum()) < 0.15
    assert not r[3].any() and not quality_rules.smooth(lambda: iter([]), 1, size).any()


def test_op6_many_languages_share_buckets():
    assert langid.bucket_count(4) == langid.bucket_count(512) == 1 << 16 and langid.bucket_count(2000) == 1 << 14
    rng, texts = random.Random(3), []
    names = [f"l{k:03d}" for k in range(700)]
    for name in names:
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)]
        texts += [(name, " ".join(rng.choices(words, k=12))) for _ in range(4)]
    samples = []
    for name, text in texts:
        b, c = np.unique(np.concatenate([x for x, _ in langid.ngrams([text])]), return_counts=True)
        samples.append((name, b, c))
    model = langid.fit(samples, names)
    assert model.weights.shape == (1 << 15, 700)
    long = " ".join(t for n, t in texts[:4] for _ in range(9000))
    assert len(long) > 1 << 20 and model.predict([long, None])[0] == [names[0], "und"]


@pytest.mark.parametrize("where", ["small", "odd"])
def test_op9_round_trip(spark, request, where):
    folder = request.getfixturevalue(where)
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = result(spark, "op9_byte_bpe", folder)
    want = []
    for t in docs.text:
        t = t if isinstance(t, str) else ""
        ids = linear_ids(t, enc)
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(zip(got.n_tokens, got.ids_sha256, got.decoded_sha256)) == sorted(want)


def test_op9_encode_then_decode(spark, small, documents):
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, small, "documents"), *args)
    back = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(ids, *args).collect()}
    assert back == dict(zip(documents.doc_id, documents.text))


def test_op10_main_text(spark, small):
    got = result(spark, "op10_main_text", small).set_index("page_id")
    pages = pd.read_parquet(f"{small}/pages.parquet").set_index("page_id")
    for k in range(30):
        body = re.search(r"(?s)<article>(.*)</article>", pages.html[k])[1]
        assert got.text[k] == " ".join(re.sub(r"<[^>]+>", " ", body).split()) and got.n_chars[k] == len(got.text[k])
    assert got.text[30] == "" and got.text[31] == "a & b"


class _Divs(HTMLParser):
    """Text, running text and path of every element of a well-formed page of body, div, p and a."""

    def __init__(self, source):
        super().__init__()
        self.stack, self.nodes = [], []
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        up = self.stack[-1]["path"] + "/" if self.stack else ""
        node = {"path": up + tag + (f".{dict(attrs)['class']}" if attrs and "class" in dict(attrs) else ""), "all": 0, "run": 0, "out": [], "tag": tag}
        self.nodes.append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        running = self.stack[-1]["tag"] == "p" or (self.stack[-1]["tag"] == "div" and len(data) >= 25)
        for node in self.stack:
            node["all"] += len(data)
            node["run"] += len(data) if running else 0
            node["out"].append(data)


def test_op10_votes_of_a_host_with_several_templates(spark, tmp_path):
    rng, pages = random.Random(4), []

    def prose(n):
        return " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(n)) + "."

    links = " ".join(["home page"] * 40)
    for k in range(60):
        lead, text, talk = prose(8), prose(rng.randrange(60, 90)), prose(rng.choice([6, 6, 6, 6, 300]))
        if k % 2:
            html = f"<body><div class='bar'><a>{links}</a></div><div class='story'><div class='lead'>{lead}</div><div class='copy'><p>{text}</p></div></div><div class='extra'><p>{talk}</p></div></body>"
        else:
            html = f"<body><div class='shell'><div class='bar'><a>{links}</a></div><div class='copy'><p>{text}</p><p>{lead}</p></div></div><div class='extra'>{talk}</div></body>"
        pages.append((k, f"http://{'one' if k < 40 else 'two'}.example.org/{k}", html))
    pages += [(100 + k, "http://three.example.org/", f"<body><div class='copy'><p>{prose(40)}</p><div class='share-tip'>the very same tip on every page of it</div></div></body>") for k in range(3)]
    columns = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
    write(str(tmp_path), "pages", columns, pages)
    rates, parsed = {}, {}
    for k, url, html in pages:
        nodes = parsed[k] = _Divs(html.replace("<div class='share-tip'>the very same tip on every page of it</div>", "")).nodes
        total = nodes[0]["run"]
        for n in nodes:
            if n["tag"] in ("body", "div") and n["run"]:
                rates.setdefault((url.split("/")[2], n["path"]), []).append(2_000_000 * n["run"] // (total + n["all"]))
    got = result(spark, "op10_main_text", tmp_path).set_index("page_id")
    changed = 0
    for k, url, _ in pages:
        host, here = url.split("/")[2], [n for n in parsed[k] if (url.split("/")[2], n["path"]) in rates]
        rating = lambda n, host=host: -(sum(rates[host, n["path"]]) // len(rates[host, n["path"]]))
        best = min(here, key=rating)
        own = max(here, key=lambda n: 2 * n["run"] / (parsed[k][0]["run"] + n["all"]))
        changed += best["path"] != own["path"]
        assert got.text[k] == " ".join(" ".join(best["out"]).split())
    assert changed > 5


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd, name):
    rows = queries.QUERIES[name](spark, odd).collect()
    table = "pages" if name.startswith(("op5_", "op10_")) else "documents"
    if name != "op3_decontaminate":
        assert len(rows) == len(pd.read_parquet(f"{odd}/{table}.parquet", columns=[]).index) or len(rows) == pd.read_parquet(f"{odd}/{table}.parquet").shape[0]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_und_without_letters(spark, odd):
    got = result(spark, "op6_language", odd)
    docs = pd.read_parquet(f"{odd}/documents.parquet")
    silent = sum(1 for t in docs.text if not isinstance(t, str) or not any(map(str.isalpha, t)))
    assert (got.lang_pred == "und").sum() == silent and (got[got.lang_pred == "und"].score == 0).all()
    assert np.isfinite(got.score).all()
