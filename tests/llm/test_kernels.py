"""Kernels against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyarrow import fs

from motionweave.llm import bpe, common, decontaminate, elias_fano, golay, langid, quality_model, shards, simhash, warc
from motionweave.llm.components import connected, stars
from motionweave.llm.html import Page, mark_of, path_hash


@pytest.mark.parametrize("n,u", [(0, 10), (1, 1), (1, 1 << 40), (5, 6), (1000, 1000), (1000, 1 << 62), (20000, 90000)])
def test_elias_fano(tmp_path, n, u):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, u, n, dtype=np.uint64))
    uri = f"file://{tmp_path}/x"
    elias_fano.save(uri, elias_fano.nested("a", elias_fano.encode(v, u)))
    e = elias_fano.pick("a", elias_fano.load(uri))
    if n:
        assert (e.get(np.arange(n)) == v).all()
        low, high = e.get_pair(np.arange(n - 1))
        assert (low == v[:-1]).all() and (high == v[1:]).all()
    q = np.concatenate([rng.integers(0, u, 500, dtype=np.uint64), v])
    at, same = e.successor(q)
    want = np.searchsorted(v, q)
    assert (at == want).all() and (same == np.isin(q, v)).all()


def test_golay_keys():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 300)
    k, m = golay.keys(x)
    table = golay.decode_table()
    for i in range(300):
        own = set(k[i][m[i]].tolist())
        assert len(own) <= 6 and int(table[x[i]]) in own
        a, b = (1 << int(p) for p in rng.choice(23, 2, replace=False))
        assert int(table[x[i] ^ a]) in own
        k2, m2 = golay.keys(np.array([x[i] ^ a ^ b]))
        assert own & set(k2[m2].tolist())


@pytest.mark.parametrize("seed", range(3))
def test_simhash_links_are_exact(seed):
    rng = np.random.default_rng(seed)
    f = [int(v) for v in rng.integers(0, 1 << 63, 60)]
    for _ in range(900):  # chains and dense groups
        v = f[int(rng.integers(len(f)))]
        for p in rng.choice(64, int(rng.integers(1, 8)), replace=False):
            v ^= 1 << int(p)
        f.append(v)
    fps = np.unique(np.array(f, np.uint64))
    a, b = simhash.close_pairs(*simhash.join_keys(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    p, q = np.nonzero(np.triu(near, 1))
    want, got = stars(fps[p], fps[q]), stars(a, b)
    assert set(zip(*map(np.ndarray.tolist, want))) == set(zip(*map(np.ndarray.tolist, got)))
    assert len(a) < len(fps)


def test_components_over_spark(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 100 + k) for k in range(30)] + [(k, k + 1) for k in range(200, 240)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        x, y = label.setdefault(a, a), label.setdefault(b, b)
        label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    loops = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    assert got == {k: v for k, v in label.items() if k not in loops}


def test_masks_hit_every_allowed_window():
    for n in range(decontaminate.LEAST, decontaminate.WINDOW + 1):
        window, least = decontaminate.rule(n)
        for wrong in combinations(range(window), window - least):
            assert any(all(o + k not in wrong for k in m) for m in decontaminate.MASKS for o in range(window - m[-1]))


def test_decontamination_equals_brute_force():
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 4, 5, 7, 9, 14, 30])))) for k in range(25)]
    texts = [None, ""]
    for _ in range(60):
        w = rng.choice(items)[1].split()
        at = rng.randrange(max(1, len(w) - 12))
        w = w[at : at + rng.randrange(5, 20)]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "zz"
        texts.append(" ".join(rng.choices(vocab, k=8) + w + rng.choices(vocab, k=5)))
    bench = decontaminate.Benchmark(items)
    got = {(r, bench.items[k][0]) for r, k, *_ in bench.overlaps(texts)}
    want = set()
    for r, t in enumerate(texts):
        w = decontaminate.tokens(t)
        for k, x in items:
            x = x.split()
            n, least = decontaminate.rule(len(x))
            if any(sum(0 <= s + j < len(w) and w[s + j] == x[j] for j in range(q, q + n)) >= least for s in range(-len(x), len(w)) for q in range(len(x) - n + 1)):
                want.add((r, k))
    assert got == want and want
    short = {(r, bench.items[k][0]) for r, k, _, n, _ in bench.overlaps(texts) if n < decontaminate.LEAST}
    assert short == {(r, k) for r, k in want if len(items[k][1].split()) < 5} and short


def test_decontamination_in_blocks(spark, small, monkeypatch):
    from motionweave.llm.common import table

    docs, bench = table(spark, small, "documents"), table(spark, small, "benchmark")
    whole = sorted(map(tuple, decontaminate.find_overlaps(docs, bench).collect()))
    kept = sorted(r.doc_id for r in decontaminate.keep_clean(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    assert decontaminate.count_blocks(bench) > 2
    assert sorted(map(tuple, decontaminate.find_overlaps(docs, bench).collect())) == whole
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()) == kept


def test_decontamination_blocks_count_a_text_for_every_id(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(100))
    bench = spark.createDataFrame([(k, text) for k in range(100)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + text + " after"), (2, "something else"), (None, text)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 5 * len(text))
    n = decontaminate.count_blocks(bench)
    assert n == 20
    sizes = [len(b.items) for b in decontaminate.blocks(bench, n)]
    assert sum(sizes) == 100 and max(sizes) < 20
    found = decontaminate.find_overlaps(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.doc_token) for r in found) == sorted([(0, k, 0) for k in range(100)] + [(1, k, 1) for k in range(100)])


def test_language_draw_leaves_no_language_out(spark):
    words = {"de": "der die und das nicht", "fr": "le la et les pas"}
    # Rows without an id, and one id repeated for all rows of a language.
    no_ids = [(None, f"{w} {k}", lang) for lang, w in words.items() for k in range(6000)]
    one_id = [(7 if lang == "de" else 8, w, lang) for lang, w in words.items() for _ in range(6000)]
    for rows in (no_ids, one_id):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
        model = langid.train(docs)
        assert model.languages == ["de", "fr"]
        assert model.predict(["der die und nicht", "le la pas et"])[0] == ["de", "fr"]
        assert np.array_equal(langid.train(docs.repartition(3)).weights, model.weights)


def test_language_training_step_by_hand():
    """One row with one n-gram: the first step of the regularised leader, and scores as a softmax."""
    one = np.array([5], "<i4")
    samples = [("a", one, one * 0 + 1), ("b", one + 1, one * 0 + 1)]
    model = langid.fit(samples, ["a", "b"])
    assert model.weights[5, 0] > model.weights[5, 1] and model.weights[6, 1] > model.weights[6, 0]
    used = np.flatnonzero(np.abs(model.weights).sum(axis=1))
    assert set(used.tolist()) == {5, 6}
    texts = ["some text", "другой", None, ""]
    p = np.exp(model.logits(texts) / model.temperature)
    p /= p.sum(axis=1, keepdims=True)
    lang, score = model.predict(texts)
    assert np.allclose(score[:2], p.max(axis=1)[:2]) and lang[2:] == ["und", "und"] and score[2:].tolist() == [0, 0]


def test_quality_model_takes_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k} " + "word " * (k % 9)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    texts = [r.text for r in docs.limit(50).collect()]
    x = quality_model.features(pa.array(texts))
    scores = [quality_model.train(docs.repartition(n), labels).score(x) for n in (1, 3, 7)]
    assert all(np.array_equal(scores[0], s) for s in scores[1:])
    # The same as the model of the chosen texts alone.
    best = {}
    for r in docs.selectExpr("doc_id", "text", "xxhash64(text) h").collect():
        best[r.doc_id] = min(best.get(r.doc_id, (r.h, r.text)), (r.h, r.text))
    own = quality_model.fit(quality_model.features(pa.array([best[k][1] for k in range(40)])), np.array([k % 2 for k in range(40)], float))
    assert np.array_equal(own.score(x), scores[0])


def test_bpe_pieces_give_the_same_ids():
    import public_tokenizers

    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(6)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "don't", "42", "é", "漢", "😀", "...", " ", "\x1c", " '", "s"]) for _ in range(4000))
    for limit in (1, 7, 50, 1000):
        pieces = list(bpe.safe_pieces(text, limit))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def linear_ids(text, enc):
    """Every match of the pattern by another matcher, encoded by itself."""
    import public_tokenizers
    import regex

    return [i for m in regex.finditer(public_tokenizers.PATTERN, text) for i in enc._encode_single_piece(m.group().encode())]


def test_bpe_white_space_of_any_length():
    import public_tokenizers

    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in (" " * 10**6, "\n" * 10**6 + "x", "x" + " " * 10**6, "ab" + "\n \t" * 400_000 + "'s " + "\u2003" * 9000 + " word", "\x1c" * 200_000 + "y"):
        ids = bpe.encode_text(text, enc)
        assert ids == linear_ids(text, enc) and enc.decode_bytes(ids) == text.encode()
    rng = random.Random(9)
    for run in (1, 2, 5):
        text = "".join(rng.choice([" ", "\n", "\t", "\xa0", "a", "é", "1", "'s", "!", " " * rng.randrange(40)]) for _ in range(3000))
        ids = [i for part, single in bpe.parts(text, run) for i in (enc._encode_single_piece(part.encode()) if single else enc.encode_ordinary(part))]
        assert ids == enc.encode_ordinary(text) and "".join(p for p, _ in bpe.parts(text, run)) == text
    with pytest.raises(ValueError):
        bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), r"\s*[\r\n]+|\s+(?!\S)|\s+")


def test_bundle_is_seekable(tmp_path):
    writer = warc.BundleWriter(f"file://{tmp_path}/b.warc.zst", frame_bytes=500)
    plain = b""
    for k in range(40):
        body = b"payload %d " % k * 10
        data = warc.format_record(warc.Record(k, "http://x/\r\n", "response", None, body, len(body), __import__("hashlib").sha256(body).hexdigest()))
        writer.add(k, data)
        plain += data
    rows = writer.close()
    raw = (tmp_path / "b.warc.zst").read_bytes()
    # Any Zstandard reader sees the frames and skips the table.
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == plain
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "b.warc.zst")) as f:
        frames = warc.read_seek_table(f)
    assert len(frames) > 5 and sum(x[2] for x in frames) == len(plain)
    for page_id, path, _, *place in rows:
        assert warc.read_record(path, *place).page_id == page_id
    broken = bytearray(plain)
    broken[plain.index(b"payload 3 ") + 2] ^= 1
    with pytest.raises(ValueError):
        list(warc.parse_records(bytes(broken)))


def test_html_drops_what_is_not_text():
    page = (
        "<html><head><title>no</title></head><body><header>no</header><nav>no</nav><div class='cookie-notice'>no</div><main><h1>Yes &lt;one&gt;</h1>"
        "<p>two<b>three</b>\n four<br>five<script>var x = '</p>no';</script><aside>no</aside><form>no</form><div id=comments><p>no no no no</div></main><footer>no</footer>"
    )
    assert Page(page).text(None) == "Yes <one> twothree four five"
    assert Page("").text(None) == "" and Page("<p>").text("html/body") == ""


def test_html_odd_markup():
    assert Page("<p title=don't>one isn't</p> two").text(None) == "one isn't two"
    assert Page('<div class="a>b" id=\'x"y\'>text</div>').text(None) == "text"
    assert Page("a b<p>c<!-- gone").text(None) == "a b c"
    page = Page("<div>" * 50_000 + "deep" + "</i>" * 50_000)
    assert page.text(None) == "deep" and len(page.hashes) == 50_001
    assert Page("<a " * 100_000).text(None).startswith("<a <a")


def test_html_paths():
    page = Page("<html><body><div class='post-7 wide'>one</div><div class='w-1/2'><p>two</p></div><div class='post-8'>three</div></body></html>")
    assert page.text("html/body/div.post-N") == "one three" and page.text("html/body/div.w-N/N") == "two"
    assert page.hashes[page.path[-1]] == path_hash("html/body/div.post-N")


def test_html_names_are_weak_signals():
    body = "<article><p>{0} one two three.</p><div class='share-price'>Share price 40 today, up from 38 yesterday</div>{1}<p>four</p></article>"
    kept = "long text one two three. Share price 40 today, up from 38 yesterday"
    page = body.format("long text", "<div class='ad'>buy</div><div id=cookieNotice>we use</div><ul class='adTop'><li>x</ul><div class='notice-box'>n</div><div class='cookie-recipe'><a href=x>only links</a></div>")
    assert Page(page).text() == kept + " four"
    # A weakly named block goes where its text repeats on the host.
    again = next(iter(Page(page).weak_blocks().values()))
    assert Page(page).text(None, [again]) == "long text one two three. four"
    assert mark_of("ad") == mark_of("main comment-list") == mark_of("adSlot2") == 2 and mark_of("share-price") == 1 and mark_of("shadow lead header") == 0


def test_html_takes_the_whole_article_of_a_page_of_divs():
    page = "<body><div class=top><a href=/>home</a><a href=/b>b</a></div><div class=post><h1>Title</h1><div class=lead>{}</div><div class=text>{}</div></div><div class=end>(c) 2020</div></body>"
    lead, text = "A lead of a hundred characters. " * 3, "<p>" + "The body of the article goes on. " * 30 + "</p><p>End.</p>"
    assert Page(page.format(lead, text)).text() == " ".join(f"Title {lead} {text}".replace("<p>", " ").replace("</p>", " ").split())


def test_compaction_plan_and_conflict(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    t = shards.ShardTable(spark, root)
    first = spark.range(1000).selectExpr("id", "cast(id as string) s", "if(id % 3 = 0, null, id) z")
    assert t.append(first, shard_bytes=2000) == 1
    assert t.append(first.filter("id < 0")) == 2
    assert t.append(first.selectExpr("id + 1000 id", "s", "z"), shard_bytes=2000) == 3
    before = t.manifest()[1]
    small = min(s.bytes for s in before)
    version = t.compact(target=20 * small)
    after = t.manifest()[1]
    assert len(after) < len(before) / 4 and version == t.latest() > 3
    assert max(s.bytes for s in after) <= 21 * small
    rows = sorted(map(tuple, t.read().collect()), key=lambda r: r[0])
    assert rows == [(k, str(k % 1000), None if k % 1000 % 3 == 0 else k % 1000) for k in range(2000)]
    assert t.read(1).count() == 1000  # an old version stays readable
    with pytest.raises(shards.CommitConflict):
        t.commit(first.schema, [], 0)
    assert t.vacuum() >= len(before) and t.read().count() == 2000


def test_every_way_to_publish_refuses_a_version_that_exists(spark, tmp_path):
    t = shards.ShardTable(spark, f"file://{tmp_path}/t")
    assert t._link(["a"], "manifests/v0000000001") and not t._link(["b"], "manifests/v0000000001")
    for way in (t._rename, t._create):
        name = f"manifests/v{way.__name__}"
        way(["a"], name)
        with pytest.raises(Exception, match="AlreadyExists"):
            way(["b"], name)
        assert (tmp_path / "t" / name).read_text() == "a"
    assert not [p for p in (tmp_path / "t" / "manifests").iterdir() if "tmp" in p.name and "crc" not in p.name]


def test_concurrent_writers_and_vacuum(spark, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    t = shards.ShardTable(spark, f"file://{tmp_path}/t")
    t.append(spark.range(100), shard_bytes=200)
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: t.append(spark.range(100 * k, 100 * k + 100), shard_bytes=200), range(1, 5)))
    assert sorted(versions) == [2, 3, 4, 5] and sorted(r.id for r in t.read().collect()) == list(range(500))
    # A vacuum, and then another writer, between a writer's files and its commit.
    commit, calls = shards.ShardTable.commit, []

    def late(self, *args):
        if not calls:
            calls.append(1)
            assert t.vacuum() == 0
            t.append(spark.range(600, 700))
        return commit(self, *args)

    monkeypatch.setattr(shards.ShardTable, "commit", late)
    assert t.append(spark.range(500, 600)) == 7
    # The same for a compaction, against an append and against another compaction.
    calls.clear()
    t.compact(target=10_000)
    assert sorted(r.id for r in t.read().collect()) == sorted([*range(700), *range(600, 700)])
    monkeypatch.setattr(shards.ShardTable, "commit", commit)
    replace, calls = shards.ShardTable._replace, []

    def other_first(self, *args):
        if not calls:
            calls.append(1)
            shards.ShardTable(spark, t.root).compact(target=100_000)
        return replace(self, *args)

    monkeypatch.setattr(shards.ShardTable, "_replace", other_first)
    for k in range(3):
        t.append(spark.range(1000 + k, 1001 + k))
    before = sorted(r.id for r in t.read().collect())
    t.compact(target=100_000)
    assert calls and sorted(r.id for r in t.read().collect()) == before
    # What a writer that failed has left goes, and nothing else.
    (tmp_path / "t" / "intents" / "dead").write_text("")
    (tmp_path / "t" / "data" / "dead-1.parquet").write_text("")
    assert (tmp_path / "t" / "data" / "dead-1.parquet").exists() and t.vacuum() > 0
    assert (tmp_path / "t" / "data" / "dead-1.parquet").exists()
    t.vacuum(stale=0)
    assert not (tmp_path / "t" / "data" / "dead-1.parquet").exists() and sorted(r.id for r in t.read().collect()) == before


def test_shards_of_several_schemas(spark, tmp_path):
    t = shards.ShardTable(spark, f"file://{tmp_path}/t")
    t.append(spark.createDataFrame([(1, "a")], "id long, text string"))
    t.append(spark.createDataFrame([("b", 2, [1.5])], "Text string, id long, more array<double>"))
    t.append(spark.createDataFrame([(3,)], "id long"))
    want = [(1, "a", None), (2, "b", [1.5]), (3, None, None)]
    assert t.read().columns == ["id", "text", "more"] and sorted(map(tuple, t.read().collect())) == want
    t.compact()
    assert len(t.manifest()[1]) == 1 and sorted(map(tuple, t.read().collect())) == want
    files = len(list((tmp_path / "t" / "data").iterdir()))
    for bad in ("id string", "id long, x int, X int"):
        with pytest.raises(shards.SchemaConflict):
            t.append(spark.createDataFrame([], bad))
    assert len(list((tmp_path / "t" / "data").iterdir())) == files and not list((tmp_path / "t" / "intents").iterdir())


def test_pairwise_model_needs_its_pairs():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality_model.fit(x, y)
    assert m.pairs[0] == (0, 1)
    fresh = rng.uniform(-1, 1, (1000, 3))
    assert ((m.score(fresh) > 0.5) == ((fresh[:, 0] > 0) ^ (fresh[:, 1] > 0))).mean() > 0.9
    assert quality_model.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


class _Session:
    """The parts of a session that the shared folder needs."""

    def __init__(self, master, **settings):
        self.conf, self.settings = self, settings
        self.sparkContext = type("Context", (), {"master": master})

    def get(self, key, default):
        return self.settings.get(key.replace(".", "_"), default)

    def set(self, key, value):
        assert key != "spark.checkpoint.dir"  # Spark refuses that in a running session
        self.settings[key.replace(".", "_")] = value


def test_shared_folder():
    assert common.shared_dir(_Session("yarn", spark_checkpoint_dir="hdfs://n/shared/")) == "hdfs://n/shared"
    alone = _Session("local[2]")
    assert common.shared_dir(alone).startswith("file://") and common.shared_dir(alone) == common.shared_dir(alone)
    with pytest.raises(ValueError):
        common.shared_dir(_Session("spark://host:7077"))


@pytest.mark.parametrize(
    "source,want",
    [
        ("<body><form id=aspnetForm><nav>Menu</nav><article><p>One long sentence of the article.</p></article><label>Name</label></form>", "One long sentence of the article."),
        ("<body><div id=page class=right-sidebar><article><p>One long sentence of the article.</p></article></div>", "One long sentence of the article."),
        ('<body><div class="wrapper sidebar-left"><article><p>One long sentence of the article.</p></article><div class=sidebar>Side text</div></div>', "One long sentence of the article."),
        ("<body><article><p>One long sentence of the article.</p><section class=social><p>How people lived together.</p></section></article>", "One long sentence of the article. How people lived together."),
        ("<body><article><div class=page-header><h1>Title</h1></div><p>One long sentence of the article.</p></article>", "Title One long sentence of the article."),
        ("<body><article><p>A sentence with an in<img src=x>side picture.</p></article>", "A sentence with an inside picture."),
        ("<body><article><p>A short article here.</p></article><form><p>Send us your name and address.</p><input></form>", "A short article here."),
        ("<body><article><p>A short article here.</p></article><div class=comments><p>" + "I like this very much. " * 40 + "</p></div>", "A short article here."),
        ("<body><article><p>A rather short article is here.</p><div class=newsletter><p>Write to us.</p></div></article><div class=cookie-notice>We use cookies.</div>", "A rather short article is here."),
    ],
)
def test_forms_and_names_keep_the_article(source, want):
    assert Page(source).text() == want
