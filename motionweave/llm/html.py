"""Main-text extraction by consensus host paths.

1. Every page is parsed, and each of its containers is rated by how well it holds the
   page's running text (paragraphs, headings and other blocks that are not mostly links):
   the F-measure of the share of the running text that it holds and the share of its own
   text that is running.  The smallest container of all the text wins; a lead block beside
   the body, or a wrapper with menus, loses (``page_votes``).
2. All containers vote, per host, on generalised tag-class paths such as
   ``html/body/div.post-N``; a path's rating is its mean over the pages that have it
   (integer sums, so they do not depend on order).  Paths travel as 64-bit hashes.
3. Every page is extracted again from the elements on the host's best-rated path that it
   has (``extract``); a page without any, or without a host, uses its own best container.

Menus, footers, scripts and the like go by their tag or role.  Forms, and blocks whose whole
name (class or id) says so, such as ``ad``, ``cookie-notice`` or ``right-sidebar``, go unless they
hold most of the page's running text, as a form or a layout class around all of it does; reader
comments always go.  A name that merely holds such a word (``share-price``) is a weak signal and
counts only if the block is mostly links, or if its text repeats on ``REPEAT_PAGES`` or more
and ``SHARE`` of the host's pages.

Null html counts as empty and gives an empty text; a page of plain text gives that
text.  Ties between paths go to the one on more pages, then to the smaller hash.  Very long
or deep pages take memory and time in proportion to their size.  Repeated rows give equal
results, an empty table none.  Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from hashlib import blake2b
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionweave.llm.common import column, materialise, record, table

#: Winning paths are broadcast up to this many bytes; beyond it they are joined by host.
BROADCAST_BYTES = 16 << 20
#: Paths and repeated blocks of a host count from this share of its pages on, so their lists are short.
SHARE, REPEAT_PAGES = 0.01, 3
#: Votes are millionths.
UNIT = 1_000_000

#: A quote opens a value only after an equals sign, so that a stray one swallows no text.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>|<[!?/][^>]*>""", re.S)
_OPEN_COMMENT = re.compile(r"<!--.*()()()\Z", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CONTAINER = frozenset("#root body article main section div td center".split())
_DROP = frozenset("head script style noscript iframe template nav footer aside button select textarea svg canvas object dialog menu title xmp".split())
_DROP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Words of names that mark boilerplate, and words that say nothing beside them.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promos promotion promotions banner nav navbar navigation menu menus breadcrumb breadcrumbs"
    " sidebar sidebars widget widgets footer masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup share sharing social related recommended"
    " comment comments commentlist respond disqus reply replies pagination pager login searchform searchbox".split()
)
_PLAIN = frozenset(
    "area aside bar block body bottom box btn button buttons card cell col column container content count desktop element fixed footer form global group head header icon icons inline inner item items"
    " js label left links link list main mobile module outer overlay page panel post posts primary right row secondary section site slot small sticky text title toggle top unit user wrap wrapper".split()
)
#: Of the words: those of reader comments, and those that a section of an article may have as its subject.
_COMMENT_MARKS = frozenset("comment comments commentlist respond disqus reply replies".split())
_SUBJECTS = frozenset("social promotion promotions menu menus navigation".split())
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Blocks whose text is running text at any length, and the length from which others are.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd figcaption".split())
MIN_RUNNING = 25
_DIGITS = re.compile(r"\d+")
#: A start tag in the first set ends an open element of the second.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)


def _words(name: str) -> set[str]:
    return {x.lower() for x in _NAME_PART.findall(name)}


def mark_of(names: str, tag: str = "div", in_article: bool = False) -> int:
    """2 if one of the names says boilerplate as a whole, 1 if one holds such a word, else 0.

    Within an article a page header is no boilerplate, and a section may be about a word of ``_SUBJECTS``.
    """
    out = 0
    for parts in map(_words, names.split()):
        if marks := _MARKS & parts:
            whole = parts <= _MARKS | _PLAIN and not (in_article and tag == "section" and marks <= _SUBJECTS)
            out = max(out, 2 if whole else 1)
        elif {"header"} < parts <= {"site", "page", "header"} and not in_article:
            out = max(out, 2)
    return out


def says_comments(names: str) -> bool:
    """Whether one of the names says reader comments as a whole."""
    return any(parts <= _MARKS | _PLAIN and not _COMMENT_MARKS.isdisjoint(parts) for parts in map(_words, names.split()))


def _signed(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def path_hash(path: str) -> int:
    return _signed(blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).digest())


class Page:
    """A parsed page: elements in document order, and runs of text that name their element.

    Equal paths share a number; a path's hash continues its parent's, so memory and time
    grow with the page and not with its depth.
    """

    __slots__ = ("tags", "parents", "dropped", "named", "weak", "in_article", "path", "hashes", "runs", "_hashers", "_numbers", "_open_tags")

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.dropped, self.in_article, self.path = ["#root"], [-1], [False], [False], [0]
        #: Elements with a name that is a weak signal; hashes of all paths by number.
        self.weak: list[int] = []
        #: Forms, and elements whose names say boilerplate, until it is known how much they hold.
        self.named: list[int] = []
        self._hashers = [blake2b(digest_size=8)]
        self.hashes = [path_hash("")]
        self._numbers: dict[tuple[int, str], int] = {}
        self._open_tags: dict[str, int] = {}
        #: (element, text); text None is a boundary between blocks.
        self.runs: list[tuple[int, str | None]] = []
        stack, at, end, last = [0], 0, len(source), source.rfind(">")
        while at < end:
            # Past the last ">" only an unclosed comment is markup.
            m = _TAG.search(source, at) if at <= last else _OPEN_COMMENT.search(source, at)
            if m is None:
                self.runs.append((stack[-1], source[at:]))
                break
            if m.start() > at:
                self.runs.append((stack[-1], source[at : m.start()]))
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if name not in _INLINE:
                self.runs.append((stack[-1], None))
            if m[1]:
                self._close(stack, name)
                continue
            self._imply(stack, name)
            node = self._open(stack[-1], name, m[3])
            if name in _RAW_END:
                e = _RAW_END[name].search(source, at)
                at = e.end() if e else end
            elif name not in _VOID and not m[3].endswith("/"):
                stack.append(node)
                self._open_tags[name] = self._open_tags.get(name, 0) + 1
        self._settle_named()
        self._drop_link_blocks()

    def _open(self, parent: int, name: str, attrs: str) -> int:
        kind, drop = "", name in _DROP or self.dropped[parent]
        if attrs and not attrs.isspace():
            found = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(attrs)}
            kind = found.get("class", "").strip()
            mark = max(mark_of(found.get(k, ""), name, self.in_article[parent]) for k in ("class", "id"))
            if name in ("body", "html", "article", "main"):
                drop = drop or (name == "article" and mark == 2 and "comment" in kind.lower())
                mark = 0
            elif not drop:
                drop = (
                    (mark == 2 and (says_comments(kind) or says_comments(found.get("id", ""))))
                    or found.get("role", "").lower() in _DROP_ROLE
                    or found.get("aria-hidden", "").lower() == "true"
                    or "display:none" in found.get("style", "").replace(" ", "").lower()
                )
            if mark == 1 and not drop:
                self.weak.append(len(self.tags))
            elif not drop and (mark == 2 or found.get("role", "").lower() == "form"):
                self.named.append(len(self.tags))
        if name == "form" and not drop and len(self.tags) not in self.named[-1:]:
            self.named.append(len(self.tags))
        if name == "header" and not drop:
            drop = not self.in_article[parent]
        step = name + "." + _DIGITS.sub("N", kind.split()[0].lower()) if kind else name
        self.tags.append(name)
        self.parents.append(parent)
        self.dropped.append(drop)
        self.in_article.append(name == "article" or self.in_article[parent])
        up = self.path[parent]
        number = self._numbers.setdefault((up, step), len(self.hashes))
        if number == len(self.hashes):
            hasher = self._hashers[up].copy()
            hasher.update((("/" if up else "") + step).encode("utf-8", "surrogatepass"))
            self._hashers.append(hasher)
            self.hashes.append(_signed(hasher.digest()))
        self.path.append(number)
        return len(self.tags) - 1

    def _drop(self, nodes: set[int]) -> None:
        """Leave out these elements and all within them."""
        for k in range(min(nodes, default=len(self.tags)), len(self.tags)):
            self.dropped[k] = self.dropped[k] or k in nodes or (k > 0 and self.dropped[self.parents[k]])

    def _settle_named(self) -> None:
        """Leave out forms and elements named as boilerplate, but for those that hold most of the page's running text.

        Where the page has an article or main element with text, that is among what they must hold.
        """
        if self.named:
            _, running, total = self._running()
            home = [self.tags[k] in ("article", "main") and not self.dropped[k] and running[k] > 0 for k in range(len(self.tags))]
            for k in range(len(self.tags) - 1, 0, -1):
                home[self.parents[k]] |= home[k]
            self._drop({k for k in self.named if 2 * running[k] <= total or home[0] and not home[k]})

    def _drop_link_blocks(self) -> None:
        """Leave out the weakly named elements that are mostly links."""
        if self.weak:
            text, links = self._sizes()
            self._drop({k for k in self.weak if 2 * links[k] >= text[k]})
            self.weak = [k for k in self.weak if not self.dropped[k]]

    def _sizes(self) -> tuple[list[int], list[int]]:
        """Characters, and those of links, within every element."""
        n = len(self.tags)
        text, links, linked = [0] * n, [0] * n, self._linked()
        for node, run in self.runs:
            if run is not None and not self.dropped[node]:
                size = len(run.strip())
                text[node] += size
                links[node] += size if linked[node] else 0
        for k in range(n - 1, 0, -1):
            text[self.parents[k]] += text[k]
            links[self.parents[k]] += links[k]
        return text, links

    def _linked(self) -> list[bool]:
        out: list[bool] = []
        for k, up in enumerate(self.parents):
            out.append(self.tags[k] == "a" or (up >= 0 and out[up]))
        return out

    def weak_blocks(self) -> dict[int, int]:
        """Hash of the text of every weakly named element that is kept."""
        if not self.weak:
            return {}
        inside: list[list[str]] = [[] for _ in self.weak]
        at = {k: i for i, k in enumerate(self.weak)}
        owner: list[int] = []  # the outermost weak element around each
        for k, up in enumerate(self.parents):
            owner.append(owner[up] if up >= 0 and owner[up] >= 0 else at.get(k, -1))
        for node, run in self.runs:
            if run is not None and owner[node] >= 0 and not self.dropped[node]:
                inside[owner[node]].append(run)
        return {k: path_hash(" ".join(" ".join(x).split())) for k, x in zip(self.weak, inside) if x}

    def _pop(self, stack: list[int], k: int) -> None:
        for node in stack[k:]:
            self._open_tags[self.tags[node]] -= 1
        del stack[k:]

    def _close(self, stack: list[int], name: str) -> None:
        if not self._open_tags.get(name):
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tags[stack[k]] == name:
                self._pop(stack, k)
                return
            if name in _INLINE and self.tags[stack[k]] in _CONTAINER:
                return

    def _imply(self, stack: list[int], name: str) -> None:
        if name in _P_ENDS:
            ends, stops = {"p"}, _CONTAINER | {"li", "th", "button", "blockquote"}
        elif name in _CLOSES:
            ends, stops = _CLOSES[name]
        else:
            return
        for tag in ends:
            if self._open_tags.get(tag):
                break
        else:
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in ends:
                self._pop(stack, k)
                if name != "tr":
                    return
            elif tag in stops:
                return

    def _running(self) -> tuple[list[int], list[int], int]:
        """Characters, and those of running text, within every element, and those of running text in all."""
        n, linked = len(self.tags), self._linked()
        text, running = [0] * n, [0] * n
        block: list[tuple[int, int, bool]] = []
        total = any_text = 0

        def close() -> None:
            nonlocal total, any_text
            size = sum(x for _, x, _ in block)
            if 2 * sum(x for _, x, a in block if a) <= size and (size >= MIN_RUNNING or any(self._in_prose(k) for k, _, _ in block)):
                for k, x, _ in block:
                    running[k] += x
                total += size
            for k, x, _ in block:
                text[k] += x
            any_text += size
            block.clear()

        for node, run in self.runs:
            if run is None:
                close()
            elif not self.dropped[node] and (size := len(run.strip())):
                block.append((node, size, linked[node]))
        close()
        if not total:  # only scraps or links: all text counts
            running, total = list(text), any_text
        for k in range(n - 1, 0, -1):
            text[self.parents[k]] += text[k]
            running[self.parents[k]] += running[k]
        return text, running, total

    def votes(self) -> dict[int, int]:
        """Rating (millionths) of the path of every container that holds running text, by its hash."""
        text, running, total = self._running()
        homes = self._homes()
        held: dict[int, list[int]] = {}
        for k in range(len(self.tags)):
            if running[k] and homes[k] == k and self.tags[k] in _CONTAINER:
                sums = held.setdefault(self.path[k], [0, 0])
                sums[0] += running[k]
                sums[1] += text[k]
        # F-measure: 2 r / (all running text + all text of the container).
        return {self.hashes[p]: 2 * UNIT * r // (total + t) for p, (r, t) in held.items()}

    def _in_prose(self, node: int) -> bool:
        while self.tags[node] in _INLINE:
            node = self.parents[node]
        return self.tags[node] in _PROSE

    def _homes(self) -> list[int]:
        """Of every element: the nearest article around it, or else the outermost main element, or itself."""
        article, main = [-1], [-1]
        for k in range(1, len(self.tags)):
            up, kept = self.parents[k], not self.dropped[k]
            article.append(k if kept and self.tags[k] == "article" else article[up])
            main.append(k if kept and self.tags[k] == "main" and main[up] < 0 else main[up])
        return [a if a >= 0 else m if m >= 0 else k for k, (a, m) in enumerate(zip(article, main))]

    def _on(self, path: int) -> list[bool]:
        """Which elements are on the path with that hash."""
        return [self.hashes[n] == path for n in self.path]

    def text(self, paths: list[int] | str | None = None, repeated: list[int] = ()) -> str:
        """Text of the elements on the first of ``paths`` that has any; of the best own container if none has.

        ``repeated`` are the hashes of blocks that the host repeats; a path may be given by name.
        """
        if self.weak and repeated:
            known = set(repeated)
            self._drop({k for k, h in self.weak_blocks().items() if h in known})
        here = set(self.hashes)
        for path in [path_hash(paths)] if isinstance(paths, str) else paths or ():
            if path in here and (out := self._text(self._on(path))):
                return out
        own = self.votes()
        return self._text(self._on(min(own, key=lambda h: (-own[h], h)))) if own else ""

    def _text(self, inside: list[bool]) -> str:
        for k in range(1, len(inside)):
            inside[k] = inside[k] or inside[self.parents[k]]
        parts = [" " if t is None else t for node, t in self.runs if inside[node] and not self.dropped[node]]
        return " ".join(entities.unescape("".join(parts)).split())


def host_of(url: str | Column) -> Column:
    """Lower-case host of a URL; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


_VOTES = pa.schema([("host", pa.string()), ("kind", pa.int32()), ("hash", pa.int64()), ("votes", pa.int64())])
PAGE, PATH, BLOCK = 0, 1, 2


def page_votes(pages: DataFrame) -> DataFrame:
    """(host, kind, hash, votes) of every page that has a host: one row for itself, one for
    the path of each container, and one for each weakly named block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, source in zip(column(batch, "host").to_pylist(), column(batch, "html")):
                page = Page(source.as_py() or "")
                rows.append((host, PAGE, 0, 0))
                rows += [(host, PATH, h, v) for h, v in page.votes().items()]
                rows += [(host, BLOCK, h, 0) for h in set(page.weak_blocks().values())]
            yield record(_VOTES, host=[r[0] for r in rows], kind=[r[1] for r in rows], hash=[r[2] for r in rows], votes=[r[3] for r in rows])

    return pages.select(host_of("url").alias("host"), "html").filter("host is not null").mapInArrow(run, "host string, kind int, hash long, votes long")


def host_paths(pages: DataFrame) -> DataFrame:
    """One row per host: its paths, best first, and the hashes of the blocks that it repeats."""
    sums = page_votes(pages).groupBy("host", "kind", "hash").agg(F.sum("votes").alias("votes"), F.count(F.lit(1)).alias("pages"))
    sums = materialise(sums, "host-votes")
    sizes = sums.filter(F.col("kind") == PAGE).select("host", F.col("pages").alias("of"))
    known = sums.filter(F.col("kind") != PAGE).join(sizes, "host").filter(F.col("pages") >= F.lit(SHARE) * F.col("of"))
    # Integer division: ratings are compared in millionths on every machine alike.
    path = F.when(F.col("kind") == PATH, F.struct((-F.expr("votes div pages")).alias("rating"), (-F.col("pages")).alias("pages"), "hash"))
    block = F.when((F.col("kind") == BLOCK) & (F.col("pages") >= REPEAT_PAGES), F.col("hash"))
    lists = known.groupBy("host").agg(F.array_sort(F.collect_list(path)).alias("paths"), F.collect_list(block).alias("repeated"))
    return lists.select("host", F.transform("paths", lambda p: p["hash"]).alias("paths"), "repeated")


def extract(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, from its host's row in ``paths``."""
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(column(batch, "html"), column(batch, "paths").to_pylist(), column(batch, "repeated").to_pylist())
            texts = [Page(s.as_py() or "").text(p or (), r or ()) for s, p, r in rows]
            yield record(out, page_id=column(batch, "page_id").cast(pa.int64()), url=column(batch, "url"), text=texts, n_chars=[len(t) for t in texts])

    # Pages without a host get keys of their own, so that they never share a partition.
    key = F.coalesce(host_of("url"), F.concat(F.lit("?"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    joined = pages.select("page_id", "url", "html", key.alias("host")).join(paths, "host", "left")
    return joined.select("page_id", "url", "html", "paths", "repeated").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """The whole method.  The hosts' lists are broadcast only if their bytes are few."""
    paths = materialise(host_paths(pages), "host-paths")
    size = paths.agg(F.sum(F.octet_length("host") + 8 * (F.size("paths") + F.size("repeated")) + 96)).first()[0] or 0
    return extract(pages, F.broadcast(paths) if size <= BROADCAST_BYTES else paths)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_main_text": op10_main_text}
SQL: dict[str, str] = {}
