"""HTML extraction by a site style tree.

The pages of a host are merged into one tree of styles: every element path of a page
counts once with its presentation (the sequence of its children) and its content (all
text below it). The entropy of both over the host's pages gives a node's importance:
what looks and reads the same on all pages, or is drawn from a small stock, matters
little. Branches of low importance are removed from each page. Elements whose very name,
role or class says that they are not content (navigation, footers, forms and so on) go
too, since a host with few pages gives no entropy to speak of."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.scratch import stash

#: A branch goes if its importance is lower, unless more than this share of its texts are found on no other page of the table.
LEAST_IMPORTANCE = 0.4
MOST_UNIQUE = 0.05
#: A host's own entropies weigh as its number of pages, those of the path over all hosts as so many pages: with few
#: pages of its own a host is judged by what the same path is elsewhere.
PRIOR_PAGES = 50
#: So many noise branches may be sent to all tasks (about 200 bytes each); more are joined to the pages by a shuffle.
BROADCAST_BRANCHES = 100_000

_TOKEN = re.compile(
    r"""<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<close2>/)?(?P<name2>[a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>""",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")

#: Elements whose content is no text of the page: neither markup nor text in them is read.
RAW = frozenset("script style title textarea iframe noembed noframes template select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
#: Elements that are never content, and those of the same kind that only their class, id or role names.
CHROME = frozenset("nav footer aside form button menu search dialog head input label".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation navi menu breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription share sharing social related "
    "recommended recommendations comment comments disqus respond reply replies widget toolbar pagination pager login signup search skip".split()
)
#: Words of a compound name that only say which part of the chrome an element is, and words that make it say how a page looks.
PART_WORDS = frozenset(
    "area bar block body box bottom button buttons column container group icon icons inner item items left link links list outer panel posts right row section slot text "
    "title top unit widget wrap wrapper x".split()
)
STATE_WORDS = frozenset("no not non has have with without is hide hides show shows enable enabled disable disabled".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: An opening tag of the key ends an open element of the value.
_P_ENDERS = BLOCK - {"body", "html", "option", "optgroup", "legend", "summary", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Why a branch is dropped: for its importance, for what it is, or only for its class or id.
NOISE, CHROME_ITSELF, CHROME_NAMED = 1, 2, 4
_SCOPES = frozenset("ul ol dl table tr tbody article main section div nav body".split())


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")) if value else "")
    return out


@lru_cache(1 << 14)
def _names_chrome(names: str) -> bool:
    """Whether one of the classes or ids is a word for chrome, or a compound that ends with one ("post-comments",
    "comment-list"); "no-sidebar" and "comments-open" only tell how a page looks."""
    for token in names.split():
        found = [w.lower() for w in _WORD.findall(token)]
        if found[:2] == ["skip", "to"]:
            return True
        while len(found) > 1 and (found[-1].isdigit() or found[-1] in PART_WORDS):
            found.pop()
        if found and STATE_WORDS.isdisjoint(found) and (found[-1] in CHROME_WORDS or _written_together(found[-1])):
            return True
    return False


def _written_together(word: str) -> bool:
    """Whether a word is one for chrome and a part without a mark between them ("commentlist")."""
    return any(word[:i] in CHROME_WORDS and word[i:] in PART_WORDS for i in range(2, len(word)))


def _is_chrome(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element is chrome by name, role or style."""
    if name in CHROME or (name in ("header", "noscript") and not in_article) or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    return attrs.get("role", "").lower() in CHROME_ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower()


#: A prime and a base of the hashes of text; fixed values.
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79C4A6E821


class Page:
    """One parsed page: ``blocks`` of (inside an article, text), ``features`` of
    {path: [presentation, content]}, with paths as 64-bit numbers, and ``lost``: characters
    in removed branches by why these go (NOISE, CHROME_ITSELF and CHROME_NAMED, added up)."""

    def __init__(self, source: str, noise: frozenset[int] = frozenset(), with_features: bool = False):
        self._noise, self._with = noise, with_features
        self._kept: frozenset[int] = frozenset()
        self._read(source)
        self._kept = self._misnamed()
        if self._kept:
            self._read(source)

    def _read(self, source: str) -> None:
        self.blocks: list[tuple[bool, str]] = []
        self.features: dict[int, list[int]] = {}
        self._named: list[list[int]] = []  # of branches with a name of chrome: place, the one around, inside an article, characters
        self._stack: list[list] = []  # name, path, dropped for (NOISE, CHROME_ITSELF, CHROME_NAMED), article, children's hash, first chunk, last label, branch of _named
        self._text: list[str] = []
        self._sums: list[int] = [0]  # running hash of the text so far, chunk by chunk
        self._open: dict[str, int] = {}  # elements of a name on the stack
        self.lost: dict[int, int] = {}
        self._has_article = False
        self._parse(source)
        while self._stack:
            self._pop()
        self._end_block()

    def _misnamed(self) -> frozenset[int]:
        """Places of the branches that hold most of the page's text, or of its articles' text if these are empty otherwise:
        they are content, whatever their class."""
        if self._has_article and any(inside for inside, _ in self.blocks):
            return frozenset()
        total = 0 if self._has_article else sum(len(t.replace(" ", "")) for _, t in self.blocks)
        for _, around, inside, size in reversed(self._named):
            if around >= 0:
                self._named[around][3] += size
            if inside if self._has_article else around < 0:
                total += size if around < 0 or not self._named[around][2] else 0
        return frozenset(place for place, _, inside, size in self._named if 2 * size > total and (inside or not self._has_article))

    def text(self) -> str:
        return "\n".join(t for inside, t in self.blocks if inside or not self._has_article)

    def _inside(self) -> bool:
        return bool(self._stack) and self._stack[-1][3]

    def _dropped(self) -> bool:
        return bool(self._stack) and self._stack[-1][2] != 0

    def _end_block(self) -> None:
        if self._text:
            text = _SPACE.sub(" ", html.unescape("".join(self._text))).strip()
            if text:
                self.blocks.append((self._block_inside, text))
            self._text = []

    def _add(self, text: str) -> None:
        if self._with:
            self._sums.append((self._sums[-1] * _BASE + xxhash.xxh64_intdigest(text)) % _PRIME)
        if self._dropped():
            self.lost[self._stack[-1][2]] = self.lost.get(self._stack[-1][2], 0) + len(_SPACE.sub("", text))
        if not self._dropped():
            if not self._text:
                self._block_inside = self._inside()
            self._text.append(text)
        elif self._stack[-1][2] == CHROME_NAMED:
            self._named[self._stack[-1][7]][3] += len(_SPACE.sub("", html.unescape(text)))

    def _push(self, name: str, attrs: dict[str, str], place: int) -> None:
        parent = self._stack[-1] if self._stack else None
        whole = name in ("body", "html", "main") or attrs.get("role") == "main"
        named = not whole and _names_chrome(attrs.get("class", "") + " " + attrs.get("id", ""))
        dropped = CHROME_ITSELF | CHROME_NAMED
        if parent and parent[2] & dropped and not named and (name in ("article", "main") or attrs.get("role") == "main") and not any(s[3] for s in self._stack):
            # chrome that was never closed doesn't swallow the article
            while self._stack and self._stack[-1][2] & dropped:
                self._pop()
            parent = self._stack[-1] if self._stack else None
        # numbers in a class or id often tell one page from another, and no style from another
        label = name + "." + _DIGITS.sub("0", attrs.get("class", "") + "#" + attrs.get("id", ""))
        path = xxhash.xxh64_intdigest(label, parent[1] if parent else 0)
        article_itself = name in ("article", "main") or attrs.get("role") in ("main", "article")
        article = (parent[3] if parent else False) or article_itself
        chrome = parent[2] if parent else 0
        if _is_chrome(name, attrs, parent[3] if parent else False):
            chrome |= CHROME_ITSELF
        branch = parent[7] if parent else -1
        if named and not article_itself and place not in self._kept:
            chrome |= CHROME_NAMED
            self._named.append([place, branch, int(parent is not None and parent[3]), 0])
            branch = len(self._named) - 1
        if article:  # what an article holds is content, however often the host repeats it
            chrome &= ~NOISE
        elif path in self._noise:
            chrome |= NOISE
        if article and not chrome:
            self._has_article = True
        if parent:
            parent[4] = xxhash.xxh64_intdigest(label, parent[4]) if label != parent[6] else parent[4]
            parent[6] = label
        self._stack.append([name, path, chrome, article, 0, len(self._sums) - 1, "", branch])
        self._open[name] = self._open.get(name, 0) + 1

    def _pop(self) -> None:
        name, path, _, _, children, first, _, _ = self._stack.pop()
        self._open[name] -= 1
        if self._with and name in BLOCK:
            content = (self._sums[-1] - self._sums[first] * pow(_BASE, len(self._sums) - 1 - first, _PRIME)) % _PRIME
            seen = self.features.setdefault(path, [0, 0])
            seen[0] = (seen[0] * 31 + children + 1) & ((1 << 64) - 1)
            seen[1] = (seen[1] * 31 + content + 1) & ((1 << 64) - 1)
        if name in BLOCK:
            self._end_block()

    def _close_until(self, names: set[str] | frozenset[str], scopes: frozenset[str]) -> None:
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] in names:
                while len(self._stack) > i:
                    self._pop()
                return
            if self._stack[i][0] in scopes:
                return

    def _parse(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                self._add(source[at:])
                return
            if m.start() > at:
                self._add(source[at : m.start()])
            at = m.end()
            name = m["name"] or m["name2"]
            if name is None:
                continue
            name = name.lower()
            if m["close"] or m["close2"]:
                if self._open.get(name):
                    self._close_until({name}, frozenset())
                elif name in BLOCK:
                    self._end_block()
                elif name == "br":
                    self._add(" ")
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(source, at) if not (m["attrs"] or "").endswith("/") else None
                if end:
                    at = end.end()
                elif not (m["attrs"] or "").endswith("/"):
                    at = n
                continue
            if name in VOID:
                if name == "br":
                    self._add(" ")
                elif name == "hr":
                    self._end_block()
                continue
            if name in BLOCK:
                self._end_block()
            if name in _P_ENDERS:
                self._close_until({"p"}, _SCOPES)
            if name in _ENDS:
                self._close_until(_ENDS[name], _SCOPES - {"tr"} if name == "tr" else _SCOPES)
            self._push(name, _attributes(m["attrs"]) if m["attrs"] else {}, m.start())


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, pages, presentation, content, importance, unique: the merged tree.

    ``presentation`` and ``content`` are entropies over the host's different pages that have
    the path, to the base of their number: 1 if all differ, 0 if all agree (and 1 on a single
    page). ``importance`` is the mean of the two, drawn towards that of the path over the pages
    of all hosts, which counts as PRIOR_PAGES pages. ``unique`` is the share of the host's pages
    whose content at the path no other page of the table has there. Equal pages of a host
    count as one."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = xxhash.xxh64_intdigest(source.encode("utf-8", "surrogatepass"))
                out += [(host, page, path, a, b) for path, (a, b) in Page(source, with_features=True).features.items()]
            if out:
                host, *numbers = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(host), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in numbers)], ["host", "page", "path", "style", "content"])

    seen = rows.mapInArrow(run, "host string, page long, path long, style long, content long").distinct()
    counts = stash(seen.groupBy("host", "path", "style", "content").agg(F.count(F.lit(1)).alias("c")), "style-tree")

    def entropies(keys: list[str], feature: str, name: str) -> DataFrame:
        c, n = F.col("c").cast("double"), F.sum("c")
        entropy = (F.log(n) - F.sum(c * F.log(c)) / n) / F.log(n)
        summed = counts.groupBy(*keys, feature).agg(F.sum("c").alias("c"))
        return summed.groupBy(*keys).agg(n.alias("pages"), F.when(n > 1, F.greatest(entropy, F.lit(0.0))).otherwise(1.0).alias(name))

    def importances(keys: list[str]) -> DataFrame:
        return entropies(keys, "style", "presentation").join(entropies(keys, "content", "content").drop("pages"), keys)

    mean = (F.col("presentation") + F.col("content")) / 2
    everywhere = importances(["path"]).select("path", mean.alias("prior"))
    alone = counts.groupBy("path", "content").agg(F.sum("c").alias("n"), F.min("host").alias("host")).where("n = 1").groupBy("host", "path").agg(F.count(F.lit(1)).alias("alone"))
    own = importances(["host", "path"]).join(everywhere, "path").join(alone, ["host", "path"], "left")
    drawn = (F.col("pages") * mean + PRIOR_PAGES * F.col("prior")) / (F.col("pages") + PRIOR_PAGES)
    return own.select("host", "path", "pages", "presentation", "content", drawn.alias("importance"), (F.coalesce("alone", F.lit(0)) / F.col("pages")).alias("unique"))


def _noise(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """host, path of the branches that go for their importance."""
    low = (F.col("importance") < LEAST_IMPORTANCE) & (F.col("unique") <= MOST_UNIQUE) & (F.col("pages") > 1)
    return stash(style_tree(pages, url_col, html_col).where(low).select("host", "path"), "noise-branches")


def _parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str, names: list[str], kinds: list[str], read: Callable[[str | None, frozenset[int]], tuple]) -> DataFrame:
    """``id_col``, ``url_col`` and the columns that ``read`` makes of each page and the noise paths of its host."""
    noise = _noise(pages, url_col, html_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    known: dict[str, set[int]] | None = None
    if noise.limit(BROADCAST_BRANCHES + 1).count() <= BROADCAST_BRANCHES:
        known = {}
        for r in noise.toLocalIterator():
            known.setdefault(r["host"], set()).add(r["path"])
        shared = pages.sparkSession.sparkContext.broadcast({h: frozenset(p & (1 << 64) - 1 for p in paths) for h, paths in known.items()})
        rows = rows.withColumn("noise", F.lit(None).cast("array<long>"))
    else:
        # a host's list has only branches that at least two of its pages share
        rows = rows.join(noise.groupBy("host").agg(F.collect_list("path").alias("noise")), "host", "left").select("id", "url", "host", "html", "noise")
    broadcast = known is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for host, source, own in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                paths = shared.value.get(host, frozenset()) if broadcast else frozenset(p & (1 << 64) - 1 for p in own.as_py() or ())
                found.append(read(source.as_py(), paths))
            made = zip(*found, strict=True) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.string() if k == "string" else pa.int64()) for x, k in zip(made, kinds, strict=True))], ["id", "url", *names])

    types = dict(pages.dtypes)
    out = rows.mapInArrow(run, ", ".join([f"id {types[id_col]}", f"url {types[url_col]}", *(f"{n} {k}" for n, k in zip(names, kinds, strict=True))]))
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: ``id_col``, ``url_col``, text and n_chars (code points).

    Blocks are joined by newlines in page order; white space inside one is a single space,
    a ``br`` too. A page with an ``article`` or ``main`` element gives what is inside these,
    any other its body. A branch is removed if its element is not content by name, role, class
    or id, or if its importance on its host is low (see ``style_tree``) and its texts are not
    its pages' own; an article, what is inside it and what holds it never go for their
    importance. By class and id neither an article goes, nor a branch with more than half of
    the text of a page without articles, or of articles that would be empty otherwise.

    A null or empty page has the empty text. Pages repeated in the table are extracted each,
    and count once for their host; pages without a host form one of their own. A null id or
    url stays null. Only the three columns named are read."""

    def read(source: str | None, noise: frozenset[int]) -> tuple[str, int]:
        text = Page(source, noise).text() if source else ""
        return text, len(text)

    return _parsed(pages, id_col, url_col, html_col, ["text", "n_chars"], ["string", "long"], read)


def removal_report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """What removes how much of every page: ``id_col``, ``url_col`` and numbers of characters (white space
    not counted): kept, beside_article (in no removed branch, but outside the page's articles), by_importance
    (in branches that the style tree alone removes), by_name (that name, role or class alone removes) and
    by_both. Nulls and repeated pages as in ``extract_main_text``."""

    def read(source: str | None, noise: frozenset[int]) -> tuple[int, ...]:
        page = Page(source or "", noise)
        size = lambda keep: sum(len(t.replace(" ", "")) for inside, t in page.blocks if keep(inside))
        kept = size(lambda inside: inside or not page._has_article)
        beside = size(lambda inside: page._has_article and not inside)
        lost = lambda why: sum(n for flags, n in page.lost.items() if why(flags))
        return kept, beside, lost(lambda f: f == NOISE), lost(lambda f: not f & NOISE), lost(lambda f: f & NOISE and f != NOISE)

    return _parsed(pages, id_col, url_col, html_col, ["kept", "beside_article", "by_importance", "by_name", "by_both"], ["long"] * 5, read)
