"""Main text of web pages by host consensus on container paths.

Every page names the container that holds its article: the deepest element with
nearly all of the page's plain text (or the article element around it), leaving
out menus, forms, adverts and the like. Containers are written as generalised paths of tags and classes, with
digits replaced, so pages of one host agree on them. Spark counts the votes per
host and path, and every page is read again with its host's winning path; a page
without such a container falls back on its own best one. An element whose class, id
or role speaks of something beside the article stays if it holds nearly all of the
page's plain text, or if the page has no other text.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed, empty ones left out, and the rest joined in page order
by two line ends. Headings inside the article belong to it.

Nulls and odd rows: a null or empty html, or one without main text, gives an empty
text; markup may break off anywhere; a null url is a host of its own; repeated
rows vote and are extracted each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import stage

#: A container holds the article if it has this share of the page's plain text.
SHARE = 0.85
DEPTH = 24
#: So often a page is read again for elements named beside the article that hold it; then names count no more.
READINGS = 8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_ARTICLE = re.compile(r".*>(?:article|main)(?:\.[^>]*)?(?=>|$)")
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; the last two do hold text.
RAW = frozenset("script style noscript template iframe textarea title noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
DROPPED = frozenset("head nav footer aside form button select option script style noscript template iframe textarea svg canvas object dialog menu".split())
#: Parts of class names, ids and roles that mark something beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo complementary consent cookie "
    "cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo "
    "promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split()
)
#: These close an open paragraph.
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
    "section table ul".split()
)
_CONTAINERS = frozenset("article body div html main section table tbody td tr center".split())


class Block:
    __slots__ = ("text", "linked", "chain")

    def __init__(self, text: str, linked: int, chain: tuple[int, ...]):
        self.text, self.linked, self.chain = text, linked, chain

    @property
    def plain(self) -> int:
        return max(0, len(self.text) - 2 * self.linked)


class Page:
    """Blocks of text outside dropped elements, and the containers above them."""

    def __init__(self, source: str | None):
        kept: set[int] = set()
        for reading in range(READINGS + 1):
            self.paths: list[str] = []
            self.blocks: list[Block] = []
            beside = self._read(source or "", kept, reading < READINGS)
            total = sum(b.plain for b in self.blocks) + sum(max(0, n) for n in beside.values())
            holds = {start for start, n in beside.items() if n > 0 and (n >= SHARE * total or not self.blocks)}
            if not holds:
                break
            kept |= holds

    def _read(self, source: str, kept: set[int], by_name: bool) -> dict[int, int]:
        """Fill paths and blocks; plain text of elements left out by their names, by place. ``kept`` ones stay, or all."""
        beside: dict[int, int] = {}
        named = tagged = 0
        # Open elements: name, number of the container (-1: none), whether it is left out, and by its tag.
        stack: list[tuple[str, int, bool, bool]] = []
        chain: tuple[int, ...] = ()
        held: list[str] = []
        linked = links = dropped = articles = at = 0

        def flush() -> None:
            nonlocal linked
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                self.blocks.append(Block(text, min(linked, len(text)), chain))
            held.clear()
            linked = 0

        def close() -> None:
            nonlocal chain, links, dropped, tagged, articles
            name, container, out, by_tag = stack.pop()
            if name not in INLINE:
                flush()
            if container >= 0:
                chain = chain[:-1]
            links -= name == "a"
            dropped -= out
            tagged -= by_tag
            articles -= name in ("article", "main")

        while at < len(source):
            found = _TOKEN.search(source, at)
            stop = found.start() if found else len(source)
            if stop > at and not dropped:
                held.append(source[at:stop])
                linked += (stop - at) * (links > 0)
            elif stop > at and not tagged:
                size = len(" ".join(source[at:stop].split()))
                beside[named] += -size if links else size
            if not found:
                break
            at = found.end()
            if found[2] is None:
                continue
            name = found[2].lower()
            if found[1]:
                if any(s[0] == name for s in stack):
                    while stack[-1][0] != name:
                        close()
                    close()
                elif name == "p" or name not in INLINE:
                    flush()
                continue
            if name not in INLINE and name != "br":
                flush()
            if name == "br":
                held.append(" ")
            if name in VOID:
                continue
            if name in _CLOSES_P:
                self._close_open(stack, close, ("p",), _CONTAINERS)
            elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self._close_open(stack, close, ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,), frozenset("ul ol dl table tbody".split()))
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            attributes = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(found[3])} if found[3].strip() else {}
            out = by_tag = name in DROPPED or (name == "header" and not articles)
            if not out and by_name and attributes and found.start() not in kept and name not in ("html", "body", "main"):
                words = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
                marks = set(_PARTS.split(_CAMEL.sub(" ", words).lower()))
                out = bool(marks & BESIDE) or (not articles and bool(marks & {"header"}) and name != "article")
                if out and not dropped:
                    named = found.start()
                    beside[named] = 0
            container = -1
            if name in _CONTAINERS and not dropped and not out:
                kind = attributes.get("class", "").split()
                step = _DIGITS.sub("#", name + ("." + kind[0].lower() if kind else ""))
                above = self.paths[chain[-1]] if chain else ""
                container = len(self.paths)
                self.paths.append(f"{above}>{step}" if above.count(">") < DEPTH else above)
                chain = (*chain, container) if len(chain) < DEPTH else chain
                if len(chain) == DEPTH and chain[-1] != container:
                    container = -1
            stack.append((name, container, out, by_tag))
            links += name == "a"
            dropped += out
            tagged += by_tag
            articles += name in ("article", "main")
        flush()
        return beside

    @staticmethod
    def _close_open(stack, close, names, until) -> None:
        """Close an open element whose end tag may be left out, unless a container stands between."""
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in names:
                while len(stack) > depth:
                    close()
                return
            if stack[depth][0] in until:
                return

    def best(self) -> tuple[str | None, float]:
        """Path of the deepest containers with nearly all plain text, and that text's length."""
        weights: dict[str, float] = {}
        total = 0.0
        for block in self.blocks:
            total += block.plain
            for path in {self.paths[c] for c in block.chain}:
                weights[path] = weights.get(path, 0.0) + block.plain
        if not total:
            return None, 0.0
        enough = [p for p, w in weights.items() if w >= SHARE * total]
        path = max(enough, key=lambda p: (p.count(">"), weights[p], p), default=None)
        # Sections of an article are parts of it, headings between them included.
        whole = _ARTICLE.match(path) if path else None
        return whole[0] if whole else path, total

    def text(self, path: str | None) -> str:
        """Blocks below ``path``, or below the page's own best container, or all."""
        chosen = [b for b in self.blocks if any(self.paths[c] == path for c in b.chain)] if path else []
        if not chosen:
            own, _ = self.best()
            chosen = [b for b in self.blocks if any(self.paths[c] == own for c in b.chain)] if own else self.blocks
        return "\n\n".join(b.text for b in chosen)


def host_column(url: str = "url") -> Column:
    return F.regexp_extract(F.lower(F.coalesce(F.col(url).cast("string"), F.lit(""))), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1)


def host_paths(pages: DataFrame) -> DataFrame:
    """host and path: what most of a host's pages name, then what holds more text."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = [Page(h.as_py()).best() for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p for p, _ in named], pa.string()), pa.array([n for _, n in named], pa.float64())], ["host", "path", "size"]
            )

    votes = pages.select(host_column().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(vote, "host string, path string, size double")
    counted = votes.where("path IS NOT NULL").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("n", "size", "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    paths = stage(host_paths(pages), "host-paths").withColumnRenamed("host", "_host")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_column().alias("host"))
    # The written table's size decides whether it is broadcast; else a large host is split at run time.
    joined = rows.join(paths, rows["host"] == paths["_host"], "left").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", "path"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h.as_py()).text(p.as_py()) for h, p in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(read, "page_id long, url string, text string, n_chars long")
