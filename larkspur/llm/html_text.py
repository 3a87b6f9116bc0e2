"""Main text of web pages by host consensus.

First pass: every page scores its containers by the running text directly in
them, climbs from the best one to the whole article around it, and votes for
that one's generalised tag-class path. The votes are summed per host, and a host
may have several winning paths. Second pass: each page's text is taken from the
containers on one winning path, its own choice if that won, else the one with
most votes that it has; where a page has none of them, from its own choice.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep_table, prepare

# Elements of the HTML standard by how they are treated here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold isn't shown as text, or isn't the article's; they end at their end tag, whatever is between.
RAW = frozenset("script style textarea title noscript iframe template noembed noframes svg annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
NOT_ARTICLE = frozenset("nav header footer aside form menu dialog head button select search fieldset label".split())
#: Words in class, id or role that mark what isn't the article.
NOT_ARTICLE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer form header login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion recommended related replies reply "
    "search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets banner complementary contentinfo alert".split()
)
#: A start tag of the first set ends an open element of the second.
CLOSES = {
    **{t: frozenset({"p"}) for t in BLOCK - {"html", "head", "body"}},
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}),
    "option": frozenset({"option"}),
    "body": frozenset({"head", "p"}),
}
#: What such an implied end does not reach beyond.
FENCE = frozenset("table ul ol dl article section div main body td th blockquote form".split())
#: Elements that hold one block; their text counts for the container around them.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote td th tr tbody thead tfoot table ul ol dl figcaption caption summary".split())
#: An implied end isn't looked for beyond so many open elements.
REACH = 512
# No part of these patterns is tried again once it has matched, so a page is read once whatever is wrong with it.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)(>?)")
ATTR = re.compile(r"([^\s=>/\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*+>?", re.I) for t in RAW}
PARTING = re.compile(r"[-_:\d]+|(?<=[a-z])(?=[A-Z])")
#: Words that mark a class token whatever stands beside them (reader-comments, disqus_thread, cookie-banner-text), but for ``STATE_WORDS``.
STRONG_WORDS = frozenset("advert adverts advertisement advertisements comment comments consent cookie cookies disqus gdpr newsletter sponsored".split())
#: With one of these a token tells of a state or a style (comments-open, has-cookies, no-comments), not of what the element is.
STATE_WORDS = frozenset("allow allowed can closed disabled enabled free has hide hidden is js no not off on open show shown supports with without".split())
#: Words that may stand beside those of ``NOT_ARTICLE_WORDS`` in one class token (site-footer, ad-slot) without changing what it marks.
PLACE_WORDS = frozenset("area bar block bottom box container global inner item items left link links list main module outer page panel post primary right secondary section site slot top unit wrap wrapper".split())
#: Elements that class, id or role never mark: their words tell of the page's state or layout.
NEVER_MARKED = frozenset("html body main article".split())
DIGITS = re.compile(r"\d+")


class Element:
    """``key`` numbers the elements in page order, ``last`` is the last one inside, ``path`` numbers equal tag-class paths."""

    __slots__ = ("tag", "label", "path", "parent", "key", "last", "named", "barred", "skip", "article", "main", "heading", "leaf", "box")

    def __init__(self, tag, label, path, parent, key, named=False):
        self.tag, self.label, self.path, self.parent, self.key, self.last = tag, label, path, parent, key, key
        self.named = named  # marked by class, id or role
        self.article = self if tag == "article" else parent and parent.article
        self.main = self if tag == "main" else parent and parent.main
        # an article's own header holds its headline, a quotation's footer its source
        inside = (tag == "header" and self.article) or (tag == "footer" and parent is not None and parent.tag == "blockquote")
        self.barred = (tag in NOT_ARTICLE and not inside) or (parent is not None and parent.barred)
        self.skip = self.barred or named or (parent is not None and parent.skip)
        self.heading = tag == "h1" or (parent is not None and parent.heading)
        self.leaf = tag in LEAF or (parent is not None and parent.leaf)
        self.box = self if tag not in LEAF or parent is None else parent.box

    def holds(self, other: Element) -> bool:
        return self.key <= other.key <= self.last

    def line(self) -> list[Element]:
        """The element and those around it, outwards."""
        out, e = [], self
        while e is not None:
            out.append(e)
            e = e.parent
        return out

    def path_text(self) -> str:
        return "".join(f"/{e.label}" for e in reversed(self.line()[:-1]))


def _marks(token: str) -> bool:
    words = [w.lower() for w in PARTING.split(token) if w]
    if any(w in STRONG_WORDS for w in words) and not any(w in STATE_WORDS for w in words):
        return True
    return token.lower() in NOT_ARTICLE_WORDS or (any(w in NOT_ARTICLE_WORDS for w in words) and all(w in NOT_ARTICLE_WORDS or w in PLACE_WORDS for w in words))


def _names(attrs: str) -> tuple[str, bool]:
    """The generalised class part of a path, and whether class, id or role mark what isn't the article."""
    shown, bad = "", False
    for m in ATTR.finditer(attrs):
        name = m[1].lower()
        if name in ("class", "id", "role"):
            words = (m[2] or m[3] or m[4] or "").split()
            bad = bad or any(map(_marks, words))
            if name == "class" and not shown:
                shown = "".join(f".{c}" for c in sorted({DIGITS.sub("#", c) for c in words}))
    return shown, bad


class Page:
    """The blocks of a page and the elements they are in, read in one pass.

    ``blocks`` are (text, element, characters of it that are link text) in page
    order; ``elements`` are in page order, so parents come first.
    """

    def __init__(self, page: str):
        root = Element("", "", 0, None, 0)
        self.elements = [root]
        self.blocks: list[tuple[str, Element, int]] = []
        self.kids: dict[int, dict[str, int]] = defaultdict(dict)  # of a path: label -> path
        self._paths = 0
        self._read(page)
        for e in reversed(self.elements):
            if e.parent is not None and e.last > e.parent.last:
                e.parent.last = e.last
        if any(e.named for e in self.elements):
            self._unmark()

    def _element(self, tag: str, shown: str, parent: Element, named: bool) -> Element:
        label, kids = tag + shown, self.kids[parent.path]
        if label not in kids:
            self._paths += 1
            kids[label] = self._paths
        element = Element(tag, label, kids[label], parent, len(self.elements), named)
        self.elements.append(element)
        return element

    def _read(self, page: str) -> None:
        stack, buffer = [self.elements[0]], []
        opened: dict[str, int] = defaultdict(int)  # open elements by tag
        linked = 0
        in_link = False

        def flush():
            nonlocal linked
            if buffer:
                text = " ".join(_html.unescape("".join(buffer)).split())
                if text:
                    self.blocks.append((text, stack[-1], min(linked, len(text))))
                buffer.clear()
            linked = 0

        def add(text):
            nonlocal linked
            if text:
                buffer.append(text)
                if in_link:
                    linked += len(text)

        def close(k):
            for e in stack[k:]:
                opened[e.tag] -= 1
            del stack[k:]

        def push(tag, shown, bad):
            opened[tag] += 1
            stack.append(self._element(tag, shown, stack[-1], bad))

        at, n = 0, len(page)
        while at < n:
            begin = page.find("<", at)
            if begin < 0:
                add(page[at:])
                break
            add(page[at:begin])
            mark = page[begin + 1 : begin + 2]
            if mark in ("!", "?"):
                comment = page.startswith("<!--", begin)
                end = page.find("-->" if comment else ">", begin + 2)
                at = n if end < 0 else end + (3 if comment else 1)
                continue
            m = TAG.match(page, begin)
            if m is None:
                add("<")
                at = begin + 1
                continue
            at = m.end()
            tag = m[2].lower()
            if not m[4]:  # the page ends inside a tag
                break
            if tag in RAW:
                if not m[1] and not m[3].endswith("/"):
                    if tag == "title":
                        flush()
                    end = RAW_END[tag].search(page, at)
                    at = n if end is None else end.end()
                continue
            if tag == "a":
                in_link = not m[1]
                continue
            if tag in ("br", "wbr", "img"):
                if tag == "br":
                    add(" ")
                continue
            inline = tag not in BLOCK
            if m[1]:
                if not inline:
                    flush()
                if opened[tag]:
                    flush()
                    in_link = False
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
                continue
            shown, bad = _names(m[3]) if "=" in m[3] else ("", False)
            bad = bad and tag not in NEVER_MARKED
            if inline:
                if (bad or tag in NOT_ARTICLE) and tag not in VOID and not m[3].endswith("/"):  # a marked span or label is left out like a block
                    flush()
                    push(tag, shown, bad)
                continue
            flush()
            in_link = False
            closes = CLOSES.get(tag, ())
            if any(opened[t] for t in closes):
                for k in range(len(stack) - 1, max(0, len(stack) - 1 - REACH), -1):
                    if k < len(stack) and stack[k].tag in closes:
                        close(k)
                        if tag not in ("tr", "td", "th", "dd", "dt", "li", "body"):
                            break
                    elif k < len(stack) and stack[k].tag in FENCE:
                        break
            if tag not in VOID:
                push(tag, shown, bad)
        flush()

    def summed(self, own: dict[int, float]) -> list[float]:
        """For each element the sum of ``own`` (by key) over what it holds."""
        out = [own.get(e.key, 0) for e in self.elements]
        for e in reversed(self.elements):
            if e.parent is not None:
                out[e.parent.key] += out[e.key]
        return out

    def _unmark(self) -> None:
        """What holds most of the page's running text isn't left out for its class, unless an article or main stands beside it."""
        own: dict[int, float] = defaultdict(int)
        framed: dict[int, float] = defaultdict(int)
        for text, element, linked in self.blocks:
            if not element.barred:
                own[element.key] += len(text) - linked
                if element.article or element.main:
                    framed[element.key] += len(text) - linked
        held, held_framed = self.summed(own), self.summed(framed)
        for e in self.elements:
            if e.named and 2 * held[e.key] > held[0] and held_framed[e.key] == held_framed[0]:
                e.named = False
            e.skip = e.barred or e.named or (e.parent is not None and e.parent.skip)

    def running(self) -> list[tuple[str, Element, int]]:
        return [b for b in self.blocks if not b[1].skip]

    def path_of(self, text: str) -> int | None:
        """The number of the path with this text, if the page has it."""
        open_ = [(0, 0)]
        while open_:
            path, at = open_.pop()
            if at == len(text):
                return path
            open_ += [(p, at + 1 + len(label)) for label, p in self.kids.get(path, {}).items() if text.startswith(f"/{label}", at)]
        return None


def best_container(page: Page) -> Element | None:
    """The container with most running text: its own blocks count in full, those of containers in it by half."""
    scores: dict[int, float] = defaultdict(float)
    for text, element, linked in page.running():
        share, e = 1.0, element.box
        while e is not None and share > 0.2:
            scores[e.key] += (len(text) - linked) * share
            share /= 2
            e = e.parent
    return page.elements[max(scores, key=lambda k: (scores[k], -k))] if scores else None


#: Without a heading to hold, a container with this share of the running text is climbed to.
NEARLY_ALL = 0.97


def whole_article(page: Page) -> Element | None:
    """The best container's article or main; where it is in none, the lowest element around it that holds the page's
    heading and all running text that isn't left out (nearly all of it where there is no heading)."""
    best = best_container(page)
    if best is None:
        return None
    running = page.running()
    headings = [e for _, e, _ in running if e.heading]
    article, main = best.article, best.main
    if article is not None:
        # a heading or sections of running text beside the article belong to it unless they are other articles'
        alone = all(article.holds(e) for _, e, _ in running if e.article)
        outer = main is not None and main.holds(article)
        return main if outer and alone and headings and not any(article.holds(e) for e in headings) else article
    if main is not None:
        return main
    own: dict[int, float] = defaultdict(int)
    for text, element, linked in running:
        if 2 * linked < len(text) and element.leaf:
            own[element.key] += len(text)
    held = page.summed(own)
    for e in best.line():
        if headings:
            if held[e.key] >= held[0] and e.holds(headings[0]) and e.tag not in LEAF:
                return e
        elif held[e.key] >= NEARLY_ALL * held[0]:
            return e if e.parent is None or e.tag not in LEAF else best
    return best


def extract(html: str, winners: list[str] | None) -> str:
    """The text of a page; ``winners`` are its host's winning paths, most votes first."""
    page = Page(html)
    own = whole_article(page)
    if own is None:
        return ""
    path = None
    if winners:
        if own.path_text() in winners:
            path = own.path
        else:
            holding = page.summed({element.key: 1 for _, element, _ in page.running()})
            there = {e.path for e in page.elements if holding[e.key]}
            path = next((p for p in map(page.path_of, winners) if p is not None and p in there), None)
    inside = [False] * len(page.elements)
    for e in page.elements:
        inside[e.key] = (e is own if path is None else e.path == path) or (e.parent is not None and inside[e.parent.key])
    return "\n".join(text for text, element, _ in page.running() if inside[element.key])


#: A path beside the first wins with this share of its host's votes, so a host has about twenty at most.
VOTES_SHARE = 0.05
#: A table of winning paths up to this many bytes (measured) is sent to every task; a larger one is joined by host.
BROADCAST_BYTES = 8 << 20


def _source(pages: DataFrame) -> DataFrame:
    prepare(pages.sparkSession)
    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, place): a host's winning paths, by votes; of equal votes the longer running text, then the path.

    The first one wins, and each other with two votes and ``VOTES_SHARE`` of the host's.
    """

    def vote(batches):
        for batch in batches:
            hosts, pages_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            votes: dict[tuple[str, str], list[int]] = {}
            for host, page in zip(hosts, pages_, strict=True):
                best = whole_article(found := Page(page))
                if best is not None:
                    v = votes.setdefault((host, best.path_text()), [0, 0])
                    v[0] += 1
                    v[1] += sum(len(t) for t, _, _ in found.running())
            if votes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in votes]), pa.array([k[1] for k in votes]), *(pa.array([v[i] for v in votes.values()], pa.int64()) for i in (0, 1))],
                    names=["host", "path", "votes", "chars"],
                )

    votes = _source(pages).select("host", "html").mapInArrow(vote, "host string, path string, votes long, chars long")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("chars").alias("chars"))
    by_host = Window.partitionBy("host")
    place = F.row_number().over(by_host.orderBy(F.desc("votes"), F.desc("chars"), F.desc("path")))
    ranked = votes.withColumn("place", place).withColumn("all", F.sum("votes").over(by_host))
    return ranked.where((F.col("place") == 1) | ((F.col("votes") >= 2) & (F.col("votes") >= VOTES_SHARE * F.col("all")))).select("host", "path", "place")


def main_text(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text (empty if none), n_chars.

    Null html is an empty page; pages without a url vote together as one host;
    repeated rows are kept; other columns are ignored; an empty table gives an
    empty result.
    """
    ranked = host_paths(pages).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "path"))).alias("ranked"))
    winners = keep_table(ranked.select("host", F.col("ranked.path").alias("path")), "host-paths")
    size = winners.agg(F.coalesce(F.sum(F.length("host") + F.length(F.concat_ws("", "path")) + 32), F.lit(0))).first()[0]
    source = _source(pages)
    joined = source.join(F.broadcast(winners) if size <= BROADCAST_BYTES else winners.hint("shuffle_merge"), "host", "left").select("page_id", "url", "html", "path")

    def run(batches):
        for batch in batches:
            paths = batch.column(3).to_pylist()
            texts = [extract(h, p) for h, p in zip(batch.column(2).to_pylist(), paths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = source.schema
    return joined.mapInArrow(run, f"page_id {kind['page_id'].dataType.simpleString()}, url {kind['url'].dataType.simpleString()}, text string, n_chars long")
