"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of their blocks; the page votes for the path of its best container, where
a path is the chain of tags with their classes, digits generalised. Spark counts the votes for each host. Pages are then
extracted from the most voted path of their host that they have; a page that has none of them uses its own best one.
A path counts as its host's if it has CONSENSUS of the host's votes, so a host has 1 / CONSENSUS paths at most.

Parts that are no article text by their class or id, and forms, are dropped only once the page is read and its text is
weighed, see Page._stays: one with more than half of the page's text outside links stays if it holds the h1, an article or
main. Headings never go, paragraphs and other blocks of running text only where a whole class is such a word, and
sections whose names hold one among others (related-work) only where links are much of their text. A class that says
something about other parts (no-sidebar, comments-open) doesn't count.

Defined results: a null or empty html gives an empty text; a null url (or one without a host) votes with others of its
kind; of paths with equal votes the first by name wins, of containers with equal scores the first in the page; malformed
markup is read as far as it goes, time is linear in its length; repeated rows are separate pages; an empty table gives
an empty result; other columns don't matter; very long or deep pages are read whole.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import stored

CONSENSUS = 0.01
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article blockquote body center div main section td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("aside button canvas dialog footer head iframe input label menu nav noscript object option script select style svg template textarea title".split())
#: Class and id words of parts that are no article text.
OTHER = frozenset("ad ads adv advert advertisement advertising adsense banner banners breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar warning widget".split())
#: Those of them that make an article element one of the others; its layout words don't.
NO_ARTICLE = frozenset("advert advertisement comment comments promo promoted related reply sponsored teaser".split())
#: Those of them that name other parts of a page in any compound, as in comments-area; the rest may be a subject, as in related-work.
PLAIN = frozenset("ad ads advert advertisement breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr modal nav navbar navigation newsletter outbrain pagination popup sidebar signup sponsored subscribe taboola widget".split())
#: Blocks that keep their text whatever their id is.
RUNNING = frozenset("blockquote caption dd dl dt figcaption figure hgroup li p pre table tbody td tfoot th thead tr".split())
#: Share of a doubtful section's text in links from which on it goes.
LINKED = 0.4
#: Words of a class that says something about the parts it names, as in has-sidebar.
ABOUT = frozenset("closed disabled enabled has have is no not open with without".split())
_TAG = re.compile("<[A-Za-z/!?]")
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: A start tag closes these open elements, up to the named limits.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


@functools.lru_cache(maxsize=1 << 14)
def _part_names(values: str) -> tuple[frozenset[str], frozenset[str]]:
    """The words of OTHER that are a class or id by themselves, and those that are in one among other words."""
    whole, among = set(), set()
    for value in values.split():
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
        if len(words) == 1 or value.lower() in OTHER:
            whole |= OTHER.intersection(words)
        elif ABOUT.isdisjoint(words):
            among |= OTHER.intersection(words)
    return frozenset(whole), frozenset(among)


def _readable(html: str) -> str:
    """html without what a parser looks through again and again to no end: tags and comments that never close."""
    close = html.rfind("-->") + 1
    first = html.find("<!--", close)
    if first >= 0:
        html = html[: first + 4] + html[first + 4 :].replace("<!--", "")
    end = html.rfind(">") + 1
    tag = _TAG.search(html, end)
    return html[: tag.start()] if tag else html


@functools.lru_cache(maxsize=1 << 14)
def _name(tag: str, classes: str) -> str:
    """The step of a path: the tag with its classes, digits generalised."""
    return tag + "".join("." + re.sub(r"\d+", "#", c).replace(">", "_") for c in sorted(classes.split()))


class Page(HTMLParser):
    """Blocks of text with the containers around them."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, int, bool, int]] = []  # tag, container, dropped, other part, in an article, last block's place
        self.open: dict[str, list[int]] = defaultdict(list)  # places of the open elements of a tag
        self.names, self.parents, self.tags = [""], [0], [""]
        self.others: list[list] = [[0, False, False, False, 0, 0]]  # the one around it, a form, doubtful, has a landmark, text, text in links
        self.parts: list[tuple[int, list]] = []  # container, pieces of text
        self.text: list[tuple[int, str, bool]] = []  # other part, text, in a link
        self.where = self.links = 0
        self.feed(_readable(html))
        self.close()
        self._flush()
        self.blocks = self._kept()  # container, text, characters in links

    def parse_html_declaration(self, i: int) -> int:
        """Sections such as <![if ...]> and <![CDATA[ are comments up to the next '>', as in browsers."""
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def _here(self) -> tuple[int, bool, int]:
        return self.stack[-1][1:4] if self.stack else (0, False, 0)

    def _flush(self) -> None:
        if self.text:
            self.parts.append((self.where, self.text))
            self.text = []

    def _add(self, data: str) -> None:
        if not self.text:
            self.where = self._here()[0]
        self.text.append((self._here()[2], data, self.links > 0))

    def _stays(self) -> list[bool]:
        """Whether each of the other parts stays: a doubtful one without many links, or one that has more than half of the text
        and a landmark, or is a form. If that leaves no text, half is enough."""
        if len(self.others) == 1:
            return [True]
        for _, pieces in self.parts:
            for other, data, linked in pieces:
                self.others[other][5 if linked else 4] += len(" ".join(data.split()))
        for x in reversed(self.others[1:]):  # a part comes after the one around it
            self.others[x[0]][4] += x[4]
            self.others[x[0]][5] += x[5]
        for strict in (True, False):
            stays = [True]
            for around, form, doubtful, landmark, text, links in self.others[1:]:
                most = 2 * text > self.others[0][4] and (landmark or form or not strict)
                stays.append(stays[around] and (most or doubtful and links < LINKED * (text + links)))
            if any(stays[other] and data.strip() for _, pieces in self.parts for other, data, _ in pieces):
                break
        return stays

    def _kept(self) -> list[tuple[int, str, int]]:
        stays, out = self._stays(), []
        for where, pieces in self.parts:
            pieces = [x for x in pieces if stays[x[0]]]
            text = " ".join("".join([x[1] for x in pieces]).split())
            if text:
                out.append((where, text, min(sum(len(x[1]) for x in pieces if x[2]), len(text))))
        return out

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self._add(" ")
        if tag in VOID and tag != "hr":
            return
        if tag in BLOCKS or tag in DROPPED:
            self._flush()
        if tag in BLOCKS:
            self._close_to({"p"}, {"button", "table", "object", "article", "section", "div", "li", "td"} - {tag})
        if tag in CLOSES:
            self._close_to(*CLOSES[tag])
        if tag == "hr":
            return
        container, dropped, other = self._here()
        inside, block = self.stack[-1][4:] if self.stack else (False, -1)
        values = {k: v or "" for k, v in attrs}
        dropped = dropped or tag in DROPPED or tag not in ("html", "body", "main", "h1") and ("hidden" in values or values.get("role") in ROLES)
        dropped = dropped or tag == "header" and not inside
        names, doubtful = (frozenset(), False) if dropped else self._other(tag, values, inside)
        if names or tag == "form" and not dropped:
            self.others.append([other, tag == "form", doubtful, tag == "article", 0, 0])
            other = len(self.others) - 1
        elif tag in ("h1", "main", "article") and not dropped:
            self._landmark(other)
        if tag in CONTAINERS:
            self.names.append(_name(tag, values.get("class", "")))
            self.parents.append(container)
            self.tags.append(tag)
            container = len(self.names) - 1
        self.links += tag == "a"
        self.open[tag].append(len(self.stack))
        block = len(self.stack) if tag in BLOCKS else block
        self.stack.append((tag, container, dropped, other, inside or tag in ("article", "main"), block))

    def _landmark(self, other: int) -> None:
        """Notes a landmark in the part and those around it, up to one that has it already."""
        while other and not self.others[other][3]:
            self.others[other][3] = True
            other = self.others[other][0]

    @staticmethod
    def _other(tag: str, values: dict, inside: bool) -> tuple[frozenset[str], bool]:
        """The words that make this element one of the other parts, and whether they leave it in doubt."""
        if tag in ("html", "body", "main", "header", "h1", "h2", "h3", "h4", "h5", "h6") or "class" not in values and "id" not in values:
            return frozenset(), False
        whole, among = _part_names(values.get("class", ""))
        if tag in RUNNING:
            return whole, False
        whole_id, among_id = _part_names(values.get("id", ""))
        whole, among_id = whole | whole_id, among_id - among
        if tag == "article":
            return (whole | among) & NO_ARTICLE, False
        if tag == "section" or inside:
            # what is in doubt goes only with its links
            sure = whole | (among if tag != "section" else among & PLAIN) | among_id & PLAIN
        else:
            sure = whole | among | among_id
        names = whole | among | among_id
        if inside:
            names, sure = names - {"header"}, sure - {"header"}
        return names, not sure

    def _last(self, tags: set) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _close_to(self, tags: set, limits: set) -> None:
        at = self._last(tags)
        if at >= 0 and at > self._last(limits - tags):
            self._cut(at)

    def _cut(self, at: int) -> None:
        for x in reversed(self.stack[at:]):
            self.open[x[0]].pop()
            self.links -= x[0] == "a"
        del self.stack[at:]

    def handle_endtag(self, tag: str) -> None:
        at = self._last({tag})
        if at < 0 or tag not in BLOCKS and tag not in DROPPED and self.stack[-1][5] > at:
            return
        if any(x[0] in BLOCKS or x[0] in DROPPED for x in self.stack[at:]):
            self._flush()
        self._cut(at)

    def handle_data(self, data: str) -> None:
        if self._here()[1]:
            return
        self._add(data)

    def path(self, container: int) -> str:
        steps = []
        while container:
            steps.append(self.names[container])
            container = self.parents[container]
        return ">".join(reversed(steps))

    def best(self) -> int:
        """The container that has most of the text in and just below it, or the article around it; 0 for none."""
        own, whole = [0.0] * len(self.names), [0.0] * len(self.names)
        for where, text, linked in self.blocks:
            worth = len(text) - 2 * linked
            own[where] += worth
            own[self.parents[where]] += worth / 2
            whole[where] += worth
        for k in range(len(whole) - 1, 0, -1):  # a container comes after the one around it
            whole[self.parents[k]] += whole[k]
        if len(own) == 1 or not self.blocks:
            return 0
        at = max(range(1, len(own)), key=lambda k: (own[k] * (1.2 if self.tags[k] in ("article", "main") else 1), -k))
        up = at
        while up:
            if self.tags[up] == "article":
                return up
            up = self.parents[up]
        while self.parents[at] and self.tags[self.parents[at]] != "body" and whole[self.parents[at]] <= 1.4 * whole[at]:
            at = self.parents[at]
        return at

    def extract(self, paths: "Paths | list[str]") -> str:
        """The blocks below the most voted of the paths that the page has, or below its best container, in page order."""
        at = (paths if isinstance(paths, Paths) else Paths(paths)).of(self)
        own = [] if at else [self.best()]
        at = at or [k in own for k in range(len(self.names))]
        inside = [own == [0]]
        for k in range(1, len(self.names)):
            inside.append(at[k] or inside[self.parents[k]])
        return "\n".join(text for where, text, _ in self.blocks if inside[where])


class Paths:
    """The paths of a host as a tree of steps, so that a page's containers are looked up along their parents'."""

    def __init__(self, paths: list[str]) -> None:
        self.steps: dict[tuple[int, str], int] = {}
        self.rank: dict[int, int] = {}
        for n, path in enumerate(paths):
            node = 0
            for step in path.split(">"):
                node = self.steps.setdefault((node, step), len(self.steps) + 1)
            self.rank.setdefault(node, n)

    def of(self, page: Page) -> list[bool]:
        """Whether each container of the page is the path of the first rank that the page has; empty if it has none."""
        if not self.rank:
            return []
        nodes = [0]
        for k in range(1, len(page.names)):
            above = nodes[page.parents[k]]
            nodes.append(self.steps.get((above, page.names[k]), -1) if above >= 0 else -1)
        ranks = [self.rank.get(node, len(self.steps)) for node in nodes]
        first = min(ranks)
        return [r == first for r in ranks] if first < len(self.steps) else []


def _vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = [_best_path(x.as_py()) for x in batch["html"]]
        yield pa.RecordBatch.from_arrays([batch["host"], pa.array(paths, pa.string())], ["host", "path"])


def _best_path(html: str | None) -> str:
    page = Page(html or "")
    return page.path(page.best())


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, Paths] = {}
    for batch in batches:
        texts = []
        for html, host, paths in zip(batch["html"], batch["host"].to_pylist(), batch["paths"], strict=True):
            if host not in known:
                known = known if len(known) < 10_000 else {}
                known[host] = Paths(paths.as_py() or [])
            texts.append(Page(html.as_py() or "").extract(known[host]))
        arrays = [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host and paths: the container paths that have CONSENSUS of each host's votes, in order of votes."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_vote, "host string, path string")
    counted = stored(votes.where("path != ''").groupBy("host", "path").agg(F.count("*").alias("votes")), "votes")
    # a table of its own, so that Spark may split the paths of a host that very many pages are of
    hosts = stored(counted.groupBy("host").agg(F.sum("votes").alias("all")), "hosts")
    some = counted.join(hosts, "host").where(F.col("votes") >= CONSENSUS * F.col("all"))
    lists = some.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("n"), "path"))).alias("x"))
    return lists.select("host", F.transform("x", lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    paths = stored(host_paths(pages), "host-paths")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(paths, "host", "left")
    return rows.select("page_id", "url", "html", "host", "paths").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
