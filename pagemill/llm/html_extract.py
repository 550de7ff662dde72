"""Main text of web pages by paths that a host's pages agree on.

Each page's containers are scored by the text they hold less their links. The
best ones vote with the path of tags and generalised classes that leads to
them, votes are summed by host in Spark, and each page is then extracted again
at the winning path of its host; a page that has no such container, or holds
little of its text there, falls back to its own best one.

What is never article text (menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts, styles) is left out by tag and role. A class
or id is only taken at its word if all of it speaks of such parts ("share
buttons"); where it may mean something else ("related-work", "legal"), the
element's text decides: prose with few links stays.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import cut, looked_up, small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Elements that close an open p.
CLOSES_P = BLOCKS - frozenset("td th tr tbody tfoot thead caption body html legend summary".split())
#: An open element of the first kind ends where one of the second begins, within the scope of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NOT_TEXT = frozenset(
    "script style head title template noscript iframe object embed svg canvas audio video map nav menu footer aside form "
    "button select textarea input dialog noembed noframes datalist".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search menu menubar toolbar dialog alertdialog alert form tablist".split()
)
#: Words of a class or id that say that an element isn't article text.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promoted "
    "promotion banner nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs crumbs sidebar sidebars aside "
    "rail footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup "
    "popover modal overlay lightbox newsletter subscribe subscription signup login signin register share sharing social "
    "related recommended recommendations recommends trending popular comment comments commentlist respond disqus reply "
    "replies discussion pagination pager paging search searchform searchbox widget widgets tags tagcloud skip hidden "
    "copyright legal disclaimer paywall teaser outbrain taboola form".split()
)
#: Those that say so whatever stands beside them and however much text there is.
NEVER = frozenset("comment comments commentlist disqus advert advertisement advertising cookie cookies".split())
#: Those that are names of a topic as well: never taken at their word.
TOPICS = frozenset(
    "related recommended recommendations trending popular legal disclaimer form widget widgets notice notices alert notification "
    "copyright discussion reply replies respond register search tags rail promotion navigation consent subscription hidden teaser".split()
)
#: Heads of an article are part of it.
HEADS = frozenset("header head".split())
#: Words that say nothing of the kind of an element.
FILLERS = frozenset(
    "area bar block box button buttons card cards center col column container content data entry fixed global group heading holder icon "
    "icons inner item items js left link links list listing main medium mobile module modules outer page panel post posts article articles "
    "story stories primary reader readers right row secondary section site slot small sticky tag text thread title top bottom unit user "
    "users view wrap wrapper zone has is with the a of and id large desktop side body cta".split()
)
#: Text with less of it in links, of at least so many characters and sentences, is prose.
LINKED, PROSE, SENTENCES = 0.3, 80, 1
#: Words that say the contrary.
ARTICLE = frozenset("article post content main body entry story text maincontent articlebody".split())
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…。！？](?:[\"'”’»)\]]*)(?:\s|$)")
CANDIDATES = frozenset("article main section div td body blockquote".split())
#: Containers vote if their score is at least this part of the page's best one's.
VOTES_FROM = 1 / 3
#: A page's text at the host's path counts if it is at least this part of the text of the page's own best container.
SHARE_AT_PATH = 0.1


@dataclass
class Node:
    """An element, or a piece of text (``tag`` is empty)."""

    tag: str
    parent: Node | None = None
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    text: str = ""
    skipped: bool = False


def _attributes(raw: str) -> dict[str, str]:
    out = {}
    for m in _ATTRIBUTE.finditer(raw):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
        out.setdefault(m[1].lower(), entities.unescape(value or ""))
    return out


def _tokens(node: Node) -> list[set[str]]:
    """The words of each class, and of the id."""
    said = f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}"
    return [set(_WORD.findall(_CAMEL.sub("-", t).lower())) for t in said.split()]


def _names(node: Node) -> set[str]:
    return set().union(*_tokens(node)) if node.attributes else set()


#: What a class or id says of an element: nothing; a topic among other words; something that may be meant otherwise; boilerplate.
NOTHING, TOPIC, PERHAPS, OTHER = range(4)


def _said_to_be_other(node: Node, in_article: bool) -> int:
    found = NOTHING
    for words in _tokens(node):
        of = words & BOILERPLATE
        if in_article or words & ARTICLE:
            of = of - HEADS
        pure = words <= BOILERPLATE | FILLERS
        if of & NEVER or (of - TOPICS and pure):
            return OTHER
        found = max(found, (PERHAPS if pure or of - TOPICS else TOPIC) if of else NOTHING)
    return found


@dataclass
class Held:
    """What an element's text is like: its characters, those in links, and ends of sentences."""

    chars: int = 0
    linked: int = 0
    sentences: int = 0

    @property
    def prose(self) -> bool:
        return self.chars >= PROSE and self.sentences >= SENTENCES and self.linked < LINKED * self.chars


def _left_out(node: Node, in_article: bool, root: Node, text_of: Callable[[Node], Held]) -> bool:
    """Whether an element is never part of the article; what its text is like is only asked for where that matters."""
    if node.tag in NOT_TEXT:
        return True
    if node.tag == "header":
        return not in_article
    if not node.attributes or node.tag in ("html", "body"):
        return False
    a = node.attributes
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    if node.tag in ("article", "main"):
        return False
    said = _said_to_be_other(node, in_article)
    if said == NOTHING:
        return False
    if said == TOPIC:
        return text_of(node).linked >= LINKED * max(1, text_of(node).chars)
    if said == PERHAPS:
        return not text_of(node).prose
    # a wrapper may be called after what it stands beside ("content has-sidebar"): one that holds most of the page stays
    names = _names(node)
    return bool(names & NEVER) or not (names & ARTICLE and text_of(node).chars > 0.5 * text_of(root).chars)


class _Tree:
    """The open elements while a page is read; counts by tag spare walks that would find nothing."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.open = [self.root]
        self.count = {"html": 1}

    def pop_to(self, i: int) -> None:
        for node in self.open[i:]:
            self.count[node.tag] -= 1
        del self.open[i:]

    def close(self, tags: frozenset[str] | set[str], scope: frozenset[str] | set[str]) -> None:
        """End the innermost open element of ``tags``, if none of ``scope`` is inside it."""
        if not any(self.count.get(t) for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                return self.pop_to(i)
            if tag in scope:
                return None

    def end(self, tag: str) -> None:
        if self.count.get(tag) and tag != "html":
            self.close({tag}, frozenset() if tag in BLOCKS else frozenset({"td", "th", "table"}))

    def begin(self, tag: str, raw: str, leaf: bool) -> None:
        if tag == "html":
            self.root.attributes |= _attributes(raw)
            return
        if tag in CLOSES_P:
            self.close({"p"}, BLOCKS - {"p"})
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
        if tag == "body":
            self.close({"head"}, frozenset())
        node = Node(tag, self.open[-1], _attributes(raw) if raw.strip("/ ") else {})
        self.open[-1].children.append(node)
        if not leaf:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1


def parse(page: str) -> Node:
    """The element tree of a page. Broken markup gives some tree; nothing is an error.

    Comments and tags that don't end go on to the end of the page, as browsers
    have it; a tag with an unended quotation ends at its first ``>``.
    """
    tree, at, text_from, n, quoted = _Tree(), 0, 0, len(page), True

    def text(upto: int) -> None:
        if upto > text_from:
            tree.open[-1].children.append(Node("", tree.open[-1], text=page[text_from:upto]))

    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            begin = at + 4
            end = begin if page.startswith(">", begin) else page.find("-->", begin)
            stop = n if end < 0 else page.index(">", end) + 1
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            stop = n if end < 0 else end + 1
        elif (m := _NAME.match(page, at)) is None:
            at += 1
            continue
        else:
            end = _INSIDE.match(page, m.end()).end() if quoted else -1
            if not 0 <= end < n or page[end] != ">":
                quoted, end = quoted and 0 <= end < n, page.find(">", m.end())
            stop = n if end < 0 else end + 1
            text(at)
            tag = m[1].lower()
            if end >= 0:
                raw = page[m.end() : end]
                if page[at + 1] == "/":
                    tree.end(tag)
                else:
                    tree.begin(tag, raw, tag in VOID or tag in RAW or (raw.endswith("/") and tag not in BLOCKS))
                    if tag in RAW:
                        close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, stop)
                        stop = close.end() if close else n
            at = text_from = stop
            continue
        text(at)
        at = text_from = stop
    text(n)
    _skip(tree.root)
    return tree.root


def _texts(root: Node) -> dict[int, Held]:
    """What the text of each element is like, comments left out."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if c.tag and c.tag not in NOT_TEXT)
    held: dict[int, Held] = {}
    for node in reversed(order):
        of = held[id(node)] = Held()
        if node.attributes and node.tag not in ("html", "body") and _names(node) & NEVER:
            continue
        for c in node.children:
            if c.tag:
                below = held.get(id(c), Held())
                of.chars, of.linked, of.sentences = of.chars + below.chars, of.linked + below.linked, of.sentences + below.sentences
            else:
                text = c.text.strip()
                of.chars, of.sentences = of.chars + len(text), of.sentences + len(_SENTENCE.findall(text))
        if node.tag == "a":
            of.linked = of.chars
    return held


def _skip(root: Node) -> None:
    held: dict[int, Held] = {}

    def text_of(node: Node) -> Held:
        if not held:  # for the first element that calls for it
            held.update(_texts(root))
        return held[id(node)]

    waiting = [(root, False)]
    while waiting:
        node, inside = waiting.pop()
        inside = inside or node.tag in ("article", "main")
        for child in node.children:
            if child.tag:
                child.skipped = _left_out(child, inside, root, text_of)
                if not child.skipped:
                    waiting.append((child, inside))


def blocks(node: Node) -> list[str]:
    """The text of each block, in page order, without what is left out."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            if text:
                out.append(text)
            run.clear()

    stack: list[tuple[Node, bool]] = [(node, True)]
    while stack:
        now, opening = stack.pop()
        if not now.tag:
            run.append(now.text)
            continue
        if now.tag in BLOCKS:
            close()
        elif now.tag == "br":
            run.append(" ")
        if opening and not now.skipped:
            if now.tag in BLOCKS:
                stack.append((now, False))
            stack.extend((child, True) for child in reversed(now.children))
    close()
    return out


def step(node: Node) -> str:
    """An element's tag with its generalised classes: words only, in order, without numbers."""
    names = [re.sub(r"[\d/]+", "#", c) for c in node.attributes.get("class", "").split()]
    return ".".join([node.tag.replace("/", "#"), *sorted(set(names))])


def path(node: Node) -> str:
    steps = []
    while node is not None and node.parent is not None:
        steps.append(step(node))
        node = node.parent
    return "/".join(reversed(steps))


def scored(root: Node) -> list[tuple[float, Node]]:
    """(score, container), best first: the text directly in a container's blocks or in its
    paragraphs, less the text of links; half of a child container's goes to its parent."""
    found: list[tuple[float, Node]] = []
    own: dict[int, float] = {}
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if c.tag and not c.skipped)
    for node in reversed(order):
        direct = sum(len(c.text.strip()) for c in node.children if not c.tag)
        total = float(direct)
        for c in node.children:
            if c.tag and not c.skipped:
                share = own.get(id(c), 0.0)
                total += 0.6 * share if c.tag in CANDIDATES else share
        if node.tag == "a":
            total *= -0.25
        own[id(node)] = total
        if node.tag in CANDIDATES and total > 0:
            names = _names(node)
            bonus = 1.5 if node.tag in ("article", "main") or (names & ARTICLE and not names & BOILERPLATE) else 1.0
            found.append((total * bonus, node))
    found.sort(key=lambda x: -x[0])
    return found


def votes(page: str | None) -> list[tuple[str, float]]:
    """(path, share of the page's votes) of its best container and of those that score nearly as well."""
    best = scored(parse(page or ""))
    best = [(s, n) for s, n in best if s >= VOTES_FROM * best[0][0]]
    total = sum(s for s, _ in best)
    return [(path(n), s / total) for s, n in best]


def extract(page: str | None, winner: str | None) -> tuple[str, bool]:
    """(the page's text, whether it was found at the winning path)."""
    root = parse(page or "")
    at: list[Node] = []
    if winner is not None:
        steps = winner.split("/") if winner else []
        stack = [(root, 0)]
        while stack:
            node, depth = stack.pop()
            if depth == len(steps):
                at.append(node)
                continue
            below = (c for c in reversed(node.children) if c.tag and not c.skipped)
            stack.extend((c, depth + 1) for c in below if step(c) == steps[depth])
    text = "\n".join(t for node in at for t in blocks(node))
    # a page of another template may have some small block at the path
    if text and len(text) >= SHARE_AT_PATH * _chars(root):
        return text, True
    best = scored(root)[:1]
    own = "\n".join(blocks(best[0][1] if best else root))
    return (text, True) if text and len(text) >= SHARE_AT_PATH * len(own) else (own, False)


def _chars(root: Node) -> int:
    """Characters of all that isn't left out, markup and entities apart."""
    n, stack = 0, [root]
    while stack:
        for c in stack.pop().children:
            if not c.tag:
                n += len(c.text)
            elif not c.skipped:
                stack.append(c)
    return n


def host_of(url) -> F.Column:
    """The host of a url, in lower case; the empty string for none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, winner, pages): the path with most votes of each host's pages, ties to the smaller
    path, and how many pages the host has; null for the path if no page has a container.

    A page's votes are divided among its containers, and summed by host and
    path before they are shuffled, so a host with very many pages is no more
    to its task than one with few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches([whole], "html"):
                out = []
                for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                    out.append((host, None, None, 1))
                    out += [(host, p, s, 0) for p, s in votes(page)]
                kinds = (pa.string(), pa.string(), pa.float64(), pa.int64())
                names = ["host", "path", "share", "pages"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)

    cast = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, share double, pages long")
    votes_of = F.sum(F.round(F.col("share") * 1_000_000).cast("long")).alias("votes")
    summed = cast.groupBy("host", "path").agg(votes_of, F.sum("pages").alias("pages"))
    least = F.when(F.col("path").isNotNull(), F.struct(-F.col("votes"), F.col("path")))
    return summed.groupBy("host").agg(F.min_by("path", least).alias("winner"), F.sum("pages").alias("pages"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", small: bool | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, at_host_path) of each page.

    Blocks are joined by a line feed, white space inside a block is one space,
    character references are decoded. Null and empty html give an empty text;
    null urls share a host of their own. Pages of any length are taken whole.
    Repeated rows are returned each; ties of votes go to the smaller path; no
    rows give none. Other columns are ignored, whatever their names. Html
    stays where it is while the hosts prove few (see ``looked_up``).
    """
    given = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    winners = cut(winning_paths(given))
    named = given.withColumn("host", host_of(F.col("url")))
    joined = looked_up(named, winners, "host", "pages", small).select("page_id", "url", "html", "winner")
    kind = pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches([whole], "html"):
                found = [extract(p, w) for p, w in zip(batch.column("html").to_pylist(), batch.column("winner").to_pylist())]
                texts = [t for t, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page_id"), batch.column("url"), pa.array(texts, kind),
                        pa.array([len(t) for t in texts], pa.int64()), pa.array([h for _, h in found], pa.bool_()),
                    ],
                    names=["page_id", "url", "text", "n_chars", "at_host_path"],
                )

    kept = given.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kept}, url string, text string, n_chars long, at_host_path boolean")
