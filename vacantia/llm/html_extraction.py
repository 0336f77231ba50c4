"""Main text of web pages by consensus host paths.

First pass: every page is read into blocks and containers, and each container
gets the share of the page's prose it holds less the share of its other text,
lowered if its names point to furniture. The good containers that hold no other
good one vote for their generalised path (tags and classes, digits and hash-like
names masked), and Spark adds the votes up per host. Second pass: a page's text is
taken from the containers with the host's best path that the page has; where it
has none, or there is hardly prose in them, from its own best container and those
that share its path. Menus, notices and other furniture inside are left out.

Names mark furniture only if nothing else is in them ("cookie-notice", "ad-box",
but not "notice-board-story"), and never at the cost of the whole page: if nothing
would be left of a page with prose, its names are not looked at.

A block is what stands between two block-level tags. Defined results: a null or
empty page, or one without text, gives the empty text; a page whose address is
null or has no host votes in a group of its own (host ""); repeated rows each
vote and each get a row; of paths with equal votes the first in the alphabet wins,
of containers with equal scores the innermost; unclosed tags end with their
container, a tag that never ends swallows the rest, as in browsers; pages of any
length are read whole, in time that grows with their length; an empty table gives
an empty table; columns beyond the three are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import text_batches, tune_arrow
from vacantia.session import settled

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute, as browsers read them: a quoted value runs to its quote, a bare one to a blank or the end of the tag.
ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)|(?=>)))?+)")
SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TOKENS = re.compile(r"\S+")
#: Parts of a name that look made by a build tool: a digit before a letter, or capitals scattered over a few letters.
HASHED = re.compile(r"(?=[A-Za-z\d]*\d[A-Za-z])[A-Za-z\d]{5,}|(?=.{5,8}$)[A-Za-z]*[a-z][A-Z]+[a-z]+[A-Z][A-Za-z]*")
LONG_NAME = 100

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp noscript iframe template".split())
CONTAINERS = frozenset("body main article section div td center blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p pre blockquote li dd dt figcaption td th".split())
#: Opening one of these ends an open one of the listed elements, up to the next container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SHUT = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
FURNITURE_TAGS = frozenset("nav footer aside form button select menu dialog svg head script style noscript iframe template textarea title object canvas".split())
#: Words of class, id and role that mark furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside complementary menu menus nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer contentinfo cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog newsletter subscribe subscription "
    "signup login form search share sharing social related recommended recommendations comment comments disqus reply replies respond widget toolbar pagination pager skip copyright".split()
)
#: Words that wrappers of an article carry too ("has-sidebar"); they don't count if an article lies inside.
LAYOUT_WORDS = frozenset("sidebar header menu nav navbar navigation search login related share widget ad ads banner toolbar".split())
#: Words of names that say where or what shape something is, and words of things that an article is.
PLAIN_WORDS = frozenset(
    "box bar list item items section container wrapper wrap block area links link posts results content body inner outer panel buttons button icons icon top bottom left right "
    "site page main global local primary secondary fixed sticky small large row col column group title text card view js is no".split()
)
STORY_WORDS = frozenset("article story post entry prose chapter".split())
#: A path wins if it has this share of the votes of its host's best path.
WINNING = 0.1
#: A container votes if it scores this share of its page's best.
VOTING = 0.5
#: Winners with less than this share of the page's prose are passed over.
SPARSE = 0.2
#: Longer paths are carried as digests.
LONG_PATH = 300


@dataclass
class Node:
    tag: str
    parent: int
    path: str
    furniture: bool  # by its tag, or hidden
    named: bool = False  # by its names
    hinted: bool = False  # names that hold words of furniture among others
    prose: float = 0.0
    other: float = 0.0
    pardoned: bool = False  # furniture only by words that also name layouts
    article: bool = False  # an article lies inside
    heading: bool = False


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)


@dataclass
class Names:
    """What the attributes of a tag say."""

    classes: str = ""
    hidden: bool = False
    named: bool = False
    hinted: bool = False
    pardoned: bool = False


def tag_end(source: str, position: int) -> tuple[int, dict[str, str]]:
    """Where a tag ends and its attributes, the first of each name; each character is passed once."""
    found: dict[str, str] = {}
    end = len(source)
    while position < end:
        match = ATTRIBUTE.match(source, position)
        if not match:
            # an "=" before any name, or a quote that isn't closed
            if source.find("\"", position) < 0 and source.find("'", position) < 0:
                shut = source.find(">", position)
                return (shut + 1 if shut >= 0 else end), found
            return end, found
        position = match.end()
        if match[1]:
            return position, found
        after = source[position : position + 1]
        if match[3] is None and match[4] is None and match[5] is None and after in "=\"'":
            rest = source[position:].lstrip("= \t\n\r\f")[:1]
            if rest in ("\"", "'"):
                return end, found
            position += 1
        found.setdefault(match[2].lower(), match[3] or match[4] or match[5] or "")
    return end, found


def masked(name: str) -> str:
    """A class without what differs from page to page."""
    if len(name) > LONG_NAME:
        return "~"
    parts = re.split(r"([-_]+)", name)
    return "".join("~" if HASHED.fullmatch(p) else re.sub(r"\d+", "#", p) for p in parts)


def read_names(attributes: dict[str, str]) -> Names:
    """Generalised classes, and whether the names of a tag mark furniture."""
    out = Names()
    if value := attributes.get("class"):
        out.classes = "." + ".".join(sorted({masked(c) for c in value.split()}))
    out.hidden = "hidden" in attributes or attributes.get("aria-hidden", "false").lower() != "false"
    marking: set[str] = set()
    for name in ("class", "id", "role"):
        for token in TOKENS.findall(attributes.get(name, "")):
            words = [w.lower() for w in SPLIT.findall(token)]
            held = [w for w in words if w in FURNITURE_WORDS]
            if not held:
                continue
            telling = [w for w in words if w not in PLAIN_WORDS]
            if all(w in FURNITURE_WORDS or w in STORY_WORDS for w in telling) and telling[-1] in FURNITURE_WORDS:
                out.named = True
                marking.update(held)
            else:
                out.hinted = True
    out.pardoned = not out.hidden and marking <= LAYOUT_WORDS
    return out


def parsed(source: str) -> Page:
    """Blocks and elements of a page; every tag is looked at once."""
    page = Page([Node("body", -1, "body", False)])
    stack, pieces, links = [0], [], []
    open_tags: dict[str, int] = {}
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            at = stack[-1]
            page.blocks.append((at, text))
            share = min(1.0, sum(links) / len(text))
            tag = page.nodes[at].tag
            prose = len(text) * (1 - share) if tag in PROSE or len(text) >= 80 else 0.0
            page.nodes[at].prose += prose
            page.nodes[at].other += len(text) - prose
        pieces.clear()
        links.clear()

    def close(upto: int) -> None:
        for at in stack[upto:]:
            open_tags[page.nodes[at].tag] -= 1
        del stack[upto:]

    position, end = 0, len(source)
    while position < end:
        start = source.find("<", position)
        run = source[position : start if start >= 0 else end]
        if run:
            pieces.append(run)
            if linked:
                links.append(len(run))
        if start < 0:
            break
        closing = source.startswith("/", start + 1)
        name = NAME.match(source, start + 1 + closing)
        if not name:
            if source.startswith("<!--", start):
                shut = source.find("-->", start + 2)
                position = shut + 3 if shut >= 0 else end
            elif closing or source.startswith(("!", "?"), start + 1):
                shut = source.find(">", start)
                position = shut + 1 if shut >= 0 else end
            else:
                pieces.append("<")
                position = start + 1
            continue
        tag = name[0].lower()
        position, attributes = tag_end(source, name.end())
        if closing:
            if tag == "a":
                linked = 0
            if tag in INLINE:
                continue
            flush()
            if not open_tags.get(tag):
                continue
            for k in range(len(stack) - 1, 0, -1):
                open_tag = page.nodes[stack[k]].tag
                if open_tag == tag:
                    close(k)
                    break
                if open_tag in CONTAINERS and tag not in CONTAINERS and tag not in FURNITURE_TAGS:
                    break
            continue
        if tag in RAW:
            shut = SHUT[tag].search(source, position)
            position = (source.find(">", shut.end()) + 1 or end) if shut else end
            continue
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                linked = 1
            continue
        flush()
        linked = 0
        if tag in VOID or tag in ("html", "body"):
            if tag == "body":
                close(1)
            continue
        ends = [t for t in (*CLOSES.get(tag, ()), "p", *HEADINGS) if open_tags.get(t)]
        for k in range(len(stack) - 1, 0, -1) if ends else ():
            open_tag = page.nodes[stack[k]].tag
            if open_tag in ends:
                close(k)
                break
            if open_tag in CONTAINERS or open_tag in ("ul", "ol", "dl", "table"):
                break
        names = read_names(attributes)
        whole = f"{page.nodes[stack[-1]].path}>{tag}{names.classes}"
        if len(whole) > LONG_PATH:
            whole = hashlib.sha256(whole.encode()).hexdigest()
        node = Node(tag, stack[-1], whole, names.hidden or tag in FURNITURE_TAGS or tag == "header", names.named, names.hinted, pardoned=names.pardoned)
        node.article = tag in ("article", "main") and not names.named and not names.hidden
        node.heading = tag in HEADINGS
        page.nodes.append(node)
        stack.append(len(page.nodes) - 1)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    _clean(page)
    return page


def _clean(page: Page) -> None:
    """Pass furniture down to what lies in it, and text up to the containers around it."""
    for node in reversed(page.nodes[1:]):
        up = page.nodes[node.parent]
        up.article, up.heading = up.article or node.article, up.heading or node.heading
    prose = [node.prose for node in page.nodes]
    other = [node.other for node in page.nodes]
    by_tag = [False] * len(page.nodes)
    inside = [False] * len(page.nodes)
    for names in (True, False):
        for i, node in enumerate(page.nodes):
            node.prose, node.other = prose[i], other[i]
            if i:
                up = page.nodes[node.parent]
                inside[i] = inside[node.parent] or node.tag in ("article", "main")
                if names:
                    title = node.tag == "header" and node.heading and inside[i] and node.pardoned
                    wrapper = node.article and node.pardoned and node.tag not in FURNITURE_TAGS
                    by_tag[i] = node.furniture and not title
                    node.furniture = by_tag[i] or (node.named and not wrapper)
                else:
                    node.furniture = by_tag[i]
                node.furniture = node.furniture or up.furniture
                by_tag[i] = by_tag[i] or by_tag[node.parent]
            if node.furniture:
                node.other, node.prose = node.other + node.prose, 0.0
        for node in reversed(page.nodes[1:]):
            page.nodes[node.parent].prose += node.prose
            page.nodes[node.parent].other += node.other
        if page.nodes[0].prose > 0 or not any(prose):
            return


def scores(page: Page) -> dict[int, float]:
    """Share of the page's prose less share of its other text, for containers that hold prose; half if names hint at furniture."""
    whole = page.nodes[0]
    found = {}
    for i, node in enumerate(page.nodes):
        if node.prose > 0 and not node.furniture and node.tag in CONTAINERS:
            score = node.prose / whole.prose - (node.other / whole.other if whole.other else 0.0) * 0.5
            found[i] = score / 2 if node.hinted and score > 0 else score
    return found


def best(found: dict[int, float]) -> int:
    """The container with the highest score; of equal ones the innermost."""
    return max(found, key=lambda i: (round(found[i], 9), i)) if found else 0


def page_text(page: Page, winners: list[str]) -> str:
    """Text of the containers with the first winning path that holds enough prose, else of the page's best."""
    found = scores(page)
    top = best(found)
    by_path: dict[str, list[int]] = {}
    for i in found:
        by_path.setdefault(page.nodes[i].path, []).append(i)
    # an article in several parts: what shares the best container's path and is prose too, or is marked as an article
    same = [i for i, node in enumerate(page.nodes) if node.path == page.nodes[top].path]
    chosen = {top, *(i for i in same if found.get(i, 0.0) > 0 or page.nodes[i].tag in ("article", "main"))}
    for p in winners:
        own = by_path.get(p, [])
        if sum(page.nodes[i].prose for i in own) > SPARSE * page.nodes[top].prose:
            chosen = set(own)
            break
    held = [False] * len(page.nodes)
    for i, node in enumerate(page.nodes):
        held[i] = i in chosen or (i > 0 and held[node.parent])
    return "\n\n".join(text for at, text in page.blocks if held[at] and not page.nodes[at].furniture)


def page_votes(page: Page) -> dict[str, float]:
    """Votes of a page: its good containers that hold no other good one."""
    found = scores(page)
    least = VOTING * max(found.values(), default=0.0)
    good = {i for i, score in found.items() if score >= least and score > 0}
    above = [False] * len(page.nodes)
    for i in range(len(page.nodes) - 1, 0, -1):
        if above[i] or i in good:
            above[page.nodes[i].parent] = True
    outer = {i for i in good if above[i]}
    votes: dict[str, float] = {}
    for i in good - outer:
        votes[page.nodes[i].path] = votes.get(page.nodes[i].path, 0.0) + found[i]
    return votes


def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, votes) of a batch, added up before the shuffle."""
    for batch in text_batches(batches, limit=4 << 20):
        votes: dict[tuple[str, str], float] = {}
        for host, source in zip(batch.column("host").to_pylist(), batch.column("text").to_pylist()):
            for path, score in page_votes(parsed(source or "")).items():
                votes[host, path] = votes.get((host, path), 0.0) + score
        yield pa.record_batch(
            [pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.float64())],
            names=["host", "path", "votes"],
        )


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches):
        texts = [page_text(parsed(s or ""), w or []) for s, w in zip(batch.column("text").to_pylist(), batch.column("winners").to_pylist())]
        sizes = [len(t) for t in texts]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, winners): the paths that win a host's vote, best first."""
    votes = pages.mapInArrow(vote, "host string, path string, votes double").groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    votes = settled(votes, "votes")
    top = votes.groupBy("host").agg(F.max("votes").alias("top"))
    winning = votes.join(top, "host").filter(F.col("votes") >= WINNING * F.col("top"))
    by_votes = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("rank"), "path")))  # at most 1 / WINNING paths near the top a page
    return winning.groupBy("host").agg(F.transform(by_votes, lambda s: s["path"]).alias("winners"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    The winners are a written table of one row per host. Spark sends it to all
    tasks only if its files are under the broadcast limit; otherwise the join
    on the host is a shuffle whose hot hosts AQE splits.
    """
    tune_arrow(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("text"))
    winners = settled(host_paths(rows.select("host", "text")), "paths")
    kind = dict(pages.select(F.col(id_col).alias("i")).dtypes)["i"]
    return rows.join(winners, "host", "left").select("page_id", "url", "text", "winners").mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars bigint")
