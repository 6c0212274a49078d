"""Main text of web pages by consensus host paths.

1. Each page is parsed into containers (body, div, article, section, ...) and text blocks. Starting
   at the body, the deepest container that holds all its parent's good text (text outside links and
   boilerplate) is the page's candidate; the descent ends at an article or main at the latest. Its generalised path joins the tags and
   classes of the containers down to it, with digits in classes replaced by ``#``.
2. Every page votes for its candidate's path, with the candidate's good text as the vote's weight in
   case of a tie. Votes are summed for each host and path, and a host's winner is the path with most
   votes.
3. Every page is extracted again with its host's winner: the text blocks of the outermost containers
   with that path. A page without such a container, or with an empty one, falls back on its own
   candidate.

Boilerplate (menus, headers and footers of the page, sidebars, notices, adverts, forms, reader
comments) is left out wherever it stands; scripts, styles and markup never count as text. Tags, roles
and class names that can mean nothing else are certain. Names that can (``share``, ``side``, ``ad``)
are only a suspicion: as a whole name it holds unless nearly all of the page's text outside links
stands in such containers, and half in this one; as a part of a longer name (``share-price-report``) only where links or a few
characters are all that stands in it. The host's vote overrules suspicions: containers on its path
are never left out by their names.

Character references are decoded. Inside a block white space becomes one space; blocks are trimmed,
empty ones dropped, and the rest joined by a newline in page order.

Winners are broadcast up to a checked size in bytes and otherwise joined by a shuffle with each
winner given ``SALTS`` times, so that no task receives a hot host. A null or empty page has an empty
text, whatever its length a page is read whole, in memory in proportion to it; a null or odd url
shares the host ``''``; repeated rows vote once each and are extracted alike; an empty table gives an
empty result. Other columns pass through; result columns replace columns of their name.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldlake.llm.common import BROADCAST_LIMIT_BYTES, ascii_lower, bound_batches, free_name, materialise, release_memory

#: Copies of a winner, by task of the pages, where winners are joined by a shuffle.
SALTS = 32

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(noscript|template|iframe|svg|select|object)\b[^>]*(?<!/)>.*?(?:</\2\s*>|\Z)"
    r"|<[/!?]?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r"|<[/!?][^>]*>"
    r"|[^<]+"
    r"|<",
    re.DOTALL | re.IGNORECASE,
)
_TAG = re.compile(r"<(/?)\s*([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CONTAINERS = frozenset(
    "body div article main section nav header footer aside form table td th ul ol dl figure fieldset dialog details menu center".split()
)
_BLOCKS = _CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr thead tbody tfoot caption blockquote pre figcaption summary hr address legend html head option hgroup search".split()
)
#: Elements that a new element of the same group closes, and the containers that stop the search.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 dt".split())
_BOILER_TAGS = frozenset("nav footer aside form dialog menu button fieldset search".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar note toolbar".split())
#: Parts of names of containers that hold no article text, and those that may also mean something else.
_SURE_WORDS = frozenset(
    "nav menu menus footer foot masthead sidebar gdpr consent pagination pager toolbar replies respond disqus outbrain taboola toc signup".split()
)
_SURE_STARTS = (
    "advert", "sidebar", "comment", "cookie", "navi", "navbar", "menu", "footer", "promo", "sponsor", "newsletter",
    "breadcrumb", "subscri", "disclaimer",
)
_MAYBE_WORDS = frozenset(
    "ad ads adv banner header side rail popup modal overlay alert login share sharing social related recommended widget "
    "reply reactions skip form search hidden teaser".split()
)
_MAYBE_STARTS = ("notice", "notif")
#: Parts of names that say where or how a container stands, not what is in it.
_PLAIN_WORDS = frozenset(
    "site page main global primary secondary top bottom left right head body box wrap wrapper container content block area "
    "section region zone list item items bar inner outer unit slot col column row group panel button buttons link links post "
    "posts article articles entry blog user users reader readers js c m l the of and".split()
)
_FEW = 40  # characters outside links
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: How sure it is that a container is boilerplate.
NO, PART, NAME, SURE = range(4)


@dataclass(slots=True)
class Node:
    parent: int
    #: Number of the generalised path among the page's paths.
    path: int
    tag: str
    doubt: int
    in_article: bool
    boiler: bool = False
    chars: int = 0
    free: int = 0
    good: float = 0.0
    #: Whether good text stands in it outside its children.
    own: bool = False
    children: list[int] = field(default_factory=list)


def _attributes(tag: str) -> dict[str, str]:
    out: dict[str, str] = {}
    body = tag[_TAG.match(tag).end() : -1]
    for m in _ATTRIBUTE.finditer(body):
        name, *values = m.groups()
        out.setdefault(name.lower(), html_lib.unescape(next((v for v in values if v is not None), "")))
    return out


def _doubt(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    if tag in _BOILER_TAGS and tag != "form" or (tag == "header" and not in_article):
        return SURE
    if not attributes:
        return NAME if tag == "form" else NO
    if attributes.get("role", "").lower() in _BOILER_ROLES or attributes.get("aria-hidden") == "true":
        return SURE
    if "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return SURE
    if tag in ("body", "article", "main"):
        return NO
    found = NAME if tag == "form" else NO
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        words = _WORDS.findall(_CAMEL.sub("-", name).lower())
        sure = [w in _SURE_WORDS or w.startswith(_SURE_STARTS) for w in words]
        maybe = [(w in _MAYBE_WORDS or w.startswith(_MAYBE_STARTS)) and not (w == "header" and in_article) for w in words]
        if not any(sure) and not any(maybe):
            continue
        plain = all(x or y or w in _PLAIN_WORDS for x, y, w in zip(sure, maybe, words))
        found = max(found, SURE if plain and any(sure) else NAME if plain or any(sure) else PART)
    return found


@dataclass
class Page:
    nodes: list[Node]
    #: Numbers of paths by the number of the path above and the last step.
    paths: dict[tuple[int, str], int]
    #: Container, text, and characters outside links of each block.
    blocks: list[tuple[int, str, int]]


def parse(html: str | None) -> Page:
    """Containers and text blocks of a page, in page order."""
    nodes, blocks = [Node(-1, 0, "body", NO, False)], []
    paths: dict[tuple[int, str], int] = {(-1, "body"): 0}
    # open elements, each with its container and whether it is inline boilerplate, whose text is left out
    stack: list[tuple[str, int, bool]] = [("body", 0, False)]
    text: list[str] = []
    free = links = 0

    def flush() -> None:
        nonlocal free
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                blocks.append((stack[-1][1], whole, min(free, len(whole))))
            text.clear()
        free = 0

    for token in _TOKEN.finditer(html or ""):
        piece = token.group()
        if piece[0] != "<" or piece == "<":
            if stack[-1][2]:
                continue
            piece = html_lib.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if not links and any(map(str.isalnum, piece)):
                free += len(piece)
            continue
        if token.group(1) is not None or token.group(2) is not None:
            if token.group(2) is not None or token.group(1).lower() == "textarea":
                text.append(" ")
            continue
        found = _TAG.match(piece)
        if found is None:
            continue
        closing, tag = found.group(1), found.group(2).lower()
        if tag == "br":
            text.append(" ")
            continue
        block = tag in _BLOCKS
        if block:
            flush()
        if closing:
            if tag in ("body", "html"):
                continue
            if tag == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag not in _CONTAINERS and stack[k][0] in _CONTAINERS:
                    break  # an end tag of a line or phrase closes nothing outside its container
            continue
        if tag in ("html", "head", "body") or tag in _VOID:
            continue
        if block:
            # a block ends an open paragraph or heading of the same container
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _LEAVES:
                    del stack[k:]
                    break
                if stack[k][0] in _CONTAINERS or stack[k][0] in ("li", "dd", "blockquote"):
                    break
            for k in range(len(stack) - 1, 0, -1) if tag in _CLOSES else ():
                if stack[k][0] in _STOPS[tag]:
                    break
                if stack[k][0] in _CLOSES[tag]:
                    del stack[k:]
                    break
        if tag == "a":
            links += 1
        container, muted = stack[-1][1:]
        attributes = _attributes(piece) if len(piece) > len(tag) + 2 else {}
        own = _doubt(tag, attributes, True) if attributes or tag in _BOILER_TAGS else NO
        if own and not block:
            muted = muted or own >= NAME
        elif tag in _CONTAINERS or own:
            above = nodes[container]
            doubt = _doubt(tag, attributes, above.in_article)
            classes = ".".join(sorted(re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split()))
            path = paths.setdefault((above.path, tag + (f".{classes}" if classes else "")), len(paths))
            nodes.append(Node(container, path, tag, doubt, above.in_article or tag in ("article", "main")))
            above.children.append(len(nodes) - 1)
            container = len(nodes) - 1
        if not piece.endswith("/>") or tag in _CONTAINERS:
            stack.append((tag, container, muted and not block))
    flush()
    return Page(nodes, paths, blocks)


def find_path(page: Page, path: str) -> list[int]:
    """Numbers of the page's paths from the body to ``path``; none if it has no such path."""
    out, number = [], -1
    for step in path.split(">"):
        number = page.paths.get((number, step))
        if number is None:
            return []
        out.append(number)
    return out


def path_text(page: Page, number: int) -> str:
    steps = {n: key for key, n in page.paths.items()}
    out = []
    while number >= 0:
        number, step = steps[number]
        out.append(step)
    return ">".join(reversed(out))


def judge_containers(page: Page, cleared: list[int]) -> None:
    """Set ``boiler`` of all containers; names of those with a path in ``cleared`` do not count."""
    nodes, known = page.nodes, set(cleared)
    for node in nodes:
        node.chars = node.free = 0
    sure, named, outside = [False] * len(nodes), [False] * len(nodes), 0
    for k, node in enumerate(nodes):
        sure[k] = node.doubt == SURE or (node.parent >= 0 and sure[node.parent])
        named[k] = node.doubt == NAME or (node.parent >= 0 and named[node.parent])
    for k, text, free in page.blocks:
        if not sure[k]:
            nodes[k].chars += len(text)
            nodes[k].free += free
            outside += 0 if named[k] else free
    for k in range(len(nodes) - 1, 0, -1):  # children come after their parents
        nodes[nodes[k].parent].chars += nodes[k].chars
        nodes[nodes[k].parent].free += nodes[k].free
    for k, node in enumerate(nodes):
        out = node.doubt == SURE
        if node.path not in known:
            if node.doubt == NAME:
                out = 10 * outside >= nodes[0].free or 2 * node.free < nodes[0].free
            elif node.doubt == PART:
                out = 2 * node.free < node.chars or node.free < _FEW
        node.boiler = out or (node.parent >= 0 and nodes[node.parent].boiler)


def candidate(page: Page) -> int:
    """The container of the page's main text."""
    nodes = page.nodes
    for node in nodes:
        node.good, node.own = 0.0, False
    for k, text, free in page.blocks:
        if not nodes[k].boiler:
            nodes[k].good += len(text) * (free / len(text)) ** 2
            nodes[k].own |= free > 0
    for k in range(len(nodes) - 1, 0, -1):
        nodes[nodes[k].parent].good += nodes[k].good
    k = 0
    while True:
        if nodes[k].tag in ("article", "main"):
            return k
        inside = [c for c in nodes[k].children if not nodes[c].boiler]
        best = max(inside, key=lambda c: nodes[c].good, default=None)
        if best is None or nodes[best].good <= 0 or nodes[k].own or any(nodes[c].good > 0 for c in inside if c != best):
            return k
        k = best


def block_text(page: Page, roots: list[int]) -> str:
    """The blocks outside boilerplate below ``roots``, one to a line."""
    wanted = set(roots)
    inside = [False] * len(page.nodes)
    for k, node in enumerate(page.nodes):
        inside[k] = not node.boiler and (k in wanted or (node.parent >= 0 and inside[node.parent]))
    return "\n".join(text for k, text, _ in page.blocks if inside[k])


def vote(html: str | None) -> tuple[str, float] | None:
    """Generalised path and good text of the page's candidate; None without text."""
    page = parse(html)
    judge_containers(page, [])
    node = page.nodes[candidate(page)]
    return (path_text(page, node.path), node.good) if node.good > 0 else None


def extract(html: str | None, path: str | None) -> tuple[str, bool]:
    """The page's text by ``path``, and whether the path was found; otherwise by its own candidate."""
    page = parse(html)
    winner = find_path(page, path) if path is not None else []
    judge_containers(page, winner)
    if winner:
        roots = [k for k, n in enumerate(page.nodes) if n.path == winner[-1] and not n.boiler]
        if text := block_text(page, roots):
            return text, True
        judge_containers(page, [])
    return block_text(page, [candidate(page)]), False


def url_host(url):
    """Lower-cased host of a url column; empty for a null url or one without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "^.*?://([^/?#]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host and path: the path that most pages of the host vote for, ties by text, then by path."""

    def run(hosts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in hosts:
            votes: dict[tuple[str, str], list[float]] = {}
            for host, html in zip(batch["host"], batch["html"]):
                if (found := vote(html)) is not None:
                    total = votes.setdefault((host, found[0]), [0, 0.0])
                    total[0] += 1
                    total[1] += round(found[1])
            rows = [(h, p, int(n), int(w)) for (h, p), (n, w) in votes.items()]
            yield pd.DataFrame(rows, columns=["host", "path", "votes", "weight"])
        release_memory()

    rows = pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    votes = rows.mapInPandas(run, "host string, path string, votes long, weight long")
    sums = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("weight").alias("weight"))
    best = sums.groupBy("host").agg(F.max(F.struct("votes", "weight", "path")).alias("best"))
    return best.select("host", F.col("best.path").alias("path"))


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with text, n_chars (code points) and by_consensus."""
    bound_batches(pages.sparkSession)
    winners = materialise(host_paths(pages, url_col, html_col), "host-paths")
    size = winners.agg(F.sum(F.length("host") + F.length("path") + 64)).first()[0] or 0
    names = ("text", "n_chars", "by_consensus")
    keep = [c for c in pages.columns if c.lower() not in names]
    row = free_name(pages, "row")
    whole = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias(row), F.col(html_col).alias("html"), url_host(F.col(url_col)).alias("host")
    )
    if 4 * size <= BROADCAST_LIMIT_BYTES:  # characters have four bytes at most
        whole = whole.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        whole = whole.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for htmls, paths in batches:
            yield pd.DataFrame([extract(h, p) for h, p in zip(htmls, paths)], columns=["text", "by_consensus"])
        release_memory()

    extracted = F.pandas_udf(run, "text string, by_consensus boolean")
    done = whole.select(row, extracted("html", "path").alias("found"))
    columns = [F.col(f"{row}.`{c}`") for c in keep]
    return done.select(
        *columns, F.col("found.text").alias("text"), F.length("found.text").cast("long").alias("n_chars"), "found.by_consensus"
    )
