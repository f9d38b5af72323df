"""Main text of web pages by minimum-cut labelling of their blocks.

1. A page becomes blocks of text between block-level tags, each with its place in the DOM and the share of link text.
2. A naive Bayes classifier on block features gives log-odds of content. It is fitted on at most ``max_pages`` pages,
   on blocks that semantic containers label; the containers themselves aren't features.
3. Log-odds and the containers that tell their role become terminal capacities; neighbouring blocks and blocks of one
   DOM parent are tied by smoothness edges. The minimum cut (Dinic's maximum flow) separates content from the rest, so
   blocks without clear evidence follow the ones around them.
4. Containers weigh by how certain their role is. Elements for menus, footers, sidebars and forms, and names made of nothing but words
   for such parts (``comments``, ``cookie-notice``), outweigh text and ties: prose of readers looks like the article's. A form or name
   that holds nearly all text of a page is a layout, not a part, and other names are hints: both count as far as the classifier
   agrees with containers on the sample, and less than all ties of a block, so text and flow can overrule them.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _names(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Elements that begin and end a block.
BLOCK = _names(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul"
)
VOID = _names("area base br col embed hr img input link meta param source track wbr")
#: Elements that an opening tag closes, up to the elements where this ends.
CLOSES = {
    "li": (_names("li"), _names("ul ol menu dir")), "dt": (_names("dt dd"), _names("dl")), "dd": (_names("dt dd"), _names("dl")),
    "tr": (_names("tr td th"), _names("table")), "td": (_names("td th"), _names("tr table")), "th": (_names("td th"), _names("tr table")),
    "option": (_names("option"), _names("select")), "tbody": (_names("thead tbody tr td th"), _names("table")), "body": (_names("head"), _names("html")),
}
SCOPE = _names("table td th button caption html body article section aside nav header footer main form")

#: Containers and words of class, id and role that tell what is inside.
ASIDE_TAGS = _names("nav footer aside form button select dialog menu head fieldset search")
MAIN_TAGS = _names("article main")
ASIDE_WORDS = _names(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar footer masthead header topbar toolbar pagination pager comment comments commentlist reply replies respond "
    "disqus cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended widget complementary contentinfo search form skip"
)
#: Words of parts that may belong to the article, so their names are hints only.
LOOSE_WORDS = _names("widget related recommended share sharing social skip header")
#: Words that say nothing about the role of a name they are part of.
NEUTRAL_WORDS = _names("area bar block bottom box container group inner item items left link links list outer panel right row section site thread top wrap wrapper")
MAIN_WORDS = _names("article post entry story content main maincontent articlebody postbody body text")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|noscript|template|textarea|iframe|object|svg|math|xmp)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+>|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORD = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class HtmlRule:
    max_pages: int = 2_000
    container: float = 2.0  # log-odds of a block inside a container that tells its role, at most; outer ones count half each
    least: float = 0.5  # the same at least
    certain: float = 20.0  # the same inside a container whose role is certain
    layout: float = 10.0  # a certain form or name that holds this many times the other text is a layout
    hidden: float = 99.0  # against text that isn't shown
    most: float = 3.0  # log-odds of the classifier at most
    neighbour: float = 1.0  # smoothness between neighbouring blocks
    sibling: float = 1.0  # between neighbours of one DOM parent, and half of it of one grandparent
    token_buckets: int = 512
    alpha: float = 1.0


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    node: int


@dataclass
class Page:
    """Blocks in page order, and the block-level elements: tag, parent, and the role (1 main, -1 aside, 0 open) of the
    innermost element around that has one."""

    blocks: list[Block] = field(default_factory=list)
    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    roles: list[int] = field(default_factory=lambda: [0])
    around: list[float] = field(default_factory=lambda: [0.0])  # roles of all elements around, each counted half as much as the next inner one
    hidden: list[bool] = field(default_factory=lambda: [False])
    firm: list[int] = field(default_factory=lambda: [0])  # 1: a form or name, 2: another element whose role is certain, which no article is in
    words: list[tuple[str, ...]] = field(default_factory=lambda: [()])


def _hidden(attrs: str) -> bool:
    if "hidden" in attrs.lower() or "display" in attrs.lower():
        for m in NAMED.finditer(attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                return True
    return False


def _role(tag: str, words: list[str], in_main: bool) -> int:
    if tag in ASIDE_TAGS or (tag == "header" and not in_main):
        return -1
    if tag in ("html", "body"):
        return 0
    if not ASIDE_WORDS.isdisjoint(words) and not (tag in MAIN_TAGS or tag in ("h1", "header") and in_main):
        return -1 if MAIN_WORDS.isdisjoint(words) else 0
    if tag in MAIN_TAGS or not MAIN_WORDS.isdisjoint(words):
        return 1
    return 0


def _firm(tag: str, names: list[list[str]], role: int) -> int:
    """How certain the role aside is: 2 by the element, 1 for forms and by a name of nothing but words for such parts, else 0."""
    if role >= 0:
        return 0
    if tag == "form":
        return 1
    if tag in ASIDE_TAGS or tag == "header":
        return 2
    return int(any(not LOOSE_WORDS.intersection(n) and ASIDE_WORDS.intersection(n) and ASIDE_WORDS.union(NEUTRAL_WORDS).issuperset(n) for n in names))


def parse(page: str) -> Page:
    """Blocks and elements of a page; anything between < and > that isn't a tag, comment or declaration is text."""
    out = Page()
    stack, parts, links, in_link, at = [0], [], 0, False, 0

    def end_block() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.blocks.append(Block(text, min(links, len(text)), stack[-1]))
            parts, links = [], 0

    def close(upto: int) -> None:
        end_block()
        del stack[upto:]

    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            links += len(piece) if in_link else 0
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m["close"]
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            end_block()
            if m["close"]:
                for i in range(len(stack) - 1, 0, -1):
                    if out.tags[stack[i]] == tag:
                        close(i)
                        break
                in_link = False
                continue
            gone, ends = CLOSES.get(tag, (None, SCOPE))
            for i in range(len(stack) - 1, 0, -1):
                name = out.tags[stack[i]]
                if name == "p" or (gone and name in gone):
                    close(i)
                elif name in ends or name in SCOPE:
                    break
            if tag in VOID:
                continue
            attrs, names = m["attrs"], []
            if attrs:
                for a in NAMED.finditer(attrs):
                    if a[2] and a[1].lower() in ("class", "id", "role"):
                        names += [WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", n).lower()) for n in a[2].strip("\"'").split()]
            words = [w for n in names for w in n]
            out.tags.append(tag)
            out.parents.append(stack[-1])
            out.words.append(out.words[stack[-1]] + tuple(words))
            inside = out.roles[stack[-1]]
            hidden = _hidden(attrs)
            role = -1 if hidden else _role(tag, words, inside > 0)
            out.firm.append(_firm(tag, names, role))
            out.roles.append(role or inside)
            out.around.append(role + out.around[stack[-1]] / 2 if role else out.around[stack[-1]])
            out.hidden.append(hidden or out.hidden[stack[-1]])
            stack.append(len(out.tags) - 1)
    if at < len(page):
        parts.append(page[at:])
    end_block()
    return out


def outside(page: Page, rule: HtmlRule) -> list[bool]:
    """Which elements lie in a container whose role aside is certain; forms and names that hold nearly all other text aren't."""
    near, text = [0] * len(page.tags), {0: 0}
    for node in range(1, len(page.tags)):
        near[node] = node if page.firm[node] else near[page.parents[node]]
    for block in page.blocks:
        if not page.hidden[block.node]:
            text[near[block.node]] = text.get(near[block.node], 0) + len(block.text)
    out, open_text = [False] * len(page.tags), text[0]
    for node in range(1, len(page.tags)):
        out[node] = out[page.parents[node]]
        if page.firm[node] and not out[node]:
            inside = text.get(node, 0)
            if page.firm[node] == 1 and inside > rule.layout * open_text:
                open_text += inside
            else:
                out[node] = True
    return out


def signature(page: Page, block: Block) -> tuple:
    """What the classifier sees of a block: tag, link share, length, sentences, words of its elements' names."""
    n = len(block.text)
    share = min(3, 4 * block.links // max(n, 1))
    stops = block.text.count(".") + block.text.count("!") + block.text.count("?")
    return page.tags[block.node], share, min(n.bit_length(), 12), min(stops, 3), page.words[block.node]


@lru_cache(maxsize=1 << 16)
def features(seen: tuple, buckets: int) -> tuple[int, ...]:
    """Feature numbers of a signature."""
    tag, share, length, stops, words = seen
    codes = [(0, tag), (1, share), (2, length), (3, stops), (4, tag, share), *((5, w) for w in words)]
    return tuple(sorted({zlib.crc32(repr(c).encode()) % buckets for c in codes}))


@dataclass(frozen=True)
class Fitted:
    """Log-odds of every feature bucket (none without blocks of both sides), what they sum to between both sides, and those of a container."""

    table: list[float]
    middle: float
    container: float


def told(page: Page, block: Block, table: list[float]) -> float:
    """The classifier's log-odds of content."""
    return sum([table[f] for f in features(signature(page, block), len(table))]) if table else 0.0


def log_odds(page: Page, fitted: Fitted, rule: HtmlRule) -> list[float]:
    """Evidence for content of every block: the classifier's, and that of its containers."""
    out, gone = [], outside(page, rule)
    for block in page.blocks:
        own = max(-rule.most, min(rule.most, told(page, block, fitted.table) - fitted.middle)) + fitted.container * page.around[block.node]
        out.append(own - rule.certain * gone[block.node] - rule.hidden * page.hidden[block.node])
    return out


def edges(page: Page, rule: HtmlRule) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, and blocks that follow each other under one DOM parent or grandparent."""
    found: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, int], int] = {}
    for i, block in enumerate(page.blocks):
        if i:
            found[i - 1, i] = found.get((i - 1, i), 0.0) + rule.neighbour
        parent = page.parents[block.node]
        for level, node, weight in ((1, parent, rule.sibling), (2, page.parents[parent] if parent > 0 else -1, rule.sibling / 2)):
            if node > 0:
                if (level, node) in last:
                    pair = (last[level, node], i)
                    found[pair] = found.get(pair, 0.0) + weight
                last[level, node] = i
    return [(a, b, w) for (a, b), w in found.items()]


def label(odds: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum-cut labels. A node whose odds outweigh all its ties keeps its side in every minimum cut; its ties then
    count towards the odds of the others, and the flow runs over what is left."""
    odds = list(odds)
    tied: list[dict[int, float]] = [{} for _ in odds]
    for a, b, w in ties:
        tied[a][b] = tied[b][a] = w
    side: list[bool | None] = [None] * len(odds)
    queue = deque(range(len(odds)))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(odds[i]) > sum(tied[i].values()):
            side[i] = odds[i] > 0
            for j, w in tied[i].items():
                odds[j] += w if side[i] else -w
                del tied[j][i]
                queue.append(j)
    rest = [i for i, s in enumerate(side) if s is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        left = [(place[a], place[b], w) for a in rest for b, w in tied[a].items() if a < b]
        for i, s in zip(rest, minimum_cut([odds[i] for i in rest], left)):
            side[i] = s
    return [bool(s) for s in side]


def minimum_cut(odds: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: source edges of positive odds, sink edges of negative ones, two-way ties."""
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i, o in enumerate(odds):
        if o > 0:
            link(source, i, o, 0.0)
        elif o < 0:
            link(i, sink, -o, 0.0)
    for a, b, w in ties:
        link(a, b, w, w)
    small = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > small and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= small)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] > small and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(e)
                a = to[e]
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def main_text(page: str, fitted: Fitted, rule: HtmlRule) -> str:
    parsed = parse(page)
    if not parsed.blocks:
        return ""
    odds = log_odds(parsed, fitted, rule)
    content = [o > 0 for o in odds]
    if any(content) and not all(content):
        content = label(odds, edges(parsed, rule))
    return "\n".join(b.text for b, c in zip(parsed.blocks, content) if c)


PAGE = 1 << 20  # a page's blocks of one side count this much together, so no long page decides


def labelled(page: Page) -> Iterator[tuple[Block, int, int]]:
    """(block, side, weight) of the blocks that containers label."""
    found = [(b, page.roles[b.node]) for b in page.blocks if page.roles[b.node] and not page.hidden[b.node]]
    n = Counter(side for _, side in found)
    for block, side in found:
        yield block, side, max(1, PAGE // n[side])


def fit(pages: DataFrame, rule: HtmlRule) -> Fitted:
    """Classifier of the blocks that containers label, on the pages with the smallest digests, and how far it agrees with the containers."""
    chosen = pages.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(rule.max_pages)
    sample = pages.join(F.broadcast(chosen), "page_id").select("html")  # max_pages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for html in batch.column("html").to_pylist():
                page = parse(html or "")
                for block, side, weight in labelled(page):
                    counts[-1, side] += weight
                    for f in features(signature(page, block), rule.token_buckets):
                        counts[f, side] += weight
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in counts], pa.int64()), pa.array([s for _, s in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())],
            names=["feature", "side", "n"],
        )

    counted = sample.mapInArrow(run, "feature long, side long, n long").groupBy("feature", "side").agg(F.sum("n").alias("n")).collect()
    n = {(r["feature"], r["side"]): r["n"] for r in counted}
    if (-1, 1) not in n or (-1, -1) not in n:
        return Fitted([], 0.0, rule.container)

    def share(f: int, side: int) -> float:
        return (n.get((f, side), 0) / PAGE + rule.alpha) / (n[-1, side] / PAGE + 2 * rule.alpha)

    table = [math.log(share(f, 1) / share(f, -1)) for f in range(rule.token_buckets)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for html in batch.column("html").to_pylist():
                page = parse(html or "")
                for block, side, weight in labelled(page):
                    counts[round(10 * told(page, block, table)), side] += weight
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in counts], pa.int64()), pa.array([s for _, s in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())],
            names=["tenths", "side", "n"],
        )

    # a few hundred sums in tenths; the middle lies halfway between the means of both sides
    found = [(r["tenths"] / 10, r["side"], r["n"] / PAGE) for r in sample.mapInArrow(sums, "tenths long, side long, n long").groupBy("tenths", "side").agg(F.sum("n").alias("n")).orderBy("tenths", "side").collect()]
    middle = sum(sum(t * w for t, s, w in found if s == side) / sum(w for _, s, w in found if s == side) for side in (1, -1)) / 2
    yes = sum(w for t, side, w in found if (t - middle) * side > 0)
    no = sum(w for _, _, w in found) - yes
    return Fitted(table, middle, max(rule.least, min(rule.container, math.log((yes + rule.alpha) / (no + rule.alpha)))))


def extract(pages: DataFrame, rule: HtmlRule = HtmlRule(), key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    Null, empty and pages without content give ''. Repeated rows give the same text each. Where no page of the sample
    has a container that tells its role, the classifier says nothing, and blocks without a role are left out.
    An empty table gives no rows.
    """
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    fitted = fit(rows, rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = [main_text(x or "", fitted, rule) for x in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
