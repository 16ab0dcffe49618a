"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read as a sequence of text blocks (runs of text between block-level tags),
each with its place in the element tree. Every block becomes a node between two
terminals, content and boilerplate:

* terminal capacities are the costs of a classifier of the block's text, ``-log p`` and
  ``-log(1 - p)``, with log-odds of at most ``TEXT_LIMIT`` either way;
* smoothness edges join neighbouring blocks, weaker the farther apart they are in the
  tree, and consecutive blocks of one parent;
* an element that says what it holds is a node of its own, with edges of ``HOLD`` to the
  blocks whose nearest such element it is. Its terminal is ``NAMED`` where a class, id or
  role says so, and the blocks it holds can outvote that together; for elements such as
  ``article`` or ``nav`` and for lists of comments it is a fixed seed;
* a minimum cut, found by max-flow, is the labelling of least total cost.

Nodes whose terminal costs outweigh all their edges are labelled beforehand and their
edges folded into the neighbours' terminals; that leaves the cut minimal and the flow
small. The classifier is a logistic regression on text and tree features. It is trained
here, on at most ``max_pages`` pages with the smallest digests, where blocks under
``article`` or ``main`` are content and blocks under navigation, forms and the like are
not; it sees the text alone, so it carries pages that have no such elements.

A form that holds an ``article`` or ``main``, or more than half of the page, is a wrapper.
``main`` ends what an unclosed ``nav`` or the like before it says, and such elements
without any end tag are no seeds.

Scripts, styles, comments, titles, hidden elements and form controls hold no text. Raw
elements end at their end tag; drawings, media, objects and lists of choices end with
their own or an enclosing element, drawings and formulas also at ``/>``.

Defined results:

* null or empty html, or no content block: empty text, ``n_chars`` 0;
* null ``page_id`` or url: carried; repeated rows get equal texts;
* broken markup (missing end tags, cut entities, open comments): read as browsers do in
  the common cases; a ``<`` that opens no tag is text;
* no page with both kinds of hints in the sample (also: empty table): fixed prior weights;
* very long pages are read whole; other columns play no part.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kohorta.llm.frames import map_texts, smallest_digests
from kohorta.session import cut_lineage

# Element names by what they mean for text.
RAW = "script|style|title|textarea|iframe|noscript"
UNSEEN = set("svg math object canvas select video audio template".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul option caption".split()
)
ONE_OPEN = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = set("article aside body div footer form header html main nav ol ul dl section table blockquote".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "head", "body", "option", "caption"}
CONTENT_TAGS, OTHER_TAGS = {"article", "main"}, {"nav", "aside", "form", "footer", "menu", "dialog", "button"}
CONTENT_WORDS = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body-?text)(?:$|[\s_-])", re.I)
OTHER_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|sidebar|side|footer|masthead|"
    r"breadcrumbs?|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|login|signup|social|share|"
    r"sharing|related|recommended|widget|comments?|respond|reply|replies|disqus|discussion|pagination|pager|"
    r"search|copyright|legal|disclaimer|toolbar|tags|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
HEADER_WORD = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
UNDISPLAYED = re.compile(r"display\s*:\s*none", re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:{RAW})(?=[\s/>])(?P<skip>)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>|<[!?/][^>]*>",
    re.I | re.S,
)
SELF_CLOSED = re.compile(r"[^<>]*/>")
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?]")
FEATURES = 8
#: Weights without any training page: long blocks of few links.
PRIOR = np.array([-1.0, 1.5, -3.0, 1.0, 0.0, 0.5, 0.5, -0.5])
NEAR, SIBLING, TEXT_LIMIT, PENALTY = 0.6, 0.3, 3.0, 10.0
#: Edge to the element that holds a block: more than its text and all its neighbours. Terminals
#: of elements: ten full votes of blocks for names, more than any page has for seeds.
HOLD, NAMED, SEED = 5.0, 30.0, 1e9
#: What an article may hold that is not its own text.
REPLIES = re.compile(r"(?:^|[\s_-])(?:comments?|respond|reply|replies)(?:$|[\s_-])", re.I)


#: Layouts named by what they have beside the text, and kinds of pages.
LAYOUTS = re.compile(r"(?:^|(?<=\s))(?:(?:has|no|with|without)[_-]\S+|\S+[_-](?:page|layout))(?=\s|$)", re.I)
#: Lists of comments, which no article inside makes content.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|respond|reply|replies|disqus|discussion)(?:$|[\s_-])", re.I)


class PageBlock:
    __slots__ = ("element", "link", "region", "tag", "text")

    def __init__(self, text, link, element):
        self.text, self.link, self.tag = text, link, element.tag
        self.element, self.region = element.block, element.region


def attributes_of(raw: str) -> dict[str, str]:
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), a or b or c)
    return found


class _Element:
    """Open element: its place among block-level elements, and what holds its text.

    ``region`` is the nearest element that says what it holds (``vote``: above 0 for
    content). Elements that are never content (``firm`` 1) and lists of comments (2) hold
    whatever is inside; only ``main`` leaves the former.
    """

    __slots__ = ("block", "content", "depth", "firm", "hard", "in_link", "name", "region", "tag", "unseen", "up", "vote")

    def __init__(self, name, up, attributes, loose):
        given = attributes_of(attributes) if attributes else {}
        self.name, self.up = name, up.block
        self.block, self.tag, self.depth = up.block, up.tag, up.depth
        if name in BLOCKS:
            self.block, self.tag, self.depth = self, name, up.depth + 1
        self.in_link = up.in_link or name == "a"
        self.unseen = up.unseen or name in UNSEEN
        self.hard = up.hard or self.unseen or bool(
            given
            and (
                "hidden" in given
                or given.get("aria-hidden", "").strip().lower() == "true"
                or UNDISPLAYED.search(given.get("style", ""))
            )
        )
        words = " ".join(given[k] for k in ("class", "id", "role") if k in given)
        content = name in CONTENT_TAGS or bool(words and CONTENT_WORDS.search(words))
        firm, other = 0, False
        if name in CONTENT_TAGS:
            firm = 2 if words and REPLIES.search(words) else 0
        elif name not in ("body", "html"):
            beside = LAYOUTS.sub(" ", words)
            other = bool(beside and OTHER_WORDS.search(beside)) or (name in OTHER_TAGS and (name != "form" or not loose))
            top = name == "header" or bool(words and HEADER_WORD.search(words))
            other = other or (top and not up.content and not content)
            firm = 2 if beside and COMMENTS.search(beside) else 1 if name in OTHER_TAGS and not loose else 0
        self.content = up.content or content
        self.firm, self.region, self.vote = up.firm, up.region, 0.0
        if up.firm and not (up.firm == 1 and name == "main"):
            return
        if firm or other or content:
            self.firm, self.region = firm, self
            size = SEED if firm or name in CONTENT_TAGS or (name in OTHER_TAGS and not loose) else NAMED
            self.vote = -size if firm or other else size


class _Root:
    name = tag = ""
    depth, firm, in_link, content, hard, unseen, region, up = 0, 0, False, False, False, False, None, None


_Root.block = _Root


def page_blocks(page: str) -> list[PageBlock]:
    """Text blocks in page order."""
    blocks: list[PageBlock] = []
    stack, held, link, at = [_Root], [], 0, 0
    ahead: dict[str, int] = {}

    def next_of(pattern):
        """Where the pattern stands next, or the end of the page; asked in page order."""
        if ahead.get(pattern, -1) < at:
            found = re.compile(pattern, re.I).search(page, at)
            ahead[pattern] = found.start() if found else len(page)
        return ahead[pattern]

    def is_loose(name):
        """Whether an element holds what its name does not say."""
        if name not in OTHER_TAGS:
            return False
        end = next_of(rf"</{name}[\s>]")
        if name == "form":
            return next_of(r"<(?:article|main)[\s>]") < end or 2 * (end - at) > len(page)
        return end == len(page)

    def close_block():
        nonlocal held, link
        if held:
            text = SPACE.sub(" ", "".join(held)).strip()
            if text:
                seen = next(e for e in reversed(stack) if not e.unseen)
                blocks.append(PageBlock(text, min(link, len(text)), seen))
            held, link = [], 0

    def add(raw):
        nonlocal link
        if raw and not stack[-1].hard:
            text = entities.unescape(raw) if "&" in raw else raw
            held.append(text)
            if stack[-1].in_link:
                link += len(text.strip())

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m["skip"] is not None:
            closed = SELF_CLOSED.match(page, at) if stack[-1].unseen else None
            if closed:
                at = closed.end()
                continue
            name = re.match(r"<(\w+)", page[m.start() : m.start() + 12]).group(1).lower()
            shut = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            held.append(" ")
            at = shut.end() if shut else len(page)
            continue
        name = m["tag"] or m["tag2"]
        if name is None:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if name in BLOCKS:
                if not stack[-1].unseen or (place and not stack[place].unseen):
                    close_block()
                del stack[place or len(stack) :]
            elif place and name in UNSEEN:
                del stack[place:]
            elif place:
                del stack[place]
            continue
        if name in VOID:
            if name == "hr" and not stack[-1].unseen:
                close_block()
            else:
                held.append(" " if name in ("br", "img", "wbr") else "")
            continue
        if name in BLOCKS:
            if not stack[-1].unseen:
                close_block()
            ends = ONE_OPEN.get(name, set()) | ({"p"} if name in CLOSES_P else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ends:
                    if not stack[i].unseen:
                        close_block()
                    del stack[i:]
                    break
                if stack[i].name in SCOPES:
                    break
        elif name in UNSEEN:
            held.append(" ")
        rest = m["rest"] if m["tag"] else m["rest2"]
        if not rest.endswith("/") or name in BLOCKS or name == "a":
            stack.append(_Element(name, stack[-1], rest, is_loose(name)))
    close_block()
    return blocks


def block_features(blocks: list[PageBlock]) -> np.ndarray:
    """Bias, words, links, punctuation, capital, paragraph, heading, list."""
    out = np.zeros((len(blocks), FEATURES))
    for row, b in zip(out, blocks, strict=True):
        text, words = b.text, b.text.count(" ") + 1
        row[:] = (
            1.0, math.log1p(words) / 3, b.link / len(text), min(len(PUNCTUATION.findall(text)) / words, 1.0),
            sum(map(str.isupper, text[:1])), b.tag == "p", b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
            b.tag in ("li", "td", "th", "option"),
        )
    return out


def tree_distance(a, b) -> int:
    """Steps between two block-level elements."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def smoothness_edges(blocks: list[PageBlock]) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEAR / (1 + tree_distance(blocks[i - 1].element, b.element))))
        before = last.get(b.element.up)
        if before is not None and before != i - 1:
            edges.append((before, i, SIBLING))
        last[b.element.up] = i
    return edges


def _saturate(flow: dict[int, dict[int, float]], source: int, sink: int) -> dict[int, int]:
    """Pushes a maximum flow, in phases of shortest paths; nodes still reached from ``source``."""
    near = {u: list(rooms) for u, rooms in flow.items()}
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v in near[u]:
                if v not in level and flow[u].get(v, 0.0) > 1e-12:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return level
        tried, path = dict.fromkeys(level, 0), [source]
        while path:
            u = path[-1]
            if u == sink:
                steps = list(zip(path, path[1:], strict=False))
                push = min(flow[x][y] for x, y in steps)
                for x, y in steps:
                    flow[x][y] -= push
                    flow[y][x] = flow[y].get(x, 0.0) + push
                full = next(i for i, (x, y) in enumerate(steps) if flow[x][y] <= 1e-12)
                del path[full + 1 :]
                continue
            while tried[u] < len(near[u]):
                v = near[u][tried[u]]
                if flow[u].get(v, 0.0) > 1e-12 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
                tried[u] += 1
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1


def minimum_cut(keep: list[float], drop: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: ``keep[i]`` for content, ``drop[i]`` for boilerplate, and an
    edge's weight where its ends differ. Ties go to boilerplate."""
    n = len(keep)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    gain = [d - k for k, d in zip(keep, drop, strict=True)]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(gain[i]) > sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                gain[j] += w if label[i] else -w
                queue.append(j)
            near[i] = {}
    free = [i for i in range(n) if label[i] is None]
    if free:
        source, sink = n, n + 1
        flow: dict[int, dict[int, float]] = {i: dict(near[i]) for i in free} | {source: {}, sink: {}}
        for i in free:
            if gain[i] > 0:
                flow[source][i] = gain[i]
                flow[i][source] = 0.0
            else:
                flow[i][sink] = -gain[i]
                flow[sink][i] = 0.0
        reached = _saturate(flow, source, sink)
        for i in free:
            label[i] = i in reached
    return [bool(x) for x in label]


def log_odds(blocks: list[PageBlock], weights: np.ndarray) -> np.ndarray:
    """Log-odds of content by the text alone."""
    return np.clip(block_features(blocks) @ weights, -TEXT_LIMIT, TEXT_LIMIT)


def content_labels(blocks: list[PageBlock], weights: np.ndarray) -> list[bool]:
    """Which blocks are content, by the minimum cut over blocks and the elements that hold them."""
    z, edges = log_odds(blocks, weights), smoothness_edges(blocks)
    regions = {b.region: None for b in blocks if b.region is not None}
    places = {region: len(blocks) + i for i, region in enumerate(regions)}
    edges += [(i, places[b.region], HOLD) for i, b in enumerate(blocks) if b.region is not None]
    keep, drop = np.logaddexp(0, -z).tolist(), np.logaddexp(0, z).tolist()
    keep += [max(-region.vote, 0.0) for region in regions]
    drop += [max(region.vote, 0.0) for region in regions]
    return minimum_cut(keep, drop, edges)[: len(blocks)]


def main_text(page: str | None, weights: np.ndarray) -> str:
    blocks = page_blocks(page or "")
    if not blocks:
        return ""
    return "\n".join(b.text for b, c in zip(blocks, content_labels(blocks, weights), strict=True) if c)


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a square penalty, by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(beta))
        step = np.linalg.solve(hessian, x.T @ (p - y) + PENALTY * beta)
        beta = beta - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def train(pages: DataFrame, max_pages: int = 2_000, page_id: str = "page_id", html: str = "html") -> np.ndarray:
    """Classifier weights from tree hints of a bounded sample of pages."""
    keys = pages.select(F.col(page_id).alias("__key")).filter("__key IS NOT NULL").distinct()
    chosen = cut_lineage(smallest_digests(keys, F.col("__key").cast("string"), max_pages), "html-sample")
    rows = pages.select(F.col(page_id).alias("__key"), F.col(html).alias("__html"))
    rows = rows.join(chosen.filter("__key >= 0 OR __key < 0"), "__key")

    def features(column: pa.Array) -> list[pa.Array]:
        out = []
        for page in column:
            blocks = [b for b in page_blocks(page.as_py() or "") if b.region is not None]
            labels = np.array([b.region.vote > 0 for b in blocks], float).reshape(-1, 1)
            out.append(np.hstack([block_features(blocks), labels]).ravel().tolist())
        return [pa.array(out, pa.list_(pa.float64()))]

    found = map_texts(rows, "__html", [], StructType.fromDDL("x array<double>"), features)
    found = smallest_digests(found, F.col("x").cast("string"), max_pages)
    parts = [np.array(r["x"]).reshape(-1, FEATURES + 1) for r in found.collect()]
    x = np.vstack(parts) if parts else np.zeros((0, FEATURES + 1))
    x, y = x[:, :-1], x[:, -1]
    return _fit(x, y) if 0 < y.sum() < len(y) else PRIOR


def extract(pages: DataFrame, weights: np.ndarray, carry=("page_id", "url"), html: str = "html") -> DataFrame:
    """``carry`` columns with the main ``text`` and ``n_chars``."""
    fields = StructType([StructField("text", StringType()), StructField("n_chars", LongType())])

    def work(column: pa.Array) -> list[pa.Array]:
        texts = [main_text(page.as_py(), weights) for page in column]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return map_texts(pages, html, list(carry), fields, work)


def query(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return extract(pages, train(pages))
