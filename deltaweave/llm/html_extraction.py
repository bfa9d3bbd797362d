"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the blocks of text below them (length, commas, share of links,
hints in tags and classes) and named by their generalised path: tags with classes and ids, numbers
replaced. Pages vote for the paths of their best containers (the whole body is no choice that says
anything, so it gets no votes), and the votes are added up by host. Then every page is read again and
its text is taken from the container on its host's winning path; a page without that path uses its own
best container. A container inside an article or main part stands for all of it, and a section or one
named as content for its like beside it, with the title and text between them; a title above it that
stands alone is the article's if that has none.

A page is read by one scan for tags; elements that HTML lets stay open are closed as browsers do. What
is no article's by its nature (scripts, menus, controls, hidden parts) is left out at once. Forms and
elements named as sidebars, notices, comments and the like are left out after reading, unless they
wrap the page: one that holds an article, main part or title (a form: anything) and more text than is
left without it stays. Reading and choosing take time and memory in proportion to the page.

Edge cases: null html is an empty page with empty text; null urls and urls without a host share the
host ""; unclosed tags, comments and scripts run to the end; repeated rows give repeated results and
votes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm.worker import map_texts
from deltaweave.session import materialize

# Names of HTML elements and words that hint at a part's role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td".split())
WHOLE = frozenset(("", "html", "body"))
DROPPED = frozenset("aside button canvas dialog footer head iframe input label menu nav noscript object select svg template textarea title video audio".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "caption", "tbody", "thead", "tfoot"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table".split())
SAME_OR_SCOPE = SCOPES.union(*SAME.values())
FORMS = frozenset("form fieldset".split())
#: Elements that hold an article's own words; a part of their names says nothing about them, a whole name does.
OWN = frozenset("a abbr b blockquote cite code em figcaption figure h1 h2 h3 h4 h5 h6 i li p pre q small span strong td th time tr".split())
AGAINST = (
    r"(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup|modal|newsletter|subscribe|signup|login|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|aside|footer\w*|foot|masthead|topbar|toolbar"
    r"|comment\w*|disqus|discussion|replies|respond|reviews?|share\w*|sharing|social\w*|related|recommend\w*|teaser\w*|widget\w*|pagination|pager|skip|copyright|legal|hidden)"
)
#: Names of articles that aren't a page's own.
LESSER = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|comment\w*|repl\w*|reviews?|related|recommend\w*|teaser\w*|widget\w*)(?=$|[\s_-])", re.I)
AGAINST_PART = re.compile(rf"(?:^|[_-]){AGAINST}(?=$|[_-])", re.I)
AGAINST_WHOLE = re.compile(rf"{AGAINST}\Z", re.I)
FOR = re.compile(r"(?:^|[\s_-])(?:article\w*|content\w*|post\w*|entry\w*|main\w*|story\w*|text|body)(?=$|[\s_-])", re.I)

SCAN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.I | re.S,
)
ATTRIBUTES = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
#: A class with such a word states something about the page, as "no-sidebar" does, and isn't a part's name.
STATES = re.compile(r"(?:^|[_-])(?:no|not|has|have|with|without|is|open|opened|closed|enabled|disabled|overflow)(?=$|[_-])", re.I)
NUMBERS = re.compile(r"\d+")

BEST_PATHS = 3
MAX_SENT_HOSTS = 200_000


class Node:
    """An element; ``hard`` says that its text isn't part of an article, ``soft`` that it isn't unless the element wraps the page."""

    __slots__ = ("tag", "parent", "label", "key", "weight", "hard", "soft", "out", "heading", "score", "links", "chars", "total", "at", "holds", "inside")

    def __init__(self, tag: str, rest: str, parent: Node | None, at: int) -> None:
        self.tag, self.parent, self.at = tag, parent, at
        names, hidden = "", False
        if rest and not rest.isspace():
            for name, *values in ATTRIBUTES.findall(rest):
                value, name = "".join(values), name.lower()
                if name in ("class", "id"):
                    names += " " + value
                hidden = hidden or name == "hidden" or (name == "aria-hidden" and value == "true")
        pro, against = False, False
        self.label = tag
        if names:
            pro = bool(FOR.search(names))
            bad = AGAINST_WHOLE.match if tag in OWN else AGAINST_PART.search
            against = tag not in ("html", "body", "main") and not (pro and tag == "article" and not LESSER.search(names)) and any(bad(x) and not STATES.search(x) for x in names.split())
            self.label = ".".join((tag, *sorted(set(NUMBERS.sub("#", names).lower().replace("/", "|").split()))))
        self.key = xxhash.xxh64_intdigest(self.label, parent.key) if parent else 0
        self.weight = (1.3 if pro or tag in ("article", "main") else 1.0) * (0.7 if tag in ("body", "td") else 1.0)
        self.hard = hidden or tag in DROPPED or (parent is not None and parent.hard)
        self.soft = against or tag in FORMS
        self.holds = tag in FORMS or (not against and tag in ("article", "main", "h1"))
        self.heading = tag in HEADINGS or (parent.heading if parent else False)
        self.out, self.inside = self.hard, 0
        self.score = 0.0
        self.links = self.chars = self.total = 0

    @property
    def path(self) -> str:
        labels, node = [], self
        while node.parent is not None:
            labels.append(node.label)
            node = node.parent
        return "/".join(["", *reversed(labels)])


def path_key(path: str) -> int:
    """The key of the nodes on a path."""
    key = 0
    for label in path.split("/")[1:]:
        key = xxhash.xxh64_intdigest(label, key)
    return key


Piece = tuple[str, Node, bool]  # text, innermost element, whether in a link


def read(page: str | None) -> tuple[list[tuple[Node, str]], list[Node]]:
    """Blocks (innermost block element, text) in page order, and all elements; text that is no article's is left out."""
    found, nodes = _parse(page or "")
    _decide(found, nodes)
    blocks = []
    for owner, pieces in found:
        left = [p for p in pieces if not p[1].out]
        text = " ".join(html.unescape("".join([p[0] for p in left])).split())
        if text:
            blocks.append((owner, text))
            owner.links += min(sum(len(p[0]) for p in left if p[2]), len(text))
    return blocks, nodes


def _decide(found: list[tuple[Node, list[Piece]]], nodes: list[Node]) -> None:
    """Sets ``out``, from the page's outermost elements inwards."""
    if not any(n.soft for n in nodes):
        return
    under = [False] * len(nodes)  # in or below a soft element
    for n in nodes[1:]:
        under[n.at] = n.soft or under[n.parent.at]
    left, own = 0, [0] * len(nodes)  # own: text below an element, but not below soft ones in it
    for _, pieces in found:
        for text, node, _ in pieces:
            size = len(text.strip())
            node.total += size
            own[node.at] += size
            if not under[node.at]:
                left += size
    for n in reversed(nodes[1:]):
        n.parent.total += n.total
        n.parent.holds = n.parent.holds or n.holds
        if not n.soft:
            own[n.parent.at] += own[n.at]
    for n in nodes[1:]:
        n.out = n.out or n.parent.out
        if n.soft and not n.out:
            if n.holds and n.total > left:
                left += own[n.at]
            else:
                n.out = True


def _parse(page: str) -> tuple[list[tuple[Node, list[Piece]]], list[Node]]:
    """Blocks as their pieces of text, and the elements in page order (parents before children)."""
    root = Node("", "", None, 0)
    nodes, blocks, stack = [root], [], [root]
    open_: dict[str, int] = {}
    marks: dict[str, list[int]] = {"p": [], "same": []}  # places in the stack where a search for an element to close can end
    block_of = [root]  # the innermost block element of each place in the stack
    links = [False]
    pieces: list[Piece] = []
    owner = root  # the block that the collected pieces belong to

    def flush() -> None:
        nonlocal pieces
        if pieces:
            blocks.append((owner, pieces))
            pieces = []

    def add(text: str) -> None:
        nonlocal owner
        top = stack[-1]
        if not text or top.hard:
            return
        if not pieces:
            if text.isspace():
                return
            owner = block_of[-1]
        pieces.append((text, top, links[-1]))

    def push(node: Node) -> None:
        tag = node.tag
        if tag == "p" or tag in CONTAINERS:
            marks["p"].append(len(stack))
        if tag in SAME_OR_SCOPE:
            marks["same"].append(len(stack))
        open_[tag] = open_.get(tag, 0) + 1
        block_of.append(node if tag in BLOCKS else block_of[-1])
        links.append(tag == "a" or (links[-1] and tag not in BLOCKS))
        stack.append(node)

    def cut(size: int) -> None:
        while len(stack) > size:
            open_[stack.pop().tag] -= 1
            block_of.pop()
            links.pop()
        for places in marks.values():
            while places and places[-1] >= size:
                places.pop()

    at = 0
    for m in SCAN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["close"] or m["close2"]:
            if tag in BLOCKS:
                flush()
            if open_.get(tag):
                size = len(stack) - 1
                while stack[size].tag != tag:
                    size -= 1
                cut(size)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            flush()
        if tag in CLOSES_P and marks["p"] and stack[marks["p"][-1]].tag == "p":
            cut(marks["p"][-1])
        if tag in SAME:
            for place in reversed(marks["same"]):
                name = stack[place].tag
                if name in SAME[tag]:
                    cut(place)
                    break
                if name in SCOPES:
                    break
        if tag in VOID:
            continue
        node = Node(tag, m["rest"] or m["rest2"] or "", stack[-1], len(nodes))
        nodes.append(node)
        if not (m["rest"] or "").endswith("/") or tag in BLOCKS:
            push(node)
    add(page[at:])
    flush()
    return blocks, nodes


def score(blocks: list[tuple[Node, str]], nodes: list[Node]) -> list[Node]:
    """Containers with text, best first (ties: the first in the page).

    A block's worth counts whole for its nearest container, half for the next and so on.
    """
    for owner, text in blocks:
        if not owner.heading:
            owner.score += 0.1 + (len(text) >= 25) * (1 + text.count(",") + min(len(text) / 100, 3.0))
            owner.chars += len(text)
    for n in reversed(nodes[1:]):
        n.parent.score += n.score * (0.5 if n.tag in CONTAINERS else 1.0)
        n.parent.chars += n.chars
        n.parent.links += n.links
    found = [n for n in nodes if n.score > 0 and (n.tag in CONTAINERS or n.parent is None)]
    return sorted(found, key=lambda n: (-n.score * n.weight * (1 - min(n.links / max(n.chars, 1), 1.0) * 0.9), n.at))


def article(best: Node, nodes: list[Node]) -> tuple[list[Node], Node | None]:
    """The elements that hold the article around a container, and the parent whose loose text is the article's too.

    That is the outermost article or else the main part it lies in; without these, what follows the same path
    under the same parent, if that is a section or named as content.
    """
    outer, node = {}, best
    while node is not None:
        outer[node.tag] = node
        node = node.parent
    for tag in ("article", "main"):
        if tag in outer:
            return [outer[tag]], None
    if best.tag not in ("td", *WHOLE) and (best.tag == "section" or best.weight > 1):
        return [n for n in nodes if n.parent is best.parent and n.key == best.key], best.parent if best.parent.tag not in WHOLE else None
    return [best], None


def _title(parts: list[Node], blocks: list[tuple[Node, str]]) -> Node | None:
    """The last first-order heading before the article that stands in an element around it, alone or among headings."""
    around, node = set(), parts[0]
    while node is not None:
        around.add(node)
        node = node.parent
    title = None
    for owner, _ in blocks:
        if owner.at > parts[0].at:
            break
        if owner.tag == "h1":
            node = owner.parent
            while node not in around and node.chars == 0 and node.tag != "header":
                node = node.parent
            title = owner if node in around else title
    return title


def extract(page: str | None, path: str | None) -> str:
    """Text of the article around the best container on ``path``, else of the best of all; blocks joined by a line end."""
    blocks, nodes = read(page)
    ranked = score(blocks, nodes)
    if not ranked:  # headings alone
        ranked = [nodes[0]]
    key = path_key(path) if path else None
    best = next((n for n in ranked if n.key == key), ranked[0])
    parts, loose = article(best, nodes)
    for part in parts:
        part.inside = 1
    for n in nodes[1:]:  # 1: inside, 2: in a header inside
        if not n.inside:
            n.inside = 2 if n.tag == "header" and n.parent.inside else n.parent.inside
    whole = parts[0].tag in WHOLE
    taken = [o.inside == 1 or (o.inside == 2 and o.heading and not whole) or (loose is not None and (o is loose or (o.parent is loose and o.tag not in CONTAINERS))) for o, _ in blocks]
    if not any(t and o.tag == "h1" for t, (o, _) in zip(taken, blocks)):
        title = _title(parts, blocks)
        taken = [t or o is title for t, (o, _) in zip(taken, blocks)]
    return "\n".join(text for t, (_, text) in zip(taken, blocks) if t)


def hosts(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", F.coalesce(host, F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): thousandths of the scores of each page's best containers, added by task and then by host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, str], int] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                best = [n for n in score(*read(page)) if n.tag not in WHOLE][:BEST_PATHS]
                whole = sum(n.score * n.weight for n in best)
                for n in best:
                    key = host, n.path
                    total[key] = total.get(key, 0) + round(1000 * n.score * n.weight / whole)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in total], pa.string()), pa.array([p for _, p in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["host", "path", "votes"])

    return map_texts(pages.select("host", "html"), run, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winners(pages: DataFrame) -> DataFrame:
    """(host, path): most votes; ties: the least path."""
    return votes(pages).groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path")).alias("w")).select("host", "w.path")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every row."""
    pages = hosts(pages)
    best = winners(pages)
    best = materialize(best, "paths")
    best = F.broadcast(best) if best.count() <= MAX_SENT_HOSTS else best
    ready = pages.join(best, "host", "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_texts(ready, run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
