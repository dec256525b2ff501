"""Main text of web pages by wrapper induction: same-host trees are aligned, constant nodes are template."""

from __future__ import annotations

import html as htmllib
import math
import re
import sys
from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoolwave.llm.common import checkpoint, plain

#: Rows of one host that a task aligns at a time. All parts of a host use one reference page and one template.
GROUP = 400
#: A node is template if its text stands at the same place of at least this many distinct pages and this share of them.
LEAST_PAGES = 3
SHARE = 0.5
LEAST_PAGES_MAIN = 4
SHARE_MAIN = 0.8
#: A block that holds this share of what varies in the block around it holds the content.
REGION_SHARE = 0.8
#: Hosts whose table (a name and three numbers each) is broadcast; a larger table is joined by shuffle.
BROADCAST_HOSTS = 50_000
#: Cells of one alignment table beyond which only some of its rows are kept and the others computed again on the way back,
#: and entries of the memory of scores beyond which it is emptied.
TABLE = 200_000
SCORES = 1_000_000

# Element and attribute names with a meaning for extraction.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": ("li", frozenset(("ul", "ol", "menu"))),
    "dt": ("dt dd", frozenset(("dl",))),
    "dd": ("dt dd", frozenset(("dl",))),
    "tr": ("tr td th", frozenset(("table",))),
    "td": ("td th", frozenset(("tr", "table"))),
    "th": ("td th", frozenset(("tr", "table"))),
    "option": ("option", frozenset(("select",))),
}
NOT_CONTENT = frozenset("nav footer aside form head script style noscript template iframe button select input textarea dialog menu object canvas audio video map".split())
NOT_CONTENT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion sidebar nav navbar navigation menu"
    " breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription"
    " signup login search share sharing social comment comments commentlist disqus respond reply replies related recommended"
    " recommendations widget widgets toolbar pagination pager copyright disclaimer complementary contentinfo".split()
)
MAIN_NAMES = frozenset("article post entry content main body story text".split())
HEADER_NAMES = frozenset(("header", "head", "top", "topbar"))

# a quote opens a value only behind an equals sign; what is taken is never given back, so no page takes long
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PARTS = re.compile(r"[-_:]+")


class Node:
    """A block element, or a run of text (tag '#')."""

    __slots__ = ("children", "drop", "link", "main", "number", "sig", "size", "tag", "text")

    def __init__(self, tag: str, text: str = "") -> None:
        self.tag, self.text, self.children, self.drop, self.main, self.link, self.sig, self.size, self.number = tag, text, [], False, False, 0, None, 1, 0


def _noise(token: str) -> bool:
    """Whether a name says that its element is no content: the whole name, its last part, or its first unless it ends as main."""
    parts = [p for p in _PARTS.split(token) if p]
    return token in NOT_CONTENT_NAMES or bool(parts) and (parts[-1] in NOT_CONTENT_NAMES or parts[0] in NOT_CONTENT_NAMES and parts[-1] not in MAIN_NAMES and len(parts) == 2)


def _roles(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is no content by its name, and whether it is named as the main part."""
    if tag in NOT_CONTENT:
        return True, False
    tokens: set[str] = set()
    for _, a, b, c in _NAMES.findall(attrs) if attrs else ():
        tokens.update((a or b or c).lower().split())
    if any(map(_noise, tokens)):
        return True, False
    ends = {_PARTS.split(t)[-1] for t in tokens} | tokens
    if tag not in INLINE and (tag == "header" or ends & HEADER_NAMES) and not ends & MAIN_NAMES:
        return tag not in ("h1", "h2", "h3", "h4", "h5", "h6"), False
    main = tag in ("article", "main") or "main" in tokens and tag in ("div", "section") or "articlebody" in tokens
    return bool(attrs and _HIDDEN.search(attrs)), main


def parse(page: str) -> Node:
    """The block tree of a page. Inline elements melt into the text around them; white space runs become one space.

    An inline element that is no content by its name takes its text along, and the text around it stays one run.
    """
    root = Node("#root")
    stack = [root]
    run: list[str] = []
    links = linked = 0
    mute: list[tuple[str, int]] = []  # open inline elements without content, and how deep they stand

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                leaf = Node("#", text)
                leaf.link = min(linked, len(text))
                stack[-1].children.append(leaf)
            linked = 0

    at, low = 0, None
    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            piece = page[at : m.start()]
            if not mute:
                piece = htmllib.unescape(piece) if "&" in piece else piece
                run.append(piece)
                linked += len(piece) if links else 0
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag, closing = name.lower(), bool(m[1])
        if tag in RAW and not closing:
            low = low or page.lower()
            end = low.find("</" + tag, at)
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                at = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
            continue
        if tag in INLINE:
            if mute and closing and any(t == tag for t, _ in mute):
                while mute.pop()[0] != tag:
                    pass
            elif not closing and tag not in VOID and (mute or m[3]) and (tag in (t for t, _ in mute) or _roles(tag, m[3])[0]):
                mute.append((tag, len(stack)))
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
            elif tag in ("br", "img", "wbr"):
                run.append(" ")
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag == "p" and stack[i].tag in ("article", "main", "section", "div", "td", "li"):
                    break
            links = 0
            while mute and mute[-1][1] > len(stack):
                mute.pop()
            continue
        if tag in CLOSES_P:
            if stack[-1].tag == "p":
                stack.pop()
        elif tag in SIBLINGS:
            names, fence = SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in fence:
                    break
                if stack[i].tag in names.split():
                    del stack[i:]
                    break
        node = Node(tag)
        node.drop, node.main = _roles(tag, m[3])
        if tag == "header" and any(n.main for n in stack):
            node.drop = False
        node.drop = node.drop or bool(mute)
        stack[-1].children.append(node)
        if tag not in VOID and not (m[3].endswith("/") and tag in RAW):
            stack.append(node)
        if tag not in ("p", "li", "td"):
            links = 0
    if at < len(page) and not mute:
        run.append(htmllib.unescape(page[at:]))
    flush()
    return root


def signature(node: Node) -> int:
    """Hash of the shape below a node, texts left out; every node also gets the number of nodes of its subtree."""
    order, todo = [], [node]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.children
    for n in reversed(order):
        n.sig = hash((n.tag, tuple(c.sig for c in n.children)))
        n.size = 1 + sum(c.size for c in n.children)
    return node.sig


def align(a: Node, b: Node, out: dict[int, Node]) -> None:
    """Simple tree matching: fill out with id(node of a) -> node of b for the best order-preserving alignment.

    Subtrees of one shape at the start and the end of two child lists are taken as matches first: none of them can score
    more than its size, so no best alignment is lost. The rest goes through the dynamic programme over child pairs. Scores
    depend on shapes only and are remembered by shape.
    """
    scores: dict[tuple[int, int], int] = {}
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 1000 + 4 * min(_depth(a), _depth(b))))  # two calls a level, on the heap
    try:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            out[id(x)] = y
            todo += _pairs(x, y, scores)
    finally:
        sys.setrecursionlimit(limit)


def _depth(root: Node) -> int:
    depth, level = 0, [root]
    while level:
        depth, level = depth + 1, [c for n in level for c in n.children]
    return depth


def _trim(x: Node, y: Node) -> tuple[int, int, int]:
    p, n, m = 0, len(x.children), len(y.children)
    while p < n and p < m and x.children[p].sig == y.children[p].sig:
        p += 1
    s = 0
    while s < n - p and s < m - p and x.children[n - 1 - s].sig == y.children[m - 1 - s].sig:
        s += 1
    return p, n - s, m - s


def _score(x: Node, y: Node, scores: dict[tuple[int, int], int]) -> int:
    if x.tag != y.tag:
        return 0
    if x.sig == y.sig:
        return x.size
    if not x.children or not y.children:
        return 1
    key = (x.sig, y.sig)
    own = scores.get(key)
    if own is None:
        p, n, m = _trim(x, y)
        own = 1 + sum(c.size for c in x.children[:p]) + sum(c.size for c in x.children[n:])
        if n > p and m > p:
            row, ys = [0] * (m - p + 1), y.children[p:m]
            for c in x.children[p:n]:
                row = _next_row(c, ys, row, scores)
            own += row[-1]
        if len(scores) >= SCORES:
            scores.clear()
        scores[key] = own
    return own


def _next_row(x: Node, ys: list[Node], above: list[int], scores: dict) -> list[int]:
    row = [0]
    for j, y in enumerate(ys):
        best = above[j + 1] if above[j + 1] >= row[j] else row[j]
        if x.tag == y.tag:
            w = above[j] + (_score(x, y, scores) if x.children and y.children else 1)
            best = w if w > best else best
        row.append(best)
    return row


def _pairs(x: Node, y: Node, scores: dict) -> list[tuple[Node, Node]]:
    p, n, m = _trim(x, y)
    cx, cy = x.children, y.children
    found = list(zip(cx[:p], cy[:p])) + list(zip(cx[n:], cy[m:]))
    xs, ys = cx[p:n], cy[p:m]
    if not xs or not ys:
        return found
    step = len(xs) if len(xs) * len(ys) <= TABLE else math.isqrt(len(xs)) + 1
    row = [0] * (len(ys) + 1)
    kept = [row]  # the rows before every step-th child
    for i in range((len(xs) - 1) // step * step):
        row = _next_row(xs[i], ys, row, scores)
        if (i + 1) % step == 0:
            kept.append(row)
    i, j = len(xs), len(ys)
    while i and j:
        low = (i - 1) // step * step
        rows = [kept[low // step]]
        for c in xs[low:i]:
            rows.append(_next_row(c, ys, rows[-1], scores))
        while i > low and j:
            if rows[i - low][j] == rows[i - low - 1][j]:
                i -= 1
            elif rows[i - low][j] == rows[i - low][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((xs[i], ys[j]))
    return found


def numbered(page: str) -> tuple[Node, list[Node]]:
    """The tree of a reference page and its nodes in page order; a node's number is its place in that list."""
    root = parse(page)
    signature(root)
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        n.number = len(order)
        order.append(n)
        todo += reversed(n.children)
    return root, order


class Run:
    """A text run of a page with what the elements around it say: dropped, main, heading, its place and that of its block."""

    __slots__ = ("around", "drop", "head", "inside", "link", "main", "spot", "text")

    def __init__(self, leaf: Node, state: tuple, spot: Node | None) -> None:
        self.text, self.link, self.spot = leaf.text, leaf.link, spot
        self.drop, self.main, self.head, self.around = state

    @property
    def chars(self) -> int:
        """What the run counts for when the content is looked for: nothing where a name drops it or where it is mostly links."""
        return 0 if self.drop or self.link * 2 > len(self.text) else len(self.text)


def runs(page: str, reference: Node | None) -> list[Run]:
    """Text runs in page order, each with its node of the reference page (None without one)."""
    root, places = parse(page), {}
    if reference is not None:
        signature(root)
        align(root, reference, places)
    out, todo = [], [(root, (False, False, False, reference))]
    while todo:
        n, (drop, main, head, around) = todo.pop()
        spot = places.get(id(n))
        if n.tag == "#":
            out.append(Run(n, (drop, main, head, around), spot))
        else:
            state = (drop or n.drop, main or (n.main and not drop), head or n.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), around if spot is None else spot)
            todo += [(c, state) for c in reversed(n.children)]
    return out


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def survey(pages: Iterable[list[Run]]) -> dict[tuple[int, int | None], list[int]]:
    """{(node, text): [pages, characters]}: how often each text stands at each node of the reference page.

    Runs without a place of their own count under the block around them, with no text.
    """
    found: dict[tuple[int, int | None], list[int]] = {}
    for page in pages:
        for r in page:
            key = (r.around.number, None) if r.spot is None else (r.spot.number, digest(r.text))
            own = found.setdefault(key, [0, 0])
            own[0] += r.spot is not None
            own[1] += r.chars
    return found


def totals(found: dict[tuple[int, int | None], list[int]]) -> list[tuple[int, int, int, int | None, int, int]]:
    """What Spark makes of the surveys of a large host: (node, pages, characters, most frequent text, its pages and characters)."""
    out: dict[int, list] = {}
    for (node, text), (pages, chars) in found.items():
        row = out.setdefault(node, [0, 0, None])
        row[0] += pages
        row[1] += chars
        if text is not None:
            row[2] = max(row[2] or (0, text, 0), (pages, text, chars))
    return [(node, pages, chars, *((best[1], best[0], best[2]) if best else (None, 0, 0))) for node, (pages, chars, best) in out.items()]


class Template:
    """What a host's pages share: the frequent text of each slot, and the block that holds most of what varies."""

    def __init__(self, order: list[Node], rows: Iterable[tuple[int, int, int, int | None, int, int]]) -> None:
        self.slots = {node: (text, times, pages) for node, pages, _, text, times, _ in rows if text is not None}
        mass = [0] * len(order)
        for node, pages, chars, text, times, of_text in rows:
            mass[node] = chars - (of_text if text is not None and times >= LEAST_PAGES and times >= SHARE * pages else 0)
        parent: list[int | None] = [None] * len(order)
        for n in reversed(order):  # children come after their parent
            for c in n.children:
                mass[n.number] += mass[c.number]
                parent[c.number] = n.number
        region = order[0]
        while True:
            blocks = [c for c in region.children if any(x.tag != "#" for x in c.children)]
            best = max(blocks, key=lambda c: mass[c.number], default=None)
            if best is None or not mass[best.number] or mass[best.number] < REGION_SHARE * mass[region.number]:
                break
            region = best
        up: int | None = region.number
        while up is not None:  # what is named as main around it belongs to it
            region = order[up] if order[up].main else region
            up = parent[up]
        self.inside = frozenset(range(region.number, region.number + region.size)) if mass[region.number] and region is not order[0] else None

    def constant(self, r: Run, least: int, share: float) -> bool:
        if r.spot is None or r.spot.number not in self.slots:
            return False
        text, times, pages = self.slots[r.spot.number]
        return times >= least and times >= share * pages and text == digest(r.text)


def content(page: list[Run], template: Template | None) -> str:
    """The text of the content region's varying slots; without a region, that of the elements named as main, or of all."""
    inside = template.inside if template else None
    within = [not r.drop and inside is not None and r.around.number in inside for r in page]
    if not any(within):
        within = [not r.drop for r in page]
    marked = any(r.main for r, ok in zip(page, within) if ok)
    found, spare = [], []
    for r, ok in zip(page, within):
        if not ok or (marked and not r.main) or (not marked and not r.head and r.link * 2 > len(r.text)):
            continue
        spare.append(r.text)
        if not template or not template.constant(r, *((LEAST_PAGES_MAIN, SHARE_MAIN) if r.main or inside is not None else (LEAST_PAGES, SHARE))):
            found.append(r.text)
    return "\n\n".join(found or spare)


def middle(pages: Iterable[str]) -> str:
    """The reference page among distinct pages: of those of middle length the one of the least hash, as `references` finds it."""
    distinct = sorted(set(pages), key=len)
    at = len(distinct[len(distinct) // 2])
    return min((p for p in distinct if len(p) == at), key=lambda p: (_signed(p), p))


def _signed(page: str) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(page.encode("utf-8"), seed=42)
    return h - (1 << 64) if h >> 63 else h


class Wrapper:
    """The pages of one host that fit in a task: surveyed, induced and extracted at once."""

    def __init__(self, pages: Iterable[str]) -> None:
        distinct = sorted(set(pages))
        self.template = None
        root = order = None
        if len(distinct) >= LEAST_PAGES:
            root, order = numbered(middle(distinct))
        self.pages = {p: runs(p, root) for p in distinct}
        if order:
            self.template = Template(order, totals(survey(self.pages.values())))

    def extract(self, page: str) -> str:
        return content(self.pages[page], self.template)


def references(own: DataFrame) -> DataFrame:
    """(_host, _parts, _distinct, _digest) of own(host, chars, digest): rows dealt in parts, distinct pages, the reference page.

    The reference is of the middle length of the distinct pages: lengths are counted, and the counts of a host (one row a length)
    are summed in order, so no task sees a host's pages. Copies of a page count once, whatever their number.
    """
    pages = own.groupBy("host", "chars", "digest").agg(F.count("*").alias("rows"))
    lengths = pages.groupBy("host", "chars").agg(F.count("*").alias("pages"), F.sum("rows").alias("rows"), F.min("digest").alias("digest"))
    whole = Window.partitionBy("host")
    up_to = F.sum("pages").over(whole.orderBy("chars").rowsBetween(Window.unboundedPreceding, 0))
    told = lengths.select("host", "digest", "pages", up_to.alias("up_to"), F.sum("pages").over(whole).alias("distinct"), F.sum("rows").over(whole).alias("rows"))
    at = F.floor(F.col("distinct") / 2)
    found = told.where((F.col("up_to") > at) & (F.col("up_to") - F.col("pages") <= at))
    return found.select(F.col("host").alias("_host"), F.ceil(F.col("rows") / GROUP).alias("_parts"), F.col("distinct").alias("_distinct"), F.col("digest").alias("_digest"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    All distinct pages of a host are aligned with one reference page, one of the middle length. Text that stands at its place on
    most pages is template. What varies and is not mostly links shows where the content is: from the root down, a block that
    holds nearly all of it is entered, and the varying slots of the last one are content unless an element's name says otherwise
    (navigation, adverts, comments and the like). Names of main elements decide only where nothing can be induced (fewer than
    three distinct pages, or a page that has no such block). A host of any size is dealt into parts by its pages' content; the
    parts' counts are summed over the host. Reference, counts and the least number of pages go by distinct pages, so neither the
    number of rows nor copies of a page change another page's text. Where all that is left would be template (copies of one
    page), the runs stay. Null html gives an empty text; null urls form one host; repeated rows repeat; an empty table stays empty.
    """
    pages = plain(pages, "page_id", "url", "html")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    own = own.withColumn("chars", F.length("html")).withColumn("digest", F.xxhash64("html"))
    hosts = checkpoint(references(own))
    few = hosts.count() <= BROADCAST_HOSTS  # pages then stay where they are until they are dealt
    placed = own.join(F.broadcast(hosts) if few else hosts, F.col("host") == F.col("_host")).withColumn("part", F.pmod("digest", "_parts"))
    chosen = placed.where((F.col("_parts") > 1) & (F.col("_distinct") >= LEAST_PAGES) & (F.col("digest") == F.col("_digest")))
    reference = chosen.groupBy("host", F.col("_parts").alias("parts")).agg(F.min("html").alias("reference"))
    # tasks follow the number of pages, whatever the session's number of shuffle partitions
    tasks = max(1, -(-pages.count() // (GROUP * 4)), min(pages.sparkSession.sparkContext.defaultParallelism, 8))
    dealt = placed.select("page_id", "url", "html", "host", "part").repartition(tasks, "host", "part")
    large = checkpoint(reference)
    # a column of its own: that of the checkpoint still counts as the pages' one, and the two meet below
    asked = large.select(F.concat("host", F.lit("")).alias("host"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "reference")

    def look(own: pa.Table, asked: pa.Table) -> pa.Table:
        """Survey of a part of a large host."""
        rows: list[tuple] = []
        if own.num_rows and asked.num_rows:
            root, _ = numbered(asked.column("reference")[0].as_py())
            html = sorted(set(own.column("html").to_pylist()))
            name = own.column("host")[0].as_py()
            rows = [(name, *key, *value) for key, value in survey(runs(p, root) for p in html).items()]
        columns = list(zip(*rows)) or [()] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("host", "node", "text", "pages", "chars"), columns, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))})

    seen = dealt.groupBy("host", "part").cogroup(asked.groupBy("host", "part")).applyInArrow(look, "host string, node int, text bigint, pages bigint, chars bigint")
    slots = seen.groupBy("host", "node", "text").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars")).groupBy("host", "node")
    best = F.max(F.when(F.col("text").isNotNull(), F.struct("pages", "text", "chars"))).alias("best")
    slots = slots.agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), best)
    # one row a host: as many slots as its reference page has nodes
    row = F.struct("node", "pages", "chars", F.col("best.text").alias("text"), F.col("best.pages").alias("times"), F.col("best.chars").alias("of_text"))
    induced = asked.join(slots.groupBy("host").agg(F.collect_list(row).alias("slots")), "host").select("host", "part", "reference", "slots")

    def read(own: pa.Table, induced: pa.Table) -> pa.Table:
        html = own.column("html").to_pylist()
        if not induced.num_rows:
            texts = _texts(html, Wrapper(html).extract)
        else:
            root, order = numbered(induced.column("reference")[0].as_py())
            rows = [(s["node"], s["pages"], s["chars"], s["text"], s["times"] or 0, s["of_text"] or 0) for s in induced.column("slots")[0].as_py()]
            template = Template(order, rows)
            texts = _texts(html, lambda p: content(runs(p, root), template))
        return pa.table({"page_id": own.column("page_id"), "url": own.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    types = dict(pages.dtypes)
    return dealt.groupBy("host", "part").cogroup(induced.groupBy("host", "part")).applyInArrow(read, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars bigint")


def _texts(pages: list[str], one) -> list[str]:
    done: dict[str, str] = {}
    return [done[p] if p in done else done.setdefault(p, one(p)) for p in pages]
