"""Main text of web pages by a site style tree.

Each page becomes a tree of block elements; the trees of all pages of a host are merged by path (tag and
first class of each ancestor). For every node of the merged tree Spark counts, over the host's distinct pages
(copies count once), which presentations (sequences of child elements) and which contents (texts) occur. The entropy of these counts,
to the base of the number of pages, drawn towards 1 as by PRIOR more pages, is the node's importance: near 1 where pages differ, near 0 where
many repeat. A node's composite importance weighs its own against its children's. Branches of low composite
importance are removed from each page, beside what markup itself names as no article (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments).

Only counts are shuffled, never the pages, unless the list of unimportant branches is too long to broadcast.

Defined cases: null or empty html gives empty text; a page without <article> or <main> gives its remaining
body; the branch with most text of a
host is never unimportant, and a page that would lose all its text to the tree keeps it; a page whose text is all in menus, adverts, forms
or hidden elements gives empty text, but paragraphs and headings stay where only words of classes speak against all of a page; html, body, main, article and what encloses them are not judged by the words of their classes and
ids, except for articles inside another one; inside an article or main element a class or id must consist of such words only, unless it names readers' comments; a null url counts as a host of its own; repeated rows give repeated rows; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.llm.shared import map_rows, written

LEAST_IMPORTANCE, GAMMA = 0.2, 0.9
#: Pages without any repetition that each node is thought to have besides its own: what few pages show says little.
PRIOR = 2
#: Tasks that the leaves below one node are dealt to.
SALTS = 64
#: Elements nested deeper than this belong to their ancestor's branch at that depth, so that a page's paths take no more than a multiple of its own size.
DEEPEST = 200

# Element and class names of HTML pages.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset("head script style title textarea nav footer aside form noscript template iframe svg button select dialog menu object canvas audio video map xmp noembed noframes option".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NAMES_OTHER = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar"
    " aside footer header masthead topbar cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup social share sharing"
    " related recommended recommendations widget widgets comment comments commentlist disqus respond replies reply login search searchbox pagination pager toolbar copyright disclaimer".split()
)
# Words that add nothing to a class name.
_NAMES_ANY = frozenset("area bar block bottom box btn button buttons card column container content fixed form group header icon icons inline inner item items left link links list module outer panel posts right row section slot small text title top unit wrap wrapper".split())
_NAMES_ARTICLE = frozenset("article post entry content main story".split())
_NAMES_COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
_NAMES_READERS, _NAMES_SAID = frozenset("reader readers user users visitor visitors".split()), frozenset("comment comments feedback opinions reactions responses review reviews".split())
_NAMES_NOT = frozenset("allow has no with without".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_ROLES_OTHER = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


#: How surely an element is no article: by a word of its class or id, by other markup, by its tag.
ARTICLE, NAMED, OTHER, NEVER = range(4)


@dataclass
class Node:
    tag: str
    path: str
    above: Node | None
    rank: int  # ARTICLE to NEVER, by its own markup; in the end at least that of its parent
    held: bool  # in an article element
    inside: bool  # in an article or main element
    depth: int = 0
    inline: bool = False  # it and what is in it parts no block
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    node: Node
    text: str

    @property
    def path(self) -> str:
        return self.node.path

    @property
    def rank(self) -> int:
        return self.node.rank

    @property
    def inside(self) -> bool:
        return self.node.inside


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _rank(tag: str, given: dict[str, str], inside: bool) -> int:
    if tag in _NEVER:
        return NEVER
    if tag == "header" and not inside:
        return OTHER
    if not given:
        return ARTICLE
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower() or given.get("role", "").lower() in _ROLES_OTHER:
        return OTHER
    for value in [*given.get("class", "").split(), given.get("id", "")]:
        names = {n.lower() for n in _NAME.findall(value) if not n.isdigit()}
        if inside and not names & _NAMES_NOT and (names & _NAMES_COMMENTS or names & _NAMES_READERS and names & _NAMES_SAID):
            return NAMED
        if inside and names - _NAMES_OTHER - _NAMES_ANY:
            continue
        if names & _NAMES_OTHER and not (names & _NAMES_ARTICLE and names & _NAMES_OTHER <= {"header", "banner"}):
            return NAMED
    return ARTICLE


def _inherit(nodes: list[Node]) -> None:
    """Ranks hold for all below, but words of a class or id don't for html, body, main, article and what encloses them.

    Articles in another article (comments, say) keep theirs. Ones that the words speak against don't count as enclosed
    if the page has a main element or others.
    """
    tops = [n for n in nodes if n.tag == "main" or n.tag == "article" and not n.held]
    enclosed = [n for n in tops if n.tag == "main" or n.rank != NAMED] or tops
    free = {id(n) for n in nodes if n.tag in ("html", "body")} | {id(n) for n in tops}
    for node in enclosed:
        up = node.above
        while up is not None and not (id(up) in free and up.tag not in ("html", "body", "main", "article")):
            free.add(id(up))
            up = up.above
    for node in nodes[1:]:
        if node.rank == NAMED and id(node) in free:
            node.rank = ARTICLE
        node.rank = max(node.rank, node.above.rank)


def blocks_of(page: str | None) -> tuple[list[Block], list[Node]]:
    """The text blocks of a page in order, and all its nodes."""
    page = page or ""
    stack = [Node("", "", None, ARTICLE, False, False)]
    nodes: list[Node] = [stack[0]]
    blocks: list[Block] = []
    open_tags: Counter[str] = Counter()
    # Text of the current block, and of an inline element in it that is no article.
    piece: list[str] = []
    buried: list[str] = []

    def put(parts: list[str], node: Node) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            blocks.append(Block(node, text))

    def flush() -> None:
        k = len(stack)
        while stack[k - 1].inline:
            k -= 1
        if buried:
            put(buried, stack[k])
        if piece:
            put(piece, stack[k - 1])

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            (buried if stack[-1].inline else piece).append(page[at:stop])
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                if stack[k].tag == tag:
                    if not stack[k].inline:
                        flush()
                    elif buried and not stack[k - 1].inline:
                        put(buried, stack[k])
                    open_tags.subtract(x.tag for x in stack[k:])
                    del stack[k:]
                    break
                if tag not in _BLOCKS and not stack[k].inline:
                    break
            else:
                if tag in _BLOCKS:
                    flush()
            continue
        if tag == "br":
            (buried if stack[-1].inline else piece).append(" ")
            continue
        if tag in _BLOCKS:
            flush()
            if len(stack) > 1 and stack[-1].tag == "p":
                open_tags[stack.pop().tag] -= 1
            for closed in _CLOSES.get(tag, ()):
                if stack[-1].tag == closed:
                    open_tags[stack.pop().tag] -= 1
        given = _attributes(m[3])
        top = stack[-1]
        if tag in _RAW:
            close = re.compile(rf"</{tag}\s*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        rank = _rank(tag, given, top.inside)
        if tag in _VOID or (m[3] or "").rstrip().endswith("/") and tag not in _BLOCKS:
            continue
        if tag in _BLOCKS:
            names = given.get("class", "").split()
            name = f"{tag}.{names[0].replace('/', '|')}" if names else tag
            top.children.append(name)
            path = f"{top.path}/{name}" if top.depth < DEEPEST else top.path
            node = Node(tag, path, top, rank, top.held or top.tag == "article", top.inside or tag in ("article", "main"), top.depth + 1)
        elif rank or top.inline:
            node = Node(tag, top.path, top, rank, top.held, top.inside, top.depth, True)
        else:
            continue
        stack.append(node)
        open_tags[tag] += 1
        nodes.append(node)
    flush()
    _inherit(nodes)
    return blocks, nodes


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _number(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) << 32 | zlib.adler32(text.encode("utf-8", "surrogatepass"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def style_rows(url: str | None, page: str | None) -> list[tuple]:
    """Of one page: (host, copy, path, presentation, content, chars), one row for each path that it has; pages of the same copy have the same rows."""
    blocks, nodes = blocks_of(page)
    shows: dict[str, list[str]] = {}
    for n in nodes:
        if n.inline:
            continue
        shows.setdefault(n.path, []).append(",".join(n.children))
    texts: dict[str, list[str]] = {}
    for b in blocks:
        if not b.node.inline:
            texts.setdefault(b.path, []).append(b.text)
    host = host_of(url)
    rows = [(p, _signed(_number("|".join(s))), _signed(_number("\n".join(texts[p]))) if p in texts else None, sum(map(len, texts.get(p, ())))) for p, s in shows.items()]
    copy = _signed(_number(repr(rows)))
    return [(host, copy, *r) for r in rows]


def _chain(host: str, steps: list[dict]) -> list[tuple]:
    """The composite importance that one leaf gives each of its ancestors. steps: depth, path, a, b of each, the leaf's own importance as a."""
    out, value = [], None
    for s in sorted(steps, key=lambda s: -s["depth"]):
        value = s["a"] if value is None else s["a"] + s["b"] * value
        out.append((host, s["path"], value))
    return out


def unimportant(pages: DataFrame) -> DataFrame:
    """(host, paths): for each host that has any, the paths of its branches of low importance.

    The composite importance of a node with k children is (1 - GAMMA^k) of its own plus GAMMA^k of its children's largest.
    As that grows with each child's, it is the largest over the leaves below of the same sum along one chain. So no
    step gathers a host: a leaf's chain is as long as it is deep, and all else are sums and maxima.
    """
    rows = map_rows(pages.select("url", "html"), lambda: style_rows, "host string, copy long, path string, presentation long, content long, chars long")
    rows = written(rows.distinct().drop("copy"), "style-rows")

    def entropy(value: str) -> DataFrame:
        n = rows.where(f"{value} is not null").groupBy("host", "path", value).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
        # H = ln N - sum(n ln n) / N
        return n.groupBy("host", "path").agg(F.sum("n").alias("pages"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("h"), F.sum("chars").alias("chars"))

    shown = entropy("presentation").select("host", "path", "pages", F.col("h").alias("shown"), "chars")
    said = entropy("content").select("host", "path", F.col("h").alias("said"))
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    kids = shown.where("path <> ''").groupBy("host", parent.alias("path")).agg(F.count("*").alias("kids"))
    # One row for each path of the merged tree, however many pages have it.
    base = F.when(F.col("pages") > 1, F.log("pages"))
    drawn = lambda h: (F.col("pages") * F.coalesce(h / base, F.lit(1.0)) + PRIOR) / (F.col("pages") + PRIOR)
    node = F.greatest(F.when(F.col("kids").isNotNull(), drawn(F.col("shown"))), F.when(F.col("said").isNotNull(), drawn(F.col("said"))))
    part = F.pow(F.lit(GAMMA), F.col("kids"))
    # An element without text or children says nothing either way: it goes with its siblings.
    tree = shown.join(said, ["host", "path"], "left").join(kids, ["host", "path"], "left").select(
        "host", "path", "pages", "chars", "kids", F.when(F.col("kids").isNull(), F.coalesce(node, F.lit(1.0))).otherwise((1 - part) * node).alias("a"), F.coalesce(part, F.lit(0.0)).alias("b"))
    tree = written(tree, "style-nodes")

    # Each leaf with all its ancestors, which share the tree's upper paths: those are met by (path, salt).
    steps = F.split("leaf", "/")
    above = tree.where("kids is null").select("host", F.col("path").alias("leaf")).withColumn("salt", F.pmod(F.xxhash64("leaf"), F.lit(SALTS)))
    above = above.select("host", "leaf", "salt", F.explode(F.sequence(F.lit(1), F.size(steps))).alias("depth")).withColumn("path", F.array_join(F.slice(steps, 1, F.col("depth")), "/"))
    salted = above.select("host", "path", "salt").distinct().join(tree.select("host", "path", "a", "b"), ["host", "path"])
    chains = above.join(salted, ["host", "path", "salt"]).groupBy("host", "leaf").agg(F.collect_list(F.struct("depth", "path", "a", "b")).alias("steps"))
    composite = map_rows(chains.select("host", "steps"), lambda: _chain, "host string, path string, importance double").groupBy("host", "path").agg(F.max("importance").alias("importance"))
    main = tree.groupBy("host").agg(F.max(F.struct("chars", "path")).alias("main"))
    low = composite.where(f"path <> '' and importance < {LEAST_IMPORTANCE}")
    low = low.join(main, "host").where(~F.startswith(F.concat("main.path", F.lit("/")), F.concat("path", F.lit("/"))))
    return low.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def main_text(page: str | None, low: set[str] | frozenset[str] = frozenset()) -> str:
    found = blocks_of(page)[0]
    # Where words of classes speak against all of a page, its prose stays: they name the page's layout then.
    blocks = [b for b in found if b.rank == ARTICLE] or [b for b in found if b.rank == NAMED and b.node.tag in _PROSE]
    if any(b.inside for b in blocks):
        blocks = [b for b in blocks if b.inside]
    if low:
        parts = [b for b in blocks if not any(b.path == p or b.path.startswith(p + "/") for p in low)]
        blocks = parts or blocks
    return "\n\n".join(b.text for b in blocks)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages."""
    low = written(unimportant(pages), "style-tree").withColumnRenamed("host", "low_host")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host")).join(low, F.col("host") == F.col("low_host"), "left")

    def each(page_id: int | None, url: str | None, page: str | None, paths: list[str] | None) -> list[tuple]:
        text = main_text(page, set(paths or ()))
        return [(page_id, url, text, len(text))]

    return map_rows(rows.select("page_id", "url", "html", "paths"), _always(each), "page_id long, url string, text string, n_chars long")


def _always(each: Callable) -> Callable:
    return lambda: each
