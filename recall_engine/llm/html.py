"""Main text of web pages, with the templates of each site removed."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_engine.llm.stage import join_hot, written
from recall_engine.llm.textcols import slices

#: A < outside of quotes ends the search for a tag's end, so that broken markup
#: is not read again and again.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>""",
    re.S,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
# Elements of HTML by kind.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_UNWANTED = frozenset("aside button canvas datalist dialog footer form head iframe input menu nav noscript object option script select style svg template textarea title".split())
_CONTAINER = frozenset("aside div dl footer form header nav ol section table ul".split())
_CLOSES_P = _BLOCK - frozenset("br body html head option legend summary caption tbody td tfoot th thead tr li dd dt figcaption".split())
#: Elements that end an open one of their kind, but not across what holds them.
_LEVELS = [({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}), ({"td", "th"}, {"tr", "table"}), ({"tr"}, {"table"}), ({"option"}, {"select"})]
_LEVEL_OF = {tag: k for k, (ends, _) in enumerate(_LEVELS, 1) for tag in ends}
# Words in class, id and role that mark what isn't the article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments commentlist consent contentinfo cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
_MAIN_MARKS = frozenset("article content entry main post story".split())


# Class words that say how an element is laid out, not what it is.
_LAYOUT = frozenset("block bottom box col column container content flex grid inner item left list outer right row section top wrap wrapper".split())
#: Whole class words that mark the same within the article.
_INSIDE = _MARKS - {"footer", "login", "notice", "pager", "reply", "respond", "search", "skip"}


class Node:
    """near: the innermost open element that decides what a start tag ends, one
    for blocks and one for each of _LEVELS."""

    __slots__ = ("children", "marks", "near", "parent", "tag", "words")

    def __init__(self, tag: str, marks: frozenset[str], words: frozenset[str], parent: Node | None):
        self.tag, self.marks, self.words, self.parent = tag, marks, words, parent
        self.children: list[Node | str] = []
        near = parent.near if parent else (None,) * (1 + len(_LEVELS))
        if tag in _BLOCK or tag == "p":
            near = (self, *(self if tag in ends or tag in holds else x for x, (ends, holds) in zip(near[1:], _LEVELS, strict=True)))
        elif tag in ("option", "select"):
            near = (*near[:-1], self)
        self.near = near


_NO_MARKS: frozenset[str] = frozenset()


def parse(html: str) -> Node:
    """A tree of elements and text, in time in proportion to the page.  Broken
    markup never fails: ends of what isn't open are skipped, open elements end
    with the page, a < that opens nothing is text."""
    root = at = Node("", _NO_MARKS, _NO_MARKS, None)
    place, n = 0, len(html)
    opened: Counter[str] = Counter()

    def leave(node: Node) -> Node:
        """Closes all up to the node; its parent is what stays open."""
        up = at
        while up is not node:
            opened[up.tag] -= 1
            up = up.parent
        opened[node.tag] -= 1
        return node.parent

    while place < n:
        m = _TOKEN.search(html, place)
        if not m:
            at.children.append(html[place:])
            break
        if m.start() > place:
            at.children.append(html[place : m.start()])
        place = m.end()
        ends, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                at.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if ends:
            if opened[tag]:
                up = at
                while up.tag != tag:
                    up = up.parent
                at = leave(up)
            continue
        if tag in _CLOSES_P or tag == "p":
            block = at.near[0]
            if block and block.tag == "p":
                at = leave(block)
        elif tag in _LEVEL_OF:
            level = _LEVEL_OF[tag]
            same = at.near[level]
            if same and same.tag in _LEVELS[level - 1][0]:
                at = leave(same)
        marks = words = _NO_MARKS
        if rest and "=" in rest:
            values = [(name.lower(), (a or b or c).lower()) for name, a, b, c in _NAMED.findall(rest)]
            marks = frozenset(x for _, v in values for x in _WORD.findall(v))
            words = frozenset(f"={x}" if name == "role" else x for name, v in values if name != "id" for x in v.split())
        node = Node(tag, marks, words, at)
        at.children.append(node)
        if tag in _RAW:
            over = re.compile(f"</{tag}\\b[^<>]*>", re.I).search(html, place)
            place = over.end() if over else n
        elif tag not in _VOID and not rest.endswith("/"):
            at = node
            opened[tag] += 1
    return root


def _named(node: Node, marks: frozenset[str]) -> bool:
    """Whether an element is named as nothing else: its role is a mark, or all
    words of its class are, words of layout aside."""
    named = {x for x in node.words if x[0] != "="} - _LAYOUT
    return bool(named) and named <= marks or any(x[0] == "=" and x[1:] in marks for x in node.words)


def _unwanted(node: Node, inside: bool) -> bool:
    """What isn't the article.  Within it, and outside of it for elements that
    hold no others, names count only where they say nothing else: a box of
    class 'share price' and a paragraph of class 'notice-period' stay.  A list
    within it goes by any word of its class: lists of links are named so."""
    if node.tag in _UNWANTED or (node.tag == "header" and not inside):
        return True
    if node.tag in ("html", "body", "main") or not node.marks:
        return False
    if inside:
        return node.tag in _CONTAINER and (bool(node.words & _INSIDE) if node.tag in ("ul", "ol") else _named(node, _INSIDE))
    if node.tag not in _CONTAINER:
        return _named(node, _MARKS)
    return bool(node.marks & _MARKS) or "header" in node.marks


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(c for c in reversed(x.children) if isinstance(c, Node))


def _wanted(node: Node, test) -> list[Node]:
    """The topmost elements that pass the test and stand in nothing unwanted."""
    found, stack = [], [node]
    while stack:
        x = stack.pop()
        if x.parent and _unwanted(x, False):
            continue
        if x.parent and test(x):
            found.append(x)
        else:
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return found


def main_elements(root: Node) -> list[Node]:
    """The articles of a page; without any its main element, then what is named
    as content, then the page."""
    return (
        _wanted(root, lambda x: x.tag == "article")
        or _wanted(root, lambda x: x.tag == "main" or "articlebody" in x.marks)
        or _wanted(root, lambda x: x.tag in ("div", "section") and bool(x.marks & _MAIN_MARKS))
        or [root]
    )


def text_of(nodes: list[Node]) -> str:
    """Text of the elements without unwanted subtrees: white space in a block
    becomes one space, blocks are joined by one."""
    out: list[str] = []
    for top in nodes:
        out.append(" ")
        stack: list[Node | str] = [top]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(entities.unescape(x) if "&" in x else x)
                continue
            if x is not top and _unwanted(x, top.parent is not None):
                out.append(" " if x.tag in _BLOCK else "")
                continue
            if x.tag in _BLOCK:
                out.append(" ")
                stack.append(" ")
            stack.extend(reversed(x.children))
    return " ".join("".join(out).split())


def subtree_hashes(root: Node) -> dict[Node, int]:
    """Node -> hash of tag and content, for all elements of a page.

    Children are hashed before their parents; links and attributes of a subtree
    don't count, its texts do."""
    every: dict[Node, int] = {}
    for x in reversed(list(_walk(root))):
        parts = [x.tag.encode()]
        for c in x.children:
            if isinstance(c, str):
                parts.append(b"t" + " ".join(c.split()).encode("utf-8", "surrogatepass"))
            else:
                parts.append(b"n" + every[c].to_bytes(8, "little"))
        every[x] = xxhash.xxh3_64_intdigest(b"\0".join(parts))
    return every


def containers(hashes: dict[Node, int]) -> dict[Node, int]:
    """Those of the elements that may be templates, as signed hashes."""
    return {x: h - (1 << 63) for x, h in hashes.items() if x.tag in _CONTAINER}


def without_templates(root: Node, templates: set[int]) -> Node:
    """The page less the subtrees of these hashes; each leaves a space."""
    gone = {x for x, h in containers(subtree_hashes(root)).items() if h in templates}
    for above in {x.parent for x in gone}:
        above.children = [" " if x in gone else x for x in above.children]
    return root


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _page_key() -> Column:
    return F.xxhash64("page_id", "html", "url")


def site_templates(pages: DataFrame, *, least_pages: int = 5) -> tuple[DataFrame, DataFrame]:
    """(subtrees, templates): the hashes of the containers of each page (key,
    host, subtree, content), and (host, subtree, n) of those that recur on pages
    of many different contents of the host: ``least_pages`` and the binary
    logarithm of how many the host has.

    So the count that makes a template hardly grows with the host, and copies of
    an article on one host never make it a template.
    """

    def run(batches):
        for batch in slices(batches, "html"):
            key, host, subtree, content = [], [], [], []
            for k, name, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                root = parse(raw)
                hashes = subtree_hashes(root)
                main = xxhash.xxh3_64_intdigest(b"".join([hashes[x].to_bytes(8, "little") for x in main_elements(root)])) - (1 << 63)
                for h in {*containers(hashes).values()}:
                    key.append(k)
                    host.append(name)
                    subtree.append(h)
                    content.append(main)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(host, pa.string()), pa.array(subtree, pa.int64()), pa.array(content, pa.int64())], ["key", "host", "subtree", "content"])

    found = written(pages.select(_page_key().alias("key"), host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "key long, host string, subtree long, content long"), "subtrees")
    # rows, for joins, and different contents, for the decision
    one = found.groupBy("host", "subtree", "content").agg(F.count(F.lit(1)).alias("rows"))
    often = one.groupBy("host", "subtree").agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least_pages)
    whole = found.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    # ``whole`` has one row a host, so a hot host is a few rows of ``often`` only
    return found, written(often.join(whole, "host").where(F.col("pages") >= least_pages + F.log2("of")).select("host", "subtree", "n"), "templates")


def extract_main_text(pages: DataFrame, *, least_pages: int = 5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): the article of every whole page.

    First the subtrees that recur on many pages of the host go (site_templates);
    of what is left the article is taken, less menus, headers and footers of
    the page, sidebars, notices, adverts, forms, comments of readers, scripts
    and styles.  Character references are decoded, white space in a block is one
    space, blocks are joined by one in page order.

    Null or empty html gives ''; a null url is a host of its own name; ids may
    be null; repeated rows count as one page and give equal rows; pages are read
    whole, in time in proportion to their length; an empty table gives no rows;
    other columns go.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    found, templates = site_templates(rows, least_pages=least_pages)
    on = ["host", "subtree"]
    recurring = join_hot(found.select("key", *on), templates.select(*on), on, templates, found.count())
    removed = recurring.groupBy("key").agg(F.collect_set("subtree").alias("removed"))

    def run(batches):
        for batch in slices(batches, "html"):
            out = []
            for raw, templates in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                root = parse(raw or "")
                out.append(text_of(main_elements(without_templates(root, {*templates}) if templates else root)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    keyed = rows.withColumn("key", _page_key()).join(removed, "key", "left").select("page_id", "url", "html", "removed")
    return keyed.mapInArrow(run, "page_id long, url string, text string")
