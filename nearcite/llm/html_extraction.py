"""Main text of web pages; subtrees that recur across a host's pages are its template and go."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearcite.llm.common import small, stored
from nearcite.llm.tokens import slices

#: A subtree is template if at least so many different pages of its host have it, and at least this share of them.
LEAST_PAGES = 5
LEAST_SHARE = 0.5
SALTS = 16

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea title xmp".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
ASIDE = frozenset("nav header footer aside form dialog menu button select head fieldset search del".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An element named so by id, class, role or label is no part of an article.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer header masthead "
    "comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe signup login popup modal overlay "
    "pagination pager toolbar skip complementary contentinfo search form".split()
)
LISTS = frozenset("ul ol dl table select".split())
NOTHING = frozenset().__contains__
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[^a-zA-Z/!?])|[^<]+|<", re.S)
NAMED = re.compile(r"(?:\b(?:id|class|role|aria-label)\s*=\s*)(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
BLANK = re.compile(r"[\s]+")
#: First part of the path that has another behind it.
SECTION = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*/+([^/?#]+)/"
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


@dataclass(slots=True)
class Node:
    name: str
    aside: bool = False
    parts: list = field(default_factory=list)  # texts and nodes in page order
    value: int = 0  # hash of the subtree, once subtree_hashes has been through


class Open:
    """The elements that are open, innermost last, and how many there are of each name. Pages may nest to any depth."""

    def __init__(self, root: Node):
        self.stack, self.names = [root], Counter()

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.names[node.name] += 1

    def close(self, name: str, barrier) -> None:
        """Ends the innermost element of this name, unless one that the barrier holds back stands between."""
        if not self.names[name]:
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].name == name:
                self.names.subtract(n.name for n in self.stack[depth:])
                del self.stack[depth:]
                return
            if barrier(self.stack[depth].name):
                return


def parse(page: str) -> Node:
    """A tolerant element tree of any depth: open elements end with their parent, unknown ends are passed over."""
    root = Node("#root")
    opened = Open(root)
    stack = opened.stack
    end = 0
    while end < len(page):
        match = TOKEN.match(page, end)
        end = match.end()
        token = match.group()
        if token[0] != "<" or match.group(2) is None:
            if token[0] != "<" or token == "<":
                stack[-1].parts.append(token)
            continue
        closing, name, attributes = match.group(1), match.group(2).lower(), match.group(3)
        if closing:
            opened.close(name, (lambda n: n not in INLINE) if name in INLINE else NOTHING)
            continue
        if name in RAW and not attributes.rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, end)
            end = close.end() if close else len(page)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                stack[-1].parts.append(Node(name))
            continue
        if name in CLOSES_P:
            opened.close("p", CLOSES_P.__contains__)
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            group = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            for own in group:
                opened.close(own, LISTS.__contains__)
        names = {w for m in NAMED.finditer(attributes) for w in SPLIT.split((m[1] or m[2] or m[3] or "").lower())} if attributes else ()
        node = Node(name, name in ASIDE or bool(attributes and HIDDEN.search(attributes)) or bool(ASIDE_NAMES.intersection(names)))
        if name in ("html", "body", "article", "main"):
            node.aside = False
        stack[-1].parts.append(node)
        if not (attributes and attributes.rstrip().endswith("/") and name not in ("p", "div")):
            opened.push(node)
    return root


def main_part(root: Node) -> list[Node]:
    """The outermost article elements, or else main, or else the whole page without its sides."""
    for names in (("article",), ("main",)):
        if found := [n for n in _find_open(root, names) if _text(n)]:
            return found
    return [root]


def _find_open(node: Node, names: tuple[str, ...]) -> list[Node]:
    """Outermost elements of these names that are in no element at the side, in page order."""
    found, ahead = [], [node]
    while ahead:
        own = ahead.pop()
        if own is not node and own.name in names:
            found.append(own)
        else:
            ahead += [part for part in reversed(own.parts) if isinstance(part, Node) and not part.aside]
    return found


def _text(node: Node) -> str:
    return " ".join(blocks(node, frozenset()))


def subtree_hashes(root: Node) -> list[int]:
    """Gives every element its hash, from its name, texts and children; those of all block elements that have content."""
    order = [root]
    for node in order:  # grows by the children of each: parents stand before them
        order += [part for part in node.parts if isinstance(part, Node)]
    found = []
    for node in reversed(order):
        own = xxhash.xxh3_64(node.name.encode())
        for part in node.parts:
            if isinstance(part, Node):
                own.update(part.value.to_bytes(8, "little"))
            else:
                own.update(BLANK.sub(" ", part).strip().encode("utf-8", "surrogatepass"))
        node.value = own.intdigest()
        if node is not root and node.name not in INLINE and node.parts:
            found.append(node.value)
    return found


def blocks(node: Node, template: frozenset[int]) -> Iterator[str]:
    """Texts of blocks in page order: character references decoded, white space as one blank, none empty."""
    run: list[str] = []
    for text in _stream(node, template):
        if text is None:
            if joined := BLANK.sub(" ", html.unescape("".join(run))).strip():
                yield joined
            run = []
        else:
            run.append(text)
    if joined := BLANK.sub(" ", html.unescape("".join(run))).strip():
        yield joined


def _stream(node: Node, template: frozenset[int]) -> Iterator[str | None]:
    """Raw texts, and None where a block begins or ends."""
    ahead: list = [*reversed(node.parts)]
    while ahead:
        part = ahead.pop()
        if not isinstance(part, Node):
            yield part
        elif part.name in ("br", "hr") or part.aside or (part.name not in INLINE and part.value in template):
            yield None
        elif part.name in INLINE:
            ahead += reversed(part.parts)
        else:
            yield None
            ahead.append(None)  # the end of the block
            ahead += reversed(part.parts)


def extract(page: str | None, template: frozenset[int] = frozenset()) -> str:
    """The main text of one page; empty for null and empty pages."""
    root = parse(page or "")
    if template:
        subtree_hashes(root)
    return " ".join(" ".join(blocks(n, template)) for n in main_part(root)).strip()


def _page_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_groups, _body (hash of the main text) and _trees (hashes of the distinct subtrees) of every page."""
    for batch in batches:
        for part in slices(batch, "_html"):
            bodies, trees = [], []
            for page in part["_html"].to_pylist():
                root = parse(page or "")
                body = " ".join(_text(n) for n in main_part(root))
                bodies.append(_signed(xxhash.xxh3_64_intdigest(body.encode("utf-8", "surrogatepass"))))
                trees.append([_signed(t) for t in set(subtree_hashes(root))])
            columns = [part["_groups"], pa.array(bodies, pa.int64()), pa.array(trees, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_groups", "_body", "_trees"])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """_group and _template: hashes of the subtrees that recur across many pages of a host, or of a section of it.

    Pages of equal main text count as one, that of the fewest subtrees, so copies of an article don't make
    it a template. Counts are summed in tasks first. A page has a bounded number of subtrees on average, so
    those on at least a share s of the pages are at most that number / s: the array of a group is bounded
    however many pages it has.
    """
    trees = pages.mapInArrow(_page_subtrees, "_groups array<string>, _body long, _trees array<long>")
    grouped = trees.select(F.explode("_groups").alias("_group"), "_body", "_trees").groupBy("_group", "_body")
    one = stored(grouped.agg(F.min(F.struct(F.size("_trees").alias("n"), "_trees")).alias("_m")).select("_group", "_m._trees"), "subtrees")
    totals = one.groupBy("_group").agg(F.count("*").alias("_pages")).where(F.col("_pages") >= least_pages)
    counts = one.select("_group", F.explode("_trees").alias("_tree")).groupBy("_group", "_tree").agg(F.count("*").alias("_n"))
    often = counts.where(F.col("_n") >= least_pages).join(totals, "_group").where(F.col("_n") >= least_share * F.col("_pages"))
    return often.groupBy("_group").agg(F.sort_array(F.collect_list("_tree")).alias("_template"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ready: dict[tuple, frozenset[int]] = {}
    for batch in batches:
        for part in slices(batch, "_html"):
            texts = []
            given = zip(part["_groups"].to_pylist(), part["_html"].to_pylist(), part["_host_template"], part["_section_template"], strict=True)
            for groups, page, *found in given:
                key = tuple(groups)
                if key not in ready:
                    if len(ready) > 1000:
                        ready.clear()
                    ready[key] = frozenset(t % (1 << 64) for template in found for t in template.as_py() or ())
                texts.append(extract(page, ready[key]))
            columns = [part["_id"], part["_url"], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_url", "text"])


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE,
) -> DataFrame:
    """_id, _url and text of every page.

    Elements at the side by their HTML role or name go, then subtrees that recur across the page's host or its
    section of it (the first part of the path), from the article elements (main, or the body, where there is none).
    Elements may nest to any depth. Null and empty pages give an empty text; null urls and urls without a host have
    no template; repeated rows are extracted each; a long page is parsed whole; an empty table gives no rows; other
    columns are not read. Templates join pages by group: broadcast while their number is small, else over salted
    groups, so that a host of any size is spread.
    """
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    host, section = F.lower(F.regexp_extract(url, HOST, 1)), F.regexp_extract(url, SECTION, 1)
    groups = F.when(host == "", F.array().cast("array<string>")).otherwise(F.array(host, F.concat_ws("/", host, section)))
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"), F.col(f"`{html_col}`").alias("_html"), groups.alias("_groups"))
    found = stored(templates(rows.select("_groups", "_html"), least_pages, least_share), "templates")
    salted = stored(found.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))), "salted-templates")
    joined = rows.withColumn("_salt", F.pmod(F.xxhash64("_url", "_id"), F.lit(SALTS)).cast("int"))
    for i, name in enumerate(("_host_template", "_section_template")):
        own = salted.withColumnRenamed("_template", name)
        joined = joined.withColumn("_group", F.get("_groups", F.lit(i))).join(small(own, 20_000), ["_group", "_salt"], "left").drop("_group")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    slim = joined.select("_id", "_url", "_groups", "_html", "_host_template", "_section_template")
    return slim.mapInArrow(_extracted, f"_id {kinds['_id']}, _url {kinds['_url']}, text string")


def report(pages: DataFrame) -> DataFrame:
    out = extract_pages(pages)
    return out.select(F.col("_id").alias("page_id"), F.col("_url").alias("url"), "text", F.length("text").cast("bigint").alias("n_chars"))

