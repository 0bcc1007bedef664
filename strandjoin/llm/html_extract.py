"""Main text of web pages with a site style tree.

The DOMs of a host are merged into a style tree, whose nodes are paths of labels (element and
classes). A node has a presentation importance, the entropy of the sets of child sequences that pages
show there, and a content importance, one minus the mean entropy of its text blocks over the host's
pages; both are in 0..1 and weigh into its composite importance. A branch in which no node is
important is nearly the same on all pages of a host: its blocks that min_pages pages have are removed
from each page, other text in it stays. Pages of a host with the same article count once, so that
copies of an article aren't taken for a template, and a node counts from min_pages distinct pages on.
Without a marked article the whole text of the page is compared.

Elements that are never article text (scripts, forms, menus...) are pruned while merging, and those
whose role or id says so. A class says so if all words of it are marks or say where things are
(share-buttons does, share-price doesn't); within a marked article only classes of comments, adverts
and menus do, and the tree decides on the rest, so that no paragraph of an article goes for a word.
Where a page marks articles, those are the page: all that aren't in another one, in page order.

Paths are followed to `deepest` labels; what is below belongs to the node there. Nothing is recursive
and the tokenizer reads a page once, so that deep and malformed pages cost time by their length: where
a tag's quotes don't close, that tag and those after it end at their first >. An unclosed comment or
script takes the rest of the page, as it does in browsers.

Character references are decoded, white space inside a block becomes one space, blocks are joined
in page order by one space. Null html is empty, empty pages have an empty text; a null or odd url is
host ''. Rows that repeat are extracted each by itself, further columns are ignored whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

# HTML's void, raw-text and inline elements, elements that hold no article text, and words in class, id and role that mark such elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head title script style noscript template iframe object embed svg canvas audio video map nav footer aside form button select option optgroup textarea input fieldset dialog menu noembed noframes xmp".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent notice gdpr popup modal overlay newsletter subscribe social share sharing related recommended recommendations comment comments disqus replies reply respond widget toolbar pagination pager login signup search complementary contentinfo alert dialog".split())
#: Of these those that also prune within a marked article.
INNER_MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies respond cookie cookies consent newsletter pagination".split())
#: Words that say where or what a box is, not what it is about.
PLACES = frozenset("area bar block bottom box button buttons container content group holder icons inner item items left link links list main outer panel right row section site thread top wrap wrapper".split())
HEADER_MARKS = frozenset("header masthead topbar".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table article section div body html td th main aside nav select".split())

NAME = re.compile(r"[a-zA-Z][^\s>/]*")
ATTR = re.compile(r"""\b(class|id|role|hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
QUOTED = re.compile(r"""[>"']""")
SPLIT = re.compile(r"[^a-z0-9]+")
DEEPEST = 64


class Node:
    """An element. chain: the hashes of its path and of those around it, outermost first."""

    __slots__ = ("chain", "children", "label", "noise", "root", "size", "tag", "up")

    def __init__(self, tag: str, label: str, up: Node | None, noise: bool, root: bool):
        self.tag, self.label, self.up, self.noise, self.root, self.size = tag, label, up, noise, root, 0
        around = up.chain if up else ()
        self.chain = around if len(around) >= DEEPEST else (*around, xxhash.xxh3_64_intdigest(f"{around[-1] if around else 0}/{label}") >> 1)
        self.children: list[Node | str] = []


def says(classes: str, marks: frozenset) -> bool:
    """Whether one of the classes names a mark and, besides marks, only places."""
    for c in classes.lower().split():
        words = {w.rstrip("0123456789") for w in SPLIT.split(c)} - {""}
        if words & marks and words <= marks | PLACES:
            return True
    return False


class Tags:
    """The tokens of a page in one pass: (text, None, None), (name, attributes, False) for a start tag, (name, None, True) for an end tag."""

    def __init__(self, page: str):
        self.page, self.at, self.plain = page, 0, False
        self.last = page.rfind(">")

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose attributes begin at `at`."""
        page, k = self.page, at
        while not self.plain:
            m = QUOTED.search(page, k)
            if m and m[0] == ">":
                return m.start()
            k = page.find(m[0], m.end()) + 1 if m else 0
            if not k:  # an open quote: from here on they aren't looked at
                self.plain = True
        return page.find(">", at)

    def __iter__(self) -> Iterator[tuple[str, str | None, bool | None]]:
        page, begin = self.page, 0
        while True:
            k = page.find("<", self.at)
            if k < 0 or (k > self.last and not page.startswith("<!--", k)):
                break
            close = page.startswith("</", k)
            m = NAME.match(page, k + 1 + close)
            if m:
                gt = self.end(m.end())
                after, token = gt + 1, (m[0].lower(), None if close else page[m.end() : gt], close)
            elif page.startswith("<!--", k):
                gt = page.find("-->", k + 4)
                after, token = gt + 3 if gt >= 0 else len(page), None
            elif page.startswith("<![CDATA[", k) and (gt := page.find("]]>", k)) >= 0:
                after, token = gt + 3, None
            elif page.startswith(("<!", "<?"), k):
                after, token = page.find(">", k) + 1, None
            else:
                self.at = k + 1
                continue
            if k > begin:
                yield page[begin:k], None, None
            self.at = begin = after
            if token:
                yield token
                begin = self.at  # a raw element's text is skipped by the reader
        if begin < len(page):
            yield page[begin:], None, None

    def skip(self, name: str) -> None:
        """Past the end tag of a raw element."""
        m = re.compile(rf"</{name}(?![^\s>/])[^>]*>", re.I).search(self.page, self.at)
        self.at = m.end() if m else len(self.page)


class Open:
    """The open elements, and where in them those of each tag are, so that no search walks over them."""

    def __init__(self, top: Node):
        self.stack, self.names, self.at = [top], ["html"], defaultdict(list)

    def push(self, node: Node, name: str) -> None:
        self.at[name].append(len(self.stack))
        self.stack.append(node)
        self.names.append(name)

    def highest(self, tags: Iterable[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def cut(self, k: int) -> None:
        for name in self.names[k:]:
            self.at[name].pop()
        del self.stack[k:], self.names[k:]


def parse(page: str) -> Node:
    """The tree of a page without what is noise; text nodes are strings with their references decoded. Each node knows the length of its text."""
    top = Node("html", "html", None, False, False)
    tags, opened, order = Tags(page), Open(top), []
    for name, attrs, close in tags:
        up = opened.stack[-1]
        if close is None:
            if not up.noise:
                text = html.unescape(name) if "&" in name else name
                up.children.append(text)
                up.size += len(text)
            continue
        if close:
            if k := opened.highest((name,)):
                opened.cut(k)
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P and (k := opened.highest("p")) > opened.highest(SCOPES):
            opened.cut(k)
        if name in SIBLINGS:
            own, rows = SIBLINGS[name], name in ("tr", "tbody", "tfoot", "thead")
            while (k := opened.highest(own)) > opened.highest(SCOPES - own):
                opened.cut(k)
                if not rows:
                    break
        up = opened.stack[-1]
        found = {x.lower(): (a or b or c) for x, a, b, c in ATTR.findall(attrs)} if attrs else {}
        classes, role = found.get("class", ""), found.get("role", "").lower()
        marked = name == "article" or role == "article" or "articlebody" in found.get("itemprop", "").lower()
        root = marked or name == "main" or role == "main"
        within = up.root
        marks = INNER_MARKS if within or root else MARKS
        noise = up.noise or name in NEVER or "hidden" in found or role in MARKS or says(classes, marks) or says(found.get("id", ""), marks)
        noise = noise or (not within and (name == "header" or says(f"{classes} {found.get('id', '')} {role}", HEADER_MARKS)))
        label = name + "".join(f".{w}" for w in SPLIT.split(classes.lower()) if w and not w.isdigit())
        node = Node(name, label, up, noise, within or root)
        if root and not marked and not noise:
            node.tag = "main"
        elif marked:
            node.tag = "article"
        if not noise:
            up.children.append(node)
            order.append(node)
        if name in RAW:
            tags.skip(name)
        elif name not in VOID and not attrs.endswith("/"):
            opened.push(node, name)
    for node in reversed(order):
        node.up.size += node.size
    return top


def articles(top: Node) -> list[Node]:
    """The branches that the page marks as its articles and that have text, without those inside one; else its main branches; else the page."""
    for tag in ("article", "main"):
        found, todo = [], [top]
        while todo:
            n = todo.pop()
            if n.tag == tag and n.size and n.up:
                found.append(n)
            else:
                todo += [c for c in reversed(n.children) if isinstance(c, Node)]
        if found:
            return found
    return [top]


def blocks(node: Node) -> Iterator[tuple[Node, str]]:
    """The text blocks below node, in page order, each with its element."""
    held: list[str] = []

    def flush(n: Node) -> Iterator[tuple[Node, str]]:
        words = " ".join("".join(held).split())
        held.clear()
        if words:
            yield n, words

    # frames: a node and what is left of its children
    todo = [(node, iter(node.children))]
    while todo:
        n, rest = todo[-1]
        c = next(rest, None)
        if c is None:
            todo.pop()
            if n is node or n.tag not in INLINE:
                yield from flush(n)
        elif isinstance(c, str):
            held.append(c)
        elif c.tag == "br":
            held.append(" ")
        else:
            if c.tag not in INLINE:
                yield from flush(n)
            todo.append((c, iter(c.children)))


def block_key(words: str) -> int:
    return xxhash.xxh3_64_intdigest(words) >> 1


def article_text(top: Node, removed: dict[int, set[int]] | None = None) -> str:
    """The page's text, without the blocks that removed (path -> keys) names in a branch."""

    def kept(chain: tuple[int, ...], words: str) -> bool:
        key = block_key(words)
        return not any(key in removed.get(path, ()) for path in chain)

    return " ".join(w for root in articles(top) for n, w in blocks(root) if not removed or kept(n.chain, w))


def style_rows(top: Node) -> Iterator[tuple[int, int, int, tuple[int, ...] | None]]:
    """(path, kind, key, around) of a page: kind 0 the element with the paths around it, 1 the set of child sequences it has on the page, 2 a text block in its branch."""
    shapes: dict[tuple[int, ...], set[str]] = defaultdict(set)
    todo = [top]
    while todo:
        n = todo.pop()
        for c in n.children:
            if isinstance(c, Node) and c.tag not in INLINE and c.tag not in VOID:
                shapes[c.chain].add(",".join(x.label for x in c.children if isinstance(x, Node)))
                todo.append(c)
    for chain, found in shapes.items():
        yield chain[-1], 0, 0, chain[1:]
        yield chain[-1], 1, xxhash.xxh3_64_intdigest("|".join(sorted(found))) >> 1, None
    seen: set[tuple[int, int]] = set()
    for n, words in blocks(top):
        h = block_key(words)
        for path in n.chain[1:]:
            if (path, h) not in seen:
                seen.add((path, h))
                yield path, 2, h, None


def importances(keys: DataFrame, min_pages: int, gamma: float) -> DataFrame:
    """host, path, around, m (pages), importance of the nodes on min_pages pages that have text. keys: host, path, kind, key, around, n (pages that have it)."""
    m = F.max(F.when(F.col("kind") == 0, F.col("n")))
    ln = F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log(F.col("n"))))
    nodes = keys.groupBy("host", "path").agg(m.alias("m"), F.max("around").alias("around"), ln.alias("shapes"), F.sum(F.when(F.col("kind") == 2, F.log("n"))).alias("repeats"), F.sum((F.col("kind") == 2).cast("long")).alias("blocks"))
    # a branch without text has nothing to lose and doesn't keep the one around it
    nodes = nodes.filter((F.col("m") >= min_pages) & (F.col("blocks") > 0))
    # entropy of the pages' sets of shapes in base m; a block on k of m pages has an entropy of log_m k over them
    presentation = (F.log("m") - F.col("shapes") / F.col("m")) / F.log("m")
    content = 1 - F.col("repeats") / F.col("blocks") / F.log("m")
    return nodes.select("host", "path", "around", "m", ((1 - F.lit(gamma)) * presentation + F.lit(gamma) * content).alias("importance"))


def style_keys(pages: DataFrame) -> DataFrame:
    """host, path, kind, key, around, n: in how many of the host's distinct pages each element, set of child sequences and text block is. pages: host, page_hash, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, offsets, rows = [], [0], []
            for page in b["html"]:
                top = parse(page.as_py())
                texts.append(block_key(article_text(top)))
                rows += style_rows(top)
                offsets.append(len(rows))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), (), ()), kinds, strict=True)]
            nested = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(cols, ["path", "kind", "key", "around"]))
            yield pa.RecordBatch.from_arrays([b["host"], b["page_hash"], pa.array(texts, pa.int64()), nested], names=["host", "page_hash", "article", "rows"])

    rows = pages.select("host", "page_hash", "html").mapInArrow(run, "host string, page_hash long, article long, rows array<struct<path:long,kind:int,key:long,around:array<long>>>")
    once = rows.groupBy("host", "article").agg(F.min_by("rows", "page_hash").alias("rows"))
    return once.select("host", F.explode("rows").alias("r")).groupBy("host", "r.path", "r.kind", "r.key").agg(F.max("r.around").alias("around"), F.count("*").alias("n"))


def style_tree(pages: DataFrame, min_pages: int = 5, threshold: float = 0.1, gamma: float = 0.9) -> DataFrame:
    """host, path, keys of the branches in which no node is important: the text blocks that min_pages pages or more have there."""
    keys = materialise(style_keys(pages), "style_keys")
    nodes = importances(keys, min_pages, gamma)
    low = nodes.select("host", F.explode("around").alias("path"), "importance", F.col("path").alias("own")).groupBy("host", "path").agg(F.max("importance").alias("importance"), F.max(F.col("own") == F.col("path")).alias("node"))
    low = low.filter(F.col("node") & (F.col("importance") < threshold)).select("host", "path")
    return keys.filter((F.col("kind") == 2) & (F.col("n") >= min_pages)).join(low, ["host", "path"]).groupBy("host", "path").agg(F.collect_list("key").alias("keys"))


def extract(pages: DataFrame, min_pages: int = 5, threshold: float = 0.1, max_broadcast_nodes: int = 50_000, salts: int = 16) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit("")).alias("host"))
    p = p.withColumn("page_hash", F.xxhash64("html"))
    low = materialise(style_tree(p, min_pages, threshold), "style_nodes")
    removed = low.groupBy("host").agg(F.collect_list(F.struct("path", "keys")).alias("removed"))
    if (low.agg(F.sum(F.size("keys"))).first()[0] or 0) <= max_broadcast_nodes:
        joined = p.join(F.broadcast(removed), "host", "left")
    else:  # a host may hold a third of all pages
        salted = removed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = p.withColumn("salt", F.pmod("page_hash", F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [article_text(parse(page.as_py()), {r["path"]: set(r["keys"]) for r in gone or ()}) for page, gone in zip(b["html"], b["removed"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "removed").mapInArrow(run, "page_id long, url string, text string, n_chars long")
