"""HTML extraction by site template removal.

Each page is parsed into a tree. Every element has two hashes. That of its subtree covers tag, attributes and content; that of
its slot covers only the way from the root to it, by tags, roles and classes without digits, no text and no addresses.
Spark counts both per host:

- A subtree that recurs in many different surroundings on its host is template, wherever it stands. Surroundings are counted
  by the hash of the parent, so that copies of a whole page, however many, don't make its paragraphs template.
- The main element of a page is found by descent from its root, each time into the slot that holds most of the text that varies
  on the host. Elements outside it whose slots recur on the host (menus, adverts and footers, though no two have the same
  text) are template as well.

Names decide only what counts can't: on hosts with too few pages or without a slot that varies most, and for what has no main
text inside the main element or in slots of few pages (forms, adverts, reader comments), tags, roles and classes tell it.
The rest is the main text, block by block.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import sliced, stored

#: Fixed values of HTML: elements without an end tag, with text that isn't markup, that begin a block, that close an open p or li.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An open element of the first kind ends before a start tag of the second, up to an element of the third.
IMPLIED = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
#: Elements, roles and words of class or id that hold no main text.
NO_TEXT = frozenset("head script style template noscript iframe object embed svg math canvas audio video nav header footer aside form button select textarea input dialog menu title".split())
#: Those of them that hold no text for readers at all.
NO_MARKUP = frozenset("head script style template noscript title".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NO_CLASS = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad(?:box|banner|slot|unit|space|container|sbygoogle)|advert(?:s|isement|ising)?|banner|sponsor(?:ed)?|promo(?:tion)?|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side-?bar|footer|header|masthead|cookies?|consent|gdpr|notices?|alerts?|announcement|disclaimer|toast|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommended|comments?|disqus|respond|reply|replies|pagination|pager|widget|toolbar|skip-?link|login|search)(?:$|[\s_-])",
    re.I,
)
#: Elements that are told by a class or id inside an article.
CONTAINERS = frozenset("article section div ul ol dl table figure ins details center".split())
#: Elements that may be a page's main element, besides those with a hyphen in their names; and those in which the descent ends.
MAIN = frozenset("html body main article section div table tbody tr td center".split())
#: Share of the varying text of an element that the next one of the descent must hold.
MAIN_SHARE = 0.6
#: Bytes of all hosts' templates up to which they are broadcast; beyond, pages and templates are dealt out by host and part.
BROADCAST_BYTES, PART_PAGES = 32 << 20, 50_000
#: How much more often a subtree must recur on its host than on others, unless it stands on a large share of the host's pages.
LIFT = 4
#: Characters of text from which on a subtree is told from a phrase that articles have in common.
LEAST_CHARS = 20
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/)?(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>|<[!?/][^>]*+>", re.S
)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WHITE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "attrs", "parts", "hash", "chars", "plain", "slot", "up")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.parts, self.hash, self.chars, self.plain, self.slot, self.up = tag, attrs, [], b"", 0, 0, 0, None

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def parse(page: str) -> Node:
    """The tree of a page; parts of a node are its child nodes and its texts, in page order. Never fails."""
    root = Node("", "")
    open_: list[Node] = [root]
    at, raw = 0, None
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            open_[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag, attrs = (m["tag"] or m["tag2"] or "").lower(), m["attrs"] or m["attrs2"] or ""
        if not tag:
            continue
        if m["end"] or m["end2"]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    del open_[k:]
                    break
            continue
        if tag in CLOSES_P and open_[-1].tag == "p":
            open_.pop()
        elif tag in CLOSES_P:
            # A p with open inline elements inside it ends as well.
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag in BLOCK:
                    if open_[k].tag == "p":
                        del open_[k:]
                    break
        if tag in IMPLIED:
            ended, limit = IMPLIED[tag][0].split(), IMPLIED[tag][1]
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag in limit:
                    break
                if open_[k].tag in ended:
                    del open_[k:]
                    break
        node = Node(tag, attrs)
        open_[-1].parts.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in RAW and tag not in BLOCK:
            continue
        if tag in RAW:
            raw = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            node.parts.append(page[at : raw.start() if raw else len(page)])
            at = raw.end() if raw else len(page)
            continue
        open_.append(node)
    if at < len(page):
        open_[-1].parts.append(page[at:])
    return root


def walk(root: Node) -> list[Node]:
    """All elements, parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return out


def hashed(root: Node) -> list[Node]:
    """All elements, with the hashes of subtree and slot, characters of text, and those outside links and scripts (plain)."""
    nodes = walk(root)
    for node in nodes:
        for p in node.children():
            label = p.tag
            if p.attrs.strip():
                named = {name.lower(): a or b or c for name, a, b, c in ATTR.findall(p.attrs)}
                label = f"{p.tag} {DIGITS.sub('', named.get('class', ''))} {named.get('role', '')}"
            p.up, p.slot = node, xxh3_64_intdigest(label.encode("utf-8", "replace"), node.slot)
    for node in reversed(nodes):
        h = blake2b(digest_size=8)
        h.update(f"{node.tag} {WHITE.sub(' ', node.attrs).strip()}\n".encode("utf-8", "replace"))
        for p in node.parts:
            if isinstance(p, Node):
                h.update(b"\x01" + p.hash)
                node.chars += p.chars
                node.plain += p.plain
            elif t := WHITE.sub(" ", p).strip():
                h.update(b"\x02" + t.encode("utf-8", "replace"))
                node.chars += len(t)
                node.plain += len(t)
        if node.tag == "a" or node.tag in RAW:
            node.plain = 0
        node.hash = h.digest()
    return nodes


def singles(nodes: list[Node]) -> set[int]:
    """The slots that one element of the page has alone."""
    once: set[int] = set()
    more: set[int] = set()
    for n in nodes:
        (more if n.slot in once else once).add(n.slot)
    return once - more


def _signed(digest: bytes) -> int:
    return int.from_bytes(digest, "big", signed=True)


def _slot(node: Node) -> int:
    return node.slot - (1 << 64) if node.slot >> 63 else node.slot


def is_chrome(node: Node, inside: bool = False) -> bool:
    """Whether an element holds no main text by its tag, role, class or id.

    Inside an article or main, headers are text, and only whole names of class or id count, on containers alone.
    """
    if node.tag in NO_TEXT and not (inside and node.tag == "header"):
        return True
    if node.attrs.strip() and node.tag not in ("html", "body", "main"):
        for name, a, b, c in ATTR.findall(node.attrs):
            value = CAMEL.sub("-", html.unescape(a or b or c))
            if (name := name.lower()) in ("class", "id"):
                if not inside and NO_CLASS.search(value):
                    return True
                if inside and node.tag in CONTAINERS and any(NO_CLASS.fullmatch(x) and x.lower() not in ("header", "masthead") for x in html.unescape(a or b or c).split()):
                    return True
            elif name == "role" and value.lower() in NO_ROLE or name == "hidden" or name == "aria-hidden" and value == "true":
                return True
    return False


def main_element(root: Node, slots: dict[int, float], names: bool = True) -> Node | None:
    """The element that the descent by varying text ends in, or None where slots don't tell one. slots: mean varying text."""
    alone = singles(walk(root))
    node, held = root, None
    while node.tag not in ("article", "main"):
        fit = [p for p in node.children() if (p.tag in MAIN or "-" in p.tag) and p.slot in alone and _slot(p) in slots and not (names and is_chrome(p))]
        best = max(fit, key=lambda p: slots[_slot(p)], default=None)
        if best is None or slots[_slot(best)] <= 0 or held and slots[_slot(best)] < MAIN_SHARE * held:
            break
        node, held = best, slots[_slot(best)]
    return None if node.tag in ("", "html", "body") else node


def main_text(root: Node, template: frozenset[int] = frozenset(), slots: dict[int, float] | None = None, names: bool = True) -> str:
    """The blocks of the article, one a line. hashed() has been called on root.

    template: hashes of template subtrees; slots: those that recur on the host, with their mean varying text; names: whether tags,
    roles and classes tell what has no main text (without, heads, scripts and the like alone are left out).
    """
    top = main_element(root, slots, names) if slots else None
    around, node = set(), top
    while node:
        around.add(id(node))
        node = node.up

    def dropped(n: Node, inside: bool = False) -> bool:
        if id(n) in around:
            return False
        if _signed(n.hash) in template or n.tag in NO_MARKUP or names and is_chrome(n, inside):
            return True
        return top is not None and not inside and _slot(n) in slots and not any(x.tag == "h1" for x in walk(n))

    # Without a main element by counts, the page's own articles or mains that aren't template bound the main text, if it has one.
    tops, todo = [], [root]
    while todo and top is None and names:
        node = todo.pop()
        if dropped(node):
            continue
        if node.tag in ("article", "main") and node.chars:
            tops.append(node)
        else:
            todo += reversed(node.children())
    blocks: list[str] = []
    now: list[str] = []

    def cut() -> None:
        if now and (line := WHITE.sub(" ", "".join(now)).strip()):
            blocks.append(line)
        now.clear()

    for start in tops or [root]:
        stack: list = [(start, start is not root)]
        while stack:
            p, inside = stack.pop()
            inside = inside or p is not None and p is top
            if p is None:
                cut()
            elif isinstance(p, str):
                now.append(html.unescape(p))
            elif p is not start and dropped(p, inside):
                if p.tag in BLOCK:
                    cut()
            elif p.tag == "br":
                now.append(" ")
            elif p.tag in BLOCK:
                cut()
                stack.append((None, inside))
                stack += [(x, inside) for x in reversed(p.parts)]
            else:
                stack += [(x, inside) for x in reversed(p.parts)]
        cut()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_rows(root: Node) -> list[tuple[int, int, int, bool, int, int]]:
    """hash, parent, slot, alone, chars, plain of each distinct subtree of a page; a row of hash 0 stands for the page itself.

    Subtrees that hold an article, main or body have hash null: pages are copies there, not a frame.
    """
    nodes = hashed(root)
    alone, whole = singles(nodes), {id(root)}
    for node in reversed(nodes):
        if node.tag in ("article", "main", "body", "html", "head") or any(id(p) in whole for p in node.children()):
            whole.add(id(node))
    rows = {(0, _signed(root.hash), 0): (False, 0, 0)}
    for n in nodes:
        if n.chars and n.up is not None:
            rows[_signed(n.hash), _signed(n.up.hash), _slot(n)] = (n.slot in alone, 0 if id(n) in whole else n.chars, n.plain)
    return [(*key, *row) for key, row in rows.items()]


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = 0.3, least_pages: int = 10) -> DataFrame:
    """host, pages, hashes, slots, means: what recurs on a host; pages are counted without copies.

    hashes: subtrees in least_pages different surroundings, however many pages the host has. On a host of fewer than 2 * least_pages
    pages, half of them are enough, but 3 at least. A subtree with less than LEAST_CHARS characters may be a phrase that
    articles have in common: it must recur least_pages times and on a share of all pages. One that stands on less than that
    share must recur LIFT times as often as on the other hosts, or it is text that articles everywhere repeat. slots: those that recur as often, with
    the mean length of text that doesn't recur in them (0 where a page has several of a slot).

    Rows are pre-aggregated within map tasks and dealt out by hash, so a host with a third of all pages is spread. Pages of
    null or no url are of one host, ''; null and empty pages have one row each; an empty table has no templates.
    """
    hosted = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    schema = "host string, hash long, parent long, slot long, alone boolean, chars long, plain long"
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            rows = [(host, *row) for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in page_rows(parse(page or ""))]
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    places = hosted.mapInArrow(run, schema).groupBy("host", "hash", "parent").agg(F.min("slot").alias("slot"), F.min("alone").alias("alone"), F.max("chars").alias("chars"), F.max("plain").alias("plain"))
    counts = places.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("slot"), F.min("alone").alias("alone"), F.max("chars").alias("chars"), F.max("plain").alias("plain"))
    counts = stored(counts, "subtrees")
    total = stored(counts.where("hash = 0").select("host", F.col("n").alias("pages")), "hosts")
    enough = F.least(F.lit(least_pages), F.greatest(F.lit(3), F.col("pages") / 2))
    common = (F.col("n") >= least_pages) & (F.col("n") >= F.col("pages") * share)
    sized = counts.where((F.col("n") >= min(3, least_pages)) & (F.col("chars") > 0)).join(total, "host")
    many = sized.where(common | (F.col("chars") >= LEAST_CHARS) & (F.col("n") >= enough))
    # A phrase that articles have in common recurs on a large host as well, but on others as often; a site's template does not.
    of_hosts = counts.join(many.select("hash").distinct(), "hash", "left_semi").join(total, "host")
    of_hosts = of_hosts.withColumn("rare", F.when((F.col("n") >= 3) & (F.col("n") >= F.col("pages") * share), 0).otherwise(F.col("n")))
    told = of_hosts.join(of_hosts.groupBy("hash").agg(F.sum("rare").alias("anywhere")), "hash")
    everywhere = F.lit(total.agg(F.sum("pages")).first()[0] or 0)
    own = (F.col("rare") == 0) | (F.col("rare") * (everywhere - F.col("pages")) >= LIFT * F.col("pages") * (F.col("anywhere") - F.col("rare")))
    hashes = many.join(told.where(own).select("host", "hash"), ["host", "hash"]).groupBy("host").agg(F.collect_list("hash").alias("hashes"))
    # What recurs doesn't vary; where a page has several of a slot, none of them is its main element.
    varying = F.when((F.col("n") < min(3, least_pages)) & F.col("alone"), F.col("plain")).otherwise(0)
    slots = counts.where("hash <> 0").groupBy("host", "slot").agg(F.sum("n").alias("n"), F.avg(varying).alias("mean")).join(total, "host").where(F.col("n") >= enough)
    slots = slots.groupBy("host").agg(F.collect_list("slot").alias("slots"), F.collect_list("mean").alias("means"))
    return total.join(hashes, "host", "left").join(slots, "host", "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.3, least_pages: int = 10, names: bool = True) -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    A null or empty page has an empty text. A page without a url or a host belongs to the host ''. Pages of any length are read
    whole. Repeated rows count as one page for templates and stay. An empty table gives an empty result; other columns are
    ignored. names: whether tags, roles and classes tell what counts can't.
    """
    found = stored(templates(pages, url_col, html_col, share, least_pages), "templates")
    given = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}  # a host's lists are read once, until another follows some
        for batch in sliced(batches, "_html"):
            texts = []
            for i, (page, host) in enumerate(zip(batch.column("_html").to_pylist(), batch.column("host").to_pylist(), strict=True)):
                if host not in known:
                    if len(known) > 256:
                        known.clear()
                    hashes, slots, means = (batch.column(k)[i].as_py() or () for k in ("hashes", "slots", "means"))
                    known[host] = frozenset(hashes), dict(zip(slots, means, strict=True))
                root = parse(page or "")
                hashed(root)
                texts.append(main_text(root, *known[host], names))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string())], names=["_id", "_url", "text"])

    size = F.sum(F.coalesce(F.size("hashes"), F.lit(0)) * 8 + F.coalesce(F.size("slots"), F.lit(0)) * 16 + 100)
    if (found.select(size).first()[0] or 0) <= BROADCAST_BYTES:
        joined = given.join(F.broadcast(found), "host", "left")
    else:
        parts = F.ceil(F.col("pages") / PART_PAGES).cast("int")
        dealt = found.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        numbers = found.select("host", parts.alias("_parts"))
        numbered = given.join(numbers, "host", "left").withColumn("part", F.pmod(F.xxhash64("_html"), F.coalesce("_parts", F.lit(1))).cast("int"))
        joined = numbered.join(dealt, ["host", "part"], "left")
    out = joined.select("_id", "_url", "_html", "hashes", "slots", "means", "host").mapInArrow(run, given.select("_id", "_url", F.lit("").alias("text")).schema)
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
