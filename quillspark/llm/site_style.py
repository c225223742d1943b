"""Main text of web pages through a site style tree.

The pages of a host are merged into one style tree: a node is the path of elements with their
class and id (digits folded). It is built from whole pages, but for scripts, styles, comments and
what is hidden. For each node the tree knows on how many distinct pages it stands, how often each
layout (the sequence of its child elements) and each content occurs there; pages with the same
blocks count once, so that copies and mirrors do not make an article look repeated. A node's
importance combines its presentation with the contents below it: with L layouts it is
(1 - DAMP^L) times the entropy of the layouts plus DAMP^L times the mean entropy of the contents
of the nodes below that hold text, entropies being over the most that so many pages could have. A
branch of low importance says the same in the same form on page after page, and is cut from every
page of the host, once PAGES distinct pages of it are there to tell; a page of which nothing would
be left keeps its blocks. Bare text elements (a paragraph without class or id) share their parent's
importance, so that a site of copies does not lose its articles.

What the tree cannot know follows by fixed rules: hosts of few pages, and branches whose contents
change from page to page though they are no part of the article (reader comments, adverts, links
to other articles). What the names of elements, classes, ids and roles say is a menu, header,
footer, sidebar, notice, advert, form or reader comment goes; where there is an article or main
element, what is outside goes. A class says so if all its parts do, or stand with words that say
only where it is or what form it has: cookie-notice and ad-slot go, share-price stays. The output
counts what the tree cut and what the rules did.

The tree is counted by partial aggregation over (host, node, layout) and (host, node, content); a
host with a third of all pages is no more than its distinct ones. No page's markup is shuffled:
pages are parsed once into blocks, written to the shared folder, and blocks are filtered by a join
on the host.

Odd rows: a null or empty page gives an empty text; a null url is a host of its own; rows come
back one for one; unclosed tags, comments and scripts end with the page; extra columns are not
read; an empty table gives an empty result; a branch right at the least importance stays."""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, id_type

#: Pages of a host from which the tree decides, the importance below which a branch goes, and what a node's contents count for by its number of layouts.
PAGES, LEAST, DAMP = 6, 0.35, 0.9
#: Bytes of the table of branches to cut up to which it is broadcast.
BROADCAST = 16 << 20

#: Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BARE = frozenset("p h1 h2 h3 h4 h5 h6 li td th tr tbody thead dt dd blockquote pre figure figcaption article main body html".split()) | INLINE
NOISE_TAGS = frozenset("nav footer aside form button dialog menu fieldset select".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navigation navbar menu breadcrumb breadcrumbs sidebar widget footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus reply replies reactions toolbar pagination pager copyright complementary contentinfo search".split()
)
#: Words that say where a part stands or what form it has, and so leave a name what its other words make it.
FORM_WORDS = frozenset(
    "area articles bar big block body bottom box button buttons center class container content count cta desktop element entry feed float form global group header icon icons id image img inline inner item items js label large left link links list main message mobile module outer page panel part placement post posts primary region right role row secondary section site slot small stories sticky tab tabs text thread title toggle top trail unit user wrap wrapper zone".split()
)
#: With one of these a name says what stands beside it, as in has-sidebar.
BESIDE = frozenset("with has no without".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    r"""|<(?P<raw>script|style|noscript|template|iframe|textarea|svg|title|object)(?=[\s/>])[^>]*(?:>|\Z).*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)"""
    r"""|<[!?/][^>]*(?:>|\Z)"""
    r"""|(?P<text>[^<]+|<)""",
    re.I | re.S,
)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[a-z]+")


def node(parent: int, tag: str, label: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent}/{tag}.{label}") - (1 << 63)


#: What stands against a block: a part that its element says is none of the article, or only a name.
BY_ELEMENT, BY_NAME = 2, 1


def says_noise(value: str) -> bool:
    """Whether one class, id or role names a part beside the article."""
    words = set(WORD.findall(value))
    return bool(words & NOISE_NAMES) and not words & BESIDE and words <= NOISE_NAMES | FORM_WORDS


class Page:
    """Blocks of one page: (style nodes that may go, text, what stands against it, whether it is in an
    article), and the layouts of the nodes."""

    def __init__(self, source: str):
        self.blocks: list[tuple[tuple[int, ...], str, int, bool]] = []
        self.buffer: list[str] = []
        self.aside: list[tuple[tuple, list[str]]] = []  # text in parts that something stands against, beside the open block
        self.layouts: dict[int, xxhash.xxh64] = {}
        # each open element: name, style node, hidden, what stands against it, whether it is in an article, nodes that may go
        self.stack: list[tuple[str, int, bool, int, bool, tuple[int, ...]]] = [("", 0, False, 0, False, ())]
        self.at = self.stack[0]
        for m in TOKEN.finditer(source):
            text = m["text"]
            if text is not None:
                self.say(text)
                continue
            tag = m["tag"] or m["tag2"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"] or m["end2"]:
                self.close(tag)
            else:
                self.open(tag, m["attrs"] if m["tag"] else m["attrs2"])
        self.flush()

    def say(self, text: str) -> None:
        here = self.stack[-1]
        if here[2]:
            return
        if not here[3]:
            if not self.buffer:
                self.at = here
            self.buffer.append(text)
        elif self.aside and self.aside[-1][0][3:] == here[3:]:
            self.aside[-1][1].append(text)
        else:
            self.aside.append((here, [text]))

    def flush(self) -> None:
        for at, texts in [(self.at, self.buffer), *self.aside]:
            text = "".join(texts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                self.blocks.append((at[5], text, at[3], at[4]))
        self.buffer, self.aside = [], []

    def space(self) -> None:
        if self.buffer and not self.stack[-1][3]:
            self.buffer.append(" ")
        if self.aside:
            self.aside[-1][1].append(" ")

    def pop_to(self, names: set[str] | frozenset[str], stops: set[str]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in names:
                del self.stack[i:]
                return
            if self.stack[i][0] in stops:
                return

    def open(self, tag: str, attrs: str) -> None:
        if tag not in INLINE:
            self.flush()
            if tag in CLOSES_P:
                self.pop_to({"p"}, {"td", "th", "li", "table", "div", "section", "article"})
            if tag in SIBLINGS and tag != "p":
                self.pop_to(SIBLINGS[tag], STOPS.get(tag, set()))
        elif tag == "br":
            self.space()
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
            return
        _, parent, hidden, against, inside, chain = self.stack[-1]
        label, names = "", []
        if attrs and not attrs.isspace():
            for key, *values in NAMED.findall(attrs):
                key, value = key.lower(), "".join(values).lower()
                if key in ("class", "id", "role"):
                    label += f"{key[0]}={value};"
                    names += value.split()
                elif key == "style":
                    hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
                else:
                    hidden |= value != "false"
        label = re.sub(r"\d+", "9", label)
        own = node(parent, tag, label)
        if tag not in INLINE and chain:
            self.layouts.setdefault(chain[-1], xxhash.xxh64()).update(f"{tag}.{label}\n")
        words = {w for x in names for w in WORD.findall(x)}
        main = tag in ("article", "main") or tag == "div" and "main" in words and words <= {"main", "article", "content"}
        plain = tag in ("html", "body", "article", "main")
        if not plain or words & {"comment", "comments"}:  # an article may be a comment
            if tag in NOISE_TAGS or not inside and tag == "header":
                against |= BY_ELEMENT | BY_NAME
            elif any(map(says_noise, names)) or not inside and any(x == "header" or x.endswith(("-header", "_header")) for x in names):
                against |= BY_NAME
        if label and not plain or tag not in BARE:
            chain = (*chain, own)
        self.stack.append((tag, own, hidden, against, inside or main, chain))

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.space()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return

    def contents(self) -> dict[int, tuple[tuple[int, ...], int]]:
        """Of each node that holds text, its chain and a hash of what it says."""
        says: dict[int, tuple[tuple[int, ...], xxhash.xxh64]] = {}
        for chain, text, *_ in self.blocks:
            if chain:
                says.setdefault(chain[-1], (chain, xxhash.xxh64()))[1].update(text + "\n")
        return {n: (chain, h.intdigest() - (1 << 63)) for n, (chain, h) in says.items()}


def host_of(url: str | None) -> str:
    found = re.match(r"[a-z][a-z0-9+.-]*://([^/?#]*)", url or "", re.I)
    return found[1].lower() if found else ""


def entropy(counts: DataFrame, by: list[str]) -> DataFrame:
    """Of counts c of the kinds of something: n, how many kinds, and the entropy over the most of n."""
    out = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.sum(F.col("c") * F.log("c")).alias("s"))
    return out.select(*by, "n", "kinds", F.when(F.col("n") > 1, (F.log("n") - F.col("s") / F.col("n")) / F.log("n")).otherwise(1.0).alias("h"))


def style_tree(parsed: DataFrame) -> DataFrame:
    """host, node, n (distinct pages with the node), importance, of parsed pages (host, same, nodes,
    layouts): nodes hold what is said where, layouts the forms."""
    distinct = parsed.select("host", "same", "nodes", "layouts").dropDuplicates(["host", "same"])
    said = distinct.select("host", F.inline("nodes")).groupBy("host", "node", "chain", "content").agg(F.count("*").cast("double").alias("c"))
    contents = entropy(said, ["host", "node", "chain"])
    below = contents.select("host", "n", "h", F.explode("chain").alias("node")).groupBy("host", "node").agg(F.max("n").alias("n"), (F.sum(F.col("n") * F.col("h")) / F.sum("n")).alias("content"))
    formed = distinct.select("host", F.inline("layouts")).groupBy("host", "node", "layout").agg(F.count("*").cast("double").alias("c"))
    forms = entropy(formed, ["host", "node"]).select(F.col("host").alias("fh"), F.col("node").alias("fn"), "kinds", "h")
    both = below.join(forms, F.col("host").eqNullSafe(F.col("fh")) & (F.col("node") == F.col("fn")), "left")
    rest = F.pow(F.lit(DAMP), F.coalesce("kinds", F.lit(0)))  # a node without child elements has its contents only
    return both.select("host", "node", "n", ((1 - rest) * F.coalesce("h", F.lit(0.0)) + rest * F.col("content")).alias("importance"))


def extract(pages: DataFrame) -> DataFrame:
    """Returns page_id, url, text, n_chars, n_tree (blocks that the tree cut) and n_rules (blocks that the
    rules did) for every row."""
    tables = Tables(pages.sparkSession, "style")
    kinds = {
        "host": pa.string(), "same": pa.int64(),
        "blocks": pa.list_(pa.struct([("chain", pa.list_(pa.int64())), ("text", pa.string()), ("against", pa.int32()), ("inside", pa.bool_())])),
        "nodes": pa.list_(pa.struct([("node", pa.int64()), ("chain", pa.list_(pa.int64())), ("content", pa.int64())])), "layouts": pa.list_(pa.struct([("node", pa.int64()), ("layout", pa.int64())])),
    }

    def parse(batches):
        for batch in batches:
            rows = []
            for url, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                page = Page(source or "")
                blocks = [{"chain": list(c), "text": t, "against": a, "inside": i} for c, t, a, i in page.blocks]
                nodes = [{"node": n, "chain": list(c), "content": h} for n, (c, h) in page.contents().items()]
                layouts = [{"node": n, "layout": h.intdigest() - (1 << 63)} for n, h in page.layouts.items()]
                rows.append((host_of(url), xxhash.xxh64_intdigest(repr(page.blocks)) - (1 << 63), blocks, nodes, layouts))
            cols = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True))], ["page_id", "url", *kinds])

    schema = (
        f"page_id {id_type(pages, 'page_id')}, url string, host string, same bigint, blocks array<struct<chain:array<bigint>,text:string,against:int,inside:boolean>>, "
        "nodes array<struct<node:bigint,chain:array<bigint>,content:bigint>>, layouts array<struct<node:bigint,layout:bigint>>"
    )
    parsed = tables.write(pages.select("page_id", "url", "html").mapInArrow(parse, schema), "pages")
    low = style_tree(parsed).where(F.col("n") >= PAGES).where(F.col("importance") < LEAST).groupBy("host").agg(F.collect_list("node").alias("low"))
    low = tables.write(low, "low")
    size = low.agg(F.coalesce(F.sum(F.size("low") * 8 + F.length("host") + 64), F.lit(0))).first()[0]
    # what goes is a few nodes a host; sent to all tasks where that is little, else joined on the host
    joined = parsed.select("page_id", "url", "host", "blocks").join(F.broadcast(low) if size <= BROADCAST else low, "host", "left")
    told = F.filter("blocks", lambda b: ~F.arrays_overlap(b.chain, F.col("low")))
    joined = joined.withColumn("tree", F.when(F.col("low").isNull() | (F.size(told) == 0), F.col("blocks")).otherwise(told))

    def kept(against: int):
        free = F.filter("tree", lambda b: b.against.bitwiseAND(F.lit(against)) == 0)
        within = F.filter(free, lambda b: b.inside)
        return F.when(F.size(within) > 0, within).otherwise(free)

    # a page of which names leave nothing is judged by its elements alone
    left = joined.select("page_id", "url", "blocks", "tree", kept(BY_NAME).alias("named"), kept(BY_ELEMENT).alias("plain"))
    left = left.select("page_id", "url", "blocks", "tree", F.when(F.size("named") > 0, F.col("named")).otherwise(F.col("plain")).alias("left"))
    size = lambda c: F.size(c).cast("bigint")
    out = left.select("page_id", "url", F.array_join(F.transform("left", lambda b: b.text), "\n").alias("text"), (size("blocks") - size("tree")).alias("n_tree"), (size("tree") - size("left")).alias("n_rules"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_tree", "n_rules")
