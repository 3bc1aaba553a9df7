"""HTML extraction by site style trees.

The pages of a host are merged into one tree.  A node of it is the path of
structural elements (tag and class) from the root; it remembers in how many
distinct pages it occurs, the styles (sequences of child elements) it has
there, and the content features (texts) of its blocks.  A branch whose style
and content hardly vary over the host's pages has low importance and goes from
each page.  What a page's own markup names as menu, advert, form and so on goes
without statistics, which a host with a few pages cannot give: by whole class
words, but neither on ``html`` and ``body`` nor on what surrounds the article, and
on no paragraph or heading of it.  The paragraphs of a page's article, where it
marks one, are never judged by how often the host repeats them: a line that
many articles share is part of each, and copies of an article are articles.
"""

from __future__ import annotations

import html as refs
import re

import pyarrow as pa
import zstandard
from xxhash import xxh3_64_intdigest

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import register, stored, table

#: A host's branch is judged from this many distinct pages on.
LEAST_PAGES = 6
#: Weight of content against presentation, and the importance below which a branch goes.
GAMMA, LEAST_IMPORTANCE = 0.9, 0.35

# Fixed values of HTML: elements without end tags, with raw text, and whose text runs on in a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr center".split())
#: Elements that end an open one of the same set.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
SCOPES = frozenset("html body article main section div td th table ul ol dl blockquote aside nav footer header form".split())

#: Elements that are no part of an article.
BOILERPLATE = frozenset("head nav footer header aside form button select dialog menu fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words of class and id attributes that say the same.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar|footer|site-?header|page-?header|masthead|topbar|"
    r"cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|sign-?up|login|share|sharing|social|"
    r"comments?|respond|disqus|replies|reply|related|recommended|widget|pagination|pager|toolbar|skip-?link)(?:$|[\s_-])",
    re.I,
)
MAIN_NAMED = re.compile(r"(?:^|[\s_-])(?:article-?body|post-?content|entry-?content|article-?content|main-?content|story-?body)(?:$|[\s_-])", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|--!>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|$)", re.S)
#: Whether an element is out of the article: not, by the name of its class (unless the article is inside), or surely.
NOT, BY_NAME, SURELY = range(3)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)(?!\s*=\s*[\"']?false)", re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


#: Class words that say that something is there or not, and nothing of the element itself.
ABOUT = re.compile(r"^(?:has|no|with|without|is|not|js|hide|show|hidden|toggle|open|t)[-_]", re.I)
#: Elements of an article's own text.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table tbody thead tr td th ul ol li dl dt dd figure figcaption header".split())

def named(label: str) -> bool:
    return any(NAMED.search(word) and not ABOUT.match(word) for word in label.split())


class Block:
    __slots__ = ("node", "text", "main", "out", "kept")

    def __init__(self, node, main, out, kept):
        self.node, self.text, self.main, self.out, self.kept = node, [], main, out, kept


class Page:
    """A page's blocks in order, and the styles of its nodes."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.styles: dict[str, list[str]] = {}
        # of the open structural elements: tag, path, in main, out of the article by markup, protected
        self.open = [("", "", False, NOT, False)]
        self.block: Block | None = None
        self.has_main = False
        self._read(source)

    def _text(self, data: str) -> None:
        if self.block is None:
            if data.isspace() or not data:
                return
            _, path, main, out, kept = self.open[-1]
            self.block = Block(path, main, out, kept)
            self.blocks.append(self.block)
        self.block.text.append(data)

    def _start(self, tag: str, attributes: str) -> None:
        names = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        label = f"{names.get('class', '')} {names.get('id', '')}".strip()
        while self.open[-1][0] in ENDS.get(tag, ()):
            self.open.pop()
        if tag in ENDS_P and self.open[-1][0] == "p":
            self.open.pop()
        _, path, main, out, kept = self.open[-1]
        role = names.get("role", "").lower()
        is_main = tag in ("article", "main") or role in ("main", "article") or names.get("itemprop") == "articleBody" or bool(label and MAIN_NAMED.search(f" {label} "))
        comment = bool(label and re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", label, re.I))
        if is_main and not comment and out != SURELY:
            main, out = True, NOT  # what surrounds the article may be called anything
            self.has_main = True
        elif out != SURELY:
            if tag in BOILERPLATE and not (tag == "header" and main) or role in ROLES or names.get("aria-hidden") == "true" or HIDDEN.search(attributes):
                out = SURELY
            elif label and tag not in ("html", "body") and not (main and tag in TEXTUAL) and named(label):
                out = SURELY if main or comment else BY_NAME
        kept = main and (is_main or tag in TEXTUAL) and (kept or is_main)
        name = tag if not label else f"{tag}.{label}"
        style = self.styles.setdefault(path, [])
        if not style or style[-1] != name:
            style.append(name)
        self.open.append((tag, f"{path}/{name}", main, out, kept))
        self.block = None

    def _end(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
            if self.open[k][0] in SCOPES and tag not in SCOPES:
                break  # an end tag without start does not close what surrounds it
        self.block = None

    def _read(self, source: str) -> None:
        at = 0
        while True:
            m = TOKEN.search(source, at)
            if m is None:
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m[2] is None:  # a comment or declaration
                continue
            tag = m[2].lower()
            if m[1]:
                if tag not in INLINE and tag not in VOID:
                    self._end(tag)
            elif tag == "br":
                if self.block is not None:
                    self.block.text.append(" ")
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(source, at)
                at = len(source) if end is None else end.end()
            elif tag in VOID:
                if tag == "hr":
                    self.block = None
            elif tag not in INLINE:
                self._start(tag, m[3])
        if at < len(source):
            self._text(source[at:])

    def text(self, i: int) -> str:
        return " ".join(refs.unescape("".join(self.blocks[i].text)).split())

    def judged(self) -> list[int]:
        """Blocks that the host's tree may remove: what markup neither removes nor protects."""
        return [i for i, b in enumerate(self.blocks) if not b.out and not b.kept and (b.main or not self.has_main)]

    def article(self, without: set[int]) -> str:
        chosen = [(i, t) for i, b in enumerate(self.blocks) if not b.out and (b.main or not self.has_main) and (t := self.text(i))]
        left = [x for x in chosen if x[0] not in without]
        return " ".join(t for _, t in left or chosen)


def _key(*parts: str) -> int:
    return xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


def _features(batches):
    """For each distinct page (by host and html): a row for each judged block, and one for each node's style."""
    for batch in batches:
        out = []
        for host, page, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            p = Page(source)
            parents = set()
            for i in p.judged():
                if t := p.text(i):
                    node = p.blocks[i].node
                    parent = node.rpartition("/")[0]  # a block's branch is judged by its parent's styles
                    parents.add(parent)
                    out.append((host, page, _key(node), _key("text", t), i))
                    out.append((host, page, _key(node), _key(parent), -2 - i))
            for node in parents & p.styles.keys():
                out.append((host, page, _key(node), _key("style", *p.styles[node]), -1))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["host", "page", "node", "feature", "block"])


def _extract(batches):
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        text = []
        for packed, without in zip(batch.column("packed"), batch.column("without").to_pylist(), strict=True):
            text.append(Page(open_.decompress(packed.as_py()).decode()).article(set(without or ())))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _pack(batches):
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([press.compress(x.encode()) for x in batch.column("html").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("page_id", "url", "page")), packed], names=["page_id", "url", "page", "packed"])


def low_branches(features: DataFrame) -> DataFrame:
    """page, without: the blocks that the host's tree finds unimportant.

    Content importance of a block is 1 - log_m(c), for a text in c of the m
    distinct pages of the host that have the node; presentation importance of a
    node is the entropy to base m of its styles.
    """
    blocks = features.where("block >= 0").select("host", "page", "node", "feature", "block")
    once = blocks.select("host", "node", "feature", "page").distinct()
    c = once.groupBy("host", "node", "feature").agg(F.count("*").alias("c"))
    m = once.select("host", "node", "page").distinct().groupBy("host", "node").agg(F.count("*").alias("m")).where(F.col("m") >= LEAST_PAGES)
    styles = features.where("block = -1").groupBy("host", "node", "feature").agg(F.count("*").alias("c"))
    n = F.sum("c")
    looks = styles.groupBy("host", "node").agg(n.alias("n"), F.when(n > 1, (F.log(n) - F.sum(F.col("c") * F.log("c")) / n) / F.log(n)).otherwise(1.0).alias("look"))
    parents = features.where("block < -1").select("host", "node", F.col("feature").alias("parent")).distinct()
    branch = m.join(parents, ["host", "node"]).join(looks.select("host", F.col("node").alias("parent"), "look"), ["host", "parent"]).groupBy("host", "node").agg(F.max("m").alias("m"), F.max("look").alias("look"))
    importance = (1 - GAMMA) * F.col("look") + GAMMA * (1 - F.log("c") / F.log("m"))
    low = c.join(branch, ["host", "node"]).where(importance < LEAST_IMPORTANCE).select("host", "node", "feature")
    return blocks.join(low, ["host", "node", "feature"], "left_semi").groupBy("page").agg(F.collect_set("block").alias("without"))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null html is empty; a page without article text gives an empty text.  Pages
    with a null or odd url belong to one host without name.  Copies of a page
    on a host count as one page in the host's tree and each get their text.  If
    the tree would remove all of a page's article, it removes nothing there.
    """
    W.small_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", F.xxhash64(host).alias("host"), F.xxhash64(host, html).alias("page"), html.alias("html"))
    found = rows.select("host", "page", "html").mapInArrow(_features, "host long, page long, node long, feature long, block long")
    features = stored(found.distinct(), "style-tree")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    packed = rows.select("page_id", "url", "page", "html").mapInArrow(_pack, f"page_id {kinds['page_id']}, url {kinds['url']}, page long, packed binary")
    out = packed.join(low_branches(features), "page", "left").select("page_id", "url", "packed", "without")
    return out.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


@register("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
