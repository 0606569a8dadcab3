"""Main text of web pages by site style trees.

Method (Yi, Liu and Li, "Eliminating noisy information in web pages for data mining", KDD 2003):
the pages of a host are merged into one tree. A node is the path of tags and class names that
leads to it. What its pages put there (sequences of children, texts) has an entropy: presentation
that varies and texts that few pages share make a branch important, the same few texts on page
after page make it noise. Each page then loses its branches of low importance.

Two kinds of branches are decided by what their tags or names say, whatever the entropy: menus,
footers, sidebars, notices, adverts, forms, scripts, styles and comments go, for texts that differ
from page to page are no less noise there; the element that is marked as the article stays, and
the tree decides on the branches in it. In the article only names that say nothing but noise
count. Where the article's own branch is of low importance (a host with many copies of one
article), markup alone decides. A branch of few pages is important until more pages say
otherwise: its importance is weighed against PRIOR_PAGES pages of importance 1.

The tree is never held anywhere: it is a table of (host, path) with sums, built by two grouped
sums with partial aggregation, so a host with a third of all pages is as cheap as many small ones.
The branches of low importance go to the tasks once, while there are few of them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lensmill.llm import common, url_filter

#: Pages of importance 1 that a branch is given beforehand, and the importance below which it goes.
PRIOR_PAGES = 4
LEAST_IMPORTANCE = 0.4
#: How much a branch's own presentation counts against its contents.
PRESENTATION = 0.1

# Names of HTML elements and of common parts of pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body html caption tbody tfoot thead tr legend summary".split())
NOISE_TAGS = frozenset("aside button canvas dialog fieldset footer form head iframe input label map menu nav object option script select style svg template textarea title audio video noscript".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
NOISE_NAMES = frozenset(
    """ad ads adsense advert advertisement adverts alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright
    disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion
    recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget""".split()
)
PLAIN_NAMES = frozenset("area bar block body bottom box btn button buttons col column container group holder inner item items left link links list module outer panel right row section thread top wrap wrapper".split())
MAIN_NAMES = frozenset("article articlebody content entry maincontent post postbody story".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>?|<[!?/][^>]*>?|<\Z""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Long numbers in names are those of a page, not of the site.
LONG_NUMBER = re.compile(r"\d{3,}")


class Node:
    """An element of a page: its place in the style tree, and what its marking says."""

    __slots__ = ("children", "holds", "inside", "named", "noise", "parent", "path", "rank", "sure", "tag")

    def __init__(self, tag: str, parent: Node | None, path: int, noise: bool, rank: int, named: int = 0):
        self.tag, self.parent, self.path, self.children = tag, parent, path, []
        #: Noise by tag, role or hidden, here or around; with its names, noise is settled by settle().
        self.sure = self.noise = noise or (parent is not None and parent.sure)
        self.rank, self.named, self.holds = rank, named, False
        #: The strongest mark of an article around the node: 3 article, 2 main, 1 a telling name.
        self.inside = max(rank, parent.inside if parent else 0)


def attributes(text: str) -> dict[str, str]:
    """Attributes by name in lower case; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        value = m[2] or ""
        out.setdefault(m[1].lower(), value[1:-1] if value[:1] in ("'", '"') and value[-1] == value[0] and len(value) > 1 else value)
    return out


def words_of(name: str) -> list[str]:
    return [n.lower() for n in NAME.findall(name)]


def noise_named(given: dict[str, str], inside: bool) -> int:
    """How far class and id name noise: 0 not, 1 with a word of some, 2 with all of one or some of each.

    All of a name is words of noise, or with such a word plain ones. Inside an article no less counts.
    """
    said = [w for w in map(words_of, f"{given.get('class', '')} {given.get('id', '')}".split()) if w]
    some = [not NOISE_NAMES.isdisjoint(w) for w in said]
    if any(x and all(y in NOISE_NAMES or y in PLAIN_NAMES for y in w) for x, w in zip(some, said, strict=True)):
        return 2
    return 0 if inside else 2 if some and all(some) else int(any(some))


def marked(tag: str, given: dict[str, str], parent: Node | None) -> tuple[str, bool, int, int]:
    """Signature of an element, whether it is noise by tag, role or hidden, its rank as an article, and noise_named()."""
    names = words_of(f"{given.get('class', '')} {given.get('id', '')}") if given else []
    rank = 3 if tag == "article" else 2 if tag == "main" or given.get("role", "").lower() == "main" else 0
    if given.get("itemprop", "").lower() == "articlebody":
        rank = 3
    noise = tag in NOISE_TAGS or given.get("role", "").lower() in NOISE_ROLES or "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true"
    named = noise_named(given, parent is not None and parent.inside >= 2) if names and tag not in ("html", "body", "main") else 0
    if tag == "header" and not (parent and parent.inside >= 2):
        noise = True
    if not rank and not noise and named < 2 and (not MAIN_NAMES.isdisjoint(names) or "".join(names) in MAIN_NAMES) and tag in ("div", "section", "td"):
        rank = 1
    said = LONG_NUMBER.sub("", f"{given.get('class', '')} {given.get('id', '')}").lower() if given else ""
    return f"{tag}.{'.'.join(sorted(set(said.split())))}", noise, rank, named


def settle(nodes: list[Node], blocks: list[tuple[Node, str]]) -> None:
    """Decides on noise by names.

    One word of a name does not make noise of what is or holds an article. A whole name does,
    unless the page's marked articles are all in such elements.
    """
    if not any(n.named for n in nodes):
        return
    for strict in (True, False):
        for node in nodes:
            node.holds = False
        for node in nodes:
            if node.rank >= 2 and not node.sure:
                while node is not None and not node.holds and not (strict and node.named == 2):
                    node.holds = True
                    node = node.parent
        for node in nodes[1:]:
            own = node.named == 2 or node.named == 1 and not node.rank
            node.noise = node.sure or node.parent.noise or own and not node.holds
        if any(n.inside >= 2 and not n.noise for n, _ in blocks) or not any(n.rank >= 2 for n in nodes):
            return


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The page's elements, and its blocks of text in page order with the elements that hold them."""
    root = Node("#", None, 0, False, 0)
    nodes, blocks, top, held, at = [root], [], root, [], 0
    owner = root

    def flush():
        nonlocal held
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                blocks.append((owner, text))
            held = []

    def add(text: str):
        nonlocal owner
        if not held:
            owner = top
        held.append(text)

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag closes its element and all inside; without one it says nothing
            node = top
            while node is not None and node.tag != tag:
                node = node.parent if node.tag not in ("td", "th") or tag in BLOCKS else None
            if node is not None and node.parent is not None:
                if tag in BLOCKS:
                    flush()
                elif tag in ("td", "th"):
                    add(" ")
                top = node.parent
            elif tag in BLOCKS:
                flush()
            continue
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th"):
            add(" ")
        if tag in CLOSES_P:
            node = top
            while node.parent is not None and node.tag not in ("p", "td", "th", "button", "object", "li") and node.tag not in BLOCKS:
                node = node.parent
            if node.tag == "p":
                top = node.parent
        if tag in IMPLIED:
            same, stop = IMPLIED[tag]
            node = top
            while node.parent is not None and node.tag not in stop:
                if node.tag in same:
                    top = node.parent
                    if tag != "tr" or node.tag == "tr":
                        break
                node = node.parent
        given = attributes(m[3])
        signature, noise, rank, named = marked(tag, given, top)
        path = xxhash.xxh64_intdigest(signature, top.path & 0xFFFFFFFF) ^ top.path >> 32
        node = Node(tag, top, path, noise, rank, named)
        nodes.append(node)
        top.children.append(signature)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end.start() if end else size
        top = node
    flush()
    return nodes, blocks


def branch(node: Node) -> list[int]:
    """The node's path and those of the elements around it."""
    out = []
    while node.parent is not None:
        out.append(signed(node.path))
        node = node.parent
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def repeated(node: Node, noisy: frozenset[int]) -> bool:
    """Whether a branch in the node's marked article is noisy, and the article's own is not."""
    inner, article = False, node
    while article.parent is not None and article.parent.inside == node.inside:
        inner = inner or signed(article.path) in noisy
        article = article.parent
    return inner and signed(article.path) not in noisy


def main_text(page: str, noisy: frozenset[int]) -> str:
    """Text of the page without its noise and the branches in ``noisy``."""
    nodes, blocks = parse(page)
    settle(nodes, blocks)
    clean = [(n, t) for n, t in blocks if not n.noise]
    level = max((n.inside for n, _ in clean), default=0)
    if level >= 2:  # an element is marked as the article
        article = [(n, t) for n, t in clean if n.inside == level]
        left = [(n, t) for n, t in article if not repeated(n, noisy)] if noisy else article
        return "\n".join(t for _, t in left or article)
    left = [(n, t) for n, t in clean if noisy.isdisjoint(branch(n))] if noisy else clean
    if any(n.inside for n, _ in left):  # a telling name counts only where the entropy leaves it
        left = [(n, t) for n, t in left if n.inside]
    return "\n".join(t for _, t in left)


def facts(page: str) -> Iterator[tuple[int, int, int, list[int] | None]]:
    """What a page adds to its host's tree: (path, kind, value, branch); kind 0 children, 1 text."""
    nodes, blocks = parse(page)
    seen = set()
    for node in nodes[1:]:
        if node.tag not in NOISE_TAGS or node.tag in ("nav", "footer", "aside", "form"):
            sequence = [s for i, s in enumerate(node.children) if not i or s != node.children[i - 1]]
            fact = (signed(node.path), 0, signed(xxhash.xxh64_intdigest(" ".join(sequence))))
            if fact not in seen:
                seen.add(fact)
                yield *fact, None
    for node, text in blocks:
        fact = (signed(node.path), 1, signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))))
        if fact not in seen:
            seen.add(fact)
            yield *fact, branch(node)


def style_tree(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The style trees of all hosts: (host, path, pages, importance), one row per branch with text.

    The importance of a text that k of m pages share at a place is 1 - log k / log m, that of a
    place the mean of its texts', and that of a branch the mean over its places by number of
    texts, together with the entropy of its own sequences of children. All are from 0 to 1; a
    branch of a single page has 1.
    """
    common.small_batches(pages.sparkSession)
    schema = pa.schema([("host", pa.string()), ("path", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()), ("branch", pa.list_(pa.int64()))])

    def told(it):
        def rows():
            for batch in it:
                for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for path, kind, value, around in facts(page or ""):
                        yield [host, path, kind, value, around]

        yield from common.batches(rows(), schema, 5000)

    source = pages.select(url_filter.host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    rows = source.mapInArrow(told, "host string, path long, kind int, value long, branch array<long>")
    # Written once: pages are not parsed again for each of its two uses.
    values = rows.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("k"), F.first("branch").alias("branch"))
    k = F.col("k").cast("double")
    places = values.groupBy("host", "path", "kind").agg(
        F.count("*").alias("values"), F.sum("k").alias("pages"), F.sum(F.log(k)).alias("logs"), F.sum(k * F.log(k)).alias("klogs"), F.first("branch").alias("branch")
    )
    places, _ = common.written(places, "places")
    own = places.filter("kind = 0").select("host", "path", "pages", (F.when(F.col("pages") > 1, (F.log("pages") - F.col("klogs") / F.col("pages")) / F.log("pages")).otherwise(1.0)).alias("entropy"))
    texts = places.filter("kind = 1").select("host", "values", "logs", F.explode("branch").alias("path"))
    texts = texts.groupBy("host", "path").agg(F.sum("values").alias("values"), F.sum("logs").alias("logs"))
    content = F.when(F.col("pages") > 1, 1 - F.col("logs") / F.col("values") / F.log("pages")).otherwise(1.0)
    importance = PRESENTATION * F.col("entropy") + (1 - PRESENTATION) * F.greatest(content, F.lit(0.0))
    return texts.join(own, ["host", "path"]).select("host", "path", "pages", importance.alias("importance"))


def extract(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with text_col, the main text, and n_chars, its code points.

    White space inside a block becomes one space; blocks are joined by one line feed, in page
    order. Null and empty pages have the empty text. Pages whose URL is null or has no host form
    one site. Broken markup is read as far as it goes. Repeated pages are pages. New columns
    replace columns of pages that have their names; the others stay. Empty in, empty out.
    """
    pages = pages.drop(*[c for c in (text_col, "n_chars") if c not in (url_col, html_col)])
    spark, kept = pages.sparkSession, pages.columns
    weight = F.col("pages") / (F.col("pages") + PRIOR_PAGES)
    low = style_tree(pages, url_col=url_col, html_col=html_col).filter(1 - (1 - F.col("importance")) * weight < LEAST_IMPORTANCE)
    low, low_path = common.written(low.select("host", "path"), "noisy")
    known, host, of, noisy = None, *common.free_names(pages, "host_", "of_", "noisy_")
    joined = pages.withColumn(host, url_filter.host_of(F.col(url_col)))
    if low.count() <= common.BROADCAST_ROWS:
        by: dict[str, list[int]] = {}
        for r in low.collect():
            by.setdefault(r["host"], []).append(r["path"])
        known = spark.sparkContext.broadcast({k: frozenset(v) for k, v in by.items()})
        common.drop(spark, low_path)
    else:  # a plain join: pages of a hot host can be split over tasks
        lists = low.groupBy(F.col("host").alias(of)).agg(F.collect_list("path").alias(noisy))
        joined = joined.join(lists, F.col(host) == F.col(of), "left").drop(of)

    def extracted(it):
        sets: dict[bytes, frozenset[int]] = {}
        none = frozenset()

        def noise_of(batch):
            if known is not None:
                yield from (known.value.get(h, none) for h in batch.column(host).to_pylist())
                return
            for paths in batch.column(noisy):
                given = paths.values.to_numpy() if paths.is_valid else np.zeros(0, np.int64)
                if (key := given.tobytes()) not in sets:
                    sets.clear() if len(sets) > 100 else None
                    sets[key] = frozenset(given.tolist())
                yield sets[key]

        for batch in it:
            out = [main_text(page.as_py() or "", noise) for page, noise in zip(batch.column(html_col), noise_of(batch), strict=True)]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*kept, text_col, "n_chars"])

    fields = [*pages.schema.fields, StructField(text_col, StringType()), StructField("n_chars", LongType())]
    return joined.mapInArrow(extracted, StructType(fields))
