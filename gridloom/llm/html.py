"""Operator 10: main text of HTML pages by a site style tree.

Pages are read into their elements twice. The first pass merges the pages of a host: every element, named by the tags and
classes on the way to it, gets the counts of its presentation styles (the sequence of its children) and of the blocks of
text below it. Entropies of these counts, and what tags and names declare, give its importance. The second pass removes
the branches of low importance from each page. Nothing else removes one: on every page the tree decides, with an article
or without, and names are one of its features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import spool
from gridloom.llm.urls import url_host

#: Weight of an element's own presentation against what lies below it: DECAY ** (number of its styles).
DECAY = 0.9
#: Branches go that hold nothing of this importance. A site of few pages tells little: SMOOTH pages are added to the scale.
LOW, SMOOTH = 0.35, 4
#: Importance that an element loses, with all below it, by what it declares (a name in passing; inside an article, to be
#: what a site repeats; to be no article), how much of the second is taken back by many pages, whose entropies then say
#: whether it is repeated: so much * m / (m + SMOOTH) for m pages. What
#: lists of links lose outside articles, what all else outside loses where articles hold most of every page of the site,
#: and what article and main elements add to all that is in them.
DECLARED, BACK, LINKED, OUTSIDE, RAISED = (0.0, 0.3, 1.0, 1.0), 0.4, 0.7, 0.7, 0.15
#: Elements below this depth count as children of the last one above it, told apart by tag, class and declaration.
DEPTH = 32
#: Counts that a task gathers before it passes them on.
GATHERED = 200_000

_RAW = "script|style|noscript|template|iframe|svg|title|textarea"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[^a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Tags and words of class names, ids and roles that declare a branch to be no part of the article, and words that say
#: no more beside them.
NO_ARTICLE_TAGS = frozenset("head nav footer aside form menu button select option label fieldset dialog".split())
NO_ARTICLE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner breadcrumb breadcrumbs nav navbar navigation menu"
    " sidebar aside footer complementary contentinfo cookie cookies consent gdpr notice notices alert disclaimer comment comments disqus respond reply replies"
    " related recommended share sharing social newsletter subscribe signup login search pagination pager popup modal overlay toolbar widget masthead".split()
)
#: Names of what a site repeats on its pages. Inside an article what bears them may also be part of the story, so there
#: they speak against it, but the tree can overrule them; adverts, forms and comments differ by page, so it cannot there.
REPEATED_NAMES = frozenset("alert banner disclaimer masthead notice notices share sharing social toolbar widget".split())
FILLERS = frozenset("area bar block box button buttons container content form inner left links list main outer panel posts right section site slot thread top bottom unit wrap wrapper".split())
#: What holds the text itself; inside an article, its names declare nothing but a name in passing, and its ids nothing.
PASSAGES = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre figcaption td th".split())
WHOLE = frozenset(["html", "body", "main", "article"])
HEADERS = frozenset(["header", "banner", "masthead"])
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}


class Element:
    """An element of a page; key names it in its site's tree, path holds the keys from the root to it, declared (0 to 3) is
    what it or one around it declares."""

    __slots__ = ("tag", "key", "path", "declared", "hidden", "article", "children")

    def __init__(self, tag: str, key: int, path: tuple[int, ...], declared: int, hidden: bool, article: bool):
        self.tag, self.key, self.path, self.declared, self.hidden, self.article, self.children = tag, key, path, declared, hidden, article, []


def _attributes(text: str) -> tuple[str, str, str, bool]:
    """class, id and role in lower case, and whether the element is hidden."""
    found, hidden = {"class": "", "id": "", "role": ""}, False
    for what, a, b, c in _NAMES.findall(text):
        what, value = what.lower(), (a or b or c).lower()
        if what == "hidden" or what == "aria-hidden" and value == "true":
            hidden = True
        elif what != "aria-hidden":
            found[what] = value
    return found["class"], found["id"], found["role"], hidden


def _declared(tag: str, classes: str, name: str, role: str, inside: bool) -> int:
    """3 for an element whose tag, or a whole class, role or id of it, says that it is no article; 2 if inside an article
    these only say that it is repeated; 1 if a word of them says either. Inside an article ids count only if they say so
    wholly, and passages are not declared more than in passing."""
    if tag in NO_ARTICLE_TAGS or (not inside and tag in HEADERS):
        return 3
    if tag in WHOLE:
        return 0
    names = NO_ARTICLE_NAMES if inside else NO_ARTICLE_NAMES | HEADERS
    most = 0
    for token, is_id in [*((x, False) for x in (*classes.split(), role)), (name, True)]:
        words = {w for w in _WORDS.split(token) if w}
        if not names.isdisjoint(words):
            if words <= names | FILLERS:
                whole = 2 if inside and words <= REPEATED_NAMES | FILLERS else 3
                most = max(most, 1 if inside and tag in PASSAGES else whole) if not (is_id and inside and tag in PASSAGES) else most
            elif not (is_id and inside):
                most = max(most, 1)
    return most


def parse(html: str) -> tuple[list[tuple[Element, str, bool]], list[Element]]:
    """Blocks of text in page order, each with its innermost element and whether all of it is links, and all elements."""
    root = Element("", 0, (0,), 0, False, False)
    stack, every, blocks, text = [root], [root], [], []
    at, link, linked = 0, False, True

    def flush() -> None:
        nonlocal linked
        if text:
            if block := " ".join(unescape("".join(text)).split()):
                blocks.append((stack[-1], block, linked))
            text.clear()
        linked = True

    for token in _TOKEN.finditer(html):
        start = token.start()
        if start > at:
            text.append(piece := html[at:start])
            linked = linked and (link or piece.isspace())
        at = token.end()
        tag = token[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            link = not token[2]
        if tag in VOID:
            if tag in BLOCK:
                flush()
            continue
        if token[2]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth or tag == "p":  # any other end tag without its start is ignored
                flush()
            if depth:
                del stack[depth:]
            continue
        attributes = token[4]
        if tag not in BLOCK and not ("class" in attributes or "id" in attributes or "role" in attributes or tag in NO_ARTICLE_TAGS):
            continue
        around, inside = stack[-1], stack[-1].article
        classes, name, role, hidden = _attributes(attributes) if attributes.strip(" /") else ("", "", "", False)
        own = _declared(tag, classes, name, role, inside)
        if tag not in BLOCK and not hidden and own < 2:
            continue
        flush()
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in _CLOSES:
            same, limits = _CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in same:
                    del stack[i:]
                    break
                if stack[i].tag in limits:
                    break
        parent = stack[-1]
        above = parent.path[: DEPTH - 1]
        kind = " ".join(sorted(_DIGITS.sub("0", classes).split()))
        key = xxhash.xxh64_intdigest(f"{above[-1]} {tag} {max(own, around.declared)} {kind}".encode()) >> 1
        path = (*above, key)
        parent.children.append(key)
        element = Element(tag, key, path, max(own, around.declared), around.hidden or hidden or tag == "head", inside or tag in ("article", "main"))
        stack.append(element)
        every.append(element)
    if at < len(html):
        text.append(html[at:])
        linked = linked and link
    flush()
    return blocks, every


def main_text(html: str, low: set[int] | frozenset[int] = frozenset()) -> str:
    """The blocks of the main text, joined by line feeds: those in no branch of `low`, the elements of low importance.

    If a site repeats all of a page, the tree cannot tell the story from its frame: of such a page what declares itself
    no article goes, and the rest stays.
    """
    blocks = [x for x in parse(html)[0] if not x[0].hidden]
    kept = [x for x in blocks if low.isdisjoint(x[0].path)] or [x for x in blocks if x[0].declared < 2]
    return "\n".join(t for _, t, _ in kept)


def in_articles(blocks: list[tuple[Element, str, bool]]) -> bool:
    """Whether article and main elements hold half or more of what neither is declared otherwise nor a list of links."""
    sizes = [(len(t), e.article) for e, t, linked in blocks if not e.hidden and e.declared < 2 and (e.article or not (linked and e.tag == "li"))]
    return any(a for _, a in sizes) and 2 * sum(n for n, a in sizes if a) >= sum(n for n, _ in sizes)


def _features(html: str) -> set[tuple[int, str, int]]:
    """(element, kind, value) once per page: kind s for a style, c for a block of the element's own, l if some of these are
    no mere links, a for an ancestor and p for the parent, d for 2 * declared + whether it is in an article, h (of the
    root) for a page that articles hold most of."""
    blocks, every = parse(html)
    found = {(e.key, "s", xxhash.xxh64_intdigest(repr(e.children).encode()) >> 1) for e in every if e.children}
    for e, t, linked in blocks:
        if not e.hidden:
            found.add((e.key, "c", xxhash.xxh64_intdigest(t.encode()) >> 1))
            if not linked or e.tag != "li":
                found.add((e.key, "l", 0))
    if in_articles(blocks):
        found.add((0, "h", 1))
    for e in {e.key: e for e in every}.values():
        found.add((e.key, "d", 2 * e.declared + e.article))
        found.update((e.key, "a", key) for key in e.path)
        found.add((e.key, "p", e.path[-2] if len(e.path) > 1 else -1))
    return found


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, element, parent, importance, highest) of every element of the hosts' merged pages, from (host, html).

    With m pages, and SMOOTH more on the scale, a block that an element has on n of them has entropy
    log(n) / log(m + SMOOTH): 0 if it is unique, nearly 1 if all pages share it. What lies below an element weighs 1 less
    the mean over the blocks of all elements there; its own presentation weighs the entropy of its styles on that scale,
    and DECAY ** styles of the two is presentation. Declarations, lists of links and articles then lower and raise it.
    highest: the largest importance of the element and all below it.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            columns = list(zip(*((*k, n) for k, n in counts.items()))) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "element", "kind", "feature", "n"])

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts.update((host, *x) for x in _features(html.as_py() or ""))
                if len(counts) > GATHERED:
                    yield out()
                    counts.clear()
        yield out()

    rows = pages.select("host", "html").mapInArrow(gather, "host string, element long, kind string, feature long, n long")
    counts = rows.groupBy("host", "element", "kind", "feature").agg(F.sum("n").alias("n"))
    style, content, declared = (F.col("kind") == k for k in "scd")
    n = F.col("n").cast("double")
    own_sums = counts.groupBy("host", "element").agg(
        F.sum(F.when(style, n)).alias("seen"),
        F.sum(F.when(style, n * F.log(n))).alias("seen_log"),
        F.count(F.when(style, 1)).alias("styles"),
        F.sum(F.when(content, n)).alias("blocks"),
        F.sum(F.when(content, n * F.log(n))).alias("blocks_log"),
        F.count(F.when(F.col("kind") == "l", 1)).alias("prose"),
        F.max(F.when(declared, F.col("feature"))).alias("flags"),
        F.max(F.when(F.col("kind") == "p", F.col("feature"))).alias("parent"),
        F.sum(F.when(declared, n)).alias("pages"),
        F.coalesce(F.max(F.when(F.col("kind") == "h", n)), F.lit(0.0)).alias("articles"),
        F.collect_set(F.when(F.col("kind") == "a", F.col("feature"))).alias("above"),
    )
    own_sums, _ = spool(own_sums, "elements")
    number = own_sums.where("element = 0").select("host", F.col("pages").alias("m"), "articles")  # every page has the root
    own_sums = own_sums.drop("pages", "articles")
    above = own_sums.select("host", "element", F.explode("above").alias("ancestor"))
    lower = own_sums.where("blocks > 0").select("host", F.explode("above").alias("element"), F.col("blocks").alias("all_blocks"), F.col("blocks_log").alias("all_log"))
    lower = lower.groupBy("host", "element").agg(F.sum("all_blocks").alias("all_blocks"), F.sum("all_log").alias("all_log"))
    sums = own_sums.drop("blocks_log", "above").join(lower, ["host", "element"], "left").join(number, "host")
    scale = F.log(F.col("m") + SMOOTH)
    own = F.coalesce((F.log("seen") - F.col("seen_log") / F.col("seen")) / scale, F.lit(0.0))
    below = F.coalesce(1 - F.col("all_log") / F.col("all_blocks") / scale, F.lit(0.0))  # 0: nothing is below
    part = F.when(F.col("styles") == 0, F.lit(0.0)).otherwise(F.pow(F.lit(DECAY), F.col("styles")))
    in_article = F.col("flags") % 2 == 1
    loss = F.element_at(F.array(*[F.lit(x) for x in DECLARED]), F.floor(F.col("flags") / 2).cast("int") + 1)
    loss = loss - F.when(F.floor(F.col("flags") / 2) == 2, BACK * F.col("m") / (F.col("m") + SMOOTH)).otherwise(0.0)
    loss = loss + F.when(in_article, 0.0).otherwise(OUTSIDE * F.col("articles") / F.col("m"))
    loss = loss + F.when(~in_article & (F.col("blocks") > 0) & (F.col("prose") == 0), F.lit(LINKED)).otherwise(F.lit(0.0))
    rated = sums.select("host", "element", "parent", ((1 - part) * below + part * own - loss + F.when(in_article, RAISED).otherwise(0.0)).alias("importance"))
    best = above.join(rated.select("host", "element", "importance"), ["host", "element"])
    best = best.groupBy("host", F.col("ancestor").alias("element")).agg(F.max("importance").alias("highest"))
    return rated.join(best, ["host", "element"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every row; text is empty where the page has none, or is null.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by line feeds.
    Pages without a host share one tree. Only the topmost elements of low importance are passed on to the second pass, a
    number for each such branch of a site's template; the planner broadcasts that table if its measured size allows, and
    joins by host otherwise, where adaptive execution splits a host of many pages. Repeated rows stay repeated; an empty
    table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), url_host(F.col(url_col)).alias("host"))
    low = style_tree(rows.select("host", "html")).where(F.col("highest") < LOW)
    inner = low.select("host", F.col("element").alias("parent"))  # goes with its parent
    low, _ = spool(low.join(inner, ["host", "parent"], "left_anti").groupBy("host").agg(F.collect_list("element").alias("low")), "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str | None, frozenset[int]] = {}
        for batch in batches:
            texts = []
            for html, host, low in zip(*(batch.column(i) for i in range(2, 5))):
                host = host.as_py()
                if host not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[host] = frozenset(low.as_py() or ())
                texts.append(main_text(html.as_py() or "", sets[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.join(low, "host", "left").select("id", "url", "html", "host", "low").mapInArrow(run, f"id {kind['id']}, url string, text string")
