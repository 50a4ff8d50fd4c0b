"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its structural start tags and its text blocks, each told apart by the chain of
structural elements around it. Tokens of one host with the same occurrence vector over the host's pages form
an equivalence class. A class is valid if it occurs on enough pages and is large enough; as a token names the elements
around it, the tags of valid classes nest into the host's template. What remains between them are its slots:

* The main slot is the innermost element that holds three quarters of the host's text; where elements of a valid class are that near to each
  other (half of the text and more), a tag breaks the tie: an article or main element is taken before what is around or in it. Only the slot makes the text, with what stands
  right in the elements around it if it is no article.
* Texts of a valid class that keep their place (after the same sibling tag, or first in the same element) are furniture, too.

Words that name furniture decide where there is no template, on pages without their host's main slot. In an article or in the slot only blocks go that the contract names, adverts,
notices and comments, by words that mean nothing else; whatever else is there goes only if other pages of the host repeat it.

Occurrence vectors are never collected: a vector is represented by its support and by two sums of
31-bit hashes of (page, count), which partial aggregation adds up before any shuffle. So a host
with a third of all pages is as cheap as any other. Reading a page takes time in proportion to its length, whatever is in it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, store, table

#: A class holds so many tokens at least, and is on this share of the host's pages (two at least).
LEAST_TOKENS, LEAST_SHARE = 3, 0.75
#: So often must the texts of a class be seen, all of them together, on whatever pages; a text in an article so often by itself. Few pages
#: say as much by many texts as many pages by one, and two versions of an article are no template.
LEAST_SIGHTINGS = 8

# A tag ends at its >, before the next < or with the page, so that no start is read on from twice.
_ATTRIBUTES = r"((?:\"[^\"]*\"|'[^']*'|[^'\"<>]+|['\"])*+)"
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|svg|title)\b{_ATTRIBUTES}(?:>.*?(?:</\1\s*>|\Z)|(?=<)|\Z)"
    rf"|<(/?)([A-Za-z][\w:-]*){_ATTRIBUTES}(?:>|(?=<)|\Z)|<[!?][^<>]*(?:>|(?=<)|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PIECES = re.compile(r"[a-z]+")

#: Elements whose text runs on in the line; every other element ends a block (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold blocks and so make up the path of a token.
STRUCTURE = frozenset("html head body main article section div nav header footer aside form table ul ol dl menu dialog fieldset figure details blockquote".split())
#: Elements that are never main text.
FURNITURE = frozenset("head nav footer aside form menu dialog button select option label input object embed canvas audio video map".split())
#: Elements without content, and blocks that end where the next one begins.
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that mark an element as page furniture if one is a whole class, id, role or itemprop of it.
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu masthead topbar footer sidebar aside rail ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login form search share sharing social related recommended "
    "breadcrumb breadcrumbs contentinfo complementary pagination pager comment comments reply replies respond discussion disqus widget toolbar copyright".split()
)
#: Words that mark a block as an advert, a notice or a comment wherever it is, alone or before one of BLOCK_WORDS (ad-slot, comment-list).
CONTRACT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsored cookie cookies consent gdpr notice comment comments replies respond disqus".split())
BLOCK_WORDS = frozenset("slot unit container wrapper wrap banner box block space label placement zone list section thread form area item notice consent bar popup message overlay modal".split())
MAIN_WORDS = frozenset("articlebody main".split())
#: A header of an article is its title; any other is the page's.
HEADER_WORDS = frozenset(("header",))


_DIGITS, _SIGNS = re.compile(r"\d+"), re.compile(r"[-_]+")
#: Elements whose token is their name: what class and id they have differs from page to page.
PLAIN = frozenset("html head body main".split())


class Event:
    """A structural start tag, or a block of text (white space made one, references decoded).

    ``token`` names it with the elements around it, ``parent`` the innermost of those. ``furniture`` tells that an element around
    it (below the main slot, if it is in one) is boilerplate by name, ``main`` that it is in an article or main element,
    ``inside`` that it is in the main slot. ``serial`` numbers the elements of a page; a text has that of its element. Of a tag ``held`` counts the characters of text that are in the element and no furniture.
    """

    __slots__ = ("tag", "parent", "token", "text", "furniture", "main", "inside", "core", "depth", "held", "serial")

    def __init__(self, tag: bool, parent: int, token: int, text: str, furniture: bool, main: bool, inside: bool, core: bool = False, depth: int = 0, serial: int = 0) -> None:
        self.tag, self.parent, self.token, self.text, self.furniture, self.main, self.inside, self.core, self.depth, self.held, self.serial = tag, parent, token, text, furniture, main, inside, core, depth, 0, serial


def events_of(page: str, slot: int = 0) -> tuple[list[Event], set[int]]:
    """Events of a page in order, and the serial numbers of the elements around the main slot ``slot`` where it is first met.

    Unclosed and unmatched tags are taken as browsers do in the common cases: an end tag closes down to its start
    tag if there is one, inline tags never nest.

    A word in class, id, role or itemprop marks an element only as a whole token (or as a compound like ``ad-slot``; of an inline element also as its head, as in
    ``share-count``), never an html, body, main or article element, or what is in code, and never an element around an article that no such word names. In an
    article or the slot only CONTRACT_WORDS do, and neither inline elements, headings nor ids.
    """
    around: dict[bool, set[int]] = {False: set(), True: set()}  # elements by word around articles that no word names, or one does
    found = _events(page, slot, frozenset(), around)
    exempt = (around[False] or around[True]) - {-1}
    return _events(page, slot, frozenset(exempt), {False: set(), True: set()}) if exempt else found


def _events(page: str, slot: int, exempt: frozenset[int], around: dict[bool, set[int]]) -> tuple[list[Event], set[int]]:
    """``events_of``, where words don't mark the elements at the offsets ``exempt``; adds to ``around`` the
    offsets of the marked elements around articles (-1 if there is an article), by whether a word names the article."""
    out: list[Event] = []
    code = False
    root = Event(True, 0, 0, "", False, False, False)
    stack: list[tuple[str, Event]] = [("", root)]
    open_: Counter[str] = Counter()
    marked: list[tuple[int, int]] = []  # offset and depth of the open elements that a word marks
    told = {False: 0, True: 0}  # how many of those are in ``around``
    parts: list[str] = []
    mute: tuple[str, bool] | None = None  # an element whose text goes; does it last until its end tag?
    outer: set[int] = set()
    at = total = 0

    def flush() -> None:
        nonlocal total
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            e = stack[-1][1]
            out.append(Event(False, e.token, 0, text, e.furniture, e.main, e.inside, serial=e.serial))
            total += 0 if e.furniture else len(text)

    def close() -> str:
        name, e = stack.pop()
        e.held += total
        open_[name] -= 1
        while marked and marked[-1][1] >= len(stack):
            marked.pop()
        return name

    for m in _MARKUP.finditer(page):
        if m.start() > at and not mute:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m[4] or "").lower()
        if not name:
            if m[1] and m[1].lower() not in ("script", "style", "noscript", "template"):
                flush()
            continue
        inner = stack[-1][1]
        attributes = {k.lower(): (x or y or z).lower() for k, x, y, z in _ATTRIBUTE.findall(m[5])} if len(m[5]) > 4 and not m[3] else {}
        words = {w for v in attributes.values() for w in _PIECES.findall(v)}
        if name in ("pre", "code"):
            code = not m[3]
        main = inner.main or inner.inside
        tokens = {w for k, v in attributes.items() if k != "id" or not (name in HEADINGS or main) for w in v.split()}
        split = {w: _SIGNS.split(w, 1) for w in tokens}
        compound = {head for head, *rest in split.values() if rest and head in CONTRACT_WORDS and rest[0] in BLOCK_WORDS}
        if main:
            named = name not in INLINE and name not in HEADINGS and bool(compound or tokens & CONTRACT_WORDS)
        elif name in INLINE:
            named = bool((tokens | {head for head, *_ in split.values()}) & FURNITURE_WORDS)
        else:
            named = bool(compound or tokens & FURNITURE_WORDS)
        own = name not in PLAIN and name != "article"
        by_word = named and not code and own and m.start() not in exempt
        empty = m[5].endswith("/") or name in EMPTY
        if name in INLINE and name not in FURNITURE:
            if mute and m[3] and mute[0] == name:
                mute = None
            elif by_word and not mute and not empty:
                mute = (name, False)
            continue
        if name == "br":
            if not mute:
                parts.append(" ")
            continue
        flush()
        if mute and (not mute[1] or m[3] and mute[0] == name):
            mute = None
            if m[3]:
                continue
        if m[3]:
            if open_[name] > 0:
                while close() != name:
                    pass
            continue
        core = name in ("article", "main") or bool(words & MAIN_WORDS)
        head = bool(tokens & HEADER_WORDS) and own and m.start() not in exempt and not main
        bad = name in FURNITURE or by_word or head or (not main and name == "header")
        if name in STRUCTURE or (bad and name not in FURNITURE and name not in PARAGRAPHS):
            said = "" if name in PLAIN else " ".join(sorted(tokens & FURNITURE_WORDS)) if name == "article" else _DIGITS.sub("0", "|".join(attributes.get(k, "") for k in ("class", "id")))
            token = xxhash.xxh64_intdigest(f"{name}|{said}", inner.token) >> 1
            inside = bool(slot) and token == slot
            if inside and not outer:
                outer.update(e.serial for _, e in stack)
            e = Event(True, inner.token, token, "", not inside and (inner.furniture or bad), inner.main or core, inner.inside or inside, core, len(stack), m.start() + 1)
            out.append(e)
            if core:
                around[named].add(-1)
                around[named].update(x for x, _ in marked[told[named] :])
                told[named] = len(marked)
            if not empty:
                e.held = -total
                if (by_word or head) and name not in FURNITURE:
                    marked.append((m.start(), len(stack)))
                stack.append((name, e))
                open_[name] += 1
                told = {k: min(n, len(marked)) for k, n in told.items()} if len(marked) < max(told.values()) else told
        elif bad and not empty and not mute:
            mute = (name, name in FURNITURE)
    if at < len(page) and not mute:
        parts.append(page[at:])
    flush()
    while len(stack) > 1:
        close()
    return out, outer


def text_token(e: Event) -> int:
    return xxhash.xxh64_intdigest(e.text, e.parent ^ 1) >> 1


def main_text(page: str, texts: frozenset[int] = frozenset(), slot: int = 0, article: bool = True) -> str:
    """The text of a page, block by block, joined by a space. ``texts`` holds the tokens of the host's template texts, ``slot`` the
    token of its main slot (0: none), ``article`` whether that is one; a page without it is read by elements and words."""
    events, outer = events_of(page, slot)
    blocks = [e for e in events if not e.tag and not e.furniture]
    slots = [e for e in blocks if e.inside]
    if slots:
        chosen = slots if article else [e for e in blocks if e.inside or e.serial in outer]
    else:
        main = [e for e in blocks if e.main]
        # (A page with an article that says nothing has no text.)
        chosen = main if main or any(e.tag and e.main and not e.furniture for e in events) else blocks
    # A text that is all template is a page that its host repeats: then it is the text.
    kept = [e for e in chosen if text_token(e) not in texts] if texts else chosen
    return " ".join(e.text for e in kept or chosen)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without port and user; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


OCCURRENCES = "host string, token long, before long, tag boolean, main boolean, core boolean, usable boolean, depth int, held long, half1 long, half2 long"
_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}
_OCCURRENCES = pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in OCCURRENCES.split(", "))])


def occurrences(pages: DataFrame) -> DataFrame:
    """One row for each token of each page: the token, the tag before it among its siblings (or around it), whether it is a tag, in an
    article, an article, no furniture (and so usable as a slot), how deep it is, how much text it holds, and the page's share of its
    occurrence vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            out: list[tuple] = []
            for host, url, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not page:
                    continue
                rows: dict[int, list] = {}
                last: dict[int, int] = {}
                for e in events_of(page)[0]:
                    token = e.token if e.tag else text_token(e)
                    row = rows.get(token)
                    if row is None:
                        row = rows[token] = [0, last.get(e.parent, 0), e.tag, False, False, False, e.depth, 0]
                    row[0] += 1
                    row[3] |= e.main
                    row[4] |= e.core
                    row[5] |= e.tag and not e.furniture
                    row[7] += e.held
                    if e.tag:
                        last[e.parent] = last[token] = token
                seed = xxhash.xxh64_intdigest(f"{url}\x1f{page}")
                for token, (n, *rest) in rows.items():
                    h = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), seed)
                    out.append((host, token, *rest, h & 0x7FFFFFFF, h >> 33))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OCCURRENCES.types, strict=True)], schema=_OCCURRENCES)

    return pages.mapInArrow(run, OCCURRENCES)


def deduce_templates(pages: DataFrame, least_tokens: int = LEAST_TOKENS, least_share: float = LEAST_SHARE, least_sightings: int = LEAST_SIGHTINGS) -> DataFrame:
    """``host, texts, slot, article`` of every host with a template, from ``pages(host, url, html)``: tokens of its template texts (none: empty), the token of its main slot
    (none: null) and whether that is an article. Null and empty pages say nothing, null hosts are one host; an empty table gives no rows.

    Two shuffles, of one row for each distinct token of a host and then of one for each token that
    is on two pages; a template is as large as the host's page furniture, not as its pages.
    """
    tokens = occurrences(pages).groupBy("host", "token").agg(
        F.count("*").alias("support"), F.sum("half1").alias("half1"), F.sum("half2").alias("half2"), F.max("tag").alias("tag"), F.max("main").alias("main"), F.min("before").alias("low"), F.max("before").alias("high"),
        F.max("core").alias("core"), F.min("usable").alias("usable"), F.max("depth").alias("depth"), F.sum("held").alias("held"),
    )
    frequent = tokens.where("support >= 2").withColumn("ordered", F.col("low") == F.col("high"))
    vector = ["host", "support", "half1", "half2"]
    element = F.when(F.col("tag") & F.col("usable") & (F.col("held") > 0), F.struct("held", "core", (-F.col("depth")).alias("up"), "token"))
    telling = ~F.col("tag") & F.col("ordered") & (~F.col("main") | (F.col("support") >= least_sightings))
    classes = frequent.groupBy(*vector).agg(
        F.count("*").alias("size"), F.count_if("tag").alias("tags"), F.collect_list(F.when(telling, F.col("token"))).alias("texts"),
        F.max(element["held"]).alias("most"), F.collect_list(element).alias("elements"),
    ).where((F.col("size") >= least_tokens) & (F.col("tags") >= 2))
    # Elements that hold less than half of what the class's largest holds can't be the slot; what is left is nested, or two at most.
    classes = classes.withColumn("elements", F.filter("elements", lambda e: e["held"] * 2 >= F.col("most")))
    found = F.collect_list(F.when((F.size("texts") > 0) & (F.col("support") * F.size("texts") >= least_sightings), F.struct("support", "texts")))
    # The most frequent class of a host is on all of its pages, as its html element is.
    hosts = classes.groupBy("host").agg(F.max("support").alias("pages"), F.max("most").alias("most"), found.alias("found"), F.flatten(F.collect_list("elements")).alias("elements"))
    usual = F.filter("found", lambda c: c["support"] >= F.col("pages") * least_share)
    slot = F.array_min(F.transform(F.filter("elements", lambda e: (e["core"] & (e["held"] * 2 >= F.col("most"))) | (e["held"] * 4 >= F.col("most") * 3)), lambda e: F.struct((~e["core"]).alias("plain"), e["held"], e["up"], e["token"])))
    hosts = hosts.select("host", F.array_sort(F.flatten(F.transform(usual, lambda c: c["texts"]))).alias("texts"), slot.alias("slot"))
    return hosts.select("host", "texts", F.col("slot.token").alias("slot"), F.coalesce(~F.col("slot.plain"), F.lit(False)).alias("article")).where((F.size("texts") > 0) | F.col("slot").isNotNull())


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page, from its whole html.

    Null and empty pages have an empty text; null urls share the nameless host; repeated rows are
    kept. Only the named columns are read. Very long pages and pages of broken markup take time in proportion to their length. Templates
    are joined by host: broadcast if Spark's size estimate of the stored templates allows, else by a shuffle whose skewed hosts AQE splits.
    """
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(url).alias("url"), F.col(page).alias("html"), F.col(page_id).cast("long").alias("page_id"))
    templates = store(deduce_templates(rows), "page-templates")
    joined = rows.join(templates, "host", "left").select("page_id", "url", "html", "host", "texts", "slot", "article")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in slices(batches, 2):
            texts = []
            for i, (host, source) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                template = known.get(host)
                if template is None:
                    if len(known) > 4096:
                        known.clear()
                    repeated, slot, article = (batch.column(c)[i].as_py() for c in (4, 5, 6))
                    template = known[host] = frozenset(repeated or ()), slot or 0, bool(article)
                texts.append(main_text(source or "", *template))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_template_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
