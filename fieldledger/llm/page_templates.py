"""Main text of pages, by the template of their host.

Deduction, for each host (EXALG): tokens are tags, told apart by the elements around them, and words, told apart by
these, their place in the block and the words around them. Words get vectors if their block's first word and length are on
at least `SUPPORT` of the host's pages at that place; no other block can be template text as a whole. The occurrence
vector of a token is how often each page has it. Tokens of equal vectors, on at least `SUPPORT` of the pages and on
`DIFFERENT` different ones, are an equivalence class if they are `LEAST` or more. A class holds on a page where its tokens stand in the class's order
(that of their mean places; tokens out of line do not count), once or in turns that do not mix, and where it does not cross
a larger class: classes lie beside each other or in each other's slots. Valid classes are the template, the rest are slots.
Vectors are compared by 64-bit sums over pages, tokens by 63-bit hashes.

The words in the slots of each element are summed over the host's pages, without elements that are named as menus,
adverts and the like. The host's content element is the `article` or `main` with most words, else the smallest element on
`SUPPORT` of the pages that holds `NEARLY` all slot words (of an article within a main, or of several, also the smallest
that holds nearly as much).

Extraction: of each page the content element is read, without the elements in it that are hidden or boilerplate by tag
(`BOILERPLATE`), and without containers whose class or role is a boilerplate name and which stand on most pages of a host
of two or more; ids, headings, paragraphs and inline tags never count. A page that lacks the element (or a host with a
template that has none) is read from its `article`, else `main`, else `body` without containers of boilerplate names.
A block all of whose words are template text (menu items, teasers, closing lines) is dropped; a block with a word of its
own stays whole, and so does a page that would lose all its text. Block tags and table rows separate blocks; character references are decoded, white space in a block becomes one space, blocks are joined by two line ends.

A null or empty html gives an empty text; html without any tag is one text. A null or odd url is a host of its own kind.
Repeated pages and null ids are kept. Columns other than page_id, url and html are ignored. Unclosed elements end with
their parent or the page; unclosed comments, scripts and styles run to the end of the page.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import saved

SUPPORT = 0.5
NEARLY = 0.98  #: share of the words that the content element must hold
LEAST = 2  #: tokens of an equivalence class
DIFFERENT = 5  #: pages that differ and hold a class: of fewer, nobody can tell template from text

# What tags mean in HTML, and the names boilerplate goes by.
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select"
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul".split())
STRUCTURE = frozenset("html body div section main article aside nav header footer form dialog table figure search menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("head nav footer aside form button dialog menu search label".split())
ARTICLE = frozenset("article main".split())
CONTAINERS = STRUCTURE | frozenset("ul ol dl details fieldset center hgroup dir".split())
_NAMES = re.compile(r"(?<![a-z])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar|footer|foot|header|masthead|banner|ads?|advert(?:s|isements?|ising)?|sponsor(?:ed|s)?|promo(?:tion)?s?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|comments?|replies|respond|disqus|share|sharing|social|related|recommend(?:ed|ations)?|newsletter|subscribe|signup|login|search|widgets?|toolbar|pagination|pager|skip|toc|copyright|legal|disclaimer)(?![a-z])", re.I)
_INSIDE = re.compile(_NAMES.pattern.replace("|header|", "|"), re.I)  # inside the content a header holds the title
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


def _named(attrs: str) -> tuple[str, str, bool]:
    """Classes, id and role of a tag as one name, classes and role alone, and whether it is hidden."""
    if "=" not in attrs and "hidden" not in attrs:
        return "", "", False
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    hidden = "hidden" in found or found.get("aria-hidden", "") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    name, kind = (" ".join(x for x in map(found.get, keys) if x) for keys in (("class", "id", "role"), ("class", "role")))
    return name, kind, hidden


class Element:
    """An open tag. hard: nothing in it is text; bad: boilerplate of the page; block: boilerplate inside the content, if
    the host's template has it. dead: it or one around it is bad; path: tokens of it and of those around it."""

    __slots__ = ("tag", "token", "hard", "bad", "block", "article", "dead", "path", "met")

    def __init__(self, tag: str, name: str, kind: str, hidden: bool, above):
        self.tag, self.met = tag, False
        self.token = f"{tag}.{re.sub(r'[0-9]+', '#', name)}" if name else tag
        inside = above is not None and above.article
        self.article = inside or tag in ARTICLE
        may = tag in CONTAINERS and tag not in ARTICLE and tag not in ("body", "html")
        self.hard = hidden or tag in BOILERPLATE
        self.block = may and bool(_INSIDE.search(kind))
        # a header inside an article carries its title; elsewhere it is the page's
        self.bad = self.hard or (self.block if inside else tag == "header" or (may and bool(_NAMES.search(name))))
        self.dead = self.bad or (above is not None and above.dead)
        path = above.path if above is not None else ()
        self.path = path if self.token in path else (*path, self.token)


def walk(page: str):
    """Yields (open elements, text, is a block edge) in page order."""
    stack: list[Element] = []
    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            yield stack, m["text"], False
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        edge = tag in BLOCKS
        if m["end"]:
            if edge:
                yield stack, None, True
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), None)
            if at is not None:
                del stack[at:]
            continue
        if edge:
            yield stack, None, True
        elif tag in ("br", "td", "th"):
            yield stack, " ", False
        if tag in VOID or not (tag in STRUCTURE or tag in BOILERPLATE or tag == "header" or "class" in m["attrs"] or "id" in m["attrs"]):
            continue
        if m["attrs"].rstrip().endswith("/") and tag in ("use", "path"):
            continue
        name, kind, hidden = _named(m["attrs"])
        if tag in STRUCTURE or tag in BOILERPLATE or hidden or (tag in CONTAINERS and _NAMES.search(name)):
            stack.append(Element(tag, name, kind, hidden, stack[-1] if stack else None))


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@lru_cache(1 << 16)
def key(*parts) -> int:
    """Hash of a token, the same in every task; even for tags (path), odd for words."""
    h = hashed("\0".join(map(str, parts)))
    return h & ~1 if len(parts) == 1 else h | 1


def in_block(path: tuple, words: list[str]) -> list[int]:
    """Hashes of the words of a block, told apart by their place and the words around them."""
    block = hashed("\0".join((*path, "", *words)))
    return [(block + 2 * k & 0x7FFFFFFFFFFFFFFF) | 1 for k in range(len(words))]


def begins(path: tuple, words: list[str]) -> int:
    """Hash of a block's first word and length."""
    return key(path, words[0], len(words))


def plain_words(parts: list[str]) -> list[str]:
    return references.unescape("".join(parts)).split()


def measure(page: str, blocks: list | None = None) -> dict[str, tuple[int, int]]:
    """For each token of a page: how often it opens, and the words in it and in all elements within it, without
    boilerplate. The empty token stands for the page. blocks: gets the path and the parts of each block."""
    count: Counter[str] = Counter({"": 1})
    words: Counter[str] = Counter()
    parts: list[str] = []
    for stack, text, _ in walk(page):
        for e in reversed(stack):
            if e.met:
                break
            e.met = True
            count[e.token] += 1
        if text and not (stack and stack[-1].dead):
            n = len(text.split())
            path = stack[-1].path if stack else ()
            for token in ("", *path):
                words[token] += n
            if blocks is not None:
                if not parts:
                    blocks.append((path, parts))
                parts.append(text)
        elif parts:
            parts = []
    return {t: (count[t], words[t]) for t in count}


def sequence(page: str, known, place: bool):
    """Tokens of a page in order, as (key, path): tags, and words. place: those of blocks all of whose words are in `known`;
    else of those whose beginning is."""
    path, parts = (), []

    def block():
        words = plain_words(parts)
        if words and (place or begins(path, words) in known):
            tokens = in_block(path, words)
            if not place or all(t in known for t in tokens):
                yield from ((t, path) for t in tokens)

    for stack, text, _ in walk(page):
        dead = bool(stack) and stack[-1].dead
        if parts and (dead or text is None):
            yield from block()
            parts = []
        new = []
        for e in reversed(stack):
            if e.met:
                break
            e.met = True
            new.append(e)
        yield from ((key(e.path), None) for e in reversed(new) if not e.dead)
        if text and not dead:
            if not parts:
                path = stack[-1].path if stack else ()
            parts.append(text)
    if parts:
        yield from block()


def in_line(order: list[int]) -> set[int]:
    """The longest rising run of numbers within `order`."""
    last, ends, before = [], [], [-1] * len(order)
    for k, x in enumerate(order):
        at = bisect_left(last, x)
        before[k] = ends[at - 1] if at else -1
        last[at : at + 1], ends[at : at + 1] = [x], [k]
    out, k = set(), ends[-1] if ends else -1
    while k >= 0:
        out.add(order[k])
        k = before[k]
    return out


def holding(page: str, classes: list[list[int]]) -> set[int]:
    """Words of the classes that hold on a page: ordered, in turns that do not mix, nested in larger ones."""
    at: dict[int, list[int]] = {}
    for k, (token, _) in enumerate(sequence(page, {t for c in classes for t in c if t & 1}, True)):
        at.setdefault(token, []).append(k)
    valid: set[int] = set()
    spans: list[tuple[int, int]] = []
    for tokens in sorted(classes, key=len, reverse=True):
        turns = len(at.get(tokens[0], ()))
        if not turns or any(len(at.get(t, ())) != turns for t in tokens):
            continue
        kept = set(range(len(tokens)))
        for j in range(turns):
            kept &= in_line(sorted(range(len(tokens)), key=lambda k: at[tokens[k]][j]))
        own = [tokens[k] for k in sorted(kept)]
        if len(own) < LEAST:
            continue
        new = [(at[own[0]][j], at[own[-1]][j]) for j in range(turns)]
        if any(a[1] >= b[0] for a, b in zip(new, new[1:], strict=False)) or any(a < c <= b < d or c < a <= d < b for a, b in new for c, d in spans):
            continue
        spans += new
        valid.update(t for t in own if t & 1)
    return valid


def dropped(stack: list[Element], at: int, confirmed) -> bool:
    """Is the text here boilerplate, if the element at place `at` is the content (none if below 0)?"""
    if at < 0:
        return bool(stack) and stack[-1].dead
    return (at > 0 and stack[at - 1].dead) or stack[at].hard or any(e.hard or (e.block and e.token in confirmed) for e in stack[at + 1 :])


def extract(page: str, content: str | None, confirmed=(), classes=()) -> str:
    """Main text of a page; content: token of the host's content element; confirmed: boilerplate blocks of its template;
    classes: its equivalence classes that hold words."""
    found: dict[str, list[tuple[tuple, list[str]]]] = {"content": [], "article": [], "main": [], "body": []}
    ended = dict.fromkeys(found, True)
    for stack, text, edge in walk(page):
        for kind in found:
            at = -1 if kind == "body" else next((k for k, e in enumerate(stack) if (e.token == content if kind == "content" else e.tag == kind)), -1)
            if (at < 0 and kind != "body") or edge or dropped(stack, at, confirmed):
                ended[kind] = True
            elif text:
                if ended[kind]:
                    found[kind].append((stack[-1].path if stack else (), []))
                    ended[kind] = False
                found[kind][-1][1].append(text)
    template = holding(page, classes) if classes else ()
    for without in (template, ()) if template else ((),):
        for kind in found:
            blocks = [(path, words) for path, parts in found[kind] if (words := plain_words(parts))]
            own = [" ".join(words) for path, words in blocks if not without or any(t not in without for t in in_block(path, words))]
            if own:
                return "\n\n".join(own)
    return ""


def host_of(url):
    return F.coalesce(F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/?#:]*)", 1), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """host, content: the content element of every host's template (null where it has none); confirmed: its boilerplate
    blocks; classes: its equivalence classes, each in order, if any holds words."""

    def tokens(batches):
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                blocks: list = []
                rows = [((host, t, None), w) for t, (_, w) in measure(page, blocks).items()]
                split = ((path, plain_words(parts)) for path, parts in blocks)
                firsts = {begins(path, words) for path, words in split if words}
                rows += [((host, None, first), 0) for first in firsts]
                for k, w in rows:
                    row = sums.setdefault(k, [0, 0])
                    row[0] += 1
                    row[1] += w
            cols = list(zip(*((*k, *v) for k, v in sums.items()), strict=True)) if sums else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["host", "token", "word", "held", "words"])

    size = pages.groupBy("host").agg(F.count("*").alias("pages"))
    read = pages.mapInArrow(tokens, "host string, token string, word long, held long, words long")
    sums = read.groupBy("host", "token", "word").agg(F.sum("held").alias("held"), F.sum("words").alias("words"))
    # at least SUPPORT of the pages hold a token, so a host has no more of them than twice the tokens of a page
    common = saved(sums.join(size, "host").where(F.col("held") >= F.lit(SUPPORT) * F.col("pages")), "common")
    classes = saved(equivalence_classes(pages, common, size), "classes")
    # words of the template are no slot words, in whichever element
    inside = classes.select("host", F.explode("tokens").alias("t")).where("t.times > 0").select("host", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), "t.path"))).alias("token"), F.col("t.times").alias("times"))
    template = inside.groupBy("host", "token").agg(F.sum("times").alias("template"))
    frequent = common.where("token is not null").join(template, ["host", "token"], "left").withColumn("words", F.when(F.col("token").rlike(r"^(?:article|main)(?:[.]|\z)"), F.col("words")).otherwise(F.col("words") - F.coalesce("template", F.lit(0))))
    text = classes.groupBy("host").agg(F.collect_list(F.transform("tokens", lambda t: t["token"])).alias("classes"), F.max(F.exists("tokens", lambda t: t["times"] > 0)).alias("_text")).where("_text").drop("_text")
    each = frequent.groupBy("host").agg(F.first("pages").alias("pages"), F.collect_list(F.struct("words", "token")).alias("all"))
    of = lambda tags: lambda t: t["token"].rlike(rf"^(?:{'|'.join(sorted(tags))})(?:[.]|\z)")
    article = F.filter("all", lambda t: of(ARTICLE)(t) & (t["words"] > 0))
    other = F.filter("all", lambda t: (t["token"] != "") & ~of(("html", "body"))(t) & (t["words"] > 0))
    whole = F.array_max(F.filter("all", lambda t: t["token"] == ""))["words"]
    smallest = lambda ts, words: F.array_min(F.filter(ts, lambda t: t["words"] >= F.lit(NEARLY) * words))["token"]
    content = F.coalesce(smallest(article, F.array_max(article)["words"]), smallest(other, whole))
    # a block is confirmed by standing on most of at least two pages
    blocks = F.transform(F.filter("all", lambda t: (F.col("pages") > 1) & t["token"].rlike(f"(?i){_INSIDE.pattern}")), lambda t: t["token"])
    return each.select("host", content.alias("content"), blocks.alias("confirmed")).join(text, "host", "left")


def equivalence_classes(pages: DataFrame, common: DataFrame, size: DataFrame) -> DataFrame:
    """host, tokens: (place, token, times: words of text it stands for, path) of each class in the order of their places."""

    def vectors(batches):
        for batch in batches:
            sums: dict[tuple, list] = {}
            for host, page, words in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "words")), strict=True):
                r = hashed(page) | 1
                places: dict[int, list[int]] = {}
                paths = {}
                for k, (token, path) in enumerate(sequence(page, set(words), False)):
                    places.setdefault(token, []).append(k)
                    paths[token] = path
                for token, at in places.items():
                    h = r * (2 * len(at) + 1)
                    row = sums.setdefault((host, token), [0, 0, 0, 0, 0, 0, paths[token]])
                    row[:6] = row[0] + 1, row[1] + (h & 0xFFFFFFFF), row[2] + (h >> 32 & 0xFFFFFFFF), row[3] + at[0], row[4] + (len(at) if token & 1 else 0), row[5] | 1 << (r >> 8) % 63
            cols = list(zip(*((*k, *v) for k, v in sums.items()), strict=True)) if sums else [[]] * 9
            kinds = (pa.string(), *[pa.int64()] * 7, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["host", "token", "held", "low", "high", "place", "times", "seen", "path"])

    words = common.where("word is not null").groupBy("host").agg(F.collect_list("word").alias("words"))
    asked = pages.join(words, "host", "left").select("host", "html", F.coalesce("words", F.array().cast("array<bigint>")).alias("words"))
    read = asked.mapInArrow(vectors, "host string, token long, held long, low long, high long, place long, times long, seen long, path array<string>")
    sums = read.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("held", "low", "high", "place", "times")), F.bit_or("seen").alias("seen"), F.first("path", True).alias("path"))
    # bits of page hashes: never more than there are different pages
    frequent = sums.join(size, "host").where((F.col("held") >= F.lit(SUPPORT) * F.col("pages")) & (F.bit_count("seen") >= DIFFERENT))
    each = frequent.groupBy("host", "held", "low", "high").agg(F.sort_array(F.collect_list(F.struct("place", "token", "times", "path"))).alias("tokens"))
    return each.where(F.size("tokens") >= LEAST).select("host", "tokens")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    base = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    known = saved(templates(base), "templates")

    def work(batches):
        for batch in batches:
            text = [extract(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("html", "content", "confirmed", "classes")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return base.join(known, "host", "left").select("page_id", "url", "html", "content", F.coalesce("confirmed", F.array()).alias("confirmed"), "classes").mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
