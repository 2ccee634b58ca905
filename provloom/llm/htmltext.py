"""Main text of web pages by equivalence-class template deduction.

A page is read as a stream of tags and texts. The token of an element is its chain of tags with class and id
from the root, so the same tag at another place is another token. Over all pages of a host every token has
an occurrence vector, its count on each page; tokens with equal vectors form an equivalence class. Vectors are
compared by the exclusive-or of a hash of (page, count), so that they are summed up per task before anything
is shuffled and no page meets another. The classes that occur once on most pages of the host and lie
within one another are its template; what the template leaves open are the slots. The main slot is the
innermost one, ``article`` or ``main`` before others, that still holds half of the host's text; other slots,
and texts that never change from page to page, go, as do menus, headers, footers, side bars, notices, adverts,
forms, scripts, styles and comments, told by tag, role or words of class and id. Words and ``form`` do not hide what
holds most of a page's text, nor what holds the page's only articles (``has-sidebar`` around a whole page, a page
within a form); reader comments stay hidden however long they are. Nothing is taken for unchanging on a host
whose pages are all alike, nor on a page that would have no text then.

A page without the main slot, or of a host with one page, is read by its own largest article, else its body.
Blocks end at block-level tags; white space within a block, line breaks too, is one space; blocks are joined
by an empty line.

Defined results: a null or empty html has an empty text; a null url belongs to the host ''; repeated rows are
answered each; unclosed, misnested and stray tags are closed where a block of their kind opens or their
parent ends; an empty table gives no rows; extra columns pass by. Whole pages are read, nothing is capped. A
host's tokens meet by (host, token); the templates are joined to the pages by broadcast while they
are below ``BROADCAST_BYTES``, by a join otherwise."""

from __future__ import annotations

import html
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.llm.batches import pieces
from provloom.llm.shared import written

BROADCAST_BYTES = 8 << 20

# fixed values: names of the format
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "area audio button canvas embed iframe img input label link map math meta noscript object param picture script select source style svg "
    "template textarea track video a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset(
    "head title script style noscript template svg math nav header footer aside form button select option textarea input label fieldset menu dialog iframe object".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("html body article main section div nav aside header footer form table ul ol dl blockquote".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "sidenav footer header masthead topbar cookie cookies consent gdpr notice notices alert comment comments disqus replies respond share sharing social "
    "related recommended newsletter subscribe subscription signup login modal popup overlay widget toolbar pagination pager skip copyright".split()
)
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"<]*\"|'[^'<]*')*+>|[^>]*>)|<[!?][^>]*>", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|\b(hidden)\b")
_WORDS = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_MASK = (1 << 64) - 1


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mix(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


class Element:
    """``aside``: beside the text, with all below it. ``soft``: only because of its words, or as a form (2: reader comments)."""

    __slots__ = ("aside", "depth", "main", "name", "parent", "soft", "token")

    def __init__(self, name, token, parent, depth, aside, soft, main):
        self.name, self.token, self.parent, self.depth, self.aside, self.soft, self.main = name, token, parent, depth, aside, soft, main


def _describe(name: str, rest: str) -> tuple[str, bool, int, bool]:
    """Key of a tag for its token, whether it is beside the text for sure, or by its words, and whether it is marked as
    the main part."""
    key, aside, soft, main = name, name in NEVER and name != "form", int(name == "form"), name in ("article", "main")
    if len(rest) < 3:
        return key, aside, soft, main
    for a in _ATTRIBUTE.finditer(rest):
        what = (a[1] or a[3]).lower()
        value = (a[2] or "").strip("\"'")
        if what in ("class", "id"):
            key += f" {what}={value}" if what == "class" else ""
            if not aside and name not in ("html", "body", "article", "main"):
                told = {w.lower() for w in _WORDS.split(value)} & ASIDE_WORDS
                soft = max(soft, 2 if told & COMMENT_WORDS else int(bool(told)))
        elif what == "role":
            soft = max(soft, int(value.lower() == "form"))
            aside = aside or value.lower() in ASIDE_ROLES and value.lower() != "form"
            main = main or value.lower() in ("main", "article")
        elif what == "hidden" or what == "aria-hidden" and value.lower() == "true" or what == "style" and "display:none" in value.replace(" ", "").lower():
            aside = True
    return key, aside, soft, main


def _settle(elements: list[Element], texts: list[tuple[Element, int]]) -> None:
    """Decides which words hide: sets ``aside`` of every element. ``texts``: elements and sizes of the texts right in them,
    those beside the text for sure left out."""
    doubtful = [e for e in elements if e.soft == 1]
    if doubtful:
        size = dict.fromkeys(elements, 0)
        for e, n in texts:
            size[e] += n
        for e in reversed(elements):  # parents come first
            if e.parent is not None:
                size[e.parent] += size[e]
        for e in doubtful:
            if 2 * size[e] > size[elements[0]]:
                e.soft = 0
        # articles that are all behind words: those around the largest one do not hide it
        articles = [e for e in elements if e.main and size[e]]
        hidden = [[a for a in _line(e) if a.soft] for e in articles]
        if articles and all(hidden):
            open_ = [(size[e], line) for e, line in zip(articles, hidden, strict=True) if all(a.soft == 1 for a in line)]
            for a in max(open_, key=lambda x: x[0], default=(0, []))[1]:
                a.soft = 0
    for e in elements:  # parents come first
        e.aside = e.aside or bool(e.soft) or (e.parent is not None and e.parent.aside)


def read_page(page: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """All elements in order of their start, the root first, and the blocks: (innermost element at the
    block's start, text). Elements beside the text keep no blocks."""
    root = Element("", 1, None, 0, False, 0, False)
    elements, stack, blocks = [root], [root], []
    held: list[tuple[Element | None, str]] = []  # pieces of a block with the element they stand in

    def end_block():
        if held:
            blocks.append(held.copy())
            held.clear()

    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.search(page, pos)
        at = m.start() if m else n
        if at > pos and not stack[-1].aside:
            held.append((stack[-1], page[pos:at]))
        if not m:
            break
        pos = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if name not in INLINE and name != "br":
            end_block()
        if name == "br":
            held.append((None, " ")) if held else None
        elif m[1]:
            stop = name in SCOPES
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if not stop and stack[k].name in SCOPES:
                    break
        else:
            if name not in INLINE:
                closing = CLOSES.get(name, frozenset(["p", *HEADINGS]) if name not in ("p",) else frozenset(["p"]))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in closing:
                        del stack[k:]
                        break
                    if stack[k].name in SCOPES:
                        break
            top = stack[-1]
            key, aside, soft, main = _describe(name, m[3])
            if name == "header" and any(e.main for e in stack):
                aside, soft = False, 0  # the head of an article holds its title
            token = _mix((top.token * 0x100000001B3 + zlib.crc32(key.encode())) & _MASK)
            e = Element(name, token, top, top.depth + 1, aside or top.aside, soft, main)
            elements.append(e)
            if name in RAW:
                close = re.compile(rf"</{name}[^>]*>", re.I).search(page, pos)
                pos = close.end() if close else n
            elif name not in VOID and not m[3].endswith("/>"):
                stack.append(e)
    end_block()
    _settle(elements, [(e, len(piece)) for block in blocks for e, piece in block if e is not None and not piece.isspace()])
    read = []
    for block in blocks:
        owner, kept = None, []
        for e, piece in block:
            if e is None:
                kept.append(piece)
            elif not e.aside:
                owner = owner or next((a for a in _line(e) if a.name not in INLINE), root)
                kept.append(piece)
        if owner is not None and (text := " ".join(html.unescape("".join(kept)).split())):
            read.append((owner, text))
    return elements, read


def token_counts(page_key: int, page: str) -> list[tuple]:
    """Per token of a page: token, parent, depth, flags, count hash, once, characters in it, text hash."""
    elements, blocks = read_page(page)
    seen: dict[int, list] = {}
    for e in elements:
        if (s := seen.get(e.token)) is None:
            seen[e.token] = [e, 1, 0, 0]
        else:
            s[1] += 1
    for e, text in blocks:
        s = seen[e.token]
        s[2] += len(text)
        s[3] = zlib.crc32(text.encode(), s[3])
    for token in reversed(seen):  # parents come before their children
        s = seen[token]
        if s[0].parent is not None:
            up = seen[s[0].parent.token]
            up[2] += s[2]
            up[3] = zlib.crc32(s[3].to_bytes(4, "little"), up[3])
    return [
        (token, e.depth, e.aside, e.main, _mix((page_key * 0x9E3779B97F4A7C15 + count) & _MASK), count == 1, chars, told)
        for token, (e, count, chars, told) in seen.items()
    ]


_STATS = pa.schema([
    ("host", pa.string()), ("token", pa.int64()), ("depth", pa.int32()), ("aside", pa.bool_()), ("main", pa.bool_()), ("pages", pa.int64()),
    ("once", pa.int64()), ("vector", pa.int64()), ("chars", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
])
_STATS_DDL = "host string, token long, depth int, aside boolean, main boolean, pages long, once long, vector long, chars long, low long, high long"

#: rows of host statistics that a task holds before it hands them on
HELD_TOKENS = 100_000


def token_statistics(pages: DataFrame) -> DataFrame:
    """Per (host, token) over all pages: pages, pages with it once, vector hash, characters, whether its text
    never changes. Summed up per task first."""

    def run(batches):
        held: dict[tuple[str, int], list] = {}

        def out():
            rows = [(h, _signed(t), *v) for (h, t), v in held.items()]
            held.clear()
            columns = list(zip(*rows, strict=True)) or [[] for _ in _STATS]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _STATS, strict=True)], schema=_STATS)

        for batch in batches:
            for part in pieces(batch, "html"):
                for key, url, page in zip(part.column("page").to_pylist(), part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                    host = host_of(url)
                    for token, depth, aside, main, vector, once, chars, told in token_counts(key & _MASK, page or ""):
                        v = held.get((host, token))
                        if v is None:
                            held[host, token] = [depth, aside, main, 1, int(once), _signed(vector), chars, told, told]
                        else:
                            v[3] += 1
                            v[4] += once
                            v[5] ^= _signed(vector)
                            v[6] += chars
                            v[7], v[8] = min(v[7], told), max(v[8], told)
                if len(held) > HELD_TOKENS:
                    yield out()
        if held:
            yield out()

    keyed = pages.select(F.xxhash64("page_id", "url").alias("page"), "url", F.coalesce("html", F.lit("")).alias("html"))
    found = keyed.mapInArrow(run, _STATS_DDL)
    return found.groupBy("host", "token").agg(
        F.min("depth").alias("depth"), F.min("aside").alias("aside"), F.max("main").alias("main"), F.sum("pages").alias("pages"),
        F.sum("once").alias("once"), F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars"),
        (F.min("low") == F.max("high")).alias("constant"),
    )


def templates(pages: DataFrame) -> DataFrame:
    """host, main (token of the main slot), constant (tokens whose text is part of the template)."""
    t = token_statistics(pages)
    t = written(t, "page-tokens")
    hosts = t.groupBy("host").agg(
        F.max("pages").alias("host_pages"), F.max("chars").alias("host_chars"), F.max(F.when(F.col("depth") == 0, F.col("constant"))).alias("alike")
    )
    t = t.join(hosts, "host").join(t.groupBy("host", "vector").agg(F.count(F.lit(1)).alias("class_size")), ["host", "vector"])
    valid = (F.col("host_pages") >= 2) & (2 * F.col("pages") >= F.col("host_pages")) & (F.col("once") == F.col("pages"))
    slot = valid & ~F.col("aside") & (F.col("depth") > 0) & (2 * F.col("chars") >= F.col("host_chars"))
    rank = F.struct(F.col("main").cast("int"), "depth", "class_size", "chars", "token")
    still = (F.col("host_pages") >= 3) & (F.col("pages") == F.col("host_pages")) & F.col("constant") & ~F.col("alike") & (F.col("depth") > 0)
    return t.groupBy("host").agg(
        F.max_by("token", F.when(slot, rank)).alias("main"), F.max_by("main", F.when(slot, rank)).alias("marked"),
        F.sort_array(F.collect_list(F.when(still & ~F.col("aside"), F.col("token")))).alias("still"),
    ).select("host", "main", F.when(F.col("marked"), F.array().cast("array<bigint>")).otherwise(F.col("still")).alias("constant"))


def main_text(page: str, main: int | None, constant: list[int]) -> str:
    elements, blocks = read_page(page)
    slot = main is not None and any(e.token == main & _MASK and not e.aside for e in elements)
    wanted = {main & _MASK} if slot else set()
    if not slot:  # the page's own largest article, else all that is not beside the text
        size: dict[Element, int] = {}
        for e, text in blocks:
            up = next((a for a in _line(e) if a.main), None)
            if up is not None:
                size[up] = size.get(up, 0) + len(text)
        wanted = {max(size, key=size.get).token} if size else {1}
    still = {c & _MASK for c in constant} if slot else set()
    lines = [(text, {a.token for a in _line(e)}) for e, text in blocks]
    inside = [(text, line) for text, line in lines if not wanted.isdisjoint(line)]
    changing = [text for text, line in inside if still.isdisjoint(line)]
    return "\n\n".join(changing or [text for text, _ in inside])


def _line(e: Element):
    while e is not None:
        yield e
        e = e.parent


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and whether the host's template led to the text."""
    pages = pages.select("page_id", "url", "html")
    t = written(templates(pages), "page-templates")
    size = t.agg(F.coalesce(F.sum(F.length("host") + 16 + 8 * F.size("constant")), F.lit(0))).head()[0]
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = pages.withColumn("host", host).join(F.broadcast(t) if size <= BROADCAST_BYTES else t, "host", "left")
    joined = joined.select("page_id", "url", "html", "main", "constant")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "html"):
                rows = zip(*(part.column(c).to_pylist() for c in ("html", "main", "constant")), strict=True)
                texts = [(main_text(h or "", m, c or []), m is not None) for h, m, c in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"), part.column("url"), pa.array([x for x, _ in texts], pa.string()),
                        pa.array([len(x) for x, _ in texts], pa.int64()), pa.array([y for _, y in texts], pa.bool_()),
                    ],
                    ["page_id", "url", "text", "n_chars", "by_template"],
                )

    kind = dict(pages.dtypes)["page_id"]
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, by_template boolean")
