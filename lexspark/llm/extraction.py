"""Main text of web pages by deducing the template of each host from equivalence classes of tokens.

A page is a sequence of structural tokens: elements by the path of tags and class names that leads
to them. Tokens of one host that occur equally often on the same pages share an occurrence vector
and form an equivalence class. Tokens nest, since a path leads through the tokens around it. Tokens
of a class inside one token are valid if several pages have them and they come in one order on all
of these. Valid classes, nested, are the template; the text between its tokens are slots, inside
articles too. A slot that holds the same text on its pages, while the rest of these pages differs, or
links for the most part, is the template's own; what remains is extracted. A text block that is the same on all pages is
the article's, not the template's, where it stands in an article or between text that varies. Names that say
comments, sidebar, advert, notice, menu or the like speak against a token and all inside it, on one page or many; names that often stand for
text too ("popular") only where no valid class has the token (of hosts with a single page, rare parts, parts that change places).
Elements that HTML itself sets apart or that a page hides are never text, on that page.

Only sums per (host, token) are gathered: pages, text, link text, a hash sum that identifies the
occurrence vector, and extremes of hashes that tell whether all texts are equal, and all rests of pages. They are combined before
they are shuffled, so a host with a third of all pages is a few rows a task. Pages get only the tokens that decide something
on their host: constant and link slots, and weak names, of valid classes. Tokens that a single page has, such as random class names, are not among them.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import checkpoint, table

#: Templates of so many tokens and characters of paths in all are broadcast; beyond that pages are joined with them by host.
BROADCAST_TOKENS, BROADCAST_CHARS = 200_000, 32_000_000

# Element names and roles of HTML, and common class names, that say what an element is for.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "nobr", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label"}
BLOCKS_IN_TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "hr", "address", "center", "hgroup"}
NOT_TEXT = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "input", "fieldset", "legend", "audio", "video", "map", "applet", "datalist", "output", "progress", "meter"}
UNBROKEN = {"script", "style", "noscript", "template", "svg", "math", "object", "canvas", "iframe", "button", "select", "datalist", "output", "progress", "meter", "audio", "video", "map"}  # may stand inside a text block, which goes on after them
LINKED_TEXT = {"article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6"}  # may be a link as a whole
NOT_TEXT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist"}
NOT_TEXT_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners billboard "
    "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager toc header masthead topbar footer foot colophon copyright "
    "sidebar sidebars aside rail widget widgets related recommended recommendations teaser teasers trending popular "
    "notice notices cookie cookies consent gdpr privacy alert popup modal overlay lightbox paywall subscribe subscription newsletter signup login register "
    "comment comments commentlist discussion disqus replies reply respond reviews reactions share sharing social follow tags toolbar "
    "search form hidden noprint print skip tracking legal disclaimer".split()
)
WEAK_NAMES = {"popular", "trending", "reviews", "legal", "print", "tags"}  # may name what a page is about
OWNERS = {"reader", "readers", "user", "users", "visitor", "visitors", "article", "story", "page", "news", "blog", "google", "text", "body", "thread", "feed", "zone"}  # whose comments or adverts they are
COMMENT_NAMES = {"comment", "comments", "reply", "replies"}  # may name an article element
BOX_NAMES = set("area bar block box btn button buttons bottom col column container content group holder icons inner item items left link links list main panel post posts right row section site slot top unit wrap wrapper".split())
ARTICLE_PARTS = {"header", "foot", "footer", "print", "legal", "tags"}  # may name parts of an article itself
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.S)
_IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "blockquote", "td", "th", "aside", "nav", "header", "footer", "form", "figure"}


@dataclass
class _Element:
    tag: str
    path: str  # of structural elements, with class names
    skip: bool  # not text by the element itself, or hidden
    named: int  # named as not being text: 2, or 1 if the name may mislead
    inside: bool  # in an article or main
    link: bool


@dataclass
class Token:
    """A structural element on a page: its path, and the text right inside it and its text blocks."""

    path: str
    skip: bool
    inside: bool
    named: int = 0  # by its own names, as in _Element
    above: int = 0  # place of the token around it
    blocks: list[str] = field(default_factory=list)
    link_chars: int = 0


def _names(attributes: str) -> tuple[list[str], dict[str, str]]:
    held = {}
    for m in _ATTRIBUTE.finditer(attributes):
        held.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    names = f"{held.get('class', '')} {held.get('id', '')}".lower().split()
    return names, held


def _is_skipped(tag: str, held: dict[str, str], inside: bool) -> bool:
    if tag in NOT_TEXT or (tag == "header" and not inside):
        return True
    if held.get("role", "").lower() in NOT_TEXT_ROLES or "hidden" in held or held.get("aria-hidden", "").lower() == "true":
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", held.get("style", ""), re.I))


def _is_named(tag: str, names: list[str], inside: bool) -> int:
    """Whether a class or id says what is not text, as a whole: "comment-list" and "reader-comments" do, "legal-news" and "share-price" do not."""
    if tag in {"html", "body", "main"}:
        return 0
    best = 0
    for name in names:
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        told = [w for w in words if w in NOT_TEXT_NAMES and not (inside and w in ARTICLE_PARTS) and (tag != "article" or w in COMMENT_NAMES)]
        boxes = BOX_NAMES if any(w in ARTICLE_PARTS for w in told) else BOX_NAMES | OWNERS
        if told and all(w in boxes or w in told for w in words):
            best = max(best, 1 if all(w in WEAK_NAMES for w in told) else 2)
    return best


def _path_names(names: list[str]) -> list[str]:
    """The words of classes and ids, without numbers that differ from page to page."""
    return sorted({w for name in names for w in re.split(r"[^a-z]+", name) if w})


def read_page(source: str) -> tuple[list[Token], list[tuple[int, str]]]:
    """Structural tokens of a page and its text blocks in page order, each with the place of its token.

    Markup may be cut off or unclosed: a closing tag closes what is open inside, one without its
    opening is ignored, and paragraphs, items and cells end where the next one begins.
    """
    tokens = [Token("", False, False)]
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[_Element, int]] = [(_Element("", "", False, 0, False, False), 0)]
    parts: list[str] = []
    linked = mute = 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text:
            at = stack[-1][1]
            tokens[at].blocks.append(text)
            tokens[at].link_chars += min(linked, len(text))
            blocks.append((at, text))
        parts, linked = [], 0

    at = 0
    while True:
        m = _MARKUP.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text and not mute:
            parts.append(text)
            if stack[-1][0].link:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            parts.append(entities.escape(m[0][9:].removesuffix("]]>")))
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                parts.append(" ")
            if not any(e.tag == tag for e, _ in stack):
                continue
            if tag not in INLINE and tag not in UNBROKEN and not mute:
                flush()
            while stack[-1][0].tag != tag:
                if stack[-1][0].tag not in INLINE and stack[-1][0].tag not in UNBROKEN and not mute:
                    flush()
                mute -= stack.pop()[0].tag in UNBROKEN
            mute -= stack.pop()[0].tag in UNBROKEN
            continue
        if tag not in INLINE and tag not in UNBROKEN and not mute:
            flush()
        if tag in VOID:
            if tag in {"br", "wbr", "img"}:
                parts.append("" if tag == "wbr" else " ")
            continue
        names, held = _names(m[3])
        if tag in UNBROKEN:  # neither text nor the end of a text block
            if m[0].endswith("/>"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
            else:
                stack.append((_Element(tag, stack[-1][0].path, True, 0, stack[-1][0].inside, False), stack[-1][1]))
                mute += 1
            continue
        if tag not in INLINE:  # a text block ends where the next begins, and inline elements end with it
            closes = _IMPLIED.get(tag) or ({"p"} if tag in BLOCKS_IN_TEXT or tag in _SCOPE else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0].tag in closes:
                    mute -= sum(e.tag in UNBROKEN for e, _ in stack[i:])
                    del stack[i:]
                    break
                if stack[i][0].tag in _SCOPE:
                    break
        above, place = stack[-1]
        inside = above.inside or tag in {"article", "main"} or held.get("role", "").lower() in {"main", "article"}
        skip = above.skip or _is_skipped(tag, held, above.inside)
        own = _is_named(tag, names, above.inside)
        named = max(above.named, own)
        boxed = tag in BLOCKS_IN_TEXT and names  # a text block with a name of its own may be a box of the template
        structural = tag not in INLINE and tag not in BLOCKS_IN_TEXT or boxed or (skip and not above.skip) or named > above.named
        path = above.path
        if structural:
            path = f"{above.path}/{'.'.join([tag, *_path_names(names)])}"
            tokens.append(Token(path, skip, inside, own, place))
            place = len(tokens) - 1
        if not m[0].endswith("/>") or tag not in {"svg", "math", "object"}:
            stack.append((_Element(tag, path, skip, named, inside, above.link or tag == "a"), place))
        if tag in RAW and not m[0].endswith("/>"):
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(source, at)
            at = end.start() if end else len(source)
    flush()
    return tokens, blocks


def host_of(url: Column) -> Column:
    """The host of an address in lower case, with or without a scheme; empty for none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), F.lit("")))


_TOKENS = "host string, path string, pages long, vector decimal(38,0), least long, most long, chars long, links long, least_rest long, most_rest long, weak int"
_REST = (1 << 63) - 1


def _both(of: Callable[[int, int], int], a: int | None, b: int | None) -> int | None:
    return a if b is None else b if a is None else of(a, b)


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "replace"), 4) >> 2  # sums of 4 fit, and wrap as long does not


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_TOKENS`` summed over the pages of a task: texts of slots that are shown, and of the rest of their pages."""
    held: dict[tuple[str, str], list] = {}

    def rows() -> pa.RecordBatch:
        keys = list(held)
        cols = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys])]
        kinds = (pa.int64(), pa.decimal128(38), *[pa.int64()] * 6, pa.int32())
        cols += [pa.array([held[k][i] for k in keys], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(cols, names=["host", "path", "pages", "vector", "least", "most", "chars", "links", "least_rest", "most_rest", "weak"])

    for b in batches:
        for page, host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            seen: dict[str, list[Token]] = {}
            for t in read_page(source.as_py() or "")[0]:
                seen.setdefault(t.path, []).append(t)
            found = {}
            for path, own in seen.items():
                shown = [t for t in own if not t.skip and t.blocks]
                told = _hash(path, *[x for t in shown for x in t.blocks]) if shown else 0
                found[path] = (shown, told)
            page_sum = sum(told for _, told in found.values())
            for path, (shown, told) in found.items():
                vector, rest = _hash(page, len(seen[path])), (page_sum - told) & _REST
                weak = int(any(t.named == 1 for t in seen[path]))
                new = [1, vector, None, None, 0, 0, None, None, weak]
                if shown:  # pages that hide a slot or leave it empty say nothing about its text
                    text = _hash(*[x for t in shown for x in t.blocks])
                    new = [1, vector, text, text, sum(len(x) for t in shown for x in t.blocks), sum(t.link_chars for t in shown), rest, rest, weak]
                old = held.get((host, path))
                if old is not None:
                    new = [old[0] + 1, old[1] + vector, _both(min, old[2], new[2]), _both(max, old[3], new[3]), old[4] + new[4], old[5] + new[5], _both(min, old[6], new[6]), _both(max, old[7], new[7]), max(old[8], new[8])]
                held[host, path] = new
        if len(held) > 100_000:
            yield rows()
            held.clear()
    if held:
        yield rows()


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, class_id, around, least, most): hashes of the orders in which tokens of a class come inside one token."""
    held: dict[tuple[str, int, str], tuple[int, int]] = {}

    def rows() -> pa.RecordBatch:
        cols = [pa.array([k[i] for k in held], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))]
        cols += [pa.array([v[i] for v in held.values()], pa.int64()) for i in range(2)]
        return pa.RecordBatch.from_arrays(cols, names=["host", "class_id", "around", "least", "most"])

    for b in batches:
        for host, source, asked in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            if not asked.is_valid:
                continue
            classes, found = {x["path"]: x["class_id"] for x in asked.as_py()}, {}
            for path in dict.fromkeys(t.path for t in read_page(source.as_py() or "")[0]):
                if path in classes:
                    found.setdefault((host, classes[path], path.rpartition("/")[0]), []).append(path)
            for k, order in found.items():
                h = _hash(*order)
                least, most = held.get(k, (h, h))
                held[k] = (min(least, h), max(most, h))
        if len(held) > 100_000:
            yield rows()
            held.clear()
    if held:
        yield rows()


def _by_host(pages: DataFrame, tokens: DataFrame, held: Column, name: str) -> DataFrame:
    """``pages`` with what is held of their host's tokens, null for none."""
    key = "_" + max([*pages.columns, name], key=len)  # longer than all other names, so another one
    told = tokens.groupBy(F.col("host").alias(key)).agg(F.collect_list(held).alias(name))
    size = tokens.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("path")), F.lit(0)).alias("chars")).first()
    few = size.n <= BROADCAST_TOKENS and size.chars <= BROADCAST_CHARS
    return pages.join(F.broadcast(told) if few else told, host_of(pages["url"]) == told[key], "left").drop(told[key])


def templates(pages: DataFrame) -> DataFrame:
    """``(host, path, class_id, extract, constant)``: the tokens of valid classes that decide something on their host.

    Those are tokens whose slots are not extracted, because they are constant or hold links, and tokens whose weak names do not count. Classes
    without such tokens are not looked at.
    """
    raw = pages.select("page_id", host_of(F.col("url")).alias("host"), "html").mapInArrow(_occurrences, _TOKENS)
    tokens = raw.groupBy("host", "path").agg(
        F.sum("pages").alias("pages"), F.sum("vector").alias("vector"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("chars").alias("chars"),
        F.sum("links").alias("links"), (F.min("least_rest") != F.max("most_rest")).alias("rests"), F.max("weak").alias("weak"),
    )
    around = F.expr("left(path, greatest(length(path) - locate('/', reverse(path)), 0))")
    constant = F.coalesce(F.col("rests") & (F.col("least") == F.col("most")), F.lit(False))  # if the rests are equal too, its pages are copies, which says nothing about slots
    linked = (2 * F.col("links") > F.col("chars")) & ~F.regexp_extract("path", r"([^/.]*)[^/]*$", 1).isin(*LINKED_TEXT)
    told = tokens.where("pages > 1").select("host", "path", F.xxhash64("vector", "pages").alias("class_id"), around.alias("around"), constant.alias("constant"), (~(constant | linked)).alias("extract"), "weak")
    told = checkpoint(told)
    part, deciding = ["host", "class_id", "around"], ~F.col("extract") | (F.col("weak") > 0)
    several = told.groupBy(*part).agg(F.count("*").alias("n"), F.max(deciding).alias("decides")).where("n > 1 and decides").select(*part)
    asked = told.join(several, part, "left_semi")
    orders = _by_host(pages.select("url", "html"), asked, F.struct("path", "class_id"), "asked").select(host_of(F.col("url")).alias("host"), "html", "asked")
    orders = orders.mapInArrow(_orders, "host string, class_id long, around string, least long, most long")
    unordered = orders.groupBy(*part).agg((F.min("least") != F.max("most")).alias("unordered")).where("unordered")
    return checkpoint(told.where(deciding).join(unordered, part, "left_anti").select("host", "path", "class_id", "extract", "constant"))


def main_text(source: str | None, template: dict[str, tuple[bool, bool]]) -> str:
    """What remains of a page's slots after its host's template; an article, if there is one, is all that counts.

    ``template`` has deciding tokens of valid classes: whether their slots are extracted, and whether they are constant.
    """
    tokens, blocks = read_page(source or "")
    use, against, weak = [], [], []
    for t in tokens:
        first = not use
        known = template.get(t.path)
        against.append(t.named == 2 or (not first and against[t.above]))
        weak.append(known is None and (t.named == 1 or (not first and weak[t.above])))
        fits = known is None or known[0]
        if not fits and known[1] and not first and _tag(t.path) in BLOCKS_IN_TEXT:  # a constant text block between others
            above = tokens[t.above]
            fits = t.inside or (use[t.above] and bool(above.blocks))
        use.append(not t.skip and not against[-1] and not weak[-1] and fits)
    article = any(t.inside and u and t.blocks for t, u in zip(tokens, use))
    if article:
        return "\n".join(x for at, x in blocks if use[at] and tokens[at].inside)
    plain = [(at, x) for at, x in blocks if use[at]]
    dense = {i for i, t in enumerate(tokens) if 2 * t.link_chars > sum(map(len, t.blocks)) and _tag(t.path) not in LINKED_TEXT}
    return "\n".join(x for at, x in plain if at not in dense)


def _tag(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def extracted(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` with ``text``, the page's main text, blocks joined by line feeds.

    Null and empty html give an empty text. Pages without a host share one template. Repeated rows
    give equal texts. Whole pages are read, whatever their length. A column ``text`` is replaced; other columns
    stay. No rows: no rows.
    """
    pages = pages.drop("text")
    held = templates(pages.select("page_id", "url", "html"))
    template = "_" + max([*pages.columns, "template"], key=len)
    joined = _by_host(pages, held, F.struct("path", "extract", "constant"), template)
    names = pages.columns
    at = names.index("html")
    schema = pages.select("*", F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(len(names))
            texts = [main_text(h.as_py(), {x["path"]: (x["extract"], x["constant"]) for x in o.as_py() or ()}) for h, o in zip(b.column(at), own)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, "text"])

    return joined.mapInArrow(run, schema)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page; n_chars counts code points."""
    found = extracted(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
