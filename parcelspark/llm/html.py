"""Main text of web pages: page structure and a suffix array over each host's pages.

A page is cut into blocks. Elements that never hold the article (scripts, navigation, footers, forms, adverts, comments
and the like, by name, role, class or id) go; blocks inside an article or main element are safe. What is left, the open
blocks, may or may not be boilerplate, and the host tells: the token streams of its pages are concatenated, and
substrings of at least `min_tokens` tokens that occur in two distinct pages, and in `SHARE` of the host's pages, are
repeated. An open block that they cover from end to end goes if the page has a text of its own to show for it, at least
half as long; all others stay whole. So a story under several addresses stays in each of them, however much the lines
around it differ, and pages with the same open text take nothing from each other.

The suffix array of a host is never built in one place, since a host may hold a third of all pages. Suffixes that agree
in their first `min_tokens` tokens are one interval of the array, and a repeated substring of any greater length is a
chain of such intervals; so each interval is one group of a hash aggregate, which counts distinct pages and combines on
the map side before anything is moved.

Repetition alone would also remove articles that two pages of a host share, which belong to both; therefore the
article's own blocks are outside the streams.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.session import stage

MIN_TOKENS = 8
SHARE = 0.3  # of the host's pages with open blocks that must hold a run
OWN = 2  # a repeated block goes from pages whose own text, times this, is as long

# Elements whose content is not markup: everything up to the closing tag is skipped.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "title", "textarea", "xmp", "annotation", "annotation-xml"}
HEAD = {"title", "base", "basefont", "link", "meta", "style", "script", "noscript", "template", "bgsound", "command", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"nav", "footer", "aside", "form", "head", "menu", "button", "select", "dialog", "label", "fieldset", "audio", "video"}
MAIN = {"article", "main"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr", "br", "img",
    "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mfrac", "msqrt", "mroot", "mstyle", "msub", "msup",
    "msubsup", "munder", "mover", "munderover", "mfenced", "mpadded", "mphantom", "mtable", "mtr", "mtd",
}
# Without attributes these decide nothing.
PLAIN = INLINE | {"p", "div", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "td", "tr", "blockquote", "pre"}
# An opening tag of the key ends an open element of the value, as browsers do.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
# Whole names in a class or id that mark an element as no part of the article: words, alone or with a part from a list.
MARKS = re.compile(
    r"(?:^|\s)(?:(?:(?:main|site|page|top|bottom|global|primary|secondary|left|right|mobile|sub)[_-]+)?"
    r"(?:nav(?:bar|igation)?|menus?|header|masthead|topbar|footer|side-?bar|aside|notices?|cookies?|consent|gdpr|banner|"
    r"ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promos?|promoted|promotion|popup|modal|newsletter|subscribe|signup|"
    r"login|comments?|commentlist|disqus|replies|respond|discussion|shar(?:e|ing)|social|related|recommend(?:ed|ations?)?|"
    r"breadcrumbs?|pagination|pager|widgets?|toolbar|skip-link|copyright|legal|disclaimer)"
    r"|(?:post|article|entry|page|social|sticky|google)[_-]+(?:ads?|shar(?:e|ing)|comments?|related|newsletter|widgets?|nav(?:igation)?|pagination))"
    r"(?:[_-]+(?:wrap(?:per)?|container|box|bar|banner|block|section|list|area|links?|menu|unit|slot|nav|buttons?|icons?|"
    r"posts?|articles?|stories|form|notice|media|content|top|bottom|left|right|inner|[0-9]+))*(?=$|\s)",
    re.I,
)
# Marks of elements whose article elements are not the page's own.
FOREIGN = re.compile(r"comment|disqus|replies|respond|discussion|related|recommend|sponsor|promo|(?:^|[\s_-])ad(?:s|vert|$|[_-])", re.I)
HEADINGS = {"header", "h1", "h2", "h3", "h4", "h5", "h6"}
MAIN_MARKS = re.compile(r"(?:^|\s)(?:article|main|content|main-content|article-body|post-content|entry-content|article-content)(?:$|\s)", re.I)

# A quote opens a value only after an equals sign.
PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)  # as a name, values being taken out
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)

SAFE, OPEN = 1, 0
KEPT, AROUND, FAR = 0, 1, 2


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if "=" in text else {}


def hidden(attrs: dict[str, str], raw: str) -> bool:
    if attrs.get("aria-hidden", "").lower() == "true" or NOT_SHOWN.search(attrs.get("style", "")):
        return True
    return "hidden" in raw.lower() and bool(HIDDEN.search(QUOTED.sub("=''", raw)))


def unwanted(tag: str, attrs: dict[str, str], raw: str, inside_main: bool, forms: bool) -> int:
    """KEPT, or FAR from the article for certain, or AROUND: unwanted unless the page's only article is inside."""
    if attrs.get("role", "").lower() in ROLES or (raw and hidden(attrs, raw)):
        return FAR
    if tag == "form" and forms:
        return AROUND
    if (tag in DROPPED and tag != "form") or (tag == "header" and not inside_main):
        return FAR
    if tag in ("body", "html") or (inside_main and tag in HEADINGS) or (tag in MAIN and not inside_main):
        return KEPT
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    mark = MARKS.search(names)
    if not mark:
        return KEPT
    if FOREIGN.search(mark[0]):
        return FAR
    # "content sidebar-right" is a layout: what holds the content is not the sidebar.
    return KEPT if MAIN_MARKS.search(names) else AROUND


def blocks(page: str) -> list[tuple[int, str]]:
    """(SAFE or OPEN, text) of the blocks that structure does not exclude, in page order.

    An article or main element inside a form or a marked element counts if the page has no other; a form around all
    text of a page counts as no form.
    """
    out, wrapped = _blocks(page)
    if wrapped and not any(kind == SAFE for kind, _ in out):
        out, _ = _blocks(page, rescue=True)
    if not out and "<form" in page.lower():
        out, _ = _blocks(page, forms=False)
    return out


def _blocks(page: str, rescue: bool = False, forms: bool = True) -> tuple[list[tuple[int, str]], bool]:
    """The blocks, and whether an article or main element stands in elements that are AROUND only.

    One pass over the tags. Unclosed elements end with their parent, stray closing tags are ignored, a page cut off
    anywhere keeps what was read.
    """
    out: list[tuple[int, str]] = []
    # Open elements with: name, change of `dropped`, whether it is inside the article, whether it is FAR.
    stack: list[tuple[str, int, bool, bool]] = []
    dropped = inside = far = 0
    wrapped = False
    count: Counter[str] = Counter()
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = "".join(text)
            text.clear()
            joined = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
            if joined:
                out.append((SAFE if inside else OPEN, joined))

    def close(depth: int) -> None:
        nonlocal dropped, inside, far
        while len(stack) > depth:
            name, bad, main, off = stack.pop()
            count[name] -= 1
            dropped -= bad
            inside -= main
            far -= off

    at, end = 0, len(page)
    while at < end:
        m = PIECE.search(page, at)
        start = m.start() if m else end
        if start > at:
            if count["head"] and stack[-1][0] == "head" and not page[at:start].isspace():
                close(len(stack) - 1)  # text cannot stand in a head
            if not dropped:
                text.append(page[at:start])
        if not m:
            break
        at = m.end()
        if m[2] is None:  # comment or declaration
            continue
        tag, closing, raw = m[2].lower(), bool(m[1]), m[3]
        if tag in RAW:
            if not closing and not raw.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if count["head"] and not closing and tag not in HEAD and tag != "head":
            # The end tag of a head may be left out: the first element that cannot stand in it ends it.
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "head":
                    flush()
                    close(depth)
                    break
        if tag not in INLINE:
            flush()
        elif tag == "br" and not dropped:
            text.append(" ")
        if tag in VOID:
            continue
        if closing:
            if not count[tag]:
                continue
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if any(s[1] or s[2] for s in stack[depth:]):
                        flush()
                    close(depth)
                    break
            continue
        if tag not in INLINE:
            # A paragraph cannot hold blocks: a new block ends it, with the inline elements left open inside.
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p" or stack[depth][0] in CLOSES.get(tag, ()):
                    close(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        if not raw and tag in PLAIN:
            stack.append((tag, 0, False, False))
            count[tag] += 1
            continue
        attrs = attributes(raw)
        verdict = unwanted(tag, attrs, raw, inside > 0, forms)
        main = not verdict and (tag in MAIN or attrs.get("role") in ("main", "article") or (
            tag in ("div", "section") and bool(MAIN_MARKS.search(f"{attrs.get('class', '')} {attrs.get('id', '')}"))))
        bad = int(verdict != KEPT)
        if main and dropped and not far:
            wrapped = True
            bad = -dropped if rescue else 0
        if bad or main:
            flush()
        stack.append((tag, bad, main, verdict == FAR))
        count[tag] += 1
        dropped += bad
        inside += main
        far += verdict == FAR
    flush()
    return out, wrapped


BLOCKS = "array<struct<safe:boolean,text:string>>"


def block_column(page: Column) -> Column:
    @F.pandas_udf(BLOCKS)
    def cut(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: [{"safe": bool(s), "text": t} for s, t in blocks(p)] if p else [])

    return cut(F.coalesce(page.cast("string"), F.lit("")))


def host(url: Column) -> Column:
    """The host of a URL in lower case; null without one."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def extract(pages: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """page_id, url, text of every page row; the blocks of the main text joined by one newline.

    Null and empty pages, and pages of boilerplate alone, give an empty text. Pages without a host share the stream of
    the null host with nobody: each of them stands alone. Rows repeated with one page_id count as one page of the host,
    so they take nothing from each other. Extra columns are left out; an empty table gives no rows.
    """
    cut = pages.select(
        F.col("page_id"),
        F.col("url").cast("string").alias("url"),
        F.monotonically_increasing_id().alias("row_id"),
        block_column(F.col("html")).alias("blocks"),
    )
    cut = stage(cut.withColumn("open", F.exists("blocks", lambda b: ~b["safe"])), "page-blocks")
    safe = cut.where(~F.col("open")).select(
        "page_id", "url", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").alias("text")
    )
    streams = cut.where(F.col("open") & host(F.col("url")).isNotNull()).select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"),
        host(F.col("url")).alias("host"),
        "row_id",
        "blocks",
    )
    suffixes = streams.mapInPandas(
        _suffixes(min_tokens), "host string, page string, content long, row_id long, start int, head long"
    )

    # Intervals of the suffix array that hold two pages of different text, and enough of the host's.
    pages_in = F.least(F.count_distinct("page"), F.count_distinct("content"))
    hosts = suffixes.where("start = 0").groupBy("host").agg(pages_in.alias("of"))
    shared = suffixes.groupBy("host", "head").agg(pages_in.alias("n")).where("n > 1")
    shared = shared.join(hosts, "host").where(F.col("n") >= SHARE * F.col("of")).select("host", "head", "n")
    repeated = suffixes.join(shared, ["host", "head"])
    repeated = repeated.groupBy("row_id").agg(F.collect_list(F.struct("start", "n")).alias("starts"))

    found = cut.where("open").join(repeated, "row_id", "left")

    @F.pandas_udf("string")
    def assemble(kept: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([_assemble(b, s, min_tokens) for b, s in zip(kept, starts)], dtype=object)

    return safe.unionByName(found.select("page_id", "url", assemble("blocks", "starts").alias("text")))


def _tokens(found: list[dict]) -> list[list[str]]:
    """Token streams of the open blocks: each block's words, and a mark that no word equals at its end."""
    return [b["text"].split(" ") for b in found if not b["safe"]]


def _suffixes(min_tokens: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hosts, page_ids, contents, rows, starts, heads = [], [], [], [], [], []
            for r in pdf.itertuples(index=False):
                stream = [t for block in _tokens(r.blocks) for t in block]
                content = xxhash.xxh3_64_intdigest(" ".join(stream))
                # A page with fewer tokens than the minimum is one suffix of its own length.
                for i in range(max(1, len(stream) - min_tokens + 1)):
                    head = " ".join(stream[i : i + min_tokens])
                    hosts.append(r.host)
                    page_ids.append(r.page)
                    contents.append(content)
                    rows.append(r.row_id)
                    starts.append(i)
                    heads.append(xxhash.xxh3_64_intdigest(head))
            yield pd.DataFrame(
                {
                    "host": hosts, "page": page_ids,
                    "content": np.array(contents, dtype=np.uint64).astype(np.int64), "row_id": rows, "start": starts,
                    "head": np.array(heads, dtype=np.uint64).astype(np.int64),
                }
            )

    return run


def _assemble(found: list[dict], starts: list[dict] | None, min_tokens: int) -> str:
    streams = _tokens(found)
    shared = np.zeros(sum(map(len, streams)) + min_tokens, dtype=np.int64)  # pages that share each token's run
    for s in starts if starts is not None else ():
        run = shared[s["start"] : s["start"] + min_tokens]
        np.maximum(run, s["n"], out=run)
    sizes = [len(stream) for stream in streams]
    ends = np.cumsum(sizes)
    repeated = [shared[end - size : end].min() > 1 for size, end in zip(sizes, ends, strict=True)]
    # What the page has for itself: its article, and the open blocks that are not repeated.
    own = sum(len(b["text"].split(" ")) for b in found if b["safe"])
    own += sum(size for size, again in zip(sizes, repeated, strict=True) if not again)
    out, open_blocks = [], iter(zip(sizes, repeated, strict=True))
    for b in found:
        if not b["safe"]:
            size, again = next(open_blocks)
            if again and size <= OWN * own:
                continue
        out.append(b["text"])
    return "\n".join(out)
