"""Operator 4, HTML extraction: page structure, and repeated substrings of a host's token streams.

The token streams of a host's pages are one sequence, whose suffixes are named
by their first tokens, as in the doubling rounds of a suffix array. Suffixes of
one name on distinct pages mark a repeated substring; any longer one is the
union of those. Outside articles all suffixes are named by RUN tokens, and any
repetition is boilerplate. Inside them those at the starts of blocks are named
by their block, and a block is boilerplate if it stands on over half of the
host's pages, which otherwise differ. Covered tokens go, the unique runs stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_below, cut, text_key, text_or_empty
from .url_filter import host_and_path

#: Tokens that a repeated substring has at least; a shorter block counts as a whole.
RUN = 8
#: Distinct pages, and share of the host's, that a block of an article stands on more often if it is boilerplate.
PAGES, SHARE = 4, 0.5

#: Fixed names of HTML.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "textarea", "title", "select", "option"}
DROPPED = RAW | {"head", "nav", "footer", "aside", "form", "button", "dialog", "menu", "input", "label", "fieldset"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
#: Whole names of a class, id or role that name a part outside the article.
HINTS = re.compile(
    r"(?i)(?<!\S)(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|gdpr|notices?|sidebar|widget|comments?|disqus|replies|respond|menu|nav|navbar|navigation|breadcrumbs?"
    r"|footer|site-header|page-header|masthead|topbar|toolbar|share|sharing|social|related|recommended|newsletter|subscribe|signup|popup|modal|overlay|pagination|contentinfo|complementary|search"
    r"|(?:cookie|consent|gdpr|ad|advert|promo)[_-](?:banner|bar|notice|box|slot|unit|container|wrapper)|(?:site|page|main|top|primary)[_-](?:nav|menu|navigation|footer|sidebar)"
    r"|(?:cookies?|gdpr)[_-]consent|notices?[_-](?:box|bar|banner)|(?:comments?|comment)[_-](?:list|area|section|form)|(?:share|social|sharing)[_-](?:buttons?|links?|bar|icons?)|(?:related|recommended)[_-](?:posts?|articles?|links?|stories)|(?:newsletter|subscribe)[_-](?:form|signup|box)|search[_-](?:form|box|bar))(?!\S)"
)
#: Words of a class, id or role that name reader comments or adverts inside an article, unless a word beside them denies or counts them.
STEMS = re.compile(r"(?i)(?<![^\s_-])(?:comments?|commentlist|disqus|ads|adsbygoogle|advert\w*|sponsor(?:ed|s)?)(?![^\s_-])")
DENIED = re.compile(r"(?i)(?<![^\s_-])(?:no|not|non|has|have|with|without|hide|free)(?![^\s_-])")
#: A quote delimits a value only right after its equals sign.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?+)*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NONE = re.compile(r"(?i)display\s*:\s*none")
_NAMED = ("class", "id", "role")
#: Tags whose text in the middle of an article's sentence belongs to the sentence.
IN_SENTENCE = {"button", "label"}


def _attributes(text: str) -> dict[str, str]:
    """The attributes of a start tag, the first of each name."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_NONE.search(attributes.get("style", "")))


def _named(attributes: dict[str, str], inside: bool) -> bool:
    """Whether a class, id or role names a part that is no article; inside an article, comments and adverts go by words of their names."""
    names = [attributes[k] for k in _NAMED if k in attributes]
    return any(HINTS.search(x) for x in names) or (inside and any(STEMS.search(x) and not DENIED.search(x) for n in names for x in n.split()))


def blocks(html: str) -> tuple[list[tuple[str, bool, bool]], bool]:
    """([(text, inside the article, in a dropped part)], whether there is an article) in page order.

    Neither names nor tags drop an element around the page's only article, such as a
    form or a menu that is never closed: if all articles are in dropped parts, those
    parts stay where the articles in them have more text than the page outside of
    them. An article whose own name drops it counts as in such a part.
    """
    out, found, around = _blocks(html, frozenset())
    own = sum(len(text) for text, main, dropped in out if main and not dropped)
    if own or not around:
        return out, found
    more, found, _ = _blocks(html, frozenset(around))
    inside = sum(len(text) for text, main, dropped in more if main and not dropped)
    return (more, found) if inside > sum(len(text) for text, _, dropped in out if not dropped) else (out, False)


def _end_of(html: str, tag: str, at: int) -> int:
    """Where the element of that name ends whose start tag ends at `at`; `at` itself if it is never closed."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}\b[^>]*>", re.I).finditer(html, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return at


def _blocks(html: str, spared: frozenset[int]) -> tuple[list[tuple[str, bool, bool]], bool, set[int]]:
    """As blocks(), with the starts of elements that name or tag drop and that are or hold an article; `spared` ones are not dropped."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool, int | None]] = []  # tag, inside main, dropped, start if its name or tag drops it
    around: set[int] = set()
    inside = dropped = found = False
    buffer: list[str] = []
    in_sentence: list[str] = []
    at = 0

    def flush() -> None:
        text = " ".join(unescape("".join(buffer)).split())
        if text:
            out.append((text, inside, dropped))
        buffer.clear()
        in_sentence.clear()

    while m := _TAG.search(html, at):
        if m.start() > at:
            buffer.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            buffer.append(" ")
        if tag in INLINE:  # part of its block, whatever its name; only hidden ones go
            if not m[1] and tag not in VOID and m[3] and _hidden(_attributes(m[3])):
                at = _end_of(html, tag, at)
            continue
        if m[1] and tag in in_sentence:
            in_sentence.remove(tag)
            continue
        if not m[1] and tag in IN_SENTENCE and inside and not dropped and any(map(str.strip, buffer)) and not _hidden(_attributes(m[3])):
            in_sentence.append(tag)
            continue
        if m[1]:
            flush()
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is not None:
                inside, dropped = stack[k][1], stack[k][2]
                del stack[k:]
            continue
        attributes = _attributes(m[3])
        main = tag in MAIN or attributes.get("role", "").strip().lower() == "main" or "articleBody" in attributes.get("itemprop", "").split()
        shut = _hidden(attributes)
        flush()
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else (len(html) if tag in ("script", "style") else at)
            continue
        drops = tag in DROPPED or (tag == "header" and not inside) or (tag not in ("html", "body") and _named(attributes, inside))
        soft = drops and not shut and m.start() not in spared
        stack.append((tag, inside, dropped, m.start() if soft else None))
        if main and not shut and (dropped or soft):
            around.update(x[3] for x in stack if x[3] is not None)
        dropped = dropped or shut or soft
        inside = inside or (main and not dropped)
        found = found or inside
    buffer.append(html[at:])
    flush()
    return out, found, around


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Named suffixes: host, name, page, whether in the article, and the place where it matters: a token outside articles, a block inside."""
    for batch in batches:
        rows = []
        for html, host, k1, k2 in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "k1", "k2")), strict=True):
            found, article = blocks(html)
            seed, at = xxhash.xxh3_64_intdigest(host or ""), 0
            for n, (text, inside, dropped) in enumerate(found):
                if inside and not dropped:
                    rows.append((seed, xxhash.xxh3_64_intdigest(text, seed ^ 1), k1, k2, True, n))
                    continue
                tokens = text.split(" ")
                for i in range(max(1, len(tokens) - RUN + 1)):
                    rows.append((seed, xxhash.xxh3_64_intdigest(" ".join(tokens[i : i + RUN]), seed), k1, k2, False, None if article or dropped else at + i))
                at += 0 if dropped else len(tokens)
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        signed = [pa.array([x - 2**64 if x >= 2**63 else x for x in c], pa.int64()) for c in cols[:2]]
        yield pa.RecordBatch.from_arrays([*signed, pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.int32())], names=["host", "w", "k1", "k2", "inside", "place"])


def article_text(html: str, covered: list[int] | None) -> str:
    """The text of the article without covered blocks; without an article, the unique runs of what structure has not dropped.

    A page whose article is mostly covered is a copy of others and keeps all of it.
    """
    found, article = blocks(html)
    starts = set(covered or ())
    if article:
        own = [(n, text) for n, (text, inside, dropped) in enumerate(found) if inside and not dropped]
        left = [text for n, text in own if n not in starts]
        if 2 * sum(map(len, left)) < sum(len(text) for _, text in own):
            left = [text for _, text in own]
        return "\n\n".join(left)
    kept, at = [], 0
    for text, _, dropped in found:
        if dropped:
            continue
        tokens = text.split(" ")
        gone = set()
        for i in range(max(1, len(tokens) - RUN + 1)):
            if at + i in starts:
                gone.update(range(i, min(i + RUN, len(tokens))))
        at += len(tokens)
        left = [t for i, t in enumerate(tokens) if i not in gone]
        if left:
            kept.append(" ".join(left))
    return "\n\n".join(kept)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [article_text(h, c) for h, c in zip(batch.column("html").to_pylist(), batch.column("covered").to_pylist(), strict=True)]
        yield batch.drop_columns(["html", "covered"]).append_column("text", pa.array(texts, pa.string()))


def extract_text(pages: DataFrame, *, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Per page: page_id, url, text.

    The text is that of the page's article or main part, without the parts
    inside it that tags or names mark as menus, forms, adverts, comments and the
    like, and without its blocks that over PAGES pages and over SHARE of the
    host's pages have in their articles as well, if most of it is left then. A
    page without such a part gives its blocks outside marked parts, less
    the tokens covered by substrings of RUN tokens or more (or whole shorter
    blocks) that the host's other pages have outside their articles as well.
    Pages with equal html are one page there. Character references are decoded,
    white space in a block is one space, blocks are joined by two newlines.

    Null or empty html: empty text. A null URL belongs to the host without name.
    Repeated rows get equal texts. Pages of any length are whole. Empty tables
    give an empty result. Other columns don't matter, whatever their names.
    """
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text_or_empty(F.col(html)).alias("html"))
    k1, k2 = text_key(F.col("html"))
    p = p.withColumns({"k1": k1, "k2": k2, "host": host_and_path(F.col("url"))[0]})
    windows = cut(p.select("html", "host", "k1", "k2").mapInArrow(_windows, "host long, w long, k1 long, k2 long, inside boolean, place int"), "windows")
    outside = windows.where("not inside")
    repeated = outside.groupBy("w").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo < hi").select("w")
    hosts = windows.groupBy("host", "k1", "k2").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("pages"))
    often = windows.where("inside").groupBy("host", "w", "k1", "k2").agg(F.lit(1)).groupBy("host", "w").agg(F.count("*").alias("n")).where(F.col("n") > PAGES)
    often = often.join(hosts, "host").where(F.col("n") > SHARE * F.col("pages")).select("w")
    places = windows.where("place is not null").distinct()
    covered = None
    for inside, names in ((False, repeated), (True, often)):
        names = broadcast_below(cut(names, "names"), 1_000_000)
        part = places.where(F.col("inside") == inside).join(names, "w").select("k1", "k2", "place")
        covered = part if covered is None else covered.unionByName(part)
    covered = covered.groupBy("k1", "k2").agg(F.collect_set("place").alias("covered"))
    covered = broadcast_below(cut(covered, "covered"), 10_000)
    joined = p.join(covered, ["k1", "k2"], "left").select("page_id", "url", "html", "covered")
    kind = dict(joined.dtypes)
    return joined.mapInArrow(_texts, f"page_id {kind['page_id']}, url {kind['url']}, text string")
