"""Main text of web pages: tree scoring, by which paragraphs pass points for length and commas to their ancestors."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, map_arrow, unboxed

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks whose text gives points to the elements around them; other blocks with text of their own hold it themselves.
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
#: Never part of an article.
DROPPED = frozenset("head script style noscript template iframe object svg canvas nav footer aside form button select textarea input dialog menu title option audio video map".split())
#: An open element of the second kind ends where one of the first begins, unless an element of the third lies between.
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: Words in class, id and role that mark what is no article.
NOT_ARTICLE = frozenset("""ad ads advert adverts advertisement advertising adsbygoogle adsense adslot adunit sponsor sponsored sponsors promo promos promoted promotion
comment comments commentlist commentary respond replies reply disqus discussion sidebar sidebars aside rail widget widgets related recommended recommendation recommendations
nav navbar navigation menu menus menubar breadcrumb breadcrumbs toolbar pagination pager footer masthead topbar cookie cookies consent gdpr notice notices notification notifications
alert popup modal overlay newsletter subscribe subscription signup signin login register share sharing sharebar social search searchbox skip complementary contentinfo banner
dialog form hidden visuallyhidden copyright legal disclaimer paywall outbrain taboola tags trending""".split())
#: Of these, a word before them says that the page merely has, or lacks, such a part.
_HAS = frozenset("has no with without is not js".split())
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text) of a page: start, end or text. Comments, declarations and raw elements are left out.

    Each character is looked at a bounded number of times, however broken the page: a quote without an end counts as a letter from
    then on, and what has no end runs to the end of the page.
    """
    at, n, seen, dead = 0, len(page), 0, set()
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        after = page[at + 1 : at + 2]
        if after in ("!", "?") or page.startswith("</", at) and not page[at + 2 : at + 3].isalpha() and at + 2 < n:
            if seen < at:
                yield "text", "", page[seen:at]
            comment = page.startswith("<!--", at)
            end = page.find("-->" if comment else ">", at + 2)
            at = seen = n if end < 0 else end + (3 if comment else 1)
            continue
        closing = after == "/"
        name = _NAME.match(page, at + 1 + closing)
        if not name:
            at += 1
            continue
        if seen < at:
            yield "text", "", page[seen:at]
        end = name.end()
        while True:
            close = page.find(">", end)
            if close < 0:
                close = n
                break
            quotes = [q for q in (page.find(c, end, close) for c in "\"'" if c not in dead) if q >= 0]
            if not quotes:
                break
            first = min(quotes)
            if page[:first].rstrip()[-1:] != "=" if first - end < 1 else page[max(end, first - 8) : first].rstrip()[-1:] != "=":
                end = first + 1
                continue
            mate = page.find(page[first], first + 1)
            if mate < 0:
                dead.add(page[first])
                end = first + 1
            else:
                end = mate + 1
        tag = name.group().lower()
        yield ("end" if closing else "start"), tag, page[name.end() : close]
        at = seen = min(n, close + 1)
        if not closing and tag in RAW and not page[name.end() : close].endswith("/"):
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = seen = stop.start() if stop else n
    if seen < n:
        yield "text", "", page[seen:]


def _marks(attributes: str) -> tuple[bool, bool]:
    """Whether an element's attributes hide it or name it as no part of an article, and whether they name an article's body."""
    found = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(attributes)}
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if hidden or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"):
        return True, False
    for word in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [p.lower() for p in _PART.findall(word)]
        if any(p in NOT_ARTICLE and (i == 0 or parts[i - 1] not in _HAS) for i, p in enumerate(parts)):
            return True, False
    return False, role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"


class Tree:
    """The elements of a page in page order, each after its parent, and the pieces of text in them."""

    def __init__(self, page: str):
        self.tag, self.parent, self.block, self.junk, self.body = ["#"], [-1], [0], [False], [False]
        self.pieces: list[tuple[int, int, bool, str]] = []  # element, number of its block run, inside a link, text
        self.run = 0
        stack, opened, links = [0], {"#": 1}, 0

        def pop() -> None:
            nonlocal links
            t = self.tag[stack.pop()]
            opened[t] -= 1
            links -= t == "a"
            self.run += t in BLOCKS

        for kind, tag, text in tokens(page):
            if kind == "text":
                self.pieces.append((stack[-1], self.run, links > 0, html.unescape(text)))
            elif kind == "start":
                if tag == "br":
                    self.pieces.append((stack[-1], self.run, False, " "))
                    continue
                if tag in BLOCKS and opened.get("p"):  # a paragraph ends where any block begins
                    while self.tag[stack[-1]] != "p" and self.tag[stack[-1]] not in BLOCKS:
                        pop()
                    if self.tag[stack[-1]] == "p":
                        pop()
                if tag == "a" and links:
                    self._end("a", stack, opened, pop)
                if tag in CLOSES:
                    ends, between = CLOSES[tag]
                    if any(opened.get(e) for e in ends):
                        k = len(stack) - 1
                        while k > 0 and self.tag[stack[k]] not in ends and self.tag[stack[k]] not in between:
                            k -= 1
                        if self.tag[stack[k]] in ends:
                            while len(stack) > k:
                                pop()
                above = stack[-1]
                junk, body = _marks(text) if "=" in text or "hidden" in text else (False, False)
                self.tag.append(tag)
                self.parent.append(above)
                self.block.append(len(self.tag) - 1 if tag in BLOCKS else self.block[above])
                self.junk.append(tag in DROPPED or junk and tag not in ("html", "body", "main"))
                self.body.append(body or tag in ("article", "main"))
                self.run += tag in BLOCKS
                if tag not in VOID and not text.endswith("/"):
                    stack.append(len(self.tag) - 1)
                    opened[tag] = opened.get(tag, 0) + 1
                    links += tag == "a"
            else:
                self._end(tag, stack, opened, pop)

    def _end(self, tag: str, stack: list[int], opened: dict[str, int], pop) -> None:
        if opened.get(tag):
            while self.tag[stack[-1]] != tag:
                pop()
            pop()

    def spread(self, marks: list[bool]) -> list[bool]:
        """Marks, passed on to everything inside."""
        out = list(marks)
        for i in range(1, len(out)):
            out[i] |= out[self.parent[i]]
        return out


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, white space inside each as one space, joined by newlines.

    Left out are elements that never belong to an article, hidden ones, and those whose class, id or role says so (unless an element
    that has a main heading or an article inside is so named). A block of text gives one point, one a comma and one a hundred characters
    up to three, less its share of links, to its container, half to the next, a third and so on to the fifth; a container's points are
    lowered by its share of links. The best container (the first of equals), or the article or main element around it, is kept whole, with
    those siblings that have a fifth of its points or are paragraphs and headings. Lists and other containers in it that are mostly links go.
    Pages without points give all blocks outside of what is left out; empty, if none.
    """
    t = Tree(page or "")
    n = len(t.tag)
    inside = [False] * n  # has an article, a main element or a main heading that nothing marks
    for i in range(n - 1, 0, -1):
        if inside[i] or not t.junk[i] and t.tag[i] in ("article", "main", "h1"):
            if t.junk[i] and t.tag[i] not in DROPPED and t.tag[i] in ("div", "section", "table", "td", "tr", "tbody"):
                t.junk[i] = False
            inside[t.parent[i]] |= not t.junk[i]
    # A page's own header is none of the article; of a header inside an article the headings stay.
    framed = t.spread(t.body)
    header = t.spread([x == "header" for x in t.tag])
    heading = t.spread([x in HEADINGS for x in t.tag])
    out = t.spread(t.junk)
    for i in range(n):
        out[i] |= header[i] and not (framed[i] and heading[i])
    runs: dict[int, list] = {}
    for e, run, link, text in t.pieces:
        if not out[e]:
            r = runs.setdefault(run, [t.block[e], [], 0])
            r[1].append(text)
            r[2] += link * len("".join(text.split()))
    blocks = [(b, " ".join("".join(text).split()), links) for b, text, links in runs.values()]
    blocks = [(b, text, min(1.0, links / max(1, len(text) - text.count(" ")))) for b, text, links in blocks if text]
    points, chars, linked, links = [0.0] * n, [0] * n, [0.0] * n, [0] * n
    for b, text, share in blocks:
        chars[b] += len(text)
        linked[b] += share * len(text)
        if t.tag[b] not in HEADINGS:
            at, part = (t.parent[b] if t.tag[b] in PARAGRAPHS else b), 1
            while at >= 0 and part <= 5:
                points[at] += (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - share) / part
                at, part = t.parent[at], part + 1
    for i in range(n - 1, 0, -1):
        links[i] += t.tag[i] == "a"
        for total in (chars, linked, links):
            total[t.parent[i]] += total[i]
    density = [linked[i] / chars[i] if chars[i] else 0.0 for i in range(n)]
    score = [points[i] * (1 - density[i]) for i in range(n)]
    best = max(range(n), key=lambda i: (score[i], -i))
    roots = {0}
    if score[best] > 0:
        at = best
        while at > 0 and not t.body[at]:
            at = t.parent[at]
        roots = {at} if at > 0 else {best}
        if at <= 0 and t.parent[best] >= 0:
            for i in range(best + 1 if t.parent[best] < 0 else t.parent[best] + 1, n):
                if t.parent[i] == t.parent[best] and (score[i] >= max(10.0, 0.2 * score[best]) or t.tag[i] in PARAGRAPHS | HEADINGS and density[i] < 0.5):
                    roots.add(i)
    kept = t.spread([i in roots for i in range(n)])
    menus = t.spread([i not in roots and t.tag[i] in BLOCKS and t.tag[i] not in PARAGRAPHS | HEADINGS and links[i] > 1 and density[i] > 0.6 for i in range(n)])
    return "\n".join(text for b, text, _ in blocks if kept[b] and not menus[b])


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["row", "text", "n_chars"])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text, the main text of the whole html, and n_chars, its code points. Each row is worked on by itself, so equal rows
    have equal results and no key can be hot. Null and empty html give an empty text; columns named text or n_chars are replaced."""
    d = boxed(pages, page=F.col(html_col))
    return unboxed(map_arrow(d, _work, f"row {d.schema['row'].dataType.simpleString()}, text string, n_chars long"), pages.columns, "text", "n_chars")


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


#: Holds for the layout of the given table only: one article element of headings and paragraphs.
OP13_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, unnest(regexp_split_to_array(regexp_replace(regexp_replace(body, '<br>', ' ', 'g'), '</?b>', '', 'g'), '</?(?:p|h1)>')) AS part, generate_subscripts(regexp_split_to_array(body, '</?(?:p|h1)>'), 1) AS k FROM a),
c AS (SELECT page_id, url, k, trim(regexp_replace(replace(replace(replace(replace(replace(part, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS part FROM b)
SELECT page_id, url, coalesce(string_agg(part, chr(10) ORDER BY k) FILTER (part <> ''), '') AS text, CAST(length(coalesce(string_agg(part, chr(10) ORDER BY k) FILTER (part <> ''), '')) AS BIGINT) AS n_chars
FROM c GROUP BY page_id, url
"""
