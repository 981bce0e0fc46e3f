"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page becomes a sequence of text pieces and tags. A text piece scores its number of words, a tag its (negative) weight,
and one linear scan finds the contiguous run of the largest sum: the content region. Weights come from labelled pages. For every tag
(opening and closing apart, and again with each word of its class and id) the pages tell how often it stands inside
the content and how often elsewhere: a tag seen only outside costs as many words as it was seen, one that is common inside costs
next to nothing. Tags for running text never cost more than ``FLOW_COST``, so that lists or tables that no labelled page had do not
split an article.

Elements that are no article text wherever they stand (menus, forms, asides, adverts, reader comments ...) are left out before
the scan, as are comments, scripts, styles and the head. Such an element stays if it holds the page's article (the longest article or main
element) or, on a page without one, if it is marked by its class, id or role (or is a form) and holds most of the words: what it holds is looked
through in turn, and its own tag costs ``MARKED_COST`` words in the scan unless the labelled pages tell its weight. Character references are decoded, white space inside a block becomes one space, blocks are
joined by an empty line. Null and empty pages, and pages without words, give an empty text. Unclosed tags are tolerated: an element to leave out that
never closes loses only its tag. Rows are handled one by one, so repeated rows repeat; other columns pass through untouched.
"""

from __future__ import annotations

import functools
import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: tags of running text, tags inside a block, elements whose content is no page text.
FLOW = frozenset("p li ul ol dl dt dd b i u s a em strong span small sub sup code pre kbd samp var abbr cite q mark font time br wbr hr img figure figcaption picture source video audio blockquote table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 ins del dfn bdi bdo ruby rt rp details summary address center tt big strike".split())
INLINE = frozenset("b i u s a em strong span small sub sup code kbd samp var abbr cite q mark font time img wbr ins del dfn bdi bdo ruby rt rp tt big strike label picture source".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|select|button|object|canvas"
#: Elements and words of class, id or role that mark what is no article text.
LEFT_OUT = frozenset("head nav aside form footer dialog menu".split())
LEFT_OUT_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice notices popup modal newsletter subscribe signup login comment comments disqus replies reply share sharing social related recommended widget toolbar pagination pager contentinfo complementary search".split())
MAIN = frozenset("article main".split())
MAIN_WORDS = frozenset("articlebody main".split())
FLOW_COST, LEAST_COST, MARKED_COST = 3.0, 0.01, 20.0
#: Labelled pages counted at most (those of the smallest hash), and pages a tag must be on for a weight of its own.
LABELLED_PAGES, LEAST_PAGES = 2_000, 3

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?([a-zA-Z][a-zA-Z0-9:-]*))")
_RAW = frozenset(RAW.split("|"))
_ENDING = re.compile("[\"'>]")
_NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Endings:
    """Where tags end: at the first ``>`` outside quotes. Worked out once per page from its end, so that tags that never end cost nothing more."""

    def __init__(self, page: str):
        self.places, kinds = [], []
        for m in _ENDING.finditer(page):
            self.places.append(m.start())
            kinds.append(m[0])
        # per quote or bracket, the end of a tag that reaches it outside quotes
        self.ends, quote = [-1] * (len(kinds) + 1), {'"': -1, "'": -1}
        for k in range(len(kinds) - 1, -1, -1):
            if kinds[k] == ">":
                self.ends[k] = self.places[k]
            else:
                partner = quote[kinds[k]]
                self.ends[k] = self.ends[partner + 1] if partner >= 0 else -1
                quote[kinds[k]] = k

    def of(self, at: int) -> int:
        """The closing bracket of a tag whose name ends at ``at``; -1 if there is none."""
        return self.ends[bisect_left(self.places, at)]


def tokens(page: str) -> list[tuple]:
    """("text", raw text), ("tag", name, closing?, words of class and id) and ("gap",) for what holds no text, in page order.

    One pass forward: a bracket that opens nothing is text, and nothing behind it is looked at twice, so malformed pages take time in proportion to
    their length too. A comment, or an element of raw content, that never closes reaches to the end of the page.
    """
    out, at, seek, endings = [], 0, 0, None
    absent: set[str] = set()  # closing strings that do not occur any more

    def found(what: str, start: int) -> int:
        if what in absent:
            return -1
        k = page.find(what, start)
        if k < 0:
            absent.add(what)
        return k

    def text(until: int) -> None:
        if until > at:
            out.append(("text", page[at:until]))

    while m := _OPEN.search(page, seek):
        here, name = m.start(), (m[1] or "").lower()
        if not name:
            if m[0] == "<!--":
                end = found("-->", m.end())
                end = len(page) if end < 0 else end + 3
            else:
                end = found("]]>", m.end()) + 3 if m[0] == "<![CDATA[" else 2
                if end == 2:
                    end = found(">", here + 2) + 1
            if end <= 0:
                seek = m.end()
                continue
            text(here)
            at = seek = end
            continue
        opens = m[0][1] != "/"
        if opens and name in _RAW:
            close = found(">", m.end())
            if close >= 0:
                text(here)
                out.append(("gap",))
                end = raw_end(page, name, close + 1, absent)
                at = seek = end
                continue
        endings = endings or Endings(page)
        close = endings.of(m.end())
        if close < 0:
            seek = m.end()
            continue
        text(here)
        rest = page[m.end() : close]
        named = _NAMED.findall(rest) if "=" in rest else ()
        out.append(("tag", name, not opens, frozenset(w for n in named for w in re.split(r"[^a-z0-9]+", "".join(n).lower()) if w)))
        at = seek = close + 1
    text(len(page))
    return out


@functools.cache
def _raw_close(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def raw_end(page: str, name: str, start: int, absent: set[str]) -> int:
    """Behind the closing tag of an element of raw content; the page's end if it has none."""
    m = None if "</" + name in absent else _raw_close(name).search(page, start)
    if m is None:
        absent.add("</" + name)
        return len(page)
    return m.end()


def closings(tokens_: list[tuple]) -> dict[int, int]:
    """Place of the closing tag per place of an opening one; without those that never close."""
    open_, out = {}, {}
    for k, t in enumerate(tokens_):
        if t[0] == "tag":
            places = open_.setdefault(t[1], [])
            if not t[2]:
                places.append(k)
            elif places:
                out[places.pop()] = k
    return out


def marked(t: tuple) -> bool:
    """Whether a tag's class, id or role says that it is no article text."""
    return bool(t[3] & LEFT_OUT_WORDS) and not t[3] & MAIN_WORDS and t[1] not in MAIN | {"html", "body"}


def article_tokens(page: str) -> list[tuple]:
    """Tokens without the elements that are left out unless they hold the article; a site header counts unless it stands in an article."""
    all_, out, k, inside = tokens(page), [], 0, 0
    ends = closings(all_)
    words = [0]
    for t in all_:
        words.append(words[-1] + (len(t[1].split()) if t[0] == "text" else 0))
    mains = [k for k, t in enumerate(all_) if t[0] == "tag" and not t[2] and (t[1] == "main" or ((t[1] in MAIN or t[3] & MAIN_WORDS) and not t[3] & LEFT_OUT_WORDS))]
    # the longest, the innermost of equals
    chief = max(mains, key=lambda k: (words[ends.get(k, len(all_))] - words[k], k), default=None)
    while k < len(all_):
        t = all_[k]
        if t[0] == "tag":
            if t[1] in MAIN:
                inside += -1 if t[2] else 1
            by_words = marked(t)
            # an element that never closes loses nothing
            if not t[2] and k in ends and (t[1] in LEFT_OUT or by_words or (t[1] == "header" and inside <= 0)):
                end = ends[k]
                most = chief is None and (by_words or t[1] == "form") and t[1] not in LEFT_OUT - {"form"} and 2 * (words[end] - words[k]) > words[-1]
                if not (most or (chief is not None and k <= chief < end)):
                    out.append(("gap",))
                    k = end + 1
                    continue
        out.append(t)
        k += 1
    return out


def features(t: tuple) -> list[str]:
    side = "/" if t[2] else ""
    return [side + t[1], *[f"{t[1]}.{w}" for w in sorted(t[3])]]


def counted(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per tag: how often inside and outside the element that a labelled page names as its main one."""
    within, without, seen = Counter(), Counter(), Counter()
    for batch in pages:
        for page in batch["html"]:
            ts = article_tokens(page)
            main = next((k for k, t in enumerate(ts) if t[0] == "tag" and not t[2] and (t[1] in MAIN or t[3] & MAIN_WORDS)), None)
            if main is None:
                continue
            end, on_page = closings(ts).get(main, len(ts)), set()
            for k, t in enumerate(ts):
                if t[0] == "tag":
                    for f in features(t):
                        (within if main < k < end else without)[f] += 1
                        on_page.add(f)
            seen.update(on_page)
    yield pd.DataFrame([{"tag": f, "inside": within[f], "outside": without[f], "pages": n} for f, n in seen.items()], columns=["tag", "inside", "outside", "pages"])


def fit(pages: DataFrame, key: str = "page_id", html_column: str = "html", most: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from the labelled pages: those that mark their main element themselves."""
    labelled = pages.filter(F.col(html_column).rlike(r"(?i)<article\b|<main\b|articlebody|role=.?main")).select(F.col(html_column).alias("html"), F.xxhash64(key, html_column).alias("h"))
    # hashes alone are sorted; the pages of the smallest follow in a second step
    last = labelled.select("h").orderBy("h").limit(most).agg(F.max("h").alias("h")).first().h
    sample = labelled.filter(F.col("h") <= F.lit(last)).select("html")
    got = sample.mapInPandas(counted, "tag string, inside long, outside long, pages long").groupBy("tag").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"), F.sum("pages").alias("pages"))
    rows = got.filter(F.col("pages") >= LEAST_PAGES).orderBy(F.desc("pages"), "tag").limit(2_000).collect()
    return {r.tag: -max(LEAST_COST, (r.outside + 1) / (r.inside + 1)) for r in rows}


def cost(t: tuple, weights: dict[str, float]) -> float:
    """A tag's weight: the least of its features', bounded for tags of running text; unknown tags cost one word, unknown structure three,
    unknown openings marked as no article text ``MARKED_COST``."""
    if not t[2] and marked(t) and not any(f"{t[1]}.{w}" in weights for w in t[3] & LEFT_OUT_WORDS):
        return -MARKED_COST
    known = [weights[f] for f in features(t) if f in weights]
    w = min(known) if known else (-1.0 if t[1] in FLOW else -FLOW_COST)
    return max(w, -FLOW_COST) if t[1] in FLOW and not t[3] else w


def region(ts: list[tuple], weights: dict[str, float]) -> tuple[int, int]:
    """Bounds of the run of the largest sum, by one scan; the earliest of equals."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for k, t in enumerate(ts):
        if total <= 0:
            total, start = 0.0, k
        total += len(t[1].split()) if t[0] == "text" else cost(t, weights) if t[0] == "tag" else -1.0
        if total > best:
            best, bounds = total, (start, k + 1)
    return bounds


def blocks(ts: list[tuple]) -> str:
    """Text of a region: references decoded, one space for white space, blocks joined by an empty line."""
    out, held = [], []

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append(text)
        held.clear()

    for t in ts:
        if t[0] == "text":
            held.append(t[1])
        elif t[0] == "tag" and t[1] in ("br", "hr"):
            held.append(" ")
        elif t[0] == "gap" or t[1] not in INLINE:
            close()
    close()
    return "\n\n".join(out)


def extract(page: str | None, weights: dict[str, float]) -> str:
    ts = article_tokens(page or "")
    first, last = region(ts, weights)
    return blocks(ts[first:last])


def main_text(page: Column, weights: dict[str, float]) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(p, weights) for p in pages], dtype=object)

    return run(page)
