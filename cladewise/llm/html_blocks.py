"""Main text of web pages by rules over blocks, in two passes.

A page is cut into blocks at its block-level tags. The first pass looks at each
block by itself: how long it is, which share of it is link text, and which share
of its words are stop words. It calls blocks good, bad, near (a fair share of
stop words in few words) or short. In the second pass each run of short blocks,
and then each near one, takes the label of its nearest decided neighbours.

Where a page says what a part is, that counts: blocks within navigation,
footers, asides, forms, adverts, notices or comments are bad, and the bounds of
an article are good neighbours. Within an article a block of few stop words is
undecided, not bad, since not every language's stop words are known.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.common import table

MOST_LINKS, FEW_STOPS, MANY_STOPS, SHORT, LONG = 0.2, 0.30, 0.32, 70, 200
_OUTPUT_BYTES = 8 << 20

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could do for from had has have he her his how i if in into is it its
    just like more most my no not now of on one only or other our out over she so some such than that the their them then there these they this to up
    was we were what when which who will with would you your
    au aux avec ce ces cette dans de des du elle elles en est et eux il ils je la le les leur lui ma mais me mes ne nous ou par pas pour qu que qui sa
    se ses son sont sur te tu un une vous
    aber als am auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer er es für hat ich ihr ihre im ist ja kann
    man mein mit nach nicht noch nur oder sein seine sich sie sind so über um und uns unter von vor war was wenn werden wie wir wird zu zum zur
    al como con cuando del desde donde el ella ellos entre era es esta este están fue ha hay la las lo los más mi muy no nos o para pero por porque que
    quien se ser si sin sobre son su sus también tiene todo un una uno y ya""".split()
)
# Elements by what they are.
_BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
_SKIPPED = frozenset("script style noscript template textarea title iframe object svg math canvas audio video noembed noframes xmp".split())
_BAD_TAGS = frozenset("nav footer aside form menu select button dialog search fieldset head".split())
_GOOD_TAGS = frozenset(("article", "main"))
_BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_GOOD_ROLES = frozenset(("article", "main"))
# Words of class and id names.
_BAD_NAMES = frozenset(
    """ad ads advert advertisement adverts adsense advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright
    disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination
    popup popups privacy promo promotion recommended recommendations related reply replies respond search share sharing sidebar signin signup skip social
    sponsor sponsored sponsors subscribe subscription tags toolbar tracking widget widgets""".split()
)
_GOOD_NAMES = frozenset("article articlebody content entry main post story".split())
_HEADER = "header"

_REST = r"""(?:[^"'>]+|"[^"]*"|'[^']*'|["'])*?"""
_TOKEN = re.compile(
    rf"""<(?P<raw>{"|".join(sorted(_SKIPPED, key=len, reverse=True))})(?=[\s/>]){_REST}(?:(?<=/)>|>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z))|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>{_REST})(?:>|\Z)"""
    r"""|<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()) + "\xab\xbb\xbf\xa1\u2018\u2019\u201c\u201d\u201e\u2026\u2013\u2014"
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class _Place:
    """An open element: whether its text is out of question, and whether it lies in an article."""

    __slots__ = ("name", "bad", "article")

    def __init__(self, name: str, bad: bool, article: bool):
        self.name, self.bad, self.article = name, bad, article


def _judge(name: str, rest: str, bad: bool, article: bool) -> tuple[bool, bool]:
    """What an element adds: whether it is bad, whether it is or opens an article."""
    if not rest:
        return bad or name in _BAD_TAGS or name == _HEADER and not article, article or name in _GOOD_TAGS
    attributes = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(rest)}
    names = {p.lower() for key in ("class", "id") for p in _NAME_PART.findall(attributes.get(key, ""))} if name not in ("html", "body") else set()
    role = attributes.get("role", "").lower()
    good = name in _GOOD_TAGS or role in _GOOD_ROLES or bool(names & _GOOD_NAMES)
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(attributes.get("style", "").lower()))
    head = (name == _HEADER or _HEADER in names) and not (article or good)
    return bad or head or hidden or name in _BAD_TAGS or role in _BAD_ROLES or bool(names & _BAD_NAMES), article or good


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """``(text, link characters, bad, in an article)`` of a page's blocks in order; those without text are left out."""
    out: list[tuple[str, int, bool, bool]] = []
    stack = [_Place("", False, False)]
    parts: list[str] = []
    links, in_link, at = 0, False, 0
    count: dict[str, int] = {}  # open elements by name

    def flush() -> None:
        nonlocal links
        text = "".join(parts)
        if not text.isspace():
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append((text, min(links, len(text)), stack[-1].bad, stack[-1].article))
        parts.clear()
        links = 0

    for met in _TOKEN.finditer(page):
        if met.start() > at:
            piece = page[at : met.start()]
            parts.append(piece)
            if in_link:
                links += len(" ".join(html.unescape(piece).split()))
        at = met.end()
        raw, end, name, rest = met.group("raw", "end", "name", "rest")
        if name is None:
            if raw is not None:
                parts.append(" ")
            continue
        name = name.lower()
        if name in _BLOCKS:
            if parts:
                flush()
            in_link = False
            if end:
                if count.get(name):
                    _pop(stack, count, (name,))
            elif name not in _VOID:
                _close(stack, count, name)
                here = stack[-1]
                stack.append(_Place(name, *_judge(name, rest, here.bad, here.article)))
                count[name] = count.get(name, 0) + 1
        elif name == "a":
            in_link = not end
        elif name == "br":
            parts.append(" ")
        elif end:
            if stack[-1].name == name and len(stack) > 1:
                flush()
                _pop(stack, count, (name,))
        elif rest and name not in _VOID and _judge(name, rest, False, True)[0]:
            # an inline element that is named as an advert or the like is a block of its own
            flush()
            stack.append(_Place(name, True, stack[-1].article))
            count[name] = count.get(name, 0) + 1
    parts.append(page[at:])
    flush()
    return out


#: An open element of the second kind ends where one of the first begins.
_ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",), "body": ("head",)}


def _pop(stack: list[_Place], count: dict[str, int], names: tuple[str, ...]) -> None:
    """Close all down to the last open element with one of these names."""
    while len(stack) > 1:
        name = stack.pop().name
        count[name] -= 1
        if name in names:
            return


def _close(stack: list[_Place], count: dict[str, int], name: str) -> None:
    """Close what may not hold ``name``: paragraphs, items of the same list, and navigation left open before an article."""
    before = ("nav", "head", "header")
    if name in _GOOD_TAGS and any(count.get(b) for b in before):
        _pop(stack, count, before)
    closing = _ENDS.get(name, ("p",))
    while len(stack) > 1 and (stack[-1].name in closing or stack[-1].name not in _BLOCKS):
        count[stack.pop().name] -= 1


def first_pass(text: str, links: int, bad: bool, article: bool) -> str:
    """Label of a block by itself: good, bad, near or short."""
    if bad or links > MOST_LINKS * len(text) or not article and ("\xa9" in text or "&copy" in text):
        return "bad"
    if len(text) < SHORT:
        return "bad" if links and not article else "short"
    words = text.lower().split()
    stops = sum([(w if w.isalpha() else w.strip(_MARKS)) in STOP_WORDS for w in words]) / max(1, len(words))
    if stops >= MANY_STOPS:
        return "good" if len(text) > LONG else "near"
    return "near" if stops >= FEW_STOPS else "short" if article else "bad"


def second_pass(labels: list[str], article: list[bool]) -> list[bool]:
    """Which blocks to keep. The bounds of an article count as good neighbours within it, those of a page as bad ones.

    A short block is good between two good ones, bad between two bad ones; else
    it is good if it has a near block for neighbour on the bad side. A near
    block that is left is good unless both decided neighbours are bad.
    """
    n = len(labels)

    def neighbours(now: list[str], decided: tuple[str, ...]) -> list[tuple[str, str]]:
        sides: list[list[str]] = []
        for order in (range(n), range(n - 1, -1, -1)):
            found, last, before = ["bad"] * n, "bad", None
            for k in order:
                if article[k] and not (before is not None and article[before]):
                    last = "good"  # over the bound into an article
                elif before is not None and article[before] and not article[k]:
                    last = now[before] if now[before] in decided else "good"
                found[k] = last
                if now[k] in decided:
                    last = now[k]
                before = k
            sides.append(found)
        return list(zip(*sides))

    wide = neighbours(labels, ("good", "bad", "near"))
    strict = neighbours(labels, ("good", "bad"))
    after = []
    for label, near, far in zip(labels, wide, strict):
        if label != "short":
            after.append(label)
        elif far[0] == far[1]:
            after.append(far[0])
        else:
            other = near[0] if far[0] == "bad" else near[1]
            after.append("good" if other == "near" else "bad")
    last = neighbours(after, ("good", "bad"))
    return [label == "good" or label == "near" and "good" in sides for label, sides in zip(after, last)]


def main_text(page: str) -> str:
    found = blocks(page)
    keep = second_pass([first_pass(*b) for b in found], [b[3] and not b[2] for b in found])
    return " ".join(b[0] for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` of every row: the kept blocks in page order, joined by spaces.

    Character references are decoded, white space within a block becomes one
    space. A null or empty page, or one without text, gives an empty text;
    pages are read whole, broken and unclosed markup too; repeated rows come
    out alike; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, texts, size = 0, [], 0
            for k in range(batch.num_rows):
                text = main_text(batch.column(2)[k].as_py() or "")
                texts.append(text)
                size += len(text)
                if size >= _OUTPUT_BYTES or k == batch.num_rows - 1:
                    part = batch.slice(start, len(texts))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])
                    start, texts, size = k + 1, [], 0

    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return given.mapInArrow(run, "page_id long, url string, text string")


def op13_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
