"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped to one line per block element.  The text lengths of lines are summed
over a sliding window of lines; a surge is where the sum rises above a bound,
a dive where it falls to nothing, and the text between them is kept.  Links have length 0, and
elements that are never part of an article have no text.

Article and main elements mark their lines: these weigh more, no dive cuts the text of one such element,
and links in an article with text of its own are text.  Lines outside must surge above the largest sum inside.
"""

from __future__ import annotations

import html
import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import arrow_batches

WINDOW = 3
SURGE = 86
#: What a character of an article or main element counts in the sums.
WEIGHT = 2

# Fixed values of the HTML standard.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object textarea title select button canvas audio video".split())
#: Elements that never hold the article.
ASIDE = frozenset("nav footer aside form menu dialog head".split())
#: Names in a class, id or role that mark what is no part of the article.
NAMES = frozenset(
    "ad ads adbox adslot adunit adsbygoogle advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent notice gdpr popup modal newsletter "
    "subscribe signup login share sharing social sidebar widget menu navbar nav navigation breadcrumb breadcrumbs pagination footer related recommended recommendations comment comments disqus "
    "reply replies respond complementary contentinfo".split()
)
#: Words that may stand beside these in a name: they say where the element is or what holds it, not what it is about.
PLACES = frozenset(
    "area article articles bar block body bottom box btn button buttons center col column container content count entry first form global group head header heading icons inner item items last "
    "latest left link links list main media module outer page panel post posts primary reader right row secondary section side site slot small sticky stories story text thread title toolbar top "
    "unit user wrap wrapper zone".split()
)
#: Whole names that mark a search form; a list of results is text.
WHOLE_NAMES = frozenset("search searchbox search-box search-form searchform side-bar".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
QUOTED = re.compile(r"\"[^\"]*\"?|'[^']*'?")
UNSEEN = re.compile(r"(?:^|[\s\"'/])hidden(?=[\s=/]|$)", re.I)
NO_DISPLAY = re.compile(r"(?:^|[\s\"'/])style\s*=\s*[\"']?[^\"'>]*\bdisplay\s*:\s*none", re.I)


def _marked(attributes: str, first_only: bool = False) -> bool:
    """Whether a name in class, id or role says that the element is no part of the article.

    All parts of the name must be of ``NAMES`` or ``PLACES``, one at least of ``NAMES``: "related-posts" says so, "related-work" doesn't.
    With ``first_only``, for article elements, it must be the first: "post-comments" may hold the post.
    """
    for values in NAMED.findall(attributes):
        for name in "".join(values).lower().split():
            parts = [x for x in re.split(r"[-_]+", name) if x]
            told = [x in NAMES for x in parts]
            if name in WHOLE_NAMES or (any(told[:1] if first_only else told) and all(k or x in PLACES or len(x) == 1 or x.isdigit() for k, x in zip(told, parts, strict=True))):
                return True
    return False


def _unseen(attributes: str) -> bool:
    return bool(UNSEEN.search(QUOTED.sub('""', attributes)) or NO_DISPLAY.search(attributes))


def page_lines(page: str) -> list[tuple[str, int, int]]:
    """(text, length, unit) of each block of the page, in order.

    The length counts characters outside links; lines of elements that never
    hold the article, and of hidden ones, are left out.  White space in a line is one space.
    The unit is the number of the outermost article or main element that holds the line, 0 outside
    and in elements that hold nothing but links.  A line of links counts in full in an article that has text
    outside links, and in a main element that has such text and no such article.
    """
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, int]] = []  # name, hides its text, innermost article or main
    scopes: list[tuple[str, int]] = [("", 0)]  # name of each article or main, and the scope around it
    hidden = False
    scope = in_link = 0
    unclosed: set[str] = set()  # raw elements that have no end tag any more

    def close_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append((text, max(0, len(text) - linked), scope))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            parts.append(text)
            if in_link:
                linked += len(" ".join(html.unescape(text).split()))

    at = 0
    while at < len(page):
        token = TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at : token.start()])
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            close_line()
        if token[1]:
            if name == "a":
                in_link = max(0, in_link - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body") and name not in ("body", "html"):
                    break  # a stray end tag doesn't close the article
                if stack[k][0] in BLOCKS and name not in BLOCKS:
                    break  # nor does one of an inline element close a block
        elif name in RAW:
            alone = token[3].rstrip().endswith("/")
            end = None if alone or name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if not end and not alone:
                unclosed.add(name)
            if end:
                at = end.end()
            elif name in ("script", "style", "textarea", "title", "template"):
                at = len(page)
        elif name == "br":
            add(" ")
        elif name not in VOID and not token[3].rstrip().endswith("/"):
            if name == "p":
                inner = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCKS), -1)
                if inner >= 0 and stack[inner][0] == "p":
                    del stack[inner:]
            if name == "a":
                in_link += 1
            outer = stack[-1] if stack else ("", False, 0)
            named = name not in ("html", "body", "main", "a") and _marked(token[3], name == "article")
            aside = name in ASIDE or (name == "header" and not outer[2]) or named or (name not in ("html", "body") and _unseen(token[3]))
            if name in BLOCKS:
                inside = outer[2]
                if name in ("article", "main"):
                    scopes.append((name, inside))
                    inside = len(scopes) - 1
                # The main element holds the article whatever the names around it say.
                stack.append((name, (outer[1] and name != "main") or aside, inside))
                in_link = 0
            elif aside or outer[1]:
                stack.append((name, True, outer[2]))
        hidden = bool(stack) and stack[-1][1]
        scope = stack[-1][2] if stack else 0
    close_line()
    return _in_units(lines, scopes)


def _in_units(lines: list[tuple[str, int, int]], scopes: list[tuple[str, int]]) -> list[tuple[str, int, int]]:
    """The lines with the outermost scope that has text in place of the innermost, and with lines of links that are text counted in full."""
    own = [False] * len(scopes)
    for _, n, scope in lines:
        own[scope] |= n > 0
    speaks, has_article, outermost = own[:], [False] * len(scopes), list(range(len(scopes)))
    for k in range(len(scopes) - 1, 0, -1):  # a scope comes after the scope around it
        name, around = scopes[k]
        if around:
            speaks[around] |= speaks[k]
            has_article[around] |= has_article[k] or (name == "article" and speaks[k])
    for k in range(1, len(scopes)):
        outermost[k] = outermost[scopes[k][1]] or k
    out = []
    for text, n, scope in lines:
        whole = scope and own[scope] and (scopes[scope][0] == "article" or not has_article[scope])
        unit = outermost[scope]
        out.append((text, n or (len(text) if whole else 0), unit if unit and speaks[unit] else 0))
    return out


def main_lines(lines: list[tuple[str, int, int]], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The lines between surges and dives.

    A stretch of lines begins where the sum of a window rises from nothing
    and ends where it falls back to nothing; it is kept if its sum surges
    above ``surge`` characters, or half of the largest sum where that is less.
    Characters of a unit count ``WEIGHT`` times, and between its first and last line with a length there is no dive.
    Windows end where a unit begins or ends; a stretch outside must surge above the largest sum of all units.
    A line of links stays where text of its stretch lies on both sides.
    """
    lengths = [n * WEIGHT if unit else n for _, n, unit in lines]
    pieces = [list(g) for _, g in groupby(range(len(lines)), key=lambda k: bool(lines[k][2]))]
    sums = [sum(lengths[k : min(k + window, g[-1] + 1)]) for g in pieces for k in g]
    ends: dict[int, int] = {}
    for k, (_, _, unit) in enumerate(lines):
        if unit and lengths[k]:
            ends[unit] = k
    bound = min(surge, max(sums, default=0) / 2)
    inside = max((sums[k] for k in range(len(lines)) if lines[k][2]), default=0)
    kept: list[str] = []
    for g in pieces:
        rise, stop = g[0], g[-1] + 1
        while rise < stop:
            dive, held = rise, -1
            while dive < stop and (sums[dive] > 0 or dive <= held):
                if lengths[dive] and lines[dive][2]:
                    held = max(held, ends[lines[dive][2]])
                dive += 1
            if max(sums[rise:dive], default=0) > (bound if lines[rise][2] else max(bound, inside)):
                full = [k for k in range(rise, dive) if lengths[k]]
                kept += [line[0] for line in lines[full[0] : full[-1] + 1]]
            rise = dive + 1
    return kept


def main_text(page: str | None) -> str:
    return "\n\n".join(main_lines(page_lines(page or "")))


def _batches(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id`` (long), ``url``, ``text`` (blocks joined by an empty line; empty if there are none) and ``n_chars`` of every row.

    A null html is the empty page.  Unclosed elements, comments and quotes
    run to the end of the page.  Other columns are ignored; repeated rows stay repeated.
    """
    arrow_batches(pages.sparkSession, 256)
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return plain.mapInArrow(_batches, "page_id long, url string, text string, n_chars long")
