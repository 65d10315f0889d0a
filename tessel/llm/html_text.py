"""HTML extraction by line-block distribution.

Markup is stripped and the page becomes lines: one for each block of text, an empty one where a container begins or ends (WINDOW of
them, which is a dive, for an article), and one empty line for each element that never is main text (menus, headers, footers, asides, forms, scripts, styles, blocks whose whole
class or id names an advert, a notice, comments and the like, and an article within an article, which is a comment). A line weighs
as many code points as it has outside of links. Where the page marks an article, its lines weigh INSIDE times their whole length, all
others a part of theirs, OUTSIDE: a mark tips the scale, the sums decide.

The weights of WINDOW lines in a row are summed at each line. The sums dive where they are 0; between two dives they surge if they
climb to the level that the page itself sets, a third of its highest sum or LEVEL. The text between a surge's foot and its
dive stays, short lines and lines of links among it too; text between dives that never surges goes. An article that surges anywhere is text as a whole: its short blocks
between dives join the surge. What stands below a heading of comments goes, to the end of the element that holds the heading, or of the next one where the heading is alone in its own.

Character references are decoded, white space within a block becomes one space, blocks are joined by one space.

Defined results: a null, empty or markup-only page has an empty text; broken markup is read as far as it goes; repeated rows are
extracted alike; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessel.llm.common import table

WINDOW = 3
LEVEL = 80
INSIDE, OUTSIDE = 2, 0.5

# Elements by what they do to the lines of a page.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title".split())
NEVER = frozenset("nav header footer aside form menu dialog button select head".split())
BLOCK = frozenset(
    "address article blockquote body br caption center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINER = frozenset("article div figure main section table".split())
# Parts of names in a class or id. A name is beside the main text if all its parts are known and one of them is in BESIDE.
BESIDE = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr popup modal newsletter subscribe subscription sidebar nav navbar navigation menu breadcrumb "
    "breadcrumbs masthead footer comment comments commentlist disqus replies respond pagination pager toolbar share sharing social login signup notice header widget widgets related skyscraper leaderboard".split()
)
BETWEEN = frozenset("story stories posts articles items topics site page main global top bottom left right primary secondary mobile desktop post article entry user reader the area block box bar list section wrapper container inner slot unit links buttons icons form text message overlay".split())
# Headings, without numbers, that reader comments stand below.
REMARKS = frozenset(("comment", "comments", "reader comments", "user comments", "leave a comment", "leave a reply", "post a comment", "join the discussion"))
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_PART = re.compile(r"[a-z]+|[0-9]+")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=$|[\s=/])|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_BLANK = re.compile(r"\s+")


class Line:
    """A block's text, how much of it is links, its mark, which is 2 in an article, 1 in the main element, else 0, and the number of its article, 0 outside of any. Empty lines stand for what parts blocks."""

    __slots__ = ("text", "linked", "mark", "article")

    def __init__(self, text: str = "", linked: int = 0, mark: int = 0, article: int = 0):
        self.text, self.linked, self.mark, self.article = text, linked, mark, article


def _names_beside(names: str) -> bool:
    """Whether one of the names says that its block is beside the main text. Letters, hyphens, underscores and a change of case part a name."""
    for name in names.split():
        parts = [x for x in _PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if not x.isdigit()]
        if any(x in BESIDE for x in parts) and all(x in BESIDE or x in BETWEEN for x in parts):
            return True
    return False


def _heads_remarks(text: str) -> bool:
    return len(text) < 40 and " ".join(re.findall(r"[a-z]+", text.lower())) in REMARKS


def _beside(name: str, attributes: str) -> bool:
    if name in NEVER:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    for key, *values in _NAMED.findall(attributes):
        value = next((v for v in values if v), "")
        if key.lower() == "role" and value.strip().lower() in _ROLES or key.lower() != "role" and _names_beside(value):
            return True
    return False


def lines_of(page: str) -> list[Line]:
    """The page's lines; what never is main text is an empty one."""
    out: list[Line] = []
    parts: list[str] = []
    linked = 0
    stack: list[str] = []
    skip_at = 0  # depth of the element that is skipped, or 0
    articles = mains = links = seen = 0
    remarks = False  # whether what is skipped is what follows a heading of comments, and nothing has followed yet
    raw_end: re.Pattern[str] | None = None

    def close() -> None:
        nonlocal linked
        if parts:
            text = _BLANK.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Line(text, min(linked, len(text)), 2 if articles else 1 if mains else 0, seen if articles else 0))
            parts.clear()
        linked = 0

    def part(name: str) -> None:
        if name == "article" and articles < 2:
            out.extend([Line()] * WINDOW)
        elif name in CONTAINER and not (articles and out and not out[-1].text):  # nested boundaries in an article are one
            out.append(Line())

    at = 0
    while at < len(page):
        if raw_end:
            found = raw_end.search(page, at)
            raw_end = None
            at = found.end() if found else len(page)
            continue
        found = _TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if remarks and text.strip():
            remarks = False
        if text and not skip_at:
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name in stack:
                k = len(stack) - 1 - stack[::-1].index(name)
                if name in BLOCK or name in NEVER:
                    if not skip_at:
                        before = len(out)
                        close()
                        if name in _HEADING and len(out) > before and _heads_remarks(out[-1].text):
                            out[-1] = Line()
                            skip_at, remarks = max(1, k), True  # to the end of what holds the heading
                        part(name)
                elif any(x in BLOCK or x in NEVER for x in stack[k + 1 :]):
                    continue  # an inline end tag does not close blocks
                for x in stack[k:]:
                    articles -= x == "article"
                    mains -= x == "main"
                    links -= x == "a"
                del stack[k:]
                if skip_at > len(stack):
                    # a heading that is alone in its element heads what follows that
                    skip_at = len(stack) if remarks else 0
            elif name in BLOCK and not skip_at:
                close()
            continue
        if name in BLOCK or name in NEVER:
            if not skip_at:
                close()
                part(name)
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and name in stack:  # these close one another
                k = len(stack) - 1 - stack[::-1].index(name)
                if not any(x in ("ul", "ol", "dl", "table", "div", "article", "section", "main", "body") or x in NEVER for x in stack[k + 1 :]) and skip_at <= k + 1:
                    for x in stack[k:]:
                        links -= x == "a"
                    if skip_at > k:
                        skip_at = 0
                    del stack[k:]
        if name in RAW:
            if not found[3].rstrip().endswith("/"):
                raw_end = re.compile(rf"</{name}\s*>", re.I)
            continue
        if name in VOID or found[3].rstrip().endswith("/"):
            continue
        stack.append(name)
        comment = name == "article" and articles > 0
        articles += name == "article"
        seen += name == "article" and articles == 1
        mains += name == "main"
        links += name == "a"
        if not skip_at and (comment or _beside(name, found[3])):
            close()
            out.append(Line())
            skip_at = len(stack)
    if not skip_at:
        close()
    return out


def weights_of(lines: list[Line]) -> list[float]:
    mark = max((x.mark for x in lines if x.text), default=0)
    if not mark:
        return [len(x.text) - x.linked for x in lines]
    return [INSIDE * len(x.text) if x.mark == mark else OUTSIDE * (len(x.text) - x.linked) for x in lines]


def main_lines(lines: list[Line]) -> list[str]:
    """The lines between surges and dives of the summed weights."""
    weights = weights_of(lines)
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(lines))]
    if not sums or not (peak := max(sums)):
        return []
    level = min(LEVEL, peak / 3)
    parts: list[tuple[int, int, float]] = []  # first and last line, and the highest sum within
    for i, weight in enumerate(weights):
        if not weight:
            continue
        if not parts or i - parts[-1][1] > WINDOW:  # WINDOW lines without weight lie between
            parts.append((i, i, 0.0))
        # the sums that begin at or up to WINDOW - 1 lines before this one, within the foot
        foot, _, top = parts[-1]
        parts[-1] = foot, i, max(top, *sums[max(foot, i - WINDOW + 1) : i + 1])
    surged = {lines[i].article for foot, last, top in parts if top >= level for i in range(foot, last + 1)} - {0}
    return [x.text for foot, last, top in parts for x in lines[foot : last + 1] if x.text and (top >= level or x.article in surged)]


def extract(page: str | None) -> str:
    return " ".join(main_lines(lines_of(page))) if page else ""


def main_text(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """(id columns, text) of every row."""
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([extract(x.as_py()) for x in batch.column(html_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in id_cols], text], [*id_cols, "text"])

    return pages.select(*id_cols, html_col).mapInArrow(run, f"{kinds}, text string")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"))
    return out.selectExpr("page_id", "url", "text", "cast(char_length(text) as bigint) as n_chars")
