"""Main text of web pages by tag-path ratios.

A page is read once into blocks: runs of text between block tags, each with its path from the root.
Per path (tag names with their class) the page's text length, blocks, punctuation and link text are
aggregated. Two ratios per path, text length per block and punctuation per block, are smoothed over the
order in which paths of the same tag names come on the page (as geometric means, so that a long neighbour
does not carry a short path), fused by multiplication and compared with a share of the page's own mean. A
block is content if its path passes and is not mostly links. The ratios decide on the whole page: where a page has
an article, paths outside it count ``OUTSIDE`` of their ratio, so they need far more text than the article's.
Two rules go with that:

* Short paragraphs, items, cells and quotes without a class belong to the path of the element that holds
  them, and stay or go with that column, however short they are.
* A heading stays if content follows it before the next heading of its rank or above. Only where nothing
  but headings has text do the ratios decide on them.

Elements that never hold article text (scripts, menus, footers, forms, adverts by their class; hidden
ones, by the attribute or the style) are left out of the paths from the start. Each page is handled alone,
in the task that reads it; nothing is shuffled.

Defined cases: a null or empty html gives an empty text. Repeated rows are extracted each, extra columns
are ignored, an empty table gives an empty result. Broken markup is read as browsers do where that is
simple: unknown end tags are skipped, unclosed paragraphs and items end at the next block.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import bound_batches

# Element names by their part in a page.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea option button datalist".split())
BOILER = frozenset("nav header footer aside form menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr picture q ruby rp rt s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(["article", "main"])
ENDS_ITSELF = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
#: Names of what is not the article, as whole classes, ids and roles.
BOILER_NAME = re.compile(r"ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|widget\w*|footer\w*|foot|masthead|header\w*|site-?header|comments?|comment-?\w*|replies|reply|respond|disqus|cookies?\w*|consent|gdpr|notice\w*|alert\w*|popup|modal|overlay|newsletter\w*|subscribe\w*|signup|login|share\w*|social\w*|related\w*|recommend\w*|more|tags?|meta|byline|pagination|pager|toolbar|search\w*|skip\w*|copyright|legal|disclaimer|hidden|sr-only|(?:post|entry|article)[_-](?:meta|footer|tags|share|comments)", re.I)
#: Words beside such names that only say where something stands, or that it is a list.
PLACES = frozenset("site page main top bottom global primary area list links box block bar button buttons icons items form posts".split())
BLOCK_HEADS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Steps at the end of a path that, without a class, belong to the column that holds them.
COLUMN_PARTS = frozenset("p li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
MARKS = re.compile(r"[.,;:!?…。，、；：！？]")
#: Share of the page's mean that a path's fused ratio must reach.
SHARE = 0.25
#: Factor on the ratio of paths outside the article of a page that has one.
OUTSIDE = 0.2
#: Share of link text from which a path is a list of links.
LINKED = 0.6


class Block:
    __slots__ = ("path", "text", "linked", "dull", "inside")

    def __init__(self, path: str, text: str, linked: int, dull: bool, inside: bool):
        self.path, self.text, self.linked, self.dull, self.inside = path, text, linked, dull, inside


@functools.lru_cache(10_000)
def _boiler(token: str) -> bool:
    """Whether a whole class, id or role is such a name, or consists of such names and places; no-sidebar and has-sidebar do not."""
    parts = [x for x in re.split("[_-]", token) if x.lower() not in PLACES]
    return bool(BOILER_NAME.fullmatch(token)) or bool(parts) and all(map(BOILER_NAME.fullmatch, parts))


def page_blocks(source: str) -> list[Block]:
    """The blocks of a page in order."""
    blocks: list[Block] = []
    stack: list[tuple[str, str, bool, bool]] = []  # name, step of the path, boilerplate here or above, article here or above
    parts: list[str] = []
    linked = 0
    at, n = 0, len(source)

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = "/".join(s[1] for s in stack if s[0] not in INLINE)
                blocks.append(Block(path, text, linked, bool(stack) and stack[-1][2], bool(stack) and stack[-1][3]))
        parts, linked = [], 0

    def add(text):
        nonlocal linked
        parts.append(text)
        if text and any(s[0] == "a" for s in reversed(stack)):
            linked += len(text.strip())

    def pop_to(i):
        del stack[i:]

    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
                if name in INLINE and stack[i][0] not in INLINE:
                    break
            if name == "p":
                flush()
            continue
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        if name in HIDDEN:
            if name == "head":
                continue
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            if not m[3].rstrip().endswith("/") or name in ("script", "style"):
                at = end.end() if end else (n if name in ("script", "style", "title", "textarea") else at)
            if name not in ("svg", "math", "button", "select"):
                flush()
            continue
        if name not in INLINE:
            flush()
            closes = ENDS_ITSELF.get(name) or (frozenset(["p"]) if name not in VOID else frozenset())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    pop_to(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if name in VOID:
            continue
        has: dict[str, str] = {}
        for x in ATTRIBUTE.finditer(m[3]):
            has.setdefault(x[1].lower(), html.unescape(x[2] or x[3] or x[4] or ""))
        kinds = has.get("class", "").lower().split()
        named = [*kinds, *has.get("id", "").split(), *has.get("role", "").split()]
        above = stack[-1] if stack else ("", "", False, False)
        inside = above[3] or name in ARTICLE
        dull = above[2] or (name in BOILER and not (name == "header" and above[3])) or (name not in ("body", "html", *ARTICLE) and ("hidden" in has or bool(UNSEEN.search(has.get("style", ""))) or any(map(_boiler, named))))
        stack.append((name, ".".join([name, *kinds]).replace("/", "|"), dull, inside))
    flush()
    return blocks


def _smooth(values: list[float]) -> list[float]:
    """Geometric mean of each value and its neighbours, the value itself counting twice."""
    logs = [math.log(v) for v in values]
    return [math.exp((sum(near := logs[max(0, i - 1):i + 2]) + v) / (len(near) + 1)) for i, v in enumerate(logs)]


def _column(path: str) -> str:
    steps = path.split("/")
    while len(steps) > 1 and steps[-1] in COLUMN_PARTS:
        steps.pop()
    return "/".join(steps)


def _rank(b: Block) -> int:
    """1 to 6 for a heading, else 0."""
    name = b.path.rsplit("/", 1)[-1].split(".")[0]
    return int(name[1]) if name in BLOCK_HEADS else 0


def content_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks of the main text, by the ratios of their paths."""
    rest = [b for b in blocks if not b.dull]
    article = any(b.inside for b in rest)
    links: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for b in rest:
        links[b.path][0] += b.linked
        links[b.path][1] += len(b.text)
    rest = [b for b in rest if links[b.path][0] < LINKED * links[b.path][1]]
    judged = [b for b in rest if not _rank(b)] or rest
    paths: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    within: dict[str, bool] = {}
    for b in judged:
        within[_column(b.path)] = b.inside
        p = paths[_column(b.path)]
        p[0] += 1
        p[1] += len(b.text)
        p[2] += len(MARKS.findall(b.text))
    if not paths:
        return []
    like: dict[str, list[str]] = defaultdict(list)
    for k in paths:
        like[_column("/".join(x.split(".")[0] for x in k.split("/")))].append(k)
    fused: dict[str, float] = {}
    for ks in like.values():
        length = _smooth([paths[k][1] / paths[k][0] for k in ks])
        marks = _smooth([1 + paths[k][2] / paths[k][0] for k in ks])
        fused.update({k: a * m for k, a, m in zip(ks, length, marks, strict=True)})
    fused = {k: f if within[k] or not article else OUTSIDE * f for k, f in fused.items()}
    weight = sum(p[1] for p in paths.values())
    mean = sum(fused[k] * p[1] for k, p in paths.items()) / weight
    good = {k for k in paths if fused[k] >= SHARE * mean}
    content = {id(b) for b in judged if _column(b.path) in good}
    kept = content | _headed(blocks, content, {id(b) for b in rest})
    return [b for b in blocks if id(b) in kept]


def _headed(blocks: list[Block], content: set[int], rest: set[int]) -> set[int]:
    """The headings of ``rest`` with content before the next heading of their rank or above; headings in a row count as one."""
    out: set[int] = set()
    follows, row = [False] * 7, False
    for b in reversed(blocks):
        rank = _rank(b) if id(b) in rest else 0
        if id(b) in content:
            follows, row = [True] * 7, False
        elif rank:
            row = row or follows[rank]
            if row:
                out.add(id(b))
            follows[rank:] = [False] * (7 - rank)
        else:
            row = False
    return out


def extract(source: str | None) -> str:
    """The main text of one page: its blocks, joined by two line feeds."""
    return "\n\n".join(b.text for b in content_blocks(page_blocks(source))) if source else ""


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    def run(batches):
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
