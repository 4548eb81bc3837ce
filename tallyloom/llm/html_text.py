"""Operator 2: main text of web pages by a maximum-scoring subsequence.

A page becomes a row of runs: words between two tags, and tags. Words score positive and tags
negative, each by its surroundings; the weights are those that lose the fewest words on labelled
pages. One linear scan finds the contiguous region with the highest sum. The text of that region,
without elements that are marked as something else, is the main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm.labelled_pages import PAGES
from tallyloom.session import map_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "noframes", "iframe", "template", "svg", "math", "object", "select", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Tags that end an open paragraph.
_ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ALONE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "option": {"select"}}
_OTHER = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset", "legend", "input"}
_MAIN = {"article", "main"}
_HEADINGS = {"h2", "h3", "h4", "h5", "h6"}
_OTHER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar", "form"}
#: Parts of class names and ids that mark an element as something else, whatever other names it has.
_OTHER_NAMES = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|popup|modal|overlay|nav\w*|menus?|breadcrumbs?|sidebar\w*|footer\w*|masthead|topbar|toolbar|newsletter|"
    r"subscribe|subscription|signup|login|comments?|commentlist|replies|disqus|reactions|pagination|pager)",
    re.I,
)
#: Those that do so unless another name of the element says that it holds the text.
_DOUBTFUL_NAMES = re.compile(
    r"(?:promo\w*|banner|notices?|side|widgets?|share|sharing|social|related|recommend\w*|respond|skip|search|tags|copyright|legal|disclaimer|alert)", re.I
)
_TEXT_NAMES = re.compile(r"(?:article|body|content|entry|main|post|story|text)", re.I)
#: First parts of names that tell of the layout around an element, not of itself.
_LAYOUT = {"has", "no", "with", "without", "is", "not", "hide", "show"}
_COMMENT_HEADS = re.compile(r"\W*(?:\d+\s+)?(?:reader\s+|user\s+)?(?:comments?|kommentare?|commentaires?|comentarios?|leave a (?:comment|reply))(?:\s*[(\[]?\d+[)\]]?)?\W*", re.I)
_MAIN_NAMES = re.compile(r"(?:^|\s)(?:article-?body|post-?content|entry-?content|article-?content|main-?content|story-?body)(?:$|\s)", re.I)

Run = tuple[str, str, str, int]  # kind ("word" or a tag class), surroundings, text, block number


def _named_other(names: str) -> bool:
    """Whether class names and ids mark an element as something else than text."""
    doubtful = text = False
    for name in names.split():
        parts = re.split(r"[-_]+", name)
        if parts[0].lower() in _LAYOUT:
            continue
        if any(_OTHER_NAMES.fullmatch(part) for part in parts):
            return True
        if any(_DOUBTFUL_NAMES.fullmatch(part) for part in parts):
            doubtful = True
        elif any(_TEXT_NAMES.fullmatch(part) for part in parts):
            text = True
    return doubtful and not text


def _marks(name: str, attributes: str, inside_main: bool) -> str:
    """What a start tag says about its element: "other", "main" or nothing."""
    if name in _OTHER or (name == "header" and not inside_main):
        return "other"
    values = {}
    for m in _ATTRIBUTE.finditer(attributes) if attributes.strip(" /\n\t") else ():
        values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if values:
        if "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", "")):
            return "other"
        if values.get("role", "").lower() in _OTHER_ROLES or (name not in ("body", "html") and name not in _MAIN and _named_other(f"{values.get('class', '')} {values.get('id', '')}")):
            return "other"
        if values.get("role") == "main" or values.get("itemprop") == "articleBody" or _MAIN_NAMES.search(f"{values.get('class', '')} {values.get('id', '')}"):
            return "main"
    return "main" if name in _MAIN else ""


def runs(page: str) -> list[Run]:
    """Words and tags of a page in order, with their surroundings and block numbers."""
    out: list[tuple[str, str, str, int]] = []
    stack: list[tuple[str, str]] = []  # open elements with their surroundings
    block, at, end, has_main = 0, 0, len(page), False
    heading = None  # where the runs of an open heading begin

    def put(text: str) -> None:
        nonlocal has_main
        if text:
            around = stack[-1][1] if stack else "plain"
            has_main |= around == "main" and not text.isspace()
            linked = any(n == "a" for n, _ in stack)
            out.append(("link" if linked else "word", around, html.unescape(text), block))

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, around = m[2].lower(), stack[-1][1] if stack else "plain"
        kind = "inline" if name in _INLINE else name if name in ("p", "li", "div", "td") or name in ("h1", "h2", "h3") else "block"
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                around = stack[k][1]
                del stack[k:]
            if heading is not None and name in _HEADINGS:
                if stack and _COMMENT_HEADS.fullmatch("".join(r[2] for r in out[heading:])):
                    # what follows in the element around a heading of comments is comments
                    around = "inner" if stack[-1][1] in ("main", "inner") else "other"
                    stack[-1] = stack[-1][0], around
                    out[heading:] = [(k, around, t, b) for k, _, t, b in out[heading:]]
                heading = None
        elif name in _RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            if not m[3].rstrip().endswith("/") or name in ("script", "style", "textarea", "title"):
                at = close.end() if close else (end if name in ("script", "style", "textarea", "title", "xmp") else at)
        else:
            if name in _ENDS_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] not in _INLINE:
                        break
            elif name in _ALONE:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] in _ALONE[name]:
                        break
            around = stack[-1][1] if stack else "plain"
            said = _marks(name, m[3], around == "main")
            if said == "other" or around in ("other", "inner"):
                around = "inner" if around in ("main", "inner") else "other"  # inside the main part it breaks nothing off
            else:
                around = said or around
            if name not in _VOID and not (m[3].endswith("/") and name in _VOID):
                stack.append((name, around))
        if name == "br":
            out.append(("word", around, " ", block))
        elif name not in _INLINE:
            block += 1
        if name in _HEADINGS and not m[1]:
            heading = len(out)
        out.append((kind, around, "", block))
    if has_main:  # beside a marked main part, unmarked runs are features of their own; their words still add to a region
        out = [(k, "beside" if a == "plain" else a, t, b) for k, a, t, b in out]
    return out


def _feature(kind: str, around: str) -> tuple[str, str]:
    """The weight that a run uses: like kinds and surroundings share one."""
    if kind not in ("word", "link"):
        kind = {"h1": "head", "h2": "head", "h3": "head", "td": "item", "li": "item", "p": "p", "inline": "inline"}.get(kind, "block")
    if around in ("other", "inner") and kind not in ("word", "link"):
        kind = "tag"
    return kind, around


#: Values from which each weight is chosen; words of unmarked text have weight 1. Words score
#: positive and tags negative in text that may be main; what is marked as something else can't add.
GRIDS: dict[tuple[str, str], tuple[float, ...]] = {
    ("word", "main"): (1.0, 2.0, 4.0, 8.0), ("link", "main"): (0.25, 0.5, 1.0, 2.0), ("word", "beside"): (1.0, 0.5, 0.25, 0.1), ("link", "plain"): (-0.25, -0.5, -1.0, -2.0, 0.25), ("link", "beside"): (-0.25, -0.5, -1.0, -2.0, 0.25),
    **{(kind, "plain"): (-0.1, -0.25, -0.5, -1.0, -2.0, -4.0) for kind in ("inline", "p", "head", "item", "block")},
    **{(kind, "beside"): (-0.1, -0.25, -0.4, -0.5, -1.0, -2.0, -4.0) for kind in ("inline", "p", "head", "item", "block")},
    **{(kind, "main"): (-0.01, -0.05, -0.25) for kind in ("inline", "p", "head", "item", "block")},
    **{(kind, around): (-0.1, -0.25, -0.4) for kind in ("head", "p") for around in ("plain", "beside")},  # a heading of one word still adds to its text
    ("word", "inner"): (0.0, -0.1, -0.5), ("link", "inner"): (0.0, -0.1, -0.5), ("tag", "inner"): (0.0, -0.05, -0.25),
    ("word", "other"): (-0.5, -1.0, -2.0, 0.0), ("link", "other"): (-0.5, -1.0, -2.0, 0.0), ("tag", "other"): (-0.25, -0.5, -1.0, -2.0, 0.0),
}
ROUNDS = 3


@cache
def _examples() -> list[tuple[list[tuple[str, str]], list[int], list[bool], list[bool]]]:
    """For each labelled page: features of its runs, words in them, whether they are main text, and whether they can be given back."""
    out = []
    for parts in PAGES:
        found = runs("".join(part for _, part in parts))
        wanted = {" ".join(t.split()) for _, _, t, _ in runs("".join(part for good, part in parts if good)) if t.strip()}
        out.append(
            (
                [_feature(kind, around) for kind, around, _, _ in found],
                [len(t.split()) if kind in ("word", "link") else 1 for kind, _, t, _ in found],
                [bool(t.strip()) and " ".join(t.split()) in wanted for _, _, t, _ in found],
                [bool(t.strip()) and around in _GIVEN for _, around, t, _ in found],
            )
        )
    return out


def _lost(table: dict[tuple[str, str], float]) -> float:
    """Words that a scan with these weights misses or adds, as a share of each labelled page's main text, over all pages."""
    wrong = 0.0
    for features, sizes, good, given in _examples():
        first, last = best_region([table[f] * n for f, n in zip(features, sizes)])
        missed = sum(n for k, n in enumerate(sizes) if good[k] != (given[k] and first <= k < last) and (good[k] or given[k]))
        wrong += missed / sum(n for k, n in enumerate(sizes) if good[k])
    return wrong


@cache
def weights() -> dict[tuple[str, str], float]:
    """The weight of each feature: of the values in ``GRIDS``, in turns, the one that loses the fewest words on the labelled pages."""
    table = {("word", "plain"): 1.0} | {f: values[0] for f, values in GRIDS.items()}
    # the start: words, tags of lines and other tags beside a main part are chosen together
    lines = ("head", "p")
    levels = [
        {("word", "beside"): word, **{f: line if f[0] in lines else tag for f in GRIDS if f[1] == "beside" and f[0] not in ("word", "link")}}
        for word in GRIDS["word", "beside"]
        for line in GRIDS["p", "beside"]
        for tag in GRIDS["block", "beside"]
    ]
    best, table = min(((_lost(table | level), table | level) for level in levels), key=lambda x: x[0])
    for _ in range(ROUNDS):
        before = best
        for feature, values in GRIDS.items():
            for value in values:
                tried = table | {feature: value}
                lost = _lost(tried)
                if lost < best:
                    best, table = lost, tried
        if best == before:
            break
    return table


#: Surroundings whose text inside the region is main text.
_GIVEN = ("plain", "beside", "main")


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last+1 of the contiguous region with the highest sum, in one scan; the first of equals."""
    best, at, total, first = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, first = 0.0, k
        total += score
        if total > best:
            best, at = total, (first, k + 1)
    return at


def main_text(page: str | None, table: dict[tuple[str, str], float] | None = None) -> str:
    """Main text: blocks in page order, white space inside each one space, joined by two line ends.

    Null, empty and blank pages, and pages without words outside marked elements, give "". Of
    regions with equal sums the first counts. The whole page is read, however long.
    """
    if not page:
        return ""
    found, table = runs(page), table or weights()
    scores = [table[_feature(kind, around)] * (len(text.split()) if kind in ("word", "link") else 1) for kind, around, text, _ in found]
    first, last = best_region(scores)
    blocks: dict[int, list[str]] = {}
    for kind, around, text, block in found[first:last]:
        if text and around in _GIVEN:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(line for line in lines if line)


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null and empty pages give an empty text, null ids and urls stay null; other columns are
    ignored, repeated rows stay, and an empty table gives an empty table.
    """
    table = weights()  # fitted once, on the driver

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, table) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return map_batches(plain, read, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
