"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks, each with its word count and link density, those of its
neighbours, and, after these, the kind of element it stands in. A decision tree, trained on a small labelled table,
tells main text from the rest; many of the labelled pages name no part of themselves, so that lengths and links decide.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.shared import ship, table

# Element names of HTML, and words that name parts of a page.
RAW = "script style noscript title textarea iframe".split()  # text up to their end tags, not markup
SKIPPED = set("template select option button object svg math canvas audio video".split())
BREAKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HOLDERS = set("article aside details dialog div dl fieldset figure footer form header main menu nav ol section table ul body blockquote span".split())
FRAME = set("nav header footer aside menu dialog fieldset".split())
MAIN = set("article main".split())
OPTIONAL = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}  # start tags that end open ones
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
PART = set(
    "ad ads advert advertisement banner sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies"
    " cookie-notice cookie-banner consent notice alert popup modal newsletter subscribe search share social related comment comments comment-list"
    " disqus pagination pager".split()
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)")
# Blanks and slashes, then an attribute if there is one. Nothing is tried twice, and no tag reaches beyond the next "<".
ATTRIBUTE = re.compile(
    r"([\s/]*+)(?:([^\s/>=<\"'][^\s/>=<]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'<][^\s><]*+)))?+)?+"
)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}

NAMES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "in_frame", "in_form", "hinted", "prose", "main_elsewhere"
)


def scan(page: str) -> Iterator[tuple[str, str, bool, dict[str, str], bool]]:
    """(text, name, is an end tag, attributes, closes itself) of each piece of a page: a text, or a tag with its name.

    Comments, declarations and raw elements give nothing; one that is not closed ends with the page. A tag without its
    ">" ends at the next "<". Time is linear in the length of the page, whatever is broken in it.
    """
    at, size = 0, len(page)
    while at < size:
        low = page.find("<", at)
        if low != at:
            yield page[at : low if low >= 0 else size], "", False, {}, False
        if low < 0:
            return
        if page.startswith(("<!", "<?"), low):
            mark = "-->" if page.startswith("<!--", low) else ">"
            high = page.find(mark, low + (4 if mark == "-->" else 2))
            at = size if high < 0 else high + len(mark)
            continue
        tag = NAME.match(page, low)
        if not tag:
            yield "<", "", False, {}, False
            at = low + 1
            continue
        at, name, attributes, closed = tag.end(), tag[2].lower(), {}, False
        while True:
            found = ATTRIBUTE.match(page, at)
            at = found.end()
            if found[2]:
                attributes.setdefault(found[2].lower(), found[3] or found[4] or found[5] or "")
            elif at >= size or page[at] == "<":
                break
            elif page[at] == ">":
                closed = found[1].endswith("/")
                at += 1
                break
            else:  # a stray quote or sign
                at += 1
        if name in RAW_END and not tag[1]:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else size
        elif name not in RAW_END:
            yield "", name, bool(tag[1]), attributes, closed


def marks(attributes: dict[str, str]) -> tuple[bool, bool]:
    """Whether class or id is a word for a part around the main text, and whether role or style set the element apart."""
    hinted = not PART.isdisjoint(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split())
    apart = attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
    return hinted, apart or bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))


def ends_around(name: str, kind: str, around: set[str], inner: Counter) -> bool:
    """Whether a start tag in a skipped element `kind` ends it, or one of the open elements `around` it, as HTML has it."""
    if kind in ("svg", "math"):  # tags of HTML break out, but for the places where it may stand
        return name in BREAKS | {"body", "span"} and not any(inner[x] > 0 for x in ("foreignobject", "desc", "annotation-xml", "mtext", "mi", "mo", "mn", "ms"))
    if kind in ("object", "template"):
        return False
    if name in BREAKS and "p" in around and kind != "button":
        return True
    return name != "p" and bool(OPTIONAL.get(name, set()) & around)


def blocks(page: str) -> list[tuple[str, tuple]]:
    """(text, own features) of the flat text blocks of a page, in order.

    Unclosed elements end with the element around them; a page cut short ends all. Character references
    are decoded, white space is one space. Scripts, styles, markup and other unseen contents are skipped; an
    unseen element that is not closed ends with the element around it too.
    """
    found: list[tuple[str, tuple]] = []
    # (name, in main, in a frame, in a form, in a part that is named as such)
    stack: list[tuple] = [("", False, False, False, False)]
    around: list[set[str]] = [set()]  # open elements with optional end tags, for each of the stack
    hidden, inner, open_ = 0, Counter(), Counter()  # place of the skipped element on the stack; other open elements in and around it
    parts: list[str] = []
    linked: list[str] = []
    in_link, prose, in_head = 0, False, False

    names, held = Counter(), 0  # of the stack; holders inside the skipped element

    def push(entry: tuple) -> None:
        nonlocal held
        stack.append(entry)
        around.append(set())
        names[entry[0]] += 1
        held += bool(hidden) and entry[0] in HOLDERS

    def cut(place: int) -> None:
        """Close the elements of the stack from `place` on."""
        nonlocal held
        for entry in stack[place:]:
            names[entry[0]] -= 1
            held -= bool(hidden) and entry[0] in HOLDERS
        del stack[place:], around[place:]

    def close() -> None:
        nonlocal prose
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            n = len(text.split())
            inside = len(html.unescape("".join(linked)).split())
            found.append((text, (n, min(1.0, inside / n), *map(float, stack[-1][1:]), float(prose))))
        parts.clear()
        linked.clear()

    for text, name, end, attributes, closed in scan(page):
        if text:
            if not in_head and not hidden:
                parts.append(text)
                if in_link:
                    linked.append(text)
            continue
        if hidden:
            place = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0) if end and names[name] > 0 else 0
            if place >= hidden:
                cut(place)
                hidden = hidden if place > hidden else 0
                continue
            if end:
                leave = place > 0 or inner[name] <= 0 and open_[name] > 0 or name == "head"
                inner[name] -= inner[name] > 0
            else:
                leave = name == "body" or not held and ends_around(name, stack[hidden][0], around[hidden - 1], inner)
            if not leave:
                if name == "option" and stack[-1][0] == "option" and not end and len(stack) > hidden + 1:
                    continue  # ends the one before
                if not end and not closed and (name in HOLDERS or name in SKIPPED):
                    push((name, *stack[-1][1:]))
                elif not end and not closed and name not in VOID:
                    inner[name] += 1
                continue
            cut(hidden)
            hidden = 0
        if name in SKIPPED:
            if not end and not (closed and name in ("svg", "math")):
                push((name, *stack[-1][1:]))
                hidden, held = len(stack) - 1, 0
                inner.clear()
            continue
        if name not in HOLDERS and name not in VOID:
            open_[name] += 1 - closed if not end else -(open_[name] > 0)
        if name in BREAKS:
            around[-1].discard("p")
        if name in OPTIONAL:
            around[-1] -= OPTIONAL[name]
            if not end:
                around[-1].add(name)
        if name == "head":
            in_head = not end
        elif name in ("body", "nav", "article", "main", "p", "div", "h1"):
            in_head = False
        if name == "a":
            in_link = 0 if end else 1
            if linked and not end:
                linked.append(" ")
        elif name == "br":
            parts.append(" ")
        if name in BREAKS:
            close()
            prose = not end and (name in ("p", "blockquote", "pre") or name[0] == "h" and name[1:].isdigit())
            in_link = 0
        if name in HOLDERS:
            if end:
                depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0) if names[name] > 0 else 0
                if depth:
                    if name != "span":
                        close()
                    cut(depth)
            elif not closed:
                if name == "span" and not attributes:
                    push((name, *stack[-1][1:]))
                    continue
                _, main, frame, form, hint = stack[-1]
                hinted, apart = marks(attributes) if attributes and name not in ("body", "article", "main") else (False, False)
                if name == "span" and (hinted or apart):
                    close()
                inside = main or name in MAIN
                is_frame = apart or name in FRAME and not (name == "header" and inside)
                # What holds the main text as a whole says nothing about it.
                push((name, inside, frame or is_frame, (form or name == "form") and name not in MAIN, (hint or hinted) and name not in MAIN))
        elif name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td") and not end and attributes and any(marks(attributes)):
            prose = False
    close()
    return found


def with_neighbours(own: list[tuple]) -> np.ndarray:
    """One row of NAMES for each block: its own features and those of the blocks before and after it."""
    none = (0.0, 0.0)
    rows = []
    known = any(kind[2] for kind in own)
    for i, (words, links, *kind) in enumerate(own):
        before = own[i - 1][:2] if i else none
        after = own[i + 1][:2] if i + 1 < len(own) else none
        rows.append((words, links, *before, *after, *kind, float(known and not kind[0])))
    return np.array(rows, float).reshape(-1, len(NAMES))


# The labelled table: [+n] stands for a block of n words of main text, [-n] for n words of anything else.
LABELLED = (
    "<body><nav><ul><li><a>[-1]</a></li><li><a>[-2]</a></li></ul></nav><div class='ad'>[-12]</div><article><h1>[+6]</h1><p>[+40]</p><p>[+2]</p><p>[+90]</p></article><footer>[-9]</footer></body>",
    "<body><header><h1>[-3]</h1><p>[-14]</p></header><nav><a>[-1]</a> </nav><main><h1>[+5]</h1><p>[+60]</p><ul><li>[+4]</li><li>[+9]</li></ul><p>[+1]</p></main><aside><p>[-30]</p><a>[-4]</a></aside><footer><p>[-25]</p></footer></body>",
    "<body><div id='header'><h2>[-2]</h2></div><div id='menu'><a>[-1]</a></div><div id='content'><h1>[+7]</h1><p>[+33]</p><p>[+3]</p><blockquote>[+20]</blockquote></div><div id='sidebar'><h3>[-2]</h3><p>[-40]</p></div><div id='footer'>[-10]</div></body>",
    "<body><div class='cookie-notice'><p>[-35]</p></div><div class='post'><h2>[+4]</h2><p>[+70]</p><p>[+55]</p><div class='share'><a>[-1]</a></div></div><div class='comments'><h3>[-2]</h3><p>[-45]</p><p>[-12]</p></div></body>",
    "<body><article><h1>[+8]</h1><p>[+25]</p><aside><p>[-22]</p></aside><p>[+48]</p><div class='advert'><p>[-18]</p></div><p>[+5]</p><section class='comments'><h2>[-1]</h2><p>[-60]</p></section></article></body>",
    "<body><form><p>[-6]</p><label>[-2]</label></form><div><p>[+80]</p><p>[+64]</p><p>[+6]</p><p>[+50]</p></div><div><a>[-3]</a></div><div><a>[-2]</a> <a>[-2]</a></div></body>",
    "<body><div><a>[-2]</a></div><h1>[+6]</h1><p>[+30]</p><p>[+2]</p><p>[+75]</p><ul><li><a>[-4]</a></li><li><a>[-5]</a></li></ul><div>[-4]</div></body>",
    "<body><main><article><header><h1>[+9]</h1></header><p>[+44]</p><ol><li>[+12]</li><li>[+3]</li></ol><table><tr><td>[+2]</td><td>[+1]</td></tr></table><footer>[-5]</footer></article><nav><a>[-3]</a></nav></main></body>",
    "<body><div class='banner'>[-11]</div><div class='article-body'><p>[+15]</p><div>[+38]</div><p>[+4]</p><pre>[+22]</pre></div><div class='related'><p>[-16]</p><a>[-6]</a></div><div role='contentinfo'>[-20]</div></body>",
    "<body><article><p>[+1]</p><p>[+1]</p><h2>[+3]</h2><p>[+110]</p><p><a>[+3]</a></p><div>[+14]</div><form><p>[-10]</p></form></article><div id='disqus'><p>[-33]</p></div></body>",
    "<body><div class='newsletter'><h4>[-5]</h4><p>[-28]</p></div><section><h2>[+4]</h2><p>[+52]</p><p>[+18]</p></section><div>[-3]</div><div>[-7]</div></body>",
    "<body><article><h1>[+5]</h1><p>[+30]</p><p>[+61]",
    "<body><nav><a>[-2]</a></nav><main><h2>[+3]</h2><p>[+2]</p><div>[+21]",
    "<body><h1>[+4]</h1><p>[+26]</p><p>[+45]</p></body>",
    "<body><article><p>[+28]</p><ul><li>[+5]</li><li>[+3]</li></ul><div>[+1]</div></article></body>",
    "<body><article><div>[+2]</div></article></body>",
    "<body><p><a>[-2]</a></p><p><a>[-3]</a></p><h1>[+5]</h1><p>[+40]</p><p>[+24]</p><p><a>[-4]</a></p><p><a>[-6]</a></p></body>",
    "<body><div>[-2]</div><article><p>[+3]</p></article><div>[-3]</div></body>",
    # Pages that name nothing.
    "<body><div><div><a>[-1]</a></div><div><a>[-2]</a></div><div><a>[-1]</a></div></div><div><div>[+7]</div><div>[+55]</div><div>[+48]</div><div>[+4]</div><div>[+60]</div></div><div><div>[-6]</div><div>[-9]</div></div></body>",
    "<body><div><a>[-3]</a> <a>[-2]</a></div><div>[-9]</div><div>[-5]</div><div>[+9]</div><div>[+80]</div><div>[+22]</div><div>[+35]</div><div>[+3]</div><div>[+41]</div><div><a>[-4]</a></div><div>[-7]</div></body>",
    "<body><div><a>[-1]</a></div><div><div>[+5]</div><div>[+33]</div><div>[+27]</div></div><div><a>[-6]</a></div><div><a>[-5]</a></div><div>[-11]</div></body>",
    "<body><table><tr><td><a>[-2]</a></td><td><a>[-1]</a></td></tr></table><div>[-14]</div><div><a>[-2]</a></div><div>[+6]</div><div>[+120]</div><div>[+31]</div><div>[-4]</div><div><a>[-2]</a></div></body>",
    "<body><div>[+60]</div></body>",
    "<body><div>[+28]</div><div>[+31]</div><div>[+5]</div><div>[+29]</div></body>",
    "<body><div><a>[-8]</a> <a>[-9]</a> <a>[-12]</a> <a>[-7]</a></div><div>[+45]</div><div>[+5]</div><div>[+52]</div><div><a>[-15]</a> <a>[-14]</a></div><div>[-8]</div></body>",
    "<body><form><div><div>[+8]</div><p>[+60]</p><p>[+30]</p></div><div>[-3]</div><label>[-2]</label></form></body>",
    "<body><form><label>[-2]</label><p>[-9]</p><div>[-6]</div></form><p>[+50]</p><p>[+4]</p><p>[+44]</p></body>",
    "<body><div>[-12]</div><div>[-3]</div><div><a>[-2]</a></div><div>[-10]</div><div>[-5]</div><div><a>[-3]</a></div></body>",
    "<body><section><p>[+60]</p></section></body>",
    "<body><div><p>[-26]</p></div><article><h1>[+5]</h1><p>[+60]</p></article><div><p>[-31]</p><div>[-40]</div></div></body>",
    "<body><div>[-60]</div><main><p>[+12]</p><div>[+3]</div><section><p>[+60]</p></section></main></body>",
    "<body><div><p><a>[-9]</a></p><p>[+5]</p><p>[+34]</p><p>[+2]</p><p>[+1]</p><p>[+39]</p></div></body>",
    "<body><dialog><p>[-24]</p></dialog><article><div>[+60]</div><div>[+3]</div><ul><li>[+7]</li><li><a>[+2]</a></li></ul></article><div>[-10]</div><div>[-13]</div></body>",
)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled table."""
    spelled = lambda m: ("yes " if m[1] == "+" else "no ") + "w " * (int(m[2]) - 1)
    rows, labels = [], []
    for page in LABELLED:
        found = blocks(re.sub(r"\[([+-])(\d+)\]", spelled, page))
        rows.append(with_neighbours([own for _, own in found]))
        labels += [text.startswith("yes") for text, _ in found]
    return np.concatenate(rows), np.array(labels, float)


def grow(x: np.ndarray, y: np.ndarray, depth: int) -> tuple | float:
    """A binary tree by Gini impurity: (feature, threshold, not above, above), or the share of main text.

    Of equal splits the one of the earlier feature and the wider gap is taken.
    """
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):  # how long blocks are and what they link comes before what element they stand in
        values = np.unique(x[:, f])
        for low, high in zip(values, values[1:], strict=False):
            above = x[:, f] > (low + high) / 2
            impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[above], y[~above]))
            if best is None or impurity < best[0] - 1e-9:
                best = (impurity, f, (low + high) / 2, above)
    if best is None:
        return float(y.mean())
    _, f, threshold, above = best
    return f, threshold, grow(x[~above], y[~above], depth - 1), grow(x[above], y[above], depth - 1)


@lru_cache(maxsize=1)
def tree() -> tuple | float:
    return grow(*labelled(), 8)


def is_main(row: np.ndarray, node: tuple | float) -> bool:
    while isinstance(node, tuple):
        f, threshold, low, high = node
        node = high if row[f] > threshold else low
    return node >= 0.5


def main_text(page: str | None, node: tuple | float) -> str:
    """The main blocks of a page, joined by two line feeds; empty for null, empty or textless pages."""
    found = blocks(page or "")
    rows = with_neighbours([own for _, own in found])
    return "\n\n".join(text for (text, _), row in zip(found, rows, strict=True) if is_main(row, node))


def extract(pages: DataFrame, node: tuple | float | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of `pages`.

    The whole html is read; null counts as empty, and a page without main text gives an empty one. Rows
    that repeat an id are extracted each; ids and urls are passed on as they are, nulls too. No pages give
    no rows. Only page_id, url and html are read. `node` is a tree as `grow` gives it.
    """
    ship(pages.sparkSession)
    node = tree() if node is None else node
    rows = pages.select("page_id", "url", "html")

    def extracted(batches):
        for batch in batches:
            texts = [main_text(page.as_py(), node) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    out = rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars")).schema
    return rows.mapInArrow(extracted, out)


def op7_html(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, folder, "pages"))
