"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Words score positive, tags negative (by
tag name and by open or close); one linear scan (Kadane) finds the contiguous
run with the best score: the content region. The tag weights are learned
on labelled pages - pages whose author marked the content with an ``article``
or ``main`` element - by a structured perceptron: for every labelled page
the best run under the present weights is compared with the marked one, and
counts in the marked but not the found run are rewarded, the others punished;
tags never score above zero, words never below a floor. At most ``max_labelled`` pages
of at most ``max_labelled_chars`` characters each train it (a bounded sample by
hash); every page is then extracted whole.

The run is then fitted to the page's block structure: the smallest container
element that holds all of it is the content, so short first and last blocks,
which cannot pay for the tags around them, stay. Where that is the page itself, those
of its ``div`` parts that the run does not touch are not content. Inside the content, menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments (by element, role, or class and id) neither score nor count as text.
A class or id names such a part by its whole token or its head noun (``page-footer``,
``share-buttons``), not by any word in it (``social-impact``, ``has-sidebar``). Ids of
headings, paragraphs and other text elements are link targets and name nothing; ``html``,
``body``, ``main``, ``article`` and a layout box around nearly all of the page's words are
never such parts. The text of formulas (``math``) is text.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by one line feed.

Edge cases: null or empty html gives the empty text, as does a page without
words; unclosed and stray tags, comments, CDATA, quotes and ``<`` in text are taken as
browsers take them (but a quote that never closes does not swallow the rest), in time linear
in the page's length, and the end tags that may be left out (of p, li, dt, dd, option and the
parts of tables) are implied; a page without containers is one container. Repeated rows stay.
An empty table gives an empty result. Extra input columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscope.llm.common import clean_columns, prepare

MAX_LABELLED = 300
MAX_LABELLED_CHARS = 200_000
EPOCHS = 4

# HTML element classes and boilerplate vocabulary
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg",
       "select", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
        "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd",
          "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
          "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu",
          "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
          "th", "thead", "tr", "ul"}
CONTAINERS = {"article", "aside", "blockquote", "body", "center", "details", "dialog", "div", "dl",
              "fieldset", "figure", "footer", "form", "header", "html", "main", "menu", "nav", "ol",
              "section", "table", "tbody", "td", "th", "thead", "tfoot", "tr", "ul"}
#: Elements that are not containers, but whose end counts, as it may be left out.
IMPLIED = {"p", "li", "dt", "dd", "option", "math"}
#: Start tags that end an open p.
ENDS_P = BLOCKS - {"body", "br", "caption", "head", "html", "legend", "option"} | {"dir", "hgroup", "search"}
_P_BOUNDS = CONTAINERS | {"button"}
_SPECIAL = CONTAINERS - {"div"} | {"button", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6"}
_CELLS, _ROWS = {"td", "th", "caption"}, {"tbody", "thead", "tfoot"}
#: Start tag: the open elements that it ends, and those that hide elements further out from it.
ENDS = ({"li": ({"li"}, _SPECIAL - {"li"}), "option": ({"option"}, _SPECIAL)}
        | dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, _SPECIAL - {"dt", "dd"}))
        | dict.fromkeys(("td", "th"), (_CELLS, {"table", "tr"}))
        | {"tr": (_CELLS | {"tr"}, {"table"})}
        | dict.fromkeys(_ROWS, (_CELLS | _ROWS | {"tr"}, {"table"})))
#: What hides open elements of ``IMPLIED`` from their end tag.
SCOPES = {"table", "td", "th", "caption", "button"}
LISTS = {"ul", "ol", "menu"}
BOILERPLATE = {"nav", "menu", "header", "footer", "aside", "form", "head", "button", "dialog", "fieldset",
               "label", "annotation", "annotation-xml"}
#: Never boilerplate, whatever their attributes say.
CONTENT = {"html", "body", "main", "article"}
#: The page itself, as opposed to a part of it.
WHOLE = {"", "html", "body"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert",
         "alertdialog", "menu", "menubar", "form", "toolbar"}
NOISE = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner",
         "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie",
         "cookies", "discussion", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal",
         "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup",
         "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "share",
         "sharing", "sidebar", "sidenav", "signup", "social", "sponsor", "sponsored", "subscribe",
         "toolbar", "topbar", "widget"}
#: A class with one of these beside a noise word names a part of the content itself.
KEEP = {"article", "entry", "post", "content", "story", "main", "page"}
KEPT_NOISE = {"header"}
#: A first word that makes a class a state of the layout or a subject, not a part of the page.
STATES = {"has", "no", "with", "without", "is", "not", "hide", "hidden", "show", "category", "tag", "type",
          "format"}
#: Last words that say only that something is a part: the head noun is before them.
PARTS = {"area", "bar", "block", "body", "bottom", "box", "btn", "button", "card", "cell", "center", "col",
         "column", "container", "content", "count", "form", "frame", "group", "heading", "holder", "icon",
         "inner", "item", "label", "left", "link", "list", "main", "message", "outer", "overlay", "panel",
         "placeholder", "primary", "region", "right", "row", "secondary", "section", "slot", "space", "text",
         "thread", "title", "toggle", "top", "unit", "wrap", "wrapper", "zone"}
#: Nouns that a word of the second set makes a part of the boilerplate.
ITEMS = {"article", "link", "page", "post", "product", "reading", "story", "stories", "topic", "video"}
ADJECTIVES = {"related", "recommended", "sponsored", "promoted"}
#: Elements whose id is the target of a link to their text.
TEXT_ELEMENTS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "a", "span", "b", "strong", "em", "i", "code", "dt",
                 "dd", "td", "th", "tr", "caption", "figure", "figcaption", "blockquote", "pre", "summary"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "section"}
#: Words that, alone, are as well the title of a section of the text, or what a heading is called.
TITLES = {"advertising", "banner", "cookies", "discussion", "header", "masthead", "menu", "modal", "nav",
          "navigation", "notice", "notices", "promotion", "share", "sharing", "social", "toolbar", "widget"}
#: Reader comments may hold more words than the text they are about.
READERS = {"comment", "comments", "commentlist", "discussion", "disqus", "replies", "respond"}
#: A layout box holds at least so many words, and such a share of the page's, to be the page itself.
BULK_WORDS, BULK_SHARE = 50, 0.8

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute: its name, then perhaps a value in quotes or up to white space.
_PART = re.compile(r"[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(?:(?P<quote>[\"'])|[^\s>\"'][^\s>]*)?)?)?")
_COMMENT_END = re.compile(r"--!?>")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in sorted(RAW)}
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))?)?")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[^a-z]+")


def _head(token: str) -> tuple[list[str], str]:
    """Words of a class or id token up to its head noun, and the head noun if it is a noise word."""
    words = [w for w in _WORDS.split(token.split("--")[0]) if w]
    if not words or words[0] in STATES:
        return words, ""

    def one_of(word, names):
        return word in names or word.endswith("s") and word[:-1] in names

    while len(words) > 1 and words[-1] not in NOISE and (
            len(words[-1]) == 1 or one_of(words[-1], PARTS)
            or (one_of(words[-1], ITEMS) and words[-2] in ADJECTIVES)):
        words.pop()
    return words, words[-1] if one_of(words[-1], NOISE) else ""


def _noisy(name: str, attributes: str) -> int:
    """0: content; 1: boilerplate by class or id; 2: boilerplate by element or role, or reader comments."""
    if name in BOILERPLATE:
        return 2
    if not attributes or name in CONTENT:
        return 0
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key not in ("class", "id", "role") or (key == "id" and name in TEXT_ELEMENTS):
            continue
        value = (m[2] or m[3] or m[4] or "")
        value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()
        if key == "role":
            if value.strip() in ROLES:
                return 2
            continue
        for part in value.split():
            words, head = _head(part)
            if not head or (head in KEPT_NOISE and set(words) & KEEP):
                continue
            if name in HEADINGS and (key == "id" or name != "section"):
                # a slug of the section's title, or what the heading looks like
                if head in TITLES and not set(words[:-1]) & NOISE:
                    continue
            found = max(found, 2 if head in READERS else 1)
    return found


class Scanner:
    """The tags of one page in order, in time linear in its length.

    A tag ends at the first ``>`` that is not in a quoted attribute value, and quotes count
    only where a value starts, after ``=``. A quote that never closes starts no value. A tag
    or declaration that never ends is markup up to the end of the page."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def tag_end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` ends: the place of its ``>``, or the page's length."""
        page, n = self.page, len(self.page)
        if at > self.last[">"]:
            return n
        end = page.find(">", at)
        if page.find('"', at, end) < 0 and page.find("'", at, end) < 0:
            return end
        while at < n and page[at] != ">":
            m = _PART.match(page, at)
            at = m.end()
            quote = m["quote"]
            if quote and at <= self.last[quote]:
                at = page.find(quote, at) + 1
        return at

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, closing, attributes) of each tag; the name is empty for what
        holds neither text nor tags: comments, declarations and the like. Raw elements
        are one item with all they hold."""
        page, n, at = self.page, len(self.page), 0
        cdata = True
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                if page.startswith(("<!-->", "<!--->"), start):  # whole comments
                    at = page.find(">", start) + 1
                else:
                    m = _COMMENT_END.search(page, start + 4)
                    at = m.end() if m else n
                yield start, at, "", False, ""
                continue
            if cdata and page.startswith("<![CDATA[", start):
                end = page.find("]]>", start + 9)
                cdata = end >= 0  # none follows: the next ones are declarations too
                if cdata:
                    at = end + 3
                    yield start, at, "", False, ""
                    continue
            closing = page.startswith("/", start + 1)
            m = _NAME.match(page, start + 1 + closing)
            if m:
                name, end = m[0].lower(), self.tag_end(m.end())
                at, attributes = min(end + 1, n), page[m.end():end]
                if name in RAW:
                    if not closing and not attributes.rstrip().endswith("/"):
                        last = _RAW_ENDS[name].search(page, at)
                        at = min(self.tag_end(last.end()) + 1, n) if last else n
                    name = ""
                elif end == n:
                    name = ""
                yield start, at, name, closing, attributes
            elif closing and start + 2 < n or page.startswith(("!", "?"), start + 1):
                end = page.find(">", start + 1) if start < self.last[">"] else -1
                at = end + 1 if end >= 0 else n
                yield start, at, "", False, ""
            else:
                at = start + 1  # text


class Page:
    """Tokens of one page: text runs and tags with their container path."""

    __slots__ = ("texts", "names", "depths", "paths", "noise", "kinds")

    def __init__(self, page: str):
        self.texts: list[str] = []    # the text run ("" for a tag)
        self.names: list[str] = []    # the tag token ("" for a text run)
        self.noise: list[bool] = []   # inside boilerplate, once all of the page is read
        self.paths: list[int] = []    # id of the innermost open container
        parents = [-1]                # container tree; 0 is the page
        self.kinds = [""]             # name of the container
        stack: list[tuple[str, int, int]] = [("", 0, -1)]   # name, container, number of its span
        is_open: Counter = Counter()  # names on the stack
        spans: list[list[int]] = []   # boilerplate elements: first token, end, kind (see _noisy)
        at = 0
        for start, end, name, closing, attributes in Scanner(page).tags():
            if start > at:
                self._text(page[at:start], stack[-1][1])
            at = end
            if not name:
                continue
            token = f"/{name}" if closing else name
            if is_open["math"] and name in BLOCKS:  # an unclosed formula ends here
                self._close(stack, max(i for i, x in enumerate(stack) if x[0] == "math"), is_open, spans)
            if not closing:
                self._imply(name, stack, is_open, spans)
            formula = name == "math" or is_open["math"] > 0
            if not closing and name not in VOID:
                noisy = _noisy(name, attributes)
                if name in CONTAINERS or noisy or name in IMPLIED:
                    path = stack[-1][1]
                    if name in CONTAINERS or noisy:
                        parents.append(path)
                        self.kinds.append(name)
                        path = len(parents) - 1
                    stack.append((name, path, len(spans) if noisy else -1))
                    is_open[name] += 1
                    if noisy:
                        spans.append([len(self.texts), -1, noisy])
            elif closing and is_open[name]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        self._close(stack, i, is_open, spans)
                        break
                    if stack[i][0] in ("article", "main", "body") and name not in ("html", "body"):
                        break  # a stray end tag doesn't close the content
                    if name in IMPLIED and (stack[i][0] in SCOPES or name == "li" and stack[i][0] in LISTS):
                        break
            if formula:
                continue  # a formula's tags are part of its text
            self.texts.append("")
            self.names.append(token)
            self.paths.append(stack[-1][1])
        if at < len(page):
            self._text(page[at:], stack[-1][1])
        self._close(stack, 1, is_open, spans)
        self.depths = parents
        self._mark(spans)

    def _text(self, text: str, path: int) -> None:
        self.texts.append(text)
        self.names.append("")
        self.paths.append(path)

    def _imply(self, name: str, stack: list[tuple[str, int, int]], is_open: Counter,
               spans: list[list[int]]) -> None:
        """Ends the elements whose end tag the start tag ``name`` implies."""
        ended, hidden = ENDS.get(name, ((), ()))
        for names, bounds in ((ended, hidden), (("p",) if name in ENDS_P else (), _P_BOUNDS)):
            if not any(is_open[x] for x in names):
                continue
            first = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    first = i
                elif stack[i][0] in bounds:
                    break
            if first:
                self._close(stack, first, is_open, spans)

    def _close(self, stack: list[tuple[str, int, int]], i: int, is_open: Counter,
               spans: list[list[int]]) -> None:
        """Ends the open elements from the ``i``-th on before the next token."""
        for name, _, span in stack[i:]:
            is_open[name] -= 1
            if span >= 0:
                spans[span][1] = len(self.texts)
        del stack[i:]

    def _mark(self, spans: list[list[int]]) -> None:
        """``noise``, from the boilerplate elements without those that hold the page itself."""
        self.noise = self._covered(x for x in spans if x[2] == 2)
        if any(x[2] == 1 for x in spans):
            before = [0]
            for text, noisy in zip(self.texts, self.noise):
                before.append(before[-1] + (0 if noisy else len(text.split())))
            least = max(BULK_WORDS, BULK_SHARE * before[-1])
            marked = labelled_run(self)

            def whole(a, b):
                return before[b] - before[a] >= least and (marked is None or a < marked[0] <= b)

            self.noise = self._covered(x for x in spans if x[2] == 2 or not whole(x[0], x[1]))

    def _covered(self, spans) -> list[bool]:
        change = [0] * (len(self.texts) + 1)
        for a, b, _ in spans:
            change[a] += 1
            change[b] -= 1
        return [x > 0 for x in accumulate(change[:-1])]

    def scores(self, weights: dict[str, float]) -> list[float]:
        word = weights[""]
        other = weights["*"]
        return [len(t.split()) * word if not x and not b else (0.0 if not x else weights.get(x, other))
                for t, x, b in zip(self.texts, self.names, self.noise)]

    def within(self, paths: set[int]) -> list[bool]:
        """By container: does it belong to the innermost container that holds all of ``paths``?
        Where that is the page itself, its ``div`` parts that hold none of them don't."""
        held = [0] * len(self.depths)
        for path in paths:
            held[path] = 1
        inside = len(held) - 1
        while held[inside] < len(paths):  # children are numbered after their parents
            held[self.depths[inside]] += held[inside]
            inside -= 1
        whole = self.kinds[inside] in WHOLE
        out = [False] * len(held)
        out[inside] = True
        for path in range(inside + 1, len(held)):
            parent = self.depths[path]
            out[path] = out[parent] and not (
                whole and parent == inside and not held[path] and self.kinds[path] == "div")
        return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the maximum-scoring contiguous run (empty if none is
    positive); the earliest of equal runs."""
    best, run, start, span = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0.0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, span = run, (start, i + 1)
    return span


def labelled_run(page: Page) -> tuple[int, int] | None:
    """The run inside the page's one article (or main) element."""
    for name in ("article", "main"):
        if page.names.count(name) == 1:
            a = page.names.index(name) + 1
            rest = page.names[a:]
            return a, a + (rest.index(f"/{name}") if f"/{name}" in rest else len(rest))
    return None


def train(pages: list[str], epochs: int = EPOCHS) -> dict[str, float]:
    """Structured perceptron on labelled pages: weight by token; "" is a word, "*" any other tag."""
    weights: dict[str, float] = {"": 1.0, "*": -1.0}
    parsed = [(p, run) for p in map(Page, pages) if (run := labelled_run(p))]
    for epoch in range(epochs):
        rate = 1.0 / (1 + epoch)
        for page, (a, b) in parsed:
            x, y = best_run(page.scores(weights))
            if (x, y) == (a, b):
                continue
            change: Counter = Counter()
            for lo, hi, sign in ((a, b, 1), (x, y, -1)):
                for t, tag, noisy in zip(page.texts[lo:hi], page.names[lo:hi], page.noise[lo:hi]):
                    if tag:
                        change[tag] += sign
                    elif not noisy:
                        change[""] += sign * len(t.split())
            words = change.pop("", 0)
            weights[""] = max(0.5, weights[""] + 0.001 * rate * words)
            for tag, c in change.items():
                old = weights.get(tag, weights["*"])
                weights[tag] = min(-0.05, old + rate * max(-5, min(5, c)))
    return weights


def extract(page_html: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    if not page_html:
        return ""
    page = Page(page_html)
    a, b = best_run(page.scores(weights))
    words = [i for i in range(a, b) if not page.names[i] and not page.noise[i] and page.texts[i].strip()]
    if not words:
        return ""
    within = page.within({page.paths[i] for i in words})
    blocks: list[list[str]] = [[]]
    for text, name, noisy, path in zip(page.texts, page.names, page.noise, page.paths):
        if name:
            if name.lstrip("/") in BLOCKS:
                blocks.append([])
        elif not noisy and within[path]:
            blocks[-1].append(text)
    lines = (_SPACE.sub(" ", html_lib.unescape("".join(x))).strip() for x in blocks if x)
    return "\n".join(x for x in lines if x)


def learn_weights(pages: DataFrame, max_labelled: int = MAX_LABELLED,
                  max_chars: int = MAX_LABELLED_CHARS, epochs: int = EPOCHS) -> dict[str, float]:
    """Weights from a bounded sample of labelled pages (``html`` with an article or main element)."""
    labelled = (pages.filter(F.length("html") <= max_chars)
                .filter(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
                .withColumn("_h", F.xxhash64("url", "page_id", "html")))
    # hashes first, so that the pages of the sample alone reach the driver
    wanted = [r["_h"] for r in labelled.select("_h").distinct().orderBy("_h").limit(max_labelled).collect()]
    rows = labelled.filter(F.col("_h").isin(wanted)).select("_h", "html").dropDuplicates(["_h"]).collect()
    rows.sort(key=lambda r: r["_h"])
    return train([r["html"] for r in rows], epochs)


def extract_pages(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    prepare(pages.sparkSession)
    rows = clean_columns(pages, "page_id", "url", "html")
    weights = weights or learn_weights(rows)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()),
                        ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), weights) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()),
                 pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                schema=schema)

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
