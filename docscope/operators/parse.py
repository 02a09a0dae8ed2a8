"""Page parsing: the one step that runs Python in the workers.

``parse_pages`` maps each HTML page to a struct of title text, first ``h1``,
meta tags, the chosen main-content node's text and its cleaned HTML cut into
``parts`` at every ``a[href]`` / ``img[src]`` value. Everything after it (title
cleanup, meta lookup, link and image rewriting, joins) is native Spark.

The tree follows the lenient rules of a streaming HTML tree builder: void
elements never nest, an end tag closes the most recent open element of that
name (and everything opened inside it), a stray end tag is ignored, and
elements left open end where their parent ends.
"""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser
from typing import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The parser runs in the Python workers. Its functions are shipped by value
# with the task (this module needs only the standard library, pandas and
# pyspark there), so executors need no copy of this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values that must equal the reference's behaviour:
# content selectors tried in this order, the minimum stripped-text length a
# candidate needs, tags removed below the content node, and the class pattern
# (substring, case-insensitive) of removed elements.
CONTENT_SELECTORS = ["main", "article", '[role="main"]', "div.content", "div.topic", "div.body"]
MIN_CONTENT_CHARS = 150
STRIP_TAGS = ["script", "style", "nav", "header", "footer", "noscript", "form"]
STRIP_CLASS = re.compile(r"(sidebar|breadcrumb|toc|cookie|feedback)", re.I)

# Elements without content, and elements whose text is not document text.
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link meta param source track wbr "
    "basefont bgsound command frame image isindex menuitem nextid spacer".split())
NON_TEXT_TAGS = frozenset({"script", "style", "template"})

PART = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
META = T.StructType([T.StructField("attr", T.StringType()), T.StructField("name", T.StringType()),
                     T.StructField("content", T.StringType())])
PARSED = T.StructType([
    T.StructField("title_raw", T.StringType()),
    T.StructField("h1", T.StringType()),
    T.StructField("metas", T.ArrayType(META)),
    T.StructField("content_node", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("parts", T.ArrayType(PART)),
    T.StructField("error", T.StringType()),
])

# one attribute of a start tag: name, and its value with quotes if it has one
_ATTRIBUTE = re.compile(r"""([^\s=/"'>][^\s=/>]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent", "start", "inner_start", "inner_end", "end")

    def __init__(self, tag, attrs, parent, start, inner_start):
        self.tag = tag
        self.attrs = attrs
        self.children = []
        self.parent = parent
        self.start = start
        self.inner_start = inner_start
        self.inner_end = None
        self.end = None

    def classes(self):
        c = self.attrs.get("class")
        return c.split() if c else []


class _Text:
    __slots__ = ("text", "comment")

    def __init__(self, text, comment=False):
        self.text = text
        self.comment = comment


class _TreeBuilder(HTMLParser):
    def __init__(self, src: str):
        super().__init__(convert_charrefs=True)
        self.src = src
        self._line_starts = [0]
        for m in re.finditer("\n", src):
            self._line_starts.append(m.end())
        self.root = _Node("[document]", {}, None, 0, 0)
        self.stack = [self.root]

    def _offset(self):
        line, col = self.getpos()
        return self._line_starts[line - 1] + col

    def handle_starttag(self, tag, attrs):
        start = self._offset()
        raw = self.get_starttag_text() or ""
        parent = self.stack[-1]
        # of a repeated attribute the last value counts
        node = _Node(tag, dict(attrs), parent, start, start + len(raw))
        parent.children.append(node)
        if tag in VOID_TAGS:
            node.inner_end = node.end = node.inner_start
        else:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and self.stack[-1].tag == tag:
            node = self.stack.pop()
            node.inner_end = node.end = node.inner_start

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                pos = self._offset()
                close = self.src.find(">", pos)
                end = len(self.src) if close < 0 else close + 1
                while len(self.stack) > i:
                    node = self.stack.pop()
                    # elements left open inside end where this end tag begins
                    node.inner_end = pos
                    node.end = end if len(self.stack) == i else pos
                return

    def handle_data(self, data):
        self.stack[-1].children.append(_Text(data))

    def handle_comment(self, data):
        self.stack[-1].children.append(_Text(data, comment=True))

    def finish(self):
        """The tree as built so far; elements still open end with the source."""
        n = len(self.src)
        while len(self.stack) > 1:
            node = self.stack.pop()
            node.inner_end = node.end = n
        self.root.inner_end = self.root.end = n
        return self.root


def _iter_elements(node):
    """Elements below ``node`` in document order, however deep they nest."""
    todo = [c for c in reversed(node.children) if isinstance(c, _Node)]
    while todo:
        c = todo.pop()
        yield c
        todo.extend(x for x in reversed(c.children) if isinstance(x, _Node))


def _strings(node, skip=None):
    """Document text strings under ``node`` in order, skipping removed subtrees."""
    todo = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, _Text):
            if not c.comment:
                yield c.text
        elif c.tag not in NON_TEXT_TAGS and (skip is None or id(c) not in skip):
            todo.extend(reversed(c.children))


def _stripped(node, skip=None):
    return [s for s in (x.strip() for x in _strings(node, skip)) if s]


def _matches(el, sel):
    if sel == '[role="main"]':
        return el.attrs.get("role") == "main"
    if "." in sel:
        tag, cls = sel.split(".", 1)
        return el.tag == tag and cls in el.classes()
    return el.tag == sel


def _title_string(node):
    """Text of an element that holds exactly one string (through single children)."""
    while True:
        if len(node.children) != 1:
            return None
        c = node.children[0]
        if isinstance(c, _Text):
            return None if c.comment else c.text
        node = c


def _kept_elements(node, removed):
    """(kept, removed) elements below ``node``; of removed subtrees only the top."""
    kept, tops = [], []
    todo = [c for c in reversed(node.children) if isinstance(c, _Node)]
    while todo:
        c = todo.pop()
        if id(c) in removed:
            tops.append(c)
            continue
        kept.append(c)
        todo.extend(x for x in reversed(c.children) if isinstance(x, _Node))
    return kept, tops


def _value_span(src, el, attr):
    """(start, end, has value) of the last ``attr`` in the element's start tag."""
    name_end = el.start + 1 + len(el.tag)
    span = None
    for m in _ATTRIBUTE.finditer(src, name_end, el.inner_start - 1):
        if m[1].lower() == attr:
            span = (m.start(2), m.end(2), True) if m[2] is not None else (m.end(1), m.end(1), False)
    return span


def _cut_parts(src, node, removed):
    """Source of ``node``'s interior minus removed subtrees, cut at link/image values."""
    kept, tops = _kept_elements(node, removed)
    events = [(e.start, e.end, None, None, True) for e in tops]
    for el in kept:
        attr = "href" if el.tag == "a" else "src" if el.tag == "img" else None
        if attr is not None and attr in el.attrs and (span := _value_span(src, el, attr)):
            events.append((span[0], span[1], attr, el.attrs[attr] or "", span[2]))
    events.sort(key=lambda e: e[:2])
    parts = []
    pos = node.inner_start if node.parent is not None else 0
    end = node.inner_end if node.parent is not None else len(src)
    for s, e, kind, value, has_value in events:
        if s < pos:
            continue
        if s > pos:
            parts.append(("html", src[pos:s]))
        if kind is not None:
            if not has_value:  # a bare attribute gets the value it stands for
                parts.append(("html", "="))
            parts.append((kind, value))
        pos = e
    if pos < end:
        parts.append(("html", src[pos:end]))
    return [{"kind": k, "value": v} for k, v in parts]


def parse_html(html: str | None) -> dict:
    """Parse one page; returns a dict shaped like ``PARSED``. A page that the tokenizer
    gives up on keeps what was built before, and says so in ``error``."""
    src = html or ""
    tb = _TreeBuilder(src)
    error = None
    try:
        tb.feed(src)
        tb.close()
    except Exception as e:  # noqa: BLE001 - reported per page
        error = f"{type(e).__name__}: {e}"[:200]
    root = tb.finish()
    elements = list(_iter_elements(root))

    title_el = next((e for e in elements if e.tag == "title"), None)
    title_raw = _title_string(title_el) if title_el is not None else None
    h1_el = next((e for e in elements if e.tag == "h1"), None)
    h1 = "".join(_stripped(h1_el)) if h1_el is not None else None
    metas = []
    for e in elements:
        if e.tag != "meta":
            continue
        for attr in ("name", "property"):
            if attr in e.attrs:
                metas.append({"attr": attr, "name": e.attrs[attr], "content": e.attrs.get("content")})

    node, which = None, None
    for sel in CONTENT_SELECTORS:
        el = next((e for e in elements if _matches(e, sel)), None)
        if el is not None and len("".join(_stripped(el))) > MIN_CONTENT_CHARS:
            node, which = el, sel
            break
    if node is None:
        body = next((e for e in elements if e.tag == "body"), None)
        node, which = (body, "body") if body is not None else (root, "document")

    removed = set()
    for e in _iter_elements(node):
        c = e.attrs.get("class")
        if e.tag in STRIP_TAGS or c and STRIP_CLASS.search(" ".join(c.split())):
            removed.add(id(e))
    text = " ".join(_stripped(node, removed))
    return {"title_raw": title_raw, "h1": h1, "metas": metas, "content_node": which,
            "text": text, "parts": _cut_parts(src, node, removed), "error": error}


def parse_pages(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add a ``page`` struct column (``PARSED``) computed from ``html_col``.

    One Arrow batch at a time per task; the HTML column is dropped from the
    output so the wide text is not carried further than needed.

    Pages are parsed in the partitions they come in: split a scan of few large
    files with ``spark.sql.files.maxPartitionBytes``.
    """
    keep = [c for c in (keep or df.columns) if c != html_col]
    out_schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("page", PARSED)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keep].copy()
            out["page"] = [parse_html(h) for h in b[html_col]]
            yield out

    return df.select(*keep, html_col).mapInPandas(run, out_schema)
