"""HTML to a flat list of content nodes: the one place where a page is read token by token.

The helper only finds block boundaries, inline marks and cells. Choosing the content root, dropping
boilerplate and rendering markdown are Spark expressions over the node array (``operators.extract``).
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

_NODE_ARROW = pa.struct([
    ("kind", pa.string()), ("level", pa.int32()), ("ordinal", pa.int32()), ("list_no", pa.int32()),
    ("in_root", pa.bool_()), ("unsure", pa.bool_()), ("text", pa.string()), ("linked", pa.int32()),
    ("rows", pa.list_(pa.list_(pa.string()))),
])
_NODES_ARROW = pa.list_(_NODE_ARROW)
_MATCHES_ARROW = pa.list_(pa.struct([("nodes", _NODES_ARROW), ("content", pa.string())]))

# Quotes count behind an equals sign only, and a tag ends before the next "<": no opener is scanned for twice.
_ATTRS = r"(?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea)(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-z][^\s/<>]*+)(?P<attrs>{_ATTRS})>"
    r"|(?P<text><?[^<]++|<)", re.S | re.I)
_ATTR = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_BLANKS = re.compile(r"[ \t\r\n\f\v]+")

_VOID = frozenset({
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
})
_NOISE = frozenset({"head", "title", "nav", "header", "footer", "aside", "button", "select"})
# Elements whose end tag also closes what stands open inside them; cells and tables hide what is outside.
_CELLS = frozenset({"table", "caption", "td", "th"})
_SCOPES = _NOISE | _CELLS | frozenset({
    "html", "body", "main", "article", "section", "div", "form", "fieldset", "details", "figure", "center",
    "address", "ul", "ol", "dl", "blockquote",
})
# What an element without an end tag may still hold; anything else ends it.
_HEAD_TAGS = frozenset({"title", "meta", "link", "base"})
_SELECT_TAGS = frozenset({"option", "optgroup", "hr"})
_HEADINGS = {f"h{n}": n for n in range(1, 7)}
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "tt": "`", "kbd": "`",
          "s": "~~", "strike": "~~", "del": "~~", "a": ""}
_CODE = frozenset(("code", "tt", "kbd"))
_BREAKS = frozenset({
    "p", "div", "section", "article", "main", "body", "ul", "ol", "dl", "dt", "dd", "figure", "figcaption",
    "details", "summary", "address", "hr", "blockquote", "table", "caption", "pre", "li", "tr", "td", "th",
}) | _HEADINGS.keys()


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def _signs(text: str) -> int:
    return len("".join(text.split()))


class _Page:
    """Collects the nodes of one page."""

    def __init__(self) -> None:
        self.nodes: list[dict] = []
        self.roots: list[list] = []     # open content-root elements: [tag, elements of its kind]
        self.unsure = False             # behind the start tag of noise that lacks an end tag
        self.lists: list[list] = []     # [ordered, items so far] per open list
        self.list_no = 0
        self.rows: list[list[str]] | None = None
        self.tables = 0
        self.start("para")

    def start(self, kind: str, level: int = 0, ordinal: int = 0) -> None:
        self.kind, self.level, self.ordinal = kind, level, ordinal
        self.parts: list[str] = []
        self.marks: list[tuple[str, int, str, int]] = []    # tag, first part, link target, linked before
        self.linked = 0

    def flush(self, kind: str = "para", level: int = 0, ordinal: int = 0) -> None:
        """Close the open block and start the next one."""
        while self.marks:
            self.close_mark(self.marks[-1][0])
        text = "".join(self.parts)
        text = text if self.kind == "code" else text.strip()
        if text.strip():
            self.emit(text)
        self.start(kind, level, ordinal)

    def emit(self, text: str, rows: list | None = None) -> None:
        self.nodes.append({
            "kind": self.kind, "level": self.level, "ordinal": self.ordinal,
            "list_no": self.list_no if self.kind == "item" else 0,
            "in_root": bool(self.roots), "unsure": self.unsure, "text": text, "linked": self.linked, "rows": rows})

    def text(self, raw: str) -> None:
        text = entities.unescape(raw)
        verbatim = self.kind == "code" or any(mark[0] in _CODE for mark in self.marks)
        if not verbatim:
            text = _BLANKS.sub(" ", text)
            if text[:1] == " " and self.parts and self.parts[-1][-1:].isspace():
                text = text[1:]     # blanks also collapse across inline elements
        self.parts.append(text)

    def close_mark(self, tag: str) -> None:
        """Render the open marks down to ``tag``; ``linked`` counts the signs that stand inside links."""
        while self.marks:
            name, at, target, linked = self.marks.pop()
            inner = "".join(self.parts[at:])
            body = inner.strip()
            if name in _CODE:
                if "\n" in inner and self.kind == "para" and not "".join(self.parts[:at]).strip():
                    self.kind, self.parts = "code", [inner]
                    self.flush()
                    return
                body = f"`{inner}`" if inner else ""
            elif name == "a":
                body = f"[{body or target}]({target})" if target else body
            elif body:
                body = _MARKS[name] + body + _MARKS[name]
            if name == "a" or (body and self.linked - linked == _signs(inner)):
                self.linked = linked + _signs(body)
            if inner and name not in _CODE:     # blanks stay outside the marks
                lead, tail = inner[:len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()):]
                body = lead + body + (tail if inner.strip() else "")
            self.parts[at:] = [body]
            if name == tag:
                return

    def separate(self) -> None:
        """A block boundary inside an item, quote or cell is only a line break."""
        while self.marks:
            self.close_mark(self.marks[-1][0])
        if "".join(self.parts[-1:]).strip():
            self.parts.append("\n")

    def gap(self) -> None:
        """Cells of a table inside a cell become words of that cell."""
        if self.parts and not self.parts[-1][-1:].isspace():
            self.parts.append(" ")

    def cell_done(self) -> None:
        while self.marks:
            self.close_mark(self.marks[-1][0])
        if self.kind == "cell":
            self.rows[-1].append("".join(self.parts))
        linked = self.linked
        self.start("rowgap")
        self.linked = linked

    def open(self, tag: str, attrs: dict[str, str]) -> None:
        if self.kind == "code":
            return
        if tag in ("main", "article") or attrs.get("role") == "main":
            self.flush()
            self.roots.append([tag, 1])
        elif self.rows is not None:
            self.open_in_table(tag, attrs)
        elif tag == "br":
            self.parts.append("\n")
        elif tag in _MARKS:
            self.marks.append((tag, len(self.parts), attrs.get("href", ""), self.linked))
        elif tag in _HEADINGS:
            self.flush("heading", _HEADINGS[tag])
        elif tag in ("ul", "ol"):
            self.flush()
            self.list_no += not self.lists
            self.lists.append([tag == "ol", 0])
        elif tag == "li":
            top = self.lists[-1] if self.lists else [False, 0]
            top[1] += 1
            self.flush("item", max(len(self.lists) - 1, 0), top[1] if top[0] else 0)
        elif tag == "pre":
            self.flush("code")
        elif tag == "blockquote":
            self.flush("quote")
        elif tag == "table":
            self.flush("rowgap")
            self.rows, self.tables = [], 1
        elif tag in _BREAKS:
            if self.kind in ("item", "quote"):
                self.separate()
            else:
                self.flush()

    def open_in_table(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "table":
            self.tables += 1
            self.gap()
        elif self.tables > 1 and tag in _BREAKS:
            self.gap()
        elif tag == "tr":
            self.cell_done()
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell_done()
            if not self.rows:
                self.rows.append([])
            self.kind = "cell"
        elif tag == "br":
            self.parts.append("\n")
        elif tag in _MARKS:
            self.marks.append((tag, len(self.parts), attrs.get("href", ""), self.linked))
        elif tag in _BREAKS:
            self.separate()

    def close(self, tag: str) -> None:
        if self.kind == "code":
            if tag == "pre":
                self.flush()
        elif self.rows is not None:
            if tag == "table":
                self.tables -= 1
                if not self.tables:
                    self.table_done()
                else:
                    self.gap()
            elif tag in _MARKS and any(m[0] == tag for m in self.marks):
                self.close_mark(tag)
            elif self.tables > 1 and tag in _BREAKS:
                self.gap()
            elif tag in ("td", "th", "tr"):
                self.cell_done()
        elif tag in _MARKS:
            if any(m[0] == tag for m in self.marks):
                self.close_mark(tag)
        elif tag in ("ul", "ol"):
            self.flush()
            if self.lists:
                self.lists.pop()
        elif tag in ("p", "div") and self.kind in ("item", "quote"):
            self.separate()
        elif tag in _BREAKS:
            self.flush()
        if self.roots and tag == self.roots[-1][0]:
            self.roots[-1][1] -= 1
            if not self.roots[-1][1]:
                self.flush()
                self.roots.pop()

    def table_done(self) -> None:
        self.cell_done()
        rows, self.rows = [r for r in self.rows if r], None
        self.kind = "table"
        if rows:
            self.emit("\n".join("\t".join(r) for r in rows), rows)
        self.start("para")

    def finish(self) -> list[dict]:
        if self.rows is not None:
            self.table_done()
        self.flush()
        return self.nodes


def noise_ends(tokens: list[re.Match]) -> dict[int, tuple[int, bool]]:
    """Where each noise element ends, by the number of its start tag, and whether by its own end tag.

    Every structural element is on a stack; an end tag also closes what was left open inside its element, and
    inside a cell nothing outside the table can be closed. Each element is pushed and popped once.
    """
    ends: dict[int, tuple[int, bool]] = {}
    stack: list[tuple[str, int]] = []
    scopes: list[dict[str, int]] = [{}]     # open elements by tag, anew inside every cell
    cells: dict[str, int] = {}
    for no, token in enumerate(tokens):
        tag = token["tag"] and token["tag"].lower()
        if tag not in _SCOPES:
            continue
        if not token["end"]:
            stack.append((tag, no))
            if tag in _CELLS:
                cells[tag] = cells.get(tag, 0) + 1
                scopes.append({})
            else:
                scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
        elif (cells if tag in _CELLS else scopes[-1]).get(tag):
            name = ""
            while name != tag:
                name, start = stack.pop()
                if name in _CELLS:
                    cells[name] -= 1
                    scopes.pop()
                else:
                    scopes[-1][name] -= 1
                if name in _NOISE:
                    ends[start] = no, name == tag
    for name, start in stack:
        if name in _NOISE:
            ends[start] = len(tokens), False
    return ends


def _ends_noise(noise: str, token: re.Match) -> bool:
    """Whether noise without an end tag stops before this token."""
    if token["tag"] is None:
        return noise == "head" and bool((token["text"] or "").strip())
    tag = token["tag"].lower()
    if noise == "head":
        return tag not in _HEAD_TAGS and tag != "head"
    if noise == "select":
        return tag not in _SELECT_TAGS and not (token["end"] and tag == "select")
    return noise == "title" or tag in _BREAKS or tag in _SCOPES


def page_nodes(text: str) -> list[dict]:
    """Content nodes of an HTML text in document order.

    Text between the start and end tag of a noise element is dropped, unless the body or a content root begins
    there. Without an end tag, ``head`` holds its own elements only, ``select`` its options, ``title`` and ``button``
    the text up to the next block; what follows an unclosed ``nav``, ``aside``, ``header`` or ``footer`` up to the
    end of the element around it is kept as ``unsure``.
    """
    page, tokens = _Page(), list(_TOKEN.finditer(text))
    ends = noise_ends(tokens)
    until = -1          # the end tag of the noise at hand
    short = ""          # noise without an end tag that stops by itself
    unsure = -1         # where the element around noise without an end tag ends
    pending: list[str] = []
    for no, token in enumerate(tokens):
        tag = token["tag"]
        if short and until < no and _ends_noise(short, token):
            short = ""
        if tag is None:
            if token["text"] and until < no and not short:
                pending.append(token["text"])
            continue
        if pending:
            page.text("".join(pending))
            pending.clear()
        tag, end = tag.lower(), token["end"]
        if until >= no or short:
            if not end and (tag in ("body", "main", "article")
                            or "role" in token["attrs"] and _attributes(token["attrs"]).get("role") == "main"):
                until, short = -1, ""
            else:
                if short == "head" and tag == "title" and not end:
                    until, short = (ends[no][0], short) if ends[no][1] else (until, "title")
                continue
        if page.unsure and no >= unsure:
            if page.rows is None:
                page.flush()
            page.unsure = False
        if end:
            if tag not in _NOISE:
                page.close(tag)
        elif tag in _NOISE and not (page.roots and tag == "header"):
            if page.rows is None and tag not in ("button", "select"):   # controls stand inside a line, a table keeps its cells
                page.flush()
            stop, closed = ends[no]
            if closed:
                until = stop
            elif tag in ("head", "title", "select", "button"):
                short = tag
            else:
                unsure, page.unsure = max(unsure, stop), True
        else:
            roots = len(page.roots)
            page.open(tag, _attributes(token["attrs"]) if token["attrs"] else {})
            if len(page.roots) > roots:
                page.unsure = False     # a content root is no part of the noise before it
            elif page.roots and tag == page.roots[-1][0]:
                page.roots[-1][1] += 1  # an element of the root's own kind inside it
    if pending:
        page.text("".join(pending))
    return page.finish()


# Selectors are tag, .class and [role='…'] compounds, optionally below an ancestor compound.
_COMPOUND = re.compile(r"([a-z0-9]*)((?:\.[\w-]+)*)(?:\[role='(\w+)'\])?")


def _matches(selector: str, element: tuple[str, str, str]) -> bool:
    tag, classes, role = _COMPOUND.fullmatch(selector).groups()
    return ((not tag or tag == element[0]) and set(classes.split(".")[1:]) <= set(element[1].split())
            and (not role or role == element[2]))


def subtree(text: str, selector: str) -> str | None:
    """HTML of the first element the selector matches."""
    *above, wanted = selector.split()
    path: list[tuple[str, str, str]] = []
    start, nested, root = None, 0, ""
    for token in _TOKEN.finditer(text):
        if token["tag"] is None:
            continue
        tag = token["tag"].lower()
        if start is not None:
            nested += (tag == root) * (-1 if token["end"] else 1)
            if not nested:
                return text[start:token.end()]
        elif token["end"]:
            while any(e[0] == tag for e in path) and path.pop()[0] != tag:
                pass
        else:
            attrs = _attributes(token["attrs"])
            element = (tag, attrs.get("class", ""), attrs.get("role", ""))
            if _matches(wanted, element) and all(any(_matches(a, e) for e in path) for a in above):
                start, nested, root = token.start(), 1, tag
            elif tag not in _VOID:
                path.append(element)
    return None if start is None else text[start:]


def text_content(text: str) -> str:
    return "".join(entities.unescape(t["text"]) for t in _TOKEN.finditer(text) if t["text"])


def nodes_or_error(text: str) -> list[dict]:
    """Nodes of a page; one page that cannot be read becomes an ``error`` node and fails alone."""
    try:
        return page_nodes(text)
    except Exception as error:
        return [{"kind": "error", "level": 0, "ordinal": 0, "list_no": 0, "in_root": False, "unsure": False,
                 "text": f"{type(error).__name__}: {error}", "linked": 0, "rows": None}]


@F.arrow_udf(from_arrow_type(_NODES_ARROW))
def html_nodes(html: pa.Array) -> pa.Array:
    return pa.array([None if v is None else nodes_or_error(v) for v in html.to_pylist()], _NODES_ARROW)


@F.arrow_udf(from_arrow_type(_MATCHES_ARROW))
def selected_nodes(html: pa.Array, selectors: pa.Array) -> pa.Array:
    """Nodes and raw text of the first match of every selector, in selector order; no match is skipped."""
    out = []
    for text, wanted in zip(html.to_pylist(), selectors.to_pylist()):
        found = [subtree(text or "", s) for s in wanted or []]
        out.append([{"nodes": nodes_or_error(f), "content": text_content(f)} for f in found if f is not None])
    return pa.array(out, _MATCHES_ARROW)
