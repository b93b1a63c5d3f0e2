"""Turn one HTML page into numbered nodes.

A page becomes rows in document order. ``pre`` is a node's position, ``last`` the
position of the last node in its subtree, so "x lies inside y" is
``y.pre < x.pre <= y.last`` (pre-order interval encoding, Grust, SIGMOD 2002).
All rules over the nodes are Spark expressions; this module only does the part SQL
cannot: matching start and end tags with a stack.
"""

from __future__ import annotations

import re
from html import unescape

# Groups: comment, end tag, start tag, attributes, whether it is complete, other markup.
TOKEN = re.compile(
    r"<(?:"
    r"!--(.*?)(?:-->|\Z)"
    r"|/([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|([A-Za-z][^\s/>]*)"
    r"((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)(>|\Z)"
    r"|[!?/]([^>]*)(?:>|\Z)"
    r")",
    re.S,
)
ATTRIBUTE = re.compile(
    r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S
)
UNQUOTED_END = re.compile(r"=\s*[^\s\"'][^\s]*\Z")  # a final "/" then belongs to the value
# In attribute values a reference without ";" is not one when "=" or a letter follows.
ATTRIBUTE_REFERENCE = re.compile(
    r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9])))"
)
ASCII_BLANK = " \t\n\r\f"

VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex "
    "keygen link menuitem meta nextid param source spacer track wbr".split()
)
RAW_TEXT = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "title", "textarea", "xmp")}
DECODED_RAW = frozenset(("title", "textarea"))
STRING_CONTAINERS = frozenset(("script", "style", "template", "rt", "rp"))
KEEP_BLANKS = frozenset(("pre", "textarea"))
HEAD_TAGS = frozenset(("script", "style", "meta", "link", "title", "base"))
FRAME_TAGS = frozenset(("noframes", "frame", "frameset"))

PARAGRAPH_ENDERS = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu "
    "nav ol p pre search section summary table ul xmp".split()
)
PARAGRAPH_SCOPE = frozenset("applet button caption html marquee object table td template th".split())
_CELLS = frozenset(("td", "th"))
_ROWS = frozenset(("tr", "td", "th"))
_GROUPS = frozenset("tbody thead tfoot tr td th caption colgroup".split())
# start tag -> (open elements it ends, elements that stop the search)
ENDS_OPEN = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (_CELLS, frozenset(("tr", "table"))),
    "th": (_CELLS, frozenset(("tr", "table"))),
    "tr": (_ROWS, frozenset(("table",))),
    "tbody": (_GROUPS, frozenset(("table",))),
    "thead": (_GROUPS, frozenset(("table",))),
    "tfoot": (_GROUPS, frozenset(("table",))),
    "rt": (frozenset(("rt", "rp")), frozenset(("ruby",))),
    "rp": (frozenset(("rt", "rp")), frozenset(("ruby",))),
    "a": (frozenset(("a",)), frozenset(("div", "td", "th", "tr", "table", "template"))),
}
# An end tag cannot close through an open element of higher rank.
END_RANK = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180,
    "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220,
}


def _decode_attribute(value: str) -> str:
    if "&" not in value:
        return value
    return ATTRIBUTE_REFERENCE.sub(lambda m: unescape(m.group()), value)


def read_attributes(source: str) -> dict[str, str]:
    attrs: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        name = name.lower()
        if name not in attrs:
            value = _decode_attribute(double or single or bare)
            attrs[name] = " ".join(value.split()) if name == "class" else value
    return attrs


class NodeColumns:
    """Nodes of many pages, one Python list per output column."""

    def __init__(self):
        self.pre, self.last, self.parent, self.depth = [], [], [], []
        self.kind, self.tag, self.text = [], [], []
        self.attr_offsets, self.attr_names, self.attr_values = [0], [], []

    def __len__(self):
        return len(self.pre)

    def truncate(self, size: int) -> None:
        """Forget nodes from ``size`` on (a page failed half way)."""
        self.attr_offsets = self.attr_offsets[: size + 1]
        del self.attr_names[self.attr_offsets[-1]:], self.attr_values[self.attr_offsets[-1]:]
        for column in (self.pre, self.last, self.parent, self.depth, self.kind, self.tag, self.text):
            del column[size:]

    def keep_tags(self, size: int, tags: frozenset[str]) -> None:
        """Of the nodes from ``size`` on keep the elements with these tags."""
        chosen = [i for i in range(size, len(self.tag)) if self.tag[i] in tags]
        ends, first = self.attr_offsets, self.attr_offsets[size]
        names, values, offsets = [], [], []
        for i in chosen:
            names += self.attr_names[ends[i]:ends[i + 1]]
            values += self.attr_values[ends[i]:ends[i + 1]]
            offsets.append(first + len(names))
        self.attr_offsets[size + 1:], self.attr_names[first:], self.attr_values[first:] = offsets, names, values
        for column in (self.pre, self.last, self.parent, self.depth, self.kind, self.tag, self.text):
            column[size:] = [column[i] for i in chosen]

    def add(self, pre, parent, depth, kind, tag, text, attrs=None):
        self.pre.append(pre)
        self.last.append(pre)
        self.parent.append(parent)
        self.depth.append(depth)
        self.kind.append(kind)
        self.tag.append(tag)
        self.text.append(text)
        if attrs:
            self.attr_names.extend(attrs)
            self.attr_values.extend(attrs.values())
        self.attr_offsets.append(len(self.attr_names))


class PageNumberer:
    """Adds the nodes of one page to a ``NodeColumns``."""

    def __init__(self, out: NodeColumns):
        self.out = out
        self.base = len(out)
        self.open: list[int] = []       # positions of open elements
        self.open_tags: list[str] = []
        self.open_count: dict[str, int] = {}
        self.containers: list[str] = []  # open elements with strings of their own kind
        self.keeping_blanks = 0
        self.pending: list[str] = []    # text not yet written as a node
        self.seen_head = self.seen_body = False

    # ---- stack -----------------------------------------------------------
    def _push(self, tag, attrs):
        position = len(self.out) - self.base
        parent = self.open[-1] if self.open else -1
        self.out.add(position, parent, len(self.open), "element", tag, None, attrs)
        self.open.append(position)
        self.open_tags.append(tag)
        self.open_count[tag] = self.open_count.get(tag, 0) + 1
        if tag in STRING_CONTAINERS:
            self.containers.append(tag)
        elif tag in KEEP_BLANKS:
            self.keeping_blanks += 1

    def _pop_to(self, size):
        if self.pending:
            self._flush()
        end = len(self.out) - self.base - 1
        while len(self.open) > size:
            self.out.last[self.base + self.open.pop()] = end
            tag = self.open_tags.pop()
            self.open_count[tag] -= 1
            if tag in STRING_CONTAINERS:
                self.containers.pop()
            elif tag in KEEP_BLANKS:
                self.keeping_blanks -= 1

    def _close_open(self, closed, scope):
        for tag in closed:
            if self.open_count.get(tag):
                break
        else:
            return
        cut = None
        for i in range(len(self.open_tags) - 1, -1, -1):
            if self.open_tags[i] in closed:
                cut = i
            elif self.open_tags[i] in scope:
                break
        if cut is not None:
            self._pop_to(cut)

    # ---- strings ---------------------------------------------------------
    def _string(self, kind, text):
        parent = self.open[-1] if self.open else -1
        self.out.add(len(self.out) - self.base, parent, len(self.open), kind, None, text)

    def _flush(self):
        if not self.pending:
            return
        text = "".join(self.pending) if len(self.pending) > 1 else self.pending[0]
        self.pending.clear()
        if not self.keeping_blanks and not text.strip(ASCII_BLANK):
            text = "\n" if "\n" in text else " "
        self._string(self.containers[-1] if self.containers else "text", text)

    def text(self, text):
        if not text:
            return
        if len(self.open) < 2 or self.open_tags[-1] == "head":
            if self.pending or text.strip(ASCII_BLANK):
                if not self.seen_body:
                    self._imply("p")
                    self._push("p", None)
            else:
                return
        self.pending.append(text)

    def comment(self, text):
        self._flush()
        if self.open:
            self._string("comment", text)

    # ---- tags ------------------------------------------------------------
    def _imply(self, tag):
        """Open html, head or body when the page left them out."""
        if not self.open:
            self._push("html", None)
        if tag in FRAME_TAGS:
            return
        in_head = self.open_count.get("head")
        if tag in HEAD_TAGS or (tag == "noscript" and in_head):
            if not self.seen_head:
                self.seen_head = True
                self._push("head", None)
        elif in_head and self.open_tags[-1] != "head":
            return
        else:
            if in_head:
                self._pop_to(self.open_tags.index("head"))
            self.seen_head = self.seen_body = True
            self._push("body", None)

    def start(self, tag, attrs, closed):
        if tag == "html":
            if not self.open:
                self._push(tag, attrs)
            return
        if tag == "head" or tag == "body":
            if self.seen_body or (tag == "head" and self.seen_head):
                return
            self._flush()
            if not self.open:
                self._push("html", None)
            if self.open_count.get("head"):
                self._pop_to(self.open_tags.index("head"))
            self.seen_head, self.seen_body = True, tag == "body"
            self._push(tag, attrs)
            return
        if tag == "noscript" and self.open_count.get("noscript"):
            return  # browsers read noscript up to its first end tag
        self._flush()
        if not self.seen_body:
            self._imply(tag)
        if tag in PARAGRAPH_ENDERS and self.open_count.get("p"):
            self._close_open(("p",), PARAGRAPH_SCOPE)
        if tag in ENDS_OPEN:
            self._close_open(*ENDS_OPEN[tag])
        self._push(tag, attrs)
        if closed or tag in VOID:
            self._pop_to(len(self.open) - 1)

    def end(self, tag):
        if tag in ("html", "body") or tag in VOID or not self.open_count.get(tag):
            return
        rank = END_RANK.get(tag, 100)
        for i in range(len(self.open_tags) - 1, -1, -1):
            if self.open_tags[i] == tag:
                self._pop_to(i)
                return
            if END_RANK.get(self.open_tags[i], 100) > rank:
                return

    # ---- page ------------------------------------------------------------
    def read(self, html: str) -> None:
        position, size, search = 0, len(html), TOKEN.search
        while position < size:
            token = search(html, position)
            if token is None:
                self.text(unescape(html[position:]))
                break
            begin, after = token.span()
            if begin > position:
                text = html[position:begin]
                self.text(unescape(text) if "&" in text else text)
            position = after
            comment, end, name, source, done, bogus = token.groups()
            if name is not None:
                if not done:
                    continue
                name = name.lower()
                closed = source.endswith("/") and not UNQUOTED_END.search(source)
                self.start(name, read_attributes(source) if source else None, closed)
                if name in RAW_TEXT and not closed:
                    stop = RAW_TEXT[name].search(html, position)
                    raw = html[position:stop.start() if stop else size]
                    self.text(unescape(raw) if name in DECODED_RAW else raw)
                    position = stop.start() if stop else size
            elif end is not None:
                self.end(end.lower())
            elif comment is not None:
                self.comment(comment)
            elif not bogus[:7].lower() == "doctype":
                self.comment(bogus)
        self._pop_to(0)


def number_page(html: str, out: NodeColumns) -> None:
    PageNumberer(out).read(html)
