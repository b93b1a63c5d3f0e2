"""The cleaning rules done the obvious way on a linked tree, to compare with."""

from __future__ import annotations

import html as html_lib

from pageloom.functions.text import BLANKS
from pageloom.operators.htmltree import NodeColumns, STRING_CONTAINERS, VOID, number_page
from pageloom.profile import CleanRules


class Node:
    def __init__(self, kind, tag, attrs, text):
        self.kind, self.tag, self.attrs, self.text = kind, tag, attrs, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    @property
    def element(self):
        return self.kind == "element"

    def below(self):
        for child in self.children:
            yield child
            yield from child.below()

    def drop(self):
        self.parent.children = [c for c in self.parent.children if c is not self]
        for node in (self, *self.below()):
            node.gone = True

    gone = False

    def said(self):
        kind = self.tag if self.tag in STRING_CONTAINERS else "text"
        return "".join(n.text.strip(BLANKS) for n in self.below() if n.kind == kind)

    def only_string(self):
        if len(self.children) != 1:
            return None
        child = self.children[0]
        return child.only_string() if child.element else child

    def write(self):
        if self.kind == "comment":
            return f"<!--{self.text}-->" if self.text else ""
        if not self.element:
            return self.text if self.kind in ("script", "style") else html_lib.escape(self.text, quote=False)
        inner = "".join(f' {k}="{v}"' for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"<{self.tag}{inner}/>"
        return f"<{self.tag}{inner}>{''.join(c.write() for c in self.children)}</{self.tag}>"


def tree(source):
    columns = NodeColumns()
    number_page(source, columns)
    nodes = []
    for i in range(len(columns)):
        lo, hi = columns.attr_offsets[i], columns.attr_offsets[i + 1]
        attrs = dict(zip(columns.attr_names[lo:hi], columns.attr_values[lo:hi]))
        node = Node(columns.kind[i], columns.tag[i], attrs, columns.text[i])
        nodes.append(node)
        if columns.parent[i] >= 0:
            node.parent = nodes[columns.parent[i]]
            node.parent.children.append(node)
    return nodes


def clean(source, rules=CleanRules(), uris=None):
    nodes = tree(source)
    root = next(n for n in nodes if n.tag == "div" and "entry-content" in n.attrs.get("class", "").split())
    root.attrs = {}
    tasks = []
    for img in [n for n in root.below() if n.tag == "img"]:
        if rules.lazy_class in img.attrs.get("class", "").split():
            img.drop()
            continue
        holder = img.parent
        if holder.tag == "noscript":
            at = holder.parent.children.index(holder)
            holder.parent.children[at:at + 1] = holder.children
            for child in holder.children:
                child.parent = holder.parent
        source_url = img.attrs.get("data-src") or img.attrs.get("src", "")
        if source_url.startswith("http"):
            tasks.append((img, source_url))
    if uris is not None:
        for img, source_url in tasks:
            if source_url in uris:
                img.attrs = {"src": uris[source_url]}
            else:
                img.drop()

    def banned_text(text):
        return text.strip(BLANKS).startswith(rules.removed_text_prefixes)

    for node in [n for n in root.below() if n.element]:
        if node.gone or node.tag in rules.protected_tags:
            continue
        string = node.only_string()
        if (
            node.tag in rules.removed_tags
            or any(c.tag == "a" for c in node.children)
            or node.attrs.get("id") in rules.removed_ids
            or set(node.attrs.get("class", "").split()) & set(rules.removed_classes)
            or (string is not None and string.text and banned_text(node.said()))
        ):
            node.drop()
        elif node.tag not in rules.attribute_tags:
            node.attrs = {}
    for node in [n for n in root.below() if n.element]:
        if node.gone or node.tag in rules.protected_tags:
            continue
        if not node.said() and not any(n.tag == "img" for n in node.below()):
            node.drop()
    words = []
    for node in list(root.below()):
        if not node.element and banned_text(node.text):
            node.text = ""
        if node.kind == "text":
            words.append(node.text.strip(BLANKS))
    return root.write(), "".join(words)
