"""Reads one HTML page into the few lists that issue extraction works on.

This is the only Python that runs on executors for batch work.  It repairs
markup and reads text in document order and decides nothing about issues:
choosing header, columns, sections and identifiers is left to Spark expressions.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

# Quotes only count after "=", and "<" ends an unfinished tag: input that is cut
# off or badly quoted costs one pass, not one pass per tag. An element that holds one text and nothing
# else, as most do, is one token: start tag, text and end tag.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\s*>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^<>]*>"
    r"|<([a-zA-Z][^\s/<>]*)((?:[^<>\"'=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+)>(?:([^<]*+)(?-i:</\2\s*+>))?",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))")
_INLINE = re.compile(r"display:\s?inline")

# HTML elements without content.
_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
    "track", "wbr",
}

# Optional end tags of HTML - which new element closes an open one.
_BLOCK = {
    "address", "article", "blockquote", "center", "dd", "div", "dl", "dt", "fieldset", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "ol", "p", "pre", "section", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_GROUPS = {"tbody", "tfoot", "thead"}
_CLOSED_BY = {
    "p": _BLOCK,
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option"},
    "a": {"a", "table", "td", "th"},
    "td": {"td", "th", "tr"} | _GROUPS,
    "th": {"td", "th", "tr"} | _GROUPS,
    "tr": {"tr"} | _GROUPS,
    "title": _BLOCK | {"body"},
}
_CLOSED_BY.update({t: _GROUPS for t in _GROUPS})
_CLOSED_BY.update({t: {"p", "td", "th"} for t in ("b", "i", "tt", "u", "s", "font", "small")})
_CLOSED_BY.update({f"h{n}": {"p", "table", "li", "form"} for n in range(1, 7)})

# An end tag never closes an open element of a higher rank.
_RANK = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180,
    "table": 190, "head": 200, "body": 200, "html": 220,
}


def _plain(text):
    """Text with its entities read; the commonest one needs no search for others."""
    n = text.count("&")
    if not n:
        return text
    return text.replace("&amp;", "&") if n == text.count("&amp;") else unescape(text)


class Node:
    __slots__ = ("tag", "attrs", "classes", "within", "kids")

    def __init__(self, tag, attrs, classes, within, kids):
        self.tag, self.attrs, self.classes, self.within, self.kids = tag, attrs, classes, within, kids

    def has_class(self, name):
        return name in self.classes


_NO_ATTRS: dict = {}
_READ_ATTRS = {"a", "div", "h2", "h3"}


def _attributes(tag, text):
    """Attributes where something reads them: links, blocks, topic titles and roles."""
    if "=" not in text or not (tag in _READ_ATTRS or "role" in text):
        return _NO_ATTRS
    found = {}
    for name, double, single, bare in _ATTR.findall(text):
        value = double or single or bare
        found[name.lower()] = unescape(value) if "&" in value else value
    return found


_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_LISTED = {*_HEADINGS, "p", "a", "table", "title"}
_IN_TABLE, _IN_ARIA = 1, 2
_NEVER_CLOSED = {"html", "body"}


def _start_tag(tag, text):
    """What a start tag says whatever stands around it.

    Name, attributes, classes, whether it is an inline ``div``, whether it opens an element, what its
    content is within, and whether a page may list it.
    """
    tag = tag.lower()
    attrs = _attributes(tag, text)
    classes = tuple(attrs["class"].split()) if "class" in attrs else ()
    aria = attrs.get("role") == "table"
    return (
        tag, attrs, classes,
        tag == "div" and _INLINE.search(attrs.get("style", "")) is not None,
        tag not in _VOID and text[-1:] != "/",
        _IN_TABLE * (tag == "table") | _IN_ARIA * aria,
        aria or tag in _LISTED or (tag == "div" and "topic" in classes),
    )


# Pages repeat their tags: each worker keeps what the last short ones say.
_LONGEST_KEPT = 200
_kept_start_tag = lru_cache(maxsize=4096)(_start_tag)


def read_tree(html):
    """Tree of a page; inline ``div`` wrappers inside tables leave no node."""
    return _read(html)[0]


def _read(html):
    """Tree of a page, and the nodes it may list as (place in the document, node, parent)."""
    root = Node("", _NO_ATTRS, (), 0, [])
    tags, nodes, listed = [""], [root], []
    tables = order = 0
    # Texts stand between the tokens; a token is an end tag, or a start tag with its attributes and
    # the only text of its element, if the element is one token.
    pieces = _TOKEN.split(html)
    for text, end_tag, tag, rest, only in zip(pieces[::5], pieces[1::5], pieces[2::5], pieces[3::5], pieces[4::5]):
        if text and not text.isspace():
            nodes[-1].kids.append(_plain(text))
        if tag is not None:
            said = _kept_start_tag(tag, rest) if len(rest) <= _LONGEST_KEPT else _start_tag(tag, rest)
            tag, attrs, classes, inline, opens, within, may_list = said
            closed = _CLOSED_BY.get(tags[-1])
            while closed is not None and tag in closed:
                tables -= tags.pop() == "table"
                nodes.pop()
                closed = _CLOSED_BY.get(tags[-1])
            parent = nodes[-1]
            if inline and tables:
                tags.append(tag)
                nodes.append(parent)
            else:
                order += 1
                if only is not None and opens and tag not in _NEVER_CLOSED:
                    node = Node(tag, attrs, classes, parent.within | within, [_plain(only)] if only and not only.isspace() else [])
                    parent.kids.append(node)
                    if may_list:
                        listed.append((order, node, parent))
                    continue
                node = Node(tag, attrs, classes, parent.within | within, [])
                parent.kids.append(node)
                if may_list:
                    listed.append((order, node, parent))
                if opens:
                    tags.append(tag)
                    nodes.append(node)
                    tables += tag == "table"
            if only is None:
                continue
            if only and not only.isspace():
                nodes[-1].kids.append(_plain(only))
            end_tag = tag
        if end_tag is not None:
            tag = end_tag.lower()
            if tag == tags[-1]:
                if tag not in _NEVER_CLOSED:
                    tables -= tags.pop() == "table"
                    nodes.pop()
                continue
            if tag in _NEVER_CLOSED:
                continue
            depth = len(tags) - 1
            rank = _RANK.get(tag, 100)
            while depth and tags[depth] != tag and _RANK.get(tags[depth], 100) <= rank:
                depth -= 1
            if depth and tags[depth] == tag:
                tables -= tags[depth:].count("table")
                del tags[depth:], nodes[depth:]
    rest = pieces[-1]
    if rest and not rest.isspace():
        nodes[-1].kids.append(_plain(rest))
    return root, listed


def walk(node, enter=None):
    """Nodes and texts below a node in document order; ``enter`` says where to go deeper."""
    kids = node.kids
    if not kids or len(kids) == 1 and kids[0].__class__ is str:
        return kids
    found, stack, kids = [], [], iter(kids)
    while True:
        for kid in kids:
            found.append(kid)
            if kid.__class__ is Node and kid.kids and (enter is None or enter(kid)):
                stack.append(kids)
                kids = iter(kid.kids)
                break
        else:
            if not stack:
                return found
            kids = stack.pop()


def find_all(node, tags, enter=None):
    return [k for k in walk(node, enter) if k.__class__ is Node and k.tag in tags]


def texts(found):
    return [k for k in found if k.__class__ is str]


def _joined(parts):
    return " ".join(" ".join(parts).split())


def _fused(parts):
    return "".join([p.strip() for p in parts])


def spaced(node, enter=None):
    """Texts joined by a space, white space collapsed."""
    return _joined(texts(walk(node, enter)))


def fused(node, enter=None):
    """Stripped texts joined by nothing: "PAN-1" and "PAN-2" become "PAN-1PAN-2"."""
    return _fused(texts(walk(node, enter)))


def _flat(node):
    """The texts of a node whose elements hold one text at most and no table or topic; else nothing."""
    found = []
    for kid in node.kids:
        if kid.__class__ is str:
            found.append(kid)
            continue
        below = kid.kids
        if below and (len(below) > 1 or below[0].__class__ is not str) or kid.tag == "table" or "topic" in kid.classes:
            return None
        found += below
    return found


def _not_table(node):
    return node.tag != "table"


def _nested_table_text(table):
    rows = ([spaced(c) for c in find_all(r, ("td", "th"))] for r in find_all(table, ("tr",)))
    return "; ".join(": ".join(cells) for cells in rows if cells)


def _cell(node):
    kids = node.kids
    if len(kids) == 1 and kids[0].__class__ is str:
        text = kids[0]
        return {"tag": node.tag, "spaced": " ".join(text.split()), "fused": text.strip(), "parts": []}
    found = _flat(node)
    if found is not None:
        parts = [k.kids[0].strip() for k in kids if k.__class__ is Node and k.kids and k.tag == "div" and "p" in k.classes]
        return {"tag": node.tag, "spaced": _joined(found), "fused": _fused(found), "parts": [p for p in parts if p]}
    outer = walk(node, _not_table)
    nested = any(k.__class__ is Node and k.tag == "table" for k in outer)
    plain = own = texts(outer)
    everything = outer
    if nested:
        plain = [
            k if k.__class__ is str else f" [{_nested_table_text(k)}] "
            for k in outer
            if k.__class__ is str or k.tag == "table"
        ]
        everything = walk(node)
        own = texts(everything)
    parts = [
        fused(k) for k in everything
        if k.__class__ is Node and k.tag == "div" and k.has_class("p")
    ]
    return {"tag": node.tag, "spaced": _joined(plain), "fused": _fused(own), "parts": [p for p in parts if p]}


_ROW_PARTS = {"table", "tr", *_GROUPS}
_CELLS = {"td", "th"}


def _around_rows(node):
    return node.tag not in _ROW_PARTS


def _table(node, order):
    rows, has_head, bodies = [], False, 0

    def collect(parent, section):
        for kid in parent.kids:
            if kid.__class__ is str:
                continue
            if kid.tag in _ROW_PARTS:
                take(kid, section)
            elif kid.kids:
                for below in walk(kid, _around_rows):
                    if below.__class__ is Node:
                        take(below, section)

    def take(node, section):
        nonlocal has_head, bodies
        if node.tag == "tr":
            cells = [_cell(c) for c in node.kids if c.__class__ is Node and c.tag in _CELLS]
            rows.append({"section": section, "cells": cells})
        elif node.tag in _GROUPS:
            has_head |= node.tag == "thead"
            bodies += node.tag == "tbody"
            collect(node, f"tbody {bodies}" if node.tag == "tbody" else node.tag)

    collect(node, "")
    return {"ord": order, "has_head": has_head, "has_body": bodies > 0, "rows": rows}


def _in_topic(node):
    return node.tag != "div" or "topic" not in node.classes


def _first(found, tag):
    return next((k for k in found if k.__class__ is Node and k.tag == tag), None)


def _paragraph(p):
    found = _flat(p)
    if found is not None:
        bold = tt = after = None
        for place, kid in enumerate(p.kids):
            if kid.__class__ is Node:
                if kid.tag == "b" and bold is None:
                    bold = _joined(kid.kids)
                    after = _joined([k if k.__class__ is str else _fused(k.kids) for k in p.kids[place + 1:]])
                elif kid.tag == "tt" and tt is None:
                    tt = _joined(kid.kids)
        return {"text": _joined(found), "bold": bold, "after_bold": after or None, "tt": tt}
    found = walk(p, _in_topic)
    bold, tt = _first(found, "b"), _first(found, "tt")
    after = None
    if bold is not None:
        owner = next(n for n in [p, *find_nodes(p)] if bold in n.kids)
        rest = owner.kids[owner.kids.index(bold) + 1:]
        after = _joined([k if k.__class__ is str else fused(k, _in_topic) for k in rest])
    return {
        "text": _joined(texts(found)),
        "bold": spaced(bold, _in_topic) if bold is not None else None,
        "after_bold": after or None,
        "tt": spaced(tt, _in_topic) if tt is not None else None,
    }


def _topic(node, order):
    title = short = None
    paras = []
    for k in walk(node, _in_topic):
        if k.__class__ is str or not k.classes:
            continue
        if k.tag == "div":
            classes = k.classes
            if "topic" in classes:
                continue
            if short is None and "shortdesc" in classes:
                short = spaced(k, _in_topic)
            if "p" in classes:
                paras.append(_paragraph(k))
        elif title is None and k.tag in ("h2", "h3") and "title" in k.classes:
            title = fused(k, _in_topic)
    return {"ord": order, "title": title, "shortdesc": short, "paras": paras}


def find_nodes(node):
    return [k for k in walk(node) if k.__class__ is Node]


def _aria_table(node, order):
    def own(k):
        return k.attrs.get("role") != "table"

    headers, rows = [], []
    for k in walk(node, own):
        if k.__class__ is Node and k.attrs:
            role = k.attrs.get("role")
            if role == "columnheader":
                headers.append(spaced(k))
            elif role == "row":
                cells = [c for c in walk(k) if c.__class__ is Node and c.attrs and c.attrs.get("role") == "cell"]
                rows.append([spaced(c) for c in cells])
    return {"ord": order, "headers": headers, "rows": rows}


def raw_title(html):
    """Text of the first title as it is written: entities, cut off ones too, and white space stay."""
    for token in _TOKEN.finditer(html):
        if (token.group(2) or "").lower() == "title":
            return html[token.end(3) + 1:].partition("<")[0]
    return None


_TEXTS = {"title", "raw_title"}


def read_page(html, parts):
    """The requested lists of one page, each entry with its place in the document."""
    page = {part: [] for part in parts if part not in _TEXTS}
    if "raw_title" in parts:
        page["raw_title"] = raw_title(html)
        if len(parts) == 1:
            return page
    title = None
    for order, node, parent in _read(html)[1]:
        tag = node.tag
        if tag == "title":
            if title is None and "title" in parts:
                title = spaced(node)
        elif tag == "table" and not parent.within & _IN_TABLE and "tables" in page:
            page["tables"].append(_table(node, order))
        elif (tag in _HEADINGS or tag == "p") and "headings" in page:
            found = texts(walk(node))
            page["headings"].append(
                {"ord": order, "tag": tag, "fused": _fused(found), "spaced": _joined(found)}
            )
        elif tag == "a" and "href" in node.attrs and "links" in page:
            page["links"].append(
                {"ord": order, "href": node.attrs["href"], "text": spaced(node)}
            )
        elif tag == "div" and "topics" in page and node.has_class("topic"):
            page["topics"].append(_topic(node, order))
        if "aria" in page and node.within & _IN_ARIA and node.attrs.get("role") == "table" and not parent.within & _IN_ARIA:
            page["aria"].append(_aria_table(node, order))
    if "title" in parts:
        page["title"] = title
    return page
