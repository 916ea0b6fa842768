"""Tokens and documents: a position-based tokenizer and the flat tree that every query reads.

The tree rule is deliberately small: no implied end tags and no inserted elements. An end tag closes the nearest open
element of its name with everything above it, and is ignored if there is none; ``/>`` closes any tag; void elements never open.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

ELEMENT, TEXT, COMMENT, DOCUMENT = 1, 3, 8, 9
#: fixed values: elements without content, elements with raw text, and the limits of open elements and attributes
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style"))
MAX_DEPTH, MAX_ATTRS = 1024, 64

_NAME = re.compile(r"[^\s/>]+")
_ATTR = re.compile(r"([^\s=>/][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*)?))?")
_GAP = re.compile(r"[\s/]*")
_REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,8})|#([0-9]{1,9})|(amp|lt|gt|quot|apos|nbsp));")
_PLAIN = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def character(code: int) -> str:
    """The character of a numeric reference; what no text can hold becomes U+FFFD."""
    return "�" if code == 0 or 0xD800 <= code <= 0xDFFF or code > 0x10FFFF else chr(code)


def _reference(m: re.Match) -> str:
    if m[3]:
        return _PLAIN[m[3]]
    return character(int(m[1], 16) if m[1] else int(m[2]))


def decode(text: str) -> str:
    """The references that documents decode: six names and numbers, in one pass."""
    return _REFERENCE.sub(_reference, text) if "&" in text else text


def _attributes(html: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes from at on, whether the tag closes itself, and the position after it."""
    attrs: dict[str, str] = {}
    n = len(html)
    while True:
        gap = _GAP.match(html, at)
        at = gap.end()
        if at >= n:
            return attrs, False, n
        if html[at] == ">":
            return attrs, html[at - 1] == "/", at + 1
        m = _ATTR.match(html, at)
        if not m:  # a stray quote or equals sign
            at += 1
            continue
        at = m.end()
        name = m[1].lower()
        if name not in attrs and len(attrs) < MAX_ATTRS:
            attrs[name] = decode(next((v for v in m.group(2, 3, 4) if v is not None), ""))


def tokens(html: str) -> Iterator[tuple[str, str | None, dict[str, str] | None, str | None, bool, int, int]]:
    """(kind, name, attributes, data, closes itself, start, end); kind is doctype, start, end, text or comment.

    The pieces [start, end) follow one another and make up the whole input, but for raw text that is never closed.
    """
    at, n, text_from = 0, len(html), 0
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt + 1 >= n:
            break
        c = html[lt + 1]
        if not (c.isalpha() and c.isascii() or c in "!/?"):
            at = lt + 1
            continue
        if c == "/" and not (lt + 2 < n and html[lt + 2].isalpha()):
            at = lt + 1
            continue
        if lt > text_from:
            yield "text", None, None, decode(html[text_from:lt]), False, text_from, lt
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            stop = n if end < 0 else end + 3
            yield "comment", None, None, html[lt + 4 : n if end < 0 else end], False, lt, stop
        elif c in "!?":
            end = html.find(">", lt)
            stop = n if end < 0 else end + 1
            body = html[lt + 2 : n if end < 0 else end]
            if c == "!" and body[:7].lower() == "doctype":
                yield "doctype", body[7:].strip(), None, None, False, lt, stop
            else:
                yield "skipped", None, None, body, False, lt, stop
        elif c == "/":
            end = html.find(">", lt)
            stop = n if end < 0 else end + 1
            yield "end", _NAME.match(html, lt + 2)[0].lower(), None, None, False, lt, stop
        else:
            m = _NAME.match(html, lt + 1)
            attrs, closed, stop = _attributes(html, m.end())
            name = m[0].lower()
            yield "start", name, attrs, None, closed, lt, stop
            if name in RAW and not closed:
                m = re.compile(f"</{name}", re.I).search(html, stop)
                if not m:
                    return
                if m.start() > stop:
                    yield "text", None, None, html[stop : m.start()], False, stop, m.start()
                stop = m.start()
        at = text_from = stop
    if text_from < n:
        yield "text", None, None, decode(html[text_from:]), False, text_from, n


def events(html: str) -> Iterator[tuple[str, str | None, dict[str, str] | None, str | None]]:
    """(kind, name, attributes, data) as a stream parser sees them, between doc_start and doc_end; void and self-closed elements end at once."""
    yield "doc_start", None, None, None
    for kind, name, attrs, data, closed, _, _ in tokens(html):
        if kind == "skipped":
            continue
        yield kind, name, attrs, data
        if kind == "start" and (closed or name in VOID):
            yield "end", name, None, None
    yield "doc_end", None, None, None


class Dom:
    """A parsed document as columns indexed by pre-order number; 0 is the document. Descendants of i are i + 1 .. out[i]."""

    def __init__(self, html: str):
        self.kind, self.tag, self.parent, self.out = [DOCUMENT], [""], [-1], [0]
        self.attrs: list[dict[str, str] | None] = [None]
        self.data, self.depth, self.doctype = [""], [0], None
        stack = [0]
        for kind, name, attrs, data, closed, _, _ in tokens(html or ""):
            if kind == "start":
                i = self._add(ELEMENT, name, attrs, "", stack)
                if not closed and name not in VOID and len(stack) <= MAX_DEPTH:
                    stack.append(i)
            elif kind == "end":
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        last = len(self.tag) - 1
                        for j in stack[k:]:
                            self.out[j] = last
                        del stack[k:]
                        break
            elif kind == "text":
                self._add(TEXT, "", None, data, stack)
            elif kind == "comment":
                self._add(COMMENT, "", None, data, stack)
            elif kind == "doctype" and self.doctype is None:
                self.doctype = name
        for j in stack:
            self.out[j] = len(self.tag) - 1

    def _add(self, kind: int, tag: str, attrs, data: str, stack: list[int]) -> int:
        i = len(self.tag)
        self.kind.append(kind)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.data.append(data)
        self.parent.append(stack[-1])
        self.out.append(i)
        self.depth.append(len(stack))
        return i

    def __len__(self) -> int:
        return len(self.tag)

    @cached_property
    def texts(self) -> list[int]:
        return [i for i, k in enumerate(self.kind) if k == TEXT]

    @cached_property
    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.tag]
        for i in range(1, len(self.tag)):
            out[self.parent[i]].append(i)
        return out

    @cached_property
    def places(self) -> tuple[list[int], list[int], list[int], list[int], list[int], list[int]]:
        """Of elements among their element siblings: index and index from the end, the same by tag (from 1), neighbours before and after (-1 if none)."""
        n = len(self.tag)
        idx, rev, tidx, trev, before, after = [0] * n, [0] * n, [0] * n, [0] * n, [-1] * n, [-1] * n
        for kids in self.children:
            els = [k for k in kids if self.kind[k] == ELEMENT]
            seen: dict[str, int] = {}
            for p, k in enumerate(els):
                idx[k], rev[k] = p + 1, len(els) - p
                seen[self.tag[k]] = tidx[k] = seen.get(self.tag[k], 0) + 1
                if p:
                    before[k], after[els[p - 1]] = els[p - 1], k
            for k in els:
                trev[k] = seen[self.tag[k]] - tidx[k] + 1
        return idx, rev, tidx, trev, before, after

    @cached_property
    def classes(self) -> list[frozenset[str]]:
        none: frozenset[str] = frozenset()
        return [frozenset(a["class"].split()) if a and "class" in a else none for a in self.attrs]

    @cached_property
    def index(self) -> tuple[dict[str, list[int]], dict[str, list[int]], dict[str, list[int]]]:
        """Elements by tag, class and id, in document order."""
        tags: dict[str, list[int]] = {}
        classes: dict[str, list[int]] = {}
        ids: dict[str, list[int]] = {}
        for i, k in enumerate(self.kind):
            if k == ELEMENT:
                tags.setdefault(self.tag[i], []).append(i)
                for c in self.classes[i]:
                    classes.setdefault(c, []).append(i)
                if "id" in self.attrs[i]:
                    ids.setdefault(self.attrs[i]["id"], []).append(i)
        return tags, classes, ids

    @cached_property
    def elements(self) -> list[int]:
        return [i for i, k in enumerate(self.kind) if k == ELEMENT]

    def ancestors(self, i: int) -> list[int]:
        """Element ancestors, the nearest first."""
        out = []
        p = self.parent[i]
        while p > 0:
            out.append(p)
            p = self.parent[p]
        return out

    def text(self, i: int) -> str:
        """All text below a node, or its own data."""
        if self.kind[i] in (TEXT, COMMENT):
            return self.data[i]
        t = self.texts
        return "".join([self.data[k] for k in t[bisect_right(t, i) : bisect_right(t, self.out[i])]])

    def direct_texts(self, i: int) -> list[str]:
        return [self.data[k] for k in self.children[i] if self.kind[k] == TEXT]

    def visible_text(self, i: int) -> str:
        """Text below a node outside script, style and noscript."""
        hidden = [(k, self.out[k]) for tag in ("script", "style", "noscript") for k in self.index[0].get(tag, ())]
        t = self.texts
        keep = (k for k in t[bisect_left(t, i) : bisect_right(t, self.out[i])] if not any(a < k <= b for a, b in hidden))
        return "".join(self.data[k] for k in keep)

    def attr(self, i: int, name: str) -> str | None:
        a = self.attrs[i]
        return a.get(name) if a else None

    # --- serialisation and paths ----------------------------------------------------------------------------------------

    def html(self, i: int = 0) -> str:
        """The markup of a node."""
        kind = self.kind[i]
        if kind == TEXT:
            raw = self.tag[self.parent[i]] in RAW
            return self.data[i] if raw else escape(self.data[i])
        if kind == COMMENT:
            return f"<!--{self.data[i]}-->"
        if kind == DOCUMENT:
            return (f"<!DOCTYPE {self.doctype}>" if self.doctype else "") + self.inner_html(i)
        start = self.tag[i] + "".join(f' {k}="{escape(v, quote=True)}"' for k, v in self.attrs[i].items())
        return f"<{start}>" if self.tag[i] in VOID else f"<{start}>{self.inner_html(i)}</{self.tag[i]}>"

    def inner_html(self, i: int) -> str:
        return "".join(self.html(k) for k in self.children[i])

    def css_path(self, i: int) -> str:
        """tag:nth-of-type(k) steps joined by >, from the nearest ancestor with an id."""
        steps = []
        for k in [i, *self.ancestors(i)]:
            if self.attr(k, "id"):
                steps.append(f"#{self.attr(k, 'id')}")
                break
            steps.append(f"{self.tag[k]}:nth-of-type({self.places[2][k]})")
        return " > ".join(reversed(steps))

    def xpath_path(self, i: int) -> str:
        steps = []
        for k in [i, *self.ancestors(i)]:
            if self.attr(k, "id"):
                return f"//{self.tag[k]}[@id='{self.attr(k, 'id')}']" + "".join(f"/{s}" for s in reversed(steps))
            steps.append(f"{self.tag[k]}[{self.places[2][k]}]")
        return "".join(f"/{s}" for s in reversed(steps))


def escape(text: str, quote: bool = False, apostrophe: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    text = text.replace('"', "&quot;") if quote else text
    return text.replace("'", "&#39;") if apostrophe else text


def clean(text: str) -> str:
    """ASCII white space squeezed and stripped."""
    return re.sub(r"[ \t\r\n\f\v]+", " ", text).strip(" ")
