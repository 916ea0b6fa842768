"""CSS selectors: grammar, the chain of compounds that every engine compiles, and the matcher for one document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from ..functions.html import ELEMENT, TEXT, Dom


class SelectorError(ValueError):
    """A selector that cannot be read."""


@dataclass
class Attr:
    name: str
    op: str = ""
    value: str = ""
    fold: bool = False


@dataclass
class Pseudo:
    name: str
    arg: object = None  # (a, b) for nth-*, list of chains for not, is and has, text otherwise


@dataclass
class Compound:
    tag: str = "*"
    ids: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    attrs: list[Attr] = field(default_factory=list)
    pseudos: list[Pseudo] = field(default_factory=list)


@dataclass
class Chain:
    """parts[0].combinator is what stands before the first compound ('' for a plain start)."""

    parts: list[tuple[str, Compound]]
    value: tuple[str, str] | None = None  # ("text" | "own_text" | "attr" | "own_attr", name)


_IDENT = re.compile(r"(?:\\.|[\w-]|[^\x00-\x7f])+")
_ATTRIBUTE = re.compile(r"\[\s*([^\s=~|^$*\]]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\]]+))\s*([iIsS])?\s*)?\]")
_ELEMENT = re.compile(r"::(text|attr|first-letter|first-line|before|after)(?:\(\s*([^)]*?)\s*\))?\s*$")
_NTH = re.compile(r"^\s*(?:([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$", re.I)


def _unescape(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def nth(text: str) -> tuple[int, int]:
    """(a, b) of an+b."""
    low = text.strip().lower()
    if low in ("odd", "even"):
        return 2, int(low == "odd")
    m = _NTH.match(low)
    if not m:
        raise SelectorError(f"not a position: {text!r}")
    if m[4] is not None:
        return 0, int(m[4])
    a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    return a, int((m[2] or "+") + (m[3] or "0"))


def _split(text: str) -> list[str]:
    """Comma-separated groups outside brackets and quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [x.strip() for x in [*out, text[start:]] if x.strip()]


@lru_cache(maxsize=1024)
def parse(selector: str) -> tuple[Chain, ...]:
    """The groups of a selector."""
    groups = _split(selector)
    if not groups:
        raise SelectorError("empty selector")
    return tuple(_chain(g) for g in groups)


def _chain(text: str) -> Chain:
    value = None
    if m := _ELEMENT.search(text):
        own = bool(re.search(r">\s*$", text[: m.start()]))
        kind = "attr" if m[1] == "attr" else "text"
        value = (("own_" if own else "") + kind, (m[2] or "").lower())
        text = re.sub(r">\s*$", "", text[: m.start()]).strip()
        if not text:
            return Chain([("", Compound("*", pseudos=[Pseudo("scope-self")]))], value)
    parts, at = [], 0
    combinator, first = "", True
    while at < len(text):
        m = re.compile(r"\s*([>+~])\s*|\s+").match(text, at)
        if m and (m[1] or not first):
            combinator = m[1] or " "
            at = m.end()
            if at >= len(text):
                raise SelectorError(f"nothing after {combinator!r} in {text!r}")
        elif m:
            at = m.end()
        compound, end = _compound(text, at)
        if end == at:
            raise SelectorError(f"cannot read {text[at:]!r}")
        parts.append((combinator, compound))
        at, combinator, first = end, " ", False
    return Chain(parts, value)


def _compound(text: str, at: int) -> tuple[Compound, int]:
    c = Compound()
    if at < len(text) and text[at] == "*":
        at += 1
    elif m := _IDENT.match(text, at):
        c.tag, at = _unescape(m[0]).lower(), m.end()
    while at < len(text):
        ch = text[at]
        if ch in ".#":
            m = _IDENT.match(text, at + 1)
            if not m:
                raise SelectorError(f"no name after {ch!r} in {text!r}")
            (c.classes if ch == "." else c.ids).append(_unescape(m[0]))
            at = m.end()
        elif ch == "[":
            m = _ATTRIBUTE.match(text, at)
            if not m:
                raise SelectorError(f"cannot read {text[at:]!r}")
            value = next((v for v in m.group(3, 4, 5) if v is not None), "")
            c.attrs.append(Attr(m[1].lower(), m[2] or "", value, (m[6] or "").lower() == "i"))
            at = m.end()
        elif ch == ":":
            m = _IDENT.match(text, at + 1)
            if not m:
                raise SelectorError(f"no name after ':' in {text!r}")
            name, at, arg = m[0].lower(), m.end(), None
            if at < len(text) and text[at] == "(":
                depth, end = 1, at + 1
                while end < len(text) and depth:
                    depth += {"(": 1, ")": -1}.get(text[end], 0)
                    end += 1
                arg = text[at + 1 : end - 1 if not depth else end]
                at = end
            c.pseudos.append(_pseudo(name, arg))
        else:
            break
    return c, at


def _pseudo(name: str, arg: str | None) -> Pseudo:
    if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
        return Pseudo(name, nth(arg or ""))
    if name in ("not", "is", "matches", "where"):
        return Pseudo("not" if name == "not" else "is", [_chain(g) for g in _split(arg or "")])
    if name == "has":
        chains = []
        for g in _split(arg or ""):
            if g.strip() == "::text":
                chains.append("text")
                continue
            chain = _chain(g)
            lead = chain.parts[0][0] or " "
            chains.append(Chain([(lead, chain.parts[0][1]), *chain.parts[1:]]))
        return Pseudo("has", chains)
    return Pseudo(name, arg)


# fixed values: states that a static page can show, by attribute
STATES = {"checked": "checked", "disabled": "disabled", "required": "required"}
NEVER = frozenset("visited target focus hover active placeholder-shown".split())


def _state(dom: Dom, i: int, name: str) -> bool:
    v = dom.attr(i, name)
    return v is not None and v.lower() != "false"


def _attr(dom: Dom, i: int, t: Attr) -> bool:
    v = dom.attr(i, t.name)
    if v is None:
        return False
    want = t.value
    if t.fold:
        v, want = v.lower(), want.lower()
    match t.op:
        case "":
            return True
        case "=":
            return v == want
        case "*=":
            return want in v
        case "^=":
            return v.startswith(want)
        case "$=":
            return v.endswith(want)
        case "~=":
            return want in v.split()
        case _:
            return v == want or v.startswith(want + "-")


def is_nth(k: int, ab: tuple[int, int]) -> bool:
    a, b = ab
    return k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0


def matches(dom: Dom, i: int, c: Compound, scope: int = 0) -> bool:
    if c.tag != "*" and dom.tag[i] != c.tag or dom.kind[i] != ELEMENT:
        return False
    if any(dom.attr(i, "id") != x for x in c.ids) or any(x not in dom.classes[i] for x in c.classes):
        return False
    return all(_attr(dom, i, t) for t in c.attrs) and all(_matches_pseudo(dom, i, p, scope) for p in c.pseudos)


def _matches_pseudo(dom: Dom, i: int, p: Pseudo, scope: int) -> bool:
    idx, rev, tidx, trev, _, _ = dom.places
    match p.name:
        case "first-child":
            return idx[i] == 1
        case "last-child":
            return rev[i] == 1
        case "only-child":
            return idx[i] == rev[i] == 1
        case "first-of-type":
            return tidx[i] == 1
        case "last-of-type":
            return trev[i] == 1
        case "only-of-type":
            return tidx[i] == trev[i] == 1
        case "nth-child":
            return is_nth(idx[i], p.arg)
        case "nth-last-child":
            return is_nth(rev[i], p.arg)
        case "nth-of-type":
            return is_nth(tidx[i], p.arg)
        case "nth-last-of-type":
            return is_nth(trev[i], p.arg)
        case "empty":
            return not any(dom.kind[k] == ELEMENT or dom.kind[k] == TEXT and dom.data[k] for k in dom.children[i])
        case "root":
            return dom.parent[i] == 0
        case "scope":
            return True
        case "scope-self":
            return i == scope
        case "checked" | "disabled" | "required":
            return _state(dom, i, p.name)
        case "enabled":
            return not _state(dom, i, "disabled")
        case "optional":
            return not _state(dom, i, "required")
        case "read-only":
            return _state(dom, i, "readonly")
        case "read-write":
            return not _state(dom, i, "readonly")
        case "any-link" | "link":
            return dom.tag[i] in ("a", "area") and dom.attr(i, "href") is not None
        case "not":
            return not any(chain_matches(dom, i, c, 0) for c in p.arg)
        case "is":
            return any(chain_matches(dom, i, c, 0) for c in p.arg)
        case "has":
            return any(_has(dom, i, c) for c in p.arg)
    return False


def _has(dom: Dom, i: int, chain: Chain | str) -> bool:
    if chain == "text":
        return any(t.strip() for t in dom.direct_texts(i))
    reached = {i}
    for combinator, compound in chain.parts:
        reached = {k for r in reached for k in _forward(dom, r, combinator) if matches(dom, k, compound)}
    return bool(reached)


def _forward(dom: Dom, i: int, combinator: str) -> Iterator[int]:
    after = dom.places[5]
    if combinator == ">":
        yield from dom.children[i]
    elif combinator == "+":
        if after[i] >= 0:
            yield after[i]
    elif combinator == "~":
        k = after[i]
        while k >= 0:
            yield k
            k = after[k]
    else:
        yield from range(i + 1, dom.out[i] + 1)


def chain_matches(dom: Dom, i: int, chain: Chain, scope: int, at: int | None = None) -> bool:
    """Whether i ends the chain, with everything it names inside the scope."""
    at = len(chain.parts) - 1 if at is None else at
    combinator, compound = chain.parts[at]
    if not matches(dom, i, compound, scope):
        return False
    inside = lambda k: k > 0 and scope <= k
    if at == 0:  # a leading combinator relates to any node in scope
        if combinator == ">":
            return dom.parent[i] >= scope
        if combinator in ("+", "~"):
            return dom.places[4][i] >= 0
        return True
    before = dom.places[4]
    if combinator == ">":
        return inside(dom.parent[i]) and chain_matches(dom, dom.parent[i], chain, scope, at - 1)
    if combinator == "+":
        return inside(before[i]) and chain_matches(dom, before[i], chain, scope, at - 1)
    if combinator == "~":
        k = before[i]
        while k >= 0:
            if inside(k) and chain_matches(dom, k, chain, scope, at - 1):
                return True
            k = before[k]
        return False
    return any(inside(k) and chain_matches(dom, k, chain, scope, at - 1) for k in dom.ancestors(i))


def _candidates(dom: Dom, c: Compound) -> list[int]:
    """The narrowest index that covers a compound."""
    tags, classes, ids = dom.index
    if c.ids:
        return ids.get(c.ids[0], [])
    if c.classes:
        return min((classes.get(x, []) for x in c.classes), key=len)
    return tags.get(c.tag, []) if c.tag != "*" else dom.elements


def select(dom: Dom, selector: str, scope: int = 0, limit: int | None = None) -> list[int]:
    """Nodes of the scope (itself included) that match, group by group, each once."""
    out: dict[int, None] = {}
    for chain in parse(selector):
        for i in _candidates(dom, chain.parts[-1][1]):
            if scope <= i <= dom.out[scope] and i not in out and chain_matches(dom, i, chain, scope):
                out[i] = None
                if limit and len(out) >= limit:
                    return list(out)
    return list(out)


def values(dom: Dom, selector: str, scope: int = 0) -> list[str | None]:
    """What a selector yields as strings: its pseudo-element's values, the text of nodes where it has none."""
    out: list[str | None] = []
    for chain in parse(selector):
        seen = set()
        for i in _candidates(dom, chain.parts[-1][1]):
            if not scope <= i <= dom.out[scope] or i in seen or not chain_matches(dom, i, chain, scope):
                continue
            seen.add(i)
            kind, name = chain.value or ("text", "")
            if kind == "text":
                out.append(dom.text(i))
            elif kind == "own_text":
                out += dom.direct_texts(i)
            elif kind == "attr":
                out.append(dom.attr(i, name))
            elif (v := dom.attr(i, name)) is not None:
                out.append(v)
    return out
