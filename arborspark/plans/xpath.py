"""XPath 1.0: grammar and evaluation over one document.

Predicates count per context node, and along reverse axes in order of proximity; results come in document order. The
namespace axis is empty, prefixes of names are ignored, and sibling axes hold elements only.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

from ..functions.html import COMMENT, ELEMENT, TEXT, Dom


class XPathError(ValueError):
    """An expression that cannot be read."""


class Unsupported(XPathError):
    """An axis or function that does not exist here."""


@dataclass(frozen=True)
class Attribute:
    """An attribute as a node: it belongs to an element and has a name and a value."""

    owner: int
    name: str
    value: str


_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|\"([^\"]*)\"|'([^']*)'|(::|//|\.\.|!=|<=|>=|[/@.,()\[\]|+\-=<>*$])|([^\W\d][\w.-]*(?::(?!:)[^\W\d][\w.-]*|:\*)?))")
_TYPES = ("node", "text", "comment", "processing-instruction")
AXES = (
    "child descendant descendant-or-self parent self ancestor ancestor-or-self following-sibling preceding-sibling "
    "following preceding attribute namespace"
).split()
REVERSE = frozenset(("ancestor", "ancestor-or-self", "preceding", "preceding-sibling"))


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        if not text[at:].strip():
            break
        m = _TOKEN.match(text, at)
        if not m:
            raise XPathError(f"cannot read {text[at:]!r}")
        at = m.end()
        if m[1] is not None:
            out.append(("number", m[1]))
        elif m[2] is not None or m[3] is not None:
            out.append(("string", m[2] if m[2] is not None else m[3]))
        elif m[4]:
            out.append(("op", m[4]))
        else:
            out.append(("name", m[5]))
    return out


class _Parser:
    """Recursive descent; nodes of the tree are tuples that begin with their kind."""

    def __init__(self, text: str):
        self.toks, self.at = _lex(text), 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.toks[self.at + k] if self.at + k < len(self.toks) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, v = self.peek()
        if kind in ("op", "name") and v in values:
            self.at += 1
            return v
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise XPathError(f"expected {value!r} before {self.peek()[1]!r}")

    def binary(self, lower, *ops: str):
        left = lower()
        while (op := self.peek()[1] if self.peek()[0] in ("op", "name") else None) in ops:
            self.at += 1
            left = ("binary", op, left, lower())
        return left

    def expression(self):
        return self.binary(self.conjunction, "or")

    def conjunction(self):
        return self.binary(self.equality, "and")

    def equality(self):
        return self.binary(self.relation, "=", "!=")

    def relation(self):
        return self.binary(self.sum, "<", ">", "<=", ">=")

    def sum(self):
        return self.binary(self.product, "+", "-")

    def product(self):
        return self.binary(self.unary, "*", "div", "mod")

    def unary(self):
        if self.take("-"):
            return ("negate", self.unary())
        return self.union()

    def union(self):
        left = self.path()
        while self.take("|"):
            left = ("union", left, self.path())
        return left

    def path(self):
        kind, v = self.peek()
        call = kind == "name" and self.peek(1) == ("op", "(") and v not in _TYPES
        if kind in ("number", "string") or v == "(" and kind == "op" or call:
            base = self.primary()
            predicates = self.predicates()
            node = ("filter", base, predicates) if predicates else base
            steps = []
            if self.peek() in (("op", "/"), ("op", "//")):
                steps = self.steps(lead=True)
            return ("path", node, steps) if steps else node
        if kind == "op" and v == "/":
            self.at += 1
            return ("path", ("root",), self.steps(lead=False) if self.begins_step() else [])
        if kind == "op" and v == "//":
            return ("path", ("root",), self.steps(lead=True))
        return ("path", ("context",), self.steps(lead=False))

    def begins_step(self) -> bool:
        kind, v = self.peek()
        return kind == "name" or kind == "op" and v in ("@", ".", "..", "*")

    def steps(self, lead: bool) -> list:
        out = []
        if not lead:
            out.append(self.step())
        while True:
            if self.take("//"):
                out += [("descendant-or-self", ("type", "node"), []), self.step()]
            elif self.take("/"):
                out.append(self.step())
            else:
                return out

    def step(self):
        if self.take("."):
            return ("self", ("type", "node"), self.predicates())
        if self.take(".."):
            return ("parent", ("type", "node"), self.predicates())
        axis = "child"
        if self.take("@"):
            axis = "attribute"
        elif self.peek(1) == ("op", "::"):
            axis = self.peek()[1]
            if axis not in AXES:
                raise Unsupported(f"no axis {axis!r}")
            self.at += 2
        return (axis, self.test(), self.predicates())

    def test(self):
        kind, v = self.peek()
        if kind == "op" and v == "*":
            self.at += 1
            return ("name", "*")
        if kind != "name":
            raise XPathError(f"expected a step before {v!r}")
        self.at += 1
        if v in _TYPES and self.take("("):
            if self.peek()[0] == "string":
                self.at += 1
            self.need(")")
            return ("type", v)
        return ("name", v.rpartition(":")[2].lower())

    def predicates(self) -> list:
        out = []
        while self.take("["):
            out.append(self.expression())
            self.need("]")
        return out

    def primary(self):
        kind, v = self.peek()
        self.at += 1
        if kind == "number":
            return ("number", float(v))
        if kind == "string":
            return ("string", v)
        if v == "(":
            e = self.expression()
            self.need(")")
            return e
        args = []
        self.need("(")
        if not self.take(")"):
            args.append(self.expression())
            while self.take(","):
                args.append(self.expression())
            self.need(")")
        if v not in FUNCTIONS:
            raise Unsupported(f"no function {v!r}")
        return ("call", v, args)


@lru_cache(maxsize=1024)
def parse(text: str):
    p = _Parser(text)
    tree = p.expression()
    if p.at != len(p.toks):
        raise XPathError(f"cannot read {p.peek()[1]!r} in {text!r}")
    return tree


@dataclass
class _Context:
    dom: Dom
    node: object
    position: int = 1
    size: int = 1


# --- values -------------------------------------------------------------------------------------------------------------


def string(dom: Dom, v) -> str:
    if isinstance(v, list):
        return string(dom, v[0]) if v else ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if math.isinf(v):
            return "Infinity" if v > 0 else "-Infinity"
        return str(int(v)) if v == int(v) else repr(v)
    if isinstance(v, Attribute):
        return v.value
    return dom.text(v) if isinstance(v, int) else v


def number(dom: Dom, v) -> float:
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, float):
        return v
    s = string(dom, v).strip()
    return float(s) if re.fullmatch(r"-?(\d+(\.\d*)?|\.\d+)", s) else math.nan


def boolean(v) -> bool:
    if isinstance(v, float):
        return v != 0 and not math.isnan(v)
    return bool(v)


def _order(n) -> tuple:
    return (n.owner, 1, n.name) if isinstance(n, Attribute) else (n, 0, "")


def _sorted(nodes) -> list:
    return sorted(dict.fromkeys(nodes), key=_order)


# --- axes ---------------------------------------------------------------------------------------------------------------


def _axis(dom: Dom, n, axis: str) -> list:
    """Nodes of an axis, the nearest first."""
    if isinstance(n, Attribute):
        if axis in ("self", "ancestor-or-self", "descendant-or-self"):
            own = [n]
        else:
            own = []
        up = [n.owner, *_axis(dom, n.owner, "ancestor")]
        return {"parent": [n.owner], "ancestor": up, "ancestor-or-self": own + up}.get(axis, own)
    match axis:
        case "child":
            return dom.children[n]
        case "descendant":
            return list(range(n + 1, dom.out[n] + 1))
        case "descendant-or-self":
            return list(range(n, dom.out[n] + 1))
        case "parent":
            return [dom.parent[n]] if dom.parent[n] >= 0 else []
        case "self":
            return [n]
        case "ancestor" | "ancestor-or-self":
            out = [n] if axis == "ancestor-or-self" else []
            p = dom.parent[n]
            while p >= 0:
                out.append(p)
                p = dom.parent[p]
            return out
        case "following-sibling" | "preceding-sibling":
            kin = dom.children[dom.parent[n]] if dom.parent[n] >= 0 else []
            kin = [k for k in kin if dom.kind[k] == ELEMENT]
            return [k for k in kin if k > n] if axis[0] == "f" else [k for k in reversed(kin) if k < n]
        case "following":
            return list(range(dom.out[n] + 1, len(dom)))
        case "preceding":
            return [k for k in range(n - 1, 0, -1) if dom.out[k] < n]
        case "attribute":
            return [Attribute(n, k, v) for k, v in (dom.attrs[n] or {}).items()]
    return []


def _test(dom: Dom, n, axis: str, test: tuple[str, str]) -> bool:
    kind, v = test
    if kind == "type":
        return v == "node" or not isinstance(n, Attribute) and dom.kind[n] == {"text": TEXT, "comment": COMMENT}.get(v)
    if isinstance(n, Attribute):
        return v in ("*", n.name)
    return dom.kind[n] == ELEMENT and v in ("*", dom.tag[n])


def _filtered(ctx: _Context, nodes: list, predicates: list) -> list:
    for p in predicates:
        kept, size = [], len(nodes)
        for k, n in enumerate(nodes, 1):
            v = _eval(_Context(ctx.dom, n, k, size), p)
            if v == k if isinstance(v, float) else boolean(v):
                kept.append(n)
        nodes = kept
    return nodes


# --- evaluation ---------------------------------------------------------------------------------------------------------


def _eval(ctx: _Context, e):
    dom = ctx.dom
    match e[0]:
        case "number" | "string":
            return e[1]
        case "negate":
            return -number(dom, _eval(ctx, e[1]))
        case "root":
            return [0]
        case "context":
            return [ctx.node]
        case "union":
            return _sorted([*_set(_eval(ctx, e[1])), *_set(_eval(ctx, e[2]))])
        case "filter":
            return _filtered(ctx, _set(_eval(ctx, e[1])), e[2])
        case "path":
            nodes = _set(_eval(ctx, e[1]))
            for axis, test, predicates in e[2]:
                got = []
                for n in nodes:
                    got += _filtered(ctx, [k for k in _axis(dom, n, axis) if _test(dom, k, axis, test)], predicates)
                nodes = _sorted(got)
            return nodes
        case "call":
            return FUNCTIONS[e[1]](ctx, [_eval(ctx, a) for a in e[2]])
    _, op, left, right = e
    if op in ("or", "and"):
        first = boolean(_eval(ctx, left))
        return first if first == (op == "or") else boolean(_eval(ctx, right))
    a, b = _eval(ctx, left), _eval(ctx, right)
    if op in ("=", "!=", "<", ">", "<=", ">="):
        return _compare(dom, op, a, b)
    x, y = number(dom, a), number(dom, b)
    match op:
        case "+":
            return x + y
        case "-":
            return x - y
        case "*":
            return x * y
        case "div":
            if y == 0:
                return math.nan if x == 0 or math.isnan(x) else math.copysign(math.inf, x) * math.copysign(1, y)
            return x / y
    return math.nan if y == 0 or math.isinf(x) or math.isnan(x) or math.isnan(y) else math.fmod(x, y)


def _set(v) -> list:
    if not isinstance(v, list):
        raise XPathError("a set of nodes is needed")
    return v


def _compare(dom: Dom, op: str, a, b) -> bool:
    if isinstance(a, list) or isinstance(b, list):
        other = b if isinstance(a, list) else a
        if isinstance(other, bool):
            return _atoms(dom, op, boolean(a), boolean(b))
        left = [string(dom, n) for n in a] if isinstance(a, list) else [a]
        right = [string(dom, n) for n in b] if isinstance(b, list) else [b]
        return any(_atoms(dom, op, x, y) for x in left for y in right)
    return _atoms(dom, op, a, b)


def _atoms(dom: Dom, op: str, a, b) -> bool:
    if op in ("=", "!="):
        if isinstance(a, bool) or isinstance(b, bool):
            same = boolean(a) == boolean(b)
        elif isinstance(a, float) or isinstance(b, float):
            same = number(dom, a) == number(dom, b)
        else:
            same = a == b
        return same == (op == "=")
    x, y = number(dom, a), number(dom, b)
    return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


def _one(ctx: _Context, args: list):
    return args[0] if args else [ctx.node]


def _name(ctx: _Context, args: list) -> str:
    nodes = _one(ctx, args)
    if not nodes:
        return ""
    return nodes[0].name if isinstance(nodes[0], Attribute) else ctx.dom.tag[nodes[0]]


def _substring(ctx: _Context, args: list) -> str:
    s = string(ctx.dom, args[0])
    first = _round(number(ctx.dom, args[1]))
    last = first + _round(number(ctx.dom, args[2])) if len(args) > 2 else math.inf
    return "".join(c for k, c in enumerate(s, 1) if k >= first and k < last)


def _round(x: float) -> float:
    return x if math.isnan(x) or math.isinf(x) else float(math.floor(x + 0.5))


def _lang(ctx: _Context, args: list) -> bool:
    want, n = string(ctx.dom, args[0]).lower(), ctx.node
    for k in ([n.owner] if isinstance(n, Attribute) else [n]) + [k for k in _axis(ctx.dom, n, "ancestor")]:
        have = ctx.dom.attr(k, "xml:lang") or ctx.dom.attr(k, "lang")
        if have is not None:
            return have.lower() == want or have.lower().startswith(want + "-")
    return False


def _ids(ctx: _Context, args: list) -> list:
    v = args[0]
    names = {w for x in (v if isinstance(v, list) else [v]) for w in string(ctx.dom, x).split()}
    return [i for i in ctx.dom.elements if ctx.dom.attr(i, "id") in names]


def _translate(ctx: _Context, a: list) -> str:
    s, old, new = (string(ctx.dom, x) for x in a)
    table: dict[int, str | None] = {}
    for k, c in enumerate(old):
        table.setdefault(ord(c), new[k] if k < len(new) else None)
    return s.translate(table)



FUNCTIONS = {
    "last": lambda ctx, a: float(ctx.size),
    "position": lambda ctx, a: float(ctx.position),
    "count": lambda ctx, a: float(len(_set(a[0]))),
    "id": _ids,
    "local-name": _name,
    "name": _name,
    "namespace-uri": lambda ctx, a: "",
    "string": lambda ctx, a: string(ctx.dom, _one(ctx, a)),
    "concat": lambda ctx, a: "".join(string(ctx.dom, x) for x in a),
    "starts-with": lambda ctx, a: string(ctx.dom, a[0]).startswith(string(ctx.dom, a[1])),
    "contains": lambda ctx, a: string(ctx.dom, a[1]) in string(ctx.dom, a[0]),
    "substring-before": lambda ctx, a: (lambda s, t: s[: s.index(t)] if t in s else "")(string(ctx.dom, a[0]), string(ctx.dom, a[1])),
    "substring-after": lambda ctx, a: (lambda s, t: s[s.index(t) + len(t) :] if t in s else "")(string(ctx.dom, a[0]), string(ctx.dom, a[1])),
    "substring": _substring,
    "string-length": lambda ctx, a: float(len(string(ctx.dom, _one(ctx, a)))),
    "normalize-space": lambda ctx, a: " ".join(string(ctx.dom, _one(ctx, a)).split()),
    "translate": _translate,
    "boolean": lambda ctx, a: boolean(a[0]),
    "not": lambda ctx, a: not boolean(a[0]),
    "true": lambda ctx, a: True,
    "false": lambda ctx, a: False,
    "lang": _lang,
    "number": lambda ctx, a: number(ctx.dom, _one(ctx, a)),
    "sum": lambda ctx, a: math.fsum(number(ctx.dom, [n]) for n in _set(a[0])),
    "floor": lambda ctx, a: (lambda x: x if math.isnan(x) or math.isinf(x) else float(math.floor(x)))(number(ctx.dom, a[0])),
    "ceiling": lambda ctx, a: (lambda x: x if math.isnan(x) or math.isinf(x) else float(math.ceil(x)))(number(ctx.dom, a[0])),
    "round": lambda ctx, a: _round(number(ctx.dom, a[0])),
}


def evaluate(dom: Dom, expression: str, node: int = 0):
    """A list of nodes (numbers of the document, or attributes), a string, a number or a boolean."""
    return _eval(_Context(dom, node), parse(expression))


def select(dom: Dom, expression: str, node: int = 0) -> list:
    """The result as a list: nodes as they are, another value as its only item."""
    v = evaluate(dom, expression, node)
    return v if isinstance(v, list) else [v]


def strings(dom: Dom, expression: str, node: int = 0) -> list[str]:
    return [string(dom, v) for v in select(dom, expression, node)]
