"""Complete elements of huge documents as rows, from chunks of bytes of any size.

The scanner keeps what it has not finished; its result does not depend on where the chunks are cut. In Structured Streaming
the unfinished rest is the state of a document, so memory is bounded by the largest row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.html import VOID, Dom
from ..operators.nodes import map_rows
from ..plans import css

_OUTER = re.compile(r"^([A-Za-z][\w-]*)((?:[.#][\w-]+)*)$")


class Target:
    """tag(.class)*(#id): the element that makes a row. Classes are compared without case, the id exactly."""

    def __init__(self, outer: str):
        m = _OUTER.match(outer.strip())
        if not m:
            raise ValueError(f"rows need a tag with classes or an id: {outer!r}")
        self.outer, self.tag = outer, m[1].lower()
        self.classes = {c.lower() for c in re.findall(r"\.([\w-]+)", m[2])}
        self.id = next(iter(re.findall(r"#([\w-]+)", m[2])), None)

    def matches(self, attrs: dict[str, str]) -> bool:
        have = {c.lower() for c in attrs.get("class", "").split()}
        return self.classes <= have and (self.id is None or attrs.get("id") == self.id)


_OPEN = re.compile(rb"<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")


class Scanner:
    """Feed it bytes, take complete rows."""

    def __init__(self, target: Target, state: tuple[bytes, int, int, bytes] = (b"", 0, -1, b"")):
        self.target = target
        self.buffer, self.depth, self.start, self.raw = state  # unread bytes, open same tags, where the row began, raw element

    @property
    def state(self) -> tuple[bytes, int, int, bytes]:
        return self.buffer, self.depth, self.start, self.raw

    def feed(self, chunk: bytes) -> Iterator[str]:
        buf, at = self.buffer + chunk, self._resume
        tag = self.target.tag.encode()
        while True:
            if self.raw:
                m = re.compile(b"</" + self.raw, re.I).search(buf, at)
                if not m:
                    at = max(at, len(buf) - len(self.raw) - 1)
                    break
                at, self.raw = m.start(), b""
            lt = buf.find(b"<", at)
            if lt < 0:
                at = len(buf)
                break
            if lt + 9 > len(buf) and buf.find(b">", lt) < 0:
                at = lt
                break
            if buf.startswith((b"<!--", b"<![CDATA["), lt):
                mark = b"-->" if buf.startswith(b"<!--", lt) else b"]]>"
                end = buf.find(mark, lt + 4)
                if end < 0:
                    at = lt
                    break
                at = end + 3
                continue
            if buf[lt + 1 : lt + 2] == b"/":
                end = buf.find(b">", lt)
                if end < 0:
                    at = lt
                    break
                name = re.match(rb"</([^\s/>]*)", buf[lt : end + 1])[1].lower()
                at = end + 1
                if name == tag and self.depth:
                    self.depth -= 1
                    if self.depth == 0:
                        yield buf[self.start : at].decode("utf-8", "ignore")
                        buf, at, self.start = buf[at:], 0, -1
                continue
            m = _OPEN.match(buf, lt)
            if not m:
                if buf[lt + 1 : lt + 2].isalpha():
                    at = lt
                    break
                at = lt + 1
                continue
            name, closed = m[1].lower(), m[2].rstrip().endswith(b"/")
            at = m.end()
            if name == tag:
                void = closed or name.decode() in VOID
                if self.depth == 0 and self.target.matches(Dom(m[0].decode("utf-8", "ignore")).attrs[1]):
                    if void:
                        yield m[0].decode("utf-8", "ignore")
                        buf, at = buf[at:], 0
                        continue
                    self.depth, self.start = 1, m.start()
                elif self.depth and not void:
                    self.depth += 1
            if name in (b"script", b"style") and not closed:
                self.raw = name
        if self.depth == 0:
            self.buffer, self._resume = buf[at:], 0
        else:
            self.buffer, self._resume = buf[self.start :], at - self.start
            self.start = 0

    _resume = 0


def split_rows(chunks: Iterable[bytes], outer: str) -> Iterator[str]:
    """Complete rows of a stream of chunks, in order; a row that never ends is not given."""
    s = Scanner(Target(outer))
    for c in chunks:
        yield from s.feed(c)


def rows(pages: DataFrame, outer: str, fields: dict[str, str] | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """ord and row (markup), or ord and the first value of each field inside the row, of whole pages."""
    Target(outer)

    def compute(dom: Dom, row: dict):
        for k, markup in enumerate(split_rows([(row[html_col] or "").encode()], outer)):
            if fields is None:
                yield k, markup
            else:
                d = Dom(markup)
                yield (k, *(next(iter(css.values(d, s, 1)), None) for s in fields.values()))

    schema = "ord int, row string" if fields is None else "ord int, " + ", ".join(f"`{k}` string" for k in fields)
    return map_rows(pages, html_col, compute, schema, keep, (html_col,))


def stream_rows(chunks: DataFrame, outer: str) -> DataFrame:
    """doc_id, ord, row from a streaming table of chunks (doc_id, seq, chunk), which come in order of seq within each trigger."""
    target = Target(outer)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, depth, start, raw, resume, n = state.get if state.exists else (b"", 0, -1, b"", 0, 0)
        s = Scanner(target, (bytes(buffer), depth, start, bytes(raw)))
        s._resume = resume
        found = []
        for chunk in pd.concat(list(frames)).sort_values("seq")["chunk"]:
            found += list(s.feed(bytes(chunk)))
        state.update((*s.state, s._resume, n + len(found)))
        yield pd.DataFrame({"doc_id": [key[0]] * len(found), "ord": range(n, n + len(found)), "row": found})

    return chunks.groupBy("doc_id").applyInPandasWithState(step, "doc_id long, ord long, row string", "buffer binary, depth int, start int, raw binary, resume int, n long", "append", GroupStateTimeout.NoTimeout)
