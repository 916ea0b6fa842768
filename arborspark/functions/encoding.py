"""Encodings of raw pages: detection from marks and declarations, normalised names, and text that never fails."""

from __future__ import annotations

import codecs
import re

_MARKS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]
_META = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)
#: fixed values: names under which browsers mean another encoding
_ALIASES = {"latin1": "windows-1252", "latin-1": "windows-1252", "iso-8859-1": "windows-1252", "ascii": "windows-1252", "us-ascii": "windows-1252", "sjis": "shift_jis", "x-sjis": "shift_jis", "shift-jis": "shift_jis", "eucjp": "euc-jp", "gb2312": "gbk", "utf8": "utf-8", "big5-hkscs": "big5"}


def normalize(name: str) -> str:
    low = name.strip().lower()
    return _ALIASES.get(low, low)


def detect(raw: bytes) -> str:
    """By byte-order mark, else by a meta declaration in the first 1024 bytes, else UTF-8."""
    for mark, name in _MARKS:
        if raw.startswith(mark):
            return name
    m = _META.search(raw[:1024])
    name = normalize(m[1].decode("ascii")) if m else "utf-8"
    try:
        codecs.lookup(name)
    except LookupError:
        return "utf-8"
    return name


def to_text(raw: bytes, encoding: str | None = None) -> str:
    """The text without its mark; bytes that the encoding does not know are dropped."""
    name = normalize(encoding) if encoding else detect(raw)
    for mark, _ in _MARKS:
        if raw.startswith(mark):
            raw = raw[len(mark) :]
            break
    try:
        return raw.decode(name, "ignore")
    except LookupError:
        return raw.decode("utf-8", "ignore")
