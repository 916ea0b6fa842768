"""The full entity table and its decoder; documents themselves decode only the few names of html.decode()."""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import character

_REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]+)|#([0-9]+)|([A-Za-z][A-Za-z0-9]*));")


def decode(text: str) -> str:
    """Named (HTML 4 and apos) and numeric references; unknown ones stay, nbsp is a plain space."""

    def one(m: re.Match) -> str:
        if m[3] is None:
            return character(int(m[1], 16) if m[1] else int(m[2]))
        if m[3] == "nbsp":
            return " "
        if m[3] == "apos":
            return "'"
        return chr(name2codepoint[m[3]]) if m[3] in name2codepoint else m[0]

    return _REFERENCE.sub(one, text) if "&" in text else text


def decode_col(c: Column) -> Column:
    """decode() as an expression: the text is split at references, and each is looked up in a map."""
    table = {**{k: chr(v) for k, v in name2codepoint.items()}, "apos": "'", "nbsp": " "}
    names = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    parts = F.regexp_extract_all(c, F.lit(r"&#[xX][0-9a-fA-F]{1,7};|&#[0-9]{1,9};|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"), F.lit(0))

    def numeric(code: Column) -> Column:
        bad = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        wide = F.lpad(F.hex(code), 8, "0")
        return F.when(bad, F.lit("�")).otherwise(F.decode(F.unhex(wide), "UTF-32"))

    def one(p: Column) -> Column:
        inner = F.substring(p, F.lit(2), F.length(p) - 2)
        hexa = F.conv(F.substring(p, F.lit(4), F.length(p) - 4), 16, 10).cast("bigint")
        deci = F.substring(p, F.lit(3), F.length(p) - 3).try_cast("bigint")
        reference = F.startswith(p, F.lit("&")) & (F.length(p) > 1)
        return F.when(~reference, p).when(F.rlike(p, F.lit("^&#[xX]")), numeric(hexa)).when(F.startswith(p, F.lit("&#")), numeric(deci)).otherwise(F.coalesce(F.element_at(names, inner), p))

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(c)
