"""Values from text: numbers, money, dates, URLs and lists, for one string (Python) and for a column (Spark expressions).

Both give the same results; the column forms stay inside Catalyst and are what queries should use on plain columns.
"""

from __future__ import annotations

import datetime
import json
import re
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE = ("true", "yes", "1", "on", "enabled")
FALSE = ("false", "no", "0", "off", "disabled")
#: Date forms that are read, in Spark's and in Python's notation.
DATES = [("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy/MM/dd", "%Y/%m/%d"), ("MM/dd/yyyy", "%m/%d/%Y"), ("d MMM yyyy", "%d %b %Y"), ("d MMMM yyyy", "%d %B %Y"), ("MMM d, yyyy", "%b %d, %Y"), ("MMMM d, yyyy", "%B %d, %Y")]
_AMOUNT = re.compile(r"-?\d[\d.,]*")


def integer(v: str) -> int | None:
    kept = re.sub(r"[^0-9-]", "", v)
    if kept in ("", "-"):
        return None
    m = re.match(r"-?\d+", kept)
    return int(m[0]) if m else 0


def floating(v: str) -> float | None:
    kept = re.sub(r"[^0-9.-]", "", v)
    return None if kept in ("", "-", ".") else _prefix(kept)


def _prefix(v: str) -> float:
    m = re.match(r"-?\d+(\.\d+)?", v)
    return float(m[0]) if m else 0.0


def _grouped(v: str, mark: str) -> bool:
    return bool(re.fullmatch(rf"-?\d{{1,3}}(?:{re.escape(mark)}\d{{3}})+", v))


def money(v: str) -> float | None:
    """The first amount: where both separators occur the later one is decimal; one kind alone groups if its groups of three say so."""
    m = _AMOUNT.search(v)
    if not m:
        return None
    s = m[0]
    comma, dot = s.rfind(","), s.rfind(".")
    if comma >= 0 and dot >= 0:
        s = s.replace(".", "").replace(",", ".") if comma > dot else s.replace(",", "")
    elif comma >= 0:
        s = s.replace(",", "") if _grouped(s, ",") else s.replace(",", ".")
    elif s.count(".") > 1 and _grouped(s, "."):
        s = s.replace(".", "")
    return _prefix(s)


def number(v: str) -> int | float | None:
    m = re.search(r"-?\d+(\.\d+)?", v.replace(",", ""))
    return None if not m else float(m[0]) if m[1] else int(m[0])


def boolean(v: str) -> bool | None:
    low = v.strip().lower()
    return True if low in TRUE else False if low in FALSE else None


def date(v: str) -> datetime.date | None:
    s = v.strip()
    s = s[:10] if re.match(r"\d{4}-\d{2}-\d{2}[T ]", s) else s
    for _, form in DATES:
        try:
            return datetime.datetime.strptime(s, form).date()
        except ValueError:
            continue
    return None


def parsed_json(v: str):
    try:
        return json.loads(v)
    except ValueError:
        return None


def listing(v: str, delimiter: str = r"\s*,\s*", literal: bool = False) -> list[str]:
    parts = v.split(delimiter) if literal else re.split(delimiter, v)
    return [x.strip() for x in parts if x.strip()]


def absolute(href: str | None, base: str | None) -> str | None:
    """An address with a scheme stands; others are joined to the base, if there is one; what cannot be joined stays."""
    if href is None or re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", href) or not base:
        return href
    try:
        return urljoin(base, href)
    except ValueError:
        return href


# --- columns --------------------------------------------------------------------------------------------------------------


def clean_col(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f\x0B]+", " "))


def integer_col(c: Column) -> Column:
    kept = F.regexp_replace(c, "[^0-9-]", "")
    lead = F.regexp_extract(kept, r"^-?[0-9]+", 0)
    return F.when(kept.isin("", "-"), None).when(lead == "", F.lit(0).cast("bigint")).otherwise(lead.try_cast("bigint"))


def _prefix_col(c: Column) -> Column:
    lead = F.regexp_extract(c, r"^-?[0-9]+(\.[0-9]+)?", 0)
    return F.when(lead == "", F.lit(0.0)).otherwise(lead.try_cast("double"))


def float_col(c: Column) -> Column:
    kept = F.regexp_replace(c, "[^0-9.-]", "")
    return F.when(kept.isin("", "-", "."), None).otherwise(_prefix_col(kept))


def money_col(c: Column) -> Column:
    s = F.regexp_extract(c, r"-?[0-9][0-9.,]*", 0)
    comma, dot = F.contains(s, F.lit(",")), F.contains(s, F.lit("."))
    later = F.instr(F.reverse(s), ",") < F.instr(F.reverse(s), ".")
    no = lambda x, mark: F.replace(x, F.lit(mark), F.lit(""))
    both = F.when(later, F.replace(no(s, "."), F.lit(","), F.lit("."))).otherwise(no(s, ","))
    commas = F.when(F.rlike(s, F.lit(r"^-?[0-9]{1,3}(,[0-9]{3})+$")), no(s, ",")).otherwise(F.replace(s, F.lit(","), F.lit(".")))
    dots = F.when(F.rlike(s, F.lit(r"^-?[0-9]{1,3}(\.[0-9]{3}){2,}$")), no(s, ".")).otherwise(s)
    return F.when(s == "", None).otherwise(_prefix_col(F.when(comma & dot, both).when(comma, commas).otherwise(dots)))


def boolean_col(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)


def date_col(c: Column) -> Column:
    s = F.trim(c)
    s = F.when(F.rlike(s, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]")), F.substring(s, 1, 10)).otherwise(s)
    return F.coalesce(*[F.try_to_date(s, form) for form, _ in DATES])


def json_col(c: Column) -> Column:
    return F.try_parse_json(c)


def list_col(c: Column, delimiter: str = r"\s*,\s*") -> Column:
    return F.filter(F.transform(F.split(c, delimiter), lambda x: F.trim(x)), lambda x: x != "")


def escape_col(c: Column, quote: bool = False, apostrophe: bool = False) -> Column:
    for a, b, on in (("&", "&amp;", True), ("<", "&lt;", True), (">", "&gt;", True), ('"', "&quot;", quote), ("'", "&#39;", apostrophe)):
        c = F.replace(c, F.lit(a), F.lit(b)) if on else c
    return c


def host_col(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"://([^/?#:]+)", 1))


def charset_col(content_type: Column) -> Column:
    found = F.lower(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", 1))
    return F.when(found == "", None).otherwise(found)
