"""Command line over one page: python -m arborspark.cli COMMAND FILE (- for standard input)."""

from __future__ import annotations

import argparse
import json
import sys

from .functions import encoding
from .functions.html import Dom, events
from .operators import structured
from .operators.extract import record
from .plans import css, xpath
from .plans.schema import Schema


def _info(dom: Dom) -> dict:
    first = lambda s: next((dom.text(i) for i in css.select(dom, s, limit=1)), None)
    tags = sorted({dom.tag[i] for i in dom.elements})
    return {"title": first("title"), "nodes": len(dom), "elements": len(dom.elements), "tags": tags, "doctype": dom.doctype, "page_type": structured.page_type(dom)}


COMMANDS = {
    "info": lambda dom, raw, a: _info(dom),
    "page-type": lambda dom, raw, a: structured.page_type(dom),
    "encoding": lambda dom, raw, a: encoding.detect(raw),
    "jsonld": lambda dom, raw, a: structured.json_ld_items(dom),
    "opengraph": lambda dom, raw, a: structured.meta(dom, "og:"),
    "schema-org": lambda dom, raw, a: [x for x in structured.json_ld_items(dom) if not a.type or a.type in structured.types_of(x)],
    "microdata": lambda dom, raw, a: structured.microdata_items(dom),
    "rdfa": lambda dom, raw, a: structured.rdfa_items(dom),
    "sax": lambda dom, raw, a: [list(e) for e in events(encoding.to_text(raw))],
    "css": lambda dom, raw, a: css.values(dom, a.select),
    "xpath": lambda dom, raw, a: xpath.strings(dom, a.select),
    "extract": lambda dom, raw, a: record(dom, Schema.from_json(open(a.schema).read()).items, 0, a.base),
}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="arborspark", description=__doc__)
    p.add_argument("command", choices=[*COMMANDS, "version"])
    p.add_argument("file", nargs="?", default="-")
    p.add_argument("--select", help="selector or expression of css and xpath")
    p.add_argument("--schema", help="JSON file of extract")
    p.add_argument("--base", help="address that relative links are joined to")
    p.add_argument("--type", help="type that schema-org keeps")
    p.add_argument("--compact", action="store_true", help="one line of JSON")
    a = p.parse_args(argv)
    if a.command == "version":
        print("0.1.0")
        return 0
    if a.file == "-":
        raw = sys.stdin.buffer.read()
    else:
        with open(a.file, "rb") as f:
            raw = f.read()
    got = COMMANDS[a.command](Dom(encoding.to_text(raw)), raw, a)
    print(json.dumps(got, ensure_ascii=False, default=str, indent=None if a.compact else 2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
