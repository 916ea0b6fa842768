"""Callbacks over the event stream of one page."""

from __future__ import annotations

from .html import events


class Handler:
    """Override what is of interest."""

    def start_document(self) -> None: ...

    def end_document(self) -> None: ...

    def doctype(self, name: str) -> None: ...

    def start_element(self, name: str, attrs: dict[str, str]) -> None: ...

    def end_element(self, name: str) -> None: ...

    def characters(self, text: str) -> None: ...

    def comment(self, text: str) -> None: ...


def parse(html: str, handler: Handler) -> Handler:
    for kind, name, attrs, data in events(html):
        match kind:
            case "doc_start":
                handler.start_document()
            case "doc_end":
                handler.end_document()
            case "doctype":
                handler.doctype(name or "")
            case "start":
                handler.start_element(name or "", attrs or {})
            case "end":
                handler.end_element(name or "")
            case "text":
                handler.characters(data or "")
            case "comment":
                handler.comment(data or "")
    return handler


def parse_file(path: str, handler: Handler) -> Handler:
    from .encoding import to_text

    with open(path, "rb") as f:
        return parse(to_text(f.read()), handler)
