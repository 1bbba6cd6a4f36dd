"""A page's title and main text, for use inside tasks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements that hold no content, elements without an end, and marks of a main region in order.
FURNITURE = {"script", "style", "nav", "header", "footer", "aside"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
REGIONS = ("main", "article", "role=main", "main-content", "content", "post-content", "entry-content")


class _Walk(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.stack, self.found = "", [], {k: [] for k in (*REGIONS, "body", "all")}
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        self.stack.append(tag)
        a = dict(attrs)
        marks = {tag, f"role={a.get('role')}", *(a.get("class") or "").split()}
        for r in (*REGIONS, "body"):
            if r in marks and r not in self.open and not self.found[r]:
                self.open[r] = len(self.stack)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while self.stack.pop() != tag:
            pass
        self.open = {r: d for r, d in self.open.items() if d <= len(self.stack)}

    def handle_data(self, data: str) -> None:
        if "title" in self.stack:
            self.title = self.title or data.strip()
        elif not FURNITURE & set(self.stack):
            self.found["all"].append(data)
            for r in self.open:
                self.found[r].append(data)


def main_text(html: str) -> tuple[str, str]:
    """(title, text) of the first main region that has text, else of the body, else of the whole."""
    walk = _Walk()
    walk.feed(html)
    walk.close()
    for r in (*REGIONS, "body", "all"):
        text = re.sub(r"\s+", " ", " ".join(walk.found[r])).strip()
        if text:
            return walk.title, text
    return walk.title, ""
