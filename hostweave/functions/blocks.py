"""The one page rule that needs a tag counter: find a footer-like block.

Only the standard library is used, and the module is shipped to the Python
workers by value, so they do not need this package installed.
"""

from __future__ import annotations

import sys
from html.parser import HTMLParser

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _BlockFinder(HTMLParser):
    """Offsets of the first block element whose class, id or role names a footer."""

    def __init__(self, page: str, hints: tuple[str, ...]):
        super().__init__(convert_charrefs=False)
        self._line_starts = [0]
        for line in page.split("\n")[:-1]:
            self._line_starts.append(self._line_starts[-1] + len(line) + 1)
        self.start = self.end = None
        self._hints = hints
        self._tag, self._depth = "", 0
        self.feed(page)

    def _offset(self) -> int:
        line, column = self.getpos()
        return self._line_starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if self.start is None:
            named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
            if tag in ("div", "section", "aside") and any(
                w in named for w in self._hints
            ):
                self.start, self._tag, self._depth = self._offset(), tag, 1
        elif self.end is None and tag == self._tag:
            self._depth += 1

    def handle_endtag(self, tag):
        if self.start is not None and self.end is None and tag == self._tag:
            self._depth -= 1
            if self._depth == 0:
                self.end = self._offset()


def marked_block(page: str, hints: tuple[str, ...]) -> str:
    """The footer-like block of a page, without trailing text; ``''`` if none."""
    found = _BlockFinder(page, hints)
    if found.start is None:
        return ""
    if found.end is None:
        return page[found.start:]
    close = page.find(">", found.end)
    return page[found.start:close + 1 if close >= 0 else len(page)]
