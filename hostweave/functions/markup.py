"""Column expressions for HTML: visible text, titles, blocks and anchors."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostweave.functions import fixed
from hostweave.functions.stages import constant, let

# Marks the place of removed markup until text nodes are joined.
_CUT = "\x01"
_TRIM = " \t\n\r\f\x0b\u00a0"

#: Names that count without a semicolon, longest first, so that a match is the longest prefix.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
#: Numbers the standard reads as other characters, and code points it leaves out.
_MOVED = {0: "\ufffd", 13: "\r"} | {
    n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
_NO_CHARACTER = [(0x1, 0x8), (0xB, 0xB), (0xE, 0x1F), (0x7F, 0x9F), (0xFDD0, 0xFDEF)] + [
    (plane + 0xFFFE, plane + 0xFFFF) for plane in range(0, 0x110000, 0x10000)]

TEXT_SKIPS = ("script", "style", "noscript", "svg", "iframe")
PHONE_SKIPS = ("script", "style", "noscript")


def _numbered(digits: Column, base: int) -> Column:
    """The character of a number, as the HTML standard reads it."""
    short = F.regexp_replace(digits, "^0+", "")
    code = F.when(F.length(short) > 7, F.lit(0x110000)).otherwise(
        F.coalesce(F.conv(short, base, 10).try_cast("bigint"), F.lit(0)).cast("int"))

    def character(n: Column) -> Column:
        none = F.lit(False)
        for low, high in _NO_CHARACTER:
            none = none | n.between(low, high)
        moved = F.create_map(*[F.lit(x) for pair in _MOVED.items() for x in pair])
        plain = F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32")
        return F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd")).when(
            (n < 0xA0) & F.array_contains(F.map_keys(moved), n), F.try_element_at(moved, n)
        ).when(none, F.lit("")).otherwise(plain)

    return let(code, character)


def decode_entities(text: Column) -> Column:
    """Decode character references as the HTML standard does, in one pass.

    Every name counts, and those that may lack their semicolon also as the longest
    prefix of what follows ``&``.  The text is cut at ``&`` and only the start of
    each piece is looked at; common names are looked up first.
    """
    common = constant(fixed.ENTITIES, "map<string,string>")
    named = constant({n[:-1]: c for n, c in html5.items() if n.endswith(";")}, "map<string,string>")
    bare = constant({n: html5[n] for n in _BARE}, "map<string,string>")

    def numbered(part: Column) -> Column:
        def read(pattern: str, base: int, otherwise: Column) -> Column:
            return let(F.regexp_extract(part, pattern, 0), lambda ref: F.when(
                ref == "", otherwise
            ).otherwise(F.concat(
                _numbered(F.regexp_extract(ref, "[0-9a-fA-F]+", 0), base),
                F.substring(part, F.length(ref) + 1, F.length(part)))))
        return read("^#[xX][0-9a-fA-F]+;?", 16, read("^#[0-9]+;?", 10, F.concat(F.lit("&"), part)))

    def prefixed(part: Column) -> Column:
        return let(F.regexp_extract(part, "^(?:" + "|".join(_BARE) + ")", 0), lambda ref: F.when(
            ref == "", F.concat(F.lit("&"), part)
        ).otherwise(F.concat(F.element_at(bare, ref), F.substring(part, F.length(ref) + 1, F.length(part)))))

    def lettered(part: Column) -> Column:
        def whole(ref: Column) -> Column:
            char = F.when(ref != "", F.coalesce(F.try_element_at(common, ref), F.try_element_at(named, ref)))
            return let(char, lambda c: F.when(c.isNull(), prefixed(part)).otherwise(
                F.concat(c, F.substring(part, F.length(ref) + 2, F.length(part)))))
        return let(F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]{1,31});", 1), whole)

    def piece(part: Column) -> Column:
        return F.when(part.startswith("#"), numbered(part)).otherwise(lettered(part))

    def joined(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, 2, F.size(parts)), piece)
        return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))

    return let(text, lambda t: F.when(
        t.contains("&"), let(F.split(t, "&"), joined)
    ).otherwise(t))


def visible_text(html: Column, skip: tuple[str, ...] = TEXT_SKIPS) -> Column:
    """Text nodes outside ``skip`` elements, each stripped, joined by one space.

    White space *inside* a text node stays as written.  One pass removes
    comments and skipped elements together, so neither can hide in the other.
    """
    names = "|".join(skip)
    hidden = rf"(?is)<!--.*?(?:-->|\z)|<({names})\b.*?(?:</\1\s*>|\z)"
    cut = F.regexp_replace(html, hidden, _CUT)
    cut = F.regexp_replace(cut, r"<[A-Za-z/!?][^>]*>", _CUT)
    nodes = F.transform(
        F.split(decode_entities(cut), _CUT), lambda n: F.btrim(n, F.lit(_TRIM))
    )
    return F.array_join(F.filter(nodes, lambda n: n != ""), " ")


def title_of(html: Column) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title", 1)
    return F.btrim(decode_entities(raw), F.lit(_TRIM))


def strict_footer(html: Column) -> Column:
    """First ``<footer>`` element, up to the end if it is never closed; ``''`` if none."""
    return F.regexp_extract(html, r"(?is)<footer\b.*?(?:</footer\s*>|\z)", 0)


def anchors(html: Column) -> Column:
    """All ``<a>`` elements in order, as text."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>.*?(?:</a\s*>|\z)"), F.lit(0))


def anchor_tags(html: Column) -> Column:
    """All opening ``<a>`` tags in order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>"), F.lit(0))


def href_of(tag: Column) -> Column:
    pattern = r"""(?is)^<a\b[^>]*?\shref\s*=\s*(?:["']([^"']*)["']|([^\s"'>]+))"""
    raw = F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))
    return F.replace(raw, F.lit("&amp;"), F.lit("&"))
