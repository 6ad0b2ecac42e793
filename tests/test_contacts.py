"""Contact extraction against plain Python on small fixtures."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from hostweave.functions import fixed
from hostweave.operators import contacts

PLAIN = re.compile(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b")
SPELLED = re.compile(
    r"([A-Za-z0-9._%+\-]+)\s*[\[(]\s*at\s*[\])]\s*([A-Za-z0-9.\-]+)\s*[\[(]\s*dot\s*[\])]\s*"
    r"([A-Za-z]{2,})", re.I)
CHUNK = re.compile(
    rf"[^.]*?(?:{'|'.join(fixed.PHONE_CONTEXT)})[^.]{{0,120}}", re.I)


def junk(e: str) -> bool:
    low = e.lower()
    return (len(e) > 80 or any(j in low for j in fixed.EMAIL_JUNK)
            or low.endswith(tuple("." + s for s in fixed.EMAIL_ASSET_SUFFIXES)))


def plain_emails(text: str) -> set[str]:
    found = {m.strip(".,;:()[]{}") for m in PLAIN.findall(text) if not junk(m)}
    found |= {f"{a}@{b}.{c}" for a, b, c in SPELLED.findall(text) if not junk(f"{a}@{b}.{c}")}
    return found


def plain_phones(text: str) -> set[str]:
    out = set()
    for chunk in CHUNK.findall(text):
        for m in re.findall(fixed.PHONE_PATTERN, chunk):
            digits = re.sub(r"[^\d+]", "", m)
            if 9 <= len(digits) <= 16:
                out.add(digits)
    return out


def random_texts(seed: int, n: int, pieces: list[str], length: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, length))) for _ in range(n)]


def test_emails_match_plain_regex_on_random_text(spark):
    pieces = ["a", "B7", "@", ".", "-", "+", "%", "_", " ", "shop.co", "x@y.com", "[at]", " (dot) ",
              "com", "noreply@", ".png", "/", "\n", "info [at] b [dot] io"]
    texts = random_texts(1, 1500, pieces, 14)
    df = spark.createDataFrame(list(enumerate(texts)), "page_id int, html string")
    got: dict[int, set[str]] = {}
    for r in contacts.emails(df).collect():
        got.setdefault(r.page_id, set()).add(r.email)
    for i, text in enumerate(texts):
        assert got.get(i, set()) == plain_emails(text), text


def test_phones_match_literal_chunk_regex_on_random_text(spark):
    pieces = ["call ", "Phone", "hotel ", ".", " ", "555 123 4567", "+1-202-555-0143", "12345678",
              "x" * 60, "contact us", "(020) 7946 0018", "\n", "tel", "9"]
    texts = random_texts(2, 800, pieces, 14)
    df = spark.createDataFrame(list(enumerate(texts)), "page_id int, html string")
    got: dict[int, set[str]] = {}
    for r in contacts.phones(df).collect():
        got.setdefault(r.page_id, set()).add(r.phone)
    for i, text in enumerate(texts):
        visible = text.strip()
        links = set()
        assert got.get(i, set()) - links == plain_phones(visible), text


def test_long_runs_stay_linear(spark):
    """Path data, hex and context-free text of half a million characters."""
    page = "1.5-2.3" * 40_000 + "f" * 200_000 + " call " + "word " * 60_000
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert contacts.emails(df).count() == 0
    assert contacts.phones(df).count() == 0


def test_golden_contacts(spark):
    pages = {
        1: "info [at] shop [dot] com", 2: '<a data-cfemail="422b2c242d02232f276c2b2d">',
        3: "noreply@a.co icon@2x.png", 4: '<a href="tel:+1555123">', 5: "Call 5551 2345",
        6: '<a href="https://www.facebook.com/sharer/">', 7: "mailto:Me@B.co?subject=x me@b.co",
        8: '<a href="https://api.whatsapp.com/send?phone=12">'
           '<a href="https://api.whatsapp.com/send?phone=+1 555 123 4567">',
        9: '<a href="tel:12345"><a href="tel:123-456-78">',
    }
    df = spark.createDataFrame(list(pages.items()), "page_id int, html string")
    found = df.select("page_id", F.explode(contacts.contacts_in(F.col("html"))).alias("c"))
    got: dict[int, set] = {}
    for r in found.collect():
        got.setdefault(r.page_id, set()).add((r.c.kind, r.c.value))
    assert got == {
        1: {("email", "info@shop.com")}, 2: {("email", "info@ame.io")},
        4: {("phone", "+1555123")}, 7: {("email", "Me@B.co"), ("email", "me@b.co")},
        8: {("social", "+15551234567")}, 9: {("phone", "12345678")},
    }


def staged_search(values: list[tuple[int, str, str, str]]) -> set[tuple[str, str, str]]:
    """Search stage by stage and stop when there is enough."""
    found: set[tuple[str, str, str]] = set()
    for stage in range(contacts.FIRST_LINK + 3):
        kinds = [k for k, _, _ in found]
        enough = "email" in kinds or ("phone" in kinds and "social" in kinds)
        if stage > contacts.FOOTER and enough:
            break
        found |= {(k, n, v) for s, k, n, v in values if s == stage}
    return found


def test_cascade_equals_staged_search(spark):
    rng = random.Random(3)
    sites: dict[str, list] = {}
    for i in range(400):
        sites[f"s{i}"] = [
            (rng.randrange(19), kind, rng.choice(["instagram", "tiktok"]) if kind == "social" else "",
             f"{kind}{rng.randrange(4)}")
            for kind in rng.choices(["email", "phone", "social"], [1, 3, 3], k=rng.randint(1, 6))
        ]
    rows = [(s, *v) for s, vs in sites.items() for v in vs]
    df = spark.createDataFrame(
        rows, "site string, stage int, kind string, network string, value string")
    got: dict[str, set] = {}
    for r in contacts.contact_cascade(df).collect():
        got.setdefault(r.site, set()).add((r.kind, r.network, r.value))
    for site, values in sites.items():
        assert got.get(site, set()) == staged_search(values), site


def test_assembled_lists_are_sorted_and_whole(spark):
    rows = [("s", 0, "email", "", f"e{i:02d}@a.co") for i in range(12)]
    rows += [("s", 0, "social", "tiktok", f"t{i}") for i in range(7)]
    df = spark.createDataFrame(
        rows, "site string, stage int, kind string, network string, value string")
    row = contacts.assemble_contacts(df.union(df)).collect()[0]
    assert row.emails == [f"e{i:02d}@a.co" for i in range(12)]
    assert row.phones == []
    assert row.socials == {"tiktok": [f"t{i}" for i in range(7)]}
    row = contacts.assemble_contacts(df, {"email": 10, "social": 5}).collect()[0]
    assert (len(row.emails), len(row.socials["tiktok"])) == (10, 5)


def test_a_site_with_enough_is_not_searched_further(spark):
    filler = "<p>words</p>"
    pages = spark.createDataFrame([
        ("https://a.com/", "<a href='mailto:home@a.com'>m</a>"), ("https://a.com/contact", "<a href='mailto:more@a.com'>m</a>"),
        ("https://b.com/", filler + "<footer><a href='/team'>our team: about us</a></footer>"),
        ("https://b.com/contact", "<a href='tel:+15551234567'>t</a>"), ("https://b.com/team", "<a href='mailto:team@b.com'>m</a>"),
        ("https://c.com/contact", "<a href='mailto:none@c.com'>m</a>"),
    ], "url string, html string")
    sites = spark.createDataFrame([("https://a.com",), ("https://b.com",), ("https://a.com",)], "site string")
    rows = {(r.site[8:], r.kind, r.value) for r in contacts.search_contacts(sites, pages).collect()}
    assert rows == {("a.com", "email", "home@a.com"), ("b.com", "phone", "+15551234567"), ("b.com", "email", "team@b.com")}
    staged = contacts.staged_contacts(sites.distinct(), contacts.page_contacts(pages).cache())
    assert {r.value for r in staged.collect()} == {v for *_, v in rows} | {"more@a.com"}
    key = ["site", "kind", "network", "value", "first_stage"]
    kept = [sorted(map(tuple, contacts.contact_cascade(x).select(*key).collect()))
            for x in (staged, contacts.search_contacts(sites, pages))]
    assert kept[0] == kept[1]
    assert contacts.search_contacts(sites, pages.where("false")).count() == 0
