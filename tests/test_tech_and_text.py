from __future__ import annotations

import html as standard
import random
from html.entities import html5

from pyspark.sql import functions as F

from hostweave.functions import fixed, markup
from hostweave.functions.blocks import marked_block
from hostweave.operators import expand, tech, text


def scan(spark, pages):
    df = spark.createDataFrame(pages, "page_id int, html string, headers_text string")
    return {r.page_id: {h.platform: h.evidence for h in r.hits}
            for r in tech.fingerprint(df).collect()}


def test_markers_match_a_plain_scan(spark):
    pages = [(i, f"<x>{m.upper()}</x>", "") for i, m in enumerate(
        m for ms in fixed.FINGERPRINTS.values() for m in ms)]
    got = scan(spark, pages)
    for i, page, _ in pages:
        blob = page.lower() + " "
        expected = {}
        for platform, markers in fixed.FINGERPRINTS.items():
            hits = [m for m in markers if m in blob]
            if hits:
                expected[platform] = hits
        if "WooCommerce" in expected and "WordPress" not in expected:
            expected["WordPress"] = None
        assert got[i] == expected


def test_headers_and_implied(spark):
    got = scan(spark, [(1, "", "X-ShopId: 1"), (2, "wc_add_to_cart", None), (3, None, None),
                       (4, "x" * 900_000 + "cdn.shopify.com", "")])
    assert got == {1: {"Shopify": ["x-shopid"]},
                   2: {"WooCommerce": ["wc_add_to_cart"], "WordPress": None}, 3: {}, 4: {"Shopify": ["cdn.shopify.com"]}}


def test_rerender_and_merge(spark):
    df = spark.createDataFrame(
        [(1, "data-reactroot", ""), (2, "data-reactroot wix.com", ""), (3, "", "")],
        "page_id int, html string, headers_text string")
    fp = tech.fingerprint(df)
    assert {r.page_id for r in tech.rerender_candidates(fp).collect()} == {1, 3}
    late = tech.fingerprint(
        spark.createDataFrame([(1, "react-dom data-reactroot cdn.zid.sa")], "page_id int, html string"),
        headers=None)
    merged = {r.page_id: {h.platform: h.evidence for h in r.hits}
              for r in tech.merge_passes(fp, late).collect()}
    assert merged[1] == {"React": ["data-reactroot"], "Zid": ["cdn.zid.sa"]}


def test_marker_table_of_any_length(spark):
    table = spark.createDataFrame([("P", "b"), ("P", "a"), ("Q", "c")], "platform string, marker string")
    assert tech.markers_from_table(table) == {"P": ["a", "b"], "Q": ["c"]}
    many = spark.range(2_500).selectExpr("'P' as platform", "concat('m', id) as marker")
    assert len(tech.markers_from_table(many)["P"]) == 2_500


def test_marker_tables_match_a_plain_scan(spark, monkeypatch):
    monkeypatch.setattr(tech, "PIECE", 50)
    rng = random.Random(8)
    letters = "abcé "
    markers = {(f"P{rng.randrange(9)}", "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 12])))) for _ in range(300)}
    pages = [(i, "".join(rng.choice(letters.upper()) for _ in range(rng.choice([0, 1, 3, 60, 400])))) for i in range(40)]
    pages += [(90, "x" * 49 + "marker on a border"), (91, None), (92, pages[-1][1])]
    markers |= {("B", "Marker on a border"), ("B", "border"), ("E", ""), ("E", None)}
    expected = {}
    for i, page in pages:
        for platform, marker in markers:
            if marker and marker.lower() in (page or "").lower():
                expected.setdefault((i, platform), set()).add(marker.lower())
    table = spark.createDataFrame(list(markers), "platform string, marker string")
    df = spark.createDataFrame(pages, "page_id int, html string")
    found = tech.fingerprint_by_table(df, table, headers=None)
    assert {(r.page_id, r.platform): r.evidence for r in found.collect()} == {k: sorted(v) for k, v in expected.items()}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert tech.fingerprint_by_table(df, table.limit(0), headers=None).count() == 0


def test_places_are_matched_with_shapes_of_markers_not_with_each_marker(spark):
    """Many markers filed under one gram cost a place one string per position and length."""
    texts = spark.createDataFrame([(1, "aqzx 7777 b"), (2, "no mark, zx 12"), (3, "x 5555")], "page_id int, _blob string")
    texts = texts.union(spark.range(1000, 10_000).selectExpr("-id", "concat('x ', id, ' zx ')"))
    known = spark.range(1000, 10_000).selectExpr("'P' as platform", "concat('zx ', id) as marker")
    places = tech._places(texts, ["page_id"], "_blob", 7, [4])
    index = tech.marker_index(places, known, 7)
    assert index.groupBy().agg({"offset": "max"}).first()[0] <= 3
    strings = tech.possible_markers(places, index, ["page_id"], 7)
    assert strings.count() <= places.count()
    assert [tuple(r) for r in strings.join(index, "marker").select("page_id", "marker").collect()] == [(1, "zx 7777")]


def test_fingerprint_plan_has_no_shuffle_and_prunes_columns(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    plan = tech.fingerprint(pages, headers=None)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan


def test_visible_text(spark):
    pages = {
        "<p>a <b> b</b>c</p>": "a b c", "<p>two\n  words</p>\n\n<p> x</p>": "two\n  words x",
        '<script>var t="</p>";</script>y<!-- <p>z</p> -->w': "y w", "1 < 2 &amp;lt; &#8217;&#x41;&nbsp;": "1 < 2 &lt; ’A",
        "<noscript>n</noscript><svg><g>s</g></svg><iframe>i</iframe>k": "k",
        "open <script>never closed": "open", "a&#; &bogus; b": "a&#; &bogus; b", "": "",
    }
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    got = {r.html: r.t for r in df.select("html", markup.visible_text(F.col("html")).alias("t")).collect()}
    assert got == pages


def test_references_are_decoded_as_the_standard_does(spark):
    rng = random.Random(4)
    names = sorted(html5)
    texts = [f"a&{n}b" for n in names] + [f"&{n}" for n in names] + [f"&#{n};" for n in [*range(300), 0xD800, 0xFDD0, 0x1FFFE, 0x110000]]
    texts += ["&#x1F600;x", "&#X41", "&#0065;", "&#99999999999;", "&#xZ;", "&&amp", "a=1&b=2&copy=3", "&notin &notit; &am", "&#", "&", "", "&\u00e9;"]
    texts += ["".join(rng.choice(["&", "#", "x", "amp", ";", "not", "in", "1", "5", " ", "gt", "lt", "A"]) for _ in range(9))
              for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.d for r in df.select("i", markup.decode_entities(F.col("t")).alias("d")).collect()}
    wrong = [(t, got[i], standard.unescape(t)) for i, t in enumerate(texts) if got[i] != standard.unescape(t)]
    assert not wrong, wrong[:5]


def test_short_pages_are_flagged_and_whole(spark):
    df = spark.createDataFrame([("<title> T </title><p>" + "x" * 97 + "</p>",), ("<title>T</title>" + "y" * 4000,)],
                               "html string")
    rows = text.page_text(df).collect()
    assert [(r.title, len(r.text), r.short) for r in rows] == [("T", 99, True), ("T", 4002, False)]


def test_footer_like_blocks(spark):
    hints = tuple(fixed.FOOTER_HINTS)
    assert marked_block('<div>a<div id="Site-Info">b<div>c</div>d</div>e</div>', hints) == \
        '<div id="Site-Info">b<div>c</div>d</div>'
    assert marked_block('<section role="x footer">\nopen', hints) == '<section role="x footer">\nopen'
    assert marked_block("<div class='plain'>footer</div>", hints) == ""
    df = spark.createDataFrame(
        [(1, "<FOOTER a>x</FOOTER ><p>"), (2, '<div class="page-footer">y</div>z'), (3, "none")],
        "page_id int, html string")
    got = {r.page_id: r.footer for r in text.page_footers(df).collect()}
    assert got == {1: "<FOOTER a>x</FOOTER >", 2: '<div class="page-footer">y</div>', 3: ""}


def test_search_pages_are_dealt_by_campaign_and_encoded_once_a_query(spark):
    schema = ("campaign_id int, keywords string, vertical string, area string, city string, state string, "
              "country string, tech_stacks string, skip_tech_filter boolean, pages_per_query int")
    row = ("a*b", "all", "", "Rome", "", "", "Wix", True)
    df = spark.createDataFrame([(1, *row, 3), (2, *row, None), (4, *row, 2), (4, *row, 1), (None, *row, 5)], schema)
    pages = expand.search_pages(df)
    old = expand.expand_queries(df).join(df.select("campaign_id", "pages_per_query"), "campaign_id")
    old = expand.fan_out_pages(old)
    assert sorted(pages.collect()) == sorted(old.collect())
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "Generate" not in plan[plan.rindex("Join"):]


def test_query_expansion(spark):
    schema = ("campaign_id int, keywords string, vertical string, area string, city string, state string, "
              "country string, tech_stacks string, skip_tech_filter boolean")
    df = spark.createDataFrame([
        (1, "rings,  gold  chains", "all", "", "Paris", "", "France", "Ghost", False),
        (2, "", "Fashion", "", "", "", "", "", False), (3, "a, b", "all", "", "Rome", "", "", "Wix", True),
        (4, "solo", "all", "", "", "", "", "", True),
    ], schema)
    got: dict[int, list[str]] = {}
    for r in expand.expand_queries(df).orderBy("campaign_id", "query_idx").collect():
        got.setdefault(r.campaign_id, []).append(r.query)
    g = '"powered by ghost"'
    assert got[1] == [
        f'rings "Paris" {g}', f"rings Paris France {g}", f'gold chains "Paris" {g}',
        f"gold chains Paris France {g}", f'"based in Paris" {g}', f'"made in Paris" {g}',
        f'"ships from Paris" {g}', f'"rings" "based in Paris" {g}', f'"gold chains" "based in Paris" {g}']
    assert got[2] == ["Fashion"]
    assert len(got[3]) == 6 and got[3][0].startswith('("a" OR "b") "Rome" -site:facebook.com')
    assert got[3][4].startswith('("a" OR "b") "based in Rome" -site:')
    assert len(got[4]) == 1 and got[4][0].startswith('"solo" -site:facebook.com')
