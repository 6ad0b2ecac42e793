"""Deterministic views over the sample tables that exercise every rule.

The sample pages carry no stack markers, contacts or result links, so the views
add them by row number.  Each view covers every row of its tables.  The SQL is
written to run on Spark and on DuckDB unchanged; ``@name`` after FROM or JOIN
stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

OVERLAYS: dict[str, str] = {
    # Pages with stack markers, contacts, footers without <footer>, entities.
    "fx_pages": """
select page_id, url,
  case when page_id % 13 = 0 then 'server:nginx x-magento-cache:hit' else 'server:nginx' end as headers_text,
  case when page_id % 7 = 3
    then replace(replace(seeded, '<footer>', '<div class="site-footer">'), '</footer>', '</div>')
    else seeded end as html
from (
select page_id, url, concat(
  replace(html, '</footer>', concat(
    case when page_id % 3 = 0 then concat('<a href="mailto:info@shop', cast(page_id as string), '.co">mail</a>') else '' end,
    case when page_id % 4 = 0 then concat('<p>Call us on +1 555 123 ', cast(1000 + page_id % 9000 as string), ' today</p><a href="tel:+1555123', cast(1000 + page_id % 9000 as string), '">ring</a>') else '' end,
    case when page_id % 6 = 0 then concat('<a href="https://www.instagram.com/shop', cast(page_id as string), '/">ig</a><a href="https://www.facebook.com/sharer/">s</a>') else '' end,
    case when page_id % 17 = 0 then '<span data-cfemail="422b2c242d02232f276c2b2d"></span>' else '' end,
    case when page_id % 4 = 1 then concat('<a href="/team/">Our people</a><a href="https://www.s', cast(cast(floor(page_id / 5.0) as bigint) as string), '.shop/story#x">About us</a><a href="/contact">Contact</a><a href="https://other.shop/about">About them</a>') else '' end,
    '</footer>')),
  case when page_id % 5 = 0 and page_id % 15 <> 0 then concat('<footer><a href="/team">Team</a> <a class="l" href="https://s', cast(cast(floor(page_id / 5.0) as bigint) as string), '.shop/story">About us</a></footer>') else '' end,
  case when page_id % 10 = 1 then concat('<p>sales [at] shop', cast(page_id as string), ' [dot] com</p>') else '' end,
  case when page_id % 9 = 0 then '<p>noreply@shop.co</p>' else '' end,
  case when page_id % 9 = 4 then '<p>Reach us: (020) 7946 0018. Mobile 07700 900 123 or 555-1234, fax 030 1234 5678</p>' else '' end,
  case when page_id % 8 = 1 then concat('<script type="application/ld+json">{"email":"org', cast(page_id as string), '@brand.co","sameAs":["https://www.linkedin.com/company/brand', cast(page_id as string), '","https://api.whatsapp.com/send?phone=15551234', cast(1000 + page_id % 9000 as string), '"]}</script>') else '' end,
  case when page_id % 29 = 3 then '<script>window.__NUXT__ = {"a":"tel:+4930901820"};</script>' else '' end,
  case when page_id % 5 = 1 then '<p>Fine rings, necklaces and watches. It&#8217;s &#x41;cme &amp;lt; more &#; &unknown; &Eacute;t&eacute; &hearts; &frac12 &notit; &CounterClockwiseContourIntegral; &#150;</p>' else '' end,
  case when page_id % 5 = 3 then '<p>Shoes and rings in our store</p>' else '' end,
  case when cast(floor(page_id / 5.0) as bigint) % 4 = 0 then '<script src="https://cdn.shopify.com/s/x.js"></script><div id="shopify-section-a"></div><b>window.Shopify myshopify.com</b>' else '' end,
  case when page_id % 7 = 0 then '<i class="wc_add_to_cart"></i>' else '' end,
  case when page_id % 19 = 0 then '<div data-reactroot></div>' else '' end,
  case when page_id % 11 = 0 then concat('<script id="__NEXT_DATA__">{"mail":"next', cast(page_id as string), '@app.co"}</script>') else '' end
) as seeded from @pages) s
""",
    # The same pages as sites of five pages: home, contact, about, team, story.
    "fx_crawl": """
select page_id, cast(floor(page_id / 5.0) as bigint) as site_no,
  concat(case when page_id % 2 = 0 then 'https://www.s' else 'http://s' end, cast(cast(floor(page_id / 5.0) as bigint) as string), '.shop',
    case page_id % 5 when 0 then '/' when 1 then case when page_id % 3 = 0 then '/contact/' else '/pages/contact' end when 2 then '/about-us?utm_source=x' when 3 then '/team' else '/story' end) as url,
  headers_text, html
from @fx_pages
""",
    # Client-rendered shells as a browser would show them.
    "fx_rendered": """
select page_id, url, concat(html, '<footer><a href="mailto:spa', cast(page_id as string), '@app.co">x</a></footer>', '<i id="__nuxt__"></i><p>wp-content</p>') as html
from @fx_crawl where html like '%!_!_NEXT!_DATA!_!_%' escape '!' or html like '%data-reactroot%'
""",
    "fx_links": """
select concat('job_', cast(page_id % 5 as string)) as job_id, page_id % 3 as query_idx, case when page_id % 4 = 0 then 'bing' when page_id % 4 = 1 then 'ddg' else 'google' end as engine, page_id % 2 as page_no, page_id as rank,
  case page_id % 16
    when 0 then concat('https://www.instagram.com/p', cast(page_id as string))
    when 1 then concat('https://www.google.com/url?sa=t&q=', split_part(url, '?', 1), '&x=1')
    when 2 then concat('https://files', cast(page_id as string), '.example.com/a.PDF')
    when 3 then 'mailto:a@b.co'
    when 4 then 'http://192.168.0.1/x'
    when 5 then concat('https://dept', cast(page_id as string), '.gov.in/')
    when 6 then concat('https://duckduckgo.com/l/?uddg=https%3A%2F%2Fwww.shop', cast(page_id % 40 as string), '.com%2Fa%2520b%3Fref%3Dx%26id%3D', cast(page_id as string), '&rut=9')
    when 7 then concat(' https://WWW.Shop', cast(page_id % 40 as string), '.com//a//b/;v=1?utm_source=x&&id=', cast(page_id as string), '&Ref=2#frag ')
    when 8 then concat('HTTP://upper', cast(page_id as string), '.com/')
    when 9 then concat('https://shop', cast(page_id % 40 as string), '.com/search?q=1')
    when 10 then concat('https://netflix.com/t', cast(page_id as string))
    when 11 then 'https:///nohost'
    else url end as href
from @pages
""",
    "fx_serp_html": """
select page_id, case page_id % 3 when 0 then 'google' when 1 then 'bing' else 'ddg' end as engine,
  case page_id % 3
    when 0 then concat('<a href="/url?q=https%3A%2F%2Fshop', cast(page_id as string), '.com%2Fx&amp;sa=U">r</a><a href="https://maps.google.com/x">m</a><a class="z" href="', url, '">d</a><a href="/url?sa=1">n</a><a class=p href=https://plain', cast(page_id as string), '.com/q?a=1&amp;b=2 rel=x>u</a>', html)
    when 1 then concat('<ol><li class="b_algo b2"><h2><a href="', url, '">t</a></h2><a href="https://skip.com/">s</a></li><li class="b_ad"><h2><a href="https://ad.com/">a</a></h2></li><li class="b_algo"><div></div><h2 class="q"><a target="_blank" href="/local">l</a><a href="https://b', cast(page_id as string), '.com/">t</a></h2></li></ol>', html)
    else concat('<a rel="nofollow" class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fd', cast(page_id as string), '.com%2F&amp;rut=1">t</a><a class="x result__url" href="', url, '">u</a><a class="result__snippet" href="https://no.com">s</a>', html)
  end as html
from @pages
""",
    "fx_fetch_log": """
select p.page_id, p.url, attempt, case when (p.page_id * 7 + attempt * 3) % 4 < 2 then 403 else 200 end as status,
  case when p.page_id % 10 = 7 then 'https://www.landing.example.com/' else p.url end as final_url,
  case when (p.page_id + attempt) % 6 = 0 then '' when (p.page_id + attempt) % 5 = 0 then '<p>short</p>' else p.html end as body
from (select *, 1 as attempt from @pages union all select *, 2 from @pages union all select *, 3 from @pages) p
""",
    # Links and fetch attempts of whole runs over the crawled sites.
    "fx_run_links": """
select concat('job_', cast(site_no % 50 as string)) as job_id, page_id % 3 as query_idx, 'google' as engine, page_id % 2 as page_no, page_id as rank,
  case page_id % 7 when 0 then concat('https://www.google.com/url?q=', split_part(url, '?', 1)) when 1 then concat(url, case when url like '%?%' then '&' else '?' end, 'gclid=1') when 2 then 'https://www.facebook.com/x' else url end as href
from @fx_crawl
""",
    "fx_run_log": """
select c.url, attempt, case when (c.page_id * 7 + attempt * 3) % 4 < 2 then 403 else 200 end as status,
  case when c.page_id % 10 = 7 then concat('https://landing', cast(c.page_id % 4 as string), '.shop/') else c.url end as final_url,
  c.headers_text, case when (c.page_id + attempt) % 6 = 0 then '' else c.html end as body
from (select *, 1 as attempt from @fx_crawl union all select *, 2 from @fx_crawl union all select *, 3 from @fx_crawl) c
union all select concat('https://landing', cast(page_id % 4 as string), '.shop/contact'), 1, 200, '', headers_text,
  concat('<p>Write to <a href="mailto:desk', cast(page_id as string), '@landing.co">us</a></p>') from @fx_crawl where page_id in (7, 17)
""",
    "fx_jobs": """
select concat('job_', cast(o_orderkey as string)) as id, o_orderdate as created_at,
  case o_orderstatus when 'F' then 'done' when 'O' then 'running' else 'stopped' end as status,
  o_orderpriority as keywords, case o_custkey % 5 when 0 then ' jewelry ' else '' end as custom_niche,
  case o_custkey % 3 when 0 then 'all' when 1 then 'Fashion' else 'Jewelry' end as vertical,
  concat('City', cast(o_custkey % 10 as string)) as city, case when o_custkey % 7 = 0 then null else '' end as state,
  'X' as country, '' as area,
  case o_custkey % 4 when 0 then '' when 1 then 'Shopify' when 2 then 'Shopify,WooCommerce' else case when o_orderkey % 2 = 0 then 'React,Wix' else 'Wix,React' end end as stacks,
  o_custkey % 12 as pages_per_query, o_custkey % 6 <> 5 as classify_niche, o_custkey % 4 <> 3 as extract_contacts, o_custkey % 8 = 0 as skip_tech_filter
from @orders
""",
    "fx_jobs_raw": """
select id, created_at, status,
  case when pages_per_query = 11 then '{"keywords": "cut' else concat('{"keywords": "', keywords, '", "custom_niche": "', custom_niche, '", "vertical": "', vertical, '", "city": "', city, '", "tech_stacks": ["', stacks, '"], "pages_per_query": ', cast(pages_per_query as string), ', "classify_niche": ', case when classify_niche then 'true' else 'false' end, '}') end as params_json
from @fx_jobs
""",
    "fx_urls": """
select concat('job_', cast(l_orderkey as string)) as job_id, concat('s', cast(l_suppkey % 20 as string), '.example') as host, l_linenumber as seq, l_partkey as tiebreak from @lineitem
""",
    # Stored verification rows in their text form.
    "fx_history": """
select concat('job_', cast(l_orderkey as string)) as job_id, concat('s', cast(l_suppkey % 20 as string), '.example') as domain,
  concat('https://s', cast(l_suppkey % 20 as string), '.example/') as url, l_linenumber as version, l_partkey * 100000000 + l_suppkey * 10000 + cast(l_quantity * 100 as bigint) as tiebreak,
  case l_partkey % 4 when 0 then 'Shopify' when 1 then 'WooCommerce,WordPress' when 2 then 'React' else '' end as platforms,
  case l_returnflag when 'N' then case when l_linestatus = 'F' then 'Unknown' else '' end when 'A' then 'Jewelry' else ' Fashion' end as vertical,
  l_discount as confidence, case when l_partkey % 9 = 0 then null else concat('because, "', l_returnflag, '" ', repeat('long ', cast(l_quantity as int) * 2)) end as reason,
  case when l_linestatus = 'F' then 1 else 0 end as accepted,
  case l_partkey % 4 when 0 then 'a@b.co,c@d.co' when 1 then 'x@y.io' else '' end as emails,
  case l_partkey % 6 when 0 then '+15551234567' else '' end as phones,
  case l_partkey % 5 when 0 then '{"instagram": ["shopa", "shopb"], "tiktok": ["t"]}' when 1 then '{"instagram": ["cut' when 2 then '{}' else '' end as socials
from @lineitem
""",
    "fx_status_changes": """
select concat('job_', cast(l_orderkey + 500 as string)) as id, cast(l_linenumber as bigint) * 10000000000 + l_partkey * 1000000 + l_suppkey * 100 + cast(l_quantity as bigint) as seq, l_shipdate as changed_at,
  case when l_quantity > 45 then 'running' when l_returnflag = 'N' then 'running' when l_returnflag = 'A' then 'done' else 'stopped' end as status,
  l_quantity <= 45 and l_returnflag <> 'N' as ended, l_quantity > 45 as replaced
from @lineitem
""",
    "fx_responses": """
select conv_id, turn, case (conv_id + turn) % 9
  when 0 then '<think>{"vertical":"Other"}</think>{"vertical":"Jewelry","confidence":0.9,"reason":"rings"}'
  when 1 then 'first {"vertical":"Retail","confidence":0.2,"reason":"a"} then {"vertical":"Fashion","confidence":0.7,"reason":"b"}'
  when 2 then '{"confidence":0.4,"reason":"no label"}' when 3 then concat('no json here ', text)
  when 4 then '' when 5 then '{"vertical":"Broken","confidence":' when 6 then '{"vertical": Broken, "confidence": 1}'
  when 7 then '{"vertical":"Retail","confidence":"high"}' else concat('  {"vertical":"Fashion"} ', text) end as content
from @conversations where role = 'assistant'
""",
    "fx_verdicts": """
select d.doc_id, n, case when (d.doc_id + n) % 3 = 0 then 'Jewelry' else 'Unknown' end as vertical, case when (d.doc_id * 5 + n) % 4 = 0 then 'model rejection' else concat('API error: 429 #', cast(n as string)) end as reason
from (select doc_id, 1 as n from @documents union all select doc_id, 2 from @documents union all select doc_id, 3 from @documents) d
""",
    "fx_campaigns": """
select c_custkey as campaign_id,
  case c_custkey % 4 when 0 then '' when 1 then concat('rings, gold  chains ', lower(c_mktsegment)) when 2 then 'vegan skincare' else 'salon, spa, salon' end as keywords,
  case c_custkey % 5 when 0 then 'Fashion' when 1 then 'all' else 'Nope' end as vertical,
  case when c_custkey % 7 = 0 then 'Old Town' else '' end as area,
  case when c_custkey % 3 = 0 then '' else concat('City', cast(n_nationkey as string)) end as city,
  case when c_custkey % 6 = 0 then '' else n_name end as state, case when c_custkey % 12 = 0 then '' else r_name end as country,
  case c_custkey % 5 when 0 then '' when 1 then 'Shopify' when 2 then 'Wix,Webflow' when 3 then 'Zid' else 'Shopify, Ghost' end as tech_stacks,
  c_custkey % 13 as pages_per_query, c_custkey % 3 = 1 as skip_tech_filter
from @customer join @nation on c_nationkey = n_nationkey join @region on n_regionkey = r_regionkey
""",
    "fx_url_lists": """
select page_id as list_id, concat('job_', cast(page_id % 40 as string)) as job_id, concat('  ', url, ', foo', cast(page_id as string), '.gov.in   Shop', cast(page_id as string), '.com,', case when page_id % 2 = 0 then 'https://www.b.org/x' else 'b.co/y' end, ',s', cast(cast(floor(page_id / 5.0) as bigint) as string), '.shop') as raw
from @pages
""",
    "fx_serp_pages": """
select cast(floor(doc_id / 4.0) as bigint) as query_id, doc_id % 4 as page_no, case when doc_id % 7 = 0 then 'https://www.google.com/sorry/index' else concat('https://www.google.com/search?q=', cast(doc_id as string)) end as href,
  case when doc_id % 5 = 0 then concat(text, ' Your search did not match any documents.') when doc_id % 11 = 0 then concat('Our systems have detected UNUSUAL traffic ', text) else text end as body,
  case when doc_id % 9 = 0 then 0 else doc_id % 20 + 1 end as n_links
from @documents
""",
    # A marker per part: ids that pages mention, words, and short ones.
    "fx_markers": """
select p_brand as platform, case p_partkey % 5 when 0 then concat('Track(', cast(p_partkey as string), ')') when 1 then concat('ad ', cast(p_partkey as string))
  when 2 then p_name when 3 then concat('href="/', substr(p_name, 1, 2)) else case when p_partkey < 10 then substr(p_name, 1, 3) else concat(p_type, cast(p_partkey as string), ' of a longer marker that no page has') end end as marker
from @part
""",
    "fx_probe_log": """
select event_id, concat('model', cast(user_id % 5 as string)) as model, event_id % 997 + 50 as elapsed_ms, case event_type when 'error' then '404 page not found' when 'click' then 'Error 401 denied' when 'view' then '429 too many' when 'signup' then 'Request Timeout' else case when user_id % 3 = 0 then 'boom' else '' end end as error
from @events
""",
}

_REF = re.compile(r"(?<=from |join )@(\w+)")


def spark_overlay(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An overlay, or a plain table, of a test data folder."""
    def inline(match: re.Match) -> str:
        ref = match.group(1)
        if ref in OVERLAYS:
            return f"({_REF.sub(inline, OVERLAYS[ref])})"
        return f"parquet.`{sf_dir}/{ref}.parquet`"

    if name not in OVERLAYS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_REF.sub(inline, OVERLAYS[name]))


def with_overlays(sql: str) -> str:
    """Put the overlays a query reads in front of it as common table expressions."""
    needed: list[str] = []

    def collect(text: str) -> None:
        for ref in re.findall(r"\b(fx_\w+)\b", text):
            if ref in OVERLAYS and ref not in needed:
                collect(OVERLAYS[ref])
                if ref not in needed:
                    needed.append(ref)

    collect(sql)
    ctes = ", ".join(f"{n} as ({_REF.sub(lambda m: m.group(1), OVERLAYS[n])})" for n in needed)
    body = sql.strip()
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"
