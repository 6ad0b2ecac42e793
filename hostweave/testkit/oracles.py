"""Independent SQL for the catalogue's queries, written for DuckDB.

Wherever the operators use a rewrite (segmented phone search, role lookup by
URL, two-level as-of search, counts by first stage), the SQL states the plain
definition instead.
"""

from __future__ import annotations

from hostweave.functions import fixed
from hostweave.testkit.overlays import with_overlays

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = with_overlays(sql)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join(
        "(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in row) + ")"
        for row in rows
    )


def alternatives(words) -> str:
    special = ".^$*+?{}[]()|\\"
    return "|".join("".join("\\" + c if c in special else c for c in w) for w in words)


BLANKS = "' '||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
TRACKING = "^(utm_|" + "|".join(f"{n}$" for n in fixed.TRACKING_NAMES) + ")"


# --- shared expressions -------------------------------------------------------

def absolute(u: str) -> str:
    return f"(case when instr({u}, '://') > 0 then {u} else 'https://' || {u} end)"


def host(u: str) -> str:
    return (f"regexp_replace(ltrim(lower(regexp_extract({absolute(u)}, '{SCHEME}([^/?#]*)', 1)), '.'),"
            " '^www\\.', '')")


def path(u: str) -> str:
    raw = f"regexp_extract({absolute(u)}, '{SCHEME}[^/?#]*([^?#]*)', 1)"
    single = f"regexp_replace(regexp_replace({raw}, ';[^/]*$', ''), '/+', '/', 'g')"
    return f"coalesce(nullif(rtrim({single}, '/'), ''), '/')"


def canon(u: str) -> str:
    query = f"regexp_extract({absolute(u)}, '^[^?#]*\\?([^#]*)', 1)"
    kept = (f"array_to_string(list_filter(string_split({query}, '&'), lambda kv: kv <> '' and not "
            f"regexp_matches(string_split(kv, '=')[1], '(?i){TRACKING}')), '&')")
    return (f"('https://' || {host(u)} || {path(u)} || "
            f"coalesce('?' || nullif({kept}, ''), ''))")


def excluded(h: str) -> str:
    labels = "string_split(trim(" + h + ", '.'), '.')"
    bad = "(" + ", ".join(lit(x) for x in fixed.EXCLUDED_TLD_LABELS) + ")"
    return (f"(len({labels}) >= 2 and ({labels}[-1] in {bad} or "
            f"(len({labels}) >= 3 and {labels}[-2] in {bad})))")


def param(u: str, name: str) -> str:
    return (f"url_decode(replace(regexp_extract(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), "
            f"'(?:^|&){name}=([^&]+)', 1), '+', ' '))")


def unwrapped(h: str) -> str:
    target = f"coalesce(nullif({param(h, 'q')}, ''), {param(h, 'url')})"
    return (f"(case when contains({h}, 'duckduckgo.com/l/') and {param(h, 'uddg')} <> '' "
            f"then url_decode({param(h, 'uddg')}) "
            f"when (starts_with({h}, 'https://www.google.com/url?') or starts_with({h}, '/url?')) "
            f"and starts_with({target}, 'http') then {target} else {h} end)")


def clean_ctes(source: str, match: str = "substring") -> str:
    """CTEs ending in ``cleaned``: the source plus url, host, reject_reason."""
    if match == "substring":
        noise = "exists (select 1 from noise where contains(u.host, noise.h))"
    else:
        noise = ("exists (select 1 from noise where contains('.' || u.host || '/', "
                 "'.' || noise.h || case when noise.h like '%.' then '' else '/' end))")
    extensions = " or ".join(f"ends_with(u.p, {lit('.' + e)})" for e in fixed.FILE_EXTENSIONS)
    fragments = " or ".join(f"contains(u.p || '?', {lit(f)})" for f in fixed.PATH_FRAGMENTS)
    local = " or ".join(f"starts_with(u.host, {lit(p)})" for p in fixed.LOCAL_PREFIXES)
    return f"""
noise(h) as (values {values([(h,) for h in fixed.NOISE_HOSTS])}),
unwrapped_links as (select *, {unwrapped("coalesce(href, '')")} as t0 from {source}),
tidy_links as (select * exclude (t0), replace(replace(replace(trim(t0, {BLANKS}), chr(9), ''), chr(10), ''), chr(13), '') as t from unwrapped_links),
url_parts as (select *, {canon('t')} as url_c, {host('t')} as host, lower({path('t')}) as p from tidy_links),
cleaned as (select u.* exclude (t, p, url_c), u.url_c as url,
  case when not (starts_with(t, 'http://') or starts_with(t, 'https://')) then 'not_http'
    when u.host = '' then 'no_host' when {extensions} then 'file_extension'
    when {fragments} then 'path_fragment' when {noise} then 'noise_host'
    when {excluded('u.host')} then 'excluded_tld' when {local} then 'local_address' end as reject_reason
  from url_parts u)"""


def skipped(names) -> str:
    return "|".join(rf"<{n}\b.*?(?:</{n}\s*>|\z)" for n in names)


# References of the views beside the common names; all others are tested against the standard library.
VIEW_REFERENCES = {"&Eacute;": "É", "&hearts;": "♥", "&frac12": "½", "&notit;": "¬it;",
                   "&CounterClockwiseContourIntegral;": "∳"}


def decoded(x: str) -> str:
    numeric = (
        f"(case when contains({x}, '&#') then string_split({x}, '&#')[1] || array_to_string("
        f"list_transform(string_split({x}, '&#')[2:], lambda p: case "
        "when regexp_matches(p, '^[0-9]{1,6};') then chr(cast(regexp_extract(p, '^([0-9]{1,6});', 1) as int)) || regexp_replace(p, '^[0-9]{1,6};', '') "
        "when regexp_matches(p, '^[xX][0-9a-fA-F]{1,5};') then chr(cast('0x' || regexp_extract(p, '^[xX]([0-9a-fA-F]{1,5});', 1) as int)) || regexp_replace(p, '^[xX][0-9a-fA-F]{1,5};', '') "
        f"else '&#' || p end), '') else {x} end)")
    out = f"replace({numeric}, chr(150), '–')"
    for ref, char in VIEW_REFERENCES.items():
        out = f"replace({out}, '{ref}', {lit(char)})"
    for name, char in fixed.ENTITIES.items():
        out = f"replace({out}, '&{name};', {lit(char)})"
    return out


def visible(x: str, names) -> str:
    cut = f"regexp_replace({x}, '(?is)<!--.*?(?:-->|\\z)|{skipped(names)}', chr(1), 'g')"
    cut = f"regexp_replace({cut}, '<[A-Za-z/!?][^>]*>', chr(1), 'g')"
    joined = f"regexp_replace({decoded(cut)}, '[\\s\\x{{a0}}]*\\x01[\\s\\x{{a0}}\\x01]*', ' ', 'g')"
    return f"trim({joined}, {BLANKS}||chr(160))"


TEXT_SKIPS = ("script", "style", "noscript", "svg", "iframe")
PHONE_SKIPS = ("script", "style", "noscript")


def title(x: str) -> str:
    return f"trim({decoded(f'''regexp_extract({x}, '(?is)<title\\b[^>]*>(.*?)</title', 1)''')}, {BLANKS}||chr(160))"


def text_ctes(source: str) -> str:
    """CTE ``texts``: the source plus title and text."""
    return f"""
full_text as (select *, {visible('html', TEXT_SKIPS)} as ft, {title('html')} as tt from {source}),
texts as (select * exclude (ft, tt), tt as title, ft as text, length(ft) < 100 as short from full_text)"""


def footer(x: str) -> str:
    return f"regexp_extract({x}, '(?is)<footer\\b.*?(?:</footer\\s*>|\\z)', 0)"


def any_footer(x: str) -> str:
    """The views put a marked block last and never nest it, so a pattern suffices here."""
    return f"coalesce(nullif({footer(x)}, ''), regexp_extract({x}, '(?is)<div class=\"site-footer\">.*?(?:</div>|\\z)', 0))"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[a-z]+')"


def host_words(u: str) -> str:
    known = "|".join(fixed.HINT_TLDS)
    return words(f"regexp_replace({host(u)}, '\\.({known})(\\.[a-z]{{2}})?$', '')")


def path_words(u: str) -> str:
    raw = f"regexp_replace(regexp_extract({absolute(u)}, '{SCHEME}[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"
    return words(f"lower({raw})")


def hint(u: str) -> str:
    return (f"'domain words: ' || array_to_string({host_words(u)}, ' ') || ' | path words: ' || "
            f"array_to_string({path_words(u)}, ' ')")


def flat_list(x: str) -> str:
    return f"array_to_string({x}, '|')"


# --- sources and sinks --------------------------------------------------------

def href(tag: str) -> str:
    pattern = r"""'(?is)^<a\b[^>]*?\shref\s*=\s*(?:["'']([^"'']*)["'']|([^\s"''>]+))'"""
    raw = f"(regexp_extract({tag}, {pattern}, 1) || regexp_extract({tag}, {pattern}, 2))"
    return f"replace({raw}, '&amp;', '&')"


oracle("serp_links", rf"""
with tags as (select page_id, engine, list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*>'), lambda t: {href('t')}) as h
  from fx_serp_html where engine = 'google'),
google as (select page_id, engine, list_filter(list_transform(h, lambda x: case when starts_with(x, '/url?') then {unwrapped('x')} when contains({host('x')}, 'google.') then null else x end), lambda y: starts_with(y, 'http')) as l from tags),
items as (select page_id, engine, regexp_extract_all(html, '(?is)<li\b[^>]*class="[^"]*\bb_algo\b[^"]*".*?(?:</li\s*>|\z)') as i from fx_serp_html where engine = 'bing'),
heads as (select page_id, engine, flatten(list_transform(i, lambda x: regexp_extract_all(x, '(?is)<h2\b.*?(?:</h2\s*>|\z)'))) as h2 from items),
bing as (select page_id, engine, list_filter(list_transform(flatten(list_transform(h2, lambda x: regexp_extract_all(x, '(?is)<a\b[^>]*>'))), lambda t: {href('t')}), lambda y: starts_with(y, 'http')) as l from heads),
marked as (select page_id, engine, list_transform(list_filter(regexp_extract_all(html, '(?is)<a\b[^>]*>'), lambda t: regexp_matches(t, '(?i)class="[^"]*\bresult__(?:a|url)\b')), lambda t: {href('t')}) as h from fx_serp_html where engine = 'ddg'),
full_h as (select page_id, engine, list_transform(h, lambda x: case when starts_with(x, '//duckduckgo.com/l/') then 'https:' || x else x end) as h from marked),
ddg as (select page_id, engine, list_filter(list_transform(h, lambda x: {unwrapped('x')}), lambda y: starts_with(y, 'http')) as l from full_h),
every as (select * from google union all select * from bing union all select * from ddg)
select page_id, engine, cast(generate_subscripts(l, 1) - 1 as bigint) as rank, unnest(l) as href from every""")

oracle("serp_links_rendered", rf"""
with tags as (select page_id, engine, list_filter(list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*>'), lambda t: {href('t')}), lambda y: starts_with(y, 'http')) as l from fx_serp_html)
select page_id, engine, cast(generate_subscripts(l, 1) - 1 as bigint) as rank, unnest(l) as href from tags""")

BULK = rf"""
entries as (select list_id, job_id, list_filter(regexp_split_to_array(raw, '[\s,]+'), lambda x: x <> '') as l from fx_url_lists),
entry_rows as (select list_id, job_id, cast(generate_subscripts(l, 1) - 1 as bigint) as pos, unnest(l) as e from entries),
bulk as (select list_id, job_id, pos, {canon('e')} as url, {host('e')} as host, {excluded(host('e'))} as skipped from entry_rows)"""
oracle("bulk_ingest", f"with {BULK} select * from bulk")


def comma(x: str) -> str:
    return f"list_filter(string_split(coalesce({x}, ''), ','), lambda v: v <> '')"


def network(name: str, src: str = "socials") -> str:
    return f"coalesce(cast(try_cast({src} as json)->'$.{name}' as varchar[]), [])"


SOCIAL_TEXT = "array_to_string(list_filter([" + ", ".join(
    f"case when len({network(n)}) > 0 then '{n}=' || array_to_string({network(n)}, ',') end"
    for n in sorted(fixed.OUTREACH_NETWORKS)) + "], lambda v: v is not null), '|')"

oracle("history_decode", f"""
select job_id, domain, cast(version as bigint) as version, tiebreak, {flat_list(comma('platforms'))} as platforms,
  {flat_list(comma('emails'))} as emails, {flat_list(comma('phones'))} as phones, {SOCIAL_TEXT} as socials,
  accepted = 1 as accepted from fx_history""")

oracle("jobs_decode", """
with j as (select id, status, try_cast(params_json as json) as p from fx_jobs_raw)
select id, status, p->>'$.keywords' as keywords, p->>'$.custom_niche' as custom_niche, p->>'$.vertical' as vertical,
  p->>'$.city' as city, p->>'$.area' as area, array_to_string(cast(p->'$.tech_stacks' as varchar[]), '|') as tech_stacks,
  cast(p->>'$.pages_per_query' as bigint) as pages_per_query, cast(p->>'$.classify_niche' as boolean) as classify_niche,
  cast(p->>'$.skip_tech_filter' as boolean) as skip_tech_filter from j""")

LATEST = """
numbered as (select *, row_number() over (partition by job_id, domain order by version desc, tiebreak desc) as rn from fx_history),
latest as (select * exclude (rn) from numbered where rn = 1)"""
FIRST_URLS = """
url_ranks as (select *, row_number() over (partition by job_id, host order by seq, tiebreak) as rn from fx_urls),
urls_once as (select job_id, host, seq, tiebreak from url_ranks where rn = 1)"""


def results(where: str) -> str:
    return f"""with {LATEST} select job_id, domain, url, array_to_string({comma('platforms')}, '|') as tech_stack,
  vertical as niche, confidence, case when accepted = 1 then 'yes' else 'no' end as accepted,
  coalesce(reason, '') as reason from latest {where}"""


oracle("results_export", results(""))
oracle("results_export_accepted", results("where accepted = 1"))
oracle("results_tsv", results(""))
oracle("history_lookup", f"""with {LATEST} select job_id, domain, cast(version as bigint) as version, vertical, accepted = 1 as accepted
from latest where job_id in (select id from fx_jobs where status = 'running')""")
oracle("history_changed", """with kept as (select * from fx_history where version > 5 or job_id not in (select id from fx_jobs where status = 'stopped')),
numbered as (select *, row_number() over (partition by job_id, domain order by version desc, tiebreak desc) as rn from kept)
select job_id, domain, cast(version as bigint) as version, tiebreak, vertical, cast(accepted as bigint) as accepted from numbered where rn = 1""")
oracle("history_appended", """with ordered as (select *, row_number() over (partition by job_id, host order by seq > 3, seq, tiebreak) as rn from fx_urls)
select job_id, host, cast(seq as bigint) as seq, tiebreak from ordered where rn = 1""")
oracle("outreach_export", f"""with {LATEST} select job_id, domain, url, vertical as niche, confidence,
  array_to_string({comma('platforms')}, '|') as tech_stack, array_to_string({comma('emails')}, '; ') as emails,
  array_to_string({comma('phones')}, '; ') as phones,
  {", ".join(f"array_to_string({network(n)}, '; ') as {n}" for n in fixed.OUTREACH_NETWORKS)} from latest""")
oracle("job_detail", f"""with {LATEST}, {FIRST_URLS}
select job_id, 'url' as kind, host as name, cast(seq as bigint) as seq, tiebreak from urls_once where job_id in (select id from fx_jobs where status = 'running')
union all select job_id, 'verification', domain, cast(version as bigint), tiebreak from latest where job_id in (select id from fx_jobs where status = 'running')""")


# --- query expansion ----------------------------------------------------------

TERMS = rf"""
hints(stack, n, hint) as (values {values([(s, i, h) for s, hs in fixed.STACK_HINTS.items() for i, h in enumerate(hs)])}),
words0 as (select *, list_filter(list_transform(regexp_split_to_array(keywords, '[,\n]'), lambda x: trim(x)), lambda x: x <> '') as kw,
  list_filter(list_transform(string_split(tech_stacks, ','), lambda x: trim(x)), lambda x: x <> '') as st,
  list_filter([trim(area), trim(city), trim(state), trim(country)], lambda x: x <> '') as places from fx_campaigns),
terms as (select *, case when len(kw) > 0 then kw when vertical in ('Jewelry', 'Fashion', 'Retail') then [vertical] else ['Jewelry', 'Fashion', 'Retail'] end as bases,
  coalesce(places[1], '') as place, array_to_string(places, ' ') as broad from words0)"""


def numbered(source: str) -> str:
    """Squeeze, drop repeats, number by first place; ``source`` has o1..o5 and q."""
    return rf"""squeezed as (select campaign_id, o1, o2, o3, o4, o5, trim(regexp_replace(q, '\s+', ' ', 'g')) as query from {source}),
firsts as (select campaign_id, query, min(struct_pack(a := o1, b := o2, c := o3, d := o4, e := o5)) as place from squeezed where query <> '' group by 1, 2)
select campaign_id, row_number() over (partition by campaign_id order by place) - 1 as query_idx, query from firsts"""


STACK_QUERIES = rf"""{TERMS},
stacked as (select * from terms where not skip_tech_filter),
own_hints as (select s.campaign_id, s.sn, h.n, h.hint from (select campaign_id, unnest(st) as stack, generate_subscripts(st, 1) as sn from stacked) s join hints h on s.stack = h.stack),
hint_rows as (select campaign_id, sn, n, hint from own_hints union all select campaign_id, 0, 0, '' from stacked where campaign_id not in (select campaign_id from own_hints)),
base_rows as (select campaign_id, place, broad, st, unnest(bases) as kw, generate_subscripts(bases, 1) as kn from stacked),
stack_q as (
select b.campaign_id, 1 as o1, kn as o2, sn as o3, n as o4, v as o5,
  case when place = '' then kw || ' ' || hint when v = 0 then kw || ' "' || place || '" ' || hint else kw || ' ' || broad || ' ' || hint end as q
  from base_rows b join hint_rows using (campaign_id) cross join (values (0), (1)) x(v) where place <> '' or v = 0
union all select s.campaign_id, 2, sn, n, 0, v, '"' || phrase || ' ' || place || '" ' || hint
  from stacked s join hint_rows using (campaign_id) cross join (values (0, 'based in'), (1, 'made in'), (2, 'ships from')) x(v, phrase) where place <> ''
union all select b.campaign_id, 2, sn, n, 1, kn, '"' || kw || '" "based in ' || place || '" ' || hint
  from base_rows b join hint_rows using (campaign_id) where place <> ''
union all select campaign_id, 3, v, 0, 0, 0, 'site:myshopify.com "' || case when v = 0 then place else broad end || '"'
  from stacked cross join (values (0), (1)) x(v) where place <> '' and list_contains(st, 'Shopify'))"""
OR_QUERIES = rf"""
ored as (select *, case when len(bases) > 1 then '(' || array_to_string(list_transform(bases, lambda w: '"' || w || '"'), ' OR ') || ')' else '"' || bases[1] || '"' end as block,
  array_to_string(list_transform(places, lambda w: '"' || w || '"'), ' ') as loc from terms where skip_tech_filter),
or_templates(n, t) as (values {values([
    (0, '@B @L @X'), *[(i + 1, f'@B @L {n} @X') for i, n in enumerate(fixed.OR_QUERY_NUDGES)],
    (4, '@B "based in @P" @X'), (5, '@B "made in @P" @X')])}),
or_q as (select campaign_id, n as o1, 0 as o2, 0 as o3, 0 as o4, 0 as o5,
  replace(replace(replace(replace(t, '@X', {lit(' '.join(f'-site:{h}' for h in fixed.OR_QUERY_EXCLUSIONS))}), '@P', place), '@L', loc), '@B', block) as q
  from ored cross join or_templates where n = 0 or place <> '')"""
oracle("expand_stack_queries", f"with {STACK_QUERIES}, {numbered('stack_q')}")
oracle("expand_or_queries", f"with {TERMS}, {OR_QUERIES}, {numbered('or_q')}")
oracle("query_pages", f"""with {STACK_QUERIES}, {OR_QUERIES},
both_q as (select * from stack_q union all select * from or_q),
queries as (with {numbered('both_q')})
select campaign_id, query_idx, query, cast(page_no as bigint) as page_no,
  'https://www.google.com/search?q=' || replace(url_encode(query), '%20', '+') || '&num=10&start=' || cast(page_no * 10 as varchar) || '&hl=en' as search_url
from queries join (select campaign_id, unnest(range(0, greatest(1, pages_per_query))) as page_no from fx_campaigns) using (campaign_id)""")


# --- cleaning and collection --------------------------------------------------

CLEAN = clean_ctes("fx_links")
oracle("clean_urls", f"with {CLEAN} select rank, url, host, reject_reason from cleaned")
oracle("clean_urls_whole_labels",
       f"with {clean_ctes('fx_links', 'label')} select rank, url, host, reject_reason from cleaned")


def first_host(keys: str, order: str, source: str = "cleaned") -> str:
    return f"""host_ranks as (select *, row_number() over (partition by {keys}, host order by {order}, url) as rn from {source} where reject_reason is null),
firsts as (select * exclude (rn) from host_ranks where rn = 1)"""


oracle("first_per_host", f"""with {CLEAN}, {first_host('job_id', 'query_idx, page_no, rank')}
select job_id, host, query_idx, page_no, rank, url from firsts""")
oracle("reject_census", f"""with {CLEAN} select coalesce(reject_reason, 'kept') as reject_reason, count(*) as n_links from cleaned group by 1""")
oracle("links_topn", f"""with {CLEAN}, {first_host('job_id, query_idx, engine', 'page_no, rank')},
top as (select job_id, query_idx, engine, host, page_no, rank, url, row_number() over (partition by job_id, query_idx, engine order by page_no, rank, url) as pos from firsts)
select * from top where pos <= 5""")
oracle("engine_fallback", f"""with {CLEAN},
kept as (select *, list_position(['google', 'bing', 'ddg'], engine) as er from cleaned where reject_reason is null)
select job_id, query_idx, engine, rank, url from kept k
where er = (select min(er) from kept m where m.job_id = k.job_id and m.query_idx = k.query_idx)""")

FLAGS = f"""flagged as (select *, regexp_matches(href || ' ' || body, '(?i){fixed.INTERSTITIAL_PATTERN.replace("'", "''")}') as captcha,
  regexp_matches(body, '(?i){fixed.NO_RESULTS_PATTERN}') as no_results from fx_serp_pages)"""
oracle("pages_before_stop", f"""with {FLAGS},
stops as (select *, max(case when captcha or no_results or n_links = 0 then 1 else 0 end) over (partition by query_id order by page_no rows between unbounded preceding and current row) as stopped from flagged)
select query_id, page_no, n_links from stops where stopped = 0""")
oracle("serp_flags", f"""with {FLAGS} select query_id, count(*) as n_pages, count(*) filter (where captcha) as n_captcha,
  count(*) filter (where no_results) as n_no_results from flagged group by 1""")


# --- attempt logs -------------------------------------------------------------

def resolved(condition: str) -> str:
    return f"""with usable as (select *, row_number() over (partition by page_id, url order by attempt) as rn from fx_fetch_log where {condition})
select k.page_id, k.url, u.attempt is not null as ok, cast(u.attempt as bigint) as attempt, cast(u.status as bigint) as status,
  coalesce(u.final_url, '') as final_url, md5(coalesce(u.body, '')) as body_md5
from (select distinct page_id, url from fx_fetch_log) k left join usable u on k.page_id = u.page_id and k.url = u.url and u.rn = 1"""


oracle("resolve_fetch", resolved("status < 400 and body <> ''"))
oracle("resolve_fetch_text", resolved(
    f"status < 400 and body <> '' and length({visible('body', TEXT_SKIPS)}) >= 100"))
oracle("landing_domains", f"""with usable as (select *, row_number() over (partition by page_id, url order by attempt) as rn from fx_fetch_log where status < 400 and body <> ''),
landed as (select 'job_' || cast(page_id % 5 as varchar) as job_id, page_id as write_order, url, final_url, {host('final_url')} as domain from usable where rn = 1),
ranked as (select *, row_number() over (partition by job_id, domain order by write_order desc, url desc) as rn from landed)
select job_id, write_order, url, final_url, domain from ranked where rn = 1""")
oracle("resolve_verdicts", f"""with marked as (select *, trim(vertical) not in ('', 'Unknown') or not regexp_matches(lower(reason), '{"|".join(fixed.TRANSIENT_TOKENS)}') as final from fx_verdicts),
ranked as (select *, row_number() over (partition by doc_id order by case when final then 0 else 1 end, case when final then n else -n end) as rn from marked)
select doc_id, cast(n as bigint) as n, vertical, reason from ranked where rn = 1""")
CLASS = """case when error = '' then 'ok' when error like '%404%' then '404' when error like '%401%' or error like '%403%' then 'auth'
  when error like '%429%' then '429' when lower(error) like '%timeout%' then 'timeout' else 'other' end"""
oracle("failure_classes", f"""select model, {CLASS} as failure_class, count(*) as n_probes, min(elapsed_ms) as min_ms, max(elapsed_ms) as max_ms from fx_probe_log group by 1, 2""")
oracle("probe_rollup", """select model, count(*) as n_probes, count(*) filter (where error = '') as n_ok,
  cast(count(*) filter (where error = '') as double) / count(*) as ok_rate,
  quantile_disc(elapsed_ms, 0.5) as median_ms from fx_probe_log group by 1""")


oracle("probe_quantiles", """select model, rank, count(*) as n_probes, true as rank_close
  from fx_probe_log, (select unnest([0.5, 0.9, 0.99])::double as rank) group by 1, 2""")


# --- page profiling -----------------------------------------------------------

MARKERS = f"markers(pi, platform, mi, marker) as (values {values([(i, p, j, m) for i, (p, ms) in enumerate(fixed.FINGERPRINTS.items()) for j, m in enumerate(ms)])})"


def hits(name: str, source: str, key: str, blob: str) -> str:
    return f"""{name}_blob as (select {key}, {blob} as b from {source}),
{name}_own as (select {key}, platform, list(marker order by mi) as evidence from {name}_blob join markers on contains(b, marker) group by {key}, platform),
{name} as (select * from {name}_own union all select {key}, 'WordPress', null from {name}_own w where platform = 'WooCommerce'
  and not exists (select 1 from {name}_own o where o.{key} = w.{key} and o.platform = 'WordPress'))"""


HITS = MARKERS + ", " + hits("hits", "fx_pages", "page_id", "lower(html) || ' ' || lower(headers_text)")
LATE = hits("late", "fx_rendered", "page_id", "lower(html)")
oracle("tech_fingerprint", f"with {HITS} select page_id, platform, array_to_string(evidence, '|') as evidence from hits_own")
oracle("pages_profiled", f"""with {MARKERS}, {hits('hits', 'fx_pages', 'page_id', "lower(html) || ' server:nginx x-page:' || cast(page_id as varchar)")}
select page_id, platform, array_to_string(evidence, '|') as evidence from hits""")
oracle("tech_implied", f"with {HITS} select page_id, platform, array_to_string(evidence, '|') as evidence from hits")
oracle("tech_merge", f"""with {HITS}, {LATE} select page_id, platform, array_to_string(evidence, '|') as evidence from (
select * from hits union all select * from late l where not exists (select 1 from hits h where h.page_id = l.page_id and h.platform = l.platform))""")
FRAMEWORK_LIST = "(" + ", ".join(lit(f) for f in fixed.FRAMEWORKS) + ")"
oracle("rerender_candidates", f"""with {HITS} select p.page_id, coalesce(array_to_string(list(h.platform order by m.pi), '|'), '') as platforms
from fx_pages p left join hits h on p.page_id = h.page_id left join (select distinct pi, platform from markers) m on m.platform = h.platform
group by p.page_id having count(*) filter (where h.platform is not null and h.platform not in {FRAMEWORK_LIST}) = 0""")
SPA = "(" + " or ".join(f"contains(html, {lit(m)})" for m in fixed.SPA_MARKERS) + ")"
oracle("spa_pages", f"select {host('url')} as host, count(*) as n_pages, count(*) filter (where {SPA}) as n_spa from fx_pages group by 1")
oracle("stack_counts", f"""with {HITS} select platform, count(distinct {host('url')}) as n_sites, count(*) as n_pages
from hits join fx_pages using (page_id) group by 1""")
oracle("stack_counts_merged", f"with {HITS} select platform, count(*) as n_pages, true as n_sites_close from hits join fx_pages using (page_id) group by 1")
oracle("tech_by_table", """with known as (select distinct p.platform, lower(p.marker) as marker from fx_markers p where marker <> '')
select page_id, platform, array_to_string(list(marker order by marker), '|') as evidence
from fx_pages join known on contains(lower(html) || ' ' || lower(headers_text), marker) group by 1, 2""")
oracle("page_text", f"with {text_ctes('fx_pages')} select page_id, title, text, short from texts")
TOKENS = f"""tokens as (select url, 'host' as part, cast(generate_subscripts(w, 1) - 1 as bigint) as pos, unnest(w) as token from (select url, {host_words('url')} as w from pages)
union all select url, 'path', cast(generate_subscripts(w, 1) - 1 as bigint), unnest(w) from (select url, {path_words('url')} as w from pages))"""
oracle("url_tokens", f"with {TOKENS} select * from tokens")
oracle("token_frequency", f"with {TOKENS} select part, token, count(distinct url) as n_urls, count(*) as n_uses from tokens group by 1, 2")
oracle("page_footers", f"select page_id, {footer('html')} as footer from fx_pages")
# The views put the marked block last and never nest it, so a pattern suffices here.
oracle("page_footers_marked", rf"""select page_id, coalesce(nullif({footer('html')}, ''),
  regexp_extract(html, '(?is)<div class="site-footer">.*?(?:</div>|\z)', 0)) as footer from fx_pages""")


# --- contacts -----------------------------------------------------------------

def usable_email(e: str) -> str:
    junk = " and ".join(f"not contains(lower({e}), {lit(j)})" for j in fixed.EMAIL_JUNK)
    ends = " and ".join(f"not ends_with(lower({e}), '.{s}')" for s in fixed.EMAIL_ASSET_SUFFIXES)
    return f"(length({e}) <= 80 and {junk} and {ends})"


def scan(name: str, source: str, keys: str, col: str) -> str:
    """CTE ``name`` (keys, kind, network, value): contacts in a text column."""
    plain = rf"regexp_extract_all({col}, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}\b')"
    mail = rf"""regexp_extract_all({col}, '(?i)mailto:([^"''\s>?]+)', 1)"""
    spelled = rf"regexp_extract_all({col}, '(?i)[A-Za-z0-9._%+\-]+\s*[\[(]\s*at\s*[\])]\s*[A-Za-z0-9.\-]+\s*[\[(]\s*dot\s*[\])]\s*[A-Za-z]{{2,}}')"
    parts = r"'(?i)^(.+?)\s*[\[(]\s*at\s*[\])]\s*(.+?)\s*[\[(]\s*dot\s*[\])]\s*([A-Za-z]+)$'"
    hidden = f"""regexp_extract_all({col}, 'data-cfemail="([0-9a-fA-F]+)"', 1)"""
    byte = "cast('0x' || substring(c, {i}, 2) as int)"
    decode = (f"array_to_string(list_transform(range(3, length(c) + 1, 2), lambda i: "
              f"chr(xor({byte.format(i='i')}, {byte.format(i='1')}))), '')")
    phone = lambda p: f"regexp_replace({p}, '[^0-9+]', '', 'g')"
    context = "|".join(fixed.PHONE_CONTEXT)
    socials = " union all ".join(
        f"select {keys}, '{n}' as network, unnest(regexp_extract_all({col}, '(?i){p}', 1)) as h from {source}"
        for n, p in fixed.SOCIAL_PATTERNS.items())
    stop = "(" + ", ".join(lit(s) for s in fixed.SOCIAL_STOPWORDS) + ")"
    handle = f"case when network = 'whatsapp' then case when length({phone('h')}) between 8 and 16 then {phone('h')} else '' end else trim(h) end"
    return rf"""
{name}_mail as (
  select {keys}, trim(e, '.,;:()[]{{}}') as v from (select {keys}, unnest({plain}) as e from {source}) where {usable_email('e')}
  union all select {keys}, e from (select {keys}, unnest({mail}) as e from {source}) where {usable_email('e')}
  union all select {keys}, e from (select {keys}, regexp_replace(unnest({spelled}), {parts}, '\1@\2.\3') as e from {source}) where {usable_email('e')}
  union all select {keys}, e from (select {keys}, {decode} as e from (select {keys}, unnest({hidden}) as c from {source})) where {usable_email('e')}),
{name}_text as (select {keys}, {visible(col, PHONE_SKIPS)} as x from {source}),
{name}_chunk as (select {keys}, unnest(regexp_extract_all(x, '(?is)[^.]*?(?:{context})[^.]{{0,120}}')) as c from {name}_text),
{name}_tel as (
  select {keys}, {phone('p')} as v, 8 as least_len from (select {keys}, unnest(regexp_extract_all({col}, '(?i)tel:([^"''\s>?]+)', 1)) as p from {source})
  union all select {keys}, {phone('p')}, 9 from (select {keys}, unnest(regexp_extract_all(c, '{fixed.PHONE_PATTERN}')) as p from {name}_chunk)),
{name}_soc as ({socials}),
{name} as (
  select distinct {keys}, 'email' as kind, '' as network, v as value from {name}_mail where v <> ''
  union all select distinct {keys}, 'phone', '', v from {name}_tel where length(v) between least_len and 16
  union all select distinct {keys}, 'social', network, {handle} from {name}_soc where trim(h) <> '' and lower(trim(h)) not in {stop} and {handle} <> '')"""


PAGE_SCAN = scan("found", "fx_pages", "page_id", "html")
oracle("emails", f"with {PAGE_SCAN} select page_id, value as email from found where kind = 'email'")
oracle("phones", f"with {PAGE_SCAN} select page_id, value as phone from found where kind = 'phone'")
oracle("socials", f"with {PAGE_SCAN} select page_id, network, value as handle from found where kind = 'social'")
oracle("document_emails", f"""with docs as (select doc_id, replace(text, '.example.com', '.shop') as html from documents),
{scan('found', 'docs', 'doc_id', 'html')} select doc_id, value as email from found where kind = 'email'""")
oracle("document_phones", f"""with docs as (select doc_id, replace(text, '+1 (', 'call +1 (') as html from documents),
{scan('found', 'docs', 'doc_id', 'html')} select doc_id, value as phone from found where kind = 'phone'""")


def payload_rows(name: str, source: str, key: str) -> str:
    linked = """regexp_extract_all(html, '(?s)<script[^>]*type="application/ld\\+json"[^>]*>(.*?)</script>', 1)"""
    return rf"""
{name}_ld as (select {key}, unnest({linked}) as b from {source}),
{name} as (select {key}, regexp_extract(html, '(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(\{{.*?\}})</script>', 1) as b from {source}
  union all select {key}, b from {name}_ld
  union all select {key}, unnest(regexp_extract_all(list_item, '"(https?://[^"]+)"', 1)) from (select {key}, unnest(regexp_extract_all(b, '"sameAs"\s*:\s*\[([^\]]+)\]', 1)) as list_item from {name}_ld)
  union all select {key}, regexp_extract(html, '(?s)window\.__NUXT__\s*=\s*(\{{.*?\}});', 1) from {source})"""


oracle("payload_contacts", f"""with {payload_rows('blobs', 'fx_pages', 'page_id')}, {scan('found', 'blobs', 'page_id', 'b')}
select distinct page_id, kind, network, value from found""")

PATHS = f"paths(n, path) as (values {values([(i + 5, p) for i, p in enumerate(fixed.CONTACT_PATHS)])})"
LINK_WORDS = "|".join(fixed.CONTACT_LINK_WORDS)


def link_ctes(p: str, crawl: str, sites: str) -> str:
    """CTEs ``{p}home`` and ``{p}links``; ``crawl`` has url, landed, html."""
    return rf"""
{p}home as (select site, c.url as page, html, landed, {host('landed')} as host from {sites} join {crawl} c on rtrim({canon('landed')}, '/') = site),
{p}home_anchors as (select site, page, landed, host, regexp_extract_all(coalesce(nullif({any_footer('html')}, ''), html), '(?is)<a\b[^>]*>.*?(?:</a\s*>|\z)') as l from {p}home),
{p}anchor_rows as (select site, page, landed, host, generate_subscripts(l, 1) as pos, unnest(l) as a from {p}home_anchors),
{p}anchor_parts as (select site, page, landed, host, pos, trim({href('a')}) as h, lower(regexp_replace(a, '<[^>]*>', ' ', 'g')) as label from {p}anchor_rows),
{p}full_links as (select site, page, host, pos, case when starts_with(h, 'http') then h when starts_with(h, '/') then regexp_extract(landed, '^https?://[^/?#]+', 0) || h end as full_url
  from {p}anchor_parts where regexp_matches(lower(h) || ' ' || label, '{LINK_WORDS}')),
{p}same_host as (select site, page, min(pos) as pos, {canon('full_url')} as url from {p}full_links where full_url is not null and {host('full_url')} = host group by site, page, {canon('full_url')}),
{p}page_order as (select site, url, row_number() over (partition by site, page order by pos) as pos from {p}same_host),
{p}site_order as (select site, url, min(pos) as pos from {p}page_order group by 1, 2),
{p}unseen as (select s.* from {p}site_order s where rtrim(url, '/') <> site and not exists (select 1 from paths where s.url = s.site || path)),
{p}link_ranks as (select site, url, row_number() over (partition by site order by pos, url) as nth from {p}unseen where url in (select {canon('url')} from {crawl})),
{p}links as (select site, nth + 15 as stage, url from {p}link_ranks)"""


def cascade_ctes(p: str, crawl: str, sites: str, rendered: str) -> str:
    """CTEs ``{p}first_seen`` and ``{p}kept``: contacts by stage, with early stop."""
    return f"""{link_ctes(p, crawl, sites)},
{payload_rows(p + 'blobs', p + 'home', 'site')},
{p}shells as (select distinct site from {p}home where {SPA}),
{p}late as (select site, r.html from (select rtrim({canon('url')}, '/') as site, html from {rendered}) r join {p}shells using (site)),
{p}sources as (
  select site, 0 as stage, b as blob from {p}blobs
  union all select site, 1, {any_footer('html')} from {p}home
  union all select site, 2, html from {p}home
  union all select site, 3, {any_footer('html')} from {p}late
  union all select site, 4, html from {p}late
  union all select site, n, html from {sites} cross join paths join {crawl} c on c.url = site || path
  union all select site, stage, html from {p}links join {crawl} c using (url)),
{scan(p + 'found', p + 'sources', 'site, stage', 'blob')},
{p}first_seen as (select site, kind, network, value, cast(min(stage) as bigint) as stage from {p}found group by 1, 2, 3, 4),
{p}stage_list as (select distinct site, stage from {p}first_seen),
{p}upto as (select l.site, l.stage, count(*) filter (where kind = 'email') as e, count(*) filter (where kind = 'phone') as p, count(*) filter (where kind = 'social') as s
  from {p}stage_list l join {p}first_seen f on f.site = l.site and f.stage <= l.stage group by 1, 2),
{p}stops as (select site, min(stage) as stop from {p}upto where e >= 1 or (p >= 1 and s >= 1) group by 1),
{p}kept as (select f.* from {p}first_seen f left join {p}stops using (site) where stop is null or stage <= greatest(stop, 1))"""


SITES = f"""
crawl as (select {canon('url')} as url, url as landed, html from fx_crawl),
sites as (select distinct 'https://' || {host('url')} as site from fx_crawl)"""
oracle("contact_candidates", f"""with {SITES}, {PATHS}
select site, cast(n as bigint) as stage, url from sites cross join paths join crawl on crawl.url = site || path""")
oracle("footer_links", f"with {SITES}, {PATHS}, {link_ctes('', 'crawl', 'sites')} select site, cast(stage as bigint) as stage, url from links")
CASCADE = f"{SITES}, {PATHS}, {cascade_ctes('', 'crawl', 'sites', 'fx_rendered')}"
oracle("staged_contacts", f"with {CASCADE} select * from first_seen")
oracle("contact_cascade", f"with {CASCADE} select site, kind, network, value, stage as first_stage from kept")


def assembled(name: str, source: str) -> str:
    def listed(kind, net):
        return f"list(value order by value) filter (where kind = '{kind}' and network = '{net}')"
    nets = ", ".join(
        f"case when count(*) filter (where network = '{n}') > 0 then '{n}=' || array_to_string({listed('social', n)}, ',') end"
        for n in sorted(fixed.SOCIAL_PATTERNS))
    return f"""{name} as (select site, coalesce(array_to_string({listed('email', '')}, '|'), '') as emails,
  coalesce(array_to_string({listed('phone', '')}, '|'), '') as phones,
  array_to_string(list_filter([{nets}], lambda v: v is not null), '|') as socials from {source} group by site)"""


oracle("contacts_row", f"with {CASCADE}, {assembled('rows_', 'kept')} select * from rows_")


# --- labels -------------------------------------------------------------------

oracle("label_requests", f"""with {text_ctes('fx_crawl')}
select page_id, url, case when page_id % 2 = 0 then 'Does this site offer the niche "handmade gifts"? Answer with that niche or Other.'
  else 'Choose the best category: Jewelry, Fashion, Retail or Other.' end || chr(10) || 'URL: ' || url || chr(10) || 'TITLE: ' || title || chr(10) || 'URL HINT: ' || {hint('url')}
  || chr(10) || 'TEXT (' || cast(length(text) as varchar) || ' chars): ' || case when text <> '' then text else '[no page text]' end as request from texts""")
oracle("parse_labels", rf"""
with raw as (select conv_id, turn, trim(content) as r, trim(regexp_replace(trim(content), '(?s)<think>.*?</think>', '', 'g'), ' '||chr(9)||chr(10)||chr(13)) as c from fx_responses),
objects as (select *, coalesce(regexp_extract_all(c, '(?s)\{{[^{{}}]*"vertical"[^{{}}]*\}}')[-1], regexp_extract_all(c, '(?s)\{{.*?\}}')[-1]) as o from raw),
parsed as (select *, try_cast(o as json) as j from objects),
read_ as (select *, case when j is not null then coalesce(try_cast(coalesce(j->>'$.confidence', '0') as double), -1) else -1 end as conf from parsed)
select conv_id, cast(turn as bigint) as turn, case when r = '' then 'Unknown' when conf >= 0 then coalesce(j->>'$.vertical', 'Other') else 'Other' end as vertical,
  case when r <> '' and conf >= 0 then conf else 0.0::double end as confidence,
  case when r = '' then 'model returned empty response' when conf >= 0 then coalesce(j->>'$.reason', '') else 'could not parse JSON · raw: ' || c end as reason from read_""")


def lexicon_ctes(source: str) -> str:
    """CTE ``labelled``: the source (url, title, text) plus a verdict."""
    counts = ", ".join(
        rf"len(regexp_extract_all(seen, '\b(?:{'|'.join(w)})\b')) as n{i}"
        for i, w in enumerate(fixed.LEXICON.values()))
    n = [f"n{i}" for i in range(len(fixed.LEXICON))]
    best, total = f"greatest({', '.join(n)})", "(" + " + ".join(n) + ")"
    label = " ".join(f"when {c} = {best} then '{name}'" for c, name in zip(n, fixed.LEXICON))
    return f"""seen_text as (select *, lower(title || ' ' || {hint('url')} || ' ' || text) as seen from {source}),
seen_counts as (select *, {counts} from seen_text),
labelled as (select *, case when {total} = 0 then 'Other' {label} end as vertical,
  case when {total} = 0 then 0.0::double else {best}::double / {total} end as confidence,
  'lexicon hits: ' || cast({best} as varchar) || ' of ' || cast({total} as varchar) as reason from seen_counts)"""


oracle("lexicon_labels", f"with {text_ctes('fx_crawl')}, {lexicon_ctes('texts')} select page_id, vertical, confidence, reason from labelled")
UNLABELLED = "trim(coalesce(vertical, '')) in ('', 'Unknown')"
oracle("unknown_sweep", f"""with {LATEST}, {FIRST_URLS}
select l.job_id, domain, case when {UNLABELLED} and u.host is not null then case when seq % 2 = 0 then 'Retail' else 'Unknown' end else vertical end as vertical,
  case when {UNLABELLED} and u.host is not null then 0.5 else confidence end as confidence,
  case when {UNLABELLED} and u.host is not null then 'second look' else reason end as reason
from latest l left join urls_once u on l.job_id = u.job_id and l.domain = u.host""")


# --- acceptance ---------------------------------------------------------------

def rules(source: str = "latest") -> str:
    return f"""
rules as (select id as job_id, {comma('stacks')} as st, case when trim(custom_niche) <> '' then trim(custom_niche) when vertical <> 'all' then vertical else '' end as niche,
  classify_niche, skip_tech_filter, extract_contacts from fx_jobs),
label_counts as (select job_id, count(*) as n_rows, count(*) filter (where not {UNLABELLED}) as n_ok from {source} group by 1),
policy as (select r.*, classify_niche and niche <> '' as wanted, coalesce(n_ok, 0) = 0 and coalesce(n_rows, 0) > 0 as none_ok from rules r left join label_counts using (job_id))"""


def accepted(platforms: str, apply: str, skip: str) -> str:
    return (f"((coalesce({skip}, false) or case when len(st) > 0 then len(list_intersect({platforms}, st)) > 0 else len({platforms}) > 0 end) "
            f"and (not coalesce({apply}, false) or lower(trim(coalesce(vertical, ''))) = lower(niche)))")


oracle("niche_fallback", f"with {LATEST}, {rules()} select job_id, niche, wanted and not none_ok as apply_niche, wanted and none_ok as niche_fallback from policy")
oracle("accept", f"""with {LATEST}, {rules()} select job_id, domain, {accepted(comma('platforms'), 'wanted and not none_ok', 'skip_tech_filter')} as accepted from latest left join policy using (job_id)""")
oracle("accept_resume", f"""with {LATEST}, {rules()} select job_id, domain, {accepted(comma('platforms'), 'wanted', 'false')} as accepted from latest left join policy using (job_id)""")
oracle("run_summary", f"""with {LATEST}, {FIRST_URLS}, ids as (select job_id from urls_once union select job_id from latest)
select job_id, (select count(*) from urls_once u where u.job_id = i.job_id) as collected, (select count(*) from latest v where v.job_id = i.job_id) as analysed,
  (select count(*) from latest v where v.job_id = i.job_id and accepted = 1) as matched, (select count(*) from latest v where v.job_id = i.job_id and accepted = 0) as rejected,
  (select count(*) from latest v where v.job_id = i.job_id and not {UNLABELLED}) as labels_ok, (select count(*) from latest v where v.job_id = i.job_id and {UNLABELLED}) as labels_failed
from ids i""")


# --- job history --------------------------------------------------------------

oracle("append_urls", f"""with ordered as (select *, row_number() over (partition by job_id, host order by case when seq <= 3 then 0 else 1 end, seq, tiebreak) as rn from fx_urls)
select job_id, host, cast(seq as bigint) as seq, tiebreak from ordered where rn = 1""")
oracle("upsert_verifications", f"with {LATEST} select job_id, domain, url, cast(version as bigint) as version, tiebreak, platforms, vertical, confidence, reason, cast(accepted as bigint) as accepted, emails, phones, socials from latest")
oracle("job_status", """with made as (select id, max(seq) as mseq, arg_max(changed_at, seq) as mat from fx_status_changes where replaced group by 1),
last_ as (select id, arg_max(status, seq) as st from fx_status_changes group by 1),
ends as (select c.id, arg_max(c.changed_at, c.seq) as eat from fx_status_changes c left join made m using (id) where ended and (mseq is null or c.seq > mseq) group by 1),
ids as (select id from fx_jobs union select id from made)
select i.id, strftime(coalesce(m.mat, j.created_at), '%Y-%m-%d %H:%M:%S') as created_at, coalesce(l.st, j.status) as status, strftime(e.eat, '%Y-%m-%d %H:%M:%S') as ended_at
from ids i left join fx_jobs j using (id) left join last_ l using (id) left join made m using (id) left join ends e using (id)""")
oracle("recover_orphans", """select id, case when status = 'running' and id not in (select job_id from fx_urls where seq = 1) then 'interrupted' else status end as status,
  case when status = 'running' and id not in (select job_id from fx_urls where seq = 1) then '2030-01-01 00:00:00' end as ended_at,
  status = 'running' and id not in (select job_id from fx_urls where seq = 1) as recovered from fx_jobs""")


def job_list(limit: str) -> str:
    return f"""with {LATEST}, {FIRST_URLS}
select id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at, (select count(*) from urls_once u where u.job_id = j.id) as collected,
  (select count(*) from latest v where v.job_id = j.id) as verified, (select count(*) from latest v where v.job_id = j.id and v.accepted = 1) as matched,
  (select count(*) from latest v where v.job_id = j.id and {UNLABELLED.replace('vertical', 'v.vertical')}) as unknown_niche
from fx_jobs j order by j.created_at desc, id {limit}"""


oracle("list_jobs", job_list("limit 50"))
oracle("list_jobs_all", job_list(""))
PREVIOUS = """keyed as (select id, created_at, status, concat_ws('~', keywords, custom_niche, city, coalesce(state, ''), country, area, array_to_string(list_sort(string_split(stacks, ',')), ',')) as k from fx_jobs),
pairs as (select id as job_id, last_value(case when status in ('done', 'stopped') then id end ignore nulls) over (partition by k order by created_at, id rows between unbounded preceding and 1 preceding) as prev_job_id from keyed)"""
DIFF = f"""{PREVIOUS}, linked as (select * from pairs where prev_job_id is not null), hosts as (select distinct job_id, host from fx_urls),
compared as (select l.job_id, l.prev_job_id, h.host, p.host as known from linked l join hosts h on h.job_id = l.job_id left join hosts p on p.job_id = l.prev_job_id and p.host = h.host),
fresh as (select job_id, prev_job_id, host from compared where known is null)"""
NEW_HOSTS = f"""{PREVIOUS}, linked as (select * from pairs where prev_job_id is not null), hosts as (select distinct job_id, host from fx_urls),
asked as (select l.job_id, l.prev_job_id, h.host from linked l join hosts h on h.job_id = l.job_id)"""
oracle("previous_run", f"with {PREVIOUS} select * from pairs")
oracle("new_hosts", f"with {NEW_HOSTS} select a.job_id, a.prev_job_id, a.host from asked a anti join hosts p on p.job_id = a.prev_job_id and p.host = a.host")
oracle("run_diff", f"""with {DIFF} select job_id, prev_job_id, (select count(*) from fresh f where f.job_id = l.job_id) as new_count,
  (select count(*) from hosts h where h.job_id = l.prev_job_id) as prev_total from linked l""")
oracle("remaining_urls", f"with {LATEST}, {FIRST_URLS} select job_id, host, cast(seq as bigint) as seq, tiebreak from urls_once u where not exists (select 1 from latest v where v.accepted = 1 and v.job_id = u.job_id and v.domain = u.host)")
oracle("backfill_set", f"with {LATEST} select job_id, domain, cast(version as bigint) as version from latest where emails = '' and phones = '' and {SOCIAL_TEXT} = ''")
oracle("patch_rows", f"""with {FIRST_URLS}, ranked as (select *, row_number() over (partition by job_id, url order by version, tiebreak) as rn from fx_history)
select r.job_id, domain, cast(version as bigint) as version, r.tiebreak, vertical, case when u.host is not null then 'new@' || u.host else array_to_string({comma('emails')}, '|') end as emails,
  case when u.host is not null then '' else array_to_string({comma('phones')}, '|') end as phones
from ranked r left join urls_once u on rn = 1 and u.seq % 2 = 0 and u.job_id = r.job_id and u.host = r.domain""")
oracle("delete_jobs", f"""with {LATEST}, {FIRST_URLS}, gone as (select id from fx_jobs where status = 'stopped')
select 'jobs' as kind, id, '' as name from fx_jobs where status <> 'stopped'
union all select 'urls', job_id, host from urls_once where job_id not in (select id from gone)
union all select 'verifications', job_id, domain from latest where job_id not in (select id from gone)""")
oracle("schema_upgrade", """select job_id, domain, cast(version as bigint) as version, tiebreak, vertical, case when version <= 3 then '' else emails end as emails,
  case when version <= 3 then '' else phones end as phones, case when version <= 3 then '' else socials end as socials from fx_history""")


# --- streams ------------------------------------------------------------------

LIVE = """live as (select job_id, domain, version, tiebreak, case when l_returnflag = 'N' then 'Unknown' when l_returnflag = 'A' then 'Jewelry' else 'Fashion' end as vertical, l_linestatus = 'F' as accepted
from (select 'job_' || cast(l_orderkey as varchar) as job_id, 's' || cast(l_suppkey % 20 as varchar) || '.example' as domain, l_linenumber as version, l_partkey * 100000000 + l_suppkey * 10000 + cast(l_quantity * 100 as bigint) as tiebreak, l_returnflag, l_linestatus from lineitem))"""
oracle("stream_first", "select distinct job_id, host from fx_urls")
oracle("stream_first_stored", """select 'job_' || cast(l_orderkey as varchar) as job_id, 's' || cast(l_suppkey % 20 as varchar) || '.example' as host,
  cast(min((l_linenumber - 1) % 4) as bigint) as run from lineitem group by 1, 2""")
LIVE_LATEST = f"""with {LIVE}, r as (select *, row_number() over (partition by job_id, domain order by version desc, tiebreak desc) as rn from live)
select job_id, domain, cast(version as bigint) as version, tiebreak, vertical, accepted from r where rn = 1"""
oracle("stream_upsert", LIVE_LATEST)
oracle("stream_folded", LIVE_LATEST)
oracle("stream_counts", f"with {LIVE} select job_id, count(*) as verified, count(*) filter (where accepted) as matched, count(*) filter (where vertical = 'Unknown') as unknown_niche from live group by 1")


# --- whole runs ---------------------------------------------------------------

RUN_LOG = f"""
{MARKERS}, {PATHS},
log_usable as (select {canon('url')} as url, coalesce(nullif(final_url, ''), {canon('url')}) as landed, headers_text, body as html,
  row_number() over (partition by {canon('url')} order by attempt) as rn from fx_run_log where status < 400 and body <> ''),
run_pages as (select url, landed, headers_text, html from log_usable where rn = 1),
run_rendered as (select {canon('url')} as url, html from fx_rendered)"""


def profile_ctes(p: str, wanted: str) -> str:
    """CTE ``{p}profiles`` (url, landed, ok, platforms, verdict) of ``wanted`` addresses
    and ``{p}contacts`` (site, emails, phones, socials)."""
    order = "src, case when evidence is null then 1 else 0 end, pi"
    return f"""
{p}pages as (select w.url, landed, headers_text, html from {wanted} w join run_pages r using (url)),
{hits(p + 'static', p + 'pages', 'url', "lower(html) || ' ' || lower(headers_text)")},
{hits(p + 'shown', 'run_rendered', 'url', 'lower(html)')},
{p}again as (select w.url from {wanted} w left join {p}static s using (url) group by w.url having count(*) filter (where s.platform not in {FRAMEWORK_LIST}) = 0),
{p}all_hits as (select url, platform, evidence, 0 as src from {p}static union all
  select url, platform, evidence, 1 from {p}shown l where url in (select url from {p}again) and not exists (select 1 from {p}static s where s.url = l.url and s.platform = l.platform)),
{p}stacks as (select url, list(h.platform order by {order}) as platforms, array_to_string(list_sort(list(h.platform || '=' || coalesce(array_to_string(evidence, ','), ''))), '|') as hits from {p}all_hits h join (select distinct pi, platform from markers) m using (platform) group by url),
{text_ctes(p + 'pages').replace('full_text', p + 'full_text').replace('texts as', p + 'texts as')},
{p}asked as (select w.url as requested, coalesce(t.landed, w.url) as url, t.landed is not null as ok, coalesce(title, '') as title, coalesce(text, '') as text from {wanted} w left join {p}texts t using (url)),
{lexicon_ctes(p + 'asked').replace('seen_text', p + 'seen_text').replace('seen_counts', p + 'seen_counts').replace('labelled as', p + 'labelled as')},
{p}profiles as (select requested as url, l.url as landed, ok, coalesce(platforms, []) as platforms, coalesce(hits, '') as hits, vertical, confidence, reason from {p}labelled l left join {p}stacks s on s.url = l.requested),
{p}sites as (select distinct rtrim({canon('landed')}, '/') as site from {p}pages),
{cascade_ctes(p, 'run_pages', p + 'sites', 'run_rendered')},
{assembled(p + 'contacts', p + 'kept')}"""


REQUEST = f"""case when niche <> '' then 'Does this site offer the niche "' || niche || '"? Answer with that niche or Other.'
  else 'Choose the best category: Jewelry, Fashion, Retail or Other.' end || chr(10) || 'URL: ' || url || chr(10) || 'TITLE: ' || title || chr(10) || 'URL HINT: ' || {hint('url')}
  || chr(10) || 'TEXT (' || cast(length(text) as varchar) || ' chars): ' || case when text <> '' then text else '[no page text]' end"""


def service_ctes(p: str, collected: str) -> str:
    """CTE ``{p}verdicts`` (url, niche, verdict): answers of the flaky service, three attempts."""
    size = "length(request)"
    return f"""
{p}questions as (select distinct c.url as requested, trim(coalesce(j.custom_niche, '')) as niche from {collected} c left join fx_jobs j on j.id = c.job_id where coalesce(j.classify_niche, true)),
{p}requests as (select requested, niche, {REQUEST} as request from {p}questions join {p}asked using (requested)),
{p}answers as (select *, case when {size} % 11 = 0 then 'model rejection' when {size} % 7 = 0 then 'timeout'
  when {size} % 3 = 0 and n = 1 or {size} % 13 = 0 and n <= 2 then 'API error: 429' else '' end as error from {p}requests, (values (1), (2), (3)) t(n)),
{p}tried as (select *, error in ('', 'model rejection') or n = 3 as final from {p}answers),
{p}verdicts as (select requested as url, niche, case when error <> '' then 'Unknown' when niche <> '' then case when contains(lower(request), 'rings') then niche else 'Other' end
  when contains(lower(request), 'rings') then 'Jewelry' when contains(lower(request), 'shoes') then 'Fashion' else 'Other' end as vertical,
  case when error <> '' then 0.0::double else cast('0.' || cast(5 + {size} % 5 as varchar) as double) end as confidence,
  case when error <> '' then error else 'attempt ' || n end as reason from {p}tried where final qualify row_number() over (partition by requested, niche order by n) = 1)"""


def verify_ctes(p: str, collected: str, service: bool = False) -> str:
    """CTE ``{p}ver`` from ``collected`` (job_id, host, url, w = write order)."""
    base, source = profile_ctes(p, p + 'wanted'), collected
    if service:
        base += f""",{service_ctes(p, collected)},
{p}niched as (select c.*, trim(coalesce(j.custom_niche, '')) as niche from {collected} c left join fx_jobs j on j.id = c.job_id)"""
        labels, collected = f"left join {p}verdicts v on v.url = c.url and v.niche = c.niche", f"{p}niched"
    else:
        labels = ""
    return f"""
{p}wanted as (select distinct url from {source}),
{base},
{p}rows as (select c.job_id, c.host as requested_host, {host('r.landed')} as domain, r.landed as url, platforms,
  case when coalesce(j.classify_niche, true) then {'v' if service else 'r'}.vertical else 'Unknown' end as vertical, case when coalesce(j.classify_niche, true) then {'v' if service else 'r'}.confidence else 0.0::double end as confidence,
  case when coalesce(j.classify_niche, true) then {'v' if service else 'r'}.reason else '' end as reason,
  case when j.extract_contacts then coalesce(emails, '') else '' end as emails, case when j.extract_contacts then coalesce(phones, '') else '' end as phones, case when j.extract_contacts then coalesce(socials, '') else '' end as socials,
  row_number() over (partition by c.job_id, {host('r.landed')} order by w desc, c.host desc) as rn
  from {collected} c join {p}profiles r on r.url = c.url {labels} left join {p}contacts k on k.site = rtrim({canon('r.landed')}, '/') left join fx_jobs j on j.id = c.job_id),
{p}ver as (select * exclude (rn) from {p}rows where rn = 1)"""


def decided(ver: str, apply: str, skip: str) -> str:
    return f"""{rules(ver)} select job_id, requested_host, domain, url, array_to_string(platforms, '|') as platforms, vertical, confidence, reason, emails, phones, socials,
  {accepted('platforms', apply, skip)} as accepted from {ver} left join policy using (job_id)"""


RUN_URLS = f"""{clean_ctes('fx_run_links')}, {first_host('job_id', 'query_idx, page_no, rank')},
collected as (select job_id, host, url, query_idx, rank, struct_pack(a := query_idx, b := page_no, c := rank) as w from firsts)"""
oracle("run_campaign", f"with {RUN_LOG}, {RUN_URLS}, {verify_ctes('v_', 'collected')}, {decided('v_ver', 'wanted and not none_ok', 'skip_tech_filter')}")
oracle("run_campaign_asked", f"with {RUN_LOG}, {RUN_URLS}, {verify_ctes('v_', 'collected', service=True)}, {decided('v_ver', 'wanted and not none_ok', 'skip_tech_filter')}")
ORACLES["run_campaign_stored"] = ORACLES["run_campaign"]
oracle("run_bulk", f"""with {RUN_LOG}, {BULK},
bulk_ranks as (select *, row_number() over (partition by job_id, host order by list_id, pos, url) as rn from bulk where not skipped and host <> ''),
collected as (select job_id, host, url, struct_pack(a := list_id, b := pos) as w from bulk_ranks where rn = 1),
{verify_ctes('v_', 'collected')}, {decided('v_ver', 'wanted', 'false')}""")
oracle("run_resume", f"""with {RUN_LOG}, {RUN_URLS},
known as (select job_id, host as requested_host, url, host as domain, case when rank % 2 = 0 then 'Unknown' else 'Fashion' end as vertical, 0.25 as confidence,
  case when rank % 4 < 2 then 'old@shop.co' else '' end as emails from collected where query_idx = 0),
todo as (select job_id, host, url, w from collected c where not exists (select 1 from known k where k.job_id = c.job_id and k.requested_host = c.host)),
{verify_ctes('v_', 'todo')},
flagged as (select k.*, k.vertical = 'Unknown' and coalesce(j.classify_niche, true) as ask, k.emails = '' and coalesce(j.extract_contacts, false) as bare from known k left join fx_jobs j on j.id = k.job_id),
a_wanted as (select distinct url from flagged where ask or bare),
{profile_ctes('a_', 'a_wanted')},
patched as (select k.job_id, k.requested_host, k.domain, k.url, ['Wix'] as platforms, case when k.ask then p.vertical else k.vertical end as vertical,
  case when k.ask then p.confidence else k.confidence end as confidence, case when k.ask then p.reason else '' end as reason, case when k.bare then coalesce(c.emails, '') else k.emails end as emails,
  case when k.bare then coalesce(c.phones, '') else '' end as phones, case when k.bare then coalesce(c.socials, '') else '' end as socials
  from flagged k left join a_profiles p using (url) left join a_contacts c on c.site = rtrim(k.url, '/')),
every as (select *, 0 as round_ from patched union all select *, 1 from v_ver),
every_rank as (select *, row_number() over (partition by job_id, domain order by round_ desc, requested_host desc) as rn from every),
current_rows as (select * exclude (rn, round_) from every_rank where rn = 1), {decided('current_rows', 'wanted', 'false')}""")
oracle("verify_domains", f"""with {RUN_LOG}, wanted_urls as (select distinct {canon('url')} as url from fx_crawl), {profile_ctes('v_', 'wanted_urls')}
select landed as url, {host('landed')} as domain, array_to_string(platforms, '|') as platforms, hits, case when ok then vertical else 'Unknown' end as vertical,
  case when ok then confidence else 0.0::double end as confidence, case when ok then reason else 'fetch failed' end as reason from v_profiles""")
