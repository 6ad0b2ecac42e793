"""DuckDB statements for the training-data queries that SQL can express."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

NEAR = f"""
with recursive worded as (
  select doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} as w from documents
), shingled as (
  select doc_id, case
    when len(w) >= 5 then list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
  from worded
), flat as (select doc_id, len(s) as n, unnest(s) as g from shingled),
pairs as (
  select a.doc_id as u, b.doc_id as v, count(*) as nb, any_value(a.n) as nu, any_value(b.n) as nv
  from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
  select u, v from pairs where 100 * nb >= 75 * (nu + nv - nb)
), sym as (select u, v from links union all select v, u from links),
reach(node, other) as (
  select doc_id, doc_id from shingled
  union
  select r.node, s.v from reach r join sym s on s.u = r.other
)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from shingled s join (select node, min(other) as component_id from reach group by node) c on c.node = s.doc_id
"""

CONTROL = ("<|", "|>", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")
ESCAPES = "length({0}) - length(replace({0}, '\\', ''))" + "".join(
    f" + (length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in CONTROL)
NEW_LINE = "length({0}) - length(replace({0}, chr(10), ''))"

CHAT = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, length(role) + {ESCAPES.format("role")} + {NEW_LINE.format("role")} + length(text) + {ESCAPES.format("text")}
    + length('<|turn|>') + 1 + length('<|end|>') + 1 as chars from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""

CRC_TABLE = """select list_transform(range(256), lambda k: list_reduce(
    list_concat([k], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t"""


def crc32(codes: str) -> str:
    """CRC-32 of a list of bytes, with the table ``t`` in scope."""
    return f"""xor(list_reduce(list_concat([4294967295], {codes}),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""


LEAF = "sha256(" + " || ".join(
    f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
DIGITS = "list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ord(x) as bigint))"


def levels(nodes: str, rows: str, depth: int) -> str:
    """Trees of eight over the ``nodes`` (tree, idx, total, d), level by level, and the
    ``rows`` (tree, pos, cur, proof) folded with their siblings."""
    out = ""
    for k in range(depth):
        n, w = (nodes, rows) if k == 0 else (f"{nodes}{k}", f"{rows}{k}")
        out += f""", {nodes}{k + 1} as (
  select tree, idx // 8 as idx, (total + 7) // 8 as total,
    case when total > 1 then sha256(string_agg(d, '' order by idx)) else any_value(d) end as d
  from {n} group by tree, idx // 8, total
), {rows}{k + 1} as (
  select w.* replace (w.pos // 8 as pos,
      case when n.total > 1 then sha256(l || w.cur || r) else w.cur end as cur,
      case when n.total > 1 then w.proof || l || r else w.proof end as proof)
  from {w} w join (
    select w.rid, any_value(n.total) as total,
      coalesce(string_agg(n.d, '' order by n.idx) filter (n.idx < w.pos), '') as l,
      coalesce(string_agg(n.d, '' order by n.idx) filter (n.idx > w.pos), '') as r
    from {w} w join {n} n on n.tree is not distinct from w.tree and n.idx // 8 = w.pos // 8
    group by w.rid) n on n.rid = w.rid
)"""
    return out


#: Holds for 8 ** 8 documents of a language and 8 ** 4 languages.
MERKLE = f"""
with crc as ({CRC_TABLE}), leaf as (
  select doc_id, lang as tree, {LEAF.format("text")} as leaf,
    case when {crc32(DIGITS)} % 3 = 0 then {LEAF.format(LOWER.format("text"))} else {LEAF.format("text")} end as claim
  from documents, crc
), placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf, claim) - 1 as idx,
    count(*) over (partition by tree) as total, row_number() over (order by tree nulls first, doc_id, leaf) as rid
  from leaf
), n as (select tree, idx, total, leaf as d from placed),
w as (select rid, doc_id, leaf, tree, idx as pos, claim as cur, '' as proof from placed)
{levels("n", "w", 8)}, sub as (
  select tree as name, d, row_number() over (order by tree nulls first) - 1 as idx, count(*) over () as total from n8
), m as (select 0 as tree, idx, total, d from sub),
v as (
  select w.rid, w.doc_id, w.leaf, s.d as subroot, 0 as tree, s.idx as pos, w.cur, w.proof
  from w8 w join sub s on s.name is not distinct from w.tree
)
{levels("m", "v", 4)}
select v.doc_id, v.leaf, v.subroot, m.d as root, sha256(v.proof) as proof_sha256, v.cur as folded_root,
  v.cur = m.d as verified
from v4 v, m4 m
"""

LETTERS = """flatten(list_transform(string_split(id || ':' || run, ''),
    lambda x: case when ord(x) < 128 then [cast(ord(x) as bigint)] else [195, ord(x) - 64] end))"""

VARIANTS = f"""
with recursive crc as ({CRC_TABLE}), runs as (
  select id, run, count(*) as k from (
    select cast(doc_id as varchar) as id, unnest(regexp_extract_all({LOWER.format("text")}, '[A-Za-zÀ-ÿ]+')) as run
    from documents)
  where length(run) >= 6 group by all
), coded as (select run, k, coalesce({crc32(LETTERS)}, 1) as h from runs, crc),
words as (
  select word, cast(sum(k) as bigint) as n from (
    select case when h % 199 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, k from coded)
  where length(word) >= 6 group by word having sum(k) >= 5
), cut as (
  select word, i, word[:i - 1] || word[i + 1:] as rest from (select word, unnest(range(1, length(word) + 1)) as i from words)
), pairs as (
  select a.word, b.word as near from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word from cut a join words b on a.rest = b.word
  union select b.word, a.word from cut a join words b on a.rest = b.word
), best as (
  select p.word, count(*) as n_near, arg_min(p.near, (-w.n, p.near)) as near, max(w.n) as near_n
  from pairs p join words w on w.word = p.near group by p.word
), formed as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near,
    case when b.near_n >= 5 * w.n then b.near end as form, case when b.near_n >= 5 * w.n then b.near_n end as form_n
  from words w left join best b on b.word = w.word
), led(word, root, form) as (
  select word, word, form from formed
  union all select l.word, f.word, f.form from led l join formed f on f.word = l.form
)
select f.word, f.form, l.root, f.n, f.n_near, f.form_n
from formed f join led l on l.word = f.word and l.form is null
"""

ORACLES = {
    "op6_chat_formatting": CHAT,
    "op2_minhash_near_dedup": NEAR,
    "op11_merkle_manifest": MERKLE,
    "op13_spelling_variants": VARIANTS,
}
