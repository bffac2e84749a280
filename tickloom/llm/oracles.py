"""DuckDB SQL with the results of the operators' queries, where SQL can give them.

The others are learned (6, 9), iterated draws (4), searches (1), a tokenizer (5), or would take every window or every
partition into account (2, 7); tests hold them against brute force.
"""

_ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+)"""
_GROUP = r"""(?i:(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))"""
# kind, pattern, what must hold of a match m
_KINDS = (
    ("assign", _ASSIGN, f"length(regexp_extract(m, '{_GROUP}', 1)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
    ("code_host", "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
)


def _found(rank: int, kind: str, pattern: str, holds: str) -> str:
    """Where a match starts: the pieces between matches and the matches before it."""
    return f"""select doc_id, {rank} as r, '{kind}' as kind, s, s + length(m) as e from (
      select doc_id, m[i] as m, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as s
      from (select doc_id, m, p, unnest(range(1, len(m) + 1)) as i from (
        select doc_id, regexp_extract_all(t, '{pattern}') as m, regexp_split_to_array(t, '{pattern}') as p from d))) where {holds.replace('(m', '(m')}"""


SECRETS = f"""with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({' union all '.join(_found(k, *x) for k, x in enumerate(_KINDS))}),
g as (select doc_id, r, kind, cast(s as bigint) as s, kind || ':' || cast(s as bigint) || ':' || cast(e as bigint) as line from f),
a as (select doc_id, count(*) filter (r = 0) as n_assign, count(*) filter (r = 1) as n_access, count(*) filter (r = 2) as n_hex,
  string_agg(line, ',' order by s, r) filter (r < 3) as base, string_agg(line, ',' order by s, r) as spans from g group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (doc_id)"""

NGRAM_JOIN = r"""with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as h from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (h) where a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
c(doc_id, c) as (select doc_id, doc_id from documents union select l.b, c.c from c join l on l.a = c.doc_id)
select c.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(c.c) as component_id from c left join n using (doc_id) group by c.doc_id"""

WARC = """with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as payload_bytes, sha1(h) as x from p),
m as (select x, max(page_id) as top from d group by x)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(((16 * (instr('0123456789abcdef', substr(x, 1 + (5 * i) // 4, 1)) - 1)
    + greatest(instr('0123456789abcdef', substr(x || '0', 2 + (5 * i) // 4, 1)) - 1, 0)) >> (3 - (5 * i) % 4)) & 31 as int), 1)), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to
from d join m using (x)"""

ORACLES: dict[str, str] = {"op3_secrets": SECRETS, "op8_ngram_join": NGRAM_JOIN, "op10_warc": WARC}
