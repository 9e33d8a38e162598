"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATION = rf"""with b as (select item_id, regexp_extract_all({_LOWER}, {_ALNUM}) as w from benchmark),
items as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from b where len(w) > 0)),
d as (select doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) as w from documents),
sizes as (select distinct n from items),
spots as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
found as (select doc_id, spots.n, i, item_id from spots join items on items.s = spots.s and items.n = spots.n),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
named as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list_distinct(list(item_id::varchar))), ',') as names from found group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join named using (doc_id)"""

SUBSTRING_DEDUP = r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as nth from win) where nth > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from again),
kept as (select x.doc_id, string_agg(x.v, ' ' order by x.p) as t from (select doc_id, unnest(w) as v, unnest(range(1, len(w) + 1)) as p from d) x anti join gone on gone.doc_id = x.doc_id and gone.p = x.p group by x.doc_id),
n as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n.n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join n using (doc_id) left join kept using (doc_id)"""

CHAT = r"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m as (select *, length(text) + length(regexp_replace(text, '[^\\\[\]<]', '', 'g')) as body,
  case role when 'user' then 15 when 'assistant' then 11 when 'system' then 17 else 16 + length(role) + length(regexp_replace(role, '[^\\\[\]<]', '', 'g')) end as marks from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256, sum(body + marks + 1)::bigint as formatted_chars from m group by conv_id"""

FILL_IN_MIDDLE = r"""with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || doc_id) as h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as w, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
k as (select *, len(w) as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
x as (select *, array_to_string(w[1:a], '') as p, array_to_string(w[a + 1:b], '') as m, array_to_string(w[b + 1:], '') as s from k)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256 from x"""
