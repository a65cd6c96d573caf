"""DuckDB SQL for those operators that SQL can express. The others are tested against brute force in tests/llm."""

from __future__ import annotations

from functools import reduce

from factorlake.llm.licences import RULES, SENTENCE_END, SENTENCES
from factorlake.llm.queries import SHARD_BYTES

_HASH = "('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 15))::bigint"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_rules = ""
for _k, (_name, _ids) in enumerate(RULES):
    _w = "".join(f"<{x}>" for x in _ids)
    _rules += f", s{_k + 1} as (select * exclude (l), case when contains(l, '{_w}') then '{_name}' end r{_k}, replace(l, '{_w}', '') l from s{_k})"
_known = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items()) + "}"
_licences = f"""
with cut as (
  select doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '{SENTENCE_END}', chr(10), 'g'), chr(10)),
    lambda s: trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') s
  from documents),
named as (select doc_id, len(s) n_sentences, list_filter(list_transform(s, lambda x: {_known}[x]), lambda x: x is not null) ids from cut),
s0 as (select doc_id, n_sentences, ids, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') l from named)
{_rules}
select doc_id, n_sentences::bigint n_sentences, len(ids)::bigint n_known, coalesce(array_to_string(ids, ','), '') sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{", ".join(f"r{k}" for k in range(len(RULES)))}], lambda x: x is not null))), ','), '') licences
from s{len(RULES)}"""

_sharding = f"""
with d as (select row_number() over () r, doc_id, strlen(coalesce(text, ''))::bigint n_bytes, {_HASH} h from documents),
p as (select r, depth, h >> (60 - depth) p, n_bytes from d, range(0, 61) t(depth)),
s as (select depth, p, sum(n_bytes)::bigint b, count(*) n from p group by all),
best as (select p.r, min(p.depth) depth from p join s using (depth, p) where s.b <= {SHARD_BYTES} group by p.r),
o as (select doc_id, n_bytes, h, ((row_number() over (partition by h) - 1) // greatest({SHARD_BYTES} // greatest(n_bytes, 1), 1))::bigint page from d where r not in (select r from best))
select d.doc_id, d.n_bytes, 's' || right(format('{{:060b}}', d.h), 60)[1:best.depth] shard, best.depth::int shard_depth, s.b shard_bytes, s.n shard_docs, false oversize
from d join best using (r) join s on s.depth = best.depth and s.p = d.h >> (60 - best.depth)
union all
select doc_id, n_bytes, 's' || right(format('{{:060b}}', h), 60) || '.' || page, 60, sum(n_bytes) over (partition by h, page), count(*) over (partition by h, page), n_bytes > {SHARD_BYTES} from o"""

_near = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
g as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from w),
n as (select doc_id, count(*) n from g group by doc_id),
c as (select x.doc_id a, y.doc_id b, count(*) k from g x join g y on x.g = y.g and x.doc_id <> y.doc_id group by all),
e as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 75 * (na.n + nb.n - k)),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
m as (select a, min(b) b from r group by a)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, least(d.doc_id, m.b) component_id, d.doc_id = least(d.doc_id, m.b) kept
from documents d left join n using (doc_id) left join m on m.a = d.doc_id"""

_contamination = r"""
with words as (select 'd' k, doc_id id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
  union all select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
win as (select distinct id item, m, array_to_string(w[i:i + m - 1], ' ') x from (select id, w, least(10, len(w)) m, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from words where k = 'b' and len(w) > 0)),
occ as (select id, m, i, array_to_string(w[i:i + m - 1], ' ') x from (select id, w, m, unnest(range(1, len(w) - m + 2)) i from words, (select distinct m from win) where k = 'd' and len(w) >= m)),
hit as (select id, item, i, m from occ join win using (m, x)),
n as (select id, count(distinct p) n_hit from (select id, unnest(range(i, i + m)) p from hit) group by id),
items as (select id, count(*) n_items, string_agg(item::varchar, ',' order by item::varchar) s from (select distinct id, item from hit) group by id)
select id doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from words left join n using (id) left join items using (id) where k = 'd'"""

_mixing = rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, {_HASH} h from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] w, row_number() over (order by source nulls last) - 1 place, source_size * 3.0::double cap from s),
r as (select *, cap / w room from w),
l as (select *, (sum(cap) over () / 3 - sum(cap) over (order by room, place rows unbounded preceding) + cap) / sum(w) over (order by room, place rows between current row and unbounded following) level from r),
f as (select min(struct_pack(room := room, place := place, level := level)) f from l where room > level),
t as (select source, source_size, round(case when f is null or room < f.room or (room = f.room and place < f.place) then cap else w * f.level end, 6) target from l, f),
q as (select *, case when source_size > 0 then least(floor(target / source_size), 3)::bigint else 0 end whole from t),
g as (select source, h, sum(size) size, sum(sum(size)) over (partition by source order by h) through from d group by source, h),
k as (select g.source, max(h) cut from g join q on g.source is not distinct from q.source
  where through <= greatest(target - whole * source_size, 0) or (through - size < greatest(target - whole * source_size, 0)
    and through - greatest(target - whole * source_size, 0) < greatest(target - whole * source_size, 0) - through + size) group by g.source)
select doc_id, size, d.source, source_size, target, copies, size * copies taken
from (select d.*, q.source_size, q.target, case when size > 0 then whole + (h <= coalesce(cut, -1))::bigint else 0 end copies
  from d join q on d.source is not distinct from q.source left join k on d.source is not distinct from k.source) d"""

_warc = """
with p as (select page_id, url, coalesce(html, '') h, strlen(coalesce(html, ''))::bigint payload_bytes, sha1(coalesce(html, '')) payload_digest from pages),
m as (select payload_digest, max(page_id) largest from p where payload_bytes >= 1000 group by 1)
select p.page_id, p.payload_bytes, p.payload_digest, case when m.largest is null or p.page_id = m.largest then 'response' else 'revisit' end record_type,
  case when p.page_id < m.largest then m.largest end refers_to, url from p left join m using (payload_digest)"""

_audit = r"""
with d as (select row_number() over () r, doc_id, coalesce(source, '') part, coalesce(text, '') t from documents),
w as (select r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) w from d),
c as (select r, sum(n) n, count(*) k from (select r, w, count(*) n from w group by all) group by r),
m as (select t, min(doc_id) least from d group by t),
l as (select doc_id, bool_or(coalesce(quality = 1, false)) good, bool_or(coalesce(toxic = 1, false)) toxic from labels group by doc_id),
f as (select part, coalesce(good, false) good, coalesce(toxic, false) toxic, [coalesce(n, 0) < 200, 100 * coalesce(k, 0) < 50 * coalesce(n, 0),
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] fails
  from d left join c using (r) left join m using (t) left join l using (doc_id)),
g as (select part, fails, count(*) n, count_if(good) good, count_if(toxic) toxic from f group by all),
o as (select a || b || c || d || e filter_order from unnest(['A', 'B', 'C', 'D', 'E']) x(a), unnest(['A', 'B', 'C', 'D', 'E']) y(b), unnest(['A', 'B', 'C', 'D', 'E']) z(c),
    unnest(['A', 'B', 'C', 'D', 'E']) v(d), unnest(['A', 'B', 'C', 'D', 'E']) u(e) where len(list_distinct([a, b, c, d, e])) = 5),
s as (select filter_order, step, ascii(filter_order[step]) - 64 own, list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) before from o, range(1, 6) t(step)),
x as (select part, filter_order, step, own, n, good, toxic, fails[own] here, coalesce(list_bool_or(list_transform(before, lambda i: fails[i])), false) gone,
    len(list_filter(fails, lambda b: b)) = 1 alone from g, s),
y as (select part, filter_order, step, own, sum(case when not gone and not here then n else 0 end)::bigint kept, sum(case when here and not gone then n else 0 end)::bigint removed,
    sum(case when here and gone then n else 0 end)::bigint redundant, sum(case when here and alone then n else 0 end)::bigint unique_fails,
    sum(case when here and not gone then good else 0 end)::bigint good_lost, sum(case when here and not gone then toxic else 0 end)::bigint toxic_lost from x group by all)
select part, filter_order, step::int step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint shapley from y"""

#: The table of CRC-32 by its rule: eight shifts, each with the polynomial where a bit falls out.
_crc = ", ".join(str(reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), b)) for b in range(256))
_spelling = rf"""
with recursive runs as (select coalesce(doc_id::varchar, '') id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') r from documents),
occ as (select id, r, count(*) n, hex(encode(id || ':' || r)) x from runs where len(r) >= 5 group by all),
hashed as (select r, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::bigint)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::bigint) h from occ, (select [{_crc}]::bigint[] t)),
cut as (select case when h % 97 = 0 then r[1:h % len(r)] || r[h % len(r) + 2:] else r end word, n from hashed),
v as (select word, sum(n)::bigint n from cut where len(word) >= 5 group by word having sum(n) >= 3),
k as (select word, n, i, word[1:i - 1] || word[i + 1:] c from v, range(1, 200) t(i) where i <= len(word)),
near as (select x.word a, y.word b, y.n from k x join k y on x.c = y.c and x.i = y.i and x.word <> y.word union select x.word, y.word, y.n from k x join v y on x.c = y.word union select y.word, x.word, x.n from k x join v y on x.c = y.word),
best as (select a, count(*) n_near, min({{'m': -n, 'b': b}}) m from near group by a),
f as (select word, v.n, coalesce(n_near, 0)::bigint n_near, case when -m.m >= 2 * v.n then m.b end form, case when -m.m >= 2 * v.n then -m.m end::bigint form_n from v left join best on a = word),
up(word, top) as (select word, form from f where form is not null union all select up.word, f.form from up join f on f.word = up.top where f.form is not null),
last as (select up.word, up.top from up join f on f.word = up.top where f.form is null)
select f.word, form, coalesce(l.top, f.word) root, n, n_near, form_n from f left join last l on l.word = f.word"""

ORACLES = {
    "op2_licences": _licences,
    "op4_sharding": _sharding,
    "op6_near_dedup": _near,
    "op8_decontamination": _contamination,
    "op9_mixing": _mixing,
    "op10_warc": _warc,
    "op12_filter_audit": _audit,
    "op13_spelling": _spelling,
}
