"""SQL (DuckDB) of the results, for the operators SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op10_quality_rules"] = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
e as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i from w),
g as (select doc_id, i, list(word) over (partition by doc_id order by i rows between current row and 7 following) as win
  from e),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as c from g where len(win) = 8) where c > 1),
rep as (select doc_id, count(distinct i + k) as n from r, (select unnest(range(8)) as k) group by doc_id),
s as (select w.doc_id, text, ws, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls,
    coalesce(rep.n, 0) as n_repeat_words,
    length(regexp_replace(text, '\P{Lu}+', '', 'g')) as capitals, length(regexp_replace(text, '\P{L}+', '', 'g')) as letters
  from w left join rep on w.doc_id = rep.doc_id),
v as (select *, len(ls) - len(list_distinct(ls)) as n_dup_lines,
    n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > 3 * n_words or 2 * n_dup_lines > len(ls)
    or (letters >= 20 and 10 * capitals > 6 * letters)
    or (n_words >= 50 and 10 * len(list_distinct(ws)) < n_words)) as kept
from v"""


def _secret_kind(rank: int, name: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""select doc_id, source, {rank} as rank, '{name}' as kind, {least} as least,
  regexp_extract_all(t, '{p}') as ms, regexp_extract_all(t, '{p}', {group}) as vs, string_split_regex(t, '{p}') as ps
  from d"""


_SECRET_KINDS = [
    (0, "assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    (1, "access", r"AKIA[A-Z0-9]+", 0, 16),
    (2, "hex", r"[0-9a-f]+", 0, 32),
    (3, "pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 1),
    (4, "jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    (5, "prefixed", r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]{16,}", 0, 1),
]

ORACLES["op2_secret_scan"] = f"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
k as ({' union all '.join(_secret_kind(*k) for k in _SECRET_KINDS)}),
m as (select doc_id, source, rank, kind, least, ms[i] as m, vs[i] as v,
    list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as s
  from (select *, unnest(range(1, len(ms) + 1)) as i from k)),
f as (select doc_id, source, rank, kind, s::bigint as s, (s + length(m))::bigint as e, v from m where length(v) >= least),
o as (select v, count(distinct doc_id) as repos, count(distinct source) as owners from f group by v),
c as (select f.*, owners >= 3 or repos >= 8 as copied,
    len(list_distinct(string_split(f.v, ''))) >= 8 and regexp_matches(f.v, '[0-9]')
      and not regexp_matches(f.v, '(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0123456|1234567|abcdef') as random
  from f join o on f.v = o.v),
g as (select doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access,
    count(*) filter (rank = 2) as n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < 3) as base,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans,
    count(*) filter (not copied and random) as n_live, count(*) filter (copied) as n_copied,
    count(*) filter (not copied and not random) as n_weak from c group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live,
  coalesce(n_copied, 0) as n_copied, coalesce(n_weak, 0) as n_weak
from d left join g on d.doc_id = g.doc_id"""

ORACLES["op9_histogram_sort"] = """
with t as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, range(8)),
    lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) as crcs),
d as (select doc_id, coalesce(text, '') as text, strlen(coalesce(text, '')) + 16 as size from documents),
h as (select doc_id, size, hex(encode(text)) as x from d),
b as (select doc_id, size, list_transform(regexp_extract_all(x, '..'), lambda y: ('0x' || y)::bigint) as bytes from h),
k as (select doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint, bytes),
    lambda c, v: xor(c >> 8, crcs[(xor(c, v) & 255) + 1])), 4294967295::bigint) as text_crc32 from b, t),
s as (select *, sum(size) over (order by doc_id) as upto from k),
total as (select sum(size) as b from k),
cuts as (select i, b * i // 320 as target from total, (select unnest(range(1, 320)) as i)),
low as (select i, target, (select coalesce(max(upto), 0) from s where upto < target) as l from cuts),
both_ as (select i, target, l, (select min(upto) from s where upto >= target) as h from low),
best as (select i, case when target - l <= h - target then l else h end as cut from both_),
shards as (select row_number() over (order by cut) as shard, cut from best where i % 8 = 0),
placed as (select s.*, (select count(*) from shards where cut < s.upto) as shard from s)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id) - 1 as slot,
  null as grown_shard from placed"""

ORACLES["op3_warc"] = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, p.payload_digest, case when page_id != first then 'revisit' else 'response' end as record_type,
  case when page_id != first then first end as refers_to
from p left join f on p.payload_digest = f.payload_digest and payload_bytes >= 100"""

ORACLES["op7_minhash"] = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: ws[i : i + 4])
    when len(ws) > 0 then [ws] else [] end) as shingle from w),
s as (select distinct doc_id, hash(shingle) as x, shingle from g),
n as (select doc_id, count(*) as n from s group by doc_id),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.shingle = b.shingle
  and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from both_ join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 85 * (p.n + q.n - c)),
two as (select a, b from links union all select b, a from links),
reach as (select doc_id as v, doc_id as r from documents union select two.a, reach.r from reach join two on reach.v = two.b),
low as (select v, min(r) as component_id from reach group by v)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join low on d.doc_id = v left join n on n.doc_id = d.doc_id"""

ORACLES["op4_multi_index"] = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
ok as (select * from v where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0
  and len(list_filter(e, lambda x: x != 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from ok a join ok b
  on a.vec_id != b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
n as (select a, count(*) as n from links group by a),
reach as (select vec_id as v, vec_id as r from v union select links.a, reach.r from reach join links on reach.v = links.b),
low as (select v, min(r) as component_id from reach group by v)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from v join low on low.v = vec_id left join n on n.a = vec_id"""

ORACLES["op6_temperature_mixing"] = r"""
with recursive d as (select doc_id, source, md5(coalesce(text, '')) as m,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as t from documents),
h as (select doc_id, source, t, ('0x' || md5(concat_ws('|', 'mix', coalesce(doc_id::text, 'null'), m))[1:15])::bigint as h from d),
s as (select source, sum(t) as t from h group by source),
total as (select sum(t) as b from s),
bisect(lo, hi) as (select -1, 262144 union all
  select case when r <= 1.25 then lo else mid end, case when r <= 1.25 then mid else hi end
  from (select lo, hi, (lo + hi) // 2 as mid, (select b from total) / sum(power(t, ((lo + hi) // 2) / 262144.0::double))
      * max(power(t, ((lo + hi) // 2) / 262144.0::double - 1)) as r
    from bisect, s where hi - lo > 1 and t > 0 group by lo, hi)),
alpha as (select min(hi) / 262144.0::double as alpha from bisect),
z as (select sum(power(t, alpha)) as z from s, alpha where t > 0),
p as (select source, t, greatest(1, ceil(t / 65536.0))::bigint as blocks, floor(power(t, alpha) / z * b)::bigint as budget
  from s, alpha, z, total),
q as (select source, blocks, case when t > 0 then budget // t else 1 end as whole, case when t > 0 then budget % t else 0 end as rest from p),
e as (select h.*, q.blocks, q.whole, q.rest, h.h % q.blocks as block,
    ('0x' || md5(concat_ws('|', 'mix', coalesce(h.source, 'null'), q.whole::text, (h.h % q.blocks)::text))[1:15])::bigint as place
  from h join q on h.source is not distinct from q.source),
b as (select source, block, place, rest, sum(t) as n from e group by all),
c as (select *, rest - coalesce(sum(n) over (partition by source order by place, block
    rows between unbounded preceding and 1 preceding), 0) as left_ from b),
ends as (select source, block, place, left_ from c where left_ > 0 and left_ <= n),
f as (select e.*, ends.block as end_block, ends.place as end_place, left_,
    case when e.block = ends.block then coalesce(sum(case when e.block = ends.block then e.t else 0 end) over (
      partition by e.source, e.block order by e.h range between unbounded preceding and 1 preceding), 0) end as before
  from e left join ends on e.source is not distinct from ends.source),
g as (select *, whole + case when place < end_place or (place = end_place and block < end_block)
    or (block = end_block and before < left_) then 1 else 0 end as copies from f),
x as (select *, unnest(range(copies::bigint)) as copy from g where copies > 0)
select doc_id, source, t as tokens, copy, block,
  ('0x' || md5(concat_ws('|', 'mix', coalesce(source, 'null'), copy::text, block::text))[1:15])::bigint as mix_key from x"""

ORACLES["op11_periodic_runs"] = r"""
with t as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, range(8)),
    lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) as crcs),
d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
    list_transform(string_split(doc_id::text, ''), lambda x: ord(x)::bigint) as bytes from documents),
h as (select doc_id, ws, len(ws) as n, xor(list_reduce(list_prepend(4294967295::bigint, bytes),
    lambda c, v: xor(c >> 8, crcs[(xor(c, v) & 255) + 1])), 4294967295::bigint) as h from d, t),
a as (select *, h // 10 as g, case when h % 10 = 0 and n > 0 then (h // 10) % n else n end as a from h),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
w as (select doc_id, n, list_transform(range(n), lambda i: case when i >= a then ws[1 + a + (i - a) % p] else ws[i + 1] end) as ws from p),
e as (select doc_id, n, unnest(ws) as word, unnest(range(n)) as i from w),
m as (select x.doc_id, y.i - x.i as q, y.i from e x join e y
  on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n),
o as (select *, i - row_number() over (partition by doc_id, q order by i) as island from m),
f as (select doc_id, q, min(i) - q as s, count(*) + q as len from o group by doc_id, q, island
  having count(*) + q >= greatest(6, 4 * q)),
r as (select doc_id, s, len, min(q) as q from f group by doc_id, s, len),
b as (select doc_id, count(*) as n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as listed,
    first({'s': s, 'len': len, 'q': q} order by len / q desc, s, q) as best from r group by doc_id),
gone as (select distinct doc_id, unnest(range(s + q, s + len)) as i from r),
k as (select e.doc_id, string_agg(word, ' ' order by e.i) as text from e left join gone
  on e.doc_id = gone.doc_id and e.i = gone.i where gone.i is null group by e.doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.len as length, best.q as period,
  1000 * best.len // best.q as exponent_milli, sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from d left join b on d.doc_id = b.doc_id left join k on d.doc_id = k.doc_id"""

ORACLES["op13_collocations"] = r"""
with d as (select coalesce(lang, 'und') as lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as ps
  from documents),
p as (select lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') as ws from d),
n as (select lang, sum(len(ws))::bigint as n from p group by lang),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) as phrase
  from p, (select unnest(range(1, 6)) as k) where len(ws) >= k),
f as (select lang, k, phrase, count(*)::bigint as f from g group by lang, k, phrase having count(*) >= 100),
c as (select lang, k, phrase, string_split(phrase, ' ') as ws, f as a from f where k > 1),
u as (select lang, phrase, ws, a, unnest(range(1, k)) as cut from c),
s as (select u.lang, u.phrase, a, cut, l.f as l, r.f as r, n, (1000::hugeint * a * n) // (l.f::hugeint * r.f) as score
  from u join f l on l.lang = u.lang and l.phrase = array_to_string(ws[1 : cut], ' ')
  join f r on r.lang = u.lang and r.phrase = array_to_string(ws[cut + 1 :], ' ') join n on n.lang = u.lang),
low as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
kept as (select * from low where not exists (select 1 from c where c.lang = low.lang and c.phrase != low.phrase
  and contains(' ' || c.phrase || ' ', ' ' || low.phrase || ' ') and 100 * c.a >= 100 * low.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked where rank <= 2000"""

# the pages of these tables have one layout; the operator knows nothing of it
ORACLES["op12_templates"] = r"""
with p as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) as a from pages),
b as (select page_id, url, unnest(regexp_split_to_array(a, '</?(?:h1|p)>')) as block, generate_subscripts(regexp_split_to_array(a, '</?(?:h1|p)>'), 1) as i from p),
t as (select page_id, url, i, trim(regexp_replace(regexp_replace(regexp_replace(block, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) as x from b),
d as (select page_id, url, i, replace(replace(replace(regexp_replace(replace(x, '&quot;', '"'), '&copy;', '©', 'g'), '&lt;', '<'), '&gt;', '>'), '&#39;', '''') as x from t),
e as (select page_id, url, i, regexp_replace(x, '&amp;?', '&', 'g') as x from d),
j as (select page_id, string_agg(x, chr(10) order by i) as text from e where x != '' group by page_id)
select p.page_id, p.url, coalesce(j.text, '') as text, length(coalesce(j.text, '')) as n_chars from p left join j on p.page_id = j.page_id"""
