"""SQL counterparts, for DuckDB, of the queries that SQL can express."""

EXACT = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as h from documents
), g as (select h, min(doc_id) as keep_id, count(*) as group_size from d group by h),
m as (select quantile_disc(doc_id, 0.5) as middle from documents),
old as (select distinct h from d, m where doc_id <= middle)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, h as text_sha256, old.h is not null as seen_before
from d join g using (h) left join old using (h)
"""

#: The exponent is bisected on the same grid of millionths, one halving at a time.
MIXING = r"""
with recursive d as (
  select doc_id, source,
    greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1) as tokens
  from documents
), s as (
  select source, count(*) as docs, sum(tokens)::bigint as n from d group by source
), total as (
  select sum(n)::double as n, max(n)::double as most, min(n)::double as least, count(*) as k from s
), grid as (
  select 0 as a, 1000000 as b, 0 as step
  union all
  select case when ok then m else a end, case when ok then b else m end, step + 1
  from (
    select a, b, step, m, (
      select ln(sum(pow(s.n / total.n, m / 1e6))) - sum(pow(s.n / total.n, m / 1e6) * (m / 1e6) * ln(s.n / total.n))
        / sum(pow(s.n / total.n, m / 1e6)) >= 0.9 * ln(any_value(k)) - 1e-12
      from s, total) as ok
    from (select a, b, step, (a + b) // 2 as m from grid where b - a > 1)
  )
), natural_mix as (
  select k = 1 or -sum(s.n / total.n * ln(s.n / total.n)) >= 0.9 * ln(k) - 1e-12 as ok from s, total group by k
), wanted as (
  select case when ok then 1.0 else (select max(a) from grid) / 1e6 end as a from natural_mix
), low as (
  select coalesce(max(i) + 1, 0) / 1e6 as a from range(0, 1000000) r(i), total where pow(most / least, 1 - i / 1e6) > 4.0
), e as (
  select case when k = 1 then 1.0 else greatest(wanted.a, low.a) end as a from wanted, low, total
), w as (
  select s.source, s.docs, s.n, pow(s.n / total.n, e.a) / (select sum(pow(x.n / total.n, e.a)) from s x) as weight,
    floor(total.most * pow(s.n / total.most, e.a) + 1e-6)::bigint as budget
  from s, total, e
), copies as (
  select d.doc_id, d.source, d.tokens, w.weight, w.budget // w.n as blocks, w.budget % w.n as rest,
    unnest(range(1, 1 + (w.budget // w.n + (w.budget % w.n > 0)::int)::bigint)) as block
  from d join w on d.source is not distinct from w.source
), placed as (
  select *, row_number() over o - 1 as place, sum(tokens) over (o rows unbounded preceding) as upto
  from copies
  window o as (partition by source, block order by md5('7:' || block || ':' || doc_id), doc_id)
)
select doc_id, source, block::int as block, place, tokens::bigint as tokens, round(weight, 9) as weight
from placed where block <= blocks or upto <= rest
"""

LEXICAL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), filled as (select r, doc_id, terms, len(terms)::bigint as n from d where len(terms) > 0),
total as (select count(*)::bigint as docs, sum(n)::bigint as terms from filled),
wanted as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), said as (select r, unnest(terms) as term from filled),
times as (select r, term, count(*)::bigint as tf from said where term in (select term from wanted) group by all),
weights as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from times, total group by term, docs),
scored as (
  select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total.terms))))::bigint as score
  from wanted join times using (term) join weights using (term) join filled using (r), total group by item_id, r, doc_id
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scored where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
"""
