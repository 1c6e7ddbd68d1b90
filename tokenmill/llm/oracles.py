"""SQL for the queries of this subpackage that SQL can express."""

from tokenmill.llm import filter_audit, phrases

_PHRASES = f"""with pieces as (
  select lang, unnest(regexp_split_to_array(body, '[.,;:!?\\x0A-\\x0D]')) as piece from (
    select coalesce(lang, 'und') as lang, translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents)),
words as (
  select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w
  from pieces),
places as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from words),
runs as (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase
  from places cross join (select unnest(range(1, {phrases.MAX_WORDS + 1})) as k)
  where i + k - 1 <= len(w)),
counts as (select lang, k, phrase, count(*) as f from runs group by all),
totals as (select lang, sum(f)::bigint as n from counts where k = 1 group by lang),
candidates as (
  select lang, k, phrase, f as a, string_split(phrase, ' ') as w from counts
  where k >= 2 and f >= {phrases.MIN_COUNT}),
cuts as (
  select c.lang, c.phrase, c.k, c.w, c.a, j, x.f as l, y.f as r,
    ({phrases.SCALE}::hugeint * c.a) // (x.f + y.f) as score
  from (select *, unnest(range(1, k)) as j from candidates) c
  join counts x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : j], ' ')
  join counts y on y.lang = c.lang and y.phrase = array_to_string(c.w[j + 1 : c.k], ' ')),
scored as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inner_parts as (
  select lang, a, array_to_string(w[i : i + m - 1], ' ') as phrase
  from (select *, unnest(range(1, k - m + 2)) as i
    from (select *, unnest(range(2, k)) as m from candidates))),
longest as (select lang, phrase, max(a) as most from inner_parts group by all),
ranked as (
  select s.*, row_number() over (partition by s.lang order by score desc, a desc, s.phrase) as rank
  from scored s left join longest o on o.lang = s.lang and o.phrase = s.phrase
  where o.most is null or 100::hugeint * o.most < {phrases.COVERED_PERCENT}::hugeint * s.a)
select r.lang, r.rank::bigint as rank, r.phrase, r.a, r.l, r.r, t.n, r.score::bigint as score
from ranked r join totals t on t.lang = r.lang where rank <= {phrases.TOP}"""

_AUDIT = f"""with texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
split as (
  select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from texts),
marks as (
  select doc_id, part,
    (len(w) < {filter_audit.MIN_WORDS})::int
    + 2 * (100 * len(list_distinct(w)) < {filter_audit.DISTINCT_PERCENT} * len(w))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g'))
      > {filter_audit.CAPITALS_PERCENT} * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as failed
  from split),
known as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic
  from labels group by doc_id),
counts as (
  select part, failed, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from marks left join known using (doc_id) group by part, failed),
letters as (select unnest(range(5)) as i),
orders as (
  select [a.i, b.i, c.i, d.i, e.i] as o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps as (
  select o, step, o[step] as i, list_sum(list_transform(o[1 : step - 1], lambda x: 1 << x)) as earlier
  from (select o, unnest(range(1, 6)) as step from orders)),
masks as (
  select array_to_string(list_transform(o, lambda x: chr((65 + x)::int)), '') as filter_order,
    step::int as step, 1 << i as own, coalesce(earlier, 0)::int as earlier from steps),
rows as (
  select part, filter_order, step, own,
    sum(n) filter (failed & (earlier | own) = 0) as kept,
    sum(n) filter (failed & own <> 0 and failed & earlier = 0) as removed,
    sum(n) filter (failed & own <> 0 and failed & earlier <> 0) as redundant,
    sum(n) filter (failed = own) as unique_fails,
    sum(good) filter (failed & own <> 0 and failed & earlier = 0) as good_lost,
    sum(toxic) filter (failed & own <> 0 and failed & earlier = 0) as toxic_lost
  from counts cross join masks group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept,
  coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost,
  coalesce(toxic_lost, 0)::bigint as toxic_lost,
  sum(coalesce(removed, 0)) over (partition by part, own)::bigint as shapley
from rows"""

ORACLES: dict[str, str] = {
    "op11_toivonen_phrases": _PHRASES,
    "op13_filter_potential": _AUDIT,
}
