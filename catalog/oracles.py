"""The same results in SQL, for a single-node checker."""

from __future__ import annotations

from catalog.queries import (
    BATCH_ROWS,
    BLOCK,
    CHUNK,
    FIRST_ROWS,
    LENGTH_LIMITS,
    MAX_LEN,
    MERGES,
    PLANS,
    SEED,
    TEMPERATURE,
    TOKENS_PER_STEP,
    TOP_K,
    TRAIN_FRACTION,
    VAL_RATIO,
)
from tokenmill.functions.text import WHITESPACE
from tokenmill.operators.tokens import SEGMENT

FRACTION = f"{TRAIN_FRACTION}::double"
RATIO = f"{VAL_RATIO}::double"


def hashed(seed, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 15))::bigint"


def stripped(text: str) -> str:
    return f"trim({text}, '{WHITESPACE}')"


def cleaned(text: str) -> str:
    return stripped(f"replace({text}, chr(10), ' ')")


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def joined(ids: str) -> str:
    return f"md5(array_to_string({ids}, ','))"


LINES = f"""lines as (
  select doc_id, {cleaned('text')} as line from documents where text is not null and text <> '')"""
PLACED = """placed as (
  select doc_id, line || chr(10) as content, length(line) + 1 as n,
    (sum(length(line) + 1) over (order by doc_id) - length(line) - 1)::bigint as start
  from lines)"""
TOTAL = f"""total as (
  select sum(n)::bigint as n, floor(sum(n)::bigint * {FRACTION})::bigint as cut from placed)"""
CHARS = """chars as (
  select doc_id, start + generate_subscripts(a, 1) - 1 as p, unnest(a) as ch
  from (select doc_id, start, string_split(content, '') as a from placed))"""
VOCAB = """vocab as (
  select ch, (row_number() over (order by ch) - 1)::int as id
  from (select distinct ch from chars))"""
IDS = "ids as (select doc_id, p, id from chars join vocab using (ch))"
STREAM = (LINES, PLACED, TOTAL, CHARS)

TURNS = f"""turns as (
  select conv_id, turn, {stripped('text')} as content,
    case when lower({stripped('role')}) in ('assistant', 'bot', 'model', 'gpt') then 'Assistant'
         when lower({stripped('role')}) = 'system' then 'System' else 'Human' end as speaker
  from conversations where {stripped('text')} <> '')"""
EXAMPLES = """examples as (
  select conv_id,
    string_agg(case when back > 1 then speaker || ': ' || content end, chr(10) || chr(10)
               order by turn) || chr(10) || chr(10) || 'Assistant:' as prompt,
    max(case when back = 1 then content end) as response
  from (select *, row_number() over (partition by conv_id order by turn desc) as back from turns)
  group by conv_id
  having count(*) >= 2 and max(case when back = 1 then speaker end) = 'Assistant')"""
CHAT_VOCAB = """chat_vocab as (
  select ch, (row_number() over (order by ch) - 1)::int as id from (
    select distinct unnest(string_split(content, '')) as ch from turns
    union select unnest(string_split('Human: Assistant: System: ' || chr(10), ''))))"""
CUT_AND_MASK = (
    f"""trimmed as (
  select conv_id, p[1 + least(len(p), over_by):] as p,
    r[1 + over_by - least(len(p), over_by):] as r
  from (select *, greatest(len(p) + len(r) - {MAX_LEN}, 0) as over_by from coded))""",
    """rows_ as (
  select conv_id, len(p) + len(r) as n, list_concat(p, r) as ids,
    list_transform(range(1, len(p) + len(r) + 1), lambda i:
      case when i >= len(p) and i < len(p) + len(r) then list_concat(p, r)[i + 1]
           else -100 end) as labels
  from trimmed)""",
    """sft as (
  select conv_id, n, ids, labels, len(list_filter(labels, lambda x: x <> -100)) as supervised,
    (sum(n) over (order by conv_id) - n)::bigint as start
  from rows_)""",
)
SFT = (
    TURNS,
    EXAMPLES,
    CHAT_VOCAB,
    """coded as (
  select conv_id,
    list_transform(string_split(prompt, ''), lambda c: m[c]) as p,
    list_append(list_transform(string_split(response, ''), lambda c: m[c]), v) as r
  from examples, (select map(list(ch), list(id)) as m, count(*)::int as v from chat_vocab))""",
    *CUT_AND_MASK,
)
RAW_SPLIT = f"""raw as (
  select conv_id, row_number() over (order by {hashed(SEED, 'conv_id')}, conv_id) as r,
    count(*) over () as total
  from (select distinct conv_id from conversations)),
raw_split as (
  select conv_id, case when r <= least(greatest(floor(total * {FRACTION})::bigint, 1), total - 1)
    then 'train' else 'val' end as split
  from raw)"""
EXAMPLE_SPLIT = f"""example_split as (
  select conv_id, total, case when r <= greatest(1, floor(total * {RATIO})::bigint) then 'val'
    else 'train' end as split
  from (select conv_id, count(*) over () as total,
          row_number() over (order by {hashed(SEED, 'conv_id')}, conv_id) as r from examples))"""
LINE_SPLIT = f"""line_split as (
  select *, case when r <= greatest(1, floor(total * {RATIO})::bigint) then 'val' else 'train' end
    as split
  from (select doc_id, line, count(*) over () as total,
          row_number() over (order by {hashed(SEED, 'doc_id')}, doc_id) as r from lines))"""
LOG = """log as (
  select event_type as run, user_id as step, ts, event_id, value,
    case when event_id % 10 = 0 then 'val' else 'train' end as split,
    case when event_id % 10 = 0 then 'val/loss' else 'train/loss' end as metric
  from events)"""
LATEST = """latest as (
  select run, step, metric, event_id, value from (
    select *, row_number() over (
      partition by run, step, metric order by ts desc, event_id desc) as r
    from log) where r = 1)"""
SNAPSHOTS = """a as (select doc_id, (n_chars % 2)::bigint as shape from documents),
b as (select doc_id, quality::bigint as shape from labels)"""
PAIRS = """pairs as (
  select p, id as cur, lead(id) over (order by p) as next, cut, n
  from ids, total)"""
TRAIN_PAIRS = """train as (
  select cur, next, count(*) as n from pairs where p + 1 < cut group by cur, next)"""
PROBS = f"""probs as (
  select vec_id, i, e / sum(e) over (partition by vec_id) as p from (
    select vec_id, i, exp(s - max(s) over (partition by vec_id)) as e from (
      select vec_id, generate_subscripts(embedding, 1) - 1 as i,
        unnest(embedding)::double / {TEMPERATURE}::double as s from embeddings)))"""
UNIFORM = f"{hashed(SEED, 'vec_id')} / {float(1 << 60)}::double"


def windows(split: str, seed: int, rank: int, world: int, ids: bool = False) -> str:
    lo, hi = ("0", "cut") if split == "train" else ("cut", "n")
    slots = f"(hi - lo - {BLOCK} - {rank} + {world} - 1) // {world}"
    source, token, comma = ("ids", "id", ",") if ids else ("chars", "ch", "")
    return (
        with_(
            *STREAM,
            *((VOCAB, IDS) if ids else ()),
            f"bounds as (select {lo} as lo, {hi} as hi from total)",
            f"""draws as (
  select d, {hashed(seed + rank, 'd')} % ({slots}) * {world} + {rank} as start, lo
  from bounds, range(greatest((hi - lo) // 1024, 1)) as r(d))""",
            f"""wanted as (
  select d, start, o, lo + start + o as p from draws, range({BLOCK + 1}) as r(o))""",
            f"""found as (
  select d, start, o, {token} as t from wanted join {source} using (p))""",
        )
        + f"""select d // {2 * BATCH_ROWS} as step, d % {2 * BATCH_ROWS} // {BATCH_ROWS} as micro,
  d % {BATCH_ROWS} as row, start,
  md5(string_agg(case when o < {BLOCK} then t end, '{comma}' order by o)) as x_md5,
  md5(string_agg(case when o > 0 then t end, '{comma}' order by o)) as y_md5
from found group by d, start"""
    )


def epoch(ids: bool) -> str:
    source, token, comma = ("ids", "id", ",") if ids else ("chars", "ch", "")
    span = BATCH_ROWS * CHUNK
    return (
        with_(
            *STREAM,
            *((VOCAB, IDS) if ids else ()),
            f"""last as (
  select greatest(1, ceil((n - {span} - 1)::double / {span})::bigint) * {BATCH_ROWS} as chunks
  from total)""",
            f"""xs as (select p // {CHUNK} as c,
    md5(string_agg({token}, '{comma}' order by p)) as x_md5
  from {source} group by c)""",
            f"""ys as (select (p - 1) // {CHUNK} as c,
    md5(string_agg({token}, '{comma}' order by p)) as y_md5
  from {source} where p > 0 group by c)""",
        )
        + f"""select c // {BATCH_ROWS} as batch, c % {BATCH_ROWS} as row, x_md5, y_md5
from xs join ys using (c), last where c < chunks"""
    )


def merged(text: str) -> str:
    """The disjoint pairs as one private-use character each."""
    for i, pair in enumerate(MERGES):
        text = f"replace({text}, '{pair}', chr({0xE000 + i}))"
    return text


def codes(chars: str) -> str:
    """Each distinct character of a table of characters with its ids, joined by commas."""
    cases = " ".join(f"when ch = chr({0xE000 + i}) then '{256 + i}'" for i in range(len(MERGES)))
    return f"""codes as (
  select ch, case {cases} else array_to_string(list_transform(range(1, length(h), 2),
    lambda k: ('0x' || substr(h, k, 2))::int), ',') end as code
  from (select ch, hex(encode(ch)) as h from (select distinct ch from {chars})))"""


def byte_pairs() -> str:
    """Lines as ids: merged pairs, then bytes."""
    return f"""subchars as (
  select doc_id, generate_subscripts(a, 1) as i, unnest(a) as ch
  from (select doc_id, string_split({merged('content')}, '') as a from placed)),
{codes('subchars')},
subids as (
  select doc_id, i, code, len(string_split(code, ',')) as n from subchars join codes using (ch)),
subrows as (
  select doc_id, sum(n)::bigint as n, string_agg(code, ',' order by i) as ids
  from subids group by doc_id)"""


SUBWORD_SFT = (
    TURNS,
    EXAMPLES,
    f"""sides as (
  select conv_id, side, generate_subscripts(a, 1) as i, unnest(a) as ch from (
    select conv_id, 'p' as side, string_split({merged('prompt')}, '') as a from examples
    union all
    select conv_id, 'r', string_split({merged('response')}, '') from examples))""",
    codes("sides"),
    """sided as (
  select conv_id, side,
    list_transform(string_split(string_agg(code, ',' order by i), ','), lambda x: x::int) as ids
  from sides join codes using (ch) group by conv_id, side)""",
    f"""coded as (
  select a.conv_id, a.ids as p, list_append(b.ids, {256 + len(MERGES)}) as r
  from sided a join sided b on a.conv_id = b.conv_id and a.side = 'p' and b.side = 'r')""",
    *CUT_AND_MASK,
)


def plan_rows() -> str:
    return ", ".join(f"('{p}', {b}, {k}, {s})" for p, b, k, s in PLANS)


ROUND_OVER = ", ".join(
    f"round(avg((n > {x})::int::double), 6) as over_{x}" for x in LENGTH_LIMITS
)
LENGTH_STATS = f"""select count(*) as rows, min(n) as min_len, max(n) as max_len,
  round(avg(n), 6) as mean_len, round(quantile_cont(n, 0.5), 6) as p50,
  round(quantile_cont(n, 0.9), 6) as p90, round(quantile_cont(n, 0.95), 6) as p95,
  round(quantile_cont(n, 0.99), 6) as p99, {ROUND_OVER}
"""
MERGED = " ".join(
    f"- (length(t) - length(replace(t, '{pair}', ''))) // 2" for pair in MERGES
)  # each pair takes one id instead of two
EXAMPLE_BYTES = f"""sizes as (
  select (sum(strlen(t) {MERGED}) + 1)::bigint as n from (
    select conv_id, prompt as t from examples union all select conv_id, response from examples)
  group by conv_id)"""
RUNS = ("click", "error", "purchase", "signup", "view")
SWEEP = ", ".join(f"round(avg(value) filter (run = '{r}'), 6) as {r}" for r in RUNS)
DELTAS = ", ".join(
    f"round(avg(value) filter (run = '{r}') - avg(value) filter (run = 'click'), 6) as {r}_delta"
    for r in RUNS
    if r != "click"
)
RATES = f"""select run, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as batches,
  round(avg(value), 6) as mean_value,
  round(count(*) * {TOKENS_PER_STEP} / 86400.0::double, 6) as tokens_per_sec
from log group by run, date_trunc('day', ts)"""
CLEAN_LINES = with_(LINES) + "select doc_id, line from lines"
CHAT_EXAMPLES = with_(TURNS, EXAMPLES) + "select * from examples"
ADJACENT = (
    with_(
        """paired as (
  select conv_id, turn, role, text, lead(text) over w as reply, lead(role) over w as next_role
  from conversations window w as (partition by conv_id order by turn))"""
    )
    + f"""select conv_id, turn, {stripped('text')} as prompt, {stripped('reply')} as response
from paired
where lower(role) not in ('assistant', 'bot', 'model', 'gpt', 'system')
  and lower(next_role) in ('assistant', 'bot', 'model', 'gpt')
  and {stripped('text')} <> '' and {stripped('reply')} <> ''"""
)
METRICS = (
    with_(LOG) + "select run, step, event_id, split || '/loss' as metric, value from log"
)
LATEST_ROWS = with_(LOG, LATEST) + "select * from latest"

TOKEN_CACHE = (
    with_(*STREAM, VOCAB, IDS)
    + """select p // 1024 as chunk_id, count(*)::int as n,
  md5(string_agg(id, ',' order by p)) as ids_md5,
  (sum(count(*)) over ())::bigint as num_tokens
from ids group by p // 1024"""
)

LENIENT = (
    TURNS,
    EXAMPLES,
    RAW_SPLIT,
    f"""lenient as (
  select * from (
    select case split when 'train' then 'train' else 'test' end as split, prompt, response,
      row_number() over (partition by split order by conv_id) as r
    from examples join raw_split using (conv_id)) where r <= {FIRST_ROWS})""",
)

ORACLES = {
    "clean_lines": CLEAN_LINES,
    "clean_pages": f"""select page_id, length({cleaned('html')})::int as n,
  md5({cleaned('html')}) as line_md5 from pages where html is not null and html <> ''""",
    "first_n_lines": with_(LINES)
    + f"select doc_id, line from lines order by doc_id limit {FIRST_ROWS}",
    "shuffled_order": f"""select doc_id,
  row_number() over (order by {hashed(SEED, 'doc_id')}, doc_id) - 1 as rank from documents""",
    "text_round_trip": with_(LINES)
    + """select md5(line) as line_md5, count(*) as copies, max(length(line)) as n
from lines group by line""",
    "numbered_lines": with_(LINES)
    + "select row_number() over (order by doc_id) - 1 as row, md5(line) as line_md5 from lines",
    "whole_file": with_(LINES)
    + """select (sum(length(line)) + count(*))::bigint as chars, count(*) as newlines
from lines""",
    "split_summary": with_(LINES, LINE_SPLIT)
    + """select coalesce(split, 'total') as split, count(*) as rows
from line_split group by rollup (split)""",
    "split_files": with_(LINES)
    + f"""select split, written, md5(line) as line_md5, count(*) as copies from (
  select 'train' as split, line, count(*) over () as written from lines
  union all
  select 'validation', {cleaned('text')}, count(*) over () from benchmark
  where text is not null and text <> '')
group by split, written, line""",
    "export_summary": with_(LINES)
    + """select coalesce(split, 'total') as split, count(*) as rows from (
  select 'train' as split from lines
  union all select 'validation' from benchmark where text is not null and text <> '')
group by rollup (split)""",
    "export_manifest": with_(LINES)
    + """select 'both' as requested_split, split as actual_split, 'text' as text_field,
  'train,validation' as available_splits, count(*) as written_samples from (
  select 'train' as split from lines
  union all select 'validation' from benchmark where text is not null and text <> '')
group by split""",
    "export_manifest_fields": with_(*LENIENT)
    + f"""select 'conversations' as source, null::varchar as subset, 'both' as requested_split,
  split as actual_split, 'prompt_response' as format, 'prompt' as prompt_field,
  'response' as response_field, 'messages' as messages_field,
  {FIRST_ROWS}::bigint as max_samples, 'test,train' as available_splits,
  count(*) as written_samples from lenient group by split""",
    "export_lenient_split": with_(*LENIENT) + "select split, prompt, response from lenient",
    "export_local_split": with_(TURNS, EXAMPLES, EXAMPLE_SPLIT)
    + """select split, prompt, response, total as source_total,
  count(*) over (partition by split) as written
from example_split join examples using (conv_id)""",
    "example_split": with_(TURNS, EXAMPLES, EXAMPLE_SPLIT)
    + "select conv_id, split from example_split",
    "row_split": with_(RAW_SPLIT) + "select conv_id, split from raw_split",
    "split_members": with_(TURNS, EXAMPLES, RAW_SPLIT)
    + "select conv_id, split as side from examples join raw_split using (conv_id)",
    "chat_examples": CHAT_EXAMPLES,
    "chat_array_examples": CHAT_EXAMPLES,
    "json_text_examples": CHAT_EXAMPLES,
    "adjacent_pairs": ADJACENT,
    "jsonl_round_trip": with_(TURNS, EXAMPLES) + "select prompt, response from examples",
    "char_vocab": with_(*STREAM, VOCAB) + "select id, ch from vocab",
    "encoded_lines": with_(*STREAM, VOCAB, IDS)
    + """select doc_id, count(*)::int as n, md5(string_agg(id, ',' order by p)) as ids_md5
from ids group by doc_id""",
    "decode_round_trip": CLEAN_LINES,
    "subword_encode": with_(LINES, PLACED, byte_pairs())
    + "select doc_id, n::int as n, md5(ids) as ids_md5 from subrows",
    "subword_round_trip": CLEAN_LINES,
    "subword_positions": with_(LINES, PLACED, byte_pairs())
    + "select doc_id, (sum(n) over (order by doc_id) - n)::bigint as start, n from subrows",
    "subword_chunks": with_(
        LINES,
        PLACED,
        byte_pairs(),
        """sequence_ as (
  select row_number() over (order by doc_id, i, k) - 1 as p, id from (
    select doc_id, i, generate_subscripts(c, 1) as k, unnest(c) as id
    from (select doc_id, i, string_split(code, ',') as c from subids)))""",
    )
    + f"""select p // {CHUNK} as chunk_id, count(*)::int as n,
  md5(string_agg(id, ',' order by p)) as ids_md5
from sequence_ group by p // {CHUNK}""",
    "sft_examples": with_(*SFT)
    + f"""select conv_id, n::int as n_tokens, supervised::int as n_supervised,
  {joined('ids')} as ids_md5, {joined('labels')} as labels_md5 from sft""",
    "sft_subword_examples": with_(*SUBWORD_SFT)
    + f"""select conv_id, n::int as n_tokens, supervised::int as n_supervised,
  {joined('ids')} as ids_md5, {joined('labels')} as labels_md5 from sft""",
    "sft_padded": with_(*SFT)
    + f"""select conv_id,
  {joined(f'list_resize(ids, {MAX_LEN}, 0)')} as x_md5,
  {joined(f'list_resize(labels, {MAX_LEN}, -100)')} as y_md5 from sft""",
    "sft_offsets": with_(*SFT) + "select conv_id, start, n::int as length from sft",
    "sft_cache": with_(*SFT)
    + f"""select conv_id, start, n::int as length, {joined('ids')} as ids_md5,
  {joined('labels')} as labels_md5, true as reused, true as rebuilt,
  (sum(n) over ())::bigint as num_tokens
from sft""",
    "sft_split_caches": with_(
        *SFT,
        "numbered as (select *, row_number() over (order by conv_id) - 1 as row from sft)",
        f"""ranked as (
  select *, count(*) over () as total,
    row_number() over (order by {hashed(SEED, 'row')}, row) as r from numbered)""",
        f"""sides as (
  select *, case when r <= least(greatest(floor(total * {FRACTION})::bigint, 1), total - 1)
    then 'train' else 'val' end as split
  from ranked)""",
    )
    + f"""select split, row,
  (sum(n) over (partition by split order by row) - n)::bigint as start, n::int as length,
  {joined('ids')} as ids_md5, {joined('labels')} as labels_md5
from sides""",
    "sft_file_caches": with_(*SFT, RAW_SPLIT)
    + f"""select split, row_number() over w - 1 as row,
  (sum(n) over w - n)::bigint as start, n::int as length,
  {joined('ids')} as ids_md5, {joined('labels')} as labels_md5
from sft join raw_split using (conv_id) window w as (partition by split order by conv_id)""",
    "string_key_order": """select doc_id::varchar as name, row_number() over w - 1 as rank,
  (sum(length(text)) over w - length(text))::bigint as start
from documents window w as (order by doc_id::varchar)""",
    "sft_batches": with_(
        *SFT,
        "numbered as (select *, row_number() over (order by conv_id) - 1 as idx from sft)",
        f"""draws as (
  select d, {hashed(SEED, 'd')} % total as idx
  from (select count(*) as total from sft), range(4 * total) as r(d))""",
    )
    + f"""select d // {2 * BATCH_ROWS} as step, d % {2 * BATCH_ROWS} // {BATCH_ROWS} as micro,
  d % {BATCH_ROWS} as row, conv_id,
  {joined(f'list_resize(ids, {MAX_LEN}, 0)')} as x_md5,
  {joined(f'list_resize(labels, {MAX_LEN}, -100)')} as y_md5
from draws join numbered using (idx)""",
    "token_positions": with_(LINES, PLACED) + "select doc_id, start, n from placed",
    "token_chunks": with_(*STREAM)
    + f"""select p // {CHUNK} as chunk_id, count(*)::int as n,
  md5(string_agg(ch, '' order by p)) as content_md5
from chars group by p // {CHUNK}""",
    "token_cache": TOKEN_CACHE,
    "file_token_cache": TOKEN_CACHE,
    "position_split": with_(*STREAM)
    + """select split, doc_id, min(q) as start, count(*)::int as n,
  md5(string_agg(ch, '' order by q)) as content_md5
from (select doc_id, ch, case when p < cut then 'train' else 'val' end as split,
        case when p < cut then p else p - cut end as q from chars, total)
group by split, doc_id""",
    "split_token_counts": with_(*STREAM)
    + """select case when p < cut then 'train' else 'val' end as split,
  count(distinct doc_id) as rows, count(*) as tokens
from chars, total group by 1""",
    "train_windows": windows("train", SEED, 1, 3),
    "val_windows": windows("val", SEED, 0, 1),
    "sharded_starts": with_(LINES, PLACED, TOTAL)
    + f"""select d as draw, rank::int as rank,
  ('0x' || substr(md5(({SEED} + rank) || ':' || d), 1, 15))::bigint
    % ((n - {BLOCK} - rank + 2) // 3) * 3 + rank as start
from total, range(3) as a(rank), range(greatest(n // 1024, 1)) as b(d)""",
    "sequential_batches": epoch(ids=False),
    "cached_windows": windows("train", SEED, 0, 1, ids=True),
    "cached_epoch": epoch(ids=True),
    "flat_token_cache": TOKEN_CACHE,
    "bucketed_windows": windows("train", SEED, 0, 1, ids=True),
    "grown_token_cache": TOKEN_CACHE,
    "flat_windows": windows("train", SEED, 0, 1, ids=True),
    "flat_sft_cache": with_(*SFT)
    + f"""select row_number() over (order by conv_id) - 1 as index, start, n::int as length,
  {joined('ids')} as ids_md5, {joined('labels')} as labels_md5, (sum(n) over ())::bigint as num_tokens
from sft""",
    "context_tail": with_(LINES) + f"select doc_id, right(line, {BLOCK}) as tail from lines",
    "token_budget": with_(LINES, PLACED, TOTAL)
    + f"""select plan, cut as train_tokens, n - cut as val_tokens, n as dataset_tokens,
  (batch * block)::bigint as tokens_per_step, (batch * block * steps)::bigint as planned_tokens,
  round(batch * block * steps / cut::double * 100, 6) as coverage_percent,
  round(batch * block * steps / cut::double, 6) as epochs
from total, (values {plan_rows()}) as v(plan, batch, block, steps)""",
    "length_stats": with_(LINES, PLACED) + LENGTH_STATS + "from placed",
    "sft_length_stats": with_(TURNS, EXAMPLES, EXAMPLE_BYTES) + LENGTH_STATS + "from sizes",
    "supervised_stats": with_(*SFT, RAW_SPLIT)
    + """select split, count(*) as examples, sum(n)::bigint as tokens,
  sum(supervised)::bigint as supervised, round(sum(supervised) / sum(n)::double, 6) as ratio
from sft join raw_split using (conv_id) group by split""",
    "cached_supervised_stats": with_(*SFT, RAW_SPLIT)
    + """select split, count(*) as examples, sum(n)::bigint as tokens,
  sum(supervised)::bigint as supervised, round(sum(supervised) / sum(n)::double, 6) as ratio
from sft join raw_split using (conv_id) group by split""",
    "cached_length_stats": with_(*SFT) + LENGTH_STATS + "from sft",
    "vector_parity": """with d as (
  select vec_id, abs(x - round(x, 2)) as d
  from (select vec_id, unnest(embedding)::double as x from embeddings))
select count(distinct vec_id) as vectors,
  (select count(*) from embeddings) - count(distinct vec_id) as unmatched,
  round(max(d), 6) as max_abs_diff,
  round(avg(d), 6) as mean_abs_diff from d""",
    "match_rate": with_(
        *STREAM,
        """moved as (select doc_id, ch, row_number() over w as i, lead(ch) over w as next
  from (select chars.* from chars join placed using (doc_id) where p < start + n - 1)
  window w as (partition by doc_id order by p))""",
    )
    + """select count(*) filter (ch = next) as matches, count(*) as total,
  round(count(*) filter (ch = next) * 100.0 / count(*)::double, 6) as match_percent,
  0::bigint as unmatched
from moved where i > 8""",
    "snapshot_diff": with_(SNAPSHOTS)
    + """select coalesce(a.doc_id, b.doc_id) as doc_id, a.shape as left_shape,
  b.shape as right_shape, case when b.doc_id is null then 'only_left'
    when a.doc_id is null then 'only_right'
    when a.shape is not distinct from b.shape then 'same' else 'mismatch' end as status
from a full join b on a.doc_id = b.doc_id""",
    "digest_diff": with_(SNAPSHOTS)
    + """select coalesce(a.doc_id, b.doc_id) as doc_id, a.shape as left_shape,
  b.shape as right_shape, case when b.doc_id is null then 'only_left'
    when a.doc_id is null then 'only_right'
    when a.shape is not distinct from b.shape then 'same' else 'mismatch' end as status
from a full join b on a.doc_id = b.doc_id
where a.doc_id is null or b.doc_id is null or a.shape is distinct from b.shape""",
    "snapshot_counts": with_(SNAPSHOTS)
    + """select count(a.doc_id) as left_keys, count(b.doc_id) as right_keys,
  count(*) filter (a.doc_id is null) as missing, count(*) filter (b.doc_id is null) as extra,
  count(*) filter (a.doc_id = b.doc_id and a.shape is distinct from b.shape) as mismatched
from a full join b on a.doc_id = b.doc_id""",
    "one_sided_keys": with_(SNAPSHOTS)
    + """select doc_id, shape, 'left' as side from a where doc_id not in (select doc_id from b)
union all
select doc_id, shape, 'right' from b where doc_id not in (select doc_id from a)""",
    "softmax_topk": with_(PROBS)
    + f"""select vec_id, r::int as rank, i::int as index, round(p, 6) as prob
from (select *, row_number() over (partition by vec_id order by p desc, i) as r from probs)
where r <= {TOP_K}""",
    "argmax_scores": """select vec_id, arg_max(i, (x, -i))::int as choice
from (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding) as x
      from embeddings) group by vec_id""",
    "draw_topk": with_(
        PROBS,
        f"""kept as (select * from (select *,
    row_number() over (partition by vec_id order by p desc, i) as r from probs)
  where r <= {TOP_K})""",
        f"""mass as (select *, sum(p) over (partition by vec_id order by r) as below,
    sum(p) over (partition by vec_id) * ({UNIFORM}) as target from kept)""",
    )
    + """select vec_id, arg_min(i, r)::int as choice from mass where below > target
group by vec_id""",
    "draw_whole": with_(
        PROBS,
        f"""mass as (select *, sum(p) over (partition by vec_id order by i) as below,
    sum(p) over (partition by vec_id) * ({UNIFORM}) as target from probs)""",
    )
    + "select vec_id, min(i)::int as choice from mass where below > target group by vec_id",
    "blocked_softmax_topk": with_(PROBS)
    + f"""select vec_id, r::int as rank, i::int as index, round(p, 6) as prob
from (select *, row_number() over (partition by vec_id order by p desc, i) as r from probs)
where r <= {TOP_K}""",
    "blocked_argmax": """select vec_id, arg_max(i, (x, -i))::int as choice
from (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding) as x
      from embeddings) group by vec_id""",
    "blocked_draw_topk": with_(
        PROBS,
        f"""kept as (select * from (select *,
    row_number() over (partition by vec_id order by p desc, i) as r from probs)
  where r <= {TOP_K})""",
        f"""mass as (select *, sum(p) over (partition by vec_id order by r) as below,
    sum(p) over (partition by vec_id) * ({UNIFORM}) as target from kept)""",
    )
    + """select vec_id, arg_min(i, r)::int as choice from mass where below > target
group by vec_id""",
    "blocked_draw_whole": f"""select vec_id, arg_max(i, (s - ln(-ln(u)), -i))::int as choice from (
  select vec_id, i, e::double / {TEMPERATURE}::double as s,
    {hashed(SEED, "vec_id || ':' || i")} / {float(1 << 60)}::double + {0.5 / (1 << 60)!r}::double as u
  from (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding) as e
        from embeddings)) group by vec_id""",
    "log_append": METRICS,
    "log_latest": LATEST_ROWS,
    "log_interval": with_(LOG, LATEST)
    + """select run, step, metric, value
from (select *, max(step) over (partition by run) as last from latest)
where step % 10 = 0 or step = last""",
    "log_saved_steps": with_(LOG, LATEST)
    + """select run, step, metric, value
from (select *, max(step) over (partition by run) as last from latest)
where (step + 1) % 25 = 0 or step = last""",
    "log_tokens": with_(LOG)
    + f"""select run, step,
  (sum({TOKENS_PER_STEP}) over (partition by run order by step))::bigint as tokens_seen
from (select distinct run, step from log where split = 'train')""",
    "log_sweep_rows": with_(
        LOG, "means as (select step, run, avg(value) as value from log group by step, run)"
    )
    + """select means.step, means.run, round(means.value, 6) as value,
  round(means.value - base.value, 6) as delta
from means left join means as base on base.step = means.step and base.run = 'click'""",
    "log_loss": with_(LOG)
    + """select *, round(case when mean_loss < 20 then exp(mean_loss)
  else 'infinity'::double end, 3) as perplexity
from (select run, step, count(value) as batches, round(avg(value), 8) as mean_loss
      from log group by run, step)""",
    "log_split_losses": with_(LOG)
    + """select run, step, round(avg(value) filter (split = 'train'), 6) as train,
  round(avg(value) filter (split = 'val'), 6) as val
from log group by run, step""",
    "log_rates": with_(LOG) + RATES,
    "log_throughput": with_(LOG)
    + f"""select run, (count(*) * {TOKENS_PER_STEP})::bigint as tokens, round(s, 6) as seconds,
  round(count(*) * {TOKENS_PER_STEP} / greatest(s, 1e-9::double), 6) as tokens_per_sec
from (select run, (epoch_us(max(ts) over w) - epoch_us(min(ts) over w)) / 1e6::double as s
      from log window w as (partition by run))
group by run, s""",
    "log_generation": with_(LOG)
    + """select run, count(value) as tokens, round(sum(value), 6) as seconds,
  arg_min(value, (step, event_id)) as first_latency,
  round(count(value) / greatest(sum(value), 1e-9::double), 6) as tokens_per_sec
from log group by run""",
    "log_sweep": with_(LOG) + f"select step, {SWEEP}, {DELTAS} from log group by step",
    "next_token_counts": with_(*STREAM, VOCAB, IDS, PAIRS)
    + """select case when p < cut then 'train' else 'val' end as split, cur, next, count(*) as n
from pairs where next is not null and p + 1 <> cut group by 1, 2, 3""",
    "next_token_topk": with_(*STREAM, VOCAB, IDS, PAIRS, TRAIN_PAIRS)
    + """select cur, r::int as rank, next, n
from (select *, row_number() over (partition by cur order by n desc, next) as r from train)
where r <= 3""",
    "held_out_loss": with_(
        *STREAM,
        VOCAB,
        IDS,
        PAIRS,
        TRAIN_PAIRS,
        "curs as (select cur, sum(n) as cur_n from train group by cur)",
        """loss as (
  select count(*) as pairs, avg(-ln((coalesce(train.n, 0) + 1)::double
    / (coalesce(cur_n, 0) + (select count(*) from vocab)))) as mean_loss
  from pairs left join train using (cur, next) left join curs using (cur)
  where p >= cut and p + 1 < pairs.n)""",
    )
    + """select pairs, round(mean_loss, 6) as mean_loss, round(exp(mean_loss), 6) as perplexity
from loss""",
    "stream_clean": CLEAN_LINES,
    "stream_split": CLEAN_LINES,
    "stream_tokens": with_(*STREAM, VOCAB, IDS)
    + f"""select doc_id, ((p - start) // {SEGMENT})::int as seg, min(p) as start,
  count(*)::int as n, md5(string_agg(id, ',' order by p)) as ids_md5
from ids join placed using (doc_id) group by doc_id, (p - start) // {SEGMENT}""",
    "stream_chat": CHAT_EXAMPLES,
    "stream_pairs": ADJACENT,
    "stream_append": METRICS,
    "stream_latest": LATEST_ROWS,
    "stream_tokens_seen": with_(LOG)
    + f"""select run, step,
  (sum({TOKENS_PER_STEP}) over (partition by run order by step))::bigint as tokens_seen
from (select distinct run, step from log where split = 'train')""",
    "stream_rate": with_(LOG) + RATES,
}
