"""SQL twins of the registered queries, for DuckDB."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
with d as (select doc_id, {WORDS} as w from documents),
win as (
  select doc_id, i, array_to_string(w[i : i + 19], ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
later as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as r from win) where r > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from later),
each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (
  select e.doc_id, string_agg(e.word, ' ' order by e.p) as t, count(*) as n
  from each e anti join gone g on e.doc_id = g.doc_id and e.p = g.p group by e.doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(k.n, 0) as bigint) as n_removed,
  sha256(coalesce(k.t, '')) as kept_sha256
from d left join kept k on d.doc_id = k.doc_id
"""

_RULES = rf"""
with d as (
  select doc_id, coalesce(text, '') as t, {WORDS} as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
win as (
  select doc_id, i, array_to_string(w[i : i + 7], ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as n from win) where n > 1),
covered as (
  select doc_id, count(*) as n from (select distinct doc_id, unnest(range(i, i + 8)) as p from again) group by doc_id),
m as (
  select d.doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(l) as n_lines,
    len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_stutter,
    length(regexp_replace(t, '[^!]+', '', 'g')) as n_ex, length(regexp_replace(t, '[^A-Z]+', '', 'g')) as n_cap,
    length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) as n_let
  from d left join covered c on d.doc_id = c.doc_id),
f as (
  select *, n_words < 20 as r0, 100 * n_repeat_words > 30 * n_words as r1, 100 * n_symbols > 25 * n_words as r2,
    n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines as r3,
    n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words) as r4,
    100 * n_ex > 50 * n_words as r5, n_let >= 100 and 100 * n_cap > 70 * n_let as r6, 100 * n_stutter > 30 * n_words as r7
  from m),
b as (
  select *, r0::bigint + 2 * r1::bigint + 4 * r2::bigint + 8 * r3::bigint + 16 * r4::bigint + 32 * r5::bigint
    + 64 * r6::bigint + 128 * r7::bigint as fail_bits from f)
"""

QUALITY_RULES = rf"""{_RULES}
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, r0 or r1 as base_failed, fail_bits = 0 as kept, fail_bits
from b
"""

RULE_ABLATION = rf"""{_RULES}
select bit, rule, count(*) filter (fail_bits // (1 << bit) % 2 = 1) as n_fail, count(*) filter (fail_bits = 1 << bit) as n_only
from b, (values (0, 'few_words'), (1, 'repeated_words'), (2, 'symbols'), (3, 'duplicate_lines'), (4, 'word_length'),
  (5, 'exclamations'), (6, 'capitals'), (7, 'stutter')) as v(bit, rule)
group by bit, rule
"""

_ESC = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"

_CHAT = rf"""
with recursive all_turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
n as (
  select *, row_number() over (partition by conv_id order by turn, role, text) as seq,
    len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) + 4 as tokens,
    length({_ESC.format("text")}) + length(replace({_ESC.format("role")}, chr(10), '\-')) + 24 as chars
  from all_turns),
s as (select *, seq = 1 and role = 'system' as is_system from n),
p as (
  select s.*, coalesce(y.tokens, 0) as system_tokens,
    sum(case when s.is_system then 0 else s.tokens end) over (partition by s.conv_id order by s.seq)
      - case when s.is_system then 0 else s.tokens end as before
  from s left join (select conv_id, tokens from s where is_system) y on s.conv_id = y.conv_id),
r as (
  select *, greatest(512 - system_tokens - 128, least(512 - system_tokens, 64)) as room,
    row_number() over (partition by conv_id order by seq) - max(is_system::int) over (partition by conv_id) as k
  from p),
g as (
  select conv_id, k, tokens as n, 0 as win from r where k = 1
  union all
  select r.conv_id, r.k, case when g.n + r.tokens <= r.room then g.n + r.tokens else r.tokens end,
    g.win + case when g.n + r.tokens <= r.room then 0 else 1 end
  from g join r on r.conv_id = g.conv_id and r.k = g.k + 1),
own as (select r.*, coalesce(g.win, 0) as win from r left join g on r.conv_id = g.conv_id and r.k = g.k),
starts as (
  select conv_id, win, min(case when not is_system then before end) as begin,
    least(128, 512 - max(system_tokens) - sum(case when is_system then 0 else tokens end)) as allowed
  from own group by conv_id, win)
"""

CHAT_FORMAT = rf"""{_CHAT},
chars as (
  select o.conv_id, sum(o.chars) as n from own o join starts w on o.conv_id = w.conv_id
    and (o.win = w.win or (w.win > o.win and (o.is_system or w.begin - o.before <= w.allowed))) group by o.conv_id),
told as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by seq) as said,
    coalesce(string_agg(text, '' order by seq) filter (role = 'assistant'), '') as learned
  from own group by conv_id)
select t.conv_id, cast(n_turns as bigint) as n_turns, sha256(said) as turns_sha256, cast(length(learned) as bigint) as loss_chars,
  sha256(learned) as loss_sha256, cast(c.n as bigint) as formatted_chars
from told t join chars c on t.conv_id = c.conv_id
"""

_PIECE = f"""'<|im_start|>' || replace({_ESC.format("o.role")}, chr(10), '\\-') || chr(10) || {_ESC.format("o.text")} || '<|im_end|>' || chr(10)"""

CHAT_WINDOWS = rf"""{_CHAT}
select o.conv_id, cast(w.win as bigint) as window, count(*) filter (o.win < w.win) as n_context, cast(sum(o.tokens) as bigint) as n_tokens,
  sha256(string_agg({_PIECE}, '' order by o.seq)) as formatted_sha256
from own o join starts w on o.conv_id = w.conv_id and (o.win = w.win or (w.win > o.win and (o.is_system or w.begin - o.before <= w.allowed)))
group by o.conv_id, w.win
"""

WARC = """
with p as (
  select page_id, url, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select *, case when n >= 100 then min(page_id) over (partition by d) else page_id end as first from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
  case when first = page_id then 'response' else 'revisit' end as record_type,
  case when first = page_id then null else first end as refers_to, url
from f
"""

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = rf"""
with recursive d as (select doc_id, regexp_extract_all({_AZ}, '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as sh from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as shared from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (select u, v from p join n x on u = x.doc_id join n y on v = y.doc_id where 100 * shared >= 80 * (x.n + y.n - shared)),
e as (select u, v from l union all select v, u from l),
r as (select u, v from e union select r.u, e.v from r join e on r.v = e.u),
c as (select u, min(v) as least from r group by u)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) as component_id
from d left join n on d.doc_id = n.doc_id left join c on d.doc_id = c.u
"""


def _places(phrase: str) -> str:
    words = ", ".join(f"'{w}'" for w in phrase.split())
    size = len(phrase.split())
    return f"list_filter(range(1, len(w) - {size - 2}), lambda i: w[i : i + {size - 1}] = [{words}])"


LICENSE_BASE = rf"""
with d as (select doc_id, regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select doc_id, len(w) as n, {_places("apache license version 2")} as a, {_places("cc by nc")} as c, {_places("under the mit license")} as m from d)
select doc_id, cast(n as bigint) as n_words, cast(len(a) + len(c) + len(m) as bigint) as n_base,
  list_min(a || c || m) - 1 as first_word, list_max(a || c || m) - 1 as last_word,
  array_to_string(list_filter([case when len(a) > 0 then 'apache-2' end, case when len(c) > 0 then 'cc-by-nc' end,
    case when len(m) > 0 then 'mit' end], lambda x: x is not null), ',') as base_labels
from p
"""

MIXING_TARGETS = rf"""
with d as (select doc_id, source, cast(len({WORDS}) as bigint) as size from documents),
s as (select source, sum(size) as n from d group by source),
k as (select source, n, 1.0::double + (row_number() over (order by source is null, encode(source)) - 1) % 3 as w from s),
o as (
  select *, row_number() over (order by n / w, w, source) as place,
    coalesce(sum(n) over (order by n / w, w, source rows between unbounded preceding and 1 preceding), 0) as fuller,
    sum(w) over (order by n / w, w, source rows between current row and unbounded following) as open_weight,
    sum(n) over () as total
  from k where n > 0),
u as (select (total::double - 3.0 * fuller) / open_weight as unit from o where w * ((total::double - 3.0 * fuller) / open_weight) <= 3.0 * n order by place limit 1)
select doc_id, size, cast(k.n as bigint) as source_size, case when k.n > 0 then least(k.w * u.unit, 3.0 * k.n) else 0.0 end::double as target
from d join k on d.source is not distinct from k.source left join u on true
"""


def _vector_codes(parts: int, entries: int, rounds: int) -> str:
    """Assign and average, round by round."""
    assign = """
a{r} as materialized (
  select n, j, q, arg_min(e, d * 256 + e) as e, min(d) as d from (
    select p.n, p.j, p.q, b.e, list_sum(list_transform(list_zip(p.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
    from p join b{r} b on p.j = b.j)
  group by n, j, q)"""
    average = """
b{s} as materialized (
  select b.j, b.e, coalesce(m.q, b.q) as q from b{r} b left join (
    select j, e, list(cast(floor(s / c) as bigint) order by k) as q from (
      select j, e, k, sum(x) as s, count(*) as c from (select j, e, unnest(q) as x, unnest(range(len(q))) as k from a{r}) group by j, e, k)
    group by j, e) m on b.j = m.j and b.e = m.e)"""
    steps = [t for r in range(rounds) for t in (assign.format(r=r), average.format(r=r, s=r + 1))]
    return f"""
with kept as materialized (
  select row_number() over (order by vec_id) as n, vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as materialized (
  select n, j, v[j * (len(v) // {parts}) + 1 : (j + 1) * (len(v) // {parts})] as q from (select n, v, unnest(range({parts})) as j from kept)),
b0 as materialized (select j, n - 1 as e, q from p where n <= {entries}),{",".join([*steps, assign.format(r=rounds)])},
each as (select n, string_agg(printf('%02x', cast(e as int)), '' order by j) as code, cast(sum(d) as bigint) as error from a{rounds} group by n),
books as (
  select sha256(string_agg(cast(x as varchar), ',' order by j, e, k)) as h
  from (select j, e, unnest(q) as x, unnest(range(len(q))) as k from b{rounds}))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select h from books) as codebooks_sha256
from each join kept using (n)
"""


VECTOR_CODES = _vector_codes(8, 16, 6)

#: Words one edit apart share the word without one letter: of one word, or of both at the same place.
SPELLING_VARIANTS = r"""
with recursive steps(i, k, c) as (
  select i, 0, i from range(256) t(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8),
crc as (select list(c order by i) as t from steps where k = 8),
runs as (
  select d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r, count(*) as n
  from (select coalesce(cast(doc_id as varchar), '') as d, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as r from documents)
  where length(r) >= 6 group by 1, 2),
sums as (
  select r, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(cast(length(hex(encode(d || ':' || r))) // 2 as int)),
      lambda j: cast('0x' || substr(hex(encode(d || ':' || r)), cast(2 * j + 1 as int), 2) as bigint))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) as h
  from runs, crc),
words as materialized (
  select word, cast(sum(n) as bigint) as n from (
    select case when h % 199 = 0 then substr(r, 1, cast(h % length(r) as int)) || substr(r, cast(h % length(r) as int) + 2) else r end as word, n from sums)
  where length(word) >= 6 group by word having sum(n) >= 5),
less as materialized (
  select word, p, substr(word, 1, cast(p as int)) || substr(word, cast(p as int) + 2) as s from (select word, unnest(range(length(word))) as p from words)),
near as materialized (
  select distinct a, b from (
    select x.word as a, y.word as b from less x join less y on x.s = y.s and x.p = y.p and x.word != y.word
    union all select l.word, w.word from less l join words w on l.s = w.word
    union all select w.word, l.word from less l join words w on l.s = w.word)),
best as materialized (
  select a as word, count(*) as n_near, first(b order by n desc, b) as near, max(n) as near_n
  from near join words on near.b = words.word group by a),
forms as materialized (
  select w.word, case when near_n >= 5 * n then near end as form, n, coalesce(n_near, 0) as n_near,
    case when near_n >= 5 * n then near_n end as form_n
  from words w left join best using (word)),
walk(word, node) as (
  select word, word from forms union all select walk.word, forms.form from walk join forms on walk.node = forms.word where forms.form is not null)
select f.word, f.form, walk.node as root, f.n, cast(f.n_near as bigint) as n_near, f.form_n
from walk join forms f using (word) join forms e on walk.node = e.word where e.form is null
"""
