"""DuckDB SQL for the rows of those queries that SQL can express, by the plainest way there is."""

from __future__ import annotations

from linkloom.llm import lm_score, mixing, quality_rules, secret_scan

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mix_sql(block: int = 32, seed: int = 7) -> str:
    """All quotients are listed and ranked; every document meets every block of its shard."""
    return f"""with d as (select doc_id, coalesce(source, '') as src, source is null as no_src, len({WORDS}) as size, md5('{seed}:' || doc_id) as place from documents),
s as (select no_src, src, sum(size)::bigint as source_size, row_number() over (order by no_src, src) as nth from d group by 1, 2),
c as (select *, [3.0, 1.0, 2.0][((nth - 1) % 3) + 1]::double as w, 2.0::double * source_size as cap, 1.5::double * sum(source_size) over () as wanted from s),
l as (select *, (wanted - coalesce(sum(cap) over o, 0)) / (sum(w) over () - coalesce(sum(w) over o, 0)) as level from c window o as (order by cap / w, nth rows between unbounded preceding and 1 preceding)),
t as (select *, least(cap, coalesce((select max(level) from l where level <= cap / w) * w, cap)) as target from l),
n as (select round(sum(target) / {block})::bigint as seats from t),
q as (select no_src, src, nth, target / (2 * k - 1) as q from t, n, unnest(range(1, seats + 1)) u(k) where target > 0),
a as (select no_src, src, count(*) as quota from (select *, row_number() over (order by q desc, nth) as r from q) x, n where r <= seats group by 1, 2),
g as (select least({mixing.MAX_SHARDS}, greatest(1, ceil(sum(size) / {mixing.SHARD_WORDS}.0)))::bigint as shards from d),
e as (select d.*, ('0x' || left(place, 8))::bigint % shards as shard from d, g),
p as (select no_src, src, shard, sum(size)::bigint as part from e group by 1, 2, 3),
pq as (select p.*, coalesce(quota, 0) as quota from p left join a using (no_src, src)),
y as (select no_src, src, shard, quota, part::double / (2 * k - 1) as q from pq, unnest(range(1, quota + 1)) u(k) where part > 0),
v as (select no_src, src, shard, count(*) as won from (select *, row_number() over (partition by no_src, src order by q desc, shard) as r from y) x where r <= quota group by 1, 2, 3),
b as (select pq.*, greatest(1, round(part / {block}.0))::bigint as blocks, coalesce(won, 0) as won0 from pq left join v using (no_src, src, shard)),
z as (select *, least(won0, 2 * blocks) as won, ('0x' || left(md5('{seed}:' || no_src || ':' || src || ':' || shard), 8))::bigint % blocks as start from b),
f as (select *, sum(size) over (partition by no_src, src, shard order by place, doc_id, size rows unbounded preceding)::bigint as stop from e)
select doc_id, size, source_size, target, case when size = 0 or won = 0 then 0 else coalesce(list_sum(list_transform(range(0, blocks), lambda j:
  greatest(0, least(stop, (j + 1) * part // blocks) - greatest(stop - size, j * part // blocks)) * (won // blocks + (j + 1 + start) * (won % blocks) // blocks - (j + start) * (won % blocks) // blocks))), 0) end::bigint as taken
from f join z using (no_src, src, shard) join t using (no_src, src)"""


def secret_sql() -> str:
    """Each rule's matches, placed by the lengths of what lies before them."""
    rows = []
    for k, r in enumerate(secret_scan.RULES):
        p = _quote(r.pattern)
        rows.append(f"""select doc_id, {k} as rule, '{r.kind}' as kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as start, length(ms[i]) as n, length(gs[i]) as g, {r.least} as least
from (select doc_id, string_split_regex(t, {p}) as gaps, regexp_extract_all(t, {p}) as ms, regexp_extract_all(t, {p}, {r.group}) as gs, unnest(range(1, len(regexp_extract_all(t, {p})) + 1)) as i from d)""")
    base = len(secret_scan.BASE)
    count = ", ".join(f"count(*) filter (rule = {k}) as n_{r.kind}" for k, r in enumerate(secret_scan.BASE))
    zero = ", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secret_scan.BASE)
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), m as ({' union all '.join(rows)}),
s as (select *, kind || ':' || start::bigint || ':' || (start + n)::bigint as span from m where g >= least),
a as (select doc_id, {count}, string_agg(span, ',' order by start, rule) filter (rule < {base}) as base, string_agg(span, ',' order by start, rule) as spans from s group by 1)
select doc_id, {zero}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents left join a using (doc_id)"""


def rules_sql() -> str:
    """Windows as joined strings, sketches as bucket counts of every group and of what it falls back on."""
    q = quality_rules
    symbols = f"length(regexp_replace(coalesce(text, ''), '[^{q.SYMBOLS}]', '', 'g'))"
    picks, limits, tests = [], [], []
    for r, above, below in q.RATES:
        picks.append(f"select lk, sk, '{r}' as rate, {r} as x from rated")
        limits.append(f"max(case when rate = '{r}' then q3 + {q.SPREAD} * (q3 - q1) + {above} end) as {r}_most")
        tests.append(f"{r} <= {r}_most")
        if below is not None:
            limits.append(f"max(case when rate = '{r}' then q1 - {q.SPREAD} * (q3 - q1) - {below} end) as {r}_least")
            tests.append(f"{r} >= {r}_least")

    def quartile(name: str, keys: str) -> str:
        k = keys + ", " if keys else ""
        return f"""{name}_u as (select {k}rate, bucket, sum(sum(n)) over (partition by {k}rate order by bucket) as upto, sum(sum(n)) over (partition by {k}rate) as docs from sketch group by {k}rate, bucket),
{name} as (select {k}rate, max(docs) as docs, min(case when upto >= 0.25 * docs then v end) as q1, min(case when upto >= 0.75 * docs then v end) as q3 from (select *, case when bucket = 0 then 0 else {q.FLOOR}::double * pow({q.WIDTH}::double, bucket) end as v from {name}_u) group by {k}rate)"""

    pick = lambda c: f"case when o.docs >= {q.LEAST_DOCS} then o.{c} when g.docs >= {q.LEAST_DOCS} then g.{c} else e.{c} end"
    return f"""with d as (select doc_id, coalesce('=' || lang, '') as lk, coalesce('=' || source, '') as sk, {WORDS} as w, {symbols} as n_symbols, coalesce(text, '') as t from documents),
win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d)),
rep as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 8)) as p from (select *, count(*) over (partition by doc_id, k) as c from win) where c > 1) group by 1),
lin as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1),
c as (select doc_id, lk, sk, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
 length(regexp_replace(t, '[^!?]', '', 'g')) as n_marks, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_stutter from d left join rep using (doc_id) left join lin using (doc_id)),
rated as (select *, case when n_words > 0 then n_symbols / n_words::double else 0 end as symbols, case when n_words > 0 then n_marks / n_words::double else 0 end as marks, case when word_chars > 0 then n_upper / word_chars::double else 0 end as upper,
 case when n_lines > 0 then n_dup_lines / n_lines::double else 0 end as dup_lines, case when n_words > 0 then n_stutter / n_words::double else 0 end as stutter, case when n_words > 0 then word_chars / n_words::double else 0 end as word_len from c),
sketch as (select lk, sk, rate, case when x <= {q.FLOOR} then 0 else least({q.MOST_BUCKETS}, ceil(ln(x / {q.FLOOR}::double) / ln({q.WIDTH}::double)))::int end as bucket, count(*) as n from ({' union all '.join(picks)}) group by 1, 2, 3, 4),
{quartile('own', 'lk, sk')}, {quartile('lan', 'lk')}, {quartile('eve', '')},
f as (select lk, sk, rate, {pick('q1')} as q1, {pick('q3')} as q3 from own o join lan g using (lk, rate) join eve e using (rate)),
lim as (select lk, sk, {', '.join(limits)} from f group by 1, 2),
j as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from rated join lim using (lk, sk))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {' and '.join(tests)} as kept from j"""


def lm_sql(least: int = lm_score.LEAST, backoff: float = lm_score.BACKOFF) -> str:
    """Each word's longest context by cases; counts of words, pairs and triples by plain aggregates."""
    return f"""with d as (select doc_id, row_number() over () as r, {WORDS} as w from documents),
u as (select r, unnest(w) as c, generate_subscripts(w, 1) as i from d),
p as (select *, lag(c) over l as b, lag(c, 2) over l as a from u window l as (partition by r order by i)),
n1 as (select c, count(*) as k from p group by 1), n2 as (select b, c, count(*) as k from p where b is not null group by 1, 2), n3 as (select a, b, c, count(*) as k from p where a is not null group by 1, 2, 3),
s as (select r, case when n3.k >= {least} then 0 when n2.k >= {least} then (p.a is not null)::int else (p.a is not null)::int + (p.b is not null)::int end as steps, coalesce(n2.k < {least}, true) as alone,
 case when n3.k >= {least} then ln(n3.k / ab.k::double) when n2.k >= {least} then ln(n2.k / b1.k::double) else ln(n1.k / (select count(*) from p)::double) end as v
 from p join n1 on n1.c = p.c left join n2 on n2.b = p.b and n2.c = p.c left join n3 on n3.a = p.a and n3.b = p.b and n3.c = p.c left join n2 ab on ab.b = p.a and ab.c = p.b left join n1 b1 on b1.c = p.b),
t as (select r, count(*) as n_words, count(*) filter (alone) as n_alone, sum(steps)::bigint as n_backoff, avg(v + steps * ln({backoff}::double)) as score from s group by 1)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_alone, 0) as n_alone, coalesce(n_backoff, 0) as n_backoff, round(coalesce(score, 0), 6) as score from d left join t using (r)"""


SQL = {"op3_mix_sources": mix_sql(), "op4_secret_scan": secret_sql(), "op7_lm_score": lm_sql(), "op10_quality_rules": rules_sql()}
