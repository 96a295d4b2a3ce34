"""The registry's queries in DuckDB's SQL."""

from __future__ import annotations


def words(column: str, table: str) -> str:
    return f"select lower(w) as term, count(*)::bigint as freq from (select unnest(regexp_extract_all({column}, '[A-Za-z]+')) as w from {table}) group by 1"


VOCABULARY = words("text", "documents")
BENCHMARK = words("text", "benchmark")
NOISY = """case length(term) % 4 when 0 then substr(term, 2, 1) || left(term, 1) || substr(term, 3) when 1 then left(term, 1) || substr(term, 3)
    when 2 then left(term, 1) || substr(term, 2, 1) || substr(term, 2, 1) || substr(term, 3) else 'x' || substr(term, 2) end"""
WORKLOAD = f"select distinct {NOISY} as query from ({BENCHMARK})"

CORPUS_PARSE = f"""
with lines as (select unnest(string_split(text, chr(10))) as v from documents union all select term || ' ' || freq from ({VOCABULARY})),
parts as (select string_split(v, ' ') as p from lines)
select p[1] as term, sum(try_cast(p[2] as bigint))::bigint as freq from parts
where len(p) = 2 and regexp_matches(p[2], '^[0-9]{{1,19}}$') and try_cast(p[2] as bigint) is not null and p[1] <> '' group by 1"""

ORDER_VIOLATIONS = """
with lists as (select item_id as list_id, unnest(range(len(w))) as pos, lower(unnest(w)) as term from (select item_id, regexp_extract_all(text, '[A-Za-z]+') as w from benchmark)),
pairs as (select *, lag(term) over (partition by list_id order by pos) as previous from lists)
select list_id, pos::bigint as pos, term, previous from pairs where term <= previous or term = ''"""

#: Steps of the edit matrix over pairs(pid, a, b); distances(pid, distance) has the results. To follow "with recursive pairs as ...".
OSA = """
steps(pid, a, b, i, p2, p1) as (
  select pid, a, b, 0, null::int[], list_transform(range(0, length(b) + 1), lambda x: x::int) from pairs
  union all
  select pid, a, b, i + 1, p1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, least(acc[j] + 1, p1[j + 1] + 1,
      p1[j] + (case when substr(a, i + 1, 1) = substr(b, j::int, 1) then 0 else 1 end),
      case when i >= 1 and j >= 2 and substr(a, i + 1, 1) = substr(b, j::int - 1, 1) and substr(a, i, 1) = substr(b, j::int, 1) then p2[j - 1] + 1 else 1000000 end)), [i + 1])
  from steps where i < length(a)),
distances as (select pid, p1[-1]::int as distance from steps where i = length(a))"""

LETTERS = "list_aggregate(list_transform(string_split({}, ''), lambda c: 1::bigint << (ascii(c) - 97)), 'bit_or')"


def _near(queries: str, dictionary: str, k: int) -> str:
    """Results of a lookup as found(query, term, freq, distance). The unrestricted distance bounds the wanted one from below.

    An edit changes at most two bits of a word's set of letters, which rules most pairs out at once.
    """
    return f"""
words as materialized (select *, {LETTERS.format("term")} as letters from ({dictionary})), wanted as materialized (select *, {LETTERS.format("query")} as own from ({queries})),
alike as materialized (select query, term, freq from wanted join words on abs(length(query) - length(term)) <= {k} and bit_count(xor(own, letters)) <= {2 * k}),
near as materialized (select query, term, freq, damerau_levenshtein(query, term) as least_distance from alike where damerau_levenshtein(query, term) <= {k}),
pairs as materialized (select row_number() over () as pid, query as a, term as b from near where least_distance > 1), {OSA},
found as materialized (
  select query, term, freq, least_distance::int as distance from near where least_distance <= 1
  union all
  select a, b, freq, distance from pairs join distances using (pid) join words on term = b where distance <= {k})"""


def lookup(k: int, dictionary: str = VOCABULARY, queries: str = WORKLOAD) -> str:
    return f"with recursive {_near(queries, dictionary, k)} select query, term, freq, distance from found"


SINGLE = lookup(3, VOCABULARY, "select unnest(['adventures', 'the', 'tion']) as query")
EXACT = f"select query, term, freq, 0::int as distance from ({WORKLOAD}) join ({VOCABULARY}) on query = term"
TOTALS = f"with recursive {_near(WORKLOAD, VOCABULARY, 3)} select k::int as k, (select count(*) from found where distance <= k)::bigint as total from unnest([0, 1, 2, 3]) as t(k)"
BEST = f"with recursive {_near(WORKLOAD, VOCABULARY, 1)} select query, term, freq, distance from found qualify row_number() over (partition by query order by distance, freq desc, term) = 1"


REPORT = f"""
with recursive {_near(WORKLOAD, VOCABULARY, 3)} select 'total' as part, k::int as k, null::varchar as term, (select count(*) from found where distance <= k)::bigint as n from unnest([0, 1, 2, 3]) as t(k)
union all select 'term', 3, term, freq from ({lookup(3, VOCABULARY, "select 'adventures' as query")})"""


def matched(how: str) -> str:
    return f"with recursive {_near(WORKLOAD, VOCABULARY, 1)} select query from wanted where {how} (select 1 from found where found.query = wanted.query)"


OSA_PAIRS = f"""
with recursive words as materialized (select term, {NOISY} as noisy from ({BENCHMARK})),
pairs as materialized (select row_number() over () as pid, noisy as a, term as b from words), {OSA}
select b as term, a as noisy, distance, case when distance <= 2 then distance end as within_2 from pairs join distances using (pid)"""

QUERY_PARSE = f"""
with recursive words as materialized (select term, {NOISY} as noisy from ({BENCHMARK})),
pairs as materialized (select row_number() over () as pid, noisy as a, term as b from words), {OSA},
lines as (select unnest(string_split(text, chr(10))) as v from conversations union all select a || ' ' || b || ' ' || distance from pairs join distances using (pid)),
parts as (select string_split_regex(v, '\\s') as p from lines)
select p[1] as noisy, p[2] as clean, p[3]::int as distance from parts where len(p) = 3 and regexp_matches(p[3], '^[0-9]{{1,9}}$')"""


def single_edits(cases: list[tuple[str, str, int, bool]]) -> str:
    rows = ", ".join(f"('{a}', '{b}', {k}, {str(e).lower()})" for a, b, k, e in cases)
    return f"""
with recursive cases as (select * from (values {rows}) as t(term, query, k, expected)),
pairs as materialized (select row_number() over () as pid, query as a, term as b from cases), {OSA}
select term, query, k, expected, term = query as match_0, distance <= k as match_k from cases join pairs on term = b and query = a join distances using (pid)"""


COMMON_PREFIX = f"""
with placed as (select term, lag(term) over (order by term) as previous from ({VOCABULARY}))
select term, previous, len(list_filter(range(1, least(length(term), length(previous)) + 1), lambda i: left(term, i::int) = left(previous, i::int)))::bigint as common
from placed where previous is not null"""


def automaton(select: str, dictionary: str = VOCABULARY) -> str:
    """select over nodes, states, edges, scores, topo, ranks, csr_nodes and csr_edges of a dictionary."""
    return f"""
with recursive words as materialized ({dictionary}),
cuts as materialized (select term, freq, i::int as pos, left(term, i::int) as prefix, substr(term, i::int + 1) as suffix from (select *, unnest(range(0, length(term) + 1)) as i from words)),
nodes as materialized (select prefix, md5(string_agg(suffix, '|' order by suffix)) as lang, bool_or(suffix = '') as is_terminal, count(*) as reachable, sum(freq) as weight from cuts group by prefix),
states as materialized (select lang, min({{'n': length(prefix), 'p': prefix}}).p as state, bool_or(is_terminal) as is_terminal, max(reachable) as reachable, max(length(prefix)) as level from nodes group by lang),
members as materialized (select prefix, state from nodes join states using (lang)),
edges as materialized (select p.state as src, right(c.prefix, 1) as label, c.state as dst, sum(n.weight) as weight from members c join nodes n using (prefix) join members p on p.prefix = left(c.prefix, -1) where c.prefix <> '' group by all),
own as materialized (select state, sum(length(bin(freq)) - 1)::bigint as own_score from words join members on prefix = term group by state),
scores as materialized (select states.state, coalesce(any_value(own.own_score), 0)::bigint as own_score, coalesce(sum(e.own_score), 0)::bigint as score
  from states left join own on own.state = states.state left join cuts on cuts.prefix = states.state left join members m on m.prefix = cuts.term left join own e on e.state = m.state group by states.state),
ranks as materialized (select term, freq, (row_number() over (order by path) - 1)::bigint as idx
  from (select term, any_value(freq) as freq, list({{'s': -score, 'c': right(cuts.prefix, 1)}} order by pos) as path from cuts join members using (prefix) join scores using (state) where pos > 0 group by term)),
near as materialized (select src, label, dst, d.level from edges join states s on s.state = src join states d on d.state = dst where s.level = d.level - 1),
keys(state, level, key) as (
  select '', 0, '' union all
  select dst, level, last.key || chr(-last.less) from (select dst, near.level, max({{'key': keys.key, 'less': -unicode(label)}}) as last from keys join near on src = keys.state and near.level = keys.level + 1 group by dst, near.level)),
topo as materialized (select state, level, (row_number() over (order by level, key) - 1)::bigint as order_id from keys),
csr_edges as materialized (select (row_number() over (order by s.order_id, score desc, label) - 1)::bigint as edge_id, s.order_id as src_order, d.order_id as dst_order, label, weight
  from edges join topo s on s.state = src join topo d on d.state = dst join scores on scores.state = dst),
degrees as (select order_id, is_terminal, reachable, count(src_order)::bigint as degree from topo join states using (state) left join csr_edges on src_order = order_id group by all),
csr_nodes as materialized (select order_id, (coalesce(sum(degree) over (order by order_id rows between unbounded preceding and 1 preceding), 0))::bigint as first_edge, degree, reachable, is_terminal from degrees)
{select}"""


def coarsened(select: str, near: str = "src", far: str = "dst", last: int = 9) -> str:
    """select over kept(c, src, dst), the graph after contraction with 1 to c parents (near, far swapped: children), and fixed(node).

    Each step of the recursion is the whole graph: contracted once more while a node has few enough parents, else as it is with the next c.
    """
    return automaton(f"""
select * from (with recursive first as materialized (select distinct src_order as src, dst_order as dst from csr_edges),
fixed as materialized (select 0::bigint as node union select dst from first where src = 0),
steps(i, c, stable, src, dst) as (
  select 0, 1, false, src, dst from first
  union all
  select * from (
    with now as (select * from steps),
    ready as (select {far} as node from now group by {far} having count(*) <= any_value(c) and {far} not in (select node from fixed)),
    blocked as (select distinct now.{far} as node from now join ready on now.{near} = ready.node),
    merged as (select node from ready where node not in (select node from blocked)),
    parents as (select now.{far} as node, now.{near} as a from now join merged on now.{far} = merged.node),
    beyond as (select now.{near} as node, now.{far} as b from now join merged on now.{near} = merged.node),
    next as (select src, dst from now where src not in (select node from merged) and dst not in (select node from merged)
      union select {"a, b" if near == "src" else "b, a"} from parents join beyond using (node) where a <> b)
    select i + 1, c + 1, true, src, dst from now where c <= {last} and not exists (select 1 from ready)
    union all
    select m.i + 1, m.c, false, next.src, next.dst from next, (select any_value(i) as i, any_value(c) as c from now) m where exists (select 1 from ready))),
kept as materialized (select c - 1 as c, src, dst from steps where stable)
{select})""")


COARSE_SIZES = """select t.c::int as coarse, (select count(*) from (select src from kept where kept.c = t.c union select dst from kept where kept.c = t.c union select node from fixed))::bigint as n_nodes,
    (select count(*) from kept where kept.c = t.c)::bigint as n_edges from unnest(range(1, 10)) as t(c)"""
COARSE_LINKS = """select '{"source":' || src || ',"target":' || dst || '}' as json from kept where c = 1"""

CODEC = f"""select distinct freq, (1 + floor((length(bin(freq)) - 1) / 7))::bigint as unsigned,
(case when length(bin(freq)) <= 6 then 1 else 1 + ceil((length(bin(freq)) - 6) / 7) end)::bigint as signed, freq as unsigned_back, -freq as signed_back from ({VOCABULARY})"""

def packed(x: str, last_bits: int = 7, sign: str = "0", at: str = "i") -> str:
    """A number from 0 on as a variable-length number in hexadecimal digits: groups of seven bits, the least first, all but the last with 128 added.

    A signed number's last byte holds six bits and the sign. at: a name that isn't a column's.
    """
    n = f"greatest(1, 1 + (length(bin({x})) - {last_bits} + 6) // 7)"
    byte = f"(({x} >> (7 * {at})) & 127) + case when {at} < {n} - 1 then 128 else {sign} end"
    return f"list_aggregate(list_transform(range(0, {n}), lambda {at}: lpad(lower(to_hex(({byte})::bigint)), 2, '0')), 'string_agg', '')"


CODEC_ARRAYS = f"""
with words as (select left(term, 2) || length(term) as block, term, freq, row_number() over (partition by left(term, 2), length(term) order by term) as place from ({VOCABULARY})),
digits as (select block, term, place, {packed("freq")} as u, {packed("freq", 6, "case when place % 2 = 0 then 64 else 0 end")} as s from words),
blocks as (select block, count(*) as n, string_agg(u, '' order by place) as u, string_agg(s, '' order by place) as s, string_agg(term, '' order by place) as t from digits group by block)
select block, md5(unhex({packed("n")} || u)) as unsigned, md5(unhex({packed("n")} || s)) as signed, md5(unhex({packed("n")} || u)) as ascending,
    md5(unhex({packed("length(t)")} || {packed("length(t)")} || lower(hex(t)))) as text, true as back from blocks"""

MATH = """
select o_orderkey, greatest(o_orderkey - o_custkey, 0)::bigint as positive, abs(o_orderkey - o_custkey)::bigint as absolute, least(o_orderkey, o_custkey)::bigint as smaller,
((o_orderkey >> 5) | ((o_orderkey & 31) << 27))::bigint as rotated, ((o_orderkey >> 48) | case when (o_orderkey & 65535) >= 32768 then ((o_orderkey & 65535) - 65536) * 281474976710656 else (o_orderkey & 65535) * 281474976710656 end)::bigint as swapped from orders"""
