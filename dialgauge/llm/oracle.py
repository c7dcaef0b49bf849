"""SQL counterparts of the queries that SQL can express; the others are tested against brute force."""

FILTER_AUDIT = r"""
with docs as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as part from documents),
marks as (select doc_id, max(cast(coalesce(quality = 1, false) as int)) as good,
                 max(cast(coalesce(toxic = 1, false) as int)) as toxic from labels group by doc_id),
split as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by t) as first from docs),
failing as (
    select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
           cast(len(ws) < 200 as int) + 2 * cast(100 * len(list_distinct(ws)) < 50 * len(ws) as int)
           + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) as int)
           + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(coalesce(doc_id > first, false) as int) as fails
    from split left join marks using (doc_id)),
cells as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from failing group by part, fails),
letters(l, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
    select a.l || b.l || c.l || d.l || e.l as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
    from letters a, letters b, letters c, letters d, letters e where a.b + b.b + c.b + d.b + e.b = 31 and
         len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
steps as (
    select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as seen
    from orders, (select unnest(range(1, 6)) as step)),
runs as (
    select part, filter_order, step, bit,
           sum(case when fails & (seen | bit) = 0 then n else 0 end) as kept,
           sum(case when fails & seen = 0 and fails & bit <> 0 then n else 0 end) as removed,
           sum(case when fails & seen <> 0 and fails & bit <> 0 then n else 0 end) as redundant,
           sum(case when fails = bit then n else 0 end) as unique_fails,
           sum(case when fails & seen = 0 and fails & bit <> 0 then good else 0 end) as good_lost,
           sum(case when fails & seen = 0 and fails & bit <> 0 then toxic else 0 end) as toxic_lost
    from cells, steps group by part, filter_order, step, bit)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from runs
"""

PREFIX_TRIE = r"""
with ids as (select distinct conv_id from conversations where conv_id is not null),
crc as (
    select conv_id, xor(4294967295::bigint, list_reduce(
               list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: ascii(c)::bigint)),
               lambda state, byte: list_reduce(list_prepend(xor(state, byte), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
                   lambda s, zero: case when s % 2 = 1 then xor(s // 2, 3988292384::bigint) else s // 2 end))) % 9 as h
    from ids),
own as (
    select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, sha256(octet_length(encode(coalesce(role, '')))
           || ':' || coalesce(role, '') || coalesce(text, ''))) as turns
    from conversations where conv_id is not null group by conv_id),
built as (
    select o.conv_id, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) as turns
    from own o join crc using (conv_id) left join own b on b.conv_id = o.conv_id - o.conv_id % 5),
members as (
    select conv_id, turns[1:d] as prefix, d, len(turns) as n
    from (select *, unnest(range(0, len(turns) + 1)) as d from built)),
nodes as (
    select prefix, d, min(conv_id) as conv_id, count(*) as n_convs,
           sha256(coalesce(string_agg(conv_id, ',' order by conv_id) filter (where n = d), '')) as ends_sha256,
           case when d = 0 then 0 else octet_length(encode(prefix[d].t)) end * (count(*) - 1) as own_saved
    from members group by prefix, d),
children as (select prefix[1:d - 1] as prefix, count(*) as n_children from nodes where d > 0 group by prefix[1:d - 1]),
counted as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (prefix)),
above as (
    select prefix[1:k] as prefix, n_children, own_saved
    from (select *, unnest(range(0, d + 1)) as k from counted)),
sums as (
    select prefix, count(*) filter (where n_children = 0) as n_leaves, sum(own_saved) as saved_tokens from above group by prefix)
select c.conv_id, cast(c.d as bigint) as depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, n_leaves,
       cast(saved_tokens as bigint) as saved_tokens, c.ends_sha256
from counted c join sums using (prefix) left join counted p on c.d > 0 and p.prefix = c.prefix[1:c.d - 1]
"""

ORACLE: dict[str, str] = {"op11_filter_audit": FILTER_AUDIT, "op12_prefix_trie": PREFIX_TRIE}
