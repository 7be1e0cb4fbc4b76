"""DuckDB twins of the queries that SQL can express on whole tables."""

from __future__ import annotations

CHAT = """select conv_id, turn, role, turn as at_turn, 0 as at_call, cast(json_object('content', text, 'role', role) as varchar) as message,
    0 as n_calls, 0 as n_invalid, cast(null as boolean) as linked from conversations"""

_H = "(ln(list_sum(list_transform(t, lambda x: pow(x, {m})))) - {m} * list_sum(list_transform(t, lambda x: pow(x, {m}) * ln(x))) / list_sum(list_transform(t, lambda x: pow(x, {m}))))"
_M, _R = "((elo + ehi) / 2)", "((rlo + rhi) / 2)"
_TARGET = "0.99 * ln(len(t))"
_SPREAD = "(list_max(t) / list_min(t))"
_BLOCK = "cast('0x' || substr(md5(concat_ws(':', '5', {0})), 1, 8) as bigint)"

MIX = f"""with recursive d as (select doc_id, source, coalesce('=' || source, '-') as ms, greatest(1, cast(ceil(coalesce(octet_length(encode(text)), 0) / 4.0) as bigint)) as tokens from documents),
    s as (select ms, sum(tokens)::double as tk from d group by 1), arr as (select list(tk order by tk) as t from s),
    b as (select 0 as i, 0.0::double as elo, 1.0::double as ehi, 0.0::double as rlo, 1.0::double as rhi, t from arr
        union all select i + 1, case when {_H.format(m=_M)} >= {_TARGET} then {_M} else elo end, case when {_H.format(m=_M)} >= {_TARGET} then ehi else {_M} end,
        case when pow({_SPREAD}, 1 - {_R}) <= 2 then rlo else {_R} end, case when pow({_SPREAD}, 1 - {_R}) <= 2 then {_R} else rhi end, t from b where i < 50),
    e as (select t, round(greatest(case when {_H.format(m='1.0')} >= {_TARGET} then 1.0 else elo end, case when {_SPREAD} <= 2 then 0.0 else rhi end), 9) as x from b where i = 50),
    w as (select ms, tk, round(pow(tk, x) / list_sum(list_transform(t, lambda y: pow(y, x))), 9) as weight, round(greatest(1.0, list_max(list_transform(t, lambda y: pow(y, 1 - x))) * pow(tk, x - 1)), 9) as repetition, greatest(64, cast(ceil(tk / 1000000) as bigint)) as blocks from s, e),
    r as (select d.*, weight, repetition, {_BLOCK.format('cast(doc_id as varchar)')} % blocks as block from d join w using (ms)),
    k as (select ms, block, sum(tokens)::double as bt from r group by all),
    p as (select k.*, w.tk, w.repetition, unnest(range(cast(ceil(repetition) as int)))::int as pass from k join w using (ms)),
    o as (select *, {_BLOCK.format("ms, cast(pass as varchar), cast(block as varchar)")} as place from p),
    q as (select *, row_number() over (partition by ms, pass order by place, block) - 1 as rank, sum(bt) over (partition by ms, pass order by place, block) as upto from o)
    select r.doc_id, r.source, r.tokens, r.weight, r.repetition, q.pass, r.block, q.rank as block_rank from r join q on r.ms = q.ms and r.block = q.block where q.upto - q.bt / 2 <= q.tk * least(1, q.repetition - q.pass)"""  # fmt: skip

_WORD = r"'[^\x20\x09-\x0D]+'"
_NORM = r"regexp_replace(lower(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '[\x20\x09-\x0D]+', ' ', 'g')"

QUALITY = f"""with d as (select row_number() over () as id, doc_id, coalesce('=' || source, '-') as host, coalesce(text, '') as text from documents),
    w as (select *, regexp_extract_all(text, {_WORD}) as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) as ls from d),
    win as (select id, unnest(range(1, len(ws) - 3)) as k, ws from w where len(ws) >= 5), h as (select id, k, concat_ws(chr(10), ws[k], ws[k + 1], ws[k + 2], ws[k + 3], ws[k + 4]) as g from win),
    dup as (select id, k from (select *, count(*) over (partition by id, g) as n from h) t where n > 1), cov as (select id, count(distinct k + j) as n from dup, (select unnest(range(5)) as j) o group by id),
    m as (select w.*, len(ws)::bigint as n_words, list_sum(list_transform(ws, lambda x: length(x)))::bigint as chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat from w left join cov using (id)),
    li as (select id, host, text, unnest(ls) as x from w), ln as (select id, host, text, {_NORM} as line, length(x) as chars from li),
    com as (select host, line from ln group by all having count(distinct id) > 10), rem as (select id, sum(chars)::bigint as chars from ln join com using (host, line) group by 1), tot as (select id, sum(chars)::bigint as chars from ln group by 1)
    select doc_id, n_words, coalesce(m.chars, 0) as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat as n_repeat_words, (n_words < 10 or 100 * n_repeat > 20 * n_words) as base_failed,
    not (n_words < 10 or 100 * n_repeat > 20 * n_words) and coalesce(tot.chars, 0) - coalesce(rem.chars, 0) >= 0.3 * coalesce(tot.chars, 0) as kept, coalesce(rem.chars, 0) as n_chars_removed from m left join rem using (id) left join tot using (id)"""  # fmt: skip

NEAR = f"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) as ws from documents),
    g as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 3), lambda k: concat_ws(' ', ws[k], ws[k + 1], ws[k + 2], ws[k + 3], ws[k + 4]))) end as gs from d),
    s as (select doc_id, len(gs)::bigint as n, unnest(gs) as x from g),
    e as (select a.doc_id as a, b.doc_id as b from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    both_ways as (select a, b from e union all select b, a from e),
    r as (select doc_id as node, doc_id as seen from documents union select r.node, w.b from r join both_ways w on r.seen = w.a)
    select g.doc_id, len(g.gs)::bigint as n_shingles, c.component_id, g.doc_id = c.component_id as kept from g join (select node, min(seen) as component_id from r group by node) c on c.node = g.doc_id"""  # fmt: skip

_CRC = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split({0}::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295)"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"case when {c} is null then '-' else octet_length(encode({c}::varchar)) || ':' || {c}::varchar end" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _levels(leaves: str, name: str) -> str:
    return f"""{name} as (select k, 0 as lv, i, h, (count(*) over (partition by k))::bigint as w from {leaves}
    union all (select k, lv + 1, i // 2, sha256(string_agg(h, '' order by i)), ((w + 1) // 2)::bigint from {name} where w > 1 group by k, lv, i // 2, w))"""


MERKLE = f"""with recursive d as (select doc_id, case when lang is null then '' else '=' || lang end as k, {_leaf('n_chars')} as leaf, case when {_CRC.format('doc_id')} % 7 = 0 then {_leaf('(n_chars + 1)')} else {_leaf('n_chars')} end as claim from documents),
    p as (select *, (row_number() over (partition by k order by doc_id nulls first, leaf) - 1)::bigint as i from d), pl as (select k, i, leaf as h from p),
    {_levels('pl','t')},
    s as (select k as own, h from t where w = 1), sl as (select 'all' as k, (row_number() over (order by own) - 1)::bigint as i, own, h from s),
    {_levels('sl','c')},
    steps as (select p.k, p.i as leaf_i, t.lv, (p.i >> t.lv) & 1 as odd, o.h from p join (select distinct k, lv from t where w > 1) t on t.k = p.k left join t o on o.k = p.k and o.lv = t.lv and o.i = xor(p.i >> t.lv, 1)
        union all select p.k, p.i, 1000 + t.lv, (sl.i >> t.lv) & 1, o.h from p join sl on sl.own = p.k cross join (select distinct lv from c where w > 1) t left join c o on o.lv = t.lv and o.i = xor(sl.i >> t.lv, 1)),
    ways as (select k, leaf_i, list(coalesce(h, '') order by lv) as hs, list(odd order by lv) as odds from steps group by 1, 2),
    q as (select p.*, coalesce(hs, []) as hs, coalesce(odds, []) as odds from p left join ways w on w.k = p.k and w.leaf_i = p.i)
    select doc_id, leaf, s.h as subroot, c.h as root, sha256(array_to_string(hs, '')) as proof_sha256,
    list_reduce(list_concat([claim], list_transform(range(1, len(hs) + 1), lambda j: odds[j] || hs[j])), lambda a, b: case when b[1] = '1' then sha256(b[2:] || a) else sha256(a || b[2:]) end) as folded_root,
    folded_root = c.h as verified from q join s on s.own = q.k, c where c.w = 1"""  # fmt: skip


def _codes() -> str:
    """Seven assignments and six updates, one common table each."""
    near = lambda r: f"select rn, j, min(list_sum(list_transform(range(1, w + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))::bigint * 16 + e) as m from p join c{r} c using (j) group by rn, j"
    steps = []
    for r in range(7):
        steps.append(f"a{r} as materialized ({near(r)})")
        if r < 6:
            means = f"select j, m % 16 as e, i, sum(x[i]) as s, count(*) as n from (select a.j, a.m, p.x, unnest(range(1, p.w + 1)) as i from a{r} a join p using (rn, j)) group by all"
            steps.append(f"u{r} as materialized (select j, e, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as x from ({means}) group by all), c{r + 1} as materialized (select c.j, c.e, coalesce(u.x, c.x) as x from c{r} c left join u{r} u using (j, e))")
    return f"""with k as materialized (select *, row_number() over (order by vec_id nulls last, embedding) as rn from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    v as materialized (select rn, len(embedding) // 8 as w, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as z from k),
    p as materialized (select rn, w, j, z[j * w + 1:j * w + w] as x from v, (select unnest(range(8)) as j) parts),
    c0 as materialized (select j, rn - 1 as e, x from p where rn <= 16), {", ".join(steps)},
    f as (select rn, string_agg(printf('%02x', (m % 16)::int), '' order by j) as code, sum(m // 16)::bigint as error from a6 group by rn),
    b as (select sha256(string_agg(t::varchar, ',' order by j, e, i)) as codebooks_sha256 from (select j, e, unnest(x) as t, unnest(range(len(x))) as i from c6))
    select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from k join f using (rn), b"""


CODES = _codes()

ORACLE_SQL = {"op1_minhash_near_dedup": NEAR, "op3_chat_format": CHAT, "op5_mix_sources": MIX, "op10_quality_rules": QUALITY, "op11_vector_codes": CODES, "op12_merkle_manifest": MERKLE}
