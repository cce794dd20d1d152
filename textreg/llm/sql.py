"""DuckDB twins of the queries."""

from __future__ import annotations

from textreg.llm import quality

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

NEAR_DUPLICATES = f"""
with recursive w as (
    select doc_id, coalesce({_WORDS.format(text=_LOWER)}, []) as ws from documents
), s as (
    select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as g
    from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) as i from w where len(ws) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id),
p as (
    select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id
    group by a.doc_id, b.doc_id
), e as (
    select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)
), b as (select x, y from e union all select y, x from e),
r as (select doc_id as u, doc_id as v from w union select r.u, b.y from r join b on r.v = b.x)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.m as component_id, c.m = w.doc_id as kept
from w left join n using (doc_id) join (select u, min(v) as m from r group by u) c on c.u = w.doc_id
"""

_ITEM_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

CONTAMINATION = f"""
with b as (select item_id, {_ITEM_WORDS} as ws from benchmark where item_id is not null),
bw as (
    select distinct item_id, least(13, len(ws)) as m, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') as g
    from (select item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as i from b where len(ws) > 0)
), d as (select doc_id, {_ITEM_WORDS} as ws from documents),
dw as (
    select doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') as g
    from (select doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) as i from d, (select distinct m from bw) where len(ws) >= m)
), f as (select doc_id, i, m, item_id from dw join bw using (m, g)),
h as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + m)) as p from f) group by doc_id),
t as (
    select doc_id, count(*) as n, string_agg(item, ',' order by item) as items
    from (select distinct doc_id, item_id::varchar as item from f) group by doc_id
)
select d.doc_id, len(ws)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(t.n, 0)::bigint as n_items,
    sha256(coalesce(t.items, '')) as items_sha256, coalesce(h.n, 0) > 0 and 20 * coalesce(h.n, 0) >= len(ws) as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""

_TESTS = [(rule, *spec[:2], c) for rule, spec in quality.RULES.items() for c in spec[2]]
_SHARE = quality.FALSE_REJECTION / len(quality.RULES)
_COUNTS = ", ".join(f"sum((1000 * {part} > {c} * {whole})::bigint)::bigint as k_{r}_{c}" for r, part, whole, c in _TESTS)
_TAIL = (
    "(select sum(exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({p}) + (n - j) * ln(1 - {p}))) "
    "from (select unnest(range(0, k_{r}_{c} + 1)) as j))"
)
_CUTS = ", ".join(
    "coalesce(" + ", ".join(
        f"case when k_{r}_{c} < n * {_SHARE} and {_TAIL.format(p=_SHARE, r=r, c=c)} "
        f"<= {quality.CONFIDENCE_GAP} / (strata * {len(_TESTS)}) then {c} end" for c in spec[2]
    ) + f", null) as cut_{r}" for r, spec in quality.RULES.items()
)
_PASSES = " and ".join(
    f"not coalesce(1000 * {part} > cut_{r} * {whole}, false)" for r, (part, whole, _) in quality.RULES.items()
)
QUALITY = f"""
with w as (
    select doc_id, lang, coalesce(text, '') as text, {_WORDS.format(text="coalesce(text, '')")} as ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
    from documents
), g as (
    select doc_id, i, hash(ws[i:i + 4]) as h from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)
), r as (
    select doc_id, count(distinct p) as n from (
        select doc_id, unnest(range(i, i + 5)) as p from g join (
            select doc_id, h from g group by doc_id, h having count(*) > 1
        ) using (doc_id, h)
    ) group by doc_id
), m as (
    select w.doc_id, lang, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
        len(ls)::bigint as n_lines
    from w left join r using (doc_id)
), b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m),
good as (select doc_id from labels where quality is not null group by doc_id having min(quality) = 1),
c as (select lang, count(*) as n, {_COUNTS} from b semi join good using (doc_id) where not base_failed group by lang),
t as (select lang, {_CUTS} from (select *, (select count(*) from c) as strata from c))
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and {_PASSES} as kept
from b left join t on b.lang is not distinct from t.lang
"""

LINES = r"""
with l as (
    select doc_id, i, ls[i] as line, regexp_matches(ls[i], '[^\x20\x09-\x0D]') as has_word
    from (select doc_id, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)
), m as (
    select *, has_word and row_number() over (partition by line order by doc_id, i) > 1 as gone from l
)
select d.doc_id, coalesce(sum(has_word::bigint), 0)::bigint as n_lines, coalesce(sum(gone::bigint), 0)::bigint as n_removed,
    case when any_value(d.text) is not null
        then coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '') end as kept_text
from documents d left join m on d.doc_id = m.doc_id group by d.doc_id
"""

ARCHIVES = """
with p as (
    select page_id, octet_length(encode(coalesce(html, '')))::bigint as n, sha1(coalesce(html, '')) as h from pages
), k as (select h, n, max(page_id) as m from p where n >= 1000 group by h, n)
select page_id, p.n as payload_bytes, p.h as payload_digest,
    case when m is null or m = page_id then 'response' else 'revisit' end as record_type,
    case when m != page_id then m end as refers_to
from p left join k on p.h = k.h and p.n = k.n
"""

HARD_NEGATIVES = """
with v as materialized (
    select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: coalesce(not isfinite(x), true))) = 0
), s as (
    select a.r, a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
        coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::bigint as score
    from v a join v b on a.r != b.r where a.vec_id % 100 = 0
), p as (
    select * from (select *, row_number() over (partition by r order by score desc, id) as k from s where same) where k <= 5
)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from (
    select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score,
        row_number() over (partition by p.r, p.k order by s.score desc, s.id) as rank
    from p join s on p.r = s.r and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
) where rank <= 10
"""
