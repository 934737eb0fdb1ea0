"""DuckDB forms of the corpus queries that SQL can express."""

from __future__ import annotations

from fieldlab.llm import op1_quality as Q

_G, _S = repr(Q.GAMMA), repr(Q.SHIFT)
_SIZES = {"word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"),
          "repeats": ("n_repeat_words", "n_words"), "neighbours": ("n_neighbours", "n_words")}


def _figures() -> str:
    return " union all ".join(f"select r, lang, source, base_failed, '{f}' as figure, {x}::double / {n} as v, {n}::double / {Q.FIGURES[f] or 1} as n "
                              "from based where n_words > 0" for f, (x, n) in _SIZES.items())


def quality(spread: float = 2.0, prior: float = 10.0, sure: float = 2.0) -> str:
    at = lambda q: f"min(bucket) filter (cum > {q} * (total - 1))"
    value = lambda q: f"greatest(pow({_G}, {at(q)}) * {2 / (1 + Q.GAMMA)!r} - {_S}, 0.0)"
    tail = lambda x, y: f"greatest(list_sort([g.{y} - g.{x}, l.{y} - l.{x}, e.{y} - e.{x}])[2], least(g.q50 - g.q10, g.q90 - g.q50))"
    shrunk = lambda t, to: f"(({t}.total::double * {t}.q50 + {prior}::double * {to}) / ({t}.total::double + {prior}::double))"
    noise = f"({sure}::double / (2.0::double * sqrt(f.n)))"
    expected = f"(f.n * greatest(high, {Q.FLOOR}::double))"
    return f"""
with docs as materialized (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text from documents),
split as materialized (select *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from docs),
places as materialized (select r, i, array_to_string(w[i:i + 7], ' ') as win
    from (select r, w, unnest(generate_series(1, len(w) - 7)) as i from split where len(w) >= 8)),
again as (select r, win from places group by r, win having count(*) > 1),
hit as (select r, count(distinct i + o) as n from places join again using (r, win) cross join (select unnest(range(8)) as o) group by r),
counts as materialized (select s.r, doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(l) as n_lines,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(h.n, 0)::bigint as n_repeat_words,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_neighbours from split s left join hit h on s.r = h.r),
based as materialized (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counts),
figures as materialized ({_figures()}),
sketch as (select lang, source, figure, ceil(ln(v + {_S}) / ln({_G}))::int as bucket, count(*) as n from figures where not base_failed group by all),
merged as (select 0 as level, lang, source, figure, bucket, sum(n) as n from sketch group by all
    union all select 1, lang, null, figure, bucket, sum(n) from sketch group by all
    union all select 2, null, null, figure, bucket, sum(n) from sketch group by all),
run as (select *, sum(n) over (partition by level, lang, source, figure order by bucket) as cum,
    sum(n) over (partition by level, lang, source, figure) as total from merged),
tails as (select level, lang, source, figure, total, {value(0.1)} as q10, {value(0.5)} as q50, {value(0.9)} as q90
    from run group by level, lang, source, figure, total),
limits as (select g.lang, g.source, g.figure, {shrunk("g", shrunk("l", "e.q50"))} as center,
    center - {spread}::double * {tail("q10", "q50")} as low, center + {spread}::double * {tail("q50", "q90")} as high
    from tails g join tails l on l.level = 1 and l.figure = g.figure and l.lang is not distinct from g.lang
    join tails e on e.level = 2 and e.figure = g.figure where g.level = 0),
failures as (select r, string_agg(f.figure, ',' order by f.figure) as failed from figures f join limits t
    on t.figure = f.figure and t.lang is not distinct from f.lang and t.source is not distinct from f.source
    where case when f.figure = 'word_length' then v * (1 - {noise}) > high or v * (1 + {noise}) < low
    else v * f.n > {expected} + {sure * sure / 2}::double + {sure}::double * sqrt({expected} + {sure * sure / 4}::double) end group by r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and f.failed is null as kept, coalesce(f.failed, '') as failed
from based b left join failures f on b.r = f.r"""


EXACT = """
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
norm as (select r, doc_id, length(text) as chars, sha256(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as text_sha256 from docs),
best as (select text_sha256, count(*) as group_size, arg_min(struct_pack(r := r, doc_id := doc_id), (-chars, doc_id is null, doc_id, r)) as b
    from norm group by text_sha256)
select doc_id, b.doc_id as keep_id, group_size, n.r = b.r as kept, text_sha256 from norm n join best using (text_sha256)"""

SQL = {"op1_quality_rules": quality(), "op10_exact_dedup": EXACT}
