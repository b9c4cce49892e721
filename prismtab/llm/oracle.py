"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

from prismtab.llm.substring import WINDOW

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING = f"""with d as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as s from d where len(w) >= {WINDOW}),
wins as (select doc_id, s, array_to_string(w[s:s + {WINDOW - 1}], ' ') as k from starts),
again as (select doc_id, s from wins qualify row_number() over (partition by k order by doc_id, s) > 1),
gone as (select distinct doc_id, unnest(range(s, s + {WINDOW})) as p from again),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from d),
kept as (select words.doc_id, string_agg(word, ' ' order by words.p) as t, count(*) as n from words anti join gone on gone.doc_id = words.doc_id and gone.p = words.p group by words.doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""

NEAR = f"""with recursive d as (select doc_id, {_WORDS.format(text=_LOWER)} as w from documents),
sets as (select doc_id, case when len(w) > 1 then list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) else w end as s from d),
cells as (select doc_id, len(s) as n, unnest(s) as x from sets),
links as (select a.doc_id as a, b.doc_id as b from cells a join cells b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
sym as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as c from documents union select sym.a, reach.c from reach join sym on sym.b = reach.a where reach.c < sym.a),
least as (select a, min(c) as c from reach group by a)
select sets.doc_id, len(s)::bigint as n_shingles, c as component_id, sets.doc_id = c as kept from sets join least on least.a = sets.doc_id"""

ORACLE_SQL = {"op5_substring_dedup": SUBSTRING, "op10_minhash_near_dedup": NEAR}
