"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, line_dedup, mixing, pii, quality, simhash, token_counts, token_store, toxicity
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_decontaminate": lambda s, d: decontaminate.query(table(s, d, "documents"), table(s, d, "benchmark")),
        "op2_pii": lambda s, d: pii.query(table(s, d, "documents")),
        "op3_token_counts": lambda s, d: token_counts.query(table(s, d, "documents")),
        "op4_quality_rules": lambda s, d: quality.query(table(s, d, "documents")),
        "op5_simhash_dedup": lambda s, d: simhash.query(table(s, d, "documents")),
        "op6_chat_trees": lambda s, d: chat.query(table(s, d, "conversations")),
        "op7_mix_sources": lambda s, d: mixing.query(table(s, d, "documents")),
        "op8_toxicity": lambda s, d: toxicity.query(table(s, d, "documents"), table(s, d, "labels")),
        "op9_line_dedup": lambda s, d: line_dedup.query(table(s, d, "documents")),
        "op10_token_store": lambda s, d: token_store.query(table(s, d, "documents")),
        "pipeline": corpus_pipeline.run,
    }


#: Words, 3-word windows and lines of each text, and the rules on them.
QUALITY_SQL = r"""
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] k from (select doc_id, w, unnest(range(1, len(w) - 1)) i from d where len(w) >= 3)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, k) c from g) where c >= 2),
c as (select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from r) group by doc_id),
m as (select d.doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines, coalesce(c.n, 0) n_repeat_words,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) n_lower from d left join c on c.doc_id = d.doc_id),
b as (select *, len(lines) n_lines, len(lines) - len(list_distinct(lines)) n_dup_lines from m),
f as (select *, case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end + case when 10 * n_symbols > n_words then 4 else 0 end + case when 2 * n_dup_lines > n_lines then 8 else 0 end
  + case when n_words > 0 and (word_chars < 2 * n_words or word_chars > 12 * n_words) then 16 else 0 end + case when n_upper > n_lower and n_upper >= 20 then 32 else 0 end fail_bits from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 base_failed, fail_bits = 0 kept, cast(fail_bits as bigint) fail_bits from f
"""

#: All windows of items, met with all stretches of the documents of the same length.
CONTAMINATION_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
v as (select item_id, array_to_string(w[i : i + 9], ' ') k, 10 l from (select item_id, w, unnest(range(1, len(w) - 8)) i from b where len(w) >= 10) union all select item_id, array_to_string(w, ' '), len(w) from b where len(w) between 1 and 9),
s as (select doc_id, i, l, array_to_string(w[i : i + l - 1], ' ') k from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) i from d, (select distinct l from v) where len(w) >= l)),
h as (select doc_id, i, s.l, item_id from s join v on v.k = s.k and v.l = s.l),
p as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + l)) p from h) group by doc_id),
q as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from h group by doc_id)
select d.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, n_hit is not null contaminated from d left join p on p.doc_id = d.doc_id left join q on q.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": CONTAMINATION_SQL, "op4_quality_rules": QUALITY_SQL, "op6_chat_trees": chat.ORACLE}
