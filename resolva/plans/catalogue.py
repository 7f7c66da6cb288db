"""All queries of the library by name, with their SQL for DuckDB. Doubles are rounded to six places on both sides, lists are
joined to strings, and every ranking has a total order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import blocking, catalog, decide, features, metrics, mining, models, retrieval, splits, validate
from ..sources import tables
from ..sources.staging import stage
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def joined(c: str) -> Column:
    return F.array_join(c, "|")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def view(*columns: str) -> Query:
    """The named view columns of every record; lists joined."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        v = X.views(spark, sf)
        kinds = dict(v.dtypes)
        return v.select("id", *[joined(c).alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns])

    return run


def view_sql(*columns: str, lists: tuple[str, ...] = ()) -> str:
    return f"with {X.VIEWS} select id, " + ", ".join(f"array_to_string({c}, '|') {c}" if c in lists else c for c in columns) + " from v"


# ---- sources and subsets


@query("q01_source_scan_fill", f"with {X.ENT} select entity_id, business_name, business_address, country from ent")
def _(spark, sf):
    return tables.fill_records(X.entity_view(spark, sf))


@query("q02_truth_explode", f"with {X.TRUTH} select sid, tid from truth")
def _(spark, sf):
    pairs = X.truth(spark, sf)
    wire = X.entities(spark, sf).join(pairs.groupBy("sid").agg(F.array_join(F.array_sort(F.collect_set("tid")), ", ").alias("m")), "sid", "left")
    return tables.truth_pairs(wire.select(F.col("sid").alias("source1_entity_id"), F.col("m").alias("matched_entity_ids")))


@query("q03_benchmark_subset", f"""with {X.TRUTH},
c as (select entity_id from ent where entity_id like 'S1-%' order by entity_id limit 50), tr as (select distinct tid from truth where sid in (select entity_id from c)),
o as (select entity_id, row_number() over (partition by split_part(entity_id, '-', 1) order by entity_id) place from ent where entity_id not like 'S1-%' and entity_id not in (select tid from tr))
select entity_id, 'entity' as part from c union all select tid, 'target' from tr union all select entity_id, 'target' from o where place <= 100""")
def _(spark, sf):
    ent = X.entity_view(spark, sf).select("entity_id")
    chosen, pool = tables.benchmark_subset(ent.where("entity_id like 'S1-%'"), ent.where("entity_id not like 'S1-%'"), X.truth(spark, sf), 50, 4)
    return chosen.withColumn("part", F.lit("entity")).unionByName(pool.withColumn("part", F.lit("target")))


# ---- text and views

QUERIES["q04_clean_basic"], SQL["q04_clean_basic"] = view("n_clean", "a_clean", "n_compact"), view_sql("n_clean", "a_clean", "n_compact")
QUERIES["q05_legal_strip"], SQL["q05_legal_strip"] = view("n_legal"), view_sql("n_legal")
QUERIES["q08_acronym"], SQL["q08_acronym"] = view("n_acronym", "n_first_two", "n_first", "n_last", "n_prefix", "n_suffix"), view_sql("n_acronym", "n_first_two", "n_first", "n_last", "n_prefix", "n_suffix")
QUERIES["q09_sorted_tokens"], SQL["q09_sorted_tokens"] = view("n_sorted"), view_sql("n_sorted")
QUERIES["q11_numbers_postal"], SQL["q11_numbers_postal"] = view("a_numbers", "a_postal", "a_num", "a_zip", "a_digits", "n_numbers"), view_sql("a_numbers", "a_postal", "a_num", "a_zip", "a_digits", "n_numbers", lists=("a_numbers", "a_postal", "a_digits", "n_numbers"))
QUERIES["q12_address_norm"], SQL["q12_address_norm"] = view("a_norm"), view_sql("a_norm")
QUERIES["q13_salient"], SQL["q13_salient"] = view("a_salient", "a_sal", "a_sal2"), view_sql("a_salient", "a_sal", "a_sal2", lists=("a_salient",))


@query("q06_expand_abbrev", f"with {X.VIEWS} select id, array_to_string(list_transform(n_tokens, lambda x: coalesce({X._ABBREV}[x], x)), ' ') n_expanded from v")
def _(spark, sf):
    return X.views(spark, sf).select("id", "n_expanded")


@query("q07_dba", r"""with n as (select c_custkey k, case when c_custkey % 3 = 0 then c_name || ' d/b/a Shop ' || c_custkey when c_custkey % 3 = 1 then c_name || ' T/A: Store' else c_name end as name from customer)
select k, case when regexp_extract(name, '(?i)\b(?:d\s*/?\s*b\s*/?\s*a|t\s*/?\s*a)\b[:\s]*(.+)', 1) <> '' then trim(regexp_extract(name, '(?i)\b(?:d\s*/?\s*b\s*/?\s*a|t\s*/?\s*a)\b[:\s]*(.+)', 1)) else name end as dba from n""")
def _(spark, sf):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat("c_name", F.lit(" d/b/a Shop "), k.cast("string"))).when(k % 3 == 1, F.concat("c_name", F.lit(" T/A: Store"))).otherwise(F.col("c_name"))
    return X.table(spark, sf, "customer").select(k.alias("k"), T.dba(name).alias("dba"))


@query("q10_char_3grams", f"with {X.VIEWS} select id, array_to_string(list_sort(n_grams3), '|') n_grams3, len(n_grams4) n4, len(a_grams3) a3 from v")
def _(spark, sf):
    return X.views(spark, sf).select("id", F.array_join(F.array_sort("n_grams3"), "|").alias("n_grams3"), F.size("n_grams4").cast("long").alias("n4"), F.size("a_grams3").cast("long").alias("a3"))


@query("q14_condensed_url", r"""select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), 'https?://(?:www\.)?', '', 'g'), '\.(com|org|net|in|co|io|biz|info|gov)\b', '', 'g'), '^[@#*]+', ''), '[^\p{L}\p{N}]+', '', 'g') condensed from pages""")
def _(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", T.condensed(F.col("url")).alias("condensed"))


_INDIC = ["सोलर सॉल्यूशंस", "कमल", "நிலா", "తెలుగు", "দোকান ABC 12", "plain", "", "राजा​‍जी ।", "कककक ल्ल"]


@query("q15_romanize", "select * from (values (0, 'solr slyushms'), (1, 'kml'), (2, 'nila'), (3, 'telugu'), (4, 'dokan ABC 12'), (5, 'plain'), (6, ''), (7, 'raja​ji '), (8, 'kk ll')) t(k, romanized)")
def _(spark, sf):
    return spark.createDataFrame(list(enumerate(_INDIC)), "k int, name string").select("k", T.romanize(F.col("name")).alias("romanized"))


# ---- blocking

_FREQ = "tf as (select country, token, count(*) n from (select country, unnest(n_tokens) token from t) where length(token) >= 4 group by all)"


@query("q16_token_freq", f"with {X.VIEWS}, {_FREQ} select country, token, n from tf")
def _(spark, sf):
    return blocking.token_frequency(X.sides(spark, sf)[1])


def _product(a: str, b: str) -> str:
    return f"flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: x || '|' || y)))"


_KEYS = f"""
pre as (select *, case when len(a_digits) >= 2 then array_to_string(list_sort(a_digits[1:2]), '|') else '' end pair,
  case when len(n_tokens) >= 2 and length(n_tokens[1]) >= 3 and length(n_tokens[2]) >= 3 then least(substr(n_tokens[1], 1, 3), substr(n_tokens[2], 1, 3)) || '|' || greatest(substr(n_tokens[1], 1, 3), substr(n_tokens[2], 1, 3)) else '' end prefixes from v),
sp as (select id, country, least(a_salient[cast(i as integer)], a_salient[cast(j as integer)]) || '|' || greatest(a_salient[cast(i as integer)], a_salient[cast(j as integer)]) k from v, range(1, 5) a(i), range(2, 6) b(j) where i < j and j <= len(a_salient)),
k0 as (
  select id, country, 'clean' channel, n_clean k from pre union all select id, country, 'legal', n_legal from pre union all select id, country, 'first_two', n_first_two from pre union all select id, country, 'sorted', n_sorted from pre
  union all select id, country, 'condensed', n_condensed from pre where length(n_condensed) >= 5
  union all select id, country, 'num_sal', unnest({_product('a_digits[1:4]', 'a_salient[1:12]')}) from pre union all select id, country, 'pin_num', unnest({_product('a_postal[1:2]', 'a_digits[1:2]')}) from pre
  union all select id, country, 'pin_sal', unnest({_product('a_postal[1:2]', 'a_salient[1:4]')}) from pre union all select id, country, 'num_pair', pair from pre
  union all select id, country, 'rare', unnest(list_filter(n_tokens, lambda x: length(x) >= 4)) from pre union all select id, country, 'sal_pair', k from sp union all select id, country, 'prefix_pair', prefixes from pre
  union all select id, country, 'fallback', unnest(list_filter(a_salient[1:2], lambda x: length(x) >= 5)) from pre),
keys as (select distinct id, country, channel, k from k0 where k <> ''),
cap as (select * from (values ('clean', 150, 1), ('legal', 150, 1), ('first_two', 150, 1), ('sorted', 150, 1), ('condensed', 150, 1), ('num_sal', 100, 2), ('pin_num', 80, 2), ('pin_sal', 60, 2), ('num_pair', 60, 2), ('rare', 40, 2), ('sal_pair', 50, 3), ('prefix_pair', 50, 3), ('fallback', 35, 4)) c(channel, cap, tier)),
post as (select country, channel, k, id tid, tier, cap, count(*) over (partition by country, channel, k) n from keys join cap using (channel) where id not like 'S1-%'),
hit as (select distinct a.id sid, p.tid, p.tier from keys a join post p using (country, channel, k) where a.id like 'S1-%' and p.n <= p.cap and not (channel = 'rare' and exists (select 1 from tf where tf.country = a.country and tf.token = k and tf.n > 40)))"""
_CANDS = f"""{_FREQ}, {_KEYS},
sure as (select sid, count(*) filter (where tier <= 2) sure from hit group by sid),
pairs as (select sid, tid, min(least(tier, 3)) tier from hit join sure using (sid) where tier < 4 or sure <= 2 group by all)"""


def _block(tier: int) -> Query:
    def run(spark, sf):
        return blocking.hits(*X.sides(spark, sf)).where(F.col("tier") == tier).select("sid", "tid").distinct()

    return run


for _tier, _name in ((1, "q17_block_tier1"), (2, "q18_block_tier2"), (3, "q19_block_tier3")):
    QUERIES[_name], SQL[_name] = _block(_tier), f"with {X.VIEWS}, {_FREQ}, {_KEYS} select distinct sid, tid from hit where tier = {_tier}"


@query("q19b_block_fallback", f"with {X.VIEWS}, {_CANDS} select sid, tid, tier from pairs")
def _(spark, sf):
    return blocking.candidates(*X.sides(spark, sf), most=None)


_CAPPED = f"{_CANDS}, capped as (select sid, tid, tier from (select *, row_number() over (partition by sid order by tier, tid) place from pairs) where tier = 1 or place <= 150)"


@query("q20_tiered_cap", f"with {X.VIEWS}, {_CAPPED} select sid, tid, tier from capped")
def _(spark, sf):
    return blocking.candidates(*X.sides(spark, sf), most=blocking.MAX_CANDIDATES)


@query("q21_block_report", f"""with {X.VIEWS}, {_CAPPED}, per as (select s.id, count(tid) c from s left join capped on sid = s.id group by s.id)
select count(*) n_entities, cast(sum(c) as bigint) n_pairs, (select count(*) from truth) n_true, (select count(*) from truth join capped using (sid, tid)) found,
  round((select count(*) from truth join capped using (sid, tid)) / cast((select count(*) from truth) as double), 6) recall, round(avg(c), 6) mean, round(quantile_cont(c, 0.95), 6) p95, round(quantile_cont(c, 0.99), 6) p99, max(c) most,
  round(1 - sum(c) / cast(count(*) * (select count(*) from t) as double), 6) reduction from per""")
def _(spark, sf):
    s, t = X.sides(spark, sf)
    rep = blocking.report(s, blocking.candidates(s, t, most=blocking.MAX_CANDIDATES), X.truth(spark, sf), t.count())
    return rep.select("n_entities", "n_pairs", "n_true", "found", *[r6(c).alias(c) for c in ("recall", "mean", "p95", "p99")], "most", r6("reduction").alias("reduction"))


@query("q21b_slice_recall", f"""with {X.VIEWS}, {_CAPPED} select s.country, count(*) n, count(capped.tid) found, round(count(capped.tid) / cast(count(*) as double), 6) recall
from truth join s on s.id = sid left join capped on capped.sid = truth.sid and capped.tid = truth.tid group by s.country""")
def _(spark, sf):
    s, t = X.sides(spark, sf)
    met = X.truth(spark, sf).join(blocking.candidates(s, t, most=blocking.MAX_CANDIDATES).withColumn("hit", F.lit(1)), ["sid", "tid"], "left").join(s.select(F.col("id").alias("sid"), "country"), "sid")
    return met.groupBy("country").agg(F.count("*").alias("n"), F.count("hit").alias("found"), r6(F.count("hit") / F.count("*")).alias("recall"))


# ---- retrieval


def _bm25_sql(tokens: str) -> str:
    return f"""(select sid, tid, row_number() over (partition by sid order by score desc, tid) - 1 as rank, score from (
  select a.sid, p.tid, cast(sum(cast(a.q * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / greatest(avg_len, 1.0))) as decimal(28, 12))) as double) score
  from (select id sid, country, unnest({tokens}) token, 1 one from s) a0 join (select sid, country, token, cast(count(*) as double) q from (select id sid, country, unnest({tokens}) token from s) group by all) a using (sid, country, token)
  join (select id tid, country, token, len, cast(count(*) as double) tf from (select id, country, len({tokens}) len, unnest({tokens}) token from t) group by all) p using (country, token)
  join (select country, token, ln(1 + (n - df + 0.5) / (df + 0.5)) idf from (select country, token, count(*) df from (select distinct id, country, token from (select id, country, unnest({tokens}) token from t)) group by all) join (select country, count(*) n from t group by all) using (country) where df <= 300) i using (country, token)
  join (select country, avg(len({tokens})) avg_len from t group by all) l using (country) where idf > 0 group by all) qualify row_number() over (partition by sid order by score desc, tid) <= 25)""".replace(f"(select id sid, country, unnest({tokens}) token, 1 one from s) a0 join ", "").replace(" a using (sid, country, token)", " a")


@query("q22_bm25_topk", f"with {X.VIEWS} select sid, tid, rank, round(score, 6) score from {_bm25_sql('n_tokens')}")
def _(spark, sf):
    return retrieval.bm25(*X.sides(spark, sf)).select("sid", "tid", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


_HITS = """
ix0 as (select id tid, country, 'name' kind, unnest([n_clean, n_legal, n_sorted]) k from t union all select id, country, 'addr', a_clean from t union all select id, country, 'pin', a_zip || '|' || a_num from t where a_zip <> '' and a_num <> ''
  union all select id, country, 'rare', n_tokens[list_position(list_transform(n_tokens, lambda x: length(x)), list_max(list_transform(n_tokens, lambda x: length(x))))] from t where len(n_tokens) >= 2 and list_max(list_transform(n_tokens, lambda x: length(x))) >= 6
  union all select id, country, 'missing', unnest(list_transform(a_salient[1:2], lambda x: case when a_num <> '' then x || '_' || a_num else x end)) from t where n_clean = ''),
ix as (select *, row_number() over (partition by country, kind, k order by tid) - 1 as rank from (select distinct * from ix0 where k <> '') qualify row_number() over (partition by country, kind, k order by tid) <= case when kind = 'rare' then 20 else 35 end),
pr as (select id sid, country, 'name' kind, n_clean k, 'exact_name' channel, 1.0 base from s union all select id, country, 'name', n_legal, 'exact_name', 0.95 from s where n_legal <> n_clean union all select id, country, 'name', n_sorted, 'exact_name', 0.9 from s where n_sorted <> n_clean
  union all select id, country, 'addr', a_clean, 'exact_addr', 0.95 from s union all select id, country, 'pin', a_zip || '|' || a_num, unnest(['numeric_loc', 'sibling']), unnest([0.8, 0.65]) from s where a_zip <> '' and a_num <> ''
  union all select id, country, 'rare', unnest(list_filter(n_tokens, lambda x: length(x) >= 6)), 'rare_token', 0.85 from s
  union all select id, country, 'missing', unnest(list_transform(a_salient[1:2], lambda x: case when a_num <> '' then x || '_' || a_num else x end)), 'missing_field', 0.7 from s where n_clean = '' and a_clean <> ''),
met as (select sid, tid, channel, rank, base / (1 + 0.05 * rank) score, base = 1.0 clean, kind, country, k from pr join ix using (country, kind, k) where k <> '' and not (channel = 'sibling' and (select count(*) from ix i where i.kind = 'pin' and i.country = pr.country and i.k = pr.k) > 20)),
both_ as (select sid, tid, 'exact_both' channel, row_number() over (partition by sid order by rank, tid) - 1 as rank from (select m.sid, m.tid, m.rank from met m semi join (select sid, tid from met where channel = 'exact_addr') a using (sid, tid) where m.channel = 'exact_name' and m.clean)),
alls as (select sid, tid, channel, rank, cast(score as double) score from met union all select sid, tid, channel, rank, 1 / (1 + 0.05 * rank) from both_ union all select sid, tid, 'bm25_name', rank, score from bn union all select sid, tid, 'bm25_addr', rank, score from ba),
best as (select sid, tid, channel, rank, score from alls qualify row_number() over (partition by sid, tid, channel order by rank, score desc) = 1),
hits as (select * from best union all select sid, tid, 'reverse', 0, 1.0 from (select distinct sid, tid from best) b join s on s.id = sid join t on t.id = tid
  where s.country = t.country and ((t.n_clean <> '' and t.n_clean = s.n_clean) or (t.n_sorted <> '' and t.n_sorted = s.n_sorted) or (t.a_clean <> '' and t.a_clean = s.a_clean) or (t.a_zip <> '' and t.a_zip = s.a_zip and t.a_num <> '' and t.a_num = s.a_num))),
prov as (select sid, tid, count(*) agreement, list_sort(list(rank)) ranks, list_reverse_sort(list(score)) scores, max(case when channel = 'exact_both' then 1 else 0 end) both_hit from hits group by all)"""
_RETRIEVED = f"bn as (select * from {_bm25_sql('n_tokens')}), ba as (select * from {_bm25_sql('a_tokens')}), {_HITS}"


@query("q23_channel_provenance", f"""with {X.VIEWS}, {_RETRIEVED} select sid, tid, cast(agreement as double) agreement, cast(ranks[1] as double) best_rank, cast(coalesce(ranks[2], ranks[1]) as double) second_rank, round(scores[1], 6) best_score, round(coalesce(scores[2], 0), 6) second_score, round(1 / (1.0 + ranks[1]), 6) reciprocal_rank, cast(both_hit as double) by_exact_both from prov""")
def _(spark, sf):
    p = retrieval.provenance(retrieval.hits(*X.sides(spark, sf)))
    return p.select("sid", "tid", "agreement", "best_rank", "second_rank", r6("best_score").alias("best_score"), r6("second_score").alias("second_score"), r6("reciprocal_rank").alias("reciprocal_rank"), "by_exact_both")


@query("q24_budget_cut", f"""with {X.VIEWS}, {_RETRIEVED} select sid, tid, cast(place as integer) place from (
  select sid, tid, row_number() over (partition by sid order by agreement desc, scores[1] desc, ranks[1], tid) place, max(both_hit) over (partition by sid) exact, case when n_clean = '' or a_clean = '' or country not in ('us', 'in', 'india') then 120 else 60 end budget
  from prov join s on s.id = sid) where place <= case when exact = 1 then least(budget, 25) else budget end""")
def _(spark, sf):
    s, t = X.sides(spark, sf)
    return retrieval.budget_cut(retrieval.provenance(retrieval.hits(s, t)), s).select("sid", "tid", "place")


# ---- similarities and pair features

_BOTH = "np join s a on a.id = np.sid join t b on b.id = np.tid"


def _pairs(spark, sf) -> DataFrame:
    s, t = X.sides(spark, sf)
    return features.with_sides(X.name_pairs(spark, sf), s, t)


@query("q25_levenshtein_sim", f"with {X.PAIRS} select sid, tid, round({X.lev('a.n_clean', 'b.n_clean')}, 6) name_seq, round({X.lev('a.a_clean', 'b.a_clean')}, 6) addr_seq from {_BOTH}")
def _(spark, sf):
    return _pairs(spark, sf).select("sid", "tid", r6(S.levenshtein_ratio(F.col("s_n_clean"), F.col("t_n_clean"))).alias("name_seq"), r6(S.levenshtein_ratio(F.col("s_a_clean"), F.col("t_a_clean"))).alias("addr_seq"))


def _jw_sql(a: str, b: str) -> str:
    # DuckDB's function counts bytes: the one letter of cleaned names that is not ASCII gets an ASCII stand-in
    one, two = (f"replace({x}, 'ß', '~')" for x in (a, b))
    return f"case when {a} = '' and {b} = '' then 1.0 when {a} = '' or {b} = '' then 0.0 else jaro_winkler_similarity({one}, {two}) end"


@query("q26_jaro_winkler", f"with {X.PAIRS} select sid, tid, round({_jw_sql('a.n_clean', 'b.n_clean')}, 6) name_jw from {_BOTH}")
def _(spark, sf):
    return features.with_ratios(_pairs(spark, sf)).select("sid", "tid", r6("name_jw").alias("name_jw"))


@query("q27_jaccard_containment", f"""with {X.PAIRS} select sid, tid, round({X.jac('a.n_tokens', 'b.n_tokens')}, 6) jaccard, round(case when len(a.n_tokens) = 0 and len(b.n_tokens) = 0 then 1.0 when len(a.n_tokens) = 0 or len(b.n_tokens) = 0 then 0.0
  else len(list_intersect(a.n_tokens, b.n_tokens)) / cast(least(len(list_distinct(a.n_tokens)), len(list_distinct(b.n_tokens))) as double) end, 6) containment, round({X.jac('a.n_grams3', 'b.n_grams3')}, 6) grams from {_BOTH}""")
def _(spark, sf):
    c = lambda p, n: F.col(f"{p}_{n}")
    return _pairs(spark, sf).select("sid", "tid", *[r6(f(c("s", n), c("t", n))).alias(a) for a, f, n in (("jaccard", S.jaccard, "n_tokens"), ("containment", S.containment, "n_tokens"), ("grams", S.jaccard, "n_grams3"))])


@query("q28_token_sort")
def _(spark, sf):
    return features.with_ratios(_pairs(spark, sf)).select("sid", "tid", r6("name_sort").alias("name_sort"))


@query("q29_token_set")
def _(spark, sf):
    return features.with_ratios(_pairs(spark, sf)).select("sid", "tid", r6("name_set").alias("name_set"), r6("addr_set").alias("addr_set"))


def _same_sql(c: str) -> str:
    return f"case when a.{c} <> '' and a.{c} = b.{c} then 1.0 else 0.0 end"


_NAME_SQL = {
    "name_raw": _same_sql("n_raw"), "name_clean": _same_sql("n_clean"), "name_legal": _same_sql("n_legal"), "name_compact": _same_sql("n_compact"), "name_seq": X.lev("a.n_clean", "b.n_clean"),
    "name_jaccard": X.jac("a.n_tokens", "b.n_tokens"), "name_overlap": "len(list_intersect(a.n_tokens, b.n_tokens))", "name_grams3": X.jac("a.n_grams3", "b.n_grams3"), "name_grams4": X.jac("a.n_grams4", "b.n_grams4"),
    "name_prefix": _same_sql("n_prefix"), "name_suffix": _same_sql("n_suffix"), "name_first": _same_sql("n_first"), "name_last": _same_sql("n_last"),
    "name_acronym": "case when a.n_acronym <> '' and a.n_acronym = b.n_acronym then 1.0 when (a.n_acronym <> '' and contains(b.n_compact, a.n_acronym)) or (b.n_acronym <> '' and contains(a.n_compact, b.n_acronym)) then 0.8 else 0.0 end",
    "name_len_diff": "abs(length(a.n_clean) - length(b.n_clean))", "name_len_ratio": "least(length(a.n_clean), length(b.n_clean)) / cast(greatest(length(a.n_clean), length(b.n_clean), 1) as double)", "name_count_diff": "abs(len(a.n_tokens) - len(b.n_tokens))",
    "name_missing": "case when a.n_clean = '' or b.n_clean = '' then 1.0 else 0.0 end", "name_number": "case when len(list_intersect(a.n_numbers, b.n_numbers)) > 0 then 1.0 else 0.0 end",
}
_HOUSE_ABS = "(case when a.a_num <> '' and b.a_num <> '' then abs(cast(a.a_num as bigint) - cast(b.a_num as bigint)) else 0 end)"
_POSTAL = "(case when len(list_intersect(a.a_postal, b.a_postal)) > 0 then 1.0 else 0.0 end)"
_CONFLICT = f"(case when {_POSTAL} = 0 and len(a.a_postal) > 0 and len(b.a_postal) > 0 then 1.0 else 0.0 end + case when a.a_num <> '' and b.a_num <> '' and a.a_num <> b.a_num and {_HOUSE_ABS} > 10 then 1.0 else 0.0 end)"
_THREE = "list_transform(list_filter({p}.a_postal, lambda x: length(x) >= 3), lambda x: substr(x, 1, 3))"
_ADDR_SQL = {
    "addr_raw": _same_sql("a_raw"), "addr_clean": _same_sql("a_clean"), "addr_seq": X.lev("a.a_clean", "b.a_clean"), "addr_jaccard": X.jac("a.a_tokens", "b.a_tokens"), "addr_overlap": "len(list_intersect(a.a_tokens, b.a_tokens))",
    "addr_salient": X.jac("a.a_salient", "b.a_salient"), "addr_grams3": X.jac("a.a_grams3", "b.a_grams3"), "postal": _POSTAL, "postal_prefix": f"case when len(list_intersect({_THREE.format(p='a')}, {_THREE.format(p='b')})) > 0 then 1.0 else 0.0 end",
    "house": _same_sql("a_num"), "house_abs": _HOUSE_ABS, "house_rel": f"{_HOUSE_ABS} / cast(greatest(coalesce(try_cast(a.a_num as bigint), 0), coalesce(try_cast(b.a_num as bigint), 0), 1) as double)",
    "house_digits": f"case when a.a_num <> '' and b.a_num <> '' then {X.lev('a.a_num', 'b.a_num')} else 0.0 end", "city": X.lev("a.a_sal", "b.a_sal"), "state": X.lev("a.a_sal2", "b.a_sal2"), "locality": X.jac("a.a_salient[1:3]", "b.a_salient[1:3]"),
    "agree": f"{_POSTAL} + {_same_sql('a_num')}", "conflict": _CONFLICT, "addr_len_diff": "abs(length(a.a_clean) - length(b.a_clean))", "addr_missing": "case when a.a_clean = '' or b.a_clean = '' then 1.0 else 0.0 end", "addr_numbers": X.jac("a.a_numbers", "b.a_numbers"),
}
_NUMS = "list_distinct(list_concat({p}.a_numbers, {p}.n_numbers))"
_A, _B = _NUMS.format(p="a"), _NUMS.format(p="b")
_NUM_SQL = {
    "num_shared": f"len(list_intersect({_A}, {_B}))", "num_jaccard": X.jac(_A, _B), "num_sequence": "case when len(a.a_numbers) > 0 and a.a_numbers = b.a_numbers then 1.0 else 0.0 end",
    "num_apart": f"len(list_distinct(list_concat({_A}, {_B}))) - len(list_intersect({_A}, {_B}))", "num_only": f"case when len(list_intersect({_A}, {_B})) > 0 and ({X.lev('a.n_clean', 'b.n_clean')}) < 0.3 then 1.0 else 0.0 end", "num_conflict": f"case when {_CONFLICT} > 0 then 1.0 else 0.0 end",
}
_N, _D = f"({X.lev('a.n_clean', 'b.n_clean')})", f"({X.lev('a.a_clean', 'b.a_clean')})"
_CROSS_SQL = {
    "x_product": f"{_N} * {_D}", "x_harmonic": f"case when {_N} + {_D} > 0 then 2 * {_N} * {_D} / ({_N} + {_D}) else 0.0 end", "x_min": f"least({_N}, {_D})", "x_max": f"greatest({_N}, {_D})", "x_diff": f"abs({_N} - {_D})",
    "x_name_addr": f"case when {_same_sql('n_clean')} = 1 and {_D} >= 0.5 then 1.0 else 0.0 end", "x_house_name": f"case when {_same_sql('a_num')} = 1 and {_N} >= 0.7 then 1.0 else 0.0 end", "x_name_number": f"case when len(list_intersect({_A}, {_B})) > 0 then {_N} else 0.0 end",
    "x_country": "case when a.country = b.country then 1.0 else 0.0 end", "is_s2": "case when b.src = 'S2' then 1.0 else 0.0 end", "is_s3": "case when b.src = 'S3' then 1.0 else 0.0 end",
}


def _feature_query(columns: list[str]) -> Query:
    def run(spark, sf):
        return features.pair_features(_pairs(spark, sf), ratios=False).select("sid", "tid", *[r6(c).alias(c) for c in columns])

    return run


for _name, _cols in (("q30_name_features", _NAME_SQL), ("q31_addr_features", _ADDR_SQL), ("q32_numeric_features", _NUM_SQL), ("q33_cross_features", _CROSS_SQL)):
    QUERIES[_name] = _feature_query(list(_cols))
    SQL[_name] = f"with {X.PAIRS} select sid, tid, " + ", ".join(f"round(cast({e} as double), 6) {c}" for c, e in _cols.items()) + f" from {_BOTH}"


@query("q33b_feature_matrix")
def _(spark, sf):
    """All 96 columns over retrieved pairs, provenance included."""
    s, t = X.sides(spark, sf)
    found = stage(retrieval.budget_cut(retrieval.provenance(retrieval.hits(s, t)), s).drop("place"), "retrieved")
    return features.feature_matrix(found, s, t).select("sid", "tid", *[r6(c).alias(c) for c in features.ALL])


@query("q34_consensus", f"""with {X.PAIRS} select sid, tid, max(case when p.sid2 is not null then 1.0 else 0.0 end) has_peer, round(max(case when p.sid2 is not null then {X.jac('b.n_tokens', 'p.toks')} else 0.0 end), 6) peer_jaccard,
  max(case when b.a_num <> '' and b.a_num = p.num then 1.0 else 0.0 end) peer_number, round(max(case when p.sid2 is not null then {X.jac('b.n_tokens', 'p.toks')} else 0.0 end) * max(case when b.a_num <> '' and b.a_num = p.num then 1.0 else 0.0 end), 6) peer_score
  from np join t b on b.id = np.tid left join (select np.sid sid2, t.src, t.n_tokens toks, t.a_num num from np join t on t.id = np.tid) p on p.sid2 = np.sid and p.src <> b.src group by sid, tid""")
def _(spark, sf):
    made = features.consensus(X.name_pairs(spark, sf), X.sides(spark, sf)[1])
    return made.select("sid", "tid", "has_peer", r6("peer_jaccard").alias("peer_jaccard"), "peer_number", r6("peer_score").alias("peer_score"))


_CONTEXT_SQL = f"""with {X.PAIRS}, c as (select sid, tid, score, cast(count(*) over (partition by sid) as double) density, cast(count(*) over (partition by tid) as double) competition, list_reverse_sort(list(score) over (partition by tid)) tops from sc)"""


@query("q35_context", f"""{_CONTEXT_SQL} select sid, tid, density, case when density = 1 then 1.0 else 0.0 end single_candidate, competition, case when competition = 1 then 1.0 else 0.0 end single_claimant, case when a.a_num <> '' and a.a_num = b.a_num then 1.0 else 0.0 end house_support from c join s a on a.id = sid join t b on b.id = tid""")
def _(spark, sf):
    return features.context(X.name_pairs(spark, sf), *X.sides(spark, sf)).drop("target_margin")


@query("q36_target_margin", f"{_CONTEXT_SQL} select sid, tid, round(cast(case when len(tops) >= 2 then tops[1] - tops[2] else tops[1] end as double), 6) target_margin from c")
def _(spark, sf):
    return features.context(X.scored_pairs(spark, sf), *X.sides(spark, sf), score="score").select("sid", "tid", r6("target_margin").alias("target_margin"))


# ---- decisions on fixed scores

_RANKED = "rk as (select *, row_number() over (partition by sid order by score desc, tid) place, max(score) over (partition by sid) top from sc)"
_POLICY = f"{_RANKED}, pol as (select sid, tid, score from rk where top >= 0.65 and place <= 10 and (place = 1 or score >= greatest(0.65, top - 0.2)))"


@query("q37_precision_policy", f"with {X.PAIRS}, {_POLICY} select sid, tid, score from pol")
def _(spark, sf):
    return decide.precision_policy(X.scored_pairs(spark, sf))


@query("q38_expected_f05", f"""with {X.PAIRS}, {_RANKED}, e as (select *, sum(score) over (partition by sid order by score desc, tid rows unbounded preceding) cum, greatest(sum(score) over (partition by sid), 1.0) total from rk),
g as (select *, case when place <= 8 and score >= 0.25 and top >= 0.45 then round(1.25 * (cum / place) * (cum / total) / (0.25 * (cum / place) + cum / total), 12) end val from e),
m as (select sid, arg_max(place, val * 1000000 - place * 0.0000001) best from g where val is not null group by sid) select g.sid, g.tid, g.score from g join m using (sid) where val is not null and place <= best""")
def _(spark, sf):
    return decide.expected_f05(X.scored_pairs(spark, sf))


_EXCLUSIVE = f"{_POLICY}, ex as (select sid, tid, score from pol qualify row_number() over (partition by tid order by score desc, sid) = 1)"


@query("q39_exclusivity", f"with {X.PAIRS}, {_EXCLUSIVE} select sid, tid, score from ex")
def _(spark, sf):
    return decide.exclusive(decide.precision_policy(X.scored_pairs(spark, sf)))


@query("q40_source_partition", f"with {X.PAIRS}, {_POLICY} select sid, tid, score from pol qualify row_number() over (partition by sid, substr(tid, 1, 2) order by score desc, tid) = 1")
def _(spark, sf):
    return decide.source_partition(decide.precision_policy(X.scored_pairs(spark, sf)))


@query("q41_contradiction", f"""with {X.PAIRS}, {_POLICY} select sid, tid, score from pol join s a on a.id = sid join t b on b.id = tid where not (a.country <> 'unknown' and b.country <> 'unknown' and a.country <> b.country)
  and not (a.a_sal <> '' and b.a_sal <> '' and a.a_sal <> b.a_sal and coalesce(abs(try_cast(a.a_num as bigint) - try_cast(b.a_num as bigint)) > 500, false))""")
def _(spark, sf):
    return decide.without_contradictions(decide.precision_policy(X.scored_pairs(spark, sf)), *X.sides(spark, sf))


_GRID = ([0.45, 0.55, 0.65, 0.75, 0.85, 0.9, 0.95], [0.45, 0.5, 0.55, 0.6, 0.65], [0.05, 0.1, 0.15, 0.2, 0.3])


@query("q42_policy_grid", f"""with {X.PAIRS}, {_RANKED}, g as (select m, sg, mg from (select unnest({_GRID[0]}) m) a, (select unnest({_GRID[1]}) sg) b, (select unnest({_GRID[2]}) mg) c),
nt as (select id sid, (select count(*) from truth where truth.sid = s.id) n_true from s),
acc as (select m, sg, mg, rk.sid, count(*) n_pred, count(truth.tid) tp from rk cross join g left join truth on truth.sid = rk.sid and truth.tid = rk.tid where top >= sg and top >= m and place <= 10 and (place = 1 or score >= greatest(m, top - mg)) group by all),
f as (select g.m, g.sg, g.mg, nt.sid, n_true, coalesce(n_pred, 0) n_pred, coalesce(tp, 0) tp from g cross join nt left join acc on acc.m = g.m and acc.sg = g.sg and acc.mg = g.mg and acc.sid = nt.sid)
select cast(m as double) "match", cast(sg as double) singleton, cast(mg as double) margin, round(avg(case when n_true = 0 then case when n_pred = 0 then 1.0 else 0.0 end when tp = 0 then 0.0 else 1.25 * (tp / cast(n_pred as double)) * (tp / cast(n_true as double)) / (0.25 * (tp / cast(n_pred as double)) + tp / cast(n_true as double)) end), 6) f05 from f group by all""")
def _(spark, sf):
    ent = X.entities(spark, sf).select(F.col("sid").alias("id"))
    return decide.policy_grid(X.scored_pairs(spark, sf), X.truth(spark, sf), ent, *_GRID).select("match", "singleton", "margin", r6("f05").alias("f05"))


# ---- metrics

_SCORES = f"""{_POLICY}, pr as (select sid, tid from pol), j as (select coalesce(truth.sid, pr.sid) sid, truth.tid t, pr.tid p from truth full join pr on truth.sid = pr.sid and truth.tid = pr.tid),
e0 as (select s.id sid, s.country, s.n_clean, s.a_clean, count(t) n_true, count(p) n_pred, count(case when t = p then 1 end) tp from s left join j on j.sid = s.id group by all),
es as (select *, n_pred - tp fp, n_true - tp fn, case when n_true = 0 then case when n_pred = 0 then 1.0 else 0.0 end when tp = 0 then 0.0 else tp / cast(n_pred as double) end prec,
  case when n_true = 0 then case when n_pred = 0 then 1.0 else 0.0 end when tp = 0 then 0.0 else tp / cast(n_true as double) end rec from e0),
ef as (select *, case when n_true = 0 then rec when tp = 0 then 0.0 else 1.25 * prec * rec / (0.25 * prec + rec) end f05 from es)"""


def _scores(spark, sf, extra: tuple[str, ...] = ()) -> DataFrame:
    ent = X.sides(spark, sf)[0].select(F.col("id").alias("sid"), "country", *extra)
    return metrics.entity_scores(ent, truth=X.truth(spark, sf), predicted=decide.precision_policy(X.scored_pairs(spark, sf)))


@query("q43_entity_f05", f"with {X.PAIRS}, {_SCORES} select sid, n_true, n_pred, tp, round(prec, 6) \"precision\", round(rec, 6) recall, round(f05, 6) f05 from ef")
def _(spark, sf):
    return _scores(spark, sf).select("sid", "n_true", "n_pred", "tp", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f05").alias("f05"))


@query("q44_macro_f05_grouping_sets", f"""with {X.PAIRS}, {_SCORES}, b as (select *, case when n_true = 0 then '0' when n_true = 1 then '1' when n_true <= 3 then '2-3' else '4+' end bucket from ef)
select country, bucket, count(*) n, round(avg(f05), 6) f05, round(avg(prec), 6) "precision", round(avg(rec), 6) recall, round(avg(case when n_true = 0 then f05 end), 6) singleton_accuracy, round(avg(case when n_true > 0 then f05 end), 6) matched_f05, cast(sum(tp) as bigint) tp, cast(sum(fp) as bigint) fp, cast(sum(fn) as bigint) fn, count(case when n_true = 0 and n_pred > 0 then 1 end) false_merges
from b group by grouping sets ((), (country), (bucket))""")
def _(spark, sf):
    return metrics.summary(_scores(spark, sf)).select("country", "bucket", "n", *[r6(c).alias(c) for c in ("f05", "precision", "recall", "singleton_accuracy", "matched_f05")], "tp", "fp", "fn", "false_merges")


@query("q45_slice_audit", f"""with {X.PAIRS}, {_SCORES}, g as (select f05, unnest(list_filter([case when n_clean = '' then 'missing_name' end, case when a_clean = '' then 'missing_address' end, case when country not in ('us', 'unknown') then 'foreign' end, case when n_true >= 2 then 'multi_match' end, case when n_true = 0 then 'singleton' end], lambda x: x is not null)) slice from ef) select slice, count(*) n, round(avg(f05), 6) f05 from g group by slice""")
def _(spark, sf):
    return metrics.slices(_scores(spark, sf, ("n_clean", "a_clean", "n_is_indic"))).select("slice", "n", r6("f05").alias("f05"))


@query("q45b_truth_structure", f"""with {X.TRUTH}, e as (select entity_id sid, (select count(*) from truth where truth.sid = entity_id and tid like 'S2%') s2, (select count(*) from truth where truth.sid = entity_id and tid not like 'S2%') s3 from ent where entity_id like 'S1-%')
select count(*) n, count(case when s2 = 0 and s3 = 0 then 1 end) "none", count(case when s2 > 0 and s3 > 0 then 1 end) "both", count(case when s2 > 0 and s3 = 0 then 1 end) only_s2, count(case when s2 = 0 and s3 > 0 then 1 end) only_s3, round(avg(s2), 6) mean_s2, round(avg(s3), 6) mean_s3 from e""")
def _(spark, sf):
    out = metrics.truth_structure(X.entities(spark, sf).select("sid"), X.truth(spark, sf))
    return out.select("n", "none", "both", "only_s2", "only_s3", r6("mean_s2").alias("mean_s2"), r6("mean_s3").alias("mean_s3"))


@query("q46_error_taxonomy_pareto", f"""with {X.PAIRS}, {_SCORES}, bad as (select sid, n_true, 1 - f05 deficit, fp, fn from ef where f05 < 1 - 1e-6),
wrong as (select j.sid, coalesce(j.t, j.p) tid, j.t is not null and j.p is null missed, deficit / greatest(fp + fn, 1) lost from j join bad using (sid) where n_true > 0 and (j.t is null or j.p is null)),
cl as (select case when missed and sc.score is null then case when regexp_matches(a.n_raw || b.n_raw, '[^\\x00-\\x7F]') then 'blocker_miss_transliteration' when a.a_raw = '' or b.a_raw = '' then 'blocker_miss_missing_address' else 'blocker_miss_lexical' end
  when missed then case when sc.score >= 0.65 then 'margin_gate_cut' else 'model_under_threshold' end when a.a_raw <> '' and lower(a.a_raw) = lower(b.a_raw) then 'address_collision' when a.n_raw <> '' and lower(a.n_raw) = lower(b.n_raw) then 'name_collision' else 'hard_negative' end "class", lost
  from wrong w left join sc on sc.sid = w.sid and sc.tid = w.tid join s a on a.id = w.sid join t b on b.id = w.tid union all select 'singleton_false_merge', deficit from bad where n_true = 0),
rolled as (select "class", count(*) n, sum(lost) lost from cl group by all)
select "class", n, round(lost, 6) lost, round(100 * lost / sum(lost) over (), 6) "share", round(sum(100 * lost / (select sum(lost) from rolled)) over (order by lost desc, "class" rows unbounded preceding), 6) cumulative from rolled""")
def _(spark, sf):
    scored = X.scored_pairs(spark, sf)
    out = metrics.error_taxonomy(_scores(spark, sf), X.views(spark, sf).select("id", "n_raw", "a_raw"), truth=X.truth(spark, sf), predicted=decide.precision_policy(scored), candidates=scored)
    return out.select("class", "n", r6("lost").alias("lost"), r6("share").alias("share"), r6("cumulative").alias("cumulative"))


# ---- mining and gates


@query("q47_hard_negative_cascade", f"""with {X.PAIRS} select sid, tid, case when score >= 0.9 then 'model_fp' when (a.n_clean = b.n_clean or (a.n_sorted <> '' and a.n_sorted = b.n_sorted)) and a.a_clean <> b.a_clean then 'same_name_diff_addr'
  when a.a_clean <> '' and a.a_clean = b.a_clean and not (a.n_clean = b.n_clean or (a.n_sorted <> '' and a.n_sorted = b.n_sorted)) then 'same_addr_diff_name' when a.a_zip <> '' and a.a_zip = b.a_zip and a.a_num <> '' and b.a_num <> '' and a.a_num <> b.a_num then 'nearby_hnum_locality' else 'general' end bucket
  from sc join s a on a.id = sid join t b on b.id = tid anti join truth on truth.sid = sc.sid and truth.tid = sc.tid""")
def _(spark, sf):
    s, t = X.sides(spark, sf)
    return mining.classify(features.with_sides(X.scored_pairs(spark, sf), s, t), truth=X.truth(spark, sf), least=0.9)


@query("q47b_mined_quota")
def _(spark, sf):
    s, t = X.sides(spark, sf)
    truth = X.truth(spark, sf)
    return mining.mine(mining.classify(features.with_sides(X.scored_pairs(spark, sf), s, t), truth=truth, least=0.9), truth.count())


@query("q48_per_s1_top_negatives", f"with {X.PAIRS} select sid, tid, score from (select sc.*, row_number() over (partition by sc.sid order by score desc, jaccard desc, sc.tid) place from sc anti join truth on truth.sid = sc.sid and truth.tid = sc.tid) where place <= 4")
def _(spark, sf):
    pairs = X.scored_pairs(spark, sf).select("sid", "tid", "score", F.col("score").alias("agreement"), F.col("jaccard").alias("best_score"))
    return mining.hardest_per_entity(pairs, truth=X.truth(spark, sf)).select("sid", "tid", "score")


@query("q48b_hardness", f"""with {X.PAIRS}, h as (select sc.sid, sc.tid, round(0.4 * jaccard + 0.3 * addr + 0.3 * score, 9) hardness from sc anti join truth on truth.sid = sc.sid and truth.tid = sc.tid), n as (select *, count(*) over (partition by sid) n, row_number() over (partition by sid order by hardness desc, tid) place from h)
select sid, tid, round(hardness, 6) hardness from n where n <= 8 or place <= greatest(4, least(floor(0.6 * n), 15)) + 6""")
def _(spark, sf):
    pairs = X.scored_pairs(spark, sf).select("sid", "tid", F.col("jaccard").alias("name_seq"), F.col("addr").alias("addr_seq"), F.col("score").alias("name_jaccard"))
    return mining.by_hardness(pairs, truth=X.truth(spark, sf)).select("sid", "tid", r6("hardness").alias("hardness"))


_SINGLE = "si as (select sid, max(score) top, avg(score) mean, sqrt(cast(count(*) * sum(cast(round(score * 1000000000) as bigint) * cast(round(score * 1000000000) as bigint)) - sum(cast(round(score * 1000000000) as bigint)) * sum(cast(round(score * 1000000000) as bigint)) as double)) / count(*) / 1000000000.0 spread, max(score) - coalesce(list_reverse_sort(list(score))[2], 0) margin, count(*) n, count(*) filter (where score >= 0.3) n_30, count(*) filter (where score >= 0.4) n_40, max(jaccard) max_jaccard, avg(jaccard) mean_jaccard, max(number) max_number, max(addr) max_addr, avg(addr) mean_addr from sc group by sid)"


@query("q49_singleton_features", f"with {X.PAIRS}, {_SINGLE} select sid, n, n_30, n_40, " + ", ".join(f"round(cast({c} as double), 6) {c}" for c in ("top", "mean", "spread", "margin", "max_jaccard", "mean_jaccard", "max_number", "max_addr", "mean_addr")) + " from si")
def _(spark, sf):
    f = decide.singleton_features(X.scored_pairs(spark, sf))
    return f.select("sid", "n", "n_30", "n_40", *[r6(c).alias(c) for c in ("top", "mean", "spread", "margin", "max_jaccard", "mean_jaccard", "max_number", "max_addr", "mean_addr")])


@query("q50_abstention_gate", f"with {X.PAIRS}, {_SINGLE} select sid, top < 0.48 and max_jaccard < 0.55 and max_number < 0.5 and margin < 0.08 abstain, top < 0.77 and margin < 0.035 and top - margin > 0.35 close_race from si")
def _(spark, sf):
    scored = X.scored_pairs(spark, sf)
    return decide.abstention_gate(scored).join(decide.close_race_gate(scored).withColumnRenamed("abstain", "close_race"), "sid")


# ---- catalog, encodings, validation


@query("q51_group_median_baseline", "with b as (select p_type, median(p_retailprice) m from part where p_partkey % 5 <> 0 group by 1) select p_partkey, round(coalesce(m, (select median(p_retailprice) from part where p_partkey % 5 <> 0)), 6) baseline from part left join b using (p_type) where p_partkey % 5 = 0")
def _(spark, sf):
    part = X.table(spark, sf, "part")
    train, test = part.where("p_partkey % 5 <> 0"), part.where("p_partkey % 5 = 0")
    return splits.apply_baseline(test, splits.group_baseline(train, "p_type", "p_retailprice"), train, "p_type", "p_retailprice").select("p_partkey", r6("baseline").alias("baseline"))


@query("q52_target_encoding", "select o_orderpriority, round((sum(o_totalprice) + 10 * (select avg(o_totalprice) from orders)) / (count(o_totalprice) + 10), 4) encoded from orders group by 1")
def _(spark, sf):
    return splits.target_encoding(X.table(spark, sf, "orders"), "o_orderpriority", "o_totalprice").select("o_orderpriority", F.round("encoded", 4).alias("encoded"))


@query("q53_oof_target_encoding", """with o as (select o_orderpriority, o_orderkey % 5 fold, o_totalprice from orders), c as (select distinct o_orderpriority, fold from o),
g as (select f.fold, avg(o_totalprice) mean from (select distinct fold from o) f join o on o.fold <> f.fold group by f.fold)
select c.o_orderpriority, cast(c.fold as bigint) fold, round((sum(o_totalprice) + 10 * any_value(mean)) / (count(*) + 10), 4) encoded from c join g on g.fold = c.fold join o on o.fold <> c.fold and o.o_orderpriority = c.o_orderpriority group by c.o_orderpriority, c.fold""")
def _(spark, sf):
    orders = X.table(spark, sf, "orders").withColumn("fold", F.col("o_orderkey") % 5)
    return splits.oof_target_encoding(orders, "o_orderpriority", "o_totalprice", "fold").select("o_orderpriority", F.col("fold").cast("long").alias("fold"), F.round("encoded", 4).alias("encoded"))


@query("q54_schema_validation", "select count(*) n, count(*) - count(c_name) null_c_name, count(*) - count(c_acctbal) null_c_acctbal, count(c_custkey) - count(distinct c_custkey) duplicates, count(*) filter (where isnan(cast(c_acctbal as double))) nan_target, count(*) filter (where c_acctbal < 0) negative_target, count(*) filter (where c_acctbal = 0) zero_target from customer")
def _(spark, sf):
    return validate.table_counts(X.table(spark, sf, "customer"), "c_custkey", "c_acctbal", ["c_name", "c_acctbal"])


def _ratio_sql(pattern: str) -> str:
    return f"round(len(regexp_extract_all(text, '{pattern}')) / cast(greatest(length(text), 1) as double), 6)"


@query("q55_text_stats", rf"select doc_id, cast(length(text) as double) txt_char_len, cast(len(regexp_extract_all(text, '\S+')) as double) txt_word_count, {_ratio_sql('[0-9]')} txt_digit_ratio, {_ratio_sql(chr(92) + 'p{Lu}')} txt_upper_ratio, {_ratio_sql('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's]')} txt_punct_ratio from documents")
def _(spark, sf):
    kept = X.table(spark, sf, "documents").select("doc_id", *catalog.text_stats(F.col("text"), "txt"))
    return kept.select("doc_id", *[r6(c).alias(c) for c in kept.columns[1:]])


@query("q56_keyword_flags", "select p_partkey, " + ", ".join(f"cast(contains(lower(p_name || ' ' || p_type), '{k}') as integer) kw_{k}" for k in ("combo", "pack", "set", "organic", "refill", "premium", "pro", "plus", "mini", "max", "ultra", "wireless", "rechargeable", "genuine", "original", "warranty", "waterproof", "portable", "natural")) + " from part")
def _(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", *catalog.keyword_flags(F.concat_ws(" ", "p_name", "p_type")))


_UNIT_TEXT = "case p_size % 6 when 0 then 'Pack of ' || p_size when 1 then p_size || 'x250 ml bottle' when 2 then 'Jar ' || p_size || ' kg' when 3 then p_size || '.5 oz tin, set of 4' when 4 then 'Box, ' || p_size || ' pcs' else p_name end"


@query("q57_pack_quantity_unit", rf"""with p as (select p_partkey, {_UNIT_TEXT} x from part), g as (select *, regexp_extract(x, '(?i)(\d+)\s*x\s*\d+(?:\.\d+)?', 1) mult, coalesce(nullif(regexp_extract(x, '(?i)(?:pack\s+of|set\s+of)\s*(\d+)', 1), ''), nullif(regexp_extract(x, '(?i)(\d+)\s*(?:pcs|pack)', 1), '')) pk,
  regexp_extract(x, '(?i)(\d+(?:\.\d+)?)\s*(ml|kg|oz|pcs)(?:[^a-zA-Z]|$)', 1) v, lower(regexp_extract(x, '(?i)(\d+(?:\.\d+)?)\s*(ml|kg|oz|pcs)(?:[^a-zA-Z]|$)', 2)) u from p)
select p_partkey, coalesce(try_cast(mult as integer), case when try_cast(pk as integer) between 1 and 1000 then try_cast(pk as integer) end, 1) pack, round(try_cast(v as double), 6) "value", case when u = '' then 'unknown' else u end unit, round(try_cast(v as double) * case u when 'kg' then 1000.0 when 'oz' then 28.3495 end, 6) grams, round(try_cast(v as double) * case u when 'ml' then 1.0 end, 6) millilitres from g""")
def _(spark, sf):
    part = X.table(spark, sf, "part").select("p_partkey", F.expr(_UNIT_TEXT).alias("x"))
    made = part.select("p_partkey", catalog.pack_count(F.col("x")).alias("pack"), catalog.quantity(F.col("x")).alias("q"))
    return made.select("p_partkey", "pack", r6("q.value").alias("value"), "q.unit", r6("q.grams").alias("grams"), r6("q.millilitres").alias("millilitres"))


@query("q58_brand", r"""with p as (select p_partkey, case p_partkey % 4 when 0 then 'brand: ' || p_brand when 1 then 'Acme ' || p_name when 2 then 'made by ' || p_brand else p_name end x from part)
select p_partkey, case when regexp_extract(x, '(?i)(?:brand\s*:\s*|by\s+)([a-zA-Z0-9\-.&]+)', 1) <> '' then regexp_extract(x, '(?i)(?:brand\s*:\s*|by\s+)([a-zA-Z0-9\-.&]+)', 1) when regexp_matches(split_part(x, ' ', 1), '^[A-Z]') and length(split_part(x, ' ', 1)) > 1 then regexp_replace(split_part(x, ' ', 1), '[^\p{L}\p{N}_]', '', 'g') else 'UNKNOWN' end brand from p""")
def _(spark, sf):
    k = F.col("p_partkey") % 4
    x = F.when(k == 0, F.concat(F.lit("brand: "), "p_brand")).when(k == 1, F.concat(F.lit("Acme "), "p_name")).when(k == 2, F.concat(F.lit("made by "), "p_brand")).otherwise(F.col("p_name"))
    return X.table(spark, sf, "part").select("p_partkey", catalog.brand(x).alias("brand"))


@query("q58b_catalog_record")
def _(spark, sf):
    part = X.table(spark, sf, "part").withColumn("bullets", F.concat(F.lit("Pack of "), F.col("p_size").cast("string")))
    return catalog.record_features(part, "p_name", "p_type", "bullets", ["p_partkey"])


@query("q59_median_impute_ordinal", """with tr as (select * from part where p_partkey % 5 <> 0), c as (select p_brand, row_number() over (order by p_brand) - 1 code from (select distinct p_brand from tr where p_brand <> 'Brand#11'))
select p_partkey, coalesce(code, -1) code, round(coalesce(case when p_partkey % 7 <> 0 then cast(p_size as double) end, (select quantile_cont(p_size, 0.5) from tr)), 6) size_ from part left join c using (p_brand)""")
def _(spark, sf):
    part = X.table(spark, sf, "part")
    train = part.where("p_partkey % 5 <> 0")
    holed = part.withColumn("size_", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")))
    filled = catalog.impute_median(holed, "size_", train.withColumn("size_", F.col("p_size").cast("double")))
    return catalog.ordinal(filled, "p_brand", train.where("p_brand <> 'Brand#11'")).select("p_partkey", F.col("code").cast("long").alias("code"), r6("size_").alias("size_"))


_LABELLED = "l as (select doc_id, quality y, 0.05 + 0.9 * ((doc_id * 37) % 101) / 101.0 a, 0.05 + 0.9 * quality * 0.5 + 0.2 * ((doc_id * 53) % 97) / 97.0 b from labels)"


def _labelled(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    return X.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"), (0.05 + 0.9 * ((k * 37) % 101) / 101.0).alias("a"), (0.05 + 0.9 * F.col("quality") * 0.5 + 0.2 * ((k * 53) % 97) / 97.0).alias("b"))


@query("q60_blend_alpha_logloss", f"with {_LABELLED}, g as (select k / 10.0 alpha from range(11) r(k)) select round(cast(alpha as double), 6) alpha, round(avg(-(y * ln(alpha * a + (1 - alpha) * b) + (1 - y) * ln(1 - (alpha * a + (1 - alpha) * b)))), 6) loss from l, g group by 1")
def _(spark, sf):
    return metrics.blend_losses(_labelled(spark, sf), "y", "a", "b").select(r6("alpha").alias("alpha"), r6("loss").alias("loss"))


@query("q60b_blends", f"with {_LABELLED} select doc_id, round(cast((a + b) / 2 as double), 6) mean, round(cast((a + b) / 2 as double), 6) median, round(cast(0.3 * a + 0.7 * b as double), 6) weighted from l")
def _(spark, sf):
    return _labelled(spark, sf).select("doc_id", r6(models.blend(["a", "b"])).alias("mean"), r6(models.blend(["a", "b"], "median")).alias("median"), r6(models.blend(["a", "b"], weights=[0.3, 0.7])).alias("weighted"))


@query("q61_calibrator_isotonic")
def _(spark, sf):
    rows = _labelled(spark, sf)
    return models.Calibrator().fit(rows, "b", "y").apply(rows, "b").select("doc_id", "y", r6("b").alias("b"))


def _pair_table(spark, sf) -> DataFrame:
    s, t = X.sides(spark, sf)
    made = features.pair_features(features.with_sides(X.name_pairs(spark, sf), s, t))
    label = X.truth(spark, sf).withColumn("label", F.lit(1.0))
    return made.join(label, ["sid", "tid"], "left").fillna(0.0, ["label"]).withColumn("fold", splits.fold(F.col("sid"), 3))


@query("q62_gbt_oof")
def _(spark, sf):
    pairs = stage(_pair_table(spark, sf), "pair-table")  # read by every fold and learner
    scored = models.out_of_fold(pairs, ["name_seq", "name_jaccard", "addr_seq", "addr_jaccard", "house", "postal", "name_jw", "x_product"], "label", 3)
    return scored.select("sid", "tid", "label", r6("score").alias("score"))


@query("q63_tfidf_ridge")
def _(spark, sf):
    part = X.table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("txt"), F.col("p_retailprice").cast("double").alias("price"))
    model = models.TfidfRidge().fit(part.where("p_partkey % 5 <> 0"), "txt", "price")
    return model.predict(part.where("p_partkey % 5 = 0"), "txt").select("p_partkey", F.round("prediction", 2).alias("prediction"), "price")


@query("q63b_tabular_gbt")
def _(spark, sf):
    part = X.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_brand", F.col("p_retailprice").cast("double").alias("price"), F.log1p(F.col("p_retailprice").cast("double")).alias("y"))
    fitted = models.tabular(["p_size"], ["p_brand"], "y").fit(part.where("p_partkey % 5 <> 0"))
    return fitted.transform(part.where("p_partkey % 5 = 0")).select("p_partkey", "price", F.round(F.expm1("prediction"), 2).alias("prediction"))


# ---- results and streams

_ROWS = f"""with {X.PAIRS}, {_POLICY}, lst as (select s.id sid, coalesce(string_agg(pol.tid, ',' order by pol.tid), '') matched from s left join pol on pol.sid = s.id group by s.id)"""


def _lists(spark, sf) -> DataFrame:
    return tables.id_lists(X.entities(spark, sf), decide.precision_policy(X.scored_pairs(spark, sf)))


@query("q64_submission_findings", f"""{_ROWS}, odd as (select sid, case when sid like '%0' then matched || ',' || sid when sid like '%1' then matched || ',X9' else matched end matched from lst where sid not like '%3'),
sp as (select sid, trim(x) tid from (select sid, unnest(string_split(matched, ',')) x from odd) where trim(x) <> ''),
bad as (select 'error' severity, 'self_match' rule, sid ex from sp where tid = sid union all select 'error', 'bad_prefix', tid from sp where not (tid like 'S2-%' or tid like 'S3-%') union all select 'error', 'missing_entity', id from s where id not in (select sid from odd))
select severity, rule, count(*) n, array_to_string(list_sort(list_distinct(list(ex)))[1:3], ',') examples from bad group by all""")
def _(spark, sf):
    last = F.right("sid", F.lit(1))
    odd = _lists(spark, sf).where(last != "3").withColumn("matched", F.when(last == "0", F.concat_ws(",", "matched", "sid")).when(last == "1", F.concat("matched", F.lit(",X9"))).otherwise(F.col("matched")))
    return validate.submission(odd, X.entities(spark, sf).select("sid"))


@query("q65_tsv_pair_rollup", f"{_ROWS} select sid, matched from lst")
def _(spark, sf):
    return _lists(spark, sf)


_EVENTS = "select date_trunc('hour', ts) start, event_type, count(*) n, round(sum(value), 4) total from events group by all"


@query("q66_stream_equals_batch", _EVENTS)
def _(spark, sf):
    """Hourly counts by the streaming operator over the event files, read back from its sink."""
    import tempfile
    import uuid

    from ..streaming import resolver

    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp()
    at = f"{base.rstrip('/')}/resolva-stream-{uuid.uuid4().hex}"
    events = X.table(spark, sf, "events")
    events.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{at}/in")
    counted = resolver.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    name = f"counts_{uuid.uuid4().hex}"
    run = counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("q66b_tumbling_counts", _EVENTS)
def _(spark, sf):
    from ..streaming import resolver

    out = resolver.windowed_counts(X.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("q67_end_to_end", f"""with {X.PAIRS}, {_EXCLUSIVE}, pol2 as (select sid, tid from ex join s a on a.id = sid join t b on b.id = tid where not (a.a_sal <> '' and b.a_sal <> '' and a.a_sal <> b.a_sal and coalesce(abs(try_cast(a.a_num as bigint) - try_cast(b.a_num as bigint)) > 500, false))),
j as (select coalesce(truth.sid, pol2.sid) sid, truth.tid t, pol2.tid p from truth full join pol2 on truth.sid = pol2.sid and truth.tid = pol2.tid), e0 as (select s.id sid, s.country, count(t) n_true, count(p) n_pred, count(case when t = p then 1 end) tp from s left join j on j.sid = s.id group by all),
e as (select *, case when n_true = 0 then case when n_pred = 0 then 1.0 else 0.0 end when tp = 0 then 0.0 else 1.25 * (tp / cast(n_pred as double)) * (tp / cast(n_true as double)) / (0.25 * (tp / cast(n_pred as double)) + tp / cast(n_true as double)) end f05 from e0)
select country, count(*) n, round(avg(f05), 6) f05, cast(sum(tp) as bigint) tp, cast(sum(n_pred - tp) as bigint) fp, cast(sum(n_true - tp) as bigint) fn from e group by country""")
def _(spark, sf):
    """Block, score, decide, keep targets exclusive, drop contradictions, evaluate by country."""
    s, t = X.sides(spark, sf)
    accepted = decide.without_contradictions(decide.exclusive(decide.precision_policy(X.scored_pairs(spark, sf))), s, t)
    scores = metrics.entity_scores(X.entities(spark, sf), truth=X.truth(spark, sf), predicted=accepted)
    return scores.groupBy("country").agg(F.count("*").alias("n"), r6(F.avg("f05")).alias("f05"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


# ---- numbers without a table


@query("q68_f05_sensitivity", "with v as (select * from (values (1, 1, 1), (1, 2, 1), (2, 3, 2), (2, 2, 3), (0, 1, 1), (5, 6, 10), (9, 10, 10)) t(tp, n_pred, n_true)) select tp, n_pred, n_true, round(case when tp = 0 then 0.0 else 1.25 * (tp / cast(n_pred as double)) * (tp / cast(n_true as double)) / (0.25 * (tp / cast(n_pred as double)) + tp / cast(n_true as double)) end, 6) f05 from v")
def _(spark, sf):
    rows = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 3, 2), (2, 2, 3), (0, 1, 1), (5, 6, 10), (9, 10, 10)], "tp int, n_pred int, n_true int")
    return rows.select("tp", "n_pred", "n_true", r6(metrics.f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true"))).alias("f05"))


@query("q69_regression_metrics", "select round(avg(abs(l_extendedprice - 1000 * l_quantity)), 4) mae, round(sqrt(avg((l_extendedprice - 1000 * l_quantity) * (l_extendedprice - 1000 * l_quantity))), 4) rmse, round(100 * avg(abs(l_extendedprice - 1000 * l_quantity) / ((abs(l_extendedprice) + abs(1000 * l_quantity)) / 2)), 4) smape from lineitem")
def _(spark, sf):
    rows = X.table(spark, sf, "lineitem").select(F.col("l_extendedprice").cast("double").alias("a"), (1000 * F.col("l_quantity").cast("double")).alias("p"))
    return metrics.regression(rows, "a", "p").select(*[F.round(c, 4).alias(c) for c in ("mae", "rmse", "smape")])


@query("q70_target_store_latest", "select user_id, arg_max(event_type, event_id) event_type, max(event_id) event_id from events group by user_id")
def _(spark, sf):
    return tables.latest(X.table(spark, sf, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("q71_folds_stratified")
def _(spark, sf):
    """Folds whose labels differ by one at most, and group folds of the same rows."""
    rows = splits.stratified(X.table(spark, sf, "labels"), "doc_id", "quality", 5)
    return rows.select("doc_id", "quality", "fold", splits.fold(F.col("doc_id") % 97, 5).alias("group_fold"))
