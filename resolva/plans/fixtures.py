"""Deterministic inputs made from the tables at hand: an entity view over documents with its truth, and scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import similarity as S
from ..operators import views as V
from ..sources.staging import kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, business_name, business_address, country, fp: noisy names and addresses from the first words of each document."""
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", words.alias("t"))
    parts = docs.select("doc_id", "lang", "t", F.array_join(F.slice("t", 1, 4), " ").alias("nm"), F.array_join(F.slice("t", 5, 5), " ").alias("ad"), F.length(F.array_join(F.slice("t", 1, 4), "")).alias("ln"), F.length(F.array_join(F.slice("t", 5, 5), "")).alias("la"))
    k = F.col("doc_id")
    suffix = F.when(k % 5 == 0, " LLC").when(k % 5 == 1, " Inc.").when(k % 5 == 2, " Pvt Ltd").when(k % 5 == 3, " SARL").otherwise("")
    street = F.when(k % 2 == 0, " St").otherwise(" Street")
    number, zip_ = (100 + (F.col("ln") * 13) % 900).cast("string"), (10000 + (F.col("la") * 997) % 90000).cast("string")
    return parts.select(
        F.concat(F.lit("S"), (1 + k % 3).cast("string"), F.lit("-"), F.lpad(k.cast("string"), 6, "0")).alias("entity_id"), F.when(k % 29 == 0, "").otherwise(F.concat("nm", suffix)).alias("business_name"),
        F.when(k % 31 == 0, "").otherwise(F.concat(number, F.lit(" "), F.col("ad"), street, F.lit(", "), zip_)).alias("business_address"), F.col("lang").alias("country"), F.array_join(F.slice("t", 1, 12), " ").alias("fp"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, tid): S1 and other records of one country and fingerprint."""
    ent = entity_view(spark, sf_dir).select("entity_id", "country", "fp")
    mine, others = ent.where("entity_id like 'S1-%'"), ent.where("entity_id not like 'S1-%'").select(F.col("entity_id").alias("tid"), F.col("country").alias("c"), F.col("fp").alias("f"))
    return mine.join(others, (F.col("country") == F.col("c")) & (F.col("fp") == F.col("f"))).select(F.col("entity_id").alias("sid"), "tid")


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: every channel of a query reads them, and the folding UDF should run once per record."""
    return kept(spark, sf_dir, "views", lambda: V.with_views(entity_view(spark, sf_dir)))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return V.split_sides(views(spark, sf_dir))


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, tid): records of one country whose names share their first two tokens, in buckets of 150 targets or fewer."""
    return kept(spark, sf_dir, "name-pairs", lambda: _name_pairs(spark, sf_dir))


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = sides(spark, sf_dir)
    t = t.where("n_first_two <> ''").select(F.col("id").alias("tid"), "country", "n_first_two")
    good = t.groupBy("country", "n_first_two").agg(F.count("*").alias("n")).where("n <= 150").drop("n")
    return s.select(F.col("id").alias("sid"), "country", "n_first_two").join(t.join(good, ["country", "n_first_two"]), ["country", "n_first_two"]).select("sid", "tid")


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, tid, score, jaccard, number, addr): name_pairs with a fixed score in place of a model's, exact to 6 places."""
    return kept(spark, sf_dir, "scored-pairs", lambda: _scored_pairs(spark, sf_dir))


def _scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = sides(spark, sf_dir)
    cut = lambda df, p: df.select(F.col("id").alias(p + "id"), *[F.col(c).alias(f"{p}_{c}") for c in ("n_clean", "a_clean", "n_tokens", "a_num")])
    both = name_pairs(spark, sf_dir).join(cut(s, "s"), "sid").join(cut(t, "t"), "tid")
    name, addr = S.levenshtein_ratio(F.col("s_n_clean"), F.col("t_n_clean")), S.levenshtein_ratio(F.col("s_a_clean"), F.col("t_a_clean"))
    number = F.when((F.col("s_a_num") != "") & (F.col("s_a_num") == F.col("t_a_num")), 1.0).otherwise(0.0)
    return both.select("sid", "tid", F.round(0.5 * name + 0.5 * addr, 6).alias("score"), F.round(S.jaccard(F.col("s_n_tokens"), F.col("t_n_tokens")), 6).alias("jaccard"), number.alias("number"), F.round(addr, 6).alias("addr"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, country) of S1."""
    return entity_view(spark, sf_dir).where("entity_id like 'S1-%'").select(F.col("entity_id").alias("sid"), "country")


# ---- the same in DuckDB's SQL, as common table expressions

_LEGAL = "['llc','inc','incorporated','corp','corporation','ltd','limited','pvt','private','pllc','pc','co','company','lp','llp','gmbh','sarl','sasu','sas','eurl','sa','snc','scs','sci','gie']"
_STOP = "['st','street','rd','road','dr','drive','ave','avenue','ln','lane','blvd','boulevard','ct','court','cir','circle','hwy','highway','fl','floor','ste','suite','apt','apartment','unit','po','box','near','opp','opposite','behind','beside','block','sector','plot','no','h','city','state','west','east','north','south','rue','impasse','allee','place','chemin','batiment']"
_STREET = "map {'rd':'road','st':'street','dr':'drive','ave':'avenue','ln':'lane','blvd':'boulevard','bd':'boulevard','ct':'court','cir':'circle','hwy':'highway','pkwy':'parkway','ste':'suite','fl':'floor','apt':'apartment','bldg':'building','pl':'place','sq':'square','ter':'terrace','r':'rue','av':'avenue','imp':'impasse','all':'allee','chem':'chemin'}"
_ABBREV = "map {'corp':'corporation','inc':'incorporated','ltd':'limited','pvt':'private','co':'company','mfg':'manufacturing','intl':'international','assoc':'associates','tech':'technology','mgmt':'management','svcs':'services','svc':'service','grp':'group','ent':'enterprise','ind':'industries','hldg':'holdings'}"


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(lower(strip_accents({x})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda x: x <> '')"


def _numbers(x: str, most: str) -> str:
    return rf"list_filter(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '\p{{Nd}}{{{most}}}'))"


def _unpadded(x: str) -> str:
    return f"list_transform({x}, lambda x: case when ltrim(x, '0') = '' then '0' else ltrim(x, '0') end)"


def _grams(x: str, n: int) -> str:
    return f"case when length({x}) >= {n} then list_distinct(list_transform(range(1, length({x}) - {n - 2}), lambda i: substr({x}, cast(i as integer), {n}))) else [] end"


ENT = r"""
w as (select doc_id, lang, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') t from documents),
p as (select doc_id, lang, t, array_to_string(t[1:4], ' ') nm, array_to_string(t[5:9], ' ') ad, length(array_to_string(t[1:4], '')) ln, length(array_to_string(t[5:9], '')) la from w),
ent as (
  select 'S' || (1 + doc_id % 3) || '-' || lpad(cast(doc_id as varchar), 6, '0') entity_id,
    case when doc_id % 29 = 0 then '' else nm || case doc_id % 5 when 0 then ' LLC' when 1 then ' Inc.' when 2 then ' Pvt Ltd' when 3 then ' SARL' else '' end end business_name,
    case when doc_id % 31 = 0 then '' else (100 + (ln * 13) % 900) || ' ' || ad || case when doc_id % 2 = 0 then ' St' else ' Street' end || ', ' || (10000 + (la * 997) % 90000) end business_address,
    lang country, array_to_string(t[1:12], ' ') fp
  from p)"""

TRUTH = ENT + r""",
truth as (select a.entity_id sid, b.entity_id tid from ent a join ent b on a.country = b.country and a.fp = b.fp where a.entity_id like 'S1-%' and b.entity_id not like 'S1-%')"""

VIEWS = (
    TRUTH
    + rf""",
v0 as (select entity_id id, split_part(entity_id, '-', 1) src, lower(trim(country)) country, trim(business_name) n_raw, trim(business_address) a_raw from ent),
v1 as (select *, {_clean('n_raw')} n_clean, {_clean('a_raw')} a_clean, regexp_replace(lower(strip_accents(n_raw)), '[^a-z0-9]', '', 'g') n_compact from v0),
v2 as (select *, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(n_clean, 'private limited$', '')), 'pvt ltd$', '')), 'limited liability company$', '')), 'limited liability$', '')) n_left,
  replace(n_clean, ' ', '') n_joined, replace(a_clean, ' ', '') a_joined from v1),
v3 as (select *, list_filter({_tokens('n_left')}, lambda x: not list_contains({_LEGAL}, x)) kept, {_tokens('n_left')} every,
  list_transform({_tokens('a_clean')}, lambda x: coalesce({_STREET}[x], x)) a_tokens,
  list_filter({_tokens('a_clean')}, lambda x: length(x) >= 3 and not list_contains({_STOP}, x) and not regexp_full_match(x, '\p{{Nd}}+')) a_salient,
  {_unpadded(_numbers('a_raw', '1,7'))} a_numbers, {_numbers('a_raw', '5,6')} a_postal, {_unpadded(_numbers('n_raw', '1,'))} n_numbers,
  {_unpadded("regexp_extract_all(a_raw, '[0-9]{1,7}')")} a_digits from v2),
v4 as (select *, case when len(kept) > 0 then kept else every end n_tokens, array_to_string(a_tokens, ' ') a_norm,
  list_filter({_tokens('n_clean')}, lambda x: not list_contains({_LEGAL}, x) and length(x) >= 2) sig from v3),
v as (select *, array_to_string(n_tokens, ' ') n_legal, array_to_string(n_tokens[1:2], ' ') n_first_two, coalesce(n_tokens[1], '') n_first, coalesce(n_tokens[-1], '') n_last,
  array_to_string(list_sort(list_filter(n_tokens, lambda x: length(x) >= 2 and not list_contains({_LEGAL}, x)))[1:5], '_') n_sorted,
  substr(n_joined, 1, 4) n_prefix, right(n_joined, 4) n_suffix, {_grams('n_joined', 3)} n_grams3, {_grams('n_joined', 4)} n_grams4, {_grams('a_joined', 3)} a_grams3,
  case when len(sig) >= 2 then array_to_string(list_transform(sig[1:6], lambda x: substr(x, 1, 1)), '') else '' end n_acronym,
  coalesce(a_numbers[1], '') a_num, coalesce(a_postal[1], '') a_zip, coalesce(a_salient[1], '') a_sal, coalesce(a_salient[2], '') a_sal2,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(n_raw), 'https?://(?:www\.)?', '', 'g'), '\.(com|org|net|in|co|io|biz|info|gov)\b', '', 'g'), '^[@#*]+', ''), '[^\p{{L}}\p{{N}}]+', '', 'g') n_condensed
  from v4),
s as (select * from v where src = 'S1'), t as (select * from v where src <> 'S1')"""
)


def lev(a: str, b: str) -> str:
    # DuckDB's distance counts bytes: the one letter of cleaned texts that is not ASCII gets an ASCII stand-in
    one, two = (f"replace({x}, 'ß', '~')" for x in (a, b))
    return f"case when {a} = '' and {b} = '' then 1.0 when {a} = '' or {b} = '' then 0.0 when {a} = {b} then 1.0 else 1 - levenshtein({one}, {two}) / cast(greatest(length({a}), length({b})) as double) end"


def jac(a: str, b: str) -> str:
    return f"case when len({a}) = 0 and len({b}) = 0 then 1.0 when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b})) / cast(len(list_distinct(list_concat({a}, {b}))) as double) end"


PAIRS = (
    VIEWS
    + f""",
good as (select country, n_first_two from t where n_first_two <> '' group by all having count(*) <= 150),
np as (select s.id sid, t.id tid from s join t using (country, n_first_two) semi join good using (country, n_first_two)),
sc as (select sid, tid, round(0.5 * ({lev('a.n_clean', 'b.n_clean')}) + 0.5 * ({lev('a.a_clean', 'b.a_clean')}), 6) score, round({jac('a.n_tokens', 'b.n_tokens')}, 6) jaccard,
  case when a.a_num <> '' and a.a_num = b.a_num then 1.0 else 0.0 end number, round({lev('a.a_clean', 'b.a_clean')}, 6) addr
  from np join s a on a.id = sid join t b on b.id = tid)"""
)
