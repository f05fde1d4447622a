"""Queries on single texts: normal forms, features, hints; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as feat
from ..functions import lexicons as L
from ..functions import query_text as qt


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table; one that comes in fewer pieces than there are cores (a single small file) is spread over them first."""
    df, cores = spark.read.parquet(f"{d}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("train", "documents") and df.rdd.getNumPartitions() < cores else df


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


BLANK = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def sql_norm(x: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({x}), '[^a-zа-яё0-9]+', ' ', 'g')), '')"


def sql_count(text: str, words) -> str:
    return f"cast(len(list_filter({sql_list(words)}, lambda m: contains({text}, m))) as bigint)"


def sql_translit(x: str) -> str:
    out = f"lower({sql_strip(x)})"
    for a, b in L.LATIN_GROUPS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"translate({out}, '{L.LATIN_LETTERS}', '{L.CYRILLIC_LETTERS}')"


def sql_is_latin(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '[A-Za-z]') and not regexp_matches({x}, '[\\x{{0400}}-\\x{{04FF}}]'), false)"


def sql_tokens(norm: str) -> str:
    return f"list_filter(string_split({norm}, ' '), lambda t: t <> '')"


def _features(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "train").select("qid", "QueryText", qt.normalize(F.col("QueryText")).alias("norm"))
    return rows.select("qid", *[c.alias(k) for k, c in feat.columns(F.col("QueryText"), F.col("norm")).items()])


def _hint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train").select("qid", feat.type_hint(F.col("QueryText")).alias("h")).select("qid", "h.label", "h.score", "h.dominance")


def _calibrated(spark: SparkSession, d: str) -> DataFrame:
    """The labelled type as the title's, the type of the neighbouring label as the model's, a margin by qid."""
    t = table(spark, d, "train")
    margin = F.when(F.col("qid") % 3 == 0, None).otherwise((F.col("qid") % 10) / 10)
    source = F.when(F.col("qid") % 2 == 0, "franchise_exact").otherwise("raw")
    return t.select("qid", feat.calibrated_type(F.col("QueryText"), F.when(F.col("qid") % 5 > 0, F.col("ContentType")), F.when(F.col("qid") % 7 > 1, F.lit("фильм")), margin, source).alias("content_type"))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "kinopoisk_top250")
    clean = qt.clean_title(F.lower(qt.stripped(F.col("movie"))))
    return k.select("kp_id", clean.alias("title"), qt.title_variants(clean, F.col("year")).alias("variants"), qt.chosen_title(clean, F.lower(qt.stripped(F.col("movie")))).alias("chosen"))


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train").filter("Title is not null")
    return t.select("qid", qt.has_phrase(F.col("QueryText"), F.col("Title")).alias("has_phrase"), qt.vetoed(F.col("QueryText"), F.substring("Title", 1, 2)).alias("vetoed"))


def _affixes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train").filter("Title is not null and QueryText is not null")
    return t.select("qid", qt.common_prefix(F.col("QueryText"), F.col("Title")).alias("prefix"), qt.common_suffix(F.col("QueryText"), F.col("Title")).alias("suffix"))


QUERIES = {
    "normalize": lambda s, d: table(s, d, "train").select("qid", qt.normalize(F.col("QueryText")).alias("norm")),
    "normalize_documents": lambda s, d: table(s, d, "documents").select("doc_id", qt.normalize(F.col("text")).alias("norm")).select("doc_id", F.length("norm").alias("n_chars"), F.md5("norm").alias("digest")),
    "variant_form": lambda s, d: table(s, d, "train").select("qid", qt.variant_form(F.col("QueryText")).alias("form")),
    "default_process": lambda s, d: table(s, d, "train").select("qid", qt.default_process(F.col("QueryText")).alias("processed")),
    "translit": lambda s, d: table(s, d, "train").select("qid", qt.is_latin(F.col("QueryText")).alias("latin"), qt.in_cyrillic(F.col("QueryText")).alias("cyrillic")),
    "clean_titles": _titles,
    "phrase_match": _phrases,
    "common_affixes": _affixes,
    "content_type_map": lambda s, d: table(s, d, "train").select("qid", qt.content_type(F.col("ContentType")).alias("mapped"), qt.known_label(F.col("ContentType")).alias("label")),
    "year_tokens": lambda s, d: table(s, d, "train").select("qid", F.explode(qt.tokens(qt.normalize(F.col("QueryText")))).alias("token")).filter(qt.is_year(F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n")),
    "features18": _features,
    "feature_vector": lambda s, d: table(s, d, "test_public_queries").withColumn("norm", qt.normalize(F.col("QueryText"))).select("qid", feat.vector(F.col("QueryText"), F.col("norm")).alias("v")),
    "heuristic_type": lambda s, d: table(s, d, "train").select("qid", feat.heuristic_type(F.col("QueryText")).alias("type_query")),
    "generic_query": lambda s, d: table(s, d, "train").select("qid", feat.is_generic(F.col("QueryText")).alias("generic"), feat.has_broad_context(F.col("QueryText")).alias("broad")),
    "ct_hint": _hint,
    "ct_calibrate": _calibrated,
    "label_filter_fill": lambda s, d: table(s, d, "train").filter("TypeQuery = 1").select("qid", F.coalesce(F.when(F.col("ContentType") != "", F.col("ContentType")), F.lit(L.OTHER)).alias("content_type"), qt.normalize(F.col("QueryText")).alias("norm")),
    "label_distribution": lambda s, d: table(s, d, "train").groupBy("TypeQuery", "ContentType").agg(F.count(F.lit(1)).alias("n")),
    "title_mask": lambda s, d: table(s, d, "train").filter((F.col("TypeQuery") == 1) & F.col("Title").isNotNull() & (qt.stripped(F.col("Title")) != "")).select("qid"),
}

_N = sql_norm("QueryText")
_points = {label: " + ".join(["0", *[f"case when {' or '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in words)} then {n} else 0 end" for x, n, words in L.TYPE_POINTS if x == label]]) for label in L.LABELS}
_POINTS = f"""
p as (select *, {', '.join(f'{_points[x]} as p{i}' for i, x in enumerate(L.LABELS))} from low),
q as (select * replace (p1 + case when p0 = 0 and p3 = 0 and regexp_matches(low, '19[5-9][0-9]|20[0-2][0-9]|2030') then 1 else 0 end as p1) from p),
r as (select *, list_sort([{', '.join(f"{{'score': p{i}, 'place': {-i}, 'label': '{x}'}}" for i, x in enumerate(L.LABELS))}], 'DESC') as o from q),
h as (select *, case when o[1].score > 0 then o[1].label else '' end as label, o[1].score as score, o[1].score - o[2].score as dominance from r)"""
_label = lambda x: f"case when lower({sql_strip(x)}) in ('сериал', 'фильм', 'мультфильм', 'мультсериал', 'прочее') then lower({sql_strip(x)}) else '' end"
_variants = lambda t, y: f"""list_sort(list_distinct(list_filter([trim(v) for v in [{t}, {sql_norm(t)}, replace({t}, 'ё', 'е'), replace({sql_norm(t)}, 'ё', 'е'),
  case when regexp_matches({y}, '^[0-9]+$') then {t} || ' ' || {y} end, case when regexp_matches({y}, '^[0-9]+$') then {sql_norm(t)} || ' ' || {y} end]], lambda v: v <> '')))"""  # noqa: E731
_clean = lambda x: sql_strip(f"regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '\\s*\\(.*?\\)', '', 'g'), '\\s+\\d{{4}}$', ''), '^(?:фильм|сериал|мультфильм|аниме)\\s+', '', 'i')")

ORACLES = {
    "normalize": f"select qid, {_N} as norm from train",
    "normalize_documents": f"select doc_id, length({sql_norm('text')}) as n_chars, md5({sql_norm('text')}) as digest from documents",
    "variant_form": f"select qid, {sql_strip('''regexp_replace(lower(QueryText), '[^a-zа-яё0-9\\s]', '', 'g')''')} as form from train",
    "default_process": f"select qid, lower({sql_strip('''regexp_replace(QueryText, '[^\\pL\\pM\\p{{Nd}}\\p{{Nl}}_\\p{{Pc}}\\x{{200C}}\\x{{200D}}]', ' ', 'g')'''.replace('{{', '{').replace('}}', '}'))}) as processed from train",
    "translit": f"select qid, {sql_is_latin('QueryText')} as latin, case when {sql_is_latin('QueryText')} then {sql_translit('QueryText')} else QueryText end as cyrillic from train",
    "clean_titles": f"""
with k as (select kp_id, {_clean(f"lower({sql_strip('movie')})")} as title, coalesce(year, '') as y, lower({sql_strip('movie')}) as raw from kinopoisk_top250)
select kp_id, title, {_variants('title', 'y')} as variants,
  case when {sql_norm('title')} = {sql_norm('raw')} and ((title = {sql_norm('title')} and raw <> {sql_norm('raw')}) or (length(raw) > length(title) and replace(raw, ' ', '') <> replace(title, ' ', ''))) then raw else title end as chosen
from k""",
    "phrase_match": f"""
with t as (select qid, {_N} as q, {sql_norm('Title')} as t, {sql_norm('substr(Title, 1, 2)')} as s from train where Title is not null)
select qid, t <> '' and q <> '' and contains(' ' || q || ' ', ' ' || t || ' ') as has_phrase,
  replace(s, ' ', '') <> '' and not regexp_matches(replace(s, ' ', ''), '^[0-9]+$') and length(replace(s, ' ', '')) <= 2 and not (q <> '' and s <> '' and contains(' ' || q || ' ', ' ' || s || ' ')) as vetoed
from t""",
    "common_affixes": """
with t as (select qid, QueryText as a, Title as b, least(length(QueryText), length(Title)) as n from train where Title is not null and QueryText is not null)
select qid, cast(coalesce(list_position([substr(a, i, 1) = substr(b, i, 1) for i in range(1, n + 1)], false) - 1, n) as int) as prefix,
  cast(coalesce(list_position([substr(a, length(a) + 1 - i, 1) = substr(b, length(b) + 1 - i, 1) for i in range(1, n + 1)], false) - 1, n) as int) as suffix
from t""",
    "content_type_map": f"select qid, case when {_label('ContentType')} = '' then 'прочее' else {_label('ContentType')} end as mapped, {_label('ContentType')} as label from train",
    "year_tokens": f"""
with t as (select unnest({sql_tokens(_N)}) as token from train)
select token, count(*) as n from t where regexp_matches(token, '^[0-9]{{4}}$') and try_cast(token as int) between 1950 and 2035 group by token""",
    "features18": f"""
with n as (select qid, coalesce(QueryText, '') as q, {_N} as norm from train)
select qid, length(q) as length, len({sql_tokens('norm')}) as word_count, cast(regexp_matches(q, '\\p{{Nd}}') as bigint) as has_digits,
  len(regexp_extract_all(q, '\\p{{Nd}}')) as digit_count, {sql_count('norm', L.VIDEO_MARKERS)} as video_marker_count, cast({sql_count('norm', L.VIDEO_MARKERS)} > 0 as bigint) as has_video_marker,
  {sql_count('norm', L.OTHER_MARKERS)} as non_video_marker_count, cast({sql_count('norm', L.OTHER_MARKERS)} > 0 as bigint) as has_non_video_marker,
  cast(regexp_matches(norm, '[0-9]+\\s*(?:сезон|season|s(?: |$))') as bigint) as has_season, cast(regexp_matches(norm, '[0-9]+\\s*(?:серия|эпизод|episode|eps(?: |$))') as bigint) as has_episode,
  cast(regexp_matches(norm, '(?:^| )(19[5-9][0-9]|20[0-2][0-9])(?: |$)') as bigint) as has_year,
  coalesce(try_cast(regexp_extract(norm, '([0-9]+)\\s*(?:сезон|season|s(?: |$))', 1) as bigint), 0) as season_number,
  coalesce(try_cast(regexp_extract(norm, '([0-9]+)\\s*(?:серия|эпизод|episode|eps(?: |$))', 1) as bigint), 0) as episode_number,
  cast({sql_is_latin('norm')} as bigint) as is_translit, {', '.join(f"cast({sql_count('norm', w)} > 0 as bigint) as {k}" for k, w in L.HINTS.items())} from n""",
    "heuristic_type": f"""
with n as (select qid, lower(coalesce(QueryText, '')) as low from train)
select qid, cast({sql_count('low', L.VIDEO_SIGNALS)} > {sql_count('low', L.OTHER_SIGNALS)} as int) as type_query from n""",
    "generic_query": f"""
with n as (select qid, list_distinct({sql_tokens(_N)}) as w from train),
o as (select *, len(list_filter(w, lambda t: not list_contains({sql_list(L.GENERIC_QUERY_WORDS)}, t) and not regexp_matches(t, '^[0-9]+$'))) as own from n)
select qid, own = 0 or (own <= 2 and list_has_any(w, {sql_list(L.BROAD_QUERY_WORDS)})) as generic, list_has_any(w, {sql_list(L.BROAD_CONTEXT_WORDS)}) as broad from o""",
    "ct_hint": f"with low as (select qid, lower(coalesce(QueryText, '')) as low from train), {_POINTS} select qid, label, score, dominance from h",
    "ct_calibrate": f"""
with low as (select qid, lower(coalesce(QueryText, '')) as low, case when qid % 5 > 0 then ContentType end as tt, case when qid % 7 > 1 then 'фильм' end as mt,
  case when qid % 3 = 0 then null else (qid % 10) / 10 end as margin, case when qid % 2 = 0 then 'franchise_exact' else 'raw' end as source from train), {_POINTS},
c as (select *, coalesce({_label('tt')}, '') as title, coalesce({_label('mt')}, '') as model, margin is null or margin < 0.45 as weak from h)
select qid, case when score >= 5 or (label in ('мультфильм', 'мультсериал', 'сериал') and score >= 3) or (label <> '' and dominance >= 4)
    or contains(low, 'аниме') or contains(low, 'дорама') or contains(low, 'т/с') or contains(low, 'х/ф') then label
  when (score >= 4 or (score >= 3 and dominance >= 2)) and label <> '' then label
  when title <> '' and (source = 'franchise_exact' or model = '' or weak) then title
  when model <> '' then model when title <> '' then title when label <> '' then label else 'прочее' end as content_type from c""",
    "label_filter_fill": f"select qid, coalesce(nullif(ContentType, ''), 'прочее') as content_type, {_N} as norm from train where TypeQuery = 1",
    "label_distribution": "select TypeQuery, ContentType, count(*) as n from train group by all",
    "title_mask": f"select qid from train where TypeQuery = 1 and {sql_strip('Title')} <> ''",
}
ORACLES["feature_vector"] = f"select qid, [{', '.join(f'cast({k} as double)' for k in feat.KEYS)}] as v from ({ORACLES['features18'].replace('from train', 'from test_public_queries')})"
