"""Queries on string scorers, search, splits and measures, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as feat
from ..functions import lexicons as L
from ..functions import query_text as qt
from ..functions import scorers
from ..operators import evaluation, process
from .text_queries import BLANK, sql_count, sql_list, sql_strip, table


def _pairs(spark: SparkSession, d: str, ascii_only: bool = False) -> DataFrame:
    """Titles of films in order of their ids with the titles of the next film; Latin and Russian, or pure ASCII."""
    films = table(spark, d, "enriched_films")
    title = F.coalesce("title_ru", "title_en") if not ascii_only else F.when(F.col("title_en").rlike("^[ -~]+$"), F.col("title_en"))
    one = films.select(F.col("film_id").alias("id"), title.alias("a"))
    two = films.select((F.col("film_id") - 1).alias("id"), title.alias("b"))
    return one.join(two, "id").filter("a is not null and b is not null")


def _scored(names: dict[str, str], ascii_only: bool = False):
    def query(spark: SparkSession, d: str) -> DataFrame:
        pairs = _pairs(spark, d, ascii_only)
        return pairs.select("id", *[F.round(scorers.column(n)(F.col("a"), F.col("b")), 6).alias(alias) for alias, n in names.items()])

    return query


def _scripts(spark: SparkSession, d: str) -> DataFrame:
    steps = _pairs(spark, d).select("id", "a", "b", F.explode(scorers.script_column()(F.col("a"), F.col("b"))).alias("s"))
    return steps.select("id", "s.tag", "s.a", "s.b")


def _alignments(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("struct<score: double, a_from: int, a_to: int, b_from: int, b_to: int>")
    def aligned(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scorers.partial_ratio_alignment(x, y) for x, y in zip(a, b)], columns=["score", "a_from", "a_to", "b_from", "b_to"])

    return _pairs(spark, d).select("id", aligned("a", "b").alias("x")).select("id", "x.*")


def _choices(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").groupBy(F.col("p_name").alias("choice")).agg(F.min("p_partkey").alias("ord"))
    return parts.select("ord", "choice")


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("query"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kinopoisk_top250").select(F.col("kp_id").alias("id"), qt.normalize(F.col("movie")).alias("query"))


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "title_catalog").select("ord", qt.normalize(F.col("title")).alias("choice"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    hint = feat.type_hint(F.col("QueryText"))["label"]
    return table(spark, d, "train").select("qid", "source", F.col("TypeQuery").alias("truth"), feat.heuristic_type(F.col("QueryText")).alias("predicted"),
                                           qt.content_type(F.col("ContentType")).alias("type"), qt.content_type(hint).alias("guess"), F.col("Title").alias("title"), qt.normalize(F.col("QueryText")).alias("span"))


def _share_score(c):
    """A score from 0 to 1 for the sweep: the share of video signals among all signals found in a lower-case text."""
    low = c
    video, other = feat.markers_in(low, L.VIDEO_SIGNALS), feat.markers_in(low, L.OTHER_SIGNALS)
    return F.when(video + other > 0, video / (video + other)).otherwise(0.5)


def _combined(spark: SparkSession, d: str) -> DataFrame:
    p = _predictions(spark, d)
    f2 = evaluation.f_beta(p, "truth", "predicted").select(F.col("f_beta").alias("f2"), F.lit(1).alias("k"))
    positive = p.filter("truth = 1")
    macro = evaluation.class_f1(positive, "type", "guess").agg(F.avg("f1").alias("macro_f1")).withColumn("k", F.lit(1))
    title = positive.agg(F.avg(evaluation.token_f1(F.col("title"), F.col("span"))).alias("title_f1")).withColumn("k", F.lit(1))
    row = f2.join(macro, "k").join(title, "k").drop("k")
    return row.select(*[F.round(c, 6).alias(c) for c in ("f2", "macro_f1", "title_f1")], F.round(evaluation.combined(F.col("f2"), F.col("macro_f1"), F.col("title_f1")), 6).alias("combined"))


QUERIES = {
    "lev_pairs": _scored({"distance": "levenshtein_distance", "similarity": "levenshtein_normalized_similarity"}, True),
    "dl_pairs": _scored({"distance": "damerau_levenshtein_distance"}, True),
    "jaro_pairs": _scored({"jaro": "jaro_similarity", "jaro_winkler": "jaro_winkler_similarity"}, True),
    "hamming_pairs": _scored({"distance": "hamming_distance"}),
    "prefix_pairs": _scored({"prefix": "prefix_similarity", "postfix": "postfix_similarity"}),
    "lcs_pairs": _scored({"lcs": "lcs_seq_similarity", "indel": "indel_distance", "ratio": "ratio"}),
    "osa_pairs": _scored({"distance": "osa_distance", "similarity": "osa_normalized_similarity"}),
    "ratio_pairs": _scored({n: n for n in scorers.RATIOS}),
    "partial_alignment_pairs": _alignments,
    "editops_pairs": _scripts,
    "extract_topk": lambda s, d: process.extract(_nations(s, d), _choices(s, d), "levenshtein_distance", 3),
    "extract_one": lambda s, d: process.extract_one(_nations(s, d), _choices(s, d), "jaro_winkler_similarity", 0.5).withColumn("score", F.round("score", 6)),
    "cdist": lambda s, d: process.cdist(_nations(s, d), _choices(s, d), "levenshtein_distance").select("id", "ord", "score"),
    "cpdist": lambda s, d: process.cpdist(_pairs(s, d, True), "a", "b", "levenshtein_distance").select("id", "score"),
    "extract_titles": lambda s, d: process.extract_one(_typed(s, d), _catalog(s, d), "ratio", 70).withColumn("score", F.round("score", 6)),
    "fbeta": lambda s, d: evaluation.f_beta(_predictions(s, d), "truth", "predicted").select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f_beta")]),
    "class_f1": lambda s, d: evaluation.class_f1(_predictions(s, d).filter("truth = 1"), "type", "guess").withColumn("f1", F.round("f1", 6)),
    "token_f1": lambda s, d: _predictions(s, d).filter("truth = 1").select("qid", F.round(evaluation.token_f1(F.col("title"), F.col("span")), 6).alias("f1")),
    "combined": _combined,
    "threshold_sweep": lambda s, d: evaluation.threshold_sweep(table(s, d, "train").select("TypeQuery", F.lower(F.coalesce("QueryText", F.lit(""))).alias("low")).select("TypeQuery", _share_score(F.col("low")).alias("score")), "TypeQuery", "score").withColumn("f_beta", F.round("f_beta", 6)),
    "split_average": lambda s, d: _predictions(s, d).filter("truth = 1").groupBy("source").agg(F.round(F.avg(evaluation.token_f1(F.col("title"), F.col("span"))), 6).alias("title_f1"), F.count(F.when(F.col("predicted") == 0, 1)).alias("missed")),
    "error_list": lambda s, d: _predictions(s, d).filter("truth <> predicted").orderBy("qid").limit(50).select("qid", "truth", "predicted", "span"),
    "stratified_split": lambda s, d: evaluation.stratified(table(s, d, "train"), "qid", "TypeQuery", 0.15).groupBy("TypeQuery").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("valid"), 1)).alias("n_valid")),
    "group_holdout": lambda s, d: evaluation.group_holdout(table(s, d, "train"), "qid", F.lower(F.trim("Title")), "TypeQuery", 0.2).select("qid", "valid"),
    "subsample": lambda s, d: evaluation.stratified(table(s, d, "train").withColumn("stratum", F.when(F.col("TypeQuery") == 1, F.concat(F.lit("1"), qt.content_type(F.col("ContentType")))).otherwise("0")), "qid", "stratum", 0.01).filter("valid").groupBy("stratum").agg(F.count(F.lit(1)).alias("n")),
}

_PAIRS = """p as (select a.film_id as id, {0} as a, {1} as b from enriched_films a join enriched_films b on b.film_id = a.film_id + 1)"""
_ASCII = "with " + _PAIRS.format(*["case when regexp_matches(%s.title_en, '^[ -~]+$') then %s.title_en end" % (x, x) for x in "ab"]) + ", q as (select * from p where a is not null and b is not null)"
_ANY = "with recursive " + _PAIRS.format(*["coalesce(%s.title_ru, %s.title_en)" % (x, x) for x in "ab"]) + ", q as (select * from p where a is not null and b is not null)"
_LCS = _ANY + """,
step as (select id, a, b, 0 as i, [0 for j in range(0, length(b) + 1)] as r from q
  union all select id, a, b, i + 1, list_reduce([[j] for j in range(1, length(b) + 1)], lambda cur, j: cur || [case when substr(a, i + 1, 1) = substr(b, j[1], 1) then r[j[1]] + 1 else greatest(r[j[1] + 1], cur[len(cur)]) end], [0]) from step where i < length(a)),
l as (select id, a, b, r[len(r)] as n from step where i = length(a))"""
_N = "coalesce(trim(regexp_replace(lower({0}), '[^a-zа-яё0-9]+', ' ', 'g')), '')"
_low = "lower(coalesce(QueryText, ''))"
_type = lambda x: f"case when lower({sql_strip(x)}) in {tuple(L.LABELS)} then lower({sql_strip(x)}) else 'прочее' end"
_pts = {x: " + ".join(["0", *[f"case when {' or '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in ws)} then {n} else 0 end" for y, n, ws in L.TYPE_POINTS if y == x]]) for x in L.LABELS}
_PRED = f"""
t as (select *, {_low} as low from train),
s as (select *, {', '.join(f'{_pts[x]} as p{i}' for i, x in enumerate(L.LABELS))} from t),
u as (select * replace (p1 + case when p0 = 0 and p3 = 0 and regexp_matches(low, '19[5-9][0-9]|20[0-2][0-9]|2030') then 1 else 0 end as p1) from s),
p as (select qid, source, TypeQuery as truth, cast({sql_count('low', L.VIDEO_SIGNALS)} > {sql_count('low', L.OTHER_SIGNALS)} as int) as predicted, {_type('ContentType')} as type, Title as title, {_N.format('QueryText')} as span,
  case {' '.join(f"when p{i} = greatest(p0, p1, p2, p3, p4) and p{i} > 0 then '{x}'" for i, x in enumerate(L.LABELS))} else 'прочее' end as guess from u)"""
_words = lambda x: f"list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '{BLANK}+', ' ', 'g'), ' '), lambda w: w <> ''))"
_TF1 = f"""
w as (select *, {_words('title')} as tw, {_words('span')} as pw from p where truth = 1),
f as (select *, case when len(tw) = 0 and len(pw) = 0 then 1.0 when len(list_intersect(tw, pw)) = 0 then 0.0 else 2.0 * len(list_intersect(tw, pw)) / (len(tw) + len(pw)) end as f1 from w)"""
_CLASS = f"""
c as (select label, count(*) filter (type = label) as t, count(*) filter (guess = label) as g, count(*) filter (type = label and guess = label) as hits
  from (select unnest({sql_list(L.LABELS)}) as label) x left join (select * from p where truth = 1) y on y.type = label or y.guess = label group by label),
k as (select label, t as support, case when t + g > 0 then 2.0 * hits / (t + g) else 0.0 end as f1 from c)"""
_FB = """
b as (select count(*) filter (truth = 1 and predicted = 1) as tp, count(*) filter (truth = 0 and predicted = 1) as fp, count(*) filter (truth = 1 and predicted = 0) as fn from p),
e as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall from b),
g as (select *, case when precision + recall > 0 then 5 * precision * recall / (4 * precision + recall) else 0.0 end as f_beta from e)"""
_CH = "ch as (select p_name as choice, min(p_partkey) as ord from part group by 1), qu as (select n_nationkey as id, lower(n_name) as query from nation)"

ORACLES = {
    "lev_pairs": _ASCII + " select id, cast(levenshtein(a, b) as double) as distance, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) as similarity from q",
    "dl_pairs": _ASCII + " select id, cast(damerau_levenshtein(a, b) as double) as distance from q",
    "jaro_pairs": _ASCII + " select id, round(jaro_similarity(a, b), 6) as jaro, round(jaro_winkler_similarity(a, b), 6) as jaro_winkler from q",
    "hamming_pairs": _ANY + " select id, cast(len([i for i in range(1, greatest(length(a), length(b)) + 1) if substr(a, i, 1) <> substr(b, i, 1)]) as double) as distance from q",
    "prefix_pairs": _ANY + """ select id, cast(coalesce(list_position([substr(a, i, 1) = substr(b, i, 1) for i in range(1, least(length(a), length(b)) + 1)], false) - 1, least(length(a), length(b))) as double) as prefix,
  cast(coalesce(list_position([substr(a, length(a) + 1 - i, 1) = substr(b, length(b) + 1 - i, 1) for i in range(1, least(length(a), length(b)) + 1)], false) - 1, least(length(a), length(b))) as double) as postfix from q""",
    "lcs_pairs": _LCS + " select id, cast(n as double) as lcs, cast(length(a) + length(b) - 2 * n as double) as indel, round(200.0 * n / (length(a) + length(b)), 6) as ratio from l",
    "extract_topk": f"with {_CH}, s as (select id, ord, choice, cast(levenshtein(query, choice) as double) as score from qu, ch), r as (select *, row_number() over (partition by id order by score, ord) as place from s) select * from r where place <= 3",
    "extract_one": f"with {_CH}, s as (select id, ord, choice, jaro_winkler_similarity(query, choice) as score from qu, ch), r as (select *, row_number() over (partition by id order by score desc, ord) as place from s where score >= 0.5) select id, ord, choice, round(score, 6) as score from r where place = 1",
    "cdist": f"with {_CH} select id, ord, cast(levenshtein(query, choice) as double) as score from qu, ch",
    "cpdist": _ASCII + " select id, cast(levenshtein(a, b) as double) as score from q",
    "fbeta": f"with {_PRED}, {_FB} select tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f_beta, 6) as f_beta from g",
    "class_f1": f"with {_PRED}, {_CLASS} select label, support, round(f1, 6) as f1 from k",
    "token_f1": f"with {_PRED}, {_TF1} select qid, round(f1, 6) as f1 from f",
    "combined": f"""with {_PRED}, {_FB}, {_CLASS}, {_TF1}, z as (select (select f_beta from g) as f2, (select avg(f1) from k) as macro_f1, (select avg(f1) from f) as title_f1)
select round(f2, 6) as f2, round(macro_f1, 6) as macro_f1, round(title_f1, 6) as title_f1, round(0.35 * f2 + 0.30 * macro_f1 + 0.35 * title_f1, 6) as combined from z""",
    "threshold_sweep": f"""
with c as (select TypeQuery as t, {sql_count(_low, L.VIDEO_SIGNALS)} as v, {sql_count(_low, L.OTHER_SIGNALS)} as o from train),
s as (select t, case when v + o > 0 then v / (v + o) else 0.5 end as score from c), m as (select cast(unnest(range(10, 90)) as int) as percent),
n as (select percent, count(*) filter (t = 1 and floor(round(score * 100, 9)) >= percent) as tp, count(*) filter (t = 0 and floor(round(score * 100, 9)) >= percent) as fp, count(*) filter (t = 1) as pos from s, m group by percent)
select percent, round(case when 5 * tp + 4 * (pos - tp) + fp > 0 then 5.0 * tp / (5 * tp + 4 * (pos - tp) + fp) else 0.0 end, 6) as f_beta from n""",
    "split_average": f"with {_PRED}, {_TF1} select source, round(avg(f1), 6) as title_f1, count(*) filter (predicted = 0) as missed from f group by source",
    "error_list": f"with {_PRED} select qid, truth, predicted, span from p where truth <> predicted order by qid limit 50",
    "stratified_split": "select TypeQuery, count(*) as n, cast(floor(count(*) * 0.15) as bigint) as n_valid from train group by 1",
    "subsample": f"with s as (select case when TypeQuery = 1 then '1' || {_type('ContentType')} else '0' end as stratum from train) select stratum, cast(floor(count(*) * 0.01) as bigint) as n from s group by 1 having floor(count(*) * 0.01) > 0",
}
