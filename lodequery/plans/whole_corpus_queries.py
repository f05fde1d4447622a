"""Queries on whole corpora whose SQL is long, and the SQL of catalog, title and scorer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as feat
from ..functions import lexicons as L
from ..functions import query_text as qt
from ..operators import ensemble, evaluation, graph, models, process, vectors
from ..stage import written
from . import score_queries as sq
from . import text_queries as tq
from . import title_match_queries as tm
from .text_queries import BLANK, sql_list, sql_norm, sql_strip, sql_tokens, table


def _corpus(s: SparkSession, d: str) -> DataFrame:
    return written(vectors.corpus(table(s, d, "train"), table(s, d, "title_catalog")), "corpus")


def _links(s: SparkSession, d: str) -> DataFrame:
    train = table(s, d, "train")
    return graph.title_links(written(graph.title_words(train, written(graph.top_titles(train), "top")), "words"))


def _holdout(s: SparkSession, d: str) -> DataFrame:
    """(title, n, n_valid, whole) of the groups, which are on one side each, and of the rows without a title, by their type;
    ``n_valid`` is given for the latter only, as -1 for groups."""
    rows = evaluation.group_holdout(table(s, d, "train"), "qid", F.lower(F.trim("Title")), "TypeQuery", 0.2)
    per = rows.groupBy(F.coalesce(F.lower(F.trim("Title")), F.concat(F.lit("no title "), "TypeQuery")).alias("title"), F.col("Title").isNull().alias("alone"))
    counts = per.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("valid"), 1)).alias("n_valid"))
    return counts.select("title", "n", F.when(F.col("alone"), F.col("n_valid")).otherwise(-1).alias("n_valid"), (F.col("alone") | F.col("n_valid").isin(0) | (F.col("n_valid") == F.col("n"))).alias("whole"))


def _guesses(s: SparkSession, d: str) -> DataFrame:
    """Scores of predictions made from the text alone: type by signals, label by hints, the text itself as title."""
    train = table(s, d, "train")
    hint = qt.content_type(feat.type_hint(F.col("QueryText"))["label"])
    made = train.select("qid", feat.heuristic_type(F.col("QueryText")).alias("TypeQuery"), qt.normalize(F.col("QueryText")).alias("Title"), hint.alias("ContentType"))
    got = evaluation.scores(train.withColumn("ContentType", qt.content_type(F.col("ContentType"))), made, "qid")
    return got.select(*[F.round(c, 6).alias(c) for c in ("f2", "macro_f1", "title_f1", "combined")], "n_false_positive", "n_false_negative", "n_exact_titles", "n_positive")


def _evaluated(s: SparkSession, d: str) -> DataFrame:
    """Scores of the whole cascade on a holdout of train whose titles the fitted parts have not seen."""
    rows = written(evaluation.group_holdout(table(s, d, "train"), "qid", F.lower(F.trim("Title")), "TypeQuery", 0.2), "holdout")
    held = rows.filter("valid")
    made = ensemble.predicted(held.select(F.col("qid").alias("id"), "QueryText"), table(s, d, "title_catalog"), ensemble.branches(rows.filter("not valid"), table(s, d, "title_catalog")))
    got = evaluation.scores(held, written(made.withColumnRenamed("id", "qid"), "predictions"), "qid")
    return got.select(*[F.round(c, 4).alias(c) for c in ("f2", "macro_f1", "title_f1", "combined")], "n_false_positive", "n_false_negative", "n_exact_titles", "n_positive")


def _boosted(s: SparkSession, d: str) -> DataFrame:
    """The public queries scored by the boosted model of TypeQuery."""
    model = models.type_query_model(table(s, d, "train").filter("QueryText is not null and TypeQuery is not null"), boosted=True)
    return models.type_query_scores(model, table(s, d, "test_public_queries").select("qid", "QueryText")).select("qid", F.round("score", 4).alias("score"))


def _processed(s: SparkSession, d: str) -> DataFrame:
    """Films' titles searched for in the catalog as typed, prepared by ``default_process``."""
    typed = table(s, d, "kinopoisk_top250").select(F.col("kp_id").alias("id"), F.col("movie").alias("query"))
    choices = table(s, d, "title_catalog").select("ord", F.col("title").alias("choice"))
    return process.extract_one(typed, choices, "ratio", 70, processor=qt.default_process).withColumn("score", F.round("score", 6))


QUERIES = {
    "corpus_texts": _corpus,
    "corpus_terms": lambda s, d: vectors.corpus_vocabulary(_corpus(s, d)).select("term", "df", F.round("idf", 6).alias("idf")),
    "kg_query_links": _links,
    "kg_query_edges": lambda s, d: tm._graph(s, d)[1],
    "kg_query_hop1": tm._walk(graph.one_step),
    "kg_query_hop2": tm._walk(graph.two_steps),
    "holdout_groups": _holdout,
    "evaluate_guesses": _guesses,
    "evaluate_cascade": _evaluated,
    "typequery_boosted": _boosted,
    "extract_processed": _processed,
}

_WORD = r"[\pL\pM\p{Nd}\p{Pc}]"
_NOT = r"[^\pL\pM\p{Nd}\p{Pc}]"
_YEAR = f"(?:^|{_NOT})(19[5-9][0-9]|20[0-2][0-9])(?:$|{_NOT})"
_SEASON = f"(?i)([0-9]+){BLANK}*(?:сезон|season|s(?:$|{_NOT}))"
_key = f"lower(trim({sql_strip('Title')}, ' '))"
_form = f"{sql_strip('''regexp_replace(lower(QueryText), '[^a-zа-яё0-9\\s]', '', 'g')''')}"
_parts = lambda x: f"list_filter(regexp_split_to_array({x}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
_N = sql_norm("QueryText")


def _stated(pattern: str) -> str:
    found = f"nullif(regexp_extract(coalesce(QueryText, ''), '{pattern}', 1), '')"
    return f"""
with f as (select {_key} as title, {found} as value from train where Title is not null),
r as (select title, value, row_number() over (partition by title order by count(*) desc, value) as rn from f where value is not null group by title, value)
select title, value from r where rn = 1"""


_TOP = f"""
t as (select kp_id, {tq._clean(f"lower({sql_strip('movie')})")} as title, lower(coalesce(description, '')) as about, trim(coalesce(year, ''), ' ') as y from kinopoisk_top250),
l as (select *, row_number() over (partition by title order by kp_id desc) as rn from t where title <> '')"""
_TOP_ROWS = f"""select title, case when contains(about, 'мультсериал') then 'мультсериал' when contains(about, 'мультфильм') then 'мультфильм' when contains(about, 'сериал') then 'сериал' else 'фильм' end as content_type,
  {tq._variants('title', 'y')} as variants, nullif(y, '') as year, nullif(regexp_extract(about, '{_SEASON}', 1), '') as season from l where rn = 1"""
_FILM = f"""
t as (select film_id, {tq._clean(f"lower({sql_strip('title_ru')})")} as title, {tq._clean(f"lower({sql_strip('title_en')})")} as en, lower(coalesce(Genres, '')) as g, lower(coalesce("Description Kinopoisk", '')) as about,
  trim(replace(coalesce("Year", ''), '.0', ''), ' ') as y from enriched_films),
l as (select *, row_number() over (partition by title order by film_id desc) as rn from t where not (len({_parts('title')}) < 2 and length(title) <= 5)),
film as (select title, case when contains(g, 'сериал') or contains(about, 'сериал') or contains(about, 'многосерийный') then 'сериал' else 'фильм' end as content_type,
  list_sort(list_distinct(list_concat({tq._variants('title', 'y')}, case when en <> '' then {tq._variants('en', 'y')} else [] end))) as variants,
  nullif(regexp_extract(title || ' ' || about, '{_YEAR}', 1), '') as year, nullif(regexp_extract(title || ' ' || about, '{_SEASON}', 1), '') as season from l where rn = 1)"""
_chosen = f"case when {sql_norm('a.title')} = {sql_norm('b.title')} and ((a.title = {sql_norm('a.title')} and b.title <> {sql_norm('b.title')}) or (length(b.title) > length(a.title) and replace(b.title, ' ', '') <> replace(a.title, ' ', ''))) then b.title else a.title end"
_MERGE = f"""
e as (select *, {sql_norm('title')} as form from film), b as (select unnest(min(struct_pack(title := title, content_type := content_type, variants := variants, year := year, season := season))), form from e group by form),
a as (select title, content_type, cnt, variants, year, season, {sql_norm('title')} as form from title_catalog)
select case when a.form is null then b.title when b.form is null then a.title else {_chosen} end as title,
  case when coalesce(a.content_type, '') in ('', 'прочее') and coalesce(b.content_type, '') <> '' then b.content_type else coalesce(a.content_type, b.content_type) end as content_type,
  cast(coalesce(a.cnt, 0) + case when b.form is null then 0 else 1 end as bigint) as cnt, list_sort(list_distinct(list_concat(coalesce(a.variants, []), coalesce(b.variants, [])))) as variants,
  coalesce(nullif(a.year, ''), b.year) as year, coalesce(nullif(a.season, ''), b.season) as season from a full join b on a.form = b.form"""

_links_sql = tm._links.replace(f"tw as (select distinct title, unnest({sql_tokens(sql_norm('title'))}) as word from top)", "tw as (select distinct r.title, unnest(ws) as word from rows r join top using (title))")
_graph_sql = lambda what: f"with {tm._top}, {_links_sql} {what}"

_CORPUS = f"""
k as (select {_key} as title, {_N} as text from train where Title is not null),
v as (select {_key} as title, {sql_norm('title')} as own, coalesce(variants, []) as variants from title_catalog),
x as (select title, own, unnest(variants) as y from v), o as (select title, {sql_norm('y')} as text, own from x),
every as (select title, text from k union all select title, own from v union all select title, text from o where text <> '' and text <> own),
c as (select title, text, count(*) as n from every group by all)"""
_grams = f"flatten([flatten([[substr(' ' || w || ' ', i, n) for i in range(1, length(w) + 4 - n)] for w in {sql_tokens('text')}]) for n in [1, 2]])"

_templates = {
    "фильм": ["'фильм ' || t || ' ' || n", "t || ' смотреть онлайн'"], "сериал": ["'сериал ' || t || ' ' || n", "t || ' все серии ' || n"],
    "мультсериал": ["'мультсериал ' || t", "'мультик ' || t || ' ' || n", "'аниме ' || t"], "мультфильм": ["'мультфильм ' || t || ' ' || n", "'мультик ' || t"], "прочее": ["t || ' смотреть'"],
}

#: Length of the longest common subsequence of a and b, row by row, for the pairs of q.
_lcs_step = """
step as (select id, a, b, 0 as i, [0 for j in range(0, length(b) + 1)] as r from {0}
  union all select id, a, b, i + 1, list_reduce([[j] for j in range(1, length(b) + 1)], lambda cur, j: cur || [case when substr(a, i + 1, 1) = substr(b, j[1], 1) then r[j[1]] + 1 else greatest(r[j[1] + 1], cur[len(cur)]) end], [0]) from step where i < length(a)),
l as (select id, a, b, r[len(r)] as n from step where i = length(a))"""

_processed_sql = lambda x: tq.ORACLES["default_process"].split("select qid, ")[1].split(" as processed")[0].replace("QueryText", x)

ORACLES = {
    "query_year": f"with y as (select regexp_extract(coalesce(QueryText, ''), '{_YEAR}', 1) as year from train) select year, count(*) as n from y where year <> '' group by year",
    "catalog_year": _stated(_YEAR),
    "catalog_season": _stated(_SEASON),
    "catalog_spellings": f"""
with r as (select distinct {_key} as title, {_form} as variant from train where Title is not null)
select title, variant from r where list_has_any({_parts('title')}, {_parts('variant')}) union select title, title from r""",
    "top_list_catalog": f"with {_TOP} {_TOP_ROWS}",
    "film_list_catalog": f"with {_FILM} select * from film",
    "catalog_merge": f"with {_FILM}, {_MERGE}",
    "kg_query_links": _graph_sql("select a, b, w from tl"),
    "kg_query_edges": _graph_sql("select src, dst, w from ed"),
    "kg_query_hop1": _graph_sql("select id, title, score from h1"),
    "kg_query_hop2": _graph_sql("select id, title, score from h2"),
    "kg_match": _graph_sql(f""", bo as (select id, title, sum(score) as score from (select id, title, score from h1 union all select id, title, score from h2) group by all),
kt as (select {_key} as title, {tm._kind} as ct from train where Title is not null), kk as (select title, ct, row_number() over (partition by title order by count(*) desc, ct) as rn from kt group by title, ct),
p as (select id, title, score / max(score) over (partition by id) * 0.7 as confidence, row_number() over (partition by id order by score desc, title) as place from bo)
select p.id, p.title, coalesce(ct, '') as content_type, round(confidence + 1e-12, 6) as confidence, place from p left join kk on kk.title = p.title and rn = 1 where place <= 5"""),
    "corpus_texts": f"with {_CORPUS} select title, text, n from c",
    "corpus_terms": f"""
with {_CORPUS}, g as (select n, unnest({_grams}) as term, row_number() over () as id from c), t as (select id, term, n, count(*) as k from g group by all), s as (select sum(n) as docs from c),
u as (select term, cast(sum(n) as bigint) as df, sum(n * k) as tf from t group by term)
select term, df, round(ln((1 + docs) / (1 + df)) + 1, 6) as idf from u, s where df >= 2 and df <= 0.95 * docs order by tf desc, term limit 50000""",
    "ct_augmentation": f"""
with c as (select {sql_norm('title')} as t, {tq._label('content_type')} as label from title_catalog), k as (select *, list_sum([unicode(x) for x in string_split(t, '')]) as total from c where label <> '' and t <> ''),
n as (select *, {sql_list(L.TEMPLATE_NOISE)}[cast(total % {len(L.TEMPLATE_NOISE)} as int) + 1] as n from k)
select unnest(case {' '.join(f"when label = '{x}' then [t, {', '.join(f'trim({y})' for y in ys)}]" for x, ys in _templates.items())} end) as QueryText, label from n""",
    "holdout_groups": "select coalesce(lower(trim(Title, ' ')), 'no title ' || TypeQuery) as title, count(*) as n, case when bool_or(Title is null) then cast(floor(count(*) * 0.2) as bigint) else -1 end as n_valid, true as whole from train group by 1",
    "osa_pairs": sq._ANY + """,
step as (select id, a, b, 0 as i, [j for j in range(0, length(b) + 1)] as r, cast(null as bigint[]) as o from q
  union all select id, a, b, i + 1, list_reduce([[j] for j in range(1, length(b) + 1)], lambda cur, j: cur || [least(r[j[1]] + case when substr(a, i + 1, 1) = substr(b, j[1], 1) then 0 else 1 end, r[j[1] + 1] + 1, cur[len(cur)] + 1,
    case when i > 0 and j[1] > 1 and substr(a, i + 1, 1) = substr(b, j[1] - 1, 1) and substr(a, i, 1) = substr(b, j[1], 1) then o[j[1] - 1] + 1 else 1000000 end)], [i + 1]), r from step where i < length(a)),
d as (select id, a, b, r[len(r)] as n from step where i = length(a))
select id, cast(n as double) as distance, round(1 - n / greatest(length(a), length(b)), 6) as similarity from d""",
    "extract_titles": f"""
with recursive k as (select kp_id as id, {sql_norm('movie')} as query from kinopoisk_top250), c as (select ord, {sql_norm('title')} as choice from title_catalog),
q as (select row_number() over () as id, k.id as kid, ord, query as a, choice as b from k, c where 200 * least(length(query), length(choice)) >= 70 * (length(query) + length(choice))),
{_lcs_step.format('q')},
s as (select kid, ord, q.b as choice, case when length(q.a) + length(q.b) = 0 then 100.0 else 200.0 * n / (length(q.a) + length(q.b)) end as score from q join l using (id)),
r as (select *, row_number() over (partition by kid order by score desc, ord) as rn from s where score >= 70) select kid as id, ord, choice, round(score, 6) as score from r where rn = 1""",
    "evaluate_guesses": f"""
with {sq._PRED}, {sq._FB}, {sq._CLASS}, {sq._TF1} select round((select f_beta from g), 6) as f2, round((select avg(f1) from k), 6) as macro_f1, round((select avg(f1) from f), 6) as title_f1,
  round(0.35 * (select f_beta from g) + 0.30 * (select avg(f1) from k) + 0.35 * (select avg(f1) from f), 6) as combined, (select fp from b) as n_false_positive, (select fn from b) as n_false_negative,
  (select count(*) from f where len(tw) > 0 and list_sort(tw) = list_sort(pw)) as n_exact_titles, (select count(*) from f) as n_positive""",
    "extract_processed": f"""
with recursive k as (select kp_id as id, {_processed_sql('movie')} as query from kinopoisk_top250 where movie is not null), c as (select ord, title, {_processed_sql('title')} as choice from title_catalog),
q as (select row_number() over () as id, k.id as kid, ord, title, query as a, choice as b from k, c where 200 * least(length(query), length(choice)) >= 70 * (length(query) + length(choice))),
{_lcs_step.format('q')},
s as (select kid, ord, title, case when length(q.a) + length(q.b) = 0 then 100.0 else 200.0 * n / (length(q.a) + length(q.b)) end as score from q join l using (id)),
r as (select *, row_number() over (partition by kid order by score desc, ord) as rn from s where score >= 70) select kid as id, ord, title as choice, round(score, 6) as score from r where rn = 1""",
}
