"""Queries on catalogs, matching, retrieval, prototypes, graphs, the cascade, models, sources and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import query_text as qt
from ..operators import catalog as cat
from ..operators import ensemble, evaluation, graph, matching, models, retrieval, vectors
from ..sources import tables
from ..stage import new_path, written
from ..streaming import scoring
from .text_queries import sql_count, sql_list, sql_norm, sql_strip, sql_tokens, table


def _train(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "train")


def _catalog(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "title_catalog")


def _asked(s: SparkSession, d: str) -> DataFrame:
    return _train(s, d).select(F.col("qid").alias("id"), F.col("QueryText").alias("query"))


def _public(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "test_public_queries").select(F.col("qid").alias("id"), qt.in_cyrillic(F.col("QueryText")).alias("query"))


def _match(step):
    return lambda s, d: step(_asked(s, d), _catalog(s, d)).select("id", "title", "content_type", F.round("confidence", 6).alias("confidence"), "match_type")


def _leaders(s: SparkSession, d: str) -> DataFrame:
    """The titles of train by normal form, in the order of their first rows."""
    keys = cat.grouped(_train(s, d)).select("ord", qt.normalize(F.col("title")).alias("title"), "cnt").filter("title <> ''")
    titles = written(keys.groupBy("title").agg(F.min("ord").alias("ord"), F.sum("cnt").alias("cnt")), "titles")
    return cat.clustered(titles, cat.leaders(titles, cat.similar_pairs(titles)))


def _merge(s: SparkSession, d: str) -> DataFrame:
    extra = cat.film_list(table(s, d, "enriched_films"))
    one = extra.withColumn("form", qt.normalize(F.col("title"))).groupBy("form").agg(F.min(F.struct("title", "content_type", "variants", "year", "season")).alias("x")).select("x.*").withColumn("cnt", F.lit(1))
    return cat.merged(_catalog(s, d).select("title", "content_type", "cnt", "variants", "year", "season"), one)


def _typos(s: SparkSession, d: str) -> DataFrame:
    choices = _catalog(s, d).select("ord", qt.normalize(F.col("title")).alias("choice"))
    return cat.typo_dictionary(_train(s, d), choices).withColumn("score", F.round("score", 6))


def _spans(s: SparkSession, d: str) -> DataFrame:
    found = matching.cascade(_public(s, d), _catalog(s, d))
    return found.join(_public(s, d), "id").select("id", "title", matching.span(F.col("query"), F.col("title")).alias("span"))


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return _train(s, d).select("qid", retrieval.parsed(qt.normalize(F.col("QueryText"))).alias("x")).select("qid", "x.candidate", "x.span", "x.plausible", "x.acceptable")


def _prefixes(s: SparkSession, d: str) -> DataFrame:
    return _train(s, d).select("qid", retrieval.parsed(qt.normalize(F.col("QueryText"))).alias("x")).select("qid", F.posexplode("x.prefixes").alias("at", "variant"))


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "test_public_queries").select(F.col("qid").alias("id"), F.col("QueryText").alias("text"))


def _terms(s: SparkSession, d: str) -> DataFrame:
    docs = _documents(s, d)
    return vectors.vocabulary(written(vectors.term_counts(docs), "terms"), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


def _term_weights(s: SparkSession, d: str) -> DataFrame:
    docs = _documents(s, d)
    counts = written(vectors.term_counts(docs), "terms")
    return vectors.weights(counts, vectors.vocabulary(counts, docs.count())).select("id", "term", F.round("w", 6).alias("w"))


def _nearest(s: SparkSession, d: str) -> DataFrame:
    docs = written(vectors.corpus(_train(s, d), _catalog(s, d)), "corpus")
    vocab = written(vectors.corpus_vocabulary(docs), "vocab")
    protos = written(vectors.corpus_prototypes(docs, vocab), "protos")
    return vectors.nearest(_documents(s, d), protos, vocab).withColumn("score", F.round("score", 4))


def _dense(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    return vectors.dense_nearest(v, "vec_id", "embedding", vectors.dense_centroids(v, "label", "embedding"), "label").withColumn("score", F.round("score", 6))


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(top titles, edges, nodes); nothing but the words of titles is written before one of them is used."""
    top = written(graph.top_titles(_train(s, d)), "top")
    every = written(graph.title_words(_train(s, d), top), "words")
    words = graph.word_links(every)
    return top, graph.edges(words, graph.title_links(every)), graph.nodes(words, top)


def _title_links(s: SparkSession, d: str) -> DataFrame:
    return graph.title_links(written(graph.title_words(_train(s, d), graph.top_titles(_train(s, d))), "words"))


def _words_of(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "test_public_queries").select(F.col("qid").alias("id"), F.explode(F.array_distinct(qt.tokens(qt.normalize(F.col("QueryText"))))).alias("word"))


def _walk(step):
    def query(s: SparkSession, d: str) -> DataFrame:
        _, links, kinds = _graph(s, d)
        return step(_words_of(s, d), written(links, "edges"), written(kinds, "nodes"))

    return query


def _graph_top(s: SparkSession, d: str) -> DataFrame:
    _, links, kinds = _graph(s, d)
    links, kinds = written(links, "edges"), written(kinds, "nodes")
    types = cat.grouped(_train(s, d)).select("title", "content_type")
    return graph.matched(_documents(s, d).withColumnRenamed("text", "query"), links, kinds, types).withColumn("confidence", F.round("confidence", 6))


def _agreed(s: SparkSession, d: str) -> DataFrame:
    parts = ensemble.branches(_train(s, d), _catalog(s, d), with_models=False)
    asked = _public(s, d)
    near = ensemble.named(vectors.nearest(asked.select("id", F.col("query").alias("text")), parts["protos"], parts["vocab"]), _catalog(s, d), parts["types"])
    walked = graph.matched(asked, parts["links"], parts["kinds"], parts["types"])
    return ensemble.aggregated(ensemble.candidates(matching.cascade(asked, _catalog(s, d)), near, walked))


def _predicted(s: SparkSession, d: str) -> DataFrame:
    parts = ensemble.branches(_train(s, d), _catalog(s, d))
    return ensemble.predicted(table(s, d, "test_public_queries").withColumnRenamed("qid", "id"), _catalog(s, d), parts)


def _type_model(s: SparkSession, d: str) -> DataFrame:
    """Scores of the public queries, with the threshold of best F2 on a holdout the model has not seen."""
    rows = _train(s, d).filter("QueryText is not null").withColumn("held", evaluation.in_share(F.xxhash64("QueryText"), 0.15))
    model = models.type_query_model(rows.filter("not held"))
    sweep = evaluation.threshold_sweep(models.type_query_scores(model, rows.filter("held").select("QueryText", "TypeQuery")), "TypeQuery", "score")
    best = sweep.agg(F.min(F.struct((-F.col("f_beta")).alias("f"), "percent")).alias("x")).first()["x"]["percent"]
    scored = models.type_query_scores(model, table(s, d, "test_public_queries"))
    return scored.select("qid", F.round("score", 4).alias("score"), (F.col("score") >= best / 100).cast("int").alias("type_query"))


def _kind_model(s: SparkSession, d: str) -> DataFrame:
    model, names = models.content_type_model(_train(s, d), _catalog(s, d))
    return models.content_type_predictions(model, names, table(s, d, "test_public_queries")).select("qid", "label", F.round("margin", 4).alias("margin"))


def _csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "labelled-csv")
    rows = _train(s, d).select("QueryText", "TypeQuery", "Title", "ContentType").filter("QueryText is not null")
    tables.write_csv(rows, path, "\\N")
    return tables.read_csv(s, path, tables.LABELLED, "\\N").groupBy("TypeQuery").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("QueryText").alias("n_queries"), F.count("Title").alias("n_titles"))


def _translated(s: SparkSession, d: str) -> DataFrame:
    films = table(s, d, "enriched_films")
    names = films.filter("title_ru is not null and title_en is not null").groupBy(F.lower(F.trim("title_ru")).alias("key")).agg(F.min("title_en").alias("value"))
    rows = _catalog(s, d).select("ord", F.lower("title").alias("title"))
    return tables.with_translations(rows, "title", names)


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The public queries scored as a stream of files, read back."""
    src, out = new_path(s, "arrivals"), new_path(s, "scored")
    rows = table(s, d, "test_public_queries")
    rows.repartition(4).write.parquet(src)
    scoring.run_once(scoring.scored(scoring.read_queries(s, src, rows.schema), _catalog(s, d)), out, new_path(s, "progress"))
    return s.read.parquet(out)


QUERIES = {
    "catalog_group": lambda s, d: cat.grouped(_train(s, d)),
    "catalog_spellings": lambda s, d: cat.spellings(_train(s, d)),
    "catalog_year": lambda s, d: cat.stated_mode(_train(s, d), cat.YEAR),
    "catalog_season": lambda s, d: cat.stated_mode(_train(s, d), cat.SEASON),
    "variant_map": lambda s, d: cat.variant_map(_catalog(s, d), qt.normalize),
    "bag_map": lambda s, d: cat.variant_map(_catalog(s, d), cat.bag),
    "first_variant_map": lambda s, d: cat.variant_map(_catalog(s, d), qt.normalize, last=False),
    "leader_cluster": _leaders,
    "top_list_catalog": lambda s, d: cat.top_list(table(s, d, "kinopoisk_top250")),
    "film_list_catalog": lambda s, d: cat.film_list(table(s, d, "enriched_films")),
    "catalog_merge": _merge,
    "typo_dictionary": _typos,
    "fix_typos": lambda s, d: cat.corrected(table(s, d, "test_public_queries").select("qid", qt.normalize(F.col("QueryText")).alias("query")), "query", _typos(s, d)),
    "match_exact": _match(matching.exact),
    "match_same_words": _match(matching.same_words),
    "match_contained": _match(matching.contained),
    "match_cascade": lambda s, d: matching.cascade(_public(s, d), _catalog(s, d)).withColumn("confidence", F.round("confidence", 6)),
    "match_span": _spans,
    "query_year": lambda s, d: _train(s, d).select("qid", F.regexp_extract(F.coalesce("QueryText", F.lit("")), cat.YEAR, 1).alias("year")).filter("year <> ''").groupBy("year").agg(F.count(F.lit(1)).alias("n")),
    "noise_filter": lambda s, d: _train(s, d).select("qid", matching.without_noise(qt.normalize(F.col("QueryText"))).alias("kept")),
    "title_candidates": _candidates,
    "candidate_prefixes": _prefixes,
    "retrieval": lambda s, d: retrieval.retrieved(_public(s, d), _catalog(s, d)).withColumn("confidence", F.round("confidence", 6)),
    "tfidf_terms": _terms,
    "tfidf_weights": _term_weights,
    "prototype_nearest": _nearest,
    "prototype_cosine_top3": _dense,
    "kg_top_titles": lambda s, d: graph.top_titles(_train(s, d)),
    "kg_edges": lambda s, d: _graph(s, d)[1],
    "kg_nodes": lambda s, d: _graph(s, d)[2],
    "kg_title_edges": _title_links,
    "kg_hop1": _walk(graph.one_step),
    "kg_hop2": _walk(graph.two_steps),
    "kg_match": _graph_top,
    "aggregate_branches": _agreed,
    "predict_cascade": _predicted,
    "ct_augmentation": lambda s, d: models.augmented(_catalog(s, d)),
    "typequery_model": _type_model,
    "ct_model": _kind_model,
    "csv_round_trip": _csv_round_trip,
    "translation_lookup": _translated,
    "stream_scoring": _stream,
    "windowed_counts": lambda s, d: scoring.windowed_counts(_train(s, d), "log_ts", "source", "1 day"),
}

_key = f"lower(trim({sql_strip('Title')}, ' '))"
_N = sql_norm("QueryText")
_kind = f"case when lower({sql_strip('ContentType')}) in {tuple(L.LABELS)} then lower({sql_strip('ContentType')}) else 'прочее' end"
_each = "e as (select title, ord, content_type, unnest(list_distinct(list_concat(coalesce(variants, []), [title]))) as v from title_catalog)"
_bag = lambda x: f"array_to_string(list_sort({sql_tokens(sql_norm(x))}), ' ')"
_map = lambda form, order: f"with {_each}, f as (select {form} as form, title, ord from e), r as (select *, row_number() over (partition by form order by ord {order}) as rn from f where form <> '') select form, title, ord from r where rn = 1"
_QBAG = _bag("QueryText")
_top = f"top as (select {_key} as title, count(*) as cnt from train where Title is not null group by 1 order by cnt desc, title limit 500)"
_links = f"""
rows as (select {_key} as title, list_distinct({sql_tokens(_N)}) as ws from train where Title is not null),
wl as (select title, word, count(*) as w from (select r.title, unnest(ws) as word from rows r join top using (title)) where length(word) >= 3 group by all),
tw as (select distinct title, unnest({sql_tokens(sql_norm('title'))}) as word from top),
tl as (select x.title as a, y.title as b, count(*) as w from tw x join tw y on x.word = y.word and x.title < y.title group by all),
half as (select title as src, word as dst, w from wl union all select a, b, w from tl),
ed as (select src, dst, cast(sum(w) as bigint) as w from (select * from half union all select dst, src, w from half) group by all),
nd as (select distinct word as node, 'token' as node_type from wl union all select title, 'title' from top where title not in (select word from wl)),
ask as (select distinct qid as id, unnest({sql_tokens(_N)}) as word from test_public_queries),
h1 as (select id, dst as title, cast(sum(w) as double) as score from ask join ed on src = word join nd on node = dst and node_type = 'title' group by all),
md as (select a.id, e.dst as mid from ask a join ed e on e.src = a.word join nd on node = e.dst and node_type = 'token' where not exists (select 1 from ask b where b.id = a.id and b.word = e.dst)),
h2 as (select id, e.dst as title, sum(w) * 0.5 as score from md join ed e on e.src = mid join nd on node = e.dst and node_type = 'title' group by all)"""
_grams = lambda x: f"flatten([flatten([[substr(' ' || w || ' ', i, n) for i in range(1, length(w) + 4 - n)] for w in {sql_tokens(sql_norm(x))}]) for n in [1, 2]])"
_tf = f"""g as (select qid as id, unnest({_grams('QueryText')}) as term from test_public_queries), c as (select id, term, count(*) as tf from g group by all),
n as (select count(*) as n from test_public_queries), vo as (select term, count(*) as df, sum(tf) as tf from c group by term),
v as (select term, df, ln((1 + n) / (1 + df)) + 1 as idf from vo, n where df >= 2 and df <= 0.95 * n order by tf desc, term limit 50000)"""

ORACLES = {
    "catalog_group": f"""
with t as (select {_key} as title, qid, {_kind} as ct from train where Title is not null),
k as (select title, ct, row_number() over (partition by title order by count(*) desc, ct) as rn from t group by title, ct)
select a.*, k.ct as content_type from (select title, min(qid) as ord, count(*) as cnt from t group by title) a join k on k.title = a.title and rn = 1""",
    "variant_map": _map(sql_norm("v"), "desc"),
    "bag_map": _map(_bag("v"), "desc"),
    "first_variant_map": _map(sql_norm("v"), "asc"),
    "match_exact": f"""
with {_each}, f as (select {sql_norm('v')} as form, title, content_type, row_number() over (partition by {sql_norm('v')} order by ord desc) as rn from e)
select qid as id, f.title, f.content_type, 0.95 as confidence, 'exact' as match_type from train join f on form = {_N} and rn = 1 and form <> ''""",
    "match_same_words": f"""
with {_each}, f as (select {_bag('v')} as form, title, content_type, row_number() over (partition by {_bag('v')} order by ord desc) as rn from e)
select qid as id, f.title, f.content_type, 0.9 as confidence, 'lemma_match' as match_type from train join f on form = {_QBAG} and rn = 1 and form <> ''""",
    "match_contained": f"""
with {_each}, f as (select {_bag('v')} as form, title, ord, content_type, row_number() over (partition by {_bag('v')} order by ord desc) as rn from e),
w as (select *, list_distinct(string_split(form, ' ')) as ws from f where rn = 1 and form <> ''), q as (select distinct {_N} as norm, list_distinct({sql_tokens(_N)}) as have from train),
x as (select norm, title, content_type, ws, row_number() over (partition by norm order by len(ws) desc, ord) as rn from q join w on len(ws) >= 2 and len(have) >= 2 and list_has_all(have, ws))
select qid as id, x.title, x.content_type, 0.85 as confidence, 'lemma_overlap' as match_type from train join x on norm = {_N} and x.rn = 1""",
    "noise_filter": f"select qid, case when len(list_filter({sql_tokens(_N)}, lambda w: not list_contains({sql_list(L.FUZZY_NOISE)}, w))) > 0 then array_to_string(list_filter({sql_tokens(_N)}, lambda w: not list_contains({sql_list(L.FUZZY_NOISE)}, w)), ' ') else {_N} end as kept from train",
    "tfidf_terms": f"with {_tf} select term, df, round(idf, 6) as idf from v",
    "tfidf_weights": f"with {_tf}, r as (select id, c.term, c.tf * idf as w from c join v using (term)), m as (select id, sqrt(sum(w * w)) as norm from r group by id) select id, term, round(w / norm, 6) as w from r join m using (id)",
    "prototype_cosine_top3": """
with x as (select vec_id, label, unnest(embedding) as v, generate_subscripts(embedding, 1) as k from embeddings), c as (select label, k, avg(cast(v as double)) as w from x group by all),
s as (select x.vec_id, c.label, sum(cast(x.v as double) * c.w) / sqrt(sum(cast(x.v as double) * cast(x.v as double)) * sum(c.w * c.w)) as score from x join c using (k) group by all),
r as (select *, row_number() over (partition by vec_id order by score desc, label) as place from s) select vec_id, label, round(score, 6) as score, place from r where place <= 3""",
    "kg_top_titles": f"with {_top} select * from top",
    "kg_edges": f"with {_top}, {_links} select src, dst, w from ed",
    "kg_nodes": f"with {_top}, {_links} select node, node_type from nd",
    "kg_title_edges": f"with {_top}, {_links} select a, b, w from tl",
    "kg_hop1": f"with {_top}, {_links} select id, title, score from h1",
    "kg_hop2": f"with {_top}, {_links} select id, title, score from h2",
    "csv_round_trip": "select TypeQuery, count(*) as n, count(distinct QueryText) as n_queries, count(Title) as n_titles from train where QueryText is not null group by 1",
    "translation_lookup": """
with n as (select lower(trim(title_ru, ' ')) as key, min(title_en) as value from enriched_films where title_ru is not null and title_en is not null group by 1)
select ord, lower(title) as title, coalesce(value, '') as EnglishTitle from title_catalog left join n on key = lower(title)""",
    "windowed_counts": f"""
select date_trunc('day', log_ts) as start, source, count(*) as n, cast(sum(cast({sql_count("lower(coalesce(QueryText, ''))", L.VIDEO_SIGNALS)} > {sql_count("lower(coalesce(QueryText, ''))", L.OTHER_SIGNALS)} as int)) as bigint) as n_video
from train where log_ts is not null group by all""",
}
