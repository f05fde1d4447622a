"""Queries of the training-data operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stage import new_path, written
from ..text import title_key, word_bag
from . import canonical, language, leakage, linkage, overlap, packing, records, splits, terms

# The invisible characters, as an RE2 class.
_WORDS = r"regexp_extract_all(lower(regexp_replace({0}, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}\x{{00AD}}]', '', 'g')), '[\pL\p{{Nd}}]+')"


def _words_sql(column: str) -> str:
    return _WORDS.format(column)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _term_counts(spark: SparkSession, d: str) -> terms.TermCounts:
    """All of train, merged as it arrived: rows with a known load time first, then those loaded at an unknown time."""
    train = _table(spark, d, "train")
    store = terms.TermCounts(spark, new_path(spark, "term-counts"))
    store.merge(terms.term_deltas(train.filter("load_ts is not null"), "QueryText"))
    store.merge(terms.term_deltas(train.filter("load_ts is null"), "QueryText"))
    return store


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    store = _term_counts(spark, d)
    return terms.marked(store.counts(), store.total())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_terms(spark, d).filter("mark is not null").select("term", "mark")


def p1_changes(spark: SparkSession, d: str) -> DataFrame:
    """The counts after a change of the log: all of train is counted, then its test rows are withdrawn and queries without text
    get their title, and only the signed changes are merged."""
    train = _table(spark, d, "train").select("qid", "QueryText", "Title", "split")
    now = train.filter("split is null or split <> 'test'").select("qid", F.coalesce("QueryText", "Title").alias("QueryText"))
    store = terms.TermCounts(spark, new_path(spark, "changed-counts"))
    store.merge(terms.term_deltas(train, "QueryText"))
    store.merge(terms.term_deltas(terms.signed_changes(train, now, "qid", "QueryText"), "text", F.col("sign")))
    return terms.marked(store.counts(), store.total())


def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    """(qid, split, source, kind) of the evaluation rows that training holds."""
    train = _table(spark, d, "train").filter("split is not null").withColumn("is_eval", F.col("split") != "train")
    rows = overlap.canonical_rows(train, "QueryText", ["qid", "split", "source", "is_eval"])
    return overlap.eval_rows(rows, overlap.overlapping(rows)).select("qid", "split", "source", "kind")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_rows(spark, d).select("qid")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return p5_rows(spark, d).groupBy("split", "source", "kind").agg(F.count(F.lit(1)).alias("n_rows"))


def p6_mapped(spark: SparkSession, d: str) -> DataFrame:
    """(qid, value, whole, ord, score) of all rows whose title or query needs mapping; null ord: no entry."""
    train, catalog = _table(spark, d, "train"), _table(spark, d, "title_catalog")
    entries = catalog.select("ord", "title", F.concat(F.array("title"), F.coalesce("variants", F.array().cast("array<string>"))).alias("spellings"))
    whole = F.col("Title").isNotNull()
    value = F.when(whole, title_key(F.col("Title"))).when(F.col("TypeQuery") == 1, F.col("QueryText"))
    return canonical.mapped(train, "qid", value, whole, entries, F.lower("title")).withColumnRenamed("id", "qid")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = p6_mapped(spark, d).filter("whole or ord is not null")
    return rows.select(F.coalesce("ord", F.lit(-1).cast("long")).alias("ord"), "qid")


def p6_unlisted(spark: SparkSession, d: str) -> DataFrame:
    """(value, n_rows): the title keys that mean no entry."""
    return p6_mapped(spark, d).filter("whole and ord is null").groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"))


def _p7_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "train").select("qid", "QueryText", F.to_date("log_ts").alias("day")).filter(F.col("day").isNotNull() & word_bag(F.col("QueryText")).isNotNull())
    return records.rooted(rows, F.struct("day", "QueryText"), ["QueryText"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return records.copies(_p7_rows(spark, d), "qid").select(F.col("keep").alias("keep_qid"), F.col("copy").alias("copy_qid"))


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    return records.collapsed(_p7_rows(spark, d), "qid").select(F.col("keep").alias("keep_qid"), F.col("n_rows").alias("n_copies"))


def _year(c: str):
    return F.try_to_number(F.regexp_extract(c, r"((?:19|20)\d\d)", 1), F.lit("9999")).cast("int")


def p2_references(spark: SparkSession, d: str) -> DataFrame:
    """(ref, source, titles, year, kind) of the three sources; one row for each distinct title key of train."""
    films, top, train = _table(spark, d, "enriched_films"), _table(spark, d, "kinopoisk_top250"), _table(spark, d, "train")
    none = F.lit(None)
    original = F.nullif(F.regexp_extract("description", r"Ориг\. название: ([^.]+)", 1), F.lit(""))
    e = films.select(F.concat(F.lit("e:"), F.col("film_id")).alias("ref"), F.lit("e").alias("source"), F.array("title_ru", "title_en").alias("titles"), _year("Year").alias("year"), none.cast("string").alias("kind"))
    k = top.select(F.concat(F.lit("k:"), F.col("kp_id")).alias("ref"), F.lit("k").alias("source"), F.array("movie", original).alias("titles"), _year("year").alias("year"), none.cast("string").alias("kind"))
    # the year that a title's queries name most often, the least of several
    typed = train.select(title_key(F.col("Title")).alias("title"), _year("QueryText").alias("said")).filter("title is not null")
    typed = typed.groupBy("title", "said").agg(F.count(F.lit(1)).alias("n"))
    t = typed.groupBy("title").agg(F.min(F.when(F.col("said").isNotNull(), F.struct((-F.col("n")).alias("n"), "said"))).alias("most"))
    own = F.coalesce(_year("title"), F.col("most.said"))
    t = t.select(F.concat(F.lit("t:"), F.col("title")).alias("ref"), F.lit("t").alias("source"), F.array("title").alias("titles"), own.alias("year"), none.cast("string").alias("kind"))
    return e.unionByName(k).unionByName(t)


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return linkage.linked(linkage.prepared(p2_references(spark, d)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pairs(spark, d).select("ref_a", "ref_b")


def _p4(spark: SparkSession, d: str) -> DataFrame:
    train = _table(spark, d, "train")
    slices, found = splits.grouped(train, "qid", [title_key(F.col("Title")), word_bag(F.col("QueryText"))], ["split"])
    return splits.slice_groups(slices, found)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    groups = _p4(spark, d).groupBy("component").agg(F.min("least").alias("group_qid"), F.min("split").alias("a"), F.max("split").alias("b"))
    return groups.filter("a <> b").select("group_qid")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """(component, split, n): where each group of tied rows goes, and its rows."""
    groups = written(_p4(spark, d).groupBy("component").agg(F.sum("n").alias("n")), "groups")
    return splits.assigned(groups, {"train": 0.8, "valid": 0.1, "test": 0.1}).join(groups, "component")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """(n_rows, n_titles_apart, n_bags_apart, near) of the new splits: rows placed, title keys and bags of words that have rows in
    two splits, and whether every split has its share of the rows within one in a hundred."""
    placed = written(p4_splits(spark, d), "placed")
    total = placed.agg(F.sum("n").alias("n_rows"), *[F.sum(F.when(F.col("split") == x, F.col("n")).otherwise(0)).alias(x) for x in ("train", "valid", "test")])
    near = (F.abs(F.col("train") / F.col("n_rows") - 0.8) <= 0.01) & (F.abs(F.col("valid") / F.col("n_rows") - 0.1) <= 0.01) & (F.abs(F.col("test") / F.col("n_rows") - 0.1) <= 0.01)
    slices = _p4(spark, d).join(placed.select("component", F.col("split").alias("new")), "component")
    apart = lambda key: slices.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("new").alias("a"), F.max("new").alias("b")).agg(F.count(F.when(F.col("a") != F.col("b"), 1)))
    titles, bags = apart("k0").toDF("n_titles_apart"), apart("k1").toDF("n_bags_apart")
    return total.select("n_rows", near.alias("near")).crossJoin(F.broadcast(titles)).crossJoin(F.broadcast(bags))  # one row each


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(packing.pieces(_table(spark, d, "documents"), "doc_id", packing.byte_tokens(F.col("text"))))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).filter("n_pieces > 1 and piece = 0").select(F.col("id").alias("doc_id"))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("id", "doc_id")


def p8_sequences(spark: SparkSession, d: str) -> DataFrame:
    """How full the sequences are: one row by number of full tenths."""
    bins = _packed(spark, d).groupBy("shard", "bin").agg(F.sum("tokens").alias("tokens"))
    return bins.groupBy((F.floor(F.col("tokens") * 10 / 8192)).alias("tenths")).agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("tokens").alias("n_tokens"))


def p8_totals(spark: SparkSession, d: str) -> DataFrame:
    """(n_docs, n_pieces, n_tokens, n_over, n_split): what the packing of whole documents holds, how many sequences exceed their
    capacity, and how many documents no longer than a sequence were cut."""
    got = _packed(spark, d)
    bins = got.groupBy("shard", "bin").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("s"))
    over = bins.agg(F.sum("t").alias("n_tokens"), F.sum("s").alias("n_pieces"), F.count(F.when(F.col("t") > 8192, 1)).alias("n_over"))
    whole = got.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    return over.crossJoin(F.broadcast(whole.agg(F.count(F.lit(1)).alias("n_docs"), F.count(F.when((F.col("n") > 1) & (F.col("t") <= 8192), 1)).alias("n_split"))))


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """(n_items, n_tokens, n_over, n_least, near_least) of a packing of paragraphs in which all three limits bind: at most 24 to
    a sequence, and 6 144 loss-bearing tokens, those of all paragraphs but each document's first. ``n_over`` counts sequences
    beyond a limit, ``n_least`` is the number of sequences that the sums of the demands need at least, ``near_least`` tells
    whether there are at most a tenth more."""
    docs = _table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("no", "text"))
    n = packing.byte_tokens(F.col("text"))
    items = docs.select(F.concat_ws("/", "doc_id", "no").alias("id"), n.alias("n"), F.when(F.col("no") > 0, n).otherwise(0).alias("loss"))
    got = packing.packed(packing.pieces(items, "id", F.col("n"), F.col("loss")), max_segments=24, max_loss=6144)
    bins = got.groupBy("shard", "bin").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("s"), F.sum("loss").alias("l"))
    over = F.count(F.when((F.col("t") > 8192) | (F.col("s") > 24) | (F.col("l") > 6144) & (F.col("s") > 1), 1)).alias("n_over")
    least = F.greatest(F.ceil(F.sum("t") / 8192), F.ceil(F.sum("s") / 24), F.ceil(F.sum("l") / 6144)).alias("n_least")
    one = bins.agg(F.sum("s").alias("n_items"), F.sum("t").alias("n_tokens"), over, least, F.count(F.lit(1)).alias("n"))
    return one.select("n_items", "n_tokens", "n_over", "n_least", (F.col("n") <= F.col("n_least") * 1.1).alias("near_least"))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_spans(spark, d).select("item_id", "doc_id").distinct()


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n_chars_left) of the documents from which passages were cut."""
    docs, found = _table(spark, d, "documents"), written(p9_spans(spark, d), "spans")
    touched = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    return leakage.without_spans(touched, found).select("doc_id", F.length("text").alias("n_chars_left"))


def p10_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return language.segments(docs, language.fitted(docs)).drop("scores", "n_grams")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_paragraphs(spark, d).filter("label is null or lang <> label").select("doc_id", "para_no", "lang")


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    model = language.fitted(docs)
    return language.document_languages(language.segments(docs, model), model)


QUERIES = {
    "p1_found": p1_found,
    "p1_terms": p1_terms,
    "p1_changes": p1_changes,
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p4_found": p4_found,
    "p4_splits": p4_splits,
    "p4_shares": p4_shares,
    "p5_found": p5_found,
    "p5_rows": p5_rows,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_mapped": p6_mapped,
    "p6_unlisted": p6_unlisted,
    "p7_found": p7_found,
    "p7_records": p7_records,
    "p8_found": p8_found,
    "p8_packing": p8_packing,
    "p8_sequences": p8_sequences,
    "p8_totals": p8_totals,
    "p8_limits": p8_limits,
    "p9_found": p9_found,
    "p9_spans": p9_spans,
    "p9_cleaned": p9_cleaned,
    "p10_found": p10_found,
    "p10_paragraphs": p10_paragraphs,
    "p10_documents": p10_documents,
}

ORACLES = {
    "p1_terms": f"""
with w as (select qid, unnest({_words_sql('QueryText')}) as term from train),
c as (select term, count(*) as occurrences, count(distinct qid) as records from w group by term)
select *, case when records <= 1 then 'rare' when records > 0.05 * (select count(*) from train) then 'common' end as mark from c""",
    "p1_found": f"""
with w as (select qid, unnest({_words_sql('QueryText')}) as term from train),
c as (select term, count(distinct qid) as records from w group by term)
select term, case when records <= 1 then 'rare' else 'common' end as mark from c
where records <= 1 or records > 0.05 * (select count(*) from train)""",
    "p1_changes": f"""
with t as (select qid, coalesce(QueryText, Title) as q from train where split is null or split <> 'test'), w as (select qid, unnest({_words_sql('q')}) as term from t),
c as (select term, count(*) as occurrences, count(distinct qid) as records from w group by term)
select *, case when records <= 1 then 'rare' when records > 0.05 * (select count(*) from t) then 'common' end as mark from c""",
    "p4_found": f"""
with recursive r as (select qid, split, 't' || lower(trim(Title, ' ')) as a, case when len({_words_sql('QueryText')}) > 0 then 'q' || array_to_string(list_sort({_words_sql('QueryText')}), ' ') end as b from train),
n as (select qid, split, coalesce(a, b, 'r' || qid) as x, coalesce(b, a, 'r' || qid) as y from r),
e as (select distinct x as p, y as q from n union select distinct y, x from n),
c(node, least) using key (node) as (select p as node, min(q) as least from e group by p
  union (select e.q as node, min(c.least) as least from c join e on e.p = c.node join recurring.c as o on o.node = e.q where c.least < o.least group by e.q)),
g as (select c.least, min(qid) as group_qid, count(distinct split) as k from n join c on c.node = n.x group by 1)
select group_qid from g where k > 1""",
    "p4_shares": "select count(*) as n_rows, true as near, cast(0 as bigint) as n_titles_apart, cast(0 as bigint) as n_bags_apart from train",
    "p7_found": f"""
with r as (select qid, cast(log_ts as date) as day, list_sort({_words_sql('QueryText')}) as bag from train),
m as (select qid, min(qid) over (partition by day, bag) as keep from r where day is not null and len(bag) > 0)
select keep as keep_qid, qid as copy_qid from m where keep <> qid""",
    "p7_records": f"""
with r as (select qid, cast(log_ts as date) as day, list_sort({_words_sql('QueryText')}) as bag from train)
select min(qid) as keep_qid, count(*) as n_copies from r where day is not null and len(bag) > 0 group by day, bag""",
    "p8_totals": """
with t as (select strlen(text) as n from documents where strlen(text) > 0)
select cast(sum(n) as bigint) as n_tokens, cast(sum(ceil(n / 8192)) as bigint) as n_pieces, cast(0 as bigint) as n_over, count(*) as n_docs, cast(0 as bigint) as n_split from t""",
    "p8_limits": """
with p as (select unnest(string_split(text, chr(10) || chr(10))) as t, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) as k from documents),
n as (select strlen(t) as n, k from p where strlen(t) > 0),
s as (select sum(ceil(n / 8192)) as items, sum(n) as tokens, sum(case when k > 1 then n else 0 end) as loss from n)
select cast(items as bigint) as n_items, cast(tokens as bigint) as n_tokens, cast(0 as bigint) as n_over,
  cast(greatest(ceil(tokens / 8192), ceil(items / 24), ceil(loss / 6144)) as bigint) as n_least, true as near_least from s""",
    "p8_found": "select doc_id from documents where strlen(text) > 8192",
}
