"""Building a catalog of titles from labelled queries and reference lists, as tables.

A catalog is (title, ord, content_type, cnt) with its spellings in a long table (title, variant), so that no title's
spellings are ever gathered in one row. ``ord`` is the order of entries that ties are broken by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import skew
from ..functions import lexicons as L
from ..functions import query_text as qt
from ..functions import scorers
from ..stage import written
from ..text import title_key

SEASON = r"(?iU)([0-9]+)\s*(?:сезон|season|s\b)"
YEAR = r"(?U)\b(19[5-9][0-9]|20[0-2][0-9])\b"


def grouped(train: DataFrame) -> DataFrame:
    """(title, ord, cnt, content_type): one row per title key, ord the least qid, the type the commonest label (the least
    of several). Null titles are left out."""
    key = title_key(qt.stripped(F.col("Title")))
    kinds = skew.modes(skew.compressed(train, key, qt.content_type(F.col("ContentType"))))
    titles = train.select(key.alias("key"), "qid").filter("key is not null").groupBy("key").agg(F.min("qid").alias("ord"), F.count(F.lit(1)).alias("cnt"))
    return titles.join(kinds, "key").select(F.col("key").alias("title"), "ord", "cnt", F.col("mode").alias("content_type"))


def spellings(train: DataFrame) -> DataFrame:
    """(title, variant): each title and the query forms that share a word with it."""
    rows = train.select(title_key(qt.stripped(F.col("Title"))).alias("title"), qt.variant_form(F.col("QueryText")).alias("variant")).filter("title is not null").distinct()
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    shared = rows.filter(F.arrays_overlap(words(F.col("title")), words(F.col("variant"))))
    return shared.unionByName(rows.select("title", F.col("title").alias("variant"))).distinct()


def stated_mode(train: DataFrame, pattern: str) -> DataFrame:
    """(title, value): what a pattern most often finds in a title's queries (the least of several); titles with none are
    left out."""
    found = F.nullif(F.regexp_extract(F.coalesce("QueryText", F.lit("")), pattern, 1), F.lit(""))
    modes = skew.modes(skew.compressed(train, title_key(qt.stripped(F.col("Title"))), found))
    return modes.filter("mode is not null").select(F.col("key").alias("title"), F.col("mode").alias("value"))


def variant_map(catalog: DataFrame, key, last: bool = True) -> DataFrame:
    """(form, title, ord): which entry a spelling stands for. ``catalog``: (title, ord, variants); ``key``: function from a
    spelling column to its form. Where several entries share a form, the last one holds, or the first."""
    each = catalog.select("title", "ord", F.explode(F.array_union(F.coalesce("variants", F.array().cast("array<string>")), F.array("title"))).alias("v"))
    forms = each.select(key(F.col("v")).alias("form"), "title", "ord").filter("form <> ''")
    pick = F.max if last else F.min
    return forms.groupBy("form").agg(pick(F.struct("ord", "title")).alias("x")).select("form", "x.title", "x.ord")


def bag(c):
    """The words of the normal form in order of the alphabet."""
    return F.array_join(F.array_sort(qt.tokens(qt.normalize(c))), " ")


def merged(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """Two catalogs (title, content_type, cnt, variants, year, season) by normal form of the title: spellings united,
    counts summed, gaps of year and season filled, an empty type or the last label replaced, the better written title kept.
    Forms must be unique on each side; of several, keep one beforehand."""
    a, b = primary.withColumn("form", qt.normalize(F.col("title"))).alias("a"), extra.withColumn("form", qt.normalize(F.col("title"))).alias("b")
    both = a.join(b, "form", "full_outer")
    fill = lambda c: F.coalesce(F.when(F.col(f"a.{c}") != "", F.col(f"a.{c}")), F.col(f"b.{c}"))
    kind = F.when((F.coalesce("a.content_type", F.lit("")).isin("", L.OTHER)) & (F.coalesce("b.content_type", F.lit("")) != ""), F.col("b.content_type")).otherwise(F.coalesce("a.content_type", "b.content_type"))
    empty = F.array().cast("array<string>")
    return both.select(
        F.when(F.col("a.title").isNull(), F.col("b.title")).when(F.col("b.title").isNull(), F.col("a.title")).otherwise(qt.chosen_title(F.col("a.title"), F.col("b.title"))).alias("title"),
        kind.alias("content_type"), (F.coalesce("a.cnt", F.lit(0)) + F.coalesce("b.cnt", F.lit(0))).cast("bigint").alias("cnt"),
        F.array_sort(F.array_union(F.coalesce("a.variants", empty), F.coalesce("b.variants", empty))).alias("variants"), fill("year").alias("year"), fill("season").alias("season"),
    )


def top_list(films: DataFrame) -> DataFrame:
    """(title, content_type, variants, year, season) of a list (kp_id, movie, year, description); of films with one clean
    title the last by kp_id holds. The type is told by the description, the longer word first; a film otherwise."""
    title, about = qt.clean_title(F.lower(qt.stripped(F.col("movie")))), F.lower(F.coalesce("description", F.lit("")))
    kind = F.when(about.contains("мультсериал"), "мультсериал").when(about.contains("мультфильм"), "мультфильм").when(about.contains("сериал"), "сериал").otherwise("фильм")
    rows = films.select("kp_id", title.alias("title"), kind.alias("content_type"), F.trim(F.coalesce("year", F.lit(""))).alias("y"), F.regexp_extract(about, SEASON, 1).alias("s")).filter("title <> ''")
    last = rows.groupBy("title").agg(F.max(F.struct("kp_id", "content_type", "y", "s")).alias("x"))
    return last.select("title", "x.content_type", qt.title_variants(F.col("title"), F.col("x.y")).alias("variants"), F.nullif("x.y", F.lit("")).alias("year"), F.nullif("x.s", F.lit("")).alias("season"))


def film_list(films: DataFrame) -> DataFrame:
    """(title, content_type, variants, year, season) of a list with Russian and English titles. A Russian title of one word
    and up to five letters, an empty one included, is left out; of films with one title the last by film_id holds."""
    ru, en = (qt.clean_title(F.lower(qt.stripped(F.col(c)))) for c in ("title_ru", "title_en"))
    genres, about = F.lower(F.coalesce("Genres", F.lit(""))), F.lower(F.coalesce("Description Kinopoisk", F.lit("")))
    series = genres.contains("сериал") | about.contains("сериал") | about.contains("многосерийный")
    year = F.trim(F.replace(F.coalesce("Year", F.lit("")), F.lit(".0"), F.lit("")))
    text = F.concat(ru, F.lit(" "), about)
    rows = films.select("film_id", ru.alias("title"), en.alias("en"), F.when(series, "сериал").otherwise("фильм").alias("content_type"), year.alias("y"), F.regexp_extract(text, YEAR, 1).alias("said"), F.regexp_extract(text, SEASON, 1).alias("s"))
    rows = rows.filter(~((F.size(F.filter(F.split("title", r"\s+"), lambda w: w != "")) < 2) & (F.length("title") <= 5)))
    last = rows.groupBy("title").agg(F.max(F.struct("film_id", "en", "content_type", "y", "said", "s")).alias("x"))
    variants = F.array_sort(F.array_union(qt.title_variants(F.col("title"), F.col("x.y")), F.when(F.col("x.en") != "", qt.title_variants(F.col("x.en"), F.col("x.y"))).otherwise(F.array().cast("array<string>"))))
    return last.select("title", "x.content_type", variants.alias("variants"), F.nullif("x.said", F.lit("")).alias("year"), F.nullif("x.s", F.lit("")).alias("season"))


def similar_pairs(titles: DataFrame, least: float = 85.0, inside: float = 70.0) -> DataFrame:
    """(i, j) with i < j of titles (ord, title) whose ratio is at least ``least``, or at least ``inside`` where one holds the
    other. Exact without comparing all pairs: such titles share most of their letter pairs, so they share one of the
    rarest of either, by which they are joined."""
    n_pairs = F.greatest(F.length("title") - 1, F.lit(1))
    grams = titles.select("ord", "title", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n_pairs), lambda i: F.substring("title", i, F.lit(2))))).alias("gram"))
    count = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = grams.join(count, "gram").withColumn("place", F.row_number().over(Window.partitionBy("ord").orderBy("n", "gram"))).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("ord")))
    # an edit spoils two letter pairs, and repeated ones count once: keep all but those that a pair must share for certain
    certain = F.greatest(F.floor(F.col("all") - 0.6 * F.length("title") - (F.length("title") - 1 - F.col("all"))), F.lit(1))
    kept = written(ranked.filter(F.col("place") <= F.col("all") - certain + 1).select("ord", "title", "gram"), "rare-pairs")
    a, b = kept.alias("a"), kept.alias("b")
    near = (F.least(F.length("a.title"), F.length("b.title")) * 200) >= (F.length("a.title") + F.length("b.title")) * F.least(F.lit(least), F.lit(inside))
    met = a.join(b, "gram").filter((F.col("a.ord") < F.col("b.ord")) & near).select(F.col("a.ord").alias("i"), F.col("b.ord").alias("j"), F.col("a.title").alias("x"), F.col("b.title").alias("y")).distinct().repartition(2 * titles.sparkSession.sparkContext.defaultParallelism)
    score, holds = scorers.column("ratio")(F.col("x"), F.col("y")), F.contains("x", F.col("y")) | F.contains("y", F.col("x"))
    return met.withColumn("score", score).filter((F.col("score") >= least) | ((F.col("score") >= inside) & holds)).select("i", "j")


def leaders(titles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ord, leader): each title's leader when titles are taken in order and each one not yet taken leads all later similar
    ones. Leaders are the titles with no earlier similar leader; each round settles those with no earlier open neighbour and
    what they lead, the first open title at least, so it ends; there are as many rounds as the longest chain of titles each
    similar to the next needs."""
    edges = written(pairs.select("i", "j"), "similar")
    nodes = titles.select("ord")
    open_ = written(edges.select(F.col("i").alias("ord")).union(edges.select(F.col("j"))).distinct(), "open")
    done = nodes.join(open_, "ord", "left_anti").select("ord", F.col("ord").alias("leader"))
    while not open_.isEmpty():
        live = edges.join(open_.select(F.col("ord").alias("i")), "i").join(open_.select(F.col("ord").alias("j")), "j")
        lead = open_.join(live.select(F.col("j").alias("ord")).distinct(), "ord", "left_anti")
        taken = live.join(lead.select(F.col("ord").alias("i")), "i").groupBy(F.col("j").alias("ord")).agg(F.min("i").alias("leader"))
        settled = written(lead.select("ord", F.col("ord").alias("leader")).unionByName(taken), "settled")
        done = done.unionByName(settled)
        open_ = written(open_.join(settled, "ord", "left_anti"), "open")
    return done


def clustered(titles: DataFrame, led: DataFrame) -> DataFrame:
    """(title, cnt, n_titles): clusters of (ord, title, cnt) named by their most frequent title, the earliest of several."""
    rows = titles.join(led, "ord").groupBy("leader").agg(F.max(F.struct("cnt", (-F.col("ord")).alias("o"), "title")).alias("best"), F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("n_titles"))
    return rows.select("best.title", "cnt", "n_titles")


def typo_dictionary(queries: DataFrame, titles: DataFrame, least: float = 70.0) -> DataFrame:
    """(query, title, score): normal forms of more than three letters that occur twice or more, with the title of best
    ratio, unless it is the form itself. ``queries``: (QueryText); ``titles``: (ord, choice)."""
    from .process import extract_one

    forms = queries.select(qt.normalize(F.col("QueryText")).alias("query")).filter(F.length("query") > 3).groupBy("query").count().filter("count >= 2")
    found = extract_one(forms.select(F.col("query").alias("id"), "query"), titles, "ratio", least)
    return found.filter("id <> choice").select(F.col("id").alias("query"), F.col("choice").alias("title"), "score")


def corrected(rows: DataFrame, text: str, typos: DataFrame) -> DataFrame:
    """``rows`` with ``text`` replaced where the dictionary (query, title) has it."""
    fixes = typos.select(F.col("query").alias("_q"), F.col("title").alias("_t"))
    return rows.join(fixes, F.col(text) == F.col("_q"), "left").withColumn(text, F.coalesce("_t", text)).drop("_q", "_t")
