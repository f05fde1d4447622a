import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodequery import skew
from lodequery.functions import features as feat
from lodequery.functions import query_text as qt
from lodequery.operators import catalog as cat
from lodequery.operators import ensemble, evaluation, matching, process, retrieval, title_profile
from lodequery.functions import scorers
from lodequery.sources import tables
from lodequery.stage import new_path
from lodequery.streaming import scoring

TRAIN = "qid bigint, QueryText string, TypeQuery int, Title string, ContentType string, log_ts timestamp, extra string, title string"


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_text_columns(spark):
    assert one(spark, qt.normalize, "  Рик и-Морти! ", None, "", "ÀÉ", "ёж№2") == ["рик и морти", "", "", "", "ёж 2"]
    assert one(spark, qt.transliterate, "shchuka", "maks", "xyz") == ["щука", "макс", "ксыз"]
    assert one(spark, qt.is_latin, "abc", "abc я", "12", None) == [True, False, False, False]
    assert one(spark, qt.clean_title, "Фильм Лед (2018)", "Лед 2018", None) == ["Лед", "Лед", ""]
    assert one(spark, feat.heuristic_type, "смотреть онлайн", "купить", None) == [1, 0, 0]
    assert one(spark, feat.is_generic, "смотреть фильмы 2025", "крик", "", None) == [True, False, True, True]
    assert one(spark, lambda c: feat.type_hint(c)["label"], "мультфильм лед", "лед 3 сезон", "лед 1999", None) == ["мультфильм", "сериал", "фильм", ""]
    with pytest.raises(NotImplementedError):
        qt.lemmatize(F.col("x"), enabled=True)


def test_profiles_of_a_hot_title(spark):
    day = dt.datetime(2023, 1, 1)
    rows = [(i, f"q{i % 7}" if i % 5 else None, 1, " Лед" if i < 60 else "x" if i < 70 else None, "Фильм " if i % 2 else None, day if i % 3 else None, "e", "t") for i in range(100)]
    df = spark.createDataFrame(rows, TRAIN.replace(", title string", ", other string"))
    got = {r.title: r for r in title_profile.title_profiles(df).collect()}
    assert set(got) == {"лед", "x"} and got["лед"].n_rows == 60 and got["лед"].content_type == "фильм" and got["лед"].n_queries == 7
    assert [r.title for r in title_profile.heavy_titles(df, 0.5).collect()] == ["лед"]
    empty = df.limit(0)
    assert title_profile.title_profiles(empty).count() == 0 == title_profile.heavy_titles(empty).count() == title_profile.title_length_percentiles(empty).count()


def test_weighted_percentiles_and_running_weights(spark):
    random.seed(3)
    rows = [("hot" if random.random() < 0.7 else f"k{i % 9}", random.choice([None, *range(20)])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {r.key: (r.p50, r.p90) for r in skew.percentiles(skew.compressed(df, F.col("k"), F.col("v")), {"p50": 0.5, "p90": 0.9}).collect()}
    for k in {r[0] for r in rows}:
        v = sorted(x for key, x in rows if key == k and x is not None)
        assert got[k] == tuple(next(x for i, x in enumerate(v) if i + 1 >= len(v) * p) for p in (0.5, 0.9))


def test_lookup_join(spark):
    rows = spark.createDataFrame([("a",)] * 50 + [("b",), (None,)], "k string")
    table = spark.createDataFrame([("a", 50, 1), ("b", 1, 2), ("c", 0, 3)], "k string, n_rows int, v int")
    assert sorted(r.v for r in skew.lookup_join(rows, table, "k", 10).collect()) == [1] * 50 + [2]


def test_stratified_is_exact(spark):
    df = spark.createDataFrame([(i, "a" if i < 900 else "b" if i < 990 else None) for i in range(1000)], "id bigint, s string")
    got = {r.s: r.n for r in evaluation.stratified(df, "id", "s", 0.15).filter("valid").groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 135, "b": 13, None: 1}
    assert evaluation.stratified(df, "id", "s", 0.15).count() == 1000


def test_group_holdout_keeps_groups(spark):
    df = spark.createDataFrame([(i, f"g{i % 20}" if i % 3 else None, i % 2) for i in range(400)], "id bigint, g string, y int")
    got = evaluation.group_holdout(df, "id", F.col("g"), "y", 0.3)
    assert got.count() == 400 and got.filter("g is not null").groupBy("g").agg(F.countDistinct("valid").alias("n")).filter("n > 1").count() == 0


def test_measures(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "t int, p int")
    assert evaluation.f_beta(df, "t", "p").first()["f_beta"] == pytest.approx(0.5)
    assert evaluation.f_beta(df.limit(0), "t", "p").first()["f_beta"] == 0
    t = spark.createDataFrame([("рик и морти", "Рик"), (None, ""), ("а", "")], "t string, p string").select(evaluation.token_f1(F.col("t"), F.col("p")).alias("f"))
    assert [r.f for r in t.collect()] == [pytest.approx(0.5), 1.0, 0.0]


def test_search(spark):
    q = spark.createDataFrame([(1, "лёд"), (2, None), (3, "")], "id int, query string")
    c = spark.createDataFrame([(1, "лед"), (2, "лёд"), (3, None), (4, "лёд")], "ord bigint, choice string")
    for block in (1, 100):
        got = process.extract(q.filter("id < 3"), c, "ratio", 2, block=block).orderBy("place").collect()
        assert [(r.ord, r.place) for r in got] == [(2, 1), (4, 2)]
    assert process.extract_one(q, c.limit(0), "ratio").count() == 0
    assert process.extract_one(q, c, "ratio", 101).count() == 0


def test_leaders_equal_the_sequential_form(spark):
    random.seed(5)
    titles = [(i, "".join(random.choice("абв ") for _ in range(random.randint(3, 9))).strip() or "а", i) for i in range(60)]
    df = spark.createDataFrame(titles, "ord bigint, title string, cnt bigint")

    def near(a, b):
        r = scorers.ratio(a, b)
        return r >= 85 or (r >= 70 and (a in b or b in a))

    want, taken = {}, set()
    for i, a, _ in titles:
        if i not in taken:
            want[i] = i
            for j, b, _ in titles:
                if j > i and j not in taken and j not in want and near(a, b):
                    taken.add(j)
                    want[j] = i
    pairs = cat.similar_pairs(df)
    brute = {(i, j) for i, a, _ in titles for j, b, _ in titles if i < j and near(a, b)}
    assert {(r.i, r.j) for r in pairs.collect()} == brute
    assert {r.ord: r.leader for r in cat.leaders(df, pairs).collect()} == want
    assert cat.leaders(df, pairs.limit(0)).filter("ord <> leader").count() == 0


CATALOG = [("Рик и Морти", 1, "мультсериал", ["рик и морти", "rick and morty"]), ("Лёд", 2, "фильм", None), ("Белая королева", 3, "сериал", [])]


def test_matching(spark):
    c = spark.createDataFrame(CATALOG, "title string, ord bigint, content_type string, variants array<string>")
    q = spark.createDataFrame([(1, "рик и морти"), (2, "морти и рик"), (3, "смотреть белая королева"), (4, "белая каралева"), (5, None), (6, "")], "id bigint, query string")
    got = {r.id: (r.title, r.match_type) for r in matching.cascade(q, c).collect()}
    assert got == {1: ("Рик и Морти", "exact"), 2: ("Рик и Морти", "lemma_match"), 3: ("Белая королева", "lemma_overlap"), 4: ("Белая королева", "fuzzy")}
    found = {r.id: r for r in retrieval.retrieved(q, c).collect()}
    assert found[3].source == "catalog_exact" and found[3].title == "Белая королева" and found[5].raw == ""
    assert matching.cascade(q, c.limit(0)).count() == 0


def test_spans():
    assert retrieval.candidate("белая королева 2013 смотреть") == ["белая", "королева"]
    assert retrieval.candidate("рик и морти 7 сезон") == ["рик", "и", "морти"]
    assert retrieval.candidate("смотреть фильмы 2025 онлайн") == [] == retrieval.candidate("")
    assert retrieval.prefixes(["рик", "и", "морти"]) == ["рик и морти", "рик"]
    assert not retrieval.acceptable("", [])


def test_answers_of_branches():
    rows = [{"branch": "franchise", "title": "лед", "content_type": "фильм", "confidence": 0.95, "weight": 2.0}, {"branch": "graph", "title": "лед 2", "content_type": "сериал", "confidence": 0.7, "weight": 0.7}]
    title, kind, sure, agree = ensemble.answer(rows)
    assert (title, kind, agree) == ("лед", "фильм", 0.6667) and 0 < sure <= 1
    assert ensemble.answer([]) == ("", "", 0.0, 0.0)


def test_merge_fills_gaps(spark):
    kind = "title string, content_type string, cnt int, variants array<string>, year string, season string"
    a = spark.createDataFrame([("лед", "прочее", 2, ["лед"], None, None)], kind)
    b = spark.createDataFrame([("Лед!", "фильм", 1, ["ice"], "2018", None), ("новый", "сериал", 1, None, None, "2")], kind)
    got = {r.title: r for r in cat.merged(a, b).collect()}
    assert got["Лед!"].cnt == 3 and got["Лед!"].content_type == "фильм" and got["Лед!"].year == "2018" and got["новый"].variants == []


def test_csv_and_parts(spark):
    rows = spark.createDataFrame([("а, \"б\"\nв", 1, None, ""), ("", 0, " x ", "фильм")], tables.LABELLED)
    path = new_path(spark, "csv")
    tables.write_csv(rows, path, "\\N")
    assert sorted(map(str, tables.read_csv(spark, path, tables.LABELLED, "\\N").collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(ValueError, match="movie"):
        tables.read_csv(spark, path, tables.TOP_LIST)
    assert tables.first_existing(spark, [path + "-none", path], tables.QUERIES).count() == 2
    assert tables.first_existing(spark, [], tables.QUERIES, otherwise=[("x",)]).count() == 1
    tables.save_parts({"a": rows}, path + "-parts", {"version": 1})
    parts, about = tables.load_parts(spark, path + "-parts", ["a"])
    assert parts["a"].count() == 2 and about["version"] == 1
    with pytest.raises(ValueError, match="b"):
        tables.load_parts(spark, path + "-parts", ["b"])
    assert tables.load_map(spark, path + "-none").count() == 0


def test_stream_equals_batch(spark):
    rows = spark.createDataFrame([(i, f"смотреть лёд {i % 3}" if i % 4 else "лёд") for i in range(20)], "qid bigint, QueryText string")
    c = spark.createDataFrame(CATALOG, "title string, ord bigint, content_type string, variants array<string>")
    src, out, progress = (new_path(spark, n) for n in ("src", "out", "progress"))
    rows.write.parquet(src)
    stream = scoring.scored(scoring.read_queries(spark, src, rows.schema), c)
    scoring.run_once(stream, out, progress)
    scoring.run_once(stream, out, progress)
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, scoring.scored(rows, c).collect()))


def test_registered_queries_have_sql_of_the_same_name():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "p3_found" in e.queries()
