import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodequery.llm import canonical, keyed, language, leakage, linkage, overlap, packing, records, spelling, splits, terms, titles
from lodequery.stage import new_path
from lodequery.text import words

TEXTS = ["Лёд  и пламя", "лед", None, "", " ... ", "лёд лёд", "ice " * 3000]


def test_term_counts_follow_changes(spark):
    old = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    new = spark.createDataFrame([(0, "лёд и пламя"), (1, None), (7, "пламя пламя")], "id int, text string")
    store = terms.TermCounts(spark, new_path(spark, "t"), buckets=4)
    store.merge(terms.term_deltas(old, "text"))
    assert store.total() == len(TEXTS)
    changes = terms.signed_changes(old, new, "id", "text")
    store.merge(terms.term_deltas(changes, "text", F.col("sign")))
    got = {r.term: (r.occurrences, r.records) for r in store.counts().collect()}
    assert got == {"лёд": (1, 1), "и": (1, 1), "пламя": (3, 2)} and store.total() == 3
    marks = {r.term: r.mark for r in terms.marked(store.counts(), 3, 1, 0.5).collect()}
    assert marks == {"лёд": "rare", "и": "rare", "пламя": "common"}
    nothing = terms.TermCounts(spark, new_path(spark, "t"))
    nothing.merge(terms.term_deltas(old.limit(0), "text"))
    assert nothing.counts().count() == 0 and nothing.total() == 0


def test_records_that_differ_in_format_collapse(spark):
    rows = [(1, "A,  b", {"x": ["1", "2"]}, 5), (2, "a B", {"x": ["2", "1"]}, 5), (3, "b a", {"x": ["1", "2"]}, 5), (4, None, None, None), (5, None, None, None), (6, "", None, None)]
    df = spark.createDataFrame(rows, "id bigint, t string, m map<string, array<string>>, n int")
    tight = records.rooted(df, F.struct("t", "n"))
    assert sorted((r.keep, r.n_rows) for r in records.collapsed(tight, "id").collect()) == [(1, 2), (3, 1), (4, 2), (6, 1)]
    loose = records.rooted(df, F.struct("t", "n"), ["t"])
    assert sorted((r.keep, r["copy"]) for r in records.copies(loose, "id").collect()) == [(1, 2), (1, 3), (4, 5)]
    assert records.rooted(df, F.struct("n", "t")).select("digest").first() == tight.select("digest").first()
    assert records.copies(loose.limit(0), "id").count() == 0


def test_equal_digests_of_different_records_stay_apart(spark):
    df = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, 7, "a")], "id bigint, digest bigint, form string")
    assert [(r.keep, r["copy"]) for r in records.copies(df, "id").collect()] == [(1, 3)]


def components_slow(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    groups = {}
    for x in list(up):
        groups.setdefault(root(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("hub_links", [3, 1000])
def test_components(spark, hub_links):
    random.seed(11)
    edges = [(random.randint(0, 80), random.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 112)] + [(200, 200), (300, 301), (301, 300)] + [(400, 401 + i) for i in range(9)]
    df = spark.createDataFrame([*edges, (None, 5)], "a bigint, b bigint")
    groups = {}
    for r in splits.components(df, hops=2, hub_links=hub_links).collect():
        groups.setdefault(r.component, set()).add(r.node)
    assert {frozenset(g) for g in groups.values()} == components_slow(edges)


def test_components_of_nothing(spark):
    assert splits.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_splits_keep_groups_and_shares(spark):
    df = spark.range(2000).select(F.col("id").alias("component"), F.when(F.col("id") == 0, 600).otherwise(F.col("id") % 3 + 1).alias("n"))
    got = splits.assigned(df, {"train": 0.8, "valid": 0.1, "test": 0.1}).join(df, "component").groupBy("split").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()
    total = sum(r.n for r in got)
    assert {r.split: round(r.n / total, 2) for r in got} == {"train": 0.8, "valid": 0.1, "test": 0.1} and sum(r.c for r in got) == 2000
    assert splits.assigned(df.limit(0), {"train": 0.9, "test": 0.1}).count() == 0


def test_tied_rows(spark):
    rows = [(5, "t1", "a b", "train"), (2, "t1", None, "test"), (9, None, "b a", "valid"), (7, None, None, "train"), (1, None, "", "test"), (3, "t2", "c", "train"), (4, "t2", "c", "train")]
    df = spark.createDataFrame(rows, "qid bigint, title string, q string, split string")
    bag = F.when(F.size(words(F.col("q"))) > 0, F.array_join(F.array_sort(words(F.col("q"))), " "))
    slices, found = splits.grouped(df, "qid", [F.col("title"), bag], ["split"])
    got = splits.slice_groups(slices, found).groupBy("component").agg(F.min("least").alias("g"), F.countDistinct("split").alias("s"), F.sum("n").alias("n")).collect()
    assert sorted((r.g, r.s, r.n) for r in got) == [(1, 1, 1), (2, 3, 3), (3, 1, 2), (7, 1, 1)]


def test_slips_and_spellings():
    assert all(spelling.is_slip("лабиринт", w) for w in ("лабирнт", "лабиирнт", "лабиритн", "лаабиринт", "лабирикт"))
    assert not any(spelling.is_slip("антиквар", w) for w in ("антиквара", "нтиквар", "антиквас", "антиквар", "актиккар"))
    assert not spelling.is_slip("серия", "серии") and not spelling.is_slip("12345", "12346") and not spelling.is_slip("кино", "кно")
    for a, b in [("туманный", "tumannyj"), ("пятнистая", "pjatnistaja"), ("мельница", "melnica"), ("часовщик", "chasovschik")]:
        assert spelling.skeleton(a) == spelling.skeleton(b)
    assert spelling.from_keys("nevfyysq kf,bhbyn") == "туманный лабиринт" and spelling.looked("тyмaнный") == "туманный"


LOG = [
    (1, "туманный лабиринт смотреть", "train"), (2, "Смотреть, ТУМАННЫЙ лабиринт", "test"), (3, "nevfyysq kf,bhbyn cvjnhtnm", "valid"), (4, "tumannyj labirint smotret", "test"),
    (5, "тумнный лабириннт смотреть", "test"), (6, "тумнный лабириннт смтореть", "test"), (7, "туманный лабиринт", "test"), (8, "туманный лабиринт смотреть 2", "test"),
    (9, None, "test"), (10, "", "train"), (11, "...", "test"), (12, "туманный туманный лабиринт смотреть", "test"), (13, "серия 12 выпуск", "train"), (14, "серии 12 выпуск", "test"), (15, "серия 13 выпуск", "test"),
]


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_overlap(spark, monkeypatch, limit):
    """``limit`` 0 takes the ways without a broadcast."""
    monkeypatch.setattr(keyed.canonical, "__defaults__", (limit,))
    monkeypatch.setattr(overlap.with_keys, "__defaults__", (limit,))
    df = spark.createDataFrame(LOG, "qid bigint, q string, split string").withColumn("is_eval", F.col("split") != "train")
    rows = overlap.canonical_rows(df, "q", ["qid", "is_eval"])
    got = {r.qid: r.kind for r in overlap.eval_rows(rows, overlap.overlapping(rows)).collect()}
    assert got == {2: "same", 3: "same", 4: "same", 5: "slips"}


def test_overlap_equals_comparison_of_all_pairs(spark):
    random.seed(2)
    clean = ["туманный лабиринт", "медный звонарь", "ржавая плотина смотреть"]

    def typed(s):
        ws = s.split()
        for _ in range(random.choice([0, 1, 2])):
            i = random.randrange(len(ws))
            k = random.randrange(1, len(ws[i]) - 2)
            ws[i] = ws[i][:k] + ws[i][k + 1 :]
        random.shuffle(ws)
        return " ".join(ws)

    data = [(i, typed(random.choice(clean)), bool(i % 2)) for i in range(120)]
    df = spark.createDataFrame(data, "qid bigint, q string, is_eval boolean")
    rows = overlap.canonical_rows(df, "q", ["qid", "is_eval"])
    got = {r.qid for r in overlap.eval_rows(rows, overlap.overlapping(rows)).collect()}

    def near(a, b):
        x, y = Counter(a.split()), Counter(b.split())
        left, right = list((x - y).elements()), list((y - x).elements())
        if len(left) != len(right) or len(left) > 2:
            return False
        return any(all(spelling.is_slip(p, q) for p, q in zip(left, o)) for o in ([right, right[::-1]] if right else [[]]))

    train = [q for _, q, e in data if not e]
    assert got == {i for i, q, e in data if e and any(near(q, t) for t in train)}


ENTRIES = [(1, ["Туманный лабиринт", "the misty labyrinth"]), (2, ["Туманный лабиринт 2"]), (3, ["Антиквар компаса"]), (4, ["Компас антиквара"]), (5, ["Скрипачка из Ремлунска"]), (6, ["Медный лабиринт", "the copper labyrinth"]), (7, ["Медный компас"])]


def test_titles_typed_freely():
    r = titles.Reference(ENTRIES)
    whole = {"туманныйлабиринт": 1, "nevfyysq kf,bhbyn": 1, "misty labyrinth": 1, "labyrinth misty": None, "сериал туманный лабиринт (2017)": 1, "туманный лабиринт ii": 2, "туманный лабиринт часть 2": 2, "туманный лабиринт 3": None, "тумнный лабирикт": 1, "антиквара компас": 4, "антиквар компас": None, "skripachka iz remlunska": 5, "скрипачкаизремлунска": 5, "": None, "...": None, "туманный": None}
    assert {t: (f := r.title(t)) and f[0] for t in whole} == whole
    asked = {"смотреть туманный лабиринт 2 сезон 5 серия": 1, "туманный лабиринт 2 смотреть": 2, "лабиринт 5 сезон туманный": 1, "лучшие фильмы": None, "tumannyy labirint онлайн": 1, "туманный лабиринт 2017": 1}
    assert {t: (f := r.named(t)) and f[0] for t in asked} == asked


@pytest.mark.parametrize("limit", [0, 200_000])
def test_mapping_of_rows(spark, monkeypatch, limit):
    """``limit`` 0 joins everything by shuffle."""
    monkeypatch.setattr(canonical, "BROADCAST_ROWS", limit)
    e = spark.createDataFrame([(i, s[0], s) for i, s in ENTRIES], "ord bigint, title string, spellings array<string>")
    v = spark.createDataFrame([("туманныйлабиринт", True), ("неведомое", True), ("смотреть антиквар компаса", False), (None, True)], "value string, whole boolean")
    got = {r.value: (r.ord, round(r.score, 9)) for r in canonical.matched(v, e).collect()}
    alone = titles.Reference(ENTRIES)
    assert got == {"туманныйлабиринт": alone.title("туманныйлабиринт"), "смотреть антиквар компаса": alone.named("смотреть антиквар компаса")}
    assert [x[0] for x in got.values()].count(1) == 1 and len(got) == 2
    for parts in (1, 7, 40):
        spread = canonical.matched(v.repartition(parts), e.repartition(parts))
        assert {r.value: (r.ord, round(r.score, 9)) for r in spread.collect()} == got
    rows = spark.createDataFrame([(1, "туманный лабиринт"), (2, "туманныйлабиринт"), (3, "нет такого"), (4, None)], "qid bigint, t string")
    got = {r.id: r.ord for r in canonical.mapped(rows, "qid", F.col("t"), F.lit(True), e, F.lower("title")).collect()}
    assert got == {2: 1, 3: None}
    assert canonical.mapped(rows, "qid", F.col("t"), F.lit(True), e.limit(0)).filter("ord is not null").count() == 0


@pytest.mark.parametrize("limit", [0, 500_000])
def test_works_across_sources(spark, monkeypatch, limit):
    """``limit`` 0 joins the tables of words by shuffle."""
    monkeypatch.setattr(linkage, "BROADCAST_WORDS", limit)
    refs = [
        ("e:1", "e", ["Туманный лабиринт", "The Misty Labyrinth"], 2017), ("e:2", "e", ["Туманный лабиринт 2", None], 2019), ("e:3", "e", ["Медный компас", "The Copper Compass"], 1990), ("e:4", "e", [None, None], None),
        ("e:5", "e", ["Туманный компас", "The Misty Compass"], 2001), ("e:6", "e", ["Медный лабиринт", "The Copper Labyrinth"], 2002), ("k:1", "k", ["туманный лабиринт (2017)", None], 2018), ("k:2", "k", ["Медный компас", None], 2020),
        ("t:a", "t", ["туманныйлабиринт"], None), ("t:b", "t", ["misty labyrinth"], None), ("t:c", "t", ["ntvyjt"], None), ("t:d", "t", ["тумнный лабиринт"], None), ("t:e", "t", [""], None),
    ]
    df = spark.createDataFrame([(r, s, t, y, None) for r, s, t, y in refs], "ref string, source string, titles array<string>, year int, kind string")
    got = {(r.ref_a, r.ref_b): r.confidence for r in linkage.linked(linkage.prepared(df)).collect()}
    assert set(got) == {("e:1", "k:1"), ("e:1", "t:a"), ("e:1", "t:b"), ("e:1", "t:d"), ("k:1", "t:a"), ("k:1", "t:b"), ("k:1", "t:d")}
    assert all(0 < c <= 1 for c in got.values())


def test_hyperplanes_bring_together_what_is_alike(spark):
    """Of all pairs of forms that the exact comparison accepts, the buckets hold nearly all; nothing else feeds them."""
    rng = random.Random(8)
    syllables = ["ла", "би", "рин", "ту", "мед", "ко", "зво", "нар", "пло", "ти", "ржа", "ве", "мос", "гар", "сне", "жур"]
    name = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(3, 4)))
    rows = []
    for i in range(150):
        title = " ".join(name() for _ in range(rng.randint(1, 3)))
        k = rng.randrange(1, len(title) - 2)
        rows += [(f"a:{i}", "a", [title], 1950 + i % 60), (f"b:{i}", "b", [title.replace(" ", "")], None), (f"c:{i}", "c", [title[:k] + title[k + 1 :]], 1950 + i % 60)]
    df = spark.createDataFrame(rows, "ref string, source string, titles array<string>, year int").withColumn("kind", F.lit(None).cast("string"))
    forms, holders = linkage.title_forms(linkage.prepared(df))
    met = {tuple(r) for r in linkage.blocked(forms, linkage.trained(forms, holders)).collect()}
    every = forms.collect()
    want = {tuple(sorted((x.form, y.form))) for n, x in enumerate(every) for y in every[n + 1 :] if len({d.source for d in [*x.dated, *y.dated]}) > 1 and linkage.alike(x.asDict(), y.asDict()) > 0}
    assert len(want) > 100 and len(want & met) >= 0.98 * len(want)


def test_packing(spark):
    docs = [(i, "я" * random.Random(i).randint(0, 900)) for i in range(400)] + [(900, None), (901, "a" * 2500), (902, "a" * 2000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = packing.pieces(df, "doc_id", packing.byte_tokens(F.col("text")), capacity=1000)
    got = packing.packed(items, capacity=1000, max_segments=5, max_loss=1000, shard_items=100).collect()
    per = Counter()
    for r in got:
        per[r.shard, r.bin] += r.tokens
    assert max(per.values()) <= 1000 and max(Counter((r.shard, r.bin) for r in got).values()) <= 5
    assert sum(per.values()) == sum(len((t or "").encode()) for _, t in docs)
    assert sorted((r.id, r.start, r.tokens) for r in got if r.n_pieces > 1 and r.id == 901) == [(901, 0, 1000), (901, 1000, 1000), (901, 2000, 500)]
    assert packing.packed(items.limit(0)).count() == 0
    assert (packing.fill(np.array([[5.0, 1], [5, 1], [20, 1]]), np.array([10.0, 9])) == [1, 1, 0]).all()


def test_tokenizer_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.tokens for r in packing.tokenizer_tokens(df, "text", P.path("byte_bpe_50k.json")).collect()}
    assert got == {1: 2, 2: None, 3: 0}


def leak_slow(item, doc):
    """Any passage of 24 or more item words with at most one edit in eight, by plain edit distances."""
    for i in range(len(item) - 23):
        row = [0] * (len(doc) + 1)
        for k, w in enumerate(item[i:], 1):
            new = [k]
            for j, x in enumerate(doc, 1):
                new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
            row = new
            if k >= 24 and min(row) <= k // 8:
                return True
    return False


def test_leaks_equal_plain_alignment(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(20, 60)))) for k in range(4)] + [(90, None), (91, "")]
    docs = []
    for d in range(120):
        ws = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        src = items[rng.randrange(4)][1].split()
        a = rng.randrange(0, max(1, len(src) - 24))
        cut = src[a : a + rng.randint(18, 40)]
        for _ in range(rng.randint(0, 6)):
            p = rng.randrange(len(cut))
            cut[p : p + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 1)
        docs.append((d, " ".join([*ws, *cut, *(rng.choice(vocab) for _ in range(9))])))
    docs += [(900, None), (901, ""), (902, "w1")]
    want = {(k, d) for k, t in items if t for d, x in docs if x and leak_slow(t.split(), x.split())}
    it, do = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string")
    for block in (10, 1_000_000):
        got = {(r.item_id, r.doc_id) for r in leakage.leaks(do, it, block_words=block).collect()}
        assert got == want and 20 < len(want) < 150
    assert leakage.leaks(do, it.limit(0)).count() == 0


def test_leaks_whatever_the_letters(spark):
    item = "Поздней осенью уставший капитан прячет от всех старую карту побережья в школе деревни Кажводол и никто не верит его словам пока маяк ещё горит над морем"
    hidden = "до. " + item.upper().replace("Й", "Й").replace("А", "A").replace(" ", "­  ") + "! после"
    it, do = spark.createDataFrame([(1, item)], "item_id bigint, text string"), spark.createDataFrame([(1, hidden)], "doc_id bigint, text string")
    found = leakage.leaks(do, it)
    assert [(r.item_id, r.doc_id) for r in found.collect()] == [(1, 1)]
    left = leakage.without_spans(do, found).first()["text"]
    assert left.startswith("до.") and left.endswith("! после") and "КАПИТ" not in left.upper()


def test_languages(spark):
    said = {
        "ru": ["поздней осенью уставший капитан прячет от всех старую карту", "никто не верит его словам, и город уходит под воду", "музыка лишь усиливает тревогу"],
        "en": ["late in autumn the weary captain hides an old chart", "nobody believes a word of it and the city sinks", "the music only adds to the dread"],
        "de": ["spät im Herbst versteckt der müde Kapitän eine alte Karte", "niemand glaubt ihm ein Wort und die Stadt versinkt", "die Musik verstärkt nur die Unruhe"],
    }
    rows = [(i * 10 + k, "\n\n".join(ps[k:] + ps[:k]), lang) for i in range(6) for k, (lang, ps) in enumerate((x, said[x]) for x in said)]
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(rows)]
    rows += [(900, said["ru"][0] + "\n\n" + said["en"][1] + "\n\n...", "ru-RU"), (901, "nikto ne verit ego slovam i gorod ukhodit pod vodu", "EN"), (902, None, "ru"), (903, "", None), (904, said["de"][0], "und"), (905, said["en"][0], "ru")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fitted(df)
    got = language.segments(df, model)
    assert got.filter("doc_id < 100 and lang <> label").count() == 0
    assert sorted((r.doc_id, r.para_no, r.lang) for r in got.filter("label is null or lang <> label").collect()) == [(900, 1, "en"), (901, 0, "ru"), (904, 0, "de"), (905, 0, "en")]
    assert got.filter("confidence < 0.3 or confidence > 1").count() == 0
    assert {r.doc_id: r.n_langs for r in language.document_languages(got, model).collect()}[900] == 2
    with pytest.raises(ValueError):
        language.fitted(df.limit(0))


def test_unequal_dates_stay_apart(spark):
    df = spark.createDataFrame([(1, dt.date(2023, 1, 1), "a b"), (2, dt.date(2023, 1, 2), "b a"), (3, dt.date(2023, 1, 1), "B, a")], "id bigint, day date, t string")
    got = records.copies(records.rooted(df, F.struct("day", "t"), ["t"]), "id").collect()
    assert [(r.keep, r["copy"]) for r in got] == [(1, 3)]


def test_swapped_keys_with_many_marks():
    known = {"w:" + w: w for w in "последний волк жуткой пустыни без любви и воды сезон бюро".split()}
    typed = "gjcktlybq;djkr;;enrjq;gecnsyb;,tp;k.,db;b;djls;10;ctpjy;,.hj"
    want = "последний волк жуткой пустыни без любви и воды 10 сезон бюро".split()
    assert keyed.meant(typed, known.get) == want
    assert {"w:" + w for w in want if w != "10"} <= set(keyed.lookups(typed))
    assert keyed.key_reading("djkr;yt", lambda w: 0 if w == "волк" else None) is None
    assert keyed.key_reading(typed, lambda w: 0 if w in want else len(w)) == want
    for n in (10, 400):
        assert keyed.key_reading(";".join(["djkr"] * n), lambda w: 0 if w == "волк" else None, longest=20) == ["волк"] * n
