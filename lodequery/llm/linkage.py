"""The same works in several sources that share no key.

Records, the words of their titles, the sounds in those words and their years form a graph. Random walks over it train
skip-gram vectors of the nodes. A form of a title (its words in one spelling, however many records have it) gets two
vectors, the weighted means of those of its stems and of the sounds of its words written as one. Forms are blocked by the
signs of random hyperplanes in several tables, neighbouring buckets included; nothing else brings forms together. Blocked
forms are compared exactly, and the cosine is calibrated into a confidence by evidence that neither the vectors of titles
nor the comparison of words has seen: how often the years of the works agree.

Titles are first brought to the words meant (see ``keyed``), slips of the hand to the commoner word one slip away, and
English words to Russian ones by a dictionary of words that stand at the same place in titles known in both.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..stage import written
from . import keyed
from . import spelling as sp
from .overlap import slip_pairs
from .titles import _LATIN, is_year, joins, sequel, stand_alone, stem

DIM, WALKS, LENGTH, SLOTS = 32, 2, 6, 32
#: Hyperplane tables for the vectors of stems and of sounds, and buckets looked into besides the own one of each table.
TABLES, PROBES = (2, 10), 1
#: Nodes are hashed to this many bits, so the table of vectors has a fixed size (34 MB) whatever the number of words.
NODE_BITS = 18
#: Rows of a lookup table of words that are broadcast; a larger one is joined by shuffle, with the same result.
BROADCAST_WORDS = 500_000


def node(name: str) -> int:
    return (zlib.crc32(name.encode()) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - NODE_BITS)


def sound_nodes(joined: str) -> list[int]:
    """Nodes of the three-letter sounds in words written as one."""
    padded = f"<{sp.skeleton(joined)}>"
    return [node("g:" + padded[i : i + 3]) for i in range(len(padded) - 2)]


def _small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_WORDS else table


def _replaced(rows: DataFrame, ids: list[str], words: str, table: DataFrame) -> DataFrame:
    """``ids`` and ``words`` with every word replaced that ``table`` (word, to) has; ids are unique."""
    each = rows.select(*ids, F.posexplode(words).alias("at", "word")).join(_small(table), "word", "left")
    back = each.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("to", "word").alias("w")))).alias("x"))
    return back.select(*ids, F.transform("x", lambda x: x["w"]).alias(words))


def _commoner(counts: DataFrame, times: int, name: str) -> DataFrame:
    """(word, to): the commonest word one slip away, where it is at least ``times`` as common. ``counts``: (word, n), written."""
    slips = slip_pairs(counts).select("word", F.explode("ups").alias("up")).join(counts.withColumnRenamed("word", "up"), "up")
    best = slips.groupBy("word").agg(F.max(F.struct("n", "up")).alias("best")).join(counts, "word").filter(F.col("best.n") >= times * F.col("n"))
    return written(best.select("word", F.col("best.up").alias("to")), name)


def prepared(refs: DataFrame) -> DataFrame:
    """(ref, source, year, kind, readings) from (ref, source, titles, year, kind).

    ``titles``: array of strings; a reading holds a title's words without joining words, years and words for types, the
    number of a sequel, and whether it is in Latin letters. Titles without words give no reading; records without any
    are left out. A null ``year`` is taken from a title that ends in one."""
    each = refs.select("ref", F.posexplode("titles").alias("no", "title")).filter("title is not null")
    vocab = written(keyed.vocabulary(each, "title"), "title-vocabulary")
    words = written(keyed.canonical(each, "title", vocab).filter(F.size("meant") > 0), "title-words")
    counts = words.select(F.explode("meant").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "title-counts")
    @F.pandas_udf("struct<words: array<string>, joined: string, number: int, latin: boolean, year: int>")
    def reading(meant: pd.Series) -> pd.DataFrame:
        rows = []
        for ws in meant:
            ws = list(ws)
            drop, number = sequel(ws)
            years = [int(w) for w in ws if is_year(w)]
            kept = [w for i, w in enumerate(ws) if i not in drop]
            content = [w for w in kept if not joins(w)] or kept or ws
            if len(content) > 1:
                content = [w for w in content if not stand_alone(w)] or content
            whole = [w for w in kept if not stand_alone(w)] or kept or ws
            rows.append((content, "".join(whole), number, bool(_LATIN.search("".join(content))), years[-1] if years else None))
        return pd.DataFrame(rows, columns=["words", "joined", "number", "latin", "year"]).astype({"number": "Int32", "year": "Int32"})

    fixed = _replaced(words, ["ref", "no"], "meant", _commoner(counts, 3, "title-fixes"))
    read = fixed.select("ref", reading("meant").alias("r"))
    per = read.groupBy("ref").agg(F.collect_set(F.struct("r.words", "r.joined", "r.number", "r.latin")).alias("readings"), F.max("r.year").alias("said"))
    return written(refs.join(per, "ref").select("ref", "source", F.coalesce("year", "said").alias("year"), "kind", "readings"), "references")


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: [stem(w) for w in ws])


def dictionary(ready: DataFrame) -> DataFrame:
    """(en, ru): stems of English words and the stems of the Russian ones that most often stand at the same place."""
    both = ready.filter("exists(readings, r -> r.latin) and exists(readings, r -> not r.latin)")
    pairs = both.select(F.explode(F.filter("readings", lambda r: ~r["latin"])).alias("a"), "readings").select("a", F.explode(F.filter("readings", lambda r: r["latin"])).alias("b"))
    pairs = pairs.filter(F.size("a.words") == F.size("b.words")).select(F.explode(F.arrays_zip(_stems("a.words").alias("ru"), _stems("b.words").alias("en"))).alias("p"))
    counted = pairs.filter("p.en <> p.ru").groupBy("p.en", "p.ru").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("en").agg(F.max(F.struct("n", "ru")).alias("best")).select("en", F.col("best.ru").alias("ru"))


def title_forms(ready: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(form id, words, joined, number, latin, stems, near, near_joined, dated) and (form, ref, source, year), both written.

    ``stems`` are those of the words, English ones as Russian where the dictionary has them; ``near`` and ``near_joined`` the
    same with every word, or all of them as one, replaced by the commonest one slip away. ``dated`` are the distinct sources
    and years of the records that have the form, so its size does not grow with them."""
    each = ready.select("ref", "source", "year", F.explode("readings").alias("r")).select("ref", "source", "year", "r.*")
    what = ["words", "joined", "number", "latin"]
    forms = each.groupBy(*what).agg(F.collect_set(F.struct("source", "year")).alias("dated"))
    forms = written(forms.withColumn("form", F.monotonically_increasing_id()), "title-forms")
    counts = lambda c: forms.select(c.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    near = _replaced(forms, ["form"], "words", _commoner(written(counts(F.explode("words")), "form-words"), 1, "near-words"))
    joined = _commoner(written(counts(F.col("joined")), "form-joined"), 1, "near-joined").select(F.col("word").alias("joined"), F.col("to").alias("near_joined"))
    spelled = forms.join(near.select("form", _stems("words").alias("near")), "form").join(_small(joined), "joined", "left")
    spelled = written(spelled.select("form", *what, "dated", F.coalesce("near_joined", "joined").alias("near_joined"), _stems("words").alias("stems"), "near"), "spelled-forms")
    to = written(dictionary(ready).select(F.col("en").alias("word"), F.col("ru").alias("to")), "title-dictionary")
    latin = spelled.filter("latin")
    read = _replaced(latin, ["form"], "stems", to).join(_replaced(latin, ["form"], "near", to), "form")
    forms = written(spelled.filter("not latin").unionByName(latin.drop("stems", "near").join(read, "form")), "forms")
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}")) for c in what]
    holders = each.alias("e").join(forms.alias("f"), same).select("f.form", "e.ref", "e.source", "e.year").distinct()
    return forms, written(holders, "form-holders")


def walks(nodes: DataFrame, length: int = LENGTH, per_record: int = WALKS, seed: int = 11) -> DataFrame:
    """(walk: array of nodes): ``per_record`` walks from every record of (ref, nodes), record to node to record.

    A node's records are dealt to slots by hash and each slot keeps one; a walker at a node goes on to the record of a
    random slot. So no node, however common, gathers its records, and the join on (node, slot) is spread."""
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SLOTS))
    links = nodes.select("ref", "nodes", F.explode("nodes").alias("node"))
    heads = links.groupBy("node", slot("ref", F.lit(seed)).alias("slot")).agg(F.min_by("nodes", F.xxhash64("ref", "node")).alias("next"))
    heads = written(heads, "walk-heads")
    starts = nodes.filter(F.size("nodes") > 0).select("ref", "nodes", F.explode(F.sequence(F.lit(1), F.lit(per_record))).alias("again"))
    at = starts.select(F.concat_ws("/", "ref", "again").alias("id"), F.col("nodes").alias("here")).withColumn("walk", F.array().cast("array<int>"))
    for step in range(length):
        pick = F.element_at("here", (F.pmod(F.xxhash64("id", F.lit(step), F.lit(seed)), F.size("here")) + 1).cast("int"))
        at = at.withColumn("node", pick).withColumn("walk", F.concat("walk", F.array("node")))
        if step < length - 1:
            at = at.withColumn("slot", slot("id", F.lit(step))).join(heads, ["node", "slot"], "left").select("id", F.coalesce("next", "here").alias("here"), "walk")
    return at.select("walk")


class Nodes:
    """The vectors and weights of all hashed nodes, two tables of fixed size. A node that no walk met keeps the random vector
    that training would have started from, so nodes never share one but by a collision of their hash."""

    def __init__(self, seen: np.ndarray, trained: np.ndarray, counted: np.ndarray, counts: np.ndarray, records: int, seed: int):
        self.vector = np.random.default_rng(seed).standard_normal((1 << NODE_BITS, DIM)).astype(np.float32)
        if len(seen):
            # directions shared by all nodes would put most forms on one side of most hyperplanes
            v = trained - trained.mean(axis=0)
            axes = np.linalg.eigh(v.T @ v)[1][:, -3:]
            self.vector[seen] = v - v @ axes @ axes.T
        self.vector /= np.maximum(np.linalg.norm(self.vector, axis=1, keepdims=True), 1e-9)
        self.weight = np.full(1 << NODE_BITS, math.log(1 + records), np.float32)
        self.weight[counted] = np.log(1 + records / np.maximum(counts, 1))

    def of(self, nodes: list[int]) -> np.ndarray:
        v = self.weight[nodes] @ self.vector[nodes] if nodes else np.zeros(DIM, np.float32)
        return v / max(float(np.linalg.norm(v)), 1e-9)

    def views(self, stems: list[str], joined: str) -> tuple[np.ndarray, np.ndarray]:
        return self.of([node("w:" + s) for s in stems]), self.of(sound_nodes(joined))


def trained(forms: DataFrame, holders: DataFrame, seed: int = 11) -> Nodes:
    """Skip-gram vectors of the nodes on the walks. What comes to the driver is bounded by the number of hashed nodes."""

    @F.pandas_udf("array<int>")
    def nodes_of(stems: pd.Series, joined: pd.Series) -> pd.Series:
        return pd.Series([sorted({*(node("w:" + s) for s in ss), *sound_nodes(j)}) for ss, j in zip(stems, joined)])

    @F.pandas_udf("int")
    def year_node(year: pd.Series) -> pd.Series:
        return year.map(lambda y: node(f"y:{int(y)}"))

    per = forms.select("form", nodes_of("stems", "joined").alias("nodes")).join(holders, "form")
    every = per.groupBy("ref").agg(F.array_distinct(F.flatten(F.collect_list("nodes"))).alias("nodes"), F.max("year").alias("year"))
    dated = every.filter("year is not null").select("ref", F.array_union("nodes", F.array(year_node(F.col("year").cast("double")))).alias("nodes"))
    nodes = written(every.filter("year is null").select("ref", "nodes").unionByName(dated), "walk-nodes")
    counts = nodes.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")).toPandas()
    records = nodes.count()
    seen, vectors = np.zeros(0, np.int64), np.zeros((0, DIM), np.float32)
    if records:
        from pyspark.ml.feature import Word2Vec

        paths = written(walks(nodes, seed=seed).select(F.col("walk").cast("array<string>").alias("walk")), "walks")
        parts = max(2, forms.sparkSession.sparkContext.defaultParallelism // 2)
        model = Word2Vec(vectorSize=DIM, minCount=1, windowSize=3, maxIter=1, numPartitions=parts, seed=seed, inputCol="walk", outputCol="v").fit(paths)
        table = model.getVectors().toPandas()
        seen, vectors = table["word"].astype(np.int64).to_numpy(), np.array([v.toArray() for v in table["vector"]], np.float32).reshape(-1, DIM)
    return Nodes(seen, vectors, counts["node"].to_numpy(np.int64), counts["n"].to_numpy(np.float64), max(records, 1), seed)


def buckets(vector: np.ndarray, planes: np.ndarray, tables: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, probed buckets) of a vector in each table: the signs of its products with the planes, and the same with the sign
    of the product nearest to zero turned, then the second nearest, and so on."""
    bits = len(planes) // tables
    product = (planes @ vector).reshape(tables, bits)
    powers = (1 << np.arange(bits)).astype(np.int64)
    own = (product > 0) @ powers
    near = np.argsort(np.abs(product), axis=1)[:, :probes]
    return own, own[:, None] ^ powers[near]


def blocked(forms: DataFrame, nodes: Nodes, tables: tuple[int, int] = TABLES, probes: int = PROBES, extra_bits: int = 2, seed: int = 11) -> DataFrame:
    """(f, g) with f <= g: ids of forms that meet in some bucket, have the same number of a sequel, and are of two sources. A form
    is hashed as it is spelled and, where a commoner spelling is one slip away, as that.

    The buckets have ``extra_bits`` bits more than the number of forms, so that they stay as small whatever that number is."""
    spark = forms.sparkSession
    bits = max(6, math.ceil(math.log2(forms.count() + 1)) + extra_bits)
    planes = [np.random.default_rng(seed + k).standard_normal((t * bits, DIM)).astype(np.float32) for k, t in enumerate(tables)]
    shared = spark.sparkContext.broadcast(nodes)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, block, probe = [], [], []
            spelled, commoner = zip(b["stems"].map(tuple), b["joined"]), zip(b["near"].map(tuple), b["near_joined"])
            for i, spellings in enumerate(zip(spelled, commoner)):
                for stems, joined in dict.fromkeys(spellings):
                    first = 0
                    for v, p, t in zip(shared.value.views(list(stems), joined), planes, tables):
                        own, near = buckets(v, p, t, probes)
                        place = (first + np.arange(t)) << bits
                        block += [*(place + own), *(place[:, None] + near).ravel()]
                        probe += [False] * t + [True] * near.size
                        at += [i] * (t + near.size)
                        first += t
            yield pd.DataFrame({"form": b["form"].to_numpy()[at], "block": block, "probe": probe, "number": b["number"].fillna(1).astype("int32").to_numpy()[at], "sources": b["sources"].to_numpy()[at]})

    sources = F.array_sort(F.array_distinct(F.transform("dated", lambda d: d["source"])))
    rows = forms.select("form", "number", "stems", "joined", "near", "near_joined", sources.alias("sources")).mapInPandas(hashed, "form bigint, block bigint, probe boolean, number int, sources array<string>")
    rows = written(rows, "blocks")
    a, b = rows.alias("a"), rows.filter("not probe").alias("b")
    two = (F.size("a.sources") > 1) | (F.size("b.sources") > 1) | (F.col("a.sources") != F.col("b.sources"))
    met = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.number") == F.col("b.number"))).filter(two & (F.col("a.probe") | (F.col("a.form") <= F.col("b.form"))))
    return met.select(F.least("a.form", "b.form").alias("f"), F.greatest("a.form", "b.form").alias("g")).distinct()


def alike(a: dict, b: dict) -> float:
    """How alike two readings are: 0 for another title, else the mean certainty of their words."""
    na, nb = a["number"], b["number"]
    if (na if na == na else None) != (nb if nb == nb else None):
        return 0.0
    x, y = list(a["words"]), list(b["words"])
    if "".join(x) == "".join(y) or a["joined"] == b["joined"]:
        return 1.0
    if a["latin"] != b["latin"]:
        p, q = list(a["stems"]), list(b["stems"])
        if len(p) != len(q):
            return 0.0
        same = [1.0 if s == t else 0.9 if sp.is_slip(s, t) else 0.0 for s, t in zip(p, q)]
        return float(np.mean(same)) * 0.95 if min(same) > 0 else 0.0
    if len(x) != len(y):
        return 0.9 if min(len(x), len(y)) == 1 and sp.is_slip(a["joined"], b["joined"]) else 0.0
    if a["latin"]:
        same = [1.0 if s == t or sp.skeleton(s) == sp.skeleton(t) else 0.9 if sp.is_slip(s, t) else 0.0 for s, t in zip(x, y)]
        return float(np.mean(same)) if min(same) > 0 else 0.0
    left, sure = list(y), []
    for w in x:
        if w in left:
            left.remove(w)
            sure.append(1.0)
    rest = [w for w in x if w not in y] if len(left) else []
    for w in rest:
        hit = next((v for v in left if sp.is_slip(w, v) or sp.skeleton(w) == sp.skeleton(v)), None)
        if hit is None:
            return 0.0
        left.remove(hit)
        sure.append(0.9)
    return float(np.mean(sure)) if not left else 0.0


def certainty(forms: DataFrame, compared: DataFrame) -> DataFrame:
    """(step, sure, agree): for steps of two degrees of the angle between forms found alike, how likely they mean one work, and
    by what factor agreeing years raise the odds.

    Years agree in a share t of pairs of one work (taken from the forms of least angle) and in a share c of pairs by chance
    (from all years); in a step where a share m agrees, (m - c) / (t - c) of the pairs are of one work. The share is made to
    fall with the angle. Where no years tell, it is the cosine. At most 91 steps and 200 years come to the driver."""
    spark = forms.sparkSession
    dated = forms.select("form", F.filter("dated", lambda d: d["year"].isNotNull()).alias("dated")).filter(F.size("dated") > 0)
    known = compared.join(dated.select(F.col("form").alias("f"), F.col("dated").alias("x")), "f").join(dated.select(F.col("form").alias("g"), F.col("dated").alias("y")), "g")
    facing = lambda near: F.exists("x", lambda p: F.exists("y", lambda q: (p["source"] != q["source"]) & ((F.abs(p["year"] - q["year"]) <= 1) if near else F.lit(True))))
    told = known.filter(facing(False)).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(facing(True), 1)).alias("agree"))
    have = {r["step"]: (r["n"], r["agree"]) for r in told.collect()}
    years = {r["year"]: r["n"] for r in dated.select(F.explode("dated.year").alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(years.values())
    chance = sum(n * sum(years.get(y + d, 0) for d in (-1, 0, 1)) for y, n in years.items()) / total**2 if total else 1.0
    least = min(have, default=None)
    true = (have[least][1] + 1) / (have[least][0] + 2) if have else 0.0
    out, bound = [], 1.0
    for step in range(91):
        n, agree = have.get(step, (0, 0))
        if true > chance:
            share = (agree / n - chance) / (true - chance) if n else bound
            # as if two more pairs had been as sure as those of the step before
            bound = min(bound, (n * min(max(share, 0.0), 1.0) + 2 * bound) / (n + 2))
        else:
            bound = max(math.cos(math.radians(2 * step)), 0.0)
        out.append((step, bound, true / chance if true > chance else 1.0))
    return spark.createDataFrame(out, "step int, sure double, agree double")


def linked(ready: DataFrame, years_apart: int = 1, least: float = 0.5) -> DataFrame:
    """(ref_a, ref_b, cosine, likeness, confidence): pairs of references to one work from two sources, ref_a < ref_b.

    Two references mean one work if some form of one is a form of the other (same number, every word the same or
    one slip away), their years, where both are known, are at most ``years_apart`` apart, and the confidence is at least
    ``least``. The confidence is the calibrated certainty of the cosine (see :func:`certainty`), its odds raised where both
    years are known, times the likeness; of several forms the pair has the best."""
    forms, holders = title_forms(ready)
    nodes = trained(forms, holders)
    pairs = blocked(forms, nodes)
    facts = forms.select("form", F.struct("words", "joined", "number", "latin", "stems").alias("w"))
    facing = pairs.join(facts.select(F.col("form").alias("f"), F.col("w").alias("x")), "f").join(facts.select(F.col("form").alias("g"), F.col("w").alias("y")), "g")
    shared = forms.sparkSession.sparkContext.broadcast(nodes)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for f, g, x, y in zip(t["f"], t["g"], t["x"], t["y"]):
                if (same := 1.0 if f == g else alike(x, y)) > 0:
                    near = 1.0 if f == g else max(float(a @ b) for a, b in zip(shared.value.views(list(x["stems"]), x["joined"]), shared.value.views(list(y["stems"]), y["joined"])))
                    out.append((f, g, near, same))
            yield pd.DataFrame(out, columns=["f", "g", "cosine", "likeness"])

    found = facing.mapInPandas(compare, "f bigint, g bigint, cosine double, likeness double")
    angle = F.degrees(F.acos(F.greatest(F.least(F.col("cosine"), F.lit(1.0)), F.lit(-1.0))))
    compared = written(found.withColumn("step", F.floor(angle / 2).cast("int")), "compared")
    sure = F.broadcast(certainty(forms, compared))  # 91 rows
    one = holders.select(F.col("form").alias("f"), F.col("ref").alias("r"), F.col("source").alias("rs"), F.col("year").alias("ry"))
    two = holders.select(F.col("form").alias("g"), F.col("ref").alias("s"), F.col("source").alias("ss"), F.col("year").alias("sy"))
    both = compared.join(sure, "step").join(one, "f").join(two, "g").filter("rs <> ss")
    both = both.filter(F.col("ry").isNull() | F.col("sy").isNull() | (F.abs(F.col("ry") - F.col("sy")) <= years_apart))
    odds: Column = F.when(F.col("ry").isNotNull() & F.col("sy").isNotNull(), F.col("agree")).otherwise(F.lit(1.0))
    raised = F.col("sure") * odds / (F.col("sure") * odds + 1 - F.col("sure"))
    rows = both.select(F.least("r", "s").alias("ref_a"), F.greatest("r", "s").alias("ref_b"), (raised * F.col("likeness")).alias("confidence"), "cosine", "likeness")
    best = rows.groupBy("ref_a", "ref_b").agg(F.max(F.struct("confidence", "cosine", "likeness")).alias("b"))
    return best.select("ref_a", "ref_b", "b.cosine", "b.likeness", "b.confidence").filter(F.col("confidence") >= least)
