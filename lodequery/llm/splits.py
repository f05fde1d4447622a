"""Train, validation and test splits in which tied records stay together.

Components are found by frontier breadth-first search from many seeds at once: adjacency lists are hash-partitioned
rows, seeds are the nodes whose degree is greatest among their neighbours, and every hop joins the newest labels only. Where
two labels meet they are linked in a smaller graph of labels, which is searched the same way until no label meets
another. Nodes with very many links are joined by broadcast, so their adjacency stays spread over all tasks. Components
are then given to the splits in the order of their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import lookup_join, running_weights
from ..stage import written

#: A node is a hub from this many links and this share of all link ends on; so there are at most 1 / HUB_SHARE hubs.
HUB_LINKS, HUB_SHARE = 10_000, 0.0005


def _hubs(degree: DataFrame, ends: int, least: int) -> DataFrame | None:
    """(a) of the nodes with very many links, of which there is a bounded number; None without any. ``degree``: (a, degree)."""
    found = degree.filter(F.col("degree") >= max(least, int(ends * HUB_SHARE))).select("a")
    return None if found.isEmpty() else F.broadcast(found)


def _sent(rows: DataFrame, values: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Inner join of rows to ``values`` on ``a``, unique in ``values``; the values of hubs are broadcast."""
    if hubs is None:
        return rows.join(values, "a")
    hot = rows.join(F.broadcast(values.join(hubs, "a", "left_semi")), "a")
    return hot.unionByName(rows.join(hubs, "a", "left_anti").join(values.join(hubs, "a", "left_anti"), "a").select(hot.columns))


def _turned(links: DataFrame) -> DataFrame:
    return links.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _labels(edges: DataFrame, hops: int, hub_links: int, level: int) -> DataFrame:
    """(node, component) of a simple graph given once per edge with a < b.

    In every component the node of greatest rank is a seed and its neighbours take a label, so each level has fewer nodes;
    the labels of local maxima three hops around shrink a path to a third or less, so levels grow with the logarithm."""
    n_edges = edges.count()
    if not n_edges:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    both = written(edges.unionByName(_turned(edges)), "adjacency")
    rank = written(both.groupBy("a").agg(F.count(F.lit(1)).alias("degree")).select("a", "degree", F.struct("degree", F.xxhash64("a", F.lit(level)).alias("h"), "a").alias("rank")), "ranks")
    hubs = _hubs(rank, 2 * n_edges, hub_links)
    near = _sent(both, rank.select("a", "rank"), hubs).groupBy(F.col("b").alias("a")).agg(F.max("rank").alias("other"))
    seeds = rank.join(near, "a").filter("rank > other").select("a", F.col("a").alias("label"))
    labelled = frontier = written(seeds, "seeds")
    for _ in range(hops):
        met = _sent(both, frontier, hubs).groupBy(F.col("b").alias("a")).agg(F.min("label").alias("label"))
        frontier = written(met.join(labelled, "a", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        labelled = labelled.unionByName(frontier)
    left = rank.select("a").join(labelled, "a", "left_anti").withColumn("label", F.col("a"))
    labelled = written(labelled.unionByName(left), "labels")
    seen = _sent(edges, labelled, hubs).select(F.col("b").alias("a"), F.col("label").alias("x")).distinct()
    meeting = _sent(seen, labelled, hubs).filter("x <> label").select(F.least("x", "label").alias("a"), F.greatest("x", "label").alias("b")).distinct()
    above = _labels(written(meeting, "label-graph"), hops, hub_links, level + 1)
    named = labelled.withColumnRenamed("a", "node").join(above.withColumnRenamed("node", "label"), "label", "left")
    return named.select("node", F.coalesce("component", "label").alias("component"))


def components(edges: DataFrame, hops: int = 3, hub_links: int = HUB_LINKS) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint), where component is one of its nodes.

    Self-links, repeated and reversed edges and nulls are allowed; a node with only a self-link is its own component. A
    node with one neighbour takes that neighbour's component and is left out of the search."""
    pairs = edges.filter("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs, "edges")
    links = pairs.filter("a <> b")
    ends = links.unionByName(_turned(links))
    degree = ends.groupBy("a").agg(F.count(F.lit(1)).alias("degree"), F.min("b").alias("only"))
    degree = written(degree, "degrees")
    single = degree.filter("degree = 1").select(F.col("a").alias("node"), "only")
    # of two nodes that have only each other, the lesser stays
    lone = single.join(single.select(F.col("node").alias("only"), F.col("only").alias("back")), "only", "left").filter("back is null or only < node").select("node", "only")
    leaves = written(lone, "leaves")
    # a link is inside the core if neither end has it as its only one: no join, as ends know their degree
    counts = degree.select("a", "degree")
    hubs = _hubs(counts, degree.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0], hub_links)
    one = _sent(links, counts, hubs).filter("degree > 1").select(F.col("b").alias("a"), F.col("a").alias("b"))
    core = _sent(one, counts, hubs).filter("degree > 1").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = _labels(written(core, "core"), hops, hub_links, 0)
    rest = degree.select(F.col("a").alias("node")).join(leaves, "node", "left_anti").select("node").unionByName(pairs.filter("a = b").select(F.col("a").alias("node"))).distinct()
    inner = written(rest.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")
    around = inner.join(degree.select(F.col("a").alias("node"), F.col("degree").alias("n_rows")), "node").select(F.col("node").alias("only"), "component", "n_rows")
    outer = lookup_join(leaves, around, "only", max(10_000, leaves.count() // 1000)).select("node", "component")
    return inner.unionByName(outer)


def grouped(rows: DataFrame, id_col: str, keys: list[Column], carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records tied by any of two keys: (slices, components of slices).

    A slice (k0, k1, carry columns, least, n) stands for all rows that agree in them; ``node`` is where it hangs in the
    graph, and rows that no key ties to others keep their own id as ``least``. The second table is :func:`components`."""
    named = [F.when(k.isNotNull(), F.xxhash64(F.lit(i), k)).alias(f"k{i}") for i, k in enumerate(keys)]
    slices = rows.select(F.col(id_col).alias("id"), *named, *carry).withColumn("alone", F.when(F.coalesce("k0", "k1").isNull(), F.xxhash64(F.lit("row"), F.col("id"))))
    slices = written(slices.groupBy("k0", "k1", "alone", *carry).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "slices")
    return slices.withColumn("node", F.coalesce("k1", "k0", "alone")), components(slices.select(F.col("k0").alias("a"), F.col("k1").alias("b")).filter("a is not null and b is not null"))


def slice_groups(slices: DataFrame, found: DataFrame) -> DataFrame:
    """``slices`` with ``component``; one that hangs on no edge is a component by itself with all of its key."""
    return slices.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def assigned(groups: DataFrame, shares: dict[str, float], large: float = 0.005) -> DataFrame:
    """(component, split) from (component, n): whole components, close to the given shares of the rows.

    Components of at least ``large`` of all rows (so 1 / large of them at most) are placed first, largest first, each in
    the split that lacks most. The rest fill what each split still lacks in the order of their hash."""
    groups = groups.groupBy("component").agg(F.sum("n").alias("n"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    big = groups.filter(F.col("n") >= max(1, total * large)).orderBy(F.desc("n"), "component").collect() if total else []
    lack = {s: share * total for s, share in shares.items()}
    placed = []
    for g in big:
        to = max(lack, key=lack.get)
        lack[to] -= g["n"]
        placed.append((g["component"], to))
    spark = groups.sparkSession
    first = spark.createDataFrame(placed, "component bigint, split string")
    rest = groups.join(F.broadcast(first), "component", "left_anti").withColumn("order", F.xxhash64("component"))
    open_ = sum(max(0.0, v) for v in lack.values())
    left = total - sum(g["n"] for g in big)
    to, edge, edges = F.lit(None).cast("string"), 0.0, []
    for s in lack:
        edge += max(0.0, lack[s]) / (open_ or 1) * left
        edges.append((s, edge))
    placing = F.col("before") + F.col("n") / 2
    for s, edge in reversed(edges[:-1]):
        to = F.when(placing < F.lit(edge), F.lit(s)).otherwise(to if s != edges[-2][0] else F.lit(edges[-1][0]))
    if len(edges) == 1:
        to = F.lit(edges[0][0])
    ranked = running_weights(rest.withColumn("all", F.lit(0)), ["all"], ["order", "component"], "n")
    return first.unionByName(ranked.select("component", to.alias("split")))
