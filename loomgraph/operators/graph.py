"""Hypergraph operators over incidence rows (edge_id, node, role, position)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.storage import written


def degrees(incidences: DataFrame) -> DataFrame:
    """node, degree: its appearances as source and as target; members don't count."""
    return incidences.where(F.col("role").isin("source", "target")).groupBy("node").agg(F.count("*").alias("degree"))


def document_frequencies(incidences: DataFrame, edges: DataFrame, cap: float = 6.0, nodes: DataFrame | None = None) -> DataFrame:
    """node, df (distinct edges), idf = min(ln((N + 1) / (df + 1)) + 1, cap); nodes of the table ``nodes`` without edges have df 0."""
    df = incidences.groupBy("node").agg(F.countDistinct("edge_id").alias("df"))
    if nodes is not None:
        df = nodes.select("node").distinct().join(df, "node", "left").select("node", F.coalesce("df", F.lit(0)).alias("df"))
    n = edges.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("node", "df", F.least(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, F.lit(cap)).alias("idf"))  # n is one row


def of_role(role: str) -> Column:
    """Nodes of a role in order of position, as an aggregate."""
    rows = F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("position", "node"))))
    return F.transform(rows, lambda r: r["node"])


def edge_view(incidences: DataFrame) -> DataFrame:
    """edge_id, sources, targets: arrays by position; edges with neither are dropped."""
    per = incidences.groupBy("edge_id").agg(of_role("source").alias("sources"), of_role("target").alias("targets"))
    return per.where((F.size("sources") > 0) | (F.size("targets") > 0))


def neighbours(incidences: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, neighbour: distinct nodes on a common edge, the seed itself excluded."""
    near = incidences.join(seeds.select("node").distinct(), "node").select("node", "edge_id").distinct()
    return near.join(incidences.select("edge_id", F.col("node").alias("neighbour")), "edge_id").where(F.col("node") != F.col("neighbour")).select("node", "neighbour").distinct()


def neighborhood(incidences: DataFrame, nodes: DataFrame) -> DataFrame:
    """node: the given nodes and all that share an edge with one of them."""
    edges = incidences.join(nodes.select("node").distinct(), "node", "left_semi").select("edge_id").distinct()
    return incidences.join(edges, "edge_id", "left_semi").select("node").unionByName(nodes.select("node")).distinct()


def subgraph(incidences: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, degree: the given nodes with their degrees, 0 for those that are no source or target."""
    return nodes.select("node").distinct().join(degrees(incidences), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def subgraph_edges(incidences: DataFrame, nodes: DataFrame) -> DataFrame:
    """The view of all edges that touch one of the nodes; they may lead out of the set."""
    touching = incidences.join(nodes.select("node").distinct(), "node", "left_semi").select("edge_id").distinct()
    return edge_view(incidences.join(touching, "edge_id", "left_semi"))


def all_degrees(incidences: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, degree for every node of the table, 0 for isolated ones."""
    return nodes.select("node").distinct().join(degrees(incidences), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def statistics(incidences: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes, edges, average_degree, max_degree, isolated, density = edges / (n (n - 1)); isolated nodes count."""
    stats = all_degrees(incidences, nodes).agg(F.count("*").alias("nodes"), F.avg("degree").alias("average_degree"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("isolated"))
    both = stats.crossJoin(edges.agg(F.count("*").alias("edges")))  # two single rows
    density = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return both.select("nodes", "edges", F.round("average_degree", 6).alias("average_degree"), "max_degree", "isolated", F.round(density, 9).alias("density"))


def most_connected(incidences: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    return all_degrees(incidences, nodes).orderBy(F.desc("degree"), "node").limit(k)


#: A node on more edges than that is always indexed together with each edge's other nodes.
HEAVY = 1000


def ranked_edges(rows: DataFrame) -> DataFrame:
    """edge_id, nodes: each edge's distinct nodes as structs of n (edges that have it) and node, from the rarest on."""
    each = rows.groupBy("edge_id").agg(F.collect_set("node").alias("nodes")).select("edge_id", F.explode("nodes").alias("node"))
    counts = each.groupBy("node").agg(F.count("*").alias("n"))
    return each.join(counts, "node").groupBy("edge_id").agg(F.sort_array(F.collect_list(F.struct("n", "node"))).alias("nodes"))


def connection_candidates(rows: DataFrame, least: int, heavy: int = HEAVY) -> DataFrame:
    """a < b: pairs of edges that may have ``least`` nodes in common; all that do are among them. ``rows`` has edge_id, node."""
    return candidates_of(written(ranked_edges(rows), "edges"), least, heavy)


def candidates_of(edges: DataFrame, least: int, heavy: int = HEAVY) -> DataFrame:
    """Candidates among :func:`ranked_edges`.

    Of an edge's nodes, from the rarest on, all but the last ``least - 1`` are indexed: two edges that
    share ``least`` nodes share one of those. Where a common node is on more edges than an edge has nodes (as a
    node sees it, on average) and another one must be shared, too, it is indexed with each of those after it, so the
    edges it has meet in small groups. Keys are hashes; two that are alike by chance give a candidate too many.
    """
    mean = edges.agg(F.least(F.lit(float(heavy)), F.sum(F.size("nodes").cast("double") * F.size("nodes")) / F.sum(F.size("nodes"))).alias("most"))
    indexed = edges.crossJoin(F.broadcast(mean)).select("edge_id", "nodes", "most", F.posexplode(F.slice("nodes", F.lit(1), F.greatest(F.lit(0), F.size("nodes") - (least - 1)))).alias("at", "first"))  # one row
    alone = F.array(F.xxhash64("first.node"))
    if least > 1:
        others = F.transform(F.slice("nodes", F.col("at") + 2, F.size("nodes")), lambda o: F.xxhash64(F.col("first.node"), o["node"]))
        alone = F.when(F.col("first.n") > F.col("most"), others).otherwise(alone)
    keyed = indexed.select(F.explode(alone).alias("key"), "edge_id").repartition("key")
    return keyed.withColumnRenamed("edge_id", "a").join(keyed.withColumnRenamed("edge_id", "b"), "key").where("a < b").select("a", "b").distinct()


def connected_edges(incidences: DataFrame, least: int = 2, most_edges: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """a < b, shared: pairs of edges with at least ``least`` nodes in common.

    Candidates come from :func:`candidates_of` and are counted exactly. ``most_edges`` leaves out
    nodes on more edges than that.
    """
    edges = written(ranked_edges(incidences.select("edge_id", "node").where("edge_id is not null")), "edges")  # read for means, keys and sets
    if most_edges is not None:
        edges = edges.select("edge_id", F.filter("nodes", lambda x: x["n"] <= most_edges).alias("nodes"))
    candidates = written(candidates_of(edges, least, heavy), "candidates")
    ids = candidates.select(F.explode(F.array("a", "b")).alias("edge_id")).distinct()
    sets = edges.join(ids, "edge_id", "left_semi").select("edge_id", F.col("nodes.node").alias("nodes"))
    pairs = candidates.join(sets.select(F.col("edge_id").alias("a"), F.col("nodes").alias("of_a")), "a").join(sets.select(F.col("edge_id").alias("b"), F.col("nodes").alias("of_b")), "b")
    return pairs.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("shared")).where(F.col("shared") >= least)


def visibility_threshold(degrees: DataFrame, target: int) -> DataFrame:
    """One row, threshold: the degree of the ``target``-th node by degree, 1 at least and if there are no more nodes than that."""
    top = degrees.orderBy(F.desc("degree"), "node").limit(target + 1)
    nth = top.agg(F.count("*").alias("n"), F.min("degree").alias("next"), F.sort_array(F.collect_list("degree"), asc=False).alias("top"))  # target + 1 numbers
    return nth.select(F.when(F.col("n") <= target, 1).otherwise(F.greatest(F.lit(1), F.element_at("top", target))).cast("long").alias("threshold"))


def visible(degrees: DataFrame, threshold: DataFrame, expanded: DataFrame) -> DataFrame:
    """node: of at least the threshold's degree, or expanded."""
    rows = degrees.join(expanded.select("node", F.lit(True).alias("open")).distinct(), "node", "left").crossJoin(F.broadcast(threshold))  # one row
    return rows.where((F.col("degree") >= F.col("threshold")) | F.coalesce("open", F.lit(False))).select("node")


def visible_edges(incidences: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge_id: edges whose sources and targets are all among the nodes; an edge without any counts as such.

    A missing node hides no edge. The nodes are hashed where incidences of a node lie, which are not sorted, and
    an edge is decided from all of its rows at once.
    """
    end, shown = F.coalesce(F.col("role").isin("source", "target"), F.lit(False)), nodes.select("node", F.lit(True).alias("shown")).hint("shuffle_hash")
    ends = incidences.where(end).join(shown, "node", "left").select("edge_id", (F.col("node").isNull() | F.coalesce("shown", F.lit(False))).alias("shown"))
    rows = ends.unionByName(incidences.where(~end).select("edge_id", F.lit(True).alias("shown"))).where("edge_id is not null")
    return rows.groupBy("edge_id").agg(F.every("shown").alias("shown")).where("shown").select("edge_id")


def components(links: DataFrame) -> DataFrame:
    """id, component for the ids in ``links`` (a, b): the least id in reach, by labels from neighbours and doubled jumps."""
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other"))).checkpoint()
    labels = both.groupBy("id").agg(F.min("other").alias("least")).select("id", F.least("id", "least").alias("component")).checkpoint()
    while True:
        heard = both.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, "id").select("id", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
        after = nearer.join(jump, "component").select("id", "was", F.least("component", "beyond").alias("component")).checkpoint()
        labels = after.select("id", "component")
        if after.where(F.col("component") != F.col("was")).isEmpty():
            return labels


def hop_lengths(incidences: DataFrame, seeds: DataFrame, most_edges: int = 3) -> DataFrame:
    """seed, node, length: edges on a shortest path, for nodes reached over at most ``most_edges``.

    Frontiers expand node to edge to node; edges met before by a seed are not met again, so a level
    costs no more than the frontier's incidences and pairs of edges are never built.
    """
    rows = written(incidences.select("edge_id", "node").distinct(), "rows")  # read at every level
    frontier = seeds.select(F.col("node").alias("seed"), "node").distinct()
    seen_nodes, seen_edges = frontier.withColumn("length", F.lit(0)), None
    for length in range(1, most_edges + 1):
        # dealt by edge alone and by node alone, they are made distinct and joined where they lie
        edges = frontier.join(rows, "node").select("seed", "edge_id").repartition("edge_id").distinct()
        if seen_edges is not None:
            edges = edges.join(seen_edges, ["seed", "edge_id"], "left_anti")
        if length < most_edges:
            edges = written(edges, "level-edges")
            seen_edges = edges if seen_edges is None else seen_edges.unionByName(edges)
        reached = edges.join(rows, "edge_id").select("seed", "node").repartition("node").distinct()
        frontier = reached.join(seen_nodes, ["seed", "node"], "left_anti")
        if length < most_edges:  # the last level is read once, by whoever asks
            frontier = written(frontier, "level-nodes")
        seen_nodes = seen_nodes.unionByName(frontier.withColumn("length", F.lit(length)))
    return seen_nodes.where(F.col("length") > 0)


def same_or_first(columns: Sequence[str], key: Sequence[str], version: str, rows: DataFrame, keep_if_null: Sequence[str] = ()) -> DataFrame:
    """Upsert: one row per key, each column from the latest version, those in ``keep_if_null`` from the latest that has a value."""
    latest = {c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(version))) if c in keep_if_null else F.max_by(c, version) for c in columns}
    return rows.groupBy(*key).agg(*[f.alias(c) for c, f in latest.items()])
