"""Edges that share nodes, and all shortest paths, against brute force; vector means by key."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as tx
from loomgraph.functions import vectors as vx
from loomgraph.operators import clusters, graph, merging, paths, similarity
from loomgraph.plans.queries import QUERIES
from loomgraph.sources import tables

SF = "/root/testdata/sf0.001"


def hypergraph(seed, edges=60, nodes=40, hub=True):
    rng = random.Random(seed)
    rows = {(e, f"n{rng.randrange(nodes)}") for e in range(edges) for _ in range(rng.randint(1, 6))}
    return rows | ({(e, "hub") for e in range(edges)} | {(e, "hub2") for e in range(0, edges, 2)} if hub else set())


@pytest.mark.parametrize("least,heavy", [(1, 10), (2, 10), (2, 1000), (3, 5), (3, 1000)])
def test_edges_that_share_nodes(spark, least, heavy):
    rows = hypergraph(least)
    df = spark.createDataFrame(sorted(rows), "edge_id long, node string")
    of = collections.defaultdict(set)
    for e, n in rows:
        of[e].add(n)
    want = {(a, b, len(of[a] & of[b])) for a, b in itertools.combinations(sorted(of), 2) if len(of[a] & of[b]) >= least}
    assert {tuple(r) for r in graph.connected_edges(df.unionByName(df.limit(5)), least, heavy=heavy).collect()} == want
    assert graph.connected_edges(df.limit(0), least).count() == 0


def test_a_hub_gives_few_candidates(spark):
    """Two nodes an edge, one of them on all edges: only edges with the other one in common are candidates."""
    rows = [(e, n) for e in range(2000) for n in ("hub", f"n{e // 2}")]
    df = spark.createDataFrame(rows, "edge_id long, node string")
    assert graph.connection_candidates(df, 2).count() == 1000  # 1,999,000 pairs meet at the hub
    assert graph.connected_edges(df, 2).count() == 1000
    three = [(e, n) for e in range(600) for n in ("hub", "hub2" if e % 2 else f"x{e}", f"n{e // 3}")]
    df = spark.createDataFrame(three, "edge_id long, node string")
    assert graph.connection_candidates(df, 2, heavy=100).count() < 50_000  # 179,700 at the first hub


@pytest.mark.parametrize("most", [1, 4, 5])
def test_all_shortest_paths(spark, most):
    rows = hypergraph(7, edges=40, nodes=45, hub=False)
    of, on = collections.defaultdict(set), collections.defaultdict(set)
    for e, n in rows:
        of[e].add(n)
        on[n].add(e)
    names = sorted(on)
    pairs = [(a, b) for a in names[:6] for b in names[3:14]] + [("n0", "nowhere")]
    want = set()
    for a, b in pairs:
        if a == b or b not in on:
            continue
        level, seen = [((e,), e) for e in on[a]], set(on[a])
        for _ in range(most):
            hit = [p for p, e in level if b in of[e]]
            if hit:
                want |= {(a, b, len(p), p) for p in hit}
                break
            step = [(p + (f,), f) for p, e in level for n in of[e] for f in on[n] if f not in seen]
            level = sorted(set(step))
            seen |= {e for _, e in level}
    df = spark.createDataFrame(sorted(rows), "edge_id long, node string")
    got = paths.all_shortest_paths(df, spark.createDataFrame(pairs, "seed string, target string"), most).collect()
    assert {(r["seed"], r["target"], r["length"], tuple(r["path"])) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("most, kept", [(3, 3), (4, 2), (5, 3), (5, None)])
def test_paths_from_both_ends(spark, most, kept):
    # chains of edges that only groups of ends reach, beside a part that nothing joins to them
    rows = hypergraph(11, edges=25, nodes=50, hub=False)
    rows |= {(100 + e, f"m{e + i}") for e in range(9) for i in (0, 1)} | {(200 + e, f"m{e + i}") for e in range(4) for i in (0, 1)} | {(300, "z0"), (300, "z1")}
    of, on = collections.defaultdict(set), collections.defaultdict(set)
    for e, n in rows:
        of[e].add(n)
        on[n].add(e)
    ends = sorted(n for n in on if n[0] == "n")[:12] + ["m0", "m1", "m4", "m5", "m9", "z0", "z1"]
    want = set()
    for a in ends:
        level, seen, open_ = [((e,), e) for e in sorted(on[a])], set(on[a]), set(ends) - {a}
        for _ in range(most):
            hit = {b: sorted(p for p, e in level if b in of[e])[:kept] for b in open_ if any(b in of[e] for _, e in level)}
            want |= {(a, b, len(p), p) for b, ps in hit.items() for p in ps}
            open_ -= set(hit)
            level = sorted({(p + (f,), f) for p, e in level for n in of[e] for f in on[n] if f not in seen})
            seen |= {f for _, f in level}
    assert max(w[2] for w in want) == most
    df = spark.createDataFrame(sorted(rows), "edge_id long, node string")
    named = spark.createDataFrame([(n,) for n in ends], "node string")
    got = paths.shortest_paths(df, named, named, most, kept).collect()
    assert {(r["seed"], r["target"], r["length"], tuple(r["path"])) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("kept", [2, None])
def test_one_table_of_ends_is_searched_once(spark, monkeypatch, kept):
    rows = hypergraph(11, edges=25, nodes=50, hub=False) | {(100 + e, f"m{e + i}") for e in range(9) for i in (0, 1)}
    df = spark.createDataFrame(sorted(rows) * 2, "edge_id long, node string")
    named = spark.createDataFrame([(n,) for n in ("n1", "n2", "n3", "n4", "n5", "n6", "m0", "m3", "m4", "m5")], "node string")
    names, write = [], paths.written
    monkeypatch.setattr(paths, "written", lambda df, name: names.append(name) or write(df, name))
    got = {tuple(map(str, r)) for r in paths.shortest_paths(df, named, named, 5, kept).collect()}
    once = collections.Counter(names)
    names.clear()
    assert got == {tuple(map(str, r)) for r in paths.shortest_paths(df, named, named.select("node"), 5, kept).collect()}
    assert max(int(r[2]) for r in got) == 5 and once["edges"] + once["nodes"] <= 5 < names.count("edges") + names.count("nodes")


def test_parts_without_a_way_between_them_stay_closed(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "x"), (4, "y"), (5, "x"), (5, "v"), (6, "v"), (6, "y")], "edge_id long, node string")
    ends = spark.createDataFrame([(n,) for n in "abcdxy"], "start string")
    found = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "seed string, target string")
    near = ends.join(rows, F.col("start") == F.col("node")).select("start", "edge_id")
    left = paths.open_pairs(rows, found, ends, ends, near, 1).collect()
    assert {(r["seed"], r["target"]) for r in left} == {("d", "c"), ("x", "y"), ("y", "x")}


def test_weighted_means(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 2, None]), rng.choice(["x", "y", None]), rng.random(), [rng.random() for _ in range(3)]) for _ in range(500)] + [(7, "z", 0.5, None), (7, "z", None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "a long, b string, w double, v array<double>").repartition(5)
    want = collections.defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    for a, b, w, v in rows:
        if w is not None and v is not None:
            want[a, b][0] += w
            for i in range(3):
                want[a, b][i + 1] += w * v[i]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r["a"], r["b"]): r["mean"] for r in clusters.weighted_means(df, ["a", "b"], "v", "w").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(want) and all(got[k] == pytest.approx([x / want[k][0] for x in want[k][1:]]) for k in got)
    assert clusters.weighted_means(df.limit(0), ["a"], "v").count() == 0


def test_sentences_urls_titles_and_norms(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    for text, want in (("One. Two! three", ["One.", " Two!"]), ("none", []), ("", []), (None, None), ("a.\n", ["a."]), ("?!", []), ("end.", ["end."]), ("a..b", ["a.."]), ("x" * 60_000, [])):
        assert one(tx.sentences(F.lit(text).cast("string"))) == want
    for url, want in (("example.com/a/", "example.com/a"), ("example.com", "example.com"), ("example.com/?q=/", "example.com?q=/"), ("/a/b/", "/a/b"), ("/", "/"), ("HTTP://User@Ex.COM:80/a/", "http://User@ex.com/a"), (" x y/ ", "x y/")):
        assert one(tx.normalized_url(F.lit(url))) == want
    assert one(tx.relation_title(F.lit("works with_Some ONE"))) == "Works with Some one"
    assert one(vx.normalized(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8] and one(vx.normalized(F.array(F.lit(0.0)))) == [0.0]
    assert str(one(vx.normalized_or_nan(F.array(F.lit(0.0), F.lit(0.0))))) == "[nan, nan]" and one(vx.normalized(F.lit(None).cast("array<double>"))) is None


@pytest.mark.parametrize("few", [20, 4096])
def test_merge_plan_without_pairs(spark, few):
    """The plan from each node's best partner is the plan from all pairs, with equal vectors and zero vectors among them; and pairs are counted alike."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(300, 8))
    v[50:58], v[60], v[61:70] = v[40], 0, -v[70]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [])], "id long, v array<double>").repartition(3)
    degrees = spark.createDataFrame([(i, int(d)) for i, d in enumerate(rng.integers(0, 9, size=250))], "node long, degree long")
    pairs = similarity.similar_pairs(vectors, 0.5)
    rows = lambda df: sorted((r["kept"], r["gone"], round(r["similarity"], 7)) for r in df.collect())
    assert rows(merging.plan_of_vectors(vectors, degrees, 0.5, few)) == rows(merging.merge_plan(pairs, degrees))
    counted = {r["id"]: r["n"] for r in similarity.pair_counts(vectors, 0.5).groupBy("id").agg(F.sum("n").alias("n")).collect()}
    assert counted == {r["a"]: r["n"] for r in pairs.groupBy("a").agg(F.count("*").alias("n")).collect()}


def test_common_nodes_meet_in_pairs(spark):
    """Nodes on thirty edges each, of which few edges share two: candidates are little more than what is connected."""
    rng = random.Random(5)
    rows = [(e, n) for e in range(900) for n in rng.sample(range(150), 5)]
    df = spark.createDataFrame(rows + rows[:7] + [(1000, None), (1001, None), (None, 3)], "edge_id long, node long")
    of = collections.defaultdict(set)
    for e, n in rows:
        of[e].add(n)
    want = {(a, b, len(of[a] & of[b])) for a, b in itertools.combinations(sorted(of), 2) if len(of[a] & of[b]) >= 2}
    assert {tuple(r) for r in graph.connected_edges(df, 2).collect()} == want
    assert graph.connection_candidates(df, 2).count() == len(want)  # 60,000 pairs share one node


@pytest.mark.parametrize("batch,group_bytes", [(3, 200), (10_000, 256 << 20)])
def test_pooled_vectors_by_groups_of_keys(spark, batch, group_bytes):
    """Repeated vectors count as often as they are there; ids without vector and keys without ids are left out."""
    rng = random.Random(8)
    rows = [(rng.randrange(40), rng.choice(["x", "y", None]), rng.randrange(12), rng.randrange(2), float(rng.randint(1, 5))) for _ in range(600)]
    rows += [(99, "x", 500, 0, 1.0), (98, "x", None, 0, 1.0), (97, "x", 1, 0, None), (96, "y", 3, 1, 2.0)]
    vectors = [(i, [float(i), float(i * i), 1.0]) for i in range(10)] + [(3, [7.0, 0.0, -1.0]), (4, None), (None, [0.0, 0.0, 0.0])]
    wanted = {}
    for a, b, i, side, w in rows:
        for j, v in vectors:
            if i is not None and i == j and w and v:
                total = wanted.setdefault((a, b), {}).setdefault(side, np.zeros(4))
                total += [w, *(w * x for x in v)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = clusters.pooled(spark.createDataFrame(rows, "a long, b string, id long, side int, w double"), spark.createDataFrame(vectors, "id long, v array<float>"), ["a", "b"], 2, group_bytes).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(found) == len(wanted) and (96, "y") in wanted and (99, "x") not in wanted
    for r in found:
        for side, mean in ((0, r.m0), (1, r.m1)):
            t = wanted[r.a, r.b].get(side)
            assert mean is None if t is None else mean == pytest.approx(list(t[1:] / t[0]))


def test_last_hop_is_not_written(spark):
    """What only the caller reads is not stored, and what is stored are files of columns, no checkpoints."""
    from pathlib import Path

    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "c"), (3, "a")], "edge_id long, node string")
    seeds = rows.where("node = 'a'").select("node")
    stored = {p.name for p in folder.iterdir()}
    assert {(r.seed, r.node, r.length) for r in graph.hop_lengths(rows, seeds, 1).collect()} == {("a", "b", 1), ("a", "c", 1)}
    assert {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in stored} == {"rows"}


def test_incidences_lie_in_bounded_partitions(spark, monkeypatch):
    """The rows of a task don't grow with the table: 6,000 lines in parts of 500 give twelve partitions or more, with an order in one."""
    whole = {tuple(r) for r in tables.order_incidences(spark, SF).collect()}
    monkeypatch.setattr(tables, "DEALT", 500)
    rows = tables.order_incidences(spark, SF)
    sizes = [len(p) for p in rows.rdd.glom().collect()]
    lines = tables.table(spark, SF, "lineitem").count()
    assert len(sizes) >= lines / 500 and max(sizes) < 2500  # an order's customer, parts and suppliers, with chance
    assert {tuple(r) for r in rows.collect()} == whole and len(whole) == sum(sizes)
    nodes = tables.table(spark, SF, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("position"))
    assert {(e, n, p) for e, n, r, p in whole if r == "target"} == {(r[0], f"p:{r[1]}", r[2]) for r in nodes.collect()}


def test_neighborhood_in_small_partitions(spark, monkeypatch):
    """Stages that group incidences run in as many tasks as the table needs, and give the same."""
    want = {tuple(r) for r in QUERIES["neighborhood"](spark, SF).collect()}
    monkeypatch.setattr(tables, "DEALT", 300)
    found = QUERIES["neighborhood"](spark, SF)
    assert {tuple(r) for r in found.collect()} == want
    assert "hashpartitioning(l_orderkey" in plan(found) and "REPARTITION_BY_NUM" in plan(found)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_visible_edges_in_one_pass(spark):
    """Against brute force; a missing node hides nothing, and an edge without a name is none."""
    rng = random.Random(5)
    rows = [(e, f"n{rng.randrange(12)}", rng.choice(["source", "target", "member"]), 0) for e in range(80) for _ in range(rng.randint(1, 3))]
    rows += [(900, None, "source", 0), (901, "n1", "member", 0), (902, "hidden", None, 0), (None, "n1", "source", 0)]
    shown = {f"n{i}" for i in range(6)}
    inc = spark.createDataFrame(rows, "edge_id long, node string, role string, position int")
    nodes = spark.createDataFrame([(n,) for n in [*sorted(shown), "n1"]], "node string")
    hidden = {e for e, n, r, _ in rows if r in ("source", "target") and n is not None and n not in shown}
    found = [r.edge_id for r in graph.visible_edges(inc, nodes).collect()]
    assert sorted(found) == sorted({e for e, *_ in rows if e is not None} - hidden) and {900, 901, 902} <= set(found)
    edges = graph.visible_edges(inc, nodes.where("false"))
    assert sorted(r.edge_id for r in edges.collect()) == sorted({e for e, n, r, _ in rows if e is not None} - {e for e, n, r, _ in rows if r in ("source", "target") and n})


def test_visible_edges_reads_lines_twice(spark):
    """Degrees are written once; beside them, lines are read for orders' customers and for their parts."""
    assert plan(QUERIES["visible_edges"](spark, SF)).count("lineitem.parquet") == 2
