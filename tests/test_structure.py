"""Queries on tables of their own, against brute force."""

import math
from collections import Counter

import pytest

from loomgraph.plans import queries as plans

#: Order, customer, part: chains between every hundredth customer; no other comes near 900.
LINES = [(1, 0, 10), (2, 1, 10), (2, 1, 11), (3, 2, 11), (3, 2, 12), (4, 100, 12), (13, 3, 11), (13, 3, 12), (5, 100, 13), (6, 4, 13), (6, 4, 14), (7, 5, 14), (7, 5, 15), (8, 6, 15), (8, 6, 16), (9, 200, 16), (10, 300, 16), (11, 300, 17), (12, 400, 17), (14, 900, 99), (20, 500, 20), (21, 7, 20), (21, 7, 21), (22, 600, 21)]


def test_paths_of_five_edges(spark, tmp_path):
    spark.createDataFrame(sorted({(o, c) for o, c, _ in LINES}), "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(o, p, 1, 1) for o, _, p in LINES], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    nodes = {}
    for o, c, p in LINES:
        nodes.setdefault(o, set()).update({f"c:{c}", f"p:{p}"})
    seeds = [f"c:{c}" for c in sorted({c for _, c, _ in LINES}) if c % 100 == 0]
    wanted = set()
    for seed in seeds:
        found, level = {}, [(o,) for o in nodes if seed in nodes[o]]
        for _ in range(5):
            for target in seeds:
                ends = sorted(p for p in level if target in nodes[p[-1]])
                if target != seed and target not in found and ends:
                    found[target] = ends[:3]
            level = [(*p, o) for p in level for o in nodes if o not in p and nodes[o] & nodes[p[-1]]]
        wanted |= {(seed, t, p) for t, ps in found.items() for p in ps}
    assert {len(p) for _, _, p in wanted} == {2, 3, 4, 5} and ("c:0", "c:100", (1, 2, 13, 4)) in wanted
    rows = plans.QUERIES["bfs_paths"](spark, str(tmp_path)).collect()
    assert {(r.seed, r.target, tuple(map(int, r.path.split()))) for r in rows} == wanted and all(r.length == len(r.path.split()) for r in rows)
    hops = {(r.seed, r.target, tuple(map(int, r.path.split())), r.hop): r.shared for r in plans.QUERIES["reasoning_paths"](spark, str(tmp_path)).collect()}
    assert hops == {(s, t, p, i): " ".join(sorted(nodes[a] & nodes[b])) for s, t, p in wanted for i, (a, b) in enumerate(zip(p, p[1:]))}
    assert {r.length: r.n for r in plans.QUERIES["path_length_histogram"](spark, str(tmp_path)).collect()} == Counter(len(p) for _, _, p in wanted)


def test_pool_has_the_whole_vector(spark, tmp_path):
    vectors = {0: [float(i) for i in range(64)], 1: [float(-i * i) for i in range(64)]}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 11)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    a, b = math.log(3 / 2) + 1, math.log(3 / 3) + 1
    got = {(r.edge_id, r.pos): r["mean"] for r in plans.QUERIES["event_vector_pool_whole"](spark, str(tmp_path)).collect()}
    wanted = {(1, i): (a * x + b * y) / (a + b) for i, (x, y) in enumerate(zip(vectors[0], vectors[1]))} | {(2, i): y for i, y in enumerate(vectors[1])}
    assert got == pytest.approx(wanted, abs=1e-5)


def test_provenance_and_history_are_whole(spark, tmp_path):
    first = " ".join(f"word{i}" for i in range(80))
    docs = [(0, f"{first}\n\n{'x' * 300}"), (1, None), (2, "short")]
    spark.createDataFrame([(i, t, "a") for i, t in docs], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i,) for i in (0, 1, 7, 14)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.edge_id: r.chunk_text for r in plans.QUERIES["provenance_edge_whole"](spark, str(tmp_path)).collect()}
    assert len(first) > 80 and got == {0: first, 1: "chunk of 1", 7: "(Source text not available)", 14: "short"}
    spark.createDataFrame([(1, 1, "b", "y" * 400), (1, 0, None, "x  " * 100), (2, 0, "a", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    said = {r.conv_id: r.history for r in plans.QUERIES["conversation_history_whole"](spark, str(tmp_path)).collect()}
    assert said == {1: f": {'x ' * 100}\nb: {'y' * 400}", 2: "a: "}
