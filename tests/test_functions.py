from pyspark.sql import functions as F

from loomgraph.functions import text as tx
from loomgraph.functions import vectors as vx
from loomgraph.operators import clusters, graph, merging, paths, similarity


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*x):
    return F.array(*map(F.lit, map(float, x))) if x else F.array().cast("array<double>")


def test_vectors(spark):
    assert value(spark, vx.cosine_similarity(vec(1, 2, 3, 4, 5), vec(1, 2, 3, 4, 5))) == 1
    assert value(spark, vx.cosine_similarity(vec(1, 2, 3), vec(-1, -2, -3))) == -1
    assert value(spark, vx.cosine_similarity(vec(), vec())) == 0
    assert value(spark, vx.cosine_distance(vec(0, 0), vec(1, 0))) is None
    assert value(spark, vx.l2_distance(vec(0, 0, 0), vec(3, 4, 0))) == 5
    assert value(spark, vx.normalized(vec(3, 4, 0))) == [0.6, 0.8, 0]
    assert value(spark, vx.normalized(vec(0, 0))) == [0, 0]
    assert value(spark, vx.quantized_bits(vec(1, 0, -1, 1, 0, 0, 0, 1))) == [0b10001001]


def test_similarity(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.99, 0.01, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])], "id long, v array<double>")
    assert [(r.a, r.b) for r in similarity.similar_pairs(rows, 0.95).collect()] == [(0, 1)]
    found = similarity.nearest(rows.where("id = 0"), rows, 9, "l2")
    assert [r.id for r in found.orderBy("rank").collect()] == [1, 2, 3]
    assert similarity.nearest(rows.where("id > 9"), rows, 9).count() == 0


def test_text(spark):
    said = {"apple": '"apple*"', "apple revenue growth": '"apple" "revenue" "growth*"', "  hello  world  ": '"hello" "world*"', "  ": "", 'say "hello"': '"say" """hello""*"'}
    assert {k: value(spark, tx.match_query(F.lit(k))) for k in said} == said
    assert value(spark, tx.strip_html(F.lit("<p>a &amp;lt; b</p>\n<b>c</b> "))) == "a < b c"
    names = {"Valid-File_Name 123": "Valid-File_Name 123", "": "untitled", "  Test Name  ": "Test Name", "https://aws.amazon.com/blogs/aws/feed": "aws.amazon.com-blogs-aws"}
    assert {k: value(spark, tx.file_name(F.lit(k))) for k in names} == names
    families = {"leads to": "Cause & Effect", "PARTNERED WITH": "Partnership", "merged with": "Acquisition & Investment", "rivals": "Competition", "fined": "Regulation & Legal", "hacked": "Security Incident", "priced at": "Pricing & Cost", "scored": "Performance & Benchmark", "laid off": "Hiring & Layoffs", "announced": "Product Launch", "uses": "Association", "": "Other"}
    assert {k: value(spark, tx.relation_family(F.lit(k))) for k in families} == families


def test_hops(spark):
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    edges = {1: "ab", 2: "bc", 3: "cd", 4: "ad", 5: "x"}
    rows = spark.createDataFrame([(e, n) for e, ns in edges.items() for n in ns], "edge_id long, node string")
    seeds = spark.createDataFrame([("a",), ("x",)], "node string")
    assert {(r.seed, r.node): r.length for r in graph.hop_lengths(rows, seeds, 3).collect()} == {("a", "b"): 1, ("a", "d"): 1, ("a", "c"): 2}


def test_paths(spark):
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    edges = {1: "ab", 2: "bc", 3: "bc", 4: "cd", 5: "ax", 6: "xd", 7: "bc", 8: "bc"}
    rows = spark.createDataFrame([(e, n) for e, ns in edges.items() for n in ns], "edge_id long, node string")
    ends = spark.createDataFrame([("a",), ("c",), ("d",), ("alone",)], "node string")
    found = paths.shortest_paths(rows, ends, ends, 5, 3)
    got = {}
    for r in found.collect():
        got.setdefault(r.seed + r.target, []).append(list(r.path))
    assert {k: sorted(v) for k, v in got.items()} == {
        "ac": [[1, 2], [1, 3], [1, 7]], "ad": [[5, 6]], "cd": [[4]], "dc": [[4]], "da": [[6, 5]], "ca": [[2, 1], [3, 1], [7, 1]]}
    assert {tuple(r.path): r.shared for r in paths.hops(found, rows).where("seed = 'a'").collect()} == {(1, 2): ["b"], (1, 3): ["b"], (1, 7): ["b"], (5, 6): ["x"]}
    assert paths.shortest_paths(rows.limit(0), ends, ends).count() == 0
    assert sorted(r.node for r in graph.neighborhood(rows, ends.where("node in ('d', 'alone')")).collect()) == ["alone", "c", "d", "x"]
    assert {r.node: r.degree for r in graph.subgraph(rows.selectExpr("*", "'member' role"), ends).collect()} == dict.fromkeys(["a", "c", "d", "alone"], 0)


def test_merging(spark):
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    pairs = [(1, 2, 0.99), (2, 3, 0.98), (1, 3, 0.97), (3, 4, 0.97), (5, 6, 0.99), (6, 7, 0.95), (5, 7, 0.95)]
    degree = {1: 1, 2: 5, 3: 9, 4: 9, 6: 2}
    gone, plan = set(), set()
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in gone and b not in gone:
            kept, other = (a, b) if degree.get(a, 0) >= degree.get(b, 0) else (b, a)
            gone.add(other)
            plan.add((kept, other))
    rows = spark.createDataFrame(pairs, "a long, b long, similarity double")
    found = merging.merge_plan(rows, spark.createDataFrame(list(degree.items()), "node long, degree long"))
    assert {(r.kept, r.gone) for r in found.collect()} == plan
    assert {r.gone: r.kept for r in merging.final_nodes(found).collect()} == {1: 3, 2: 3, 4: 3, 5: 6, 7: 6}
    inc = spark.createDataFrame([(1, 1, "source", 0), (1, 2, "source", 3), (1, 2, "target", 0), (2, 8, "source", 0)], "edge_id long, node long, role string, position int")
    assert sorted(map(tuple, merging.merged(inc, found).collect())) == [(1, 3, "source", 0), (1, 3, "target", 0), (2, 8, "source", 0)]
    assert merging.merge_plan(rows.limit(0), inc.selectExpr("node", "1L degree")).count() == 0
    labels = clusters.auto_labels(spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "cluster int, node string, rank int"), spark.createDataFrame([(0, "Other", 1), (1, "Other", 1)], "cluster int, family string, rank int"))
    assert {r.cluster: r.label for r in labels.collect()} == {0: "x, y — Other", 1: "Cluster"}


def test_streaming_ingest(spark, tmp_path):
    from loomgraph.streaming import ingest

    rows = spark.createDataFrame([("g1", "2024-01-01 00:00:00", "x"), ("g1", "2024-01-01 01:00:00", "y"), ("g2", "2024-01-01 00:00:00", "z")], "guid string, ts string, t string").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    items = ingest.first_seen(ingest.feed_stream(spark, f"{tmp_path}/in", rows.schema), ["guid"], "ts")
    ingest.write_batches(items, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    assert sorted(r.guid for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["g1", "g2"]
