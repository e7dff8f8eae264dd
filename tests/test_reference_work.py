"""Small fixtures for what the queries' SQL can't show: expected values are written out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import models, search
from loomgraph.functions import text as tx
from loomgraph.functions import vectors as vx
from loomgraph.operators import context, graph, history, paths, pipelines, similarity, themes, upserts
from loomgraph.operators import search as fts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("given, want", [
    ("HTTPS://Example.COM/Path/", "https://example.com/Path"), ("http://a.com:80/", "http://a.com/"), ("https://a.com:443/x/?next=/", "https://a.com/x?next=/"), ("http://a.com/p?next=/", "http://a.com/p?next=/"),
    ("http://a.com", "http://a.com"), (" just text/ ", "just text/"), ("http://a.com/x/#/", "http://a.com/x#/"), ("http://a.com:8080/x/", "http://a.com:8080/x"),
])
def test_normalized_url(spark, given, want):
    assert one(spark, tx.normalized_url(F.lit(given))) == want


@pytest.mark.parametrize("given, want", [
    ("https://example.com/feed", "example.com"), ("http://a.b/rss.xml", "a.b"), ("100% sure?", "100 sure"), ("a/feed/b", "a-b"), ("", "untitled"), ("///", "untitled"), ("x" * 90, "x" * 80), ("- a -", "a"), ("a.xml.b", "a.b"),
])
def test_file_name(spark, given, want):
    assert one(spark, tx.file_name(F.lit(given))) == want


@pytest.mark.parametrize("given, want", [
    ("https://amazon.comabout-aws", "https://amazon.com/about-aws"), ("https://a.com:80", "https://a.com:80"), ("https://a.com/b", "https://a.com/b"), ("", None), ("plain", "plain"),
])
def test_repaired_url(spark, given, want):
    assert one(spark, tx.repaired_url(F.lit(given))) == want


@pytest.mark.parametrize("verb, family", [
    ("acquired by", "Acquisition & Investment"), ("caused", "Cause & Effect"), ("sues", "Regulation & Legal"), ("priced at", "Pricing & Cost"), ("benchmarked", "Performance & Benchmark"), ("hires", "Hiring & Layoffs"), ("hacked", "Security Incident"),
    ("partnered", "Partnership"), ("competes", "Competition"), ("launched", "Product Launch"), ("uses", "Association"), ("xyz", "Other"), ("", "Other"),
])
def test_relation_family(spark, verb, family):
    assert one(spark, tx.relation_family(F.lit(verb))) == family
    hot = one(spark, tx.relation_one_hot(F.lit(family)))
    assert sum(hot) == 1 and hot[tx.FAMILY_ORDER.index(family)] == 1 and len(hot) == 12


@pytest.mark.parametrize("given, want", [("0_works_for", "Works For"), ("chunk_3_made__by", "Made By"), ("rel_1_x_chunk_0", "X"), ("12_", "12_"), ("USED_by", "Used By")])
def test_relation_title(spark, given, want):
    assert one(spark, tx.relation_title(F.lit(given))) == want


def test_texts(spark):
    a, b = F.array(F.lit("A"), F.lit("B")), F.array().cast("array<string>")
    assert one(spark, tx.relation_sentence(a, F.lit("partnered_With"), F.array(F.lit("C")))) == "A, B partnered with C."
    assert one(spark, tx.relation_sentence(a, F.lit("grew"), b)) == "A, B grew."
    assert one(spark, tx.relation_arrow(a, F.lit("partnered_with"), F.array(F.lit("C")))) == "A, B → Partnered With → C"
    assert one(spark, tx.path_description(F.lit("S"), b, F.lit("T"))) == "S connects directly to T" and one(spark, tx.path_description(F.lit("S"), a, F.lit("T"))) == "S → A → B → T"
    assert one(spark, tx.relation_of_edge(F.lit("works_for_chunk0_1"))) == "works for" and one(spark, tx.relation_of_edge(F.lit("0_works_for"))) == "works_for" and one(spark, tx.relation_of_edge(F.lit("plain"))) == "plain"
    assert one(spark, tx.chunk_number(F.lit("x_chunk_12"))) == 12 and one(spark, tx.chunk_number(F.lit("x_chunk"))) is None
    assert one(spark, tx.highlighted(F.lit("C++ and c++, the The"), F.lit("c++ the"))) == "<b>C++</b> and <b>c++</b>, <b>the</b> <b>The</b>"
    assert one(spark, tx.markdown_text(F.lit("<p>a&amp;lt;b</p><BR/>c<li>d</li>"))) == "a<b\n\nc" + "d" and one(spark, tx.markdown_text(F.lit("1 < 2 &amp; 3"))) == "1 < 2 &amp; 3"
    at = F.lit("2024-01-15 09:05:00").cast("timestamp")
    assert one(spark, tx.article_markdown(F.lit("T"), F.lit("L"), F.lit(None).cast("string"), at, F.lit("S"), F.lit(""))) == "# T\n\n**Source:** S\n**Published:** January 15, 2024 at 9:05 AM\n**Link:** L\n\n---\n\n*No content available*"
    assert [one(spark, tx.reading_minutes(F.lit(n))) for n in (0, 5, 200, 650)] == [0, 1, 1, 3] and [one(spark, tx.similarity(F.lit(d))) for d in (0.25, 1.5, -0.5)] == [0.75, 0.0, 1.0]
    assert one(spark, tx.label_of_answer(F.lit('```json\n{"title": "A", "summary": ""}\n```'))) is None and one(spark, tx.keywords_of_answer(F.lit("nothing"))) is None
    assert one(spark, search.contains_folded(F.lit("Café Noir"), "cafe")) and not one(spark, search.contains_folded(F.lit(None).cast("string"), "x"))


def test_vector_errors(spark):
    v = F.array(F.lit(1.0), F.lit(2.0))
    for bad in (vx.l2_distance(v, F.array(F.lit(1.0))), vx.sliced(v, 0, 3), vx.quantized_bits(v), vx.added(v, F.array())):
        with pytest.raises(Exception, match="dimension|elements"):
            one(spark, bad)
    with pytest.raises(ValueError):
        vx.sliced(v, 1, 1)
    assert one(spark, vx.as_json(vx.normalized_or_nan(F.array(F.lit(0.0))))) == "[null]" and one(spark, vx.normalized(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, vx.quantized_bits(F.array(*[F.lit(x) for x in (1.0, -1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 2.0)]))) == [0b10000101]
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])], "id long, v array<double>")
    assert [(r.a, r.b) for r in similarity.similar_pairs(rows, 0.9).collect()] == [(1, 2)]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopeful", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("running", "run"), ("sky", "sky"), ("Äpfel", "apfel")])
def test_stems(word, stem):
    assert search.stem(word) == stem


def test_full_text(spark, tmp_path):
    texts = {1: "Running dogs run", 2: "the Café was closed", 3: "a dog", 4: "", 5: None, 6: "cats and dogs and dogs"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    index = fts.build(docs, "id", "text", f"file://{tmp_path}/index", 4)
    terms = {i: search.terms_of(t) for i, t in texts.items()}
    mean = sum(map(len, terms.values())) / len(texts)

    def want(query):
        wanted, out = set(search.terms_of(query)), {}
        for i, t in terms.items():
            if wanted and all(w in t for w in wanted):
                score = 0.0
                for w in wanted:
                    df = sum(w in x for x in terms.values())
                    tf = t.count(w)
                    score += max(math.log((len(texts) - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
                out[i] = -score
        return out

    for query in ("dog", "DOGS run", "cafe", "nothing", "", "and"):
        got = {r.doc: r["rank"] for r in fts.search(spark, index, query).collect()}
        assert got == pytest.approx(want(query))
    assert fts.search(spark, index, "dog", 1).count() == 1
    long = " ".join(f"w{i}" for i in range(60)) + " dogs " + " ".join(f"v{i}" for i in range(60))
    cut = search.snippet_of(long, frozenset(["dog"]), 8, "<b>", "</b>", "...")
    assert cut.startswith("...<b>dogs</b> v0") and cut.endswith("v6...") and search.snippet_of("a dog.", frozenset(["dog"]), 8, "<b>", "</b>", "...") == "a <b>dog</b>."


def test_content_search(spark, tmp_path):
    chunks = spark.createDataFrame([(10, 1, 0, "dogs bark"), (11, 1, 1, "dogs dogs dogs"), (20, 2, 0, "cats")], "id long, feed_item_id long, chunk_index int, content string")
    edges = spark.createDataFrame([(1, 10), (2, None), (3, 20)], "edge_id long, source_chunk_id long")
    stated = spark.createDataFrame([(2, 1, 1)], "edge_id long, feed_item_id long, chunk_index int")
    inc = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c")], "edge_id long, node string")
    items = spark.createDataFrame([(1, "One"), (2, "Two")], "id long, title string")
    index = fts.build(chunks, "id", "content", f"file://{tmp_path}/index", 2)
    found = {r.node: r for r in fts.search_content(spark, index, chunks, edges, stated, inc, items, "dog").collect()}
    assert set(found) == {"a", "b"} and found["b"]["rank"] < found["a"]["rank"] and found["b"].snippet == "<b>dogs</b> <b>dogs</b> <b>dogs</b>" and found["a"].title == "One"
    direct = spark.createDataFrame([("a", -1.0)], "node string, rank double")
    both = fts.search_all(direct, spark.createDataFrame([(n, r["rank"]) for n, r in found.items()], "node string, rank double"))
    assert sorted((r.node, r.kind) for r in both.collect()) == [("a", "label"), ("b", "content")] and fts.matched(both).count() == 2


def test_clusters(spark):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.3, (25, 3)) for c in ((0, 0, 0), (5, 5, 5), (0, 6, 0))] + [rng.uniform(-30, 30, (6, 3))])
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<double>")
    cores = {r.id: r.core for r in themes.core_distances(rows, len(points), 5).collect()}
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    assert cores == pytest.approx(dict(enumerate(np.sort(d, axis=1)[:, 5])), abs=1e-6)
    reach = np.maximum(np.maximum(d, np.sort(d, axis=1)[:, 5][:, None]), np.sort(d, axis=1)[:, 5][None])
    inside, length = {0}, 0.0
    while len(inside) < len(points):  # Prim
        w, j = min((reach[i, j], j) for i in inside for j in range(len(points)) if j not in inside)
        inside.add(j)
        length += w
    tree = themes.spanning_tree(rows, themes.core_distances(rows, len(points), 5)).collect()
    assert len(tree) == len(points) - 1 and sum(e.w for e in tree) == pytest.approx(length, abs=1e-5)
    found = {r.id: r.cluster for r in themes.hdbscan(rows, 10, 5).collect()}
    assert [found[i] for i in range(75)] == [0] * 25 + [1] * 25 + [2] * 25 and sum(found[i] == themes.NOISE for i in range(75, 81)) >= 4
    assert [(r.cluster, r.membership) for r in themes.hdbscan(rows.limit(1)).collect()] == [(-1, 0.0)] and themes.clamped(30) == (6, 6) and themes.clamped(1000) == (20, 10)


def test_event_vector(spark):
    inc = spark.createDataFrame([(1, "a", "source"), (1, "b", "target"), (1, "c", "member"), (2, "x", "source"), (3, "a", "source")], "edge_id long, node string, role string")
    emb = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "node string, v array<double>")
    idf = spark.createDataFrame([("b", 3.0), ("c", 1.0)], "node string, idf double")
    edges = spark.createDataFrame([(1, "acquired"), (2, "x"), (3, "x")], "edge_id long, label string")
    got = {r.edge_id: r.v for r in themes.event_vectors(inc, emb, idf, edges).collect()}
    t, s = np.array([0.75, 0.25]), np.array([3.0, 4.0])
    hot = [0.0] * 12
    hot[4] = 1.0
    assert set(got) == {1, 3} and got[1] == pytest.approx([*(s / 5), *(t / np.linalg.norm(t)), *((t - s) / np.linalg.norm(t - s)), *hot])
    assert got[3][:6] == pytest.approx([0.6, 0.8, 0, 0, -0.6, -0.8])


def graph_tables(spark):
    inc = spark.createDataFrame([(1, "a", "source", 0), (1, "b", "target", 1), (2, "b", "source", 0), (2, "c", "target", 1), (3, "d", "member", 0)], "edge_id long, node string, role string, position int")
    nodes = spark.createDataFrame([(n, f"Label {n}", None) for n in "abcde"], "node string, label string, node_type string")
    edges = spark.createDataFrame([(1, "works_for"), (2, "owns"), (3, "x")], "edge_id long, label string")
    items = spark.createDataFrame([(1, "One", "l1", 10), (2, "Two", "l2", None)], "id long, title string, link string, pub_date long")
    chunks = spark.createDataFrame([(10, 1, 0, "text of one"), (20, 2, 0, "text of two")], "id long, feed_item_id long, chunk_index int, content string")
    stated = spark.createDataFrame([(1, 1, 0, None), (2, 2, 0, "said")], "edge_id long, feed_item_id long, chunk_index int, chunk_text string")
    return inc, nodes, edges, items, chunks, stated


def test_provenance_and_context(spark):
    inc, nodes, edges, items, chunks, stated = graph_tables(spark)
    linked = edges.withColumn("source_chunk_id", F.when(F.col("edge_id") == 2, 10).cast("long"))
    found = context.edge_provenance(linked, stated, chunks, items)
    assert sorted((r.edge_id, r.feed_item_id, r.chunk_text) for r in found.collect()) == [(1, 1, "text of one"), (2, 1, "text of one"), (2, 2, "said")]
    per = context.by_article(context.node_provenance(inc, nodes.where("node = 'b'"), found), "node").collect()
    assert sorted((r.feed_item_id, r.place, len(r.chunks)) for r in per) == [(1, 1, 1), (2, 2, 1)]  # the one without a date is last
    ways = paths.shortest_paths(inc.where("role <> 'member'"), nodes.where("node in ('a', 'c')"), nodes.where("node in ('a', 'c')"))
    told = paths.first_per_pair(paths.reasoning(ways, paths.hops(ways, inc), edges))
    assert sorted((r.seed, r.target, r.between, r.labels) for r in told.collect()) == [("a", "c", ["b"], ["works_for", "owns"]), ("c", "a", ["b"], ["owns", "works_for"])]
    wanted = context.merged_edges(ways.select(F.explode("path").alias("edge_id")).distinct(), context.edges_of_nodes(inc, nodes))
    said = context.labelled_edges(inc, nodes, edges, stated, wanted).join(wanted, "edge_id")
    few = context.chunks_of_nodes(inc, nodes, stated, chunks, items, 5)
    text = context.context_text(nodes.where("node in ('a', 'c')").withColumn("place", F.col("node")), told, said, few).first().context
    assert text == "## Relevant Concepts\n- Label a\n- Label c\n\n## Reasoning Paths\n- a → (via b) → c\n- c → (via b) → a\n\n## Relationships\n- Label a works for Label b\n- Label b owns Label c\n\n## Source Content\n### From: One\ntext of one\n\n### From: Two\ntext of two"
    assert context.context_text(nodes.limit(0).withColumn("place", F.lit(1)), told.limit(0), said.limit(0), few.limit(0)).first().context == ""
    deep = context.analysis_text(nodes.where("node = 'a'").withColumn("place", F.lit(1)), told.limit(0), said).first().context
    assert deep == "## Related Concepts\n- Label a\n\n## Knowledge Graph Relationships\nLabel a works for Label b.\nLabel b owns Label c."
    stats = graph.statistics(inc, edges, nodes).first()
    assert (stats.nodes, stats.isolated, stats.max_degree) == (5, 2, 2)
    assert [r.edge_id for r in graph.visible_edges(inc, nodes.where("node in ('a', 'b')").select("node")).orderBy("edge_id").collect()] == [1, 3]


def test_texts_name_only_what_they_show(spark, monkeypatch):
    from loomgraph.plans import context as plans

    inc = spark.createDataFrame([(e, "a", "source", 0) for e in range(40)] + [(e, "b", "target", 0) for e in range(40)] + [(50, "z", "source", 0)], "edge_id long, node string, role string, position int")
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "node string, label string")
    edges = spark.createDataFrame([(e, f"l{e}") for e in (2, *range(20, 40), 50)], "edge_id long, label string")
    stated = spark.createDataFrame([(e, i, 0, f"{e} in {i}") for e in range(40) for i in (2, 1)], "edge_id long, feed_item_id long, chunk_index int, chunk_text string")
    wanted = spark.createDataFrame([(e, e % 2 == 0) for e in (*range(40), 50)], "edge_id long, of_path boolean")
    looked_up, label = [], context.labelled_edges
    monkeypatch.setattr(context, "labelled_edges", lambda *tables: looked_up.append(tables[-1].count()) or label(*tables))
    for most in (1, 3, 12, 100):
        found = [tuple(r) for r in context.first_labelled_edges(inc, nodes, edges, stated, wanted, most).orderBy(F.desc("of_path"), "edge_id").limit(most).collect()]
        every = [tuple(r) for r in label(inc, nodes, edges, stated, wanted).join(wanted, "edge_id").orderBy(F.desc("of_path"), "edge_id").limit(most).collect()]
        assert found == every and len(found) == min(most, 21) and found[0][:2] == (2, "l2") and found[0][4] == "2 in 1"
    assert looked_up == [1, 8, 3, 24, 12, 41, 41]
    found_paths = spark.createDataFrame([("s", t, 2, [e, 9]) for t in "cba" for e in (3, 1, 2)], "seed string, target string, length int, path array<long>")
    monkeypatch.setattr(plans, "reasoned", lambda spark, sf_dir, found, rows: found)
    assert sorted((r.target, r.path) for r in plans.first_reasoned(spark, "", found_paths, inc, 2).collect()) == [("a", [1, 9]), ("b", [1, 9])]


def test_question(spark):
    inc, nodes, edges, items, chunks, stated = graph_tables(spark)
    vectors = spark.createDataFrame([(i, n, [float(x) for x in models.hashed_vectors([f"alpha {n}" if n in "ac" else f"other{n}"])[0]]) for i, n in enumerate("abcde")], "id long, node string, v array<double>")
    tables = pipelines.Graph(nodes, edges, inc, stated, chunks, items, vectors)
    phases = list(pipelines.question(spark, tables, "What about alpha?"))
    names = [p for p, _ in phases]
    assert names[:5] == ["keywords", "nodes", "paths", "context", "sources"] and phases[0][1] == ["alpha"]
    assert sorted(r.node for r in phases[1][1].collect()) == ["a", "c"] and "- a → (via b) → c" in phases[3][1] and "".join(x for p, x in phases if p == "answer") == "## Relevant Concepts "
    assert [r.title for r in phases[4][1].orderBy("place").collect()] == ["One", "Two"]
    assert pipelines.deep_analysis("x", models.first_lines) == {"synthesis": "Synthesis of: ", "hypotheses": "Hypotheses from: "}


def test_processing(spark):
    items = spark.createDataFrame([(1, "A text. More.", 5), (2, "", 6), (3, "Other.", None), (4, "Done.", 7)], "id long, full_content string, pub_date long")
    status = spark.createDataFrame([(3, "failed", "before"), (4, "completed", None)], "id long, status string, error string")
    todo = pipelines.unprocessed(items, status)
    assert [r.id for r in todo.collect()] == [1, 3]
    extract = lambda rows: rows.select(F.concat(F.lit("has_chunk0_"), "id").alias("edge_id"), F.lit("has").alias("relation"), F.lit("c_0").alias("chunk_id"), F.col("id").alias("feed_item_id"), F.array(F.lit("n"), F.lit("m"), F.lit("k")).alias("nodes"), F.array(F.lit("n"), F.lit("m")).alias("sources"), F.array(F.lit("m")).alias("targets"))
    rows, after = pipelines.processed(todo, status, extract)
    assert {(r.node_id, r.role) for r in rows["incidences"].collect()} == {("n", "source"), ("m", "source"), ("k", "member")}
    assert {(r.edge_id, r.chunk_text) for r in rows["provenance"].collect()} == {("has_chunk0_1", "A text. More."), ("has_chunk0_3", "Other.")}
    assert {r.id: r.status for r in after.collect()} == {1: "completed", 3: "completed", 4: "completed"}
    _, failed = pipelines.processed(todo, status, lambda rows: rows.select("no such column"))
    assert {r.id: r.status for r in failed.collect()} == {1: "failed", 3: "failed", 4: "completed"}


def test_processing_stream(spark, tmp_path):
    from loomgraph.streaming import ingest

    source = tmp_path / "items"
    for n, rows in enumerate(([(1, "A text."), (2, "B text.")], [(3, "C text.")])):
        spark.createDataFrame(rows, "id long, full_content string").coalesce(1).write.mode("append").parquet(f"file://{source}/{n}")
    items = ingest.feed_stream(spark, f"file://{source}/*", spark.createDataFrame([], "id long, full_content string").schema, 1)
    extract = lambda rows: rows.where(F.col("id") > 0).select(F.concat(F.lit("e_chunk0_"), "id").alias("edge_id"), F.lit("r").alias("relation"), F.lit("c_0").alias("chunk_id"), F.col("id").alias("feed_item_id"), F.array(F.lit("n")).alias("nodes"), F.array(F.lit("n")).alias("sources"), F.array().cast("array<string>").alias("targets"))
    ingest.process_batches(items, f"file://{tmp_path}/out", f"file://{tmp_path}/state", extract).awaitTermination(120)
    assert {r.id: r.status for r in ingest.current_status(spark, f"file://{tmp_path}/out").collect()} == {1: "completed", 2: "completed", 3: "completed"}
    assert spark.read.parquet(f"file://{tmp_path}/out/edges").count() == 3


def test_models(spark):
    rows = spark.createDataFrame([("dogs run",), ("running dog",), (None,), ("",)], "t string").select(models.embedded(F.col("t")).alias("v"), models.answered(F.col("t"), models.first_lines).alias("a")).collect()
    assert rows[0].v == pytest.approx(rows[1].v) and rows[2].v is None and not any(rows[3].v) and [r.a for r in rows] == ["dogs run ", "running dog ", None, ""]


def test_history(spark):
    rows = spark.createDataFrame([(1, 5, "old", "h", 1.0), (2, 6, None, None, None)], "id long, created_at long, synthesis string, hypotheses string, analyzed_at double")
    saved = history.with_analysis(rows, spark.createDataFrame([(2, "s", "x", 9.0)], "id long, synthesis string, hypotheses string, analyzed_at double"))
    assert [(r.id, r.synthesis, r.analyzed_at) for r in history.recent(saved, 5).collect()] == [(2, "s", 9.0), (1, "old", 1.0)]
    assert one(spark, F.size(history.decoded_paths(F.lit("{broken")))) == 0


def test_clearing_and_rebuilding(spark):
    rows = spark.range(3).withColumnRenamed("id", "x")
    left = upserts.cleared({"a": rows, "b": rows}, ["a"])
    assert (left["a"].count(), left["b"].count()) == (0, 3)
    inc = spark.createDataFrame([(i, f"n{i % 6}", r) for i in range(40) for r in ("source", "target")], "edge_id long, node string, role string").withColumn("position", F.lit(0)).withColumn("node", F.when(F.col("role") == "target", F.concat("node", F.lit("t"))).otherwise(F.col("node")))
    nodes = inc.select("node").distinct().withColumn("label", F.col("node"))
    emb = spark.createDataFrame([(f"n{i}{t}", [float(i % 2), float(i % 2 == 0), 0.1 * i, float(bool(t))]) for i in range(6) for t in ("", "t")], "node string, v array<double>")
    edges = inc.select("edge_id").distinct().withColumn("label", F.lit("uses"))
    members, art = pipelines.rebuilt_themes(inc, emb, edges, nodes, F.lit("b2"), lambda prompt: iter(['{"title": "T", ', '"summary": "S"}']), 8, 3)
    assert members.count() == 40 and {r.label for r in art.collect()} == {"T"} and {r.summary for r in art.collect()} == {"S"}
