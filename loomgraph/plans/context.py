"""Queries on what belongs to nodes and questions: provenance, subgraphs, context edges, chunks, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as tx
from loomgraph.operators import context, graph, paths, similarity
from loomgraph.operators.storage import written
from loomgraph.plans.queries import INCIDENCES, NODES, ORDERS, checkpointed, query, vectors
from loomgraph.plans.structure import PATHS, order_paths
from loomgraph.sources import tables as src

SEEDS = "seeds AS (SELECT 'c:' || c_custkey AS node FROM customer WHERE c_custkey % 100 = 0)"
CHUNKS = "ch AS (SELECT doc_id * 100000 + i AS id, doc_id AS feed_item_id, CAST(i AS INTEGER) AS chunk_index, substr(text, i * 800 + 1, 800) AS content FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 800.0) AS BIGINT))) AS i FROM documents))"
PROVENANCE = f"""n AS (SELECT count(*) AS n FROM documents), {CHUNKS}, pr AS (SELECT event_id AS edge_id, event_id % n AS feed_item_id, 0 AS chunk_index, CASE WHEN event_id % 7 <> 0 THEN 'chunk of ' || event_id END AS chunk_text FROM events, n),
found AS (SELECT edge_id, pr.feed_item_id, pr.chunk_index, coalesce(chunk_text, content, '(Source text not available)') AS chunk_text FROM pr LEFT JOIN ch USING (feed_item_id, chunk_index)
UNION SELECT event_id, feed_item_id, chunk_index, content FROM events, n JOIN ch ON ch.id = event_id % n * 100000 WHERE event_id % 5 = 0)"""


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("c:"), "c_custkey").alias("node"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.edge_provenance(src.linked_edges(spark, sf_dir), src.provenance(spark, sf_dir), src.article_chunks(spark, sf_dir), src.feed_items(spark, sf_dir))


@query(f"WITH {PROVENANCE} SELECT edge_id, feed_item_id, 'Article ' || feed_item_id AS title, chunk_index, md5(chunk_text) AS chunk_text FROM found")
def edge_provenance(spark, sf_dir):
    return found(spark, sf_dir).select("edge_id", "feed_item_id", "title", "chunk_index", F.md5("chunk_text").alias("chunk_text"))


@query(f"""WITH {INCIDENCES}, {PROVENANCE}, w AS (SELECT DISTINCT node, feed_item_id, chunk_index, chunk_text FROM inc JOIN found USING (edge_id) WHERE node LIKE 'u:%0')
SELECT node, feed_item_id, count(*) AS chunks, sum(length(chunk_text)) AS chars, row_number() OVER (PARTITION BY node ORDER BY feed_item_id DESC) AS place FROM w GROUP BY node, feed_item_id""")
def node_provenance(spark, sf_dir):
    """Articles of every tenth user, newest first, with their chunks."""
    inc = src.event_incidences(spark, sf_dir)
    nodes = inc.where("node like 'u:%0'").select("node")
    per = context.by_article(context.node_provenance(inc, nodes, found(spark, sf_dir)), "node")
    chars = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + F.char_length(c["chunk_text"]))
    return per.select("node", "feed_item_id", F.size("chunks").cast("long").alias("chunks"), chars.alias("chars"), "place")


@query(f"""WITH {ORDERS}, {SEEDS}, t AS (SELECT DISTINCT edge_id FROM inc JOIN seeds USING (node)), v AS (SELECT edge_id, array_to_string(list(node ORDER BY position, node) FILTER (role = 'source'), ' ') AS sources, array_to_string(list(node ORDER BY position, node) FILTER (role = 'target'), ' ') AS targets FROM inc JOIN t USING (edge_id) GROUP BY edge_id)
SELECT edge_id, sources, targets FROM v""")
def subgraph_edges(spark, sf_dir):
    """All edges that touch every hundredth customer, wherever they lead."""
    rows = graph.subgraph_edges(src.order_incidences(spark, sf_dir), seeds(spark, sf_dir))
    return rows.select("edge_id", F.array_join("sources", " ").alias("sources"), F.array_join("targets", " ").alias("targets"))


@query("""WITH x AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS p FROM lineitem) SELECT a.e AS a, b.e AS b, count(*) AS shared FROM x a JOIN x b ON a.p = b.p AND a.e < b.e GROUP BY 1, 2 HAVING count(*) >= 2""")
def connected_edges(spark, sf_dir):
    """Orders that share at least two parts."""
    checkpointed(spark)
    rows = src.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge_id"), F.col("l_partkey").alias("node"))
    return graph.connected_edges(rows, 2)


VISIBLE = f"""{ORDERS}, {NODES}, d AS (SELECT node, count(*) AS degree FROM inc WHERE role <> 'member' GROUP BY node), a AS (SELECT node, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN d USING (node)),
t AS (SELECT CASE WHEN count(*) <= 500 THEN 1 ELSE greatest(1, list(degree ORDER BY degree DESC)[500]) END AS threshold FROM a),
vis AS (SELECT node FROM a, t WHERE degree >= threshold OR (node LIKE 'p:%' AND CAST(substr(node, 3) AS BIGINT) % 10 = 0))"""


def seen(spark: SparkSession, sf_dir: str, target: int = 500) -> tuple[DataFrame, DataFrame]:
    """The ``target`` nodes of the highest degrees, those like the last of them, and every tenth part, which is expanded; with incidences of sources and targets."""
    inc, nodes = src.order_incidences(spark, sf_dir), src.order_nodes(spark, sf_dir)
    checkpointed(spark)
    degrees = written(graph.all_degrees(inc, nodes), "degrees")  # read for the threshold and for the nodes
    expanded = src.table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.concat(F.lit("p:"), "p_partkey").alias("node"))
    return graph.visible(degrees, graph.visibility_threshold(degrees, target), expanded), inc.where("role <> 'member'")  # every line has a part, so no edge is lost


@query(f"WITH {VISIBLE} SELECT node FROM vis")
def visible_nodes(spark, sf_dir):
    return seen(spark, sf_dir)[0]


@query(f"WITH {VISIBLE} SELECT DISTINCT edge_id FROM inc WHERE edge_id NOT IN (SELECT edge_id FROM inc WHERE role <> 'member' AND node NOT IN (SELECT node FROM vis))")
def visible_edges(spark, sf_dir):
    """Edges whose sources and targets are all visible."""
    nodes, inc = seen(spark, sf_dir)
    return graph.visible_edges(inc, nodes)


@query(f"WITH {VISIBLE} SELECT node, degree FROM a ORDER BY degree DESC, node LIMIT 5")
def most_connected(spark, sf_dir):
    return graph.most_connected(src.order_incidences(spark, sf_dir), src.order_nodes(spark, sf_dir))


@query(f"""WITH {PATHS}, i AS (SELECT seed, target, path, unnest(range(1, len(path) + 1)) AS i FROM found),
b AS (SELECT seed, target, path, i, list(DISTINCT a.node ORDER BY a.node) AS shared FROM i JOIN g a ON a.edge_id = path[i] JOIN g b ON b.edge_id = path[i + 1] AND a.node = b.node WHERE i < len(path) GROUP BY ALL),
fl AS (SELECT seed, target, path, flatten(list(shared ORDER BY i)) AS s FROM b GROUP BY ALL), o AS (SELECT seed, target, path, list_filter(list_transform(s, lambda x, k: CASE WHEN list_position(s, x) = k THEN x END), lambda x: x IS NOT NULL) AS between FROM fl),
l AS (SELECT seed, target, path, string_agg(o_orderstatus, ' ' ORDER BY i) AS labels FROM i JOIN orders ON o_orderkey = path[i] GROUP BY ALL)
SELECT seed, target, array_to_string(path, ' ') AS path, labels, CASE WHEN o.between IS NULL THEN seed || ' connects directly to ' || target ELSE seed || ' → ' || array_to_string(o.between, ' → ') || ' → ' || target END AS said FROM l LEFT JOIN o USING (seed, target, path)""")
def labelled_paths(spark, sf_dir):
    """Paths between every hundredth customer with the labels of their edges and the nodes between, said in words."""
    named = reasoned(spark, sf_dir, *order_paths(spark, sf_dir))
    return named.select("seed", "target", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"), F.array_join("labels", " ").alias("labels"), tx.path_description(F.col("seed"), F.col("between"), F.col("target")).alias("said"))


def reasoned(spark: SparkSession, sf_dir: str, found_paths: DataFrame, rows: DataFrame) -> DataFrame:
    labels = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_orderstatus").alias("label"))
    return paths.reasoning(found_paths, paths.hops(found_paths, rows), labels)


def first_reasoned(spark: SparkSession, sf_dir: str, found_paths: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """The first path of each of the first ``most`` pairs; what a text doesn't show isn't named."""
    first = paths.first_per_pair(found_paths).orderBy("seed", "target").limit(most).checkpoint()
    return reasoned(spark, sf_dir, first, rows)


@query(f"WITH {PATHS} SELECT seed, target, CAST(length AS INTEGER) AS length, array_to_string(path, ' ') AS path FROM found QUALIFY row_number() OVER (PARTITION BY seed, target ORDER BY path) = 1 ORDER BY length DESC, seed, target LIMIT 15")
def longest_paths(spark, sf_dir):
    """The first path of each pair, those with the most edges first, fifteen shown."""
    first = paths.first_per_pair(order_paths(spark, sf_dir)[0]).select("seed", "target", F.size("path").alias("length"), "path")
    return first.orderBy(F.desc("length"), "seed", "target").limit(15).withColumn("path", F.array_join(F.col("path").cast("array<string>"), " "))


@query(f"""WITH {PATHS}, {NODES}, {SEEDS}, p AS (SELECT DISTINCT unnest(path) AS edge_id FROM found), t AS (SELECT DISTINCT edge_id FROM inc JOIN seeds USING (node) ORDER BY edge_id LIMIT 50),
w AS (SELECT edge_id, true AS of_path FROM p UNION ALL SELECT edge_id, false FROM t WHERE edge_id NOT IN (FROM p))
SELECT edge_id, of_path, array_to_string(list(DISTINCT label ORDER BY label) FILTER (role = 'source'), ', ') || ' ' || lower(any_value(o_orderstatus)) || ' ' || array_to_string(list(DISTINCT label ORDER BY label) FILTER (role = 'target'), ', ') || '.' AS sentence
FROM w JOIN inc USING (edge_id) JOIN nodes USING (node) JOIN orders ON o_orderkey = edge_id GROUP BY 1, 2""")
def context_sentences(spark, sf_dir):
    """Edges of paths and the first fifty direct edges of every hundredth customer, as sentences."""
    edges = context_edges_of(spark, sf_dir, order_paths(spark, sf_dir)[0])
    return edges.select("edge_id", "of_path", tx.relation_sentence(F.col("sources"), F.col("label"), F.col("targets")).alias("sentence"))


def context_edges_of(spark: SparkSession, sf_dir: str, found_paths: DataFrame, most: int | None = None) -> DataFrame:
    """Labelled edges of the paths and the first direct ones; with ``most`` the first so many among them."""
    inc = src.order_incidences(spark, sf_dir)
    wanted = context.merged_edges(found_paths.select(F.explode("path").alias("edge_id")).distinct(), context.edges_of_nodes(inc, seeds(spark, sf_dir)))
    orders = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_orderstatus").alias("label"))
    said = src.provenance(spark, sf_dir)
    tables = inc, src.order_nodes(spark, sf_dir), orders, said, wanted
    return context.labelled_edges(*tables).join(wanted, "edge_id") if most is None else context.first_labelled_edges(*tables, most)


FEW = f"""{INCIDENCES}, {PROVENANCE}, e AS (SELECT DISTINCT edge_id FROM inc WHERE node LIKE 'u:%0'), pl AS (SELECT DISTINCT feed_item_id, chunk_index FROM pr JOIN e USING (edge_id)),
few AS (SELECT ch.* FROM ch JOIN pl USING (feed_item_id, chunk_index) ORDER BY id LIMIT 40)"""


def few_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc = src.event_incidences(spark, sf_dir)
    return context.chunks_of_nodes(inc, inc.where("node like 'u:%0'").select("node"), src.provenance(spark, sf_dir), src.article_chunks(spark, sf_dir), src.feed_items(spark, sf_dir), 40)


@query(f"WITH {FEW} SELECT id, feed_item_id, chunk_index, md5(content) AS content, 0.0::DOUBLE AS distance FROM few")
def chunks_of_nodes(spark, sf_dir):
    """Chunks that provenance links to every tenth user, where no chunk has an embedding."""
    return few_chunks(spark, sf_dir).select("id", "feed_item_id", "chunk_index", F.md5("content").alias("content"), "distance")


@query(f"WITH {FEW} SELECT feed_item_id, 'Article ' || feed_item_id AS title, count(*) AS chunks, row_number() OVER (ORDER BY feed_item_id DESC) AS place FROM few GROUP BY feed_item_id")
def source_articles(spark, sf_dir):
    return context.source_articles(few_chunks(spark, sf_dir)).select("feed_item_id", "title", F.size("chunks").cast("long").alias("chunks"), "place")


E_SQL = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"
L2 = "list_distance(q.v, e.v)"
COSINE = "1 - list_inner_product(q.v, e.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.v, e.v)))"


@query(f"""WITH {E_SQL}, d AS (SELECT q.id AS keyword_at, e.id, {COSINE} AS distance FROM e q, e WHERE q.id % 100 = 0 AND q.id <> e.id), r AS (SELECT *, row_number() OVER (PARTITION BY keyword_at ORDER BY round(distance, 9), id) AS k FROM d WHERE distance < 0.9),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY keyword_at, round(distance, 9)) AS seen FROM r WHERE k <= 5) SELECT keyword_at, id, round(distance, 5) AS distance, row_number() OVER (ORDER BY round(distance, 9), id) AS place FROM o WHERE seen = 1""")
def nodes_of_keywords(spark, sf_dir):
    """The nearest nodes of every hundredth vector, each node once, by the first of them that finds it."""
    return keyword_nodes(spark, sf_dir).withColumn("distance", F.round("distance", 5))


def keyword_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir).select("id", "v")
    hits = similarity.nearest(base.where("id % 100 = 0"), base, 5, "cosine", 0.9)
    return context.first_seen(hits.select(F.col("query").alias("keyword_at"), "id", "distance"))


@query(f"""WITH {E_SQL}, {CHUNKS}, c AS (SELECT ch.id, feed_item_id, content, v FROM ch JOIN e ON ch.id = e.id * 100000), d AS (SELECT q.id AS query, c.id, feed_item_id, content, {COSINE.replace('e.v', 'c.v')} AS distance FROM e q, c WHERE q.id % 100 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), id) AS rank FROM d WHERE distance < 0.8) SELECT query, id, 'Article ' || feed_item_id AS title, length(content) AS chars, round(greatest(0, least(1, 1 - distance)), 5) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def knn_chunks(spark, sf_dir):
    """The nearest first chunks of articles to every hundredth vector (after the first), with their titles."""
    base = vectors(spark, sf_dir).select("id", "v")
    chunks = src.article_chunks(spark, sf_dir).where("chunk_index = 0")
    embedded = chunks.join(base.withColumn("feed_item_id", F.col("id")).select("feed_item_id", "v"), "feed_item_id").select("id", "v")
    hits = similarity.nearest(base.where("id % 100 = 1"), embedded, 5, "cosine", 0.8, itself=True)
    items = src.feed_items(spark, sf_dir).select(F.col("id").alias("feed_item_id"), "title")
    named = hits.join(chunks.select("id", "feed_item_id", F.char_length("content").cast("long").alias("chars")), "id").join(items, "feed_item_id")
    return named.select("query", "id", "title", "chars", F.round(tx.similarity(F.col("distance")), 5).alias("similarity"), "rank")


@query(f"""WITH {E_SQL}, d AS (SELECT q.id AS query, e.id, {L2} AS distance FROM e q, e WHERE q.id % 100 = 0 AND q.id <> e.id AND distance < sqrt(2 * (1 - 0.3::DOUBLE))), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), id) AS rank FROM d)
SELECT query, id, round(1 - distance * distance / 2, 5) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def similar_nodes(spark, sf_dir):
    """Nodes within the L2 distance that a similarity of 0.3 stands for, twenty each."""
    base = vectors(spark, sf_dir).select("id", "v")
    hits = similarity.nearest(base.where("id % 100 = 0"), base, 20, "l2", (2 * (1 - 0.3)) ** 0.5)
    return hits.select("query", "id", F.round(1 - F.col("distance") * F.col("distance") / 2, 5).alias("similarity"), "rank")


@query(f"""WITH {E_SQL}, n AS (SELECT count(*) AS n FROM documents), d AS (SELECT q.id AS query, e.id, {L2} AS distance FROM e q, e WHERE q.id % 100 = 0 AND q.id <> e.id),
a AS (SELECT DISTINCT query, event_id % n AS feed_item_id, round(distance, 5) AS distance FROM d JOIN events ON user_id = d.id, n), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, feed_item_id) AS rank FROM a) SELECT query, feed_item_id, distance, rank FROM r WHERE rank <= 20""")
def similar_articles(spark, sf_dir):
    """Articles of nodes (users) by the nodes' distance from every hundredth one, each article and distance once."""
    base = vectors(spark, sf_dir).select("id", "v")
    n = src.table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    events = src.table(spark, sf_dir, "events").crossJoin(F.broadcast(n)).select(F.col("user_id").alias("id"), (F.col("event_id") % F.col("n")).alias("feed_item_id")).distinct()  # one row
    # every node with events has an article at its distance, so twenty distances hold the first twenty rows
    hits = similarity.nearest_levels(base.where("id % 100 = 0"), base.join(events.select("id"), "id", "left_semi"), 20, 5)
    rows = hits.join(events, "id").select("query", "feed_item_id", "distance").distinct()
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "feed_item_id"))
    return rows.withColumn("rank", rank).where("rank <= 20")


@query(f"""WITH {E_SQL}, d AS (SELECT q.id AS a, e.id AS b, {L2} AS distance FROM e q JOIN e ON q.id < e.id) SELECT a, b, round(1 - distance * distance / 2, 5) AS similarity FROM d WHERE distance < sqrt(2 * (1 - 0.3::DOUBLE)) ORDER BY round(distance, 9), a, b LIMIT 50""")
def merge_suggestions(spark, sf_dir):
    return similarity.near_pairs(vectors(spark, sf_dir).select("id", "v"), 0.3, 50).select("a", "b", F.round("similarity", 5).alias("similarity"))


@query(f"""WITH {E_SQL}, d AS (SELECT q.id AS query, e.id, list_sum(list_transform(list_zip(q.v, e.v), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END))::DOUBLE AS distance FROM e q, e WHERE q.id % 100 = 0 AND q.id <> e.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d) SELECT query, id, distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def knn_hamming(spark, sf_dir):
    """The nearest by the bits of the elements' signs."""
    base = vectors(spark, sf_dir).select("id", "v")
    return similarity.nearest(base.where("id % 100 = 0"), base, 5, "hamming")


@query(f"""WITH {E_SQL}, d AS (SELECT q.id AS query, e.id, {L2} AS distance FROM e q, e WHERE q.id % 100 = 0 AND q.id <> e.id AND e.label IN (1, 2, 3) AND e.id BETWEEN 10 AND 400 AND e.id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), id) AS rank FROM d) SELECT query, id, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def knn_filtered(spark, sf_dir):
    """The nearest among the vectors of some labels (a partition key), ids and a metadata condition."""
    base = vectors(spark, sf_dir)
    allowed = F.col("label").isin(1, 2, 3) & F.col("id").between(10, 400) & (F.col("id") % 2 == 1)
    return similarity.nearest(base.where("id % 100 = 0"), base, 5, "l2", where=allowed).select("query", "id", F.round("distance", 5).alias("distance"), "rank")


@query()
def question_context(spark, sf_dir):
    """The text of a question's context: concepts, paths, relationships and sources, as an answering model takes it."""
    nodes = seeds(spark, sf_dir).join(src.order_nodes(spark, sf_dir), "node").withColumn("place", F.col("node"))
    found_paths, rows = order_paths(spark, sf_dir)
    return context.context_text(nodes, first_reasoned(spark, sf_dir, found_paths, rows, 5), context_edges_of(spark, sf_dir, found_paths, 15), few_chunks(spark, sf_dir))


@query()
def analysis_context(spark, sf_dir):
    nodes = seeds(spark, sf_dir).join(src.order_nodes(spark, sf_dir), "node").withColumn("place", F.col("node"))
    found_paths, rows = order_paths(spark, sf_dir)
    return context.analysis_text(nodes, first_reasoned(spark, sf_dir, found_paths, rows, 10), context_edges_of(spark, sf_dir, found_paths, 20))
