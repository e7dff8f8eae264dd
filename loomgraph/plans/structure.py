"""Queries on paths, merges, subgraphs and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import chunks
from loomgraph.functions import text as tx
from loomgraph.operators import clusters, graph, merging, paths, similarity
from loomgraph.plans.queries import INCIDENCES, ORDERS, checkpointed, family_sql, query, vectors
from loomgraph.sources import tables as src

PATHS = f"""{ORDERS}, g AS MATERIALIZED (SELECT DISTINCT edge_id, node FROM inc WHERE role <> 'member'),
s AS (SELECT DISTINCT node FROM g WHERE node LIKE 'c:%' AND CAST(substr(node, 3) AS BIGINT) % 100 = 0),
p1 AS MATERIALIZED (SELECT s.node AS seed, [edge_id] AS path, edge_id AS last FROM s JOIN g USING (node)),
p2 AS MATERIALIZED (SELECT DISTINCT seed, list_append(path, b.edge_id) AS path, b.edge_id AS last FROM p1 JOIN g a ON a.edge_id = last JOIN g b USING (node)
WHERE (seed, b.edge_id) NOT IN (SELECT (seed, last) FROM p1)),
p3 AS (SELECT DISTINCT seed, list_append(path, b.edge_id) AS path, b.edge_id AS last FROM p2 JOIN g a ON a.edge_id = last JOIN g b USING (node)
WHERE b.edge_id IN (SELECT edge_id FROM g JOIN s USING (node)) AND (seed, b.edge_id) NOT IN (SELECT (seed, last) FROM p1 UNION ALL SELECT (seed, last) FROM p2)),
f AS (SELECT seed, g.node AS target, path, len(path) AS length FROM (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3) JOIN g ON g.edge_id = last JOIN s ON s.node = g.node WHERE seed <> g.node),
r AS (SELECT *, min(length) OVER (PARTITION BY seed, target) AS least FROM f),
found AS (SELECT seed, target, length, path FROM r WHERE length = least QUALIFY row_number() OVER (PARTITION BY seed, target ORDER BY path) <= 3)"""


def order_paths(spark: SparkSession, sf_dir: str, most_paths: int | None = 3) -> tuple[DataFrame, DataFrame]:
    """Paths of up to five orders between every hundredth customer, and the incidences they run over.

    The SQL ends at three; it gives the same as long as no pair's shortest path is longer. Nodes go by
    number on the way, customers by odd ones.
    """
    checkpointed(spark)
    rows = src.order_incidences(spark, sf_dir).where("role <> 'member'")
    customer = F.startswith("node", F.lit("c:"))
    numbered = rows.select("edge_id", (F.substring("node", 3, 20).cast("long") * 2 + customer.cast("long")).alias("node"))
    seeds = src.table(spark, sf_dir, "orders").where("o_custkey % 100 = 0").select((F.col("o_custkey") * 2 + 1).cast("long").alias("node"))
    found = paths.shortest_paths(numbered, seeds, seeds, most_paths=most_paths)
    named = [F.concat(F.lit("c:"), F.expr(f"({c} - 1) div 2")).alias(c) for c in ("seed", "target")]
    return found.select(*named, "length", "path"), rows


@query(f"WITH {PATHS} SELECT seed, target, CAST(length AS INTEGER) AS length, array_to_string(path, ' ') AS path FROM found")
def bfs_paths(spark, sf_dir):
    return order_paths(spark, sf_dir)[0].select("seed", "target", "length", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"))


@query(f"WITH {PATHS.replace(' QUALIFY row_number() OVER (PARTITION BY seed, target ORDER BY path) <= 3', '')} SELECT seed, target, CAST(length AS INTEGER) AS length, array_to_string(path, ' ') AS path FROM found")
def all_paths(spark, sf_dir):
    """All shortest paths of up to five orders between every hundredth customer."""
    return order_paths(spark, sf_dir, None)[0].select("seed", "target", "length", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"))


@query(f"""WITH {PATHS}, h AS (SELECT seed, target, path, unnest(range(1, len(path))) AS i FROM found)
SELECT seed, target, array_to_string(path, ' ') AS path, CAST(i - 1 AS INTEGER) AS hop, string_agg(a.node, ' ' ORDER BY a.node) AS shared
FROM h JOIN g a ON a.edge_id = path[i] JOIN g b ON b.edge_id = path[i + 1] AND a.node = b.node GROUP BY ALL""")
def reasoning_paths(spark, sf_dir):
    found, rows = order_paths(spark, sf_dir)
    return paths.hops(found, rows).select("seed", "target", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"), "hop", F.array_join("shared", " ").alias("shared"))


@query(f"WITH {PATHS} SELECT CAST(length AS INTEGER) AS length, count(*) AS n FROM found GROUP BY 1")
def path_length_histogram(spark, sf_dir):
    return order_paths(spark, sf_dir)[0].groupBy("length").agg(F.count("*").alias("n"))


MERGES = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT count(*) AS n FROM embeddings),
inc AS (SELECT l_orderkey AS edge_id, l_partkey % n AS node, min(l_linenumber) AS position FROM lineitem, n GROUP BY ALL),
d AS (SELECT node, count(*) AS degree FROM inc GROUP BY node),
s AS MATERIALIZED (SELECT a.id AS a, b.id AS b, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 9) AS similarity FROM e a JOIN e b ON a.id < b.id WHERE similarity > 0.3),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY similarity DESC, a, b) AS i, a, b, similarity, CASE WHEN coalesce(x.degree, 0) >= coalesce(y.degree, 0) THEN a ELSE b END AS kept FROM s LEFT JOIN d x ON x.node = a LEFT JOIN d y ON y.node = b),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS removed, CAST(NULL AS BIGINT) AS kept, CAST(NULL AS BIGINT) AS gone, CAST(NULL AS DOUBLE) AS similarity
UNION ALL SELECT p.i, CASE WHEN ok THEN list_append(removed, other) ELSE removed END, CASE WHEN ok THEN kept END, CASE WHEN ok THEN other END, similarity
FROM (SELECT p.*, w.removed, a + b - p.kept AS other, NOT list_contains(removed, a) AND NOT list_contains(removed, b) AS ok FROM w JOIN p ON p.i = w.i + 1) p),
plan AS MATERIALIZED (SELECT kept, gone, similarity FROM w WHERE gone IS NOT NULL)"""


def part_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The merge plan of part embeddings (cosine above 0.3), and orders' incidences with their nodes."""
    checkpointed(spark)
    e = vectors(spark, sf_dir).select("id", "v")
    n = e.agg(F.count("*").alias("n"))
    lines = src.table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n))  # one row
    inc = lines.groupBy(F.col("l_orderkey").alias("edge_id"), (F.col("l_partkey") % F.col("n")).alias("node")).agg(F.min("l_linenumber").alias("position")).withColumn("role", F.lit("target"))
    degree = inc.groupBy("node").agg(F.count("*").alias("degree"))
    return merging.plan_of_vectors(e, degree, 0.3), inc


@query(f"WITH RECURSIVE {MERGES} SELECT kept, gone, round(similarity, 5) AS similarity FROM plan")
def merge_plan(spark, sf_dir):
    return part_vectors(spark, sf_dir)[0].withColumn("similarity", F.round("similarity", 5))


@query(f"""WITH RECURSIVE {MERGES}, c AS (SELECT gone, kept FROM plan UNION ALL SELECT c.gone, q.kept FROM c JOIN plan q ON q.gone = c.kept),
ends AS (SELECT gone, kept FROM c WHERE kept NOT IN (SELECT gone FROM plan))
SELECT edge_id, coalesce(kept, node) AS node, min(position) AS position FROM inc LEFT JOIN ends ON gone = node GROUP BY 1, 2""")
def simplify_graph(spark, sf_dir):
    plan, inc = part_vectors(spark, sf_dir)
    return merging.merged(inc, plan).select("edge_id", "node", "position")


@query(f"""WITH {ORDERS}, c AS (SELECT DISTINCT node FROM inc WHERE node LIKE 'c:%' AND CAST(substr(node, 3) AS BIGINT) % 100 = 0),
e AS (SELECT DISTINCT edge_id FROM inc JOIN c USING (node)), i AS (SELECT DISTINCT node FROM inc JOIN e USING (edge_id))
SELECT node, count(*) FILTER (role <> 'member') AS degree FROM inc JOIN i USING (node) GROUP BY node""")
def neighborhood(spark, sf_dir):
    """Nodes on an edge with every hundredth customer, and their degrees."""
    rows = src.order_incidences(spark, sf_dir)
    seeds = rows.where(F.startswith("node", F.lit("c:")) & (F.substring("node", 3, 20).cast("long") % 100 == 0)).select("node")
    return graph.subgraph(rows, graph.neighborhood(rows, seeds))


@query(f"""WITH f AS (SELECT label AS cluster, {family_sql('event_type')} AS family, count(*) AS n FROM embeddings JOIN events ON event_id = vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, family) AS rank FROM f) SELECT cluster, family, n AS score, rank FROM r WHERE rank <= 5""")
def cluster_top_families(spark, sf_dir):
    events = src.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), tx.relation_family(F.col("event_type")).alias("family"), F.lit(1).alias("one"))
    rows = vectors(spark, sf_dir).select("id", F.col("label").alias("cluster")).join(events, "id")
    return clusters.top_by_sum(rows, "cluster", "family", "one", 5)


@query(f"""WITH {INCIDENCES}, m AS (SELECT label AS cluster, vec_id AS edge_id FROM embeddings),
t AS (SELECT cluster, node, count(*) AS n FROM m JOIN inc USING (edge_id) GROUP BY ALL), e AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, node) AS rank FROM t),
f AS (SELECT cluster, {family_sql('event_type')} AS family, count(*) AS n FROM m JOIN events ON event_id = edge_id GROUP BY ALL), g AS (SELECT cluster, arg_min(family, (-n, family)) AS family FROM f GROUP BY cluster)
SELECT cluster, string_agg(node, ', ' ORDER BY rank) || ' — ' || any_value(family) AS label FROM e JOIN g USING (cluster) WHERE rank <= 2 GROUP BY cluster""")
def cluster_auto_label(spark, sf_dir):
    one = F.lit(1).alias("one")
    members = vectors(spark, sf_dir).select(F.col("id").alias("edge_id"), F.col("label").alias("cluster"))
    entities = clusters.top_by_sum(members.join(src.event_incidences(spark, sf_dir), "edge_id").select("cluster", "node", one), "cluster", "node", "one", 2)
    edges = src.event_edges(spark, sf_dir).select("edge_id", tx.relation_family(F.col("label")).alias("family"))
    return clusters.auto_labels(entities, clusters.top_by_sum(members.join(edges, "edge_id").select("cluster", "family", one), "cluster", "family", "one", 1))


@query()
def text_chunks(spark, sf_dir):
    docs = src.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(chunks.text_chunks(F.col("text"))).alias("pos", "chunk"))
