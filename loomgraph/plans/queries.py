"""Queries over the driver's tables, with the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import chunks
from loomgraph.functions import text as tx
from loomgraph.functions import vectors as vx
from loomgraph.operators import clusters, graph, search, similarity
from loomgraph.sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def searched(spark: SparkSession, sf_dir: str, metric: str, within: float | None) -> DataFrame:
    base = vectors(spark, sf_dir).select("id", "v")
    found = similarity.nearest(base.where(F.col("id") % 100 == 0), base, 5, metric, within)
    return found.select("query", "id", F.round("distance", 5).alias("distance"), "rank")


KNN_SQL = """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.id AS query, e.id, {distance} AS distance FROM e q, e WHERE q.id % 100 = 0 AND q.id <> e.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), id) AS rank FROM d {where})
SELECT query, id, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""


@query(KNN_SQL.format(distance="1 - list_inner_product(q.v, e.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.v, e.v)))", where="WHERE distance < 0.8"))
def knn_cosine(spark, sf_dir):
    return searched(spark, sf_dir, "cosine", 0.8)


@query(KNN_SQL.format(distance="list_distance(q.v, e.v)", where=""))
def knn_l2(spark, sf_dir):
    return searched(spark, sf_dir, "l2", None)


@query(KNN_SQL.format(distance="list_sum(list_transform(list_zip(q.v, e.v), lambda p: abs(p[1] - p[2])))", where=""))
def knn_l1(spark, sf_dir):
    return searched(spark, sf_dir, "l1", None)


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) AS similarity FROM e a JOIN e b ON a.id < b.id)
SELECT a, b, round(similarity, 5) AS similarity FROM s WHERE similarity > 0.3""")
def similar_pairs(spark, sf_dir):
    return similarity.similar_pairs(vectors(spark, sf_dir).select("id", "v"), 0.3).select("a", "b", F.round("similarity", 5).alias("similarity"))


@query("""SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 5) AS squares,
round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 5) AS l1, round(sqrt(list_sum(list_transform(embedding[1:8]::DOUBLE[], lambda x: x * x))), 5) AS head_norm,
list_sum(list_transform(embedding::DOUBLE[], lambda x: CAST(trunc((x + 1) / (2.0::DOUBLE / 255) - 128) AS INTEGER))) AS int8_sum,
list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS positive FROM embeddings""")
def vector_scalars(spark, sf_dir):
    v, zero = F.col("embedding"), F.transform("embedding", lambda x: F.lit(0.0))
    none = F.transform(vx.quantized_bits(v), lambda x: F.lit(0))
    return src.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(v).cast("long").alias("dims"), F.round(vx.dot(v, v), 5).alias("squares"), F.round(vx.l1_distance(v, zero), 5).alias("l1"), F.round(vx.norm(vx.sliced(v, 0, 8)), 5).alias("head_norm"),
        F.aggregate(vx.quantized_int8(v), F.lit(0), lambda a, x: a + x).cast("long").alias("int8_sum"), vx.hamming(vx.quantized_bits(v), none).cast("long").alias("positive"))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(x::DOUBLE, 6) AS value FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def vector_elements(spark, sf_dir):
    return src.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("value"))


INCIDENCES = """inc AS (SELECT event_id AS edge_id, 'u:' || user_id AS node, 'source' AS role FROM events
UNION ALL SELECT event_id, 'k:' || json_extract_string(props, '$.k'), 'target' FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)"""
ORDERS = """inc AS (SELECT o_orderkey AS edge_id, 'c:' || o_custkey AS node, 'source' AS role, 0 AS position FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT l_orderkey, 'p:' || l_partkey, 'target', min(l_linenumber) FROM lineitem GROUP BY ALL
UNION ALL SELECT l_orderkey, 's:' || l_suppkey, 'member', min(l_linenumber) FROM lineitem GROUP BY ALL)"""


@query(f"WITH {INCIDENCES} SELECT node, count(*) AS degree FROM inc GROUP BY node")
def full_graph_degrees(spark, sf_dir):
    return graph.degrees(src.event_incidences(spark, sf_dir))


@query(f"WITH {ORDERS} SELECT node, count(*) AS degree FROM inc WHERE role <> 'member' GROUP BY node")
def order_graph_degrees(spark, sf_dir):
    return graph.degrees(src.order_incidences(spark, sf_dir))


@query(f"WITH {INCIDENCES}, n AS (SELECT count(*) AS n FROM events) SELECT node, count(DISTINCT edge_id) AS df, round(least(ln((n + 1) / (count(DISTINCT edge_id) + 1)) + 1, 6.0), 6) AS idf FROM inc, n GROUP BY node, n")
def node_df_idf(spark, sf_dir):
    return graph.document_frequencies(src.event_incidences(spark, sf_dir), src.event_edges(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


NODES = """nodes AS (SELECT 'c:' || c_custkey AS node, c_name AS label, 'customer' AS node_type FROM customer UNION ALL SELECT 'p:' || p_partkey, p_name, 'part' FROM part UNION ALL SELECT 's:' || s_suppkey, s_name, 'supplier' FROM supplier)"""


@query(f"""WITH {ORDERS}, {NODES}, d AS (SELECT node, count(*) AS degree FROM inc WHERE role <> 'member' GROUP BY node), a AS (SELECT node, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN d USING (node))
SELECT count(*) AS nodes, (SELECT count(*) FROM orders) AS edges, round(avg(degree), 6) AS average_degree, max(degree) AS max_degree, count(*) FILTER (degree = 0) AS isolated,
round((SELECT count(*) FROM orders) / (count(*) * (count(*) - 1)), 9) AS density FROM a""")
def graph_statistics(spark, sf_dir):
    """Customers without orders, and suppliers, which are members only, are isolated."""
    return graph.statistics(src.order_incidences(spark, sf_dir), src.table(spark, sf_dir, "orders"), src.order_nodes(spark, sf_dir))


@query(f"""WITH {ORDERS}, {NODES}, n AS (SELECT count(*) AS n FROM orders), d AS (SELECT node, count(DISTINCT edge_id) AS df FROM inc GROUP BY node)
SELECT node, coalesce(df, 0) AS df, round(least(ln((n + 1) / (coalesce(df, 0) + 1)) + 1, 6.0), 6) AS idf FROM nodes LEFT JOIN d USING (node), n""")
def all_node_idf(spark, sf_dir):
    """As ``node_df_idf``, but nodes without edges have df 0."""
    return graph.document_frequencies(src.order_incidences(spark, sf_dir), src.table(spark, sf_dir, "orders"), nodes=src.order_nodes(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query(f"""WITH {ORDERS} SELECT edge_id, array_to_string(list(node ORDER BY position, node) FILTER (role = 'source'), ' ') AS sources, array_to_string(list(node ORDER BY position, node) FILTER (role = 'target'), ' ') AS targets
FROM inc GROUP BY edge_id""")
def context_edges(spark, sf_dir):
    return graph.edge_view(src.order_incidences(spark, sf_dir)).select("edge_id", F.array_join("sources", " ").alias("sources"), F.array_join("targets", " ").alias("targets"))


@query(f"WITH {ORDERS} SELECT DISTINCT a.node, b.node AS neighbour FROM inc a JOIN inc b USING (edge_id) WHERE a.role = 'source' AND b.role = 'target' AND a.node <> b.node")
def customer_neighbours(spark, sf_dir):
    rows = src.order_incidences(spark, sf_dir).where("role <> 'member'")
    return graph.neighbours(rows, rows.where("role = 'source'")).where(F.startswith("neighbour", F.lit("p:")))


@query(f"""WITH {ORDERS}, g AS (SELECT DISTINCT edge_id, node FROM inc WHERE role <> 'member'), s AS (SELECT DISTINCT node FROM g WHERE node LIKE 'c:%' AND CAST(substr(node, 3) AS BIGINT) % 100 = 0),
l1 AS (SELECT DISTINCT s.node AS seed, b.node FROM s JOIN g a ON a.node = s.node JOIN g b USING (edge_id)),
l2 AS (SELECT DISTINCT l1.seed, b.node FROM l1 JOIN g a ON a.node = l1.node JOIN g b USING (edge_id)),
u AS (SELECT seed, node, 1 AS length FROM l1 UNION ALL SELECT seed, node, 2 FROM l2)
SELECT seed, node, min(length) AS length FROM u WHERE seed <> node GROUP BY seed, node""")
def hop_lengths(spark, sf_dir):
    rows = src.order_incidences(spark, sf_dir).where("role <> 'member'")
    seeds = rows.where(F.startswith("node", F.lit("c:")) & (F.substring("node", 3, 20).cast("long") % 100 == 0)).select("node")
    checkpointed(spark)
    return graph.hop_lengths(rows, seeds, 2)


def checkpointed(spark: SparkSession) -> None:
    """Sets the session's checkpoint folder, ``spark.checkpoint.dir``; only a local session may go without it."""
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            base = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(base)


@query("""WITH n AS (SELECT count(*) AS n FROM documents), p AS (SELECT event_id, event_id % n AS item, CASE WHEN event_id % 7 <> 0 THEN 'chunk of ' || event_id END AS chunk FROM events, n)
SELECT event_id AS edge_id, item AS feed_item_id, coalesce(chunk, text, '(Source text not available)') AS chunk_text FROM p LEFT JOIN documents ON doc_id = item""")
def provenance_edge(spark, sf_dir):
    items = src.feed_items(spark, sf_dir).select(F.col("id").alias("feed_item_id"), "full_content")
    return src.provenance(spark, sf_dir).join(items, "feed_item_id", "left").select("edge_id", "feed_item_id", F.coalesce("chunk_text", "full_content", F.lit("(Source text not available)")).alias("chunk_text"))


@query()
def provenance_edge_whole(spark, sf_dir):
    """As ``provenance_edge``, but a missing text is the whole content of the item's chunk of that index."""
    docs = src.feed_items(spark, sf_dir).select(F.col("id").alias("feed_item_id"), F.posexplode(chunks.text_chunks(F.col("full_content"))).alias("chunk_index", "content"))
    found = src.provenance(spark, sf_dir).join(docs, ["feed_item_id", "chunk_index"], "left")
    return found.select("edge_id", "feed_item_id", F.coalesce("chunk_text", "content", F.lit("(Source text not available)")).alias("chunk_text"))


@query("""SELECT doc_id AS id FROM documents LEFT JOIN (SELECT event_id, event_type FROM events) ON event_id = doc_id
WHERE text IS NOT NULL AND text <> '' AND (event_id IS NULL OR event_type = 'click')""")
def unprocessed_items(spark, sf_dir):
    """Items without a status row, or with a failed one (events stand in for statuses, 'click' for failed)."""
    status = src.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type")
    items = src.feed_items(spark, sf_dir).where(F.col("full_content").isNotNull() & (F.col("full_content") != ""))
    return items.join(status, "id", "left").where(F.col("event_type").isNull() | (F.col("event_type") == "click")).select("id")


def stripped_sql() -> str:
    sql = "regexp_replace(html, '<[^>]+>', '', 'g')"
    for entity, char in tx.ENTITIES:
        sql = "replace({}, '{}', '{}')".format(sql, entity, char.replace("'", "''"))
    return f"regexp_replace(regexp_replace({sql}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"SELECT page_id, {stripped_sql()} AS text FROM pages")
def html_strip(spark, sf_dir):
    return src.table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text"))


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s AS sentence FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]+[.!?]+')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?]+[.!?]+'), 1) AS i FROM documents)")
def sentence_split(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS pos, substr(text, i * 800 + 1, 800) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 800.0) AS BIGINT))) AS i FROM documents)")
def fixed_chunks(spark, sf_dir):
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / 800).cast("int") - 1), lambda i: F.substr("text", i * 800 + 1, F.lit(800)))
    return src.table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", F.posexplode(chunks).alias("pos", "chunk"))


@query(r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), ' '), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(list_zip(w, range(1, len(w) + 1)), lambda p: '"' || replace(p[1], '"', '""') || CASE WHEN p[2] = len(w) THEN '*"' ELSE '"' END), ' ') AS match FROM w""")
def match_queries(spark, sf_dir):
    return src.table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.match_query(F.col("text")).alias("match"))


@query("SELECT conv_id, turn, array_to_string(list_slice(list_filter(w, lambda x: length(x) > 2 AND x NOT IN ({})), 1, 5), ' ') AS words FROM (SELECT conv_id, turn, list_transform(list_sort(list_transform(list_distinct(a), lambda x: [lpad(CAST(list_position(a, x) AS VARCHAR), 9, '0'), x])), lambda p: p[2]) AS w FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS a FROM conversations))".format(", ".join(f"'{w}'" for w in tx.STOPWORDS)))
def keyword_fallback(spark, sf_dir):
    return src.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(tx.keywords(F.col("text")), " ").alias("words"))


#: The families in SQL, written out: {} is the verb.
FAMILY_SQL = """CASE WHEN regexp_matches(lower({0}), 'cause|result in|lead to|leads to|led to|trigger|enable|prevent|block|reduce|increase|impact|affect|disrupt|transform|drive|accelerate') THEN 'Cause & Effect'
WHEN regexp_matches(lower({0}), 'partner|collaborate|team up|ally|join|integrate|work with|cooperate|support') THEN 'Partnership'
WHEN regexp_matches(lower({0}), 'acquire|buy|purchase|invest|fund|merge|raise|sell|divest|ipo') THEN 'Acquisition & Investment'
WHEN regexp_matches(lower({0}), 'compete|rival|challenge|outperform|surpass|overtake|beat|versus|alternative') THEN 'Competition'
WHEN regexp_matches(lower({0}), 'regulate|ban|approve|fine|sue|comply|enforce|legislat|sanction|antitrust|patent|licens|lawsuit') THEN 'Regulation & Legal'
WHEN regexp_matches(lower({0}), 'hack|breach|attack|vulnerab|exploit|malware|ransomware|phish|compromis|leak') THEN 'Security Incident'
WHEN regexp_matches(lower({0}), 'price|cost|fee|tariff|discount|revenue|profit|margin|valuation|billion|million|worth') THEN 'Pricing & Cost'
WHEN regexp_matches(lower({0}), 'benchmark|perform|test|evaluat|score|speed|latency|throughput|accuracy|efficien') THEN 'Performance & Benchmark'
WHEN regexp_matches(lower({0}), 'hire|recruit|layoff|lay off|laid off|fire|restructur|downsize|appoint|resign|ceo') THEN 'Hiring & Layoffs'
WHEN regexp_matches(lower({0}), 'launch|release|announc|unveil|introduce|debut|ship|deploy|roll out|open source') THEN 'Product Launch'
WHEN regexp_matches(lower({0}), 'use|run|has|is|include|contain|feature|offer|provide|consist') THEN 'Association' ELSE 'Other' END"""


def family_sql(verb: str) -> str:
    return FAMILY_SQL.format(verb)


@query(f"SELECT {family_sql('p_type')} AS family, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT {family_sql('event_type')} || ' event', count(*) FROM events GROUP BY 1")
def relation_family_counts(spark, sf_dir):
    parts = src.table(spark, sf_dir, "part").groupBy(tx.relation_family(F.col("p_type")).alias("family")).agg(F.count("*").alias("n"))
    events = src.table(spark, sf_dir, "events").groupBy(F.concat(tx.relation_family(F.col("event_type")), F.lit(" event")).alias("family")).agg(F.count("*").alias("n"))
    return parts.unionByName(events)


@query(r"""WITH v AS (SELECT page_id, CASE page_id % 7 WHEN 5 THEN regexp_replace(url, '^[^:]*://', '') || '/' WHEN 6 THEN replace(url, '://', '://User@') WHEN 0 THEN url || '/' WHEN 1 THEN url || '?next=/' WHEN 2 THEN regexp_extract(url, '^[^:]*://[^/]*') || '/' WHEN 3 THEN ' no address/ ' ELSE replace(upper(url), 'HTTPS://', 'HTTPS://') END AS u FROM pages),
p AS (SELECT page_id, u, regexp_extract(u, '^([A-Za-z]+)://', 1) AS scheme, regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1) AS host, regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '([?#].*)$', 1) AS tail FROM v)
SELECT page_id, CASE WHEN scheme = '' AND u LIKE '% %' THEN trim(u) WHEN scheme = '' THEN regexp_replace(regexp_extract(u, '^[^?#]*'), '/$', '') || tail ELSE lower(scheme) || '://' || CASE WHEN contains(host, '@') THEN split_part(host, '@', 1) || '@' ELSE '' END || CASE lower(scheme) WHEN 'http' THEN regexp_replace(lower(regexp_replace(host, '^.*@', '')), ':80$', '') WHEN 'https' THEN regexp_replace(lower(regexp_replace(host, '^.*@', '')), ':443$', '') ELSE lower(regexp_replace(host, '^.*@', '')) END || CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/$', '') END || tail END AS url FROM p""")
def url_normalize(spark, sf_dir):
    """Pages' addresses, with slashes put to the end of the path, into the query or after the host, and upper case."""
    url, root = F.col("url"), F.regexp_extract("url", "^[^:]*://[^/]*", 0)
    by = F.col("page_id") % 7
    odd = F.when(by == 5, F.concat(F.regexp_replace(url, "^[^:]*://", ""), F.lit("/"))).when(by == 6, F.replace(url, F.lit("://"), F.lit("://User@"))).when(by == 0, F.concat(url, F.lit("/"))).when(by == 1, F.concat(url, F.lit("?next=/"))).when(by == 2, F.concat(root, F.lit("/"))).when(by == 3, " no address/ ").otherwise(F.upper(url))
    return src.table(spark, sf_dir, "pages").select("page_id", tx.normalized_url(odd).alias("url"))


@query(r"""SELECT doc_id, coalesce(length(text) < 500 OR ends_with(text, '...') OR ends_with(text, '…') OR contains(lower(text), 'read more') OR contains(lower(text), 'continue reading'), true) AS needs_full,
coalesce(length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 100 AND NOT ends_with(regexp_replace(text, '^\s+|\s+$', '', 'g'), '...') AND NOT ends_with(regexp_replace(text, '^\s+|\s+$', '', 'g'), '…'), false) AS admitted FROM documents""")
def content_admission(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").select("doc_id", tx.needs_full_content(F.col("text")).alias("needs_full"), tx.admitted(F.col("text")).alias("admitted"))


@query("SELECT doc_id AS id FROM documents, (SELECT max(doc_id) AS last FROM documents) WHERE doc_id IS NULL OR doc_id >= last - 7 * 24")
def age_cutoff(spark, sf_dir):
    """Items of the last seven days, and those without a date; the newest item's date is today."""
    items = src.feed_items(spark, sf_dir)
    today = items.agg(F.max("pub_date").alias("today"))
    return items.crossJoin(F.broadcast(today)).where(F.col("pub_date").isNull() | (F.col("pub_date") >= F.col("today") - F.expr("INTERVAL 7 DAYS"))).select("id")  # one row


@query("SELECT doc_id AS id, source AS source_id FROM documents ORDER BY doc_id DESC NULLS LAST LIMIT 100")
def recent_items(spark, sf_dir):
    return src.feed_items(spark, sf_dir).orderBy(F.desc("pub_date"), F.desc("id")).limit(100).select("id", "source_id")


@query("SELECT source AS source_id, count(*) AS items, count(DISTINCT lang) AS languages, max(doc_id) AS newest FROM documents GROUP BY source")
def source_counts(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("items"), F.countDistinct("lang").alias("languages"), F.max("doc_id").alias("newest"))


@query("""WITH u AS (SELECT source, CAST(doc_id // 2 AS BIGINT) AS guid, doc_id AS v, text, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang FROM documents)
SELECT source, guid, arg_max(md5(text), v) AS content, arg_max(lang, v) FILTER (lang IS NOT NULL) AS lang, max(v) AS version FROM u GROUP BY source, guid""")
def feed_upsert(spark, sf_dir):
    """Latest version per (source, guid); lang keeps the old value when the new one is null."""
    docs = src.table(spark, sf_dir, "documents")
    rows = docs.select("source", F.floor(F.col("doc_id") / 2).alias("guid"), F.col("doc_id").alias("version"), F.md5("text").alias("content"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"))
    return graph.same_or_first(["content", "lang", "version"], ["source", "guid"], "version", rows, keep_if_null=["lang"])


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
c AS (SELECT doc_id, coalesce(len(w), 0) AS dl, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'worthless')) AS b FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT doc_id AS doc, round(-(greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / mean)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / mean))), 5) AS rank
FROM c, s WHERE a > 0 AND b > 0""")
def bm25_search(spark, sf_dir):
    return search.bm25(src.table(spark, sf_dir, "documents"), "doc_id", "text", ["the", "worthless"]).withColumn("rank", F.round("rank", 5))


@query("""WITH p AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label AS cluster, CAST(pos AS INTEGER) AS pos, round(avg(x), 5) AS mean FROM p GROUP BY label, pos""")
def cluster_centroids(spark, sf_dir):
    means = clusters.weighted_means(vectors(spark, sf_dir).withColumnRenamed("label", "cluster"), ["cluster"], "v")
    return means.select("cluster", F.posexplode("mean").alias("pos", "mean")).withColumn("mean", F.round("mean", 5))


@query("""WITH e AS (SELECT vec_id AS id, label AS cluster, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT cluster, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM e), m AS (SELECT cluster, pos, avg(x) AS x FROM p GROUP BY cluster, pos), c AS (SELECT cluster, list(x ORDER BY pos) AS c FROM m GROUP BY cluster),
s AS (SELECT cluster, id, list_inner_product(v, c) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(c, c))) AS similarity FROM e JOIN c USING (cluster)),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(similarity, 9) DESC, id) - 1 AS rank FROM s)
SELECT cluster, id, round(similarity, 5) AS similarity, rank FROM r WHERE rank < 10""")
def cluster_exemplars(spark, sf_dir):
    members = vectors(spark, sf_dir).withColumnRenamed("label", "cluster")
    found = clusters.exemplars(members, clusters.weighted_means(members, ["cluster"], "v"))
    return found.withColumn("similarity", F.round("similarity", 5))


@query(f"""WITH {INCIDENCES}, n AS (SELECT count(*) AS n FROM events), w AS (SELECT node, least(ln((n + 1) / (count(DISTINCT edge_id) + 1)) + 1, 6.0) AS idf FROM inc, n GROUP BY node, n),
t AS (SELECT event_type AS cluster, node, sum(idf) AS score FROM inc JOIN events ON edge_id = event_id JOIN w USING (node) GROUP BY event_type, node),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, node) AS rank FROM t)
SELECT cluster, node, round(score, 4) AS score, rank FROM r WHERE rank <= 20""")
def cluster_top_entities(spark, sf_dir):
    inc, edges = src.event_incidences(spark, sf_dir), src.event_edges(spark, sf_dir)
    rows = inc.join(edges.select("edge_id", F.col("label").alias("cluster")), "edge_id").join(graph.document_frequencies(inc, edges), "node")
    return clusters.top_by_sum(rows, "cluster", "node", "idf", 20).withColumn("score", F.round("score", 4))


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings), x AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS p FROM lineitem), w AS (SELECT p, count(*) AS df FROM x GROUP BY p),
k AS (SELECT count(DISTINCT e) AS k FROM x), i AS (SELECT p, least(ln((k + 1) / (df + 1)) + 1, 6.0) AS idf FROM w, k),
v AS (SELECT e, idf, embedding::DOUBLE[] AS v FROM x JOIN i USING (p), n JOIN embeddings ON vec_id = p % n),
q AS (SELECT e, idf, generate_subscripts(v, 1) AS pos, unnest(v) AS y FROM v)
SELECT e AS edge_id, CAST(pos - 1 AS INTEGER) AS pos, round(sum(idf * y) / sum(idf), 5) + 0.0 AS mean FROM q GROUP BY e, pos""")
def event_vector_pool(spark, sf_dir):
    return pooled_parts(spark, sf_dir, F.col("embedding"))


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings), x AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS p FROM lineitem), w AS (SELECT p, count(*) AS df FROM x GROUP BY p),
k AS (SELECT count(DISTINCT e) AS k FROM x), i AS (SELECT p, least(ln((k + 1) / (df + 1)) + 1, 6.0) AS idf FROM w, k),
v AS (SELECT e, idf, embedding::DOUBLE[] AS v FROM x JOIN i USING (p), n JOIN embeddings ON vec_id = p % n),
q AS (SELECT e, idf, generate_subscripts(v, 1) AS pos, unnest(v) AS y FROM v)
SELECT e AS edge_id, CAST(pos - 1 AS INTEGER) AS pos, round(sum(idf * y) / sum(idf), 5) + 0.0 AS mean FROM q GROUP BY e, pos""")
def event_vector_pool_whole(spark, sf_dir):
    return pooled_parts(spark, sf_dir, F.col("embedding"))


def pooled_parts(spark: SparkSession, sf_dir: str, vector: Column) -> DataFrame:
    """IDF-weighted mean of the target parts' vectors per order."""
    checkpointed(spark)
    x = src.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge_id"), F.col("l_partkey").alias("part")).repartition("edge_id").distinct()
    k = x.groupBy("edge_id").agg(F.lit(1)).where("edge_id is not null").agg(F.count("*").alias("k"))
    idf = x.groupBy("part").agg(F.count("*").alias("df")).crossJoin(F.broadcast(k)).select("part", F.least(F.log((F.col("k") + 1) / (F.col("df") + 1)) + 1, F.lit(6.0)).alias("idf"))  # one row
    e = src.table(spark, sf_dir, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    weighted = idf.crossJoin(F.broadcast(n)).select("part", (F.col("part") % F.col("n")).alias("id"), F.col("idf").alias("w"))
    means = clusters.pooled(x.join(weighted, "part").select("edge_id", "id", "w"), e.select(F.col("vec_id").alias("id"), vector.alias("v")), ["edge_id"])
    return means.select("edge_id", F.posexplode("m0").alias("pos", "mean")).withColumn("mean", F.round("mean", 5) + 0.0)


@query("""SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id""")
def conversation_history(spark, sf_dir):
    line = F.concat("role", F.lit(": "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    rows = src.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return rows.select("conv_id", "turns", F.array_join(F.transform("lines", lambda s: s["line"]), "\n").alias("history"))


@query("""SELECT conv_id, count(*) AS turns, string_agg(coalesce(role, '') || ': ' || regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id""")
def conversation_history_whole(spark, sf_dir):
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    rows = src.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return rows.select("conv_id", "turns", F.array_join(F.transform("lines", lambda s: s["line"]), "\n").alias("history"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_events(spark, sf_dir):
    return src.table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest parts by embedding with the degrees of both in the order graph."""
    n = vectors(spark, sf_dir).agg(F.count("*").alias("n"))
    degree = graph.degrees(src.order_incidences(spark, sf_dir)).where(F.startswith("node", F.lit("p:")))
    per = degree.crossJoin(F.broadcast(n)).groupBy((F.substring("node", 3, 20).cast("long") % F.col("n")).alias("id")).agg(F.sum("degree").alias("degree"))  # one row
    return knn_cosine(spark, sf_dir).join(per, "id", "left").select("query", "id", "distance", "rank", F.coalesce("degree", F.lit(0)).alias("degree"))
