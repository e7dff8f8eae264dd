"""Queries on SQL names, phrases and index upkeep, written files, page articles and refreshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import article, sql_names
from loomgraph.operators import graph, history, search
from loomgraph.plans.context import VISIBLE, seen
from loomgraph.plans.index import own_path
from loomgraph.plans import texts  # noqa: F401 - its SQL is read below
from loomgraph.plans.queries import SQL, query
from loomgraph.sources import snapshots
from loomgraph.sources import tables as src


def view(spark, sf_dir: str, name: str) -> str:
    found = f"loomgraph_{name}"
    src.table(spark, sf_dir, name).createOrReplaceTempView(found)
    sql_names.register(spark)
    return found


@query("""SELECT a.vec_id, len(a.embedding) AS dims, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS l2, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: abs(p[1] - p[2]))), 5) AS l1,
round(1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 5) AS cosine,
len(list_filter(list_zip(a.embedding, b.embedding), lambda p: (p[1] > 0) <> (p[2] > 0))) AS hamming, list_sum(list_transform(a.embedding::DOUBLE[], lambda x: CAST(trunc((x + 1) / (2.0::DOUBLE / 255) - 128) AS INTEGER))) AS int8_sum,
round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: (p[1] + p[2]) * p[1] - (p[1] - p[2]) * p[2])), 5) AS mixed
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def sql_vectors(spark, sf_dir):
    """Each vector and the next, by functions of SQL text."""
    e = view(spark, sf_dir, "embeddings")
    return spark.sql(f"""SELECT a.vec_id, CAST(vec_length(a.v) AS BIGINT) AS dims, round(vec_distance_l2(a.v, b.v), 5) AS l2, round(vec_distance_l1(a.v, b.v), 5) AS l1, round(vec_distance_cosine(a.v, b.v), 5) AS cosine,
        CAST(vec_distance_hamming(vec_quantize_binary(a.v), vec_quantize_binary(b.v)) AS BIGINT) AS hamming, CAST(aggregate(vec_quantize_int8(a.v), 0, (s, x) -> s + x) AS BIGINT) AS int8_sum,
        round(aggregate(zip_with(vec_add(a.v, b.v), a.v, (x, y) -> x * y), 0D, (s, x) -> s + x) - aggregate(zip_with(vec_sub(a.v, b.v), b.v, (x, y) -> x * y), 0D, (s, x) -> s + x), 5) AS mixed
        FROM (SELECT vec_id, CAST(embedding AS ARRAY<DOUBLE>) AS v FROM {e}) a JOIN (SELECT vec_id - 1 AS vec_id, CAST(embedding AS ARRAY<DOUBLE>) AS v FROM {e}) b ON a.vec_id = b.vec_id""")


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS rowid, round(x::DOUBLE, 6) AS value FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def sql_elements(spark, sf_dir):
    """A row per element, by a table function."""
    e = view(spark, sf_dir, "embeddings")
    return spark.sql(f"SELECT vec_id, rowid, round(value, 6) AS value FROM {e}, LATERAL vec_each(CAST(embedding AS ARRAY<DOUBLE>))")


#: "of" and "the" with all their forms that have the same stem.
PHRASE = r"""t AS (SELECT doc_id, list_transform(regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\p{{L}}\p{{N}}]+'), lambda x: CASE WHEN regexp_full_match(x, 'of(e|ed|ing)?s?') THEN 'of' WHEN regexp_full_match(x, 'the(ing)?s?') THEN 'the' ELSE x END) AS w FROM {0}),
c AS (SELECT doc_id, len(w) AS dl, len(list_filter(list_zip(w, w[2:]), lambda p: p[1] = 'of' AND p[2] = 'the')) AS a FROM t), s AS (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (a > 0) AS da FROM c)
SELECT doc_id AS doc, round(-greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / mean)), 5) AS rank FROM c, s WHERE a > 0"""


@query("WITH " + PHRASE.format("documents"))
def phrase_search(spark, sf_dir):
    """Documents with "of" right before "the", which one quoted word that falls into two terms asks for."""
    docs = src.table(spark, sf_dir, "documents")
    index = search.build(docs, "doc_id", "text", own_path(spark, "phrases"))
    return search.search(spark, index, "of-the").withColumn("rank", F.round("rank", 5))


@query("WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 2 THEN reverse(text) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3), " + PHRASE.format("d"))
def search_after_changes(spark, sf_dir):
    """The same after changes: part inserted later, part replaced by reversed texts, part deleted, segments merged."""
    docs = src.table(spark, sf_dir, "documents").select("doc_id", "text")
    by = F.col("doc_id") % 7
    index = search.build(docs.where(by != 1), "doc_id", "text", own_path(spark, "changes"))
    search.upsert(index, docs.where(by == 1), "doc_id", "text")
    search.upsert(index, docs.where(by == 2).withColumn("text", F.reverse("text")), "doc_id", "text")
    search.delete(index, docs.where(by == 3).select("doc_id"), "doc_id")
    search.merge(spark, index, 2)
    return search.search(spark, index, "of-the").withColumn("rank", F.round("rank", 5))


@query(f"SELECT markdown FROM ({SQL['markdown_export']})")
def article_files(spark, sf_dir):
    """Items written to one file each, by day and source, and read back from the files."""
    path = own_path(spark, "articles")
    docs = src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    items = src.feed_items(spark, sf_dir).join(docs, "id")
    items = items.withColumns({"author": F.when(F.col("lang") != "en", F.col("lang")), "source": F.col("source_id"), "description": F.lit(None).cast("string")}).where("source is not null")
    snapshots.write_articles(items, path)
    return spark.read.format("article_files").load(path).select(F.md5("markdown").alias("markdown"))


@query(r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS a FROM pages),
t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(a, '(?s)<script.*?</script>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&[a-z]+;', ' ', 'g') AS t FROM a)
SELECT page_id, trim(regexp_replace(t, '[^\p{L}\p{N}]+', ' ', 'g')) AS words FROM t""")
def page_articles(spark, sf_dir):
    """The words of each page's article, found by the worth of its blocks, without its navigation, advertisements and foot."""
    text = article.article(F.col("html"), F.col("url"))
    return src.table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")).alias("words"))


@query("SELECT source AS source_id, count(*) - count(*) FILTER (doc_id % 10 < 7) AS new_items FROM documents GROUP BY source")
def new_items(spark, sf_dir):
    """Items that a refresh has brought, by source; before it, three in ten were missing."""
    after = src.feed_items(spark, sf_dir)
    return history.new_items(after.where("id % 10 < 7"), after, "source_id")


@query("WITH " + VISIBLE.replace("500", "2800") + " SELECT DISTINCT edge_id FROM inc WHERE edge_id NOT IN (SELECT edge_id FROM inc WHERE role <> 'member' AND node NOT IN (SELECT node FROM vis))")
def visible_edges_of_many(spark, sf_dir):
    """As ``visible_edges``, with a limit of nodes that leaves edges."""
    nodes, inc = seen(spark, sf_dir, 2800)
    return graph.visible_edges(inc, nodes)
