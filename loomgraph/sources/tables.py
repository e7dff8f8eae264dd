"""The hypergraph's tables, derived from the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition where rows are dealt for grouping.
DEALT = 200_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` by ``key`` in partitions of about ``DEALT`` rows, more of them the longer the table, so that what a task groups doesn't grow with it."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / DEALT)), key)


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("edge_id"), F.col("event_type").alias("label"), F.col("ts").alias("created_at"))


def event_incidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary hyperedges: a user as source, a property key as target."""
    events = table(spark, sf_dir, "events")
    ends = F.array(
        F.struct(F.concat(F.lit("u:"), F.col("user_id")).alias("node"), F.lit("source").alias("role"), F.lit(0).alias("position")),
        F.struct(F.concat(F.lit("k:"), F.get_json_object("props", "$.k")).alias("node"), F.lit("target").alias("role"), F.lit(0).alias("position")),
    )
    return events.select(F.col("event_id").alias("edge_id"), F.explode(ends).alias("e")).select("edge_id", "e.*").where(F.col("node").isNotNull())


def order_incidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperedges of orders: the customer as source, parts as targets, suppliers as members."""
    orders, lines = table(spark, sf_dir, "orders"), dealt(table(spark, sf_dir, "lineitem"), "l_orderkey")

    def nodes(prefix: str, key: str, role: str) -> DataFrame:
        each = lines.groupBy("l_orderkey", key).agg(F.min("l_linenumber").alias("position"))  # grouped where an order's lines lie
        return each.select(F.col("l_orderkey").alias("edge_id"), F.concat(F.lit(prefix), F.col(key)).alias("node"), F.lit(role).alias("role"), "position")

    with_lines = orders.join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    customers = with_lines.select(F.col("o_orderkey").alias("edge_id"), F.concat(F.lit("c:"), F.col("o_custkey")).alias("node"), F.lit("source").alias("role"), F.lit(0).alias("position"))
    return customers.unionByName(nodes("p:", "l_partkey", "target")).unionByName(nodes("s:", "l_suppkey", "member"))


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    published = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 3600)
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("guid"), F.col("text").alias("full_content"), published.alias("pub_date"), F.concat(F.lit("Article "), F.col("doc_id")).alias("title"), F.concat(F.lit("https://example.org/a/"), F.col("doc_id")).alias("link"))


def article_chunks(spark: SparkSession, sf_dir: str, size: int = 800) -> DataFrame:
    """id, feed_item_id, chunk_index, content: each document's text in pieces of ``size`` code points."""
    docs = table(spark, sf_dir, "documents").where(F.char_length("text") > 0)
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.char_length("text") / size).cast("int") - 1), lambda i: F.substr("text", i * size + 1, F.lit(size)))
    rows = docs.select(F.col("doc_id").alias("feed_item_id"), F.posexplode(pieces).alias("chunk_index", "content"))
    return rows.select((F.col("feed_item_id") * 100_000 + F.col("chunk_index")).alias("id"), "feed_item_id", "chunk_index", "content")


def linked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event edges with an id that names relation and chunk; every fifth is linked to its document's first chunk."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    events = table(spark, sf_dir, "events").crossJoin(F.broadcast(n))  # one row
    key = F.concat(F.col("event_type"), F.lit("_of_chunk0_"), F.col("event_id"))
    return events.select(F.col("event_id").alias("edge_id"), key.alias("edge_key"), F.col("event_type").alias("label"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") % F.col("n") * 100_000).alias("source_chunk_id"))


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, label, node_type of customers, parts and suppliers, those without orders included."""
    kinds = (("customer", "c", "c_custkey", "c_name"), ("part", "p", "p_partkey", "p_name"), ("supplier", "s", "s_suppkey", "s_name"))
    rows = [table(spark, sf_dir, t).select(F.concat(F.lit(f"{p}:"), F.col(k)).alias("node"), F.col(n).alias("label"), F.lit(t).alias("node_type")) for t, p, k, n in kinds]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's document; every seventh without chunk text."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    events = table(spark, sf_dir, "events").crossJoin(F.broadcast(n))  # one row
    text = F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("chunk of "), F.col("event_id")))
    return events.select(F.col("event_id").alias("edge_id"), (F.col("event_id") % F.col("n")).alias("feed_item_id"), F.lit(0).alias("chunk_index"), text.alias("chunk_text"))
