"""Steps put together: answering a question, deep analysis, rebuilding themes, ingesting articles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import models
from loomgraph.functions import text as tx
from loomgraph.operators import context, graph, paths, similarity, themes, upserts


@dataclass(frozen=True)
class Graph:
    """The tables that a question reads: nodes (node, label, node_type), edges (edge_id, label), incidences, provenance,
    chunks (id, feed_item_id, chunk_index, content), items (id, title, link, pub_date), vectors (id, node, v)."""

    nodes: DataFrame
    edges: DataFrame
    incidences: DataFrame
    provenance: DataFrame
    chunks: DataFrame
    items: DataFrame
    vectors: DataFrame


@dataclass(frozen=True)
class Limits:
    """Effective settings of a question: nodes per keyword, chunks, distance bound, edges and paths of a way."""

    nodes: int = 5
    chunks: int = 5
    within: float = 0.5
    path_edges: int = 5
    pair_paths: int = 3


def question(spark: SparkSession, tables: Graph, text: str, embed: models.Embedder = models.hashed_vectors, generate: models.Generator = models.first_lines, limits: Limits = Limits(), tag: str = "question") -> Iterator[tuple[str, object]]:
    """Phases of an answer, one after the other, each with its table, at last the pieces of the answer.

    Jobs carry ``tag``, so that :func:`cancel` ends a question at any phase; between phases the caller
    may simply stop reading.
    """
    spark.addTag(tag)
    try:
        row = spark.createDataFrame([(text,)], "q string")
        words = [r["w"] for r in row.select(F.explode(tx.keywords(F.col("q"))).alias("w")).collect()]  # five at most
        yield "keywords", words
        asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(embed(words))], "id long, v array<double>") if words else spark.createDataFrame([], "id long, v array<double>")
        hits = similarity.nearest(asked, tables.vectors.select("id", "v"), limits.nodes, "cosine", limits.within, itself=True)
        named = context.first_seen(hits.select(F.col("query").alias("keyword_at"), "id", "distance")).join(tables.vectors.select("id", "node"), "id").join(tables.nodes, "node").checkpoint()
        yield "nodes", named
        ways = paths.shortest_paths(tables.incidences, named, named, limits.path_edges, limits.pair_paths)
        reasons = paths.first_per_pair(paths.reasoning(ways, paths.hops(ways, tables.incidences), tables.edges)).checkpoint()
        yield "paths", reasons
        wanted = context.merged_edges(ways.select(F.explode("path").alias("edge_id")).distinct(), context.edges_of_nodes(tables.incidences, named))
        edges = context.labelled_edges(tables.incidences, tables.nodes, tables.edges, tables.provenance, wanted).join(wanted, "edge_id")
        chunks = context.chunks_of_nodes(tables.incidences, named, tables.provenance, tables.chunks, tables.items, limits.chunks)
        gathered = context.context_text(named, reasons, edges, chunks).first()["context"]  # one row of bounded text
        yield "context", gathered
        yield "sources", context.source_articles(chunks)
        for piece in generate(f"{gathered}\n\nQuestion: {text}"):
            yield "answer", piece
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str = "question") -> None:
    spark.interruptTag(tag)


def deep_analysis(gathered: str, generate: models.Generator) -> dict[str, str]:
    """Two agents one after the other: a synthesis of the context, and hypotheses from both."""
    synthesis = "".join(generate(f"Synthesis of:\n{gathered}"))
    return {"synthesis": synthesis, "hypotheses": "".join(generate(f"Hypotheses from:\n{synthesis}\n\n{gathered}"))}


def rebuilt_themes(incidences: DataFrame, embeddings: DataFrame, edges: DataFrame, names: DataFrame, build: Column, generate: models.Generator | None = None, least_size: int = 20, samples: int = 10) -> tuple[DataFrame, DataFrame]:
    """Membership (id, cluster, membership, build_id) and artifacts of a new build: weights, event vectors, clusters, descriptions, labels."""
    idf = graph.document_frequencies(incidences, edges)
    found = themes.event_vectors(incidences, embeddings, idf, edges).select(F.col("edge_id").alias("id"), "v").checkpoint()
    members = themes.hdbscan(found, least_size, samples).checkpoint()
    art = themes.artifacts(members.join(found, "id"), incidences, idf, edges, names, build)
    if generate is not None:
        prompts = art.select("cluster", models.answered(F.concat_ws(", ", "entities"), generate).alias("answer"))
        art = themes.named_clusters(art, prompts)
    return members.withColumn("build_id", build), art


#: What an article's content gives: rows of edge_id, relation, chunk_id, feed_item_id, nodes, sources, targets; it may raise.
Extractor = Callable[[DataFrame], DataFrame]


def unprocessed(items: DataFrame, status: DataFrame) -> DataFrame:
    """Items with content and without a status row, or with a failed one, newest first."""
    rows = items.where(F.coalesce("full_content", F.lit("")) != "").join(status.select("id", "status"), "id", "left")
    return rows.where(F.col("status").isNull() | (F.col("status") == "failed")).drop("status").orderBy(F.desc_nulls_last("pub_date"), F.desc("id"))


def processed(items: DataFrame, status: DataFrame, extract: Extractor, size: int = 800) -> tuple[dict[str, DataFrame], DataFrame]:
    """New rows of the hypergraph's tables from a batch of items, and the status table after it.

    Items go from processing to completed; if the extraction fails, all of the batch to failed, with the error.
    """
    from loomgraph.functions import chunks as ck

    texts = items.select(F.col("id").alias("feed_item_id"), F.posexplode(ck.text_chunks(F.col("full_content"), size)).alias("chunk_index", "content"))
    none = F.lit(None).cast("string")
    begun = upserts.upserted(status, items.select("id", F.lit("processing").alias("status"), none.alias("error")), ["id"])
    try:
        rows = upserts.persisted(extract(items), texts) | {"chunks": texts}
        ended = items.select("id", F.lit("completed").alias("status"), none.alias("error"))
    except Exception as e:  # noqa: BLE001 - the extractor is the caller's
        rows, ended = {}, items.select("id", F.lit("failed").alias("status"), F.lit(f"{type(e).__name__}: {e}").alias("error"))
    return rows, upserts.upserted(begun, ended, ["id"])
