"""Queries on the stored vector index and the similarity join by cells."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import similarity, vector_index
from loomgraph.plans.queries import KNN_SQL, SQL, checkpointed, query, vectors


def own_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder."""
    checkpointed(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def indexed(spark: SparkSession, sf_dir: str, metric: str) -> tuple[vector_index.VectorIndex, DataFrame]:
    base = vectors(spark, sf_dir)
    return vector_index.build(base, own_path(spark, "vectors"), metric), base.where(F.col("id") % 100 == 0).select("id", "v")


def ranked(found: DataFrame) -> DataFrame:
    return found.select("query", "id", F.round("distance", 5).alias("distance"), "rank")


@query(KNN_SQL.format(distance="list_distance(q.v, e.v)", where=""))
def indexed_knn_l2(spark, sf_dir):
    """Every hundredth vector against the index of all; the further cells that may hold something nearer are read, too."""
    index, queries = indexed(spark, sf_dir, "l2")
    return ranked(vector_index.search(index, queries, 5))


@query(KNN_SQL.format(distance="list_sum(list_transform(list_zip(q.v, e.v), lambda p: abs(p[1] - p[2])))", where=""))
def indexed_knn_l1(spark, sf_dir):
    index, queries = indexed(spark, sf_dir, "l2")
    return ranked(vector_index.search(index, queries, 5, metric="l1"))


@query(KNN_SQL.format(distance="1 - list_inner_product(q.v, e.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.v, e.v)))", where="WHERE distance < 0.8").replace("embedding::DOUBLE[] AS v FROM", "embedding::DOUBLE[] AS v, label FROM").replace("q.id <> e.id", "q.id <> e.id AND e.label IN (1, 2, 3)"))
def indexed_knn_filtered(spark, sf_dir):
    """Under a distance, among the vectors of some labels: the filter comes before the search."""
    index, queries = indexed(spark, sf_dir, "cosine")
    return ranked(vector_index.search(index, queries, 5, within=0.8, where=F.col("label").isin(1, 2, 3)))


@query("SELECT count(*) FILTER (vec_id % 100 = 0) AS queries, 5 * count(*) FILTER (vec_id % 100 = 0) AS wanted, true AS recalled, true AS fewer_rows FROM embeddings")
def index_recall(spark, sf_dir):
    """The probed cells alone: whether 0.9 of the five nearest are found, and fewer rows are read than a scan reads."""
    index, queries = indexed(spark, sf_dir, "l2")
    base = vectors(spark, sf_dir).select("id", "v")
    whole = similarity.nearest(queries, base, 5, "l2").select("query", "id")
    found = vector_index.search(index, queries, 5, exact=False).select("query", "id", F.lit(1).alias("hit"))
    hits = whole.join(found, ["query", "id"], "left").agg(F.count("*").alias("wanted"), F.countDistinct("query").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
    rows = vector_index.rows_compared(index, queries).agg(F.sum("rows").alias("read"))
    n = base.agg(F.count("*").alias("n"))
    return hits.crossJoin(rows).crossJoin(n).select("queries", "wanted", (F.col("recall") >= 0.9).alias("recalled"), (F.col("read") < F.col("queries") * F.col("n")).alias("fewer_rows"))  # single rows


@query(SQL["similar_pairs"])
def similar_pairs_by_cells(spark, sf_dir):
    index, _ = indexed(spark, sf_dir, "cosine")
    return vector_index.similar_pairs(index, 0.3).select("a", "b", F.round("similarity", 5).alias("similarity"))
