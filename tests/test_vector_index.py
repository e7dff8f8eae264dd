"""The vector index and the join by cells against scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import similarity, vector_index
from loomgraph.plans.index import own_path

SCHEMA = "id long, v array<double>, kind int"


def clustered(spark, n=3000, groups=60, dims=24, seed=1, spread=0.02):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dims))
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    which = rng.integers(groups, size=n)
    v = middle[which] + rng.normal(size=(n, dims)) * spread
    return spark.createDataFrame([(i, x.tolist(), int(w) % 3) for i, (x, w) in enumerate(zip(v, which))], SCHEMA).repartition(4).cache()


def rows(df):
    return sorted((r["query"], r["rank"], r["id"], round(r["distance"], 7)) for r in df.collect())


@pytest.mark.parametrize("metric,by", [("l2", "l2"), ("cosine", "cosine"), ("l1", "l2")])
def test_search_is_exact(spark, metric, by):
    base = clustered(spark)
    index, queries = vector_index.build(base, own_path(spark, "v"), by), base.where("id % 50 = 0").select("id", "v")
    assert rows(vector_index.search(index, queries, 5, metric=metric, probes=1)) == rows(similarity.nearest(queries, base, 5, metric))
    odd = F.col("kind") == 1
    assert rows(vector_index.search(index, queries, 40, metric=metric, where=odd)) == rows(similarity.nearest(queries, base, 40, metric, where=odd))
    near = 0.05 if metric == "cosine" else 0.12
    assert rows(vector_index.search(index, queries, 5, metric=metric, within=near)) == rows(similarity.nearest(queries, base, 5, metric, within=near))
    assert rows(vector_index.search(index, queries, 3, metric=metric, itself=True)) == rows(similarity.nearest(queries, base, 3, metric, itself=True))


def test_recall_and_rows_read(spark):
    base = clustered(spark)
    index, queries = vector_index.build(base, own_path(spark, "v"), "l2", recall=0.95), base.where("id % 20 = 0").select("id", "v")
    whole = {(r["query"], r["id"]) for r in similarity.nearest(queries, base, 5, "l2").collect()}
    found = {(r["query"], r["id"]) for r in vector_index.search(index, queries, 5, exact=False).collect()}
    assert len(found & whole) >= 0.9 * len(whole)
    read = vector_index.rows_compared(index, queries).agg(F.sum("rows")).first()[0]
    assert read < 0.2 * queries.count() * base.count()
    assert index.rows().count() == base.count() and index.sizes.sum() == base.count()


def test_odd_tables(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, None, 0), (3, [], 0), (4, [0.0, 0.0], 1)], SCHEMA)
    for by in ("l2", "cosine"):
        index = vector_index.build(one, own_path(spark, "v"), by)
        assert index.rows().count() == 2
        assert rows(vector_index.search(index, one, 5)) == rows(similarity.nearest(one, one, 5, by))
        none = vector_index.build(one.limit(0), own_path(spark, "v"), by)
        assert vector_index.search(none, one, 5).count() == 0 and vector_index.similar_pairs(none, 0.5).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0], 0) for i in range(2500)], SCHEMA)  # one cell holds all
    index = vector_index.build(same, own_path(spark, "v"), "cosine")
    assert vector_index.similar_pairs(index, 0.9).count() == 2500 * 2499 // 2
    with pytest.raises(ValueError):
        vector_index.search(index, one, 5, metric="l2")


@pytest.mark.parametrize("above", [0.9, 0.3])
def test_join_by_cells(spark, above):
    base = clustered(spark, n=1500, groups=40).select("id", "v")
    index = vector_index.build(base, own_path(spark, "v"), "cosine")
    pairs = lambda df: {(r["a"], r["b"]): round(r["similarity"], 7) for r in df.collect()}
    got = vector_index.similar_pairs(index, above)
    assert pairs(got) == pairs(similarity.similar_pairs(base, above)) and got.count() == got.select("a", "b").distinct().count()


def test_join_by_cells_compares_little(spark):
    """On clustered data less than a tenth of the pairs of rows that the join by blocks compares; the nearest pairs are the same."""
    base = clustered(spark).select("id", "v")
    index = vector_index.build(base, own_path(spark, "v"), "l2")
    compared = vector_index.block_pairs_of(index, 0.3).select(F.sum(F.size("ids").cast("long") * F.size("ids2"))).first()[0]
    assert compared < 0.1 * base.count() ** 2 / 2
    pairs = lambda df: [(r["a"], r["b"], round(r["distance"], 7)) for r in df.collect()]
    assert pairs(vector_index.near_pairs(index, 0.955, 50)) == pairs(similarity.near_pairs(base, 0.955, 50))


@pytest.mark.parametrize("k", [1, 3, 40, 60])
def test_least_of_rows(k):
    rng = np.random.default_rng(k)
    d = rng.integers(0, 5, size=(30, 40)).astype(float)
    d[rng.random(d.shape) < 0.2] = np.inf
    ids = rng.permutation(40)
    want = [(i, j) for i in range(30) for j in sorted(range(40), key=lambda j: (d[i, j], ids[j]))[:k] if np.isfinite(d[i, j])]
    assert list(zip(*similarity.least_of_rows(d, ids, k))) == want


def test_nearest_levels(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 3, size=(200, 3)).astype(float)  # many at one distance
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    got = {(r["query"], r["id"], r["distance"]) for r in similarity.nearest_levels(df.where("id < 5"), df, 2, 1).collect()}
    want = set()
    for q in range(5):
        d = np.round(np.linalg.norm(v - v[q], axis=1), 1)
        levels = sorted({d[i] for i in range(200) if i != q})[:2]
        want |= {(q, i, d[i]) for i in range(200) if i != q and d[i] in levels}
    assert got == want
    assert similarity.nearest_levels(df.where("id < 5"), df.limit(0), 2, 1).count() == 0


def test_join_by_cells_copies_no_vectors(spark):
    """In random directions nearly every vector visits nearly every cell; yet each is in one bin, and a bin is bounded."""
    rng = np.random.default_rng(3)
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(3000, 32)))], "id long, v array<double>").repartition(4)
    index = vector_index.build(base, own_path(spark, "v"), "cosine", cells=100)
    bins = vector_index.binned(index, 1.3).select(F.size("ids").alias("n")).toPandas().n
    assert bins.sum() == 3000 and bins.max() <= vector_index.BLOCK
    pairs = lambda df: {(r["a"], r["b"]): round(r["similarity"], 7) for r in df.collect()}
    assert pairs(vector_index.similar_pairs(index, 0.3)) == pairs(similarity.similar_pairs(base, 0.3))


@pytest.mark.parametrize("slab", [40, 1 << 20])
def test_slabs(monkeypatch, slab):
    """Pairs of a block with itself and with another, once each, however few distances are held; the nearest with those like the last."""
    monkeypatch.setattr(similarity, "SLAB", slab)
    rng = np.random.default_rng(2)
    v, ids = rng.integers(0, 3, size=(30, 3)).astype(float), rng.permutation(30)
    every = sorted((round(float(np.linalg.norm(v[i] - v[j])), 7), min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(30) for j in range(i))
    got = lambda a, b, most=None: sorted((round(float(d), 7), x, y) for part in similarity.slabs(ids[a], v[a], ids[b], v[b], "l2", lambda d: d < 2.5, most) for x, y, d in zip(*part))
    all_, left, right = slice(None), slice(0, 11), slice(11, 30)
    wanted = [p for p in every if p[0] < 2.5]
    assert got(all_, all_) == wanted
    assert sorted(got(left, left) + got(left, right) + got(right, right)) == wanted
    assert got(all_, all_, 5)[:5] == wanted[:5] and (slab == 40 or len(got(all_, all_, 5)) < len(wanted))
