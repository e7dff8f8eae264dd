"""Upkeep of the full-text index and phrases, against rebuilds and brute force."""

import math
import random
import uuid

import pytest

from loomgraph.functions.search import terms_of
from loomgraph.operators import search

SCHEMA = "id long, body string"


def ranks(df):
    return {r["doc"]: round(r["rank"], 9) for r in df.collect()}


def by_hand(docs, query):
    units = list(dict.fromkeys(tuple(terms_of(w)) for w in query.split() if terms_of(w)))
    cut = {d: terms_of(t) for d, t in docs.items()}
    mean = sum(map(len, cut.values())) / len(cut)
    tf = {u: {d: n for d, w in cut.items() if (n := sum(tuple(w[i:i + len(u)]) == u for i in range(len(w))))} for u in units}
    out = {}
    for d, w in cut.items():
        if units and all(d in tf[u] for u in units):
            score = sum(max(1e-6, math.log((len(cut) - len(tf[u]) + 0.5) / (len(tf[u]) + 0.5))) * tf[u][d] * 2.2 / (tf[u][d] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for u in units)
            out[d] = round(-score, 9)
    return out


@pytest.fixture()
def path(spark):
    from loomgraph.plans.index import own_path

    return own_path(spark, f"fts-{uuid.uuid4().hex}")


def texts(seed, ids):
    rng = random.Random(seed)
    say = ["running", "e-mail", "email", "mail", "e", "house", "Houses", "3.5", "the", "5", "3"]
    return {i: " ".join(rng.choice(say) for _ in range(rng.randint(0, 25))) for i in ids}


QUERIES = ["e-mail", "e-mail house", "3.5 the", "mail-e", "running", "nothing here", "", "e mail", "the-e-mail"]


def test_phrases(spark, path):
    docs = texts(1, range(60)) | {60: None, 61: "", 62: "e-mail e-mail e"}
    df = spark.createDataFrame(list(docs.items()), SCHEMA)
    index = search.build(df, "id", "body", path, buckets=8)
    for q in QUERIES:
        assert ranks(search.search(spark, index, q)) == by_hand(docs, q), q
    assert [r["doc"] for r in search.search(spark, index, "e-mail", 3).collect()] == [d for d, _ in sorted(by_hand(docs, "e-mail").items(), key=lambda x: (x[1], x[0]))[:3]]


def test_upkeep(spark, path):
    """Inserts, updates, deletes, updates of updates, unknown ids; merges on the way; always the ranks of a rebuild."""
    docs = texts(2, range(40))
    table = lambda d: spark.createDataFrame(list(d.items()), SCHEMA)
    index = search.build(table(docs), "id", "body", path, buckets=4)
    steps = [("put", texts(3, range(30, 55))), ("drop", [3, 33, 54, 999]), ("put", texts(4, [3, 4, 33])), ("merge", 2), ("put", texts(5, [3, 60])), ("drop", [4]), ("merge", 1), ("put", texts(6, [4, 5]))]
    for what, given in steps:
        if what == "put":
            docs |= given
            search.upsert(index, table(given), "id", "body")
        elif what == "drop":
            docs = {d: t for d, t in docs.items() if d not in given}
            search.delete(index, spark.createDataFrame([(i,) for i in given], "id long"), "id")
        else:
            search.merge(spark, index, given)
            assert sum(e.kind == "segment" for e in index.manifest(spark)[1]) <= given
        total = index.totals(spark).first()
        assert total["n"] == len(docs) and total["mean"] == pytest.approx(sum(len(terms_of(t)) for t in docs.values()) / len(docs))
        for q in ("e-mail house", "the"):
            assert ranks(search.search(spark, index, q)) == by_hand(docs, q), (what, q)
    assert not [e for e in index.manifest(spark)[1] if e.kind == "marks"][1:]


def test_words_are_gathered_where_texts_lie(spark, path, monkeypatch):
    """A segment is one table with a row per term and document, and one per document; also from texts in several steps."""
    docs = texts(4, range(50)) | {50: None, 51: ""}
    df = spark.createDataFrame(list(docs.items()), SCHEMA).repartition(2)
    index = search.build(df, "id", "body", path, buckets=8)
    name = index.manifest(spark)[1][0].name
    stored = spark.read.parquet(f"{path}/{name}")
    assert stored.where("term is null").count() == 52 and stored.where("term is not null").count() == sum(len(set(terms_of(t))) for t in docs.values())
    got = {(r["doc"], r["term"]): sorted(r["positions"]) for r in stored.where("term is not null").collect()}
    assert all([i for i, w in enumerate(terms_of(docs[d])) if w == t] == at for (d, t), at in got.items())
    import pyarrow as pa

    monkeypatch.setattr(search, "HELD", 7)
    batch = pa.RecordBatch.from_pydict({"doc": list(docs), "text": list(docs.values())})
    assert {(x["doc"], x["term"]): x["positions"] for b in search.placed([batch]) for x in b.to_pylist() if x["term"]} == got
