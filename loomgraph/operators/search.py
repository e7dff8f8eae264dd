"""Full-text search: stored postings with upkeep, phrases, and BM25 (k1 = 1.2, b = 0.75; lower is better)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.search import snippet, terms_of

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Index:
    """Segments of postings at ``path``, with marks of documents that were deleted or replaced.

    A segment has postings (bucket, term, doc, tf, dl, positions) by bucket of terms, and in the bucket
    ``LENGTHS`` a row without a term for every document; it is never changed. Marks (doc, at) say that a document's rows in segments numbered below ``at`` are dead.
    Each change writes a new version of the manifest, a row per segment, table of marks, and totals; readers
    see a version or the next, never part of one. One writer at a time.
    """

    path: str
    buckets: int

    def manifest(self, spark: SparkSession) -> tuple[int, list[Row]]:
        rows = spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        last = rows.agg(F.max("version")).first()[0]
        return last, rows.where(F.col("version") == last).collect()  # a row per segment and table of marks

    def tables(self, spark: SparkSession, part: str, entries: list[Row] | None = None) -> DataFrame:
        """The live rows of all segments' (or these) ``part`` ("postings", "docs" or "all"), with the segment's number."""
        every = self.manifest(spark)[1]
        entries = [e for e in every if e.kind == "segment"] if entries is None else entries
        found = None
        for e in entries:
            rows = spark.read.parquet(f"{self.path}/{e.name}").withColumn("number", F.lit(e.number))
            if part == "postings":
                rows = rows.where(F.col("bucket") != LENGTHS)
            elif part == "docs":
                rows = rows.where(F.col("bucket") == LENGTHS).select("doc", "dl", "number")
            found = rows if found is None else found.unionByName(rows)
        marks = [spark.read.parquet(f"{self.path}/{e.name}") for e in every if e.kind == "marks"]
        if not marks:
            return found
        last = reduce(DataFrame.unionByName, marks).groupBy("doc").agg(F.max("at").alias("at"))
        return found.join(last, "doc", "left").where(F.col("at").isNull() | (F.col("at") <= F.col("number"))).drop("at")

    def postings(self, spark: SparkSession) -> DataFrame:
        return self.tables(spark, "postings")

    def totals(self, spark: SparkSession) -> DataFrame:
        """One row: n documents, mean words."""
        t = next(e for e in self.manifest(spark)[1] if e.kind == "totals")
        return spark.createDataFrame([(t.docs, t.words / t.docs if t.docs else 0.0)], "n long, mean double")


MANIFEST = "kind string, name string, number long, docs long, words long, version long"


def bucket_of(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def committed(spark: SparkSession, index: Index, version: int, entries: list[tuple]) -> None:
    spark.createDataFrame(entries, MANIFEST.removesuffix(", version long")).coalesce(1).write.parquet(f"{index.path}/manifest/version={version}")


#: A term's postings go to so many files of a bucket at most, by document; the bucket of documents' lengths; places of words that a task gathers.
SPREAD, LENGTHS, HELD = 8, -1, 500_000


def written(postings: DataFrame, path: str) -> None:
    # a frequent term's postings spread over files by document
    spread = F.pmod(F.xxhash64("doc"), F.lit(SPREAD))
    postings.repartition("bucket", spread).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def segment(index: Index, docs: DataFrame, doc: str, text: str, number: int) -> tuple:
    """Tokenizes every text once and writes a segment; its entry in the manifest.

    A text's words are gathered by term where the text lies, so what is shuffled is a row per term and
    document. Each document adds a row without a term, which has its length, in a bucket of its own.
    """
    spark, name = docs.sparkSession, f"segment-{number}-{uuid.uuid4().hex}"
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(placed, f"doc {rows.schema['doc'].dataType.simpleString()}, dl int, term string, positions array<int>")
    bucket = F.when(F.col("term").isNull(), F.lit(LENGTHS)).otherwise(bucket_of("term", index.buckets))
    written(found.select(bucket.alias("bucket"), "term", "doc", F.size("positions").cast("long").alias("tf"), "dl", "positions"), f"{index.path}/{name}")
    return ("segment", name, number, *lengths(spark, index, name))


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text a row without a term, and a row per term with its places; at most about ``HELD`` places at once."""
    for batch in batches:
        docs, dl, words, places, ends = [], [], [], [], [0]
        for i, text in enumerate(batch.column("text")):
            found = terms_of(text.as_py())
            at: dict[str | None, list[int]] = {None: []}
            for k, term in enumerate(found):
                at.setdefault(term, []).append(k)
            for term, where in at.items():
                words.append(term)
                places += where
                ends.append(len(places))
            docs += [i] * len(at)
            dl += [len(found)] * len(at)
            if len(places) >= HELD or i + 1 == batch.num_rows:
                positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(docs, pa.int64())), pa.array(dl, pa.int32()), pa.array(words, pa.string()), positions], names=["doc", "dl", "term", "positions"])
                docs, dl, words, places, ends = [], [], [], [], [0]


def lengths(spark: SparkSession, index: Index, name: str) -> tuple[int, int]:
    """Documents and words of a segment."""
    found = spark.read.parquet(f"{index.path}/{name}").where(F.col("bucket") == LENGTHS)
    return tuple(found.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())


def build(docs: DataFrame, doc: str, text: str, path: str, buckets: int = 64) -> Index:
    """An index of one segment. A document without terms counts among the documents; ids must be distinct."""
    index = Index(path, buckets)
    first = segment(index, docs, doc, text, 1)
    committed(docs.sparkSession, index, 1, [first, ("totals", None, 1, first[3], first[4])])
    return index


def changed(spark: SparkSession, index: Index, ids: DataFrame, docs: DataFrame | None = None, doc: str = "doc", text: str = "text") -> None:
    version, entries = index.manifest(spark)
    number = 1 + max(e.number for e in entries)
    name = f"marks-{number}-{uuid.uuid4().hex}"
    ids.select(F.col(doc).alias("doc")).distinct().withColumn("at", F.lit(number).cast("long")).write.parquet(f"{index.path}/{name}")
    gone = index.tables(spark, "docs").join(spark.read.parquet(f"{index.path}/{name}").select("doc"), "doc", "left_semi").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    own = [segment(index, docs, doc, text, number)] if docs is not None else []
    old = next(e for e in entries if e.kind == "totals")
    totals = ("totals", None, number, old.docs - gone[0] + sum(s[3] for s in own), old.words - gone[1] + sum(s[4] for s in own))
    kept = [tuple(e)[:5] for e in entries if e.kind != "totals"]
    committed(spark, index, version + 1, [*kept, ("marks", name, number, gone[0], gone[1]), *own, totals])


def upsert(index: Index, docs: DataFrame, doc: str, text: str) -> None:
    """Inserts documents, or puts them in the place of those with their ids. Only these texts and the ids of the others are read."""
    changed(docs.sparkSession, index, docs, docs, doc, text)


def delete(index: Index, ids: DataFrame, doc: str) -> None:
    changed(ids.sparkSession, index, ids, doc=doc)


def merge(spark: SparkSession, index: Index, most: int = 8) -> None:
    """Writes the smallest segments' live rows into one, so that ``most`` are left; with one left, marks go, too."""
    version, entries = index.manifest(spark)
    parts = sorted((e for e in entries if e.kind == "segment"), key=lambda e: (e.docs, e.number))
    if len(parts) <= most:
        return
    old = parts[: len(parts) - most + 1]
    # its rows are those live now, so later marks alone can concern them
    number = max(e.number for e in old)
    name = f"segment-{number}-{uuid.uuid4().hex}"
    written(index.tables(spark, "all", old).drop("number"), f"{index.path}/{name}")
    t = lengths(spark, index, name)
    names = {e.name for e in old}
    rest = [tuple(e)[:5] for e in entries if e.name not in names and not (most == 1 and e.kind == "marks")]
    committed(spark, index, version + 1, [*rest, ("segment", name, number, t[0], t[1])])


def units_of(query: str) -> list[tuple[str, ...]]:
    """The query's words, each as its terms: several terms are a phrase. Each once, in order."""
    return list(dict.fromkeys(tuple(t) for word in query.split() if (t := terms_of(word))))


def phrase(found: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """doc, dl, tf: where the words stand one behind the other, from the postings of their terms."""
    places = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(w).alias("term")) for i, w in enumerate(words)])
    asked = found.sparkSession.range(1).select(F.explode(places).alias("p")).select("p.*")
    at = found.join(F.broadcast(asked), "term").select("doc", "dl", "k", F.explode("positions").alias("at"))  # a row per word
    starts = at.groupBy("doc", "dl", (F.col("at") - F.col("k")).alias("start")).agg(F.count("*").alias("n")).where(F.col("n") == len(words))
    return starts.groupBy("doc", "dl").agg(F.count("*").alias("tf"))


def search(spark: SparkSession, index: Index, query: str, most: int | None = None) -> DataFrame:
    """doc, rank: documents that hold all the query's words as stems, the best ``most`` of them.

    A word that falls into several terms ("e-mail", "3.5") is a phrase: its terms follow each other, and
    its occurrences and documents are counted like a term's.
    """
    units = units_of(query)
    found = index.postings(spark)
    if not units:
        return found.select("doc", F.lit(0.0).alias("rank")).limit(0)
    wanted = sorted({t for u in units for t in u})
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "term string").select(bucket_of("term", index.buckets)).distinct().collect()]  # as many as the query has words
    found = found.where(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))
    singles = [u[0] for u in units if len(u) == 1]
    rows = found.where(F.col("term").isin(singles)).select("doc", "dl", F.col("term").alias("unit"), "tf")
    for u in units:
        if len(u) > 1:
            rows = rows.unionByName(phrase(found.where(F.col("term").isin(*u)), u).select("doc", "dl", F.lit(" ".join(u)).alias("unit"), "tf"))
    df = rows.groupBy("unit").agg(F.count("*").alias("df"))
    rows = rows.join(F.broadcast(df), "unit").crossJoin(F.broadcast(index.totals(spark)))  # a row per word of the query; one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    ranked = rows.groupBy("doc").agg((-F.sum(score)).alias("rank"), F.count("*").alias("k")).where(F.col("k") == len(units)).drop("k")
    return ranked if most is None else ranked.orderBy(F.round("rank", 9), "doc").limit(most)


def search_nodes(spark: SparkSession, index: Index, nodes: DataFrame, query: str, most: int = 50) -> DataFrame:
    """node, label, node_type, snippet, rank of nodes whose label holds the query's words."""
    hits = search(spark, index, query, most).withColumnRenamed("doc", "node")
    return nodes.join(F.broadcast(hits), "node").select("node", "label", "node_type", snippet(F.col("label"), terms_of(query), 32).alias("snippet"), "rank")  # `most` rows


def search_content(spark: SparkSession, index: Index, chunks: DataFrame, edges: DataFrame, provenance: DataFrame, incidences: DataFrame, items: DataFrame, query: str, most: int = 30) -> DataFrame:
    """node, rank, snippet, title: nodes on edges that come from one of the best ``most`` chunks, each with its best chunk.

    An edge comes from a chunk that it names itself or that its provenance names.
    """
    hits = F.broadcast(search(spark, index, query, most).withColumnRenamed("doc", "id"))  # `most` rows
    found = chunks.join(hits, "id").join(items.select(F.col("id").alias("feed_item_id"), "title"), "feed_item_id")
    found = found.select("id", "feed_item_id", "chunk_index", "title", "rank", snippet(F.col("content"), terms_of(query), 48).alias("snippet")).checkpoint()
    named = edges.select("edge_id", F.col("source_chunk_id").alias("id")).join(F.broadcast(found.select("id")), "id")
    stated = provenance.select("edge_id", "feed_item_id", "chunk_index").join(F.broadcast(found.select("id", "feed_item_id", "chunk_index")), ["feed_item_id", "chunk_index"])
    both = named.select("edge_id", "id").unionByName(stated.select("edge_id", "id")).distinct()
    nodes = both.join(incidences.select("edge_id", "node"), "edge_id").select("node", "id").distinct()
    per = nodes.join(F.broadcast(found.select("id", "rank", "snippet", "title")), "id")
    return per.groupBy("node").agg(F.min_by(F.struct("rank", "snippet", "title"), F.struct(F.round("rank", 9), "id")).alias("best")).select("node", "best.*")


def search_all(direct: DataFrame, derived: DataFrame) -> DataFrame:
    """node, rank, kind: direct matches, and nodes found by content that aren't among them."""
    rest = derived.join(direct.select("node"), "node", "left_anti")
    return direct.select("node", "rank", F.lit("label").alias("kind")).unionByName(rest.select("node", "rank", F.lit("content").alias("kind")))


def matched(results: DataFrame) -> DataFrame:
    """All matched nodes, each once."""
    return results.select("node").distinct()


def bm25(docs: DataFrame, doc: str, text: str, words: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """doc, rank for the documents that hold all words as they are written, without an index: one scan of the texts."""
    words = sorted(set(words))
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = docs.select(F.col(doc).alias("doc"), tokens.alias("terms")).withColumn("dl", F.size("terms"))
    counts = [(F.size("terms") - F.size(F.array_remove("terms", w))).alias(f"tf{i}") for i, w in enumerate(words)]
    rows = rows.select("doc", "dl", *counts)
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.greatest("dl", F.lit(0))).alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    found = rows.where(" and ".join(f"tf{i} > 0" for i in range(len(words)))).crossJoin(F.broadcast(stats))  # one row
    score = sum((F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(LEAST_IDF)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("mean"))) for i in range(len(words))), F.lit(0.0))
    return found.select("doc", (-score).alias("rank"))
