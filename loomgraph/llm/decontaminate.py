"""Operator 3: benchmark decontamination, with DataFrame functions only.

Test items are cut into windows of ten words (a shorter item is one window). A document is not cut
at every word: an occurrence of a window of L words covers a whole block of b = (L + 1) // 2 words
that starts at a multiple of b. So documents give only every b-th block; blocks found in the hash
set of the windows' blocks lead to the few places where whole windows are compared.

The hash sets are broadcast while the windows number at most ``MOST_WINDOWS``; beyond that the same
joins shuffle block keys instead.

Defined results: a null text has no words; null or wordless items have no windows; an item without
id is listed as ''; rows that share doc_id and text have the same result; items with equal windows are
all listed; a very long text is cut into blocks twice at most, and each found block costs the same
however long the text is; empty tables give empty or uncontaminated results; other columns, whatever their names, are ignored by the report and
kept by the filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, by_ids, stored, text_key

WIDTH = 10
#: Stands for a null doc_id where ids are looked up.
NO_ID = -(1 << 63)
#: At about 100 bytes a window the sets stay under some 100 MB.
MOST_WINDOWS = 500_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """The words, each followed by one space; '' when there are none."""
    words = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    return F.when(words == "", words).otherwise(F.concat(words, F.lit(" ")))


def run_of(words: Column, start: Column, n) -> Column:
    """n words from the 0-based place ``start``, each followed by a space."""
    return F.concat(F.array_join(F.slice(words, start + 1, n), " "), F.lit(" "))


def word_array(norm: Column) -> Column:
    return F.split(F.rtrim(norm), " ")


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct windows: window, n (its words), items (ids as strings)."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), normalised(F.col("text")).alias("norm")).where(F.col("norm") != "")
    rows = rows.withColumn("words", word_array(F.col("norm"))).withColumn("n", F.least(F.size("words"), F.lit(width)))
    rows = rows.select("item", "words", "n", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))).alias("at"))
    rows = rows.select("item", "n", run_of(F.col("words"), F.col("at"), F.col("n")).alias("window"))
    return rows.groupBy("window", "n").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per (doc_id, __text) with an occurrence: n_hit, items (sorted ids)."""
    windows = stored(item_windows(benchmark, width), "windows")
    stats = windows.groupBy("n").agg(F.count("*").alias("c")).orderBy("n").collect()  # a row per window length
    small = sum(r["c"] for r in stats) <= MOST_WINDOWS
    hint = F.broadcast if small else (lambda df: df)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__key")
    rows = docs.select("doc_id", key, text_key(F.col("text")).alias("__text"), normalised(F.col("text")).alias("norm"))
    sizes = {block: [r["n"] for r in stats if (r["n"] + 1) // 2 == block] for block in sorted({(r["n"] + 1) // 2 for r in stats})}
    if not sizes:
        return rows.select("doc_id", "__text", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")).limit(0)
    blocks = lambda block: F.regexp_extract_all("norm", F.lit(f"(?:[^ ]+ ){{1,{block}}}"), F.lit(0))
    found = None
    for block, lengths in sizes.items():
        anchors = windows.where(F.col("n").isin(lengths)).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda o: run_of(word_array(F.col("window")), o, block))).alias("block")).distinct()
        part = rows.select("__key", "__text", F.posexplode(blocks(block)).alias("k", "block")).join(hint(anchors), "block", "left_semi")
        part = part.groupBy("__key", "__text").agg(F.collect_set("k").alias("ks")).withColumn("size", F.lit(block))
        found = part if found is None else found.unionByName(part)
    found = stored(found, "places")
    # only documents with a found block are cut again; their blocks lie in one array, so a place costs the same in a text of any length
    some = stored(by_ids(rows, found.select("__key"), key="__key").dropDuplicates(["__key", "__text"]), "found")
    held, found = found, None
    for block, lengths in sizes.items():
        near = some.join(held.where(F.col("size") == block).hint("merge"), ["__key", "__text"])
        near = near.select("doc_id", "__text", blocks(block).alias("blocks"), "ks").select("doc_id", "__text", "blocks", F.explode("ks").alias("k"))
        # the blocks before, at and after the found one hold every window that covers it
        first = F.greatest(F.col("k") - 1, F.lit(0))
        around = word_array(F.array_join(F.slice("blocks", first + 1, F.col("k") - first + 2), ""))
        near = near.select("doc_id", "__text", (first * block).alias("base"), ((F.col("k") - first) * block).alias("at"), around.alias("words"))
        of_block = windows.where(F.col("n").isin(lengths))
        for n in lengths:
            starts = F.filter(F.sequence(F.col("at") - (block - 1), F.col("at")), lambda p: (p >= 0) & (p + n <= F.size("words")))
            places = F.explode(F.transform(starts, lambda p: F.struct((F.col("base") + p).alias("start"), run_of(F.col("words"), p, n).alias("window")))).alias("place")
            part = near.select("doc_id", "__text", places).select("doc_id", "__text", "place.*", F.lit(n).alias("n")).join(hint(of_block.where(F.col("n") == n).select("window", "items")), "window")
            part = part.select("doc_id", "__text", F.struct("start", "n").alias("run"), "items")
            found = part if found is None else found.unionByName(part)
    per = found.groupBy("doc_id", "__text").agg(F.array_sort(F.collect_set("run")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "runs", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, r: F.struct(F.greatest(a["end"], r["start"] + r["n"]).alias("end"), (a["n"] + F.greatest(F.lit(0), r["start"] + r["n"] - F.greatest(a["end"], r["start"]))).alias("n")),
        lambda a: a["n"].cast("long"),
    )
    return per.select("doc_id", "__text", covered.alias("n_hit"), "items", "runs")


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(ANY_CASE_WORD)), F.lit(0)).cast("long")
    base = docs.select("doc_id", text_key(F.col("text")).alias("__text"), words.alias("n_words"))
    found = stored(hits(docs, benchmark, width).select(F.col("doc_id").alias("__id"), F.col("__text").alias("__t"), "n_hit", "items"), "hits")
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__t")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def split_by_hits(docs: DataFrame, benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents whose doc_id has no occurrence, the others, and the occurrences (__id, __t, runs)."""
    found = stored(hits(docs, benchmark, width).select(F.col("doc_id").alias("__id"), F.col("__text").alias("__t"), "runs"), "hits")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()], key.alias("__key"))
    ids = found.select(F.coalesce(F.col("__id").cast("long"), F.lit(NO_ID)))
    return by_ids(rows, ids, held=False, key="__key"), by_ids(rows, ids, key="__key").withColumn("__t", text_key(F.col(at["text"]))), found.withColumn("__key", F.coalesce(F.col("__id").cast("long"), F.lit(NO_ID)))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without an occurrence, all columns kept. Only texts under a doc_id that has one are shuffled."""
    rest, some, found = split_by_hits(docs, benchmark, width)
    both = rest.drop("__key").unionByName(some.join(found, ["__key", "__t"], "left_anti").drop("__key", "__t"))
    return both.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """All documents; in those with occurrences the words under them are cut out, the others joined by spaces."""
    rest, some, found = split_by_hits(docs, benchmark, width)
    text = F.col(f"c{docs.columns.index('text')}")
    words = F.regexp_extract_all(text, F.lit(ANY_CASE_WORD), F.lit(0))
    left = F.filter(words, lambda w, i: ~F.exists("runs", lambda r: (i >= r["start"]) & (i < r["start"] + r["n"])))
    cut = some.join(found.select("__key", "__t", "runs"), ["__key", "__t"], "left")
    columns = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    cut = cut.select(*[F.when(F.col("runs").isNotNull(), F.array_join(left, " ")).otherwise(text).alias(c) if c == "text" else x for c, x in zip(docs.columns, columns)])
    return rest.select(*columns).unionByName(cut)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM (SELECT item, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
