"""Operator 12: spelling variants by merging the light subtrees of a trie of words.

The words form a trie whose nodes are their prefixes. At each node the heavy child is the one with the
most words below it (ties: the largest character); a word's end is a light child. A word leaves the
heavy path at most log2(words) times, and only there it is merged with its siblings:

- its subtree without the character of the light edge, into the node itself (*skipped*);
- its subtree under the heavy child, with the heavy character for its own (*replaced*) or before it
  (*inserted*); the smaller subtree always goes into the larger;
- the light subtrees of a node with each other, without the characters of their edges (*light*).

Where a moved word ends where another one ends, the two are one edit apart. A skipped character must
differ from the next one, which makes every pair come up exactly once: at the node where its words
part, from the light side. So nothing has to be told apart afterwards, and near words are counted by
aggregation. All of it is DataFrame functions: a node is a prefix, a merge is a join on the moved
word, and a frequent node (the root has all words) meets its heavy child in a join that Spark splits.

The forms' links go to words at least ``ratio`` times as frequent, so chains are short, and doubling
finds their ends in a few rounds.

Defined results: characters are code points; A-Z are lower-cased and nothing else; a null or empty
text has no words; a null doc_id is the empty string before the colon; repeated rows count again; the
largest n wins, then the smallest word by code points; words of any length and texts of any length are
taken whole; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discarded, stored

#: The characters of words, once A-Z are lower-cased.
WORD = "[a-zÀ-ÿ]+"


def damaged(run: Column, doc_id: Column, one_in: int) -> Column:
    """The run without one code point, for one in ``one_in`` of the pairs (document, run)."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def words(docs: DataFrame, shortest: int = 7, least: int = 2, one_in: int | None = 31) -> DataFrame:
    """word, n: the words of at least ``shortest`` characters that occur at least ``least`` times."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0))).alias("word"))
    runs = runs.where(F.char_length("word") >= shortest)
    if one_in:
        runs = runs.select(damaged(F.col("word"), F.col("doc_id"), one_in).alias("word")).where(F.char_length("word") >= shortest)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def light_edges(table: DataFrame) -> DataFrame:
    """word, n, at, own, heavy: where a word leaves the heavy path, after ``at`` characters."""
    place = F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("at")
    steps = table.select("word", "n", place).select("*", F.substring("word", F.lit(1), F.col("at")).alias("node"), F.substring("word", F.col("at") + 1, F.lit(1)).alias("own"))
    children = steps.groupBy("node", "own").agg(F.count("*").alias("below"))
    nodes = children.groupBy("node").agg(F.count("*").alias("children"), F.max(F.when(F.col("own") != "", F.struct("below", "own"))).alias("heavy"))
    # written, so that the join reads both sides from exchanges and can split a frequent node
    nodes = stored(nodes.where(F.col("children") > 1).select("node", F.col("heavy.own").alias("heavy")), "nodes")
    return steps.join(nodes, "node").where(F.col("own") != F.col("heavy")).drop("node")


def near_pairs(table: DataFrame) -> DataFrame:
    """word, n, near, near_n: each pair of words that are one edit apart, once."""
    edges = stored(light_edges(table), "edges")
    word, at, own, heavy = (F.col(c) for c in ("word", "at", "own", "heavy"))
    head, rest = F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word))
    moved = F.array(
        F.when((own != "") & (own != F.substring(word, at + 2, F.lit(1))), F.concat(head, rest)),
        F.when(own != "", F.concat(head, heavy, rest)),
        F.concat(head, heavy, own, rest),
    )
    moved = edges.select("word", "n", F.explode(F.array_compact(moved)).alias("near"))
    found = moved.join(table.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")
    # siblings: as many at most as there are characters
    members = edges.where(own != "").groupBy(at.alias("at"), F.concat(head, F.lit("*"), rest).alias("key")).agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("m")).where(F.size("m") > 1)
    one = members.select("m", F.explode("m").alias("a"))
    light = one.select("a", F.explode(F.filter("m", lambda x: x["word"] > F.col("a.word"))).alias("b"))
    return found.unionByName(light.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n")))


def ends(forms: DataFrame) -> DataFrame:
    """word, root: where the links word -> form end."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discarded(now)
        if after.where("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")
        now.stored_at = after.stored_at


def variants(docs: DataFrame, shortest: int = 7, least: int = 2, ratio: int = 10, one_in: int | None = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word. ``one_in`` None leaves the texts as they are."""
    table = stored(words(docs, shortest, least, one_in), "words")
    pairs = near_pairs(table)
    both = pairs.select("word", "n", F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p")).select("p.*")
    stats = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    rows = table.join(stats, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), best["near"].alias("form"), (-best["less"]).alias("form_n"))
    rows = stored(rows, "variants")
    roots = ends(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def merged_variants(docs: DataFrame, **options) -> DataFrame:
    """root, n, words: each group of spelling variants with its members and their occurrences."""
    rows = variants(docs, **options)
    return rows.groupBy("root").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("word")).alias("words"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The crc32 by a table of 256 values that is computed bit by bit; near words by their strings without one character.
OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
bytes AS (SELECT run, doc_id, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM counted),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc),
words AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, word[:i] AS head, word[i + 2:] AS tail FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
pairs AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT DISTINCT a.word, a.n, b.word, b.n FROM cut a JOIN w b ON a.head || a.tail = b.word
  UNION SELECT DISTINCT b.word, b.n, a.word, a.n FROM cut a JOIN w b ON a.head || a.tail = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best ON w.word = best.word),
chain AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN f ON c.next = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON f.word = c.word AND c.next IS NULL
"""
