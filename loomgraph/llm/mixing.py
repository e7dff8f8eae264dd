"""Operator 1: mixing sources to target weights along a curriculum, with DataFrame functions only.

Each source has a share of the token budget (:func:`source_targets`) and a weight schedule over
training progress 0..1. Integrating the schedule gives the source's cumulative demand; inverting it
at a document's place in its source gives the document's training position.

Places are running word counts. So that a source with a third of all rows is no single task, each
source is cut into hash buckets: running sums are taken within (source, bucket), and a small table
of bucket totals gives each bucket its start.

Defined results: a null text has size 0; a null source is a source of its own, sorted last; a source
without words has target 0 and nothing is taken from it; repeated rows are documents of their own;
ties in the shuffled order go by doc_id, then size; a very long text is one document, taken whole;
an empty table gives an empty result; other columns pass through, whatever their names. The table of
sources, of about 50 bytes each, is ranked in one task, so some ten millions of sources are the limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A schedule: (progress, rate) knots, linear in between.
Schedule = Sequence[tuple[float, float]]
#: Curriculum of the query: the heavy class leads, the light class trails.
CURRICULUM: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def integrated(schedule: Schedule) -> Column:
    """The schedule's segments with the share of demand met before each, as an array of structs."""
    areas = [(t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(schedule, schedule[1:])]
    total, before, rows = sum(areas), 0.0, []
    for ((t0, r0), (t1, r1)), area in zip(zip(schedule, schedule[1:]), areas):
        slope = (r1 - r0) / (t1 - t0) / total
        rows.append(F.struct(F.lit(before).alias("met"), F.lit(t0).alias("t"), F.lit(r0 / total).alias("rate"), F.lit(slope).alias("slope")))
        before += area / total
    return F.array(*rows)


def position_at(share: Column, segments: Column) -> Column:
    """Progress at which the given share of a source's demand is met (the inverse of the integral)."""
    seg = F.element_at(F.filter(segments, lambda s: s["met"] <= share), -1)
    left = share - seg["met"]
    return F.least(F.lit(1.0), seg["t"] + 2 * left / (seg["rate"] + F.sqrt(F.greatest(F.lit(1e-300), seg["rate"] ** 2 + 2 * seg["slope"] * left))))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """One row per source: __source, source_size, target, class (its place in ``weights``).

    Budget ``share`` x all words is dealt by weight; a target stops at ``max_epochs`` x its source's
    size and the excess is dealt again by weight. In order of size per weight the capped sources come
    first, so the level that the others reach follows from running sums. The table has a row per
    source, far fewer than documents.
    """
    by_name = Window.orderBy(F.col("__source") == "", "__source")
    per = sizes.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    per = per.withColumn("class", (F.row_number().over(by_name) - 1) % len(weights))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("class") + 1)).withColumn("most", F.col("source_size") * float(max_epochs))
    filling = Window.orderBy(F.col("most") / F.col("weight"), "__source")
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    # the level of the first source that isn't capped; those after it come out lower
    reached = F.max(F.when(F.col("weight") * F.col("level") < F.col("most"), F.col("level"))).over(everything)
    per = per.withColumn("reached", reached)
    return per.select("__source", "source_size", F.coalesce(F.least("most", F.col("weight") * F.col("reached")), F.col("most")).alias("target"), "class")


def keyed(docs: DataFrame, size: Column, seed: str = "mix") -> DataFrame:
    """Adds __size, __source (never null: '' is the null source) and __order, a seeded shuffle."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("text"), F.lit(""))))) if "text" in docs.columns else F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.withColumns({"__size": size, "__source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")), "__order": F.substring(F.md5(F.concat(F.lit(f"{seed} "), name)), 1, 16)})


def assign(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, curriculum: Sequence[Schedule] = CURRICULUM, bucket_digits: int = 3, stats: DataFrame | None = None) -> DataFrame:
    """Adds __source_size, __target, __copies and __positions (one per copy) to :func:`keyed` rows.

    Pass p of a source takes its documents in shuffled order; a document is taken in each pass in
    which its middle word falls within the target, so a source misses its target by half a document
    at most. ``stats`` may be a narrower table of the same rows for the totals.
    """
    stats = rows if stats is None else stats
    bucket = F.substring("__order", 1, bucket_digits)
    targets = source_targets(stats, weights, share, max_epochs)
    starts = stats.groupBy("__source", bucket.alias("__bucket")).agg(F.sum("__size").alias("__total"))
    ahead = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("__start", F.coalesce(F.sum("__total").over(ahead), F.lit(0))).drop("__total")
    starts = starts.join(targets.select("__source", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("class").alias("__class")), "__source")
    within = Window.partitionBy("__source", "__bucket").orderBy("__order", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("__bucket", bucket).withColumn("__before", F.sum("__size").over(within) - F.col("__size")).join(starts, ["__source", "__bucket"])
    middle = F.col("__start") + F.col("__before") + F.col("__size") / 2
    copies = F.when((F.col("__source_size") > 0) & (middle <= F.col("__target")), F.floor((F.col("__target") - middle) / F.col("__source_size")) + 1).otherwise(0).cast("int")
    # an empty document in the middle of nothing is taken as often as its neighbours, never beyond the cap
    placed = placed.withColumn("__copies", F.least(copies, F.lit(int(max_epochs)))).withColumn("__middle", middle)
    segments = F.element_at(F.array(*map(integrated, curriculum)), F.col("__class") % len(curriculum) + 1)
    shares = F.transform(F.when(F.col("__copies") > 0, F.sequence(F.lit(0), F.col("__copies") - 1)).otherwise(F.array().cast("array<int>")), lambda p: (p * F.col("__source_size") + F.col("__middle")) / F.col("__target"))
    return placed.withColumn("__positions", F.transform(shares, lambda u: position_at(u, segments)))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in training order: each document as often as it is taken, range-sorted by position."""
    needed = ["doc_id", "source", "text"]
    at = {c: c if c in needed else f"c{i}" for i, c in enumerate(docs.columns)}
    rows = keyed(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()]), word_count(F.col("text")))
    order = assign(rows, stats=rows.select("__source", "__size", "__order"), **options)
    order = order.select(*at.values(), "__order", F.explode("__positions").alias("__position"))
    return order.orderBy("__position", "__order").select(*[F.col(n).alias(c) for c, n in at.items()])


def op1_mix_to_weights(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = keyed(docs, word_count(F.col("text"))).select("doc_id", "source", "__size", "__source", "__order")
    placed = assign(stored(rows, "mix"))
    result = placed.select(
        "doc_id", "source", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"), F.col("__copies").alias("copies"), F.round(F.try_element_at("__positions", F.lit(1)), 9).alias("position"),
    )
    return result.orderBy("position", "doc_id")


OP1_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5('mix ' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))), 1, 16) AS o
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS class FROM per),
weighed AS (SELECT *, CASE class WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM ranked),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY most / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
reached AS (SELECT *, max(CASE WHEN weight * level < most THEN level END) OVER () AS reached FROM levels),
targets AS (SELECT source, source_size, class, coalesce(least(most, weight * reached), most) AS target FROM reached),
placed AS (SELECT r.*, t.source_size, t.target, t.class,
             CAST(sum(size) OVER (PARTITION BY r.source ORDER BY o, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size + size / 2.0::DOUBLE AS middle
           FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
taken AS (SELECT *, CAST(CASE WHEN source_size > 0 AND middle <= target THEN least(floor((target - middle) / source_size) + 1, 2) ELSE 0 END AS INTEGER) AS copies FROM placed),
shares AS (SELECT *, CASE WHEN copies > 0 THEN middle / target END AS u FROM taken)
SELECT doc_id, source, size, source_size, target, size * copies AS taken, copies,
  round(CASE WHEN copies = 0 THEN NULL WHEN class = 0 THEN least(1.0, 2 * u / (1.5 + sqrt(1.5 * 1.5 - 2 * u)))
       WHEN class = 1 THEN u
       WHEN u < 0.3125 THEN least(1.0, 2 * u / (0.25 + sqrt(0.0625 + 3 * u)))
       ELSE least(1.0, 0.5 + 2 * (u - 0.3125) / (1.0 + sqrt(1.0 + 3 * (u - 0.3125)))) END, 9) AS position
FROM shares
"""
