"""Mixing sources to target weights by hash-threshold histograms, without sorting documents.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share `budget` times all
words; a source's target stops at `most` times its size and the excess goes to the others by weight.
That is water-filling, solved in closed form over the (small) table of sources.

Filter: every document has a 60-bit hash of its id.  A source takes whole passes over all its documents
as often as its target allows and of the next pass the documents below a hash threshold.  The threshold
comes from histograms: words by (source, hash bucket of 12 bits); the bucket in which the budget ends is
refined by the next 12 bits, and so on, so that five small aggregations place it to one hash value; the
unit there is taken if that comes closer to the target.  Thresholds of smaller budgets are nested in those of
larger ones, as all use one hash.

Documents are taken whole, so a source's words miss its target by at most half of what the boundary hash holds: half a document, as a
rule.  The table of sources (a row each) is taken by one task; documents never are.

Only built-in expressions run.  Aggregations combine before the shuffle, so a source with a third of all
rows sends 4,096 sums a task; joins are with tables of one row a source.

Defined cases: null text has size 0; a null id hashes as the word `null`; documents with equal ids in a source
are taken together; a null source is a source; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
LEVELS = 5
BITS = 12


def size_of(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def hash_of(id_col: str) -> Column:
    """60 bits of the MD5 of the id's decimal form."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("at") % len(weights) + 1).cast("int"))
    t = sizes.withColumn("at", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # sources in order of the level at which they fill: those before a source are full when it is
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("level", (F.sum("source_size").over(everything) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    t = t.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    # the level of the first source that isn't full holds for all from there on
    t = t.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.row_number().over(filling).alias("k"), "level"))).over(everything)["level"])
    return t.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """(source, below): of each source the documents with hash < below hold about `rest` words.

    rows: (source, h, size); rest: (source, rest double), the words that the last pass may take.
    """
    state = rest.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("done"))
    for k in range(LEVELS):
        shift = BITS * (LEVELS - 1 - k)
        inside = rows.join(state, rows["source"].eqNullSafe(state["source"])).where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        hist = inside.groupBy(rows["source"].alias("source"), F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        hist = hist.withColumnRenamed("source", "name")
        joined = hist.join(state.select("source", "rest", "prefix", "done"), hist["name"].eqNullSafe(F.col("source")))
        w = Window.partitionBy("name").orderBy("bucket")
        ran = joined.withColumn("before", F.col("done") + F.sum("words").over(w) - F.col("words"))
        # the bucket in which the budget ends: the last that begins within it
        last = ran.where(F.col("before") <= F.col("rest")).groupBy("name").agg(
            F.max(F.struct("bucket", "before", "words", "rest")).alias("x")
        )
        state = last.select(F.col("name").alias("source"), F.col("x.rest").alias("rest"), F.col("x.bucket").alias("prefix"), F.col("x.before").alias("done"), F.col("x.words").alias("words"))
        state = written(state, "op7-thresholds", small=True)
    closer = F.col("done") + F.col("words") / 2 <= F.col("rest")
    return state.select("source", (F.col("prefix") + F.when(closer, 1).otherwise(0)).alias("below"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target (of the source), copies, taken."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), hash_of(id_col).alias("h")
    )
    rows = written(rows, "op7-sizes", small=True)
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = written(goal.withColumn("passes", F.least(whole, F.lit(most).cast("long"))), "op7-targets", small=True)
    rest = goal.select("source", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"))
    cut = thresholds(rows.where("size > 0"), rest)
    plan = goal.join(cut.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
    plan = written(plan.withColumnRenamed("source", "name"), "op7-plan", small=True)
    more = (F.col("passes") < most) & (F.col("h") < F.coalesce("below", F.lit(0)))
    copies = F.col("passes") + F.when(more, 1).otherwise(0)
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("name")))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source
), w AS (
  SELECT *, CASE pos % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), whole AS (
  SELECT 1.5::DOUBLE * sum(source_size) AS words FROM s
), filled AS (  -- what all sources hold when the level reaches this source's cap
  SELECT a.source, a.cap / a.weight AS level, sum(least(b.cap, b.weight * a.cap / a.weight)) AS held FROM w a, w b GROUP BY a.source, a.cap, a.weight
), full_at AS (
  SELECT coalesce(max(level), -1) AS level FROM filled, whole WHERE held <= words
), rest AS (
  SELECT ((SELECT words FROM whole) - coalesce(sum(cap) FILTER (cap / weight <= level), 0)) / nullif(sum(weight) FILTER (cap / weight > level), 0) AS level
  FROM w, full_at
), t AS (
  SELECT source, source_size, CASE WHEN cap / weight <= full_at.level THEN cap ELSE weight * rest.level END AS target FROM w, full_at, rest
), u AS (
  SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size) AS before FROM d GROUP BY source, h
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS passes FROM t
)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (passes + CASE WHEN passes < 2 AND u.before + u.words / 2.0 <= p.target - passes * p.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN u ON u.source IS NOT DISTINCT FROM d.source AND u.h = d.h
"""
