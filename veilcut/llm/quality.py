"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Per document the base counts are taken from the whole text.  Five measures are held against thresholds that
come from the data alone: for each language and source a quantile sketch of each measure, a histogram over
logarithmic buckets (relative error 0.1 %), is counted; such sketches merge by adding counts, so partial
aggregation combines them before the shuffle and a hot source sends some hundred counts a task.  A measure's
threshold is its group's median plus `spread` times its upper half-spread (p75 - p50); word length also has a
lower one, the median less `spread` times (p50 - p25).  A half-spread counts as at least MARGIN of the median, so that a
group of much alike texts keeps some room.  Measures that are zero in most texts (NONZERO) take quantiles of
the texts in which they aren't.  Sketches count each different text of a group once, so copies don't move
them, and only texts that pass the base rules.  Groups of fewer than `least` texts take the sketch of their language, then of
the corpus; if that has fewer, the measure rejects nothing.  Documents then join the thresholds of their group and
are kept if no measure is beyond them and the base rules hold.  No measure has a fixed cutoff.

Only built-in expressions run.  Repeated 3-word windows are found inside the row: if hashes of windows repeat, they
are sorted with their positions, equal neighbours marked and the covered words counted from the gaps of the marked
positions, so no words are exploded or shuffled.

Defined cases: null and empty texts have no words and fail the base rules; texts of any length are taken whole; a null
language or source is a group of its own; repeated rows each come out (and count once in the sketches); other columns
are ignored, whatever their names, and kept by `keep`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, written

MEASURES = ("nonletter_share", "upper_share", "word_length", "repeat_share", "dup_line_share")
NONZERO = ("repeat_share", "dup_line_share")
#: The measure that has a lower threshold too.
LOWER = "word_length"
SPREAD = 16.0
LEAST = 100
MARGIN = 0.01
MIN_WORDS = 50
GAMMA = 1.002
TINY = 1e-4


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: bool = False) -> DataFrame:
    """doc_id, lang, source, th (a hash of the text), the base counts and the counts behind the measures; one row per row of docs.

    n_lines counts the lines with a word where lines repeat, else it is 0.  carry: also `row`, a struct of all columns of docs.
    """
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.coalesce(text_col, F.lit("")).alias("text"), *row
    )
    d = d.withColumn("w", F.regexp_extract_all("text", F.lit(f"({WORD_RE})"), F.lit(1)))
    d = d.withColumn("n_words", F.size("w").cast("long")).withColumn("lines", F.split("text", "\n", -1))
    windows = F.when(F.col("n_words") >= 3, F.expr("transform(sequence(0, cast(n_words - 3 as int)), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"))
    repeats = F.size("lines") > F.size(F.array_distinct("lines"))
    d = d.withColumn("h", windows).withColumn("lines", F.when(repeats, F.filter("lines", lambda x: x.rlike(WORD_RE))).otherwise(F.array().cast("array<string>")))
    # (hash of the window, position), sorted: equal windows are neighbours
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.expr("sort_array(transform(h, (x, i) -> struct(x as h, i as i)))")))
    marked = "sort_array(transform(filter(s, (x, k) -> x.h = get(s, k - 1).h or x.h = get(s, k + 1).h), x -> x.i))"
    d = d.withColumn("p", F.expr(marked))
    covered = "aggregate(transform(p, (x, k) -> least(3, coalesce(get(p, k + 1) - x, 3))), 0L, (a, x) -> a + x)"
    length = lambda x: F.length(x).cast("long")
    return d.select(
        "doc_id",
        "lang",
        "source",
        F.xxhash64("text").alias("th"),
        "n_words",
        length(F.array_join("w", "")).alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        length(F.regexp_replace("text", r"\P{L}+", "")).alias("n_letters"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        *(["row"] if carry else []),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(a / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {
        "nonletter_share": share(F.col("word_chars") - F.col("n_letters"), "word_chars"),
        "upper_share": share(F.col("n_upper"), "n_letters"),
        "word_length": share(F.col("word_chars"), "n_words"),
        "repeat_share": share(F.col("n_repeat_words"), "n_words"),
        "dup_line_share": share(F.col("n_dup_lines"), "n_lines"),
    }


def bucket(x: Column) -> Column:
    """Sketch bucket of a value that isn't negative; 0 for values up to TINY."""
    return F.when(x <= TINY, 0).otherwise(F.ceil(F.log(x / TINY) / F.log(F.lit(GAMMA)))).cast("int")


def value_of(b: Column) -> Column:
    """Middle of a bucket: within 0.1 % of all its values."""
    return F.when(b <= 0, 0.0).otherwise(F.pow(F.lit(GAMMA), b) * (2 * TINY / (1 + GAMMA)))


def sketches(feats: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the mergeable sketch of every group, each different text counted once."""
    m = measures()
    rows = feats.where(~base_failed()).select("lang", "source", "th", *(bucket(v).alias(k) for k, v in m.items()))
    rows = rows.groupBy("lang", "source", "th").agg(*(F.first(k).alias(k) for k in m))
    rows = rows.select("lang", "source", F.explode(F.create_map(*(x for k in m for x in (F.lit(k), F.col(k))))).alias("measure", "bucket"))
    return rows.where((F.col("bucket") > 0) | ~F.col("measure").isin(*NONZERO)).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Quartiles and size of the sketches merged by keys, columns named after tag; some thousand buckets a group at most."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    held = merged.groupBy(*keys, "measure").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("h"))
    # the least bucket with a share q of all values in it or below
    at = lambda q: value_of(
        F.expr(f"aggregate(h, struct(cast(0 as bigint) as c, cast(-1 as int) as b), (a, x) -> if(a.c >= {q} * n, a, struct(a.c + x.n as c, x.bucket as b)), a -> a.b)")
    )
    names = [F.col(k).alias(f"{tag}_{k}") for k in [*keys, "measure"]]
    return held.select(*names, F.col("n").alias(f"{tag}_n"), F.struct(at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75")).alias(f"{tag}_q"))


def thresholds(sketch: DataFrame, spread: float = SPREAD, least: int = LEAST) -> DataFrame:
    """One row a (lang, source) with the threshold of each measure (t_<measure>, and t_<measure>_low), null where there is none."""
    groups = sketch.select("lang", "source").distinct().select("lang", "source", F.explode(F.array(*map(F.lit, MEASURES))).alias("measure"))
    same = lambda k, tag: F.col(k).eqNullSafe(F.col(f"{tag}_{k}"))
    t = groups.join(_quantiles(sketch, ["lang", "source"], "o"), same("lang", "o") & same("source", "o") & same("measure", "o"), "left")
    t = t.join(_quantiles(sketch, ["lang"], "l"), same("lang", "l") & same("measure", "l"), "left").join(_quantiles(sketch, [], "e"), same("measure", "e"), "left")
    t = t.withColumn("q", F.when(F.col("o_n") >= least, F.col("o_q")).when(F.col("l_n") >= least, F.col("l_q")).when(F.col("e_n") >= least, F.col("e_q")))
    p25, p50, p75 = (F.col(f"q.{k}") for k in ("p25", "p50", "p75"))
    t = t.withColumn("t", p50 + spread * F.greatest(p75 - p50, MARGIN * p50)).withColumn("low", p50 - spread * F.greatest(p50 - p25, MARGIN * p50))
    one = lambda k, c: F.max(F.when(F.col("measure") == k, F.col(c)))
    return t.groupBy("lang", "source").agg(*(one(k, "t").alias(f"t_{k}") for k in MEASURES), one(LOWER, "low").alias(f"t_{LOWER}_low"))


def judge(docs: DataFrame, spread: float = SPREAD, least: int = LEAST, carry: bool = False, **columns: str) -> DataFrame:
    """One row per row of docs: the base counts, the measures, their thresholds, base_failed and kept."""
    feats = written(features(docs, carry=carry, **columns), "op8-features")
    limit = written(thresholds(sketches(feats), spread, least), "op8-thresholds", small=True)
    limit = limit.withColumnRenamed("lang", "t_lang").withColumnRenamed("source", "t_source")
    out = feats.join(limit, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    m = measures()
    limits = [f"t_{k}" for k in MEASURES] + [f"t_{LOWER}_low"]
    fine = ~base_failed()
    for k, v in m.items():
        fine = fine & F.coalesce(v <= F.col(f"t_{k}"), F.lit(True))
    fine = fine & F.coalesce(m[LOWER] >= F.col(f"t_{LOWER}_low"), F.lit(True))
    return out.select(*feats.columns, *(v.alias(k) for k, v in m.items()), *limits, base_failed().alias("base_failed"), fine.alias("kept"))


def keep(docs: DataFrame, spread: float = SPREAD, least: int = LEAST, **columns: str) -> DataFrame:
    """The rows of docs, all columns, that the rules keep; texts are written once with their counts and not shuffled."""
    return judge(docs, spread, least, carry=True, **columns).where("kept").select("row.*")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_M = {
    "nonletter_share": "(word_chars - n_letters) / word_chars",
    "upper_share": "n_upper / n_letters",
    "word_length": "word_chars / n_words",
    "repeat_share": "n_repeat_words / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
}

OP8_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g') AS letters
  FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))
), r AS (
  SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS pos FROM g WHERE n > 1) GROUP BY doc_id
), c AS (
  SELECT d.doc_id, lang, source, t, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
         length(letters) AS n_letters, length(regexp_replace(letters, '[^\p{Lu}]', '', 'g')) AS n_upper
  FROM d LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
), m AS (
  SELECT doc_id, lang, source, t, base_failed, measure, CASE WHEN v IS NULL OR isnan(v) THEN 0 ELSE v END AS v FROM ("""
    + " UNION ALL ".join(f"SELECT doc_id, lang, source, t, base_failed, '{k}' AS measure, {v} AS v FROM f" for k, v in _M.items())
    + r""")
), b AS (
  SELECT DISTINCT lang, source, t, measure, CASE WHEN v <= 1e-4::DOUBLE THEN 0 ELSE ceil(ln(v / 1e-4::DOUBLE) / ln(1.002::DOUBLE)) END AS bucket FROM m WHERE NOT base_failed
), z AS (
  SELECT * FROM b WHERE bucket > 0 OR measure NOT IN ('repeat_share', 'dup_line_share')
), qo AS (
  SELECT lang, source, measure, count(*) AS n, quantile_disc(bucket, [0.25, 0.5, 0.75]) AS q FROM z GROUP BY ALL
), ql AS (
  SELECT lang, measure, sum(n) AS n FROM qo GROUP BY ALL
), qm AS (
  SELECT lang, measure, quantile_disc(bucket, [0.25, 0.5, 0.75]) AS q FROM z GROUP BY ALL
), qe AS (
  SELECT measure, count(*) AS n, quantile_disc(bucket, [0.25, 0.5, 0.75]) AS q FROM z GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.measure, CASE WHEN qo.n >= 100 THEN qo.q WHEN ql.n >= 100 THEN qm.q WHEN qe.n >= 100 THEN qe.q END AS q
  FROM (SELECT DISTINCT lang, source FROM z) g CROSS JOIN (VALUES """
    + ", ".join(f"('{k}')" for k in MEASURES)
    + r""") k(measure)
  LEFT JOIN qo ON qo.lang IS NOT DISTINCT FROM g.lang AND qo.source IS NOT DISTINCT FROM g.source AND qo.measure = k.measure
  LEFT JOIN ql ON ql.lang IS NOT DISTINCT FROM g.lang AND ql.measure = k.measure
  LEFT JOIN qm ON qm.lang IS NOT DISTINCT FROM g.lang AND qm.measure = k.measure
  LEFT JOIN qe ON qe.measure = k.measure
), v AS (
  SELECT lang, source, measure, list_transform(q, lambda x: CASE WHEN x <= 0 THEN 0 ELSE pow(1.002::DOUBLE, x) * 2e-4 / 2.002 END) AS v FROM p
), l AS (
  SELECT lang, source, measure, v[2] + 16.0 * greatest(v[3] - v[2], 0.01::DOUBLE * v[2]) AS hi, v[2] - 16.0 * greatest(v[2] - v[1], 0.01::DOUBLE * v[2]) AS lo FROM v
), bad AS (
  SELECT DISTINCT m.doc_id FROM m JOIN l ON m.lang IS NOT DISTINCT FROM l.lang AND m.source IS NOT DISTINCT FROM l.source AND m.measure = l.measure
  WHERE m.v > l.hi OR m.measure = 'word_length' AND m.v < l.lo
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM f LEFT JOIN bad USING (doc_id)
"""
)
