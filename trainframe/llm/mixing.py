"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Every document has a hash. A source takes each document as often as its whole size fits its target, and once more
those with a hash up to a threshold. The thresholds come from histograms: words by source and hash bucket, a running
sum over a source's buckets, then the same for the one bucket in which the sum passes the budget, by its next bits and at
last by its hashes. The thresholds are nested: a larger budget takes a superset. No documents are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a hash, and of the first and second histogram.
BITS, FIRST, SECOND = 60, 12, 12
#: Up to so many sources the per-source table is sent to all executors; more are joined by a shuffle.
MOST_BROADCAST = 10_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of an MD5 digest that also DuckDB can compute; documents that share an id differ by their text."""
    seen = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.md5(text.cast("binary")), F.lit("null")))
    return F.conv(F.substring(F.md5(seen.cast("binary")), 1, 15), 16, 10).cast("long")


def per_source(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= MOST_BROADCAST else small


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) -> source, source_size, target, by one pass over the sources.

    The least level at which the targets min(most * size, level * weight) use the whole budget is where sharing the
    excess of full sources by weight ends. Sources are full in order of their cap by weight.
    """
    alone = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*(F.lit(float(w)) for w in weights))
    s = sizes.withColumn("weight", F.element_at(table, ((F.row_number().over(alone) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", share * F.sum("source_size").over(everything))
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    # the level if all sources before this one are full; the first that its level leaves below its cap fixes it
    s = s.withColumn("level", (F.col("budget") - F.col("full")) / F.col("rest"))
    s = s.withColumn("fixed", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("fixed").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("fixed.level") * F.col("weight"))).alias("target"))


def budgets(rows: DataFrame, plan: DataFrame, group: str = "") -> DataFrame:
    """(source, h, size) and (source, source_size, target) -> source, base (whole copies), threshold (of the extra copy).

    The extra copy goes to the hashes up to the one after which the words lie nearest to the target, the fewer at a tie.
    Hashes that several documents share go together.
    """
    n = plan.count()
    plan = plan.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("left", F.col("target") - F.col("base") * F.col("source_size"))
    low = BITS - FIRST - SECOND

    def boundary(hist: DataFrame, key: str, out: str) -> DataFrame:
        """Of each source the first bucket in which the running sum passes what is left, and the sum before it."""
        run = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        upto = hist.withColumn("upto", F.sum("words").over(run)).join(per_source(state.select(F.col("source").alias("s"), "left"), n), F.col("source").eqNullSafe(F.col("s")))
        over = upto.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct(key, (F.col("upto") - F.col("words")).alias("before"), "words")).alias("x"))
        return over.select(F.col("source").alias("s"), F.col(f"x.{key}").alias(out), F.col("x.before").alias("before"), F.col("x.words").alias("words_at"))

    def within(key: str, part: str, of: Column) -> DataFrame:
        """Words by the next key, in each source's boundary bucket."""
        cuts = state.where(F.col(key).isNotNull()).select(F.col("source").alias("s"), F.col(key).alias("cut"), "at")
        found = rows.join(per_source(cuts, n), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", BITS - FIRST if key == "b1" else low) == F.col("cut")))
        hist = found.groupBy("source", of.alias(part)).agg(F.sum("size").alias("words"), F.first("at").alias("at"))
        return hist

    def merged(found: DataFrame) -> DataFrame:
        return state.join(per_source(found, n), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")

    state = plan
    hist = rows.groupBy("source", F.shiftright("h", BITS - FIRST).alias("k")).agg(F.sum("size").alias("words"))
    state = merged(boundary(hist, "k", "b1")).withColumn("at", F.coalesce("before", F.lit(0))).drop("before", "words_at")
    state = common.materialize(state, "mix")
    rest = state
    for key, part, of in (("b1", "b2", F.shiftright("h", low)), ("b2", "b3", F.col("h"))):
        hist = within(key, "k", of)
        run = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        upto = hist.withColumn("upto", F.col("at") + F.sum("words").over(run))
        upto = upto.join(per_source(state.select(F.col("source").alias("s"), "left"), n), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        over = upto.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("k", (F.col("upto") - F.col("words")).alias("before"), "words")).alias("x"))
        over = over.select(F.col("source").alias("s"), F.col("x.k").alias(part), F.col("x.before").alias("before"), F.col("x.words").alias("words_at"))
        state = merged(over).withColumn("at", F.coalesce("before", F.col("at"))).drop("before")
        state = common.materialize(state.drop("words_at") if part == "b2" else state, "mix")
    rest = state
    # all hashes below b3 are taken; b3 too if that lies nearer. No boundary: the whole source fits.
    nearer = (F.col("at") + F.col("words_at") - F.col("left")) < (F.col("left") - F.col("at"))
    threshold = F.when(F.col("b3").isNull(), F.when(F.col("left") > 0, F.lit(1 << BITS)).otherwise(F.lit(-1))).when(nearer, F.col("b3")).otherwise(F.col("b3") - 1)
    return rest.select("source", "source_size", "target", "base", threshold.cast("long").alias("threshold"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, group: str = "") -> DataFrame:
    """``docs`` with the columns size, source_size, target, copies and taken (words, copies counted).

    docs needs doc_id, text and source; its other columns stay. Sources in code-point order, null last, weigh
    ``weights`` in turn; together the targets are ``share`` of all words, and none exceeds ``most`` times its source's
    words. copies is at most ceil(most). The same rows give the same result however they are partitioned. An empty
    table and sources without words take nothing. Columns named like the added ones are replaced.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    given = docs.drop(*added)
    sized = given.withColumn("size", words(F.col("text"))).withColumn("_h", document_hash(F.col("doc_id"), F.col("text")))
    rows = common.materialize(sized.select("source", F.col("_h").alias("h"), "size"), "mix", group)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    cuts = budgets(rows, common.materialize(targets(sizes, weights, share, most), "mix", group))
    n = cuts.count()
    cuts = per_source(cuts.select(F.col("source").alias("_s"), "source_size", "target", "base", "threshold"), n)
    out = sized.join(cuts, F.col("source").eqNullSafe(F.col("_s")))
    out = out.withColumn("copies", F.col("base") + (F.col("_h") <= F.col("threshold")).cast("long"))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*(F.col(f"`{c}`") for c in given.columns), *added)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = common.columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = """
WITH d AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0 * sum(size)::DOUBLE AS cap,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, cap / weight AS ratio, 1.5 * sum(source_size) OVER ()::DOUBLE AS budget,
    coalesce(sum(cap) OVER w, 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest
  FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT min_by((budget - filled) / rest, ratio) AS level FROM r WHERE (budget - filled) / rest <= ratio
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM s, l
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS base FROM t
), c AS (
  SELECT d.*, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS remains,
    sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER (PARTITION BY d.source, h) AS here
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
  (size * (base + CASE WHEN (upto <= remains AND remains > 0)
    OR (upto > remains AND upto - here <= remains AND upto - remains < remains - (upto - here)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
