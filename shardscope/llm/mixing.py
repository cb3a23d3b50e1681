"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame operations only.

Every document gets the exponential key -ln(u) / w, with u from a hash of its identifier and w its quality weight. A source
whose target holds whole epochs takes all its documents that often; the rest of the target goes to the documents of the smallest
keys. No source is sorted as a whole: keys fall into ``BUCKETS`` ranges, sums per (source, range) locate the range in which the
budget ends, and only that range is sorted. So a source with a third of all rows is spread over all ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardscope.llm.common import WORD, table, written

BUCKETS = 4096
SEED = "mix-1"
#: Weights of the sources by code point order, repeated; and the mix's size as a share of all words.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per distinct (identifier, source, size, quality): number of rows, words, exponential key and its range.

    The quality weight runs from 1/4 to 1 with the share of distinct words, so that repetitive texts come late. Rows that repeat
    an identifier within a source and size share one decision.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), 0)
    counted = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words.alias("words")).select(
        "doc_id", "source", F.size("words").cast("long").alias("size"), F.size(F.array_distinct("words")).cast("long").alias("kinds")
    )
    rows = counted.groupBy("doc_id", "source", "size", "kinds").agg(F.count("*").alias("n_rows"))
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    uniform = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    weight = 0.25 + 0.75 * F.col("kinds") / F.greatest(F.col("size"), F.lit(1))
    keyed = rows.withColumn("sort_key", -F.log(uniform) / weight)
    place = F.least(F.floor((1 - F.exp(-F.col("sort_key"))) * BUCKETS), F.lit(BUCKETS - 1))
    return keyed.withColumn("bucket", place.cast("int"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target. ``sizes`` has one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn. A target stops at ``epochs`` times its source's size; the excess
    goes to the others by weight until none is above. In the order of size per weight, a source is capped exactly when its part
    of what is left exceeds its cap, so the repeated sharing is one running sum over the list of sources.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighted = sizes.select("source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).alias("w"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everything) - epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    part, cap = F.col("w") * F.col("left") / F.col("rest"), epochs * F.col("source_size").cast("double")
    flagged = weighted.withColumns({"left": left, "rest": rest}).withColumn("capped", part > cap)
    # the first source that is not capped sets the level of all after it
    level = F.first(F.when(~F.col("capped"), F.struct("left", "rest")), ignorenulls=True).over(everything)
    shared = F.col("w") * F.col("level.left") / F.col("level.rest")
    return flagged.withColumn("level", level).select(
        "source", "source_size", F.when(F.col("capped"), cap).otherwise(shared).alias("target")
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **shares) -> DataFrame:
    """Per distinct (doc_id, source, size, kinds): n_rows, source_size, target, copies (how often each row is taken).

    Null texts have size 0, a null source is a source of its own, an empty table gives no rows. Equal keys are ordered by identifier.
    """
    rows = written(sized(docs, key, text, source), "sized")
    total = F.sum(F.col("size") * F.col("n_rows"))
    by_source = targets(rows.groupBy("source").agg(total.alias("source_size")), **shares)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.col("target") - F.col("whole") * F.col("source_size")
    by_source = by_source.withColumn("whole", whole).withColumn("budget", budget)
    ranges = rows.groupBy("source", "bucket").agg(total.alias("words"))
    ranges = ranges.join(by_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    end = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranges = ranges.withColumn("end", end).withColumn("begin", F.col("end") - F.col("words"))
    # a source whose target is whole epochs has no budget left, not even for texts without words
    inside = F.when(F.col("budget") <= 0, 0).when(F.col("end") <= F.col("budget"), 1).when(F.col("begin") >= F.col("budget"), 0)
    ranges = ranges.withColumn("inside", inside)
    ranges = written(ranges, "ranges").withColumnsRenamed({"source": "_s", "bucket": "_b"})
    placed = rows.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    # only the range in which the budget ends is put in order; a row is taken when its middle lies within the budget
    held = F.col("size") * F.col("n_rows")
    order = Window.partitionBy("source", "bucket").orderBy("sort_key", F.col("doc_id").asc_nulls_first(), "size", "kinds")
    upto = F.sum(held).over(order.rowsBetween(Window.unboundedPreceding, 0))
    cut = placed.where("inside IS NULL").withColumn("upto", upto)
    cut = cut.withColumn("inside", F.when(F.col("begin") + F.col("upto") - held / 2 <= F.col("budget"), 1).otherwise(0)).drop("upto")
    both = placed.where("inside IS NOT NULL").unionByName(cut)
    return both.select("doc_id", "source", "size", "kinds", "n_rows", "source_size", "target", (F.col("whole") + F.col("inside")).alias("copies"))


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns it came with, whatever their names.

    Documents without words are taken in the whole epochs of their source, and in the fractional one when their key is before its end. A null
    identifier or source is one like any other; an empty table gives no rows.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), 0)
    chosen = mix(docs, key, text, source).where("copies > 0").select(
        F.col("doc_id").alias("id_taken"), F.col("source").alias("source_taken"), F.col("size").alias("size_taken"),
        F.col("kinds").alias("kinds_taken"), F.col("copies").cast("int").alias("copies"),
    )
    # the caller's columns travel as one struct, so their names meet none of these
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), words.alias("words"))
    rows = rows.select("row", F.size("words").alias("size"), F.size(F.array_distinct("words")).alias("kinds"))
    same = F.col("row")[key].eqNullSafe(F.col("id_taken")) & F.col("row")[source].eqNullSafe(F.col("source_taken"))
    same = same & (F.col("size") == F.col("size_taken")) & (F.col("kinds") == F.col("kinds_taken"))
    repeated = rows.join(chosen, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select("row.*")


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, size, source_size, target of its source, words taken (repeats counted)."""
    mixed = mix(table(spark, folder, "documents"))
    rows = mixed.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH w AS (
  SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), d AS (
  SELECT doc_id, source, len(ws)::BIGINT AS size,
    -ln((('0x' || substr(md5('mix-1:' || doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
      / (0.25 + 0.75 * len(list_distinct(ws))::DOUBLE / greatest(len(ws), 1)) AS k
  FROM w
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS wt
  FROM d GROUP BY source
), f AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS lft,
    (sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY source_size::DOUBLE / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rst
  FROM s
), c AS (
  SELECT *, wt * lft / rst > 2.0::DOUBLE * source_size AS capped FROM f
), lv AS (
  SELECT lft, rst FROM c WHERE NOT capped ORDER BY source_size::DOUBLE / wt, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN 2.0::DOUBLE * source_size ELSE wt * (SELECT lft FROM lv) / (SELECT rst FROM lv) END AS target FROM c
), e AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
)
SELECT d.doc_id, d.size, e.source_size, e.target,
  (d.size * (e.whole + CASE WHEN sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - d.size / 2.0::DOUBLE <= e.target - e.whole * e.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
