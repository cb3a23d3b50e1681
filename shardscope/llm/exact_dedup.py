"""Exact duplicates by a tree merge of sorted digest runs, with DataFrame operations only.

Every text is reduced to its SHA-256, its byte length and a second hash, so that a group is only formed where all three agree.
The rows of a partition are one run. First every task sorts its rows by digest and merges equal ones into one entry that keeps the winning row and
the number of rows, so that a text that a third of all rows share is a handful of entries before anything is shuffled.
Then runs exchange their entries in binomial rounds: in round r the ``fan_in`` runs that differ in the r-th digit of their number deal their entries to
one another by the r-th digit of the digest. What a run receives is sorted by digest and the equal entries of its partners,
now side by side, are merged in a pass over the sorted run. After the last round a run holds all entries of its part of the digests, once each;
no run ever holds more than its share, and there are as many runs as the session has shuffle partitions. The entries are joined back to the rows on
the digest; that join is a plain equi-join whose hot side adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardscope.llm.common import table, written

DIGEST = ["text_sha256", "_llm_bytes", "_llm_check"]


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: identifier, digest columns and a row number that tells repeated rows apart."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"),
        F.sha2(whole, 256).alias("text_sha256"),
        F.octet_length(whole).alias("_llm_bytes"),
        F.xxhash64(whole).alias("_llm_check"),
        F.monotonically_increasing_id().alias("_llm_row"),
    )


def merge_runs(rows: DataFrame, runs: int | None = None, fan_in: int = 4, keep: str = "largest") -> DataFrame:
    """One row per text: digest columns, ``keep`` (struct of identifier and row number) and ``group_size``.

    ``keep`` is the largest or smallest identifier; null is smaller than any identifier. The result depends neither on ``runs`` (raised to a power of
    ``fan_in``; by default at least the session's shuffle partitions) nor on ``fan_in``.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    best = F.max if keep == "largest" else F.min
    wanted = runs or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = 0
    while fan_in**rounds < wanted:
        rounds += 1
    total = fan_in**rounds

    def merged(level: DataFrame) -> DataFrame:
        return level.groupBy("_llm_run", *DIGEST).agg(best("keep").alias("keep"), F.sum("group_size").alias("group_size"))

    def dealt(level: DataFrame, digit: int) -> DataFrame:
        """The run whose ``digit`` is that of the digest, the other digits unchanged."""
        unit = fan_in**digit
        own = F.floor(F.col("_llm_run") / unit) % fan_in
        part = F.floor(F.pmod(F.col("_llm_check"), F.lit(total)) / unit) % fan_in
        return level.withColumn("_llm_run", (F.col("_llm_run") + (part - own) * unit).cast("long"))

    level = rows.select(
        *DIGEST,
        F.pmod(F.shiftright("_llm_row", 33), F.lit(total)).cast("long").alias("_llm_run"),
        F.struct("doc_id", "_llm_row").alias("keep"),
        F.lit(1).cast("long").alias("group_size"),
    )
    # the first round: its partial aggregates are the sorted runs of the partitions, each digest once
    level = merged(dealt(level, 0) if rounds else level)
    for digit in range(1, rounds):
        level = merged(dealt(level, digit).repartition(total, "_llm_run").sortWithinPartitions("_llm_run", *DIGEST))
    return level.drop("_llm_run")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal. Of rows that repeat both identifier and text exactly one is kept. A null identifier is the
    smallest. An empty table gives no rows. Other columns of the input are not read.
    """
    rows = written(digests(docs, key, text), "digests")
    merged = written(merge_runs(rows, keep=keep), "merged")
    same = F.col("keep._llm_row") == F.col("_llm_row")
    return rows.join(merged, DIGEST).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", same.alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """The documents that stay, with the columns they came with."""
    whole = F.coalesce(F.col(text), F.lit(""))
    merged = merge_runs(written(digests(docs, key, text), "digests"), keep=keep)
    stays = merged.select(F.col("keep.doc_id").alias("_llm_id"), F.col("text_sha256").alias("_llm_sha"))
    rows = docs.withColumn("_llm_sha256", F.sha2(whole, 256))
    found = rows.join(stays, (F.col("_llm_sha") == F.col("_llm_sha256")) & F.col(key).eqNullSafe(F.col("_llm_id")), "left_semi")
    # Rows that repeat identifier and text pass together; all but one of them go here. Distinct rows are never compared by text.
    counted = found.groupBy(key, "_llm_sha256").agg(F.count("*").alias("_llm_n")).where("_llm_n > 1")
    twice = F.col(key).eqNullSafe(F.col("_llm_twin")) & (F.col("_llm_sha256") == F.col("_llm_twin_sha"))
    twins = counted.select(F.col(key).alias("_llm_twin"), F.col("_llm_sha256").alias("_llm_twin_sha"))
    once = found.join(twins, twice, "left_anti")
    many = found.join(twins, twice, "left_semi").dropDuplicates([key, "_llm_sha256"])
    return once.unionByName(many).select(*docs.columns)


SQL = """
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d JOIN (
  SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1
) g ON coalesce(d.text, '') = g.t
"""


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))
