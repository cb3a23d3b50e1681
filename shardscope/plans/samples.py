"""Queries over samples, splits and first rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardscope.operators import sampling
from shardscope.plans.registry import query
from shardscope.plans.tables import FLOW, flow, rounded, table


def trace(df, by):
    """Size and content of a sample per group, tight enough to tell two samples apart."""
    return rounded(
        df.groupBy(*by).agg(
            F.count("*").alias("n"),
            F.min("row_key").alias("first_key"),
            F.max("row_key").alias("last_key"),
            F.sum("price").alias("price_sum"),
            F.sum("suppkey").alias("supplier_sum"),
        ),
        3,
    )


def trace_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS n, min(row_key) AS first_key, max(row_key) AS last_key, round(sum(price), 3) AS price_sum,
        CAST(sum(suppkey) AS BIGINT) AS supplier_sum FROM {source} GROUP BY {by}"""


def ordered_sql(seed: int = sampling.SEED, by: str = "PARTITION BY label") -> str:
    """Rows numbered in hash order, with class sizes."""
    return f"""numbered AS (
        SELECT *, row_number() OVER ({by} ORDER BY md5('{seed}|' || row_key), row_key) AS place,
               count(*) OVER ({by}) AS size, count(*) OVER () AS total FROM flow),
      classes AS (SELECT label, count(*) AS size FROM flow GROUP BY label)"""


@query(
    "m1_stratified_sample",
    f"""WITH {FLOW}, {ordered_sql()}, taken AS (
          SELECT * FROM numbered WHERE total <= 30000 OR place <= greatest(1000, 30000 // (SELECT count(*) FROM classes)))
        {trace_sql('taken', 'label')}""",
)
def stratified_sample(spark, folder):
    """The cap of the geometry step: 30,000 rows, at least 1,000 per class."""
    return trace(sampling.stratified(flow(spark, folder), "label", ["row_key"], 30_000, 1_000), ["label"])


@query(
    "m1_stratified_small",
    f"""WITH {FLOW}, {ordered_sql()}, taken AS (
          SELECT * FROM numbered WHERE place <= greatest(300, least(12000, total) // (SELECT count(*) FROM classes)))
        {trace_sql('taken', 'label')}""",
)
def stratified_small(spark, folder):
    """The cap of the attribution step: at most 12,000 rows, at least 300 per class."""
    return trace(sampling.stratified(flow(spark, folder), "label", ["row_key"], 12_000, 300, when_larger=False), ["label"])


def quota_sql(label: str) -> str:
    """Test rows per class: rounded-down shares, leftovers to the largest remainders."""
    return f"""sizes AS (SELECT {label} AS stratum, count(*) AS size, sum(count(*)) OVER () AS total FROM flow GROUP BY 1),
      shares AS (
        SELECT stratum, size * ceil(total * 0.2e0) / total AS share, ceil(total * 0.2e0) AS target FROM sizes),
      quotas AS (
        SELECT stratum, floor(share)
               + CASE WHEN row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, stratum) <= target - sum(floor(share)) OVER ()
                      THEN 1 ELSE 0 END AS quota FROM shares)"""


@query(
    "m2_train_test_split",
    f"""WITH {FLOW}, {ordered_sql()}, {quota_sql('label')},
        taken AS (SELECT numbered.*, place <= quota AS is_test FROM numbered JOIN quotas ON stratum = label)
        {trace_sql('taken', 'label, is_test')}""",
)
def train_test_split(spark, folder):
    return trace(sampling.split(flow(spark, folder), "label", ["row_key"]), ["label", "is_test"])


@query(
    "m2_split_without_strata",
    f"""WITH flow AS (
          SELECT CASE WHEN o_orderkey = 0 THEN 'solo' ELSE o_orderstatus END AS label, CAST(o_orderkey AS VARCHAR) AS row_key,
                 o_totalprice / 1e3 AS price, o_custkey AS suppkey FROM orders),
        {ordered_sql(by='')}, {quota_sql('0')},
        taken AS (SELECT numbered.*, place <= quota AS is_test FROM numbered CROSS JOIN quotas)
        {trace_sql('taken', 'label, is_test')}""",
)
def split_without_strata(spark, folder):
    """One class has a single row, so the split cannot be stratified."""
    rows = table(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") == 0, "solo").otherwise(F.col("o_orderstatus")).alias("label"),
        F.col("o_orderkey").cast("string").alias("row_key"),
        (F.col("o_totalprice") / 1e3).alias("price"),
        F.col("o_custkey").alias("suppkey"),
    )
    return trace(sampling.split(rows, "label", ["row_key"]), ["label", "is_test"])


@query(
    "m3_test_set",
    f"""WITH {FLOW}, {ordered_sql()},
        quotas AS (
          SELECT label AS stratum, least(size, 2000 // count(*) OVER ()
                 + CASE WHEN row_number() OVER (ORDER BY size DESC, label) <= 2000 % count(*) OVER () THEN 1 ELSE 0 END) AS quota
          FROM classes),
        taken AS (SELECT numbered.* FROM numbered JOIN quotas ON stratum = label WHERE place <= quota)
        {trace_sql('taken', 'label')}""",
)
def test_set(spark, folder):
    return trace(sampling.test_set(flow(spark, folder), "label", ["row_key"], 2000), ["label"])


@query(
    "m5_background_sample",
    f"""WITH {FLOW}, {ordered_sql(seed=0, by='')},
        taken AS (SELECT *, 'all' AS part FROM numbered WHERE place <= least(100, greatest(1, total // 10)))
        {trace_sql('taken', 'part')}""",
)
def background_sample(spark, folder):
    sample = sampling.background(flow(spark, folder), ["row_key"])
    return trace(sample.withColumn("part", F.lit("all")), ["part"])


@query(
    "m6_plain_sample",
    f"""WITH {FLOW}, {ordered_sql(by='')}, taken AS (SELECT *, 'all' AS part FROM numbered WHERE place <= 8000)
        {trace_sql('taken', 'part')}""",
)
def plain_sample(spark, folder):
    sample = sampling.plain(flow(spark, folder), ["row_key"], 8000)
    return trace(sample.withColumn("part", F.lit("all")), ["part"])


EVENTS = """rows AS (
    SELECT event_type AS class, CASE WHEN event_type = 'view' THEN 'client_' || (user_id % 2 + 2) ELSE 'client_' || (user_id % 3 + 1) END AS client, event_id, value FROM events)"""


def _events(spark, folder):
    """All events; the first client has no view."""
    turn = F.when(F.col("event_type") == "view", F.col("user_id") % 2 + 2).otherwise(F.col("user_id") % 3 + 1)
    return table(spark, folder, "events").select(
        F.col("event_type").alias("class"), F.concat(F.lit("client_"), turn.cast("string")).alias("client"), "event_id", "value"
    )


@query(
    "w5_first_positions",
    f"""WITH {EVENTS}, placed AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY event_id) - 1 AS position FROM rows)
        SELECT class, client, position FROM placed
        QUALIFY row_number() OVER (PARTITION BY class ORDER BY client, event_id) = 1""",
)
def first_positions(spark, folder):
    return sampling.first_positions(_events(spark, folder), "class", ["event_id"], "client")


@query(
    "m4_example_per_class",
    f"""WITH {EVENTS} SELECT class, client, event_id, value FROM rows
        QUALIFY row_number() OVER (PARTITION BY class ORDER BY client, event_id) = 1""",
)
def example_per_class(spark, folder):
    return sampling.first_of_class(_events(spark, folder), "class", F.struct("client", "event_id"))
