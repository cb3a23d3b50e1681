"""Views of the driver tables in the form the operators expect, in Spark and in SQL.

Every view exists twice, as a DataFrame and as a common table expression, and covers its whole
table. Prices are in thousands, which keeps rounded figures comparable between engines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["quantity", "price", "discount", "tax"]
LABELS = ["A", "N", "R"]
VIRTUAL_CLIENTS = {"client_1": ["A", "N"], "client_2": ["A", "R"], "client_3": ["N", "R"]}
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder, for queries that write files."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="shardscope-scratch-")
    return f"{base.rstrip('/')}/shardscope-{uuid.uuid4().hex}"


ROW_KEY = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT))"
)

FLOW = f"""flow AS (
  SELECT l_returnflag AS label, l_quantity AS quantity, l_extendedprice / 1e3 AS price, l_discount AS discount,
         l_tax AS tax, l_linestatus AS status, l_suppkey AS suppkey, {ROW_KEY} AS row_key
  FROM lineitem)"""

GAPS = f"""flow AS (
  SELECT l_returnflag AS label, l_quantity AS quantity, l_extendedprice / 1e3 AS price,
         nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax, l_linestatus AS status,
         l_suppkey AS suppkey, {ROW_KEY} AS row_key
  FROM lineitem)"""

CLIENTS = f"""{FLOW},
clients AS (
  SELECT flow.*, r_name AS client
  FROM flow JOIN supplier ON s_suppkey = suppkey JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey)"""

CLIENT_MAP = """client_map(client, label) AS (
  VALUES ('client_1', 'A'), ('client_1', 'N'), ('client_2', 'A'), ('client_2', 'R'), ('client_3', 'N'), ('client_3', 'R'))"""

ROUND_PREDICTIONS = """predictions AS (
  SELECT r_name AS client, l_returnflag AS truth, CAST(month(l_shipdate) AS INTEGER) AS round,
         CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' WHEN l_quantity < 47 THEN 'R' ELSE 'Z' END AS pred
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey)"""


def flow(spark: SparkSession, folder: str, gaps: bool = False) -> DataFrame:
    rows = table(spark, folder, "lineitem")

    def gap(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(0.0)) if gaps else F.col(c)

    return rows.select(
        F.col("l_returnflag").alias("label"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / 1e3).alias("price"),
        gap("l_discount").alias("discount"),
        gap("l_tax").alias("tax"),
        F.col("l_linestatus").alias("status"),
        F.col("l_suppkey").alias("suppkey"),
        F.expr(ROW_KEY).alias("row_key"),
    )


def regions(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier key and the name of its region."""
    supplier, nation, region = (table(spark, folder, n) for n in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("suppkey"), F.col("r_name").alias("client"))
    )


def clients(spark: SparkSession, folder: str, gaps: bool = False) -> DataFrame:
    """The flow view with the supplier's region as client."""
    return flow(spark, folder, gaps).join(regions(spark, folder), "suppkey")


def guess(quantity: Column) -> Column:
    """A prediction; 'Z' is a class that no class list names."""
    return F.when(quantity < 17, "A").when(quantity < 34, "N").when(quantity < 47, "R").otherwise("Z")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """``client, true, round, pred`` with the ship month as round."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_returnflag").alias("true"),
        F.month("l_shipdate").alias("round"),
        guess(F.col("l_quantity")).alias("pred"),
    )
    return rows.join(regions(spark, folder), "suppkey").select("client", "true", "round", "pred")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column, so that results compare equal whatever the order of summation."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), special.get(f.name, digits)).alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def per_feature(template: str, features: list[str] = FEATURES) -> str:
    """SQL repeated for each feature name ``{c}`` and joined by UNION ALL."""
    return "\nUNION ALL\n".join(template.replace("{c}", c) for c in features)
