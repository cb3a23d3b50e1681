"""Session helpers: building a session, cutting lineage, sizing small results."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SMALL_ROWS = 100_000


def get_session(app: str = "shardscope", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; ``master`` is left to the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for name, value in {**defaults, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share.

    It is the session's ``spark.checkpoint.dir``. Only a local session without that setting gets a
    temporary folder of its own; a cluster without it is an error, because a folder of one machine does not survive the
    loss of that machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="shardscope-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def written(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again, by column and with statistics.

    ``schema`` may read the same columns as richer types, such as a struct as the vector type that it stores.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/shardscope-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_table(df: DataFrame, limit: int = SMALL_ROWS) -> pa.Table | None:
    """A summary's rows on the driver when there are at most ``limit``, else None."""
    table = df.limit(limit + 1).toArrow()
    return table if table.num_rows <= limit else None


def local_if_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Return a summary of at most ``limit`` rows as a local relation, anything larger unchanged.

    For tables known to be short, such as classes x classes, and for written ones; what may be long is settled.

    Spark knows the exact size of a local relation, so a join with it becomes a broadcast join
    exactly when it fits ``spark.sql.autoBroadcastJoinThreshold``. Larger summaries stay
    distributed and are joined by shuffle, with adaptive skew handling.
    """
    table = small_table(df, limit)
    return df if table is None else df.sparkSession.createDataFrame(table, schema=df.schema)


def settle(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Run a summary once, into the shared folder; a short one becomes local."""
    return local_if_small(written(df), limit)
