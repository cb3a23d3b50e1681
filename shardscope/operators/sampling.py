"""Exact-size samples and splits, stratified by class.

Rows are taken in the order of a seeded hash of their key. Counts per class and leading hash digits
tell in which prefix the quota ends; only the rows sharing that prefix are sorted, to find the last
row taken. Nothing else moves, whatever the size of a class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardscope.functions.scalars import hash_order, quoted
from shardscope.session import local_if_small, settle, written

SEED = 42
# Leading hash digits to count by: 65,536 prefixes per class.
DIGITS = 4


def _tagged(df: DataFrame, label: str | None, key: Sequence[str], seed: int) -> DataFrame:
    stratum = quoted(label) if label is not None else F.lit(0)
    return df.withColumn("order_hash", hash_order(key, seed)).withColumn("stratum", stratum).withColumn(
        "prefix", F.substring("order_hash", 1, DIGITS)
    )


def _histogram(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows per class and prefix, and ``stratum, size`` per class."""
    histogram = settle(tagged.groupBy("stratum", "prefix").agg(F.count("*").alias("n")))
    return histogram, local_if_small(histogram.groupBy("stratum").agg(F.sum("n").alias("size")))


def _ends(histogram: DataFrame, quotas: DataFrame) -> DataFrame:
    """``end_stratum, end_prefix, needed``: the prefix in which the quota of a class ends, and its place there."""
    quota = quotas.select(F.col("stratum").alias("quota_stratum"), F.col("quota").cast("bigint").alias("quota"))
    upto = F.sum("n").over(Window.partitionBy("stratum").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))
    running = histogram.withColumn("upto", upto).join(quota, F.col("stratum").eqNullSafe(F.col("quota_stratum")))
    return local_if_small(
        running.filter((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota"))).select(
            F.col("stratum").alias("end_stratum"),
            F.col("prefix").alias("end_prefix"),
            (F.col("quota") - (F.col("upto") - F.col("n"))).alias("needed"),
        )
    )


def _last(tagged: DataFrame, key: Sequence[str], ends: DataFrame) -> DataFrame:
    """``cut_stratum, cut_hash, cut_key``: the last row, in hash order, that each class gives."""
    same = F.col("stratum").eqNullSafe(F.col("end_stratum")) & (F.col("prefix") == F.col("end_prefix"))
    # Equal keys collapse first, so the window holds the distinct keys of one prefix per class.
    edge = (
        tagged.join(ends, same)
        .groupBy("stratum", "needed", F.struct("order_hash", *[quoted(k) for k in key]).alias("cut"))
        .agg(F.count("*").alias("n"))
    )
    place = F.sum("n").over(Window.partitionBy("stratum").orderBy("cut").rowsBetween(Window.unboundedPreceding, 0))
    last = edge.withColumn("upto", place).filter((F.col("upto") >= F.col("needed")) & (F.col("upto") - F.col("n") < F.col("needed")))
    repeated = F.raise_error(F.lit("the key given does not identify a row")).cast("boolean")
    return local_if_small(
        last.filter(F.when(F.col("upto") > F.col("needed"), repeated).otherwise(F.lit(True))).select(
            F.col("stratum").alias("cut_stratum"), "cut"
        )
    )


def _cutoffs(tagged: DataFrame, key: Sequence[str], quotas) -> DataFrame:
    """The last row of each class for the quotas that ``quotas`` makes of the class sizes."""
    histogram, sizes = _histogram(tagged)
    return _last(tagged, key, _ends(histogram, quotas(sizes)))


def _split_at_quota(df: DataFrame, label: str | None, key: Sequence[str], seed: int, quotas) -> DataFrame:
    """Add ``taken``: whether the row is among the first ``quota`` of its class in hash order.

    The result only compares each row with the cutoff of its class, so it can be read any number of
    times without a shuffle.
    """
    tagged = _tagged(df, label, key, seed)
    cuts = _cutoffs(tagged, key, quotas)
    own = F.struct("order_hash", *[quoted(k) for k in key])
    if label is None:
        # One cutoff for the whole table: a literal instead of a join.
        only = cuts.first()
        limit = F.lit(False) if only is None else own <= F.struct(*[F.lit(v).cast(f.dataType) for v, f in zip(only.cut, cuts.schema["cut"].dataType)])
        return tagged.select(*[quoted(c) for c in df.columns], limit.alias("taken"))
    joined = tagged.join(cuts, tagged["stratum"].eqNullSafe(cuts["cut_stratum"]), "left")
    taken = F.coalesce(own <= F.col("cut"), F.lit(False))
    return joined.select(*[quoted(c) for c in df.columns], taken.alias("taken"))


def stratified(
    df: DataFrame, label: str, key: Sequence[str], total: int, floor: int = 0, seed: int = SEED, when_larger: bool = True
) -> DataFrame:
    """At most max(floor, total / classes) rows of each class.

    Rows without a label belong to no class and are never taken. With ``when_larger`` a table of at
    most ``total`` rows gives all its labelled rows; without it ``total`` is first lowered to the
    number of rows.
    """
    size = df.count()
    if when_larger and size <= total:
        return df.filter(quoted(label).isNotNull())
    budget = total if when_larger else min(size, total)

    def quotas(sizes: DataFrame) -> DataFrame:
        classes = sizes.filter("stratum is not null").count() or 1
        return sizes.withColumn("quota", F.least("size", F.lit(max(floor, budget // classes))))

    rows = df.filter(quoted(label).isNotNull())
    return _split_at_quota(rows, label, key, seed, quotas).filter("taken").drop("taken")


def plain(df: DataFrame, key: Sequence[str], n: int, seed: int = SEED) -> DataFrame:
    """min(n, rows) rows without replacement."""

    def quotas(sizes: DataFrame) -> DataFrame:
        return sizes.withColumn("quota", F.least("size", F.lit(n)))

    return _split_at_quota(df, None, key, seed, quotas).filter("taken").drop("taken")


def background(df: DataFrame, key: Sequence[str], size: int = 100, seed: int = 0) -> DataFrame:
    """min(size, max(1, rows / 10)) rows without replacement."""
    return plain(df, key, min(size, max(1, df.count() // 10)), seed)


def split(df: DataFrame, label: str, key: Sequence[str], test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """Add ``is_test`` for ``test_size`` of the rows, stratified by class.

    The test set has ceil(rows * test_size) rows; each class gives its rounded-down share and the
    classes with the largest remainders one more. A table in which some class has a single row is
    split without strata.
    """
    classes = df.groupBy(quoted(label).alias("stratum")).agg(F.count("*").alias("size"))
    found = classes.agg(F.min("size").alias("smallest"), F.sum("size").alias("rows")).first()
    stratify = (found.smallest or 0) >= 2

    parted = _split_at_quota(df, label if stratify else None, key, seed, lambda sizes: _test_quotas(sizes, test_size))
    return parted.withColumnRenamed("taken", "is_test")


def _test_quotas(sizes: DataFrame, test_size: float) -> DataFrame:
    total = sizes.agg(F.sum("size")).first()[0] or 0
    target = -int(-(total * test_size) // 1)
    share = F.col("size") * F.lit(target) / F.lit(total or 1)
    base = sizes.withColumn("base", F.floor(share)).withColumn("rest", F.round(share - F.floor(share), 9))
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("rest"), "stratum"))
    left = F.lit(target) - F.sum("base").over(Window.partitionBy())
    return base.withColumn("quota", F.col("base") + (place <= left).cast("int"))


def fitting_and_test(
    df: DataFrame, label: str, key: Sequence[str], test_size: float, total: int | None = None, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """The training rows of ``split``, and the test rows; unlabelled rows are in neither. With ``total``, those that ``stratified`` draws (without a floor).

    One histogram locates the ends. Rows are written with their side, and the last row of a class is found among those that share its prefix: two
    scans of the table. In the hash order of a class the test rows come first and the drawn ones next. Without strata the drawn rows of a class
    do not follow its test rows, and split and draw go one after the other.
    """
    rows = df.filter(quoted(label).isNotNull())
    tagged = _tagged(rows, label, key, seed)
    histogram, sizes = _histogram(tagged)
    names = [quoted(c) for c in df.columns]
    if (sizes.agg(F.min("size")).first()[0] or 0) < 2:
        whole = written(split(rows, label, key, test_size, seed))
        fitting, tested = whole.filter(~F.col("is_test")).drop("is_test"), whole.filter("is_test").drop("is_test")
        return (fitting if total is None else written(stratified(fitting, label, key, total, 0, seed))), tested
    test = local_if_small(_test_quotas(sizes, test_size).select("stratum", "size", "quota"))
    own = F.struct("order_hash", *[quoted(k) for k in key])
    if total is None:
        end = _ends(histogram, test)
        # only rows of the prefix in which the test rows end keep their hash
        sided = tagged.join(end.drop("needed"), F.col("stratum").eqNullSafe(F.col("end_stratum")), "left").select(
            F.struct(*names).alias("row"),
            F.coalesce(F.col("prefix") < F.col("end_prefix"), F.lit(False)).alias("before_end"),
            F.when(F.col("prefix") == F.col("end_prefix"), F.col("order_hash")).alias("end_hash"),
        )
        near = written(sided)
        edge = near.filter("end_hash is not null").select(
            "row.*", F.col("row")[label].alias("stratum"), F.col("end_hash").alias("order_hash"), F.substring("end_hash", 1, DIGITS).alias("prefix")
        )
        last = _last(edge, key, end)
        placed = near.join(last, F.col("row")[label].eqNullSafe(F.col("cut_stratum")), "left")
        reached = F.struct(F.col("end_hash").alias("order_hash"), *[F.col("row")[k].alias(k) for k in key]) <= F.col("cut")
        is_test = F.when(F.col("end_hash").isNull(), F.col("before_end")).otherwise(F.coalesce(reached, F.lit(False)))
        return placed.filter(~is_test).select("row.*"), placed.filter(is_test).select("row.*")
    rest = F.col("size") - F.col("quota")
    found = test.agg(F.sum(rest).alias("rows"), F.count(F.when(rest > 0, F.lit(1))).alias("classes")).first()
    drawn = rest if found.rows <= total else F.least(rest, F.lit(total // found.classes))
    ends = [_ends(histogram, test), _ends(histogram, test.withColumn("quota", F.col("quota") + drawn))]
    reach = ends[1].select(F.col("end_stratum").alias("reach_stratum"), F.col("end_prefix").alias("reach"))
    within = F.col("stratum").eqNullSafe(F.col("reach_stratum")) & (F.col("prefix") <= F.col("reach"))
    near = written(tagged.join(reach, within).drop("reach_stratum", "reach"))
    first, second = (
        _last(near, key, e).select(F.col("cut_stratum").alias(f"cut_stratum_{i}"), F.col("cut").alias(f"cut_{i}")) for i, e in enumerate(ends)
    )
    placed = near.join(first, F.col("stratum").eqNullSafe(F.col("cut_stratum_0")), "left")
    is_test = F.coalesce(own <= F.col("cut_0"), F.lit(False))
    reached = placed.filter(~is_test).join(second, F.col("stratum").eqNullSafe(F.col("cut_stratum_1"))).filter(own <= F.col("cut_1"))
    return written(reached.select(*names)), placed.filter(is_test).select(*names)


def test_set(df: DataFrame, label: str, key: Sequence[str], total: int = 2000, seed: int = SEED) -> DataFrame:
    """``total`` rows: the same number of each class, the remainder from the largest classes.

    Equally large classes are ordered by name; a class cannot give more rows than it has.
    """

    def quotas(sizes: DataFrame) -> DataFrame:
        classes = sizes.count() or 1
        place = F.row_number().over(Window.partitionBy().orderBy(F.desc("size"), "stratum"))
        wanted = F.lit(total // classes) + (place <= F.lit(total % classes)).cast("int")
        return sizes.withColumn("quota", F.least("size", wanted))

    rows = df.filter(quoted(label).isNotNull())
    return _split_at_quota(rows, label, key, seed, quotas).filter("taken").drop("taken")


def first_of_class(df: DataFrame, label: str, order: Column) -> DataFrame:
    """One whole row per class: the first in the given order. Partial minima, no window."""
    rows = df.groupBy(quoted(label).alias("class")).agg(F.min_by(F.struct(*[quoted(c) for c in df.columns]), order).alias("first_row"))
    return rows.select("first_row.*")


def first_positions(df: DataFrame, label: str, key: Sequence[str], client: str) -> DataFrame:
    """``class, client, position``: 0-based position of the first row of each class in its client.

    Rows of a client are ordered by ``key``; the client is the first one, by name, with the class.
    The position is the number of rows of that client with a smaller key.
    """
    order = F.struct(*[quoted(k) for k in key])
    heads = df.groupBy(quoted(label).alias("class"), quoted(client).alias("client")).agg(F.min(order).alias("head"))
    chosen = local_if_small(
        heads.groupBy("class").agg(F.min(F.struct("client", "head")).alias("pick")).select("class", "pick.client", "pick.head")
    ).withColumnRenamed("client", "head_client")
    smaller = F.count(F.when(order < F.col("head"), F.lit(1)))
    return (
        df.select(quoted(client).alias("row_client"), *[quoted(k) for k in key if k != client])
        .join(chosen, F.col("row_client") == F.col("head_client"))
        .groupBy("class", F.col("head_client").alias("client"))
        .agg(smaller.alias("position"))
    )
