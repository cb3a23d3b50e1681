"""Per-client training in rounds: local steps, server updates, evaluation.

The model is softmax regression. Its parameters live in tables of a few numbers per client; the
rows are only ever read by one grouped sum per step, whose partial sums form before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardscope.functions.scalars import clip, quoted
from shardscope.operators.evaluate import averaged_f1, central, confusion, macro, rounds
from shardscope.operators.scoring import Linear, linear_scorer, score, with_softmax
from shardscope.session import local_if_small, settle

# Decay rates, floor and step of the adaptive server update.
BETA_1 = 0.9
BETA_2 = 0.99
TAU = 1e-9
SERVER_STEP = 0.01
# Local and server step and bound of the control-variate update.
CONTROL_LOCAL_STEP = 0.01
CONTROL_SERVER_STEP = 0.5
CONTROL_BOUND = 1.0


@dataclass(frozen=True)
class Shape:
    """Feature and class names of a softmax regression.

    Parameters are one array: weights class by class, then one intercept per class.
    """

    features: Sequence[str]
    classes: Sequence[str]

    @property
    def weights(self) -> int:
        return len(self.features) * len(self.classes)

    @property
    def size(self) -> int:
        return self.weights + len(self.classes)

    def outputs(self, theta: Column) -> list[Column]:
        width = len(self.features)
        result = []
        for k in range(len(self.classes)):
            total = F.get(theta, F.lit(self.weights + k))
            for j, c in enumerate(self.features):
                total = total + F.get(theta, F.lit(k * width + j)) * quoted(c)
            result.append(total)
        return result

    def linear(self, theta: Sequence[float]) -> Linear:
        width = len(self.features)
        rows = [theta[k * width : (k + 1) * width] for k in range(len(self.classes))]
        return Linear(rows, theta[self.weights :])


def start(spark: SparkSession, clients: DataFrame, shape: Shape, theta: Sequence[float] | None = None) -> DataFrame:
    """``client, theta, shift``: the same parameters for every client, no gradient shift."""
    zeros = F.array_repeat(F.lit(0.0), shape.size)
    first = F.array(*[F.lit(float(v)) for v in theta]) if theta is not None else zeros
    return local_if_small(clients.select("client").distinct()).select("client", first.alias("theta"), zeros.alias("shift"))


def local_steps(df: DataFrame, shape: Shape, state: DataFrame, step: float, steps: int = 1) -> DataFrame:
    """Weighted gradient steps of every client on its own rows: ``client, theta, shift, n, loss``.

    ``df`` has ``client, label, weight`` and the features. The loss is the mean weighted
    cross-entropy before the last step; ``shift`` is added to the gradient. A label outside the
    shape's classes fails the job.
    """
    for _ in range(steps):
        state = settle(_one_step(df, shape, state, step))
    return state


def _one_step(df: DataFrame, shape: Shape, state: DataFrame, step: float) -> DataFrame:
    held = state.select("client", "theta", "shift")
    rows = df.select("client", "label", "weight", *[quoted(c).cast("double").alias(c) for c in shape.features])
    joined = rows.join(held.select("client", "theta"), "client")
    raw = [f"output{k}" for k in range(len(shape.classes))]
    named = joined.withColumns(dict(zip(raw, shape.outputs(F.col("theta")))))
    shares = with_softmax(named, [F.col(r) for r in raw], "shares")
    own = [F.when(F.col("label") == c, 1.0).otherwise(0.0) for c in shape.classes]
    errors = shares.select(
        "client",
        *[quoted(c) for c in shape.features],
        *[(F.col("weight") * (F.get("shares", F.lit(k)) - y)).alias(f"error{k}") for k, y in enumerate(own)],
        (F.col("weight") * _cross_entropy(shape, raw)).alias("loss"),
    )
    sums = [F.sum(F.col(f"error{k}") * quoted(c)) for k in range(len(shape.classes)) for c in shape.features]
    sums += [F.sum(f"error{k}") for k in range(len(shape.classes))]
    gradients = errors.groupBy("client").agg(F.array(*sums).alias("gradient"), F.count("*").alias("n"), F.avg("loss").alias("loss"))
    moved = F.zip_with(
        F.col("theta"),
        F.zip_with(F.col("gradient"), F.col("shift"), lambda g, s: g / F.col("n") + s),
        lambda x, g: x - F.lit(step) * g,
    )
    return held.join(gradients, "client").select("client", moved.alias("theta"), "shift", "n", "loss")


def _cross_entropy(shape: Shape, raw: Sequence[str]) -> Column:
    """Loss of a row from its outputs, so that a share of 0 gives a large loss and not a missing one."""
    top = F.greatest(*raw) if len(raw) > 1 else F.col(raw[0])
    total = top + F.log(sum((F.exp(F.col(r) - top) for r in raw), F.lit(0.0)))
    name = F.coalesce(F.col("label").cast("string"), F.lit("NULL"))
    chosen = F.raise_error(F.concat(F.lit("unknown label: "), name)).cast("double")
    for r, c in zip(raw, shape.classes):
        chosen = F.when(F.col("label") == c, F.col(r)).otherwise(chosen)
    return total - chosen


def to_long(state: DataFrame, shape: Shape, value: str = "value") -> DataFrame:
    """Parameters as rows: ``client, layer, idx, <value>`` and, when known, ``n``."""
    extra = [c for c in ("n",) if c in state.columns]
    rows = state.select("client", *extra, F.posexplode("theta").alias("place", value))
    weight = F.col("place") < shape.weights
    return rows.select(
        "client",
        F.when(weight, "coef").otherwise("intercept").alias("layer"),
        F.when(weight, F.col("place")).otherwise(F.col("place") - shape.weights).alias("idx"),
        value,
        *extra,
    )


def server_step(
    updates: DataFrame,
    state: DataFrame,
    beta_1: float = BETA_1,
    beta_2: float = BETA_2,
    tau: float = TAU,
    eta: float = SERVER_STEP,
) -> DataFrame:
    """Adaptive server update: ``layer, idx, x, m, v``.

    ``updates`` is ``client, layer, idx, value, n`` and ``state`` is ``layer, idx, x, m, v``. The
    row-weighted mean of the clients is compared with x; m and v follow the difference and its
    square.
    """
    means = updates.groupBy("layer", "idx").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    moved = (
        state.join(means, ["layer", "idx"])
        .withColumn("gap", F.col("mean") - F.col("x"))
        .withColumn("m", F.lit(beta_1) * F.col("m") + F.lit(1 - beta_1) * F.col("gap"))
        .withColumn("v", F.lit(beta_2) * F.col("v") + F.lit(1 - beta_2) * F.col("gap") * F.col("gap"))
    )
    x = F.col("x") + F.lit(eta) * F.col("m") / (F.sqrt("v") + F.lit(tau))
    return moved.select("layer", "idx", x.alias("x"), "m", "v")


def control_clients(updates: DataFrame, state: DataFrame, steps: int, step: float = CONTROL_LOCAL_STEP) -> DataFrame:
    """New client control variates: ``client, layer, idx, y, c_old, c_new``.

    ``updates`` is ``client, layer, idx, y, c_i``; ``state`` is ``layer, idx, x, c``.
    """
    joined = updates.join(state, ["layer", "idx"])
    c_new = F.col("c_i") - F.col("c") + (F.col("x") - F.col("y")) / F.lit(float(steps) * step)
    return joined.select("client", "layer", "idx", "y", F.col("c_i").alias("c_old"), c_new.alias("c_new"))


def control_step(
    updates: DataFrame,
    state: DataFrame,
    steps: int,
    step: float = CONTROL_LOCAL_STEP,
    server: float = CONTROL_SERVER_STEP,
    bound: float = CONTROL_BOUND,
) -> DataFrame:
    """Server side of the control-variate round: ``layer, idx, x, c``, with c clipped."""
    clients = control_clients(updates, state, steps, step)
    sums = clients.groupBy("layer", "idx").agg(
        F.avg("y").alias("mean_y"), F.avg(F.col("c_new") - F.col("c_old")).alias("mean_change")
    )
    return state.join(sums, ["layer", "idx"]).select(
        "layer",
        "idx",
        (F.col("x") + F.lit(server) * (F.col("mean_y") - F.col("x"))).alias("x"),
        clip(F.col("c") + F.col("mean_change"), -bound, bound).alias("c"),
    )


def evaluate_clients(df: DataFrame, shape: Shape, theta: Sequence[float], by: Sequence[str] = ("client",)) -> DataFrame:
    """Macro metrics of one model on the test rows of every client."""
    return macro(confusion(predict(df, shape, theta, by), shape.classes, by), by)


def test_loss(df: DataFrame, shape: Shape, theta: Sequence[float]) -> float | None:
    """Mean cross-entropy of one model over labelled rows; None without rows."""
    state = F.array(*[F.lit(float(v)) for v in theta])
    raw = [f"output{k}" for k in range(len(shape.classes))]
    rows = df.select("label", *[quoted(c).cast("double").alias(c) for c in shape.features])
    return rows.withColumns(dict(zip(raw, shape.outputs(state)))).agg(F.avg(_cross_entropy(shape, raw))).first()[0]


def predict(df: DataFrame, shape: Shape, theta: Sequence[float], keep: Sequence[str]) -> DataFrame:
    """``keep..., true, pred`` with class names."""
    scored = score(df, linear_scorer(shape.linear(theta), probabilities=False), shape.features, keep, "label")
    names = F.array(*[F.lit(c) for c in shape.classes])
    return scored.select(*keep, "true", F.get(names, F.col("pred")).alias("pred"))


def _as_list(state: DataFrame, shape: Shape, value: str = "x") -> list[float]:
    """The global parameters on the driver: one number per parameter of the model."""
    theta = [0.0] * shape.size
    for r in state.select("layer", "idx", value).collect():
        theta[r.idx + (0 if r.layer == "coef" else shape.weights)] = r[value]
    return theta


def run_rounds(
    train: DataFrame,
    test: DataFrame,
    shape: Shape,
    count: int,
    method: str = "adaptive",
    step: float = 0.1,
    local: int = 1,
    held_out: DataFrame | None = None,
    sink: str | None = None,
) -> DataFrame:
    """Train for ``count`` rounds and return the history, one row per round.

    Every round reads ``train`` and ``test`` again, so pass written or materialised tables.
    ``method`` is ``adaptive`` or ``control``. ``held_out`` is a shared table evaluated every round
    (``central_*`` columns, with weighted F1 and mean loss). With ``sink``, every round is appended there as soon as it is done, so
    a lost driver loses no history.
    """
    spark = train.sparkSession
    clients = local_if_small(train.select("client").distinct())
    theta = [0.0] * shape.size
    extra = ["m", "v"] if method == "adaptive" else ["c"]
    layers = [("coef", i) for i in range(shape.weights)] + [("intercept", i) for i in range(len(shape.classes))]
    schema = "layer string, idx int, x double, " + ", ".join(f"{c} double" for c in extra)
    state = spark.createDataFrame([(layer, i, 0.0, *[0.0] * len(extra)) for layer, i in layers], schema)
    controls: DataFrame | None = None
    history: DataFrame | None = None
    for number in range(1, count + 1):
        begin = start(spark, clients, shape, theta)
        if controls is not None:
            begin = begin.drop("shift").join(controls, "client")
        after = local_steps(train, shape, begin, step, local)
        loss = after.agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss")).first().loss
        if method == "adaptive":
            state = settle(server_step(to_long(after, shape), state))
        else:
            old = clients.select("client", F.array_repeat(F.lit(0.0), shape.size).alias("theta")) if number == 1 else c_old
            updates = to_long(after, shape, "y").drop("n").join(to_long(old, shape, "c_i"), ["client", "layer", "idx"])
            new = control_clients(updates, state, local, step)
            state = settle(control_step(updates, state, local, step))
            c_old, controls = _next_controls(new, state, shape)
        theta = _as_list(state, shape)
        row = rounds(evaluate_clients(test, shape, theta).withColumn("round", F.lit(number)))
        if held_out is not None:
            said = predict(held_out.withColumn("round", F.lit(number)), shape, theta, ["round"])
            weighted = averaged_f1(confusion(said, shape.classes, ["round"]), ["round"])
            weighted = weighted.select("round", F.col("weighted_f1").alias("central_weighted_f1"))
            shared = central(said, shape.classes, ["round"]).join(weighted, "round")
            row = row.join(shared, "round").withColumn("central_loss", F.lit(test_loss(held_out, shape, theta)))
        row = settle(row.withColumn("loss", F.lit(loss)))
        if sink is not None:
            row.write.mode("append").parquet(sink)
        history = row if history is None else history.unionByName(row)
    return history


def _next_controls(new: DataFrame, state: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """Client variates as arrays, and the gradient shift (c - c_i) of the next round."""
    place = F.col("idx") + F.when(F.col("layer") == "coef", 0).otherwise(shape.weights)

    def arrays(rows: DataFrame, value: Column, name: str) -> DataFrame:
        entries = F.array_sort(F.collect_list(F.struct(place.alias("place"), value.alias("value"))))
        return rows.groupBy("client").agg(F.transform(entries, lambda e: e["value"]).alias(name))

    joined = new.join(state.select("layer", "idx", "c"), ["layer", "idx"])
    return (
        settle(arrays(new, F.col("c_new"), "theta")),
        settle(arrays(joined, F.col("c") - F.col("c_new"), "shift")),
    )
