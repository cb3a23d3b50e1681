"""Queries over scoring, training updates, attribution and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardscope.functions.labels import MODEL_CLASSES, PFCP_CLASSES
from shardscope.operators import clients as client_ops
from shardscope.operators.clean import impute_median
from shardscope.operators import evaluate, explain, forest, sampling, scoring, training, trees
from shardscope.plans.evaluation import LISTED, MACRO_SQL, class_sql, matrix_sql
from shardscope.plans.registry import query
from shardscope.plans.samples import ordered_sql, quota_sql
from shardscope.session import local_if_small, materialise, written
from shardscope.plans.tables import CLIENTS, FEATURES, FLOW, LABELS, clients, flow, rounded, table

# Features brought to about the unit range, as a scaled model table has them.
UNIT = {"quantity": "quantity / 50e0", "price": "price / 1e2", "discount": "discount * 1e1", "tax": "tax * 1e1"}
UNIT_SQL = "unit AS (SELECT row_key, label, {extra} " + ", ".join(f"{e} AS {c}" for c, e in UNIT.items()) + " FROM {source})"


def unit(df, *keep):
    return df.select(*keep, "label", *[F.expr(e).alias(c) for c, e in UNIT.items()])


# A small linear model over the unit features: one row of weights and one intercept per class.
COEF = [[1.5, -0.5, 0.25, 0.0], [-1.0, 0.75, 0.5, -0.25], [0.25, 0.5, -1.25, 1.0]]
INTERCEPT = [0.1, -0.2, 0.05]
MODEL = scoring.Linear(COEF, INTERCEPT)


def outputs_sql(values: dict[str, str], coef=COEF, intercept=INTERCEPT) -> list[str]:
    return [
        "(" + " + ".join([f"{b}e0", *[f"{w}e0 * {v}" for w, v in zip(row, values.values())]]) + ")"
        for row, b in zip(coef, intercept)
    ]


def probability_sql(outputs: list[str]) -> list[str]:
    top = f"greatest({', '.join(outputs)})"
    powers = [f"exp({o} - {top})" for o in outputs]
    return [f"{p} / ({' + '.join(powers)})" for p in powers]


PROBS = ", ".join(f"{p} AS p_{i}" for i, p in enumerate(probability_sql(outputs_sql({c: c for c in FEATURES}))))
SCORED = f"""{FLOW}, {UNIT_SQL.format(extra='', source='flow')},
  shares AS (SELECT *, {PROBS} FROM unit),
  scored AS (SELECT *, CAST(list_position([p_0, p_1, p_2], greatest(p_0, p_1, p_2)) - 1 AS INTEGER) AS pred FROM shares)"""


@query(
    "l4_batch_scoring",
    f"""WITH {SCORED} SELECT pred, label AS "true", count(*) AS n, {', '.join(f'round(avg(p_{i}), 8) AS p_{i}' for i in range(3))}
        FROM scored GROUP BY 1, 2""",
)
def batch_scoring(spark, folder):
    scored = scoring.score(unit(flow(spark, folder), "row_key"), scoring.linear_scorer(MODEL), FEATURES, ["row_key"], "label")
    wide = scoring.wide_probabilities(scored, 3)
    return rounded(wide.groupBy("pred", "true").agg(F.count("*").alias("n"), *[F.avg(f"p_{i}").alias(f"p_{i}") for i in range(3)]), 8)


def _occlusion_sql() -> str:
    means = ", ".join(f"avg({c}) AS {c}_mean" for c in FEATURES)
    parts = []
    for c in FEATURES:
        values = {f: (f"{f}_mean" if f == c else f) for f in FEATURES}
        probs = probability_sql(outputs_sql(values))
        pick = "CASE pred " + " ".join(f"WHEN {i} THEN p_{i} - ({p})" for i, p in enumerate(probs)) + " END"
        parts.append(f"SELECT pred AS output, '{c}' AS feature, {pick} AS value FROM scored CROSS JOIN middle")
    return f"""WITH {SCORED},
      sample AS (SELECT * FROM unit QUALIFY row_number() OVER (ORDER BY md5('0|' || row_key)) <= least(100, greatest(1, (SELECT count(*) FROM unit) // 10))),
      middle AS (SELECT {means} FROM sample), falls AS ({' UNION ALL '.join(parts)})
      SELECT output, feature, count(*) AS n, round(avg(value), 8) AS mean_fall, round(avg(abs(value)), 8) AS abs_mean FROM falls GROUP BY 1, 2"""


@query("l5_occlusion", _occlusion_sql())
def occlusion(spark, folder):
    rows = unit(flow(spark, folder), "row_key")
    falls = explain.occlusion(rows, scoring.linear_scorer(MODEL), FEATURES, ["row_key"], sampling.background(rows, ["row_key"]))
    return rounded(
        falls.groupBy("output", "feature").agg(
            F.count("*").alias("n"), F.avg("value").alias("mean_fall"), F.avg(F.abs("value")).alias("abs_mean")
        ),
        8,
    )


# Parts as a second small table of scored rows: three features, three classes.
PART_FEATURES = ["size", "price", "turn"]
PART_SQL = """parts AS (
    SELECT p_partkey, p_size / 53e0 AS size, p_retailprice / 937e0 AS price, (p_partkey % 11) / 1.1e1 AS turn,
           CAST(p_size % 4 AS VARCHAR) AS label FROM part)"""
PART_COEF = [[1.5, -0.5, 0.25], [-1.0, 0.75, 0.5], [0.25, 0.5, -1.25]]
PART_MODEL = scoring.Linear(PART_COEF, INTERCEPT)


def parts(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        (F.col("p_size") / 53.0).alias("size"),
        (F.col("p_retailprice") / 937.0).alias("price"),
        ((F.col("p_partkey") % 11) / 11.0).alias("turn"),
        (F.col("p_size") % 4).cast("string").alias("label"),
    )


# For a linear output the Shapley value is weight * (value - background mean), whatever the orders.
PART_VALUES = f"""{PART_SQL},
  sample AS (SELECT * FROM parts QUALIFY row_number() OVER (ORDER BY md5('0|' || p_partkey)) <= least(100, greatest(1, (SELECT count(*) FROM parts) // 10))),
  middle AS (SELECT {', '.join(f'avg({c}) AS {c}_mean' for c in PART_FEATURES)} FROM sample),
  attributions AS ({' UNION ALL '.join(
      f"SELECT p_partkey, {k} AS output, '{c}' AS feature, {w}e0 * ({c} - {c}_mean) AS value FROM parts CROSS JOIN middle"
      for k, row in enumerate(PART_COEF) for c, w in zip(PART_FEATURES, row))}),
  summary AS (SELECT p_partkey, feature, avg(abs(value)) AS abs_mean FROM attributions GROUP BY 1, 2)"""


def _part_values(spark, folder):
    rows = parts(spark, folder)
    sample = sampling.background(rows, ["p_partkey"])
    return explain.shapley(rows, scoring.linear_scorer(PART_MODEL, probabilities=False), PART_FEATURES, ["p_partkey"], sample)


@query("l6_shapley", f"WITH {PART_VALUES} SELECT p_partkey, output, feature, round(value, 7) AS value FROM attributions")
def shapley(spark, folder):
    return rounded(_part_values(spark, folder), 7)


@query("l7_attribution_summary", f"WITH {PART_VALUES} SELECT p_partkey, feature, round(abs_mean, 7) AS abs_mean FROM summary")
def attribution_summary(spark, folder):
    return rounded(explain.summary(_part_values(spark, folder), ["p_partkey"]), 7)


@query(
    "w6_top_attributions",
    f"""WITH {PART_VALUES}, placed AS (
          SELECT p_partkey, feature, round(abs_mean, 7) AS abs_mean,
                 CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY round(abs_mean, 7) DESC, feature) AS INTEGER) AS place FROM summary)
        SELECT * FROM placed WHERE place <= 10""",
)
def top_attributions(spark, folder):
    summary = rounded(explain.summary(_part_values(spark, folder), ["p_partkey"]), 7)
    return explain.top_features(summary, ["p_partkey"], 10)


PART_PROBS = ", ".join(f"{p} AS p_{i}" for i, p in enumerate(probability_sql(outputs_sql({c: c for c in PART_FEATURES}, PART_COEF))))
PART_SCORED = f"""part_shares AS (SELECT p_partkey, label, {PART_PROBS} FROM parts),
  part_scored AS (
    SELECT p_partkey, label, list_position([p_0, p_1, p_2], greatest(p_0, p_1, p_2)) - 1 AS pred, greatest(p_0, p_1, p_2) AS sure FROM part_shares)"""


def _part_scores(spark, folder):
    return scoring.score(parts(spark, folder), scoring.linear_scorer(PART_MODEL), PART_FEATURES, ["p_partkey"], "label")


@query(
    "j4_attribution_with_prediction",
    f"""WITH {PART_VALUES}, {PART_SCORED}
        SELECT p_partkey, feature, round(abs_mean, 7) AS abs_mean, CAST(pred AS INTEGER) AS pred, label AS "true", round(sure, 7) AS sure
        FROM summary JOIN part_scored USING (p_partkey)""",
)
def attribution_with_prediction(spark, folder):
    summary = explain.summary(_part_values(spark, folder), ["p_partkey"])
    joined = explain.joined_predictions(summary, _part_scores(spark, folder), ["p_partkey"])
    return rounded(joined.withColumn("sure", F.array_max("probs")).drop("probs"), 7)


NAMES = "[" + ", ".join(f"'{c}'" for c in MODEL_CLASSES) + "]"
FAMILY = ", ".join(f"'{c}'" for c in PFCP_CLASSES)
HEAD_SQL = """Explain the following traffic classification to a security analyst.

Predicted class: %s
True class: %s

Outcome:
- The prediction is right: %s
- Family: %s
- Confidence: %.1f%%

Features that moved the prediction most:"""


@query(
    "l13_prompts",
    f"""WITH {PART_VALUES}, {PART_SCORED},
        placed AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY abs_mean DESC, feature) AS place FROM summary),
        lines AS (
          SELECT p_partkey, string_agg(printf('- %s: importance %.6f', feature, abs_mean), chr(10) ORDER BY place) AS feature_lines
          FROM placed WHERE place <= 10 GROUP BY p_partkey),
        named AS (
          SELECT p_partkey, ({NAMES})[pred + 1] AS pred_name, ({NAMES})[CAST(label AS INTEGER) + 1] AS true_name, sure FROM part_scored)
        SELECT p_partkey, printf('{HEAD_SQL}', pred_name, true_name, CASE WHEN pred_name = true_name THEN 'True' ELSE 'False' END,
                 CASE WHEN pred_name IN ({FAMILY}) THEN 'PFCP' ELSE 'Non-PFCP' END, round(sure * 100, 4)) || chr(10) || feature_lines AS prompt
        FROM named JOIN lines USING (p_partkey)""",
)
def prompts(spark, folder):
    summary = explain.summary(_part_values(spark, folder), ["p_partkey"])
    return explain.prompts(summary, _part_scores(spark, folder), ["p_partkey"], MODEL_CLASSES)


STEP = 0.5
SHAPE = training.Shape(FEATURES, LABELS)


def _weighted_clients(spark, folder):
    rows = unit(clients(spark, folder), "row_key", "client")
    # one row per label: a join by label would bring all rows of a label to one task
    return rows.join(local_if_small(client_ops.class_weights(rows).select("label", "weight")), "label")


def _training_sql(steps: int) -> str:
    """Gradient steps of a weighted softmax regression, one pair of tables per step."""
    width, classes = len(FEATURES), range(len(LABELS))
    place = {(k, c): k * width + j for k in classes for j, c in enumerate(FEATURES)}
    size = width * len(LABELS) + len(LABELS)
    sql = f"""WITH {CLIENTS}, {UNIT_SQL.format(extra='client,', source='clients')},
      weights AS (SELECT label, sum(count(*)) OVER () / ({len(LABELS)}e0 * count(*)) AS weight FROM unit GROUP BY label),
      rows AS (SELECT unit.*, weight FROM unit JOIN weights USING (label)),
      theta0 AS (SELECT DISTINCT client, {', '.join(f'0e0 AS t{i}' for i in range(size))} FROM rows)"""
    for s in range(steps):
        logits = ["(" + " + ".join([f"t{width * len(LABELS) + k}", *[f"t{place[k, c]} * {c}" for c in FEATURES]]) + ")" for k in classes]
        shares = ", ".join(f"{p} AS p{k}" for k, p in enumerate(probability_sql(logits)))
        errors = [f"weight * (p{k} - CASE WHEN label = '{name}' THEN 1 ELSE 0 END)" for k, name in enumerate(LABELS)]
        moved = [f"any_value(t{place[k, c]}) - {STEP}e0 * sum({errors[k]} * {c}) / count(*) AS t{place[k, c]}" for k in classes for c in FEATURES]
        moved += [f"any_value(t{width * len(LABELS) + k}) - {STEP}e0 * sum({errors[k]}) / count(*) AS t{width * len(LABELS) + k}" for k in classes]
        own = "CASE label " + " ".join(f"WHEN '{name}' THEN p{k}" for k, name in enumerate(LABELS)) + " END"
        sql += f""",
      shares{s} AS (SELECT rows.*, {', '.join(f't{i}' for i in range(size))}, {shares} FROM rows JOIN theta{s} USING (client)),
      theta{s + 1} AS (
        SELECT client, {', '.join(moved)}, count(*) AS n, avg(-weight * ln({own})) AS loss FROM shares{s} GROUP BY client)"""
    return sql + f""" SELECT client, n, round(loss, 8) AS loss, {', '.join(f'round(t{i}, 8) AS t{i}' for i in range(size))} FROM theta{steps}"""


@query("l9_local_training", _training_sql(2))
def local_training(spark, folder):
    rows = _weighted_clients(spark, folder)
    after = training.local_steps(rows, SHAPE, training.start(spark, rows, SHAPE), STEP, 2)
    return rounded(after.select("client", "n", "loss", *[F.get("theta", F.lit(i)).alias(f"t{i}") for i in range(SHAPE.size)]), 8)


@query(
    "l12_central_evaluation",
    f"""WITH {CLIENTS}, {UNIT_SQL.format(extra='client,', source='clients')},
        shares AS (SELECT client, label, {PROBS} FROM unit),
        predictions AS (
          SELECT client, label AS truth, (['A', 'N', 'R'])[list_position([p_0, p_1, p_2], greatest(p_0, p_1, p_2))] AS pred FROM shares),
        {matrix_sql('client')}, {class_sql('client')}, macros AS (SELECT client, {MACRO_SQL} FROM classes GROUP BY client)
        SELECT client, {', '.join(f'round({m}, 9) AS central_{m}' for m in evaluate.MACRO)}, round(accuracy, 9) AS central_accuracy,
               n_test AS central_n_test, n_classes_test AS central_n_classes_test FROM macros""",
)
def central_evaluation(spark, folder):
    """The linear model scores every row of every client."""
    theta = [w for row in COEF for w in row] + INTERCEPT
    scored = training.predict(unit(clients(spark, folder), "client"), SHAPE, theta, ["client"])
    return rounded(evaluate.central(scored, LISTED, ["client"]), 9)


@query("l9_adaptive_rounds")
def adaptive_rounds(spark, folder):
    """Three rounds with the adaptive server update; the history, one row per round.

    A tenth of the rows tests the clients, another tenth is held out for the shared evaluation.
    """
    parted = materialise(sampling.split(_weighted_clients(spark, folder), "label", ["row_key"]))
    train, rest = parted.filter(~F.col("is_test")), parted.filter("is_test").drop("is_test")
    halves = materialise(sampling.split(rest, "label", ["row_key"], 0.5, seed=7))
    test, held_out = halves.filter(~F.col("is_test")), halves.filter("is_test")
    return training.run_rounds(train, test, SHAPE, 3, "adaptive", STEP, held_out=held_out)


@query("l11_control_rounds")
def control_rounds(spark, folder):
    """Three rounds with control variates."""
    parted = materialise(sampling.split(_weighted_clients(spark, folder), "label", ["row_key"]))
    train, test = parted.filter(~F.col("is_test")), parted.filter("is_test")
    return training.run_rounds(train, test, SHAPE, 3, "control", STEP, local=2)


def _round_parts() -> tuple[dict, list[str], list[str], str]:
    """Places of the weights, and of one round over outputs from columns x<i>: shares, errors by parameter, and a row's loss."""
    width, classes = len(FEATURES), range(len(LABELS))
    intercept = width * len(LABELS)
    logits = ["(" + " + ".join([f"x{intercept + k}", *[f"x{k * width + j} * {c}" for j, c in enumerate(FEATURES)]]) + ")" for k in classes]
    shares = ", ".join(f"{p} AS p{k}" for k, p in enumerate(probability_sql(logits)))
    errors = [f"weight * (p{k} - CASE WHEN label = '{name}' THEN 1 ELSE 0 END)" for k, name in enumerate(LABELS)]
    gradients = [f"sum({errors[k]} * {c})" for k in classes for c in FEATURES] + [f"sum({errors[k]})" for k in classes]
    own = "CASE label " + " ".join(f"WHEN '{name}' THEN p{k}" for k, name in enumerate(LABELS)) + " END"
    return shares, gradients, [f"x{i}" for i in range(len(gradients))], f"avg(-weight * ln({own}))"


ROUND_ROWS = f"""WITH {CLIENTS}, {UNIT_SQL.format(extra='client,', source='clients')},
      weights AS (SELECT label, sum(count(*)) OVER () / ({len(LABELS)}e0 * count(*)) AS weight FROM unit GROUP BY label),
      rows AS MATERIALIZED (SELECT unit.*, weight FROM unit JOIN weights USING (label))"""


def _adaptive_sql(count: int) -> str:
    """Every round: the gap is the mean of all clients' steps, m and v follow it and its square."""
    shares, gradients, x, loss = _round_parts()
    sql = ROUND_ROWS + ", s0 AS (SELECT " + ", ".join(f"0e0 AS x{i}, 0e0 AS m{i}, 0e0 AS v{i}" for i in range(len(x))) + ")"
    for r in range(count):
        gaps = ", ".join(f"-{STEP}e0 * {g} / count(*) AS gap{i}" for i, g in enumerate(gradients))
        moved = ", ".join(
            f"{training.BETA_1}e0 * m{i} + (1 - {training.BETA_1}e0) * gap{i} AS m{i}, {training.BETA_2}e0 * v{i} + (1 - {training.BETA_2}e0) * gap{i} * gap{i} AS v{i}, x{i} AS o{i}"
            for i in range(len(x))
        )
        stepped = ", ".join(f"o{i} + {training.SERVER_STEP}e0 * m{i} / (sqrt(v{i}) + {training.TAU:.1e}) AS x{i}, m{i}, v{i}" for i in range(len(x)))
        sql += f""",
      g{r} AS MATERIALIZED (SELECT {loss} AS loss, {gaps} FROM (SELECT rows.*, {shares} FROM rows CROSS JOIN s{r})),
      s{r + 1} AS MATERIALIZED (SELECT {stepped} FROM (SELECT {moved} FROM s{r} CROSS JOIN g{r}))"""
    return sql + " " + " UNION ALL ".join(f"SELECT {r + 1} AS round, round(loss, 7) AS loss FROM g{r}" for r in range(count))


def _control_sql(count: int) -> str:
    """Every round: clients step by gradient and shift, the server by their mean, controls by what they moved."""
    shares, gradients, x, loss = _round_parts()
    n = len(x)
    sql = ROUND_ROWS + ", s0 AS (SELECT " + ", ".join(f"0e0 AS x{i}, 0e0 AS c{i}" for i in range(n)) + ")"
    sql += ", k0 AS (SELECT DISTINCT client, " + ", ".join(f"0e0 AS k{i}, 0e0 AS shift{i}" for i in range(n)) + " FROM rows)"
    bound = training.CONTROL_BOUND
    for r in range(count):
        means = ", ".join(f"{g} / count(*) AS g{i}" for i, g in enumerate(gradients))
        steps = ", ".join(f"x{i} - {STEP}e0 * (g{i} + shift{i}) AS y{i}, k{i}, x{i}, c{i}" for i in range(n))
        news = ", ".join(f"y{i}, k{i}, k{i} - c{i} + (x{i} - y{i}) / {STEP}e0 AS new{i}" for i in range(n))
        after = ", ".join(
            f"any_value(x{i}) + {training.CONTROL_SERVER_STEP}e0 * (avg(y{i}) - any_value(x{i})) AS x{i}, greatest(least(any_value(c{i}) + avg(new{i} - k{i}), {bound}e0), -{bound}e0) AS c{i}"
            for i in range(n)
        )
        kept = ", ".join(f"new{i} AS k{i}, c{i} - new{i} AS shift{i}" for i in range(n))
        sql += f""",
      g{r} AS MATERIALIZED (SELECT client, count(*) AS n, {loss} AS loss, {means} FROM (SELECT rows.*, {shares} FROM rows CROSS JOIN s{r}) GROUP BY client),
      u{r} AS MATERIALIZED (SELECT client, {news} FROM (SELECT client, {steps} FROM g{r} JOIN k{r} USING (client) CROSS JOIN s{r})),
      s{r + 1} AS MATERIALIZED (SELECT {after} FROM u{r} CROSS JOIN s{r}),
      k{r + 1} AS MATERIALIZED (SELECT client, {kept} FROM (SELECT * EXCLUDE ({', '.join(f'k{i}' for i in range(n))}) FROM u{r}) CROSS JOIN s{r + 1})"""
    return sql + " " + " UNION ALL ".join(f"SELECT {r + 1} AS round, round(sum(loss * n) / sum(n), 7) AS loss FROM g{r}" for r in range(count))


def _round_losses(spark, folder, method):
    rows = materialise(_weighted_clients(spark, folder))
    history = training.run_rounds(rows, rows, SHAPE, 3, method, STEP)
    return rounded(history.select("round", "loss"), 7)


@query("l9_adaptive_losses", _adaptive_sql(3))
def adaptive_losses(spark, folder):
    """Losses of three rounds over all rows; each follows from the parameters of the server steps before."""
    return _round_losses(spark, folder, "adaptive")


@query("l11_control_losses", _control_sql(3))
def control_losses(spark, folder):
    """The same with control variates."""
    return _round_losses(spark, folder, "control")


PARAMS = """cells AS (
    SELECT label, CAST(unnest(embedding) AS DOUBLE) AS value, generate_subscripts(embedding, 1) - 1 AS idx FROM embeddings),
  updates AS (SELECT label AS client, idx, avg(value) AS value, count(*) AS n, stddev_pop(value) AS c_i FROM cells GROUP BY 1, 2),
  state AS (
    SELECT idx, avg(value) * 0.5e0 AS x, stddev_pop(value) * 0.1e0 AS m, var_pop(value) AS v, stddev_pop(value) * 0.9e0 AS c
    FROM cells GROUP BY idx)"""


def _parameters(spark, folder):
    """Embedding dimensions as parameters: means per label as client updates, the rest as state."""
    cells = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("idx", "value")).select(
        "label", "idx", F.col("value").cast("double").alias("value"), F.lit("vector").alias("layer")
    )
    updates = cells.groupBy(F.col("label").alias("client"), "layer", "idx").agg(
        F.avg("value").alias("value"), F.count("*").alias("n"), F.stddev_pop("value").alias("c_i")
    )
    state = cells.groupBy("layer", "idx").agg(
        (F.avg("value") * 0.5).alias("x"),
        (F.stddev_pop("value") * 0.1).alias("m"),
        F.var_pop("value").alias("v"),
        (F.stddev_pop("value") * 0.9).alias("c"),
    )
    return updates, state


@query(
    "l10_server_step",
    f"""WITH {PARAMS}, gaps AS (
          SELECT idx, any_value(x) AS x, any_value(m) AS m, any_value(v) AS v, sum(n * (value - x)) / sum(n) AS gap
          FROM updates JOIN state USING (idx) GROUP BY idx),
        moved AS (SELECT idx, x, 0.9e0 * m + 0.1e0 * gap AS m, 0.99e0 * v + 0.01e0 * gap * gap AS v FROM gaps)
        SELECT 'vector' AS layer, CAST(idx AS INTEGER) AS idx, round(x + 0.01e0 * m / (sqrt(v) + 1e-9), 9) AS x,
               round(m, 9) AS m, round(v, 9) AS v FROM moved""",
)
def server_step(spark, folder):
    updates, state = _parameters(spark, folder)
    return rounded(training.server_step(updates, state.select("layer", "idx", "x", "m", "v")), 9)


@query(
    "l11_control_step",
    f"""WITH {PARAMS}, changed AS (
          SELECT idx, x, c, value - x AS moved, (c_i - c + (x - value) / (20 * 0.01e0)) - c_i AS change FROM updates JOIN state USING (idx))
        SELECT 'vector' AS layer, CAST(idx AS INTEGER) AS idx, round(any_value(x) + 0.5e0 * avg(moved), 9) AS x,
               round(greatest(least(any_value(c) + avg(change), 1), -1), 9) AS c FROM changed GROUP BY idx""",
)
def control_step(spark, folder):
    updates, state = _parameters(spark, folder)
    sent = updates.select("client", "layer", "idx", F.col("value").alias("y"), "c_i")
    return rounded(training.control_step(sent, state.select("layer", "idx", "x", "c"), 20), 9)


@query("l1_pca")
def pca(spark, folder):
    """Variance shares of the embedding dimensions."""
    rows = table(spark, folder, "embeddings")
    names = [f"e{i}" for i in range(64)]
    wide = rows.select("vec_id", F.col("label").cast("string").alias("label"), *[F.get("embedding", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return rounded(forest.principal_components(wide, "label", names, ["vec_id"]).variance, 9)


PCA_COLUMNS = [f"e{i}" for i in range(8)]


def _pca_sql() -> str:
    """Trace and squared sum of the covariances, which are the sums of the variances and of their squares."""
    fit = ", ".join(f"quantile_cont({c}, 0.5) AS {c}_m, nullif(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0) AS {c}_r" for c in PCA_COLUMNS)
    scaled = ", ".join(f"({c} - {c}_m) / coalesce({c}_r, 1) AS {c}" for c in PCA_COLUMNS)
    trace = " + ".join(f"covar_samp({c}, {c})" for c in PCA_COLUMNS)
    squares = " + ".join(f"covar_samp({a}, {b}) ** 2" for a in PCA_COLUMNS for b in PCA_COLUMNS)
    return f"""WITH rows AS (SELECT {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS {c}' for i, c in enumerate(PCA_COLUMNS))} FROM embeddings WHERE label IS NOT NULL),
      fit AS (SELECT {fit} FROM rows), scaled AS (SELECT {scaled} FROM rows CROSS JOIN fit)
      SELECT {len(PCA_COLUMNS)} AS components, 1e0 AS share_sum, round(({squares}) / ({trace}) ** 2, 7) AS square_sum, 1e0 AS last_cumulative, count(*) AS scored FROM scaled"""


@query("l1_pca_sums", _pca_sql())
def pca_sums(spark, folder):
    """All components of eight dimensions: their shares add up, and their squares follow from the covariances."""
    rows = table(spark, folder, "embeddings")
    wide = rows.select("vec_id", F.col("label").cast("string").alias("label"), *[F.get("embedding", F.lit(i)).alias(c) for i, c in enumerate(PCA_COLUMNS)])
    found = forest.principal_components(wide, "label", PCA_COLUMNS, ["vec_id"], k=len(PCA_COLUMNS))
    sums = found.variance.agg(
        F.count("*").cast("int").alias("components"),
        F.round(F.sum("ratio"), 9).alias("share_sum"),
        F.round(F.sum(F.col("ratio") * F.col("ratio")), 7).alias("square_sum"),
        F.round(F.max("cumulative"), 9).alias("last_cumulative"),
    )
    return sums.crossJoin(found.scores.agg(F.count("*").alias("scored")))


FORESTS: dict[tuple[str, str], forest.Forest] = {}


def _forest(spark, folder):
    """One fit per session and folder, shared by the queries that read it; its table lies in the checkpoint folder."""
    at = (spark.sparkContext.applicationId, folder)
    if at not in FORESTS:
        rows = flow(spark, folder, gaps=True).drop("suppkey")
        FORESTS[at] = forest.proxy_forest(rows, "label", ["row_key"], FEATURES, ["status"])
    return FORESTS[at]


@query("l2_proxy_forest")
def proxy_forest(spark, folder):
    """Report rows and named importances of the proxy forest, in one table."""
    fitted = _forest(spark, folder)
    report = fitted.report.select(F.lit("report").alias("part"), F.col("label").alias("name"), F.col("f1").alias("value"))
    return report.unionByName(
        fitted.importances.select(F.lit("importance").alias("part"), F.col("feature").alias("name"), F.col("importance").alias("value"))
    )


@query(
    "l2_forest_checks",
    f"""WITH {FLOW}, {ordered_sql()}, {quota_sql('label')}, test AS (
          SELECT numbered.label FROM numbered JOIN quotas ON stratum = label WHERE place <= quota),
        codes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS VARCHAR) AS code FROM (SELECT DISTINCT label FROM flow))
        SELECT 'support' AS part, code AS name, CAST(count(*) AS DOUBLE) AS value FROM test JOIN codes USING (label) GROUP BY 2
        UNION ALL SELECT 'test rows', 'all', CAST(count(*) AS DOUBLE) FROM test
        UNION ALL SELECT 'trees', 'all', 400
        UNION ALL SELECT 'importance', 'sum', 1
        UNION ALL SELECT 'importance', name, 1 FROM (VALUES ('quantity'), ('price'), ('discount'), ('tax'), ('status_hot_F'), ('status_hot_O')) t(name)
        UNION ALL SELECT 'share sums of leaves', 'largest gap', 0""",
)
def forest_checks(spark, folder):
    """What is sure about the fitted forest whatever its trees: rows tested, inputs, sums."""
    fitted = _forest(spark, folder)
    one = F.lit(1.0)
    shares = fitted.table.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("column") - 1), lambda i: F.aggregate(F.slice("shares", i * 3 + 1, 3), F.lit(0.0), lambda a, x: a + x))).alias("total"))
    parts = [
        fitted.matrix.groupBy(F.col("true").alias("name")).agg(F.sum("n").cast("double").alias("value")).select(F.lit("support").alias("part"), "name", "value"),
        fitted.test.agg(F.count("*").cast("double").alias("value")).select(F.lit("test rows").alias("part"), F.lit("all").alias("name"), "value"),
        fitted.table.agg(F.count("*").cast("double").alias("value")).select(F.lit("trees").alias("part"), F.lit("all").alias("name"), "value"),
        fitted.importances.agg(F.round(F.sum("importance"), 9).alias("value")).select(F.lit("importance").alias("part"), F.lit("sum").alias("name"), "value"),
        fitted.importances.filter("importance >= 0").select(F.lit("importance").alias("part"), F.col("feature").alias("name"), one.alias("value")),
        shares.agg(F.round(F.max(F.abs(F.col("total") - 1)), 9).alias("value")).select(
            F.lit("share sums of leaves").alias("part"), F.lit("largest gap").alias("name"), "value"
        ),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


@query("l3_permutation_importance")
def permutation_importance(spark, folder):
    return forest.permutation_importance(_forest(spark, folder), ["row_key"], repeats=5)


def _permutation_sql(repeats: int) -> str:
    """Falls of a linear model's accuracy, one donor join per trial."""
    values = {c: c for c in PART_FEATURES}

    def said(v: dict[str, str]) -> str:
        outputs = outputs_sql(v, PART_COEF)
        return f"list_position([{', '.join(outputs)}], greatest({', '.join(outputs)})) - 1"

    falls = [
        f"""SELECT {t} AS trial, '{c}' AS feature, avg(CASE WHEN r.said = r.code THEN 1 ELSE 0 END) - avg(CASE WHEN {said({f: f'd.{f}' if f == c else f'r.{f}' for f in PART_FEATURES})} = r.code THEN 1 ELSE 0 END) AS fall
            FROM placed r CROSS JOIN size JOIN placed d ON d.place = (r.place * ({forest.PRIMES[t]} % n) + {forest.SHIFT * (sampling.SEED + t + 1)} % n) % n"""
        for t in range(repeats)
        for c in PART_FEATURES
    ]
    return f"""WITH {PART_SQL}, size AS (SELECT count(*) AS n FROM parts),
      placed AS (SELECT *, CAST(label AS INTEGER) AS code, {said(values)} AS said,
                        row_number() OVER (ORDER BY md5('{sampling.SEED}|' || p_partkey), p_partkey) - 1 AS place FROM parts),
      falls AS ({' UNION ALL '.join(falls)})
      SELECT feature, round(avg(fall), 9) AS perm_importance_mean, round(stddev_pop(fall), 9) AS perm_importance_std FROM falls GROUP BY 1"""


@query("l3_linear_permutation", _permutation_sql(5))
def linear_permutation(spark, folder):
    """The same trials for a linear model over all parts, which SQL can follow."""
    rows = parts(spark, folder)
    test = rows.select("p_partkey", F.col("label").cast("int").alias("code"), scoring.feature_array(rows, PART_FEATURES).alias("inputs"))
    return rounded(forest.permuted_falls(test, scoring.linear_scorer(PART_MODEL, probabilities=False), PART_FEATURES, ["p_partkey"]), 9)


ATTRIBUTED: dict[tuple[str, str], tuple] = {}


def _attributed(spark, folder):
    """A forest fitted on a stratified sample, the filled table with its background, and what scores it; once per session and folder.

    Attributions are wider than the table and are used up where they are made, so they are never written.
    """
    at = (spark.sparkContext.applicationId, folder)
    if at not in ATTRIBUTED:
        rows = flow(spark, folder, gaps=True).select("row_key", "label", *FEATURES)
        sample = materialise(forest.attribution_sample(rows, "label", ["row_key"]))
        model = forest.fit_numeric_forest(sample, "label", FEATURES)
        filled = written(impute_median(rows, FEATURES, fitted_on=sample).select("row_key", *FEATURES))
        base = materialise(sampling.background(filled, ["row_key"]))
        ATTRIBUTED[at] = (model, filled, base, trees.scorer(spark, model, filled.count()))
    return ATTRIBUTED[at]


@query("l8_forest_attribution")
def forest_attribution(spark, folder):
    """Mean absolute attribution of a numeric forest over all rows; a stratified sample fits it."""
    model, filled, base, _ = _attributed(spark, folder)
    return explain.summary(trees.attribute(filled, model, FEATURES, ["row_key"], base))


@query(
    "l8_attribution_sums",
    f"""WITH {FLOW}, classes AS (SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS output FROM (SELECT DISTINCT label FROM flow WHERE label IS NOT NULL))
        SELECT output, (SELECT count(*) FROM flow) AS n, {len(FEATURES)} AS features, 0e0 AS largest_gap FROM classes""",
)
def attribution_sums(spark, folder):
    """Per output, how far any row's values are from adding up to f(row) - mean f(background)."""
    model, filled, base, scored = _attributed(spark, folder)
    width, inputs = len(FEATURES), scoring.feature_array(filled, FEATURES)
    middle = scored(base.select(scoring.feature_array(base, FEATURES).alias("inputs")), "inputs", "probs")
    means = middle.select(F.posexplode("probs").alias("output", "p")).groupBy("output").agg(F.avg("p").alias("mean"))
    # the inputs go along as keys, so a row is scored beside its attributions; rows that share a key are summed as one
    placed = filled.select("row_key", inputs.alias("row_inputs"), *FEATURES)
    rows = scored(trees.attribute_rows(placed, model, FEATURES, ["row_key", "row_inputs"], base), "row_inputs", "probs")
    outputs = range(model.shares.shape[1])
    totals = [F.aggregate(F.slice("attribution", k * width + 1, width), F.lit(0.0), lambda a, x: a + x) for k in outputs]
    ends = [F.struct(F.sum(t).alias("total"), F.min(F.get("probs", F.lit(k))).alias("low"), F.max(F.get("probs", F.lit(k))).alias("high")) for k, t in zip(outputs, totals)]
    keyed = rows.groupBy("row_key").agg(F.count("*").alias("rows"), F.array(*ends).alias("ends"))
    cells = keyed.select("rows", F.posexplode("ends").alias("output", "cell")).join(means, "output")
    gap = F.greatest(*[F.abs(F.col("cell.total") - F.col(f"cell.{end}") + F.col("mean")) for end in ("low", "high")])
    return cells.groupBy("output").agg(
        F.sum("rows").alias("n"), (F.max("rows") * width).cast("int").alias("features"), F.round(F.max(gap), 9).alias("largest_gap")
    )
