"""Queries over predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardscope.functions import scalars
from shardscope.functions.labels import MODEL_CLASSES
from shardscope.operators import evaluate as ops
from shardscope.operators import explain
from shardscope.plans.registry import query
from shardscope.plans.tables import FLOW, ROUND_PREDICTIONS, flow, predictions, rounded

# A class list with one name nobody uses, so that the grid has gaps.
LISTED = ["A", "N", "R", "X"]
LIST_SQL = ", ".join(f"('{c}')" for c in LISTED)


def matrix_sql(by: str = "", classes: str = LIST_SQL) -> str:
    """Full confusion grid per group, as a table ``matrix``."""
    groups = f"CROSS JOIN (SELECT DISTINCT {by} FROM predictions) AS names" if by else ""
    head, own = (f"{by}, ", " AND ".join(f"p.{b.strip()} = names.{b.strip()}" for b in by.split(",")) + " AND ") if by else ("", "")
    keys = "".join(f"names.{b.strip()}, " for b in by.split(",")) if by else ""
    return f"""listed(name) AS (VALUES {classes}),
      matrix AS (
        SELECT {keys}t.name AS truth, q.name AS pred, count(p.truth) AS n
        FROM listed AS t CROSS JOIN listed AS q {groups}
        LEFT JOIN predictions AS p ON {own}p.truth = t.name AND p.pred = q.name
        GROUP BY ALL
        UNION ALL SELECT {head}truth, NULL, count(*) FROM predictions WHERE pred NOT IN (SELECT name FROM listed) GROUP BY ALL)"""


def class_sql(by: str = "") -> str:
    """Per-class table ``classes`` from ``matrix``."""
    keys = "".join(f"{b.strip()}, " for b in by.split(",")) if by else ""
    return f"""sums AS (
        SELECT {keys}label, sum(hits) AS hits, CAST(sum(support) AS BIGINT) AS support, sum(predicted) AS predicted FROM (
          SELECT {keys}truth AS label, CASE WHEN truth = pred THEN n ELSE 0 END AS hits, n AS support, 0 AS predicted FROM matrix
          UNION ALL SELECT {keys}pred, 0, 0, n FROM matrix) WHERE label IS NOT NULL GROUP BY ALL),
      rates AS (
        SELECT {keys}label, support, predicted, COALESCE(CAST(hits AS DOUBLE) / nullif(predicted, 0), 0) AS precision,
               COALESCE(CAST(hits AS DOUBLE) / nullif(support, 0), 0) AS recall FROM sums),
      classes AS (
        SELECT *, COALESCE(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rates)"""


def _matrix(spark, folder, by=(), classes=LISTED):
    return ops.confusion(predictions(spark, folder), classes, by)


@query("a25_confusion_matrix", f"WITH {ROUND_PREDICTIONS}, {matrix_sql('client')} SELECT client, truth AS \"true\", pred, n FROM matrix WHERE pred IS NOT NULL")
def confusion_matrix(spark, folder):
    return _matrix(spark, folder, ["client"]).filter("pred is not null")


@query(
    "j3_reindex_confusion",
    f"""WITH {ROUND_PREDICTIONS}, {matrix_sql()} SELECT truth AS "true", {', '.join(
        f"CAST(sum(CASE WHEN pred = '{c}' THEN n END) AS BIGINT) AS {c}" for c in LISTED)} FROM matrix GROUP BY truth""",
)
def reindex_confusion(spark, folder):
    """A matrix of the classes that occur, widened to the whole class list."""
    rows = predictions(spark, folder)
    found = rows.groupBy("true", "pred").agg(F.count("*").alias("n"))
    return ops.wide_matrix(ops.full_grid(found, LISTED), LISTED)


CLASS_COLUMNS = "label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support"


@query(
    "a26_per_class_metrics",
    f"WITH {ROUND_PREDICTIONS}, {matrix_sql('client')}, {class_sql('client')} SELECT client, {CLASS_COLUMNS} FROM classes",
)
def per_class_metrics(spark, folder):
    return rounded(ops.per_class(_matrix(spark, folder, ["client"]), ["client"]).drop("predicted"), 9)


MACRO_SQL = """avg(CASE WHEN support > 0 THEN f1 END) AS macro_f1, avg(CASE WHEN support > 0 THEN precision END) AS macro_precision,
    avg(CASE WHEN support > 0 THEN recall END) AS macro_recall, sum(recall * support) / sum(support) AS accuracy,
    CAST(sum(support) AS BIGINT) AS n_test, count(CASE WHEN support > 0 THEN 1 END) AS n_classes_test"""
MACRO_ROUNDED = "round(macro_f1, 9) AS macro_f1, round(macro_precision, 9) AS macro_precision, round(macro_recall, 9) AS macro_recall"


@query(
    "a27_macro_metrics",
    f"""WITH {ROUND_PREDICTIONS}, {matrix_sql('client')}, {class_sql('client')},
        macros AS (SELECT client, {MACRO_SQL} FROM classes GROUP BY client) SELECT client, {MACRO_ROUNDED} FROM macros""",
)
def macro_metrics(spark, folder):
    return rounded(ops.macro(_matrix(spark, folder, ["client"]), ["client"]).select("client", *ops.MACRO), 9)


@query(
    "a28_accuracy",
    f"""WITH {ROUND_PREDICTIONS} SELECT client, round(avg(CASE WHEN truth = pred THEN 1e0 ELSE 0e0 END), 9) AS accuracy,
        count(*) AS n_test, count(DISTINCT truth) AS n_classes_test FROM predictions GROUP BY client""",
)
def accuracy(spark, folder):
    table = ops.macro(_matrix(spark, folder, ["client"]), ["client"])
    return rounded(table.select("client", "accuracy", "n_test", "n_classes_test"), 9)


@query(
    "a29_weighted_f1",
    f"""WITH {ROUND_PREDICTIONS}, {matrix_sql('round')}, {class_sql('round')}
        SELECT round, round(sum(f1 * support) / sum(support), 9) AS weighted_f1,
               round(avg(CASE WHEN support > 0 OR predicted > 0 THEN f1 END), 9) AS macro_f1 FROM classes GROUP BY round""",
)
def weighted_f1(spark, folder):
    return rounded(ops.averaged_f1(_matrix(spark, folder, ["round"]), ["round"]), 9)


# The client of one region reports no precision: it has to drop out of that mean only.
CLIENT_METRICS = f"""{matrix_sql('client, round')}, {class_sql('client, round')},
      macros AS (
        SELECT client, round, avg(CASE WHEN support > 0 THEN f1 END) AS macro_f1,
               CASE WHEN client <> 'ASIA' THEN avg(CASE WHEN support > 0 THEN precision END) END AS macro_precision,
               avg(CASE WHEN support > 0 THEN recall END) AS macro_recall, sum(support) AS n_test FROM classes GROUP BY client, round)"""
MEANS = ", ".join(
    f"round(sum({m} * n_test) / sum(CASE WHEN {m} IS NOT NULL THEN n_test END), 9) AS {m}_weighted" for m in ops.MACRO
)


def _client_metrics(spark, folder):
    by = ["client", "round"]
    table = ops.macro(_matrix(spark, folder, by), by)
    return table.withColumn("macro_precision", F.when(F.col("client") != "ASIA", F.col("macro_precision")))


@query("a30_weighted_mean", f"WITH {ROUND_PREDICTIONS}, {CLIENT_METRICS} SELECT {MEANS} FROM macros")
def weighted_mean(spark, folder):
    return rounded(ops.weighted_mean(_client_metrics(spark, folder), list(ops.MACRO), "n_test"), 9)


@query("w7_round_history", f"WITH {ROUND_PREDICTIONS}, {CLIENT_METRICS} SELECT round, {MEANS} FROM macros GROUP BY round")
def round_history(spark, folder):
    return rounded(ops.rounds(_client_metrics(spark, folder)).orderBy("round"), 9)


@query(
    "a31_merged_confusion",
    f"WITH {ROUND_PREDICTIONS}, {matrix_sql()}, {class_sql()} SELECT {CLASS_COLUMNS} FROM classes",
)
def merged_confusion(spark, folder):
    merged = ops.merge(_matrix(spark, folder, ["client"]))
    return rounded(ops.per_class(merged).drop("predicted"), 9)


@query(
    "a32_classification_report",
    f"""WITH {ROUND_PREDICTIONS}, {matrix_sql()}, {class_sql()},
        seen AS (SELECT * FROM classes WHERE support > 0 OR predicted > 0),
        report AS (
          SELECT label, precision, recall, f1, support FROM seen
          UNION ALL SELECT 'accuracy', NULL, NULL, sum(recall * support) / sum(support), CAST(sum(support) AS BIGINT) FROM seen
          UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM seen
          UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                    sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM seen)
        SELECT {CLASS_COLUMNS} FROM report""",
)
def classification_report(spark, folder):
    return rounded(ops.report(_matrix(spark, folder)), 9)


@query(
    "a34_diagnostics_status",
    f"""WITH {ROUND_PREDICTIONS}, pairs AS (SELECT DISTINCT client, round FROM predictions)
        SELECT round, count(*) AS num_clients, count(CASE WHEN client <> 'ASIA' THEN 1 END) AS num_local_details_received,
               count(CASE WHEN round >= 7 THEN 1 END) AS num_central_details_received FROM pairs GROUP BY round""",
)
def diagnostics_status(spark, folder):
    """Every client reports its matrix as JSON, except one region; central details start later."""
    by = ["client", "round"]
    sent = ops.details_json(_matrix(spark, folder, by), by)
    received = sent.select(
        "client",
        "round",
        F.when(F.col("client") != "ASIA", F.col("details_json")).alias("details_json"),
        F.when(F.col("round") >= 7, F.col("details_json")).otherwise("").alias("central_details_json"),
    )
    return ops.diagnostics_status(received)


PROBS = "[quantity / 50e0, price / 105e0, discount * 10e0, 0.5e0]"


def _probabilities(spark, folder):
    """Four positive scores per row; equal ones occur, so ties are exercised."""
    scores = F.array(F.col("quantity") / 50, F.col("price") / 105, F.col("discount") * 10, F.lit(0.5))
    return flow(spark, folder).select("row_key", "label", "quantity", scores.alias("probs"))


@query(
    "p19_argmax",
    f"""WITH {FLOW}, scored AS (SELECT label, {PROBS} AS probs FROM flow)
        SELECT label, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred, count(*) AS n,
               round(avg(list_max(probs)), 9) AS mean_confidence FROM scored GROUP BY 1, 2""",
)
def argmax(spark, folder):
    rows = _probabilities(spark, folder).select(
        "label", scalars.argmax(F.col("probs")).alias("pred"), scalars.confidence(F.col("probs")).alias("sure")
    )
    return rounded(rows.groupBy("label", "pred").agg(F.count("*").alias("n"), F.avg("sure").alias("mean_confidence")), 9)


NAMES_SQL = "[" + ", ".join(f"'{c}'" for c in MODEL_CLASSES) + "]"


@query(
    "p20_code_names",
    f"""SELECT p_size, COALESCE(CASE WHEN p_size BETWEEN 0 AND 5 THEN ({NAMES_SQL})[p_size + 1] END, CAST(p_size AS VARCHAR)) AS name,
               count(*) AS n FROM part GROUP BY ALL""",
)
def code_names(spark, folder):
    from shardscope.plans.tables import table

    name = scalars.code_name(F.col("p_size"), MODEL_CLASSES).alias("name")
    return table(spark, folder, "part").groupBy("p_size", name).agg(F.count("*").alias("n"))


@query(
    "p21_outcome_flags",
    f"""WITH {FLOW}, rows AS (
          SELECT CAST(CAST(quantity AS BIGINT) % 8 AS VARCHAR) AS pred,
                 CASE label WHEN 'A' THEN '3' WHEN 'N' THEN 'benign' ELSE '4' END AS truth FROM flow),
        named AS (
          SELECT COALESCE(({NAMES_SQL})[TRY_CAST(pred AS INTEGER) + 1], pred) AS pred_name,
                 COALESCE(({NAMES_SQL})[TRY_CAST(truth AS INTEGER) + 1], truth) AS true_name FROM rows)
        SELECT pred_name, true_name, pred_name = true_name AS is_correct,
               pred_name IN ('pfcp_session_deletion', 'pfcp_session_establishment', 'pfcp_session_modification') AS is_family,
               count(*) AS n FROM named GROUP BY ALL""",
)
def outcome_flags(spark, folder):
    rows = flow(spark, folder).select(
        (F.col("quantity").cast("bigint") % 8).cast("string").alias("pred"),
        F.when(F.col("label") == "A", "3").when(F.col("label") == "N", "benign").otherwise("4").alias("true"),
    )
    flagged = rows.select(*explain.outcome(F.col("pred"), F.col("true"), MODEL_CLASSES))
    return flagged.groupBy(*flagged.columns).agg(F.count("*").alias("n"))


@query(
    "p22_clip",
    f"""WITH {FLOW} SELECT label, round(avg(greatest(least(price / 50e0 - 1, 1), -1)), 9) AS mean_clipped,
        round(min(greatest(least(price / 50e0 - 1, 1), -1)), 9) AS low, round(max(greatest(least(price / 50e0 - 1, 1), -1)), 9) AS high
        FROM flow GROUP BY label""",
)
def clip(spark, folder):
    value = scalars.clip(F.col("price") / 50 - 1, -1.0, 1.0)
    rows = flow(spark, folder).select("label", value.alias("v"))
    return rounded(rows.groupBy("label").agg(F.avg("v").alias("mean_clipped"), F.min("v").alias("low"), F.max("v").alias("high")), 9)
