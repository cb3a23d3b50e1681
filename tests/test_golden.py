"""Published results of known inputs."""

from __future__ import annotations

import pytest

from shardscope.functions.labels import MODEL_CLASSES, label_from_path
from shardscope.operators import clients, evaluate, explain, sampling
from pyspark.sql import functions as F

COUNTS = {
    "benign": (21060, 21060, 21060, 0.5406536878759101),
    "bruteForce": (30778, 0, 0, 1.1098349470400937),
    "ddos_tcp_ddos": (0, 45033, 0, 0.7585215286567628),
    "pfcp_session_deletion": (0, 15296, 15296, 1.1165827667364017),
    "pfcp_session_establishment": (0, 0, 7588, 4.50164733790195),
    "pfcp_session_modification": (0, 0, 27780, 1.2296076313894888),
}

MATRICES = {
    "client_1": {0: (4200, 6, 1, 4, 0, 1), 1: (165, 5951, 25, 13, 1, 1)},
    "client_2": {0: (4046, 0, 164, 2, 0, 0), 2: (1022, 2, 7967, 5, 9, 2), 3: (65, 0, 2, 2990, 2, 0)},
    "client_3": {
        0: (4175, 1, 2, 13, 19, 2),
        3: (2, 0, 0, 2436, 594, 27),
        4: (58, 0, 0, 7, 1452, 1),
        5: (13, 0, 0, 73, 1069, 4401),
    },
}


@pytest.fixture(scope="module")
def rows(spark):
    """The counted rows themselves, generated by Spark."""
    cells = [(c, f"client_{i + 1}", n[i]) for c, n in COUNTS.items() for i in range(3) if n[i]]
    table = spark.createDataFrame(cells, "label string, client string, n int")
    return table.select("label", "client", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("number"))


@pytest.fixture(scope="module")
def matrices(spark):
    cells = [
        (client, MODEL_CLASSES[t], MODEL_CLASSES[p], n)
        for client, matrix in MATRICES.items()
        for t, row in matrix.items()
        for p, n in enumerate(row)
    ]
    counts = spark.createDataFrame(cells, "client string, true string, pred string, n bigint")
    return evaluate.full_grid(counts, MODEL_CLASSES, ["client"])


def test_class_by_client_counts(rows):
    wide = clients.wide_by_client(clients.class_client_grid(rows), ["client_1", "client_2", "client_3"])
    assert {r["class"]: tuple(r)[1:] for r in wide.collect()} == {c: n[:3] for c, n in COUNTS.items()}


def test_rows_per_client(rows):
    found = {r.client: (r.n, r.percent) for r in clients.client_counts(rows).collect()}
    assert {c: n for c, (n, _) in found.items()} == {"client_1": 51838, "client_2": 81389, "client_3": 71724}
    assert sum(p for _, p in found.values()) == pytest.approx(100)


def test_global_class_weights(rows):
    found = {r.label: r.weight for r in clients.class_weights(rows).collect()}
    assert found == pytest.approx({c: n[3] for c, n in COUNTS.items()}, rel=1e-12)


def test_absent_class_has_weight_one(rows):
    weights = clients.class_weights(rows, client="client").filter("client = 'client_1'")
    found = {r.label: r.weight for r in weights.collect()}
    assert found["ddos_tcp_ddos"] == 1.0
    assert found["benign"] == pytest.approx(51838 / (2 * 21060))


def test_grid_is_square_and_keeps_counts(matrices):
    assert matrices.count() == 3 * 36
    assert matrices.agg(F.sum("n")).first()[0] == sum(sum(r) for m in MATRICES.values() for r in m.values())


def test_merged_per_class(matrices):
    found = {r.label: r for r in evaluate.per_class(evaluate.merge(matrices)).collect()}
    benign = found["benign"]
    assert (benign.precision, benign.recall, benign.f1) == pytest.approx(
        (0.9036083224210679, 0.9829851218740108, 0.9416268668031234), rel=1e-12
    )
    assert benign.support == 12636
    assert found["pfcp_session_establishment"].f1 == pytest.approx(0.6226415094339623, rel=1e-12)


def test_row_weighted_macro(matrices):
    per_client = evaluate.macro(matrices, ["client"]).withColumn("round", F.lit(50))
    row = evaluate.rounds(per_client).first()
    assert row.macro_f1_weighted == pytest.approx(0.9108609907141718, rel=1e-12)
    assert row.macro_precision_weighted == pytest.approx(0.9117816830103984, rel=1e-12)
    assert row.macro_recall_weighted == pytest.approx(0.931363387779626, rel=1e-12)


def test_report_has_summary_rows(matrices):
    found = {r.label: r for r in evaluate.report(evaluate.merge(matrices)).collect()}
    assert {"accuracy", "macro avg", "weighted avg"} < set(found)
    assert found["accuracy"].f1 == pytest.approx(found["weighted avg"].recall)


FILES = {
    "benign/normal.csv": "benign",
    "bruteForce/bruteForce.csv": "bruteForce",
    "ddos/Slowloris/slowloris_merged.csv": "ddos_slowloris",
    "ddos/TCP DDOS/tcp_ddos_merged.csv": "ddos_tcp_ddos",
    "pfcp/session_deletion/session_deletion_merged.csv": "pfcp_session_deletion",
    "pfcp/session_establishment/session_establishment_merged.csv": "pfcp_session_establishment",
    "pfcp/session_modification/session_modification.csv": "pfcp_session_modification",
    "ddos/other/x.csv": "ddos",
    "pfcp/x.csv": "pfcp",
    "Misc/x.csv": "misc",
    "ddos/slowloris tcp/x.csv": "ddos_slowloris",
    "": "unknown",
}


def test_label_from_path(spark):
    table = spark.createDataFrame([(p,) for p in FILES], "path string")
    found = {r.path: r.label for r in table.select("path", label_from_path(F.col("path")).alias("label")).collect()}
    assert found == FILES


def test_first_positions(spark):
    """Stacked classes start where the rows before them end."""
    blocks = [("client_1", "benign", 21060), ("client_1", "bruteForce", 30778), ("client_2", "benign", 21060),
              ("client_2", "ddos_tcp_ddos", 45033), ("client_2", "pfcp_session_deletion", 15296)]
    cells, start = [], {}
    for client, label, n in blocks:
        cells.append((client, label, start.get(client, 0), n))
        start[client] = start.get(client, 0) + n
    table = spark.createDataFrame(cells, "client string, label string, start int, n int")
    rows = table.select("client", "label", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("place"))
    found = {r["class"]: (r.client, r.position) for r in sampling.first_positions(rows, "label", ["place"], "client").collect()}
    assert found == {
        "benign": ("client_1", 0),
        "bruteForce": ("client_1", 21060),
        "ddos_tcp_ddos": ("client_2", 21060),
        "pfcp_session_deletion": ("client_2", 66093),
    }


def test_attribution_summary_of_one_and_of_many_outputs(spark):
    values = [(1, 0, "a", 0.5), (1, 1, "a", -0.25), (1, 2, "a", 0.0), (2, 0, "a", -0.75)]
    table = spark.createDataFrame(values, "index int, output int, feature string, value double")
    found = {r["index"]: r.abs_mean for r in explain.summary(table, ["index"]).collect()}
    assert found == {1: pytest.approx(0.25), 2: pytest.approx(0.75)}


def test_stratified_test_set_sizes(spark, rows):
    """2000 rows over 6 classes: the two largest classes give the two extra rows."""
    keyed = rows.withColumn("key", F.concat_ws("-", "label", "client", "number"))
    sizes = sampling.test_set(keyed, "label", ["key"], 2000).groupBy("label").count()
    assert {r.label: r["count"] for r in sizes.collect()} == {
        c: 334 if c in ("benign", "ddos_tcp_ddos") else 333 for c in COUNTS
    }
