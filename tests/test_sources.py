"""CSV trees, client folders, contracts and weights, written to fresh temporary folders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from shardscope.functions.labels import MODEL_CLASSES
from shardscope.sources import contract, readers, sinks


@pytest.fixture
def tree(tmp_path):
    files = {
        "benign/normal.csv": "a,b\n1,2\n3,\n",
        "ddos/TCP DDOS/tcp+1.csv": "label,b,a\n0.5,x,5\n",
        "pfcp/x.csv": "a,b\n7,8\n",
        "Misc/note.txt": "not a table\n",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path


def test_files_meet_by_name(spark, tree):
    table = readers.read_tree(spark, str(tree))
    found = {(r["__source_file"], r.a): (r["__label"], r.b, r.label) for r in table.collect()}
    assert found == {
        ("benign/normal.csv", 1): ("benign", "2", None),
        ("benign/normal.csv", 3): ("benign", None, None),
        ("ddos/TCP DDOS/tcp+1.csv", 5): ("ddos_tcp_ddos", "x", 0.5),
        ("pfcp/x.csv", 7): ("pfcp", "8", None),
    }


def test_given_types_replace_inference(spark, tree):
    table = readers.read_tree(spark, "file://" + str(tree), types={"a": "bigint", "b": "double", "label": "double"})
    assert dict(table.dtypes)["b"] == "double"
    assert table.agg(F.sum("a"), F.count("b")).first() == (16, 2)


def test_one_header_per_folder(spark, tmp_path):
    for folder, text in (("benign", "a,b\n1,2\n"), ("pfcp", "b,a\n3,4\n")):
        (tmp_path / folder).mkdir()
        for name in ("x.csv", "y.csv"):
            (tmp_path / folder / name).write_text(text)
    table = readers.read_tree(spark, str(tmp_path))
    assert sorted((r["__label"], r.a, r.b) for r in table.collect()) == [("benign", 1, 2)] * 2 + [("pfcp", 4, 3)] * 2
    (tmp_path / "pfcp" / "z.csv").write_text("a,b\n5,6\n")
    with pytest.raises(Exception, match="header does not conform"):
        readers.read_tree(spark, str(tmp_path), types={}).collect()
    assert readers.read_tree(spark, str(tmp_path), same_header_per_folder=False).agg(F.sum("a")).first()[0] == 15


@pytest.mark.parametrize("narrow", ["select", "count", "clients"])
def test_another_header_fails_under_any_select(spark, tmp_path, narrow):
    """A file with one more column is not read without it; looked at on its own, its column is there."""
    first = "__label" if narrow == "clients" else "w"
    (tmp_path / "client_1.csv").write_text(f"{first},x,y\na,1,2\n")
    (tmp_path / "client_2.csv").write_text(f"{first},x,y,z\nb,3,4,5\n")
    read = {
        "select": lambda each: readers.read_tree(spark, str(tmp_path), types={}, same_header_per_folder=not each).select("x"),
        "count": lambda each: readers.read_tree(spark, str(tmp_path), types={}, same_header_per_folder=not each).groupBy().count(),
        "clients": lambda each: readers.read_clients(spark, str(tmp_path), types={}, same_header_per_folder=not each).select("client"),
    }[narrow]
    with pytest.raises(Exception, match="(?i)header|CSV"):
        read(False).collect()
    assert len(read(True).collect()) == (1 if narrow == "count" else 2)
    union = readers.read_clients(spark, str(tmp_path), label=first, same_header_per_folder=False)
    assert union.columns[-1] == "z" or "z" in union.columns


def test_file_index(spark, tree):
    found = {r.rel: r.label for r in readers.file_index(spark, str(tree)).collect()}
    assert found == {"benign/normal.csv": "benign", "ddos/TCP DDOS/tcp+1.csv": "ddos_tcp_ddos", "pfcp/x.csv": "pfcp"}


def test_empty_tree_fails(spark, tmp_path):
    (tmp_path / "x.txt").write_text("")
    with pytest.raises(FileNotFoundError):
        readers.read_tree(spark, str(tmp_path))
    with pytest.raises(ValueError, match="absolute"):
        readers.file_index(spark, "some/folder")


def test_clients_by_file_name(spark, tmp_path):
    (tmp_path / "client_1.csv").write_text("__label,x\na,1\nb,2\n")
    (tmp_path / "client_2.csv").write_text('x,__label,note\n3,a,"two\n"\n')
    (tmp_path / "other.csv").write_text("x\n1\n")
    table = readers.read_clients(spark, str(tmp_path), same_header_per_folder=False)
    assert {r.client: r["count"] for r in table.groupBy("client").count().collect()}["client_1"] == 2
    assert readers.read_client(spark, str(tmp_path), "client_1").count() == 2
    with pytest.raises(ValueError, match="__label"):
        readers.read_clients(spark, str(tmp_path), "other.csv")


def test_contract(spark, tmp_path):
    path = tmp_path / "schema.json"
    path.write_text(json.dumps({"label_col": "__label", "feature_cols": ["y", "x"]}))
    loaded = contract.load_contract(spark, str(path))
    table = spark.createDataFrame([("a", 1.5, 2)], "__label string, x double, y int")
    out = contract.apply_contract(table, loaded)
    assert out.dtypes == [("__label", "string"), ("y", "float"), ("x", "float")]
    with pytest.raises(ValueError, match="missing"):
        contract.apply_contract(table.drop("y"), loaded)


def test_class_weights_in_three_shapes(spark):
    weights = {c: 0.5 * i + 1 for i, c in enumerate(MODEL_CLASSES)}
    texts = [json.dumps(list(weights.values())), json.dumps(weights), json.dumps({"label_counts": {"benign": 3}, "label_weights": weights})]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = contract.class_weight_rows(table, "text", MODEL_CLASSES, ["id"]).collect()
    assert len(rows) == 18 and all(r.weight == weights[r.label] for r in rows)


def test_missing_class_weight_fails(spark):
    table = spark.createDataFrame([('{"benign": 1}',)], "text string")
    with pytest.raises(Exception, match="no weight for class"):
        contract.class_weight_rows(table, "text", MODEL_CLASSES).collect()


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([("a", 1)], "label string, n int")
    sinks.write_csv(table, str(tmp_path / "c"))
    sinks.write_json(table, str(tmp_path / "j"))
    sinks.write_parquet(table, str(tmp_path / "p"), by=("label",))
    assert spark.read.parquet(str(tmp_path / "p")).first().n == 1
    with pytest.raises(Exception, match="already exists"):
        sinks.write_csv(table, str(tmp_path / "c"))
