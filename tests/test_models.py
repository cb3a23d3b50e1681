"""Training, scoring and attribution."""

from __future__ import annotations

import hashlib
import inspect
import itertools
import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from shardscope.operators import explain, forest, sampling, scoring, training, trees
from shardscope.plans import modelling

FEATURES = ["x", "y"]
MODEL = scoring.Linear([[1.0, -2.0], [0.5, 0.5], [-1.0, 1.0]], [0.1, 0.0, -0.1])


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(300).select(
        "id",
        F.concat(F.lit("client_"), (F.col("id") % 2 + 1).cast("string")).alias("client"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("label"),
        (F.col("id") % 3 - 1 + (F.col("id") % 7) / 20).cast("double").alias("x"),
        ((F.col("id") % 3 == 0).cast("double") + (F.col("id") % 5) / 20).alias("y"),
        F.lit(1.0).alias("weight"),
    )


def predictor():
    """A model in plain numpy; a closure, so that workers need not import this file."""
    coef, intercept = np.array(MODEL.coef).T, np.array(MODEL.intercept)

    def predict(matrix: np.ndarray) -> np.ndarray:
        z = matrix @ coef + intercept
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    return predict


predict = predictor()


def test_python_and_column_scorers_agree(rows):
    tables = [
        scoring.score(rows, s, FEATURES, ["id"], "label").orderBy("id").collect()
        for s in (scoring.linear_scorer(MODEL), scoring.python_scorer(predict))
    ]
    for a, b in zip(*tables):
        assert a.pred == b.pred and a.probs == pytest.approx(b.probs) and sum(a.probs) == pytest.approx(1)


@pytest.mark.parametrize("scorer", ["column", "python"])
def test_shapley_adds_up(rows, scorer):
    used = scoring.linear_scorer(MODEL) if scorer == "column" else scoring.python_scorer(predict)
    base = sampling.plain(rows, ["id"], 3, seed=0)
    values = explain.shapley(rows, used, FEATURES, ["id"], base, 2)
    sums = values.groupBy("id", "output").agg(F.sum("value").alias("total"))
    outputs = scoring.score(rows, used, FEATURES, ["id"]).select("id", F.posexplode("probs").alias("output", "p"))
    mean = scoring.score(base, used, FEATURES, ["id"]).select(F.posexplode("probs").alias("output", "p")).groupBy("output").agg(F.avg("p").alias("mean"))
    joined = sums.join(outputs, ["id", "output"]).join(mean, "output")
    assert joined.count() == 900
    assert joined.agg(F.max(F.abs(F.col("total") - F.col("p") + F.col("mean")))).first()[0] < 1e-12


def test_occlusion_of_one_row(rows):
    base = sampling.background(rows, ["id"])
    means = np.array(base.agg(F.avg("x"), F.avg("y")).first())
    row = rows.filter("id = 17")
    found = {r.feature: r for r in explain.occlusion(row, scoring.linear_scorer(MODEL), FEATURES, ["id"], base).collect()}
    own = np.array(row.select("x", "y").first())
    p = predict(own[None])[0]
    k = int(p.argmax())
    for j, name in enumerate(FEATURES):
        changed = own.copy()
        changed[j] = means[j]
        assert found[name].output == k
        assert found[name].value == pytest.approx(p[k] - predict(changed[None])[0][k])


def test_loss_falls_for_every_client(spark, rows):
    shape = training.Shape(FEATURES, ["a", "b", "c"])
    state = training.start(spark, rows, shape)
    first = training.local_steps(rows, shape, state, 0.5)
    later = training.local_steps(rows, shape, first, 0.5, 5)
    before, after = ({r.client: r.loss for r in s.collect()} for s in (first, later))
    assert set(before) == {"client_1", "client_2"}
    assert all(before[c] == pytest.approx(np.log(3)) and after[c] < before[c] for c in before)


@pytest.mark.parametrize("method", ["adaptive", "control"])
def test_rounds_learn_and_are_written_one_by_one(rows, method, tmp_path):
    shape = training.Shape(FEATURES, ["a", "b", "c"])
    sink = str(tmp_path / "history")
    history = training.run_rounds(rows, rows, shape, 3, method, 0.5, 2, held_out=rows, sink=sink).orderBy("round").collect()
    assert [r["round"] for r in history] == [1, 2, 3]
    assert history[2].loss < history[0].loss
    assert history[2].macro_f1_weighted > 0.3
    assert 0 <= history[2].central_macro_f1 <= 1
    assert rows.sparkSession.read.parquet(sink).count() == 3


def test_control_round_equals_numpy(spark):
    """Two clients, one parameter: the update written out by hand."""
    updates = spark.createDataFrame([("p", "coef", 0, 0.8, 0.1), ("q", "coef", 0, 0.2, -0.3)], "client string, layer string, idx int, y double, c_i double")
    state = spark.createDataFrame([("coef", 0, 0.5, 0.05)], "layer string, idx int, x double, c double")
    row = training.control_step(updates, state, 10, 0.01, 0.5).first()
    change = [(0.1 - 0.05 + (0.5 - 0.8) / 0.1) - 0.1, (-0.3 - 0.05 + (0.5 - 0.2) / 0.1) + 0.3]
    assert row.x == pytest.approx(0.5 + 0.5 / 2 * (0.3 - 0.3))
    assert row.c == pytest.approx(np.clip(0.05 + sum(change) / 2, -1, 1))


def test_components_and_forest(rows):
    parts = forest.principal_components(rows, "label", FEATURES, ["id"])
    shares = [r.ratio for r in parts.variance.orderBy("component").collect()]
    assert shares == sorted(shares, reverse=True) and sum(shares) == pytest.approx(1)
    means = parts.scores.select(F.posexplode("scores")).groupBy("pos").agg(F.avg("col")).collect()
    assert all(abs(r[1]) < 1e-9 for r in means)
    fitted = forest.proxy_forest(rows, "label", ["id"], FEATURES, ["client"], trees=5, depth=4)
    names = {r.feature: r.importance for r in fitted.importances.collect()}
    assert set(FEATURES) < set(names) and sum(names.values()) == pytest.approx(1)
    falls = {r.feature: r for r in forest.permutation_importance(fitted, ["id"], 3).collect()}
    assert set(falls) == {"x", "y", "client"}
    assert falls["x"].perm_importance_mean > falls["client"].perm_importance_mean
    assert fitted.table.count() == 5 and fitted.report.count() > 0
    model = forest.fit_numeric_forest(rows, "label", FEATURES, trees=5, depth=4)
    values = trees.attribute(rows, model, FEATURES, ["id"], sampling.plain(rows, ["id"], 2))
    assert values.count() == 300 * 2 * 3


def test_fitted_models_score_and_attribute(rows):
    """A Spark ML classifier as scorer, attributed over unfolded rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    coded = rows.select((F.col("id") % 3).cast("double").alias("code"), array_to_vector(F.array("x", "y")).alias("inputs"))
    model = RandomForestClassifier(featuresCol="inputs", labelCol="code", numTrees=3, maxDepth=3, seed=1).fit(coded)
    values = explain.shapley(rows, scoring.fitted_scorer(model), FEATURES, ["id"], sampling.plain(rows, ["id"], 2), 1)
    assert values.count() == 300 * 2 * 3


def grown(numbers, classes, n_trees, depth, codes=None, categories=()):
    codes = np.zeros((len(classes), 0)) if codes is None else codes
    return trees.Sample.build(numbers, codes, list(categories), classes, int(classes.max()) + 1), n_trees, depth


@pytest.mark.parametrize("depth", [3, None])
@pytest.mark.parametrize("dense, grid", [(trees.DENSE, 1 << 30), (trees.DENSE, 0), (0, 0)])
def test_attribution_equals_all_subsets(spark, monkeypatch, depth, dense, grid):
    """Six features, the definition of the Shapley value over all 64 subsets; by grids, by leaves, by patterns that occur."""
    monkeypatch.setattr(trees, "DENSE", dense)
    monkeypatch.setattr(trees, "GRID", grid)
    draw = np.random.default_rng(5)
    x = draw.integers(-3, 4, (300, 6)) / 4.0
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 3] > 0.25)
    sample, n, deep = grown(x, y, 6, depth)
    model = trees.Trees.load(trees.fit(spark, sample, n, deep, 3))
    base, rows = x[:5], x[50:54]
    attributor = trees.Attributor(model, base)
    assert (attributor.grids is None) == (grid == 0)
    found = attributor.values(rows)
    expected = np.zeros_like(found)
    subsets = list(itertools.product([False, True], repeat=6))
    for i, row in enumerate(rows):
        for z in base:
            outputs = dict(zip(subsets, model.probabilities(np.where(np.array(subsets), row, z))))
            for j in range(6):
                for s in subsets:
                    if not s[j]:
                        share = math.factorial(sum(s)) * math.factorial(5 - sum(s)) / math.factorial(6)
                        with_j = tuple(k == j or v for k, v in enumerate(s))
                        expected[i, :, j] += share * (outputs[with_j] - outputs[s]) / len(base)
    assert np.abs(found - expected).max() < 1e-9
    assert np.abs(found.sum(axis=2) - model.probabilities(rows) + model.probabilities(base).mean(axis=0)).max() < 1e-9


def test_trees_cut_where_impurity_falls_most():
    """One tree on all inputs against every cut of the root, and pure leaves when nothing bounds the depth."""
    draw = np.random.default_rng(2)
    x = draw.integers(0, 6, (80, 1)).astype(float)
    y = ((x[:, 0] > 2) ^ (draw.random(80) < 0.1)).astype(int)
    sample, _, _ = grown(x, y, 1, 1)
    tree = trees.grow(sample, [4, 0], 1)
    times = np.bincount(np.random.default_rng([4, 0]).integers(0, 80, 80), minlength=80).astype(float)
    weight = times * (80 / (2 * np.bincount(y, times, 2)))[y]

    def gini(part):
        w = np.array([weight[part & (y == k)].sum() for k in (0, 1)])
        return w.sum() - (w**2).sum() / w.sum() if w.sum() else 0.0

    falls = {c + 0.5: gini(np.ones(80, bool)) - gini(x[:, 0] <= c) - gini(x[:, 0] > c) for c in range(5)}
    assert tree["threshold"][0] == max(falls, key=falls.get) and tree["gain"][0] == pytest.approx(max(falls.values()))
    distinct = np.arange(60, dtype=float)[:, None]
    whole = trees.grow(trees.Sample.build(distinct, np.zeros((60, 0)), [], np.arange(60) % 3, 3), [1, 1], None)
    leaves = [whole["shares"][3 * i : 3 * i + 3] for i, c in enumerate(whole["column"]) if c < 0]
    assert all(max(v) == pytest.approx(1) for v in leaves)


def test_forest_reads_texts_and_missing_cuts(spark):
    draw = np.random.default_rng(8)
    codes = draw.integers(0, 3, (400, 1))
    sample, n, depth = grown(np.zeros((400, 1)), (codes[:, 0] == 1).astype(int), 8, 4, codes, [3])
    table = trees.fit(spark, sample, n, depth, 1)
    model = trees.Trees.load(table)
    probabilities = model.probabilities(np.array([[0.0, 0], [0.0, 1], [0.0, 2], [0.0, -1], [np.nan, 1]]))
    assert probabilities.argmax(axis=1).tolist() == [0, 1, 0, 0, 1]
    assert model.importances(*sample.slots).sum() == pytest.approx(1) and model.importances(*sample.slots)[0] == 0
    again = trees.Trees.load(trees.fit(spark, sample, n, depth, 1))
    assert all(np.array_equal(getattr(model, f), getattr(again, f)) for f in ("roots", "column", "threshold", "shares"))
    with pytest.raises(ValueError, match="numeric"):
        trees.Attributor(model, np.zeros((1, 2)))
    flat = trees.Trees.load(trees.fit(spark, trees.Sample.build(np.ones((9, 1)), np.zeros((9, 0)), [], np.zeros(9), 1), 2, 3, 1))
    assert flat.importances(np.array([0]), np.array([-1])).tolist() == [0.0]
    assert trees.Attributor(flat, np.ones((2, 1))).values(np.ones((3, 1))).tolist() == [[[0.0]]] * 3


def test_forests_too_large_to_send_are_refused(spark, monkeypatch):
    monkeypatch.setattr(trees, "MAX_NODES", 10)
    sample, n, depth = grown(np.arange(50, dtype=float)[:, None], np.arange(50) % 2, 4, None)
    with pytest.raises(ValueError, match="nodes"):
        trees.Trees.load(trees.fit(spark, sample, n, depth, 1))


def test_permuted_falls_equal_numpy(spark, rows):
    test = rows.select("id", (F.col("id") % 3).cast("int").alias("code"), F.array("x", "y").alias("inputs"))
    found = {r.feature: r for r in forest.permuted_falls(test, scoring.python_scorer(predict), FEATURES, ["id"], 3, seed=4).collect()}
    data = sorted((hashlib.md5(f"4|{r.id}".encode()).hexdigest(), r.id, r.code, r.inputs) for r in test.collect())
    code, x = np.array([d[2] for d in data]), np.array([d[3] for d in data])
    place = np.arange(300)
    for j, name in enumerate(FEATURES):
        falls = []
        for t in range(3):
            donor = (place * forest.PRIMES[t] + forest.SHIFT * (4 + t + 1)) % 300
            assert len(set(donor.tolist())) == 300
            mixed = x.copy()
            mixed[:, j] = x[donor, j]
            falls.append((predict(x).argmax(1) == code).mean() - (predict(mixed).argmax(1) == code).mean())
        assert found[name].perm_importance_mean == pytest.approx(np.mean(falls))
        assert found[name].perm_importance_std == pytest.approx(np.std(falls))
    assert forest.permuted_falls(test.limit(0), scoring.python_scorer(predict), FEATURES, ["id"]).count() == 0


def test_prompt_text(spark):
    attributions = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.25)], "id int, feature string, abs_mean double")
    predictions = spark.createDataFrame([(1, 3, "3", [0.1, 0.1, 0.1, 0.7])], "id int, pred int, true string, probs array<double>")
    names = ["benign", "bruteForce", "ddos_tcp_ddos", "pfcp_session_deletion"]
    text = explain.prompts(attributions, predictions, ["id"], names, 2, preamble="100% plain").first().prompt
    assert text.startswith("100% plain\n\nPredicted class: pfcp_session_deletion\nTrue class: pfcp_session_deletion\n")
    assert "- The prediction is right: True\n- Family: PFCP\n- Confidence: 70.0%" in text
    assert text.endswith("- a: importance 0.500000\n- b: importance 0.500000")


def test_loss_of_a_hopeless_row_is_large(spark):
    """A share that rounds to 0 costs much; it is not left out of the mean."""
    shape = training.Shape(["x"], ["a", "b"])
    rows = spark.createDataFrame([("c", "a", 1.0, 1.0), ("c", "b", 1.0, 1.0)], "client string, label string, weight double, x double")
    state = spark.createDataFrame([("c", [2000.0, 0.0, 0.0, 0.0], [0.0] * 4)], "client string, theta array<double>, shift array<double>")
    assert training.local_steps(rows, shape, state, 0.1).first().loss == pytest.approx(1000.0)
    assert training.test_loss(rows, shape, [2000.0, 0.0, 0.0, 0.0]) == pytest.approx(1000.0)
    with pytest.raises(Exception, match="unknown label"):
        training.local_steps(rows.replace("b", "zz"), shape, state, 0.1)


def test_walks_inside_tasks_equal_unfolded_ones(rows):
    base = sampling.plain(rows, ["id"], 3)
    scorer = scoring.linear_scorer(scoring.Linear([[1.0, -2.0], [0.5, 0.25]], [0.1, 0.0]))
    unfolded = lambda df, source, target: scorer(df, source, target)
    found, want = (
        {(r.id, r.output, r.feature): r.value for r in explain.shapley(rows, s, FEATURES[:2], ["id"], base).collect()} for s in (scorer, unfolded)
    )
    assert found == pytest.approx(want)
    with pytest.raises(ValueError):
        explain.shapley(rows, scorer, FEATURES[:2], ["id"], rows.crossJoin(rows.select("id").withColumnRenamed("id", "other")).limit(2000))


def test_registered_forest_has_the_operators_own_size(monkeypatch):
    taken = {}
    monkeypatch.setattr(modelling, "flow", lambda *a, **k: SimpleNamespace(drop=lambda *c: None))
    own = inspect.signature(forest.proxy_forest)
    monkeypatch.setattr(forest, "proxy_forest", lambda *a, **k: taken.update(own.bind(*a, **k).arguments))
    monkeypatch.setattr(modelling, "FORESTS", {})
    modelling._forest(SimpleNamespace(sparkContext=SimpleNamespace(applicationId="none")), "")
    assert {k: taken.get(k, own.parameters[k].default) for k in ("trees", "depth")} == {"trees": 400, "depth": 10}


def test_forests_score_by_cells_with_equal_outputs(spark):
    """Walked over bins, node by node in the order of the trees, and looked up when there are more rows than cells."""
    draw = np.random.default_rng(12)
    x, codes = draw.integers(0, 9, (500, 2)) / 8.0, draw.integers(0, 3, (500, 1))
    sample, n, depth = grown(x, (x[:, 0] > 0.5).astype(int) + (codes[:, 0] == 1), 9, 6, codes, [3])
    model = trees.Trees.load(trees.fit(spark, sample, n, depth, 1))
    odd = [[np.nan, 0.3, 1.0], [np.inf, -np.inf, 0.0], [0.5, 0.25, -1.0], [2.0, np.nan, 7.0], [0.1, 0.2, np.nan]]
    rows = np.concatenate([np.concatenate([x, codes], axis=1), odd])
    expected = np.zeros((len(rows), model.shares.shape[1]))
    for i, row in enumerate(rows):
        for at in model.roots.tolist():
            while model.column[at] >= 0:
                value, category = row[model.column[at]], model.category[at]
                at = model.left[at] if (value <= model.threshold[at] if category < 0 else value != category) else model.right[at]
            expected[i] += model.shares[at]
    expected /= len(model.roots)
    cells = trees.Cells.of(model)
    walked, looked_up = trees.scorer(spark, model), trees.scorer(spark, model, cells.count)
    assert np.array_equal(walked.matrix(rows), expected) and np.array_equal(looked_up.matrix(rows), expected)


def test_rows_are_not_brought_together_by_label(spark, tmp_path):
    folder = str(tmp_path)
    spark.sql("SELECT id AS s_suppkey, id % 2 AS s_nationkey FROM range(4)").write.parquet(f"{folder}/supplier.parquet")
    spark.sql("SELECT id AS n_nationkey, id AS n_regionkey FROM range(2)").write.parquet(f"{folder}/nation.parquet")
    spark.sql("SELECT id AS r_regionkey, concat('R', id) AS r_name FROM range(2)").write.parquet(f"{folder}/region.parquet")
    spark.sql(
        """SELECT id AS l_orderkey, 1 AS l_linenumber, id AS l_partkey, id % 4 AS l_suppkey, 1.0D + id % 50 AS l_quantity, 10.0D * id AS l_extendedprice,
                  0.01D AS l_discount, 0.02D AS l_tax, if(id % 3 = 0, 'A', if(id % 3 = 1, 'N', NULL)) AS l_returnflag, 'O' AS l_linestatus FROM range(60)"""
    ).write.parquet(f"{folder}/lineitem.parquet")
    found = modelling._weighted_clients(spark, folder)
    assert "hashpartitioning(label" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.label, r.weight) for r in found.collect()} == {("A", 1.0), ("N", 1.0)} and found.count() == 40


def test_attributions_of_a_row_stay_one_row(spark):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 7, (200, 2)) / 4.0
    sample, n, depth = grown(x, (x[:, 0] > 0.5).astype(int) + (x[:, 1] > 1), 4, 3)
    model = trees.Trees.load(trees.fit(spark, sample, n, depth, 1))
    table = spark.createDataFrame([(i % 30, float(a), float(b)) for i, (a, b) in enumerate(x.tolist()[:40])], "id int, a double, b double")
    base = table.limit(5)
    rows = trees.attribute_rows(table, model, ["a", "b"], ["id"], base)
    assert rows.count() == 40 and {len(r.attribution) for r in rows.collect()} == {2 * model.shares.shape[1]}
    long = trees.attribute(table, model, ["a", "b"], ["id"], base)
    assert long.count() == 40 * 2 * model.shares.shape[1]
    wide = sorted((r.id, k // 2, "ab"[k % 2], v) for r in rows.collect() for k, v in enumerate(r.attribution))
    assert wide == sorted((r.id, r.output, r.feature, r.value) for r in long.collect())
    none = trees.attribute(table, model, ["a", "b"], ["id"], base.limit(0))
    assert none.filter("value is null").count() == long.count()


@pytest.mark.parametrize("total", [30, 61, 1000])
@pytest.mark.parametrize("solo", [False, True])
def test_fitting_and_test_rows_are_those_of_split_and_sample(spark, total, solo):
    """Classes of very different size, one without a label; with a class of one row nothing is stratified."""
    label = "CASE WHEN id % 7 = 0 THEN NULL WHEN id < 4 THEN 'few' WHEN id % 5 = 1 THEN 'b' ELSE 'a' END"
    if solo:
        label = f"CASE WHEN id = 9 THEN 'solo' ELSE {label} END"
    rows = spark.range(300).selectExpr("IF(id = 11, NULL, id) AS id", f"{label} AS label", "id * 0.5D AS x")
    whole = sampling.split(rows.filter("label IS NOT NULL"), "label", ["id"], 0.2, 7)
    drawn = sampling.stratified(whole.filter("NOT is_test").drop("is_test"), "label", ["id"], total, 0, 7)
    found = sampling.fitting_and_test(rows, "label", ["id"], 0.2, total, 7)
    want = drawn, whole.filter("is_test").drop("is_test")
    assert [sorted(map(str, f.collect())) for f in found] == [sorted(map(str, w.collect())) for w in want]
    assert found[0].columns == found[1].columns == rows.columns and found[1].count() == 52


def test_fitting_and_test_rows_need_a_key(spark):
    twice = spark.range(100).selectExpr("id DIV 2 AS id", "'a' AS label").unionByName(spark.range(100).selectExpr("id + 100 AS id", "'b' AS label"))
    with pytest.raises(Exception, match="does not identify"):
        sampling.fitting_and_test(twice, "label", ["id"], 0.05, 30)


def test_a_forest_hashes_the_table_twice(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        seen.add(1)
        return i

    fitted = forest.proxy_forest(rows.select(counted("id").alias("id"), "label", *FEATURES), "label", ["id"], FEATURES, trees=2, depth=2)
    assert fitted.test.count() == 60
    assert seen.value == 2 * 300


def test_rows_are_scored_as_arrow_batches(spark):
    """No row becomes a Python object: outputs as by matrix, missing inputs are NaN, missing outputs NULL, uneven rows an error."""
    used = scoring.python_scorer(lambda x: np.stack([x.sum(axis=1), x[:, 0] * 2], axis=1))
    rows = spark.range(0, 30_000, 1, 2).selectExpr("id", "array(id * 1D, if(id % 9 = 0, NULL, 0.5D)) AS inputs")
    found = used(rows, "inputs", "probs")
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_UDF}" in found._jdf.queryExecution().executedPlan().toString()
    assert all(r.probs == [None if r.id % 9 == 0 else r.id + 0.5, 2.0 * r.id] for r in found.collect())
    assert used(rows.limit(0), "inputs", "probs").count() == 0
    for uneven in ("if(id = 3, NULL, inputs)", "if(id = 3, array(1D), inputs)"):
        with pytest.raises(Exception, match="same number of features"):
            used(rows.selectExpr(f"{uneven} AS inputs"), "inputs", "probs").agg(F.count("probs")).collect()


def test_prompts_of_many_rows_are_not_broadcast(spark):
    """Neither side goes through the driver; repeated keys meet as in any join, and a missing key meets nothing."""
    keyed = spark.range(0, 400, 1, 3).selectExpr("IF(id = 7, NULL, IF(id = 9, 8, id)) AS id")
    attributions = keyed.selectExpr("id", "explode(array('a', 'b')) AS feature").distinct().selectExpr("*", "IF(feature = 'a', 0.25D, 0.5D) AS abs_mean")
    predictions = keyed.selectExpr("id", "1 AS pred", "'0' AS true", "array(0.25D, 0.75D) AS probs")
    found = explain.prompts(attributions, predictions, ["id"], ["x", "y"])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert sorted(r.id for r in rows) == sorted([i for i in range(400) if i not in (7, 9)] + [8])
    assert {r.prompt.split("Confidence: ")[1] for r in rows} == {
        "75.0%\n\nFeatures that moved the prediction most:\n- b: importance 0.500000\n- a: importance 0.250000"
    }


@pytest.mark.parametrize("solo", [False, True])
def test_without_a_total_all_training_rows_fit(spark, solo):
    label = "CASE WHEN id % 7 = 0 THEN NULL WHEN id < 4 THEN 'few' WHEN id % 5 = 1 THEN 'b' ELSE 'a' END"
    if solo:
        label = f"CASE WHEN id = 9 THEN 'solo' ELSE {label} END"
    rows = spark.range(300).selectExpr("IF(id = 11, NULL, id) AS id", f"{label} AS label", "id * 0.5D AS `x.y`")
    whole = sampling.split(rows.filter("label IS NOT NULL"), "label", ["id"], 0.2, 7)
    found = sampling.fitting_and_test(rows, "label", ["id"], 0.2, seed=7)
    want = whole.filter("NOT is_test").drop("is_test"), whole.filter("is_test").drop("is_test")
    assert [sorted(map(str, f.collect())) for f in found] == [sorted(map(str, w.collect())) for w in want]
    assert found[0].columns == found[1].columns == rows.columns


def counted_rows(spark):
    """Many equal rows, a number of more than 128 values, one without any value, a text."""
    rows = spark.range(0, 4000, 1, 3).selectExpr(
        "CAST(id % 3 = 0 OR id % 1000 < 300 AS INT) AS code",
        "array(CAST(id % 1000 AS DOUBLE), CAST(id % 5 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(id % 2 AS DOUBLE)) AS inputs",
    )
    found = sorted((r.code, r.inputs) for r in rows.collect())
    x = np.array([[np.nan if v is None else v for v in i] for _, i in found])
    return rows, x, np.array([c for c, _ in found])


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_counted_cells_hold_all_rows(spark, monkeypatch, block):
    """The same bins as those of the rows themselves, however they are dealt into blocks."""
    monkeypatch.setattr(forest, "BLOCK", block)
    rows, x, y = counted_rows(spark)
    counted = forest._counted(rows, 3, [2])
    sample = trees.Sample.build(x[:, :3], x[:, 3:].astype(int), [2], y, 2)
    assert [c.tolist() for c in counted.cuts] == [c.tolist() for c in sample.cuts]
    assert (len(counted.blocks) > 1) == (block == 600) and counted.sizes.sum() == 4000 and counted.n_classes == 2
    found = Counter()
    for sent in counted.blocks:
        bins, classes, counts = sent.value
        found.update({(c, *b): n for c, b, n in zip(classes.tolist(), bins.tolist(), counts.tolist())})
    assert found == Counter(zip(y.tolist(), *sample.bins.T.tolist())) and len(found) == counted.cells


@pytest.mark.parametrize("depth", [1, 6, None])
def test_counted_trees_cut_where_impurity_falls_most(spark, monkeypatch, depth):
    """All nodes of a tree that tries all inputs against the rows drawn, and equal trees however cells are held and counted."""
    monkeypatch.setattr(forest, "BLOCK", 600)
    monkeypatch.setattr(trees, "math", SimpleNamespace(sqrt=lambda n: n))
    counted = forest._counted(counted_rows(spark)[0], 3, [2])
    tree = trees.grow_counted(counted, [4, 0], depth)
    drawn = list(trees._Drawn(counted, [4, 0], np.random.default_rng([4, 0])))
    bins, y, times = (np.concatenate([d[i] for d in drawn]) for i in range(3))
    assert times.sum() == 4000
    weight = times * (4000 / (2 * np.bincount(y, times, 2)))[y]

    def gini(part):
        w = np.bincount(y[part], weight[part], 2)
        return w.sum() - (w**2).sum() / w.sum() if w.sum() else 0.0

    def sides(column, threshold, category):
        return bins[:, column] != category if category >= 0 else bins[:, column] <= np.searchsorted(counted.cuts[column], threshold)

    open_, cut = [(0, np.ones(len(y), bool))], 0
    while open_:
        node, part = open_.pop()
        shares = np.bincount(y[part], weight[part], 2)
        assert tree["shares"][2 * node : 2 * node + 2] == pytest.approx(shares / shares.sum())
        if tree["column"][node] < 0:
            continue
        cut += 1
        left = sides(tree["column"][node], tree["threshold"][node], tree["category"][node])
        falls = [gini(part) - gini(part & s) - gini(part & ~s) for j, c in enumerate(counted.cuts) for s in (sides(j, t, -1) for t in c)]
        falls += [gini(part) - gini(part & s) - gini(part & ~s) for s in (sides(3, 0, c) for c in range(2))]
        assert tree["gain"][node] == pytest.approx(max(falls)) == pytest.approx(gini(part) - gini(part & left) - gini(part & ~left))
        open_ += [(tree["left"][node], part & left), (tree["right"][node], part & ~left)]
    assert cut == 1 if depth == 1 else cut > 3
    monkeypatch.setattr(trees, "HELD", 0)
    monkeypatch.setattr(trees, "CUT_COUNTS", 1)
    assert trees.grow_counted(counted, [4, 0], depth) == tree
    monkeypatch.setattr(trees, "math", math)
    assert trees.fit(spark, counted, 1, depth, 4).first().threshold == trees.grow_counted(counted, [4, 0], depth)["threshold"]


def test_all_training_rows_fit_a_forest(spark, rows, monkeypatch):
    """More rows than travel: bootstraps draw from all 240 training rows, in equal trees whatever the blocks are cached as."""
    seen, own = [], forest.fit
    monkeypatch.setattr(forest, "fit", lambda s, sample, *a: seen.append(sample) or own(s, sample, *a))
    monkeypatch.setattr(forest, "FOREST_ROWS", 50)
    fitted = forest.proxy_forest(rows, "label", ["id"], FEATURES, ["client"], trees=5, depth=4)
    assert seen[0].sizes.sum() == 240 and fitted.test.count() == 60 and fitted.table.count() == 5
    falls = {r.feature: r.perm_importance_mean for r in forest.permutation_importance(fitted, ["id"], 3).collect()}
    assert falls["x"] > falls["client"]
    monkeypatch.setattr(forest, "MAX_TEXTS", 1)
    with pytest.raises(ValueError, match="texts"):
        forest.proxy_forest(rows, "label", ["id"], FEATURES, ["client"], trees=5, depth=4)
