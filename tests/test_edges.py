"""Edge frames: missing, infinite, constant, tied, empty and skewed inputs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardscope.functions.scalars import argmax, hash_order
from shardscope.functions.tails import beta_share, gamma_tail
from shardscope.operators import clean, clients, evaluate, features, forest, profile, quantiles, relate, sampling, totals
from shardscope.operators.quantiles import exact_quantiles

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        ("a", 1.0, None, 5.0, 1.0, NAN),
        ("a", 2.0, None, 5.0, INF, 0.0),
        ("a", 3.0, None, 5.0, 2.0, -0.0),
        ("b", 4.0, None, 5.0, -INF, 1.0),
        ("b", 5.0, None, 5.0, 3.0, None),
    ]
    return spark.createDataFrame(rows, "label string, x double, nothing double, same double, wild double, holes double")


def by_feature(df, *key):
    return {tuple(r[k] for k in (*key, "feature")): r for r in df.collect()}


def test_quantiles_match_the_builtin(spark):
    """Many ties, one hot value, and brackets so coarse that they are narrowed again."""
    rows = spark.range(20_000).select(
        (F.col("id") % 3).cast("string").alias("label"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_000)) / 7.0).alias("x"),
        (F.col("id") % 5).cast("double").alias("y"),
    )
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for by in ([], ["label"]):
        want = rows.groupBy(*by).agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in "xy"]).collect()
        expected = {(*[r[b] for b in by], c, p): r[c][i] for r in want for c in "xy" for i, p in enumerate(probs)}
        for options in ({}, {"accuracy": 200, "max_survivors": 300}, {"accuracy": 50}, {"accuracy": 20, "max_survivors": 50}):
            got = exact_quantiles(rows, ["x", "y"], probs, by, **options).collect()
            assert {(*[r[b] for b in by], r.feature, r.prob): r.value for r in got} == pytest.approx(expected)


def test_quantiles_of_nothing_are_null(odd):
    found = by_feature(exact_quantiles(odd, ["nothing", "wild"], [0.5]))
    assert found["nothing",].value is None and found["nothing",].n == 0
    assert found["wild",].value == 2.0 and found["wild",].n == 3


def test_quantiles_of_an_unnamed_group(spark):
    table = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    found = exact_quantiles(table, ["x"], [0.5], ["g"]).collect()
    assert {r.g: r.value for r in found} == {None: 2.0, "a": 5.0}


def test_a_missed_bracket_is_widened(spark):
    """Brackets without any width miss their ranks at first."""
    rows = spark.range(30_000).select((F.pmod(F.xxhash64("id"), F.lit(9_973)) / 3.0).alias("x"))
    want = rows.agg(F.percentile("x", F.array(F.lit(0.3), F.lit(0.77)))).first()[0]
    found = exact_quantiles(rows, ["x"], [0.3, 0.77], accuracy=100, margin=1e-9).orderBy("prob").collect()
    assert [r.value for r in found] == pytest.approx(want)


@pytest.mark.parametrize("by", [[], ["label"]])
def test_median_deviation_folds_the_sketch(spark, monkeypatch, by):
    """Long groups whose brackets are cut, against numpy; then the same through the path for very many groups."""
    rows = spark.range(40_000).select(
        (F.col("id") % 2).cast("string").alias("label"),
        (F.pmod(F.xxhash64("id"), F.lit(9_973)) / 7.0 - F.col("id") % 3 * 100).alias("x"),
        F.when(F.col("id") % 3 > 0, F.floor(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5))).cast("double")).alias("y"),
    )
    held = rows.toPandas()
    expected = {}
    for key, part in [((), held)] if not by else [((k,), v) for k, v in held.groupby("label")]:
        for c in "xy":
            v = part[c].dropna().to_numpy()
            expected[*key, c] = (len(v), *np.percentile(v, [25, 50, 75]), np.median(np.abs(v - np.median(v))), v.mean())
    for accuracy, cells in ((200, 2_000_000), (quantiles.ACCURACY, 2_000_000), (quantiles.ACCURACY, 0)):
        monkeypatch.setattr(quantiles, "MAX_CELLS", cells if by else 2_000_000)
        found = quantiles.order_statistics(rows, ["x", "y"], [0.25, 0.5, 0.75], by, True, True, accuracy).collect()
        assert {(*[r[b] for b in by], r.feature): (r.n, *r["values"], r.mad, r["mean"]) for r in found} == {k: pytest.approx(v) for k, v in expected.items()}


def test_brackets_hold_few_values(spark):
    """The second scan of a long table keeps a small share of it, and counts the rest."""
    rows = spark.range(200_000).select(F.lit(0).alias("group_key"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 3.0).alias("v0"), F.lit(0).alias("g"))
    found = quantiles._sketch(rows, 1, [0.5], 2e-4, True, False, quantiles.ACCURACY).toArrow().to_pylist()
    brackets = quantiles._brackets(found, np.array([[200_000]]), [0.5], 2e-4, True, quantiles.ACCURACY)
    kept = quantiles._kept(rows, brackets, 1)
    sizes = {r.slot: r.n for r in kept.where("value IS NOT NULL").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    assert 0 < sizes[0] < 400 and 0 < sizes[1] < 2_000


def test_tables_without_rows(spark, odd):
    """Empty slices are common: every operator that stands on percentiles answers with NULL or with no rows."""
    none, numbers = odd.limit(0), ["x", "holes"]
    assert [(r.feature, r.n, r.value) for r in exact_quantiles(none, numbers, [0.5]).orderBy("feature").collect()] == [("holes", 0, None), ("x", 0, None)]
    assert exact_quantiles(none, numbers, [0.5], ["label"]).count() == 0
    assert {(r["count"], r.median, r.mad, r["mean"]) for r in profile.robust_stats(none, numbers).collect()} == {(0, None, None, None)}
    assert profile.robust_stats(none, numbers, "label").count() == 0
    assert {r.mad for r in profile.mad(none, numbers).collect()} == {None} and profile.mad(none, numbers, "label").count() == 0
    assert clean.robust_scale(none, numbers).count() == 0 and clean.impute_median(none, numbers).count() == 0
    filled = clean.impute_median(odd, numbers, fitted_on=none)
    assert filled.count() == odd.count() and filled.filter("x is null").count() == odd.filter("x is null").count()
    assert {r.x for r in clean.robust_scale(odd, ["x"], fitted_on=none).collect()} == {None}
    assert clean.robust_scale_per_client(none.withColumnRenamed("label", "client"), numbers).count() == 0
    assert relate.mutual_info(none, "label", numbers).count() == 0
    assert relate.anova(none, "label", numbers).count() == 0
    assert relate.pearson(none, numbers).filter("r <> 0").count() == 0
    assert clients.ks_drift(none, {"c": ["a"]}, "label", numbers).count() == 0
    found = forest.principal_components(none.withColumn("id", F.lit(1)), "label", numbers, ["id"])
    assert found.variance.count() == 0 and found.scores.count() == 0
    with pytest.raises(ValueError, match="labelled rows"):
        forest.fit_numeric_forest(none, "label", numbers)


def test_drift_of_filled_cells(spark):
    """Missing cells count as the global median, which may lie between two values; against the plain definition."""
    draw = np.random.default_rng(3)
    rows = [(["a", "b", "c"][i % 3], None if draw.random() < 0.3 else float(draw.integers(0, 8)) + (0.25 if i % 3 == 0 else 0), float(i % 4) if i % 2 else None) for i in range(90)]
    rows += [("a", None, 1.0)] * 20
    table = spark.createDataFrame(rows, "label string, x double, y double")
    held = table.toPandas()
    holders = {"one": ["a"], "two": ["b", "c"]}
    expected = {}
    for f in "xy":
        v = held[f].fillna(held[f].median())
        points = np.sort(v.unique())
        for client, labels in holders.items():
            own = v[held.label.isin(labels)]
            expected[client, f] = max(abs((v <= p).mean() - (own <= p).mean()) for p in points)
    found = {(r.client, r.feature): r.ks_stat for r in clients.ks_drift(table, holders, "label").collect()}
    assert found == {k: pytest.approx(v) for k, v in expected.items()}


def test_neighbour_estimate_equals_brute_force(spark):
    """2,000 rows, all pairs; ties, a constant, a class of one row, and many small range partitions."""
    draw = np.random.default_rng(11)
    size = 2_000
    label = np.where(np.arange(size) == 5, "lone", draw.choice(["a", "b", "c"], size, p=[0.6, 0.3, 0.1]))
    x = draw.integers(0, 1 << 20, size) / 1024 + (label == "a") * 300.0
    columns = {"x": x, "tied": np.floor(x / 64), "same": np.ones(size), "noise": draw.integers(0, 1 << 16, size) / 256}
    psi = {n: -0.5772156649015329 + sum(1 / i for i in range(1, n)) for n in range(1, size + 1)}
    expected = {}
    for name, v in columns.items():
        total = []
        for c in "abc":
            own = np.flatnonzero(label == c)
            for i in own:
                away = np.sort(np.abs(v[own] - v[i]))
                k = min(3, len(own) - 1)
                r = away[k]
                others = np.abs(v[label != "lone"] - v[i])
                total.append(psi[k] - psi[len(own)] - psi[int((others < r).sum() if r > 0 else (others == 0).sum())])
        expected[name] = max(psi[len(total)] + np.mean(total), 0)
    rows = [(str(a), *map(float, b)) for a, b in zip(label, zip(*columns.values()))]
    table = spark.createDataFrame(rows, "label string, " + ", ".join(f"{c} double" for c in columns))
    found = {r.feature: r.mutual_info for r in relate.neighbour_info(table, "label").collect()}
    assert found == {c: pytest.approx(v, abs=1e-9) for c, v in expected.items()} and found["x"] > 0.1
    spread = {r.feature: r.mutual_info for r in relate.neighbour_info(table.limit(60), "label", ["x", "same"], 5).collect()}
    assert set(spread) == {"x", "same"} and relate.neighbour_info(table.limit(0), "label").count() == 0


def test_rank_correlation_of_scattered_gaps(spark):
    """Every column misses in rows of its own, so ranks differ from pair to pair; against ranks among the common rows."""
    draw = np.random.default_rng(4)
    values = draw.integers(0, 9, (300, 7)).astype(float)
    values[:, 1] += values[:, 0]
    values[:, 6] = 2.0
    values[draw.random(values.shape) < 0.3] = np.nan
    values[:, 3] = np.where(np.isnan(values[:, 2]), np.nan, draw.integers(0, 50, 300))
    names = [f"c.{i}" for i in range(7)]
    table = spark.createDataFrame([(i, *[None if np.isnan(x) else float(x) for x in row]) for i, row in enumerate(values)], "id int, " + ", ".join(f"`{n}` double" for n in names))

    def ranks(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    expected = {}
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            on = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
            x, y = ranks(values[on, i]), ranks(values[on, j])
            expected[a, b] = np.corrcoef(x, y)[0, 1] if x.std() > 0 and y.std() > 0 else 0.0
    found = {(r.a, r.b): r.r for r in relate.spearman(table, ["id"], names).collect()}
    assert found == {k: pytest.approx(v, abs=1e-9) for k, v in expected.items()}


def test_codes_of_keys_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(clean, "FEW", 2)
    draw = np.random.default_rng(6)
    odd_numbers = [None, 0.0, -0.0, 1.0, -1.0, 1e-300, -1e-300, 1e300, 0.1, 0.10000000000000002, 99.0, 100.0, INF, -INF, NAN]
    texts = [None, "", "a", "a ", "ab", "b", "\u00e9", "zz"]
    rows = [(odd_numbers[i % 15], texts[i % 8], int(draw.integers(-(1 << 62), 1 << 62)), i) for i in range(240)]
    table = spark.createDataFrame(rows, "x double, t string, k long, i int")
    for key in (["x", "t", "k"], ["t", "x", "i"], ["k"]):
        whole = [r.i for r in table.orderBy(*[F.col(c).asc_nulls_first() for c in key]).collect()]
        for position in (0, 1, 117, 239):
            assert clean.row_at(table, key, position).first().i == whole[position]
    days = spark.sql("SELECT date_add(date'1969-12-25', cast(id AS int)) AS d, id FROM range(20)")
    assert clean.row_at(days, ["d"], 9).first().id == 9
    with pytest.raises(TypeError, match="no code"):
        clean.row_at(spark.sql("SELECT array(1) AS a"), ["a"], 0)


def test_missing_counts(odd):
    found = by_feature(profile.missingness(odd))
    assert found["nothing",].missing_pct == 100 and found["nothing",].nunique_non_null == 0
    assert found["holes",].missing_count == 2 and found["holes",].nunique_non_null == 2
    assert found["wild",].missing_count == 0 and found["wild",].nunique_non_null == 5


def test_missing_is_not_zero(odd):
    found = by_feature(profile.zero_rates(odd))
    assert found["holes",].zero_pct == 40 and found["nothing",].zero_pct == 0


def test_constant_columns(odd):
    found = {r.feature: r.kind for r in profile.constants(odd).collect()}
    assert found == {"nothing": "constant", "same": "constant"}


def test_no_constant_column_gives_an_empty_table(spark):
    table = profile.constants(spark.range(10).select("id"))
    assert table.count() == 0 and table.columns == ["feature", "kind", "top_fraction", "nunique"]


def test_missing_counts_as_value_for_constants(spark):
    table = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert profile.constants(table).count() == 0


def test_robust_stats_of_odd_columns(odd):
    found = by_feature(profile.robust_stats(odd))
    assert found["nothing",]["count"] == 0 and found["nothing",].mean is None
    assert found["wild",]["count"] == 3 and found["wild",]["mean"] == 2.0
    assert found["same",].std == 0 and found["same",].iqr == 0 and found["same",].mad == 0
    assert found["x",].mad == 1.0 and found["x",]["var"] == 2.0


def test_zero_iqr_divides_by_one(spark):
    table = spark.createDataFrame([(5.0,)] * 9 + [(9.0,)], "x double")
    assert clean.robust_scale(table, ["x"]).agg(F.max("x")).first()[0] == 4.0


def test_per_client_scale_with_flat_and_empty_clients(spark):
    rows = [("flat", 5.0), ("flat", 5.0), ("flat", 5.0), ("none", None), ("wide", 1.0), ("wide", 3.0), (None, 2.0)]
    table = spark.createDataFrame(rows, "client string, x double")
    found = [(r.client, r.x) for r in clean.robust_scale_per_client(table, ["x"]).collect()]
    assert sorted(found, key=str) == sorted(
        [("flat", 0.0)] * 3 + [("none", None), ("wide", -1.0), ("wide", 1.0), (None, 0.0)], key=str
    )


def test_most_frequent_takes_the_smallest_on_ties(spark):
    table = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("a",)], "t string")
    assert clean.most_frequent(table, ["t"]) == {"t": "a"}


def test_duplicates_treat_missing_as_equal(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, None, "x"), (3, 1.0, "y")]
    table = spark.createDataFrame(rows, "id int, v double, t string")
    found = profile.duplicates(table, ["id"]).first()
    assert (found.exact_duplicate_rows, found.duplicate_rows_excluding_cols) == (1, 2)


def test_unknown_label_fails(spark):
    table = spark.createDataFrame([("a",), ("z",)], "label string")
    with pytest.raises(Exception, match="unknown label: z"):
        clean.encode_labels(table, "label", ["a", "b"]).collect()


def test_position_outside_the_table_fails(spark):
    with pytest.raises(IndexError):
        clean.row_at(spark.range(3), ["id"], 3)
    assert clean.row_at(spark.range(3), ["id"], 2).first().id == 2


def test_first_index_wins_among_equal_probabilities(spark):
    table = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, 0.45, 0.45],)], "p array<double>")
    assert [r[0] for r in table.select(argmax(F.col("p"))).collect()] == [0, 1]


def test_metrics_of_unpredicted_and_absent_classes(spark):
    rows = [("a", "a"), ("a", "a"), ("b", "a")]
    matrix = evaluate.confusion(spark.createDataFrame(rows, "true string, pred string"), ["a", "b", "c"])
    found = {r.label: r for r in evaluate.per_class(matrix).collect()}
    assert found["b"].precision == 0 and found["b"].f1 == 0 and found["c"].support == 0
    row = evaluate.macro(matrix).first()
    assert row.n_classes_test == 2 and row.macro_recall == 0.5 and row.n_test == 3


def test_weighted_mean_without_any_metric(spark):
    table = spark.createDataFrame([(None, 3), (NAN, 4)], "m double, n int")
    assert evaluate.weighted_mean(table, ["m"], "n").first()[0] is None


def test_grid_keeps_groups_without_known_pairs(spark):
    counts = spark.createDataFrame([("c1", "a", "q", 2)], "client string, true string, pred string, n bigint")
    grid = evaluate.full_grid(counts, ["a", "b"], ["client"])
    listed = grid.filter("pred is not null")
    assert listed.count() == 4 and listed.agg(F.sum("n")).first()[0] == 0
    assert grid.filter("pred is null").collect() == [("c1", "a", None, 2)]


def test_pairwise_correlations_with_missing_values(spark):
    rows = [(1, 1.0, 2.0, 7.0), (2, 2.0, None, 7.0), (3, 3.0, 6.0, 7.0), (4, 9.0, 5.0, 7.0), (5, 5.0, 1.0, 7.0)]
    table = spark.createDataFrame(rows, "id int, a double, b double, c double")
    pandas = table.toPandas()[["a", "b", "c"]]
    for method, got in (
        ("pearson", relate.pearson(table, ["a", "b", "c"])),
        ("spearman", relate.spearman(table, ["id"], ["a", "b", "c"])),
    ):
        want = (pandas.rank() if method == "spearman" else pandas).corr().fillna(0)
        if method == "spearman":
            both = pandas.dropna()[["a", "b"]].rank()
            want.loc["a", "b"] = want.loc["b", "a"] = both.corr().loc["a", "b"]
        found = {(r.a, r.b): r.r for r in got.collect()}
        assert found == pytest.approx({(i, j): want.loc[i, j] for i in "abc" for j in "abc"}), method


def test_anova_of_one_class_is_undefined(spark):
    table = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "label string, x double")
    assert relate.anova(table, "label").first().f_score is None


def test_tail_probabilities():
    for x in (0.01, 1.0, 5.0, 40.0, 300.0):
        assert gamma_tail(1.0, x / 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
        assert gamma_tail(2.0, x / 2) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-10)
        assert gamma_tail(0.5, x / 2) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9)
    for f, d in ((0.3, 10), (4.0, 57), (2.5, 100_000)):
        assert beta_share(d / 2, 1, d / (d + 2 * f)) == pytest.approx((1 + 2 * f / d) ** (-d / 2), rel=1e-9)
    # Table values: F(0.05; 5, 10) = 3.3258 and F(0.01; 4, 20) = 4.4307.
    assert beta_share(5, 2.5, 10 / (10 + 5 * 3.3258)) == pytest.approx(0.05, abs=1e-5)
    assert beta_share(10, 2, 20 / (20 + 4 * 4.4307)) == pytest.approx(0.01, abs=1e-5)


def test_running_totals_over_many_slices(spark):
    freq = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"), F.lit(2).alias("n"))
    found = totals.running_totals(freq, ["g"], "v", ["n"]).collect()
    assert len(found) == 1000
    assert all(r.n_before == r.v // 2 * 2 and r.n_total == 1000 for r in found)


def test_drift_of_a_known_shift(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 500, "lo").otherwise("hi").alias("label"), F.col("id").cast("double").alias("x"))
    found = {r.client: r.ks_stat for r in clients.ks_drift(rows, {"low": ["lo"], "all": ["lo", "hi"]}, columns=["x"]).collect()}
    assert found == {"low": pytest.approx(0.5), "all": pytest.approx(0.0)}


def test_drift_of_an_empty_client_is_null(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "label string, x double")
    assert clients.ks_drift(rows, {"none": ["q"]}, columns=["x"]).first().ks_stat is None


def test_samples_have_exact_sizes_under_skew(spark):
    rows = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 20, "rare").otherwise(F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))).alias("label")
    )
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    taken = sampling.stratified(rows, "label", ["id"], 900, 0).groupBy("label").count()
    cap = 900 // len(sizes)
    assert {r.label: r["count"] for r in taken.collect()} == {c: min(n, cap) for c, n in sizes.items()}
    parted = sampling.split(rows, "label", ["id"], 0.2)
    assert parted.count() == 9000 and parted.filter("is_test").count() == 1800
    again = sampling.plain(rows, ["id"], 100).select("id").exceptAll(sampling.plain(rows, ["id"], 100).select("id"))
    assert again.count() == 0


def test_samples_refuse_repeated_keys(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("id"), F.lit("a").alias("label"))
    with pytest.raises(Exception, match="does not identify a row"):
        sampling.plain(rows, ["id"], 10).count()


def test_small_tables_are_not_sampled(spark):
    rows = spark.range(10).withColumn("label", F.lit("a"))
    assert sampling.stratified(rows, "label", ["id"], 100).count() == 10
    assert sampling.background(rows, ["id"]).count() == 1
    assert sampling.plain(rows, ["id"], 50).count() == 10


def test_hash_order_depends_on_the_seed(spark):
    one, two = spark.range(1).select(hash_order(["id"], 1), hash_order(["id"], 2)).first()
    assert one != two and len(one) == 32


def test_ratios_need_their_inputs(spark):
    table = spark.createDataFrame([(10, 0, 3.0), (10, 4, None)], "bidirectional_bytes int, bidirectional_packets int, `udps.session_report_request_counter` double")
    out = features.add_ratios(table)
    assert [c for c in out.columns if c.startswith("fe_")] == ["fe_bytes_per_packet_bi", "fe_udps_session_report_req_per_packet"]
    assert [tuple(r)[3:] for r in out.collect()] == [(0.0, 3.0), (2.5, 0.0)]


def test_model_ratio_names(spark):
    names = sorted({c for _, inputs in features.MODEL_RATIOS.values() for c in inputs})
    table = spark.range(1).select(*[F.lit(1.0).alias(n) for n in names])
    made = [c for c in features.add_model_ratios(table).columns if c.startswith("fe_")]
    assert made == list(features.MODEL_RATIOS) and len(made) == 22
    assert features.add_model_ratios(table.drop("src2dst_min_ps")).columns.count("fe_src2dst_min_over_mean_ps") == 0


def test_one_hot_of_unknown_values_is_all_zeros(spark):
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "t string")
    new = spark.createDataFrame([("b",), ("zzz",)], "t string")
    out, _ = features.one_hot(new, ["t"], fitted_on=known)
    assert [r.t_hot.toArray().tolist() for r in out.orderBy("t").collect()] == [[0, 1, 0], [0, 0, 0]]


def test_screen_keeps_class_specific_features(spark):
    rows = spark.range(300_000).select(
        F.when(F.col("id") == 7, "rare").otherwise("common").alias("label"),
        F.when(F.col("id") == 7, 1).otherwise(0).alias("signal"),
        F.lit(0).alias("silent"),
        F.col("id").alias("id"),
    )
    screened = profile.screen(rows, "label")
    found = {r.feature: (r.is_always_zero, r.is_leaky, r.keep) for r in screened.collect()}
    assert found == {"signal": (True, False, True), "silent": (True, False, False), "id": (False, True, False)}
    assert profile.apply_screen(rows, screened).columns == ["label", "signal"]


def test_wide_tables_profile(spark):
    """The width of a flow table: over a hundred columns."""
    rows = spark.range(50).select(
        (F.col("id") % 2).cast("string").alias("label"), *[(F.col("id") * i % 13).cast("double").alias(f"f.{i}") for i in range(110)]
    )
    assert profile.robust_stats(rows).count() == 110
    assert profile.missingness(rows).count() == 111
    assert profile.zero_rates(rows, by="label").count() == 220


def test_wide_tables_keep_all_columns(spark):
    """130 numeric columns: none is left out by default."""
    names = [f"n{i}" for i in range(130)]
    rows = spark.range(40).select(
        F.col("id"),
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("label"),
        *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)) / 7.0).alias(n) for i, n in enumerate(names)],
    )
    pairs = relate.pearson(rows.drop("id", "label"))
    assert pairs.count() == 130 * 130
    checked = rows.agg(F.corr("n3", "n128")).first()[0]
    assert pairs.filter("a = 'n3' and b = 'n128'").first().r == pytest.approx(checked)
    assert relate.spearman(rows.drop("label"), ["id"]).select("a").distinct().count() == 130
    drift = clients.ks_drift(rows.drop("id"), {"one": ["A"], "two": ["B"]}, "label")
    assert drift.select("feature").distinct().count() == 130


def test_correlation_of_a_constant_is_zero(spark):
    rows = spark.range(1000).repartition(7).select(F.lit(0.1).alias("same"), F.col("id").cast("double").alias("x"), (-F.col("id") * 3.0 + 1e9).alias("y"))
    found = {(r.a, r.b): r.r for r in relate.pearson(rows).collect()}
    assert found["same", "x"] == 0 and found["same", "same"] == 0 and found["x", "y"] == pytest.approx(-1)


def test_unlisted_predictions_are_errors(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "zz"), ("a", "zz"), ("b", "b")], "true string, pred string")
    found = evaluate.macro(evaluate.confusion(rows, ["a", "b"])).first()
    assert (found.accuracy, found.n_test) == (0.5, 4)
    with pytest.raises(Exception, match="unknown label"):
        evaluate.confusion(rows, ["a"]).collect()


def test_missing_labels_stay_in_the_grid(spark):
    rows = spark.createDataFrame([("x", "A"), ("x", None), ("y", "A"), (None, "B")], "client string, label string")
    found = {(r["class"], r.client): r["count"] for r in clients.class_client_grid(rows).collect()}
    assert found[None, "x"] == 1 and found[None, "y"] == 0 and found["B", None] == 1 and len(found) == 9


def test_small_samples_leave_unlabelled_rows_out(spark):
    rows = spark.createDataFrame([(i, "A" if i % 2 else None) for i in range(50)], "id long, label string")
    assert {sampling.stratified(rows, "label", ["id"], total, 1000).count() for total in (100, 49)} == {25}


def test_counts_of_a_column_named_twice(spark):
    """Cells are counted by the number of their column; one named twice counts twice under its name."""
    table = spark.createDataFrame([(1.0, 2.0), (1.0, None), (float("nan"), -0.0)], "a double, b double")
    found = totals.value_counts(table, ["a", "b", "a"]).collect()
    assert sorted(((r.feature, r.value, r.n) for r in found), key=str) == sorted(
        [("a", 1.0, 4), ("a", None, 2), ("b", 2.0, 1), ("b", None, 1), ("b", 0.0, 1)], key=str
    )
