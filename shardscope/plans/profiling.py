"""Queries over column profiles and feature relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardscope.operators import profile, relate
from shardscope.plans.registry import query
from shardscope.plans.tables import FEATURES, FLOW, GAPS, LABELS, flow, per_feature, rounded, table

# Columns of every kind the profile distinguishes.
PROFILED = f"""{GAPS},
profiled AS (
  SELECT label, quantity, price, discount, tax, status, 1 AS constant, CAST(0 AS BIGINT) AS always_zero,
         CASE WHEN suppkey = 1 AND quantity = 7 THEN 1 ELSE 0 END AS rare, CAST(suppkey AS VARCHAR) AS src_ip,
         CASE WHEN suppkey = 2 AND quantity < 9 THEN 'seen' END AS user_agent, suppkey AS bidirectional_first_seen_ms
  FROM flow)"""
PROFILE_TYPES = {
    "label": "string", "quantity": "double", "price": "double", "discount": "double", "tax": "double", "status": "string",
    "constant": "int", "always_zero": "bigint", "rare": "int", "src_ip": "string", "user_agent": "string",
    "bidirectional_first_seen_ms": "bigint",
}
NUMBERS = [c for c, t in PROFILE_TYPES.items() if t != "string"]


def profiled(spark, folder):
    rows = flow(spark, folder, gaps=True)
    return rows.select(
        "label", *FEATURES, "status",
        F.lit(1).alias("constant"),
        F.lit(0).cast("bigint").alias("always_zero"),
        F.when((F.col("suppkey") == 1) & (F.col("quantity") == 7), 1).otherwise(0).alias("rare"),
        F.col("suppkey").cast("string").alias("src_ip"),
        F.when((F.col("suppkey") == 2) & (F.col("quantity") < 9), "seen").alias("user_agent"),
        F.col("suppkey").alias("bidirectional_first_seen_ms"),
    )


def _cells(columns) -> str:
    return per_feature("SELECT '{c}' AS feature, label, CAST({c} AS VARCHAR) AS value FROM profiled", list(columns))


MISSING = """missing AS (
  SELECT feature, count(*) - count(value) AS missing_count, round(100e0 * (count(*) - count(value)) / count(*), 6) AS missing_pct,
         count(DISTINCT value) AS nunique_non_null FROM cells GROUP BY feature)"""
TYPES_SQL = "CASE feature " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in PROFILE_TYPES.items()) + " END AS dtype"


@query(
    "a8_missingness",
    f"WITH {PROFILED}, cells AS ({_cells(PROFILE_TYPES)}), {MISSING} SELECT *, {TYPES_SQL} FROM missing",
)
def missingness(spark, folder):
    return profile.ordered_missingness(profile.missingness(profiled(spark, folder)))


@query(
    "a9_missingness_by_class",
    f"""WITH {PROFILED}, cells AS ({_cells(c for c in PROFILE_TYPES if c != 'label')})
        SELECT feature, {', '.join(
            f"round(100e0 * sum(CASE WHEN label = '{k}' AND value IS NULL THEN 1 ELSE 0 END) / sum(CASE WHEN label = '{k}' THEN 1 ELSE 0 END), 6) AS {k}"
            for k in LABELS)} FROM cells GROUP BY feature""",
)
def missingness_by_class(spark, folder):
    return profile.pivot_classes(profile.missingness_by(profiled(spark, folder), "label"), "label", "missing_pct", LABELS)


ZERO = "round(100e0 * avg(CASE WHEN {c} = 0 THEN 1e0 ELSE 0e0 END), 6) AS zero_pct"


@query("a10_zero_share", f"WITH {PROFILED} " + per_feature(f"SELECT '{{c}}' AS feature, {ZERO} FROM profiled", NUMBERS))
def zero_share(spark, folder):
    return profile.zero_rates(profiled(spark, folder))


@query(
    "a11_zero_share_by_class",
    f"WITH {PROFILED} " + per_feature(f"SELECT '{{c}}' AS feature, label, {ZERO} FROM profiled GROUP BY label", NUMBERS),
)
def zero_share_by_class(spark, folder):
    return profile.zero_rates(profiled(spark, folder), by="label")


SPREAD = """freq AS (SELECT feature, value, count(*) AS n FROM cells GROUP BY feature, value),
spread AS (
  SELECT feature, round(max(n) / sum(n), 9) AS top_fraction, count(*) AS nunique FROM freq GROUP BY feature)"""


@query(
    "a12_constants",
    f"""WITH {PROFILED}, cells AS ({_cells(PROFILE_TYPES)}), {SPREAD}
        SELECT feature, CASE WHEN nunique <= 1 THEN 'constant' ELSE 'near_constant' END AS kind, top_fraction, nunique
        FROM spread WHERE nunique <= 1 OR top_fraction >= 0.999""",
)
def constants(spark, folder):
    return rounded(profile.constants(profiled(spark, folder)), 9)


@query(
    "a13_duplicates",
    """WITH rows AS (SELECT l_returnflag, l_linestatus, l_quantity, nullif(l_tax, 0) AS tax, l_linenumber FROM lineitem)
       SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM rows)) AS exact_duplicate_rows,
              count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, tax FROM rows)) AS duplicate_rows_excluding_cols
       FROM rows""",
)
def duplicates(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_quantity", F.nullif("l_tax", F.lit(0.0)).alias("tax"), "l_linenumber"
    )
    return profile.duplicates(rows, ["l_linenumber", "id"])


# Interpolated order statistics of five-digit prices have seven digits; eight leave no ties to round.
MOMENTS = """count(value) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 8) AS median,
  round(var_pop(value), 5) AS var, round(stddev_pop(value), 6) AS std,
  round(avg(pow(value - mid, 3)) / pow(avg(pow(value - mid, 2)), 1.5), 6) AS skew, round(kurtosis_pop(value), 6) AS kurtosis,
  round(quantile_cont(value, 0.25), 8) AS q1, round(quantile_cont(value, 0.75), 8) AS q3,
  round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 8) AS iqr, round(mad(value), 8) AS mad"""


ORDER_DIGITS = dict.fromkeys(("median", "q1", "q3", "iqr", "mad"), 8)


def _moments(by: str) -> str:
    group = f"{by}, feature" if by else "feature"
    cells = per_feature("SELECT '{c}' AS feature, label, {c} AS value FROM flow")
    return f"""WITH {GAPS}, cells AS ({cells}),
      centred AS (SELECT *, avg(value) OVER (PARTITION BY {group}) AS mid FROM cells)
      SELECT {group}, {MOMENTS} FROM centred GROUP BY {group}"""


@query("a14_robust_stats", _moments(""))
def robust_stats(spark, folder):
    return rounded(profile.robust_stats(flow(spark, folder, gaps=True), FEATURES), var=5, **ORDER_DIGITS)


@query("a15_robust_stats_by_class", _moments("label"))
def robust_stats_by_class(spark, folder):
    return rounded(profile.robust_stats(flow(spark, folder, gaps=True), FEATURES, by="label"), var=5, **ORDER_DIGITS)


@query(
    "a16_mad",
    f"""WITH {FLOW}, mids AS (SELECT label, {', '.join(f'median({c}) AS {c}_mid' for c in FEATURES)} FROM flow GROUP BY label) """
    + per_feature("SELECT label, '{c}' AS feature, round(median(abs({c} - {c}_mid)), 8) AS mad FROM flow JOIN mids USING (label) GROUP BY label"),
)
def mad(spark, folder):
    """MAD per class by the way long tables go: bracketed order statistics."""
    return rounded(profile.mad(flow(spark, folder), FEATURES, by="label"), 8)


@query(
    "p3_screening",
    f"""WITH {PROFILED}, cells AS ({_cells(c for c in PROFILE_TYPES if c != 'label')}), {MISSING}, {SPREAD},
        zeros AS ({per_feature(f"SELECT '{{c}}' AS feature, {ZERO} FROM profiled", NUMBERS)}),
        class_zeros AS ({per_feature(f"SELECT '{{c}}' AS feature, label, {ZERO} FROM profiled GROUP BY label", NUMBERS)}),
        least AS (SELECT feature, min(zero_pct) AS least_zero_pct FROM class_zeros GROUP BY feature),
        flags AS (
          SELECT feature, missing_pct, zero_pct, nunique <= 1 AS is_constant, COALESCE(zero_pct >= 99.999, false) AS is_always_zero,
                 missing_pct >= 95 AS is_mostly_missing,
                 regexp_matches(feature, '(_ip|_mac|_oui|_first_seen_ms|_last_seen_ms)$') OR feature IN ('id', 'expiration_id') AS is_leaky,
                 COALESCE(least_zero_pct < 99.999, false) AS in_some_class
          FROM missing JOIN spread USING (feature) LEFT JOIN zeros USING (feature) LEFT JOIN least USING (feature))
        SELECT * EXCLUDE in_some_class, NOT is_constant AND NOT is_leaky AND (NOT is_always_zero OR in_some_class) AS keep FROM flags""",
)
def screening(spark, folder):
    return profile.screen(profiled(spark, folder), "label")


@query(
    "w4_threshold_lists",
    f"""WITH {PROFILED}, cells AS ({_cells(PROFILE_TYPES)}), {MISSING},
        zeros AS ({per_feature(f"SELECT '{{c}}' AS feature, {ZERO} FROM profiled", NUMBERS)})
        SELECT 'mostly_missing' AS list, feature, missing_pct AS pct FROM missing WHERE missing_pct >= 95
        UNION ALL SELECT 'always_zero', feature, zero_pct FROM zeros WHERE zero_pct >= 99.999""",
)
def threshold_lists(spark, folder):
    rows = profiled(spark, folder)
    missing = profile.mostly_missing(profile.missingness(rows)).select(
        F.lit("mostly_missing").alias("list"), "feature", F.col("missing_pct").alias("pct")
    )
    zeros = profile.always_zero(profile.zero_rates(rows))
    return missing.unionByName(zeros.select(F.lit("always_zero").alias("list"), "feature", F.col("zero_pct").alias("pct")))


def _corr_sql(rows: str, value: str) -> str:
    pairs = [(a, b) for a in FEATURES for b in FEATURES]
    return f"WITH {rows} " + "\nUNION ALL\n".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(COALESCE(corr({value.format(c=a)}, {value.format(c=b)}), 0), 8) AS r FROM ranked" for a, b in pairs
    )


@query("a17_pearson", _corr_sql(f"{GAPS}, ranked AS (SELECT * FROM flow)", "{c}"))
def pearson(spark, folder):
    return rounded(relate.pearson(flow(spark, folder, gaps=True), FEATURES), 8)


RANKS = ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 AS {c}_rank" for c in FEATURES
)


@query("a18_spearman", _corr_sql(f"{FLOW}, ranked AS (SELECT {RANKS} FROM flow)", "{c}_rank"))
def spearman(spark, folder):
    return rounded(relate.spearman(flow(spark, folder), ["row_key"], FEATURES), 8)


FILL = per_feature(
    "SELECT label, '{c}' AS feature, COALESCE({c}, (SELECT quantile_cont({c}, 0.5) FROM flow)) AS value FROM flow"
)
ANOVA = f"""WITH {GAPS}, cells AS ({FILL}),
  per_class AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM cells GROUP BY 1, 2),
  grand AS (SELECT feature, avg(value) AS g FROM cells GROUP BY 1),
  sums AS (
    SELECT feature, sum(n * pow(m - g, 2)) AS ssb, sum(n * v) AS ssw, count(*) - 1 AS df1, sum(n) - count(*) AS df2
    FROM per_class JOIN grand USING (feature) GROUP BY feature),
  scores AS (SELECT feature, (ssb / df1) / (ssw / df2) AS f, df2 FROM sums)"""


# With three classes the upper tail of F(2, d) is (1 + 2 F / d) ^ (-d / 2).
@query(
    "a19_anova",
    f"{ANOVA} SELECT feature, round(f, 6) AS f_score, round(pow(1 + 2 * f / df2, -df2 / 2), 6) AS p_value FROM scores",
)
def anova(spark, folder):
    return rounded(relate.anova(flow(spark, folder, gaps=True), "label", FEATURES))


CHI2 = f"""WITH rows AS (
    SELECT l_returnflag AS label, l_linestatus AS status, nullif(o_orderpriority, '1-URGENT') AS priority,
           substr(CAST(l_shipdate AS VARCHAR), 1, 7) AS month
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  best AS (SELECT priority AS filler FROM rows WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  cells AS (
    SELECT label, 'status' AS feature, status AS value FROM rows
    UNION ALL SELECT label, 'priority', COALESCE(priority, filler) FROM rows, best
    UNION ALL SELECT label, 'month', month FROM rows),
  vals AS (SELECT feature, value, count(*) AS value_n FROM cells GROUP BY 1, 2),
  classes AS (SELECT label, count(*) AS class_n, sum(count(*)) OVER () AS n FROM rows GROUP BY label),
  observed AS (SELECT feature, value, label, count(*) AS o FROM cells GROUP BY 1, 2, 3),
  chi AS (
    SELECT feature, value, sum(pow(COALESCE(o, 0) - CAST(class_n AS DOUBLE) * value_n / n, 2) / (CAST(class_n AS DOUBLE) * value_n / n)) AS chi2
    FROM vals CROSS JOIN classes LEFT JOIN observed USING (feature, value, label) GROUP BY 1, 2)"""


def _chi2(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority")
    )
    rows = (
        table(spark, folder, "lineitem")
        .select(
            "l_orderkey",
            F.col("l_returnflag").alias("label"),
            F.col("l_linestatus").alias("status"),
            F.substring(F.col("l_shipdate").cast("string"), 1, 7).alias("month"),
        )
        .join(orders, "l_orderkey")
    )
    return relate.chi2(rows, "label", ["status", "priority", "month"])


# With three classes the upper tail of chi-square with 2 degrees of freedom is exp(-x / 2).
@query("a20_chi2", f"{CHI2} SELECT feature, value, round(chi2, 6) AS chi2, round(exp(-chi2 / 2), 6) AS p_value FROM chi")
def chi2(spark, folder):
    return rounded(_chi2(spark, folder))


BINS = 8


def _mi_sql() -> str:
    def part(c: str) -> str:
        if c == "tax":
            return c
        edges = " + ".join(f"CAST({c} > (SELECT quantile_cont({c}, {i / BINS}) FROM filled) AS INTEGER)" for i in range(1, BINS))
        return f"CAST({edges} AS DOUBLE)"

    filled = ", ".join(f"COALESCE({c}, (SELECT quantile_cont({c}, 0.5) FROM flow)) AS {c}" for c in FEATURES)
    cells = "\nUNION ALL\n".join(f"SELECT label, '{c}' AS feature, {part(c)} AS value FROM filled" for c in FEATURES)
    return f"""WITH {GAPS}, filled AS (SELECT label, {filled} FROM flow), cells AS ({cells}),
      joint AS (SELECT feature, value, label, CAST(count(*) AS DOUBLE) AS n FROM cells GROUP BY 1, 2, 3),
      margins AS (
        SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, value) AS v,
               sum(n) OVER (PARTITION BY feature, label) AS k FROM joint),
      mi AS (SELECT feature, round(greatest(sum(n / t * ln(n * t / (v * k))), 0), 9) AS mutual_info FROM margins GROUP BY feature)"""


@query("a21_mutual_info", f"{_mi_sql()} SELECT feature, mutual_info FROM mi")
def mutual_info(spark, folder):
    return rounded(relate.mutual_info(flow(spark, folder, gaps=True), "label", FEATURES, BINS, discrete=["tax"]), 9)


def _digamma_sql(n: str) -> str:
    x = f"({n} + 6e0)"
    steps = " - ".join(f"1e0 / ({n} + {i})" for i in range(6))
    return f"(ln{x} - 1 / (2 * {x}) - 1 / (12 * {x}**2) + 1 / (120 * {x}**4) - 1 / (252 * {x}**6) + 1 / (240 * {x}**8) - {steps})"


def _neighbours_sql() -> str:
    """Three neighbours on either side by lag and lead, counts of ranges by ASOF joins with running totals."""
    beside = ", ".join(
        f"{{'d': abs(value - {f}(value, {i}) OVER w), 'n': {f}(n, {i}) OVER w}}" for f in ("lag", "lead") for i in (1, 2, 3)
    )
    cells = per_feature("SELECT label, '{c}' AS feature, coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM flow)) AS value FROM flow")
    return f"""WITH {GAPS}, cells AS ({cells}),
      counts AS (SELECT feature, label, value, count(*) AS n FROM cells GROUP BY ALL),
      points AS (SELECT *, sum(n) OVER (PARTITION BY feature, label) AS class_n FROM counts QUALIFY class_n > 1),
      beside AS (SELECT *, least(3, class_n - 1) AS k, [{{'d': 0e0, 'n': n - 1}}, {beside}] AS near FROM points
                 WINDOW w AS (PARTITION BY feature, label ORDER BY value)),
      unfolded AS (SELECT feature, label, value, n, class_n, k, unnest(near) AS x FROM beside),
      summed AS (SELECT *, sum(x.n) OVER (PARTITION BY feature, label, value ORDER BY x.d) AS upto FROM unfolded WHERE x.d IS NOT NULL),
      radius AS (SELECT feature, label, value, any_value(n) AS n, any_value(class_n) AS class_n, any_value(k) AS k, min(x.d) AS r
                 FROM summed WHERE upto >= k GROUP BY ALL),
      ranks AS (SELECT feature, value, sum(n) AS own, sum(sum(n)) OVER (PARTITION BY feature ORDER BY value) AS upto FROM points GROUP BY feature, value),
      wide AS (SELECT a.*, coalesce(h.upto, 0) - coalesce(l.upto, 0) AS m
               FROM (SELECT *, value + r AS high, value - r AS low FROM radius WHERE r > 0) a
               ASOF LEFT JOIN ranks h ON a.feature = h.feature AND a.high > h.value
               ASOF LEFT JOIN ranks l ON a.feature = l.feature AND a.low >= l.value),
      flat AS (SELECT a.*, own AS m FROM radius a JOIN ranks USING (feature, value) WHERE r = 0),
      every AS (SELECT feature, n, class_n, k, m FROM wide UNION ALL SELECT feature, n, class_n, k, m FROM flat)
      SELECT feature, round(greatest({_digamma_sql('sum(n)')} + sum(n * {_digamma_sql('k')}) / sum(n) - sum(n * {_digamma_sql('class_n')}) / sum(n)
             - sum(n * {_digamma_sql('m')}) / sum(n), 0), 7) AS mutual_info FROM every GROUP BY feature"""


@query("a21_neighbour_info", _neighbours_sql())
def neighbour_info(spark, folder):
    return rounded(relate.neighbour_info(flow(spark, folder, gaps=True), "label", FEATURES), 7)


@query(
    "w3_top_features",
    f"{CHI2} SELECT feature, value, round(chi2, 6) AS chi2 FROM chi ORDER BY round(chi2, 6) DESC, feature, value LIMIT 15",
)
def top_features(spark, folder):
    return relate.top(rounded(_chi2(spark, folder).drop("p_value")), "chi2", 15, ["feature", "value"])
