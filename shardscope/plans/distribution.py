"""Queries over class and client distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardscope.operators import clients as ops
from shardscope.plans.registry import query
from shardscope.plans.tables import (
    CLIENT_MAP,
    CLIENTS,
    FEATURES,
    FLOW,
    GAPS,
    REGIONS,
    VIRTUAL_CLIENTS,
    clients,
    flow,
    per_feature,
    rounded,
    table,
)

QUALITY = """scored AS (
  SELECT CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS label, lang AS client
  FROM labels JOIN documents USING (doc_id))"""

GRID = """counts AS (SELECT client, label, count(*) AS n FROM {source} GROUP BY 1, 2),
grid AS (
  SELECT label AS class, client, COALESCE(n, 0) AS count
  FROM (SELECT DISTINCT label FROM counts) CROSS JOIN (SELECT DISTINCT client FROM counts)
  LEFT JOIN counts USING (client, label))"""

# Virtual clients lack one class each, which leaves gaps for the grid to fill.
VIRTUAL = f"""{FLOW}, {CLIENT_MAP},
virtual AS (SELECT client, label, quantity, price, discount, tax FROM flow JOIN client_map USING (label))"""


def scored(spark, folder):
    """Labelled documents with their language as client."""
    return (
        table(spark, folder, "labels")
        .join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
        .select(F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"), F.col("lang").alias("client"))
    )


def virtual(spark, folder):
    return ops.assign(flow(spark, folder), VIRTUAL_CLIENTS)


@query("a1_class_counts", "SELECT event_type AS class, count(*) AS count FROM events GROUP BY 1")
def class_counts(spark, folder):
    return ops.class_counts(table(spark, folder, "events"), "event_type").select("class", "count").orderBy("class")


@query(
    "a2_class_percent",
    f"""WITH {QUALITY} SELECT label AS class, count(*) AS count, round(100e0 * count(*) / sum(count(*)) OVER (), 6) AS percent
        FROM scored GROUP BY 1""",
)
def class_percent(spark, folder):
    return rounded(ops.class_counts(scored(spark, folder)).drop("log_count"))


@query(
    "a3_rows_per_client",
    f"""WITH {CLIENTS} SELECT client, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 6) AS percent
        FROM clients GROUP BY 1""",
)
def rows_per_client(spark, folder):
    return rounded(ops.client_counts(clients(spark, folder)))


@query(
    "a4_class_by_client",
    f"""WITH {VIRTUAL} SELECT label AS class, {', '.join(
        f"count(CASE WHEN client = '{c}' THEN 1 END) AS {c}" for c in VIRTUAL_CLIENTS)} FROM virtual GROUP BY 1""",
)
def class_by_client(spark, folder):
    return ops.wide_by_client(ops.class_client_grid(virtual(spark, folder)), list(VIRTUAL_CLIENTS))


@query(
    "j1_class_client_grid",
    f"WITH {VIRTUAL}, {GRID.format(source='virtual')} SELECT class, client, count FROM grid",
)
def class_client_grid(spark, folder):
    return ops.class_client_grid(virtual(spark, folder))


PERCENT = "COALESCE(100e0 * count / nullif(sum(count) OVER (PARTITION BY client), 0), 0)"


@query(
    "a5_percent_within_client",
    f"WITH {VIRTUAL}, {GRID.format(source='virtual')} SELECT class, client, count, round({PERCENT}, 6) AS percent FROM grid",
)
def percent_within_client(spark, folder):
    return rounded(ops.label_counts(virtual(spark, folder)))


@query(
    "j5_divide_by_client_totals",
    f"WITH {CLIENTS}, {GRID.format(source='clients')} SELECT class, client, count, round({PERCENT}, 6) AS percent FROM grid",
)
def divide_by_client_totals(spark, folder):
    return rounded(ops.with_client_percent(ops.class_client_grid(clients(spark, folder))))


@query(
    "a6_totals",
    f"""WITH {VIRTUAL} SELECT 'client' AS kind, client AS name, count(*) AS n FROM virtual GROUP BY client
        UNION ALL SELECT 'class', label, count(*) FROM virtual GROUP BY label""",
)
def totals(spark, folder):
    grid = ops.class_client_grid(virtual(spark, folder))
    by_client = ops.client_totals(grid).select(F.lit("client").alias("kind"), F.col("client").alias("name"), "n")
    return by_client.unionByName(ops.class_totals(grid).select(F.lit("class").alias("kind"), F.col("class").alias("name"), "n"))


@query(
    "a7_unpivot_percent",
    f"WITH {CLIENTS}, {GRID.format(source='clients')} SELECT class, client, round({PERCENT}, 6) AS percent FROM grid",
)
def unpivot_percent(spark, folder):
    wide = ops.wide_by_client(ops.label_counts(clients(spark, folder)), REGIONS, "percent")
    return rounded(ops.long_by_client(wide))


@query(
    "a23_global_class_weights",
    f"""WITH {QUALITY} SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (CAST(count(*) OVER () AS DOUBLE) * count(*)), 9) AS weight
        FROM scored GROUP BY label""",
)
def global_class_weights(spark, folder):
    return rounded(ops.class_weights(scored(spark, folder)), 9)


@query(
    "a24_client_class_weights",
    f"""WITH {VIRTUAL}, {GRID.format(source='virtual')}
        SELECT client, class AS label, count AS n,
               round(COALESCE(sum(count) OVER w / (CAST(count(CASE WHEN count > 0 THEN 1 END) OVER w AS DOUBLE) * nullif(count, 0)), 1), 9) AS weight
        FROM grid WINDOW w AS (PARTITION BY client)""",
)
def client_class_weights(spark, folder):
    return rounded(ops.class_weights(virtual(spark, folder), client="client"), 9)


@query(
    "a33_log_class_counts",
    f"WITH {QUALITY} SELECT label AS class, round(log10(count(*) + 1), 9) AS log_count FROM scored GROUP BY 1",
)
def log_class_counts(spark, folder):
    return rounded(ops.class_counts(scored(spark, folder)).select("class", "log_count"), 9)


@query(
    "j2_virtual_clients",
    f"""WITH {VIRTUAL} SELECT client, label, count(*) AS n, round(avg(price), 6) AS mean_price FROM virtual GROUP BY 1, 2""",
)
def virtual_clients(spark, folder):
    rows = virtual(spark, folder)
    return rounded(rows.groupBy("client", "label").agg(F.count("*").alias("n"), F.avg("price").alias("mean_price")))


def _ks_sql(rows: str, features: list[str]) -> str:
    """Largest gap of cumulative shares, by window sums over the distinct values."""
    cells = per_feature(f"SELECT label, '{{c}}' AS feature, COALESCE({{c}}, (SELECT quantile_cont({{c}}, 0.5) FROM flow)) AS value FROM flow", features)
    return f"""WITH {rows}, {CLIENT_MAP},
      cells AS ({cells}),
      freq AS (
        SELECT names.client, feature, value, count(*) AS whole, count(map.client) AS own
        FROM cells CROSS JOIN (SELECT DISTINCT client FROM client_map) AS names
        LEFT JOIN client_map AS map ON map.client = names.client AND map.label = cells.label
        GROUP BY 1, 2, 3),
      shares AS (
        SELECT client, feature,
               CAST(sum(whole) OVER w AS DOUBLE) / sum(whole) OVER (PARTITION BY client, feature) AS all_share,
               CAST(sum(own) OVER w AS DOUBLE) / sum(own) OVER (PARTITION BY client, feature) AS own_share
        FROM freq WINDOW w AS (PARTITION BY client, feature ORDER BY value)),
      ks AS (SELECT client, feature, round(max(abs(all_share - own_share)), 9) AS ks_stat FROM shares GROUP BY 1, 2)"""


@query("a22_ks_drift", _ks_sql(GAPS, FEATURES) + "\nSELECT client, feature, ks_stat FROM ks")
def ks_drift(spark, folder):
    return rounded(ops.ks_drift(flow(spark, folder, gaps=True), VIRTUAL_CLIENTS, columns=FEATURES), 9)


RANKED_KS = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY ks_stat DESC, feature) AS place FROM ks)
    SELECT client, feature, ks_stat FROM ranked WHERE place <= """


@query("w1_top25_drift", _ks_sql(FLOW, FEATURES) + RANKED_KS + "25")
def top25_drift(spark, folder):
    drift = rounded(ops.ks_drift(flow(spark, folder), VIRTUAL_CLIENTS, columns=FEATURES), 9)
    return ops.top_k(drift, 25, ["client"], "ks_stat")


# Two derived features more, so that five places leave one out.
WIDER = f"""{FLOW.replace('flow AS', 'base AS', 1)},
flow AS (SELECT *, price * discount AS rebate, price / quantity AS unit_price FROM base)"""
WIDER_FEATURES = [*FEATURES, "rebate", "unit_price"]


@query("w2_top5_drift", _ks_sql(WIDER, WIDER_FEATURES) + RANKED_KS + "5")
def top5_drift(spark, folder):
    rows = flow(spark, folder).withColumns(
        {"rebate": F.col("price") * F.col("discount"), "unit_price": F.col("price") / F.col("quantity")}
    )
    drift = rounded(ops.ks_drift(rows, VIRTUAL_CLIENTS, columns=WIDER_FEATURES), 9)
    return ops.top_k(drift, 5, ["client"], "ks_stat")
