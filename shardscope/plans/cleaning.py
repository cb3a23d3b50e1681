"""Queries over dropping, coding, imputing, scaling and ratio features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardscope.operators import clean, features
from shardscope.operators import clients as client_ops
from shardscope.plans.registry import query
from shardscope.plans.tables import (
    CLIENT_MAP,
    CLIENTS,
    FEATURES,
    FLOW,
    GAPS,
    VIRTUAL_CLIENTS,
    clients,
    flow,
    rounded,
    table,
)
from shardscope.session import written


def digest(df: DataFrame, by: str, columns=FEATURES, digits: int = 6) -> DataFrame:
    """Rows, mean, least and largest value of each column per group: a small trace of a whole table."""
    parts = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("low", F.min), ("high", F.max))]
    return rounded(df.groupBy(by).agg(F.count("*").alias("n"), *parts), digits)


def digest_sql(source: str, by: str, columns=FEATURES, digits: int = 6) -> str:
    parts = ", ".join(
        f"round({f}({c}), {digits}) AS {c}_{n}" for c in columns for n, f in (("mean", "avg"), ("low", "min"), ("high", "max"))
    )
    return f"SELECT {by}, count(*) AS n, {parts} FROM {source} GROUP BY {by}"


@query("p1_drop_artifacts", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_artifacts(spark, folder):
    return clean.drop_columns(table(spark, folder, "customer"), ["c_name", "c_acctbal", "label"])


MEDIANS = "medians AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}_mid" for c in FEATURES) + " FROM flow)"
FILLED = "filled AS (SELECT {keep}, " + ", ".join(f"COALESCE({c}, {c}_mid) AS {c}" for c in FEATURES) + " FROM {rows}, medians)"


@query("p4_median_impute", f"WITH {GAPS}, {MEDIANS}, {FILLED.format(keep='label', rows='flow')} {digest_sql('filled', 'label')}")
def median_impute(spark, folder):
    return digest(clean.impute_median(flow(spark, folder, gaps=True), FEATURES), "label")


@query(
    "p5_client_impute",
    f"""WITH {GAPS}, {CLIENT_MAP}, {MEDIANS}, virtual AS (SELECT * FROM flow JOIN client_map USING (label)),
        {FILLED.format(keep='client', rows='virtual')} {digest_sql('filled', 'client')}""",
)
def client_impute(spark, folder):
    whole = flow(spark, folder, gaps=True)
    return digest(clean.impute_median(client_ops.assign(whole, VIRTUAL_CLIENTS), FEATURES, fitted_on=whole), "client")


@query(
    "p6_most_frequent_impute",
    """WITH gaps AS (SELECT o_orderstatus AS status, nullif(o_orderpriority, '1-URGENT') AS priority FROM orders),
       best AS (SELECT priority AS filler FROM gaps WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
       SELECT status, COALESCE(priority, filler) AS priority, count(*) AS n FROM gaps, best GROUP BY 1, 2""",
)
def most_frequent_impute(spark, folder):
    gaps = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("status"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority")
    )
    return clean.impute_most_frequent(gaps, ["priority"]).groupBy("status", "priority").agg(F.count("*").alias("n"))


def _scaled(source: str, by: str) -> str:
    fit = ", ".join(
        f"quantile_cont({c}, 0.5) AS {c}_mid, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_iqr" for c in FEATURES
    )
    values = ", ".join(f"({c} - {c}_mid) / CASE WHEN {c}_iqr = 0 THEN 1 ELSE {c}_iqr END AS {c}" for c in FEATURES)
    group, join = (f"{by}, ", f"JOIN fit USING ({by})") if by else ("", "CROSS JOIN fit")
    tail = f" GROUP BY {by}" if by else ""
    return f"""fit AS (SELECT {group}{fit} FROM {source}{tail}),
      scaled AS (SELECT {by or 'label'}, {values} FROM {source} {join})"""


@query("p7_robust_scale", f"WITH {GAPS}, {_scaled('flow', '')} {digest_sql('scaled', 'label')}")
def robust_scale(spark, folder):
    return digest(clean.robust_scale(flow(spark, folder, gaps=True), FEATURES), "label")


@query("p8_robust_scale_per_client", f"WITH {CLIENTS}, {_scaled('clients', 'client')} {digest_sql('scaled', 'client')}")
def robust_scale_per_client(spark, folder):
    return digest(clean.robust_scale_per_client(clients(spark, folder), FEATURES), "client")


@query(
    "p9_one_hot",
    """WITH gaps AS (
         SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, nullif(o_orderpriority, '3-MEDIUM') AS priority FROM orders),
       fill AS (
         SELECT (SELECT status FROM gaps WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS s,
                (SELECT priority FROM gaps WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS p)
       SELECT feature, value, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (
         SELECT o_orderkey, 'status' AS feature, COALESCE(status, s) AS value FROM gaps, fill
         UNION ALL SELECT o_orderkey, 'priority', COALESCE(priority, p) FROM gaps, fill) GROUP BY 1, 2""",
)
def one_hot(spark, folder):
    gaps = table(spark, folder, "orders").select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("priority"),
    )
    entries = features.one_hot_long(gaps, ["status", "priority"], ["o_orderkey"])
    return entries.groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    "p9_one_hot_vectors",
    """WITH codes AS (
         SELECT o_orderkey, 'o_orderpriority' AS feature, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS place FROM orders WHERE o_orderpriority <> '3-MEDIUM'
         UNION ALL SELECT o_orderkey, 'o_orderstatus', dense_rank() OVER (ORDER BY o_orderstatus) - 1 FROM orders WHERE o_orderstatus <> 'P'),
       sizes AS (SELECT feature, max(place) + 1 AS size FROM codes GROUP BY 1)
       SELECT feature, CAST(size AS INTEGER) AS size, CAST(place AS INTEGER) AS place, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys
       FROM codes JOIN sizes USING (feature) GROUP BY 1, 2, 3
       UNION ALL SELECT feature, CAST(size AS INTEGER), -1, count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders, sizes
       WHERE CASE WHEN feature = 'o_orderstatus' THEN o_orderstatus = 'P' ELSE o_orderpriority = '3-MEDIUM' END GROUP BY 1, 2""",
)
def one_hot_vectors(spark, folder):
    """Vectors fitted without one category of either column, whose rows so become all zeros."""
    from pyspark.ml.functions import vector_to_array

    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    known = orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("o_orderpriority"))
    coded, _ = features.one_hot(orders, ["o_orderpriority", "o_orderstatus"], fitted_on=known)
    parts = []
    for c in ("o_orderpriority", "o_orderstatus"):
        entries = vector_to_array(F.col(f"{c}_hot"))
        place = (F.coalesce(F.array_position(entries, 1.0), F.lit(0)) - 1).cast("int")
        parts.append(coded.select(F.lit(c).alias("feature"), F.size(entries).alias("size"), place.alias("place"), "o_orderkey"))
    every = parts[0].unionByName(parts[1])
    return every.groupBy("feature", "size", "place").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    "p9_text_codes",
    f"""WITH {FLOW}, codes AS (
          SELECT label, status, dense_rank() OVER (ORDER BY row_key) - 1 AS row_key_code, dense_rank() OVER (ORDER BY status) - 1 AS status_code FROM flow)
        SELECT label, status_code, count(*) AS n, min(row_key_code) AS first_code, max(row_key_code) AS last_code,
               CAST(sum(row_key_code) AS BIGINT) AS code_sum FROM codes GROUP BY 1, 2""",
)
def text_codes(spark, folder):
    """A column with as many texts as rows beside one with two."""
    rows = flow(spark, folder).select("label", "status", "row_key")
    coded = features.text_codes(rows, ["row_key", "status"], written(features.dictionary(rows, ["row_key", "status"])))
    return coded.groupBy("label", "status_code").agg(
        F.count("*").alias("n"), F.min("row_key_code").alias("first_code"), F.max("row_key_code").alias("last_code"), F.sum("row_key_code").alias("code_sum")
    )


@query(
    "p11_presence_flags",
    """SELECT c_nationkey, CAST(sum(CASE WHEN nullif(c_mktsegment, 'BUILDING') IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS agents,
              CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS types, count(*) AS n FROM customer GROUP BY 1""",
)
def presence_flags(spark, folder):
    rows = table(spark, folder, "customer").select(
        "c_nationkey",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("user_agent"),
        F.when(F.col("c_acctbal") > 0, "text/html").alias("content_type"),
    )
    flagged = clean.presence_flags(rows)
    return flagged.groupBy("c_nationkey").agg(
        F.sum("user_agent__present").alias("agents"), F.sum("content_type__present").alias("types"), F.count("*").alias("n")
    )


# Line items under the names of a flow table; every ratio input occurs, zeros included.
TRAFFIC = {
    "bidirectional_bytes": "l_extendedprice",
    "bidirectional_packets": "l_linenumber - 1",
    "bidirectional_duration_ms": "l_suppkey",
    "src2dst_bytes": "l_quantity",
    "src2dst_packets": "l_linenumber - 2",
    "dst2src_bytes": "l_tax * 100",
    "dst2src_packets": "l_linenumber",
    "bidirectional_syn_packets": "l_linenumber % 3",
    "bidirectional_rst_packets": "l_linenumber % 2",
    "bidirectional_fin_packets": "l_partkey % 3",
    "bidirectional_ack_packets": "l_partkey % 5",
    "bidirectional_psh_packets": "l_partkey % 7",
    "udps.session_report_request_counter": "nullif(l_discount, 0) * 100",
}


def traffic(spark, folder, names=None):
    rows = table(spark, folder, "lineitem")
    columns = names or TRAFFIC
    return rows.select(F.col("l_returnflag").alias("label"), *[F.expr(e).alias(n) for n, e in columns.items()])


# Every ratio as it is meant, over the columns named above.
RATIO_SQL = {
    "fe_bytes_per_packet_bi": "bidirectional_bytes / nullif(bidirectional_packets, 0)",
    "fe_bytes_per_packet_s2d": "src2dst_bytes / nullif(src2dst_packets, 0)",
    "fe_bytes_per_packet_d2s": "dst2src_bytes / nullif(dst2src_packets, 0)",
    "fe_byte_ratio_s2d_over_d2s": "src2dst_bytes / nullif(dst2src_bytes + 1, 0)",
    "fe_packet_ratio_s2d_over_d2s": "src2dst_packets / nullif(dst2src_packets + 1, 0)",
    "fe_packets_per_ms_bi": "bidirectional_packets / nullif(bidirectional_duration_ms + 1, 0)",
    "fe_bytes_per_ms_bi": "bidirectional_bytes / nullif(bidirectional_duration_ms + 1, 0)",
    "fe_syn_rate_bi": "bidirectional_syn_packets / nullif(bidirectional_packets + 1, 0)",
    "fe_rst_rate_bi": "bidirectional_rst_packets / nullif(bidirectional_packets + 1, 0)",
    "fe_fin_rate_bi": "bidirectional_fin_packets / nullif(bidirectional_packets + 1, 0)",
    "fe_ack_rate_bi": "bidirectional_ack_packets / nullif(bidirectional_packets + 1, 0)",
    "fe_psh_rate_bi": "bidirectional_psh_packets / nullif(bidirectional_packets + 1, 0)",
    "fe_udps_session_report_req_per_packet": '"udps.session_report_request_counter" / nullif(bidirectional_packets + 1, 0)',
}
TRAFFIC_COLUMNS = ", ".join(f'CAST({e} AS DOUBLE) AS "{n}"' for n, e in TRAFFIC.items())
RATIO_ROWS = f"""traffic AS (SELECT l_returnflag AS label, {TRAFFIC_COLUMNS} FROM lineitem),
  ratios AS (SELECT label, {', '.join(f'COALESCE({e}, 0) AS {n}' for n, e in RATIO_SQL.items())} FROM traffic)"""


@query("p12_engineered_ratios", f"WITH {RATIO_ROWS} {digest_sql('ratios', 'label', list(RATIO_SQL), 4)}")
def engineered_ratios(spark, folder):
    return digest(features.add_ratios(traffic(spark, folder)), "label", list(RATIO_SQL), 4)


# Inputs of the further model ratios, again with zeros.
MODEL_TRAFFIC = {
    "bidirectional_stddev_piat_ms": "l_quantity * 1",
    "dst2src_stddev_piat_ms": "l_quantity * 2",
    "src2dst_stddev_piat_ms": "l_quantity * 3",
    "bidirectional_mean_piat_ms": "l_tax * 100",
    "dst2src_mean_piat_ms": "l_tax * 200",
    "src2dst_mean_piat_ms": "l_tax * 300",
    "bidirectional_packets": "l_linenumber",
    "src2dst_packets": "l_linenumber - 1",
    "dst2src_packets": "l_linenumber - 2",
    "src2dst_fin_packets": "l_partkey % 2",
    "src2dst_psh_packets": "l_partkey % 3",
    "src2dst_rst_packets": "l_partkey % 4",
    "src2dst_ack_packets": "l_partkey % 5",
    "dst2src_syn_packets": "l_suppkey % 2",
    "dst2src_ack_packets": "l_suppkey % 3",
    "dst2src_fin_packets": "l_suppkey % 4",
    "dst2src_psh_packets": "l_suppkey % 5",
    "src2dst_min_ps": "l_quantity",
    "src2dst_mean_ps": "l_discount * 1000",
    "udps.session_establishment_request_counter": "l_partkey % 3",
    "udps.session_modification_request_counter": "l_partkey % 4",
    "udps.session_deletion_request_counter": "l_partkey % 5",
    "udps.session_report_request_counter": "l_partkey % 6",
    "udps.session_establishment_response_counter": "l_suppkey % 3",
    "udps.session_modification_response_counter": "l_suppkey % 4",
    "udps.session_deletion_response_counter": "l_suppkey % 5",
    "udps.session_report_response_counter": "l_suppkey % 6",
}

# The further ratios over these inputs, spelled out; an undefined ratio is 0.
MODEL_RATIO_SQL = {
    "fe_bidirectional_piat_burstiness": '("bidirectional_stddev_piat_ms" - "bidirectional_mean_piat_ms") / nullif("bidirectional_stddev_piat_ms" + "bidirectional_mean_piat_ms", 0)',
    "fe_dst2src_piat_burstiness": '("dst2src_stddev_piat_ms" - "dst2src_mean_piat_ms") / nullif("dst2src_stddev_piat_ms" + "dst2src_mean_piat_ms", 0)',
    "fe_src2dst_piat_burstiness": '("src2dst_stddev_piat_ms" - "src2dst_mean_piat_ms") / nullif("src2dst_stddev_piat_ms" + "src2dst_mean_piat_ms", 0)',
    "fe_src2dst_fin_rate": '"src2dst_fin_packets" / nullif("src2dst_packets" + 1, 0)',
    "fe_src2dst_psh_rate": '"src2dst_psh_packets" / nullif("src2dst_packets" + 1, 0)',
    "fe_src2dst_rst_rate": '"src2dst_rst_packets" / nullif("src2dst_packets" + 1, 0)',
    "fe_dst2src_syn_rate": '"dst2src_syn_packets" / nullif("dst2src_packets" + 1, 0)',
    "fe_dst2src_ack_rate": '"dst2src_ack_packets" / nullif("dst2src_packets" + 1, 0)',
    "fe_dst2src_fin_rate": '"dst2src_fin_packets" / nullif("dst2src_packets" + 1, 0)',
    "fe_dst2src_psh_rate": '"dst2src_psh_packets" / nullif("dst2src_packets" + 1, 0)',
    "fe_ack_rate_imbalance": '(coalesce("src2dst_ack_packets" / nullif("src2dst_packets" + 1, 0), 0) - coalesce("dst2src_ack_packets" / nullif("dst2src_packets" + 1, 0), 0)) / nullif(coalesce("src2dst_ack_packets" / nullif("src2dst_packets" + 1, 0), 0) + coalesce("dst2src_ack_packets" / nullif("dst2src_packets" + 1, 0), 0) + 1, 0)',
    "fe_src2dst_min_over_mean_ps": '"src2dst_min_ps" / nullif("src2dst_mean_ps", 0)',
    "fe_session_del_req_per_packet": '"udps.session_deletion_request_counter" / nullif("bidirectional_packets" + 1, 0)',
    "fe_session_del_resp_per_packet": '"udps.session_deletion_response_counter" / nullif("bidirectional_packets" + 1, 0)',
    "fe_session_est_req_per_packet": '"udps.session_establishment_request_counter" / nullif("bidirectional_packets" + 1, 0)',
    "fe_session_mod_req_per_packet": '"udps.session_modification_request_counter" / nullif("bidirectional_packets" + 1, 0)',
    "fe_session_mod_resp_per_packet": '"udps.session_modification_response_counter" / nullif("bidirectional_packets" + 1, 0)',
    "fe_session_rep_req_per_packet": '"udps.session_report_request_counter" / nullif("bidirectional_packets" + 1, 0)',
    "fe_session_rep_resp_per_packet": '"udps.session_report_response_counter" / nullif("bidirectional_packets" + 1, 0)',
    "fe_session_del_req_resp_imbalance": '("udps.session_deletion_request_counter" - "udps.session_deletion_response_counter") / nullif("udps.session_deletion_request_counter" + "udps.session_deletion_response_counter" + 1, 0)',
    "fe_session_mod_req_resp_imbalance": '("udps.session_modification_request_counter" - "udps.session_modification_response_counter") / nullif("udps.session_modification_request_counter" + "udps.session_modification_response_counter" + 1, 0)',
    "fe_session_rep_req_resp_imbalance": '("udps.session_report_request_counter" - "udps.session_report_response_counter") / nullif("udps.session_report_request_counter" + "udps.session_report_response_counter" + 1, 0)',
}


@query(
    "p23_model_ratios",
    f"""WITH inputs AS (SELECT l_returnflag AS label, {', '.join(f'CAST({e} AS DOUBLE) AS "{n}"' for n, e in MODEL_TRAFFIC.items())} FROM lineitem),
        ratios AS (SELECT label, {', '.join(f'coalesce({e}, 0) AS {n}' for n, e in MODEL_RATIO_SQL.items())} FROM inputs)
        {digest_sql('ratios', 'label', list(MODEL_RATIO_SQL), 5)}""",
)
def model_ratios(spark, folder):
    return digest(features.add_model_ratios(traffic(spark, folder, MODEL_TRAFFIC)), "label", list(MODEL_RATIO_SQL), 5)


@query(
    "p13_drop_and_remap",
    f"""WITH {FLOW}, {CLIENT_MAP} SELECT CASE client WHEN 'client_1' THEN 'client_1' ELSE 'client_2' END AS client, label, count(*) AS n
        FROM flow JOIN client_map USING (label) WHERE label <> 'R' AND client <> 'client_2' GROUP BY 1, 2""",
)
def drop_and_remap(spark, folder):
    rows = client_ops.assign(flow(spark, folder), VIRTUAL_CLIENTS)
    kept = clean.drop_label(rows, "label", "R", {"client_1": "client_1", "client_3": "client_2"})
    return kept.groupBy("client", "label").agg(F.count("*").alias("n"))


@query(
    "p14_label_codes",
    """SELECT l_returnflag AS label, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 WHEN 'A' THEN 2 END AS code, count(*) AS n
       FROM lineitem GROUP BY 1, 2""",
)
def label_codes(spark, folder):
    coded = clean.encode_labels(flow(spark, folder), "label", ["R", "N", "A"])
    return coded.groupBy("label", "code").agg(F.count("*").alias("n"))


@query(
    "p15_category_codes",
    """SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code, count(*) AS n
       FROM events GROUP BY event_type""",
)
def category_codes(spark, folder):
    coded = clean.category_codes(table(spark, folder, "events"), "event_type")
    return coded.groupBy("event_type", "code").agg(F.count("*").alias("n"))


@query("p16_label_filter", f"WITH {FLOW}, kept AS (SELECT * FROM flow WHERE label IN ('A', 'R')) {digest_sql('kept', 'label')}")
def label_filter(spark, folder):
    return digest(clean.keep_labels(flow(spark, folder), "label", ["A", "R"]), "label")


@query(
    "p17_row_by_position",
    f"""WITH {FLOW} SELECT label, quantity, round(price, 6) AS price, row_key FROM (
          SELECT *, row_number() OVER (ORDER BY price, row_key) - 1 AS place FROM flow) WHERE place = 1234""",
)
def row_by_position(spark, folder):
    row = clean.row_at(flow(spark, folder), ["price", "row_key"], 1234)
    return rounded(row.select("label", "quantity", "price", "row_key"))


@query(
    "p18_row_weights",
    f"""WITH {FLOW}, weights AS (SELECT label, count(*) AS n, sum(count(*)) OVER () / (3e0 * count(*)) AS weight FROM flow GROUP BY label)
        SELECT label, count(*) AS n, round(sum(weight), 4) AS weight_sum, round(sum(weight * price), 2) AS weighted_price
        FROM flow JOIN weights USING (label) GROUP BY label""",
)
def row_weights(spark, folder):
    rows = flow(spark, folder)
    weighted = clean.row_weights(rows, client_ops.class_weights(rows))
    return rounded(
        weighted.groupBy("label").agg(
            F.count("*").alias("n"),
            F.sum("weight").alias("weight_sum"),
            F.sum(F.col("weight") * F.col("price")).alias("weighted_price"),
        ),
        4,
        weighted_price=2,
    )


@query("p24_drop_provenance", "SELECT s_suppkey, s_nationkey FROM supplier")
def drop_provenance(spark, folder):
    rows = table(spark, folder, "supplier").select(
        "s_suppkey", F.col("s_name").alias("original_file"), "s_nationkey", F.col("s_acctbal").alias("original_index")
    )
    return clean.drop_provenance(rows)
