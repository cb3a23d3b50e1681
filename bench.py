"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores. Every query runs once
unmeasured on the smallest data it can find, so that the figures leave out class loading, and once
measured.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shardscope.plans import QUERIES  # noqa: E402
from shardscope.session import get_session  # noqa: E402

HEADLINE = [
    "a5_percent_within_client",
    "a8_missingness",
    "a13_duplicates",
    "a14_robust_stats",
    "a15_robust_stats_by_class",
    "a17_pearson",
    "a18_spearman",
    "a19_anova",
    "a20_chi2",
    "a21_mutual_info",
    "a22_ks_drift",
    "a23_global_class_weights",
    "a26_per_class_metrics",
    "w7_round_history",
    "p3_screening",
    "p7_robust_scale",
    "p8_robust_scale_per_client",
    "p12_engineered_ratios",
    "m1_stratified_sample",
    "m2_train_test_split",
    "l4_batch_scoring",
    "l5_occlusion",
    "l6_shapley",
    "l9_local_training",
    "l10_server_step",
    "l11_control_step",
    "l13_prompts",
]


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="shardscope-bench-")
    spark = get_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": scratch,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = Path(folder).parent / "sf0.001"
    times: dict[str, float] = {}
    for name in HEADLINE:
        if small.is_dir():
            QUERIES[name](spark, str(small)).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    shutil.rmtree(scratch, ignore_errors=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    return 0


if __name__ == "__main__":
    sys.exit(main())
