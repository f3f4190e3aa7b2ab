"""Times the headline queries on $BENCH_SF_DIR and prints one JSON line.

Every query runs to the end over its whole tables; results go to a sink that drops them.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import QUERIES  # noqa: E402
from checks.views import raw_discharges  # noqa: E402
from cohortlens.plans.clean_job import clean_and_report  # noqa: E402
from cohortlens.plans.deliveries import stored_rows  # noqa: E402
from cohortlens.presets import discharge  # noqa: E402
from cohortlens.presets import fixed_values as fv  # noqa: E402
from cohortlens.session import with_settings  # noqa: E402
from cohortlens.sources import tables as T  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "revenue_by_region", "agg_two_dims", "agg_all_metrics", "agg_star_dims", "filter_and",
    "topk_sorted", "topk_default", "kpi_overview", "distribution_topn", "top_groups",
    "group_share", "assoc_rules", "assoc_rules_all", "risk_score", "risk_profile",
    "clean_text", "to_money", "dedup_exact", "dedup_documents", "train_sample",
    "model_metrics", "cost_model_metrics", "lexicon_score", "best_synonym", "filters_found",
    "intent_label", "numbers_in_text", "grounding",
)


def session(scratch: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.files.maxPartitionBytes", "16m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", scratch)
    )
    spark = with_settings(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = session(scratch)
    drain(QUERIES["agg_one_dim"](spark, SF_DIR))  # start the engine before the clock
    times = {name: timed(lambda: drain(QUERIES[name](spark, SF_DIR))) for name in HEADLINE}

    # The cleaning job and the first load start from a CSV file, as they do in production.
    raw, clean, clean_csv = (f"{scratch}/{n}" for n in ("raw", "clean", "clean_csv"))
    T.write_table(raw_discharges(spark, SF_DIR), raw, "csv")
    times["clean_job"] = timed(
        lambda: drain(
            clean_and_report(
                spark, raw, clean, discharge.CLEANING, fv.REPORT_FIELDS
            ).report
        )
    )
    T.write_table(stored_rows(spark, clean), clean_csv, "csv")
    times["first_load"] = timed(
        lambda: T.materialise(T.read_typed(spark, clean_csv, discharge.SCHEMA))
    )
    print(
        json.dumps(
            {
                "metric": "total_time_of_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
