"""Seconds per headline query, as one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Every query is run
once to warm up and then timed into a sink that computes all its columns.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablegrist.plans.reports import load_all  # noqa: E402
from tablegrist.session import local_session  # noqa: E402

HEADLINE = [
    "big_orders_with_customer",
    "filtered_orders",
    "shipped_lineitems_in_year",
    "mean_order_by_segment",
    "sales_by_supplier",
    "daily_event_trend",
    "cleaned_lineitems",
    "lineitem_description",
    "order_description_by_narrowing",
    "common_part_values",
    "name_columns",
    "order_windows",
    "latest_order_per_customer",
    "normalised_documents",
    "document_windows",
    "repeated_source_lines",
    "documents_without_repeats",
    "cleaned_grids",
    "conversation_transcripts",
    "part_question_plans",
    "question_columns",
    "question_entities",
    "nearest_to_label_means",
    "nearest_rows_per_table",
    "scaled_lineitems",
    "part_postings_built",
    "part_posting_hits",
    "linear_ranking",
    "second_stage_ranking",
    "balances_across_tables",
    "customer_entities",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    reports = load_all()
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        try:
            for _ in range(2):  # the first run warms the JVM up
                start = time.perf_counter()
                reports[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
                seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as e:  # the others are timed all the same
            seconds.pop(name, None)
            failed[name] = f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}"
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
            | ({"failed": failed} if failed else {})
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
