"""Times the headline queries; prints one JSON line.

All queries run in two rounds of one session and the faster run of each counts; a run includes building the plan
and computing every row (written to a sink that discards them).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from signalmill.plans.catalog import QUERIES  # noqa: E402
from signalmill.session import build_session  # noqa: E402

HEADLINE = [
    "bars_resample", "ta_record", "ind_rsi", "ind_macd", "ind_long_history", "volatility", "risk_flags",
    "resp_confidence", "agg_score", "run_decisions", "call_cost", "call_summary", "call_dashboard_summary",
    "call_box_stats", "cost_agent_model", "snap_combined", "mix_share", "ing_spot_prices", "news_dedupe_multi",
    "sentiment_summary", "ticker_mentions_top5", "metric_latency_15m", "metric_counts_15m", "alarm_eval",
    "sql_direction_distribution", "sink_upsert",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "signalmill-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false", spark__python__sql__dataFrameDebugging__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    first = {name: once(name) for name in HEADLINE}
    seconds = {name: round(min(first[name], once(name)), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
