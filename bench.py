"""Time the headline queries and print one JSON line.

Each query runs twice in one session, results thrown away: ``cold`` is the first run, ``queries``
(and ``value``, their sum) the second. Set BENCH_SF_DIR and BENCH_CPUS to change data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracemill import fixtures as fx  # noqa: E402
from tracemill.catalog.queries import all_queries  # noqa: E402
from tracemill.session import build_session  # noqa: E402

HEADLINE = [
    "prepare_gold_set",
    "rendered_gold",
    "m5_render_text",
    "m7_render_template",
    "t1_tokenize",
    "t2_dictionary",
    "t3_overlap_mask",
    "s4_write_tokenized",
    "b1_split",
    "b5_pad_batch",
    "k1_top_k",
    "k9_position_kl",
    "k14_batch_kl",
    "a3_running_loss",
    "build_score_cache",
    "evaluate_epoch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    cold = {name: run(name) for name in HEADLINE}
    warm = {name: run(name) for name in HEADLINE}
    # t1 and evaluation read all conversations, the score cache the gold ones.
    tokens = fx.conversation_tokens(spark, sf_dir, offsets=False).count()
    gold_tokens = fx.gold_tokens(spark, sf_dir, offsets=False).count()
    print(
        json.dumps(
            {
                "metric": "headline queries, second run, total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "cold": cold,
                "cold_total": round(sum(cold.values()), 3),
                "tokens": tokens,
                "gold_tokens": gold_tokens,
                "tokens_per_sec": {
                    "t1_tokenize": round(tokens / warm["t1_tokenize"]),
                    "build_score_cache": round(gold_tokens / warm["build_score_cache"]),
                    "evaluate_epoch": round(2 * tokens / warm["evaluate_epoch"]),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
