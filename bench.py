"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
Every query is run to its end into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from starlens.catalog import load
from starlens.session import build_session

HEADLINE = (
    "f04_extended",
    "f05_f09_strategies",
    "q01_standardise_clean",
    "w01_dedup_first",
    "q13_strategy_comparison",
    "q07_s14_evaluate",
    "a20_venue_rollup",
    "w12_holdout_split",
    "w13_kfold",
    "j08_triplets",
    "q03_q04_augment_minority",
    "q02_training_set",
    "a24_star_tokens",
    "m01_j05_word_tfidf",
    "m02_char_tfidf",
    "m14_linear_scorer",
    "q06_score_reviews",
    "q08_venue_cache",
    "q09_s20_profile",
    "a30_corpus_fingerprint",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.log.level": "ERROR",
        },
    )
    queries = load()
    load()["a02_rating_distribution"].run(spark, folder).collect()  # start the session's workers
    seconds = {}
    for name in wanted:
        begin = time.perf_counter()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
