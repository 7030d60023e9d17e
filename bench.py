"""Headline timings: prints one JSON line.  ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from checks import corpus
from checks.corpus import NOW
from checks.queries import _user_files, fake_extractor
from loglathe.operators.dedup import dedup_new
from loglathe.operators.detection import with_format
from loglathe.operators.extraction import extract_rules, extract_with
from loglathe.operators.framing import frame_chunks
from loglathe.operators.metrics import status_counts
from loglathe.operators.storage import work_path
from loglathe.plans import jobs
from loglathe.plans.sinks import Sinks, run_batch
from loglathe.sources.files import detect_files

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # The generated code of the long projections exceeds the size up to which the JVM compiles a method.
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    lines = corpus.event_lines(spark, SF_DIR).cache()
    all_lines = corpus.all_lines(spark, SF_DIR).cache()
    answers = with_format(corpus.answers(spark, SF_DIR)).drop("sample").cache()
    chunks = corpus.chunks(spark, SF_DIR).cache()
    user_files = _user_files(spark, SF_DIR)
    size = {"lines": lines.count(), "all_lines": all_lines.count(), "answers": answers.count(), "chunks": chunks.count()}
    jobs_ = {
        "detect": ("all_lines", lambda: run(with_format(all_lines))),
        "extract_rules": ("lines", lambda: run(extract_rules(lines))),
        "parse": ("lines", lambda: run(jobs.parse(lines, ingest_ts=NOW))),
        "heal": ("answers", lambda: run(jobs.heal(answers, NOW))),
        "dedup": ("lines", lambda: run(dedup_new(jobs.parse(lines, ingest_ts=NOW)))),
        "frame_chunks": ("chunks", lambda: run(frame_chunks(chunks))),
        "run_batch": ("lines", lambda: run_batch(lines, Sinks.under(work_path(spark, "bench")), ingest_ts=NOW)),
        "extract_with": ("lines", lambda: run(extract_with(lines, fake_extractor))),
        "detect_files": ("lines", lambda: run(detect_files(spark, user_files))),
        "status_counts": ("lines", lambda: run(status_counts(jobs.parse(lines, ingest_ts=NOW)))),
    }
    seconds, rate = {}, {}
    for name, (unit, job) in jobs_.items():
        best = None
        for _ in range(RUNS):
            start = time.perf_counter()
            job()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        rate[name] = round(size[unit] / best)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_best_of_two",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rate,
                "rows": size,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
