"""Files that queries read, written by tasks: one for each value of a key."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loglathe.sources.store import open_store, reachable

from .corpus import spread_tasks

#: What Spark's writers name the folder of a null.
NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def write_files(
    rows: DataFrame, path: str, key: str, *order: str, begin: str = "", between: str = "\n", end: str = "\n", suffix: str = ".txt"
) -> None:
    """``value`` of all rows of a key in one file ``<key>=<its value><suffix>`` below ``path``, by ``order``.

    Files are named by keys, so a folder and a file of a task's own name for each are not needed, nor is a commit on the
    driver that moves them one by one: a file has another name until it is whole, and a task that is repeated writes the
    same once more.  Rows stream through the task, which holds a batch.  Where tasks can't open the path, Spark writes.
    """
    tasks = spread_tasks(rows)
    named = rows.select(F.coalesce(F.col(key).cast("string"), F.lit(NO_KEY)).alias("key"), "value", *order)
    if not reachable(path):
        return _write_whole(named, path, key, order, begin, between, end)
    kind = "gzip" if suffix.endswith(".gz") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = open_store(path)
        store.create_dir(inner, recursive=True)
        now, out, own, count = None, None, "", 0

        def close() -> None:
            if out is not None:
                out.write(end.encode())
                out.close()
                store.move(own, f"{inner}/{key}={now}{suffix}")

        for batch in batches:
            if not batch.num_rows:
                continue
            names, texts = batch.column(0), batch.column(1)
            codes = names.dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                name, lead = names[i].as_py(), between
                if name != now:
                    close()
                    now, own, lead, count = name, f"{inner}/_{uuid.uuid4().hex}", begin, count + 1
                    out = store.open_output_stream(own, compression=kind)
                out.write((lead + between.join(texts.slice(i, j - i).to_pylist())).encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["files"])

    dealt = named.repartition(tasks, "key").sortWithinPartitions("key", *order).select("key", "value")
    dealt.mapInArrow(run, "files long").agg(F.sum("files")).first()


def _write_whole(named: DataFrame, path: str, key: str, order, begin: str, between: str, end: str) -> None:
    """The same contents by Spark's writer, a row for each file."""
    listed = named.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*order, "value"))).alias("rows"))
    text = F.concat(F.lit(begin), F.array_join(F.transform("rows", lambda x: x["value"]), between), F.lit(end))
    listed.select(F.col("key").alias(key), text.alias("value")).write.partitionBy(key).option("lineSep", "\0").text(path)
