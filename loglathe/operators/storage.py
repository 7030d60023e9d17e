"""Where jobs keep data between stages: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session: the one already set, else ``spark.checkpoint.dir``.

    A machine-local folder is made only for a local session that names none.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loglathe-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the checkpoint folder for a written intermediate table."""
    return f"{use_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def with_cleanup(df: DataFrame, run: Callable[[DataFrame], None]) -> None:
    """``run(df)``, a job whose shuffle files are deleted at its end and not when the driver collects garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        run(df)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    system, hadoop_path = _file_system(spark, path)
    return system.exists(hadoop_path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that a job wrote itself."""
    system, hadoop_path = _file_system(spark, path)
    system.delete(hadoop_path, True)


def encoded_path(spark: SparkSession, path: str) -> str:
    """The path part of a full name, encoded as in the names of files that are read."""
    system, hadoop_path = _file_system(spark, path)
    return system.makeQualified(hadoop_path).toUri().getRawPath()


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, none if there is no such folder."""
    system, hadoop_path = _file_system(spark, path)
    return [f.getPath().getName() for f in system.listStatus(hadoop_path)] if system.exists(hadoop_path) else []


def file_sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Names and sizes of the files directly below a folder, none if there is no such folder."""
    system, hadoop_path = _file_system(spark, path)
    if not system.exists(hadoop_path):
        return {}
    return {f.getPath().getName(): f.getLen() for f in system.listStatus(hadoop_path) if f.isFile()}


def create_file(spark: SparkSession, path: str, text: str | bytes) -> bool:
    """Write a small file unless there is one of that name; of several writers one succeeds, where the store checks it."""
    system, hadoop_path = _file_system(spark, path)
    try:
        out = system.create(hadoop_path, False)
    except Exception:
        if system.exists(hadoop_path):
            return False
        raise
    try:
        out.write(bytearray(text.encode() if isinstance(text, str) else text))
    finally:
        out.close()
    return True


def read_file(spark: SparkSession, path: str) -> str:
    """Text of a small file."""
    system, hadoop_path = _file_system(spark, path)
    size = system.getFileStatus(hadoop_path).getLen()
    stream = system.open(hadoop_path)
    try:
        return bytes(b & 0xFF for b in stream.readNBytes(int(size))).decode()
    finally:
        stream.close()
