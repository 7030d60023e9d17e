"""Line, object and file sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import detect as d, fixed
from ..functions.text import strip
from ..operators.storage import encoded_path, path_exists, use_checkpoint_dir
from ..operators.unwrap import object_lines, split_text
from .byte_lines import ByteLines
from .envelopes import read_keys
from .heads import FileHeads
from .store import reachable

_METADATA = {"file_path": "file_path", "block_start": "file_block_start"}


def _reader(spark: SparkSession, streaming: bool, tolerant: bool, options: dict):
    reader = (spark.readStream if streaming else spark.read).option("recursiveFileLookup", "true")
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return reader.options(**options)


def _checked(text: Column, errors: str) -> Column:
    if errors not in ("replace", "strict"):
        raise ValueError(f"errors must be 'replace' or 'strict', got {errors!r}")
    return F.make_valid_utf8(text) if errors == "replace" else F.validate_utf8(text)


def read_lines(
    spark: SparkSession,
    path: str | list[str],
    streaming: bool = False,
    start: str = "earliest",
    start_time: str | None = None,
    errors: str = "strict",
    tolerant: bool = False,
    encoding: str = "utf-8",
    growing: bool = False,
    **options,
) -> DataFrame:
    """Lines of files: ``raw, file_path, block_start, line_id``.

    Empty lines are dropped, lines of white space are kept.  Files split across tasks, and ``(file_path,
    block_start, line_id)`` orders the lines; a stream has no ``line_id``, it is given to each micro-batch.

    ``start="latest"`` keeps only files modified after ``start_time`` (default: now); Spark applies that filter to
    the file listing.

    Other encodings than UTF-8, and with ``growing`` a stream of files that are appended to, are read by the ``byte_lines``
    source: tasks open the files themselves, so it needs a path that they reach (see ``store``).  There, ``block_start`` is
    the place of a line in its file, and ``start="latest"`` means what is appended from the stream's first start on.

    ``tolerant`` skips unreadable files; on a stream the checkpoint then counts them as done.  Other options go to
    the reader, for example ``maxFilesPerTrigger`` or ``cleanSource`` with ``sourceArchiveDir``.
    """
    if start not in ("earliest", "latest"):
        raise ValueError(f"start must be 'earliest' or 'latest', got {start!r}")
    if growing or encoding.lower().replace("_", "-") not in ("utf-8", "utf8"):
        return _byte_lines(spark, path, streaming, start, start_time, errors, encoding, options)
    text = _reader(spark, streaming, tolerant, options).text(path)
    columns = [F.col(f"_metadata.{source}").alias(name) for name, source in _METADATA.items()]
    if start == "latest":
        since = F.lit(start_time).cast("timestamp") if start_time else F.lit(_now(spark))
        text = text.where(F.col("_metadata.file_modification_time") > since)
    lines = text.where(F.col("value") != "").select(_checked(F.col("value"), errors).alias("raw"), *columns)
    return lines if streaming else with_line_id(lines)


def _byte_lines(spark, path, streaming, start, start_time, errors, encoding, options) -> DataFrame:
    if not isinstance(path, str) or not reachable(path):
        raise ValueError(f"only one path that tasks can open can be read byte by byte, got {path!r}")
    if start_time or (start == "latest" and not streaming):
        raise ValueError("byte by byte, start='latest' is for streams and has no start_time")
    spark.dataSource.register(ByteLines)
    reader = (spark.readStream if streaming else spark.read).format(ByteLines.name())
    options = {"encoding": encoding, "errors": errors, "start": start, **options}
    return reader.options(**options).load(path)


def _now(spark: SparkSession):
    return spark.range(1).select(F.current_timestamp()).first()[0]


def with_line_id(lines: DataFrame) -> DataFrame:
    """Number lines that have no number yet, in read order within each split of a file."""
    place = F.monotonically_increasing_id()
    return lines.withColumn("line_id", F.coalesce("line_id", place) if "line_id" in lines.columns else place)


def list_keys(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Keys and sizes of the objects under a prefix; contents are not read."""
    root, prefix = _prefix_root(path, prefix)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    keys = listing.select(F.col("_metadata.file_path").alias("file_path"), F.col("length"))
    return _with_prefix(keys, root, prefix)


def new_keys(keys: DataFrame, processed: DataFrame) -> DataFrame:
    """Keys that are not in the table of processed keys."""
    return keys.join(processed.select("file_path"), "file_path", "left_anti")


def _prefix_root(path: str, prefix: str) -> tuple[str, str]:
    """Deepest folder of a key prefix, which need not end at a folder, and the rest of the prefix."""
    folder, _, rest = prefix.lstrip("/").rpartition("/")
    return (f"{path.rstrip('/')}/{folder}" if folder else path.rstrip("/")), rest


def _with_prefix(df: DataFrame, root: str, prefix: str) -> DataFrame:
    if not prefix:
        return df
    # paths of files are encoded and name the whole root, so the prefix is brought into that form
    start = encoded_path(df.sparkSession, f"{root}/{prefix}")
    return df.where(F.regexp_replace("file_path", "^[A-Za-z0-9+.-]+:(//[^/]*)?", "").startswith(start))


def read_objects(
    spark: SparkSession,
    path: str | list[str],
    prefix: str = "",
    streaming: bool = False,
    tolerant: bool = False,
    **options,
) -> DataFrame:
    """Objects under a prefix, one row each: ``file_path, text``.

    Objects with a ``.gz`` suffix are unpacked by the reader; each such object is one task.  Bytes that are not
    UTF-8 are replaced.
    """
    root, rest = (path, "") if isinstance(path, list) else _prefix_root(path, prefix)
    objects = _reader(spark, streaming, tolerant, options).text(root, wholetext=True)
    keyed = objects.select(
        F.col("_metadata.file_path").alias("file_path"), F.make_valid_utf8("value").alias("text")
    )
    return keyed if isinstance(root, list) else _with_prefix(keyed, root, rest)


def load_objects(
    spark: SparkSession,
    path: str,
    prefix: str = "",
    processed: DataFrame | None = None,
    envelopes: bool = True,
    streaming: bool = False,
    tolerant: bool = False,
    encoding: str = "utf-8",
    **options,
) -> DataFrame:
    """Lines of plain, gzip and envelope objects: ``file_path, block_start, line_id, raw``; only new keys when given.

    In a batch, tasks open the objects themselves where they reach the path (see ``store``) and emit records one by one,
    so an envelope may be larger than a task's memory.  Elsewhere and in a stream, each object is one row.  Without
    ``envelopes``, objects are read as text lines and large ones split across tasks.

    In a batch, ``processed`` names the keys already done (see ``ProcessedKeys``).  In a stream, the checkpoint keeps them.
    """
    plain = encoding.lower().replace("_", "-") in ("utf-8", "utf8")
    own = not streaming and reachable(path)
    if not plain and not own:
        raise ValueError(f"objects in {encoding!r} can only be read in a batch from a path that tasks can open")
    if processed is not None or (own and envelopes):
        keys = list_keys(spark, path, prefix)
        fresh = keys if processed is None else new_keys(keys, processed)
        if own:
            return _as_lines(read_keys(fresh, tolerant, encoding=encoding).where("error IS NULL"))
        objects = read_objects(spark, path, prefix, tolerant=tolerant, **options)
        return _as_lines(object_lines(objects.join(fresh.select("file_path"), "file_path", "left_semi")))
    if not envelopes:
        root, rest = _prefix_root(path, prefix)
        lines = read_lines(spark, root, streaming, errors="replace", tolerant=tolerant, encoding=encoding, **options)
        numbered = lines if streaming else lines.drop("line_id")
        pieces = _with_prefix(split_text(numbered, "raw"), root, rest).drop("pos")
        return pieces if streaming else with_line_id(pieces).select("file_path", "block_start", "line_id", "raw")
    return _as_lines(object_lines(read_objects(spark, path, prefix, streaming, tolerant, **options)))


def _as_lines(rows: DataFrame) -> DataFrame:
    place = F.col("pos" if "pos" in rows.columns else "line_id")
    return rows.select("file_path", F.lit(0).cast("long").alias("block_start"), place.cast("long").alias("line_id"), "raw")


class ProcessedKeys:
    """Which objects were read, and which could not be: a Parquet table ``file_path, error, batch_id`` of runs.

    A key without error is done.  One with errors is tried again until it failed in ``max_attempts`` runs.
    """

    SCHEMA = "file_path STRING, error STRING, batch_id BIGINT"

    def __init__(self, spark: SparkSession, path: str, max_attempts: int = 3) -> None:
        self.spark, self.path, self.max_attempts = spark, path, max_attempts

    def rows(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def settled(self, without: int = -1) -> DataFrame:
        """Keys that need no further try; ``without`` leaves out what one run recorded, so that it can be repeated."""
        tries = self.rows().where(F.col("batch_id") != without).groupBy("file_path")
        counted = tries.agg(F.count("error").alias("failures"), F.count("*").alias("tries"))
        return counted.where(f"tries > failures OR failures >= {int(self.max_attempts)}").select("file_path")

    def fresh(self, keys: DataFrame, without: int = -1) -> DataFrame:
        return new_keys(keys, self.settled(without))

    def record(self, outcome: DataFrame, batch_id: int) -> None:
        """Keep ``file_path, error`` of one run; repeated, it replaces what it recorded."""
        rows = outcome.select("file_path", "error")
        rows.write.mode("overwrite").parquet(f"{self.path}/batch_id={int(batch_id)}")


def take_objects(
    spark: SparkSession, path: str, keys: ProcessedKeys, write, batch_id: int, prefix: str = "", encoding: str = "utf-8"
) -> DataFrame:
    """Read the objects that are new or due for another try, give their lines to ``write(lines)``, then record the keys.

    Keys are recorded after the lines are out, so a run that is lost reads them again; writing has to bear that, as
    ``run_batch`` does.  Returns the outcome: ``file_path, error`` of the objects of this run.  An object that breaks off
    while it is read gives no line in this run.
    """
    use_checkpoint_dir(spark)
    fresh = keys.fresh(list_keys(spark, path, prefix), batch_id).checkpoint()
    read = read_keys(fresh, tolerant=True, encoding=encoding).checkpoint()
    broken = read.where("error IS NOT NULL").select("file_path", "error")
    write(_as_lines(read.where("error IS NULL").join(broken, "file_path", "left_anti")))
    outcome = fresh.select("file_path").join(broken, "file_path", "left")
    keys.record(outcome, batch_id)
    return keys.rows().where(F.col("batch_id") == batch_id).select("file_path", "error")


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every file below a path, empty ones too: ``file_path, file_name, suffix``.

    Scans leave out empty files, so the names come from Spark's file index, which the driver holds for any scan.
    """
    index = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = spark.createDataFrame([(name,) for name in index.inputFiles()], "name STRING")
    encoded = F.regexp_extract("file_path", r"[^/]*\z", 0)
    return (
        # Scans write a path without authority with one slash.
        listed.select(F.regexp_replace("name", r"^([A-Za-z0-9+.\-]+):///", "$1:/").alias("file_path"))
        .withColumn("file_name", F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))))
        .withColumn("suffix", _suffix(F.col("file_name")))
    )


def _suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.[^.]*\z", 0))


def detect_files(spark: SparkSession, path: str | list[str], tolerant: bool = True) -> DataFrame:
    """One format hint per file: ``file_path, format, confidence, hint, raw_sample``.

    The hint of a file is that of its first line that is not blank; ``.evtx`` files are labelled by name and not read.
    Where tasks can open the path (see ``store``), they read the beginnings of groups of files and no more, and a file
    that can't be read is reported as such (or fails the job, if not ``tolerant``).  Elsewhere Spark's reader goes through
    the files, and a file that it can't read looks empty.
    """
    paths = path if isinstance(path, list) else [path]
    return _detect_heads(spark, paths, tolerant) if all(map(reachable, paths)) else _detect_scan(spark, path, tolerant)


def _detect_heads(spark: SparkSession, paths: list[str], tolerant: bool) -> DataFrame:
    spark.dataSource.register(FileHeads)
    reader = spark.read.format(FileHeads.name()).option("tolerant", str(tolerant).lower())
    found = reduce(DataFrame.unionByName, [reader.load(p) for p in paths])
    x, label, binary = F.col("sample"), F.col("format"), F.col("suffix") == ".evtx"
    first = found.withColumn("format", d.format_label(F.coalesce(x, F.lit(""))))
    evtx = (label == "xml") & F.col("suffix").isin(".xml", ".log") & d.is_evtx(F.col("head"))
    labelled = first.withColumn(
        "format", F.when(binary | evtx, "evtx_xml").when(x.isNull(), "unknown").otherwise(label)
    )
    return labelled.select(
        "file_path",
        "format",
        F.when(x.isNull() & ~binary, F.lit(0.0)).otherwise(d.format_confidence(label, F.coalesce(x, F.lit("")))).alias("confidence"),
        d.guidance(label).alias("hint"),
        F.when(binary, F.concat(F.lit("[binary EVTX file: "), F.col("file_name"), F.lit("]")))
        .when(F.col("error").isNotNull(), F.concat(F.lit(fixed.UNREADABLE_FILE_SAMPLE), F.col("error"), F.lit("]")))
        .when(x.isNull(), F.lit(fixed.EMPTY_FILE_SAMPLE))
        .otherwise(d.raw_sample(x))
        .alias("raw_sample"),
    )


def _detect_scan(spark: SparkSession, path: str | list[str], tolerant: bool) -> DataFrame:
    """``detect_files`` by Spark's text reader: per file the first line is a grouped minimum."""
    name = F.col("_metadata.file_name")
    suffix = _suffix(name)
    listing = list_files(spark, path)
    text = _reader(spark, False, tolerant, {}).text(path)
    lines = (
        text.where(~F.lower(name).endswith(".evtx"))
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            suffix.alias("suffix"),
            F.make_valid_utf8("value").alias("value"),
            F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
        )
    )
    first = (
        lines.withColumn("sample", strip(F.col("value")))
        .where("sample <> ''")
        .groupBy("file_path", "suffix")
        .agg(F.min_by("sample", "place").alias("sample"))
        .withColumn("format", d.format_label(F.col("sample")))
    )
    # One row per file, used twice: written once, so the lines are scanned once for it.
    use_checkpoint_dir(spark)
    first = first.checkpoint()
    heads = _evtx_heads(spark, lines, first)
    x, label = F.col("sample"), F.col("format")
    is_binary = F.col("suffix") == ".evtx"
    found = listing.join(first.drop("suffix"), "file_path", "left").join(heads, "file_path", "left")
    labelled = found.withColumn(
        "format",
        F.when(is_binary | F.col("evtx"), "evtx_xml").when(x.isNull(), "unknown").otherwise(label),
    )
    return labelled.select(
        "file_path",
        "format",
        F.when(x.isNull() & ~is_binary, F.lit(0.0))
        .otherwise(d.format_confidence(label, F.coalesce(x, F.lit(""))))
        .alias("confidence"),
        d.guidance(label).alias("hint"),
        F.when(is_binary, F.concat(F.lit("[binary EVTX file: "), F.col("file_name"), F.lit("]")))
        .when(x.isNull(), F.lit(fixed.EMPTY_FILE_SAMPLE))
        .otherwise(d.raw_sample(x))
        .alias("raw_sample"),
    )


def _evtx_heads(spark: SparkSession, lines: DataFrame, first: DataFrame) -> DataFrame:
    """XML files by first line whose first characters hold event log markers.

    A character takes at most four bytes, so only splits that begin near the start of a file can hold its head.  A
    line takes at least one character, so the head needs at most that many lines; Spark limits each file to them in
    every map task before the shuffle.
    """
    limit = "spark.sql.optimizer.windowGroupLimitThreshold"
    if 0 <= int(spark.conf.get(limit)) < fixed.EVTX_HEAD_CHARS:
        spark.conf.set(limit, str(fixed.EVTX_HEAD_CHARS))
    candidates = first.where((F.col("format") == "xml") & F.col("suffix").isin(".xml", ".log"))
    order = Window.partitionBy("file_path").orderBy("place")
    head = (
        lines.where(F.col("suffix").isin(".xml", ".log"))
        .where(F.col("place")["file_block_start"] < 4 * fixed.EVTX_HEAD_CHARS)
        # Of a longer line only the part that can lie in the head matters; the length keeps the positions.
        .select(
            "file_path",
            "place",
            F.length("value").alias("_chars"),
            F.substring("value", 1, fixed.EVTX_HEAD_CHARS).alias("value"),
        )
        .withColumn("_row", F.row_number().over(order))
        .where(F.col("_row") <= fixed.EVTX_HEAD_CHARS)
        .join(candidates.select("file_path"), "file_path", "left_semi")
        .withColumn("_start", F.sum(F.col("_chars") + 1).over(order) - F.col("_chars") - 1)
        .where(F.col("_start") < fixed.EVTX_HEAD_CHARS)
        .groupBy("file_path")
        .agg(F.array_sort(F.collect_list(F.struct("_start", "value"))).alias("_lines"))
    )
    text = F.substring(
        F.array_join(F.transform("_lines", lambda line: line["value"]), "\n"), 1, fixed.EVTX_HEAD_CHARS
    )
    return head.withColumn("_text", text).select("file_path", d.is_evtx(F.col("_text")).alias("evtx"))


def profile_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files per format."""
    return detect_files(spark, path).groupBy("format").agg(F.count("*").alias("files"))
