"""Log lines, answers, objects and payloads derived from the given tables.

``*_SQL`` texts run unchanged in Spark and DuckDB and only shape input; operators and oracles are written apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglathe.operators.unwrap import split_text

NOW = "2026-06-01T00:00:00+00:00"

# One line per event in sixteen shapes.  Error events are sent twice, as by a sender that retries.  Views and clicks
# also leave one and the same probe line, so a single line text holds a quarter of all rows.
_FIELDS_SQL = """
SELECT event_id AS id, event_type AS et, 'user' || CAST(user_id AS STRING) AS u,
       '10.' || CAST(user_id % 256 AS STRING) || '.' || CAST(event_id % 256 AS STRING) || '.'
         || CAST(event_id % 254 + 1 AS STRING) AS ip,
       '192.168.' || CAST(user_id % 256 AS STRING) || '.' || CAST(event_id % 100 + 1 AS STRING) AS ip2,
       'host-' || CAST(user_id % 10 AS STRING) AS h, CAST(1024 + event_id % 60000 AS STRING) AS port,
       substr(CAST(ts AS STRING), 1, 10) AS d, substr(CAST(ts AS STRING), 12, 8) AS t,
       'Jan ' || lpad(CAST(CAST(substr(CAST(ts AS STRING), 9, 2) AS INT) AS STRING), 2, ' ') || ' '
         || substr(CAST(ts AS STRING), 12, 8) AS st
FROM events
"""

_RAW_SQL = """
CASE id % 16
  WHEN 0 THEN st || ' ' || h || ' sshd[' || port || ']: Accepted password for ' || u || ' from ' || ip || ' port ' || port || ' ssh2'
  WHEN 1 THEN '<13>' || st || ' ' || h || ' sshd[' || port || ']: Failed password for invalid user ' || u || ' from ' || ip || ' port ' || port || ' ssh2'
  WHEN 2 THEN st || ' ' || h || ' sudo: ' || u || ' : TTY=pts/1 ; PWD=/home/' || u || ' ; USER=root ; COMMAND=/usr/bin/apt-get update'
  WHEN 3 THEN st || ' ' || h || ' kernel: [UFW BLOCK] IN=eth0 OUT= SRC=' || ip || ' DST=' || ip2 || ' PROTO=TCP SPT=' || port || ' DPT=22 FLAGS=SYN'
  WHEN 4 THEN 'CEF:0|Suricata|ids|6.0|2001219|ET SCAN ' || et || '|8|src=' || ip || ' spt=' || port || ' dst=' || ip2 || ' dpt=443 proto=TCP'
  WHEN 5 THEN '{"timestamp":"' || d || 'T' || t || 'Z","eventName":"GetObject","userIdentity":{"userName":"' || u || '"},"sourceIPAddress":"' || ip || '","requestParameters":{"bucketName":"prod-data","key":"' || et || '.env"}}'
  WHEN 6 THEN '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>4625</EventID><Computer>' || h || '</Computer></System></Event>'
  WHEN 7 THEN '<log host="' || h || '"><user>' || u || '</user><ip>' || ip || '</ip></log>'
  WHEN 8 THEN d || ' ' || t || ',' || u || ',' || ip || ',' || et || ',' || port
  WHEN 9 THEN 'src=' || ip || ' dst=' || ip2 || ' user=' || u || ' action=' || et
  WHEN 10 THEN d || ' user ' || u || ' did ' || et || ' on ' || h
  WHEN 11 THEN 'user' || chr(9) || u || chr(9) || et
  WHEN 12 THEN '<34>1 ' || d || 'T' || t || 'Z ' || h || ' app - - - ' || et
  WHEN 13 THEN '[' || d || ' ' || t || '] INFO ' || et || ' ' || u
  WHEN 14 THEN 'Error,' || u || ',' || ip || ',' || et
  ELSE '   ' || st || ' ' || h || ' sshd[' || port || ']: Disconnected from user ' || u || ' ' || ip || ' port ' || port || '  '
END
"""

EVENT_LINES_SQL = f"""
WITH f AS ({_FIELDS_SQL}),
l AS (SELECT id AS line_id, et, {_RAW_SQL} AS raw FROM f)
SELECT line_id, raw FROM l
UNION ALL
SELECT line_id + 1000000000000 AS line_id, raw FROM l WHERE et = 'error'
UNION ALL
SELECT line_id + 2000000000000 AS line_id, 'Jan  1 00:00:00 lb-01 kernel: [UFW ALLOW] IN=eth0 OUT= SRC=10.0.0.1 DST=10.0.0.2 PROTO=TCP SPT=5000 DPT=443' AS raw
FROM l WHERE et IN ('view', 'click')
"""

# One answer per event: right, or with one of 22 defects.
ANSWERS_SQL = f"""
WITH f AS ({_FIELDS_SQL}),
g AS (
  SELECT id AS line_id, {_RAW_SQL} AS raw, id % 23 AS k, et, u, ip, ip2, h, d, t FROM f),
p AS (
  SELECT line_id, raw, k, et,
    CASE k WHEN 8 THEN '"1999-12-31T00:00:00Z"' WHEN 22 THEN '2024' ELSE '"' || d || 'T' || t || 'Z"' END AS event_ts,
    CASE k WHEN 15 THEN '' ELSE '"ts_source":null,' END AS ts_source,
    CASE k WHEN 5 THEN 'null' WHEN 14 THEN '5' ELSE '"' || h || '"' END AS source_host,
    CASE k WHEN 9 THEN '"Authentication"' ELSE '"authentication"' END AS category,
    CASE k WHEN 9 THEN '"SUCCESS"' ELSE '"success"' END AS outcome,
    CASE k WHEN 19 THEN 'true' ELSE '"' || et || '"' END AS action,
    CASE k WHEN 5 THEN '"web-01"' WHEN 6 THEN '"web-01"' WHEN 7 THEN '"web-01.example.com"' WHEN 21 THEN '" ' || ip || ' "' ELSE '"' || ip || '"' END AS src_ip,
    CASE k WHEN 6 THEN '"db-01"' ELSE '"' || ip2 || '"' END AS dst_ip,
    CASE k WHEN 14 THEN '7' ELSE 'null' END AS target,
    '"' || et || ' | by ' || u || ' = ok"' AS message,
    CASE k WHEN 19 THEN '[1]' WHEN 13 THEN '"x"' ELSE '{{"a":1,"k":"' || et || '"}}' END AS extras,
    CASE k WHEN 10 THEN '"0.9"' WHEN 11 THEN '1.5' WHEN 12 THEN '0.4' WHEN 13 THEN '"90%"' WHEN 20 THEN 'true' ELSE '0.9' END AS confidence,
    CASE k WHEN 17 THEN '"yes"' WHEN 18 THEN 'null' ELSE 'false' END AS review_flag
  FROM g),
j AS (
  SELECT line_id, raw, k, et,
    '{{"event_hash":null,"event_ts":' || event_ts || ',' || ts_source || '"source_host":' || source_host
    || ',"category":' || category || ',"action":' || action || ',"outcome":' || outcome || ',"actor_user":"' || et
    || '","src_ip":' || src_ip || ',"target":' || target || ',"dst_ip":' || dst_ip || ',"message":' || message
    || ',"raw":null,"extras":' || extras || ',"confidence":' || confidence || ',"review_flag":' || review_flag
    || ',"validation_issues":[],"format_hint":null,"unknown":1}}' AS ok
  FROM p)
SELECT line_id, raw,
  CASE k WHEN 1 THEN '```json' || chr(10) || ok || chr(10) || '```'
         WHEN 2 THEN 'Here is the event: ' || ok || ' as asked.'
         WHEN 3 THEN 'I cannot read this ' || et || ' line. ' || repeat('sorry ', 30)
         WHEN 4 THEN CASE et WHEN 'click' THEN 'null' WHEN 'view' THEN '[1]' WHEN 'error' THEN '' WHEN 'signup' THEN ok || ' ' || ok ELSE '{{"category":"network"}}' END
         WHEN 16 THEN NULL
         ELSE ok END AS ai_response,
  CASE k WHEN 16 THEN 'timeout for ' || et END AS error
FROM j
"""

# Twenty lines per object; every third object belongs to connection 0, which so holds a third of all bytes.
_OBJECT_LINES_SQL = f"""
SELECT id AS line_id, CAST(floor(id / 20) AS BIGINT) AS object_id, {_RAW_SQL} AS raw FROM ({_FIELDS_SQL}) f
"""

CHUNK_BYTES = 37


#: Rows of a given table that a task takes.
TASK_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table to tasks where its parts are few, large or uneven.

    A row group of a file is not split, so a file that was cut into many parts may have all its rows in a few of them: the
    rows count, not the parts.
    """
    parts = df.groupBy(F.spark_partition_id().alias("part")).count()
    held = parts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.coalesce(F.max("count"), F.lit(0)).alias("most"))
    found = held.first()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions(), -(-found["rows"] // TASK_ROWS))
    return df.repartition(tasks) if found["most"] * tasks > 2 * found["rows"] else df


def spread_tasks(df: DataFrame) -> int:
    """Tasks among which the rows of ``df`` are dealt by a key."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _sql(spark: SparkSession, sf_dir: str, text: str, name: str = "events") -> DataFrame:
    table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, EVENT_LINES_SQL)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, ANSWERS_SQL)


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, line_id, raw``: event lines, and every text line of documents, pages and conversations."""

    def lines_of(name: str, key: str, text: str) -> DataFrame:
        objects = table(spark, sf_dir, name).select(F.expr(key).alias("k"), F.col(text).alias("text"))
        return split_text(objects).select(
            F.lit(name).alias("source"), (F.col("k") * 1000000 + F.col("pos")).alias("line_id"), "raw"
        )

    events = event_lines(spark, sf_dir).select(F.lit("events").alias("source"), "line_id", "raw")
    return (
        events.unionByName(lines_of("documents", "doc_id", "text"))
        .unionByName(lines_of("pages", "page_id", "html"))
        .unionByName(lines_of("conversations", "conv_id * 10000 + turn", "text"))
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``object_id, text``: envelopes of JSON strings-as-records for even objects, plain lines for odd ones."""
    lines = _sql(spark, sf_dir, _OBJECT_LINES_SQL)
    listed = lines.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("line_id", "raw"))).alias("ls"))
    records = F.transform("ls", lambda x: F.concat(
        F.lit('{ "n" : '), x["line_id"].cast("string"), F.lit(', "tag":["é", null] }')
    ))
    envelope = F.concat(F.lit(' {"Records": ['), F.array_join(records, " , "), F.lit("]}\n"))
    plain = F.array_join(F.transform("ls", lambda x: x["raw"]), "\r\n")
    return listed.select(
        "object_id", F.when(F.col("object_id") % 2 == 0, envelope).otherwise(plain).alias("text")
    )


def chunks(spark: SparkSession, sf_dir: str, thirds: bool = False) -> DataFrame:
    """``conn_id, seq, payload``: object bytes cut every 37 bytes, and one connection per document.

    With ``thirds`` also ``t``, 0 to 2, which grows with ``seq`` in each connection: thirds of a document, and of all objects.
    """
    lines = _sql(spark, sf_dir, _OBJECT_LINES_SQL)
    listed = lines.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("line_id", "raw"))).alias("ls"))
    plain = listed.select(
        F.when(F.col("object_id") % 3 == 0, 0).otherwise(F.col("object_id") % 50 + 1).cast("long").alias("conn_id"),
        (F.col("object_id") * 100000).alias("base"),
        F.array_join(F.transform("ls", lambda x: x["raw"]), "\n").alias("text"),
    )
    docs = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 1000).alias("conn_id"), F.lit(0).cast("long").alias("base"), "text"
    )
    # parts of bytes are taken in place; in a text, every part is looked for from its beginning
    coded = plain.unionByName(docs).withColumn("b", F.encode("text", "utf-8")).where(F.length("b") > 0)
    last = F.floor((F.length("b") - 1) / CHUNK_BYTES).cast("int")
    seq = (F.col("base") + F.col("i")).alias("seq")
    payload = F.substring("b", F.col("i") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)).alias("payload")
    cut = coded.select("conn_id", "base", "b", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    if not thirds:
        return cut.select("conn_id", seq, payload)
    objects_ = lines.agg(F.coalesce(F.max("object_id"), F.lit(0)) + 1).first()[0]
    in_text = F.floor(3 * F.col("i") / (last + 1))
    of_objects = F.floor(3 * F.col("base") / F.lit(100000 * objects_))
    third = F.when(F.col("conn_id") < 1000, of_objects).otherwise(in_text)
    return cut.select("conn_id", seq, payload, third.cast("int").alias("t"))


def datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``msg_id, payload``: whole documents with one to three line feeds at the end; for each an empty one, ``-1 - msg_id``."""
    docs = table(spark, sf_dir, "documents")
    feeds = F.repeat(F.lit("\n"), (F.col("doc_id") % 3 + 1).cast("int"))
    full = docs.select(F.col("doc_id").alias("msg_id"), F.encode(F.concat("text", feeds), "utf-8").alias("payload"))
    blank = docs.select((-1 - F.col("doc_id")).alias("msg_id"), F.encode(feeds, "utf-8").alias("payload"))
    return full.unionByName(blank)


def mixed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``object_id, text``: envelopes whose records are texts, and null for every seventh line."""
    lines = _sql(spark, sf_dir, _OBJECT_LINES_SQL)
    record = F.when(F.col("line_id") % 7 == 0, "null").otherwise(F.to_json(F.to_variant_object(F.struct("raw"))))
    quoted = F.regexp_replace(record, r'(?s)\A\{"raw":(.*)\}\z', "$1")
    listed = lines.select("object_id", F.struct("line_id", quoted.alias("r")).alias("l")).groupBy("object_id").agg(
        F.array_sort(F.collect_list("l")).alias("ls")
    )
    inner = F.array_join(F.transform("ls", lambda x: x["r"]), ", ")
    return listed.select("object_id", F.concat(F.lit('{"Records" : ['), inner, F.lit("]}")).alias("text"))
