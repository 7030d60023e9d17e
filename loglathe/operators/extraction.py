"""Field extraction: the rule extractor as a projection, and user extractors on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import fixed, rules
from ..functions.detect import prompt_context
from ..functions.text import event_hash
from .detection import detect, with_format
from .once import evaluate_once
from .skew import join_by_hash
from .storage import use_checkpoint_dir

SYSTEM_PROMPT = """\
You read security log lines and return the fields they state.
- src_ip: address of the client, attacker or sender (ssh: after "from"; firewall and CEF: src= or SRC=).
- dst_ip: address of the destination (dst= or DST=); never place it in target.
- actor_user: account that acted (ssh: after "for"; sudo: after "sudo:"; CEF: suser=).
- source_host: host that wrote the line (syslog: token after the time); never an address.
- action: a short verb such as login, disconnect, sudo, block, allow.
- target: the resource named in the line (file, bucket, URL, service); never an address or a command.
- category: authentication, network, file, process or other. outcome: success, failure or unknown.
- event_ts: ISO 8601 UTC only when the line states a time, otherwise null.
- message: a one-line summary. confidence: 0.0 to 1.0, below 0.7 when in doubt.
- event_hash, ts_source and format_hint are null, review_flag is false, validation_issues is [], extras is {}.
Use null for what the line does not state. Answer with one JSON object that has all of these keys, and nothing else."""


def prompt(raw: Column, hint: Column, system_prompt: str = SYSTEM_PROMPT) -> Column:
    """System text, hint context, instruction and the raw line."""
    user = F.concat_ws("\n\n", prompt_context(hint), F.lit(fixed.PROMPT_INSTRUCTION), raw)
    return F.concat(F.lit(system_prompt + fixed.PROMPT_USER), user)


def build_prompt(lines: DataFrame, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """Add ``prompt`` to a table with ``raw`` and ``hint``."""
    return lines.withColumn("prompt", prompt(F.col("raw"), F.col("hint"), system_prompt))


def with_rule_fields(lines: DataFrame, json_actor: bool = False) -> DataFrame:
    """Add a struct ``found`` with the fields that the rules read from each line; keeps ``format_hint``.

    Several projections, so that the parsed JSON record, the line shape and the line body are computed once.
    """
    x, label = F.col("sample"), F.col("format_hint")
    j, shape = F.col("_record"), F.col("_shape")
    base = lines if {"sample", "format_hint"} <= set(lines.columns) else with_format(lines)
    process, body, verb = F.col("_process"), F.col("_body"), F.col("_verb")
    step = (
        base.withColumns(
            {
                "_record": rules.json_record(x, label),
                "_process": rules.process(x, label),
                "_verb": rules.firewall_verb(x, label),
                "_dst": rules.dst_ip(x),
                "_host": rules.source_host(x, label),
            }
        )
        .withColumns(
            {
                "_shape": rules.shape(label, j, process, verb),
                "_body": rules.body(x, process),
                "_src": rules.src_ip(x, j),
                "_user": rules.actor_user(x, j, json_actor),
            }
        )
        .withColumn("_target", rules.target(shape, j))
        .withColumn(
            "_message",
            rules.message(
                x, shape, j, body, verb, F.col("_src"), F.col("_dst"), F.col("_user"), F.col("_target")
            ),
        )
    )
    found = F.struct(
        rules.event_ts(x).alias("event_ts"),
        F.col("_host").alias("source_host"),
        rules.category(shape).alias("category"),
        rules.action(shape, j, body, verb).alias("action"),
        rules.outcome(shape, body, verb).alias("outcome"),
        F.col("_user").alias("actor_user"),
        F.col("_src").alias("src_ip"),
        F.col("_target").alias("target"),
        F.col("_dst").alias("dst_ip"),
        F.col("_message").alias("message"),
        rules.confidence(
            shape, F.col("_message"), F.col("_src"), F.col("_dst"), F.col("_user"), F.col("_host")
        ).alias("confidence"),
    )
    temporary = (
        "_record", "_process", "_verb", "_shape", "_body", "_src", "_dst", "_user", "_host", "_target", "_message",
        "sample",
    )
    return evaluate_once(step, {"found": found}, drop=temporary)


def extract_rules(lines: DataFrame, json_actor: bool = False) -> DataFrame:
    """Add ``ai_response`` (the answer as JSON text) and a null ``error``, as a user extractor would."""
    f = F.col("found")
    null = F.lit(None).cast("string")
    answer = F.struct(
        null.alias("event_hash"),
        f["event_ts"].alias("event_ts"),
        null.alias("ts_source"),
        *[f[k].alias(k) for k in ("source_host", "category", "action", "outcome", "actor_user", "src_ip")],
        *[f[k].alias(k) for k in ("target", "dst_ip", "message")],
        F.create_map().cast("map<string,string>").alias("extras"),
        f["confidence"].alias("confidence"),
        F.lit(False).alias("review_flag"),
        F.array().cast("array<string>").alias("validation_issues"),
        null.alias("format_hint"),
    )
    return (
        with_rule_fields(lines, json_actor)
        .withColumn("ai_response", F.to_json(answer, {"ignoreNullFields": "false"}))
        .withColumn("error", null)
        .drop("found")
    )


Extractor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

ANSWER_FIELDS = [T.StructField("ai_response", T.StringType()), T.StructField("error", T.StringType())]


def extract_with(
    lines: DataFrame,
    fn: Callable[[pd.DataFrame], pd.Series],
    system_prompt: str = SYSTEM_PROMPT,
    parallelism: int | None = None,
    once_per_line: bool = True,
) -> DataFrame:
    """Run a user extractor and add ``ai_response`` and ``error``.

    ``fn`` gets a pandas batch with ``raw`` and ``prompt`` and returns one answer text per row, or an exception object
    for a row that failed; its text becomes ``error``.  When ``fn`` raises, the rows of the batch are tried one by one.

    With ``once_per_line`` each distinct line is sent once and the answers are written to the checkpoint folder,
    so neither a lost executor nor a second action calls the extractor again; then they are joined back by hash.
    ``parallelism`` sets the number of concurrent extractor tasks.
    """
    def ask(table: DataFrame) -> DataFrame:
        asked = build_prompt(detect(table), system_prompt).drop("hint")
        if parallelism:
            asked = asked.repartition(parallelism)
        # a prompt repeats the system text: it goes to the worker, but neither into results nor back
        schema = T.StructType([*[f for f in asked.schema.fields if f.name != "prompt"], *ANSWER_FIELDS])
        return asked.mapInPandas(_answering(fn), schema)

    if not once_per_line:
        return ask(lines)
    use_checkpoint_dir(lines.sparkSession)
    # Partial grouping keeps one row per line text in each map task, so a hot line costs one row per task.
    distinct = lines.groupBy("raw").agg(F.count("*").alias("copies"))
    hashed = distinct.withColumn("event_hash", event_hash(F.col("raw")))
    answered = ask(hashed).drop("raw").checkpoint()
    return join_by_hash(lines.withColumn("event_hash", event_hash(F.col("raw"))), answered).drop("event_hash")


def _answering(fn: Callable[[pd.DataFrame], pd.Series]) -> Extractor:
    def ask(asked: pd.DataFrame) -> list:
        answers = list(fn(asked))
        if len(answers) != len(asked):
            raise ValueError(f"extractor returned {len(answers)} answers for {len(asked)} lines")
        return answers

    def ask_one(asked: pd.DataFrame):
        try:
            return ask(asked)[0]
        except Exception as exc:
            return exc

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch[["raw", "prompt"]]
            try:
                answers = ask(asked)
            except Exception:
                answers = [ask_one(asked.iloc[i : i + 1]) for i in range(len(asked))]
            failed = [isinstance(answer, Exception) for answer in answers]
            yield batch.drop(columns="prompt").assign(
                ai_response=[None if bad else answer for answer, bad in zip(answers, failed)],
                error=[str(answer) if bad else None for answer, bad in zip(answers, failed)],
            )

    return run
