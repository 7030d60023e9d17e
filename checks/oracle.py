"""DuckDB statements that compute each registered query on their own, from the same tables."""

from __future__ import annotations

from loglathe.functions import fixed
from loglathe.functions.formats import PRODUCT
from loglathe.operators.extraction import SYSTEM_PROMPT

from .corpus import _OBJECT_LINES_SQL, ANSWERS_SQL, CHUNK_BYTES, EVENT_LINES_SQL, NOW

SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\p{L}\p{N}_]"
BREAKS = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
IP = r"\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(col: str) -> str:
    return f"regexp_replace({col}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def rx(col: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({col}, {q(pattern)}, {group}), '')"


def is_ip(col: str) -> str:
    return (
        rf"(regexp_matches({col}, '^(\p{{Nd}}{{1,3}}\.){{3}}\p{{Nd}}{{1,3}}\n?$') OR "
        rf"regexp_matches({col}, '^([0-9a-fA-F]{{0,4}}:){{2,7}}[0-9a-fA-F]{{0,4}}\n?$'))"
    )


def is_host(col: str) -> str:
    return rf"regexp_matches({col}, '^[a-zA-Z][a-zA-Z0-9\-]*\n?$')"


def case_of(col: str, table: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {col} {whens}{'' if default is None else ' ELSE ' + default} END"


def cte(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts)


# --- lines ------------------------------------------------------------------------------------------------------
def _split(table: str, key: str, text: str) -> str:
    return (
        f"SELECT '{table}' AS source, k * 1000000 + pos AS line_id, raw FROM (SELECT k, unnest(range(len(l))) AS pos, "
        f"unnest(l) AS raw FROM (SELECT {key} AS k, regexp_split_to_array({text}, '{BREAKS}') AS l FROM {table})) "
        f"WHERE {strip('raw')} <> ''"
    )


EVENT_LINES = ("lines", f"SELECT 'events' AS source, line_id, raw FROM ({EVENT_LINES_SQL})")
ALL_LINES = (
    "lines",
    " UNION ALL ".join(
        [
            EVENT_LINES[1],
            _split("documents", "doc_id", "text"),
            _split("pages", "page_id", "html"),
            _split("conversations", "conv_id * 10000 + turn", "text"),
        ]
    ),
)
STRIPPED = ("s", f"SELECT *, {strip('raw')} AS x FROM lines")

# --- detection --------------------------------------------------------------------------------------------------
_MARKERS = " + ".join(f"CAST(contains(x, {q(m)}) AS INT)" for m in fixed.EVTX_MARKERS)
EVTX = f"(contains(x, {q(fixed.EVTX_NAMESPACE)}) OR ({_MARKERS}) >= 2)"
CEF = r"regexp_matches(x, '^(?i:cef):\p{Nd}\|')"
HEADER = (
    r"regexp_matches(x, '^(?:<\p{Nd}{1,3}>)?(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)["
    + SPACE + r"]+\p{Nd}{1,2}[" + SPACE + r"]+\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}')"
)
PRIORITY = r"regexp_matches(x, '^<\p{Nd}{1,3}>')"
JSON = "(x LIKE '{%' OR x LIKE '[%')"
XML = (
    rf"(regexp_matches(x, '^(?i:<\?xml)') OR (regexp_matches(x, '^<[A-Za-z_][\p{{L}}\p{{N}}_:.\-]*[{SPACE}>]') "
    "AND contains(x, '</')) OR suffix(x, '/>'))"
)
CSV = (
    "(x <> '' AND NOT contains(x, chr(10)) AND left(x, 1) NOT IN ('<', '{', '[', 'C', 'E', 'F') "
    "AND len(substr(x, 2)) - len(replace(substr(x, 2), ',', '')) >= 3)"
)
KV = rf"regexp_matches(x, '({WORD}[\p{{L}}\p{{N}}_.\-]*=[^{SPACE}]+[{SPACE}]*){{3}}')"
PLAIN = (
    r"(x <> '' AND NOT regexp_matches(x, '[\p{C}\p{Zl}\p{Zp}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]'))"
)
LABEL = (
    f"CASE WHEN {EVTX} THEN 'evtx_xml' WHEN {CEF} THEN 'cef' WHEN {HEADER} OR {PRIORITY} THEN 'syslog_rfc3164' "
    f"WHEN {JSON} THEN 'json' WHEN {XML} THEN 'xml' WHEN {CSV} THEN 'csv' WHEN {KV} THEN 'kv' "
    f"WHEN {PLAIN} THEN 'plaintext' ELSE 'unknown' END"
)
DETECTED = (
    "d",
    f"SELECT *, CASE WHEN fmt = 'syslog_rfc3164' AND NOT {HEADER} THEN 0.9 ELSE "
    + case_of("fmt", fixed.FORMAT_CONFIDENCE)
    + f" END::DOUBLE AS fmt_conf FROM (SELECT *, {LABEL} AS fmt FROM s)",
)
HINT_TEXT = case_of("fmt", fixed.FORMAT_GUIDANCE)
CONTEXT = (
    f"{q(fixed.HINT_HEADER)} || chr(10) || {q(fixed.HINT_FORMAT)} || {HINT_TEXT} || chr(10) || "
    f"{q(fixed.HINT_CONFIDENCE)} || printf('%.2f', fmt_conf) || chr(10) || {q(fixed.HINT_SAMPLE)} || substr(x, 1, 200)"
)
PROMPT = f"{q(SYSTEM_PROMPT + fixed.PROMPT_USER)} || {CONTEXT} || chr(10) || chr(10) || {q(fixed.PROMPT_INSTRUCTION)} || chr(10) || chr(10) || raw"

# --- rules ------------------------------------------------------------------------------------------------------
_HEAD = r"^(?:<\p{Nd}{1,3}>)?[A-Z][a-z]{2}\s+\p{Nd}{1,2} \S+ \S+ "


def _json(path: str) -> str:
    return f"CASE WHEN fmt = 'json' AND json_valid(x) THEN json_extract_string(x, '{path}') END"


RULES = [
    (
        "r1",
        f"SELECT *, {rx('x', _HEAD + r'([A-Za-z0-9_\-]+)(?:\[\p{Nd}+\])?: ')} AS proc, "
        f"{rx('x', _HEAD + r'[A-Za-z0-9_\-]+(?:\[\p{Nd}+\])?: ((?s).*)$')} AS body, "
        f"{rx('x', r'\[UFW (BLOCK|ALLOW)\]')} AS verb, {_json('$.eventName')} AS j_event, "
        f"{_json('$.sourceIPAddress')} AS j_src, {_json('$.userIdentity.userName')} AS j_user, "
        f"{_json('$.requestParameters.bucketName')} AS j_bucket, {_json('$.requestParameters.key')} AS j_key FROM d",
    ),
    (
        "r2",
        "SELECT *, CASE WHEN fmt = 'cef' THEN 'cef' WHEN fmt = 'json' AND j_event IS NOT NULL THEN 'json' "
        "WHEN fmt <> 'syslog_rfc3164' THEN 'other' WHEN verb IS NOT NULL THEN 'fw' WHEN proc = 'sshd' THEN 'ssh' "
        "WHEN proc = 'sudo' THEN 'sudo' ELSE 'other' END AS shape, "
        f"coalesce({rx('x', rf'\b(?i:src)=({IP})')}, {rx('x', rf' from ({IP})')}, "
        rf"{rx('x', rf' from user \S+ ({IP})')}, j_src) AS src_ip, "
        f"{rx('x', rf'\b(?i:dst)=({IP})')} AS dst_ip, "
        f"coalesce({rx('x', r' for (?:invalid user )?(\S+) from ')}, {rx('x', r' from user (\S+)')}, "
        f"{rx('x', r' sudo: (\S+)')}, {rx('x', r'\bsuser=(\S+)')}) AS actor_user, "
        + rx("x", r"^(?:<\p{Nd}{1,3}>)?[A-Z][a-z]{2}\s+\p{Nd}{1,2} \p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2} (\S+)")
        + " AS host0, "
        "CASE WHEN j_bucket IS NOT NULL AND j_key IS NOT NULL THEN j_bucket || '/' || j_key "
        "ELSE coalesce(j_bucket, j_key) END AS path0, "
        + rx("x", r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}[T ]\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}(?:\.\p{Nd}+)?(?:Z|[+-]\p{Nd}{2}:?\p{Nd}{2})?", 0)
        + " AS ts0 FROM r1",
    ),
    (
        "r3",
        f"SELECT *, CASE WHEN fmt = 'syslog_rfc3164' AND NOT {is_ip('host0')} THEN host0 END AS source_host, "
        f"CASE WHEN shape = 'json' AND NOT {is_ip('path0')} THEN path0 END AS target, replace(ts0, ' ', 'T') AS event_ts, "
        "CASE shape WHEN 'ssh' THEN 'authentication' WHEN 'sudo' THEN 'process' WHEN 'fw' THEN 'network' "
        "WHEN 'cef' THEN 'network' WHEN 'json' THEN 'file' ELSE 'other' END AS category, "
        "CASE shape WHEN 'ssh' THEN CASE WHEN starts_with(body, 'Disconnected') THEN 'disconnect' ELSE 'login' END "
        "WHEN 'sudo' THEN 'sudo' WHEN 'fw' THEN lower(verb) WHEN 'cef' THEN 'detected' WHEN 'json' THEN j_event END AS action, "
        "CASE WHEN shape = 'ssh' AND starts_with(body, 'Accepted') THEN 'success' "
        "WHEN shape = 'ssh' AND starts_with(body, 'Failed') THEN 'failure' WHEN shape IN ('sudo', 'json') THEN 'success' "
        "WHEN shape = 'fw' AND verb = 'BLOCK' THEN 'failure' WHEN shape = 'fw' THEN 'success' ELSE 'unknown' END AS outcome "
        "FROM r2",
    ),
    (
        "r4",
        "SELECT *, CASE shape WHEN 'ssh' THEN body WHEN 'sudo' THEN actor_user || ' executed ' || "
        f"{rx('x', r'COMMAND=(.*)$')} || ' as ' || {rx('x', r'\bUSER=(\S+)')} "
        "WHEN 'fw' THEN CASE verb WHEN 'BLOCK' THEN 'UFW blocked ' ELSE 'UFW allowed ' END || "
        f"{rx('x', r'\bPROTO=(\S+)')} || ' from ' || concat_ws(':', src_ip, {rx('x', r'\bSPT=(\p{Nd}+)')}) || ' to ' || "
        f"concat_ws(':', dst_ip, {rx('x', r'\bDPT=(\p{Nd}+)')}) "
        f"WHEN 'cef' THEN concat_ws(' ', {rx('x', r'^(?:(?:[^|\\]|\\.)*\|){5}((?:[^|\\]|\\.)*)')}, 'detected', "
        "'from ' || src_ip, 'to ' || dst_ip) "
        "WHEN 'json' THEN concat_ws(' ', j_user, 'accessed', target, 'from ' || src_ip) END AS message FROM r3",
    ),
    (
        "rules",
        "SELECT *, CASE WHEN shape = 'ssh' AND src_ip IS NOT NULL AND actor_user IS NOT NULL THEN 1.0 "
        "WHEN shape = 'sudo' AND message IS NOT NULL THEN 1.0 "
        "WHEN shape IN ('fw', 'cef') AND message IS NOT NULL AND src_ip IS NOT NULL AND dst_ip IS NOT NULL THEN 1.0 "
        "WHEN shape = 'json' THEN 0.85 WHEN coalesce(src_ip, dst_ip, actor_user, source_host) IS NOT NULL THEN 0.6 "
        "ELSE 0.3 END::DOUBLE AS confidence FROM r4",
    ),
]
BASE = [EVENT_LINES, STRIPPED, DETECTED]
ALL = [ALL_LINES, STRIPPED, DETECTED]
RULED = [*BASE, *RULES]
ANSWER_JSON = (
    "CAST(json_object('event_hash', NULL, 'event_ts', event_ts, 'ts_source', NULL, 'source_host', source_host, "
    "'category', category, 'action', action, 'outcome', outcome, 'actor_user', actor_user, 'src_ip', src_ip, "
    "'target', target, 'dst_ip', dst_ip, 'message', message, 'extras', json('{}'), 'confidence', confidence, "
    "'review_flag', false, 'validation_issues', json('[]'), 'format_hint', NULL) AS VARCHAR)"
)

# --- answers ----------------------------------------------------------------------------------------------------


def _object(text: str) -> str:
    return f"CASE WHEN json_valid({text}) AND json_type({text}) = 'OBJECT' THEN {text} END"


ANSWERS = [
    ("lines", f"SELECT * FROM ({ANSWERS_SQL})"),
    STRIPPED,
    DETECTED,
    (
        "a0",
        f"SELECT *, {strip('ai_response')} AS t1, "
        rf"{strip('''regexp_replace(ai_response, '```(?:json)?', '', 'g')''')} AS t2, "
        r"regexp_extract(ai_response, '(?s)\{.*\}') AS t3 FROM d",
    ),
    (
        "a1",
        f"SELECT *, CASE WHEN error IS NULL THEN coalesce({_object('t1')}, {_object('t2')}, {_object('t3')}) END AS j FROM a0",
    ),
    (
        "a2",
        f"SELECT *, CASE WHEN error IS NOT NULL THEN {q(fixed.REASON_CALL_FAILED)} || error "
        f"WHEN j IS NULL THEN {q(fixed.REASON_NOT_JSON)} || substr(ai_response, 1, 120) END AS reason FROM a1",
    ),
]
_KEYS = (
    "ts_source", "event_ts", "source_host", "category", "action", "outcome", "actor_user",
    "src_ip", "dst_ip", "target", "message", "extras", "confidence", "review_flag",
)
_DEFAULTS = {
    "ts_source": ("string", "ingestion"), "category": ("string", "other"), "outcome": ("string", "unknown"),
    "extras": ("object", "{}"), "confidence": ("number", "0.0"), "review_flag": ("boolean", "False"),
}
_FALLBACK = {
    **_DEFAULTS, "event_ts": ("string", NOW), "review_flag": ("boolean", "True"),
}


def _kind(key: str) -> str:
    default = _DEFAULTS.get(key, ("null", None))[0]
    fallback = _FALLBACK.get(key, ("null", None))[0] if key != "message" else "string"
    return (
        f"CASE WHEN reason IS NOT NULL THEN '{fallback}' ELSE CASE json_type(j, '$.{key}') WHEN 'VARCHAR' THEN 'string' "
        f"WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' "
        f"ELSE CASE WHEN json_type(j, '$.{key}') IS NULL THEN '{default}' ELSE 'number' END END END AS {key}_k"
    )


def _text(key: str) -> str:
    default = _DEFAULTS.get(key, ("null", None))[1]
    fallback = _FALLBACK.get(key, ("null", None))[1]
    fallback_sql = (
        f"{q(fixed.PARSE_FAILURE_MESSAGE)} || reason" if key == "message" else "NULL" if fallback is None else q(fallback)
    )
    value = f"json_extract_string(j, '$.{key}')"
    return (
        f"CASE WHEN reason IS NOT NULL THEN {fallback_sql} WHEN json_type(j, '$.{key}') IS NULL THEN "
        f"{'NULL' if default is None else q(default)} WHEN json_type(j, '$.{key}') = 'BOOLEAN' "
        f"THEN upper({value}[1]) || {value}[2:] ELSE {value} END AS {key}_t"
    )


ASSEMBLED = [
    *ANSWERS,
    (
        "c",
        "SELECT line_id, raw, x, fmt, reason, j, sha256(raw) AS event_hash, "
        + ", ".join(_kind(k) for k in _KEYS) + ", " + ", ".join(_text(k) for k in _KEYS) + " FROM a2",
    ),
]


def truthy(key: str) -> str:
    return (
        f"CASE {key}_k WHEN 'null' THEN false WHEN 'string' THEN {key}_t <> '' WHEN 'boolean' THEN {key}_t = 'True' "
        f"WHEN 'number' THEN CAST({key}_t AS DOUBLE) <> 0 WHEN 'object' THEN {key}_t <> '{{}}' ELSE {key}_t <> '[]' END"
    )


def date_in_raw(ts: str, raw: str) -> str:
    months = " OR ".join(f"(contains({ts}, '{m}') AND contains({raw}, '{m}'))" for m in fixed.MONTHS)
    return (
        f"({ts} <> '' AND {raw} <> '' AND (coalesce(contains({raw}, {rx(ts, r'\p{Nd}{4}', 0)}), false) OR "
        f"coalesce(contains({raw}, {rx(ts, r'\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}', 0)}), false) OR {months}))"
    )


def fill(pattern: str, *values: str) -> str:
    out = q(pattern)
    for value in values:
        head, tail = out.split("%s", 1)
        out = f"{head}' || {value} || '{tail}"
    return out


_TEXTS = ("source_host", "action", "actor_user", "target", "message")
HEALED = [
    *ASSEMBLED,
    (
        "h1",
        f"SELECT *, {strip('src_ip_t')} AS src_t, {strip('dst_ip_t')} AS dst_t, {strip('confidence_t')} AS conf_t, "
        f"{truthy('source_host')} AS host_set, CASE WHEN fmt = 'syslog_rfc3164' THEN 'missing' WHEN NOT ({truthy('event_ts')}) "
        f"THEN 'missing' WHEN {date_in_raw('event_ts_t', 'raw')} THEN 'verified' ELSE 'invented' END AS time_case FROM c",
    ),
    (
        "h2",
        f"SELECT *, CASE WHEN src_t <> '' AND NOT {is_ip('src_t')} THEN CASE WHEN {is_host('src_t')} THEN 'hostname' "
        "ELSE 'invalid' END END AS problem, "
        "greatest(0.0, least(1.0, coalesce(CASE WHEN confidence_k = 'boolean' THEN CASE confidence_t WHEN 'True' THEN 1.0 ELSE 0.0 END "
        "WHEN confidence_k = 'number' THEN TRY_CAST(confidence_t AS DOUBLE) "
        r"WHEN confidence_k = 'string' AND regexp_matches(conf_t, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') "
        "THEN TRY_CAST(conf_t AS DOUBLE) END, 0.0)))::DOUBLE AS conf FROM h1",
    ),
    (
        "h3",
        "SELECT *, (time_case = 'invented' OR conf < 0.7) AS forced, "
        "CASE WHEN problem = 'hostname' AND NOT host_set THEN 'string' ELSE source_host_k END AS host_k, "
        "CASE WHEN problem = 'hostname' AND NOT host_set THEN src_t ELSE source_host_t END AS host_t, "
        "CASE WHEN review_flag_k = 'boolean' THEN review_flag_t = 'True' WHEN review_flag_k = 'number' AND "
        "TRY_CAST(review_flag_t AS DOUBLE) IN (0, 1) THEN TRY_CAST(review_flag_t AS DOUBLE) = 1 "
        "WHEN review_flag_k = 'string' AND lower(review_flag_t) IN ('1','on','t','true','y','yes') THEN true "
        "WHEN review_flag_k = 'string' AND lower(review_flag_t) IN ('0','off','f','false','n','no') THEN false END AS flag, "
        f"CASE WHEN reason IS NOT NULL THEN [{q(fixed.PARSE_FAILURE_ISSUE)} || reason] ELSE []::VARCHAR[] END || "
        "list_filter([CASE WHEN problem = 'hostname' AND NOT host_set THEN " + fill(fixed.ISSUE_HOST_MOVED, "src_t")
        + " WHEN problem = 'hostname' THEN " + fill(fixed.ISSUE_HOST_DROPPED, "src_t")
        + " WHEN problem = 'invalid' THEN " + fill(fixed.ISSUE_INVALID_IP, "src_t")
        + " END, CASE WHEN time_case = 'invented' THEN " + fill(fixed.ISSUE_HALLUCINATION, "event_ts_t", q(NOW))
        + " END], lambda i: i IS NOT NULL) AS issues FROM h2",
    ),
    (
        "h4",
        "SELECT *, list_filter(["
        "CASE WHEN time_case = 'verified' AND event_ts_k <> 'string' THEN 'event_ts: Input should be a valid string' END, "
        "CASE WHEN host_k NOT IN ('string', 'null') THEN 'source_host: Input should be a valid string' END, "
        + ", ".join(
            f"CASE WHEN {k}_k NOT IN ('string', 'null') THEN '{k}: Input should be a valid string' END"
            for k in ("action", "actor_user", "target", "message")
        )
        + ", CASE WHEN NOT forced AND flag IS NULL THEN CASE WHEN review_flag_k = 'string' OR (review_flag_k = 'number' "
        "AND TRY_CAST(review_flag_t AS DOUBLE) = floor(TRY_CAST(review_flag_t AS DOUBLE))) "
        f"THEN 'review_flag: {fixed.ERROR_BOOL_PARSING}' ELSE 'review_flag: {fixed.ERROR_BOOL}' END END], "
        "lambda i: i IS NOT NULL) AS errors FROM h3",
    ),
    (
        "ev",
        f"SELECT line_id, event_hash, CASE WHEN ok AND time_case = 'verified' THEN event_ts_t ELSE {q(NOW)} END AS event_ts, "
        "CASE WHEN ok AND time_case = 'verified' AND coalesce(ts_source_t, '') <> 'ingestion' THEN 'original' ELSE 'ingestion' END AS ts_source, "
        "CASE WHEN ok AND host_k = 'string' THEN host_t END AS source_host, "
        f"CASE WHEN ok AND category_k = 'string' AND category_t IN {fixed.CATEGORIES} THEN category_t ELSE 'other' END AS category, "
        "CASE WHEN ok AND action_k = 'string' THEN action_t END AS action, "
        f"CASE WHEN ok AND outcome_k = 'string' AND outcome_t IN {fixed.OUTCOMES} THEN outcome_t ELSE 'unknown' END AS outcome, "
        "CASE WHEN ok AND actor_user_k = 'string' THEN actor_user_t END AS actor_user, "
        f"CASE WHEN ok AND problem IS NULL AND {is_ip('src_t')} THEN src_t END AS src_ip, "
        f"CASE WHEN ok AND {is_ip('dst_t')} THEN dst_t END AS dst_ip, "
        "CASE WHEN ok AND target_k = 'string' THEN target_t END AS target, "
        "CASE WHEN NOT ok THEN '[VALIDATION FAILURE] ' || array_to_string(errors, '; ') WHEN message_k = 'string' THEN message_t END AS message, "
        "raw, CASE WHEN ok AND extras_k = 'object' THEN extras_t ELSE '{}' END AS extras, "
        "CASE WHEN ok THEN conf ELSE 0.0 END::DOUBLE AS confidence, "
        "CASE WHEN ok THEN forced OR coalesce(flag, true) ELSE true END AS review_flag, "
        "CASE WHEN ok THEN issues ELSE errors END AS validation_issues, CASE WHEN ok THEN fmt END AS format_hint, "
        "ok, time_case, reason FROM (SELECT *, len(errors) = 0 AS ok FROM h4)",
    ),
]

# Events of the rule extractor: its answers have no type errors, so only the time and the gate matter.
EVENTS = [
    *RULED,
    (
        "ev",
        f"SELECT line_id, sha256(raw) AS event_hash, CASE WHEN verified THEN event_ts ELSE {q(NOW)} END AS event_ts, "
        "CASE WHEN verified THEN 'original' ELSE 'ingestion' END AS ts_source, "
        f"CASE WHEN problem = 'hostname' THEN coalesce(source_host, src_ip) ELSE source_host END AS source_host, category, action, outcome, actor_user, "
        "CASE WHEN problem IS NULL THEN src_ip END AS src_ip, dst_ip, target, message, raw, '{}' AS extras, confidence, "
        "(confidence < 0.7 OR invented) AS review_flag, "
        "list_filter([CASE problem WHEN 'invalid' THEN " + fill(fixed.ISSUE_INVALID_IP, "src_ip")
        + " WHEN 'hostname' THEN CASE WHEN source_host IS NULL THEN " + fill(fixed.ISSUE_HOST_MOVED, "src_ip")
        + " ELSE " + fill(fixed.ISSUE_HOST_DROPPED, "src_ip") + " END END, CASE WHEN invented THEN "
        + fill(fixed.ISSUE_HALLUCINATION, "event_ts", q(NOW)) + " END], lambda i: i IS NOT NULL) AS validation_issues, "
        "fmt AS format_hint FROM (SELECT *, fmt <> 'syslog_rfc3164' AND coalesce(" + date_in_raw("event_ts", "raw")
        + ", false) AS verified, fmt <> 'syslog_rfc3164' AND event_ts IS NOT NULL AND NOT "
        + date_in_raw("event_ts", "raw") + f" AS invented, CASE WHEN src_ip IS NOT NULL AND NOT {is_ip('src_ip')} THEN "
        f"CASE WHEN {is_host('src_ip')} THEN 'hostname' ELSE 'invalid' END END AS problem FROM rules)",
    ),
]
EVENT_LIST = (
    "event_hash, event_ts, ts_source, source_host, category, action, outcome, actor_user, src_ip, dst_ip, target, message, "
    "raw, extras, confidence, review_flag, CAST(to_json(validation_issues) AS VARCHAR) AS validation_issues, format_hint"
)
FIRST = (
    "first",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_flag, event_hash ORDER BY line_id) AS rn FROM ev) WHERE rn = 1",
)
# History: what was written for the lines of event 0 to the middle event.
HISTORY = (
    "hist",
    "SELECT DISTINCT event_hash, review_flag FROM ev WHERE category IN ('network', 'file')",
)

_CLASS = case_of("category", fixed.OCSF_CLASS_UID, "0")
_STATUS = "CASE outcome WHEN 'success' THEN 'Success' WHEN 'failure' THEN 'Failure' ELSE 'Unknown' END"
_OCSF_COLUMNS = (
    f"{_CLASS} AS class_uid, upper(category[1]) || category[2:] AS class_name, {_CLASS} // 1000 AS category_uid, "
    f"{case_of('category', fixed.OCSF_SEVERITY, '1')} AS severity_id, {_STATUS} AS status, "
    f"{case_of('outcome', fixed.OCSF_STATUS_ID, '0')} AS status_id, {_CLASS} * 100 + 1 AS type_uid"
)
_OCSF_JSON = (
    f"CAST(json_object('metadata', json_object('version', '1.0.0', 'product', json_object('name', {q(PRODUCT)})), "
    "'class_uid', class_uid, 'class_name', class_name, 'category_uid', category_uid, 'severity_id', severity_id, "
    "'status', status, 'status_id', status_id, 'time', event_ts, 'ts_source', ts_source, "
    "'actor', json_object('user', CASE WHEN actor_user <> '' THEN json_object('name', actor_user) END), "
    "'src_endpoint', json_object('hostname', source_host, 'ip', src_ip), "
    "'dst_endpoint', json_object('hostname', target, 'ip', dst_ip), 'action', action, 'message', message, "
    "'raw_data', raw, 'enrichments', json_object('event_hash', event_hash, 'confidence', confidence, "
    "'review_flag', review_flag, 'validation_issues', to_json(validation_issues), 'extras', json(extras)), "
    "'type_uid', type_uid) AS VARCHAR)"
)


def escape(col: str) -> str:
    return (
        rf"replace(replace(replace(replace(replace({col}, '\', '\\'), '|', '\|'), '=', '\='), chr(10), '\n'), chr(13), '\r')"
    )


_CEF = (
    f"'CEF:0|{PRODUCT}|1.0|' || upper(category) || '|' || "
    + escape("CASE WHEN action <> '' THEN action WHEN message <> '' THEN message ELSE category END")
    + f" || '|' || {case_of('category', fixed.CEF_SEVERITY, '1')} || '|' || "
    "CASE WHEN src_ip <> '' THEN 'src=' || src_ip || ' ' ELSE '' END || "
    "CASE WHEN dst_ip <> '' THEN 'dst=' || dst_ip || ' ' ELSE '' END || "
    + " || ".join(
        f"CASE WHEN {c} <> '' THEN '{k}=' || {escape(c)} || ' ' ELSE '' END"
        for k, c in (("shost", "source_host"), ("dhost", "target"), ("suser", "actor_user"), ("action", "action"), ("msg", "message"))
    )
    + " || 'outcome=' || upper(outcome[1]) || outcome[2:] || ' confidence=' || printf('%.2f', confidence) "
    "|| ' review_flag=' || CAST(review_flag AS VARCHAR) || ' ts_source=' || ts_source || ' event_hash=' || event_hash "
    "|| ' rt=' || event_ts"
)

_OBJECT_TEXT = [
    ("ol", _OBJECT_LINES_SQL),
    (
        "objects",
        "SELECT object_id, CASE WHEN object_id % 2 = 0 THEN ' {\"Records\": [' || string_agg('{ \"n\" : ' || line_id || "
        "', \"tag\":[\"é\", null] }', ' , ' ORDER BY line_id) || ']}' || chr(10) "
        "ELSE string_agg(raw, chr(13) || chr(10) ORDER BY line_id) END AS text FROM ol GROUP BY object_id",
    ),
]
_OBJECT_SPLIT = (
    "SELECT object_id, unnest(range(len(l))) AS pos, unnest(l) AS raw "
    f"FROM (SELECT object_id, regexp_split_to_array(text, '{BREAKS}') AS l FROM objects"
)
_USERS = "SELECT line_id, raw, CAST(line_id % 1000000000000 AS BIGINT) AS eid FROM lines"


def sql() -> dict[str, str]:
    out: dict[str, str] = {}

    def over(name: str, ctes: list, select: str) -> None:
        out[name] = f"{cte(*ctes)}\n{select}"

    only_lines, stripped = [ALL_LINES], [ALL_LINES, STRIPPED]
    # detection
    over("d1_strip", stripped, "SELECT source, line_id, x AS sample FROM s")
    for key, predicate in (
        ("d2_evtx", EVTX), ("d3_cef", CEF), ("d4_syslog", f"({HEADER} OR {PRIORITY})"), ("d5_json", JSON), ("d6_xml", XML),
        ("d7_csv", CSV), ("d8_kv", KV), ("d9_plaintext", PLAIN),
    ):
        over(key, stripped, f"SELECT source, line_id, {predicate} AS matches FROM s")
    over("d11_detect", ALL, "SELECT source, line_id, fmt AS format, fmt_conf AS confidence, substr(x, 1, 200) AS raw_sample FROM d")
    over("d12_hint", ALL, f"SELECT source, line_id, {HINT_TEXT} AS hint FROM d")
    over("d14_prompt_context", ALL, f"SELECT source, line_id, {CONTEXT} AS context FROM d")
    over("profile_formats", ALL, "SELECT source, fmt AS format_hint, count(*) AS lines FROM d GROUP BY ALL")
    by_user = [EVENT_LINES, ("u", "SELECT l.line_id, l.raw, e.user_id FROM lines l JOIN events e ON l.line_id % 1000000000000 = e.event_id"),
               ("f", f"SELECT user_id, raw, {strip('raw')} AS x FROM (SELECT user_id, arg_min(raw, line_id) AS raw FROM u GROUP BY user_id)")]
    over("d15_detect_files", [*by_user, ("d", DETECTED[1].replace("FROM s)", "FROM f)"))],
         f"SELECT user_id, fmt AS format, fmt_conf AS confidence, {HINT_TEXT} AS hint, substr(x, 1, 200) AS raw_sample FROM d")
    over("profile_files", [*by_user, ("d", DETECTED[1].replace("FROM s)", "FROM f)"))],
         "SELECT fmt AS format, count(*) AS files FROM d GROUP BY fmt")
    # extraction
    over("x0_prompt", BASE, f"SELECT line_id, sha256({PROMPT}) AS prompt_hash, len({PROMPT}) AS prompt_chars FROM d")
    over("x1_extract_with", BASE, "SELECT line_id, CASE WHEN contains(raw, chr(9)) THEN NULL ELSE "
         "'{\"confidence\":0.9,\"message\":\"' || len(raw) || '\"}' END AS ai_response, "
         "CASE WHEN contains(raw, chr(9)) THEN 'line has a tab' END AS error FROM d")
    for key, column in (("x2_src_ip", "src_ip"), ("x3_dst_ip", "dst_ip"), ("x4_actor_user", "actor_user"), ("x5_source_host", "source_host"),
                        ("x6_action", "action"), ("x7_target", "target"), ("x8_class", "category, outcome"), ("x9_message", "message"),
                        ("x10_event_ts", "event_ts")):
        over(key, RULED, f"SELECT line_id, {column} FROM rules")
    over("x11_extract_rules", RULED, f"SELECT line_id, {ANSWER_JSON} AS ai_response FROM rules")
    # answers
    over("r1_extract_json", ANSWERS, "SELECT line_id, j IS NOT NULL AS found, json_extract_string(j, '$.src_ip') AS src_ip, "
         "json_extract_string(j, '$.confidence') AS confidence, CAST(json_extract(j, '$.extras') AS VARCHAR) AS extras FROM a2")
    over("r2_assemble", ASSEMBLED, "SELECT line_id, " + ", ".join(f"{k}_k, {k}_t" for k in _KEYS) + " FROM c")
    over("r3_event_hash", only_lines, "SELECT source, line_id, sha256(raw) AS event_hash FROM lines")
    over("r4_fallback", HEALED, "SELECT line_id, message, CAST(to_json(validation_issues) AS VARCHAR) AS validation_issues, confidence, "
         "review_flag, event_ts, format_hint FROM ev WHERE reason IS NOT NULL")
    # healing
    for key, columns in (
        ("h1_syslog_ts", "format_hint, event_ts, ts_source"), ("h5_ts_source", "ts_source"),
        ("h11_enums", "category, outcome"), ("h12_confidence", "confidence"), ("h13_ip_fields", "src_ip, dst_ip"), ("h14_extras", "extras"),
    ):
        over(key, HEALED, f"SELECT line_id, {columns} FROM ev")
    over("h2_src_ip_fix", HEALED, "SELECT line_id, problem, CASE WHEN host_k = 'string' THEN host_t END AS source_host, CAST(to_json(issues) AS VARCHAR) AS issues FROM h4")
    over("h3_date_in_raw", [("lines", f"SELECT * FROM ({ANSWERS_SQL})"),
         ("t", "SELECT line_id, raw, regexp_extract(ai_response, '\"event_ts\":\"?([^\",]*)', 1) AS ts FROM lines")],
         f"SELECT line_id, coalesce({date_in_raw('ts', 'raw')}, false) AS found FROM t")
    over("h4_hallucination", HEALED, "SELECT line_id, time_case = 'invented' AS invented, forced FROM h4")
    over("h7_gate", HEALED, "SELECT line_id, conf AS confidence, conf < 0.7 AS below FROM h4")
    texts = ("t", "SELECT line_id, src_ip_t AS v FROM c WHERE src_ip_t IS NOT NULL UNION ALL SELECT line_id, dst_ip_t FROM c "
             "WHERE dst_ip_t IS NOT NULL UNION ALL SELECT line_id, source_host_t FROM c WHERE source_host_t IS NOT NULL")
    over("h9_is_ip", [*ASSEMBLED, texts], f"SELECT line_id, v, {is_ip('v')} AS is_ip FROM t")
    over("h10_is_hostname", [*ASSEMBLED, texts], f"SELECT line_id, v, {is_host('v')} AS is_hostname FROM t")
    over("h15_quarantine", HEALED, "SELECT line_id, message, CAST(to_json(validation_issues) AS VARCHAR) AS validation_issues, "
         "confidence, review_flag, format_hint FROM ev WHERE NOT ok")
    over("h18_safe_parse", HEALED, f"SELECT line_id, {EVENT_LIST} FROM ev")
    # formats
    over("f1_ocsf", HEALED, f"SELECT line_id, {_OCSF_COLUMNS}, event_ts AS time, actor_user AS actor, source_host AS src_host, src_ip, target AS dst_host, dst_ip, event_hash FROM ev")
    over("f2_ocsf_json", [*EVENTS, ("o", f"SELECT *, {_OCSF_COLUMNS} FROM ev")], f"SELECT line_id, {_OCSF_JSON} AS value FROM o")
    over("f3_cef_escape", only_lines, f"SELECT source, line_id, {escape('raw')} AS escaped FROM lines")
    over("f4_cef", HEALED, f"SELECT line_id, {_CEF} AS value FROM ev")
    out["f5_fixed2"] = (
        "SELECT l_orderkey, l_linenumber, printf('%.2f', l_discount) AS discount, "
        "printf('%.2f', l_extendedprice / (l_extendedprice + 1000.0)) AS share, "
        "printf('%.2f', (l_orderkey % 200) / 200.0::DOUBLE) AS half FROM lineitem"
    )
    # routing
    over("w1_route", EVENTS, "SELECT line_id, CASE WHEN review_flag THEN 'review' ELSE 'confident' END AS sink FROM ev")
    over("w2_dedup", [*EVENTS, FIRST], "SELECT line_id, event_hash, review_flag FROM first")
    over("w3_dedup_history", [*EVENTS, FIRST, HISTORY], "SELECT line_id, event_hash, review_flag FROM first f WHERE NOT EXISTS "
         "(SELECT 1 FROM hist h WHERE h.event_hash = f.event_hash AND h.review_flag = f.review_flag)")
    jsonl = (
        "CAST(json_object('event_hash', event_hash, 'event_ts', event_ts, 'ts_source', ts_source, 'source_host', source_host, "
        "'category', category, 'action', action, 'outcome', outcome, 'actor_user', actor_user, 'src_ip', src_ip, 'dst_ip', dst_ip, "
        "'target', target, 'message', message, 'raw', raw, 'extras', json(extras), 'confidence', confidence, 'review_flag', review_flag, "
        "'validation_issues', to_json(validation_issues), 'format_hint', format_hint) AS VARCHAR)"
    )
    over("w6_json_lines", [*EVENTS, FIRST], f"SELECT CASE WHEN review_flag THEN 'review' ELSE 'confident' END AS sink, {jsonl} AS value FROM first")
    over("w7_cef_text", [*EVENTS, FIRST], f"SELECT {_CEF} AS value FROM first WHERE NOT review_flag")
    over("w8_stream", [*EVENTS, FIRST], "SELECT CASE WHEN review_flag THEN 'review' ELSE 'confident' END AS sink, event_hash, message, format_hint FROM first")
    for key in ("w8_restart", "w8_within", "w8_after_batch", "w6_lost_run"):
        out[key] = out["w8_stream"]
    over("w5_ocsf_dedup", [*EVENTS, FIRST], "SELECT event_hash FROM first WHERE NOT review_flag")
    over("w2_retry", BASE, "SELECT DISTINCT 'confident' AS sink, sha256(raw) AS event_hash, CAST(len(raw) AS VARCHAR) AS message, fmt AS format_hint FROM d "
         "UNION ALL SELECT DISTINCT 'review', sha256(raw), '[PARSE FAILURE] Ollama call failed: line has a tab', fmt FROM d WHERE contains(raw, chr(9))")
    over("w3_index", EVENTS, "SELECT DISTINCT event_hash, CASE WHEN review_flag THEN 'review' ELSE 'confident' END AS sink FROM ev WHERE line_id % 6 <> 5")
    over("m1_observed", [*EVENTS, FIRST], "SELECT format_hint, CASE WHEN review_flag THEN 'REVIEW' ELSE 'CONFIDENT' END AS status, "
         "count(*) AS events, round(avg(confidence), 6) AS avg_confidence, count(src_ip) AS with_src_ip FROM first GROUP BY ALL")
    over("m1_status_counts", EVENTS, "SELECT format_hint, CASE WHEN review_flag THEN 'REVIEW' ELSE 'CONFIDENT' END AS status, "
         "count(*) AS events, round(avg(confidence), 6) AS avg_confidence, count(src_ip) AS with_src_ip FROM ev GROUP BY ALL")
    over("m2_source_counts", only_lines, "SELECT source, count(*) AS lines FROM lines GROUP BY source")
    over("p1_parse", EVENTS, f"SELECT line_id, {EVENT_LIST} FROM ev")
    over("p2_parse_batch", EVENTS, f"SELECT line_id, {EVENT_LIST} FROM ev")
    # sources
    for key in ("s1_read_lines", "s2_growing", "s12_tolerant_read"):
        over(key, only_lines, "SELECT raw FROM lines")
    over("s2_start_latest", only_lines, "SELECT raw FROM lines WHERE source <> 'events'")
    over("s12_retry", only_lines, "SELECT raw FROM lines WHERE source IN ('events', 'conversations') UNION ALL SELECT 'late'")
    over("s13_encoded_lines", only_lines, "SELECT source, line_id, raw FROM lines")
    over("s5_mixed_records", _OBJECT_TEXT, "SELECT object_id, row_number() OVER (PARTITION BY object_id ORDER BY line_id) - 1 AS pos, "
         "CASE WHEN line_id % 7 = 0 THEN 'null' ELSE CAST(to_json(raw) AS VARCHAR) END AS raw FROM ol")
    over("s5_split_envelopes", [EVENT_LINES], "SELECT line_id % 5 AS part, '{\"n\":' || line_id || ',\"tag\":[\"é\",null]}' AS raw FROM lines")
    out["d16_xml_files"] = (
        "SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'evtx_xml' ELSE 'xml' END AS format, CAST(1 AS DOUBLE) AS confidence FROM events "
        "UNION ALL SELECT -1, 'evtx_xml', 1.0"
    )
    over("s3_read_objects", by_user[:2], "SELECT user_id, string_agg(raw, chr(10) ORDER BY line_id) || chr(10) AS text FROM u GROUP BY user_id")
    over("s5_unwrap_records", _OBJECT_TEXT, "SELECT object_id, row_number() OVER (PARTITION BY object_id ORDER BY line_id) - 1 AS pos, "
         "'{\"n\":' || line_id || ',\"tag\":[\"é\",null]}' AS raw FROM ol WHERE object_id % 2 = 0")
    over("s6_split_text", only_lines, "SELECT source, line_id, raw FROM lines WHERE source <> 'events'")
    over("load_objects", _OBJECT_TEXT, "SELECT object_id, CASE WHEN object_id % 2 = 0 THEN '{\"n\":' || line_id || ',\"tag\":[\"é\",null]}' "
         "ELSE raw END AS raw FROM ol")
    out["s7_new_keys"] = (
        "SELECT DISTINCT 'logs/' || user_id || '/' || substr(CAST(ts AS VARCHAR), 1, 10) AS file_path FROM events e WHERE NOT EXISTS "
        "(SELECT 1 FROM events p WHERE p.event_type = 'error' AND p.user_id = e.user_id AND "
        "substr(CAST(p.ts AS VARCHAR), 1, 10) = substr(CAST(e.ts AS VARCHAR), 1, 10))"
    )
    out["s9_frame_datagrams"] = (
        "SELECT doc_id AS msg_id, regexp_replace(text, '\\n+$', '') AS raw FROM documents WHERE regexp_replace(text, '\\n+$', '') <> ''"
    )
    conns = [
        ("ol", _OBJECT_LINES_SQL),
        ("o", "SELECT CASE WHEN object_id % 3 = 0 THEN 0 ELSE object_id % 50 + 1 END AS conn_id, object_id, "
              "string_agg(raw, chr(10) ORDER BY line_id) AS text FROM ol GROUP BY ALL"),
        ("w", "SELECT conn_id, string_agg(text, '' ORDER BY object_id) AS text FROM o GROUP BY conn_id UNION ALL "
              "SELECT doc_id + 1000, text FROM documents"),
        ("l", "SELECT conn_id, unnest(string_split(text, chr(10))) AS raw FROM w"),
    ]
    over("s10_frame_chunks", conns, f"SELECT conn_id, {strip('raw')} AS raw FROM l WHERE {strip('raw')} <> ''")
    out["s10_chunk_stream"] = out["s10_open_connections"] = out["s10_frame_chunks"]
    over("s11_union_sources", only_lines, "SELECT CASE WHEN source = 'events' THEN 'FileConnector' ELSE source END AS source, raw FROM lines")
    out["s13_decode"] = (
        "SELECT doc_id, 'utf16' AS kind, text FROM documents UNION ALL SELECT doc_id, 'broken', text || chr(65533) FROM documents "
        "UNION ALL SELECT doc_id, 'latin', regexp_replace(text, '[^\\x{00}-\\x{ff}]', '', 'g') FROM documents"
    )
    return out
