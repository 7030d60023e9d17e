"""Labels, patterns, word lists, lookup tables and texts that output must match exactly.

Patterns are Java regular expressions.  Character classes are spelled out (``\\p{Nd}``, ``[\\p{L}\\p{N}_]``) because
Java's ``\\d`` and ``\\w`` are ASCII only, and ends are written ``\\z``.
"""

# --- white space removed by a Unicode-aware strip ---------------------------------------------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# --- format labels: (label, detector confidence, guidance text) -------------------------------------------------
FORMAT_CONFIDENCE = {
    "evtx_xml": 1.0,
    "cef": 1.0,
    "syslog_rfc3164": 1.0,
    "json": 1.0,
    "xml": 1.0,
    "csv": 0.85,
    "kv": 0.85,
    "plaintext": 0.6,
    "unknown": 0.0,
}
SYSLOG_PRIORITY_ONLY_CONFIDENCE = 0.9

FORMAT_GUIDANCE = {
    "syslog_rfc3164": "Syslog RFC3164. Header is: <priority>Month Day HH:MM:SS hostname process[pid]: message. "
    "Priority = facility*8 + severity.",
    "cef": "CEF (ArcSight Common Event Format). "
    "Structure: CEF:version|vendor|product|version|signatureId|name|severity|extensions. "
    "Extension fields are space-separated key=value pairs.",
    "json": "JSON log. Fields are key-value pairs inside a JSON object or array. Parse as standard JSON.",
    "xml": "XML log. Fields are enclosed in XML tags. Extract tag names and their text content as fields.",
    "evtx_xml": "Windows Event Log (EVTX) in XML form. "
    "Key fields are under <System> (EventID, TimeCreated, Computer, Channel) "
    "and <EventData> (named Data elements). "
    "EventID 4624=logon, 4625=failed logon, 4648=explicit logon, 4688=process create.",
    "csv": "CSV log. Fields are comma-separated. "
    "First row may be a header. Treat positionally if no header is present.",
    "kv": "Key=Value log. Fields are space-separated key=value pairs. "
    "Common keys: src, dst, spt, dpt, user, action, result, msg.",
    "plaintext": "Unstructured plain-text log. "
    "Extract any identifiable fields: timestamps, IPs, usernames, actions, outcomes.",
    "unknown": "Unknown or unrecognised log format. Attempt best-effort field extraction. Set confidence low.",
}

# --- detector patterns ------------------------------------------------------------------------------------------
EVTX_NAMESPACE = "http://schemas.microsoft.com/win/2004/08/events/event"
EVTX_MARKERS = (
    "Microsoft-Windows-Security-Auditing",
    "Microsoft-Windows-System",
    "Microsoft-Windows-Application",
    "EventID",
    "<System>",
    "<EventData>",
)
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

CEF_START = r"^(?i:CEF):\p{Nd}\|"
SYSLOG_PRIORITY = r"^<\p{Nd}{1,3}>"
SYSLOG_HEADER = (
    r"^(?:<\p{Nd}{1,3}>)?(?:" + "|".join(MONTHS) + rf")[{SPACE_CLASS}]+"
    rf"\p{{Nd}}{{1,2}}[{SPACE_CLASS}]+\p{{Nd}}{{2}}:\p{{Nd}}{{2}}:\p{{Nd}}{{2}}"
)
JSON_START = r"^[\[{]"
XML_DECLARATION = r"^(?i:<\?xml)"
XML_TAG = rf"^<[A-Za-z_][\p{{L}}\p{{N}}_:.\-]*[{SPACE_CLASS}>]"

# One line, first character not one of < { [ C E F, at least three commas after the first character.  The first
# three fields exclude the comma, so the match never backtracks.
CSV_LINE = r"^[^<{\[CEF][^\n,]*,[^\n,]*,[^\n,]*,[^\n]*\z"

# Three adjacent key=value pairs.  A key inside an unbroken token may start at its last word character and a key in
# a new token starts with the token, so no prefix is rescanned and no group is repeated.
_WORD = r"[\p{L}\p{N}_]"
_VALUE = rf"[^{SPACE_CLASS}]+"
_KEY_SAME_TOKEN = rf"{_WORD}[.\-]*="
_KEY_NEXT_TOKEN = rf"[{SPACE_CLASS}]+{_WORD}[\p{{L}}\p{{N}}_.\-]*="
_NEXT_KEY = rf"(?:{_KEY_NEXT_TOKEN}|{_KEY_SAME_TOKEN})"
KV_TRIPLE = rf"{_KEY_SAME_TOKEN}{_VALUE}{_NEXT_KEY}{_VALUE}{_NEXT_KEY}[^{SPACE_CLASS}]"

NOT_PRINTABLE = r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]"

# --- values of the normalized event -----------------------------------------------------------------------------
CATEGORIES = ("authentication", "network", "file", "process", "other")
OUTCOMES = ("success", "failure", "unknown")
CONFIDENCE_GATE = 0.7

IPV4 = r"^(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}\n?\z"
IPV6 = r"^(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}\n?\z"
HOSTNAME = r"^[a-zA-Z][a-zA-Z0-9\-]*\n?\z"

# Text that converts to a float, after stripping (no hexadecimal, no type suffix).
_DIGITS = r"\d+(?:_\d+)*"
FLOAT_TEXT = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"
POSITIVE_INFINITY = r"^(?i:\+?inf(?:inity)?)\z"

TRUE_TEXTS = ("1", "on", "t", "true", "y", "yes")
FALSE_TEXTS = ("0", "off", "f", "false", "n", "no")

# --- texts of issues and fallback messages ----------------------------------------------------------------------
ISSUE_HOST_MOVED = "IP/Hostname Fix: src_ip '%s' was a hostname — moved to source_host, src_ip set to null."
ISSUE_HOST_DROPPED = (
    "IP/Hostname Fix: src_ip '%s' was a hostname — set to null (source_host already populated)."
)
ISSUE_INVALID_IP = "Invalid IP: src_ip '%s' is not a valid IP address — set to null."
ISSUE_HALLUCINATION = (
    "Hallucination Fix: event_ts '%s' not found in raw log — overridden with ingestion time '%s'."
)
ERROR_STRING = "Input should be a valid string"
ERROR_BOOL = "Input should be a valid boolean"
ERROR_BOOL_PARSING = "Input should be a valid boolean, unable to interpret input"
ERROR_TS_SOURCE = "Input should be 'original' or 'ingestion'"
VALIDATION_FAILURE = "[VALIDATION FAILURE] "
PARSE_FAILURE_MESSAGE = "[PARSE FAILURE] "
PARSE_FAILURE_ISSUE = "Parse failure: "
REASON_CALL_FAILED = "Ollama call failed: "
REASON_NOT_JSON = "AI returned non-JSON response: "
NOT_JSON_CHARS = 120

# --- hint and prompt layout -------------------------------------------------------------------------------------
SAMPLE_CHARS = 200
HINT_HEADER = "[PRE-PROCESSOR HINT]"
HINT_FORMAT = "Detected format     : "
HINT_CONFIDENCE = "Detector confidence : "
HINT_SAMPLE = "Raw sample          : "
PROMPT_USER = "\n\nUser: "
PROMPT_INSTRUCTION = "The log line to read is below. Answer with the JSON object described above."

# --- file detection ---------------------------------------------------------------------------------------------
EVTX_HEAD_CHARS = 2000
EMPTY_FILE_SAMPLE = "[empty file]"
UNREADABLE_FILE_SAMPLE = "[error reading file: "

# --- export tables ----------------------------------------------------------------------------------------------
OCSF_VERSION = "1.0.0"
OCSF_CLASS_UID = {"authentication": 4624, "network": 3001, "file": 1001, "process": 4001, "other": 0}
OCSF_SEVERITY = {"authentication": 3, "network": 4, "file": 2, "process": 3, "other": 1}
OCSF_STATUS_ID = {"success": 1, "failure": 2, "unknown": 0}
CEF_SEVERITY = {"authentication": 5, "network": 7, "file": 3, "process": 5, "other": 1}
