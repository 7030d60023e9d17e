"""Extractor answers: text to a JSON object, and typed access to its keys.

Healing needs the JSON kind of a value (null, string, boolean, number, object, array) next to its text, because the
text of ``1`` and ``"1"`` is the same.  A table of answers holds both in a struct ``kind, text`` per key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .text import strip

CELL_KEYS = (
    "ts_source",
    "event_ts",
    "source_host",
    "category",
    "action",
    "outcome",
    "actor_user",
    "src_ip",
    "dst_ip",
    "target",
    "message",
    "extras",
    "confidence",
    "review_flag",
)

# Value of a key that is missing from the answer; a key holding JSON null keeps its null.
MISSING_DEFAULTS = {
    "ts_source": ("string", "ingestion"),
    "category": ("string", "other"),
    "outcome": ("string", "unknown"),
    "extras": ("object", "{}"),
    "confidence": ("number", "0.0"),
    "review_flag": ("boolean", "False"),
}


def is_one_value(text: Column) -> Column:
    """Whether the text is a single JSON value.

    The parser stops after the first value and ignores what follows.  Putting the text into an array shows whether
    it is one value: a text that closes the array early gives the same length in both forms, a single value 1 and 2.
    """
    return (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1) & (
        F.json_array_length(F.concat(F.lit("["), text, F.lit(",0]"))) == 2
    )


def _strict_object(text: Column) -> Column:
    """The text as a JSON object, or null."""
    return F.when(text.startswith("{") & is_one_value(text), F.try_parse_json(text))


def extract_json(text: Column) -> Column:
    """Answer text to a VARIANT object: the text itself, without code fences, or from first ``{`` to last ``}``."""
    bare = F.regexp_replace(text, "```(?:json)?", "")
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(_strict_object(strip(text)), _strict_object(strip(bare)), _strict_object(braces))


@dataclass(frozen=True)
class Cell:
    """One answer value.  ``kind`` is None for a value that is text or null by construction."""

    text: Column
    kind: Column | None = None

    @classmethod
    def of(cls, struct: Column) -> Cell:
        return cls(struct["text"], struct["kind"])

    def is_kind(self, *kinds: str) -> Column:
        if self.kind is not None:
            return self.kind.isin(*kinds)
        parts = {"string": self.text.isNotNull(), "null": self.text.isNull()}
        found = F.lit(False)
        for kind in kinds:
            found = found | parts.get(kind, F.lit(False))
        return found


def make_cell(kind, text) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    text = text if isinstance(text, Column) else F.lit(text)
    return F.struct(kind.alias("kind"), text.cast("string").alias("text"))


def value(answer: Column, key: str) -> Column:
    """Value of one key; null when the key is missing, a VARIANT null when it holds JSON null."""
    return F.try_variant_get(answer, f"$.{key}", "variant")


def cell(value: Column, schema: Column, key: str) -> Column:
    """Kind and text of the value of ``key`` with the given schema text; a missing key has its default."""
    default_kind, default_text = MISSING_DEFAULTS.get(key, ("null", None))
    kind = (
        F.when(schema.isNull(), default_kind)
        .when(schema == "STRING", "string")
        .when(schema == "VOID", "null")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .otherwise("number")
    )
    text = F.try_variant_get(value, "$", "string")
    text = F.when(schema.isNull(), F.lit(default_text)).when(schema == "BOOLEAN", F.initcap(text)).otherwise(text)
    return make_cell(kind, text)


def extras(value: Column, schema: Column) -> Column:
    """The ``extras`` object as VARIANT; anything that is not an object becomes ``{}``."""
    return F.when(schema.startswith("OBJECT"), value).otherwise(F.parse_json(F.lit("{}")))
