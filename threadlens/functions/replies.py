"""Reading the free-form JSON a model sends back.

Replies are held as VARIANT, which keeps apart what the rules below need apart:
an absent key (SQL NULL) from an explicit null, and the number -1000 from the
text "-1000".
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NO_ISSUE = -1000
GENERALISED_LEVELS = ("Low", "None")
DEFAULT_RELEVANCE = "None"

_FENCE = r"(?s)```(?:json)?(.*)"


def reply_object(text: Column) -> Column:
    """The JSON object in a reply, bare or in a Markdown fence; else null."""
    fenced = F.btrim(F.regexp_extract(text, _FENCE, 1), F.lit(" \n\r\t`"))
    parsed = F.coalesce(
        F.try_parse_json(text),
        F.when(F.contains(text, F.lit("```")), F.try_parse_json(fenced)),
    )
    return F.when(kind(parsed).startswith("OBJECT"), parsed)


def key(reply: Column, name: str) -> Column:
    """Value of a key as a variant; SQL NULL only where the key is absent."""
    return F.variant_get(reply, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def as_text(value: Column) -> Column:
    """Text as it is, lists and objects as JSON, null as null."""
    return F.try_variant_get(value, "$", "string")


def as_number(value: Column) -> Column:
    """Numbers and booleans as a double; null for everything else."""
    return F.when(kind(value) != "STRING", F.try_variant_get(value, "$", "double"))


def text_or(value: Column, default: str) -> Column:
    """The default only where the key is absent: an explicit null stays null."""
    return F.when(value.isNull(), F.lit(default)).otherwise(as_text(value))


def truthy(value: Column) -> Column:
    """Python's idea of truth for a JSON value; an absent key is false."""
    empty = F.to_json(value).isin("null", '""', "[]", "{}")
    zero = F.coalesce(as_number(value) == 0, F.lit(False))
    return value.isNotNull() & ~empty & ~zero


def _missing(value: Column) -> Column:
    absent = value.isNull() | (kind(value) == "VOID")
    # JSON true counts as 1, never as the marker, so no test for booleans.
    return absent | F.coalesce(as_number(value) == NO_ISSUE, F.lit(False))


def valid_issue(reply: Column) -> Column:
    """Complaint and diagnosis both given and neither the no-issue number."""
    return ~(_missing(key(reply, "user_complaint")) | _missing(key(reply, "diagnosis")))


def relevance(reply: Column) -> Column:
    return text_or(key(reply, "cybersecurity_relevance"), DEFAULT_RELEVANCE)


def low_relevance(level: Column) -> Column:
    """Levels whose complaint is generalised; odd spellings and null are not."""
    return F.coalesce(level.isin(*GENERALISED_LEVELS), F.lit(False))
