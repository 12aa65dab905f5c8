"""Text governance expressions: screening, redaction, digests, identifiers.

Patterns use (?U) so that letters and digits of every script count as such, and (?d) where
a dot must stop at line feeds only.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.convert import full_match, strip

# Screening rules, tried in this order.
GUARD_RULES: tuple[tuple[str, str], ...] = (
    ("credential_request", r"\b(token|api[ _-]?key|password|secret|credential)\b"),
    ("private_source_request", r"\bsource\s*\.\s*\w+\b"),
    ("file_or_url_request", r"\b(read|scan|open|fetch|download)\b.*\b(file|csv|parquet|json|https?://)"),
    ("instruction_injection", r"\b(ignore|bypass|override)\b.*\b(policy|instructions|guard|rules)\b"),
    ("raw_pii_request", r"\b(card number|cvv|pin|home address|precise location)\b"),
)

# Personal data patterns and marks.
EMAIL = r"\b[^\s@]+@[^\s@]+\.[^\s@]+\b"
LONG_NUMBER = r"\b\d[\d -]{7,}\d\b"
EMAIL_MARK, NUMBER_MARK, SCALAR_MARK = "[redacted email]", "[redacted number]", "[redacted]"
MAX_FACT_LENGTH = 160
SIGNED_TOKEN = r"eyJ[A-Za-z0-9_.-]+"
SECRET_KEY = r"^sk-[A-Za-z0-9_-]{16,400}$"
SECRET_KEY_IN_TEXT = r"(?<![A-Za-z0-9_-])sk-[A-Za-z0-9_-]{16,400}(?![A-Za-z0-9_-])"

# Filter names that may not be remembered.
FORBIDDEN_FILTERS = ("rows", "row", "sql", "raw_sql", "prompt", "question", "answer", "content", "narrative")

# Telemetry fields by treatment.
HASHED_FIELDS = ("sql", "prompt", "question", "answer", "conversation_id", "request_id")
PASSED_FIELDS = (
    "route", "reason_code", "semantic_version", "graph_version", "node", "provider", "model",
    "latency_ms", "execution_count", "repair_count", "token_count", "cost_micros",
)

_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


# Each rule needs a word of every group; looking for them first spares most texts the pattern.
_GUARD_WORDS: dict[str, tuple[tuple[str, ...], ...]] = {
    "credential_request": (("token", "api", "password", "secret", "credential"),),
    "private_source_request": (("source",),),
    "file_or_url_request": (("file", "csv", "parquet", "json", "http"), ("read", "scan", "open", "fetch", "download")),
    "instruction_injection": (("ignore", "bypass", "override"), ("policy", "instructions", "guard", "rules")),
    "raw_pii_request": (("card number", "cvv", "pin", "home address", "precise location"),),
}


def request_text(text: Column) -> Column:
    """The form of a request that screening looks at."""
    return F.coalesce(F.lower(strip(text)), F.lit(""))


def verdict(request: Column) -> Column:
    """``struct<route, reason_code>`` of a ``request_text``: the first rule that matches decides."""

    def outcome(route: str, reason: str) -> Column:
        return F.struct(F.lit(route).alias("route"), F.lit(reason).alias("reason_code"))

    decided = F.when(request == "", outcome("clarify", "blank_question"))
    for reason, pattern in GUARD_RULES:
        mentioned = reduce(lambda a, b: a & b, [
            reduce(lambda a, b: a | b, [request.contains(word) for word in words]) for words in _GUARD_WORDS[reason]])
        decided = decided.when(mentioned & request.rlike("(?Ud)" + pattern), outcome("abstain", reason))
    return decided.otherwise(outcome("allow", "allowed"))


def screen(requests: DataFrame, text: str) -> DataFrame:
    """Add ``route`` and ``reason_code``: clarify when blank, abstain on the first rule that matches, else allow.

    The request text is prepared in a step of its own, so it is computed once per row.
    """
    prepared = requests.withColumn("_request", request_text(F.col(text)))
    return prepared.withColumn("_verdict", verdict(F.col("_request"))).select(
        *requests.columns, "_verdict.route", "_verdict.reason_code")


# Finds exactly what EMAIL finds, but starts once per word instead of at every word border, so a
# very long word (encoded data, for instance) costs one pass and not one per border.
_EMAIL_SCAN = (
    r"(?U)(?:(?<![^\s@])([^\w\s@]*+)(?=\w)|\G(?<!^)(?=[^\s@]))[^\s@]++@[^\s@]+\.[^\s@]+\b"
)


def redact_emails(text: Column) -> Column:
    # the containment test spares the pattern on most rows
    return F.when(text.contains("@"), F.regexp_replace(text, _EMAIL_SCAN, "$1" + EMAIL_MARK)).otherwise(text)


def redact_turn(text: Column) -> Column:
    """E-mail addresses first, then long digit runs; the rest of the text is kept whole."""
    return F.regexp_replace(redact_emails(text), "(?U)" + LONG_NUMBER, NUMBER_MARK)


def redact_scalar(text: Column) -> Column:
    """The whole value is replaced when it is long or holds personal data, else trimmed."""
    sensitive = (F.length(text) > MAX_FACT_LENGTH) | text.rlike("(?U)" + EMAIL) | text.rlike("(?U)" + LONG_NUMBER)
    return F.when(sensitive, F.lit(SCALAR_MARK)).otherwise(strip(text))


def sanitise_filters(filters: Column) -> Column:
    """Drop forbidden names (any case), redact the remaining values."""
    allowed = F.map_filter(filters, lambda key, _: ~F.lower(key).isin(*FORBIDDEN_FILTERS))
    return F.transform_values(allowed, lambda _, value: redact_scalar(value))


def is_digest(text: Column) -> Column:
    return full_match(text, "[a-f0-9]{64}")


def redact_secrets(text: Column, known_token: str | None = None) -> Column:
    if known_token:
        text = F.replace(text, F.lit(known_token), F.lit(SCALAR_MARK))
    return F.when(text.contains("eyJ"), F.regexp_replace(text, SIGNED_TOKEN, SCALAR_MARK)).otherwise(text)


def is_secret_key(text: Column) -> Column:
    return strip(text).rlike(SECRET_KEY)


def secret_keys(text: Column) -> Column:
    """All key-shaped strings inside a text."""
    return F.regexp_extract_all(text, F.lit(SECRET_KEY_IN_TEXT), F.lit(0))


def telemetry_columns(types: Mapping[str, str]) -> list[Column]:
    """The columns that may leave the service: hashes, a row count and harmless fields; nothing else."""
    kept = []
    for name in types:
        if name in HASHED_FIELDS:
            value = F.coalesce(F.col(name).cast("string"), F.lit("None"))
            kept.append(F.sha2(value, 256).alias(f"{name}_hash"))
        elif name == "rows":
            kept.append(F.size(name).cast("long").alias("row_count"))
        elif name in PASSED_FIELDS and types[name] in ("string", "int", "bigint", "float", "double", "boolean"):
            kept.append(F.col(name))
    return kept


def point_id(doc_id: Column) -> Column:
    """Name-based UUID (version 5, URL namespace) of a document id."""
    name = F.concat(F.unhex(F.lit(_URL_NAMESPACE)), F.encode(doc_id.cast("string"), "UTF-8"))
    digest = F.sha1(name)
    variant = F.substr(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


# Wider redaction for complaint narratives, applied in this order after e-mail addresses.
COMPLAINT_MARKS: tuple[tuple[str, str], ...] = (
    (r"\b\d{3}-\d{2}-\d{4}\b", "[redacted ssn]"),
    (r"\b(?:\d[ -]?){13,16}\b", "[redacted card]"),
    (r"\b(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}\b", "[redacted phone]"),
    (LONG_NUMBER, "[redacted account]"),
)


def redact_complaint(text: Column) -> Column:
    text = redact_emails(text)
    for pattern, mark in COMPLAINT_MARKS:
        text = F.regexp_replace(text, "(?U)" + pattern, mark)
    return text
