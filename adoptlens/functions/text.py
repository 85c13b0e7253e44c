"""Text expressions: words, tokens, hashes, masks and marker counts.

Offsets count Unicode code points, which is what ``length`` and ``substring`` do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col

# Whitespace (Unicode plus the four separators below the blank), its
# opposite, and the characters of a word token. Both need the (?U) flag; an explicit
# list of code points would match about ten times slower.
SPACE = r"[\s\x1c-\x1f]"
NONSPACE = r"[\S&&[^\x1c-\x1f]]"
TOKEN = r"[\p{L}\p{N}_]+"

# Triage markers, matched without regard to case, with Unicode classes.
MARKERS = {
    "email": r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "phone_like": r"(?<!\d)(?:\+?1[-.\s]?)?(?:\(\d{3}\)|\d{3})[-.\s]\d{3}[-.\s]\d{4}(?!\d)",
    "ssn_like": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "bank_details_language": r"\b(?:routing number|bank account|account number|wire transfer instructions)\b",
    "signature_marker": r"/s/|\bin witness whereof\b",
    "confidential_treatment": r"\b(?:confidential treatment|redacted|filed separately with the securities)\b",
    "redaction_or_blank": r"\*{3,}|_{3,}|\[\s*\*[^\]]{0,30}\]",
    "rights_notice": r"\bcopyright\b|\ball rights reserved\b|\x{a9}",
    "redistribution_language": r"\binternal use only\b|\bno part.{0,60}\b(?:reproduc|distribut)",
}
CONTACT_MARKERS = ("email", "phone_like", "ssn_like")
PREVIEW_MARKERS = (
    "confidential_treatment",
    "redaction_or_blank",
    "rights_notice",
    "redistribution_language",
)
PREVIEW_BEFORE, PREVIEW_AFTER, PREVIEW_HITS = 80, 140, 3


def fold(text: Column | str) -> Column:
    """Lower case with sharp s written out, close to full case folding."""
    return F.replace(F.lower(col(text)), F.lit("ß"), F.lit("ss"))


def tokens(text: Column | str) -> Column:
    """Word tokens in order, duplicates kept."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def collapse(text: Column | str) -> Column:
    """Runs of whitespace become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(col(text), f"(?U){SPACE}+", " "))


def normalized(text: Column | str) -> Column:
    return fold(collapse(text))


def normalized_hash(text: Column | str) -> Column:
    """SHA-256 of the text without case and whitespace differences."""
    return F.sha2(normalized(text), 256)


def canonical_hash(record: Column | str) -> Column:
    """SHA-256 of the compact JSON of a struct whose fields the caller sorted by name."""
    return F.sha2(F.to_json(col(record), {"ignoreNullFields": "false"}), 256)


def sorted_struct(*names: str) -> Column:
    return F.struct(*sorted(names))


def mask_contacts(text: Column | str) -> Column:
    """E-mail, phone-like and SSN-like strings become tags, in this order."""
    out = col(text)
    for name in CONTACT_MARKERS:
        out = F.regexp_replace(out, f"(?iU){MARKERS[name]}", f"[{name.upper()}]")
    return out


def marker_count(text: Column | str, name: str) -> Column:
    return F.regexp_count(col(text), F.lit(f"(?iU){MARKERS[name]}"))


def mask_characters(segment: Column) -> Column:
    """Every character but whitespace becomes X; the length stays."""
    return F.regexp_replace(segment, f"(?U){NONSPACE}", "X")


def edit_ratio(original: Column | str, edited: Column | str) -> Column:
    """Levenshtein distance over the longer length: 0 = equal, 1 = all changed.

    Two empty texts are equal. This is a character distance; a matching-block
    similarity would give slightly different values.
    """
    a, b = F.coalesce(col(original), F.lit("")), F.coalesce(col(edited), F.lit(""))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(
        F.levenshtein(a, b).cast("double") / longest
    )
