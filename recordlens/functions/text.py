"""Text cleaning, identifiers and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as white space when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Lower-cased texts that stand for a missing value.
MISSING_TEXTS = ("", "nan", "none", "null")

# Plain decimal or exponent notation; keeps out suffixes such as "1d" that a cast would accept.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends, in time linear in the text."""
    return F.btrim(c, F.lit(WHITESPACE))


def filled(c: Column) -> Column:
    """NULL becomes empty text, everything else is stripped."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def is_blank(c: Column) -> Column:
    """NULL, empty or only white space; looks no further than the first other character."""
    return F.coalesce(F.ltrim(c, F.lit(WHITESPACE)) == "", F.lit(True))


def present_text(c: Column) -> Column:
    """Stripped text, NULL when it stands for a missing value."""
    s = strip(c)
    # The length test comes first, so long texts are not lower-cased for the comparison.
    named = (F.octet_length(s) <= 4) & F.lower(s).isin(*MISSING_TEXTS)
    return F.when(~named, s)


def is_missing(c: Column) -> Column:
    return present_text(c).isNull()


def clean_text(c: Column) -> Column:
    return F.coalesce(present_text(c), F.lit(""))


def embedding_text(title: Column, tags: Column, body: Column) -> Column:
    """Non-blank cleaned parts joined by one space."""
    return F.concat_ws(" ", present_text(title), present_text(tags), present_text(body))


def normalize_id(raw: Column) -> Column:
    """Strip, and drop a final ``.0`` when the rest of the text is digits."""
    s = strip(raw)
    digits_only = F.replace(s, F.lit(".0"), F.lit("")).rlike("^[0-9]+$")
    shortened = s.substr(F.lit(1), F.length(s) - F.lit(2))
    return F.when(s.endswith(".0") & digits_only, shortened).otherwise(s)


def to_number(c: Column) -> Column:
    """Double value of a number in text form, NULL for anything else."""
    s = strip(c)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def id_to_int(c: Column) -> Column:
    """Integer form of an identifier; fractions truncate, other text gives 0."""
    s = strip(c)
    whole = F.when(s.rlike("^[0-9]+$"), s.try_cast("bigint"))
    return F.coalesce(whole, to_number(s).try_cast("bigint"), F.lit(0).cast("bigint"))


def id_number(c: Column) -> Column:
    """Number of an all-digit identifier, NULL for other text; the first sort key of ids."""
    s = strip(c)
    return F.when(s.rlike("^[0-9]+$"), s.try_cast("bigint"))


def fingerprint(work_item_id: Column, title: Column, body: Column) -> Column:
    """SHA-256 over id, title and body; NULL parts count as empty."""
    parts = [F.coalesce(c, F.lit("")) for c in (work_item_id, title, body)]
    payload = F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2])
    return F.sha2(payload, 256)


def fingerprint_undelimited(work_item_id: Column, title: Column, body: Column) -> Column:
    """The older fingerprint form without separators, needed only by the audit."""
    parts = [F.coalesce(c, F.lit("")) for c in (work_item_id, title, body)]
    return F.sha2(F.concat(*parts), 256)
