"""Parsing and normalisation of raw filing text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted input formats (shape, pattern), flags and lengths.
FILING_DATE_FORMATS = (
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
)
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
TRUE_FLAGS = ("1", "TRUE", "Y", "YES", "X")
CUSIP_LENGTH = 9
CIK_LENGTH = 10


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks; null becomes ''."""
    return F.btrim(F.coalesce(_col(c), F.lit("")), F.lit(WHITE_SPACE))


def stripped_upper(c: Column | str) -> Column:
    return F.upper(strip(c))


def blank_to_null(c: Column | str) -> Column:
    text = strip(c)
    return F.when(text != "", text)


def normalize_cik(c: Column | str) -> Column:
    """Digits only, zero-padded to ten; null when no digit is left."""
    digits = F.regexp_replace(_col(c), "[^0-9]", "")
    return F.when(F.length(digits) >= CIK_LENGTH, digits).when(
        F.length(digits) > 0, F.lpad(digits, CIK_LENGTH, "0")
    )


def normalize_cusip(c: Column | str) -> Column:
    """Upper-case first, then keep the characters a CUSIP may contain."""
    return F.regexp_replace(stripped_upper(c), "[^A-Z0-9*@#]", "")


def is_valid_cusip(c: Column | str) -> Column:
    return F.length(_col(c)) == CUSIP_LENGTH


def normalize_list_cusip(c: Column | str) -> Column:
    """Reference-list identifiers keep letters and digits only."""
    return F.upper(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[^A-Za-z0-9]", ""))


def parse_filing_date(c: Column | str) -> Column:
    """Date in one of the accepted formats; the shape picks the format before parsing."""
    text = strip(c)
    parsed: Column | None = None
    for shape, pattern in FILING_DATE_FORMATS:
        value = F.try_to_date(text, pattern)
        parsed = F.when(text.rlike(shape), value) if parsed is None else parsed.when(text.rlike(shape), value)
    return parsed


def parse_number(c: Column | str, as_type: str) -> Column:
    """Number with optional thousands commas; null when it is not a number."""
    return F.replace(strip(c), F.lit(","), F.lit("")).try_cast(as_type)


def parse_int_via_float(c: Column | str) -> Column:
    """Integer written as a decimal in XML; empty text is 0."""
    text = strip(c)
    return F.when(text == "", F.lit(0).cast("long")).otherwise(
        text.try_cast("double").try_cast("long")
    )


def truthy(c: Column | str) -> Column:
    return stripped_upper(c).isin(*TRUE_FLAGS)


def row_key_order(c: Column | str) -> Column:
    """Sort key of a row id: numeric value (0 when not numeric), then the text."""
    return F.struct(
        F.coalesce(_col(c).try_cast("long"), F.lit(0).cast("long")).alias("n"), _col(c).alias("t")
    )


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
