"""Security keys, stable ids and amendment predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip, stripped_upper

# Form names, option sides, amendment words.
ORIGINAL_FORM = "13F-HR"
AMENDED_FORM = "13F-HR/A"
HOLDINGS_FORMS = (ORIGINAL_FORM, AMENDED_FORM)
OPTION_SIDES = ("PUT", "CALL")
ADDITIVE_WORDS = "NEW HOLDING|ADD"
ID_HEX_DIGITS = 24


def side_key(cusip: Column | str, put_call: Column | str) -> Column:
    """CUSIP and side (LONG, PUT or CALL)."""
    return F.concat(_col(cusip), F.lit("|"), option_side(put_call))


def option_side(put_call: Column | str) -> Column:
    side = stripped_upper(put_call)
    return F.when(side.isin(*OPTION_SIDES), side).otherwise(F.lit("LONG"))


def cusip_of_side_key(key: Column | str) -> Column:
    """The CUSIP of a ``side_key``: all before its last '|'."""
    return F.substring(_col(key), F.lit(1), F.length(_col(key)) - F.length(F.substring_index(_col(key), "|", -1)) - 1)


def detailed_key(
    cusip: str = "cusip",
    title: str = "title_of_class",
    put_call: str = "put_call",
    share_type: str = "share_type",
    discretion: str = "investment_discretion",
    other_manager: str = "other_manager",
) -> Column:
    """CUSIP plus the five fields that separate lines of one security."""
    parts = [cusip, title, put_call, share_type, discretion, other_manager]
    return F.upper(F.concat_ws("|", *[strip(p) for p in parts]))


def document_key(
    cusip: str = "cusip",
    issuer: str = "issuer_name",
    title: str = "title_of_class",
    share_type: str = "share_type",
    put_call: str = "put_call",
    discretion: str = "investment_discretion",
    other_manager: str = "other_manager",
) -> Column:
    """Holding key of the per-document path: issuer stands in for a missing CUSIP."""
    security = F.coalesce(F.when(F.col(cusip) != "", F.col(cusip)), F.col(issuer), F.lit(""))
    rest = [title, share_type, put_call, discretion, other_manager]
    return F.concat_ws("|", security, *[F.coalesce(F.col(p), F.lit("")) for p in rest])


def digest_id(*parts: Column | str) -> Column:
    """First 24 hex digits of SHA-256 over the '|'-joined parts."""
    return F.substring(F.sha2(F.concat_ws("|", *[_col(p) for p in parts]), 256), 1, ID_HEX_DIGITS)


def event_id(accession: Column | str, holding_key: Column | str) -> Column:
    return F.concat(_col(accession), F.lit(":"), _col(holding_key))


def is_additive(submission_type: Column | str, amendment_type: Column | str) -> Column:
    """True for amendments that add holdings instead of replacing the filing."""
    words = F.replace(F.coalesce(_col(amendment_type), F.lit("")), F.lit("_"), F.lit(" "))
    return (_col(submission_type) != ORIGINAL_FORM) & words.rlike(ADDITIVE_WORDS)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
