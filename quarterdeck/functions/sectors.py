"""Sector inference from issuer names by an ordered pattern table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

UNKNOWN_SECTOR = "Unknown"

# Ordered groups; the first group with a contained word wins.
SECTOR_WORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Technology", (
        "APPLE", "MICROSOFT", "NVIDIA", "ORACLE", "SNOWFLAKE", "INTERNATIONAL BUSINESS MACHINES",
        "TAIWAN SEMICONDUCTOR", "HEWLETT PACKARD")),
    ("Communication Services", (
        "ALPHABET", "META", "NETFLIX", "DISNEY", "SPOTIFY", "COMCAST", "CHARTER COMMUNICATIONS")),
    ("Financials", (
        "VISA", "MASTERCARD", "AMERICAN EXPRESS", "BANK", "CAPITAL ONE", "JPMORGAN", "GOLDMAN",
        "MORGAN STANLEY", "PAYPAL", "DISCOVER", "MOODY", "S&P GLOBAL")),
    ("Consumer Staples", (
        "KRAFT HEINZ", "COCA COLA", "PEPSICO", "PROCTER", "COSTCO", "MONDELEZ", "KROGER", "WALMART")),
    ("Consumer Discretionary", (
        "AMAZON", "TESLA", "HOME DEPOT", "LOWE", "MCDONALD", "STARBUCKS", "NIKE", "BOOKING")),
    ("Healthcare", (
        "HEALTH", "PFIZER", "MERCK", "ABBVIE", "ELI LILLY", "JOHNSON & JOHNSON", "UNITEDHEALTH",
        "DANAHER", "THERMO FISHER")),
    ("Energy", (
        "CHEVRON", "OCCIDENTAL", "EXXON", "CONOCOPHILLIPS", "SCHLUMBERGER", "EOG", "ENERGY")),
    ("Industrials", (
        "DELTA AIR", "BOEING", "CATERPILLAR", "UNION PACIFIC", "LOCKHEED", "GENERAL ELECTRIC", "3M")),
    ("Utilities", ("DUKE ENERGY", "NEXTERA", "SOUTHERN CO", "DOMINION ENERGY")),
    ("Real Estate", ("REALTY INCOME", "PROLOGIS", "SIMON PROPERTY", "WELLTOWER")),
)


def infer_sector(name: Column | str, table: Sequence[tuple[str, Sequence[str]]] = SECTOR_WORDS) -> Column:
    upper = F.upper(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    sector: Column | None = None
    for label, words in table:
        hit = upper.rlike("|".join(re.escape(w) for w in words))
        sector = F.when(hit, label) if sector is None else sector.when(hit, label)
    return F.lit(UNKNOWN_SECTOR) if sector is None else sector.otherwise(UNKNOWN_SECTOR)
