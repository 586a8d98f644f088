"""Comparison of two holdings tables, mismatch diagnosis and source integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import option_side, side_key
from ..functions.text import is_valid_cusip, normalize_cusip, strip
from .filings import MANAGER_QUARTER, effective_filing_rows

KEYS = ("cik", "report_period", "security_key")
SHARES_TOLERANCE = 1e-6
WEIGHT_TOLERANCE = 1e-12
COMPARED = ("value_usd", "shares_or_principal", "portfolio_weight", "holding_rank", "available_at", "source_accession_numbers")


def _aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    def named(df: DataFrame, side: str) -> DataFrame:
        cols = [
            (F.sort_array(c) if c == "source_accession_numbers" else F.col(c)).alias(f"{side}_{c}") for c in COMPARED
        ]
        return df.select(*KEYS, *cols)

    return named(left, "l").join(named(right, "r"), list(KEYS), "full_outer")


def compare_holdings(left: DataFrame, right: DataFrame, left_name: str = "left", right_name: str = "right") -> DataFrame:
    """Eight mismatch counters and the largest differences, in one full outer join."""
    no_left, no_right = F.col("l_portfolio_weight").isNull(), F.col("r_portfolio_weight").isNull()
    both = ~no_left & ~no_right
    weight_delta = F.abs(F.col("l_portfolio_weight") - F.col("r_portfolio_weight"))
    shares_delta = F.abs(F.col("l_shares_or_principal") - F.col("r_shares_or_principal"))

    def differ(name: str) -> Column:
        return F.col(f"l_{name}") != F.col(f"r_{name}")

    def counted(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0)).alias(name)

    return _aligned(left, right).agg(
        F.count(F.lit(1)).alias("joined_rows"),
        counted(no_left, f"missing_in_{left_name}"),
        counted(no_right, f"missing_in_{right_name}"),
        counted(both & differ("value_usd"), "value_mismatches"),
        counted(both & (shares_delta > SHARES_TOLERANCE), "shares_mismatches"),
        counted(both & (weight_delta > WEIGHT_TOLERANCE), "weight_mismatches"),
        counted(both & differ("holding_rank"), "rank_mismatches"),
        counted(both & differ("available_at"), "availability_mismatches"),
        counted(both & ~F.col("l_source_accession_numbers").eqNullSafe(F.col("r_source_accession_numbers")), "accession_mismatches"),
        F.max(F.when(both, weight_delta)).alias("max_weight_delta"),
        F.max(F.when(both, shares_delta)).alias("max_shares_delta"),
    )


def with_pass_flag(counters: DataFrame) -> DataFrame:
    names = [c for c in counters.columns if c.startswith("missing_in_") or c.endswith("_mismatches")]
    clean = F.lit(True)
    for n in names:
        clean = clean & (F.col(n) == 0)
    return counters.withColumn("passed", clean)


def prefix_stability(baseline: DataFrame, scaled: DataFrame) -> DataFrame:
    """The small cohort's table must equal the same managers' part of the large one."""
    managers = baseline.select("cik").distinct()
    return compare_holdings(baseline, scaled.join(managers, "cik", "left_semi"), "baseline", "scaled")


def mismatch_inventory(left: DataFrame, right: DataFrame, infotable: DataFrame, selected: DataFrame) -> DataFrame:
    """One-sided holdings with evidence from the raw lines and the reason they differ.

    Raw lines are reduced to counts and spellings per (accession, security) and joined
    on both columns, so no filing's lines are ever gathered in one group.
    """
    one_sided = (
        _aligned(left, right)
        .filter(F.col("l_portfolio_weight").isNull() | F.col("r_portfolio_weight").isNull())
        .select(
            *KEYS,
            F.when(F.col("r_portfolio_weight").isNull(), "left_only").otherwise("right_only").alias("mismatch_side"),
            F.explode_outer(F.coalesce("l_source_accession_numbers", "r_source_accession_numbers")).alias("accession_number"),
        )
    )
    cusip = normalize_cusip("CUSIP")
    raw = infotable.select(
        strip("ACCESSION_NUMBER").alias("accession_number"),
        side_key(cusip, "PUTCALL").alias("security_key"),
        strip("CUSIP").alias("raw_cusip"),
    ).groupBy("accession_number", "security_key").agg(
        F.count(F.lit(1)).alias("lines"), F.min("raw_cusip").alias("first_spelling"), F.max("raw_cusip").alias("last_spelling")
    )
    chosen = selected.select("accession_number", F.lit(True).alias("chosen")).distinct()
    traced = one_sided.join(raw, ["accession_number", "security_key"], "left").join(chosen, "accession_number", "left")
    found = traced.groupBy(*KEYS, "mismatch_side").agg(
        F.sort_array(F.collect_set("accession_number")).alias("traced_accessions"),
        F.sum(F.coalesce("lines", F.lit(0))).alias("raw_lines"),
        F.min("first_spelling").alias("first_raw_cusip"),
        F.max("last_spelling").alias("last_raw_cusip"),
        F.min(F.coalesce("chosen", F.lit(False))).alias("all_selected"),
    )
    reason = (
        F.when(F.col("mismatch_side") == "right_only", "absent_from_left")
        .when(~F.col("all_selected"), "source_accession_not_selected")
        .when(F.col("raw_lines") > 0, "missing_after_selected_raw_holding")
        .otherwise("raw_security_key_differs_after_normalization")
    )
    return found.withColumn("exclusion_reason", reason)


def reason_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("exclusion_reason").agg(F.count(F.lit(1)).alias("row_count"))


def reasons_by_quarter(left: DataFrame, right: DataFrame, lines: DataFrame, dealt: int) -> DataFrame:
    """:func:`reason_counts` of :func:`mismatch_inventory` for two builds by CUSIP and side from filings ``left`` and ``right`` (selected).

    Holdings of either build and their raw lines follow from the lines of a manager-quarter, so lines that name theirs
    are dealt by it once over ``dealt`` partitions, without values and names, and all is decided there.
    """
    sides = effective_filing_rows(left).select("accession_number", *MANAGER_QUARTER, F.lit(True).alias("left")).distinct().join(
        effective_filing_rows(right).select("accession_number", *MANAGER_QUARTER, F.lit(True).alias("right")).distinct(), ["accession_number", *MANAGER_QUARTER], "full_outer")
    filed = sides.groupBy(*MANAGER_QUARTER).agg(F.collect_list(F.struct("accession_number", F.coalesce("left", F.lit(False)).alias("left"), F.coalesce("right", F.lit(False)).alias("right"))).alias("filed"))
    keyed = lines.filter(is_valid_cusip("cusip")).select(*MANAGER_QUARTER, "accession_number", "cusip", option_side("put_call").alias("side"))
    met = keyed.repartition(dealt, *MANAGER_QUARTER).join(filed.repartition(dealt, *MANAGER_QUARTER), list(MANAGER_QUARTER))
    own = F.filter("filed", lambda f: f["accession_number"] == F.col("accession_number"))
    told = met.select(*MANAGER_QUARTER, "cusip", "side", F.explode(own).alias("f"))
    found = told.groupBy(*MANAGER_QUARTER, "cusip", "side").agg(
        F.max("f.left").alias("left"), F.max("f.right").alias("right"), F.min(F.when(F.col("f.left"), F.col("f.right"))).alias("all_selected"))
    # a holding of one build has raw lines in each of its filings, so the reasons that ask for them do not occur
    one_sided = found.filter("left <> right").select(F.when(F.col("right"), "absent_from_left").when(
        ~F.col("all_selected"), "source_accession_not_selected").otherwise("missing_after_selected_raw_holding").alias("exclusion_reason"))
    return reason_counts(one_sided)


def source_integrity(files: DataFrame, manifest: DataFrame, forbidden_packages: tuple[str, ...] = ()) -> DataFrame:
    """Each source file against the manifest: ok, missing, unexpected, changed or forbidden.

    A file is forbidden if the manifest or its own name (the part before "_" or ".") names
    a forbidden package, so one that is on disk but not listed is found as well.
    """
    joined = files.alias("f").join(
        manifest.select("package", "file_name", F.col("size_bytes").alias("m_size"), F.col("sha256").alias("m_sha")),
        "file_name", "full_outer",
    )
    status = (
        F.when(F.col("package").isin(*forbidden_packages) | F.regexp_extract("file_name", r"^([^_.]*)", 1).isin(*forbidden_packages), "forbidden")
        if forbidden_packages else F.when(F.lit(False), "")
    )
    status = (
        status.when(F.col("f.sha256").isNull(), "missing").when(F.col("m_sha").isNull(), "unexpected")
        .when((F.col("f.size_bytes") != F.col("m_size")) | (F.col("f.sha256") != F.col("m_sha")), "changed").otherwise("ok")
    )
    return joined.select("file_name", "package", F.col("f.size_bytes").alias("size_bytes"), status.alias("status"))
