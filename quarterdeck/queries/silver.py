"""Registered queries: filings, holdings, quality, cohort, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import ORIGINAL_FORM
from ..functions.text import normalize_list_cusip
from ..operators import cohort, filings as fl, holdings as hd, portfolios, quality, reconcile as rc, validation
from ..plans import silver as plan
from ..session import save_stage
from ..sources import documents, driver_tables as given
from .sql_twins import part, twin
from .tables import Tables

# Fixed values of these reports.
LAST_PERIOD = "2001-03-31"
COHORT_WINDOW = ("1995-03-31", "2001-06-30")
COHORT_QUARTERS, COHORT_ANCHOR, COHORT_SIZE, COHORT_PREFIX = 16, "1999-12-31", 50, 10

QUERIES: dict = {}
TWINS: dict = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = lambda spark, source: function(Tables(spark, source))
        if sql is not None:
            TWINS[name] = twin(sql)
        return function

    return register


def joined(name: str):
    return F.array_join(name, "|").alias(name)


SILVER_SQL = """
SELECT cik, report_period, security_key, cusip, issuer_name, value_usd, shares_or_principal, available_at,
       source_accessions, portfolio_value_usd, round(coalesce(weight, 0), 9) AS portfolio_weight, holding_rank
FROM silver
"""


def silver_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "cik", "report_period", "security_key", "cusip", "issuer_name", "value_usd", "shares_or_principal",
        "available_at", F.array_join("source_accession_numbers", "|").alias("source_accessions"),
        "portfolio_value_usd", F.round("portfolio_weight", 9).alias("portfolio_weight"), "holding_rank",
    )


@query("silver_holdings_v2", SILVER_SQL)
def silver_holdings_v2(t: Tables) -> DataFrame:
    return silver_columns(t.build_silver())


@query("silver_holdings_v1", """
SELECT substr(sha256(cik || '|' || CAST(report_period AS VARCHAR) || '|' || detail_key), 1, 24) AS holding_id,
       cik, report_period, detail_key AS security_key, accession_number AS source_accession_number, issuer_name, value_usd,
       shares AS shares_or_principal,
       round(coalesce(CAST(value_usd AS DOUBLE) / nullif(CAST(sum(value_usd) OVER (PARTITION BY cik, report_period) AS DOUBLE), 0), 0), 9) AS portfolio_weight,
       CAST(row_number() OVER (PARTITION BY cik, report_period ORDER BY value_usd DESC, detail_key, CAST(row_no AS VARCHAR)) AS BIGINT) AS holding_rank
FROM silver_last
""")
def silver_holdings_v1(t: Tables) -> DataFrame:
    return t.build_silver_last().select(
        "holding_id", "cik", "report_period", "security_key", "source_accession_number", "issuer_name", "value_usd",
        "shares_or_principal", F.round("portfolio_weight", 9).alias("portfolio_weight"), "holding_rank",
    )


part("chain_last", """
  SELECT * FROM filing_seq QUALIFY row_number() OVER (PARTITION BY cik, report_period ORDER BY filing_order DESC) = 1
""")
part("chain_lists", """
  SELECT s.cik, s.report_period,
         coalesce(string_agg(s.accession_number, '|' ORDER BY s.filing_order) FILTER (u.accession_number IS NOT NULL), '') AS source_accession_numbers,
         coalesce(string_agg(s.accession_number, '|' ORDER BY s.filing_order) FILTER (u.accession_number IS NULL), '') AS superseded_accession_numbers
  FROM filing_seq s LEFT JOIN (SELECT accession_number FROM chain_used) u USING (accession_number) GROUP BY 1, 2
""")


@query("effective_filings", """
SELECT l.cik, l.report_period, l.filing_date AS selected_filing_date, l.filer_name, l.accession_number AS selected_accession_number,
       source_accession_numbers, superseded_accession_numbers,
       CASE WHEN l.kind = 'N' THEN 'initial'
            WHEN l.additive THEN CASE WHEN has_original THEN 'initial_plus_additive_amendment' ELSE 'amendment_only_additive_chain' END
            WHEN l.amendment_type <> '' THEN 'restatement_amendment' ELSE 'unspecified_amendment_replacement' END AS resolution,
       l.package
FROM chain_last l JOIN chain_base USING (cik, report_period) JOIN chain_lists USING (cik, report_period)
""")
def effective_filings(t: Tables) -> DataFrame:
    return fl.effective_filings(t.filings(), label_amendment_only=True).withColumns({
        c: F.array_join(c, "|") for c in ("source_accession_numbers", "superseded_accession_numbers")
    })


@query("filing_order", """
SELECT accession_number, cik, report_period, filing_date, submission_type, filing_order FROM filing_seq
""")
def filing_order(t: Tables) -> DataFrame:
    return fl.filing_order(t.filings()).select(
        "accession_number", "cik", "report_period", "filing_date", "submission_type", "filing_order")


@query("filing_totals", """
SELECT cik, report_period, CAST(sum(CASE WHEN filing_date < DATE '1998-07-01' THEN raw_total * 1000 ELSE raw_total END) AS BIGINT) AS total_value_usd
FROM chain_used GROUP BY ALL
""")
def filing_totals(t: Tables) -> DataFrame:
    per_filing = t.lines().groupBy("accession_number").agg(F.sum("reported_value").alias("reported_total"))
    dated = t.filings().join(per_filing, "accession_number").withColumn(
        "total_value_usd", F.when(F.col("filing_date") < F.lit(given.UNIT_CUTOVER).cast("date"), F.col("reported_total") * 1000)
        .otherwise(F.col("reported_total")))
    return fl.filing_totals(dated)


@query("invalid_rows", """
SELECT f.package, 'INFOTABLE' AS table_name, accession_number, CAST(row_no AS VARCHAR) AS row_key, 'bad CUSIP' AS reason
FROM holding_lines JOIN filings f USING (accession_number) WHERE length(cusip) <> 9
""")
def invalid_rows(t: Tables) -> DataFrame:
    return validation.rejected_rows(t.all_filings(), t.lines())


@query("duplicate_counts", """
SELECT CAST(sum(inside) AS BIGINT) AS duplicates_inside_filings, CAST(sum(across) AS BIGINT) AS duplicates_across_filings
FROM (SELECT sum(lines - 1) AS inside, greatest(count(*) FILTER (used) - 1, 0) AS across
      FROM (SELECT g.cik, g.report_period, accession_number, side_key, count(*) AS lines,
                   accession_number IN (SELECT accession_number FROM chain_used) AS used
            FROM good_lines g GROUP BY ALL) GROUP BY cik, report_period, side_key)
""")
def duplicate_counts(t: Tables) -> DataFrame:
    return hd.duplicate_counts(t.filings(), t.lines(), t.dealt())


@query("quality_metrics", f"""
SELECT CAST(sum(n) AS BIGINT) AS holding_rows, count(*) AS portfolios, count(DISTINCT cik) AS distinct_managers,
       count(DISTINCT report_period) AS distinct_report_periods, min(report_period) AS min_report_period,
       max(report_period) AS max_report_period,
       CAST(coalesce(sum(n) FILTER (report_period > DATE '{LAST_PERIOD}'), 0) AS BIGINT) AS prospective_rows,
       max(abs(w - CASE WHEN v = 0 THEN 0 ELSE 1 END)) < 1e-9 AS weights_close
FROM (SELECT cik, report_period, count(*) AS n, sum(weight) AS w, max(portfolio_value_usd) AS v FROM silver GROUP BY ALL)
""")
def quality_metrics(t: Tables) -> DataFrame:
    m = quality.silver_metrics(t.silver(), LAST_PERIOD)
    return m.withColumn("weights_close", F.col("portfolio_weight_max_abs_error") < 1e-9).drop("portfolio_weight_max_abs_error")


@query("build_report", """
SELECT metric, CAST(value AS DOUBLE) AS value FROM (
  SELECT 'submissions_processed' AS metric, count(*) AS value FROM filings
  UNION ALL SELECT 'packages_processed', count(DISTINCT package) FROM filings
  UNION ALL SELECT 'effective_filings', count(*) FROM chain_last
  UNION ALL SELECT 'unique_managers', count(DISTINCT cik) FROM chain_last
  UNION ALL SELECT 'raw_holdings', count(*) FROM holding_lines
  UNION ALL SELECT 'normalized_holdings', count(*) FROM silver_last
  UNION ALL SELECT 'unique_securities', count(DISTINCT detail_key) FROM silver_last
  UNION ALL SELECT 'identifier_coverage', 1
  UNION ALL SELECT 'invalid_rows_rejected', count(*) FROM holding_lines WHERE length(cusip) <> 9)
""")
def build_report(t: Tables) -> DataFrame:
    return quality.build_report(
        t.all_filings(), t.effective_filings(), t.lines(), t.silver_last(), validation.rejected_rows(t.all_filings(), t.lines()))


# ---- cohort -----------------------------------------------------------------------------------
part("cohort_filings", f"""
  SELECT *, CASE WHEN kind = 'A' AND (l_suppkey + qn) % 5 = 0 THEN NULL
                 WHEN filing_date < DATE '1998-07-01' THEN raw_total * 1000 ELSE raw_total END AS total_value_usd
  FROM filings WHERE report_period BETWEEN DATE '{COHORT_WINDOW[0]}' AND DATE '{COHORT_WINDOW[1]}'
""")
part("cohort_seq", """
  SELECT *, kind = 'A' AS additive,
         row_number() OVER (PARTITION BY cik, report_period ORDER BY filing_date, coalesce(amendment_number, 0), accession_number) AS o
  FROM cohort_filings WHERE total_value_usd IS NOT NULL
""")
part("cohort_quarters", """
  SELECT cik, report_period, sum(total_value_usd) AS total FROM cohort_seq s
  WHERE o >= coalesce((SELECT max(o) FROM cohort_seq r WHERE r.cik = s.cik AND r.report_period = s.report_period AND NOT r.additive), 0)
  GROUP BY ALL
""")
part("cohort_eligible", f"""
  SELECT cik, count(*) AS eligible_quarter_count, CAST(trunc(median(total)) AS BIGINT) AS median_value_usd
  FROM cohort_quarters GROUP BY cik
  HAVING count(*) >= {COHORT_QUARTERS} AND bool_or(report_period = DATE '{COHORT_ANCHOR}')
""")
part("cohort_ranked", """
  SELECT cik, any_value(filer_name) AS filer_name, eligible_quarter_count, median_value_usd,
         row_number() OVER (ORDER BY median_value_usd DESC, cik) AS cohort_rank
  FROM cohort_eligible JOIN filings USING (cik) GROUP BY cik, eligible_quarter_count, median_value_usd
""")


def _eligible(t: Tables) -> DataFrame:
    with_totals = cohort.filings_with_totals(
        t.filings(), t.summaries(), *COHORT_WINDOW, given.UNIT_CUTOVER)
    return cohort.eligible_managers(with_totals, COHORT_QUARTERS, COHORT_ANCHOR)


def _cohort(t: Tables, size: int) -> DataFrame:
    eligible = t.workspace.saved("cohort_eligible", lambda: _eligible(t))
    return cohort.ordered_cohort(eligible, size)


@query("manager_cohort", f"SELECT * FROM cohort_ranked WHERE cohort_rank <= {COHORT_SIZE}")
def manager_cohort(t: Tables) -> DataFrame:
    return _cohort(t, COHORT_SIZE)


@query("cohort_checksum", f"""
SELECT count(*) AS main_actual_count, sha256('[' || string_agg('"' || cik || '"', ',' ORDER BY cohort_rank) || ']') AS ordered_ciks_sha256
FROM cohort_ranked WHERE cohort_rank <= {COHORT_SIZE}
""")
def cohort_checksum(t: Tables) -> DataFrame:
    return cohort.cohort_checksum(_cohort(t, COHORT_SIZE))


@query("cohort_skipped_filings", """
SELECT CAST(sum(CASE WHEN total_value_usd IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS skipped_filings_missing_total FROM cohort_filings
""")
def cohort_skipped(t: Tables) -> DataFrame:
    return cohort.skipped_without_total(cohort.filings_with_totals(
        t.filings(), t.summaries(), *COHORT_WINDOW, given.UNIT_CUTOVER))


def _silver_of(t: Tables, size: int) -> DataFrame:
    filings, lines = hd.lines_in_universe(t.filings(), t.lines(), managers=_cohort(t, size))
    return plan.build_silver(filings, lines, given.UNIT_CUTOVER, dealt=t.dealt())


@query("universe_filter", SILVER_SQL + f" WHERE cik IN (SELECT cik FROM cohort_ranked WHERE cohort_rank <= {COHORT_SIZE})")
def universe_filter(t: Tables) -> DataFrame:
    return silver_columns(_silver_of(t, COHORT_SIZE))


# ---- reconciliation ---------------------------------------------------------------------------
COUNTERS = ["value_mismatches", "shares_mismatches", "weight_mismatches", "rank_mismatches", "availability_mismatches", "accession_mismatches"]


@query("prefix_stability", f"""
SELECT count(*) AS joined_rows, {', '.join(f'CAST(0 AS BIGINT) AS {c}' for c in ['missing_in_baseline', 'missing_in_scaled', *COUNTERS])}, TRUE AS passed
FROM silver WHERE cik IN (SELECT cik FROM cohort_ranked WHERE cohort_rank <= {COHORT_PREFIX})
""")
def prefix_stability(t: Tables) -> DataFrame:
    small = save_stage(_silver_of(t, COHORT_PREFIX), "silver_prefix")
    return rc.with_pass_flag(rc.prefix_stability(small, t.silver())).drop("max_weight_delta", "max_shares_delta")


part("originals_seq", """
  SELECT *, row_number() OVER (PARTITION BY cik, report_period ORDER BY filing_date, accession_number) AS o FROM filings WHERE kind = 'N'
""")
part("originals_sums", """
  SELECT s.cik, s.report_period, side_key AS security_key, CAST(sum(value_usd) AS BIGINT) AS value_usd, sum(shares) AS shares,
         max(g.filing_date) AS available_at, array_to_string(list_sort(list(DISTINCT accession_number)), '|') AS source_accessions
  FROM originals_seq s JOIN good_lines g USING (accession_number) GROUP BY s.cik, s.report_period, side_key
""")
part("originals", """
  SELECT *, CAST(value_usd AS DOUBLE) / nullif(CAST(sum(value_usd) OVER (PARTITION BY cik, report_period) AS DOUBLE), 0) AS weight,
         row_number() OVER (PARTITION BY cik, report_period ORDER BY value_usd DESC, security_key) AS holding_rank
  FROM originals_sums
""")
part("compared", """
  SELECT cik, report_period, security_key, l.weight AS lw, r.weight AS rw, l.value_usd AS lv, r.value_usd AS rv, l.shares AS ls,
         r.shares_or_principal AS rs, l.holding_rank AS lr, r.holding_rank AS rr, l.available_at AS la, r.available_at AS ra,
         l.source_accessions AS lx, r.source_accessions AS rx
  FROM originals l FULL JOIN silver r USING (cik, report_period, security_key)
""")


def _originals(t: Tables) -> DataFrame:
    """The same build from original filings only: the other side to reconcile with."""
    t.lines()  # both sides read them
    return t.workspace.saved("silver_originals", lambda: plan.build_silver(
        t.filings().filter(F.col("submission_type") == ORIGINAL_FORM), t.named_lines(), given.UNIT_CUTOVER, dealt=t.dealt()))


@query("reconcile", """
SELECT count(*) AS joined_rows,
       count(*) FILTER (lw IS NULL) AS missing_in_left, count(*) FILTER (rw IS NULL) AS missing_in_right,
       count(*) FILTER (lv <> rv) AS value_mismatches, count(*) FILTER (abs(ls - rs) > 1e-6) AS shares_mismatches,
       count(*) FILTER (abs(lw - rw) > 1e-12) AS weight_mismatches, count(*) FILTER (lr <> rr) AS rank_mismatches,
       count(*) FILTER (la <> ra) AS availability_mismatches, count(*) FILTER (lx <> rx) AS accession_mismatches,
       round(max(abs(lw - rw)), 9) AS max_weight_delta, max(abs(ls - rs)) AS max_shares_delta, FALSE AS passed
FROM compared
""")
def reconcile(t: Tables) -> DataFrame:
    out = rc.with_pass_flag(rc.compare_holdings(_originals(t), t.silver()))
    return out.withColumn("max_weight_delta", F.round("max_weight_delta", 9))


part("one_sided", """
  SELECT cik, report_period, security_key, CASE WHEN rw IS NULL THEN 'left_only' ELSE 'right_only' END AS mismatch_side,
         unnest(string_split(coalesce(lx, rx), '|')) AS accession_number
  FROM compared WHERE lw IS NULL OR rw IS NULL
""")
part("mismatches", """
  SELECT m.cik, m.report_period, m.security_key, mismatch_side,
         array_to_string(list_sort(list(DISTINCT m.accession_number)), '|') AS traced_accessions,
         CAST(coalesce(sum(n), 0) AS BIGINT) AS raw_lines,
         bool_and(m.accession_number IN (SELECT accession_number FROM chain_used)) AS all_selected
  FROM one_sided m LEFT JOIN (SELECT accession_number, side_key, count(*) AS n FROM good_lines GROUP BY ALL) g
    ON g.accession_number = m.accession_number AND g.side_key = m.security_key
  GROUP BY 1, 2, 3, 4
""")
part("mismatch_rows", """
  SELECT *, CASE WHEN mismatch_side = 'right_only' THEN 'absent_from_left' WHEN NOT all_selected THEN 'source_accession_not_selected'
                 WHEN raw_lines > 0 THEN 'missing_after_selected_raw_holding' ELSE 'raw_security_key_differs_after_normalization' END AS exclusion_reason
  FROM mismatches
""")


def _inventory(t: Tables) -> DataFrame:
    selected = fl.effective_filing_rows(t.filings())
    return rc.mismatch_inventory(_originals(t), t.silver(), t.raw_lines(), selected)


@query("mismatch_inventory", "SELECT * FROM mismatch_rows")
def mismatch_inventory(t: Tables) -> DataFrame:
    return _inventory(t).drop("first_raw_cusip", "last_raw_cusip").withColumn("traced_accessions", F.array_join("traced_accessions", "|"))


@query("mismatch_reasons", "SELECT exclusion_reason, count(*) AS row_count FROM mismatch_rows GROUP BY 1")
def mismatch_reasons(t: Tables) -> DataFrame:
    dealt, originals = t.dealt(), t.filings().filter(F.col("submission_type") == ORIGINAL_FORM)
    return rc.reasons_by_quarter(originals, t.filings(), t.named_lines(), dealt) if dealt else rc.reason_counts(_inventory(t))


@query("scale_gate", f"""
SELECT count(*) = 0 AS passed, CASE WHEN count(*) = 0 THEN '' ELSE 'prospective_rows' END AS blocking_reasons
FROM silver WHERE report_period > DATE '{LAST_PERIOD}'
""")
def scale_gate(t: Tables) -> DataFrame:
    gate = quality.scale_gate(quality.silver_metrics(t.silver(), LAST_PERIOD))
    return gate.withColumn("blocking_reasons", F.array_join("blocking_reasons", "|"))


# ---- filing lists -----------------------------------------------------------------------------
part("latest", """
  SELECT *, CAST(row_number() OVER (PARTITION BY cik ORDER BY report_period DESC, filing_date DESC, accession_number DESC) AS BIGINT) AS recency
  FROM (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY cik, report_period
        ORDER BY CASE WHEN kind = 'N' THEN 0 ELSE 1 END, filing_date DESC, accession_number DESC) = 1)
""")
part("pairs", """
  SELECT * FROM (SELECT cik, recency, accession_number AS current_accession_number, report_period AS current_report_period,
    lead(accession_number) OVER w AS previous_accession_number, lead(report_period) OVER w AS previous_report_period
    FROM latest WINDOW w AS (PARTITION BY cik ORDER BY recency)) WHERE previous_accession_number IS NOT NULL
""")


@query("latest_filings", "SELECT cik, accession_number, report_period, filing_date, submission_type, filer_name, recency FROM latest WHERE recency <= 2")
def latest_filings(t: Tables) -> DataFrame:
    return fl.latest_filings(t.filings(), limit=2)


@query("filing_pairs", "SELECT cik, current_accession_number, current_report_period, previous_accession_number, previous_report_period FROM pairs")
def filing_pairs(t: Tables) -> DataFrame:
    return fl.adjacent_pairs(fl.latest_filings(t.filings()))


@query("recent_filings", """
SELECT accession_number, cik, filing_date, report_period, submission_type, filer_name FROM filings
ORDER BY report_period DESC, filing_date DESC, accession_number DESC LIMIT 20
""")
def recent_filings(t: Tables) -> DataFrame:
    return fl.recent_filings(t.filings(), 20)


@query("official_list_match", """
SELECT count(c) AS matched_holdings, count(*) AS total_holdings
FROM holding_lines h LEFT JOIN (
  SELECT DISTINCT regexp_replace(lpad(substr(p_brand, 7), 3, '0') || rpad(substr(p_type, 1, 6), 6, '*'), '[^A-Za-z0-9]', '', 'g') AS c FROM part) l
  ON regexp_replace(h.cusip, '[^A-Za-z0-9]', '', 'g') = l.c
""")
def official_list_match(t: Tables) -> DataFrame:
    """Every holding line against a reference list made of the part table."""
    listed = given.table(t.spark, t.source, "part").groupBy(normalize_list_cusip(given.part_cusip()).alias("cusip")).agg(
        F.min("p_name").alias("issuer_name")).withColumns({c: F.lit(None).cast("string") for c in ("class_title", "ticker")})
    return documents.list_coverage(documents.enrich_with_list(t.lines(), listed))


@query("snapshots_v1", """
SELECT s.cik, s.report_period, detail_key AS security_key, l.filing_date, l.accession_number AS effective_accession_number,
       CAST(row_number() OVER (PARTITION BY s.cik, s.report_period ORDER BY value_usd DESC, detail_key, CAST(row_no AS VARCHAR)) AS BIGINT) AS rank
FROM silver_last s JOIN chain_last l ON l.cik = s.cik AND l.report_period = s.report_period
""")
def snapshots_v1(t: Tables) -> DataFrame:
    """Point-in-time rows of the last-line-wins build, with the filing selected for the quarter."""
    selected = t.silver_last().select("cik", "report_period", "security_key", "effective_accession_number")
    snaps = portfolios.snapshots(t.silver_last()).select("cik", "report_period", "security_key", "filing_date", "rank")
    return snaps.join(selected, ["cik", "report_period", "security_key"])


@query("merged_snapshots", """
SELECT holding_id, CAST(CASE WHEN quarter(report_period) = 2 THEN 1 ELSE 0 END AS BIGINT) AS duplicates,
       CAST(CASE WHEN quarter(report_period) = 3 AND holding_id LIKE '0%' THEN 2 ELSE 1 END AS BIGINT) AS versions
FROM (SELECT substr(sha256(cik || '|' || CAST(report_period AS VARCHAR) || '|' || detail_key), 1, 24) AS holding_id, report_period FROM silver_last)
""")
def merged_snapshots(t: Tables) -> DataFrame:
    """A build merged with copies of its second quarters and changed rows of its third ones."""
    build = hd.with_holding_id(portfolios.snapshots(t.silver_last()))
    copies = build.filter(F.quarter("report_period") == 2)
    changed = build.filter((F.quarter("report_period") == 3) & F.col("holding_id").startswith("0")).withColumn("value_usd", F.col("value_usd") + 1)
    merged, conflicts = portfolios.merge_snapshots(build, copies, changed)
    return merged.select("holding_id", "duplicates", F.lit(1).cast("long").alias("versions")).unionByName(
        conflicts.select("holding_id", F.lit(0).cast("long").alias("duplicates"), "versions"))
