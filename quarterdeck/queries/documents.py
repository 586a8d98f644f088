"""Registered queries: documents in text columns, written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources import bulk, documents, driver_documents as written
from .silver import joined, query
from .sql_twins import part
from .tables import Tables

part("document_lines", """
  SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS key, accession, p_name, p_brand, p_type, l_quantity, l_linenumber, l_linestatus,
         CAST(floor(l_extendedprice) AS BIGINT) AS reported,
         upper(lpad(substr(p_brand, 7), 3, '0') || rpad(substr(p_type, 1, 6), 6, '*')) AS clean
  FROM base JOIN part ON l_partkey = p_partkey
""")


@query("information_tables", """
SELECT CAST(l_orderkey AS VARCHAR) AS document_id, p_name AS issuer_name, 'COM' AS title_of_class,
       CASE WHEN l_quantity = 50 AND l_linenumber = 1 THEN 'BAD' WHEN l_linenumber % 2 = 0 THEN lower(clean) ELSE clean END AS cusip,
       reported AS reported_value, l_quantity AS shares_or_principal, 'SH' AS share_type,
       CASE l_linenumber WHEN 7 THEN 'PUT' WHEN 6 THEN 'CALL' ELSE '' END AS put_call,
       CASE WHEN l_linestatus = 'O' THEN 'SOLE' ELSE 'DFND' END AS investment_discretion, CAST(NULL AS VARCHAR) AS other_manager,
       CASE WHEN l_linenumber % 2 = 1 THEN CAST(floor(l_quantity) AS BIGINT) ELSE 0 END AS voting_authority_sole,
       0::BIGINT AS voting_authority_shared, 0::BIGINT AS voting_authority_none
FROM document_lines
""")
def information_tables(t: Tables) -> DataFrame:
    return documents.information_table_lines(written.information_tables(t.spark, t.source))


@query("cover_pages", """
SELECT accession_number, cik, submission_type AS form_type, report_period, nullif(trim(filer_name), '') AS filer_name FROM filings
""")
def cover_pages(t: Tables) -> DataFrame:
    return documents.cover_pages(written.cover_pages(t.spark, t.source))


@query("submission_feeds", """
SELECT cik, submission_type AS form_type, accession_number, filing_date, CASE WHEN quarter(report_period) <> 3 THEN report_period END AS report_period,
       'x/primary_doc.xml' AS primary_document, '' AS primary_doc_description
FROM filings
""")
def submission_feeds(t: Tables) -> DataFrame:
    return documents.recent_filings(written.submission_feeds(t.spark, t.source))


@query("information_table_choice", """
SELECT accession_number, CASE (l_suppkey + month(report_period)) % 4
         WHEN 0 THEN CASE WHEN l_suppkey % 3 = 0 THEN 'Other.XML' ELSE 'infotable.xml' END WHEN 1 THEN 'Form13F.xml' WHEN 3 THEN 'A.xml' END AS information_table
FROM filings
""")
def information_table_choice(t: Tables) -> DataFrame:
    return documents.information_table_names(written.filing_indexes(t.spark, t.source))


@query("securities_list", f"""
SELECT regexp_replace(upper(lpad(substr(p_brand, 7), 3, '0') || rpad(substr(p_type, 1, 6), 6, '*')), '[^A-Z0-9]', '', 'g') AS cusip,
       CASE WHEN even THEN p_name || ', INC' ELSE p_name END AS issuer_name, 'COM' AS class_title,
       CASE WHEN NOT even THEN 'T' || p_partkey END AS ticker, CASE WHEN even AND p_partkey % 5 = 0 THEN 'NEW' END AS status
FROM (SELECT *, (p_partkey // {written.SECURITIES_PER_LIST}) % 2 = 0 AS even FROM part WHERE p_partkey % 17 <> 0)
QUALIFY row_number() OVER (PARTITION BY cusip ORDER BY p_partkey) = 1
""")
def securities_list(t: Tables) -> DataFrame:
    return documents.securities_of_lists(written.securities_lists(t.spark, t.source), "list_id")


# What the reader says to each planted fault.
_REASONS = {
    1: "missing VALUE", 2: "bad VALUE", 3: "missing INFOTABLE_SK", 4: "missing NAMEOFISSUER", 5: "missing TITLEOFCLASS", 6: "missing CUSIP", 7: "bad CUSIP",
    8: "missing SSHPRNAMT", 9: "bad SSHPRNAMT", 10: "missing SSHPRNAMTTYPE", 11: "missing INVESTMENTDISCRETION", 12: "negative VALUE or SSHPRNAMT",
    13: "bad VOTING_AUTH_SOLE",
}
# a line's own unusable CUSIP comes after what VALUE and the texts before CUSIP lack, and before the rest
part("package_lines", f"""
  SELECT *, CASE WHEN fault IN (1, 2, 3, 4, 5, 6) THEN told WHEN unusable THEN 'bad CUSIP' ELSE told END AS reason
  FROM (SELECT *, key % {written.FAULT_CYCLE} AS fault, l_quantity = 50 AND l_linenumber = 1 AS unusable,
               CASE key % {written.FAULT_CYCLE} {' '.join(f"WHEN {k} THEN '{r}'" for k, r in _REASONS.items())} END AS told FROM document_lines)
""")


def package_lines(t: Tables) -> DataFrame:
    return bulk.parse_holdings(bulk.package_rows(written.package_tables(t.spark, t.source), [*written.PACKAGE_COLUMNS, "OTHERMANAGER"]))


@query("package_tables", """
SELECT accession AS accession_number, CAST(key AS VARCHAR) AS info_table_key, p_name AS issuer_name, clean AS cusip, reported AS reported_value,
       l_quantity AS shares_or_principal, CASE l_linenumber WHEN 7 THEN 'PUT' WHEN 6 THEN 'CALL' ELSE '' END AS put_call,
       1::BIGINT AS voting_authority_sole
FROM package_lines WHERE reason IS NULL
""")
def package_tables(t: Tables) -> DataFrame:
    return package_lines(t).filter("reason IS NULL").select(
        "accession_number", "info_table_key", "issuer_name", "cusip", "reported_value", "shares_or_principal", "put_call", "voting_authority_sole")


@query("package_rejections", """
SELECT accession AS accession_number, CASE WHEN fault = 3 THEN '' ELSE CAST(key AS VARCHAR) END AS info_table_key, reason FROM package_lines WHERE reason IS NOT NULL
""")
def package_rejections(t: Tables) -> DataFrame:
    """Every kind of rejected holding line, with its reason."""
    return package_lines(t).filter("reason IS NOT NULL").select("accession_number", "info_table_key", "reason")


@query("reference_holdings", """
SELECT cik, report_period, security_key, value_usd, shares_or_principal, round(coalesce(weight, 0), 9) AS portfolio_weight, holding_rank, available_at,
       source_accessions AS source_accession_numbers FROM silver
""")
def reference_holdings(t: Tables) -> DataFrame:
    """Silver holdings as CSV lines with a JSON list, read back with types."""
    columns = [c.split()[0] for c in documents.RECONCILED_SCHEMA.split(",")]
    rows = t.silver().withColumn("source_accession_numbers", F.to_json("source_accession_numbers")).select(*columns)
    lines = rows.select(F.to_csv(F.struct(*columns), {"escape": '"'}).alias("value"))
    return documents.reference_holdings(lines).withColumns({
        "portfolio_weight": F.round("portfolio_weight", 9), "holding_rank": F.col("holding_rank").cast("long"),
        "source_accession_numbers": joined("source_accession_numbers")})
