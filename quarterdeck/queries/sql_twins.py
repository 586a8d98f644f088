"""SQL twins of the registered queries, for a second engine on the same tables.

``PARTS`` are named common table expressions; ``twin`` puts the ones a query
mentions (directly or through other parts) in front of it.
"""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql.strip()


def twin(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"\b[a-z_0-9]+\b", text))
        for name in PARTS:
            if name in words and name not in needed:
                visit(PARTS[name])
                needed.append(name)

    visit(sql)
    ctes = ",\n".join(f"{name} AS ({PARTS[name]})" for name in needed)
    return f"WITH {ctes}\n{sql.strip()}" if needed else sql.strip()


# ---- the given tables as filings ----------------------------------------------------------
part("base_rows", """
  SELECT l.*, o_custkey, CAST(o_orderdate AS DATE) AS od,
         CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS BIGINT) AS qn0
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
""")
part("base_lines", """
  SELECT *, CASE WHEN is_gap THEN qn0 - 1 ELSE qn0 END AS qn,
         lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS cik,
         last_day(CAST(date_trunc('quarter', od) - CASE WHEN is_gap THEN INTERVAL 3 MONTH ELSE INTERVAL 0 MONTH END
                  + INTERVAL 2 MONTH AS DATE)) AS period
  FROM (SELECT *, (l_suppkey + 3 * qn0) % 19 = 0 AS is_gap FROM base_rows)
""")
part("base", """
  SELECT *, cik || '-' || CAST(period AS VARCHAR) || '-' || kind AS accession
  FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'A'
                       WHEN l_returnflag = 'R' AND (l_suppkey + qn) % 4 = 0 THEN 'R' ELSE 'N' END AS kind
        FROM base_lines)
""")
part("filings", """
  SELECT accession AS accession_number, cik, period AS report_period, kind, l_suppkey, qn,
         CAST(period + CAST(30 + l_suppkey % 16
           + CASE WHEN kind = 'A' THEN 10 WHEN kind = 'R' AND l_suppkey % 2 = 0 THEN 5 WHEN kind = 'R' THEN 15 ELSE 0 END
           + CASE WHEN (l_suppkey * 7 + qn) % 23 = 0 THEN 100 ELSE 0 END AS INTEGER) AS DATE) AS filing_date,
         CASE WHEN kind = 'N' THEN '13F-HR' ELSE '13F-HR/A' END AS submission_type,
         CASE kind WHEN 'A' THEN 1 WHEN 'R' THEN 2 END AS amendment_number,
         CASE WHEN kind = 'A' AND l_suppkey % 5 = 0 THEN 'NEW_HOLDINGS' WHEN kind = 'A' THEN 'NEW HOLDINGS'
              WHEN kind = 'R' AND l_suppkey % 3 <> 0 THEN 'RESTATEMENT' ELSE '' END AS amendment_type,
         year(period) || 'q' || quarter(period) AS package,
         coalesce(any_value(s_name), '') AS filer_name,
         CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS raw_total
  FROM base LEFT JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY accession, cik, period, kind, l_suppkey, qn
""")
part("holding_lines", """
  SELECT accession AS accession_number, cik, period AS report_period,
         CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS row_no,
         p_name AS issuer_name,
         CASE WHEN l_quantity = 50 AND l_linenumber = 1 THEN 'BAD' ELSE
           upper(lpad(substr(p_brand, 7), 3, '0') || rpad(substr(p_type, 1, 6), 6, '*')) END AS cusip,
         CASE l_linenumber WHEN 7 THEN 'PUT' WHEN 6 THEN 'CALL' ELSE '' END AS put_call,
         CASE WHEN l_linestatus = 'O' THEN 'SOLE' ELSE 'DFND' END AS discretion,
         CAST(floor(l_extendedprice) AS BIGINT) AS reported_value, l_quantity AS shares
  FROM base JOIN part ON l_partkey = p_partkey
""")
part("good_lines", """
  SELECT h.*, f.filing_date, f.kind, f.amendment_type,
         cusip || '|' || CASE WHEN put_call IN ('PUT', 'CALL') THEN put_call ELSE 'LONG' END AS side_key,
         cusip || '|COM|' || put_call || '|SH|' || discretion || '|' AS detail_key,
         CASE WHEN filing_date < DATE '1998-07-01' THEN reported_value * 1000 ELSE reported_value END AS value_usd
  FROM holding_lines h JOIN filings f USING (accession_number)
  WHERE length(cusip) = 9
""")
# ---- amendment chains, step by step ---------------------------------------------------------
part("filing_seq", """
  SELECT *, kind <> 'N' AND (replace(amendment_type, '_', ' ') LIKE '%NEW HOLDING%'
                             OR replace(amendment_type, '_', ' ') LIKE '%ADD%') AS additive,
         CAST(row_number() OVER (PARTITION BY cik, report_period
              ORDER BY filing_date, coalesce(amendment_number, 0), accession_number) AS BIGINT) AS filing_order
  FROM filings
""")
part("chain_base", """
  SELECT cik, report_period, coalesce(max(CASE WHEN kind = 'N' THEN filing_order END), 1) AS base_order,
         bool_or(kind = 'N') AS has_original
  FROM filing_seq GROUP BY ALL
""")
part("chain_after", """
  SELECT s.*, b.base_order, b.has_original FROM filing_seq s JOIN chain_base b USING (cik, report_period)
  WHERE s.filing_order >= b.base_order
""")
part("chain_reset", """
  SELECT cik, report_period, max(CASE WHEN NOT additive THEN filing_order END) AS reset_order
  FROM chain_after GROUP BY ALL
""")
part("chain_used", """
  SELECT a.* FROM chain_after a JOIN chain_reset r USING (cik, report_period)
  WHERE r.reset_order IS NULL OR a.filing_order >= r.reset_order
""")
part("silver_sums", """
  SELECT u.cik, u.report_period, side_key AS security_key, cusip,
         CAST(sum(value_usd) AS BIGINT) AS value_usd, sum(shares) AS shares_or_principal,
         arg_min(issuer_name, (filing_order, row_no, value_usd, shares, issuer_name)) AS issuer_name,
         max(u.filing_date) AS available_at,
         array_to_string(list_sort(list(DISTINCT u.accession_number)), '|') AS source_accessions
  FROM chain_used u JOIN good_lines g USING (accession_number)
  GROUP BY u.cik, u.report_period, side_key, cusip
""")
part("silver", """
  SELECT *, CAST(value_usd AS DOUBLE) / nullif(CAST(portfolio_value_usd AS DOUBLE), 0) AS weight
  FROM (SELECT *, CAST(sum(value_usd) OVER (PARTITION BY cik, report_period) AS BIGINT) AS portfolio_value_usd,
               CAST(row_number() OVER (PARTITION BY cik, report_period ORDER BY value_usd DESC, security_key) AS BIGINT) AS holding_rank
        FROM silver_sums)
""")
part("silver_last", """
  SELECT u.cik, u.report_period, g.* EXCLUDE (cik, report_period), u.filing_order
  FROM chain_used u JOIN good_lines g USING (accession_number)
  QUALIFY row_number() OVER (PARTITION BY u.cik, u.report_period, detail_key
    ORDER BY filing_order DESC, row_no DESC, value_usd DESC, shares DESC, issuer_name DESC) = 1
""")
