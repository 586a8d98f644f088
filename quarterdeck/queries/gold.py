"""Registered queries: peers, candidates, examples, folds, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import folds, peers, portfolios
from ..plans import gold as plan
from .silver import query
from .sql_twins import part
from .tables import Tables

# Fixed values of these reports.
CAP = plan.NEGATIVE_LIMIT
VALIDATION = ("1999-03-31", "2000-12-31")
STUDIED_CAPS = (0, 100, 500)

part("facts", """
  SELECT cik, report_period, max(available_at) AS available_at, count(*) AS holdings, sum(weight) AS weight_sum,
         sum(weight * weight) AS hhi, coalesce(sum(weight) FILTER (holding_rank <= 10), 0) AS top10
  FROM silver GROUP BY ALL
""")
part("mq", """
  SELECT f.*, last_day(f.report_period + INTERVAL 3 MONTH) AS target_report_period, n.available_at AS target_available_at,
         n.holdings AS target_holdings, n.weight_sum AS target_weight_sum, coalesce(p.holdings, 0) AS previous_holdings,
         p.holdings IS NOT NULL AS has_previous,
         CASE WHEN n.cik IS NULL THEN 'no_next_quarter' WHEN n.available_at <= f.available_at THEN 'target_already_available' ELSE 'eligible' END AS status
  FROM facts f LEFT JOIN facts n ON n.cik = f.cik AND n.report_period = last_day(f.report_period + INTERVAL 3 MONTH)
               LEFT JOIN facts p ON p.cik = f.cik AND f.report_period = last_day(p.report_period + INTERVAL 3 MONTH)
""")
part("moves", """
  SELECT coalesce(a.cik, b.cik) AS cik, coalesce(a.report_period, last_day(b.report_period + INTERVAL 3 MONTH)) AS report_period,
         abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) AS moved
  FROM silver a FULL JOIN silver b ON a.cik = b.cik AND a.security_key = b.security_key
       AND a.report_period = last_day(b.report_period + INTERVAL 3 MONTH)
""")
part("turn", """
  SELECT cik, report_period, CASE WHEN any_value(has_previous) THEN sum(moved) / 2 ELSE 0 END AS turnover
  FROM moves JOIN mq USING (cik, report_period) GROUP BY ALL
""")
part("cuts", "SELECT DISTINCT report_period AS t, available_at AS c FROM mq WHERE status = 'eligible'")
part("active", """
  SELECT t, c, cik, max(report_period) AS p FROM cuts JOIN facts ON report_period <= t AND available_at <= c GROUP BY ALL
""")
part("peer_stats", """
  SELECT t, c, security_key, count(*) AS owners, round(sum(weight), 10) AS aggregate_weight
  FROM active a JOIN silver s ON s.cik = a.cik AND s.report_period = a.p GROUP BY ALL
""")
part("negatives", """
  SELECT m.cik, m.report_period, s.security_key, s.owners, s.aggregate_weight,
         row_number() OVER (PARTITION BY m.cik, m.report_period ORDER BY owners DESC, round(aggregate_weight, 10) DESC, s.security_key) AS pos
  FROM mq m JOIN peer_stats s ON s.t = m.report_period AND s.c = m.available_at
       LEFT JOIN silver h ON h.cik = m.cik AND h.report_period = m.report_period AND h.security_key = s.security_key
  WHERE status = 'eligible' AND h.cik IS NULL
""")
part("candidate_rows", f"""
  SELECT cik, report_period, security_key, owners, aggregate_weight FROM negatives WHERE pos <= {CAP}
  UNION ALL
  SELECT h.cik, h.report_period, h.security_key, coalesce(owners, 0), coalesce(aggregate_weight, 0)
  FROM silver h JOIN mq m USING (cik, report_period)
       LEFT JOIN peer_stats s ON s.t = h.report_period AND s.c = m.available_at AND s.security_key = h.security_key
  WHERE status = 'eligible'
""")
part("seen", """
  SELECT security_key, arg_min((report_period, available_at, cusip, issuer_name), (available_at, report_period, cik)) AS f
  FROM silver GROUP BY 1
""")
part("history", """
  SELECT c.cik, c.report_period, c.security_key, count(h.cik) AS held, max(h.report_period) AS last_held
  FROM candidate_rows c LEFT JOIN silver h ON h.cik = c.cik AND h.security_key = c.security_key AND h.report_period <= c.report_period
  GROUP BY ALL
""")
part("gold_raw", """
  SELECT c.cik, c.security_key, c.report_period, m.available_at, m.target_report_period, m.target_available_at, owners, aggregate_weight,
         seen.f[1] AS seen_period, seen.f[2] AS seen_available, seen.f[3] AS cusip,
         coalesce(n.issuer_name, b.issuer_name, seen.f[4]) AS issuer_name,
         coalesce(n.weight, 0) AS cw, coalesce(b.weight, 0) AS pw, coalesce(b2.weight, 0) AS lw, coalesce(x.weight, 0) AS tw,
         coalesce(n.holding_rank, m.holdings + 1) AS cr, coalesce(b.holding_rank, m.previous_holdings + 1) AS pr,
         coalesce(x.holding_rank, m.target_holdings + 1) AS tr, x.cik IS NOT NULL AS in_target,
         held, coalesce((year(c.report_period) - year(last_held)) * 4 + (month(c.report_period) - month(last_held)) // 3, -1) AS since,
         turnover, hhi, top10
  FROM candidate_rows c JOIN mq m USING (cik, report_period) JOIN turn USING (cik, report_period) JOIN seen USING (security_key)
       JOIN history USING (cik, report_period, security_key)
       LEFT JOIN silver n ON n.cik = c.cik AND n.security_key = c.security_key AND n.report_period = c.report_period
       LEFT JOIN silver b ON b.cik = c.cik AND b.security_key = c.security_key AND b.report_period = last_day(c.report_period - INTERVAL 3 MONTH)
       LEFT JOIN silver b2 ON b2.cik = c.cik AND b2.security_key = c.security_key AND b2.report_period = last_day(c.report_period - INTERVAL 6 MONTH)
       LEFT JOIN silver x ON x.cik = c.cik AND x.security_key = c.security_key AND x.report_period = m.target_report_period
""")
part("gold", """
  SELECT *, CASE WHEN cw <= 1e-8 AND tw > 1e-8 THEN 'new' WHEN cw > 1e-8 AND tw <= 1e-8 THEN 'exit'
                 WHEN tw - cw > 1e-8 THEN 'increase' WHEN cw - tw > 1e-8 THEN 'decrease' ELSE 'unchanged' END AS action,
         substr(sha256(cik || '|' || CAST(report_period AS VARCHAR) || '|' || security_key), 1, 24) AS example_id
  FROM gold_raw
""")


@query("portfolio_stats", """
SELECT cik, report_period, holdings, round(hhi, 8) AS concentration_hhi, round(top10, 8) AS top10_share, round(turnover, 8) AS turnover
FROM facts JOIN turn USING (cik, report_period)
""")
def portfolio_stats(t: Tables) -> DataFrame:
    return t.quarters().select("cik", "report_period", "holdings", *[
        F.round(c, 8).alias(c) for c in ("concentration_hhi", "top10_share", "turnover")])


@query("eligibility", """
SELECT count(*) FILTER (status = 'eligible') AS eligible_manager_quarters,
       count(*) FILTER (status = 'no_next_quarter') AS manager_quarters_without_exact_next_quarter,
       count(*) FILTER (status = 'target_already_available') AS manager_quarters_target_already_available FROM mq
""")
def eligibility(t: Tables) -> DataFrame:
    return portfolios.eligibility_counts(t.quarters())


@query("holding_history", """
SELECT cik, security_key, report_period, held AS holding_history_quarters, CAST(since AS BIGINT) AS quarters_since_last_held FROM gold_raw
""")
def holding_history(t: Tables) -> DataFrame:
    return t.read_once().select("cik", "security_key", F.col("feature_report_period").alias("report_period"),
                           "holding_history_quarters", "quarters_since_last_held")


@query("first_seen", """
SELECT security_key, f[1] AS security_first_seen_period, f[2] AS security_first_seen_available_at, f[3] AS first_cusip, f[4] AS first_issuer_name FROM seen
""")
def first_seen(t: Tables) -> DataFrame:
    return portfolios.first_seen(t.snapshots())


@query("peer_stats_asof", """
SELECT t, c AS cutoff, security_key, owners AS peer_owner_count, round(aggregate_weight, 6) AS peer_aggregate_weight FROM peer_stats
""")
def peer_stats_asof(t: Tables) -> DataFrame:
    return t.build_peers().withColumn("peer_aggregate_weight", F.round("peer_aggregate_weight", 6))


@query("candidates", """
SELECT cik, report_period, security_key, owners AS peer_owner_count, round(aggregate_weight, 6) AS peer_aggregate_weight FROM candidate_rows
""")
def candidates(t: Tables) -> DataFrame:
    c = ["cik", "report_period", "security_key", "peer_owner_count", F.round("peer_aggregate_weight", 6).alias("peer_aggregate_weight")]
    return t.held().select(*c).unionByName(t.negatives().select(*c))


GOLD_SQL = """
SELECT example_id, cik, security_key, cusip, issuer_name, report_period AS feature_report_period, available_at AS feature_available_at,
       target_report_period, target_available_at, seen_period AS security_first_seen_period, seen_available AS security_first_seen_available_at,
       round(cw, 8) AS current_weight, round(pw, 8) AS previous_weight, round(lw, 8) AS lag2_weight, round(cw - pw, 8) + 0.0 AS weight_momentum,
       cr AS current_rank, pr AS previous_rank, pr - cr AS rank_momentum, held AS holding_history_quarters,
       CAST(since AS BIGINT) AS quarters_since_last_held, round(turnover, 8) AS manager_turnover, round(hhi, 8) AS manager_concentration_hhi,
       round(top10, 8) AS manager_top10_share, owners AS peer_owner_count, round(aggregate_weight, 6) AS peer_aggregate_weight,
       round(tw, 8) AS target_weight, tr AS target_rank, action AS target_action,
       CAST(action = 'new' AS INTEGER) AS target_is_new, CAST(action = 'exit' AS INTEGER) AS target_is_exit,
       CAST(action = 'increase' AS INTEGER) AS target_is_increase, CAST(action = 'decrease' AS INTEGER) AS target_is_decrease,
       CAST(action = 'unchanged' AS INTEGER) AS target_is_unchanged
FROM gold
"""
ROUNDED = {c: 8 for c in ("current_weight", "previous_weight", "lag2_weight", "weight_momentum", "manager_turnover",
                          "manager_concentration_hhi", "manager_top10_share", "target_weight")} | {"peer_aggregate_weight": 6}


@query("gold_examples", GOLD_SQL)
def gold_examples(t: Tables) -> DataFrame:
    return t.build_gold().withColumns({c: F.round(c, d) for c, d in ROUNDED.items()}).drop("in_target")


part("cover_mq", """
  SELECT m.cik, m.report_period, m.target_report_period, any_value(m.target_holdings) AS n, count(*) FILTER (in_target) AS covered,
         any_value(m.target_weight_sum) AS mass, sum(tw) AS covered_mass
  FROM mq m JOIN gold_raw USING (cik, report_period) WHERE status = 'eligible' GROUP BY 1, 2, 3
""")


@query("candidate_coverage", """
SELECT target_report_period, count(*) AS manager_quarter_count, CAST(sum(n) AS BIGINT) AS target_holdings,
       CAST(sum(covered) AS BIGINT) AS target_holdings_in_candidate_universe, round(sum(mass), 6) AS target_weight_mass_total,
       round(sum(covered_mass), 6) AS target_weight_mass_in_candidate_universe, round(avg(covered_mass / mass), 6) AS mean_target_weight_mass_coverage,
       round(CAST(sum(covered) AS DOUBLE) / sum(n), 6) AS target_candidate_coverage, round(sum(covered_mass) / sum(mass), 6) AS target_weight_mass_coverage
FROM cover_mq GROUP BY GROUPING SETS ((target_report_period), ())
""")
def candidate_coverage(t: Tables) -> DataFrame:
    s = plan.coverage_summary(plan.coverage_by_manager_quarter(t.build_gold(), t.quarters()))
    return s.withColumns({c: F.round(c, 6) for c in (
        "target_weight_mass_total", "target_weight_mass_in_candidate_universe", "mean_target_weight_mass_coverage",
        "target_candidate_coverage", "target_weight_mass_coverage")})


@query("coverage_by_manager_quarter", """
SELECT cik, report_period AS feature_report_period, target_report_period, n AS target_holding_count, covered AS covered_target_holding_count,
       round(mass, 6) AS target_weight_mass_total, round(covered_mass, 6) AS target_weight_mass_in_candidate_universe,
       round(covered_mass / mass, 6) AS target_weight_mass_coverage FROM cover_mq
""")
def coverage_by_manager_quarter(t: Tables) -> DataFrame:
    s = plan.coverage_by_manager_quarter(t.build_gold(), t.quarters())
    return s.withColumns({c: F.round(c, 6) for c in (
        "target_weight_mass_total", "target_weight_mass_in_candidate_universe", "target_weight_mass_coverage")})


@query("cap_selection", f"""
SELECT min(cap) AS selected_negative_candidate_limit, round(any_value(best), 6) AS best_mean_target_weight_mass_coverage FROM (
  SELECT cap, coverage, max(coverage) OVER () AS best FROM (
    SELECT cap, avg(covered / mass) AS coverage FROM (
      SELECT cap, m.cik, m.report_period, any_value(m.target_weight_sum) AS mass, coalesce(sum(x.weight), 0) AS covered
      FROM mq m CROSS JOIN (SELECT unnest([{', '.join(map(str, STUDIED_CAPS))}]) AS cap)
      JOIN (SELECT cik, report_period, security_key, pos FROM negatives
            UNION ALL SELECT cik, report_period, security_key, 0 FROM silver) k
        ON k.cik = m.cik AND k.report_period = m.report_period AND k.pos <= cap
      LEFT JOIN silver x ON x.cik = k.cik AND x.security_key = k.security_key AND x.report_period = m.target_report_period
      WHERE status = 'eligible' GROUP BY 1, 2, 3) GROUP BY cap))
WHERE best - coverage <= 0.0025
""")
def cap_selection(t: Tables) -> DataFrame:
    positions = peers.target_positions(t.snapshots(), t.held(), t.quarters(), t.ranked_peers())
    return plan.smallest_good_cap(plan.coverage_by_cap(positions, t.quarters(), STUDIED_CAPS)).withColumn(
        "best_mean_target_weight_mass_coverage", F.round("best_mean_target_weight_mass_coverage", 6))


@query("coverage_by_cap", f"""
SELECT CAST(cap AS BIGINT) AS negative_candidate_limit, round(avg(covered / mass), 6) AS mean_target_weight_mass_coverage FROM (
  SELECT cap, m.cik, m.report_period, any_value(m.target_weight_sum) AS mass, coalesce(sum(x.weight), 0) AS covered
  FROM mq m CROSS JOIN (SELECT unnest([{', '.join(map(str, STUDIED_CAPS))}]) AS cap)
  JOIN (SELECT cik, report_period, security_key, pos FROM negatives
        UNION ALL SELECT cik, report_period, security_key, 0 FROM silver) k
    ON k.cik = m.cik AND k.report_period = m.report_period AND k.pos <= cap
  LEFT JOIN silver x ON x.cik = k.cik AND x.security_key = k.security_key AND x.report_period = m.target_report_period
  WHERE status = 'eligible' GROUP BY 1, 2, 3) GROUP BY cap
""")
def coverage_by_cap(t: Tables) -> DataFrame:
    positions = peers.target_positions(t.snapshots(), t.held(), t.quarters(), t.ranked_peers())
    return plan.coverage_by_cap(positions, t.quarters(), STUDIED_CAPS).withColumn(
        "mean_target_weight_mass_coverage", F.round("mean_target_weight_mass_coverage", 6))


part("fold_quarters", """
  SELECT target_report_period AS quarter, count(*) AS n, row_number() OVER (ORDER BY target_report_period) AS o,
         count(*) OVER () AS quarters FROM gold GROUP BY 1
""")


@query("folds_v1", """
SELECT 'fold-' || (o - 2) AS fold_id, CASE WHEN o > quarters - 1 THEN 'test' ELSE 'validation' END AS role,
       (SELECT string_agg(CAST(quarter AS VARCHAR), '|' ORDER BY quarter) FROM fold_quarters b WHERE b.o < a.o) AS train_target_quarters,
       quarter AS evaluation_target_quarter, CAST((SELECT sum(n) FROM fold_quarters b WHERE b.o < a.o) AS BIGINT) AS train_example_count,
       n AS evaluation_example_count
FROM fold_quarters a WHERE o > 2
""")
def folds_v1(t: Tables) -> DataFrame:
    return folds.expanding_folds(t.candidate_counts()).withColumn("train_target_quarters", F.array_join(F.col("train_target_quarters").cast("array<string>"), "|"))


@query("folds_v2", f"""
SELECT 'validation-' || row_number() OVER (ORDER BY quarter) AS fold_id, 'validation' AS role,
       (SELECT string_agg(CAST(quarter AS VARCHAR), '|' ORDER BY quarter) FROM fold_quarters b WHERE b.o < a.o) AS train_target_quarters,
       quarter AS evaluation_target_quarter, CAST((SELECT sum(n) FROM fold_quarters b WHERE b.o < a.o) AS BIGINT) AS train_example_count,
       n AS evaluation_example_count
FROM fold_quarters a WHERE quarter BETWEEN DATE '{VALIDATION[0]}' AND DATE '{VALIDATION[1]}'
""")
def folds_v2(t: Tables) -> DataFrame:
    return folds.validation_folds(t.candidate_counts(), *VALIDATION).withColumn(
        "train_target_quarters", F.array_join(F.col("train_target_quarters").cast("array<string>"), "|"))


@query("fold_membership", f"""
SELECT 'validation-' || row_number() OVER (ORDER BY quarter) AS fold_id, n AS evaluation_rows,
       CAST((SELECT sum(n) FROM fold_quarters b WHERE b.o < a.o) AS BIGINT) AS train_rows
FROM fold_quarters a WHERE quarter BETWEEN DATE '{VALIDATION[0]}' AND DATE '{VALIDATION[1]}'
""")
def fold_membership(t: Tables) -> DataFrame:
    # the folds are saved: a table of known size, that is sent to the examples
    split = t.save(folds.validation_folds(t.candidate_counts(), *VALIDATION), "folds")
    rows = folds.fold_rows(t.build_gold().select("target_report_period"), split)
    return rows.groupBy("fold_id").agg(
        F.sum((F.col("side") == "evaluation").cast("long")).alias("evaluation_rows"),
        F.sum((F.col("side") == "train").cast("long")).alias("train_rows"))


@query("leakage_audit", """
SELECT code, count(*) AS issues FROM (
  SELECT 'invalid_target_horizon' AS code FROM gold WHERE target_report_period <> last_day(report_period + INTERVAL 3 MONTH)
  UNION ALL SELECT 'target_available_too_early' FROM gold WHERE target_available_at <= available_at
  UNION ALL SELECT 'future_candidate' FROM gold WHERE seen_period > report_period OR seen_available > available_at
  UNION ALL SELECT 'duplicate_example' FROM gold GROUP BY example_id HAVING count(*) > 1) GROUP BY code
UNION ALL SELECT 'rows_checked', count(*) FROM gold
""")
def leakage_audit(t: Tables) -> DataFrame:
    examples = t.audited()
    split = t.save(folds.validation_folds(examples, *VALIDATION), "folds")
    found = folds.audit_examples(examples).unionByName(folds.audit_quarter_folds(examples, split))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("issues")).unionByName(
        examples.agg(F.count(F.lit(1)).alias("issues")).select(F.lit("rows_checked").alias("code"), "issues"))


# ---- planted faults ---------------------------------------------------------------------------
# The first character of an example id says which fault it gets; the split evaluates the last quarter of the window.
LAST = VALIDATION[1]

part("faulty", """
  SELECT example_id, left(example_id, 1) AS c, cik, report_period,
         CASE WHEN left(example_id, 1) = '1' THEN last_day(target_report_period + INTERVAL 3 MONTH) ELSE target_report_period END AS target,
         left(example_id, 1) = '2' AS early, left(example_id, 1) = '3' AS future
  FROM gold
""")
part("faulty_sides", f"""
  SELECT example_id AS id, cik, report_period, target, TRUE AS known, target < DATE '{LAST}' OR c = '4' AS train, target = DATE '{LAST}' OR (c = '5' AND target < DATE '{LAST}') AS evaluation FROM faulty
  UNION ALL SELECT 'x' || example_id, NULL, NULL, NULL, FALSE, TRUE, FALSE FROM faulty WHERE c = '6'
  UNION ALL SELECT 'y' || example_id, NULL, NULL, NULL, FALSE, FALSE, TRUE FROM faulty WHERE c = '7'
""")


@query("planted_faults", f"""
SELECT code, count(*) AS issues FROM (
  SELECT 'duplicate_example' AS code FROM faulty WHERE c = '0'
  UNION ALL SELECT 'invalid_target_horizon' FROM faulty WHERE target <> last_day(report_period + INTERVAL 3 MONTH)
  UNION ALL SELECT 'target_available_too_early' FROM faulty WHERE early
  UNION ALL SELECT 'future_candidate' FROM faulty WHERE future
  UNION ALL SELECT 'unknown_train_example' FROM faulty_sides WHERE NOT known AND train
  UNION ALL SELECT 'unknown_evaluation_example' FROM faulty_sides WHERE NOT known AND evaluation
  UNION ALL SELECT 'train_boundary_violation' FROM faulty_sides WHERE train AND target >= DATE '{LAST}'
  UNION ALL SELECT 'evaluation_boundary_violation' FROM faulty_sides WHERE evaluation AND target <> DATE '{LAST}'
  UNION ALL SELECT DISTINCT 'split_example_overlap' FROM faulty_sides WHERE train AND evaluation
  UNION ALL SELECT DISTINCT 'split_manager_quarter_overlap' FROM (
    SELECT cik FROM faulty_sides WHERE known GROUP BY cik, report_period HAVING bool_or(train) AND bool_or(evaluation))
) GROUP BY code
""")
def planted_faults(t: Tables) -> DataFrame:
    """The audit over examples and a split with planted faults: all ten codes are found."""
    c = F.substring("example_id", 1, 1)
    examples = t.audited().withColumns({
        "target_report_period": F.when(c == "1", F.last_day(F.add_months("target_report_period", 3))).otherwise(F.col("target_report_period")),
        "target_available_at": F.when(c == "2", F.col("feature_available_at")).otherwise(F.col("target_available_at")),
        "security_first_seen_available_at": F.when(c == "3", F.date_add("feature_available_at", 1)).otherwise(F.col("security_first_seen_available_at")),
    })
    examples = examples.unionByName(examples.filter(c == "0"))
    quarter, target = F.lit(LAST).cast("date"), F.col("target_report_period")

    def side(name: str, condition, prefix: str = "") -> DataFrame:
        return examples.filter(condition).select(F.lit("planted").alias("fold_id"), F.lit(name).alias("side"), F.concat(F.lit(prefix), "example_id").alias("example_id"))

    membership = side("train", (target < quarter) | (c == "4")).unionByName(side("evaluation", (target == quarter) | ((c == "5") & (target < quarter))))
    membership = membership.unionByName(side("train", c == "6", "x")).unionByName(side("evaluation", c == "7", "y"))
    split = t.spark.range(1).select(F.lit("planted").alias("fold_id"), quarter.alias("evaluation_target_quarter"))
    found = folds.audit_examples(examples).unionByName(folds.audit_split(examples, membership, split))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("issues"))
