"""Silver from one deal of the lines by manager-quarter; what the audit stores; short hashes of ids."""

from pyspark.sql import functions as F

from quarterdeck.operators import folds, holdings, portfolios
from quarterdeck.plans import silver
from quarterdeck.queries import gold, tables
from quarterdeck.queries.tables import Tables
from quarterdeck.session import Workspace
from quarterdeck.sources import driver_tables as given

SOURCE = "/root/testdata/sf0.001"


def test_dealt_silver_is_the_banded_one_and_stores_no_sums(spark, monkeypatch):
    t = Tables(spark, SOURCE)

    def no_stage(df, label):
        raise AssertionError(f"{label} is stored")

    dealt = silver.build_silver(t.filings(), t.lines(), given.UNIT_CUTOVER, no_stage, dealt=t.dealt()).localCheckpoint()
    banded = silver.build_silver(t.filings(), t.lines(), given.UNIT_CUTOVER).select(*dealt.columns)
    assert dealt.exceptAll(banded).count() == 0 and banded.exceptAll(dealt).count() == 0
    monkeypatch.setattr(tables, "WHOLE_ROWS", t.largest_portfolio() - 1)
    assert t.dealt() is None and t.largest_portfolio() > 1


def test_turnover_exchanges_a_holding_once(spark):
    snaps = portfolios.snapshots(Tables(spark, SOURCE).silver())
    plan = portfolios.turnover(snaps)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_the_audit_stores_no_examples(spark):
    t = Tables(spark, SOURCE)
    t.workspace.forget()
    gold.leakage_audit(t)
    stored = {key[3] for key in Workspace._paths if key[1] == SOURCE}
    assert "audited" in stored and "gold" not in stored
    assert t.audited().count() == t.audited().select("example_id").distinct().count() > 0


def test_ids_that_repeat_are_found_by_short_hashes(spark):
    day = F.lit("2000-03-31").cast("date")
    rows = spark.range(3000).select(
        F.when(F.col("id") == 7, "8").otherwise(F.col("id").cast("string")).alias("example_id"), day.alias("feature_report_period"),
        F.last_day(F.add_months(day, 3)).alias("target_report_period"), day.alias("feature_available_at"), F.date_add(day, 90).alias("target_available_at"),
        day.alias("security_first_seen_period"), day.alias("security_first_seen_available_at"))
    assert [(r.code, r.example_id) for r in folds.audit_examples(rows).collect()] == [("duplicate_example", "8")]


def test_duplicates_are_counted_in_one_deal(spark):
    t = Tables(spark, SOURCE)
    dealt, plain = (holdings.duplicate_counts(t.filings(), t.lines(), n) for n in (3, None))
    assert dealt.collect() == plain.collect()
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(accession_number" not in plan.split("HashAggregate")[1]
