"""Counts and reasons that follow from keys against the plain ways."""

from pyspark.sql import functions as F

from quarterdeck.operators import folds, holdings, peers, reconcile as rc
from quarterdeck.queries import gold, silver
from quarterdeck.queries.tables import Tables
from quarterdeck.session import Workspace
from quarterdeck.sources import driver_tables as given

SOURCE = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _stored():
    return {key[3] for key in Workspace._paths if key[1] == SOURCE}


def test_fold_sizes_follow_from_keys(spark):
    t = Tables(spark, SOURCE)
    t.workspace.forget()
    found = gold.folds_v1(t).collect()
    assert not _stored() & {"silver", "lines", "peers", "ranked_peers", "manager_quarters"}
    for limit in (0, 3, 100, 100_000):
        formed = t.build_gold(limit).groupBy("cik", F.col("feature_report_period").alias("report_period"), "target_report_period").agg(F.count(F.lit(1)).alias("candidates"))
        told = t.candidate_counts(limit).select(*formed.columns)
        assert told.exceptAll(formed).count() == 0 and formed.exceptAll(told).count() == 0
    plain = folds.expanding_folds(t.build_gold().select("target_report_period"))
    assert [r[:2] + r[3:] for r in found] == [r[:2] + r[3:] for r in plain.collect()]


def test_lengths_of_the_lists_of_securities(spark):
    t = Tables(spark, SOURCE)
    lengths = t.ranked_peers().groupBy(F.col("report_period").alias("t"), "cutoff").agg(F.max("peer_rank").alias("securities"))
    told = peers.security_counts(t.listed(), t.quarters(), peers.quarter_cutoffs(t.quarters()))
    assert told.exceptAll(lengths).count() == 0 and lengths.exceptAll(told).count() == 0


def test_named_lines_are_exchanged_once_and_meet_their_filings(spark):
    t = Tables(spark, SOURCE)
    named = t.lines().withColumns(given.manager_quarter("accession_number"))
    own = named.select("accession_number", F.struct("cik", "report_period").alias("told")).join(t.filings(), "accession_number")
    assert own.filter(~F.col("told").eqNullSafe(F.struct("cik", "report_period"))).count() == 0 and own.count() == named.count()
    # a filing that is listed twice counts twice, a line of an unknown filing not at all
    filings = t.filings().unionByName(t.filings().filter("cik = '0000000001'"))
    strange = named.limit(1).withColumns({"accession_number": F.lit("0000000001-1990-03-31-N"), "report_period": F.to_date(F.lit("1990-03-31"))})
    once, twice = (holdings.summed_holdings(filings, lines, given.UNIT_CUTOVER, 3) for lines in (named.unionByName(strange), t.lines()))
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        own, met = (_plan(holdings.summed_holdings(t.filings(), lines, given.UNIT_CUTOVER, 3)) for lines in (named, t.lines()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(accession_number" not in own and "hashpartitioning(accession_number" in met


def test_reasons_from_one_deal_of_the_lines(spark):
    t = Tables(spark, SOURCE)
    found = {tuple(r) for r in silver.mismatch_reasons(t).collect()}
    assert found == {tuple(r) for r in rc.reason_counts(silver._inventory(t)).collect()} and found
    assert "raw_lines" not in _plan(silver.mismatch_reasons(t))
