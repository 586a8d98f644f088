"""Filings found by numbers once, and silver that does not carry the CUSIP beside its key."""

from pyspark.sql import functions as F

from quarterdeck.functions.keys import cusip_of_side_key, side_key
from quarterdeck.plans import silver
from quarterdeck.queries.tables import Tables
from quarterdeck.session import save_stage
from quarterdeck.sources import driver_tables as given

SOURCE = "/root/testdata/sf0.001"


def test_filings_are_grouped_by_numbers_and_named_as_their_lines(spark):
    found = given.filings(spark, SOURCE)
    assert found.columns == ["l_suppkey", "qn", "kind", "total"]
    # the names of the lines are made of dates, those of the filings of quarter numbers
    lines = given._lines(spark, SOURCE).select("accession", "cik", "period").distinct()
    named = given._filings(spark, SOURCE, None).select("accession", "cik", "period")
    assert named.exceptAll(lines).count() == 0 and lines.exceptAll(named).count() == 0 and named.count() == found.count()
    for table in (given.submission, given.coverpage, given.summarypage):
        assert table(spark, SOURCE).exceptAll(table(spark, SOURCE, Tables(spark, SOURCE).found_filings())).count() == 0


def test_cusip_of_a_key(spark):
    rows = spark.createDataFrame([("12345678X", "put"), ("1|CALL|89", "call"), ("12345678X", None)], "cusip string, put_call string")
    assert rows.filter(cusip_of_side_key(side_key("cusip", "put_call")) != F.col("cusip")).count() == 0
    assert rows.filter(cusip_of_side_key(side_key("cusip", "put_call")).isNull()).count() == 0


def test_silver_stores_the_cusip_in_its_key_only(spark):
    t, stored = Tables(spark, SOURCE), {}

    def save(df, label):
        stored[label] = df.columns
        return save_stage(df, label)

    built = silver.build_silver(t.filings(), t.lines(), given.UNIT_CUTOVER, save)
    assert "cusip" not in stored["effective"] and "security_key" in stored["effective"]
    assert built.filter(F.col("cusip").isNull() | (F.length("cusip") != 9) | ~F.startswith("security_key", F.concat("cusip", F.lit("|")))).count() == 0
