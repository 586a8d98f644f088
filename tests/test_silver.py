import itertools
from datetime import date

import pytest
from pyspark.sql import functions as F

from quarterdeck.functions import keys, quarters, text
from quarterdeck.operators import cohort, filings as fl, quality, reconcile as rc, validation
from quarterdeck.operators.ranking import rank_within
from quarterdeck.plans import silver
from quarterdeck.sources import bulk

SUBMISSION = """ACCESSION_NUMBER	FILING_DATE	SUBMISSIONTYPE	CIK	PERIODOFREPORT
A-1	15-MAY-2024	13F-HR	100	31-MAR-2024
A-2	20-MAY-2024	13F-HR/A	100	31-MAR-2024
B-1	14-MAY-2024	13F-HR	200	31-MAR-2024
B-2	21-MAY-2024	13F-HR/A	200	31-MAR-2024
C-1	14-NOV-2022	13F-HR	300	30-SEP-2022
bad	NOT-A-DATE	13F-HR	400	31-MAR-2024
"""
COVERPAGE = """ACCESSION_NUMBER	REPORTCALENDARORQUARTER	ISAMENDMENT	AMENDMENTNO	AMENDMENTTYPE	FILINGMANAGER_NAME
A-1	31-MAR-2024	N			FIRST
A-2	31-MAR-2024	Y	1	RESTATEMENT	FIRST
B-1	31-MAR-2024	N			SECOND
B-2	31-MAR-2024	Y	1	NEW HOLDINGS	SECOND
C-1	30-SEP-2022	N			THIRD
bad	31-MAR-2024	N			FOURTH
"""
INFOTABLE = """ACCESSION_NUMBER	INFOTABLE_SK	NAMEOFISSUER	TITLEOFCLASS	CUSIP	FIGI	VALUE	SSHPRNAMT	SSHPRNAMTTYPE	PUTCALL	INVESTMENTDISCRETION	OTHERMANAGER
A-1	1	APPLE INC	COM	037833100		1000000	10000	SH		SOLE	
A-1	2	MICROSOFT CORP	COM	594918104		500000	5000	SH		SOLE	
A-2	1	APPLE INC	COM	037833100		1200000	12000	SH		SOLE	
A-2	2	AMAZON COM INC	COM	023135106		300000	3000	SH		SOLE	
B-1	1	APPLE INC	COM	037833100		200000	2000	SH		SOLE	
B-2	1	NVIDIA CORP	COM	67066G104		400000	4000	SH		SOLE	
B-2	2	NVIDIA CORP	COM	67066G104		450000	4500	SH		SOLE	
C-1	1	OLD "QUOTED ISSUER	COM	123456789		100	1000	SH		SOLE	
C-1	2	BROKEN	COM	BAD		50	500	SH		SOLE	
"""


@pytest.fixture(scope="module")
def package(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("bulk")
    folder = root / "package=2024q2"
    folder.mkdir()
    for name, content in (("SUBMISSION", SUBMISSION), ("COVERPAGE", COVERPAGE), ("INFOTABLE", INFOTABLE)):
        # a byte order mark must not hide the first column
        (folder / f"{name}.tsv").write_text("﻿" + content if name == "SUBMISSION" else content, encoding="utf-8")
    tables = {n: bulk.read_package_table(spark, str(root), n) for n in ("SUBMISSION", "COVERPAGE", "INFOTABLE")}
    return bulk.parse_submissions(tables["SUBMISSION"], tables["COVERPAGE"]), bulk.parse_holdings(tables["INFOTABLE"])


def test_last_line_wins_build(spark, package):
    filings, lines = package
    rows = {(r.cik, r.cusip): r for r in silver.build_silver_last(filings, lines).collect()}
    assert rows["0000000200", "67066G104"].value_usd == 450_000
    assert rows["0000000300", "123456789"].value_usd == 100_000
    assert rows["0000000300", "123456789"].issuer_name == 'OLD "QUOTED ISSUER'
    assert ("0000000100", "594918104") not in rows
    assert [rows["0000000100", c].holding_rank for c in ("037833100", "023135106")] == [1, 2]
    assert rows["0000000100", "037833100"].portfolio_weight == pytest.approx(0.8)


def test_summed_build(package):
    filings, lines = package
    rows = {(r.cik, r.security_key): r for r in silver.build_silver(filings, lines).collect()}
    nvidia = rows["0000000200", "67066G104|LONG"]
    assert nvidia.value_usd == 850_000 and nvidia.shares_or_principal == 8_500
    assert nvidia.available_at == date(2024, 5, 21) and nvidia.source_accession_numbers == ["B-2"]
    assert rows["0000000200", "037833100|LONG"].available_at == date(2024, 5, 14)


def test_effective_filings_and_rejections(package):
    filings, lines = package
    usable = filings.filter("reason is null")
    rows = {r.cik: r for r in fl.effective_filings(usable).collect()}
    assert rows["0000000100"].resolution == "restatement_amendment"
    assert rows["0000000100"].source_accession_numbers == ["A-2"]
    assert rows["0000000100"].superseded_accession_numbers == ["A-1"]
    assert rows["0000000200"].resolution == "initial_plus_additive_amendment"
    assert rows["0000000200"].source_accession_numbers == ["B-1", "B-2"]
    assert rows["0000000300"].resolution == "initial"
    rejected = {(r.table_name, r.reason) for r in validation.rejected_rows(filings, lines).collect()}
    assert rejected == {("SUBMISSION", "bad FILING_DATE"), ("INFOTABLE", "bad CUSIP")}


def fold_chain(chain, sums):
    """Plain left-to-right reading of the rules."""
    held = {}
    for kind, accession, value in chain:
        if kind == "add":
            held["X"] = held.get("X", 0) + value if sums else value
        else:
            held = {"X": value}
    return held["X"]


def test_chains_match_a_sequential_reading(spark):
    """All orders of originals, restatements and additive amendments of one manager-quarter."""
    submissions, lines, expected = [], [], {}
    forms = {"orig": ("13F-HR", ""), "rest": ("13F-HR/A", "RESTATEMENT"), "add": ("13F-HR/A", "NEW_HOLDINGS")}
    for n, chain in enumerate(c for size in (1, 2, 3) for c in itertools.product(forms, repeat=size)):
        cik, steps = f"{n:010d}", []
        for i, kind in enumerate(chain):
            accession, value = f"{cik}-{i}", 10 ** i
            form, amendment = forms[kind]
            submissions.append((accession, date(2024, 5, 1 + i), form, cik, date(2024, 3, 31), "M", form != "13F-HR", i, amendment, "p", None))
            lines.append((accession, "1", "I", "COM", "037833100", "", value, 1.0, "SH", "", "SOLE", "", 0, 0, 0, None))
            steps.append((kind, accession, value))
        last = max((i for i, s in enumerate(steps) if s[0] == "orig"), default=0)  # earlier filings are superseded
        expected[cik] = (fold_chain(steps[last:], True), fold_chain(steps[last:], False))
    filings = spark.createDataFrame(submissions, "accession_number string, filing_date date, submission_type string, cik string, report_period date,"
                                    " filer_name string, is_amendment boolean, amendment_number int, amendment_type string, package string, reason string")
    holdings = spark.createDataFrame(lines, "accession_number string, info_table_key string, issuer_name string, title_of_class string, cusip string, figi string,"
                                     " reported_value long, shares_or_principal double, share_type string, put_call string, investment_discretion string,"
                                     " other_manager string, voting_authority_sole long, voting_authority_shared long, voting_authority_none long, reason string")
    sums = {r.cik: r.value_usd for r in silver.build_silver(filings, holdings).collect()}
    last = {r.cik: r.value_usd for r in silver.build_silver_last(filings, holdings).collect()}
    assert {k: (sums[k], last[k]) for k in expected} == expected


def test_identifiers(spark):
    df = spark.createDataFrame([(" 037833100\t",), ("67066g104",), ("03-7833 100",), ("é37833100",), ("",), (None,)], "c string")
    got = [r[0] for r in df.select(text.normalize_cusip("c")).collect()]
    assert got == ["037833100", "67066G104", "037833100", "37833100", "", ""]
    row = spark.range(1).select(
        text.normalize_cik(F.lit("CIK 100")), text.normalize_cik(F.lit("none")), text.parse_number(F.lit("1,234"), "long"),
        text.truthy(F.lit(" yes ")), keys.side_key(F.lit("X"), F.lit(" put ")),
        *[text.parse_filing_date(F.lit(d)) for d in ("05-MAY-2024", "2024-05-05", "5/5/2024", "soon")],
        quarters.shift_quarter(F.lit("2023-12-31").cast("date"), 1), quarters.quarter_distance(F.lit("2023-12-31").cast("date"), F.lit("2024-09-30").cast("date")),
    ).first()
    day = date(2024, 5, 5)
    assert tuple(row) == ("0000000100", None, 1234, True, "X|PUT", day, day, day, None, date(2024, 3, 31), 3)
    assert [r.quarter for r in quarters.quarter_range(spark, "2023q4", "2024Q2").collect()] == ["2023q4", "2024q1", "2024q2"]
    with pytest.raises(ValueError):
        quarters.quarter_range(spark, "2024q2", "2024q1")


def test_rank_with_a_hot_group(spark):
    """One group holds most rows, with many ties; ranks, totals and running sums stay exact."""
    rows = [("hot", i % 97, f"k{i:04d}") for i in range(2000)] + [("cold", 5, "a"), ("cold", 0, "b")]
    df = spark.createDataFrame(rows, "g string, v long, k string")
    from quarterdeck.functions.measures import octave
    got = rank_within(df, ["g"], [F.desc("v"), F.col("k")], [-octave("v")], totals={"total": F.col("v")}, running={"sofar": F.col("v")}).collect()
    for group in ("hot", "cold"):
        mine = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2]))
        theirs = sorted((r for r in got if r.g == group), key=lambda r: r["rank"])
        assert [(r.k, r["rank"]) for r in theirs] == [(m[2], i + 1) for i, m in enumerate(mine)]
        assert {r.total for r in theirs} == {sum(m[1] for m in mine)}
        assert [r.sofar for r in theirs] == list(itertools.accumulate(m[1] for m in mine))


def test_reconcile_prefix_and_gate(spark, package):
    filings, lines = package
    table = silver.build_silver(filings, lines)
    assert rc.with_pass_flag(rc.compare_holdings(table, table)).first().passed
    changed = table.withColumn("value_usd", F.when(F.col("cik") == "0000000200", F.col("value_usd") + 1).otherwise(F.col("value_usd")))
    assert rc.compare_holdings(table, changed).first().value_mismatches == 2
    small = table.filter("cik = '0000000100'")
    metrics = rc.prefix_stability(small, table).crossJoin(quality.silver_metrics(table, "2024-03-31"))
    assert quality.scale_gate(metrics).first().passed
    late = quality.scale_gate(quality.silver_metrics(table, "2023-12-31")).first()
    assert not late.passed and late.blocking_reasons == ["prospective_rows"]


def test_cohort_ties_by_cik(spark):
    eligible = spark.createDataFrame([("2", "b", 16, 5), ("1", "a", 16, 5), ("3", "c", 16, 9)], "cik string, filer_name string, eligible_quarter_count long, median_value_usd long")
    assert [r.cik for r in cohort.ordered_cohort(eligible, 2).orderBy("cohort_rank").collect()] == ["3", "1"]
