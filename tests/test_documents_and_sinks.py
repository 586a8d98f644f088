import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from quarterdeck.functions.sectors import infer_sector
from quarterdeck.operators import changes as ch, clients as cl, reconcile as rc, validation
from quarterdeck.sinks import tables as sk
from quarterdeck.sources import documents as doc

LINE = """<{p}infoTable><{p}nameOfIssuer>APPLE INC</{p}nameOfIssuer><{p}titleOfClass>COM</{p}titleOfClass><{p}cusip>037833100</{p}cusip><{p}value>12.0</{p}value>
<{p}shrsOrPrnAmt><{p}sshPrnamt>1,000</{p}sshPrnamt><{p}sshPrnamtType>SH</{p}sshPrnamtType></{p}shrsOrPrnAmt><{p}putCall>Put</{p}putCall>
<{p}votingAuthority><{p}Sole>7</{p}Sole></{p}votingAuthority></{p}infoTable>"""


@pytest.mark.parametrize("prefix", ["", "ns1:"])
def test_information_table(spark, tmp_path, prefix):
    name = "xmlns" + (":ns1" if prefix else "")
    (tmp_path / "t.xml").write_text(f'<{prefix}informationTable {name}="http://x">{LINE.format(p=prefix)}<{prefix}infoTable><{prefix}cusip>1</{prefix}cusip></{prefix}infoTable></{prefix}informationTable>')
    rows = {r.cusip: r for r in doc.read_information_tables(spark, str(tmp_path)).collect()}
    apple, bare = rows["037833100"], rows["1"]
    assert (apple.issuer_name, apple.reported_value, apple.shares_or_principal, apple.put_call, apple.voting_authority_sole) == ("APPLE INC", 12, 1000.0, "PUT", 7)
    assert (bare.issuer_name, bare.reported_value, bare.shares_or_principal, bare.other_manager, bare.voting_authority_none) == ("", 0, 0.0, None, 0)


def test_cover_page(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<e:edgarSubmission xmlns:e="http://x"><e:headerData><e:filerInfo><e:filer><e:credentials><e:cik>0001</e:cik></e:credentials></e:filer></e:filerInfo></e:headerData>'
                                    '<e:formData><e:coverPage><e:reportCalendarOrQuarter>03-31-2024</e:reportCalendarOrQuarter><e:filingManager><e:name>M</e:name></e:filingManager></e:coverPage></e:formData></e:edgarSubmission>')
    row = doc.read_cover_pages(spark, str(tmp_path)).first()
    assert (row.cik, row.form_type, row.report_period, row.filer_name) == ("0001", "13F-HR", date(2024, 3, 31), "M")


def test_feed_and_index(spark):
    feed = {"cik": "77", "filings": {"recent": {"form": ["10-K", "13F-HR"], "accessionNumber": ["a", "b"], "filingDate": ["2024-01-01", "2024-05-01"],
                                               "reportDate": ["", "2024-03-31"], "primaryDocument": ["x", "y/primary_doc.xml"], "primaryDocDescription": ["", ""]}}}
    row = doc.recent_filings(spark.createDataFrame([(json.dumps(feed),)], "value string")).collect()
    assert [(r.cik, r.accession_number, r.report_period) for r in row] == [("0000000077", "b", date(2024, 3, 31))]
    def index(*items):
        return json.dumps({"directory": {"item": [{"name": n, "size": s} for n, s in items]}})
    names = spark.createDataFrame([
        ("1", "d/primary_doc.xml", index(("primary_doc.xml", "9"), ("small.xml", "10"), ("Big.XML", "200"))),
        ("2", "d/only.xml", index(("only.xml", ""), ("a.txt", "5"))), ("3", "d/p.htm", index(("p.htm", "5")))],
        "accession_number string, primary_document string, value string")
    assert {r.accession_number: r.information_table for r in doc.information_table_names(names).collect()} == {"1": "Big.XML", "2": "only.xml", "3": None}


def test_securities_list_and_enrichment(spark, tmp_path):
    (tmp_path / "list.csv").write_text('Official list,,,\nCUSIP No,Issuer Description,Class,Status\n037833-10 0,"APPLE, INC",COM,\n037833100,LATER,COM,\n,NO CUSIP,COM,\n')
    listed = doc.read_securities_list(spark, str(tmp_path / "list.csv"))
    assert [(r.cusip, r.issuer_name, r.class_title, r.status) for r in listed.collect()] == [("037833100", "APPLE, INC", "COM", None)]
    lines = spark.createDataFrame([("037833100", "old"), ("999999999", "kept")], "cusip string, official_issuer_name string")
    rich = doc.enrich_with_list(lines, listed)
    assert {r.cusip: (r.official_issuer_name, r.official_list_match) for r in rich.collect()} == {"037833100": ("APPLE, INC", True), "999999999": ("kept", False)}
    assert tuple(doc.list_coverage(rich).first()) == (1, 2)


def test_securities_list_of_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Issuer,CUSIP,Class\nFIRST,111111111,COM\n")
    (tmp_path / "b.tsv").write_text("note\nCUSIP\tIssuer Description\tStatus\n222222222\tSECOND\tNEW\n")
    listed = doc.read_securities_list(spark, str(tmp_path))
    assert {(r.cusip, r.issuer_name, r.class_title, r.status) for r in listed.collect()} == {
        ("111111111", "FIRST", "COM", None), ("222222222", "SECOND", None, "NEW")}


def test_source_integrity(spark, tmp_path):
    for n in ("a.zip", "b.zip", "x.zip"):
        (tmp_path / n).write_text(n)
    files = doc.source_files(spark, str(tmp_path))
    shas = {r.file_name: r.sha256 for r in files.collect()}
    manifest = spark.createDataFrame([("a", "a.zip", 5, shas["a.zip"]), ("b", "b.zip", 5, "0"), ("c", "c.zip", 5, "0")], "package string, file_name string, size_bytes long, sha256 string")
    assert {r.file_name: r.status for r in rc.source_integrity(files, manifest).collect()} == {"a.zip": "ok", "b.zip": "changed", "c.zip": "missing", "x.zip": "unexpected"}
    # forbidden by the manifest and, for the unlisted file, by its name
    assert {r.file_name: r.status for r in rc.source_integrity(files, manifest, ("x", "b")).collect()} == {
        "a.zip": "ok", "b.zip": "forbidden", "c.zip": "missing", "x.zip": "forbidden"}


def test_keyed_replace_and_portfolios(spark, tmp_path):
    path = str(tmp_path / "t")
    def rows(*r):
        return spark.createDataFrame(list(r), "acc string, k string, v int")
    sk.replace_by_key(spark, path, rows(("a", "1", 1), ("a", "2", 1), ("b", "1", 1)), ["acc"], "acc")
    for _ in range(2):
        sk.replace_by_key(spark, path, rows(("a", "1", 9)), ["acc"], "acc")
    assert {tuple(r) for r in spark.read.parquet(path).select("acc", "k", "v").collect()} == {("a", "1", 9), ("b", "1", 1)}
    clients = str(tmp_path / "c")
    def portfolio(client, *held):
        return spark.createDataFrame([(client, "n", "s", c, w) for c, w in held], "client_id string, client_name string, strategy string, cusip string, weight double")
    sk.store_client_portfolios(spark, clients, portfolio("1", ("x", .5), ("y", .5)), buckets=2)
    sk.store_client_portfolios(spark, clients, portfolio("2", ("x", 1.0)), buckets=2)
    sk.store_client_portfolios(spark, clients, portfolio("1", ("z", 1.0)), buckets=2)
    assert {(r.client_id, r.cusip) for r in spark.read.parquet(clients).collect()} == {("1", "z"), ("2", "x")}


def test_runs_and_datasets(spark, tmp_path):
    rows = spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, x int")
    run = {"run_id": "r", "prediction_count": 2}
    assert sk.store_run_once(spark, str(tmp_path), run, rows) and not sk.store_run_once(spark, str(tmp_path), run, rows)
    with pytest.raises(sk.RunConflict):
        sk.store_run_once(spark, str(tmp_path), run, rows.withColumn("x", F.col("x") + 1))
    with pytest.raises(ValueError):
        sk.store_run_once(spark, str(tmp_path), {**run, "prediction_count": 3}, rows)
    first = sk.publish_dataset(spark, str(tmp_path), {"sources": ["a"]}, {"t": rows})
    assert first == sk.publish_dataset(spark, str(tmp_path), {"sources": ["a"]}, {"t": rows.limit(0)})
    assert sk.verify_dataset(spark, first)["outputs"]["t"]["rows"] == 2
    spark.createDataFrame([("r", 5)], "run_id string, x int").write.mode("overwrite").parquet(f"{first}/t")
    with pytest.raises(ValueError):
        sk.verify_dataset(spark, first)


def test_portfolio_and_label_checks(spark):
    schema = "client_id string, client_name string, strategy string, cusip string, weight double"
    bad = spark.createDataFrame([("1", "n", "s", "a", 0.6), ("1", "n", "s", "a", 0.6), ("2", "n", " ", None, None), ("3", "n", "s", "a", 1.0)], schema)
    assert {r.client_id: r.problems for r in validation.portfolio_problems(bad).collect()} == {
        "1": ["CUSIP listed twice", "weights do not sum to 1"], "2": ["strategy is blank", "no holdings"]}


def test_scores_and_sectors(spark):
    assert [r[0] for r in spark.createDataFrame([("Apple Inc",), ("JOHNSON & JOHNSON",), ("DUKE ENERGY",), ("ZZZ",)], "n string").select(infer_sector("n")).collect()] == [
        "Technology", "Healthcare", "Energy", "Unknown"]
    features = spark.range(1).select(
        *[F.lit(True).alias(c) for c in ("entered_top10", "entered_top20", "is_new_position")],
        *[F.lit(False).alias(c) for c in ("exited_top10", "exited_top20", "is_exited_position")],
        F.lit(0.05).alias("abs_weight_delta"), F.lit(600_000).cast("long").alias("abs_value_delta_thousands"), F.lit(None).cast("double").alias("value_pct_change"),
        F.lit(0.25).alias("turnover_ratio"), F.lit(0.2).alias("change_share_of_turnover"))
    row = ch.score_changes(features).first()
    assert row.score == 30 + 12 + 20 + 10 + 8 + 8 and row.severity == "urgent" and len(row.reasons) == 6


def test_precedents_match_brute_force(spark):
    import math
    import random
    rng = random.Random(5)
    def change(i, kind):
        return (f"acc{i:03d}", "prev", f"k{i}", "issuer", "c", rng.choice(["T", "E"]), rng.random() ** 3, int(rng.random() * 3e6) - 1_500_000, rng.random(), rng.random() / 5,
                kind == 0, kind == 1, rng.randrange(100), 0)
    schema = ("current_accession_number string, previous_accession_number string, holding_key string, issuer_name string, cusip string, sector string, abs_weight_delta double,"
              " value_delta_thousands long, turnover_ratio double, change_share_of_turnover double, is_new_position boolean, is_exited_position boolean, rule_score int, weak_label int")
    past = [change(i, rng.randrange(3)) for i in range(400)]
    history = spark.createDataFrame(past, schema)
    alerts = history.filter("current_accession_number < 'acc040'").withColumn("alert_id", F.col("current_accession_number"))
    def shape(c):
        return (c[6], abs(c[7]) / 1e6, c[8], c[9], float(c[10]), float(c[11]))
    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    got = {(r.alert_id, r.place): r.p_accession for r in cl.precedents(alerts, history).collect()}
    for a in past[:40]:
        near = sorted((c for c in past if c[5] == a[5] and c[0] != a[0] and cosine(shape(a), shape(c)) >= .45), key=lambda c: (-cosine(shape(a), shape(c)), -c[12], -abs(c[7])))
        assert [got.get((a[0], i + 1)) for i in range(3)] == [c[0] for c in near[:3]]


def test_client_store_keeps_its_partitions(spark, tmp_path):
    def rows(*clients):
        return spark.createDataFrame([(c, "x", .5) for c in clients], "client_id string, cusip string, weight double")

    path = str(tmp_path / "store")
    sk.store_client_portfolios(spark, path, rows("1", "2"), buckets=3)
    sk.store_client_portfolios(spark, path, rows("1", "3"))  # keeps three, or client 1 would be stored twice
    stored = spark.read.parquet(path).collect()
    assert sorted(r.client_id for r in stored) == ["1", "2", "3"] and {r.client_buckets for r in stored} == {3}
    fresh = str(tmp_path / "fresh")
    sk.store_client_portfolios(spark, fresh, rows("1"))
    assert spark.read.parquet(fresh).first().client_buckets == 1


def test_holdings_by_quarter(spark, tmp_path):
    """All rows come back, and a filter on the quarter is one on folders."""
    path = str(tmp_path / "holdings")
    rows = spark.range(1000).selectExpr("cast(id as string) cik", "cast(2020 + id % 2 as int) report_year", "cast(1 + id % 4 as int) report_quarter", "id value_usd")
    sk.write_holdings(rows, path)
    assert spark.read.parquet(path).exceptAll(rows.select("cik", "value_usd", "report_year", "report_quarter")).count() == 0
    assert spark.read.parquet(path).count() == 1000
    one = spark.read.parquet(path).filter("report_year = 2021 and report_quarter = 2")
    assert one.count() == 250
    assert "PartitionFilters: [isnotnull(report_year" in one._jdf.queryExecution().toString()
