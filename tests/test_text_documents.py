"""Sources as column operators, package files by header names, and plain writers."""

import json
from datetime import date

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarterdeck.sinks import tables as sk
from quarterdeck.sources import bulk, documents as doc

ODD = [(1, None), (2, ""), (3, "junk <"), (4, "<other/>")]


def texts(spark, *rows, schema="id int, value string"):
    return spark.createDataFrame(list(rows), schema)


def test_lines_of_text_columns(spark):
    table = ('<n:informationTable xmlns:n="http://x"><n:infoTable><n:nameOfIssuer> A &amp; B </n:nameOfIssuer><n:value>12.0</n:value><n:putCall>call</n:putCall></n:infoTable>'
             '<n:infoTable/></n:informationTable>')
    rows = doc.information_table_lines(texts(spark, *ODD, (9, table))).collect()
    assert sorted((r.id, r.issuer_name, r.reported_value, r.put_call, r.other_manager, r.shares_or_principal) for r in rows) == [
        (9, "", 0, "", None, 0.0), (9, "A & B", 12, "CALL", None, 0.0)]
    assert doc.information_table_lines(texts(spark, schema="id int, value string")).count() == 0


def test_cover_pages_of_text_columns(spark):
    page = '<a><headerData><submissionType>13F-HR/A</submissionType></headerData><formData><coverPage><reportCalendarOrQuarter>13-31-2024</reportCalendarOrQuarter></coverPage></formData></a>'
    rows = {r.id: r for r in doc.cover_pages(texts(spark, *ODD, (9, page))).collect()}
    assert set(rows) == {1, 2, 3, 4, 9} and {(rows[i].cik, rows[i].form_type, rows[i].report_period, rows[i].filer_name) for i in (1, 2, 3, 4)} == {("", "13F-HR", None, None)}
    assert (rows[9].form_type, rows[9].report_period) == ("13F-HR/A", None)


def test_equal_sizes_and_odd_indexes(spark):
    def index(*items):
        return json.dumps({"directory": {"item": [{"name": n, "size": s} for n, s in items]}})
    names = texts(spark, ("tie", "p.xml", index(("a.xml", "5"), ("b.xml", "5"))), ("sizes", "p.xml", index(("a.xml", "x"), ("b.xml", None), ("c.XML", "1"))),
                  ("itself", None, index(("a.txt", "5"))), ("none", "p.xml", None), ("junk", "p.xml", "{"), ("empty", "p.xml", index()),
                  schema="accession_number string, primary_document string, value string")
    assert {r.accession_number: r.information_table for r in doc.information_table_names(names).collect()} == {
        "tie": "a.xml", "sizes": "c.XML", "itself": None, "none": None, "junk": None, "empty": None}


def test_lists_of_text_columns(spark):
    lists = texts(spark, (2, "Issuer\tCUSIP\nLATER\t037833100\n\t222222222\nOTHER\t333333333"), (1, 'note\r\nCUSIP No,Issuer,Status\r\n037833-10 0,"A, INC",NEW\r\n037833100,AGAIN,\r\n'), (3, None), (4, " "))
    assert {(r.cusip, r.issuer_name, r.class_title, r.status) for r in doc.securities_of_lists(lists, "id").collect()} == {
        ("037833100", "A, INC", None, "NEW"), ("333333333", "OTHER", None, None)}
    assert doc.securities_of_lists(lists.filter("id > 2"), "id").count() == 0
    with pytest.raises(ValueError):
        doc.securities_of_lists(texts(spark, (1, "no header\n1,2")), "id")


def test_package_rows(spark):
    tables = texts(spark, (1, "﻿A\tB\r\n1\t2\r\n\r\n3\r\n"), (2, "b\tx\ta\n5\t6\t\"7\n"), (3, None), (4, ""), (5, "A\tB"))
    assert sorted(bulk.package_rows(tables, ["A", "B", "C"]).collect(), key=str) == [(1, "1", "2", None), (1, "3", None, None), (2, '"7', "5", None)]


def test_package_files_with_other_column_orders(spark, tmp_path):
    for label, text in (("2020q1", "A\tB\n1\t2\n"), ("2020q2", "﻿b\ta\tC\n3\t4\t5\n"), ("2020q3", "A\tB\n6\t7\n"), ("2020q4", "")):
        (tmp_path / f"package={label}").mkdir()
        (tmp_path / f"package={label}" / "INFOTABLE.tsv").write_text(text)
    rows = bulk.read_package_table(spark, str(tmp_path), "INFOTABLE").select("PACKAGE", "A", "B", "C").collect()
    assert sorted(map(tuple, rows)) == [("2020q1", "1", "2", None), ("2020q2", "4", "3", "5"), ("2020q3", "6", "7", None)]


LINE = '0000000001,2020-03-31,k,5,1.5,0.25,1,2020-05-01,"[""b"",""a""]"'


def test_reference_holdings(spark, tmp_path):
    (tmp_path / "h.csv").write_text(doc.RECONCILED_SCHEMA.replace(" string", "").replace(" date", "") + "\n" + LINE + "\n")
    want = ("0000000001", date(2020, 3, 31), "k", 5, 1.5, 0.25, 1, date(2020, 5, 1), ["a", "b"])
    assert [tuple(r) for r in doc.read_reference_holdings(spark, str(tmp_path / "h.csv")).collect()] == [want]
    assert [tuple(r) for r in doc.reference_holdings(texts(spark, (1, LINE), (2, None))).collect()] == [want]
    bad = LINE.replace(",5,", ",five,")
    with pytest.raises((PySparkException, Py4JJavaError)):
        doc.reference_holdings(texts(spark, (1, bad))).collect()
    (tmp_path / "bad.csv").write_text("header\n" + bad + "\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        doc.read_reference_holdings(spark, str(tmp_path / "bad.csv")).collect()


def test_holdings_by_quarter_and_ordered_inventory(spark, tmp_path):
    rows = spark.range(40).select("id", (2020 + F.col("id") % 2).alias("report_year"), (1 + F.col("id") % 4).alias("report_quarter"))
    sk.write_holdings(rows, str(tmp_path / "h"))
    assert {p.name for p in (tmp_path / "h").iterdir() if p.is_dir()} == {"report_year=2020", "report_year=2021"}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "h")).select("id", "report_year", "report_quarter").collect()} == {tuple(r) for r in rows.collect()}
    sk.write_ordered_json(rows, ["report_quarter", "id"], str(tmp_path / "j"))
    lines = [json.loads(line) for file in sorted((tmp_path / "j").glob("part-*")) for line in file.read_text().splitlines()]
    assert [(x["report_quarter"], x["id"]) for x in lines] == sorted((r.report_quarter, r.id) for r in rows.collect())
