"""The given tables written as filing documents in text columns: XML tables and cover pages, JSON feeds and indexes, lists, TSV packages.

A document holds one filing, the lines of one order, one manager's filings or a hundred securities,
so none grows with the tables. Some rows get faults that the readers must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import driver_tables as given

# Fixed values of the mapping; the SQL twins use the same ones.
SECURITIES_PER_LIST = 100
FAULT_CYCLE = 89
#: remainder of a line's key, the column that is spoilt and its text
FAULTS = (
    (1, "VALUE", ""), (2, "VALUE", "abc"), (3, "INFOTABLE_SK", ""), (4, "NAMEOFISSUER", ""), (5, "TITLEOFCLASS", ""), (6, "CUSIP", ""), (7, "CUSIP", "1"),
    (8, "SSHPRNAMT", ""), (9, "SSHPRNAMT", "x"), (10, "SSHPRNAMTTYPE", ""), (11, "INVESTMENTDISCRETION", ""), (12, "VALUE", "-5"), (13, "VOTING_AUTH_SOLE", "many"),
)
PACKAGE_COLUMNS = (
    "ACCESSION_NUMBER", "INFOTABLE_SK", "NAMEOFISSUER", "TITLEOFCLASS", "CUSIP", "VALUE", "SSHPRNAMT", "SSHPRNAMTTYPE", "PUTCALL", "INVESTMENTDISCRETION", "VOTING_AUTH_SOLE",
)


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _tag(prefix: Column, name: str, content: Column) -> Column:
    """The tag, or nothing when its content is null."""
    whole = F.concat(F.lit("<"), prefix, F.lit(f"{name}>"), content, F.lit("</"), prefix, F.lit(f"{name}>"))
    return F.coalesce(whole, F.lit(""))


def _in_order(place: Column, text: Column) -> Column:
    """Texts of a group, by place."""
    return F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), text.alias("text")))), lambda x: x["text"])


def _order_lines(spark: SparkSession, source: str) -> DataFrame:
    key = F.col("INFOTABLE_SK").cast("long")
    return given.infotable(spark, source).withColumns({"key": key, "order": F.expr("CAST(INFOTABLE_SK AS BIGINT) DIV 10")})


def information_tables(spark: SparkSession, source: str) -> DataFrame:
    """document_id, value: an XML table with the lines of an order; tags of odd orders have a prefix, even lines no votes."""
    lines = _order_lines(spark, source)
    odd = F.col("order") % 2 == 1
    prefix = F.when(odd, "ns1:").otherwise("")
    even = F.col("key") % 2 == 0

    def tag(name: str, content: Column) -> Column:
        return _tag(prefix, name, content)

    line = tag("infoTable", F.concat(
        tag("nameOfIssuer", _escaped(F.col("NAMEOFISSUER"))), tag("titleOfClass", F.col("TITLEOFCLASS")), tag("cusip", F.col("CUSIP")),
        tag("value", F.when(even, F.concat("VALUE", F.lit(".0"))).otherwise(F.col("VALUE"))),
        tag("shrsOrPrnAmt", F.concat(tag("sshPrnamt", F.col("SSHPRNAMT")), tag("sshPrnamtType", F.col("SSHPRNAMTTYPE")))),
        tag("putCall", F.when(F.col("PUTCALL") != "", F.col("PUTCALL"))), tag("investmentDiscretion", F.col("INVESTMENTDISCRETION")),
        tag("votingAuthority", F.when(~even, tag("Sole", F.col("SSHPRNAMT")))),
    ))
    name = F.when(odd, "xmlns:ns1").otherwise("xmlns")
    texts = lines.groupBy("order").agg(F.array_join(_in_order(F.col("key"), line), "\n").alias("lines"))
    return texts.select(F.col("order").cast("string").alias("document_id"), F.concat(
        F.lit("<"), prefix, F.lit("informationTable "), name, F.lit('="http://example.org/table">'), "lines", F.lit("</"), prefix, F.lit("informationTable>")).alias("value"))


def filings(spark: SparkSession, source: str) -> DataFrame:
    covers = given.coverpage(spark, source).select("ACCESSION_NUMBER", "FILINGMANAGER_NAME")
    joined = given.submission(spark, source).join(covers, "ACCESSION_NUMBER")
    return joined.withColumns({"manager": F.col("CIK").cast("long"), "period": F.col("PERIODOFREPORT").cast("date")})


def cover_pages(spark: SparkSession, source: str) -> DataFrame:
    """accession_number, value: a primary document for each filing; originals leave the form out."""
    prefix = F.when(F.col("manager") % 2 == 1, "e:").otherwise("")

    def tag(name: str, *content: Column) -> Column:
        return _tag(prefix, name, F.concat(*content))

    header = tag("headerData", tag("submissionType", F.when(F.col("SUBMISSIONTYPE") != "13F-HR", F.col("SUBMISSIONTYPE"))),
                 tag("filerInfo", tag("filer", tag("credentials", tag("cik", F.col("CIK"))))))
    form = tag("formData", tag("coverPage", tag("reportCalendarOrQuarter", F.date_format("period", "MM-dd-yyyy")),
                               tag("filingManager", tag("name", _escaped(F.col("FILINGMANAGER_NAME"))))))
    name = F.when(F.col("manager") % 2 == 1, "xmlns:e").otherwise("xmlns")
    return filings(spark, source).select(F.col("ACCESSION_NUMBER").alias("accession_number"), F.concat(
        F.lit("<"), prefix, F.lit("edgarSubmission "), name, F.lit('="http://example.org/filer">'), header, form, F.lit("</"), prefix, F.lit("edgarSubmission>")).alias("value"))


def submission_feeds(spark: SparkSession, source: str) -> DataFrame:
    """value: a JSON feed for each manager, with an annual report beside every filing and no report date in third quarters."""
    rows = filings(spark, source).withColumn("form", F.explode(F.array(F.col("SUBMISSIONTYPE"), F.lit("10-K"))))
    told = F.struct(
        F.col("FILING_DATE").alias("filingDate"), F.col("ACCESSION_NUMBER").alias("accessionNumber"), "form",
        F.when(F.quarter("period") == 3, "").otherwise(F.col("PERIODOFREPORT")).alias("reportDate"),
        F.lit("x/primary_doc.xml").alias("primaryDocument"), F.lit("").alias("primaryDocDescription"))
    grouped = rows.groupBy("manager").agg(F.sort_array(F.collect_list(told)).alias("told"))
    recent = F.struct(*[F.col(f"told.{c}").alias(c) for c in (
        "form", "accessionNumber", "filingDate", "reportDate", "primaryDocument", "primaryDocDescription")])
    return grouped.select(F.to_json(F.struct(F.col("manager").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))).alias("value"))


def filing_indexes(spark: SparkSession, source: str) -> DataFrame:
    """accession_number, primary_document, value: four kinds of filing folders, with equal and missing sizes."""
    kind = (F.col("manager") + F.month("period")) % 4

    def item(name: str, size: Column | str) -> Column:
        return F.struct(F.lit(name).alias("name"), (F.lit(size) if isinstance(size, str) else size).alias("size"))

    sized = ((F.col("manager") % 3) * 100).cast("string")
    items = (
        F.when(kind == 0, F.array(item("primary_doc.xml", "99999"), item("infotable.xml", sized), item("Other.XML", "100")))
        .when(kind == 1, F.array(item("notes.txt", "7"), item("Form13F.xml", "5")))
        .when(kind == 2, F.array(item("p.htm", "5")))
        .otherwise(F.array(item("A.xml", ""), item("B.xml", "0")))
    )
    primary = F.when(kind == 0, "x/primary_doc.xml").when(kind == 1, "x/form13f.xml").when(kind == 2, "p.htm").otherwise("primary_doc.xml")
    index = F.struct(F.struct(items.alias("item")).alias("directory"))
    return filings(spark, source).select(F.col("ACCESSION_NUMBER").alias("accession_number"), primary.alias("primary_document"), F.to_json(index).alias("value"))


def securities_lists(spark: SparkSession, source: str) -> DataFrame:
    """list_id, value: CSV lists with a line above their header, and TSV lists; some securities have no issuer."""
    parts = given.table(spark, source, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    parts = parts.withColumn("list_id", F.expr(f"p_partkey DIV {SECURITIES_PER_LIST}"))
    name = F.when(F.col("p_partkey") % 17 == 0, "").otherwise(F.col("p_name"))
    comma = F.concat(given.part_cusip(), F.lit(',"'), F.when(name == "", "").otherwise(F.concat(name, F.lit(", INC"))), F.lit('",COM,'), F.when(F.col("p_partkey") % 5 == 0, "NEW").otherwise(""))
    tab = F.concat_ws("\t", name, given.part_cusip(), F.lit("COM"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")))
    even = F.col("list_id") % 2 == 0
    texts = parts.groupBy("list_id").agg(F.array_join(_in_order(F.col("p_partkey"), F.when(even, comma).otherwise(tab)), "\n").alias("lines"))
    head = F.when(even, "Official list,,,\r\nCUSIP No,Issuer Description,Class,Status\r\n").otherwise("Issuer\tCUSIP\tTitle of Class\tTicker\n")
    return texts.select("list_id", F.concat(head, "lines").alias("value"))


def package_tables(spark: SparkSession, source: str) -> DataFrame:
    """value: holding tables (TSV) with the lines of an order; the columns of odd orders come in reverse, and ``FAULTS`` spoil some lines."""
    lines = _order_lines(spark, source).withColumn("VOTING_AUTH_SOLE", F.lit("1"))
    for rest, column, text in FAULTS:
        lines = lines.withColumn(column, F.when(F.col("key") % FAULT_CYCLE == rest, text).otherwise(F.col(column)))
    names, odd = list(PACKAGE_COLUMNS), F.col("order") % 2 == 1
    line = F.when(odd, F.concat_ws("\t", *names[::-1])).otherwise(F.concat_ws("\t", *names))
    texts = lines.groupBy("order").agg(F.array_join(_in_order(F.col("key"), line), "\n").alias("lines"))
    head = F.when(odd, "\t".join(names[::-1]).lower()).otherwise("﻿" + "\t".join(names))
    return texts.select(F.concat(head, F.lit("\n"), "lines", F.lit("\r\n")).alias("value"))
