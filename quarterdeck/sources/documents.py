"""Readers for per-filing documents: XML tables, submission feeds, filing indexes, securities lists."""

from __future__ import annotations

import csv
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.keys import HOLDINGS_FORMS, ORIGINAL_FORM
from ..functions.text import blank_to_null, normalize_cik, normalize_list_cusip, parse_int_via_float, parse_number, strip

# Tags of the information table and the cover page.
_TEXT = T.StringType()
LINE_SCHEMA = T.StructType([
    *[T.StructField(n, _TEXT) for n in ("nameOfIssuer", "titleOfClass", "cusip", "value")],
    T.StructField("shrsOrPrnAmt", T.StructType([T.StructField(n, _TEXT) for n in ("sshPrnamt", "sshPrnamtType")])),
    *[T.StructField(n, _TEXT) for n in ("putCall", "investmentDiscretion", "otherManager")],
    T.StructField("votingAuthority", T.StructType([T.StructField(n, _TEXT) for n in ("Sole", "Shared", "None")])),
])
COVER_PATHS = {
    "cik": ("headerData", "filerInfo", "filer", "credentials", "cik"), "form_type": ("headerData", "submissionType"),
    "report_period": ("formData", "coverPage", "reportCalendarOrQuarter"), "filer_name": ("formData", "coverPage", "filingManager", "name"),
}
# Keys of the submission feed and the filing index, header words of securities lists.
FEED_SCHEMA = (
    "cik string, filings struct<recent: struct<form: array<string>, accessionNumber: array<string>, filingDate: array<string>,"
    " reportDate: array<string>, primaryDocument: array<string>, primaryDocDescription: array<string>>>"
)
INDEX_SCHEMA = "directory struct<item: array<struct<name: string, size: string>>>"
LIST_HEADERS = {
    "cusip": ("cusip",), "issuer_name": ("issuer description", "issuer", "name of issuer"), "class_title": ("class", "title of class"),
    "ticker": ("ticker", "symbol"), "status": ("status",),
}


def read_information_tables(spark: SparkSession, path: str) -> DataFrame:
    """Holding lines of information-table XML files, prefixed tags included; absent tags are ''/0."""
    raw = (
        spark.read.format("xml").option("rowTag", "infoTable").option("ignoreNamespace", True).schema(LINE_SCHEMA).load(path)
        .withColumn("file_path", F.col("_metadata.file_path"))
    )
    return raw.select("file_path", *_line_columns())


def information_table_lines(documents: DataFrame, text: str = "value") -> DataFrame:
    """Holding lines of XML documents in a text column, each parsed once, beside the other columns.

    Prefixed tags are read as well. A document that is null, empty, without lines or no XML gives no row.
    """
    parsed = F.from_xml(F.col(text), f"infoTable array<{LINE_SCHEMA.simpleString()}>", {"ignoreNamespace": "true"})
    kept = [F.col(c) for c in documents.columns if c != text]
    whole = documents.select(F.struct(*kept).alias("kept"), F.explode(parsed["infoTable"]).alias("line"))
    return whole.select(*[F.col("kept")[c].alias(c) for c in documents.columns if c != text], *_line_columns("line."))


def _line_columns(at: str = "") -> list[Column]:
    """The typed columns of a holding line whose tags are at ``at``."""
    def number(c: str) -> Column:
        return F.coalesce(parse_int_via_float(at + c), F.lit(0).cast("long"))

    return [
        strip(at + "nameOfIssuer").alias("issuer_name"), strip(at + "titleOfClass").alias("title_of_class"), strip(at + "cusip").alias("cusip"),
        number("value").alias("reported_value"),
        F.coalesce(parse_number(at + "shrsOrPrnAmt.sshPrnamt", "double"), F.lit(0.0)).alias("shares_or_principal"),
        strip(at + "shrsOrPrnAmt.sshPrnamtType").alias("share_type"), F.upper(strip(at + "putCall")).alias("put_call"),
        strip(at + "investmentDiscretion").alias("investment_discretion"), blank_to_null(at + "otherManager").alias("other_manager"),
        *[number(f"votingAuthority.{n}").alias(f"voting_authority_{n.lower()}") for n in ("Sole", "Shared", "None")],
    ]


def read_cover_pages(spark: SparkSession, path: str) -> DataFrame:
    """Manager, form, quarter and name of primary documents, whatever their namespaces."""
    return cover_pages(spark.read.text(path, wholetext=True).withColumn("file_path", F.col("_metadata.file_path")))


def cover_pages(documents: DataFrame, text: str = "value") -> DataFrame:
    """Manager, form, quarter and name of primary documents in a text column, one row each; one parse a document.

    Absent tags are '' (the name and a quarter that is no date: null); the form defaults to the original one.
    """
    parsed = F.from_xml(F.col(text), _nested(list(COVER_PATHS.values())), {"ignoreNamespace": "true"})
    kept = [c for c in documents.columns if c != text]
    found = documents.select(*kept, parsed.alias("page"))
    at = {name: strip("page." + ".".join(path)) for name, path in COVER_PATHS.items()}
    return found.select(
        *kept, at["cik"].alias("cik"), F.when(at["form_type"] == "", ORIGINAL_FORM).otherwise(at["form_type"]).alias("form_type"),
        F.try_to_date(at["report_period"], "MM-dd-yyyy").alias("report_period"), blank_to_null(at["filer_name"]).alias("filer_name"),
    )


def _nested(paths: list[tuple[str, ...]], top: bool = True) -> str:
    """Schema of nested text tags at these paths."""
    heads = dict.fromkeys(p[0] for p in paths)
    tails = {h: [p[1:] for p in paths if p[0] == h and len(p) > 1] for h in heads}
    fields = ", ".join(f"{h}{' ' if top else ': '}" + (f"struct<{_nested(tails[h], False)}>" if tails[h] else "string") for h in heads)
    return fields


def recent_filings(feeds: DataFrame, forms: tuple[str, ...] = HOLDINGS_FORMS) -> DataFrame:
    """Filings of submission feeds (JSON text in ``value``): parallel arrays become rows."""
    parsed = feeds.select(F.from_json("value", FEED_SCHEMA).alias("feed"))
    recent = [F.col(f"feed.filings.recent.{c}") for c in (
        "form", "accessionNumber", "filingDate", "reportDate", "primaryDocument", "primaryDocDescription")]
    rows = parsed.select(normalize_cik("feed.cik").alias("cik"), F.explode(F.arrays_zip(*recent)).alias("f"))
    rows = rows.select("cik", "f.*").toDF("cik", "form_type", "accession_number", "filing_date", "report_period", "primary_document", "primary_doc_description")
    return rows.filter(F.col("form_type").isin(*forms)).withColumns({
        c: F.try_to_date(c, "yyyy-MM-dd") for c in ("filing_date", "report_period")
    })


def information_table_names(indexes: DataFrame) -> DataFrame:
    """Information table of each filing: largest other XML file (the first of equal ones), else the primary document itself.

    ``indexes`` has accession_number, primary_document and the index JSON in ``value``; each row is decided by itself.
    """
    listed = indexes.select(
        "accession_number", F.lower(F.element_at(F.split("primary_document", "/"), -1)).alias("primary"),
        F.from_json("value", INDEX_SCHEMA).alias("index"))

    def name(item: Column) -> Column:
        return F.lower(F.coalesce(item["name"], F.lit("")))

    def size(item: Column) -> Column:
        return F.coalesce(item["size"].try_cast("long"), F.lit(0).cast("long"))

    primary, items = F.coalesce("primary", F.lit("")), F.col("index.directory.item")
    others = F.filter(items, lambda i: name(i).endswith(".xml") & (name(i) != primary) & ~name(i).contains("primary_doc"))
    placed = F.transform(others, lambda i, at: F.struct(size(i).alias("size"), (-at).alias("place"), i["name"].alias("name")))
    itself = F.get(F.filter(items, lambda i: primary.endswith(".xml") & (name(i) == primary)), F.lit(0))["name"]
    return listed.select("accession_number", F.coalesce(F.array_max(placed)["name"], itself).alias("information_table"))


def read_securities_list(spark: SparkSession, path: str) -> DataFrame:
    """Reference securities (CSV or TSV with optional preamble); the first row of a CUSIP wins.

    The header of each file is its first line with "cusip" in it; one aggregate finds them, and
    every line is then cut by the positions of its own file's header, in parallel. A file
    without a header is an error, as is a header without CUSIP and issuer columns.
    """
    lines = spark.read.text(path).withColumns({
        "file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "id": F.monotonically_increasing_id(),
    })
    spot = F.struct("block", "id")
    titled = F.lower("value").contains("cusip")
    headers = lines.groupBy("file").agg(
        F.min(F.when(titled, spot)).alias("spot"), F.min_by(F.when(titled, F.col("value")), F.when(titled, spot)).alias("header"))
    under = lines.join(headers.withColumnRenamed("file", "of_file"), F.col("file") == F.col("of_file")).filter(spot > F.col("spot"))
    # a row per different header, and most lists have one
    return _listed(under, [row["header"] for row in headers.select("header").distinct().collect()], ("file", "block", "id"))


def securities_of_lists(documents: DataFrame, order: str, text: str = "value") -> DataFrame:
    """Reference securities of lists in a text column; the first row of a CUSIP wins, by ``order`` of the lists and then by line.

    Header and lines of a list are found within its row. A list without a header is an error; null and empty ones give no row.
    """
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    cut = documents.filter(strip(text) != "").select(F.col(order).alias("list"), lines.alias("lines"))
    at = F.array_position(F.transform("lines", lambda line: F.lower(line).contains("cusip")), True)
    titled = cut.withColumn("at", at).withColumn("header", F.when(F.col("at") > 0, F.get("lines", (F.col("at") - 1).cast("int"))))
    kinds = [row["header"] for row in titled.select("header").distinct().collect()]  # most lists share a header
    if not kinds:
        kinds = ["cusip,issuer"]
    below = F.slice("lines", (F.col("at") + 1).cast("int"), F.size("lines"))
    return _listed(titled.select("list", "header", F.posexplode(below).alias("line", "value")), kinds, ("list", "line"))


def _listed(under: DataFrame, kinds: list, order: tuple[str, ...]) -> DataFrame:
    """Securities of list lines (``value``) below their ``header``, one of ``kinds``; the first by ``order`` wins."""
    if not kinds or None in kinds:
        raise ValueError("no header row with a CUSIP column")
    layouts = [_list_layout(kind) for kind in kinds]
    # a column for each kind of header, filled below that header only; Spark may parse a line again in the filter it pushes down
    parsed = under.select(*order, *[F.when(F.col("header") == kind, row).alias(f"kind{i}") for i, (kind, (row, _)) in enumerate(zip(kinds, layouts))])
    cells = [F.when(F.col(f"kind{i}").isNotNull(), cells(F.col(f"kind{i}"))) for i, (_, cells) in enumerate(layouts)]
    cut = parsed.select(*order, F.coalesce(*cells).alias("r"))

    def cell(column: str) -> Column:
        return F.col(f"r.{column}")

    rows = cut.select(
        *order, normalize_list_cusip(cell("cusip")).alias("cusip"), strip(cell("issuer_name")).alias("issuer_name"),
        *[blank_to_null(cell(c)).alias(c) for c in ("class_title", "ticker", "status")],
    ).filter((F.col("cusip") != "") & (F.col("issuer_name") != ""))
    first = rows.groupBy("cusip").agg(F.min_by(F.struct("issuer_name", "class_title", "ticker", "status"), F.struct(*order)).alias("s"))
    return first.select("cusip", "s.*")


def _list_layout(header: str) -> tuple[Column, Callable[[Column], Column]]:
    """The parsed line below this header, and what makes the list columns of it."""
    separator = "\t" if header.count("\t") >= max(1, header.count(",")) else ","
    names = next(csv.reader([header], delimiter=separator))
    tidy = [" ".join("".join(ch if ch.isalnum() else " " for ch in n.lower()).split()) for n in names]
    position = {
        column: next((i for word in words for i, n in enumerate(tidy) if word in n), None) for column, words in LIST_HEADERS.items()
    }
    if position["cusip"] is None or position["issuer_name"] is None:
        raise ValueError("CUSIP and issuer columns are needed")
    row = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))), {"sep": separator})
    return row, lambda line: F.struct(*[(F.lit(None).cast("string") if i is None else line[f"c{i}"]).alias(c) for c, i in position.items()])


def enrich_with_list(lines: DataFrame, securities: DataFrame, source_label: str = "official list") -> DataFrame:
    """Attach reference names by normalised CUSIP; unmatched lines keep what they had."""
    listed = securities.select(
        F.col("cusip").alias("list_cusip"), F.col("issuer_name").alias("list_issuer"), F.col("class_title").alias("list_class"), F.col("ticker").alias("list_ticker"))

    def prior(name: str) -> Column:
        return F.col(name) if name in lines.columns else F.lit(None).cast("string")

    joined = lines.join(listed, normalize_list_cusip("cusip") == F.col("list_cusip"), "left")
    hit = F.col("list_cusip").isNotNull()
    kept = [c for c in lines.columns if c not in ("official_issuer_name", "official_class_title", "ticker", "official_list_source")]
    return joined.select(
        *kept,
        F.when(hit, F.col("list_issuer")).otherwise(prior("official_issuer_name")).alias("official_issuer_name"),
        F.when(hit, F.col("list_class")).otherwise(prior("official_class_title")).alias("official_class_title"),
        F.coalesce("list_ticker", prior("ticker")).alias("ticker"), hit.alias("official_list_match"),
        F.when(hit, F.lit(source_label)).otherwise(prior("official_list_source")).alias("official_list_source"),
    )


def list_coverage(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.sum(F.col("official_list_match").cast("long")).alias("matched_holdings"), F.count(F.lit(1)).alias("total_holdings"))


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """Size and SHA-256 of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


RECONCILED_SCHEMA = (
    "cik string, report_period date, security_key string, value_usd bigint, shares_or_principal double, portfolio_weight double,"
    " holding_rank int, available_at date, source_accession_numbers string"
)


def read_reference_holdings(spark: SparkSession, path: str) -> DataFrame:
    """Typed holdings CSV with a JSON list column; a bad row fails the read."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").option("escape", '"').schema(RECONCILED_SCHEMA).csv(path)
    return _with_accession_lists(raw)


def reference_holdings(lines: DataFrame, text: str = "value") -> DataFrame:
    """The same rows from CSV lines in a text column, without a header; a bad line fails the query, a null one gives no row."""
    parsed = F.from_csv(F.col(text), RECONCILED_SCHEMA, {"mode": "FAILFAST", "escape": '"'})
    return _with_accession_lists(lines.filter(F.col(text).isNotNull()).select(parsed.alias("row")).select("row.*"))


def _with_accession_lists(raw: DataFrame) -> DataFrame:
    return raw.withColumn("source_accession_numbers", F.sort_array(F.from_json("source_accession_numbers", "array<string>")))
