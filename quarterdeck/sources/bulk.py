"""Quarterly bulk packages: tab-separated SUBMISSION, COVERPAGE, INFOTABLE, SUMMARYPAGE tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.keys import AMENDED_FORM, HOLDINGS_FORMS
from ..functions.measures import UNIT_CHANGE_DATE, to_dollars
from ..functions.text import (
    is_valid_cusip,
    normalize_cik,
    normalize_cusip,
    parse_filing_date,
    parse_number,
    strip,
    stripped_upper,
    truthy,
)

# Table names of a package.
TABLES = ("SUBMISSION", "COVERPAGE", "INFOTABLE", "SUMMARYPAGE")


def read_package_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All packages under ``root/package=<label>/<table>.tsv`` as text columns plus ``PACKAGE``.

    Columns are matched by the names in each file's header, whatever their order; one that a package
    lacks is null there. The headers (a line of each package) are read first, and packages with the
    same header are scanned together.
    """
    if table not in TABLES:
        raise ValueError(f"unknown table {table!r}")
    found = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/package=*/{table}.tsv").select("path", "length")
    paths = [row["path"] for row in found.filter("length > 0").orderBy("path").collect()]  # one file a package
    if not paths:
        raise ValueError(f"no package holds {table}")
    alike: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        alike.setdefault(tuple(_header(spark.read.text(path).first()[0])), []).append(path)

    def scan(header: tuple[str, ...], files: list[str]) -> DataFrame:
        raw = (
            spark.read.option("header", True).option("sep", "\t").option("quote", "\u0000").option("mode", "PERMISSIVE")
            .schema(", ".join(f"`{c}` string" for c in header)).csv(files)
        )
        return raw.withColumn("PACKAGE", F.regexp_extract(F.col("_metadata.file_path"), "package=([^/]+)", 1))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [scan(h, files) for h, files in alike.items()])


def package_rows(documents: DataFrame, columns: Sequence[str], text: str = "value") -> DataFrame:
    """Rows of package tables in a text column: these columns as text, by the names in each table's header, beside the other columns.

    Nothing is quoted; a leading byte-order mark and carriage returns are dropped. A column or cell that a
    table lacks is null. Tables that are null, empty or hold only a header give no row, and neither do blank lines.
    """
    kept = [c for c in documents.columns if c != text]
    lines = F.split(F.regexp_replace(F.col(text), "^\ufeff|\r", ""), "\n")
    titles = F.transform(F.split(F.get("lines", F.lit(0)), "\t"), lambda c: F.upper(strip(c)))
    places = [F.array_position("titles", c).cast("int").alias(c) for c in columns]
    cut = documents.filter(F.col(text).isNotNull()).select(*kept, lines.alias("lines")).withColumn("titles", titles)
    rows = cut.select(*kept, F.struct(*places).alias("at"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("line"))
    cells = rows.filter(F.col("line") != "").select(*kept, "at", F.split("line", "\t").alias("cells"))
    return cells.select(*kept, *[F.when(F.col("at")[c] > 0, F.get("cells", F.col("at")[c] - 1)).alias(c) for c in columns])


def _header(line: str) -> list[str]:
    return [c.lstrip("\ufeff").strip().upper() for c in line.split("\t")]


def parse_submissions(submission: DataFrame, coverpage: DataFrame) -> DataFrame:
    """Typed filings with ``reason`` set on rows that cannot be used."""
    text = submission.select(
        strip("ACCESSION_NUMBER").alias("accession_number"),
        strip("FILING_DATE").alias("filed"),
        stripped_upper("SUBMISSIONTYPE").alias("submission_type"),
        strip("CIK").alias("raw_cik"),
        strip("PERIODOFREPORT").alias("period"),
        _optional(submission, "PACKAGE").alias("package"),
    ).filter(F.col("submission_type").isin(*HOLDINGS_FORMS))
    typed = text.withColumns({
        "filing_date": parse_filing_date("filed"), "report_period": parse_filing_date("period"),
        "cik": normalize_cik("raw_cik"),
    })
    filings = typed.withColumn("reason", _first_reason(
        (F.col("accession_number") == "", "missing ACCESSION_NUMBER"),
        (F.col("filed") == "", "missing FILING_DATE"),
        (F.col("filing_date").isNull(), "bad FILING_DATE"),
        (F.col("raw_cik") == "", "missing CIK"),
        (F.col("cik").isNull(), "bad CIK"),
        (F.col("period") == "", "missing PERIODOFREPORT"),
        (F.col("report_period").isNull(), "bad PERIODOFREPORT"),
    ))
    number = parse_number("AMENDMENTNO", "int")
    covers = coverpage.select(
        strip("ACCESSION_NUMBER").alias("accession_number"),
        strip("FILINGMANAGER_NAME").alias("filer_name"),
        truthy("ISAMENDMENT").alias("cover_amendment"),
        number.alias("amendment_number"),
        stripped_upper("AMENDMENTTYPE").alias("amendment_type"),
        ((strip("AMENDMENTNO") != "") & number.isNull()).alias("bad_number"),
    )
    return filings.join(covers, "accession_number", "left").select(
        "accession_number", "filing_date", "submission_type", "cik", "report_period",
        F.coalesce("filer_name", F.lit("")).alias("filer_name"),
        ((F.col("submission_type") == AMENDED_FORM) | F.coalesce("cover_amendment", F.lit(False))).alias("is_amendment"),
        "amendment_number",
        F.coalesce("amendment_type", F.lit("")).alias("amendment_type"),
        "package",
        F.coalesce("reason", F.when(F.col("bad_number"), "bad AMENDMENTNO")).alias("reason"),
    )


# Columns a holding line must fill, and its optional vote counts.
REQUIRED_TEXT = {
    "INFOTABLE_SK": "info_table_key", "NAMEOFISSUER": "issuer_name", "TITLEOFCLASS": "title_of_class",
    "SSHPRNAMTTYPE": "share_type", "INVESTMENTDISCRETION": "investment_discretion",
}
VOTES = ("VOTING_AUTH_SOLE", "VOTING_AUTH_SHARED", "VOTING_AUTH_NONE")


def parse_holdings(infotable: DataFrame) -> DataFrame:
    """Typed holding lines, in reported value units, with ``reason`` on unusable rows."""
    votes = {v: v.lower().replace("auth", "authority") for v in VOTES}
    present = [v for v in VOTES if v in infotable.columns]
    text = infotable.select(
        strip("ACCESSION_NUMBER").alias("accession_number"),
        *[strip(raw).alias(name) for raw, name in REQUIRED_TEXT.items() if raw not in ("SSHPRNAMTTYPE", "INVESTMENTDISCRETION")],
        stripped_upper("SSHPRNAMTTYPE").alias("share_type"),
        stripped_upper("INVESTMENTDISCRETION").alias("investment_discretion"),
        strip("CUSIP").alias("raw_cusip"), strip("VALUE").alias("raw_value"), strip("SSHPRNAMT").alias("raw_shares"),
        F.upper(strip(_optional(infotable, "FIGI"))).alias("figi"),
        stripped_upper("PUTCALL").alias("put_call"),
        strip("OTHERMANAGER").alias("other_manager"),
        *[strip(v).alias(f"raw_{v}") for v in present],
    )
    typed = text.withColumns({
        "cusip": normalize_cusip("raw_cusip"), "reported_value": parse_number("raw_value", "long"),
        "shares_or_principal": parse_number("raw_shares", "double"),
        **{votes[v]: parse_number(f"raw_{v}", "long") for v in present},
    })
    reason = _first_reason(
        (F.col("raw_value") == "", "missing VALUE"),
        (F.col("reported_value").isNull(), "bad VALUE"),
        *[(F.col(n) == "", f"missing {raw}") for raw, n in list(REQUIRED_TEXT.items())[:3]],
        (F.col("raw_cusip") == "", "missing CUSIP"),
        (~is_valid_cusip("cusip"), "bad CUSIP"),
        (F.col("raw_shares") == "", "missing SSHPRNAMT"),
        (F.col("shares_or_principal").isNull(), "bad SSHPRNAMT"),
        *[(F.col(n) == "", f"missing {raw}") for raw, n in list(REQUIRED_TEXT.items())[3:]],
        *[((F.col(f"raw_{v}") != "") & F.col(votes[v]).isNull(), f"bad {v}") for v in present],
        ((F.col("reported_value") < 0) | (F.col("shares_or_principal") < 0), "negative VALUE or SSHPRNAMT"),
    )
    none = F.lit(0).cast("long")
    return typed.select(
        "accession_number", "info_table_key", "issuer_name", "title_of_class", "cusip", "figi", "reported_value",
        "shares_or_principal", "share_type", "put_call", "investment_discretion", "other_manager",
        *[(F.coalesce(F.col(n), none) if v in present else none).alias(n) for v, n in votes.items()],
        reason.alias("reason"),
    )


def value_in_dollars(holdings_with_date: DataFrame, cutover: str = UNIT_CHANGE_DATE) -> DataFrame:
    return holdings_with_date.withColumn("value_usd", to_dollars("reported_value", "filing_date", cutover))


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _first_reason(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(condition, reason) for condition, reason in checks])
