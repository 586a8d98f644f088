"""Writers: partitioned tables, keyed replacement, insert-once runs, content-addressed datasets."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import save_stage


def write_holdings(df: DataFrame, path: str) -> None:
    """Holdings by report year and quarter. Spark splits large quarters and joins small ones by the bytes it measured, so files have even sizes."""
    spread = df.hint("rebalance", "report_year", "report_quarter")
    spread.write.mode("overwrite").partitionBy("report_year", "report_quarter").parquet(path)


def write_filings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_ordered_json(df: DataFrame, order: Sequence[str], path: str) -> None:
    """An inventory in order. Range-sorted files keep the order by file name without one writer."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def split_rejected(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a ``reason``."""
    return df.filter(F.col("reason").isNull()).drop("reason"), df.filter(F.col("reason").isNotNull())


def replace_by_key(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], partition: str) -> None:
    """Replace all stored rows that share the new rows' keys; running it again changes nothing.

    Only the partitions (``partition`` must be one of the keys) present in ``rows`` are rewritten.
    """
    if partition not in keys:
        raise ValueError("the partition column must be one of the keys")
    try:
        stored = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException:
        stored = None
    result = rows
    if stored is not None:
        touched = stored.join(rows.select(partition).distinct(), partition, "left_semi")
        kept = touched.join(rows.select(*keys).distinct(), list(keys), "left_anti")
        result = save_stage(kept.unionByName(rows), "replacement")  # never overwrite what is being read
    result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


#: holdings a hash partition of the client store is planned for
BUCKET_ROWS = 1_000_000


def store_client_portfolios(spark: SparkSession, path: str, portfolios: DataFrame, buckets: int | None = None) -> None:
    """Replace header and holdings of the given clients, rewriting only their hash partitions.

    The first call sets the number of partitions, from its rows unless ``buckets`` names it; the
    store carries it in ``client_buckets`` and later calls keep it, so a client stays in its partition.
    """
    try:
        stored = spark.read.parquet(path).select("client_buckets").first()
    except AnalysisException:
        stored = None
    if stored is not None:
        buckets = stored[0]
    elif buckets is None:
        buckets = 1 + portfolios.count() // BUCKET_ROWS
    keyed = portfolios.withColumns({
        "client_bucket": F.pmod(F.xxhash64("client_id"), F.lit(buckets)).cast("int"), "client_buckets": F.lit(buckets).cast("int")})
    replace_by_key(spark, path, keyed, ["client_bucket", "client_id"], "client_bucket")


class RunConflict(ValueError):
    """A stored run has the same id but other content."""


def content_summary(df: DataFrame) -> dict:
    """Row count and an order-free checksum of a table, computed by Spark."""
    row = df.select(F.xxhash64(*sorted(df.columns)).alias("h")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")).first()
    return {"rows": row["rows"], "checksum": f"{row['xor']}:{row['sum']}"}


def store_run_once(spark: SparkSession, root: str, run: dict, predictions: DataFrame) -> bool:
    """Insert a forecast run once: False for an identical rerun, an error for other content."""
    if predictions.filter(F.col("run_id") != run["run_id"]).limit(1).count():
        raise ValueError("every prediction must name the run")
    content = content_summary(predictions)
    if run["prediction_count"] != content["rows"]:
        raise ValueError("prediction_count does not match the predictions")
    described = json.dumps({**run, "checksum": content["checksum"]}, sort_keys=True)
    path = f"{root}/run_id={run['run_id']}"
    try:
        existing = spark.read.text(f"{path}/run").first()
    except AnalysisException:
        existing = None
    if existing is not None:
        if existing[0] != described or content_summary(spark.read.parquet(f"{path}/predictions")) != content:
            raise RunConflict(f"run {run['run_id']} exists with other content")
        return False
    # the description is written last: a run without it is incomplete and written again
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    spark.createDataFrame([(described,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/run")
    return True


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def dataset_id(identity: dict) -> str:
    """First 16 hex digits of SHA-256 over the canonical identity."""
    return hashlib.sha256(canonical_json(identity).encode()).hexdigest()[:16]


def publish_dataset(spark: SparkSession, root: str, identity: dict, tables: dict[str, DataFrame], prefix: str = "dataset") -> str:
    """Immutable dataset named by its identity; reused when present, never overwritten.

    Tables are written first and the manifest last, so a folder without a manifest is an
    unfinished build and is built again.
    """
    folder = f"{root}/{prefix}-{dataset_id(identity)}"
    try:
        manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    except AnalysisException:
        manifest = None
    if manifest is not None:
        if manifest["identity"] != json.loads(canonical_json(identity)):
            raise ValueError(f"{folder} holds another dataset")
        return folder
    outputs = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        outputs[name] = content_summary(spark.read.parquet(f"{folder}/{name}"))
    text = canonical_json({"dataset_id": dataset_id(identity), "identity": identity, "outputs": outputs})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return folder


def verify_dataset(spark: SparkSession, folder: str) -> dict:
    """Manifest of a published dataset after checking every table against it."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    for name, expected in manifest["outputs"].items():
        if content_summary(spark.read.parquet(f"{folder}/{name}")) != expected:
            raise ValueError(f"table {name} of {folder} does not match its manifest")
    return manifest
