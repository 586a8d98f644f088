"""Session defaults and saved stage tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException


def build_session(master: str | None = None, app: str = "quarterdeck", shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` when the cluster names one.

    Only a local master may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = _LOCAL_FOLDERS.get(spark.sparkContext.applicationId)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _LOCAL_FOLDERS[spark.sparkContext.applicationId] = folder
    return folder


_LOCAL_FOLDERS: dict[str, str] = {}


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the Python workers this package, as ``--py-files`` would; once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def save_stage(df: DataFrame, label: str, partition_by: tuple[str, ...] = (), rows_a_file: int = 0) -> DataFrame:
    """Write a stage as Parquet in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and lets every later
    reader prune columns and push filters into the scan.
    """
    return read_stage(df.sparkSession, write_stage(df, label, partition_by, rows_a_file))


def write_stage(df: DataFrame, label: str, partition_by: tuple[str, ...] = (), rows_a_file: int = 0) -> str:
    path = f"{shared_folder(df.sparkSession)}/quarterdeck/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_a_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def listing_key(spark: SparkSession, folder: str) -> str:
    """Key of a folder's files by path, length and time of change; Spark lists them and reads no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    hashed = files.select(F.xxhash64("path", "length", "modificationTime").alias("h"))
    row = hashed.agg(F.count("h").alias("files"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("mixed")).first()
    return f"{row.files}:{row.mixed}"


class Workspace:
    """Saved stage tables of one input folder, each built at most once per application and state of its files.

    The files are listed once for each workspace, so a query sees one state of its input,
    and the next query on files that have changed builds its stages anew.
    """

    _paths: dict[tuple[str, str, str, str], str] = {}

    def __init__(self, spark: SparkSession, source: str):
        self.spark, self.source = spark, source

    @cached_property
    def _state(self) -> str:
        return listing_key(self.spark, self.source)

    def kept(self, label: str) -> DataFrame | None:
        """A stage that is there already; nothing is built."""
        path = self._paths.get((self.spark.sparkContext.applicationId, self.source, self._state, label))
        try:
            return None if path is None else read_stage(self.spark, path)
        except AnalysisException:  # the shared folder was cleared in between
            return None

    def saved(self, label: str, build, partition_by: tuple[str, ...] = (), rows_a_file: int = 0) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.source, self._state, label)
        path = self._paths.get(key)
        if path is not None:
            try:
                return read_stage(self.spark, path)
            except AnalysisException:  # the shared folder was cleared in between
                pass
        self._paths[key] = write_stage(build(), label, partition_by, rows_a_file)
        return read_stage(self.spark, self._paths[key])

    def forget(self, delete: bool = False) -> None:
        """Build every stage of the folder anew; ``delete`` removes the saved tables too, so no frame that reads them may be in use."""
        jvm, app = self.spark._jvm, self.spark.sparkContext.applicationId
        for key in [k for k in self._paths if k[:2] == (app, self.source)]:
            table = self._paths.pop(key)
            if delete:
                path = jvm.org.apache.hadoop.fs.Path(table)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.__dict__.pop("_state", None)
