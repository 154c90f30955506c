"""What is on disk: datasets, user files, reports, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.operators.reports import longest_prefix, newest_first

REPORT_NAME = r"^(.+)_(\d{8}_\d{6}|\d{8})\.json$"


def dataset_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Per JSON-lines file: non-blank lines, size in KB, evaluator of the first line."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"))
    filled = lines.where(F.trim("value") != "")
    return filled.groupBy("file", "bytes").agg(
        F.count(F.lit(1)).alias("case_count"),
        F.min_by(F.coalesce(F.get_json_object("value", "$.eval.evaluator"), F.lit("")), "at").alias("evaluator"),
    ).select(F.regexp_extract("file", r"([^/]+)$", 1).alias("name"), "case_count",
             F.round(F.col("bytes") / 1024, 1).alias("size_kb"), "evaluator")


def user_files(spark: SparkSession, root: str) -> DataFrame:
    """Files per user folder, hidden ones left out. Only names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    parts = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("user_folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length")
    return parts.where(~F.startswith("file", F.lit(".")))


def index_reports(files: DataFrame, datasets: DataFrame) -> DataFrame:
    """(benchmark, filename) rows to dataset, target label and date, newest first; other names are left out."""
    named = files.where(F.col("filename").rlike(REPORT_NAME)).withColumns({
        "name": F.regexp_extract("filename", REPORT_NAME, 1), "date": F.regexp_extract("filename", REPORT_NAME, 2)})
    return newest_first(longest_prefix(named, datasets))


def report_index(spark: SparkSession, root: str, datasets: DataFrame) -> DataFrame:
    """Index of the report files under a folder with one sub-folder per benchmark. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root).select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("benchmark"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"))
    return index_reports(files, datasets)


# Files up to this size are hashed within Spark, larger ones in pieces of PIECE bytes.
WHOLE_FILE = 1 << 26
PIECE = 1 << 23


def _piecewise():
    """Digests of files that are read piece by piece, as a closure: it travels to the workers by value."""
    import hashlib
    import re

    import pandas as pd
    from pyarrow import fs

    def opened(path: str):
        if re.match(r"file:|/", path):
            from urllib.parse import unquote

            return open(re.sub(r"^file:/+", "/", unquote(path)), "rb")
        system, at = fs.FileSystem.from_uri(path)
        return system.open_input_stream(at)

    def run(batches):
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                digest = hashlib.sha256()
                with opened(path) as f:
                    while piece := f.read(PIECE_BYTES):
                        digest.update(piece)
                out.append(digest.hexdigest())
            yield pd.DataFrame({"path": pdf["path"], "digest": out})
    PIECE_BYTES = PIECE
    return run


def file_fingerprint(spark: SparkSession, path: str, whole: int = WHOLE_FILE) -> DataFrame:
    """First 16 hex digits of the SHA-256 of every file, of any size.

    A digest has one order, so a file is one task's work; files over `whole` bytes pass through it in small pieces, read by
    Arrow's file systems (local, HDFS, S3, GCS).
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("digest"))
    # Contents are not read here: the list alone is dealt out, a file to a task.
    listed = files.where(F.col("length") > whole).select("path").repartition("path")
    large = listed.mapInPandas(_piecewise(), "path string, digest string")
    return small.unionByName(large).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.substring("digest", 1, 16).alias("fingerprint"))
