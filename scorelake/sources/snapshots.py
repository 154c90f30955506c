"""Tables of buckets with versions: changed buckets are found by fingerprints, and a version appears at once.

A version is a small table (bucket, fingerprint, write) that says which write holds the rows of each bucket. Data are only ever
added. A version counts from the moment its marker file is whole, and a marker is never replaced; a
reader that has opened one version goes on reading it, and a writer that dies before the marker leaves nothing
but unlisted files.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.operators.corpus import content_fingerprint

BUCKET = "_bucket"


def _files(spark: SparkSession, path: str):
    """(file system, path) of Spark's own storage."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _files(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


@dataclass
class Snapshots:
    """A table below `folder` whose rows lie in `n_buckets` buckets by a hash of `key`."""

    folder: str
    key: str = "user_id"
    n_buckets: int = 256

    def current(self, spark: SparkSession) -> tuple[int, str | None]:
        """Number and name of the newest version; 0 and None before the first."""
        for number in sorted((int(n) for n in _names(spark, f"{self.folder}/versions") if n.isdigit()), reverse=True):
            fs, at = _files(spark, f"{self.folder}/versions/{number}")
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(at), "UTF-8")
            if text.endswith("\n"):  # else its writer died while it made the marker
                return number, text.strip()
        return 0, None

    def manifest(self, spark: SparkSession, name: str | None = None) -> DataFrame:
        """(bucket, fingerprint, write) of a version, by default the newest."""
        name = name or self.current(spark)[1]
        schema = f"{BUCKET} INT, fingerprint STRING, write STRING"
        return spark.createDataFrame([], schema) if name is None else spark.read.schema(schema).parquet(f"{self.folder}/manifests/{name}")

    def read(self, spark: SparkSession, name: str | None = None) -> DataFrame | None:
        """The rows of a version; None before the first. Folders of other writes are pruned."""
        entries = self.manifest(spark, name).select(BUCKET, F.col("write").alias("_write"))
        if name is None and self.current(spark)[1] is None:
            return None
        # One row for each bucket: a table of bounded size.
        return spark.read.parquet(f"{self.folder}/data").join(F.broadcast(entries), ["_write", BUCKET], "left_semi").drop("_write", BUCKET)

    def update(self, df: DataFrame, sort: Sequence[str] = (), spread: Sequence[str] = ()) -> tuple[int, DataFrame]:
        """Make the table equal to `df` by writing the buckets that differ; (version, changed buckets).

        `spread` names columns that deal the rows of a large bucket to several writers, and `sort` their order in
        a file. A version that another writer has made meanwhile ends the update with an error and stays.
        """
        spark = df.sparkSession
        number, old_name = self.current(spark)
        rows = df.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.n_buckets)).cast("int"))
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) if "array" not in t and "struct" not in t and "map" not in t and t != "variant" else F.coalesce(F.to_json(c), F.lit("\0"))
                 for c, t in df.dtypes]
        prints = content_fingerprint(rows, [BUCKET], *parts).select(BUCKET, "fingerprint")
        old = self.manifest(spark, old_name)
        write, name = uuid.uuid4().hex, uuid.uuid4().hex
        both = prints.join(old.withColumnsRenamed({"fingerprint": "_old", "write": "_old_write"}), BUCKET, "left")
        same = F.col("fingerprint").eqNullSafe(F.col("_old"))
        entries = both.select(BUCKET, "fingerprint", F.when(same, F.col("_old_write")).otherwise(F.lit(write)).alias("write"))
        entries.write.parquet(f"{self.folder}/manifests/{name}")
        entries = self.manifest(spark, name)
        changed = entries.where(F.col("write") == write).select(BUCKET)
        dealt = rows.join(F.broadcast(changed), BUCKET, "left_semi").withColumn("_write", F.lit(write))
        dealt.repartition(BUCKET, *spread).sortWithinPartitions(BUCKET, *sort).write.mode("append").partitionBy("_write", BUCKET).parquet(f"{self.folder}/data")
        self._commit(spark, number + 1, name)
        return self.current(spark)[0], changed

    def _commit(self, spark: SparkSession, number: int, name: str) -> None:
        """Create the marker of version `number`, or of the next number whose marker is not one of a dead writer."""
        dead = [int(n) for n in _names(spark, f"{self.folder}/versions") if n.isdigit()]
        if number in dead and self.current(spark)[0] >= number:
            raise RuntimeError(f"version {number} was made by another writer")
        fs, marker = _files(spark, f"{self.folder}/versions/{max([number, *(n + 1 for n in dead)])}")
        try:
            out = fs.create(marker, False)
        except Exception as e:
            raise RuntimeError(f"version {number} was made by another writer") from e
        out.write(bytearray(f"{name}\n".encode()))
        out.close()
