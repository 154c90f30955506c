"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.session import scratch_path, shuffles_freed
from scorelake.session import stored as stored

# Stands for a missing id inside joins; results show null again.
NO_ID = -(2**63)
MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def solid_id(c: str) -> Column:
    """An id that joins: null becomes NO_ID."""
    return F.coalesce(F.col(c).cast("bigint"), F.lit(NO_ID))


def given_id(c: str) -> Column:
    """The id as it was given, undoing `solid_id`."""
    return F.nullif(F.col(c), F.lit(NO_ID))


def stored_by(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Like `stored`, dealt out by the keys: joins on them read the table without a shuffle of it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table_name = f"{name}_{path.rsplit('-', 1)[1]}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_freed(spark):
        df.repartition(n, *keys).write.bucketBy(n, *keys).option("compression", "zstd").option("path", path).saveAsTable(table_name)
    return spark.table(table_name)


def splitmix(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers (the splitmix64 sequence)."""
    out, state = [], seed
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & MASK
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))
