"""Ranks, top-k and medians that stay exact when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


SLICES = 64


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cell: Column,
           rank: str = "rank", size: str | None = None) -> DataFrame:
    """row_number() per group, computed cell by cell.

    `cell` must be a function of the row that never decreases along `order`. Cell sizes are
    counted first and summed up per group, so that a group is sorted by as many tasks as it
    has cells instead of by one.
    """
    celled = df.withColumn("_rk_cell", cell)
    counts = celled.groupBy(*keys, "_rk_cell").agg(F.count(F.lit(1)).alias("_rk_n"))
    along = W.partitionBy(*keys).orderBy("_rk_cell")
    key_names = [f"_rk_{i}" for i in range(len(keys))]
    offsets = counts.select(
        *[F.col(k).alias(n) for k, n in zip(keys, key_names)],
        F.col("_rk_cell").alias("_rk_at"),
        (F.sum("_rk_n").over(along) - F.col("_rk_n")).alias("_rk_before"),
        F.sum("_rk_n").over(W.partitionBy(*keys)).alias("_rk_size"),
    )
    on = F.col("_rk_cell").eqNullSafe(F.col("_rk_at"))
    for k, n in zip(keys, key_names):
        on = on & F.col(k).eqNullSafe(F.col(n))
    within = W.partitionBy(*keys, "_rk_cell").orderBy(*order)
    out = celled.join(offsets, on).withColumn(rank, F.col("_rk_before") + F.row_number().over(within))
    if size:
        out = out.withColumn(size, F.col("_rk_size"))
    return out.drop("_rk_cell", "_rk_at", "_rk_before", "_rk_size", *key_names)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group.

    Spark cuts every partition to k per group before the shuffle, but only up to its own limit. Beyond it, groups are cut
    in slices by a hash of the row first, so that no task sorts a whole group.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
        slices = W.partitionBy(*keys, F.pmod(F.xxhash64(*plain), F.lit(SLICES))).orderBy(*order)
        df = df.withColumn("_rk_slice", F.row_number().over(slices)).where(F.col("_rk_slice") <= k).drop("_rk_slice")
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


_ACCURACY = 10_000
_MARGIN = 3.0 / _ACCURACY


def median_bracket(value: str) -> list[Column]:
    """Aggregates from which `exact_median` starts; add them to an aggregate that runs anyway."""
    v = F.col(value)
    near = F.percentile_approx(v, [0.5 - _MARGIN, 0.5 + _MARGIN], _ACCURACY)
    # With few rows a rank is wider than the margin: take all of them.
    few = F.count(v) <= 4 * _ACCURACY
    return [F.count(v).alias("_n"), F.when(few, F.min(v)).otherwise(near[0]).alias("_lo"),
            F.when(few, F.max(v)).otherwise(near[1]).alias("_hi")]


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", bracket: DataFrame | None = None, many: bool = False) -> DataFrame:
    """Median per group, the middle pair averaged.

    A bounded sketch brackets the middle ranks, rows below the bracket are only counted, and
    just the distinct values inside it are put in order. The bracket is wider than the error of
    the sketch, so the result is exact. `many` groups are not sent to all executors, however small they are when compressed.
    """
    if bracket is None:
        bracket = df.groupBy(*keys).agg(*median_bracket(value))
    bracket = bracket.select(*keys, "_n", "_lo", "_hi")
    near = df.join(bracket.hint("merge") if many else bracket, list(keys)).where(F.col(value) <= F.col("_hi"))
    slot = F.when(F.col(value) >= F.col("_lo"), F.col(value))
    freq = near.groupBy(*keys, "_n", slot.alias("_v")).agg(F.count(F.lit(1)).alias("_f"))
    upto = F.sum("_f").over(W.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()))
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    placed = freq.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_f") + 1)
    return placed.groupBy(*keys).agg((
        (F.max(F.when(lower.between(F.col("_from"), F.col("_to")), F.col("_v")))
         + F.max(F.when(upper.between(F.col("_from"), F.col("_to")), F.col("_v")))) / 2).alias(name))
