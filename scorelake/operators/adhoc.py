"""Read-only statements over registered frames, bounded in rows and cell width."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

READ_ONLY = ("select", "with")


def bounded_sql(spark: SparkSession, sql: str, frames: dict[str, DataFrame], max_rows: int | None = None,
                max_cell_chars: int | None = None) -> DataFrame:
    """Run a SELECT over `{name}` frames; one row beyond the limit, if there is one, marks the result as truncated."""
    body = sql.strip().rstrip(";").strip()
    first = re.match(r"\w*", body).group().lower()
    if first not in READ_ONLY or ";" in body:
        raise ValueError("only a single SELECT or WITH statement is allowed")
    result = spark.sql(body, **frames)
    kinds = dict(result.dtypes)
    clipped = result if max_cell_chars is None else result.select(*[
        F.substring(F.col(c), 1, max_cell_chars).alias(c) if kinds[c] == "string" else F.col(c) for c in result.columns])
    if max_rows is None:
        return clipped.withColumn("truncated", F.lit(False))
    # A bounded number of rows: they may pass through one task, which also counts them.
    everything = W.partitionBy(F.lit(1))
    return clipped.limit(max_rows + 1).withColumns({
        "truncated": F.count(F.lit(1)).over(everything) > max_rows,
        "_row": F.row_number().over(everything.orderBy(F.lit(1)))}).where(F.col("_row") <= max_rows).drop("_row")
