"""Streams over growing result logs, readings and ingested batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.numbers import settled
from scorelake.operators.reports import changed_batches, pass_rate

RESULT_LINE = "run_id STRING, id STRING, result STRING, score DOUBLE, tags ARRAY<STRING>, finished_at TIMESTAMP"
KEY = ("run_id", "id")
# Parts of a week's users that are held and summed up apart.
WEEK_BUCKETS = 1024
Batch = Callable[[DataFrame, int], None]


def stream_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result lines as they arrive, in whatever order; lines without an id are damaged and left out."""
    lines = spark.readStream.schema(RESULT_LINE).option("mode", "PERMISSIVE").json(folder)
    return lines.where(F.col("id").isNotNull())


def _parts(spark: SparkSession, path: str, schema) -> DataFrame:
    """What earlier micro-batches have written below `path`, with the number of each in `_part`."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema).withColumn("_part", F.lit(0))


def first_finished(lines: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """For each key that a micro-batch brings lines of, the first finished line of all so far; for update mode.

    The line is held in the state store, so what counts does not depend on the borders of micro-batches: of lines that
    finished at the same time the one whose text sorts first, of unfinished ones likewise, last of all. `_changed` says
    whether the line came with this micro-batch, `_again` whether the key had one before.
    """
    rest = [c for c in lines.columns if c not in keys]
    schema = ", ".join(f"{c} {t}" for c, t in lines.dtypes if c not in keys)
    # The time of a micro-batch is one value, and the same if it runs again.
    now = F.current_timestamp()
    first = F.min(F.struct(F.col("finished_at").isNull().alias("open"), F.col("finished_at").alias("at"), F.to_json(F.struct(*rest)).alias("line"), F.col("_now").alias("came")))
    held = lines.withColumn("_now", now).groupBy(*keys).agg(first.alias("_f"), F.min("_now").alias("_since"))
    return held.select(*keys, F.from_json("_f.line", schema).alias("_r"), (F.col("_f.came") == now).alias("_changed"), (F.col("_since") < now).alias("_again")).select(
        *keys, "_r.*", "_changed", "_again")


def append_changes(table: str, then: Batch | None = None, keys: Sequence[str] = KEY) -> Batch:
    """Batch function that adds the changes of a micro-batch to a log: new lines with sign 1, and with sign -1 those they take the place of.

    A micro-batch has a partition of its own, so one that runs again replaces itself. The log is looked up for keys
    whose line has changed after an earlier micro-batch, and for no others. `then` gets the stored changes.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"{table}/_part={number}"
        columns = [c for c in batch.columns if c not in ("_changed", "_again")]
        # New lines are written once, next to whether their key had one before; lines taken back are added to them.
        new = batch.where("_changed").select(*columns, F.lit(1).alias("sign"), "_again")
        new.write.mode("overwrite").parquet(own)
        moved = spark.read.schema(new.schema).parquet(own).where("_again").select(*keys)
        if not moved.isEmpty():
            before = _parts(spark, table, new.schema).where(F.col("_part") != number)
            old = net_rows(before.join(moved, list(keys), "left_semi").select(*columns, "sign"))
            old.select("*", F.lit(-1).alias("sign"), F.lit(False).alias("_again")).write.mode("append").parquet(own)
        if then is not None:
            then(spark.read.schema(new.schema).parquet(own).drop("_again"), number)
    return write


def append_rows(table: str) -> Batch:
    """Batch function that stores the rows of a micro-batch in a partition of their own."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/_part={number}")
    return write


def net_rows(changes: DataFrame) -> DataFrame:
    """Rows that are left when those that were taken back cancel out."""
    columns = [c for c in changes.columns if c != "sign"]
    return changes.groupBy(*columns).agg(F.sum("sign").alias("sign")).where("sign > 0").select(*columns)


def current_results(spark: SparkSession, table: str, keys: Sequence[str] = KEY) -> DataFrame:
    """The table of results after all its changes. Only keys of which a line was taken back are added up."""
    log = spark.read.parquet(table).drop("_part", "_again")
    moved = log.where("sign < 0").select(*keys).distinct()
    if moved.isEmpty():
        return log.drop("sign")
    settled_rows = log.where("sign > 0").drop("sign").join(moved, list(keys), "left_anti").select(*[c for c in log.columns if c != "sign"])
    return settled_rows.unionByName(net_rows(log.join(moved, list(keys), "left_semi").select(*log.columns)))


def _signed(rows: DataFrame) -> Column:
    """1 or -1 for a change, 1 for the row of a table."""
    return F.col("sign") if "sign" in rows.columns else F.lit(1)


def keep_totals(path: str, totals: Callable[[DataFrame], DataFrame]) -> Batch:
    """Batch function that stores the sums of one micro-batch; `read_totals` adds them up."""
    def write(added: DataFrame, number: int) -> None:
        totals(added).write.mode("overwrite").parquet(f"{path}/_part={number}")
    return write


def read_totals(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    stored = spark.read.parquet(path).drop("_part")
    return stored.groupBy(*by).agg(*[F.sum(c).alias(c) for c in stored.columns if c not in by])


def tag_totals(rows: DataFrame) -> DataFrame:
    """Sums per tag that add up over micro-batches; a line that was taken back counts -1."""
    sign = _signed(rows)

    def of(status: str) -> Column:
        return F.sum(F.when(F.col("result") == status, sign).otherwise(F.lit(0)))
    return rows.withColumn("tag", F.explode("tags")).groupBy("tag").agg(
        F.sum(sign).alias("total"), of("pass").alias("pass_count"), of("fail").alias("fail_count"),
        F.sum(F.col("score") * sign).alias("score_sum"), F.sum(F.when(F.col("score").isNotNull(), sign).otherwise(F.lit(0))).alias("scored"))


def tag_stats(totals: DataFrame) -> DataFrame:
    """Live tag statistics from added totals."""
    rate = pass_rate(F.col("pass_count").cast("double"), F.col("fail_count").cast("double"))
    return totals.select("tag", "total", "pass_count", "fail_count", F.round(rate, 6).alias("pass_rate"),
                         settled(F.try_divide("score_sum", "scored"), 6).alias("avg_score"))


def status_totals(rows: DataFrame) -> DataFrame:
    """Number and score sum per run and status."""
    sign = _signed(rows)
    return rows.groupBy("run_id", "result").agg(F.sum(sign).alias("n"), F.sum(F.col("score") * sign).alias("score_sum"))


def progress_snapshot(counts: DataFrame, cases: DataFrame) -> DataFrame:
    """Counts per run and status next to the size of the case table; open cases get a NULL status."""
    total = cases.agg(F.count(F.lit(1)).alias("total")).first()["total"]
    done = counts.groupBy("run_id").agg(F.sum("n").alias("completed"))
    opened = done.select("run_id", F.lit(None).cast("string").alias("result"), (F.lit(total) - F.col("completed")).alias("n"))
    rows = counts.select("run_id", "result", "n").unionByName(opened)
    return rows.join(done, "run_id").withColumn("total", F.lit(total))


def stream_weekly_stats(readings: DataFrame, delay: str, time: str = "time") -> DataFrame:
    """Mean, minimum, maximum per user, Monday week and indicator; see `stream_week_trends` for the trend.

    In complete mode every reading counts. In update mode the state of a week goes once the newest reading
    is `delay` past its end, which bounds the state; readings later than that are left out.
    """
    timed = readings.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    week = F.window(time, "7 days", "7 days", "4 days")
    return timed.where(F.col("value_num").isNotNull()).groupBy("user_id", week.alias("week"), "indicator").agg(
        F.count("value_num").alias("n"), F.avg("value_num").alias("mean"), F.min("value_num").alias("min"), F.max("value_num").alias("max"))


def _week_closer():
    """A processor that gathers a week's readings of many users and sums them up when the week is closed.

    The readings of a micro-batch are one value of the state, users and indicators by number, so a call to the state store
    goes for many readings.
    """
    import pickle
    import zlib

    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    def held(pdf: pd.DataFrame) -> bytes:
        """Readings as columns, without a copy of a user for each. The names of the columns are not those of the rows."""
        user, indicator, at, value, _ = (pdf.iloc[:, i] for i in range(-5, 0))
        columns = [pd.factorize(c, use_na_sentinel=False) for c in (user, indicator)]
        return zlib.compress(pickle.dumps((*[(x_at.astype(np.int32), [None if pd.isna(x) else x for x in names]) for x_at, names in columns],
                                           at.to_numpy(np.int64), value.to_numpy(np.float64))), 1)

    def joined(parts: list[tuple]) -> tuple:
        """All parts of a week: users and the number of each reading's, indicators likewise, times and values."""
        out = []
        for i in (0, 1):
            numbers: dict = {}
            # Equal names of several parts get one number.
            of = [np.array([numbers.setdefault(x, len(numbers)) for x in p[i][1]], np.int64)[p[i][0]] for p in parts]
            out += [list(numbers), np.concatenate(of)]
        return (*out, np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]))

    class WeekCloser(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.readings = handle.getListState("readings", "part BINARY")
            self.closed = handle.getValueState("closed", "done BOOLEAN")

        def handleInputRows(self, key, rows, timerValues):
            if not self.closed.exists():
                new = [(held(pdf),) for pdf in rows if len(pdf)]
                if new and not self.readings.exists():
                    self.handle.registerTimer(int(key[1]) + 7 * 86_400_000)
                if new:
                    self.readings.appendList(new)
            yield pd.DataFrame()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            parts = [pickle.loads(zlib.decompress(r[0])) for r in self.readings.get()]
            self.readings.clear()
            self.closed.update((True,))
            users, user, indicators, indicator, at, value = joined(parts)
            order = np.lexsort((value, at, indicator, user))
            user, indicator, value = user[order], indicator[order], value[order]
            start = np.flatnonzero(np.diff(user, prepend=-1) | np.diff(indicator, prepend=-1))
            n = np.diff(start, append=len(value))
            mid = n // 2

            def sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                """Sums of the stretches from a to b; empty ones are 0."""
                out, some = np.zeros(len(a)), b > a
                cuts = np.column_stack([a[some], b[some]]).ravel()
                padded = np.append(value, 0.0)
                out[some] = np.add.reduceat(padded, cuts)[::2] if len(cuts) else 0.0
                return out
            stop = start + n
            mean = sums(start, stop) / n
            first = np.divide(sums(start, start + mid), mid, out=np.zeros(len(n)), where=mid > 0)
            ratio = (sums(start + mid, stop) / (n - mid) - first) / (np.abs(first) + 1e-9)
            trend = np.where((n >= 4) & (ratio > 0.1), "rising", np.where((n >= 4) & (ratio < -0.1), "falling", "stable"))
            least, most = np.minimum.reduceat(value, start), np.maximum.reduceat(value, start)
            yield pd.DataFrame({
                "user_id": pd.Series([users[u] for u in user[start]], dtype=object), "indicator": pd.Series([indicators[x] for x in indicator[start]], dtype=object),
                "_week": np.int64(key[1]), "n": n.astype(np.int64), "mean": mean, "min": least, "max": most, "trend": trend.astype(object),
                "anomaly": (n >= 3) & (most > mean * 1.5)})

        def close(self) -> None:
            pass
    return WeekCloser()


def stream_week_trends(readings: DataFrame, delay: str, time: str = "time", buckets: int = WEEK_BUCKETS) -> DataFrame:
    """Weekly summaries with trend and anomaly, one row per user, indicator and Monday week when the week is closed.

    A week is closed once the newest reading is `delay` past its end; readings that lie further than that behind the newest one are
    left out. Until then its readings are held in the state store, in no order; the halves of the trend follow time and value.
    Users and indicators are dealt to `buckets`, and the state is kept by bucket and week; the number stays with a checkpoint.
    """
    timed = readings.withColumn(time, F.col(time).cast("timestamp")).where(F.col("value_num").isNotNull()).withWatermark(time, delay)
    week = F.unix_millis(F.date_trunc("week", time))
    types = dict(readings.dtypes)
    bucket = F.pmod(F.xxhash64("user_id", "indicator"), F.lit(buckets)).cast("int")
    rows = timed.select(bucket.alias("_bucket"), week.alias("_week"), F.col("user_id").cast("string").alias("user_id"), F.col("indicator").cast("string").alias("indicator"),
                        F.unix_micros(time).alias("_at"), F.col("value_num").cast("double").alias("value_num"), time)
    schema = "user_id string, indicator string, _week bigint, n bigint, mean double, min double, max double, trend string, anomaly boolean"
    out = rows.groupBy("_bucket", "_week").transformWithStateInPandas(_week_closer(), schema, "append", "eventTime")
    return out.select(F.col("user_id").cast(types["user_id"]).alias("user_id"), F.timestamp_millis("_week").cast("date").alias("monday"),
                      F.col("indicator").cast(types["indicator"]).alias("indicator"), "n", "mean", "min", "max", "trend", "anomaly")


def run_available(stream: DataFrame, checkpoint: str, each: Batch, mode: str = "append") -> None:
    """Process what is there, then stop. A restart with the same checkpoint goes on where it ended.

    State lies in RocksDB, which keeps it on disk and not on the heap. Its rows are not counted, which would take a look-up
    for each row that is put.
    """
    conf = stream.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def overwrite_with(path: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> Batch:
    """Batch function that replaces the snapshot at `path`."""
    def write(batch: DataFrame, _: int) -> None:
        transform(batch).write.mode("overwrite").parquet(path)
    return write


def ingest_changed(spark: SparkSession, folder: str, schema: str, manifest: DataFrame, local: DataFrame, table: str, staging: str,
                   checkpoint: str, force: bool = False, versions: tuple[str | None, str | None] = (None, None)) -> None:
    """Ingest files of batches that are new or changed; their partitions of the table are replaced.

    The rows carry their `batch`. Micro-batches only collect rows, under the checksum of their batch; when
    all files are read, each changed partition is replaced once, by all its rows. A run that stops
    before that goes on with the rows collected so far. `versions` are those of the manifest and of the table.
    """
    wanted = changed_batches(manifest, local, force, versions).select("batch", "checksum")

    def collect(rows: DataFrame, number: int) -> None:
        rows.join(wanted, "batch").write.mode("overwrite").partitionBy("batch", "checksum").parquet(f"{staging}/_part={number}")

    run_available(spark.readStream.schema(schema).json(folder), checkpoint, collect)
    columns = spark.createDataFrame([], schema).columns
    collected = _parts(spark, staging, f"{schema}, checksum STRING").withColumn("batch", F.col("batch").cast("string"))
    collected.join(wanted, ["batch", "checksum"], "left_semi").select(*columns).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)
