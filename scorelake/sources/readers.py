"""Readers: files in the evaluation formats to flat tables.

Document readers take one JSON document per file, or with `lines` one per line, which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake import schemas as sm
from scorelake.functions.dates import exclusive_end
from scorelake.functions.text import folder_to_user
from scorelake.operators.cases import is_array, is_object
from scorelake.sources.json_array import read_json_array, until_damage


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines to cases; blank lines are skipped, a bad line ends the job."""
    return spark.read.schema(sm.CASE).option("mode", "FAILFAST").json(path)


def read_case_csv(spark: SparkSession, path: str) -> DataFrame:
    """Calculator rows with quoted notes over several lines; header names become snake case."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    return df.toDF(*["ground_truth" if n == "ground_truth_answer" else n for n in names])


def _path_user(path: Column) -> Column:
    """User from the folder a document lies in."""
    return folder_to_user(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def read_timeline(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """One document per user to `readings`, `exams` and `events` by entry type; values stay text."""
    docs = spark.read.schema(sm.TIMELINE).json(path, multiLine=not lines).select("*", F.col("_metadata.file_path").alias("_path"))
    user = F.coalesce("user_id", _path_user(F.col("_path")))
    entries = docs.select(user.alias("user_id"), F.explode("entries").alias("e")).select("user_id", "e.*")
    time = F.try_to_timestamp("time")
    readings = entries.where("entry_type = 'device_indicator'").select(
        "user_id", time.alias("time"), "indicator", "device_type", "value", F.col("value").try_cast("double").alias("value_num"), "unit")
    exams = entries.where("entry_type = 'exam_indicator'").select(
        "user_id", time.alias("time"), "indicator", "exam_type", "exam_location", "value", F.col("value").try_cast("double").alias("value_num"), "unit")
    start = F.col("event.start_date").try_cast("date")
    events = entries.where("entry_type = 'event'").select(
        "user_id", time.alias("time"), F.coalesce(F.try_to_timestamp("end_time"), exclusive_end(start, F.col("event.duration_days")).cast("timestamp")).alias("end_time"),
        "event.event_id", "event.event_type", "event.event_name", start.alias("start_date"), "event.duration_days", "event.interrupted",
        F.col("event.interruption_date").try_cast("date").alias("interruption_date"))
    return {"readings": readings, "exams": exams, "events": events}


def read_exams(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Exam documents whose indicators are a map by name or an array; the time defaults to the exam day."""
    docs = spark.read.schema(sm.EXAM).json(path, multiLine=not lines).select("*", F.col("_metadata.file_path").alias("_path"))
    head = docs.select(_path_user(F.col("_path")).alias("user_id"), F.coalesce("exam_date", "date").alias("exam_date"),
                       "exam_type", "exam_location", "indicators")
    as_map = head.where(is_object(F.col("indicators"))).select(
        "*", F.explode(F.try_variant_get("indicators", "$", "map<string,variant>")).alias("_name", "_v"))
    as_list = head.where(is_array(F.col("indicators"))).select(
        "*", F.explode(F.try_variant_get("indicators", "$", "array<variant>")).alias("_v")).withColumn("_name", F.lit(None).cast("string"))

    def field(name: str) -> Column:
        return F.try_variant_get("_v", f"$.{name}", "string")

    both = as_map.unionByName(as_list).where(is_object(F.col("_v")))
    key = F.coalesce(field("indicator_key"), F.col("_name"), field("indicator_name"))
    return both.select(
        "user_id", "exam_date", "exam_type", "exam_location", F.coalesce(field("indicator_name"), F.col("_name"), field("indicator_key")).alias("indicator"),
        key.alias("indicator_key"), field("value").alias("value"), field("value").try_cast("double").alias("value_num"), field("unit").alias("unit"),
        field("status").alias("status"), field("reference_range").alias("reference_range"),
        F.coalesce(F.try_to_timestamp(field("timestamp")), F.try_to_timestamp(F.concat("exam_date", F.lit(" 00:00:00")))).alias("time"))


def read_device_days(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Days to readings of five fields.

    With `lines`, one day per line, and a broken line (such as a cut tail) is skipped. Otherwise one array of days per
    file, of any size, read in byte ranges; of a damaged file the days before the damage count.
    """
    if lines:
        raw = spark.read.schema(sm.DEVICE_DAY + ", _corrupt_record STRING").option("mode", "PERMISSIVE").json(path)
        days = raw.select("date", "indicators", "_corrupt_record", _path_user(F.col("_metadata.file_path")).alias("user_id")).where(F.col("_corrupt_record").isNull())
    else:
        days = until_damage(read_json_array(spark, path), sm.DEVICE_DAY).select("item.date", "item.indicators", _path_user(F.col("path")).alias("user_id"))
    return days.select("user_id", "date", F.explode("indicators").alias("i")).select(
        "user_id", F.col("date").try_cast("date").alias("day"), F.col("i.indicator_key").alias("indicator"), F.col("i.indicator_name").alias("indicator_name"),
        F.coalesce("i.value_num", F.col("i.value").try_cast("double")).alias("value_num"), "i.unit")

def read_queries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Queries with ground truth, from a root object or a bare list."""
    docs = spark.read.schema(sm.QUERIES).json(path, multiLine=not lines)
    own = F.struct("query_id", "query_text", "difficulty", "ground_truth")
    return docs.select(F.explode(F.coalesce("evaluation_queries", F.array(own))).alias("q")).select(
        "q.query_id", "q.query_text", "q.difficulty", "q.ground_truth.*").where(F.col("query_id").isNotNull())


def read_reports(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Report documents to (runs, results); results carry the names of their run."""
    docs = spark.read.schema(sm.REPORT).json(path, multiLine=not lines).select("*", F.col("_metadata.file_name").alias("file"))
    docs = docs.where(F.col("file") != "metadata.json")
    head = ["file", "benchmark_name", "dataset_name", "started_at"]
    results = docs.select(*head, F.explode("cases").alias("c")).select(*head, "c.*").withColumns({
        "result": F.col("eval.result"), "score": F.col("eval.score"), "feedback": F.col("eval.feedback")}).drop("eval")
    return docs.drop("cases"), results


def read_result_log(spark: SparkSession, path: str) -> DataFrame:
    """Append-only results; cut or broken lines are skipped."""
    raw = spark.read.schema(sm.RESULT + ", _corrupt_record STRING").option("mode", "PERMISSIVE").json(path)
    return raw.where(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()).drop("_corrupt_record")


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """External answers; an answer has at least one character."""
    return spark.read.schema(sm.SUBMISSION).json(path).where(F.length("answer") >= 1)


def usage_rows(submissions: DataFrame, role: str = "target") -> DataFrame:
    """Token use of submissions as (id, role, model, tokens)."""
    return submissions.select("id", F.lit(role).alias("role"), F.explode("cost").alias("model", "u")).select("id", "role", "model", "u.*")
