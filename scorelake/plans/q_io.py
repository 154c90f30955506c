"""Source and sink queries: tables are written in a format and read back through its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.plans.registry import query
from scorelake.session import scratch_path
from scorelake.sources import catalog, readers, writers
from scorelake.sources.snapshots import Snapshots


def written(t, df, name: str, fmt: str = "json", **options) -> str:
    path = scratch_path(t.spark, name)
    df.write.options(**options).format(fmt).save(path)
    return path


def case_docs(t):
    return t.cases.select(
        F.col("id").cast("string").alias("id"), F.col("difficulty").alias("title"),
        F.struct(F.lit("manual").alias("type"), F.array("expected_value").alias("strict_inputs"),
                 F.create_map(F.lit("api"), F.create_map(F.lit("user"), F.col("user_id").cast("string"))).alias("target_overrides")).alias("user"),
        F.struct(F.lit("typed_qa").alias("evaluator"), "answer_type", "expected_value").alias("eval"),
        F.array(F.struct(F.lit("assistant").alias("role"), F.lit("hi").alias("content"))).alias("history"), F.array("status_tag").alias("tags"))


@query("src01_read_cases", "SELECT CAST(id AS VARCHAR) AS id, difficulty AS title, answer_type, CAST(user_id AS VARCHAR) AS user_ref, status_tag AS tag FROM v_cases")
def _(t):
    cases = readers.read_cases(t.spark, written(t, case_docs(t), "cases"))
    return cases.select("id", "title", F.try_variant_get("eval", "$.answer_type", "string").alias("answer_type"),
                        F.col("user.target_overrides")["api"]["user"].alias("user_ref"), F.col("tags")[0].alias("tag"))


@query("src02_read_case_csv", "SELECT CAST(doc_id AS VARCHAR) AS row_number, md5(concat('said \"', text, '\"')) AS h FROM documents")
def _(t):
    rows = t.raw("documents").select(F.col("doc_id").alias("Row Number"), F.concat(F.lit('said "'), "text", F.lit('"')).alias("Patient Note"))
    path = written(t, rows, "csv", "csv", header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_case_csv(t.spark, path).select("row_number", F.md5("patient_note").alias("h"))


def slot(*parts):
    """Cuts a group that is gathered in one document into many."""
    return F.pmod(F.xxhash64(*parts), F.lit(16)).alias("slot")


def timeline_docs(t):
    """Documents of a user's months, in one JSON-lines folder."""
    entry = F.struct(F.lit("device_indicator").alias("entry_type"), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), "indicator",
                     F.col("value_num").alias("value"), "unit", F.lit(None).cast("struct<event_name:string,start_date:string,duration_days:int>").alias("event"))
    device = t.readings.select(F.col("user_id").cast("string").alias("user_id"), entry.alias("e"))
    event = t.life_events.select(F.col("user_id").cast("string").alias("user_id"), F.struct(
        F.lit("event").alias("entry_type"), F.concat(F.col("start_date").cast("string"), F.lit("T00:00:00")).alias("time"), F.lit(None).cast("string").alias("indicator"),
        F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"),
        F.struct("event_name", F.col("start_date").cast("string").alias("start_date"), "duration_days").alias("event")).alias("e"))
    part = F.substring(F.col("e.time"), 1, 7)
    return device.unionByName(event).groupBy("user_id", part.alias("part"), slot(F.col("e.time"), F.col("e.value"))).agg(
        F.collect_list("e").alias("entries")).select("user_id", "entries")


@query("src03_read_timeline", """SELECT 'readings' AS kind, CAST(user_id AS VARCHAR) AS user_id, count(*) AS n, CAST(round(sum(CAST(value_num AS DECIMAL(18,2))), 2) AS DOUBLE) AS total FROM v_readings GROUP BY user_id
       UNION ALL SELECT 'events', CAST(user_id AS VARCHAR), count(*), sum(duration_days)::DOUBLE FROM v_life_events GROUP BY user_id""")
def _(t):
    tables = readers.read_timeline(t.spark, written(t, timeline_docs(t), "timeline"), lines=True)
    device = tables["readings"].groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    events = tables["events"].groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_days").cast("double").alias("total"))
    return device.withColumn("kind", F.lit("readings")).unionByName(events.withColumn("kind", F.lit("events")))


@query("src04_read_exams", "SELECT indicator, exam_type, CAST(day AS VARCHAR) AS exam_date, count(*) AS n, CAST(sum(CAST(value_num AS DECIMAL(18,2))) AS DOUBLE) AS total FROM v_exams GROUP BY ALL")
def _(t):
    doc = t.exams.select(F.col("day").cast("string").alias("exam_date"), "exam_type", "indicator", "value_num", (F.col("exam_id") % 2 == 0).alias("even"))
    head = ["exam_date", "exam_type"]
    as_map = doc.where("even").select(*head, F.create_map("indicator", F.struct(F.col("value_num").alias("value"))).alias("indicators"))
    as_list = doc.where("NOT even").select(*head, F.array(F.struct(F.col("indicator").alias("indicator_name"), F.col("value_num").alias("value"))).alias("indicators"))
    root = scratch_path(t.spark, "exams")
    as_map.write.json(f"{root}/a")
    as_list.write.json(f"{root}/b")
    read = readers.read_exams(t.spark, f"{root}/*", lines=True)
    return read.groupBy("indicator", "exam_type", "exam_date").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query("src05_read_device_days", "SELECT CAST(day AS VARCHAR) AS day, indicator, count(*) AS n, CAST(sum(CAST(value_num AS DECIMAL(18,2))) AS DOUBLE) AS total FROM v_readings GROUP BY ALL")
def _(t):
    item = F.struct(F.col("indicator").alias("indicator_key"), F.when(F.col("reading_id") % 2 == 0, F.col("value_num")).alias("value_num"),
                    F.when(F.col("reading_id") % 2 == 1, F.col("value_num")).alias("value"), F.lit("generated").alias("origin"))
    days = t.readings.groupBy("user_id", F.col("day").cast("string").alias("date"), slot(F.col("reading_id"))).agg(F.collect_list(item).alias("indicators"))
    good = days.select(F.to_json(F.struct("date", "indicators")).alias("value"))
    cut = t.raw("region").select(F.concat(F.lit('{"date": "2024-01-01", "indicators": [{"indicator_key": "'), "r_name").alias("value"))
    read = readers.read_device_days(t.spark, written(t, good.union(cut), "days", "text"))
    return read.groupBy(F.col("day").cast("string").alias("day"), "indicator").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value_num").cast("decimal(18,2)")).cast("double").alias("total"))


@query("src05_read_device_arrays", """SELECT CAST(event_type AS VARCHAR) AS indicator, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM events GROUP BY ALL""")
def _(t):
    """One array of days per month and slot, of which the text is cut short within a last day that no file keeps."""
    item = F.struct(F.col("indicator").alias("indicator_key"), F.col("value_num"), F.lit('generated "by {this}", \\\\ [and] that').alias("origin"))
    days = t.readings.groupBy(F.trunc("day", "month").alias("month"), slot(F.col("reading_id")), "user_id", F.col("day").cast("string").alias("date")).agg(F.collect_list(item).alias("indicators"))
    arrays = days.groupBy("month", slot(F.col("user_id"))).agg(F.sort_array(F.collect_list(F.to_json(F.struct("date", "indicators")))).alias("days"))
    text = F.concat(F.lit("[\n "), F.array_join("days", ",\n "), F.lit(',\n {"date": "2024-01-01", "indicators": [{"indicator_key": "lost", "value_num": 1'))
    root = scratch_path(t.spark, "arrays")
    # One file for each array: the month and the slot name it.
    arrays.select(text.alias("value"), F.concat_ws("-", "month", F.xxhash64("days")).alias("part")).repartition("part").write.partitionBy("part").text(root)
    # Ranges that cut large files in several, whatever their size: as many tasks as files ask for, not one for each 64 KB.
    largest = t.spark.read.format("binaryFile").load(f"{root}/*").agg(F.max("length").alias("most")).first()["most"] or 0
    kept = t.spark.conf.get("spark.sql.files.maxPartitionBytes")
    t.spark.conf.set("spark.sql.files.maxPartitionBytes", str(min(max(1 << 16, largest // 4), 1 << 27)))
    try:
        read = readers.read_device_days(t.spark, f"{root}/*", lines=False)
    finally:
        t.spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    return read.groupBy(F.col("day").cast("string").alias("day"), "indicator").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value_num").cast("decimal(18,2)")).cast("double").alias("total"))


@query("src06_read_queries", "SELECT CAST(event_id AS VARCHAR) AS query_id, event_type AS difficulty, CAST(value AS VARCHAR) AS expected_value FROM events")
def _(t):
    e = t.raw("events")
    q = F.struct(F.col("event_id").cast("string").alias("query_id"), F.col("event_type").alias("difficulty"),
                 F.struct(F.col("value").alias("expected_value"), F.lit("numeric").alias("answer_type")).alias("ground_truth"))
    root = scratch_path(t.spark, "queries")
    e.where("event_type = 'click'").groupBy("user_id", F.trunc("ts", "month"), slot(F.col("event_id"))).agg(F.collect_list(q).alias("evaluation_queries")).select("evaluation_queries").write.json(f"{root}/a")
    e.where("event_type <> 'click'").select(q.alias("q")).select("q.*").write.json(f"{root}/b")
    return readers.read_queries(t.spark, f"{root}/*", lines=True).select("query_id", "difficulty", "expected_value")


def result_struct():
    return F.struct(F.col("id").cast("string").alias("id"), F.struct("result", "score").alias("eval"), F.lit(None).cast("string").alias("title"))


@query("src07_read_reports", "SELECT CAST(system_id AS VARCHAR) AS dataset, count(*) AS n, count(*) FILTER (result = 'pass') AS passed FROM v_results GROUP BY system_id")
def _(t):
    reports = t.results.groupBy("system_id", F.trunc("start_ts", "month").alias("month"), slot(F.col("id"))).agg(F.collect_list(result_struct()).alias("cases")).select(
        F.lit("b").alias("benchmark_name"), F.col("system_id").cast("string").alias("dataset_name"), "cases")
    runs, results = readers.read_reports(t.spark, written(t, reports, "reports"), lines=True)
    return results.withColumnRenamed("dataset_name", "dataset").groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("result") == "pass").alias("passed"))


@query("src08_read_result_log", "SELECT CAST(id AS VARCHAR) AS id, result, score FROM v_results")
def _(t):
    lines = t.results.select(F.to_json(result_struct()).alias("value"))
    cut = lines.where(F.length("value") > 50).select(F.substring("value", 1, 30).alias("value"))
    return readers.read_result_log(t.spark, written(t, lines.union(cut), "log", "text")).select("id", F.col("eval.result").alias("result"), F.col("eval.score").alias("score"))


@query("src09_read_submissions", "SELECT CAST(id AS VARCHAR) AS id, md5(answer) AS h, 10 * length(answer) AS input_tokens FROM v_answers")
def _(t):
    subs = t.answers.select(F.col("id").cast("string").alias("id"), "answer", F.create_map(F.lit("m"), F.struct((F.length("answer") * 10).alias("input_tokens"))).alias("cost"))
    empty = t.raw("region").select(F.col("r_name").alias("id"), F.lit("").alias("answer"))
    read = readers.read_submissions(t.spark, written(t, subs.unionByName(empty, allowMissingColumns=True), "subs"))
    return read.join(readers.usage_rows(read), "id").select("id", F.md5("answer").alias("h"), "input_tokens")


@query("src10_write_cases", "SELECT difficulty, count(*) AS n, count(*) AS n_all FROM v_cases GROUP BY difficulty")
def _(t):
    path = scratch_path(t.spark, "published")
    schema = "id BIGINT, user_id BIGINT, difficulty STRING"
    writers.write_cases(t.cases.select("user_id", "id", "difficulty"), path, by="difficulty")
    per = t.spark.read.schema(schema).json(f"{path}/by_difficulty").groupBy("difficulty").agg(F.count("id").alias("n"))
    return per.join(t.spark.read.schema(schema).json(f"{path}/all").groupBy("difficulty").agg(F.count("id").alias("n_all")), "difficulty")


@query("src11_write_report", "SELECT CAST(system_id AS VARCHAR) AS target_label, CAST(CASE WHEN id % 2 = 0 THEN 20240101 ELSE 20240102 END AS VARCHAR) AS run_ts, count(*) AS n FROM v_results GROUP BY ALL")
def _(t):
    path = scratch_path(t.spark, "report")
    rows = t.results.select("id", "result", "score", F.lit("b").alias("benchmark"), F.lit("d").alias("dataset"), F.concat(F.lit("s"), "system_id").alias("target_label"),
                            F.when(F.col("id") % 2 == 0, F.lit("r20240101")).otherwise(F.lit("r20240102")).alias("run_ts"))
    writers.write_report(rows, path)
    writers.write_report(rows.where("target_label = 's1'"), path)
    return t.spark.read.parquet(path).groupBy(F.substring("target_label", 2, 9).alias("target_label"), F.substring("run_ts", 2, 8).alias("run_ts")).agg(F.count(F.lit(1)).alias("n"))


@query("src12_dataset_catalog", "SELECT answer_type AS evaluator, count(*) AS case_count FROM v_cases GROUP BY answer_type")
def _(t):
    docs = t.cases.select("answer_type", F.to_json(F.struct("id", F.struct(F.col("answer_type").alias("evaluator")).alias("eval"))).alias("value"))
    path = scratch_path(t.spark, "datasets")
    spaced = docs.select("answer_type", F.explode(F.array(F.col("value"), F.lit("  "))).alias("value"))
    spaced.write.partitionBy("answer_type").text(path)
    return catalog.dataset_catalog(t.spark, f"{path}/*").groupBy("evaluator").agg(F.sum("case_count").alias("case_count"))


@query("src12_user_files", "SELECT DISTINCT concat('user_id=', CAST(c_nationkey AS VARCHAR)) AS user_folder FROM customer")
def _(t):
    path = scratch_path(t.spark, "users")
    t.raw("customer").select(F.col("c_nationkey").alias("user_id"), "c_name").write.partitionBy("user_id").json(path)
    return catalog.user_files(t.spark, path).where(F.startswith("user_folder", F.lit("user_id="))).select("user_folder").distinct()


@query("src13_report_index", "SELECT DISTINCT o_orderstatus AS benchmark, replace(o_orderpriority, ' ', '-') AS dataset, 'gpt' AS label, strftime(o_orderdate, '%Y0101') AS date FROM orders")
def _(t):
    path = scratch_path(t.spark, "index")
    names = t.raw("orders").select(F.col("o_orderstatus").alias("benchmark"), F.concat(
        F.replace("o_orderpriority", F.lit(" "), F.lit("-")), F.lit("_gpt_"), F.date_format("o_orderdate", "yyyy0101"), F.lit(".json")).alias("f")).distinct()
    names.withColumn("content", F.lit("{}")).write.partitionBy("benchmark", "f").text(path)
    listing = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.regexp_extract("path", "benchmark=([^/]+)", 1).alias("benchmark"), F.regexp_extract("path", "f=([^/]+)/", 1).alias("filename"))
    known = t.raw("orders").select(F.replace("o_orderpriority", F.lit(" "), F.lit("-")).alias("dataset")).distinct()
    return catalog.index_reports(listing, known).select("benchmark", "dataset", "label", "date")


@query("src14_build_tables", "SELECT user_id, count(*) AS n, CASE WHEN max(value_num) > 300 THEN max(value_num) * 2 ELSE max(value_num) END AS top FROM v_readings GROUP BY user_id")
def _(t):
    path = scratch_path(t.spark, "tables")
    writers.build_tables(t.readings, path, 16)
    # Users with a peak have changed: their values have doubled.
    changed = t.readings.where("value_num > 300").select("user_id").distinct()
    marked = t.readings.join(changed.withColumn("_changed", F.lit(True)), "user_id", "left")
    doubled = marked.withColumn("value_num", F.when(F.col("_changed"), F.col("value_num") * 2).otherwise(F.col("value_num"))).drop("_changed")
    writers.build_tables(doubled, path, 16, changed_users=changed)
    return t.spark.read.parquet(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value_num").alias("top"))


@query("src14_snapshots", """SELECT user_id, count(*) AS n, CASE WHEN max(value_num) > 300 THEN max(value_num) * 2 ELSE max(value_num) END AS top,
       CAST(count(*) FILTER (value_num < 300) AS BIGINT) AS before FROM v_readings GROUP BY user_id""")
def _(t):
    """Values of users with a peak double in the second version; the library finds their buckets. `before` counts the first version's rows."""
    table = Snapshots(scratch_path(t.spark, "snapshots"), n_buckets=16)
    table.update(t.readings, ["user_id", "indicator", "time"], ["indicator"])
    first = table.current(t.spark)[1]
    changed = t.readings.where("value_num > 300").select("user_id").distinct()
    marked = t.readings.join(changed.withColumn("_changed", F.lit(True)), "user_id", "left")
    doubled = marked.withColumn("value_num", F.when(F.col("_changed"), F.col("value_num") * 2).otherwise(F.col("value_num"))).drop("_changed")
    table.update(doubled, ["user_id", "indicator", "time"], ["indicator"])
    old = table.read(t.spark, first).groupBy("user_id").agg(F.count_if(F.col("value_num") < 300).alias("before"))
    return table.read(t.spark).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value_num").alias("top")).join(old, "user_id")


@query("src15_file_fingerprint", "SELECT strftime(o_orderdate, '%Y-%m') AS month, substring(sha256(concat(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey), chr(10))), 1, 16) AS fingerprint FROM orders GROUP BY 1")
def _(t):
    """One file of order keys per month."""
    path = scratch_path(t.spark, "print")
    keys = t.raw("orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderkey").cast("string").alias("value"), "o_orderkey")
    keys.repartition("month").sortWithinPartitions("month", "o_orderkey").select("month", "value").write.partitionBy("month").text(path)
    return catalog.file_fingerprint(t.spark, path).select(F.regexp_extract("path", "month=([0-9-]+)", 1).alias("month"), "fingerprint")
