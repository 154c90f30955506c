"""Readers, writers and streams on small hand-made files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from scorelake.operators.adhoc import bounded_sql
from scorelake.sources import catalog, readers, writers
from scorelake.streaming import streams as st


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_cases_skip_blank_and_fail_on_bad_lines(spark, tmp_path):
    good = json.dumps({"id": "a", "eval": {"evaluator": "x", "expected_value": ["p", "q"]}, "tags": ["t"]})
    path = put(tmp_path / "c.jsonl", f"{good}\n\n{good}\n")
    assert readers.read_cases(spark, path).count() == 2
    bad = put(tmp_path / "bad.jsonl", f"{good}\n{{broken\n")
    with pytest.raises(Exception):
        readers.read_cases(spark, bad).collect()


def test_csv_with_multi_line_note(spark, tmp_path):
    path = put(tmp_path / "c.csv", 'Row Number,Patient Note,Ground Truth Answer\n1,"line one\nsaid ""hi""",5\n')
    row = readers.read_case_csv(spark, path).first()
    assert (row["row_number"], row["patient_note"], row["ground_truth"]) == ("1", 'line one\nsaid "hi"', "5")


def test_timeline_user_from_document_or_folder(spark, tmp_path):
    entries = [{"entry_type": "device_indicator", "time": "2024-01-01T08:00:00", "indicator": "HR", "value": 61, "unit": "bpm"},
               {"entry_type": "device_indicator", "time": "2024-01-01T09:00:00", "indicator": "HR", "value": None},
               {"entry_type": "exam_indicator", "time": "2024-01-02", "indicator": "LDL", "value": "high", "exam_type": "blood"},
               {"entry_type": "event", "time": "2024-01-03", "event": {"event_id": "e", "event_name": "n", "start_date": "2024-01-03", "duration_days": 2}}]
    put(tmp_path / "u1_AT_x" / "timeline.json", json.dumps({"entries": entries}, indent=1))
    put(tmp_path / "dir" / "b_timeline.json", json.dumps({"user_id": "u2", "entries": entries[:1]}))
    tables = readers.read_timeline(spark, f"{tmp_path}/*/*timeline.json")
    got = sorted((r["user_id"], r["value"], r["value_num"]) for r in tables["readings"].where("value IS NOT NULL").collect())
    assert got == [("u1@x", "61", 61.0), ("u2", "61", 61.0)]
    assert tables["readings"].where("value IS NULL").count() == 1
    assert tables["exams"].first()["value_num"] is None
    assert str(tables["events"].first()["end_time"]) == "2024-01-05 00:00:00"


def test_exams_as_map_and_list(spark, tmp_path):
    docs = [{"exam_date": "2024-01-01", "exam_type": "t", "indicators": {"LDL": {"value": 3, "unit": "u"}}},
            {"date": "2024-02-01", "indicators": [{"indicator_key": "hdl", "value": "1.5", "timestamp": "2024-02-01 07:00:00"}, 5]}]
    path = put(tmp_path / "u" / "exam_data.json", json.dumps(docs))
    rows = {r["indicator"]: r for r in readers.read_exams(spark, path).collect()}
    assert rows["LDL"]["value_num"] == 3.0 and str(rows["LDL"]["time"]) == "2024-01-01 00:00:00"
    assert rows["hdl"]["exam_date"] == "2024-02-01" and str(rows["hdl"]["time"]) == "2024-02-01 07:00:00"


def test_device_days_survive_a_cut_tail(spark, tmp_path):
    day = json.dumps({"date": "2024-01-01", "indicators": [{"indicator_key": "hr", "value_num": None, "value": "60"}, {"indicator_key": "s", "value_num": 5, "value": "x"}]})
    path = put(tmp_path / "u" / "days.jsonl", day + "\n" + day[:40])
    assert sorted(r["value_num"] for r in readers.read_device_days(spark, path).collect()) == [5.0, 60.0]


def test_queries_as_object_or_list(spark, tmp_path):
    q = {"query_id": "1_Q1", "ground_truth": {"answer_type": "list", "expected_value": ["a"], "source_data": {"data_type": "device"}}}
    put(tmp_path / "a.json", json.dumps({"evaluation_queries": [q]}))
    put(tmp_path / "b.json", json.dumps([q, q]))
    rows = readers.read_queries(spark, f"{tmp_path}/*.json").collect()
    assert len(rows) == 3 and rows[0]["expected_value"] == '["a"]'


def test_reports_skip_metadata(spark, tmp_path):
    case = {"id": "c1", "eval": {"result": "pass", "score": 1.0, "feedback": "f"}, "tags": ["a"], "start": "2024-01-01T00:00:00"}
    put(tmp_path / "r_20240101.json", json.dumps({"benchmark_name": "b", "dataset_name": "d", "cases": [case, case]}, indent=1))
    put(tmp_path / "metadata.json", "{}")
    runs, results = readers.read_reports(spark, str(tmp_path))
    assert runs.count() == 1 and [r["result"] for r in results.collect()] == ["pass", "pass"]


def test_log_skips_broken_and_submission_needs_answer(spark, tmp_path):
    put(tmp_path / "log" / "l.jsonl", '{"id": "a", "eval": {"result": "pass"}}\n{"id": "b", "ev')
    assert [r["id"] for r in readers.read_result_log(spark, f"{tmp_path}/log").collect()] == ["a"]
    put(tmp_path / "sub" / "s.jsonl", '{"id": "a", "answer": "x", "cost": {"m": {"input_tokens": 3}}}\n{"id": "b", "answer": ""}')
    subs = readers.read_submissions(spark, f"{tmp_path}/sub")
    assert subs.count() == 1 and readers.usage_rows(subs).first()["input_tokens"] == 3


def test_catalog_and_index(spark, tmp_path):
    put(tmp_path / "data" / "core.jsonl", '\n{"eval": {"evaluator": "first"}}\n\n{"eval": {"evaluator": "second"}}\n')
    row = catalog.dataset_catalog(spark, f"{tmp_path}/data/*.jsonl").first()
    assert (row["name"], row["case_count"], row["evaluator"]) == ("core.jsonl", 2, "first")
    for name in ("core_gpt_20240102.json", "core_20240301_101010.json", "notes.json"):
        put(tmp_path / "rep" / "bench" / name, "{}")
    known = spark.createDataFrame([("core",)], "dataset string")
    got = [(r["dataset"], r["label"], r["date"]) for r in catalog.report_index(spark, f"{tmp_path}/rep", known).collect()]
    assert got == [("core", None, "20240301_101010"), ("core", "gpt", "20240102")]
    assert len(catalog.file_fingerprint(spark, f"{tmp_path}/data").first()["fingerprint"]) == 16


def test_tables_are_rebuilt_for_changed_users_only(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 4 AS user_id", "'i' AS indicator", "timestamp '2024-01-01 00:00:00' AS time", "1.0D AS value_num")
    path = str(tmp_path / "t")
    writers.build_tables(rows, path, 8)
    doubled = rows.withColumn("value_num", F.lit(2.0))
    writers.build_tables(doubled, path, 8, changed_users=spark.createDataFrame([(1,)], "user_id long"))
    assert readers_sum(spark, path, 1, 8) == 20.0
    assert spark.read.parquet(path).count() == 40


def readers_sum(spark, path, user, n):
    return writers.read_user(spark, path, user, n).agg(F.sum("value_num")).first()[0]


def test_bounded_sql(spark):
    df = spark.range(500).select("id", F.repeat(F.lit("x"), 400).alias("t"))
    assert len(bounded_sql(spark, "SELECT * FROM {d}", {"d": df}).where("length(t) = 400 AND NOT truncated").collect()) == 500
    got = bounded_sql(spark, "SELECT * FROM {d};", {"d": df}, 200, 300).collect()
    assert len(got) == 200 and got[0]["truncated"] and len(got[0]["t"]) == 300
    assert not bounded_sql(spark, "WITH a AS (SELECT 1 AS created_at) SELECT * FROM a", {}).first()["truncated"]
    for bad in ("DROP TABLE x", "SELECT 1; DROP TABLE x"):
        with pytest.raises(ValueError):
            bounded_sql(spark, bad, {})


def line(i, at="2024-01-01T00:00:00Z", result="pass", score=1.0, run="r"):
    return json.dumps({"run_id": run, "id": i, "result": result, "score": score, "tags": ["t"], "finished_at": at})


def test_stream_keeps_late_lines_and_one_row_per_case(spark, tmp_path):
    folder, table, sums, ck = (str(tmp_path / n) for n in ("in", "table", "sums", "ck"))
    put(tmp_path / "in" / "a.jsonl", f"{line('1')}\n{line('2', '2024-06-01T00:00:00Z')}\n{line('1')}\n{{broken\n")
    run = lambda: st.run_available(st.first_finished(st.stream_results(spark, folder)), ck, st.append_changes(table, st.keep_totals(sums, st.tag_totals)), "update")
    stats = lambda: st.tag_stats(st.read_totals(spark, sums, ["tag"])).first()
    run()
    assert stats()["total"] == 2
    # After a restart: a line from months before the newest one, a repeated one, and one without a score.
    put(tmp_path / "in" / "b.jsonl", f"{line('2')}\n{line('3', '2023-01-01T00:00:00Z', 'fail', 0.0)}\n{line('4', score=None)}\n")
    run()
    assert tuple(stats()) == ("t", 4, 3, 1, 0.75, round(2 / 3, 6))
    assert st.current_results(spark, table).count() == 4
    cases = spark.range(6).selectExpr("id")
    got = {(r["result"], r["n"], r["completed"], r["total"]) for r in st.progress_snapshot(st.status_totals(st.current_results(spark, table)), cases).collect()}
    assert got == {("pass", 3, 4, 6), ("fail", 1, 4, 6), (None, 2, 4, 6)}


def test_borders_of_micro_batches_change_no_answer(spark, tmp_path):
    lines = [line("1", "2024-05-02T00:00:00Z", "fail", 0.0), line("1", "2024-05-01T00:00:00Z"), line("2", "2024-01-01T00:00:00Z"), line("2", "2024-02-01T00:00:00Z", "fail", 0.25),
             line("3", None, "fail", 0.5), line("3", "2024-07-01T00:00:00Z")]
    answers = set()
    for name, cuts in (("one", [6]), ("two", [1, 5]), ("each", [1] * 6)):
        folder, rest = tmp_path / name / "in", list(lines)
        table, sums, ck = (str(tmp_path / name / x) for x in ("table", "sums", "ck"))
        for i, size in enumerate(cuts):
            put(folder / f"{i}.jsonl", "\n".join(rest[:size]) + "\n")
            rest = rest[size:]
            st.run_available(st.first_finished(st.stream_results(spark, str(folder))), ck, st.append_changes(table, st.keep_totals(sums, st.tag_totals)), "update")
        rows = tuple(sorted((r["id"], r["result"], r["score"]) for r in st.current_results(spark, table).collect()))
        answers.add((rows, tuple(st.tag_stats(st.read_totals(spark, sums, ["tag"])).first())))
    assert len(answers) == 1
    rows, stats = answers.pop()
    assert [r[1] for r in rows] == ["pass"] * 3 and stats[:4] == ("t", 3, 3, 0)


def test_changes_are_written_once(spark, tmp_path):
    """Next to the log lies no second copy of its micro-batches; lines taken back are added to the new ones."""
    table = str(tmp_path / "table")
    rows = spark.createDataFrame([("r", str(i), "pass", 1.0, ["t"], None, True, False) for i in range(3)], st.RESULT_LINE + ", _changed BOOLEAN, _again BOOLEAN")
    seen = []
    append = st.append_changes(table, lambda changes, number: seen.append(sorted((r["id"], r["result"], r["sign"]) for r in changes.collect())))
    append(rows, 0)
    append(rows.where("id = '1'").withColumns({"result": F.lit("fail"), "_again": F.lit(True)}), 1)
    assert [f.name for f in tmp_path.iterdir()] == ["table"]
    assert seen[1] == [("1", "fail", 1), ("1", "pass", -1)]
    assert sorted((r["id"], r["result"]) for r in st.current_results(spark, table).collect()) == [("0", "pass"), ("1", "fail"), ("2", "pass")]


def test_the_result_log_is_compressed_and_holds_every_line_twice(spark):
    from pathlib import Path

    from scorelake.plans.fixtures import Tables
    from scorelake.plans.q_live import result_lines
    t = Tables(spark, "/root/testdata/sf0.001")
    path = result_lines(t)
    assert {f.suffix for f in Path(path.removeprefix("file:")).glob("part-*")} == {".gz"}
    lines = spark.read.text(path).groupBy("value").count()
    assert lines.where("count % 2 = 1").isEmpty() and lines.agg(F.sum("count")).first()[0] == 2 * t.results.count()


def test_a_micro_batch_that_runs_again_replaces_itself(spark, tmp_path):
    table = str(tmp_path / "table")
    rows = spark.createDataFrame([("r", "1", "pass", 1.0, ["t"], None, True, False)], st.RESULT_LINE + ", _changed BOOLEAN, _again BOOLEAN")
    append = st.append_changes(table)
    for _ in range(2):
        append(rows, 0)
    for _ in range(2):
        append(rows.withColumn("result", F.lit("fail")).withColumn("_again", F.lit(True)), 1)
    append(rows.withColumn("_changed", F.lit(False)), 2)
    assert [r["result"] for r in st.current_results(spark, table).collect()] == ["fail"]


def test_week_is_summed_up_when_it_closes(spark, tmp_path):
    folder, ck, seen = tmp_path / "in", str(tmp_path / "ck"), []
    reading = lambda time, v: json.dumps({"user_id": 1, "indicator": "i", "time": f"{time}:00Z", "value_num": v})

    def run():
        source = spark.readStream.schema("user_id BIGINT, indicator STRING, time TIMESTAMP, value_num DOUBLE").json(str(folder))
        st.run_available(st.stream_week_trends(source, "7 days"), ck, lambda df, _: seen.extend(tuple(r) for r in df.collect()))
    put(folder / "a.jsonl", "\n".join([reading("2024-01-04T08:00", 4.0), reading("2024-01-02T08:00", 1.0), reading("2024-01-07T23:59", 20.0), reading("2024-01-03T08:00", 1.0)]))
    run()
    assert seen == []
    # Late, but within the delay; then a reading that closes the first week, and one that comes too late for it.
    put(folder / "b.jsonl", reading("2024-01-02T07:00", 2.0) + "\n" + reading("2024-01-14T08:00", 3.0))
    run()
    assert seen == []
    put(folder / "c.jsonl", reading("2024-01-16T08:00", 3.0))
    run()
    put(folder / "d.jsonl", reading("2024-01-02T06:00", 900.0))
    run()
    # In order of time: 2, 1 | 1, 4, 20.
    assert [(str(s[1]), *s[3:]) for s in seen] == [("2024-01-01", 5, 28.0 / 5, 1.0, 20.0, "rising", True)]


def test_weeks_of_many_users_share_the_state_of_a_bucket(spark, tmp_path):
    folder, ck, seen = tmp_path / "in", str(tmp_path / "ck"), []
    reading = lambda user, indicator, time, v: json.dumps({"user_id": user, "indicator": indicator, "time": f"{time}:00Z", "value_num": v})
    big, days = 2**53 + 1, ("2024-01-02T08:00", "2024-01-03T08:00", "2024-01-04T08:00", "2024-01-05T08:00")
    values = {(1, "i"): [1.0, 1.0, 4.0, 20.0], (1, "j"): [9.0, 9.0, 1.0, 1.0], (big, "i"): [5.0, 5.0, 5.0, 5.0], (None, "i"): [2.0, 2.0, 2.0]}

    def run():
        source = spark.readStream.schema("user_id BIGINT, indicator STRING, time TIMESTAMP, value_num DOUBLE").json(str(folder))
        st.run_available(st.stream_week_trends(source, "7 days", buckets=1), ck, lambda df, _: seen.extend(tuple(r) for r in df.collect()))
    for name, some in (("b", (3, 1)), ("a", (0, 2))):
        put(folder / f"{name}.jsonl", "\n".join(reading(*k, days[d], v[d]) for k, v in values.items() for d in some if d < len(v)))
        run()
    put(folder / "c.jsonl", reading(7, "i", "2024-02-20T08:00", 3.0))
    run()
    assert {(r[0], r[2]): r[3:] for r in seen} == {
        (1, "i"): (4, 6.5, 1.0, 20.0, "rising", True), (1, "j"): (4, 5.0, 1.0, 9.0, "falling", True),
        (big, "i"): (4, 5.0, 5.0, 5.0, "stable", False), (None, "i"): (3, 2.0, 2.0, 2.0, "stable", False)}
    assert len(seen) == 4 and {str(r[1]) for r in seen} == {"2024-01-01"}


def test_weekly_stream_in_update_mode_bounds_its_state(spark, tmp_path):
    folder, ck, seen = tmp_path / "in", str(tmp_path / "ck"), []
    reading = lambda day, v: json.dumps({"user_id": 1, "indicator": "i", "time": f"{day}T08:00:00Z", "value_num": v})

    def run():
        source = spark.readStream.schema("user_id BIGINT, indicator STRING, time TIMESTAMP, value_num DOUBLE").json(str(folder))
        st.run_available(st.stream_weekly_stats(source, "7 days"), ck, lambda df, _: seen.extend((str(r["week"]["start"])[:10], r["n"], r["max"]) for r in df.collect()), "update")
    put(folder / "a.jsonl", reading("2024-01-02", 1.0) + "\n" + reading("2024-01-09", 2.0))
    run()
    assert sorted(seen) == [("2024-01-01", 1, 1.0), ("2024-01-08", 1, 2.0)]
    put(folder / "b.jsonl", reading("2024-01-08", 5.0) + "\n" + reading("2024-03-01", 3.0))
    run()
    assert ("2024-01-08", 2, 5.0) in seen
    put(folder / "c.jsonl", reading("2024-01-02", 9.0))
    run()
    assert not any(m == 9.0 for _, _, m in seen)


def test_ingest_takes_all_files_of_a_batch_and_swaps_once(spark, tmp_path):
    folder, table, staging, ck = (str(tmp_path / n) for n in ("in", "table", "staging", "ck"))
    spark.createDataFrame([("a", 1), ("keep", 9)], "batch string, id long").write.partitionBy("batch").parquet(table)
    manifest = spark.createDataFrame([("a", "new"), ("keep", "same"), ("b", "x")], "batch string, checksum string")
    local = spark.createDataFrame([("a", "old"), ("keep", "same")], "batch string, checksum string")
    rows = lambda *ids: "\n".join(json.dumps({"batch": b, "id": i}) for b, i in ids)
    put(tmp_path / "in" / "1.jsonl", rows(("a", 2), ("keep", 8)))
    run = lambda **k: st.ingest_changed(spark, folder, "batch STRING, id BIGINT", manifest, local, table, staging, ck, **k)
    have = lambda: sorted((r["batch"], r["id"]) for r in spark.read.parquet(table).collect())
    run(versions=("7", "7"))
    assert have() == [("a", 1), ("keep", 9)]
    ck = str(tmp_path / "ck2")
    run()
    put(tmp_path / "in" / "2.jsonl", rows(("a", 3), ("b", 4)))
    run(versions=("8", "7"))
    assert have() == [("a", 2), ("a", 3), ("b", 4), ("keep", 9)]


# --- arrays of days in byte ranges -------------------------------------------------------------------


def _days(r, n):
    """Days whose strings hold quotes, braces, backslashes and other scripts."""
    odd = ['a "quoted" {brace}', "back\\slash\\", "]}[{,", "日本 é", "", '\\"}', "tab\tline\n"]
    return [{"date": f"2024-{1 + i // 28 % 12:02d}-{1 + i % 28:02d}", "note": r.choice(odd),
             "indicators": [{"indicator_key": f"k{j}", "indicator_name": r.choice(odd), "value_num": None if j % 2 else float(i), "value": str(i) if j % 2 else None,
                             "unit": "u", "meta": {"deep": [r.choice(odd), {"x": [1, {"y": "}"}]}]}} for j in range(r.randint(0, 4))]} for i in range(n)]


def _days_by_force(text):
    """Whole objects of the outer array, one by one, up to the first that can't be read."""
    decode, at, out = json.JSONDecoder().raw_decode, text.find("[") + 1, []
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        try:
            day, at = decode(text, at)
        except ValueError:
            return out
        out.append(day)


def _readings_of(days):
    return sorted((d["date"], i["indicator_key"], i["value_num"] if i["value_num"] is not None else float(i["value"])) for d in days for i in d["indicators"])


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_arrays_of_days_in_ranges(spark, tmp_path, small_ranges):
    r = random.Random(12)
    texts = []
    for i, indent in enumerate((None, 1, None, 2)):
        text = json.dumps(_days(r, 60), indent=indent, ensure_ascii=bool(i % 2))
        texts += [text, text[: r.randrange(len(text))], text[: r.randrange(len(text))]]
    # Damage in the middle, a cut just before and just after a brace, a big first day, and files with nothing in them.
    whole = json.dumps(_days(r, 40))
    middle = whole.index('{"date"', len(whole) // 2)
    texts += [whole[:middle] + '{"date": nonsense}, ' + whole[middle:], whole[: whole.rindex("}")], whole[: whole.rindex("}") + 1],
              json.dumps([{"date": "2024-01-01", "note": "x{" * 9000, "indicators": [{"indicator_key": "a", "value_num": 1.0}]}] + _days(r, 3)), "", "[]", "[", "no json"]
    for i, text in enumerate(texts):
        put(tmp_path / f"u{i}" / "device.json", text)
    got = {}
    for row in readers.read_device_days(spark, f"{tmp_path}/*", lines=False).collect():
        got.setdefault(row["user_id"], []).append((row["day"].isoformat(), row["indicator"], row["value_num"]))
    users = {readers_user: sorted(rows) for readers_user, rows in got.items()}
    want = {f"u{i}": _readings_of(_days_by_force(t)) for i, t in enumerate(texts)}
    by_folder = {r["user_id"]: r["p"] for r in spark.createDataFrame([(f"{tmp_path}/u{i}/device.json", f"u{i}") for i in range(len(texts))], "path string, p string").select(
        readers._path_user(F.col("path")).alias("user_id"), "p").collect()}
    assert {by_folder[u]: rows for u, rows in users.items()} == {u: rows for u, rows in want.items() if rows}


def test_a_cut_array_of_fifty_megabytes_is_read_by_several_tasks(spark, tmp_path):
    day = {"indicators": [{"indicator_key": f"k{j}", "value_num": 1.5, "meta": {"text": "{" * 900}} for j in range(60)]}
    body = ",\n".join(json.dumps({"date": f"{2000 + i // 336}-{1 + i // 28 % 12:02d}-{1 + i % 28:02d}", **day}) for i in range(900))
    text = "[" + body
    put(tmp_path / "u" / "big.json", text[: len(text) - 30_000])
    assert len(text) > 50_000_000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        from scorelake.sources.json_array import read_json_array
        objects = read_json_array(spark, str(tmp_path / "u"))
        assert objects.select("start").distinct().count() >= 2
        got = readers.read_device_days(spark, str(tmp_path / "u"), lines=False).groupBy("day").agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 899 and {r["n"] for r in got} == {60}


def test_states_of_ranges_do_not_pass_through_the_program(spark, tmp_path, monkeypatch):
    from scorelake.sources.json_array import read_json_array
    days = [{"date": "2024-01-01", "n": i, "text": 'a "{[" b' * 40} for i in range(400)]
    put(tmp_path / "u" / "days.json", json.dumps(days))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        with monkeypatch.context() as m:
            m.setattr(type(spark.range(1)), "collect", lambda self: pytest.fail("collected"))
            objects = read_json_array(spark, str(tmp_path / "u"))
        got = [json.loads(r["text"]) for r in objects.orderBy("start", "n").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == days


def test_snapshots_find_what_changed_and_swap_at_once(spark, tmp_path, monkeypatch):
    from scorelake.sources.snapshots import BUCKET, Snapshots
    table = Snapshots(str(tmp_path / "t"), n_buckets=8)
    rows = spark.range(400).selectExpr("id % 40 AS user_id", "CAST(id AS DOUBLE) AS value", "array(id) AS list")
    assert table.read(spark) is None
    assert table.update(rows)[0] == 1
    first, name = table.read(spark), table.current(spark)[1]
    # The same rows in another order change nothing; a changed, a new and a lost user change their buckets only.
    version, changed = table.update(rows.repartition(5).orderBy(F.desc("value")))
    assert version == 2 and changed.count() == 0
    other = rows.where("user_id <> 3").withColumn("value", F.when(F.col("user_id") == 7, F.lit(-1.0)).otherwise(F.col("value")))
    bucket = {r["user_id"]: r["b"] for r in rows.select("user_id", F.pmod(F.xxhash64("user_id"), F.lit(8)).alias("b")).distinct().collect()}
    _, changed = table.update(other)
    assert {r[BUCKET] for r in changed.collect()} == {bucket[3], bucket[7]}
    assert sorted(map(tuple, table.read(spark).collect())) == sorted(map(tuple, other.collect()))
    # A reader of the first version still sees it, also by its name.
    assert first.count() == 400 and table.read(spark, name).agg(F.sum("value")).first()[0] == sum(range(400))
    # A writer that dies before the marker leaves the old version; two writers can't make the same one.
    monkeypatch.setattr(Snapshots, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        table.update(rows)
    monkeypatch.undo()
    assert table.read(spark).count() == other.count()
    # One that dies within the marker leaves a number that is passed over.
    (tmp_path / "t" / "versions" / "4").write_text("")
    assert table.current(spark)[0] == 3 and table.update(rows)[0] == 5
    with pytest.raises(RuntimeError):
        table._commit(spark, 5, "y")
    assert table.read(spark).count() == 400


def test_deep_pages_read_the_ranges_they_lie_in(spark, tmp_path):
    from scorelake.operators.readings import PageIndex
    df = spark.range(0, 5000, 1, 7).select(F.xxhash64("id").alias("v"), "id")
    index = PageIndex(df, [F.desc("v"), F.col("id")], str(tmp_path / "pages"))
    want = [r["id"] for r in df.orderBy(F.desc("v"), "id").collect()]
    assert index.total == 5000
    for offset, size in ((0, 10), (4321, 50), (4990, 50), (6000, 5), (2500, 1)):
        rows = sorted(index.page(offset, size).collect(), key=lambda r: r["_row"])
        assert [r["id"] for r in rows] == want[offset: offset + size]
        assert len(index.parts(offset, size)) <= 2 and all(r["next_offset"] == (offset + size if offset + size < 5000 else None) for r in rows)
    assert PageIndex(df.limit(0), [F.col("v")], str(tmp_path / "none")).page(0, 5).count() == 0


def test_fingerprint_of_a_file_over_two_gigabytes(spark, tmp_path):
    import hashlib
    (tmp_path / "big").mkdir()
    with open(tmp_path / "big" / "sparse 1.bin", "wb") as f:
        f.write(b"start")
        f.truncate(3 << 30)
    put(tmp_path / "big" / "small.txt", "small")
    want = hashlib.sha256(b"start")
    zeros = bytes(1 << 24)
    left = (3 << 30) - 5
    while left:
        want.update(zeros[: min(left, len(zeros))])
        left -= min(left, len(zeros))
    got = {r["file"]: r["fingerprint"] for r in catalog.file_fingerprint(spark, str(tmp_path / "big")).collect()}
    assert sorted(got.values()) == sorted([want.hexdigest()[:16], hashlib.sha256(b"small").hexdigest()[:16]])
    pieces = catalog.file_fingerprint(spark, str(tmp_path / "big" / "small.txt"), whole=1).first()
    assert pieces["fingerprint"] == hashlib.sha256(b"small").hexdigest()[:16]
