"""Schemas of the files that are read. JSON is never inferred: unions would change from file to file."""

from __future__ import annotations

MESSAGE = "STRUCT<role: STRING, type: STRING, content: STRING>"
PERSONA = "STRUCT<disclosure: STRING, attitude: STRING, cognition: STRING, logic: STRING, expression: STRING>"
USER = (f"STRUCT<type: STRING, goal: STRING, context: STRING, strict_inputs: ARRAY<STRING>, max_turns: INT,"
        f" finish_condition: STRING, persona: {PERSONA}, target_overrides: MAP<STRING, MAP<STRING, STRING>>>")
# `eval` is an open union on `evaluator`, so it stays a VARIANT.
CASE = f"id STRING, title STRING, description STRING, user {USER}, eval VARIANT, history ARRAY<{MESSAGE}>, tags ARRAY<STRING>"

EVENT = ("STRUCT<event_id: STRING, event_type: STRING, event_name: STRING, start_date: STRING, duration_days: INT,"
         " interrupted: BOOLEAN, interruption_date: STRING>")
ENTRY = (f"STRUCT<entry_type: STRING, time: STRING, indicator: STRING, device_type: STRING, exam_type: STRING,"
         f" exam_location: STRING, value: STRING, unit: STRING, end_time: STRING, event: {EVENT}>")
TIMELINE = f"user_id STRING, entries ARRAY<{ENTRY}>"

EXAM = "exam_date STRING, date STRING, exam_type STRING, exam_location STRING, indicators VARIANT"
DEVICE_DAY = ("date STRING, indicators ARRAY<STRUCT<indicator_key: STRING, indicator_name: STRING, value_num: DOUBLE,"
              " value: STRING, unit: STRING>>")
LIFE_EVENT = ("event_id STRING, event_name STRING, event_type STRING, description STRING, start_date STRING, time STRING,"
              " end_time STRING, duration_days INT, interrupted BOOLEAN, interruption_date STRING,"
              " medications ARRAY<STRUCT<name: STRING, dose: STRING, frequency: STRING, timing: STRING>>,"
              " affected_indicators ARRAY<STRUCT<indicator_name: STRING, indicator_key: STRING, expected_change: STRING,"
              " impact_level: STRING, time_to_effect: STRING, fade_out_days: INT>>")

TRUTH = "STRUCT<answer_type: STRING, expected_value: STRING, key_points: ARRAY<STRING>, source_data: VARIANT>"
QUERY = f"query_id STRING, query_text STRING, difficulty STRING, ground_truth {TRUTH}"
QUERIES = (f"evaluation_queries ARRAY<STRUCT<query_id: STRING, query_text: STRING, difficulty: STRING, ground_truth: {TRUTH}>>, "
           + QUERY)

TOKENS = "STRUCT<input_tokens: BIGINT, output_tokens: BIGINT, total_tokens: BIGINT>"
SUBMISSION = f"id STRING, answer STRING, start TIMESTAMP, end TIMESTAMP, cost MAP<STRING, {TOKENS}>"
RESULT_FIELDS = ("id: STRING, title: STRING, user_type: STRING, target_type: STRING, eval_type: STRING,"
                 " eval: STRUCT<result: STRING, score: DOUBLE, feedback: STRING>, start: TIMESTAMP, end: TIMESTAMP, tags: ARRAY<STRING>")
RESULT = ("id STRING, title STRING, user_type STRING, target_type STRING, eval_type STRING,"
          " eval STRUCT<result: STRING, score: DOUBLE, feedback: STRING>, start TIMESTAMP, end TIMESTAMP, tags ARRAY<STRING>")
REPORT = ("benchmark_name STRING, dataset_name STRING, runtime_target MAP<STRING, STRING>, started_at TIMESTAMP,"
          f" finished_at TIMESTAMP, cases ARRAY<STRUCT<{RESULT_FIELDS}>>")
