"""Golden tables for the text functions."""

import pytest
from pyspark.sql import functions as F

from scorelake.functions import text as tx


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", fn(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_contains_ci(spark):
    assert values(spark, ["Heart RATE", None, ""], lambda c: tx.contains_ci(c, " rate ")) == [True, False, False]
    assert values(spark, ["x", None], lambda c: tx.contains_ci(c, "")) == [True, True]


def test_match_name(spark):
    names = ["heart-rate", "HeartRate-HR", "heart", "", None]
    assert values(spark, names, lambda c: tx.match_name("HeartRate", c)) == [True, True, False, False, False]
    assert values(spark, ["anything"], lambda c: tx.match_name("  ", c)) == [True]
    # A query of punctuation alone has no compact form, so only the plain substring counts.
    assert values(spark, ["a-b", "ab"], lambda c: tx.match_name("-", c)) == [True, False]


def test_answer_line(spark):
    texts = ["Thought\nANSWER: 42 \nmore", "answer: 42", "ANSWER:7", "no line", "ANSWER: a\nANSWER: b"]
    assert values(spark, texts, tx.answer_line) == ["42", None, "7", None, "a"]


def test_numbers_of_dates_are_negative(spark):
    got = values(spark, ["on 2024-03-15", "1,234.56 and −7", "none"], lambda c: F.transform(tx.number_strings(c), tx.to_number))
    assert got == [[2024.0, -3.0, -15.0], [1234.56, -7.0], []]


@pytest.mark.parametrize("a,b,expected", [
    ("0", "0", True), ("0", "0.0000001", True), ("0", "0.1", True), ("0", "0.6", False), ("100", "101", True), ("100", "101.1", True),
    ("100", "102", False), ("0.124", "0.12", True), ("-5", "5", False), ("2.5", "2", True), ("3.5", "3", False),
])
def test_close_numbers(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(tx.close_numbers(F.col("a"), F.col("b"), F.lit(0.01))).first()[0] is expected


def test_data_status(spark):
    texts = ["I cannot find it", "HTTP 429", "没有找到", "fine"]
    assert values(spark, texts, tx.data_status) == ["data_not_found"] * 3 + ["data_found"]


def test_normalize_text(spark):
    texts = ["## **HeartRate** `x_y`", "[link](http://a) re-test; a/b", "血糖，偏高！", "ABCDef"]
    assert values(spark, texts, tx.normalize_text) == ["heart rate xy", "link re test a b", "血糖偏高", "abc def"]


def test_keyword_ratio(spark):
    df = spark.createDataFrame([("the heart beats", "heart rate"), ("血糖偏高", "血糖高"), ("a", "a"), ("b", "a"), ("x", "")], "g string, s string")
    got = [r[0] for r in df.select(tx.keyword_ratio(F.col("g"), F.col("s"))).collect()]
    assert got == [0.5, 0.5, 1.0, 0.0, 0.0]


def test_response_items(spark):
    table = "| # | Name |\n|---|---|\n| 1 | Glucose |\n| 2 | LDL |"
    lines = "Glucose\n5.6 mmol\nLDL\nHDL\nBMI\nHRV\nThe values are listed here and recorded below for you"
    texts = ["- Sleep\n- Steps\n- a\n- sleep", table, "Sleep; Steps", "Sleep, Steps, HRV", "Sleep, Steps", lines, "**bold**\n- one"]
    got = values(spark, texts, lambda c: tx.keep_first(tx.response_items(c)))
    assert got == [["Sleep", "Steps"], ["Glucose", "LDL"], ["Sleep", "Steps"], ["Sleep", "Steps", "HRV"], [],
                   ["Glucose", "LDL", "HDL", "BMI", "HRV"], []]


def test_word_match(spark):
    texts = ["no", "know", "note", "是no否", "so, no."]
    assert values(spark, texts, lambda c: tx.word_match("no", c)) == [True, False, False, False, True]


def test_weeks_days(spark):
    got = values(spark, ["(12 Weeks, 3 days)", "1 week 0 day", "12 weeks"], tx.weeks_days)
    assert [tuple(g) if g else None for g in got] == [(12, 3), (1, 0), None]


def test_parse_judge_json(spark):
    texts = ['{"score": 1}', 'x\n```json\n{"score": 2}\n```', 'I say {"score": 3} ok', "broken {"]
    assert values(spark, texts, lambda c: F.try_variant_get(tx.parse_judge_json(c), "$.score", "int")) == [1, 2, 3, None]


def test_char_windows(spark):
    texts = ["a" * 10, "a" * 11, "abcdefghijklmno", ""]
    got = values(spark, texts, lambda c: tx.char_windows(c, 10, 4))
    assert [[len(p) for p in g] for g in got] == [[10], [10, 5], [10, 9, 3], [0]]


def test_small_functions(spark):
    assert values(spark, ["a@b"], tx.user_to_folder) == ["a_AT_b"]
    assert values(spark, ["a_AT_b"], tx.folder_to_user) == ["a@b"]
    assert values(spark, ["Fasting Glucose-FBG"], tx.name_to_key) == ["fastingglucose_fbg"]
    assert values(spark, ["Creatinine Clearance (Cockcroft-Gault Equation)"], tx.slug) == ["creatinine_clearance_cockcroft_gault_equation"]
    assert values(spark, ["u_Q1_Q22", "plain"], tx.user_of_case) == ["u_Q1", "plain"]
