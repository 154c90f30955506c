"""Golden tables for the scorers."""

import pytest
from pyspark.sql import functions as F

from scorelake.operators import scoring as sc


def scores(df):
    return [round(r["score"], 6) for r in df.orderBy("id").collect()]


def answers(spark, rows):
    return spark.createDataFrame([(i, e, a) for i, (e, a) in enumerate(rows)], "id int, expected_value string, answer string")


def test_numeric(spark):
    rows = [("5.6", "ANSWER: 5.6"), ("5.6", "about 5.61"), ("5 and 7", "5 only"), ("5", "it is 9"), ("5", "I cannot find it, maybe 9"),
            ("5", "not found, but 5"), ("5", "unknown"), ("high", "very high"), ("5", "ANSWER: none\nfive is 5")]
    assert scores(sc.score_numeric(answers(spark, rows))) == [1.0, 1.0, 0.5, 0.2, 0.0, 1.0, 0.0, 1.0, 1.0]


def test_boolean(spark):
    rows = [("true", "yes"), ("false", "No, never"), ("true", "incorrect"), ("false", "incorrect"), ("true", "I know"), ("是", "是的")]
    assert scores(sc.score_boolean(answers(spark, rows))) == [1.0, 1.0, 0.0, 1.0, 0.0, 1.0]


def test_list(spark):
    rows = [("Sleep; Steps", "- Sleep\n- Steps"), ("Sleep; Steps", "- Sleep\n- Weight"), ("Sleep; Steps", "sleep"), ("Sleep", "ANSWER: none\nSleep"),
            (" ; ", "Sleep")]
    assert scores(sc.score_list(answers(spark, rows))) == [1.0, 0.5, round(2 * 0.5 * 0.5 / 1.0, 6), 1.0, 0.0]


def test_a_list_answer_is_normalised_once(spark):
    """Not within the lambda that looks for the words of the expected items."""
    rows = spark.createDataFrame([(1, "a red fox", "red fox; blue whale")], "id long, answer string, expected_value string")
    scored = sc.score_list(rows)
    assert scored.first()["score"] > 0
    assert "Contains(trim(lower(regexp_replace" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_by_type_routes_and_guards(spark):
    rows = [(0, "numeric_value", "5", "5"), (1, "boolean", "yes", "yes"), (2, "list", "Aa; Bb", "Aa; Bb"), (3, "text", "heart rate", "heart"),
            (4, "text", "x", ""), (5, "text", "x", "502 Bad Gateway"), (6, "odd", "x", "y")]
    df = spark.createDataFrame(rows, "id int, answer_type string, expected_value string, answer string")
    got = [(r["result"], r["score"]) for r in sc.score_by_type(df).orderBy("id").collect()]
    assert got == [("scored", 1.0), ("scored", 1.0), ("scored", 1.0), ("scored", 0.5), ("fail", 0.0), ("error", 0.0), ("fail", 0.0)]


def test_text_judge_falls_back(spark):
    df = spark.createDataFrame([(0, "heart rate", "heart", True, 0.9), (1, "heart rate", "heart", True, None), (2, "heart rate", "heart", False, 0.9)],
                               "id int, expected_value string, answer string, has_key_points boolean, verdict double")
    assert scores(sc.score_text_rule(df, judge="verdict")) == [0.9, 0.5, 0.5]


def test_typed(spark):
    rows = [(0, "decimal", "1,234.5", "1234", "1234", "1235"), (1, "decimal", "9", "1", "1", "2"), (2, "integer", "2.5", "2.9", "", ""),
            (3, "integer", "3.5", "3", "", ""), (4, "date", "1/2/2020", "01/02/2020", "", ""), (5, "date", "13/1/2020", "01/13/2020", "", ""),
            (6, "weeks_days", "3 weeks 2 days", "(3 weeks, 2 days)", "", ""), (7, "integer", "NONE", "1", "", ""), (8, "other", "1", "1", "", "")]
    df = spark.createDataFrame(rows, "id int, output_type string, extracted string, ground_truth string, lower_limit string, upper_limit string")
    assert [r["result"] for r in sc.score_typed(df).orderBy("id").collect()] == [
        "pass", "fail", "pass", "fail", "pass", "fail", "pass", "fail", "fail"]


def test_rubric(spark):
    items = spark.createDataFrame([(1, 0, 5), (1, 1, -3), (2, 0, -1), (3, 0, 2), (3, 1, -9), (4, 0, 2)], "case_id int, item_idx int, points int")
    met = spark.createDataFrame([(1, 0, True), (1, 1, True), (2, 0, True), (3, 0, True), (3, 1, True)], "case_id int, item_idx int, met boolean")
    got = {r["case_id"]: (r["result"], round(r["score"], 6), r["met_count"]) for r in sc.score_rubric(items, met).collect()}
    assert got == {1: ("scored", 0.4, 2), 2: ("fail", 0.0, 1), 3: ("scored", 0.0, 2), 4: ("scored", 0.0, 0)}


def test_criteria_defaults(spark):
    items = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 0), (2, "b", 0), (3, "a", 100)], "case_id int, name string, weight int")
    verdicts = spark.createDataFrame([(1, "a", 100), (2, "a", 100), (3, "a", 80)], "case_id int, name string, verdict int")
    got = {r["case_id"]: (round(r["score"], 6), r["result"]) for r in sc.score_criteria(items, verdicts, 0.7).collect()}
    assert got == {1: (0.665, "fail"), 2: (0.75, "pass"), 3: (0.8, "pass")}


@pytest.mark.parametrize("values,expected", [((5, 5), 1.0), ((1, 1), 0.0), ((3, 3), 0.5), ((None, 5), 0.75), ((9, 0), 0.5)])
def test_dimensions(spark, values, expected):
    items = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5)], "case_id int, name string, weight double")
    verdicts = spark.createDataFrame([(1, n, v) for n, v in zip("ab", values)], "case_id int, name string, verdict int")
    assert sc.score_dimensions(items, verdicts).first()["score"] == pytest.approx(expected)


def test_checkpoints(spark):
    schema = "conv_id int, turn int, type string, echo_keywords array<string>, max_chars int, max_seconds double, must_contain array<string>"
    ack = lambda conv, turn, kw=(): (conv, turn, "record_ack", list(kw), 20, 5.0, None)
    cps = spark.createDataFrame([(1, 1, "skip", None, 80, 5.0, None), ack(2, 1, ["128"]), ack(3, 1), ack(4, 1), ack(5, 1), ack(6, 2),
                                 (7, 1, "retrieval_data", None, 80, 5.0, ["LDL", "3.1"])], schema)
    turns = spark.createDataFrame([(1, 1, "x", 1.0), (2, 1, "noted 128", 1.0), (3, 1, "x" * 21, 1.0), (4, 1, "you should rest", 1.0),
                                   (5, 1, "ok", 9.0), (6, 1, "ok", 1.0), (7, 1, "ldl is 3.1", None)], "conv_id int, turn int, response string, latency_s double")
    got = {r["conv_id"]: r["score"] for r in sc.score_checkpoints(cps, turns).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: 1.0}


def test_flatten_dialogue(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 3, "user", "bye"), (1, 4, "assistant", "")],
                                  "conv_id int, turn int, role string, text string")
    one = lambda style: sc.flatten_dialogue(turns, style).first()["dialogue"]
    assert one("rubric") == "user: hi\n\nassistant: yo\n\nuser: bye"
    assert one("numbered") == "[Turn 1] 用户: hi\n[Turn 1] AI: yo\n[Turn 2] 用户: bye"


def test_ghost_turn_is_left_out(spark):
    turns = spark.createDataFrame([(1, 1, "user", "hi", False), (1, 2, "assistant", "yo", False), (1, 3, "user", "gone", True)],
                                  "conv_id int, turn int, role string, text string, ghost boolean")
    assert sc.flatten_dialogue(turns, "semantic").first()["dialogue"] == "User: hi\n\nAI Assistant: yo"
    assert sc.flatten_dialogue(turns, "numbered").first()["dialogue"].endswith("[Turn 2] 用户: gone")


def test_replies_are_clipped_only_on_request(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "x" * 2001)], "conv_id int, turn int, role string, text string")
    assert sc.flatten_dialogue(turns, "semantic").first()["dialogue"] == "AI Assistant: " + "x" * 2001
    clipped = sc.flatten_dialogue(turns, "semantic", assistant_chars=2000).first()["dialogue"]
    assert clipped == "AI Assistant: " + "x" * 2000 + "...(truncated)"


def test_digits_of_other_scripts_are_numbers(spark):
    df = spark.createDataFrame([("心率 １２０", "120"), ("٣٫ about ١٢", "12"), ("ANSWER:\u3000１,２３４．", "1234"), ("none", "7")], "answer string, expected_value string")
    assert [r["score"] for r in sc.score_numeric(df).collect()] == [1.0, 1.0, 1.0, 0.0]
    weeks = spark.createDataFrame([("１２ weeks, ３ days", "12 weeks 3 days")], "a string, b string")
    assert weeks.select(sc.match_weeks_days(F.col("a"), F.col("b"))).first()[0]


def test_cases_without_any_verdict(spark):
    items = spark.createDataFrame([(1, "a", 50), (1, "b", 50), (2, "a", 100)], "case_id int, name string, weight int")
    verdicts = spark.createDataFrame([(1, "a", 5), (2, "a", None)], "case_id int, name string, verdict int")
    got = {r["case_id"]: (r["score"], r["result"]) for r in sc.score_dimensions(items, verdicts).collect()}
    assert got == {1: (0.75, "pass"), 2: (0.0, "error")}
    hundreds = verdicts.withColumn("verdict", F.col("verdict") * 20)
    got = {r["case_id"]: (r["score"], r["result"]) for r in sc.score_criteria(items, hundreds, 0.5).collect()}
    assert got == {1: (0.75, "pass"), 2: (0.0, "fail")}


def test_score_all_routes_every_evaluator(spark):
    cases = spark.createDataFrame([
        ("q", "typed_qa", "120 bpm", "120", "numeric_value", None, None, None), ("l", "label", None, None, None, "hi", "yes", "engaged"),
        ("r", "rubric", None, None, None, None, None, None), ("r2", "rubric", None, None, None, None, None, None), ("c", "criteria", None, None, None, None, None, None),
        ("d", "dimensions", None, None, None, None, None, None), ("k", "checkpoints", None, None, None, None, None, None), ("x", "nobody", None, None, None, None, None, None),
        ("n", None, None, None, None, None, None, None)],
        "id string, evaluator string, answer string, expected_value string, answer_type string, opening string, reply string, label string")
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "rubric_items": one([("r", 0, 4), ("r", 1, 1), ("other", 0, 1)], "case_id string, item_idx int, points int"),
        "rubric_verdicts": one([("r", 0, True)], "case_id string, item_idx int, met boolean"),
        "criteria_items": one([("c", "a", 1)], "case_id string, name string, weight int"), "criteria_verdicts": one([("c", "a", 70)], "case_id string, name string, verdict int"),
        "dimension_items": one([("d", "a", 1)], "case_id string, name string, weight int"), "dimension_verdicts": one([("d", "a", 2)], "case_id string, name string, verdict int")}
    got = {r["id"]: (r["result"], r["score"]) for r in sc.score_all(cases, tables).collect()}
    assert got == {"q": ("scored", 1.0), "l": ("pass", 1.0), "r": ("scored", 0.8), "r2": ("fail", 0.0), "c": ("pass", 0.7), "d": ("fail", 0.25),
                   "k": ("error", 0.0), "x": ("error", 0.0), "n": ("error", 0.0)}


def test_score_all_reports_unknown(spark):
    df = spark.createDataFrame([("1", "nobody")], "id string, evaluator string")
    assert sc.score_all(df).collect()[0]["result"] == "error"
