"""Golden tables and brute-force checks for readings, reports, corpus and graph operators."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.functions import dates
from scorelake.operators import ablation as ab
from scorelake.operators import cases as cs
from scorelake.operators import corpus as cp
from scorelake.operators import graph as gr
from scorelake.operators import readings as rd
from scorelake.operators import reports as rp
from scorelake.operators.ranking import exact_median, ranked


def test_week_key_matches_strftime(spark):
    days = [dt.date(2019, 12, 25) + dt.timedelta(days=i) for i in range(1500)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert all(r[1] == r[0].strftime("%Y-W%W") for r in df.select("d", dates.week_key(F.col("d"))).collect())


def test_event_end(spark):
    d = dt.date
    rows = [(d(2024, 1, 1), 0, None), (d(2024, 1, 1), 3, None), (d(2024, 1, 1), 10, d(2024, 1, 4)), (d(2024, 1, 1), 2, d(2024, 2, 1)), (d(2024, 1, 1), None, None)]
    df = spark.createDataFrame(rows, "s date, n int, i date").select(dates.event_end(F.col("s"), F.col("n"), F.col("i")))
    assert [r[0].day for r in df.collect()] == [1, 3, 4, 2, 1]


def test_ranked_equals_row_number_for_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"u{rng.randrange(5)}", rng.randrange(200), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = ranked(df, ["k"], [F.col("v"), F.col("i")], F.floor(F.col("v") / 10), "r", "n")
    per = {}
    for k, v, i in rows:
        per.setdefault(k, []).append((v, i))
    for r in got.collect():
        order = sorted(per[r["k"]])
        assert order[r["r"] - 1] == (r["v"], r["i"]) and r["n"] == len(order)


@pytest.mark.parametrize("n", [1, 2, 5, 60001])
def test_exact_median(spark, n):
    rng = random.Random(n)
    values = [round(rng.gauss(0, 10), 2) for _ in range(n)]
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    assert exact_median(df, ["k"], "v").first()["median"] == pytest.approx(statistics.median(values))


def test_window_stats(spark):
    d = dt.date
    readings = spark.createDataFrame([(1, "a", d(2024, 1, i), float(v)) for i, v in [(1, 3), (2, 9), (3, 9), (31, 1)]], "user_id int, indicator string, day date, value_num double")
    windows = spark.createDataFrame([(1, "a", d(2024, 1, 1), d(2024, 1, 3)), (1, "a", d(2024, 1, 31), d(2024, 3, 5)), (1, "b", d(2024, 1, 1), d(2024, 1, 3))],
                                    "user_id int, indicator string, start_date date, end_date date")
    got = {(r["indicator"], r["start_date"].day): r for r in rd.window_stats(windows, readings).collect()}
    full, one, none = got["a", 1], got["a", 31], got["b", 1]
    assert (full["mean"], full["median"], full["range"], full["argmax_date"], full["n_points"]) == (7.0, 9.0, 6.0, d(2024, 1, 2), 3)
    assert full["stddev"] == round(statistics.stdev([3, 9, 9]), 4)
    assert (one["stddev"], one["n_points"]) == (0.0, 1)
    assert none["unanswerable"] and none["n_points"] == 0


def test_overlapping_events_brute_force(spark):
    rng = random.Random(3)
    d0 = dt.date(2024, 1, 1)
    events = [(u, i, f"n{rng.randrange(4)}", "t", d0 + dt.timedelta(days=rng.randrange(200)), rng.randrange(0, 80), None) for i, u in enumerate([1] * 60 + [2] * 10)]
    df = spark.createDataFrame(events, "user_id int, event_id int, event_name string, event_type string, start_date date, duration_days int, interruption_date date")
    end = lambda e: e[4] + dt.timedelta(days=max(e[5] - 1, 0))
    want = {}
    for a in events:
        for b in events:
            if a[0] == b[0] and a[1] != b[1] and b[4] <= end(a) and end(b) >= a[4]:
                key = (a[1], b[2], b[4])
                want[key] = max(want.get(key, -1), b[1])
    got = {(r["target_id"], r["event_name"], r["start_date"]): r["event_id"] for r in rd.overlapping_events(df, df).collect()}
    assert got == want


def test_half_trend(spark):
    rows = [("up", i, float(v)) for i, v in enumerate([1, 1, 2, 2])] + [("short", i, float(v)) for i, v in enumerate([1, 5, 9])] + [("odd", i, float(v)) for i, v in enumerate([10, 10, 5, 5, 5])]
    df = spark.createDataFrame(rows, "k string, s int, value_num double").withColumn("time", F.timestamp_seconds("s"))
    assert {r["k"]: r["trend"] for r in rd.half_trend(df, ["k"], ["time"]).collect()} == {"up": "rising", "short": "stable", "odd": "falling"}


def test_events_by_indicators(spark):
    links = spark.createDataFrame([(1, "Heart-Rate"), (1, "Sleep"), (2, "HeartRate-HR"), (3, "Steps")], "event_id int, indicator_name string")
    both = rd.events_by_indicators(links, ["heartrate", "sleep"]).collect()
    assert [(r["event_id"], r["matched_terms"]) for r in both] == [(1, ["heartrate", "sleep"])]
    assert {r["event_id"] for r in rd.events_by_indicators(links, ["heartrate", "sleep"], "any").collect()} == {1, 2}


def test_medication_prefers_exact(spark):
    events = spark.createDataFrame([(1, 10, "health_event"), (1, 11, "health_event"), (2, 12, "health_event"), (1, 13, "other")], "user_id int, event_id int, event_type string")
    meds = spark.createDataFrame([(10, "Aspirin"), (11, "Aspirin 100"), (12, "aspirin plus"), (13, "Aspirin")], "event_id int, medication string")
    got = {(r["user_id"], r["match_type"]): r["n_events"] for r in rd.count_events_by_medication(events, meds, "aspirin", ["user_id"]).collect()}
    assert got == {(1, "exact"): 1, (2, "contains"): 1}


def test_pass_rate_and_average(spark):
    rows = [("pass", 1.0), ("fail", 0.0), ("scored", 0.5), ("error", 0.0)]
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(r, s, ["a", "a"], t, t + dt.timedelta(seconds=10)) for r, s in rows], "result string, score double, tags array<string>, start_ts timestamp, end_ts timestamp")
    s = rp.run_summary(df).first()
    assert (s["pass_rate"], s["avg_score"], s["total_seconds"]) == (0.5, 0.375, 40)
    assert rp.stats_by_tag(df).first()["total"] == 8
    assert rp.wall_span(df).first()["wall_seconds"] == 10


def test_longest_prefix(spark):
    names = spark.createDataFrame([("sample",), ("sample_50_gpt",), ("sample_gpt",), ("other_x",)], "name string")
    known = spark.createDataFrame([("sample",), ("sample_50",)], "dataset string")
    got = {r["name"]: (r["dataset"], r["label"]) for r in rp.longest_prefix(names, known).collect()}
    assert got == {"sample": ("sample", None), "sample_50_gpt": ("sample_50", "gpt"), "sample_gpt": ("sample", "gpt"), "other_x": ("other_x", None)}


def test_perturbation_counts(spark):
    rows = [(u, i, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for u in (1, 2) for i in range(10 + u)]
    df = spark.createDataFrame(rows, "user_id int, reading_id int, day date, value_num double")
    kept = {r["user_id"]: r["n"] for r in ab.perturb_delete(df, 0.3, 5).groupBy("user_id").agg(F.count_distinct("day").alias("n")).collect()}
    assert kept == {1: 8, 2: 9}
    noisy = ab.perturb_noise(df, 0.1, 5)
    assert noisy.where("reading_id = 0 AND value_num <> 0").count() == 0
    assert noisy.repartition(7).orderBy("user_id", "reading_id").collect() == ab.perturb_noise(df.repartition(2), 0.1, 5).orderBy("user_id", "reading_id").collect()


def test_apply_patches(spark):
    cases = spark.createDataFrame([("a", "1", ["x", "n_points: 3", "数据点 4"]), ("b", "1", ["x"])], "id string, expected_value string, key_points array<string>")
    patches = spark.createDataFrame([("a", None, 0, True, "no data in range")], "id string, expected_value string, n_points int, unanswerable boolean, reason string")
    got = {r["id"]: r for r in ab.apply_patches(cases, patches).collect()}
    assert got["a"]["expected_value"] is None and got["a"]["key_points"] == ["x", "n_points: 0", "数据点 4"] and got["a"]["unanswerable"]
    assert got["b"]["expected_value"] == "1" and not got["b"]["patched"]
    assert ab.perturb_stats(ab.apply_patches(cases, patches)).first().asDict() == {"total": 2, "n_patched": 1, "n_unanswerable": 1, "n_unchanged": 1}


def test_json_path_and_search(spark):
    doc = '{"a": [{"k": 1}, {"k": {"deep": "Needle"}}, 5], "needle": null}'
    df = spark.createDataFrame([(1, doc)], "id int, j string")
    v = df.select("id", F.parse_json("j").alias("v"))
    paths = lambda p: sorted(r["path"] for r in cs.json_path(v, "v", p, ["id"]).collect())
    assert paths("$.a.k") == ["$.a[0].k", "$.a[1].k"]
    assert paths("a[-1]") == ["$.a[2]"]
    assert paths("a[*].k.deep") == ["$.a[1].k.deep"]
    assert paths("a[7]") == []
    hits = sorted((r["path"], r["match"]) for r in cs.json_search(df, "j", "NEEDLE", ["id"]).collect())
    assert hits == [("$.a[1].k.deep", "value"), ("$.needle", "key")]


def test_generated_cases_smoke(spark):
    people = spark.createDataFrame([("obesity_001", 25, "male", "学生", "31.0", ["a"], "m", "b")],
                                   "profile_id string, age int, gender string, occupation string, bmi string, comorbidities array<string>, motivation string, background string")
    got = cs.generate_cases(people, [("01", "hi"), ("02", "yo")]).collect()
    assert [r["id"] for r in got] == ["vu_o01_p001", "vu_o02_p001"]
    assert len({r["persona"] for r in got}) == 1
    for r in got:
        assert r["evaluator"] == "engagement" and len(r["history"]) == 1 and r["history"][0]["role"] == "assistant"
        assert any(x.startswith("opening:") for x in r["tags"])


@pytest.mark.parametrize("n_lines", [1, 7, 400])
def test_windowed_text_equals_cut_text(spark, n_lines):
    rng = random.Random(n_lines)
    lines = [(1, i, "x" * rng.randrange(1, 30) + str(i)) for i in range(n_lines)]
    text = "HEAD\n" + "\n".join(x[2] for x in lines)
    want, start = [], 0
    while start < len(text) and (len(text) > 100 or not want):
        want.append(text[start:start + 100])
        start += 70
    df = spark.createDataFrame(lines, "k int, i int, line string")
    got = cp.windowed_text(df, ["k"], ["i"], F.lit("HEAD"), F.floor(F.col("i") / 9), 100, 30).orderBy("piece").collect()
    assert [r["text"] for r in got] == want


def test_pack_lines(spark):
    doc = "[PROFILE]\nname\n[DATA] d\n" + "\n".join("y" * 8 for _ in range(5))
    df = spark.createDataFrame([(doc,), ("plain text",)], "t string")
    got = [r[0] for r in df.select(cp.pack_lines(F.col("t"), 27, 5)).collect()]
    head = "[PROFILE]\nname"
    assert got[0] == [head, f"{head}\n[DATA] d\n{'y' * 8}\n{'y' * 8}"[: len(head) + 1 + 26], f"{head}\n{'y' * 8}\n{'y' * 8}\n{'y' * 8}"]
    assert got[1] == ["plain text"]


def test_fingerprint_ignores_order_and_counts_copies(spark):
    one = lambda rows: cp.content_fingerprint(spark.createDataFrame([(r,) for r in rows], "t string"), [], F.col("t")).first()["fingerprint"]
    assert one(["a", "b", "c"]) == one(["c", "a", "b"])
    assert one(["a", "b"]) != one(["a", "b", "b"])


def vectors(n, dim, seed):
    return np.random.default_rng(seed).normal(size=(n, dim))


def test_dense_top_k_and_pairs_brute_force(spark):
    v = vectors(300, 4, 1)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = unit @ unit.T
    df = spark.createDataFrame([(1, i, [float(x) for x in row]) for i, row in enumerate(v)], "user_id int, vec_id int, embedding array<double>")
    pairs = {(r["id_a"], r["id_b"]) for r in gr.similar_pairs(df, 0.9, block_rows=16).collect()}
    assert pairs == {(i, j) for i in range(300) for j in range(i + 1, 300) if sims[i, j] >= 0.9}
    chunks = df.withColumnRenamed("vec_id", "chunk_id")
    queries = df.where("vec_id < 40").withColumnRenamed("vec_id", "query_id")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in gr.dense_top_k(queries, chunks, 3, block_rows=16).collect()}
    for qid in range(40):
        order = sorted(range(300), key=lambda j: (sims[qid, j], j), reverse=True)[:3]
        assert [got[qid, r] for r in (1, 2, 3)] == order


def power_iteration(nodes, edges, seed, alpha=0.5, tol=1e-6):
    deg = {n: sum(w for a, b, w in edges if n in (a, b)) for n in nodes}
    x = {n: 1 / len(nodes) for n in nodes}
    for _ in range(100):
        lost = sum(x[n] for n in nodes if deg[n] == 0)
        new = {n: alpha * lost * seed.get(n, 0) + (1 - alpha) * seed.get(n, 0) for n in nodes}
        for a, b, w in edges:
            new[b] += alpha * x[a] * w / deg[a]
            new[a] += alpha * x[b] * w / deg[b]
        change = sum(abs(new[n] - x[n]) for n in nodes)
        x = new
        if change < len(nodes) * tol:
            break
    return x


def test_pagerank_with_dangling_passage(spark):
    names = ["ent:a", "ent:b", "passage:1", "passage:2"]
    links = [("ent:a", "passage:1", 1.0), ("ent:a", "ent:b", 2.0)]
    nodes = spark.createDataFrame([(1, n) for n in names], "user_id int, node string")
    edges = spark.createDataFrame([(1, *e) for e in links], "user_id int, src string, dst string, weight double")
    seeds = spark.createDataFrame([("q", 1, "ent:b", 3.0), ("q", 1, "passage:2", 1.0)], "query_id string, user_id int, node string, weight double")
    want = power_iteration(names, links, {"ent:b": 0.75, "passage:2": 0.25}, tol=1e-15)
    for tol in (1e-3, 1e-6, 1e-14):
        got = {r["node"]: r["score"] for r in gr.personalized_pagerank(nodes, edges, seeds, tol=tol).collect()}
        assert sum(abs(got.get(n, 0.0) - want[n]) for n in names) <= tol * len(names) + 1e-14


def test_graph_retrieve_fills_up(spark):
    e = lambda *x: [float(v) for v in x]
    chunks = spark.createDataFrame([(1, 0, e(1, 0)), (1, 1, e(0, 1)), (1, 2, e(1, 1))], "user_id int, chunk_id int, embedding array<double>")
    ents = spark.createDataFrame([(1, "a", e(1, 0)), (1, "b", e(0, 1))], "user_id int, entity string, embedding array<double>")
    mentions = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "user_id int, chunk_id int, entity string")
    triples = spark.createDataFrame([], "user_id int, chunk_id int, subject string, predicate string, object string")
    queries = spark.createDataFrame([(1, "q", e(1, 0.1))], "user_id int, query_id string, embedding array<double>")
    got = gr.graph_retrieve(queries, chunks, ents, mentions, triples, 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [0, 1, 2]


def test_turn_pairs_follow_the_order_not_the_numbers(spark):
    from scorelake.operators.cases import pair_turns
    rows = [(1, 1, "user", "a"), (1, 4, "assistant", "b"), (1, 6, "user", "c"), (1, 9, "user", "d"), (1, 10, "assistant", "e"), (1, 12, "user", "f")]
    got = pair_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).orderBy("turn").collect()
    assert [(r["user_text"], r["assistant_text"]) for r in got] == [("a", "b"), ("c", None), ("d", "e"), ("f", None)]


def test_cached_input_has_its_own_price(spark):
    from scorelake.operators import reports
    usage = spark.createDataFrame([("r", "m", 1000, 400, 10), ("r", "n", 1000, 400, 10), ("r", "unknown", 1000, 400, 0), ("r", "m", 100, None, 0)],
                                  "role string, model string, input_tokens long, cached_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", 2.0, 0.5, 10.0), ("n", 2.0, None, 10.0)], "model string, input double, cached_input double, output double")
    row = reports.cost_rollup(usage, prices).first()
    # 600 x 2 + 400 x 0.5 + 100, then cached at the full price, then the defaults, then 100 x 2; in USD per million.
    assert row["cost"] == round((1500 + 2100 + 600 * 2.0 + 400 * 0.5 + 200) / 1e6, 4) and row["cached_tokens"] == 1200


def test_interrupted_events_without_a_date(spark):
    from scorelake.operators.corpus import event_chunks
    schema = "user_id int, event_id int, event_name string, event_type string, start_date date, duration_days int, interrupted boolean, interruption_date date"
    import datetime
    day = datetime.date(2024, 1, 1)
    rows = [(1, 1, "n", "t", day, 2, True, None), (1, 2, "n", "t", day, 2, False, day), (1, 3, "n", "t", day, 2, True, day), (1, 4, "n", "t", day, 2, None, None)]
    texts = {r["part"][-1]: r["text"].split("\n")[-1] for r in event_chunks(spark.createDataFrame(rows, schema)).collect()}
    assert texts["1"] == "Interrupted: True" and texts["3"] == "Interruption date: 2024-01-01" and texts["4"] == "Interrupted: False"


def test_readings_of_one_instant_give_one_answer(spark):
    import datetime

    from scorelake.operators.ablation import recompute_truth
    day, at = datetime.date(2024, 1, 1), datetime.datetime(2024, 1, 1, 8)
    readings = spark.createDataFrame([(1, day, at, "i", v) for v in (3.0, 7.0, 5.0)], "user_id int, day date, time timestamp, indicator string, value_num double")
    queries = spark.createDataFrame([("q", 1, "i", "device", day, None, [])], "query_id string, user_id int, indicator string, kind string, day date, group_filter string,"
                                    " ranges array<struct<role:string,start_date:date,end_date:date>>")
    assert recompute_truth(queries, readings.repartition(3)).first()["expected_num"] == 7.0


def test_dense_top_k_gives_exactly_k_of_equal_vectors(spark):
    from scorelake.operators.graph import dense_top_k
    same = spark.range(40).selectExpr("1 AS user_id", "id AS chunk_id", "array(1.0F, 0.0F) AS embedding")
    queries = spark.createDataFrame([(1, 7, [1.0, 0.0]), (1, 8, [0.0, 0.0])], "user_id int, query_id int, embedding array<float>")
    for size in (1000, 8):
        rows = dense_top_k(queries, same, 5, block_rows=size).collect()
        assert {(r["query_id"], r["chunk_id"]) for r in rows} == {(q, c) for q in (7, 8) for c in range(35, 40)}


def test_packing_many_lines_is_linear(spark):
    import time

    from pyspark.sql import functions as F

    from scorelake.operators.corpus import pack_lines

    def seconds(n):
        df = spark.range(1).select(pack_lines(F.concat(F.lit("[PROFILE]\nhead\n[DATA]\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")), 2000).alias("c"))
        started = time.perf_counter()
        chunks = df.first()["c"]
        assert chunks[0] == "[PROFILE]\nhead" and sum(c.count("line ") for c in chunks) == n and all(len(c) <= 2000 + 20 for c in chunks)
        return time.perf_counter() - started
    seconds(1000)
    assert seconds(100_000) < 20 * max(seconds(10_000), 0.2)


def test_search_follows_json_to_any_depth(spark):
    from scorelake.operators.cases import json_search
    deep = '{"a": ' * 60 + '{"Needle": [1.50, null, true, {"k": "a needle"}]}' + "}" * 60
    df = spark.createDataFrame([(1, deep), (2, "broken {"), (3, None), (4, '"needle"'), (5, "[]")], "id int, doc string")
    got = sorted((r["id"], r["path"].count(".a"), r["match"], r["preview"]) for r in json_search(df, "doc", "NEEDLE", ["id"]).collect())
    assert got == [(1, 60, "key", '[1.50,null,true,{"k":"a needle"}]'), (1, 60, "value", "a needle"), (4, 0, "value", "needle")]


# --- forward push and bounded vector search ---------------------------------------------------------


def _graph(seed, nodes=60, edges=150):
    """Random links, a hub that touches every other node, and a pair apart from the rest."""
    r = np.random.default_rng(seed)
    links = {}
    for _ in range(edges):
        a, b = sorted(r.choice(nodes, 2, replace=False).tolist())
        links[a, b] = float(r.integers(1, 5))
    links.update({(0, i): 1.0 for i in range(1, nodes)} | {(nodes, nodes + 1): 2.0})
    return nodes + 2, links


def _exact_push(n, links, seeds, alpha):
    w = np.zeros((n, n))
    for (a, b), x in links.items():
        w[a, b] += x
        w[b, a] += x
    step = w / w.sum(axis=1, keepdims=True)
    return (1 - alpha) * np.linalg.solve(np.eye(n) - alpha * step.T, seeds)


@pytest.mark.parametrize("block_edges", [16, 100_000])
def test_push_keeps_its_error_bound(spark, block_edges):
    from scorelake.operators import diffusion
    n, links = _graph(3)
    edges = spark.createDataFrame([(1, f"n{a}", f"n{b}", x) for (a, b), x in links.items()], "user_id int, src string, dst string, weight double")
    graph = diffusion.Graph(edges, block_edges=block_edges)
    seeds = np.zeros((n, 3))
    seeds[5, 0], seeds[0, 1], seeds[n - 1, 1] = 1.0, 0.5, 0.5
    seeds[:, 2] = np.random.default_rng(4).normal(size=n) / n
    rows = spark.createDataFrame([(1, "a", f"n{i}", seeds[i].tolist()) for i in range(n) if seeds[i].any()] + [(1, "a", "alone", [2.0, 0.0, 0.0])],
                                 "user_id int, lane string, node string, values array<double>")
    want, passed_on, tol = _exact_push(n, links, seeds, 0.5), [], 1e-4
    found, late = diffusion.push(graph, rows, 0.5, tol, width=3, passed_on=passed_on)
    got = {r["node"]: r["values"] for r in found.collect()}
    assert got.pop("alone") == [1.0, 0.0, 0.0] and late.count() == 0
    error = sum(np.abs(np.array(got.get(f"n{i}", [0.0] * 3)) - want[i]) for i in range(n))
    assert (error <= tol * n + 1e-12).all()
    if block_edges == 16:
        # Several blocks: what leaves them gets less from round to round.
        assert len(passed_on) > 2 and passed_on[-1] == 0 and passed_on[-2] < passed_on[0]
        _, unfinished = diffusion.push(graph, rows, 0.5, 1e-9, max_rounds=1, width=3)
        assert [tuple(r) for r in unfinished.collect()] == [(1, "a")]
    else:
        assert passed_on == [0]


def test_graph_passages_equal_power_iteration(spark):
    """Dense seeds as smoothed vectors, entity seeds by push: the same scores as one run with all seeds."""
    r = np.random.default_rng(6)
    n, dim = 14, 70
    chunk, ent = r.normal(size=(n, dim)), r.normal(size=(8, dim))
    names = [f"ent:e{i}" for i in range(8)] + [f"passage:{i}" for i in range(n)]
    links = [(f"ent:e{r.integers(8)}", f"passage:{i}", 1.0) for i in range(n)] + [("ent:e0", "ent:e1", 2.0), ("ent:e2", "ent:e5", 0.9)]
    used = {x for a, b, _ in links for x in (a, b)}
    names = [x for x in names if x in used] + ["ent:e9"]  # an entity without an edge
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    f = lambda v: [float(x) for x in v]
    user = "user_id int, "
    nodes = spark.createDataFrame([(1, x) for x in names], user + "node string")
    edges = spark.createDataFrame([(1, *e) for e in links], user + "src string, dst string, weight double")
    chunks = spark.createDataFrame([(1, i, f(chunk[i])) for i in range(n)], user + "chunk_id int, embedding array<double>")
    vectors = [(1, f"e{i}", f(ent[i])) for i in range(8) if f"ent:e{i}" in used] + [(1, "e9", f(ent[0] + 0.1))]
    passages = chunks.select("user_id", "chunk_id")
    asked = {"q1": ent[0] + 0.2 * chunk[3], "q2": chunk[5], "q3": -unit(chunk).sum(axis=0)}
    queries = spark.createDataFrame([(1, k, f(v)) for k, v in asked.items()] + [(1, "zero", [0.0] * dim)], user + "query_id string, embedding array<double>")
    got = gr.graph_passages(queries, chunks, spark.createDataFrame(vectors, user + "entity string, embedding array<double>"), nodes, edges, passages, 5, tol=1e-13).collect()
    assert {r["query_id"] for r in got} == set(asked)
    for name, q in asked.items():
        q = q / np.linalg.norm(q)
        near = sorted(((float(np.array(v) @ q / np.linalg.norm(v)), f"ent:{e}") for _, e, v in vectors), reverse=True)[:10]
        seed = {e: c for c, e in near if c > 0} | {f"passage:{i}": 0.05 * float(unit(chunk)[i] @ q) for i in range(n)}
        total = sum(seed.values())
        score = power_iteration(names, links, {k: v / total for k, v in seed.items()}, tol=1e-15)
        want = sorted(((score[f"passage:{i}"], i) for i in range(n)), reverse=True)[:5]
        mine = [(r["chunk_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == name), key=lambda r: r["rank"])]
        assert [m[0] for m in mine] == [i for _, i in want]
        # Mass that the entity without an edge loses scales all scores of the query alike.
        lost = sum(v for k, v in seed.items() if k == "ent:e9") / total
        assert all(math.isclose(m[1] / (1 - 0.5 * lost), x, abs_tol=1e-9) for m, (x, _) in zip(mine, want, strict=True))


def clustered(n, dim, groups, seed):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(groups, dim))
    return centers[r.integers(groups, size=n)] + 0.05 * r.normal(size=(n, dim))


def frame_of(spark, v, name="vec_id"):
    return spark.createDataFrame([(i % 2, i, [float(x) for x in row]) for i, row in enumerate(v)], f"user_id int, {name} int, embedding array<double>")


def test_bounds_spare_blocks_and_lose_nothing(spark):
    from scorelake.operators import vectors as ve
    v = clustered(600, 8, 12, 2)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims, df = unit @ unit.T, frame_of(spark, v)
    blocks = ve.blocks_of(df, "user_id", "vec_id", block_rows=20, pivots=16)
    size = {(r["user_id"], r["block"]): r["n"] for r in blocks.packed.collect()}
    n = {u: sum(1 for k in size if k[0] == u) for u in (0, 1)}
    met = ve.block_pairs(blocks, 0.85).collect()
    assert len(met) < 0.5 * sum(x * (x + 1) // 2 for x in n.values())
    # Vectors compared, against bands of the angle to one pivot, in which a band meets itself and the next.
    banded = 0
    for u in (0, 1):
        band = np.floor(np.arccos(np.clip(unit[u::2] @ unit[u], -1, 1)) / math.acos(0.85))
        counts = [int((band == b).sum()) for b in range(8)]
        banded += sum(c * c for c in counts) + sum(a * b for a, b in zip(counts, counts[1:]))
    assert sum(size[r["user_id"], r["block_a"]] * size[r["user_id"], r["block_b"]] for r in met) < 0.5 * banded
    pairs = {(r["id_a"], r["id_b"]) for r in ve.similar_pairs(df, 0.85, block_rows=20).collect()}
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if i % 2 == j % 2 and sims[i, j] >= 0.85}
    assert pairs == want
    likely = {(r["id_a"], r["id_b"]) for r in ve.likely_pairs(df, 0.85, recall=0.95, bits=8, block_rows=50).collect()}
    assert likely <= want and len(likely) >= 0.9 * len(want)
    seen = []
    found = ve.nearest_vectors(df.where("vec_id < 60").withColumnRenamed("vec_id", "query_id"), blocks, 4, met=seen).collect()
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in found}
    for q in range(60):
        assert [got[q, k] for k in (1, 2, 3, 4)] == sorted((j for j in range(600) if j % 2 == q % 2), key=lambda j: (sims[q, j], j), reverse=True)[:4]
    assert sum(x.count() for x in seen) < 0.5 * 30 * sum(n.values())


def test_vector_search_without_unit_length_and_odd_rows(spark):
    from scorelake.operators import vectors as ve
    v = np.random.default_rng(8).normal(size=(90, 5)) * np.arange(1, 91)[:, None]
    df = frame_of(spark, v).unionByName(spark.createDataFrame([(0, 900, None)], "user_id int, vec_id int, embedding array<double>"))
    q = df.where("vec_id < 10").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in ve.nearest_vectors(q, ve.blocks_of(df, "user_id", "vec_id", block_rows=8, unit_length=False), 3, unit_length=False).collect():
        got[r["query_id"], r["rank"]] = r["vec_id"]
    for i in range(10):
        assert [got[i, k] for k in (1, 2, 3)] == sorted((j for j in range(90) if j % 2 == i % 2), key=lambda j: (float(v[i] @ v[j]), j), reverse=True)[:3]
    empty = df.limit(0)
    assert ve.similar_pairs(empty, 0.9).count() == 0
    assert ve.dense_top_k(empty.withColumnRenamed("vec_id", "query_id"), df.withColumnRenamed("vec_id", "chunk_id"), 3).count() == 0


# --- dyadic partials ----------------------------------------------------------------------------------


def test_window_cells_cover_each_day_once(spark):
    from scorelake.operators.dyadic import window_cells
    r = random.Random(2)
    base, spans = dt.date(2024, 1, 1), []
    for _ in range(300):
        a = base + dt.timedelta(days=r.randint(-20_000, 9000))
        spans.append((a, a + dt.timedelta(days=r.choice([-1, 0, 1, 6, 13, 100, 364, 9000]))))
    df = spark.createDataFrame(spans, "start_date date, end_date date")
    epoch = dt.date(1970, 1, 1)
    for row in df.select("start_date", "end_date", window_cells(F.col("start_date"), F.col("end_date"), 10).alias("c")).collect():
        days = sorted(d for c in row["c"] for d in range(c["cell"] << c["level"], (c["cell"] + 1) << c["level"]))
        first, stop = (row["start_date"] - epoch).days, (row["end_date"] - epoch).days + 1
        assert days == list(range(first, stop))
        assert len(row["c"]) <= 20 + max(0, stop - first) // 1024


def test_window_statistics_equal_plain_python(spark):
    r = random.Random(7)
    base = dt.date(2023, 12, 20)
    # Values that vary little about a large mean: sums of plain squares would lose the deviation.
    readings = [(u, i, base + dt.timedelta(days=r.randint(0, 400)), r.choice([None, 1e7 + round(r.random(), 3), 1e7 + 0.5])) for u in (1, 2) for i in ("a", "b") for _ in range(300)]
    windows = [(u, i, s, s + dt.timedelta(days=n)) for u in (1, 2, 3) for i in ("a", "b") for n in (0, 13, 100, 380) for s in [base + dt.timedelta(days=r.randint(-30, 380))]]
    df = spark.createDataFrame(readings, "user_id int, indicator string, day date, value_num double")
    got = rd.window_stats(spark.createDataFrame(windows, "user_id int, indicator string, start_date date, end_date date"), df).collect()
    assert len(got) == len(windows)
    for g in got:
        inside = [(v, d) for u, i, d, v in readings if (u, i) == (g["user_id"], g["indicator"]) and g["start_date"] <= d <= g["end_date"] and v is not None]
        assert g["n_points"] == len(inside) and g["unanswerable"] == (not inside)
        if inside:
            values = [v for v, _ in inside]
            assert g["argmax_date"] == min((-v, d) for v, d in inside)[1] and g["max"] == round(max(values), 4) and g["min"] == round(min(values), 4)
            assert math.isclose(g["mean"], statistics.fmean(values), rel_tol=0, abs_tol=1e-4) and math.isclose(g["median"], statistics.median(values), abs_tol=1e-4)
            assert math.isclose(g["stddev"], statistics.stdev(values) if len(values) > 1 else 0.0, rel_tol=0, abs_tol=2e-4)


def _truth_input(spark):
    readings = spark.range(400).selectExpr(
        "id AS reading_id", "CAST(id % 5 AS INT) AS user_id", "date_add(DATE'2024-01-01', CAST(id DIV 20 AS INT)) AS day", "timestamp_seconds(id) AS time",
        "'i' AS indicator", "CAST(id % 13 AS DOUBLE) AS value_num")
    queries = spark.range(5).selectExpr(
        "concat('q', id) AS query_id", "CAST(id AS INT) AS user_id", "'i' AS indicator",
        "element_at(array('device_timeseries', 'event_window_median_value', 'two_window_delta', 'device', 'peak_date'), CAST(id AS INT) + 1) AS kind",
        "DATE'2024-01-03' AS day", "CAST(NULL AS STRING) AS group_filter",
        "IF(id = 2, array(named_struct('role', 'window1', 'start_date', DATE'2024-01-01', 'end_date', DATE'2024-01-07'),"
        " named_struct('role', 'window2', 'start_date', DATE'2024-01-08', 'end_date', DATE'2024-01-14')),"
        " array(named_struct('role', 'range', 'start_date', DATE'2024-01-01', 'end_date', DATE'2024-01-14'))) AS ranges")
    return queries, readings


def test_ablation_sends_no_readings_or_ranges_to_all_executors(spark):
    from scorelake.operators.ablation import VARIANTS, ablation_truth
    queries, readings = _truth_input(spark)
    truth = ablation_truth(queries, readings, 3)
    rows = truth.collect()
    assert {(r["variant"], r["query_id"]) for r in rows} == {(v, f"q{i}") for v, _, _ in VARIANTS for i in range(5)}
    # Adaptive execution would turn the joins to broadcasts by the size of compressed rows.
    assert "BroadcastHashJoin" not in truth._jdf.queryExecution().executedPlan().toString()


def test_a_range_is_answered_once_for_all_variants(spark):
    from scorelake.operators.ablation import ablation_truth
    queries, readings = _truth_input(spark)
    plain = [("same", "delete", 0.0), ("half", "delete", 0.5)]
    got = {(r["variant"], r["query_id"]): r for r in ablation_truth(queries, readings, 3, plain).collect()}
    values = {u: [float(i % 13) for i in range(400) if i % 5 == u and i // 20 < 14] for u in range(5)}
    assert got["same", "q0"]["expected_num"] == pytest.approx(statistics.mean(values[0]), abs=1e-4)
    assert got["same", "q1"]["expected_num"] == pytest.approx(statistics.median(values[1]), abs=1e-4)
    assert got["half", "q0"]["n_points"] < got["same", "q0"]["n_points"] == len(values[0])


def test_days_are_placed_only_in_cells_as_long_as_windows(spark):
    from scorelake.operators import dyadic
    df = spark.range(64).selectExpr("1 AS k", "date_add(DATE'2024-01-01', CAST(id AS INT)) AS day", "CAST(id % 7 AS DOUBLE) AS value_num")
    daily = dyadic.day_partials(df, ["k"])
    cells = dyadic.cell_partials(daily, ["k"], spark.createDataFrame([(1, 14)], "k int, days int"), ["k"]).collect()
    assert max(c["level"] for c in cells) == 3 and sum(c["n"] for c in cells if c["level"] == 3) == 64
    windows = spark.sql("SELECT 1 AS k, DATE'2024-01-03' AS start_date, DATE'2024-01-20' AS end_date")
    one = dyadic.window_totals(windows, daily, ["k"]).first()
    # Of days with the same greatest value the first.
    assert (one["n"], one["most"], str(one["peak_day"])) == (18, 6.0, "2024-01-07")


def test_pushed_rows_hold_as_many_columns_as_a_user_has_queries(spark, monkeypatch):
    from scorelake.operators import diffusion, graph
    edges = spark.createDataFrame([(u, "a", b, 1.0) for u in (1, 2) for b in ("b", "c")], "user_id int, src string, dst string, weight double")
    nodes = edges.selectExpr("user_id", "src AS node").union(edges.selectExpr("user_id", "dst")).distinct()
    seeds = spark.createDataFrame([(q, u, "b", 1.0) for q, u in ((1, 1), (2, 2), (3, 2), (4, 2))], "query_id int, user_id int, node string, weight double")
    sizes, push = [], diffusion.push

    def seen(graph, rows, *rest):
        sizes.extend(r[0] for r in rows.selectExpr("size(values)").distinct().collect())
        return push(graph, rows, *rest)
    monkeypatch.setattr(diffusion, "push", seen)
    got = {(r["query_id"], r["node"]): r["score"] for r in graph.personalized_pagerank(nodes, edges, seeds, tol=1e-12).collect()}
    assert sizes == [3] and len(got) == 12
    # b keeps half, a gets half of the rest, and so on: the same for every query.
    assert all(got[q, n] == pytest.approx(got[1, n], abs=1e-9) for q in (2, 3, 4) for n in "abc")
    assert sum(got[1, n] for n in "abc") == pytest.approx(1.0, abs=1e-6) and got[1, "b"] > got[1, "a"] > got[1, "c"]


def test_link_seeds_query_asks_for_every_vector(spark, tmp_path):
    from scorelake.plans import registry
    rows = [(i, i % 2, [1.0, i / 10]) for i in range(1, 8)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.all_queries()["rg10_link_seeds"](spark, str(tmp_path)).collect()
    # No id is divisible by 100; all are asked for, against all entities and passages of their user.
    assert sorted((r["query_id"], r["node"]) for r in got) == sorted(
        (a, node) for a, x, _ in rows for b, y, _ in rows if x == y for node in (f"ent:e{b:09d}", f"passage:{b}"))
    assert "% 100" not in registry.all_oracles()["rg10_link_seeds"]


def test_scores_leave_a_pair_of_blocks_in_pieces(spark, monkeypatch):
    from scorelake.operators import vectors as ve
    v = clustered(60, 4, 3, 5)
    frame = frame_of(spark, v)
    monkeypatch.setattr(ve, "SCORES", 16)
    got = ve.block_scores(frame.withColumnRenamed("vec_id", "query_id"), ve.blocks_of(frame, "user_id", "vec_id", block_rows=8), query_rows=8).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = {(r["query_id"], i): s for r in got for i, s in zip(r["ids"], r["scores"], strict=True)}
    assert len(found) == sum(len(r["ids"]) for r in got) == 2 * 30 * 30
    assert all(s == pytest.approx(float(u[q] @ u[i]), abs=1e-12) for (q, i), s in found.items())


def test_packed_graphs_equal_power_iteration_and_keep_their_names(spark, monkeypatch):
    """Graphs of several users and queries share a block, and nothing is pushed in rounds."""
    from scorelake.operators import diffusion
    monkeypatch.setattr(diffusion, "_push_cut", lambda *a: pytest.fail("a small graph was cut"))
    links = {1: [("a", "b", 2.0), ("b", "c", 1.0), ("a", "b", 1.0)], 2: [("a", "c", 1.0), ("c", "d", 3.0)], 3: [("x", "y", 0.5)]}
    edges = spark.createDataFrame([(u, *e) for u, es in links.items() for e in es] + [(None, "a", "b", 9.0)], "user_id int, src string, dst string, weight double")
    asked = {"q1": (1, {"b": 1.0}), "q2": (2, {"a": 3.0, "c": 1.0}), "q3": (2, {"c": 1.0}), "q4": (3, {"y": 1.0})}
    seeds = [(q, u, n, w) for q, (u, s) in asked.items() for n, w in s.items()] + [("q4", 3, "nowhere", 1.0), ("q5", 9, "a", 1.0)]
    seeds = spark.createDataFrame(seeds, "query_id string, user_id int, node string, weight double")
    got = gr.personalized_pagerank(None, edges, seeds, tol=1e-14).collect()
    found = {(r["query_id"], r["user_id"], r["node"]): r["score"] for r in got}
    assert len(found) == len(got) and all(r["converged"] for r in got)
    # A seed at no node counts in the sum of the seeds, and no more.
    want = {}
    for q, (u, s) in asked.items():
        names, total = sorted({x for a, b, _ in links[u] for x in (a, b)}), sum(s.values()) + (q == "q4")
        scores = power_iteration(names, links[u], {n: w / total for n, w in s.items()}, tol=1e-15)
        want |= {(q, u, n): scores[n] for n in names}
    assert found == pytest.approx(want, abs=1e-9)


def test_edge_without_an_end_counts_as_weight(spark):
    from scorelake.operators import diffusion
    edges = spark.createDataFrame([(1, "a", "b", 1.0), (1, "a", None, 1.0), (1, "b", "c", None)], "user_id int, src string, dst string, weight double")
    seeds = spark.createDataFrame([(1, "0", "a", [1.0])], "user_id int, lane string, node string, values array<double>")
    found, _ = diffusion.push(diffusion.Graph(edges), seeds, 0.5, 1e-14, width=1)
    # Half of what goes on from a is lost; all that goes on from b comes back, and c gets nothing.
    got = {r["node"]: r["values"][0] for r in found.collect()}
    assert got == {"a": pytest.approx(0.5 / (1 - 0.125)), "b": pytest.approx(0.125 / (1 - 0.125))}


def test_stored_tables_leave_no_shuffle_files(spark):
    import re
    import time

    from scorelake.session import checkpointed, stored

    def held() -> set[int]:
        return {int(x) for x in re.findall(r"\d+", str(spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keys().mkString(" ")))}
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition("k")
    for keep in (checkpointed, lambda df: stored(df, "counts")):
        before = held()
        assert keep(rows).count() == 7
        own = held() - before
        # Those of the last count stay; two exchanges of the table itself go.
        until = time.time() + 10
        while len(own & held()) > 1 and time.time() < until:
            time.sleep(0.1)
        assert len(own & held()) <= 1


def test_large_graph_of_few_nodes_is_pushed_whole(spark, monkeypatch):
    """More edges than a block, fewer nodes: one pass, next to a small graph, equal to the exact scores."""
    from scorelake.operators import diffusion
    monkeypatch.setattr(diffusion, "_push_cut", lambda *a: pytest.fail("a graph of few nodes was cut"))
    monkeypatch.setattr(diffusion, "FLOW_EDGES", 7)
    n, links = _graph(3)
    rows = [(1, f"n{a}", f"n{b}", x) for (a, b), x in links.items()] + [(2, "a", "b", 1.0)]
    edges = spark.createDataFrame(rows, "user_id int, src string, dst string, weight double")
    assert n <= 64 < 2 * len(links)
    graph = diffusion.Graph(edges, block_edges=64)
    assert graph.large is None and graph.packed.count() == 2
    seeds = np.zeros((n, 2))
    seeds[5, 0], seeds[0, 1], seeds[n - 1, 1] = 1.0, 0.5, 0.5
    mass = spark.createDataFrame([(1, "a", f"n{i}", seeds[i].tolist()) for i in range(n) if seeds[i].any()] + [(2, "a", "a", [1.0, 0.0])],
                                 "user_id int, lane string, node string, values array<double>")
    got = {(r["user_id"], r["node"]): r["values"] for r in diffusion.push(graph, mass, 0.5, 1e-13, width=2)[0].collect()}
    want = _exact_push(n, links, seeds, 0.5)
    assert all(got[1, f"n{i}"] == pytest.approx(want[i], abs=1e-9) for i in range(n))
    assert got[2, "a"][0] == pytest.approx(2 / 3) and got[2, "b"][0] == pytest.approx(1 / 3)
