"""Repeats and near-duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from scorelake.llm import chosen_path, repeats
from scorelake.llm.common import table
from scorelake.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA)


# --- byte repeats ----------------------------------------------------------------------------------


def cut_by_force(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        runs = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


def mixed_texts(seed):
    r = random.Random(seed)

    def some(n):
        return "".join(r.choice("abcdé ") for _ in range(n))
    shared = [some(60), some(100), some(45)]
    texts = [None, "", "a" * 200, "x" * 39, "ab" * 80, "ab" * 50, "y" * 40]
    for _ in range(100):
        t = some(r.randrange(0, 150))
        for _ in range(r.randrange(0, 3)):
            t += r.choice(shared)[r.randrange(0, 20):] + some(r.randrange(0, 30))
        texts.append(t)
    return texts + texts[40:44]


@pytest.mark.parametrize("group_rows", [1024, 7])
def test_repeats_match_brute_force(spark, group_rows):
    texts = mixed_texts(3)
    rows = repeats.measure_repeats(documents(spark, texts), 40, 16, group_rows).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert [got[i] for i in range(len(texts))] == cut_by_force(texts, 40)


def test_crowded_anchors_match_brute_force_with_few_rows(spark, monkeypatch):
    """Very frequent passages are not written out window by window, nor once for each pair."""
    r = random.Random(7)

    def some(n):
        return "".join(r.choice("abcdé ") for _ in range(n))
    middle, before, after = some(60), [some(120) for _ in range(9)], [some(120) for _ in range(9)]
    texts = [some(30) + middle + some(30) for _ in range(150)]
    # Left and right of the passage repeat in turn, so no one text agrees with another on both sides.
    texts += [r.choice(before)[r.randrange(60):] + middle + r.choice(after)[: r.randrange(60, 120)] for _ in range(150)]
    rows, kept = {}, repeats.stored

    def counted(df, name):
        out = kept(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out
    monkeypatch.setattr(repeats, "stored", counted)
    found = repeats.measure_repeats(documents(spark, texts), 40, 16, 7).collect()
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found}
    assert [got[i] for i in range(len(texts))] == cut_by_force(texts, 40)
    assert rows["spans"] + rows["cells"] <= 4 * rows["anchors"]


def test_repeats_of_a_table_match_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.measure_repeats(docs).collect()}
    assert got == dict(zip([r.doc_id for r in rows], cut_by_force([r.text for r in rows], repeats.MIN_BYTES), strict=True))


def test_repeats_odd_rows(spark):
    long = "".join(random.Random(1).choice("abcdef ") for _ in range(500))
    rows = repeats.measure_repeats(documents(spark, [long, long, None, "short", "short"], [1, 1, 2, None, None])).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in rows) == [
        (0, 5, 0, 0), (0, 5, 0, 0), (1, 500, 500, 1), (1, 500, 500, 1), (2, 0, 0, 0)]
    assert repeats.measure_repeats(documents(spark, [])).collect() == []


def test_cut_texts_keep_the_columns_and_all_rows(spark):
    r = random.Random(5)
    shared = "".join(r.choice("abcdeé ") for _ in range(450))
    docs = documents(spark, ["one " + shared + " two", shared + "three", None, "clean"])
    got = {x.doc_id: x for x in repeats.without_repeats(docs).collect()}
    assert got[0].text == "one  two" and got[0].n_chars == 8 and got[1].text == "three"
    assert got[2].text is None and got[3].text == "clean" and repeats.without_repeats(docs).columns == docs.columns


def words_cut_by_force(texts, size):
    """The texts without their runs of `size` words that occur elsewhere, whatever white space they hold."""
    places = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    words = [[t[a:b] for a, b in p] for t, p in zip(texts, places, strict=True)]
    seen = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for t, p, w in zip(texts, places, words, strict=True):
        gone = bytearray(len(t or ""))
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                a, b = p[i][0], p[i + size - 1][1]
                gone[a:b] = b"\1" * (b - a)
        out.append(t and "".join(c for c, g in zip(t, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("group_rows", [1024, 7])
def test_repeated_runs_of_words_match_brute_force(spark, group_rows):
    r = random.Random(11)

    def some(n):
        return "".join(r.choice(["éa", "b", "to", "cc", "d"]) + r.choice([" ", "  ", "\n"]) for _ in range(n))
    shared = [some(12), some(30), some(11)]
    texts = [None, "", " \t", "a " * 40, "b", some(9)]
    for _ in range(120):
        t = some(r.randrange(0, 25))
        for _ in range(r.randrange(0, 3)):
            t += " ".join(r.choice(shared).split()[r.randrange(0, 4):]) + r.choice([" ", "x "]) + some(r.randrange(0, 8))
        texts.append(t)
    got = {x.doc_id: x for x in repeats.without_repeats(documents(spark, texts), 1000, 16, group_rows, 10).collect()}
    want = words_cut_by_force(texts, 10)
    assert [got[i].text for i in range(len(texts))] == want and want != texts
    assert [got[i].n_chars for i in range(len(texts))] == [len(t or "") for t in want]


def test_pipeline_cuts_passages_of_over_50_words(spark):
    """A passage of 51 short words has fewer than 400 bytes; one of 50 words stays."""
    r = random.Random(13)

    def some(n):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    over, fifty, copy = some(51), some(50), some(60)
    texts = [some(30) + "\n" + over, "x " + over.replace(" ", "\n", 3) + " y", fifty + " one", "two " + fifty, copy, copy, some(70)]
    assert len(over) < repeats.MIN_BYTES
    got = {x.doc_id: x.text for x in corpus_pipeline.repeated_passages(spark, documents(spark, texts), None).collect()}
    assert got == {0: texts[0][:-len(over)], 1: "x  y", 2: texts[2], 3: texts[3], 4: "", 5: "", 6: texts[6]}


def test_maximal_groups_list_all_occurrences():
    lefts, rights = [b"cba", b"cbx", b"cba", b"zzz"], [b"12345", b"12345", b"129", b"77"]
    groups: list = []
    reach_l, reach_r = repeats.scan_group(lefts, rights, 4, groups)
    assert sorted(groups) == [(2, 2, [0, 1, 2]), (2, 5, [0, 1]), (3, 2, [0, 2])]
    assert reach_l.tolist() == [3, 2, 3, 0] and reach_r.tolist() == [5, 5, 2, 0]


def test_prefix_intervals():
    # Suffixes a, ab, ab, b with common prefixes 1, 2, 0.
    import numpy as np
    assert sorted(repeats.prefix_intervals(np.array([0, 1, 2, 0]))) == [(0, 0, 3), (1, 0, 2), (2, 1, 2)]


# --- near-duplicates -------------------------------------------------------------------------------


def classes_by_force(ids, texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set())
    places, both, parent = defaultdict(list), Counter(), list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, s in enumerate(sets):
        for x in s:
            both.update((j, i) for j in places[x])
            places[x].append(i)
    for (i, j), c in both.items():
        if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
            parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, d in enumerate(ids)}


def found_classes(docs, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in chosen_path.near_duplicates(docs, **options).collect()}


def test_near_duplicates_of_a_table_match_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text").collect()
    assert found_classes(docs) == classes_by_force([r.doc_id for r in rows], [r.text for r in rows])


def test_dense_and_crowded_nodes_lose_no_link(spark):
    r = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(60)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:20] + [f"y{r.randrange(10**6)}" for _ in range(40)]) for _ in range(80)]
    assert found_classes(documents(spark, texts), block=8, max_depth=3) == classes_by_force(list(range(len(texts))), texts)


def test_near_duplicates_odd_rows(spark):
    texts = [None, "", " \n", "one two", "ONE  two", "one two three", "lost", "a b c d e f", "z y x w v u"]
    rows = chosen_path.near_duplicates(documents(spark, texts, [0, 1, 2, 3, 4, 5, None, 7, 7])).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in rows)
    assert got == [(-1, 1, None, True), (0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False),
                   (5, 1, 5, True), (7, 2, 7, True), (7, 2, 7, True)]
    assert chosen_path.near_duplicates(documents(spark, [])).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 3), (2, 1), (20, 30), (40, 30), (40, 50), (50, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 20, 30: 20, 40: 20, 50: 20, 60: 20}


def test_linked_pairs_meet_at_any_depth():
    import numpy as np
    r = np.random.default_rng(5)
    chooser = chosen_path.Chooser(np.empty(0, np.uint64), 75)
    tokens = r.integers(0, 2**64, 150, dtype=np.uint64)
    # 120 of 160 tokens in common: barely linked. The whole sets are seen at every depth, as if all nodes were large.
    pair = np.sort(tokens[:140]), np.sort(np.concatenate([tokens[:120], r.integers(0, 2**64, 20, dtype=np.uint64)]))

    class Texts:
        def __init__(self, words):
            pass

        def __call__(self, data):
            return pair[data]

    import pandas as pd
    lost, roots = 0, r.integers(0, 2**64, 1500, dtype=np.uint64)
    whole, chosen_path.Shingler = chosen_path.Shingler, Texts
    try:
        branch = chosen_path._branch(5, chooser)
        for root in roots:
            met = np.intersect1d(*(chooser(s, np.array([root])) for s in pair))
            for _ in range(4):
                if not len(met):
                    break
                pdf = pd.DataFrame({"_id": [0, 1], "data": [0, 1], "nodes": [met[:40].view(np.int64)] * 2})
                rows = next(branch([pdf]))
                met = np.intersect1d(*(rows.loc[rows["_id"] == i, "node"].to_numpy(np.int64).view(np.uint64) for i in (0, 1)))
            lost += not len(met)
    finally:
        chosen_path.Shingler = whole
    assert (lost / len(roots)) ** chosen_path.tree_count(chosen_path.RECALL) <= 2 * (1 - chosen_path.RECALL)


def test_common_shingles_are_counted_over_all_texts(spark):
    import numpy as np

    from scorelake.llm import chosen_path as cp
    n = 6000
    rows = [(i, (f"one two three four five x{i}" if i % 80 == 0 else f"a{i} b{i} c{i} d{i} e{i}" + (" six seven eight nine ten" if i % 150 == 1 else "")).encode()) for i in range(n)]
    texts = spark.createDataFrame([*rows, (n, None), (n + 1, b"")], "_id long, data binary")
    every = np.concatenate([cp.Shingler(5)(t) for _, t in rows])
    found, times = np.unique(every, return_counts=True)
    assert sorted(cp.common_shingles(texts, 5)) == sorted(found[times > 0.01 * (n + 2)])
    assert sorted(cp.common_shingles(texts, 5, 0.005)) == sorted(found[times > 0.005 * (n + 2)])
    assert len(cp.common_shingles(texts.limit(0), 5)) == 0


def test_texts_in_chunks_have_the_shingles_and_choices_of_single_ones(monkeypatch):
    import numpy as np
    r = np.random.default_rng(8)
    texts = [" ".join(f"W{x}" for x in r.integers(0, 40, int(n))).encode() for n in r.integers(0, 60, 80)]
    texts += [None, b"", b" \t", b"one", b"A b\x0bC", b"a b c d e", b"x " * 500, "é É a b c d".encode(), b"\xff\xfe q w e r t"]
    monkeypatch.setattr(chosen_path, "CHUNK", 700)
    shingle = chosen_path.Shingler(5)
    one = [shingle(t) for t in texts]
    some = list(shingle.many(texts))
    assert len(some) > 5 and len(some) < len(texts)
    assert all(np.array_equal(a, b) for a, b in zip(shingle.each(texts), one, strict=True))
    roots = chosen_path.splitmix(13, 21)
    for common in (np.empty(0, np.uint64), np.unique(np.concatenate([one[3][:20], one[7]]))):
        chooser = chosen_path.Chooser(common, 75)
        got = [x for s, n in some for x in chooser.many(s, n, roots)]
        assert all(np.array_equal(a, chooser(s, roots)) for a, s in zip(got, one, strict=True))
