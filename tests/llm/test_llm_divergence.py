"""The source audit against plain Python, over copies, odd rows and many sources."""

import random
import re
from collections import Counter, defaultdict

import pytest

from scorelake.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, dg string, term string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def audit_by_force(rows, min_docs, top):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        words = [lower(w) for w in TERM.findall(text or "")]
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        n[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, c in docs[lang].items() if c >= min_docs]
        own = sorted(s for g, s in groups if g == lang)
        whole = Counter()
        for s in own:
            whole.update(n[lang, s])

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}
        q, p = shares(whole), {s: shares(n[lang, s]) for s in own}
        for s in own:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


def made_rows(r, n, sources, langs=("en", "de", None)):
    words = ["alpha", "Beta", "GAMMA", "delta", "épsilon", "ZÉTA", "eta", "theta1", "x_y", "漢字", "kappa", "lambda"]
    rows = []
    for _ in range(n):
        text = r.choice([" ", "\n", "-", "1"]).join(r.choices(words, weights=range(1, 13), k=r.randint(0, 25)))
        rows.append((text, r.choice(langs), r.choice(sources)))
    rows += [(rows[0][0], "en", r.choice(sources)) for _ in range(n // 2)]  # copies hold a third of all rows
    rows += [(None, "en", "void"), ("", None, None), ("12 34", "none", "a"), ("12 34", "none", "b"), ("one two", "few", "c")]
    rows += [("single term", "few", s) for s in "cd"]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i if i % 7 else None, t, lang, s, 0, "x", "y") for i, (t, lang, s) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("seed,n,sources,min_docs,held", [(1, 200, ["a", "b", "c", None], 20, 300_000), (2, 150, [f"s{i}" for i in range(30)], 3, 5)])
def test_audit_equals_brute_force(spark, monkeypatch, seed, n, sources, min_docs, held):
    rows = made_rows(random.Random(seed), n, sources)
    found = dv.Audit(frame(spark, rows), min_docs, held)
    terms = [(r["lang"], r["source"], "term", bytes(r["term"]).decode(), r["value"], r["rank"]) for r in found.typical(5).collect()]
    want = audit_by_force(rows, min_docs, 5)
    assert sorted(terms) == [w for w in want if w[2] == "term"]
    # Small blocks and slices must give what one block gives.
    for block, slice_rows in ((64, 16_384), (3, 4)):
        pairs = sorted((r["lang"], r["source"], r["other"], r["value"]) for r in found.distances(block, slice_rows).collect())
        assert pairs == sorted((w[0], w[1], w[3], w[4]) for w in want if w[2] == "pair")


def test_ranks_and_ties(spark):
    # s1 and s2 hold the same texts, so both are equally far from s3, and the lower name comes first.
    rows = [("aa bb", "en", s) for s in ("s2", "s1") for _ in range(3)] + [("bb cc cc", "en", "s3")] * 3
    got = sorted(map(tuple, dv.audit(frame(spark, rows), 3, 2).collect()))
    assert got == audit_by_force(rows, 3, 2)
    assert [g[3] for g in got if g[1] == "s3" and g[2] == "pair"] == ["s1", "s2"]


def test_empty_and_single(spark):
    assert dv.audit(frame(spark, [])).collect() == []
    assert dv.audit(frame(spark, [("only one text", "en", "a")])).collect() == []


def test_long_text(spark):
    rows = [("word " * 400_000 + "é" * 100_000, "en", "a"), ("word " * 3, "en", "b")]
    got = sorted(map(tuple, dv.audit(frame(spark, rows), 1, 3).collect()))
    assert got == audit_by_force(rows, 1, 3)
