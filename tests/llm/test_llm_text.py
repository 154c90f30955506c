"""Quality rules, language, toxicity, token ids and benchmark leaks."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from math import comb, isclose, log

import numpy as np
import pytest
from tokenizers import Tokenizer

from scorelake.llm import decontaminate, langid, quality, toxicity, wordbpe
from scorelake.llm.common import table, tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang)."""
    full = [(*r, *[None] * (3 - len(r)), None, None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


# --- quality ---------------------------------------------------------------------------------------


def counts_by_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(inside))


def test_counts_match_brute_force(spark, sf_dir):
    texts = [r.text for r in table(spark, sf_dir, "documents").select("text").collect()]
    r = random.Random(2)
    texts += [None, "", " \n\t ", "a\n a\na\n\n\n", "x" * 5000, "\x1c \x85  é"] + [" ".join(r.choice("abc") for _ in range(n)) for n in range(60)]
    for t in texts:
        assert quality.counts_of(t)[:6] == counts_by_force(t)


def test_binomial_bound_is_exact():
    for k, n, p in [(0, 10, 0.1), (3, 50, 0.02), (7, 400, 0.03), (50, 50, 0.5)]:
        exact = sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))
        assert quality.at_most(k, n, p) == pytest.approx(float(exact), rel=1e-9)


def test_cutoffs_keep_the_risk(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 10 == 0
        junk = "###" if bad or r.random() < 0.0005 else ""
        rows.append((i, " ".join(f"w{r.randrange(10**6)}{junk}" for _ in range(30)), "en"))
        labels.append((i, 0 if bad else 1))
    labels_df = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {x.doc_id: x.kept for x in quality.judge(documents(spark, rows), labels_df).collect()}
    good = [i for i, q in labels if q]
    assert sum(not got[i] for i in good) <= quality.RISK * len(good)
    assert not any(got[i] for i, q in labels if not q)
    # Few labels prove nothing, so nothing is rejected.
    few = quality.judge(documents(spark, rows[:200]), labels_df.where("doc_id < 200")).where("not kept")
    assert few.count() == 0


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    rows = [(None, None), (1, ""), (1, "a b c"), (2, " ".join(f"w{i}" for i in range(40))), (3, "same " * 40)]
    got = quality.judge(documents(spark, rows), labels).collect()
    assert sorted((x.n_words, x.base_failed, x.kept) for x in got) == [
        (0, True, False), (0, True, False), (3, True, False), (40, False, True), (40, True, False)]
    wide = documents(spark, rows).selectExpr("*", "1 AS _q", "2 AS kept", "3 AS stratum")
    kept = quality.good_documents(wide, labels)
    assert kept.columns == wide.columns and [x.doc_id for x in kept.collect()] == [2]
    assert quality.judge(documents(spark, []), labels.limit(0)).collect() == []


# --- language --------------------------------------------------------------------------------------


def chance_by_force(segments, word, chance):
    """Sum over all segmentations, one by one."""
    marked = "▁" + word

    def rest(i):
        if i == len(marked):
            return 1.0
        total = 0.0
        for j in range(i + 1, len(marked) + 1):
            number = segments.number.get(marked[i:j], segments.unknown if j == i + 1 else None)
            if number is not None:
                total += chance[number, 0] * rest(j)
        return total
    return rest(0)


def test_long_runs_sum_over_all_segmentations():
    """Against sums in rationals, over runs whose probability lies below the least double."""
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aab", "bbbb"]
    segments, r = langid.Segments(pieces), random.Random(4)
    share = [Fraction(r.randint(1, 9), 10**r.choice([3, 7])) for _ in range(len(pieces) + 1)]
    padded = langid._padded(np.array([[float(x)] * 2 for x in share]))
    number = {p: i for i, p in enumerate(pieces)}

    def exact(word):
        marked = "▁" + word
        total = [Fraction(1)] + [Fraction(0)] * len(marked)
        for end in range(1, len(marked) + 1):
            for start in range(end):
                piece = marked[start:end]
                if piece in number or end - start == 1:
                    total[end] += total[start] * share[number.get(piece, len(pieces))]
        return total[-1]

    for length in (1, 39, 40, 41, 80, 200):
        words = ["".join(r.choices("abc", weights=[5, 4, 1], k=length)) for _ in range(3)]
        got = segments.log_chances(words, padded)
        for w, row in zip(words, got, strict=True):
            want = exact(w)
            assert isclose(row[0], log(want.numerator) - log(want.denominator), rel_tol=1e-12, abs_tol=1e-12) and row[0] == row[1]
    assert segments.words("A" * 500 + " b2c") == ["a" * 500, "b", "c"]
    # Expected uses of long and short runs agree where both can be computed.
    found = segments.lattice(["ab" * 20])
    own, logs = padded[:, [0]], np.log(np.maximum(padded[:, 0], 1e-300))
    assert np.allclose(np.log(segments.forward(found, own)[0, :, 0]), segments.forward_logs(found, logs)[0])
    assert np.allclose(np.log(segments.backward(found, own)[0, :, 0]), segments.backward_logs(found, logs)[0])


def test_forward_sums_all_segmentations():
    segments = langid.Segments(["▁", "▁a", "a", "b", "ab", "▁ab", "ba"])
    chance = np.random.default_rng(1).random((8, 1))
    for word in ("a", "ab", "abab", "bqa"):
        found = segments.lattice([word])
        padded = langid._padded(chance)
        assert segments.forward(found, padded)[0, -1, 0] == pytest.approx(chance_by_force(segments, word, chance))
        assert segments.backward(found, padded)[0, 0, 0] == pytest.approx(chance_by_force(segments, word, chance))


def test_languages_of_held_out_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.predict(docs, tokenizer("piece_bpe_32k.model")).where("held_out").collect()
    right = sum(r.lang_pred == lang[r.doc_id] for r in rows)
    assert len(rows) > 100 and right >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    rows = [(i, "der und die das ist ein", "de") for i in range(20)] + [(i, "the and of that is was", "en") for i in range(20, 40)]
    odd = [(100, None), (101, ""), (102, "123 !!"), (None, "the of and"), (104, "ß" * 3000), (105, "日本語")]
    got = {r.doc_id: r for r in langid.predict(documents(spark, rows + odd), tokenizer("piece_bpe_32k.model")).collect()}
    assert {got[i].lang_pred for i in (100, 101, 102)} == {"und"} and got[None].lang_pred == "en" and got[104].lang_pred in ("de", "en")
    assert got[105].lang_pred in ("de", "en")
    alone = langid.predict(documents(spark, odd), tokenizer("piece_bpe_32k.model")).collect()
    assert {r.lang_pred for r in alone} == {"und"} and langid.predict(documents(spark, []), tokenizer("piece_bpe_32k.model")).collect() == []


# --- toxicity --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def letters(spark):
    return toxicity.language_model(table(spark, "/root/testdata/sf0.01", "documents"))


def test_disguised_words_are_restored(letters):
    restore = toxicity.Restorer(letters)
    for token, word in [("1d10t", "idiot"), ("sc.u.m", "scum"), ("tr@sh", "trash"), ("looooser", "loser"), ("m0r0n", "moron")]:
        assert word in toxicity.restored_words(token, restore), token
    assert toxicity.restored_words("plain,", restore) == {"plain"}
    assert "i d i o t" in toxicity.tokens_of("you i d i o t there")
    assert toxicity.restored_words("i d i o t".replace(" ", "."), restore) >= {"idiot"}


def test_words_set_apart_are_restored(letters):
    restore = toxicity.Restorer(letters)
    for text, word in [("i d 1 0 t", "idiot"), ("i d  i o t", "idiot"), ("i\nd\ti\no\nt", "idiot"), ("such a l o s e r", "loser"), ("y o u i d i o t", "idiot"),
                       ("y.o.u.m.o.r.o.n", "moron"), ("b a d", "bad"), ("t h e " * 40 + "i d i o t " + "t h e " * 40, "idiot")]:
        assert word in set().union(*[toxicity.restored_words(t, restore, 8) for t in toxicity.tokens_of(text)]), text


def test_toxicity_of_held_out_texts(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert len(toxic) > 50
    # Some junk texts are labelled toxic without any word that others share.
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.03 * len(clean)


def test_toxicity_odd_rows(spark):
    rows = [(i, f"you are a moron number {i}" if i % 2 else f"you are a friend number {i}") for i in range(60)]
    odd = [(100, None), (101, ""), (None, "moron"), (103, "m o r o n"), (104, "M0R0N!!!"), (105, "a" * 20_000 + "1")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (100, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(documents(spark, rows + odd), labels).collect()}
    assert [got[i].predicted for i in (100, 101, None, 103, 104, 105)] == [0, 0, 1, 1, 1, 0]
    none = toxicity.score(documents(spark, rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and toxicity.score(documents(spark, []), labels).collect() == []


# --- token ids -------------------------------------------------------------------------------------


def odd_texts():
    r = random.Random(8)
    letters = "abcDEé ß'sΣςİJ̌ǰ12３½٣!?<|>_-\n\t  \u0085\x1c日本語한글🙂éﬁ"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 40))) for _ in range(400)]
    return texts + [None, "", " ", "<|endoftext|>", "a<|startoftext|>b<|endoftext|>", "it's WE'LL don't", "x" * 3000, "ΑΣ ΟΔΟΣ"]


@pytest.mark.parametrize("block_chars", [wordbpe.BLOCK_CHARS, 50])
def test_ids_and_texts_equal_the_library(spark, block_chars):
    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = odd_texts()
    docs = documents(spark, [(i, t) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in wordbpe.digests(docs, path, block_chars).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == expected, t


def test_encode_then_decode(spark, sf_dir):
    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = table(spark, sf_dir, "documents")
    encoded = wordbpe.encode(docs, path)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    decoded = {r.doc_id: r.text for r in wordbpe.decode(encoded, path).collect()}
    for r in docs.collect():
        assert ids[r.doc_id] == library.encode(r.text, add_special_tokens=False).ids
        assert decoded[r.doc_id] == library.decode(ids[r.doc_id], skip_special_tokens=False)


def test_ids_of_odd_rows(spark):
    path = tokenizer("word_bpe_49k.json")
    rows = wordbpe.digests(documents(spark, [(None, "a b"), (1, "a b"), (1, "a b")]), path).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 2), (1, 2), (1, 2)]
    assert wordbpe.digests(documents(spark, []), path).collect() == []


# --- benchmark leaks -------------------------------------------------------------------------------


def leaks_by_force(docs, items):
    def split(text):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def runs(words):
        return [tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    best = {}
    for d, text in docs:
        words = split(text)
        places = {}
        for p, s in enumerate(runs(words)):
            places.setdefault(s, []).append(p)
        for item, other in items:
            want = runs(split(other))
            n = len(split(other))
            starts = {max(0, p - q) for q, s in enumerate(want) for p in places.get(s, [])}
            for start in starts:
                have = Counter(runs(words[start:start + n]))
                both = sum((have & Counter(want)).values())
                score = both / (sum(have.values()) + len(want) - both)
                if score >= 0.75 and (score, -start) > best.get((d, item), (0, 0)):
                    best[d, item] = (score, -start)
    return {k: (s, -p) for k, (s, p) in best.items()}


def test_leaks_match_brute_force(spark, sf_dir):
    docs, items = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    got = {(r.doc_id, r.item_id): (pytest.approx(r.similarity), r.start) for r in decontaminate.leaks(docs, items).collect()}
    expected = leaks_by_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert len(expected) > 5 and {k: (v[0], v[1]) for k, v in expected.items()} == got


def test_changed_items_are_found(spark):
    r = random.Random(6)
    item = [f"w{i}" for i in range(40)]
    def around():
        return [f"u{r.randrange(10**6)}" for _ in range(50)]
    changed = item[:20] + ["other"] + item[21:]
    docs = [(1, " ".join(around() + item + around())), (2, " ".join(around() + changed + around())), (3, " ".join(around() + item[:15] + around())),
            (4, None), (5, ""), (None, " ".join(item)), (6, " ".join(item)), (6, " ".join(item)), (7, "two words"), (8, " ".join(item).upper())]
    items = [(10, " ".join(item)), (10, " ".join(item)), (11, None), (12, ""), (None, " ".join(item)), (13, "two words")]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.leaks(documents(spark, docs), items_df).collect()
    assert sorted((x.doc_id, x.item_id) for x in rows) == [(1, 10), (2, 10), (6, 10), (7, 13), (8, 10)]
    assert decontaminate.leaks(documents(spark, []), items_df).collect() == [] and decontaminate.leaks(documents(spark, docs), items_df.limit(0)).collect() == []
    kept = decontaminate.clean_documents(documents(spark, docs), items_df)
    assert sorted(x.doc_id or 0 for x in kept.collect()) == [0, 3, 4, 5]


def test_items_in_another_order_are_found(spark):
    r = random.Random(7)
    docs, items = [], []
    for k, n in enumerate((100, 40, 24)):
        item = [f"i{k}w{j}" for j in range(n)]
        items.append((k, " ".join(item)))
        for d, cut in enumerate((n // 2, n // 4, n - n // 8, 0)):
            around = [[f"u{r.randrange(10**6)}" for _ in range(m)] for m in (r.choice((0, 60)), r.choice((0, 60)))]
            docs.append((10 * k + d, " ".join(around[0] + item[cut:] + item[:cut] + around[1])))
    best = {}
    for d, text in docs:
        words = text.split()
        for item, other in items:
            want = other.split()
            shingles = Counter(zip(*(want[i:] for i in range(5)), strict=False))
            for start in range(len(words)):
                window = words[start:start + len(want)]
                have = Counter(zip(*(window[i:] for i in range(5)), strict=False))
                both = (have & shingles).total()
                score = both / (have.total() + shingles.total() - both)
                if score >= 0.75:
                    best[d, item] = max(score, best.get((d, item), 0))
    got = decontaminate.leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    # The halves of the first item are exchanged in document 0.
    assert {(x.doc_id, x.item_id): x.similarity for x in got} == pytest.approx(best) and best[0, 0] == pytest.approx(92 / 100)


def test_only_texts_with_windows_are_shuffled(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, f"before {item} after"), (1, "another row of one id"), (1, f"{item}"), (2, "nothing of any item is here at all")] + [
        (i, f"text number {i} of no item") for i in range(3, 30)], "doc_id long, text string")
    items, plans, kept = spark.createDataFrame([(7, item)], "item_id long, text string"), [], decontaminate.stored

    def seen(df, name):
        if name == "windows":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, name)
    monkeypatch.setattr(decontaminate, "stored", seen)
    found = [tuple(r) for r in decontaminate.leaks(docs, items).collect()]
    monkeypatch.setattr(decontaminate, "SENT_DOCUMENTS", 0)
    assert found == [tuple(r) for r in decontaminate.leaks(docs, items).collect()] and [(r[0], r[1], r[3]) for r in found] == [(1, 7, 1.0)]
    assert "LeftSemi" in plans[0] and "LeftSemi" not in plans[1]


def test_leaks_run_no_python(spark, sf_dir):
    plan = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_hash_blocks_hold_all_bits(spark):
    from pyspark.sql import functions as F
    row = spark.range(1).select(decontaminate.blocks_of(F.lit(-1).cast("bigint"), 24).alias("b")).first()
    assert sum(x["value"].bit_count() for x in row.b) == 64 and len(row.b) == 25
