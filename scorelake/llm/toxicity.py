"""Toxicity scores of texts after noisy-channel deobfuscation.

A suspicious token (look-alike signs among letters, letters set apart, drawn-out letters) becomes a
lattice: each sign may stand for one of several letters, or for nothing, and a repeated letter may
be one too many, each at a cost. Signs set apart, from three up, are read as one word and also with
word ends where the letters make them likely; toxic words are then sought from every start within
the run. A Viterbi pass under a character trigram model of the corpus finds the likeliest letters.
The restored words are then scored by the words and word beginnings that the labelled texts show to
be toxic.

Rules for odd input: null and empty texts have the score of a text without toxic words; without
labels every score is 0; texts labelled both ways count as both; rows without doc_id are not used
for training and not held out. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.chosen_path import Shingler
from scorelake.llm.common import given_id, solid_id, stored

# Labelled texts that the word weights are fitted on, about; chosen by a hash of the text.
TRAIN_TEXTS = 20_000
THRESHOLD = 0.7
# A word counts as toxic if it is in so many labelled toxic texts, and so often among all.
MIN_TEXTS = 4
MIN_SHARE = 0.6
# Words of such a share are toxic by themselves; what else is toxic is learned from texts without them.
STRONG_SHARE = 0.9
BEGINNINGS = (4, 5, 6)
CACHED_TOKENS = 400_000

# What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
# Costs in nats.
_STAND_IN, _DROP_SIGN, _DROP_STAR, _DROP_REPEAT, _WILD = 1.0, 6.0, 2.0, 0.5, 4.0
_LETTERS = "".join(chr(c) for c in range(ord("a"), ord("z") + 1)) + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
_K = len(_LETTERS) + 2  # 0 is no letter, the last is any other letter
_TABLE = np.zeros(0x10000, np.uint8)
_TABLE[[ord(c) for c in _LETTERS]] = np.arange(1, len(_LETTERS) + 1)

_RUN = re.compile(r"[^\W\d_]+")
_APART = re.compile(r"(?<!\w)(?:[^\W\d_]|[0-9@$!|+(<€£¡])(?:[\s.\-_*]++(?:[^\W\d_]|[0-9@$!|+(<€£¡])){2,}(?!\w)")
_GAP = re.compile(r"[\s.\-_]+")
_EDGES = ".,;:?\"'()[]{}<>#%&~^=/\\*`-_"
_DRAWN = re.compile(r"([^\W\d_])\1\1")
_SIGNS = re.compile(r"[0-9@$!|+(<€£¡*.\-_\s]")


def letter_codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    codes = _TABLE[np.minimum(points, 0xFFFF)]
    other = np.flatnonzero((codes == 0) & (points > 0x7F))
    if len(other):
        codes = codes.copy()
        codes[other] = [_K - 1 if chr(p).isalpha() else 0 for p in points[other].tolist()]
    return codes


def _trigrams(batches):
    """Counts of letter triples per task; their number is bounded by the alphabet."""
    counts = np.zeros(_K**3, np.int64)
    for pdf in batches:
        for text in pdf["text"]:
            c = letter_codes(f"  {text} ").astype(np.int64)
            np.add.at(counts, (c[:-2] * _K + c[1:-1]) * _K + c[2:], 1)
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"gram": at, "n": counts[at]})


def language_model(docs: DataFrame) -> np.ndarray:
    """Log chances (before, last, next) of letters, from all texts."""
    grams = docs.where("text is not null").select("text").mapInPandas(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(_K**3)
    for gram, n in grams.collect():
        counts[gram] = n
    three = counts.reshape(_K, _K, _K)
    two = three.sum(axis=0)
    one = (two.sum(axis=0) + 1) / (two.sum() + _K)
    pair = (two + one) / (two.sum(axis=1, keepdims=True) + 1)
    triple = (three + pair[None]) / (three.sum(axis=2, keepdims=True) + 1)
    # A mixture: restored words need not look like the rest of the corpus.
    return np.log(0.6 * triple + 0.25 * pair[None] + 0.15 * one)


class Restorer:
    """Viterbi decoding of suspicious tokens."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.code = {c: i + 1 for i, c in enumerate(_LETTERS)} | {" ": 0}

    def choices(self, token: str, ends: bool = False) -> list[list[tuple[str, float]]]:
        """Per sign the letters it may be and their costs; an empty string drops it. With `ends` a blank may stay."""
        out: list[list[tuple[str, float]]] = []
        for i, c in enumerate(token):
            if c.isalpha():
                own = [(c, 0.0)]
                if i and token[i - 1] == c:
                    own.append(("", _DROP_REPEAT))
            elif c == "*":
                own = [("", _DROP_STAR)] + [(x, _WILD) for x in _LETTERS[:26]]
            elif ends and c == " ":
                own = [("", 0.0), (" ", 0.0)]
            else:
                own = [(x, _STAND_IN) for x in LOOKALIKES.get(c, "")] + [("", _DROP_SIGN if c in LOOKALIKES else 0.0)]
            out.append(own)
        return out

    def __call__(self, token: str, ends: bool = False) -> str:
        model, code, rest = self.model, self.code, _K - 1
        # (letter before, last letter) -> (cost, letters so far, each with those before it, so that the work stays linear)
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for own in self.choices(token, ends):
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, done) in states.items():
                for letter, extra in own:
                    if letter:
                        c = code.get(letter, rest)
                        state, total = (b, c), cost + extra - model[a][b][c]
                    else:
                        state, total = (a, b), cost + extra
                    old = following.get(state)
                    if old is None or total < old[0]:
                        following[state] = (total, (done, letter) if letter else done)
            states = following
        (a, b), (_, done) = min(states.items(), key=lambda s: s[1][0] - model[s[0][0]][s[0][1]][0])
        letters = []
        while done:
            done, letter = done
            letters.append(letter)
        return "".join(reversed(letters))


def suspicious(token: str) -> bool:
    return bool(_RUN.search(token) and _SIGNS.search(token)) or bool(_DRAWN.search(token))


def restored_words(token: str, restore: Restorer, longest: int = 0) -> set[str]:
    """The words of a token as written and, if it looks disguised, as restored.

    Of signs set apart, where a word ends is not known, all stretches of up to `longest` letters are words.
    """
    low = token.lower().strip(_EDGES)
    if low[-2:] in ("$$", "!!", "@@", "||", "++"):
        low = low.rstrip("$!@|+")
    words = set(_RUN.findall(low))
    core = low.rstrip("!|")
    if suspicious(core):
        whole = restore(core)
        words |= set(_RUN.findall(whole))
        if _APART.fullmatch(core):
            parted = restore(_GAP.sub(" ", core), ends=True)
            words |= set(_RUN.findall(parted))
            words |= {w[i:j] for w in {whole, parted.replace(" ", "")} for i in range(len(w)) for j in range(i + 1, min(i + longest, len(w)) + 1)}
    return words


def tokens_of(text: str) -> set[str]:
    """Distinct tokens between white space; letters and look-alikes set apart also make one token together."""
    return set(text.split()) | set(_APART.findall(text))


def features_of(words: set[str]) -> set[str]:
    return words | {w[:n] + "-" for w in words for n in BEGINNINGS if len(w) > n}


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _training_features(model: np.ndarray):
    def run(batches):
        restore, shingle = Restorer(model), Shingler(5)
        for pdf in batches:
            rows = []
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                s = shingle(text.encode())
                words = set().union(*[restored_words(t, restore) for t in tokens_of(text)])
                rows.append((int(s.min().astype(np.int64)) if len(s) else 0, bool(toxic), sorted(features_of(words))))
            yield pd.DataFrame(rows, columns=["kind", "toxic", "features"])
    return run


def weights(docs: DataFrame, labels: DataFrame, model: np.ndarray, train_texts: int = TRAIN_TEXTS) -> tuple[dict[str, float], float]:
    """Chance of being toxic for a text with each toxic word or beginning, and for one without any.

    Of near copies, which mostly share their least shingle, one counts.
    """
    marked = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic").distinct()
    ids = docs.where("doc_id is not null and text is not null").where(~held_out()).select("doc_id", F.xxhash64("text").alias("h"))
    known = ids.join(marked, "doc_id")
    total = known.count()
    if not total:
        return {}, 0.0
    grain = 1 << 20
    share = min(grain, train_texts * grain // total + 1)
    chosen = stored(known.where(F.pmod("h", F.lit(grain)) < share).select("doc_id", "toxic"), "chosen")
    # About `train_texts` ids, so they go to the texts; many copies of one text could make them more.
    few = chosen.limit(4 * train_texts + 1).count() <= 4 * train_texts
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen) if few else chosen, "doc_id").select("text", "toxic").mapInPandas(
        _training_features(model), "kind long, toxic boolean, features array<string>").dropDuplicates(["kind", "toxic"])
    rows = stored(rows, "features")
    strong = _chances(rows, STRONG_SHARE, "f NOT LIKE '%-'")
    others = rows.mapInPandas(_without_any(set(strong)), "toxic boolean, features array<string>")
    found = strong | _chances(others, MIN_SHARE, "true")
    rest, rest_bad = rows.mapInPandas(_without_any(set(found)), "toxic boolean, features array<string>").agg(F.count(F.lit(1)), F.count_if("toxic")).first()
    return found, (rest_bad + 0.01) / (rest + 1)


def _chances(rows: DataFrame, least: float, kind: str) -> dict[str, float]:
    """Smoothed share of toxic texts among those with a feature, where it is `least` or more."""
    n, bad = rows.agg(F.count(F.lit(1)), F.count_if("toxic")).first()
    counts = rows.select("toxic", F.explode("features").alias("f")).where(kind).groupBy("f").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("toxic").alias("bad"))
    chance = (F.col("bad") + 2 * bad / max(n, 1)) / (F.col("n") + 2)
    likely = counts.where(F.col("bad") >= MIN_TEXTS).select("f", chance.alias("p")).where(F.col("p") >= least)
    return {r["f"]: r["p"] for r in likely.collect()}


def _without_any(found: set):
    def run(batches):
        for pdf in batches:
            yield pdf.loc[[found.isdisjoint(f) for f in pdf["features"]], ["toxic", "features"]]
    return run


def _score(model: np.ndarray, found: dict[str, float], base: float):
    def run(batches):
        restore, cache, longest = Restorer(model), {}, max(map(len, found), default=0)
        for pdf in batches:
            scores = []
            for text in pdf["text"]:
                best = base
                for token in tokens_of(text or ""):
                    p = cache.get(token)
                    if p is None:
                        p = max((found[f] for f in features_of(restored_words(token, restore, longest)) if f in found), default=0.0)
                        if len(cache) > CACHED_TOKENS:
                            cache.clear()
                        cache[token] = p
                    if p > best:
                        best = p
                scores.append(best)
            yield pd.DataFrame({"_id": pdf["_id"], "score": np.array(scores, float)})
    return run


def score(docs: DataFrame, labels: DataFrame, train_texts: int = TRAIN_TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) for each row of `docs`; labels are (doc_id, toxic)."""
    model = language_model(docs)
    found, base = weights(docs, labels, model, train_texts)
    scored = docs.select(solid_id("doc_id").alias("_id"), "text").mapInPandas(_score(model, found, base), "_id long, score double")
    return scored.withColumn("doc_id", given_id("_id")).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
