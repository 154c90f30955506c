"""Language identification by unigrams summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a
word is the sum over all ways to cut it into pieces, by a forward pass; that of a text is the product
over its words. The piece probabilities are fitted by expectation-maximisation, whose expected
counts come from the forward and a backward pass.

Rules for odd input: texts that are null or hold no letter are `und` with score 0; without any
training text all are `und`; letters outside the vocabulary count alike for all languages; equally
likely languages go by name. A run of letters is one word, however long. The score is the posterior of the
language under the model and is not calibrated: it is near 1 for most texts. Rows without doc_id are not used for training and are not held out.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import given_id, solid_id, stored

# Texts of a language that the pieces are fitted on, about; chosen by a hash of the text.
TRAIN_TEXTS = 4_000
ROUNDS = 2
# Runs of up to so many letters are summed as they are, many at once; longer ones by logarithms, as their probabilities may
# lie below the least double.
PLAIN_RUN = 40
# Longer runs, as in scripts without blanks, are scored like all others, but the pieces aren't fitted on them.
TRAIN_RUN = 10_000
CACHED_WORDS = 400_000
CACHED_CHARS = 20_000_000
_SMOOTH = 0.1


def vocabulary(path: str) -> list[str]:
    """Pieces of letters of a sentencepiece model; a leading mark stands for the start of a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p == p.lower() and re.fullmatch(r"▁?[^\W\d_]*", p)})


class Segments:
    """Finds the pieces in words and sums over the segmentations of many words at once."""

    def __init__(self, pieces: list[str]):
        self.number = {p: i for i, p in enumerate(pieces)}
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.runs = re.compile(r"[^\W\d_]+")

    def words(self, text: str) -> list[str]:
        return self.runs.findall(text.lower())

    def lattice(self, words: list[str]) -> np.ndarray:
        """(words, start, length - 1) -> piece number, or -1; words have one length.

        A letter without a piece of its own is the unknown piece.
        """
        n = len(words[0]) + 1
        found = np.full((len(words), n, self.longest), -1, np.int32)
        get = self.number.get
        for k, word in enumerate(words):
            marked = "▁" + word
            for i in range(n):
                for j in range(i + 1, min(n, i + self.longest) + 1):
                    piece = get(marked[i:j])
                    if piece is not None:
                        found[k, i, j - i - 1] = piece
        single = found[:, :, 0]
        single[single < 0] = self.unknown
        return found

    def forward(self, found: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """(words, end, languages): summed probability of the segmentations of each prefix."""
        m, n, longest = found.shape
        total = np.zeros((m, n + 1, chance.shape[1]))
        total[:, 0] = 1
        for end in range(1, n + 1):
            for size in range(1, min(end, longest) + 1):
                total[:, end] += total[:, end - size] * chance[found[:, end - size, size - 1]]
        return total

    def backward(self, found: np.ndarray, chance: np.ndarray) -> np.ndarray:
        m, n, longest = found.shape
        total = np.zeros((m, n + 1, chance.shape[1]))
        total[:, n] = 1
        for start in range(n - 1, -1, -1):
            for size in range(1, min(n - start, longest) + 1):
                total[:, start] += total[:, start + size] * chance[found[:, start, size - 1]]
        return total

    def forward_logs(self, found: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """`forward` by logarithms, for one language: (words, end)."""
        m, n, longest = found.shape
        total = np.full((m, n + 1), -np.inf)
        total[:, 0] = 0
        for end in range(1, n + 1):
            for size in range(1, min(end, longest) + 1):
                total[:, end] = np.logaddexp(total[:, end], total[:, end - size] + logs[found[:, end - size, size - 1]])
        return total

    def backward_logs(self, found: np.ndarray, logs: np.ndarray) -> np.ndarray:
        m, n, longest = found.shape
        total = np.full((m, n + 1), -np.inf)
        total[:, n] = 0
        for start in range(n - 1, -1, -1):
            for size in range(1, min(n - start, longest) + 1):
                total[:, start] = np.logaddexp(total[:, start], total[:, start + size] + logs[found[:, start, size - 1]])
        return total

    def log_chances(self, words: list[str], padded: np.ndarray) -> np.ndarray:
        """(words, languages): logarithm of the summed probability of words of one length, however long they are.

        Of long words only the sums of the last few prefixes are held.
        """
        if len(words[0]) <= PLAIN_RUN:
            return np.log(self.forward(self.lattice(words), padded)[:, -1])
        with np.errstate(divide="ignore"):
            logs = np.log(padded)
        marked, get = ["▁" + w for w in words], self.number.get
        rows = [np.zeros((len(words), padded.shape[1]))]
        for end in range(1, len(marked[0]) + 1):
            total = np.full(rows[0].shape, -np.inf)
            for size in range(1, min(end, self.longest) + 1):
                ids = [get(w[end - size:end], self.unknown if size == 1 else -1) for w in marked]
                if max(ids) >= 0:
                    total = np.logaddexp(total, rows[-size] + logs[ids])
            rows = [*rows[1 - self.longest:], total] if self.longest > 1 else [total]
        return rows[-1]

    def batches(self, words, most: int = 4096):
        """Words of one length at a time, at most `most` together, fewer if they are long."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, same in by_length.items():
            step = max(1, min(most, most * PLAIN_RUN // max(length, 1)))
            for i in range(0, len(same), step):
                yield same[i:i + step]


def _padded(chance: np.ndarray) -> np.ndarray:
    """With a last row of zeros, which -1 points to: no piece."""
    return np.vstack([chance, np.zeros((1, chance.shape[1]))])


def _count_words(pieces: list[str]):
    def run(batches):
        segments = Segments(pieces)
        for pdf in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                counts.setdefault(lang, Counter()).update(w for w in segments.words(text) if len(w) <= TRAIN_RUN)
            yield pd.DataFrame([(lang, w, n) for lang, c in counts.items() for w, n in c.items()], columns=["lang", "word", "n"])
    return run


def _expect(pieces: list[str], langs: list[str], chance: np.ndarray):
    """Expected uses of each piece over all segmentations of the words, per language."""
    def run(batches):
        segments, padded = Segments(pieces), _padded(chance)
        column = {lang: i for i, lang in enumerate(langs)}
        for pdf in batches:
            uses = np.zeros_like(padded)
            for lang, rows in pdf.groupby("lang"):
                own = padded[:, [column[lang]]]
                weight = dict(zip(rows["word"], rows["n"], strict=True))
                for same in segments.batches(weight):
                    found, times = segments.lattice(same), np.array([weight[w] for w in same])
                    if len(same[0]) > PLAIN_RUN:
                        with np.errstate(divide="ignore"):
                            logs = np.log(own[:, 0])
                        far, near = segments.forward_logs(found, logs), segments.backward_logs(found, logs)
                    else:
                        ahead, back = segments.forward(found, own), segments.backward(found, own)
                        scale = times / ahead[:, -1, 0]
                    for start in range(found.shape[1]):
                        for size in range(1, min(found.shape[1] - start, segments.longest) + 1):
                            piece = found[:, start, size - 1]
                            if len(same[0]) > PLAIN_RUN:
                                used = np.exp(far[:, start] + logs[piece] + near[:, start + size] - far[:, -1]) * times
                            else:
                                used = ahead[:, start, 0] * own[piece, 0] * back[:, start + size, 0] * scale
                            np.add.at(uses[:, column[lang]], piece, used)
            uses[-1] = 0
            at = np.argwhere(uses > 0)
            yield pd.DataFrame({"piece": at[:, 0], "lang": at[:, 1], "n": uses[at[:, 0], at[:, 1]]})
    return run


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, pieces: list[str], train_texts: int = TRAIN_TEXTS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (piece, language), the last piece being the unknown one.

    Fitted on about `train_texts` texts of each language. What reaches the driver is one number for
    each piece of the vocabulary and language.
    """
    rows = docs.where("doc_id is not null and text is not null and lang is not null").where(~held_out())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(pieces) + 1, 0))
    grain = 1 << 20
    limits = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(grain, train_texts * grain // sizes[lang] + 1))])
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(grain)) < F.element_at(limits, F.col("lang"))).select("lang", "text")
    words = chosen.mapInPandas(_count_words(pieces), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stored(words, "words")
    chance = np.full((len(pieces) + 1, len(langs)), 1 / (len(pieces) + 1))
    for _ in range(rounds):
        uses = words.mapInPandas(_expect(pieces, langs, chance), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        counts = np.full(chance.shape, _SMOOTH)
        for piece, lang, n in uses.collect():
            counts[piece, lang] += n
        counts[-1] = _SMOOTH
        chance = counts / counts.sum(axis=0)
        chance[-1] = chance[-1].min()
    return langs, chance


def _score(pieces: list[str], langs: list[str], chance: np.ndarray):
    def run(batches):
        segments, padded = Segments(pieces), _padded(chance)
        place: dict[str, int] = {}
        logs, held = np.zeros((0, len(langs))), 0
        for pdf in batches:
            for rows in np.array_split(np.arange(len(pdf)), max(1, len(pdf) // 1000)):
                part = pdf.iloc[rows]
                texts = [segments.words(t) if t is not None else [] for t in part["text"]]
                if len(place) > CACHED_WORDS or held > CACHED_CHARS:
                    place, logs, held = {}, np.zeros((0, len(langs))), 0
                new = {w for t in texts for w in t if w not in place}
                held += sum(map(len, new))
                for same in segments.batches(new):
                    place |= {w: len(place) + i for i, w in enumerate(same)}
                    logs = np.vstack([logs, segments.log_chances(same, padded)])
                best, score = [], []
                for words in texts:
                    if not words or not langs:
                        best.append("und")
                        score.append(0.0)
                        continue
                    total = logs[[place[w] for w in words]].sum(axis=0)
                    k = int(total.argmax())
                    best.append(langs[k])
                    score.append(float(1 / np.exp(total - total[k]).sum()))
                yield pd.DataFrame({"_id": part["_id"], "lang_pred": best, "score": score})
    return run


def predict(docs: DataFrame, vocabulary_path: str, train_texts: int = TRAIN_TEXTS, rounds: int = ROUNDS) -> DataFrame:
    """One row (doc_id, held_out, lang_pred, score) for each row of `docs` (doc_id, text, lang)."""
    pieces = vocabulary(vocabulary_path)
    langs, chance = fit(docs, pieces, train_texts, rounds)
    scored = docs.select(solid_id("doc_id").alias("_id"), "text").mapInPandas(
        _score(pieces, langs, chance), "_id long, lang_pred string, score double")
    return scored.withColumn("doc_id", given_id("_id")).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
