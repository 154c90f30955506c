"""Quality rules with risk-controlled cutoffs.

A rule rejects a text if one of its measures lies above a cutoff. Cutoffs are chosen per stratum
(language) on labelled texts: a cutoff may be used if the exact binomial (Clopper-Pearson) upper
bound of its rate of rejected good texts is at most `risk / number of rules`, at a level of
`delta / (strata * rules * cutoffs)`. By Bonferroni all usable cutoffs hold together with a chance of
at least 1 - delta, so any choice among them is safe, and all rules of a stratum together reject at
most `risk` of its good texts. The one with the largest gain is taken: bad texts rejected less LOSS times the
good ones.

Rules for odd input: null and empty texts have no words and fail the base rules; a null language is
a stratum of its own; strata with too few labels get no cutoff and reject nothing; a text labelled
several times counts once for each label; rows without a label, a text or an id don't count as
labelled. Clashing extra columns are kept by `good_documents` and ignored elsewhere.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import stored

RISK = 0.05
DELTA = 0.05
# A good text lost weighs as so many bad ones rejected.
LOSS = 10
# Measures, each higher for worse texts, and the cutoffs that are tried.
RULES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "word_length")
GRID = {
    "symbol_share": [round(0.01 * i, 2) for i in range(1, 41)],
    "dup_line_share": [round(0.02 * i, 2) for i in range(1, 41)],
    "repeat_share": [round(0.01 * i, 2) for i in range(1, 41)],
    "upper_share": [round(0.02 * i, 2) for i in range(1, 41)],
    "word_length": [round(5 + 0.25 * i, 2) for i in range(1, 41)],
}
MIN_WORDS = 20
WINDOW = 8
# Rows of the table of cutoffs that may be sent to every executor.
SENT_STRATA = 100_000

_SPACE = " \t\n\x0b\x0c\r"
_COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper long"


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words inside a run of `window` words that occurs twice or more, the first time included.

    Runs of doubled length are numbered exactly from the numbers of their halves.
    """
    n = len(words)
    if n <= window:
        return 0
    numbers: dict = {}
    rank = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if len(numbers) == n:
        return 0
    span = 1
    while span < window:
        rank = np.unique(rank[:-span] * (n + 1) + rank[span:], return_inverse=True)[1]
        span *= 2
    often = np.bincount(rank)[rank] > 1
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.flatnonzero(often), 1)
    np.add.at(edges, np.flatnonzero(often) + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def counts_of(text: str | None) -> tuple[int, ...]:
    """The counts named in _COUNTS."""
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    chars = len(text) - sum(map(text.count, _SPACE))
    low = text.lower()
    if len(low) == len(text):
        upper = int(np.count_nonzero(np.frombuffer(low.encode("utf-32-le"), "<u4") != np.frombuffer(text.encode("utf-32-le"), "<u4")))
    else:
        upper = sum(map(str.isupper, text))
    return len(words), chars, sum(map(text.count, "#*$%&|<>")), len(lines), len(lines) - len(set(lines)), repeated_words(words), upper


def _measure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counts_of(t) for t in texts], columns=[c.split()[0] for c in _COUNTS.split(", ")])


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(f"_q.{part}"), F.col(f"_q.{whole}")), F.lit(0.0))


def measures() -> dict[str, Column]:
    """The rules' measures over the counts in column _q."""
    return {"symbol_share": _share("n_symbols", "word_chars"), "dup_line_share": _share("n_dup_lines", "n_lines"),
            "repeat_share": _share("n_repeat_words", "n_words"), "upper_share": _share("n_upper", "word_chars"),
            "word_length": _share("word_chars", "n_words")}


def base_failed() -> Column:
    n, again = F.col("_q.n_words"), F.col("_q.n_repeat_words")
    return (n < MIN_WORDS) | (100 * again > 30 * n)


def with_counts(docs: DataFrame) -> DataFrame:
    """`docs` with the counts of its texts in column _q."""
    return docs.withColumn("_q", F.pandas_udf(_measure, _COUNTS)(F.col("text")))


def stratum() -> Column:
    return F.coalesce(F.col("lang"), F.lit(""))


# --- cutoffs ---------------------------------------------------------------------------------------


def at_most(k: int, n: int, p: float) -> float:
    """Chance that a binomial (n, p) is at most k, summed exactly in logarithms."""
    if k >= n:
        return 1.0
    i = np.arange(k, dtype=np.float64)
    steps = np.log((n - i) / (i + 1)) + math.log(p / (1 - p))
    logs = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)])
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def usable(k: int, n: int, risk: float, level: float) -> bool:
    """Whether the exact upper bound of the rate, from k in n, is at most `risk` at `level`."""
    return bool(n) and k < risk * n and at_most(k, n, risk) <= level


def cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, one column per rule): the cutoffs of each stratum, null where a rule has none.

    `counted` has (doc_id, lang, digest, _q); `labels` has (doc_id, quality).
    """
    marked = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 1).alias("good")).distinct()
    rows = counted.where("doc_id is not null and digest is not null").join(marked, "doc_id")
    # Copies of a text are one draw.
    rows = rows.select(stratum().alias("stratum"), "digest", "good", *[c.alias(r) for r, c in measures().items()]).dropDuplicates(
        ["stratum", "digest", "good"])

    def passed(rule: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(x)) for x in GRID[rule]]), lambda x: F.col(rule) > x))
    cells = rows.select("stratum", "good", F.posexplode(F.array(*[passed(r) for r in RULES])).alias("rule", "passed")).groupBy(
        "stratum", "rule", "passed").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    strata = cells.groupBy("stratum").agg(F.lit(1)).count()
    level = delta / max(1, strata * len(RULES) * max(map(len, GRID.values())))
    grids = [GRID[r] for r in RULES]

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grid = grids[key[1]]
        good = np.bincount(pdf["passed"], pdf["good"], len(grid) + 1).astype(np.int64)
        bad = np.bincount(pdf["passed"], pdf["bad"], len(grid) + 1).astype(np.int64)
        # A text that passes i cutoffs is rejected by the first i of them.
        lost, gone = good[::-1].cumsum()[::-1][1:], bad[::-1].cumsum()[::-1][1:]
        gains = [(int(gone[i] - LOSS * lost[i]), grid[i]) for i in range(len(grid))
                 if gone[i] > LOSS * lost[i] and usable(int(lost[i]), int(good.sum()), risk / len(grids), level)]
        best = [(key[0], key[1], float(max(gains)[1]))] if gains else []
        return pd.DataFrame(best, columns=["stratum", "rule", "cutoff"])

    chosen = cells.groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule int, cutoff double")
    return chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == i, F.col("cutoff"))).alias(f"_c{i}") for i in range(len(RULES))])


def _judged(counted: DataFrame, table: DataFrame) -> DataFrame:
    """`counted` with base_failed and kept."""
    table = stored(table, "cutoffs")
    small = table.limit(SENT_STRATA + 1).count() <= SENT_STRATA
    joined = counted.withColumn("stratum", stratum()).join(F.broadcast(table) if small else table, "stratum", "left")
    over = F.lit(False)
    for i, measure in enumerate(measures().values()):
        over = over | F.coalesce(measure > F.col(f"_c{i}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | over))


def _counted(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return with_counts(docs.select("doc_id", "lang", "text")).select(
        "doc_id", "lang", F.when(text.isNotNull(), F.xxhash64(text)).alias("digest"), "_q")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row (doc_id, the counts, the measures, base_failed, kept) for each row of `docs`."""
    counted = stored(_counted(docs), "counts")
    judged = _judged(counted, cutoffs(counted, labels, risk, delta))
    return judged.select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words",
                         *[c.alias(r) for r, c in measures().items()], "base_failed", "kept")


def good_documents(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of `docs` that the rules keep.

    The counts are made twice, so that no text has to be shuffled to meet them.
    """
    table = cutoffs(stored(_counted(docs), "counts"), labels, risk, delta)
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    counted = with_counts(packed.select("_row", F.col("_row.text").alias("text"), F.col("_row.lang").alias("lang"))).drop("text")
    return _judged(counted, table).where("kept").select("_row.*")
