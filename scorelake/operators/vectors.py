"""Exact nearest vectors and similar pairs over blocks with bounds.

The vectors of a user are drawn to pivots and cut into blocks of bounded size; a block is one row, with its ids, its
vectors, their mean and radius, and the range of their angles to every pivot. A small table of bounds decides
which blocks must meet before any vector is sent: a query meets a block only if the best score that its mean and radius
allow could still be among the k best, and two blocks meet only if no pivot tells all their members apart.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.operators.ranking import top_k
from scorelake.session import checkpointed

BLOCK_ROWS = 1024
PIVOTS = 32
# Blocks that every query meets first; what they hold sets its bar for the others.
FIRST_BLOCKS = 2
# Blocks whose bounds are compared in one task.
BOUND_ROWS = 256
# Scores that a batch of a whole comparison holds.
SCORES = 1 << 18
# Scores are compared with this much room, as bounds and scores are rounded differently.
ROOM = 1e-9


def _helpers():
    """NumPy helpers as closures: they travel to the workers by value."""
    def rows_of(column) -> np.ndarray:
        return np.stack([np.asarray(v, dtype=np.float64) for v in column])

    def unit(m: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norms == 0, 1.0, norms)

    def matrix(data: bytes, n: int) -> np.ndarray:
        return np.frombuffer(data, np.float64).reshape(n, -1)

    def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(a @ b.T, -1.0, 1.0))

    def nothing(*columns: str) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
    return rows_of, unit, matrix, angles, nothing


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new ids: both sides of a cogroup may come from one table."""
    return df.toDF(*[f"{c}_" for c in df.columns]).toDF(*df.columns)


@dataclass
class Blocks:
    """`packed` (key, block, n, ids, data, mean, radius, low, high); data are `n` rows of doubles, of length 1 if `unit`.

    `low` and `high` are the least and greatest angle of the members to each pivot of the user.
    """

    packed: DataFrame
    key: str
    row_id: str

    def bounds(self) -> DataFrame:
        return self.packed.select(self.key, "block", "n", "mean", "radius", "low", "high")


def blocks_of(vectors: DataFrame, key: str, row_id: str, embedding: str = "embedding", block_rows: int = BLOCK_ROWS,
              pivots: int = PIVOTS, unit_length: bool = True) -> Blocks:
    """Deal the vectors of each user to blocks around pivots; rows without a vector are left out."""
    rows_of, unit, _, angles, nothing = _helpers()
    types = dict(vectors.dtypes)
    rows = vectors.select(F.col(key), F.col(row_id), F.col(embedding).cast("array<double>").alias("_v")).where("_v is not null")
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    # Pivots are drawn by a hash; users whose vectors fit into one block need one only.
    drawn = top_k(rows.withColumn("_h", F.xxhash64(row_id)), [key], [F.col("_h"), F.col(row_id)], pivots).join(sizes, key).where(
        (F.col("rank") == 1) | (F.col("_rows") > block_rows))
    centers = drawn.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "_v"))).alias("_p")).select(key, F.col("_p._v").alias("_p"))
    centers = checkpointed(centers)
    slices = F.ceil(F.col("_rows") / block_rows).cast("int")
    dealt = rows.join(sizes, key).select(key, row_id, "_v", F.pmod(F.xxhash64(row_id), slices).cast("int").alias("_slice"))
    places = sizes.join(centers, key).select(key, "_p", F.explode(F.sequence(F.lit(0), slices - 1)).alias("_slice"))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return nothing(key, row_id, "_v", "_near")
        near = np.argmax(unit(rows_of(left["_v"])) @ unit(rows_of(right["_p"].iloc[0])).T, axis=1)
        return pd.DataFrame({key: left[key], row_id: left[row_id], "_v": left["_v"], "_near": near.astype(np.int32)})

    placed = checkpointed(dealt.groupBy(key, "_slice").cogroup(_fresh(places).groupBy(key, "_slice")).applyInPandas(
        nearest, f"{key} {types[key]}, {row_id} {types[row_id]}, _v array<double>, _near int"))
    cells = placed.groupBy(key, "_near").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_cuts"))
    numbered = placed.join(cells, [key, "_near"]).withColumn(
        "block", F.col("_near").cast("long") * 1_000_000_000 + F.pmod(F.xxhash64(row_id, F.lit(7)), F.col("_cuts")))
    members = numbered.select(key, "block").distinct().join(centers, key)

    def pack(names, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return nothing(key, "block", "n", "ids", "data", "mean", "radius", "low", "high")
        left = left.sort_values(row_id, kind="stable")
        raw = rows_of(left["_v"])
        ones = unit(raw)
        m = ones if unit_length else raw
        mean = m.mean(axis=0)
        at = angles(ones, unit(rows_of(right["_p"].iloc[0])))
        return pd.DataFrame({key: [names[0]], "block": [names[1]], "n": [len(left)], "ids": [left[row_id].tolist()], "data": [m.tobytes()], "mean": [mean.tolist()],
                             "radius": [float(np.linalg.norm(m - mean, axis=1).max())], "low": [at.min(axis=0).tolist()], "high": [at.max(axis=0).tolist()]})

    packed = numbered.groupBy(key, "block").cogroup(_fresh(members).groupBy(key, "block")).applyInPandas(
        pack, f"{key} {types[key]}, block long, n int, ids array<{types[row_id]}>, data binary, mean array<double>, radius double, low array<double>, high array<double>")
    return Blocks(checkpointed(packed), key, row_id)


# --- nearest vectors -------------------------------------------------------------------------------


def nearest_vectors(queries: DataFrame, blocks: Blocks, k: int, query_id: str = "query_id", embedding: str = "embedding", positive: bool = False,
                    unit_length: bool = True, query_rows: int = BLOCK_ROWS, met: list | None = None) -> DataFrame:
    """The k best vectors of the user for each query, (query_id, row id, score, rank); on ties the higher id first.

    Every query meets the FIRST_BLOCKS blocks whose bounds are best. Its k-th score there is its bar, and only the other
    blocks whose bounds reach it are met as well; so nothing is missed, and a met block gives at most k rows. If
    `met` is given, tables (query_id, block) of the two rounds are appended to it.
    """
    rows_of, unit, matrix, _, nothing = _helpers()
    key, row_id = blocks.key, blocks.row_id
    types, id_type = dict(queries.dtypes), dict(blocks.packed.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    q_type = types[query_id]
    rows = queries.select(key, F.col(query_id).alias("_q"), F.col(embedding).cast("array<double>").alias("_v")).where("_v is not null")
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("_slices"))
    sliced = checkpointed(rows.join(sizes, key).withColumn("_slice", F.pmod(F.xxhash64("_q"), F.col("_slices")).cast("int")))
    bounds = blocks.bounds().join(sizes, key).select(key, "block", "mean", "radius", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"))
    names = [key, "block", "_slice", "_qs", "_data"]
    schema = f"{key} {types[key]}, block long, _slice int, _qs array<{q_type}>, _data binary"

    def asker(later: bool):
        def ask(at, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return nothing(*names)
            right = right.sort_values("block")
            v = rows_of(left["_v"])
            v = unit(v) if unit_length else v
            top = v @ rows_of(right["mean"]).T + np.linalg.norm(v, axis=1, keepdims=True) * right["radius"].to_numpy()[None, :]
            first = np.argsort(-top, axis=1, kind="stable")[:, :FIRST_BLOCKS]
            wanted = np.zeros(top.shape, bool)
            np.put_along_axis(wanted, first, True, axis=1)
            if later:
                wanted = ~wanted & (top >= left["_bar"].to_numpy()[:, None] - ROOM)
            some = np.flatnonzero(wanted.any(axis=0))
            if not len(some):
                return nothing(*names)
            ids = left["_q"].to_numpy(dtype=object)
            return pd.DataFrame({key: [at[0]] * len(some), "block": right["block"].to_numpy()[some], "_slice": [at[1]] * len(some),
                                 "_qs": [ids[wanted[:, b]].tolist() for b in some], "_data": [v[wanted[:, b]].tobytes() for b in some]})
        return ask

    def best(batches):
        for pdf in batches:
            out = []
            for ids, n, data, qs, q_data in zip(pdf["ids"], pdf["n"], pdf["data"], pdf["_qs"], pdf["_data"]):
                ids = np.asarray(ids, dtype=object)
                scores = matrix(q_data, len(qs)) @ matrix(data, n).T
                keep = min(k, n)
                floor = np.partition(scores, n - keep, axis=1)[:, n - keep]
                chosen = scores >= floor[:, None]
                if positive:
                    chosen &= scores > 0
                high_first = np.array(sorted(range(n), key=ids.__getitem__, reverse=True))
                for q in np.flatnonzero(chosen.sum(axis=1) > keep):
                    # More than k because of ties at the end: the higher ids stay.
                    at = high_first[chosen[q, high_first]]
                    at = at[np.argsort(-scores[q, at], kind="stable")][:keep]
                    chosen[q] = False
                    chosen[q, at] = True
                qi, ci = np.nonzero(chosen)
                out.append(pd.DataFrame({query_id: np.asarray(qs, dtype=object)[qi], row_id: ids[ci], "score": scores[qi, ci]}))
            yield pd.concat(out, ignore_index=True) if out else nothing(query_id, row_id, "score")

    def answers(asked: DataFrame) -> DataFrame:
        if met is not None:
            met.append(asked.select(F.explode("_qs").alias(query_id), "block"))
        both = asked.join(blocks.packed.select(key, "block", "ids", "n", "data"), [key, "block"])
        return both.select("ids", "n", "data", "_qs", "_data").mapInPandas(best, f"{query_id} {q_type}, {row_id} {id_type}, score double")

    order = [F.desc("score"), F.desc(row_id)]
    start = checkpointed(answers(sliced.groupBy(key, "_slice").cogroup(_fresh(bounds).groupBy(key, "_slice")).applyInPandas(asker(False), schema)))
    bars = top_k(start, [query_id], order, k).where(F.col("rank") == k).select(F.col(query_id).alias("_q"), F.col("score").alias("_bar"))
    barred = sliced.join(bars, "_q", "left").withColumn("_bar", F.coalesce("_bar", F.lit(0.0 if positive else float("-inf"))))
    rest = answers(barred.groupBy(key, "_slice").cogroup(_fresh(bounds).groupBy(key, "_slice")).applyInPandas(asker(True), schema))
    return top_k(start.unionByName(rest), [query_id], order, k)


def dense_top_k(queries: DataFrame, chunks: DataFrame, k: int, key: str = "user_id", chunk_id: str = "chunk_id",
                positive: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact cosine top-k per query among the chunks of the same user; on ties the higher id first."""
    found = nearest_vectors(queries, blocks_of(chunks, key, chunk_id, block_rows=block_rows), k, positive=positive, query_rows=block_rows)
    return found.select("query_id", chunk_id, "score", "rank")


def block_scores(queries: DataFrame, blocks: Blocks, query_id: str = "query_id", embedding: str = "embedding", query_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, key, ids, scores): the cosine of each query to all vectors of a block, one row for each block.

    Each slice of queries meets each block of its user. The pairs are dealt by their block, so a large user's are not one
    task, and scores leave a pair SCORES at a time.
    """
    rows_of, unit, matrix, _, nothing = _helpers()
    key, types = blocks.key, dict(queries.dtypes)
    ids_type = dict(blocks.packed.dtypes)["ids"]
    rows = queries.select(key, F.col(query_id).alias("_q"), F.col(embedding).cast("array<double>").alias("_v")).where("_v is not null")
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("_slices"))
    sliced = checkpointed(rows.join(sizes, key).groupBy(key, F.pmod(F.xxhash64("_q"), F.col("_slices")).cast("int").alias("_slice")).agg(
        F.collect_list(F.struct("_q", "_v")).alias("_qs")))
    names = blocks.packed.select(key, "block").join(sizes, key).select(key, "block", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"))

    def score(batches):
        for pdf in batches:
            for user, qs, ids, n, data in zip(pdf[key], pdf["_qs"], pdf["ids"], pdf["n"], pdf["data"]):
                m, step = matrix(data, n), max(1, SCORES // n)
                for at in range(0, len(qs), step):
                    some = qs[at: at + step]
                    scores = unit(rows_of([q["_v"] for q in some])) @ m.T
                    yield pd.DataFrame({query_id: [q["_q"] for q in some], key: [user] * len(some), "ids": [ids] * len(some), "scores": list(scores)})

    # The copies of a slice of queries lie with the blocks before they meet their vectors.
    asked = names.join(sliced, [key, "_slice"]).select(key, "block", "_qs")
    return asked.join(blocks.packed.select(key, "block", "ids", "n", "data"), [key, "block"]).select(key, "_qs", "ids", "n", "data").mapInPandas(
        score, f"{query_id} {types[query_id]}, {key} {types[key]}, ids {ids_type}, scores array<double>")


# --- similar pairs ---------------------------------------------------------------------------------


def block_pairs(blocks: Blocks, threshold: float, bound_rows: int = BOUND_ROWS) -> DataFrame:
    """(key, block_a, block_b) of the blocks, a <= b, that may hold a pair with cosine >= threshold.

    Angles are a metric: if the ranges of two blocks to some pivot lie further apart than the angle of the
    threshold, no pair of theirs can reach it. Bounds meet in groups, as blocks would.
    """
    key, types = blocks.key, dict(blocks.packed.dtypes)
    *_, nothing = _helpers()
    width = math.acos(max(-1.0, min(threshold, 1.0))) + 1e-6
    table = blocks.bounds().select(key, "block", "low", "high")
    sizes = table.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / bound_rows).cast("int").alias("_groups"))
    grouped = table.join(sizes, key).withColumn("_own", F.pmod(F.xxhash64("block"), F.col("_groups")).cast("int"))
    met = grouped.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).select(
        key, F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"), "block", "low", "high", "_own")

    def near(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # Within one group each pair is seen from both sides, so blocks in order suffice there too.
        left, right = pdf[pdf["_own"] == at[1]], pdf[pdf["_own"] == at[2]]
        if left.empty or right.empty:
            return nothing(key, "block_a", "block_b")
        low_a, high_a, low_b, high_b = (np.stack(c) for c in (left["low"], left["high"], right["low"], right["high"]))
        out = []
        for i, a in enumerate(left["block"].to_numpy()):
            gap = np.maximum(low_a[i][None, :] - high_b, low_b - high_a[i][None, :]).max(axis=1)
            b = right["block"].to_numpy()[gap <= width]
            b = b[b >= a] if at[1] == at[2] else b
            out.append(pd.DataFrame({"block_a": np.minimum(a, b), "block_b": np.maximum(a, b)}))
        found = pd.concat(out, ignore_index=True)
        found.insert(0, key, at[0])
        return found

    return met.groupBy(key, "_a", "_b").applyInPandas(near, f"{key} {types[key]}, block_a long, block_b long")


def _closer(threshold: float, key: str):
    _, _, matrix, _, nothing = _helpers()

    def close(batches):
        for pdf in batches:
            out = []
            for user, a, b, ids_a, n_a, data_a, ids_b, n_b, data_b in zip(*(pdf[c] for c in (key, "block_a", "block_b", "ids_a", "n_a", "data_a", "ids_b", "n_b", "data_b"))):
                scores = matrix(data_a, n_a) @ matrix(data_b, n_b).T
                i, j = np.nonzero(scores >= threshold)
                ids_l, ids_r = np.asarray(ids_a, dtype=object)[i], np.asarray(ids_b, dtype=object)[j]
                keep = (ids_l < ids_r) if a == b else (ids_l != ids_r)
                lower = ids_l < ids_r
                lo, hi = np.where(lower, ids_l, ids_r)[keep.astype(bool)], np.where(lower, ids_r, ids_l)[keep.astype(bool)]
                out.append(pd.DataFrame({key: [user] * len(lo), "id_a": lo, "id_b": hi, "cosine": scores[i, j][keep.astype(bool)]}))
            yield pd.concat(out, ignore_index=True) if out else nothing(key, "id_a", "id_b", "cosine")
    return close


def _compared(blocks: Blocks, pairs: DataFrame, threshold: float) -> DataFrame:
    key, types = blocks.key, dict(blocks.packed.dtypes)
    id_type = types["ids"].removeprefix("array<").removesuffix(">")

    def side(x: str) -> DataFrame:
        return blocks.packed.select(key, F.col("block").alias(f"block_{x}"), F.col("ids").alias(f"ids_{x}"), F.col("n").alias(f"n_{x}"), F.col("data").alias(f"data_{x}"))
    both = pairs.join(side("a"), [key, "block_a"]).join(side("b"), [key, "block_b"])
    return both.mapInPandas(_closer(threshold, key), f"{key} {types[key]}, id_a {id_type}, id_b {id_type}, cosine double")


def similar_pairs(vectors: DataFrame, threshold: float = 0.85, key: str = "user_id", row_id: str = "vec_id",
                  block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """All pairs i < j of a user with cosine >= threshold, exactly, as (key, id_a, id_b, cosine)."""
    blocks = blocks_of(vectors, key, row_id, block_rows=block_rows, pivots=pivots)
    return _compared(blocks, checkpointed(block_pairs(blocks, threshold)), threshold)


# --- approximate pairs -----------------------------------------------------------------------------


def hash_tables(threshold: float, recall: float, bits: int) -> int:
    """Tables of `bits` random planes so that a pair at the threshold shares a bucket in one of them with the chance `recall`."""
    one = (1 - math.acos(max(-1.0, min(threshold, 1.0))) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - one))) if one < 1 else 1


def likely_pairs(vectors: DataFrame, threshold: float = 0.85, key: str = "user_id", row_id: str = "vec_id", recall: float = 0.95,
                 bits: int = 10, seed: int = 11, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Like `similar_pairs`, but only of vectors that share a bucket of random planes: each such pair is found with the
    chance `recall` or better, and no other pair is returned. For users whose vectors no pivot can part.
    """
    rows_of, unit, _, _, nothing = _helpers()
    types, tables = dict(vectors.dtypes), hash_tables(threshold, recall, bits)
    rows = vectors.select(key, row_id, F.col("embedding").cast("array<double>").alias("_v")).where("_v is not null")

    def bucketed(batches):
        planes: dict[int, np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            m = unit(rows_of(pdf["_v"]))
            if m.shape[1] not in planes:
                planes[m.shape[1]] = np.random.default_rng(seed).standard_normal((tables * bits, m.shape[1]))
            signs = (m @ planes[m.shape[1]].T >= 0).reshape(len(m), tables, bits)
            codes = (signs * (1 << np.arange(bits))).sum(axis=2)
            for t in range(tables):
                yield pd.DataFrame({key: pdf[key], row_id: pdf[row_id], "data": [r.tobytes() for r in m], "_table": np.int32(t), "_code": codes[:, t]})

    cells = rows.mapInPandas(bucketed, f"{key} {types[key]}, {row_id} {types[row_id]}, data binary, _table int, _code long")
    by = [key, "_table", "_code"]
    sizes = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("_cuts", F.ceil(F.col("_n") / block_rows).cast("int"))
    cut = cells.join(sizes, by).withColumn("_cut", F.pmod(F.xxhash64(row_id), F.col("_cuts")).cast("int"))
    # A bucket beyond the size of a block is cut, and its cuts meet two by two.
    met = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))).select(
        *by, F.least("_cut", "_other").alias("_a"), F.greatest("_cut", "_other").alias("_b"), row_id, "data", "_cut")

    def close(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["_cut"] == at[3]], pdf[pdf["_cut"] == at[4]]
        if left.empty or right.empty:
            return nothing(key, "id_a", "id_b", "cosine")
        a, b = (np.frombuffer(b"".join(x["data"]), np.float64).reshape(len(x), -1) for x in (left, right))
        scores = a @ b.T
        i, j = np.nonzero(scores >= threshold)
        ids_l, ids_r = left[row_id].to_numpy(dtype=object)[i], right[row_id].to_numpy(dtype=object)[j]
        keep = ((ids_l < ids_r) if at[3] == at[4] else (ids_l != ids_r)).astype(bool)
        lower = ids_l < ids_r
        lo, hi = np.where(lower, ids_l, ids_r)[keep], np.where(lower, ids_r, ids_l)[keep]
        return pd.DataFrame({key: [at[0]] * len(lo), "id_a": lo, "id_b": hi, "cosine": scores[i, j][keep]})

    found = met.groupBy(*by, "_a", "_b").applyInPandas(close, f"{key} {types[key]}, id_a {types[row_id]}, id_b {types[row_id]}, cosine double")
    return found.groupBy(key, "id_a", "id_b").agg(F.max("cosine").alias("cosine"))

