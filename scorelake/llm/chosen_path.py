"""Near-duplicates by a chosen-path set similarity join (Christiani, Pagh and Sivertsen, 2018).

A document is the set of its word shingles. In each of several independent trees a document goes
from a node to a child for every token whose hash, drawn anew for that node, is below
1 / (similarity * size): similar sets choose a common token with a chance of at least 1 - 1/e in
each root. Below the roots GROWTH times as many are chosen, so that a pair is unlikely to part at any
depth. Tokens of a stated share of all documents split nothing; as far as the other tokens of
a set suffice for that chance they are chosen from alone, at a higher rate. Small nodes are compared
exhaustively, larger ones branch again. Before a node branches, all its members are compared with one of them, so that a dense group becomes one
component at linear cost; from then on only members of different components are compared.
Every link is confirmed on the full sets, made anew from the texts.

Rules for odd input: texts that are null or hold no word have an empty set and link with nothing;
texts below five words are one shingle; rows without doc_id take no part (component_id null, kept);
rows under one doc_id are one document that has the links of all its rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import MASK, mixed, splitmix, stored, stored_by
from scorelake.llm.components import components

WORDS = 5
PERCENT = 75
RECALL = 0.99999
# Shared tokens that a linked pair chooses on average in a node below the roots.
GROWTH = 3
# Least hashes of a set, 16 bits each. A pair whose sketches share so little that a linked pair lies DEVIATIONS away
# is not confirmed on the texts.
SKETCH = 192
DEVIATIONS = 5.5
COLLIDED = 3
BLOCK = 512
SALTS = 16
# Bits to which sketches are folded to rule pairs out.
FOLD = 4096
MAX_DEPTH = 20
# Tokens of more than this share of all documents are common. The list has at most the mean
# size of a set over the share entries; it decides how fast nodes get small, not what is found.
COMMON_SHARE = 0.01
BUCKET_BITS = 18
# Bytes of texts that are shingled at once.
CHUNK = 1 << 16


# --- sets ------------------------------------------------------------------------------------------


class Shingler:
    """Texts to sorted arrays of 64-bit shingle hashes."""

    def __init__(self, words: int):
        self.words = words
        self.letters = splitmix(256, 11)
        # Where the words of the last text start.
        self.starts = np.empty(0, np.int64)
        self.places = splitmix(words, 12)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.undo = np.uint64(pow(0x9E3779B97F4A7C15, -1, MASK + 1))
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        self.up = np.multiply.accumulate(np.full(n, self.base))
        self.down = np.multiply.accumulate(np.full(n, self.undo))

    def word_hashes(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        if len(data) + 1 > len(self.up):
            self._grow(2 * len(data) + 2)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], self.space[data], [True]])))
        starts, stops = edges[::2], edges[1::2]
        self.starts = starts
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letters[data] * self.up[: len(data)], dtype=np.uint64)])
        return mixed((total[stops] - total[starts]) * self.down[starts] + (stops - starts).astype(np.uint64))

    def __call__(self, text: bytes | None) -> np.ndarray:
        w = self.word_hashes((text or b"").lower())
        k = min(self.words, len(w))
        if not k:
            return np.empty(0, np.uint64)
        n = len(w) - k + 1
        h = np.full(n, k, np.uint64)
        for t in range(k):
            h = h + w[t: t + n] * self.places[t]
        return np.unique(mixed(h))

    def many(self, texts: Sequence[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The shingles of all texts, a chunk of texts at a time: those of one text after those of another, and how many each has."""
        at = 0
        while at < len(texts):
            stop, n = at, 0
            while stop < len(texts) and (stop == at or n < CHUNK):
                n += len(texts[stop] or b"")
                stop += 1
            yield self._chunk([(t or b"").lower() for t in texts[at:stop]])
            at = stop

    def each(self, texts: Sequence[bytes | None]) -> Iterator[np.ndarray]:
        """The shingles of each text."""
        for found, counts in self.many(texts):
            yield from np.split(found, np.cumsum(counts)[:-1])

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # A hash does not depend on where its word lies, so texts lie one after the other, with a space between them.
        w, k = self.word_hashes(b" ".join(texts)), self.words
        ends = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(ends, self.starts, side="right")
        n = max(0, len(w) - k + 1)
        h = np.full(n, k, np.uint64)
        for t in range(k):
            h = h + w[t: t + n] * self.places[t]
        inside = doc[:n] == doc[k - 1: k - 1 + n]
        h, doc_of = mixed(h[inside]), doc[:n][inside]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(doc_of, minlength=len(texts)))])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc_of[1:] != doc_of[:-1])
        h, counts = h[new], np.bincount(doc_of[new], minlength=len(texts))
        words = np.bincount(doc, minlength=len(texts))
        if len(short := np.flatnonzero((words > 0) & (words < k))):
            parts = np.split(h, np.cumsum(counts)[:-1])
            for i in short.tolist():
                parts[i] = self(texts[i])
            h, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return h, counts


def limit_of(size: float) -> np.uint64:
    """Hashes up to this are chosen: 1 / size of all."""
    return np.uint64(min(MASK, int((MASK + 1) / max(size, 1.0))))


class Chooser:
    """The child nodes that sets choose.

    A linked pair shares at least percent / 100 of either set, so at least `left` of the tokens of a set that are
    not common. They are chosen with a chance of 1 / left, and common ones, at 100 / (percent * size), only if few
    others are left. Either way a linked pair chooses one shared token or more on average, or `growth` times as many.
    """

    def __init__(self, common: np.ndarray, percent: int):
        self.common, self.share = np.sort(common), percent / 100
        # Buckets that hold a common token; made where it is used.
        self.known: np.ndarray | None = None

    def limits(self, shingles: np.ndarray, growth: int = 1) -> np.ndarray:
        n = len(shingles)
        at = np.minimum(np.searchsorted(self.common, shingles), max(len(self.common) - 1, 0))
        often = self.common[at] == shingles if len(self.common) else np.zeros(n, bool)
        left = self.share * n - np.count_nonzero(often)
        if left >= 0.05 * n:
            return np.where(often, np.uint64(0), limit_of(left / growth))
        return np.where(often, limit_of(self.share * n / growth), limit_of(max(left, 0.04 * n) / growth))

    def __call__(self, shingles: np.ndarray, nodes: np.ndarray, growth: int = 1) -> np.ndarray:
        if not len(shingles) or not len(nodes):
            return np.empty(0, np.uint64)
        limits = self.limits(shingles, growth)
        shingles, limits = shingles[limits > 0], limits[limits > 0]
        salts = mixed(nodes) | np.uint64(1)
        at, token = np.nonzero(shingles[None, :] * salts[:, None] <= limits[None, :])
        return mixed(shingles[token] + mixed(nodes[at] + np.uint64(7)))


    def many(self, shingles: np.ndarray, counts: np.ndarray, nodes: np.ndarray) -> list[np.ndarray]:
        """What each of several sets chooses in the same nodes. The sets lie one after the other, `counts` has their sizes."""
        doc = np.repeat(np.arange(len(counts)), counts)
        often = np.zeros(len(shingles), bool)
        if len(self.common):
            if self.known is None:
                self.known = np.zeros(1 << BUCKET_BITS, bool)
                self.known[_buckets(self.common)] = True
            some = np.flatnonzero(self.known[_buckets(shingles)])
            at = np.minimum(np.searchsorted(self.common, shingles[some]), len(self.common) - 1)
            often[some[self.common[at] == shingles[some]]] = True
        left = self.share * counts - np.bincount(doc[often], minlength=len(counts))
        spare = left >= 0.05 * counts
        rare = [limit_of(x if s else max(x, 0.04 * n)) for s, x, n in zip(spare.tolist(), left.tolist(), counts.tolist())]
        common = [np.uint64(0) if s else limit_of(self.share * n) for s, n in zip(spare.tolist(), counts.tolist())]
        limits = np.where(often, np.array(common, np.uint64)[doc], np.array(rare, np.uint64)[doc])
        where, chosen = [], []
        for node, salt in zip(mixed(nodes + np.uint64(7)), mixed(nodes) | np.uint64(1)):
            hit = np.flatnonzero((shingles * salt <= limits) & (limits > 0))
            where.append(doc[hit])
            chosen.append(mixed(shingles[hit] + node))
        order = np.argsort(places := np.concatenate(where), kind="stable")
        return np.split(np.concatenate(chosen)[order], np.cumsum(np.bincount(places, minlength=len(counts)))[:-1])


def tree_count(recall: float) -> int:
    """Trees needed for a similar pair to meet in one of them at any depth.

    A node below the roots loses a pair with a chance of at most q = exp(-GROWTH * (1 - q)), however deep the tree
    is, so a tree loses it with a chance of at most exp(-(1 - q)).
    """
    q = 0.0
    for _ in range(100):
        q = math.exp(-GROWTH * (1 - q))
    return math.ceil(-math.log(1 - recall) / (1 - q))


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _count_buckets(words: int):
    def run(batches):
        shingle, n = Shingler(words), np.zeros(1 << BUCKET_BITS, np.int64)
        for pdf in batches:
            for found, _ in shingle.many(pdf["data"].tolist()):
                np.add.at(n, _buckets(found), 1)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": some, "n": n[some]})
    return run


def _count_shingles(words: int, buckets: np.ndarray):
    wanted = np.zeros(1 << BUCKET_BITS, bool)
    wanted[buckets] = True

    def run(batches):
        shingle = Shingler(words)
        for pdf in batches:
            kept = [s[wanted[_buckets(s)]] for s, _ in shingle.many(pdf["data"].tolist())]
            found, n = np.unique(np.concatenate([np.empty(0, np.uint64), *kept]), return_counts=True)
            yield pd.DataFrame({"shingle": found.view(np.int64), "n": n.astype(np.int64)})
    return run


def common_shingles(texts: DataFrame, words: int, share: float = COMMON_SHARE) -> np.ndarray:
    """Shingles of more than a share of all documents, counted over all of them.

    A first pass counts buckets of hashes; only shingles in buckets that reach the share are counted one by one.
    """
    least = max(5.0, share * texts.count())
    counts = texts.mapInPandas(_count_buckets(words), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    buckets = np.array([r["bucket"] for r in counts.where(F.col("n") > least).select("bucket").collect()], np.int64)
    if not len(buckets):
        return np.empty(0, np.uint64)
    counts = texts.mapInPandas(_count_shingles(words, buckets), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return np.array([r["shingle"] for r in counts.where(F.col("n") > least).select("shingle").collect()], np.int64).view(np.uint64)


def _signatures(words: int, chooser: Chooser, trees: int):
    roots = splitmix(trees, 21)

    def run(batches):
        shingle = Shingler(words)
        for pdf in batches:
            parts: dict[str, list] = {"n": [], "one": [], "two": [], "nodes": [], "sketch": []}
            for s, counts in shingle.many(pdf["data"].tolist()):
                keys, stops = mixed(s + np.uint64(5)), np.cumsum(counts)
                sums, some = np.zeros((2, len(counts)), np.uint64), np.flatnonzero(counts)
                if len(some):
                    sums[0, some] = np.add.reduceat(keys * s, (stops - counts)[some])
                    sums[1, some] = np.bitwise_xor.reduceat(keys, (stops - counts)[some])
                parts["n"].append(counts)
                parts["one"].append(sums[0].view(np.int64))
                parts["two"].append(sums[1].view(np.int64))
                parts["nodes"] += [f.view(np.int64) for f in chooser.many(s, counts, roots)]
                for k in np.split(keys, stops[:-1]):
                    least = np.partition(k, SKETCH - 1)[:SKETCH] if len(k) > SKETCH else k
                    parts["sketch"].append(least.astype(np.uint16).view(np.int16))
            flat = {c: np.concatenate(parts[c]) if parts[c] else np.empty(0, np.int64) for c in ("n", "one", "two")}
            yield pd.DataFrame({"_id": pdf["_id"].to_numpy(), **flat, "nodes": pd.Series(parts["nodes"], dtype=object), "sketch": pd.Series(parts["sketch"], dtype=object)})
    return run


def _branch(words: int, chooser: Chooser):
    def run(batches):
        shingle = Shingler(words)
        for pdf in batches:
            found = [chooser(shingle(text), nodes.astype(np.int64).view(np.uint64), GROWTH).view(np.int64)
                     for text, nodes in zip(pdf["data"], pdf["nodes"], strict=True)]
            yield pd.DataFrame({"_id": np.repeat(pdf["_id"].to_numpy(), [len(f) for f in found]), "node": np.concatenate(found) if found else []})
    return run


def _confirm(words: int, percent: int):
    def run(batches):
        shingle = Shingler(words)
        for pdf in batches:
            # Pairs with one document come one after the other, so its set is made once for a run of them.
            v = pdf["v"].to_numpy()
            first = np.diff(v, prepend=v[:1] - 1) != 0
            rights = shingle.each(pdf["other"][first].tolist())
            hit, right = [], np.empty(0, np.uint64)
            for left, new in zip(shingle.each(pdf["data"].tolist()), first.tolist(), strict=True):
                right = next(rights) if new else right
                both = np.count_nonzero(right[np.minimum(np.searchsorted(right, left), len(right) - 1)] == left) if len(right) else 0
                hit.append(bool(both) and 100 * both >= percent * (len(left) + len(right) - both))
            yield pdf.loc[hit, ["u", "v"]]
    return run


def least_common(low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
    """Values that the sketches of sets of sizes `low` <= `high` have in common, if barely linked, less the deviations.

    A linked pair has percent / (100 + percent) of both sizes in common, and the sketch of the larger set is the
    denser one. Sketches are drawn without replacement, so there is no deviation if they hold the sets; COLLIDED
    values may be lost as they have 16 bits.
    """
    share, size = percent / (100 + percent) * (1 + low / high), np.minimum(SKETCH, low)
    spread = np.sqrt(share * (1 - share) * size * (high - size) / np.maximum(high - 1, 1))
    return np.where(high <= SKETCH, percent / (100 + percent) * (low + high), share * size - DEVIATIONS * spread) - COLLIDED


def _exhaust(percent: int, forest: bool):
    """Pairs of different components within a block whose sizes and sketches don't rule out a link.

    A pair that meets in several nodes is taken in the least of them. With `forest`, only as many of the likeliest pairs as
    tie the components together: fewer than there are members.
    """
    def of_block(rows: list[tuple], out: list) -> None:
        found: list[tuple] = []
        node = rows[0][0][0]
        ids = np.array([r[1] for r in rows], np.int64)
        own, label, n = np.array([r[2] for r in rows], bool), np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
        folded, spare = np.zeros((len(rows), FOLD // 64), np.uint64), np.zeros(len(rows), np.int64)
        for i, r in enumerate(rows):
            bits = np.zeros(FOLD, np.uint8)
            bits[r[5].astype(np.int64) % FOLD] = 1
            folded[i] = np.packbits(bits, bitorder="little").view("<u8")
            spare[i] = len(np.unique(r[5])) - bits.sum()
        sets: dict[int, tuple[frozenset, frozenset]] = {}

        def of(i: int) -> tuple[frozenset, frozenset]:
            if i not in sets:
                sets[i] = frozenset(rows[i][5].tolist()), frozenset(rows[i][6].tolist())
            return sets[i]

        for i in range(len(rows) - 1):
            low, high = np.minimum(n[i], n[i + 1:]), np.maximum(n[i], n[i + 1:])
            at = np.flatnonzero((label[i] != label[i + 1:]) & (own[i] | own[i + 1:]) & (100 * low >= percent * high))
            if not len(at):
                continue
            other, floor = at + i + 1, least_common(low[at], high[at], percent)
            # Two values of a sketch may share a bit; with those added the bits are never fewer than the common values.
            most = np.bitwise_count(folded[i] & folded[other]).sum(axis=1, dtype=np.int64) + spare[i]
            for j, least in zip(other[most >= floor].tolist(), floor[most >= floor].tolist(), strict=True):
                (mine, my_nodes), (its, its_nodes) = of(i), of(j)
                if min(my_nodes & its_nodes) == node and (shared := len(mine & its)) >= least:
                    found.append((least - shared, i, j))
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        for _, i, j in sorted(found) if forest else found:
            a, b = top(int(label[i])), top(int(label[j]))
            if a != b or not forest:
                above[max(a, b)] = min(a, b)
                out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))

    def run(batches):
        held: list[tuple] = []
        out: list = []
        for pdf in batches:
            for node, block, id_, own, label, n, sketch, nodes in zip(
                    *(pdf[c] for c in ("node", "block", "_id", "own", "label", "n", "sketch", "nodes")), strict=True):
                if held and held[0][0] != (node, block):
                    of_block(held, out)
                    held = []
                held.append(((node, block), id_, own, label, n, sketch, nodes))
            yield pd.DataFrame(out, columns=["u", "v"])
            out = []
        if held:
            of_block(held, out)
        yield pd.DataFrame(out, columns=["u", "v"])
    return run


# --- the join --------------------------------------------------------------------------------------


def _likely(percent: int) -> Column:
    """Whether sizes and sketches of a pair leave a link possible; see `least_common`."""
    na, nb = F.col("a.n"), F.col("b.n")
    low, high = F.least(na, nb), F.greatest(na, nb)
    part = F.lit(percent / (100 + percent))
    share, size = part * (1 + low / high), F.least(F.lit(SKETCH), low)
    spread = F.sqrt(share * (1 - share) * size * (high - size) / F.greatest(high - 1, F.lit(1)))
    floor = F.when(high <= SKETCH, part * (low + high)).otherwise(share * size - DEVIATIONS * spread) - COLLIDED
    return (100 * low >= percent * high) & (F.size(F.array_intersect("a.sketch", "b.sketch")) >= floor)


class _Join:
    """State of one join: signatures, the texts of candidates, and what is linked so far."""

    def __init__(self, docs: DataFrame, words: int, percent: int, recall: float, block: int, max_depth: int):
        self.words, self.percent, self.block, self.max_depth = words, percent, block, max_depth
        self.texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").cast("binary").alias("data"))
        self.chooser = Chooser(common_shingles(self.texts, words), percent)
        sigs = stored(self.texts.mapInPandas(
            _signatures(words, self.chooser, tree_count(recall)),
            "_id long, n long, one long, two long, nodes array<long>, sketch array<smallint>"), "signatures")
        # Each document with the least id of those with an identical set; an empty set is like no other.
        reps = sigs.where("n > 0").groupBy("n", "one", "two").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
        # One set may be that of a third of all documents, so its rows are dealt out over SALTS tasks.
        reps = reps.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = sigs.select("_id", "n", "one", "two", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int").alias("_salt"))
        self.classes = stored(salted.join(reps, ["n", "one", "two", "_salt"], "left").select(
            "_id", "n", F.coalesce("rep", "_id").alias("rep")), "classes")
        first = self.classes.where("_id = rep AND n > 0").select("_id").distinct()
        self.sigs = stored_by(sigs.where("n > 0").join(first, "_id", "left_semi"), "sets", "_id")
        self.one_sig = self.sigs.select("_id", "n", "sketch").dropDuplicates(["_id"])
        self.roots: DataFrame | None = None

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) whose full sets are similar enough."""
        left = pairs.join(self.texts.withColumnRenamed("_id", "u"), "u")
        both = left.join(self.texts.select(F.col("_id").alias("v"), F.col("data").alias("other")), "v")
        return stored(both.select("u", "v", "data", "other").mapInPandas(_confirm(self.words, self.percent), "u long, v long"), "links")

    def link(self, edges: DataFrame) -> None:
        """Add links (u, v): components of those that are known are joined where a link ties them."""
        if self.roots is None:
            self.roots = components(edges)
            return
        known = self.roots
        ends = edges.join(known.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left").join(
            known.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")).where("u != v")
        ends = stored(ends.distinct(), "ties")
        if ends.isEmpty():
            return
        above = components(ends).select(F.col("node").alias("root"), F.col("root").alias("top"))
        moved = known.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        new = above.select(F.col("root").alias("node"), F.col("top").alias("root")).join(known.select("node"), "node", "left_anti")
        self.roots = stored(moved.unionByName(new), "roots")

    def labelled(self, nodes: DataFrame) -> DataFrame:
        """Rows (node, _id, label) of the nodes in which more than one component is left, with their counts."""
        rows = nodes.join(self.roots.select(F.col("node").alias("_id"), "root"), "_id", "left").select(
            "node", "_id", F.coalesce("root", "_id").alias("label"))
        by_label = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"))
        counts = by_label.groupBy("node").agg(
            F.sum("c").alias("m"), F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("most"),
            F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        return rows.join(counts, "node")

    def stars(self, nodes: DataFrame) -> DataFrame:
        """Each member of a node with the least member, once over all nodes, if a link is possible."""
        hubs = nodes.groupBy("node").agg(F.min("_id").alias("v"))
        pairs = nodes.join(hubs, "node").where("_id != v").select(F.col("_id").alias("u"), "v").distinct()
        return pairs.join(self.one_sig.alias("a"), F.col("u") == F.col("a._id")).join(self.one_sig.alias("b"), F.col("v") == F.col("b._id")).where(
            _likely(self.percent)).select("u", "v")

    def exhaust(self, rows: DataFrame, forest: bool = False) -> DataFrame:
        """All pairs of different components within the nodes of `rows`, if a link is possible; see `_exhaust`.

        A node is dealt out in blocks. Members outside its main component go to every block, so
        that each meets every other member; pairs within the main component need no comparison,
        and the one pair of a node of two has been looked at as its star.
        """
        rows = rows.where("m > 2")
        blocks = F.ceil(F.col("m") / self.block).cast("int")
        own = rows.select("node", F.pmod(F.xxhash64("_id"), blocks).cast("int").alias("block"), "_id", "label", F.lit(True).alias("own"))
        sent = rows.where((F.col("label") != F.col("main")) & (F.col("m") > self.block)).select(
            "node", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "_id", "label", F.lit(False).alias("own"))
        places = rows.groupBy("_id").agg(F.collect_list("node").alias("nodes"))
        sig = self.one_sig.join(places, "_id")
        return own.unionByName(sent).join(sig, "_id").repartition("node", "block").sortWithinPartitions("node", "block").mapInPandas(
            _exhaust(self.percent, forest), "u long, v long").distinct()

    def run(self) -> None:
        """Fill `roots` with (node, root) of all documents in components of more than one distinct set."""
        all_nodes = self.sigs.select("_id", F.explode("nodes").alias("node")).distinct()
        crowded = all_nodes.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("node")
        nodes = stored(all_nodes.join(crowded, "node").select("node", "_id"), "nodes")
        # From here on only documents that share a node with another one matter.
        self.texts = stored_by(self.texts.join(nodes.select("_id").distinct(), "_id", "left_semi"), "candidates", "_id")
        several = self.classes.groupBy("_id").agg(F.min("rep").alias("v"), F.collect_set("rep").alias("all")).where(F.size("all") > 1)
        first = several.select(F.explode("all").alias("u"), "v")
        for depth in range(1, self.max_depth + 1):
            # Every step is stored before the next one starts, so no job plans more than one step.
            ties = self.confirmed(stored(self.stars(nodes), "stars"))
            self.link(ties.unionByName(first) if depth == 1 else ties)
            rows = stored(self.labelled(nodes), "open")
            # Comparing all is linear while few members lie outside the main component.
            cheap = (F.col("m") <= self.block) | ((F.col("m") - F.col("most")) * F.ceil(F.col("m") / self.block) <= 4 * F.col("m"))
            last = depth == self.max_depth
            near, wide = rows if last else rows.where(cheap), rows.where(~cheap)
            # The likeliest pairs first: in a dense group they tie all, and few are left for the whole comparison.
            self.link(self.confirmed(stored(self.exhaust(near, forest=True), "likely")))
            left = stored(self.labelled(near.select("node", "_id")), "left")
            self.link(self.confirmed(stored(self.exhaust(left), "pairs")))
            if last or wide.isEmpty():
                break
            per_doc = wide.groupBy("_id").agg(F.collect_list("node").alias("nodes"))
            grown = stored(self.texts.join(per_doc, "_id").select("_id", "data", "nodes").mapInPandas(
                _branch(self.words, self.chooser), "_id long, node long"), "children")
            crowd = grown.groupBy("node").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).where("low != high").select("node")
            nodes = stored(grown.join(crowd, "node").select("node", "_id").distinct(), "nodes")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, recall: float = RECALL,
                    block: int = BLOCK, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each row of `docs`.

    Sets are linked if 100 * intersection >= percent * union. `recall` is the chance that a linked
    pair meets in a node of one of the trees. The node's size decides how it is compared: exhaustively
    in blocks, or by branching up to `max_depth` levels, after which nodes are compared exhaustively
    whatever their size.
    """
    join = _Join(docs, words, percent, recall, block, max_depth)
    join.run()
    found = join.classes.join(join.roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.least(F.coalesce("root", "rep"), "_id").alias("component_id"))
    lost = docs.where("doc_id is null").select(F.lit(None).cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("data")).mapInPandas(
        _sizes(words), "doc_id long, n_shingles long").withColumn("component_id", F.lit(None).cast("bigint"))
    return found.unionByName(lost).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sizes(words: int):
    def run(batches):
        shingle = Shingler(words)
        for pdf in batches:
            counts = [n for _, n in shingle.many(pdf["data"].tolist())]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": np.concatenate(counts) if counts else []})
    return run
