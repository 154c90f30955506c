"""Forward push of seed mass over undirected weighted graphs (Andersen, Chung and Lang, 2006).

A row holds the mass of one node for up to WIDTH columns: queries, or components of vectors. Edges lie in
blocks of bounded size. A task pushes within its block until no node holds more than its share of the tolerance, and
passes on only what leaves the block; blocks that get nothing are not looked at again. Graphs that fit
into one block are packed, several in a row, and done in one pass without rounds; larger ones send fewer rows with every round.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.session import checkpointed, stored

WIDTH = 64
BLOCK_EDGES = 65_536
# A graph of up to so many blocks is pushed as a whole if its nodes are no more than a block has edges: many edges cost a task
# some 20 bytes each, nodes several rows of WIDTH values.
WHOLE_BLOCKS = 32
# Edges along which mass is moved at once.
FLOW_EDGES = 32_768
# Rows of a table of users up to which it is sent to all executors.
SENT_ROWS = 100_000


def sent(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """`df`, a stored table, for a broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _pusher(alpha: float):
    """What a block does with the mass it has got, as a closure: it travels to the workers by value."""
    def push(edges: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        own = edges[~edges["src_hub"]]
        nodes = pd.Index(pd.concat([own["src"], rows.loc[~rows["hub"], "node"]]).unique())
        width = len(rows["values"].iloc[0]) if len(rows) else 0
        outside = pd.Index(edges.loc[~edges["inside"], "dst"].unique())
        hubs = rows[rows["hub"]]
        hub_index = pd.Index(hubs["node"])
        held, made, left = np.zeros((len(nodes), width)), np.zeros((len(nodes), width)), np.zeros((len(outside), width))
        plain = rows[~rows["hub"]]
        if len(plain):
            np.add.at(held, nodes.get_indexer(plain["node"]), np.stack([np.asarray(v, np.float64) for v in plain["values"]]))
        share = np.full(len(nodes), np.inf)
        share[nodes.get_indexer(own["src"])] = own["share"].to_numpy()
        # Edges in the order of where they lead: sums over a target are sums over a run.
        code = np.where(edges["inside"], nodes.get_indexer(edges["dst"]), len(nodes) + outside.get_indexer(edges["dst"]))
        order = np.argsort(code, kind="stable")
        code, p = code[order], edges["p"].to_numpy()[order]
        from_hub = edges["src_hub"].to_numpy()[order]
        src = np.where(from_hub, hub_index.get_indexer(edges["src"])[order], nodes.get_indexer(edges["src"])[order])

        own_edges = np.flatnonzero(~from_hub)

        def flow(amount: np.ndarray, at: np.ndarray) -> None:
            if not len(at):
                return
            moved = alpha * p[at, None] * amount[src[at]]
            starts = np.flatnonzero(np.diff(code[at], prepend=-1))
            sums, to = np.add.reduceat(moved, starts, axis=0), code[at][starts]
            here = to < len(nodes)
            held[to[here]] += sums[here]
            left[to[~here] - len(nodes)] += sums[~here]

        if len(hubs):
            flow(np.stack([np.asarray(v, np.float64) for v in hubs["values"]]), np.flatnonzero(from_hub & (src >= 0)))
        while True:
            over = np.abs(held) > share[:, None]
            active = over.any(axis=1)
            if not active.any():
                break
            moving = np.where(over, held, 0.0)
            held[over] = 0.0
            made += (1 - alpha) * moving
            flow(moving, own_edges[active[src[own_edges]]])

        def part(kind: int, names, values: np.ndarray) -> pd.DataFrame:
            some = np.abs(values).any(axis=1) if len(values) else np.zeros(0, bool)
            return pd.DataFrame({"kind": kind, "node": np.asarray(names, dtype=object)[some], "values": pd.Series(list(values[some]), dtype=object)})
        home = hubs[hubs["home"]]
        done = np.stack([(1 - alpha) * np.asarray(v, np.float64) for v in home["values"]]) if len(home) else np.zeros((0, width))
        return pd.concat([part(0, nodes, made), part(0, home["node"], done), part(1, outside, left), part(2, nodes, held)], ignore_index=True)
    return push


_SEP = "\u0001"


def _code(key: Column, node: Column) -> Column:
    """One name for a node of all users."""
    return F.concat(key.cast("string"), F.lit(_SEP), node)


def _thin(values: np.ndarray) -> bytes:
    """An array with the first bytes of all its values, then the second ones: most are alike, and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _packer():
    """The edges of whole graphs as one value, as a closure: it travels to the workers by value.

    Holds the nodes' codes and users, and the places of the ends and the weight of each edge.
    """
    thin, sep = _thin, _SEP

    def pack(names: tuple, edges: pd.DataFrame) -> pd.DataFrame:
        keys, users = pd.factorize(edges["key"])
        ends, nodes = pd.factorize(pd.concat([edges["src"], edges["dst"]], ignore_index=True))
        # A missing end is a node of each user: it counts as one and has weight, but what is sent there is lost.
        ends = np.where(ends < 0, len(nodes), ends).astype(np.int64)
        cells, at = np.unique(np.concatenate([keys, keys]).astype(np.int64) * (len(nodes) + 1) + ends, return_inverse=True)
        owner, node = cells // (len(nodes) + 1), cells % (len(nodes) + 1)
        codes = [f"{users[u]}{sep}{nodes[x]}" if x < len(nodes) else None for u, x in zip(owner.tolist(), node.tolist())]
        a, b = at[:len(edges)], at[len(edges):]
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b, weight = a[order].astype(np.int32), b[order].astype(np.int32), np.nan_to_num(edges["weight"].to_numpy(np.float64))[order]
        data = zlib.compress(pickle.dumps((codes, *map(thin, (owner.astype(np.int32), np.diff(a, prepend=np.int32(0)), b - a, weight)))))
        return pd.DataFrame({"block": [names[0]], "data": [data]})
    return pack


def _unpacked(rows: pd.DataFrame) -> tuple:
    """Codes of the nodes, the directed edges in the order of where they lead to, with their share of the source's weight, and for
    each node its share of the tolerance: over all nodes of a graph they add up to its number of nodes.
    """
    def thick(data: bytes, kind) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()
    codes, *columns = pickle.loads(zlib.decompress(rows["data"].iloc[0]))
    owner, step, gap, weight = (thick(c, k) for c, k in zip(columns, (np.int32, np.int32, np.int32, np.float64)))
    one = np.cumsum(step, dtype=np.int32)
    two, n = one + gap, len(codes)
    a, b, w = np.concatenate([one, two]), np.concatenate([two, one]), np.concatenate([weight, weight])
    degree = np.bincount(a, w, n)
    volume, count = np.bincount(owner, degree), np.bincount(owner)
    share = np.divide(degree, volume[owner], out=np.zeros(n), where=volume[owner] != 0) * count[owner]
    p = np.divide(w, degree[a], out=np.zeros(len(a)), where=degree[a] != 0)
    names = np.asarray(codes, dtype=object)
    missing = np.array([c is None for c in codes], bool)
    order = np.argsort(b, kind="stable")
    order = order[~(missing[a] | missing[b])[order]]
    return pd.Index(names), a[order], b[order], p[order], share


def _settle(alpha: float, tol: float):
    """Push within whole graphs until no node holds more than its share; mass at nodes of no graph ends there or goes on lost."""
    def settle(packed: tuple | None, codes: np.ndarray, values) -> tuple[np.ndarray, np.ndarray]:
        """Codes and mass of the nodes: those of the graphs, and those of `codes` without one. `values(place, n)` has the seeds' mass at n places."""
        names, a, b, p, share = packed or (pd.Index([], dtype=object), *[np.empty(0, np.int32)] * 2, *[np.empty(0)] * 2)
        n, at = len(names), names.get_indexer(codes)
        apart, where = np.unique(codes[at < 0].astype(object), return_inverse=True) if (at < 0).any() else (np.empty(0, object), None)
        at = at.astype(np.int64)
        if where is not None:
            at[at < 0] = n + where
        all_held = values(at, n + len(apart))
        held, made = all_held[:n], np.zeros_like(all_held)
        made[n:] = (1 - alpha) * all_held[n:]
        step = FLOW_EDGES
        while True:
            over = np.abs(held) > (share * tol)[:, None]
            active = over.any(axis=1)
            if not active.any():
                break
            moving = np.where(over, held, 0.0)
            held[over] = 0.0
            made[:n] += (1 - alpha) * moving
            some = np.flatnonzero(active[a])
            for cut in range(0, len(some), step):
                along = some[cut: cut + step]
                to = b[along]
                first = np.flatnonzero(np.diff(to, prepend=-1))
                held[to[first]] += np.add.reduceat(alpha * p[along, None] * moving[a[along]], first, axis=0)
        return np.concatenate([names.to_numpy(dtype=object), apart]), made
    return settle


class Graph:
    """Edges with the share of each in its source's weight, dealt to blocks.

    Graphs of up to `block_edges` edges are packed: `packed` has rows (block, data) of several whole graphs. So are larger ones of few
    nodes (WHOLE_BLOCKS), each in its own row. The others are cut and lie in `nodes` and `edges`. A node with very many edges (a hub) has them where they lead to, so
    that no block grows with it.
    """

    def __init__(self, edges: DataFrame, key: str = "user_id", block_edges: int = BLOCK_EDGES):
        self.key, self.key_type = key, dict(edges.dtypes)[key]
        self.given = stored(edges.select(key, "src", "dst", "weight"), "edges")
        sizes = stored(self.given.groupBy(key).agg((2 * F.count(F.lit(1))).alias("edges")), "sizes")
        small, most = sizes.agg(F.sum(F.when(F.col("edges") <= block_edges, F.col("edges"))), F.max("edges")).first()
        self.shared = max(1, -(-2 * (small or 0) // block_edges))
        # Users of graphs that are cut, and of packed ones that have a row of their own.
        self.large = self.own = None
        if (most or 0) > block_edges:
            big = stored(sizes.where(F.col("edges") > block_edges), "big")
            n = self._ends(self.given.join(sent(big.select(key)), key, "left_semi")).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            known = stored(big.join(n, key).select(key, ((F.col("n") <= block_edges) & (F.col("edges") <= WHOLE_BLOCKS * block_edges)).alias("whole")), "big")
            self.own = known.where("whole").select(key, F.lit(True).alias("_own"))
            large = known.where("NOT whole").select(key)
            self.large = None if large.isEmpty() else large
        whole = self.given.where(F.col(key).isNotNull())
        if self.large is not None:
            whole = whole.join(sent(self.large), key, "left_anti")
        self.packed = stored(self.placed(whole).select("block", F.col(key).cast("string").alias("key"), "src", "dst", F.col("weight").cast("double").alias("weight")).groupBy(
            "block").applyInPandas(_packer(), "block bigint, data binary"), "graphs")
        if self.large is not None:
            self._cut(self.given.join(sent(self.large), key, "left_semi"), block_edges)

    def placed(self, rows: DataFrame) -> DataFrame:
        """`rows` of users whose graphs are packed, with the `block` that holds the user's. Blocks of one graph are negative."""
        shared = F.pmod(F.xxhash64(self.key), F.lit(self.shared))
        if self.own is None:
            return rows.withColumn("block", shared)
        alone = -1 - F.pmod(F.xxhash64(self.key), F.lit(2**62))
        return rows.join(sent(self.own), self.key, "left").withColumn("block", F.when(F.col("_own"), alone).otherwise(shared)).drop("_own")

    def _ends(self, edges: DataFrame) -> DataFrame:
        return edges.select(self.key, F.col("src").alias("node")).union(edges.select(self.key, "dst")).distinct()

    def all_nodes(self) -> DataFrame:
        """(key, node) of all nodes with an edge."""
        return self._ends(self.given)

    def _cut(self, edges: DataFrame, block_edges: int) -> None:
        key = self.key
        both = edges.select(key, "src", "dst", "weight").union(edges.select(key, F.col("dst"), F.col("src"), "weight"))
        both = stored(both.groupBy(key, "src", "dst").agg(F.sum("weight").alias("weight")), "both")
        degree = stored(both.groupBy(key, F.col("src").alias("node")).agg(F.sum("weight").alias("degree"), F.count(F.lit(1)).alias("n_edges")), "degree")
        sizes = stored(degree.groupBy(key).agg(F.sum("degree").alias("volume"), F.count(F.lit(1)).alias("n"), F.sum("n_edges").alias("edges")).withColumn(
            "blocks", F.ceil(F.col("edges") / block_edges).cast("int")), "sizes")
        hub = F.col("n_edges") * 8 > block_edges
        place = F.xxhash64(F.col(key), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        self.nodes = stored(degree.join(sent(sizes), key).select(
            key, "node", _code(F.col(key), F.col("node")).alias("code"), "degree", "blocks", hub.alias("hub"), place.alias("block"),
            # The part of the tolerance that a node may keep: over all nodes of a graph they add up to its number of nodes.
            (F.col("degree") / F.col("volume") * F.col("n")).alias("share")), "places")
        a = self.nodes.select(key, F.col("node").alias("src"), F.col("code").alias("src_code"), "degree", F.col("hub").alias("src_hub"), F.col("block").alias("src_block"), "share")
        b = self.nodes.select(key, F.col("node").alias("dst"), F.col("code").alias("dst_code"), F.col("hub").alias("dst_hub"), F.col("block").alias("dst_block"))
        block = F.when(F.col("src_hub"), F.col("dst_block")).otherwise(F.col("src_block"))
        self.edges = stored(both.join(a, [key, "src"]).join(b, [key, "dst"]).select(
            block.alias("block"), F.col("src_code").alias("src"), F.col("dst_code").alias("dst"), (F.col("weight") / F.col("degree")).alias("p"), "src_hub", "share",
            (~F.col("dst_hub") & (F.col("dst_block") == block)).alias("inside")), "cut")


def _summed(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.get("values", F.lit(i))) for i in range(width)]).alias("values"))


def _apart(graph: Graph, rows: DataFrame, large: bool) -> DataFrame:
    """Those of the rows whose user has a graph beyond a block, or the others."""
    if graph.large is None:
        return rows.limit(0) if large else rows
    return rows.join(sent(graph.large), graph.key, "left_semi" if large else "left_anti")


def _lanes_of_blocks(graph: Graph, lanes: DataFrame) -> DataFrame:
    """A row (block, lane, data) of packed graphs for each lane that one of their users has."""
    wanted = stored(graph.placed(_apart(graph, lanes, False)).select("block", "lane").distinct(), "lanes")
    return graph.packed.join(sent(wanted), "block")


def push(graph: Graph, seeds: DataFrame, alpha: float = 0.5, tol: float = 1e-6, max_rounds: int = 100, width: int = WIDTH,
         passed_on: list[int] | None = None, alone: bool = True) -> tuple[DataFrame, DataFrame]:
    """Mass that stays at each node, (key, lane, node, values), and the lanes that are not done after `max_rounds`.

    `seeds`, a stored table, has (key, lane, node, values) with `width` values. If it has `names` too, the same for all rows of a
    user and lane, so has the result. A walk from a seed goes on with the chance `alpha` along an edge, by
    weight, and ends otherwise; what would leave a node without edges is lost. The sum of the absolute errors of a column is
    at most tol x the number of nodes of its graph: that much is left unpushed, and a unit of it could at most
    end somewhere else. If `passed_on` is given, the number of rows that leave their blocks is appended for each round.
    Without `alone`, nodes without edges have no row.
    """
    key, kind, settle, unpacked, sep = graph.key, graph.key_type, _settle(alpha, tol), _unpacked, _SEP
    types, named = dict(seeds.dtypes), ["names"] if "names" in seeds.columns else []

    def of_graphs(at: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty or (left.empty and not alone):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("lane", "node", "values", *named)})

        def values(place: np.ndarray, n: int) -> np.ndarray:
            held = np.zeros((n, width))
            np.add.at(held, place, np.stack([np.asarray(v, np.float64) for v in right["values"]]))
            return held
        packed = unpacked(left) if len(left) else None
        codes, made = settle(packed, right["node"].to_numpy(dtype=object), values)
        some = made.any(axis=1)
        if not alone:
            some[len(packed[0]):] = False
        out = pd.DataFrame({"lane": at[1], "node": codes[some], "values": pd.Series(list(made[some]), dtype=object)})
        if named:
            of = dict(zip((c.split(sep, 1)[0] for c in right["node"]), right["names"]))
            out["names"] = pd.Series([of[c.split(sep, 1)[0]] for c in out["node"]], dtype=object)
        return out

    rows = graph.placed(_apart(graph, seeds, False)).where(F.col(key).isNotNull() & F.col("node").isNotNull()).select(
        "block", "lane", _code(F.col(key), F.col("node")).alias("node"), "values", *named)
    by = ["block", "lane"]
    found = _lanes_of_blocks(graph, seeds).groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(
        of_graphs, ", ".join(f"{c} {types[c]}" for c in ("lane", "node", "values", *named))).select(*_node_of(key, kind), "lane", "values", *named)
    columns = [key, "lane", "node", "values", *named]
    found = found.select(*columns)
    if graph.large is None:
        if passed_on is not None:
            passed_on.append(0)
        return found, seeds.select(key, "lane").limit(0)
    cut = _apart(graph, seeds, True)
    more, late = _push_cut(graph, cut.drop(*named), alpha, tol, max_rounds, width, passed_on)
    if not alone:
        more = more.join(graph.nodes.select(key, "node"), [key, "node"], "left_semi")
    if named:
        more = more.join(cut.select(key, "lane", "names").dropDuplicates([key, "lane"]), [key, "lane"])
    return found.unionByName(more.select(*columns)), late


def _node_of(key: str, kind: str, code: str = "node") -> tuple[Column, Column]:
    """User and node of a code."""
    return F.substring_index(code, _SEP, 1).cast(kind).alias(key), F.substring(code, F.locate(_SEP, F.col(code)) + 1, F.length(code)).alias("node")


def _push_cut(graph: Graph, seeds: DataFrame, alpha: float, tol: float, max_rounds: int, width: int, passed_on: list[int] | None) -> tuple[DataFrame, DataFrame]:
    """`push` on the graphs that are cut, in rounds."""
    key, kind = graph.key, graph.key_type
    nodes = graph.nodes.select(key, "code", "block", "blocks", "hub", (F.col("share") * tol).alias("share"))
    edges = graph.edges.withColumn("share", F.col("share") * tol)
    placed = seeds.join(graph.nodes.select(key, "node", "code"), [key, "node"], "left").select(
        key, "lane", "node", "values", "code")
    alone = placed.where("code IS NULL").select("lane", _code(F.col(key), F.col("node")).alias("node"), F.transform("values", lambda v: v * (1 - alpha)).alias("values"))
    done, held = [alone], None
    come = checkpointed(placed.where("code IS NOT NULL").select("lane", F.col("code").alias("node"), "values"))
    schema = f"lane {dict(seeds.dtypes)['lane']}, kind int, node string, values array<double>"
    worker = _pusher(alpha)

    def of_block(names: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = worker(left, right)
        out.insert(0, "lane", names[1])
        return out

    def found_at(rows: DataFrame) -> DataFrame:
        return rows.join(nodes.withColumnRenamed("code", "node"), "node")

    def whole(rows: DataFrame) -> DataFrame:
        return rows.select("lane", "block", "node", "values", F.lit(False).alias("hub"), F.lit(True).alias("home"))

    for _ in range(max_rounds):
        at = found_at(come)
        work, kept = whole(at.where("NOT hub")), None
        # A hub is pushed as a whole: its mass is added up, and goes to every block that holds edges of it.
        hubs = at.where("hub") if held is None else at.where("hub").unionByName(found_at(held).where("hub"))
        hubs = checkpointed(_summed(hubs, ["lane", key, "node", "block", "blocks", "share"], width))
        ready = F.exists("values", lambda v: F.abs(v) > F.col("share"))
        waiting = hubs.where(~ready).select("lane", "node", "values")
        copies = hubs.where(ready).select("lane", "node", "values", F.col("block").alias("_home"), key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_b"))
        copies = copies.withColumn("block", F.xxhash64(key, "_b"))
        work = work.unionByName(copies.select("lane", "block", "node", "values", F.lit(True).alias("hub"), (F.col("block") == F.col("_home")).alias("home")))
        if held is not None:
            rest = found_at(held).where("NOT hub")
            active = work.select("lane", "block").distinct()
            work = work.unionByName(whole(rest.join(active, ["lane", "block"], "left_semi")))
            kept = rest.join(active, ["lane", "block"], "left_anti").select("lane", "node", "values")
        work = checkpointed(work)
        cells = edges.join(work.select("block", "lane").distinct(), "block")
        by = ["block", "lane"]
        moved = checkpointed(cells.groupBy(*by).cogroup(work.toDF(*[f"{c}_" for c in work.columns]).toDF(*work.columns).groupBy(*by)).applyInPandas(of_block, schema))
        done.append(moved.where("kind = 0").select("lane", "node", "values"))
        come = moved.where("kind = 1").select("lane", "node", "values")
        if passed_on is not None:
            passed_on.append(come.count())
        if come.limit(1).isEmpty():
            come = come.limit(0)
            break
        held = moved.where("kind = 2").select("lane", "node", "values").unionByName(waiting)
        held = checkpointed(held if kept is None else held.unionByName(kept))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    user, node = _node_of(key, kind)
    out = _summed(out, ["lane", "node"], width).select(user, "lane", node, "values")
    return out, come.select(user, "lane").distinct()


def in_lanes(rows: DataFrame, column: str, key: str, width: int = WIDTH) -> DataFrame:
    """(key, column, lane, col): distinct values of `column` dealt to lanes of at most `width`.

    Lanes are drawn by a hash and cut where one is full, so no task sees all columns of a user.
    """
    names = rows.select(key, column).distinct()
    sizes = names.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / (width * 0.75)).cast("int").alias("_lanes"))
    drawn = names.join(sizes, key).withColumn("_drawn", F.pmod(F.xxhash64(column), F.col("_lanes")))
    at = F.row_number().over(W.partitionBy(key, "_drawn").orderBy(column)) - 1
    numbered = drawn.withColumn("_at", at)
    return numbered.select(key, column, F.concat_ws(".", "_drawn", F.floor(F.col("_at") / width).cast("string")).alias("lane"), (F.col("_at") % width).cast("int").alias("col"))


def lane_width(rows: DataFrame, column: str, key: str) -> int:
    """Columns that the lanes of `rows` need: WIDTH, or as many as the user with most values of `column` has."""
    most = rows.select(key, column).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return max(1, min(WIDTH, most or 1))


def spread(rows: DataFrame, keys: list[str], col: str, value: str, width: int = WIDTH) -> DataFrame:
    """Rows (keys, col, value) to rows (keys, values), added up; columns without a row are 0."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.when(F.col(col) == i, F.col(value)).otherwise(F.lit(0.0))) for i in range(width)]).alias("values"))


def names_of(lanes: DataFrame, column: str, key: str, width: int = WIDTH) -> DataFrame:
    """(key, lane, names): the values of `column` in the order of a lane's columns."""
    return lanes.groupBy(key, "lane").agg(F.array(*[F.max(F.when(F.col("col") == i, F.col(column))) for i in range(width)]).alias("names"))


def named_values(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column, node, value) of all values that are not 0, of rows that hold their `names`."""
    cells = rows.select(key, "node", F.explode(F.arrays_zip("names", "values")).alias("_c"))
    return cells.select(key, F.col("_c.names").alias(column), "node", F.col("_c.values").alias("value")).where("value != 0")


def column_values(rows: DataFrame, lanes: DataFrame, key: str, column: str) -> DataFrame:
    """The other way round: (key, column, node, value) of all values that are not 0."""
    cells = rows.select(key, "lane", "node", F.posexplode("values").alias("col", "value")).where("value != 0")
    return cells.join(lanes, [key, "lane", "col"]).select(key, column, "node", "value")

