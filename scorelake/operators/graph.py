"""Graph retrieval: entity graph, seeds, personalised PageRank, passages by both."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators import diffusion
from scorelake.operators.ranking import top_k
from scorelake.operators.vectors import block_scores, blocks_of, dense_top_k, nearest_vectors, similar_pairs
from scorelake.session import checkpointed, stored

PASSAGE_WEIGHT = 0.05
SYNONYM_THRESHOLD = 0.85


# --- entity graph ------------------------------------------------------------------------------------------


def entity_mentions(extractions: DataFrame, key: str = "user_id") -> DataFrame:
    """(user, chunk_id, entities, triples) to distinct lower-case mentions per chunk."""
    entity = F.lower(F.trim(F.col("entity")))
    return extractions.select(key, "chunk_id", F.explode("entities").alias("entity")).select(
        key, "chunk_id", entity.alias("entity")).where(F.col("entity") != "").distinct()


def fact_triples(extractions: DataFrame, key: str = "user_id") -> DataFrame:
    """Distinct lower-case (subject, predicate, object) per chunk; incomplete ones dropped."""
    def clean(f: str) -> Column:
        return F.lower(F.trim(F.col(f"_t.{f}")))
    return extractions.select(key, "chunk_id", F.explode("triples").alias("_t")).select(
        key, "chunk_id", clean("subject").alias("subject"), clean("predicate").alias("predicate"), clean("object").alias("object")).distinct()


def entities(mentions: DataFrame, triples: DataFrame, key: str = "user_id") -> DataFrame:
    """Distinct names from mentions and triple ends, empty ones removed."""
    names = mentions.select(key, "entity").union(triples.select(key, "subject")).union(triples.select(key, "object"))
    return names.where(F.col("entity") != "").distinct()


def passage_node(c: Column) -> Column:
    return F.concat(F.lit("passage:"), c.cast("string"))


def entity_node(c: Column) -> Column:
    return F.concat(F.lit("ent:"), c)


def build_graph(mentions: DataFrame, triples: DataFrame, key: str = "user_id") -> DataFrame:
    """Undirected edges (src < dst): passage-entity of weight 1, facts weighted by their count."""
    p, e = passage_node(F.col("chunk_id")), entity_node(F.col("entity"))
    # Node names differ where passages and entities do, and those are shorter.
    links = mentions.select(key, "chunk_id", "entity").distinct().select(key, F.least(p, e).alias("src"), F.greatest(p, e).alias("dst")).withColumns(
        {"weight": F.lit(1.0), "type": F.lit("passage_entity")})
    s, o = entity_node(F.col("subject")), entity_node(F.col("object"))
    facts = triples.where((F.col("subject") != "") & (F.col("object") != "") & (F.col("subject") != F.col("object")))
    counted = facts.groupBy(key, F.least(s, o).alias("src"), F.greatest(s, o).alias("dst")).agg(
        F.count(F.lit(1)).cast("double").alias("weight")).withColumn("type", F.lit("fact"))
    return links.unionByName(counted)


def graph_nodes(entity_names: DataFrame, passages: DataFrame, key: str = "user_id") -> DataFrame:
    """All nodes, also those without an edge."""
    return entity_names.select(key, entity_node(F.col("entity")).alias("node")).union(
        passages.select(key, passage_node(F.col("chunk_id")).alias("node"))).distinct()


def synonym_edges(entity_vectors: DataFrame, edges: DataFrame, threshold: float = SYNONYM_THRESHOLD, key: str = "user_id") -> DataFrame:
    """Similar entities that no edge links yet. `entity_vectors` has (user, entity, embedding)."""
    near = similar_pairs(entity_vectors, threshold, key, "entity")
    a, b = entity_node(F.col("id_a")), entity_node(F.col("id_b"))
    return near.select(key, F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.col("cosine").alias("weight"),
                       F.lit("synonymy").alias("type")).join(edges.select(key, "src", "dst"), [key, "src", "dst"], "left_anti")


def entity_seeds(queries: DataFrame, entity_vectors: DataFrame, k: int = 10, key: str = "user_id") -> DataFrame:
    """(query_id, node, weight, user): the k nearest entities of each query, with their cosine if it is positive."""
    near = dense_top_k(queries, entity_vectors, k, key, "entity", positive=True).select(
        "query_id", entity_node(F.col("entity")).alias("node"), F.col("score").alias("weight"))
    return near.join(queries.select("query_id", key), "query_id")


def passage_seeds(queries: DataFrame, chunk_vectors: DataFrame, key: str = "user_id") -> DataFrame:
    """(query_id, user, chunk_ids, weights): every passage with a weak weight, one row for each block of passages."""
    scores = block_scores(queries, blocks_of(chunk_vectors, key, "chunk_id"))
    return scores.select("query_id", key, F.col("ids").alias("chunk_ids"), F.transform("scores", lambda x: x * PASSAGE_WEIGHT).alias("weights"))


def link_seeds(queries: DataFrame, entity_vectors: DataFrame, chunk_vectors: DataFrame, k: int = 10, key: str = "user_id") -> DataFrame:
    """All seeds as rows (query_id, node, weight, user), those of the passages unpacked.

    `graph_retrieve` doesn't need the passages' rows: it pushes their vectors instead.
    """
    weak = passage_seeds(queries, chunk_vectors, key).select("query_id", key, F.explode(F.arrays_zip("chunk_ids", "weights")).alias("_s")).select(
        "query_id", passage_node(F.col("_s.chunk_ids")).alias("node"), F.col("_s.weights").alias("weight"), key)
    return entity_seeds(queries, entity_vectors, k, key).select("query_id", "node", "weight", key).unionByName(weak)


def personalized_pagerank(nodes: DataFrame | None, edges: DataFrame, seeds: DataFrame, alpha: float = 0.5, max_iter: int = 100,
                          tol: float = 1e-6, key: str = "user_id") -> DataFrame:
    """Scores (query_id, user, node, score, converged) for all queries at once; nodes without a row have score 0.

    Without `nodes` they are the ends of the edges. Edges are undirected. Seeds, with weights of either sign, are scaled to a sum of 1. Their mass is pushed along the
    edges only where it is (see `diffusion.push`), so work and rows follow it; the sum of the absolute errors of a
    query is below tol times its number of nodes. Mass of nodes without edges returns to the seeds: all
    scores grow by the same factor, so they are pushed without it and scaled at the end.
    """
    graph = diffusion.Graph(edges, key)
    totals = stored(seeds.groupBy("query_id", key).agg(F.sum("weight").alias("_total")), "totals")
    # Rows hold no more columns than a user has queries.
    width = diffusion.lane_width(totals, "query_id", key)
    lanes = stored(diffusion.in_lanes(totals, "query_id", key, width).join(totals, ["query_id", key]), "lanes")
    known = seeds if nodes is None else seeds.join(nodes.select(key, "node"), [key, "node"], "left_semi")
    seed = known.join(lanes, [key, "query_id"]).select(
        key, "query_id", "lane", "col", "node", F.coalesce(F.try_divide("weight", "_total"), F.lit(0.0)).alias("value"))
    names = diffusion.names_of(lanes, "query_id", key, width)
    rows = stored(diffusion.spread(seed, [key, "lane", "node"], "col", "value", width).join(names, [key, "lane"]), "seeds")
    found, unfinished = diffusion.push(graph, rows, alpha, tol, max_iter, width, None, nodes is not None)
    scores = diffusion.named_values(found, key, "query_id")
    converged, factor = F.lit(True), F.lit(1.0)
    if nodes is not None:
        lost = seed.join(graph.all_nodes(), [key, "node"], "left_anti").groupBy("query_id", key).agg(F.sum("value").alias("_lost"))
        scores, factor = scores.join(lost, ["query_id", key], "left"), 1 - alpha * F.coalesce("_lost", F.lit(0.0))
    if graph.large is not None:
        late = lanes.join(unfinished, [key, "lane"], "left_semi").select("query_id", key, F.lit(True).alias("_late"))
        scores, converged = scores.join(late, ["query_id", key], "left"), F.col("_late").isNull()
    return scores.select("query_id", key, "node", (F.col("value") / factor).alias("score"), converged.alias("converged"))


def smoothed_passages(graph: diffusion.Graph, chunk_vectors: DataFrame, alpha: float = 0.5, tol: float = 1e-9, max_iter: int = 100, key: str = "user_id") -> DataFrame:
    """(user, node, embedding): for every passage the vector whose product with a query is what all passages, seeded with
    their cosine to it, send there. It depends on no query, as pushing is linear.
    """
    unit = F.transform("_v", lambda x: F.try_divide(x, F.col("_norm")))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    rows = chunk_vectors.select(key, passage_node(F.col("chunk_id")).alias("node"), F.col("embedding").cast("array<double>").alias("_v")).withColumn("_norm", norm)
    width = diffusion.WIDTH
    flat = rows.select(key, "node", F.transform(unit, lambda x: F.coalesce(x, F.lit(0.0))).alias("_u"))
    parts = flat.select(key, "node", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("_u") - 1) / width).cast("int")),
                                                             lambda i: F.slice("_u", i * width + 1, F.lit(width)))).alias("_part", "_s"))
    # The last part is filled up with zeros.
    filled = parts.select(key, F.col("_part").cast("string").alias("lane"), "node",
                          F.concat("_s", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("_s"))).alias("values"))
    found, _ = diffusion.push(graph, stored(filled, "parts"), alpha, tol, max_iter)
    dims = rows.groupBy(key).agg(F.max(F.size("_v")).alias("_dim"))
    whole = found.where(F.startswith(F.col("node"), F.lit("passage:"))).groupBy(key, "node").agg(
        F.sort_array(F.collect_list(F.struct(F.col("lane").cast("int").alias("lane"), "values"))).alias("_parts"))
    return whole.join(dims, key).select(key, "node", F.slice(F.flatten(F.col("_parts.values")), F.lit(1), F.col("_dim")).alias("embedding"))


def top_up(first: DataFrame, fallback: DataFrame, k: int, item: str = "chunk_id") -> DataFrame:
    """Ranked hits of `first`, filled from `fallback` with items not yet present, up to k per query."""
    both = first.select("query_id", item, F.lit(0).alias("_src"), "rank").unionByName(
        fallback.select("query_id", item, F.lit(1).alias("_src"), "rank"))
    best = both.groupBy("query_id", item).agg(F.min(F.struct("_src", "rank")).alias("_b"))
    return top_k(best.select("query_id", item, F.col("_b._src").alias("_src"), F.col("_b.rank").alias("_r")),
                 ["query_id"], [F.col("_src"), F.col("_r")], k).select("query_id", item, "rank")


def _dots(pairs: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """`pairs` with the product of two vectors of equal length, by Arrow batches; the vectors go."""
    def dot(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(np.dot(np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64))) for x, y in zip(a, b)])
    return pairs.withColumn(name, F.pandas_udf(dot, "double")(F.col(left).cast("array<double>"), F.col(right).cast("array<double>"))).drop(left, right)


def graph_passages(queries: DataFrame, chunk_vectors: DataFrame, entity_vectors: DataFrame, nodes: DataFrame, edges: DataFrame, passages: DataFrame,
                   k: int, key: str = "user_id", max_iter: int = 100, tol: float = 1e-6, alpha: float = 0.5) -> DataFrame:
    """(query_id, chunk_id, score): the k best passages by PageRank; queries that can't be ranked have no row.

    The seeds of a query are its nearest entities and, weakly, all passages of the graph. The entities' mass is
    pushed for each query. What the passages' seeds send is the product of the query with one smoothed vector for each
    passage, so the best passages by that part are a bounded vector search. As entities only add to a
    score, the k best of all are among those and the passages that entity mass has reached.
    """
    graph = diffusion.Graph(edges, key)
    seeded = chunk_vectors.join(passages, [key, "chunk_id"], "left_semi")
    smooth = stored(smoothed_passages(graph, seeded, alpha, min(tol, 1e-9), max_iter, key), "smooth")
    unit = F.transform("_v", lambda x: F.coalesce(F.try_divide(x, F.col("_norm")), F.lit(0.0)))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    asked = checkpointed(queries.select(key, "query_id", F.col("embedding").cast("array<double>").alias("_v")).withColumn("_norm", norm).where("_norm > 0").select(
        key, "query_id", unit.alias("embedding")))
    # The seeds' sum: what all passages add to it is the product with the sum of their unit vectors.
    near = entity_seeds(asked, entity_vectors, key=key).join(nodes.select(key, "node"), [key, "node"], "left_semi")
    near = checkpointed(near.select("query_id", key, "node", "weight"))
    vectors = seeded.select(key, F.col("embedding").cast("array<double>").alias("_v")).withColumn("_norm", norm)
    sums = vectors.select(key, F.posexplode(unit).alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("x")).groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("_sum"))
    weak = _dots(asked.join(sums, key), "embedding", "_sum", "_weak")
    strong = near.groupBy("query_id").agg(F.sum("weight").alias("_strong"))
    totals = weak.join(strong, "query_id", "left").select(
        "query_id", key, (F.col("_weak") * PASSAGE_WEIGHT + F.coalesce("_strong", F.lit(0.0))).alias("_total"))
    totals = checkpointed(totals)
    width = diffusion.lane_width(near, "query_id", key)
    lanes = checkpointed(diffusion.in_lanes(near, "query_id", key, width))
    rows = stored(diffusion.spread(near.join(lanes, [key, "query_id"]), [key, "lane", "node"], "col", "weight", width), "seeds")
    found, late = diffusion.push(graph, rows, alpha, tol, max_iter, width)
    reached = checkpointed(diffusion.column_values(found, lanes, key, "query_id").where(F.startswith(F.col("node"), F.lit("passage:"))).select(
        "query_id", key, "node", F.col("value").alias("_entity")))
    late = lanes.join(late, [key, "lane"], "left_semi").select("query_id")

    best = nearest_vectors(asked, blocks_of(smooth, key, "node", unit_length=False), k, unit_length=False).select("query_id", "node")
    positive = totals.where("_total > 0")
    # A negative sum turns the order round, and entities take from a score then: all passages of such a query are scored.
    turned = totals.where("_total < 0").join(smooth.select(key, "node"), key).select("query_id", "node")
    candidates = best.unionByName(reached.select("query_id", "node")).join(positive.select("query_id"), "query_id", "left_semi").unionByName(turned).distinct()
    scored = candidates.join(asked.select("query_id", key, F.col("embedding").alias("_q")), "query_id").join(
        smooth.select(key, "node", F.col("embedding").alias("_m")), [key, "node"])
    both = _dots(scored, "_q", "_m", "_dense").join(reached, ["query_id", key, "node"], "left").join(totals, ["query_id", key])
    score = (F.col("_dense") * PASSAGE_WEIGHT + F.coalesce("_entity", F.lit(0.0))) / F.col("_total")
    chunk_type = dict(chunk_vectors.dtypes)["chunk_id"]
    ranked = both.join(late, "query_id", "left_anti").select(
        "query_id", F.substring("node", F.lit(len("passage:") + 1), F.length("node")).cast(chunk_type).alias("chunk_id"), score.alias("score"))
    return top_k(ranked, ["query_id"], [F.desc("score"), F.desc("chunk_id")], k)


def graph_retrieve(queries: DataFrame, chunk_vectors: DataFrame, entity_vectors: DataFrame, mentions: DataFrame, triples: DataFrame,
                   k: int, key: str = "user_id", max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """Passages by PageRank, filled up with dense hits; dense alone for users without a graph or convergence."""
    mentions, triples = stored(mentions, "mentions"), stored(triples, "triples")
    names = entities(mentions, triples, key)
    edges = build_graph(mentions, triples, key)
    edges = edges.unionByName(synonym_edges(entity_vectors, edges, key=key))
    edges = stored(edges, "edges")
    passages = mentions.select(key, "chunk_id").distinct()
    nodes = graph_nodes(names, passages, key)
    by_graph = graph_passages(queries, chunk_vectors, entity_vectors, nodes, edges, passages, k, key, max_iter, tol)
    return top_up(by_graph, dense_top_k(queries, chunk_vectors, k, key), k)
