"""Approximate nearest neighbours by NN-descent and greedy graph search.

Distinct vectors are dealt at random to shards that fit a task. A shard's graph
starts from neighbours along random projections and improves by Spark joins: each
node gathers its neighbours and the nodes it is a neighbour of, which are then
candidates for each other. A query searches the graph of every shard greedily,
and the shards' best are merged. Nearness is the inner product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.anchors import grouped_by
from tapewright.llm.common import cut, partitions

NEIGHBOURS = 20
ROUNDS = 4
#: Candidates that a node passes on to each of its neighbours in a round.
OFFERS = 5
#: Vectors of a shard, held by one task.
SHARD_ROWS = 16_384
#: Queries that search a shard in one task.
BLOCK_QUERIES = 1024
#: Best nodes that a search holds; it ends when none is left to expand.
BEAM = 200
ENTRIES = 64
STEP = 8


def usable(vector: Column) -> Column:
    """Vectors that are not null, not zero and hold finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def packed(vector: Column):
    """Vectors as bytes of eight-bit integers for the joins, on one scale."""

    @F.pandas_udf("binary")
    def go(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.clip(np.rint(np.asarray(x, float) / max(np.abs(x).max(), 1e-300) * 127), -127, 127).astype(np.int8).tobytes() + np.float32(np.abs(x).max()).tobytes())

    return go(vector)


def unpacked(rows: list[bytes]) -> np.ndarray:
    body = np.frombuffer(b"".join(r[:-4] for r in rows), np.int8).reshape(len(rows), -1).astype(np.float32)
    return body * (np.frombuffer(b"".join(r[-4:] for r in rows), np.float32) / np.float32(127))[:, None]


def offers(limit: int):
    """Members of each node's neighbourhood, sorted by node -> for each member, the
    best others that beat its worst neighbour. Only pairs with a new member count."""

    def go(batches):
        for t in grouped_by(batches, "w"):
            w, v, worst, fresh = (t.column(c).to_numpy(zero_copy_only=False) for c in ("w", "v", "worst", "fresh"))
            vectors = t.column("q").to_pylist()
            edges = np.flatnonzero(np.r_[True, w[1:] != w[:-1], True])
            out_v, out_x, out_s = [], [], []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if not fresh[lo:hi].any():
                    continue
                x = unpacked(vectors[lo:hi])
                s = x @ x.T
                s[~(fresh[lo:hi][:, None] | fresh[lo:hi][None, :])] = -np.inf
                np.fill_diagonal(s, -np.inf)
                k = min(limit, hi - lo - 1)
                if k < 1:
                    continue
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                score = np.take_along_axis(s, best, 1)
                ok = score > worst[lo:hi][:, None]
                rows = np.broadcast_to(np.arange(lo, hi)[:, None], best.shape)[ok]
                out_v.append(v[rows]), out_x.append(v[lo + best[ok]]), out_s.append(score[ok])
            if out_v:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_v), pa.int64()), pa.array(np.concatenate(out_x), pa.int64()), pa.array(np.concatenate(out_s).astype(np.float32), pa.float32())], ["v", "x", "s"])

    return go


def projected(vector: Column, t: int) -> Column:
    """The product with the t-th pseudorandom vector."""
    weighted = F.transform(vector, lambda x, i: x * (F.pmod(F.xxhash64(i, F.lit(t)), F.lit(2001)) - 1000))
    return F.aggregate(weighted, F.lit(0.0), lambda a, b: a + b)


def neighbour_graph(nodes: DataFrame, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """(shard, node, vector) -> (u, v, s): about the nearest neighbours of each node in its shard."""
    spark = nodes.sparkSession
    n = partitions(spark)
    small = cut(nodes.select("shard", "node", packed(F.col("vector")).alias("q"), *[projected(F.col("vector"), t).alias(f"p{t}") for t in range(3)]), "nn-nodes")
    start = None
    span = -(-neighbours // 6)
    for t in range(3):
        along = Window.partitionBy("shard").orderBy(f"p{t}", "node")
        near = F.filter(F.array(*[f("node", d).over(along) for d in range(1, span + 1) for f in (F.lag, F.lead)]), lambda x: x.isNotNull())
        one = small.select(F.col("node").alias("u"), near.alias("near")).select("u", F.explode("near").alias("v"))
        start = one if start is None else start.union(one)
    graph = cut(start.distinct().withColumns({"s": F.lit(-3.4e38).cast("float"), "fresh": F.lit(True)}), "nn-graph")
    vectors = small.select(F.col("node").alias("v"), "q")
    for _ in range(rounds):
        back = graph.select(F.col("v").alias("w"), F.col("u").alias("v"), "s", "fresh")
        back = back.withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("fresh"), F.desc("s"), "v"))).where(F.col("r") <= neighbours).drop("r")
        itself = small.select(F.col("node").alias("w"), F.col("node").alias("v"), F.lit(0.0).cast("float").alias("s"), F.lit(False).alias("fresh"))
        around = graph.select(F.col("u").alias("w"), "v", "s", "fresh").union(back).union(itself).groupBy("w", "v").agg(F.max("fresh").alias("fresh"))
        worst = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= neighbours, F.min("s")).otherwise(F.lit(-3.4e38)).cast("float").alias("worst"))
        known = vectors.join(worst.withColumnRenamed("u", "v"), "v", "left").withColumn("worst", F.coalesce("worst", F.lit(-3.4e38).cast("float")))
        met = around.join(known, "v").select("w", "v", "worst", "fresh", "q").repartition(n, "w").sortWithinPartitions("w")
        found = met.mapInArrow(offers(OFFERS), "v long, x long, s float").select(F.col("v").alias("u"), F.col("x").alias("v"), "s", F.lit(True).alias("fresh"))
        both = graph.withColumn("fresh", F.lit(False)).union(found).groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
        best = Window.partitionBy("u").orderBy(F.desc("s"), "v")
        graph = cut(both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= neighbours).drop("r"), "nn-graph")
    return graph


def beam_search(vectors: np.ndarray, links: list[np.ndarray], query: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search from the entries: the nodes it holds at the end and their scores."""
    seen = np.zeros(len(vectors), bool)
    held = np.unique(entries)
    seen[held] = True
    score, done = vectors[held] @ query, np.zeros(len(held), bool)
    while True:
        todo = np.flatnonzero(~done)
        if not len(todo):
            return held, score
        if len(todo) > STEP:
            todo = todo[np.argpartition(-score[todo], STEP - 1)[:STEP]]
        done[todo] = True
        near = np.unique(np.concatenate([links[i] for i in held[todo]]))
        near = near[~seen[near]]
        if not len(near):
            continue
        seen[near] = True
        held, score, done = np.r_[held, near], np.r_[score, vectors[near] @ query], np.r_[done, np.zeros(len(near), bool)]
        if len(held) > beam:
            top = np.argpartition(-score, beam - 1)[:beam]
            held, score, done = held[top], score[top], done[top]


def search_shard(k: int, beam: int):
    """One shard's nodes and a block of queries -> each query's best nodes."""

    def go(nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "node", "score"]
        if not len(nodes) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in zip(columns, ("int64", "int64", "float64"), strict=True)})
        nodes = nodes.sort_values("node").reset_index(drop=True)
        ids = nodes["node"].to_numpy()
        vectors = np.stack(nodes["vector"]).astype(float)
        links: list[list[int]] = [[] for _ in ids]
        for u, near in enumerate(nodes["near"]):
            for v in np.searchsorted(ids, np.asarray(near if near is not None else [], np.int64)):
                links[u].append(int(v))
                links[int(v)].append(u)
        graph = [np.unique(np.array(x, np.int64)) for x in links]
        entries = np.random.default_rng(11).permutation(len(ids))[: beam if len(ids) <= beam else ENTRIES]
        out = []
        for q in queries.itertuples():
            at = np.searchsorted(ids, q.node)
            own = [at] if at < len(ids) and ids[at] == q.node else []
            held, score = beam_search(vectors, graph, np.asarray(q.vector, float), np.r_[entries, own].astype(np.int64), beam)
            order = np.lexsort((ids[held], -score))[:k]
            out.append(pd.DataFrame({"query_id": q.query_id, "node": ids[held[order]], "score": score[order]}))
        return pd.concat(out)[columns]

    return go


def nearest(table: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest rows of each query row: query_id, rank, vec_id, score.

    queries: which rows of ``table`` are queries (a condition on its columns).

    Equal vectors are one node of the graph, of which the k+1 smallest ids can be
    results. Cases: rows whose vector is null, empty, zero or not finite, or whose
    id is null, take no part; repeated rows count once; a query with fewer other
    rows gets them all, as no shard of up to BEAM nodes is left unseen; ties go to
    the smaller id; an empty table gives an empty result; vectors of another length
    than the most common one take no part; a query id with several vectors asks
    with any one of them.
    """
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double")).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = cut(rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).dropDuplicates(["vec_id", "vector"]), "vectors")
    # an inner product needs one length: the most common takes part, the longer of equal ones
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    rows = rows.where(F.size("vector") == (lengths["length"] if lengths else 0))
    nodes = rows.groupBy("vector").agg(F.min("vec_id").alias("node"))
    total = rows.count()
    shards = max(1, -(-total // shard_rows))
    nodes = cut(nodes.select(F.pmod(F.xxhash64("node"), F.lit(shards)).alias("shard"), "node", "vector"), "nodes")
    graph = neighbour_graph(nodes)
    near = graph.groupBy("u").agg(F.collect_list("v").alias("near")).withColumnRenamed("u", "node")
    named = cut(rows.join(nodes.select("node", "vector"), "vector").select("vec_id", "node", "asks", "vector"), "members")
    asked = named.where("asks").select(F.col("vec_id").alias("query_id"), "node", "vector").dropDuplicates(["query_id", "node"])
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    sides = nodes.join(near, "node", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = sides.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(search_shard(k + 1, beam), "query_id long, node long, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).drop("place")
    members = named.select("node", "vec_id").distinct()
    members = members.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("place") <= k + 1).drop("place")
    # the held nodes' scores once more, pair by pair in one order of the sums
    asking = named.where("asks").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("__q")).dropDuplicates(["query_id"])
    exact = F.aggregate(F.zip_with("__q", "vector", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    found = found.drop("score").join(nodes.select("node", "vector"), "node").join(asking, "query_id").select("query_id", "node", exact.alias("score"))
    out = found.join(members, "node").where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return out.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
