"""Approximate nearest neighbours over graphs built by NN-descent, for largest inner products.

Vectors are rows of a table (id, coordinates). Equal vectors are one node, so groups of copies don't fill each other's
neighbour lists. Nodes are dealt by a hash of their ids into blocks that a task can hold, as few as that allows, and each
block gets a graph of its own: every node starts with neighbours at random, and in each round nodes meet the neighbours of
their neighbours (`descent`). All blocks are built side by side, and what is shuffled is each vector once.

To search largest inner products in a graph of nearest points, vectors get one more coordinate that brings all of them
to the same length; the order of inner products with a query is then the order of distances to it. The coordinate is
never stored: distances are made in double precision from vectors in 32 bits, so short vectors keep theirs apart.

Tight groups can be islands of a graph. One node of each island takes part in a graph of such nodes, and so on until
all hang together, and these long links join the graph.

Every query searches every block greedily, many queries at once: each keeps the best nodes that it has met, and in each
round the best of them not yet opened are. A query starts at its own node, in the block that has it, and at nodes drawn
from all, from the islands' and from the longest. The best of the blocks are the result: as a block holds only its part of
the nearest, beams are narrower where there are more blocks. Scores are computed again in double precision from the
original vectors before ranks are given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm import descent
from tickloom.llm.bytetext import give_back
from tickloom.llm.descent import DEGREE
from tickloom.llm.scratch import drop, let_go, settle

#: Nodes that a query keeps in a table of one block, and opens in a round, and entry points of a block: at least so many,
#: and more with the root of the number of the block's nodes.
BEAM, OPENED, ENTRIES = 320, 32, 512
GROWTH = 2.5
#: A beam for a block that holds this share of the nearest is as wide as the share to this power.
SHARED = 0.4
#: Nodes of a block and bytes of its vectors in 32 bits, at most; blocks of FEWEST are made to give all tasks work.
BLOCK, BLOCK_BYTES, FEWEST = 1 << 15, 16 << 20, 1 << 13
#: Queries that are carried together, and that a task searches for in a block, and that are searched for in one job.
TOGETHER, ASKED, AT_ONCE = 256, 1 << 15, 1 << 17


def _element(df: DataFrame, col: str) -> str:
    """float where the coordinates are, else double."""
    return "float" if df.schema[col].dataType.elementType.simpleString() == "float" else "double"


def usable(vectors: DataFrame, id_col: str, vector_col: str, element: str = "double") -> DataFrame:
    """(id, vector): rows that take part. Null and zero vectors, and those with null or non-finite components, don't."""
    # Null and non-finite components differ from themselves less themselves; -0 and 0 are one number.
    ok = F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(x - x == 0, F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast(element)).alias("v"))
    return rows.where(ok).select("id", F.transform("v", lambda x: x + F.lit(0.0).cast(element)).alias("vector"))


def nodes(rows: DataFrame) -> DataFrame:
    """(node, vector, copies) of rows (id, vector): node is the smallest id of those with an equal vector."""
    found = settle(rows.groupBy("vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")), "nodes")
    # Rows of one id with several vectors: one of these is its node's.
    if found.select("node").distinct().count() == found.count():
        return found
    one = settle(found.groupBy("node").agg(F.min("vector").alias("vector"), F.max("copies").alias("copies")), "nodes")
    drop(found)
    return one


def _blocks(n: int, dim: int, partitions: int) -> int:
    return max(-(-n // max(2 * DEGREE, min(BLOCK, BLOCK_BYTES // (4 * dim)))), min(partitions, n // FEWEST), 1)


def _labels(spark: SparkSession, blocks: int) -> list[int]:
    """Numbers of blocks that a hash exchange deals to as many partitions, one to each."""
    some = spark.range(64 * blocks).select(F.col("id").cast("int").alias("label"))
    one = some.groupBy(F.pmod(F.hash("label"), F.lit(blocks)).alias("p")).agg(F.min("label").alias("label")).collect()
    got = [r["label"] for r in one]
    return sorted(got + [-1 - k for k in range(blocks - len(got))])


def _by_block(packed: DataFrame, blocks: int, seed: int, told, schema: str) -> DataFrame:
    """told(block, nodes in order, their coordinates as bytes) of every block of packed (node, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, xs = None, [], []

        def block() -> pa.RecordBatch:
            node, x = np.concatenate(ids), b"".join(xs)
            x = np.frombuffer(x, np.uint8).reshape(len(node), -1)
            order = np.argsort(node)
            return told(now, node[order], x[order])

        for b in batches:
            of = np.asarray(b.column(0))
            cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))[: len(of)]
            for a, z in zip(cuts, np.append(cuts[1:], len(of)), strict=True):
                if now is not None and of[a] != now:
                    yield block()
                    ids, xs = [], []
                now = int(of[a])
                ids.append(np.asarray(b.column(1))[a:z])
                xs += [v.as_buffer().to_pybytes() for v in b.column(2).slice(a, z - a)]
        if ids:
            yield block()
        del ids, xs
        give_back()

    label = _labels(packed.sparkSession, blocks)
    block = F.array(*map(F.lit, label))[F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(blocks)).cast("int")].alias("block")
    return packed.select(block, "node", "x").repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(run, schema)


def build_graph(packed: DataFrame, dim: int, seed: int = 3) -> DataFrame:
    """(node, near, score): the neighbour lists of nodes (node, x: coordinates in 32 bits, no vector longer than 1) in their blocks.

    Lists only get better, so the rounds end.
    """

    def told(block: int, node: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        ids, score = descent.descend(x.view(np.float32), seed)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(node, ids.shape[1])), pa.array(node[ids.ravel()]), pa.array(score.ravel())], names=["node", "near", "score"])

    blocks = _blocks(packed.count(), dim, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return settle(_by_block(packed, blocks, seed, told, "node bigint, near bigint, score float"), "graph")


def _graphs(points: DataFrame, kind: type, longest: float, blocks: int, entries: int, seed: int) -> DataFrame:
    """(block, node, x, around, entry) of each block: its nodes, original coordinates, neighbours and entry points."""

    def told(block: int, node: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        x = x.view(kind)
        scaled = (x / longest).astype(np.float32)
        around, heads = descent.graph(scaled, seed)
        rng = np.random.default_rng(seed)
        # Entry points: a bounded number of nodes, drawn from all and from the islands', and the longest, which have the
        # largest inner products with many.
        far = np.argsort(-(scaled.astype(np.float64) ** 2).sum(1), kind="stable")[:entries]
        entry = np.unique(np.concatenate([rng.permutation(len(node))[:entries], rng.permutation(heads)[:entries], far]))
        blobs = [node.astype(np.int64), x, around.astype(np.int32), entry.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in blobs)], names=["block", "node", "x", "around", "entry"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten(), kind).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["node", "x"])

    packed = points.select("node", "vector").mapInArrow(run, "node bigint, x binary")
    return _by_block(packed, blocks, seed, told, "block int, node binary, x binary, around binary, entry binary")


def _best(node: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest scores of each row, ties to smaller nodes; what is no node scores minus infinity."""
    order = np.argsort(node, axis=1, kind="stable")
    order = np.take_along_axis(order, np.argsort(-np.take_along_axis(score, order, 1), axis=1, kind="stable"), 1)[:, :most]
    return np.take_along_axis(node, order, 1), np.take_along_axis(score, order, 1)


def _search_blocks(graphs: DataFrame, chunks: DataFrame, slices: list[int], blocks: int, partitions: int, kind: type, width: int, longest: float, beam: int, opened: int, k: int) -> DataFrame:
    """(query, node, score): the k + 1 best nodes that queries of these slices find in all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = x = scaled = around = entry = None
        for b in batches:
            for i, chunk in enumerate(b.column(2).to_pylist()):
                if chunk < 0:
                    node, x, around, entry = (np.frombuffer(b.column(3 + j)[i].as_buffer(), t) for j, t in enumerate((np.int64, kind, np.int32, np.int32)))
                    x, around = x.reshape(len(node), width), around.reshape(len(node), -1)
                    scaled = (x / longest).astype(np.float32)
                    continue
                query, home = np.asarray(b.column(7)[i].values), np.asarray(b.column(9)[i].values)
                q = np.asarray(b.column(8)[i].values.flatten(), np.float64).reshape(len(query), width)
                at = np.minimum(np.searchsorted(node, home), len(node) - 1)
                at = np.where(node[at] == home, at, -1)
                found, _ = descent.search(scaled, around, entry, q.astype(np.float32), at, beam, opened, k + 8)
                score = np.empty(found.shape)
                for a in range(0, len(q), 64):  # products summed one after another, in double precision
                    score[a : a + 64] = np.cumsum(x[found[a : a + 64]].astype(np.float64) * q[a : a + 64, None, :], axis=2)[:, :, -1]
                score[found < 0] = -np.inf
                ids, score = _best(np.where(found < 0, np.iinfo(np.int64).max, node[found]), score, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), b.column(0).slice(i, 1), *(pa.array([v.tobytes()], pa.binary()) for v in (query, ids, score))], names=["chunk", "block", "query", "node", "score"])
        del node, x, scaled, around, entry
        give_back()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, query, ids, score = None, None, None, None

        def rows() -> pa.RecordBatch:
            there = score > -np.inf
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(query, there.sum(1))), pa.array(ids[there]), pa.array(score[there])], names=["query", "node", "score"])

        for b in batches:
            for i, chunk in enumerate(b.column(0).to_pylist()):
                own, n, s = (np.frombuffer(b.column(2 + j)[i].as_buffer(), t) for j, t in enumerate((np.int64, np.int64, np.float64)))
                n, s = n.reshape(len(own), -1), s.reshape(len(own), -1)
                if chunk != now:
                    if now is not None:
                        yield rows()
                    now, query, ids, score = chunk, own, n, s
                else:
                    ids, score = _best(np.concatenate([ids, n], 1), np.concatenate([score, s], 1), k + 1)
        if now is not None:
            yield rows()

    vectors = chunks.schema["q"].dataType.simpleString()
    left = graphs.select("block", F.explode(F.array(*map(F.lit, slices))).alias("slice"), F.lit(-1).alias("chunk"), "node", "x", "around", "entry", *(F.lit(None).cast(t).alias(c) for c, t in (("query", "array<bigint>"), ("q", vectors), ("home", "array<bigint>"))))
    asked = chunks.where(F.col("slice").isin(slices)).select(F.explode(F.array(*map(F.lit, _labels(graphs.sparkSession, blocks)))).alias("block"), "slice", "chunk", *(F.lit(None).cast("binary").alias(c) for c in ("node", "x", "around", "entry")), "query", "q", "home")
    met = left.unionByName(asked).repartition(blocks * len(slices), "block", "slice").sortWithinPartitions("block", "slice", "chunk")
    found = met.mapInArrow(run, "chunk int, block int, query binary, node binary, score binary")
    return found.repartition(partitions, "chunk").sortWithinPartitions("chunk", "block").mapInArrow(merged, "query bigint, node bigint, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", beam: int | None = None, opened: int | None = None, seed: int = 3) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest rows other than its own, by inner product.

    queries: rows of the same columns. Of a group of equal vectors the smallest ids come first; equal scores are ordered
    by id. A query with an unusable vector gives no rows; repeated ids count once. beam, opened: nodes that a query keeps
    of a block, and opens in a round; by default they grow with the block.
    """
    spark = vectors.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    element, told = _element(vectors, vector_col), _element(queries, vector_col)
    rows = usable(vectors, id_col, vector_col, element)
    points = nodes(rows)
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    stats = points.agg(F.max(F.size("vector")).alias("d"), F.min(F.size("vector")).alias("e"), F.max(F.aggregate(double("vector"), F.lit(0.0), lambda a, x: a + x * x)).alias("s"), F.count(F.lit(1)).alias("n"), F.max("copies").alias("c")).first()
    if not stats["n"]:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id"), F.lit(0.0).alias("score")).where(F.lit(False))
    if stats["d"] != stats["e"]:
        raise ValueError("vectors differ in length")
    width, longest, kind = stats["d"], float(stats["s"]) ** 0.5, np.float32 if element == "float" else np.float64
    blocks = _blocks(stats["n"], width, partitions)
    share = -(-k // blocks) / k
    beam = beam or int(max(BEAM, GROWTH * (stats["n"] / blocks) ** 0.5) * share**SHARED)
    beam = max(beam, k + 8)
    opened = opened or max(OPENED, beam // 5)
    graphs = settle(_graphs(points, kind, longest, blocks, max(ENTRIES, 2 * beam), seed), "graphs")
    let_go(spark)

    # A query whose vector is in the table starts at its own node too; nodes are told by hashes here, as any node may be a start.
    named = lambda v: F.xxhash64(double(v)).alias("h")
    asked = usable(queries, id_col, vector_col, told).select(F.col("id").alias("query"), F.col("vector").alias("q")).dropDuplicates(["query"])
    asked = settle(asked.select("query", "q", named("q")), "asked")
    homes = points.select(named("vector"), "node").groupBy("h").agg(F.min("node").alias("node"))
    homes = settle(asked.select("query", "h").join(homes, "h", "left").select("query", F.coalesce("node", F.lit(-(1 << 63))).alias("home")), "homes")
    n = homes.count()
    chunk = F.pmod(F.xxhash64("query", F.lit(seed)), F.lit(-(-n // TOGETHER) or 1)).cast("int").alias("chunk")
    slices = max(min(-(-n // TOGETHER), -(-partitions // blocks)), -(-n // ASKED), 1)
    packed = asked.join(homes, "query").groupBy(chunk).agg(F.collect_list(F.struct("query", "q", "home")).alias("l"))
    chunks = settle(packed.select("chunk", (F.col("chunk") % slices).alias("slice"), F.col("l.query").alias("query"), F.col("l.q").alias("q"), F.col("l.home").alias("home")), "chunks")
    found = None
    step = max(1, slices * AT_ONCE // max(n, 1))
    for a in range(0, slices, step):
        part = settle(_search_blocks(graphs, chunks, list(range(a, min(slices, a + step))), blocks, partitions, kind, width, longest, beam, opened, k), "found")
        found = part if found is None else found.unionByName(part)
        let_go(spark)
    drop(graphs)

    # Of equal vectors no more than k + 1 rows can be among the nearest, the smallest ids (one may be the query's own).
    members = points.select("node", F.col("node").alias("id"))
    if stats["c"] > 1:
        w = Window.partitionBy("node").orderBy("id")
        copies = rows.join(points.where("copies > 1").select("node", "vector"), "vector").select("node", "id").distinct()
        copies = copies.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).select("node", "id")
        members = points.where("copies = 1").select("node", F.col("node").alias("id")).unionByName(copies)
    near = found.join(members, "node").where("id <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "id", "score")
