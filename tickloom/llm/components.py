"""Connected components of links, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import settle


#: Links that one task may hold.
ONE_TASK = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of their component) of the links a-b, without the smallest ones themselves."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, x, y = np.arange(len(nodes)), back[: len(a)], back[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while (deeper := new[new]).tolist() != new.tolist():
            new = deeper
        if (new[label] == label).all():
            break
        label = new[label]
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b: long) but the roots, the smallest node of each component.

    Links are contracted within partitions. What is left goes through one task if it has been counted to be no more than
    ONE_TASK links (16 bytes each); beyond that, large-star and small-star rounds run on the cluster until nothing changes,
    and no task or driver holds a whole component. Both give the same.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for batch in batches:
            a.append(np.asarray(batch.column(0)))
            b.append(np.asarray(batch.column(1)))
            if sum(map(len, a)) > 1 << 20:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b = [x], [y]
        if a:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    stars = settle(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").mapInArrow(contract, "a bigint, b bigint"), "links")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(stars)
    if before[0] <= ONE_TASK:
        whole = settle(stars.coalesce(1).mapInArrow(contract, "a bigint, b bigint"), "stars")
        return whole.select(F.col("a").alias("node"), F.col("b").alias("root"))
    tasks = before[0] // 50_000 + 1
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written first, so that the joins with it can be split where a star's root has most of the rows.
        low = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "low", tasks)
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b").distinct()
        large = settle(large, "large", tasks)
        low = settle(large.groupBy("a").agg(F.min("b").alias("low")), "low", tasks)
        small = large.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        stars = settle(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "stars", tasks)
        after = mark(stars)
        if after == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
