"""Sharding by minimax contiguous partition.

Documents with equal texts are one atomic group; groups are laid out by the hash of their text, those larger than
a fair share first. The smallest capacity that lets a greedy pass fill no more than the given number of shards is
found by binary search, and the order is cut there. The search works on sums over ranges of hashes; a range is
split further only where a cut may fall inside it, until every cut lies between two groups, so the driver holds a
bounded number of sums and the result is exact. Only DataFrame expressions run on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.scratch import settle

#: Hash bits that each round of splitting looks at.
BITS = 12


@dataclass
class Atom:
    """Groups whose hash shifted right by `shift` is `value`; low is the first of their hashes."""

    shift: int
    value: int
    low: int
    size: int
    count: int


def _greedy(sums: np.ndarray, single: np.ndarray, capacity: float, shards: int, fluid: bool, base: float = 0.0):
    """(whether `shards` shards of `capacity` hold what follows base, cuts as atom numbers, split atoms met).

    sums[i]: what stands before atom i. fluid: cuts may fall inside atoms that are not single groups.
    """
    cuts, met, n = [], [], len(single)
    for _ in range(shards):
        i = int(np.searchsorted(sums, base + capacity, "right")) - 1
        if i >= n:
            return True, cuts, met
        if not single[i]:
            met.append(i)
        if fluid and not single[i]:
            base = base + capacity
        elif sums[i] <= base:
            return False, cuts, met
        else:
            base = sums[i]
            cuts.append(i)
    return False, cuts, met


def _smallest(sums: np.ndarray, single: np.ndarray, shards: int, low: int, fluid: bool) -> tuple[int, list[int]]:
    high, met = int(sums[-1]), []
    while low < high:
        mid = (low + high) // 2
        ok, _, m = _greedy(sums, single, mid, shards, fluid)
        met += m
        low, high = (low, mid) if ok else (mid + 1, high)
    return low, met


def cut_points(groups: DataFrame, shards: int, skip: list[int], total: int, largest: int) -> tuple[list[int], int]:
    """(hashes at which shards after the first begin, the smallest capacity) for groups (h, size) but those in skip.

    A greedy pass at that capacity may leave the last shard short, so each cut is moved to the boundary nearest to
    an even division wherever the remaining groups still fit.
    """
    if total == 0 or shards == 1:
        return [], total
    rest = groups.where(~F.col("h").isin(skip)) if skip else groups

    def ask(shift: int, wanted: DataFrame) -> list[Atom]:
        v = F.shiftright("h", shift)
        rows = wanted.groupBy(v.alias("v")).agg(F.min("h").alias("low"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        return [Atom(shift, r["v"], r["low"], r["size"], r["n"]) for r in rows]

    atoms = ask(64 - BITS, rest)
    while True:
        atoms.sort(key=lambda a: a.low)
        sums = np.concatenate([[0], np.cumsum([a.size for a in atoms])])
        single = np.array([a.count == 1 for a in atoms])
        low = max(-(-total // shards), largest)
        lower, met = _smallest(sums, single, shards, low, True)
        upper, met2 = _smallest(sums, single, shards, low, False)
        split = {i for i in met + met2 if not single[i]} if lower < upper else set()
        if not split:
            cuts, base = [], 0
            for k in range(shards, 1, -1):
                even = base + (sums[-1] - base) / k
                i = int(np.searchsorted(sums, even))
                near = [j for j in (i - 1, i) if 0 <= j <= len(atoms) and base < sums[j] <= base + upper]
                latest = int(np.searchsorted(sums, base + upper, "right")) - 1
                split |= {j for j in (i - 1, i, latest) if 0 <= j < len(atoms) and not single[j]}
                fits = [j for j in sorted(near, key=lambda j: abs(sums[j] - even)) if _greedy(sums, single, upper, k - 1, False, sums[j])[0] or sums[j] == sums[-1]]
                at = fits[0] if fits else latest
                if at >= len(atoms):
                    break
                cuts.append(at)
                base = sums[at]
            if not split:
                return [atoms[i].low for i in cuts], upper
        kept = [a for i, a in enumerate(atoms) if i not in split]
        for shift in sorted({atoms[i].shift for i in split}):
            values = [atoms[i].value for i in split if atoms[i].shift == shift]
            kept += ask(max(0, shift - BITS), rest.where(F.shiftright("h", shift).isin(values)))
        atoms = kept


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law 'bytes', shard, slot, grown_shard (null).

    Equal texts share a shard; sizes of shards are as near to equal as that allows, and slots number a shard's rows
    from 0 without gaps. A null text has no bytes; all null texts are one group. Equal rows get slots of their own.
    keep: all columns of docs as well; one named like a column above comes as that name and `_of_docs`. A null id is
    a value like others. An empty table gives an empty result.
    """
    made = {"_h": text_hash(F.col(text_col)), "_size": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8, "_crc": F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long")}
    slim = settle(docs.select(F.col(id_col).alias("_id"), *[c.alias(n) for n, c in made.items()]), "slim")
    groups = settle(slim.groupBy(F.col("_h").alias("h")).agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("n")), "groups")
    whole = groups.agg(F.sum("size").alias("s"), F.sum("n").alias("n")).first()
    left, n = whole["s"] or 0, whole["n"] or 0
    top, giants = groups.orderBy(F.desc("size"), "h").limit(shards).collect(), []
    for g in top:
        if shards - len(giants) > 1 and g["size"] * (shards - len(giants)) > left:
            giants.append(g["h"])
            left -= g["size"]
        else:
            break
    largest = top[len(giants)]["size"] if len(giants) < len(top) else 0
    cuts, _ = cut_points(groups, shards - len(giants), giants, left, largest)

    place = reduce(lambda a, c: a + (F.col("_h") >= F.lit(c)).cast("int"), cuts, F.lit(len(giants)))
    for i, h in enumerate(giants):
        place = F.when(F.col("_h") == F.lit(h), F.lit(i)).otherwise(place)
    # Slots: each shard is dealt into parts by a hash of the id, counted, and numbered within.
    parts = 1 << max(0, min(12, math.ceil(math.log2(max(1, n / shards / 2048)))))
    part = F.pmod(F.xxhash64("_id", "_size"), F.lit(parts)).cast("int")
    dealt = {"_shard": place.cast("int"), "_part": part}
    counted = slim.withColumns(dealt).groupBy("_shard", "_part").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At most shards * 4096 rows whatever the input, so it can be broadcast.
    starts = F.broadcast(counted.select(F.col("_shard"), F.col("_part"), before.alias("_before")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.col(f"`{id_col}`").alias("_id"), *[c.alias(n) for n, c in made.items()]) if keep else slim
    order = Window.partitionBy("_shard", "_part").orderBy("_id", "_h", "_size")
    rows = rows.withColumns(dealt).withColumn("_nth", F.row_number().over(order)).join(starts, ["_shard", "_part"], "left")
    own = [F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), (F.col("_before") + F.col("_nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    if keep:
        taken = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"} | {c.lower() for c in docs.columns}
        names = []
        for c in docs.columns:
            name = c
            while name.lower() in {"size", "text_crc32", "law", "shard", "slot", "grown_shard"} or name != c and name.lower() in taken:
                name += "_of_docs"
            names.append(name)
        return rows.select(*[F.col("_row").getField(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], *own)
    return rows.select(F.col("_id").alias("doc_id"), *own)
