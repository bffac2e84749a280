"""Mixing sources to target weights by pivotal dependent rounding.

A document's expected copies are its source's target over its source's words. The whole part is taken as it is;
the fractional parts are rounded in pairs: words move from one document to the other, in a direction drawn so that
expectations stay, until one of the two is whole. Blocks of a source are folded side by side; what each leaves
undecided goes up a reduction tree, so a source's words stay at its target but for the last document of all.
Only DataFrame expressions run, and draws are hashes, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import settle

#: Documents that are folded together, on average; a tree over n of them has log(n) / log(BLOCK) levels.
BLOCK = 32
#: Words are what stands between these (as a Java pattern).
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), cap: float = 2.0, source_col: str = "source", size_col: str = "size") -> DataFrame:
    """Per source: source_size, n_docs (with words), weight, target.

    Sources by code point, null last, weigh `weights` in turn and share `share` times all sizes. A target stops at
    `cap` times its source's size; the excess goes to the others by weight until none is above, that is, targets are
    least(cap * size, level * weight) for the one level that uses the words up. Ranks come from a range
    partitioning, so no task holds all sources.
    """
    per = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"), F.sum((F.col(size_col) > 0).cast("long")).alias("n_docs"))
    per = settle(per, "sources")
    cut = settle(per.repartitionByRange(F.col("source").isNull(), F.col("source")).select("*", F.spark_partition_id().alias("part")), "ranked")
    before, starts = 0, {}
    for r in sorted(cut.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["part"]):
        starts[r["part"]] = before
        before += r["n"]
    if not starts:
        return per.select("source", "source_size", "n_docs", F.lit(0.0).alias("weight"), F.lit(0.0).alias("target"))
    from pyspark.sql import Window

    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    first = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[F.col("part")]
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = settle(cut.withColumn("rank", first + inside).select("source", "source_size", "n_docs", F.get(turn, (F.col("rank") % len(weights)).cast("int")).alias("weight")), "weighed")
    whole = ranked.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    goal, level = share * (whole["s"] or 0), 0.0
    weight_left, taken = float(whole["w"]), 0.0
    while weight_left > 0:
        new = (goal - taken) / weight_left
        if new <= level * (1 + 1e-15):
            break
        level = new
        full = F.lit(level) * F.col("weight") > F.lit(cap) * F.col("source_size")
        r = ranked.agg(F.sum(F.when(full, F.lit(cap) * F.col("source_size")).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        taken, weight_left = float(r["taken"]), float(r["w"])
    target = F.least(F.lit(cap) * F.col("source_size"), F.lit(level) * F.col("weight")) if weight_left > 0 else F.lit(cap) * F.col("source_size")
    return ranked.withColumn("target", target.cast("double"))


def _fold(seed: int) -> Column:
    """Over `items`, an array of structs with size and p: the decided ones with their bit, and the one left over."""
    draw = f"pmod(xxhash64(r.key, e.key, r.size, e.size, {seed}), 1073741824L) / 1073741824D"
    return F.expr(f"""
    aggregate(
      slice(items, 2, size(items)),
      struct(items[0] as r, slice(transform(items, x -> struct(x as item, 0 as bit)), 1, 0) as done),
      (acc, e) -> transform(
        array(struct(acc.r as r, acc.done as done, e as e,
          least((1 - acc.r.p) * acc.r.size, e.p * e.size) as up,
          least(acc.r.p * acc.r.size, (1 - e.p) * e.size) as down)),
        s -> transform(
          array(struct(s.r as r, s.e as e, s.done as done, s.up as up, s.down as down)),
          t -> case
            when {draw.replace('r.', 't.r.').replace('e.', 't.e.')} * (t.up + t.down) < t.down then
              case when (1 - t.r.p) * t.r.size <= t.e.p * t.e.size
                then struct(named_struct('key', t.e.key, 'size', t.e.size, 'p', greatest(0D, t.e.p - t.up / t.e.size), 'base', t.e.base, 'row', t.e.row) as r,
                            concat(t.done, array(struct(t.r as item, 1 as bit))) as done)
                else struct(named_struct('key', t.r.key, 'size', t.r.size, 'p', least(1D, t.r.p + t.up / t.r.size), 'base', t.r.base, 'row', t.r.row) as r,
                            concat(t.done, array(struct(t.e as item, 0 as bit))) as done) end
            else
              case when t.r.p * t.r.size <= (1 - t.e.p) * t.e.size
                then struct(named_struct('key', t.e.key, 'size', t.e.size, 'p', least(1D, t.e.p + t.down / t.e.size), 'base', t.e.base, 'row', t.e.row) as r,
                            concat(t.done, array(struct(t.r as item, 0 as bit))) as done)
                else struct(named_struct('key', t.r.key, 'size', t.r.size, 'p', greatest(0D, t.r.p - t.down / t.r.size), 'base', t.r.base, 'row', t.r.row) as r,
                            concat(t.done, array(struct(t.e as item, 1 as bit))) as done) end
          end)[0])[0])
    """)


def round_copies(docs: DataFrame, seed: int = 11, source_cols: tuple[str, ...] = ("source",)) -> DataFrame:
    """Adds `copies` to rows that have key (long), size (long), base (long), p (0 to 1) and n_docs (rows of the source with p > 0 at most).

    Within each source the sum of size * (base + p) is kept, but for the rounding of one last row to its nearer side:
    words taken miss the target by at most half that row's size. Equal rows are rounded one by one.
    """
    names = docs.columns
    row = F.struct(*[c for c in names if c not in ("key", "size", "p", "base")])
    still = F.col("p").between(1e-12, 1 - 1e-12) & (F.col("size") > 0)
    whole = docs.where(~still).withColumn("copies", F.col("base") + (F.col("p") > 0.5).cast("long"))
    item = F.struct("key", F.col("size").cast("double").alias("size"), "p", "base", row.alias("row"))
    level = docs.where(still).select(*[F.col(c).alias(f"s{i}") for i, c in enumerate(source_cols)], F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCK)).cast("long").alias("blocks"), item.alias("item"))
    group = [f"s{i}" for i in range(len(source_cols))]
    done, depth = [whole], 0
    while True:
        block = F.pmod(F.xxhash64(F.col("item.key"), F.col("item.size"), F.lit(seed + depth)), F.col("blocks"))
        order = F.transform(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.col("item.key"), F.lit(seed + 100 + depth)).alias("h"), F.col("item.key").alias("k"), F.col("item.p").alias("p"), "item"))), lambda x: x["item"])
        folded = level.groupBy(*group, block.alias("block"), "blocks").agg(order.alias("items")).select(*group, "blocks", _fold(seed + depth).alias("f"))
        folded = settle(folded, f"mix{depth}")
        out = folded.select(F.explode("f.done").alias("d")).select("d.item", F.col("d.bit").cast("long").alias("bit"))
        last = folded.where("blocks = 1").select(F.col("f.r").alias("item"), (F.col("f.r.p") > 0.5).cast("long").alias("bit"))
        for part in (out, last):
            done.append(part.select(F.col("item.key").alias("key"), F.col("item.size").cast("long").alias("size"), F.col("item.p").alias("p"), F.col("item.base").alias("base"), "item.row.*", (F.col("item.base") + F.col("bit")).alias("copies")).select(*names, "copies"))
        level = folded.where("blocks > 1").select(*group, F.ceil(F.col("blocks") / BLOCK).cast("long").alias("blocks"), F.col("f.r").alias("item"))
        most = level.agg(F.max("blocks").alias("m")).first()["m"]
        if most is None:
            break
        depth += 1
        if depth > 64 or not math.isfinite(most):
            raise RuntimeError("the reduction tree does not end")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), cap: float = 2.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, size (words), source, source_size, target (its source's), copies, taken (copies * size).

    A null text has no words; rows without words get 0 or more copies of nothing. Rows keep their multiplicity,
    a null id or source is a value like others, other columns are not read. No row gets more than
    ceil(cap) copies. An empty table gives an empty result. Rows that are alike are counted before they are dealt over
    blocks, and each is drawn for by its number among them.
    """
    sized = settle(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *keep), "sizes")
    targets = source_targets(sized, share, weights, cap).select(F.col("source").alias("of"), "source_size", "n_docs", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    rows = rows.withColumn("ratio", ratio).withColumn("base", F.floor("ratio").cast("long")).withColumn("p", F.col("ratio") - F.col("base")).drop("ratio")
    alike = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_alike"))
    rows = alike.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_alike")))).withColumn("key", F.when(F.col("_turn") == 1, F.xxhash64("doc_id")).otherwise(F.xxhash64("doc_id", "_turn"))).drop("_alike", "_turn")
    out = round_copies(rows, seed)
    return out.select("doc_id", *keep, "size", "source", "source_size", "target", F.col("copies"), (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), cap: float = 2.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken, with all its columns.

    Rows with the same id and text are alike to the mix, so their copies are dealt out over them evenly. Columns of any
    name are kept; null ids, texts and sources are values, and an empty table gives an empty one.
    """
    keyed = docs.select(F.col(id_col), F.col(source_col), F.col(text_col), F.xxhash64(text_col).alias("_hash"))
    taken = mix(keyed, share, weights, cap, seed, id_col, text_col, source_col, keep=("_hash",))
    per = settle(taken.groupBy(F.col("doc_id").alias("_id"), "_hash").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")), "copies")
    repeated = per.where("_rows > 1").limit(1).count() > 0
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_own"), F.xxhash64(F.col(f"`{text_col}`")).alias("_of"))
    rows = whole.join(per, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_hash")))
    if repeated:
        from pyspark.sql import Window

        nth = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.monotonically_increasing_id()))
        rows = rows.withColumn("_copies", F.floor(F.col("_copies") / F.col("_rows")) + (nth <= F.col("_copies") % F.col("_rows")).cast("long"))
    times = F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))
    return rows.select("_row", times.alias("_nth")).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
