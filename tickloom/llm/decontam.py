"""Benchmark decontamination by SimHash of item-sized windows.

A window has as many words as the benchmark item it is held against; a shorter text is one window, the whole text. Windows are fingerprinted with SimHash over
their word shingles, repetitions numbered; a multi-index over blocks of the fingerprint, with the neighbourhood of each block, gives every
item fingerprint within a Hamming radius; what it gives is verified by the exact similarity of weighted shingles
(weights are multiplicities: the sum of the smaller counts over the sum of the larger).

Of all windows of every text, those are fingerprinted that can matter: a window as similar as asked for holds a known
number of shingles of items of its size, and moved right to the first of them it is no less similar, so the windows
that begin at such shingles and hold enough of them are all that is needed. Nothing is lost by this.
Equal windows are looked up once, however many documents hold them. Only DataFrame expressions run.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.joins import bounded, only, without
from tickloom.llm.scratch import settle

BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
#: All fingerprints at most this far apart agree in some block but for BLOCK_RADIUS bits.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1


def words(text: str) -> str:
    """SQL for the lower-cased words between blanks of a text; null and blank texts have none."""
    bare = f"btrim(lower({text}), ' \\t\\n\\u000b\\f\\r')"
    return f"case when length({bare}) > 0 then split({bare}, '[\\\\x20\\\\x09-\\\\x0D]+') else cast(array() as array<string>) end"


def shingle_hashes(text: str, width: int) -> Column:
    """Hashes of all runs of `width` words of a text, in order.

    The words are bound to a variable: as a column they would be put, and split again, wherever they are used.
    """
    parts = ", ".join(f"w[i + {k}]" if k else "w[i]" for k in range(width))
    return F.expr(f"transform(array({words(text)}), w -> case when size(w) >= {width} then transform(sequence(0, size(w) - {width}), i -> xxhash64({parts})) else cast(array() as array<bigint>) end)[0]")


def simhash(shingles: str) -> Column:
    """64 bits: each is set where more of the hashes have it than not."""
    return F.expr(f"""
    aggregate(sequence(0, 63), 0L, (f, b) ->
      f | shiftleft(case when aggregate({shingles}, 0, (s, h) -> s + 2 * cast(shiftright(h, b) & 1L as int) - 1) > 0 then 1L else 0L end, b))""")


def numbered(shingles: str) -> Column:
    """The hashes with every repetition made another one, by its number: the multiset as a set.

    A shingle that fills much of a window would else outvote all others in the fingerprint.
    """
    return F.expr(f"""
    case when size(array_distinct({shingles})) = size({shingles}) then {shingles}
      else transform({shingles}, (h, i) -> case when array_position({shingles}, h) = i + 1 then h else xxhash64(h, size(filter(slice({shingles}, 1, i), x -> x = h))) end) end""")


def blocks_of(fingerprint: str) -> Column:
    return F.expr(f"transform(sequence(0, {BLOCKS - 1}), k -> struct(k as block, cast(shiftright({fingerprint}, k * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}L as int) as value))")


def neighbourhood() -> list[int]:
    """What a block is xored with to get all values within BLOCK_RADIUS bits."""
    return [sum(1 << b for b in bits) for r in range(BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), r)]


def common(a: str, b: str) -> Column:
    """Sum of the smaller counts of the elements that two arrays share."""
    return F.expr(f"aggregate(array_distinct({a}), 0, (s, x) -> s + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))")


def matches(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, start, n_words): per document and item the most similar window.

    start counts words from 0; of equally similar windows the first is given. Items with fewer than `width` words are
    one shingle of all their words; null or blank items match nothing, equal items each match. A document shorter than
    an item is held against it whole, and n_words is then its own number of words. A null text has no windows; a null id is kept, and repeated rows give one row.
    """
    worded = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"), F.expr(f"size({words(f'`{item_text_col}`')})").alias("n_words")).where("n_words > 0")
    bench = settle(worded, "items")
    widths = sorted(r["k"] for r in bench.select(F.least("n_words", F.lit(width)).alias("k")).distinct().collect())
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    found = None
    for k in widths:
        same = bench.where(F.least("n_words", F.lit(width)) == k)
        own = settle(same.select("item_id", "n_words", shingle_hashes("text", k).alias("item_shingles")), "item-shingles")
        # The sizes of the items that hold a shingle.
        spots = own.select("n_words", F.explode("item_shingles").alias("h")).groupBy("h").agg(F.collect_set("n_words").alias("spots"))
        spread = texts.select("doc_id", "text_hash", shingle_hashes("text", k).alias("s"))
        # The texts are not carried along: what is exploded is as wide as a few numbers. (An inner explode would
        # have a filter put under it that makes the shingles twice.)
        hits = spread.select("doc_id", "text_hash", F.size("s").alias("n"), F.posexplode_outer("s").alias("pos", "h")).join(bounded(settle(spots, "spots")), "h")
        hits = hits.select("doc_id", "text_hash", "n", "pos", F.explode("spots").alias("n_words")).withColumn("span", F.col("n_words") - (k - 1)).where(f"n >= span * {threshold!r}D - 1e-9D")
        # A window moved right until its first shingle is one of an item loses nothing that it shares, so windows that
        # begin at such places, and the last one, are all that is needed; and of their shingles enough must be such.
        per = hits.groupBy("doc_id", "text_hash", "n", "n_words", "span").agg(F.sort_array(F.collect_set("pos")).alias("p")).withColumn("need", F.expr(f"cast(ceil((least(n, span) + span) * {threshold / (1 + threshold)!r}D - 1e-9D) as int)")).where("size(p) >= need")
        # A text shorter than the item is one window.
        starts = F.expr("""case when n < span then array(0) else array_distinct(concat(
            transform(filter(sequence(0, size(p) - need), i -> p[i + need - 1] - p[i] < span and p[i] <= n - span), i -> p[i]),
            case when size(filter(p, x -> x >= n - span)) >= need then array(n - span) else cast(array() as array<int>) end)) end""")
        places = settle(per.select("doc_id", "text_hash", "n_words", "span", F.explode(starts).alias("start")).distinct(), "places")
        held = only(docs, places.select(F.col("doc_id").alias("id"), "text_hash"), id_col, text_col)
        held = held.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"), shingle_hashes(f"`{text_col}`", k).alias("s"))
        windows = places.join(held, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
        windows = windows.select("doc_id", "text_hash", "n_words", "start", F.expr("slice(s, start + 1, span)").alias("window")).dropDuplicates(["doc_id", "text_hash", "n_words", "start"])
        windows = settle(windows, "windows")
        distinct = windows.select("n_words", "window").distinct().withColumn("votes", numbered("window")).withColumn("print", simhash("votes")).drop("votes")
        probes = distinct.select("*", F.explode(blocks_of("print")).alias("b")).select("n_words", "window", "print", "b.block", "b.value")
        prints = own.withColumn("votes", numbered("item_shingles")).withColumn("item_print", simhash("votes")).drop("votes").select("*", F.explode(blocks_of("item_print")).alias("b"))
        near = F.explode(F.array(*[F.col("b.value").bitwiseXOR(F.lit(x)) for x in neighbourhood()]))
        index = prints.select("item_id", "n_words", "item_shingles", "item_print", "b.block", near.alias("value"))
        pairs = probes.join(index, ["n_words", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        pairs = pairs.select("n_words", "window", "item_id", "item_shingles").dropDuplicates(["n_words", "window", "item_id"])
        shared = common("item_shingles", "window")
        sure = pairs.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.size("window") + F.size("item_shingles") - F.col("shared"))).where(F.col("similarity") >= threshold)
        sure = settle(sure.select("n_words", "window", "item_id", "similarity"), "matches")
        got = windows.join(sure, ["n_words", "window"]).select("doc_id", "text_hash", "item_id", "similarity", "start", (F.size("window") + (k - 1)).alias("n_words"))
        found = got if found is None else found.unionByName(got)
    if found is None:
        return texts.join(bench, F.lit(False)).select("doc_id", "text_hash", "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), "n_words")
    best = F.max_by(F.struct("similarity", "start", "n_words"), F.struct("similarity", -F.col("start"))).alias("best")
    return found.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "best.similarity", "best.start", "best.n_words")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that match no item."""
    bad = matches(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("id"), "text_hash")
    return without(docs, bad, id_col, text_col)
