"""The pipeline's stages on a small corpus: each decision takes effect, and clean documents stay."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tickloom.llm import queries


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf).cache()
        seen[name] = (before, after)
        if name != "sharding":
            assert after.columns == columns, name
        before = after
    a, b = seen["quality classifier"]
    assert b.join(a, "doc_id", "left_anti").count() == 0 and b.count() < a.count()
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").join(a, "doc_id")
    assert good.join(b, "doc_id", "left_semi").count() >= 0.97 * good.count()
    a, b = seen["n-gram Jaccard join"]
    assert a.select("text").distinct().count() >= b.count() == b.select("doc_id").distinct().count()
    assert b.groupBy("text").count().where("count > 1").count() == 0
    a, b = seen["benchmark decontamination"]
    items = [r["text"].lower() for r in queries.table(spark, sf, "benchmark").collect()]
    held = {r["doc_id"] for r in a.collect() if any(i in r["text"].lower() for i in items)}
    assert not held & {r["doc_id"] for r in b.collect()} and a.count() - b.count() <= len(held) + 3
    a, b = seen["mixing sources to target weights"]
    assert b.join(a, "doc_id", "left_anti").count() == 0 and b.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    a, b = seen["sharding"]
    assert a.count() == b.count() and b.groupBy("text").agg(F.countDistinct("shard").alias("k")).where("k > 1").count() == 0


CLASHING = ("_id", "_of", "_row", "id", "size", "score", "class", "key", "shard", "n", "text_hash")
SYLLABLES = ["an", "the", "re", "ou", "ti", "on", "sh", "ble", "wh", "er"]


def prose(rnd, n):
    return " ".join("".join(rnd.choices(SYLLABLES, k=rnd.randint(1, 3))) for _ in range(n))


def odd_rows(rnd):
    """(doc_id, text, source) of plain rows, and of those that each stage has a rule for."""
    rows = [(k, prose(rnd, rnd.randint(8, 120)), rnd.choice(["a", "b", None])) for k in range(80)]
    odd = [(100, None, "a"), (101, "", None), (102, " \n\t", "b"), (103, prose(rnd, 20000), "b"), (None, None, None), (None, prose(rnd, 30), "a"), (None, rows[4][1], "a")]
    return rows + odd + [(104, rows[5][1], "b"), rows[6], rows[6], rows[6], (100, None, "a")]


def written(spark, folder, rows, labels=(), items=()):
    docs = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"{folder}"


def test_stages_on_odd_rows(spark, tmp_path):
    rnd = random.Random(31)
    rows = odd_rows(rnd)
    item = prose(rnd, 40)
    rows.append((105, f"{prose(rnd, 30)} {item} {prose(rnd, 30)}", "a"))
    sf = written(spark, tmp_path, rows, items=[(1, item), (2, None), (3, " ")])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored, alone, clean, mix, shards = [stage for _, stage in corpus_pipeline.STAGES]
    key = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    plain = sorted([r[:2] for r in rows], key=str)

    a = scored(spark, docs, sf)
    assert a.columns == docs.columns and key(a) == plain  # nothing to learn from

    b = alone(spark, a, sf)
    assert b.columns == docs.columns
    kept = key(b)
    copies = {(None, rows[4][1]), (104, rows[5][1])}
    assert kept == sorted(set(plain) - copies, key=str)

    c = clean(spark, a, sf)
    assert c.columns == docs.columns and key(c) == [r for r in plain if r[0] != 105]

    d = mix(spark, a, sf)
    assert d.columns == docs.columns and set(d.columns) > set(CLASHING)
    taken = [tuple(r) for r in d.collect()]
    there = [tuple(r) for r in docs.collect()]
    assert set(taken) <= set(there) and all(taken.count(r) <= 2 * there.count(r) for r in set(taken))

    e = shards(spark, a, sf).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in e), key=str) == plain
    slots, of = {}, {}
    for r in e:
        slots.setdefault(r["shard"], []).append(r["slot"])
        of.setdefault(r["text"], set()).add(r["shard"])
        assert r["shard_of_docs"] == (None if r["doc_id"] is None else f"shard{r['doc_id']}")
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_whole_run_of_next_to_nothing(spark, tmp_path, rows):
    out = corpus_pipeline.run(spark, written(spark, tmp_path, rows))
    assert out.count() <= 2 * len(rows) and {"doc_id", "shard", "slot", "shard_of_docs"} <= set(out.columns)
