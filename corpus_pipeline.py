"""From raw documents to shards of a training corpus.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Documents of low quality go,
one document of each group of near copies stays, documents that hold a benchmark item go, each remaining document is
repeated as the mix of sources asks, and the result is dealt into shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import decontam, jaccard, mixing, quality, queries, sharding
from tickloom.llm.scratch import settle


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns, as often as they are there.

    A null or empty text has the score of the bias, a long one is scored whole, ties at the threshold stay. Ids and
    other columns decide nothing. Without labels that can be learned from all rows stay; an empty table stays empty.
    """
    labels = queries.table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, queries.fold("id", queries.QUALITY_FOLDS) != queries.QUALITY_HELD)
    return quality.keep(docs, model, queries.QUALITY_THRESHOLD)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with the smallest id of their group of near copies; of repeated rows (id and text) one.

    Texts without words (null, empty, blank) are linked with nothing and stay, once for each id. A row with a null id
    belongs to the group of its text and stays only where no row of the group has an id. Other columns are kept and decide nothing,
    an empty table stays empty.
    """
    return jaccard.one_of_each(docs, 5, 75, 100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no benchmark item, with all their columns, as often as they are there.

    Null, empty and blank texts hold none, nor does any text a null or blank item; a long text is looked through whole.
    An id may be null. Without items all rows stay; an empty table stays empty.
    """
    return decontam.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix of sources takes it: 0 to 2 times.

    A null source is a source, last in order. Texts without words count 0, so taking them or not changes no sum.
    Copies of rows with one id and text are dealt out over them evenly; other columns, of any name, are kept. An empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot, by the law `bytes`; equal texts, and all null ones, share a shard.

    Repeated rows get slots of their own. Columns of docs named like a new one come as that name and `_of_docs`. An
    empty table gives an empty one of these columns.
    """
    return sharding.shard(docs, 24, keep=True)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]
#: SQL can't express the learned classifier, nor the iterated rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), "stage")
    return docs
