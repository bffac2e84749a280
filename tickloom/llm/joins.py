"""Applying decisions to whole rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import settle

#: Rows of two longs that may be broadcast (about 32 MB in memory); with more, both sides are shuffled.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame) -> DataFrame:
    """A settled df of two longs, marked for broadcast if it has been counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def without(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs whose id and text hash are not in keys (id, text_hash); a null id equals a null id."""
    return _kept(docs, keys, id_col, text_col, "left_anti")


def only(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs whose id and text hash are in keys (id, text_hash); a null id equals a null id."""
    return _kept(docs, keys, id_col, text_col, "left_semi")


def _kept(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    named = bounded(settle(keys.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "keys"))
    return docs.join(named, docs[id_col].eqNullSafe(named["_id"]) & (F.xxhash64(docs[text_col]) == named["_hash"]), how)
