"""The registered queries: names and types of their columns, and as many rows as their contracts say."""

import zlib

import pytest

from tickloom.llm import queries

SF = "/root/testdata/sf0.001"
#: Of each query the columns that its contract names.
COLUMNS = {
    "op1_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_decontamination": {"doc_id": "bigint"},
    "op3_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op4_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op6_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op9_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
}
#: Held-out rows have this remainder of crc32 of the id.
HELD = {"op6_language": (3, 1), "op9_quality": (5, 0)}


def test_every_operator_has_a_query():
    assert set(COLUMNS) == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    got = queries.QUERIES[name](spark, SF)
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = got.collect()
    if name == "op1_nearest":
        ids = [r["vec_id"] for r in queries.table(spark, SF, "embeddings").select("vec_id").collect()]
        asked = [i for i in ids if i % 20 == 0]
        assert len(rows) == len(asked) * min(20, len(ids) - 1) and {r["query_id"] for r in rows} == set(asked)
        return
    source, key = ("pages", "page_id") if name == "op10_warc" else ("documents", "doc_id")
    ids = sorted(r[key] for r in queries.table(spark, SF, source).select(key).collect())
    mine = sorted(r[key] for r in rows)
    if name == "op2_decontamination":
        assert set(mine) <= set(ids)
    else:
        assert mine == ids
    if name in HELD:
        folds, held = HELD[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in rows)
    if name == "op9_quality":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
