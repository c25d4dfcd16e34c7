"""The registered queries: SQL where there is some, one row per input row elsewhere."""

import pytest
from compare import difference, duck

from cashlens.llm import oracle, queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_mix": {"doc_id", "size", "source_size", "target", "taken"},
    "op2_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op3_quality": {"doc_id", "held_out", "score", "predicted"},
    "op4_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op5_personal_data": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op6_main_text": {"page_id", "url", "text", "n_chars"},
    "op7_near_vectors": {"vec_id", "n_links", "component_id", "kept"},
    "op8_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op9_line_dedup": {"doc_id", "text", "n_lines", "n_removed"},
    "op10_pieces": {"doc_id", "ids", "lossless", "n_pieces"},
    "op11_spelling": {"word", "root", "form", "n", "n_near", "form_n"},
    "op12_conversation_repair": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
    "op13_repeated_strings": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
}
TABLES = {"op6_main_text": "pages", "op8_warc": "pages", "op7_near_vectors": "embeddings"}


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_equals_sql(spark, name):
    assert difference(spark, duck(SF), SF, name) is None


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(oracle.oracle_sql()) - {"op12_conversation_repair"}))
def test_whole_tables(spark, name):
    found = queries.REGISTRY[name](spark, SF)
    assert COLUMNS[name] <= set(found.columns)
    assert found.count() == spark.read.parquet(f"{SF}/{TABLES.get(name, 'documents')}.parquet").count()


def test_all_registered():
    assert set(queries.REGISTRY) == set(COLUMNS)
