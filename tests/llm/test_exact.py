import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from cashlens.llm import exact
from tests_llm_util import FOLD, SMALL, documents

ROWS = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "Ä"), (6, "ä"), (7, "a  b"), (8, "x" * 200_000), (9, "X" * 200_000), (7, "a  b"), (None, "n"), (None, "A B"), (10, "n")]


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(FOLD)].append(i)
    out = []
    for i, text in rows:
        body = (text or "").translate(FOLD)
        known = [x for x in groups[body] if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(groups[body]), i == keep, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_edges(spark):
    found = exact.exact_groups(documents(spark, ROWS)).collect()
    assert sorted(repr(tuple(r)) for r in found) == expected(ROWS)


def test_whole_table_and_hash_collisions(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    md5 = F.md5
    monkeypatch.setattr(exact.F, "md5", lambda c: md5(F.substring(c, 1, 1)))
    found = exact.exact_groups(docs).collect()
    assert sorted(repr(tuple(r)) for r in found) == expected(rows)


def test_smallest_stays_and_empty_table(spark):
    docs = documents(spark, [(1, "A"), (2, "a"), (3, "b")])
    assert sorted(r.doc_id for r in exact.drop_exact(docs, keep="min").collect()) == [1, 3]
    assert exact.drop_exact(docs).columns == docs.columns
    assert exact.exact_groups(docs.limit(0)).count() == 0
