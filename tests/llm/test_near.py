import random

import numpy as np

from cashlens.llm import near
from cashlens.llm.components import components
from cashlens.llm.shelf import Shelf
from tests_llm_util import SMALL, documents, shingles, smallest_reachable


def brute(rows, width):
    sets = [(i, shingles(t, width)) for i, t in rows]
    links = [
        (a, b)
        for k, (a, x) in enumerate(sets)
        for b, y in sets[k + 1 :]
        if a is not None and b is not None and x and 100 * len(x & y) >= 80 * len(x | y)
    ]
    found = smallest_reachable([i for i, _ in rows if i is not None], links)
    return sorted(repr((i, len(s), found.get(i) if s else i, (found.get(i) if s else i) == i)) for i, s in sets)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for width in (4, 5):
        found = near.near_components(docs, width)
        assert sorted(repr(tuple(r)) for r in found.collect()) == brute([tuple(r) for r in docs.collect()], width)


def test_edges_and_chains(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    # A chain: each text is near the next only, so leaders alone don't settle it.
    chain = [(100 + k, " ".join(base[k * 3 : k * 3 + 40])) for k in range(7)]
    near_copies = [(200 + k, " ".join([*base[:59], f"z{k}"])) for k in range(30)]
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "a b c d"), (8, "A b c d")]
    rows += [(9, "x y " * 20_000), (10, "x y " * 20_001), (None, "one two"), (11, "ä b c d e"), (12, "Ä b c d e"), *chain, *near_copies]
    found = near.near_components(documents(spark, rows), 4).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute(rows, 4)


def test_rows_that_repeat_an_id_and_a_text(spark, monkeypatch):
    """They are compared once, however many there are."""
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base), " ".join([*base[:59], "z"]), " ".join([*base[:58], "y", "z"])]
    rows = [(k, t) for k, t in enumerate(texts) for _ in range(40)]
    sizes = []
    put = Shelf.put

    def counted(self, df, **how):
        table = put(self, df, **how)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(Shelf, "put", counted)
    found = near.near_components(documents(spark, rows), 4).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(0, 0), (1, 0), (2, 0)} and len(found) == 120
    assert sorted(sizes, reverse=True)[1] <= 3 * near.HASHES


def test_drop_and_empty(spark):
    docs = documents(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (4, None)])
    kept = near.drop_near(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and kept.columns == docs.columns
    assert near.near_components(docs.limit(0)).count() == 0
    # Rows that repeat an id are judged each by its own text.
    twice = near.near_components(documents(spark, [(1, "a b c d e f"), (1, "q"), (2, "a b c d e f"), (2, "a b c d e f")]))
    assert sorted((r.doc_id, r.component_id) for r in twice.collect()) == [(1, 1), (1, 1), (2, 1), (2, 1)]


def test_bounds():
    least = near.least_matches(0.8, 1e-7)
    assert least == sorted(least) and 0 <= least[0] < 16 and least[-1] < 0.8 * near.HASHES
    rng = np.random.default_rng(0)
    same = rng.random((20_000, near.HASHES)) < 0.8
    assert all(same[:, : (k + 1) * near.BATCH].sum(axis=1).min() >= m for k, m in enumerate(least))


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(300)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    want = smallest_reachable({i for p in links if p[0] != p[1] for i in p}, links)
    df = spark.createDataFrame([(b, a) for a, b in links], "a long, b long")
    assert {r.id: r.component for r in components(df, Shelf(spark, "t")).collect()} == want
    assert components(df.limit(0), Shelf(spark, "t")).count() == 0


def test_low_thresholds(spark):
    assert [near.band_rows(s) for s in (0.5, 0.75, 0.8, 0.9)] == [2, 2, 4, 4]
    assert [near.smallest_linking(*x) for x in ((1, 2), (3, 4), (80, 100), (81, 100), (1, 1))] == [1, 3, 4, 5, 1 << 62]
    rows = [(1, "a"), (2, "a b"), (3, "c d e"), (4, "c d e f"), (5, "g h"), (6, "i j k")]
    # Forty pairs with half of the words shared, each word a shingle.
    for k in range(40):
        common = [f"c{k}x{j}" for j in range(20)]
        rows += [(100 + 2 * k, " ".join([*common, *(f"l{k}x{j}" for j in range(10))])), (101 + 2 * k, " ".join([*common, *(f"r{k}x{j}" for j in range(10))]))]
    found = {r.doc_id: r.component_id for r in near.near_components(documents(spark, rows), 1, 1, 2).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6} | {i: i - i % 2 for i in range(100, 180)}
