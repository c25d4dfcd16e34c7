import hashlib
from collections import defaultdict

import pytest

from cashlens.llm import mixing
from tests_llm_util import SMALL, documents, words


def targets(sizes: dict, weights=(3, 1, 2), share=1.5, epochs=2):
    """The contract's own words: share by weight, stop at the cap, reshare the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    rest, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > epochs * sizes[s]]
        if not full:
            out |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            out[s] = epochs * sizes[s]
            rest -= out[s]
            open_.remove(s)
    return out


def check(rows, found):
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
        largest[source] = max(largest[source], len(words(text)))
    want = targets(sizes)
    taken = defaultdict(int)
    key = lambda i: (hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:15], i)
    by_source = defaultdict(list)
    for r in found:
        assert r["size"] * r.repeats == r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
        if r["size"]:
            by_source[r.source].append((key(r.doc_id), r.repeats))
    for source in sizes:
        assert abs(taken[source] - want[source]) <= largest[source] / 2 + 1e-6
        repeats = [n for _, n in sorted(by_source[source])]
        assert repeats == sorted(repeats, reverse=True)  # the next epoch takes the first documents in key order
    assert len(found) == len(rows)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_IN_BUCKET", 3)
    rows = [(i, "w " * (i % 7), f"s{i % 3}") for i in range(60)]
    rows += [(60, None, "s0"), (61, "", None), (62, "a\x0bb c d", None), (63, "one", ""), (64, "x " * 20_000, "big"), (5, "w", "s1"), (5, "w", "s1")]
    check(rows, mixing.mix(documents(spark, rows)).collect())


def test_whole_table_twice(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = mixing.mix(docs).collect()
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], found)
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_wordless_and_empty(spark):
    found = mixing.mix(documents(spark, [(1, None), (2, " ")])).collect()
    assert {(r.target, r.taken) for r in found} == {(0.0, 0)}
    assert mixing.mix(documents(spark, [(1, "a")]).limit(0)).count() == 0


def test_draw(spark):
    docs = documents(spark, [(i, "w " * 5, "abc"[i % 3]) for i in range(30)] + [(90, None, "a")])
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns
    times = {r.doc_id: r["count"] for r in drawn.groupBy("doc_id").count().collect()}
    assert times == {r.doc_id: r.repeats for r in mixing.mix(docs).filter("repeats > 0").collect()}
