import zlib

import numpy as np

from cashlens.llm import quality
from tests_llm_util import documents

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(found) == docs.count()
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    tested = [(found[r.doc_id], r.quality) for r in labels.collect() if found[r.doc_id].held_out]
    good = np.array([r.score for r, q in tested if q == 1])
    bad = np.array([r.score for r, q in tested if q == 0])
    assert (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean() > 0.97
    assert np.mean([r.predicted == q for r, q in tested]) > 0.95
    # Only text counts: other ids, languages and sources give the same scores; held-out labels change nothing.
    flipped = labels.withColumn("quality", (labels.quality + quality.held_out(labels.doc_id).cast("int")) % 2)
    other = quality.quality_scores(docs.withColumn("lang", docs.source).withColumn("source", docs.text), flipped)
    assert {r.doc_id: round(r.score, 9) for r in other.collect()} == {i: round(r.score, 9) for i, r in found.items()}


def test_edges(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "a b c"), (4, "x" * 300_000), (4, "x" * 300_000), (None, "a")])
    shape = "doc_id long, quality int, toxic int, id long"
    none = spark.createDataFrame([], shape)
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0, 1), (3, 1, 0, 1), (None, 0, 0, 1), (4, None, 0, 1)], shape)
    assert {r.score for r in quality.quality_scores(docs, one).collect()} == {1.0}
    both = spark.createDataFrame([(1, 0, 0, 1), (3, 1, 0, 1), (3, 1, 0, 1), (4, 1, 0, 1)], shape)
    found = quality.quality_scores(docs, both).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert quality.quality_scores(docs.limit(0), both).count() == 0
    kept = quality.keep_good(docs, one)
    assert kept.count() == 6 and kept.columns == docs.columns


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 9, 40)
    hits = rng.binomial(n, np.linspace(0.1, 0.9, 40))
    x, share = quality.isotonic(np.arange(40.0), n, hits)
    assert (np.diff(share) > 0).all()
    # Max-min formula of isotonic regression.
    fit = [max(min(hits[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert sorted(set(np.round(fit, 12))) == sorted(set(np.round(share, 12)))


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    stats = rng.normal(size=(50, quality.STATISTICS))
    model = quality.Model(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    f = model.features(stats)[:, :-1]
    distance = ((stats[:, None] - stats[None]) ** 2).sum(axis=2)
    assert np.abs(f @ f.T - np.exp(-distance / (2 * quality.WIDTH**2))).max() < 0.3
