from collections import Counter

import corpus_pipeline
import test_exact
import test_mixing
import test_near
from cashlens.llm import mixing, quality

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    """Each stage on what the one before kept, against brute force."""
    frames = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(_stored(stage(spark, frames[-1], SF)))
    docs, good, exact, near, mix, coded = frames
    assert all(f.columns == docs.columns for f in frames[:5])
    rows = lambda f: [(r.doc_id, r.text) for r in f.collect()]
    scored = quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(i for i, _ in rows(good)) == sorted(r.doc_id for r in scored.filter("predicted = 1").collect())
    kept = [e for e in test_exact.expected(rows(good)) if eval(e)[3]]
    assert sorted(i for i, _ in rows(exact)) == sorted(eval(e)[0] for e in kept)
    kept = [eval(e)[0] for e in test_near.brute(rows(exact), 5) if eval(e)[3]]
    assert sorted(i for i, _ in rows(near)) == sorted(kept)
    taken = mixing.mix(near).collect()
    test_mixing.check([(r.doc_id, r.text, r.source) for r in near.collect()], taken)
    assert Counter(i for i, _ in rows(mix)) == {r.doc_id: r.repeats for r in taken if r.repeats}
    assert sorted(r.doc_id for r in coded.collect()) == sorted(i for i, _ in rows(mix))
    assert coded.filter("NOT lossless").count() == 0


def _stored(df):
    from cashlens.llm.shelf import Shelf

    return Shelf(df.sparkSession, "test").put(df)


def test_run_is_the_stages(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "source", "ids", "lossless", "n_pieces"] and found.count() > 0
