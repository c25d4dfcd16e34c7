import hashlib
import random

import numpy as np
import pytest

from cashlens.llm import suffixes
from tests_llm_util import SMALL, documents


def brute(rows, length=50):
    last = float("inf")
    texts = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, text in texts:
        for p in range(len(text) - length + 1):
            s = text[p : p + length]
            first[s] = min(first.get(s, last), i)
    out = []
    for (i, text), (raw, _) in zip(texts, rows):
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if first[text[p : p + length]] < i:
                gone[p : p + length] = b"\x01" * length
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out.append((raw, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def got(df):
    rows = df.collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in rows)


@pytest.mark.parametrize("period", suffixes.COVERS)
def test_covers(period):
    cover = set(suffixes.COVERS[period])
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


def test_hashes_are_of_the_bytes():
    data = np.random.default_rng(1).integers(97, 99, 4000).astype(np.uint8)
    at = np.arange(len(data) - 50)
    for length in (16, 30, 50):
        names = {}
        for p, h in zip(at.tolist(), suffixes.hashes(data, at, length, 2)[0].tolist()):
            assert names.setdefault(h, data[p : p + length].tobytes()) == data[p : p + length].tobytes()
        assert len(names) == len({data[p : p + length].tobytes() for p in at.tolist()})


def passages(rng, n, alphabet="abcde ß𝒳"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 130))) for _ in range(n)]


def random_rows(rng, n):
    shared, rows = passages(rng, 12), []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else passages(rng, 1)[0] for _ in range(rng.randint(1, 5))]
        rows.append((rng.choice([i, i, i, i // 2, None]), "".join(parts)))
    return rows


def test_random_texts(spark):
    rows = random_rows(random.Random(1), 160)
    assert got(suffixes.repeated_strings(documents(spark, rows))) == brute(rows)


@pytest.mark.parametrize("length", [36, 42, 64])
def test_other_lengths(spark, length):
    rows = random_rows(random.Random(length), 60)
    assert got(suffixes.repeated_strings(documents(spark, rows), length)) == brute(rows, length)


def test_rounds_and_small_blocks(spark, monkeypatch):
    """Many blocks, and many rounds of buckets: the same result."""
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 700)
    monkeypatch.setattr(suffixes, "ROUND_BYTES", 9000)
    rows = random_rows(random.Random(9), 120)
    assert got(suffixes.repeated_strings(documents(spark, rows))) == brute(rows)


def test_edges(spark):
    rng = random.Random(4)
    run, word = "q" * 333, "".join(chr(rng.randint(97, 122)) for _ in range(50))
    rows = [(1, None), (2, ""), (3, word[:49]), (4, word), (5, word), (5, word + "!"), (6, word[:49] + "?"), (7, run), (8, "q" * 60), (9, "x" + "q" * 49)]
    rows += [(None, word), (None, "p" * 80), (None, "p" * 90), (10, "p" * 49), (4, word), (11, "long " * 60_000), (12, "long " * 50 + "é" * 70)]
    rows += [(100 + k, f"{k} " + word + " tail") for k in range(200)] + [(400 + k, "copied " * 20) for k in range(150)]
    assert got(suffixes.repeated_strings(documents(spark, rows))) == brute(rows)
    assert suffixes.repeated_strings(documents(spark, rows).limit(0)).count() == 0
    assert suffixes.repeated_strings(documents(spark, rows[:3])).count() == 3
    with pytest.raises(ValueError):
        suffixes.cover_of(35)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = got(suffixes.repeated_strings(documents(spark, rows)))
    assert found == brute(rows)
