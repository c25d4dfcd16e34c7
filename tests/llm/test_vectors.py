import numpy as np

from cashlens.llm import vectors
from tests_llm_util import smallest_reachable

SHAPE = "vec_id long, embedding array<float>, label int, id long, vec string, weight long, component_id string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 1, "x") for r in rows], SHAPE)


def brute(rows, threshold=0.93):
    unit = []
    for i, v, label in rows:
        ok = i is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
        x = np.array(v, dtype=np.float32).astype(float) if ok else None
        unit.append(x / np.sqrt(x @ x) if ok else None)
    links, n = [], [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]):
                if unit[a] @ unit[b] >= threshold:
                    links.append((rows[a][0], rows[b][0]))
                    n[a] += 1
                    n[b] += 1
    found = smallest_reachable([r[0] for r in rows if r[0] is not None], links)
    return sorted(repr((r[0], k, found.get(r[0]), found.get(r[0]) == r[0])) for r, k in zip(rows, n))


def test_edges_groups_and_copies(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF", 32)
    monkeypatch.setattr(vectors, "BLOCK", 48)
    rng = np.random.default_rng(4)
    rows = []

    def add(v, label):
        rows.append((len(rows), None if v is None else [None if x is None else float(x) for x in v], label))

    for _ in range(300):
        add(rng.normal(size=16), int(rng.integers(2)))
    for group in range(30):
        centre = rng.normal(size=16)
        for _ in range(4):
            add(centre + 0.25 * rng.normal(size=16), group % 2)
    centre = rng.normal(size=16)
    for _ in range(150):
        add(centre + 0.05 * rng.normal(size=16), 0)  # one large group
    for _ in range(20):
        add(3 * centre, 1)  # copies
        add(2 * centre, None)
    for v in (None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 3, [2.0] * 3, [3e38] * 16, [1e-40] * 16):
        add(v, 0)
    rows.append((None, [1.0] * 3, 0))
    found = vectors.near_vectors(table(spark, rows)).collect()
    expected = [r if r[0] is not None else (None, None, 0) for r in rows]
    got = sorted(repr((r.vec_id, r.n_links, r.component_id, r.kept if r.vec_id is not None else False)) for r in found)
    assert got == [e.replace("None, True", "None, False") for e in brute(expected)]


def test_empty_table(spark):
    assert vectors.near_vectors(table(spark, [(1, [1.0], 1)]).limit(0)).count() == 0
    assert vectors.near_vectors(table(spark, [(1, None, 1)])).collect()[0].kept


def test_ids_of_several_labels(spark):
    """A row links inside its own label, whatever other rows share its id."""
    rows = [(5, [1.0, 0.0], 0), (5, [0.0, 1.0], 1), (6, [0.0, 1.0], 0), (7, [0.0, 2.0], 1), (4, [3.0, 0.1], 0), (4, [1.0, 1.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(table(spark, rows)).collect())
    assert got == [(4, 0, 4), (4, 1, 4), (5, 1, 4), (5, 1, 5), (6, 0, 6), (7, 1, 5)]


def test_deep_trees_project_again(spark, monkeypatch):
    """More levels than projections made at once: a dense label is split until its leaves are small."""
    monkeypatch.setattr(vectors, "LEAF", 12)
    monkeypatch.setattr(vectors, "AT_ONCE", 2)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=24)], 0) for i in range(500)]
    for i in range(60):
        rows.append((1000 + i, [x + 0.2 * float(rng.normal()) for x in rows[i][1]], 0))
    found = sorted(repr(tuple(r)) for r in vectors.near_vectors(table(spark, rows)).collect())
    assert found == brute(rows)
