from collections import defaultdict

from cashlens.llm import sitelines
from tests_llm_util import SMALL, documents

WHITE = " \t\n\r\v\f"


def brute(rows, min_sites):
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if site is not None:
                sites[line.strip(WHITE)].add(site)
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not x.strip(WHITE) or len(sites[x.strip(WHITE)]) < min_sites]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(repr, out))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")
    for min_sites in (2, 5):
        found = sitelines.drop_spread_lines(docs, min_sites).collect()
        assert sorted(repr(tuple(r)) for r in found) == brute([tuple(r) for r in docs.collect()], min_sites)


def test_edges(spark):
    rows = [(k, f"own {k}\n shared \nend", f"s{k}") for k in range(5)] + [(k + 10, "four\nown", f"s{k % 4}") for k in range(9)]
    rows += [(20, None, "s"), (21, "", "s"), (22, "\n\n", "s"), (23, "shared\nshared", None), (24, "shared", "s1"), (24, "shared", "s1")]
    rows += [(25, "z" * 200_000 + "\nshared", "s1"), (None, "shared\nx", "s2")] + [(100 + k, "wide\nx", f"w{k}") for k in range(300)]
    found = sitelines.drop_spread_lines(documents(spark, rows)).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute(rows, 5)
    assert sitelines.drop_spread_lines(documents(spark, rows).limit(0)).count() == 0


def test_pairs_are_distinct_only_near_the_threshold(spark):
    """Sketches are made of all lines; lines far from the threshold never meet their sites again."""
    from cashlens.llm.shelf import Shelf

    rows = [(f"k{k}", f"s{s}") for k, n in enumerate([1, 2, 4, 5, 6, 40, 300]) for s in range(n) for _ in range(3)]
    lines = spark.createDataFrame(rows, "key string, site string")
    shelf = Shelf(spark, "spread")
    found = {r.key: r.n_sites for r in sitelines.spread_lines(lines, shelf, 5).collect()}
    assert set(found) == {"k3", "k4", "k5", "k6"} and found["k3"] == 5 and found["k4"] == 6
    plan = lines.groupBy("key").agg(__import__("pyspark.sql.functions", fromlist=["x"]).hll_sketch_agg("site", 10))
    assert "partial_hll" in plan._jdf.queryExecution().executedPlan().toString()
