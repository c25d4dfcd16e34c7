"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.001"
#: Columns with names that operators use inside.
CLASH = ", id long, of string, size long, key string, body string, n long, rep long, bucket long, kept boolean, _stay long, ids string, name string"
CLASHING = (1, "x", 1, "x", "x", 1, 1, 1, True, 1, "x", "x")


def documents(spark, rows: list[tuple]):
    """From (doc_id, text[, source]); the other columns of documents, and columns whose names clash."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, *CLASHING) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long" + CLASH)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    found = words((text or "").translate(FOLD))
    if len(found) < width:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def smallest_reachable(ids, links) -> dict:
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
