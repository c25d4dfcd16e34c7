import random
import re
import zlib
from collections import Counter

from cashlens.llm import queries, variants
from tests_llm_util import FOLD, documents

LATIN = re.compile("[A-Za-zÀ-ÿ]+")


def edits(word, alphabet):
    for i in range(len(word)):
        yield word[:i] + word[i + 1 :]
        for c in alphabet:
            yield word[:i] + c + word[i + 1 :]
    for i in range(len(word) + 1):
        for c in alphabet:
            yield word[:i] + c + word[i:]


def brute(counts, ratio=5):
    alphabet = {c for w in counts for c in w}
    near = {w: {e for e in edits(w, alphabet) if e in counts and e != w} for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, counts[w], len(near[w]), form[w], counts.get(form[w]), root))
    return out


def found(df):
    rows = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def random_words(rng, n):
    """Words with many variants, chains of forms, repeated letters and code points beyond 16 bits."""
    counts = {}
    for _ in range(n):
        word = "".join(rng.choice("abbé𝒳") for _ in range(rng.randint(1, 7)))
        counts[word] = rng.choice([1, 2, 5, 10, 25, 26, 130, 700])
    return counts


def test_random_words(spark):
    counts = random_words(random.Random(3), 700)
    assert found(variants.spelling_groups(table(spark, counts))) == brute(counts)


def test_rounds_of_filters(spark, monkeypatch):
    """Filters that exceed the bound are probed a range at a time; many false positives don't matter either."""
    monkeypatch.setattr(variants, "MAX_BLOCKS", 23)
    monkeypatch.setattr(variants, "EDITS_AT_ONCE", 64)
    counts = random_words(random.Random(4), 400)
    sizes = {k: -(-n // variants.WORDS_IN_BLOCK) for k, n in Counter(map(len, counts)).items()}
    rounds = variants._rounds(sizes)
    assert len(rounds) > 2 and all(sum(b - a for a, b, _ in r.values()) <= 23 for r in rounds)
    assert found(variants.spelling_groups(table(spark, counts))) == brute(counts)


def test_edges(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert variants.spelling_groups(empty).count() == 0
    rows = [(None, 4, "x", 1), ("", 9, "x", 1), ("z" * 3000, 5, "x", 1), ("z" * 2999, 30, "x", 1), ("lone", 2, "x", 1)]
    got = found(variants.spelling_groups(spark.createDataFrame(rows, "word string, n long, near string, form_n long")))
    assert got == {("z" * 3000, 5, 1, "z" * 2999, 30, "z" * 2999), ("z" * 2999, 30, 1, None, None, "z" * 2999), ("lone", 2, 0, None, None, "lone")}


def damaged(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in LATIN.findall(text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_words_of_documents(spark):
    rng = random.Random(5)
    vocabulary = ["Straßen", "strassen", "Élevage", "elevage", "letters", "letter", "lettera", "short", "NAÏVETÉ", "x" * 900]
    rows = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "1", "’s"]) for _ in range(60))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "letters " * 40_000), (902, "letters"), (None, "letters letters Ünique"), (903, "tiny × ÷")]
    words = queries.damaged_words(documents(spark, rows))
    got = {r.word: r.n for r in variants.vocabulary(words, min_length=6, min_count=5).collect()}
    assert got == damaged(rows)
    assert any(w == "letter" for w in got)
    assert found(variants.spelling_groups(table(spark, got))) == brute(got)


def test_shuffles_only_what_a_filter_holds(spark):
    """With 16 bits a word, chance lets few of the edits through."""
    rng = random.Random(6)
    counts = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)): 1 for _ in range(3000)}
    from cashlens.llm.shelf import Shelf

    shelf = Shelf(spark, "positives")
    variants.near_pairs(shelf.put(table(spark, counts)), shelf)
    positives = shelf.tables[-1][0]
    assert positives.columns == ["word", "n", "edit"] and positives.count() < 0.03 * 3000 * 9 * 13
