"""Spelling variants: generated edits of each word, probed against Bloom filters, then joined with the vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.llm.arrowtext import mixed
from cashlens.llm.exact import folded
from cashlens.llm.shelf import Shelf

#: Words in a 64-bit block of a filter: 16 bits a word.
WORDS_IN_BLOCK = 4
#: Blocks of all filters that are broadcast at once (16 MB). A larger vocabulary is probed in several rounds.
MAX_BLOCKS = 1 << 21
#: Edits that are hashed at once inside a task.
EDITS_AT_ONCE = 1 << 19
#: A form has at least so many times the occurrences of its variant.
RATIO = 5

_ONE = np.uint64(1)
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(docs: DataFrame, letters: str, min_length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, run: every maximal run of at least `min_length` `letters` (a character class), A-Z lower-cased.

    The class must hold the lower-case form of each of its letters A-Z. A null text has no runs.
    """
    runs = F.regexp_extract_all(folded(F.col(text_col)), F.lit(f"[{letters}]{{{min_length},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))


def vocabulary(words: DataFrame, min_length: int = 1, min_count: int = 1) -> DataFrame:
    """word, n: words (one column) with enough code points and occurrences. Map tasks count before the shuffle."""
    long_enough = words.select(F.col(words.columns[0]).alias("word")).where(F.length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), len(words[0])).astype(np.uint64)


def _at(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What a code point adds to a word's hash from its place."""
    return mixed((places.astype(np.uint64) << np.uint64(32)) + codes + _PLACE)


def _blocks(sums: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, four bits in it) of hashes in a filter of so many blocks."""
    h = mixed(sums)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    six = np.uint64(63)
    bits = _ONE << (h & six)
    for shift in (6, 12, 18):
        bits |= _ONE << ((h >> np.uint64(shift)) & six)
    return block.astype(np.int64), bits


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], np.ndarray]]:
    words = batch.column("word").to_pylist()
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield int(length), [words[i] for i in rows], rows


def _insert(sizes: dict[int, int]) -> Callable:
    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, words, _ in _by_length(batch):
                block, bits = _blocks(_at(_codes(words), np.arange(length)).sum(axis=1, dtype=np.uint64), sizes[length])
                columns = [pa.array(np.full(len(words), length)), pa.array(block), pa.array(bits.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["length", "block", "bits"])

    return insert


Ranges = dict[int, tuple[int, int, int]]


def _rounds(sizes: dict[int, int]) -> list[Ranges]:
    """Ranges of blocks, by length: (first, end, where they start in the round's filter); MAX_BLOCKS a round at most."""
    rounds: list[Ranges] = []
    left = 0
    for length, size in sorted(sizes.items()):
        first = 0
        while first < size:
            if not left or length in rounds[-1]:
                rounds.append({})
                left = MAX_BLOCKS
            end = min(size, first + left)
            rounds[-1][length] = (first, end, MAX_BLOCKS - left)
            left -= end - first
            first = end
    return rounds


class _Filter:
    """The filters of a round, as tasks see them."""

    def __init__(self, bits: np.ndarray, ranges: Ranges, sizes: dict[int, int]):
        self.bits, self.ranges, self.sizes = bits, ranges, sizes

    def may_hold(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Which hashes of words of this length the filter holds; none outside the round's ranges."""
        first, end, start = self.ranges[length]
        block, bits = _blocks(sums, self.sizes[length])
        if first == 0 and end == self.sizes[length]:
            return (self.bits[start + block] & bits) == bits
        inside = (block >= first) & (block < end)
        found = self.bits[start + np.where(inside, block - first, 0)]
        return inside & ((found & bits) == bits)


def _edits(words: list[str], alphabet: np.ndarray, filters: _Filter) -> Iterator[tuple[int, str]]:
    """(row, edit) of the words' edits that a filter holds: deletions, and replacements by later code points.

    Insertions and replacements by earlier ones are the same pairs seen from the other word.
    """
    codes = _codes(words)
    n, length = codes.shape
    places = np.arange(length)
    own = _at(codes, places)
    total = own.sum(axis=1, dtype=np.uint64)
    if length - 1 in filters.ranges:
        before = np.cumsum(own, axis=1) - own
        moved = _at(codes[:, 1:], places[:-1])
        after = np.zeros_like(own)
        after[:, :-1] = np.cumsum(moved[:, ::-1], axis=1)[:, ::-1]
        found = filters.may_hold(before + after, length - 1)
        found[:, 1:] &= codes[:, 1:] != codes[:, :-1]  # of a repeated letter only the first goes
        for i, p in zip(*(x.tolist() for x in np.nonzero(found))):
            yield i, words[i][:p] + words[i][p + 1 :]
    if length not in filters.ranges or not len(alphabet):
        return
    step = max(1, EDITS_AT_ONCE // (n * len(alphabet)))
    for low in range(0, length, step):
        high = min(length, low + step)
        put = _at(alphabet[None, :], places[low:high, None])
        sums = (total[:, None] - own[:, low:high])[:, :, None] + put[None]
        later = alphabet[None, None, :] > codes[:, low:high, None]
        rows, at, letters = np.nonzero(later)
        held = np.flatnonzero(filters.may_hold(sums[rows, at, letters], length))
        for i, p, a in zip(rows[held].tolist(), at[held].tolist(), letters[held].tolist()):
            yield i, words[i][: low + p] + chr(int(alphabet[a])) + words[i][low + p + 1 :]


def _probe(filters, alphabet: np.ndarray) -> Callable:
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("n").to_numpy()
            for length, words, rows in _by_length(batch):
                step = max(1, EDITS_AT_ONCE // max(1, length * len(alphabet)))
                for low in range(0, len(words), step):
                    found = list(_edits(words[low : low + step], alphabet, filters.value))
                    at = [low + i for i, _ in found]
                    columns = [
                        pa.array([words[i] for i in at], pa.string()),
                        pa.array(counts[rows[at]] if at else [], pa.int64()),
                        pa.array([edit for _, edit in found], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["word", "n", "edit"])

    return probe


def near_pairs(words: DataFrame, shelf: Shelf) -> DataFrame:
    """word, n, near, near_n: each pair of words that differ by one code point, in one of its two directions.

    `words` has distinct words and their counts, and is a written table. A Bloom filter for each length is built by
    aggregation; tasks probe the edits of their words against the filters of all lengths, a round of at most MAX_BLOCKS
    blocks at a time, so what is broadcast doesn't grow with the vocabulary. Only edits that a filter holds are
    shuffled; the join with the vocabulary removes those that it holds by chance.
    """
    spark = words.sparkSession
    lengths = words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {row["length"]: -(-row["n"] // WORDS_IN_BLOCK) for row in lengths}
    letters = words.select(F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0)))).alias("letter")).distinct()
    alphabet = np.array(sorted(ord(row["letter"]) for row in letters.collect()), dtype=np.uint64)
    filled = words.select("word").mapInArrow(_insert(sizes), "length long, block long, bits long")
    filled = shelf.put(filled.groupBy("length", "block").agg(F.expr("bit_or(bits)").alias("bits")))
    held = []
    for ranges in _rounds(sizes):
        bits = np.zeros(sum(end - first for first, end, _ in ranges.values()), np.uint64)
        inside = " or ".join(f"(length = {k} and block >= {a} and block < {b})" for k, (a, b, _) in ranges.items())
        part = filled.where(inside).toArrow()
        start = np.array([ranges[k][2] - ranges[k][0] for k in part["length"].to_pylist()], dtype=np.int64)
        bits[part["block"].to_numpy() + start] = part["bits"].to_numpy().view(np.uint64)
        filters = spark.sparkContext.broadcast(_Filter(bits, ranges, sizes))
        held.append(shelf.put(words.mapInArrow(_probe(filters, alphabet), "word string, n long, edit string")))
        filters.unpersist()
    if not held:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    positives = held[0]
    for more in held[1:]:
        positives = positives.unionByName(more)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return positives.withColumnRenamed("edit", "near").join(known, "near").select("word", "n", "near", "near_n")


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root for each of the distinct `words` (word, n).

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word
    of largest n (of several, the first in code-point order), if that is at least `ratio` (over 1) times its own n. Root
    is where following forms ends: itself for a word without a form.

    Null and empty words are left out. Counts are positive. An empty table gives no rows.
    Words are of any length and any code points; every different code point of the vocabulary is tried at every place.
    """
    shelf = Shelf(words.sparkSession, "variants")
    words = shelf.put(words.where("word <> ''").select("word", F.col("n").cast("long").alias("n")))
    pairs = shelf.put(near_pairs(words, shelf))
    both = F.array(
        F.struct("word", "near", F.col("near_n").alias("of_near")),
        F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("of_near")),
    )
    best = F.min(F.struct((-F.col("of_near")).alias("less"), "near"))
    sides = pairs.select(F.inline(both)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    often = -F.col("best")["less"]
    formed = often >= ratio * F.col("n")
    grouped = shelf.put(
        words.join(sides, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("best")["near"]).alias("form"),
            F.when(formed, often).alias("form_n"),
        )
    )
    # Each step doubles the way; counts grow by the ratio along it, so there are few.
    paths = shelf.put(grouped.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = paths.select(F.col("word").alias("at"), F.col("root").alias("further"))
        step = paths.join(ahead, F.col("root") == F.col("at"), "left")
        longer = shelf.put(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        paths = longer.select("word", "root")
        if not longer.where("moved").limit(1).count():
            break
    shelf.keep(grouped, longer)
    return grouped.join(paths, "word", "left").withColumn("root", F.coalesce("root", "word"))
