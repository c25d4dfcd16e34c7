"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashlens.llm.arrowtext import FOLD, parts, shingle_hashes, span_hashes, text_bytes, word_spans
from cashlens.llm.shelf import Shelf

#: Kinds of bytes that are counted; any other byte is of the last kind.
KINDS = ("a-z", "A-Z", "0-9", " ", "\n", "\t\r\v\f", ".,;:'\"?()-", "!", "|", "#$%&*", "@^~<>{}[]\\/_=+`", "high", "more", "")
FEATURES = 256
WIDTH = 4.0  # of the Gaussian kernel, in standard deviations of the statistics
RIDGE = 1e-4
BINS = 2048  # of raw scores, for calibration
LOW, HIGH = -0.5, 1.5  # raw scores beyond are put at the ends


def _kind_table() -> np.ndarray:
    table = np.full(256, len(KINDS) - 1, dtype=np.int64)
    for k, chars in enumerate(KINDS):
        if chars in ("high", "more"):
            continue
        text = "".join(map(chr, range(ord(chars[0]), ord(chars[2]) + 1))) if len(chars) == 3 and chars[1] == "-" else chars
        table[[ord(c) for c in text]] = k
    table[0xC0:] = KINDS.index("high")  # first byte of a longer character
    table[0x80:0xC0] = KINDS.index("more")  # its other bytes
    return table


KIND = _kind_table()


def statistics(column: pa.Array) -> np.ndarray:
    """One row of numbers per text; no language, source or id goes in. An empty text has zeros."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(row * len(KINDS) + KIND[data], minlength=n * len(KINDS)).reshape(n, len(KINDS)).astype(float)
    chars = np.maximum(counts.sum(axis=1) - counts[:, KINDS.index("more")], 1)
    starts, ends, bounds = word_spans(data, offsets)
    words = np.maximum(np.diff(bounds), 1).astype(float)
    hashes = span_hashes(FOLD[data], starts, ends)
    pairs, pair_bounds = shingle_hashes(hashes, bounds, 2)
    lengths = np.concatenate([[0], np.cumsum(ends - starts)]).astype(float)
    short = np.concatenate([[0], np.cumsum(ends - starts <= 3)]).astype(float)
    long_ = np.concatenate([[0], np.cumsum(ends - starts >= 20)]).astype(float)
    distinct, top, distinct_pairs = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        if bounds[i] < bounds[i + 1]:
            seen = np.unique(hashes[bounds[i] : bounds[i + 1]], return_counts=True)[1]
            distinct[i], top[i] = len(seen), seen.max()
            distinct_pairs[i] = len(np.unique(pairs[pair_bounds[i] : pair_bounds[i + 1]]))
    per_char = counts[:, : KINDS.index("more")] / chars[:, None]
    over = lambda sums: (sums[bounds[1:]] - sums[bounds[:-1]]) / words
    return np.column_stack(
        [
            per_char,
            np.log1p(chars),
            np.log1p(words),
            over(lengths),
            over(short),
            over(long_),
            distinct / words,
            top / words,
            distinct_pairs / words,
            counts[:, KINDS.index("\n")] / words,
            counts[:, KINDS.index("A-Z")] / np.maximum(counts[:, 0] + counts[:, 1], 1),
        ]
    )


STATISTICS = KINDS.index("more") + 10


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, "text"):
        values = pa.array(statistics(part.column("text")).astype(np.float32).ravel())
        rows = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * STATISTICS, values)
        yield pa.RecordBatch.from_arrays([part.column("id"), rows], ["id", "stats"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(-1, STATISTICS).astype(np.float64)


@dataclass
class Model:
    """All that scoring needs; its size is fixed by FEATURES and BINS."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.full(1, 0.5))
    seed: int = 17

    def features(self, stats: np.ndarray) -> np.ndarray:
        """cos(x W + b) with normal W and uniform b: inner products approximate exp(-|x - y|^2 / (2 WIDTH^2))."""
        random = np.random.default_rng(self.seed)
        w = random.normal(size=(STATISTICS, FEATURES)) / WIDTH
        b = random.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, LOW, HIGH)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.knots[1][0])
        return np.interp(self.raw(stats), *self.knots)


def _normal_equations(model: Model) -> Callable:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One partition's sum of the upper triangle of F'F (j < FEATURES + 1) and of F'y (j = FEATURES + 1)."""
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                cut = batch.slice(start, 4096)
                f = model.features(_matrix(cut))
                total += f.T @ np.column_stack([f, cut.column("y").to_numpy()])
        i, j = np.triu_indices(FEATURES + 1, 0, FEATURES + 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"]
        )

    return sums


def _raw_bins(model: Model) -> Callable:
    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = ((model.raw(_matrix(batch)) - LOW) / (HIGH - LOW) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], ["bin", "y"])

    return bins


def isotonic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (x, share) of the best rising fit to shares `positive / n` at rising x."""
    blocks: list[list[float]] = []
    for at, weight, hit in zip(x.tolist(), n.tolist(), positive.tolist()):
        blocks.append([at * weight, weight, hit])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    moment, weight, hits = np.array(blocks).T
    return moment / weight, hits / weight


def held_out(id_col: Column) -> Column:
    """Rows that no label is learnt from: CRC-32 of the id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, shelf: Shelf) -> Model:
    """The model of labels (id, y) on stats (id, stats). Only sums come to the driver, of a size that no data changes.

    Without labels, or with one label only, every score is the share of 1 (0.5 without any).
    """
    labels = labels.groupBy("id").agg(F.avg("y").alias("y"))
    train = shelf.put(stats.join(labels, "id"))
    column = lambda k: F.col("stats")[k].cast("double")
    sums = [f(column(k)).alias(f"{f.__name__}{k}") for f in (F.avg, F.stddev_pop) for k in range(STATISTICS)]
    row = train.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), *sums).first()
    if not row["n"] or row["ones"] in (0, row["n"]):
        share = row["ones"] / row["n"] if row["n"] else 0.5
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), None, (np.zeros(1), np.full(1, share)))
    mean, spread = (np.array([row[f"{f}{k}"] for k in range(STATISTICS)]) for f in ("avg", "stddev_pop"))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0))
    parts_ = train.mapInArrow(_normal_equations(model), "i int, j int, v double")
    cells = parts_.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    full = np.zeros((FEATURES + 1, FEATURES + 2))
    full[cells["i"], cells["j"]] = cells["v"]
    gram = full[:, :-1] + np.triu(full[:, :-1], 1).T
    model.weights = np.linalg.solve(gram + RIDGE * row["n"] * np.eye(len(gram)), full[:, -1])
    bins = train.mapInArrow(_raw_bins(model), "bin int, y double")
    bins = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).toPandas().sort_values("bin")
    x = LOW + (bins["bin"].to_numpy() + 0.5) * (HIGH - LOW) / BINS
    model.knots = isotonic(x, bins["n"].to_numpy(), bins["ones"].to_numpy())
    return model


def _score(model: Model) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(model.score(_matrix(batch)))], ["id", "score"]
            )

    return score


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.7,
) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted (1 from `threshold` on).

    Learns from the labels of rows that are not held out; a label that is null is none, several labels of an id count as
    their mean, and a repeated document id counts once for each row. Texts are read once, whole; statistics of null and
    empty texts are zeros, and they get a score like any other. A null id is never held out and has no label. An empty
    table gives no rows; other columns are ignored.
    """
    shelf = Shelf(docs.sparkSession, "quality")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    stats = shelf.put(source.mapInArrow(_measure, "id long, stats array<float>"))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y"))
    marks = marks.filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    model = fit(stats, marks, shelf)
    shelf.keep(stats)
    scored = stats.mapInArrow(_score(model), "id long, score double")
    return scored.select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents with predicted = 1, with all their columns."""
    good = quality_scores(docs, labels, id_col, **how).filter("predicted = 1")
    good = good.select(F.col(id_col).alias("_good")).distinct()
    return docs.join(good, docs[id_col].cast("long").eqNullSafe(good["_good"]), "left_semi")
