"""Embedding near-dedup with a random-projection forest: overlapping splits, comparison in leaves, union of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.llm.components import components, first_linked
from cashlens.llm.shelf import Shelf

TREES = 12
LEVELS = 40  # a node may be split as often
AT_ONCE = 8  # levels for which a vector's projections are made together
LEAF = 256  # vectors; a smaller node is not split
BLOCK = 512  # vectors of a group that one task compares with as many others
#: Overlap on either side of a split, in standard deviations of the projected distance of two vectors at the threshold.
SPILL = 0.4

VALID = "id long, label long, vec binary"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that can link, with the vector scaled to length 1 in double precision."""
    for batch in batches:
        ids, labels, out = [], [], []
        for i, label, values in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "vec"))):
            if values is None or not values or None in values:
                continue
            vector = np.array(values, dtype=np.float64)
            if not np.isfinite(vector).all() or not vector.any():
                continue
            vector = vector / np.abs(vector).max()  # so that squares neither overflow nor vanish
            vector = vector / np.sqrt(vector @ vector) + 0.0
            ids.append(i)
            labels.append(label)
            out.append(vector.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(out, pa.binary())], ["id", "label", "vec"]
        )


def _project(dim: int, level: int) -> Callable:
    """Adds to each (id, label, tree, node, vec) the vector's projections on its tree's directions for the next levels."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.random.default_rng(23 + level).normal(size=(TREES, dim, AT_ONCE))
        w /= np.sqrt((w * w).sum(axis=1, keepdims=True))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), dtype=np.float64).reshape(-1, dim)
            trees = batch.column("tree").to_numpy()
            values = np.empty((len(x), AT_ONCE), np.float32)
            for tree in np.unique(trees):
                values[trees == tree] = x[trees == tree] @ w[tree]
            offsets = np.arange(len(x) + 1, dtype=np.int32) * AT_ONCE
            at = pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "tree", "node")), at], ["id", "label", "tree", "node", "at"])

    return project


def _forest(reps: DataFrame, dim: int, threshold: float, shelf: Shelf) -> DataFrame:
    """(id, leaf, n): the leaves of all trees, in which a vector near a split is on both sides.

    A level is one grouped aggregation (mean, spread and size of each node) and one join, for all trees at once. A node
    is a leaf if it is small, or if its spread along the direction is below the distance of linked vectors, where no
    split could part it well; `_pair_blocks` compares such a dense leaf whole, whatever its size. A small label is one leaf, once
    for all trees. Projections are made for a few levels at a time, for the vectors that get there.
    """
    sigma = sqrt(2 * (1 - threshold)) / sqrt(dim)
    sizes = shelf.put(reps.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    small = reps.select("id", "label").join(sizes.filter(F.col("n") <= LEAF), "label")
    leaves = [small.select("id", F.xxhash64(F.lit(-1), "label").alias("leaf"), "n")]
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    large = reps.join(sizes.filter(F.col("n") > LEAF), "label").select("id", "label", trees)
    rows = large.withColumn("node", F.lit(1).cast("long"))
    key = ["label", "tree", "node"]
    for level in range(LEVELS):
        if level % AT_ONCE == 0:
            with_vec = rows.select("id", *key).join(reps.select("id", "vec"), "id")
            shape = "id long, label long, tree int, node long, at array<float>"
            rows = shelf.put(with_vec.mapInArrow(_project(dim, level), shape))
            if not rows.limit(1).count():
                break
        here = F.col("at")[level % AT_ONCE].cast("double")
        nodes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg(here).alias("mid"), F.stddev_pop(here).alias("spread"))
        last = F.lit(level == LEVELS - 1)
        done = (F.col("n") <= LEAF) | (F.col("spread") < sigma) | last
        nodes = shelf.put(nodes.withColumn("done", done))
        placed = shelf.put(rows.join(nodes, key))
        leaf = F.xxhash64(F.lit(level), *key).alias("leaf")
        leaves.append(placed.filter("done").select("id", leaf, "n"))
        if not nodes.filter("not done").limit(1).count():
            break
        margin = SPILL * sigma
        sides = F.array_compact(
            F.array(
                F.when(here <= F.col("mid") + margin, F.col("node") * 2),
                F.when(here >= F.col("mid") - margin, F.col("node") * 2 + 1),
            )
        )
        rows = placed.filter("not done").select("id", "label", "tree", "at", F.explode(sides).alias("node"))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def _pair_blocks(rows: DataFrame, group: str) -> DataFrame:
    """(group, i, j, items): rows (group, n, id, weight, vec) cut into blocks by a hash, every two blocks brought together.

    A group of up to BLOCK rows is one block; a row of a larger one goes to as many pairs of blocks as the group has.
    """
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(F.lit(41), "id"), F.col("blocks")).cast("int")
    cut = rows.withColumn("blocks", count).withColumn("own", own)
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    item = F.struct("id", "weight", "own", "vec")
    low, high = F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j")
    return cut.select(group, low, high, item.alias("item")).groupBy(group, "i", "j").agg(F.collect_list("item").alias("items"))


def _groups(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    lists = batch.column("items")
    flat = lists.flatten()
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    ids, weights, own = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "weight", "own"))
    vectors = flat.field("vec").to_pylist()
    for k, same in enumerate((np.array(batch.column("i")) == np.array(batch.column("j"))).tolist()):
        at = slice(ends[k], ends[k + 1])
        if at.stop - at.start > 1:
            x = np.frombuffer(b"".join(vectors[at]), dtype=np.float64).reshape(-1, dim)
            yield ids[at], weights[at], own[at], x, same


def _linked(x: np.ndarray, own: np.ndarray, same: bool, threshold: float) -> np.ndarray:
    """Links as a matrix without the diagonal; between two blocks only those across."""
    hits = x @ x.T >= threshold
    np.fill_diagonal(hits, False)
    if not same:
        hits &= own[:, None] != own[None, :]
    return hits


def _local_links(dim: int, threshold: float) -> Callable:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each linked vector with the first of its component inside the group: as many rows as vectors, not as pairs."""
        for batch in batches:
            a, b = [], []
            for ids, _, own, x, same in _groups(batch, dim):
                hits = _linked(x, own, same, threshold)
                first, other = first_linked(hits)
                a.extend(ids[first].tolist())
                b.extend(ids[other].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return join


def _count_links(dim: int, threshold: float) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_ids, out_links = [], []
            for ids, weights, own, x, same in _groups(batch, dim):
                links = _linked(x, own, same, threshold) @ weights
                out_ids.extend(ids[links > 0].tolist())
                out_links.extend(links[links > 0].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_ids, pa.int64()), pa.array(out_links, pa.int64())], ["id", "links"]
            )

    return count


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows of one label link when the cosine of their vectors, in double precision, reaches `threshold`. Equal directions
    are one class with a count, so copies are never paired. Candidates come from the forest; links inside a component
    are then counted exactly, block by block. A pair at the threshold is parted by a split with about 4 %, so that some
    tree keeps it together with a chance above 1 - 1e-6 for ten levels.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without label or id, link with
    nothing: n_links 0, component_id their id, kept true. Vectors of different lengths don't link. Rows that repeat an
    id count as vectors of their own. An empty table gives no rows; other columns are ignored.
    """
    shelf = Shelf(vectors.sparkSession, "vectors")
    source = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec")
    )
    usable = source.filter(F.col("id").isNotNull() & F.col("label").isNotNull())
    valid = shelf.put(usable.mapInArrow(_vectors, VALID))
    classes = valid.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    # A class has a number of its own: an id may stand for classes of several labels.
    classes = classes.withColumn("dim", (F.octet_length("vec") / 8).cast("int"))
    classes = shelf.put(classes.withColumn("class", F.monotonically_increasing_id()))
    dims = [row["dim"] for row in classes.select("dim").distinct().collect()]  # one number for each length in use

    links, counts = [], []
    for dim in dims:
        reps = classes.filter(F.col("dim") == dim).select(F.col("class").alias("id"), "label", "vec", "weight")
        leaves = _forest(reps, dim, threshold, shelf)
        rows = leaves.join(reps.select("id", "weight", "vec"), "id")
        pairs = _pair_blocks(rows, "leaf").mapInArrow(_local_links(dim, threshold), "a long, b long")
        found = components(pairs, shelf)
        links.append(found)
        sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        sized = found.join(shelf.put(sizes), "component").join(reps.select("id", "weight", "vec"), "id")
        counted = _pair_blocks(sized, "component").mapInArrow(_count_links(dim, threshold), "id long, links long")
        counts.append(shelf.put(counted.groupBy("id").agg(F.sum("links").alias("links"))))
    info = classes.select("label", "vec", F.col("id").alias("own"), "weight", F.col("class").alias("id"))
    for frames, column in ((links, "component"), (counts, "links")):
        merged = frames[0] if frames else info.select("id", F.col("id").alias(column)).limit(0)
        for more in frames[1:]:
            merged = merged.unionByName(more)
        info = info.join(merged, "id", "left")
    info = shelf.put(info)
    smallest = info.where("component IS NOT NULL").groupBy("component").agg(F.min("own").alias("smallest"))
    info = shelf.put(
        info.join(smallest, "component", "left").select(
            "label",
            "vec",
            F.coalesce("smallest", "own").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        )
    )
    shelf.keep(valid, info)
    linked = valid.join(info, ["label", "vec"]).select("id", "n_links", "component_id")
    invalid = source.withColumn("ok", _is_valid()).filter(~F.col("ok"))
    alone = invalid.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    result = linked.unionByName(alone)
    return result.select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _is_valid():
    """The same test as in `_vectors`, as a column expression."""
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("vec", lambda v: v != 0)
    whole = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
    return F.coalesce(whole & finite & some, F.lit(False))
