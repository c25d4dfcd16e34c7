"""MinHash near-dedup: banded candidates, sequential Bayesian pruning of signature batches, exact verification.

Why the result is whole: a pair at the threshold shares a band with probability 1 - (1 - s^rows)^bands (1 - 5e-8 for
0.8, 4 rows, 32 bands; lower thresholds take shorter bands) and survives pruning with probability 1 - miss at least per batch. Candidates of a band bucket
are first compared with the bucket's leader only. Buckets whose members are not all in one component by then are settled
whole, without a cap: their members meet in blocks of bounded size, signatures first, then the full sets of those that
have a likely partner in another component. A block is compared inside its task and yields at most a link for each
member, so a group never becomes a table of its pairs, and members of one big component never meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.llm.arrowtext import FOLD, mixed, parts, shingle_hashes, span_hashes, text_bytes, word_spans
from cashlens.llm.components import components, first_linked
from cashlens.llm.shelf import Shelf

HASHES, BATCH = 128, 16
ROWS = (4, 2, 1)  # of a band: the first with which a pair at the threshold shares no band with a chance of MISSED at most
MISSED = 1e-7
BLOCK = 1 << 14  # shingles hashed at once, to stay in the cache
MEMBERS, WEIGHT = 512, 1 << 18  # documents, and shingles in them, of a block that one task compares with another
COLUMNS = 1 << 13  # shingles in a slice of the matrix of a block

_FACTORS = np.random.default_rng(3).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def row_shingles(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased. 64 bits: two shingles collide once in 2^64."""
    data, offsets = text_bytes(column)
    data = FOLD[data]
    starts, ends, bounds = word_spans(data, offsets)
    hashes, bounds = shingle_hashes(span_hashes(data, starts, ends), bounds, width)
    edges = bounds.tolist()
    return [np.unique(hashes[a:b]) for a, b in zip(edges, edges[1:])]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima (upper 32 bits) for each set; all ones for an empty one."""
    out = np.full((len(sets), HASHES), np.iinfo(np.uint32).max, dtype=np.uint32)
    filled = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(filled):
        group, held = [], 0
        while at < len(filled) and (not group or held + len(sets[filled[at]]) <= BLOCK):
            group.append(filled[at])
            held += len(sets[filled[at]])
            at += 1
        values = np.concatenate([sets[i] for i in group])
        starts = np.cumsum([0] + [len(sets[i]) for i in group[:-1]])
        work = np.empty_like(values)
        for k in range(HASHES):
            np.multiply(values, _FACTORS[k], out=work)
            out[group, k] = np.minimum.reduceat(work, starts) >> np.uint64(32)
    return out


def _fingerprints(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """128 bits of each set, whatever its order: sums of two further hashes of its members."""
    first = [int(np.sum(mixed(s ^ np.uint64(0x5851F42D4C957F2D)))) if len(s) else 0 for s in sets]
    second = [int(np.sum(mixed(s + np.uint64(0x14057B7EF767814F)))) if len(s) else 0 for s in sets]
    signed = lambda xs: [x - (1 << 64) if x >> 63 else x for x in xs]
    return signed(first), signed(second)


SIGNED = "id long, n_shingles long, fp1 long, fp2 long, sig binary"


def _sign(width: int) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            sets = row_shingles(part.column("text"), width)
            sigs = minima(sets)
            fp1, fp2 = _fingerprints(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(fp1, pa.int64()),
                    pa.array(fp2, pa.int64()),
                    pa.array([x.tobytes() if len(s) else None for x, s in zip(sigs, sets)], pa.binary()),
                ],
                ["id", "n_shingles", "fp1", "fp2", "sig"],
            )

    return sign


def band_rows(similarity: float) -> int:
    return next((r for r in ROWS if (1 - similarity**r) ** (HASHES // r) <= MISSED), ROWS[-1])


def smallest_linking(over: int, under: int) -> int:
    """Sets smaller than this link with equal sets only: 80 of 100 shared needs at least 4 of 5."""
    return -(-over // (under - over)) if under > over else 1 << 62


def _bands(rows: int) -> Callable:
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each band of a signature: a hash of the band's number and its values."""
        n = HASHES // rows
        factors = np.random.default_rng(5).integers(1, 2**63, (n, rows), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                cut = batch.slice(start, 4096)
                sig = np.frombuffer(b"".join(cut.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, n, rows)
                keys = mixed((sig.astype(np.uint64) * factors).sum(axis=2) + np.arange(n, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.astype(np.int64).ravel()),
                        pa.array(np.repeat(cut.column("id").to_numpy(), n)),
                        pa.array(np.repeat(cut.column("n_shingles").to_numpy(), n)),
                    ],
                    ["bucket", "id", "n"],
                )

    return bands


def least_matches(similarity: float, miss: float) -> list[int]:
    """For each batch end n: fewest equal minima of n with a chance above `miss` that the similarity is reached.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and P(s >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below <= miss:
            m += 1
            below += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out.append(m)
    return out


def _prune(least: list[int]) -> Callable:
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                cut = batch.slice(start, 4096)
                sides = [
                    np.frombuffer(b"".join(cut.column(c).to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
                    for c in ("sig_a", "sig_b")
                ]
                alive, equal = np.arange(cut.num_rows), np.zeros(cut.num_rows, dtype=np.int64)
                for k, m in enumerate(least):
                    at = slice(k * BATCH, (k + 1) * BATCH)
                    equal[alive] += (sides[0][alive, at] == sides[1][alive, at]).sum(axis=1)
                    alive = alive[equal[alive] >= m]
                yield cut.select(["a", "b"]).take(pa.array(alive))

    return prune


def _verify(width: int, over: int, under: int) -> Callable:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(iter([batch]), "text_b"):
                left = part.column("text_a").dictionary_encode()
                sets = row_shingles(left.dictionary, width)
                linked = []
                for i, (at, b) in enumerate(zip(left.indices.to_pylist(), row_shingles(part.column("text_b"), width))):
                    a = sets[at]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if under * both >= over * (len(a) + len(b) - both):
                        linked.append(i)
                yield part.select(["a", "b"]).take(pa.array(linked, pa.int64()))

    return verify


def _met(batch: pa.RecordBatch, payload: str) -> Iterator[tuple]:
    """(group, ids, components, sizes, payloads, whether members are of different blocks or of the one block)."""
    lists = batch.column("items")
    flat = lists.flatten()
    ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
    ids, component, n, own = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "n", "own"))
    content = flat.field(payload)
    for group, i, j, a, b in zip(*(batch.column(c).to_pylist() for c in ("group", "i", "j")), ends, ends[1:]):
        at = slice(a, b)
        across = np.ones((b - a, b - a), dtype=bool) if i == j else own[at, None] != own[None, at]
        yield group, ids[at], component[at], n[at], content.slice(a, b - a), across


def _possible(component: np.ndarray, n: np.ndarray, across: np.ndarray, over: int, under: int) -> np.ndarray:
    fits = under * np.minimum(n[:, None], n[None]) >= over * np.maximum(n[:, None], n[None])
    return fits & across & (component[:, None] != component[None])


def _likely(least: list[int], over: int, under: int) -> Callable:
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of blocks that have, by their signatures, a likely partner in another component."""
        for batch in batches:
            groups, out = [], []
            for group, ids, component, n, sigs, across in _met(batch, "sig"):
                alive = _possible(component, n, across, over, under)
                if not alive.any():
                    continue
                sig = np.frombuffer(b"".join(sigs.to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
                a, b = np.nonzero(np.triu(alive | alive.T))
                equal = np.zeros(len(a), dtype=np.int64)
                for k, m in enumerate(least):
                    at = slice(k * BATCH, (k + 1) * BATCH)
                    for start in range(0, len(a), 1 << 16):
                        run = slice(start, start + (1 << 16))
                        equal[run] += (sig[a[run], at] == sig[b[run], at]).sum(axis=1)
                    stay = equal >= m
                    a, b, equal = a[stay], b[stay], equal[stay]
                found = ids[np.unique(np.concatenate([a, b]))]
                out.extend(found.tolist())
                groups.extend([group] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(out, pa.int64())], ["group", "id"])

    return likely


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with each other, through slices of their incidence matrix."""
    values = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    number = np.cumsum(np.diff(values, prepend=values[:1]) != 0)
    common = np.bincount(number)[number] > 1
    number, rows = number[common], rows[common]
    number = np.cumsum(np.diff(number, prepend=number[:1]) != 0) if len(number) else number
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        a, b = np.searchsorted(number, [start, start + COLUMNS])
        matrix = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        matrix[rows[a:b], number[a:b] - start] = 1
        out += matrix @ matrix.T
    return out.astype(np.int64)


def _exact(width: int, over: int, under: int) -> Callable:
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """True links between components inside blocks: for each member that has some, one to its first."""
        for batch in batches:
            a, b = [], []
            for _, ids, component, n, texts, across in _met(batch, "text"):
                possible = _possible(component, n, across, over, under)
                if not possible.any():
                    continue
                sets = row_shingles(texts, width)
                both = shared_counts(sets)
                size = np.array([len(s) for s in sets])
                hits = possible & (under * both >= over * (size[:, None] + size[None] - both))
                first, other = first_linked(hits | hits.T)
                a.extend(ids[first].tolist())
                b.extend(ids[other].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return exact


def _blocks(rows: DataFrame, payload: DataFrame, content: str, shelf: Shelf) -> DataFrame:
    """(group, i, j, items): members (group, id, n, component) of groups, cut into blocks, blocks brought together by two.

    Members of a component that fills a block of its own meet those of other components only; the rest, a group's
    stragglers, meet everyone. Numbers of blocks come from counts, members are dealt to them by a hash.
    """
    sizes = rows.groupBy("group", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    sizes = shelf.put(sizes.withColumn("big", F.col("c") > MEMBERS))
    of = lambda c, big: F.coalesce(F.sum(F.when(F.col("big") == big, F.col(c))), F.lit(0))
    blocks = lambda big: F.ceil(F.greatest(of("c", big) / MEMBERS, of("s", big) / WEIGHT)).cast("int")
    groups = sizes.groupBy("group").agg(
        F.count(F.lit(1)).alias("components"), F.count_if("big").alias("bigs"), blocks(False).alias("ns"), blocks(True).alias("nm")
    )
    groups = shelf.put(groups.filter("components > 1"))
    placed = rows.join(sizes.select("group", "component", "big"), ["group", "component"]).join(groups, "group")
    spread = F.xxhash64(F.lit(29), "id")
    within = lambda n: F.pmod(spread, F.greatest(n, F.lit(1)))
    own = F.when(F.col("big"), F.col("ns") + within("nm")).otherwise(within("ns")).cast("int")
    everyone = F.sequence(F.lit(0), F.col("ns") + F.col("nm") - 1)
    met = F.filter(everyone, lambda k: ~F.col("big") | (F.col("bigs") > 1) | (k < F.col("ns")))
    placed = placed.withColumn("own", own).select("group", "id", "n", "component", "own", F.explode(met).alias("with"))
    placed = placed.join(payload, "id")
    item = F.struct("id", "n", "component", "own", content).alias("item")
    cut = placed.select("group", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), item)
    return cut.groupBy("group", "i", "j").agg(F.collect_list("item").alias("items"))


def near_components(
    docs: DataFrame,
    width: int = 5,
    over: int = 80,
    under: int = 100,
    miss: float = 1e-7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Texts link when under * |intersection| >= over * |union| of their sets of `width`-word shingles (`over`/`under` at
    least 0.5); a text of fewer words has its whole sequence as the one shingle. component_id is the smallest id
    reachable by links, kept says that it is the row's own. Equal sets are one class, compared once. Null, empty and
    wordless texts have no shingles and link with nothing. A null id links with nothing: component_id null, kept true.
    Rows that repeat an id are each judged by their own text, and are one node in the links of others; rows that repeat
    an id and a text are compared once. An empty table gives no rows; other columns are ignored.
    """
    shelf = Shelf(docs.sparkSession, "near")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = shelf.put(source.mapInArrow(_sign(width), SIGNED))
    solid = signed.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = shelf.put(solid.groupBy("fp1", "fp2", "n_shingles").agg(F.min("id").alias("rep")))
    key = ["fp1", "fp2", "n_shingles"]
    # Each class is represented by its smallest id.
    firsts = classes.filter(f"n_shingles >= {smallest_linking(over, under)}").select(
        F.col("rep").alias("id"), F.col("fp1").alias("f1"), F.col("fp2").alias("f2")
    )
    reps = solid.join(firsts, "id").filter("fp1 = f1 AND fp2 = f2").dropDuplicates(["id", "fp1", "fp2"])
    reps = shelf.put(reps.select("id", "n_shingles", "sig"))
    banded = reps.mapInArrow(_bands(band_rows(over / under)), "bucket long, id long, n long")
    leaders = banded.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("lead"), F.count(F.lit(1)).alias("size"))
    leaders = shelf.put(leaders.filter("size > 1").select("bucket", "lead.*").toDF("bucket", "lead", "lead_n"))
    members = shelf.put(banded.join(leaders, "bucket"))

    near_size = lambda x, y: f"{under} * least({x}, {y}) >= {over} * greatest({x}, {y})"

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = shelf.put(ids.distinct().toDF("wanted"))
        return shelf.put(source.join(wanted, F.col("id") == F.col("wanted"), "left_semi").dropDuplicates(["id", "text"]))

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = shelf.put(pairs.distinct())
        side = lambda s: reps.select(F.col("id").alias(s), F.col("sig").alias(f"sig_{s}"))
        candidates = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b")
        alive = shelf.put(candidates.mapInArrow(_prune(least_matches(over / under, miss)), "a long, b long"))
        texts = texts_of(alive.select("a").union(alive.select("b")))
        text = lambda s: texts.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}"))
        both = alive.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
        return shelf.put(both.mapInArrow(_verify(width, over, under), "a long, b long"))

    star = members.filter("id <> lead").filter(near_size("n", "lead_n")).select(F.col("lead").alias("a"), F.col("id").alias("b"))
    links = linked(star)
    found = components(links, shelf)

    # What the leaders have not settled: buckets that hold several components.
    placed = members.join(found.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left")
    placed = placed.select("bucket", "id", "n", "lead", F.coalesce("component", "id").alias("component"))
    placed = shelf.put(placed.filter("id <> lead"))
    split = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    split = shelf.put(split.filter("low <> high").select("bucket"))
    open_ = shelf.put(placed.join(split, "bucket", "left_semi"))
    # Buckets are put together by the least leader that their members know, so that a member is in few groups.
    hubs = shelf.put(open_.groupBy("id").agg(F.min("lead").alias("hub")))
    groups = shelf.put(open_.join(hubs, "id").groupBy("bucket").agg(F.min("hub").alias("group")))
    rows = shelf.put(open_.join(groups, "bucket").select("group", "id", "n", "component").distinct())
    sigs = _blocks(rows, reps.select("id", "sig"), "sig", shelf)
    likely = sigs.mapInArrow(_likely(least_matches(over / under, miss), over, under), "group long, id long")
    likely = shelf.put(likely.distinct())
    rows = shelf.put(rows.join(likely, ["group", "id"], "left_semi"))
    blocks = _blocks(rows, texts_of(rows.select("id")), "text", shelf)
    rest = shelf.put(blocks.mapInArrow(_exact(width, over, under), "a long, b long"))
    if rest.limit(1).count():
        found = components(links.union(rest), shelf)

    of_class = classes.join(found.withColumnRenamed("id", "of"), F.col("rep") == F.col("of"), "left")
    of_class = shelf.put(of_class.select(*key, F.coalesce("component", "rep").alias("component_id")))
    shelf.keep(signed, of_class)
    marked = signed.drop("sig").join(of_class, key, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return marked.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id. Needs distinct ids."""
    found = near_components(docs, id_col=id_col, text_col=text_col, **how).filter("kept")
    stays = found.select(F.col(id_col).alias("_stay")).distinct()
    return docs.join(stays, docs[id_col].cast("long").eqNullSafe(stays["_stay"]), "left_semi")
