"""Repeated byte strings: suffixes pruned by a ranked difference-cover sample, then sorted one bucket at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashlens.llm.arrowtext import mixed, text_bytes
from cashlens.llm.shelf import Shelf

#: Perfect difference sets: any two residues have a shift below the period that brings both into the set.
COVERS = {
    7: (1, 2, 4),
    13: (0, 1, 3, 9),
    21: (3, 6, 7, 12, 14),
    31: (1, 5, 11, 24, 25, 27),
}
#: Sample suffixes are compared to at least so many bytes.
MIN_DEPTH = 30
#: Text in a block, the unit in which tasks ask about their suffixes. One longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: What a task sorts in a round. The number of rounds follows from it, from the corpus and from the shuffle partitions.
ROUND_BYTES = 20 << 20
#: Buckets that a task sorts one after another.
BUCKETS_IN_TASK = 2
#: Ids of rows without one: after all others, and none is smaller than another.
NO_ID = np.iinfo(np.int64).max

_HALF = np.uint64(32)
_KEYS = np.random.default_rng(13).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def cover_of(length: int) -> tuple[int, tuple[int, ...]]:
    """(period, set) for strings of `length` bytes: a sample suffix keeps MIN_DEPTH of them whatever the shift."""
    period = max((p for p in COVERS if length - p + 1 >= MIN_DEPTH), default=None)
    if period is None:
        raise ValueError(f"strings must have at least {min(COVERS) + MIN_DEPTH - 1} bytes")
    return period, COVERS[period]


def hashes(data: np.ndarray, at: np.ndarray, length: int, *seeds: int) -> list[np.ndarray]:
    """For each seed, 64 bits of the `length` bytes from each place, read as words of eight."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    totals = [np.full(len(at), _KEYS[seed], dtype=np.uint64) for seed in seeds]
    for k, start in enumerate(range(0, length, 8)):
        word = words[at + min(start, length - 8)] * _KEYS[16 + k % 48]
        for seed, total in zip(seeds, totals):
            total ^= total >> np.uint64(32)
            total *= _KEYS[8 + seed]
            total += word
    return [mixed(total) for total in totals]


class Block:
    """Texts of a block, one after another, with the ids of the documents they first stand in."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.sizes = np.frombuffer(sizes, np.int64)
        self.data = np.frombuffer(data, np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def suffixes(self, length: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(places, texts) of the suffixes of at least `length` bytes whose place in their text is in the cover."""
        places = np.arange(0, self.sizes.max(initial=0) + period, period)[:, None] + np.array(sorted(cover))
        places = places.ravel()
        n = np.searchsorted(places, self.sizes - length, side="right")
        moved = np.repeat(self.starts, n)
        moved += places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        return moved, np.repeat(np.arange(len(n)), n)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket follows from the upper half of a name's key, which a suffix's first bytes settle."""
    return (((keys >> _HALF) * np.uint64(buckets)) >> _HALF).astype(np.int32)


def _keys(prefix: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Keys whose upper half comes from one hash and whose lower half from another: in order of key is in order of bucket."""
    return ((prefix >> _HALF) << _HALF) | (whole >> _HALF)


def _groups(keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): the order that brings equal names together, and where each begins in it. `more` may be empty."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if len(more):
        further = more[order]
        if (~new[1:] & (further[1:] != further[:-1])).any():  # two names share 64 bits
            order = np.lexsort((more, keys))
            ordered, further = keys[order], more[order]
            new[1:] = (ordered[1:] != ordered[:-1]) | (further[1:] != further[:-1])
    return order, np.flatnonzero(new)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary array: the bytes of the values from each start to the next."""
    offsets = np.append(starts, len(values)) * (values.nbytes // max(1, len(values)))
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.binary(), len(starts), buffers)


def _values(column: pa.Array, kind=np.uint64) -> np.ndarray:
    """All values of a binary array, one after another."""
    return np.frombuffer(text_bytes(column)[0].tobytes(), kind)


BLOCK = "block long, ids binary, sizes binary, names binary, copied binary, data binary"


def _blocks(length: int) -> Callable:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Different texts, packed. Texts without a suffix of the length have no place in any."""
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int, bytes, bool, bytes]] = []
        size = 0

        def pack():
            nonlocal number, held, size
            arrays = [
                np.array([i for i, *_ in held], np.int64).tobytes(),
                np.array([len(t) for *_, t in held], np.int64).tobytes(),
                b"".join(n for _, n, _, _ in held),
                bytes(c for _, _, c, _ in held),
                b"".join(t for *_, t in held),
            ]
            record = [pa.array([number], pa.int64()), *[pa.array([x], pa.binary()) for x in arrays]]
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays(record, ["block", "ids", "sizes", "names", "copied", "data"])

        for batch in batches:
            for first, name, copied, text in zip(*(batch.column(n).to_pylist() for n in ("first_id", "name", "copied", "text"))):
                if len(text) < length:
                    continue
                if held and size + len(text) > BLOCK_BYTES:
                    yield pack()
                held.append((NO_ID if first is None else first, name, copied, text))
                size += len(text)
        if held:
            yield pack()

    return blocks


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name, first_id of the texts that several rows have."""
    for row in _rows(batches):
        ids, names = np.frombuffer(row["ids"], np.int64), row["names"]
        several = np.flatnonzero(np.frombuffer(row["copied"], np.uint8))
        first = [None if ids[t] == NO_ID else int(ids[t]) for t in several.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([names[16 * t : 16 * t + 16] for t in several.tolist()], pa.binary()), pa.array(first, pa.int64())], ["name", "first_id"])


@dataclass
class Names:
    """Different names of a block's suffixes, in order of key and so of bucket, and which of them each suffix has.

    Both the task that asks and the one that reads the answers make them, so an answer is a bit for each name.
    """

    keys: np.ndarray
    more: np.ndarray
    least: np.ndarray
    most: np.ndarray
    name_of: np.ndarray
    buckets: int

    @classmethod
    def of(cls, keys: np.ndarray, more: np.ndarray, ids: np.ndarray, buckets: int) -> Names:
        order, starts = _groups(keys, more)
        least, most = _ends(ids[order], starts)
        name_of = np.empty(len(keys), np.int32)
        name_of[order] = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(keys))))
        first = order[starts]
        return cls(keys[first], more[first] if len(more) else more, least, most, name_of, buckets)

    def ask(self, block: int) -> pa.RecordBatch:
        """A row for each bucket."""
        bucket = _bucket(self.keys, self.buckets)
        starts = _runs(bucket)
        arrays = [
            pa.array(bucket[starts]),
            pa.array(np.full(len(starts), block)),
            _lists(self.keys, starts),
            _lists(self.more, starts if len(self.more) else starts * 0),
            _lists(self.least, starts),
            _lists(self.most - self.least, starts),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["bucket", "block", "keys", "more", "ids", "span"])

    def told(self, answers: bytes) -> np.ndarray:
        """A truth value for each suffix, from (bucket, bytes, bits) one after another."""
        found = np.zeros(len(self.keys), bool)
        bucket = _bucket(self.keys, self.buckets)
        starts = _runs(bucket)
        ranges = dict(zip(bucket[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)])))
        at = 0
        while at < len(answers):
            number, size = np.frombuffer(answers, np.int32, 2, at).tolist()
            low, high = ranges[number]
            bits = np.unpackbits(np.frombuffer(answers, np.uint8, size, at + 8))
            found[low:high] = bits[: high - low]
            at += 8 + size
        return found[self.name_of]


ASKED = "bucket int, block long, keys binary, more binary, ids binary, span binary"
#: A suffix's bucket follows from its first bytes.
PREFIX = 16


def _sample(length: int, low: int, high: int, buckets: int) -> Callable:
    """The names of a block's sample suffixes in the buckets low to high."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row["ids"], row["sizes"], row["data"])
            _, names = _sample_names(block, length, low, high, buckets)
            yield names.ask(row["block"])

    return sample


def _sample_names(block: Block, length: int, low: int, high: int, buckets: int) -> tuple[np.ndarray, Names]:
    period, cover = cover_of(length)
    depth = length - period + 1
    at, text = block.suffixes(depth, period, cover)
    prefix = hashes(block.data, at, PREFIX, 1)[0]
    if (low, high) != (0, buckets):
        bucket = _bucket(prefix, buckets)
        here = np.flatnonzero((bucket >= low) & (bucket < high))
        prefix, at, text = prefix[here], at[here], text[here]
    keys = _keys(prefix, hashes(block.data, at, depth, 2)[0])
    return at, Names.of(keys, keys[:0], block.ids[text], buckets)


def _ends(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest id from each start to the next."""
    if not len(starts):
        return ids, ids
    return np.minimum.reduceat(ids, starts), np.maximum.reduceat(ids, starts)


def _in_buckets(answer: Callable) -> Callable:
    """Sorts a task's buckets one after another; the answers to a block go out together."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, list[bytes]] = {}

        def settle(bucket: int, held: list[tuple[np.ndarray, ...]], blocks: list[np.ndarray], sizes: list[np.ndarray]) -> None:
            keys, more, ids, most = (np.concatenate(x) for x in zip(*held))
            order, starts = _groups(keys, more)
            least, _ = _ends(ids[order], starts)
            _, most = _ends((ids + most)[order], starts)
            counts = np.diff(np.append(starts, len(keys)))
            found = np.empty(len(keys), bool)
            found[order] = answer(ids[order], np.repeat(least, counts), np.repeat(most, counts))
            at = 0
            for block, size in zip(np.concatenate(blocks).tolist(), np.concatenate(sizes).tolist()):
                bits = np.packbits(found[at : at + size])
                if bits.any():
                    told.setdefault(block, []).append(np.array([bucket, len(bits)], np.int32).tobytes() + bits.tobytes())
                at += size

        held, blocks, sizes = [], [], []
        at = None
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            starts = _runs(buckets)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(buckets)]):
                if at is not None and buckets[a] != at:
                    settle(at, held, blocks, sizes)
                    held, blocks, sizes = [], [], []
                at = int(buckets[a])
                rows = batch.slice(a, b - a)
                held.append((_values(rows.column("keys")), _values(rows.column("more")), *(_values(rows.column(c), np.int64) for c in ("ids", "span"))))
                blocks.append(rows.column("block").to_numpy())
                sizes.append(np.diff(text_bytes(rows.column("ids"))[1]) // 8)
        if at is not None:
            settle(at, held, blocks, sizes)
        if told:
            values = [b"".join(found) for found in told.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(told), pa.int64()), pa.array(values, pa.binary())], ["block", "told"])

    return sort


def _rounds(blocks: DataFrame, entries: int, entry_bytes: int) -> tuple[int, int]:
    """(rounds, buckets): so many that what a task sorts in a round is bounded."""
    partitions = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, -(-entries * entry_bytes // (partitions * ROUND_BYTES)))
    return rounds, rounds * partitions * BUCKETS_IN_TASK


def _ask(blocks: DataFrame, rounds: int, buckets: int, ask: Callable, answer: Callable, shelf: Shelf) -> DataFrame:
    """block, told: the answers to what `ask(low, high, buckets)` asks of each block, one range of buckets after another."""
    per_round = buckets // rounds
    told = None
    for r in range(rounds):
        asked = blocks.mapInArrow(ask(r * per_round, (r + 1) * per_round, buckets), ASKED)
        dealt = asked.repartition(per_round // BUCKETS_IN_TASK, "bucket").sortWithinPartitions("bucket")
        found = shelf.put(dealt.mapInArrow(_in_buckets(answer), "block long, told binary"), release=True)
        told = found if told is None else told.unionByName(found)
    return told


def _with_answers(blocks: DataFrame, told: DataFrame) -> DataFrame:
    """Each block's answers, then the block itself."""
    columns = {c: F.lit(None).cast(blocks.schema[c].dataType) for c in blocks.columns if c != "block"}
    answers = told.withColumns(columns)
    whole = blocks.withColumn("told", F.lit(None).cast("binary"))
    # A null sorts first: answers have no ids, so they come before their block.
    return answers.unionByName(whole).repartition("block").sortWithinPartitions("block", F.col("ids").isNotNull())


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
    """(block, all its answers), from the rows of `_with_answers`."""
    told: list[bytes] = []
    for batch in batches:
        start = 0
        for i in np.flatnonzero(batch.column("ids").is_valid().to_numpy(zero_copy_only=False)).tolist():
            told += batch.slice(start, i - start).column("told").to_pylist()
            yield batch.slice(i, 1).to_pylist()[0], b"".join(told)
            told, start = [], i + 1
        told += batch.slice(start).column("told").to_pylist()


SURVIVORS = "block long, ids binary, sizes binary, names binary, data binary, runs binary, n long"


def _survivors(length: int, buckets: int) -> Callable:
    period, _ = cover_of(length)

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Suffixes that may be equal to one of another document in all their first bytes: a shift below the period leads
        both to sample suffixes of equal rank, so one without any shared sample suffix ahead ties with none."""
        for row, told in _met(batches):
            block = Block(row["ids"], row["sizes"], row["data"])
            at, names = _sample_names(block, length, 0, buckets, buckets)
            shared = at[names.told(told)]
            if not len(shared):
                continue
            ahead = np.zeros(len(block.data) + period, np.int8)
            ahead[shared] += 1  # the first place that the suffix is ahead of, moved on by period - 1
            ahead[shared + period] -= 1
            near = np.cumsum(ahead, dtype=np.int32)[period - 1 : -1] > 0
            left = np.repeat(block.ends, block.sizes) - np.arange(len(block.data))
            kept = near & (left >= length)
            texts = np.flatnonzero(np.logical_or.reduceat(kept, block.starts))
            if not len(texts):
                continue
            names = [row["names"][16 * t : 16 * t + 16] for t in texts.tolist()]
            pieces = [slice(int(block.starts[t]), int(block.ends[t])) for t in texts.tolist()]
            mask = np.concatenate([[False], *[kept[p] for p in pieces], [False]])
            runs = np.flatnonzero(mask[1:] != mask[:-1])  # start, end, start, end: the last suffixes of a text are too short
            arrays = [
                block.ids[texts].tobytes(),
                block.sizes[texts].tobytes(),
                b"".join(names),
                b"".join(block.data[p].tobytes() for p in pieces),
                runs.astype(np.int64).tobytes(),
            ]
            n = int((runs[1::2] - runs[::2]).sum())
            record = [pa.array([row["block"]]), *[pa.array([x], pa.binary()) for x in arrays], pa.array([n])]
            yield pa.RecordBatch.from_arrays(record, ["block", "ids", "sizes", "names", "data", "runs", "n"])

    return survivors


class Suffixes(Block):
    """A block's surviving suffixes, each with the id of its text."""

    def __init__(self, row: dict):
        super().__init__(row["ids"], row["sizes"], row["data"])
        runs = np.frombuffer(row["runs"], np.int64)
        sizes = runs[1::2] - runs[::2]
        self.places = np.arange(sizes.sum()) + np.repeat(runs[::2] - (np.cumsum(sizes) - sizes), sizes)
        owner = self.ids[np.searchsorted(self.ends, runs[::2], side="right")]
        self.owner = np.repeat(owner, sizes)

    def named(self, length: int, low: int, high: int, buckets: int) -> tuple[np.ndarray, Names]:
        """(places, their names) in the buckets low to high: 128 bits of the first `length` bytes."""
        at, owner = self.places, self.owner
        prefix = hashes(self.data, at, PREFIX, 3)[0]
        if (low, high) != (0, buckets):
            bucket = _bucket(prefix, buckets)
            here = np.flatnonzero((bucket >= low) & (bucket < high))
            prefix, at, owner = prefix[here], at[here], owner[here]
        whole, more = hashes(self.data, at, length, 4, 5)
        return at, Names.of(_keys(prefix, whole), more, owner, buckets)


def _named(length: int, low: int, high: int, buckets: int) -> Callable:
    """The names of a block's surviving suffixes in the buckets low to high."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield Suffixes(row).named(length, low, high, buckets)[1].ask(row["block"])

    return named


def _first_elsewhere(ids: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    return ids > least


def _in_several(ids: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    return least < most


REMOVED = "name binary, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string"


def _removed(length: int, buckets: int) -> Callable:
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What goes of each text: bytes in a suffix's first ones that stand in a document of smaller id, too."""
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for row, told in _met(batches):
            block = Suffixes(row)
            at, names = block.named(length, 0, buckets, buckets)
            # In a smaller document of another block, or of this one.
            repeated = names.told(told) | (block.owner > names.least[names.name_of])
            at = at[repeated]
            cover = np.zeros(len(block.data) + 1, np.int8)
            cover[at] += 1
            cover[at + length] -= 1
            gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
            counts = np.add.reduceat(gone.astype(np.int64), block.starts)
            names, totals, spans, shas = [], [], [], []
            for t in np.flatnonzero(counts).tolist():
                mask = gone[block.starts[t] : block.ends[t]]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                names.append(row["names"][16 * t : 16 * t + 16])
                totals.append(int(counts[t]))
                spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                shas.append(hashlib.sha256(block.data[block.starts[t] : block.ends[t]][~mask].tobytes()).hexdigest())
            if names:
                record = [pa.array(names, pa.binary()), pa.array(totals, pa.int64()), pa.array(spans, spans_type), pa.array(shas)]
                yield pa.RecordBatch.from_arrays(record, ["name", "n_removed", "spans", "kept_sha256"])

    return removed


def _name(text: Column) -> Column:
    return F.unhex(F.md5(text))


def repeated_strings(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, spans, kept_sha256.

    A byte of a text (UTF-8) goes if a string of `length` bytes that covers it also starts in a document with a smaller
    id; strings are judged on the input, and lie inside one text. Spans are the maximal runs that go (end exclusive);
    the hash is that of what is left. Ids are integers.

    Equal texts are sorted once, for the smallest of their ids; in rows of larger ids every byte goes. Rows that repeat an id are
    equals: neither takes from the other. A null id is after all others. A null text is empty, and texts shorter than
    `length` keep everything. An empty table gives no rows; other columns are ignored.

    Two suffixes that are equal in their first `length` bytes lead, by one shift below the period of a difference
    cover, to two sample suffixes that are equal to a known depth. So the sample (a quarter of all places for 50 bytes) is
    sorted first, and suffixes without a shared sample suffix ahead are out: they tie with none. The others are sorted
    by 128 bits of their first bytes. Both sorts run one range of buckets at a time, as many rounds as bound what a task
    sorts; inside a block equal suffixes are one entry, so a string that a third of all documents share counts once a
    block.
    """
    shelf = Shelf(docs.sparkSession, "suffixes")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = source.groupBy("text").agg(F.min("id").alias("first_id"), (F.count(F.lit(1)) > 1).alias("copied"))
    texts = texts.select("first_id", _name(F.col("text")).alias("name"), "copied", F.col("text").cast("binary").alias("text"))
    blocks = shelf.put(texts.mapInArrow(_blocks(length), BLOCK), release=True)
    copies = shelf.put(blocks.select("ids", "names", "copied").mapInArrow(_copied, "name binary, first_id long"))
    blocks = blocks.drop("copied")
    period, cover = cover_of(length)
    size = blocks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    rounds, buckets = _rounds(blocks, size * len(cover) // period, 16)
    told = _ask(blocks, rounds, buckets, lambda *where: _sample(length, *where), _in_several, shelf)
    survivors = shelf.put(_with_answers(blocks, told).mapInArrow(_survivors(length, buckets), SURVIVORS), release=True)
    shelf.keep(survivors, copies)
    left = survivors.agg(F.sum("n")).first()[0] or 0
    rounds, buckets = _rounds(survivors, left, 24)
    told = _ask(survivors, rounds, buckets, lambda *where: _named(length, *where), _first_elsewhere, shelf)
    gone = shelf.put(_with_answers(survivors, told).mapInArrow(_removed(length, buckets), REMOVED), release=True)
    shelf.keep(gone, copies)
    rows = source.select("id", F.octet_length("text").cast("long").alias("n_bytes"), _name(F.col("text")).alias("name"), F.sha2("text", 256).alias("sha"))
    of_text = copies.join(gone, "name", "full_outer").withColumnRenamed("name", "of")
    known = rows.join(of_text, F.col("name") == F.col("of"), "left")
    # A row without an id comes after one with an id.
    later = (F.col("first_id") < F.col("id")) | (F.col("first_id").isNotNull() & F.col("id").isNull())
    whole = F.coalesce(later, F.lit(False)) & (F.col("n_bytes") >= length)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    nothing = F.array().cast("array<struct<start: long, end: long>>")
    spans = F.when(whole, everything).otherwise(F.coalesce("spans", nothing))
    return known.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        spans.alias("spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
