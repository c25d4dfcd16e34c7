"""SentencePiece encoding by sampling (forward filtering, backward sampling over the piece lattice), and decoding.

The lattice of a text falls apart where no piece crosses: before each run of the space mark and around characters that
no longer piece holds. Such units ("words") repeat, so forward sums are made once for each different word of a batch
and every occurrence is then sampled backwards from them, all occurrences at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.llm.arrowtext import mixed, parts, text_bytes
from cashlens.llm.shelf import Shelf

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose lattice is held at once: edges, forward sums and draws take over a hundred times as much.
LATTICE_BYTES = 256 << 10
MARK = "▁"
_MARK = MARK.encode()


class Vocabulary:
    """Pieces as byte strings with log weights, and a trie over them as one table (node, byte) -> node.

    A BPE model states ranks, not probabilities: piece r of the merge order weighs 1 / (r + 3), Zipf's law. `theta` is
    the smoothing exponent of the sampling. A character without a piece of its own is spelt in byte pieces, and so is
    the space mark itself, which would otherwise decode to a space.
    """

    def __init__(self, model: str, theta: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = sp.get_piece_size()
        self.bytes = [b""] * self.size  # what each id decodes to
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.log_weight = np.full(self.size, -30.0)
        words: dict[bytes, int] = {}
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[i] = bytes([int(piece[3:5], 16)])
                self.byte_ids[self.bytes[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.bytes[i] = piece.replace(MARK, " ").encode()
                self.log_weight[i] = -theta * np.log(max(-sp.get_score(i), 0) + 3)
                # Space marks are spaces in the lattice; a space is never anything else there.
                words[self.bytes[i]] = i
        alphabet = sorted({b for w in words for b in w})
        self.column = np.full(256, len(alphabet), dtype=np.int64)
        self.column[alphabet] = np.arange(len(alphabet))
        self.width = len(alphabet) + 1
        nodes: list[dict[int, int]] = [{}]
        ids = [-1]
        for word, i in words.items():
            at = 0
            for b in word:
                if b not in nodes[at]:
                    nodes[at][b] = len(nodes)
                    nodes.append({})
                    ids.append(-1)
                at = nodes[at][b]
            ids[at] = i
        self.child = np.zeros((len(nodes), self.width), dtype=np.int32)  # 0: none, as no piece leads back to the root
        for at, children in enumerate(nodes):
            for b, to in children.items():
                self.child[at, self.column[b]] = to
        self.id_at = np.array(ids, dtype=np.int32)
        self.single = {w.decode() for w in words if len(w.decode("utf-8", "ignore")) == 1}
        self.decoded = pa.array(self.bytes, pa.binary())


@lru_cache(maxsize=2)
def vocabulary(model: str, theta: float) -> Vocabulary:
    return Vocabulary(model, theta)


class Lattice:
    """Lattice edges of different words, sorted by end, with what backward sampling needs.

    Nodes are byte positions; a node of a word is its start in `data` plus the position plus the word's number, as a
    word of n bytes has n + 1 nodes. `first[node]` is the node's first edge; `upto[edge]` the cumulated probability
    among the edges that end at the node.
    """

    def __init__(self, vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray):
        lengths = np.diff(offsets)
        word = np.repeat(np.arange(len(lengths)), lengths)
        column = vocab.column[data]
        limit = np.repeat(offsets[1:], lengths)
        starts, ends, ids = [], [], []
        at = np.arange(len(data))
        node = vocab.child.reshape(-1)[column]
        depth = 1
        while len(at := at[keep := node > 0]):
            node = node[keep]
            found = vocab.id_at[node]
            hit = found >= 0
            starts.append(at[hit])
            ends.append(at[hit] + depth)
            ids.append(found[hit])
            inside = at + depth < limit[at]
            at, node = at[inside], node[inside]
            node = vocab.child.reshape(-1)[node.astype(np.int64) * vocab.width + column[at + depth]]
            depth += 1
        start, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, ids))
        # Characters without a piece: byte edges along them. The first byte tells the character's length.
        head = (data & 0xC0) != 0x80
        number = np.cumsum(head) - 1
        heads = np.append(np.flatnonzero(head), len(data))
        size = np.diff(heads)
        have = np.zeros(len(size), dtype=bool)
        whole = end - start == size[number[start]] if len(start) else np.zeros(0, dtype=bool)
        have[number[start[whole & head[start]]]] = True
        bare = np.flatnonzero(~have[number]) if len(size) else np.zeros(0, np.int64)
        start = np.concatenate([start, bare]).astype(np.int64)
        end = np.concatenate([end, bare + 1]).astype(np.int64)
        piece = np.concatenate([piece, vocab.byte_ids[data[bare]]]).astype(np.int64)
        # Longer pieces first at each end, which makes the search in `sample` short.
        order = np.lexsort((start, end))
        start, end, piece = start[order], end[order], piece[order]
        own = word[start]
        self.piece = piece
        self.source = start + own
        target = end + own
        nodes = len(data) + len(lengths)
        count = np.bincount(target, minlength=nodes)
        self.first = np.concatenate([[0], np.cumsum(count)])[:-1]
        self.origin = offsets[:-1] + np.arange(len(lengths))
        self.final = offsets[1:] + np.arange(len(lengths))
        # Forward sums, for all words at once, by distance from the word's start.
        alpha = np.full(nodes, -np.inf)
        alpha[self.origin] = 0.0
        weight = vocab.log_weight[piece]
        reach = end - offsets[own]
        by_reach = np.argsort(reach, kind="stable")
        borders = np.flatnonzero(np.diff(reach[by_reach], prepend=-1, append=-1))
        value = np.empty(len(piece))
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            edges = by_reach[a:b]
            value[edges] = alpha[self.source[edges]] + weight[edges]
            to = target[edges]
            new = np.flatnonzero(np.diff(to, prepend=-1))
            alpha[to[new]] = np.logaddexp.reduceat(value[edges], new)
        share = np.exp(value - alpha[target]) if len(piece) else value
        total = np.cumsum(share)
        before = np.where(self.first[target] > 0, total[np.maximum(self.first[target] - 1, 0)], 0.0) if len(piece) else total
        self.upto = total - before
        if len(piece):
            self.upto[np.flatnonzero(np.diff(target, append=-1))] = 2.0  # the last edge of a node takes what rounding leaves

    def sample(self, words: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all occurrences in order, number of pieces of each). `state`: 64 random bits for each occurrence."""
        node = self.final[words].copy()
        active = np.flatnonzero(node > self.origin[words])
        who, what = [], []
        step = 0
        while len(active):
            step = (step + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
            draw = (mixed(state[active] + np.uint64(step)) >> np.uint64(11)) * 2.0**-53
            edge = self.first[node[active]]
            search = np.flatnonzero(draw >= self.upto[edge])
            while len(search):
                edge[search] += 1
                search = search[draw[search] >= self.upto[edge[search]]]
            who.append(active)
            what.append(self.piece[edge])
            node[active] = self.source[edge]
            active = active[node[active] > self.origin[words[active]]]
        count = np.zeros(len(words), dtype=np.int64)
        for at in who:
            count[at] += 1
        end = np.cumsum(count)
        out = np.empty(int(end[-1]) if len(end) else 0, dtype=np.int32)
        for back, (at, pieces) in enumerate(zip(who, what), 1):
            out[end[at] - back] = pieces
        return out, count


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, bounds) of the units that no piece crosses: a run of spaces with what follows it; a line break alone."""
    n = len(data)
    space, line = data == 32, data == 10
    start = space.copy()
    start[1:] &= ~space[:-1]
    start |= line
    start[1:] |= line[:-1]
    inside = offsets[(offsets >= 0) & (offsets < n)]
    start[inside] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, offsets)


def encode_rows(vocab: Vocabulary, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of sampled segmentations. `keys`: 64 bits for each row; equal keys and texts give equal ids."""
    raw, ends = text_bytes(texts)
    # A space before each text that isn't empty, as the model was trained; decoding takes it away again.
    filled = np.diff(ends) > 0
    offsets = ends + np.concatenate([[0], np.cumsum(filled)])
    data = np.full(offsets[-1], 32, dtype=np.uint8)
    shift = np.repeat(np.cumsum(filled), np.diff(ends))
    data[np.arange(len(raw)) + shift] = raw
    starts, bounds = cut_words(data, offsets)
    limits = np.append(starts, len(data)).astype(np.int64)
    occurrences = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(np.ascontiguousarray(limits)), pa.py_buffer(data)]
    )
    coded = occurrences.dictionary_encode()
    words = coded.indices.to_numpy().astype(np.int64)
    lattice = Lattice(vocab, *text_bytes(coded.dictionary))
    per_row = np.diff(bounds)
    place = np.arange(len(starts)) - np.repeat(bounds[:-1], per_row)
    state = mixed(np.repeat(keys, per_row) + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    ids, count = lattice.sample(words, state)
    total = np.concatenate([[0], np.cumsum(count)])
    return ids, total[bounds]


def decode_rows(vocab: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts: what the pieces stand for, joined, without the space before."""
    pieces = vocab.decoded.take(pa.array(ids)).cast(pa.large_binary())
    data, ends = text_bytes(pieces)
    limits = ends[offsets]
    skip = (np.diff(limits) > 0).astype(np.int64)
    values = [data[a:b].tobytes() for a, b in zip((limits[:-1] + skip).tolist(), limits[1:].tolist())]
    return pa.array(values, pa.large_binary()).cast(pa.large_string())


def row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    values = ids.cast(pa.int64()).fill_null(-(1 << 62)).to_numpy().astype(np.uint64)
    return mixed(values + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def _local(model: str) -> str:
    """Where a task finds the model: the shipped file, or the path itself."""
    import os

    shipped = os.path.join(SparkFiles.getRootDirectory(), os.path.basename(model))
    return shipped if os.path.exists(shipped) else model


def _encode(model: str, theta: float, seed: int) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(_local(model), theta)
        for batch in batches:
            for part in parts(iter([batch]), "text", LATTICE_BYTES):
                texts = part.column("text")
                ids, offsets = encode_rows(vocab, texts, row_keys(part.column("id"), seed))
                back = decode_rows(vocab, ids, offsets)
                same = pc.equal(back, texts.cast(pa.large_string()).fill_null(""))
                rows = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                kept = [part.column(c) for c in part.schema.names if c != "text"]
                names = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*kept, rows, same], [*names, "ids", "lossless"])

    return encode


def _decode(model: str, theta: float) -> Callable:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(_local(model), theta)
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            offsets = lists.offsets.to_numpy().astype(np.int64)
            texts = decode_rows(vocab, lists.flatten().to_numpy(), offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column("id"), texts.cast(pa.string())], ["id", "text"])

    return decode


def _ship(df: DataFrame, model: str) -> None:
    Shelf(df.sparkSession, "pieces")
    context = df.sparkSession.sparkContext
    if not any(f.endswith("/" + model.rsplit("/", 1)[-1]) for f in context.listFiles):
        context.addFile(model)


def encode(
    docs: DataFrame,
    model: str = MODEL,
    theta: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, the columns of `keep`, ids (array of int), lossless, n_pieces.

    A segmentation is drawn with probability in proportion to the product of its pieces' weights to the power `theta`:
    forward sums over the lattice of each word, then pieces drawn from the end. Draws depend on the id, the seed and the
    word's place only, so a rerun, another partitioning, or a repeated row gives the same pieces. `lossless` says that
    decoding gave the text back. A word is one lattice however long it is; its forward sums take one step for each of its
    bytes. Null and empty texts have no pieces; a null id is a key like any other. An empty table
    gives no rows; columns beyond those named are ignored.
    """
    _ship(docs, model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).alias(f"keep_{c}") for c in keep], F.col(text_col).alias("text"))
    shape = ", ".join(f"`{name}` {kind}" for name, kind in rows.drop("text").dtypes) + ", ids array<int>, lossless boolean"
    coded = rows.mapInArrow(_encode(model, theta, seed), shape)
    return coded.select(
        F.col("id").alias(id_col), *[F.col(f"keep_{c}").alias(c) for c in keep], "ids", "lossless", F.size("ids").cast("long").alias("n_pieces")
    )


def decode(coded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each row of ids. Null ids give an empty text."""
    _ship(coded, model)
    rows = coded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(model, 1.0), "id long, text string").select(F.col("id").alias(id_col), "text")
