from collections import Counter
from itertools import product
from math import exp

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from cashlens.llm import pieces
from tests_llm_util import SMALL, documents

THETA = 0.2


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(pieces.MODEL, THETA)


def segmentations(vocab, word: str) -> dict[tuple[int, ...], float]:
    """All segmentations of a word (with its space) and their probabilities, by trying every set of borders."""
    known = {b: i for i, b in enumerate(vocab.bytes) if vocab.log_weight[i] > -30 or b.strip() == b""}
    out = {}
    for cuts in product([0, 1], repeat=len(word) - 1):
        borders = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b].encode() for a, b in zip(borders, borders[1:])]
        if all(p in known for p in parts):
            ids = tuple(known[p] for p in parts)
            out[ids] = exp(sum(vocab.log_weight[i] for i in ids))
    total = sum(out.values())
    return {ids: w / total for ids, w in out.items()}


def test_sampled_frequencies_match_the_lattice(vocab):
    want = segmentations(vocab, " hello")
    n = 40_000
    ids, offsets = pieces.encode_rows(vocab, pa.array(["hello"] * n), pieces.row_keys(pa.array(range(n)), 1))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:]))
    assert set(seen) <= set(want) and len(want) > 8
    for segmentation, p in want.items():
        assert abs(seen[segmentation] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab \n\t▁é日𠀀\x00"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=5))
def test_lossless(texts):
    vocab = pieces.vocabulary(pieces.MODEL, THETA)
    ids, offsets = pieces.encode_rows(vocab, pa.array(texts), pieces.row_keys(pa.array(range(len(texts))), 0))
    assert pieces.decode_rows(vocab, ids, offsets).to_pylist() == texts


def test_library_decodes_the_same(vocab):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["Hello  world, ça va?", " lead", "a\nb\n", "日本𠀀", "x" * 50]
    ids, offsets = pieces.encode_rows(vocab, pa.array(texts), pieces.row_keys(pa.array(range(5)), 0))
    assert [sp.decode(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:])] == texts


def test_edges_and_reruns(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "word " * 30_000), (5, "y" * 200_000), (6, "same"), (6, "same"), (None, "n▁m"), (7, "\r\n\t")]
    docs = documents(spark, rows)
    found = pieces.encode(docs, keep=("source",))
    coded = sorted(map(repr, found.collect()))
    assert len(coded) == len(rows) and all(r.lossless and r.n_pieces == len(r.ids) for r in found.collect())
    assert coded == sorted(map(repr, pieces.encode(docs.repartition(5), keep=("source",)).collect()))
    assert len({tuple(r.ids) for r in found.filter("doc_id = 6").collect()}) == 1
    back = pieces.decode(found)
    assert sorted(repr(tuple(r)) for r in back.collect()) == sorted(repr((i, t or "")) for i, t in rows)
    other = pieces.encode(docs, seed=1).filter("doc_id = 4").first()
    assert other.ids != found.filter("doc_id = 4").first().ids
    assert pieces.encode(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    coded = pieces.encode(docs)
    assert coded.filter("lossless").count() == docs.count()
    texts = {r.doc_id: r.text for r in pieces.decode(coded).collect()}
    assert texts == {r.doc_id: r.text for r in docs.collect()}


def test_long_words_are_one_lattice(vocab):
    """A piece crosses any place of a long word as often as it crosses that place's copies in the middle of others."""
    word = "therefore" * 9000
    data = np.frombuffer((" " + word).encode(), np.uint8)
    starts, _ = pieces.cut_words(data, np.array([0, len(data)]))
    assert starts.tolist() == [0]
    ids, offsets = pieces.encode_rows(vocab, pa.array([word, "é日" * 40_000]), np.arange(2, dtype=np.uint64))
    assert pieces.decode_rows(vocab, ids, offsets).to_pylist() == [word, "é日" * 40_000]
    ends = np.cumsum([len(vocab.bytes[i]) for i in ids[: offsets[1]].tolist()])
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    # 65,536 bytes is where words were once cut: now borders there are no likelier than at the same letter elsewhere.
    share = cut[65536 % 9 + 9 * 100 : -900 : 9].mean()
    assert 0 < share < 1
    near = [cut[65536 + 9 * k] for k in range(-40, 41)]
    assert abs(np.mean(near) - share) < 0.25


def test_forward_sums_of_a_long_word(vocab):
    """The chances with which pieces end at a place are those of an exact sum over all segmentations up to it."""
    word = " " + "abab" * 40
    lattice = pieces.Lattice(vocab, np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]))
    weight = {p: np.exp(w) for p, w in zip(vocab.bytes, vocab.log_weight) if w > -30 and p}
    total = [1.0]
    for end in range(1, len(word) + 1):
        total.append(sum(total[a] * weight.get(word[a:end].encode(), 0.0) for a in range(max(0, end - 20), end)))
    for node in range(1, len(word) + 1):
        a, b = lattice.first[node], lattice.first[node + 1] if node < len(word) else len(lattice.piece)
        shares = np.diff(np.concatenate([[0.0], lattice.upto[a:b]]))[:-1]
        for edge, share in zip(range(a, b), shares):
            assert share == pytest.approx(total[lattice.source[edge]] * np.exp(vocab.log_weight[lattice.piece[edge]]) / total[node], rel=1e-6, abs=1e-9)


def test_lattices_hold_little_text(vocab, monkeypatch):
    """Edges and forward sums are held for a bounded run of rows, whose pieces are those of all rows together."""
    texts = [f"words of row {n} " * 40 for n in range(2000)]
    batch = pa.record_batch([pa.array(range(2000), pa.int64()), pa.array(texts)], ["id", "text"])
    want, offsets = pieces.encode_rows(vocab, batch.column("text"), pieces.row_keys(batch.column("id"), 0))
    held = []
    encode_rows = pieces.encode_rows
    monkeypatch.setattr(pieces, "encode_rows", lambda v, part, keys: held.append(sum(map(len, part.to_pylist()))) or encode_rows(v, part, keys))
    monkeypatch.setattr(pieces, "_local", lambda model: model)
    out = pa.Table.from_batches(pieces._encode(pieces.MODEL, THETA, 0)(iter([batch])))
    assert max(held) <= 256 << 10 and sum(held) == sum(map(len, texts))
    got = out.column("ids").to_pylist()
    assert got == [want[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert out.column("lossless").to_pylist() == [True] * 2000
