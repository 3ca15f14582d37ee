import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from civiclens.llm import bpe, packing
from tests.llm.conftest import EDGE_ROWS

ALPHABET = ["a", "b", "the", "'", "s", "'re", "'s", "!", "?", " ", "  ", "\n", "\t", "\xa0", "\x1c", "e\u0301", "İ", "Σ", "😀", "漢", "1",
            "22", "<|endoftext|>", "<|startoftext|>", "_", "\u0300", "-", "\u2003", "ß", "aaaa", "\r\n"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tree_equals_library(name):
    enc = bpe.Encoder(public_tokenizers.path(name))
    rnd = random.Random(3)
    for _ in range(1500):
        some = rnd.sample(ALPHABET, rnd.choice([2, 3, 5, 12, len(ALPHABET)]))
        text = "".join(rnd.choice(some) for _ in range(rnd.choice([3, 8, 30, 80])))
        want = enc.tokenizer.encode(text, add_special_tokens=False).ids
        for leaf, window in ((1, 1), (7, 4), (16, 8), (10**6, 8)):
            ids = np.frombuffer(bpe.tree_encode(enc, text, leaf, window), dtype="<u4")
            assert ids.tolist() == want, (text, leaf, window)
        assert enc.decode(np.asarray(want)) == enc.tokenizer.decode(want, skip_special_tokens=False)
    long = "abcé" * 9000  # one chunk without a place to split
    for leaf in (512, 8192):
        assert np.frombuffer(bpe.tree_encode(enc, long, leaf), dtype="<u4").tolist() == enc.tokenizer.encode(long, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_new_words_of_many_texts_are_encoded_together(name, monkeypatch):
    enc = bpe.Encoder(public_tokenizers.path(name))
    rnd = random.Random(5)
    for some in [ALPHABET, *(rnd.sample(ALPHABET, rnd.choice([3, 6, 12])) for _ in range(60))]:
        texts = ["".join(rnd.choice(some) for _ in range(rnd.choice([0, 3, 30, 200]))) for _ in range(40)]
        enc.learn(texts)
        for t in texts:
            assert np.frombuffer(bpe.tree_encode(enc, t), dtype="<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t
    calls = []
    encoded = enc._encoded
    monkeypatch.setattr(enc, "_encoded", lambda texts: calls.append(len(texts)) or encoded(texts))
    texts = [f"first{i} " + " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(20)) for i in range(50)]
    enc.learn(texts)
    for t in texts:
        assert np.frombuffer(bpe.tree_encode(enc, t), dtype="<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
    assert 0 < len(calls) <= 4 and sum(calls) >= 1000


def test_documents_match_library(edge, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = bpe.encode_documents(edge, path, digests=True).collect()
    want = []
    for r in EDGE_ROWS:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert bpe.encode_documents(none, path).collect() == []


def filled(plan):
    bins = np.zeros(packing.sequences(plan), dtype=int)
    ends = bins.copy()
    for length, _, n, first, offset in plan:
        bins[first : first + n] += length
        ends[first : first + n] = np.maximum(ends[first : first + n], offset + length)
    assert (bins == ends).all()  # gapless
    return bins


def test_plan_places_all_once():
    rnd = random.Random(5)
    for _ in range(60):
        capacity = rnd.choice([5, 16, 64])
        counts = {k: rnd.randint(0, 9) for k in range(1, capacity + 1) if rnd.random() < 0.5}
        plan = packing.plan_packing(counts, capacity)
        assert filled(plan).max(initial=0) <= capacity
        for k, n in counts.items():
            at = 0
            for _, rank, m, _, _ in sorted(p for p in plan if p[0] == k):
                assert rank == at
                at += m
            assert at == n


def test_plan_is_tight():
    assert packing.sequences(packing.plan_packing({700: 1000, 400: 10})) == 1005
    assert packing.sequences(packing.plan_packing({512: 100, 256: 200})) == 100
    rng = np.random.default_rng(0)
    lengths, n = np.unique(rng.integers(1, 1025, 50_000), return_counts=True)
    plan = packing.plan_packing(dict(zip(lengths.tolist(), n.tolist())))
    assert packing.sequences(plan) <= 1.01 * (lengths * n).sum() / 1024


def test_packed_documents(edge, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = packing.pack_documents(edge, path, 2).toPandas()
    want = []
    for r in EDGE_ROWS:
        ids = np.asarray([*lib.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for piece, (s, n) in enumerate(packing.cut_points(len(ids), 1024)):
            want.append((-1 if r[0] is None else r[0], piece, s, n, zlib.crc32(ids[s : s + n].tobytes())))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    have = got[cols].fillna({"doc_id": -1}).astype("int64")
    assert sorted(map(tuple, have.to_numpy().tolist())) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 1024
    assert packing.pack_documents(none, path, 2).count() == 0


def test_many_texts_at_once_give_the_librarys_ids():
    """The batch encoder alone, on every rule of the splitting; no word is kept."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, rng = bpe.Encoder(path), random.Random(11)
    assert enc.batch is not None
    letters = "ab'stmdrevl S\n\t\r \u0085 　1½Ⅷ!_-é漢字\U0001d4b3\U0001f600́‍ßǅ\x00\x1c<"
    runs = ["'s", "'ll", "'re", "'t", "  ", "\r\n", "the ", "<|endoftext|>", "x" * 40, " " * 40]
    for _ in range(300):
        texts = ["".join(rng.choice(runs if rng.random() < 0.2 else letters) for _ in range(rng.randrange(60))) for _ in range(4)]
        assert enc.many(texts) == [np.asarray(enc.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    words = [f"w{i}{'abc' * (i % 7)}," for i in range(3000)]
    before = len(enc.rest)
    enc.many([" ".join(words)])
    assert len(enc.rest) == before
