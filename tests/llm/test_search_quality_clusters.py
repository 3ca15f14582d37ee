import hashlib
import math
import random
import re

import numpy as np
import pandas as pd
import pytest

from civiclens.llm import nbsvm, ns_bounds, presence_masks
from tests.llm.conftest import EDGE_ROWS

SF = "/root/testdata/sf0.001"
BIG = [2**53 + 1, 2**53 + 3, -(2**63), 2**63 - 1]


# ------------------------------------------------------------------ quality

def junk_and_prose(n, seed):
    rnd = random.Random(seed)
    syllables = ["an", "er", "th", "in", "on", "ed", "re", "st", "ou", "ha"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(5, 200))]
        if i % 5 == 0:
            kind = rnd.randrange(3)
            words = [w for w in words[:40] for _ in range(4)] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [w + rnd.choice(["***", "###"]) for w in words]
        texts.append(" ".join(words))
        labels.append(int(i % 5 != 0))
    return texts, labels


def test_quality_held_out():
    texts, labels = junk_and_prose(900, 1)
    model = nbsvm.train(texts[:500], labels[:500])
    indicators = nbsvm.Indicators()
    right = [(model.score(indicators(t)) >= 0.3) == bool(y) for t, y in zip(texts[500:], labels[500:])]
    assert np.mean(right) > 0.97


def test_indicators_are_the_distinct_grams_of_the_whole_text():
    indicators = nbsvm.Indicators()
    one = indicators("ab ab")
    assert len(one) == len(set(one.tolist()))
    # bytes: 3 + 3 + 3 + 2 distinct grams; shapes: a, a again, the pair of both
    assert len(one) == 11 + 3
    assert set(indicators("ab ab ab").tolist()) >= set(one.tolist())
    assert len(indicators("")) == 0 and len(indicators("x")) == 2
    long = "abc " * 400_000 + "Q#"
    assert set(indicators("bc Q#").tolist()) - set(indicators(long).tolist()) <= set(indicators("bc Q#").tolist())
    assert set(indicators("Q#").tolist()) <= set(indicators(long).tolist())  # past the first part that is hashed
    assert indicators("ab ab").tolist() == one.tolist()


def test_shapes():
    assert [nbsvm.shape(w) for w in ("Hello", "WORLD!!", "a1b22", "###", "é")] == ["Aa", "A!", "a0a0", "#", "a"]


def test_dual_coordinate_descent_closes_the_duality_gap():
    texts, labels = junk_and_prose(120, 2)
    y = np.asarray(labels)
    indicators = nbsvm.Indicators()
    rows = [indicators(t) for t in texts]
    ratios = nbsvm.log_count_ratios(rows, y)
    values = [ratios[r] / len(r) ** 0.5 for r in rows]
    w, bias, alpha = nbsvm.descend(rows, values, y, cost=0.5)
    s = np.where(y == 1, 1.0, -1.0)
    loss = sum(max(0.0, 1 - a * (w[r] @ v + bias)) for r, v, a in zip(rows, values, s))
    half = 0.5 * (w @ w + bias * bias)
    assert ((alpha >= 0) & (alpha <= 0.5)).all()
    primal, dual = half + 0.5 * loss, alpha.sum() - half
    assert dual <= primal + 1e-9 and primal - dual < 0.01 * primal


def test_log_count_ratios():
    rows = [np.array([1, 2]), np.array([2]), np.array([3])]
    r = nbsvm.log_count_ratios(rows, np.array([1, 1, 0]))
    total = nbsvm.BUCKETS
    assert r[2] == pytest.approx(math.log((3 / (total + 3)) / (1 / (total + 1))))
    assert r[3] == pytest.approx(math.log((1 / (total + 3)) / (2 / (total + 1))))


def test_quality_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = nbsvm.fit(edge, labels, held_out=None)
    rows = nbsvm.score_documents(edge, model).collect()
    assert len(rows) == len(EDGE_ROWS) and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (3, 4)}
    assert len(empty) == 1  # NULL and empty texts score alike
    assert all(r.score == 0 for r in nbsvm.score_documents(edge, nbsvm.fit(edge, labels.limit(0))).collect())
    good = labels.where("quality = 1")
    assert all(r.score == 1 for r in nbsvm.score_documents(edge, nbsvm.fit(edge, good, held_out=None)).collect())
    assert nbsvm.score_documents(none, model).count() == 0
    assert nbsvm.fit(none, labels).constant == 0


def test_scores_keep_ids(spark):
    docs = spark.createDataFrame([(i, "some text") for i in [*BIG, None]], "doc_id long, text string").coalesce(1)
    ids = [r.doc_id for r in nbsvm.score_documents(docs, nbsvm.train([], [])).collect()]
    assert sorted(ids, key=str) == sorted([*BIG, None], key=str)


# ------------------------------------------------------------------- search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_ranks(docs, items, k):
    words = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs = sum(1 for _, w in words if w)
    n_terms = sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, w in words:
            score = 0
            for t in set(TERM.findall((text or "").translate(LOWER))):
                if t in w:
                    m = 100 - 90 + (90 * len(w) * n_docs) // n_terms
                    tf = w.count(t)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r, None if z else i, -s) for r, (s, z, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def search_fixture(seed, n, vocabulary, longest):
    rnd = random.Random(seed)
    words = [f"w{i}" if i % 7 else f"Äß{i}" for i in range(vocabulary)]
    pick = lambda: words[min(int(rnd.expovariate(8 / vocabulary)), vocabulary - 1)]
    docs = [(i, "".join(pick() + rnd.choice([" ", ", ", "-", "_", "\n"]) for _ in range(rnd.randint(0, longest)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .\t"), (None, "w1 w2 w1"), *[(n + 10 + i, "w1 W2 w3") for i in range(30)], (n + 10, "w1 W2 w3")]
    items = [(i, " ".join(pick() for _ in range(rnd.randint(1, 12)))) for i in range(12)] + [(50, None), (51, "nowhere"), (52, " ".join(words))]
    return docs, items


@pytest.mark.parametrize("seed,vocabulary", [(1, 30), (2, 150), (3, 400)])
def test_ranks_equal_brute_force(spark, monkeypatch, seed, vocabulary):
    docs, items = search_fixture(seed, 400, vocabulary, 40)
    expected = brute_ranks(docs, items, 5)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = presence_masks.rank_documents(d, q, k=5).collect()
    assert sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in got], key=str) == expected
    monkeypatch.setattr(presence_masks, "ITEM_BYTES", 100)  # several shards of items
    got = presence_masks.rank_documents(d, q, k=5).collect()
    assert sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in got], key=str) == expected


def test_masks_are_left_unscored():
    rnd = random.Random(4)
    n = 2000
    doc, term, gain = [], [], []
    for i in range(n):
        doc.append(i), term.append(0), gain.append(rnd.randint(1, 5))  # a term of nearly no weight everywhere
        if i % 100 == 0:
            doc.append(i), term.append(1), gain.append(rnd.randint(900, 1000))
    block = presence_masks.Block(np.array(doc), np.array(term), np.array(gain), n, 2)
    best = presence_masks.Best(10)
    scored = block.rank(np.array([0, 1]), best, lambda i: (False, i, 0, 0))
    assert len(best.rows) == 10 and scored == 20


def test_block_of_many_words_of_masks():
    rnd = np.random.default_rng(5)
    held = rnd.random((130, 300)) < 0.3  # masks of more than two words
    term, doc = np.nonzero(held)
    gain = rnd.integers(1, 50, len(term))
    whole = np.zeros(held.shape, dtype=np.int64)
    whole[term, doc] = gain
    block = presence_masks.Block(doc, term, gain, 300, 130)
    best = presence_masks.Best(7)
    block.rank(np.arange(130), best, lambda i: (False, i, 0, 0))
    expected = sorted([(int(s), (False, i, 0, 0)) for i, s in enumerate(whole.sum(0))], key=lambda r: (-r[0], r[1]))[:7]
    assert best.rows == expected


def test_search_edges(spark, edge, none):
    items = spark.createDataFrame([(1, "Fox BRIDGE"), (1, "fox"), (None, "night 42"), (3, "")], "item_id long, text string")
    rows = presence_masks.rank_documents(edge, items, k=3).collect()
    assert [r.doc_id for r in sorted((r for r in rows if r.item_id is None), key=lambda r: r.rank)] == [6, 1, 2]
    assert len([r for r in rows if r.item_id == 1]) == 6  # each row of items is an item
    assert presence_masks.rank_documents(none, items).count() == 0
    assert presence_masks.rank_documents(edge, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score", "scored"]
    big = spark.createDataFrame([(i, "fox") for i in [*BIG, None]], "doc_id long, text string").coalesce(1)
    got = presence_masks.rank_documents(big, items.where("text = 'fox'")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [*sorted(BIG), None]


# ----------------------------------------------------------------- clusters

def brute_clusters(vectors, k, rounds):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in start]
    history = []
    for t in range(rounds + 1):
        at = [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for _, v in kept]
        if t == rounds:
            break
        for j in range(len(c)):
            mine = [v for (_, v), (_, a) in zip(kept, at) if a == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
        history.append([list(v) for v in c])
    inertia = {}
    for d, j in at:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(
        (str(i), j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at)
    )


def as_rows(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("seed,n,k,dims,rounds", [(0, 300, 7, 3, 5), (1, 400, 25, 4, 8), (2, 60, 40, 2, 5), (3, 20, 40, 2, 3), (4, 50, 4, 3, 0)])
def test_clusters_equal_brute_force(spark, seed, n, k, dims, rounds):
    rnd = random.Random(seed)
    vectors = [(i, [round(rnd.gauss(i % 5, 0.4), 2) for _ in range(dims)]) for i in range(n)]
    vectors += [(n + i, vectors[0][1]) for i in range(20)] + [(None, vectors[1][1]), (5, vectors[2][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    got = ns_bounds.cluster_vectors(df, k=k, rounds=rounds, dims=dims)
    assert as_rows(got) == brute_clusters(vectors, k, rounds)


def test_bounds_spare_most_distances():
    rnd = np.random.default_rng(0)
    centres = rnd.integers(-4000, 4000, (40, 16))
    v = centres[rnd.integers(0, 40, 3000)] + rnd.integers(-200, 200, (3000, 16))
    c = v[:40].copy()
    history, state = c[None], None
    for t in range(12):
        bounds = ns_bounds.Bounds(history)
        state = bounds.assign(v, *(state or bounds.first(len(v))))
        exact = ns_bounds.squared(v, history[-1])
        assert (state[0] == exact.argmin(1)).all()
        new = history[-1].copy()
        for j in range(40):
            if (state[0] == j).any():
                new[j] = v[state[0] == j].sum(0) // int((state[0] == j).sum())
        history = np.concatenate([history, new[None]])
    assert state[5].sum() < 0.35 * 12 * 40 * len(v)


def test_total_displacement_is_no_more_than_the_summed_drifts():
    history = np.asarray([[[0, 0]], [[30, 40]], [[0, 0]]])  # there and back
    bounds = ns_bounds.Bounds(history)
    assert bounds.moved[0, 0] == 0 and bounds.moved[1, 0] == 50


def test_exact_distances_of_large_components():
    x = np.asarray([[ns_bounds.LARGEST, 3], [-ns_bounds.LARGEST, 5]])
    d = ns_bounds.squared(x, -x)
    assert d.tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s)) for s in -x] for r in x]


def test_cluster_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, -inf]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, cluster int")
    got = ns_bounds.cluster_vectors(df, k=3, rounds=2, dims=2)
    assert as_rows(got) == brute_clusters([rows[0], rows[8]], 3, 2)
    nothing = ns_bounds.cluster_vectors(df.limit(0), k=3, rounds=2, dims=2)
    assert nothing.count() == 0 and nothing.columns == got.columns
    assert ns_bounds.cluster_vectors(df.where("vec_id = 2"), dims=2).count() == 0
    big = spark.createDataFrame([(i, [float(n), 0.5]) for n, i in enumerate([*BIG, None])], "vec_id long, embedding array<float>").coalesce(1)
    assert as_rows(ns_bounds.cluster_vectors(big, k=2, rounds=3, dims=2)) == brute_clusters([(r.vec_id, r.embedding) for r in big.collect()], 2, 3)


# ---------------------------------------------------------------- contracts

def test_op11_contract(spark):
    from civiclens.llm.queries import REGISTRY

    rows = REGISTRY["op11_quality"](spark, SF).toPandas()
    ids = pd.read_parquet(f"{SF}/documents.parquet")["doc_id"]
    import zlib

    assert sorted(rows["doc_id"]) == sorted(ids)
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(rows["doc_id"], rows["held_out"]))
    assert (rows["predicted"] == (rows["score"] >= 0.3).astype(int)).all() and rows["score"].between(0, 1).all()


def test_op12_contract(spark):
    from civiclens.llm.queries import REGISTRY

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    rows = REGISTRY["op12_ranked_search"](spark, SF)
    assert rows.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    expected = brute_ranks(list(zip(docs["doc_id"].tolist(), docs["text"])), list(zip(items["item_id"].tolist(), items["text"])), 10)
    assert sorted([tuple(r) for r in rows.collect()], key=str) == expected


def test_op13_contract(spark):
    from civiclens.llm.queries import REGISTRY

    rows = REGISTRY["op13_centroids"](spark, SF)
    assert dict(rows.dtypes) == {
        "vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"
    }
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    assert as_rows(rows) == brute_clusters(list(zip(e["vec_id"].tolist(), e["embedding"])), 40, 5)
