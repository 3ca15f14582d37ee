import hashlib
import random

import pytest

from civiclens.llm import common, graph
from civiclens.llm import jaccard_join as jj
from civiclens.llm import multiset_hash as mh
from civiclens.llm import suffix_dedup as sd
from civiclens.llm import toxicity
from civiclens.llm.jaccard_join import jaccard_components
from civiclens.llm.suffix_dedup import Automaton, remove_repeats
from tests.llm.conftest import EDGE_ROWS


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(docs, k, percent):
    sets = {i: shingle_set(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 90), (2, 60)])
def test_components_equal_all_pairs(spark, k, percent):
    rnd = random.Random(k)
    words = [f"w{i}" for i in range(60)]
    bases = [[rnd.choice(words) for _ in range(rnd.randint(1, 60))] for _ in range(20)]
    docs = []
    for i in range(260):
        w = list(rnd.choice(bases)) + (rnd.choice(bases) if rnd.random() < 0.15 else [])
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        docs.append((i, " ".join(w)))
    docs += [(1000, None), (1001, ""), (1002, " \t"), (1003, "W1"), (1004, "w1"), (1005, "w1 w2")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), k, percent).collect()}
    assert got == brute_components(docs, k, percent)


def test_components_edges(edge, none):
    rows = jaccard_components(edge, 5, 80).collect()
    assert len(rows) == len(EDGE_ROWS)
    assert sorted(r.component_id for r in rows if r.doc_id) == [1, 1, 1, 3, 4, 5, 6, 7]
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert jaccard_components(none, 5, 80).count() == 0


def test_a_family_of_near_copies_does_not_make_all_pairs(spark, monkeypatch):
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(140)]
    docs = []
    for i in range(200):
        w = list(base)
        for at in rnd.sample(range(len(w)), 1 if i % 25 == 0 else rnd.choice([2, 3, 3, 4, 4])):  # most are just too far from one another
            w[at] = f"own{i}x{at}"
        docs.append((i, " ".join(w)))
    made = {}

    def counted(df, name, write=jj.written):
        found = write(df, name)
        made[name] = found.count()
        return found

    monkeypatch.setattr(jj, "written", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80).collect()}
    assert got == brute_components(docs, 5, 80)
    pairs = {k: n for k, n in made.items() if k == "meetings" or k.endswith("-pairs")}
    assert max(pairs.values()) < 5 * len(docs), pairs  # all pairs: 19,900


def test_members_of_a_family_that_link_are_not_paired_with_each_other(spark, monkeypatch):
    """The smallest ids are the most changed ones; a third of all pairs link."""
    rnd = random.Random(6)
    base = [f"b{i}" for i in range(140)]
    changes = sorted((rnd.choice([0, 1, 2, 2, 3, 4, 5, 6]) for _ in range(240)), reverse=True)
    docs = []
    for i, n in enumerate(changes):
        w = list(base)
        for at in rnd.sample(range(len(w)), n):
            w[at] = f"own{i}x{at}"
        docs.append((i, " ".join(w)))
    made = {}

    def counted(df, name, write=jj.written):
        found = write(df, name)
        made[name] = made.get(name, 0) + found.count()
        return found

    monkeypatch.setattr(jj, "written", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80).collect()}
    assert got == brute_components(docs, 5, 80)
    pairs = {k: n for k, n in made.items() if k == "meetings" or k.endswith("-pairs")}
    assert sum(pairs.values()) < 8 * len(docs), pairs  # all pairs: 28,680


def test_many_edges_between_components_are_one(spark):
    """The components after more edges are those of all edges; single nodes and edges inside a component count too."""
    rnd = random.Random(3)
    some = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(25)]
    more = [(rnd.randrange(90), rnd.randrange(90)) for _ in range(40)] + some[:5]
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    take = lambda df: sorted(map(tuple, df.collect()))
    first = graph.components(edges(some))
    assert take(graph.merged(first, edges(more))) == take(graph.components(edges(some + more)))
    assert take(graph.merged(first, edges([]))) == take(first)
    assert take(graph.merged(first.limit(0), edges(more))) == take(graph.components(edges(more)))


def test_sketches_differ_in_no_more_places_than_the_sets():
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randint(0, 50)}" for _ in range(n)) for n in (0, 1, 2, 9, 60, 400, 3000)]
    flat, sizes = jj.shingle_sets(texts, 2)
    sets, bits = [set(x.tolist()) for x in jj._split(flat, sizes)], jj.sketches(flat, sizes)
    for a, x in zip(sets, bits):
        assert int(jj.np.bitwise_count(x.view(jj.np.uint64)).sum()) % 2 == len(a) % 2
        for b, y in zip(sets, bits):
            assert int(jj.np.bitwise_count((x ^ y).view(jj.np.uint64)).sum()) <= len(a ^ b)


def brute_removed(docs, width):
    first = {}
    for d, t in docs:
        w = (t or "").encode().split()
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, 1 << 60), d)
    out = {}
    for d, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out[d] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("width,vocabulary", [(13, 40), (4, 3)])
def test_removed_words_equal_brute_force(spark, width, vocabulary):
    rnd = random.Random(width)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [[rnd.choice(words) for _ in range(rnd.randint(width, 40))] for _ in range(12)]
    docs = []
    for i in range(200):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += rnd.choice([rnd.choice(passages), [rnd.choice(words) for _ in range(rnd.randint(0, 20))], rnd.choice(passages)[3:30]])
        docs.append((rnd.randint(0, 10**6) * 1000 + i, " ".join(w)))
    docs += [(5, None), (6, ""), (7, " \t")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), width).collect()}
    assert got == brute_removed(docs, width)


def test_automaton_knows_the_smallest_document():
    a = Automaton()
    a.add("x y z".split(), 9)
    a.add("a b c d x y z".split(), 4)
    a.finish()
    assert a.repeats("q x y z q".split(), 5, 3) == [(1, 4)]
    assert a.repeats("x y z".split(), 4, 3) == []
    assert a.repeats("c d x y z a b".split(), 7, 4) == [(0, 5)]


def test_removal_edges(edge, none):
    rows = remove_repeats(edge, 5).collect()
    assert len(rows) == len(EDGE_ROWS)
    assert sorted(r.n_removed for r in rows if r.doc_id == 2) == [16, 16]
    assert all(r.n_removed == 0 for r in rows if r.doc_id in (None, 1, 3, 4, 5, 6))
    assert remove_repeats(none, 13).count() == 0


def test_fingerprint_is_a_multiset_sum():
    a, b = "x y z\nfoo bar\nlone", "lone\n\nfoo bar\nx y z"
    assert mh.fingerprint(a) == mh.fingerprint(b)
    assert mh.fingerprint(a) - mh.fingerprint("foo bar") == mh.fingerprint("x y z\nlone")
    assert mh.fingerprint("p") + mh.fingerprint("p") == mh.fingerprint("p\np") != mh.fingerprint("p")
    assert mh.Fingerprint.read(mh.fingerprint(a).text()) == mh.fingerprint(a)


def test_long_texts_of_one_line_stay_near():
    line = " ".join(f"w{i}" for i in range(10)) + "\n"
    other = "\n".join(f"x{i} y{i * 7} z{i * 3}" for i in range(40_000))
    text = line * 40_000
    own, half, two = mh.fingerprint(text), mh.fingerprint(mh.edited(text, other)), mh.fingerprint(line * 20_000)
    assert own.likeness(two) > 0.999 and own.likeness(half) > 0.9
    assert mh.Fingerprint.read(own.text()).likeness(half) == own.likeness(half)


def test_fingerprints_equal_brute_force(spark):
    rnd = random.Random(1)
    docs = [(i * 3 + 1, "\n".join(" ".join(f"w{rnd.randint(0, 500)}" for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(0, 6)))) for i in range(150)]
    got = {r.doc_id: r for r in mh.fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    docs.sort(reverse=True)
    for n, (i, text) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        changed = mh.edited(text, after)
        r, own, other = got[i], mh.fingerprint(text), mh.fingerprint(changed)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own.text(), other.text())
        assert (r.near_edited, r.near_next) == (own.likeness(other), own.likeness(mh.fingerprint(after)))


def test_fingerprint_edges(edge, none):
    rows = mh.fingerprint_documents(edge).collect()
    assert len(rows) == len(EDGE_ROWS) and sum(r.doc_id is None for r in rows) == 2
    assert mh.fingerprint_documents(none).count() == 0
    assert mh.fingerprint_documents(edge.limit(1)).first().near_next == 1.0


def test_texts_looked_up_by_a_bitmap_give_the_same_components(spark, monkeypatch):
    """Copies, an id on several rows and NULL ids; texts that no pair needs stay out of the shuffle."""
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(40)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t) for i, t in enumerate(base[:9])]
    rows += [(200 + i, t + " tail") for i, t in enumerate(base[5:15])] + [(3, base[20]), (None, base[0]), (None, None), (300, ""), (-(2**63), base[1]), (2**63 - 1, base[2] + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    take = lambda: sorted(map(tuple, jj.jaccard_components(docs, 3, 80).collect()), key=str)
    plain, kept = take(), []
    seen = jj.likely
    monkeypatch.setattr(jj, "likely", lambda rows, bitmap: (kept.append(rows), seen(rows, bitmap))[1])
    monkeypatch.setattr(jj, "FEW", 0)
    assert take() == plain and kept
    component = {d: c for d, _, c in plain}
    assert component[100] == component[0] and component[205] == component[10] and component[2**63 - 1] == component[2] and component[-(2**63)] == -(2**63)


def test_python_workers_get_small_batches(spark):
    """Spark's own limit of 10,000 rows would hand these texts over in one batch."""
    spark.conf.unset(common.BATCH_CONF)
    docs = spark.range(0, 5000, 1, 1).selectExpr("id as doc_id", "repeat('x', 5000) as text")
    count = lambda: docs.mapInPandas(lambda fs: ([f[["doc_id"]].assign(doc_id=len(f))[:1] for f in fs]), "doc_id long").count()
    assert count() == 1
    remove_repeats(docs.limit(0))
    assert count() >= 3
    spark.conf.set(common.BATCH_CONF, "1000000")
    common.bounded_batches(spark)
    assert spark.conf.get(common.BATCH_CONF) == "1000000"
    spark.conf.unset(common.BATCH_CONF)


def test_fingerprints_take_and_give_small_batches(spark, monkeypatch):
    """The texts that a task holds at once don't grow with Spark's batches, nor its results with the texts' batches."""
    docs = [(i, f"line {i}\nand {i * i} more") for i in range(40)] + [(None, None), (7, "again")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    take = lambda: sorted(map(tuple, mh.fingerprint_documents(frame).collect()), key=str)
    spark.conf.unset(common.BATCH_CONF)
    whole = take()
    assert spark.conf.get(common.BATCH_CONF) == str(common.BATCH_BYTES)
    sizes, given = spark.sparkContext.accumulator(0), mh.map_frames
    given_at_once = lambda walk: lambda frames: (sizes.add(len(f) > 3) or f for f in walk(frames))
    monkeypatch.setattr(mh, "map_frames", lambda df, walk, schema: given(df, given_at_once(walk), schema))
    monkeypatch.setattr(mh, "ROWS", 3)
    assert take() == whole and len(whole) == len(docs)
    assert sizes.value == 0


def test_windows_are_compared_for_the_first_of_equal_runs_only(spark, monkeypatch):
    """Two texts, each in many documents of different tasks, with a common passage between
    words of their own: the runs at its ends differ, and each of them has many copies."""
    words = lambda kind, n: [f"{kind}{i}" for i in range(n)]
    texts = [" ".join(words(a, 20) + words("p", 30) + words(z, 20)) for a, z in (("a", "y"), ("b", "z"))]
    docs = [(i, texts[i % 2]) for i in range(24)]
    counts, write = {}, sd.written
    monkeypatch.setattr(sd, "written", lambda df, name: (out := write(df, name), counts.update({name: out.count()}))[0])
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(12, "doc_id")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(rows, 13).collect()}
    assert got == brute_removed(docs, 13)
    assert 0 < counts["windows"] <= 2 * 24  # at most 2 * 12 windows of each text's ends


def test_rows_of_a_bitmap_are_found_without_python(spark, capsys):
    """A Python step after it would need a second worker a task beside its own."""
    ids = [0, 1, 63, 64, -1, -(2**63), 2**63 - 1, common.IDS - 1]
    wanted = spark.createDataFrame([(i,) for i in [*ids, None]], "doc_id long")
    bitmap = spark.sparkContext.broadcast(common.bitmap_of(wanted, "doc_id"))
    others = [2, 65, -64, common.IDS + 5, None]
    rows = spark.createDataFrame([(i, "x") for i in [*ids, *others, 63, common.IDS + 64]], "doc_id long, text string")
    kept = common.likely(rows, bitmap)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*ids, 63, common.IDS + 64])
    kept.explain()
    assert "EvalPython" not in capsys.readouterr().out


def test_toxicity_hands_small_batches_to_workers(spark):
    spark.conf.unset(common.BATCH_CONF)
    docs = spark.createDataFrame([(1, "foo bar"), (2, None)], "doc_id long, text string")
    assert toxicity.drop_toxic(docs, toxicity.Model(b"", b"", (-1.0,))).count() == 2
    assert spark.conf.get(common.BATCH_CONF) == str(common.BATCH_BYTES)
    spark.conf.unset(common.BATCH_CONF)
