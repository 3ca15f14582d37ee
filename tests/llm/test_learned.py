import itertools
import random
import re
import zlib

import numpy as np

from civiclens.llm import crf, pii, toxicity
from tests.llm.conftest import EDGE_ROWS

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    rnd = random.Random(0)
    syllables = ["an", "er", "th", "in", "on", "ed", "re", "st", "ou", "ha"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    texts, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rnd.randint(5, 120))]
        if i % 4 == 0:
            for _ in range(rnd.randint(2, 6)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "moron", "worthless", "scum", "vequ" + word()]))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts[:600], labels[:600])
    seen: dict = {}
    right = [(model.score(model.evidence(t, seen)) >= 0.5) == bool(y) for t, y in zip(texts[600:], labels[600:])]
    assert np.mean(right) > 0.95


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(*toxicity.labelled_sample(edge, labels, held_out=None))
    rows = toxicity.score_documents(edge, model).collect()
    assert len(rows) == len(EDGE_ROWS) and all(0 <= r.score <= 1 for r in rows)
    nothing = toxicity.train(*toxicity.labelled_sample(edge, labels.limit(0)))
    assert all(r.score < 0.5 for r in toxicity.score_documents(edge, nothing).collect())
    assert toxicity.score_documents(none, model).count() == 0
    assert toxicity.drop_toxic(edge, nothing).count() == len(EDGE_ROWS)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    texts, _ = toxicity.labelled_sample(docs, labels)
    assert {int(t[1:]) for t in texts} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5}


def held_out_recall(planted, seed=1):
    """Shares of toxic documents found and of ordinary ones taken for toxic, where
    toxic documents have ``planted(rnd)`` and all have its words one by one."""
    rnd = random.Random(seed)
    syllables = ["an", "er", "th", "in", "on", "ed", "re", "st", "ou", "ha"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(2, 4)))
    texts, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rnd.randint(30, 120))]
        y = i % 3 == 0
        for x in planted(rnd, y):
            words.insert(rnd.randrange(len(words)), x)
        texts.append(" ".join(words))
        labels.append(int(y))
    model = toxicity.train(texts[:600], labels[:600])
    seen: dict = {}
    hit = np.array([model.score(model.evidence(t, seen)) >= 0.5 for t in texts[600:]])
    y = np.array(labels[600:]) == 1
    return hit[y].mean(), hit[~y].mean()


def test_toxic_words_of_three_bytes_and_fewer():
    for bad in ("kys", "zx", "q"):
        found, wrong = held_out_recall(lambda rnd, y: [bad] * rnd.randint(1, 3) if y else [])  # noqa: B023
        assert found > 0.95 and wrong < 0.05, bad


def test_toxic_sequences_of_ordinary_words():
    words = ["people", "like", "these", "should", "leave"]

    def planted(rnd, y):
        return [" ".join(words)] * rnd.randint(1, 2) if y else [" ".join(rnd.sample(words, 2)) for _ in range(2)] + rnd.sample(words, 5)

    found, wrong = held_out_recall(planted)
    assert found > 0.95 and wrong < 0.05


def test_strings_in_long_runs_lie_whole_in_a_window():
    run = "".join(chr(97 + i % 23) for i in range(500))
    for at in range(40, 60):
        text = run[:at] + "wretchedscoundrel" + run[at:]
        assert any(b"wretchedscoundrel" in w for w in toxicity.windows(text)), at
        assert max(map(len, toxicity.windows(text))) <= toxicity.WINDOW_BYTES


def test_copies_of_a_document_make_no_toxic_sequence():
    rnd = random.Random(5)
    copied = " ".join(f"w{rnd.randint(0, 400)}" for _ in range(60))
    other = lambda: " ".join(f"w{rnd.randint(0, 400)}" for _ in range(60))
    texts, ordinary = [copied] * 40 + [other() for _ in range(40)], [other() for _ in range(160)]
    assert not toxicity.sequences(texts, ordinary, 2.0, 3, set())


def brute_spans(text):
    out = [(m.start(), m.end(), "email") for m in pii.EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in pii.IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(m.start(), m.end(), "card") for m in pii.CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), m.end(), "phone") for m in pii.PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return pii.ordered(out)


def test_base_spans_equal_the_patterns():
    rnd = random.Random(2)
    parts = list("ab.@-%+ 0129()_é\n") + ["255", "256", "4111111111111111", "@a.b", "+49 ", "1.2.3.4"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_trees_add_other_forms_and_leave_clean_text(spark, edge, none):
    rnd = random.Random(4)
    texts = []
    for i in range(400):
        kind = i % 4
        ip = ".".join(str(rnd.randint(0, 255)) for _ in range(4))
        item = [f"u{i}@mail.example.com", ip, "4111 1111 1111 1111", f"+1 (414) 555-{rnd.randint(1000, 9999)}"][kind]
        texts.append(f"please see {item} for more of this")
    model = pii.fit(texts)
    found = lambda t: [k for *_, k in pii.find_spans([t], model)[0][1]]
    assert found("write to jo.doe (at) example.com now") == ["email"]
    assert found("ring 1 (414) 555-7134 now") == ["phone"]
    for clean in ("on 2024-01-05 at 10", "version 300.1.2.3", "id 1234567", "chapter 3.4 of 12", ""):
        assert found(clean) == []
    assert pii.redact("a +1 (414) 555-7134 b", pii.base_spans("a +1 (414) 555-7134 b")) == "a [PHONE] b"
    rows = pii.find_personal_data(edge, model).collect()
    assert len(rows) == len(EDGE_ROWS) and all(r.base == "" for r in rows)
    assert pii.find_personal_data(none, model).count() == 0
    cleaned = pii.redact_documents(edge, model).collect()
    assert sum(r.text is None for r in cleaned) == 2


def test_addresses_with_other_letters_go_whole():
    names, hosts = ("jo", "ann.lee", "kim7", "r.mo22", "olga"), ("x.com", "mail.example.com", "example.org")
    texts = [f"please see {names[i % 5]}@{hosts[i % 3]} for more of this" for i in range(100)] + [f"write to k{i} now @home or 1.2.3.{i % 9}" for i in range(100)]
    model = pii.fit(texts)
    for address in ("jörg@x.com", "müller.k@mail.example.com", "rené7@mail.example.com"):
        text = f"please see {address} for more"
        base, spans = pii.find_spans([text], model)[0]
        assert base and set(base) <= set(spans)
        assert pii.redact(text, spans) == "please see [EMAIL] for more", address
    text = "please see u5@mail.example.com for more"
    assert pii.find_spans([text], model)[0][0] == pii.find_spans([text], model)[0][1]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    unary, start, step, length = rng.normal(size=(2, 5, 3)), rng.normal(size=3), rng.normal(size=(3, 3)), np.array([5, 3])
    got, pairs = crf.marginals(unary, length, start, step)
    want, want_pairs = np.zeros_like(got), np.zeros((3, 3))
    for d, n in enumerate(length):
        weights = {}
        for y in itertools.product(range(3), repeat=n):
            weights[y] = np.exp(start[y[0]] + sum(unary[d, i, y[i]] for i in range(n)) + sum(step[y[i], y[i + 1]] for i in range(n - 1)))
        total = sum(weights.values())
        for y, w in weights.items():
            for i in range(n):
                want[d, i, y[i]] += w / total
            for i in range(n - 1):
                want_pairs[y[i], y[i + 1]] += w / total
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_language_of_held_out_documents_and_of_switched_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = crf.train(*crf.labelled_sample(docs, per_language=60))
    rows = [r for r in docs.collect() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    got = crf.Labeller(model).languages([r.text for r in rows])
    assert np.mean([g == r.lang for (g, _), r in zip(got, rows)]) > 0.97
    by = {r.lang: " ".join(r.text.split()[:30]) for r in rows if len(r.text.split()) > 60}
    one, two = sorted(by)[:2]
    words = crf.words_of(by[one]) + crf.words_of(by[two])
    labels = [model.labels[i] for i in model.label_words([" ".join(words)])[0].argmax(axis=1)]
    half = len(crf.words_of(by[one]))
    assert labels[:half].count(one) > 0.8 * half and labels[half:].count(two) > 0.8 * (len(words) - half)


def test_language_edges(spark, edge, none):
    model = crf.train(*crf.labelled_sample(edge, held_out=None))
    rows = crf.identify(edge, model).collect()
    assert len(rows) == len(EDGE_ROWS)
    got = {r.doc_id: r for r in rows if r.doc_id}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5, 6))
    assert crf.identify(edge, crf.train([], [])).where("lang_pred <> 'und'").count() == 0
    assert crf.identify(none, model).count() == 0
