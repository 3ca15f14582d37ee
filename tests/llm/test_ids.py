"""Ids over 2^53 and the ends of the long range, beside NULLs in the same batch."""

import hashlib

import public_tokenizers
import pytest

from civiclens.llm import crf, multiset_hash, pii, toxicity
from civiclens.llm.bpe import encode_documents
from civiclens.llm.content_sort import drop_exact_duplicates, exact_duplicates
from civiclens.llm.jaccard_join import jaccard_components
from civiclens.llm.packing import pack_documents
from civiclens.llm.suffix_dedup import remove_repeats

IDS = [2**53 + 1, 2**53 + 3, 2**53 + 5, -(2**63), 2**63 - 1, 0, None, None]
TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen id"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f"{TEXT} {n}") for n, i in enumerate(IDS)], "doc_id long, text string").coalesce(1)


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


WHOLE = sorted(IDS, key=str)


def test_bpe(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert ids(encode_documents(docs, path)) == WHOLE
    assert ids(encode_documents(docs, path, digests=True, part_chars=20)) == WHOLE


def test_packing(docs):
    assert ids(pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))) == WHOLE


def test_pii(docs):
    assert ids(pii.find_personal_data(docs, pii.fit([]))) == WHOLE


def test_learned(docs):
    assert ids(toxicity.score_documents(docs, toxicity.train([], []))) == WHOLE
    assert ids(crf.identify(docs, crf.train([], []))) == WHOLE


def test_exact_dedup(docs):
    assert ids(exact_duplicates(docs)) == WHOLE
    assert ids(drop_exact_duplicates(docs)) == WHOLE


def test_jaccard(docs):
    rows = jaccard_components(docs, 3, 80).collect()
    assert sorted((r.doc_id for r in rows), key=str) == WHOLE
    assert {r.component_id for r in rows if r.doc_id is not None} == {-(2**63)}


def test_suffix(docs):
    rows = remove_repeats(docs).collect()
    assert sorted((r.doc_id for r in rows), key=str) == WHOLE
    first = [r for r in rows if r.n_removed == 0 and r.doc_id is not None]
    assert [r.doc_id for r in first] == [-(2**63)]


@pytest.mark.parametrize("start,step,n", [(2**54 + 1, 3, 40), (7 * 10**18, 17, 40), (-(2**63), 1, 5), (0, 1, 1)])
def test_fingerprints_of_large_ids(spark, start, step, n):
    texts = {start + step * i: f"text {i} of many" for i in range(n)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in multiset_hash.fingerprint_documents(df).collect()}
    assert sorted(rows) == sorted(texts)
    order = sorted(texts, reverse=True)
    for i, follow in zip(order, order[1:] + order[:1]):
        assert rows[i].edited_sha256 == hashlib.sha256(multiset_hash.edited(texts[i], texts[follow]).encode()).hexdigest()


def test_fingerprints_of_repeated_and_null_ids(docs, spark):
    assert ids(multiset_hash.fingerprint_documents(docs)) == WHOLE
    hot = spark.createDataFrame([(7, f"t{i % 3}") for i in range(300)] + [(None, "x")] * 50 + [(8, "y")], "doc_id long, text string").repartition(4)
    rows = multiset_hash.fingerprint_documents(hot).collect()
    assert len(rows) == 351 and sum(r.doc_id == 7 for r in rows) == 300
