import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from civiclens.llm.common import DOCUMENT_COLUMNS
from tests.llm.conftest import EDGE_ROWS

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    rnd = random.Random(9)
    text = lambda n: " ".join(f"w{rnd.randint(0, 3000)}" for _ in range(n))
    a, b = text(80), text(120)
    rows = [(9001, a), (9002, a), (9003, b), (9004, b.replace(b.split()[60], "changed", 1)), (9005, text(50) + " call +1 (414) 555-7134 now"), (9006, text(2500)), (9007, None)]
    extra = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    base = spark.read.parquet(f"{SF}/documents.parquet").select(*DOCUMENT_COLUMNS)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = base.where("doc_id < 400").unionByName(extra)
    before = {r.doc_id for r in docs.collect()}
    clean = cp.drop_toxic(spark, docs, SF)
    left = {r.doc_id for r in clean.collect()}
    assert all(i in left for i, _ in rows)
    ordinary = [i for i in before if labels.get(i) == 0]
    assert sum(i in left for i in ordinary) >= 0.99 * len(ordinary)
    single = cp.exact_dedup(spark, extra, SF)
    assert {r.doc_id for r in single.collect()} == {9002, 9003, 9004, 9005, 9006, 9007}
    near = cp.near_dedup(spark, single, SF)
    assert {r.doc_id for r in near.collect()} == {9002, 9003, 9005, 9006, 9007}
    private = {r.doc_id: r for r in cp.redact_pii(spark, near, SF).collect()}
    assert "[PHONE]" in private[9005].text and "555" not in private[9005].text and private[9005].n_chars == len(private[9005].text)
    assert private[9003].text == b and private[9007].text is None
    packed = cp.pack(spark, near, SF).toPandas()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packed[packed.doc_id == 9003].length.sum() == len(lib.encode(b, add_special_tokens=False).ids) + 1
    assert packed.groupby("sequence_id").length.sum().max() <= 1024


def test_stages_keep_columns_and_meet_edges(spark, edge, none):
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, edge, SF)
        assert out.columns == list(DOCUMENT_COLUMNS), name
        assert 5 <= out.count() <= len(EDGE_ROWS), name
        assert stage(spark, none, SF).count() == 0, name
    assert cp.pack(spark, none, SF).count() == 0
