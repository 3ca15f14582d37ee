"""The operators of this subpackage applied to the driver tables.

Each ``opN_<name>`` runs its operator over the whole table with production
parameters and derives the columns of its contract from the operator's output.
``ORACLE`` holds DuckDB SQL for those that SQL can state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclens.llm import crf, nbsvm, pii, toxicity
from civiclens.llm.bpe import encode_documents
from civiclens.llm.common import fold, table
from civiclens.llm.content_sort import exact_duplicates
from civiclens.llm.jaccard_join import jaccard_components
from civiclens.llm.link_graph import Rule, judge_urls
from civiclens.llm.multiset_hash import fingerprint_documents
from civiclens.llm.ns_bounds import cluster_vectors
from civiclens.llm.packing import pack_documents
from civiclens.llm.presence_masks import rank_documents
from civiclens.llm.suffix_dedup import remove_repeats

END_ID = 2  # the id after each document of a packed sequence

URL_RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicate groups of ``documents``; the largest doc_id stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def _of_kind(kind: str):
    return lambda span: span.startswith(f"{kind}:")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans counted and hashed, all spans."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, pii.fit(pii.sample_texts(docs)))
    of = F.split("base", ",")
    counts = [F.size(F.filter(of, _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url, by rules and link propagation."""
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; a fifth of the ids is held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(*toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), held_out=(5, 0)))
    return toxicity.score_documents(docs, model).select(
        "doc_id",
        F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles overlap by 90 %."""
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a quarter of the ids is held out."""
    docs = table(spark, sf_dir, "documents")
    model = crf.train(*crf.labelled_sample(docs, held_out=(4, 2)))
    return crf.identify(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without passages of 13 words or more of earlier documents."""
    return remove_repeats(table(spark, sf_dir, "documents"), width=13, digests=True)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a fifth of the ids is held out."""
    docs = table(spark, sf_dir, "documents")
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"), held_out=(5, 0))
    return nbsvm.score_documents(docs, model).select(
        "doc_id",
        F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10).select("item_id", "rank", "doc_id", "score")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings in 40 clusters after five rounds and one more assignment."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256.0, seed="2:").drop("scans")


REGISTRY = {
    "op1_bpe": op1_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_url_filter": op5_url_filter,
    "op6_multiset_hash": op6_multiset_hash,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_language_id": op9_language_id,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_quality": op11_quality,
    "op12_ranked_search": op12_ranked_search,
    "op13_centroids": op13_centroids,
}


def _centroid_sql(k: int, rounds: int) -> str:
    """The rounds of :func:`op13_centroids`, one pair of tables each."""
    parts = []
    for t in range(rounds + 1):
        if t:
            parts.append(f"""c{t} AS MATERIALIZED (
                SELECT c.j, c.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.v)::BIGINT AS v
                FROM c{t - 1} c LEFT JOIN (
                    SELECT a.j, x.i, sum(x.v)::BIGINT AS s, count(*) AS n FROM x JOIN a{t - 1} a USING (vec_id) GROUP BY ALL
                ) m ON m.j = c.j AND m.i = c.i)""")
        parts.append(f"""a{t} AS MATERIALIZED (
                SELECT vec_id, j, d FROM (
                    SELECT x.vec_id, c.j, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{t} c USING (i) GROUP BY ALL
                ) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1)""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, embedding FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
        ), x AS MATERIALIZED (
            SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT)) AS v FROM kept
        ), start AS (
            SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j FROM kept ORDER BY j LIMIT {k}
        ), c0 AS MATERIALIZED (SELECT s.j, x.i, x.v FROM x JOIN start s USING (vec_id)),
        {", ".join(parts)}
        SELECT a.vec_id, a.j::INT AS "cluster", a.d AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia,
               (sum(a.d) OVER ())::BIGINT AS inertia, h.h AS centroid_sha256
        FROM a{rounds} a JOIN (SELECT j, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY j) h USING (j)
    """

ORACLE = {
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op8_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS words FROM documents
        ), s AS MATERIALIZED (
            SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, least(len(words), 1)) + 1)) AS i FROM d)
        ), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        link AS MATERIALIZED (
            SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
            JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)
        ), reach(doc_id, met) AS (
            SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.met
        )
        SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
        FROM (SELECT doc_id, min(met) AS component_id FROM reach GROUP BY doc_id) c LEFT JOIN n USING (doc_id)
    """,
    "op10_suffix_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), w AS MATERIALIZED (
            SELECT doc_id, i, hash(array_to_string(words[i:i + 12], ' ')) AS h, sha256(array_to_string(words[i:i + 12], ' ')) AS v
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)
        ), gone AS (
            SELECT DISTINCT doc_id, i + unnest(range(13)) AS i
            FROM w JOIN (SELECT h, v, min(doc_id) AS first FROM w GROUP BY h, v) USING (h, v) WHERE first < doc_id
        ), word AS (
            SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d)
        ), cut AS (
            SELECT doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (g.i IS NULL) AS kept
            FROM word LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)
    """,
    "op12_ranked_search": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
        ), q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), total AS (
            SELECT count(*)::BIGINT AS docs, sum(len(words))::BIGINT AS terms FROM d WHERE len(words) > 0
        ), tf AS (
            SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM d) GROUP BY ALL
        ), w AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs
        ), s AS (
            SELECT q.item_id, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * tf.n * total.docs) // total.terms))))::BIGINT AS score
            FROM q JOIN tf USING (term) JOIN w USING (term), total GROUP BY ALL
        )
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS "rank", doc_id, score
        FROM s WHERE score > 0 QUALIFY "rank" <= 10
    """,
    "op13_centroids": _centroid_sql(k=40, rounds=5),
}
