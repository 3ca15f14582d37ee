from collections import defaultdict

from pyspark.sql import functions as F

from civiclens.llm.content_sort import drop_exact_duplicates, exact_duplicates
from tests.llm.conftest import EDGE_ROWS


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    return groups


def test_hot_group_and_ties(spark):
    rows = [(i, f"text {i % 50}") for i in range(200)] + [(1000 + i, "hot") for i in range(400)]
    got = {r.doc_id: r for r in exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    groups = brute(rows)
    for i, text in rows:
        ids = groups[text]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))


def test_edges(edge, none):
    rows = exact_duplicates(edge).collect()
    assert len(rows) == len(EDGE_ROWS)
    groups = brute([(r[0], r[1]) for r in EDGE_ROWS])
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        of = [r for r in rows if r.keep_id == keep and r.group_size == len(ids)]
        assert sum(r.kept for r in of) >= 1, text
    assert sum(r.kept for r in rows) == len(groups)  # one row of each group, repeats too
    assert exact_duplicates(none).count() == 0


def test_smallest_stays_and_columns(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 2), (2, "b", 3)], "doc_id long, text string, slice int")
    assert sorted(r.doc_id for r in drop_exact_duplicates(df, keep="min").collect()) == [1, 2]
    assert drop_exact_duplicates(df).columns == df.columns


def test_one_shuffle_of_texts_and_no_python(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    plan = exact_duplicates(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
