import sys

import __spark_entry__
from threadlens.checks.queries import QUERIES
from threadlens.operators.copies import each_once
from threadlens.plans.ingest import ingest_comments

RAW = (
    "post_id string, id string, parent_id string, pos long, body string, score long, "
    "author struct<name:string>, created_utc double"
)


def test_of_repeated_comments_the_largest_counts(spark):
    rows = [
        ("p", "a", None, 0, "first", 1, ("x",), 1.0),
        ("p", "a", None, 0, "second", 1, None, 2.0),
        ("p", "a", None, 0, "first", 9, ("y",), 3.0),
        ("p", "b", "a", 1, None, 2, None, 1.0),
    ]
    posts = spark.createDataFrame([("p",)], "post_id string")
    results = []
    for order in (rows, rows[::-1]):
        comments = spark.createDataFrame(order, RAW).repartition(3)
        found = ingest_comments(comments, posts).select("comment_id", "body", "score", "author", "seq")
        results.append(sorted(map(tuple, found.collect())))
    assert results[0] == results[1] == [("a", "second", 1, None, 1), ("b", None, 2, None, 2)]


def test_repeated_keys_are_looked_for_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string").mapInArrow(count, "k long, v string")
    assert sorted(map(tuple, each_once(rows, ["k"]).collect())) == [(1, "b"), (2, "c")]
    # Once for the keys, then once for each of the two parts.
    assert seen.value == 9


def test_entry_without_the_optional_queries(monkeypatch):
    monkeypatch.setitem(sys.modules, "threadlens.llm", None)
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(QUERIES)
