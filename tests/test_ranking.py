import random

import pytest

from threadlens.operators.ranking import (
    best_first,
    number_within,
    top_overall,
    top_per_community,
)


@pytest.fixture(scope="module")
def posts(spark):
    rng = random.Random(3)
    # One community holds most rows and scores repeat a lot.
    rows = [
        (rng.choice(["big"] * 8 + ["small", "tiny"]), rng.randrange(20), f"p{i:05d}")
        for i in range(4000)
    ]
    frame = spark.createDataFrame(rows, "community string, upvotes long, post_id string")
    return rows, frame.repartition(6).cache()


def expected_top(rows, limit, per_community=True):
    kept, seen = set(), {}
    for community, upvotes, post in sorted(rows, key=lambda r: (-r[1], r[2])):
        group = community if per_community else ""
        seen[group] = seen.get(group, 0) + 1
        if seen[group] <= limit:
            kept.add(post)
    return kept


def ids(frame):
    return {r["post_id"] for r in frame.collect()}


@pytest.mark.parametrize("limit", [0, 1, 7, 1000, 1001, 2500, 10_000])
def test_top_per_community(posts, limit):
    rows, frame = posts
    assert ids(top_per_community(frame, limit)) == expected_top(rows, limit)


@pytest.mark.parametrize("limit", [0, 5, 1001, 3999])
def test_top_overall(posts, limit):
    rows, frame = posts
    found = top_overall(frame, limit)
    assert ids(found) == expected_top(rows, limit, per_community=False)
    assert found.count() == limit


def test_numbers_are_exact_across_partitions(posts):
    rows, frame = posts
    numbered = number_within(frame, ["community"], best_first(), "n").collect()
    for community in ("big", "small", "tiny"):
        mine = sorted((r for r in rows if r[0] == community), key=lambda r: (-r[1], r[2]))
        got = {r["post_id"]: r["n"] for r in numbered if r["community"] == community}
        assert got == {r[2]: i for i, r in enumerate(mine, 1)}


def test_map_tasks_cut_groups_before_the_shuffle(posts):
    plan = top_per_community(posts[1], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4
    assert "Python" not in plan


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    from threadlens.plans.ingest import ingest_posts
    from threadlens.schemas import RAW_SUBMISSIONS

    spark.createDataFrame([], RAW_SUBMISSIONS).write.parquet(f"{tmp_path}/raw")
    raw = spark.read.schema(RAW_SUBMISSIONS).parquet(f"{tmp_path}/raw")
    plan = (
        ingest_posts(raw, limit=3)
        .select("post_id", "upvotes")
        ._jdf.queryExecution()
        .executedPlan()
        .toString()
    )
    assert "GreaterThan(num_comments,1)" in plan
    assert "selftext" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("limit", [2, 1001])
def test_a_repeated_post_takes_one_place(spark, limit):
    rows = [("c", 9, "a"), ("c", 9, "a"), ("c", 5, "a"), ("c", 7, "b"), (None, 1, "d"), ("c", 1, "e")]
    frame = spark.createDataFrame(rows, "community string, upvotes long, post_id string")
    found = sorted(((r["community"] or "", r["post_id"], r["upvotes"]) for r in top_per_community(frame, limit).collect()))
    assert found == [("", "d", 1), ("c", "a", 9), ("c", "b", 7), ("c", "e", 1)][: 3 if limit == 2 else 4]
    assert [r["post_id"] for r in top_overall(frame, 2).collect()] == ["a", "b"]
