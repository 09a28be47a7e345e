import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from threadlens.operators import tree
from threadlens.operators.tree import flatten

SCHEMA = "post_id string, comment_id string, parent_id string, pos long"


def walk(rows):
    """Breadth-first listing per post, in plain Python."""
    children, known = defaultdict(list), {(r[0], r[1]) for r in rows}
    for post, comment, parent, pos in rows:
        top = parent is None or (post, parent) not in known
        children[(post, None if top else parent)].append((pos, comment))
    listing = {}
    for post in {r[0] for r in rows}:
        queue, seq = deque((c, 0) for _, c in sorted(children[(post, None)])), 0
        while queue:
            comment, depth = queue.popleft()
            seq += 1
            listing[(post, comment)] = (depth, seq)
            queue.extend((c, depth + 1) for _, c in sorted(children[(post, comment)]))
    return listing


def listed(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    return {
        (r["post_id"], r["comment_id"]): (r["depth"], r["seq"])
        for r in flatten(frame, **options).collect()
    }


def random_forest(seed, sizes):
    rng, rows = random.Random(seed), []
    for p, size in enumerate(sizes):
        for i in range(size):
            parent = f"c{rng.randrange(max(0, i - 5), i)}" if i and rng.random() < 0.8 else None
            rows.append((f"p{p}", f"c{i}", parent, rng.randrange(3)))
    rng.shuffle(rows)
    return rows


def test_random_trees(spark):
    rows = random_forest(1, [1, 2, 5, 40, 200])
    assert listed(spark, rows) == walk(rows)


def test_a_large_thread_is_numbered_over_many_tasks(spark):
    rows = random_forest(2, [3, 600, 5, 200])
    assert listed(spark, rows, large_thread=100) == walk(rows)


def test_chain(spark):
    rows = [("p", f"c{i}", f"c{i - 1}" if i else None, 0) for i in range(70)]
    assert listed(spark, rows) == walk(rows)


def test_missing_parents_make_a_comment_top_level(spark):
    rows = [("p", "a", "gone", 1), ("p", "b", None, 0), ("p", "c", "a", 0)]
    assert listed(spark, rows) == walk(rows)


def test_parent_cycles_end_and_keep_their_comments(spark):
    rows = [
        ("p", "top", None, 0),
        ("p", "x", "y", 0),
        ("p", "y", "x", 1),
        ("p", "below", "x", 2),
    ]
    assert listed(spark, rows) == {
        ("p", "top"): (0, 1),
        ("p", "below"): (None, 2),
        ("p", "x"): (None, 3),
        ("p", "y"): (None, 4),
    }


def test_no_comments(spark):
    assert flatten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_of_a_comment_count_once(spark):
    rows = [("p", "a", None, 0), ("p", "b", "a", 0), ("p", "c", "b", 0)]
    assert listed(spark, rows * 3) == walk(rows)
    frame = spark.createDataFrame(rows * 3, SCHEMA)
    assert flatten(frame).count() == 3


def deep_forest(seed):
    """Chains of many lengths side by side, with branches, some below a missing comment."""
    rng, rows = random.Random(seed), []
    for p in range(2):
        for chain in range(24):
            length, top = rng.randrange(1, 45), rng.choice([None, None, f"gone{chain}"])
            above = top
            for i in range(length):
                own = f"{rng.choice('abxyz')}{chain}-{i}"
                rows.append((f"p{p}", own, above, rng.randrange(2)))
                if rng.random() < 0.3:
                    rows.append((f"p{p}", f"side{chain}-{i}", above, rng.randrange(2)))
                above = own
    rng.shuffle(rows)
    return rows


def test_deep_threads_also_below_missing_comments(spark):
    for seed in (3, 4):
        rows = deep_forest(seed)
        assert listed(spark, rows) == walk(rows)


def test_numbered_paths_from_the_first_round_on(spark, monkeypatch):
    monkeypatch.setattr(tree, "_GROWING", 0)
    rows = deep_forest(5) + random_forest(6, [1, 40, 200])
    assert listed(spark, rows) == walk(rows)


def test_paths_do_not_grow_with_the_depth(spark):
    chain = [("p", f"c{i}", f"c{i - 1}" if i else None, 0) for i in range(1_500)]
    placed, found = tree._paths(spark.createDataFrame(chain, SCHEMA))
    longest, deepest = placed.agg(F.max(F.octet_length("path")), F.max("depth")).first()
    assert found == 1_500 and deepest == 1_499 and longest <= 8 * (8 + 5 + 1)
