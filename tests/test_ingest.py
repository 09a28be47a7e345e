from threadlens.plans.ingest import ingest_comments, ingest_posts
from threadlens.schemas import COMMENTS, POSTS, RAW_COMMENTS, RAW_SUBMISSIONS


def submissions(spark):
    rows = [
        ("a", "Ａ", "see http://x/1.png", "https://i.x/1.png", 5, 2, ("al",), 1.0, "c1"),
        ("b", "", "", "", 9, 9, None, 2.0, "c1"),
        ("c", "t", None, None, 9, 3, ("bo",), 3.0, "c1"),
        ("d", "t", "x", "u", 1, 1, ("bo",), 4.0, "c1"),
        ("e", "t", "x", "u", 1, 2, (None,), 5.0, "c2"),
        ("f", "t", "x", "u", 1, 0, None, 5.0, "c2"),
    ]
    return spark.createDataFrame(rows, RAW_SUBMISSIONS)


def test_posts(spark):
    got = {r["post_id"]: tuple(r)[1:] for r in ingest_posts(submissions(spark)).collect()}
    nothing = "No links or images found."
    assert got == {
        "a": ("A", "see http://x/1.png", "png", 5, 2, "al", 1.0, "http://x/1.png", "c1"),
        "b": (None, None, None, 9, 9, None, 2.0, nothing, "c1"),
        "c": ("t", None, None, 9, 3, "bo", 3.0, nothing, "c1"),
        "e": ("t", "x", "u", 1, 2, None, 5.0, nothing, "c2"),
    }
    assert ingest_posts(submissions(spark)).schema.names == POSTS.names


def test_the_limit_counts_kept_posts_of_each_community(spark):
    def ids(**options):
        return {r["post_id"] for r in ingest_posts(submissions(spark), **options).collect()}

    assert ids(limit=1) == {"b", "e"}
    assert ids(limit=2) == {"b", "c", "e"}
    assert ids(limit=0) == set()
    assert ids(min_comments=2) == {"b", "c"}
    assert ids(min_comments=-1) == set("abcdef")


def test_comments_of_kept_posts(spark):
    rows = [
        ("a", "1", None, 1, "second ｔop", 3, ("al",), 1.0),
        ("a", "2", None, 0, "first http://x/y", 3, None, 2.0),
        ("a", "3", "2", 0, "", 3, None, 3.0),
        ("d", "4", None, 0, "dropped with its post", 3, None, 4.0),
    ]
    raw = spark.createDataFrame(rows + rows[:1], RAW_COMMENTS)
    comments = ingest_comments(raw, ingest_posts(submissions(spark)))
    assert comments.schema.names == COMMENTS.names
    assert sorted(map(tuple, comments.collect()), key=lambda r: r[-1]) == [
        ("a", "2", "first http://x/y", 3, 2.0, None, "http://x/y", 1),
        ("a", "1", "second top", 3, 1.0, "al", "No links or images found.", 2),
        ("a", "3", None, 3, 3.0, None, "No links or images found.", 3),
    ]
