from threadlens.operators import threads as T

SCHEMA = "post_id string, seq long, body string"


def test_bodies_are_joined_in_order_and_nulls_skipped(spark):
    comments = spark.createDataFrame(
        [("a", 3, "z"), ("a", 1, "x"), ("a", 2, None), ("b", 1, None), ("b", 2, None)], SCHEMA
    )
    posts = spark.createDataFrame([("a",), ("b",), ("c",)], "post_id string")
    rows = {r["post_id"]: r for r in T.join_threads(posts, comments).collect()}
    assert (rows["a"]["has_comments"], rows["a"]["body_text"]) == (True, "x\nz")
    assert (rows["b"]["has_comments"], rows["b"]["body_text"]) == (True, "")
    assert (rows["c"]["has_comments"], rows["c"]["body_text"]) == (False, None)


def test_a_thread_is_one_row_however_long(spark):
    long = [("p0", i, f"{i:07d}" * 1_000) for i in range(1, 3_001)]
    comments = spark.createDataFrame([*long, ("p1", 1, "y")], SCHEMA).repartition(5)
    rows = {r["post_id"]: r["n"] for r in T.thread_texts(comments).selectExpr("post_id", "length(body_text) n").collect()}
    assert rows == {"p0": 3_000 * 7_001 - 1, "p1": 1}


def test_a_repeated_comment_counts_once(spark):
    comments = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], SCHEMA)
    assert T.thread_texts(comments.union(comments)).first()["body_text"] == "x\ny"
    posts = spark.createDataFrame([("a",)], "post_id string")
    assert [tuple(r) for r in T.threads_for_prompts(comments, posts).collect()] == [("a", "x\ny")]


def test_usual_threads_take_one_shuffle_and_no_map_side_gathering(spark, tmp_path):
    rows = [(f"p{i % 7}", i // 7 + 1, "b") for i in range(70)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/c")
    comments = spark.read.parquet(f"{tmp_path}/c")
    plan = T.thread_texts(comments)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_runs_of_a_thread_join_to_the_same_text(spark, monkeypatch):
    """Whatever the bounds of runs: order, repeated rows, null and empty bodies."""
    rows = [("a", i % 40 or None, [None, "", f"b{i % 80}", "x" * (i % 30)][i % 4]) for i in range(240)]
    rows += [("n", i, None) for i in range(30)] + [("e", 1, ""), ("e", 2, None), ("e", 3, ""), (None, 1, "z")]
    comments = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {}
    for post, seq, body in sorted(set(rows), key=lambda r: (r[0] or "", r[1] or -1, r[2] is not None, r[2] or "")):
        want.setdefault(post, []).extend([] if body is None else [body])
    want = {post: "\n".join(bodies) for post, bodies in want.items()}
    for size in (1, 100, 1 << 18):
        monkeypatch.setattr(T, "RUN_BYTES", size)
        assert {r["post_id"]: r["body_text"] for r in T.thread_texts(comments).collect()} == want


def test_no_row_gathers_the_comments_of_a_long_thread(spark, monkeypatch):
    """Bodies meet in runs; before, one buffer held every comment row of a post."""
    sizes = []
    inner = T._text
    monkeypatch.setattr(T, "_text", lambda place, text: sizes.append((place, text)) or inner(place, text))
    comments = spark.createDataFrame([("a", i, "body") for i in range(20_000)], SCHEMA)
    assert T.thread_texts(comments).first()["body_text"] == "\n".join(["body"] * 20_000)
    assert sizes == [("_at", "body"), ("_run", "_text")]
    plan = T.thread_texts(comments)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "_run" in plan
