import json

import pytest
from pyspark.sql import functions as F

from threadlens.functions.prompts import INSTRUCTIONS
from threadlens.operators.models import FunctionModel
from threadlens.operators.progress import totals
from threadlens.plans.condense import condense
from threadlens.schemas import POSTS
from threadlens.sources.dumps import stream_posts
from threadlens.streaming import incremental as I

NAMES = {text: stage for stage, text in INSTRUCTIONS.items()}


def make_posts(spark, numbers):
    rows = [(f"p{i:02d}", f"title {i}", "text", float(i)) for i in numbers]
    frame = spark.createDataFrame(rows, "post_id string, title string, self_text string, created_utc double")
    missing = [f for f in POSTS.fields if f.name not in frame.columns]
    return frame.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).select(*POSTS.names)


def make_comments(spark):
    rows = [(f"p{i:02d}", s, f"c{s}") for i in range(0, 40, 2) for s in (1, 2)]
    return spark.createDataFrame(rows, "post_id string, seq long, body string")


def make_model(log, fail="never"):
    names = dict(NAMES)

    def model(instruction, prompts):
        stage = names[instruction]
        with log.open("a") as file:
            file.writelines(f"{stage} {p.splitlines()[0]}\n" for p in prompts)
        if any(fail in p for p in prompts):
            raise ValueError(fail)
        if stage == "analysis":
            return [
                json.dumps({"user_complaint": p.splitlines()[0], "diagnosis": "d", "cybersecurity_relevance": "Low" if "3" in p else "High"})
                for p in prompts
            ]
        if stage == "generalize":
            return [p.splitlines()[0] for p in prompts]
        return [json.dumps({"Answer": p.splitlines()[0], "Confidence": 0.5}) for p in prompts]

    return FunctionModel(model, batch_size=1)


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def calls(log):
    return sorted(log.read_text().splitlines())


@pytest.fixture(scope="module")
def batch_result(spark, tmp_path_factory):
    log = tmp_path_factory.mktemp("batch") / "calls"
    result = condense(make_posts(spark, range(20)), make_comments(spark), make_model(log))
    return rows(result), calls(log)


def test_table_in_two_runs_equals_one_batch(spark, tmp_path, batch_result):
    log, out, comments = tmp_path / "calls", f"{tmp_path}/out", make_comments(spark)
    model = make_model(log)
    assert len(rows(I.condense_incremental(make_posts(spark, range(7)), comments, model, out))) == 7
    done = I.condense_incremental(make_posts(spark, range(20)), comments, model, out, chunk_rows=5)
    assert (rows(done), calls(log)) == batch_result
    again = I.condense_incremental(make_posts(spark, range(20)), comments, model, out)
    assert (rows(again), calls(log)) == batch_result


def test_stream_in_several_starts_equals_one_batch(spark, tmp_path, batch_result):
    log, out, comments = tmp_path / "calls", f"{tmp_path}/out", make_comments(spark)
    model, arriving = make_model(log), f"{tmp_path}/arriving"
    for part in (range(8), range(6, 20)):  # two posts are delivered twice
        make_posts(spark, part).repartition(3).write.mode("append").parquet(arriving)
        posts = stream_posts(spark, arriving, files_per_batch=2)
        done = I.condense_incremental(posts, comments, model, out)
    assert (rows(done), calls(log)) == batch_result


@pytest.mark.parametrize("chunk_rows", [None, 6])
def test_a_run_cut_short_after_the_model_asks_nothing_twice(
    spark, tmp_path, monkeypatch, batch_result, chunk_rows
):
    log, out, comments = tmp_path / "calls", f"{tmp_path}/out", make_comments(spark)
    model, posts = make_model(log), make_posts(spark, range(20))

    def cut(*_):
        raise RuntimeError("cut")

    with monkeypatch.context() as patched:
        patched.setattr(I, "observed", cut)
        with pytest.raises(RuntimeError):
            I.condense_incremental(posts, comments, model, out)
    assert rows(I.results(spark, out)) == []
    done = I.condense_incremental(posts, comments, model, out, chunk_rows=chunk_rows)
    assert (rows(done), calls(log)) == batch_result


def test_a_batch_delivered_again_changes_nothing(spark, tmp_path, batch_result):
    log, out, comments = tmp_path / "calls", f"{tmp_path}/out", make_comments(spark)
    model, posts = make_model(log), make_posts(spark, range(20))
    for _ in range(2):
        I._condense_batch(posts, comments, model, out, 0, 0, False)
    assert rows(I.results(spark, out, 0)) == batch_result[0]
    assert calls(log) == batch_result[1]


def test_failed_posts_wait_for_a_retry(spark, tmp_path, batch_result):
    log, out, comments = tmp_path / "calls", f"{tmp_path}/out", make_comments(spark)
    posts = make_posts(spark, range(20))
    done = I.condense_incremental(posts, comments, make_model(log, "title 7"), out)
    assert len(rows(done)) == 19
    letter = I.dead_letter(spark, out).collect()
    assert [(r["post_id"], r["stage"], r["error"], r["rounds"]) for r in letter] == [
        ("p07", "analysis", "ValueError: title 7", 1)
    ]
    before = calls(log)
    I.condense_incremental(posts, comments, make_model(log), out)
    assert calls(log) == before
    I.condense_incremental(posts, comments, make_model(log, "title 7"), out, retry_failed=True)
    assert I.dead_letter(spark, out).first()["rounds"] == 2
    done = I.condense_incremental(posts, comments, make_model(log), out, retry_failed=True)
    assert rows(done) == batch_result[0]
    assert I.dead_letter(spark, out).count() == 0
    done = {r["post_id"]: (r["status"], r["failures"]) for r in I.ledger(spark, out).collect()}
    assert done.pop("p07") == ("ok", 2)
    assert set(done.values()) == {("ok", 0)} and len(done) == 19
    counts = totals(make_posts(spark, range(22)), I.ledger(spark, out)).first()
    assert (counts["total_posts"], counts["processed"], counts["ok"], counts["pending"]) == (22, 20, 20, 2)


def test_fresh_starts_over(spark, tmp_path, batch_result):
    log, out, comments = tmp_path / "calls", f"{tmp_path}/out", make_comments(spark)
    posts = make_posts(spark, range(20))
    I.condense_incremental(posts, comments, make_model(log), out)
    done = I.condense_incremental(posts, comments, make_model(log), out, fresh=True)
    assert rows(done) == batch_result[0]
    assert calls(log) == sorted(batch_result[1] * 2)
    assert rows(I.results(spark, out, 0)) == rows(I.results(spark, out, 1))


def test_pending_posts_are_found_by_anti_join(spark, tmp_path):
    known = spark.createDataFrame([], "post_id string, status string, failures int")
    todo = I._with_rounds(make_posts(spark, range(3)), known, False)
    assert "LeftAnti" in todo._jdf.queryExecution().analyzed().toString()


def failing_at(log, stage, fail=""):
    """A model that fails in one stage on prompts with a certain text."""
    model = make_model(log)
    function, names = model.function, dict(NAMES)

    def call(instruction, prompts):
        if names[instruction] == stage and any(fail in p for p in prompts):
            with log.open("a") as file:
                file.writelines(f"failed {stage}\n" for _ in prompts)
            raise ValueError(f"no {stage}")
        return function(instruction, prompts)

    return FunctionModel(call, batch_size=1)


def test_failed_answers_get_another_try(spark, tmp_path, batch_result):
    log, out, comments = tmp_path / "calls", f"{tmp_path}/out", make_comments(spark)
    posts = make_posts(spark, range(20))
    done = I.condense_incremental(posts, comments, failing_at(log, "answer"), out)
    assert {r["solution"] for r in done.collect()} == {r["recommendation"] for r in done.collect()} == {"-999"}
    letter = sorted(map(tuple, I.dead_letter(spark, out).select("post_id", "stage", "error", "rounds").collect()))
    assert letter == [(f"p{i:02d}", "answer", "ValueError: no answer", 1) for i in range(0, 20, 2)]
    # Without being asked to, nothing is tried again.
    before = calls(log)
    I.condense_incremental(posts, comments, make_model(log), out)
    assert calls(log) == before
    # Once more in vain for some, then for good; only answers are asked for.
    I.condense_incremental(posts, comments, failing_at(log, "answer", "title 8"), out, retry_failed=True)
    letter = I.dead_letter(spark, out).collect()
    assert [(r["post_id"], r["stage"], r["rounds"]) for r in letter] == [("p08", "answer", 2)]
    done = I.condense_incremental(posts, comments, make_model(log), out, retry_failed=True)
    assert rows(done) == batch_result[0]
    assert I.dead_letter(spark, out).count() == 0
    asked = [c for c in calls(log) if not c.startswith("failed")]
    assert asked == batch_result[1]
    states = {r["post_id"]: (r["status"], r["answer_status"], r["failures"]) for r in I.ledger(spark, out).collect()}
    assert (states["p08"], states["p06"], states["p07"]) == (("ok", "ok", 2), ("ok", "ok", 1), ("ok", None, 0))
    # Nothing is left to retry.
    again = I.condense_incremental(posts, comments, failing_at(log, "answer"), out, retry_failed=True)
    assert rows(again) == batch_result[0] and "failed answer" not in calls(log)[len(before) + 60 :]


@pytest.mark.parametrize("stage", ["analysis", "generalize", "answer"])
def test_a_stream_retries_posts_of_files_read_before(spark, tmp_path, batch_result, stage):
    log, out, comments = tmp_path / "calls", f"{tmp_path}/out", make_comments(spark)
    arriving = f"{tmp_path}/arriving"
    make_posts(spark, range(20)).repartition(3).write.mode("append").parquet(arriving)

    def start(model, **options):
        return I.condense_incremental(stream_posts(spark, arriving, files_per_batch=2), comments, model, out, **options)

    start(failing_at(log, stage, "1"))
    failed = I.dead_letter(spark, out).count()
    assert failed > 0
    done = start(make_model(log), retry_failed=True)
    assert rows(done) == batch_result[0]
    assert I.dead_letter(spark, out).count() == 0
    asked = [c for c in calls(log) if not c.startswith("failed")]
    assert asked == batch_result[1]
    # New files after a retry are read as ever.
    make_posts(spark, range(18, 22)).repartition(1).write.mode("append").parquet(arriving)
    assert len(rows(start(make_model(log), retry_failed=True))) == 22


def test_a_retry_cut_short_asks_nothing_twice(spark, tmp_path, monkeypatch, batch_result):
    log, out, comments = tmp_path / "calls", f"{tmp_path}/out", make_comments(spark)
    posts = make_posts(spark, range(20))
    I.condense_incremental(posts, comments, failing_at(log, "analysis", "title 3"), out)
    I.condense_incremental(posts, comments, failing_at(log, "answer"), out, fresh=True)
    log.write_text("")

    def cut(*_):
        raise RuntimeError("cut")

    with monkeypatch.context() as patched:
        patched.setattr(I, "observed", cut)
        with pytest.raises(RuntimeError):
            I.condense_incremental(posts, comments, make_model(log), out, retry_failed=True)
    done = I.condense_incremental(posts, comments, make_model(log), out, retry_failed=True)
    assert rows(done) == batch_result[0]
    assert calls(log) == [c for c in batch_result[1] if c.startswith("answer")]


def test_a_failed_post_survives_a_batch_cut_short_before_its_outcome(spark, tmp_path, monkeypatch, batch_result):
    log, out, comments = tmp_path / "calls", f"{tmp_path}/out", make_comments(spark)
    posts = make_posts(spark, range(20))
    model = failing_at(log, "analysis", "title 7")
    I._condense_batch(posts, comments, model, out, 0, 0, False)
    # The same texts once more, as a repeated batch leaves them.
    kept = spark.read.parquet(f"{out}/reentry").select("post_id", "title", "self_text", "created_utc")
    kept.write.mode("append").parquet(f"{out}/reentry/run=0/batch=0")
    spark.createDataFrame([(0,)], "run int").write.parquet(f"{out}/runs")
    done = I.condense_incremental(posts.limit(0), comments, make_model(log), out, retry_failed=True)
    assert rows(done) == batch_result[0]
