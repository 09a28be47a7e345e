import json
from pathlib import Path

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from threadlens.functions.prompts import INSTRUCTIONS
from threadlens.operators.models import FunctionModel, Replay, ask


def never(seconds):
    raise AssertionError("no waiting expected")


def test_connection_errors_are_tried_again():
    calls, waits = [], []

    def call(prompts):
        calls.append(list(prompts))
        if len(calls) < 3:
            raise ConnectionError("down")
        return [p.upper() for p in prompts]

    assert ask(call, ["a", "b"], sleep=waits.append) == [
        ("A", "ok", None, 3),
        ("B", "ok", None, 3),
    ]
    assert waits == [4, 4] and len(calls) == 3


def test_three_tries_then_the_batch_fails():
    waits = []

    def call(prompts):
        raise TimeoutError("slow")

    assert ask(call, ["a", "b"], sleep=waits.append) == [
        (None, "failed", "TimeoutError: slow", 3)
    ] * 2
    assert len(waits) == 2


def test_other_errors_cost_only_their_own_prompt():
    def call(prompts):
        if "bad" in prompts:
            raise ValueError("too long")
        return prompts

    got = ask(call, ["a", "bad", "b"], sleep=never)
    assert [(r[0], r[1], r[2]) for r in got] == [
        ("a", "ok", None),
        (None, "failed", "ValueError: too long"),
        ("b", "ok", None),
    ]


def test_wrong_number_of_replies_is_an_error():
    assert ask(lambda prompts: [], ["a"], sleep=never)[0][1] == "failed"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(
        [(f"p{i}", 0, f"text {i}", i % 3 != 0) for i in range(40)],
        "post_id string, round int, text string, wanted boolean",
    ).repartition(3)


def counting_model(log: Path):
    def model(instruction, prompts):
        with log.open("a") as file:
            file.writelines(f"{p}\n" for p in prompts)
        return [f"{instruction[:3]} {p}" for p in prompts]

    return model


def test_only_needed_rows_are_asked_and_only_once(rows, tmp_path):
    log = tmp_path / "calls"
    model = FunctionModel(counting_model(log), batch_size=4, partitions=2)
    asked = model.attach(rows, "analysis", F.col("text"), F.col("wanted"))
    for _ in range(2):
        got = {r["post_id"]: r for r in asked.collect()}
    assert len(got) == 40
    for i in range(40):
        row = got[f"p{i}"]
        if i % 3:
            assert row["analysis_reply"] == f"{INSTRUCTIONS['analysis'][:3]} text {i}"
            assert (row["analysis_status"], row["analysis_attempts"]) == ("ok", 1)
        else:
            assert row["analysis_reply"] is None and row["analysis_status"] is None
    calls = log.read_text().splitlines()
    assert sorted(calls) == sorted(f"text {i}" for i in range(40) if i % 3)


def test_kept_replies_are_not_asked_for_again(rows, tmp_path):
    log = tmp_path / "calls"
    model = FunctionModel(counting_model(log), folder=f"{tmp_path}/replies")
    first = rows.filter("post_id < 'p2'")
    assert model.attach(first, "answer", F.col("text"), F.lit(True)).count() == first.count()
    asked = model.attach(rows, "answer", F.col("text"), F.lit(True))
    assert asked.filter("answer_status = 'ok'").count() == 40
    assert len(log.read_text().splitlines()) == 40
    again = rows.withColumn("round", F.lit(1))
    assert model.attach(again, "answer", F.col("text"), F.lit(True)).count() == 40
    assert len(log.read_text().splitlines()) == 80


def test_instructions_can_be_replaced(rows):
    model = FunctionModel(lambda i, ps: [i] * len(ps), instructions={"analysis": "Do it."})
    got = model.attach(rows, "analysis", F.col("text"), F.lit(True))
    assert {r["analysis_reply"] for r in got.collect()} == {"Do it."}


def test_replay(spark, rows):
    responses = spark.createDataFrame(
        [("p1", "analysis", "r"), ("p1", "answer", "other"), ("p3", "analysis", "r")],
        "post_id string, stage string, reply string",
    )
    got = Replay(responses).attach(rows, "analysis", F.col("text"), F.col("wanted"))
    by_id = {r["post_id"]: r for r in got.collect()}
    assert (by_id["p1"]["analysis_reply"], by_id["p1"]["analysis_status"]) == ("r", "ok")
    assert by_id["p2"]["analysis_status"] == "failed"
    assert by_id["p3"]["analysis_reply"] is None and by_id["p3"]["analysis_status"] is None


def test_tasks_need_no_installed_package(rows):
    """The pickled task code does not refer to the package by name."""
    from pyspark import cloudpickle

    assert b"threadlens.operators.models" not in cloudpickle.dumps(ask).split(b"ask")[0]
    import pickle
    import subprocess
    import sys

    code = (
        "import pickle, sys; f = pickle.loads(sys.stdin.buffer.read());"
        "print(f(lambda p: p, ['x'])); assert 'threadlens' not in sys.modules"
    )
    done = subprocess.run(
        [sys.executable, "-c", code], input=cloudpickle.dumps(ask), capture_output=True, cwd="/"
    )
    assert done.returncode == 0, done.stderr.decode()
    assert json.loads(done.stdout.decode().replace("(", "[").replace(")", "]").replace("None", "null").replace("'", '"')) == [["x", "ok", None, 1]]
    assert pickle


def test_short_prompts_use_all_slots(spark):
    prompts = spark.range(0, 20_000, 1, 2).selectExpr("'p' || id post_id", "0 round")
    model = FunctionModel(lambda _, some: [str(TaskContext.get().partitionId()) for _ in some])
    replies = model.attach(prompts, "answer", F.col("post_id"), F.lit(True))
    assert replies.select("answer_reply").distinct().count() >= spark.sparkContext.defaultParallelism
