import json

from threadlens.functions.prompts import INSTRUCTIONS
from threadlens.operators.models import FunctionModel, Replay
from threadlens.operators import threads
from threadlens.plans.condense import condense, condense_outcomes
from threadlens.schemas import CONDENSED, OUTCOMES

POSTS = "post_id string, title string, self_text string, created_utc double"
COMMENTS = "post_id string, seq long, body string"


def frames(spark):
    posts = spark.createDataFrame(
        [
            ("plain", "Ｔitle", "body", 1.0),
            ("silent", "t", None, 2.0),
            ("low", None, "", 3.0),
            ("broken", "fail analysis", "", 4.0),
            ("noissue", "nothing", "", 5.0),
            ("badgen", "fail generalize", "", 6.0),
            ("badanswer", "t", "fail answer", 7.0),
        ],
        POSTS,
    )
    comments = spark.createDataFrame(
        [
            ("plain", 2, "second"),
            ("plain", 1, "first"),
            ("low", 1, None),
            ("badanswer", 1, "fail answer"),
            ("noissue", 1, "x"),
            ("elsewhere", 1, "x"),
        ],
        COMMENTS,
    )
    return posts, comments


def make_model(seen=None):
    names = {text: stage for stage, text in INSTRUCTIONS.items()}

    def reply(stage, prompt):
        if f"fail {stage}" in prompt:
            raise ValueError(stage)
        if stage == "analysis":
            if "nothing" in prompt:
                return '{"user_complaint":-1000,"diagnosis":-1000}'
            low = "Title: None" in prompt or "fail generalize" in prompt
            return json.dumps(
                {
                    "user_complaint": prompt,
                    "diagnosis": "d",
                    "cybersecurity_relevance": "Low" if low else "High",
                }
            )
        if stage == "generalize":
            return f"<{prompt}>"
        return json.dumps({"Answer": prompt, "Confidence": 1, "Is_Solution": True})

    def model(instruction, prompts):
        return [reply(names[instruction], p) for p in prompts]

    return model


def test_every_post_has_its_outcome(spark):
    posts, comments = frames(spark)
    outcomes = condense_outcomes(posts, comments, FunctionModel(make_model()))
    assert outcomes.schema.names == OUTCOMES.names
    got = {r["post_id"]: r for r in outcomes.collect()}
    assert {k: (r["status"], r["stage"], r["error"]) for k, r in got.items()} == {
        "plain": ("ok", "answer", None),
        "silent": ("ok", "analysis", None),
        "low": ("ok", "answer", None),
        "broken": ("failed", "analysis", "ValueError: analysis"),
        "noissue": ("no_issue", "analysis", None),
        "badgen": ("failed", "generalize", "ValueError: generalize"),
        "badanswer": ("ok", "answer", "ValueError: answer"),
    }
    complaint = "Title: Title\n\nContent: body"
    assert got["plain"]["solution"] == (
        f"User Complaint: {complaint}\nDiagnosis: d\nComments: first\nsecond"
    )
    assert got["plain"]["created_time"] == 1.0
    default = ("-999", "-999", "No steps", 0.0)
    for post in ("silent", "badanswer"):
        row = got[post]
        assert (row["solution"], row["recommendation"], row["steps"], row["confidence"]) == default
    general = "<Specific complaint: Title: None\n\nContent: None\nProvide a more general version:>"
    assert got["low"]["user_complaint"] == general
    assert got["low"]["solution"].endswith("Comments: ")


def test_results_are_the_successes(spark):
    posts, comments = frames(spark)
    results = condense(posts, comments, FunctionModel(make_model()))
    assert results.schema == CONDENSED or results.schema.names == CONDENSED.names
    assert {r["post_id"] for r in results.collect()} == {"plain", "silent", "low", "badanswer"}


def test_a_long_thread_is_asked_and_answered(spark):
    posts, comments = frames(spark)
    more = spark.range(2, 1_500).selectExpr("'plain' post_id", "id seq", "repeat('x', 2000) body")
    asked = condense_outcomes(posts, comments.select("post_id", "seq", "body").unionByName(more), FunctionModel(make_model()))
    got = {r["post_id"]: r for r in asked.collect()}
    assert (got["plain"]["status"], got["plain"]["error"], got["plain"]["stage"]) == ("ok", None, "answer")
    assert got["plain"]["confidence"] > 0


def test_repeated_replies_make_no_rows(spark):
    posts, comments = frames(spark)
    replies = spark.createDataFrame([("plain", "analysis", "{}"), ("plain", "analysis", "[]")], "post_id string, stage string, reply string")
    assert condense_outcomes(posts, comments, Replay(replies)).count() == posts.count()


def test_replay_needs_no_python(spark):
    posts, comments = frames(spark)
    responses = spark.createDataFrame([], "post_id string, stage string, reply string")
    outcomes = condense_outcomes(posts, comments, Replay(responses))
    plan = outcomes._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "BatchEvalPython" not in plan
    assert {r["error"] for r in outcomes.collect()} == {"no reply known"}


def test_copies_of_a_post_count_once(spark):
    posts, comments = frames(spark)
    results = condense(posts.union(posts), comments, FunctionModel(make_model()))
    assert results.count() == 4
