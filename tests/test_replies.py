import json

import pytest
from pyspark.sql import functions as F

from threadlens.functions import replies as R
from threadlens.operators.decision import decide

ANALYSES = [
    '{"user_complaint":-1000,"diagnosis":-1000,"cybersecurity_relevance":"None"}',
    '{"user_complaint":-1000.0,"diagnosis":"d"}',
    '{"user_complaint":"u","cybersecurity_relevance":"High"}',
    '{"user_complaint":"u","diagnosis":null}',
    '{"user_complaint":"u","diagnosis":"d"}',
    '{"user_complaint":"u","diagnosis":"d","cybersecurity_relevance":null}',
    '{"user_complaint":"u","diagnosis":"d","cybersecurity_relevance":"Low"}',
    '{"user_complaint":"u","diagnosis":"d","cybersecurity_relevance":"low"}',
    '{"user_complaint":"-1000","diagnosis":"","cybersecurity_relevance":"High"}',
    '{"user_complaint":true,"diagnosis":"d"}',
    "{}",
    "not json",
    "[1]",
    "",
    None,
    '```json\n{"user_complaint":"u","diagnosis":"d"}\n```',
    'Here it is:\n```\n{"user_complaint":"u","diagnosis":"d"}\n```',
    '{"user_complaint":"use ```x```","diagnosis":"d"}',
]

NUMBERS = ["0.95", "0.949999", "1", "0", "true", "false", "null", '"0.97"', "[1]", None]
ANSWERS = [
    (answer, steps, confidence, solved)
    for answer in ['"a"', '""', "null", '"No relevant answer found"', "5", None]
    for confidence in NUMBERS
    for steps, solved in [
        ('"s"', "true"),
        ('["x","y"]', "1"),
        ("null", '"false"'),
        (None, "false"),
        ('"s"', '""'),
        ('"s"', "0"),
        ('"s"', "[]"),
        ('"s"', "{}"),
        ('"s"', "[0]"),
        ('"s"', "null"),
        ('"s"', None),
    ]
]


def as_object(text):
    if not text:
        return None
    if "```" in text and not text.startswith("{"):
        text = text.split("```")[1].removeprefix("json")
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        return None
    return value if isinstance(value, dict) else None


def shown(value):
    return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"))


def test_valid_issue_and_relevance(spark):
    rows = spark.createDataFrame([(t,) for t in ANALYSES], "t string")
    reply = F.col("reply")
    read = rows.withColumn("reply", R.reply_object(F.col("t"))).select(
        "t",
        reply.isNotNull().alias("readable"),
        R.valid_issue(reply).alias("valid"),
        R.relevance(reply).alias("level"),
        R.low_relevance(R.relevance(reply)).alias("low"),
    )
    for row in read.collect():
        value = as_object(row["t"])
        assert row["readable"] == (value is not None), row
        if value is None:
            continue
        u, d = value.get("user_complaint"), value.get("diagnosis")
        assert row["valid"] == (u is not None and d is not None and u != -1000 and d != -1000), row
        level = value.get("cybersecurity_relevance", "None")
        assert row["level"] == level
        assert row["low"] == (level in ("Low", "None"))


def plain_decision(value):
    nothing = ("-999", "-999", "No steps", 0.0)
    if value is None:
        return nothing
    answer = value.get("Answer", "No relevant answer found")
    confidence = value.get("Confidence", 0)
    if answer == "No relevant answer found" or not isinstance(confidence, (int, float)):
        return nothing
    sure = confidence >= 0.95
    if sure and value.get("Is_Solution", False):
        picked = (shown(answer), "-999")
    else:
        picked = ("-999", shown(answer))
    return (*picked, shown(value.get("Steps", "No steps")) if sure else "No steps", float(confidence))


def test_decisions(spark):
    texts = [None, "oops", "[]", "{}"]
    for answer, steps, confidence, solved in ANSWERS:
        keys = {"Answer": answer, "Steps": steps, "Confidence": confidence, "Is_Solution": solved}
        texts.append("{" + ",".join(f'"{k}":{v}' for k, v in keys.items() if v is not None) + "}")
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in decide(rows, F.col("t")).collect():
        got = tuple(row[c] for c in ("solution", "recommendation", "steps", "confidence"))
        assert got == plain_decision(as_object(row["t"])), row["t"]


@pytest.mark.parametrize("value, truth", [("1.5", True), ("-0.0", False), ('{"a":0}', True), ("true", True)])
def test_truth(spark, value, truth):
    row = spark.createDataFrame([(f'{{"k":{value}}}',)], "t string")
    reply = R.reply_object(F.col("t"))
    assert row.select(R.truthy(R.key(reply, "k"))).first()[0] is truth
