"""From an answer reply to solution, recommendation, steps and confidence."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions import replies as R

# Fixed values.
NO_ANSWER = "No relevant answer found"
NO_STEPS = "No steps"
NOTHING = "-999"
SURE = 0.95


def decide(rows: DataFrame, reply: Column) -> DataFrame:
    """Add the four answer columns.

    `reply` is the text of the model's reply, null where there was no call or it
    failed. Such rows get the default answer, and so do replies without a usable
    answer or with a confidence that is not a number. Otherwise the answer is a
    solution if the model says so and is sure, and a recommendation if not; steps
    are kept only when it is sure.
    """
    values = rows.withColumn("_object", R.reply_object(reply)).withColumns(
        {
            f"_{name}": R.key(F.col("_object"), name)
            for name in ("Answer", "Steps", "Confidence", "Is_Solution")
        }
    )
    answer, confidence = F.col("_Answer"), F.col("_Confidence")
    level = F.when(confidence.isNull(), F.lit(0.0)).otherwise(R.as_number(confidence))
    # An explicit null is an answer like any other; an absent key is none.
    answered = answer.isNotNull() & F.coalesce(
        R.as_text(answer) != NO_ANSWER, F.lit(True)
    )
    read = values.withColumns(
        {
            "_text": R.as_text(answer),
            "_level": level,
            "_usable": answered & level.isNotNull(),
            "_solved": R.truthy(F.col("_Is_Solution")),
        }
    )
    usable, sure = F.col("_usable"), F.col("_level") >= SURE
    solved = sure & F.col("_solved")
    return read.withColumns(
        {
            "solution": F.when(usable & solved, F.col("_text")).otherwise(NOTHING),
            "recommendation": F.when(usable & ~solved, F.col("_text")).otherwise(NOTHING),
            "steps": F.when(
                usable & sure, R.text_or(F.col("_Steps"), NO_STEPS)
            ).otherwise(NO_STEPS),
            "confidence": F.when(usable, F.col("_level")).otherwise(F.lit(0.0)),
        }
    ).drop(
        "_object", "_Answer", "_Steps", "_Confidence", "_Is_Solution",
        "_text", "_level", "_usable", "_solved",
    )
