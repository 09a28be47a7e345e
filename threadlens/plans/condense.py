"""From posts and comments to one condensed row per post."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions import replies as R
from threadlens.functions.prompts import (
    analysis_prompt,
    answer_prompt,
    generalize_prompt,
)
from threadlens.operators.copies import each_once
from threadlens.operators.decision import decide
from threadlens.operators.models import FunctionModel, Replay
from threadlens.operators.threads import threads_for_prompts
from threadlens.schemas import CONDENSED, OUTCOMES
from threadlens.storage import stored

Backend = FunctionModel | Replay

_BEFORE_ANSWER = [
    "post_id",
    "round",
    "created_time",
    "user_complaint",
    "diagnosis",
    "cybersecurity_relevance",
    "status",
    "stage",
    "error",
    "attempts",
]


def condense(posts: DataFrame, comments: DataFrame, backend: Backend) -> DataFrame:
    """The nine result columns for every post with a real issue."""
    return successes(condense_outcomes(posts, comments, backend))


def successes(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("status") == "ok").select(*CONDENSED.names)


def condense_outcomes(
    posts: DataFrame, comments: DataFrame, backend: Backend
) -> DataFrame:
    """One row per post, whatever became of it.

    `status` is `ok`, `no_issue` or `failed`. A failed analysis or rewording
    fails the post; a failed answer leaves it with the default answer, and
    `answer_status` tells so. `stage`, `error` and `attempts` tell of the stage that
    failed, or of the last one.
    """
    return outcomes_of_distinct(each_once(posts, ["post_id"]), comments, backend)


def outcomes_of_distinct(
    posts: DataFrame, comments: DataFrame, backend: Backend
) -> DataFrame:
    """`condense_outcomes` for posts known to be there once."""
    rows = with_round(posts).withColumn("created_time", F.col("created_utc"))
    rows = _generalised(_analysed(rows, backend), backend)
    if backend.reads_prompts:
        # Two more things start from here, and the joins above are behind us.
        rows = stored(rows, "issues")
    return _answered(rows, comments, backend).select(*OUTCOMES.names)


def outcomes_from(rows: DataFrame, stage: str, comments: DataFrame, backend: Backend) -> DataFrame:
    """Outcomes of posts that failed before in `stage`: `generalize` or `answer`.

    `rows` are their failed outcomes with `round`, as a stored table; what the stages
    before said is taken from there.
    """
    known = rows.withColumns(
        {
            "status": F.lit("ok"),
            "stage": F.lit(stage),
            "error": F.lit(None).cast("string"),
            "attempts": F.lit(None).cast("int"),
        }
    ).select(*_BEFORE_ANSWER)
    if stage == "generalize":
        known = _generalised(known, backend)
        if backend.reads_prompts:
            known = stored(known, "issues")
    return _answered(known, comments, backend).select(*OUTCOMES.names)


def with_round(posts: DataFrame) -> DataFrame:
    """`round` counts the earlier runs in which a post failed."""
    if "round" in posts.columns:
        return posts
    return posts.withColumn("round", F.lit(0))


def _analysed(posts: DataFrame, backend: Backend) -> DataFrame:
    asked = backend.attach(
        posts,
        "analysis",
        analysis_prompt(F.col("title"), F.col("self_text")),
        F.lit(True),
    )
    reply = F.col("_reply")
    unreadable = F.coalesce(
        "analysis_error", F.lit("reply is not a JSON object")
    )
    return (
        asked.withColumn("_reply", R.reply_object(F.col("analysis_reply")))
        .withColumns(
            {
                "user_complaint": R.as_text(R.key(reply, "user_complaint")),
                "diagnosis": R.as_text(R.key(reply, "diagnosis")),
                "cybersecurity_relevance": R.relevance(reply),
                "status": F.when(reply.isNull(), "failed")
                .when(R.valid_issue(reply), "ok")
                .otherwise("no_issue"),
                "stage": F.lit("analysis"),
                "error": F.when(reply.isNull(), unreadable),
                "attempts": F.col("analysis_attempts"),
            }
        )
        # From here on the post's own text is not needed.
        .select(*_BEFORE_ANSWER)
    )


def _generalised(rows: DataFrame, backend: Backend) -> DataFrame:
    low = (F.col("status") == "ok") & R.low_relevance(F.col("cybersecurity_relevance"))
    asked = backend.attach(
        rows, "generalize", generalize_prompt(F.col("user_complaint")), low
    )
    called = F.col("generalize_status").isNotNull()
    return asked.withColumns(
        {
            # A post that fails here keeps its own words for another try.
            "user_complaint": F.when(
                F.col("generalize_status") == "ok", F.col("generalize_reply")
            ).otherwise(F.col("user_complaint")),
            "status": F.when(F.col("generalize_status") == "failed", "failed").otherwise(
                F.col("status")
            ),
            "stage": F.when(called, "generalize").otherwise(F.col("stage")),
            "error": F.coalesce("generalize_error", "error"),
            "attempts": F.coalesce("generalize_attempts", "attempts"),
        }
    ).select(*rows.columns)


def _answered(rows: DataFrame, comments: DataFrame, backend: Backend) -> DataFrame:
    ok = F.col("status") == "ok"
    if backend.reads_prompts:
        # Comments of posts that dropped out are not gathered.
        threads = threads_for_prompts(comments, rows.filter(ok))
    else:
        threads = (
            comments.select("post_id").distinct().withColumn("body_text", F.lit(""))
        )
    threads = threads.withColumn("_commented", F.lit(True))
    joined = rows.join(threads, "post_id", "left")
    has_comments = F.coalesce("_commented", F.lit(False))
    asked = backend.attach(
        joined,
        "answer",
        answer_prompt(
            F.col("user_complaint"), F.col("diagnosis"), F.col("body_text")
        ),
        ok & has_comments,
    )
    called = F.col("answer_status").isNotNull()
    return decide(asked, F.col("answer_reply")).withColumns(
        {
            "stage": F.when(called, "answer").otherwise(F.col("stage")),
            "error": F.coalesce("answer_error", "error"),
            "attempts": F.coalesce("answer_attempts", "attempts"),
        }
    )
