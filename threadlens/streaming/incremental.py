"""Runs that can stop anywhere and go on without doing a post twice.

Below `out` there are two tables. `outcomes` holds one row per processed post and
serves as result table, ledger and dead-letter table at once, so that these
cannot disagree. `replies` holds what the model said, written stage by stage, so
that a run cut short before its outcomes are written does not ask again.
Both are only ever appended to, and what to append is found by anti-join on the
post: repeating a batch, whole or in part, adds what is missing and no more.

The outcomes of a run lie in buckets by post, and comments may (`deal_out`): a batch then
reads the buckets of its own posts, and its cost does not grow with what is done.
"""

import logging
import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.operators.copies import each_once, one_of_each
from threadlens.operators.models import FunctionModel
from threadlens.operators.progress import observed, pending
from threadlens.plans.condense import (
    Backend,
    outcomes_from,
    outcomes_of_distinct,
    successes,
)
from threadlens.schemas import (
    OUTCOMES,
    REENTRY,
    RUNS,
    STORED_OUTCOMES,
    STORED_REENTRY,
    STORED_REPLIES,
)
from threadlens.storage import exists, key_side, new_folder, stored, table_or_empty
from threadlens.streaming.buckets import (
    BUCKET,
    Dealt,
    bucket_numbers,
    bucket_of,
    only_buckets,
    with_bucket,
)

log = logging.getLogger(__name__)

# Batches that try again are numbered from here on, out of the way of a stream's own.
RETRIES = 1 << 40
# A post that failed and has not succeeded since, or whose answer has not.
_IS_OPEN = "status = 'failed' or coalesce(answer_status = 'failed', false)"


def condense_incremental(
    posts: DataFrame,
    comments: DataFrame | Dealt,
    backend: Backend,
    out: str,
    fresh: bool = False,
    retry_failed: bool = False,
    chunk_rows: int | None = None,
    buckets: int = 16,
) -> DataFrame:
    """Condense the posts not done yet and return all results of the run.

    `posts` may be a table or a stream of arriving files; a stream is read up to
    what is there and remembers which files it has read. `comments` is joined as
    it stands; of a table that `deal_out` wrote a batch reads its share only. So it does of
    the outcomes, dealt into `buckets` when a run begins: as many as make one a fair read for
    a batch when all is done. A run continues the latest one unless `fresh` starts a new one.
    Failed posts and failed answers are left alone unless `retry_failed`: then all of the
    run are tried once more, before any new post, whether `posts` holds them or not. With `chunk_rows` a table
    is worked off in chunks of about that many posts, each saved on its own; a
    stream is chunked by its files per batch.
    """
    spark = posts.sparkSession
    run = _begin(spark, out, fresh, buckets)
    first = _latest_batch(outcomes(spark, out, run).filter(F.col("batch") < RETRIES)) + 1
    if isinstance(backend, FunctionModel):
        # Replies of batches after the last finished one stem from a run cut short.
        folder = f"{out}/replies/run={run}"
        replies = table_or_empty(spark, folder, STORED_REPLIES)
        last = _latest_batch(replies.filter(F.col("batch") < RETRIES))
        backend = replace(backend, folder=folder, earlier=(first, last))
    if retry_failed:
        _retry(spark, comments, backend, out, run)

    def step(batch: DataFrame, number: int) -> None:
        _condense_batch(batch, comments, backend, out, run, number, False)

    if posts.isStreaming:
        query = (
            posts.writeStream.foreachBatch(step)
            .option("checkpointLocation", f"{out}/_progress/run={run}")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    else:
        for number, chunk in enumerate(_chunks(posts, chunk_rows), first):
            step(chunk, number)
    return results(spark, out, run)


def outcomes(spark: SparkSession, out: str, run: int | None = None) -> DataFrame:
    """Every processed post of a run, by default of the latest."""
    run = _latest_run(spark, out) if run is None else run
    return _stored_outcomes(spark, out, run, _dealt(spark, out, run)).drop(BUCKET)


def results(spark: SparkSession, out: str, run: int | None = None) -> DataFrame:
    """The condensed rows of a run, one per post: a later answer takes the place of the
    default that stood for a failed one."""
    done = outcomes(spark, out, run).filter(F.col("status") == "ok")
    again = done.filter(F.col("batch") >= RETRIES)
    if again.isEmpty():
        return successes(done)
    latest = stored(again.groupBy("post_id").agg(F.max("batch").alias("_latest")), "retried")
    return successes(
        done.join(key_side(latest), "post_id", "left").filter(
            F.col("_latest").isNull() | (F.col("batch") == F.col("_latest"))
        )
    )


def ledger(spark: SparkSession, out: str, run: int | None = None) -> DataFrame:
    """One row per processed post: `post_id, status, answer_status, failures`.

    A post that failed and succeeded later is done, and so is its answer; `failures`
    counts how often one of its stages failed before.
    """
    return _states(outcomes(spark, out, run)).select("post_id", "status", "answer_status", "failures")


def dead_letter(spark: SparkSession, out: str, run: int | None = None) -> DataFrame:
    """Posts that failed, whole or in their answer, and have not succeeded since, with
    their last error."""
    return (
        _states(outcomes(spark, out, run))
        .filter(_IS_OPEN)
        .select("post_id", "last.*", F.col("failures").cast("long").alias("rounds"))
    )


def _states(done: DataFrame) -> DataFrame:
    """What the outcomes of each post come to."""
    failed = F.col("status") == "failed"
    any_failed = failed | F.coalesce(F.col("answer_status") == "failed", F.lit(False))
    answer = F.max_by(F.struct("answer_status"), F.when(F.col("status") == "ok", F.col("batch")))
    last = F.max_by(F.struct("stage", "error", "attempts"), F.when(any_failed, F.col("batch")))
    return (
        done.groupBy("post_id")
        .agg(
            F.max_by("status", ~failed).alias("status"),
            answer.alias("_answer"),
            F.count_if(any_failed).cast("int").alias("failures"),
            last.alias("last"),
        )
        .withColumn("answer_status", F.col("_answer.answer_status"))
        .drop("_answer")
    )


def _condense_batch(
    posts: DataFrame,
    comments: DataFrame | Dealt,
    backend: Backend,
    out: str,
    run: int,
    batch: int,
    retry_failed: bool,
) -> None:
    spark = posts.sparkSession
    dealt = _dealt(spark, out, run)
    known = _states(_outcomes_near(posts, out, run, dealt))
    # Stored, as every stage below starts from it.
    needed = each_once(posts.select(*REENTRY.names), ["post_id"])
    todo = stored(_with_rounds(needed, known, retry_failed), "todo")
    if isinstance(backend, FunctionModel):
        backend = replace(backend, batch=batch)
    rows = outcomes_of_distinct(todo, _share(comments, todo), backend)
    _keep(spark, rows, todo.select(*REENTRY.names), out, run, batch, dealt)


def _keep(
    spark: SparkSession,
    rows: DataFrame,
    todo: DataFrame | None,
    out: str,
    run: int,
    batch: int,
    dealt: int | None,
) -> None:
    """Append the outcomes of a batch; before them, the text of posts that failed.

    In this order, as posts with an outcome are not looked at again: a batch cut short
    in between repeats both.
    """
    rows, counter = observed(rows, f"condense-{run}-{batch}")
    rows = stored(rows, "outcomes")
    counts = counter.get
    if counts["failed"] and todo is not None:
        failed = rows.filter(F.col("status") == "failed").select("post_id")
        texts = todo.join(failed, "post_id", "left_semi").select(*REENTRY.names)
        texts.write.mode("append").parquet(f"{out}/reentry/run={run}/batch={batch}")
    if dealt is None:
        writer = rows.write
    else:
        writer = rows.withColumn(BUCKET, bucket_of(F.col("post_id"), dealt)).hint("rebalance", BUCKET).write.partitionBy(BUCKET)
    writer.mode("append").parquet(f"{out}/outcomes/run={run}/batch={batch}")
    log.info("run %s, batch %s: %s", run, batch, counts)


def _retry(spark: SparkSession, comments: DataFrame | Dealt, backend: Backend, out: str, run: int) -> None:
    """Try once more what failed in a run, as a batch of its own.

    A retry cut short leaves its replies under the number that the next one takes.
    """
    done = outcomes(spark, out, run)
    number = max(RETRIES - 1, _latest_batch(done)) + 1
    if isinstance(backend, FunctionModel):
        backend = replace(backend, batch=number, earlier=(0, -1))
    again = stored(
        _states(done)
        .filter(_IS_OPEN)
        .select("post_id", F.col("failures").alias("round"), F.col("last.stage").alias("_from")),
        "again",
    )
    comments = _share(comments, again)
    # The last outcome of each has what the stages before the failed one said.
    latest = F.max_by(F.struct(*[c for c in OUTCOMES.names if c != "post_id"]), "batch").alias("_row")
    failed = stored(
        done.join(again, "post_id").groupBy("post_id", "round", "_from").agg(latest)
        .select("post_id", "round", "_from", "_row.*"),
        "failed",
    )
    kept = table_or_empty(spark, f"{out}/reentry", STORED_REENTRY).filter(F.col("run") == run)
    whole = again.filter(F.col("_from") == "analysis").select("post_id", "round")
    texts = stored(one_of_each(kept.join(whole, "post_id").select(*REENTRY.names, "round"), ["post_id"]), "reentry")
    parts = [] if texts.isEmpty() else [outcomes_of_distinct(texts, comments, backend)]
    for stage in ("generalize", "answer"):
        rows = failed.filter(F.col("_from") == stage)
        if not rows.isEmpty():
            parts.append(outcomes_from(rows, stage, comments, backend))
    if parts:
        _keep(spark, reduce(DataFrame.unionByName, parts), None, out, run, number, _dealt(spark, out, run))


def _with_rounds(posts: DataFrame, known: DataFrame, retry_failed: bool) -> DataFrame:
    """Posts still to do; `round` counts the failures they have behind them.

    Replies are kept by post and round, so a retry asks the model anew and a
    restarted retry does not.
    """
    if not retry_failed:
        return pending(posts, known)
    failed = F.col("status") == "failed"
    failures = known.filter(failed).select("post_id", F.col("failures").alias("round"))
    return (
        pending(posts, known.filter(~failed))
        .join(failures, "post_id", "left")
        .withColumn("round", F.coalesce("round", F.lit(0)))
    )


def _chunks(posts: DataFrame, chunk_rows: int | None) -> list[DataFrame]:
    if chunk_rows is None:
        return [posts]
    spark = posts.sparkSession
    count = max(1, math.ceil(posts.count() / chunk_rows))
    path = new_folder(spark, "chunks")
    # Dealt out by chunk first: a chunk is a few files, not one from every task.
    chunked = posts.withColumn("_chunk", F.pmod(F.xxhash64("post_id"), F.lit(count)))
    chunked.hint("rebalance", "_chunk").write.partitionBy("_chunk").parquet(path)
    split = spark.read.parquet(path)
    return [split.filter(F.col("_chunk") == i).drop("_chunk") for i in range(count)]


def _share(comments: DataFrame | Dealt, posts: DataFrame) -> DataFrame:
    """The comments to look through for stored posts."""
    return comments.share(posts) if isinstance(comments, Dealt) else comments


def _stored_outcomes(spark: SparkSession, out: str, run: int | None, dealt: int | None) -> DataFrame:
    schema = STORED_OUTCOMES if dealt is None else with_bucket(STORED_OUTCOMES)
    rows = table_or_empty(spark, f"{out}/outcomes/run={run}", schema)
    return rows.withColumn("run", F.lit(run).cast("int"))


def _outcomes_near(posts: DataFrame, out: str, run: int, dealt: int | None) -> DataFrame:
    """The outcomes of a run in the buckets that the posts fall in."""
    spark = posts.sparkSession
    done = _stored_outcomes(spark, out, run, dealt)
    # The first batch of a run has nothing to look up.
    if dealt is None or not exists(spark, f"{out}/outcomes/run={run}"):
        return done.drop(BUCKET)
    return only_buckets(done, bucket_numbers(posts, dealt), dealt).drop(BUCKET)


def _latest_run(spark: SparkSession, out: str) -> int | None:
    return table_or_empty(spark, f"{out}/runs", RUNS).agg(F.max("run")).first()[0]


def _dealt(spark: SparkSession, out: str, run: int | None) -> int | None:
    """How many buckets the outcomes of a run are dealt into, if any."""
    begun = table_or_empty(spark, f"{out}/runs", RUNS).filter(F.col("run").eqNullSafe(F.lit(run)))
    return begun.agg(F.max("buckets")).first()[0]


def _begin(spark: SparkSession, out: str, fresh: bool, buckets: int) -> int:
    """The run to continue; a new one is noted before any work is done for it."""
    latest = _latest_run(spark, out)
    if latest is not None and not fresh:
        return latest
    run = 0 if latest is None else latest + 1
    spark.createDataFrame([(run, buckets)], RUNS).write.mode("append").parquet(f"{out}/runs")
    return run


def _latest_batch(rows: DataFrame) -> int:
    latest = rows.agg(F.max("batch")).first()[0]
    return -1 if latest is None else latest
