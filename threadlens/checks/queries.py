"""Every operator as a query over the given tables."""

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.checks import views
from threadlens.functions import prompts as P
from threadlens.functions import replies as R
from threadlens.functions import text as X
from threadlens.operators.decision import decide
from threadlens.operators.models import FunctionModel, Replay
from threadlens.operators.progress import pending, totals
from threadlens.operators.ranking import top_overall, top_per_community
from threadlens.operators.threads import join_threads, thread_texts
from threadlens.operators.tree import flatten
from threadlens.plans.condense import condense, condense_outcomes
from threadlens.plans.ingest import ingest_comments, ingest_posts
from threadlens.sinks.csv import write_condensed, write_threads
from threadlens.schemas import CONDENSED, POSTS
from threadlens.sources.csv import READ_OPTIONS, missing_communities, read_threads
from threadlens.sources.dumps import (
    read_comments,
    read_submissions,
    stream_posts,
    stream_submissions,
)
from threadlens.storage import new_folder, stored
from threadlens.streaming.buckets import deal_out
from threadlens.streaming.incremental import condense_incremental, dead_letter

TOP_PER_COMMUNITY = 3
TOP_SINGLE = 50
TOP_LARGE = 2000


def normalize_ascii(spark: SparkSession, sf: str) -> DataFrame:
    return views.posts(spark, sf).select(
        "post_id",
        X.normalize_ascii(F.col("title")).alias("title"),
        X.normalize_ascii(F.col("self_text")).alias("self_text"),
    )


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return views.posts(spark, sf).select(
        "post_id",
        X.normalize_text(F.col("title")).alias("title"),
        X.normalize_text(F.col("self_text")).alias("self_text"),
    )


def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    return views.posts(spark, sf).select(
        "post_id", X.extract_links(F.col("self_text")).alias("links")
    )


def extract_links_comments(spark: SparkSession, sf: str) -> DataFrame:
    return views.comments(spark, sf).select(
        "comment_id", X.extract_links(F.col("body")).alias("links")
    )


def post_type(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.table(spark, sf, "pages")
    return pages.select("page_id", X.post_type(F.col("url")).alias("post_type"))


def ingest_posts_all(spark: SparkSession, sf: str) -> DataFrame:
    return ingest_posts(views.raw_submissions(spark, sf))


def ingest_posts_top(spark: SparkSession, sf: str) -> DataFrame:
    return ingest_posts(views.raw_submissions(spark, sf), limit=TOP_PER_COMMUNITY)


def top_posts_single(spark: SparkSession, sf: str) -> DataFrame:
    return top_overall(views.posts(spark, sf), TOP_SINGLE).select("post_id", "upvotes")


def top_posts_large(spark: SparkSession, sf: str) -> DataFrame:
    posts = views.view(spark, sf, views.ORDER_POSTS)
    return top_per_community(posts, TOP_LARGE).select("community", "post_id", "upvotes")


def ingest_comments_kept(spark: SparkSession, sf: str) -> DataFrame:
    posts = ingest_posts(views.raw_submissions(spark, sf))
    return ingest_comments(views.raw_comments(spark, sf), posts)


def flatten_tree(spark: SparkSession, sf: str) -> DataFrame:
    return flatten(views.comments(spark, sf)).select(
        "post_id", "comment_id", "depth", "seq"
    )


def thread_text(spark: SparkSession, sf: str) -> DataFrame:
    posts = views.posts(spark, sf).select("post_id")
    return join_threads(posts, views.comments(spark, sf)).select(
        "post_id", "has_comments", "body_text"
    )


def thread_text_orders(spark: SparkSession, sf: str) -> DataFrame:
    posts = views.view(spark, sf, views.ORDER_POSTS).select("post_id")
    lines = views.view(spark, sf, views.LINE_COMMENTS)
    return join_threads(posts, lines).select("post_id", "has_comments", "body_text")


def thread_text_long(spark: SparkSession, sf: str) -> DataFrame:
    return thread_texts(views.view(spark, sf, views.LONG_THREADS))


def analysis_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return views.posts(spark, sf).select(
        "post_id", P.analysis_prompt(F.col("title"), F.col("self_text")).alias("prompt")
    )


def _analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Analysis replies read as objects; unreadable ones are null."""
    responses = views.responses(spark, sf).filter("stage = 'analysis'")
    return responses.select(
        "post_id", R.reply_object(F.col("reply")).alias("reply")
    )


def _issues(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.col("reply")
    return (
        _analysis(spark, sf)
        .filter(reply.isNotNull() & R.valid_issue(reply))
        .select(
            "post_id",
            R.as_text(R.key(reply, "user_complaint")).alias("user_complaint"),
            R.as_text(R.key(reply, "diagnosis")).alias("diagnosis"),
            R.relevance(reply).alias("cybersecurity_relevance"),
        )
    )


def valid_issues(spark: SparkSession, sf: str) -> DataFrame:
    return _issues(spark, sf)


def generalize_prompt(spark: SparkSession, sf: str) -> DataFrame:
    low = R.low_relevance(F.col("cybersecurity_relevance"))
    return (
        _issues(spark, sf)
        .filter(low)
        .select("post_id", P.generalize_prompt(F.col("user_complaint")).alias("prompt"))
    )


def answer_prompt(spark: SparkSession, sf: str) -> DataFrame:
    threads = join_threads(_issues(spark, sf), views.comments(spark, sf))
    return threads.filter("has_comments").select(
        "post_id",
        P.answer_prompt(
            F.col("user_complaint"), F.col("diagnosis"), F.col("body_text")
        ).alias("prompt"),
    )


def generalized_complaints(spark: SparkSession, sf: str) -> DataFrame:
    low = R.low_relevance(F.col("cybersecurity_relevance"))
    asked = Replay(views.responses(spark, sf)).attach(
        _issues(spark, sf), "generalize", F.col("user_complaint"), low
    )
    return asked.select(
        "post_id",
        "cybersecurity_relevance",
        F.when(low, F.col("generalize_reply"))
        .otherwise(F.col("user_complaint"))
        .alias("user_complaint"),
    )


def answer_decision(spark: SparkSession, sf: str) -> DataFrame:
    replies = views.responses(spark, sf).filter("stage = 'answer'")
    return decide(replies, F.col("reply")).select(
        "post_id", "solution", "recommendation", "steps", "confidence"
    )


def _condense(spark: SparkSession, sf: str) -> DataFrame:
    return condense(
        views.posts(spark, sf),
        views.comments(spark, sf),
        Replay(views.responses(spark, sf)),
    )


def condense_outcomes_all(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = condense_outcomes(
        views.posts(spark, sf),
        views.comments(spark, sf),
        Replay(views.responses(spark, sf)),
    )
    return outcomes.select("post_id", "status", "stage", "error")


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of an earlier run that took the posts that have comments."""
    discussed = views.comments(spark, sf).select("post_id").distinct()
    outcomes = condense_outcomes(
        views.posts(spark, sf).join(discussed, "post_id", "left_semi"),
        views.comments(spark, sf),
        Replay(views.responses(spark, sf)),
    )
    return outcomes.select("post_id", "status")


def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    posts = views.posts(spark, sf).select("post_id", "community")
    return pending(posts, _ledger(spark, sf))


def processing_totals(spark: SparkSession, sf: str) -> DataFrame:
    return totals(views.posts(spark, sf), _ledger(spark, sf))


def union_results(spark: SparkSession, sf: str) -> DataFrame:
    posts, comments = views.posts(spark, sf), views.comments(spark, sf)
    backend = Replay(views.responses(spark, sf))
    discussed = comments.select("post_id").distinct()
    earlier = posts.join(discussed, "post_id", "left_semi")
    later = posts.join(discussed, "post_id", "left_anti")
    return condense(earlier, comments, backend).unionByName(
        condense(later, comments, backend)
    )


def _measuring_backend() -> FunctionModel:
    """A stand-in model whose replies follow from the length of the prompt."""
    levels = ("High", "Medium", "Low", "None")

    def answer(n: int) -> str:
        return json.dumps(
            {
                "Answer": f"answer {n}",
                "Steps": f"{n} steps",
                "Confidence": (90 + n % 10) / 100,
                "Is_Solution": n % 2 == 0,
            }
        )

    def analysis(n: int) -> str:
        return json.dumps(
            {
                "user_complaint": f"complaint {n}",
                "diagnosis": -1000 if n % 5 == 0 else f"diagnosis {n}",
                "cybersecurity_relevance": levels[n % 4],
            }
        )

    stages = {
        P.ANALYSIS_INSTRUCTION: analysis,
        P.GENERALIZE_INSTRUCTION: lambda n: f"general {n}",
        P.ANSWER_INSTRUCTION: answer,
    }

    def model(instruction: str, prompts: list[str]) -> list[str]:
        return [stages[instruction](len(prompt)) for prompt in prompts]

    return FunctionModel(model)


def condense_callable(spark: SparkSession, sf: str) -> DataFrame:
    return condense(
        views.posts(spark, sf), views.comments(spark, sf), _measuring_backend()
    )


def _as_files(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly into files: as many as shuffles have partitions, four at least.
    With a fixed number the share of a task would grow with the table."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(4, usual))


def _half(arrived: DataFrame) -> int:
    """How many files make a batch, so that there are two."""
    return max(1, -(-len(arrived.inputFiles()) // 2))


def condense_incremental_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Posts arrive as files of a stream; a second start finds nothing to do."""
    arriving, out = new_folder(spark, "arriving"), new_folder(spark, "incremental")
    _as_files(ingest_posts(views.raw_submissions(spark, sf), min_comments=-1)).write.parquet(arriving)
    half = _half(spark.read.schema(POSTS).parquet(arriving))
    comments = views.comments(spark, sf)
    backend = Replay(views.responses(spark, sf))
    for _ in range(2):
        posts = stream_posts(spark, arriving, files_per_batch=half)
        done = condense_incremental(posts, comments, backend, out)
    return done


def condense_incremental_table(spark: SparkSession, sf: str) -> DataFrame:
    """A first run takes part of the posts, a second one all of them, in chunks."""
    out = new_folder(spark, "incremental")
    posts, comments = views.posts(spark, sf), views.comments(spark, sf)
    backend = _measuring_backend()
    discussed = comments.select("post_id").distinct()
    condense_incremental(
        posts.join(discussed, "post_id", "left_semi"), comments, backend, out
    )
    half = -(-posts.count() // 2)
    return condense_incremental(posts, comments, backend, out, chunk_rows=half)


def condense_incremental_dealt(spark: SparkSession, sf: str) -> DataFrame:
    """Comments are dealt into buckets; each of three batches reads its share of them."""
    out = new_folder(spark, "incremental")
    posts, comments = views.posts(spark, sf), deal_out(views.comments(spark, sf), new_folder(spark, "dealt"), 64)
    third = -(-posts.count() // 3)
    return condense_incremental(posts, comments, _measuring_backend(), out, chunk_rows=third)


def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    out = new_folder(spark, "incremental")
    condense_incremental(
        views.posts(spark, sf),
        views.comments(spark, sf),
        Replay(views.responses(spark, sf)),
        out,
    )
    return dead_letter(spark, out).select("post_id", "stage", "error")


def _refusing_answers() -> FunctionModel:
    """The stand-in model, but it refuses every third answer by the prompt's length."""
    model = _measuring_backend()
    reply, stage = model.function, P.ANSWER_INSTRUCTION

    def refuse(instruction: str, prompts: list[str]) -> list[str]:
        if instruction == stage and any(len(prompt) % 3 == 0 for prompt in prompts):
            raise ValueError("refused")
        return reply(instruction, prompts)

    return replace(model, function=refuse)


def _refused(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Posts arrive as files and some answers fail."""
    arriving, out = new_folder(spark, "arriving"), new_folder(spark, "incremental")
    _as_files(ingest_posts(views.raw_submissions(spark, sf), min_comments=-1)).write.parquet(arriving)
    posts = stream_posts(spark, arriving)
    condense_incremental(posts, views.comments(spark, sf), _refusing_answers(), out)
    return arriving, out


def dead_letter_answers(spark: SparkSession, sf: str) -> DataFrame:
    return dead_letter(spark, _refused(spark, sf)[1]).select("post_id", "stage", "error", "rounds")


def retry_answers(spark: SparkSession, sf: str) -> DataFrame:
    """A second start of the stream reads no file and asks for failed answers only."""
    arriving, out = _refused(spark, sf)
    posts, model = stream_posts(spark, arriving), _measuring_backend()
    return condense_incremental(posts, views.comments(spark, sf), model, out, retry_failed=True)


def _written_threads(spark: SparkSession, sf: str) -> str:
    base = new_folder(spark, "threads")
    posts = stored(ingest_posts(views.raw_submissions(spark, sf)), "posts")
    comments = ingest_comments(views.raw_comments(spark, sf), posts)
    write_threads(posts, comments, base)
    return base


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return read_threads(spark, _written_threads(spark, sf))[0]


def csv_roundtrip_comments(spark: SparkSession, sf: str) -> DataFrame:
    return read_threads(spark, _written_threads(spark, sf))[1]


def csv_backup(spark: SparkSession, sf: str) -> DataFrame:
    return read_threads(spark, _written_threads(spark, sf) + "_backup")[0]


def csv_condensed(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "condensed")
    write_condensed(_condense(spark, sf), path)
    return spark.read.schema(CONDENSED).options(**READ_OPTIONS).csv(path)


def csv_missing_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Sources and languages are asked for; only sources are communities."""
    documents = views.table(spark, sf, "documents")
    asked = documents.select(F.explode(F.array("source", "lang")).alias("name"))
    # Stands for the list of names a user types.
    names = [row["name"] for row in asked.distinct().collect()]
    return missing_communities(spark, _written_threads(spark, sf), names)


def ingest_json(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "submissions")
    views.raw_submissions(spark, sf).write.json(path)
    return ingest_posts(read_submissions(spark, path))


def ingest_json_comments(spark: SparkSession, sf: str) -> DataFrame:
    base = new_folder(spark, "dump")
    views.raw_submissions(spark, sf).write.parquet(f"{base}/submissions")
    views.raw_comments(spark, sf).write.json(f"{base}/comments")
    posts = ingest_posts(read_submissions(spark, f"{base}/submissions", "parquet"))
    return ingest_comments(read_comments(spark, f"{base}/comments"), posts)


def ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    base = new_folder(spark, "stream")
    _as_files(views.raw_submissions(spark, sf)).write.json(f"{base}/arriving")
    half = _half(read_submissions(spark, f"{base}/arriving"))
    arriving = stream_submissions(spark, f"{base}/arriving", files_per_batch=half)
    ingest_posts(arriving).writeStream.format("parquet").option(
        "checkpointLocation", f"{base}/progress"
    ).trigger(availableNow=True).start(f"{base}/posts").awaitTermination()
    return spark.read.parquet(f"{base}/posts")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "normalize_ascii": normalize_ascii,
    "normalize_text": normalize_text,
    "extract_links": extract_links,
    "extract_links_comments": extract_links_comments,
    "post_type": post_type,
    "ingest_posts": ingest_posts_top,
    "ingest_posts_all": ingest_posts_all,
    "top_posts_single": top_posts_single,
    "top_posts_large": top_posts_large,
    "ingest_comments": ingest_comments_kept,
    "flatten_tree": flatten_tree,
    "thread_text": thread_text,
    "thread_text_orders": thread_text_orders,
    "thread_text_long": thread_text_long,
    "analysis_prompt": analysis_prompt,
    "generalize_prompt": generalize_prompt,
    "answer_prompt": answer_prompt,
    "valid_issues": valid_issues,
    "generalized_complaints": generalized_complaints,
    "answer_decision": answer_decision,
    "condense": _condense,
    "condense_outcomes": condense_outcomes_all,
    "resume_pending": resume_pending,
    "processing_totals": processing_totals,
    "union_results": union_results,
    "condense_callable": condense_callable,
    "condense_incremental": condense_incremental_stream,
    "condense_incremental_table": condense_incremental_table,
    "condense_incremental_dealt": condense_incremental_dealt,
    "dead_letter": dead_letters,
    "dead_letter_answers": dead_letter_answers,
    "retry_answers": retry_answers,
    "csv_roundtrip": csv_roundtrip,
    "csv_roundtrip_comments": csv_roundtrip_comments,
    "csv_backup": csv_backup,
    "csv_condensed": csv_condensed,
    "csv_missing_communities": csv_missing_communities,
    "ingest_json": ingest_json,
    "ingest_json_comments": ingest_json_comments,
    "ingest_stream": ingest_stream,
}
