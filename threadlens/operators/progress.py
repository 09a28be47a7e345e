"""Counting what is done and what is left."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

STATUSES = ("ok", "no_issue", "failed")


def status_counts() -> list:
    return [
        F.count("*").alias("processed"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
    ]


def observed(outcomes: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count outcomes by status while some other action runs over them."""
    counter = Observation(name)
    return outcomes.observe(counter, *status_counts()), counter


def pending(posts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Posts the ledger does not hold."""
    return posts.join(ledger.select("post_id"), "post_id", "left_anti")


def totals(posts: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: posts in all, processed by status, pending."""
    marked = posts.select("post_id").join(
        ledger.select("post_id", "status"), "post_id", "left"
    )
    done = F.count_if(F.col("status").isNotNull())
    return marked.agg(
        F.count("*").alias("total_posts"),
        done.alias("processed"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        (F.count("*") - done).alias("pending"),
    )
