"""From raw submissions and comments to the two stored tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.text import extract_links, normalize_ascii, post_type
from threadlens.operators.copies import each_once
from threadlens.operators.ranking import top_per_community
from threadlens.operators.tree import listed
from threadlens.storage import BROADCAST_KEYS, stored


def ingest_posts(
    submissions: DataFrame, min_comments: int = 1, limit: int | None = None
) -> DataFrame:
    """Posts with more than `min_comments` comments, text normalised.

    With `limit`, the best-rated that many of each community, counted after the
    filter. Without it the job is a filter and a projection, and also runs on
    streams.
    """
    kept = submissions.filter(F.col("num_comments") > min_comments).withColumnsRenamed(
        {"id": "post_id", "score": "upvotes"}
    )
    if limit is not None:
        kept = top_per_community(kept, limit)
    return kept.select(
        "post_id",
        normalize_ascii(F.col("title")).alias("title"),
        normalize_ascii(F.col("selftext")).alias("self_text"),
        post_type(F.col("url")).alias("post_type"),
        "upvotes",
        "num_comments",
        F.col("author.name").alias("author"),
        "created_utc",
        extract_links(F.col("selftext")).alias("links"),
        "community",
    )


def ingest_comments(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Comments of the given posts, text normalised, each with its place `seq`.

    The tree is walked on ids alone; texts join its result once, and are not
    shuffled for it where only few comments are wanted. Of several rows of one comment the
    one whose columns are largest counts, and its place is the least. `posts` is read while the
    walk starts: hand in a stored table rather than a dear plan.
    """
    named = comments.withColumnRenamed("id", "comment_id")
    ids = stored(
        named.select("post_id", "comment_id", "parent_id", "pos").join(
            posts.select("post_id"), "post_id", "left_semi"
        ),
        "wanted-comments",
    )
    listing, found = listed(ids)
    listing = listing.select("post_id", "comment_id", "seq")
    if found <= BROADCAST_KEYS:
        listing = F.broadcast(listing)
    if found < ids.count():
        named = each_once(named, ["post_id", "comment_id"])
    return named.join(listing, ["post_id", "comment_id"]).select(
        "post_id",
        "comment_id",
        normalize_ascii(F.col("body")).alias("body"),
        "score",
        "created_utc",
        F.col("author.name").alias("author"),
        extract_links(F.col("body")).alias("links"),
        "seq",
    )
