"""Explicit schemas of every table the engine reads or writes."""

from pyspark.sql import types as T

_AUTHOR = T.StructType([T.StructField("name", T.StringType())])

RAW_SUBMISSIONS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("selftext", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("score", T.LongType()),
        T.StructField("num_comments", T.LongType()),
        T.StructField("author", _AUTHOR),
        T.StructField("created_utc", T.DoubleType()),
        T.StructField("community", T.StringType()),
    ]
)

RAW_COMMENTS = T.StructType(
    [
        T.StructField("post_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("body", T.StringType()),
        T.StructField("score", T.LongType()),
        T.StructField("author", _AUTHOR),
        T.StructField("created_utc", T.DoubleType()),
    ]
)

POSTS = T.StructType(
    [
        T.StructField("post_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("self_text", T.StringType()),
        T.StructField("post_type", T.StringType()),
        T.StructField("upvotes", T.LongType()),
        T.StructField("num_comments", T.LongType()),
        T.StructField("author", T.StringType()),
        T.StructField("created_utc", T.DoubleType()),
        T.StructField("links", T.StringType()),
        T.StructField("community", T.StringType()),
    ]
)

COMMENTS = T.StructType(
    [
        T.StructField("post_id", T.StringType()),
        T.StructField("comment_id", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("score", T.LongType()),
        T.StructField("created_utc", T.DoubleType()),
        T.StructField("author", T.StringType()),
        T.StructField("links", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)

CONDENSED = T.StructType(
    [
        T.StructField("post_id", T.StringType()),
        T.StructField("created_time", T.DoubleType()),
        T.StructField("user_complaint", T.StringType()),
        T.StructField("diagnosis", T.StringType()),
        T.StructField("cybersecurity_relevance", T.StringType()),
        T.StructField("solution", T.StringType()),
        T.StructField("recommendation", T.StringType()),
        T.StructField("steps", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

# One row per processed post, failed ones too: results, ledger and dead-letter
# table are all selections of it.
OUTCOMES = T.StructType(
    [
        *CONDENSED.fields,
        T.StructField("status", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        # Null where no answer was asked for.
        T.StructField("answer_status", T.StringType()),
    ]
)

# What a failed post needs to be tried again without the file or row it came from.
REENTRY = T.StructType(
    [
        T.StructField("post_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("self_text", T.StringType()),
        T.StructField("created_utc", T.DoubleType()),
    ]
)

REPLIES = T.StructType(
    [
        T.StructField("post_id", T.StringType()),
        T.StructField("round", T.IntegerType()),
        T.StructField("reply", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
    ]
)

_PLACE = [T.StructField("run", T.IntegerType()), T.StructField("batch", T.LongType())]
# Below the folder of a run; without buckets in runs that were begun without them.
STORED_OUTCOMES = T.StructType([*OUTCOMES.fields, _PLACE[1]])
STORED_REENTRY = T.StructType([*REENTRY.fields, *_PLACE])
STORED_REPLIES = T.StructType([*REPLIES.fields, _PLACE[1]])
RUNS = T.StructType([_PLACE[0], T.StructField("buckets", T.IntegerType())])

# The column titles of the exchanged CSV files, in file order.
POSTS_CSV_HEADER = {
    "post_id": "Post ID",
    "title": "Title",
    "self_text": "Self Text",
    "post_type": "Post Type",
    "upvotes": "Upvotes",
    "num_comments": "Comments Count",
    "author": "Author",
    "created_utc": "Created Time (UTC)",
    "links": "Link/Image",
}
COMMENTS_CSV_HEADER = {
    "post_id": "Post ID",
    "comment_id": "Comment ID",
    "body": "Comment Body",
    "score": "Comment Upvotes",
    "created_utc": "Comment Created Time (UTC)",
    "author": "Comment Author",
    "links": "Link/Image",
}
