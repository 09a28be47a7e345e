"""From comment rows to the text of a thread."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.storage import fits_broadcast

# Neighbouring comments are put together in runs of about so many bytes first.
RUN_BYTES = 1 << 18
# What a comment weighs in a run besides its body.
ROW_BYTES = 64


def thread_texts(comments: DataFrame) -> DataFrame:
    """`post_id, body_text`: comment bodies in order of `seq`, one row per post.

    Bodies are joined by newlines and null bodies skipped; a thread of nothing but
    null bodies is empty text. A thread is always whole, however long: it is one value
    of the result, and only its post's rows meet in the task that puts it together.
    Rows of a post that are equal in `seq` and body count once.
    """
    # Gathering shrinks nothing, so combining in the map tasks would be in vain: the
    # explicit shuffle by key leaves it out.
    return _joined(comments.select("post_id", "seq", "body").repartition("post_id"))


def join_threads(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts, each with its thread: `has_comments`, `body_text`.

    A post without comments stays, with `has_comments` false.
    """
    threads = thread_texts(comments).withColumn("has_comments", F.lit(True))
    return posts.join(threads, "post_id", "left").withColumn(
        "has_comments", F.coalesce("has_comments", F.lit(False))
    )


def threads_for_prompts(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """`thread_texts` of the given posts. `posts` is counted: hand in a stored table."""
    wanted = posts.select("post_id")
    few = fits_broadcast(wanted)
    mine = comments.join(F.broadcast(wanted) if few else wanted, "post_id", "left_semi")
    # The join of a large table has dealt the comments out by post already.
    return thread_texts(mine) if few else _joined(mine)


def _joined(comments: DataFrame) -> DataFrame:
    """Rows of a post are sorted and numbered by windows, which spill, and joined in
    bounded runs; only the texts of the runs meet in one row. All of it keeps the rows
    where the first window has them."""
    order = Window.partitionBy("post_id").orderBy("seq", "body")
    again = F.lag("seq").over(order).eqNullSafe(F.col("seq")) & F.lag("body").over(order).eqNullSafe(F.col("body"))
    again = again & (F.row_number().over(order) > 1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.coalesce(F.octet_length("body"), F.lit(0)).cast("long") + ROW_BYTES
    numbered = comments.select(
        "post_id",
        "body",
        again.alias("_again"),
        F.row_number().over(order).alias("_at"),
        F.floor(F.sum(weight).over(so_far) / RUN_BYTES).alias("_run"),
    ).where("not _again")
    # A run of nothing but null bodies is null, not empty text.
    runs = numbered.groupBy("post_id", "_run").agg(F.when(F.count("body") > 0, _text("_at", "body")).alias("_text"))
    return runs.groupBy("post_id").agg(_text("_run", "_text").alias("body_text"))


def _text(place: str, text: str) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(F.col(place).alias("at"), F.col(text).alias("text"))))
    return F.array_join(F.transform(rows, lambda row: row["text"]), "\n")
