"""Writing exchanged CSV tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.schemas import COMMENTS_CSV_HEADER, POSTS_CSV_HEADER
from threadlens.sources.csv import read_threads

WRITE_OPTIONS = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "maxRecordsPerFile": 1_000_000,
}


def write_threads(
    posts: DataFrame, comments: DataFrame, base: str, backup: bool = True
) -> None:
    """Both tables as CSV, one folder per community, and a copy of them.

    Communities without rows get no folder. The copy, in `<base>_backup`, is made
    from the written files, so nothing is computed twice.
    """
    homes = posts.select("post_id", "community")
    _write_both(posts, comments.join(homes, "post_id"), base, "errorifexists")
    if backup:
        stored_posts, stored_comments = read_threads(posts.sparkSession, base)
        _write_both(stored_posts, stored_comments, f"{base}_backup", "overwrite")


def write_condensed(
    results: DataFrame, path: str, posts: DataFrame | None = None
) -> None:
    """The result table as CSV; an empty one still has its header.

    With `posts` it goes into one folder per community.
    """
    if posts is None:
        results.write.mode("overwrite").options(**WRITE_OPTIONS).csv(path)
    else:
        homes = posts.select("post_id", "community")
        columns = {name: name for name in results.columns}
        _write(results.join(homes, "post_id"), columns, path, "overwrite")


def _write_both(
    posts: DataFrame, comments: DataFrame, base: str, mode: str
) -> None:
    _write(posts, {**POSTS_CSV_HEADER}, f"{base}/posts", mode)
    # File order is lost when many tasks write; `seq` keeps the order instead.
    _write(comments, {**COMMENTS_CSV_HEADER, "seq": "seq"}, f"{base}/comments", mode)


def _write(rows: DataFrame, header: dict[str, str], path: str, mode: str) -> None:
    titled = rows.select(
        *[F.col(name).alias(title) for name, title in header.items()], "community"
    )
    # Rebalancing gathers the rows of small communities and, through adaptive
    # execution, splits those of large ones.
    (
        titled.hint("rebalance", "community")
        .write.mode(mode)
        .options(**WRITE_OPTIONS)
        .partitionBy("community")
        .csv(path)
    )
