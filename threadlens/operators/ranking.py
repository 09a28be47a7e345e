"""Best-first order, first N and exact numbering, none of it in one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.operators.copies import each_once
from threadlens.storage import stored

_SALTS = 64


def best_first() -> list[Column]:
    """Highest score first; ties by id, so that the order is total."""
    return [F.col("upvotes").desc(), F.col("post_id").asc()]


def top_per_community(posts: DataFrame, limit: int) -> DataFrame:
    """The best `limit` posts of each community.

    A post that is there several times in a community takes one place.
    """
    if limit <= 0:
        return posts.filter(F.lit(False))
    posts = each_once(posts, ["community", "post_id"])
    if limit > _window_limit(posts):
        return _top_by_number(posts, ["community"], limit)
    # Map tasks keep `limit` rows per window group. With very many map tasks that is
    # still a lot for the one task of a hot community, so a window over some of the map
    # tasks thins it out first. Only ids and scores go through both.
    ids = posts.select("community", "upvotes", "post_id").withColumn("_salt", _salt())
    thinned = _first_rows(ids, ["community", "_salt"], limit)
    return _only(posts, _first_rows(thinned, ["community"], limit).select("community", "post_id"))


def top_overall(posts: DataFrame, limit: int) -> DataFrame:
    """The best `limit` posts, communities not told apart; each post once."""
    if limit <= 0:
        return posts.filter(F.lit(False))
    posts = each_once(posts, ["post_id"])
    if limit > _window_limit(posts):
        return _top_by_number(posts, [], limit)
    # Each task keeps its best rows and sends those only.
    return posts.orderBy(*best_first()).limit(limit)


def number_within(
    rows: DataFrame, group: list[str], order: list[Column], name: str
) -> DataFrame:
    """Exact row numbers from 1 within groups of any size.

    Rows are range-partitioned by group and order, so a large group is spread
    over many partitions; a row's number is its place in its partition plus the
    rows of the group in earlier ones. `order` has to be total.
    """
    by_group = [F.col(c) for c in group]
    ranged = stored(
        rows.repartitionByRange(*by_group, *order).withColumn(
            "_part", F.spark_partition_id()
        ),
        "ranged",
    )
    # One row per group and partition it touches.
    earlier = Window.partitionBy(*by_group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        ranged.groupBy(*by_group, "_part")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    place = F.row_number().over(Window.partitionBy("_part", *by_group).orderBy(*order))
    starts = starts.withColumnsRenamed({c: f"_group{i}" for i, c in enumerate(group)}).withColumnRenamed(
        "_part", "_of"
    )
    # Null is a group like any other.
    same = [F.col(c).eqNullSafe(F.col(f"_group{i}")) for i, c in enumerate(group)]
    return (
        ranged.join(starts, [F.col("_part") == F.col("_of"), *same])
        .withColumn(name, (place + F.col("_start")).cast("long"))
        .drop("_part", "_start", "_of", *(f"_group{i}" for i in range(len(group))))
    )


def _salt() -> Column:
    # By map task: a task's rows stay one group, so it sends `limit` of them, not more.
    return F.pmod(F.spark_partition_id(), F.lit(_SALTS))


def _first_rows(posts: DataFrame, group: list, limit: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*best_first()))
    return posts.withColumn("_place", place).filter(F.col("_place") <= limit).drop(
        "_place"
    )


def _window_limit(posts: DataFrame) -> int:
    # Above this limit Spark no longer cuts window groups in the map tasks.
    conf = posts.sparkSession.conf
    return int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))


def _top_by_number(posts: DataFrame, group: list[str], limit: int) -> DataFrame:
    # Only ids and scores are sorted; the wide rows are joined back by id.
    ids = posts.select(*group, "upvotes", "post_id")
    places = number_within(ids, group, best_first(), "_place")
    return _only(posts, places.filter(F.col("_place") <= limit).select(*group, "post_id"))


def _only(posts: DataFrame, kept: DataFrame) -> DataFrame:
    """The posts with those keys, also where a key is null."""
    same = [posts[c].eqNullSafe(kept[c]) for c in kept.columns]
    return posts.join(kept, same, "left_semi")
