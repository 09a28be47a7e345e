"""Flattening comment trees, breadth first."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from threadlens.operators.ranking import number_within
from threadlens.storage import key_side, stored

_LARGE_THREAD = 1_000_000
# Rounds in which paths grow; after them a path is a number of eight bytes.
_GROWING = 3


def flatten(comments: DataFrame, large_thread: int = _LARGE_THREAD) -> DataFrame:
    """List the comments of each post level by level.

    Takes `post_id, comment_id, parent_id, pos` and returns `post_id,
    comment_id, depth, seq`, each comment once. Top-level comments have no parent (or one that is
    not in the data) and depth 0; siblings are ordered by `pos` (0 or more), then
    id. Comments on a parent cycle hang below no top-level comment: they are
    listed last, by id, with a null depth.

    Threads beyond `large_thread` comments are numbered over many tasks.
    """
    return listed(comments, large_thread)[0]


def listed(
    comments: DataFrame, large_thread: int = _LARGE_THREAD
) -> tuple[DataFrame, int]:
    """`flatten`, and the number of comments in its result."""
    placed, found = _paths(comments)
    order = [F.col("depth").asc_nulls_last(), F.col("path")]
    sizes = placed.groupBy("post_id").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > large_thread).select("post_id")
    if found <= large_thread or large.isEmpty():
        return _numbered(placed, order), found
    large = key_side(stored(large, "large-threads"))
    rest = _numbered(placed.join(large, "post_id", "left_anti"), order)
    spread = number_within(
        placed.join(large, "post_id", "left_semi"), ["post_id"], order, "seq"
    ).drop("path")
    return rest.unionByName(spread), found


def _numbered(placed: DataFrame, order: list[Column]) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("post_id").orderBy(*order))
    return placed.withColumn("seq", seq.cast("long")).drop("path")


def _paths(comments: DataFrame) -> tuple[DataFrame, int]:
    """Each comment with its depth and the path from the top down to it.

    Every round doubles the steps a path covers: the path of the node `up`
    points to is put in front, and `up` moves on to where that node points. So a
    thread of depth d takes about log2(d) joins, not d. Only ids and positions
    take part, and finished comments are never written again.

    Paths of equal depth are all that is ever compared. From `_GROWING` rounds on a round
    replaces both halves of a path by their place in the order of all pairs of halves, so
    a path stays short however deep the thread. Halves of comments of equal depth stem
    from the same round. Where a pointer leads to a missing comment a round says no more than
    the one before did, so such a path stays as it is.
    """
    # Copies of a comment would multiply along its replies.
    place = F.min(F.struct("parent_id", "pos")).alias("place")
    nodes, found, left = _kept(
        comments.groupBy("post_id", "comment_id")
        .agg(place)
        .select(
            "post_id",
            "comment_id",
            F.col("place.parent_id").alias("up"),
            F.lit(0).cast("long").alias("depth"),
            _step(F.col("place.pos"), F.col("comment_id")).alias("path"),
        )
    )
    finished = [nodes.filter(F.col("up").isNull())]
    climbing = nodes.filter(F.col("up").isNotNull())
    rounds = 0
    while left:
        known = reduce(DataFrame.unionByName, [*finished, climbing]).select(
            "post_id",
            F.col("comment_id").alias("up"),
            F.col("up").alias("above"),
            F.col("depth").alias("steps"),
            F.col("path").alias("upper"),
        )
        rounds += 1
        # A missing parent gives nulls and thereby ends the climb.
        orphan = F.col("upper").isNull()
        joined = climbing.join(known, ["post_id", "up"], "left")
        if rounds <= _GROWING:
            path = F.concat("upper", "path")
        else:
            # Numbers ascend within a partition and from one to the next.
            joined = joined.repartitionByRange("upper", "path").sortWithinPartitions("upper", "path")
            path = _sortable(F.monotonically_increasing_id())
        nodes, _, still = _kept(
            joined.select(
                "post_id",
                "comment_id",
                F.col("above").alias("up"),
                F.when(orphan, F.col("depth"))
                .otherwise(F.col("depth") + F.col("steps") + 1)
                .alias("depth"),
                F.when(orphan, F.col("path")).otherwise(path).alias("path"),
            )
        )
        finished.append(nodes.filter(F.col("up").isNull()))
        climbing = nodes.filter(F.col("up").isNotNull())
        if still == left:
            # Each round ends the climb of someone unless all are on a cycle.
            circular = climbing.select(
                "post_id",
                "comment_id",
                F.lit(None).cast("string").alias("up"),
                F.lit(None).cast("long").alias("depth"),
                F.col("comment_id").cast("binary").alias("path"),
            )
            finished.append(circular)
            break
        left = still
    return reduce(DataFrame.unionByName, finished).drop("up"), found


def _step(pos: Column, comment_id: Column) -> Column:
    """One step of a path, as bytes that sort like `(pos, comment_id)`.

    Fixed-width position, id and a closing zero: strung together, paths sort like
    the lists of their steps, at a fraction of the size of an array.
    """
    return F.concat(_sortable(F.coalesce(pos, F.lit(0))), comment_id.cast("binary"), F.lit(b"\x00"))


def _sortable(number: Column) -> Column:
    """A number (0 or more) as eight bytes that sort like it."""
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def _kept(nodes: DataFrame) -> tuple[DataFrame, int, int]:
    """The nodes as a written table, how many, and how many still have to climb."""
    counter = Observation()
    counted = nodes.observe(
        counter,
        F.count("*").alias("all"),
        F.count_if(F.col("up").isNotNull()).alias("left"),
    )
    return stored(counted, "nodes"), counter.get["all"], counter.get["left"]
