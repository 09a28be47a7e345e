"""Intermediate tables in the folder every executor can reach."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Up to so many keys (an id and a number at most) are sent to every executor.
BROADCAST_KEYS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints.

    A local session without one gets a temporary folder. A cluster session must
    name one: a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="threadlens-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/threadlens/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame once as Parquet and go on from the written table.

    Used where recomputing would be wrong or dear (model calls, rounds of a
    loop). The table survives lost executors, and later readers still get column
    pruning and filter push-down.
    """
    spark = frame.sparkSession
    path = new_folder(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def table_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table, or no rows where nothing has been written yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the store of this path has it."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)


def fits_broadcast(keys: DataFrame) -> bool:
    """Whether a stored table of keys is small enough for a broadcast."""
    return keys.count() <= BROADCAST_KEYS


def key_side(keys: DataFrame) -> DataFrame:
    """A stored table of keys as a join side: broadcast if its size allows.

    Otherwise the join is planned as any other, and adaptive execution splits
    its skewed partitions.
    """
    return F.broadcast(keys) if fits_broadcast(keys) else keys
