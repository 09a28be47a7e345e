"""Tables dealt into buckets of a key, so that a batch reads its own share only."""

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from threadlens.storage import table_or_empty

BUCKET = "bucket"
_SHAPE = StructType([StructField("buckets", LongType()), StructField("schema", StringType())])


@dataclass(frozen=True)
class Dealt:
    """A table whose rows lie in folders by the hash of their `post_id`."""

    rows: DataFrame
    buckets: int

    def share(self, posts: DataFrame) -> DataFrame:
        """All rows of the buckets that the posts fall in; no other file is opened.

        Null is a key like any other.
        """
        return only_buckets(self.rows, bucket_numbers(posts, self.buckets), self.buckets).drop(BUCKET)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def bucket_numbers(posts: DataFrame, buckets: int) -> list[int]:
    """The buckets of these posts: at most `buckets` numbers."""
    found = posts.select(bucket_of(F.col("post_id"), buckets).alias(BUCKET)).distinct()
    return sorted(r[BUCKET] for r in found.collect())


def only_buckets(rows: DataFrame, numbers: list[int], buckets: int) -> DataFrame:
    return rows if len(numbers) == buckets else rows.filter(F.col(BUCKET).isin(numbers))


def deal_out(rows: DataFrame, path: str, buckets: int = 1024) -> Dealt:
    """Write a table with `post_id` below a new `path`, dealt into buckets.

    A batch reads the buckets its posts fall in: choose so many that one holds what a
    batch may read, say 128 MB of the table. A bucket of a hot post is spread
    over several files. A column named as the bucket is refused.
    """
    if BUCKET in rows.columns:
        raise ValueError(f"a table with a column {BUCKET!r} cannot be dealt out")
    spark = rows.sparkSession
    dealt = rows.withColumn(BUCKET, bucket_of(F.col("post_id"), buckets))
    # Adaptive execution gathers small buckets in a task and splits large ones.
    dealt.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/rows")
    # Last: a table without it is not whole.
    spark.createDataFrame([(buckets, rows.schema.json())], _SHAPE).write.parquet(f"{path}/shape")
    return read_dealt(spark, path)


def read_dealt(spark: SparkSession, path: str) -> Dealt:
    shape = spark.read.schema(_SHAPE).parquet(f"{path}/shape").first()
    schema = with_bucket(StructType.fromJson(json.loads(shape["schema"])))
    return Dealt(table_or_empty(spark, f"{path}/rows", schema), shape["buckets"])


def with_bucket(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(BUCKET, IntegerType())])
