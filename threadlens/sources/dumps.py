"""Reading dumps of submissions and comments, whole or as files arrive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from threadlens.schemas import POSTS, RAW_COMMENTS, RAW_SUBMISSIONS


def read_submissions(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Raw submissions; `format` is `json` (one object per line) or `parquet`."""
    return spark.read.schema(RAW_SUBMISSIONS).format(format).load(path)


def read_comments(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Raw comments; `format` as for submissions."""
    return spark.read.schema(RAW_COMMENTS).format(format).load(path)


def stream_submissions(
    spark: SparkSession, path: str, format: str = "json", files_per_batch: int = 1000
) -> DataFrame:
    """Raw submissions from files as they arrive."""
    return _stream(spark, path, format, RAW_SUBMISSIONS, files_per_batch)


def stream_posts(
    spark: SparkSession, path: str, format: str = "parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Ingested posts from files as they arrive."""
    return _stream(spark, path, format, POSTS, files_per_batch)


def _stream(
    spark: SparkSession, path: str, format: str, schema: StructType, files: int
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files)
        .format(format)
        .load(path)
    )
