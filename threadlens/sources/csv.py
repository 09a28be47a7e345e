"""Reading exchanged CSV tables, all communities in one scan."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.schemas import COMMENTS_CSV_HEADER, COMMENTS, POSTS, POSTS_CSV_HEADER
from threadlens.storage import exists

# Cells hold newlines and doubled quotes. Quoted newlines also keep Spark from
# splitting a file, so the writer bounds the size of each file.
READ_OPTIONS = {"header": True, "multiLine": True, "escape": '"'}


def read_threads(
    spark: SparkSession, base: str, layout: str = "tables"
) -> tuple[DataFrame, DataFrame]:
    """Posts and comments below `base`.

    `tables` is what `write_threads` writes: `posts/community=x/*.csv` and
    `comments/community=x/*.csv`. `folders` is one folder per community with
    `x/x_posts.csv` and `x/x_comments.csv`. Communities without files simply have
    no rows, nor does a `base` that is not there; see `missing_communities`.
    """
    if layout == "tables":
        return read_table(spark, f"{base}/posts", POSTS), read_table(
            spark, f"{base}/comments", _with_community(COMMENTS)
        )
    if layout != "folders":
        raise ValueError(f"unknown layout {layout!r}")
    posts = _read_folders(spark, base, "posts", _columns(POSTS, POSTS_CSV_HEADER))
    comments = _read_folders(
        spark, base, "comments", _columns(COMMENTS, COMMENTS_CSV_HEADER)
    )
    # A file is read by one task from start to end, so this follows file order. It
    # ascends within a post; it is no count.
    return posts, comments.withColumn("seq", F.monotonically_increasing_id())


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**READ_OPTIONS).csv(path)


def missing_communities(
    spark: SparkSession, base: str, requested: list[str], layout: str = "tables"
) -> DataFrame:
    """The requested communities for which there is no posts file.

    Only file names are listed, no file is opened.
    """
    tables = layout == "tables"
    wanted = spark.createDataFrame([(c,) for c in requested], "community string")
    if not exists(spark, f"{base}/posts" if tables else base):
        return wanted
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv" if tables else "*_posts.csv")
        .load(f"{base}/posts" if tables else base)
    )
    folder = _folder(F.col("path"))
    if tables:
        folder = _decoded(F.regexp_replace(folder, "^community=", ""))
    present = files.select(folder.alias("community"))
    return wanted.join(present, "community", "left_anti")


def _read_folders(
    spark: SparkSession, base: str, table: str, schema: T.StructType
) -> DataFrame:
    if not exists(spark, base):
        return spark.createDataFrame([], _with_community(schema))
    return (
        spark.read.schema(schema)
        .options(**READ_OPTIONS)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*_{table}.csv")
        .csv(base)
        .withColumn("community", _decoded(_folder(F.col("_metadata.file_path"))))
    )


def _folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def _decoded(name: Column) -> Column:
    # Percent-encoded as in a path, where a plus sign is a plus sign.
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _columns(schema: T.StructType, header: dict[str, str]) -> T.StructType:
    return T.StructType([schema[name] for name in header])


def _with_community(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("community", T.StringType())])
