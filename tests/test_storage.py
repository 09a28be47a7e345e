import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadlens import storage
from threadlens.schemas import COMMENTS, CONDENSED, POSTS
from threadlens.sinks.csv import write_condensed, write_threads
from threadlens.sources.csv import READ_OPTIONS, missing_communities, read_threads

NASTY = ' a "quoted", text\nwith a newline, \\ and trailing blanks  '
POST_ROWS = [
    ("1", NASTY, None, "jpg", 5, 2, None, 1.7e9, "http://x/a.jpg", "help"),
    ("2", "None", "NA", None, -1, 3, "bob", 1.5, "No links or images found.", "net work+%"),
    ("007", "t", '"', "com/r/", 0, 9, "al", 2.25, "x", "help"),
]
COMMENT_ROWS = [
    ("1", "c1", NASTY, 4, 1.0, None, "l", 1),
    ("1", "c2", None, 4, 1.0, "x", "l", 2),
    ("2", "c3", "a\r\nb", 4, 1.0, "x", "l", 1),
    ("gone", "c4", "not in posts", 4, 1.0, "x", "l", 1),
]


def frames(spark):
    return spark.createDataFrame(POST_ROWS, POSTS), spark.createDataFrame(COMMENT_ROWS, COMMENTS)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_written_threads_read_back(spark, tmp_path):
    posts, comments = frames(spark)
    write_threads(posts, comments, f"{tmp_path}/t")
    for base in (f"{tmp_path}/t", f"{tmp_path}/t_backup"):
        got_posts, got_comments = read_threads(spark, base)
        assert rows(got_posts.select(*POSTS.names)) == sorted(POST_ROWS, key=str)
        assert rows(got_comments.select(*COMMENTS.names)) == sorted(COMMENT_ROWS[:3], key=str)
    header = next((tmp_path / "t/posts/community=help").glob("*.csv")).read_text().splitlines()[0]
    assert header == (
        "Post ID,Title,Self Text,Post Type,Upvotes,Comments Count,Author,Created Time (UTC),Link/Image"
    )


def test_one_folder_per_community(spark, tmp_path):
    for community in ("help", "net work+%"):
        folder = tmp_path / community
        folder.mkdir()
        mine = [r for r in POST_ROWS if r[-1] == community]
        names = [r[0] for r in mine]
        pd.DataFrame([r[:-1] for r in mine], columns=POSTS.names[:-1]).to_csv(
            folder / f"{community}_posts.csv", index=False
        )
        pd.DataFrame(
            [r[:-1] for r in COMMENT_ROWS if r[0] in names], columns=COMMENTS.names[:-1]
        ).to_csv(folder / f"{community}_comments.csv", index=False)
        (folder / f"{community}_posts_backup.csv").write_text("not,read\n1,2\n")
    posts, comments = read_threads(spark, str(tmp_path), layout="folders")
    assert rows(posts.select(*POSTS.names)) == sorted(POST_ROWS, key=str)
    kept = comments.select(*COMMENTS.names[:-1], "seq").orderBy("post_id", "seq").collect()
    assert [tuple(r)[:-1] for r in kept] == [r[:-1] for r in COMMENT_ROWS[:3]]
    assert comments.select("community").distinct().count() == 2
    missing = missing_communities(spark, str(tmp_path), ["help", "net work+%", "nowhere"], "folders")
    assert [r[0] for r in missing.collect()] == ["nowhere"]


def test_missing_communities_of_tables(spark, tmp_path):
    write_threads(*frames(spark), f"{tmp_path}/t", backup=False)
    missing = missing_communities(spark, f"{tmp_path}/t", ["help", "net work+%", "nowhere"])
    assert [r[0] for r in missing.collect()] == ["nowhere"]


def test_unknown_layout(spark, tmp_path):
    with pytest.raises(ValueError):
        read_threads(spark, str(tmp_path), layout="other")


def test_an_empty_frame_writes_no_community(spark, tmp_path):
    posts, comments = frames(spark)
    write_threads(posts.filter("false"), comments, f"{tmp_path}/t", backup=False)
    assert not list((tmp_path / "t/posts").glob("community=*"))


def test_condensed_export(spark, tmp_path):
    row = ("p", 1.0, NASTY, "d", None, "-999", 'say "x"', '["x","y"]', 0.95)
    for data in ([row], []):
        write_condensed(spark.createDataFrame(data, CONDENSED), f"{tmp_path}/c")
        files = list((tmp_path / "c").glob("*.csv"))
        assert all(f.read_text().startswith(",".join(CONDENSED.names)) for f in files)
        read = spark.read.schema(CONDENSED).options(**READ_OPTIONS).csv(f"{tmp_path}/c")
        assert rows(read) == data


def test_condensed_export_by_community(spark, tmp_path):
    posts, _ = frames(spark)
    data = [(p, 1.0, "u", "d", "Low", "-999", "a", "s", 0.5) for p in ("1", "2", "007")]
    write_condensed(spark.createDataFrame(data, CONDENSED), f"{tmp_path}/c", posts)
    read = spark.read.schema(CONDENSED).options(**READ_OPTIONS).csv(f"{tmp_path}/c/community=help")
    assert rows(read.select(*CONDENSED.names)) == sorted((data[0], data[2]), key=str)


def test_shared_folder_is_the_one_the_session_names(spark):
    assert storage.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    frame = spark.range(5).withColumn("x", F.col("id") * 2)
    kept = storage.stored(frame, "numbers")
    assert kept.schema.names == frame.schema.names and kept.count() == 5
    assert storage.shared_folder(spark) in kept.inputFiles()[0]


def test_missing_table_reads_as_empty(spark, tmp_path):
    assert storage.table_or_empty(spark, f"{tmp_path}/none", CONDENSED).count() == 0
