"""What one task of the stream queries has to read falls with the number of partitions."""

import pytest

from threadlens.checks import queries as Q
from threadlens.checks.views import _COLUMNS

N, PARTITIONS = 320, 16


@pytest.fixture
def sf(spark, tmp_path):
    tables = {
        "documents": [(i, f"text {i}", "en", "web") for i in range(N)],
        "conversations": [(i, turn, "user", f"turn {turn} of {i}") for i in range(N) for turn in range(3)],
        "pages": [(i, f"https://example.org/{i}") for i in range(N)],
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, _COLUMNS[name]).write.parquet(f"{tmp_path}/sf/{name}.parquet")
    return f"{tmp_path}/sf"


@pytest.fixture
def partitions(spark):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", PARTITIONS)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", usual)


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(Q, "new_folder", lambda spark, name: f"{tmp_path}/made/{name}")
    return tmp_path / "made"


def rows_by_file(spark, path, format):
    rows = spark.read.format(format).load(str(path)).groupBy("_metadata.file_path").count().collect()
    return [r["count"] for r in rows]


QUERIES = {
    "condense_incremental": ("arriving", "parquet", "incremental/_progress/run=0/commits"),
    "dead_letter_answers": ("arriving", "parquet", "incremental/_progress/run=0/commits"),
    "retry_answers": ("arriving", "parquet", "incremental/_progress/run=0/commits"),
    "ingest_stream": ("stream/arriving", "json", "stream/progress/commits"),
}


@pytest.mark.parametrize("name", QUERIES)
def test_a_file_holds_a_share_that_falls_with_the_partitions(spark, sf, partitions, folder, name):
    arriving, format, commits = QUERIES[name]
    assert Q.QUERIES[name](spark, sf).count() > 0
    counts = rows_by_file(spark, folder / arriving, format)
    assert sum(counts) == N and len(counts) == PARTITIONS
    assert max(counts) <= 2 * N // PARTITIONS
    batches = [f for f in (folder / commits).iterdir() if f.name.isdigit()]
    assert len(batches) == (1 if "answers" in name else 2)


def test_tasks_that_ask_the_stand_in_model_follow_the_partitions(spark, partitions):
    prompts = spark.range(N).selectExpr("cast(id as string) post_id", "0 round", "'text' prompt")
    for model in (Q._measuring_backend(), Q._refusing_answers()):
        assert model._asked(prompts, "analysis").rdd.getNumPartitions() == PARTITIONS
