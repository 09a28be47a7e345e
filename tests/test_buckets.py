import pytest
from pyspark.sql import functions as F
from test_incremental import calls, make_comments, make_model, make_posts, rows

from threadlens.plans.condense import condense
from threadlens.schemas import COMMENTS
from threadlens.streaming import incremental as I
from threadlens.streaming.buckets import deal_out, read_dealt


def bytes_read(frame):
    """Bytes of the files that the scans of a frame open."""
    frame.collect()
    total, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
            continue
        if "QueryStage" in plan.getClass().getSimpleName():
            todo.append(plan.plan())
            continue
        metrics = plan.metrics()
        if plan.nodeName().startswith("Scan") and metrics.contains("filesSize"):
            total += metrics.apply("filesSize").value()
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def talk(spark, posts):
    ids = spark.range(posts * 20).select(F.concat(F.lit("p"), F.col("id") % posts).alias("post_id"), "id")
    return ids.withColumns({"seq": F.col("id"), "body": F.sha2(F.col("id").cast("string"), 256)}).drop("id")


def test_a_batch_reads_its_share_whatever_the_size_of_the_table(spark, tmp_path):
    batch = spark.createDataFrame([(f"p{i}",) for i in range(6)], "post_id string")
    read = {}
    for size, buckets in ((400, 20), (3200, 160)):
        comments = talk(spark, size)
        dealt = deal_out(comments, f"{tmp_path}/{size}", buckets)
        own = dealt.share(batch)
        read[size] = bytes_read(own)
        assert own.columns == comments.columns
        assert rows(own.join(batch, "post_id", "left_semi")) == rows(comments.join(batch, "post_id", "left_semi"))
        assert rows(read_dealt(spark, f"{tmp_path}/{size}").rows.drop("bucket")) == rows(comments)
        assert read[size] < bytes_read(dealt.rows) * 0.6
    assert read[3200] < 1.6 * read[400]


def test_the_ledger_is_read_by_share(spark, tmp_path):
    model, out = make_model(tmp_path / "calls"), f"{tmp_path}/out"
    I.condense_incremental(make_posts(spark, range(40)), make_comments(spark), model, out, buckets=40)
    near = I._outcomes_near(make_posts(spark, [3]), out, 0, 40)
    assert "p03" in {r.post_id for r in near.collect()}
    assert bytes_read(near) < bytes_read(I.outcomes(spark, out)) / 5
    assert I.outcomes(spark, out).count() == 40


@pytest.mark.parametrize("buckets", [1, 7])
def test_dealt_comments_give_the_same_results(spark, tmp_path, buckets):
    once, log = tmp_path / "once", tmp_path / "calls"
    posts, comments = make_posts(spark, range(20)), make_comments(spark)
    expected = rows(condense(posts, comments, make_model(once)))
    dealt = deal_out(comments, f"{tmp_path}/dealt", buckets)
    done = I.condense_incremental(posts, dealt, make_model(log), f"{tmp_path}/out", chunk_rows=7, buckets=buckets)
    assert (rows(done), calls(log)) == (expected, calls(once))
    # Tried again by share, too.
    out, broken = f"{tmp_path}/again", make_model(tmp_path / "broken", fail="title 4")
    I.condense_incremental(posts, dealt, broken, out, buckets=buckets)
    assert rows(I.condense_incremental(posts, dealt, make_model(log), out, retry_failed=True)) == expected


def test_runs_begun_without_buckets_go_on(spark, tmp_path):
    out, log, comments = f"{tmp_path}/out", tmp_path / "calls", make_comments(spark)
    spark.createDataFrame([(0,)], "run int").write.parquet(f"{out}/runs")
    I.condense_incremental(make_posts(spark, range(5)), comments, make_model(log), out)
    assert not list((tmp_path / "out" / "outcomes" / "run=0").glob("batch=*/bucket=*"))
    assert len(rows(I.condense_incremental(make_posts(spark, range(9)), comments, make_model(log), out))) == 9
    assert len(rows(I.condense_incremental(make_posts(spark, range(9)), comments, make_model(log), out, fresh=True))) == 9
    assert len(rows(I.outcomes(spark, out, 0))) == 9 and len(calls(log)) > 9


def test_empty_tables_null_posts_and_clashing_columns(spark, tmp_path):
    none = deal_out(spark.createDataFrame([], COMMENTS), f"{tmp_path}/none", 8)
    assert none.share(make_posts(spark, range(3))).count() == 0 and none.rows.drop("bucket").schema == COMMENTS
    odd = spark.createDataFrame([(None, 1, "x"), ("p", 2, None), ("p", 2, None)], "post_id string, seq long, body string")
    dealt = deal_out(odd, f"{tmp_path}/odd", 3)
    assert sorted(map(str, rows_of(dealt.share(odd)))) == sorted(map(str, rows_of(odd)))
    assert dealt.share(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="bucket"):
        deal_out(odd.withColumn("bucket", F.lit(1)), f"{tmp_path}/no", 3)


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]
