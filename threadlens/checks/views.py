"""Discussion threads derived from the driver's tables.

None of the given text columns holds an absolute URL, a full-width character or
outer padding, so the text rules would have nothing to do on them. These views
make every document a post and every later turn of a conversation a comment, and
plant what is missing. They read whole tables and whole texts; remainders only
choose which variant a row gets.

One text for both engines: `@name` stands for a table.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSTS = """
posts as (
  select cast(d.doc_id as string) post_id,
    d.source community,
    case when d.doc_id % 4 = 0
         then translate(coalesce(c.text, concat(d.source, ' ', d.lang)), 'abcdeh. ', 'ａｂｃｄｅｈ．　')
         else coalesce(c.text, concat(d.source, ' ', d.lang)) end title,
    case when d.doc_id % 7 = 0 then null
         when d.doc_id % 9 = 0 then ''
         when d.doc_id % 5 = 0 then concat('　⺀ ', d.text, ' https://img.example.com/', cast(d.doc_id as string), '.png?x=1')
         when d.doc_id % 5 = 1 then concat(d.text, ' see http://kb.example.org/', cast(d.doc_id as string), ').')
         else d.text end self_text,
    p.url url,
    (d.doc_id * 37) % 50 upvotes,
    coalesce(n.n, 0) num_comments,
    case when d.doc_id % 11 = 0 then null else concat('user_', cast(d.doc_id % 17 as string)) end author,
    cast(1704067200 + d.doc_id * 3600 as double) created_utc
  from @documents d
  left join (select conv_id, count(*) - 1 n from @conversations group by conv_id) n on n.conv_id = d.doc_id
  left join @conversations c on c.conv_id = d.doc_id and c.turn = 0
  left join @pages p on p.page_id = d.doc_id)"""

COMMENTS = """
comments as (
  select cast(conv_id as string) post_id,
    concat(cast(conv_id as string), '_', cast(turn as string)) comment_id,
    case when turn > 1 then concat(cast(conv_id as string), '_', cast(cast(floor(turn / 2) as bigint) as string)) end parent_id,
    turn % 2 pos,
    turn seq,
    case when (conv_id + turn) % 13 = 0 then null
         when (conv_id + turn) % 4 = 0 then concat(text, ' https://i.example.net/a', cast(turn as string), '.jpg https://x.example.net/b')
         when (conv_id + turn) % 4 = 1 then concat(text, ' http://x.example.net/', cast(turn as string))
         else text end body,
    conv_id + turn score,
    cast(1704067200 + conv_id * 3600 + turn * 60 as double) created_utc,
    case when role = 'assistant' then null else role end author
  from @conversations
  where turn > 0)"""

RESPONSES = """
responses as (
  select cast(doc_id as string) post_id, 'analysis' stage, case doc_id % 12
    when 0 then '{"user_complaint":-1000,"diagnosis":-1000,"cybersecurity_relevance":"None"}'
    when 1 then '{"user_complaint":"u","cybersecurity_relevance":"High"}'
    when 2 then 'not json'
    when 3 then '{"user_complaint":"u","diagnosis":"d"}'
    when 4 then '{"user_complaint":"u","diagnosis":"d","cybersecurity_relevance":null}'
    when 5 then '{"user_complaint":"u","diagnosis":"d","cybersecurity_relevance":"Low"}'
    when 6 then '{"user_complaint":"u","diagnosis":"d","cybersecurity_relevance":"Medium"}'
    when 7 then '{"user_complaint":"u","diagnosis":"d","cybersecurity_relevance":"High"}'
    when 8 then '{"user_complaint":"u","diagnosis":"d","cybersecurity_relevance":"None"}'
    when 9 then '{"user_complaint":"-1000","diagnosis":"d","cybersecurity_relevance":"low"}'
    when 10 then '{"user_complaint":"u","diagnosis":-1000.0,"cybersecurity_relevance":"High"}'
    else '[1]' end reply
  from @documents
  union all
  select cast(doc_id as string), 'generalize', concat('general ', cast(doc_id as string))
  from @documents
  union all
  select cast(doc_id as string), 'answer', case doc_id % 17
    when 0 then '{"Answer":"No relevant answer found"}'
    when 1 then '{"Answer":"a","Steps":"s","Confidence":0.95,"Is_Solution":true}'
    when 2 then '{"Answer":"a","Steps":"s","Confidence":0.97,"Is_Solution":false}'
    when 3 then '{"Answer":"a","Steps":"s","Confidence":0.5,"Is_Solution":true}'
    when 4 then 'oops'
    when 5 then '{"Answer":"a"}'
    when 6 then '{"Answer":"a","Steps":"s","Confidence":1,"Is_Solution":true}'
    when 7 then '{"Steps":"s","Confidence":0.99}'
    when 8 then '{"Answer":"a","Steps":"s","Confidence":"0.97","Is_Solution":true}'
    when 9 then '{"Answer":"a","Steps":"s","Confidence":null,"Is_Solution":true}'
    when 10 then '{"Answer":"a","Steps":"s","Confidence":0.99,"Is_Solution":"false"}'
    when 11 then '{"Answer":"a","Steps":["x","y"],"Confidence":0.99,"Is_Solution":1}'
    when 12 then '{"Answer":null,"Steps":"s","Confidence":0.99,"Is_Solution":true}'
    when 13 then '{"Answer":"a","Steps":"s","Confidence":0.9499,"Is_Solution":true}'
    when 14 then '{"Answer":"a","Steps":null,"Confidence":true,"Is_Solution":[]}'
    when 15 then '{"Answer":"a","Confidence":0.99,"Is_Solution":0}'
    else concat('```json', chr(10), '{"Answer":"a","Steps":"s","Confidence":0.99,"Is_Solution":true}', chr(10), '```') end
  from @documents)"""

# A larger thread table: orders as posts, their lines as comments.
ORDER_POSTS = """
order_posts as (
  select cast(o_orderkey as string) post_id, o_orderpriority community,
    cast(floor(o_totalprice) as bigint) upvotes
  from @orders)"""

LINE_COMMENTS = """
line_comments as (
  select cast(l_orderkey as string) post_id, cast(l_linenumber as bigint) seq,
    case when l_returnflag = 'R' then null
         else concat(l_returnflag, l_linestatus, ' ', cast(l_partkey as string), ' ', cast(l_suppkey as string)) end body
  from @lineitem)"""

# A handful of threads, each with a good part of all lines as its comments.
LONG_THREADS = """
long_threads as (
  select cast(l_linenumber as string) post_id, l_orderkey seq,
    case when l_returnflag = 'R' then null
         else concat(l_returnflag, l_linestatus, ' ', cast(l_partkey as string), ' ', cast(l_suppkey as string)) end body
  from @lineitem)"""


# The columns the views read; naming them spares a look into each file first.
_COLUMNS = {
    "documents": "doc_id long, text string, lang string, source string",
    "conversations": "conv_id long, turn long, role string, text string",
    "pages": "page_id long, url string",
    "orders": "o_orderkey long, o_orderpriority string, o_totalprice double",
    "lineitem": """l_orderkey long, l_linenumber int, l_returnflag string,
        l_linestatus string, l_partkey long, l_suppkey long""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """One of the views above over the Parquet files of `sf_dir`."""
    for name in set(re.findall(r"@(\w+)", text)):
        table(spark, sf_dir, name).createOrReplaceTempView(f"given_{name}")
    return spark.sql(
        f"with {text.replace('@', 'given_')} select * from {text.split()[0]}"
    )


def with_views(*texts: str) -> str:
    """`with ...` clause of the given views for DuckDB."""
    return "with recursive " + ",".join(texts).replace("@", "") + "\n"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, POSTS)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, COMMENTS)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RESPONSES)


def _author() -> Column:
    return F.when(F.col("author").isNotNull(), F.struct(F.col("author").alias("name")))


def raw_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).select(
        F.col("post_id").alias("id"),
        "title",
        F.col("self_text").alias("selftext"),
        "url",
        F.col("upvotes").alias("score"),
        "num_comments",
        _author().alias("author"),
        "created_utc",
        "community",
    )


def raw_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments(spark, sf_dir).select(
        "post_id",
        F.col("comment_id").alias("id"),
        "parent_id",
        "pos",
        "body",
        "score",
        _author().alias("author"),
        "created_utc",
    )
