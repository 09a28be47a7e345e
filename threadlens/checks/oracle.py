"""The queries' results in plain SQL, for DuckDB over the same tables."""

from threadlens.checks.queries import TOP_LARGE, TOP_PER_COMMUNITY, TOP_SINGLE
from threadlens.checks.views import (
    COMMENTS,
    LINE_COMMENTS,
    LONG_THREADS,
    ORDER_POSTS,
    POSTS,
    RESPONSES,
    with_views,
)

# White space as Python has it, in RE2 notation and as a list for trim.
_SPACES = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CODES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_TRIMMED = " || ".join(f"chr({code})" for code in _CODES)
_URL = f"https?://[^{_SPACES}]+"
_IMAGE = rf"{_URL}\.(?:jpg|jpeg|png|gif)"
# Full-width forms and the ASCII signs 0xFEE0 below them, by code point.
_FULL = "".join(chr(code) for code in range(0xFF01, 0xFF5F))
_HALF = "".join(chr(code - 0xFEE0) for code in range(0xFF01, 0xFF5F)).replace("'", "''")


def _ascii(text: str) -> str:
    return f"case when length({text}) > 0 then translate({text}, '{_FULL}', '{_HALF}') end"


def _text(text: str) -> str:
    folded = f"translate({text}, '{_FULL}' || chr(12288), '{_HALF}' || ' ')"
    kept = rf"regexp_replace({folded}, '[\x{{2e80}}-\x{{2fff}}]', '', 'g')"
    return f"case when length({text}) > 0 then trim({kept}, {_TRIMMED}) end"


def _links(text: str) -> str:
    return f"""case
      when len(regexp_extract_all({text}, '{_IMAGE}')) > 0 then array_to_string(regexp_extract_all({text}, '{_IMAGE}'), ', ')
      when len(regexp_extract_all({text}, '{_URL}')) > 0 then array_to_string(regexp_extract_all({text}, '{_URL}'), ', ')
      else 'No links or images found.' end"""


_POST_COLUMNS = f"""post_id, {_ascii("title")} title, {_ascii("self_text")} self_text,
    case when length(url) > 0 then split_part(url, '.', -1) end post_type,
    upvotes, num_comments, author, created_utc, {_links("self_text")} links, community"""
_COMMENT_COLUMNS = f"""post_id, comment_id, {_ascii("body")} body, score, created_utc,
    author, {_links("body")} links, seq"""
_KEPT_COMMENTS = f"""select {_COMMENT_COLUMNS} from comments
    where post_id in (select post_id from posts where num_comments > 1)"""

# Replies as JSON objects: j is null where a reply is no object.
_OBJECTS = """
readable as (select post_id, stage, case when json_valid(reply) then reply
    else trim(regexp_extract(reply, '```(?:json)?(.*)', 1, 's'), ' ' || chr(10) || chr(13) || chr(9) || '`') end reply
  from responses),
objects as (select post_id, stage, case when json_valid(reply) and json_type(reply) = 'OBJECT' then reply end j
  from readable)"""

_NUMBERS = "('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE')"


def _missing(key: str) -> str:
    kind = f"json_type(j, '$.{key}')"
    return f"""({kind} is null or {kind} = 'NULL'
      or ({kind} in {_NUMBERS} and try_cast(json_extract_string(j, '$.{key}') as double) = -1000))"""


_ANALYSED = f"""
analysed as (select post_id, j,
    case when j is null then 'failed'
         when {_missing("user_complaint")} or {_missing("diagnosis")} then 'no_issue' else 'ok' end status,
    json_extract_string(j, '$.user_complaint') user_complaint,
    json_extract_string(j, '$.diagnosis') diagnosis,
    case when json_type(j, '$.cybersecurity_relevance') is null then 'None'
         else json_extract_string(j, '$.cybersecurity_relevance') end cybersecurity_relevance
  from objects where stage = 'analysis')"""
_ISSUES = """
issues as (select a.post_id, a.diagnosis, a.cybersecurity_relevance,
    case when a.cybersecurity_relevance in ('Low', 'None') then g.reply else a.user_complaint end user_complaint
  from analysed a left join responses g on g.post_id = a.post_id and g.stage = 'generalize'
  where a.status = 'ok')"""


def _decided(source: str) -> str:
    """CTE `decided` over rows (post_id, j); j null means the default answer."""
    return f"""
values_read as (select post_id, json_type(j, '$.Answer') answer_kind, json_extract_string(j, '$.Answer') answer,
    case when json_type(j, '$.Confidence') is null then 0.0
         when json_type(j, '$.Confidence') = 'BOOLEAN' then case json_extract_string(j, '$.Confidence') when 'true' then 1.0 else 0.0 end
         when json_type(j, '$.Confidence') in {_NUMBERS} then try_cast(json_extract_string(j, '$.Confidence') as double) end confidence,
    case when json_type(j, '$.Steps') is null then 'No steps' else json_extract_string(j, '$.Steps') end steps,
    case json_type(j, '$.Is_Solution')
         when 'NULL' then false
         when 'BOOLEAN' then json_extract_string(j, '$.Is_Solution') = 'true'
         when 'VARCHAR' then json_extract_string(j, '$.Is_Solution') <> ''
         when 'ARRAY' then json_array_length(j, '$.Is_Solution') > 0
         when 'OBJECT' then len(json_keys(j, '$.Is_Solution')) > 0
         else coalesce(try_cast(json_extract_string(j, '$.Is_Solution') as double) <> 0, false) end solved
  from {source}),
decided as (select post_id,
    case when usable and confidence >= 0.95 and solved then answer else '-999' end solution,
    case when usable and not (confidence >= 0.95 and solved) then answer else '-999' end recommendation,
    case when usable and confidence >= 0.95 then steps else 'No steps' end steps,
    cast(case when usable then confidence else 0 end as double) confidence
  from (select *, answer_kind is not null and coalesce(answer <> 'No relevant answer found', true)
      and confidence is not null usable from values_read))"""


_CONDENSED = ",".join(
    [
        _OBJECTS,
        _ANALYSED,
        _ISSUES,
        """
answered as (select i.post_id, case when i.post_id in (select post_id from comments) then o.j end j
  from issues i left join objects o on o.post_id = i.post_id and o.stage = 'answer')""",
        _decided("answered"),
    ]
)
_CONDENSED_ROWS = """select p.post_id, p.created_utc created_time, i.user_complaint, i.diagnosis,
    i.cybersecurity_relevance, d.solution, d.recommendation, d.steps, d.confidence
  from posts p join issues i on i.post_id = p.post_id join decided d on d.post_id = p.post_id"""
_CONDENSE = f"{with_views(POSTS, COMMENTS, RESPONSES)}, {_CONDENSED} {_CONDENSED_ROWS}"

_THREADS = """
threads as (select post_id, coalesce(string_agg(body, chr(10) order by seq, body), '') body_text
  from {comments} group by post_id)"""
_JOINED_THREADS = """select p.post_id, t.post_id is not null has_comments, t.body_text
  from {posts} p left join threads t on t.post_id = p.post_id"""

_PROMPT = f"""'Title: ' || coalesce({_text("title")}, 'None') || chr(10) || chr(10) || 'Content: '
    || coalesce({_text("self_text")}, 'None')"""

# The stand-in model of `condense_callable`: every reply follows from a length.
_ASKED = f"""
{with_views(POSTS, COMMENTS)}, {_THREADS.format(comments="comments")},
sized as (select post_id, created_utc, length({_PROMPT}) n from posts),
issues as (select post_id, created_utc, 'diagnosis ' || n diagnosis,
    case n % 4 when 0 then 'High' when 1 then 'Medium' when 2 then 'Low' else 'None' end cybersecurity_relevance,
    case when n % 4 >= 2
         then 'general ' || length('Specific complaint: complaint ' || n || chr(10) || 'Provide a more general version:')
         else 'complaint ' || n end user_complaint
  from sized where n % 5 <> 0),
asked as (select i.*, length('User Complaint: ' || user_complaint || chr(10) || 'Diagnosis: ' || diagnosis
      || chr(10) || 'Comments: ' || t.body_text) n
  from issues i left join threads t on t.post_id = i.post_id)"""
_MEASURED = f"""{_ASKED}
select post_id, created_utc created_time, user_complaint, diagnosis, cybersecurity_relevance,
    case when 90 + n % 10 >= 95 and n % 2 = 0 then 'answer ' || n else '-999' end solution,
    case when n is null or (90 + n % 10 >= 95 and n % 2 = 0) then '-999' else 'answer ' || n end recommendation,
    case when 90 + n % 10 >= 95 then n || ' steps' else 'No steps' end steps,
    coalesce(cast(90 + n % 10 as double) / 100, 0) confidence
  from asked"""

_LEDGER = f"""{_OBJECTS}, {_ANALYSED},
ledger as (select post_id, status from analysed where post_id in (select post_id from comments))"""

_INGESTED = f"{with_views(POSTS)} select {_POST_COLUMNS} from posts where num_comments > 1"
_INGESTED_COMMENTS = with_views(POSTS, COMMENTS) + _KEPT_COMMENTS

ORACLE_SQL: dict[str, str] = {
    "normalize_ascii": f"""{with_views(POSTS)}
        select post_id, {_ascii("title")} title, {_ascii("self_text")} self_text from posts""",
    "normalize_text": f"""{with_views(POSTS)}
        select post_id, {_text("title")} title, {_text("self_text")} self_text from posts""",
    "extract_links": f"{with_views(POSTS)} select post_id, {_links('self_text')} links from posts",
    "extract_links_comments": f"{with_views(COMMENTS)} select comment_id, {_links('body')} links from comments",
    "post_type": """select page_id, case when length(url) > 0 then split_part(url, '.', -1) end post_type
        from pages""",
    "ingest_posts": f"""{with_views(POSTS)} select {_POST_COLUMNS} from (
        select *, row_number() over (partition by community order by upvotes desc, post_id) place
        from posts where num_comments > 1) where place <= {TOP_PER_COMMUNITY}""",
    "ingest_posts_all": _INGESTED,
    "top_posts_single": f"""{with_views(POSTS)}
        select post_id, upvotes from posts order by upvotes desc, post_id limit {TOP_SINGLE}""",
    "top_posts_large": f"""{with_views(ORDER_POSTS)} select community, post_id, upvotes from (
        select *, row_number() over (partition by community order by upvotes desc, post_id) place
        from order_posts) where place <= {TOP_LARGE}""",
    "ingest_comments": _INGESTED_COMMENTS,
    "flatten_tree": f"""{with_views(COMMENTS)},
        walk as (
          select post_id, comment_id, 0 depth, [pos] path from comments where parent_id is null
          union all
          select c.post_id, c.comment_id, w.depth + 1, list_append(w.path, c.pos)
          from walk w join comments c on c.post_id = w.post_id and c.parent_id = w.comment_id)
        select post_id, comment_id, cast(depth as bigint) depth,
          row_number() over (partition by post_id order by depth, path, comment_id) seq from walk""",
    "thread_text": f"""{with_views(POSTS, COMMENTS)}, {_THREADS.format(comments="comments")}
        {_JOINED_THREADS.format(posts="posts")}""",
    "thread_text_orders": f"""{with_views(ORDER_POSTS, LINE_COMMENTS)}, {_THREADS.format(comments="line_comments")}
        {_JOINED_THREADS.format(posts="order_posts")}""",
    "thread_text_long": f"""{with_views(LONG_THREADS)}, {_THREADS.format(comments="long_threads")}
        select post_id, body_text from threads""",
    "analysis_prompt": f"{with_views(POSTS)} select post_id, {_PROMPT} prompt from posts",
    "generalize_prompt": f"""{with_views(RESPONSES)}, {_OBJECTS}, {_ANALYSED}
        select post_id, 'Specific complaint: ' || user_complaint || chr(10) || 'Provide a more general version:' prompt
        from analysed where status = 'ok' and cybersecurity_relevance in ('Low', 'None')""",
    "answer_prompt": f"""{with_views(COMMENTS, RESPONSES)}, {_OBJECTS}, {_ANALYSED},
        {_THREADS.format(comments="comments")}
        select a.post_id, 'User Complaint: ' || a.user_complaint || chr(10) || 'Diagnosis: ' || a.diagnosis
          || chr(10) || 'Comments: ' || t.body_text prompt
        from analysed a join threads t on t.post_id = a.post_id where a.status = 'ok'""",
    "valid_issues": f"""{with_views(RESPONSES)}, {_OBJECTS}, {_ANALYSED}
        select post_id, user_complaint, diagnosis, cybersecurity_relevance from analysed where status = 'ok'""",
    "generalized_complaints": f"""{with_views(RESPONSES)}, {_OBJECTS}, {_ANALYSED}, {_ISSUES}
        select post_id, cybersecurity_relevance, user_complaint from issues""",
    "answer_decision": f"""{with_views(RESPONSES)}, {_OBJECTS},
        {_decided("(select post_id, j from objects where stage = 'answer')")} select * from decided""",
    "condense": _CONDENSE,
    "condense_outcomes": f"""{with_views(POSTS, COMMENTS, RESPONSES)}, {_OBJECTS}, {_ANALYSED}
        select p.post_id, a.status,
          case when a.status <> 'ok' then 'analysis'
               when p.post_id in (select post_id from comments) then 'answer'
               when a.cybersecurity_relevance in ('Low', 'None') then 'generalize' else 'analysis' end stage,
          case when a.status = 'failed' then 'reply is not a JSON object' end error
        from posts p join analysed a on a.post_id = p.post_id""",
    "resume_pending": f"""{with_views(POSTS, COMMENTS, RESPONSES)}, {_LEDGER}
        select post_id, community from posts p
        where not exists (select 1 from ledger l where l.post_id = p.post_id)""",
    "processing_totals": f"""{with_views(POSTS, COMMENTS, RESPONSES)}, {_LEDGER}
        select count(*) total_posts, count(l.status) processed,
          count(*) filter (where l.status = 'ok') ok,
          count(*) filter (where l.status = 'no_issue') no_issue,
          count(*) filter (where l.status = 'failed') failed,
          count(*) filter (where l.status is null) pending
        from posts p left join ledger l on l.post_id = p.post_id""",
    "union_results": _CONDENSE,
    "condense_callable": _MEASURED,
    "condense_incremental": _CONDENSE,
    "condense_incremental_table": _MEASURED,
    "condense_incremental_dealt": _MEASURED,
    "dead_letter": f"""{with_views(RESPONSES)}, {_OBJECTS}, {_ANALYSED}
        select post_id, 'analysis' stage, 'reply is not a JSON object' error from analysed where status = 'failed'""",
    "dead_letter_answers": f"""{_ASKED}
        select post_id, 'answer' stage, 'ValueError: refused' error, cast(1 as bigint) rounds
        from asked where n % 3 = 0""",
    "retry_answers": _MEASURED,
    "csv_roundtrip": _INGESTED,
    "csv_roundtrip_comments": f"""{with_views(POSTS, COMMENTS)}
        select c.*, p.community from ({_KEPT_COMMENTS}) c join posts p on p.post_id = c.post_id""",
    "csv_backup": _INGESTED,
    "csv_condensed": _CONDENSE,
    "csv_missing_communities": f"""{with_views(POSTS)}
        select distinct name community from (select unnest([source, lang]) as name from documents)
        where name not in (select community from posts where num_comments > 1)""",
    "ingest_json": _INGESTED,
    "ingest_json_comments": _INGESTED_COMMENTS,
    "ingest_stream": _INGESTED,
}
