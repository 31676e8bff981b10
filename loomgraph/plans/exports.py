"""Readers of exported JSON, on exports made of the given tables; and windows of sessions."""

from pyspark.sql import functions as F

from ..registry import query
from ..sources import tables
from ..sources.tables import table as t
from ..streaming.ingest import session_windows


def named(value, name: str = "displayName"):
    return F.struct(value.alias(name))


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS source_id, 'Doc ' || doc_id AS title, md5(text) AS content, CASE WHEN doc_id % 2 = 0 THEN 'editor' ELSE source END AS author "
    "FROM documents WHERE coalesce(text, '') <> ''"
)
def s06_wiki_json(spark, d):
    author = F.when(F.col("doc_id") % 2 == 0, "editor")
    page = F.struct(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Doc "), "doc_id").alias("title"), named(named(F.col("text"), "value"), "storage").alias("body"), named(named(author), "by").alias("version"), named(named(F.col("source")), "createdBy").alias("history"))
    pages = tables.wiki_pages(t(spark, d, "documents").select(F.array(page).alias("results")))
    return pages.select("source_id", "title", F.md5("content").alias("content"), "author")


@query(
    "SELECT 'ORD-' || o_orderkey AS source_id, 'Order of ' || o_custkey AS title, md5('# ORD-' || o_orderkey || ': Order of ' || o_custkey || chr(10) || chr(10) "
    "|| 'Type: order | Status: ' || o_orderstatus || ' | Priority: ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ' | Assignee: ann' ELSE '' END "
    "|| chr(10) || chr(10) || '## Description' || chr(10) || 'worth ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) "
    "|| CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || chr(10) || '## Comments' || chr(10) || 'bob: seen' ELSE '' END) AS content FROM orders"
)
def s07_issue_json(spark, d):
    said = F.struct(named(F.lit("bob")).alias("author"), F.lit("seen").alias("body"))
    fields = F.struct(
        F.concat(F.lit("Order of "), "o_custkey").alias("summary"),
        named(F.lit("order"), "name").alias("issuetype"),
        named(F.col("o_orderstatus"), "name").alias("status"),
        named(F.col("o_orderpriority"), "name").alias("priority"),
        named(F.when(F.col("o_orderkey") % 2 == 0, "ann")).alias("assignee"),
        F.concat(F.lit("worth "), F.floor("o_totalprice").cast("long")).alias("description"),
        F.struct(F.when(F.col("o_orderkey") % 3 == 0, F.array(said)).otherwise(F.array_except(F.array(said), F.array(said))).alias("comments")).alias("comment"),
    )
    issue = F.struct(F.concat(F.lit("ORD-"), "o_orderkey").alias("key"), fields.alias("fields"))
    return tables.issues(t(spark, d, "orders").select(F.array(issue).alias("issues"))).select("source_id", "title", F.md5("content").alias("content"))


@query(
    "SELECT CAST(conv_id AS VARCHAR) AS source_id, 'chat ' || conv_id AS title, "
    "md5(string_agg(concat_ws(' ', '1970-01-01 00:01', role || ':', replace(text, 'the', '@ann')), chr(10) ORDER BY turn, role, text)) AS content, count(DISTINCT role) AS participants "
    "FROM conversations WHERE text IS NOT NULL GROUP BY conv_id"
)
def s08_chat_json(spark, d):
    m = t(spark, d, "conversations").where("text is not null")
    m = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    said = F.transform("l", lambda x: F.struct(F.lit("60").alias("ts"), F.replace(x.text, F.lit("the"), F.lit("<@U1>")).alias("text"), named(x.role, "name").alias("user_profile")))
    channel = F.struct(F.struct(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("chat "), "conv_id").alias("name")).alias("channel"), said.alias("messages"))
    raw = m.select(F.create_map(F.lit("U1"), F.lit("ann")).alias("user_map"), F.array(channel).alias("messages_by_channel"))
    return tables.chat_channels(raw).select("source_id", "title", F.md5("content").alias("content"), F.size("participants").cast("long").alias("participants"))


@query(
    "WITH r AS (SELECT p_partkey, 'repo' || p_partkey AS name, p_name, p_size FROM part) "
    "SELECT 'tree' AS kind, name AS source_id, name AS title, md5('file ' || p_name || chr(10) || 'dir src') AS content FROM r "
    "UNION ALL SELECT 'file', name || '/' || p_name, p_name, md5('size ' || p_size) FROM r WHERE p_size % 2 = 0 "
    "UNION ALL SELECT 'pull_request', name || '#' || p_size, 'PR #' || p_size || ' - Add ' || p_name, md5('why') FROM r WHERE p_size % 3 = 0"
)
def s09_code_json(spark, d):
    entries = F.array(F.struct(F.lit("file").alias("type"), F.col("p_name").alias("path")), F.struct(F.lit("dir").alias("type"), F.lit("src").alias("path")))
    file = F.struct(F.col("p_name").alias("path"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("size "), "p_size")).alias("content"))
    change = F.struct(F.col("p_size").alias("number"), F.concat(F.lit("Add "), "p_name").alias("title"), F.lit("why").alias("body"))
    changes = F.filter(F.array(change), lambda x: x.number % 3 == 0)
    repo = F.struct(named(F.concat(F.lit("repo"), "p_partkey"), "name").alias("repo"), named(entries, "entries").alias("directory_tree"), F.array(file).alias("files"), changes.alias("pull_requests"))
    return tables.code_host(t(spark, d, "part").select(F.array(repo).alias("repos"))).select("kind", "source_id", "title", F.md5("content").alias("content"))


@query("SELECT CAST(doc_id AS VARCHAR) AS source_id, source AS title, md5(text) AS content, lang FROM documents WHERE coalesce(source, '') <> ''")
def s10_feedback_json(spark, d):
    ticket = F.struct(F.col("doc_id").alias("id"), F.col("source").alias("subject"), F.col("text").alias("description"), F.array(F.struct(F.lit("lang").alias("id"), F.col("lang").alias("value"))).alias("custom_fields"))
    found = tables.feedback(t(spark, d, "documents").select(F.array(ticket).alias("tickets")))
    return found.select("source_id", "title", F.md5("content").alias("content"), F.col("custom_fields")["lang"].alias("lang"))


@query(
    "WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), "
    "f AS (SELECT *, CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM l), "
    "g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f) "
    "SELECT user_id, epoch_us(min(ts)) // 1000000 AS start, epoch_us(max(ts)) // 1000000 + 21600 AS stop, count(*) AS n FROM g GROUP BY user_id, s"
)
def x04_session_windows(spark, d):
    """The stream's session windows, over a table; seconds since 1970 of the times as they are written."""
    e = t(spark, d, "events").select("user_id", F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("+00:00"))).alias("ts"))
    return session_windows(e).select("user_id", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("stop"), "n")
