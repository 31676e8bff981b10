"""Latest rows, ranks, sessions and fills."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.graph import written
from ..operators.scan import prefix_scan
from ..registry import query
from ..sources.tables import table as t


@query("SELECT user_id, event_type, arg_max(event_id, ts) AS event_id FROM (SELECT user_id, event_type, ts, max(event_id) AS event_id FROM events GROUP BY ALL) GROUP BY 1, 2")
def w01_latest_per_key(spark, d):
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("b")).select("user_id", "event_type", "b.event_id")


@query("WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey, o_orderkey, o_orderdate FROM r WHERE r = 1")
def w02_latest_completed(spark, d):
    done = t(spark, d, "orders").where("o_orderstatus = 'F'")
    return done.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("b")).select("o_custkey", "b.o_orderkey", "b.o_orderdate")


@query("SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS execution_number, lag(event_id) OVER w AS parent FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def w03_next_ordinal(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t(spark, d, "events").select("event_id", F.row_number().over(w).alias("execution_number"), F.lag("event_id").over(w).alias("parent"))


@query("WITH k AS (SELECT o_orderkey, o_orderdate, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'p' || o_custkey END, CASE WHEN o_orderkey % 3 = 1 THEN 't' || o_custkey END, 'o' || o_orderkey) AS k FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM k) SELECT k, o_orderkey FROM r WHERE r = 1")
def w04_keep_newest(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    k = F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, key("p", "o_custkey")), F.when(F.col("o_orderkey") % 3 == 1, key("t", "o_custkey")), key("o", "o_orderkey"))
    return t(spark, d, "orders").groupBy(k.alias("k")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("b")).select("k", "b.o_orderkey")


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS r FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(r AS INTEGER) AS r FROM r WHERE r <= 3")
def w05_top_n(spark, d):
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey"))
    return t(spark, d, "lineitem").withColumn("r", r).where("r <= 3").select("l_orderkey", "l_linenumber", "l_extendedprice", "r")


@query("SELECT md5(text) AS k, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def w06_first_wins(spark, d):
    return t(spark, d, "documents").groupBy(F.md5("text").alias("k")).agg(F.min("doc_id").alias("doc_id"))


@query("WITH s AS (SELECT p_partkey, p_brand, p_size + len(string_split(p_name, ' ')) AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS r FROM s) SELECT p_brand, p_partkey, score FROM r WHERE r = 1")
def w07_score_dedupe(spark, d):
    s = t(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") + F.size(F.split("p_name", " "))).cast("long").alias("score"))
    return s.groupBy("p_brand").agg(F.max(F.struct("score", (-F.col("p_partkey")).alias("m"))).alias("b")).select("p_brand", (-F.col("b.m")).alias("p_partkey"), "b.score")


@query(
    "WITH e AS (SELECT event_id, user_id, ts, nullif(event_type, 'view') AS thread FROM events), "
    "l AS (SELECT *, lag(ts) OVER w AS p FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "f AS (SELECT *, p IS NULL OR CAST(p AS DATE) <> CAST(ts AS DATE) OR epoch_us(ts) - epoch_us(p) > 21600000000 AS apart FROM l), "
    "b AS (SELECT event_id, thread IS NOT NULL AND thread = lag(thread) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS same FROM f WHERE apart), "
    "n AS (SELECT f.*, CASE WHEN apart AND NOT coalesce(same, false) THEN 1 ELSE 0 END AS new FROM f LEFT JOIN b USING (event_id)) "
    "SELECT event_id, user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM n"
)
def w08_gap_sessions(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "view", F.col("event_type")).alias("thread"))
    return sessions(e, "user_id").select("event_id", "user_id", "session")


def sessions(rows, key: str, hours: int = 6):
    """rows (key, ts, event_id, and thread if there are any) with `session`: a new one at another date or after a gap of over `hours`, unless the
    row is in the thread of the session's first row.

    Only rows that lie so apart can begin a session; whichever they do, the thread to compare with is from then on their
    own.  So each is compared with the one before it that lies apart, and no state is carried along."""
    rows = rows if "thread" in rows.columns else rows.withColumn("thread", F.lit(None).cast("string"))
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    p = F.lag("ts").over(w)
    gap = (F.col("ts").cast("timestamp").cast("double") - p.cast("timestamp").cast("double")) > hours * 3600
    apart = rows.withColumn("apart", p.isNull() | (F.to_date(p) != F.to_date("ts")) | gap)
    # The last row before this one that lies apart, as (ts, event_id) grow: one struct, so that a null thread counts.
    before = F.last(F.when(F.col("apart"), F.struct("thread")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))["thread"]
    new = (F.col("apart") & ~F.coalesce(F.col("thread") == before, F.lit(False))).cast("int")
    return apart.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new", "apart")


@query("SELECT conv_id, turn, conv_id || ':message:' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS unit_id FROM conversations")
def w09_ordinals(spark, d):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return t(spark, d, "conversations").select("conv_id", "turn", F.concat(F.col("conv_id"), F.lit(":message:"), n).alias("unit_id"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked_at FROM conversations")
def w10_forward_fill(spark, d):
    turns = t(spark, d, "conversations").select("conv_id", "turn", "role")
    return prefix_scan(turns, "conv_id", ["turn"], value=F.when(F.col("role") == "user", F.col("turn")), last_as="asked_at").select("conv_id", "turn", "asked_at")


#: A line that begins a message: its time, who wrote it if it says, and what.
MESSAGE = r"^\[([0-9]{2}:[0-9]{2}:[0-9]{2})\]\s*(?:<@([A-Za-z0-9_]+)>\s*)?(.+)$"


def messages(lines, names):
    """(id, message, time, author, text) of lines (id, line, text): a line that MESSAGE fits begins one, any other goes on with the one
    before; lines before the first one and blank ones are left out.

    A message without an author has that of the last one before it that has one, else 'Unknown'; names (user, name; the least
    name counts) are put for users, in texts as @name.  Messages are numbered and authors carried by a prefix scan, so a conversation with
    very many lines is no single task's; only the lines of one message meet.  Null texts are blank, null ids or lines go."""
    known = names.where("user is not null and name is not null").groupBy("user").agg(F.min("name").alias("name"))
    rows = lines.where("id is not null and line is not null").select("id", "line", F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n")).alias("text")).where("text <> ''")
    begins = F.col("text").rlike(MESSAGE)
    rows = rows.withColumn("user", F.when(begins, F.nullif(F.regexp_extract("text", MESSAGE, 2), F.lit(""))))
    run = prefix_scan(rows, "id", ["line"], step=begins.cast("long"), value=F.when(F.col("user").isNotNull(), F.col("line")), sum_as="message", last_as="by").where("message > 0")
    said = F.when(begins, F.btrim(F.regexp_extract("text", MESSAGE, 3), F.lit(" \t\r\n"))).otherwise(F.col("text"))
    run = run.select("id", "line", "message", "by", "user", F.when(begins, F.regexp_extract("text", MESSAGE, 1)).alias("time"), said.alias("said")).withColumn("row", F.monotonically_increasing_id())
    run = written(run)
    # Names in texts: each user that a line mentions, looked up and put back.
    found = F.array_distinct(F.regexp_extract_all("said", F.lit("<@([A-Za-z0-9_]+)>"), F.lit(1)))
    asked = run.select("row", F.explode(found).alias("user")).join(known, "user").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("user", "name"))).alias("names"))
    put = F.aggregate(found, F.col("said"), lambda acc, u: F.coalesce(F.replace(acc, F.concat(F.lit("<@"), u, F.lit(">")), F.concat(F.lit("@"), F.element_at("names", u))), acc))
    run = run.join(asked, "row", "left").withColumn("said", F.when(F.col("names").isNull(), F.col("said")).otherwise(put))
    whole = run.groupBy("id", "message").agg(F.max("time").alias("time"), F.max(F.when(F.col("time").isNotNull(), F.col("by"))).alias("by"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda s: s.said), "\n").alias("text"))
    authors = run.where("user is not null").groupBy("id", F.col("line").alias("by")).agg(F.min("user").alias("user")).join(known, "user", "left").select("id", "by", F.coalesce("name", "user").alias("author"))
    return whole.join(authors, ["id", "by"], "left").select("id", "message", "time", F.coalesce("author", F.lit("Unknown")).alias("author"), "text")


def conversation_lines(docs):
    """Lines (id, line, text) after 'Full conversation:' of docs (id, content)."""
    return docs.where(F.col("content").contains("Full conversation:")).select("id", F.posexplode(F.split(F.substr("content", F.locate("Full conversation:", "content") + 18), "\n")).alias("line", "text"))


@query(
    r"""WITH l AS (SELECT conv_id AS id, turn AS line, trim(CASE turn % 4 WHEN 1 THEN '[10:00:0' || (turn % 10) || '] <@' || role || '> ' || t WHEN 2 THEN '[10:00:0' || (turn % 10) || '] ' || t WHEN 3 THEN 'so <@user> and <@nobody> ' || t ELSE t END) AS text
  FROM (SELECT conv_id, turn, role, replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' ') AS t FROM conversations)),
m AS (SELECT *, regexp_matches(text, '^\[([0-9]{2}:[0-9]{2}:[0-9]{2})\]\s*(?:<@([A-Za-z0-9_]+)>\s*)?(.+)$') AS b FROM l WHERE text <> ''),
r AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line) AS message, CASE WHEN b THEN nullif(regexp_extract(text, '^\[([0-9:]{8})\]\s*<@([A-Za-z0-9_]+)>', 2), '') END AS u FROM m),
f AS (SELECT *, last_value(u IGNORE NULLS) OVER (PARTITION BY id ORDER BY line) AS who, trim(CASE WHEN b THEN regexp_extract(text, '^\[([0-9]{2}:[0-9]{2}:[0-9]{2})\]\s*(?:<@([A-Za-z0-9_]+)>\s*)?(.+)$', 3) ELSE text END) AS said FROM r)
SELECT id, CAST(message AS BIGINT) AS message, max(CASE WHEN b THEN substr(text, 2, 8) END) AS time, coalesce(CASE max(CASE WHEN b THEN who END) WHEN 'user' THEN 'Ada' ELSE max(CASE WHEN b THEN who END) END, 'Unknown') AS author,
  string_agg(replace(said, '<@user>', '@Ada'), chr(10) ORDER BY line) AS text FROM f WHERE message > 0 GROUP BY id, message"""
)
def w10_messages(spark, d):
    """Turns as lines of a conversation: the first of each four names its author, the second doesn't, the others go on."""
    n, said = F.col("turn"), F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ")
    time = F.concat(F.lit("[10:00:0"), n % 10, F.lit("] "))
    text = F.when(n % 4 == 1, F.concat(time, F.lit("<@"), "role", F.lit("> "), said)).when(n % 4 == 2, F.concat(time, said)).when(n % 4 == 3, F.concat(F.lit("so <@user> and <@nobody> "), said)).otherwise(said)
    lines = t(spark, d, "conversations").select(F.col("conv_id").alias("id"), n.alias("line"), F.trim(text).alias("text"))
    return messages(lines, spark.createDataFrame([("user", "Ada")], "user string, name string"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 30")
def w11_ranked_cap(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(30)


@query("SELECT event_id, CAST(floor(100.0 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) / count(*) OVER (PARTITION BY user_id)) AS BIGINT) AS percent FROM events")
def w12_progress(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts")
    run = prefix_scan(e, "user_id", ["ts", "event_id"], step=F.lit(1), sum_as="at")
    return run.join(e.groupBy("user_id").count(), "user_id").select("event_id", F.floor(100.0 * F.col("at") / F.col("count")).alias("percent"))


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS first_order FROM orders GROUP BY o_custkey")
def v08_first_per_key(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))


@query("SELECT b.p AS priority, count(o_orderkey) AS n FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('9-NONE')) b(p) LEFT JOIN orders ON o_orderpriority = b.p GROUP BY b.p")
def v09_enum_buckets(spark, d):
    b = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",), ("9-NONE",)], "priority string")
    n = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return b.join(n, "priority", "left").fillna(0, ["n"])


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def v10_recent(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'cancelled' ELSE o_orderstatus END AS status FROM orders")
def v11_stuck_repair(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "cancelled").otherwise(F.col("o_orderstatus")).alias("status"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'order ' || o_orderkey WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'run: ' || substr(o_orderpriority, 1, 60) END AS title FROM orders")
def v14_back_fill(spark, d):
    from ..functions.text import truthy

    title = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("order "), F.col("o_orderkey"))).otherwise("")
    rest = F.when(F.col("o_orderstatus") == "F", "finished").otherwise(F.concat(F.lit("run: "), F.substring("o_orderpriority", 1, 60)))
    return t(spark, d, "orders").select("o_orderkey", truthy(title, rest).alias("title"))


@query("WITH a AS (SELECT user_id AS k, avg(value) AS x FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id AS k, avg(value) AS y FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, abs(coalesce(x, 0) - coalesce(y, 0)) <= 15 AS agree FROM a FULL JOIN b ON a.k = b.k")
def v15_rater_agreement(spark, d):
    rated = lambda kind, as_: t(spark, d, "events").where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("k")).agg(F.avg("value").alias(as_))
    return rated("click", "x").join(rated("purchase", "y"), "k", "full").select("k", (F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))) <= 15).alias("agree"))
