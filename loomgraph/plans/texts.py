"""Readers of text exports for people, on exports made of the given tables; their common form; and appended runs."""

import uuid

from pyspark.sql import functions as F

from ..operators.graph import written
from ..registry import query
from ..sources import blocks
from ..sources.tables import table as t
from .sinks import append

BAR, DASHES = "=" * 72, "-" * 44


def _export(rows, by: str, order: str, block):
    """One export for each value of `by`: its blocks in order, with bars between."""
    g = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))).alias("l"))
    return g.select(F.array_join(F.transform("l", lambda x: x.b), f"\n{BAR}\n").alias("text"))


def _issues(spark, d):
    text = F.concat(F.lit("ORD-"), "o_orderkey", F.lit("\nTitle: Order of "), "o_custkey", F.lit("\nStatus: "), "o_orderstatus", F.lit("\nPriority: "), "o_orderpriority", F.lit("\n\nDescription:\nworth "), F.floor("o_totalprice").cast("string"))
    return _export(t(spark, d, "orders"), "o_custkey", "o_orderkey", text)


def _forms(spark, d):
    text = F.concat(F.lit("Submission #"), "c_custkey", F.lit("\nName: "), "c_name", F.lit("\nSubject: "), "c_mktsegment", F.lit("\n\nMessage:\nwritten in nation "), "c_nationkey")
    return _export(t(spark, d, "customer"), "c_nationkey", "c_custkey", text)


def _pages(spark, d):
    text = F.concat(F.lit("DOCUMENT: Part "), "p_partkey", F.lit(f"\n{DASHES}\nSpace: "), "p_brand", F.lit(f"\n{DASHES}\n"), "p_name")
    return _export(t(spark, d, "part").withColumn("shelf", F.floor(F.col("p_partkey") / 100)), "shelf", "p_partkey", text)


def _changes(spark, d):
    text = F.concat(F.lit("PR #"), "s_suppkey", F.lit(" - Supply of "), "s_name", F.lit("\nRepository: org/app\nStatus: Merged\n\nDescription:\nfrom nation "), "s_nationkey")
    return _export(t(spark, d, "supplier"), "s_nationkey", "s_suppkey", text)


def _chats(spark, d):
    said = F.concat(F.col("event_type"), F.lit(": did "), F.col("event_id").cast("string"))
    days = t(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("event_id", said.alias("s")))).alias("l"))
    text = F.concat(F.lit("#u"), "user_id", F.lit(" | "), "day", F.lit(f"\n{DASHES}\n"), F.array_join(F.transform("l", lambda x: x.s), "\n"))
    return _export(days, "user_id", "day", text)


@query(
    """WITH c AS (SELECT 'u' || user_id AS id, strftime(ts, '%Y-%m-%d') AS day, event_id, event_type || ': did ' || event_id AS s FROM events)
SELECT 'issues' AS provider, 'ORD-' || o_orderkey AS source_id, 'ORD-' || o_orderkey || ': Order of ' || o_custkey AS title, md5('# ORD-' || o_orderkey || ': Order of ' || o_custkey || chr(10) || chr(10) || 'Status: ' || o_orderstatus || ' | Priority: ' || o_orderpriority || chr(10) || chr(10) || '## Description' || chr(10) || 'worth ' || CAST(floor(o_totalprice) AS BIGINT)) AS content FROM orders
UNION ALL SELECT 'feedback', CAST(c_custkey AS VARCHAR), c_mktsegment, md5('# ' || c_mktsegment || chr(10) || chr(10) || 'From: ' || c_name || chr(10) || chr(10) || 'written in nation ' || c_nationkey) FROM customer
UNION ALL SELECT 'wiki', 'Part ' || p_partkey, 'Part ' || p_partkey, md5(p_name) FROM part
UNION ALL SELECT 'code', 'org/app/pull/' || s_suppkey, 'app PR #' || s_suppkey || ': Supply of ' || s_name, md5('# PR #' || s_suppkey || ': Supply of ' || s_name || chr(10) || chr(10) || 'State: Merged | Author: unknown' || chr(10) || chr(10) || 'from nation ' || s_nationkey) FROM supplier
UNION ALL SELECT 'chat', id, '#' || id, md5('# #' || id || chr(10) || chr(10) || string_agg(s, chr(10) ORDER BY day, event_id)) FROM c GROUP BY id"""
)
def s11_text_blocks(spark, d):
    """The five text formats, each made of a table and read back."""
    exports = {"issues": _issues, "feedback": _forms, "wiki": _pages, "code": _changes, "chat": _chats}
    out = None
    for provider, made in exports.items():
        rows = blocks.READERS[provider](made(spark, d)).select("provider", "source_id", "title", F.md5("content").alias("content"))
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT 'structured' AS format, 'issues-ord-' || o_orderkey AS slug, 'ORD-' || o_orderkey AS source_id, 'ORD-' || o_orderkey || ': Order of ' || o_custkey AS title FROM orders")
def s12_structured(spark, d):
    """Text exports of issues in the common form, which a JSON writer can take."""
    rows = blocks.structured(_issues(spark, d), "issues")
    return rows.select("format", "slug", "item.source_id", "item.title")


@query("SELECT o_orderkey, o_orderstatus, 'r' || (o_orderkey % 3) AS run_id, 'e' || (o_custkey % 2) AS execution_id FROM orders WHERE o_orderkey % 3 = 1")
def u01_append(spark, d):
    """Orders of three runs, appended one after the other; one run is read, from its own folders."""
    o = F.col("o_orderkey")
    rows = written(t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.concat(F.lit("r"), (o % 3).cast("string")).alias("run_id"), F.concat(F.lit("e"), (F.col("o_custkey") % 2).cast("string")).alias("execution_id")))
    path = f"{spark.conf.get('spark.checkpoint.dir')}/appended/{uuid.uuid4().hex}"
    for run in ("r0", "r1", "r2"):
        append(rows.where(F.col("run_id") == run), path)
    return spark.read.schema(rows.schema).parquet(path).where("run_id = 'r1'").select("o_orderkey", "o_orderstatus", "run_id", "execution_id")
