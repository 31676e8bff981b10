"""Readers.  A dataset is a folder of Parquet; filters and column choices reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(c: str) -> Column:
    """A timestamp without zone as one in UTC micros."""
    return F.unix_micros(F.to_timestamp(F.concat(F.col(c).cast("string"), F.lit("+00:00"))))


def issues(raw: DataFrame) -> DataFrame:
    """Issue tracker JSON (column `issues`: array of structs) to documents: needs key and summary."""
    i = raw.select(F.explode("issues").alias("i")).select("i.*").where("key is not null and fields.summary is not null")
    meta = F.array_join(F.array_compact(F.array(F.concat(F.lit("Type: "), F.col("fields.issuetype.name")), F.concat(F.lit("Status: "), F.col("fields.status.name")), F.concat(F.lit("Priority: "), F.col("fields.priority.name")), F.concat(F.lit("Assignee: "), F.col("fields.assignee.displayName")))), " | ")
    said = F.transform("fields.comment.comments", lambda c: F.concat_ws(": ", c.author.displayName, c.body))
    comments = F.when(F.size("fields.comment.comments") > 0, F.concat(F.lit("## Comments\n"), F.array_join(said, "\n")))
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("key"), F.lit(": "), F.col("fields.summary")), meta, F.concat(F.lit("## Description\n"), F.col("fields.description")), comments)
    return i.select(F.col("key").alias("source_id"), F.lit("issues").alias("provider"), F.col("fields.summary").alias("title"), body.alias("content"))


def wiki_pages(raw: DataFrame) -> DataFrame:
    """Wiki JSON (column `results`) to documents: needs a title and a body; author of the version, else the creator."""
    p = raw.select(F.explode("results").alias("p")).select("p.*").where("coalesce(title, '') <> '' and coalesce(body.storage.value, '') <> ''")
    return p.select(F.col("id").alias("source_id"), F.lit("wiki").alias("provider"), "title", F.col("body.storage.value").alias("content"), F.coalesce("version.by.displayName", "history.createdBy.displayName").alias("author"))


def chat_channels(raw: DataFrame) -> DataFrame:
    """Chat JSON (columns messages_by_channel, user_map) to one document a channel: `YYYY-MM-DD HH:MM name: text`
    lines in message order, mentions resolved by the user map, participants in order of appearance."""
    c = raw.select("user_map", F.explode("messages_by_channel").alias("c"))
    m = c.select("user_map", F.col("c.channel.id").alias("source_id"), F.col("c.channel.name").alias("title"), F.posexplode("c.messages").alias("pos", "m"))
    at = F.date_format(F.timestamp_seconds(F.expr("try_cast(m.ts as double)")), "yyyy-MM-dd HH:mm")
    m = m.select("source_id", "title", "user_map", "pos", F.coalesce(at, F.lit("")).alias("at"), F.col("m.user_profile.name").alias("author"), F.col("m.text").alias("text"))
    m = m.withColumn("text", mentions(F.col("text"), F.col("user_map")))
    line = F.concat_ws(" ", "at", F.concat("author", F.lit(":")), "text")
    g = m.groupBy("source_id", "title").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line"), "author"))).alias("l"))
    return g.select("source_id", F.lit("chat").alias("provider"), "title", F.array_join("l.line", "\n").alias("content"), F.array_distinct(F.array_compact("l.author")).alias("participants"))


def mentions(text: Column, names: Column) -> Column:
    """<@id> becomes @name where the map has the id."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("<@([A-Za-z0-9]+)>"), F.lit(1)))
    return F.aggregate(found, text, lambda acc, i: F.coalesce(F.replace(acc, F.concat(F.lit("<@"), i, F.lit(">")), F.concat(F.lit("@"), names[i])), acc))


def feedback(raw: DataFrame) -> DataFrame:
    """Helpdesk JSON (column `tickets`) to documents: needs a subject; custom fields become a map by id."""
    t = raw.select(F.explode("tickets").alias("t")).select("t.*").where("coalesce(subject, '') <> ''")
    return t.select(F.col("id").cast("string").alias("source_id"), F.lit("feedback").alias("provider"), F.col("subject").alias("title"), F.col("description").alias("content"), F.map_from_entries(F.transform("custom_fields", lambda f: F.struct(f.id, f.value))).alias("custom_fields"))


def code_host(raw: DataFrame) -> DataFrame:
    """Code host JSON (column `repos`) to three kinds of document: the tree, files with content, pull requests."""
    r = raw.select(F.explode("repos").alias("r")).select("r.*")
    tree = r.select(F.col("repo.name").alias("source_id"), F.lit("tree").alias("kind"), F.col("repo.name").alias("title"), F.array_join(F.transform("directory_tree.entries", lambda e: F.concat_ws(" ", e.type, e.path)), "\n").alias("content"))
    f = r.select("repo", F.explode("files").alias("f")).where("coalesce(f.content, '') <> ''")
    files = f.select(F.concat_ws("/", "repo.name", "f.path").alias("source_id"), F.lit("file").alias("kind"), F.col("f.path").alias("title"), F.col("f.content").alias("content"))
    p = r.select("repo", F.explode("pull_requests").alias("p"))
    prs = p.select(F.concat(F.col("repo.name"), F.lit("#"), F.col("p.number")).alias("source_id"), F.lit("pull_request").alias("kind"), F.concat(F.lit("PR #"), F.col("p.number"), F.lit(" - "), F.col("p.title")).alias("title"), F.col("p.body").alias("content"))
    return tree.unionByName(files).unionByName(prs).withColumn("provider", F.lit("code"))
