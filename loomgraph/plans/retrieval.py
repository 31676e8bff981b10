"""Retrieval, claims, leakage and incremental ingest."""

from pyspark.sql import functions as F

from ..functions.text import char_grams
from ..registry import query
from ..sources.tables import table as t


@query("SELECT doc_id, i - 1 AS item, sha256(doc_id || '|' || (i - 1)) AS claim_id FROM documents, generate_series(1, 100000) g(i) WHERE i <= len(string_split(text, chr(10))) AND trim(string_split(text, chr(10))[i]) <> ''")
def y17_claims(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("item", "l")).where("trim(l) <> ''")
    return lines.select("doc_id", F.col("item").cast("long").alias("item"), F.sha2(F.concat_ws("|", "doc_id", "item"), 256).alias("claim_id"))


LEAKS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("key", "AKIA[0-9A-Z]{16}"), ("password", "password=[0-9a-f]+")]


@query("WITH l AS (SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS l FROM documents, generate_series(1, 100000) g(i) WHERE i <= len(string_split(text, chr(10)))), r(label, p) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in LEAKS) + ") SELECT doc_id, line, label, regexp_extract(l, p) AS snippet FROM l, r WHERE regexp_matches(l, p)")
def y25_leakage_scan(spark, d):
    """File, line, label and text of each line that a rule matches; the rules are alternatives of one filter first."""
    lines = t(spark, d, "documents").where(F.col("text").rlike("|".join(f"(?:{p})" for _, p in LEAKS))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    hits = F.array(*[F.when(F.col("l").rlike(p), F.struct(F.lit(a).alias("label"), F.regexp_extract("l", p, 0).alias("snippet"))) for a, p in LEAKS])
    return lines.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), F.explode(F.array_compact(hits)).alias("h")).select("doc_id", "line", "h.label", "h.snippet")


#: Keys of passages that are compared in each row; more are met by a join of all keys.
KEYS = 2000


@query("SELECT b.item_id, count(DISTINCT d.doc_id) AS docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def y25_contamination(spark, d):
    """Benchmark passages that lie whole in a document.  The second to fourth of a passage's five or more words, split at
    spaces, are words of any text that holds it: passage and document meet there, and the whole is compared.  Shorter
    passages meet texts at their first three characters (of less than three, at the first); an empty one lies in every text that is not null."""
    key = lambda *c: F.xxhash64(*c)
    shingles = F.transform(F.array(F.split("text", " ")), lambda w: F.when(F.size(w) > 2, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: key(F.lit("w"), w[i], w[i + 1], w[i + 2]))))[0]
    runs = lambda n: F.transform(char_grams(F.col("text"), n), lambda g: key(F.lit("c"), g))
    docs = t(spark, d, "documents").select("doc_id", "text")
    b = t(spark, d, "benchmark").where("text <> ''").select("item_id", F.col("text").alias("passage"))
    w = F.split("passage", " ")
    b = b.withColumn("g", F.when(F.size(w) > 4, key(F.lit("w"), w[1], w[2], w[3])).otherwise(key(F.lit("c"), F.when(F.length("passage") > 2, F.substring("passage", 1, 3)).otherwise(F.substring("passage", 1, 1)))))
    # Runs of characters are made only if there are passages of less than five words.
    short = b.where(F.size(F.split("passage", " ")) < 5).limit(1).count()
    keys = F.coalesce(shingles, F.array().cast("array<bigint>"))
    keys = F.array_distinct(F.concat(keys, runs(3), runs(1)) if short else keys)
    sought = [r.g for r in b.select("g").distinct().limit(KEYS + 1).collect()]
    if len(sought) <= KEYS:  # only what a passage begins with leaves its row
        keys = F.array_intersect(keys, F.lit(sought) if sought else F.array().cast("array<bigint>"))
    met = docs.select("doc_id", F.explode(keys).alias("g")).join(b, "g").select("doc_id", "item_id", "passage")
    found = met.join(docs, "doc_id").where(F.col("text").contains(F.col("passage"))).groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"))
    every = docs.where("text is not null").agg(F.countDistinct("doc_id").alias("docs")).select(F.lit("").alias("text"), "docs").where("docs > 0")
    return found.union(t(spark, d, "benchmark").select("item_id", "text").distinct().join(F.broadcast(every), "text").select("item_id", "docs"))  # one row


@query("WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS last_action FROM events WHERE event_type <> 'view' GROUP BY user_id) SELECT user_id, last_action, last_action = 'purchase' AS accepted FROM a")
def y23_last_action_wins(spark, d):
    a = t(spark, d, "events").where("event_type <> 'view'").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_action"))
    return a.withColumn("accepted", F.col("last_action") == "purchase")


@query("WITH o AS (SELECT doc_id, md5(CASE WHEN toxic = 1 THEN text || ' ' ELSE text END) AS h FROM documents JOIN labels USING (doc_id)) SELECT d.source, count(*) FILTER (WHERE o.doc_id IS NULL) AS created, count(*) FILTER (WHERE o.h <> md5(d.text)) AS updated, count(*) FILTER (WHERE o.h = md5(d.text)) AS unchanged FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id GROUP BY d.source")
def x02_hash_sync(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("now"))
    old = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select("doc_id", F.md5(F.when(F.col("toxic") == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text"))).alias("was"))
    j = docs.join(old, "doc_id", "left")
    return j.groupBy("source").agg(F.count_if(F.col("was").isNull()).alias("created"), F.count_if(F.col("was") != F.col("now")).alias("updated"), F.count_if(F.col("was") == F.col("now")).alias("unchanged"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(license|version)') AND lang IN ('en', 'fr')")
def v12_multi_field_search(spark, d):
    return t(spark, d, "documents").where(F.col("text").rlike("(?i)(license|version)") & F.col("lang").isin("en", "fr")).select("doc_id")
