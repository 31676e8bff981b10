"""Aggregations."""

from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table as t


@query("SELECT coalesce(round(sum(l_quantity), 2), 0) AS tokens_in, coalesce(round(sum(l_extendedprice), 2), 0) AS tokens_out, coalesce(round(sum(l_extendedprice * l_discount), 2), 0) AS cost FROM lineitem WHERE l_returnflag = 'A'")
def a01_global_aggregate(spark, d):
    s = lambda c, n: F.coalesce(F.round(F.sum(c), 2), F.lit(0.0)).alias(n)
    return t(spark, d, "lineitem").where("l_returnflag = 'A'").agg(s(F.col("l_quantity"), "tokens_in"), s(F.col("l_extendedprice"), "tokens_out"), s(F.col("l_extendedprice") * F.col("l_discount"), "cost"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def a02_group_count(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def a03_counters(spark, d):
    return t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(*) AS total FROM orders")
def a04_filtered_counts(spark, d):
    return t(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 100000).alias("big"), F.count("*").alias("total"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def a05_distinct(spark, d):
    return t(spark, d, "orders").where("o_orderstatus = 'O'").select("o_custkey").distinct()


@query("SELECT event_type, count(*) FILTER (WHERE value >= 66) AS high, count(*) FILTER (WHERE value >= 33 AND value < 66) AS medium, count(*) FILTER (WHERE value < 33) AS low FROM events GROUP BY event_type")
def a06_distribution(spark, d):
    v = F.col("value")
    return t(spark, d, "events").groupBy("event_type").agg(F.count_if(v >= 66).alias("high"), F.count_if((v >= 33) & (v < 66)).alias("medium"), F.count_if(v < 33).alias("low"))


@query("SELECT source, count(*) AS docs, count(DISTINCT lang) AS langs, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(CAST(ceil(greatest(n_chars - 200, 1) / 800.0) AS BIGINT)) AS BIGINT) AS chunks FROM documents GROUP BY source")
def a07_multi_metric(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.countDistinct("lang").alias("langs"), F.sum("n_chars").alias("chars"), F.sum(F.ceil(F.greatest(F.col("n_chars") - 200, F.lit(1)) / 800.0)).alias("chunks"))


@query("SELECT user_id, event_type, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT CAST(ts AS DATE)) >= 2")
def a08_distinct_threshold(spark, d):
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days")).where("n >= 2 and days >= 2")


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS e FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY e) AS types FROM f GROUP BY user_id")
def a09_ordered_set(spark, d):
    first = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("e"))
    return first.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("e", "event_type")))["event_type"], ",").alias("types"))


@query("WITH s AS (SELECT user_id, event_type, CAST(sum(CASE event_type WHEN 'purchase' THEN 2 ELSE 1 END) AS BIGINT) AS score FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS r FROM s) SELECT user_id, event_type AS owner, score FROM r WHERE r = 1")
def a10_weighted_vote(spark, d):
    s = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum(F.when(F.col("event_type") == "purchase", 2).otherwise(1)).alias("score"))
    return s.groupBy("user_id").agg(F.min(F.struct((-F.col("score")).alias("m"), "event_type")).alias("b")).select("user_id", F.col("b.event_type").alias("owner"), (-F.col("b.m")).alias("score"))


@query("SELECT md5(text) AS k, min(doc_id) AS keeper, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, arg_min(lang, doc_id) AS lang FROM documents GROUP BY md5(text)")
def a12_group_merge(spark, d):
    return t(spark, d, "documents").groupBy(F.md5("text").alias("k")).agg(F.min("doc_id").alias("keeper"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min_by("lang", "doc_id").alias("lang"))


@query("SELECT user_id, round(sum(value), 2) AS cost, count(*) AS steps FROM events GROUP BY user_id")
def a13_run_rollup(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("cost"), F.count("*").alias("steps"))


@query("WITH e AS (SELECT DISTINCT o_custkey AS c FROM orders), n AS (SELECT count(*) AS n FROM customer) SELECT round(100.0 * count(e.c) / max(n.n), 4) AS connectivity, round((SELECT count(*) FROM orders) / max(n.n), 6) AS edges_per_entity, (SELECT count(*) FROM e WHERE c NOT IN (SELECT c_custkey FROM customer)) AS dangling FROM customer LEFT JOIN e ON e.c = c_custkey CROSS JOIN n")
def a14_graph_quality(spark, d):
    nodes = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(1).alias("node"))
    degree = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    both = nodes.join(degree, "k", "full")
    total = F.count("node")
    return both.agg(F.round(100.0 * F.count_if(F.col("node").isNotNull() & F.col("n").isNotNull()) / total, 4).alias("connectivity"), F.round(F.sum("n") / total, 6).alias("edges_per_entity"), F.count_if(F.col("node").isNull()).alias("dangling"))


CHECKS = [("docs", "gte", 900.0, None), ("sources", "eq", 20.0, None), ("short", "lte", 10.0, None), ("chars", "within", 2.0e6, None)]


def score_checks(measured, checks):
    """measured (key, actual) with checks (key, mode, target, tolerance): score 0 to 100 and severity.

    gte: share of the target reached; lte: target over actual; eq: all or nothing; within: all if in
    the tolerance (half of the target unless given), else less the further off.  Under 50 high, under 80 medium."""
    a, g = F.col("actual"), F.col("target")
    tol = F.coalesce("tolerance", F.floor(g * 0.5 + 0.5))
    share = F.when(F.col("mode") == "gte", F.when(a >= g, 1.0).otherwise(a / g)).when(F.col("mode") == "lte", F.when(a <= g, 1.0).otherwise(g / a)).when(F.col("mode") == "eq", (a == g).cast("double")).otherwise(F.when(F.abs(a - g) <= tol, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (F.abs(a - g) - tol) / g)))
    score = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 100 + 0.5)
    out = measured.join(checks, "key").withColumn("score", score)
    return out.withColumn("severity", F.when(F.col("score") < 50, "high").when(F.col("score") < 80, "medium").otherwise("low")).select("key", "score", "severity")


@query("WITH m AS (SELECT count(*) AS docs, count(DISTINCT source) AS sources, count(*) FILTER (WHERE n_chars < 20) AS short, CAST(sum(n_chars) AS DOUBLE) AS chars FROM documents), c AS (SELECT 'docs' AS key, CASE WHEN docs >= 900 THEN 1.0 ELSE docs / 900.0 END AS s FROM m UNION ALL SELECT 'sources', CASE WHEN sources = 20 THEN 1.0 ELSE 0.0 END FROM m UNION ALL SELECT 'short', CASE WHEN short <= 10 THEN 1.0 ELSE 10.0 / short END FROM m UNION ALL SELECT 'chars', CASE WHEN abs(chars - 2e6) <= 1e6 THEN 1.0 ELSE greatest(0.0, 1 - (abs(chars - 2e6) - 1e6) / 2e6) END FROM m) SELECT key, CAST(floor(s * 100 + 0.5) AS BIGINT) AS score, CASE WHEN floor(s * 100 + 0.5) < 50 THEN 'high' WHEN floor(s * 100 + 0.5) < 80 THEN 'medium' ELSE 'low' END AS severity FROM c")
def a15_check_scorer(spark, d):
    m = t(spark, d, "documents").agg(F.count("*").cast("double").alias("docs"), F.countDistinct("source").cast("double").alias("sources"), F.count_if(F.col("n_chars") < 20).cast("double").alias("short"), F.sum("n_chars").cast("double").alias("chars"))
    measured = m.unpivot([], ["docs", "sources", "short", "chars"], "key", "actual")
    return score_checks(measured, spark.createDataFrame(CHECKS, "key string, mode string, target double, tolerance double"))


@query("WITH k AS (SELECT DISTINCT event_type, unnest(json_keys(props)) AS k FROM events) SELECT event_type, string_agg(k, ',' ORDER BY k) AS keys FROM k GROUP BY event_type")
def a18_facet_union(spark, d):
    return t(spark, d, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("k")).groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("keys"))
