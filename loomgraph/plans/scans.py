"""Scans, projections, filters, sorts and set operations."""

from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table as t


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click'")
def s01_collection_scan(spark, d):
    return t(spark, d, "events").where("event_type = 'click'").select("event_id", "user_id", "value")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1")
def s02_point_lookup(spark, d):
    return t(spark, d, "orders").where("o_orderstatus = 'F'").orderBy("o_orderkey").limit(1).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def s03_latest_row(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1)


@query("SELECT doc_id AS source_id, 'generic' AS provider, text AS content, n_chars AS chars FROM documents")
def s13_generic_source(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.lit("generic").alias("provider"), F.col("text").alias("content"), F.col("n_chars").alias("chars"))


@query("SELECT source, count(*) AS docs, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS units, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def s14_input_snapshot(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.size(F.split("text", "\n"))).alias("units"), F.sum("n_chars").alias("chars"))


@query("SELECT c_custkey, c_name, 'state_1' AS state_id FROM customer WHERE c_mktsegment = 'BUILDING'")
def s15_snapshot_clone(spark, d):
    return t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", F.lit("state_1").alias("state_id"))


@query("SELECT vec_id, label, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first_component FROM embeddings")
def s16_vector_scan(spark, d):
    return t(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first_component"))


@query("SELECT c_custkey, c_name FROM customer")
def f01_projection(spark, d):
    return t(spark, d, "customer").drop("c_nationkey", "c_acctbal", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def f02_equality(spark, d):
    return t(spark, d, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F'").select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE event_type = 'purchase' OR value > 90")
def f03_disjunction(spark, d):
    return t(spark, d, "events").where("event_type = 'purchase' or value > 90").select("event_id")


@query("SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent, (o_orderstatus NOT IN ('F') OR o_orderstatus IS NULL) AS unfinished FROM orders")
def f04_membership(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("urgent"), (~F.col("o_orderstatus").isin("F") | F.col("o_orderstatus").isNull()).alias("unfinished"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def f05_existence(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left").where("quality is null").select("doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 5")
def f06_range(spark, d):
    return t(spark, d, "lineitem").where("l_quantity <= 5").select("l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e') OR starts_with(text, 'The')")
def f07_regex(spark, d):
    return t(spark, d, "documents").where(F.col("text").rlike("(?i)licen[sc]e") | F.col("text").startswith("The")).select("doc_id")


@query("SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: regexp_matches(x, '^[a-c]'))) > 0")
def f08_element_match(spark, d):
    return t(spark, d, "part").where(F.exists(F.split("p_name", " "), lambda x: x.rlike("^[a-c]"))).select("p_partkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def f09_nested_path(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k >= 50")


@query("SELECT e.event_id FROM events e WHERE (e.user_id, e.ts) IN (SELECT user_id, max(ts) FROM events WHERE event_type = 'purchase' GROUP BY user_id) OR e.event_type = 'view'")
def f10_execution_scope(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    latest = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("ts")).withColumn("latest", F.lit(True))
    return e.join(latest, ["user_id", "ts"], "left").where("latest or event_type = 'view'").select("event_id")


@query("SELECT c_custkey, c_acctbal, 'state' AS layer FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT c_custkey, c_acctbal, 'baseline' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9900)")
def f11_overlay(spark, d):
    c = t(spark, d, "customer")
    state = c.where("c_mktsegment = 'MACHINERY'")
    covered = state.where("c_acctbal > 9900").select("c_nationkey").distinct()
    base = c.where("c_mktsegment = 'BUILDING'").join(covered, "c_nationkey", "left_anti")
    pick = lambda x, layer: x.select("c_custkey", "c_acctbal", F.lit(layer).alias("layer"))
    return pick(state, "state").unionByName(pick(base, "baseline"))


@query("SELECT doc_id, contains(lower(text), 'the and') AS has FROM documents")
def f12_substring(spark, d):
    return t(spark, d, "documents").select("doc_id", F.lower("text").contains("the and").alias("has"))


@query("SELECT doc_id FROM documents WHERE contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' license ')")
def f13_name_mention(spark, d):
    from ..functions.text import loose

    return t(spark, d, "documents").where(F.concat(F.lit(" "), loose(F.col("text")), F.lit(" ")).contains(" license ")).select("doc_id")


@query("SELECT doc_id, CASE WHEN n_chars < 20 THEN 'short' WHEN regexp_matches(text, '^[^a-zA-Z]*$') THEN 'no_letters' ELSE 'kept' END AS reason FROM documents")
def f14_noise_filter(spark, d):
    reason = F.when(F.col("n_chars") < 20, "short").when(F.col("text").rlike("^[^a-zA-Z]*$"), "no_letters").otherwise("kept")
    return t(spark, d, "documents").select("doc_id", reason.alias("reason"))


@query("SELECT event_type, count(*) AS n, event_type IN ('click', 'view', 'purchase') AS allowed FROM events GROUP BY event_type")
def f15_allow_list(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("allowed", F.col("event_type").isin("click", "view", "purchase"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
def t01_mixed_sort(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, lower(p_name), p_partkey")
def t03_tie_breaks(spark, d):
    return t(spark, d, "part").orderBy(F.desc("p_retailprice"), F.lower("p_name"), "p_partkey").select("p_partkey", "p_name")


@query("SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM customer GROUP BY c_nationkey")
def t04_unique_sorted(spark, d):
    return t(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS rank FROM events ORDER BY rank, event_id")
def t05_enum_order(spark, d):
    place = F.array_position(F.array(*map(F.lit, ("purchase", "click", "view"))), F.col("event_type")).cast("int")
    return t(spark, d, "events").select("event_id", F.when(place > 0, place).otherwise(4).alias("rank")).orderBy("rank", "event_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS ordered_at FROM orders ORDER BY ordered_at DESC NULLS LAST, o_orderkey")
def t06_missing_dates_last(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("ordered_at")).orderBy(F.desc_nulls_last("ordered_at"), "o_orderkey")


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 25")
def t07_seeded_sample(spark, d):
    return t(spark, d, "documents").select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(25)


@query("SELECT o_orderkey, 'base' AS layer FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'other' FROM orders WHERE o_totalprice > 200000 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def e01_keyed_union(spark, d):
    o = t(spark, d, "orders")
    base = o.where("o_orderstatus = 'F'").select("o_orderkey")
    other = o.where("o_totalprice > 200000").select("o_orderkey").join(base, "o_orderkey", "left_anti")
    return base.withColumn("layer", F.lit("base")).unionByName(other.withColumn("layer", F.lit("other")))


@query("SELECT p_partkey, len(list_distinct(list_concat(string_split(p_name, ' '), string_split(p_type, ' ')))) AS n_union, len(list_distinct(list_intersect(string_split(p_name, ' '), string_split(lower(p_type), ' ')))) AS n_both, len(list_distinct(list_filter(string_split(p_name, ' '), lambda x: NOT list_contains(string_split(p_type, ' '), x)))) AS n_only FROM part")
def e02_e03_e04_array_sets(spark, d):
    a, b = F.split("p_name", " "), F.split("p_type", " ")
    return t(spark, d, "part").select("p_partkey", F.size(F.array_union(a, b)).cast("long").alias("n_union"), F.size(F.array_intersect(a, F.split(F.lower("p_type"), " "))).cast("long").alias("n_both"), F.size(F.array_except(a, b)).cast("long").alias("n_only"))


@query("WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, 4 AS n FROM orders) SELECT count(*) FILTER (WHERE a.n = b.n) AS matches, count(*) FILTER (WHERE a.n IS DISTINCT FROM b.n) AS mismatch_count, min(coalesce(a.k, b.k)) FILTER (WHERE a.n IS DISTINCT FROM b.n) AS first_mismatch FROM a FULL JOIN b ON a.k = b.k")
def e05_reconciliation(spark, d):
    a = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    b = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(4).alias("m"))
    same = F.col("n").eqNullSafe(F.col("m"))
    return a.join(b, "k", "full").agg(F.count_if(same).alias("matches"), F.count_if(~same).alias("mismatch_count"), F.min(F.when(~same, F.col("k"))).alias("first_mismatch"))


@query("SELECT d.doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN md5(d.text) <> md5(o.text) THEN 'changed' ELSE 'same' END AS change FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN quality = 0 THEN text || ' ' ELSE text END AS text FROM documents JOIN labels USING (doc_id)) o ON d.doc_id = o.doc_id")
def e06_change_detection(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.md5("text").alias("now"))
    old = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select("doc_id", F.md5(F.when(F.col("quality") == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))).alias("was"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now") != F.col("was"), "changed").otherwise("same")
    return docs.join(old, "doc_id", "left").select("doc_id", change.alias("change"))


@query("SELECT md5(text) AS evidence_key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def e07_evidence_dedupe(spark, d):
    return t(spark, d, "documents").groupBy(F.md5("text").alias("evidence_key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT array_to_string(list_sort(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ')), ' ') AS bag, min(p_partkey) AS keeper, count(*) AS n FROM part GROUP BY 1")
def e08_word_bag(spark, d):
    from ..functions.text import word_bag

    return t(spark, d, "part").groupBy(word_bag(F.col("p_name")).alias("bag")).agg(F.min("p_partkey").alias("keeper"), F.count("*").alias("n"))
