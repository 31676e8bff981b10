"""Sinks and mutations as the rows they leave; writers are in loomgraph.plans.sinks."""

from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table as t


@query("SELECT coalesce(n.k, o.o_orderkey) AS k, CASE WHEN n.k IS NULL THEN o.o_orderstatus ELSE 'P' END AS status, CASE WHEN o.o_orderkey IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'kept' ELSE 'updated' END AS action FROM orders o FULL JOIN (SELECT CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE -o_orderkey END AS k FROM orders WHERE o_orderpriority LIKE '1%') n ON n.k = o.o_orderkey")
def u02_upsert(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    n = t(spark, d, "orders").where("o_orderpriority like '1%'").select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).otherwise(-F.col("o_orderkey")).alias("k"), F.lit(True).alias("new"))
    action = F.when(F.col("o_orderstatus").isNull(), "inserted").when(F.col("new").isNull(), "kept").otherwise("updated")
    return o.join(n, "k", "full").select("k", F.when(F.col("new").isNull(), F.col("o_orderstatus")).otherwise("P").alias("status"), action.alias("action"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def u03_set_where(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, "big").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x, i: CASE WHEN i = 2 THEN 'edited' ELSE x END), ' ') AS name FROM part")
def u04_set_by_index(spark, d):
    return t(spark, d, "part").select("p_partkey", F.array_join(F.transform(F.split("p_name", " "), lambda x, i: F.when(i == 1, "edited").otherwise(x)), " ").alias("name"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda x: CASE WHEN x = 'the' THEN 'THE' ELSE x END), ' ') = regexp_replace(text, '$', '') AS unchanged FROM documents")
def u05_array_filter_update(spark, d):
    new = F.array_join(F.transform(F.split("text", " "), lambda x: F.when(x == "the", "THE").otherwise(x)), " ")
    return t(spark, d, "documents").select("doc_id", (new == F.col("text")).alias("unchanged"))


@query("SELECT doc_id, CASE WHEN list_position(w, 'the') > 0 THEN array_to_string(list_transform(w, lambda x, i: CASE WHEN i = list_position(w, 'the') THEN 'THE' ELSE x END), ' ') ELSE array_to_string(w, ' ') END AS text FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def u06_positional_update(spark, d):
    w = t(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    first = F.array_position("w", F.lit("the")).cast("int")
    # The words around the first one as slices: a lambda over words would look for it again at each.
    new = F.concat(F.slice("w", F.lit(1), F.greatest(first - 1, F.lit(0))), F.array(F.lit("THE")), F.slice("w", first + 1, F.size("w")))
    return w.select("doc_id", F.array_join(F.when(first > 0, new).otherwise(F.col("w")), " ").alias("text"))


@query("SELECT c_custkey, array_to_string([c_mktsegment, 'x'], ',') AS pushed, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' ELSE c_mktsegment || ',BUILDING' END AS added FROM customer")
def u07_push_add_to_set(spark, d):
    one = F.array("c_mktsegment")
    return t(spark, d, "customer").select("c_custkey", F.array_join(F.concat(one, F.array(F.lit("x"))), ",").alias("pushed"), F.array_join(F.array_union(one, F.array(F.lit("BUILDING"))), ",").alias("added"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def u08_unset(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("o_orderpriority"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
def u09_delete_cascade(spark, d):
    gone = t(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return t(spark, d, "orders").select("o_orderkey").join(gone, "o_orderkey", "left_anti")


@query("WITH p AS (SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT u.user_id, coalesce(round(p.value, 4), -1) AS value FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN p ON u.user_id = p.user_id")
def u10_bulk_write(spark, d):
    e = t(spark, d, "events")
    patch = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))
    return e.select("user_id").distinct().join(patch, "user_id", "left").select("user_id", F.coalesce(F.round("value", 4), F.lit(-1.0)).alias("value"))


@query("SELECT user_id, max(version) AS active_version, count(*) AS versions FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events WHERE event_type = 'click') GROUP BY user_id")
def u14_config_versions(spark, d):
    from pyspark.sql import Window

    v = t(spark, d, "events").where("event_type = 'click'").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("version"))
    return v.groupBy("user_id").agg(F.max("version").cast("long").alias("active_version"), F.count("*").alias("versions"))


@query("SELECT DISTINCT lower(trim(c_name)) || '@x.example' AS email FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def u15_insert_if_absent(spark, d):
    email = F.concat(F.lower(F.trim("c_name")), F.lit("@x.example")).alias("email")
    c = t(spark, d, "customer")
    return c.where("c_mktsegment = 'BUILDING'").select(email).distinct().join(c.where("c_acctbal < 0").select(email), "email", "left_anti")
