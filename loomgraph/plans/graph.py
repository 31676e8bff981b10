"""Graph queries over order, line and nation edges."""

from pyspark.sql import functions as F

from ..operators.graph import both_ways, connected_components, expand
from ..registry import query
from ..sources.tables import table as t

EDGES = "edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'IN' AS type FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'IN' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'PART' FROM nation)"


def edges(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    e = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"))
    return e(t(spark, d, "customer"), name("c", "c_custkey"), name("n", "c_nationkey"), "IN").union(e(t(spark, d, "supplier"), name("s", "s_suppkey"), name("n", "s_nationkey"), "IN")).union(e(t(spark, d, "nation"), name("n", "n_nationkey"), name("r", "n_regionkey"), "PART"))


@query(f"WITH {EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node")
def j10_incident_edges(spark, d):
    return both_ways(edges(spark, d)).groupBy("node").agg(F.count("*").alias("degree"))


@query(f"WITH {EDGES}, a AS (SELECT src AS node, dst AS other, type FROM edges UNION ALL SELECT dst, src, type FROM edges), h1 AS (SELECT DISTINCT s.node AS seed, other AS node FROM (SELECT 's' || s_suppkey AS node FROM supplier) s JOIN a ON a.node = s.node), h2 AS (SELECT DISTINCT seed, a.other AS node FROM h1 JOIN a ON a.node = h1.node AND a.type = 'PART') SELECT seed, seed AS node, 0 AS hop FROM (SELECT DISTINCT seed FROM h1) UNION ALL SELECT seed, node, 1 FROM h1 UNION ALL SELECT seed, node, 2 FROM h2 WHERE node <> seed AND (seed, node) NOT IN (SELECT seed, node FROM h1)")
def j11_two_hop_expansion(spark, d):
    seeds = t(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"))
    return expand(edges(spark, d), seeds, 2, ["PART"])


@query("SELECT r_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name")
def j12_typed_multi_hop(spark, d):
    orders = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey", "left").groupBy("c_nationkey").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    n = t(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"))
    return n.join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sum("c").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"))


def propagate(edges, hypotheses, weight: float = 0.7):
    """APPLIES_TO edges (src, dst, weight) that hypotheses inherit: what applies to a node that a hypothesis (node) is
    RELATED_TO applies to the hypothesis, unless that edge is there or would be a loop."""
    related = edges.where("type = 'RELATED_TO'").join(hypotheses.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("src").alias("h"), F.col("dst").alias("via")).distinct()
    applies = edges.where("type = 'APPLIES_TO'").select(F.col("src").alias("c"), F.col("dst").alias("via")).distinct()
    new = related.join(applies, "via").where("c <> h").select(F.col("c").alias("src"), F.col("h").alias("dst")).distinct()
    return new.join(edges.where("type = 'APPLIES_TO'").select("src", "dst"), ["src", "dst"], "left_anti").withColumn("weight", F.lit(weight))


LINE_EDGES = (
    "le AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, 'RELATED_TO' AS type FROM lineitem WHERE l_returnflag = 'R' "
    "UNION SELECT 'o' || l_orderkey, 'p' || l_partkey, 'APPLIES_TO' FROM lineitem WHERE l_quantity >= 45 "
    "UNION SELECT 'o' || l_orderkey, 's' || l_suppkey, 'APPLIES_TO' FROM lineitem WHERE l_returnflag = 'N')"
)


def line_edges(spark, d):
    lines = t(spark, d, "lineitem")
    edge = lambda df, a, b, kind: df.select(F.concat(F.lit(a[0]), F.col(a[1])).alias("src"), F.concat(F.lit(b[0]), F.col(b[1])).alias("dst"), F.lit(kind).alias("type"))
    s, p, o = ("s", "l_suppkey"), ("p", "l_partkey"), ("o", "l_orderkey")
    return edge(lines.where("l_returnflag = 'R'"), s, p, "RELATED_TO").union(edge(lines.where("l_quantity >= 45"), o, p, "APPLIES_TO")).union(edge(lines.where("l_returnflag = 'N'"), o, s, "APPLIES_TO")).distinct()


@query(
    f"WITH {LINE_EDGES} SELECT DISTINCT a.src, r.src AS dst, 0.7 AS weight FROM le r JOIN le a ON a.dst = r.dst AND a.type = 'APPLIES_TO' "
    "WHERE r.type = 'RELATED_TO' AND a.src <> r.src AND NOT EXISTS (SELECT 1 FROM le x WHERE x.type = 'APPLIES_TO' AND x.src = a.src AND x.dst = r.src)"
)
def j14_label_propagation(spark, d):
    e = line_edges(spark, d)
    return propagate(e, e.where("type = 'RELATED_TO'").select(F.col("src").alias("node")).distinct())


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem), "
    "s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), "
    "reach(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM s UNION "
    "(SELECT s.b, min(r.component) FROM reach r JOIN s ON s.a = r.node JOIN recurring.reach c ON c.node = s.b "
    "GROUP BY s.b, c.component HAVING min(r.component) < c.component)) SELECT node, component FROM reach"
)
def j15_connected_components(spark, d):
    e = t(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), F.lit("LINE").alias("type"))
    return connected_components(e)


@query("SELECT l_orderkey, l_partkey, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'RESOLVES' WHEN l_returnflag = 'A' THEN 'USES' ELSE 'RELATED_TO' END AS type FROM lineitem")
def v05_edge_type_upgrade(spark, d):
    rules = spark.createDataFrame([("R", "F", "RESOLVES"), ("A", "F", "USES"), ("A", "O", "USES")], "l_returnflag string, l_linestatus string, type string")
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    return lines.join(F.broadcast(rules), ["l_returnflag", "l_linestatus"], "left").select("l_orderkey", "l_partkey", F.coalesce("type", F.lit("RELATED_TO")).alias("type"))  # three rules


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def v07_induced_subgraph(spark, d):
    nodes = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey").join(nodes, "o_custkey", "left_semi")


@query("SELECT p_partkey, string_agg(DISTINCT s_name, '|' ORDER BY s_name) AS owners FROM (SELECT l_partkey AS p_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 49) e JOIN supplier ON s_suppkey = l_suppkey GROUP BY p_partkey")
def y21_ownership_map(spark, d):
    e = t(spark, d, "lineitem").where("l_returnflag = 'R' or l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    named = e.join(t(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return named.groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set("s_name")), "|").alias("owners"))
