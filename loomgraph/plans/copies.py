"""Arrays updated where an element fits, lists held to one another by place, references told apart by all they say, and states cloned."""

from functools import reduce

from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table as t


def update_elements(c, fits, change):
    """An array with the elements that fit changed; null stays null."""
    return F.transform(c, lambda e: F.when(fits(e), change(e)).otherwise(e))


@query(
    "WITH a AS (SELECT l_orderkey AS id, list({'line': l_linenumber, 'flag': l_returnflag, 'quantity': l_quantity} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS items FROM lineitem GROUP BY 1) "
    "SELECT id, CAST(list_sum(list_transform(items, lambda e: CASE WHEN e.flag = 'R' AND e.quantity > 10 THEN 1 ELSE 0 END)) AS BIGINT) AS changed, "
    "array_to_string(list_transform(items, lambda e: e.line || ':' || CASE WHEN e.flag = 'R' AND e.quantity > 10 THEN 'returned' ELSE e.flag END), '|') AS items FROM a"
)
def u05_update_elements(spark, d):
    """Items of orders, an array each; those that came back in numbers over ten get another flag."""
    e = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    a = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(e)).alias("items"))
    fits = lambda x: (x.flag == "R") & (x.quantity > 10)
    new = update_elements(F.col("items"), fits, lambda x: x.withField("flag", F.lit("returned")))
    shown = F.array_join(F.transform(new, lambda x: F.concat_ws(":", x.line.cast("string"), x.flag)), "|")
    return a.select("id", F.size(F.filter("items", fits)).cast("long").alias("changed"), shown.alias("items"))


def reconciled(expected, actual):
    """(key, matches, changed, missing, extra, first) of two lists of blocks (key, place, block) for each key: blocks that are the same
    at one place, others, and those that only one list has; first is the least place that differs.  Null blocks are alike."""
    both = expected.select("key", "place", F.struct("block").alias("x")).join(actual.select("key", "place", F.struct("block").alias("y")), ["key", "place"], "full")
    same, lost, new = F.col("x.block").eqNullSafe(F.col("y.block")) & F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("y").isNull(), F.col("x").isNull()
    return both.groupBy("key").agg(F.count_if(same).alias("matches"), F.count_if(~same & ~lost & ~new).alias("changed"), F.count_if(lost).alias("missing"), F.count_if(new).alias("extra"), F.min(F.when(~same, F.col("place"))).alias("first"))


@query(
    "WITH a AS (SELECT conv_id AS k, turn AS place, text FROM conversations), b AS (SELECT conv_id AS k, CASE WHEN turn % 11 = 0 THEN turn + 1000 ELSE turn END AS place, CASE WHEN turn % 5 = 0 THEN upper(text) ELSE text END AS text FROM conversations WHERE turn % 7 <> 0), "
    "j AS (SELECT coalesce(a.k, b.k) AS key, coalesce(a.place, b.place) AS place, a.k IS NULL AS new, b.k IS NULL AS lost, a.k IS NOT NULL AND b.k IS NOT NULL AND a.text IS NOT DISTINCT FROM b.text AS same FROM a FULL JOIN b ON a.k = b.k AND a.place = b.place) "
    "SELECT key, count(*) FILTER (WHERE same) AS matches, count(*) FILTER (WHERE NOT same AND NOT lost AND NOT new) AS changed, count(*) FILTER (WHERE lost) AS missing, count(*) FILTER (WHERE new) AS extra, min(place) FILTER (WHERE NOT same) AS first FROM j GROUP BY key"
)
def e05_block_lists(spark, d):
    """Turns of conversations against a copy in which some are gone, moved or written otherwise."""
    n = F.col("turn")
    c = t(spark, d, "conversations").select(F.col("conv_id").alias("key"), "turn", "text")
    copy = c.where(n % 7 != 0).select("key", F.when(n % 11 == 0, n + 1000).otherwise(n).alias("place"), F.when(n % 5 == 0, F.upper("text")).otherwise(F.col("text")).alias("block"))
    return reconciled(c.select("key", n.alias("place"), F.col("text").alias("block")), copy)


#: Members by which references are told apart, in this order (fixed values).
REFERENCE = ["source_type", "doc_id", "title", "section", "excerpt"]


def distinct_references(refs):
    """The first (by at) of each owner's references (owner, at, REFERENCE) that say the same in all members, and how many do; nulls are as empty."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in REFERENCE]
    return refs.select("owner", "at", *plain).groupBy("owner", *REFERENCE).agg(F.min("at").alias("at"), F.count("*").alias("copies"))


@query(
    "SELECT l_suppkey AS owner, CASE l_linenumber % 3 WHEN 0 THEN 'jira' WHEN 1 THEN 'slack' ELSE '' END AS source_type, CAST(l_partkey % 50 AS VARCHAR) AS doc_id, l_returnflag AS title, CASE WHEN l_quantity < 25 THEN '' ELSE 'notes' END AS section, l_linestatus AS excerpt, "
    "min(l_orderkey * 10 + l_linenumber) AS at, count(*) AS copies FROM lineitem GROUP BY ALL"
)
def e07_references(spark, d):
    """Order lines as references of their supplier."""
    n = F.col("l_linenumber") % 3
    refs = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.when(n == 0, "jira").when(n == 1, "slack").alias("source_type"), (F.col("l_partkey") % 50).alias("doc_id"), F.col("l_returnflag").alias("title"), F.when(F.col("l_quantity") >= 25, "notes").alias("section"), F.col("l_linestatus").alias("excerpt"))
    return distinct_references(refs)


def cloned(collections, state: str):
    """(collection, id, base_id, state_id, value) of collections (name -> DataFrame of id and value): each row as one of the state, with an id of
    its own that tells where it is from, and nothing else of the original but its value."""
    rows = [df.select(F.lit(name).alias("collection"), F.col("id").cast("string").alias("base_id"), F.col("value").cast("string").alias("value")) for name, df in collections.items()]
    every = reduce(lambda a, b: a.union(b), rows)
    return every.select("collection", F.md5(F.concat_ws("/", F.lit(state), "collection", "base_id")).alias("id"), "base_id", F.lit(state).alias("state_id"), "value")


CLONED = {"nodes": ("part", "p_partkey", "p_name"), "edges": ("lineitem", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)", "l_returnflag"), "pages": ("pages", "page_id", "url"), "claims": ("orders", "o_orderkey", "o_orderpriority"), "cards": ("customer", "c_custkey", "c_name"), "people": ("supplier", "s_suppkey", "s_name")}


@query(
    "SELECT collection, md5('demo/' || collection || '/' || base_id) AS id, base_id, 'demo' AS state_id, value FROM ("
    + " UNION ALL ".join(f"SELECT '{name}' AS collection, CAST({key} AS VARCHAR) AS base_id, {value} AS value FROM {table}" for name, (table, key, value) in CLONED.items())
    + ")"
)
def s15_clone_state(spark, d):
    return cloned({name: t(spark, d, table).select(F.expr(key).alias("id"), F.expr(value).alias("value")) for name, (table, key, value) in CLONED.items()}, "demo")
