"""Joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import loose, token_similarity, tokens
from ..operators.graph import written
from ..operators.vectors import at_least, compare, nearest
from ..registry import query
from ..sources.tables import table as t


@query("SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN (SELECT c_nationkey, arg_max(c_name, c_custkey) AS c_name FROM customer GROUP BY c_nationkey) c ON o.o_custkey % 25 = c.c_nationkey")
def j01_last_wins_join(spark, d):
    last = t(spark, d, "customer").groupBy("c_nationkey").agg(F.max_by("c_name", "c_custkey").alias("c_name"))
    return t(spark, d, "orders").join(last, F.col("o_custkey") % 25 == F.col("c_nationkey"), "left").select("o_orderkey", "c_name")


@query("WITH a AS (SELECT p_partkey, lower(p_name) AS k FROM part UNION ALL SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) FROM part), f AS (SELECT k, min(p_partkey) AS p_partkey FROM a GROUP BY k) SELECT q.k, f.p_partkey FROM (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS k FROM part) q LEFT JOIN f ON q.k = f.k")
def j02_alias_join(spark, d):
    p = t(spark, d, "part")
    names = p.select("p_partkey", F.lower("p_name").alias("k")).union(p.select("p_partkey", F.explode(F.split(F.lower("p_name"), " "))))
    first = names.groupBy("k").agg(F.min("p_partkey").alias("p_partkey"))
    return p.select(F.explode(F.split(F.lower("p_type"), " ")).alias("k")).distinct().join(first, "k", "left")


@query("WITH refs AS (SELECT o_orderkey AS r, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS k, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS nm FROM orders), hits AS (SELECT r, c_custkey, 1 AS tier FROM refs JOIN customer ON k = c_custkey UNION ALL SELECT r, c_custkey, 2 FROM refs JOIN customer ON nm = c_name) SELECT r, arg_min(c_custkey, tier * 1000000000 + c_custkey) AS c_custkey, min(tier) AS tier FROM hits GROUP BY r")
def j04_or_join(spark, d):
    r = t(spark, d, "orders").select(F.col("o_orderkey").alias("r"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("k"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("nm"))
    c = t(spark, d, "customer").select("c_custkey", "c_name")
    hits = r.join(c, F.col("k") == F.col("c_custkey")).select("r", "c_custkey", F.lit(1).alias("tier")).union(r.join(c, F.col("nm") == F.col("c_name")).select("r", "c_custkey", F.lit(2)))
    return hits.groupBy("r").agg(F.min(F.struct("tier", "c_custkey")).alias("b")).select("r", "b.c_custkey", "b.tier")


@query("WITH c AS (SELECT p_brand, p_size, p_name, min(p_partkey) AS id, count(*) AS n FROM part GROUP BY ALL), w AS (SELECT *, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM c) SELECT a.id AS a, b.id AS b, a.n AS n_a, b.n AS n_b, count(*) AS shared FROM w a JOIN w b ON a.w = b.w AND a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.id < b.id GROUP BY 1, 2, 3, 4")
def j06_shared_evidence_join(spark, d):
    """Pairs between the first parts of each name (a, b), with how many parts (n_a, n_b) they stand for."""
    c = t(spark, d, "part").groupBy("p_brand", "p_size", "p_name").agg(F.min("p_partkey").alias("id"), F.count("*").alias("n"))
    w = c.select("id", "n", "p_brand", "p_size", F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
    a, b = w.withColumnsRenamed({"id": "a", "n": "n_a"}), w.withColumnsRenamed({"id": "b", "n": "n_b"})
    return a.join(b, ["w", "p_brand", "p_size"]).where("a < b").groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j08_semi_join(spark, d):
    lines = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j09_anti_join(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left_anti")


def layered(keys, layers: list, key: str, order: list[str]):
    """For each key the first row, in order, of the first of layers (name, rows) that has one; null where none has."""
    found = None
    for place, (name, rows) in enumerate(layers):
        one = rows.withColumn("place", F.lit(place)).withColumn("layer", F.lit(name))
        found = one if found is None else found.unionByName(one)
    columns = [c for c in found.columns if c not in (key, "place")]
    first = found.groupBy(key).agg(F.min(F.struct("place", *order, *[c for c in columns if c not in order])).alias("b"))
    return keys.join(first, key, "left").select(key, *[F.col(f"b.{c}").alias(c) for c in columns])


@query(
    "WITH l AS (SELECT o_orderkey, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS place, l_linenumber, l_partkey "
    "FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND (l_returnflag = 'R' OR l_returnflag = 'A' OR l_quantity < 10)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY place, l_linenumber, l_partkey) AS r FROM l) "
    "SELECT o_orderkey, l_partkey, CASE WHEN l_partkey IS NULL THEN NULL WHEN place = 0 THEN 'state' WHEN place = 1 THEN 'baseline' ELSE 'any' END AS layer FROM r WHERE r = 1"
)
def j20_layered_fallback(spark, d):
    """A state's rows, else the baseline's, else any."""
    lines = t(spark, d, "lineitem")
    rows = lambda where: lines.where(where).select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    layers = [("state", rows("l_returnflag = 'R'")), ("baseline", rows("l_returnflag = 'A'")), ("any", rows("l_quantity < 10 AND l_returnflag = 'N'"))]
    return layered(t(spark, d, "orders").select("o_orderkey"), layers, "o_orderkey", ["l_linenumber", "l_partkey"]).select("o_orderkey", "l_partkey", "layer")


#: Least share of an item's words in its best match.
LEAST = 0.62


@query("WITH c AS (SELECT unnest(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]{4,}'))) AS w, b.item_id FROM benchmark b), n AS (SELECT item_id, count(*) AS n FROM c GROUP BY 1), dw AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}'))) AS w FROM documents), s AS (SELECT item_id, doc_id, count(*) AS hit FROM c JOIN dw USING (w) GROUP BY ALL), r AS (SELECT s.item_id, doc_id, round(hit / n, 6) AS score, row_number() OVER (PARTITION BY s.item_id ORDER BY hit DESC, doc_id) AS r FROM s JOIN n ON s.item_id = n.item_id) SELECT item_id, doc_id, score FROM r WHERE r = 1 AND score >= 0.62")
def j17_best_match_join(spark, d):
    """An item of n words has a best match of at least LEAST only if the match has one of the item's rarest
    n - ceil(LEAST n) + 1 words.  Items meet documents at these alone; hits are then counted from the words that
    documents share with any item, which are all that is kept of them: texts are read and split once."""
    word = lambda df, i: df.select(i, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{4,}"), F.lit(0)))).alias("w"))
    items = written(word(t(spark, d, "benchmark"), "item_id").distinct())
    held = written(word(t(spark, d, "documents"), "doc_id").join(items.select("w").distinct(), "w", "left_semi"))
    often = held.groupBy("w").agg(F.count("*").alias("c"))
    rare = items.join(often, "w", "left").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "w"))).alias("by"))
    n = F.size("by")
    rare = rare.select("item_id", n.alias("n"), F.explode(F.slice("by", 1, F.greatest(F.lit(1), (n - F.ceil(n * LEAST) + 1).cast("int")))).alias("k"))
    met = held.join(rare.select("item_id", "n", F.col("k.w").alias("w")), "w").select("item_id", "n", "doc_id").distinct()
    hits = met.join(items, "item_id").join(held, ["doc_id", "w"]).groupBy("item_id", "n", "doc_id").agg(F.count("*").alias("hit"))
    best = hits.groupBy("item_id", "n").agg(F.max(F.struct("hit", (-F.col("doc_id")).alias("d"))).alias("b"))
    return best.select("item_id", (-F.col("b.d")).alias("doc_id"), F.round(F.col("b.hit") / F.col("n"), 6).alias("score")).where(F.col("score") >= LEAST)


DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"
NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
COS = f"{DOT} / ({NORM.format('a')} * {NORM.format('b')} + 1e-10)"


def _vectors(spark, d):
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group"), F.col("embedding").alias("vector"))


def nearest_of_label(spark, d, k: int = 10):
    """(query_id, vec_id, rank, score): the k nearest of each query (ids divisible by 50) in its label.  Each pair of
    blocks hands on its own k best; these are ranked."""
    v = _vectors(spark, d)
    found = compare(v.where("id % 50 = 0"), v, nearest(k)).select(F.col("a").alias("query_id"), F.col("b").alias("vec_id"), "score")
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", r).where(F.col("rank") <= k)


@query(f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {COS} AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) SELECT query_id, vec_id, round(score, 6) AS score FROM r WHERE r <= 10")
def j18_vector_knn(spark, d):
    return nearest_of_label(spark, d).select("query_id", "vec_id", F.round("score", 6).alias("score"))


#: A vector's entities: its label, or none at all.
GATE = "(a.vec_id % 10 = 3 OR b.vec_id % 10 = 3 OR a.label = b.label)"


def gated_pairs(spark, d, least: float):
    """Pairs (a < b, score) of a cosine of `least` or more whose entities overlap, or one of which has none."""
    v = _vectors(spark, d).withColumn("group", F.when(F.col("id") % 10 == 3, "none").otherwise(F.col("group").cast("string")))
    return compare(v, v, at_least(least), everywhere="none")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND {GATE} WHERE {COS} >= 0.4")
def j19_gated_vector_pairs(spark, d):
    return gated_pairs(spark, d, 0.4).select("a", "b", F.round("score", 6).alias("score"))


@query("SELECT o_orderkey, string_agg(coalesce(p_name, ''), '|' ORDER BY l_linenumber, coalesce(p_name, '')) AS names FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey")
def j22_ordered_enrich(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    named = lines.join(t(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "left")
    named = named.join(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", F.coalesce("p_name", F.lit("")).alias("n"))))
    return named.groupBy("o_orderkey").agg(F.array_join(listed["n"], "|").alias("names"))


def similar_names(named, block: str, least: float):
    """Pairs (block, a, b, n_a, n_b, sim) of the different names in `named` (block, id, name) that share a token within
    a block and have a token similarity of `least` or more.  A name is known by its least id; n counts its rows."""
    c = named.groupBy(block, "name").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("w", F.array_sort(tokens(F.col("name"))))
    if least > 0.5:  # Rare tokens first; a lower likeness leaves out few tokens, whatever their order.
        each = c.select(block, "id", "n", F.explode("w").alias("token"))
        each = each.join(each.groupBy(block, "token").agg(F.count("*").alias("often")), [block, "token"])
        c = each.groupBy(block, "id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("w")).withColumn("w", F.col("w.token"))
    # Names that share `least` of the larger set share one of the first tokens of each, those after which too few would be left.
    heads = F.slice("w", F.lit(1), (F.size("w") - F.ceil(least * F.size("w") - 1e-9) + 1).cast("int"))
    one = lambda s: c.select(block, F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("w").alias(f"w_{s}"), F.explode(heads).alias("token"))
    # A pair meets at each token that both begin with; it counts at the first that it shares.
    met = one("a").join(one("b"), [block, "token"]).where("a < b").where(F.col("token") == F.get(F.array_intersect("w_a", "w_b"), F.lit(0)))
    return met.withColumn("sim", token_similarity(F.col("w_a"), F.col("w_b"))).where(F.col("sim") >= least).select(block, "a", "b", "n_a", "n_b", "sim")


SIMILAR_NAMES = "n AS (SELECT p_brand, p_name, min(p_partkey) AS id, count(*) AS n, list_distinct(list_filter(string_split(p_name, ' '), lambda x: length(x) > 1)) AS w FROM part GROUP BY p_brand, p_name), s AS (SELECT a.p_brand, a.id AS a, b.id AS b, a.n AS n_a, b.n AS n_b, len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) AS sim FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.id < b.id)"


@query(f"WITH {SIMILAR_NAMES} SELECT a, b, n_a, n_b, round(sim, 6) AS sim FROM s WHERE sim >= 0.2")
def j05_blocked_similarity_pairs(spark, d):
    p = t(spark, d, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return similar_names(p, "p_brand", 0.2).select("a", "b", "n_a", "n_b", F.round("sim", 6).alias("sim"))


#: Edge type, types of its source and target, and whether it may be turned round.
EDGE_RULES = [
    ("WORKS_ON", ["person"], ["person", "work", "project"], True),
    ("REVIEWS", ["person"], ["work"], True),
    ("PART_OF", ["work"], ["project"], False),
]
KINDS = ["person", "work", "project"]


def judged_edges(edges, rules=EDGE_RULES):
    """edges (source, target: types; type) with `verdict`: valid, flip or drop.  Of WORKS_ON both ends can't be persons;
    a type without a rule is dropped.  The rules are joined as they are and turned round."""
    spark = edges.sparkSession
    flat = [(kind, a, b, turn) for kind, sources, targets, turn in rules for a in sources for b in targets]
    table = spark.createDataFrame(flat, "type string, x string, y string, turn boolean")
    forward = table.selectExpr("type", "x AS source", "y AS target", "true AS fits")
    backward = table.where("turn").selectExpr("type", "y AS source", "x AS target", "true AS turned")
    own = (F.col("type") == "WORKS_ON") & (F.col("source") == "person") & (F.col("target") == "person")
    verdict = F.when(own, "drop").when(F.col("fits"), "valid").when(F.col("turned"), "flip").otherwise("drop")
    key = ["type", "source", "target"]
    return edges.join(F.broadcast(forward), key, "left").join(F.broadcast(backward), key, "left").withColumn("verdict", verdict).drop("fits", "turned")  # a rule's few types


@query(
    "WITH e AS (SELECT CASE l_returnflag WHEN 'R' THEN 'REVIEWS' WHEN 'A' THEN 'WORKS_ON' ELSE CASE WHEN l_linestatus = 'O' THEN 'PART_OF' ELSE 'LIKES' END END AS type, "
    "['person', 'work', 'project'][1 + l_suppkey % 3] AS source, ['person', 'work', 'project'][1 + l_partkey % 3] AS target FROM lineitem), "
    "v AS (SELECT type, source, target, CASE "
    "WHEN type = 'WORKS_ON' THEN CASE WHEN source = 'person' AND target = 'person' THEN 'drop' WHEN source = 'person' THEN 'valid' WHEN target = 'person' THEN 'flip' ELSE 'drop' END "
    "WHEN type = 'REVIEWS' THEN CASE WHEN source = 'person' AND target = 'work' THEN 'valid' WHEN source = 'work' AND target = 'person' THEN 'flip' ELSE 'drop' END "
    "WHEN type = 'PART_OF' AND source = 'work' AND target = 'project' THEN 'valid' ELSE 'drop' END AS verdict FROM e) "
    "SELECT type, source, target, verdict, count(*) AS n FROM v GROUP BY ALL"
)
def j23_edge_type_constraint(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "REVIEWS").when(F.col("l_returnflag") == "A", "WORKS_ON").when(F.col("l_linestatus") == "O", "PART_OF").otherwise("LIKES")
    of = lambda c: F.element_at(F.array(*map(F.lit, KINDS)), (F.col(c) % 3 + 1).cast("int"))
    e = t(spark, d, "lineitem").select(kind.alias("type"), of("l_suppkey").alias("source"), of("l_partkey").alias("target"))
    return judged_edges(e).groupBy("type", "source", "target", "verdict").agg(F.count("*").alias("n"))


def resolve_names(refs, names, least: float = 0.5):
    """Of refs (ref), the name (id, name) found first: equal in loose form, else the best token similarity
    over `least` among names that share a token.  Ties by id."""
    r = refs.select("ref", loose(F.col("ref")).alias("k"), tokens(F.col("ref")).alias("w")).distinct()
    n = names.groupBy(loose(F.col("name")).alias("k"), tokens(F.col("name")).alias("v")).agg(F.min("id").alias("id"))
    exact = r.join(n.groupBy("k").agg(F.min("id").alias("id")), "k").select("ref", "id", F.lit(1.0).alias("score"), F.lit(1).alias("tier"))
    left = r.join(exact.select("ref"), "ref", "left_anti").select("ref", "w", F.explode("w").alias("x"))
    pairs = left.join(n.select("id", "v", F.explode("v").alias("x")), "x").dropDuplicates(["ref", "id"])
    near = pairs.withColumn("score", token_similarity(F.col("w"), F.col("v"))).where(F.col("score") > least)
    best = near.groupBy("ref").agg(F.max(F.struct("score", (-F.col("id")).alias("m"))).alias("b"))
    return exact.union(best.select("ref", (-F.col("b.m")).alias("id"), "b.score", F.lit(2)))


@query("WITH r AS (SELECT upper(p_name) AS ref FROM part UNION SELECT p_name || ' extra' FROM part), n AS (SELECT lower(p_name) AS k, min(p_partkey) AS id FROM part GROUP BY 1), e AS (SELECT ref, id, 1.0 AS score, 1 AS tier FROM r JOIN n ON k = lower(ref)), s AS (SELECT ref, id, len(list_intersect(string_split(lower(ref), ' '), string_split(k, ' '))) / greatest(len(string_split(ref, ' ')), len(string_split(k, ' '))) AS score FROM r CROSS JOIN n WHERE ref NOT IN (SELECT ref FROM e)), b AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score DESC, id) AS r FROM s WHERE score > 0.5) SELECT ref, id, round(score, 6) AS score, tier FROM e UNION ALL SELECT ref, id, round(score, 6), 2 FROM b WHERE r = 1")
def j03_cascading_resolve(spark, d):
    p = t(spark, d, "part")
    refs = p.select(F.upper("p_name").alias("ref")).union(p.select(F.concat("p_name", F.lit(" extra"))))
    found = resolve_names(refs, p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    return found.select("ref", "id", F.round("score", 6).alias("score"), "tier")
