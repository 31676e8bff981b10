"""Matching texts and names: scores, best units, tiers, suppression, clusters and evidence."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators.leaders import leaders
from ..operators.names import occurrences
from ..operators.vectors import with_previous
from ..registry import query
from ..sources.tables import table as t
from .joins import SIMILAR_NAMES, similar_names

# DuckDB forms of functions.text.plain_words, tokens of names, and token similarity.
PLAIN = "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?m)^[-=]{{3,}}$', '', 'g'), '(?m)^\\s*>+\\s?', '', 'g'), '(?m)^#{{1,6}}\\s+', '', 'g'), '(?m)^\\s*(?:\\d+[.)]\\s+|[-*+]\\s+)', '', 'g'), '[–—]', '-', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[`*_~]', '', 'g'), '[‘’‚‛]', '''', 'g'), '\\s+', ' ', 'g')))"
WORDS = "list_distinct(list_filter(string_split({0}, ' '), lambda w: length(w) > 3))"
SIM = "(CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0 ELSE len(list_intersect({0}, {1})) / greatest(len({0}), len({1})) END)"
TURNS = f"turns AS (SELECT conv_id, turn, {PLAIN.format('text')} AS p FROM conversations)"


def _turns(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", x.plain_words(F.col("text")).alias("p"))


def _names(spark, d):
    return t(spark, d, "part").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))


@query(f"SELECT doc_id, md5(replace(replace({PLAIN.format('text')}, '“', '\"'), '”', '\"')) AS plain FROM documents")
def c03_plain_words(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(x.plain_words(F.col("text"))).alias("plain"))


@query(f"WITH p AS (SELECT l_orderkey, l_linenumber, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS b, string_split(p_brand, ' ') AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT y.l_orderkey, y.l_linenumber, round(0.5 * {SIM.format('x.a', 'y.a')} + 0.3 * {SIM.format('x.b', 'y.b')} + 0.2 * {SIM.format('x.c', 'y.c')}, 6) AS score FROM p x JOIN p y ON x.l_orderkey = y.l_orderkey AND y.r = x.r + 1")
def c09_blended_similarity(spark, d):
    """Each line's part against that of the line before it: half name, three tenths type, a fifth brand."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    parts = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), *[F.split(c, " ").alias(c) for c in ("p_name", "p_type", "p_brand")])
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, "l_partkey")
    now = F.struct("p_name", "p_type", "p_brand")
    pairs = lines.select("l_orderkey", "l_linenumber", now.alias("y"), F.lag(now).over(w).alias("x")).where("x is not null")
    score = sum(share * x.token_similarity(F.col(f"x.{c}"), F.col(f"y.{c}")) for share, c in ((0.5, "p_name"), (0.3, "p_type"), (0.2, "p_brand")))
    return pairs.select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


STRONG = "(p <> '' AND q <> '' AND (contains(p, q) OR contains(q, p) OR (len(a) >= 3 AND len(b) >= 3 AND len(list_intersect(a, b)) >= least(4, len(a), len(b)) AND len(list_intersect(a, b)) / least(len(a), len(b)) >= 0.5)))"


@query(f"WITH {TURNS}, l AS (SELECT conv_id, turn, p, lag(p) OVER (PARTITION BY conv_id ORDER BY turn, p) AS q FROM turns), w AS (SELECT *, {WORDS.format('p')} AS a, {WORDS.format('q')} AS b FROM l WHERE q IS NOT NULL) SELECT conv_id, turn, {STRONG} AS strong FROM w")
def c10_strong_match(spark, d):
    """Whether a turn takes up the one before it."""
    q = F.lag("p").over(Window.partitionBy("conv_id").orderBy("turn", "p"))
    pairs = _turns(spark, d).withColumn("q", q).where("q is not null")
    return pairs.select("conv_id", "turn", x.strong_match(F.col("p"), F.col("q")).alias("strong"))


@query("WITH n AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 3) AS w FROM conversations), l AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn, w) AS v FROM n), f AS (SELECT conv_id, turn, list_distinct(v) AS v, unnest(w) AS c FROM l WHERE v IS NOT NULL), h AS (SELECT conv_id, turn, len(list_filter(v, lambda y: starts_with(c, y) OR starts_with(y, c))) > 0 AS hit FROM f) SELECT conv_id, turn, count(*) FILTER (WHERE hit) AS score FROM h GROUP BY ALL")
def c11_keyword_score(spark, d):
    """How many words of a turn equal, begin or continue one of the turn before it; turns without words have no row."""
    words = F.filter(F.split(x.loose(F.col("text")), " "), lambda w: F.length(w) > 3)
    turns = t(spark, d, "conversations").select("conv_id", "turn", words.alias("w"))
    pairs = turns.withColumn("v", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn", "w"))).where("v is not null and size(w) > 0")
    return pairs.groupBy("conv_id", "turn").agg(F.sum(x.keyword_score(F.col("w"), F.col("v"))).alias("score"))


RECALL = "len(list_intersect(list_distinct(list_filter(string_split(p, ' '), lambda w: w <> '')), list_distinct(list_filter(string_split(q, ' '), lambda w: w <> '')))) / greatest(1, len(list_distinct(list_filter(string_split(q, ' '), lambda w: w <> ''))))"


@query(f"WITH {TURNS}, m AS (SELECT conv_id, max(turn) AS last FROM turns GROUP BY 1), n AS (SELECT t.conv_id, max(p) AS q FROM turns t JOIN m ON t.conv_id = m.conv_id AND turn = last GROUP BY 1), u AS (SELECT t.conv_id, turn, contains(p, q) OR contains(q, p) AS inside, {RECALL} AS recall FROM turns t JOIN m ON t.conv_id = m.conv_id AND turn < last JOIN n ON n.conv_id = t.conv_id), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN inside THEN 0 WHEN recall >= 0.4 THEN 1 ELSE 2 END, CASE WHEN NOT inside AND recall >= 0.4 THEN -recall ELSE 0 END, turn) AS r FROM u) SELECT conv_id, turn, round(recall, 6) AS recall FROM r WHERE r = 1")
def c12_best_unit(spark, d):
    """The earlier turn that the last one of a conversation refers to: the first that holds it or is held by it, else that
    with the most of its words (0.4 at least), else the first."""
    turns = _turns(spark, d)
    last = turns.groupBy("conv_id").agg(F.max(F.struct("turn", "p")).alias("b")).select("conv_id", F.col("b.turn").alias("last"), F.col("b.p").alias("q"))
    u = turns.join(last, "conv_id").where("turn < last")
    p, q = F.col("p"), F.col("q")
    word = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    u = u.select("conv_id", "turn", (p.contains(q) | q.contains(p)).alias("inside"), (x.overlap(word(p), word(q)) / F.greatest(F.lit(1), F.size(word(q)))).alias("recall"))
    near = ~F.col("inside") & (F.col("recall") >= 0.4)
    tier = F.when(F.col("inside"), 0).when(near, 1).otherwise(2)
    best = u.groupBy("conv_id").agg(F.min(F.struct(tier.alias("tier"), F.when(near, -F.col("recall")).otherwise(0.0).alias("s"), "turn", "recall")).alias("b"))
    return best.select("conv_id", "b.turn", F.round("b.recall", 6).alias("recall"))


@query(f"WITH {TURNS}, o AS (SELECT conv_id, max(p) AS q FROM turns t WHERE turn = (SELECT min(turn) FROM turns s WHERE s.conv_id = t.conv_id) GROUP BY 1), w AS (SELECT t.conv_id, turn, p, q, {WORDS.format('p')} AS a, {WORDS.format('q')} AS b, min(turn) OVER (PARTITION BY t.conv_id) AS first FROM turns t JOIN o ON o.conv_id = t.conv_id), m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM w WHERE turn > first AND {STRONG}) SELECT conv_id, turn, r AS place FROM m WHERE r <= 16")
def y20_section_evidence(spark, d):
    """Turns that strongly match the opening one, sixteen at most in order (the cap is the feature)."""
    turns = _turns(spark, d)
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("first"))
    opening = turns.join(first, "conv_id").where("turn = first").groupBy("conv_id", "first").agg(F.max("p").alias("q"))
    hits = turns.join(opening, "conv_id").where("turn > first").where(x.strong_match(F.col("p"), F.col("q")))
    return hits.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("place")).where("place <= 16")


CROSS = "a AS (SELECT lower(p_name) AS name, min(p_partkey) AS id FROM part GROUP BY 1), b AS (SELECT lower(p_brand || ' ' || string_split(p_name, ' ')[1]) AS name, min(p_partkey) AS id FROM part GROUP BY 1)"


@query(f"WITH {CROSS}, s AS (SELECT a.id AS a, b.id AS b, a.name <> b.name AND ((length(a.name) >= 3 AND contains(b.name, a.name)) OR (length(b.name) >= 3 AND contains(a.name, b.name))) AS inside, len(list_intersect(string_split(a.name, ' '), string_split(replace(b.name, '#', ''), ' '))) / greatest(len(string_split(a.name, ' ')), len(string_split(b.name, ' '))) AS sim FROM a CROSS JOIN b) SELECT a, b, CASE WHEN inside THEN 'substring' ELSE 'tokens' END AS reason FROM s WHERE inside OR sim >= 0.5")
def j07_cross_type_links(spark, d):
    """Links, never merges, between names of two types: one holds the other, or their tokens are half alike.  Names meet
    at shared tokens and at shared runs of three characters, without which they can be neither."""
    keyed = lambda df, s: df.select(F.col("id").alias(s), F.col("name").alias(f"name_{s}"), x.tokens(F.col("name")).alias(f"w_{s}")).withColumn("key", F.explode(F.array_union(f"w_{s}", x.char_grams(F.col(f"name_{s}"), 3))))
    b = t(spark, d, "part").groupBy(F.lower(F.concat_ws(" ", "p_brand", F.split("p_name", " ")[0])).alias("name")).agg(F.min("p_partkey").alias("id"))
    met = keyed(_names(spark, d), "a").join(keyed(b, "b"), "key").drop("key").distinct()
    l, r = F.col("name_a"), F.col("name_b")
    inside = (l != r) & (((F.length(l) >= 3) & r.contains(l)) | ((F.length(r) >= 3) & l.contains(r)))
    return met.where(inside | (x.token_similarity(F.col("w_a"), F.col("w_b")) >= 0.5)).select("a", "b", F.when(inside, "substring").otherwise("tokens").alias("reason"))


@query()
def v01_leader_clusters(spark, d):
    """Names of a brand in order: each joins the earliest leader whose tokens are 0.4 alike, compared with leaders alone."""
    p = t(spark, d, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    classes = p.groupBy("p_brand", "name").agg(F.min("id").alias("id"))
    return leaders(classes, similar_names(p, "p_brand", 0.4))


@query("WITH n AS (SELECT lower(p_name) AS name, min(p_partkey) AS id FROM part GROUP BY 1), c AS (SELECT DISTINCT string_split(name, ' ')[2] || ' ' || string_split(name, ' ')[1] AS cand FROM n UNION SELECT name || ' extra' FROM n UNION SELECT name FROM n), e AS (SELECT cand, id, 1.0 AS sim FROM c JOIN n ON name = cand), s AS (SELECT cand, id, len(list_intersect(list_distinct(string_split(cand, ' ')), list_distinct(string_split(name, ' ')))) / greatest(len(list_distinct(string_split(cand, ' '))), len(list_distinct(string_split(name, ' ')))) AS sim FROM c CROSS JOIN n WHERE cand NOT IN (SELECT cand FROM e)), b AS (SELECT cand, min(id) AS id, arg_min(sim, id) AS sim FROM s WHERE sim > 0.7 GROUP BY 1 UNION ALL SELECT * FROM e) SELECT c.cand, b.id AS blocked_by, round(b.sim, 6) AS similarity FROM c LEFT JOIN b ON c.cand = b.cand")
def v02_suppression(spark, d):
    """Candidate names with the first known name that blocks them (equal, or tokens over 0.7 alike); none if it is new."""
    n = _names(spark, d)
    w = F.split("name", " ")
    c = n.select(F.concat_ws(" ", w[1], w[0]).alias("cand")).union(n.select(F.concat("name", F.lit(" extra")))).union(n.select("name")).distinct()
    exact = c.join(n.withColumnRenamed("name", "cand"), "cand").select("cand", "id", F.lit(1.0).alias("sim"))
    known = n.select("id", x.tokens(F.col("name")).alias("v")).withColumn("token", F.explode("v"))
    left = c.join(exact, "cand", "left_anti").select("cand", x.tokens(F.col("cand")).alias("w")).withColumn("token", F.explode("w"))
    near = left.join(known, "token").withColumn("sim", x.token_similarity(F.col("w"), F.col("v"))).where("sim > 0.7")
    near = near.groupBy("cand").agg(F.min(F.struct("id", "sim")).alias("b")).select("cand", "b.id", "b.sim")
    return c.join(exact.union(near), "cand", "left").select("cand", F.col("id").alias("blocked_by"), F.round("sim", 6).alias("similarity"))


@query("WITH n AS (SELECT lower(p_name) AS name, min(p_partkey) AS id FROM part GROUP BY 1), r AS (SELECT upper(name) AS ref FROM n UNION SELECT 'Project: ' || name FROM n UNION SELECT 'Ticket: ' || string_split(name, ' ')[2] || ' ' || string_split(name, ' ')[1] FROM n UNION SELECT 'nothing like ' || name FROM n), k AS (SELECT ref, trim(lower(ref)) AS k, trim(lower(regexp_replace(ref, '(?i)^(Decision:\\s*|Process:\\s*|Project:\\s*|PR\\s*#?\\s*|Ticket:\\s*)', ''))) AS s FROM r), h AS (SELECT ref, id, 1 AS tier, 1.0 AS sim FROM k JOIN n ON name = k UNION ALL SELECT ref, id, 2, 1.0 FROM k JOIN n ON name = s UNION ALL SELECT ref, id, 3, len(list_intersect(list_distinct(string_split(s, ' ')), list_distinct(string_split(name, ' ')))) / greatest(len(list_distinct(string_split(s, ' '))), len(list_distinct(string_split(name, ' ')))) AS sim FROM k CROSS JOIN n), b AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY tier, sim DESC, id) AS r FROM h WHERE sim >= 0.7) SELECT k.ref, id, tier FROM k LEFT JOIN b ON b.ref = k.ref AND r = 1")
def v03_tiered_match(spark, d):
    """Names found as they are (1), without a type prefix (2), or by tokens 0.7 alike (3); null if by none."""
    n = _names(spark, d)
    w = F.split("name", " ")
    r = n.select(F.upper("name").alias("ref")).union(n.select(F.concat(F.lit("Project: "), "name"))).union(n.select(F.concat(F.lit("Ticket: "), w[1], F.lit(" "), w[0]))).union(n.select(F.concat(F.lit("nothing like "), "name"))).distinct()
    k = r.select("ref", F.trim(F.lower("ref")).alias("k"), F.trim(F.lower(x.without_type_prefix(F.col("ref")))).alias("s"))
    hit = lambda c, tier: k.join(n, F.col("name") == F.col(c)).select("ref", "id", F.lit(tier).alias("tier"), F.lit(1.0).alias("sim"))
    known = n.select("id", x.tokens(F.col("name")).alias("v")).withColumn("token", F.explode("v"))
    near = k.select("ref", x.tokens(F.col("s")).alias("w")).withColumn("token", F.explode("w")).join(known, "token")
    near = near.select("ref", "id", F.lit(3).alias("tier"), x.token_similarity(F.col("w"), F.col("v")).alias("sim")).where("sim >= 0.7")
    found = hit("k", 1).union(hit("s", 2)).union(near).groupBy("ref").agg(F.min(F.struct("tier", (-F.col("sim")).alias("s"), "id")).alias("b"))
    return r.join(found, "ref", "left").select("ref", "b.id", "b.tier")


@query(f"WITH {SIMILAR_NAMES}, z AS (SELECT p_brand, min(p_partkey) AS id, list(DISTINCT p_size) AS sizes FROM part GROUP BY p_brand, p_name) SELECT s.a, s.b, round(sim, 6) AS sim FROM s JOIN z x ON x.id = s.a JOIN z y ON y.id = s.b WHERE sim >= 0.4 AND list_has_any(x.sizes, y.sizes)")
def v04_convention_pairs(spark, d):
    """Rules of one owner that are 0.4 alike and share evidence (sizes, of which there are fifty)."""
    p = t(spark, d, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size")
    sizes = p.groupBy("p_brand", "name").agg(F.min("id").alias("id"), F.collect_set("p_size").alias("sizes")).select("id", "sizes")
    pairs = similar_names(p, "p_brand", 0.4).join(sizes.toDF("a", "x"), "a").join(sizes.toDF("b", "y"), "b")
    return pairs.where(F.arrays_overlap("x", "y")).select("a", "b", F.round("sim", 6).alias("sim"))


@query("WITH e AS (SELECT l_orderkey, p_name AS title, max(floor(l_quantity / 5)) AS score, bool_and(l_returnflag = 'N') AS feedback, min(l_partkey) AS id FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), m AS (SELECT *, bool_or(NOT feedback) OVER (PARTITION BY l_orderkey) AS technical FROM e WHERE score >= 7), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, title, id) AS place FROM m WHERE NOT (feedback AND technical)) SELECT l_orderkey, title, CAST(score AS DOUBLE) AS score, place FROM r WHERE place <= 8")
def v16_evidence_selection(spark, d):
    """Evidence of an order, each title once, of score 7 or more; feedback counts only where nothing else does; the best
    eight (the cap is the feature)."""
    parts = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"))
    e = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag").join(parts, "l_partkey")
    e = e.groupBy("l_orderkey", "title").agg(F.max(F.floor(F.col("l_quantity") / 5)).cast("double").alias("score"), F.bool_and(F.col("l_returnflag") == "N").alias("feedback"), F.min("l_partkey").alias("id")).where("score >= 7")
    e = e.withColumn("technical", F.bool_or(~F.col("feedback")).over(Window.partitionBy("l_orderkey"))).where("not (feedback and technical)")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("score"), "title", "id")).cast("long")
    return e.select("l_orderkey", "title", "score", place.alias("place")).where("place <= 8")


@query("WITH n AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS name FROM part) SELECT d.doc_id, string_agg(name, '|' ORDER BY name) AS mentioned, min(name) AS scope FROM documents d JOIN n ON length(name) >= 3 AND contains(lower(d.text), name) GROUP BY 1")
def v17_mention_links(spark, d):
    """Names of three letters or more that a text holds, anywhere in it; the first one is its scope."""
    n = t(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("name")).where(F.length("name") >= 3)
    found = occurrences(t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text")), n)
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("mentioned"), F.min("name").alias("scope"))


@query("WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), b AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 64 AS bucket, count(*) AS n FROM w GROUP BY 1, 2) SELECT doc_id, CAST(bucket AS BIGINT) AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM b")
def y02_hash_embedding(spark, d):
    """A stand-in for an embedding model: words hashed to 64 buckets, counts scaled to length one, in sparse form."""
    w = t(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    bucket = F.pmod(F.conv(F.substring(F.md5("w"), 1, 4), 16, 10).cast("long"), F.lit(64))
    b = w.groupBy("doc_id", bucket.alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    return b.select("doc_id", "bucket", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id"))), 6).alias("weight"))


@query("WITH l AS (SELECT vec_id, embedding AS y, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS x FROM embeddings) SELECT vec_id, round(list_sum(list_transform(list_zip(x, y), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(x, lambda p: CAST(p AS DOUBLE) * CAST(p AS DOUBLE)))) * sqrt(list_sum(list_transform(y, lambda p: CAST(p AS DOUBLE) * CAST(p AS DOUBLE)))) + 1e-10), 6) AS score FROM l WHERE x IS NOT NULL")
def m02_cosine(spark, d):
    """Each vector against the one before it of its label."""
    pairs = with_previous(t(spark, d, "embeddings").select("vec_id", "label", "embedding"), "label", "vec_id", "embedding").where("before is not null")
    return pairs.select("vec_id", F.round(x.cosine(F.col("before"), F.col("embedding")), 6).alias("score"))
