"""Composed steps: page plans, ticket sync, verify cards, fact groups and retrieval packs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import loose, truncate
from ..operators.graph import connected_components, written
from ..registry import query
from ..sources.tables import table as t
from .joins import COS, GATE, gated_pairs, nearest_of_label

# ---------------------------------------------------------------- page plans and tickets

#: Types of nodes that have a page, categories of proposed tickets, and the states of a ticket (fixed values).
PAGE_TYPES = ["project", "team_member", "decision", "process", "repository"]
PROPOSED = ["proposed_ticket", "proposed_from_feedback"]
STATES = [
    ("done", r"\b(done|closed|resolved|complete|completed)\b"),
    ("review", r"\b(review|qa|verify|testing)\b"),
    ("in_progress", r"\b(in progress|in_progress|active|doing|wip)\b"),
]
TICKET_KEY = r"\b[A-Z][A-Z0-9]+-\d+\b"

#: The parts as nodes of a graph.
NODES = """nodes AS (
  SELECT p_partkey AS node_id, type, CASE WHEN type = 'ticket' AND p_partkey % 3 = 0 THEN 'PAY-' || (p_partkey % 50) || ' ' ELSE '' END || p_name AS name,
         p_size % 9 AS refs, p_partkey % 5 = 0 AS guess,
         CASE p_partkey % 11 WHEN 1 THEN 'proposed_ticket' WHEN 2 THEN 'proposed_from_feedback' WHEN 3 THEN 'proposed_project' WHEN 4 THEN 'past_undocumented' END AS category,
         CASE p_size % 6 WHEN 0 THEN 'Done' WHEN 1 THEN 'proposed' WHEN 2 THEN 'In Progress' WHEN 3 THEN 'In Review' WHEN 4 THEN 'Backlog' END AS status,
         CASE p_size % 4 WHEN 0 THEN 'documented' WHEN 1 THEN 'undocumented' END AS level,
         type = 'decision' AND p_partkey % 3 = 0 AS convention, p_partkey % 2 = 0 AS direct,
         CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
  FROM (SELECT *, {} AS type FROM part))"""
KINDS = "CASE p_partkey % 8 WHEN 0 THEN 'project' WHEN 1 THEN 'team_member' WHEN 2 THEN 'decision' WHEN 3 THEN 'process' WHEN 4 THEN 'repository' WHEN 5 THEN 'ticket' WHEN 6 THEN 'customer_feedback' ELSE 'pull_request' END"
NODES = NODES.format(KINDS)

BEST_NODES = """scored AS (
  SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS plain,
         least(refs, 5) + CASE WHEN guess THEN -3 ELSE 2 END + CASE WHEN category IS NULL THEN 0 WHEN guess THEN 2 ELSE 6 END
         + CASE WHEN status IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN level IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN convention THEN 3 ELSE 0 END
         + CASE WHEN direct THEN 2 ELSE 0 END + CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS score FROM nodes),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type, plain ORDER BY score DESC, refs DESC, node_id) AS r FROM scored) WHERE r = 1),
marked AS (SELECT *, type IN ('ticket', 'customer_feedback', 'project') AND category IN ('proposed_ticket', 'proposed_from_feedback') IS TRUE AS proposed FROM best)"""


def part_nodes(spark, d):
    p = t(spark, d, "part").withColumn("type", F.expr(KINDS))
    key = F.when((F.col("type") == "ticket") & (F.col("p_partkey") % 3 == 0), F.concat(F.lit("PAY-"), F.col("p_partkey") % 50, F.lit(" "))).otherwise("")
    size, at = F.col("p_size"), F.col("p_partkey") % 11
    return p.select(
        F.col("p_partkey").alias("node_id"),
        "type",
        F.concat(key, "p_name").alias("name"),
        (size % 9).alias("refs"),
        (F.col("p_partkey") % 5 == 0).alias("guess"),
        F.when(at == 1, "proposed_ticket").when(at == 2, "proposed_from_feedback").when(at == 3, "proposed_project").when(at == 4, "past_undocumented").alias("category"),
        F.when(size % 6 == 0, "Done").when(size % 6 == 1, "proposed").when(size % 6 == 2, "In Progress").when(size % 6 == 3, "In Review").when(size % 6 == 4, "Backlog").alias("status"),
        F.when(size % 4 == 0, "documented").when(size % 4 == 1, "undocumented").alias("level"),
        ((F.col("type") == "decision") & (F.col("p_partkey") % 3 == 0)).alias("convention"),
        (F.col("p_partkey") % 2 == 0).alias("direct"),
        F.when(size % 3 == 0, "high").when(size % 3 == 1, "medium").otherwise("low").alias("confidence"),
    )


def points(*rules):
    """The sum of the points of all (condition, points) that hold."""
    return sum((F.when(when, F.lit(n)).otherwise(0) for when, n in rules), F.lit(0))


def best_nodes(nodes):
    """Of the nodes of one type and plain name the one of most points; ties by references, then by id.  Each has `proposed`:
    whether it is a ticket that only is proposed."""
    sure = F.when(F.col("guess"), F.lit(-3)).otherwise(2)
    found = F.when(F.col("category").isNull(), F.lit(0)).when(F.col("guess"), F.lit(2)).otherwise(6)
    confidence = points((F.col("confidence") == "high", 2), (F.col("confidence") == "medium", 1))
    score = F.least("refs", F.lit(5)) + sure + found + confidence + points((F.col("status").isNotNull(), 4), (F.col("level").isNotNull(), 3), (F.col("convention"), 3), (F.col("direct"), 2))
    plain = F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " "))
    rows = nodes.withColumn("plain", plain).withColumn("score", score)
    first = rows.groupBy("type", "plain").agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("refs")).alias("f"), "node_id")).alias("b"))
    kept = rows.join(first.select(F.col("b.node_id").alias("node_id")), "node_id", "left_semi")
    proposed = F.col("type").isin("ticket", "customer_feedback", "project") & F.coalesce(F.col("category").isin(PROPOSED), F.lit(False))
    return kept.withColumn("proposed", proposed)


def project_category():
    """The category of a project by what was found of it, its status and how well it is documented."""
    status, level = F.lower(F.coalesce("status", F.lit(""))), F.coalesce("level", F.lit(""))
    found = F.coalesce("category", F.lit(""))
    done = status.rlike("done|completed|closed|past")
    return (
        F.when(F.col("type") != "project", F.lit(None))
        .when((found == "proposed_project") | status.isin("proposed", "planned"), "proposed_projects")
        .when(found.isin("past_undocumented", "ongoing_undocumented"), found)
        .when(done, F.when(level == "documented", "past_documented").otherwise("past_undocumented"))
        .when(level == "undocumented", "ongoing_undocumented")
        .when((level == "documented") | F.col("direct"), "ongoing_documented")
        .otherwise("ongoing_undocumented")
    )


@query(
    f"WITH {NODES}, {BEST_NODES} "
    "SELECT node_id, type, name, CASE WHEN convention OR type IN ('project', 'team_member') THEN 'high' WHEN type IN ('decision', 'process', 'repository') THEN 'medium' ELSE 'low' END AS priority, "
    "CASE WHEN type <> 'project' THEN NULL WHEN coalesce(category, '') = 'proposed_project' OR lower(coalesce(status, '')) IN ('proposed', 'planned') THEN 'proposed_projects' "
    "WHEN category IN ('past_undocumented', 'ongoing_undocumented') THEN category "
    "WHEN regexp_matches(lower(coalesce(status, '')), 'done|completed|closed|past') THEN CASE WHEN level = 'documented' THEN 'past_documented' ELSE 'past_undocumented' END "
    "WHEN level = 'undocumented' THEN 'ongoing_undocumented' WHEN level = 'documented' OR direct THEN 'ongoing_documented' ELSE 'ongoing_undocumented' END AS category "
    "FROM marked WHERE NOT (proposed AND type <> 'project') AND type IN ('project', 'team_member', 'decision', 'process', 'repository')"
)
def y14_page_plan(spark, d):
    """A page for each node that should have one, once for each type and name, with its priority and project category."""
    pages = best_nodes(part_nodes(spark, d)).where(F.col("type").isin(PAGE_TYPES) & ~(F.col("proposed") & (F.col("type") != "project")))
    priority = F.when(F.col("convention") | F.col("type").isin("project", "team_member"), "high").when(F.col("type").isin("decision", "process", "repository"), "medium").otherwise("low")
    return pages.select("node_id", "type", "name", priority.alias("priority"), project_category().alias("category"))


def workflow(status):
    status, out = F.lower(F.coalesce(status, F.lit(""))), None
    for state, words in STATES:
        out = F.when(status.rlike(words), state) if out is None else out.when(status.rlike(words), state)
    return out.otherwise("backlog")


@query(
    f"WITH {NODES}, {BEST_NODES}, "
    "keyed AS (SELECT *, regexp_extract(upper(name), '\\b[A-Z][A-Z0-9]+-\\d+\\b') AS own FROM marked WHERE type = 'ticket' OR proposed), "
    "tn AS (SELECT *, CASE WHEN own <> '' THEN 'jira:' || own WHEN category = 'proposed_from_feedback' THEN 'feedback:' || plain ELSE 'ticket:' || plain END AS key, "
    "CASE WHEN own <> '' THEN 35 ELSE 0 END + CASE WHEN status IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN direct THEN 10 ELSE 0 END "
    "+ CASE confidence WHEN 'high' THEN 4 WHEN 'medium' THEN 2 ELSE 0 END + least(refs, 5) AS weight FROM keyed), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY weight DESC, node_id) AS place, count(*) OVER (PARTITION BY key) AS nodes FROM tn), "
    "old AS (SELECT o_orderkey AS ticket_id, 'jira:PAY-' || (o_custkey % 60) AS key, o_orderkey % 4 AS comments, o_orderkey % 3 AS subtasks, o_orderdate AS created FROM orders), "
    "keeper AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY comments DESC, subtasks DESC, created DESC, ticket_id) AS kept, count(*) OVER (PARTITION BY key) AS tickets FROM old) "
    "SELECT n.key, n.node_id, k.ticket_id, CASE WHEN k.ticket_id IS NULL THEN 'insert' ELSE 'update' END AS action, "
    "CASE WHEN regexp_matches(lower(coalesce(status, '')), '\\b(done|closed|resolved|complete|completed)\\b') THEN 'done' "
    "WHEN regexp_matches(lower(coalesce(status, '')), '\\b(review|qa|verify|testing)\\b') THEN 'review' "
    "WHEN regexp_matches(lower(coalesce(status, '')), '\\b(in progress|in_progress|active|doing|wip)\\b') THEN 'in_progress' ELSE 'backlog' END AS state, "
    "n.nodes - 1 AS skipped, coalesce(k.tickets - 1, 0) AS collapsed FROM ranked n LEFT JOIN keeper k ON k.key = n.key AND k.kept = 1 WHERE n.place = 1"
)
def y14_ticket_sync(spark, d):
    """For each sync key the node of most weight, the ticket that is kept of those there are, and what is to be done."""
    nodes = best_nodes(part_nodes(spark, d)).where((F.col("type") == "ticket") | F.col("proposed"))
    own = F.regexp_extract(F.upper("name"), TICKET_KEY, 0)
    key = F.when(own != "", F.concat(F.lit("jira:"), own)).when(F.col("category") == "proposed_from_feedback", F.concat(F.lit("feedback:"), "plain")).otherwise(F.concat(F.lit("ticket:"), "plain"))
    weight = F.least("refs", F.lit(5)) + points((own != "", 35), (F.col("status").isNotNull(), 10), (F.col("direct"), 10), (F.col("confidence") == "high", 4), (F.col("confidence") == "medium", 2))
    first = nodes.groupBy(key.alias("key")).agg(F.min(F.struct((-weight).alias("w"), "node_id", "status")).alias("b"), F.count("*").alias("nodes"))
    old = t(spark, d, "orders").select(F.col("o_orderkey").alias("ticket_id"), F.concat(F.lit("jira:PAY-"), F.col("o_custkey") % 60).alias("key"), "o_orderdate")
    order = F.struct((-(F.col("ticket_id") % 4)).alias("comments"), (-(F.col("ticket_id") % 3)).alias("subtasks"), (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("created"), "ticket_id")
    keeper = old.groupBy("key").agg(F.min(order)["ticket_id"].alias("ticket_id"), F.count("*").alias("tickets"))
    action = F.when(F.col("ticket_id").isNull(), "insert").otherwise("update")
    return first.join(keeper, "key", "left").select("key", "b.node_id", "ticket_id", action.alias("action"), workflow(F.col("b.status")).alias("state"), (F.col("nodes") - 1).alias("skipped"), F.coalesce(F.col("tickets") - 1, F.lit(0)).alias("collapsed"))


# ---------------------------------------------------------------- verify cards

#: Kinds of candidates with their own severity (1 is the gravest), and how many cards are made besides the forced ones.
CARD_KINDS = [("unknown_owner", 3), ("low_confidence", 3), ("inferred_claim", 4), ("duplicate_cluster", 4)]
CARDS = 60
RISK = r"password=|AKIA[0-9A-Z]{16}"


@query(
    "WITH x AS (SELECT d.doc_id, d.lang, d.source, text LIKE '%icense%' AS convention, text LIKE '%@%' AS signal, d.doc_id % 7 = 0 AS discovery, regexp_matches(text, 'password=|AKIA[0-9A-Z]{16}') AS risk, "
    "d.doc_id % 9 = 0 AS ownerless, coalesce(l.quality = 0, false) AS weak, coalesce(l.toxic = 1, false) AS inferred, count(*) OVER (PARTITION BY md5(text)) > 1 AS twice "
    "FROM documents d LEFT JOIN labels l USING (doc_id)), "
    "c AS (SELECT *, 'unknown_owner' AS kind, 3 AS own FROM x WHERE ownerless UNION ALL SELECT *, 'low_confidence', 3 FROM x WHERE weak "
    "UNION ALL SELECT *, 'inferred_claim', 4 FROM x WHERE inferred UNION ALL SELECT *, 'duplicate_cluster', 4 FROM x WHERE twice), "
    "f AS (SELECT *, least(own, CASE WHEN kind = 'unknown_owner' AND convention THEN CASE WHEN signal THEN 1 ELSE 2 END "
    "WHEN (discovery OR convention) AND kind IN ('low_confidence', 'inferred_claim') THEN 2 WHEN risk THEN 1 ELSE 4 END) AS severity FROM c), "
    "p AS (SELECT *, 400 - severity * 100 + CASE WHEN convention THEN 40 ELSE 0 END + CASE WHEN signal THEN 20 ELSE 0 END + CASE WHEN risk THEN 30 ELSE 0 END AS priority FROM f), "
    "r AS (SELECT *, row_number() OVER (ORDER BY priority DESC, doc_id, kind) AS place FROM p), "
    "kept AS (SELECT doc_id, kind, severity, place, source, lang FROM r WHERE place <= 60 UNION ALL "
    "SELECT doc_id, 'unknown_owner', 1, 0, source, lang FROM x WHERE convention AND signal AND doc_id % 9 <> 0), "
    "w AS (SELECT *, array_to_string(list_sort(string_split(trim(regexp_replace(lower(kind || ' ' || coalesce(source, '') || ' ' || coalesce(lang, '') || ' ' || (doc_id % 40)), '[^a-z0-9]+', ' ', 'g')), ' ')), ' ') AS bag FROM kept), "
    "u AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY place, doc_id) AS again FROM w) "
    "SELECT doc_id, kind, 'S' || severity AS severity, place = 0 AS forced FROM u WHERE again = 1"
)
def y18_verify_cards(spark, d):
    """Cards of four kinds: a severity no lower than what the case asks for, the CARDS of most priority, a card for each
    convention with a sign of its owner that has none, and of cards whose titles are the same words only the first."""
    docs = t(spark, d, "documents")
    facts = docs.select(
        "doc_id", "lang", "source", F.md5("text").alias("digest"),
        F.col("text").contains("icense").alias("convention"), F.col("text").contains("@").alias("signal"), (F.col("doc_id") % 7 == 0).alias("discovery"), F.col("text").rlike(RISK).alias("risk"),
    )
    copies = facts.where("digest is not null").groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").select("digest", F.lit(True).alias("twice"))
    labels = t(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("weak"), (F.col("toxic") == 1).alias("inferred"))
    x = facts.join(labels, "doc_id", "left").join(copies, "digest", "left")
    holds = {"unknown_owner": F.col("doc_id") % 9 == 0, "low_confidence": F.col("weak"), "inferred_claim": F.col("inferred"), "duplicate_cluster": F.col("twice")}
    kinds = F.array_compact(F.array(*[F.when(holds[k], F.struct(F.lit(k).alias("kind"), F.lit(s).alias("own"))) for k, s in CARD_KINDS]))
    c = x.withColumn("k", F.explode(kinds)).select("*", "k.kind", "k.own")
    floor = (
        F.when((F.col("kind") == "unknown_owner") & F.col("convention"), F.when(F.col("signal"), F.lit(1)).otherwise(2))
        .when((F.col("discovery") | F.col("convention")) & F.col("kind").isin("low_confidence", "inferred_claim"), F.lit(2))
        .when(F.col("risk"), F.lit(1))
        .otherwise(4)
    )
    c = c.withColumn("severity", F.least("own", floor))
    c = c.withColumn("priority", F.lit(400) - F.col("severity") * 100 + points((F.col("convention"), 40), (F.col("signal"), 20), (F.col("risk"), 30)))
    columns = ["doc_id", "kind", "severity", "source", "lang"]
    most = c.orderBy(F.desc("priority"), "doc_id", "kind").limit(CARDS)
    most = most.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), "doc_id", "kind"))).select(*columns, "place")  # of CARDS rows
    forced = x.where("convention and signal and doc_id % 9 <> 0").select("doc_id", F.lit("unknown_owner").alias("kind"), F.lit(1).alias("severity"), "source", "lang", F.lit(0).alias("place"))
    title = F.concat_ws(" ", "kind", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id") % 40)
    bag = F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")), " ")), " ")
    first = most.union(forced).groupBy(bag.alias("bag")).agg(F.min(F.struct("place", "doc_id", "kind", "severity")).alias("b"))
    return first.select("b.doc_id", "b.kind", F.concat(F.lit("S"), F.col("b.severity")).alias("severity"), (F.col("b.place") == 0).alias("forced"))


# ---------------------------------------------------------------- fact groups

#: Least cosine of a pair of claims, and of a hit that speaks for a claim; how many hits lift a low confidence.
SIMILAR, HIT, HITS = 0.4, 0.4, 2


@query(
    f"WITH RECURSIVE pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, {COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND {GATE} WHERE {COS} >= {SIMILAR}), "
    "s AS (SELECT a, b, score FROM pairs UNION ALL SELECT b, a, score FROM pairs), "
    "reach(node, root) AS (SELECT DISTINCT a, a FROM s UNION SELECT s.b, r.root FROM reach r JOIN s ON s.a = r.node), "
    "g AS (SELECT node AS vec_id, min(root) AS canonical FROM reach GROUP BY node), "
    f"h AS (SELECT a AS vec_id, count(*) AS hits FROM s WHERE score >= {HIT} GROUP BY a), "
    "k AS (SELECT canonical, count(DISTINCT coalesce(toxic, 0)) > 1 AS conflict FROM g LEFT JOIN labels ON doc_id = vec_id GROUP BY canonical) "
    "SELECT e.vec_id, coalesce(g.canonical, e.vec_id) AS canonical, CASE WHEN g.canonical IS NULL THEN 'single' WHEN g.canonical = e.vec_id THEN 'canonical' ELSE 'member' END AS role, "
    "CASE WHEN g.canonical IS NULL THEN 'none' WHEN conflict THEN 'conflict' ELSE 'duplicate' END AS kind, "
    f"CASE WHEN e.vec_id % 3 = 0 AND coalesce(hits, 0) < {HITS} THEN 'low' ELSE 'medium' END AS confidence, "
    "md5(CASE WHEN conflict IS FALSE THEN c.text ELSE d.text END) AS text "
    "FROM embeddings e LEFT JOIN g USING (vec_id) LEFT JOIN h USING (vec_id) LEFT JOIN k ON k.canonical = g.canonical "
    "LEFT JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN documents c ON c.doc_id = g.canonical"
)
def y22_fact_groups(spark, d):
    """Claims (vectors with the text of their document) in groups of similar ones: entities overlap or one claim has none.

    A group whose members' labels differ is a conflict; in others the canonical claim's text (of the least id) is copied
    to all members.  A low confidence becomes medium with HITS similar claims."""
    pairs = written(gated_pairs(spark, d, SIMILAR))
    both = pairs.select("a", "score").union(pairs.select("b", "score"))
    hits = both.where(F.col("score") >= HIT).groupBy(F.col("a").alias("vec_id")).agg(F.count("*").alias("hits"))
    g = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("SAME").alias("type"))).select(F.col("node").alias("vec_id"), F.col("component").alias("canonical"))
    toxic = t(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), "toxic")
    k = g.join(toxic, "vec_id", "left").groupBy("canonical").agg((F.min(F.coalesce("toxic", F.lit(0))) != F.max(F.coalesce("toxic", F.lit(0)))).alias("conflict"))
    text = t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.md5("text").alias("digest"))
    out = t(spark, d, "embeddings").select("vec_id").join(g, "vec_id", "left").join(hits, "vec_id", "left").join(k, "canonical", "left")
    out = out.join(text, "vec_id", "left").join(text.select(F.col("vec_id").alias("canonical"), F.col("digest").alias("shared")), "canonical", "left")
    role = F.when(F.col("canonical").isNull(), "single").when(F.col("canonical") == F.col("vec_id"), "canonical").otherwise("member")
    kind = F.when(F.col("canonical").isNull(), "none").when(F.col("conflict"), "conflict").otherwise("duplicate")
    low = (F.col("vec_id") % 3 == 0) & (F.coalesce("hits", F.lit(0)) < HITS)
    return out.select(
        "vec_id",
        F.coalesce("canonical", "vec_id").alias("canonical"),
        role.alias("role"),
        kind.alias("kind"),
        F.when(low, "low").otherwise("medium").alias("confidence"),
        F.when(F.col("conflict") == F.lit(False), F.col("shared")).otherwise(F.col("digest")).alias("text"),
    )


# ---------------------------------------------------------------- retrieval packs

PACK = 10


@query(
    f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {COS} AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s), "
    "snippets AS (SELECT doc_id, md5(CASE WHEN length(trim(text)) > 200 THEN trim(substr(trim(text), 1, 197)) || '...' ELSE trim(text) END) AS snippet FROM documents), "
    "v AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(snippet, 'none:' || vec_id) ORDER BY r) AS again FROM r LEFT JOIN snippets ON doc_id = vec_id WHERE r <= 10), "
    "vector AS (SELECT query_id, 'vector' AS layer, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank, CAST(vec_id AS VARCHAR) AS item, round(score, 6) AS score, snippet FROM v WHERE again = 1), "
    "q AS (SELECT DISTINCT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0), "
    "edge AS (SELECT query_id, l_orderkey, row_number() OVER (PARTITION BY query_id ORDER BY l_orderkey) AS rank FROM (SELECT DISTINCT query_id, l_orderkey FROM q JOIN lineitem ON l_partkey = query_id)), "
    "hop AS (SELECT query_id, n_name, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, n_name) AS rank FROM q JOIN lineitem ON l_partkey = query_id "
    "JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY query_id, n_name) "
    "SELECT query_id, layer, CAST(rank AS INTEGER) AS rank, item, score, snippet FROM vector UNION ALL "
    "SELECT query_id, 'edge', CAST(rank AS INTEGER), 'o' || l_orderkey, NULL, NULL FROM edge WHERE rank <= 10 UNION ALL SELECT query_id, 'hop', CAST(rank AS INTEGER), n_name, NULL, NULL FROM hop WHERE rank <= 10"
)
def y15_retrieval_packs(spark, d):
    """Packs in three layers of up to PACK items each: the nearest vectors with distinct snippets of their documents, the
    edges at the node itself (orders of the part), and what two hops reach (nations of its suppliers), the most frequent first."""
    found = nearest_of_label(spark, d, PACK)
    snippets = t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.md5(truncate(F.col("text"), 200)).alias("snippet"))
    hits = found.join(snippets, "vec_id", "left")
    same = Window.partitionBy("query_id", F.coalesce("snippet", F.concat(F.lit("none:"), "vec_id"))).orderBy("rank")
    hits = hits.withColumn("again", F.row_number().over(same)).where("again = 1")
    place = lambda *by: F.row_number().over(Window.partitionBy("query_id").orderBy(*by))
    vector = hits.select("query_id", F.lit("vector").alias("layer"), place("rank").alias("rank"), F.col("vec_id").cast("string").alias("item"), F.round("score", 6).alias("score"), "snippet")
    q = t(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")).distinct()
    lines = t(spark, d, "lineitem").select(F.col("l_partkey").alias("query_id"), "l_orderkey", "l_suppkey").join(q, "query_id", "left_semi")
    none = [F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("snippet")]
    edge = lines.select("query_id", "l_orderkey").distinct().select("query_id", F.lit("edge").alias("layer"), place("l_orderkey").alias("rank"), F.concat(F.lit("o"), "l_orderkey").alias("item"), *none)
    by_supplier = lines.groupBy("query_id", "l_suppkey").agg(F.count("*").alias("n"))
    of = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")).join(t(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    hop = by_supplier.join(of, "l_suppkey").groupBy("query_id", "n_name").agg(F.sum("n").alias("n"))
    hop = hop.select("query_id", F.lit("hop").alias("layer"), place(F.desc("n"), "n_name").alias("rank"), F.col("n_name").alias("item"), *none)
    return vector.union(edge.where(F.col("rank") <= PACK)).union(hop.where(F.col("rank") <= PACK))


# ---------------------------------------------------------------- impact

@query(
    "WITH hit AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_partkey % 40 = 0) "
    "SELECT 'order' AS kind, l_orderkey AS id, o_orderstatus || ':review' AS state FROM (SELECT DISTINCT l_orderkey FROM hit) JOIN orders ON o_orderkey = l_orderkey "
    "UNION ALL SELECT 'supplier', l_suppkey, lower(s_name) || ':notify' FROM (SELECT DISTINCT l_suppkey FROM hit) JOIN supplier ON s_suppkey = l_suppkey"
)
def y24_impact(spark, d):
    """What one hop from the changed nodes (parts) reaches, and the update that each kind of target gets."""
    hit = t(spark, d, "lineitem").where("l_partkey % 40 = 0").select("l_orderkey", "l_suppkey")
    orders = t(spark, d, "orders").join(hit.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    suppliers = t(spark, d, "supplier").join(hit.select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi")
    return orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.concat("o_orderstatus", F.lit(":review")).alias("state")).union(
        suppliers.select(F.lit("supplier"), "s_suppkey", F.concat(F.lower("s_name"), F.lit(":notify")))
    )


def absorbed(names, weak: str = "weak"):
    """(id, into): names (id, name, refs, `weak`) whose loose form without a phase is another's go to the one of most
    references, ties by id; then each weak name goes to the strong one that has all its words and shares two or more,
    the one of most references.  A fixed point: who absorbs is never weak, so none goes on."""
    base = F.regexp_replace(loose(F.col("name")), r" (phase|part|v) ?\d+$", "")
    rows = names.withColumn("base", base)
    keep = rows.groupBy("base").agg(F.min(F.struct((-F.col("refs")).alias("r"), "id")).alias("b"), F.bool_and(weak).alias("all_weak")).select("base", F.col("b.id").alias("into"), (-F.col("b.r")).alias("refs"), "all_weak")
    words = keep.withColumn("w", F.array_distinct(F.split("base", " ")))
    left = words.where("all_weak and size(w) >= 2").select(F.col("into").alias("weak_id"), F.col("w").alias("x"), F.explode("w").alias("word"))
    right = words.where("not all_weak").select(F.col("into").alias("strong_id"), "refs", F.col("w").alias("y"), F.explode("w").alias("word"))
    # A weak name meets strong ones at its rarest word among them.
    often = right.groupBy("word").agg(F.count("*").alias("c"))
    rare = left.join(often, "word").groupBy("weak_id").agg(F.min(F.struct("c", "word")).alias("b"), F.first("x").alias("x"), F.count("*").alias("known")).where("known = size(x)").select("weak_id", "x", F.col("b.word").alias("word"))
    met = rare.join(right, "word").where(F.size(F.array_except("x", "y")) == 0)
    best = met.groupBy("weak_id").agg(F.min(F.struct((-F.col("refs")).alias("r"), "strong_id")).alias("b")).select(F.col("weak_id").alias("into"), F.col("b.strong_id").alias("further"))
    return rows.join(keep.select("base", "into"), "base").join(best, "into", "left").select("id", F.coalesce("further", "into").alias("into"))


@query(
    "WITH n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' phase ' || (p_partkey % 4) WHEN p_partkey % 7 = 0 THEN p_name || ' ' || lower(p_type) ELSE p_name END AS name, p_size AS refs, p_partkey % 7 <> 0 AS weak FROM part), "
    "b AS (SELECT *, regexp_replace(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' (phase|part|v) ?\\d+$', '') AS base FROM n), "
    "k AS (SELECT base, arg_min(id, id - CAST(refs AS BIGINT) * 1000000000) AS into_id, max(refs) AS refs, bool_and(weak) AS all_weak, list_distinct(string_split(base, ' ')) AS w FROM b GROUP BY base), "
    "m AS (SELECT x.into_id, y.into_id AS further, row_number() OVER (PARTITION BY x.into_id ORDER BY y.refs DESC, y.into_id) AS r FROM k x JOIN k y ON x.all_weak AND NOT y.all_weak AND len(x.w) >= 2 AND list_has_all(y.w, x.w)) "
    "SELECT b.id, coalesce(m.further, k.into_id) AS \"into\" FROM b JOIN k USING (base) LEFT JOIN m ON m.into_id = k.into_id AND m.r = 1"
)
def j16_fixed_point_merge(spark, d):
    p = t(spark, d, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" phase "), F.col("p_partkey") % 4)).when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit(" "), F.lower("p_type"))).otherwise(F.col("p_name"))
    return absorbed(p.select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_size").alias("refs"), (F.col("p_partkey") % 7 != 0).alias("weak")))
