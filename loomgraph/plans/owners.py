"""Who owns a node, by its attributes, references and edges; and search over names, aliases and references."""

from functools import reduce

from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table as t
from .audits import one_of

# Attributes and members of references that name owners, in this order; names that are nobody's; edges to an owner.
ATTRIBUTES = ["owner_name", "owner", "assignee", "assigned_to", "decided_by", "established_by", "owner_hint"]
MEMBERS = ["assignee", "pr_author", "comment_author", "source_author", "author", "slack_speaker"]
NOBODY = r"(?i)^(unknown|unassigned|none|null|n/a|na|tbd|\(unknown\))$"
LEAD_IN = r"(?i)^(owner|assignee|lead|decision maker|reporter)\s*:\s*"
SEVERAL, BETWEEN = r"(?i)[;,/]|\s+and\s+", r"(?i)\s*(?:,|;|/|\band\b)\s*"
TO_OWNER, FROM_OWNER = ["OWNED_BY", "PROPOSED_BY", "BUILT_BY"], ["LEADS"]


def people(value):
    """Names that a value holds: parted at commas, semicolons, slashes and 'and'; without what follows in brackets, and what leads in."""
    parts = F.when(value.rlike(SEVERAL), F.split(value, BETWEEN)).otherwise(F.array(value))
    plain = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.trim(p), r"\s*\[[^\]]+\]\s*$", ""), LEAD_IN, "")))
    return F.filter(plain, lambda p: (p != "") & ~p.rlike(NOBODY))


def ownership(nodes, refs, edges):
    """(node, owners, primary) of nodes (node, type, name, attributes: map): names in attributes, then in refs (node, at, source, MEMBERS; not of
    customers' feedback) in their order, then team members at the other end of edges (edge, src, dst, type) to an owner or from one
    who leads, by edge.  Each name counts once, as it is written first, whatever its case; nodes without an owner have no row."""
    place = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.lit(a).cast("long").alias("a") if isinstance(a, int) else a.cast("long").alias("a"), F.lit(b).alias("b"))
    said = lambda at, value: F.struct(at.alias("at"), value.alias("value"))
    own = nodes.select("node", F.explode(F.array(*[said(place(0, k, 0), F.col("attributes")[a]) for k, a in enumerate(ATTRIBUTES)])).alias("s"))
    cited = refs.where("source is null or source <> 'customer_feedback'").select("node", F.explode(F.array(*[said(place(1, F.col("at"), k), F.col(m)) for k, m in enumerate(MEMBERS)])).alias("s"))
    told = own.union(cited.join(nodes.select("node"), "node", "left_semi")).where("s.value is not null")
    told = told.select("node", "s.at", F.posexplode(people(F.col("s.value"))).alias("part", "name"))
    member = nodes.where("type = 'team_member' and name <> ''").select(F.col("node").alias("other"), "name")
    ends = edges.where(F.col("type").isin(TO_OWNER)).select("edge", F.col("src").alias("node"), F.col("dst").alias("other"))
    ends = ends.union(edges.where(F.col("type").isin(FROM_OWNER)).select("edge", F.col("dst").alias("node"), F.col("src").alias("other")))
    tied = ends.join(member, "other").join(nodes.select("node"), "node", "left_semi").select("node", place(2, F.col("edge"), 0).alias("at"), F.lit(0).alias("part"), "name")
    first = told.union(tied).groupBy("node", F.lower("name").alias("low")).agg(F.min(F.struct("at", "part", "name")).alias("f"))
    out = first.groupBy("node").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["name"]).alias("owners"))
    return out.select("node", F.array_join("owners", "|").alias("owners"), F.col("owners")[0].alias("primary"))


KINDS = ["team_member", "project", "decision", "ticket"]
VALUES = ["Ada, Bo", "owner: Cy [web]", "unassigned", "Di and Ed / ada", "N/A", "  ", "Land of Andes"]
EDGES = ["OWNED_BY", "USES", "LEADS", "BUILT_BY", "PROPOSED_BY", "RELATED_TO", "LEADS"]


def _quoted(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(
    rf"""WITH n AS (SELECT p_partkey AS node, {_quoted(KINDS)}[1 + p_partkey % 4] AS type, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN {_quoted(VALUES)}[1 + p_partkey % 7] END AS a1, CASE WHEN p_partkey % 5 < 2 THEN {_quoted(VALUES)}[1 + p_size % 7] END AS a4 FROM part),
r AS (SELECT l_partkey AS node, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber = 4 THEN 'customer_feedback' ELSE 'jira' END AS source, 'Supplier ' || (l_suppkey % 6) || ' [team]' AS assignee, CASE WHEN l_linenumber = 2 THEN 'supplier ' || (l_orderkey % 6) END AS author FROM lineitem WHERE l_quantity <= 4),
e AS (SELECT l_orderkey * 10 + l_linenumber AS edge, l_partkey AS src, l_orderkey % 500 AS dst, {_quoted(EDGES)}[l_linenumber] AS type FROM lineitem WHERE l_quantity >= 46),
s AS (SELECT node, 0 AS kind, 1 AS a, 0 AS b, a1 AS value FROM n UNION ALL SELECT node, 0, 4, 0, a4 FROM n UNION ALL SELECT node, 1, pos, 0, assignee FROM r WHERE source <> 'customer_feedback' UNION ALL SELECT node, 1, pos, 4, author FROM r WHERE source <> 'customer_feedback'),
p AS (SELECT node, kind, a, b, CASE WHEN regexp_matches(value, '{SEVERAL}') THEN string_split_regex(value, '{BETWEEN}') ELSE [value] END AS parts FROM s WHERE value IS NOT NULL AND node IN (SELECT node FROM n)),
q AS (SELECT node, kind, a, b, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM p),
c AS (SELECT node, kind, a, b, i, trim(regexp_replace(regexp_replace(trim(part), '\s*\[[^\]]+\]\s*$', ''), '{LEAD_IN}', '')) AS name FROM q),
g AS (SELECT * FROM c WHERE name <> '' AND NOT regexp_matches(name, '{NOBODY}')
  UNION ALL SELECT x.node, 2, edge, 0, 0, m.name FROM (SELECT edge, src AS node, dst AS other FROM e WHERE type IN ('OWNED_BY', 'PROPOSED_BY', 'BUILT_BY') UNION ALL SELECT edge, dst, src FROM e WHERE type = 'LEADS') x JOIN n m ON m.node = x.other AND m.type = 'team_member' WHERE x.node IN (SELECT node FROM n)),
f AS (SELECT node, lower(name) AS low, min((kind, a, b, i, name)) AS f FROM g GROUP BY 1, 2)
SELECT node, string_agg(f[5], '|' ORDER BY f) AS owners, arg_min(f[5], f) AS "primary" FROM f GROUP BY node"""
)
def y21_owners(spark, d):
    """Parts as nodes, small order lines as their references, large ones as edges."""
    i, line = F.col("p_partkey"), F.col("l_linenumber")
    attributes = F.create_map(F.lit("owner"), F.when(i % 3 == 0, one_of(i, VALUES)), F.lit("decided_by"), F.when(i % 5 < 2, one_of(F.col("p_size"), VALUES)))
    nodes = t(spark, d, "part").select(i.alias("node"), one_of(i, KINDS).alias("type"), F.col("p_name").alias("name"), attributes.alias("attributes"))
    lines = t(spark, d, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + line)
    null = F.lit(None).cast("string")
    named = {"assignee": F.concat(F.lit("Supplier "), F.col("l_suppkey") % 6, F.lit(" [team]")), "author": F.when(line == 2, F.concat(F.lit("supplier "), F.col("l_orderkey") % 6))}
    refs = lines.where("l_quantity <= 4").select(F.col("l_partkey").alias("node"), "at", F.when(line == 4, "customer_feedback").otherwise("jira").alias("source"), *[named.get(m, null).alias(m) for m in MEMBERS])
    edges = lines.where("l_quantity >= 46").select(F.col("at").alias("edge"), F.col("l_partkey").alias("src"), (F.col("l_orderkey") % 500).alias("dst"), one_of(line - 1, EDGES).alias("type"))
    return ownership(nodes, refs, edges)


# ---------------------------------------------------------------- search over nested fields


def nested_search(nodes, terms, types=None):
    """(id, type, found) of nodes (id, type, name, aliases: array, refs: array of (title, excerpt)) in which a term (a pattern, in any
    case) is in the name, an alias, or a title or excerpt of a reference; `found` are the terms that are, in their order.  types: only these."""
    def hit(term):
        at = lambda c: F.coalesce(c.rlike(f"(?i){term}"), F.lit(False))
        inside = lambda column, test: F.coalesce(F.exists(column, test), F.lit(False))
        return at(F.col("name")) | inside("aliases", at) | inside("refs", lambda r: at(r.title) | at(r.excerpt))

    hits = [hit(term) for term in terms]
    rows = nodes if types is None else nodes.where(F.col("type").isin(types))
    rows = rows.where(reduce(lambda a, b: a | b, hits, F.lit(False)))
    return rows.select("id", "type", F.array_join(F.array_compact(F.array(*[F.when(h, term) for h, term in zip(hits, terms, strict=True)])), ";").alias("found"))


TERMS, SOUGHT = ["large ring", "economy.*brand#1", "fi[rb]"], ["project", "decision"]


@query(
    "WITH n AS (SELECT p_partkey AS id, " + _quoted(KINDS) + "[1 + p_partkey % 4] AS type, p_name AS name, [p_type || ' ' || p_brand, 'ring large'] AS aliases FROM part), "
    "r AS (SELECT doc_id AS id, text FROM documents), "
    "h AS (SELECT n.id, type, " + ", ".join(f"regexp_matches(name, '(?i){x}') OR len(list_filter(aliases, lambda a: regexp_matches(a, '(?i){x}'))) > 0 OR coalesce(regexp_matches(text, '(?i){x}'), false) AS h{k}" for k, x in enumerate(TERMS)) + " FROM n LEFT JOIN r USING (id) WHERE type IN ('project', 'decision')) "
    "SELECT id, type, concat_ws(';', " + ", ".join(f"CASE WHEN h{k} THEN '{x}' END" for k, x in enumerate(TERMS)) + ") AS found FROM h WHERE h0 OR h1 OR h2"
)
def v12_nested_search(spark, d):
    """Parts with their types as aliases and the document of the same number as reference."""
    i = F.col("p_partkey")
    p = t(spark, d, "part").select(i.alias("id"), one_of(i, KINDS).alias("type"), F.col("p_name").alias("name"), F.array(F.concat_ws(" ", "p_type", "p_brand"), F.lit("ring large")).alias("aliases"))
    refs = t(spark, d, "documents").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct(F.lit(None).cast("string").alias("title"), F.col("text").alias("excerpt"))).alias("refs"))
    return nested_search(p.join(refs, "id", "left"), TERMS, SOUGHT)
