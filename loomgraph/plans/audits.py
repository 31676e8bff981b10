"""Checks and upkeep of a graph: status, truth, traversal, undocumented work, built edges, raw inputs and ingest."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators.graph import both_ways, written
from ..operators.names import occurrences
from ..registry import query
from ..sources.tables import table as t
from ..streaming.ingest import changed, impact
from .joins import resolve_names
from .steps import NODES, part_nodes


def one_of(index, values):
    """The value at index modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


# ---------------------------------------------------------------- tenants and raw inputs


@query("SELECT event_id, 'tenant_' || (user_id % 5) AS tenant FROM events WHERE user_id % 5 = 2")
def s04_tenant_routing(spark, d):
    """Events laid out in a folder for each tenant; of these only one is read."""
    e = t(spark, d, "events").select("event_id", F.concat(F.lit("tenant_"), F.col("user_id") % 5).alias("tenant"))
    return written(e, "tenant").where("tenant = 'tenant_2'")


#: Sources that raw input may come from (fixed values).
INPUT_SOURCES = ["confluence", "jira", "slack", "github", "customerFeedback"]


def raw_inputs(rows):
    """The stored input of each (company, source) after rows (company, source, data, seq) came in by seq: the last data, its
    format and number of documents, and the seq that first stored it.  Rows of other sources or without data are refused."""
    good = rows.where(F.col("source").isin(INPUT_SOURCES) & F.col("data").isNotNull())
    is_json = F.trim("data").rlike(r"^[{\[]") & F.expr("try_parse_json(data) IS NOT NULL")
    length = lambda path: F.json_array_length(F.get_json_object("data", path))
    n = F.when(is_json, F.coalesce(length("$.results"), length("$.issues"), F.json_array_length("data"), F.lit(1))).otherwise(1)
    seen = good.select("company", "source", "seq", F.struct("data", F.when(is_json, "json").otherwise("human_text").alias("format"), F.greatest(n, F.lit(1)).cast("long").alias("doc_count")).alias("v"))
    kept = seen.groupBy("company", "source").agg(F.max_by("v", "seq").alias("v"), F.max("seq").alias("updated"), F.min("seq").alias("created"))
    return kept.select("company", "source", "v.data", "v.format", "v.doc_count", "updated", "created")


@query(
    "WITH r AS (SELECT lang AS company, ['confluence', 'jira', 'slack', 'github', 'customerFeedback', 'fax'][1 + doc_id % 6] AS source, doc_id, "
    """CASE WHEN doc_id % 7 < 2 THEN '{"results":[1,' || doc_id || ']}' WHEN doc_id % 7 < 4 THEN '{"issues":[1,2,3]}' WHEN doc_id % 7 = 4 THEN '[1,2,3,4]' WHEN doc_id % 7 = 5 THEN text END AS data FROM documents), """
    "k AS (SELECT *, row_number() OVER (PARTITION BY company, source ORDER BY doc_id DESC) AS n, min(doc_id) OVER (PARTITION BY company, source) AS created FROM r WHERE source <> 'fax' AND data IS NOT NULL) "
    "SELECT company, source, md5(data) AS data, CASE WHEN doc_id % 7 < 5 THEN 'json' ELSE 'human_text' END AS format, "
    "CASE WHEN doc_id % 7 < 2 THEN 2 WHEN doc_id % 7 < 4 THEN 3 WHEN doc_id % 7 = 4 THEN 4 ELSE 1 END AS doc_count, doc_id AS updated, created FROM k WHERE n = 1"
)
def s05_raw_input_upsert(spark, d):
    i = F.col("doc_id") % 7
    data = F.when(i < 2, F.concat(F.lit('{"results":[1,'), "doc_id", F.lit("]}"))).when(i < 4, '{"issues":[1,2,3]}').when(i == 4, "[1,2,3,4]").when(i == 5, F.col("text"))
    rows = t(spark, d, "documents").select(F.col("lang").alias("company"), one_of(F.col("doc_id"), [*INPUT_SOURCES, "fax"]).alias("source"), data.alias("data"), F.col("doc_id").alias("seq"))
    return raw_inputs(rows).withColumn("data", F.md5("data"))


# ---------------------------------------------------------------- status of projects

#: States of tickets and of changes (fixed values).
TICKET_DONE, TICKET_RUNNING, TICKET_WAITING = ["done", "closed", "resolved"], ["in progress", "in review", "active"], ["backlog", "to do", "open"]
CHANGE_DONE, CHANGE_RUNNING = ["merged", "closed"], ["open"]


def status_of(state, done, running, waiting=()):
    """All done: completed; else one running: active; else all waiting: proposed; else null.  Null states don't count."""
    out = F.when(F.bool_and(state.isin(done)), "completed").when(F.bool_or(state.isin(running)), "active")
    return out.when(F.bool_and(state.isin(list(waiting))), "proposed") if waiting else out


@query(
    "WITH o AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS year, o_orderstatus, o_orderkey % 3 AS i FROM orders), "
    "a AS (SELECT o_custkey, year, CASE o_orderstatus WHEN 'F' THEN ['done', 'closed', 'resolved'][1 + i] WHEN 'P' THEN ['in progress', 'in review', 'active'][1 + i] ELSE ['backlog', 'to do', 'open'][1 + i] END AS s FROM o), "
    "tickets AS (SELECT o_custkey, year, CASE WHEN bool_and(s IN ('done', 'closed', 'resolved')) THEN 'completed' WHEN bool_or(s IN ('in progress', 'in review', 'active')) THEN 'active' "
    "WHEN bool_and(s IN ('backlog', 'to do', 'open')) THEN 'proposed' END AS s FROM a GROUP BY ALL), "
    "b AS (SELECT o_custkey, year, CASE WHEN l_returnflag = 'R' THEN 'merged' WHEN l_returnflag = 'A' THEN 'closed' WHEN l_linenumber < 4 THEN 'open' END AS s FROM o JOIN lineitem ON l_orderkey = o_orderkey), "
    "changes AS (SELECT o_custkey, year, CASE WHEN bool_and(s IN ('merged', 'closed')) THEN 'completed' WHEN bool_or(s = 'open') THEN 'active' END AS s FROM b GROUP BY ALL) "
    "SELECT o_custkey, year, coalesce(t.s, c.s) AS status, CASE WHEN t.s IS NOT NULL THEN 'ticket' WHEN c.s IS NOT NULL THEN 'change' END AS origin FROM tickets t LEFT JOIN changes c USING (o_custkey, year)"
)
def a11_status_rollup(spark, d):
    """Status of each customer's year: by its orders as tickets, where these leave it open by its lines as changes."""
    i = F.col("o_orderkey")
    ticket = F.when(F.col("o_orderstatus") == "F", one_of(i, TICKET_DONE)).when(F.col("o_orderstatus") == "P", one_of(i, TICKET_RUNNING)).otherwise(one_of(i, TICKET_WAITING))
    o = t(spark, d, "orders").select(i.alias("l_orderkey"), "o_custkey", F.year("o_orderdate").alias("year"), ticket.alias("ticket"))
    flag = F.col("l_returnflag")
    change = F.when(flag == "R", "merged").when(flag == "A", "closed").when(F.col("l_linenumber") < 4, "open")
    lines = t(spark, d, "lineitem").select("l_orderkey", change.alias("change")).join(o, "l_orderkey")
    tickets = o.groupBy("o_custkey", "year").agg(status_of(F.col("ticket"), TICKET_DONE, TICKET_RUNNING, TICKET_WAITING).alias("t"))
    changes = lines.groupBy("o_custkey", "year").agg(status_of(F.col("change"), CHANGE_DONE, CHANGE_RUNNING).alias("c"))
    origin = F.when(F.col("t").isNotNull(), "ticket").when(F.col("c").isNotNull(), "change")
    return tickets.join(changes, ["o_custkey", "year"], "left").select("o_custkey", "year", F.coalesce("t", "c").alias("status"), origin.alias("origin"))


# ---------------------------------------------------------------- truth and traversal


def holding(names, texts):
    """(k, low): texts (low) that hold a name (k)."""
    return occurrences(texts.select(F.col("low").alias("id"), F.col("low").alias("text")), names.select(F.col("k").alias("name"))).select(F.col("name").alias("k"), F.col("id").alias("low"))


#: Likeness of names of which one holds the other (fixed value).
HELD = 0.92


def truth_audit(truth, pages, links, least: float = 0.62):
    """What is amiss (issue, name, category): truth (name, category) that no page (id, name) is like by `least`; truth whose
    page is in other hubs than its category's; hubs of links (category, kind, id) with no more projects than members.
    The page of most likeness counts, ties by id: 1 if equal, HELD if one name holds the other, else the share of tokens."""
    plain = truth.select("name", x.loose(F.col("name")).alias("k")).distinct()
    known = pages.groupBy(x.loose(F.col("name")).alias("low")).agg(F.min("id").alias("id"))
    forth = holding(plain.select("k").distinct(), known.select("low"))
    back = holding(known.select(F.col("low").alias("k")), plain.select(F.col("k").alias("low")).distinct()).select(F.col("low").alias("k"), F.col("k").alias("low"))
    held = forth.union(back).where("k <> '' and low <> ''").distinct().join(known, "low").join(plain, "k").select("name", "id", F.lit(HELD).alias("score"))
    near = resolve_names(truth.select(F.col("name").alias("ref")), pages, least).select(F.col("ref").alias("name"), "id", "score")
    best = near.union(held).groupBy("name").agg(F.max(F.struct("score", (-F.col("id")).alias("m"))).alias("b"))
    found = best.where(F.col("b.score") >= least).select("name", (-F.col("b.m")).alias("id"))
    met = truth.distinct().join(found, "name", "left")
    row = lambda df, issue, name: df.select(F.lit(issue).alias("issue"), F.col(name).alias("name"), "category")
    missing = row(met.where("id is null"), "missing", "name")
    held = links.where("kind = 'project'").select("id", "category").distinct()
    wrong = row(met.where("id is not null").join(held, ["id", "category"], "left_anti"), "wrong_category", "name")
    sizes = links.groupBy("category").agg(F.count_if(F.col("kind") == "project").alias("p"), F.count_if(F.col("kind") == "member").alias("m"))
    return missing.union(wrong).union(row(sizes.where("p <= m"), "weak_hub", "category"))


@query(
    "WITH truth AS (SELECT DISTINCT p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' plan' ELSE ' new release' END AS name, ['past', 'ongoing', 'proposed'][1 + p_size % 3] AS category FROM part), "
    "pages AS (SELECT p_name AS name, min(p_partkey) AS id FROM part WHERE p_partkey % 40 = 0 GROUP BY 1), "
    "links AS (SELECT ['past', 'ongoing', 'proposed'][1 + p_size % 3] AS category, CASE WHEN p_partkey % 3 < p_size % 3 THEN 'member' ELSE 'project' END AS kind, p_partkey AS id FROM part), "
    "s AS (SELECT t.name, p.id, CASE WHEN t.name = p.name THEN 1 WHEN contains(t.name, p.name) OR contains(p.name, t.name) THEN CAST(0.92 AS DOUBLE) ELSE len(list_intersect(string_split(t.name, ' '), string_split(p.name, ' '))) / greatest(len(list_distinct(string_split(t.name, ' '))), len(list_distinct(string_split(p.name, ' ')))) END AS s FROM (SELECT DISTINCT name FROM truth) t CROSS JOIN pages p), "
    "f AS (SELECT name, arg_min(id, (-s, id)) AS id FROM s WHERE s >= 0.62 GROUP BY name), m AS (SELECT t.name, category, id FROM truth t LEFT JOIN f USING (name)) "
    "SELECT 'missing' AS issue, name, category FROM m WHERE id IS NULL UNION ALL "
    "SELECT 'wrong_category', name, category FROM m WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM links l WHERE l.id = m.id AND l.category = m.category AND kind = 'project') UNION ALL "
    "SELECT 'weak_hub', category, category FROM links GROUP BY category HAVING count(*) FILTER (WHERE kind = 'project') <= count(*) FILTER (WHERE kind = 'member')"
)
def a16_truth_metrics(spark, d):
    p, at = t(spark, d, "part"), F.col("p_partkey") % 3
    category = one_of(F.col("p_size"), ["past", "ongoing", "proposed"]).alias("category")
    truth = p.select(F.concat("p_name", F.when(at == 0, "").when(at == 1, " plan").otherwise(" new release")).alias("name"), category)
    pages = p.where("p_partkey % 40 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    links = p.select(category, F.when(at < F.col("p_size") % 3, "member").otherwise("project").alias("kind"), F.col("p_partkey").alias("id"))
    return truth_audit(truth, pages, links)


#: Types of edges to owners and to rules (fixed values); nodes to look at besides those in question.
OWNER_EDGES, RULE_EDGES, FOCUS = ["OWNED_BY", "PROPOSED_BY", "LEADS", "MEMBER_OF"], ["APPLIES_TO", "CONTAINS", "RELATED_TO"], 6


def traversal_checks(nodes, edges):
    """Whether the nodes in question reach an owner, a rule and evidence: (node, name, owner_path, rule_path, evidence).

    nodes (node, name, type, focus, rule, refs).  Looked at are projects and tickets with focus, and of those that a rule
    applies to the first by name, until there are six (one at least).  An owner is reached directly or over the rule of
    least node that has one; evidence is a node with refs among the node, those it leads to, its rules and owners."""
    subjects = nodes.where("type in ('project', 'ticket')")
    sure = subjects.where("focus")
    bound = edges.where("type = 'APPLIES_TO'").select(F.col("dst").alias("node"))
    more = subjects.where("not coalesce(focus, false)").join(bound, "node", "left_semi").orderBy("name", "node").limit(max(1, FOCUS - sure.limit(FOCUS).count()))
    looked = sure.union(more).select("node", "name", "refs")
    known = nodes.select(F.col("node").alias("other"), F.col("rule").alias("to_rule"), F.col("refs").alias("to_refs"))
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "type", F.lit(True).alias("out"))
    step = step.union(edges.where("type in ('APPLIES_TO', 'RELATED_TO')").select("dst", "src", "type", F.lit(False)))
    step = step.join(looked.select("node"), "node", "left_semi").join(known, "other")
    owners = edges.where(F.col("type").isin(OWNER_EDGES)).join(known, F.col("dst") == F.col("other")).groupBy("src").agg(F.max("to_refs").alias("owner_refs"))
    step = step.join(owners.withColumnRenamed("src", "other"), "other", "left")
    rule, own = F.col("to_rule") & (~F.col("out") | F.col("type").isin(RULE_EDGES)), F.col("out") & F.col("type").isin(OWNER_EDGES)
    seen = step.groupBy("node").agg(
        F.bool_or(own).alias("own"),
        F.bool_or(rule).alias("rule_path"),
        F.max(F.when(F.col("out") | rule, F.col("to_refs"))).alias("near"),
        F.min(F.when(rule & F.col("owner_refs").isNotNull(), F.struct("other", "owner_refs"))).alias("via"),
    )
    no, none = F.lit(False), F.lit(0)
    out = looked.join(seen, "node", "left").withColumn("own", F.coalesce("own", no))
    far = F.when(~F.col("own"), F.coalesce("via.owner_refs", none)).otherwise(0)
    evidence = F.greatest(F.coalesce("refs", none), F.coalesce("near", none), far) > 0
    return out.select("node", "name", (F.col("own") | F.col("via").isNotNull()).alias("owner_path"), F.coalesce("rule_path", no).alias("rule_path"), evidence.alias("evidence"))


CHECKED = (
    f"WITH {NODES}, n AS (SELECT node_id AS node, name, type, category IS NOT NULL OR guess AS focus, convention OR type = 'process' AS rule, CASE WHEN refs > 6 THEN refs ELSE 0 END AS refs FROM nodes), "
    "e AS (SELECT l_partkey AS src, l_orderkey AS dst, ['OWNED_BY', 'USES', 'LEADS', 'USES', 'APPLIES_TO', 'CONTAINS', 'RELATED_TO'][1 + l_linenumber % 7] AS type FROM lineitem WHERE l_quantity < 5), "
    "sure AS (SELECT * FROM n WHERE type IN ('project', 'ticket') AND focus), "
    "more AS (SELECT * FROM n WHERE type IN ('project', 'ticket') AND focus IS NOT TRUE AND node IN (SELECT dst FROM e WHERE type = 'APPLIES_TO') ORDER BY name, node LIMIT (SELECT greatest(1, 6 - count(*)) FROM sure)), "
    "looked AS (SELECT * FROM sure UNION ALL SELECT * FROM more), "
    "own AS (SELECT e.src AS node, n.node AS owner, n.refs FROM e JOIN n ON n.node = e.dst WHERE e.type IN ('OWNED_BY', 'PROPOSED_BY', 'LEADS', 'MEMBER_OF')), "
    "rules AS (SELECT e.src AS node, n.node AS r, n.refs FROM e JOIN n ON n.node = e.dst WHERE n.rule AND e.type IN ('APPLIES_TO', 'CONTAINS', 'RELATED_TO') "
    "UNION SELECT e.dst, n.node, n.refs FROM e JOIN n ON n.node = e.src WHERE n.rule AND e.type IN ('APPLIES_TO', 'RELATED_TO')), "
    "via AS (SELECT rules.node, min(r) AS r FROM rules WHERE r IN (SELECT node FROM own) GROUP BY 1), "
    "checks AS (SELECT l.node, l.name, l.node IN (SELECT node FROM own) OR l.node IN (SELECT node FROM via) AS owner_path, l.node IN (SELECT node FROM rules) AS rule_path, "
    "l.refs > 0 OR EXISTS (SELECT 1 FROM e JOIN n ON n.node = e.dst WHERE e.src = l.node AND n.refs > 0) OR EXISTS (SELECT 1 FROM rules WHERE rules.node = l.node AND rules.refs > 0) "
    "OR (l.node NOT IN (SELECT node FROM own) AND EXISTS (SELECT 1 FROM via JOIN own ON own.node = via.r WHERE via.node = l.node AND own.refs > 0)) AS evidence FROM looked l) "
)


def part_checks(spark, d):
    focus, rule = F.col("category").isNotNull() | F.col("guess"), F.col("convention") | (F.col("type") == "process")
    refs = F.when(F.col("refs") > 6, F.col("refs")).otherwise(0)
    nodes = part_nodes(spark, d).select(F.col("node_id").alias("node"), "name", "type", focus.alias("focus"), rule.alias("rule"), refs.alias("refs"))
    kind = one_of(F.col("l_linenumber"), ["OWNED_BY", "USES", "LEADS", "USES", "APPLIES_TO", "CONTAINS", "RELATED_TO"])
    edges = t(spark, d, "lineitem").where("l_quantity < 5").select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst"), kind.alias("type"))
    return traversal_checks(nodes, edges)


@query(CHECKED + "SELECT * FROM checks")
def a17_traversal_checks(spark, d):
    return part_checks(spark, d)


@query(CHECKED + "SELECT count(*) AS checked, count(*) FILTER (WHERE owner_path) AS owner_path, count(*) FILTER (WHERE rule_path) AS rule_path, count(*) FILTER (WHERE evidence) AS evidence, count(*) FILTER (WHERE owner_path AND rule_path AND evidence) AS full_pass FROM checks")
def a17_traversal_rollup(spark, d):
    full = F.col("owner_path") & F.col("rule_path") & F.col("evidence")
    return part_checks(spark, d).agg(F.count("*").alias("checked"), *[F.count_if(c).alias(c) for c in ("owner_path", "rule_path", "evidence")], F.count_if(full).alias("full_pass"))


# ---------------------------------------------------------------- neighbours, undocumented work, built edges


def mentioned_neighbours(matched, edges, pages):
    """Of matched (check, node, name: null or one of the check's names) the nodes one edge off whose page (node, text)
    holds one of the check's names: (check, node), without those that are matched."""
    near = matched.select("check", "node").distinct().join(both_ways(edges).select("node", "other").distinct(), "node").select("check", F.col("other").alias("node")).distinct()
    near = near.join(matched.select("check", "node"), ["check", "node"], "left_anti")
    names = matched.where("name is not null").select("check", F.lower("name").alias("name")).distinct()
    read = near.join(pages.select("node", F.lower("text").alias("low")), "node").join(names, "check")
    return read.where(F.col("low").contains(F.col("name"))).select("check", "node").distinct()


@query(
    "WITH w AS (SELECT 'o' || l_orderkey AS node, 'p' || l_partkey AS other FROM lineitem UNION SELECT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem), "
    'm AS (SELECT l_orderkey AS "check", \'o\' || l_orderkey AS node, NULL AS name FROM lineitem UNION SELECT l_orderkey, \'p\' || l_partkey, lower(p_name) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1), '
    'nb AS (SELECT m."check", w.other AS node FROM m JOIN w USING (node) EXCEPT SELECT "check", node FROM m), pages AS (SELECT \'p\' || p_partkey AS node, lower(p_name || \' \' || p_type) AS low FROM part) '
    'SELECT nb."check", node FROM nb JOIN pages USING (node) WHERE EXISTS (SELECT 1 FROM m WHERE m."check" = nb."check" AND contains(low, m.name))'
)
def j13_neighbour_recheck(spark, d):
    """A check for each order: the parts of its first line are matched with it, and its other parts are looked at."""
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    order, part = F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("p"), "l_partkey")
    parts = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    first = lines.where("l_linenumber = 1").join(parts, "l_partkey").select(F.col("l_orderkey").alias("check"), part.alias("node"), F.col("p_name").alias("name"))
    matched = lines.select(F.col("l_orderkey").alias("check"), order.alias("node"), F.lit(None).cast("string").alias("name")).distinct().union(first)
    edges = lines.select(order.alias("src"), part.alias("dst"), F.lit("LINE").alias("type"))
    return mentioned_neighbours(matched, edges, parts.select(part.alias("node"), F.concat_ws(" ", "p_name", "p_type").alias("text")))


def undocumented(tickets, projects, titles):
    """Tickets (id, title, status) with a status, of whose work there is no project (name) and no page (id, title) whose title
    holds its name or has a token similarity over 0.5 with it: (id, project, category)."""
    name = F.trim(F.regexp_replace(F.regexp_replace("title", r"\s*\[.*?\]\s*", ""), r"\s*-\s*\d+$", ""))
    work = tickets.where("status is not null").select("id", "status", name.alias("project")).withColumn("k", F.lower("project"))
    open_ = work.join(projects.select(F.lower("name").alias("k")), "k", "left_anti")
    names = open_.select("k").distinct()
    low = titles.select(F.lower("title").alias("low")).distinct()
    held = holding(names, low).select("k")
    near = resolve_names(names.select(F.col("k").alias("ref")), titles.select("id", F.col("title").alias("name")), 0.5).select(F.col("ref").alias("k"))
    category = F.when(F.lower("status").isin("done", "closed", "resolved", "complete"), "past_undocumented").otherwise("ongoing_undocumented")
    return open_.join(held.union(near).distinct(), "k", "left_anti").select("id", "project", category.alias("category"))


@query(
    "WITH t AS (SELECT p_partkey AS id, p_name || ' ' || lower(p_type) AS project, CASE p_size % 4 WHEN 0 THEN 'Done' WHEN 1 THEN 'In Progress' WHEN 2 THEN 'Backlog' END AS status FROM part), "
    "titles AS (SELECT p_name || ' guide' AS t FROM part WHERE p_partkey % 101 = 2 UNION SELECT 'about the ' || p_name || ' ' || lower(p_type) || 's and their long story' FROM part WHERE p_partkey % 53 = 3), "
    "doc AS (SELECT DISTINCT project FROM (SELECT DISTINCT project FROM t) CROSS JOIN titles WHERE contains(titles.t, project) OR "
    "len(list_intersect(string_split(project, ' '), string_split(titles.t, ' '))) / greatest(len(list_distinct(string_split(project, ' '))), len(list_distinct(string_split(titles.t, ' ')))) > 0.5) "
    "SELECT id, project, CASE WHEN status = 'Done' THEN 'past_undocumented' ELSE 'ongoing_undocumented' END AS category FROM t WHERE status IS NOT NULL "
    "AND project NOT IN (SELECT p_name || ' ' || lower(p_type) FROM part WHERE p_partkey % 37 = 1) AND project NOT IN (SELECT project FROM doc)"
)
def v06_undocumented_anti_join(spark, d):
    p, size = t(spark, d, "part"), F.col("p_size")
    name = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    status = F.when(size % 4 == 0, "Done").when(size % 4 == 1, "In Progress").when(size % 4 == 2, "Backlog")
    tickets = p.select(F.col("p_partkey").alias("id"), F.concat(name, F.lit(" ["), "p_brand", F.lit("] - "), "p_size").alias("title"), status.alias("status"))
    titles = p.where("p_partkey % 101 = 2").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" guide")).alias("title"))
    titles = titles.union(p.where("p_partkey % 53 = 3").select(-F.col("p_partkey"), F.concat(F.lit("about the "), name, F.lit("s and their long story"))))
    return undocumented(tickets, p.where("p_partkey % 37 = 1").select(name.alias("name")), titles)


#: Attributes of a node that name another, by the node's type, and the edge that they make (fixed values).
NAMED_EDGES = [
    ("pull_request", "author", "BUILT_BY"),
    ("ticket", "assignee", "OWNED_BY"),
    ("project", "owner", "OWNED_BY"),
    ("process", "owner", "OWNED_BY"),
    ("decision", "scope", "RELATED_TO"),
    ("decision", "decided_by", "PROPOSED_BY"),
    ("customer_feedback", "requester", "FEEDBACK_FROM"),
]


def built_edges(nodes):
    """Edges (src, dst, type), each once and none to itself, of nodes (node, type, name, alias, attributes: map, relations:
    array of target and type).  A target is the least node of that name or alias, in lower case; unknown ones make no edge."""
    said = F.array(*[F.struct(F.when(F.col("type") == kind, F.col("attributes")[key]).alias("target"), F.lit(edge).alias("type")) for kind, key, edge in NAMED_EDGES])
    told = F.transform("relations", lambda r: F.struct(r.target.alias("target"), F.regexp_replace(F.upper(r.type), r"\s+", "_").alias("type")))
    wanted = nodes.select("node", F.explode(F.concat(said, F.coalesce(told, F.slice(said, 1, 0)))).alias("r")).select(F.col("node").alias("src"), F.lower(F.trim("r.target")).alias("k"), "r.type")
    first = nodes.select("node", F.explode(F.array("name", "alias")).alias("k")).groupBy(F.lower(F.trim("k")).alias("k")).agg(F.min("node").alias("dst"))
    return wanted.where("k <> '' and type <> ''").distinct().join(first, "k").where("src <> dst").select("src", "dst", "type").distinct()


@query(
    f"WITH {NODES}, n AS (SELECT node_id, type, p_name AS name, p_brand AS alias, CASE p_size % 4 WHEN 0 THEN p_brand WHEN 1 THEN upper(p_name) WHEN 2 THEN 'nobody' ELSE ' ' || p_name END AS t, p_size FROM nodes JOIN part ON p_partkey = node_id), "
    "w AS (SELECT node_id, t, CASE type WHEN 'pull_request' THEN 'BUILT_BY' WHEN 'ticket' THEN 'OWNED_BY' WHEN 'project' THEN 'OWNED_BY' WHEN 'process' THEN 'OWNED_BY' WHEN 'decision' THEN 'RELATED_TO' WHEN 'customer_feedback' THEN 'FEEDBACK_FROM' END AS e FROM n "
    "UNION ALL SELECT node_id, alias, 'PROPOSED_BY' FROM n WHERE type = 'decision' UNION ALL SELECT node_id, name, 'DEPENDS_ON' FROM n WHERE p_size % 3 = 0), "
    "k AS (SELECT k, min(node_id) AS dst FROM (SELECT lower(name) AS k, node_id FROM n UNION ALL SELECT lower(alias), node_id FROM n) GROUP BY k) "
    "SELECT DISTINCT node_id AS src, dst, e AS type FROM w JOIN k ON k.k = lower(trim(w.t)) WHERE e IS NOT NULL AND node_id <> dst"
)
def y08_graph_build(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("node_id"), "p_name", "p_brand", "p_size")
    i = F.col("p_size") % 4
    said = F.when(i == 0, F.col("p_brand")).when(i == 1, F.upper("p_name")).when(i == 2, "nobody").otherwise(F.concat(F.lit(" "), "p_name"))
    pairs = [v for key in ("author", "assignee", "owner", "scope", "requester") for v in (F.lit(key), said)]
    relation = F.struct(F.col("p_name").alias("target"), F.lit("depends  on").alias("type"))
    nodes = part_nodes(spark, d).select("node_id", "type").join(p, "node_id")
    return built_edges(nodes.select(F.col("node_id").alias("node"), "type", F.col("p_name").alias("name"), F.col("p_brand").alias("alias"), F.create_map(*pairs, F.lit("decided_by"), F.col("p_brand")).alias("attributes"), F.when(F.col("p_size") % 3 == 0, F.array(relation)).alias("relations")))


# ---------------------------------------------------------------- incremental ingest


@query(
    "WITH old AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'as it was' ELSE text END AS text FROM documents WHERE doc_id % 4 <> 0), "
    "c AS (SELECT d.* FROM documents d LEFT JOIN old ON old.doc_id = d.doc_id WHERE old.doc_id IS NULL OR old.text IS DISTINCT FROM d.text), "
    "f AS (SELECT DISTINCT ' ' || upper(source) AS name, coalesce(lang, '') AS type, CAST(n_chars // 4000 AS VARCHAR) AS attributes FROM c WHERE source <> ''), "
    "k AS (SELECT source AS name, min(coalesce(lang, '')) AS type, CAST(min(n_chars // 4000) AS VARCHAR) AS attributes FROM documents WHERE doc_id % 3 = 0 AND source <> 'src3' GROUP BY 1) "
    "SELECT f.name, f.type, f.attributes, CASE WHEN k.name IS NULL THEN 'new' WHEN k.type <> f.type THEN 'conflict' ELSE 'updated' END AS card, CASE WHEN k.type <> f.type THEN 'S2' ELSE 'S3' END AS severity "
    "FROM f LEFT JOIN k ON lower(trim(k.name)) = lower(trim(f.name)) WHERE k.name IS NULL OR k.type <> f.type OR k.attributes <> f.attributes"
)
def x01_incremental_ingest(spark, d):
    """Cards for what new or changed documents say of their sources; where a model would read them, a document's source,
    language and length are taken for an entity's name, type and attributes."""
    docs = t(spark, d, "documents").select("doc_id", "text", "source", F.coalesce("lang", F.lit("")).alias("type"), F.floor(F.col("n_chars") / 4000).alias("size"))
    old = docs.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "as it was").otherwise(F.col("text")).alias("text"))
    found = changed(old, docs).where("source <> ''").select(F.concat(F.lit(" "), F.upper("source")).alias("name"), "type", F.col("size").cast("string").alias("attributes"))
    known = docs.where("doc_id % 3 = 0 and source <> 'src3'").groupBy(F.col("source").alias("name")).agg(F.min("type").alias("type"), F.min("size").cast("string").alias("attributes"))
    return impact(found, known)


# ---------------------------------------------------------------- conventions for a project

#: Most conventions of a project, weight of one that nothing ties to it, and what is left of a weight after a hop (fixed values).
CONVENTIONS, FALLBACK, HOP = 6, 0.3, 0.7


def conventions(targets, edges, nodes, most: int = CONVENTIONS):
    """The conventions of most weight for each target (node): (node, rule, weight, provenance, place).

    What applies to it (APPLIES_TO edges of src, dst, type, weight) has the edge's weight; what applies to a node RELATED_TO it
    or that it CONTAINS, either way, HOP of the greatest such weight; any other convention of nodes (node, convention, refs)
    FALLBACK.  Ties go to more refs, then to the lesser node.

    Of what applies to a near node a target needs the first `most`, and as many more as apply to it directly.  One that has `most` above
    FALLBACK needs no other convention; as untied conventions differ by refs alone, the rest need the first `most` of them, and as
    many more as some target of these has ties of less weight."""
    targets = written(targets.select("node").distinct())
    known = nodes.select(F.col("node").alias("rule"), "refs", F.coalesce("convention", F.lit(False)).alias("convention"))
    applies = edges.where("type = 'APPLIES_TO'").groupBy(F.col("src").alias("rule"), F.col("dst").alias("node")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
    applies = written(applies.join(known, "rule"))
    direct = written(applies.join(targets, "node", "left_semi"))
    linked = edges.where("type in ('RELATED_TO', 'CONTAINS')")
    near = linked.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(linked.select("dst", "src")).join(targets, "node", "left_semi").distinct()
    near = written(near.join(applies.groupBy(F.col("node").alias("other")).agg(F.count("*").alias("n")), "other"))
    best = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("weight"), F.desc("refs"), "rule"))
    lists = applies.select(F.col("node").alias("other"), "rule", "weight", "refs", best("node").alias("r"))
    needed = near.join(direct.groupBy("node").agg(F.count("*").alias("own")), "node", "left")
    needed = needed.select("node", "other", F.explode(F.sequence(F.lit(1), F.least("n", F.coalesce("own", F.lit(0)) + most).cast("int"))).alias("r"))
    hop = needed.join(lists, ["other", "r"]).join(direct.select("node", "rule"), ["node", "rule"], "left_anti")
    hop = hop.groupBy("node", "rule", "refs").agg((F.max("weight") * HOP).alias("weight")).withColumn("r", best("node")).where(F.col("r") <= most)
    ties = direct.select("node", "rule", "weight", F.lit("direct").alias("provenance"), "refs")
    ties = written(ties.unionByName(hop.select("node", "rule", "weight", F.lit("one_hop").alias("provenance"), "refs")))
    full = ties.where(F.col("weight") > FALLBACK).groupBy("node").count().where(F.col("count") >= most)
    targets = written(targets.join(full, "node", "left_anti"))
    # All ties of the rest to conventions: what their list of untied ones leaves out.
    rules = applies.where("convention").select("rule", "node", "weight")
    by_hop = near.select("node", "other").join(targets, "node", "left_semi").join(rules.withColumnRenamed("node", "other"), "other").select("node", "rule", (F.col("weight") * HOP).alias("weight"))
    tied = written(rules.join(targets, "node", "left_semi").select("node", "rule", "weight").union(by_hop).groupBy("node", "rule").agg(F.max("weight").alias("weight")))
    own = tied.groupBy("node").agg(F.count("*").cast("int").alias("own"))
    longest = own.agg(F.max("own")).first()[0] or 0
    order = (F.desc("refs"), F.col("node"))
    first = nodes.where("convention").orderBy(*order).limit(most + longest).select("node", "refs", F.row_number().over(Window.orderBy(*order)).alias("r"))
    needed = targets.join(own, "node", "left").select("node", F.explode(F.sequence(F.lit(1), F.coalesce("own", F.lit(0)) + most)).alias("r"))
    untied = needed.join(first.select(F.col("node").alias("rule"), "refs", "r"), "r").drop("r").join(tied.select("node", "rule"), ["node", "rule"], "left_anti")
    rows = ties.unionByName(untied.select("node", "rule", F.lit(FALLBACK).alias("weight"), F.lit("global_fallback").alias("provenance"), "refs"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), F.desc("refs"), "rule"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("node", "rule", F.round("weight", 6).alias("weight"), "provenance", "place")


@query(
    f"WITH {NODES}, e AS (SELECT l_partkey AS src, l_orderkey AS dst, ['APPLIES_TO', 'RELATED_TO', 'CONTAINS', 'USES'][1 + l_linenumber % 4] AS type, "
    "max(CAST(CASE l_returnflag WHEN 'R' THEN 0.9 WHEN 'A' THEN 0.5 ELSE 0.2 END AS DOUBLE)) AS w FROM lineitem GROUP BY 1, 2, 3), "
    "tg AS (SELECT node_id AS node FROM nodes WHERE type = 'project'), direct AS (SELECT node, src AS rule, w FROM e JOIN tg ON dst = node WHERE type = 'APPLIES_TO'), "
    "ways AS (SELECT src AS node, dst AS other FROM e WHERE type IN ('RELATED_TO', 'CONTAINS') UNION SELECT dst, src FROM e WHERE type IN ('RELATED_TO', 'CONTAINS')), "
    "hop AS (SELECT node, src AS rule, max(w) * CAST(0.7 AS DOUBLE) AS w FROM tg JOIN ways USING (node) JOIN e ON e.dst = other AND type = 'APPLIES_TO' GROUP BY 1, 2), "
    "tied AS (SELECT *, 'direct' AS provenance FROM direct UNION ALL SELECT *, 'one_hop' FROM hop WHERE (node, rule) NOT IN (SELECT node, rule FROM direct)), "
    "both_ AS (SELECT * FROM tied UNION ALL SELECT node, node_id, CAST(0.3 AS DOUBLE), 'global_fallback' FROM tg CROSS JOIN nodes WHERE convention AND (node, node_id) NOT IN (SELECT node, rule FROM tied)), "
    "r AS (SELECT b.*, row_number() OVER (PARTITION BY node ORDER BY w DESC, refs DESC, rule) AS place FROM both_ b JOIN nodes ON node_id = rule) "
    "SELECT node, rule, round(w, 6) AS weight, provenance, CAST(place AS INTEGER) AS place FROM r WHERE place <= 6"
)
def y19_conventions(spark, d):
    """The conventions of the evidence pack of each project."""
    nodes = part_nodes(spark, d).select(F.col("node_id").alias("node"), "type", "convention", "refs")
    flag = F.col("l_returnflag")
    weight = F.when(flag == "R", 0.9).when(flag == "A", 0.5).otherwise(0.2)
    kind = one_of(F.col("l_linenumber"), ["APPLIES_TO", "RELATED_TO", "CONTAINS", "USES"])
    edges = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst"), kind.alias("type")).agg(F.max(weight).alias("weight"))
    return conventions(nodes.where("type = 'project'"), edges, nodes)
