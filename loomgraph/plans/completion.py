"""Attributes completed from evidence, and rules that repeated evidence makes."""

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators.survivorship import survivors
from ..registry import query
from ..sources.tables import table as t
from .audits import one_of, status_of
from .decisions import SQL_LIST, says, sql_says

# States that attributes may have, by type; states of tickets and changes; what pages say of a piece of work.
LEVELS = ["documented", "undocumented"]
STATES = {"project": ["active", "completed", "proposed"], "process": ["active", "deprecated", "proposed", "informal"]}
TICKET_DONE, TICKET_RUNNING, TICKET_WAITING = ["done", "closed", "resolved"], ["in progress", "in review", "active"], ["backlog", "to do", "open"]
CHANGE_DONE, CHANGE_RUNNING = ["merged", "closed"], ["open"]
PROPOSED = "future considerations|low priority for now"
ACTIVE = "status in progress|in progress|current phase|living document|ongoing"
COMPLETED = "status complete|status completed|completed|launched|is live|operational|scheduler triggers sync job every"
#: Votes of a reference for who made a thing: the author of a change counts twice.
VOTES = [("pr_author", 2), ("source_author", 1), ("assignee", 1), ("author", 1)]
#: Providers of each attribute, first ones first.
PROVIDERS = [
    ("description", "given", 1), ("description", "draft", 2),
    ("documentation_level", "given", 1), ("documentation_level", "sources", 2),
    ("status", "confluence", 1), ("status", "jira", 2), ("status", "github", 3), ("status", "given", 4),
    ("decided_by", "given", 1), ("decided_by", "references", 2),
]
#: Characters of a page's content that are read.
CONTENT = 4000


def completed(nodes, refs):
    """(node, attribute, value, provider, votes, action) of the attributes that each of nodes (node, type, name, description, draft,
    documentation_level, status, decided_by) should have, from refs (node, source, title, excerpt, content, ticket_status, change_state,
    pr_author, source_author, assignee, author).

    All have a description (given, else the draft) and a level of documentation (given, else by whether a page is cited); projects
    and processes a status, of which what pages say (projects only), else tickets, else changes (projects only) overrides what is given;
    decisions somebody who decided (given, else the name of most votes).  Action is confirmed, corrected, filled or, where nothing
    says anything, ask.  Given values that the type can't have are as none.  References of unknown nodes say nothing; repeated nodes count
    once."""
    n = nodes.where("node is not null").dropDuplicates(["node"])
    may = F.coalesce(*[F.when(F.col("type") == kind, F.col("status").isin(states)) for kind, states in STATES.items()], F.lit(False))
    given = {"description": F.col("description"), "documentation_level": F.when(F.col("documentation_level").isin(LEVELS), F.col("documentation_level")), "status": F.when(may, F.col("status")), "decided_by": F.col("decided_by")}
    due = {"description": F.lit(True), "documentation_level": F.lit(True), "status": F.col("type").isin(list(STATES)), "decided_by": F.col("type") == "decision"}
    wanted = n.select("node", "type", F.explode(F.array_compact(F.array(*[F.when(due[a], F.struct(F.lit(a).alias("attribute"), F.nullif(v, F.lit("")).alias("old"))) for a, v in given.items()]))).alias("w")).select("node", "type", "w.*")

    said = lambda more: x.loose(F.concat_ws("\n", "title", "excerpt", *more))
    page = F.col("source") == "confluence"
    near, far = said([]), said([F.substring("content", 1, CONTENT)])
    holds = lambda c, words: F.bool_or(page & c.rlike(says(words)))
    seen = refs.where("node is not null").groupBy("node").agg(
        F.bool_or(page).alias("cited"),
        *[holds(c, w).alias(f"{k}_{name}") for k, c in (("near", near), ("far", far)) for name, w in (("p", PROPOSED), ("a", ACTIVE), ("c", COMPLETED))],
        F.bool_or(page & x.loose(F.col("title")).rlike(says(PROPOSED))).alias("future"),
        status_of(F.when(F.col("source") == "jira", F.lower("ticket_status")), TICKET_DONE, TICKET_RUNNING, TICKET_WAITING).alias("jira"),
        status_of(F.when((F.col("source") == "github") & (F.col("change_state") != ""), F.lower("change_state")), CHANGE_DONE, CHANGE_RUNNING).alias("github"),
    )
    e = n.select("node", "type", "draft", x.loose(F.coalesce("name", F.lit(""))).rlike(says(PROPOSED)).alias("named")).join(seen, "node", "left")
    project = F.col("type") == "project"
    told = F.when(F.col("near_p"), "proposed").when(F.col("near_a"), "active").when(F.col("near_c"), "completed").when((F.col("future") | F.col("named")) & F.col("far_p"), "proposed")
    told = told.when(F.col("far_a"), "active").when(F.col("far_c"), "completed").when(F.col("far_p"), "proposed")
    level = F.when(F.col("cited"), "documented").otherwise("undocumented")
    one = lambda a, p, v: F.struct(F.lit(a).alias("attribute"), F.lit(p).alias("provider"), v.alias("value"), F.lit(1).cast("long").alias("weight"))
    facts = [one("description", "draft", F.col("draft")), one("documentation_level", "sources", level), one("status", "confluence", F.when(project, told)), one("status", "jira", F.col("jira")), one("status", "github", F.when(project, F.col("github")))]
    claims = e.select("node", F.explode(F.array(*facts)).alias("c")).select("node", "c.*")
    claims = claims.union(wanted.select("node", "attribute", F.lit("given"), "old", F.lit(1).cast("long")))
    person = lambda c: F.trim(F.regexp_replace(c, r"\s*\[[^\]]+\]\s*$", ""))
    votes = F.array(*[F.struct(person(F.col(c)).alias("value"), F.lit(w).cast("long").alias("weight")) for c, w in VOTES])
    by_refs = refs.where("node is not null").select("node", F.explode(votes).alias("v")).select("node", F.lit("decided_by").alias("attribute"), F.lit("references").alias("provider"), "v.value", "v.weight")
    found = survivors(claims.unionByName(by_refs), PROVIDERS)
    out = wanted.join(found, ["node", "attribute"], "left")
    action = F.when(F.col("value").isNull(), "ask").when(F.col("value") == F.col("old"), "confirmed").when(F.col("old").isNotNull(), "corrected").otherwise("filled")
    return out.select("node", "attribute", "value", "provider", "votes", action.alias("action"))


TYPES = ["project", "process", "decision", "ticket"]
SOURCES = ["jira", "github", "slack", "jira", "confluence", "github", "slack"]
EXCERPTS = ["All of it is in progress.", "A note.", "Launched in May", "No words", "Future considerations", "Another note", "See page 4", "more to come"]
CONTENTS = ["ongoing work", "it is completed", "", "low priority for now"]
OLD_STATES = ["active", "completed", "deprecated", "someday"]
TICKETS = ["Done", "Closed", "Backlog", "in review", "To do"]


@query(
    f"""WITH n AS (SELECT p_partkey AS node, {SQL_LIST(TYPES)}[1 + p_partkey % 4] AS type, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS description, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS draft,
  CASE p_partkey % 5 WHEN 0 THEN 'documented' WHEN 1 THEN 'unknown' END AS level, CASE WHEN p_partkey % 7 < 4 THEN {SQL_LIST(OLD_STATES)}[1 + p_partkey % 7] END AS status, CASE WHEN p_partkey % 8 = 2 THEN 'Ada' END AS decided FROM part),
r0 AS (SELECT l_partkey AS node, l_suppkey AS s, l_orderkey AS o, CAST(l_quantity AS BIGINT) AS q, {SQL_LIST(SOURCES)}[l_linenumber] AS source FROM lineitem WHERE l_linenumber <> 5 OR l_orderkey % 3 = 0),
r AS (SELECT node, s, source, {SQL_LIST(EXCERPTS)}[1 + q % 8] AS excerpt, {SQL_LIST(CONTENTS)}[1 + q % 4] AS content, {SQL_LIST(TICKETS)}[1 + node % 5] AS ticket, {SQL_LIST(["merged", "closed", "open", ""])}[1 + node % 4] AS change, q, o FROM r0),
k AS (SELECT *, trim(regexp_replace(lower('page ' || q || chr(10) || excerpt), '[^a-z0-9]+', ' ', 'g')) AS near, trim(regexp_replace(lower('page ' || q || chr(10) || excerpt || chr(10) || content), '[^a-z0-9]+', ' ', 'g')) AS far FROM r),
g AS (SELECT node, bool_or(source = 'confluence') AS cited, {", ".join(f"bool_or(source = 'confluence' AND {sql_says(c, w)}) AS {c}_{i}" for c in ("near", "far") for i, w in (("p", PROPOSED), ("a", ACTIVE), ("c", COMPLETED)))},
  CASE WHEN bool_and(lower(ticket) IN ('done', 'closed', 'resolved')) FILTER (WHERE source = 'jira') THEN 'completed' WHEN bool_or(lower(ticket) IN ('in progress', 'in review', 'active')) FILTER (WHERE source = 'jira') THEN 'active'
       WHEN bool_and(lower(ticket) IN ('backlog', 'to do', 'open')) FILTER (WHERE source = 'jira') THEN 'proposed' END AS jira,
  CASE WHEN bool_and(change IN ('merged', 'closed')) FILTER (WHERE source = 'github' AND change <> '') THEN 'completed' WHEN bool_or(change = 'open') FILTER (WHERE source = 'github') THEN 'active' END AS github FROM k GROUP BY node),
v AS (SELECT node, name, sum(w) AS votes FROM (SELECT node, 'Supplier ' || (s % 5) AS name, 2 AS w FROM r WHERE source = 'github' UNION ALL SELECT node, 'Supplier ' || (o % 5), 1 FROM r) GROUP BY ALL),
top AS (SELECT node, name, votes FROM v QUALIFY row_number() OVER (PARTITION BY node ORDER BY votes DESC, name) = 1),
e AS (SELECT n.*, g.* EXCLUDE (node), top.name AS maker, top.votes AS votes, CASE WHEN type = 'project' THEN CASE WHEN near_p THEN 'proposed' WHEN near_a THEN 'active' WHEN near_c THEN 'completed' WHEN far_a THEN 'active' WHEN far_c THEN 'completed' WHEN far_p THEN 'proposed' END END AS told,
  CASE WHEN (type = 'project' AND status IN ('active', 'completed', 'proposed')) OR (type = 'process' AND status IN ('active', 'deprecated', 'proposed', 'informal')) THEN status END AS old,
  CASE WHEN level = 'documented' THEN level END AS old_level FROM n LEFT JOIN g USING (node) LEFT JOIN top USING (node)),
a AS (SELECT node, 'description' AS attribute, description AS old, coalesce(description, draft) AS value, CASE WHEN description IS NOT NULL THEN 'given' WHEN draft IS NOT NULL THEN 'draft' END AS provider, 1 AS votes FROM e
  UNION ALL SELECT node, 'documentation_level', old_level, coalesce(old_level, CASE WHEN cited THEN 'documented' ELSE 'undocumented' END), CASE WHEN old_level IS NOT NULL THEN 'given' ELSE 'sources' END, 1 FROM e
  UNION ALL SELECT node, 'status', old, coalesce(told, jira, CASE WHEN type = 'project' THEN github END, old), CASE WHEN told IS NOT NULL THEN 'confluence' WHEN jira IS NOT NULL THEN 'jira' WHEN type = 'project' AND github IS NOT NULL THEN 'github' WHEN old IS NOT NULL THEN 'given' END, 1 FROM e WHERE type IN ('project', 'process')
  UNION ALL SELECT node, 'decided_by', decided, coalesce(decided, maker), CASE WHEN decided IS NOT NULL THEN 'given' WHEN maker IS NOT NULL THEN 'references' END, CASE WHEN decided IS NOT NULL THEN 1 ELSE votes END FROM e WHERE type = 'decision')
SELECT node, attribute, value, provider, CASE WHEN value IS NOT NULL THEN CAST(votes AS BIGINT) END AS votes, CASE WHEN value IS NULL THEN 'ask' WHEN value = old THEN 'confirmed' WHEN old IS NOT NULL THEN 'corrected' ELSE 'filled' END AS action FROM a"""
)
def y11_completion(spark, d):
    """Each part as a node, its order lines as references."""
    i, q = F.col("p_partkey"), F.col("l_quantity").cast("long")
    n = t(spark, d, "part").select(
        i.alias("node"), one_of(i, TYPES).alias("type"), F.col("p_name").alias("name"), F.when(i % 3 == 0, F.col("p_type")).alias("description"), F.when(i % 2 == 0, F.col("p_brand")).alias("draft"),
        F.when(i % 5 == 0, "documented").when(i % 5 == 1, "unknown").alias("documentation_level"), F.when(i % 7 < 4, one_of(i % 7, OLD_STATES)).alias("status"), F.when(i % 8 == 2, "Ada").alias("decided_by"),
    )
    lines = t(spark, d, "lineitem").where("l_linenumber <> 5 or l_orderkey % 3 = 0")
    source = one_of(F.col("l_linenumber") - 1, SOURCES)
    name = lambda c: F.concat(F.lit("Supplier "), (F.col(c) % 5).cast("string"), F.lit(" [bot]"))
    refs = lines.select(
        F.col("l_partkey").alias("node"), source.alias("source"), F.concat(F.lit("page "), q.cast("string")).alias("title"), one_of(q, EXCERPTS).alias("excerpt"), one_of(q, CONTENTS).alias("content"),
        one_of(F.col("l_partkey"), TICKETS).alias("ticket_status"), one_of(F.col("l_partkey"), ["merged", "closed", "open", ""]).alias("change_state"), F.when(source == "github", name("l_suppkey")).alias("pr_author"), F.lit(None).cast("string").alias("source_author"),
        name("l_orderkey").alias("assignee"), F.lit(None).cast("string").alias("author"),
    )
    return completed(n, refs)


# ---------------------------------------------------------------- rules of packs


def conventions(packs, decisions):
    """(pack, name, owner, level, constituents, sources, verdict) of packs (pack, title, owner, rule, confidence, refs: array of (source, title)).

    A pack makes a rule if it is sure (confidence high), has an owner that is known, and is called a convention or pattern; the
    others are rejected.  Constituents are the decisions (name, titles: array) that cite a title of the pack and share two words of four letters
    with the rule or the title, or have no more than two such words.  The level is undocumented without a page, documented with
    pages alone, else in part.  Titles are told apart as they are written; nulls are as empty."""
    none = F.expr("array()").cast("array<struct<source: string, title: string>>")
    p = packs.where("pack is not null").withColumn("refs", F.coalesce("refs", none))
    words = lambda c: F.array_distinct(F.filter(F.split(x.loose(F.coalesce(c, F.lit(""))), " "), lambda w: F.length(w) >= 4))
    every = lambda c: F.filter(F.split(x.loose(F.coalesce(c, F.lit(""))), " "), lambda w: F.length(w) >= 4)
    p = p.withColumn("w", words(F.concat_ws(" ", "rule", "title")))
    cites = p.select("pack", "w", F.explode(F.array_distinct(F.transform("refs", lambda r: r.title))).alias("title")).where("title <> ''")
    # Equal names of a title, and packs of equal words, meet once; names of a title come to each pack together.
    d = decisions.where("name <> ''").select("name", F.explode(F.array_distinct("titles")).alias("title")).distinct().withColumn("v", every(F.col("name")))
    met = cites.select("w", "title").distinct().join(d, "title").where((F.size("v") <= 2) | (F.size(F.filter("v", lambda w: F.array_contains("w", w))) >= 2))
    names = met.groupBy("w", "title").agg(F.collect_set("name").alias("names"))
    of_pack = cites.join(names, ["w", "title"]).groupBy("pack").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), "|").alias("constituents"))
    kinds = F.array_distinct(F.transform("refs", lambda r: r.source))
    page, other = F.array_contains(kinds, "confluence"), F.arrays_overlap(kinds, F.array(*map(F.lit, ["slack", "github", "jira"])))
    level = F.when(page & other, "partially_documented").when(page, "documented").otherwise("undocumented")
    owner = F.trim(F.coalesce("owner", F.lit("")))
    fits = (F.col("confidence") == "high") & (owner != "") & (F.lower(owner) != "unknown") & F.lower(F.coalesce("title", F.lit(""))).rlike("(convention|pattern)$")
    out = p.join(of_pack, "pack", "left")
    return out.select("pack", F.col("title").alias("name"), owner.alias("owner"), F.coalesce(level, F.lit("undocumented")).alias("level"), F.coalesce("constituents", F.lit("")).alias("constituents"), F.size("refs").cast("long").alias("sources"), F.when(fits, "created").otherwise("rejected").alias("verdict"))


PACK_TITLES = ["Button convention", "Layout pattern", "Notes on cards", "Colour Convention"]


@query(
    f"""WITH l AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity <= 3),
f AS (SELECT l_suppkey AS pack, list(DISTINCT ['confluence', 'jira', 'slack', 'github'][1 + (CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_partkey % 4 END)] || ':page ' || (l_partkey % 400)) AS refs FROM l GROUP BY 1),
p AS (SELECT s_suppkey AS pack, {SQL_LIST(PACK_TITLES)}[1 + s_suppkey % 4] AS name, CASE s_suppkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'Unknown' ELSE s_name END AS owner, CASE WHEN s_suppkey % 7 = 0 THEN 'medium' ELSE 'high' END AS confidence,
      ['small ring and shiny widget rule', 'cold valve or large panel always'][1 + s_suppkey % 2] AS rule, coalesce(refs, []) AS refs FROM supplier LEFT JOIN f ON pack = s_suppkey),
w AS (SELECT *, list_filter(string_split(trim(regexp_replace(lower(rule || ' ' || name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 4) AS w FROM p),
c AS (SELECT pack, w, unnest(list_distinct(list_transform(refs, lambda r: string_split(r, ':')[2]))) AS title FROM w),
d AS (SELECT p_name || CASE WHEN p_partkey % 2 = 0 THEN ' for large rooms' ELSE '' END AS name, 'page ' || (p_partkey % 400) AS title FROM part),
v AS (SELECT *, list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 4) AS v FROM d),
m AS (SELECT pack, string_agg(DISTINCT name, '|' ORDER BY name) AS constituents FROM c JOIN v USING (title) WHERE len(v) <= 2 OR len(list_filter(v, lambda x: list_contains(w, x))) >= 2 GROUP BY pack)
SELECT pack, name, trim(owner) AS owner, CASE WHEN len(list_filter(refs, lambda r: starts_with(r, 'confluence'))) = 0 THEN 'undocumented' WHEN len(list_filter(refs, lambda r: NOT starts_with(r, 'confluence'))) > 0 THEN 'partially_documented' ELSE 'documented' END AS level,
  coalesce(constituents, '') AS constituents, CAST(len(refs) AS BIGINT) AS sources, CASE WHEN confidence = 'high' AND trim(owner) <> '' AND lower(trim(owner)) <> 'unknown' AND regexp_matches(lower(name), '(convention|pattern)$') THEN 'created' ELSE 'rejected' END AS verdict
FROM w LEFT JOIN m USING (pack)"""
)
def y12_conventions(spark, d):
    """Each supplier as the owner of a pack whose evidence are its small order lines; parts as decisions."""
    s, part = F.col("s_suppkey"), F.col("l_partkey")
    source = one_of(F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(part % 4), ["confluence", "jira", "slack", "github"])
    title = lambda c: F.concat(F.lit("page "), (F.col(c) % 400).cast("string"))
    refs = t(spark, d, "lineitem").where("l_quantity <= 3").groupBy("l_suppkey").agg(F.collect_set(F.struct(source.alias("source"), title("l_partkey").alias("title"))).alias("refs"))
    owner = F.when(s % 5 == 0, " ").when(s % 5 == 1, "Unknown").otherwise(F.col("s_name"))
    packs = t(spark, d, "supplier").join(refs, s == F.col("l_suppkey"), "left").select(s.alias("pack"), one_of(s, PACK_TITLES).alias("title"), owner.alias("owner"), one_of(s, ["small ring and shiny widget rule", "cold valve or large panel always"]).alias("rule"), F.when(s % 7 == 0, "medium").otherwise("high").alias("confidence"), "refs")
    decisions = t(spark, d, "part").select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " for large rooms").otherwise("")).alias("name"), F.array(title("p_partkey")).alias("titles"))
    return conventions(packs, decisions)
