"""Which nodes are one and the same, and which rules: resolution from persons to status, and consolidation of rules."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators.clusters import constrained_components, growing_merges
from ..operators.graph import written
from ..operators.names import occurrences
from ..registry import query
from ..sources.tables import table as t
from .audits import one_of, status_of
from .decisions import says
from .joins import similar_names
from .steps import absorbed

#: Keys of tickets and changes; what a label is a project, a decision or a process by; words that tell no project from another;
#: words of a part of a project; the types that are told apart by their keys alone; suffixes of environments.
TICKET_KEY, CHANGE_KEY = "[A-Z]+-[0-9]+", r"(?:^|\s|/)([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+#[0-9]+)"
PROJECT_LABEL = "page|portal|browser|browse|tracking|calendar|chooser|navigation|comparison|feature|integration|pipeline|responsiveness|redesign|search"
DECISION_LABEL, PROCESS_LABEL = "chose|chosen|decision|alternative|option|pick|select", "workflow|pipeline|runbook|playbook|procedure|recurring|repeatable"
COMMON_WORDS = ["build", "create", "implement", "improvement", "improvements", "design", "layout", "card", "cards", "responsiveness", "frontend", "backend", "phase", "work", "works", "ui", "refresh", "rollout"]
PART_WORDS = ["improvement", "improvements", "design", "layout", "card", "cards", "responsiveness", "phase", "refresh", "rollout", "refactor"]
BY_KEY = ["ticket", "pull_request", "customer_feedback"]
ENVIRONMENT = r"[\s_-]+(prod|production|staging|stage|dev|development|test|qa|sandbox)$"
#: Least score of a pair that merges by itself, and of one to ask about; likeness of a name that holds another.
SURE, LEAST, HELD = 0.9, 0.68, 0.8
DONE, RUNNING = ["done", "closed", "resolved", "complete"], ["in progress", "in review", "doing"]


def persons(nodes, hints):
    """(id, into, name) of team members (id, name) that another stands for.  hints (name) are people's full names.

    One whose name is a hint's, or its first word alone, is that person; one with dots in the name is the one of the same name
    with spaces.  The one without dots stays, else the first by id; a hint that nobody is named as names the first of its own."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\.", " "), r"\s+", " "))
    n = nodes.where("name is not null").select("id", "name", plain(F.col("name")).alias("key"), F.col("name").contains(".").alias("dots"))
    h = hints.groupBy(plain(F.col("name")).alias("hint")).agg(F.min("name").alias("full"))
    first = h.groupBy(F.split("hint", " ")[0].alias("word")).agg(F.min("hint").alias("of_word"))
    met = n.join(h.select("hint", "full"), F.col("key") == F.col("hint"), "left").drop("hint")
    met = met.join(first, F.col("key") == F.col("word"), "left").drop("word")
    met = met.withColumn("person", F.when(F.col("full").isNotNull(), F.col("key")).otherwise(F.coalesce("of_word", "key"))).withColumn("hinted", F.col("full").isNotNull() | F.col("of_word").isNotNull())
    by_name = met.groupBy(F.col("key").alias("person")).agg(F.min(F.struct("dots", "id", "name")).alias("k"))
    lead = met.groupBy("person").agg(F.min("id").alias("least"))
    m = met.join(by_name, "person", "left").join(lead, "person").join(h.select(F.col("hint").alias("person"), F.col("full").alias("named")), "person", "left")
    into = F.coalesce("k.id", "least")
    m = m.where("hinted or dots").select("id", into.alias("into"), F.coalesce("named", "k.name", "name").alias("name"))
    return m.where("id <> into or name is not null")


def keyed(nodes):
    """(id, type, refs, key) of each key of a ticket or change in a node's name, aliases or titles of references."""
    said = F.concat_ws("\n", "name", F.array_join("aliases", "\n"), F.array_join("titles", "\n"))
    keys = F.array_union(F.regexp_extract_all(said, F.lit(TICKET_KEY), F.lit(0)), F.regexp_extract_all(said, F.lit(CHANGE_KEY), F.lit(1)))
    return nodes.select("id", "type", "n_refs", F.explode(F.array_distinct(keys)).alias("key"))


def identities(keys):
    """(id, into) of tickets and changes by their keys: in the order of keys' first nodes, all of a key that are still there go to the
    one of most references (ties: the first).  A key is done once it is the first open one of all its nodes."""
    own = keys.where("(type = 'ticket' and not key like '%#%') or (type = 'pull_request' and key like '%#%')").select("id", "n_refs", "key")
    order = own.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", F.struct("lead", "key").alias("at"))
    open_ = written(own.join(order, "key"))
    spark, out = keys.sparkSession, None
    while not open_.isEmpty():
        first = open_.groupBy("id").agg(F.min("at").alias("first"))
        ready = open_.join(first, "id").groupBy("key").agg(F.bool_and(F.col("at") == F.col("first")).alias("ok")).where("ok").select("key")
        now = open_.join(ready, "key")
        keep = now.groupBy("key").agg(F.min(F.struct((-F.col("n_refs")).alias("r"), "id")).alias("k")).select("key", F.col("k.id").alias("into"))
        gone = written(now.join(keep, "key").where("id <> into").select("id", "into"))
        out = gone if out is None else out.union(gone)
        open_ = written(open_.join(ready, "key", "left_anti").join(gone.select("id"), "id", "left_anti"))
    return out if out is not None else spark.createDataFrame([], "id long, into long")


def likely_pairs(nodes, keys, least: float = LEAST):
    """(a, b, score, why) of live nodes of one type, the best reason of each pair: names or aliases in common, one base of cloud
    resources, keys in common; and unless they go by their keys: projects by words and titles in common, names that hold one another or
    whose words are alike.  `why` of related scopes is 'scope'; these have no score.

    A higher `least` gives the pairs of that score alone, without scopes, and looks for no others: those of a likely score are many times more."""
    none = F.expr("array()").cast("array<string>")
    n = nodes.withColumn("low", F.lower(F.trim("name"))).withColumn("aliases", F.coalesce("aliases", none)).withColumn("titles", F.coalesce("titles", none))
    called = n.select("id", "type", F.explode(F.array_distinct(F.concat(F.array("low"), F.transform("aliases", lambda a: F.lower(F.trim(a)))))).alias("k")).where("k <> ''")

    def meet(rows, score, why):
        """A group's nodes meet its first one; that links them all."""
        lead = rows.groupBy("type", "k").agg(F.min("id").alias("a"))
        return rows.join(lead, ["type", "k"]).where("a <> id").select("a", F.col("id").alias("b"), F.lit(score).alias("score"), F.lit(why).alias("why"))

    out = meet(called, 1.0, "alias")
    base = F.trim(F.regexp_replace("low", ENVIRONMENT, ""))
    out = out.union(meet(n.where("type = 'cloud_resource'").select("id", "type", base.alias("k")).where("k <> ''"), 1.0, "base"))
    out = out.union(meet(keys.select("id", "type", F.col("key").alias("k")), 0.95, "key"))

    # Projects meet at the first two words they share; at a word and a title only for what is less than SURE, as that asks for two words.
    words = F.array_distinct(F.transform(F.filter(F.split(x.loose(F.concat_ws(" ", "name", F.array_join("aliases", " "))), " "), lambda w: (F.length(w) >= 3) & ~w.isin(COMMON_WORDS)), lambda w: x.singular(w)))
    parts = x.loose(F.col("name")).rlike(says("|".join(PART_WORDS)))
    titles = F.array_distinct(F.transform("titles", lambda s: x.loose(s)))
    p = written(n.where("type = 'project'").select("id", F.array_sort(words).alias("w"), titles.alias("s"), parts.alias("part")))
    two = lambda a, b: F.concat_ws(" ", a, b)
    twos = F.flatten(F.transform("w", lambda a: F.transform(F.filter("w", lambda b: b > a), lambda b: two(a, b))))
    at = p.select("id", "w", F.explode(twos).alias("at"))
    both = F.array_intersect("wa", "wb")
    met = at.toDF("a", "wa", "at").join(at.toDF("b", "wb", "at"), "at").where((F.col("a") < F.col("b")) & (F.col("at") == two(F.get(both, F.lit(0)), F.get(both, F.lit(1))))).select("a", "b")
    if least < SURE:
        mixed = F.flatten(F.transform("w", lambda a: F.transform("s", lambda b: F.concat_ws("|", a, b))))
        at = p.select("id", F.explode(mixed).alias("at"))
        met = met.union(at.toDF("a", "at").join(at.toDF("b", "at"), "at").where("a < b").select("a", "b")).distinct()
    ends = lambda df, how: df.join(p.toDF("a", "wa", "sa", "pa"), "a", how).join(p.toDF("b", "wb", "sb", "pb"), "b", how).withColumn("shared", F.size(both)).withColumn("anchors", F.size(F.array_intersect("sa", "sb")))
    part, differ = F.col("pa") | F.col("pb"), (F.size("wa") > F.col("shared")) | (F.size("wb") > F.col("shared"))
    score = F.when((F.col("shared") >= 2) & (F.col("anchors") > 0), 0.96).when(F.col("shared") >= 3, 0.9).when((F.col("shared") >= 2) & part, 0.82).when((F.col("anchors") >= 2) & (F.col("shared") >= 1), 0.8)
    scope = part & differ & ((F.col("shared") >= 2) | ((F.col("shared") >= 1) & (F.col("anchors") > 0)))
    family = ends(met, "inner").select("a", "b", F.when(~scope, score).alias("score"), F.when(scope, "scope").otherwise("family").alias("why")).where("why = 'scope' or score is not null")

    loose = n.where(~F.col("type").isin(BY_KEY)).select("id", "type", "low")
    out = out.union(similar_names(loose.select("type", "id", F.col("low").alias("name")), "type", least).select("a", "b", F.col("sim").alias("score"), F.lit("words").alias("why")))
    if least <= HELD:
        first = loose.groupBy("type", "low").agg(F.min("id").alias("id"))
        held = occurrences(first.select("id", F.col("low").alias("text")), first.where("length(low) >= 3").select(F.col("low").alias("name")))
        held = held.join(first.select("id", "type"), "id").join(first.select(F.col("id").alias("other"), "type", F.col("low").alias("name")), ["type", "name"]).where("id <> other")
        out = out.union(held.select("id", "other", F.lit(HELD).alias("score"), F.lit("held").alias("why")))
    if least > LEAST:
        # Scopes that meet by another likeness are told by the projects themselves, so the others need not be found.
        out = ends(out.where(F.col("score") >= least), "left").where(~F.coalesce(scope, F.lit(False))).select("a", "b", "score", "why")
        family = family.where(F.col("score") >= least)
    out = out.union(family)
    # A scope says more than any likeness; else the best score counts.
    order = F.struct((F.col("why") != "scope").alias("o"), (-F.col("score")).alias("s"), "why")
    best = out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", "why").groupBy("a", "b").agg(F.min(order).alias("m"))
    return best.select("a", "b", (-F.col("m.s")).alias("score"), F.col("m.why").alias("why"))


def resolved(nodes, hints, tickets):
    """What becomes of each of nodes (id, name, type, aliases, titles, n_refs, documented, timeline): (id, into, phase, type, status, aliases).

    In this order: persons (`persons`), tickets and changes by their keys (`identities`), projects that others have absorbed (the ones not
    `documented` go to those that are), then pairs of SURE or more, surest first, merged unless the clusters have different keys
    (their least one: a constraint, whatever the likeness).  A cluster's node is that of most references, ties by id.  Then
    types by label, keys and time line, and the status of projects and processes by that of their tickets (key, status).  `phase` is
    where a node went; of a survivor it is null.  Null names are like nothing; repeated ids count once; empty tables give no rows."""
    n = nodes.where("id is not null").dropDuplicates(["id"])
    n = written(n.select("id", "name", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("aliases", F.expr("array()").cast("array<string>")).alias("aliases"), F.coalesce("titles", F.expr("array()").cast("array<string>")).alias("titles"), F.coalesce("n_refs", F.lit(0)).cast("long").alias("n_refs"), F.coalesce("documented", F.lit(False)).alias("documented"), F.coalesce("timeline", F.lit(False)).alias("timeline")))
    keys = written(keyed(n))
    own = written(persons(n.where("type = 'team_member'").select("id", "name"), hints))
    moves = own.where("id <> into").select("id", "into", F.lit("person").alias("phase"))
    moves = moves.union(identities(keys).withColumn("phase", F.lit("identity")))
    projects = n.where("type = 'project' and name is not null").select("id", "name", F.col("n_refs").alias("refs"), (~F.col("documented")).alias("weak"))
    moves = written(moves.union(absorbed(projects).where("id <> into").select("id", "into", F.lit("project").alias("phase"))))

    def chased(moves, hops):
        """Each node with the last one of its chain."""
        out = moves.select("id", "into", "phase")
        for _ in range(hops):
            out = out.join(moves.select(F.col("id").alias("into"), F.col("into").alias("far")), "into", "left").select("id", F.coalesce("far", "into").alias("into"), "phase")
        return written(out)

    # What survivors have taken over is theirs: names, titles, references and keys.  Of the first three phases none follows another twice.
    early = chased(moves, 2)
    place = early.select("id", "into").union(n.join(early, "id", "left_anti").select("id", F.col("id").alias("into")))
    taken = place.join(n, "id").groupBy("into").agg(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("id") == F.col("into"), F.col("aliases")).otherwise(F.array_compact(F.concat(F.array("name"), "aliases")))))).alias("aliases"), F.array_distinct(F.flatten(F.collect_set("titles"))).alias("titles"), F.sum("n_refs").alias("n_refs"))
    live = written(n.select("id", "name", "type").join(taken.withColumnRenamed("into", "id"), "id"))
    node_keys, keys = keys, written(keys.join(place, "id").join(live.select(F.col("id").alias("into"), F.col("type").alias("kind")), "into").select(F.col("into").alias("id"), F.col("kind").alias("type"), "key").distinct())
    pairs = likely_pairs(live, keys, SURE)
    marks = keys.groupBy(F.col("id").alias("node")).agg(F.min("key").alias("mark"))
    sure = pairs.select("a", "b", (-F.col("score")).alias("rank"))
    cluster = written(constrained_components(sure, marks))
    keep = cluster.join(live.select(F.col("id").alias("node"), "n_refs"), "node").groupBy("component").agg(F.min(F.struct((-F.col("n_refs")).alias("r"), "node")).alias("k"))
    late = cluster.join(keep, "component").where("node <> k.node").select(F.col("node").alias("id"), F.col("k.node").alias("into"), F.lit("cluster").alias("phase"))
    all_moves = written(moves.union(late))

    final = chased(all_moves, 3)

    names = n.join(own.groupBy("id").agg(F.min("name").alias("full")), "id", "left").withColumn("name", F.coalesce("full", "name")).drop("full")
    held = final.select("id", "into").union(n.join(final, "id", "left_anti").select("id", F.col("id").alias("into")))
    said = held.join(n.select("id", "name", "aliases", "titles", "n_refs"), "id").groupBy("into").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.concat(F.array("name"), "aliases")))))).alias("called"), F.sum("n_refs").alias("evidence"), F.bool_or(F.size("titles") > 0).alias("cited"))
    counted = held.join(node_keys.select("id", "key"), "id").groupBy("into").agg(F.count_distinct("key").alias("n_keys"), F.collect_set("key").alias("keys"))
    s = names.withColumnRenamed("id", "into").join(said, "into").join(counted, "into", "left").withColumn("n_keys", F.coalesce("n_keys", F.lit(0)))
    label, node_type = F.lower(F.coalesce("name", F.lit(""))), F.col("type")
    shaped, backed = label.rlike(says(PROJECT_LABEL)), (F.col("n_keys") > 0) | F.col("documented")
    timed = (F.col("n_keys") > 0) & F.col("timeline") & (node_type != "project")
    to = F.when(timed, F.when(shaped & (F.col("evidence") + F.col("n_keys") >= 2), "project").otherwise(node_type)).when((node_type != "decision") & label.rlike(says(DECISION_LABEL)), "decision")
    to = to.when((node_type != "process") & label.rlike(says(PROCESS_LABEL)) & ~(shaped & backed), "process").otherwise(node_type)
    of_ticket = s.select("into", F.explode("keys").alias("key")).join(tickets.where("key is not null"), "key")
    status = of_ticket.groupBy("into").agg(status_of(F.lower("status"), DONE, RUNNING).alias("status"))
    s = s.join(status, "into", "left").withColumn("new", to)
    aliases = F.array_join(F.filter("called", lambda c: F.lower(c) != F.lower(F.col("name"))), "|")
    kept = s.select(F.col("into").alias("id"), F.col("new").alias("type"), F.when(F.col("new").isin("project", "process"), F.col("status")).alias("status"), F.coalesce(aliases, F.lit("")).alias("aliases"))
    lost = final.join(n.select("id", "type"), "id").select("id", "into", "phase", "type", F.lit(None).cast("string").alias("status"), F.lit("").alias("aliases"))
    return kept.join(final.select("id"), "id", "left_anti").select("id", F.col("id").alias("into"), F.lit(None).cast("string").alias("phase"), "type", "status", "aliases").union(lost)


NODE_TYPES = ["project", "ticket", "team_member", "pull_request", "decision", "cloud_resource", "project", "process"]


def _nodes(spark, d):
    """Each part as a node: its name as a type of node would have it, keys of every ninety-seventh, titles of its brand and size."""
    i, name = F.col("p_partkey"), F.col("p_name")
    kind = one_of(i, NODE_TYPES)
    word = F.split("p_name", " ")
    key, change = F.concat(F.lit("PAY-"), i % 97), F.concat(F.lit("acme/web#"), i % 89)
    person = F.when(i % 3 == 0, F.regexp_replace("p_name", " ", ".")).when(i % 3 == 1, name).otherwise(word[0])
    label = F.when(kind == "ticket", F.concat(key, F.lit(": "), name)).when(kind == "pull_request", F.concat(name, F.lit(" "), change)).when(kind == "team_member", person)
    label = label.when(kind == "cloud_resource", F.concat(name, F.lit("-"), one_of(F.floor(i / 8), ["prod", "dev", "blue"]))).when(i % 5 == 0, F.concat(name, F.lit(" "), F.lower("p_type"), F.lit(" phase "), i % 4)).otherwise(F.concat(name, F.lit(" "), F.lower("p_type"), F.lit(" "), F.regexp_replace(F.lower("p_brand"), "#", "")))
    titles = F.array_compact(F.array(F.concat(F.lit("doc "), "p_brand", F.lit(" "), "p_size"), F.when(i % 6 == 0, F.concat(key, F.lit(" notes")))))
    aliases = F.when(i % 9 == 0, F.array(F.concat(word[1], F.lit(" of "), "p_brand", F.lit(" "), F.col("p_size").cast("string"))))
    return t(spark, d, "part").select(i.alias("id"), label.alias("name"), kind.alias("type"), aliases.alias("aliases"), titles.alias("titles"), (F.col("p_size") % 6).alias("n_refs"), (i % 4 == 0).alias("documented"), (i % 7 == 0).alias("timeline"))


@query()
def y07_resolution(spark, d):
    nodes = _nodes(spark, d)
    hints = t(spark, d, "part").where("p_partkey % 50 = 2").select(F.col("p_name").alias("name")).distinct()
    o = F.col("o_orderkey")
    tickets = t(spark, d, "orders").select(F.concat(F.lit("PAY-"), o % 97).alias("key"), one_of(F.floor(o / 97), ["Done", "In Progress", "To Do", "Closed"]).alias("status")).distinct()
    return resolved(nodes, hints, tickets)


# ---------------------------------------------------------------- consolidation of rules


def consolidated(rules, least: float = 0.4):
    """(id, owner, rule, merged, n_decisions, n_documents) of the rules left of rules (id, owner, rule, decisions, documents: arrays): each,
    by id, takes over every later one of its owner whose rule is `least` alike in tokens and that shares a decision or
    document with it, or with what it has taken over.  Owners, decisions and documents are told apart by their trimmed lower case;
    null ids go, rules without words are like none."""
    low = lambda c: F.lower(F.trim(c))
    none = F.expr("array()").cast("array<string>")
    r = rules.where("id is not null").dropDuplicates(["id"]).select("id", "owner", "rule", low(F.coalesce("owner", F.lit(""))).alias("of"), F.coalesce("decisions", none).alias("decisions"), F.coalesce("documents", none).alias("documents"))
    r = written(r.withColumn("w", F.array_sort(x.tokens(F.col("rule")))))
    # Equal rules of an owner are one class, known by its first; classes meet at their words, rows at evidence of their owner (its first class).
    classes = r.where("size(w) > 0").groupBy("of", "w").agg(F.min("id").alias("c"))
    classes = written(classes.join(classes.groupBy("of").agg(F.min("c").alias("o")), "of"))
    at = classes.select("c", "of", "w", F.explode("w").alias("token"))
    met = at.toDF("a", "of", "wa", "token").join(at.toDF("b", "of", "wb", "token"), ["of", "token"]).where("a < b and token = array_min(array_intersect(wa, wb))")
    pairs = met.where(x.token_similarity(F.col("wa"), F.col("wb")) >= least).select("a", "b")
    kinds = F.concat(F.transform("decisions", lambda d: F.concat(F.lit("d:"), low(d))), F.transform("documents", lambda d: F.concat(F.lit("s:"), low(d))))
    said = r.join(classes, ["of", "w"]).select("id", "c", "o", F.explode(F.array_distinct(kinds)).alias("s"))
    numbers = written(said.select("s").where("s is not null").distinct().select("s", F.monotonically_increasing_id().alias("number")))
    into = growing_merges(pairs, said.join(numbers, "s").select("id", F.struct("o", "number").alias("e"), "c"))
    m = r.join(into, "id", "left").withColumn("into", F.coalesce("into", "id"))
    merged = m.groupBy("into").agg(F.array_sort(F.collect_list(F.when(F.col("id") != F.col("into"), F.col("id")))).alias("merged"))
    # Null is one of its kind.
    each = lambda c: m.select("into", F.explode(c).alias("d")).distinct().groupBy("into").agg(F.count("*").cast("int").alias(f"n_{c}"))
    sums = merged.join(each("decisions"), "into", "left").join(each("documents"), "into", "left").na.fill(0, ["n_decisions", "n_documents"])
    return r.select("id", "owner", "rule").join(sums, F.col("id") == F.col("into")).drop("into")


@query()
def v04_consolidation(spark, d):
    """Each part as a rule of its brand: the suppliers of its order lines as decisions, its size as the document."""
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("owner"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("rule"), F.array(F.concat(F.lit("doc "), "p_size")).alias("documents"))
    lines = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set("l_suppkey").alias("suppliers"))
    lines = lines.select("id", F.transform("suppliers", lambda s: F.concat(F.lit("supplier "), s)).alias("decisions"))
    out = consolidated(p.join(lines, "id", "left"))
    return out.withColumn("merged", F.array_join(F.transform("merged", lambda i: i.cast("string")), "|"))
