"""Evidence packs of projects: what was built alike before, what users said, what is missing, and how well the pack is backed."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators.graph import written
from ..registry import query
from ..sources.tables import table as t
from .audits import conventions
from .audits import one_of
from .steps import NODES, part_nodes

# What words of a screen go with; types that can be built alike and what they add; words that tell of a database.
CONCEPTS = {
    "browse": ["card", "grid", "list", "filter", "search", "catalog", "gallery", "profile", "lazy", "skeleton"],
    "card": ["grid", "profile", "image", "photo", "browse", "responsive", "memo", "callback"],
    "donation": ["payment", "checkout", "form", "financial", "purchase", "order", "donate", "sponsor"],
    "payment": ["form", "checkout", "financial", "donation", "credit", "receipt"],
    "form": ["input", "field", "submit", "validation", "column", "contact", "registration"],
    "select": ["choose", "picker", "selector", "sidebar", "navigation", "chooser", "vertical", "category"],
    "pet": ["animal", "profile", "species", "shelter", "adoption", "browse", "card"],
    "adoption": ["pet", "chooser", "selection", "browse", "profile"],
    "toy": ["donation", "browse", "card", "selection", "category", "purchase"],
}
BONUS, DATABASE = {"project": 3, "pull_request": 2, "decision": 1}, "database|schema|migration|model"
#: Precedents and pieces of feedback of a pack; least words in common of one that no edge leads to; letters of a word.
PRECEDENTS, FEEDBACK, LEAST, LETTERS = 8, 4, 2, 4


def long_words(c):
    return F.filter(F.split(x.loose(c), " "), lambda w: F.length(w) >= LETTERS)


def word_scores(wanted, pages):
    """(node, page, words): of targets (node, w) and pages (page, text) how many words of the page (repeats count) are, begin or continue one of
    the target's; pairs without any have no row.  Words meet at their first letters, each once for all pages and targets."""
    held = pages.select("page", F.explode(long_words(F.col("text"))).alias("v")).groupBy("page", "v").agg(F.count("*").alias("n"))
    begin = lambda c: F.substring(c, 1, LETTERS)
    said, asked = held.select("v").distinct().withColumn("b", begin("v")), wanted.select("w").distinct().withColumn("b", begin("w"))
    near = said.join(asked, "b").where(F.startswith("v", "w") | F.startswith("w", "v")).select("v", "w")
    return wanted.join(near, "w").select("node", "v").distinct().join(held, "v").groupBy("node", "page").agg(F.sum("n").alias("words"))


def expanded(text):
    low = F.lower(text)
    return F.concat_ws(" ", text, *[F.when(F.contains(low, F.lit(k)), " ".join(v)) for k, v in CONCEPTS.items()])


def best_alike(targets, pages, taken, score, most):
    """(node, page, s) of targets (node, text): the `most` best of pages (page, text, bonus) by `score` of the words in common and the bonus (null:
    never), ties by id, without its own ones of taken (node, page).

    Equal texts are compared once, whatever the number of their targets and pages.  A text's list of pages is as long as the target
    that has the most taken needs it, and each target reads the head of it that it needs itself."""
    key = lambda c: F.md5(F.coalesce(c, F.lit("")))
    needed = targets.select("node", "text").join(taken.groupBy("node").agg(F.count("*").alias("own")), "node", "left")
    needed = written(needed.select("node", "text", key("text").alias("t"), (F.coalesce("own", F.lit(0)) + most).alias("need")))
    texts = needed.groupBy("t").agg(F.min("text").alias("text"), F.max("need").alias("need"))
    wanted = texts.select(F.col("t").alias("node"), F.explode(F.array_distinct(long_words(F.col("text")))).alias("w"))
    p = written(pages.select("page", "text", "bonus", key("text").alias("k")))
    said = p.groupBy("k").agg(F.min("text").alias("text")).select(F.col("k").alias("page"), "text")
    met = word_scores(wanted, said).select(F.col("node").alias("t"), F.col("page").alias("k"), "words")
    kinds = met.join(p.select("k", "bonus").distinct(), "k").withColumn("s", score).where("s is not null").join(texts.select("t", "need"), "t")
    # No text needs more pages of a kind than the longest list has.
    longest = kinds.groupBy("k", "bonus").agg(F.max("need").alias("longest"))
    nth = lambda by, *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = p.select("page", "k", "bonus", nth(("k", "bonus"), "page").alias("r")).join(longest, ["k", "bonus"]).where("r <= longest")
    lists = kinds.select("t", "k", "bonus", "s", "need").join(rows.select("page", "k", "bonus", "r"), ["k", "bonus"]).where("r <= need")
    lists = lists.select("t", "page", "s", "need", nth(("t",), F.desc("s"), "page").alias("r")).where("r <= need").select("t", "page", "s", "r")
    met = needed.select("node", "t", F.explode(F.sequence(F.lit(1), F.col("need").cast("int"))).alias("r")).join(lists, ["t", "r"])
    free = met.select("node", "page", "s").join(taken.select("node", "page"), ["node", "page"], "left_anti")
    return free.withColumn("r", nth(("node",), F.desc("s"), "page")).where(F.col("r") <= most).drop("r")


def beside(targets, edges, *more):
    """(node, page, *more) of what edges (src, dst) lead to from targets (node), either way."""
    ways = edges.select(F.col("src").alias("node"), F.col("dst").alias("page"), *more).union(edges.select("dst", "src", *more))
    return ways.join(targets.select("node").distinct(), "node", "left_semi")


def tied_scores(tied, targets, pages):
    """(node, page, words) of pairs (node, page): the words in common, as in `word_scores`; equal texts count once."""
    key = lambda c: F.md5(F.coalesce(c, F.lit("")))
    asked, said = targets.select("node", "text", key("text").alias("t")), pages.select("page", "text", key("text").alias("k"))
    wanted = asked.groupBy("t").agg(F.min("text").alias("text")).select(F.col("t").alias("node"), F.explode(F.array_distinct(long_words(F.col("text")))).alias("w"))
    words = word_scores(wanted, said.groupBy("k").agg(F.min("text").alias("text")).select(F.col("k").alias("page"), "text"))
    met = tied.join(asked.select("node", "t"), "node").join(said.select("page", "k"), "page")
    return met.join(words.select(F.col("node").alias("t"), F.col("page").alias("k"), "words"), ["t", "k"], "left").drop("t", "k")


def precedents(targets, nodes, edges, pages):
    """(node, precedent, score, place) of targets (node, text): the PRECEDENTS best of nodes (node, type, name, proposed, convention) with a page
    (page, text), by words in common with the page, the weight of an edge between, and type; ties by id.

    With an edge projects, changes and decisions that are no rule count, without one projects and changes of LEAST words in common.
    Proposed ones were never built."""
    targets = written(targets.groupBy("node").agg(F.concat_ws(" ", F.collect_list(expanded(F.col("text")))).alias("text")))
    bonus = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in BONUS.items()])
    built = nodes.where(F.col("type").isin(list(BONUS)) & ~F.coalesce("proposed", F.lit(False))).select(F.col("node").alias("page"), "type", bonus.alias("bonus"), F.coalesce("convention", F.lit(False)).alias("convention"))
    known = written(built.join(pages.groupBy("page").agg(F.concat_ws(" ", F.collect_list("text")).alias("text")), "page"))
    tied = beside(targets, edges, "weight").groupBy("node", "page").agg(F.max("weight").alias("weight")).where("weight is not null and node <> page")
    # A rule, or a decision without an edge, is none; a rule that an edge leads to is not looked at again.
    tied = written(tied.join(known.where("not convention").select("page", "bonus"), "page"))
    n = F.coalesce("words", F.lit(0))
    by_edge = tied_scores(tied, targets, known).select("node", "page", (n * 2 + F.col("weight") * 3 + F.col("bonus")).alias("s"))
    open_ = known.where("type <> 'decision'").select("page", "text", "bonus")
    free = best_alike(targets, open_, tied.select("node", "page").union(targets.select("node", "node")), F.when(F.col("words") >= LEAST, F.col("words") * 2.0 + F.col("bonus")), PRECEDENTS)
    both = by_edge.union(free).withColumn("score", F.round("s", 6))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "page"))
    return both.withColumn("place", place).where(F.col("place") <= PRECEDENTS).select("node", F.col("page").alias("precedent"), "score", "place")


def feedback(targets, nodes, edges):
    """(node, item, direct, place) of targets (node, text): FEEDBACK pieces of nodes (node, type, name, said) of customers, those with an edge
    first, then those with a word in common, each by id."""
    pieces = nodes.where("type = 'customer_feedback' and said <> ''").select(F.col("node").alias("page"), F.concat_ws(" ", "name", "said").alias("text"))
    direct = written(beside(targets, edges).distinct().join(pieces.select("page"), "page", "left_semi").withColumn("direct", F.lit(True)))
    targets = targets.groupBy("node").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    alike = best_alike(targets, pieces.withColumn("bonus", F.lit(0)), direct, F.lit(0), FEEDBACK).select("node", "page").withColumn("direct", F.lit(False))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("direct"), "page"))
    return direct.select("node", "page", "direct").union(alike).withColumn("place", place).where(F.col("place") <= FEEDBACK).select("node", F.col("page").alias("item"), "direct", "place")


def packs(targets, nodes, edges, pages):
    """A row of each target (node, text, proposed): its precedents and feedback by place, the gaps, and figures of what backs it.

    Nodes are (node, type, name, said, proposed, convention, refs), edges (src, dst, type, weight), pages (page, text)."""
    rules = written(conventions(targets, edges, nodes.select("node", "type", "convention", "refs")))
    before = written(precedents(targets, nodes, edges, pages))
    said = written(feedback(targets, nodes, edges))
    refs = nodes.select("node", "refs")
    of_rules = rules.join(refs.withColumnRenamed("node", "rule"), "rule").groupBy("node").agg(F.count("*").alias("rules"), F.sum("refs").alias("rule_refs"), F.count_if(F.col("provenance") == "direct").alias("direct"), F.count_if(F.col("provenance") == "one_hop").alias("one_hop"), F.count_if(F.col("provenance") == "global_fallback").alias("fallback"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda p: p[c].cast("string")), "|")
    stored = pages.select(F.col("page").alias("precedent"), F.lower("text").rlike(f"(^|[^a-z0-9_])({DATABASE})([^a-z0-9_]|$)").alias("database"))
    of_before = before.join(refs.withColumnRenamed("node", "precedent"), "precedent").join(stored.groupBy("precedent").agg(F.bool_or("database").alias("database")), "precedent", "left")
    of_before = of_before.groupBy("node").agg(listed("precedent").alias("precedents"), F.sum("refs").alias("precedent_refs"), F.bool_or("database").alias("database"))
    of_said = said.groupBy("node").agg(listed("item").alias("feedback"), F.count("*").alias("pieces"))
    r = targets.select("node", F.coalesce("proposed", F.lit(False)).alias("proposed")).join(of_rules, "node", "left").join(of_before, "node", "left").join(of_said, "node", "left")
    zero, plan = lambda c: F.coalesce(c, F.lit(0)).cast("long"), F.col("proposed")
    none, silent = F.col("precedents").isNull(), F.col("feedback").isNull()
    gaps = {"contracts": plan, "rules": zero("rules") == 0, "precedents": none, "models": plan & none, "feedback": plan & silent, "database": plan & ~F.coalesce("database", F.lit(False))}
    items = zero("rule_refs") + zero("precedent_refs") + zero("pieces")
    return r.select(
        "node", F.coalesce("precedents", F.lit("")).alias("precedents"), F.coalesce("feedback", F.lit("")).alias("feedback"), F.array_join(F.array_compact(F.array(*[F.when(c, k) for k, c in gaps.items()])), "|").alias("gaps"),
        zero("rule_refs").alias("rule_refs"), zero("precedent_refs").alias("precedent_refs"), items.alias("items"), zero("direct").alias("direct"), zero("one_hop").alias("one_hop"), zero("fallback").alias("fallback"),
        # What neither rules nor precedents cite: the pieces of feedback.
        F.when(items > 0, F.floor(100.0 * zero("pieces") / items + 0.5)).otherwise(0).cast("long").alias("unbacked_pct"),
    )


SCREENS = ["pet browse page", "donation form", "select a toy", "plain words", "schema of orders"]


@query()
def y19_packs(spark, d):
    """The packs of projects among parts, with parts and order lines as nodes and edges."""
    i = F.col("node_id")
    n = part_nodes(spark, d).select(i.alias("node"), "type", F.concat_ws(" ", "name", one_of(F.floor(i / 8), SCREENS)).alias("name"), F.when(i % 3 > 0, F.concat(F.lit("users of "), "name")).alias("said"), (F.col("status") == "proposed").alias("proposed"), "convention", "refs")
    n = written(n)
    kind, flag = one_of(F.col("l_linenumber"), ["APPLIES_TO", "RELATED_TO", "CONTAINS", "USES"]), F.col("l_returnflag")
    weight = F.when(flag == "R", 0.9).when(flag == "A", 0.5).otherwise(0.2)
    edges = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), (F.col("l_orderkey") % 1000).alias("dst"), kind.alias("type")).agg(F.max(weight).alias("weight"))
    pages = n.where("node % 5 > 0").select(F.col("node").alias("page"), F.concat_ws(" ", "name", F.lit("notes")).alias("text"))
    targets = n.where("type = 'project' and proposed").select("node", F.col("name").alias("text"), "proposed")
    return packs(targets, n, edges, pages)
