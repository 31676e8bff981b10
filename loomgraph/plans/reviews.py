"""What reviewers did, replayed: the cards, claims and nodes that their actions leave, and the actions that were refused."""

from pyspark.sql import functions as F

from ..operators.graph import written
from ..registry import query
from ..sources.tables import table as t
from .audits import one_of

#: The actions, and the status that each gives its card.
STATUS = {"validate": "validated", "edit": "edited", "reject": "rejected", "merge_entities": "validated", "keep_separate": "validated"}
ACTIONS = [*STATUS, "comment", "create"]


def folded_merges(merges, nodes, follow: bool = True):
    """Merges (seq, a, b) one after the other: (log: seq, keep, gone, why) and (state: node, survivor).  Nodes are (node, refs).

    The node of more references stays (ties: a), and takes over the other's.  A merge that names a node merged earlier lands on its
    survivor of that time, or is refused ('gone') without `follow`; one of a node with itself is refused ('same'), one of an unknown node
    too ('unknown').  A merge is done once it is the first open one of both its survivors, so a round does all that don't wait
    for each other; rounds number as the longest run of merges that do."""
    state = written(nodes.groupBy("node").agg(F.max("refs").alias("refs")).select("node", F.col("node").alias("survivor"), F.col("refs").cast("long").alias("refs")))
    known = state.select("node")
    there = merges.join(known.withColumnRenamed("node", "a"), "a", "left_semi").join(known.withColumnRenamed("node", "b"), "b", "left_semi").select("seq", "a", "b")
    none = F.lit(None).cast(state.schema["node"].dataType)
    logs = [merges.join(there.select("seq"), "seq", "left_anti").select("seq", none.alias("keep"), none.alias("gone"), F.lit("unknown").alias("why"))]
    open_ = written(there)
    while not open_.isEmpty():
        size = state.where("node = survivor").select("survivor", "refs")
        end = lambda s: state.select(F.col("node").alias(s), F.col("survivor").alias(f"s{s}")).join(size.select(F.col("survivor").alias(f"s{s}"), F.col("refs").alias(f"r{s}")), f"s{s}")
        met = open_.join(end("a"), "a").join(end("b"), "b")
        why = F.when(F.col("sa") == F.col("sb"), "same") if follow else F.when((F.col("sa") != F.col("a")) | (F.col("sb") != F.col("b")), "gone").when(F.col("sa") == F.col("sb"), "same")
        met = written(met.withColumn("why", why))
        logs.append(met.where("why is not null").select("seq", none.alias("keep"), none.alias("gone"), "why"))
        left = met.where("why is null")
        first = left.select(F.col("sa").alias("s"), "seq").union(left.select("sb", "seq")).groupBy("s").agg(F.min("seq").alias("first"))
        ready = left.join(first.toDF("sa", "fa"), "sa").join(first.toDF("sb", "fb"), "sb").where("seq = fa and seq = fb")
        stays = F.col("ra") >= F.col("rb")
        done = written(ready.select("seq", F.when(stays, F.col("sa")).otherwise(F.col("sb")).alias("keep"), F.when(stays, F.col("sb")).otherwise(F.col("sa")).alias("gone"), (F.col("ra") + F.col("rb")).alias("sum")))
        logs.append(done.select("seq", "keep", "gone", F.lit(None).cast("string").alias("why")))
        moved = state.join(done.select(F.col("gone").alias("survivor"), F.col("keep").alias("to")), "survivor", "left").select("node", F.coalesce("to", "survivor").alias("survivor"), "refs")
        state = written(moved.join(done.select(F.col("keep").alias("node"), "sum"), "node", "left").select("node", "survivor", F.coalesce("sum", "refs").alias("refs")))
        open_ = written(left.join(done, "seq", "left_anti").select("seq", "a", "b"))
    log = logs[0]
    for more in logs[1:]:
        log = log.union(more)
    return log, state


def replayed(events, cards, claims, nodes, follow: bool = True):
    """What events (seq, card, action, text, a, b: of a new card) leave of cards (card, claims: array, a, b), claims (claim, entity) and nodes
    (node, name, refs), as rows (kind, id, state, text, other, n):

    card: its status, proposed text and number of comments; claim: whether a reader asserted it, its new text, the node that its
    entity has become and the references added; node: kept (aliases in `text`, references) or merged (into `other`);
    refused: an event by its seq, why, and its action.

    Of cards of one id the first counts; an event on a card that isn't there yet is refused.  Validating asserts all claims of a card, editing
    its only one, if there is a text.  Null ids are left out."""
    events, given = events.where("seq is not null"), cards.where("card is not null").withColumn("born", F.lit(None).cast("long"))
    made = events.where("action = 'create' and card is not null").groupBy("card").agg(F.min(F.struct("seq", "a", "b")).alias("m"))
    made = made.join(given, "card", "left_anti").select("card", F.lit(None).cast(cards.schema["claims"].dataType).alias("claims"), "m.a", "m.b", F.col("m.seq").alias("born"))
    known = written(given.select("card", "claims", "a", "b", "born").union(made))
    met = events.select("seq", "card", "action", "text").join(known.withColumn("there", F.lit(True)), "card", "left")
    create = F.col("action") == "create"
    why = (
        F.when(create & F.col("there") & (F.col("born").isNull() | (F.col("born") < F.col("seq"))), "exists")
        .when(~F.coalesce(create, F.lit(False)) & (F.col("there").isNull() | (F.col("born") >= F.col("seq"))), "no card")
        .when(~F.coalesce(F.col("action").isin(ACTIONS), F.lit(False)), "unknown action")
        .when((F.col("action") == "merge_entities") & (F.col("a").isNull() | F.col("b").isNull()), "no entities")
    )
    met = written(met.withColumn("why", why))
    log, state = folded_merges(met.where("why is null and action = 'merge_entities'").select("seq", "a", "b"), nodes.where("node is not null"), follow)
    log = written(log)
    refused = met.where("why is not null").select("seq", "why").union(log.where("why is not null").select("seq", "why"))
    done = met.where("why is null").join(refused.select("seq"), "seq", "left_anti")

    word = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[F.col("action")]
    told = done.groupBy("card").agg(
        F.max(F.when(word.isNotNull(), F.struct("seq", word.alias("status")))).alias("s"),
        F.max(F.when(F.col("action") == "edit", F.struct("seq", F.col("text").alias("proposed")))).alias("p"),
        F.count_if(F.col("action") == "comment").alias("comments"),
    )
    null, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    row = lambda df, kind, i, state, text, other, n: df.select(F.lit(kind).alias("kind"), F.col(i).cast("long").alias("id"), state.alias("state"), text.alias("text"), other.cast("long").alias("other"), n.cast("long").alias("n"))
    of_cards = row(known.join(told, "card", "left"), "card", "card", F.coalesce("s.status", F.lit("open")), F.col("p.proposed"), null, F.coalesce("comments", zero))

    sure = (F.col("action") == "validate") | ((F.col("action") == "edit") & (F.size("claims") == 1) & (F.length("text") > 0))
    asserted = done.where(sure).select("seq", "action", "text", F.explode("claims").alias("claim"))
    asserted = asserted.groupBy("claim").agg(F.count("*").alias("added"), F.max(F.when(F.col("action") == "edit", F.struct("seq", "text"))).alias("e"))
    c = claims.where("claim is not null").join(asserted, "claim", "left").join(state.select(F.col("node").alias("entity"), "survivor"), "entity", "left")
    of_claims = row(c, "claim", "claim", F.when(F.col("added") > 0, "human_asserted").otherwise("inferred"), F.col("e.text"), F.coalesce("survivor", "entity"), F.coalesce("added", zero))

    named = state.join(nodes.groupBy("node").agg(F.min("name").alias("name")), "node")
    taken = named.where("node <> survivor").groupBy(F.col("survivor").alias("node")).agg(F.array_sort(F.collect_set("name")).alias("taken"))
    aliases = F.array_join(F.filter("taken", lambda x: F.lower(x) != F.lower(F.col("name"))), "|")
    n = named.join(taken, "node", "left")
    of_nodes = row(n, "node", "node", F.when(F.col("node") == F.col("survivor"), "kept").otherwise("merged"), aliases, F.when(F.col("node") != F.col("survivor"), F.col("survivor")), F.when(F.col("node") == F.col("survivor"), F.col("refs")).otherwise(0))
    of_refused = row(refused.join(events.select("seq", "action"), "seq"), "refused", "seq", F.col("why"), F.col("action"), null, zero)
    return of_cards.union(of_claims).union(of_nodes).union(of_refused)


def _reviews(spark, d):
    """Each order as a card about its customer and another of its eight, its lines as claims; events as actions on them."""
    partner = lambda c: F.floor(c / 8) * 8 + (c + 3) % 8
    lines = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim"))
    # Lines are dealt by order once, for cards and claims alike; claims once by their id, for all that joins them.
    of_card = lines.repartition("l_orderkey").distinct().groupBy("l_orderkey").agg(F.collect_list("claim").alias("claims"))
    o = written(t(spark, d, "orders").select("o_orderkey", "o_custkey").join(of_card, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey"))
    about = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey"))
    cards = o.select(F.col("o_orderkey").alias("card"), "claims", about.alias("a"), partner(about).alias("b"))
    claims = o.select(F.explode("claims").alias("claim"), F.col("o_custkey").alias("entity")).repartition("claim").distinct()
    nodes = t(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_name").alias("name"), (F.col("c_custkey") % 7).alias("refs"))
    i = F.col("event_id")
    card = F.when(i % 20 == 5, -i).when(i % 20 == 6, 1 - i).when(i % 20 == 4, -i - 1).when(i % 3 == 0, i).otherwise(F.col("user_id"))
    action = F.when(i % 20 == 5, "create").otherwise(one_of(F.floor(i / 4), [*ACTIONS[:6], "promote", "merge_entities", "merge_entities"]))
    text = F.when(i % 6 != 0, F.col("props"))
    events = t(spark, d, "events").select(i.alias("seq"), card.alias("card"), action.alias("action"), text.alias("text"), F.when(i % 20 == 5, i % 50).alias("a"), F.when(i % 20 == 5, partner(i % 50)).alias("b"))
    return events, cards, claims, nodes


@query()
def y23_verification(spark, d):
    return replayed(*_reviews(spark, d))
