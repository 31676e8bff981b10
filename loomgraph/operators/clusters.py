"""Clusters under constraints, and merges whose evidence grows; each gives what one pass in order gives, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components, written


def constrained_components(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(node, component: its least node) of the nodes of edges (a, b, rank), merged edge by edge in the order of (rank, a, b) unless
    the two clusters have different marks (node, mark; one mark a node, the least if it has several).

    An unmarked cluster always merges along its first edge: until that edge's turn nothing can mark it.  So in each round all
    unmarked clusters do so at once, edges between equal marks merge and those between different ones go; clusters without a
    mark at least halve, so rounds are as the logarithm of the nodes.  Edges to itself and repeated edges change nothing; nodes
    without an edge are not in the result."""
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rank")
    e = written(e.groupBy("a", "b").agg(F.min("rank").alias("rank")).select("a", "b", F.struct("rank", "a", "b").alias("at")))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    own = marks.where("mark is not null").groupBy("node").agg(F.min("mark").alias("mark"))
    state = written(nodes.join(own, "node", "left").select("node", F.col("node").alias("component"), "mark"))
    while True:
        end = lambda s: state.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"), F.col("mark").alias(f"m{s}"))
        met = e.join(end("a"), "a").join(end("b"), "b").where("ca <> cb and (ma is null or mb is null or ma = mb)")
        e = written(met.select("a", "b", "at", "ca", "cb", "ma", "mb"))
        if e.isEmpty():
            return state.select("node", "component")
        both = e.where("ma is null").select(F.col("ca").alias("c"), F.col("cb").alias("to"), "at").union(e.where("mb is null").select("cb", "ca", "at"))
        first = both.groupBy("c").agg(F.min(F.struct("at", "to")).alias("b")).select("c", F.col("b.to").alias("to"))
        chosen = e.where("ma = mb").select(F.col("ca").alias("c"), F.col("cb").alias("to")).union(first)
        joined = connected_components(chosen.select(F.col("c").alias("src"), F.col("to").alias("dst"), F.lit("").alias("type")))
        moved = state.join(joined.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"), "mark")
        marked = moved.groupBy("component").agg(F.min("mark").alias("mark"))
        state, e = written(moved.drop("mark").join(marked, "component").select("node", "component", "mark")), e.select("a", "b", "at")


#: Evidence of more classes than this meets leaders at their classes, other evidence at itself.
FEW_CLASSES = 16
#: Rows of the first block, how many times as many each later one has, and the share of open rows that a sweep settles for another to follow.
FIRST, MORE, ENOUGH = 4096, 4, 0.25


def growing_merges(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, into) of the ids of evidence (id: a number, e, c): the same as one pass in order, in which each row that is still there takes
    over every later one that is paired with it and shares evidence with it or with what it has taken over before.

    Rows of paired classes (pairs: a < b) and of one class (c) are paired, rows without a class with none; without a column c each
    row is a class of its own.  A block of the first ids is settled in rounds (`_settled`).  Of the rows after it those go at once that
    share evidence, which it has had before them, with the least leader that they are paired with: no later leader comes
    before that one.  What these bring settles more (`sweeps`); few are left for the next, larger blocks."""
    every = written(evidence.where("id is not null").select("id", "e", "c" if "c" in evidence.columns else F.col("id").alias("c")))
    held = every.where("e is not null and c is not null")
    p = pairs.where("a < b").select("a", "b").distinct()
    alike = written(p.union(p.select("b", "a")).union(held.select("c", "c").distinct()).toDF("c", "other"))
    open_ = written(held.select("id", "c").distinct())
    done, source, size, n = None, None, FIRST, open_.count()
    while n:
        last = open_.agg(F.max("id") if n <= size else F.percentile_approx("id", size / n)).first()[0]
        block = held.where(F.col("id") <= last).join(open_.where(F.col("id") <= last).select("id"), "id", "left_semi")
        now = _settled(written(block), alike, held, done)
        done, open_ = now if done is None else written(done.union(now)), written(open_.where(F.col("id") > last))
        n, leads = open_.count(), done.where("id = into").select("into", F.col("c").alias("other"))
        if not n:
            break
        low = written(alike.join(leads, "other").groupBy("c").agg(F.min("into").alias("into")))
        # Rows that brought nothing before bring nothing now: a class has a new least leader only if it had none.
        source = now.select("id", "into") if source is None else now.select("id", "into").union(source)
        while n:
            at = held.join(source, "id").groupBy("into", "e").agg(F.min("id").alias("at"))
            asks = held.where(F.col("id") > last).join(open_.select("id"), "id", "left_semi").join(low, "c")
            swept = written(asks.join(at, ["into", "e"]).where("at < id").select("id", "c", "into").distinct())
            gone = swept.count()
            done, open_, source = written(done.union(swept)), written(open_.join(swept.select("id"), "id", "left_anti")), swept.select("id", "into")
            enough, n = gone >= ENOUGH * n, n - gone
            if not enough:
                break
        size *= MORE
    ids = every.select("id").distinct()
    return ids.withColumn("into", F.col("id")) if done is None else ids.join(done.select("id", "into"), "id", "left").select("id", F.coalesce("into", "id").alias("into"))


def _settled(block: DataFrame, alike: DataFrame, held: DataFrame, done: DataFrame | None) -> DataFrame:
    """(id, c, into) of the rows of block (id, e, c), which come after none but it and those that are `done` (id, c, into) may lead.

    Pairs are never told row by row: a leader's evidence, with the place from which it has it, is offered to the classes like its
    own, and a row asks at its class and evidence for the least leader that had it before.  What a row becomes depends on earlier
    rows alone, so rounds that change nothing have the one result there is; each round settles the rows whose earlier ones are
    settled at least.  What leaders have from rows that are done is offered once."""
    asked = block.select("e", "c").distinct()
    asked = written(asked.join(asked.groupBy("e").agg((F.count("*") > FEW_CLASSES).alias("wide")), "e"))
    known = written(asked.select("e", "wide").distinct())
    order = Window.partitionBy("e", "c").orderBy("at", "offer").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asks = block.select("e", "c", F.col("id").alias("at"), F.lit(False).alias("offer"), F.lit(None).cast(block.schema["id"].dataType).alias("k"))

    def least(has, leads):
        """(id, k): the least leader k of leads (into, other: its class) that has (into, e, at) a row's evidence before it."""
        has = written(has.join(leads, "into").join(known, "e"))
        near = has.where("not wide").join(asked.select("e", "c"), "e").join(alike, ["c", "other"], "left_semi")
        far = has.where("wide").join(alike, "other")
        offers = [df.select("e", "c", "at", F.lit(True).alias("offer"), F.col("into").alias("k")) for df in (near, far)]
        met = asks.union(offers[0]).union(offers[1]).withColumn("k", F.min("k").over(order)).where("not offer")
        return met.groupBy(F.col("at").alias("id")).agg(F.min("k").alias("k"))

    led = None
    if done is not None:
        led = written(done.where("id = into").select("into", F.col("c").alias("other")))
        has = held.join(known.select("e"), "e", "left_semi").join(done.select("id", "into"), "id").groupBy("into", "e").agg(F.min("id").alias("at"))
        sure = written(least(has, led).withColumnRenamed("k", "sure"))
    # The first guess, which only saves rounds: each row went to the first of its class that has evidence of its own.
    first = block.groupBy("e", "c").agg(F.min("id").alias("into"))
    state = block.join(first, ["e", "c"]).groupBy("id", "c").agg(F.min("into").alias("into"))
    state = state.withColumn("sure", F.lit(None).cast(block.schema["id"].dataType)) if led is None else state.join(sure, "id", "left").withColumn("into", F.least("into", "sure"))
    state = written(state)
    while True:
        leads = state.where("id = into").select("into", F.col("c").alias("other"))
        has = block.join(state.select("id", "into"), "id").groupBy("into", "e").agg(F.min("id").alias("at"))
        now = F.coalesce(F.least("k", "sure"), "id")
        state = written(state.join(least(has, leads if led is None else leads.union(led)), "id").select("id", "c", now.alias("into"), "sure", (now != F.col("into")).alias("moved")))
        if state.where("moved").isEmpty():
            return state.select("id", "c", "into")
