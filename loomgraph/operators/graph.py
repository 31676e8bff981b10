"""Graphs as edge DataFrames (src, dst, type)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either of its ends: (node, other, type)."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "type").union(edges.select("dst", "src", "type"))


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2, types: list[str] | None = None) -> DataFrame:
    """(seed, node, hop) of what is reached from seeds (node), each node at its least hop; after the first
    hop only edges of `types` count."""
    adjacent = both_ways(edges)
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        along = adjacent if hop == 1 or not types else adjacent.where(F.col("type").isin(types))
        front = front.join(along, "node").select("seed", F.col("other").alias("node"), F.lit(hop).alias("hop")).distinct()
        front = front.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        seen = seen.union(front)
    return seen


def written(df: DataFrame, *by: str) -> DataFrame:
    """Cut the lineage by a table, with folders for the columns `by`, in the folder of spark.checkpoint.dir (in local mode a temporary one where it is unset)."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/graph/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: How often nodes go into their least neighbour, and edges with them, before labels spread.
CONTRACTIONS = 2


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component), the least node reached: nodes go into their least neighbour (or stay), which leaves few edges; along these labels
    spread, and jump to their label's label.  The least node of all always stays, so its label is the component's."""
    ends = edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    met, went = written(ends), []
    for _ in range(CONTRACTIONS):
        near = met.select(F.col("a").alias("node"), F.col("b").alias("other")).union(met.select("b", "a"))
        went.append(written(near.groupBy("node").agg(F.least("node", F.min("other")).alias("to"))))
        now = met.join(went[-1].toDF("a", "x"), "a").join(went[-1].toDF("b", "y"), "b").where("x <> y")
        met = written(now.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    found = went[0].select("node", F.col("to").alias("component"))
    for further in [*went[1:], _spread(met, rounds)]:
        found = found.join(further.toDF("component", "far"), "component", "left").select("node", F.coalesce("far", "component").alias("component"))
    return found


def _spread(ends: DataFrame, rounds: int) -> DataFrame:
    """(node, component) of the nodes of distinct edges (a, b)."""
    adjacent = written(ends.select(F.col("a").alias("node"), F.col("b").alias("other")).union(ends.select("b", "a")))
    labels = written(adjacent.select("node", F.col("node").alias("component")).distinct())
    for _ in range(rounds):
        near = adjacent.join(labels.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        step = labels.join(near, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("was"))
        jump = step.join(labels.select(F.col("node").alias("component"), F.col("component").alias("far")), "component").select("node", "was", F.least("component", "far").alias("component"))
        now = written(jump)
        if not now.where("component <> was").limit(1).count():
            return now.select("node", "component")
        labels = now.select("node", "component")
    raise RuntimeError("more rounds are needed")
