"""Leader clustering: in order of id, a row joins the earliest leader that it resembles, or becomes a leader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import written


def leaders(rows: DataFrame, pairs: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, leader) for all rows (id), given the pairs (a < b) that resemble each other; the same as one pass in order.

    A row leads if no earlier row that it resembles leads.  Rounds settle all rows whose earlier ones are settled,
    so they number as the longest chain of rows that wait for each other, not as the rows.  Rows without pairs
    lead themselves; pairs of ids that are not in `rows`, null ids and repeated rows change nothing."""
    ids = rows.select("id").where("id is not null").distinct()
    earlier = pairs.select("a", "b").where("a < b").distinct()
    earlier = earlier.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    earlier = written(earlier)
    state = written(ids.join(earlier.select(F.col("b").alias("id"), F.lit(True).alias("waits")).distinct(), "id", "left").select("id", F.when(F.col("waits").isNull(), True).alias("leads")))
    for _ in range(rounds):
        seen = earlier.join(state.select(F.col("id").alias("a"), F.col("leads").alias("led")), "a").groupBy("b").agg(F.coalesce(F.bool_or("led"), F.lit(False)).alias("some"), F.bool_or(F.col("led").isNull()).alias("open"))
        settled = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.col("some"), False).when(~F.col("open"), True)
        state = written(state.join(seen.withColumnRenamed("b", "id"), "id", "left").select("id", settled.alias("leads")))
        if not state.where("leads is null").limit(1).count():
            first = earlier.join(state.where("leads").select(F.col("id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
            return state.join(first, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))
    raise RuntimeError("more rounds are needed")
