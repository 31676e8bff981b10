"""Which value of an attribute survives, of all that providers say, and where it is from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def survivors(claims: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """(node, attribute, value, provider, votes) of claims (node, attribute, provider, value, weight).

    rules are (attribute, provider, rank), a short list: of the providers with a value those of the least rank count; among theirs the value of most
    weight wins, ties by value.  `provider` is the first by name of those of that rank who said it.  Null and empty values say nothing,
    nor do providers without a rule.  All attributes are settled in the same two aggregates, the first combined in the tasks, so
    a node with very many claims is a few rows when it is shuffled."""
    table = claims.sparkSession.createDataFrame(rules, "attribute string, provider string, rank int")
    said = claims.where("value <> ''").groupBy("node", "attribute", "provider", "value").agg(F.sum("weight").alias("weight"))
    votes = said.join(F.broadcast(table), ["attribute", "provider"]).groupBy("node", "attribute", "rank", "value").agg(F.sum("weight").alias("votes"), F.min("provider").alias("provider"))
    best = votes.groupBy("node", "attribute").agg(F.min(F.struct("rank", (-F.col("votes")).alias("minus"), "value", "provider")).alias("b"))
    return best.select("node", "attribute", F.col("b.value").alias("value"), F.col("b.provider").alias("provider"), (-F.col("b.minus")).alias("votes"))
