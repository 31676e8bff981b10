"""Writers.  Appends are partitioned by run and execution, so that a read of one prunes the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append(df: DataFrame, path: str, by: tuple[str, ...] = ("run_id", "execution_id")) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with new's rows in place of those of the same key; write it as the next version."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(old: DataFrame, kill: DataFrame, key: list[str]) -> DataFrame:
    return old.join(kill.select(*key).distinct(), key, "left_anti")
