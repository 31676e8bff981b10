"""Running values along each key in an order, as a prefix scan over ranges: no key needs one task.

Rows are ordered by (key, order) over all tasks, by ranges, and each task runs along its range from nothing.  What a range ends
with (its last key, that key's sum and last value) is one row; combined in order these tell what each range should have begun with,
and are added to the rows of its first key.  So a key with a third of all rows is run along by as many tasks as hold it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

#: Stands for a null key.
NO_KEY = "\x00"


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of _step and last _value along each _key of a sorted range; _at numbers its rows."""
    key, total, value, at = None, 0, None, 0
    part = TaskContext.get().partitionId()
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        keys, step, values = (b.column(b.schema.get_field_index(c)) for c in ("_key", "_step", "_value"))
        step, has = step.to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False)
        values = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, n))
        sums = np.cumsum(step)
        run = sums - np.repeat(np.append(0, sums)[begin], length)
        # The last row with a value at or before each, within its key.
        place = np.maximum.accumulate(np.where(has, np.arange(n), -1))
        found = place >= np.repeat(begin, length)
        last = np.where(found, values[np.maximum(place, 0)], 0)
        if keys[0].as_py() == key:
            run[: length[0]] += total
            if value is not None:
                head = np.flatnonzero(~found[: length[0]])
                last[head], found[head] = value, True
        key, total, value = keys[-1].as_py(), int(run[-1]), int(last[-1]) if found[-1] else None
        more = [pa.array(run), pa.array(last, mask=~found), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))]
        at += n
        yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "_sum", "_last", "_place", "_at"])


def prefix_scan(rows: DataFrame, key: str, order: list[str], step: Column | None = None, value: Column | None = None, sum_as: str = "running", last_as: str = "last") -> DataFrame:
    """rows with `sum_as`, the sum of step (a whole number; null: 0) over the rows of its key up to it, and `last_as`, the last value (a whole
    number) that isn't null among them; each only if it is asked for.

    Rows of one key are taken in the order given, ties by the other columns.  A null key is a key of its own; an empty table
    gives no rows.  Rows are sorted by ranges once and written; of each range one row comes to the driver."""
    none = F.lit(None).cast("long")
    more = [F.coalesce(F.col(key).cast("string"), F.lit(NO_KEY)).alias("_key"), F.coalesce(step if step is not None else F.lit(0), F.lit(0)).cast("long").alias("_step"), (value.cast("long") if value is not None else none).alias("_value")]
    by = ["_key", *order, *(c for c, kind in rows.dtypes if c not in order and not kind.startswith("map")), "_step", "_value"]
    dealt = rows.select("*", *more).repartitionByRange(*by).sortWithinPartitions(*by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", _sum long, _last long, _place int, _at long"
    local = written(dealt.mapInArrow(_along, schema))
    ends = local.groupBy("_place").agg(F.min("_key").alias("first"), F.max("_key").alias("last"), F.max_by(F.struct("_sum", "_last"), "_at").alias("end")).orderBy("_place").collect()
    starts, now = [], (None, 0, None)
    for r in ends:
        starts.append((r["_place"], *now))
        total, last = r["end"]["_sum"], r["end"]["_last"]
        now = (r["last"], now[1] + total, now[2] if last is None else last) if r["first"] == r["last"] == now[0] else (r["last"], total, last)
    begun = rows.sparkSession.createDataFrame(starts, "_place int, _of string, _total long, _had long")
    met = local.join(F.broadcast(begun), "_place")  # a row a range
    own = F.col("_key") == F.col("_of")
    found = [(F.col("_sum") + F.when(own, F.col("_total")).otherwise(0)).alias(sum_as)] if step is not None else []
    found += [F.coalesce("_last", F.when(own, F.col("_had"))).alias(last_as)] if value is not None else []
    return met.select(*rows.columns, *found)
