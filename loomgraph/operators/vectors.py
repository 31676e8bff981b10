"""Vectors against vectors in blocks.

Rows of a group are dealt to blocks of bounded size; each pair of blocks that may meet is a unit of its own, in which
numpy compares all with all, some rows at a time.  Only what a step selects leaves its task, so no join of single rows takes
place, and a group of any size is spread over as many tasks as it has pairs of blocks.  A row goes to as many units as its
block meets blocks, so blocks are large and few: rows sent are few beside the pairs compared."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

#: Most rows of a block; blocks that a smaller group has, of so many rows at least; rows of a block compared at once.
BLOCK, BLOCKS, STEP = 32768, 4, 1024
EPSILON = 1e-10
#: By how much sums in another order may be off, with room to spare.
MARGIN = 1e-9
PAIRS = "a long, b long, score double"

Select = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x with each of y, summed from the first component to the last, so that equal vectors have equal
    cosines wherever they lie in a block."""
    dot, xx, yy = np.zeros((len(x), len(y))), np.zeros(len(x)), np.zeros(len(y))
    for k in range(x.shape[1]):
        dot += x[:, k, None] * y[:, k]
        xx += x[:, k] * x[:, k]
        yy += y[:, k] * y[:, k]
    return dot / (np.sqrt(xx)[:, None] * np.sqrt(yy) + EPSILON)


def close(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of rows of x and y of a cosine of `least` or more, as `cosines` has it: a matrix product, whose sums go in an
    order of its own, leaves the few pairs that are summed in order."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    if np.isfinite(xx).all() and np.isfinite(yy).all():
        i, j = np.nonzero((x @ y.T) / (np.sqrt(xx)[:, None] * np.sqrt(yy) + EPSILON) >= least - MARGIN)
        if 4 * len(i) <= len(x) * len(y):
            dot, xx, yy = np.zeros(len(i)), np.zeros(len(x)), np.zeros(len(y))
            for k in range(x.shape[1]):
                dot += x[i, k] * y[j, k]
                xx += x[:, k] * x[:, k]
                yy += y[:, k] * y[:, k]
            s = dot / (np.sqrt(xx)[i] * np.sqrt(yy)[j] + EPSILON)
            return i[s >= least], j[s >= least], s[s >= least]
    s = cosines(x, y)
    i, j = np.nonzero(s >= least)
    return i, j, s[i, j]


def at_least(score: float) -> Select:
    """Pairs of that cosine or more, each once (a < b)."""

    def select(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero((s >= score) & (a[:, None] < b))

    select.least = score
    return select


def nearest(k: int) -> Select:
    """The k greatest of each a, ties by b; a itself is left out."""

    def select(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.where(a[:, None] == b, -np.inf, s)
        by = np.lexsort((np.broadcast_to(b, s.shape), -s), axis=1)[:, :k]
        i = np.repeat(np.arange(len(a)), by.shape[1])
        keep = np.isfinite(s[i, by.reshape(-1)])
        return i[keep], by.reshape(-1)[keep]

    return select


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    v = pa.concat_arrays(vectors.chunks)
    n = np.diff(v.offsets.to_numpy())
    if (n != n[0]).any():
        raise ValueError("vectors of a group are of one length")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), n[0])


#: What a row of a unit is: of its first block, of its second one, or of the one block that meets itself.
FIRST, SECOND, BOTH = 0, 1, 2


def _units(select: Select, once: bool):
    """Units' rows to PAIRS.  `once`: the two blocks are of the same rows, so a unit's pairs come in no other one."""

    def unit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side = t.column("side").to_numpy()
        ids = t.column("id").to_numpy()
        v = matrix(t.column("vector")).astype(np.float64, copy=False)
        (a, x), (b, y) = ((ids[side != other], v[side != other]) for other in (SECOND, FIRST))
        alone = bool((side == BOTH).any())
        for m in range(0, len(a), STEP):
            for n in range(m if alone else 0, len(b), STEP):
                p, q = a[m : m + STEP], b[n : n + STEP]
                if hasattr(select, "least"):
                    i, j, s = close(x[m : m + STEP], y[n : n + STEP], select.least)
                    p, q = p[i], q[j]
                    if once and not (alone and m == n):
                        p, q = np.minimum(p, q), np.maximum(p, q)
                    p, q, s = p[p < q], q[p < q], s[p < q]
                else:
                    s = cosines(x[m : m + STEP], y[n : n + STEP])
                    i, j = select(p, q, s)
                    p, q, s = p[i], q[j], s[i, j]
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(s)], names=["a", "b", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = t.column("unit").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1)] if len(key) else [0]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                yield from unit(t.slice(start, end - start))
            rest = t.slice(edges[-1])
        if rest is not None and rest.num_rows:
            yield from unit(rest)

    return work


def in_blocks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df (id, group, vector) with a block number, and the blocks (group, blocks) of each group."""
    n = F.count("*")
    sizes = df.groupBy("group").agg(F.greatest(F.ceil(n / BLOCK), F.least(F.lit(BLOCKS), F.ceil(n / STEP))).cast("int").alias("blocks"))
    # A row for each group; whether they are broadcast is left to the optimizer.
    dealt = df.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return dealt.select("id", "group", "block", "vector"), sizes


def compare(left: DataFrame, right: DataFrame, select: Select, everywhere: str | None = None) -> DataFrame:
    """PAIRS of what `select` takes of left (id, group, vector) and right (the same) in one group.

    Rows of the group `everywhere` meet the rows of all groups.  Null ids, groups or vectors meet nothing; vectors
    of a group are of one length.  An empty side gives no rows.  Where left is right and pairs have no order, two blocks meet once."""
    usable = "id is not null and group is not null and vector is not null"
    once = left is right and hasattr(select, "least")
    single = {df.schema["vector"].dataType.simpleString() for df in (left, right)} == {"array<float>"}
    kind = "array<float>" if single else "array<double>"  # doubles are made of floats where they are compared
    clean = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("group").cast("string").alias("group"), F.col("vector").cast(kind).alias("vector")).where(usable)
    (l, ls), (r, rs) = in_blocks(clean(left)), in_blocks(clean(right))
    one, two = ls.selectExpr("group AS g1", "explode(sequence(0, blocks - 1)) AS b1"), rs.selectExpr("group AS g2", "explode(sequence(0, blocks - 1)) AS b2")
    meets = one.join(two, F.col("g1") == F.col("g2")).where("b1 <= b2" if once else "true")
    if everywhere is not None:  # one row for each pair of blocks
        wide = one.where(F.col("g1") == everywhere).withColumn("k", F.lit(0)).join(two.where(F.col("g2") != everywhere).withColumn("k", F.lit(0)), "k")
        back = two.where(F.col("g2") == everywhere).withColumn("k", F.lit(0)).join(one.where(F.col("g1") != everywhere).withColumn("k", F.lit(0)), "k")
        meets = meets.unionByName(wide.drop("k")) if once else meets.unionByName(wide.drop("k")).unionByName(back.drop("k"))
    same = (F.col("g1") == F.col("g2")) & (F.col("b1") == F.col("b2")) & F.lit(once)
    meets = meets.select("*", F.concat_ws("\x1f", "g1", "b1", "g2", "b2").alias("unit"), same.alias("same"))
    firsts = meets.select("unit", F.col("g1").alias("group"), F.col("b1").alias("block"), F.when(F.col("same"), BOTH).otherwise(FIRST).alias("side"))
    seconds = meets.where("not same").select("unit", F.col("g2").alias("group"), F.col("b2").alias("block"), F.lit(SECOND).alias("side"))
    if once:
        rows = l.join(firsts.union(seconds), ["group", "block"])
    else:
        rows = l.join(firsts, ["group", "block"]).unionByName(r.join(seconds, ["group", "block"]))
    return rows.select("unit", "side", "id", "vector").repartition("unit").sortWithinPartitions("unit").mapInArrow(_units(select, once), PAIRS)


def with_previous(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """df with `before`, the value of the row before it by `order` among those of its key (null for the first).  Rows are dealt
    to ranges of (key, order), so that a frequent key is many tasks; a range's first row takes the last one of the range before
    it.  Null is a key like others; of rows of the same order the one before is any."""
    ranges = written(df.repartitionByRange(F.col(key), F.col(order)).withColumn("_range", F.spark_partition_id()))
    place = Window.partitionBy(key, "_range").orderBy(order)
    rows = ranges.withColumn("before", F.lag(value).over(place)).withColumn("_first", F.row_number().over(place) == 1)
    ends = ranges.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_of")).agg(F.max_by(value, order).alias("_last"))
    ends = ends.withColumn("_last", F.lag("_last").over(Window.partitionBy("_key").orderBy("_of")))
    met = (F.col("_range") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")) & F.col("_first")
    return rows.join(ends, met, "left").withColumn("before", F.coalesce("before", "_last")).drop("_range", "_first", "_key", "_of", "_last")
