"""Operator 10: near-duplicate embeddings by collision-counting projections.

Vectors are projected on many random lines.  On one line alone a window wide enough for a pair at the
threshold holds a third of all vectors, so collisions on single lines would outnumber all pairs; therefore
vectors that lie close on each line of a random choice of lines (one cell of a table) meet first.  The
members of a cell are sorted by the projection on which they lie farthest apart, and the window centred on
each of them gives its pairs; for each pair the other projections are counted on which one lies in the
window around the other, and only pairs that pass a count calibrated for recall are verified by their
cosine.  No pair leaves a task: each adds to its vectors' link counts and to a local component."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, digest, join_unique, list_array, mix, ragged, seeded, staged, table

COSINE = 0.98
#: Lines of the count; its window in standard deviations of the difference at the threshold; chance of
#: losing a pair to the count, and of a pair at the threshold meeting in no table.
LINES, WINDOW, LOSE, MISS = 32, 3.0, 1e-5, 1e-4
#: Half the window on the sorted line, in standard deviations of the difference at the threshold: beyond it,
#: on any of LINES, are 2e-5 of the pairs there.
SORTED = 5.0
#: Members of one block of a cell; a larger cell is compared block by block.  Pairs looked at in one step.
BLOCK, STEP = 1024, 1 << 18
SEED = 20


def calibrated(n: int, cosine: float) -> tuple[int, int, float, int]:
    """Lines of a table, tables, width of a cell and least count, for n vectors.

    Lines a table grow with log(n), so that a vector meets few others by chance; the tables make up
    for what that loses."""
    d = math.sqrt(2 * (1 - cosine))
    phi = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    same = lambda r: 1 - 2 * phi(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
    width = 4 * d
    near, far = same(4.0), same(width / math.sqrt(2))
    lines = max(4, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    tables = math.ceil(math.log(MISS) / math.log(1 - near**lines))
    hit = 1 - 2 * phi(-WINDOW)
    least, lost = LINES, 1 - hit**LINES
    while lost > LOSE:
        least -= 1
        lost -= math.comb(LINES, least) * hit**least * (1 - hit) ** (LINES - least)
    return lines, tables, width, least


def directions(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, n))


PREPARED = "vec_id long, h1 long, h2 long, dim int, label string, tag long, vector array<double>"


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors of the rows that can be linked, with a digest of label and vector."""
    for b in batches:
        ids, labels = b.column(0).to_numpy(zero_copy_only=False), b.column(2)
        names = {x: digest(x.encode()) for x in set(labels.to_pylist())}
        tags = np.array([names[x] for x in labels.to_pylist()], np.uint64).reshape(-1, 2)
        lists = b.column(1)
        lens = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN
        at = np.append(0, np.cumsum(lens))
        for dim in np.unique(lens[lens > 0]):
            rows = np.flatnonzero(lens == dim)
            x = flat[at[rows][:, None] + np.arange(dim)]
            good = np.isfinite(x).all(1)
            scale = np.abs(np.where(np.isfinite(x), x, 0)).max(1)
            good &= scale > 0
            rows, x, scale = rows[good], x[good], scale[good]
            if not len(rows):
                continue
            x = x / scale[:, None]  # so that no square over- or underflows
            x = x / np.sqrt((x * x).sum(1))[:, None] + 0.0
            bits = x.view(np.uint64)
            codes = seeded(int(dim), 5)
            tag = mix(tags[rows] + np.uint64(int(dim)))
            h1 = mix((mix(bits + codes) * (codes | np.uint64(1))).sum(1, dtype=np.uint64) + tag[:, 0])
            h2 = mix((mix(bits ^ codes) * (codes | np.uint64(1))).sum(1, dtype=np.uint64) ^ tag[:, 1])
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows]), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(np.full(n, dim, np.int32)), labels.take(pa.array(rows)), pa.array(tag[:, 0].view(np.int64)), list_array(x.reshape(-1), np.arange(n + 1) * dim, pa.float64())],
                names=["vec_id", "h1", "h2", "dim", "label", "tag", "vector"],
            )


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lens = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lens))


def _cells(lines: int, tables: int, width: float):
    """(vec_id, keys): the cell of each table; labels and dimensions never share one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = _vectors(b.column(3))
            dims = b.column(1).to_numpy(zero_copy_only=False)
            tags = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                p = flat[at[rows][:, None] + np.arange(dim)] @ directions(int(dim), lines * tables)
                shift = np.random.default_rng([SEED, 1]).random(lines * tables)
                cell = np.floor(p / width + shift).astype(np.int64).view(np.uint64).reshape(len(rows), tables, lines)
                key = tags[rows][:, None] + seeded(tables, 3)
                for k in range(lines):
                    key = mix(key * np.uint64(0xD6E8FEB86659FD93) + cell[:, :, k])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), list_array(key.reshape(-1).view(np.int64), np.arange(len(rows) + 1) * tables, pa.int64())], names=["vec_id", "keys"])

    return work


LINKED = "vec_id long, n long, root long"


def windows(x: np.ndarray, y: np.ndarray, width: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with y[j] in the window centred on x[i], in steps of STEP pairs or one x; of one collection
    with itself (same) each pair once."""
    by_x, by_y = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    low = np.arange(1, len(x) + 1) if same else np.searchsorted(y[by_y], x[by_x] - width)
    n = np.maximum(np.searchsorted(y[by_y], x[by_x] + width, "right") - low, 0)
    total = np.append(0, np.cumsum(n))
    a = 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(total, total[a] + STEP, "right")) - 1)
        yield by_x[np.repeat(np.arange(a, b), n[a:b])], by_y[ragged(low[a:b], n[a:b])]
        a = b


def _link(cosine: float, least: int):
    """Streams over rows sorted by unit (a cell, or two blocks of one): each vector's links there."""
    sigma = math.sqrt(2 * (1 - cosine))

    def unit(ids, weight, key, side, other, vectors, keys, labels):
        """Of one unit; side 0 meets itself, and if `other`, side 0 meets side 1 only."""
        lines = vectors @ directions(vectors.shape[1], LINES)
        x, y = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if other else (np.arange(len(ids)),) * 2
        widest = int(lines.std(0).argmax())
        found = []
        for i, j in windows(lines[x, widest], lines[y, widest], SORTED * sigma, not other):
            i, j = x[i], y[j]
            count, left = np.zeros(len(i), np.int16), LINES
            for k in range(LINES):  # pairs that can't reach the count any more are left
                count += np.abs(lines[i, k] - lines[j, k]) <= WINDOW * sigma
                left -= 1
                if k % 8 == 7:
                    live = count + left >= least
                    i, j, count = i[live], j[live], count[live]
            near = np.einsum("ij,ij->i", vectors[i], vectors[j]) >= cosine
            i, j = i[near], j[near]
            # A pair counts in the first table where it meets.
            same = keys[i] == keys[j]
            first = keys[i, same.argmax(1)] == key if len(i) else near[:0]
            found.append((i[first], j[first]))
        i, j = (np.concatenate([f[c] for f in found]) for c in range(2))
        good = labels[i] == labels[j]
        i, j = i[good], j[good]
        if not len(i):
            return None
        links = np.bincount(i, weight[j], minlength=len(ids)) + np.bincount(j, weight[i], minlength=len(ids))
        root = ids.copy()
        while True:
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            if (low == root).all():
                break
            root = low
        some = links > 0
        return ids[some], links[some].astype(np.int64), root[some]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            if not t.num_rows:
                return
            c = {n: t.column(n).combine_chunks() if t.column(n).num_chunks != 1 else t.column(n).chunk(0) for n in t.column_names}
            num = {n: c[n].to_numpy(zero_copy_only=False) for n in ("key", "low", "high", "vec_id", "weight", "block")}
            flat, at = _vectors(c["vector"])
            keys, kat = _vectors(c["keys"])
            labels = np.array(c["label"].to_pylist(), object)
            new = np.append(True, (num["key"][1:] != num["key"][:-1]) | (num["low"][1:] != num["low"][:-1]) | (num["high"][1:] != num["high"][:-1]))
            edges = np.append(np.flatnonzero(new), t.num_rows)
            parts = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    got = unit(num["vec_id"][a:b], num["weight"][a:b], num["key"][a], (num["block"][a:b] != num["low"][a:b]).astype(int), num["low"][a] != num["high"][a], flat[at[a] : at[b]].reshape(b - a, -1), keys[kat[a] : kat[b]].reshape(b - a, -1), labels[a:b])
                    if got:
                        parts.append(got)
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["vec_id", "n", "root"])

        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            last = tuple(rest.column(n)[-1].as_py() for n in ("key", "low", "high"))
            k = rest.num_rows
            cols = [rest.column(n).to_numpy() for n in ("key", "low", "high")]
            open_ = (cols[0] == last[0]) & (cols[1] == last[1]) & (cols[2] == last[2])
            k = int(open_.argmax())  # rows are sorted: the last unit begins here
            yield from done(rest.slice(0, k))
            rest = rest.slice(k)
        if rest is not None:
            yield from done(rest)

    return work


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only vectors of one label (of any type; compared as text) and length are linked.  A null label or vector,
    a zero vector, or one with a null or non-finite component is linked with nothing.  Equal vectors of a
    label are one class before any comparison and link with each other; a repeated row is one more vector.
    Pairs at exactly the threshold, by double arithmetic, are linked.  Rows without vec_id are left out,
    extra columns ignored; an empty table gives no rows.

    A cell of any size is whole: its members are dealt to blocks, and each pair of blocks is a unit of
    its own."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label")).where("vec_id is not null")
    ready = staged(vectors.where("label is not null and embedding is not null").mapInArrow(_prepare, PREPARED), "vectors")
    classes = staged(ready.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("c")), "classes")
    member = staged(join_unique(ready.select("vec_id", "h1", "h2"), classes, ["h1", "h2"]).select("vec_id", "rep"), "member")
    reps = ready.join(classes.select("h1", "h2", F.col("rep").alias("vec_id"), F.col("c").alias("weight")), ["h1", "h2", "vec_id"]).dropDuplicates(["vec_id"])
    n = classes.count()
    lines, tables, width, least = calibrated(n, cosine)
    cells = reps.select("vec_id", "dim", "tag", "vector").mapInArrow(_cells(lines, tables, width), "vec_id long, keys array<long>")
    cells = staged(cells, "cells")
    one = cells.select("vec_id", F.explode("keys").alias("key"))
    full = one.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    met = join_unique(one, full, ["key"]).select("vec_id", "key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    met = met.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    dealt = met.select("vec_id", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("vec_id", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    full_rows = dealt.join(reps.select("vec_id", "label", "weight", "vector"), "vec_id").join(cells, "vec_id")
    sorted_ = full_rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    columns = ["key", "low", "high", "vec_id", "weight", "block", "vector", "keys", "label"]
    linked = staged(sorted_.select(*columns).mapInArrow(_link(cosine, least), LINKED), "linked")
    joined = components(linked.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("vec_id").agg(F.sum("n").alias("n"))
    of_class = classes.join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "c", "n", "component_id")
    found = join_unique(member, of_class, ["rep"]).select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    others = vectors.join(member.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(others).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_collision_projections(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
