"""Shared helpers: staged tables in the cluster's shared folder, Arrow text
buffers, vectorised hashing, repeat detection and connected components."""

from __future__ import annotations

import hashlib
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text of which a Python worker holds the rows at a time, and of those that one vectorised step
#: works on; a longer document is a step of its own.
BATCH_BYTES, SLICE_BYTES = 1 << 22, 1 << 20
#: A key with more than 1/HOT of the rows is joined by broadcast: there are at most HOT of them.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def identified(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (and more) alone, so that extra columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs (doc_id, text, ...) where one doc_id has one text, and what its ids stand for (id, doc_id).

    Rows that have both in common are one document.  Where a doc_id has several texts (told by a 64-bit hash), all ids
    become places in the order of (doc_id, hash of the text), so each of the texts is a document of its own and marks of
    one never reach the other.  Where none has, docs is handed back, with None.  Rows without doc_id are left out."""
    docs = docs.where("doc_id is not null")
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    hashes = docs.select("doc_id", h.alias("h"))
    if not hashes.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").limit(1).count():
        return docs, None
    places = hashes.distinct().repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").withColumn("place", F.monotonically_increasing_id())
    places = staged(places, "places")
    others = [c for c in docs.columns if c != "doc_id"]
    apart = docs.withColumn("h", h).join(places, ["doc_id", "h"]).select(F.col("place").alias("doc_id"), *others)
    return apart, places.select(F.col("place").alias("id"), "doc_id")


def renamed(rows: DataFrame, names: DataFrame | None, column: str = "doc_id") -> DataFrame:
    """rows whose column holds ids of told_apart(), with the doc_id that each stands for."""
    if names is None:
        return rows
    held = rows.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("c")).join(names.withColumnRenamed("doc_id", "name"), "id")
    met = join_unique(rows.withColumn("id", F.col(column)), held, ["id"])
    return met.select(*[F.col("name").alias(column) if c == column else F.col(c) for c in rows.columns])


def bounded(marks: np.ndarray, limits: np.ndarray) -> None:
    """Places of marks lie within their documents; anything else is an error, never a mark in another document."""
    if len(marks) and ((marks < 0) | (marks >= limits)).any():
        raise ValueError("a mark lies outside its document")


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for each key and `c`, the rows that left has of it.

    Keys with more than 1/HOT of all rows would each fill one task; there are at most HOT of them, and they
    are joined by broadcast, so no row of left with such a key is shuffled.  left is read twice."""
    right = staged(right, "joined")
    total = right.agg(F.sum("c")).first()[0] or 0
    hot = right.where(F.col("c") > total / HOT)
    kinds = hot.count()
    if not kinds:
        return left.join(right, keys, how)
    near, far = F.broadcast(hot), right.where(F.col("c") <= total / HOT)
    return left.join(near, keys).unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(far, keys, how))


def carried(docs: DataFrame, keep: tuple[str, ...]) -> str:
    """The schema of columns that an operator hands on as they are."""
    return "".join(f", `{name}` {docs.schema[name].dataType.simpleString()}" for name in keep)


def hand_on(out: pa.RecordBatch, b: pa.RecordBatch, keep: tuple[str, ...], i: int) -> pa.RecordBatch:
    """out with the kept columns of as many rows of b from row i on."""
    more = [b.column(b.schema.get_field_index(name)).slice(i, out.num_rows) for name in keep]
    return pa.RecordBatch.from_arrays([*out.columns, *more], names=[*out.schema.names, *keep])


# ---------------------------------------------------------------- Arrow text


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins; nulls are empty."""
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most so many bytes (or one document)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def portions(batches: Iterator[pa.RecordBatch], *columns: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of text in these columns (column 1 if not given)."""
    for b in batches:
        offsets = sum(utf8(b.column(c))[1] for c in columns or (1,))
        for i, j in slices(offsets, most):
            yield b.slice(i, j - i)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lengths[i]-1, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def text_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings from bytes laid end to end."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the bytes from a[i] and from b[i] on are the same, lengths[i] (at least 1) of them."""
    if not len(a):
        return np.zeros(0, bool)
    differ = data[ragged(a, lengths)] != data[ragged(b, lengths)]
    return ~np.logical_or.reduceat(differ, np.append(0, np.cumsum(lengths)[:-1]))


# ------------------------------------------------------------------- hashing

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))


BYTE_CODES = seeded(256, 11)


def digest(raw: bytes) -> tuple[int, int]:
    """Two 64-bit halves of a cryptographic digest: what stands for a string where it decides a result."""
    return HALVES.unpack(hashlib.blake2b(raw, digest_size=16).digest())


HALVES = struct.Struct("<QQ")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        n = max(n, SLICE_BYTES + 1)
        for name, base in (("up", BASE), ("down", INVERSE)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


class Prefix:
    """Polynomial hashes of any substring of a byte array, from one running sum.

    Equal strings have equal hashes.  Different ones may have, too (there are known pairs), so these hashes
    only choose what is compared, or what is left out of a comparison."""

    def __init__(self, data: np.ndarray, codes: np.ndarray = BYTE_CODES):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def every(self, k: int) -> np.ndarray:
        """Of each k bytes in a row."""
        n = len(self.sums) - 1 - k + 1
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


# ------------------------------------------------------------------- repeats

REPEAT_ROWS = "key long, h1 long, h2 int, doc_id long, pos long, known boolean"
REPEATS = "h1 long, doc_id long, pos long"


def rows_of_batch(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, pos: np.ndarray, sure: np.ndarray | None = None) -> pa.RecordBatch:
    """REPEAT_ROWS of what one batch holds.  The least (doc, pos) of each digest stands for the
    batch; its other rows are known repeats and go to a place of their own (key), so a hot digest
    sends one row a batch to its group.  Rows that are `sure` are known to repeat by themselves."""
    sure = np.zeros(len(h1), bool) if sure is None else sure
    by = np.lexsort((pos, doc, h2, h1))
    h1, h2, doc, pos, sure = h1[by], h2[by], doc[by], pos[by], sure[by]
    own = np.ones(len(h1), bool)  # a place counts once, though its row be repeated
    own[1:] = (h1[1:] != h1[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
    h1, h2, doc, pos, sure = h1[own], h2[own], doc[own], pos[own], sure[own]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    after = np.append(~new[1:], False)
    key = np.where(new, h1, mix(doc.astype(np.uint64) * np.uint64(BASE) + pos.astype(np.uint64)))
    known = np.where(new, after | sure, True)
    # A known repeat that is not its batch's first has h2 = -1: it is never compared.
    columns = [key.view(np.int64), h1.view(np.int64), np.where(new, h2, -1).astype(np.int32), doc, pos, known]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "h1", "h2", "doc_id", "pos", "known"])


def _repeats(firsts: bool) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # digest, held-back first row
        held = place = None

        def out(h1, doc, pos):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h1, doc, pos)], names=["h1", "doc_id", "pos"])

        for b in batches:
            h1, h2, doc, pos, known = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc_id", "pos", "known"))
            if not len(h1):
                continue
            real = h2 >= 0
            same = np.zeros(len(h1), bool)
            same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]) & real[1:]
            same[0] = bool(real[0]) and last == (h1[0], h2[0])
            follow = np.append(same[1:], False)
            first = real & ~same
            keep = ~first | known | follow if firsts else ~first
            again = same[1:] & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])  # one place in two batches
            keep[1:] &= ~again
            if same[0] and place == (doc[0], pos[0]):
                keep[0] = False
            place = (doc[-1], pos[-1])
            if firsts and held is not None and same[0]:
                yield out(*([x] for x in held))
            # The last group may go on in the next batch; its first row waits if nothing is known of it yet.
            held = None
            if first[-1] and not known[-1]:
                held = (h1[-1], doc[-1], pos[-1])
            last = (h1[-1], h2[-1]) if real[-1] else None
            if keep.any():
                yield out(h1[keep], doc[keep], pos[keep])

    return work


def repeats(rows: DataFrame, firsts: bool) -> DataFrame:
    """Of REPEAT_ROWS, the places whose digest occurs more than once; without `firsts` only those
    after the least (doc_id, pos).  One shuffle; each task streams over sorted rows."""
    dealt = rows.repartition("key").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    return dealt.mapInArrow(_repeats(firsts), REPEATS)


# ---------------------------------------------------------------- components


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component_id) of every vertex of edges (a, b): the smallest vertex that it reaches.

    Alternating large-star and small-star steps: hubs are joined with an aggregated minimum, so no
    neighbour list is ever gathered.  Each round is a staged table; it ends when nothing changes."""
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = staged(now, "edges")
    was = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = staged(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if was == mark or mark[0] == 0:
            break
        was = mark
    else:
        raise RuntimeError("components: more rounds are needed")
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return roots.union(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
