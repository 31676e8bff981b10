"""Operator 3: near-duplicate documents by min-max hashing.

Each permutation of the shingle universe gives two signature values, the least and the greatest
image of the set, so 2*n values cost n hash evaluations; both agree with probability equal to the
Jaccard similarity.  Values are banded; documents that share a band are candidates, and a candidate
pair is linked only if its full sets reach the threshold."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, digest, identified, join_unique, list_array, mix, portions, renamed, seeded, slices, staged, told_apart, utf8

#: Five words and a similarity of 0.8 unless a caller says otherwise.
WORDS, PERCENT = 5, 80
#: 20 bands of 4 values (40 permutations): a pair at 0.8 is missed with probability 2.7e-5.
BANDS, ROWS = 20, 4


def word_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A cryptographic 64-bit digest of each word (A-Z lowered; words are runs of bytes other than 0x20 and 0x09
    to 0x0D), and each document's first word.  Each distinct word is digested once."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    each = [t.lower().split() for t in texts]
    first = np.append(0, np.cumsum([len(w) for w in each])).astype(np.int64)
    at = np.fromiter((number[w] for words in each for w in words), np.int64, int(first[-1]))
    return np.array([digest(w)[0] for w in number], np.uint64)[at], first


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle digests of each document, end to end, and where each set begins."""
    h, first = word_digests(texts)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    begin = np.append(0, np.cumsum(count))
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(doc)) - begin[doc] + first[doc]
    acc = h[at]
    for t in range(1, words):
        more = at + t < first[doc + 1]
        acc[more] = mix(acc[more] * np.uint64(0xD6E8FEB86659FD93) + h[at[more] + t])
    sets = [np.unique(acc[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    return (np.concatenate(sets) if sets else acc), np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int64)


def full_set(text: bytes, words: int) -> set:
    """The shingles themselves, as tuples of words."""
    w = text.lower().split()
    return set(zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else {tuple(w)} - {()}


def strings(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw, at = data.tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"


def signatures(words: int, bands: int, rows: int):
    permutations = bands * rows // 2
    factors = seeded(permutations, 101) | np.uint64(1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            ids = b.column(0)
            data, offsets = utf8(b.column(1))
            for i, j in slices(offsets):
                sets, at = shingle_sets(strings(data, offsets[i : j + 1]), words)
                n = np.diff(at)
                some = np.flatnonzero(n)
                where = at[:-1][some]
                sums = np.zeros((2, j - i), np.uint64)
                values = np.zeros((len(some), bands * rows), np.uint64)
                if len(some):
                    sums[0, some] = np.add.reduceat(mix(sets), where)
                    sums[1, some] = np.add.reduceat(mix(sets + np.uint64(0x5851F42D4C957F2D)), where)
                    for k in range(permutations):
                        image = sets * factors[k]
                        values[:, 2 * k] = np.minimum.reduceat(image, where)
                        values[:, 2 * k + 1] = np.maximum.reduceat(image, where)
                keys = np.zeros((len(some), bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + values[:, r::rows])
                keys += seeded(bands, 7)
                lens = np.zeros(j - i, np.int64)
                lens[some] = bands
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), list_array(keys.reshape(-1).view(np.int64), np.append(0, np.cumsum(lens)), pa.int64())],
                    names=["doc_id", "n_shingles", "s1", "s2", "bands"],
                )

    return work


def confirm(words: int, percent: int):
    """Of (a, b, text_a, text_b), the pairs whose full sets, compared word by word, reach the threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 2, 3):
            good = []
            for x, y in zip(strings(*utf8(b.column(2))), strings(*utf8(b.column(3))), strict=True):
                u, v = full_set(x, words), full_set(y, words)
                both = len(u & v)
                good.append(both > 0 and 100 * both >= percent * (len(u) + len(v) - both))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return work


def shingle_lists(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            data, offsets = utf8(b.column(1))
            for i, j in slices(offsets):
                sets, at = shingle_sets(strings(data, offsets[i : j + 1]), words)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), list_array(sets.view(np.int64), at, pa.int64())], names=["doc_id", "shingles"])

    return work


def prefix_pairs(texts: DataFrame, placed: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can reach the threshold, by prefix filtering.

    Sets of n shingles that overlap enough share one of their n - ceil(t*n) + 1 rarest.  What differs
    between the texts of a group is rare, so its texts meet only where they may be alike enough; no
    pair at the threshold is lost."""
    one = texts.mapInArrow(shingle_lists(words), "doc_id long, shingles array<long>").select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    one = staged(one, "shingles")
    often = one.groupBy("s").agg(F.count("*").alias("c"))
    ranked = join_unique(one, often, ["s"]).groupBy("doc_id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("c", "s"))).alias("by"))
    length = F.expr(f"int(n - ceil({percent} * n / 100) + 1)")
    prefix = ranked.select(F.col("doc_id").alias("rep"), "n", F.posexplode(F.slice("by", 1, length)).alias("at", "x")).where("x.c > 1")
    prefix = staged(prefix.join(placed, "rep").select("rep", "n", "component_id", "at", F.col("x.s").alias("s")), "prefix")
    other = prefix.select(F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("component_id").alias("c2"), F.col("at").alias("at2"), "s")
    # At the first shingle in common, what follows it must make up the least overlap.
    enough = f"least(n - at, n2 - at2) * {100 + percent} >= {percent} * (n + n2)"
    met = prefix.join(other, "s").where("rep > b and component_id <> c2").where(f"100 * least(n, n2) >= {percent} * greatest(n, n2)").where(enough)
    return met.select(F.col("rep").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    A set is the distinct `words`-word shingles; fewer words make one shingle of all; null, empty or
    blank text has an empty set, is linked with nothing and kept.  Rows without doc_id are left out;
    a repeated row gives a row each time; different texts of one doc_id are documents of their own, and those of a
    component are called by its smallest doc_id.  Texts of any length are whole.  Extra columns are ignored; an
    empty table gives no rows.

    Equal sets (by two 64-bit sums over cryptographic word digests) are one class before any pairing.  In
    each band bucket all classes are compared with the one that has most company, ties by smallest doc_id.
    The classes of buckets that this leaves in several components are compared by a prefix filter, which
    loses no pair at the threshold; so a bucket of thousands of copies costs a few rows a copy.  A link
    between classes counts only if the texts' shingles, compared as words, reach the threshold."""
    docs, names = told_apart(identified(docs))
    signed = staged(docs.mapInArrow(signatures(words, bands, rows), SIGNED), "signed")
    some = signed.where("n_shingles > 0")
    key = ["s1", "s2", "n_shingles"]
    classes = some.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1")
    classed = join_unique(some, classes, key, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), "bands")
    member = staged(classed.drop("bands").union(signed.where("n_shingles = 0").selectExpr("doc_id", "n_shingles", "doc_id AS rep")), "member")
    of_reps = classed.where("doc_id = rep").dropDuplicates(["doc_id"])
    banded = staged(of_reps.select("rep", "n_shingles", F.explode("bands").alias("key")), "banded")
    sizes = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = staged(join_unique(banded, sizes, ["key"]), "shared")
    candidates = shared.select(F.col("rep").alias("doc_id")).distinct()
    texts = staged(docs.join(candidates, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(confirm(words, percent), "a long, b long")

    # A class's score is the company it has over all buckets: the origin of a group of copies is met by
    # most of them, so the best of each bucket is compared with all others first.
    score = shared.groupBy("rep").agg(F.sum("c").alias("score"))
    best = F.max(F.struct("score", (-F.col("rep")).alias("minus"), F.col("n_shingles").alias("n2")))
    pivots = shared.join(score, "rep").groupBy("key").agg(best.alias("p"), F.first("c").alias("c")).select("key", (-F.col("p.minus")).alias("other"), "p.n2", "c")
    close = f"100 * least(n_shingles, n2) >= {percent} * greatest(n_shingles, n2)"
    met = join_unique(shared.drop("c"), pivots, ["key"]).where("rep <> other").where(close)
    stars = staged(met.select(F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b")).distinct(), "pairs")
    links = staged(linked(stars), "links")
    joined = components(links)
    # Buckets of three or more classes that this left in several components.
    placed = shared.where("c > 2").join(joined.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    placed = staged(placed.select("key", "rep", "component_id"), "placed")
    mixed = placed.groupBy("key").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y"), F.count("*").alias("c")).where("x <> y").select("key", "c")
    open_ = staged(join_unique(placed, mixed, ["key"]).select("rep", "component_id").distinct(), "open")
    pairs = prefix_pairs(texts.join(open_.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), open_, words, percent)
    found = staged(linked(pairs.join(stars, ["a", "b"], "left_anti")), "links")
    if found.limit(1).count():
        joined = components(links.union(found))
    joined = joined.withColumnRenamed("id", "rep").join(member.groupBy("rep").agg(F.count("*").alias("c")), "rep")
    component = F.coalesce("component_id", "rep")
    found = join_unique(member, joined, ["rep"], "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return renamed(renamed(found, names), names, "component_id").withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2, percent=80)
