"""Operator 13: ranked lexical search as a product of sparse matrices in blocks.

One matrix has a row for each item and a column for each term, and holds how often the item has the term; the other has a
row for each term and a column for each document, and holds whole-number impacts.  Items come in blocks that fit a
broadcast.  Each task takes documents in blocks, sorts their postings by term, and merges the term rows of an item, row by
row as in Gustavson's product, into one accumulator the width of the block; the best of each block are merged with
the best so far, so that a task hands on `k` documents an item."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import identified, portions, ragged, staged, table

#: Documents of an item, and bytes of item texts that are broadcast together.
TOP, ITEM_BYTES = 20, 1 << 22
#: Postings of documents that are multiplied together.
BLOCK = 1 << 20
#: Lists of an item that are first merged apart: a task's list goes to one of them.
MERGES = 64
#: Letters and digits of ASCII, lower-cased, and every byte of a longer code point; anything else parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order."""
    return (text or "").encode().translate(TERM_BYTES).split()


class Items:
    """The matrix of one block of items by rows, and its vocabulary."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.ids = [i for i, _ in rows]
        self.rows = []
        for _, text in rows:
            held = Counter(self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms(text))
            self.rows.append((np.fromiter(held.keys(), np.int64, len(held)), np.fromiter(held.values(), np.int64, len(held))))


POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"


def _postings(vocabulary):
    """Each document's terms of the vocabulary, how often it has each, and how many terms it has in all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        size = max(len(known), 1)
        for b in portions(batches):
            words = [terms(t) for t in b.column(1).to_pylist()]
            n = np.fromiter(map(len, words), np.int64, len(words))
            found = np.fromiter(map(known.get, chain.from_iterable(words), repeat(-1)), np.int64, int(n.sum()))
            doc = np.repeat(np.arange(len(n)), n)
            cells, tf = np.unique(doc[found >= 0] * size + found[found >= 0], return_counts=True)
            at = np.searchsorted(cells, np.arange(len(n) + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (cells % size, tf)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return work


def best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores of each item, equal ones by doc_id."""
    by = np.lexsort((doc, -score, item))
    new = np.append(True, item[by][1:] != item[by][:-1])
    first = np.flatnonzero(new)
    place = np.arange(len(by)) - first[np.cumsum(new) - 1]
    return by[place < k]


def _search(items, weights, docs: int, total: int, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, w = items.value, weights.value
        held = [np.zeros(0, np.int64) for _ in range(3)]  # item, score, doc_id: the best so far

        def block(ids: np.ndarray, n: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray) -> list[np.ndarray]:
            doc = np.repeat(np.arange(len(ids)), np.diff(at))
            m = 75 + 25 * n * docs // total
            impact = w[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            by = np.argsort(term, kind="stable")
            column, impact = doc[by], impact[by]
            begin = np.searchsorted(term[by], np.arange(len(w) + 1))
            length = np.diff(begin)
            sums = np.zeros(len(ids), np.int64)
            found = [held]
            for i, (own, often) in enumerate(rows):
                cell = ragged(begin[own], length[own])
                if not len(cell):
                    continue
                sums[:] = 0
                np.add.at(sums, column[cell], impact[cell] * np.repeat(often, length[own]))
                hit = np.flatnonzero(sums)
                if len(hit) > k:
                    hit = hit[sums[hit] >= np.partition(sums[hit], len(hit) - k)[len(hit) - k]]
                hit = hit[best(np.zeros(len(hit), np.int64), sums[hit], ids[hit], k)]
                found.append([np.full(len(hit), i), sums[hit], ids[hit]])
            joined = [np.concatenate(x) for x in zip(*found, strict=True)]
            top = best(*joined, k)
            return [x[top] for x in joined]

        for b in batches:
            ids, n = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            at = b.column(2).offsets.to_numpy().astype(np.int64)
            term, tf = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            at = at - at[0]
            i = 0
            while i < len(ids):
                j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
                held = block(ids[i:j], n[i:j], at[i : j + 1] - at[i], term[at[i] : at[j]], tf[at[i] : at[j]])
                i = j
        task = np.full(len(held[0]), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*held, task)], names=["item", "score", "doc_id", "task"])

    return work


def _items(items: DataFrame, most: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of about so many bytes of text (or one item)."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    rows = staged(rows, "items")
    size = rows.agg(F.sum(F.least(F.coalesce(F.octet_length("text"), F.lit(0)) + 16, F.lit(most)))).first()[0] or 0
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(-(-size // most), 1)))
    for (i,) in rows.select(block.alias("block")).distinct().orderBy("block").collect():
        yield [tuple(r) for r in rows.where(block == i).collect()]


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k documents of highest score, equal ones by doc_id.

    A null or empty text has no terms and is found by nothing, nor does it count.  Rows without doc_id, and items without item_id,
    are left out; rows of one doc_id are documents of their own; of items of one item_id the least text counts.
    An item none of whose terms any document has, gives no rows.  Texts of any length are whole; extra columns are ignored;
    an empty table gives no rows.

    Texts are read once for each block of items (ITEM_BYTES of their text), which is all that the driver and
    a broadcast hold; documents are never shuffled, only k rows of each task and item."""
    spark = docs.sparkSession
    rows, none = identified(docs).where("doc_id is not null"), spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = none
    for chosen in _items(items, item_bytes):
        matrix = Items(chosen)
        found = staged(rows.mapInArrow(_postings(spark.sparkContext.broadcast(matrix.vocabulary)), POSTINGS), "postings")
        n_docs, total = found.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        weights = np.zeros(max(len(matrix.vocabulary), 1), np.int64)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
        shared = [spark.sparkContext.broadcast(x) for x in (matrix.rows, weights)]
        top = found.mapInArrow(_search(*shared, n_docs, total, k), "item long, score long, doc_id long, task int")
        order = (F.col("score").desc(), F.col("doc_id"))
        part = Window.partitionBy("item", F.pmod("task", F.lit(MERGES))).orderBy(*order)
        some = top.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
        last = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(matrix.ids)), "item long, item_id long")
        out = out.unionByName(last.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def sql() -> str:
    """The same as DuckDB SQL."""
    found = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return f"""WITH q AS (SELECT item_id, term, count(*) AS often FROM (SELECT item_id, {found} AS term FROM benchmark) GROUP BY ALL),
    p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {found} AS term FROM documents) GROUP BY ALL),
    d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
    t AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
    f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p CROSS JOIN t GROUP BY term),
    s AS (SELECT item_id, doc_id, CAST(sum(often * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
        FROM q JOIN p USING (term) JOIN f USING (term) JOIN d USING (doc_id) CROSS JOIN t GROUP BY item_id, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
    QUALIFY rank <= {TOP}"""
