"""Operator 7: substring dedup by content-defined chunks.

A gear rolling hash over the last 32 bytes decides, from content alone, where a chunk ends, so an
insertion moves no boundary but those next to it.  Chunks are compared by 95 bits of a cryptographic digest; each one
after the first place (smallest doc_id, then position) is a duplicate, and runs of adjacent
duplicate chunks of at least `min_run` bytes are removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REPEAT_ROWS, bounded, carried, digest, hand_on, identified, portions, ragged, renamed, repeats, rows_of_batch, seeded, slices, text_array, told_apart, utf8

GEAR = (seeded(256, 77) >> np.uint64(32)).astype(np.uint32)
WINDOW = 32
#: Mean bytes of a chunk (a power of two) and least bytes of a removed run.
MEAN_CHUNK, MIN_RUN = 32, 64


def gear(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """h[i] = 2*h[i-1] + GEAR[byte] modulo 2**32, afresh in each document, by doubling the window."""
    h = GEAR[data]
    lengths = np.diff(offsets)
    m = 1
    while m < WINDOW:
        before = np.zeros_like(h)
        before[m:] = h[:-m] << np.uint32(m)
        before[ragged(offsets[:-1], np.minimum(lengths, m))] = 0
        h = h + before
        m *= 2
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Ends (exclusive) of the chunks of all documents; no chunk ends inside a code point."""
    if not len(data):
        return np.zeros(0, np.int64)
    h = gear(data, offsets)
    cut = (h >> np.uint32(32 - (mean.bit_length() - 1))) == 0
    following = np.append(data[1:], 0)
    cut &= (following & 0xC0) != 0x80
    cut[offsets[1:][np.diff(offsets) > 0] - 1] = True
    return np.flatnonzero(cut) + 1


def _chunks(data, offsets, mean):
    """starts, ends, document index and ordinal of each chunk."""
    ends = chunk_ends(data, offsets, mean)
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    doc = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(starts, offsets[:-1])
    return starts, ends, doc, np.arange(len(ends)) - first[doc]


def chunk_rows(mean: int = MEAN_CHUNK):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(b.column(1))
            parts = []
            for i, j in slices(offsets):
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, doc, pos = _chunks(d, o, mean)
                if len(starts):
                    raw = d.tobytes()
                    h = np.array([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
                    parts.append((h[:, 0], (h[:, 1] >> np.uint64(33)).astype(np.int32), ids[i + doc], pos))
            if parts:
                yield rows_of_batch(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return work


RESULT = "doc_id long, text string, n_bytes long, n_chunks long, n_duplicates long, n_removed long, n_spans long, kept_sha256 string"


def remove_chunks(mean: int = MEAN_CHUNK, min_run: int = MIN_RUN, keep: tuple[str, ...] = ()):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            ids = b.column(0)
            data, offsets = utf8(b.column(1))
            marks = b.column(2)
            for i, j in slices(offsets):
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                n = j - i
                starts, ends, doc, pos = _chunks(d, o, mean)
                first = np.searchsorted(doc, np.arange(n + 1))
                dup = np.zeros(len(starts), bool)
                some = marks.slice(i, n)
                lens = pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False)
                flat = some.flatten().to_numpy(zero_copy_only=False)
                bounded(flat, np.repeat(np.diff(first), lens))
                dup[np.repeat(first[:-1], lens) + flat] = True
                # Runs of adjacent duplicates within a document.
                begin = dup.copy()
                begin[1:] &= ~(dup[:-1] & (doc[1:] == doc[:-1]))
                run = np.cumsum(begin) - 1
                size = np.bincount(run[dup], (ends - starts)[dup], minlength=int(begin.sum())) if dup.any() else np.zeros(0)
                gone = dup.copy()
                gone[dup] = size[run[dup]] >= min_run
                spans = np.bincount(doc[begin & gone], minlength=n)
                count = lambda w, doc=doc, n=n: np.bincount(doc, w, minlength=n).astype(np.int64)
                removed = count((ends - starts) * gone)
                kept = d[~np.repeat(gone, ends - starts)]
                lengths = np.diff(o) - removed
                text = text_array(kept, lengths)
                at = np.append(0, np.cumsum(lengths))
                raw = kept.tobytes()
                sha = [hashlib.sha256(raw[at[x] : at[x + 1]]).hexdigest() for x in range(n)]
                out = pa.RecordBatch.from_arrays(
                    [ids.slice(i, n), text, pa.array(np.diff(o)), pa.array(np.diff(first)), pa.array(count(dup * 1.0)), pa.array(removed), pa.array(spans.astype(np.int64)), pa.array(sha, pa.string())],
                    names=[x.split()[0] for x in RESULT.split(", ")],
                )
                yield hand_on(out, b, keep, i)

    return work


def dedup_substrings(docs: DataFrame, mean: int = MEAN_CHUNK, min_run: int = MIN_RUN, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document RESULT: its text without repeated chunk runs, and their figures; and the columns to keep.

    Null or empty text: no chunks, nothing removed, empty text kept.  Rows without doc_id are left out.
    Repeated rows of one doc_id and text count as one document: the same place is never its own duplicate, so
    both keep the text.  Different texts of one doc_id are documents of their own, in the order of a hash of the text.
    Texts of any length are whole; extra columns are ignored; an empty table gives none.

    Digests are shuffled, texts once (to meet the marks of their document)."""
    docs, names = told_apart(identified(docs, *keep))
    rows = docs.select("doc_id", "text").mapInArrow(chunk_rows(mean), REPEAT_ROWS)
    later = repeats(rows, firsts=False)
    marks = later.groupBy("doc_id").agg(F.collect_set(F.col("pos").cast("int")).alias("marks"))
    left = docs.join(marks, "doc_id", "left").select("doc_id", "text", "marks", *keep).mapInArrow(remove_chunks(mean, min_run, keep), RESULT + carried(docs, keep))
    return renamed(left, names)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text")
