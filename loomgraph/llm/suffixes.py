"""Operator 2: exact removal of repeated byte strings by a collection BWT.

A string of `length` bytes is dealt by its minimizer (the k-mer of least hash in it): strings that are
equal have equal minimizers, and neighbours that share one form a run.  Runs whose minimizer occurs
once in the whole corpus hold nothing that repeats.  The runs of the other minimizers meet by
minimizer, equal runs become one, and what is left of each task is indexed column by column: each
round inserts one more symbol of every run, from the right, into the Burrows-Wheeler transform of the
collection and updates its longest common prefixes, reading and writing both in sequence.  Rows of the
index with common prefixes of at least `length` are equal strings.

What is column-wise and what is not: a round inserts one symbol of each run of a task's collection, not one of
each document of the corpus; a run is at most 227 bytes, so there are at most 227 rounds.  The sequential files of
the method are arrays of the task, at most INDEX_BYTES of text at a time (or one minimizer's runs, if they are
more): executors keep nothing in local folders, and a Spark job for each symbol of the longest document would be
as many jobs as that has bytes.  Runs that are equal as a whole are compared byte by byte before the index is
built, and runs of which no part about their minimizer recurs are left out of it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REPEAT_ROWS, Prefix, bounded, identified, join_unique, mix, portions, ragged, renamed, repeats, rows_of_batch, same_bytes, slices, staged, table, told_apart, utf8

LENGTH = 100
#: Bytes of a minimizer; of one that splits the runs of a very common minimizer further; and how common.
MINIMIZER, FINER, COMMON = 48, 84, 4096
#: Windows of a run at most, and bytes of text indexed together.
RUN, INDEX_BYTES = 128, 1 << 16
#: Divisions of a window's text about its minimizer by which runs that can't repeat are left out.
SIDES = 8
#: Rows of runs gathered before they are indexed.
GATHER = 16_384
END = 0  # the symbol before a whole run; text symbols are one more than their byte (UTF-8 has no 0xFF)


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row, by doubling."""
    m, size = h, 1
    while 2 * size <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    rest = w - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def minimizer_runs(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and minimizer of each run, in order, and whether it has the minimizer
    twice so that windows of its own can be equal; no run crosses documents."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none.astype(bool)
    h = Prefix(data).every(k)
    least = sliding_least(h, length - k + 1)
    lens = np.diff(offsets)
    n = np.maximum(lens - length + 1, 0)
    at = ragged(offsets[:-1], n)
    if not len(at):
        return none, none, none.astype(np.uint64), none.astype(bool)
    value = least[at]
    new = np.append(True, (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    # Where the next window goes on without the minimizer that this one begins with, there is another.
    twice = (h[at] == value) & ~np.append(new[1:], True)
    twice = np.add.reduceat(twice, begin) > 0
    parts = -(-size // RUN)
    first = np.repeat(at[begin], parts) + RUN * ragged(np.zeros(len(parts), np.int64), parts)
    end = np.repeat(at[begin] + size, parts)
    return first, np.minimum(end - first, RUN), np.repeat(value[begin], parts), np.repeat(twice, parts)


def _run_rows(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(b.column(1))
            parts = []
            for i, j in slices(offsets):
                o = offsets[i : j + 1] - offsets[i]
                start, n, key, twice = minimizer_runs(data[offsets[i] : offsets[j]], o, length, MINIMIZER)
                doc = np.searchsorted(o, start, "right") - 1
                parts.append((key, np.zeros(len(key), np.int32), ids[i + doc], start - o[doc], twice))
            if parts:
                yield rows_of_batch(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return work


CONTENT = "key long, content binary, doc_id long, start long, twin boolean"


def _contents(length: int):
    """Rows CONTENT of the marked runs of each document (marks: 2*start, plus 1 for a very common minimizer)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(b.column(1))
            for i, j in slices(offsets):
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                marks = b.column(2).slice(i, j - i)
                lens = pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False)
                flat = marks.flatten().to_numpy(zero_copy_only=False)
                if not len(flat):
                    continue
                bounded(flat // 2, np.repeat(np.diff(o), lens))
                place = np.repeat(o[:-1], lens) + flat // 2
                start, n, key, _ = minimizer_runs(d, o, length, MINIMIZER)
                common = np.zeros(len(start), bool)
                own = np.searchsorted(start, place)
                common[own] = flat % 2 == 1
                marked = np.zeros(len(start), bool)
                marked[own] = True
                if common.any():  # split further, alike wherever the minimizer occurs
                    s2, n2, key2, _ = minimizer_runs(d, o, length, FINER)
                    edges = np.unique(np.concatenate([start, s2]))
                    coarse, fine = np.searchsorted(start, edges, "right") - 1, np.searchsorted(s2, edges, "right") - 1
                    end = np.minimum(start[coarse] + n[coarse], s2[fine] + n2[fine])
                    pick = common[coarse]
                    edges, end, coarse, fine = edges[pick], end[pick], coarse[pick], fine[pick]
                    keep = marked & ~common
                    start = np.concatenate([start[keep], edges])
                    n = np.concatenate([n[keep], end - edges])
                    key = np.concatenate([key[keep], mix(key[coarse] + np.uint64(3) * key2[fine])])
                else:
                    start, n, key = start[marked], n[marked], key[marked]
                end = start + n + length - 1
                doc = np.searchsorted(o, start, "right") - 1
                # Equal runs of the batch: the first one (doc_id, start) stands for all.
                who, local = ids[i + doc], start - o[doc]
                h = Prefix(d)(start, end)
                by = np.lexsort((local, who, h))
                twin = np.zeros(len(by), bool)
                first, whole = start[by], (end - start)[by]
                same = (h[by][1:] == h[by][:-1]) & (whole[1:] == whole[:-1])
                pair = np.flatnonzero(same)
                same[pair] = same_bytes(d, first[pair], first[pair + 1], whole[pair])
                twin[by[1:]] = same
                again = np.zeros(len(by), bool)  # a repeated row of one document
                again[by[1:]] = same & (who[by][1:] == who[by][:-1]) & (local[by][1:] == local[by][:-1])
                size = np.where(twin, 0, end - start)
                at = np.append(0, np.cumsum(size)).astype(np.int32)
                raw = d[ragged(start, size)].tobytes()
                spread = np.where(twin, mix(who.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + local.astype(np.uint64)), key)
                out = pa.RecordBatch.from_arrays(
                    [pa.array(spread.view(np.int64)), pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw)]), pa.array(who), pa.array(np.where(twin, local * 256 + n, local)), pa.array(twin)],
                    names=[x.split()[0] for x in CONTENT.split(", ")],
                )
                yield out.filter(pa.array(~again))

    return work


def build_index(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """BWT, longest common prefixes, and string and suffix length of each row, of a collection of
    strings of at most 254 bytes.

    Round j holds the sorted suffixes of up to j symbols.  The symbol that precedes a string's newest
    suffix is what its next suffix begins with; the place of that suffix is found as in backward
    search, and the common prefix with a neighbour is one more than the least one between the rows
    that both came from."""
    lens = np.diff(offsets)
    n = len(lens)
    symbols = data + np.uint8(1)
    last = offsets[1:] - 1
    order = np.arange(n)
    bwt = np.where(lens > 0, symbols[np.maximum(last, 0)], END).astype(np.uint8)
    lcp = np.zeros(n, np.uint8)
    row = order.astype(np.int32) * 256
    place = order.copy()  # row of each string's newest suffix
    live = np.flatnonzero(lens > 0)
    j = 0
    while len(live):
        size = len(bwt)
        newest = np.zeros(size, bool)
        newest[place[live]] = True
        # Backward search for all rows: a stable sort of the transform.
        by = np.argsort(bwt, kind="stable")
        skip = int(np.count_nonzero(bwt == END))
        spot = np.flatnonzero(newest[by])
        p = by[spot]
        live = row[p] >> 8  # the strings, now in the order of their new suffixes
        c = bwt[p]
        q = spot - skip + n
        # Rows next to it that begin with the same symbol, and the least common prefix between.
        padded = np.append(lcp, np.uint8(0))
        before = by[np.maximum(spot - 1, 0)]
        has_before = (spot > skip) & (bwt[before] == c)
        after = by[np.minimum(spot + 1, size - 1)]
        has_after = (spot + 1 < size) & (bwt[after] == c)
        new_lcp = np.zeros(len(live), np.uint8)
        if has_before.any():
            pairs = np.column_stack([before[has_before] + 1, p[has_before] + 1]).reshape(-1)
            new_lcp[has_before] = np.minimum.reduceat(padded, pairs)[::2] + 1
        next_lcp = np.zeros(len(live), np.uint8)
        if has_after.any():
            pairs = np.column_stack([p[has_after] + 1, after[has_after] + 1]).reshape(-1)
            next_lcp[has_after] = np.minimum.reduceat(padded, pairs)[::2] + 1
        # One sequential pass writes the files anew.
        total = size + len(live)
        fresh = np.zeros(total, bool)
        fresh[q] = True
        old = ~fresh
        bwt2, lcp2, row2 = np.empty(total, np.uint8), np.empty(total, np.uint8), np.empty(total, np.int32)
        bwt2[old], lcp2[old], row2[old] = bwt, lcp, row
        j += 1
        ahead = offsets[1:][live] - 1 - j
        bwt2[q] = np.where(lens[live] > j, symbols[np.maximum(ahead, 0)], END)
        row2[q] = live * 256 + j
        lcp2[q] = new_lcp
        follow = q[has_after] + 1
        lcp2[follow] = next_lcp[has_after]
        bwt, lcp, row = bwt2, lcp2, row2
        place[live] = q
        live = live[lens[live] > j]
    return bwt, lcp, row // 256, row % 256


def repeated_windows(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every window that also lies at an earlier (doc, place)."""
    _, lcp, string, size = build_index(data, offsets)
    in_class = lcp >= length
    head = in_class.copy()
    head[:-1] |= in_class[1:]
    rows = np.flatnonzero(head)
    if not len(rows):
        return rows, rows
    group = np.cumsum(~in_class[rows])
    s = string[rows]
    off = np.diff(offsets)[s] - size[rows]
    by = np.lexsort((start[s] + off, doc[s], group))
    later = np.append(False, group[by][1:] == group[by][:-1])
    return s[by][later], off[by][later]


SPANS = "doc_id long, a long, b long"


def _index(length: int):
    """Removed spans, from rows sorted by key, content, doc_id and start."""

    def index(c: dict, rows: np.ndarray) -> list:
        """Of distinct runs: INDEX_BYTES of whole keys at a time."""
        data, at = c["data"], c["at"]
        size = np.diff(at)[rows]
        d = data[ragged(at[:-1][rows], size)]
        o = np.append(0, np.cumsum(size))
        s, off = repeated_windows(d, o, c["doc_id"][rows], c["start"][rows], length)
        if not len(s):
            return []
        by = np.lexsort((off, s))
        s, off = s[by], off[by]
        new = np.append(True, (s[1:] != s[:-1]) | (off[1:] != off[:-1] + 1))
        first = np.flatnonzero(new)
        end = np.append(first[1:], len(s)) - 1
        base = c["start"][rows][s[first]]
        return [(c["doc_id"][rows][s[first]], base + off[first], base + off[end] + length)]

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        if not t.num_rows:
            return
        c = {x: t.column(x).combine_chunks() if t.column(x).num_chunks != 1 else t.column(x).chunk(0) for x in t.column_names}
        c["data"], c["at"] = utf8(c.pop("content"))
        for x in ("key", "doc_id", "start", "twin"):
            c[x] = c[x].to_numpy(zero_copy_only=False)
        size, twin, key, start = np.diff(c["at"]), c["twin"], c["key"], c["start"]
        parts = []
        if twin.any():
            a = start[twin] // 256
            parts.append((c["doc_id"][twin], a, a + start[twin] % 256 + length - 1))
        rows = np.flatnonzero(~twin)
        if len(rows):
            of = Prefix(c["data"])
            h = of(c["at"][:-1][rows], c["at"][1:][rows])
            same = np.append(False, (key[rows][1:] == key[rows][:-1]) & (h[1:] == h[:-1]) & (size[rows][1:] == size[rows][:-1]))
            pair = np.flatnonzero(same)
            same[pair] = same_bytes(c["data"], c["at"][:-1][rows[pair]], c["at"][:-1][rows[pair - 1]], size[rows[pair]])
            own = np.append(False, (c["doc_id"][rows][1:] == c["doc_id"][rows][:-1]) & (start[rows][1:] == start[rows][:-1]))
            later = rows[same & ~own]
            parts.append((c["doc_id"][later], start[later], start[later] + size[later]))
            rows = rows[~same]
            rows = rows[_may_repeat(c["data"], c["at"], rows, length)]
            _, first = np.unique(key[rows], return_index=True)
            edges = np.append(np.sort(first), len(rows))
            total = np.append(0, np.cumsum(size[rows]))
            a = 0
            while a < len(edges) - 1:
                b = max(a + 1, int(np.searchsorted(total[edges], total[edges[a]] + INDEX_BYTES, "right")) - 1)
                b = min(b, len(edges) - 1)
                parts += index(c, rows[edges[a] : edges[b]])
                a = b
        parts = [x for x in parts if len(x[0])]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["doc_id", "a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, least = [], 0, GATHER
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows < least:
                continue
            t = pa.concat_tables(held)
            key = t.column("key").to_numpy()
            k = int((key == key[-1]).argmax())  # the last key may go on
            if k:
                yield from done(t.slice(0, k))
            held, rows = [t.slice(k)], t.num_rows - k
            least = max(GATHER, 2 * rows)  # a key of many rows is looked at after each doubling
        if held:
            yield from done(pa.concat_tables(held))

    return work


def _may_repeat(data: np.ndarray, at: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    """Which runs can hold a window that repeats.  It holds the run's minimizer, and the rest of it lies
    on both sides; for one of SIDES divisions of the rest, what they have in common repeats too."""
    rest = length - MINIMIZER
    step = -(-rest // SIDES)
    size = np.diff(at)[rows]
    out = np.zeros(len(rows), bool)
    if not len(rows):
        return out
    d = data[ragged(at[:-1][rows], size)]
    o = np.append(0, np.cumsum(size))
    of = Prefix(d)
    n = size - MINIMIZER + 1
    where = ragged(o[:-1], n)
    h = of.every(MINIMIZER)[where]
    run = np.repeat(np.arange(len(rows)), n)
    hit = h == np.minimum.reduceat(h, np.append(0, np.cumsum(n)[:-1]))[run]
    p, run = where[hit], run[hit]
    for left in range(0, rest, step):
        right = max(rest - left - step, 0)
        ok = (p - left >= o[run]) & (p + MINIMIZER + right <= o[run + 1])
        _, which, count = np.unique(of(p[ok] - left, p[ok] + MINIMIZER + right), return_inverse=True, return_counts=True)
        out[run[ok][count[which] > 1]] = True
    return out


RESULT = "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in portions(batches):
        data, offsets = utf8(b.column(1))
        for i, j in slices(offsets):
            d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            cover = np.zeros(len(d) + 1, np.int32)
            for column, sign in ((2, 1), (3, -1)):
                marks = b.column(column).slice(i, j - i)
                lens = pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False)
                at = marks.flatten().to_numpy(zero_copy_only=False)
                bounded(at, np.repeat(np.diff(o) + 1, lens))  # a span may end where its document does
                np.add.at(cover, np.repeat(o[:-1], lens) + at, sign)
            gone = np.cumsum(cover[:-1]) > 0
            doc = np.repeat(np.arange(j - i), np.diff(o))
            begin = gone.copy()
            begin[1:] &= ~(gone[:-1] & (doc[1:] == doc[:-1]))
            removed = np.bincount(doc[gone], minlength=j - i)
            spans = np.bincount(doc[begin], minlength=j - i)
            raw = d[~gone].tobytes()
            at = np.append(0, np.cumsum(np.diff(o) - removed))
            kept = [raw[at[x] : at[x + 1]] for x in range(j - i)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()), pa.array(np.diff(o)), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                names=[x.split()[0] for x in RESULT.split(", ")],
            )


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document RESULT: what is left when each byte covered by a string of `length` bytes that also
    starts earlier (smaller doc_id, or same document and earlier start) is gone.

    Null text is empty, texts shorter than `length` stay whole, texts of any length are whole.  Of equal strings
    the first by doc_id and start stays.  Cuts may fall inside a code point; then
    `text` drops the broken one, while kept_sha256 is of the bytes.  A repeated row is the same document
    at the same place: it does not repeat itself.  Different texts of one doc_id are documents of their own, in the
    order of a hash of the text.  Rows without doc_id are left out, extra columns ignored; an empty table gives
    no rows."""
    if not FINER < length <= 254 - RUN:
        raise ValueError(f"length is over {FINER} and at most {254 - RUN}")
    docs, names = told_apart(identified(docs))
    rows = docs.mapInArrow(_run_rows(length), REPEAT_ROWS)
    found = staged(repeats(rows, firsts=True), "runs")
    common = found.groupBy("h1").agg(F.count("*").alias("c")).where(F.col("c") > COMMON).withColumn("common", F.lit(1))
    marks = join_unique(found, common, ["h1"], "left").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("pos") * 2 + F.coalesce("common", F.lit(0)))).alias("marks"))
    contents = docs.join(marks, "doc_id").select("doc_id", "text", "marks").mapInArrow(_contents(length), CONTENT)
    dealt = contents.repartition("key").sortWithinPartitions("key", "content", "doc_id", "start")
    spans = dealt.mapInArrow(_index(length), SPANS).groupBy("doc_id").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    return renamed(docs.join(spans, "doc_id", "left").select("doc_id", "text", "a", "b").mapInArrow(_remove, RESULT), names)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("text")
