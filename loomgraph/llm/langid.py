"""Operator 6: language identification by character language models.

For each language an interpolated Kneser-Ney model of order 4 over lower-cased characters.  The
highest order uses counts, lower orders the number of distinct left contexts.  All counts come from
one distributed pass over every training document; the models of all languages share one sorted
array of n-gram hashes with a directory over its leading bits, and one matrix of log probabilities.
More 4-grams than one broadcast should hold are dealt to several models by their two middle characters,
and documents are scored by each in turn."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, hand_on, identified, list_array, mix, portions, slices, staged, table, utf8

ORDER = 4
#: 4-grams (all languages) that one broadcast holds; if there are more, they are dealt to several models.
MAX_GRAMS = 1 << 20
#: Width of the rejection in standard deviations.
REJECT_SIGMAS = 8.0
#: Nats that a short text may lie higher, over the root of its length.
SHORT = 6.0
DIRECTORY_BITS = 20
#: 0 is the start of a document, 1 any run of characters without a letter; letters above 0xFFFF share one code.
EDGE, GAP, ASTRAL = 0, 1, 0xFFFF


def _codes() -> np.ndarray:
    """The code of every code point: a letter's (by its Unicode category) in lower case, or GAP."""
    out = np.full(0x110000, GAP, np.uint16)
    for i in range(2, 0x110000):
        c = chr(i)
        if c.isalpha():
            x = c.lower()
            out[i] = ord(x) if len(x) == 1 and ord(x) < ASTRAL else min(i, ASTRAL)
    return out


_tables: list = []


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of each document: EDGE, then letters in lower case with GAP for each run between them;
    where each document begins; and whether it has a letter."""
    if not _tables:
        _tables.append(_codes())
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    at = np.append(0, np.cumsum(lead))[offsets]
    if len(points) != at[-1]:  # not UTF-8: each wrong byte became a mark of its own
        parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        at = np.append(0, np.cumsum([len(x) for x in parts]))
    codes = _tables[0][points]
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    gap = codes == GAP
    has = np.bincount(doc, ~gap, minlength=n) > 0
    keep = ~gap
    keep[1:] |= ~gap[:-1] | (doc[1:] != doc[:-1])
    if len(keep):
        keep[0] = True
    lens = np.bincount(doc[keep], minlength=n) + 1
    begin = np.append(0, np.cumsum(lens))
    out = np.zeros(int(begin[-1]), np.uint16)
    place = np.ones(len(out), bool)
    place[begin[:-1]] = False
    out[place] = codes[keep]
    return out, begin, has


def grams(codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each character, as four 16-bit codes; EDGE goes before a document."""
    c = codes.astype(np.uint64)
    out = c.copy()
    for k in range(1, ORDER):
        before = np.zeros(len(c), np.uint64)
        before[k:] = c[:-k]
        for j in range(k):  # positions nearer than k to the document's start
            at = begin[:-1] + j
            at = at[at < begin[1:]]
            before[at] = EDGE
        out |= before << np.uint64(16 * k)
    return out


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task, merged whenever 2**21 of them are held."""
    held: dict[str, list] = {}
    size = 0

    def merged():
        for lang, parts in held.items():
            g, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            u, where = np.unique(g, return_inverse=True)
            held[lang] = [(u, np.bincount(where, n).astype(np.int64))]

    for b in portions(batches):
        langs = np.array(b.column(2).to_pylist(), object)
        data, offsets = utf8(b.column(1))
        for i, j in slices(offsets):
            codes, begin, _ = characters(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            g = grams(codes, begin)
            scored = np.ones(len(g), bool)
            scored[begin[:-1]] = False
            each = np.repeat(langs[i:j], np.diff(begin))
            for lang in set(langs[i:j]):
                u, n = np.unique(g[scored & (each == lang)], return_counts=True)
                held.setdefault(lang, []).append((u, n.astype(np.int64)))
                size += len(u)
        if size > 1 << 21:
            merged()
            size = sum(len(p[0]) for parts in held.values() for p in parts)
    merged()
    for lang, parts in held.items():
        for u, n in parts:
            for a in range(0, len(u), 1 << 16):
                k = len(u[a : a + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array(u[a : a + k].view(np.int64)), pa.array(n[a : a + k])], names=["lang", "gram", "n"])


def discounts(ones: np.ndarray, twos: np.ndarray) -> np.ndarray:
    return np.where(ones + twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5).clip(0.1, 0.9)


class Model:
    """Log probabilities of every seen n-gram of orders 1 to 4, by language, in sorted hash arrays.

    Of several models each has the 4-grams (and 3-grams) of some middle characters, `part` of `parts`; then
    `pairs` are the 2-grams (lang, gram, n) of all, and `cuts` the discounts of orders 3 and 4 over all."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, part: int = 0, parts: int = 1, pairs: tuple | None = None, cuts: dict[int, np.ndarray] | None = None):
        self.langs, self.part, self.of = langs, part, parts
        k = len(langs)
        counts = {ORDER: (lang, gram, n.astype(float))}
        for o in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters to the left
            if o == 2 and pairs is not None:
                counts[o] = pairs
                continue
            la, g, _ = counts[o + 1]
            low = g & np.uint64((1 << 16 * o) - 1)
            pair, c = np.unique(np.stack([la.astype(np.uint64), low]), axis=1, return_counts=True)
            counts[o] = (pair[0].astype(np.int64), pair[1], c.astype(float))
        letters = max(2, len(np.unique(counts[1][1])) + 1)
        known, below = None, None
        self.parts = []
        for o in range(1, ORDER + 1):
            la, g, c = counts[o]
            ones, twos = (np.array([((c == v) & (la == x)).sum() for x in range(k)], float) for v in (1, 2))
            cut = cuts[o] if cuts and o in cuts else discounts(ones, twos)
            context = g >> np.uint64(16)
            ctx, where = np.unique(np.stack([la.astype(np.uint64), context]), axis=1, return_inverse=True)
            total, kinds = np.bincount(where, c), np.bincount(where)
            weight = cut[ctx[0].astype(int)] * kinds / total
            alls = np.unique(g)
            ctxs = np.unique(context)
            # Probability of each n-gram in each language: of the order below, unless the context is known.
            base = np.full((len(alls), k), 1.0 / letters) if o == 1 else below[np.searchsorted(known, alls & np.uint64((1 << 16 * (o - 1)) - 1))]
            back = np.ones((len(ctxs), k))
            back[np.searchsorted(ctxs, ctx[1]), ctx[0].astype(int)] = weight
            p = base * back[np.searchsorted(ctxs, alls >> np.uint64(16))]
            p[np.searchsorted(alls, g), la] += np.maximum(c - cut[la], 0) / total[where]
            self.parts.append((alls, np.log(p), ctxs, np.log(back)))
            known, below = alls, p
        self.floor = -np.log(letters)
        self.sorted = []
        for alls, logs, ctxs, back in self.parts:
            self.sorted.append((self._arrays(alls, logs), self._arrays(ctxs, back)))
        self.parts = []

    @staticmethod
    def _arrays(keys: np.ndarray, values: np.ndarray):
        h = mix(keys + np.uint64(0x9E3779B97F4A7C15))
        by = np.argsort(h)
        bits = np.uint64(64 - DIRECTORY_BITS)
        start = np.searchsorted(h[by], np.arange(1 << DIRECTORY_BITS, dtype=np.uint64) << bits).astype(np.int32)
        return h[by], values[by].astype(np.float32), start

    @staticmethod
    def find(arrays, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1: a directory over the leading bits, then a short walk."""
        h, _, start = arrays
        key = mix(keys + np.uint64(0x9E3779B97F4A7C15))
        at = start[(key >> np.uint64(64 - DIRECTORY_BITS)).astype(np.int64)].astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        last = len(h) - 1
        while len(left):
            here = np.minimum(at[left], last)
            got = h[here]
            hit = got == key[left]
            out[left[hit]] = here[hit]
            on = (got < key[left]) & (at[left] < last)
            left = left[on]
            at[left] += 1
        return out

    def log_probabilities(self, gram: np.ndarray) -> np.ndarray:
        """Of each 4-gram's last character in each language (rows distinct grams)."""
        out = np.zeros((len(gram), len(self.langs)), np.float32)
        left = np.arange(len(gram))
        for o in range(ORDER, 0, -1):
            (full, context) = self.sorted[o - 1]
            g = gram[left] & np.uint64((1 << 16 * o) - 1 if o < 4 else (1 << 64) - 1)
            row = self.find(full, g)
            hit = row >= 0
            out[left[hit]] += full[1][row[hit]]
            left, g = left[~hit], g[~hit]
            if not len(left):
                return out
            row = self.find(context, g >> np.uint64(16))
            seen = row >= 0
            out[left[seen]] += context[1][row[seen]]
        out[left] += np.float32(self.floor)
        return out

    def log_likelihoods(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum over the characters of each document (those of this part) in each language, whether the
        document has a letter, and its length."""
        codes, begin, has = characters(data, offsets)
        scored = np.ones(len(codes), bool)
        scored[begin[:-1]] = False
        g = grams(codes, begin)[scored]
        u, where = np.unique(g, return_inverse=True)
        n = np.diff(begin) - 1
        sums = np.zeros((len(n), len(self.langs)))
        if len(u):
            mine = part_of(u, self.of) == self.part
            logs = np.zeros((len(u), len(self.langs)), np.float32)
            logs[mine] = self.log_probabilities(u[mine])
            some = np.flatnonzero(n)
            first = (begin[:-1] - np.arange(len(n)))[some]
            for k in range(len(self.langs)):
                sums[some, k] = np.add.reduceat(logs[:, k].astype(float)[where], first)
        return sums, has, n


#: A prime, so that close characters are dealt to different parts.
SPREAD = 1_000_003


def part_of(gram: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 4-gram, by its two middle characters: all that its probability needs of orders 3 and 4 has them too."""
    return ((gram >> np.uint64(16)) & np.uint64(0xFFFFFFFF)) % np.uint64(SPREAD) % np.uint64(parts)


def train(docs: DataFrame, max_grams: int | None = None) -> tuple[list[str], int, Callable[[int], Model]]:
    """Languages of (doc_id, text, lang) rows, how many models there are, and what makes each; rows without
    lang or text teach nothing.  Every row is counted and every 4-gram kept."""
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counted = staged(rows.mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    parts = max(1, -(-counted.count() // (max_grams or MAX_GRAMS)))
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
    code = {x: i for i, x in enumerate(langs)}

    def arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = df.select("lang", "gram", "n").toArrow()
        lang = np.array([code[x] for x in got.column("lang").to_pylist()], np.int64)
        return lang, got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()

    if parts == 1:
        return langs, 1, lambda part: Model(langs, *arrays(counted))
    # What a part can't tell from its own 4-grams.
    three = staged(counted.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 48) - 1)).alias("gram")).agg(F.count("*").alias("n")), "grams")
    pairs = arrays(three.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 32) - 1)).alias("gram")).agg(F.count("*").alias("n")))
    pairs = (pairs[0], pairs[1], pairs[2].astype(float))
    cuts = {}
    for o, df in ((ORDER, counted), (ORDER - 1, three)):
        few = {r.lang: r for r in df.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()}
        cuts[o] = discounts(*(np.array([few[x][c] for x in langs], float) for c in ("ones", "twos")))
    part = F.shiftrightunsigned("gram", 16).bitwiseAND(F.lit((1 << 32) - 1)) % SPREAD % parts
    return langs, parts, lambda i: Model(langs, *arrays(counted.where(part == i)), i, parts, pairs, cuts)


def _outcome(langs: list[str], sums: np.ndarray, has: np.ndarray, n: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    """PREDICTED of documents from their log likelihoods."""
    h = -sums / np.maximum(n, 1)[:, None]
    best = h.argmin(1)
    low = h[np.arange(len(n)), best]
    # Of the languages, by their perplexities: 1 if all others are far, 1/k if all are alike.
    score = np.where(has, 1 / np.exp((low[:, None] - h) * 20).sum(1), 0.0)
    pred = [langs[k] if ok else "und" for k, ok in zip(best, has, strict=True)]
    return pa.RecordBatch.from_arrays([ids, pa.array(pred, pa.string()), pa.array(score), pa.array(np.where(has, low, np.nan)), pa.array(np.maximum(n, 1))], names=["doc_id", "lang_pred", "score", "cross_entropy", "n"])


def _cross_entropy(model, keep: tuple[str, ...] = ()):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in portions(batches):
            data, offsets = utf8(b.column(1))
            for i, j in slices(offsets):
                found = m.log_likelihoods(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield hand_on(_outcome(m.langs, *found, b.column(0).slice(i, j - i)), b, keep, i)

    return work


def _partial(model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in portions(batches):
            data, offsets = utf8(b.column(1))
            for i, j in slices(offsets):
                sums, has, n = m.log_likelihoods(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = np.arange(j - i + 1) * len(m.langs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), list_array(sums.reshape(-1), at, pa.float64()), pa.array(has), pa.array(n)], names=["row", "sums", "has", "n"])

    return work


def _summed(langs: list[str], keep: tuple[str, ...]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = np.column_stack([b.column(b.schema.get_field_index(f"s{k}")).to_numpy(zero_copy_only=False) for k in range(len(langs))])
            has, n = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("has", "n"))
            yield hand_on(_outcome(langs, sums, has, n, b.column(0)), b, keep, 0)

    return work


def _score(docs: DataFrame, langs: list[str], models: list, make: Callable[[int], Model], parts: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """PREDICTED and the columns to keep of each row of docs (doc_id, text, ...)."""
    schema = PREDICTED + carried(docs, keep)
    if parts == 1:
        return docs.mapInArrow(_cross_entropy(models[0], keep), schema)
    # One broadcast at a time; only sums are shuffled.  Rows get a number as doc_ids may repeat.
    docs = staged(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    some = None
    for i in range(parts):
        shared = docs.sparkSession.sparkContext.broadcast(make(i))
        one = staged(docs.select("row", "text").mapInArrow(_partial(shared), "row long, sums array<double>, has boolean, n long"), "sums")
        shared.destroy()
        some = one if some is None else some.union(one)
    total = some.groupBy("row").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(len(langs))], F.first("has").alias("has"), F.first("n").alias("n"))
    both = docs.join(total, "row").select("doc_id", *[f"s{k}" for k in range(len(langs))], "has", "n", *keep)
    return both.mapInArrow(_summed(langs, keep), schema)


PREDICTED = "doc_id long, lang_pred string, score double, cross_entropy double, n long"


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, training: DataFrame, sigmas: float = REJECT_SIGMAS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, lang_pred, score (0 to 1), cross_entropy, rejected, and the
    columns to keep.

    `training` has doc_id, text, lang.  `und`, score 0 and rejected: null or letterless text, or no
    training rows at all.  A document is also rejected if its cross-entropy is over the mean of its
    language by so many standard deviations, both over all training rows predicted as it (over all
    rows for a language that none is predicted as), plus SHORT over the root of its length.  Ties go to
    the first language in order.  Every character of a text counts, however long it is.  Repeated rows give a row each; extra columns are ignored; an empty
    table gives no rows."""
    spark = docs.sparkSession
    docs = identified(docs, *[c for c in keep if c != "text"])
    training = identified(training, F.col("lang").cast("string").alias("lang"))
    langs, parts, make = train(training)
    if not langs:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"), *keep)
    models = [spark.sparkContext.broadcast(make(0))] if parts == 1 else []
    fit = _score(training.where("lang is not null and text is not null").select("doc_id", "text"), langs, models, make, parts).where("lang_pred <> 'und'")
    moments = (F.mean("cross_entropy").alias("m"), F.coalesce(F.stddev("cross_entropy"), F.lit(0.0)).alias("s"))
    level = {r.lang_pred: (r.m, r.s) for r in fit.rollup("lang_pred").agg(*moments).collect()}  # None: all languages
    limit = F.create_map(*[F.lit(x) for k in langs for x in (k, (lambda m, s: m + sigmas * max(s, 0.05))(*level.get(k, level.get(None, (float("inf"), 0.0)))))])
    out = _score(docs, langs, models, make, parts, keep)
    wide = limit[F.col("lang_pred")] + SHORT / F.sqrt("n")
    return out.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("cross_entropy") > wide)).drop("n")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), docs.where(~held_out()).select("doc_id", "text", "lang"))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
