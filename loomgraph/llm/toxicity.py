"""Operator 1: toxicity as severity grades, by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - t_k): one weight vector for all ordered thresholds t_1 < t_2 < ...
Features are the presence of words (and first letters of words) that a greater share of toxic than of
clean documents has, chosen by chi-square; the expected severity is the sum of P(grade > k)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefix, identified, list_array, mix, portions, slices, table, utf8

#: Hash places of words; the most of them that become features, and the least chi-square for it.
PLACES, MAX_FEATURES, MIN_CHI2 = 1 << 22, 4096, 30.0
#: Bound on the labelled documents that the weights are fitted on: half for each class, and in it
#: the same for each language, as far as there are so many (by a hash of ids).
FIT_DOCS = 20_000
STEPS, RATE, RIDGE = 800, 0.1, 1e-5

STEM = 4

#: Words are runs of ASCII letters and digits and bytes of other characters.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray, stem: int) -> tuple[np.ndarray, ...]:
    """Hash of each word (A-Z lowered; words are runs of bytes not in `between`), each document's first word, and
    the hash of each word's first `stem` bytes."""
    if not len(data):
        none = np.zeros(0, np.uint64)
        return none, np.zeros(len(offsets), np.int64), none
    data = LOWER[data]
    inside = ~between[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    begin[edge] = inside[edge]
    starts = np.flatnonzero(begin)
    # A word ends where white space or the next document begins.
    stop = ~inside
    stop[edge] = True
    stops = np.append(np.flatnonzero(stop), len(data))
    ends = stops[np.searchsorted(stops, starts, "right")]
    of = Prefix(data)
    return of(starts, ends), np.searchsorted(starts, offsets), of(starts, np.minimum(starts + stem, ends))


def places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash places of each word and of its first STEM bytes (inflected forms share them), and each
    document's first place."""
    h, first, stem = word_hashes(data, offsets, BETWEEN, STEM)
    both = np.column_stack([h, stem + np.uint64(1)]).reshape(-1)
    return (mix(both) & np.uint64(PLACES - 1)).astype(np.int64), 2 * first


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, clean, toxic): documents of a task that have a word at the place."""
    n = np.zeros((2, PLACES), np.int32)
    for b in portions(batches, 0):
        data, offsets = utf8(b.column(0))
        toxic = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in slices(offsets):
            at, first = places(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            doc = np.repeat(np.arange(j - i), np.diff(first))
            once = np.unique(doc * PLACES + at)
            np.add.at(n, (toxic[i:j][once // PLACES], once % PLACES), 1)
    some = np.flatnonzero(n.any(0))
    for a in range(0, len(some), 1 << 16):
        x = some[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n[0][x], pa.int64()), pa.array(n[1][x], pa.int64())], names=["place", "clean", "toxic"])


def features_of(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each document, end to end, and where each begins."""
    at, first = places(data, offsets)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    f = chosen[at]
    some = f >= 0
    pairs = np.unique(doc[some] * MAX_FEATURES + f[some])
    return pairs % MAX_FEATURES, np.searchsorted(pairs, np.arange(n + 1) * MAX_FEATURES)


def _features(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            data, offsets = utf8(b.column(1))
            for i, j in slices(offsets):
                f, begin = features_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shared.value)
                yield pa.RecordBatch.from_arrays([b.column(2).slice(i, j - i), list_array(f, begin, pa.int32()), b.column(3).slice(i, j - i)], names=["grade", "features", "weight"])

    return work


def fit(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, n_features: int, each: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model, by Adam on the whole (bounded) sample.

    rows, cols: document and feature of each entry of the sparse matrix.  each: how many labelled
    documents each one stands for (1 if not given)."""
    each = np.ones(len(grade)) if each is None else each
    top = int(grade.max()) if len(grade) else 0
    above = np.array([np.average(grade > k, weights=each) if len(grade) else 0.0 for k in range(max(top, 1))]).clip(1e-4, 1 - 1e-4)
    theta0 = np.maximum.accumulate(np.log((1 - above) / above))
    # Thresholds are the first one and positive gaps, so their order holds at every step.
    x = np.concatenate([np.zeros(n_features), theta0[:1], np.log(np.maximum(np.diff(theta0), 0.05))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    n = max(each.sum(), 1)
    for step in range(1, STEPS + 1):
        w, gaps = x[:n_features], np.exp(x[n_features + 1 :])
        theta = x[n_features] + np.append(0, np.cumsum(gaps))
        score = np.bincount(rows, w[cols], minlength=len(grade))
        p = 1 / (1 + np.exp(-(score[:, None] - theta)))  # P(grade > k)
        wall = np.column_stack([np.ones(len(p)), p, np.zeros(len(p))])
        own = np.maximum(wall[np.arange(len(p)), grade] - wall[np.arange(len(p)), grade + 1], 1e-9)
        slope = np.column_stack([np.zeros(len(p)), p * (1 - p), np.zeros(len(p))])
        up, down = slope[np.arange(len(p)), grade], slope[np.arange(len(p)), grade + 1]
        d_score = -(up - down) * each / own
        d_theta = np.zeros(len(theta) + 2)
        np.add.at(d_theta, grade, up * each / own)
        np.add.at(d_theta, grade + 1, -down * each / own)
        d_theta = d_theta[1:-1]
        tail = np.cumsum(d_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, d_score[rows], minlength=n_features) / n + RIDGE * w, tail[:1] / n, tail[1:] * gaps / n])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:n_features], x[n_features] + np.append(0, np.cumsum(np.exp(x[n_features + 1 :])))


RESULT = "doc_id long, expected_severity double, grade int, p_toxic double, is_toxic boolean"


def _predict(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, w, theta = shared.value
        for b in portions(batches):
            data, offsets = utf8(b.column(1))
            for i, j in slices(offsets):
                f, begin = features_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], chosen)
                sums = np.append(0, np.cumsum(w[f]))
                p = 1 / (1 + np.exp(-((sums[begin[1:]] - sums[begin[:-1]])[:, None] - theta)))
                each = -np.diff(np.column_stack([np.ones(j - i), p, np.zeros(j - i)]), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(p.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(p[:, 0]), pa.array(p[:, 0] >= 0.5)],
                    names=[x.split()[0] for x in RESULT.split(", ")],
                )

    return work


def level(sizes: list[int], bound: float) -> float:
    """The most that may be taken of each so that the sum is the bound; all of it where there is less."""
    left, among = bound, sorted(sizes)
    for k, n in enumerate(among):
        if n * (len(among) - k) >= left:
            return left / (len(among) - k)
        left -= n
    return float("inf")


def sampled(docs: DataFrame, marked: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, each) of about FIT_DOCS labelled documents, and how many of each class."""
    found = docs.select("doc_id", "lang").join(marked, "doc_id").groupBy("doc_id", "toxic").agg(F.coalesce(F.min("lang"), F.lit("")).alias("lang"))
    strata = [(r.toxic, r.lang, r["count"]) for r in found.groupBy("toxic", "lang").count().collect()]
    most = {c: level([n for k, _, n in strata if k == c], FIT_DOCS / 2) for c in (0, 1)}
    shares = [(c, x, min(1.0, most[c] / n)) for c, x, n in strata]
    shares = docs.sparkSession.createDataFrame(shares, "toxic int, lang string, share double")
    # A row for each class and language.
    few = found.join(F.broadcast(shares), ["toxic", "lang"]).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    sample = few.select("doc_id", "toxic", (1 / F.col("share")).alias("each"))
    return sample, {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}


def severity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document RESULT, from labels (doc_id, toxic 0/1).

    Labels carry no grades, so a toxic document's grade (1, 2 or 3) is the tertile, among toxic ones of
    the sample, of how many distinct features it has; a clean one's is 0.  Words are chosen and weights
    fitted on about FIT_DOCS labelled documents at most, drawn by class (and by language if docs has
    lang); in the fit each counts for as many as it was drawn from.

    Null and empty texts have no words: the model's least severity.  Rows without a label, or with a
    null one, teach nothing; a doc_id labelled twice counts by its greatest label.  Without any toxic
    and any clean label the severity is 0 for all.  Repeated documents give a row each; extra columns
    are ignored; empty tables give no rows."""
    spark = docs.sparkSession
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"))
    docs = identified(docs)
    marked = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample, size = sampled(labelled, marked)
    known = docs.join(F.broadcast(sample), "doc_id")  # the sample is bounded, so texts stay where they are read
    chosen, w, theta = np.full(PLACES, -1, np.int32), np.zeros(1), np.array([20.0])
    if len(size) == 2:
        counts = known.select("text", "toxic").mapInArrow(_frequencies, "place long, clean long, toxic long").groupBy("place").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        total = size[0] + size[1]
        expected = (F.col("clean") + F.col("toxic")) * (size[1] / total)
        chi2 = (F.col("toxic") - expected) ** 2 / expected / (1 - (F.col("clean") + F.col("toxic")) / (total + 1))
        best = counts.withColumn("chi2", chi2).where((F.col("chi2") >= MIN_CHI2) & (F.col("toxic") >= 3) & (F.col("toxic") * size[0] > F.col("clean") * size[1])).orderBy(F.desc("chi2"), "place").limit(MAX_FEATURES)
        best = [r.place for r in best.select("place").collect()]
        chosen[best] = np.arange(len(best))
        few = known.select("doc_id", "text", F.col("toxic").alias("grade"), "each")
        rows = few.mapInArrow(_features(spark.sparkContext.broadcast(chosen)), "grade int, features array<int>, weight double").toArrow()
        lists = rows.column("features").combine_chunks()
        lens = np.array(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        toxic = rows.column("grade").to_numpy() > 0
        cuts = np.quantile(lens[toxic], [1 / 3, 2 / 3]) if toxic.any() else [0, 0]
        grade = np.where(toxic, 1 + np.searchsorted(cuts, lens, "left"), 0)
        w, theta = fit(np.repeat(np.arange(len(lens)), lens), lists.flatten().to_numpy().astype(np.int64), grade, max(len(best), 1), rows.column("weight").to_numpy())
    return docs.mapInArrow(_predict(spark.sparkContext.broadcast((chosen, w, theta))), RESULT)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
