"""The training-data operators against brute force, and on odd tables."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chunks, langid, licenses, minhash, mixing, pieces, projections, queries, spotsigs, suffixes, toxicity
from loomgraph.llm.common import Prefix, components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n)) + f" end{seed}"


LONG = prose(7, 20000)
ODD = [(0, None, "en", "s"), (1, "", None, "s"), (2, "  \n ", "en", None), (3, "one", "en", "s"), (4, "123 456", "en", "s"), (5, LONG, "en", "s"), (6, LONG + " tail", "en", "t"), (7, prose(1, 300), "de", "s"), (8, prose(1, 300), "de", "s"), (9, "né ▁ 日本 🙂 " + prose(2, 60), "fr", "s"), (9, "né ▁ 日本 🙂 " + prose(2, 60), "fr", "s")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumn("key", F.lit(1)).withColumn("rep", F.lit("x")).withColumn("n", F.lit(2))


def texts(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]


def one_by_id(df):
    return {r.doc_id: r for r in df.collect()}


def brute_repeats(rows, length=100):
    seen, out = {}, {}
    for i, text in rows:
        b = (text or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            if seen.setdefault(w, (i, a)) != (i, a):
                cover[a] += 1
                cover[a + length] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_index_is_the_sorted_suffixes():
    rng = np.random.default_rng(1)
    for _ in range(10):
        s = [bytes(rng.integers(97, 100, rng.integers(1, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 12))]
        offsets = np.append(0, np.cumsum([len(x) for x in s]))
        bwt, lcp, string, size = suffixes.build_index(np.frombuffer(b"".join(s), np.uint8), offsets)
        got = [(s[i][len(s[i]) - n :], int(i)) for i, n in zip(string, size, strict=True)]
        assert got == sorted((x[k:], i) for i, x in enumerate(s) for k in range(len(x) + 1))
        for a in range(1, len(got)):
            x, y = got[a - 1][0], got[a][0]
            n = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert lcp[a] == n
        assert all((b == 0) == (n == len(s[i])) and (b == 0 or b - 1 == s[i][len(s[i]) - n - 1]) for b, i, n in zip(bwt, string, size, strict=True))


def test_suffix_dedup(spark, sf_dir, odd):
    got = one_by_id(queries.QUERIES["op2_suffix_dedup"](spark, sf_dir))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == brute_repeats(texts(spark, sf_dir))
    got = one_by_id(suffixes.remove_repeats(odd))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == brute_repeats(sorted({r[0]: r[1] for r in ODD}.items()))


def test_suffix_dedup_of_common_and_periodic_text(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "COMMON", 3)
    line = "Share this very common line of some eighty bytes with all that you know, always!"
    rows = [(i, prose(i, 30) + line + prose(100 + i, 30)) for i in range(12)] + [(20, "ab" * 400), (21, "ab" * 90 + prose(3, 30)), (22, "a" * 120)]
    got = one_by_id(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == brute_repeats(rows)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(sets, percent=80):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_minhash(spark, sf_dir, odd):
    sets = {i: shingles(t, 2) for i, t in texts(spark, sf_dir)}
    got = one_by_id(queries.QUERIES["op3_minhash_near_dedup"](spark, sf_dir))
    want = brute_components(sets)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}
    got = one_by_id(minhash.near_duplicates(odd))
    assert {i: r.component_id for i, r in got.items()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9}


def test_minhash_group_without_a_common_origin(spark):
    base = prose(5, 200).split()
    rows = [(i, " ".join([*base[: 200 - 12 * i], *(f"x{i}y{k}" for k in range(12 * i))])) for i in range(8)] + [(50, " ".join(base[:150]))]
    sets = {i: shingles(t, 2) for i, t in rows}
    got = one_by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2))
    assert {i: r.component_id for i, r in got.items()} == brute_components(sets)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200)], "a long, b long")
    assert {(r.id, r.component_id) for r in components(edges).collect()} == {(i, 1) for i in range(1, 41)} | {(100, 100), (200, 100)}


def test_chunks(spark, sf_dir, odd):
    passage = prose(50, 60)
    rows = [(1, prose(60, 80) + " " + passage + " " + prose(61, 80)), (2, prose(62, 70) + " x " + passage + " " + prose(63, 90)), (3, prose(64, 150))]
    got = one_by_id(chunks.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1].n_removed == got[3].n_removed == 0 and got[1].text == rows[0][1]
    assert 0.5 * len(passage) < got[2].n_removed <= len(passage) + 2 and got[2].kept_sha256 == hashlib.sha256(got[2].text.encode()).hexdigest()
    got = one_by_id(chunks.dedup_substrings(odd, keep=("lang",)))
    assert got[0].text == got[1].text == "" and got[8].text == "" and got[7].text == ODD[7][1] and got[9].text == ODD[9][1] and got[9].lang == "fr"
    want = brute_chunks(texts(spark, sf_dir))
    assert {i: (r.n_removed, r.kept_sha256) for i, r in one_by_id(queries.QUERIES["op7_substring_dedup"](spark, sf_dir)).items()} == {i: (n, hashlib.sha256(t).hexdigest()) for i, (n, t) in want.items()}


def brute_chunks(rows):
    """By hand: the hash of each byte, cuts, whole chunks compared; what is removed and left of each document."""
    seen, out = set(), {}
    for i, t in rows:
        b, h, start, parts = t.encode(), 0, 0, []
        for k, c in enumerate(b):
            h = ((h << 1) + int(chunks.GEAR[c])) % 2**32
            last = k + 1 == len(b)
            if last or (h >> 27 == 0 and (b[k + 1] & 0xC0) != 0x80):
                parts.append(b[start : k + 1])
                start = k + 1
        flags = []
        for p in parts:
            flags.append(p in seen)
            seen.add(p)
        removed, run, left = 0, [], []
        for p, f in [*zip(parts, flags, strict=True), (b"", False)]:
            if f:
                run.append(p)
                continue
            if sum(map(len, run)) >= chunks.MIN_RUN:
                removed += sum(map(len, run))
            else:
                left += run
            run = []
            left.append(p)
        out[i] = (removed, b"".join(left))
    return out


def test_language(spark, sf_dir, odd):
    got = queries.QUERIES["op6_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 0.02 * len(got)
    train = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = one_by_id(langid.identify(odd, train))
    assert [r[i].lang_pred for i in (0, 1, 2, 4)] == ["und"] * 4 and r[0].rejected and r[0].score == 0 and len(r) == 10
    assert {x.lang_pred for x in langid.identify(odd, train.limit(0)).collect()} == {"und"}


def test_language_limits_come_from_all_training_documents(spark):
    rng = np.random.default_rng(4)
    rare = "uno dos tres cuatro cinco seis siete ocho nueve diez".split()
    rows = [(i, " ".join(rng.choice(WORDS, 8)), "en") for i in range(12000)]
    # Ids that a sample of a third by hash would leave out.
    ids = [r.id for r in spark.range(20000, 20100).where("pmod(xxhash64(id), 1 << 30) > (1 << 29)").limit(6).collect()]
    rows += [(i, " ".join(rng.permutation(rare)), "xx") for i in ids]
    junk = "".join(rng.permutation(list(" ".join(rare) * 30))).replace(" ", "")
    docs = spark.createDataFrame([(1, junk), (2, " ".join(rng.permutation(rare)))], "doc_id long, text string")
    got = one_by_id(langid.identify(docs, spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert got[1].lang_pred == got[2].lang_pred == "xx" and got[1].rejected and not got[2].rejected


def test_language_keeps_every_gram(spark, monkeypatch, odd):
    rows = [(i, prose(i, 40), "en") for i in range(60)] + [(100, "uno dos tres cuatro cinco seis siete", "xx"), (101, "ocho nueve diez once doce trece", "xx")]
    training = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = training.union(odd.select("doc_id", F.substring("text", 1, 500), "lang"))
    values = lambda: sorted((r.doc_id, r.lang_pred, round(r.score, 4), round(r.cross_entropy or 0, 4) if r.lang_pred != "und" else 0, r.rejected, r.source) for r in langid.identify(docs.withColumn("source", F.lit("s")), training, keep=("source",)).collect())
    want = values()
    assert {v[1] for v in want if v[0] in (100, 101)} == {"xx"}
    monkeypatch.setattr(langid, "MAX_GRAMS", 100)
    monkeypatch.setattr(langid.train, "__defaults__", tuple(100 if x else x for x in langid.train.__defaults__))
    assert values() == want


def test_language_model_sums_to_one():
    m = langid.Model(["a"], np.zeros(3, int), np.array([0x0005_0006_0007_0008, 0x0005_0006_0007_0009, 0x0001_0006_0007_0008], np.uint64), np.array([3, 1, 2]))
    seen = np.array([0x0005_0006_0007_0000 + c for c in (8, 9)], np.uint64)
    other = np.array([0x0005_0006_0007_0077], np.uint64)
    p = np.exp(m.log_probabilities(np.concatenate([seen, other]))[:, 0].astype(float))
    assert abs(p.sum() - 1) < 1e-6 and p[0] > p[1] > p[2] > 0


def test_pieces(spark, odd):
    p = pieces.load()
    table = {p.data[p.offsets[i] : p.offsets[i + 1]].tobytes(): p.score[i] for i in range(len(p.score)) if not p.is_byte[i] and p.offsets[i + 1] > p.offsets[i]}

    def best(text):
        b = b" " + text.encode()
        out = [0.0] + [-1e18] * len(b)
        for i in range(len(b)):
            w = 1
            while i + w < len(b) and (b[i + w] & 0xC0) == 0x80:
                w += 1
            out[i + w] = max(out[i + w], out[i] + p.fallback * w)
            for k in range(1, min(64, len(b) - i) + 1):
                if b[i : i + k] in table:
                    out[i + k] = max(out[i + k], out[i] + table[b[i : i + k]])
        return out[-1]

    samples = ["Hello  world\n x", " ", "a ", "▁ literal ▁x", "naïve 日本語 🙂 émoji\t\ttab", "x" * 300, "  lead"]
    raw = [s.encode() for s in samples]
    ids, at = pieces.encode(p, np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])))
    for i, s in enumerate(samples):
        mine = sum(p.fallback if p.is_byte[k] else p.score[k] for k in ids[at[i] : at[i + 1]])
        assert abs(mine - best(s)) < 1e-6
    got = pieces.encode_documents(odd)
    assert got.where("not round_trip").count() == 0 and got.count() == len(ODD)
    back = one_by_id(pieces.decode_ids(got))
    assert all(back[i].text == (t or "") for i, t, _, _ in ODD)


def test_projections(spark, sf_dir):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(v) for v in x], i % 2) for i, x in enumerate(base)]
    rows += [(100 + i, [float(v) for v in base[i] + 0.03 * rng.standard_normal(16)], i % 2) for i in range(20)]
    rows += [(200 + i, rows[5][1], 1) for i in range(30)] + [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None] * 16, 0), (304, rows[0][1], None), (305, [], 0), (306, [2 * v for v in rows[0][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit(1))
    good = {i: (np.array(x) / np.linalg.norm(x), y) for i, x, y in rows if x and y is not None and all(v is not None and v == v for v in x) and any(x)}
    links = {i: {j for j in good if j != i and i in good and good[i][1] == good[j][1] and good[i][0] @ good[j][0] >= 0.98 - 1e-12} for i, _, _ in rows}
    root = {i: i for i in links}
    for _ in range(50):
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in links}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in projections.near_vectors(df).collect()}
    assert got == {i: (len(n), root[i], root[i] == i) for i, n in links.items()}
    assert projections.near_vectors(df.limit(0)).count() == 0


def test_projections_recall_and_labels_of_text(spark, monkeypatch):
    # Clusters about the threshold: pairs of every cosine around it, and a crowded cell of several blocks.
    monkeypatch.setattr(projections, "BLOCK", 64)
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((300, 32))
    x = np.concatenate([np.repeat(centre, 6, 0) + 0.11 * rng.standard_normal((1800, 32)) * rng.random((1800, 1)), centre[:1] + 0.15 * rng.standard_normal((400, 32))])
    rows = [(i, [float(v) for v in r], "ab"[i % 2]) for i, r in enumerate(x)] + [(5000, [float(v) for v in x[0]], "a"), (5000, [float(v) for v in x[0]], "a")]
    got = projections.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    y = np.array([r[1] for r in rows])
    y = y / np.linalg.norm(y, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    want = (y @ y.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(want, False)
    links = {}
    for (i, *_), n in zip(rows, want.sum(1), strict=True):
        links.setdefault(i, []).append(int(n))
    found = sum(r.n_links for r in got)
    assert len(got) == len(rows) and 0.999 * want.sum() <= found <= want.sum() and want.sum() > 3000
    assert all(r.n_links <= max(links[r.vec_id]) for r in got)


def test_toxicity(spark, sf_dir, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.severity(docs.where("lang = 'en'"), labels).join(labels, "doc_id").collect()
    assert sum(r.is_toxic for r in rows if r.toxic) >= 0.9 * sum(r.toxic for r in rows)
    assert sum(r.is_toxic for r in rows if not r.toxic) <= 0.01 * len(rows)
    assert all(0 <= r.expected_severity <= 3 for r in rows)
    assert {r.is_toxic for r in toxicity.severity(odd, labels.limit(0)).collect()} == {False}


def test_toxicity_by_hand(spark):
    # The words of the labelled documents, their chi-squares, the features, grades and what the model makes of them.
    d = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    toxic = {}
    for r in spark.read.parquet(f"{d}/labels.parquet").collect():
        if r.toxic is not None and r.doc_id in text:
            toxic[r.doc_id] = max(toxic.get(r.doc_id, 0), r.toxic)
    place = {}

    def held(t):
        out = set()
        for w in re.findall(rb"[a-z0-9\x80-\xff]+", t.encode().lower()):
            if w not in place:
                place[w] = toxicity.places(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0].tolist()
            out |= set(place[w])
        return out

    sets = {i: held(t) for i, t in text.items()}
    count = {}
    for i, k in toxic.items():
        for x in sets[i]:
            count.setdefault(x, [0, 0])[k] += 1
    n = [list(toxic.values()).count(k) for k in (0, 1)]
    chi2 = {}
    for x, (clean, bad) in count.items():
        want = (clean + bad) * n[1] / sum(n)
        c = (bad - want) ** 2 / want / (1 - (clean + bad) / (sum(n) + 1))
        if c >= toxicity.MIN_CHI2 and bad >= 3 and bad * n[0] > clean * n[1]:
            chi2[x] = c
    best = sorted(chi2, key=lambda x: (-chi2[x], x))[: toxicity.MAX_FEATURES]
    number = {x: k for k, x in enumerate(best)}
    ids = sorted(toxic)
    features = {i: sorted(number[x] for x in sets[i] if x in number) for i in text}
    lens = np.array([len(features[i]) for i in ids])
    mark = np.array([toxic[i] for i in ids]) > 0
    grade = np.where(mark, 1 + np.searchsorted(np.quantile(lens[mark], [1 / 3, 2 / 3]), lens, "left"), 0)
    rows, cols = np.repeat(np.arange(len(ids)), lens), np.concatenate([np.array(features[i], int) for i in ids])
    w, theta = toxicity.fit(rows, cols, grade, len(best))
    got = one_by_id(queries.QUERIES["op1_toxicity"](spark, d))
    assert len(best) > 10 and len(got) == len(text)
    for i, f in features.items():
        p = 1 / (1 + np.exp(-(w[f].sum() - theta)))
        assert abs(got[i].expected_severity - p.sum()) < 1e-3 and abs(got[i].p_toxic - p[0]) < 1e-3

    # No step from the fitted weights makes the labels much likelier.
    def loss(w, theta):
        p = 1 / (1 + np.exp(-(np.bincount(rows, w[cols], minlength=len(ids))[:, None] - theta)))
        wall = np.column_stack([np.ones(len(p)), p, np.zeros(len(p))])
        at = np.arange(len(p))
        return -np.log(np.maximum(wall[at, grade] - wall[at, grade + 1], 1e-12)).mean() + toxicity.RIDGE * (w * w).sum() / 2

    least = loss(w, theta)
    for k in range(len(best)):
        for step in (-0.5, 0.5):
            assert loss(w + step * (np.arange(len(w)) == k), theta) > least - 2e-3


def test_toxicity_with_few_toxic_labels(spark, monkeypatch):
    # 1 in 100 is toxic; 'vile' is in every toxic document and in 1.1 of 100 clean ones.
    monkeypatch.setattr(toxicity, "FIT_DOCS", 2000)
    rows = [(i, prose(i, 20).rsplit(" ", 1)[0] + (" vile" if i < 40 or i >= 4000 - 44 else ""), "en", int(i < 40)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    got = one_by_id(toxicity.severity(df.drop("toxic"), df.select("doc_id", "toxic")))
    assert got[0].p_toxic > 10 * got[100].p_toxic and 0.2 < got[0].p_toxic < 0.8
    assert toxicity.level([5, 100, 100], 65) == 30 and toxicity.level([5, 6], 65) == float("inf")


def test_toxicity_thresholds_are_ordered_and_shared():
    grade = np.array([0] * 50 + [1] * 10 + [2] * 10 + [3] * 10)
    rows, cols = np.concatenate([[i] * g for i, g in enumerate(grade) if g]), np.concatenate([np.arange(g) for g in grade if g])
    w, theta = toxicity.fit(rows, cols, grade, 3)
    assert (np.diff(theta) > 0).all() and (w > 0).all()


def test_licenses_and_mixing_match_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    for name in ("op4_license_scan", "op5_mixing"):
        df = queries.QUERIES[name](spark, sf_dir)
        want = con.execute(queries.ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def files(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, path string, text string")


def test_licenses_inherit_from_the_nearest_ancestor(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c/x.txt", "text"), (3, "a/b/LICENSE", gpl), (4, "a/y.txt", "text"), (5, "z/q.txt", None), (6, None, mit), (7, "a/b/own.txt", "word " * 50 + "\n" + mit), (8, "a/b/z.txt", ""), (9, None, None), (9, None, None), (10, "a/twice.txt", mit + "\n" + "word " * 50), (10, "a/twice.txt", mit + "\n" + "word " * 50), (11, "a/long.txt", "filler words here\n" * 30000 + mit), (12, None, "text")]
    out = licenses.scan(files(spark, rows).withColumn("row", F.lit("x")).withColumn("units", F.lit(1)))
    assert out.count() == len(rows)
    got = one_by_id(out)
    assert {i: (r.licence, r.inherited_from) for i, r in got.items()} == {1: ("MIT", None), 2: ("GPL-3.0", "a/b"), 3: ("GPL-3.0", None), 4: ("MIT", "a"), 5: (None, None), 6: ("MIT", None), 7: ("MIT", None), 8: ("GPL-3.0", "a/b"), 9: (None, None), 10: ("MIT", None), 11: ("MIT", None), 12: (None, None)}
    assert licenses.scan(files(spark, rows).limit(0)).count() == 0


MIT_TEXT = """MIT License

Copyright (c) 2020 The Authors

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
#: How the texts of these licences begin; what follows has no other title.
APACHE_TEXT = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n" + '      "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.\n\n' * 40
GPL_TEXT = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\n\n" + "  You may convey verbatim copies of the source code of a covered work under this License.\n\n" * 40
HEADERS = {
    "Apache-2.0": '// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0\n\ncode();',
    "MIT": "# Copyright 2020 somebody\n# Released under the MIT License.\ncode",
    "GPL-3.0": "/* This program is free software: you can redistribute it and/or modify it under the terms of the\n GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or\n (at your option) any later version. */\n\ncode",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. */",
    "BSD-3-Clause": "// SPDX-License-Identifier: BSD-3-Clause\ncode",
}


def test_licence_texts_and_headers(spark):
    rows = [(1, "m/LICENSE", MIT_TEXT), (2, "m/src/x.py", "code"), (3, "p/LICENSE.txt", APACHE_TEXT), (4, "p/x.py", "code"), (5, "g/COPYING", GPL_TEXT), (6, "g/a/b/x.py", "code"), (7, "q/x.py", "He got his driving license in spring, and a copyright lawyer has read all of it.")]
    rows += [(100 + k, f"s/{k}.c", text) for k, text in enumerate(HEADERS.values())]
    got = one_by_id(licenses.scan(files(spark, rows)))
    assert [got[i].licence for i in range(1, 8)] == ["MIT", "MIT", "Apache-2.0", "Apache-2.0", "GPL-3.0", "GPL-3.0", None]
    assert [got[100 + k].declared for k in range(len(HEADERS))] == list(HEADERS) and got[2].inherited_from == "m"


def test_mixing_meets_its_targets(spark, odd):
    cells = spark.createDataFrame([("a", "en", "x", 100), ("a", "de", "y", 300), ("b", "en", "y", 500), ("b", "de", "x", 50)], "source string, lang string, topic string, tokens long")
    share = lambda *rows: spark.createDataFrame(list(rows), "value string, share double")
    got = mixing.rake(cells, {"source": share(("a", 0.5), ("b", 0.5)), "lang": share(("en", 0.6), ("de", 0.4)), "topic": share(("x", 0.5), ("y", 0.5))}, rounds=60).collect()
    for m, v, want in (("source", "a", 475), ("lang", "en", 570), ("topic", "x", 475)):
        assert abs(sum(r.weight for r in got if r[m] == v) - want) < 1
    out = one_by_id(mixing.mix(odd))
    assert out[0].n_tokens == 0 and out[2].source == "unknown" and out[1].lang == "unknown" and len(out) == 10


def test_mixing_of_many_cells_and_rounds(spark, monkeypatch):
    # 100,000 cells; three margins that depend on each other take many rounds.
    cells = spark.range(100_000).selectExpr("concat('s', id % 1000) AS source", "concat('l', id div 1000 % 10) AS lang", "concat('t', id div 10000) AS topic", "1 + id * id % 997 * IF(id % 7 = 0, 20, 1) AS tokens")
    few = cells.where("source < 's2'")
    by_windows = {tuple(r)[:3]: r.weight for r in mixing.rake(few, rounds=8).collect()}
    monkeypatch.setattr(mixing, "CELLS", 1000)
    by_joins = {tuple(r)[:3]: r.weight for r in mixing.rake(few, rounds=8).collect()}
    assert len(by_joins) > 1000 and by_joins.keys() == by_windows.keys() and all(abs(w - by_windows[k]) <= 1e-9 * w for k, w in by_joins.items())
    got = mixing.rake(cells, rounds=200, tolerance=1e-12)
    total = got.agg(F.sum("tokens")).first()[0]
    for m in mixing.MARGINS:
        shares = got.groupBy(m).agg(F.sum("weight").alias("w"), F.pow(F.sum("tokens"), F.lit(mixing.POWERS[m])).alias("p"))
        p = shares.agg(F.sum("p")).first()[0]
        assert shares.where(F.abs(F.col("w") / total - F.col("p") / p) > 1e-9).count() == 0
    docs = spark.createDataFrame(ODD, SCHEMA)
    want = sorted(tuple(r) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "CELLS", 0)
    assert sorted(tuple(r) for r in mixing.mix(docs).collect()) == want


def test_mixing_keeps_its_rate_beside_a_stray_source(spark):
    import corpus_pipeline

    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('word ', 500) AS text", "'en' AS lang", "IF(id = 0, 'stray', 'big') AS source", "2500L AS n_chars")
    assert 0.45 * 4000 < corpus_pipeline.mixing(spark, docs, "").count() < 0.55 * 4000
    assert 0.45 * 4000 < mixing.mix(docs).where("sampled").count() < 0.55 * 4000
    cells = spark.createDataFrame([(100, 9.0), (1000, 2.0), (10000, 0.5)], "tokens long, weight double")
    scale = mixing.scale_to(cells, 0.5)
    assert abs(sum(t * min(1, w * scale) for t, w in cells.collect()) - 0.5 * 11100) < 1e-6


def chains(text):
    """By hand: the next two content words after each anchor; of a text without one, of all words."""
    stop = set(spotsigs.ANCHORS)
    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    if not any(x in stop for x in w):
        return {tuple(w[i : i + 2]) for i in range(max(len(w) - 1, 1))}
    return {tuple([y for y in w[i + 1 :] if y not in stop][:2]) for i, x in enumerate(w) if x in stop}


def likeness(a, b):
    a, b = chains(a), chains(b)
    return len(a & b) / len(a | b)


def test_spot_signatures(spark, sf_dir, odd):
    rows = texts(spark, sf_dir)
    got = one_by_id(queries.QUERIES["op8_spot_signatures"](spark, sf_dir))
    by_text = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(got[i].near_edited - likeness(t, e)) < 1e-9 and abs(got[i].near_next - likeness(t, nxt)) < 1e-9
        assert len(got[i].fingerprint) == 16 * len(chains(t)) and by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    r = one_by_id(spotsigs.fingerprints(odd))
    assert r[7].fingerprint == r[8].fingerprint and r[0].fingerprint == r[1].fingerprint == r[2].fingerprint and r[0].near_next == 1 and len(r) == 10
    docs = [(1, "the of and to in a is it on for cat sat"), (2, "один два три"), (3, "один два три четыре"), (4, "the cat and the"), (5, "")]
    r = one_by_id(spotsigs.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")))
    assert all(abs(r[i].near_next - likeness(t, docs[i % 5][1])) < 1e-9 for i, t in docs) and r[2].near_next == 2 / 3


def test_spot_signatures_with_a_far_off_id(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET", 10)
    ids = [*range(500), 1 << 60]
    docs = spark.createDataFrame([(i, f"the word{i} of text{i % 3}") for i in ids], "doc_id long, text string")
    full = spotsigs.with_next(docs.withColumn("n", F.length("text"))).where("late = 0").groupBy("bucket").count().collect()
    assert max(r["count"] for r in full) <= 40 and sum(r["count"] for r in full) == len(ids)
    got = one_by_id(spotsigs.fingerprints(docs))
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    text = lambda i: f"the word{i} of text{i % 3}"
    for i in ids:
        n = len(text(i))
        assert got[i].edited_sha256 == hashlib.sha256((text(i)[: n - n // 2] + text(after[i])[: n // 2]).encode()).hexdigest()


def test_spot_signature_pairs(spark, sf_dir):
    rows = texts(spark, sf_dir) + [(10_000 + i, t + " and one of the new words") for i, t in texts(spark, sf_dir)[:60]]
    near = {(r.a, r.b): r.similarity for r in spotsigs.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(frozenset(chains(t)), i)
    reps = sorted((i, c) for c, i in first.items())
    want = {(i, j): len(a & b) / len(a | b) for x, (i, a) in enumerate(reps) for j, b in reps[x + 1 :] if len(a & b) >= 0.8 * len(a | b)}
    assert near.keys() == want.keys() and len(want) > 5 and all(abs(near[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("f", [chunks.dedup_substrings, suffixes.remove_repeats, minhash.near_duplicates, spotsigs.fingerprints, mixing.mix, pieces.encode_documents, lambda d: langid.identify(d, d), lambda d: toxicity.severity(d, d.selectExpr("doc_id", "1 AS toxic"))])
def test_empty_table(odd, f):
    assert f(odd.limit(0)).count() == 0


def test_hash_of_substrings():
    d = np.frombuffer(b"abcabcabc", np.uint8)
    h = Prefix(d)
    assert h(np.array([0]), np.array([3])) == h(np.array([3]), np.array([6])) != h(np.array([1]), np.array([4]))


def twins(n):
    """Two different strings of n a/b characters that a polynomial hash modulo 2**64 takes for one."""
    one = "a"
    while len(one) < n:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_texts_are_compared_not_hashes(spark, monkeypatch, n):
    x, y = twins(n)
    d = np.frombuffer((x + y).encode(), np.uint8)
    assert Prefix(d)(np.array([0]), np.array([n])) == Prefix(d)(np.array([n]), np.array([2 * n]))
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(1, x), (2, y), (3, y), (4, x + " tail"), (5, y + " tail")], schema)
    got = one_by_id(minhash.near_duplicates(df, words=2))
    assert {i: r.component_id for i, r in got.items()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}
    monkeypatch.setattr(chunks, "chunk_ends", lambda data, offsets, mean: offsets[1:])
    got = one_by_id(spark.createDataFrame(list(chunks.chunk_rows()(iter([batch([(1, x), (2, y)])])))[0].to_pandas())).values()
    assert len({r.h1 for r in got}) == 2
    p = pieces.load()
    ids, at = pieces.encode(p, d, np.array([0, n, 2 * n]))
    back, lens = pieces.decode(p, ids, at)
    assert back.tobytes().decode() == x + y and list(lens) == [n, n]


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["doc_id", "text"])


def test_equal_looking_runs_are_compared(spark, monkeypatch):
    # Every hash of a run is the same: only its bytes tell it from others.
    rows = [(i, prose(i // 3, 60) + prose(10 + i // 3, 40)) for i in range(9)]
    old = Prefix.__call__
    monkeypatch.setattr(Prefix, "__call__", lambda self, a, b: np.zeros_like(old(self, a, b)))  # so only neighbours in the sort can be twins
    b = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([t for _, t in rows]), pa.array([[2 * k for k in starts(t)] for _, t in rows])], names=["doc_id", "text", "marks"])
    out = next(suffixes._contents(100)(iter([b])))
    twin = {(r["doc_id"], r["start"] // 256) for r in out.to_pylist() if r["twin"]}
    runs = {}
    for i, t in rows:
        for a, n in starts(t).items():
            runs.setdefault(t[a : a + n + 99], []).append((i, a))
    assert twin <= {x for same in runs.values() for x in same[1:]}


def starts(text):
    d = np.frombuffer(text.encode(), np.uint8)
    a, n, _, _ = suffixes.minimizer_runs(d, np.array([0, len(d)]), 100, suffixes.MINIMIZER)
    return dict(zip(a.tolist(), n.tolist(), strict=True))


def test_language_of_symbols_and_of_letters_beyond_the_basic_plane(spark, sf_dir):
    docs = spark.createDataFrame([(1, "\U0001f600\U0001f680"), (2, "\U0001f600 4 \u2028!"), (3, "\U00010400\U00010401"), (4, "the cat is on the mat")], "doc_id long, text string")
    got = one_by_id(langid.identify(docs, spark.read.parquet(f"{sf_dir}/documents.parquet")))
    assert [got[i].lang_pred for i in (1, 2)] == ["und", "und"] and got[3].lang_pred != "und" and got[4].lang_pred == "en"


def test_language_model_is_kneser_ney(spark):
    # By hand: interpolated Kneser-Ney of order 4 with one discount for each order and language.
    train = [(1, "abc abd! abc", "x"), (2, "bcd abcab", "x"), (3, "xyz xya", "y"), (4, "abz yxz", "y")]
    codes = lambda t: [langid.GAP if k == " " else ord(k) for k in re.sub(r"[^a-z]+", " ", t.lower())]
    count = {k: {o: {} for o in range(1, 5)} for k in "xy"}
    for _, t, lang in train:
        c = [langid.EDGE] * 4 + codes(t)
        for i in range(4, len(c)):
            g = tuple(c[i - 3 : i + 1])
            count[lang][4][g] = count[lang][4].get(g, 0) + 1
    for k in "xy":
        for o in (3, 2, 1):
            for g in count[k][o + 1]:
                count[k][o][g[1:]] = count[k][o].get(g[1:], 0) + 1
    letters = max(2, len({g for k in "xy" for g in count[k][1]}) + 1)

    def p(k, g):
        if not g:
            return 1 / letters
        c = count[k][len(g)]
        ones, twos = (sum(v == n for v in c.values()) for n in (1, 2))
        cut = min(max(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.1), 0.9)
        after = [v for h, v in c.items() if h[:-1] == g[:-1]]
        lower = p(k, g[1:])
        return lower if not after else (max(c.get(g, 0) - cut, 0) + cut * len(after) * lower) / sum(after)

    docs = [(10, "abcd"), (11, "xyz bca"), (12, "qq ab")]
    got = one_by_id(langid.identify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(train, "doc_id long, text string, lang string")))
    for i, t in docs:
        c = [langid.EDGE] * 4 + codes(t)
        h = {k: -sum(math.log(p(k, tuple(c[j - 3 : j + 1]))) for j in range(4, len(c))) / len(codes(t)) for k in "xy"}
        best = min(h, key=h.get)
        assert got[i].lang_pred == best and abs(got[i].cross_entropy - h[best]) < 1e-6
        assert abs(got[i].score - 1 / sum(math.exp((h[best] - v) * 20) for v in h.values())) < 1e-5


def brute_mix(docs, rate):
    """doc_ids sampled from (doc_id, text, lang, source), by raking with plain loops."""
    topic = lambda t: "table" if " | " in t else "contact" if "http" in t or "@" in t else "licensed" if "icense" in t else "prose"
    rows = [(i, (source or "unknown", lang or "unknown", topic(t)), t.count(" ") + 1 if t else 0) for i, t, lang, source in docs]
    tokens = {}
    for _, c, n in rows:
        tokens[c] = tokens.get(c, 0) + n
    weight, total = {c: float(n) for c, n in tokens.items()}, sum(tokens.values())
    powers = [mixing.POWERS[m] for m in mixing.MARGINS]
    own = [{v: sum(n for c, n in tokens.items() if c[m] == v) ** powers[m] for v in {c[m] for c in tokens}} for m in range(3)]
    for _ in range(300):
        for m in range(3):
            held = {v: sum(w for c, w in weight.items() if c[m] == v) for v in own[m]}
            weight = {c: w * own[m][c[m]] / sum(own[m].values()) * total / held[c[m]] if held[c[m]] else 0.0 for c, w in weight.items()}
    each = {c: weight[c] / n if n else 0.0 for c, n in tokens.items()}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(1, each[c] * mid) for c, n in tokens.items()) < rate * total else (low, mid)
    return {i for i, c, _ in rows if int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32 < min(1, each[c] * low)}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = {r.doc_id: (r.text, r.lang, r.source) for r in corpus_pipeline.language(spark, docs, sf_dir).collect()}
    assert len(known) >= 0.95 * docs.where("text rlike '[a-z]'").count()
    place = brute_components({i: shingles(t, 5) for i, (t, _, _) in known.items()})
    one = [(i, known[i][0]) for i in sorted(known) if place[i] == i]
    left = {i: t.decode() for i, (_, t) in brute_chunks(one).items() if t or not known[i][0]}
    chosen = brute_mix([(i, t, *known[i][1:]) for i, t in left.items()], corpus_pipeline.MIX_RATE)
    got = one_by_id(corpus_pipeline.run(spark, sf_dir))
    assert {i: r.decoded_sha256 for i, r in got.items()} == {i: hashlib.sha256(left[i].encode()).hexdigest() for i in chosen}
    assert all(r.round_trip for r in got.values()) and 0.3 * len(left) < len(chosen) < 0.7 * len(left)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "substring_dedup", "mixing", "encoding"]


def test_pipeline_stages_of_odd_tables(spark, odd):
    import corpus_pipeline

    table = odd.union(odd.selectExpr("CAST(NULL AS LONG)", *odd.columns[1:]).limit(1)).withColumn("rejected", F.lit(1)).withColumn("kept", F.lit(0)).withColumn("probability", F.lit("x"))
    out = {name: stage(spark, table, "").collect() for name, stage in corpus_pipeline.STAGES}
    ids = {name: sorted((r.doc_id for r in rows), key=str) for name, rows in out.items()}
    assert all(set(r.asDict()) == set(corpus_pipeline.COLUMNS) for name, rows in out.items() if name != "encoding" for r in rows)
    assert not {0, 1, 2, 4} & set(ids["language"]) and {5, 6, 7, 8} <= set(ids["language"])
    assert ids["near_dedup"] == [0, 1, 2, 3, 4, 5, 7, 9]
    assert {r.doc_id: r.text for r in out["substring_dedup"]}[5] == LONG and 8 not in ids["substring_dedup"] and ids["substring_dedup"].count(9) == 2
    assert not {0, 1} & set(ids["mixing"]) and len(out["encoding"]) == len(ODD) + 1 and all(r.round_trip for r in out["encoding"])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), "").count() == 0, name
