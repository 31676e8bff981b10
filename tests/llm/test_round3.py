"""Packed token ids, the filter audit and ranked search against brute force, and on odd tables."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import filter_audit, packed_ids, queries, ranked_search

from test_operators import LONG, ODD, SCHEMA, odd, prose  # noqa: F401

RAW = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


@pytest.mark.parametrize("bits", [1, 3, 7, 15, 16, 17, 31, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, np.uint64).astype(np.uint32)
        raw = packed_ids.pack(ids, bits)
        assert len(raw) == -(-n // 64) * bits * 8 and (packed_ids.unpack(raw, n, bits) == ids).all()


@pytest.mark.parametrize("bits", [5, 16, 17])
def test_file_of_ids(tmp_path, monkeypatch, bits):
    monkeypatch.setattr(packed_ids, "BLOCK", 128)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (0, 1, 500, 127, 128, 0, 129, 3)]
    file = packed_ids.Writer(f"file://{tmp_path}/x.ids", bits)
    for i in (0, 3, 6):
        part = docs[i : i + 3]
        file.add(np.arange(i, i + len(part)), np.array([len(d) for d in part]), np.concatenate(part))
    file.close()
    back = packed_ids.Reader(file.url)
    assert back.n_docs == 8 and back.n_ids == sum(map(len, docs)) and list(back.doc_ids) == list(range(8))
    assert all((back.document(i) == d).all() for i, d in enumerate(docs))
    flat = np.concatenate(docs)
    for a, b in ((0, 1), (127, 129), (5, 5), (130, 700), (0, len(flat))):
        assert (back.ids(a, b) == flat[a:b]).all()
    assert list(back.portions(200)) == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 8)]


def test_words_are_encoded_as_in_whole_texts():
    e = packed_ids.Encoder(RAW)
    assert e.words is not None and packed_ids.id_bits(RAW, 2) == 16
    rng = random.Random(3)
    parts = [*packed_ids.SPACES, *" " * 20, *"abcdefABC'''_#.,;:!?-()012é ñß日本🙂\x1c​́²½ⅣÀÿ×÷ªµ\u0000", "<|endoftext|>", "'s", "'re", "ll", "foo.", "x" * 60]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert list(np.frombuffer(e(text), np.uint32)) == e.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_vocabularies_encode_whole_texts():
    e = packed_ids.Encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert e.words is None
    for text in ("Hello  World", "a\nb", ""):
        assert list(np.frombuffer(e(text), np.uint32)) == (e.tokenizer.encode(text, add_special_tokens=False).ids if text else [])


def brute_ids(rows):
    t, start, out = Tokenizer.from_str(RAW), 0, []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def found_ids(df):
    return sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect())


def test_packed_ids(spark, sf_dir, odd, tmp_path):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    assert found_ids(queries.QUERIES["op11_packed_ids"](spark, sf_dir)) == brute_ids(rows)
    # Odd rows, one document longer than what a reader holds, several texts and rows of one doc_id, rows without one.
    more = spark.createDataFrame([(9, "another text of nine", "x", "y"), (None, "no id", "x", "y")], SCHEMA)
    docs = odd.select("doc_id", "text", "lang", "source").union(more).withColumn("h", F.lit(0)).withColumn("start", F.lit(1))
    files = packed_ids.write_ids(docs, RAW, 2, f"file://{tmp_path}")
    nine = [(r.doc_id, r.text) for r in docs.where("doc_id = 9").orderBy(F.xxhash64("text"), "text").collect()]
    want = brute_ids([(i, t) for i, t, _, _ in ODD if i != 9] + nine)
    assert found_ids(packed_ids.read_checksums(files, most=1000)) == sorted(want)
    texts = {(r.doc_id, Tokenizer.from_str(RAW).decode([i for i in r.ids if i != 2])) for r in packed_ids.read_documents(files).collect()}
    assert (9, "another text of nine") in texts and (5, LONG) in texts
    assert packed_ids.read_checksums(packed_ids.write_ids(docs.limit(0), RAW, 2, f"file://{tmp_path}")).count() == 0


def test_packed_ids_of_several_files_a_task(spark, tmp_path):
    # A task begins another file after each Arrow batch of ten rows.
    rows = [(i, prose(i, i % 50)) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        files = packed_ids.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), RAW, 2, f"file://{tmp_path}", file_ids=1)
        assert files.count() >= 30 and files.agg(F.sum("n_docs")).first()[0] == 300
        assert found_ids(packed_ids.read_checksums(files)) == brute_ids(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def same(df, got):
    names = [c[0] for c in got.description]
    rows = [tuple(r[n] for n in names) for r in df.collect()]
    return sorted(map(str, rows)) == sorted(map(str, got.fetchall())) and set(df.columns) == set(names)


def brute_audit(docs, labels):
    from itertools import permutations

    least, parts = {}, {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, source in docs:
        t = text or ""
        words = [w for w in t.translate({c: " " for c in range(9, 14)}).split(" ") if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        mine = [(q, x) for j, q, x in labels if i is not None and j == i]
        parts.setdefault(source or "", []).append(({k for k in fails if fails[k]}, any(q == 1 for q, _ in mine), any(x == 1 for _, x in mine)))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [r for r in rows if letter in r[0] and not r[0] & before]
                shapley[letter] += len(removed)
                out[(part, "".join(order), step)] = [letter, sum(not r[0] & (before | {letter}) for r in rows), len(removed), sum(letter in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {letter} for r in rows), sum(r[1] for r in removed), sum(r[2] for r in removed)]
        for (p, _, _), v in out.items():
            if p == part:
                v.append(shapley[v[0]])
    return out


def found_audit(df):
    return {(r.part, r.filter_order, r.step): [r["filter"], r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_filter_audit(spark, sf_dir, odd):  # noqa: F811
    rng = np.random.default_rng(2)
    docs = [(i, t, s) for i, t, _, s in ODD] + [(None, "no id & more", "s"), (None, None, None), (40, "", "u"), (41, LONG, "u")]
    docs += [(100 + i, " ".join(rng.choice(["Aa", "b", "c#", "DD", "e f", "g\x1ch", "日本"], 60)) + "\x0b\x0c " + str(i % 7), "u" if i % 3 else "v") for i in range(60)] + [(200 + i, "same text", "v") for i in range(20)]
    labels = [(i, int(i % 2), int(i % 5 == 0)) for i in range(100, 160, 2)] + [(100, None, None), (101, 1, 1), (101, 0, 0), (None, 1, 1), (7, 1, None), (999, 1, 1)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("part", F.lit("x")).withColumn("mask", F.lit(1)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x"))
    got = found_audit(filter_audit.audit(a, b))
    assert got == brute_audit(docs, labels) and len(got) == 600 * 5
    assert found_audit(filter_audit.audit(a, b.limit(0))) == brute_audit(docs, [])
    assert filter_audit.audit(a.limit(0), b).count() == 0
    con = duckdb.connect()
    for n in ("documents", "labels"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    assert same(queries.QUERIES["op12_filter_audit"](spark, sf_dir), con.execute(queries.ORACLES["op12_filter_audit"]))


def brute_search(docs, items, k):
    import math
    import re
    from collections import Counter

    def terms(t):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    rows = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n, total = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        text = min((t for i, t in items if i == item and t is not None), default=None)
        scores = []
        for i, c in rows:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_ranked_search(spark, sf_dir, odd, monkeypatch):  # noqa: F811
    rng = np.random.default_rng(5)
    words = ["Straße", "café", "日本語", "x1", "Y2", "z_z", "tie", "tie", "the", " nbsp", "IJ"]
    docs = [(i, t) for i, t, _, _ in ODD] + [(None, "tie tie x1")] + [(100 + i, "tie of many") for i in range(40)] + [(200 + i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(80)]
    items = [(1, "tie"), (2, "The café, café; CAFÉ 日本語!"), (3, None), (4, ""), (5, "nothing like it"), (None, "tie"), (6, "x1 y2 Z z the the the"), (7, "many"), (7, "of"), (8, LONG)]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("item_id", F.lit("x")).repartition(7)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = brute_search(docs, items, 20)
    values = lambda df: sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert values(ranked_search.search(a, b)) == want and {r[0] for r in want} == {1, 2, 6, 7, 8}
    assert values(ranked_search.search(a, b, k=3, item_bytes=60)) == brute_search(docs, items, 3)  # items in several blocks
    assert ranked_search.search(a.limit(0), b).count() == ranked_search.search(a, b.limit(0)).count() == 0
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    assert same(queries.QUERIES["op13_ranked_search"](spark, sf_dir), con.execute(queries.ORACLES["op13_ranked_search"]))


def test_ranked_search_in_small_blocks(spark, sf_dir):
    # The product of a task taken in blocks of few documents gives what one block gives.
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    matrix = ranked_search.Items([(1, docs[0][1]), (2, docs[1][1][:200])])
    batch = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_search(docs, [(1, docs[0][1]), (2, docs[1][1][:200])], 20)
    items = spark.createDataFrame([(1, docs[0][1]), (2, docs[1][1][:200])], "item_id long, text string")
    assert len(matrix.rows) == 2
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search.search(batch.coalesce(1), items).collect()) == want
