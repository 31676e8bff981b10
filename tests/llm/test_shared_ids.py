"""Rows that share a doc_id, and rows without one, in the operators that mark places of documents."""

import hashlib

import numpy as np
import pytest

from loomgraph.llm import chunks, minhash, suffixes
from loomgraph.llm.common import bounded

from test_operators import brute_chunks, brute_components, brute_repeats, prose, shingles

PASSAGE = prose(50, 60)
TEXTS = "doc_id long, text string"
ROWS = [(1, PASSAGE), (2, prose(51, 100) + " " + PASSAGE), (2, "short one"), *((i, prose(100 + i, 18)) for i in range(20, 40)), (None, PASSAGE), (None, None), (50, PASSAGE), (50, PASSAGE), (51, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, TEXTS).coalesce(1)


@pytest.fixture(scope="module")
def placed(rows):
    """The rows as documents of their own: place -> (doc_id, text), in the order of doc_id and the text's hash."""
    known = rows.where("doc_id is not null").selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS h").distinct().collect()
    return dict(enumerate(sorted(((r.doc_id, r.text) for r in known), key=lambda x: [(r.doc_id, r.h) for r in known if (r.doc_id, r.text) == x][0])))


def many(rows, of):
    """As often as each (doc_id, text) is there."""
    return sorted((i, *of[(i, t)]) for i, t in rows if i is not None)


def test_substring_dedup(rows, placed):
    want = brute_chunks([(k, t or "") for k, (_, t) in placed.items()])
    want = {placed[k]: (n, hashlib.sha256(t).hexdigest()) for k, (n, t) in want.items()}
    got = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in chunks.dedup_substrings(rows).collect())
    assert got == many(ROWS, want)
    # Those that share nothing keep all their text.
    assert all(n == 0 for i, n, _ in got if 20 <= i < 40) and {n > 0 for i, n, _ in got if i == 50} == {True}


def test_suffix_dedup(rows, placed):
    want = brute_repeats([(k, t) for k, (_, t) in placed.items()])
    want = {placed[k]: v for k, v in want.items()}
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(rows).collect())
    assert got == many(ROWS, want)


def test_minhash(rows, placed):
    component = brute_components({k: shingles(t, 5) for k, (_, t) in placed.items()})
    want = {placed[k]: (placed[c][0],) for k, c in component.items()}
    got = minhash.near_duplicates(rows).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == many(ROWS, want) and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_marks_stay_in_their_document():
    bounded(np.array([0, 3]), np.array([1, 4]))
    with pytest.raises(ValueError):
        bounded(np.array([4]), np.array([4]))
