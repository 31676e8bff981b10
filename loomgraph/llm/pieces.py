"""Operator 9: SentencePiece encoding and decoding.

A text gets one space before it and its UTF-8 bytes are covered by pieces, a piece's whitespace
marker standing for a space; the Viterbi path of greatest summed log score is its encoding.  The
pieces lie in a double-array trie over bytes, and the walk and the recurrence run over all distinct
segments of a batch at once.  Characters outside the vocabulary become one piece for each byte."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import identified, list_array, portions, ragged, slices, table, text_array, utf8

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
#: Added to the least score of a piece for each byte of a fallback character.
FALLBACK = -10.0
#: Bytes encoded in one step.
STEP_BYTES = 3 << 19


@dataclass
class Pieces:
    """A vocabulary as arrays; its size, and so that of what is broadcast, is that of the model file."""

    base: np.ndarray  # double-array trie
    check: np.ndarray
    piece: np.ndarray  # piece that ends at a trie node, or -1
    score: np.ndarray
    byte_ids: np.ndarray
    data: np.ndarray  # bytes of each piece, end to end
    offsets: np.ndarray
    is_byte: np.ndarray
    inner: np.ndarray  # whether a piece has these two bytes in a row
    fallback: float


def double_array(pieces: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, piece: the child by byte b of the node at s is at base[s] + b, if check is s there."""
    children: list[dict[int, int]] = [{}]
    final = [-1]
    for i, p in enumerate(pieces):
        at = 0
        for b in p or b"":
            if b not in children[at]:
                children[at][b] = len(children)
                children.append({})
                final.append(-1)
            at = children[at][b]
        if p and final[at] < 0:
            final[at] = i
    size = 2 * len(children) + (1 << 14)
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[0] = False
    place, low, several = {0: 0}, 1, 1
    for node, own in enumerate(children):
        s = place[node]
        piece[s] = final[node]
        if not own:
            continue
        keys = np.fromiter(own, np.int64)
        while not free[low]:
            low += 1
        start = max(1, low - int(keys.min()))  # one child fills the first gap; several go on where the last did
        span = 1
        if len(keys) > 1 or not free[start + keys[0]]:
            start, span = max(start, several), 64
        while True:
            if start + 1024 > size:
                base, check, piece, free = (np.append(x, np.full(size, v, x.dtype)) for x, v in ((base, 0), (check, -1), (piece, -1), (free, True)))
                size *= 2
            tries = np.arange(start, start + span)
            good = free[tries[:, None] + keys].all(1)
            if good.any():
                at = int(tries[good.argmax()])
                break
            start += span
            span = 512
        several = max(several, at - 64) if len(keys) > 1 else several
        base[s] = at
        for b, child in own.items():
            free[at + b] = False
            check[at + b] = s
            place[child] = at + b
    return base, check, piece


def build(pieces: list[bytes | None], scores: list[float], byte_ids: dict[int, int]) -> Pieces:
    """From the pieces (None: not for text; a space is the marker), log scores and each byte's piece."""
    own = {i: b for b, i in byte_ids.items()}
    text = [bytes([own[i]]) if i in own else (p or b"") for i, p in enumerate(pieces)]
    inner = np.zeros((256, 256), bool)
    for p in pieces:
        for a, b in zip(p or b"", (p or b"")[1:], strict=False):
            inner[a, b] = True
    is_byte = np.zeros(len(pieces), bool)
    is_byte[list(own)] = True
    least = min([s for s, p in zip(scores, pieces, strict=True) if p], default=0.0)
    base, check, piece = double_array(pieces)
    return Pieces(base, check, piece, np.array(scores, float), np.array([byte_ids[b] for b in range(256)], np.int32), np.frombuffer(b"".join(text), np.uint8), np.append(0, np.cumsum([len(x) for x in text])), is_byte, inner, least + FALLBACK)


@lru_cache(4)
def load(path: str = VOCABULARY) -> Pieces:
    """A SentencePiece model file's pieces.  Scores that are merge ranks (a BPE file) become the log
    probabilities of Zipf's law at that rank; log probabilities stay."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
    special = {i for i in range(n) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
    pieces = [None if i in special else model.id_to_piece(i).encode().replace(MARK, b" ") for i in range(n)]
    scores = np.array([model.get_score(i) for i in range(n)])
    plain = np.array([i for i in range(n) if i not in special])
    if np.median(-scores[plain]) > 100:
        rank = np.argsort(np.argsort(-scores[plain], kind="stable"), kind="stable") + 1.0
        scores[plain] = -np.log(rank) - np.log(np.sum(1 / rank))
    return build(pieces, list(scores), byte_ids)


def viterbi(p: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of each (not empty) segment of bytes, and where they begin.  Of paths of equal score,
    at each place the one whose last piece is longest."""
    lens = np.diff(offsets)
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    seg = np.repeat(np.arange(len(lens)), lens)
    end = offsets[1:][seg]
    head = (data & 0xC0) != 0x80
    head[offsets[:-1]] = True
    # Edges: the trie's walk from every character at once, then the fallback of each character.
    at = np.flatnonzero(head)
    following = np.append(at[1:], n)
    edges = [(at, following, np.full(len(at), -1), p.fallback * (following - at))]
    node, k = np.zeros(len(at), np.int64), 0
    while len(at):
        inside = at + k < end[at]
        at, node = at[inside], node[inside]
        to = p.base[node] + data[at + k].astype(np.int64)
        inside = p.check[to] == node
        at, node = at[inside], to[inside]
        k += 1
        got = p.piece[node]
        some = got >= 0
        edges.append((at[some], at[some] + k, got[some], p.score[got[some]]))
    source, target, what, gain = (np.concatenate([e[c] for e in edges]) for c in range(4))
    # Places: one more than bytes for each segment.  Sources are done in the order of their place in
    # the segment; by then all edges into them are.
    s, t = source + seg[source], target + seg[source]
    rank = source - offsets[seg[source]]
    order = np.lexsort((what >= 0, target - source, rank))
    s, t, what, gain, rank = s[order], t[order], what[order], gain[order], rank[order]
    width = t - s
    best = np.full(n + len(lens), -np.inf)
    back, via = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
    best[offsets[:-1] + np.arange(len(lens))] = 0
    kind = np.flatnonzero(np.append(True, (rank[1:] != rank[:-1]) | (width[1:] != width[:-1]) | ((what[1:] >= 0) != (what[:-1] >= 0))))
    for a, b in zip(kind, np.append(kind[1:], len(s)), strict=True):
        value = best[s[a:b]] + gain[a:b]
        to = t[a:b]
        up = value > best[to]
        to = to[up]
        best[to], back[to], via[to] = value[up], s[a:b][up], what[a:b][up]
    first = offsets[:-1] + np.arange(len(lens))
    cur = first + lens
    live = np.arange(len(lens))
    steps = []
    while len(live):
        c = cur[live]
        steps.append((live, via[c], back[c], c - back[c]))
        cur[live] = back[c]
        live = live[cur[live] > first[live]]
    owner, v, b, w = (np.concatenate([x[c] for x in steps])[::-1] for c in range(4))
    by = np.argsort(owner, kind="stable")
    owner, v, b, w = owner[by], v[by], b[by], w[by]
    times = np.where(v < 0, w, 1)
    who, fall = np.repeat(owner, times), np.repeat(v < 0, times)
    ids = np.repeat(v, times)
    ids[fall] = p.byte_ids[data[ragged(b - owner, times)[fall]]]
    return ids.astype(np.int32), np.append(0, np.cumsum(np.bincount(who, minlength=len(lens))))


def encode(p: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of each text, end to end, and where each begins; an empty text has none.

    A text is cut wherever no piece has the two bytes around the cut: the best path of the whole is
    the best paths of the segments, and each distinct segment is solved once."""
    lens = np.diff(offsets)
    some = lens > 0
    begin = np.append(0, np.cumsum(lens + some))
    full = np.full(int(begin[-1]), 0x20, np.uint8)
    full[ragged(begin[:-1] + some, lens)] = data
    if not len(full):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    cut = np.ones(len(full), bool)
    cut[1:] = ~p.inner[full[:-1], full[1:]] & ((full[1:] & 0xC0) != 0x80)
    cut[begin[:-1][some]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(full))
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__  # each distinct segment's number
    raw = full.tobytes()
    which = np.array([number[raw[a:b]] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    size = np.array([len(x) for x in number])
    ids, at = viterbi(p, np.frombuffer(b"".join(number), np.uint8), np.append(0, np.cumsum(size)))
    n = np.diff(at)[which]
    total = np.append(0, np.cumsum(n))
    return ids[ragged(at[:-1][which], n)], total[np.searchsorted(starts, begin)]


def decode(p: Pieces, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each list of ids, end to end, and their lengths: markers are spaces, the first one goes."""
    n = np.diff(p.offsets)[ids]
    data = p.data[ragged(p.offsets[ids], n)]
    at = np.append(0, np.cumsum(n))[offsets]
    lens = np.diff(at)
    lead = at[:-1][lens > 0]
    lead = lead[data[lead] == 0x20]
    keep = np.ones(len(data), bool)
    keep[lead] = False
    return data[keep], np.diff(np.append(0, np.cumsum(keep))[at])


ENCODED = "doc_id long, ids array<int>, n_pieces long, n_byte_pieces long, decoded_sha256 string, round_trip boolean"
NAMES = [x.split()[0] for x in ENCODED.split(", ")]


def _encode(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in portions(batches):
            data, offsets = utf8(b.column(1))
            for i, j in slices(offsets, STEP_BYTES):
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                ids, at = encode(p, d, o)
                back, lens = decode(p, ids, at)
                raw, where = back.tobytes(), np.append(0, np.cumsum(lens))
                own = d.tobytes()
                texts = [(raw[where[x] : where[x + 1]], own[o[x] : o[x + 1]]) for x in range(j - i)]
                fall = np.append(0, np.cumsum(p.is_byte[ids]))[at]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), list_array(ids, at, pa.int32()), pa.array(np.diff(at)), pa.array(np.diff(fall)), pa.array([hashlib.sha256(x).hexdigest() for x, _ in texts], pa.string()), pa.array([x == y for x, y in texts], pa.bool_())],
                    names=NAMES,
                )

    return work


def encode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per document ENCODED: its piece ids, how many and how many of them are bytes, the digest of the
    decoded text and whether it is the text.

    Null is as the empty text: no ids, decoded to the empty text.  A marker character in the text itself
    is no space and becomes byte pieces, so every text comes back.  Of paths of equal score the one whose
    last piece is longest is taken, at each place.  Texts of any length are whole: they are cut only where no
    piece goes across.  Rows are independent: repeated rows give a row each, extra columns are ignored, an
    empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    return identified(docs).mapInArrow(_encode(shared), ENCODED)


def decode_ids(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give the empty text, bytes that aren't UTF-8 the replacement mark."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            lists = b.column(1)
            n = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            data, lens = decode(p, lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(n)))
            try:
                data.tobytes().decode()
                text = text_array(data, lens)
            except UnicodeDecodeError:
                at = np.append(0, np.cumsum(lens))
                text = pa.array([data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(at[:-1], at[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
