"""Operator 11: token ids in binary files, each id in as few bits as the vocabulary needs.

A file holds blocks of BLOCK ids, packed so that 64 ids fill `bits` little-endian words of 64 bits, then an index
(doc_id and first id of each document, offset of each block) and a trailer that tells where the index is.  As
the width is fixed, any id is found by arithmetic, and a block is unpacked by numpy in 64 steps whatever its size.

Documents are dealt to tasks by ranges of doc_id, so the files of the tasks, in order, are the corpus in ascending
doc_id order.  A task writes its files under names of their own and returns them as rows; a file of an attempt that
was lost is in no row."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import identified, portions, shared_dir, staged, table

MAGIC = b"PACKIDS1"
#: ids, documents, blocks, bits of an id, ids of a block, offset of the index
TRAILER = struct.Struct("<6q8s")
#: Ids of a block (a multiple of 64), and ids and documents after which a task begins another file.
BLOCK, FILE_IDS, FILE_DOCS = 1 << 16, 1 << 27, 1 << 20
#: Ids that a reader holds at a time, but for the last ones of a longer document.
READ_IDS = 1 << 21
#: Words whose ids a worker remembers, and characters of the longest of them.
WORDS, WORD_CHARS = 3 << 18, 40


# ------------------------------------------------------------------- packing


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, 64 of them in `bits` words; the last group is filled with zeros."""
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(ids)] = ids
    v = padded.reshape(groups, 64).T
    out = np.zeros((bits, groups), np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        out[word] |= v[i] << np.uint64(shift)
        if shift + bits > 64:
            out[word + 1] |= v[i] >> np.uint64(64 - shift)
    return out.T.astype("<u8").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of what pack() made."""
    words = np.frombuffer(raw, "<u8").reshape(-1, bits).T
    out = np.empty((words.shape[1], 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        v = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | (words[word + 1] << np.uint64(64 - shift))
        out[:, i] = v & mask
    return out.reshape(-1)[:n]


# --------------------------------------------------------------------- files


def opened(url: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or file, by its scheme: local files, HDFS and the object stores that Arrow knows."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", url)))


class Writer:
    """One file, written from front to back; what it holds in memory is a block and the index."""

    def __init__(self, url: str, bits: int):
        self.url, self.bits = url, bits
        fs, path = opened(url)
        self.out = fs.open_output_stream(path)
        self.out.write(MAGIC)
        self.at, self.n_ids, self.n_docs = len(MAGIC), 0, 0
        self.blocks: list[int] = []
        self.docs: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.rest = np.zeros(0, np.uint32)

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.blocks.append(self.at)
        self.out.write(raw)
        self.at += len(raw)

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents and all their ids, end to end."""
        self.docs.append(doc_ids.astype("<i8"))
        self.starts.append((self.n_ids + np.cumsum(lengths) - lengths).astype("<i8"))
        self.n_ids += len(ids)
        self.n_docs += len(doc_ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) - len(ids) % BLOCK
        for a in range(0, whole, BLOCK):
            self._block(ids[a : a + BLOCK])
        self.rest = ids[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        index = self.at
        for part in (*self.docs, *self.starts, np.array([*self.blocks, index], "<i8")):
            self.out.write(part.tobytes())
        self.out.write(TRAILER.pack(self.n_ids, self.n_docs, len(self.blocks), self.bits, BLOCK, index, MAGIC))
        self.out.close()


class Reader:
    """Random access to one file: the index is read at once, blocks only when they are asked for."""

    def __init__(self, url: str):
        fs, path = opened(url)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.n_ids, self.n_docs, n_blocks, self.bits, self.block, index, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{url} is no file of packed ids")
        flat = np.frombuffer(self.file.read_at(8 * (2 * self.n_docs + n_blocks + 1), index), "<i8")
        self.doc_ids, starts, self.offsets = np.split(flat, [self.n_docs, 2 * self.n_docs])
        self.starts = np.append(starts, self.n_ids)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b-1 of the file."""
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        raw = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        n = min((last + 1) * self.block, self.n_ids) - first * self.block
        return unpack(raw, n, self.bits)[a - first * self.block : b - first * self.block]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, its end id among them."""
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def portions(self, most: int = READ_IDS) -> Iterator[tuple[int, int]]:
        """Runs of documents of at most so many ids, or one document."""
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + most, "right")) - 1)
            yield i, j
            i = j

    def close(self) -> None:
        self.file.close()


# ------------------------------------------------------------------ encoding

#: What the byte-level pattern takes for white space.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Runs that the pattern never divides and never joins: letters, digits, marks but the apostrophe, one line end.
RUNS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]++|[0-9]++|[!-&(-/:-@\\[-`{-~]++|\n(?!\n)")
ONLY_RUNS = re.compile(f"(?:{RUNS.pattern})++")
MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: visible ones of Latin-1 for themselves, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Runs(dict):
    """Ids (as bytes) of a run, by the run; filled when one is asked for, emptied when it is full."""

    def __init__(self, tokenizer):
        self.pieces, self.alphabet = tokenizer.model.tokenize, byte_alphabet()

    def __missing__(self, run: str) -> bytes:
        if not run.isascii() or run[0] <= " ":
            ids = self.pieces(run.encode().decode("latin-1").translate(self.alphabet))
        else:
            ids = self.pieces(run)
        return self.keep(run, array("I", [t.id for t in ids]).tobytes())

    def keep(self, run: str, ids: bytes) -> bytes:
        if len(run) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.clear()
            self[run] = ids
        return ids


class Words(Runs):
    """Ids of a word that follows a space, by the word without the space."""

    def __init__(self, tokenizer, special: list[str]):
        super().__init__(tokenizer)
        self.tokenizer, self.special, self.bare, self.space = tokenizer, special, Runs(tokenizer), self.alphabet[0x20]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def run(self, run: str) -> bytes:
        """Of a run after a space."""
        coded = run if run.isascii() else run.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.pieces(self.space + coded)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and word.isascii():
            ids = self.run(word)
        elif word[-1:] in MARKS and word[:-1].isalpha() and word.isascii():
            ids = self[word[:-1]] + self.bare[word[-1]]
        elif ONLY_RUNS.fullmatch(word) and not any(s in word for s in self.special):
            first, *rest = RUNS.findall(word)
            if first == "\n":
                ids = self.whole(f" {word}")
            else:
                ids = self.run(first) + b"".join(map(self.bare.__getitem__, rest))
        else:
            ids = self.whole(f" {word}")
        return self.keep(word, ids)


class Encoder:
    """Whole texts to ids, as the tokenizers library encodes them.

    The library's byte-level pattern always parts a text at a space that follows no white space.  So for
    such vocabularies each word is encoded once and remembered, which is several times as fast as encoding
    every text anew; texts with other white space before a space are encoded whole, as are all texts where the file says
    anything besides (normalising, other patterns, special tokens with white space)."""

    doubled = tuple(f"{c} " for c in SPACES)

    def __init__(self, raw: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw)
        told = json.loads(raw)
        pattern, model = told["pre_tokenizer"] or {}, told["model"]
        plain = pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not pattern.get("add_prefix_space")
        plain &= model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain &= not any(told.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
        special = told["added_tokens"]
        # One of a single letter, or of a letter and a mark, would be in words that are taken for letters alone.
        plain &= not any(set(t["content"]) & set(SPACES) or len(t["content"]) < 3 or t["content"][:-1].isalpha() or t["lstrip"] or t["rstrip"] or t["single_word"] for t in special)
        self.words = Words(self.tokenizer, [t["content"] for t in special]) if plain else None

    def __call__(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers of this machine."""
        if not text:
            return b""
        if self.words is None:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if any(c in text for c in self.doubled):
            return self.words.whole(text)
        first, *rest = text.split(" ")
        return (self.words.whole(first) if first else b"") + b"".join(map(self.words.__getitem__, rest))


_encoders: dict[int, Encoder] = {}


def encoder(raw: str) -> Encoder:
    """One for a worker process, as it takes time to load and remembers words."""
    key = hash(raw)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(raw)
    return _encoders[key]


def id_bits(raw: str, end_id: int) -> int:
    """Least bits that hold every id of the vocabulary and the end id."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_str(raw).get_vocab_size(with_added_tokens=True) - 1, end_id, 1).bit_length()


# ---------------------------------------------------------------------- jobs

FILES = "part int, seq int, url string, n_docs long, n_ids long"


def _write(folder: str, tokenizer, bits: int, end_id: int, file_ids: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer.value), array("I", [end_id]).tobytes()
        part, seq, file = TaskContext.get().partitionId(), 0, None

        def done() -> pa.RecordBatch:
            file.close()
            row = [part, seq, file.url, file.n_docs, file.n_ids]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in FILES.split(", ")])

        for b in portions(batches):
            coded = [encode(t or "") + end for t in b.column(1).to_pylist()]
            if file is None:
                file = Writer(f"{folder}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids", bits)
            lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
            file.add(b.column(0).to_numpy(zero_copy_only=False), lengths, np.frombuffer(b"".join(coded), np.uint32))
            if file.n_ids >= file_ids or file.n_docs >= FILE_DOCS:
                yield done()
                seq, file = seq + 1, None
        if file is not None:
            yield done()

    return work


def write_ids(docs: DataFrame, raw: str, end_id: int, folder: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all documents to files in folder; FILES and `start`, the ids in all files before.

    Each text is encoded whole, without added special tokens, and end_id follows it.  A null or empty text has
    the end id alone.  Rows without doc_id are left out; rows of one doc_id are documents of their own, by
    text.  Extra columns are ignored; an empty table gives no file.  Texts of any length are whole: a document may be
    longer than a file is meant to be, and goes on over blocks.  folder is one that every executor can write to.

    Texts are shuffled once, by ranges of doc_id (and a hash of the text, so that one doc_id can't fill a task)."""
    spark = docs.sparkSession
    rows = identified(docs).where("doc_id is not null").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    made = dealt.mapInArrow(_write(folder, spark.sparkContext.broadcast(raw), id_bits(raw, end_id), end_id, file_ids), FILES)
    files = staged(made, "id-files")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row a task of the writing job, so this window is over as many rows as that had tasks.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return staged(files.withColumn("own", own).join(before, "part").select("part", "seq", "url", "n_docs", "n_ids", (F.col("before") + F.col("own")).alias("start")), "id-files")


def _checksums(most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file = Reader(url)
                for i, j in file.portions(most):
                    at = file.starts[i : j + 1]
                    if j == i + 1:  # perhaps a very long one: a part of it at a time
                        crc = 0
                        for a in range(int(at[0]), int(at[1]), most):
                            crc = zlib.crc32(file.ids(a, min(a + most, int(at[1]))).astype("<u4"), crc)
                        sums = [crc]
                    else:
                        raw, own = memoryview(file.ids(int(at[0]), int(at[-1])).astype("<u4").tobytes()), (at - at[0]).tolist()
                        sums = [zlib.crc32(raw[4 * p : 4 * q]) for p, q in zip(own[:-1], own[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (file.doc_ids[i:j], start + at[:-1], np.diff(at), sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                file.close()

    return work


def read_checksums(files: DataFrame, most: int = READ_IDS) -> DataFrame:
    """Per document, from the files: its first id's place in the corpus, how many ids it has, and their CRC."""
    n = max(files.count(), 1)
    return files.repartitionByRange(n, "part", "seq").select("url", "start").mapInArrow(_checksums(most), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id and all ids of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url in b.column(0).to_pylist():
                file = Reader(url)
                for i, j in file.portions():
                    at = (file.starts[i : j + 1] - file.starts[i]).astype(np.int32)
                    ids = file.ids(int(file.starts[i]), int(file.starts[j])).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids[i:j]), pa.ListArray.from_arrays(pa.array(at), pa.array(ids))], names=["doc_id", "ids"])
                file.close()

    return files.repartitionByRange(max(files.count(), 1), "part", "seq").select("url").mapInArrow(work, "doc_id long, ids array<int>")


def new_folder(spark: SparkSession) -> str:
    """An empty folder beside the staged tables, with its scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/packed-ids-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    return fs.makeQualified(path).toString()


def op11_packed_ids(spark, sf_dir: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    with open(tokenizer, encoding="utf-8") as f:
        raw = f.read()
    return read_checksums(write_ids(table(spark, sf_dir, "documents"), raw, end_id, new_folder(spark)))
