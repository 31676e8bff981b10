"""Which names texts hold, and where: one pass with an automaton of all names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .graph import written

#: Bytes of names that one automaton, and the broadcast that carries it, are made of.
NAME_BYTES = 1 << 23
#: Characters of text whose finds are handed on together.
PORTION = 1 << 22


def _search(names, kind: pa.DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in names.value:
            automaton.add_word(name, name)
        automaton.make_automaton()

        def out(rows: list) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, pa.string(), pa.int64(), pa.int64()), strict=True)], names=["id", "name", "first", "times"])

        rows, read = [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                found: dict[str, list[int]] = {}
                for end, name in automaton.iter(text):
                    if name in found:
                        found[name][1] += 1
                    else:
                        found[name] = [end + 1 - len(name), 1]
                rows += [(i, name, first, times) for name, (first, times) in found.items()]
                read += len(text)
                if rows and (read >= PORTION or len(rows) >= PORTION >> 4):
                    yield out(rows)
                    rows, read = [], 0
        if rows:
            yield out(rows)

    return work


def occurrences(texts: DataFrame, names: DataFrame, most: int = NAME_BYTES) -> DataFrame:
    """(id, name, first, times): of texts (id, text) the names (name) that each holds, anywhere in it, the place (from 0) of the
    first find and how many there are, those that overlap among them.  Null and empty names and texts hold and are held
    by nothing; a name counts once however often it is listed; each row of texts gives its own rows.

    Only finds leave a task.  Names beyond `most` bytes are dealt to several automata, and texts are read once for each."""
    spark = texts.sparkSession
    names = written(names.where("name <> ''").select("name").distinct())
    size = names.agg(F.sum(F.octet_length("name") + 8)).first()[0] or 0
    blocks = -(-size // most)
    key = F.pmod(F.xxhash64("name"), F.lit(max(blocks, 1)))
    kind = "string" if isinstance(texts.schema["id"].dataType, StringType) else "long"
    texts = texts.select(F.col("id").cast(kind).alias("id"), F.col("text").cast("string").alias("text"))
    schema = f"id {kind}, name string, first long, times long"
    out = spark.createDataFrame([], schema)
    for i in range(blocks):
        if mine := [r.name for r in names.where(key == i).collect()]:
            shared = spark.sparkContext.broadcast(mine)
            out = out.union(texts.mapInArrow(_search(shared, pa.string() if kind == "string" else pa.int64()), schema))
    return out
