"""A training corpus from raw documents in five stages, each one of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.chunks import dedup_substrings
from loomgraph.llm.common import staged
from loomgraph.llm.langid import held_out, identify
from loomgraph.llm.minhash import near_duplicates
from loomgraph.llm.mixing import mix
from loomgraph.llm.pieces import encode_documents

#: Share of the tokens that mixing keeps.
MIX_RATE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those that no model of one explains are left out.

    The models are learned from the training documents of the stage's input.  A null or empty text, or one without
    a letter, goes; a null lang teaches nothing but its document may stay.  A repeated row stays as often as it
    is there; texts of any length are whole; of equal entropies the first language counts.  Columns that
    documents don't have are left out; an empty table gives no rows."""
    training = docs.where(~held_out()).select("doc_id", "text", "lang")
    found = identify(docs, training, keep=("text", "lang", "source", "n_chars"))
    return found.where("not rejected").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one of the least doc_id.

    Null, empty and blank texts are copies of nothing and stay.  Rows without doc_id go; of the rows of one doc_id
    one stays, the least by text, lang, source and n_chars, nulls first.  Texts of any length are whole; columns
    that documents don't have are left out; an empty table gives no rows."""
    kept = near_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id").distinct()
    left = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi")
    one = left.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("d"))
    return one.select("doc_id", "d.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; a text of which nothing is left goes.

    A passage stays where it begins first, by doc_id and place.  A null or empty text stays, as the empty text; repeated rows
    are one document and keep their passages, other texts of one doc_id are documents of their own.  Rows without doc_id go.
    Texts of any length are whole; columns that
    documents don't have are left out; an empty table gives no rows."""
    left = dedup_substrings(docs, keep=("lang", "source"))
    return left.where("n_bytes = 0 or text <> ''").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens lie in the target proportions of source, language and topic.

    A null source or language is a value of its own; a document without tokens is never sampled.  Repeated rows are
    sampled alike, by their doc_id; texts of any length count whole; columns that documents don't have are left
    out; an empty table gives no rows."""
    chosen = mix(docs, keep=("text", "lang", "source", "n_chars"), rate=MIX_RATE).where("sampled")
    return chosen.select("doc_id", *[F.col(f"kept_{c}").alias(c) for c in COLUMNS[1:]])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether they decode to its text.

    A null text is as the empty one and has no ids.  Repeated rows give a row each; texts of any length are whole;
    other columns are left out; an empty table gives no rows."""
    return encode_documents(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("encoding", encoding)]

#: Language models and piece encoding are not expressible in SQL; tests/llm holds what run() does after the language
#: stage to plain Python, and the language models to one computed by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
