"""Operator 8: document fingerprints by spot signatures, with DataFrame functions only.

Common words are anchors; the next CHAIN content words after an anchor are a signature.  A text's
fingerprint is its set of signatures; two texts are compared by the Jaccard similarity of their sets,
and sets of too different length are not compared at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Anchors: common words of English, French, German and Spanish.
ANCHORS = (
    "the of and to in a is that it on for was with as be this by at are from "
    "de la le les des du et un une en que qui dans pour au sur avec il elle "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als "
    "el los las y por del se con una su para es lo"
).split()
#: Content words of a chain.
CHAIN = 2
#: Documents of a bucket of neighbouring ids, and the most buckets; these are two levels of bounds, of LEVEL each.
BUCKET, LEVEL = 4096, 128
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the sorted distinct 64-bit hashes of the chains: the next CHAIN content words after each anchor, fewer at
    the end of a text.  A text without an anchor (as in a script that has no spaces or none of these words) has
    the chains of all its words instead, one of no words that of no words.

    The parts are columns of their own: inside the lambda they would be made anew for each chain."""
    plain = F.trim(F.regexp_replace(F.lower(F.col(text)), BETWEEN_WORDS, " "))
    df = df.withColumn("gaps", F.split(F.concat(F.lit(" "), plain, F.lit(" ")), f"(?<= )(?:{'|'.join(sorted(set(ANCHORS)))}) "))
    # What follows an anchor up to the next one.  One that another anchor follows has the chain of that one.
    df = df.withColumn("parts", F.when(F.size("gaps") > 1, F.filter(F.slice("gaps", 2, F.size("gaps")), lambda g: g != "")).otherwise(F.split(F.trim(F.element_at("gaps", 1)), " ")))
    after = lambda i, between: F.substring_index(F.array_join(F.slice("parts", i, CHAIN), between), " ", CHAIN)
    anchored = F.transform("parts", lambda _, i: F.xxhash64(after(i + 1, "")))
    last = F.when(F.element_at("gaps", -1) == "", F.array(F.xxhash64(F.lit("")))).otherwise(F.array().cast("array<bigint>"))
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.size("parts") - CHAIN + 1, F.lit(1))), lambda i: F.xxhash64(after(i, " ")))
    chains = F.when(F.size("gaps") > 1, F.concat(anchored, last)).otherwise(every)
    return df.withColumn(name, F.array_sort(F.array_distinct(chains))).drop("gaps", "parts")


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def bucket_of(docs: DataFrame) -> Column:
    """The bucket of a doc_id: how many bounds are not over it.  Bounds are quantiles of the ids, so buckets have alike
    many documents however the ids are spread; at most LEVEL**2 of them come to the driver."""
    rows = docs.count()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(LEVEL * LEVEL, max(8 * tasks, rows // BUCKET))
    constants = lambda xs, kind: F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>")
    bounds = docs.agg(F.percentile_approx("doc_id", constants([i / (n + 1) for i in range(1, n + 1)], "double"), 10 * n)).first()[0]
    bounds = sorted(set(bounds or [0]))
    not_over = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("doc_id")))
    level = not_over(constants(bounds[::LEVEL], "bigint"))  # first among every LEVELth, then among the LEVEL from there
    return F.when(level > 0, (level - 1) * LEVEL + not_over(F.slice(constants(bounds, "bigint"), (level - 1) * LEVEL + 1, F.lit(LEVEL)))).otherwise(0)


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, n) dealt to buckets of neighbouring ids, each row with the bucket's next document in
    mind: `late` rows are the first document of the following bucket (after the last: of the first), there to
    be looked at only."""
    docs = docs.withColumn("bucket", bucket_of(docs))
    firsts = docs.groupBy("bucket").agg(F.min("doc_id").alias("doc_id"))  # a row for each bucket
    order = Window.orderBy("bucket")
    to = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy(F.lit(1))))
    late = docs.drop("bucket").join(F.broadcast(firsts.select("doc_id", to.alias("bucket"))), "doc_id")
    columns = ("bucket", "late", "doc_id", "text", "n")
    return docs.withColumn("late", F.lit(0)).select(*columns).union(late.withColumn("late", F.lit(1)).select(*columns))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the
    next document.  Null text is empty; a text without words has the signature of no words, so equal
    texts always have equal fingerprints.  Texts of any length are whole.  doc_id is the key: of repeated rows
    the one with the least text counts.  Rows without doc_id are left out, extra columns ignored; an empty
    table gives no rows.

    The likenesses asked for are of given pairs, so no partition by set length is needed here; near_documents
    has it, for pairs that are to be found."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    twice = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if twice:
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    docs = docs.withColumn("n", F.length("text"))
    # Texts are shuffled once, to buckets of neighbours; signatures are made where they arrive.
    full = with_signatures(with_next(docs).repartition("bucket"), "text", "sigs")
    inside = Window.partitionBy("bucket").orderBy("late", "doc_id")
    met = full.withColumn("next_text", F.lead("text").over(inside)).withColumn("next_sigs", F.lead("sigs").over(inside)).where("late = 0")
    met = met.withColumn("edited", F.expr("concat(substring(text, 1, cast(n - n div 2 as int)), substring(next_text, 1, cast(n div 2 as int)))"))
    met = with_signatures(met, "edited", "edited_sigs")
    return met.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_documents(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs (a, b, similarity), a < b, of documents whose signature sets reach the similarity.

    Documents of equal sets are one class (a pair's ids are the smallest of their classes).  Sets are
    partitioned by length into bands in which only neighbours can reach the similarity, and within a
    band they meet by their rarest signatures alone (prefix filter), so no pair is lost."""
    sets = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = with_signatures(sets, "text", "sigs").select("doc_id", "sigs")
    classes = staged(sets.groupBy("sigs").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("sigs")), "sets")
    one = classes.select("doc_id", "n", F.explode("sigs").alias("s"))
    often = one.groupBy("s").agg(F.count("*").alias("c"))
    by = one.join(often, "s").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("by"))
    prefix = by.select("doc_id", "n", F.posexplode(F.slice("by", 1, F.expr(f"int(n - ceil({least} * n) + 1)"))).alias("at", "x"))
    band = F.floor(F.log(F.col("n")) / -F.log(F.lit(least)))
    prefix = prefix.select("doc_id", "n", "at", F.col("x.s").alias("s"), band.alias("band"))
    other = prefix.select(F.col("doc_id").alias("b"), F.col("n").alias("n2"), F.col("at").alias("at2"), "s", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    met = prefix.join(other, ["s", "band"]).where("doc_id < b").where(f"least(n, n2) >= {least} * greatest(n, n2)").where(f"least(n - at, n2 - at2) * (1 + {least}) >= {least} * (n + n2)")
    pairs = met.select(F.col("doc_id").alias("a"), "b").distinct()
    left, right = classes.select(F.col("doc_id").alias("a"), F.col("sigs").alias("x")), classes.select(F.col("doc_id").alias("b"), F.col("sigs").alias("y"))
    return pairs.join(left, "a").join(right, "b").withColumn("similarity", jaccard(F.col("x"), F.col("y"))).where(F.col("similarity") >= least).select("a", "b", "similarity")


def op8_spot_signatures(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
