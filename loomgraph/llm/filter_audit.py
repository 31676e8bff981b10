"""Operator 12: how filters act on one another, by replay of every order.

Each document's filters are a set of bits, computed once.  The documents are crossed with the 120 broadcast orders of
the five filters, the five steps of an order are exploded, the first filter that fails tells where the document is
removed, and conditional sums by part, order and step are combined in the tasks before anything is shuffled: a task
hands on one row for each part, order and step that it met, however many documents it read."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_unique, staged, table

FILTERS = "ABCDE"
#: Fewest words; fewest distinct words and most capitals in a hundred.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
SPACE, MARKS = r"[\x20\x09-\x0D]+", "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> dict[str, Column]:
    """Of each filter that looks at one text alone, whether the text fails it."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < MIN_WORDS,
        "B": 100 * distinct < MIN_DISTINCT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS * F.length(text),
        "D": text.rlike(MARKS),
    }


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (the bits of the filters that a document fails), good and toxic of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = F.lit(0)
    for letter, fails in failures(F.col("text")).items():
        mask = mask + F.when(fails, bit(letter)).otherwise(0)
    flags = staged(own.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "flags")
    copies = flags.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    met = join_unique(flags, copies, ["digest"], "left").select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("first"), bit("E")).otherwise(0)).alias("mask"))
    of = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    of = of.where("doc_id is not null and (good or toxic)").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # Rows without an id have no label; in the join they would all go to one task.
    known = met.where("doc_id is not null").join(of, "doc_id", "left")
    rest = met.where("doc_id is null").select("doc_id", "part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return known.unionByName(rest).select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (source), filter_order and step: COUNTS, the step's filter, and shapley.

    A null text is empty; a null source is the part ''.  E fails where a row of a smaller doc_id has the same text (told by
    SHA-256), so rows of one doc_id are no copies of one another, and a row without doc_id is neither copy nor origin and has
    no label.  A label counts if any row of its doc_id has it.  Each row of a repeated document counts.  Texts of any
    length are whole; extra columns are ignored; an empty table gives no rows.

    Texts are read once and never shuffled; digests and ids are, very frequent digests by broadcast."""
    spark = docs.sparkSession
    orders = [("".join(o), i, *map(bit, o)) for i, o in enumerate(permutations(FILTERS))]
    orders = spark.createDataFrame(orders, "filter_order string, o int, b1 int, b2 int, b3 int, b4 int, b5 int")
    bits = [F.col(f"b{i}") for i in range(1, 6)]
    fails = [F.col("mask").bitwiseAND(b) != 0 for b in bits]
    first = F.lit(6)
    for i in range(5, 0, -1):
        first = F.when(fails[i - 1], i).otherwise(first)
    runs = flagged(docs, labels).crossJoin(F.broadcast(orders.select("o", *bits))).select("part", "o", "mask", "good", "toxic", first.alias("first"), F.array(*bits).alias("bits"))
    steps = runs.select("part", "o", "mask", "good", "toxic", "first", F.posexplode("bits").alias("at", "b"))
    step, removed = F.col("at") + 1, F.col("first") == F.col("at") + 1
    conditions = (F.col("first") > step, removed, (F.col("mask").bitwiseAND(F.col("b")) != 0) & (F.col("first") < step), F.col("mask") == F.col("b"), removed & F.col("good"), removed & F.col("toxic"))
    totals = steps.groupBy("part", "o", "at").agg(*[F.sum(c.cast("long")).alias(n) for n, c in zip(COUNTS, conditions, strict=True)])
    named = totals.join(F.broadcast(orders.select("o", "filter_order")), "o").withColumn("step", step.cast("int")).withColumn("filter", F.substring(F.col("filter_order"), F.col("at") + 1, F.lit(1)))
    return named.select("part", "filter_order", "step", "filter", *COUNTS, F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def sql() -> str:
    """The same as DuckDB SQL."""
    letters = ", ".join(f"('{x}', {bit(x)})" for x in FILTERS)
    differ = " AND ".join(f"{FILTERS[i].lower()}.b <> {FILTERS[j].lower()}.b" for i in range(5) for j in range(i))
    names = ", ".join(f"letters {x.lower()}" for x in FILTERS)
    sums = {"kept": "f > step", "removed": "f = step", "redundant": "mask & b <> 0 AND f < step", "unique_fails": "mask = b", "good_lost": "f = step AND good", "toxic_lost": "f = step AND toxic"}
    return rf"""WITH letters(l, b) AS (VALUES {letters}),
    orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM {names} WHERE {differ}),
    base AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    flags AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(words) < {MIN_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '{MARKS}') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
        FROM base LEFT JOIN marks USING (doc_id)),
    runs AS (SELECT *, coalesce(list_position(list_transform(bits, lambda x: (mask & x) <> 0), true), 6) AS f FROM flags CROSS JOIN orders),
    steps AS (SELECT *, bits[step] AS b FROM runs CROSS JOIN (SELECT unnest(range(1, 6))::INT AS step)),
    totals AS (SELECT part, filter_order, step, {", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in sums.items())} FROM steps GROUP BY ALL)
    SELECT part, filter_order, step, substr(filter_order, step, 1) AS "filter", {", ".join(sums)}, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM totals"""
