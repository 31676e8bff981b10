"""Operator 5: mixing sources to target weights by iterative proportional fitting, with DataFrame
functions only.

Token counts are summed to cells (source, language, topic); cell weights are raked to the three
target marginals in turn; each document is then sampled with its cell's probability, which is the
raked weight over the tokens there are, scaled so that a given share of all tokens is expected, no cell
over 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Most rounds of raking over the three margins, and the greatest relative change of a weight in the last one.
#: It is looked at every so many rounds.
ROUNDS, TOLERANCE, EVERY = 200, 1e-7, 4
#: Share of all tokens that is sampled.
RATE = 0.5
#: Cells that are raked by windows and broadcast to the documents; more are raked by aggregates that are joined back,
#: and joined to the documents by a shuffle, each in SALTS parts.
CELLS, SALTS = 100_000, 32
#: Default targets: shares of a margin go with this power of its tokens, so small ones count for more.
POWERS = {"source": 0.85, "lang": 0.85, "topic": 0.9}
MARGINS = ("source", "lang", "topic")

TOKENS = "CASE WHEN length(text) > 0 THEN length(text) - length(replace(text, ' ', '')) + 1 ELSE 0 END"
#: The form of a text stands for its topic where no topic is given.
TOPIC = "CASE WHEN text LIKE '% | %' THEN 'table' WHEN text LIKE '%http%' OR text LIKE '%@%' THEN 'contact' WHEN text LIKE '%icense%' THEN 'licensed' ELSE 'prose' END"


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from a document's id alone."""
    return F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (source, lang, topic, tokens) with `weight`.  targets: for a margin, (value, share); a value
    that isn't there gets none.  Without a target the margin's own tokens to its power in POWERS.

    There are as many rows as combinations of the margins, however many documents.  Up to CELLS of them a margin's sums
    are windows, so that EVERY rounds are one plan; beyond that, sums are aggregated, joined to the cells and each
    round is a staged table, so no margin's cells gather in one task.  It ends when EVERY rounds have been done and
    the last of them changed no weight by more than the tolerance."""
    cells = staged(cells, "cells")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    small = cells.count() <= CELLS
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m in MARGINS:
        if targets and m in targets:
            share = targets[m].select(F.col("value").alias(m), F.col("share").cast("double").alias(f"share_{m}"))
        else:
            own = cells.groupBy(m).agg(F.pow(F.sum("tokens"), F.lit(POWERS[m])).alias("p"))
            share = own.select(m, (F.col("p") / F.lit(own.agg(F.sum("p")).first()[0])).alias(f"share_{m}"))
        now = now.join(share, m, "left").withColumn(f"share_{m}", F.coalesce(f"share_{m}", F.lit(0.0)))
    cells = staged(now, "cells")

    def raked(now: DataFrame) -> DataFrame:
        now = now.withColumn("was", F.col("weight"))
        for m in MARGINS:
            if small:
                now = now.withColumn("held", F.sum("weight").over(Window.partitionBy(m)))
            else:
                now = now.join(now.groupBy(m).agg(F.sum("weight").alias("held")), m)
            now = now.withColumn("weight", F.when(F.col("held") > 0, F.col("weight") * F.col(f"share_{m}") * total / F.col("held")).otherwise(0.0)).drop("held")
        return now

    for done in range(1, rounds + 1):
        cells = raked(cells)
        if done % EVERY and done < rounds:
            cells = (cells if small else staged(cells, "raked")).drop("was")
            continue
        cells = staged(cells, "raked")
        moved = cells.where("was > 0").agg(F.max(F.abs(F.col("weight") - F.col("was")) / F.col("was"))).first()[0]
        cells = cells.drop("was")
        if (moved or 0) <= tolerance:
            break
    return cells.select(*MARGINS, "tokens", "weight")


def scale_to(cells: DataFrame, rate: float) -> float:
    """What weights are multiplied with, so that probabilities of at most 1 give this share of the tokens
    (or all that have a weight): what cells over 1 leave goes to the others, in rounds."""
    goal = rate * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    scale = 0.0
    while True:
        full = F.col("weight") * scale >= 1
        r = cells.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("tokens") * F.col("weight"))).alias("open")).first()
        now = (goal - (r.full or 0)) / r.open if r.open else scale
        if now <= scale * (1 + 1e-12):
            return scale
        scale = now


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: str = TOPIC, rounds: int = ROUNDS, keep: tuple[str, ...] = (), rate: float = RATE) -> DataFrame:
    """Per document: doc_id, source, lang, topic, n_tokens, weight (its cell's raked tokens over tokens),
    probability, sampled, and the columns to keep (as they are in docs, under kept_<name>).

    A null source or language is the value 'unknown'; null or empty text has no tokens, and a cell
    without tokens probability 0.  The share `rate` of all tokens is expected (all that have a weight, if
    these are fewer), and probabilities are at most 1.  Documents of one cell are alike but for their ids,
    so there are no ties to break; a repeated row is one more document, sampled alike.  Without doc_id
    `sampled` is null, so no filter keeps the row.  Texts of any length
    count whole.  Extra columns are ignored; an empty table gives no rows.  Two passes over the texts; only
    cells are shuffled."""
    unknown = F.lit("unknown")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), unknown).alias("source"), F.coalesce(F.col("lang").cast("string"), unknown).alias("lang"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    base = base.select("doc_id", "source", "lang", F.expr(topic).alias("topic"), F.expr(TOKENS).cast("long").alias("n_tokens"), *[f"kept_{c}" for c in keep])
    cells = base.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    raked = rake(cells, targets, rounds).withColumn("weight", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    raked = staged(raked, "weights")
    raked = raked.select(*MARGINS, "weight", F.least(F.col("weight") * scale_to(raked, rate), F.lit(1.0)).alias("probability"))
    if raked.count() <= CELLS:
        out = base.join(F.broadcast(raked), list(MARGINS))
    else:
        salted = raked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = base.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*MARGINS, "salt"])
    return out.select("doc_id", *MARGINS, "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), (uniform(F.col("doc_id")) < F.col("probability")).alias("sampled"), *[f"kept_{c}" for c in keep])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def sql() -> str:
    """The same as DuckDB SQL: raking is a recursive table of ROUNDS at most."""
    steps = [
        f"base AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, {TOPIC} AS topic, CAST({TOKENS} AS BIGINT) AS n_tokens FROM documents)",
        "cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM base GROUP BY source, lang, topic)",
    ]
    for m in MARGINS:
        steps.append(f"t_{m} AS (SELECT {m}, pow(sum(tokens), {POWERS[m]}) AS p FROM cells GROUP BY {m})")
        steps.append(f"s_{m} AS (SELECT {m}, p / sum(p) OVER () AS share FROM t_{m})")
    shares = ", ".join(f"s_{m}.share AS share_{m}" for m in MARGINS)
    joins = " ".join(f"JOIN s_{m} ON c.{m} = s_{m}.{m}" for m in MARGINS)
    steps.append(f"w0 AS (SELECT c.*, sum(c.tokens) OVER () AS total, c.tokens AS weight, {shares} FROM cells c {joins})")
    one = f"SELECT *, weight AS was FROM rounds WHERE k < {ROUNDS} AND (k % {EVERY} <> 0 OR moved > {TOLERANCE})"
    for m in MARGINS:
        held = f"sum(weight) OVER (PARTITION BY {m})"
        one = f"SELECT * REPLACE (CASE WHEN {held} > 0 THEN weight * share_{m} * total / {held} ELSE 0 END AS weight) FROM ({one})"
    columns = "source, lang, topic, tokens, total, " + ", ".join(f"share_{m}" for m in MARGINS) + ", weight"
    moved = "max(CASE WHEN was > 0 THEN abs(weight - was) / was ELSE 0 END) OVER ()"
    steps.append(f"rounds AS (SELECT {columns}, 0 AS k, CAST(1 AS DOUBLE) AS moved FROM w0 UNION ALL SELECT {columns}, k + 1, {moved} FROM ({one}))")
    steps.append("f AS (SELECT source, lang, topic, tokens, total, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS weight FROM rounds WHERE k = (SELECT max(k) FROM rounds))")
    by = "ORDER BY weight DESC, source, lang, topic ROWS BETWEEN"
    steps.append(f"o AS (SELECT weight, {RATE} * total - coalesce(sum(tokens) OVER ({by} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS goal, sum(tokens * weight) OVER ({by} CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM f WHERE weight > 0)")
    steps.append("scale AS (SELECT arg_max(goal / open, weight) AS s FROM o WHERE weight * goal / open < 1)")
    steps.append("p AS (SELECT source, lang, topic, weight, CASE WHEN weight = 0 THEN 0 ELSE least(coalesce(weight * s, 1), 1) END AS probability FROM f CROSS JOIN scale)")
    return (
        "WITH RECURSIVE " + ", ".join(steps) + " SELECT b.doc_id, b.source, b.lang, b.topic, b.n_tokens, round(p.weight, 6) AS weight, round(p.probability, 6) AS probability, "
        "CAST(('0x' || substr(md5(CAST(b.doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < p.probability AS sampled "
        "FROM base b JOIN p ON b.source = p.source AND b.lang = p.lang AND b.topic = p.topic"
    )
