"""The prefix scan against plain loops, with a hot key over many ranges; messages of conversations by hand."""

import random

from pyspark.sql import functions as F

from loomgraph.operators.scan import prefix_scan
from loomgraph.plans.ranking import conversation_lines, messages


def test_prefix_scan(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i // 2, i, rng.choice([None, -1, 2]), rng.choice([None, None, 7, 9])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, o long, id long, s int, v int").repartition(5)
    for ranges in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
        try:
            got = {r.id: (r.total, r.seen) for r in prefix_scan(df, "k", ["o", "id"], F.col("s"), F.col("v"), "total", "seen").collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.enabled")
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        want, now = {}, {}
        for k, _, i, s, v in rows:
            total, seen = now.get(k, (0, None))
            now[k] = want[i] = (total + (s or 0), seen if v is None else v)
        assert got == want
    one = prefix_scan(df, "k", ["o"], step=F.lit(1))
    assert one.columns == ["k", "o", "id", "s", "v", "running"] and one.agg(F.max("running")).first()[0] == sum(r[0] == "hot" for r in rows)
    assert prefix_scan(df.limit(0), "k", ["o"], step=F.lit(1), value=F.col("v")).count() == 0


def test_messages(spark):
    text = "head\nFull conversation:\nlost\n[10:00:00] nobody yet\n  goes on \n\n[10:00:01] <@U1> hello <@U2>, <@U9>\n[10:00:02] more\n[10:00:03] <@U9>   \n[10:00] no time\n[10:00:04] <@U2> Full conversation: again"
    docs = spark.createDataFrame([(1, text), (2, "no marker"), (3, None), (4, "Full conversation:\n[11:00:00] <@U1> x")], "id long, content string")
    names = spark.createDataFrame([("U1", "Ada"), ("U2", "Bo"), ("U2", "Cy"), (None, "x"), ("U3", None)], "user string, name string")
    got = sorted(tuple(r) for r in messages(conversation_lines(docs), names).collect())
    assert got == [
        (1, 1, "10:00:00", "Unknown", "nobody yet\ngoes on"),
        (1, 2, "10:00:01", "Ada", "hello @Bo, <@U9>"),
        (1, 3, "10:00:02", "Ada", "more"),
        (1, 4, "10:00:03", "Ada", "<@U9>\n[10:00] no time"),
        (1, 5, "10:00:04", "Bo", "Full conversation: again"),
        (4, 1, "11:00:00", "Ada", "x"),
    ]
    assert messages(conversation_lines(docs.limit(0)), names.limit(0)).count() == 0
