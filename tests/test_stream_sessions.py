"""Sessions of a stream are those of a table, whatever the order of rows, over restarts, without late rows."""

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from loomgraph.plans.ranking import sessions
from loomgraph.streaming.sessions import stream_sessions

SCHEMA = "user_id long, ts timestamp, event_id long, thread string"


def run(spark, source, out, checkpoint):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    stream_sessions(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)


def test_sessions_of_a_stream(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    rng, start = random.Random(4), datetime(2024, 1, 1, 1, tzinfo=UTC)
    rows, at = [], {u: start for u in range(4)}
    for i in range(160):
        u = rng.choice([0, 0, 1, 2, 3])
        at[u] += timedelta(hours=rng.choice([0, 1, 2, 5, 7, 30]), minutes=rng.randrange(50))
        rows.append((u, at[u], i, rng.choice([None, "a", "a", "b"])))
    rows.sort(key=lambda r: r[1])
    parts = [rows[:60], rows[60:110], rows[110:]]
    # Within a part rows come in any order; the first of the second part comes with the first part, before its time.
    parts[0].append(parts[1].pop(0))
    for p in parts:
        rng.shuffle(p)
    end = (9, max(r[1] for r in rows) + timedelta(days=9), 9999, None)
    late = (0, start, 8888, "b")  # comes when the watermark is far beyond it
    write = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        write(parts[0] + [(None, start, 1, None), (1, None, 2, None)])
        run(spark, source, out, checkpoint)
        some = spark.read.parquet(out).count()
        for more in (parts[1], parts[2], [end], [late, (9, end[1] + timedelta(days=9), 9998, None)]):
            write(more)
            run(spark, source, out, checkpoint)  # a new start each time, from the checkpoint
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {r.event_id: (r.key, r.session) for r in spark.read.parquet(out).collect() if r.key != 9}
    want = sessions(spark.createDataFrame(rows, SCHEMA), "user_id").select("event_id", "user_id", F.col("session")).collect()
    assert 0 < some < len(rows) and got == {r.event_id: (r.user_id, r.session) for r in want}
    assert spark.read.parquet(out).groupBy("event_id").count().where("count > 1").count() == 0
