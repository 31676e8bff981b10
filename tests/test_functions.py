"""Literal cases of the functions, sources and streaming parts."""

import datetime as dt

from pyspark.sql import functions as F

from loomgraph.functions import text as x
from loomgraph.operators.graph import connected_components, expand
from loomgraph.plans.aggregates import score_checks
from loomgraph.plans.joins import resolve_names
from loomgraph.plans.ranking import sessions
from loomgraph.plans.sinks import append, delete, upsert
from loomgraph.sources import tables
from loomgraph.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text(spark):
    lit = F.lit
    assert set(one(spark, x.tokens(lit("john.doe@x-y A")))) == {"john", "doe"}
    assert one(spark, x.token_similarity(x.tokens(lit("harbor-app")), x.tokens(lit("Harbor App")))) == 1.0
    assert abs(one(spark, x.token_similarity(x.tokens(lit("Map Browse Page")), x.tokens(lit("Browse")))) - 1 / 3) < 1e-9
    assert one(spark, x.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0
    assert [one(spark, x.singular(lit(w))) for w in ("categories", "class", "pets", "gas")] == ["category", "class", "pet", "gas"]
    assert one(spark, x.truncate(lit("abcdefghij"), 8)) == "abcde..."
    assert [(c.start, c.end) for c in one(spark, x.chunks(F.repeat(lit("a"), 2500)))] == [(0, 1000), (800, 1800), (1600, 2500)]
    assert [(c.start, c.end) for c in one(spark, x.chunks(F.repeat(lit("a"), 1000)))] == [(0, 1000)]
    assert [one(spark, x.half_up(lit(v))) for v in (-2.5, 2.5)] == [-2, 3]
    assert one(spark, x.html_text(lit("<p>a &amp;lt; b</p><script>x</p></script><div>c</div>"))) == "a < b\nc"
    assert one(spark, x.truthy(lit(""), lit("d"))) == "d"


def test_checks(spark):
    m = spark.createDataFrame([("a", 1.0), ("b", 15.0)], "key string, actual double")
    c = spark.createDataFrame([("a", "gte", 2.0, None), ("b", "within", 10.0, None)], "key string, mode string, target double, tolerance double")
    assert {(r.key, r.score, r.severity) for r in score_checks(m, c).collect()} == {("a", 50, "medium"), ("b", 100, "low")}


def test_sessions(spark):
    t = lambda d, h, m: dt.datetime(2024, 1, d, h, m)
    rows = [(1, "u", t(1, 23, 30)), (2, "u", t(2, 0, 10)), (3, "v", t(1, 1, 0)), (4, "v", t(1, 7, 0)), (5, "v", t(1, 13, 1))]
    got = sessions(spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp_ntz"), "user_id")
    assert {(r.event_id, r.session) for r in got.collect()} == {(1, 1), (2, 2), (3, 1), (4, 1), (5, 2)}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, "A"), (2, 3, "B"), (3, 4, "A"), (7, 8, "A")], "src long, dst long, type string")
    assert {tuple(r) for r in connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)}
    seeds = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.hop) for r in expand(e, seeds, 2, ["B"]).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_resolve(spark):
    refs = spark.createDataFrame([("Har-Bor APP",), ("map browse page",), ("nothing",)], "ref string")
    names = spark.createDataFrame([(1, "har bor app"), (2, "Map Browse"), (3, "Other")], "id long, name string")
    assert {(r.ref, r.id, r.tier) for r in resolve_names(refs, names).collect()} == {("Har-Bor APP", 1, 1), ("map browse page", 2, 2)}


def test_sources(spark):
    chat = spark.createDataFrame(
        [({"U1": "ann"}, [({"id": "C1", "name": "general"}, [("0", "hi <@U1> <@U9>", {"name": "bob"}), ("60", "yes", {"name": "ann"})])])],
        "user_map map<string,string>, messages_by_channel array<struct<channel:struct<id:string,name:string>,messages:array<struct<ts:string,text:string,user_profile:struct<name:string>>>>>",
    )
    r = tables.chat_channels(chat).first()
    assert r.content == "1970-01-01 00:00 bob: hi @ann <@U9>\n1970-01-01 00:01 ann: yes" and r.participants == ["bob", "ann"]
    tickets = spark.createDataFrame([([(1, "s", "d", [("f", "v")]), (2, None, "d", [])],)], "tickets array<struct<id:int,subject:string,description:string,custom_fields:array<struct<id:string,value:string>>>>")
    assert [(t.source_id, t.custom_fields) for t in tables.feedback(tickets).collect()] == [("1", {"f": "v"})]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert [r.k for r in delete(old, new, ["k"]).collect()] == [1]
    runs = old.selectExpr("v", "k AS run_id", "'x' AS execution_id")
    append(runs, str(tmp_path / "o"))
    append(runs, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).where("run_id = 1").count() == 2


def test_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(1, "a", t), (1, "a", t), (1, "b", t)], "doc_id long, text string, ts timestamp")
    docs.write.parquet(str(tmp_path / "in"))
    stream = ingest.new_versions(ingest.document_stream(spark, str(tmp_path / "in"), "doc_id long, text string, ts timestamp"))
    ingest.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
