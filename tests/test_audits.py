"""Small cases of raw inputs, statuses, traversal checks, built edges and the merging stream."""

from pyspark.sql import functions as F

from loomgraph.operators.vectors import with_previous
from loomgraph.plans import audits
from loomgraph.streaming import ingest


def found(df):
    return {tuple(r) for r in df.collect()}


def test_raw_inputs_refuse_and_keep_the_first_time(spark):
    rows = [("c", "jira", '{"issues":[1,2]}', 1), ("c", "jira", "words", 2), ("c", "fax", "x", 3), ("c", "slack", None, 4), ("c", "github", "[]", 5), ("c", "github", '{"a":', 0), (None, "slack", "{}", 6)]
    got = found(audits.raw_inputs(spark.createDataFrame(rows, "company string, source string, data string, seq long")))
    assert got == {("c", "jira", "words", "human_text", 1, 2, 1), ("c", "github", "[]", "json", 1, 5, 0), (None, "slack", "{}", "json", 1, 6, 6)}


def test_status_needs_all_or_one(spark):
    rows = [("a", "done"), ("a", "closed"), ("b", "done"), ("b", "active"), ("c", "open"), ("c", None), ("d", "done"), ("d", "open"), ("e", None)]
    df = spark.createDataFrame(rows, "k string, s string").groupBy("k").agg(audits.status_of(F.col("s"), audits.TICKET_DONE, audits.TICKET_RUNNING, audits.TICKET_WAITING))
    assert found(df) == {("a", "completed"), ("b", "active"), ("c", "proposed"), ("d", None), ("e", None)}


def test_traversal_reaches_an_owner_over_a_rule(spark):
    nodes = [(1, "p", "project", True, False, 0), (2, "rule", "process", False, True, 0), (3, "ann", "person", False, False, 2), (4, "q", "ticket", None, False, 1), (5, "z", "project", True, None, 0)]
    edges = [(2, 1, "APPLIES_TO"), (2, 3, "OWNED_BY"), (2, 4, "APPLIES_TO"), (4, 9, "OWNED_BY"), (1, 1, "USES")]
    got = found(audits.traversal_checks(spark.createDataFrame(nodes, "node long, name string, type string, focus boolean, rule boolean, refs int"), spark.createDataFrame(edges, "src long, dst long, type string")))
    assert got == {(1, "p", True, True, True), (4, "q", True, True, True), (5, "z", False, False, False)}


def test_built_edges_of_odd_nodes(spark):
    schema = "node long, type string, name string, alias string, attributes map<string, string>, relations array<struct<target: string, type: string>>"
    nodes = [(1, "ticket", "A", None, {"assignee": " BOB "}, [("a", "is a"), ("Bob", "works with"), ("bob", "works  with"), (None, "x")]), (2, "person", "Bob", "b", None, None), (3, None, "bob", "a", {}, [])]
    assert found(audits.built_edges(spark.createDataFrame(nodes, schema))) == {(1, 2, "OWNED_BY"), (1, 2, "WORKS_WITH")}


def test_undocumented_work_on_empty_tables(spark):
    tickets = spark.createDataFrame([(1, "New shop [web] - 12", "Done"), (2, "ab", "open"), (3, "gone", None)], "id long, title string, status string")
    names, titles = spark.createDataFrame([], "name string"), spark.createDataFrame([], "id long, title string")
    assert found(audits.undocumented(tickets, names, titles)) == {(1, "New shop", "past_undocumented"), (2, "ab", "ongoing_undocumented")}
    titles = spark.createDataFrame([(1, "a tab"), (2, "the new shop"), (3, None)], "id long, title string")
    assert found(audits.undocumented(tickets, names, titles)) == set()


def test_merging_stream_keeps_the_newest_and_tells_what_changed(spark, tmp_path):
    schema = "doc_id long, text string, ts timestamp"
    at = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, t string").select("doc_id", "text", F.to_timestamp("t").alias("ts"))
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def deliver(rows):
        at(rows).coalesce(1).write.mode("append").parquet(src)
        ingest.merge_stream(spark.readStream.schema(schema).parquet(src), out, cp).awaitTermination(120)

    deliver([(1, "a", "2024-01-01"), (1, "b", "2024-01-02"), (2, "c", "2024-01-01"), (3, None, "2024-01-01")])
    deliver([(1, "b", "2024-01-03"), (2, "d", "2024-01-02"), (3, None, "2024-01-02"), (4, "", "2024-01-01")])
    deliver([(2, "late", "2023-01-01")])
    read = lambda p: {tuple(r) for r in spark.read.parquet(f"{out}/{p}").select("doc_id", "text").collect()}
    assert read("table/0") == {(1, "b"), (2, "c"), (3, None)}
    assert read("changes/1") == {(2, "d"), (4, "")}
    assert read("changes/2") == set()
    assert read("table/2") == read("table/1") == {(1, "b"), (2, "d"), (3, None), (4, "")}


def test_rows_before_of_a_frequent_and_a_null_key(spark):
    rows = [("a" if i % 7 else None if i % 2 else "b", i, i * i) for i in range(500)]
    got = found(with_previous(spark.createDataFrame(rows, "k string, i long, v long").repartition(5), "k", "i", "v").select("i", "before"))
    last, want = {}, set()
    for k, i, v in rows:
        want.add((i, last.get(k)))
        last[k] = v
    assert got == want


def test_conventions_by_ties_of_any_weight(spark):
    nodes = spark.createDataFrame([(1, False, 0), (2, True, 1), (3, True, 9), (4, True, 5), (5, False, 0), (6, True, 7)], "node long, convention boolean, refs int")
    edges = spark.createDataFrame([(2, 1, "APPLIES_TO", 0.9), (3, 5, "APPLIES_TO", 0.4), (5, 1, "CONTAINS", 1.0), (2, 5, "APPLIES_TO", 1.0), (8, 1, "APPLIES_TO", 1.0)], "src long, dst long, type string, weight double")
    got = found(audits.conventions(spark.createDataFrame([(1,), (1,), (4,)], "node long"), edges, nodes, 3))
    assert got == {(1, 2, 0.9, "direct", 1), (1, 6, 0.3, "global_fallback", 2), (1, 4, 0.3, "global_fallback", 3)} | {(4, n, 0.3, "global_fallback", i) for i, n in enumerate((3, 6, 4), 1)}
