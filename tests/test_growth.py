"""Rows that steps make between input and result: no more where names, words and keys repeat a lot."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import clusters, graph
from loomgraph.operators.graph import written
from loomgraph.operators.vectors import at_least, compare
from loomgraph.plans.audits import conventions as conventions_of
from loomgraph.plans.completion import conventions
from loomgraph.plans.decisions import resolve_titles
from loomgraph.plans.packs import precedents
from loomgraph.plans.resolution import consolidated, resolved
from loomgraph.plans.reviews import _reviews
from loomgraph.plans.updates import u06_positional_update
from loomgraph.plans.wiring import fitting_rules, wire


@pytest.fixture
def most_rows(spark):
    """A function that runs an action and gives its result and the most rows that a step of its plans has made."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def run(action):
        bus.waitUntilEmpty()
        seen = {e.executionId() for e in map(store.executionsList().apply, range(store.executionsList().size()))}
        out = action()
        bus.waitUntilEmpty()
        most, found = 0, store.executionsList()
        for e in map(found.apply, range(found.size())):
            if e.executionId() not in seen:
                values = store.executionMetrics(e.executionId())
                for m in map(e.metrics().apply, range(e.metrics().size())):
                    value = values.get(m.accumulatorId())
                    if m.name() == "number of output rows" and value.isDefined():
                        most = max(most, int(value.get().replace(",", "")))
        return out, most

    return run


def test_equal_names_of_a_title_meet_a_pack_once(spark, most_rows):
    refs = F.array(F.struct(F.lit("jira").alias("source"), F.lit("page").alias("title")))
    packs = spark.range(500).select(F.col("id").alias("pack"), F.lit("Button pattern").alias("title"), F.lit("Ada").alias("owner"), F.lit("small ring rule").alias("rule"), F.lit("high").alias("confidence"), refs.alias("refs"))
    decisions = spark.range(500).select(F.when(F.col("id") % 2 == 0, "small ring of steel").otherwise("plain shiny valve").alias("name"), F.array(F.lit("page")).alias("titles"))
    got, most = most_rows(lambda: conventions(packs, decisions).collect())
    assert len(got) == 500 and {r.constituents for r in got} == {"small ring of steel"}
    assert most <= 2000


def test_equal_texts_of_packs_meet_once(spark, most_rows):
    nodes = spark.range(400).select(F.col("id").alias("node"), F.when(F.col("id") < 200, "project").otherwise("pull_request").alias("type"), F.lit("small ring").alias("name"), F.lit(None).cast("string").alias("said"), F.lit(False).alias("proposed"), F.lit(False).alias("convention"))
    pages = nodes.where("node >= 200").select(F.col("node").alias("page"), F.lit("small ring notes").alias("text"))
    edges = spark.createDataFrame([(0, 250, "USES", 0.5), (201, 0, "USES", None)], "src long, dst long, type string, weight double")
    targets = nodes.where("type = 'project'").select("node", F.col("name").alias("text"))
    got, most = most_rows(lambda: precedents(targets, nodes, edges, pages).collect())
    by_node = {n: [r.precedent for r in sorted((r for r in got if r.node == n), key=lambda r: r.place)] for n in (0, 7)}
    assert by_node == {0: [250, *range(200, 207)], 7: [*range(200, 208)]} and len(got) == 1600
    assert most <= 4000


def test_a_hub_gives_a_target_its_first_conventions_alone(spark, most_rows):
    nodes = spark.range(400).select(F.col("id").alias("node"), (F.col("id") >= 300).alias("convention"), (F.col("id") % 9).alias("refs"))
    applies = spark.range(300, 400).selectExpr("id AS src", "0L AS dst", "'APPLIES_TO' AS type", "0.9D AS weight")
    edges = applies.union(spark.range(1, 200).selectExpr("id AS src", "0L AS dst", "'CONTAINS' AS type", "0.5D AS weight"))
    got, most = most_rows(lambda: conventions_of(nodes.where("node between 1 and 199").select("node"), edges, nodes).collect())
    assert sorted((r.place, r.rule) for r in got if r.node == 5) == [(i + 1, 305 + 9 * i) for i in range(6)] and {r.provenance for r in got} == {"one_hop"}
    assert most <= 4000


def test_nodes_of_one_name_give_a_hypothesis_its_first_ones_alone(spark, most_rows):
    n = spark.range(400).select("id", F.when(F.col("id") < 200, F.concat(F.lit("plan n"), "id")).otherwise("red bolt").alias("name"), F.lit("ticket").alias("type"), (F.col("id") < 200).alias("hypothesis"), F.lit(False).alias("convention"), F.when(F.col("id") < 200, "see red bolt").otherwise("").alias("text"))
    none = spark.createDataFrame([], "id long, name string")
    refs = n.select("id", (F.col("id") % 100).alias("doc"))
    edges = spark.createDataFrame([], "src long, dst long, type string")
    got, most = most_rows(lambda: wire(n, none, none, refs, edges).collect())
    assert sorted(r.dst for r in got if r.src == 50) == [200, 250, 350] and len(got) == 600
    assert most <= 8000


def test_equal_rules_fit_equal_texts_once(spark, most_rows):
    said = spark.range(300).select("id", F.lit("never paint small rings").alias("said"))
    rules = spark.range(300).select(F.col("id").alias("to"), F.lit("rule").alias("name"), F.lit("never paint small rings").alias("text"))
    got, most = most_rows(lambda: fitting_rules(said, rules).collect())
    assert len(got) == 300 and {r.to for r in got} == {0} and most <= 2000


def test_rules_and_texts_of_equal_words_fit_once(spark, most_rows):
    said = spark.range(300).select("id", F.concat(F.lit("never paint small rings "), "id").alias("said"))
    rules = spark.range(300).select(F.col("id").alias("to"), F.concat(F.lit("rule "), 999 - F.col("id")).alias("name"), F.concat("id", F.lit(" rings small paint "), F.col("id") % 7).alias("text"))
    rules = rules.union(spark.createDataFrame([(400, "a", "paint bolts"), (401, "b", "1 2"), (402, None, "paint small rings")], "to long, name string, text string"))
    got, most = most_rows(lambda: fitting_rules(said.union(spark.createDataFrame([(900, ""), (901, "oh my")], said.schema)), rules).collect())
    assert len(got) == 300 and {r.to for r in got} == {402} and most <= 2000


def test_owners_of_a_family_are_gathered_once(spark, most_rows):
    i = F.col("id")
    n = spark.range(340).select("id", F.when(i < 20, F.concat(F.lit("ada "), i)).otherwise(F.concat(F.lit("plan ring "), i)).alias("name"), F.when(i < 20, "team_member").otherwise("ticket").alias("type"), (i >= 20).alias("hypothesis"), F.lit(False).alias("convention"), F.lit("").alias("text"))
    related = n.where("id between 20 and 39").select("id", F.concat(F.lit("ada "), i - 20).alias("name"))
    none = spark.createDataFrame([], "id long, name string")
    edges = spark.createDataFrame([(40, 3, "PROPOSED_BY"), (40, 5, "PROPOSED_BY"), (41, 5, "RELATED_TO"), (20, 0, "PROPOSED_BY")], "src long, dst long, type string")
    got, most = most_rows(lambda: wire(n, related, none, n.select("id", i.alias("doc")), edges).collect())
    family = {(r.src, r.dst) for r in got if r.type == "PROPOSED_BY" and r.weight == 0.55}
    # Node 20 has its listed owner already, so it takes those of its family.
    assert family == {(a, b) for a in [20, *range(40, 340)] for b in range(20)} - {(40, 3), (40, 5), (20, 0)}
    assert len(got) == len(set(got)) and most <= 1.2 * len(got)


def test_titles_try_few_documents_of_a_common_word(spark, most_rows):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("slack").alias("provider"), F.lit("slack_message").alias("type"), F.lit("").alias("title"), F.when(F.col("id") == 390, "plan the red bolts now").otherwise("red bolts").alias("content"), F.lit(None).cast("string").alias("author"))
    cited = spark.range(200).select(F.lit("slack").alias("provider"), F.concat(F.lit("red "), F.when(F.col("id") == 0, "bolts now").otherwise(F.concat(F.lit("bolt"), F.when(F.col("id") % 2 == 0, "s").otherwise("")))).alias("title"))
    cited = cited.union(spark.range(200).selectExpr("'slack'", "concat('red', repeat(' ', cast(id as int)), ' bolt')"))
    got, most = most_rows(lambda: resolve_titles(cited, docs).collect())
    assert {r.doc_id for r in got if "now" not in r.title} == {0} and [r.doc_id for r in got if "now" in r.title] == [390]
    assert len(got) == 202 and most <= 8000


def test_positional_update_reads_its_words_once(spark, tmp_path):
    texts = ["a the b the", "the", "the x", "x the", "none here", "", None, "other Then"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = u06_positional_update(spark, str(tmp_path))
    assert [r.text for r in df.orderBy("doc_id").collect()] == ["a THE b the", "THE", "THE x", "x THE", "none here", "", None, "other Then"]
    assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_rules_of_an_owner_are_consolidated_by_class(spark, most_rows):
    i = F.col("id")
    rules = spark.range(400).select("id", F.lit("Ada").alias("owner"), F.when(i % 2 == 0, "small red ring").otherwise("small red bolt").alias("rule"), F.array(F.concat(F.lit("plan "), i)).alias("decisions"), F.array(F.concat(F.lit("doc "), i % 3)).alias("documents"))
    got, most = most_rows(lambda: consolidated(rules).collect())
    assert {r.id: len(r.merged) for r in got} == {0: 133, 1: 132, 2: 132} and most <= 4000


def test_rules_after_the_first_go_to_leaders_at_once(spark, most_rows, monkeypatch):
    monkeypatch.setattr(clusters, "FIRST", 60, raising=False)
    rng = random.Random(7)
    rows = [(i, "Ada", f"plain {rng.choice(['red', 'old', 'hot', 'big', 'dry'])} {rng.choice(['ring', 'bolt', 'cog', 'pin'])}", [f"d{rng.randrange(40 + i // 4)}" for _ in range(4)]) for i in range(1500)]
    held, merged, count = {}, {}, {}
    for i, _, rule, said in rows:
        alike = [k for d in said for k in held.get(d, ()) if len({*rule.split()} & {*rows[k][2].split()}) >= 2]
        into = min(alike, default=i)
        if into == i:
            merged[i], count[i] = [], set()
        else:
            merged[into].append(i)
        count[into] |= {*said}
        for d in said:
            held.setdefault(d, set()).add(into)
    df = spark.createDataFrame(rows, "id long, owner string, rule string, decisions array<string>").withColumn("documents", F.expr("array()").cast("array<string>"))
    got, most = most_rows(lambda: consolidated(df).collect())
    assert {r.id: (list(r.merged), r.n_decisions) for r in got} == {i: (m, len(count[i])) for i, m in merged.items()}
    assert len(merged) == 14 and most <= 15000


def test_components_write_few_rows_beside_the_edges(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(graph, "written", lambda df, *by: kept.append(written(df, *by)) or kept[-1])
    pairs = spark.range(1600).selectExpr("id % 40 AS src", "100 + id div 40 AS dst", "'' AS type")
    path = [(200 + i, 201 + i) for i in range(30)] + [(300, 300), (None, 7), (400, 402), (402, 401)]
    edges = pairs.union(spark.createDataFrame(path, "src long, dst long").selectExpr("src", "dst", "''"))
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {**dict.fromkeys([*range(40), *range(100, 140)], 0), **dict.fromkeys(range(200, 231), 200), 300: 300, **dict.fromkeys([400, 401, 402], 400)}
    assert sum(df.count() for df in kept) <= 2400


def test_projects_that_share_a_word_and_a_title_are_not_paired(spark, most_rows):
    nodes = spark.range(300).select("id", F.concat(F.lit("Donor w"), F.col("id") + 100).alias("name"), F.lit("project").alias("type"), F.lit(None).cast("array<string>").alias("aliases"), F.array(F.lit("plan")).alias("titles"), F.lit(1).alias("n_refs"), F.lit(True).alias("documented"), F.lit(False).alias("timeline"))
    none = spark.createDataFrame([], "name string, key string, status string")
    got, most = most_rows(lambda: resolved(nodes, none.select("name"), none.select("key", "status")).collect())
    assert len(got) == 300 and all(r.phase is None for r in got)
    assert most <= 3000


def test_lines_are_dealt_to_cards_and_claims_once(spark, sf_dir):
    _, cards, claims, _ = _reviews(spark, sf_dir)
    assert not [f for df in (cards, claims) for f in df.inputFiles() if "lineitem" in f]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS o_orderkey", "l_orderkey * 10 + l_linenumber AS claim")
    want = spark.read.parquet(f"{sf_dir}/orders.parquet").join(lines, "o_orderkey").select("claim", F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("card")).distinct()
    assert sorted(claims.collect()) == sorted(want.select("claim", "entity").collect())
    assert sorted(cards.select("card", F.explode("claims")).collect()) == sorted(want.select("card", "claim").collect())


def test_vectors_go_to_few_units(spark, most_rows):
    turned = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.sin((F.col("id") % 11000 * k * k) % 7919))
    v = spark.range(12000).select("id", F.lit("one").alias("group"), turned.alias("vector"))
    got, most = most_rows(lambda: compare(v, v, at_least(0.999999), everywhere="none").collect())
    assert {(i, i + 11000) for i in range(1, 1000)} <= {(r.a, r.b) for r in got}
    assert most <= 5 * 12000
