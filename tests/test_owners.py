"""Owners and nested search on small tables with odd values."""

from loomgraph.plans.owners import MEMBERS, nested_search, ownership


def test_ownership(spark):
    nodes = [(1, "project", "Portal", {"owner": "Ada and bo [web]", "decided_by": "ADA; Cy", "owner_name": "TBD"}), (2, "ticket", "T", None), (3, "team_member", "Di", {}), (4, "team_member", None, {"assignee": "Lead: Ed/none"}), (5, "decision", "D", {"owner": ""})]
    ref = lambda n, at, source, **said: (n, at, source, *[said.get(m) for m in MEMBERS])
    refs = [ref(1, 2, "jira", author="Fay"), ref(1, 1, "github", pr_author="Gus", assignee="cy"), ref(2, 1, "customer_feedback", author="Hal"), ref(2, 5, None, slack_speaker="Ida, ida"), ref(9, 1, "jira", author="x"), ref(None, 1, "jira", author="x")]
    edges = [(7, 2, 3, "OWNED_BY"), (1, 3, 5, "LEADS"), (2, 5, 1, "OWNED_BY"), (3, 5, 4, "BUILT_BY"), (4, 3, 2, "OWNED_BY"), (5, 77, 3, "OWNED_BY"), (6, None, 3, "OWNED_BY"), (8, 2, 3, "USES")]
    got = ownership(
        spark.createDataFrame(nodes, "node long, type string, name string, attributes map<string, string>"),
        spark.createDataFrame(refs, "node long, at long, source string, " + ", ".join(f"{m} string" for m in MEMBERS)),
        spark.createDataFrame(edges, "edge long, src long, dst long, type string"),
    ).collect()
    assert {r.node: (r.owners, r.primary) for r in got} == {1: ("Ada|bo|Cy|Gus|Fay", "Ada"), 2: ("Ida|Di", "Ida"), 4: ("Ed", "Ed"), 5: ("Di", "Di")}


def test_nested_search(spark):
    rows = [(1, "a", "Red ring", None, None), (2, "a", None, ["x", None, "RED"], None), (3, "b", "x", [], [(None, None), ("t", "so red")]), (4, "a", "x", None, [("Blue", None)]), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, type string, name string, aliases array<string>, refs array<struct<title: string, excerpt: string>>")
    got = {r.id: r.found for r in nested_search(df, ["red", "blue", "r.n"]).collect()}
    assert got == {1: "red;r.n", 2: "red", 3: "red", 4: "blue"}
    assert {r.id for r in nested_search(df, ["red"], ["a"]).collect()} == {1, 2} and nested_search(df, []).count() == 0
