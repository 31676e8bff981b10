"""Resolution of nodes and consolidation of rules on small tables with conflicts."""

import random

import pytest

from loomgraph.plans.resolution import consolidated, identities, likely_pairs, resolved, v04_consolidation

NODES = "id long, name string, type string, aliases array<string>, titles array<string>, n_refs int, documented boolean, timeline boolean"


def node(i, name, kind, aliases=None, titles=None, refs=1, documented=False, timeline=False):
    return (i, name, kind, aliases, titles, refs, documented, timeline)


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        # Persons: a hint's full name, its first word, a dotted name, one of the same name that nothing tells about.
        node(1, "ada.lovelace", "team_member"), node(2, "Ada Lovelace", "team_member"), node(3, "ada", "team_member"), node(4, "bo", "team_member"), node(5, "Grace H", "team_member"),
        # Tickets by keys: 11 and 12 share PAY-1, 12 and 13 PAY-2; 12 has most references and takes both; 14 has a key of its own.
        node(11, "PAY-1: orders", "ticket", refs=1), node(12, "PAY-1: the orders", "ticket", ["PAY-2"], refs=5), node(13, "PAY-2", "ticket", refs=2), node(14, "PAY-9", "ticket"),
        # Projects: 21 is a phase of 22; 23 and 24 have equal aliases but different keys, so they never meet, though 25 is like both.
        node(21, "Donor portal phase 2", "project", refs=1), node(22, "Donor portal", "project", refs=3, documented=True),
        node(23, "Pet matching", "project", ["matcher"], ["PAY-1 plan"], 2), node(24, "Matching of pets", "project", ["Matcher"], ["PAY-9 plan"], 4), node(25, "matcher", "project", None, None, 1),
        # Types by label; a null name, a repeated row.
        node(31, "Chosen fonts", "process"), node(32, "Deploy runbook", "decision"), node(33, None, None), node(33, None, None), node(34, "Tracking page PAY-9", "decision", timeline=True, refs=2),
        node(41, "cache prod", "cloud_resource", refs=2), node(42, "Cache-dev", "cloud_resource", refs=3), node(43, "cache", "cloud_resource"),
    ]
    return spark.createDataFrame(rows, NODES)


def test_resolution(spark, small):
    hints = spark.createDataFrame([("Ada Lovelace",), ("Bo Derek",)], "name string")
    tickets = spark.createDataFrame([("PAY-1", "Done"), ("PAY-9", "In Progress"), (None, "Done")], "key string, status string")
    got = {r.id: (r.into, r.phase) for r in resolved(small, hints, tickets).collect()}
    moved = {i: m for i, m in got.items() if m[1]}
    assert moved == {1: (2, "person"), 3: (2, "person"), 11: (12, "identity"), 13: (12, "identity"), 21: (22, "project"), 25: (23, "cluster"), 41: (42, "cluster"), 43: (42, "cluster")}
    kept = {r.id: r for r in resolved(small, hints, tickets).collect() if r.phase is None}
    assert set(kept) == {2, 4, 5, 12, 14, 22, 23, 24, 31, 32, 33, 34, 42}
    assert kept[4].aliases == "bo" and kept[2].aliases == "ada|ada.lovelace" and kept[12].aliases == "PAY-1: orders|PAY-2"
    assert {i: kept[i].type for i in (31, 32, 33, 34)} == {31: "decision", 32: "process", 33: "", 34: "project"}
    assert {i: kept[i].status for i in (23, 24, 34)} == {23: "completed", 24: "active", 34: "active"}
    assert resolved(small.limit(0), hints, tickets).count() == 0 and resolved(small, hints.limit(0), tickets.limit(0)).count() == 21


def test_identities_in_the_order_of_keys(spark):
    rng = random.Random(5)
    rows = sorted({(i, "ticket", rng.randrange(4), f"K-{rng.randrange(12)}") for i in range(30) for _ in range(rng.choice([1, 1, 2]))})
    refs = {}
    rows = [(i, t, refs.setdefault(i, r), k) for i, t, r, k in rows]
    groups = {}
    for i, _, _, k in rows:
        groups.setdefault(k, set()).add(i)
    gone = {}
    for _, k in sorted((min(g), k) for k, g in groups.items()):
        live = [i for i in groups[k] if i not in gone]
        if len(live) > 1:
            keep = min(live, key=lambda i: (-refs[i], i))
            gone |= {i: keep for i in live if i != keep}
    got = identities(spark.createDataFrame(rows, "id long, type string, n_refs int, key string")).collect()
    assert {r.id: r.into for r in got} == gone and len(got) == len(gone)


def test_pairs_of_projects(spark):
    rows = [node(1, "Donor search", "project", None, ["Plan"]), node(2, "Search of donors", "project", None, ["plan!"]), node(3, "Donor search redesign", "project"), node(4, "Donor search cards", "project"), node(5, "Volunteer hours", "project")]
    keys = spark.createDataFrame([], "id long, type string, n_refs int, key string")
    got = {(r.a, r.b): (r.score, r.why) for r in likely_pairs(spark.createDataFrame(rows, NODES), keys).collect()}
    assert got == {(1, 2): (0.96, "family"), (1, 3): (0.8, "held"), (1, 4): (0.82, "family"), (2, 4): (0.82, "family"), (3, 4): (None, "scope")}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sure_pairs_are_those_of_all(spark, seed):
    rng = random.Random(seed)
    some = lambda words, n: [rng.choice(words) for _ in range(n)]
    words = ["donor", "search", "portal", "pets", "pet", "phase", "refresh", "map", "grid", "one", "two", "ten"]
    rows = [node(i, " ".join(some(words, rng.choice([1, 2, 3, 4, 12]))) if i % 17 else None, rng.choice(["project", "project", "process", "cloud_resource", "ticket"]), [" ".join(some(words, 2))] if i % 4 == 0 else None, some(["Plan", "Notes", "Q1", "q1", None], rng.choice([0, 1, 2]))) for i in range(60)]
    nodes = spark.createDataFrame(rows, NODES).cache()
    keys = spark.createDataFrame([(r[0], r[2], 1, f"K-{rng.randrange(6)}") for r in rows if rng.random() < 0.3], "id long, type string, n_refs int, key string")
    every = {(r.a, r.b): (r.score, r.why) for r in likely_pairs(nodes, keys).collect()}
    assert {w for _, w in every.values()} >= {"scope", "family", "words", "held", "key"}
    for least in (0.75, 0.82, 0.9):
        got = {(r.a, r.b): (r.score, r.why) for r in likely_pairs(nodes, keys, least).collect()}
        assert got == {p: m for p, m in every.items() if m[1] != "scope" and m[0] >= least}


@pytest.mark.parametrize("seed", [1, 2])
def test_consolidation_in_sequence(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["use", "one", "table", "cards", "grid", "lazy"])
    rows = [(i, rng.choice(["Ada", " ada ", "Bo", None]), " ".join(word() for _ in range(3)), rng.sample(["A", "b", "c", "d ", "D", "e", "f"], rng.randint(0, 2)) or None, rng.sample(["x", "y", "X", "z", "w", "v"], rng.randint(0, 1))) for i in range(50)]
    low = lambda c: (c or "").strip().lower()
    left = {i: [low(o), set(r.split()), {f"d{low(d)}" for d in ds or []} | {f"s{low(d)}" for d in ss}, [], set(ds or []), set(ss)] for i, o, r, ds, ss in rows}
    for i in list(left):
        for j in list(left):
            if i in left and j in left and i < j and left[i][0] == left[j][0] and len(left[i][1] & left[j][1]) / max(len(left[i][1]), len(left[j][1])) >= 0.4 and left[i][2] & left[j][2]:
                gone = left.pop(j)
                left[i][2] |= gone[2]
                left[i][3].append(j)
                left[i][4] |= gone[4]
                left[i][5] |= gone[5]
    df = spark.createDataFrame(rows, "id long, owner string, rule string, decisions array<string>, documents array<string>")
    got = {r.id: (list(r.merged), r.n_decisions, r.n_documents) for r in consolidated(df).collect()}
    assert got == {i: (v[3], len(v[4]), len(v[5])) for i, v in left.items()} and any(v[3] for v in left.values())


def test_consolidation_reads_lines_of_any_quantity(spark, tmp_path):
    parts = [(1, "Brand#1", "old ring", "LARGE", 1), (2, "Brand#1", "old ring", "LARGE", 2), (3, "Brand#1", "old ring", "LARGE", 3)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, 7, 1.0), (1, 8, 50.0), (2, 8, 3.0), (3, 9, 2.0)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted((r.id, r.merged, r.n_decisions) for r in v04_consolidation(spark, str(tmp_path)).collect()) == [(1, "2", 2), (3, "", 1)]
