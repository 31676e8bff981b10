"""Operators that settle an order in rounds, against the same in sequence; names in texts; the replay of reviews; small extractions."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.clusters import constrained_components, growing_merges
from loomgraph.operators.names import occurrences
from loomgraph.plans import extraction, reviews
from loomgraph.plans.decisions import says


@pytest.mark.parametrize("seed", [1, 2])
def test_constrained_components(spark, seed):
    rng, n = random.Random(seed), 60
    edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(9)) for _ in range(110)]
    marks = [(i, rng.choice("xyz")) for i in range(n) if rng.random() < 0.2] + [(500, "x"), (3, None)]
    root, mark = {i: i for i in range(n)}, {i: m for i, m in marks if m}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for _, a, b in sorted((r, min(a, b), max(a, b)) for a, b, r in edges if a != b):
        p, q = sorted((find(a), find(b)))
        if p != q and not (mark.get(p) and mark.get(q) and mark[p] != mark[q]):
            root[q] = p
            if mark.get(p) or mark.get(q):
                mark[p] = mark.get(p) or mark.get(q)
    got = constrained_components(spark.createDataFrame(edges, "a long, b long, rank int"), spark.createDataFrame(marks, "node long, mark string")).collect()
    assert {r.node: r.component for r in got} == {i: find(i) for a, b, _ in edges if a != b for i in (a, b)}
    assert constrained_components(spark.createDataFrame([], "a long, b long, rank int"), spark.createDataFrame(marks, "node long, mark string")).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_growing_merges(spark, seed):
    rng, n = random.Random(seed), 40
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.15]
    evidence = [(i, f"e{rng.randrange(18)}") for i in range(n) for _ in range(rng.randint(0, 2))] + [(i, None) for i in range(n)]
    own = {i: {e for j, e in evidence if j == i and e} for i in range(n)}
    into = {i: i for i in range(n)}
    for i in range(n):
        for j in range(i + 1, n):
            if into[i] == i and into[j] == j and (i, j) in pairs and own[i] & own[j]:
                own[i] |= own[j]
                into[j] = i
    got = growing_merges(spark.createDataFrame(pairs + [(5, 5), (9, 2)], "a long, b long"), spark.createDataFrame(evidence, "id long, e string")).collect()
    assert {r.id: r.into for r in got} == into and any(k != v for k, v in into.items())


def test_names_in_texts(spark):
    texts = [(1, "ababab 日本 xx"), (2, None), (3, ""), (4, "x"), (4, "x")]
    names = [("ab",), ("bab",), ("日",), ("x",), ("",), (None,), ("x",)]
    df, n = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names, "name string")
    want = [(1, "ab", 0, 3), (1, "bab", 1, 2), (1, "x", 10, 2), (1, "日", 7, 1), (4, "x", 0, 1), (4, "x", 0, 1)]
    for most in (1 << 20, 12):  # one automaton, and several
        assert sorted(tuple(r) for r in occurrences(df, n, most).collect()) == want
    by_text = occurrences(df.selectExpr("concat('t', id) AS id", "text"), n)
    assert {r.id for r in by_text.collect()} == {"t1", "t4"} and occurrences(df, n.limit(0)).count() == 0 and occurrences(df.limit(0), n).count() == 0


def in_sequence(events, cards, claims, nodes, follow):
    cards = {c: {"claims": k, "a": a, "b": b, "status": "open", "text": None, "n": 0} for c, k, a, b in cards}
    claims = {c: {"entity": e, "state": "inferred", "text": None, "n": 0} for c, e in claims}
    refs, names, survivor, alias, refused = {n: r for n, _, r in nodes}, {n: x for n, x, _ in nodes}, {n: n for n, *_ in nodes}, {}, []
    for seq, card, action, text, a, b in sorted(events):
        if action == "create":
            if card in cards:
                refused.append((seq, "exists"))
            else:
                cards[card] = {"claims": None, "a": a, "b": b, "status": "open", "text": None, "n": 0}
            continue
        c = cards.get(card)
        if c is None or action not in reviews.ACTIONS:
            refused.append((seq, "no card" if c is None else "unknown action"))
            continue
        if action == "merge_entities":
            x, y = c["a"], c["b"]
            why = None
            if x is None or y is None:
                why = "no entities"
            elif x not in refs or y not in refs:
                why = "unknown"
            elif not follow and (survivor[x] != x or survivor[y] != y):
                why = "gone"
            elif survivor[x] == survivor[y]:
                why = "same"
            if why:
                refused.append((seq, why))
                continue
            x, y = survivor[x], survivor[y]
            keep, gone = (x, y) if refs[x] >= refs[y] else (y, x)
            refs[keep] += refs[gone]
            for n, s in survivor.items():
                if s == gone:
                    survivor[n] = keep
        if action == "comment":
            c["n"] += 1
            continue
        c["status"] = reviews.STATUS[action]
        if action == "edit":
            c["text"] = text
        if action == "validate" or (action == "edit" and c["claims"] and len(c["claims"]) == 1 and text):
            for k in c["claims"] or []:
                if k in claims:
                    claims[k]["state"], claims[k]["n"] = "human_asserted", claims[k]["n"] + 1
                    if action == "edit":
                        claims[k]["text"] = text
    for n, s in survivor.items():
        if n != s:
            alias.setdefault(s, set()).add(names[n])
    out = [("card", i, c["status"], c["text"], None, c["n"]) for i, c in cards.items()]
    out += [("claim", i, c["state"], c["text"], survivor.get(c["entity"], c["entity"]), c["n"]) for i, c in claims.items()]
    out += [("node", n, "kept" if n == s else "merged", "|".join(sorted(alias[n])) if n in alias else None, None if n == s else s, refs[n] if n == s else 0) for n, s in survivor.items()]
    action = {e[0]: e[2] for e in events}
    return sorted(map(str, out + [("refused", s, why, action[s], None, 0) for s, why in refused]))


@pytest.mark.parametrize("follow", [True, False])
def test_reviews_in_sequence(spark, follow):
    rng = random.Random(7)
    nodes = [(i, f"n{i}", rng.randrange(4)) for i in range(14)]
    pick = lambda: rng.choice([*range(14), None, 99])
    cards = [(i, rng.choice([None, [], [10 + i], [10 + i, 11 + i]]), pick(), pick()) for i in range(25)]
    claims = [(10 + i, pick()) for i in range(30)]
    events = [(s, rng.choice([*range(25), 70, 80 + s // 40, None]), rng.choice([*reviews.ACTIONS, "merge_entities", "merge_entities", "promote"]), rng.choice([None, "", f"t{s}"]), pick(), pick()) for s in range(160)]
    tables = [spark.createDataFrame(*x) for x in ((events, "seq long, card long, action string, text string, a long, b long"), (cards, "card long, claims array<long>, a long, b long"), (claims, "claim long, entity long"), (nodes, "node long, name string, refs long"))]
    got = sorted(str(tuple(r)) for r in reviews.replayed(*tables, follow=follow).collect())
    want = in_sequence([e for e in events if e[1] is not None], cards, claims, nodes, follow)
    lost = [f"('refused', {e[0]}, " for e in events if e[1] is None]
    assert [g for g in got if not g.startswith(tuple(lost))] == want and ("gone" in str(want)) != follow


def test_seeds_by_hand(spark):
    unit = "array<struct<unit: string, title: string, kind: string, text: string, author: string>>"
    schema = f"doc long, provider string, title string, key string, number long, repo string, person string, subject string, status string, units {unit}"
    long = "We decided to use one table layout instead of cards.\nIt holds for every page from now on."
    rows = [
        (1, "jira", "PAY-3: Build the orders page", "PAY-3", None, None, "Ada", None, "Done", None),
        (2, "jira", "PAY-4: Fix the orders page", "PAY-4", None, None, None, None, None, []),
        (3, "jira", "no key", None, None, None, None, None, None, None),
        (4, "github", "Web PR #7: Standardize gateway api response format", None, 7, "acme/pets-api", "Bo", None, "open", [("u", None, "review_comment", long, "Cy [bot]")]),
        (5, "customerFeedback", "More filters", None, None, None, "Di", None, None, None),
        (6, "confluence", "Site", None, None, None, None, None, None, [("p", "Phase 2 — Standardise donor search", "section", "Status: in progress. " + "x" * 40, None), ("q", "Future Considerations", None, "short", None), ("r", "Future considerations", None, "y" * 40, None)]),
        (None, "slack", None, None, None, None, None, None, None, [("s", None, None, None, None), ("t", "Weekly sync", None, "Instead of that. " + "z" * 60, None)]),
    ]
    got = {(r.doc, r.unit, r.kind, r.label, r.type, r.confidence, r.candidate) for r in extraction.seeds(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        (1, None, "candidate_entity", "PAY-3", "ticket", "high", True),
        (1, None, "work_item_signal", "The Orders Page", "project", "medium", True),
        (2, None, "candidate_entity", "PAY-4", "ticket", "high", True),
        (4, "u", "candidate_entity", "pets-api", "repository", "high", True),
        (4, "u", "candidate_entity", "Web PR #7: Standardize gateway api response format", "pull_request", "high", True),
        (4, "u", "work_item_signal", "API Response Standardization", "project", "medium", True),
        (4, "u", "pattern_signal", "We decided to use one table layout instead", "decision", "high", False),
        (4, "u", "decision_signal", "We decided to use one table layout instead", "decision", "high", True),
        (5, None, "candidate_entity", "More filters", "customer_feedback", "high", True),
        (5, None, "feedback_signal", "More filters", "customer_feedback", "high", False),
        (6, "p", "work_item_signal", "Donor Search Standardization", "project", "high", True),
        (6, "r", "work_item_signal", "Site — Future Considerations", "project", "high", True),
        (None, "t", "process_signal", "Weekly sync", "process", "medium", True),
    }


def test_promotions_by_hand(spark):
    rows = [
        (1, "feedback_signal", "project", "slack", "high", "Search page", None, None, "feedback"),
        (2, "work_item_signal", "project", "confluence", "high", "Phase 2", None, None, "umbrella"),
        (3, "work_item_signal", "project", "slack", "high", "Search card", None, None, "fragment"),
        (4, "work_item_signal", "project", "jira", "high", "Small improvements", None, None, "generic"),
        (5, "work_item_signal", "project", "jira", "high", "Search page", None, "a bug", "task"),
        (6, "work_item_signal", "project", "slack", "high", "Search page", None, None, "review"),
        (7, "work_item_signal", "project", "jira", "low", "Search page", None, None, "shaped_though_unsure"),
        (8, "work_item_signal", "project", "jira", "low", "Donors", None, None, "unsure"),
        (9, "work_item_signal", "project", "jira", "high", "Donors", None, None, "shapeless"),
        (10, "candidate_entity", "decision", "jira", "low", "Office", None, "we prefer it", "decision"),
        (11, "candidate_entity", "decision", "jira", "low", "Office", None, None, "weak_decision"),
        (12, "candidate_entity", "process", "jira", "low", "Office", None, "every 30 days", "process"),
        (13, "candidate_entity", "process", "jira", "low", "Office", None, None, "not_process"),
        (14, "work_item_signal", "repository", "jira", "low", "x", None, None, "weak_work"),
        (15, None, None, None, None, None, None, None, "shaped"),
        (16, "work_item_signal", "project", "confluence", "high", "Search page", None, None, "shaped"),
        (17, "pattern_signal", "decision", "slack", "high", "we always", None, None, "rule"),
    ]
    df = spark.createDataFrame(rows, "id long, kind string, type string, source string, confidence string, label string, reasoning string, excerpt string, want string")
    got = extraction.promotions(df).collect()
    assert [(r.id, r.why) for r in got if r.why != r.want] == []
    assert {r.why for r in got if r.promote} == {"shaped_though_unsure", "decision", "process", "shaped"}


def test_excerpts_stop_at_the_first_snippet_that_passes(spark):
    df = spark.createDataFrame([("We decided on it today.\nboom boom boom boom boom",), ("nothing of note was said",)], "text string")
    test = lambda s: F.when(s.contains("boom"), F.raise_error(F.lit("tested")).cast("boolean")).otherwise(s.contains("decided"))
    assert [r.e for r in df.select(extraction.excerpt(F.col("text"), test).alias("e")).collect()] == ["We decided on it today.", "nothing of note was said"]


def test_spoken_finds_what_says_finds(spark):
    rng = random.Random(9)
    lists = [extraction.TASKS, extraction.DECISION, extraction.PROCESS, extraction.CONTEXT, extraction.PATTERN_WORDS, extraction.UMBRELLA]
    words = [w for x in lists for w in x.split("|")] + ["1:1", "every 30", "phase 2", "standardized", "_", "é", "\n", "日", "x"]
    texts = [("".join(rng.choice(words) + rng.choice(["", " ", "\n", "_", "-", "s"]) for _ in range(rng.randint(0, 3))),) for _ in range(400)]
    df = spark.createDataFrame(texts, "t string").select(*[(F.col("t").rlike(says(x)) == F.col("t").rlike(extraction.spoken(x))).alias(f"c{i}") for i, x in enumerate(lists)])
    assert {v for r in df.collect() for v in r} == {True}
