"""Attributes, conventions and metrics on small tables with nulls and odd values."""

import json

from loomgraph.operators.survivorship import survivors
from loomgraph.plans.completion import completed, conventions
from loomgraph.plans.judge import measured

REFS = "node long, source string, title string, excerpt string, content string, ticket_status string, change_state string, pr_author string, source_author string, assignee string, author string"
NODES = "node long, type string, name string, description string, draft string, documentation_level string, status string, decided_by string"


def ref(n, source, title=None, excerpt=None, content=None, ticket=None, change=None, pr=None, by=None, assignee=None, author=None):
    return (n, source, title, excerpt, content, ticket, change, pr, by, assignee, author)


def test_survivors(spark):
    claims = [(1, "a", "x", "v", 1), (1, "a", "x", "w", 2), (1, "a", "y", "v", 1), (1, "a", "z", "u", 9), (1, "a", "nobody", "t", 99), (2, "a", "z", "", 1), (2, "a", "z", None, 1), (3, "a", "z", "q", 1), (3, "a", "z", "p", 1)]
    got = survivors(spark.createDataFrame(claims, "node long, attribute string, provider string, value string, weight long"), [("a", "x", 1), ("a", "y", 1), ("a", "z", 2)]).collect()
    assert {r.node: (r.value, r.provider, r.votes) for r in got} == {1: ("v", "x", 2), 3: ("p", "z", 1)}


def test_completion(spark):
    nodes = [
        (1, "project", "Portal", None, "a draft", "documented", "completed", None), (2, "project", "Search", "given", "draft", "odd", "someday", None), (3, "process", "Deploy", "", None, None, "informal", None),
        (4, "decision", "Fonts", None, None, None, "active", None), (5, "decision", "Colours", None, None, None, None, "Bo"), (6, "project", "Future considerations", None, None, None, None, None), (7, None, None, None, None, None, None, None), (None, "project", "x", None, None, None, None, None),
        (8, "project", "Old", None, None, None, "active", None),
    ]
    refs = [
        ref(1, "confluence", "Plan", "It is In-Progress, launched soon"), ref(1, "jira", ticket="Done"),
        ref(2, "jira", ticket="DONE"), ref(2, "jira", ticket="in review"), ref(2, "github", change="open"),
        ref(3, "confluence", "Guide", "launched"), ref(3, "github", change="merged"),
        ref(4, "github", pr="Ada [web]"), ref(4, "jira", assignee="Bo", author="Bo "), ref(4, "slack", by="  "), ref(5, "github", pr="Ada"),
        ref(6, "confluence", "Page", "words", "low priority for now"), ref(8, "github", change="merged"), ref(8, "github", change=""), ref(8, "github", change="Closed"),
        ref(99, "jira", ticket="Done"), ref(None, "jira"),
    ]
    got = {(r.node, r.attribute): (r.value, r.provider, r.action) for r in completed(spark.createDataFrame(nodes, NODES), spark.createDataFrame(refs, REFS)).collect()}
    assert got == {
        (1, "description"): ("a draft", "draft", "filled"), (1, "documentation_level"): ("documented", "given", "confirmed"), (1, "status"): ("active", "confluence", "corrected"),
        (2, "description"): ("given", "given", "confirmed"), (2, "documentation_level"): ("undocumented", "sources", "filled"), (2, "status"): ("active", "jira", "filled"),
        (3, "description"): (None, None, "ask"), (3, "documentation_level"): ("documented", "sources", "filled"), (3, "status"): ("informal", "given", "confirmed"),
        (4, "description"): (None, None, "ask"), (4, "documentation_level"): ("undocumented", "sources", "filled"), (4, "decided_by"): ("Ada", "references", "filled"),
        (5, "description"): (None, None, "ask"), (5, "documentation_level"): ("undocumented", "sources", "filled"), (5, "decided_by"): ("Bo", "given", "confirmed"),
        (6, "description"): (None, None, "ask"), (6, "documentation_level"): ("documented", "sources", "filled"), (6, "status"): ("proposed", "confluence", "filled"),
        (7, "description"): (None, None, "ask"), (7, "documentation_level"): ("undocumented", "sources", "filled"),
        (8, "description"): (None, None, "ask"), (8, "documentation_level"): ("undocumented", "sources", "filled"), (8, "status"): ("completed", "github", "corrected"),
    }
    empty = completed(spark.createDataFrame([], NODES), spark.createDataFrame([], REFS))
    assert empty.count() == 0


def test_conventions(spark):
    packs = [
        (1, "Button convention", " Ada ", "buttons stay orange", "high", [("confluence", "P"), ("slack", "Q"), ("slack", None)]), (2, "Grid pattern", "Bo", None, "high", [("confluence", "P")]), (3, "Notes", "Bo", "r", "high", None),
        (4, "Layout Pattern", "unknown", "r", "high", []), (5, "Layout pattern", None, "r", "high", [("jira", "P")]), (6, "Layout pattern", "Bo", "r", "low", [("github", "Q")]), (None, "x", "y", "z", "high", []),
    ]
    decisions = [("Orange buttons everywhere", ["P"]), ("Short name", ["P", "P"]), ("Blue buttons on every single page", ["Q"]), (None, ["P"]), ("Other", None)]
    got = {r.pack: (r.owner, r.level, r.constituents, r.sources, r.verdict) for r in conventions(spark.createDataFrame(packs, "pack long, title string, owner string, rule string, confidence string, refs array<struct<source: string, title: string>>"), spark.createDataFrame(decisions, "name string, titles array<string>")).collect()}
    assert got == {
        1: ("Ada", "partially_documented", "Orange buttons everywhere|Short name", 3, "created"), 2: ("Bo", "documented", "Short name", 1, "created"), 3: ("Bo", "undocumented", "", 0, "rejected"),
        4: ("unknown", "undocumented", "", 0, "rejected"), 5: ("", "undocumented", "Short name", 1, "rejected"), 6: ("Bo", "undocumented", "", 1, "rejected"),
    }


def test_metrics(spark):
    one = {"total_chunks": "12", "pattern_candidates": [1, 2], "by_provider": {"a": 1, "b": 2}, "phase3_conventions": [{"constituent_decisions": ["x"]}, {"documentation_level": "d"}], "evidence_pack_samples": [{"fallback_ratio_pct": 10}, {"fallback_ratio_pct": "21", "convention_source_count": 4}], "category_diversity": 5, "by_category": {"z": 1}, "convention_node_count": 1, "human_page_categories": ["hidden_conventions"], "total_packs": 2, "expected_total_packs": 2}
    rows = [(1, json.dumps(one)), (2, "no json"), (3, None), (4, "[1]"), (None, "{}")]
    got = {}
    for r in measured(spark.createDataFrame(rows, "step long, artifact string")).collect():
        got.setdefault(r.step, {})[r.key] = r.actual
    a = got[1]
    assert set(got) == {1, 2, 3, 4} and got[2] == got[3] == got[4]
    assert [a[k] for k in ("total_chunks_positive", "pattern_candidates_positive", "provider_diversity", "min_decisions_per_convention", "documentation_level_set", "evidence_pack_fallback_ratio_low", "evidence_pack_convention_source_count", "category_diversity", "hidden_conventions_page_present_when_needed", "retrieval_pack_count_matches_plan")] == [12, 2, 2, 0, 0, 16, 4, 5, 1, 1]
    none = got[2]
    assert none["documentation_level_set"] is None and none["retrieval_pack_count_matches_plan"] is None and none["valid_status_pct"] == 100 and none["min_decisions_per_convention"] == 0 and none["hidden_conventions_page_present_when_needed"] == 1 and none["company_overview_page_present"] == 0
