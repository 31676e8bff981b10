"""Small cases of candidate decisions, cited titles, discoveries, wiring and HTML with marks."""

from pyspark.sql import functions as F

from loomgraph.functions import text as x
from loomgraph.plans import decisions, wiring

REFS = "array<struct<source: string, title: string, excerpt: string>>"
NODE = f"node long, type string, name string, kind string, family string, confidence string, origin string, repository string, reasoning string, refs {REFS}"


def found(df):
    return {tuple(r) for r in df.collect()}


def test_candidates_that_stay_or_go(spark):
    ref = lambda *kinds: [(k, None, None) for k in kinds]
    rows = [
        (1, "decision", "x", None, None, "low", None, None, "we decided", ref("slack")),
        (2, "team_member", "Message author 2", None, None, "high", None, None, None, None),
        (3, "project", "Great runbook", None, None, "high", None, None, None, ref("jira", "slack")),
        (4, "project", "Orders thing", None, None, "low", None, None, None, ref("jira")),
        (5, "project", "Great idea", None, None, "low", None, None, None, ref("slack")),
        (6, "project", "Grand rollout", None, None, "high", None, None, "a priority", ref("confluence", "jira")),
        (7, "project", "Thing", None, None, "high", None, None, None, ref("slack", "slack")),
        (8, "repository", "Main screen", None, None, "high", None, None, None, ref("slack")),
        (9, "repository", "Main screen", None, None, "high", None, "r", None, ref("slack")),
        (10, "ticket", None, None, None, "low", "deterministic-jira", None, None, ref("jira")),
        (11, "ticket", None, None, None, "low", None, None, None, ref("jira")),
        (12, None, None, None, None, None, None, None, None, None),
        (13, "project", "preéfix", None, None, "high", None, None, "café-fixé", ref("slack", "jira")),
    ]
    got = {r.node: (r.action, r.type, r.reason, r.needs_support) for r in decisions.validated(spark.createDataFrame(rows, NODE)).collect()}
    assert got == {
        1: ("keep", "decision", "protected", False),
        2: ("reject", "team_member", "placeholder", False),
        3: ("retype", "process", "process_work", False),
        4: ("keep", "project", "feature", True),
        5: ("reject", "project", "thin", False),
        6: ("keep", "project", "passed", False),
        7: ("retype", "ticket", "review", False),
        8: ("reject", "repository", "screen", False),
        9: ("keep", "repository", "passed", False),
        10: ("keep", "ticket", "passed", False),
        11: ("reject", "ticket", "weak", False),
        12: ("keep", None, "passed", False),
        13: ("retype", "ticket", "ticket_work", False),
    }
    assert not decisions.validated(spark.createDataFrame([], NODE)).count()


def test_titles_by_words_in_order_and_preferred_types(spark):
    docs = spark.createDataFrame(
        [
            (1, "slack", "slack_file", "about the big plan (v2)", None, None),
            (2, "slack", "slack_message", None, "the PLAN is big\nand done", None),
            (3, "slack", "slack_message", None, "Big, then\nplan", "x big plan y"),
            (4, "jira", "jira_comment", "plan (v2)", None, None),
            (5, "jira", "jira_issue", None, "plan (v2)", None),
            (6, "slack", "slack_user", "only here", None, None),
            (7, "slack", "other", None, None, "only author"),
            (8, "github", None, "qa", None, None),
        ],
        "doc_id long, provider string, type string, title string, content string, author string",
    )
    cited = [("slack", "big plan"), ("slack", "big of plan"), ("jira", "Plan (v2)"), ("slack", "only here"), ("slack", "only author"), ("github", "QA"), ("slack", "gone"), (None, "plan"), ("jira", None), ("jira", "")]
    got = found(decisions.resolve_titles(spark.createDataFrame(cited, "provider string, title string"), docs))
    assert got == {("slack", "big plan", 3), ("slack", "big of plan", 3), ("jira", "Plan (v2)", 5), ("github", "QA", 8)}
    assert not decisions.resolve_titles(spark.createDataFrame([], "provider string, title string"), docs).count()
    assert not decisions.resolve_titles(spark.createDataFrame(cited, "provider string, title string"), docs.limit(0)).count()


def test_discoveries_give_the_first_reason(spark):
    seen = [
        (1, "Shop portal", "project", "slack", 1, None),
        (2, "shop-portal", "project", "slack", 2, None),
        (3, "Old thing", "project", "github", 1, None),
        (4, "Tidy up", "ticket", "jira", 1, "cleanup"),
        (5, "Big green window", "project", "jira", 1, None),
        (6, "Lone ticket", "ticket", "jira", None, None),
        (7, "Lone idea", "project", "slack", 1, None),
        (8, None, "project", "slack", 1, None),
        (9, "Choice", "decision", "slack", 1, None),
        (10, "Paper letters", "project", "jira", 1, None),
        (11, "Garden fence paint", "project", "github", 1, None),
    ]
    rows = spark.createDataFrame(seen, "seq long, label string, type string, source string, doc long, said string")
    names = lambda r: spark.createDataFrame(r, "name string, type string")
    docs = spark.createDataFrame(
        [(1, "confluence", None, "my paper-letters here"), (2, "confluence", "Roadmap", "lone idea"), (3, "slack", None, "shop portal"), (4, "confluence", "x", "no formal project doc: shop portal"), (5, "confluence", "paint", "a fence in the garden"), (6, None, None, None)],
        "id long, provider string, title string, content string",
    )
    got = {(r.label, r.type, r.n_docs, r.reason) for r in decisions.discoveries(rows, names([("old thing", "project"), ("green window", "project"), (None, "ticket")]), names([]), docs).collect()}
    assert got == {
        ("Shop portal", "project", 2, None),
        ("Old thing", "project", 1, "already_canonical"),
        ("Tidy up", "ticket", 1, "task_noise"),
        ("Big green window", "project", 1, "same_family"),
        ("Lone ticket", "ticket", 0, "single_ticket"),
        ("Lone idea", "project", 1, "weak_shape"),
        ("Paper letters", "project", 1, "documented"),
        ("Garden fence paint", "project", 1, "documented"),
    }
    assert not decisions.discoveries(rows.limit(0), names([]), names([]), docs).count()


def test_wiring_tiers(spark):
    nodes = [
        (1, "Ann", "team_member", False, None, None),
        (2, "Shop page", "project", None, False, None),
        (3, "Ship orders", "project", True, None, None),
        (4, "Orders again", "project", True, None, None),
        (5, "Mail", "project", True, None, "as the shop page says"),
        (6, "Never", "decision", False, True, "mail with stamps and orders again"),
        (7, None, "project", True, None, None),
    ]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    n = df(nodes, "id long, name string, type string, hypothesis boolean, convention boolean, text string")
    related = df([(3, "ann"), (3, "shop PAGE"), (3, "Ship orders"), (2, "Ann"), (4, "nobody"), (4, None)], "id long, name string")
    edges = df([(6, 2, "APPLIES_TO")], "src long, dst long, type string")
    got = found(wiring.wire(n, related, df([(5, "Ann")], "id long, name string"), df([(4, 9)], "id long, doc long"), edges))
    assert got == {
        (3, 1, "PROPOSED_BY", 0.9),
        (3, 2, "RELATED_TO", 0.8),
        (4, 1, "PROPOSED_BY", 0.55),
        (4, 3, "RELATED_TO", 0.5),
        (5, 1, "PROPOSED_BY", 0.75),
        (5, 1, "RELATED_TO", 0.6),
        (5, 2, "RELATED_TO", 0.6),
        (6, 3, "APPLIES_TO", 0.7),
        (6, 5, "APPLIES_TO", 0.7),
    }
    assert not wiring.wire(n.limit(0), related, related, df([], "id long, doc long"), edges).count()


def test_html_with_marks(spark):
    html = (
        "<h2 id='a'>Top &amp;lt;</h2><script>no</script><!-- no --><p>one <b>two</b><br/>three</p>"
        "<table><tr><th>a</th><th>b</th></tr><tr><td> c </td></tr></table><ol><li>x</li><li><i>y</i></li></ol><ul></ul>"
        "<ac:structured-macro ac:name='code'><ac:plain-text-body><![CDATA[ z = 1 ]]></ac:plain-text-body></ac:structured-macro><ac:image/><table></table>"
    )
    rows = spark.createDataFrame([(html,), ("",), (None,), ("<p>open",)], "h string").select(x.html_markdown(F.col("h"))).collect()
    assert [r[0] for r in rows] == ["## Top <\n\none **two**\nthree\n\n| a | b |\n| --- | --- |\n| c |  |\n\n1. x\n2. y\n\n```\nz = 1\n```", "", None, "open"]
