"""Layout functions, block readers and leader clustering against plain Python and literal fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import layout as y
from loomgraph.functions import text as x
from loomgraph.operators.leaders import leaders
from loomgraph.sources import blocks

BAR, DASH = "=" * 80, "-" * 80


def texts(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, text string")


def apply(spark, f, *rows):
    return [r[0] for r in texts(spark, *rows).orderBy("id").select(f(F.col("text"))).collect()]


def test_titles(spark):
    got = apply(spark, lambda c: y.clean_title(c, "project"), "**Project:** [Login page](http://x) ", "ABC-12: fix api for jira", "login login page.", "", None, "a. b c: " + "w " * 20)
    assert got == ["Login page", "Fix API For Jira", "Login Page", "", None, "B C"]
    assert apply(spark, lambda c: y.clean_title(c, "decision"), "We decided to use Kafka") == ["use Kafka"]


def test_labels_owners_terms(spark):
    assert apply(spark, y.project_label, "Build set up search", "Improve checkout feature", None) == ["Search Setup", "Checkout Feature Improvements", None]
    assert apply(spark, y.owners, "Owner: Ann [lead], ann; Bob and unknown / TBD", "", None) == [["Ann", "Bob"], [], None]
    assert apply(spark, y.search_terms, "Who owns the API-gateway?", "") == [["who", "owns", "the", "api-gateway"], []]


def test_answers(spark):
    got = apply(spark, y.answer_layout, "Hi \U0001f600 there. - one\n* two", "a ## b", None)
    assert got == ["Hi there.\n\n- one\n- two", "a\n\n## b", None]


def test_json_salvage(spark):
    got = apply(spark, y.salvage_json, '```json\n{"a": 1}\n```', 'so: [1, {"b": "}"}] and } more', "x {bad} then [2]", "none", "{NaN}", None)
    assert got == ['{"a":1}', '[1,{"b":"}"}]', "[2]", None, None, None]


def test_sections(spark):
    s = y.sections(texts(spark, "pre\n# A\none\n## B\n\n# C", "", None, "plain"), "id", "text").collect()
    assert sorted((r.id, r.heading, r.start, r.stop, r.content) for r in s) == [(0, "(intro)", 0, 4, "pre"), (0, "A", 4, 12, "# A\none"), (0, "B", 12, 18, "## B"), (0, "C", 18, 21, "# C"), (3, "(intro)", 0, 5, "plain")]


def test_html_paragraphs(spark):
    page = '<p>Opening paragraph</p><h2>Head <b>x</b></h2><p>short</p><li>long enough <a href="http://jira/1">l</a></li>'
    p = y.html_paragraphs(texts(spark, page, "", None), "id", "text").collect()
    assert [(r.section, r.heading, r.paragraph, r.text, r.links) for r in p] == [(0, "Overview", 0, "Opening paragraph", []), (1, "Head x", 1, "long enough l", ["http://jira/1"])]
    assert apply(spark, y.provider_of, "http://jira/1", "http://x") == ["jira", "confluence"]


def test_lengths_of_html_paragraphs(spark):
    page = "<p><b>It ab.<br>abc</p><p>&copy; a b</p><p> &middot; <i>to</i> &amp; from \n</p><li><script>x</script>123456789</li><p>It abc.<br>abc</p>"
    p = y.html_paragraphs(texts(spark, page), "id", "text").collect()
    assert [(r.paragraph, r.text) for r in p] == [(2, "&middot; to & from"), (3, "123456789"), (4, "It abc.\nabc")]


def test_cited_paragraphs(spark):
    page = (
        '<p>Opening paragraph</p><p><i data-review-id="a">first reviewed</i></p><h2>H</h2><li data-review-id="x">short</li><li>a link of <a href="http://Slack/1">Source: Talk</a><a href="u">Talk</a><a href="v">no</a></li>'
        '<p data-x><b data-review-id="b"></b>second reviewed</p><p><b data-review-id="c"></b>third reviewed</p>'
    )
    p = y.html_paragraphs(texts(spark, page, "<p>A page without any</p>", "", None), "id", "text")
    blocks = spark.createDataFrame([(0, "a", "edited", "by hand"), (0, "b", "edited", ""), (0, "c", None, None), (1, "a", "accepted", None)], "id int, review string, status string, edited string")
    cites = spark.createDataFrame([(0, n, "d" if n < 2 else None, None if n == 3 else "jira", f"c{n}") for n in range(9)], "id int, seq int, doc string, provider string, label string")
    sources = spark.createDataFrame([(1, 2, "slack", "s2"), (1, 1, "fax", None), (1, 3, "jira", "s3"), (0, 1, "jira", "unused")], "id int, seq int, provider string, title string")
    got = {(r.id, r.section, r.paragraph): (r.text, r.confidence, [(c.source, c.label, c.doc, c.url) for c in r.cited]) for r in y.cited_paragraphs(p, blocks, cites, sources, "id").collect()}
    assert got == {
        (0, 0, 0): ("Opening paragraph", "inferred", [("jira", "c0", "d", None)]),
        (0, 0, 1): ("by hand", "verified", [("jira", "c2", None, None), ("confluence", "c3", None, None)]),
        (0, 1, 0): ("a link of Source: TalkTalkno", "inferred", [("jira", "c0", "d", None), ("slack", "Talk", None, "http://Slack/1")]),
        (0, 1, 1): ("second reviewed", "verified", [("jira", "c2", None, None), ("confluence", "c3", None, None)]),
        (0, 1, 2): ("third reviewed", "needs-verification", [("jira", "c4", None, None), ("jira", "c5", None, None)]),
        (1, 0, 0): ("A page without any", "inferred", [("confluence", "fax", None, None), ("slack", "s2", None, None)]),
    }


def test_matching_functions(spark):
    assert apply(spark, x.plain_words, "# Head\n> quote\n- item [a](b) *x*\n---\nend") == ["head quote item a x end"]
    assert apply(spark, lambda c: F.array_sort(x.char_grams(c, 3)), "abcab", "ab", "", None) == [["abc", "bca", "cab"], [], [], None]
    assert apply(spark, x.without_type_prefix, "Decision: Go", "PR #12 x") == ["Go", "12 x"]
    pairs = spark.createDataFrame([("alpha beta gamma delta echo", "delta gamma beta alpha zulu", True), ("alpha beta gamma", "gamma beta delta", False), ("alpha beta", "beta alpha", False), ("in", "begin", True), ("", "x", False)], "p string, q string, want boolean")
    assert all(r.got == r.want for r in pairs.select("want", x.strong_match(F.col("p"), F.col("q")).alias("got")).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders(spark, seed):
    rnd = random.Random(seed)
    pairs = {p for p in itertools.combinations(range(40), 2) if rnd.random() < 0.08}
    want, led = {}, []
    for i in range(40):
        want[i] = next((j for j in led if (j, i) in pairs), i)
        if want[i] == i:
            led.append(i)
    rows = spark.createDataFrame([(i,) for i in [*range(40), 3, None]], "id long")
    got = leaders(rows, spark.createDataFrame([*pairs, (2, 99), *list(pairs)[:3]], "a long, b long"))
    assert {r.id: r.leader for r in got.collect()} == want
    assert leaders(rows.limit(0), spark.createDataFrame([], "a long, b long")).count() == 0


def one(df):
    return sorted(df.collect(), key=lambda r: r.source_id)


def test_wiki_and_issue_blocks(spark):
    wiki = f"DOCUMENT: Guide\n{DASH}\nSpace: ENG\nAuthor:\nLabels: a, b\n{DASH}\nBody\ntext\n{BAR}\nnoise\n{BAR}\r\nDOCUMENT: Bare\nrest"
    a, b = one(blocks.wiki_blocks(texts(spark, wiki, "", None)))
    assert (a.title, a.content, a.metadata) == ("Bare", "rest", {})
    assert (b.title, b.content, b.metadata) == ("Guide", "Body\ntext", {"space": "ENG", "labels": "a, b"})
    (i,) = one(blocks.issue_blocks(texts(spark, "ABC-7\nTitle: Fix\nType: Bug\nStatus: Done\n\nDescription:\nwhat\n\nComments:\nann: ok")))
    assert (i.source_id, i.title, i.content) == ("ABC-7", "ABC-7: Fix", "# ABC-7: Fix\n\nType: Bug | Status: Done\n\n## Description\nwhat\n\n## Comments\nann: ok")


def test_change_form_and_chat_blocks(spark):
    (c,) = one(blocks.change_blocks(texts(spark, "PR #5 - Add x\nRepository: org/app\nStatus: Merged\n\nDescription:\nwhy\n\nFiles changed:\na.py\n\nReview Comments:\nfine")))
    assert (c.source_id, c.title) == ("org/app/pull/5", "app PR #5: Add x")
    assert c.content == "# PR #5: Add x\n\nState: Merged | Author: unknown\n\nwhy\n\n## Files Changed\na.py\n\n## Review Comments\nfine"
    (f,) = one(blocks.form_blocks(texts(spark, "Submission #3\nName: Ann\nSubject: Hello\n\nMessage:\nhi\nyou")))
    assert (f.source_id, f.title, f.content) == ("3", "Hello", "# Hello\n\nFrom: Ann\n\nhi\nyou")
    (m,) = one(blocks.chat_blocks(texts(spark, f"#dev | 2024-01-01\n{DASH}\nAnn: hi\nBob [9:00 AM]: yo\n{BAR}\n#dev | 2024-01-02\n{DASH}\nAnn: bye")))
    assert m.content == "# #dev\n\nAnn: hi\nBob [9:00 AM]: yo\nAnn: bye"
    assert m.metadata == {"participants": "Ann, Bob", "messages": "3", "dates": "2024-01-01 to 2024-01-02"}
    (s,) = blocks.structured(texts(spark, "Submission #3\nSubject: Hello"), "feedback").collect()
    assert (s.slug, s.item.title) == ("feedback-3", "Hello")


def test_contamination_finds_passages_of_any_length(spark, tmp_path):
    from loomgraph import catalog

    docs = ["a long text with several words in it", "short", "", None, "a long text  with several words in it"]
    passages = ["ong text with several words i", "hor", "sh", "", "t  with", "absent passage of many words", None]
    spark.createDataFrame([(i, v) for i, v in enumerate(docs)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, v) for i, v in enumerate(passages)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {i: n for i, p in enumerate(passages) if p is not None and (n := sum(p in d for d in docs if d is not None))}
    got = catalog.QUERIES["y25_contamination"](spark, str(tmp_path)).collect()
    assert {r.item_id: r.docs for r in got} == want
