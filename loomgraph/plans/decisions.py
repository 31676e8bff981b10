"""Steps that decide: which candidate nodes stay, what a cited title refers to, how hypotheses are wired."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators.graph import written
from ..operators.names import occurrences
from ..registry import query
from ..sources.tables import table as t
from .audits import one_of

# ---------------------------------------------------------------- candidates that stay

# Words by which evidence and labels are told apart.
PROCESS_UNITS = r"onboarding|runbook|playbook|workflow|guide|checklist|postmortem"
TICKET_UNITS = r"planning|roadmap|copy|mockups?|review|touch target|fix|bug|cleanup|maintenance|e2e|test|hiring|1:1"
DECISIONS = r"decided|decision|prefer|better than|instead of|tradeoff|going with|makes more sense|standardize|suggested|opted|convention"
PROCESSES = r"process|workflow|runbook|playbook|checklist|triage|handoff|manual process|review flow|deployment pipeline|daily|weekly|every \d+"
FEATURES = r"page|portal|browser|browse|tracking|calendar|chooser|navigation|comparison|feature|volunteer|api|integration|pipeline|responsiveness|standardization|form|orders"
FRAGMENTS = r"card|cards|button|buttons|layout|designs?|endpoint|tests?|cta|nav pr"
SCREENS = r"dashboard|page|portal|browser|form|screen"
REPOSITORIES = r"repository|repo|github|gitlab|codebase|service"
TASK_STARTS = r"fix|update|cleanup|refactor|investigate|bug|hotfix"
TASK_WORDS = r"copy|roadmap|planning|postmortem|onboarding|maintenance"
PROCESS_LABELS = r"checklist|runbook|workflow|process|guide|playbook"
PROJECT_LABELS = r"project|feature|initiative|migration|redesign|rollout|launch|integration|dashboard|pipeline|standardization"
SURFACES = r"page|pages|portal|browser|dashboard|tracking|calendar|chooser|profiles|search|navigation|library|api|integration|pipeline|responsiveness|standardization"
INITIATIVES = r"q[1-4]|priority|priorities|body of work|initiative|workstream|confluence docs|docs up by|actively designed and built|distinct feature"
SEEDED = ["deterministic-jira", "deterministic-github"]
END = "([^a-z0-9_]|$)"


def says(words: str) -> str:
    """Pattern of lower-case text that holds one of the words between marks, spaces or its ends."""
    return f"(^|[^a-z0-9_])({words}){END}"


#: Patterns of labels: an unknown author, a repository, the start of a task, a numbered ticket or change.
UNKNOWN_AUTHOR = f"^(message|comment|thread|ticket|doc|page)[ ]+author{END}"
REPOSITORY = f"(^|[-/])(api|web|app|service|repo){END}"
TASK = f"^(([a-z]+-|pr *#)[0-9]|({TASK_STARTS}){END})"
CHANGE = "^pr *#[0-9]"


def project_review(low, sources, n_refs, said):
    """(score, kind) of a label as a project: kind is what it should be, 'project' if it may stay one.  `said` is the lower-case
    reasoning and evidence, `sources` the distinct kinds of its references."""
    only = lambda s: (F.size(sources) == 1) & F.array_contains(sources, s)
    task = low.rlike(TASK) | low.rlike(says(TASK_WORDS))
    points = [
        (F.array_contains(sources, "confluence"), 2),
        (n_refs >= 2, 1),
        (F.size(sources) >= 2, 1),
        (low.rlike(says(PROJECT_LABELS)), 1),
        (low.rlike(says(SURFACES)), 1),
        (said.rlike(says(INITIATIVES)), 2),
        (task, -3),
        (only("jira") & (n_refs <= 1), -2),
        (only("github") & (n_refs <= 1), -2),
    ]
    score = sum((F.when(c, p).otherwise(0) for c, p in points), F.lit(0))
    kind = F.when(low.rlike(says(PROCESS_LABELS)), "process").when(low.rlike(CHANGE) | only("github"), "pull_request")
    return score, kind.when(only("jira") | task, "ticket").when(score >= 2, "project").otherwise("ticket")


def validated(nodes):
    """Of each candidate node what becomes of it: (node, action, type, reason, needs_support).

    Nodes are (node, type, name, kind, family, confidence, origin, repository, reasoning, refs), refs an array of (source, title,
    excerpt); any but node may be null.  Action is keep, retype (to type), reject, or ask where only a reader can judge."""
    null = lambda c: F.coalesce(c, F.lit(""))
    refs = F.coalesce("refs", F.expr("array()").cast("array<struct<source: string, title: string, excerpt: string>>"))
    n = nodes.withColumn("refs", refs)
    evidence = F.concat_ws("\n", "name", "reasoning", F.array_join(F.transform("refs", lambda r: F.concat_ws("\n", r.title, r.excerpt)), "\n"))
    said = F.concat_ws(" ", "reasoning", F.array_join(F.transform("refs", lambda r: F.concat_ws(" ", r.title, r.excerpt)), " "))
    n = n.select(
        "*",
        F.lower(evidence).alias("evidence"),
        F.lower(said).alias("said"),
        F.lower(F.trim(null(F.col("name")))).alias("low"),
        F.array_distinct(F.transform("refs", lambda r: null(r.source))).alias("sources"),
        F.size("refs").alias("n_refs"),
    )
    low, text, sources, n_refs = (F.col(c) for c in ("low", "evidence", "sources", "n_refs"))
    score, suggested = project_review(low, sources, n_refs, F.col("said"))
    n = n.select("*", score.alias("score"), suggested.alias("suggested"), low.rlike(says(FEATURES)).alias("feature"))
    kind, node_type = null(F.col("kind")), null(F.col("type"))
    is_a = lambda *types: node_type.isin(*types)
    one = (n_refs == 1) & (F.size(sources) == 1)
    deciding = is_a("decision") | kind.isin("decision_signal", "pattern_signal")
    acting = ~deciding & (is_a("process") | (kind == "process_signal"))
    stays = (deciding & (text.rlike(says(DECISIONS)) | F.col("family").isNotNull())) | (acting & text.rlike(says(PROCESSES)))
    repo = F.col("repository").isNotNull() | low.rlike(REPOSITORY) | text.rlike(says(REPOSITORIES))
    project, feature, weak = is_a("project"), F.col("feature"), F.col("suggested") != "project"
    unsure = null(F.col("confidence")) == "low"
    verdicts = [
        (stays, "keep", "type", "protected"),
        (is_a("team_member") & low.rlike(UNKNOWN_AUTHOR), "reject", "type", "placeholder"),
        (is_a("repository") & ~repo & one & F.array_contains(sources, "slack") & low.rlike(says(SCREENS)), "reject", "type", "screen"),
        (project & ~feature & text.rlike(says(PROCESS_UNITS)), "retype", "process", "process_work"),
        (project & ~feature & text.rlike(says(TICKET_UNITS)), "retype", "ticket", "ticket_work"),
        (project & low.rlike(says(FRAGMENTS)) & one, "retype", "ticket", "fragment"),
        (project & weak & ~feature & unsure & (n_refs <= 1), "reject", "type", "thin"),
        (project & weak & ~feature & ((F.col("score") <= 1) | (n_refs <= 1)), "retype", "suggested", "review"),
        (project & weak & feature, "keep", "type", "feature"),
        (project & weak, "ask", "type", "ambiguous"),
        (unsure & one & ~null(F.col("origin")).isin(SEEDED), "reject", "type", "weak"),
    ]
    out = F.struct(F.lit("keep").alias("action"), F.col("type"), F.lit("passed").alias("reason"))
    for test, action, to, reason in reversed(verdicts):
        new = F.col(to) if to in ("type", "suggested") else F.lit(to)
        out = F.when(test, F.struct(F.lit(action).alias("action"), new.alias("type"), F.lit(reason).alias("reason"))).otherwise(out)
    return n.select("node", out.alias("v")).select("node", "v.action", "v.type", "v.reason", (F.col("v.reason") == "feature").alias("needs_support"))


CANDIDATE_TYPES = ["project", "project", "decision", "project", "process", "team_member", "project", "repository"]
CANDIDATE_NAMES = ["Donor search", "PR #12 web", "Office", "Message author note", "Orders page", "Fix login", "Card layout", "Team checklist", "Data migration", "Main screen", "pets-api", "PAY-7 letters", "Grand rollout"]
CANDIDATE_SOURCES = ["slack", "jira", "github", "confluence"]
SQL_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_says(column: str, words: str) -> str:
    return f"regexp_matches({column}, '{says(words)}')"


@query(
    f"""WITH c AS (
  SELECT doc_id AS node, {SQL_LIST(CANDIDATE_TYPES)}[1 + doc_id % 8] AS type, {SQL_LIST(CANDIDATE_NAMES)}[1 + doc_id % 13] AS name,
         CASE doc_id % 11 WHEN 3 THEN 'decision_signal' WHEN 5 THEN 'process_signal' END AS kind, CASE WHEN doc_id % 17 = 0 THEN 'color' END AS family,
         ['low', 'high', 'low', 'medium'][1 + doc_id % 4] AS confidence, CASE WHEN doc_id % 5 = 0 THEN 'deterministic-jira' END AS origin,
         CASE WHEN doc_id % 19 = 0 THEN 'r' END AS repository, lang AS reasoning, text,
         {SQL_LIST(CANDIDATE_SOURCES)}[1 + doc_id % 4] AS s1, CASE WHEN doc_id % 3 = 0 THEN {SQL_LIST(CANDIDATE_SOURCES)}[1 + (doc_id // 4) % 4] END AS s2 FROM documents),
d AS (
  SELECT *, lower(concat_ws(chr(10), name, reasoning, source_text)) AS evidence, lower(concat_ws(' ', reasoning, source_text)) AS said, lower(name) AS low,
         CASE WHEN s2 IS NULL THEN 1 ELSE 2 END AS n_refs, CASE WHEN s2 IS NULL OR s1 = s2 THEN 1 ELSE 2 END AS n_sources
  FROM (SELECT *, coalesce(text, '') AS source_text FROM c)),
e AS (
  SELECT *, regexp_matches(low, '{TASK}') OR {sql_says("low", TASK_WORDS)} AS task, n_sources = 1 AND s1 = 'jira' AS jira_only, n_sources = 1 AND s1 = 'github' AS github_only,
         {sql_says("low", FEATURES)} AS feature, n_refs = 1 AND n_sources = 1 AS one FROM d),
f AS (
  SELECT *, CASE WHEN s1 = 'confluence' OR s2 = 'confluence' THEN 2 ELSE 0 END + CASE WHEN n_refs > 1 THEN 1 ELSE 0 END + CASE WHEN n_sources > 1 THEN 1 ELSE 0 END
         + CASE WHEN {sql_says("low", PROJECT_LABELS)} THEN 1 ELSE 0 END + CASE WHEN {sql_says("low", SURFACES)} THEN 1 ELSE 0 END
         + CASE WHEN {sql_says("said", INITIATIVES)} THEN 2 ELSE 0 END - CASE WHEN task THEN 3 ELSE 0 END - CASE WHEN n_refs = 1 AND (jira_only OR github_only) THEN 2 ELSE 0 END AS score FROM e),
g AS (
  SELECT *, CASE WHEN {sql_says("low", PROCESS_LABELS)} THEN 'process' WHEN regexp_matches(low, '{CHANGE}') OR github_only THEN 'pull_request'
                 WHEN jira_only OR task THEN 'ticket' WHEN score >= 2 THEN 'project' ELSE 'ticket' END AS suggested,
         CASE WHEN type = 'decision' OR kind = 'decision_signal' THEN {sql_says("evidence", DECISIONS)} OR family IS NOT NULL
              WHEN type = 'process' OR kind = 'process_signal' THEN {sql_says("evidence", PROCESSES)} ELSE false END AS stays FROM f),
h AS (
  SELECT *, CASE WHEN stays THEN 'protected'
                 WHEN type = 'team_member' AND regexp_matches(low, '{UNKNOWN_AUTHOR}') THEN 'placeholder'
                 WHEN type = 'repository' AND one AND s1 = 'slack' AND {sql_says("low", SCREENS)} AND repository IS NULL
                      AND NOT regexp_matches(low, '{REPOSITORY}') AND NOT {sql_says("evidence", REPOSITORIES)} THEN 'screen'
                 WHEN type = 'project' AND NOT feature AND {sql_says("evidence", PROCESS_UNITS)} THEN 'process_work'
                 WHEN type = 'project' AND NOT feature AND {sql_says("evidence", TICKET_UNITS)} THEN 'ticket_work'
                 WHEN type = 'project' AND one AND {sql_says("low", FRAGMENTS)} THEN 'fragment'
                 WHEN type = 'project' AND suggested <> 'project' THEN
                   CASE WHEN feature THEN 'feature' WHEN confidence = 'low' AND n_refs <= 1 THEN 'thin' WHEN score <= 1 OR n_refs <= 1 THEN 'review' ELSE 'ambiguous' END
                 WHEN confidence = 'low' AND one AND origin IS NULL THEN 'weak' ELSE 'passed' END AS reason FROM g)
SELECT node, reason, reason = 'feature' AS needs_support,
       CASE WHEN reason IN ('protected', 'feature', 'passed') THEN 'keep' WHEN reason = 'ambiguous' THEN 'ask'
            WHEN reason IN ('placeholder', 'screen', 'thin', 'weak') THEN 'reject' ELSE 'retype' END AS action,
       CASE reason WHEN 'process_work' THEN 'process' WHEN 'ticket_work' THEN 'ticket' WHEN 'fragment' THEN 'ticket' WHEN 'review' THEN suggested ELSE type END AS type FROM h"""
)
def y05_validation(spark, d):
    """Each document as the evidence of one candidate node."""
    i = F.col("doc_id")
    ref = lambda source, excerpt: F.struct(source.alias("source"), F.lit(None).cast("string").alias("title"), excerpt.alias("excerpt"))
    first = ref(one_of(i, CANDIDATE_SOURCES), F.col("text"))
    second = ref(one_of(F.floor(i / 4), CANDIDATE_SOURCES), F.lit(None).cast("string"))
    nodes = t(spark, d, "documents").select(
        i.alias("node"),
        one_of(i, CANDIDATE_TYPES).alias("type"),
        one_of(i, CANDIDATE_NAMES).alias("name"),
        F.when(i % 11 == 3, "decision_signal").when(i % 11 == 5, "process_signal").alias("kind"),
        F.when(i % 17 == 0, "color").alias("family"),
        one_of(i, ["low", "high", "low", "medium"]).alias("confidence"),
        F.when(i % 5 == 0, "deterministic-jira").alias("origin"),
        F.when(i % 19 == 0, "r").alias("repository"),
        F.col("lang").alias("reasoning"),
        F.when(i % 3 == 0, F.array(first, second)).otherwise(F.array(first)).alias("refs"),
    )
    return validated(nodes)


# ---------------------------------------------------------------- cited titles

# Types of documents looked through first, by provider and in this order, and types that hold no content.
PREFERRED = {"slack": ["slack_conversation", "slack_message", "slack_thread"], "jira": ["jira_issue", "jira_comment"]}
OTHERWISE = ["confluence_page"]
NO_CONTENT = ["slack_channel", "slack_user"]
#: Documents of a word that a title tries first, and how many times more it tries next.
TRIED = 8


def title_pattern(title):
    """The title's words of three characters or more, in order on one line; the whole title if it has none."""
    plain = lambda c: F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    words = F.filter(F.split(F.lower(title), r"\s+"), lambda w: F.length(w) > 2)
    return F.when(F.size(words) > 0, F.array_join(F.transform(words, plain), ".*")).otherwise(plain(F.lower(title)))


def resolve_titles(cited, docs):
    """The document (provider, title, doc_id) that each cited (provider, title) refers to: of docs (doc_id, provider, type, title,
    content, author) of the provider, one whose title, content or author matches the title's words, preferred types
    first, then any with content, by title or content; ties by id.  Titles without a match have no row.

    They meet at one word of the title, of those that documents of the provider hold the one that the fewest hold (a title without
    words: all of it).  A word's documents are tried in the order in which they would be chosen, TRIED of them, then that many times
    more, until each title has its first match or has tried all: common words cost no pair with every document."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    d = docs.select("doc_id", "provider", "type", low(F.col("title")).alias("t"), low(F.col("content")).alias("c"), low(F.col("author")).alias("a"))
    q = cited.where("provider is not null and title <> ''").select("provider", "title").distinct().withColumn("pattern", F.concat(F.lit("(?d)"), title_pattern(F.col("title"))))
    words = F.filter(F.split(F.lower("title"), r"\s+"), lambda w: F.length(w) > 2)
    needed = F.when(F.size(words) > 0, words).otherwise(F.array(F.lower("title")))
    asked = written(q.select("provider", "title", "pattern", F.explode(F.array_distinct(needed)).alias("name")))
    kind = d.schema["doc_id"].dataType
    hay = d.where("provider is not null and doc_id is not null").select(F.concat(F.length("provider"), F.lit(":"), "provider", F.col("doc_id").cast("string")).alias("id"), F.concat_ws("\n", "t", "c", "a").alias("text"))
    letters, rest = F.substring_index("id", ":", 1).cast("int"), F.substr(F.col("id"), F.instr("id", ":") + 1)
    held = written(occurrences(hay, asked).select(F.substr(rest, F.lit(1), letters).alias("provider"), F.substr(rest, letters + 1).cast(kind).alias("doc_id"), "name"))
    counts = held.groupBy("provider", "name").count()
    rare = asked.join(counts, ["provider", "name"], "left").groupBy("provider", "title", "pattern")
    rare = rare.agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "name")).alias("k")).where("k.n > 0")
    open_ = written(rare.select("provider", "title", "pattern", "k.name", "k.n"))
    place = F.array_position(F.array(*map(F.lit, OTHERWISE)), F.col("type"))
    for provider, types in PREFERRED.items():
        place = F.when(F.col("provider") == provider, F.array_position(F.array(*map(F.lit, types)), F.col("type"))).otherwise(place)
    first = F.coalesce(place, F.lit(0)) > 0
    kept = first | ~F.coalesce(F.col("type").isin(NO_CONTENT), F.lit(False))
    ranks = d.where(kept).select("doc_id", "provider", first.alias("first"), F.when(first, place).otherwise(F.lit(9)).alias("rank"))
    nth = F.row_number().over(Window.partitionBy("provider", "name").orderBy("rank", "doc_id"))
    lists = held.join(open_.select("provider", "name").distinct(), ["provider", "name"], "left_semi").join(ranks, ["provider", "doc_id"])
    lists = written(lists.select("provider", "name", "doc_id", "first", nth.alias("r")))
    text = F.rlike("t", "pattern") | F.rlike("c", "pattern")
    tried, found = 0, []
    while not open_.isEmpty():
        most = max(TRIED, tried * TRIED)
        now = lists.where((F.col("r") > tried) & (F.col("r") <= most))
        pairs = open_.join(now, ["provider", "name"]).join(d.select("doc_id", "provider", "t", "c", "a"), ["provider", "doc_id"])
        hits = pairs.where(text | (F.col("first") & F.rlike("a", "pattern"))).groupBy("provider", "title").agg(F.min_by("doc_id", "r").alias("doc_id"))
        found.append(written(hits))
        # A title of few documents has tried them all.
        open_ = written(open_.where(F.col("n") > most).join(found[-1], ["provider", "title"], "left_anti"))
        tried = most
    none = d.where("false").select("provider", F.lit("").alias("title"), "doc_id")
    return reduce(DataFrame.union, found, none)


@query(
    """WITH docs AS (
  SELECT doc_id, ['slack', 'jira', 'confluence'][1 + doc_id % 3] AS provider, lower(coalesce(lang, '')) AS t, lower(coalesce(text, '')) AS c, lower(coalesce(source, '')) AS a,
         CASE doc_id % 3 WHEN 0 THEN ['slack_user', 'slack_thread', 'slack_message', 'slack_conversation', 'slack_file'][1 + (doc_id // 3) % 5]
                         WHEN 1 THEN ['jira_comment', 'jira_issue', 'jira_board'][1 + (doc_id // 3) % 3] ELSE 'confluence_page' END AS type FROM documents),
w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ') AS w FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL),
cited AS (SELECT DISTINCT ['slack', 'jira', 'confluence'][1 + p] AS provider, concat_ws(' ', w[2], w[3], w[5]) AS title FROM w, (VALUES (0), (1), (2)) v(p) WHERE len(w) >= 5),
q AS (SELECT *, list_filter(string_split(lower(title), ' '), lambda x: length(x) > 2) AS words FROM cited),
p AS (SELECT provider, title, CASE WHEN len(words) > 0 THEN array_to_string(words, '.*') ELSE lower(title) END AS pattern FROM q),
m AS (
  SELECT p.provider, p.title, doc_id, list_position(CASE p.provider WHEN 'slack' THEN ['slack_conversation', 'slack_message', 'slack_thread']
         WHEN 'jira' THEN ['jira_issue', 'jira_comment'] ELSE ['confluence_page'] END, type) AS place, type,
         regexp_matches(t, pattern) OR regexp_matches(c, pattern) AS found, regexp_matches(a, pattern) AS by_author
  FROM p JOIN docs ON docs.provider = p.provider)
SELECT provider, title, arg_min(doc_id, (coalesce(place, 9), doc_id)) AS doc_id FROM m
WHERE CASE WHEN coalesce(place, 0) > 0 THEN found OR by_author ELSE found AND type NOT IN ('slack_channel', 'slack_user') END GROUP BY ALL"""
)
def j21_source_titles(spark, d):
    """Three words of every fiftieth document, cited at each provider, against all documents."""
    i = F.col("doc_id")
    third = F.floor(i / 3)
    kind = F.when(i % 3 == 0, one_of(third, ["slack_user", "slack_thread", "slack_message", "slack_conversation", "slack_file"]))
    kind = kind.when(i % 3 == 1, one_of(third, ["jira_comment", "jira_issue", "jira_board"])).otherwise("confluence_page")
    providers = ["slack", "jira", "confluence"]
    rows = t(spark, d, "documents")
    docs = rows.select("doc_id", one_of(i, providers).alias("provider"), kind.alias("type"), F.col("lang").alias("title"), F.col("text").alias("content"), F.col("source").alias("author"))
    w = rows.where("doc_id % 50 = 0 and text is not null").select(F.split(F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")), " ").alias("w")).where(F.size("w") >= 5)
    title = F.concat_ws(" ", *[F.element_at("w", n) for n in (2, 3, 5)])
    return resolve_titles(w.select(F.explode(F.array(*map(F.lit, providers))).alias("provider"), title.alias("title")), docs)


# ---------------------------------------------------------------- discoveries

# Words that make no family of names or no topic, words of tasks and of projects, what makes a page no documentation.
NO_FAMILY = ["page", "feature", "project", "phase", "frontend", "backend"]
NO_TOPIC = ["page", "feature", "portal", "browser", "tracking", "orders", "calendar", "project", "setup"]
TASK_NOISE = r"fix|bug|test|cleanup|touch target|404|broken link|copy update|maintenance|refactor"
SHAPES = r"page|pages|portal|browser|dashboard|tracking|calendar|chooser|feature|search|navigation|improvements|redesign|integration"
PLANNED = r"priority|priorities|initiative|body of work|workstream|actively designed and built|distinct feature|q[1-4]|planned"
NO_DOCUMENT = ["no formal project doc", "capacity notes", "quarterly priorities"]
LEAST_PHRASE = 7


def name_words(c, least, but=()):
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: (F.length(w) >= least) & ~w.isin(list(but))))


def same_family(keys, names):
    """The keys (key) that share two words or more, and all those of the shorter one, with one of names (name), both loose.
    They meet at pairs of words."""
    pairs = lambda w: F.flatten(F.transform(w, lambda a: F.transform(F.filter(w, lambda b: b > a), lambda b: F.struct(a, b))))
    rows = lambda df, c, w: df.select(c, name_words(F.col(c), 4, NO_FAMILY).alias(w)).select(c, w, F.explode(pairs(F.col(w))).alias("p"))
    met = rows(keys, "key", "u").join(rows(names.distinct(), "name", "v"), "p")
    return met.where(F.size(F.array_intersect("u", "v")) >= F.least(F.size("u"), F.size("v"))).select("key").distinct()


def documented(keys, pages):
    """The keys (key, loose) that a page (id, hay), loose, holds: the key, its first or last two words, if seven characters or more, or
    three words of its topic.  Topics meet pages at all but their two commonest words."""
    w = F.filter(F.split("key", " "), lambda x: F.length(x) >= 3)
    phrases = F.array("key", F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.when(F.size(w) > 2, F.slice(w, -2, 2)).otherwise(w), " "))
    asked = keys.select("key", F.explode(F.array_distinct(phrases)).alias("phrase")).where(F.length("phrase") >= LEAST_PHRASE)
    met = occurrences(pages.select("id", F.col("hay").alias("text")), asked.select(F.col("phrase").alias("name")))
    by_phrase = asked.join(met.select(F.col("name").alias("phrase")).distinct(), "phrase", "left_semi").select("key")
    topics = keys.select("key", name_words(F.col("key"), 4, NO_TOPIC).alias("topic")).where(F.size("topic") >= 3)
    words = pages.select("id", F.explode(F.array_distinct(F.split("hay", " "))).alias("w"))
    each = topics.select("key", "topic", F.explode("topic").alias("w"))
    counts = words.join(each.select("w").distinct(), "w", "left_semi").groupBy("w").count()
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.coalesce("count", F.lit(0)), "w"))
    first = each.join(counts, "w", "left").withColumn("r", place).where(F.col("r") <= F.size("topic") - 2)
    near = first.join(words, "w").select("key", "topic", "id").distinct().join(pages, "id")
    by_topic = near.where(F.size(F.array_intersect("topic", F.split("hay", " "))) >= 3).select("key")
    return by_phrase.union(by_topic).distinct()


def discoveries(observations, canonical, emitted, docs):
    """What becomes of each name that observations (seq, label, type, source, doc, said) give to a project or ticket: (key, label,
    type, n_docs, reason), reason null for a discovery, else why there is none, the first that holds.

    Canonical and emitted are (name, type); docs (id, provider, title, content).  A project answers for a ticket of its name."""
    low = F.lower(F.concat_ws("\n", "label", "said"))
    rows = observations.where(F.col("type").isin("project", "ticket")).withColumn("key", x.loose(F.col("label"))).where("key <> ''")
    groups = written(
        rows.groupBy("key").agg(
            F.min_by("label", "seq").alias("label"),
            F.when(F.bool_or(F.col("type") == "project"), "project").otherwise("ticket").alias("type"),
            F.array_sort(F.collect_set("source")).alias("sources"),
            F.count_distinct("doc").alias("n_docs"),
            F.count("*").alias("n"),
            F.bool_or(low.rlike(says(TASK_NOISE))).alias("noise"),
            F.bool_or(low.rlike(says(PLANNED))).alias("planned"),
        )
    )
    loose = lambda df: df.select(x.loose(F.col("name")).alias("key"), "type")
    held = lambda df: loose(df).where(F.col("type").isin("project", "ticket")).groupBy("key").agg(F.bool_or(F.col("type") == "project").alias("as_project"))
    keys = groups.select("key")
    projects = loose(canonical).where("type = 'project'").select(F.col("key").alias("name"))
    plain = docs.where((F.col("provider") == "confluence") & ~F.lower(F.coalesce("title", F.lit(""))).contains("roadmap"))
    pages = plain.select("id", x.loose(F.concat_ws("\n", "title", "content")).alias("hay"))
    pages = written(pages.where(~F.concat(F.lit(" "), "hay", F.lit(" ")).rlike(says("|".join(NO_DOCUMENT)))))
    mark = lambda df, name: df.select("key", F.lit(True).alias(name))
    g = groups.join(held(canonical).withColumnRenamed("as_project", "known"), "key", "left").join(held(emitted).withColumnRenamed("as_project", "out"), "key", "left")
    g = g.join(mark(same_family(keys, projects), "family"), "key", "left").join(mark(documented(keys, pages), "described"), "key", "left")
    project, flag = F.col("type") == "project", lambda c: F.coalesce(F.col(c), F.lit(False))
    answered = lambda c: F.col(c).isNotNull() & (flag(c) | ~project)
    strong = F.array_contains("sources", "jira") | F.array_contains("sources", "github")
    shaped = F.lower("label").rlike(says(SHAPES)) | F.col("planned")
    few = project & ~strong & (F.col("n_docs") < 2)
    reasons = [
        ("already_canonical", answered("known")),
        ("already_emitted", answered("out")),
        ("task_noise", F.lower("label").rlike("^([a-z]+-|pr *#)[0-9]") | F.col("noise")),
        ("same_family", project & flag("family")),
        ("documented", project & flag("described")),
        ("jira_only", project & (F.col("sources") == F.array(F.lit("jira")))),
        ("weak_shape", few & ~shaped & (F.size("sources") < 2)),
        ("thin_support", few),
        ("single_ticket", ~project & (F.col("n") < 2)),
    ]
    why = F.coalesce(*[F.when(test, name) for name, test in reasons])
    return g.select("key", "label", "type", F.col("n_docs").cast("long").alias("n_docs"), why.alias("reason"))


LABEL_ENDS = ["portal", "cards", "fix", "migration plan", "letters", "shop window", "search page", "notes", "calendar sync", "release"]
SQL_LOOSE = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
SQL_WORDS = "list_distinct(list_filter(string_split({}, ' '), lambda w: length(w) >= {} AND NOT list_contains({}, w)))"


@query(
    f"""WITH p AS (SELECT *, p_name || ' ' || {SQL_LIST(LABEL_ENDS)}[1 + p_partkey % 10] AS label FROM part),
o AS (SELECT p_partkey AS seq, label, CASE WHEN p_size % 3 = 0 THEN 'ticket' WHEN p_size % 11 = 1 THEN 'decision' ELSE 'project' END AS type,
             ['slack', 'jira', 'github', 'confluence'][1 + p_size % 4] AS source, p_partkey % 500 AS doc,
             CASE p_partkey % 31 WHEN 0 THEN 'a bug' WHEN 1 THEN 'planned for q3' END AS said FROM p WHERE p_partkey % 3 > 0),
g AS (SELECT {SQL_LOOSE.format("label")} AS key, arg_min(label, seq) AS label, CASE WHEN bool_or(type = 'project') THEN 'project' ELSE 'ticket' END AS type,
             list_sort(list(DISTINCT source)) AS sources, count(DISTINCT doc) AS n_docs, count(*) AS n,
             bool_or({sql_says("lower(concat_ws(chr(10), label, said))", TASK_NOISE)}) AS noise, bool_or({sql_says("lower(concat_ws(chr(10), label, said))", PLANNED)}) AS planned
      FROM o WHERE type IN ('project', 'ticket') GROUP BY 1),
canon AS (SELECT {SQL_LOOSE.format("label")} AS key, CASE WHEN p_size % 2 = 0 THEN 'project' ELSE 'ticket' END AS type FROM p WHERE p_partkey % 60 = 0
          UNION ALL SELECT {SQL_LOOSE.format("p_name || ' calendar sync old'")}, 'project' FROM p WHERE p_partkey % 90 = 1),
emitted AS (SELECT {SQL_LOOSE.format("label")} AS key, 'project' AS type FROM p WHERE p_partkey % 70 = 3),
pages AS (SELECT {SQL_LOOSE.format("title || chr(10) || content")} AS hay
          FROM (SELECT p_brand || CASE WHEN p_partkey % 5 = 0 THEN ' Roadmap' ELSE '' END AS title,
                       'On ' || CASE WHEN p_partkey % 2 = 0 THEN label ELSE p_name || ' and migration for a shop window' END || CASE WHEN p_partkey % 9 = 0 THEN '; capacity notes' ELSE '' END AS content
                FROM p WHERE p_partkey % 45 = 0 OR p_partkey % 77 = 5) WHERE NOT contains(lower(title), 'roadmap')),
live AS (SELECT hay, string_split(hay, ' ') AS words FROM pages WHERE NOT regexp_matches(hay, '{says("|".join(NO_DOCUMENT))}')),
k AS (SELECT key, list_filter(string_split(key, ' '), lambda w: length(w) >= 3) AS w3, {SQL_WORDS.format("key", 4, NO_TOPIC)} AS topic, {SQL_WORDS.format("key", 4, NO_FAMILY)} AS fam FROM g),
described AS (
  SELECT DISTINCT key FROM k, live WHERE len(list_filter([key, array_to_string(w3[1:2], ' '), array_to_string(w3[-2:], ' ')], lambda x: length(x) >= 7 AND contains(hay, x))) > 0
     OR len(topic) >= 3 AND len(list_intersect(topic, words)) >= 3),
cf AS (SELECT DISTINCT {SQL_WORDS.format("key", 4, NO_FAMILY)} AS v FROM canon WHERE type = 'project'),
family AS (SELECT DISTINCT key FROM k, cf WHERE len(list_intersect(fam, v)) >= 2 AND len(list_intersect(fam, v)) >= least(len(fam), len(v)))
SELECT key, label, type, n_docs, CASE
  WHEN EXISTS (SELECT 1 FROM canon c WHERE c.key = g.key AND (g.type = 'ticket' OR c.type = 'project')) THEN 'already_canonical'
  WHEN EXISTS (SELECT 1 FROM emitted c WHERE c.key = g.key) THEN 'already_emitted'
  WHEN regexp_matches(lower(label), '^([a-z]+-|pr *#)[0-9]') OR noise THEN 'task_noise'
  WHEN type = 'ticket' THEN CASE WHEN n < 2 THEN 'single_ticket' END
  WHEN key IN (SELECT key FROM family) THEN 'same_family'
  WHEN key IN (SELECT key FROM described) THEN 'documented'
  WHEN sources = ['jira'] THEN 'jira_only'
  WHEN NOT list_has_any(sources, ['jira', 'github']) AND n_docs < 2 THEN
    CASE WHEN len(sources) < 2 AND NOT planned AND NOT {sql_says("lower(label)", SHAPES)} THEN 'weak_shape' ELSE 'thin_support' END END AS reason FROM g"""
)
def y10_discovery(spark, d):
    """Parts as observations, as canonical names and as pages."""
    i, size = F.col("p_partkey"), F.col("p_size")
    p = t(spark, d, "part").withColumn("label", F.concat_ws(" ", "p_name", one_of(i, LABEL_ENDS)))
    kind = F.when(size % 3 == 0, "ticket").when(size % 11 == 1, "decision").otherwise("project")
    said = F.when(i % 31 == 0, "a bug").when(i % 31 == 1, "planned for q3")
    source = one_of(size, ["slack", "jira", "github", "confluence"])
    seen = p.where(i % 3 > 0).select(i.alias("seq"), "label", kind.alias("type"), source.alias("source"), (i % 500).alias("doc"), said.alias("said"))
    named = lambda rows, name, type_: rows.select(name.alias("name"), type_.alias("type"))
    canonical = named(p.where(i % 60 == 0), F.col("label"), F.when(size % 2 == 0, "project").otherwise("ticket"))
    canonical = canonical.union(named(p.where(i % 90 == 1), F.concat(F.col("p_name"), F.lit(" calendar sync old")), F.lit("project")))
    emitted = named(p.where(i % 70 == 3), F.col("label"), F.lit("project"))
    title = F.concat(F.col("p_brand"), F.when(i % 5 == 0, " Roadmap").otherwise(""))
    about = F.when(i % 2 == 0, F.col("label")).otherwise(F.concat(F.col("p_name"), F.lit(" and migration for a shop window")))
    content = F.concat(F.lit("On "), about, F.when(i % 9 == 0, "; capacity notes").otherwise(""))
    docs = p.where((i % 45 == 0) | (i % 77 == 5)).select(i.alias("id"), F.lit("confluence").alias("provider"), title.alias("title"), content.alias("content"))
    return discoveries(seen, canonical, emitted, docs)
