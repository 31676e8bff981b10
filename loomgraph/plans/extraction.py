"""What can be told from documents without a reader: seeds from their fields, signals in their units, which observations
become candidates, and candidates put together."""

from functools import reduce

from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table as t
from .audits import one_of
from .decisions import SQL_LIST, project_review, sql_says

# Words that tell kinds of work, text and places apart.
TASKS = r"fix|bug|cleanup|refactor|investigate|copy|planning|roadmap|maintenance|postmortem|onboarding|meeting|1:1|review|mockups?|touch target|handoff"
SURFACE = r"page|portal|browser|browse|tracking|calendar|chooser|navigation|profile|profiles|comparison|volunteer|feature|initiative|redesign|mvp|integration|rollout|launch|orders|responsiveness"
DIRECT_SURFACE = r"page|portal|browser|browse|tracking|calendar|chooser|navigation|comparison|feature|orders|responsiveness|redesign|integration|pipeline|standardization|search|profile|profiles|form"
FRAGMENT = r"button|buttons|card|cards|designs?|endpoint|tests?|e2e|mockups?|touch target"
UMBRELLA = r"phase\s+\d+|website redesign|roadmap"
INITIATIVE = r"phase|initiative|priority|biggest new feature|goal of|ongoing effort|feature work|started this effort|distinct feature|living document"
DECISION = r"decided|decision|prefer|instead of|tradeoff|going with|makes more sense|standardize|suggested|opted"
PROCESS = r"process|workflow|runbook|playbook|checklist|triage|handoff|manual process|review flow|deployment pipeline|daily|weekly|every \d+"
PATTERN_WORDS = r"convention|pattern|standard(?:ize|ized)?|rule|default|prefer|preferred|instead of|always|never"
PATTERN_PARTS = r"can you (?:memoize|use|add|move)|use the same([^a-z0-9_]|$)|fixed with([^a-z0-9_]|$)|let(?:'s| us) (?:move|use|add)|put .+ on the (?:left|right)|single[- ]column|vertical (?:nav|sidebar)"
CONTEXT = (
    r"ui|ux|button|cta|card|layout|menu|navigation|sidebar|filter|pagination|page|modal|drawer|grid|tab|tabs|table|form|search|sort|cache|caching|load|loading|client side|server side|api|schema|color|accent|style|responsive|mobile|memo(?:ize)?|usecallback|usememo|react\.memo|css.?module|camelcase|skeleton|toast|transition"
    r"|vertical.?(?:nav|sidebar|menu|panel)|single.?column|max-height|overflow-y|scroll(?:able)?|cursor.?(?:based|pagination)|promise\.all|lazy.?load|fallback"
)
ACTION = r"use|using|keep|put|place|load|store|filter|sort|paginate|render|show|hide|stack"
WORKFLOW_TITLE = r"process|workflow|runbook|playbook|checklist|onboarding|deployment|sync"
GENERIC = r"improvement|improvements|work"
WEAK_PRAISE = r"looks so much better|where we started"
#: Providers whose units are read for signals; least characters of a unit, of a snippet, and most of an excerpt and words of a label.
SIGNAL_PROVIDERS, LEAST_UNIT, LEAST_SNIPPET, EXCERPT, LABEL_WORDS = ["confluence", "slack", "github"], 40, 18, 280, 8
#: What makes the name of a piece of work of a title, in this order: (pattern, replacement).
TITLE_STARTS = [(r"(?i)^[A-Z]+-[0-9]+:\s*", ""), (r"(?i)^[^:]*PR\s*#[0-9]+:\s*", ""), (r"(?i)^(build|add|implement|design|create)\s+", "")]
SURFACE_RULES = [
    (r"(?i)^set up\s+(.+)$", "{1} setup"),
    (r"(?i)^standardi[sz]e\s+(.+)$", "{1} standardization"),
    (r"(?i)^(?:[a-z]+\s+)?api response format standardization$", "api response standardization"),
    (r"(?i)^(?:[a-z]+\s+)?api response standardization$", "api response standardization"),
    (r"(?i)^improv(?:e|ing)\s+(.+)$", "{1} improvements"),
    (r"(?i)^(.+?)\s+to\s+(.+)$", "{1} for {2}"),
    (r"(?i)\s+browser page$", " browser"),
    (r"(?i)\s+page designs?$", " page"),
    (r"(?i)\s+(frontend|backend)\s+api$", ""),
    (r"(?i)\s+[—-]\s+(backend|frontend|design|layout)([^A-Za-z0-9_].*)?$", ""),
    (r"(?i)\s+(frontend|backend|design|layout|feature)$", ""),
    (r"(?i)\s+(product spec|spec)$", ""),
    (r"\s*[—-]\s*$", ""),
    (r"\s+", " "),
]
NAMES = [("(^| )Ci Cd( |$)", "{1}CI/CD{2}"), ("(^|[^A-Za-z0-9_])Api([^A-Za-z0-9_]|$)", "{1}API{2}"), ("(^|[^A-Za-z0-9_])Pr([^A-Za-z0-9_]|$)", "{1}PR{2}")]
DECISION_RULES = [
    (r"^[-*>#\s]+", ""),
    (r"(?i)^the user is choosing,\s*not comparing,\s*so\s+", ""),
    (r"(?i)makes more sense to me than([^A-Za-z0-9_]|$)", " over {1}"),
    (r"(?i)makes more sense than([^A-Za-z0-9_]|$)", " over {1}"),
    (r"(?i)\s+across the top([^A-Za-z0-9_]|$)", "{1}"),
    (r"\s+", " "),
]
LABEL_RULES = [(r"^[-*>#\s]+", ""), (r"\s+", " "), (r"^ | $", ""), (r"[.:;,\-]+$", "")]
BLANK = " \t\n\r\f"


def replaced(c, rules):
    """Rules (pattern, replacement with groups as {n}) one after the other."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1].replace("{", "$").replace("}", "")), rules, c)


def trimmed(c):
    return F.btrim(c, F.lit(BLANK))


def snippets(text):
    """Sentences of the lines of a text, of LEAST_SNIPPET characters or more."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), "\n")
    return F.filter(F.transform(parts, trimmed), lambda s: F.length(s) >= LEAST_SNIPPET)


def spoken(words: str) -> str:
    """Finds what the pattern of `says` finds, in fewer steps: places are left at once whose letter begins no word, or follows one.
    (SQL engines without lookarounds take `says`.)"""
    starts = {w[:1] for w in words.split("|")}  # those of parts within a word too, which only lets more places through
    begin = f"(?=[{''.join(sorted(starts))}])" if all(c.isalnum() for c in starts) else ""
    return f"{begin}(?<![a-z0-9_])(?:{words})(?![a-z0-9_])"


def patterned(low):
    return low.rlike(spoken(PATTERN_WORDS)) | low.rlike(f"(?=[cuflpsv])(?:{PATTERN_PARTS})")


def excerpt(text, test):
    """The first snippet that passes, else the beginning of the text.  Snippets after the first that passes are not tested."""
    hit = F.aggregate(snippets(text), F.lit(None).cast("string"), lambda found, s: F.when(found.isNotNull(), found).when(test(F.lower(s)), s))
    return F.coalesce(hit, F.substring(trimmed(text), 1, EXCERPT))


def label(text, fallback):
    words = F.trim(F.array_join(F.slice(F.split(replaced(text, LABEL_RULES), " "), 1, LABEL_WORDS), " "))
    return F.when(words == "", fallback).otherwise(words)


def surface(text):
    """The name of a piece of work, as far as a title tells it."""
    return F.trim(replaced(text, SURFACE_RULES))


def display(text):
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return replaced(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " "), NAMES)


def project_of_title(title):
    """The project that a ticket's or change's title names; null if it names a task, or nothing that users see."""
    name = surface(F.trim(replaced(title, TITLE_STARTS)))
    low = F.lower(name)
    return F.when((name != "") & ~low.rlike(spoken(TASKS)) & low.rlike(spoken(DIRECT_SURFACE)), display(name))


def suppressed(text):
    """Whether a decision's excerpt says nothing: praise, or a bare contrast of five words at most."""
    plain = F.lower(F.trim(replaced(text, LABEL_RULES[:2])))
    return (plain == "") | plain.rlike(spoken(WEAK_PRAISE)) | (plain.rlike("^instead of([^a-z0-9_]|$)") & (F.size(F.split(plain, r"\s+")) <= 5))


def row(kind, name, node_type, confidence, said, origin, candidate, owner=None, status=None, linked=None, alias=None):
    null = F.lit(None).cast("string")
    flag = candidate if not isinstance(candidate, bool) else F.lit(candidate)
    values = {"kind": F.lit(kind), "label": name, "type": F.lit(node_type), "confidence": confidence if not isinstance(confidence, str) else F.lit(confidence), "excerpt": said, "origin": F.lit(origin), "candidate": flag, "owner": owner, "status": status, "linked": linked, "alias": alias}
    return F.struct(*[(null if v is None else v).alias(k) for k, v in values.items()])


def seeds(docs):
    """Observations (doc, unit, kind, label, type, confidence, excerpt, origin, candidate, owner, status, linked, alias) of documents
    (doc, provider, title, key, number, repo, person, subject, status, units: array of (unit, title, kind, text, author)).

    Issues with a key give a ticket, changes with a number a repository and a change, either the project that its title
    names; feedback gives itself and a signal.  Units of SIGNAL_PROVIDERS with LEAST_UNIT characters give what they say: the project of a
    section, a rule, a decision, a process.  `candidate` tells which are candidates at once.  Null fields say nothing;
    a document without units is read by its title alone."""
    units = F.coalesce("units", F.expr("array()").cast("array<struct<unit: string, title: string, kind: string, text: string, author: string>>"))
    d = docs.withColumn("units", units).withColumn("project", project_of_title(F.col("title")))
    first = F.when(F.size("units") > 0, F.substring(F.coalesce(F.element_at("units", 1)["text"], F.lit("")), 1, 240))
    repository = F.trim(F.element_at(F.split(F.trim("repo"), "/"), -1))
    title, person = F.col("title"), F.col("person")
    project = lambda linked: row("work_item_signal", F.col("project"), "project", "medium", first, "deterministic-feature-surface", True, person, None, linked, title)
    other = lambda name: F.when(F.lower(F.trim("repo")) != F.lower(name), F.col("repo"))
    is_ = lambda p, needed: (F.col("provider") == p) & F.col(needed).isNotNull()
    issue, change, feedback = is_("jira", "key"), is_("github", "number"), F.col("provider") == "customerFeedback"
    of_fields = [
        (issue, row("candidate_entity", F.col("key"), "ticket", "high", first, "deterministic-jira", True, person, F.col("status"), None, F.when(title != F.col("key"), title))),
        (issue & F.col("project").isNotNull(), project(F.col("key"))),
        (change & (repository != ""), row("candidate_entity", repository, "repository", "high", first, "deterministic-github-repository", True, None, None, F.col("number").cast("string"), other(repository))),
        (change, row("candidate_entity", title, "pull_request", "high", first, "deterministic-github", True, person, F.col("status"), F.col("number").cast("string"))),
        (change & F.col("project").isNotNull(), project(F.col("number").cast("string"))),
        (feedback, row("candidate_entity", title, "customer_feedback", "high", first, "deterministic-feedback", True, person)),
        (feedback, row("feedback_signal", F.coalesce("subject", "title"), "customer_feedback", "high", first, "deterministic-feedback", False, person)),
    ]
    rows = lambda cases: F.explode(F.array_compact(F.array(*[F.when(c, r) for c, r in cases])))
    unit = F.when(F.size("units") > 0, F.element_at("units", 1)["unit"])
    told = d.select("doc", unit.alias("unit"), rows(of_fields).alias("o")).select("doc", "unit", "o.*")

    u = d.where(F.col("provider").isin(SIGNAL_PROVIDERS)).select("doc", "provider", F.col("title").alias("page"), "person", F.explode("units").alias("u"))
    owner = F.coalesce("u.author", "person")
    u = u.select("doc", "provider", "page", F.col("u.unit").alias("unit"), F.trim(F.coalesce("u.title", F.lit(""))).alias("head"), F.coalesce("u.kind", F.lit("")).alias("unit_kind"), trimmed(F.coalesce("u.text", F.lit(""))).alias("text"), F.trim(F.regexp_replace(owner, r"\s*\[[^\]]+\]\s*$", "")).alias("owner"))
    u = u.where(F.length("text") >= LEAST_UNIT).withColumn("low", F.lower("text")).withColumn("owner", F.when(F.col("owner") != "", F.col("owner")))
    low, text, head = F.col("low"), F.col("text"), F.col("head")
    named = surface(F.regexp_extract(head, r"(?i)^Phase\s+[0-9]+.*?[—-]\s*(.+)$", 1))
    fits = (named != "") & (F.lower(named).rlike(spoken(DIRECT_SURFACE)) | (F.size(F.split(named, r"\s+")) >= 2)) & ~F.lower(named).rlike(spoken(TASKS))
    future = F.lower(head) == "future considerations"
    section = F.when(future, F.concat("page", F.lit(" — Future Considerations"))).when(fits, display(named))
    state = F.when(future, "proposed").when(low.rlike(r"(^|[^a-z0-9_])status:\s*complete([^a-z0-9_]|$)"), "completed").when(low.rlike(r"(^|[^a-z0-9_])status:\s*in progress([^a-z0-9_]|$)"), "active").when(low.contains("future considerations"), "proposed")
    decides = low.rlike(spoken(DECISION))
    rule = low.rlike(spoken(CONTEXT)) & (patterned(low) | (low.rlike(spoken(ACTION)) & decides))
    both = F.concat_ws("\n", head, text)
    strong = F.lower(head).rlike(spoken(WORKFLOW_TITLE))
    u = u.select("*", section.alias("section"), state.alias("state"), decides.alias("decides"), rule.alias("rule"), strong.alias("strong"), F.lower(both).rlike(spoken(PROCESS)).alias("works"))
    # Only units that say something are searched for what says it.
    u = u.select(
        "*",
        F.when(F.col("rule"), excerpt(text, lambda s: patterned(s) | s.rlike(spoken(CONTEXT)))).alias("of_rule"),
        F.when(F.col("decides"), excerpt(text, lambda s: s.rlike(spoken(DECISION)))).alias("of_decision"),
        F.when(F.col("works"), excerpt(both, lambda s: s.rlike(spoken(PROCESS)))).alias("of_process"),
    )
    owner, is_rule = F.col("owner"), F.col("rule")
    at_once = (F.col("provider") == "slack") | ((F.col("provider") == "github") & (F.col("unit_kind") == "review_comment")) | ~is_rule
    workflow = label(head, F.lit("Workflow"))
    of_units = [
        ((F.col("provider") == "confluence") & F.col("section").isNotNull(), row("work_item_signal", F.col("section"), "project", F.when(F.col("state").isNotNull(), "high").otherwise("medium"), F.substring("text", 1, 320), "deterministic-confluence-section-project", True, owner, F.col("state"))),
        (is_rule, row("pattern_signal", label(F.col("of_rule"), head), "decision", F.when(F.col("decides"), "high").otherwise("medium"), F.col("of_rule"), "deterministic-pattern", False, owner)),
        (F.col("decides") & ~suppressed(F.col("of_decision")), row("decision_signal", label(F.trim(replaced(F.col("of_decision"), DECISION_RULES)), head), "decision", F.when(is_rule, "high").otherwise("medium"), F.col("of_decision"), "deterministic-decision", at_once, owner)),
        (F.col("works"), row("process_signal", F.when(F.col("strong"), workflow).otherwise(label(F.col("of_process"), workflow)), "process", "medium", F.col("of_process"), "deterministic-process", F.col("strong") | (F.col("provider") != "confluence"), owner)),
    ]
    return told.unionByName(u.select("doc", "unit", rows(of_units).alias("o")).select("doc", "unit", "o.*"))


#: Names of the reasons why an observation becomes a candidate or not, in the order in which they are looked at.
REASONS = ["feedback", "rule", "umbrella", "fragment", "generic", "task", "review", "shaped_though_unsure", "unsure", "shapeless", "decision", "weak_decision", "process", "not_process", "weak_work", "shaped"]


def promotions(observations):
    """observations (id, kind, type, source, confidence, label, reasoning, excerpt) with `promote` and `why`, one of REASONS.  Nulls are
    as empty texts."""
    null = lambda c: F.coalesce(F.col(c), F.lit(""))
    name = F.lower(null("label"))
    text = F.lower(F.concat_ws(" ", null("label"), null("reasoning"), null("excerpt")))
    o = observations.select("*", name.alias("_name"), text.alias("_text"))
    name, text, kind, source = F.col("_name"), F.col("_text"), null("kind"), null("source")
    unsure, project, decision, process = null("confidence") == "low", null("type") == "project", null("type") == "decision", null("type") == "process"
    # The title of the reference of an observation is not part of it, so the review reads reasoning and excerpt.
    score, suggested = project_review(F.trim(name), F.array(source), F.lit(1), F.lower(F.concat_ws(" ", null("reasoning"), null("excerpt"))))
    direct = text.rlike(spoken(DIRECT_SURFACE))
    cases = {
        "feedback": (kind == "feedback_signal", False),
        "rule": (kind == "pattern_signal", False),
        "umbrella": (project & (source == "confluence") & name.rlike(spoken(UMBRELLA)) & ~name.rlike(spoken("future considerations")), False),
        "fragment": (project & (source == "slack") & text.rlike(spoken(FRAGMENT)), False),
        "generic": (project & ~direct & text.rlike(spoken(GENERIC)), False),
        "task": (project & text.rlike(spoken(TASKS)), False),
        "review": (project & source.isin("slack", "confluence") & (suggested != "project"), False),
        "shaped_though_unsure": (project & unsure & direct, True),
        "unsure": (project & unsure, False),
        "shapeless": (project & ~text.rlike(spoken(SURFACE)) & ~text.rlike(spoken(INITIATIVE)) & (source != "confluence"), False),
        "decision": (decision & ((kind == "decision_signal") | text.rlike(spoken(DECISION)) | (patterned(text) & text.rlike(spoken(CONTEXT)))), True),
        "weak_decision": (decision & unsure, False),
        "process": (process & ((kind == "process_signal") | text.rlike(spoken(PROCESS))), True),
        "not_process": (process, False),
        "weak_work": ((kind == "work_item_signal") & (null("type") != "ticket") & unsure, False),
    }
    out = F.struct(F.lit(True).alias("promote"), F.lit("shaped").alias("why"))
    for why in reversed(REASONS[:-1]):
        test, promote = cases[why]
        out = F.when(test, F.struct(F.lit(promote).alias("promote"), F.lit(why).alias("why"))).otherwise(out)
    return o.withColumn("_v", out).select(*observations.columns, "_v.promote", "_v.why")


def candidates(observations):
    """Candidates (type, key, name, confidence, aliases, observations, documents) of observations (doc, label, type, confidence, alias): one for
    each type and label, in lower case; the name is that of the least document."""
    known = observations.where("trim(label) <> ''")
    key = F.lower(F.trim("label"))
    g = known.groupBy("type", key.alias("key")).agg(
        F.min(F.struct("doc", F.trim("label").alias("label"))).alias("f"),
        F.max(F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)).alias("c"),
        F.array_sort(F.collect_set("alias")).alias("aliases"),
        F.count("*").alias("observations"),
        F.count_distinct("doc").alias("documents"),
    )
    confidence = F.when(F.col("c") == 3, "high").when(F.col("c") == 2, "medium").otherwise("low")
    return g.select("type", "key", F.col("f.label").alias("name"), confidence.alias("confidence"), F.array_join("aliases", "|").alias("aliases"), "observations", "documents")


# ---------------------------------------------------------------- the given documents as pages, issues, changes, talks and feedback

PROVIDERS = ["confluence", "jira", "slack", "github", "customerFeedback"]
TITLES = ["PAY-12: Build the orders page", "Web PR #7: Improve api search", "Fix login button", "Standardize gateway api response format", "Donor portal — backend", "Set up tracking pipeline", "Browse pets to adopt page designs", "Team handoff", "Volunteer calendar product spec", "create Ci Cd integration"]
HEADS = ["Phase 2 — Standardise donor search form", "Future Considerations", "Deployment Runbook", "Notes", "Phase 1: kickoff - fix bug", "Weekly sync", "phase 3 - orders"]
SAYINGS = [
    "We decided to use one table layout instead of cards.",
    "- Prefer lazy load for the search page. Status: In Progress",
    "Looks so much better than where we started, the decision stands!",
    "instead of that",
    "Run the checklist every 30 days; the on-call does triage.",
    "Let's use the same button style; put filters on the left.",
    "The user is choosing, not comparing, so a grid makes more sense than tabs across the top.",
    "status: complete",
    "Nothing of note was said here.",
]
PEOPLE = ["Ada [web]", "Grace", "Edsger [ api ] "]
REPOS = ["acme/pets-api", "web", " acme/ "]


def _documents(spark, d):
    i = F.col("doc_id")
    text = F.concat_ws("\n", one_of(i, SAYINGS), "text")
    unit = F.struct(F.concat("doc_id", F.lit(":1")).alias("unit"), one_of(F.floor(i / 5), HEADS).alias("title"), F.when(i % 2 == 0, "review_comment").otherwise("body").alias("kind"), text.alias("text"), F.when(i % 4 == 0, one_of(i, PEOPLE)).alias("author"))
    return t(spark, d, "documents").select(
        i.alias("doc"),
        one_of(i, PROVIDERS).alias("provider"),
        one_of(F.floor(i / 5), TITLES).alias("title"),
        F.when(i % 3 != 0, F.concat(F.lit("PAY-"), i % 97)).alias("key"),
        F.when(i % 7 != 0, i % 89).alias("number"),
        one_of(i, REPOS).alias("repo"),
        one_of(F.floor(i / 3), PEOPLE).alias("person"),
        F.when(i % 2 == 0, F.col("lang")).alias("subject"),
        F.col("source").alias("status"),
        F.array(unit).alias("units"),
    )


def sql_rules(c: str, rules) -> str:
    for pattern, new in rules:
        body, flags = (pattern[4:], "gi") if pattern.startswith("(?i)") else (pattern, "g")
        c = f"regexp_replace({c}, '{body}', '{new.replace('{', chr(92)).replace('}', '')}', '{flags}')"
    return c


def sql_trim(c: str) -> str:
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(12))"


def sql_excerpt(text: str, test) -> str:
    parts = rf"string_split(regexp_replace({text}, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))"
    found = f"list_filter(list_transform({parts}, lambda s: {sql_trim('s')}), lambda s: length(s) >= {LEAST_SNIPPET} AND ({test('lower(s)')}))"
    return f"coalesce({found}[1], substr({sql_trim(text)}, 1, {EXCERPT}))"


def sql_label(text: str, fallback: str) -> str:
    return f"coalesce(nullif(trim(array_to_string(string_split({sql_rules(text, LABEL_RULES)}, ' ')[1:{LABEL_WORDS}], ' ')), ''), {fallback})"


def sql_display(text: str) -> str:
    words = rf"list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')"
    return sql_rules(f"array_to_string(list_transform({words}, lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')", NAMES)


def sql_pattern(c: str) -> str:
    return f"({sql_says(c, PATTERN_WORDS)} OR regexp_matches({c}, '{PATTERN_PARTS.replace(chr(39), chr(39) * 2)}'))"


def _one(index: str, values) -> str:
    quoted = ", ".join("'{}'".format(v.replace("'", "''")) for v in values)
    return f"[{quoted}][1 + {index} % {len(values)}]"


DOCS = f"""docs AS (SELECT doc_id AS doc, {SQL_LIST(PROVIDERS)}[1 + doc_id % 5] AS provider, {_one("(doc_id // 5)", TITLES)} AS title, CASE WHEN doc_id % 3 <> 0 THEN 'PAY-' || (doc_id % 97) END AS key,
  CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 89 AS VARCHAR) END AS number, {_one("doc_id", REPOS)} AS repo, {_one("(doc_id // 3)", PEOPLE)} AS person, CASE WHEN doc_id % 2 = 0 THEN lang END AS subject, source AS status,
  doc_id || ':1' AS unit, {_one("(doc_id // 5)", HEADS)} AS head, CASE WHEN doc_id % 2 = 0 THEN 'review_comment' ELSE 'body' END AS unit_kind,
  concat_ws(chr(10), {_one("doc_id", SAYINGS)}, text) AS said, CASE WHEN doc_id % 4 = 0 THEN {_one("doc_id", PEOPLE)} ELSE {_one("(doc_id // 3)", PEOPLE)} END AS author FROM documents)"""

SEEDS = rf"""{DOCS},
n1 AS (SELECT *, trim({sql_rules(f"trim({sql_rules('title', TITLE_STARTS)})", SURFACE_RULES)}) AS w, trim(list_last(string_split(trim(repo), '/'))) AS repository, substr(said, 1, 240) AS first FROM docs),
n2 AS (SELECT *, CASE WHEN w <> '' AND NOT {sql_says("lower(w)", TASKS)} AND {sql_says("lower(w)", DIRECT_SURFACE)} THEN {sql_display("w")} END AS project FROM n1),
u1 AS (SELECT *, {sql_trim("said")} AS text, trim(regexp_replace(author, '\s*\[[^\]]+\]\s*$', '')) AS own FROM docs WHERE provider IN ('confluence', 'slack', 'github')),
u2 AS (SELECT *, lower(text) AS low, head || chr(10) || text AS both_, trim({sql_rules(r"regexp_extract(head, '(?i)^Phase\s+[0-9]+.*?[—-]\s*(.+)$', 1)", SURFACE_RULES)}) AS named, lower(head) = 'future considerations' AS future FROM u1 WHERE length(text) >= {LEAST_UNIT}),
u3 AS (SELECT *, CASE WHEN future THEN title || ' — Future Considerations' WHEN named <> '' AND ({sql_says("lower(named)", DIRECT_SURFACE)} OR len(string_split_regex(named, '\s+')) >= 2) AND NOT {sql_says("lower(named)", TASKS)} THEN {sql_display("named")} END AS section,
   CASE WHEN future THEN 'proposed' WHEN regexp_matches(low, '(^|[^a-z0-9_])status:\s*complete([^a-z0-9_]|$)') THEN 'completed' WHEN regexp_matches(low, '(^|[^a-z0-9_])status:\s*in progress([^a-z0-9_]|$)') THEN 'active' WHEN contains(low, 'future considerations') THEN 'proposed' END AS state,
   {sql_says("low", DECISION)} AS decides, {sql_says("lower(head)", WORKFLOW_TITLE)} AS strong, {sql_says("lower(both_)", PROCESS)} AS works FROM u2),
u4 AS (SELECT *, {sql_says("low", CONTEXT)} AND ({sql_pattern("low")} OR ({sql_says("low", ACTION)} AND decides)) AS rule FROM u3),
u5 AS (SELECT *, {sql_excerpt("text", lambda s: f"{sql_pattern(s)} OR {sql_says(s, CONTEXT)}")} AS of_rule, {sql_excerpt("text", lambda s: sql_says(s, DECISION))} AS of_decision, {sql_excerpt("both_", lambda s: sql_says(s, PROCESS))} AS of_process, {sql_label("head", "'Workflow'")} AS workflow FROM u4),
u6 AS (SELECT *, lower(trim({sql_rules("of_decision", LABEL_RULES[:2])})) AS plain FROM u5),
o AS (
 SELECT doc, unit, 'candidate_entity' AS kind, key AS label, 'ticket' AS type, 'high' AS confidence, first AS excerpt, 'deterministic-jira' AS origin, true AS candidate, person AS owner, status, NULL AS linked, CASE WHEN title <> key THEN title END AS alias FROM n2 WHERE provider = 'jira' AND key IS NOT NULL
 UNION ALL SELECT doc, unit, 'work_item_signal', project, 'project', 'medium', first, 'deterministic-feature-surface', true, person, NULL, key, title FROM n2 WHERE provider = 'jira' AND key IS NOT NULL AND project IS NOT NULL
 UNION ALL SELECT doc, unit, 'candidate_entity', repository, 'repository', 'high', first, 'deterministic-github-repository', true, NULL, NULL, number, CASE WHEN lower(trim(repo)) <> lower(repository) THEN repo END FROM n2 WHERE provider = 'github' AND number IS NOT NULL AND repository <> ''
 UNION ALL SELECT doc, unit, 'candidate_entity', title, 'pull_request', 'high', first, 'deterministic-github', true, person, status, number, NULL FROM n2 WHERE provider = 'github' AND number IS NOT NULL
 UNION ALL SELECT doc, unit, 'work_item_signal', project, 'project', 'medium', first, 'deterministic-feature-surface', true, person, NULL, number, title FROM n2 WHERE provider = 'github' AND number IS NOT NULL AND project IS NOT NULL
 UNION ALL SELECT doc, unit, 'candidate_entity', title, 'customer_feedback', 'high', first, 'deterministic-feedback', true, person, NULL, NULL, NULL FROM n2 WHERE provider = 'customerFeedback'
 UNION ALL SELECT doc, unit, 'feedback_signal', coalesce(subject, title), 'customer_feedback', 'high', first, 'deterministic-feedback', false, person, NULL, NULL, NULL FROM n2 WHERE provider = 'customerFeedback'
 UNION ALL SELECT doc, unit, 'work_item_signal', section, 'project', CASE WHEN state IS NOT NULL THEN 'high' ELSE 'medium' END, substr(text, 1, 320), 'deterministic-confluence-section-project', true, nullif(own, ''), state, NULL, NULL FROM u6 WHERE provider = 'confluence' AND section IS NOT NULL
 UNION ALL SELECT doc, unit, 'pattern_signal', {sql_label("of_rule", "head")}, 'decision', CASE WHEN decides THEN 'high' ELSE 'medium' END, of_rule, 'deterministic-pattern', false, nullif(own, ''), NULL, NULL, NULL FROM u6 WHERE rule
 UNION ALL SELECT doc, unit, 'decision_signal', {sql_label(f"trim({sql_rules('of_decision', DECISION_RULES)})", "head")}, 'decision', CASE WHEN rule THEN 'high' ELSE 'medium' END, of_decision, 'deterministic-decision', provider = 'slack' OR (provider = 'github' AND unit_kind = 'review_comment') OR NOT rule, nullif(own, ''), NULL, NULL, NULL FROM u6
   WHERE decides AND NOT (plain = '' OR {sql_says("plain", WEAK_PRAISE)} OR (regexp_matches(plain, '^instead of([^a-z0-9_]|$)') AND len(string_split_regex(plain, '\s+')) <= 5))
 UNION ALL SELECT doc, unit, 'process_signal', CASE WHEN strong THEN workflow ELSE {sql_label("of_process", "workflow")} END, 'process', 'medium', of_process, 'deterministic-process', strong OR provider <> 'confluence', nullif(own, ''), NULL, NULL, NULL FROM u6 WHERE works)"""


@query(f"WITH {SEEDS} SELECT * FROM o")
def y04_seeds(spark, d):
    """Each document as a page, issue, talk, change or feedback of one unit."""
    return seeds(_documents(spark, d))


@query(
    f"WITH {SEEDS} SELECT type, lower(trim(label)) AS key, arg_min(trim(label), (doc, trim(label))) AS name, CASE max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, "
    "coalesce(array_to_string(list_sort(list_distinct(list(alias))), '|'), '') AS aliases, count(*) AS observations, count(DISTINCT doc) AS documents FROM o WHERE candidate AND trim(label) <> '' GROUP BY 1, 2"
)
def y04_candidates(spark, d):
    return candidates(seeds(_documents(spark, d)).where("candidate"))


KINDS = ["work_item_signal", "candidate_entity", "decision_signal", "process_signal", "pattern_signal", "feedback_signal", "work_item_signal"]
TYPES = ["project", "project", "decision", "project", "process", "ticket"]
LABELS = ["Orders page", "Website redesign", "Small improvements", "Search card", "Fix copy", "Migration of letters", "Phase 2 roadmap", "Office work", "Roadmap future considerations", "Shelter initiative"]
CONFIDENCE = ["low", "medium", "high"]


@query(
    f"""WITH b AS (SELECT doc_id AS id, {SQL_LIST(KINDS)}[1 + doc_id % 7] AS kind, {SQL_LIST(TYPES)}[1 + doc_id % 6] AS type, {SQL_LIST(PROVIDERS)}[1 + (doc_id // 2) % 5] AS source, {SQL_LIST(CONFIDENCE)}[1 + (doc_id // 3) % 3] AS confidence,
  {SQL_LIST(LABELS)}[1 + doc_id % 10] AS label, lang AS reasoning, CASE WHEN doc_id % 4 = 0 THEN concat_ws(' ', {_one("doc_id", SAYINGS)}, text) ELSE text END AS excerpt FROM documents),
c AS (SELECT *, lower(label) AS name, lower(concat_ws(' ', label, coalesce(reasoning, ''), coalesce(excerpt, ''))) AS text, lower(concat_ws(' ', coalesce(reasoning, ''), coalesce(excerpt, ''))) AS said FROM b),
e AS (SELECT *, regexp_matches(name, '^(([a-z]+-|pr *#)[0-9]|(fix|update|cleanup|refactor|investigate|bug|hotfix)([^a-z0-9_]|$))') OR {sql_says("name", "copy|roadmap|planning|postmortem|onboarding|maintenance")} AS task FROM c),
f AS (SELECT *, CASE WHEN source = 'confluence' THEN 2 ELSE 0 END + CASE WHEN {sql_says("name", "project|feature|initiative|migration|redesign|rollout|launch|integration|dashboard|pipeline|standardization")} THEN 1 ELSE 0 END
  + CASE WHEN {sql_says("name", "page|pages|portal|browser|dashboard|tracking|calendar|chooser|profiles|search|navigation|library|api|integration|pipeline|responsiveness|standardization")} THEN 1 ELSE 0 END
  + CASE WHEN {sql_says("said", "q[1-4]|priority|priorities|body of work|initiative|workstream|confluence docs|docs up by|actively designed and built|distinct feature")} THEN 2 ELSE 0 END - CASE WHEN task THEN 3 ELSE 0 END AS score,
  {sql_says("name", "checklist|runbook|workflow|process|guide|playbook")} AS process_like, {sql_says("text", DIRECT_SURFACE)} AS direct FROM e)
SELECT id, kind, type, source, confidence, label, why, why IN ('shaped_though_unsure', 'decision', 'process', 'shaped') AS promote FROM (SELECT *, CASE
  WHEN kind = 'feedback_signal' THEN 'feedback' WHEN kind = 'pattern_signal' THEN 'rule'
  WHEN type = 'project' AND source = 'confluence' AND {sql_says("name", UMBRELLA)} AND NOT {sql_says("name", "future considerations")} THEN 'umbrella'
  WHEN type = 'project' AND source = 'slack' AND {sql_says("text", FRAGMENT)} THEN 'fragment'
  WHEN type = 'project' AND NOT direct AND {sql_says("text", GENERIC)} THEN 'generic'
  WHEN type = 'project' AND {sql_says("text", TASKS)} THEN 'task'
  WHEN type = 'project' AND source IN ('slack', 'confluence') AND (process_like OR task OR score < 2) THEN 'review'
  WHEN type = 'project' AND confidence = 'low' AND direct THEN 'shaped_though_unsure' WHEN type = 'project' AND confidence = 'low' THEN 'unsure'
  WHEN type = 'project' AND NOT {sql_says("text", SURFACE)} AND NOT {sql_says("text", INITIATIVE)} AND source <> 'confluence' THEN 'shapeless'
  WHEN type = 'decision' AND (kind = 'decision_signal' OR {sql_says("text", DECISION)} OR ({sql_pattern("text")} AND {sql_says("text", CONTEXT)})) THEN 'decision' WHEN type = 'decision' AND confidence = 'low' THEN 'weak_decision'
  WHEN type = 'process' AND (kind = 'process_signal' OR {sql_says("text", PROCESS)}) THEN 'process' WHEN type = 'process' THEN 'not_process'
  WHEN kind = 'work_item_signal' AND type <> 'ticket' AND confidence = 'low' THEN 'weak_work' ELSE 'shaped' END AS why FROM f)"""
)
def y04_promotions(spark, d):
    """Each document as the excerpt of one observation."""
    i = F.col("doc_id")
    said = F.when(i % 4 == 0, F.concat_ws(" ", one_of(i, SAYINGS), "text")).otherwise(F.col("text"))
    seen = t(spark, d, "documents").select(i.alias("id"), one_of(i, KINDS).alias("kind"), one_of(i, TYPES).alias("type"), one_of(F.floor(i / 2), PROVIDERS).alias("source"), one_of(F.floor(i / 3), CONFIDENCE).alias("confidence"), one_of(i, LABELS).alias("label"), F.col("lang").alias("reasoning"), said.alias("excerpt"))
    return promotions(seen).drop("reasoning", "excerpt")
