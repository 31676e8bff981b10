"""Metrics of a step's artifact, declared as data and compiled to one pass over JSON artifacts."""

from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table as t
from .audits import one_of

#: Metrics (key, form, arguments): what is measured of an artifact (fixed values).  Paths are names with dots; several are tried in order.
#:   number     the first path that is there, else 0
#:   sum        of all paths, what is missing as 0
#:   size       elements of an array or keys of an object, else 0
#:   truth      1 if the path says true, else 0
#:   there      1 if the path is there, else nothing
#:   given      the number, else nothing
#:   not_over   1 if the first is at most the second
#:   covers     1 if the first is at least the second and that is over 0, else 0
#:   reaches    1 if the second is 0, or the first (an array's size) is at least it
#:   equal_to   1 if the first is the second, else 0; nothing unless the second is over 0
#:   unless     the second, nothing unless the first is over 0
#:   percent    100 * (sum of the paths after the first) / the first, rounded; 100 if that is 0
#:   less       100 * (first - second) / first, rounded; 100 if the first is 0
#:   least, most, mean   of a member of all elements (of an array member its size, of an object its keys); else 0
#:   every      1 if the member of all elements is there and not empty, else 0; the last argument is what no elements give
#:   has        1 if the array holds the last argument; with a first path that is 0, 1
METRICS = [
    ("provider_diversity", "size", ["by_provider", "by_source"]),
    ("total_chunks_positive", "number", ["total_chunks"]),
    ("chunks_cover_documents", "covers", ["total_chunks", "total_documents"]),
    ("evidence_spans_positive", "number", ["total_evidence_spans", "total_chunks"]),
    ("observation_count_positive", "number", ["total_observations"]),
    ("candidate_type_diversity", "size", ["candidate_entities_by_type", "entities_by_type"]),
    ("retyped_or_rejected_positive", "sum", ["retyped_count", "opus_rejected"]),
    ("after_count_not_greater_than_before_count", "not_over", ["total_entities_after", "total_entities_before"]),
    ("zero_co_occurrence_semantic_edges", "truth", ["zero_co_occurrence_semantic_edges"]),
    ("pattern_candidates_positive", "size", ["pattern_candidates"]),
    ("total_new_edges", "number", ["total_new_edges", "new_edges"]),
    ("conventions_found_positive", "number", ["conventions_found"]),
    ("category_diversity", "size", ["by_category"]),
    ("min_decisions_per_convention", "least", ["phase3_conventions", "constituent_decisions"]),
    ("description_coverage_pct", "less", ["total_entities_processed", "descriptions_missing_after"]),
    ("valid_status_pct", "percent", ["total_project_process_nodes", "statuses_already_valid", "statuses_filled", "statuses_corrected"]),
    ("decided_by_corrections_count", "given", ["decided_by_corrected"]),
    ("decisions_with_decided_by_pct", "percent", ["total_decisions", "decided_by_fixed", "decided_by_confirmed", "decided_by_corrected"]),
    ("documentation_level_set", "every", ["phase3_conventions", "documentation_level", None]),
    ("identity_based_merges_logged", "there", ["identity_merges"]),
    ("convention_edges_positive", "sum", ["convention_edges_added", "applies_to_edges_added"]),
    ("traversal_checks_positive", "number", ["traversal_qa.summary.checked"]),
    ("traversal_full_pass_positive", "number", ["traversal_qa.summary.full_pass"]),
    ("hidden_conventions_page_present_when_needed", "has", ["convention_node_count", "human_page_categories", "hidden_conventions"]),
    ("company_overview_page_present", "has", [None, "human_page_categories", "company_overview"]),
    ("planned_repo_pages_present_when_repo_nodes_exist", "reaches", ["planned_repository_pages", "repository_node_count"]),
    ("convention_entity_pages_present_when_needed", "reaches", ["planned_convention_pages", "convention_node_count"]),
    ("retrieval_pack_count_matches_plan", "equal_to", ["total_packs", "expected_total_packs"]),
    ("howto_count_positive_when_proposed_work_exists", "unless", ["target_node_count", "total_howtos"]),
    ("convention_reference_coverage_pct", "unless", ["convention_constraints_total", "convention_reference_coverage_pct"]),
    ("step_evidence_coverage_pct", "unless", ["implementation_step_count", "step_evidence_coverage_pct"]),
    ("evidence_pack_convention_source_count", "most", ["evidence_pack_samples", "convention_source_count"]),
    ("evidence_pack_source_type_diversity", "most", ["evidence_pack_samples", "source_type_mix"]),
    ("evidence_pack_fallback_ratio_low", "mean", ["evidence_pack_samples", "fallback_ratio_pct"]),
    ("zero_jira_auto_project_promotions", "truth", ["zero_jira_auto_project_promotions"]),
]


def measured(artifacts, metrics=METRICS):
    """(step, key, actual) of artifacts (step, artifact: JSON text), a row for each metric, null where there is nothing to measure.

    A plain number under the metric's own key counts before its form.  All metrics are built-in expressions on the artifact, so
    they are one pass and one narrow projection.  What is no JSON, or null, is an empty artifact; what is no number is as missing."""
    doc = F.when(F.try_parse_json("artifact").isNotNull(), F.col("artifact")).otherwise(F.lit("{}"))
    get = lambda path: F.get_json_object("doc", f"$.{path}")
    number = lambda path: F.expr(f"try_cast(get_json_object(doc, '$.{path}') as double)")
    zero = lambda path: F.coalesce(number(path), F.lit(0.0))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    rounded = lambda c: F.floor(c + 0.5).cast("double")

    def size(text):
        """Elements of an array, or keys of an object; null of anything else."""
        return F.coalesce(F.json_array_length(text), F.when(F.trim(text).startswith("{"), F.size(F.json_object_keys(text)))).cast("double")

    def members(path, name):
        """The member of each element; null if the path is no array."""
        rows = F.from_json(get(path), "array<map<string, string>>")
        return F.transform(rows, lambda r: F.element_at(r, name))

    def valued(c):
        return F.coalesce(size(c), c.try_cast("double"), F.lit(0.0))

    def form(key, kind, a):
        if kind == "number":
            return F.coalesce(*map(number, a), F.lit(0.0))
        if kind == "sum":
            return sum(map(zero, a[1:]), zero(a[0]))
        if kind == "size":
            return F.coalesce(*[size(get(p)) for p in a], F.lit(0.0))
        if kind == "truth":
            return flag(F.coalesce(get(a[0]), F.lit("")) == "true")
        if kind == "there":
            return F.when(get(a[0]).isNotNull(), 1.0)
        if kind == "given":
            return number(a[0])
        if kind == "not_over":
            return flag(zero(a[0]) <= zero(a[1]))
        if kind == "covers":
            return flag((zero(a[1]) > 0) & (zero(a[0]) >= zero(a[1])))
        if kind == "reaches":
            return flag((zero(a[1]) == 0) | (F.coalesce(size(get(a[0])), F.lit(0.0)) >= zero(a[1])))
        if kind == "equal_to":
            return F.when(zero(a[1]) > 0, flag(zero(a[0]) == zero(a[1])))
        if kind == "unless":
            return F.when(zero(a[0]) > 0, zero(a[1]))
        if kind == "percent":
            return F.when(zero(a[0]) > 0, rounded(100 * sum(map(zero, a[2:]), zero(a[1])) / zero(a[0]))).otherwise(100.0)
        if kind == "less":
            return F.when(zero(a[0]) > 0, rounded(100 * (zero(a[0]) - zero(a[1])) / zero(a[0]))).otherwise(100.0)
        if kind == "has":
            held = F.array_contains(F.coalesce(F.from_json(get(a[1]), "array<string>"), F.array().cast("array<string>")), a[2])
            return flag(held if a[0] is None else (zero(a[0]) == 0) | held)
        inside = members(a[0], a[1])
        if kind == "every":
            return F.when(F.coalesce(F.size(inside), F.lit(0)) > 0, flag(F.forall(inside, lambda c: F.coalesce(c, F.lit("")) != ""))).otherwise(F.lit(a[2]).cast("double"))
        values = F.transform(inside, valued)
        if kind == "mean":
            mean = F.aggregate(values, F.lit(0.0), lambda x, y: x + y) / F.size(values)
            return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, rounded(mean)).otherwise(zero(key.removesuffix("_low") + "_pct"))
        some = F.array_min(values) if kind == "least" else F.array_max(values)
        return F.coalesce(some, zero(key) if kind == "most" else F.lit(0.0))

    rows = artifacts.where("step is not null").select("step", F.coalesce(doc, F.lit("{}")).alias("doc"))
    values = [F.struct(F.lit(k).alias("key"), F.coalesce(number(k), form(k, kind, a)).alias("actual")) for k, kind, a in metrics]
    return rows.select("step", F.explode(F.array(*values)).alias("m")).select("step", "m.*")


PARTS = ["ring", "widget"]


@query(
    """WITH a AS (SELECT s_suppkey AS step, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a, count(DISTINCT l_linenumber) AS k, max(l_linenumber) AS mx,
  round(avg(l_linenumber * 10.0)) AS mean, count(DISTINCT l_returnflag) AS flags FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1),
m AS (SELECT step, unnest([
  {'key': 'provider_diversity', 'actual': flags::DOUBLE}, {'key': 'total_chunks_positive', 'actual': n::DOUBLE}, {'key': 'chunks_cover_documents', 'actual': CASE WHEN r > 0 AND n >= r THEN 1.0 ELSE 0.0 END},
  {'key': 'evidence_spans_positive', 'actual': n::DOUBLE}, {'key': 'observation_count_positive', 'actual': CASE WHEN step % 2 = 0 THEN r::DOUBLE ELSE 0 END}, {'key': 'candidate_type_diversity', 'actual': flags::DOUBLE},
  {'key': 'retyped_or_rejected_positive', 'actual': (r + a)::DOUBLE}, {'key': 'after_count_not_greater_than_before_count', 'actual': CASE WHEN r <= a THEN 1.0 ELSE 0.0 END},
  {'key': 'zero_co_occurrence_semantic_edges', 'actual': CASE WHEN step % 2 = 0 THEN 1.0 ELSE 0.0 END}, {'key': 'pattern_candidates_positive', 'actual': k::DOUBLE}, {'key': 'total_new_edges', 'actual': a::DOUBLE}, {'key': 'conventions_found_positive', 'actual': step::DOUBLE},
  {'key': 'category_diversity', 'actual': 0.0}, {'key': 'min_decisions_per_convention', 'actual': CASE WHEN step % 3 = 0 THEN 0.0 ELSE 1.0 END}, {'key': 'description_coverage_pct', 'actual': floor(100.0 * (n - a) / n + 0.5)},
  {'key': 'valid_status_pct', 'actual': floor(100.0 * (r + a) / n + 0.5)}, {'key': 'decided_by_corrections_count', 'actual': CASE WHEN step % 5 = 0 THEN r::DOUBLE END}, {'key': 'decisions_with_decided_by_pct', 'actual': 100.0},
  {'key': 'documentation_level_set', 'actual': CASE WHEN step % 3 = 0 THEN NULL WHEN step % 3 = 1 THEN 1.0 ELSE 0.0 END}, {'key': 'identity_based_merges_logged', 'actual': CASE WHEN step % 2 = 0 THEN 1.0 END}, {'key': 'convention_edges_positive', 'actual': r::DOUBLE},
  {'key': 'traversal_checks_positive', 'actual': n::DOUBLE}, {'key': 'traversal_full_pass_positive', 'actual': 0.0}, {'key': 'hidden_conventions_page_present_when_needed', 'actual': CASE WHEN step % 4 = 0 OR step % 2 = 1 THEN 1.0 ELSE 0.0 END},
  {'key': 'company_overview_page_present', 'actual': 1.0}, {'key': 'planned_repo_pages_present_when_repo_nodes_exist', 'actual': CASE WHEN k >= mx THEN 1.0 ELSE 0.0 END}, {'key': 'convention_entity_pages_present_when_needed', 'actual': CASE WHEN step % 4 = 0 THEN 1.0 ELSE 0.0 END},
  {'key': 'retrieval_pack_count_matches_plan', 'actual': CASE WHEN a > 0 THEN CASE WHEN r = a THEN 1.0 ELSE 0.0 END END}, {'key': 'howto_count_positive_when_proposed_work_exists', 'actual': CASE WHEN step % 4 > 0 THEN r::DOUBLE END}, {'key': 'convention_reference_coverage_pct', 'actual': NULL}, {'key': 'step_evidence_coverage_pct', 'actual': a::DOUBLE},
  {'key': 'evidence_pack_convention_source_count', 'actual': mx::DOUBLE}, {'key': 'evidence_pack_source_type_diversity', 'actual': CASE WHEN step % 2 = 0 THEN 2.0 ELSE 1.0 END}, {'key': 'evidence_pack_fallback_ratio_low', 'actual': mean}, {'key': 'zero_jira_auto_project_promotions', 'actual': CASE WHEN step % 3 = 1 THEN 1.0 ELSE 0.0 END}]) AS m FROM a)
SELECT step, m.key AS key, m.actual AS actual FROM m"""
)
def y26_step_metrics(spark, d):
    """An artifact of each supplier's order lines."""
    s = F.col("l_suppkey")
    g = t(spark, d, "lineitem").join(t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"), F.array_sort(F.collect_set("l_linenumber")).alias("k"), F.round(F.avg(F.col("l_linenumber") * 10.0)).cast("double").alias("mean"), F.max("l_linenumber").alias("mx"), F.collect_set("l_returnflag").alias("flags")
    )
    by_flag = F.map_from_arrays("flags", F.transform("flags", lambda f: F.length(f)))
    rules = F.when(s % 3 == 0, F.array().cast("array<struct<constituent_decisions: array<string>, documentation_level: string>>")).otherwise(
        F.array(*[F.struct(F.array(*[F.lit(x) for x in p]).alias("constituent_decisions"), level.alias("documentation_level")) for p, level in ((PARTS, F.lit("documented")), (PARTS[:1], F.when(s % 3 == 1, "documented")))])
    )
    mix = F.when(s % 2 == 0, F.create_map(F.lit("slack"), F.lit(1), F.lit("jira"), F.lit(2))).otherwise(F.create_map(F.lit("jira"), F.lit(2)))
    samples = F.array(F.struct(F.col("mx").alias("convention_source_count"), mix.alias("source_type_mix"), F.col("mean").alias("fallback_ratio_pct")), F.struct(F.lit(0).alias("convention_source_count"), F.create_map(F.lit("jira"), F.lit(1)).alias("source_type_mix"), F.col("mean").alias("fallback_ratio_pct")))
    columns = {
        "by_source": by_flag, "total_chunks": F.col("n"), "total_documents": F.col("r"), "observation_count_positive": F.when(s % 2 == 0, F.col("r")), "entities_by_type": by_flag, "retyped_count": F.col("r"), "opus_rejected": F.col("a"),
        "total_entities_after": F.col("r"), "total_entities_before": F.col("a"), "zero_co_occurrence_semantic_edges": s % 2 == 0, "pattern_candidates": F.col("k"), "new_edges": F.col("a"), "conventions_found": s, "phase3_conventions": rules,
        "total_entities_processed": F.col("n"), "descriptions_missing_after": F.col("a"), "total_project_process_nodes": F.col("n"), "statuses_filled": F.col("r"), "statuses_corrected": F.col("a"), "decided_by_corrected": F.when(s % 5 == 0, F.col("r")),
        "identity_merges": F.when(s % 2 == 0, F.array(F.lit("x"))), "convention_edges_added": F.col("r"), "traversal_qa": F.struct(F.struct(F.col("n").alias("checked")).alias("summary")), "convention_node_count": s % 4,
        "human_page_categories": F.when(s % 2 == 1, F.array(F.lit("company_overview"), F.lit("hidden_conventions"))).otherwise(F.array(F.lit("company_overview"))), "planned_repository_pages": F.col("k"), "repository_node_count": F.col("mx"), "total_packs": F.col("r"),
        "expected_total_packs": F.col("a"), "target_node_count": s % 4, "total_howtos": F.col("r"), "implementation_step_count": F.col("n"), "step_evidence_coverage_pct": F.col("a"), "evidence_pack_samples": samples, "zero_jira_auto_project_promotions": s % 3 == 1,
    }
    artifact = F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]))
    return measured(g.select(s.alias("step"), artifact.alias("artifact")))
