"""Layout of texts, maps and JSON."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import layout as y
from ..registry import query
from ..sources.tables import mentions
from ..sources.tables import table as t


@query("WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(#{1,4}\\s+.)', chr(1) || '\\1', 'g'), chr(1)) AS l FROM documents), s AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM p), o AS (SELECT *, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM s) SELECT doc_id, CAST(stop AS BIGINT) - length(raw) AS start, CAST(stop AS BIGINT) AS stop, md5(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')) AS content FROM o WHERE regexp_replace(raw, '^\\s+|\\s+$', '', 'g') <> ''")
def c15_sections(spark, d):
    s = y.sections(t(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return s.select("doc_id", "start", "stop", F.md5("content").alias("content"))


@query("WITH p AS (SELECT page_id, string_split(regexp_replace(html, '(<h[23][^>]*>)', chr(1) || '\\1', 'g'), chr(1)) AS l FROM pages), s AS (SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS section FROM p), q AS (SELECT page_id, section, unnest(regexp_extract_all(regexp_replace(raw, '(?s)^<h[23][^>]*>.*?</h[23]>', ''), '(?s)<(?:p|li)[^>]*>(.*?)</(?:p|li)>', 1)) AS inner_html FROM s) SELECT page_id, CAST(section AS BIGINT) AS section, len(regexp_extract_all(inner_html, '(?s)<a[^>]*href=\"([^\"]*)\"', 1)) AS links FROM q WHERE length(trim(regexp_replace(regexp_replace(inner_html, '(?s)<[^>]*>', '', 'g'), '&[a-z#0-9]+;', '.', 'g'))) >= 10")
def c17_html_sections(spark, d):
    p = y.html_paragraphs(t(spark, d, "pages").select("page_id", "html"), "page_id", "html")
    return p.select("page_id", "section", F.size("links").cast("long").alias("links"))


@query(
    """WITH h AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(html, '<p>', '<p><span data-review-id="r' || page_id % 5 || '">') ELSE html END AS html FROM pages),
p AS (SELECT page_id, string_split(regexp_replace(html, '(<h[23][^>]*>)', chr(1) || '\\1', 'g'), chr(1)) AS l FROM h),
s AS (SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS section FROM p),
e AS (SELECT page_id, section, regexp_extract_all(regexp_replace(raw, '(?s)^<h[23][^>]*>.*?</h[23]>', ''), '(?s)<(?:p|li)[^>]*>(.*?)</(?:p|li)>', 1) AS l FROM s),
q AS (SELECT page_id, section, unnest(l) AS inner_html, generate_subscripts(l, 1) AS i FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, section ORDER BY i) - 1 AS paragraph, nullif(regexp_extract(inner_html, 'data-review-id="([^"]+)"', 1), '') AS review FROM q
      WHERE length(trim(regexp_replace(regexp_replace(inner_html, '(?s)<[^>]*>', '', 'g'), '&[a-z#0-9]+;', '.', 'g'))) >= 10),
b AS (SELECT page_id, 'r' || page_id % 5 AS review, ['accepted', 'edited', 'rejected', NULL][1 + page_id % 4] AS status FROM pages WHERE page_id % 7 > 0),
c AS (SELECT page_id, list({'doc': doc, 'provider': provider, 'label': label} ORDER BY seq) AS cs, count(*) AS n, CAST(ceil(count(*) / 8) AS BIGINT) AS share
      FROM (SELECT p_partkey % 90 AS page_id, p_partkey AS seq, CASE WHEN p_size % 5 > 0 THEN 'd' || p_partkey % 4 END AS doc, ['slack', 'jira', NULL][1 + p_partkey % 3] AS provider,
                   CASE WHEN p_size % 7 > 0 THEN p_name END AS label FROM part) GROUP BY page_id),
o AS (SELECT page_id, list({'source': CASE WHEN provider = 'fax' THEN 'confluence' ELSE provider END, 'label': coalesce(title, provider)} ORDER BY page_id) AS ss
      FROM (SELECT s_suppkey AS page_id, ['fax', 'jira'][1 + s_suppkey % 2] AS provider, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS title FROM supplier) GROUP BY page_id),
t AS (SELECT r.*, b.review IS NOT NULL AS reviewed, status, ss, n, list_transform(range(0, share), lambda k: cs[1 + (paragraph * share + k) % n]) AS turn
      FROM r LEFT JOIN b USING (page_id, review) LEFT JOIN c USING (page_id) LEFT JOIN o USING (page_id)),
u AS (SELECT *, list_transform(list_filter(turn, lambda v, k: list_position(list_transform(turn, lambda w: coalesce(w.doc, concat_ws('-', w.provider, w.label))), coalesce(v.doc, concat_ws('-', v.provider, v.label))) = k),
                               lambda v: {'source': coalesce(v.provider, 'confluence'), 'label': coalesce(v.label, 'Source'), 'url': ''}) AS own FROM t),
w AS (SELECT *, CASE WHEN n IS NOT NULL THEN own WHEN ss IS NOT NULL THEN list_transform(ss, lambda v: {'source': v.source, 'label': v.label, 'url': ''}) ELSE [] END AS base,
             list_zip(regexp_extract_all(inner_html, '(?s)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1), regexp_extract_all(inner_html, '(?s)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS z FROM u),
x AS (SELECT *, list_filter(list_transform(z, lambda v: {'url': v[1], 'label': trim(replace(replace(regexp_replace(v[2], '(?s)<[^>]*>', '', 'g'), '&amp;', '&'), '&lt;', '<'))}), lambda v: length(v.label) >= 3) AS links FROM w),
y AS (SELECT *, list_filter(links, lambda v, k: list_position(list_transform(links, lambda q: q.label), v.label) = k AND NOT list_contains(list_transform(base, lambda q: q.label), v.label)) AS fresh FROM x)
SELECT page_id, CAST(section AS BIGINT) AS section, CAST(paragraph AS BIGINT) AS paragraph, coalesce(status = 'edited' AND page_id % 2 = 1 AND page_id % 5 > 0, false) AS edited,
       CASE WHEN NOT reviewed THEN 'inferred' WHEN status IN ('accepted', 'edited') THEN 'verified' ELSE 'needs-verification' END AS confidence,
       array_to_string(list_concat(list_transform(base, lambda v: v.source || ':' || v.label || ':' || v.url), list_transform(fresh, lambda v: CASE WHEN contains(lower(v.url || ' ' || v.label), 'slack') THEN 'slack'
         WHEN contains(lower(v.url || ' ' || v.label), 'jira') THEN 'jira' ELSE 'confluence' END || ':' || v.label || ':' || v.url)), chr(10)) AS cited FROM y"""
)
def c17_citations(spark, d):
    """Paragraphs of pages, reviews by page, parts as citations and suppliers as sources."""
    i = F.col("page_id")
    mark = F.concat(F.lit('<p><span data-review-id="r'), i % 5, F.lit('">'))
    pages = t(spark, d, "pages").select("page_id", F.when(i % 3 == 0, F.replace("html", F.lit("<p>"), mark)).otherwise(F.col("html")).alias("html"))
    status = F.when(i % 4 == 0, "accepted").when(i % 4 == 1, "edited").when(i % 4 == 2, "rejected")
    blocks = t(spark, d, "pages").where(i % 7 > 0).select("page_id", F.concat(F.lit("r"), i % 5).alias("review"), status.alias("status"), F.when(i % 5 > 0, "by hand").otherwise("").alias("edited"))
    k, size = F.col("p_partkey"), F.col("p_size")
    provider = F.when(k % 3 == 0, "slack").when(k % 3 == 1, "jira")
    citations = t(spark, d, "part").select((k % 90).alias("page_id"), k.alias("seq"), F.when(size % 5 > 0, F.concat(F.lit("d"), k % 4)).alias("doc"), provider.alias("provider"), F.when(size % 7 > 0, F.col("p_name")).alias("label"))
    s = F.col("s_suppkey")
    sources = t(spark, d, "supplier").select(s.alias("page_id"), s.alias("seq"), F.when(s % 2 == 0, "fax").otherwise("jira").alias("provider"), F.when(s % 3 > 0, F.col("s_name")).alias("title"))
    p = y.cited_paragraphs(y.html_paragraphs(pages, "page_id", "html"), blocks, citations, sources, "page_id")
    lines = F.transform("cited", lambda c: F.concat(c.source, F.lit(":"), c.label, F.lit(":"), F.coalesce(c.url, F.lit(""))))
    return p.select("page_id", "section", "paragraph", F.coalesce(F.col("text") == "by hand", F.lit(False)).alias("edited"), "confidence", F.array_join(lines, "\n").alias("cited"))


@query()
def c22_titles(spark, d):
    """First lines of documents as titles."""
    first = F.substring_index("text", "\n", 1)
    return t(spark, d, "documents").where("text is not null").select("doc_id", *[y.clean_title(first, k).alias(k or "plain") for k in ("", "project", "decision")])


@query("SELECT p_partkey, upper(x[1][1]) || x[1][2:] || ' ' || upper(x[2][1]) || x[2][2:] AS label FROM (SELECT p_partkey, string_split(lower(p_name), ' ') AS x FROM part)")
def c23_labels(spark, d):
    return t(spark, d, "part").select("p_partkey", y.project_label(F.concat(F.lit("Build "), "p_name", F.lit(" backend API"))).alias("label"))


@query("SELECT conv_id, turn, len(w) AS n_terms, md5(array_to_string(w, ' ')) AS terms FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\w\\s-]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2) AS w FROM conversations)")
def c25_search_terms(spark, d):
    w = t(spark, d, "conversations").select("conv_id", "turn", y.search_terms(F.col("text")).alias("w"))
    return w.select("conv_id", "turn", F.size("w").cast("long").alias("n_terms"), F.md5(F.array_join("w", " ")).alias("terms"))


@query("SELECT c_custkey, c_name || '|' || c_mktsegment AS owners FROM customer")
def c26_owners(spark, d):
    said = F.concat(F.lit("Owner: "), "c_name", F.lit(" [new], unknown; "), "c_mktsegment", F.lit(" and TBD/"), F.upper("c_name"))
    return t(spark, d, "customer").select("c_custkey", F.array_join(y.owners(said), "|").alias("owners"))


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS json FROM events")
def c29_json_salvage(spark, d):
    """Event properties, out of replies that wrap them in words or fences."""
    reply = F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), "props", F.lit(" - done }")))
    return t(spark, d, "events").select("event_id", y.salvage_json(reply).alias("json"))


@query("SELECT conv_id, turn, CASE WHEN turn < 2 THEN '@' || CASE turn WHEN 0 THEN 'ann' ELSE 'bob' END ELSE '<@U' || turn || '>' END || ' and <@X> as ' || role AS said FROM conversations")
def c30_mentions(spark, d):
    names = F.create_map(*map(F.lit, ("U0", "ann", "U1", "bob")))
    said = F.concat(F.lit("<@U"), "turn", F.lit("> and <@X> as "), "role")
    return t(spark, d, "conversations").select("conv_id", "turn", mentions(said, names).alias("said"))


@query("SELECT c_custkey, c_mktsegment || '/' || c_nationkey || '/' || CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS merged FROM customer")
def p01_map_merge(spark, d):
    """Two maps in one; where both have a key, the second one's value stays."""
    keep = F.create_map(F.lit("segment"), "c_mktsegment", F.lit("state"), F.when(F.col("c_acctbal") < 0, "debt").otherwise("fine"))
    old = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("state"), F.lit("?"), F.lit("segment"), F.lit("?"))
    m = F.map_zip_with(old, keep, lambda k, a, b: F.coalesce(b, a)).alias("m")
    return t(spark, d, "customer").select("c_custkey", m).select("c_custkey", F.concat_ws("/", "m.segment", "m.nation", "m.state").alias("merged"))


@query("SELECT c_custkey, 'name: ' || c_name || ', segment: ' || c_mktsegment AS shown FROM customer")
def p02_map_filter(spark, d):
    """Entries whose key begins with _ are hidden."""
    m = F.create_map(F.lit("name"), "c_name", F.lit("_nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), "c_mktsegment")
    open_ = F.map_entries(F.map_filter(m, lambda k, v: ~k.startswith("_")))
    return t(spark, d, "customer").select("c_custkey", F.array_join(F.transform(open_, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ").alias("shown"))


@query("WITH l AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, props FROM events) SELECT event_id, k, was IS NOT NULL AND was <> props AS changed FROM l")
def n01_json_compare(spark, d):
    """A property out of JSON, and whether the JSON differs from the user's event before."""
    was = F.lag("props").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = t(spark, d, "events").select("event_id", "props", was.alias("was"))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("props"))).alias("changed"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def t02_limit(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query()
def v13_catalog(spark, d):
    """Tables of a folder, and their bytes; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(d).select("path", "length")
    name = F.regexp_extract("path", r"([A-Za-z_]+)\.parquet", 1)
    return files.groupBy(name.alias("name")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))


@query("SELECT vec_id, label, CASE WHEN label = (SELECT max(label) FROM embeddings) THEN 'new' ELSE 'old' END AS version FROM embeddings")
def u11_vector_upsert(spark, d):
    """Vectors of the last label are written again; the others stay."""
    from .sinks import upsert

    v = t(spark, d, "embeddings").select("vec_id", "label", F.lit("old").alias("version"))
    last = v.agg(F.max("label").alias("label"))
    return upsert(v, v.join(last, "label", "left_semi").select("vec_id", "label", F.lit("new").alias("version")), ["vec_id"])
