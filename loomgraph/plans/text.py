"""Scalar functions: text, dates, numbers, arrays, maps and JSON."""

from pyspark.sql import functions as F

from ..functions import text as x
from ..registry import query
from ..sources.tables import table as t

LOOSE = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
TOKENS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({0}), '[._@]', ' ', 'g'), '[^a-z0-9\\s-]', '', 'g'), '[\\s-]+'), lambda x: length(x) > 1))"


@query(f"SELECT doc_id, md5({LOOSE.format('text')}) AS loose FROM documents")
def c01_loose(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(x.loose(F.col("text"))).alias("loose"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS words FROM documents")
def c02_unicode_loose(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(x.unicode_loose(F.col("text"))).alias("words"))


@query(f"SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens FROM documents")
def c04_tokens(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(x.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 4 AND NOT list_contains(['that', 'this', 'with', 'from'], x)))) AS n FROM documents")
def c05_stop_words(spark, d):
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    keep = F.filter(w, lambda a: (F.length(a) >= 4) & ~a.isin("that", "this", "with", "from"))
    return t(spark, d, "documents").select("doc_id", F.size(F.array_distinct(keep)).cast("long").alias("n"))


@query(f"WITH p AS (SELECT p_partkey, {TOKENS.format('p_name')} AS a, {TOKENS.format('p_type')} AS b FROM part) SELECT p_partkey, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / greatest(len(a), len(b)) END, 6) AS similarity, round(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard, round(CASE WHEN least(len(a), len(b)) = 0 THEN 0 ELSE len(list_intersect(a, b)) / least(len(a), len(b)) END, 6) AS overlap FROM p")
def c06_c07_c08_similarities(spark, d):
    p = t(spark, d, "part").select("p_partkey", x.tokens(F.col("p_name")).alias("a"), x.tokens(F.col("p_type")).alias("b"))
    a, b = F.col("a"), F.col("b")
    least = F.least(F.size("a"), F.size("b"))
    return p.select("p_partkey", F.round(x.token_similarity(a, b), 6).alias("similarity"), F.round(x.jaccard(a, b), 6).alias("jaccard"), F.round(F.when(least == 0, 0.0).otherwise(x.overlap(a, b) / least), 6).alias("overlap"))


@query("SELECT doc_id, CASE WHEN length(trim(text)) > 80 THEN trim(substr(trim(text), 1, 77)) || '...' ELSE trim(text) END AS excerpt FROM documents")
def c13_truncate(spark, d):
    return t(spark, d, "documents").select("doc_id", x.truncate(F.col("text"), 80).alias("excerpt"))


@query("WITH n AS (SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) <= 1000 THEN 0 ELSE CAST(ceil((length(text) - 1000) / 800.0) AS BIGINT) END AS last FROM documents) SELECT doc_id, i * 800 AS start, least(i * 800 + 1000, n) AS stop, md5(CASE WHEN n <= 1000 THEN text ELSE trim(substr(text, i * 800 + 1, 1000)) END) AS chunk FROM n, generate_series(0, 10000) g(i) WHERE i <= last")
def c14_chunks(spark, d):
    c = t(spark, d, "documents").select("doc_id", F.explode(x.chunks(F.col("text"))).alias("c"))
    return c.select("doc_id", F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("stop"), F.md5("c.text").alias("chunk"))


def sql_steps(column, steps):
    for pattern, new in steps:
        column = f"regexp_replace({column}, '{pattern}', {new}, 'g')"
    return column


def sql_inner(column, tag):
    found = f"regexp_extract_all({column}, '(?is)<(?:{tag})\\b[^>]*>(.*?)</(?:{tag})>', 1)"
    return f"list_transform({found}, lambda w: regexp_replace(regexp_replace(w, '(?s)<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g'))"


def sql_blocks(column, tag, layout):
    parts = f"string_split(regexp_replace({column}, '(?is)(<{tag}\\b[^>]*>.*?</{tag}>)', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    return f"array_to_string(list_transform({parts}, lambda p, i: CASE WHEN i % 2 = 0 THEN {layout} ELSE p END), '')"


SQL_LINE = "'| ' || array_to_string(list_transform(range(1, width + 1), lambda k: coalesce(r[k], '')), ' | ') || ' |'"
SQL_ITEMS = "chr(10) || array_to_string(list_transform({}, lambda y, j: {} || y), chr(10)) || chr(10)"
SQL_HEAD = [
    (r"(?s)<!\[CDATA\[(.*?)\]\]>", r"'\1'"),
    (r"(?is)<(script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->", "''"),
    *[(rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}>", rf"chr(10) || '{'#' * n} \1' || chr(10)") for n in (1, 2, 3, 4)],
]
SQL_TAIL = [
    *[(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", rf"'{m}\1{m}'") for tag, m in (("strong", "**"), ("b", "**"), ("em", "*"), ("i", "*"), ("code", "`"))],
    (r"(?i)<hr\s*/?>", "chr(10) || '---' || chr(10)"),
    (r"(?i)<blockquote\b[^>]*>", "chr(10) || '> '"),
    (r"(?i)<br\s*/?>|</?p\b[^>]*>|</(?:div|blockquote)>", "chr(10)"),
    (r"(?s)<[^>]+>", "''"),
]
SQL_ENTITIES = "replace(replace(replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' ')"


@query(
    f"""WITH a AS (SELECT page_id, {sql_steps("html", SQL_HEAD)} AS t FROM pages),
s AS (SELECT page_id, string_split(regexp_replace(t, '(?is)(<table\\b[^>]*>.*?</table>)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS l FROM a),
u AS (SELECT page_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM s),
v AS (SELECT *, list_transform(regexp_extract_all(p, '(?is)<tr\\b[^>]*>.*?</tr>'), lambda w: {sql_inner("w", "td|th").replace("lambda w: ", "lambda q: ").replace("replace(w, ", "replace(q, ")}) AS cells FROM u),
w AS (SELECT *, coalesce(list_max(list_transform(cells, lambda r: len(r))), 0) AS width FROM v),
x AS (SELECT page_id, string_agg(CASE WHEN i % 2 = 1 THEN p WHEN len(cells) = 0 THEN '' ELSE chr(10) || array_to_string(list_transform(cells, lambda r, j: {SQL_LINE}
        || CASE WHEN j = 1 THEN chr(10) || '| ' || array_to_string(list_transform(range(1, width + 1), lambda k: '---'), ' | ') || ' |' ELSE '' END), chr(10)) || chr(10) END, '' ORDER BY i) AS t FROM w GROUP BY page_id),
y AS (SELECT page_id, {sql_blocks("t", "ul", SQL_ITEMS.format(sql_inner("p", "li"), "'- '"))} AS t FROM x),
z AS (SELECT page_id, {sql_blocks("t", "ol", SQL_ITEMS.format(sql_inner("p", "li"), "CAST(j AS VARCHAR) || '. '"))} AS t FROM y),
k AS (SELECT page_id, {sql_steps("t", SQL_TAIL)} AS t FROM z)
SELECT page_id, regexp_replace(regexp_replace({SQL_ENTITIES}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM k"""
)
def c16_html_text(spark, d):
    return t(spark, d, "pages").select("page_id", x.html_markdown(F.col("html")).alias("text"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS email FROM documents")
def c18_key_extraction(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))).alias("email"))


@query("SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug FROM part")
def c19_slug(spark, d):
    return t(spark, d, "part").select("p_partkey", x.slug(F.col("p_type")).alias("slug"))


@query("WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) SELECT w, CASE WHEN length(w) > 3 AND w LIKE '%ies' THEN regexp_replace(w, 'ies$', 'y') WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN regexp_replace(w, 's$', '') ELSE w END AS singular FROM w")
def c20_singular(spark, d):
    w = t(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return w.select("w", x.singular(F.col("w")).alias("singular"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and')))), ' ') AS key FROM part")
def c21_canonical_key(spark, d):
    w = F.filter(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z0-9]+"), F.lit(0)), lambda a: (F.length(a) >= 3) & ~a.isin("the", "and"))
    return t(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(w)), " ").alias("key"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\n'), lambda x: length(trim(x)) >= 18)) AS snippets FROM documents")
def c24_snippets(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda s: F.length(F.trim(s)) >= 18)).cast("long").alias("snippets"))


@query("SELECT o_orderkey, CASE WHEN regexp_matches(lower(o_orderpriority), 'urgent|blocker') THEN 'P0' WHEN regexp_matches(lower(o_orderpriority), 'high') THEN 'P1' WHEN regexp_matches(lower(o_orderpriority), 'medium') THEN 'P2' ELSE 'P3' END AS priority FROM orders")
def c27_rule_chain(spark, d):
    p = F.lower("o_orderpriority")
    return t(spark, d, "orders").select("o_orderkey", F.when(p.rlike("urgent|blocker"), "P0").when(p.rlike("high"), "P1").when(p.rlike("medium"), "P2").otherwise("P3").alias("priority"))


@query("SELECT event_id, CASE replace(lower(event_type), ' ', '_') WHEN 'click' THEN 'interaction' WHEN 'view' THEN 'interaction' WHEN 'purchase' THEN 'order' ELSE 'infrastructure' END AS kind FROM events")
def c28_alias_map(spark, d):
    m = F.create_map(*map(F.lit, ("click", "interaction", "view", "interaction", "purchase", "order")))
    return t(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(m, F.replace(F.lower("event_type"), F.lit(" "), F.lit("_"))), F.lit("infrastructure")).alias("kind"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS label, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def d01_d02_labels(spark, d):
    return t(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("label"), F.to_date("ts").cast("string").alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%b %-d, %Y') AS shown, split_part(strftime(o_orderdate, '%Y-%m-%dT%H:%M'), 'T', 1) AS day FROM orders")
def d03_display(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMM d, yyyy").alias("shown"), F.substring_index(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"), "T", 1).alias("day"))


@query("SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS duration_ms FROM events GROUP BY user_id")
def d04_duration(spark, d):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return t(spark, d, "events").groupBy("user_id").agg(us(F.max("ts")).alias("b"), us(F.min("ts")).alias("a")).select("user_id", F.expr("(b - a) div 1000").alias("duration_ms"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity * 2.5 + l_extendedprice * 10.0) / 1e6, 8) AS cost FROM lineitem")
def m01_cost(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round((F.col("l_quantity") * 2.5 + F.col("l_extendedprice") * 10.0) / 1e6, 8).alias("cost"))


@query("SELECT c_custkey, CAST(floor(c_acctbal / 100 + 0.5) AS BIGINT) AS rounded, least(greatest(c_acctbal / 10000, 0), 1) AS clamped FROM customer")
def m03_rounding(spark, d):
    return t(spark, d, "customer").select("c_custkey", x.half_up(F.col("c_acctbal") / 100).alias("rounded"), F.least(F.greatest(F.col("c_acctbal") / 10000, F.lit(0.0)), F.lit(1.0)).alias("clamped"))


@query("SELECT p_partkey, (CASE WHEN p_size > 25 THEN 3 ELSE 0 END) + (CASE WHEN p_retailprice > 1000 THEN 2 ELSE 0 END) + (CASE WHEN p_name LIKE '%red%' THEN 1 ELSE 0 END) AS score FROM part")
def m04_rule_score(spark, d):
    one = lambda c, n: F.when(c, n).otherwise(0)
    return t(spark, d, "part").select("p_partkey", (one(F.col("p_size") > 25, 3) + one(F.col("p_retailprice") > 1000, 2) + one(F.col("p_name").like("%red%"), 1)).alias("score"))


@query("SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda x: length(x) > 4), lambda x: upper(x))[1:2], '+') AS words FROM part")
def r01_r02_r03_arrays(spark, d):
    w = F.transform(F.filter(F.split("p_name", " "), lambda a: F.length(a) > 4), F.upper)
    return t(spark, d, "part").select("p_partkey", F.array_join(F.slice(w, 1, 2), "+").alias("words"))


@query("SELECT doc_id, i - 1 AS section, md5(string_split(text, chr(10))[i]) AS line FROM documents, generate_series(1, 100000) g(i) WHERE i <= len(string_split(text, chr(10)))")
def r04_nested_explode(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "l")).select("doc_id", F.col("section").cast("long").alias("section"), F.md5("l").alias("line"))


@query("SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) ELSE 1 END AS units FROM documents")
def r05_units_with_fallback(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    return t(spark, d, "documents").select("doc_id", F.when(F.col("text").contains("\n"), F.size(lines)).otherwise(1).cast("long").alias("units"))


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END, ''), c_name) AS shown FROM customer")
def p03_coalesce(spark, d):
    return t(spark, d, "customer").select("c_custkey", x.truthy(F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")), F.col("c_name")).alias("shown"))


@query("SELECT count(*) FILTER (WHERE l_quantity <= 0) AS bad_quantity, count(*) FILTER (WHERE l_discount < 0 OR l_discount > 1) AS bad_discount, count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N', 'R')) AS bad_flag FROM lineitem")
def n02_schema_violations(spark, d):
    return t(spark, d, "lineitem").agg(F.count_if(F.col("l_quantity") <= 0).alias("bad_quantity"), F.count_if((F.col("l_discount") < 0) | (F.col("l_discount") > 1)).alias("bad_discount"), F.count_if(~F.col("l_returnflag").isin("A", "N", "R")).alias("bad_flag"))


@query("SELECT conv_id, turn, sha256(conv_id || '|' || turn || '|' || role) AS id FROM conversations")
def n03_composite_id(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws("|", "conv_id", "turn", "role"), 256).alias("id"))
