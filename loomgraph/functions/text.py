"""Column functions on strings and token sets; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def loose(c: Column) -> Column:
    """Lower case, other than letters and digits to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def unicode_loose(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column) -> Column:
    """Distinct tokens of two letters or more; . _ @ separate, a dash too, other marks go."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "[._@]", " "), r"[^a-z0-9\s-]", "")
    return F.array_distinct(F.filter(F.split(plain, r"[\s-]+"), lambda x: F.length(x) > 1))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def token_similarity(a: Column, b: Column) -> Column:
    """Shared over the larger set; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(overlap(a, b) / F.greatest(F.size(a), F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.0).otherwise(overlap(a, b) / F.size(F.array_union(a, b)))


def slug(c: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def truncate(c: Column, most: int) -> Column:
    """Trimmed; over `most` characters, cut 3 before it, trimmed and with an ellipsis."""
    t = F.trim(c)
    return F.when(F.length(t) > most, F.concat(F.trim(F.substring(t, 1, most - 3)), F.lit("..."))).otherwise(t)


def singular(c: Column) -> Column:
    long = F.length(c) > 3
    return F.when(long & c.endswith("ies"), F.regexp_replace(c, "ies$", "y")).when(long & c.endswith("s") & ~c.endswith("ss"), F.regexp_replace(c, "s$", "")).otherwise(c)


def word_bag(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(loose(c), " ")), " ")


def chunks(c: Column, size: int = 1000, overlap_: int = 200) -> Column:
    """Windows (start, end, text) over a text; the last one ends with it.  Texts are trimmed, offsets not."""
    step = max(1, size - overlap_)
    n = F.length(c)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, n).alias("end"), F.when(n <= size, c).otherwise(F.trim(F.substring(c, i * step + 1, F.lit(size)))).alias("text")))


def html_text(c: Column) -> Column:
    """Plain text of simple HTML: scripts, styles and tags go, block ends are line breaks, entities are
    decoded, the ampersand first."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for entity, plain in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


# Entities and what they stand for, the ampersand first.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]
MARK = "\x01"


def _blocks(c: Column, tag: str, layout) -> Column:
    """The text with each element of the tag laid out anew; elements are split off, so every second part is one."""
    parts = F.split(F.regexp_replace(c, rf"(?is)(<{tag}\b[^>]*>.*?</{tag}>)", f"{MARK}$1{MARK}"), MARK)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, layout(p)).otherwise(p)), "")


def _inner(c: Column, tag: str) -> Column:
    """What the elements of the tag hold, without tags and trimmed."""
    found = F.regexp_extract_all(c, F.lit(rf"(?is)<(?:{tag})\b[^>]*>(.*?)</(?:{tag})>"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, "(?s)<[^>]+>", ""), r"^\s+|\s+$", ""))


def _table(c: Column) -> Column:
    rows = F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<tr\b[^>]*>.*?</tr>"), F.lit(0)), lambda r: _inner(r, "td|th"))
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, lambda r, i: F.when(i == 0, F.concat(line(r), F.lit("\n"), rule)).otherwise(line(r)))
    return F.when(F.size(rows) > 0, F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")


def _list(c: Column, numbered: bool) -> Column:
    head = lambda i: F.concat((i + 1).cast("string"), F.lit(". ")) if numbered else F.lit("- ")
    return F.concat(F.lit("\n"), F.array_join(F.transform(_inner(c, "li"), lambda x, i: F.concat(head(i), x)), "\n"), F.lit("\n"))


def html_markdown(c: Column) -> Column:
    """HTML as text with marks: headings to the fourth level, tables, lists, code, bold and slanted words, quotes, rules.
    Character data is unwrapped, other macros, scripts, styles, comments and tags go; entities are decoded last, and there is at
    most one empty line between others."""
    steps = [
        (MARK, ""),
        (r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"),
        (r"(?is)<(script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->", ""),
        (r"(?is)<ac:structured-macro\b[^>]*ac:name=['\"]code['\"][^>]*>.*?<ac:plain-text-body>\s*(.*?)\s*</ac:plain-text-body>.*?</ac:structured-macro>", "\n```\n$1\n```\n"),
        (r"(?is)<ac:[^>]*>.*?</ac:[^>]*>|<(?:ac|ri):[^>]*>", ""),
        *[(rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}>", f"\n{'#' * n} $1\n") for n in (1, 2, 3, 4)],
    ]
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    c = _blocks(_blocks(_blocks(c, "table", _table), "ul", lambda p: _list(p, False)), "ol", lambda p: _list(p, True))
    steps = [(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", f"{m}$1{m}") for tag, m in (("strong", "**"), ("b", "**"), ("em", "*"), ("i", "*"), ("code", "`"))]
    steps += [
        (r"(?i)<hr\s*/?>", "\n---\n"),
        (r"(?i)<blockquote\b[^>]*>", "\n> "),
        (r"(?i)<br\s*/?>|</?p\b[^>]*>|</(?:div|blockquote)>", "\n"),
        (r"(?s)<[^>]+>", ""),
    ]
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    for entity, plain in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def cosine(a: Column, b: Column) -> Column:
    """In double precision, with 1e-10 added to the product of the lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-10)


def half_up(c: Column) -> Column:
    """Rounded to the integer, halves toward plus infinity."""
    return F.floor(c + 0.5)


def truthy(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in cs[:-1]], cs[-1])


# Marks that text for matching is without, in this order, and what takes their place.
PLAIN = [
    ("(?md)^[-=]{3,}$", ""),
    (r"(?md)^\s*>+\s?", ""),
    (r"(?md)^#{1,6}\s+", ""),
    (r"(?md)^\s*(?:\d+[.)]\s+|[-*+]\s+)", ""),
    ("[–—]", "-"),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    ("[`*_~]", ""),
    ("[‘’‚‛]", "'"),
    ("[“”„‟]", '"'),
    (r"\s+", " "),
]


def plain_words(c: Column) -> Column:
    """Text for matching: without rules, quote marks, headings, list marks, link targets and emphasis, with straight
    quotes, single spaces and lower case."""
    for pattern, new in PLAIN:
        c = F.regexp_replace(c, pattern, new)
    return F.lower(F.trim(c))


def strong_match(p: Column, q: Column) -> Column:
    """Of two plain texts: one holds the other, or they share half of the smaller one's distinct words over three
    letters, and four of them if it has as many.  Three such words are needed on either side."""
    word = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) > 3))
    a, b = word(p), word(q)
    least, shared = F.least(F.size(a), F.size(b)), overlap(a, b)
    return (p != "") & (q != "") & (p.contains(q) | q.contains(p) | ((least >= 3) & (shared >= F.least(F.lit(4), least)) & (shared / least >= 0.5)))


def keyword_score(words: Column, targets: Column) -> Column:
    """How many words (repeats count) equal, begin or continue one of the targets."""
    known = F.array_distinct(targets)
    return F.size(F.filter(words, lambda c: F.exists(known, lambda y: c.startswith(y) | y.startswith(c)))).cast("long")


def char_grams(c: Column, n: int) -> Column:
    """Distinct runs of n characters; none of a shorter text.  Read in n passes, each from one character further on."""
    passes = [F.regexp_extract_all(F.substring(c, i + 1, 2**31 - 1), F.lit(f"(?s).{{{n}}}"), F.lit(0)) for i in range(n)]
    return F.array_distinct(F.concat(*passes))


def without_type_prefix(c: Column) -> Column:
    # The prefixes by which names of a type are cited.
    return F.trim(F.regexp_replace(c, r"(?i)^(Decision:\s*|Process:\s*|Project:\s*|PR\s*#?\s*|Ticket:\s*)", ""))
