"""Readers of text exports written for people: blocks between lines of 70 or more `=`, with `Field: value` lines.

Each takes a DataFrame with a column `text`, one export a row, and gives one document a block (chat: a channel):
source_id, provider, title, content, metadata (a map; fields without a value are left out).  Blocks without the mark of
their kind, empty and null texts give nothing.  A field's value ends with its line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layout import one_end


def blocks(raw: DataFrame) -> DataFrame:
    """(export, block, b): the parts of each text in order."""
    numbered = raw.select(F.monotonically_increasing_id().alias("export"), F.regexp_replace("text", r"\r\n?", "\n").alias("plain"))
    parts = numbered.select("export", F.posexplode(F.split("plain", r"(?md)^={70,}$")).alias("block", "b"))
    return parts.select("export", "block", one_end(F.col("b")).alias("b")).where("b <> ''")


def field(name: str) -> Column:
    """The value of the first line `name: value`; empty if there is none."""
    return F.trim(F.regexp_extract("b", rf"(?mid)^{name}:[ \t]*(\S.*)$", 1))


def after(name: str, *until: str) -> Column:
    """The text after the line `name:`, up to the first line of `until` or the end."""
    stop = "|".join([*[rf"\n{u}:\n" for u in until], r"\z"])
    return one_end(F.regexp_extract("b", rf"(?s)\n{name}:\n(.*?)(?:{stop})", 1))


def metadata(**values: Column) -> Column:
    """A map of those that are neither null nor empty."""
    m = F.create_map(*[v for k, c in values.items() for v in (F.lit(k), c)])
    return F.map_filter(m, lambda k, v: F.coalesce(v, F.lit("")) != "")


def lines(*cs: Column) -> Column:
    """Paragraphs that are not empty, with a blank line between them."""
    return F.array_join(F.filter(F.array(*cs), lambda c: F.coalesce(c, F.lit("")) != ""), "\n\n")


def labelled(**values: Column) -> Column:
    """`Name: value | ...` of those that are not empty."""
    return F.array_join(F.filter(F.array(*[F.when(c != "", F.concat(F.lit(f"{k}: "), c)) for k, c in values.items()]), lambda c: c.isNotNull()), " | ")


def headed(heading: str, body: Column) -> Column:
    return F.when(body != "", F.concat(F.lit(f"## {heading}\n"), body))


def _documents(df: DataFrame, provider: str, source_id: Column, title: Column, content: Column, meta: Column) -> DataFrame:
    return df.select(source_id.alias("source_id"), F.lit(provider).alias("provider"), title.alias("title"), one_end(content).alias("content"), meta.alias("metadata"))


def wiki_blocks(raw: DataFrame) -> DataFrame:
    """`DOCUMENT: title`, a line of dashes, fields, a line of dashes, the body (after the first one if there is no second)."""
    b = blocks(raw).withColumn("title", F.trim(F.regexp_extract("b", r"(?md)^DOCUMENT:[ \t]*(\S.*)$", 1))).where("title <> ''")
    parts = F.split("b", r"(?md)^-{40,}$", 3)
    body = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.regexp_replace("b", r"(?sd)\A.*?^?DOCUMENT:[^\n]*", ""))
    meta = metadata(space=field("Space"), author=field("Author"), created=field("Created"), last_updated=field("Last Updated"), labels=field("Labels"))
    return _documents(b, "wiki", F.col("title"), F.col("title"), body, meta)


def issue_blocks(raw: DataFrame, key: str = r"[A-Z][A-Z0-9]*-\d+") -> DataFrame:
    """A line with the key alone, fields, then `Description:` and `Comments:`."""
    b = blocks(raw).withColumn("key", F.regexp_extract("b", rf"(?md)^({key})[ \t]*$", 1)).where("key <> ''")
    f = {n: field(n) for n in ("Title", "Type", "Status", "Priority", "Assignee", "Reporter", "Created", "Resolved", "Sprint")}
    content = lines(F.concat(F.lit("# "), "key", F.lit(": "), f["Title"]), labelled(**{n: f[n] for n in ("Type", "Status", "Priority", "Assignee", "Reporter")}), headed("Description", after("Description", "Comments")), headed("Comments", after("Comments")))
    return _documents(b, "issues", F.col("key"), F.concat(F.col("key"), F.lit(": "), f["Title"]), content, metadata(**{n.lower(): c for n, c in f.items() if n != "Title"}))


def change_blocks(raw: DataFrame) -> DataFrame:
    """`PR #n - title`, fields, then `Description:`, `Files changed:` and `Review Comments:`."""
    head = r"(?md)^PR\s*#(\d+)\s*[—–-]\s*(.+)$"
    b = blocks(raw).withColumn("n", F.regexp_extract("b", head, 1)).where("n <> ''").withColumn("name", F.trim(F.regexp_extract("b", head, 2)))
    f = {n: field(n) for n in ("Repository", "Branch", "Author", "Created", "Merged", "Status", "Reviewers")}
    known = lambda c: F.when(c != "", c).otherwise("unknown")
    content = lines(F.concat(F.lit("# PR #"), "n", F.lit(": "), "name"), labelled(State=known(f["Status"]), Author=known(f["Author"]), Branch=f["Branch"]), after("Description", "Files changed", "Review Comments"), headed("Files Changed", after("Files changed", "Review Comments")), headed("Review Comments", after("Review Comments")))
    title = F.concat(F.substring_index(f["Repository"], "/", -1), F.lit(" PR #"), F.col("n"), F.lit(": "), F.col("name"))
    return _documents(b, "code", F.concat(f["Repository"], F.lit("/pull/"), F.col("n")), title, content, metadata(**{n.lower(): c for n, c in f.items()}))


def form_blocks(raw: DataFrame) -> DataFrame:
    """`Submission #n`, fields, then `Message:`."""
    b = blocks(raw).withColumn("n", F.regexp_extract("b", r"(?md)^Submission\s*#(\d+)", 1)).where("n <> ''")
    f = {n: field(n) for n in ("Name", "Email", "Date", "Subject")}
    content = lines(F.concat(F.lit("# "), f["Subject"]), labelled(From=f["Name"], Date=f["Date"]), after("Message"))
    title = F.when(f["Subject"] != "", f["Subject"]).otherwise(F.concat(F.lit("Feedback #"), F.col("n")))
    return _documents(b, "feedback", F.col("n"), title, content, metadata(**{n.lower(): c for n, c in f.items()}))


def speaker(message: Column) -> Column:
    """Who says `name: text` or `name [time]: text`: letters, digits, spaces and dots before the first colon outside of
    brackets; nobody if nothing is said."""
    head = F.regexp_replace(message, r"^([^\[:]*)\[[^\]]*\]", "$1")
    name = F.trim(F.substring_index(head, ":", 1))
    said = F.trim(F.substring(head, F.instr(head, ":") + 1, F.length(head)))
    return F.when(head.contains(":") & (said != "") & name.rlike(r"^\w[\w .]*$"), name).otherwise("")


def chat_blocks(raw: DataFrame) -> DataFrame:
    """`#channel | date`, dashes, messages; the blocks of a channel of one export follow each other in one document."""
    head = r"(?md)^#(\S+)\s*\|\s*(\S+)"
    b = blocks(raw).select("export", "block", F.regexp_extract("b", head, 1).alias("channel"), F.regexp_extract("b", head, 2).alias("date"), "b").where("channel <> ''")
    body = F.when(F.col("b").contains("---"), F.regexp_replace("b", r"(?s)\A.*?-{3,}\n?", "")).otherwise(F.col("b"))
    said = F.filter(F.transform(F.split(body, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    g = b.groupBy("export", "channel").agg(F.array_sort(F.collect_list(F.struct("block", "date", said.alias("said")))).alias("l"))
    messages = F.flatten("l.said")
    who = F.transform(messages, speaker)
    people = F.array_join(F.array_distinct(F.filter(who, lambda p: p != "")), ", ")
    dates = F.concat(F.element_at("l.date", 1), F.lit(" to "), F.element_at("l.date", -1))
    content = F.concat(F.lit("# #"), "channel", F.lit("\n\n"), F.array_join(messages, "\n"))
    return _documents(g, "chat", F.col("channel"), F.concat(F.lit("#"), F.col("channel")), content, metadata(participants=people, messages=F.size(messages).cast("string"), dates=dates))


READERS = {"wiki": wiki_blocks, "issues": issue_blocks, "code": change_blocks, "feedback": form_blocks, "chat": chat_blocks}


def structured(raw: DataFrame, provider: str) -> DataFrame:
    """One row an item in a common form (format, source, generated_from, slug, item), ready for a JSON writer."""
    d = READERS[provider](raw)
    slug = F.regexp_replace(F.regexp_replace(F.lower("source_id"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return d.select(F.lit("structured").alias("format"), "provider", F.lit("text export").alias("generated_from"), F.concat_ws("-", "provider", slug).alias("slug"), F.struct("source_id", "title", "content", "metadata").alias("item"))
