"""Reports as tables of lines, made where the data lie; only the text of lines that are shown leaves the cluster.

Every table has ``line`` and the columns ``ORDER`` that put its lines in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import textdiff
from palimpsest.functions.jobs import named
from palimpsest.functions.text import markdown_value, preview
from palimpsest.operators.diff import ranked, summary
from palimpsest.session import Scratch

ORDER = ("block", "kind", "place", "key", "n")


@dataclass(frozen=True)
class Form:
    """How the lines of a report of changes look."""

    title: str
    none: str
    head: tuple[str, ...]
    counts: str
    kind: tuple[str, ...]
    changed: str
    other: dict[str, str]
    field: str


# The forms of the lines, as format strings.
TEXT = Form(
    "%s -> %s", "no changes", ("", "kind                           added removed modified"), "%-28s %7d %7d %8d", ("", "== %s =="),
    "~ %s", {"added": "+ %s  %s", "removed": "- %s  %s"}, "    %s: %s",
)
MARKDOWN = Form(
    "# Changes: %s → %s", "No changes.", ("", "| Kind | Added | Removed | Modified |", "|---|---:|---:|---:|"), "| `%s` | %d | %d | %d |", ("", "## `%s`", ""),
    "- **changed** `%s`", {"added": "- **added** `%s` %s", "removed": "- **removed** `%s` %s"}, "  - `%s`: %s",
)
MORE = "  … %d more (use --limit 0 for all)"


def _said(col: Column) -> Column:
    """The text of a JSON text that is a string; null for other JSON."""
    return F.when(col.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), col, F.lit("}")), "v string")["v"])


def edited(old: Column, new: Column) -> Column:
    """Two JSON texts: the words that changed if both are strings much alike, else one after the other."""
    plain = F.concat(preview(old, 60), F.lit(" -> "), preview(new, 60))
    diff = textdiff.word_diff(_said(old), _said(new))
    line, first, alike = textdiff.marked(diff)
    return F.when(diff.isNotNull() & (alike >= textdiff.ALIKE), textdiff.around(line, first)).otherwise(plain)


def _rows(df: DataFrame, block: int, place: int, line: Column, kind: str | None = "kind", key: str | None = "key", n: Column | None = None) -> DataFrame:
    text = lambda c: F.col(c) if c else F.lit("")
    return df.select(F.lit(block).alias("block"), text(kind).alias("kind"), F.lit(place).alias("place"), text(key).alias("key"), (F.lit(0) if n is None else n).alias("n"), line.alias("line"))


def _several(df: DataFrame, block: int, place: int, lines: list[Column], kind: str | None = "kind") -> DataFrame:
    spread = df.select("*", F.posexplode(F.array(*lines)).alias("_n", "_line"))
    return _rows(spread, block, place, F.col("_line"), kind, None, F.col("_n"))


def changes(changed: DataFrame, old: str, new: str, limit: int = 50, form: Form = TEXT) -> DataFrame:
    """The lines of a report of ``diff.changes``: how many of each kind, then the changes, ``limit`` a kind (0: all)."""
    changed = Scratch(changed.sparkSession).save(changed.select("kind", "key", "status", "old_data", "new_data", "fields"), "changed")
    counts = summary(changed)
    some = counts.agg(F.count("*").alias("c"))
    heads = [F.lit(x) for x in form.head]
    title = F.lit(form.title % (old, new))
    out = _several(some, 0, 0, [title], None)
    out = out.unionByName(_several(some.where("c = 0"), 1, 0, [F.lit(form.none)], None)).unionByName(_several(some.where("c > 0"), 1, 0, heads, None))
    out = out.unionByName(_rows(counts, 2, 0, F.format_string(form.counts, "kind", "added", "removed", "modified"), key=None))
    shown = ranked(changed, "kind", limit)
    groups = counts.select("kind", (F.col("added") + F.col("removed") + F.col("modified")).alias("total"))
    out = out.unionByName(_several(groups, 3, 0, [F.format_string(x, "kind") if "%" in x else F.lit(x) for x in form.kind]))
    show = (lambda c: markdown_value(c)) if form is MARKDOWN else (lambda c: preview(c, 100))
    own = F.when(F.col("status") == "modified", F.format_string(form.changed, "key"))
    for status, data in (("added", "new_data"), ("removed", "old_data")):
        own = own.when(F.col("status") == status, F.format_string(form.other[status], F.col("key"), show(F.col(data))))
    out = out.unionByName(_rows(shown, 3, 1, own))
    fields = shown.where("status = 'modified'").select("kind", "key", F.posexplode("fields").alias("n", "f"))
    both = F.concat(markdown_value(F.col("f.old")), F.lit(" → "), markdown_value(F.col("f.new"))) if form is MARKDOWN else edited(F.col("f.old"), F.col("f.new"))
    out = out.unionByName(_rows(fields, 3, 1, F.format_string(form.field, F.col("f.path"), both), n=F.col("n") + 1))
    if limit:
        out = out.unionByName(_rows(groups.where(F.col("total") > limit), 3, 2, F.format_string(MORE, F.col("total") - limit), key=None))
    return out


def history(events: DataFrame, labels: DataFrame) -> DataFrame:
    """The lines of ``timeline.events`` with data and fields: a record's name, then its events in release order."""
    events = events.join(F.broadcast(labels.select("version_id", "label")), "version_id", "left")
    status = F.when(F.col("status") == "modified", "changed").otherwise(F.col("status"))
    told = F.size("fields") > 0
    head = F.format_string("  %-24s %-8s", "label", status)
    own = F.when(told, head).otherwise(F.concat(head, F.lit(" "), preview(F.col("data"), 90)))
    n = F.col("ord").cast("bigint") * (1 << 20)
    out = _rows(events.select("kind", "key").distinct(), 0, 0, F.concat_ws(" ", "kind", "key"), n=F.lit(0).cast("bigint"))
    out = out.unionByName(_rows(events, 0, 0, own, n=n))
    fields = events.select("kind", "key", "ord", F.posexplode("fields").alias("i", "f"))
    line = F.format_string("      %s: %s -> %s", F.col("f.path"), preview(F.col("f.old"), 50), preview(F.col("f.new"), 50))
    return out.unionByName(_rows(fields, 0, 0, line, n=n + F.col("i") + 1))


def hits(found: DataFrame, limit: int) -> DataFrame:
    """The lines of ``search.search``, and a last one if there are as many as were asked for."""
    pad = lambda c, size: F.format_string(f"%-{size}s", c)
    out = _rows(found, 0, 0, F.concat_ws(" ", pad("kind", 20), pad("key", 32), preview(F.col("data"), 80)))
    full = found.agg(F.count("*").alias("c")).where(F.col("c") == limit)
    return out.unionByName(_rows(full, 1, 0, F.lit(f"(showing first {limit}; use --limit for more)"), None, None))


def skill(skills: DataFrame) -> DataFrame:
    """The lines of skills of ``catalog.labelled``: name, job and needs, the description, then its levels by number."""
    rows = named(skills, "job").withColumnRenamed("id", "key").withColumn("kind", F.lit("skill"))
    needs = F.array_join(F.transform(F.array_sort(F.map_entries("req")), lambda e: F.concat(e["key"], F.lit(" at level "), e["value"].cast("string"))), ", ")
    parts = [
        F.array(F.format_string("%s (%s)  %s  max level %d", "label", "key", "job_name", "max_level")),
        F.when(F.size("req") > 0, F.array(F.concat(F.lit("requires "), needs))),
        F.when(F.col("invisible"), F.array(F.lit("hidden skill"))),
        F.when(F.col("desc").isNotNull(), F.concat(F.array(F.lit("")), F.split("desc", r"\\n"))),
        F.array(F.lit("")),
    ]
    head = F.flatten(F.array(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts)))
    out = _rows(rows.select("kind", "key", F.posexplode(head).alias("n", "line")), 0, 0, F.col("line"), n=F.col("n").cast("bigint"))
    level = rows.select("kind", "key", F.explode("levels").alias("lv", "stats")).where(F.col("lv").rlike("^[0-9]{1,9}$"))
    stats = F.filter(F.array_sort(F.map_entries("stats")), lambda e: e["key"] != "text")
    nums = F.array_join(F.transform(stats, lambda e: F.concat(e["key"], F.lit("="), preview(e["value"], 20))), " ")
    both = F.array_compact(F.array(F.format_string("%3s  %s", "lv", F.coalesce(_said(F.col("stats")["text"]), F.lit(""))), F.when(F.size(stats) > 0, F.concat(F.lit("     "), nums))))
    spread = level.select("kind", "key", F.col("lv").cast("bigint").alias("lv"), F.posexplode(both).alias("i", "line"))
    return out.unionByName(_rows(spread, 0, 1, F.col("line"), n=F.col("lv") * 2 + F.col("i")))


def stream(lines: DataFrame) -> Iterator[str]:
    """The text of the lines in order, one part of them at a time."""
    return (r.line for r in lines.orderBy(*ORDER).select("line").toLocalIterator())
