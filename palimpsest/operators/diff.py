"""What changed between any two versions, down to fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.canon import is_text, json_fields
from palimpsest.functions.text import kind_is, ranges
from palimpsest.session import Scratch, ship

STATUSES = ("added", "removed", "modified")


def attach(df: DataFrame, blobs: DataFrame, hash_: str, name: str) -> DataFrame:
    """``df`` with the payload of its blob hash as ``name``; null where there is none. Join sizes are left to Spark."""
    b = blobs.select(F.col("hash").alias("_h"), F.col("data").alias(name))
    return df.join(b, F.col(hash_) == F.col("_h"), "left").drop("_h")


def diff(records: DataFrame, old: int, new: int, kind: str | None = None) -> DataFrame:
    """(kind, key, status, old_hash, new_hash, old_blob, new_blob) of the records that differ between two versions.

    ``records`` has one row per version, kind and key. One full join on (kind, key); filters on versions and kind reach
    both scans. Hashes compare null-safe: null differs from any hash but null.
    """
    def side(v: int, p: str) -> DataFrame:
        rows = records.where((F.col("version_id") == v) & kind_is(F.col("kind"), kind))
        return rows.select("kind", "key", F.lit(True).alias(f"{p}_there"), F.col("hash").alias(f"{p}_hash"), F.col("blob_hash").alias(f"{p}_blob"))

    both = side(old, "old").join(side(new, "new"), ["kind", "key"], "full")
    changed = both.where(F.col("old_there").isNull() | F.col("new_there").isNull() | ~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    status = F.when(F.col("old_there").isNull(), "added").when(F.col("new_there").isNull(), "removed").otherwise("modified")
    return changed.select("kind", "key", status.alias("status"), "old_hash", "new_hash", "old_blob", "new_blob")


def diff_in_halves(records: DataFrame, old: int, new: int) -> DataFrame:
    """``diff`` as a left join and what only the new version has, put together; the same rows."""
    a = records.where(F.col("version_id") == old).select("kind", "key", F.col("hash").alias("old_hash"))
    b = records.where(F.col("version_id") == new).select("kind", "key", F.col("hash").alias("new_hash"), F.lit(True).alias("there"))
    first = a.join(b, ["kind", "key"], "left").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")) | F.col("there").isNull())
    first = first.select("kind", "key", F.when(F.col("there").isNull(), "removed").otherwise("modified").alias("status"))
    second = b.join(a, ["kind", "key"], "left_anti").select("kind", "key", F.lit("added").alias("status"))
    return first.unionByName(second)


def changes(records: DataFrame, blobs: DataFrame, old: int, new: int, kind: str | None = None) -> DataFrame:
    """``diff`` with the payloads of changed records (old_data, new_data) and the fields in which they differ. Payloads
    are joined to what changed only; fields are empty unless both are there."""
    ship(records.sparkSession)
    d = attach(attach(diff(records, old, new, kind), blobs, "old_blob", "old_data"), blobs, "new_blob", "new_data")
    return d.withColumn("fields", json_fields("old_data", "new_data"))


def is_text_only(fields: str = "fields", status: str = "status") -> Column:
    """Whether a change is a modification in nothing but texts. One without fields is not; a text that comes or goes is."""
    return (F.col(status) == "modified") & (F.size(fields) > 0) & F.forall(fields, lambda f: is_text(f["old"]) & is_text(f["new"]))


def field_rows(changed: DataFrame) -> DataFrame:
    """(kind, key, path, old, new): one row per field that differs."""
    return changed.select("kind", "key", F.explode("fields").alias("f")).select("kind", "key", "f.path", "f.old", "f.new")


def summary(changed: DataFrame, by: str = "kind") -> DataFrame:
    """Added, removed and modified per kind."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return changed.groupBy(by).agg(*(count(s) for s in STATUSES))


#: Changes of a kind that a list of them holds, unless another number is given.
LISTED = 1000


def by_kind(changed: DataFrame, most: int = LISTED) -> DataFrame:
    """kind, total, changes: how many changes a kind has, and the first ``most`` of them in key order."""
    lists = top_per(changed.select("kind", "key", "status"), "kind", max(1, most)).groupBy("kind", "total")
    return lists.agg(F.sort_array(F.collect_list(F.struct("key", "status"))).alias("changes"))


def top_per(changed: DataFrame, by: str, most: int) -> DataFrame:
    """The first ``most`` rows by key of every group, with their rank and the number of rows the group has in all; 0: all
    rows, whose rank is null, since no group of any size is put into one task."""
    changed = Scratch(changed.sparkSession).save(changed, "changed")  # it is read twice
    return ranked(changed, by, most).join(changed.groupBy(by).agg(F.count("*").alias("total")), by)


def ranked(changed: DataFrame, by: str, most: int) -> DataFrame:
    """The first ``most`` rows by key of every group, with their rank; 0: all rows, whose rank is null."""
    if not most:
        return changed.withColumn("rank", F.lit(None).cast("int"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("key", *(["kind"] if by != "kind" else [])))
    return changed.withColumn("rank", place).where(F.col("rank") <= most)


def has_status(statuses: list[str]) -> Column:
    """Whether a change has one of the statuses; names that are none count for nothing, and without any all pass."""
    known = [s for s in statuses if s in STATUSES]
    return F.col("status").isin(known) if known else F.lit(True)


def chip_counts(changed: DataFrame, facets: Column, statuses: list[str], hide_text: bool = False) -> DataFrame:
    """raw, text_only, added, removed, modified, shown of changes with facets and fields, in one pass: how many raw ones there
    are in all; of those that pass ``facets`` the ones in texts alone (with a chosen status), of each status (whichever
    are chosen), and those that are shown."""
    text, status = is_text_only(), has_status(statuses)
    seen = ~text if hide_text else F.lit(True)
    each = (F.count_if(facets & (F.col("status") == s) & seen).alias(s) for s in STATUSES)
    return changed.agg(F.count_if(F.col("detail") == "raw").alias("raw"), F.count_if(facets & text & status).alias("text_only"), *each, F.count_if(facets & status & seen).alias("shown"))


def title(new: Column, old: Column) -> Column:
    """What a record is called: its first text among name, mapName, streetName, bookName, of the new payload if there is one."""
    data = F.coalesce(new, old)
    raw = F.from_json(data, "map<string,string>")
    quoted = lambda n: F.when(data.rlike(r'"' + n + r'"\s*:\s*"'), raw[n])
    return F.coalesce(*(quoted(n) for n in ("name", "mapName", "streetName", "bookName")))


def grouped_fields(rows: DataFrame) -> DataFrame:
    """(kind, key, field, levels, n, path, old, new): changes of one field over several levels (``levels/<n>/<field>``) as
    one row with the levels they touch and the change of the lowest; other fields as they are."""
    level = F.regexp_extract("path", r"^levels/\+?([0-9]{1,9})/(.*)$", 1)
    field = F.regexp_extract("path", r"^levels/\+?([0-9]{1,9})/(.*)$", 2)
    leveled = rows.select("*", F.when(level != "", level.cast("int")).alias("level"), F.when(level != "", field).otherwise(F.col("path")).alias("field"))
    first = F.min_by(F.struct("path", "old", "new"), F.coalesce("level", F.lit(-1)))
    g = leveled.groupBy("kind", "key", "field", F.col("level").isNotNull().alias("leveled")).agg(
        F.array_sort(F.collect_set("level")).alias("levels"), F.count("*").alias("n"), first.alias("first")
    )
    return g.select("kind", "key", "field", "levels", "n", "first.path", "first.old", "first.new")


def field_table(rows: DataFrame) -> DataFrame:
    """(kind, key, label, levels, old, new): the rows a table of changed fields shows. A field that changes on three levels or
    more is one row, called by its levels and showing the change of the lowest; on fewer, each level is a row."""
    parts = [F.regexp_extract("path", r"^levels/\+?([0-9]{1,9})/(.*)$", i) for i in (1, 2)]
    told = rows.withColumn("level", F.when(parts[0] != "", parts[0].cast("int"))).withColumn("field", F.when(parts[0] != "", parts[1]).otherwise(F.col("path")))
    groups = told.where("level is not null").groupBy("kind", "key", "field").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("level")).alias("all"), F.min_by(F.struct("old", "new"), "level").alias("first"))
    many = groups.where("n >= 3")
    label = F.format_string("Lv %s · %s (%d levels)", ranges(F.col("all")), F.col("field"), F.col("n"))
    out = many.select("kind", "key", label.alias("label"), F.col("all").alias("levels"), "first.old", "first.new")
    few = told.where("level is not null").join(groups.where("n < 3").select("kind", "key", "field"), ["kind", "key", "field"], "left_semi")
    few = few.select("kind", "key", F.format_string("Lv %d · %s", "level", "field").alias("label"), F.array("level").alias("levels"), "old", "new")
    rest = told.where("level is null").select("kind", "key", F.col("path").alias("label"), F.array().cast("array<int>").alias("levels"), "old", "new")
    return out.unionByName(few).unionByName(rest)


def card(changed: DataFrame, old: int, new: int) -> DataFrame:
    """kind, key, status, side and data: in which version a change is looked at, the old one if the record was removed there, and
    its payload in it."""
    gone = F.col("status") == "removed"
    return changed.select("kind", "key", "status", F.when(gone, old).otherwise(new).alias("side"), F.when(gone, F.col("old_data")).otherwise(F.col("new_data")).alias("data"))
