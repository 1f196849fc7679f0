"""Schemas that drift between files: a column lifespan catalogue, and one consistent table read by it.

The catalogue holds, as a file's footer would, each path of a file with its type; it is small however large the files
are. Lag and islands per feed, path and type give lifespans, whose starts and endings are the changes. A path that
ends where another starts is a rename if their values agree; only files where both happen are read again for that.
The renames link lifespans to fields; the alias table made of them, by lifespan, gives the consistent table's names and casts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.jsontext import Unreadable, canonical, clean, read
from palimpsest.session import Scratch, broadcast_if_small, local_if_small, ship

#: Leaves sent on at once.
LEAVES = 50_000

_TYPES = {bool: "bool", int: "int", float: "float", str: "string", list: "list", type(None): "null"}


def leaves(value: dict) -> Iterator[tuple[str, Any]]:
    """(path, value) of every member that is not an object; a list is one value, an empty object has none."""
    todo = [(k, v) for k, v in reversed(value.items())]
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict):
            todo.extend((f"{path}/{k}", v) for k, v in reversed(x.items()))
        else:
            yield clean(path), x


def flatten(rows: DataFrame, values: bool = False) -> DataFrame:
    """feed, version_id, line_no, id (JSON text), path, type and, if ``values``, digest (16 bytes) and value (JSON text) of
    every leaf of the readable lines. Lines that are null, blank, broken or no object are left out."""
    ship(rows.sparkSession)
    names = ["feed", "version_id", "line_no"]
    extra = ["id", "path", "type", "value"]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            at: list[int] = []
            out: list[list] = [[] for _ in extra]

            def flush() -> pa.RecordBatch:
                take = pa.array(at, pa.int64())
                columns = [batch.column(i).take(take) for i in range(3)] + [pa.array(c, pa.string()) for c in out]
                return pa.RecordBatch.from_arrays(columns, names=[*names, *extra])

            payloads = batch.column(3)
            for i in range(batch.num_rows):
                try:
                    line = read(payloads[i].as_py())
                except Unreadable:
                    continue
                if not isinstance(line, dict):
                    continue
                key = canonical(line.get("id"))
                for path, x in leaves(line):
                    at.append(i)
                    for c, v in zip(out, (key, path, _TYPES[type(x)], canonical(x) if values else None)):
                        c.append(v)
                    if len(at) >= LEAVES:
                        yield flush()
                        at, out = [], [[] for _ in extra]
            if at:
                yield flush()

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{n} {types[n]}" for n in names) + ", " + ", ".join(f"{n} string" for n in extra)
    flat = rows.select(*names, "payload").mapInArrow(batches, schema)
    return flat if values else flat.drop("value")


def types(flat: DataFrame, releases: DataFrame) -> DataFrame:
    """(feed, version_id, path, type, n, ord): how many values of which type each file has."""
    order = broadcast_if_small(releases.select("version_id", "ord"))
    return flat.groupBy("feed", "version_id", "path", "type").agg(F.count("*").alias("n")).join(order, "version_id")


def catalogue(types: DataFrame) -> DataFrame:
    """(feed, version_id, path, type, ord): what each file has. A path's type in a file is that of most of its values, the
    first by name among equals; 'null' if all are null."""
    best = F.max(F.struct((F.col("type") != "null").alias("real"), "n", F.expr("-ascii(type)"), "type"))["type"]
    return types.groupBy("feed", "version_id", "path", "ord").agg(best.alias("type"))


def lifespans(catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalogue's lifespans (feed, path, type, born, died: place of the first file and of the last) and the files
    (feed, version_id, place from 1, files of the feed)."""
    by_feed = Window.partitionBy("feed")
    files = catalogue.select("feed", "version_id", "ord").distinct()
    files = files.select(
        "feed", "version_id", F.row_number().over(by_feed.orderBy("ord")).alias("place"), F.count("*").over(by_feed).alias("files")
    )
    at = catalogue.join(files, ["feed", "version_id"]).select("feed", "path", "type", "place")
    w = Window.partitionBy("feed", "path", "type").orderBy("place")
    gap = F.when(F.col("place") - F.lag("place").over(w) == 1, 0).otherwise(1)
    numbered = at.withColumn("gap", gap).withColumn("island", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("feed", "path", "type", "island").agg(F.min("place").alias("born"), F.max("place").alias("died"))
    return spans.drop("island"), files


def field_changes(rows: DataFrame, releases: DataFrame) -> DataFrame:
    """(feed, version_id, change, path, new_path): every path that a file adds, removes, renames or retypes against the
    feed's file before it in release order; new_path is '' but for renamed.

    ``rows``: feed, version_id, line_no, payload (JSON objects with a member id); other columns are not read. A path is
    the member names joined by ``/`` down to a value that is no object; a file has it if a readable line does, even
    as null. Renamed: one path goes, another comes, and wherever both files hold the id and neither value is null the
    values are equal, at least once (lines without id aside); of several candidates those sharing most values pair up, ties by name. Where an
    id repeats in a file its last line counts. Retyped: the type among int, float, string, bool and list differs;
    a file where all are null has none. Lines of a null feed or of a version that releases lack are left out, and
    a file without readable line is no file. Empty tables give an empty result.
    """
    return _changes(rows.where("feed is not null"), releases, Scratch(rows.sparkSession))[0]


def _changes(rows: DataFrame, releases: DataFrame, scratch: Scratch) -> tuple[DataFrame, ...]:
    """The changes, and the tables they are made of: ``types``, files and renames."""
    held = scratch.save(types(flatten(rows), releases), "types")  # the first reading of the lines
    spans, files = lifespans(catalogue(held))
    spans, files = scratch.save(spans, "spans"), scratch.save(files, "files")

    starts = spans.where("born > 1").select("feed", "path", "type", F.col("born").alias("place"), F.lit(True).alias("start"))
    ends = spans.join(files.select("feed", "files").distinct(), "feed").where("died < files")
    ends = ends.select("feed", "path", "type", (F.col("died") + 1).alias("place"), F.lit(False).alias("start"))
    pick = lambda c: F.max(F.when(c, F.col("type")))
    log = starts.unionByName(ends).groupBy("feed", "path", "place").agg(pick(F.col("start")).alias("came"), pick(~F.col("start")).alias("went"))
    log = scratch.save(log, "log")
    added, removed = log.where("went is null"), log.where("came is null")
    retyped = log.where("came <> 'null' and went <> 'null'").select("feed", "place", F.lit("retyped").alias("change"), "path", F.lit("").alias("new_path"))

    renames = scratch.save(_renames(rows, files, added, removed, scratch), "renames")
    old = removed.join(renames, ["feed", "place", "path"], "left_anti").select("feed", "place", F.lit("removed").alias("change"), "path", F.lit("").alias("new_path"))
    new = added.join(renames.select("feed", "place", F.col("new_path").alias("path")), ["feed", "place", "path"], "left_anti")
    new = new.select("feed", "place", F.lit("added").alias("change"), "path", F.lit("").alias("new_path"))
    both = renames.select("feed", "place", F.lit("renamed").alias("change"), "path", "new_path")
    every = retyped.unionByName(old).unionByName(new).unionByName(both)
    return every.join(files.drop("files"), ["feed", "place"]).select("feed", "version_id", "change", "path", "new_path"), held, files, renames


def _renames(rows: DataFrame, files: DataFrame, added: DataFrame, removed: DataFrame, scratch: Scratch) -> DataFrame:
    """(feed, place, path, new_path). Values meet by feed, place, id and value, so no pair is formed that does not agree
    somewhere; only pairs that do are then checked for an id where they disagree."""
    went = removed.select("feed", "place", "path")
    came = added.select("feed", "place", F.col("path").alias("new_path"))
    turning = went.select("feed", "place").distinct().join(came, ["feed", "place"], "left_semi")
    places = turning.join(files, ["feed", "place"]).select("feed", "version_id")
    before = turning.select("feed", (F.col("place") - 1).alias("place")).join(files, ["feed", "place"]).select("feed", "version_id")
    both = came.withColumnRenamed("new_path", "path").join(turning.select("feed", "place").distinct(), ["feed", "place"], "left_semi")
    leaving = went.join(turning.select("feed", "place").distinct(), ["feed", "place"], "left_semi").select("feed", (F.col("place") - 1).alias("place"), "path")
    wanted = both.unionByName(leaving).distinct()
    flat = flatten(rows.join(places.unionByName(before).distinct(), ["feed", "version_id"], "left_semi"), values=True)
    flat = flat.where("type <> 'null' and id <> 'null'").join(files.drop("files"), ["feed", "version_id"]).join(wanted, ["feed", "place", "path"], "left_semi")

    # The values of paths that go or come, and no others, are kept: the second and last reading of the lines.
    last = flat.select("feed", "place", "path", "id", "line_no", F.unhex(F.md5("value")).alias("v"))
    last = last.groupBy("feed", "place", "path", "id").agg(F.max(F.struct("line_no", "v"))["v"].alias("v"))
    last = scratch.save(last, "values")
    old = last.select("feed", (F.col("place") + 1).alias("place"), "path", "id", "v").join(went, ["feed", "place", "path"], "left_semi")
    new = last.withColumnRenamed("path", "new_path").join(came, ["feed", "place", "new_path"], "left_semi")
    agree = old.join(new, ["feed", "place", "id", "v"]).groupBy("feed", "place", "path", "new_path").agg(F.count("*").alias("equal"))
    agree = local_if_small(agree)  # as small as the catalogue
    # The ids that both hold meet by id, so that no task gets all values of a large feed.
    pairs = old.drop("v").join(agree, ["feed", "place", "path"]).join(new.drop("v"), ["feed", "place", "id", "new_path"])
    whole = pairs.groupBy("feed", "place", "path", "new_path", "equal").agg(F.count("*").alias("met")).where("met = equal")
    best = lambda key, other: F.row_number().over(Window.partitionBy("feed", "place", key).orderBy(F.desc("equal"), other))
    ranked = whole.withColumn("r", best("path", "new_path")).withColumn("s", best("new_path", "path"))
    return ranked.where("r = 1 and s = 1").select("feed", "place", "path", "new_path")


def aliases(types: DataFrame, files: DataFrame, renames: DataFrame) -> DataFrame:
    """(feed, version_id, path, name): under which one name the path of a file is read.

    A field lives on from file to file under its path, and by a rename under the new one; it is called as in its last
    file. A path that comes again after it went is another field, which may share a name with the first unless their
    files overlap: then all but the last of them are called name@version_id of their last file. All tables here are as
    small as the catalogue."""
    there = types.select("feed", "version_id", "path").distinct().join(files, ["feed", "version_id"])
    w = Window.partitionBy("feed", "path").orderBy("place")
    at = there.withColumn("gap", F.when(F.col("place") - F.lag("place").over(w) == 1, 0).otherwise(1))
    at = at.withColumn("island", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = at.groupBy("feed", "path", "island").agg(F.min("place").alias("born"), F.max("place").alias("died"))
    into = spans.select("feed", F.col("path").alias("new_path"), F.col("born").alias("place"), F.col("died").alias("until"))
    moves = renames.join(into, ["feed", "new_path", "place"]).groupBy("feed")
    moves = moves.agg(F.sort_array(F.collect_list(F.struct("place", "path", "new_path", "until"))).alias("moves"))
    none = "array<struct<place:int,path:string,new_path:string,until:int>>"
    spans = spans.join(moves, "feed", "left").withColumn("moves", F.coalesce("moves", F.array().cast(none)))
    goes = lambda at, m: (m["path"] == at["name"]) & (m["place"] == at["end"] + 1)
    step = lambda at, m: F.when(goes(at, m), F.struct(m["new_path"].alias("name"), m["until"].alias("end"))).otherwise(at)
    last = F.aggregate("moves", F.struct(F.col("path").alias("name"), F.col("died").alias("end")), step)
    spans = spans.select("feed", "path", "island", "born", last.alias("last")).select("feed", "path", "island", "born", "last.*")
    fields = spans.groupBy("feed", "name", "end").agg(F.min("born").alias("begin"))
    same = Window.partitionBy("feed", "name").orderBy("end")
    fields = fields.withColumn("clash", F.col("begin") <= F.lag("end").over(same))
    every = Window.partitionBy("feed", "name")
    fields = fields.withColumn("clash", F.max(F.coalesce("clash", F.lit(False))).over(every) & (F.col("end") < F.max("end").over(every)))
    ends = files.select("feed", F.col("place").alias("end"), F.col("version_id").alias("v"))
    fields = fields.join(ends, ["feed", "end"]).select("feed", "name", "end", F.when(F.col("clash"), F.concat("name", F.lit("@"), "v")).otherwise(F.col("name")).alias("as"))
    called = spans.join(fields, ["feed", "name", "end"]).select("feed", "path", "island", F.col("as").alias("name"))
    return at.select("feed", "version_id", "path", "island").join(called, ["feed", "path", "island"]).drop("island")


def consistent(rows: DataFrame, releases: DataFrame) -> DataFrame:
    """All readable lines of all files as one table: feed, version_id, line_no, id, name, type, value, and value as as_int,
    as_float and as_bool where the type is int, float (or int) or bool.

    name is as in ``aliases`` and type the narrowest that holds all the name's values in the feed: int, float (of
    int and float), else string; value is cast to it as text (numbers of a float column with a fraction, strings
    bare). Nulls keep their row. ``typed`` lays one feed out as columns. Lines of a version that releases lack are left
    out, as in ``field_changes``.
    """
    scratch = Scratch(rows.sparkSession)
    rows = rows.where("feed is not null")
    _, held, files, renames = _changes(rows, releases, scratch)
    names = aliases(held, files, renames)
    kinds = held.where("type <> 'null'").join(names, ["feed", "version_id", "path"]).groupBy("feed", "name").agg(F.sort_array(F.collect_set("type")).alias("kinds"))
    wide = F.when(F.size("kinds") == 1, F.col("kinds")[0]).when(F.array_join("kinds", ",") == "float,int", "float").otherwise("string")
    names = names.join(kinds.select("feed", "name", wide.alias("as")), ["feed", "name"], "left").withColumn("as", F.coalesce("as", F.lit("null")))
    names = scratch.save(names, "names")
    flat = flatten(rows, values=True).join(broadcast_if_small(names), ["feed", "version_id", "path"])
    bare = F.when(F.col("type") == "string", F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"]).otherwise(F.col("value"))
    cast = F.when(F.col("type") == "null", None).when((F.col("as") == "float") & (F.col("type") == "int"), F.concat("value", F.lit(".0"))).otherwise(bare)
    out = flat.select("feed", "version_id", "line_no", "id", "name", F.col("as").alias("type"), cast.alias("value"))
    to = lambda name, kinds, sql: F.when(F.col("type").isin(*kinds), F.col("value").try_cast(sql)).alias(name)
    return out.select("*", to("as_int", ["int"], "bigint"), to("as_float", ["int", "float"], "double"), to("as_bool", ["bool"], "boolean"))


def typed(table: DataFrame, feed: str) -> DataFrame:
    """The consistent table of one feed with a typed column for each of its names."""
    here = table.where(F.col("feed") == feed).withColumn("name", F.when(F.col("name").isin("feed", "version_id", "line_no"), F.concat("name", F.lit("_"))).otherwise(F.col("name")))
    names = sorted((r.name, r.type) for r in here.select("name", "type").distinct().collect())
    to = {"int": "bigint", "float": "double", "bool": "boolean"}
    wide = here.groupBy("feed", "version_id", "line_no").pivot("name", [n for n, _ in names]).agg(F.first("value", ignorenulls=True))
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    keys = ("feed", "version_id", "line_no")
    return wide.select(*keys, *(quoted(n).try_cast(to.get(t, "string")).alias(n) for n, t in names))
