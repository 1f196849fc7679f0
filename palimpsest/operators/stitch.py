"""Attribute-value rows into a wide table, by positional stitching.

Cells are first reduced to one row each with a state of fixed size, so an entity or attribute that holds most rows
costs no task more than its share. Entities then get global ordinals (a range sort, and the offset of each sorted
partition); ordinals fall into blocks of fixed length, and within a block every attribute is written as one typed
column aligned to the positions, so the wide rows are the columns laid side by side.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.session import Scratch, blank_trim, gather, ship

#: Entities of one block at most, and its cells: bounds what a stitching task holds at once.
BLOCK, CELLS = 4096, 1_000_000

#: Spark's type for each type of the catalogue.
TYPES = {"int": T.DecimalType(38, 0), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}


def letters(col: Column) -> Column:
    """A name by its letters and digits, without case."""
    return F.lower(F.regexp_replace(col, r"[^\p{L}\p{N}]", ""))


def reading(value: Column, kind: Column) -> Column:
    """The value in the one spelling of its type (null: it can't be read). Numbers are equal however written: in an
    int a comma before three digits groups thousands and a zero fraction is allowed; in a double a comma is the
    decimal sign."""
    v = blank_trim(value)
    whole = F.regexp_replace(v, r",(?=\d{3}(?!\d))", "")
    plain = whole.rlike(r"^[+-]?\d+(\.0*)?$")
    as_int = F.when(plain, F.regexp_replace(whole, r"\.0*$", "").try_cast("decimal(38,0)"))
    exponent = whole.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d{1,3}$")
    spread = whole.try_cast("double")
    as_int = F.coalesce(as_int, F.when(exponent & (spread == F.floor(spread)), spread.try_cast("decimal(38,0)")))
    point = F.replace(v, F.lit(","), F.lit("."))
    number = point.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    as_double = F.when(number, point.try_cast("double"))
    as_double = F.when(as_double == 0, F.lit(0.0)).when(F.abs(as_double) < float("inf"), as_double)
    low = F.lower(v)
    as_bool = F.when(low.isin("true", "yes", "1"), "true").when(low.isin("false", "no", "0"), "false")
    return (
        F.when(kind == "int", as_int.cast("string"))
        .when(kind == "double", as_double.cast("string"))
        .when(kind == "boolean", as_bool)
        .otherwise(v)
    )


def cells(rows: DataFrame, entity: list[str], attribute: str, value: str, catalog: list[tuple[str, str]]) -> DataFrame:
    """One row per entity and attribute of the catalogue: ``attr`` (its place in the catalogue; -1 for rows that only
    name the entity), ``low`` and ``high`` (least and greatest reading) and ``bad`` (a non-empty value is unreadable)."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(i, _fold(n), t) for i, (n, t) in enumerate(catalog)], "attr int, folded string, type string")
    read = rows.select(*entity, letters(F.col(attribute)).alias("folded"), F.col(value).alias("value"))
    read = read.join(F.broadcast(known), "folded", "left")
    filled = F.length(blank_trim(F.col("value"))) > 0
    read = read.select(
        *entity,
        F.when(filled & F.col("attr").isNotNull(), F.col("attr")).otherwise(-1).alias("attr"),
        F.when(filled, reading(F.col("value"), F.col("type"))).alias("r"),
    )
    return read.groupBy(*entity, "attr").agg(
        F.min("r").alias("low"),
        F.max("r").alias("high"),
        F.coalesce(F.bool_or(F.col("r").isNull() & (F.col("attr") >= 0)), F.lit(False)).alias("bad"),
    )


def _fold(name: str) -> str:
    return "".join(c for c in name if c.isalnum()).lower()


def ordinals(entities: DataFrame, entity: list[str], scratch: Scratch) -> DataFrame:
    """The distinct ``entities`` with a dense global ``ordinal`` from 0 in the order of ``entity``."""
    spark = entities.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = entities.select(*entity).distinct().repartitionByRange(parts, *entity).sortWithinPartitions(*entity)
    placed = scratch.save(placed.withColumn("_at", F.monotonically_increasing_id()), "entities")
    part = F.shiftright("_at", 33)
    sizes = gather(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part"))
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r.part, total))
        total += r.n
    table = spark.createDataFrame(offsets, "_part bigint, _offset bigint")
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(table), "_part")
        .select(*entity, (F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("ordinal"))
    )


def wide(rows: DataFrame, entity: list[str], attribute: str, value: str, catalog: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per entity: its key columns, a column per attribute of ``catalog`` (``stat_name``, ``value_type``: int,
    double, boolean or string) in that type, ``conflicts`` (the attributes whose non-empty values do not all read
    as one and the same value) and ``ordinal``.

    Names compare by letters and digits without case. Blank values are empty, and so is a cell without readable
    value; a cell in conflict is null. Attributes that are not in the catalogue are left out, entities that have no
    other stay with nulls, and rows with a null in the key have no entity. An int beyond 38 digits is unreadable.
    Repeated rows change nothing. A catalogue name that clashes with a key column gets ``_`` behind it.
    """
    spark = rows.sparkSession
    ship(spark)
    listed: dict[str, tuple[str, str]] = {}
    for r in sorted(gather(catalog.select("stat_name", "value_type")), key=lambda r: str(r.stat_name)):
        if r.stat_name is not None and _fold(r.stat_name):
            kind = (r.value_type or "string").strip().lower()
            listed.setdefault(_fold(r.stat_name), (r.stat_name, kind if kind in TYPES else "string"))
    names = list(listed.values())
    block = max(1, min(block, CELLS // max(1, len(names))))
    scratch = Scratch(spark)
    rows = rows.where(" and ".join(f"`{c}` is not null" for c in entity))
    cell = scratch.save(cells(rows, entity, attribute, value, names), "cells")
    placed = ordinals(cell, entity, scratch)
    taken = {*entity, "conflicts", "ordinal"}
    heads = [n + "_" if n in taken else n for n, _ in names]
    pieces = cell.join(placed, entity).select(
        (F.col("ordinal") / block).cast("bigint").alias("block"),
        (F.col("ordinal") % block).cast("int").alias("pos"),
        *(F.when(F.col("attr") == -1, None).otherwise(F.col(c)).alias(c) for c in ("low",)),
        "attr",
        (F.col("bad") | (F.col("low") != F.col("high"))).alias("clash"),
        *entity,
    )
    keys = [T.StructField(c, rows.schema[c].dataType) for c in entity]
    fields = [T.StructField(h, TYPES[t]) for h, (_, t) in zip(heads, names)]
    schema = T.StructType([*keys, T.StructField("ordinal", T.LongType()), *fields, T.StructField("conflicts", T.ArrayType(T.StringType()))])
    stitch = _stitcher(entity, names, heads, block)
    return pieces.groupBy("block").applyInArrow(stitch, schema)


def _stitcher(entity: list[str], names: list[tuple[str, str]], heads: list[str], block: int):
    kinds = {"int": pa.decimal128(38, 0), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}

    def typed(kind: str, texts: pa.Array) -> pa.Array:
        try:
            return texts if kind == "string" else texts.cast(kinds[kind])
        except pa.ArrowInvalid:  # a form of a double that only Python reads
            return pa.array([None if x is None else float(x) for x in texts.to_pylist()], kinds[kind])

    def stitch(table: pa.Table) -> pa.Table:
        pos, attr = table["pos"].to_numpy(), table["attr"].to_numpy()
        size = int(pos.max()) + 1
        first = np.zeros(size, np.int64)
        first[pos[::-1]] = np.arange(len(pos))[::-1]
        out = {c: table[c].take(pa.array(first)) for c in entity}
        base = table["block"][0].as_py() * block
        out["ordinal"] = pa.array(np.arange(base, base + size))
        low = table["low"].cast(pa.string()).combine_chunks()
        clash = (attr >= 0) & table["clash"].fill_null(False).to_numpy(zero_copy_only=False)
        # Each attribute's values go to their positions at once; the positions without one are null.
        order = np.argsort(np.where(clash, -1, attr), kind="stable")
        starts = np.searchsorted(np.where(clash, -1, attr)[order], np.arange(len(names) + 1))
        for a, (head, (_, kind)) in enumerate(zip(heads, names)):
            rows = order[starts[a] : starts[a + 1]]
            at = np.full(size, -1)
            at[pos[rows]] = rows
            out[head] = typed(kind, low.take(pa.array(at, mask=at < 0)))
        conflicts: list[list[str]] = [[] for _ in range(size)]
        for i in np.flatnonzero(clash).tolist():
            conflicts[pos[i]].append(names[attr[i]][0])
        out["conflicts"] = pa.array([sorted(x) for x in conflicts], pa.list_(pa.string()))
        return pa.table(out)

    return stitch


def conflicts(table: DataFrame, entity: list[str]) -> DataFrame:
    """(entity, stat_name): the cells of a ``wide`` table that have no one value."""
    return table.select(*entity, F.explode("conflicts").alias("stat_name"))


def melt(table: DataFrame, entity: list[str]) -> DataFrame:
    """A ``wide`` table back as (entity, attribute, value) rows, without its empty cells."""
    rest = [c for c in table.columns if c not in {*entity, "conflicts", "ordinal"}]
    pairs = F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in rest))
    return table.select(*entity, F.explode(pairs).alias("p")).select(*entity, "p.*").where("value is not null")
