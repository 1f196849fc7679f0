"""Search, pages and natural order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import escape_like, key_is, kind_is, like, natural_order
from palimpsest.operators.diff import attach

PAGE = 200


def search(records: DataFrame, blobs: DataFrame, version_id: int, text: str, kind: str | None = None, most: int | None = None) -> DataFrame:
    """(kind, key, hash, data, name) of a version's records whose key or JSON text holds ``text`` without regard to ASCII case.
    ``most`` keeps the first so many by kind and key; 0 keeps none, None all."""
    rows = records.where((F.col("version_id") == version_id) & kind_is(F.col("kind"), kind))
    pattern = f"%{escape_like(text)}%"
    # Every payload is looked at once, whatever the number of its records; only those of hits are attached.
    told = blobs.where(like(F.col("data"), pattern)).select(F.col("hash").alias("blob_hash"), F.lit(True).alias("told"))
    hits = rows.join(told, "blob_hash", "left").where(like(F.col("key"), pattern) | F.col("told"))
    hits = hits.select("kind", "key", "hash", "blob_hash")
    shown = attach(hits if most is None else hits.orderBy("kind", "key").limit(most), blobs, "blob_hash", "data")
    return shown.select("kind", "key", "hash", "data", name(F.col("data")).alias("name"))


def name(data: Column) -> Column:
    """What a hit is called: its text ``name``, or else ``mapName``."""
    raw = F.from_json(data, "map<string,string>")
    return F.coalesce(*(F.when(data.rlike(r'"' + n + r'"\s*:\s*"'), raw[n]) for n in ("name", "mapName")))


def with_key(records: DataFrame, key: str) -> DataFrame:
    """Records of that key, or whose key ends with it as a path."""
    return records.where(key_is(F.col("key"), key))


def page(df: DataFrame, number: int, by: list[str] | str = "key", size: int = PAGE) -> DataFrame:
    """Page ``number`` (from 0) in natural order of ``by``; of several columns the first in natural order."""
    first, *rest = [by] if isinstance(by, str) else by
    return df.orderBy(*natural_order(F.col(first)), *rest).offset(number * size).limit(size)


def pages(df: DataFrame, size: int = PAGE) -> DataFrame:
    """rows, pages."""
    return df.agg(F.count("*").alias("rows"), F.ceil(F.count("*") / size).alias("pages"))
