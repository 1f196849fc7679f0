"""The Parquet tables of a folder, and the dimensions read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import gather


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def release_order(versions: DataFrame) -> list[tuple[int, str | None]]:
    """(version_id, label) in release order: coalesce(build_time, imported_at), then version_id; versions without any
    time come last. The table of versions is a dimension: its size is checked before it is gathered."""
    at = F.coalesce(F.try_to_timestamp("build_time"), F.try_to_timestamp("imported_at"))
    rows = gather(versions.select("version_id", "label", at.cast("double").alias("at")))
    rows = [r for r in rows if r.version_id is not None]
    return [(r.version_id, r.label) for r in sorted(rows, key=lambda r: (r["at"] is None, r["at"] or 0.0, r.version_id))]


def releases(spark: SparkSession, versions: DataFrame) -> DataFrame:
    """version_id, label, ord (from 1) in release order; as many rows as the checked dimension has."""
    rows = [(v, label, i) for i, (v, label) in enumerate(release_order(versions), 1)]
    return spark.createDataFrame(rows, "version_id bigint, label string, ord int")
