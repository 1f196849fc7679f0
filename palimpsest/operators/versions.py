"""Release order and what is chosen by it. Versions are a dimension whose size is checked before it is gathered."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.tables import release_order

RESERVED = ("latest", "previous", "baseline")


def release_time() -> Column:
    """When a version was built, or else imported."""
    return F.coalesce(F.try_to_timestamp("build_time"), F.try_to_timestamp("imported_at"))


def ordered(versions: DataFrame) -> DataFrame:
    """The versions with place (from 1) and previous version in release order."""
    w = Window.partitionBy(F.lit(1)).orderBy(release_time().asc_nulls_last(), "version_id")  # a dimension: one task is enough
    return versions.withColumn("place", F.row_number().over(w)).withColumn("previous_id", F.lag("version_id").over(w))


def newest_first(versions: DataFrame) -> DataFrame:
    """version_id, label, channel, rank (from 1, the last release first)."""
    at = ordered(versions)
    last = Window.partitionBy(F.lit(1))
    return at.select("version_id", "label", "channel", (F.max("place").over(last) - F.col("place") + 1).alias("rank"))


def is_label(col: Column) -> Column:
    """Whether a text can name a version, as ``validate_label`` has it."""
    return F.coalesce(col.rlike(r"^[A-Za-z0-9_-][A-Za-z0-9._-]*$") & ~col.isin(*RESERVED) & ~col.contains("\n"), F.lit(False))


def previous(versions: DataFrame, version_id: int) -> int | None:
    """The version released just before."""
    ids = [v for v, _ in release_order(versions)]
    return ids[ids.index(version_id) - 1] if version_id in ids[1:] else None


def diff_base(versions: DataFrame, version_id: int, baseline: str | None) -> int | None:
    """What a version is compared with: the baseline if it was released before, else the version just before."""
    order = release_order(versions)
    ids = [v for v, _ in order]
    base = next((i for i, (_, name) in enumerate(order) if name == baseline and baseline is not None), None)
    if base is not None and version_id in ids and base < ids.index(version_id):
        return ids[base]
    return previous(versions, version_id)


def diff_bases(versions: DataFrame, baseline: str | None = None) -> DataFrame:
    """version_id, base_id: ``diff_base`` of every version."""
    at = ordered(versions)
    mark = at.where(F.col("label") == F.lit(baseline)).select(F.col("version_id").alias("b"), F.col("place").alias("b_place")).limit(1)
    both = at.join(F.broadcast(mark), F.col("b_place") < F.col("place"), "left")
    return both.select("version_id", F.coalesce("b", "previous_id").alias("base_id"))


def resolve(versions: DataFrame, selector: str, baseline: str | None = None) -> int:
    """The version that ``latest``, ``previous``, ``baseline``, ``#<id>`` or a label names; KeyError if there is none."""
    order = release_order(versions)
    ids = [v for v, _ in order]
    if selector in ("latest", "previous"):
        at = -1 if selector == "latest" else -2
        if len(ids) < -at:
            raise KeyError(f"no {selector} version")
        return ids[at]
    if selector == "baseline":
        if baseline is None:
            raise KeyError("no baseline is set")
        selector = baseline
    if selector.startswith("#"):
        if not selector[1:].isdigit() or int(selector[1:]) not in ids:
            raise KeyError(f"no version {selector}")
        return int(selector[1:])
    for v, name in order:
        if name == selector:
            return v
    raise KeyError(f"no version named {selector!r}")


def validate_label(label: str) -> str:
    """``label`` if it can name a version: letters, digits, ``.``, ``_``, ``-``, no leading ``.`` and no reserved word."""
    if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9._-]*", label) or label in RESERVED:
        raise ValueError(f"not a version label: {label!r}")
    return label
