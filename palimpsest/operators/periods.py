"""History of changing attributes as validity periods, by gaps and islands over all releases.

An attribute digest stands for the data from the scan on, so payloads are not shuffled. Within a record's releases a
lag comparison marks changes, their running sum numbers the islands, and an island's minimum and the next island's
start are its validity.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.jsontext import digest
from palimpsest.session import blank_trim, broadcast_if_small, ship


@F.pandas_udf(T.BinaryType())
def json_digest(data: pd.Series) -> pd.Series:
    """16 bytes equal for payloads equal as JSON; null for null."""
    return data.map(digest)


def validity_periods(events: DataFrame, releases: DataFrame) -> DataFrame:
    """(kind, key, from_version_id, to_version_id, event_id): one row per longest run of releases with the same data.

    ``events``: event_id, kind, key, version (a label), status, data, received_at. ``releases``: version_id, label, ord.
    to_version_id is where the data change or the record is removed, 0 if it still holds; event_id is the event that
    began the period. Of several events for one record and version the last received counts (null received_at
    first; the greater event_id among equals). A removed event ends the period whatever its data; any other
    status, or none, sets the data, null data being a value of their own. Labels and statuses compare without
    case and outer blanks; events of labels that no version has count for nothing. Unreadable data are equal as text.
    A null kind or key is a value. Empty tables give an empty result; columns beyond those named are not read.
    """
    ship(events.sparkSession)
    fold = lambda c: F.lower(blank_trim(F.col(c)))
    named = releases.select(fold("label").alias("label"), "version_id", "ord").dropDuplicates(["label"])
    seen = events.select(
        "kind", "key", fold("version").alias("label"), "event_id", "received_at",
        F.coalesce(fold("status") == "removed", F.lit(False)).alias("gone"),
        json_digest("data").alias("d"),
    ).join(broadcast_if_small(named), "label")
    # Deliveries of one record and version merge before the shuffle; after it a record has a row per release at most.
    last = F.max(F.struct("received_at", "event_id", "gone", "d"))
    state = seen.groupBy("kind", "key", "version_id", "ord").agg(last.alias("s"))
    gone = F.col("s.gone")
    form = F.when(gone, None).otherwise(F.concat(F.unhex(F.lit("01")), F.coalesce(F.col("s.d"), F.unhex(F.lit("00")))))
    state = state.select("kind", "key", "version_id", "ord", F.col("s.event_id").alias("event_id"), form.alias("d"))
    w = Window.partitionBy("kind", "key").orderBy("ord")
    changed = state.withColumn("change", F.when(F.col("d").eqNullSafe(F.lag("d").over(w)) & F.lag("ord").over(w).isNotNull(), 0).otherwise(1))
    numbered = changed.withColumn("island", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = numbered.groupBy("kind", "key", "island").agg(
        F.min(F.struct("ord", "version_id", "event_id")).alias("start"), F.bool_or(F.col("d").isNotNull()).alias("held")
    )
    v = Window.partitionBy("kind", "key").orderBy("island")
    closed = islands.withColumn("next", F.lead("start.version_id").over(v))
    return closed.where("held").select(
        "kind", "key", F.col("start.version_id").alias("from_version_id"), F.coalesce("next", F.lit(0)).cast("bigint").alias("to_version_id"),
        F.col("start.event_id").alias("event_id"),
    )


def as_of(periods: DataFrame, releases: DataFrame, version_id: int) -> DataFrame:
    """The periods that hold at ``version_id``: begun at it or before, ended after it or not at all."""
    order = releases.select("version_id", "ord")
    at = broadcast_if_small(order)
    here = F.broadcast(order.where(F.col("version_id") == version_id).select(F.col("ord").alias("here")).limit(1))
    p = periods.join(at.select(F.col("version_id").alias("from_version_id"), F.col("ord").alias("a")), "from_version_id")
    p = p.join(at.select(F.col("version_id").alias("to_version_id"), F.col("ord").alias("b")), "to_version_id", "left")
    p = p.join(here, F.col("a") <= F.col("here")).where("b is null or b > here")
    return p.select(*periods.columns)
