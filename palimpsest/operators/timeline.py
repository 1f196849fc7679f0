"""How single records changed over all releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import broadcast_if_small, local_if_small


def events(records: DataFrame, releases: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """(kind, key, version_id, ord, status, hash, blob_hash): every change of every record, in release order.

    ``records`` has one row per version, kind and key; ``covered``, if given, the (kind, version_id) that they hold, as can
    be told from the rows as they were loaded. Only versions that hold any record of a kind say something about
    its records, so a version without the kind removes nothing. A record that comes back is added again.

    No grid of records and versions is built: a record's removal is found from the kind's next covered version alone.
    """
    order = broadcast_if_small(releases.select("version_id", "ord"))
    covered = (records if covered is None else covered).select("kind", "version_id").distinct().join(order, "version_id")
    w = Window.partitionBy("kind").orderBy("ord")  # as many rows as there are versions
    place = covered.select("kind", "version_id", "ord", F.row_number().over(w).alias("place"), F.lead("version_id").over(w).alias("next_id"), F.lead("ord").over(w).alias("next_ord"))
    at = records.join(local_if_small(place), ["kind", "version_id"])
    r = Window.partitionBy("kind", "key").orderBy("place")
    seen = at.select(
        "kind", "key", "version_id", "ord", "hash", "blob_hash", "next_id", "next_ord",
        (F.col("place") - F.lag("place").over(r) == 1).alias("after"),
        F.lag("hash").over(r).alias("before"),
        (F.lead("place").over(r) - F.col("place") == 1).alias("goes_on"),
    )
    here = F.when(~F.coalesce("after", F.lit(False)), "added").when(~F.col("hash").eqNullSafe(F.col("before")), "modified")
    came = F.when(here.isNotNull(), F.struct("version_id", "ord", here.alias("status"), "hash", "blob_hash"))
    none = F.lit(None).cast("string")
    left = F.struct(F.col("next_id").alias("version_id"), F.col("next_ord").alias("ord"), F.lit("removed").alias("status"), none.alias("hash"), none.alias("blob_hash"))
    gone = F.when(~F.coalesce("goes_on", F.lit(False)) & F.col("next_id").isNotNull(), left)
    return seen.select("kind", "key", F.explode(F.array_compact(F.array(came, gone))).alias("e")).select("kind", "key", "e.*")
