"""A stream of loaded record rows into snapshots, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def follow(rows: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes a stream of record rows (version_id, source, kind, key, hash, blob_hash, loaded_at) below ``target``, in folders by
    version and source, exactly once.

    Rows are only appended: ``sources.store.latest_records`` reads the last loaded of each, so late and repeated rows need no
    state, and no watermark drops any. ``once`` ends when all that is there now is written.
    """
    writer = rows.writeStream.format("parquet").partitionBy("version_id", "source").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
