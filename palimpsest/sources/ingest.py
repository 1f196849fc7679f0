"""A client folder into the store."""

from __future__ import annotations

import posixpath
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.extract import chosen
from palimpsest.sources import files
from palimpsest.sources.store import Store


def _plain(path: str) -> str:
    return posixpath.normpath(path.replace("file://", "").replace("\\", "/"))


def import_client(store: Store, client: str, label: str, channel: str = "live", patchdata: str | None = None, note: str | None = None, baseline: bool = False) -> dict:
    """A version of a client folder: its files as records of the source ``import``; version_id, files, bytes, new_bytes, became_baseline.

    The folder is only read. Refused: a label in use, a folder without ``Data/Base/Base.wz``, one that lies in the store or
    holds it. If writing the records fails the version is removed again.
    """
    a, b = _plain(client), _plain(store.root)
    if a == b or a.startswith(b + "/") or b.startswith(a + "/"):
        raise ValueError("the client and the store must not lie in one another")
    whole = files.scan(store.spark, client, content=True)
    if patchdata:
        whole = whole.unionByName(files.scan(store.spark, patchdata, (), "patchdata/", True))
    found = whole.drop("content").cache()
    try:
        if found.where("path = 'Data/Base/Base.wz'").head() is None:
            raise ValueError(f"{client} has no Data/Base/Base.wz")
        known = store.table("records").where("kind = 'file'").select("hash")
        totals = files.import_totals(found, known).head()
        made = files.current_manifest(store.spark, patchdata).head() if patchdata else None
        built = datetime.fromtimestamp(made.buildtime, timezone.utc).isoformat(timespec="milliseconds") if made and made.buildtime is not None else None
        first = store.meta("baseline")
        version = store.insert_version(label, channel, client, made.hash if made else None, built, note)
        try:
            store.snapshot(label, store.ingest(whole))
            store.replace_records(version, "import", files.file_records(found))
        except Exception:
            store.remove_version(version)
            raise
    finally:
        found.unpersist()
    if baseline:
        store.set_meta("baseline", label)
    return {"version_id": version, **totals.asDict(), "became_baseline": store.meta("baseline") == label and first != label}


def run_extractors(store: Store, version_id: int, nodes: DataFrame, only: list[str] | None = None) -> dict[str, tuple[int, float]]:
    """Runs extractors over a version's nodes, each replacing its own records; how many records and seconds, by extractor."""
    out = {}
    for name, extractor in chosen(only).items():
        rows = extractor(nodes.where(F.col("version_id") == version_id)).drop("version_id")
        began = time.monotonic()
        out[name] = store.replace_records(version_id, name, rows), time.monotonic() - began
    return out
