"""A store of versions, records and payloads in Parquet.

Records lie in folders by version and source, so a version's scan reads its own files only and a source is replaced by
rewriting one folder. A row in extractions is written last and marks a source of a version as complete.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.canon import canonical_json, content_hash
from palimpsest.operators.snapshots import hash_bytes, hash_text, path_key
from palimpsest.operators.versions import validate_label
from palimpsest.session import Scratch, broadcast_if_small, ship
from palimpsest.sources.files import unreferenced

SCHEMAS = {
    "versions": "version_id bigint, label string, channel string, imported_at string, source_path string, manifest_hash string, build_time string, note string",
    "records": "kind string, key string, hash string, blob_hash string, version_id bigint, source string",
    "blobs": "hash string, data string",
    "extractions": "version_id bigint, extractor string, record_count bigint, finished_at string",
    "meta": "key string, value string",
    "objects": "hash string, size bigint, content binary",
}
#: The layout this code writes. Stores of an earlier one are brought to it step by step, those of a later one refused.
LAYOUT = 2


class Store:
    """The tables below ``root``. What is rewritten is written as a new generation (a folder ``gen=N``) beside the old one. The
    last generation that was written to its end counts, so that a crash at any time leaves the old or the new table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._fs.exists(self._path(self._at("meta/_SUCCESS"))):
            self._to_generations()
        layout = self.meta("layout")
        if layout is not None and int(layout) > LAYOUT:
            raise ValueError(f"the store has layout {layout}, this code knows {LAYOUT}")
        for step in range(int(layout or 0), LAYOUT):
            self.set_meta("layout", str(step + 1))

    def _at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _folders(self, place: str) -> list[str]:
        if not self._fs.exists(self._path(place)):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(place)) if f.isDirectory())

    def _generations(self, place: str) -> list[int]:
        """The numbers of the generations below a folder that were written to their end."""
        have = [int(f.removeprefix("gen=")) for f in self._folders(place) if f.startswith("gen=")]
        return sorted(n for n in have if self._fs.exists(self._path(f"{place}/gen={n}/_SUCCESS")))

    def _live(self, name: str) -> list[str]:
        """The folders that hold a table now."""
        places = [self._at(name)]
        if name == "records":
            places = [f"{places[0]}/{v}/{s}" for v in self._folders(places[0]) for s in self._folders(f"{places[0]}/{v}")]
        return [f"{p}/gen={n[-1]}" for p in places if (n := self._generations(p))]

    def _write(self, place: str, df: DataFrame) -> None:
        old = self._folders(place)
        new = max((int(f.removeprefix("gen=")) for f in old if f.startswith("gen=")), default=0) + 1
        df.write.mode("overwrite").parquet(f"{place}/gen={new}")
        for f in old:
            self._fs.delete(self._path(f"{place}/{f}"), True)

    def table(self, name: str) -> DataFrame:
        """One of the tables; empty if nothing was written yet."""
        folders = self._live(name)
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        reader = self.spark.read.schema(SCHEMAS[name]).option("basePath", self._at(name))
        return reader.parquet(*folders).select(*[f.split(" ")[0] for f in SCHEMAS[name].split(", ")])

    def _rewrite(self, name: str, df: DataFrame) -> None:
        self._write(self._at(name), df.coalesce(1))

    def upsert(self, name: str, keys: list[str], new: DataFrame) -> None:
        """Rows in the place of those with the same keys in one of the small tables."""
        self._rewrite(name, self.table(name).join(new.select(*keys), keys, "left_anti").unionByName(new))

    def _upsert(self, name: str, keys: list[str], rows: list[tuple]) -> None:
        self.upsert(name, keys, self.spark.createDataFrame(rows, SCHEMAS[name]))

    def _to_generations(self) -> None:
        """From layout 1, whose tables lay in their folders without generations."""
        for name in ("versions", "extractions", "meta", "blobs", "records"):
            at = self._at(name)
            places = [at] if name != "records" else [f"{at}/{v}/{s}" for v in self._folders(at) for s in self._folders(f"{at}/{v}")]
            for p in places:
                if self._fs.exists(self._path(f"{p}/_SUCCESS")):
                    self._fs.mkdirs(self._path(f"{p}/gen=1"))
                    for f in self._fs.listStatus(self._path(p)):
                        if f.isFile() and f.getPath().getName() != "_SUCCESS":
                            self._fs.rename(f.getPath(), self._path(f"{p}/gen=1/{f.getPath().getName()}"))
                    self._fs.rename(self._path(f"{p}/_SUCCESS"), self._path(f"{p}/gen=1/_SUCCESS"))

    # Settings

    def meta(self, key: str) -> str | None:
        rows = self.table("meta").where(F.col("key") == key).head(1)
        return rows[0].value if rows else None

    def set_meta(self, key: str, value: str) -> None:
        self._upsert("meta", ["key"], [(key, value)])

    def delete_meta(self, key: str) -> None:
        self._rewrite("meta", self.table("meta").where(F.col("key") != key))

    # Versions

    def insert_version(self, label: str, channel: str = "", source_path: str = "", manifest_hash: str | None = None, build_time: str | None = None, note: str | None = None, imported_at: str | None = None) -> int:
        """The id of a new version. The first one becomes the baseline."""
        validate_label(label)
        have = self.table("versions").agg(F.max("version_id").alias("top"), F.count_if(F.col("label") == label).alias("same")).head()
        if have.same:
            raise ValueError(f"there is a version {label!r} already")
        number = (have.top or 0) + 1
        when = imported_at or datetime.now(timezone.utc).isoformat(timespec="milliseconds")
        self._upsert("versions", ["version_id"], [(number, label, channel, when, source_path, manifest_hash, build_time, note)])
        if have.top is None and self.meta("baseline") is None:
            self.set_meta("baseline", label)
        return number

    def remove_version(self, version_id: int) -> None:
        """Drops a version with its records and extractions, and the baseline's mark if it was on it."""
        row = self.table("versions").where(F.col("version_id") == version_id).head()
        if row is None:
            raise KeyError(version_id)
        if self.meta("baseline") == row.label:
            self.delete_meta("baseline")
        for name in ("extractions", "versions"):
            self._rewrite(name, self.table(name).where(F.col("version_id") != version_id))
        self._fs.delete(self._path(self._at(f"records/version_id={version_id}")), True)
        self._fs.delete(self._path(self._at(f"snapshots/{row.label}")), True)

    # Records

    def replace_records(self, version_id: int, source: str, rows: DataFrame, finished_at: str | None = None) -> int:
        """Put ``rows`` (kind, key, and data or hash) in the place of the source's records of a version; how many they are.

        data is JSON; a row without it needs a hash (raw files), one with it gets that of its canonical form unless it
        brings its own. A kind and key that occurs twice, or in another source of the version, fails before
        anything is written. Payloads come first, then the records, then the mark of completion.
        """
        ship(self.spark)
        have = set(rows.columns)
        data = canonical_json("data") if "data" in have else F.lit(None).cast("string")
        given = F.col("hash") if "hash" in have else F.lit(None).cast("string")
        made = rows.select("kind", "key", data.alias("data"), given.alias("given"))
        made = made.withColumn("blob_hash", content_hash(F.col("data"))).withColumn("hash", F.coalesce("given", "blob_hash")).cache()
        try:
            others = self.table("records").where((F.col("version_id") == version_id) & (F.col("source") != source))
            twice = made.groupBy("kind", "key").count().where("count > 1").select("kind", "key")
            clash = made.join(others, ["kind", "key"], "left_semi").select("kind", "key")
            bad = twice.unionByName(clash).head()
            if bad:
                raise ValueError(f"record {bad.kind}/{bad.key} is there twice in version {version_id}")
            fresh = new_blobs(made.where("data is not null").select(F.col("blob_hash").alias("hash"), "data"), self.table("blobs"))
            blobs = self._live("blobs") or [f"{self._at('blobs')}/gen=1"]
            fresh.write.mode("append").parquet(blobs[0])
            folder = f"records/version_id={version_id}/source={source}"
            n = made.count()
            if n:
                self._write(self._at(folder), made.select("kind", "key", "hash", "blob_hash"))
            else:
                self._fs.delete(self._path(self._at(folder)), True)
        finally:
            made.unpersist()
        when = finished_at or datetime.now(timezone.utc).isoformat(timespec="milliseconds")
        self._upsert("extractions", ["version_id", "extractor"], [(version_id, source, n, when)])
        return n

    # Contents of files

    def ingest(self, found: DataFrame) -> DataFrame:
        """Stores the contents of files (path, hash, size, content) that are not stored yet, once each; (path, hash, size,
        is_new). A file's row is as large as the file."""
        once = found.select("hash", "size", "content").dropDuplicates(["hash"])
        fresh = once.join(self.table("objects").select("hash"), "hash", "left_anti")
        told = found.select("path", "hash", "size").join(fresh.select("hash", F.lit(True).alias("is_new")), "hash", "left")
        told = Scratch(self.spark).save(told.select("path", "hash", "size", F.coalesce("is_new", F.lit(False)).alias("is_new")), "told")
        objects = self._live("objects") or [f"{self._at('objects')}/gen=1"]
        fresh.write.mode("append").parquet(objects[0])
        return told

    def snapshot(self, label: str, listed: DataFrame) -> None:
        """Keeps the tree of a version (path, hash, size) as links to stored contents; there as a whole or not at all."""
        self._write(self._at(f"snapshots/{label}"), listed.select("path", "hash", "size"))

    def files(self, label: str) -> DataFrame:
        """The tree of a version: path, size and content."""
        n = self._generations(self._at(f"snapshots/{label}"))
        if not n:
            raise KeyError(label)
        listed = self.spark.read.schema("path string, hash string, size bigint").parquet(self._at(f"snapshots/{label}/gen={n[-1]}"))
        return listed.join(self.table("objects").select("hash", "content"), "hash").select("path", "size", "content")

    def retain(self, used: DataFrame) -> dict[str, int]:
        """Drops stored contents but those of ``used`` (hash); how many objects and bytes they were."""
        objects = self.table("objects")
        totals = unreferenced(objects, used).head().asDict()
        if totals["objects"]:
            self._write(self._at("objects"), objects.join(used.select("hash"), "hash", "left_semi"))
        return totals

    def gc(self) -> dict[str, int]:
        """Drops payloads that no record refers to and contents that no file record has; objects, bytes and blobs dropped."""
        blobs, records = self.table("blobs"), self.table("records")
        lost = orphan_blobs(blobs, records).count()
        if lost:
            self._write(self._at("blobs"), blobs.join(records.select(F.col("blob_hash").alias("hash")), "hash", "left_semi"))
        return self.retain(records.where("kind = 'file'").select("hash")) | {"blobs": lost}


def new_blobs(found: DataFrame, have: DataFrame) -> DataFrame:
    """Payloads not stored yet, once each. Of those stored only the ones that are found again are shuffled."""
    once = found.dropDuplicates(["hash"])
    again = have.select("hash").join(broadcast_if_small(found.select("hash").distinct()), "hash", "left_semi")
    return once.join(again, "hash", "left_anti")


def orphan_blobs(blobs: DataFrame, records: DataFrame) -> DataFrame:
    """Payloads that no record refers to. An anti join: null references neither match nor empty the result."""
    return blobs.join(records.select(F.col("blob_hash").alias("hash")), "hash", "left_anti")


def latest_records(records: DataFrame) -> DataFrame:
    """(version_id, source, kind, key, hash, blob_hash): of a load table with repeats and replaced rows, the last loaded of every
    record, with its key as a path and its hash without case and outer blanks."""
    bytes_ = F.struct("loaded_at", hash_bytes(F.col("hash")).alias("hash"), hash_bytes(F.col("blob_hash")).alias("blob_hash"))
    clean = records.select("version_id", "source", "kind", path_key(F.col("key")).alias("key"), bytes_.alias("r"))
    last = clean.groupBy("version_id", "source", "kind", "key").agg(F.max("r").alias("r"))
    return last.select("version_id", "source", "kind", "key", hash_text(F.col("r.hash")).alias("hash"), hash_text(F.col("r.blob_hash")).alias("blob_hash"))


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def pretty(rows: list) -> str:
    """Rows as indented JSON."""
    return json.dumps([r.asDict(recursive=True) for r in rows], indent=2, ensure_ascii=False)
