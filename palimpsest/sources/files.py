"""Files of a client folder, and the manifest that describes them."""

from __future__ import annotations

import base64
import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import relative_path
from palimpsest.session import ship

#: What of a client folder is kept.
INCLUDE = ("Data/", "MapleStory.exe")


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, prefix: str = "", content: bool = False) -> DataFrame:
    """(path, size, hash) and, if wanted, content: the files below ``root`` whose relative path begins with one of ``include``, any if that is empty.
    The hash is the SHA-256 of the content. A file is one row of its task; Spark's limit of 2 GB a file holds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = relative_path(F.col("path"), root)
    wanted = F.lit(not include)
    for i in include:
        wanted = wanted | (path.startswith(i) if i.endswith("/") else path == i)
    return files.where(wanted).select(F.concat(F.lit(prefix), path).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), *(["content"] if content else []))


def file_records(files: DataFrame) -> DataFrame:
    """kind, key, hash, data of files as records: the content's hash, and the size as payload."""
    return files.select(F.lit("file").alias("kind"), F.col("path").alias("key"), "hash", F.to_json(F.struct("size")).alias("data"))


def import_totals(files: DataFrame, known: DataFrame) -> DataFrame:
    """files, bytes, new_bytes: sizes of all files, and of the contents that ``known`` (hash) lacks, once each."""
    first = files.groupBy("hash").agg(F.count("*").alias("n"), F.sum("size").alias("sum"), F.max("size").alias("size"))
    told = first.join(known.select("hash").distinct().withColumn("old", F.lit(True)), "hash", "left")
    fresh = F.sum(F.when(F.col("old").isNull(), F.col("size")))
    zero = F.lit(0).cast("bigint")
    return told.agg(F.coalesce(F.sum("n"), zero).alias("files"), F.coalesce(F.sum("sum"), zero).alias("bytes"), F.coalesce(fresh, zero).alias("new_bytes"))


def unreferenced(objects: DataFrame, used: DataFrame) -> DataFrame:
    """Stored contents (hash, size) that no record uses, as objects, bytes."""
    lost = objects.join(used.select("hash"), "hash", "left_anti")
    return lost.agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


_ENTRY = "array<struct<path:string,size:bigint,mtime:bigint,objects:array<string>,is_dir:boolean>>"


def decode_path(text: str) -> str:
    """base64 of UTF-16-LE with or without byte order mark; an odd last byte is dropped."""
    raw = base64.b64decode(text)
    raw = raw.removeprefix(b"\xff\xfe")
    return raw[: len(raw) // 2 * 2].decode("utf-16-le", "replace")


def parse_manifest(content: bytes) -> dict:
    """buildtime, product, version and files of a manifest: zlib, then JSON with encoded paths."""
    d = json.loads(zlib.decompress(content))
    rows = []
    for name, f in (d.get("files") or {}).items():
        parts = f.get("objects") or []
        rows.append({"path": decode_path(name), "size": f.get("fsize"), "mtime": f.get("mtime"), "objects": parts, "is_dir": "__DIR__" in parts})
    return {"buildtime": d.get("buildtime"), "product": d.get("product"), "version": d.get("version"), "files": sorted(rows, key=lambda r: r["path"])}


def manifest(content: Column) -> Column:
    """buildtime, product, version, files of binary manifests; null for what is none."""

    @F.pandas_udf(f"struct<buildtime:double,product:string,version:string,files:{_ENTRY}>")
    def read(contents: pd.Series) -> pd.DataFrame:
        def one(c: bytes | None) -> dict:
            try:
                return parse_manifest(c)
            except (TypeError, ValueError, AttributeError, zlib.error):
                return {"buildtime": None, "product": None, "version": None, "files": None}

        return pd.DataFrame([one(c) for c in contents], columns=["buildtime", "product", "version", "files"])

    return read(content)


def current_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """hash, and the manifest's fields, of the one that the folder's first ``*.manifest.hash`` file names; no row if there is none."""
    ship(spark)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.manifest.hash").load(folder).orderBy("path").limit(1)
    names = [bytes(r.content).decode().strip() for r in listed.select("content").collect()]
    if not names:
        return spark.createDataFrame([], f"hash string, buildtime double, product string, version string, files {_ENTRY}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", names[0]).load(folder)
    return files.select(F.lit(names[0]).alias("hash"), manifest(F.col("content")).alias("m")).select("hash", "m.*")
