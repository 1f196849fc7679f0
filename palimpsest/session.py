"""What operators need of the session: a shared scratch folder, size-checked broadcasts, code on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension may be gathered by the driver or broadcast. At 200 bytes a row that is 20 MB.
DIMENSION_ROWS = 100_000


def session(app: str = "palimpsest", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for; ``conf`` uses ``_`` for ``.``."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset, a temporary one, and that in local runs alone: the
    executors of a cluster have no folder of this machine."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        context.setCheckpointDir(found)
        found = context.getCheckpointDir()
    return found


class Scratch:
    """Tables written to the shared folder to cut lineage; they outlive lost executors and go with the application."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/palimpsest-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` as ``name`` and give back the table that reads it."""
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


def small(df: DataFrame, most: int = DIMENSION_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows; counts no further than that."""
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, most: int = DIMENSION_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its size allows it; else as it is, and the join shuffles."""
    return F.broadcast(df) if small(df, most) else df


def local_if_small(df: DataFrame, most: int = DIMENSION_ROWS) -> DataFrame:
    """``df`` worked out once and broadcast if its size allows it; else as it is."""
    rows = df.limit(most + 1).collect()
    return df if len(rows) > most else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def gather(df: DataFrame, most: int = DIMENSION_ROWS) -> list:
    """The rows of a dimension table, refusing one that is too large to be a dimension."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dimension table holds more than {most} rows")
    return rows


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_palimpsest_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="palimpsest-code-")) / "palimpsest_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path(here.name) / p.relative_to(here))
    context.addPyFile(str(target))
    context._palimpsest_shipped = True


def blank_trim(col: Column) -> Column:
    """Without outer white space of any kind; ``trim`` alone takes only the space character."""
    return F.regexp_replace(col, r"^[\s ]+|[\s ]+$", "")
