"""What changed between consecutive full snapshots, by EXCEPT ALL in both directions and a full join of the residues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import Scratch, blank_trim, broadcast_if_small


def path_key(key: Column) -> Column:
    """A key as a path: single ``/`` between its parts, none outside, whatever separators it was written with."""
    whole = F.regexp_replace(F.regexp_replace(key, r"[/\\]+", "/"), "^/|/$", "")
    odd = key.contains("\\") | key.contains("//") | key.startswith("/") | key.endswith("/")
    return F.when(odd, whole).otherwise(key)  # most keys need no regular expression


def hash_bytes(hash_: Column) -> Column:
    """A hash without case and outer blanks. 64 hex digits take 32 bytes; other text keeps its own form, made longer
    than that so that the two never meet."""
    h = F.lower(blank_trim(hash_))
    other = F.concat(F.encode(F.lit("text of another form, kept whole: "), "utf-8"), F.encode(h, "utf-8"))
    odd = F.when(h.rlike("^[0-9a-f]{64}$"), F.unhex(h)).otherwise(other)
    return F.coalesce(F.when(F.length(hash_) == 64, F.unhex(hash_)), odd)


def hash_text(h: Column) -> Column:
    """What ``hash_bytes`` was made of, without case and outer blanks."""
    return F.when(F.length(h) == 32, F.lower(F.hex(h))).otherwise(F.decode(F.substring(h, 35, 1 << 30), "utf-8"))


def snapshot_changes(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """(source, version_id, kind, key, status): records added, removed or modified against the version before.

    ``rows``: version_id, source, kind, key, hash, loaded_at; other columns are not read. ``steps``: source,
    version_id, following (the next version of that source, null for the last) and first (no version before it);
    versions not in ``steps`` are left out, and so is what the first holds. Of several rows for one record and
    version the last loaded counts (null loaded_at before all others; the greater hash among equals). A null hash is a
    value of its own; a null kind, key or source is one too. Empty tables give an empty result.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    clean = rows.select("version_id", "source", "kind", path_key(F.col("key")).alias("key"), hash_bytes(F.col("hash")).alias("h"), "loaded_at")
    clean = clean.join(broadcast_if_small(steps), ["source", "version_id"])
    record = ["source", "kind", "key"]
    # One row per record and version. Repeats are merged before the shuffle, so a key loaded again and again is no hot spot.
    latest = clean.groupBy(*record, "version_id", "following", "first").agg(F.max(F.struct("loaded_at", "h"))["h"].alias("h"))
    # From here on everything is local to a record: one shuffle of the merged rows serves both directions.
    latest = latest.repartition(*record)
    side = lambda v, n: F.struct(F.col(v).alias("v"), F.lit(n).alias("n"))
    sides = latest.select(*record, "h", F.explode(F.array(F.when(~F.col("first"), side("version_id", 1)), side("following", -1))).alias("s"))
    sides = sides.where("s.v is not null").select(*record, "s.v", "s.n", "h")
    # new EXCEPT ALL old keeps what counts above zero here, old EXCEPT ALL new what counts below.
    net = sides.groupBy(*record, "v", "h").agg(F.sum("n").alias("n")).where("n <> 0").select(*record, "v", "n")
    net = scratch.save(net, "residues")
    new, old = net.where("n > 0").alias("a"), net.where("n < 0").alias("b")
    on = [*record, "v"]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]
    both = new.join(old, same[0] & same[1] & same[2] & same[3], "full")
    status = F.when(F.col("b.n").isNull(), "added").when(F.col("a.n").isNull(), "removed").otherwise("modified")
    there = F.col("a.n").isNotNull()
    pick = lambda c: F.when(there, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    return both.select(pick("source").alias("source"), pick("v").alias("version_id"), pick("kind").alias("kind"), pick("key").alias("key"), status.alias("status"))


def steps(extractions: DataFrame, releases: DataFrame) -> DataFrame:
    """source, version_id, following, first: the completed versions of each source, each with the next in release order."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("ord")
    done = extractions.select(F.col("extractor").alias("source"), "version_id").distinct()
    done = done.join(broadcast_if_small(releases.select("version_id", "ord")), "version_id")
    return done.select("source", "version_id", F.lead("version_id").over(w).alias("following"), F.lag("version_id").over(w).isNull().alias("first"))
