"""Mixing sources to target weights, as a Pfair schedule of blocks.

Each source's documents, in an order fixed by a hash, form a stream that is passed through as often as its share
needs. Streams are cut into blocks of about equal tokens. Block k of a source of weight w is released at k / w and due
at (k + 1) / w; earliest deadline first then interleaves the sources so that none is ever a whole block ahead of or
behind its share. With every source's number of blocks a multiple of the same number, the schedule repeats itself:
one frame of ``FRAME`` slots is scheduled on the driver, and a block's slot follows from its number, however many frames
there are. Documents stay put.
"""

from __future__ import annotations

import base64
import heapq
import math
import os
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.session import Scratch, gather, ship

#: How the byte-level vocabularies split text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a block, about; and slots of a frame, about.
BLOCK, FRAME = 2048, 10_000
#: Documents whose running sum one task makes, on average.
RUN = 20_000


@lru_cache(maxsize=4)
def _encoding(name: str):
    import tiktoken

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, spark: SparkSession, tokenizer: str) -> Column:
    """Tokens of a text by a byte-level vocabulary in tiktoken's form, a file of the driver that every executor is sent; 0
    for null and blank texts."""
    spark.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(name)
        return pd.Series([0 if t is None or not t.strip() else len(encoding.encode_ordinary(t)) for t in texts], dtype="int64")

    return count(text)


def source_name(col: Column) -> Column:
    """A source without case, outer blanks, ``-`` and ``_``."""
    return F.lower(F.regexp_replace(F.regexp_replace(col, r"^\s+|\s+$", ""), "[-_]", ""))


def plan(totals: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, int]:
    """Tokens to take of each source: the largest amounts in proportion to the shares that no source need be repeated
    more than it may for. Sources without tokens, share or repeats get none, and the others share what is theirs."""
    able = {s: (Fraction(str(w)), r) for s, (w, r) in targets.items() if w and w > 0 and r and r > 0 and totals.get(s, 0) > 0}
    if not able:
        return {}
    whole = min(r * totals[s] / w for s, (w, r) in able.items())
    return {s: int(w * whole) for s, (w, _) in able.items()}


def schedule(blocks: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot): earliest deadline first over the blocks' Pfair windows. With K blocks in all, block k of a
    source of n is released at slot floor(k K / n) and due by ceil((k + 1) K / n); ties go by name."""
    every = sum(blocks.values())
    waiting = [(0, s, 0) for s, n in blocks.items() if n]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(every):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * every // blocks[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append((s, k, slot))
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * every // blocks[s], s, k + 1))
    return out


def frames(need: dict[str, int], block: int, frame: int) -> tuple[int, dict[str, int]]:
    """How often the frame repeats, and how many of its blocks are each source's: in proportion to what is needed, one at
    least. Blocks of a source have need / (repeats * blocks) tokens, which is about ``block``."""
    every = sum(need.values())
    repeats = max(1, every // (block * frame))
    slots = max(1, math.ceil(every / (block * repeats)))
    return repeats, {s: max(1, round(Fraction(n * slots, every))) for s, n in need.items() if n}


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """(slot, start, doc_id, copy, source, tokens): the documents of the mixture, each as often as it is used.

    ``targets``: source, target_share, max_repeats. Reading by slot, then start (the place in its source's stream) gives
    the interleaved order. Sources compare as by ``source_name`` and are output as in ``targets``; of a source listed
    twice the first by name counts. Documents of no source or of one that is not listed, and null, blank and empty
    texts (no tokens), are not used; nor is a source without share. Every source is short of its share by less than
    one document. The choice depends on the ids and the data alone, not on how they are partitioned. ``tokenizer`` is the
    path of a vocabulary on the driver. Blocks have about ``block`` tokens whatever the total. An empty table on
    either side gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    wanted: dict[str, tuple[str, float, int]] = {}
    folded = targets.select(source_name(F.col("source")).alias("s"), "source", "target_share", "max_repeats").where("s is not null")
    for r in sorted(gather(folded), key=lambda r: (r.s, r.source)):
        wanted.setdefault(r.s, (r.source, r.target_share, r.max_repeats))
    names = spark.createDataFrame([(s, v[0]) for s, v in wanted.items()], "s string, name string")
    sized = docs.select(F.col(doc_id).alias("doc_id"), source_name(F.col("source")).alias("s"), F.col(text).alias("text"))
    sized = sized.join(F.broadcast(names.select("s")), "s").select("doc_id", "s", token_count(F.col("text"), spark, tokenizer).alias("tokens"), F.xxhash64(F.col("doc_id")).alias("h"))
    sized = scratch.save(sized.where("tokens > 0"), "sized")
    sums = {r.s: (int(r.t), r.n) for r in sized.groupBy("s").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    need = plan({s: t for s, (t, _) in sums.items()}, {s: (v[1], v[2]) for s, v in wanted.items()})

    repeats, share = frames(need, block, frame) if need else (1, {})
    rows = [(s, sums[s][0], n // sums[s][0], n % sums[s][0], n / (repeats * share[s]), share[s]) for s, n in need.items() if n]
    shape = spark.createDataFrame(rows, "s string, total bigint, passes bigint, rest bigint, length double, share bigint")
    slots = spark.createDataFrame(schedule(share), "s string, within bigint, at_slot bigint")  # one frame

    # A source may hold a third of all documents: its running sum is made over runs of the hash order, each begun
    # with the sum of the runs before it.
    runs = max(1, math.ceil(max((n for _, n in sums.values()), default=1) / RUN))
    placed = sized.withColumn("run", F.shiftrightunsigned("h", 1) / F.lit(2.0**63 / runs))
    placed = placed.withColumn("run", F.least(F.floor("run"), F.lit(runs - 1)))
    before = Window.partitionBy("s").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("s", "run").agg(F.sum("tokens").alias("t")).select("s", "run", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("s", "run").orderBy(F.shiftrightunsigned("h", 1), "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("upto", F.sum("tokens").over(within)).join(offsets, ["s", "run"])
    placed = placed.withColumn("at", F.col("offset") + F.col("upto") - F.col("tokens")).join(F.broadcast(shape), "s")
    again = F.when(F.col("at") + F.col("tokens") <= F.col("rest"), 1).otherwise(0)
    times = F.sequence(F.lit(1).cast("bigint"), F.col("passes") + again)
    used = placed.where(F.col("passes") + again > 0).withColumn("copy", F.explode(times))
    used = used.withColumn("start", (F.col("copy") - 1) * F.col("total") + F.col("at"))
    number = F.floor(F.col("start") / F.col("length")).cast("bigint")
    used = used.withColumn("block", F.least(number, F.lit(repeats) * F.col("share") - 1))
    used = used.withColumn("within", F.col("block") % F.col("share"))
    out = used.join(F.broadcast(slots), ["s", "within"]).join(F.broadcast(names), "s")
    slot = F.expr("block div share") * F.lit(sum(share.values())) + F.col("at_slot")
    return out.select(slot.alias("slot"), "start", F.col("doc_id").alias(doc_id), F.col("copy").cast("int").alias("copy"), F.col("name").alias("source"), "tokens")


def shares(mixture: DataFrame, targets: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """source, target_share, reached_share, tokens, documents (with copies), most_copies of every target; 0 for a source
    that could not be used."""
    got = mixture.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("copy").alias("most_copies"))
    every = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # over one row per target
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = targets.select("source", "target_share").join(F.broadcast(got), "source", "left")
    reached = F.coalesce(F.col("tokens") / every, F.lit(0.0)).alias("reached_share")
    return out.select("source", "target_share", reached, zero("tokens"), zero("documents"), zero("most_copies"))
