"""The job dimension, and what follows from a job's number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Number, name, branch and advancement of every job.
JOBS = [
    (0, "Beginner", "beginner", 0),
    (100, "Warrior", "warrior", 1),
    (110, "Fighter", "warrior", 2),
    (111, "Crusader", "warrior", 3),
    (112, "Hero", "warrior", 4),
    (120, "Page", "warrior", 2),
    (121, "White Knight", "warrior", 3),
    (122, "Paladin", "warrior", 4),
    (130, "Spearman", "warrior", 2),
    (131, "Dragon Knight", "warrior", 3),
    (132, "Dark Knight", "warrior", 4),
    (200, "Magician", "magician", 1),
    (210, "Wizard (Fire, Poison)", "magician", 2),
    (211, "Mage (Fire, Poison)", "magician", 3),
    (212, "Arch Mage (Fire, Poison)", "magician", 4),
    (220, "Wizard (Ice, Lightning)", "magician", 2),
    (221, "Mage (Ice, Lightning)", "magician", 3),
    (222, "Arch Mage (Ice, Lightning)", "magician", 4),
    (230, "Cleric", "magician", 2),
    (231, "Priest", "magician", 3),
    (232, "Bishop", "magician", 4),
    (300, "Bowman", "bowman", 1),
    (310, "Hunter", "bowman", 2),
    (311, "Ranger", "bowman", 3),
    (312, "Bowmaster", "bowman", 4),
    (320, "Crossbowman", "bowman", 2),
    (321, "Sniper", "bowman", 3),
    (322, "Marksman", "bowman", 4),
    (400, "Thief", "thief", 1),
    (410, "Assassin", "thief", 2),
    (411, "Hermit", "thief", 3),
    (412, "Night Lord", "thief", 4),
    (420, "Bandit", "thief", 2),
    (421, "Chief Bandit", "thief", 3),
    (422, "Shadower", "thief", 4),
    (900, "GM", "gm", 1),
    (910, "Super GM", "gm", 2),
]
# Slug and name of every branch; number, slug, word and label of every advancement.
BRANCHES = {"beginner": "Beginner", "warrior": "Warrior", "magician": "Magician", "bowman": "Bowman", "thief": "Thief", "gm": "GM"}
ADVANCEMENTS = [
    (0, "beginner", "beginner", "Beginner"),
    (1, "1st", "first", "1st job"),
    (2, "2nd", "second", "2nd job"),
    (3, "3rd", "third", "3rd job"),
    (4, "4th", "fourth", "4th job"),
]


def dimension(spark: SparkSession) -> DataFrame:
    """id, name, branch, advancement of every job."""
    return spark.createDataFrame(JOBS, "id int, name string, branch string, advancement int")


def of_skill(skill_id: Column) -> Column:
    """The job that owns a skill: its number without the last four digits."""
    return F.floor(skill_id / 10000).cast("bigint")


def parent(job: Column) -> Column:
    """The job before this one; null for the beginner."""
    step = F.when(job % 100 == 0, 0).when(job % 10 == 0, F.floor(job / 100) * 100).otherwise(job - 1)
    return F.when(job != 0, step).cast("bigint")


def path(job: Column) -> Column:
    """All jobs from the beginner to this one. A job's number leaves at most 11 steps: nine single ones, the first of its
    line, the first of its branch."""
    tens, hundreds = F.floor(job / 10) * 10, F.floor(job / 100) * 100
    singles = F.sequence(tens.cast("bigint"), job.cast("bigint"))
    every = F.concat(F.array(F.lit(0).cast("bigint"), hundreds.cast("bigint")), singles)
    return F.array_distinct(every)


def label(advancement: Column) -> Column:
    """How an advancement is called."""
    out = F.lit("Other")
    for n, _, _, text in ADVANCEMENTS:
        out = F.when(advancement == n, text).otherwise(out)
    return out


def named(df: DataFrame, job: str) -> DataFrame:
    """``df`` with job_name (``Job <n>`` for unknown numbers), branch and advancement of its column ``job``."""
    jobs = dimension(df.sparkSession).toDF("_id", "_name", "branch", "advancement")
    out = df.join(F.broadcast(jobs), F.col(job) == F.col("_id"), "left").drop("_id")
    return out.withColumn("job_name", F.coalesce("_name", F.concat(F.lit("Job "), F.col(job).cast("string")))).drop("_name")


def leaves(jobs: DataFrame, job: str = "job") -> DataFrame:
    """The jobs of a table that no other of its jobs follows."""
    one = jobs.select(job).distinct()
    before = one.select(parent(F.col(job)).alias(job)).where(F.col(job).isNotNull())
    return one.join(before, job, "left_anti")


def parse_advancement(text: str) -> int | None:
    """0 to 4 from ``2nd``, ``2``, ``second`` and the like; None for anything else."""
    t = text.strip().lower()
    return next((n for n, slug, word, _ in ADVANCEMENTS if t in (str(n), slug, word)), None)


def find(selector: str) -> int | None:
    """A job by number (also an unknown one) or by name without case."""
    digits = selector.removeprefix("+")
    if digits.isascii() and digits.isdigit() and int(digits) < 1 << 32:
        return int(digits)
    return next((i for i, name, _, _ in JOBS if name.lower() == selector.lower()), None)


def selected(col: Column, dimension_: DataFrame) -> Column:
    """``find`` of a column of selectors; ``dimension_`` is small enough to be a literal."""
    from palimpsest.functions.text import u32

    names = F.lit(None).cast("bigint")
    for r in dimension_.collect():
        names = F.when(F.lower(col) == r["name"].lower(), F.lit(r["id"])).otherwise(names)
    return F.coalesce(u32(col), names)
