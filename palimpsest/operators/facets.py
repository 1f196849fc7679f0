"""Facets: categories and jobs told from kind, key and payload at query time; filters and counts by them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import jobs
from palimpsest.functions.text import u32
from palimpsest.session import Scratch

# The categories in their order, with their names; which kinds and which top folders belong to them.
CATEGORIES = {"skills": "Skills", "equipment": "Equipment", "items": "Items", "monsters": "Monsters", "npcs": "NPCs", "maps": "Maps", "quests": "Quests", "other": "Other"}
KINDS = {
    "skills": ["skill", "string/Skill"],
    "equipment": ["string/Eqp"],
    "items": ["string/Consume", "string/Etc", "string/Ins", "string/Cash", "string/Pet"],
    "monsters": ["string/Mob", "string/MobSkill"],
    "npcs": ["string/Npc"],
    "maps": ["string/Map"],
}
FOLDERS = {"Skill": "skills", "Character": "equipment", "Item": "items", "Mob": "monsters", "Npc": "npcs", "Map": "maps", "Quest": "quests"}
RAW = ("img", "file")


def category(kind: Column, key: Column) -> Column:
    """A record's category; raw files and images go by their top folder."""
    top = F.split_part(F.regexp_replace(key, "^Data/", ""), F.lit("/"), F.lit(1))
    raw = F.lit("other")
    for folder, name in FOLDERS.items():
        raw = F.when(top == folder, name).otherwise(raw)
    out = F.when(kind.isin(*RAW), raw)
    for name, kinds in KINDS.items():
        out = out.when(kind.isin(*kinds), name)
    return out.otherwise("other")


def job(kind: Column, key: Column, data_job: Column) -> Column:
    """A record's job: of a skill the payload's (``data_job``) or else its number's, of a raw image the one it is named for."""
    raw = F.regexp_extract(F.regexp_replace(key, "^Data/", ""), r"^Skill/(.*)\.img$", 1)
    number = jobs.of_skill(u32(key))
    return (
        F.when(kind == "skill", F.coalesce(data_job.cast("bigint"), number))
        .when(kind == "string/Skill", number)
        .when(kind.isin(*RAW), u32(F.when(raw != "", raw)))
    )


def with_facets(df: DataFrame, data_job: Column | None = None) -> DataFrame:
    """``df`` with category, job, job_name, branch, advancement and detail (raw or data)."""
    none = F.lit(None).cast("bigint")
    kind, key = F.col("kind"), F.col("key")
    out = df.withColumn("category", category(kind, key)).withColumn("job", job(kind, key, none if data_job is None else data_job))
    return jobs.named(out, "job").withColumn("detail", F.when(kind.isin(*RAW), "raw").otherwise("data"))


@dataclass(frozen=True)
class FacetFilter:
    """Allowed values by dimension; an empty dimension allows all. Dimensions hold together, values of one are alternatives.
    A record without job passes no filter on job, branch or advancement."""

    categories: frozenset[str] = field(default=frozenset())
    jobs: frozenset[int] = field(default=frozenset())
    branches: frozenset[str] = field(default=frozenset())
    advancements: frozenset[int] = field(default=frozenset())
    data_only: bool = False

    def add_category(self, slug: str) -> FacetFilter:
        if slug.lower() not in CATEGORIES:
            raise ValueError(f"unknown category {slug!r}")
        return replace(self, categories=self.categories | {slug.lower()})

    def add_job(self, selector: str) -> FacetFilter:
        """A branch by its slug, else a job by number or name."""
        if selector.lower() in jobs.BRANCHES:
            return replace(self, branches=self.branches | {selector.lower()})
        found = jobs.find(selector)
        if found is None:
            raise ValueError(f"unknown job {selector!r}")
        return replace(self, jobs=self.jobs | {found})

    def add_advancement(self, text: str) -> FacetFilter:
        found = jobs.parse_advancement(text)
        if found is None:
            raise ValueError(f"unknown advancement {text!r}")
        return replace(self, advancements=self.advancements | {found})

    def is_empty(self) -> bool:
        return self == FacetFilter()

    def condition(self) -> Column:
        """True for what passes; over the columns of ``with_facets``."""
        out = F.lit(True)
        for name, values in (("category", self.categories), ("job", self.jobs), ("branch", self.branches), ("advancement", self.advancements)):
            if values:
                out = out & F.coalesce(F.col(name).isin(*sorted(values)), F.lit(False))
        return out & (F.col("detail") == "data") if self.data_only else out


def drill_sideways(df: DataFrame, chosen: FacetFilter) -> DataFrame:
    """(dimension, value, n): for every value of category, branch and advancement the rows that would be shown if it were
    the only one chosen of its dimension, all other dimensions staying as chosen (a branch also drops chosen jobs).
    One aggregation over the rows, whatever the number of values."""
    rest = {
        "category": (replace(chosen, categories=frozenset()), list(CATEGORIES)),
        "branch": (replace(chosen, branches=frozenset(), jobs=frozenset()), list(jobs.BRANCHES)),
        "advancement": (replace(chosen, advancements=frozenset()), [a[0] for a in jobs.ADVANCEMENTS]),
    }
    pairs = []
    for dimension, (others, values) in rest.items():
        for v in values:
            hit = others.condition() & F.coalesce(F.col(dimension) == v, F.lit(False))
            pairs.append(F.struct(F.lit(dimension).alias("dimension"), F.lit(str(v)).alias("value"), F.count_if(hit).alias("n")))
    return df.agg(F.array(*pairs).alias("counts")).select(F.explode("counts").alias("c")).select("c.*")


#: Changes of a category that a page shows. A fixed value.
PER_CATEGORY = 100
# The sections of a version's front page and the kinds of records they count.
SECTIONS = {"Equipment": ["string/Eqp"], "Use items": ["string/Consume"], "Etc & setup": ["string/Etc", "string/Ins"], "Monsters": ["string/Mob"], "NPCs": ["string/Npc"], "Maps": ["string/Map"]}


def top_categories(changed: DataFrame, chosen: FacetFilter, every: str | None = None, most: int = PER_CATEGORY) -> DataFrame:
    """The changes to show of each category, with total, the number it has: the first ``most`` by kind and key. No limit holds
    for the category ``every``, nor if just one is chosen."""
    changed = Scratch(changed.sparkSession).save(changed, "changed")  # it is read twice
    whole = F.lit(len(chosen.categories) == 1) | (F.col("category") == F.lit(every or ""))
    place = F.row_number().over(Window.partitionBy("category").orderBy("kind", "key"))
    some = changed.where(~whole).withColumn("rank", place).where(F.col("rank") <= most).drop("rank")
    return some.unionByName(changed.where(whole)).join(changed.groupBy("category").agg(F.count("*").alias("total")), "category")


def sections(counts: DataFrame, sections: dict[str, list[str]] | None = None, by: list[str] | None = None) -> DataFrame:
    """section, n: how many of the counted records (kind, n) each section of kinds has, 0 included; for each group ``by``."""
    by = by or []
    sums = [F.struct(F.lit(s).alias("section"), F.coalesce(F.sum(F.when(F.col("kind").isin(kinds), F.col("n"))), F.lit(0)).alias("n")) for s, kinds in (sections or SECTIONS).items()]
    return counts.groupBy(*by).agg(F.array(*sums).alias("s")).select(*by, F.explode("s").alias("s")).select(*by, "s.*")


def category_counts(df: DataFrame) -> DataFrame:
    """category, n of those that occur; ordered by n, then as the categories are."""
    place = F.array_position(F.array(*(F.lit(c) for c in CATEGORIES)), F.col("category"))
    return df.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), place)
