"""Skills read from their payloads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import jobs
from palimpsest.functions.text import u32
from palimpsest.session import ship

_LEVELS = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))
SKILL = T.StructType(
    [
        T.StructField("job", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("desc", T.StringType()),
        T.StructField("max_level", T.LongType()),
        T.StructField("req", T.MapType(T.StringType(), T.LongType())),
        T.StructField("invisible", T.BooleanType()),
        T.StructField("icon", T.BooleanType()),
        T.StructField("levels", _LEVELS),
    ]
)


def _read(text: str | None) -> dict | None:
    from palimpsest.functions.jsontext import Unreadable, canonical, read

    try:
        d = read(text)
    except Unreadable:
        return None
    d = d if isinstance(d, dict) else {}
    number = lambda v: v if type(v) is int and 0 <= v < 1 << 63 else None
    text_ = lambda v: v if isinstance(v, str) else None
    object_ = lambda v: v if isinstance(v, dict) else {}
    return {
        "job": number(d.get("job")), "name": text_(d.get("name")), "desc": text_(d.get("desc")), "max_level": number(d.get("max_level")) or 0,
        "req": {k: v for k, v in object_(d.get("req")).items() if number(v) is not None},
        "invisible": d.get("invisible") is True, "icon": d.get("icon") is True,
        "levels": {k: {n: canonical(x) for n, x in v.items()} for k, v in object_(d.get("levels")).items() if isinstance(v, dict)},
    }


@F.pandas_udf(SKILL)
def skill_fields(texts: pd.Series) -> pd.DataFrame:
    """A skill's payload, type-strict: members that are absent or of another type are null, 0, false or empty."""
    return pd.DataFrame([_read(t) or _read("{}") for t in texts], columns=SKILL.names)


def skills(records: DataFrame, blobs: DataFrame, version_id: int | None = None) -> DataFrame:
    """id, job, name, desc, max_level, req, invisible, has_icon, levels of a version's skills; levels as JSON texts. Of no
    version: the skills of all, with version_id."""
    ship(records.sparkSession)
    rows = records.where(F.col("kind") == "skill")
    rows = rows if version_id is None else rows.where(F.col("version_id") == version_id)
    kept = ["version_id"] if version_id is None else []
    data = rows.join(blobs.select(F.col("hash").alias("blob_hash"), "data"), "blob_hash", "left").select(*kept, F.col("key").alias("id"), skill_fields("data").alias("s"))
    number = F.coalesce(jobs.of_skill(u32(F.col("id"))), F.lit(0))
    return data.select(
        *kept, "id", F.coalesce("s.job", number).alias("job"), "s.name", "s.desc", "s.max_level", "s.req", "s.invisible", F.col("s.icon").alias("has_icon"), "s.levels"
    )


def is_listed() -> Column:
    """Visible, named and with levels."""
    return ~F.col("invisible") & F.col("name").isNotNull() & (F.col("max_level") > 0)


def labelled(df: DataFrame) -> DataFrame:
    """With label (the name, or one made of the id) and icon_path."""
    icon = F.format_string("Skill/%03d.img/skill/%s/icon", F.col("job"), F.col("id"))
    return df.withColumn("label", F.coalesce("name", F.concat(F.lit("Skill "), "id"))).withColumn("icon_path", F.when(F.col("has_icon"), icon))


def per_job(df: DataFrame) -> DataFrame:
    """job, skills, listed."""
    return df.groupBy("job").agg(F.count("*").alias("skills"), F.count_if(is_listed()).alias("listed"))


def index(df: DataFrame) -> DataFrame:
    """branch, job, job_name, advancement, listed: the jobs that have a listed skill, with how many."""
    counts = df.where(is_listed()).groupBy("job").agg(F.count("*").alias("listed"))
    return jobs.named(counts, "job").select("branch", "job", "job_name", "advancement", "listed")


def job_page(df: DataFrame, job: int) -> DataFrame:
    """The skills of a job: id, label, max_level, listed, and the names and levels of what each needs."""
    return needs(df).where(F.col("job") == job).select("id", "label", "max_level", "listed", "needs")


def needs(df: DataFrame) -> DataFrame:
    """id, job, label, max_level, listed and needs (a list of name and level, by id) of skills; the name of a skill that is not
    there is its id."""
    all_ = labelled(df).withColumn("listed", is_listed())
    names = all_.select(F.col("id").alias("need"), F.col("label").alias("name"))
    each = all_.select("id", F.explode("req").alias("need", "level")).join(names, "need", "left")
    each = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("need", F.coalesce("name", "need").alias("name"), "level"))).alias("n"))
    told = F.coalesce(F.transform("n", lambda x: F.struct(x["name"].alias("name"), x["level"].alias("level"))), F.array().cast("array<struct<name:string,level:bigint>>"))
    return all_.join(each, "id", "left").select("id", "job", "label", "max_level", "listed", told.alias("needs"))


def stat_names(df: DataFrame) -> DataFrame:
    """id, stats: the names of a skill's stats over all levels, sorted, without text."""
    names = F.flatten(F.transform(F.map_values("levels"), lambda m: F.map_keys(m)))
    return df.select("id", F.array_sort(F.array_except(F.array_distinct(names), F.array(F.lit("text")))).alias("stats"))
