"""Records from the tree of nodes.

An image is the unit: its nodes form one document, built by the task that has them. The registry keeps extractors by
name in the order they run.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.canon import content_hash
from palimpsest.functions.jsontext import canonical, read
from palimpsest.session import ship
from palimpsest.sources.nodes import NODES, VALUES  # noqa: F401

_IMAGE = r"^(.*?\.img)(?:/.*)?$"


class _Tree:
    """The nodes of one image by path."""

    def __init__(self, rows: pd.DataFrame):
        self.type = dict(zip(rows["path"], rows["type"]))
        self.value = dict(zip(rows["path"], rows["value"]))
        self.kids: dict[str, list[tuple[str, str]]] = {}
        for path, parent, name in zip(rows["path"], rows["parent"], rows["name"]):
            self.kids.setdefault(parent, []).append((name, path))

    def below(self, path: str) -> list[tuple[str, str]]:
        return self.kids.get(path, [])

    def json(self, path: str, depth: int | None = None):  # noqa: ANN201
        """A node's value, or its children as an object; with ``depth`` what lies deeper is a count of children."""
        if self.type[path] in VALUES:
            return read(self.value[path]) if isinstance(self.value[path], str) else None
        own = read(self.value[path]) if isinstance(self.value[path], str) else {}
        out = dict(own) if isinstance(own, dict) else {}
        if depth == 0:
            return out | {"_children": len(self.below(path))} if self.below(path) else out
        return out | {name: self.json(p, None if depth is None else depth - 1) for name, p in self.below(path)}

    def is_entry(self, name: str, path: str) -> bool:
        return name.isascii() and name.isdigit() and any(self.type[p] in VALUES for _, p in self.below(path))


def entries(nodes: DataFrame) -> DataFrame:
    """version_id, path: the nodes of a numeric name that have a value among their children."""
    held = nodes.where(F.col("type").isin(*VALUES)).select("version_id", F.col("parent").alias("path")).distinct()
    named = nodes.where(F.col("name").rlike("^[0-9]+$") & ~F.col("type").isin(*VALUES, "img"))
    return named.join(held, ["version_id", "path"], "left_semi").select("version_id", "path")


def _by_image(nodes: DataFrame, build: Callable[[str, _Tree], list[dict]], prefix: str) -> DataFrame:
    ship(nodes.sparkSession)
    image = F.regexp_extract("path", _IMAGE, 1)
    rows = nodes.withColumn("image", image).where(F.col("image").startswith(prefix) if prefix else F.col("image") != "")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, version = pdf["image"].iloc[0], pdf["version_id"].iloc[0]
        found = build(at, _Tree(pdf))
        return pd.DataFrame([(version, r["kind"], r["key"], r["data"]) for r in found], columns=["version_id", "kind", "key", "data"])

    rows = rows.select("version_id", "image", "path", "parent", "name", "type", "value")
    return rows.groupBy("version_id", "image").applyInPandas(run, "version_id bigint, kind string, key string, data string")


def strings(nodes: DataFrame) -> DataFrame:
    """(version_id, kind, key, data): every entry (a node of a numeric name with a value among its children) of the images below
    ``String/``. Its key is its path inside the image, its data its children without those that are entries."""
    def build(image: str, tree: _Tree) -> list[dict]:
        kind = "string/" + image.removeprefix("String/").removesuffix(".img")
        out = []
        for path in tree.type:
            name = path.rsplit("/", 1)[-1]
            if path != image and tree.is_entry(name, path):
                data = {n: tree.json(p) for n, p in tree.below(path) if not tree.is_entry(n, p)}
                out.append({"kind": kind, "key": path[len(image) + 1 :], "data": canonical(data)})
        return out

    return _by_image(nodes, build, "String/")


def images(nodes: DataFrame) -> DataFrame:
    """(version_id, kind, key, hash): the content hash of every image; no payload."""
    whole = _by_image(nodes, lambda image, tree: [{"kind": "img", "key": image, "data": canonical(tree.json(image))}], "")
    return whole.select("version_id", "kind", "key", content_hash(F.col("data")).alias("hash"))


def skills(nodes: DataFrame) -> DataFrame:
    """(version_id, kind, key, data): the skills of ``Skill/<job>.img``, with their texts of ``String/Skill.img``: job, name, desc,
    max_level, req, invisible, element, common, icon and levels (their stats without objects and ``hs``, and the text ``h<level>``)."""
    def texts(image: str, tree: _Tree) -> list[dict]:
        return [{"kind": "", "key": n, "data": canonical(tree.json(p))} for n, p in tree.below(image)]

    def raw(image: str, tree: _Tree) -> list[dict]:
        job = image.removeprefix("Skill/").removesuffix(".img")
        if not (job.isascii() and job.isdigit()):
            return []
        return [{"kind": job, "key": n, "data": canonical(tree.json(p))} for n, p in tree.below(f"{image}/skill")]

    left = _by_image(nodes, raw, "Skill/").withColumnRenamed("kind", "job")
    right = _by_image(nodes.where("path = 'String/Skill.img' or path like 'String/Skill.img/%'"), texts, "String/Skill.img")
    both = left.join(right.select("version_id", "key", F.col("data").alias("texts")), ["version_id", "key"], "left")

    @F.pandas_udf("string")
    def merge(jobs: pd.Series, data: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([canonical(skill_payload(int(j), read(d), read(t) if isinstance(t, str) else {})) for j, d, t in zip(jobs, data, names)])

    return both.select("version_id", F.lit("skill").alias("kind"), "key", merge("job", "data", "texts").alias("data"))


def skill_payload(job: int, node: dict, texts: dict) -> dict:
    """A skill's payload of its node and its texts."""
    said = {k: v for k, v in texts.items() if isinstance(v, str)} if isinstance(texts, dict) else {}
    node = node if isinstance(node, dict) else {}
    out: dict = {"job": job} | {k: said[k] for k in ("name", "desc") if k in said}
    levels: dict = {}
    steps = node.get("level")
    for n, stats in (steps.items() if isinstance(steps, dict) else ()):
        if isinstance(stats, dict):
            levels[n] = {k: v for k, v in stats.items() if k != "hs" and not isinstance(v, dict)}
            if f"h{n}" in said:
                levels[n]["text"] = said[f"h{n}"]
    top = node["common"].get("maxLevel") if isinstance(node.get("common"), dict) else None
    if isinstance(top, str):
        top = int(top) if top.isascii() and top.isdigit() else None
    out["max_level"] = len(levels) or (top if type(top) is int and top >= 0 else 0)
    if isinstance(node.get("req"), dict):
        out["req"] = node["req"]
    if "invisible" in node and not (type(node["invisible"]) is int and node["invisible"] == 0):
        out["invisible"] = True
    for name, there in (("element", "elemAttr"), ("common", "common")):
        if there in node:
            out[name] = node[there]
    out["icon"] = "icon" in node
    return out | ({"levels": levels} if levels else {})


#: Extractors by name, in the order they run.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"strings": strings, "skills": skills, "images": images}


def chosen(only: list[str] | None = None) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The extractors of these names, all if there are none; ValueError if none fits."""
    out = {n: f for n, f in EXTRACTORS.items() if not only or n in only}
    if not out:
        raise ValueError(f"no such extractor; there are {', '.join(EXTRACTORS)}")
    return out


def node_path(kind, key):  # noqa: ANN001, ANN201
    """The node a record was read from; null for records without one. Columns in, column out."""
    from palimpsest.functions.jobs import of_skill
    from palimpsest.functions.text import u32

    skill = F.format_string("Skill/%03d.img/skill/%s", of_skill(u32(key)), key)
    string = F.concat(F.lit("String/"), F.regexp_replace(kind, "^string/", ""), F.lit(".img/"), key)
    return F.when(kind == "img", key).when(kind == "skill", F.when(u32(key).isNotNull(), skill)).when(kind.startswith("string/"), string)


def nodes_from_json(text: str, version_id: int = 1) -> list[tuple]:
    """Node rows of a client tree written as nested JSON; for tests and small trees. Names ending in ``.img`` are images."""
    out: list[tuple] = [(version_id, "", None, "", 0, "file", None)]

    def walk(value, path: str, name: str, depth: int) -> None:  # noqa: ANN001
        parent = path.rsplit("/", 1)[0] if "/" in path else ""
        kind = {dict: "img" if name.endswith(".img") else "prop", list: "vector", str: "string", int: "int", float: "float", bool: "int", type(None): "null"}[type(value)]
        if kind == "prop" and ".img" not in path:
            kind = "dir"
        out.append((version_id, path, parent, name, depth, kind, None if isinstance(value, dict) else json.dumps(value)))
        for n, v in value.items() if isinstance(value, dict) else ():
            walk(v, f"{path}/{n}", n, depth + 1)

    for n, v in json.loads(text).items():
        walk(v, n, n, 1)
    return out


def node_json(nodes: DataFrame, path: str, depth: int = 0) -> str:
    """A node as indented JSON, ``depth`` levels of it (0: all). ``nodes`` is what ``sources.nodes.subtree`` gives of it."""
    rows = nodes.where(F.col("path").isNotNull()).dropDuplicates(["path"]).select("path", "parent", "name", "type", "value").toPandas()
    return json.dumps(_Tree(rows).json(path, depth or None), indent=2, ensure_ascii=False, sort_keys=True)
