"""The tree of a client as a table: version_id, path, parent, name, depth, type, value (JSON text of value nodes)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.jsontext import Unreadable, canonical, read
from palimpsest.functions.text import natural_order, preview
from palimpsest.session import ship

#: Types that hold a value; all others hold nodes.
VALUES = ("null", "int", "float", "vector", "string", "uol", "lua", "raw", "video")
# Names under which a node's display name is looked for, in this order.
NAME_KEYS = ("name", "mapName", "streetName", "bookName")


NODES = "version_id bigint, path string, parent string, name string, depth int, type string, value string"
_TYPES = {dict: "prop", list: "vector", str: "string", int: "int", float: "float", bool: "int", type(None): "null"}


def from_records(rows: DataFrame, version_id: int = 1) -> DataFrame:
    """The nodes of images given as JSON objects (path, data): the image, and every member below it; a list is one value.
    Images whose data are no object have no nodes."""
    ship(rows.sparkSession)

    def walk(path: str, value: dict) -> Iterator[tuple]:
        todo = [(path, value, "img")]
        while todo:
            at, x, kind = todo.pop()
            around, _, name = at.rpartition("/")
            yield version_id, at, around, name, at.count("/") + 1, kind, None if isinstance(x, dict) else canonical(x)
            if isinstance(x, dict):
                todo.extend((f"{at}/{k}", v, _TYPES[type(v)]) for k, v in reversed(x.items()))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
        names = [f.split(" ")[0] for f in NODES.split(", ")]
        for batch in source:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    value = read(data)
                except Unreadable:
                    continue
                if isinstance(value, dict) and path is not None:
                    columns = zip(*walk(path, value))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return rows.select("path", "data").mapInArrow(batches, NODES)


def get(nodes: DataFrame, path: str) -> DataFrame:
    """The node at a path; empty path: the root. Raises KeyError naming the first part that is missing."""
    parts = [p for p in path.split("/") if p]
    wanted = ["/".join(parts[: i + 1]) for i in range(len(parts))]
    have = {r.path for r in nodes.where(F.col("path").isin(wanted)).select("path").distinct().collect()} if wanted else set()
    for w in wanted:
        if w not in have:
            raise KeyError(f"{path!r}: no node named {w.rsplit('/', 1)[-1]!r}")
    return nodes.where(F.col("path") == "/".join(parts))


def images(nodes: DataFrame) -> DataFrame:
    """All images, by path."""
    return nodes.where("type = 'img'").orderBy("path")


def children(nodes: DataFrame, path: str) -> DataFrame:
    """The nodes directly below a path."""
    return nodes.where((F.col("parent") == path) & (F.col("path") != ""))


def subtree(nodes: DataFrame, path: str, depth: int = 0) -> DataFrame:
    """The node and what lies below it, ``depth`` levels (0: all)."""
    below = F.col("path").startswith(path + "/") if path else F.lit(True)
    steps = F.size(F.split("path", "/")) - (len(path.split("/")) if path else 0)
    return nodes.where((F.col("path") == path) | (below & (F.lit(depth == 0) | (steps <= depth))))


def display_names(nodes: DataFrame) -> DataFrame:
    """(version_id, parent, title): the first text child among ``NAME_KEYS`` of every node that has one."""
    rank = F.array_position(F.array(*(F.lit(k) for k in NAME_KEYS)), F.col("name"))
    text = nodes.where((F.col("type") == "string") & F.col("name").isin(*NAME_KEYS))
    title = F.get_json_object(F.concat(F.lit('{"v":'), F.min_by("value", rank), F.lit("}")), "$.v")
    return text.groupBy("version_id", "parent").agg(title.alias("title"))


def listing(nodes: DataFrame) -> DataFrame:
    """version_id, parent, name, type and what is shown of every node: a preview of its value, or else its display name."""
    titles = display_names(nodes).withColumnRenamed("parent", "path")
    kids = nodes.where(F.col("path") != "").join(titles, ["version_id", "path"], "left")
    shown = F.when(F.col("type").isin(*VALUES), preview(F.col("value"), 100)).otherwise(F.col("title"))
    return kids.select("version_id", "parent", "name", "type", shown.alias("shown"))


def ls(nodes: DataFrame, path: str) -> DataFrame:
    """name, type and what is shown of a path's children, in natural order."""
    near = nodes.where((F.col("parent") == path) | F.col("parent").startswith(path + "/") | F.lit(path == ""))
    return listing(near).where(F.col("parent") == path).select("name", "type", "shown").orderBy(*natural_order(F.col("name")))
