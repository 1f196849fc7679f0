"""Nested records into flat, linked tables, by interval labels.

A depth-first walk gives every node of a document its pre-order and post-order number. An object holds another exactly
if its interval does, so node tables of any type join by containment within a record, and the nearest object around
a node is the last one opened before it that is not yet closed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.jsontext import Unreadable, canonical, clean, read
from palimpsest.session import ship

#: Nodes sent on at once: bounds a batch whatever the size of the records in it.
NODES = 20_000

_NODE = "pre bigint, post bigint, depth int, type string, name string, path string, parent_pre bigint, parent_path string, value string"


def unwrap(value: Any) -> Any:
    """A string that holds an object or a list (also one wrapped more than once) as what it holds."""
    held = value
    while isinstance(held, str) and held.lstrip()[:1] in ("{", "[", '"'):
        try:
            held = read(held)
        except Unreadable:
            return value
    return held if isinstance(held, (dict, list)) else value


def label(value: Any) -> Iterator[list]:
    """Nodes of a document in pre-order: [pre, post, depth, type, name, path, value, whether it is a member of an object]; post
    counts up as nodes close. An object's value are its members that are values: also those that are text, but for texts
    that hold an object or a list."""
    nodes: list[list] = []
    closed = 0
    todo: list[tuple] = [("open", unwrap(value), "", "", 0)]
    while todo:
        what, x, name, path, depth = todo.pop()
        if what == "close":
            nodes[x][1] = closed
            closed += 1
            continue
        kind = "object" if isinstance(x, dict) else "list" if isinstance(x, list) else "value"
        pre = len(nodes)
        if kind == "object":
            x = {k: unwrap(v) for k, v in x.items()}
        flat = {k: v for k, v in x.items() if not isinstance(v, (dict, list))} if kind == "object" else x
        nodes.append([pre, -1, depth, kind, name, path, None if kind == "list" else canonical(flat), what == "member"])
        todo.append(("close", pre, "", "", 0))
        if kind != "value":
            inner = x.items() if kind == "object" else enumerate(x)
            join = path + "/" if depth else ""
            kin = "member" if kind == "object" else "open"
            todo.extend((kin, v if kind == "object" else unwrap(v), clean(str(k)), clean(f"{join}{k}"), depth + 1) for k, v in reversed(list(inner)))
    return iter(nodes)


def link(nodes: Iterator[list]) -> Iterator[list]:
    """Adds parent_pre and parent_path: the nearest object whose interval holds the node's (-1 and '' if there is none)."""
    around: list[list] = []
    for node in nodes:
        pre, post = node[0], node[1]
        while around and around[-1][1] < post:
            around.pop()
        top = around[-1] if around else None
        yield [*node[:6], top[0] if top else -1, top[5] if top else "", node[6], node[7]]
        if node[3] == "object":
            around.append(node)


def shred(records: DataFrame, keys: list[str], data: str = "data", types: tuple[str, ...] = ("object", "list", "value"), members: bool = True) -> DataFrame:
    """The nodes of the JSON texts in ``data``: the columns ``keys``, then pre, post, depth, type (object, list or value),
    name, path, parent_pre, parent_path (of the nearest object around it) and value (JSON text of a value; of an object,
    the text of its members that are values; null for a list). Without ``members`` values that are members of an object,
    whose own row holds them, get no rows: what is left still holds every value once (``rebuild`` puts it together).

    path is the member names and 0-based list positions joined by ``/``, '' for the outermost. Objects and lists
    stored as text count as what they hold. Null, blank or unreadable data yield nothing; a record that is repeated
    yields its nodes each time; of a member named twice the last counts. Only ``types`` are given out. A record's nodes
    stay within its row's task, and leave it in batches. Key columns must not be named like one of the node's columns.
    """
    ship(records.sparkSession)
    wanted = frozenset(types)
    fields = [f.strip().split(" ") for f in _NODE.split(",")]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    clash = {n for n, _ in fields} & set(keys)
    if clash:
        raise ValueError(f"key columns named like node columns: {sorted(clash)}")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            held, rows = [], []
            column = batch.column(len(keys))

            def flush() -> pa.RecordBatch:
                at = pa.array(held, pa.int64())
                columns = [batch.column(i).take(at) for i in range(len(keys))]
                columns += [pa.array([r[i] for r in rows], arrow[t]) for i, (_, t) in enumerate(fields)]
                return pa.RecordBatch.from_arrays(columns, names=[*keys, *(n for n, _ in fields)])

            for i in range(batch.num_rows):
                try:
                    value = read(column[i].as_py())
                except Unreadable:
                    continue
                for node in link(label(value)):
                    if node[3] in wanted and (members or node[3] != "value" or not node[9]):
                        held.append(i)
                        rows.append(node)
                        if len(rows) >= NODES:
                            yield flush()
                            held, rows = [], []
            if rows:
                yield flush()

    schema = ", ".join([*(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys), _NODE])
    return records.select(*keys, F.col(data)).mapInArrow(batches, schema)


def objects(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, parent_path): one row per object except the outermost; repeats of a record merge."""
    return nodes.where("type = 'object' and depth > 0").select(*keys, "path", "parent_path").distinct()


def rebuild(nodes: list[tuple[str, str, str | None]]) -> Any:
    """The document of its nodes (path, type, value) in pre-order, with or without rows of members; texts that held objects
    or lists come back as what they held. Paths must be plain: no member name holds a ``/``."""
    made: dict[str, Any] = {}
    for path, kind, value in nodes:
        x = {} if kind == "object" else [] if kind == "list" else read(value)
        if kind == "object":
            x.update(read(value))
        made[path] = x
        if path:
            around, _, name = path.rpartition("/")
            box = made[around]
            if isinstance(box, list):
                box.append(x)
            else:
                box[name] = x
    return made.get("")
