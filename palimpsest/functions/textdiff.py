"""Differences between two texts by words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Token pairs up to which a longest common subsequence is searched; beyond it the differing middle is replaced whole.
#: A fixed value, part of the result's definition.
MAX_CELLS = 1_000_000

SEGMENTS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType())]))


def split(text: str) -> list[str]:
    """Runs of letters, digits, ``'`` and ``%``; every other character by itself."""
    out: list[str] = []
    inside = False
    for c in text:
        word = c.isalnum() or c in "'%"
        if word and inside:
            out[-1] += c
        else:
            out.append(c)
        inside = word
    return out


def _align(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """(op, token) along a longest common subsequence; where both ways are as long, the old token goes first."""
    rows = [[0] * (len(b) + 1)]
    for x in reversed(a):
        below, row = rows[-1], [0]
        for j in range(len(b) - 1, -1, -1):
            row.append(below[j + 1] + 1 if x == b[j] else max(below[j], row[-1]))
        rows.append(row[::-1])
    rows.reverse()
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("same", a[i]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and rows[i + 1][j] >= rows[i][j + 1]):
            out.append(("removed", a[i]))
            i += 1
        else:
            out.append(("added", b[j]))
            j += 1
    return out


def segments(old: str, new: str) -> list[dict[str, str]]:
    """The two texts as runs of op (same, removed, added) and text."""
    a, b = split(old), split(new)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    middle = [("removed", t) for t in x] + [("added", t) for t in y] if len(x) * len(y) > MAX_CELLS else _align(x, y)
    out: list[dict[str, str]] = []
    for op, token in [*(("same", t) for t in a[:head]), *middle, *(("same", t) for t in a[len(a) - tail :])]:
        if out and out[-1]["op"] == op:
            out[-1]["text"] += token
        else:
            out.append({"op": op, "text": token})
    return out


@F.pandas_udf(SEGMENTS)
def word_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """``segments`` of two columns; null if either is null."""
    return pd.Series([None if a is None or b is None else segments(a, b) for a, b in zip(old, new)])


def inline(diff: Column) -> Column:
    """One line of segments: ``same [-removed-]{+added+}``."""
    mark = lambda s: F.when(s["op"] == "removed", F.concat(F.lit("[-"), s["text"], F.lit("-]"))).when(s["op"] == "added", F.concat(F.lit("{+"), s["text"], F.lit("+}"))).otherwise(s["text"])
    return F.array_join(F.transform(diff, mark), "")


def similarity(diff: Column) -> Column:
    """Bytes that stay, of these and the greater of those removed and added; 1 for two empty texts."""
    size = lambda op: F.aggregate(F.filter(diff, lambda s: s["op"] == op), F.lit(0), lambda n, s: n + F.octet_length(s["text"]))
    same = size("same")
    every = same + F.greatest(size("added"), size("removed"))
    return F.when(every == 0, F.lit(1.0)).otherwise(same / every)


#: Share of two texts that must stay for their words to be marked. A fixed value.
ALIKE = 0.3


def marked(diff: Column) -> tuple[Column, Column, Column]:
    """``inline``, where its first mark is (1 if there is none), and ``similarity``."""
    line = inline(diff)
    first = F.least(*(F.when(F.instr(line, m) > 0, F.instr(line, m)) for m in ("[-", "{+")))
    return line, F.coalesce(first, F.lit(1)), similarity(diff)


def around(line: Column, first: Column) -> Column:
    """A line from 40 characters before ``first`` on, 140 of them at most."""
    from palimpsest.functions.text import truncated

    start = F.greatest(first - 41, F.lit(1))
    return F.concat(F.when(start > 1, "…").otherwise(""), truncated(F.substring(line, start, F.length(line)), 140))


def display(diff: Column, old: Column, new: Column) -> Column:
    """How a report shows an edited text: its marked words if enough of it stays, else both texts, 60 characters each."""
    from palimpsest.functions.text import preview

    line, first, alike = marked(diff)
    return F.when(alike >= ALIKE, around(line, first)).otherwise(F.concat(preview(old, 60), F.lit(" -> "), preview(new, 60)))
