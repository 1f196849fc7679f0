"""Text of small tables, and where lines go."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Row


def table(rows: list[Row], columns: list[str]) -> Iterator[str]:
    """Lines of a table of bounded size."""
    cells = [columns, *[["" if r[c] is None else str(r[c]) for c in columns] for r in rows]]
    wide = [max(len(c[i]) for c in cells) for i in range(len(columns))]
    for line in cells:
        yield "  ".join(c.ljust(w) for c, w in zip(line, wide)).rstrip()


def emit(lines: Iterable[str], out: str | None = None) -> None:
    """Writes lines to a file, or to standard output, which always gets its last line's end."""
    if out:
        Path(out).write_text("\n".join(lines), encoding="utf-8")
    else:
        for line in lines:
            sys.stdout.write(line + "\n")
