"""JSON as text: strict reading at any depth, and a canonical form whose equality is equality of the values."""

from __future__ import annotations

import hashlib
import json
import re
from json.decoder import scanstring
from typing import Any

_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_SPACE = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None}


class Unreadable(ValueError):
    """The text is not JSON."""


def _refuse(token: str) -> None:
    raise Unreadable(token)


def _deep(text: str) -> Any:
    """Reads without recursion, for texts nested deeper than the interpreter's stack."""
    root: list = []
    stack: list[tuple[Any, Any]] = [(root, None)]
    at = _SPACE.match(text, 0).end()
    want = "value"
    while True:
        box, key = stack[-1]
        if want == "value":
            if at >= len(text):
                raise Unreadable("end")
            c = text[at]
            if c in "{[":
                new: Any = {} if c == "{" else []
                stack.append((new, None))
                at = _SPACE.match(text, at + 1).end()
                if text[at : at + 1] == ("}" if c == "{" else "]"):
                    value, at = new, at + 1
                    stack.pop()
                else:
                    want = "key" if c == "{" else "value"
                    continue
            elif c == '"':
                value, at = scanstring(text, at + 1, True)
            elif m := _NUMBER.match(text, at):
                value, at = (float(m[0]) if m[1] or m[2] else int(m[0])), m.end()
            else:
                word = next((w for w in _WORDS if text.startswith(w, at)), None)
                if word is None:
                    raise Unreadable(text[at : at + 10])
                value, at = _WORDS[word], at + len(word)
            while True:  # put the value where it belongs; close what ends with it
                box, key = stack[-1]
                if isinstance(box, dict):
                    box[key] = value
                else:
                    box.append(value)
                at = _SPACE.match(text, at).end()
                if box is root:
                    if at != len(text):
                        raise Unreadable("more text")
                    return root[0]
                c = text[at : at + 1]
                if c == ",":
                    at = _SPACE.match(text, at + 1).end()
                    want = "key" if isinstance(box, dict) else "value"
                    break
                if c != ("}" if isinstance(box, dict) else "]"):
                    raise Unreadable(c or "end")
                value, at = box, at + 1
                stack.pop()
        else:
            if text[at : at + 1] != '"':
                raise Unreadable("name")
            key, at = scanstring(text, at + 1, True)
            stack[-1] = (box, key)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise Unreadable("colon")
            at = _SPACE.match(text, at + 1).end()
            want = "value"


def read(text: Any) -> Any:
    """The value of a JSON text; raises Unreadable for None, blank or broken text, NaN and Infinity."""
    if not isinstance(text, str):
        raise Unreadable("no text")
    try:
        try:
            return json.loads(text, parse_constant=_refuse)
        except RecursionError:
            return _deep(text)
    except Unreadable:
        raise
    except ValueError as e:
        raise Unreadable(str(e)) from e


def clean(text: str) -> str:
    """``text`` without lone surrogates, which no column can hold."""
    return text if text.isascii() else text.encode("utf-8", "surrogatepass").decode("utf-8", "replace")


def _scalar(value: Any) -> str:
    out = json.dumps(value, ensure_ascii=False)
    if out.isascii():
        return out
    try:
        out.encode("utf-8")
    except UnicodeEncodeError:  # a lone surrogate stays an escape
        return json.dumps(value)
    return out


def canonical(value: Any) -> str:
    """Compact text with sorted names; ``1`` and ``1.0`` stay different, as payload hashes tell them apart."""
    if not isinstance(value, (dict, list)):
        return _scalar(value)
    out: list[str] = []
    todo: list[Any] = [("v", value)]
    while todo:
        kind, x = todo.pop()
        if kind == "t":
            out.append(x)
        elif isinstance(x, dict):
            todo.append(("t", "}"))
            names = sorted(x)
            for i, name in reversed(list(enumerate(names))):
                todo.append(("v", x[name]))
                todo.append(("t", ("," if i else "") + _scalar(name) + ":"))
            todo.append(("t", "{"))
        elif isinstance(x, list):
            todo.append(("t", "]"))
            for i in range(len(x) - 1, -1, -1):
                todo.append(("v", x[i]))
                if i:
                    todo.append(("t", ","))
            todo.append(("t", "["))
        else:
            out.append(_scalar(x))
    return "".join(out)


def digest(text: Any) -> bytes | None:
    """16 bytes that are equal for texts equal as JSON; unreadable text stands for itself, None for None."""
    if text is None:
        return None
    try:
        form = "j" + canonical(read(text))
    except Unreadable:
        form = "t" + text.strip()
    return hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest()
