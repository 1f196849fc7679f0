"""Text expressions: matching, ordering and display forms."""

from __future__ import annotations

import re
import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = r"[\p{IsAlphabetic}\p{N}'%]+|[^\p{IsAlphabetic}\p{N}'%]"


def escape_like(text: str) -> str:
    """``text`` as a LIKE pattern that matches only itself."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def ascii_lower(col: Column) -> Column:
    """Lower case for ASCII letters only."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def like(col: Column, pattern: str) -> Column:
    """LIKE without regard to the case of ASCII letters; other letters compare as they are. ``\\`` escapes."""
    return ascii_lower(col).like(pattern.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def kind_is(col: Column, kind: str | None) -> Column:
    """Whether a kind equals ``kind`` or lies below it (``string`` holds ``string/Eqp``, not ``stringy``); None: any."""
    return F.lit(True) if kind is None else (col == kind) | like(col, escape_like(kind) + "/%")


def key_is(col: Column, key: str) -> Column:
    """Whether a key equals ``key`` or ends with it as a whole path."""
    return (col == key) | like(col, "%/" + escape_like(key))


def tokens(col: Column) -> Column:
    """Runs of letters, digits, ``'`` and ``%``; every other character by itself."""
    return F.regexp_extract_all(col, F.lit(_TOKEN), F.lit(0))


def u64(col: Column) -> Column:
    """The number of a text of ASCII digits (a leading ``+`` allowed) up to 2^64 - 1, else null."""
    n = F.when(col.rlike(r"^\+?[0-9]{1,25}$"), col.try_cast("decimal(30,0)"))
    return F.when(n <= F.lit("18446744073709551615").cast("decimal(30,0)"), n)


def u32(col: Column) -> Column:
    """Like ``u64``, up to 2^32 - 1, as BIGINT."""
    return F.when(u64(col) <= 4294967295, u64(col).cast("bigint"))


def natural_order(col: Column) -> list[Column]:
    """Sort keys: numeric names by number, then all others by text."""
    n = u64(col)
    return [n.isNull(), n, col]


def truncated(col: Column, most: int) -> Column:
    """One line of at most ``most`` characters, the last an ellipsis if it was cut."""
    line = F.replace(F.replace(col, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit(""))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def preview(col: Column, most: int) -> Column:
    """``truncated``, with a sign for what is missing."""
    return F.coalesce(truncated(col, most), F.lit("∅"))


def markdown_value(col: Column) -> Column:
    """A value between back quotes, its own turned into apostrophes."""
    return F.concat(F.lit("`"), F.replace(preview(col, 120), F.lit("`"), F.lit("'")), F.lit("`"))


def human_bytes(col: Column) -> Column:
    """A size with one decimal in B, KiB, MiB or GiB."""
    out = F.format_string("%.1f GiB", col / 1024.0**3)
    for unit, power in (("MiB", 2), ("KiB", 1), ("B", 0)):
        out = F.when(col < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", col / F.lit(1024.0**power))).otherwise(out)
    return out


def short_time(col: Column) -> Column:
    """The date and time of an RFC 3339 text, without fraction and zone."""
    return F.substring(col, 1, 19)


def minute(col: Column) -> Column:
    """Date and minute of an RFC 3339 text, with a space between."""
    return F.replace(F.substring(col, 1, 16), F.lit("T"), F.lit(" "))


def rfc3339(seconds: Column) -> Column:
    """Unix seconds as RFC 3339 in UTC, to the millisecond where there is one."""
    ms = F.round(seconds * 1000).cast("bigint")
    text = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.when(F.pmod(ms, F.lit(1000)) == 0, "").otherwise(F.format_string(".%03d", F.pmod(ms, F.lit(1000))))
    return F.concat(text, part, F.lit("+00:00"))


def utf16_path(col: Column) -> Column:
    """A path from base64 of UTF-16 with a byte order mark; an odd byte at the end is dropped."""
    raw = F.unbase64(col)
    even = F.substring(raw, F.lit(1), (F.floor(F.length(raw) / 2) * 2).cast("int"))
    return F.decode(even, "UTF-16")


def object_path(hash_: Column) -> Column:
    """Where an object of that hash lies: a folder of its first two characters."""
    return F.concat(F.substring(hash_, 1, 2), F.lit("/"), hash_)


_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]+:(//[^/]*)?"


def relative_path(col: Column, root: str) -> Column:
    """A file's path below ``root``, with ``/`` between its parts; either may name a file system and its host."""
    path = F.regexp_replace(F.regexp_replace(col, r"\\", "/"), _SCHEME, "")
    return F.regexp_replace(path, "^/*" + re.escape(re.sub(_SCHEME, "", root.replace("\\", "/")).strip("/")) + "/+", "")


def summary(col: Column) -> Column:
    """The first line of a description without a prefix in brackets, breaks before it and ``#``."""
    text = F.regexp_replace(F.regexp_replace(col, r"^\s*\[[^\]]*\]", ""), r"^(\s|\\n)+", "")
    return F.trim(F.replace(F.split_part(text, F.lit("\\n"), F.lit(1)), F.lit("#"), F.lit("")))


def value_text(col: Column) -> Column:
    """A JSON text for reading: strings bare, lists of two as a pair."""
    pair = F.from_json(col, "array<string>")
    bare = F.get_json_object(F.concat(F.lit('{"v":'), col, F.lit("}")), "$.v")
    return (
        F.when(col.startswith('"'), bare)
        .when(col.startswith("[") & (F.size(pair) == 2), F.concat(F.lit("("), pair[0], F.lit(", "), pair[1], F.lit(")")))
        .otherwise(col)
    )


def key_values(data: Column) -> Column:
    """A JSON object as a list of name and text for reading, by name; objects inside are how many entries they have."""
    entry = lambda k, v: F.when(v.startswith("{"), F.concat(F.size(F.from_json(v, "map<string,string>")).cast("string"), F.lit(" entries"))).otherwise(value_text(v))
    names = F.array_sort(F.json_object_keys(data))
    raw = F.from_json(data, "map<string,variant>")
    return F.transform(names, lambda k: F.struct(k.alias("name"), entry(k, F.to_json(raw[k])).alias("text")))


def url_query(col: Column) -> Column:
    """Percent-encoded but for ASCII letters and digits."""
    out = F.url_encode(col)
    for plain, code in (("+", "%20"), ("*", "%2A"), ("-", "%2D"), (".", "%2E"), ("_", "%5F")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def url_path(col: Column) -> Column:
    """A path whose parts are percent-encoded where a part may not hold the character; ``/`` stays."""
    coded = lambda c: F.when(c.rlike(r'[^!$-;=@-_a-z|~]|[%?\x60]'), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)
    return F.array_join(F.transform(F.split(col, ""), coded), "")


def listed(col: Column) -> Column:
    """The values of a list written with commas, without blanks around them and empty ones."""
    return F.filter(F.transform(F.split(col, ","), lambda x: F.trim(x)), lambda x: x != "")


def toggled(col: Column, value: Column) -> Column:
    """A list written with commas without ``value`` where it was there first, else with it at the end."""
    items = listed(col)
    at = F.array_position(items, value).cast("int")
    rest = F.concat(F.slice(items, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(items, F.greatest(at, F.lit(0)) + 1, F.size(items)))
    return F.array_join(F.when(at > 0, rest).otherwise(F.concat(items, F.array(value))), ",")


_CODE = re.compile(r"\\n|#[cbrekn]?|[<>&\"]")
_ENTITY = {"<": "&lt;", ">": "&gt;", "&": "&amp;", '"': "&quot;"}


def mark_up(text: str | None) -> str | None:
    """Game text as HTML: a literal ``\\n`` breaks the line, ``#c`` (also b, r, e) begins a mark that the next ``#`` ends."""
    if text is None:
        return None
    marked = False

    def put(m: re.Match) -> str:
        nonlocal marked
        code = m[0]
        if code == "\\n":
            return "<br>"
        if code[0] != "#":
            return _ENTITY[code]
        end, marked = ("</mark>" if marked else ""), code[1:] in ("c", "b", "r", "e") and code != "#"
        return end + ("<mark>" if marked else "")

    out = _CODE.sub(put, text.replace("\\r", "").replace("�", " "))
    return out + ("</mark>" if marked else "")


@F.pandas_udf(T.StringType())
def game_html(texts: pd.Series) -> pd.Series:
    """``mark_up`` of a column."""
    return texts.map(mark_up)


def ranges(levels: Column) -> Column:
    """Sorted whole numbers as ranges: 1–3, 5, 7–8. Repeats count once."""
    numbers = F.array_sort(F.array_distinct(levels))
    islands = F.aggregate(
        numbers,
        F.array().cast("array<struct<a:bigint,b:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] == x - 1),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), x.cast("bigint").alias("b")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x.cast("bigint").alias("a"), x.cast("bigint").alias("b"))))),
    )
    text = lambda i: F.when(i["a"] == i["b"], i["a"].cast("string")).otherwise(F.concat(i["a"].cast("string"), F.lit("–"), i["b"].cast("string")))
    return F.array_join(F.transform(islands, text), ", ")
