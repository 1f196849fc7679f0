"""Evaluation texts leaking into training text, by pigeonhole edit matching.

A passage leaks if some run of ``window`` successive words of an item occurs with at most ``errors`` words changed or
missing. Cut into errors + 1 pieces, such a run keeps at least one piece unharmed, so the exact hits of the items'
pieces find every candidate, and Myers' bit-parallel distance over words decides each. The pieces of all items make one
sorted index, broadcast up to ``BLOCK_WORDS`` words of items (beyond that one pass over the documents per block);
documents are only ever read in place, without a shuffle.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import gather, ship

#: Words of an item that make a passage, and how many of them may be changed or missing.
WINDOW, ERRORS = 12, 2
#: Words of items in one index: bounds what is broadcast (20 bytes a word, and the vocabulary) and what a worker holds.
BLOCK_WORDS = 4_000_000
#: A leading sentence before so many different bodies is an instruction.
SHARED = 5

_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_BREAK = re.compile(r"\\[nrt]|<\s*/?\s*(?:br|p|div|li)\b[^<>]{0,80}>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>")
_COLOUR = re.compile(r"#c([^#]*)#")
_QUOTE = re.compile(r"(?<=\w)['’‘ʼ`´](?=\w)")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.?!:])\s+")


class _Plain(dict):
    """Characters without accents and in their plain forms, told once each."""

    def __missing__(self, point: int) -> str:
        self[point] = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        return self[point]


_PLAIN = _Plain()


def words(text: str | None) -> list[str]:
    """The words of a text without case, accents, punctuation, spacing and markup (tags, ``#c…#``, a literal ``\\n``,
    entities, soft hyphens); an apostrophe inside a word joins it. None and blank texts have none."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    text = _HIDDEN.sub("", text)
    if "\\" in text or "<" in text:
        text = _TAG.sub("", _BREAK.sub(" ", text))
    if "#" in text:
        text = _COLOUR.sub(r"\1", text)
    if not text.isascii():
        text = text.translate(_PLAIN)
    return _WORD.findall(_QUOTE.sub("", text).casefold())


def parts(text: str | None, instructions: frozenset[str]) -> tuple[list[str], list[str]]:
    """The words of the instructions that an item starts with, and those of the rest."""
    rest = (text or "").strip()
    head: list[str] = []
    while rest:
        first, _, more = _SENTENCE.sub("\n", rest, count=1).partition("\n")
        if " ".join(words(first)) not in instructions:
            break
        head += words(first)
        rest = more
    return head, words(rest)


def body(text: str | None, instructions: frozenset[str]) -> list[str]:
    """The words of an item after the instructions that it starts with."""
    return parts(text, instructions)[1]


def distance(pattern: list, text: list, most: int) -> int:
    """The least edit distance between ``pattern`` and any part of ``text``, by Myers' bit vectors; stops at 0."""
    m = len(pattern)
    at: dict = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score, best = full, 0, m, m
    for w in text:
        eq = at.get(w, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        up = minus | ~(d | plus) & full
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full
        plus = (down << 1 & full) | ~(d | up) & full
        minus = up & d
        if score < best:
            best = score
            if not best:
                break
    return best


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _keys(codes: np.ndarray, n: int) -> np.ndarray:
    """One number for each ``n`` successive codes."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
        for i in range(n):
            out = (out + codes[i : len(codes) - n + 1 + i].astype(np.uint64) + np.uint64(1)) * _PRIME
            out ^= out >> np.uint64(31)
    return out


class Matcher:
    """The pieces of items, sorted by their keys. ``items``: id, words and how many of the words are no passage by
    themselves but an instruction before it."""

    def __init__(self, items: list[tuple], window: int, errors: int):
        self.window, self.errors, self.piece = window, errors, window // (errors + 1)
        self.ids = [i[0] for i in items]
        self.heads = [i[2] if len(i) > 2 else 0 for i in items]
        codes: dict[str, int] = {}
        self.coded = np.fromiter((codes.setdefault(w, len(codes)) for i in items for w in i[1]), np.int32)
        self.vocabulary = list(codes)
        sizes = np.array([len(i[1]) for i in items], np.int64)
        self.ends = np.cumsum(sizes)
        at = np.arange(max(0, len(self.coded) - self.piece + 1))
        owner = np.searchsorted(self.ends, at, "right")
        at = at[(at + self.piece <= self.ends[owner]) & (sizes[owner] >= window)] if len(at) else at
        keys = _keys(self.coded, self.piece)[at]
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order].astype(np.int32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "codes"}

    def find_all(self, texts: list[list[str]]) -> list[dict[int, bool]]:
        """Of each text the items (by place) that it holds a passage of, and whether only together with the item's head."""
        if not hasattr(self, "codes"):
            self.codes = {w: i for i, w in enumerate(self.vocabulary)}
        get, piece = self.codes.get, self.piece
        flat: list[int] = []
        begins = []
        for ws in texts:
            begins.append(len(flat))
            flat += [get(w, -1) for w in ws]
            flat.append(-1)
        out: list[dict[int, bool]] = [{} for _ in texts]
        if len(flat) < piece or not len(self.keys):
            return out
        codes = np.array(flat, np.int64)
        known = np.cumsum(np.concatenate([[0], codes >= 0]))
        whole = np.flatnonzero(known[piece:] - known[:-piece] == piece)
        keys = _keys(codes, piece)[whole]
        low = np.searchsorted(self.keys, keys, "left")
        hit = self.keys[np.minimum(low, len(self.keys) - 1)] == keys
        high = np.searchsorted(self.keys, keys[hit], "right")
        doc = np.searchsorted(begins, whole[hit], "right") - 1
        last, tried = -1, set()
        for q, a, b, d in zip(whole[hit].tolist(), low[hit].tolist(), high.tolist(), doc.tolist()):
            if d != last:
                last, tried = d, set()
            self._try(flat, q, begins[d], self.at[a:b], tried, out[d])
        return out

    def _try(self, flat: list[int], q: int, begin: int, places: np.ndarray, tried: set, found: dict[int, bool]) -> None:
        window, errors = self.window, self.errors
        for i, p in zip(np.searchsorted(self.ends, places, "right").tolist(), places.tolist()):
            if found.get(i) is False:
                continue
            start, end = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
            for k in range(errors + 1):
                s = p - k * self.piece
                if s < start or s + window > end or (s, q - p) in tried:
                    continue
                head = s < start + self.heads[i]
                if head and i in found:
                    continue
                tried.add((s, q - p))
                wanted = self.coded[s : s + window].tolist()
                near = flat[max(begin, q - (p - s) - errors) : q - (p - s) + window + errors]
                there = set(near)
                if sum(w in there for w in wanted) >= window - errors and distance(wanted, near, errors) <= errors:
                    found[i] = head
                    if not head:
                        break

    def find(self, ws: list[str]) -> list:
        """Ids of the items that ``ws`` holds a passage of."""
        return sorted(self.ids[i] for i, head in self.find_all([ws])[0].items() if not head)


def lead(text: str | None, known: frozenset[str]) -> tuple[str, str] | None:
    """The first sentence of an item that is no known instruction, and its body: the sentence in the middle of its words, so
    that copies of an item have one body and so have several questions on one passage longer than they are. None from the
    body on, which is no instruction."""
    said = [" ".join(ws) for x in _SENTENCE.split((text or "").strip()) if (ws := words(x))]
    sizes = list(accumulate(x.count(" ") + 1 for x in said))
    middle = next((i for i, n in enumerate(sizes) if 2 * n > sizes[-1]), 0)
    first = next((i for i, x in enumerate(said) if x not in known), middle)
    return (said[first], said[middle]) if first < middle else None


def instructions(items: DataFrame, text: str = "text", shared: int = SHARED) -> frozenset[str]:
    """The leading sentences (their words) before at least ``shared`` different bodies, also behind one another, any number
    of them: each round takes those that the items start with behind the ones known. Counted over all items; only those
    shared come to the driver."""
    ship(items.sparkSession)
    known: frozenset[str] = frozenset()
    while True:

        @F.pandas_udf("struct<s: string, body: string>")
        def heads(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([lead(t, known) or (None, None) for t in texts], columns=["s", "body"], dtype=object)

        first = items.select(heads(F.col(text)).alias("h")).select("h.*").where("s is not null").distinct().groupBy("s").agg(F.count("*").alias("n"))
        new = frozenset(r.s for r in gather(first.where(F.col("n") >= shared))) - known
        if not new:
            return known
        known |= new


def blocks(items: DataFrame, item_id: str, text: str, known: frozenset[str], most: int, heads: bool) -> Iterator[list[tuple]]:
    """The items (id, words, words of the head) in lists of at most ``most`` words (more only for one longer item). The words
    are told in the executors and fetched one part at a time. Without ``heads`` only the bodies."""

    @F.pandas_udf("struct<words: string, head: int>")
    def told(texts: pd.Series) -> pd.DataFrame:
        both = [parts(t, known) for t in texts]
        return pd.DataFrame({"words": [" ".join(h + b if heads else b) for h, b in both], "head": [len(h) if heads else 0 for h, _ in both]})

    held: list[tuple] = []
    size = 0
    for r in items.select(F.col(item_id).alias("i"), told(F.col(text)).alias("t")).select("i", "t.*").toLocalIterator():
        ws = r.words.split(" ") if r.words else []
        if held and size + len(ws) > most:
            yield held
            held, size = [], 0
        held.append((r.i, ws, r["head"]))
        size += len(ws)
    if held:
        yield held


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    window: int = WINDOW,
    errors: int = ERRORS,
    block_words: int = BLOCK_WORDS,
    heads: bool = False,
) -> DataFrame:
    """(doc_id, item_id): every document that holds a passage of an item. With ``heads`` also the pairs found only by a
    passage that reaches into the item's instructions, and a column by_head that is true for these.

    A passage is any ``window`` successive words of the item of which at most ``errors`` are changed or missing (a word
    put in between counts like one). Words compare as by ``words``. Instructions that items share are no part of
    them. Items with fewer than ``window`` words have no passage. Null and blank texts match nothing; copies of
    documents count each; a repeated item counts under each of its ids; whole texts are searched whatever their
    length. Other columns are not read, and empty tables give an empty result.
    """
    if window // (errors + 1) < 1:
        raise ValueError("a window needs at least errors + 1 words")
    spark = docs.sparkSession
    ship(spark)
    known = instructions(items, text)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    item_kind = {f.name: f.dataType.simpleString() for f in items.schema.fields}[item_id]
    schema = f"`{doc_id}` {kinds[doc_id]}, `{item_id}` {item_kind}" + (", by_head boolean" if heads else "")
    out = spark.createDataFrame([], schema)
    for block in blocks(items, item_id, text, known, block_words, heads):
        shared = spark.sparkContext.broadcast(Matcher(block, window, errors))
        out = out.union(docs.select(doc_id, text).mapInArrow(_search(shared, heads, [doc_id, item_id, "by_head"]), schema))
    return out


#: Documents looked up at once.
TOGETHER = 64


def _search(shared: Broadcast, heads: bool, names: list[str]):
    def search(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value
        for batch in source:
            at, hit, by = [], [], []
            texts = enumerate(batch.column(1).to_pylist())
            while group := [*islice(texts, TOGETHER)]:
                for (i, _), found in zip(group, matcher.find_all([words(t) for _, t in group])):
                    for item, head in sorted(found.items()):
                        if heads or not head:
                            at.append(i)
                            hit.append(matcher.ids[item])
                            by.append(head)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            columns = [ids, pa.array(hit, pa.string() if hit and isinstance(hit[0], str) else pa.int64()), pa.array(by, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns[: 3 if heads else 2], names=names[: 3 if heads else 2])

    return search
