"""Text decoded with the wrong character encoding: found, and restored where possible.

A smoothed character n-gram model is trained on the clean records of the corpus itself. Every chain of encoding back
with one codec and decoding with another is a candidate for every run of text it can apply to; the model scores
original and candidates, and a record is garbled if its likeliest restorations gain a margin or more, which is
validated on all words of the corpus, as they are and garbled on purpose.
"""

from __future__ import annotations

import codecs
import html
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import Scratch, ship

#: Counters of the model's hashed n-gram table to begin with, and at most (64 MB as int64). The table grows fourfold while
#: more than ``FULL`` of it is taken, so that n-grams seldom share a counter.
TABLE, MOST_TABLE, FULL = 1 << 20, 1 << 23, 0.5
#: Gains are told apart to this part of one where the margin is validated, and up to this one.
STEP, TOP = 1 / 16, 32.0
#: Weight of the shorter n-gram, in counts per character of training: grows with the corpus, since what garbling is left in
#: the training does so too and must not look regular anywhere.
SMOOTH = 5e-6
#: Share of an unknown character among all, whatever the size of the corpus.
UNKNOWN = 1e-8
#: Characters of a token that are scored together: longer ones stand in languages without spaces, and once garbled.
PIECE = 48
#: A token of less gain does not keep its record out of the training.
FLOOR = 2.0
#: Share of the words garbled on purpose that a margin must find for the share of those garbled unnoticed to be told by it.
SURE = 0.97
#: Errors, as a share of what is garbled, up to which margins count as equally good.
TOLERATED = 0.005
#: The margin where there is nothing to validate it on: no clean text beyond ASCII.
UNVALIDATED = 10.0
#: Common wrong readings, (written in, read in), that the validation garbles with; the first can write every text.
COMMON = (("utf_8", "cp1252"), ("utf_8", "mac_roman"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp850"))
#: Rounds of restoring, for text garbled more than once or in more than one way.
ROUNDS = 4

#: Single-byte codecs that text is wrongly read in. Bytes a codec leaves undefined are read as control characters.
READ_IN = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254", "koi8_r", "cp866", "iso8859_2", "iso8859_5")
#: Codecs that it was written in.
WRITTEN_IN = ("utf_8", "cp932", "euc_jp", "cp949", *READ_IN)

_HIDDEN = re.compile("(?<=[\x00-\x7f])[\u00ad\u200b-\u200f\u2060\ufeff]+(?=[\x00-\x7f]|$)")
_HARD = re.compile("(?<=[\x00-\x7f])\u00a0+(?=[\x00-\x7f]|$)")
_SPLIT = re.compile(r"(\\n|[ \t\r\n]+)")
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{1,7}|#x[0-9a-fA-F]{1,6});")
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_MULTI = frozenset({"utf_8", "cp932", "euc_jp", "cp949"})
_LOST = "�"
_CONTROL = re.compile("[\x80-\x9f]")


def _maps(codec: str) -> dict[int, int]:
    out = {}
    for b in range(256):
        try:
            c = ord(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            c = b
        out.setdefault(c, b)
    for b in range(0x80, 0xA0):
        out.setdefault(b, b)
    return out


_ENCODE = {c: _maps(c) for c in READ_IN}
_RUN = {c: re.compile("[" + "".join(re.escape(chr(x)) for x in m if x > 32) + "]*[" + "".join(re.escape(chr(x)) for x in m if x > 127) + "][" + "".join(re.escape(chr(x)) for x in m if x > 32) + "]*") for c, m in _ENCODE.items()}
_DECODE = {c: "".join(chr(next((k for k, v in m.items() if v == b and (k > 0x9F or b < 0x80)), b)) for b in range(256)) for c, m in _ENCODE.items()}


def _decode(raw: bytes, codec: str) -> str:
    if codec in _MULTI:
        return raw.decode(codec, "replace")
    return codecs.charmap_decode(raw, "strict", _DECODE[codec])[0]


def options(token: str) -> dict[tuple[str, str], str]:
    """What the token may have been, by chain: (wrongly read in, written in). Chains that change nothing are left out."""
    found: dict[tuple[str, str], str] = {}
    done: dict[tuple, dict[str, str]] = {}
    for read in READ_IN:
        run, table = _RUN[read], _ENCODE[read]
        runs = [(m.start(), m.end(), codecs.charmap_encode(m[0], "strict", table)[0]) for m in run.finditer(token)]
        if not runs:
            continue
        key = tuple(runs)
        if key not in done:
            done[key] = {written: _replaced(token, runs, written) for written in WRITTEN_IN}
        found |= {(read, written): new for written, new in done[key].items() if written != read and new != token}
    return found


def _replaced(token: str, runs: list[tuple[int, int, bytes]], written: str) -> str:
    out, at = [], 0
    for a, b, raw in runs:
        out += [token[at:a], _utf8(token[a:b], raw) if written == "utf_8" else _decode(raw, written)]
        at = b
    return "".join(out) + token[at:]


def _utf8(text: str, raw: bytes) -> str:
    """``text``, one character a byte of ``raw``, with its valid UTF-8 sequences decoded."""
    out, at = [], 0
    for m in _UTF8.finditer(raw):
        try:
            out += [text[at : m.start()], m[0].decode("utf_8")]
        except UnicodeDecodeError:
            continue
        at = m.end()
    return "".join(out) + text[at:]


_SPACING = "\u00ad\u2060\ufeff\u200b\u200c\u200d\u200e\u200f\u00a0"


def tokens(text: str) -> list[str]:
    """The pieces between white space (and a literal ``\\n``) that hold a character beyond ASCII or an entity. Hidden
    characters and hard spaces that follow ASCII are spacing, not remains of a wrong reading."""
    if text.isascii():
        return [t for t in _pieces(text) if "&" in t and _ENTITY.search(t)] if "&" in text else []
    if any(c in text for c in _SPACING):
        text = _HARD.sub(" ", _HIDDEN.sub("", text))
    if "&" in text:
        return [t for t in _pieces(text) if t and (not t.isascii() or _ENTITY.search(t))]
    return [t for t in _pieces(text) if not t.isascii()]


def _pieces(text: str) -> list[str]:
    return text.replace("\\n", " ").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _framed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' code points in one array, each text between two spaces and one; and where each begins and ends in
    what ``_slots`` gives of it."""
    points = np.frombuffer("".join(f"  {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    return points, begins, begins + sizes - 2


def _slots(p: np.ndarray, n: int, slots: int) -> np.ndarray:
    """The counters, of ``slots`` (a power of two), of the n-grams that end at each position from the third on."""
    with np.errstate(over="ignore"):
        h = np.full(len(p) - 2, n, np.uint64)
        for i in range(n):
            h = (h ^ p[2 - i : len(p) - i]) * _K[i]
            h ^= h >> np.uint64(29)
        return ((h * _K[0]) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


#: What a lost character may have been: the upper characters of the single-byte codecs.
_FILL = sorted({c for read in READ_IN for c in _DECODE[read][128:] if c.isalpha() or c in "’‘“”–—…«»°§½±©"})


class Model:
    """Interpolated trigrams over hashed counts; log probabilities of whole tokens. ``best`` need not tell gains below
    ``least``: tokens that can't reach it are not tried; nor gains above ``enough``: further rounds are left out."""

    def __init__(self, counts: np.ndarray, least: float = 0.0, enough: float = float("inf")):
        self.counts = counts.astype(np.float64)
        self.size = len(counts) - 1
        self.least, self.enough = least, enough
        self.total = float(max(1, counts[-1]))
        self.prior = max(0.5, SMOOTH * self.total)
        self.cache: dict[str, tuple[float, str]] = {}
        self.single: dict[str, list[tuple[tuple[str, str], float, str]]] = {}
        self.fills: dict[tuple[str, str], str] = {}

    def _steps(self, p: np.ndarray) -> np.ndarray:
        n, size = self.counts, self.size
        before = np.concatenate([p[:1], p[:-1]])
        p1 = (n[_slots(p, 1, size)] / self.total + UNKNOWN) / (1 + UNKNOWN * 65536)
        p2 = (n[_slots(p, 2, size)] + self.prior * p1) / (n[_slots(before, 1, size)] + self.prior)
        p3 = (n[_slots(p, 3, size)] + self.prior * p2) / (n[_slots(before, 2, size)] + self.prior)
        return np.log(np.minimum(p3, 1.0))

    def logs(self, texts: list[str]) -> np.ndarray:
        """The log probability of each text, rounded so that equals stay equal whatever they are scored with."""
        p, begins, ends = _framed(texts)
        whole = np.concatenate([[0.0], np.cumsum(self._steps(p))])
        return np.round(whole[ends] - whole[begins], 6)

    def reach(self, texts: list[str]) -> np.ndarray:
        """The most that any chain can gain on each text: what its n-grams cost that a chain can change. A chain changes
        characters beyond ASCII and the one behind them; all n-grams without these stay as they are."""
        p, begins, ends = _framed(texts)
        far = p > 127
        near = far[2:] | far[1:-1] | far[:-2] | np.concatenate([[False], far[:-3]])
        whole = np.concatenate([[0.0], np.cumsum(np.where(near, self._steps(p), 0.0))])
        return whole[begins] - whole[ends]

    def filled(self, token: str) -> list[str]:
        """A token that holds lost characters (U+FFFD), without them and with the likeliest of ``_FILL`` in their places,
        from the left on. Only to tell what the loss costs: no text is restored by it."""
        out = ""
        for i, c in enumerate(token):
            if c == _LOST:
                near = (out[-2:], token[i + 1 : i + 3])
                if near not in self.fills:
                    if len(self.fills) > 50_000:
                        self.fills.clear()
                    self.fills[near] = _FILL[int(np.argmax(self.logs([near[0] + x + near[1] for x in _FILL])))]
                c = self.fills[near]
            out += c
        return [token.replace(_LOST, ""), out]

    def learn(self, texts: list[str]) -> None:
        """Works out ``best`` for the tokens, many at once. A token longer than ``PIECE`` gains what the best of its pieces
        does; the others are not tried once one gains ``enough``."""
        if len(self.cache) > 200_000:
            self.cache.clear()
        new = [t for t in dict.fromkeys(texts) if t not in self.cache]
        short = [t for t in new if len(t) <= PIECE]
        for i in range(0, len(short), 256):
            self._learn(short[i : i + 256])
        going = [(t, html.unescape(t) if "&" in t else t, 0.0, "") for t in new if len(t) > PIECE]
        for at in range(0, max((len(x) for _, x, _, _ in going), default=0), PIECE):
            pieces = [x[at : at + PIECE] for _, x, _, _ in going]
            once = [x for x in dict.fromkeys(pieces) if x not in self.cache and not x.isascii()]
            for i in range(0, len(once), 256):
                self._learn(once[i : i + 256])
            on = []
            for (t, whole, most, said), x in zip(going, pieces):
                gain, best = self.cache.get(x, (0.0, x))
                most, said = max(most, gain), said + best
                if most >= self.enough or at + PIECE >= len(whole):
                    self.cache[t] = (most, said + whole[at + PIECE :]) if most > 0 else (0.0, t)
                else:
                    on.append((t, whole, most, said))
            going = on

    def _learn(self, texts: list[str]) -> None:
        tries = {t: (0.0, html.unescape(t) if "&" in t else t) for t in texts}
        going = texts
        if self.least:
            most = self.reach([tries[t][1] for t in going])
            going = [t for t, m in zip(going, most) if m >= self.least]
        for _ in range(ROUNDS):
            flat: list[str] = []
            spans = []
            for t in going:
                at = tries[t][1]
                new = [*dict.fromkeys(options(at).values()), *(self.filled(at) if _LOST in at else ())]
                spans.append((len(flat), len(flat) + 1 + len(new)))
                flat += [at, *new]
            if not flat:
                break
            logs = self.logs(flat)
            on = []
            for t, (a, b) in zip(going, spans):
                i = a + int(np.argmax(logs[a:b]))
                if i > a:
                    tries[t] = (tries[t][0] + float(logs[i] - logs[a]), flat[i])
                    if tries[t][0] < self.enough:
                        on.append(t)
            going = on
        for t, (gain, new) in tries.items():
            self.cache[t] = (gain, new) if gain > 0 else (0.0, t)

    def best(self, token: str) -> tuple[float, str]:
        """How much the likeliest chain gains over the token as it is (0: none does), and what it gives."""
        if token not in self.cache:
            self.learn([token])
        return self.cache[token]

    def gaining(self, texts: list[str]) -> dict[str, list[tuple[tuple[str, str], float, str]]]:
        """Of each token the single chains that gain on it: (chain, gain, what it gives)."""
        if len(self.single) > 20_000:
            self.single.clear()
        new = [t for t in texts if t not in self.single]
        for at in range(0, len(new), 256):
            tries = [(t, options(t)) for t in new[at : at + 256]]
            flat = [x for t, o in tries for x in (t, *dict.fromkeys(o.values()))]
            logs = dict(zip(flat, self.logs(flat)))
            for t, o in tries:
                self.single[t] = [(chain, gain, x) for chain, x in o.items() if (gain := float(logs[x] - logs[t])) > 0]
        return {t: self.single[t] for t in texts}


def plainly_garbled(text: str) -> bool:
    """Holds characters that only lost or misread bytes leave, U+FFFD or C1 controls: nothing to train on."""
    return _LOST in text or bool(_CONTROL.search(text))


_READ_1252 = re.compile("[" + "".join(re.escape(_DECODE["cp1252"][b]) for b in range(0xC2, 0xF5)) + "][" + "".join(re.escape(_DECODE["cp1252"][b]) for b in range(0x80, 0xC0)) + "]")


def suspicious(text: str) -> bool:
    """UTF-8 read as cp1252 in all likelihood: kept out of the first training."""
    return bool(_READ_1252.search(text))


def count(texts: Iterable[str], skip: Model | None = None, slots: int = TABLE) -> np.ndarray:
    """Hashed uni-, bi- and trigram counts of the tokens of clean texts; the last slot holds the number of characters.
    Clean is what holds nothing plainly garbled and, with a model to ask, no token that it would restore."""
    table = np.zeros(slots + 1, np.int64)
    held: list[str] = []
    size = 0

    def flush() -> None:
        p, begins, ends = _framed(held)
        inside = np.zeros(len(p) - 1, np.int64)
        inside[begins] += 1
        np.subtract.at(inside, ends, 1)
        inside = np.cumsum(inside)[:-1].astype(bool)
        for n in (1, 2, 3):
            table[:slots] += np.bincount(_slots(p, n, slots)[inside], minlength=slots)
        table[slots] += int(inside.sum())

    for text, found in learned(texts, skip):
        if plainly_garbled(text) or _ENTITY.search(text) or (skip is None and suspicious(text)):
            continue
        if skip is not None and most(found, skip) >= FLOOR:
            continue
        held += found
        size += len(text)
        if size > 1 << 20:
            if held:
                flush()
            held, size = [], 0
    if held:
        flush()
    return table


def learned(texts: Iterable[str], model: Model | None, size: int = 200) -> Iterator[tuple[str, list[str]]]:
    """Each text with its tokens, which the model has learnt, ``size`` texts at a time."""
    rest = iter(texts)
    while group := [(t, tokens(t)) for t in islice(rest, size)]:
        if model is not None:
            model.learn([x for _, found in group for x in found])
        yield from group


def most(found: list[str], model: Model) -> float:
    """The most that restoring one of the tokens gains."""
    return max((model.best(t)[0] for t in found), default=0.0)


def gain(text: str, model: Model) -> float:
    """The most that restoring one token of the text gains."""
    found = tokens(text)
    model.learn(found)
    return most(found, model)


def _texts(batch: pa.RecordBatch, column: int) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


_KEPT: dict[str, Model] = {}


def _model(shared: Broadcast, name: str, least: float, enough: float = float("inf")) -> Model:
    """The model of a broadcast table; a worker keeps it, with what it has learnt, from task to task."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Model(shared.value, least, enough)
    return _KEPT[name]


def _training(skip: Broadcast | None, slots: int):
    name = uuid.uuid4().hex

    def count_all(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None if skip is None else _model(skip, name, FLOOR, FLOOR)
        table = count((t for b in source for t in _texts(b, 0)), model, slots)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], names=["slot", "n"])

    return count_all


def distinct_texts(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """The texts beyond ASCII, once each, as a written table: copies teach nothing new, and a garbled text copied often
    enough would pass for clean."""
    return scratch.save(docs.select(text).where(F.col(text).rlike(r"[^\x00-\x7f]")).distinct(), "texts")


def train(docs: DataFrame, text: str = "text", slots: int = TABLE) -> np.ndarray:
    """The n-gram table of all clean texts of ``distinct_texts``, in two passes: the second leaves out what the first would
    restore. Of the corpus only the table's sums come to the driver. A table that fills is counted again with four times
    the counters, up to ``MOST_TABLE``."""
    ship(docs.sparkSession)
    counts = None
    while True:
        shared = None if counts is None else docs.sparkSession.sparkContext.broadcast(counts)
        parts = docs.select(text).mapInArrow(_training(shared, slots), "slot int, n bigint")
        sums = parts.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        new = np.zeros(slots + 1, np.int64)
        new[sums["slot"].to_numpy()] = sums["n"].to_numpy()
        if np.count_nonzero(new[:-1]) > FULL * slots and slots < MOST_TABLE:
            slots *= 4
        elif counts is None:
            counts = new
        else:
            return new


def reading(text: str) -> tuple[str, str]:
    """The one of the ``COMMON`` wrong readings, (written in, read in), that a hash of the text says, or the next that can
    write all of it."""
    first = zlib.crc32(text.encode("utf_8", "replace"))
    for i in range(len(COMMON)):
        chain = COMMON[(first + i) % len(COMMON)]
        try:
            text.encode(chain[0])
        except UnicodeEncodeError:
            continue
        return chain
    return COMMON[0]


def spoilt(word: str) -> str:
    """The word garbled on purpose by its ``reading``."""
    written, read = reading(word)
    return codecs.charmap_decode(word.encode(written, "ignore"), "strict", _DECODE[read])[0]


#: What is measured: words as they are, and garbled on purpose. Gains from ``TOP`` on share the last step.
_CLEAN, _SPOILT = range(2)
_STEPS = int(TOP / STEP) + 1


def gains(words: Iterable[tuple[str, int]], model: Model, size: int = 500) -> np.ndarray:
    """How many of the words, as they are and garbled on purpose, gain how many ``STEP``s; each word with the number of texts
    that hold it. Words that hold something plainly garbled are left out, and so are garbled ones that come out as they
    were."""
    table = np.zeros((2, _STEPS), np.int64)
    rest = ((w, n) for w, n in words if not (plainly_garbled(w) or suspicious(w)))
    while group := [*islice(rest, size)]:
        wrong = [(tokens(x), n) for w, n in group if (x := spoilt(w)) != w]
        model.learn([*(w for w, _ in group), *(t for x, _ in wrong for t in x)])
        for kind, each in ((_CLEAN, (([w], n) for w, n in group)), (_SPOILT, wrong)):
            for found, n in each:
                table[kind, min(int(most(found, model) / STEP), _STEPS - 1)] += n
    return table


def _validation(shared: Broadcast, name: str):
    def measure(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gains((x for b in source for x in zip(_texts(b, 0), b.column(1).to_pylist())), _model(shared, name, 0.0, TOP))
        kind, at = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(table[kind, at])], names=["kind", "at", "n"])

    return measure


def _words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        held = Counter(w for t in _texts(batch, 0) for w in {*tokens(t)})
        yield pa.RecordBatch.from_arrays([pa.array([*held], pa.string()), pa.array([*held.values()], pa.int64())], names=["word", "n"])


def measured(docs: DataFrame, counts: np.ndarray, text: str = "text") -> np.ndarray:
    """``gains`` of all words beyond ASCII of all texts, whatever their length. Every different word is scored once, in the
    one task that holds it; only the counts come to the driver."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    words = docs.select(text).where(F.col(text).rlike(r"[^\x00-\x7f]")).mapInArrow(_words, "word string, n bigint")
    # Few bytes, much work: partitions of a fixed number, which are not put together for being small.
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    words = words.repartition(parts, "word").groupBy("word").agg(F.sum("n").alias("n"))
    told = words.mapInArrow(_validation(shared, uuid.uuid4().hex), "kind int, at int, n bigint")
    sums = told.groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((2, _STEPS), np.int64)
    table[sums["kind"].to_numpy(), sums["at"].to_numpy()] = sums["n"].to_numpy()
    return table


def margin(docs: DataFrame, counts: np.ndarray, text: str = "text") -> float:
    """The gain from which a text counts as garbled, by ``threshold`` of what ``measured`` counts over all texts."""
    return threshold(measured(docs, counts, text))


def threshold(table: np.ndarray) -> float:
    """The margin with the fewest errors by the counted gains of words as they are and garbled on purpose. A text gains what
    the best of its words does, so that a single garbled word is the hardest to find.

    Some of the words that pass for clean are garbled, a share p. With G the share of them that gains so much and S the
    share of those garbled on purpose, a margin between what clean and garbled words gain finds G = p S; p is the median
    of G / S over the margins where S is ``SURE`` or more. A margin then makes G - p S false rows, if that is above 0, and
    misses p (1 - S), so that what is garbled unnoticed does not move the best margin. The middle of the margins around
    the best one is taken that make no more errors than it and ``TOLERATED`` times p."""
    upto = lambda counts: np.cumsum(counts[::-1])[::-1] / max(1, counts.sum())
    if not table[_CLEAN].any() or not table[_SPOILT].any():
        return UNVALIDATED
    g, s = (upto(t)[1:] for t in (table[_CLEAN], table[_SPOILT]))  # no margin of 0
    sure = s >= min(SURE, s[0])
    p = float(np.median(g[sure] / s[sure]))
    errors = np.maximum(0.0, g - p * s) + p * (1 - s)
    low = high = int(errors.argmin())
    fair = errors <= errors[low] + max(TOLERATED * p, 0.5 / table[_CLEAN].sum())
    while low and fair[low - 1]:
        low -= 1
    while high + 1 < len(errors) and fair[high + 1]:
        high += 1
    return float((low + high) / 2 + 1) * STEP


def restore(text: str, model: Model, bound: float, found: list[str] | None = None) -> tuple[bool, str, bool]:
    """Whether the text is garbled, the likeliest original, and whether nothing of it stays lost.

    The chain that gains most over the whole text is undone wherever it gains; then the next, up to ``ROUNDS``. ``found``:
    the text's tokens, if the model has learnt them."""
    if (gain(text, model) if found is None else most(found, model)) < bound:
        return False, text, True
    parts = [html.unescape(p) if _ENTITY.search(p) else p for p in _SPLIT.split(text)]
    for _ in range(ROUNDS):
        often = Counter(p for p in parts if not p.isascii())
        tries = model.gaining([p for p in often if tokens(p)])
        sums: Counter[tuple[str, str]] = Counter()
        for t, gaining in tries.items():
            for chain, by, _ in gaining:
                sums[chain] += by * often[t]
        best = max(sums, key=lambda c: (sums[c], c), default=None)
        if best is None or sums[best] < bound:
            break
        to = {t: new for t, gaining in tries.items() for chain, _, new in gaining if chain == best}
        parts = [to.get(p, p) for p in parts]
    fixed = "".join(parts)
    return True, fixed, _LOST not in fixed and not _CONTROL.search(fixed)


def garbled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: np.ndarray | None = None, bound: float | None = None, restored: bool = True, slots: int = TABLE) -> DataFrame:
    """(doc_id, restored, complete): every document that holds text decoded with the wrong encoding, in whole or part, with
    its likeliest original; complete is false where characters are lost for good. Without ``restored`` doc_id alone.

    Garbled is what holds a token some chain of wrong readings (``READ_IN``) and right ones (``WRITTEN_IN``), up to
    ``ROUNDS`` of them one upon the other and HTML entities undone first, gains the margin or more on; a lost character
    (U+FFFD) is scored against the likeliest in its place. Clean accents, symbols and quotes stay: the model knows them
    from the corpus. ``counts`` and ``bound`` are trained and validated on ``docs`` unless they are given; ``slots`` (a
    power of two) is the size of the table to begin with. Null, blank and plain ASCII texts are never garbled; copies
    count each; whole texts are scored whatever their length. Other columns are not read, and an empty table gives an
    empty result.
    """
    ship(docs.sparkSession)
    if counts is None or bound is None:
        scratch = Scratch(docs.sparkSession)
        once = distinct_texts(docs, scratch, text)
        counts = train(once, text, slots) if counts is None else counts
        bound = margin(once, counts, text) if bound is None else bound
        scratch.drop("texts")
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}[doc_id]

    name = uuid.uuid4().hex

    def find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared, name, bound, bound)
        known: dict[str, tuple[str, bool]] = {}  # a garbled text may be copied often
        for batch in source:
            at, fixed, whole = [], [], []
            for i, (t, found) in enumerate(learned(_texts(batch, 1), model)):
                if most(found, model) < bound:
                    continue
                at.append(i)
                if restored:
                    if t not in known:
                        if len(known) >= 500:
                            known.clear()
                        known[t] = restore(t, model, bound, found)[1:]
                    fixed.append(known[t][0])
                    whole.append(known[t][1])
            columns = [batch.column(0).take(pa.array(at, pa.int64()))]
            if restored:
                columns += [pa.array(fixed, pa.string()), pa.array(whole, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[doc_id, "restored", "complete"][: len(columns)])

    return docs.select(doc_id, text).mapInArrow(find, f"`{doc_id}` {kind}" + (", restored string, complete boolean" if restored else ""))
