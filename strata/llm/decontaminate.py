"""Benchmark decontamination by template windows.

A text becomes a sequence of template tokens: runs of letters, lower-cased, and in their
place typed placeholders for numbers (NUM, with inner separators), for units after a
number (UNIT) and for capitalised words (NAME, in a row taken as one; in the probe a word
that opens a sentence counts too, as it may be a name).
Typographic quotes, dashes and spaces are signs like those of ASCII.
Windows of `window` template tokens are hashed. The benchmark's windows form a hash table
that documents probe; where the benchmark is larger than `block_chars`, it is taken in
blocks of that size, each a pass of its own, so what is broadcast stays bounded.

A document holds an item if it has `percent` or more of the item's different windows and
the slots agree: over the matched windows, each value in a slot of the item must stand
for one value in the document, and the other way round, for `percent` of the slots. A copy keeps all slot values;
a re-parameterised question maps them to others, consistently. All places of a window in
the document count: the first places are judged together, and where they do not agree, so
is each stretch that is as long as the item, or longer by what `percent` leaves room for,
and starts where one of its windows does.

Which words are NAME depends on their case. With `case_blind`, as the queries use it, each
item also has windows of its case-folded words without NAME, and a document holds an item
that it holds either way, so copies in capitals or small letters are found too.

Defined cases: a null or empty text holds nothing; an item that is null or has fewer
template tokens than a window never matches; repeated rows match alike; empty tables give
no row; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.bytewords import hash_runs, mix, utf8
from strata.llm.scratch import bound_batches

# Words that are units after a number.
UNITS = """percent km m cm mm mi miles mile feet foot ft inches inch yards kg g mg lb lbs pounds ounces oz tons l ml
litres liters gallons hours hour minutes minute seconds second days day weeks months years year euros euro dollars dollar
cents usd eur gbp mph kmh hz khz mhz ghz kb mb gb tb w kw v a pa bar c f k""".split()

_KIND = np.zeros(256, np.int8)
_KIND[48:58] = 1
_KIND[65:91] = _KIND[97:123] = 2
_KIND[128:] = 2
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n\r|"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14)]] = True


_SIGN = np.ones(256, bool)
_SIGN[[0xAA, 0xB5, 0xBA]] = False


def _capitals() -> np.ndarray:
    """Whether a capital starts with these two bytes, by 256 * first + second."""
    out = np.zeros(1 << 16, bool)
    for c in range(0x41, 0x800):
        if chr(c).isupper():
            raw = chr(c).encode()
            at = raw[0] << 8
            out[at + raw[1] if len(raw) == 2 else slice(at, at + 256)] = True
    return out


_CAPITAL = _capitals()


def _kinds(data: np.ndarray) -> np.ndarray:
    """0 for signs and blanks, 1 for digits, 2 for letters, byte by byte; signs beyond ASCII are told from letters by their block."""
    kind = _KIND[data]
    two = np.flatnonzero(data[:-1] == 0xC2)  # U+0080 to U+00BF: signs but for three letters
    two = two[_SIGN[data[two + 1]]]
    kind[two] = kind[two + 1] = 0
    lead = np.flatnonzero((data[:-2] == 0xE2) | (data[:-2] == 0xE3))
    sign = (data[lead + 1] == 0x80) | ((data[lead] == 0xE2) & (data[lead + 1] == 0x81))
    lead = lead[sign]  # U+2000 to U+207F, U+3000 to U+303F: quotes, dashes, spaces
    kind[lead] = kind[lead + 1] = kind[lead + 2] = 0
    return kind


NUM, UNIT, NAME = (np.uint64(k) for k in (0xA11CE5, 0xB0B0B0, 0xCAFE01))


SLICE = 1000  # rows that are copied at a time


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (data != 32).view(np.int8), [0]))))
    return np.sort(hash_runs(data, edges[::2], edges[1::2]))


_UNITS = _unit_hashes()


def composed(text) -> bytes:
    """UTF-8 bytes with composed accents."""
    raw = bytes(text)
    if raw.isascii():
        return raw
    known = raw.decode("utf-8", "surrogatepass")
    return raw if unicodedata.is_normalized("NFC", known) else unicodedata.normalize("NFC", known).encode("utf-8", "surrogatepass")


def folded(text) -> bytes:
    """UTF-8 bytes without case; A-Z may stay, as hashes do not tell them from a-z."""
    raw = bytes(text)
    return raw if raw.isascii() else raw.decode("utf-8", "surrogatepass").casefold().encode("utf-8", "surrogatepass")


class Parsed:
    """The runs of letters and digits of a text, from which its template follows with or without NAME."""

    def __init__(self, text):
        data = np.frombuffer(text, np.uint8)
        kind = _KIND[data] if bytes(text).isascii() else _kinds(data)
        edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        ends = np.append(edge[1:], len(data))
        real = kind[edge] > 0
        self.data, self.starts, self.ends = data, edge[real], ends[real]
        starts, ends = self.starts, self.ends
        self.hashes = h = hash_runs(data, starts, ends)
        if not len(starts):
            return
        self.number = number = kind[starts] == 1
        gap = np.concatenate(([1 << 30], starts[1:] - ends[:-1]))
        self.blank = _BLANK[data[np.maximum(starts - 1, 0)]] & (gap == 1)
        before_number = np.concatenate(([False], number[:-1]))
        self.joined = number & before_number & (gap == 1) & ~self.blank
        self.unit = np.zeros(len(starts), bool)
        maybe = np.flatnonzero(~number & before_number & (gap <= 1))
        self.unit[maybe] = _UNITS[np.minimum(np.searchsorted(_UNITS, h[maybe]), len(_UNITS) - 1)] == h[maybe]

    def _capital(self, at: np.ndarray) -> np.ndarray:
        last = len(self.data) - 1
        return _CAPITAL[(self.data[np.minimum(at, last)].astype(np.int32) << 8) + self.data[np.minimum(at + 1, last)]]

    def template(self, names: bool, openers: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(template token hashes, slot values; 0 where no slot); NAME only with `names`, for words that open a sentence only with `openers`."""
        h = self.hashes
        if not len(h):
            return h, h
        slot, joined = self.number | self.unit, self.joined
        token = np.where(self.number, NUM, np.where(self.unit, UNIT, h))
        if names:
            at = self._capital(self.starts) & ~slot
            if not openers:
                stops = np.flatnonzero(_END[self.data])
                at[0] = False
                at[1:] &= np.searchsorted(stops, self.starts[1:]) == np.searchsorted(stops, self.ends[:-1])
            at = np.flatnonzero(at)
            start, end = self.starts[at], self.ends[at]
            second = start + 1 + (self.data[start] >= 128)
            name = np.zeros(len(h), bool)
            name[at[(end > second) & ~(self._capital(second) & (second < end))]] = True
            token[name] = NAME
            slot, joined = slot | name, joined | (name & np.concatenate(([False], name[:-1])) & self.blank)
        lead = np.flatnonzero(~joined)
        return token[lead], np.add.reduceat(np.where(slot, h | np.uint64(1), np.uint64(0)), lead)


def template(text, names: bool = True, openers: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(template token hashes, slot values; 0 where no slot) of UTF-8 bytes, as Parsed.template() gives them."""
    return Parsed(text).template(names, openers)


def window_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n tokens, by its first token's position."""
    if len(tokens) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(tokens) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9DDFEA08EB382D69) + tokens[k : k + len(h)]
        h ^= h >> np.uint64(29)
    return mix(h)


class Items:
    """The windows of a block of benchmark items, as a probe table."""

    def __init__(self, items: list[tuple[int, bytes]], window: int, case_blind: bool = False, names: bool = True):
        self.blind = Items([(k, folded(text)) for k, (_, text) in enumerate(items)], window, names=False) if case_blind else None
        self.names, self.index, self.given = names, [], [item_id for item_id, _ in items]
        self.window, self.ids, self.values, self.first, self.needs, self.long = window, [], [], [], [], []
        hashes, owner = [], []
        for k, (item_id, text) in enumerate(items):
            tokens, value = template(composed(text), names, openers=True)
            h, first = np.unique(window_hashes(tokens, window), return_index=True)
            if len(h):
                hashes.append(h)
                owner.append(np.full(len(h), len(self.ids)))
                self.ids.append(item_id)
                self.index.append(k)
                self.values.append(value)
                self.first.append(dict(zip(h.tolist(), first.tolist())))
                self.needs.append(len(h))
                self.long.append(len(tokens) - window + 1)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        o = np.concatenate(owner) if owner else np.zeros(0, np.intp)
        order = np.lexsort((o, h))
        self.all, self.start, self.n = np.unique(h[order], return_index=True, return_counts=True)
        self.owner = o[order]
        self.needs = np.array(self.needs, np.intp)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.all >> np.uint64(42)).astype(np.intp)] = True

    def find(self, text, percent: int):
        """(item id, coverage, consistency, same values) of each item that the text holds."""
        text = composed(text)
        parsed = Parsed(text)
        held = self._held(parsed, percent)
        if self.blind is not None:
            blind = parsed if text.isascii() else Parsed(folded(text))  # hashes do not tell A-Z from a-z
            for k, x in self.blind._held(blind, percent).items():
                if k not in held or (x[3] == 1.0 and held[k][3] < 1.0):
                    held[k] = (self.given[k], *x[1:])
        return [held[k] for k in sorted(held)]

    def _held(self, parsed: Parsed, percent: int) -> dict[int, tuple]:
        """find(), by the item's place in the list given."""
        if not len(self.all):
            return {}
        tokens, value = parsed.template(self.names, openers=True)
        h = window_hashes(tokens, self.window)
        at = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.intp)])
        if not len(at):
            return {}
        k = np.minimum(np.searchsorted(self.all, h[at]), len(self.all) - 1)
        hit = self.all[k] == h[at]
        at, k = at[hit], k[hit]
        n = self.n[k]
        post = np.repeat(self.start[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, where = self.owner[post], np.repeat(at, n)
        order = np.argsort(item, kind="stable")  # places stay in the order of the document
        item, where = item[order], where[order]
        edge = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
        out = {}
        for a, b in zip(edge[:-1], edge[1:]):
            i, at = int(item[a]), where[a:b]
            _, first, kind = np.unique(h[at], return_index=True, return_inverse=True)
            if len(first) * 100 < self.needs[i] * percent:
                continue
            ok, same = self._slots(i, at[first], h, value)
            best = (same == 1.0, ok, same, len(first))
            if same < 1.0 and len(first) < len(at):
                for long in (self.long[i], self.long[i] * 100 // percent):
                    best = max([best, *self._stretches(i, at, kind, h, value, percent, long)])
            _, ok, same, n = best
            if ok * 100 >= percent:
                out[self.index[i]] = (self.ids[i], n / self.needs[i], ok, same)
        return out

    def _stretches(self, i: int, at: np.ndarray, kind: np.ndarray, h: np.ndarray, value: np.ndarray, percent: int, long: int):
        """What each stretch of this length gives that has enough of the item's windows, up to the first copy."""
        seen, end, enough = np.zeros(int(kind.max()) + 1, np.intp), 0, 0
        for start in range(len(at)):
            while end < len(at) and at[end] < at[start] + long:
                enough += seen[kind[end]] == 0
                seen[kind[end]] += 1
                end += 1
            if enough * 100 >= self.needs[i] * percent:
                _, first = np.unique(kind[start:end], return_index=True)
                ok, same = self._slots(i, at[start:end][first], h, value)
                yield same == 1.0, ok, same, len(first)
                if same == 1.0:
                    return
            seen[kind[start]] -= 1
            enough -= seen[kind[start]] == 0

    def _slots(self, i: int, at: np.ndarray, h: np.ndarray, value: np.ndarray) -> tuple[float, float]:
        """Shares of slots that map consistently, and that keep their value."""
        mine = np.array([self.first[i][x] for x in h[at].tolist()])
        shift = np.arange(self.window)
        a = self.values[i][(mine[:, None] + shift).ravel()]
        spots = (at[:, None] + shift).ravel()
        b = value[spots]
        keep = (a != 0) & (b != 0)
        _, once = np.unique(spots[keep], return_index=True)  # each slot of the document once
        a, b = a[keep][once], b[keep][once]
        if not len(a):
            return 1.0, 1.0
        pair, n = np.unique(np.stack((a, b)), axis=1, return_counts=True)
        agree = min(sum(int(n[side == v].max()) for v in np.unique(side)) for side in pair)  # one value for one value, both ways
        return agree / len(a), float(np.mean(a == b))


def _tables(benchmark: DataFrame, window: int, block_chars: int, case_blind: bool):
    """Broadcast probe tables of blocks of the benchmark, of about block_chars characters each."""
    bound_batches(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        some = sorted(((r.item_id, r.text.encode("utf-8", "surrogatepass")) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield benchmark.sparkSession.sparkContext.broadcast(Items(some, window, case_blind))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 5, percent: int = 80, block_chars: int = 8_000_000, case_blind: bool = False) -> DataFrame:
    """doc_id, item_id, coverage, consistency, kind (copy or reparameterised): a row for each item a document holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for shared in _tables(benchmark, window, block_chars, case_blind):

        def probe(batches, shared=shared):
            table = shared.value
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                doc, found = [], []
                for k in range(batch.num_rows):
                    text = utf8(texts[k])
                    for x in table.find(text, percent) if text else ():
                        doc.append(ids[k].as_py())
                        found.append(x)
                if doc:
                    kinds = ["copy" if x[3] == 1.0 else "reparameterised" for x in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, pa.int64()), *(pa.array([x[j] for x in found], t) for j, t in ((0, pa.int64()), (1, pa.float64()), (2, pa.float64()))), pa.array(kinds)],
                        ["doc_id", "item_id", "coverage", "consistency", "kind"],
                    )

        got = rows.mapInArrow(probe, "doc_id long, item_id long, coverage double, consistency double, kind string")
        out = got if out is None else out.union(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 5, percent: int = 80, block_chars: int = 8_000_000, case_blind: bool = False) -> DataFrame:
    """The rows of docs that hold no item, with all columns. Each row is judged by its own text, whatever its doc_id."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names)
    text = docs.columns.index("text")
    for shared in _tables(benchmark, window, block_chars, case_blind):

        def free(batches, shared=shared):
            table = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    texts = (utf8(t) for t in batch.column(text))
                    yield batch.filter(pa.array([not (t and table.find(t, percent)) for t in texts], pa.bool_()))

        rows = rows.mapInArrow(free, rows.schema)
    return rows.toDF(*docs.columns)
