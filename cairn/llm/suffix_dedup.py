"""Removal of repeated passages with a logarithmic family of suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same text or another. Equal
strings must meet in one place without every suffix being sent around, so each window of `length` bytes is placed by its
anchor: the smallest hash among its grams. Anchors whose gram occurs once in the corpus are dropped (exact counts behind
a bit table of fixed size, which lets more through as the data grow), the others send the windows they own, as one
stretch of text, to the shard of their gram; a task sends equal stretches once.

Shards come in order, and a run of them makes an index family, which is dropped after its last shard. A batch of stretches
gets a suffix array: its windows in the order of their bytes, sorted eight bytes at a time as far as `length`, where
matches end. Neighbours that agree so far are matches. The batch is then merge-scanned against the arrays of the existing
levels, the common prefix growing by eight bytes in each round, and what it has that is new becomes a level itself; a
level no more than twice as large as the next merges with it, so levels grow geometrically and a suffix is merged a
logarithmic number of times. Both partners of a match are marked. A gram that occurs more than hot_limit times is split:
its windows are counted one by one, by their first bytes and a fingerprint.

Marks belong to stretches. Where a stretch was found in the texts is joined to its marks afterwards, so that a passage
that very many texts share costs one row of marks, and its places are split among tasks like those of any large key.

Cases: a null text counts as empty; texts shorter than `length` bytes lose nothing; rows equal in doc_id and text are two
texts that repeat each other; a null doc_id is an id like others; texts of any length are worked on whole; an empty table
gives an empty one; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, has_bit, staged, whole_groups

GRAM = 64
#: Bytes that are hashed at once, and bits of a place within them.
SLICE = 1 << 19
PLACE = np.uint64(24)


@dataclass(frozen=True)
class SuffixParams:
    length: int = 200
    table_bits: int = 26
    hot_limit: int = 100_000
    #: Windows of a batch that gets a suffix array, and after which a family ends with its shard; stretches that a mapper
    #: holds to join equal ones.
    batch_windows: int = 1 << 18
    family_windows: int = 1 << 20
    held: int = 200_000


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM bytes from each place on; the last GRAM - 1 values mean nothing."""
    h = buf.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step = 1
    while step < GRAM:
        n = len(h) - step
        if n > 0:
            behind = h[step:].copy()
            h[:n] *= np.uint64(pow(0xBF58476D1CE4E5B9, step, 2**64))
            h[:n] += behind
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        step *= 2
    return h


def fingerprints(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the `length` bytes (2 * GRAM to 4 * GRAM) from the places at on, from their gram hashes."""
    out = h[at] * np.uint64(3)
    for k, step in enumerate([GRAM, min(2 * GRAM, length - GRAM), length - GRAM]):
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + h[at + step] * np.uint64(2 * k + 5)
    return out


def anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, first window and number of windows of each anchor of a text, and the gram hashes of all places."""
    h = gram_hashes(text)
    n = len(text) - length + 1
    if n <= 0:
        return h[:0], np.zeros(0, np.int64), np.zeros(0, np.int64), h
    grams = len(text) - GRAM + 1
    low = (h[:grams] >> PLACE << PLACE) | np.arange(grams, dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have < width:  # minimum over the next `have` grams
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    at = (low[:n] & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    key = h[at[first]]
    # Smallest hashes have empty high bits; keys are mixed again, as bit tables and shards look at all of them.
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    return key * np.uint64(0x94D049BB133111EB), first, np.diff(np.r_[first, n]), h


def _pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """A text in portions that overlap so that each window is in exactly one."""
    step = SLICE
    for at in range(0, max(len(text) - length + 1, 1), step):
        yield at, text[at : at + step + length - 1]


def _digest(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def _joined(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of many texts at once: gram hash, text number, first window, windows, place in the buffer; and the buffer.
    Windows that cross texts are cut off."""
    todo: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at, piece in _pieces(t, length):
            if len(piece) >= length:
                todo.append((i, at, piece))
                size += len(piece)
            if size >= SLICE:
                yield _anchored(todo, length)
                todo, size = [], 0
    if todo:
        yield _anchored(todo, length)


def _anchored(todo: list[tuple[int, int, bytes]], length: int):
    buf = np.frombuffer(b"".join(p for _, _, p in todo), np.uint8)
    key, first, n, h = anchors(buf, length)
    sizes = np.array([len(p) for _, _, p in todo])
    end = np.cumsum(sizes)
    start = end - sizes
    # A run of windows may reach over several texts' ends: cut it at the first and last window of each.
    lo_cut = start[1:]
    last_ok = end - length
    bounds = np.unique(np.concatenate([first, lo_cut, (last_ok + 1)[:-1]]))
    owner = np.searchsorted(first, bounds, side="right") - 1
    text = np.searchsorted(end, bounds, side="right")
    stop = np.r_[bounds[1:], len(buf) - length + 1]
    ok = (bounds <= last_ok[text]) & (stop > bounds)
    number = np.array([i for i, _, _ in todo])
    offset = np.array([a for _, a, _ in todo])
    b = bounds[ok]
    t = text[ok]
    return key[owner[ok]], number[t], b - start[t] + offset[t], (stop - bounds)[ok], b, buf, h


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    out = np.zeros(len(buf), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(buf)]
    return out


def _steps(length: int) -> list[int]:
    """Offsets of the words that make `length` bytes; the last may overlap the one before it."""
    steps = list(range(0, length - 7, 8))
    return steps if steps[-1] + 8 == length else [*steps, length - 8]


def _differ(words: np.ndarray, left: np.ndarray, right: np.ndarray, steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of pairs of places the first step from start on at which they differ, or the number of steps."""
    at, on = start.copy(), np.flatnonzero(start < len(steps))
    while len(on):
        step = steps[at[on]]
        on = on[words[left[on] + step] == words[right[on] + step]]
        at[on] += 1
        on = on[at[on] < len(steps)]
    return at


def _order_of_different(words: np.ndarray, at: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The order of windows no two of which are equal. Windows that agree so far make a run; it is sorted by the first word
    in which two neighbours of it differ, which parts it."""
    order = np.argsort(words[at], kind="stable")
    placed = at[order]
    edge = np.r_[True, words[placed[1:]] != words[placed[:-1]]][: len(at)]
    common = np.zeros(len(at), np.int64)
    pairs = np.flatnonzero(~edge)
    common[pairs] = _differ(words, placed[pairs - 1], placed[pairs], steps, np.ones(len(pairs), np.int64))
    while len(pairs):
        heads = np.flatnonzero(edge)
        run = np.cumsum(edge) - 1
        depth = np.minimum.reduceat(np.where(edge, len(steps), common), heads)
        some = np.flatnonzero((np.diff(np.r_[heads, len(at)]) > 1)[run])
        own = depth[run[some]]
        key = words[placed[some] + steps[own]]
        by = np.lexsort((key, run[some]))
        order[some], placed[some], key = order[some][by], placed[some][by], key[by]
        inner = np.flatnonzero(~edge[some])
        apart = key[inner] != key[inner - 1]
        edge[some[inner[apart]]] = True
        pairs, own = some[inner[~apart]], own[inner[~apart]]
        common[pairs] = _differ(words, placed[pairs - 1], placed[pairs], steps, own + 1)
    return order


def suffix_order(words: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the windows at the given places by their first `length` bytes, and which of them equal the one
    before. Equal windows are found by a hash first and compared with the first of them, word by word; the first ones are
    then sorted."""
    steps = np.array(_steps(length))
    finger = np.zeros(len(at), np.uint64)
    for step in steps:
        finger = (finger ^ words[at + step]) * np.uint64(0x9E3779B97F4A7C15)
        finger ^= finger >> np.uint64(29)
    by = np.argsort(finger, kind="stable")
    new = np.r_[True, finger[by][1:] != finger[by][:-1]][: len(at)]
    kind = np.empty(len(at), np.int64)
    kind[by] = np.cumsum(new) - 1
    first = by[new]
    others = by[~new]
    if len(others) and (_differ(words, at[others], at[first[kind[others]]], steps, np.zeros(len(others), np.int64)) < len(steps)).any():
        # Two windows share a hash by chance: tell them apart by all their words.
        by = np.lexsort([words[at + step] for step in steps[::-1]])
        new = np.r_[True, _differ(words, at[by][1:], at[by][:-1], steps, np.zeros(len(by) - 1, np.int64)) < len(steps)]
        return by, ~new
    rank = np.empty(len(first), np.int64)
    rank[_order_of_different(words, at[first], steps)] = np.arange(len(first))
    rank = rank[kind]
    order = np.argsort(rank, kind="stable")
    return order, np.r_[False, rank[order][1:] == rank[order][:-1]][: len(at)]


class Level:
    """A suffix array: the words of its text, the places of its windows in order, and the windows' numbers."""

    def __init__(self, words: np.ndarray, at: np.ndarray, number: np.ndarray):
        self.words, self.at, self.number = words, at, number
        self.first = words[at]

    def scan(self, words: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows (in order) of another text stand in this array, and whether the window there is equal: the part of
        the array that shares a common prefix with each is narrowed word by word."""
        lo, hi = np.searchsorted(self.first, words[at], "left"), np.searchsorted(self.first, words[at], "right")
        live = np.flatnonzero(lo < hi)
        for step in _steps(length)[1:]:
            if not len(live):
                break
            want = words[at[live] + step]
            ends = []
            for side in (np.less, np.less_equal):
                a, b = (ends[0] if ends else lo[live]).copy(), hi[live].copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    below = side(self.words[self.at[np.minimum(mid, len(self.at) - 1)] + step], want)
                    a, b = np.where(open_ & below, mid + 1, a), np.where(open_ & ~below, mid, b)
                ends.append(a)
            lo[live], hi[live] = ends
            live = live[ends[0] < ends[1]]
        return lo, lo < hi

    def merged(self, other: Level, length: int) -> Level:
        place, _ = self.scan(other.words, other.at, length)
        at, number = np.insert(self.at, place, other.at + len(self.words)), np.insert(self.number, place, other.number)
        return Level(np.concatenate([self.words, other.words]), at, number)


class IndexFamily:
    """Suffix arrays of growing size over the windows of a run of shards. A window is known by its number; marked tells
    which windows have been met more than once."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.levels: list[Level] = []
        self.marked = np.zeros(0, bool)

    def add(self, words: np.ndarray, at: np.ndarray) -> int:
        """Takes a batch of windows; the number of its first one."""
        base = len(self.marked)
        self.marked = np.concatenate([self.marked, np.zeros(len(at), bool)])
        order, same = suffix_order(words, at, self.length)
        number = base + order
        self.marked[number[same]] = True
        self.marked[number[:-1][same[1:]]] = True
        group = np.cumsum(~same) - 1
        firsts, own = at[order][~same], number[~same]
        fresh = np.ones(len(firsts), bool)
        for level in self.levels:
            place, hit = level.scan(words, firsts, self.length)
            self.marked[level.number[place[hit]]] = True
            self.marked[number[hit[group]]] = True
            fresh &= ~hit
        if fresh.any():
            self.levels.append(Level(words, firsts[fresh], own[fresh]))
        while len(self.levels) > 1 and len(self.levels[-2].at) <= 2 * len(self.levels[-1].at):
            self.levels[-2:] = [self.levels[-2].merged(self.levels[-1], self.length)]
        return base


SENT = "shard long, hot boolean, d1 long, d2 long, n long, windows int, stretch binary"
FOUND = "d1 long, d2 long, id long, digest long, start long"
MARKS = "d1 long, d2 long, lo array<int>, hi array<int>"
KEYS = "k1 long, k2 long, d1 long, d2 long, place int, n long"


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    names, types = zip(*(c.split(" ") for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


class Stretches:
    """The stretches of a portion of texts whose gram may repeat, as columns: number of the text, gram, whether it is hot,
    first window, windows, place in buf, and a name of 128 bits. A stretch lies within its first and last window (it has
    fewer windows than a window has bytes), so their fingerprints, with its gram and size, name it."""

    def __init__(self, rare, hot, length: int, key, number, start, windows, at, buf, h):
        found = has_bit(rare.value, key)
        self.key, self.number, self.start, self.windows, self.at = (x[found] for x in (key, number, start, windows, at))
        self.hot, self.buf = has_bit(hot.value, self.key), buf
        first, last = (fingerprints(h, x, length) for x in (self.at, self.at + self.windows - 1))
        size, c1, c2 = self.windows.astype(np.uint64), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
        names = []
        for x, y in ((first, last), (last ^ self.key, first + size)):
            z = (x ^ (x >> np.uint64(30))) * c1 + (y ^ (y >> np.uint64(27))) * c2 + self.key * np.uint64(3) + size
            z = (z ^ (z >> np.uint64(31))) * c2
            names.append((z ^ (z >> np.uint64(29))).view(np.int64))
        self.d1, self.d2 = names


def _send(rare, hot, params: SuffixParams):
    """Rows of SENT: the stretches of a task, equal ones once with their number."""

    def out(held: dict) -> pa.RecordBatch:
        return _batch(SENT, list(zip(*((k, m, d1, d2, n, w, x) for (d1, d2), (k, m, w, x, n) in held.items()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for key, number, start, windows, at, buf, h in _joined(_texts(batch), params.length):
                s = Stretches(rare, hot, params.length, key, number, start, windows, at, buf, h)
                order = np.lexsort((s.d2, s.d1))
                new = np.flatnonzero(np.r_[True, (s.d1[order][1:] != s.d1[order][:-1]) | (s.d2[order][1:] != s.d2[order][:-1])][: len(order)])
                count = np.diff(np.r_[new, len(order)])
                one = order[new]
                raw = buf.tobytes()
                for d1, d2, k, m, w, a, n in zip(*(x.tolist() for x in (s.d1[one], s.d2[one], s.key[one].view(np.int64), s.hot[one], s.windows[one], s.at[one], count))):
                    if (who := held.get((d1, d2))) is not None:
                        held[d1, d2] = (*who[:4], who[4] + n)
                    else:
                        held[d1, d2] = (k, m, w, raw[a : a + w - 1 + params.length], n)
                if len(held) >= params.held:
                    yield out(held)
                    held = {}
        if held:
            yield out(held)

    return run


def _find(rare, hot, params: SuffixParams):
    """Rows of FOUND: where the stretches stand in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            texts = _texts(batch)
            digests = np.array([_digest(t) for t in texts], np.int64)
            for key, number, start, windows, at, buf, h in _joined(texts, params.length):
                s = Stretches(rare, hot, params.length, key, number, start, windows, at, buf, h)
                if len(s.d1):
                    columns = (s.d1, s.d2, ids[s.number], digests[s.number], s.start.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["d1", "d2", "id", "digest", "start"])

    return run


def _buffer(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of a table in a row, the places of their windows, and how many windows each has."""
    windows = table.column("windows").to_numpy().astype(np.int64)
    size = windows + length - 1
    buf = np.frombuffer(b"".join(table.column("stretch").to_pylist()), np.uint8)
    first = np.cumsum(windows) - windows
    return buf, np.repeat(np.cumsum(size) - size - first, windows) + np.arange(windows.sum()), windows


def _runs(marked: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, first and last but one window of the marked runs of stretches."""
    row = np.repeat(np.arange(len(windows)), windows)
    edge = np.r_[True, (marked[1:] != marked[:-1]) | (row[1:] != row[:-1])][: len(row)]
    opens = np.flatnonzero(marked & edge)
    closes = np.flatnonzero(marked & np.r_[edge[1:], True][: len(row)]) + 1
    first = np.cumsum(windows) - windows
    return row[opens], opens - first[row[opens]], closes - first[row[opens]]


def _match(params: SuffixParams):
    """Rows of MARKS from rows of SENT that are sorted by shard."""
    length = params.length

    def told(family: IndexFamily | None, kept: list[tuple[pa.Table, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """The marked runs of stretches; without a family, all of each."""
        at = 0
        for part, windows in kept:
            n = int(windows.sum())
            if family is None:
                row, lo, hi = np.arange(len(windows)), np.zeros(len(windows), np.int64), windows
            else:
                row, lo, hi = _runs(family.marked[at : at + n], windows)
            at += n
            some, count = np.unique(row, return_counts=True)
            if len(some):
                ends = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32))
                own = [part.column(c).take(pa.array(some)).combine_chunks() for c in ("d1", "d2")]
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (lo, hi)]
                yield pa.RecordBatch.from_arrays([*own, *lists], names=["d1", "d2", "lo", "hi"])

    def distinct(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """Equal stretches of several tasks as one, with their number, and whether a shard has no other stretch."""
        shard, d1, d2 = (table.column(c).to_numpy() for c in ("shard", "d1", "d2"))
        order = np.lexsort((d2, d1, shard))
        same = np.r_[False, (shard[order][1:] == shard[order][:-1]) & (d1[order][1:] == d1[order][:-1]) & (d2[order][1:] == d2[order][:-1])]
        first = np.flatnonzero(~same)
        n = np.add.reduceat(table.column("n").to_numpy()[order], first)
        own = shard[order][first]
        opens = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        alone = np.repeat(np.diff(np.r_[opens, len(own)]) == 1, np.diff(np.r_[opens, len(own)]))
        return table.take(pa.array(order[first])), n, alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, kept = IndexFamily(length), []
        for table in whole_groups(batches, ["shard"]):
            table, n, alone = distinct(table)
            # The only stretch of its gram that stands in several places repeats as a whole, and has nobody to meet.
            done = alone & (n > 1)
            if done.any():
                part = table.filter(pa.array(done))
                yield from told(None, [(part.select(["d1", "d2"]), part.column("windows").to_numpy().astype(np.int64))])
                table, n = table.filter(pa.array(~done)), n[~done]
            if not table.num_rows:
                continue
            shard, total = table.column("shard").to_numpy(), np.cumsum(table.column("windows").to_numpy().astype(np.int64))
            cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(total // params.batch_windows)) + 1, len(shard)])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if len(family.marked) >= params.family_windows and (a == 0 or shard[a] != shard[a - 1]):
                    yield from told(family, kept)
                    family, kept = IndexFamily(length), []
                part = table.slice(a, b - a)
                buf, at, windows = _buffer(part, length)
                base = family.add(_words(buf), at)
                # So does any stretch that stands in several places.
                family.marked[base:] |= np.repeat(n[a:b] > 1, windows)
                kept.append((part.select(["d1", "d2"]), windows))
        yield from told(family, kept)

    return run


def _window_keys(params: SuffixParams):
    """Rows of KEYS: first bytes and fingerprint of each window of rows of SENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                part = pa.Table.from_batches([batch.slice(i, 5000)])
                buf, at, windows = _buffer(part, params.length)
                row = np.repeat(np.arange(part.num_rows), windows)
                keys = [_words(buf)[at], fingerprints(gram_hashes(buf), at, params.length)]
                own = [part.column(c).take(pa.array(row)).combine_chunks() for c in ("d1", "d2")]
                place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
                n = part.column("n").to_numpy()[row]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(k.view(np.int64)) for k in keys), *own, pa.array(place.astype(np.int32)), pa.array(n)], names=["k1", "k2", "d1", "d2", "place", "n"]
                )

    return run


def _hot_marks(sent: DataFrame, params: SuffixParams) -> DataFrame:
    """Rows of MARKS of stretches of hot grams: their windows counted one by one."""
    keys = staged(sent.select("windows", "stretch", "d1", "d2", "n").mapInArrow(_window_keys(params), KEYS), "suffix-keys")
    many = staged(keys.groupBy("k1", "k2").agg(F.sum("n").alias("c")).filter("c > 1").select(F.col("k1").alias("_1"), F.col("k2").alias("_2")), "suffix-hot")
    hit = keys.join(many, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2"))).groupBy("d1", "d2")
    hit = hit.agg(F.array_sort(F.collect_set("place")).alias("x"))  # a stretch's own windows bound what it collects
    lo = F.filter("x", lambda p, i: (i == 0) | (F.get("x", i - 1) != p - 1))
    hi = F.filter("x", lambda p, i: (i == F.size("x") - 1) | (F.get("x", i + 1) != p + 1))
    return hit.select("d1", "d2", lo.alias("lo"), F.transform(hi, lambda p: p + 1).alias("hi"))


def repeated_spans(docs: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """id (hash of doc_id, which may be of any type), digest (of the text) and spans (byte intervals that go; they may touch or overlap)."""
    if not 2 * GRAM <= params.length <= 4 * GRAM:
        raise ValueError(f"length must be from {2 * GRAM} to {4 * GRAM}")
    sc = docs.sparkSession.sparkContext

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, *_ in _joined(_texts(batch), params.length):
                # Equal keys of a portion are counted here: a text that repeats itself counts as often.
                k, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    counts = docs.select("text").mapInArrow(grams, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = staged(counts, "suffix-grams")
    many = counts.filter(F.col("n") > params.hot_limit)
    rare, hot = (sc.broadcast(bit_table(x, params.table_bits)) for x in (counts, many))
    sent = docs.select("text").mapInArrow(_send(rare, hot, params), SENT)
    marks = sent.filter("not hot").repartition("shard").sortWithinPartitions("shard").mapInArrow(_match(params), MARKS)
    if not many.isEmpty():
        marks = marks.unionByName(_hot_marks(sent.filter("hot"), params))
    marks = staged(marks, "suffix-marks")
    found = docs.select(F.xxhash64("doc_id").alias("id"), "text").mapInArrow(_find(rare, hot, params), FOUND)
    where = found.join(marks.withColumnsRenamed({"d1": "_1", "d2": "_2"}), (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")))
    end = F.transform("hi", lambda x: F.col("start") + x - 1 + params.length)
    spans = where.select("id", "digest", F.explode(F.arrays_zip(F.transform("lo", lambda x: F.col("start") + x).alias("lo"), end.alias("hi"))).alias("s"))
    # A text's own length bounds what it collects; rows that repeat an id and a text collect the same.
    return spans.groupBy("id", "digest").agg(F.collect_set(F.struct(F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, removed (array of byte intervals) and kept (remaining bytes) of each row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array([_digest(t) for t in _texts(batch)], pa.int64())], names=["doc_id", "text", "_digest"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], [], [], []]
            for text, spans in zip(_texts(batch), batch.column("spans").to_pylist()):
                gone = merged((s["lo"], s["hi"]) for s in spans or ())
                kept, at = [], 0
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                for c, x in zip(rows, (len(text), sum(b - a for a, b in gone), len(gone), [list(x) for x in gone], b"".join(kept))):
                    c.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(rows, types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])

    texts = docs.select("doc_id", "text").mapInArrow(digest, f"doc_id {id_type}, text string, _digest long")
    spans = repeated_spans(docs, params)
    df = texts.join(spans, (F.xxhash64("doc_id") == F.col("id")) & (F.col("_digest") == F.col("digest")), "left")
    return df.select("doc_id", "text", "spans").mapInArrow(cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, removed array<array<long>>, kept binary")


#: Every window of 200 bytes, for unique doc_ids.
ORACLE = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(b[i:i + 199]) AS k FROM (SELECT doc_id, b, unnest(range(1, n - 198)) AS i FROM b WHERE n >= 200)),
r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS opens FROM r)),
s AS (SELECT doc_id, min(i) AS lo, max(i) + 199 AS hi FROM g GROUP BY doc_id, g),
e AS (SELECT doc_id, lo, hi, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS onward, row_number() OVER (PARTITION BY doc_id ORDER BY lo) AS k FROM s),
p AS (SELECT b.doc_id, CASE WHEN k = 1 THEN hex(b[1:lo - 1]) ELSE '' END || hex(b[hi + 1:coalesce(onward - 1, n)]) AS x, lo FROM e JOIN b USING (doc_id)),
c AS (SELECT doc_id, string_agg(x, '' ORDER BY lo) AS kept FROM p GROUP BY doc_id),
t AS (SELECT doc_id, sum(hi - lo + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT b.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN c.doc_id IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256
FROM b LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
