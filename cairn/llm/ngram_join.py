"""N-gram Jaccard self-join by grouped prefixes.

A document's set holds its distinct word shingles as 64-bit hashes. Shingles are ordered by how many documents hold them,
rare ones first, then by hash; two sets that link share one of the first shingles of each (the prefix). Documents with
the same prefix and size make one group, and the prefix join runs between groups: pairs that share a prefix shingle are
filtered by size, by the places of the shingle and by parity bitmaps of the sets, which bound their difference from
below. What passes joins groups to bundles; the documents of a bundle are then expanded and verified exactly. A large
bundle is cut into blocks of documents that share their rarest shingle, and only pairs of blocks that hold a filtered pair
are verified. Equal sets are one class throughout, so copies are never paired.

Document frequencies are counted exactly: a task sends the distinct hashes (48 bits) of a few million shingles with their
counts, as differences of sorted numbers, to the bucket of each. The `ranked` most frequent shingles go to every worker
(16 MB at most) and are ordered by their counts, the others, which are rarer, by hash. Before all come the rare ones, which
a bit table of fixed size doesn't show: it holds the shingles of as few documents as it has room for. Where that is two,
the rare ones are in one document only: a text with a fifth of such shingles has no other in its prefix, and goes no
further. In larger corpora the rare ones are those of a few documents, and stay. The order affects the work only: the
join is exact under any, and exact joins decide which shingles prefixes share. Hot shingles and large bundles are cut into blocks, each pair
of blocks one task, and tasks report spanning forests and sums, never pairs.

Cases: a text that is null or has no word has an empty set and links with nothing; with fewer words than a shingle the
whole sequence is its one shingle; rows that repeat a doc_id are documents of their own; a null doc_id takes part and
counts as larger than any other; an empty table gives an empty one; only doc_id and text are read. Sets are told
apart by 64-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_table, has_bit, local_roots, release, sealed, staged, tidy, whole_groups
from .components import components

#: Bytes of texts that are worked on at once, and of a piece of them that is hashed at once.
SLICE_BYTES, PIECE = 1 << 21, 1 << 20


@dataclass(frozen=True)
class JoinParams:
    width: int = 5
    percent: int = 80
    #: Shingles that are ordered by their counts, and bits of the tables that let rows through (8 MB).
    ranked: int = 1 << 20
    table_bits: int = 26
    #: Shingles that a task sorts at once, and distinct ones wanted in a bucket of the count.
    sorted_shingles: int = 1 << 20
    bucket_shingles: int = 1 << 18
    #: Groups of a block of a hot shingle; documents of a block of a large bundle.
    token_block: int = 1024
    bundle_block: int = 512


class Shingler:
    """Sets of shingle hashes. Words are hashed where they stand: a byte's random number times a power of its place, summed
    up, so that a word's hash is a difference of two sums, shifted to one place for all words."""

    def __init__(self, width: int):
        self.width = width
        codes = np.arange(256)
        self.blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
        numbers = np.random.default_rng(17).integers(1, 2**64, 256, np.uint64, endpoint=False)
        self.number = numbers[np.where((codes >= 65) & (codes <= 90), codes + 32, codes)]  # A-Z as a-z
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(PIECE, 0x9E3779B97F4A7C15, np.uint64)], dtype=np.uint64)

    def sets(self, texts: list[str | None]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(from, to, sorted distinct shingle hashes of each text) for slices of the texts."""
        start, held, size = 0, [], 0
        for i, t in enumerate(texts):
            held.append((t or "").encode())
            size += len(held[-1]) + 1
            if size >= SLICE_BYTES or i + 1 == len(texts):
                yield start, i + 1, self._sets(held)
                start, held, size = i + 1, [], 0

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word."""
        code, hashes, places, at = np.frombuffer(data, np.uint8), [], [], 0
        while at < len(code):
            part = code[at : at + PIECE]
            blank = self.blank[part]
            if at + len(part) < len(code) and not blank[-1]:
                ends = np.flatnonzero(blank)
                if not len(ends):  # one word fills the piece
                    end = at + len(part)
                    while end < len(code) and not self.blank[code[end]]:
                        more = np.flatnonzero(self.blank[code[end : end + PIECE]])
                        end += int(more[0]) if len(more) else len(code[end : end + PIECE])
                    hashes.append(np.array([self._long(code[at:end])]))
                    places.append(np.array([at]))
                    at = end
                    continue
                part, blank = part[: ends[-1] + 1], blank[: ends[-1] + 1]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.number[part] * self.power[: len(part)], out=sums[1:])
            first = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
            last = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
            hashes.append((sums[last] - sums[first]) * self.power[PIECE - first])
            places.append(first + at)
            at += len(part)
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.concatenate(hashes)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32)), np.concatenate(places)

    def _long(self, code: np.ndarray) -> np.uint64:
        """The sum of a word of any length, shifted like those of all words."""
        total, shift = 0, int(self.power[PIECE])
        for i in range(0, len(code), PIECE):
            part = code[i : i + PIECE]
            total += int((self.number[part] * self.power[: len(part)]).sum(dtype=np.uint64)) * pow(0x9E3779B97F4A7C15, i, 2**64)
        return np.uint64(total * shift % 2**64)

    def _sets(self, texts: list[bytes]) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            h, place = self.words(b"\n".join(texts))
            ends = np.cumsum([len(t) + 1 for t in texts])
            sizes = np.bincount(np.searchsorted(ends, place, side="right"), minlength=len(texts)).tolist()
            rolled = h.copy()
            for j in range(1, self.width):
                rolled[: max(len(h) - j, 0)] = rolled[: max(len(h) - j, 0)] * np.uint64(0x9E3779B97F4A7C15) + h[j:]
            mixed = self._mixed(rolled)
            out, at = [], 0
            for n in sizes:
                if 0 < n < self.width:
                    k = h[at : at + 1].copy()
                    for x in h[at + 1 : at + n]:
                        k = k * np.uint64(0x9E3779B97F4A7C15) + x
                    k = self._mixed(k + np.uint64(n))
                else:
                    k = mixed[at : at + max(n - self.width + 1, 0)].copy()
                k.sort()
                out.append(k[np.r_[True, k[1:] != k[:-1]]] if len(k) else k)
                at += n
        return out

    @staticmethod
    def _mixed(k: np.ndarray) -> np.ndarray:
        k = (k ^ (k >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return k ^ (k >> np.uint64(29))


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of hashes by their low bits, over 256 * 2 ** k bits, at least one for two hashes."""
    m = 256
    while 2 * m < len(s):
        m *= 2
    return np.packbits((np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)).tobytes()


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _packed(values: np.ndarray) -> bytes:
    """Sorted distinct numbers of 48 bits as differences, byte by byte, so that the empty high bytes are left out."""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max((int(gaps.max()).bit_length() + 7) // 8, 1)
    return bytes([width]) + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :width] = planes.T
    return np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64)


def _frequencies(docs: DataFrame, params: JoinParams) -> DataFrame:
    """h (the high 48 bits of a shingle's hash) and n (documents that hold it) of shingles that two or more hold."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(size / 6 / params.bucket_shingles, 1))), 4, 24))
    shift = np.uint64(48 - bits)

    def portion(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.flatnonzero(np.r_[True, (h[1:] >> shift) != (h[:-1] >> shift), True])
        rows = [[], [], [], []]
        for a, b in zip(cuts[:-1], cuts[1:]):
            more = np.flatnonzero(n[a:b] > 1).astype(np.uint32)
            for c, x in zip(rows, (int(h[a] >> shift), _packed(h[a:b]), more.tobytes(), n[a:b][more].astype(np.uint32).tobytes())):
                c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(c, pa.binary()) for c in rows[1:])], names=["bucket", "h", "at", "n"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, total = Shingler(params.width), [], 0
        for batch in batches:
            for _, _, sets in shingler.sets(batch.column("text").to_pylist()):
                for x in sets:
                    held.append(x >> np.uint64(16))
                    total += len(x)
                if total >= params.sorted_shingles:
                    yield portion(held)
                    held, total = [], 0
        if total:
            yield portion(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket"]):
            bucket = table.column("bucket").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
            packed, at, more = (table.column(c).to_pylist() for c in ("h", "at", "n"))
            for a, b in zip(cuts[:-1], cuts[1:]):
                values, counts = [], []
                for x, i, m in zip(packed[a:b], at[a:b], more[a:b]):
                    values.append(_unpacked(x))
                    own = np.ones(len(values[-1]), np.int64)
                    own[np.frombuffer(i, np.uint32)] = np.frombuffer(m, np.uint32)
                    counts.append(own)
                h, n = np.concatenate(values), np.concatenate(counts)
                order = np.argsort(h, kind="stable")  # runs are sorted already
                h, n = h[order], n[order]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                total = np.add.reduceat(n, first)
                keep = total > 1
                yield pa.RecordBatch.from_arrays([pa.array(h[first][keep].view(np.int64)), pa.array(total[keep])], names=["h", "n"])

    rows = docs.select("text").mapInArrow(tidy(send), "bucket long, h binary, at binary, n binary")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(count), "h long, n long")
    return staged(rows, "join-frequencies")


class Order:
    """Keys that sort shingles by a rank before the hash: 0 for rare ones, 1 for the others, more for the most frequent
    ones; `alone` tells whether rare means in one document only."""

    def __init__(self, counts: DataFrame, params: JoinParams):
        # Levels of counts: each up to 64 its own, eight to an octave above; fewer than 600.
        level = F.when(F.col("n") <= 64, F.col("n")).otherwise(64 + F.floor(F.log2(F.col("n") / 64.0) * 8)).cast("int")
        steps = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
        total = np.cumsum([r["count"] for r in steps])

        def least(room: int) -> int:
            """The lowest level down to which all shingles find room."""
            return min((r.level for r, n in zip(steps, total) if n <= room), default=1 << 20)

        # A quarter of the bits at most are set, so few rare shingles are taken for others by chance.
        common = least(1 << (params.table_bits - 2))
        self.alone = all(r.level >= common for r in steps)
        self.shared = bit_table(counts.filter(level >= common).select(F.call_function("shiftleft", "h", F.lit(16)).alias("h")), params.table_bits)
        top = counts.filter(level >= max(least(params.ranked), common)).toArrow()
        h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
        order = np.argsort(h)
        self.top, self.rank = h[order], np.minimum(np.log2(n[order]) * 1024, 65535).astype(np.uint64) << np.uint64(48)
        self.near = np.zeros(1 << 20, np.uint8)
        np.bitwise_or.at(self.near, (self.top >> np.uint64(28)).astype(np.int64), np.uint8(1) << (self.top >> np.uint64(25) & np.uint64(7)).astype(np.uint8))

    def keys(self, s: np.ndarray) -> np.ndarray:
        out = s >> np.uint64(16)
        some = np.flatnonzero(has_bit(self.shared, s))
        if len(some):
            h = out[some]
            out[some] |= np.uint64(1 << 48)
            near = np.flatnonzero(self.near[(h >> np.uint64(28)).astype(np.int64)] >> (h >> np.uint64(25) & np.uint64(7)).astype(np.uint8) & np.uint8(1))
            if len(near):
                at = np.minimum(np.searchsorted(self.top, h[near]), len(self.top) - 1)
                hit = self.top[at] == h[near]
                out[some[near[hit]]] = h[near[hit]] | self.rank[at[hit]]
        out.sort()
        return out


def _prefixes(docs: DataFrame, order: Order, params: JoinParams) -> DataFrame:
    """doc_id, digest (of the text), n, set_id, group_id, and of the prefix the places and keys of shingles that other
    documents may hold, and the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, order = Shingler(params.width), shared.value
        for batch in batches:
            for a, b, sets in shingler.sets(batch.column("text").to_pylist()):
                ids, groups, places, tokens, maps = [], [], [], [], []
                for s in sets:
                    p = order.keys(s)[: prefix_length(len(s), params.percent)] if len(s) else s
                    at = np.arange(np.searchsorted(p, np.uint64(1 << 48)) if order.alone else 0, len(p))
                    ids.append(_digest(s.tobytes()))
                    groups.append(_digest(len(s).to_bytes(8, "little") + p.tobytes()))
                    places.append(at.astype(np.int32))
                    tokens.append(p[at].view(np.int64))
                    maps.append(_bitmap(s) if len(at) else None)
                ends = pa.array(np.cumsum([0, *map(len, places)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("digest").slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(ids, pa.int64()),
                        pa.array(groups, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(places))),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tokens))),
                        pa.array(maps, pa.binary()),
                    ],
                    names=["doc_id", "digest", "n", "set_id", "group_id", "places", "tokens", "bitmap"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(tidy(run), f"doc_id {id_type}, digest long, n long, set_id long, group_id long, places array<int>, tokens array<long>, bitmap binary")


def _pairs(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs inside consecutive groups of the given sizes, in portions."""
    end = np.repeat(np.cumsum(size), size)
    after = end - np.arange(len(end)) - 1
    step, start = 2_000_000, 0
    upto = np.cumsum(after)
    while start < len(after):
        stop = max(int(np.searchsorted(upto, (upto[start - 1] if start else 0) + step)), start + 1)
        n = after[start:stop]
        left = np.repeat(np.arange(start, stop), n)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        start = stop


def _filter(params: JoinParams, blocks: bool = False):
    """Links groups that share a prefix shingle and that no bound keeps apart: a spanning forest of them, or the pairs of
    blocks that hold such a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["token", "lo", "hi"]):
            col = {c: table.column(c).to_numpy() for c in ("token", "lo", "hi", "part", "group_id", "n", "place")}
            maps = table.column("bitmap").to_pylist()
            width = np.array([0 if m is None else len(m) for m in maps])
            folded = {}
            for w in sorted(set(width[width > 0].tolist())):
                folded[w] = np.zeros((len(maps), w // 8), np.uint64)
                for i in np.flatnonzero(width >= w):
                    m = np.frombuffer(maps[i], np.uint64)
                    while len(m) * 8 > w:
                        m = m[: len(m) // 2] ^ m[len(m) // 2 :]
                    folded[w][i] = m
            change = (np.diff(col["token"]) != 0) | (np.diff(col["lo"]) != 0) | (np.diff(col["hi"]) != 0)
            size = np.diff(np.r_[0, np.flatnonzero(change) + 1, table.num_rows])
            if blocks:
                bundle, block = table.column("bundle").to_numpy(), table.column("block").to_numpy()
            lefts, rights, seen = [], [], set()
            for a, b in _pairs(size):
                na, nb = col["n"][a], col["n"][b]
                ok = (100 * np.minimum(na, nb) >= params.percent * np.maximum(na, nb)) & ((col["lo"][a] == col["hi"][a]) | (col["part"][a] != col["part"][b]))
                pa_, pb_ = col["place"][a], col["place"][b]
                need = -(-params.percent * (na + nb) // (100 + params.percent))
                ok &= np.minimum(pa_, pb_) + np.minimum(na - pa_, nb - pb_) >= need
                ok &= col["group_id"][a] != col["group_id"][b]
                a, b, spare = a[ok], b[ok], (na + nb - 2 * need)[ok]
                w = np.minimum(width[a], width[b])
                near = w == 0
                for v, m in folded.items():
                    at = np.flatnonzero(w == v)
                    for k in np.array_split(at, len(at) // 100_000 + 1):
                        near[k] = np.bitwise_count(m[a[k]] ^ m[b[k]]).sum(1, dtype=np.int64) <= spare[k]
                if blocks:
                    x, y = block[a[near]], block[b[near]]
                    seen.update(zip(bundle[a[near]].tolist(), np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
                else:
                    lefts.append(a[near])
                    rights.append(b[near])
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in seen], pa.int64()) for i in range(3)], names=["bundle", "lo", "hi"])
                continue
            ids, node = np.unique(col["group_id"], return_inverse=True)
            root = local_roots(len(ids), node[np.concatenate(lefts)], node[np.concatenate(rights)]) if lefts else np.arange(len(ids))
            moved = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["a", "b"])

    return run


def _blocks(df: DataFrame, parts: str, salt: str, key: str) -> DataFrame:
    """Deals the rows of a key to all pairs lo <= hi of its parts that hold them."""
    part = F.pmod(F.xxhash64(salt), F.col(parts)).cast("int")
    df = df.withColumn("part", part).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
    return _dealt(df.withColumns({"lo": F.least("part", "_other"), "hi": F.greatest("part", "_other")}).drop("_other", parts), key)


def _dealt(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def _verify(params: JoinParams):
    """Exact links of the documents of a bundle's pair of blocks: set_id, links (documents) and root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bundle", "lo", "hi"]):
            col = {c: table.column(c).to_numpy() for c in ("bundle", "lo", "hi", "part", "set_id", "copies")}
            change = (np.diff(col["bundle"]) != 0) | (np.diff(col["lo"]) != 0) | (np.diff(col["hi"]) != 0)
            cuts = np.r_[0, np.flatnonzero(change) + 1, table.num_rows]
            sets = table.column("shingles")
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                own = [np.frombuffer(x.as_py(), np.uint64) for x in sets.slice(a, b - a)]
                linked = _linked(own, params.percent)
                part = col["part"][a:b]
                if col["lo"][a] != col["hi"][a]:
                    linked &= part[:, None] != part[None]
                x, y = np.nonzero(linked)
                if not len(x):
                    continue
                links = (linked * col["copies"][a:b][None]).sum(1)
                root = local_roots(b - a, x, y)
                ids = col["set_id"][a:b]
                some = np.flatnonzero(links)
                out.append((ids[some], links[some], ids[root[some]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=["set_id", "links", "root"])

    return run


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets link, as a matrix without its diagonal; sums of products over shingles held by two or more."""
    n = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), n)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[at] > 1
    row, at = row[keep], (np.cumsum(count > 1) - 1)[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    step = 4096
    width = int(at[-1]) + 1 if len(at) else 0
    for lo in range(0, width, step):
        a, b = np.searchsorted(at, [lo, lo + step])
        m = np.zeros((len(sets), min(step, width - lo)), np.float32)
        m[row[a:b], at[a:b] - lo] = 1
        common += m @ m.T
    common = np.rint(common).astype(np.int64)
    linked = 100 * common >= percent * (n[:, None] + n[None] - common)
    np.fill_diagonal(linked, False)
    return linked


def _components(docs: DataFrame, params: JoinParams) -> DataFrame:
    """One row per row of docs: doc_id, digest (of the text), n, n_links, root (a set of the component; null without
    shingles) and component (its smallest doc_id)."""
    sc = docs.sparkSession.sparkContext
    counts = _frequencies(docs, params)
    order = Order(counts, params)
    release(counts)
    found = staged(_prefixes(docs, order, params), "join-prefixes")
    held = found.filter("n > 0")
    one_set = F.min("set_id") == F.max("set_id")
    groups = held.filter(F.size("tokens") > 0).groupBy("group_id").agg(
        F.first("n").alias("n"), F.first("places").alias("places"), F.first("tokens").alias("tokens"), F.when(one_set, F.first("bitmap")).alias("bitmap")
    )
    groups = staged(groups, "join-groups")
    narrow = groups.select("group_id", F.explode(F.arrays_zip("places", "tokens")).alias("p")).select("group_id", F.col("p.places").alias("place"), F.col("p.tokens").alias("token"))
    tokens = staged(narrow.groupBy("token").count().filter("count > 1").select(F.col("token").alias("_t"), F.ceil(F.col("count") / params.token_block).cast("int").alias("parts")), "join-tokens")
    # Only shingles that two groups have in their prefixes go on, and only then with their bitmaps.
    rows = narrow.join(tokens, F.col("token") == F.col("_t")).join(groups.select("group_id", "n", "bitmap"), "group_id")
    rows = rows.select("token", "place", "group_id", "n", "bitmap", "parts")
    bundles = components(_blocks(rows, "parts", "group_id", "token").mapInArrow(tidy(_filter(params)), "a long, b long"))

    classes = held.groupBy("set_id").agg(F.min("doc_id").alias("cid"), F.count("*").alias("copies"), F.first("group_id").alias("group_id"), F.min("digest").alias("digest"))
    classes = classes.join(bundles, F.col("group_id") == F.col("id"), "left").select("set_id", "cid", "copies", "group_id", "digest", F.coalesce("component", "group_id").alias("bundle"))
    classes = staged(classes, "join-classes")
    sizes = staged(classes.groupBy("bundle").count().filter("count > 1").withColumnRenamed("bundle", "_b"), "join-bundles")
    wanted = classes.join(sizes, F.col("bundle") == F.col("_b"))
    # Blocks of a large bundle hold sets with the same rarest shingle among those of several documents.
    large = wanted.filter(F.col("count") > params.bundle_block).select("set_id", "bundle", F.col("group_id").alias("_g"))
    if large.isEmpty():
        pairs = None
        wanted = wanted.select("set_id", "copies", "digest", "bundle", F.lit(0).cast("long").alias("block"), F.lit(False).alias("cut"))
    else:
        first = groups.select("group_id", F.get("tokens", F.lit(0)).alias("_t1"))
        placed = large.join(first, F.col("_g") == F.col("group_id"), "left").withColumn("_first", F.coalesce("_t1", F.lit(0)))
        crowd = placed.groupBy("bundle", "_first").agg(F.ceil(F.count("*") / params.bundle_block).alias("_n"))
        crowd = crowd.select(F.col("bundle").alias("_b2"), F.col("_first").alias("_f2"), "_n")
        placed = placed.join(crowd, (F.col("bundle") == F.col("_b2")) & (F.col("_first") == F.col("_f2")))
        placed = staged(placed.select(F.col("set_id").alias("_s2"), "_g", F.col("bundle").alias("_bundle"), F.xxhash64("_first", F.pmod(F.xxhash64("set_id"), F.col("_n"))).alias("_block")), "join-placed")
        wanted = wanted.join(placed.select("_s2", "_block"), F.col("set_id") == F.col("_s2"), "left")
        wanted = wanted.select("set_id", "copies", "digest", "bundle", F.coalesce("_block", F.lit(0)).alias("block"), F.col("_block").isNotNull().alias("cut"))
        # The filter once more over the groups of large bundles: which blocks of theirs hold a pair that passes.
        again = rows.join(placed.select("_g", F.col("_bundle").alias("bundle"), F.col("_block").alias("block")).distinct(), F.col("group_id") == F.col("_g")).drop("_g")
        pairs = _blocks(again, "parts", "group_id", "token").mapInArrow(tidy(_filter(params, True)), "bundle long, lo long, hi long")
        own = placed.select(F.col("_bundle").alias("bundle"), F.col("_block").alias("lo"), F.col("_block").alias("hi"))
        # Sets of one group may stand in several blocks, and pass without being filtered.
        same = placed.select("_g", F.col("_bundle").alias("bundle"), F.col("_block").alias("lo")).distinct()
        twins = same.join(same.select(F.col("_g").alias("_g3"), F.col("lo").alias("hi")).distinct(), F.col("_g") == F.col("_g3")).select("bundle", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
        pairs = staged(pairs.unionByName(own).unionByName(twins).distinct(), "join-pairs")
    wanted = staged(wanted, "join-wanted")
    release(tokens, groups)
    picked = sc.broadcast(bit_table(wanted.select(F.col("digest").alias("h")), params.table_bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_bit(picked.value, batch.column("h").to_numpy().view(np.uint64))))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(params.width)
        for batch in batches:
            for a, b, sets in shingler.sets(batch.column("text").to_pylist()):
                own = [batch.column(c).slice(a, b - a) for c in ("bundle", "block", "cut", "set_id", "copies")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([s.tobytes() for s in sets], pa.binary())], names=["bundle", "block", "cut", "set_id", "copies", "shingles"])

    # One text of each wanted set: the table lets some more through, the join does not.
    texts = docs.select("text", F.xxhash64("text").alias("h")).mapInArrow(tidy(candidates), "text string, h long")
    texts = texts.dropDuplicates(["h"]).join(wanted, F.col("h") == F.col("digest")).select("text", "bundle", "block", "cut", "set_id", "copies")
    dealt = texts.mapInArrow(tidy(shingles), "bundle long, block long, cut boolean, set_id long, copies long, shingles binary")
    if pairs is None:
        checks = dealt.withColumns({"lo": F.col("block"), "hi": F.col("block")})
    else:
        dealt = staged(dealt, "join-sets")
        one = dealt.filter("not cut").withColumns({"lo": F.col("block"), "hi": F.col("block")})
        p = pairs.select(F.col("bundle").alias("_b"), "lo", "hi")
        ends = p.withColumn("_e", F.col("lo")).unionByName(p.filter("lo <> hi").withColumn("_e", F.col("hi")))
        many = dealt.filter("cut").join(ends, (F.col("bundle") == F.col("_b")) & (F.col("block") == F.col("_e")))
        checks = one.unionByName(many.select(*one.columns))
    checks = _dealt(checks.withColumnRenamed("block", "part"), "bundle")
    checked = staged(checks.mapInArrow(tidy(_verify(params)), "set_id long, links long, root long"), "join-links")
    roots = components(checked.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("set_id").agg(F.sum("links").alias("links")).withColumnRenamed("set_id", "_l")
    about = classes.join(links, F.col("set_id") == F.col("_l"), "left").join(roots, F.col("set_id") == F.col("id"), "left")
    about = staged(about.select("set_id", "cid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "set_id").alias("root")), "join-about")
    first = about.groupBy("root").agg(F.min("cid").alias("component")).withColumnRenamed("root", "_r")
    last = staged(about.join(first, F.col("root") == F.col("_r")).select(F.col("set_id").alias("_s"), "n_links", "root", "component"), "join-about")
    release(about, classes, wanted, sizes, checked)
    df = found.select("doc_id", "digest", "n", "set_id").join(last, (F.col("n") > 0) & (F.col("set_id") == F.col("_s")), "left")
    return df.select("doc_id", "digest", "n", "n_links", "root", "component")


def jaccard_classes(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, n_links (documents linked directly) and component_id."""
    df = _components(docs, params)
    return df.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """One row of docs for each component: of its smallest doc_id (nulls last), then of the smallest digest of a text; of
    wholly equal ids and texts any one. Rows without a word link with nothing, so all of them stay. All columns stay as
    they are, whatever their names."""
    df, (doc_id, text) = sealed(docs, "doc_id", "text")
    rows = _components(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), params)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    keep = rows.filter("n > 0").groupBy("root").agg(first).select("first.doc_id", "first.digest")
    keep = keep.unionByName(rows.filter("n = 0").select("doc_id", "digest").distinct())

    def key(id_: Column, digest: Column) -> Column:
        return F.concat_ws(":", id_.isNull().cast("string"), digest.cast("string"), F.coalesce(id_.cast("string"), F.lit("")))

    # One key for the join and for the repeats, so that texts are shuffled once.
    keep = keep.select(key(F.col("doc_id"), F.col("digest")).alias("_k"))
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    df = df.withColumns({"_key": key(F.col(doc_id), F.xxhash64(text)), "_own": F.when(worded, -1).otherwise(F.monotonically_increasing_id())})
    df = df.join(keep, F.col("_key") == F.col("_k"), "left_semi").dropDuplicates(["_key", "_own"])
    return df.drop("_key", "_own").toDF(*docs.columns)


#: For unique, non-null doc_ids, as SQL has no other way to tell rows apart.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END)) AS shingle
  FROM w WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links, (SELECT min(root) FROM r WHERE r.doc_id = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""
