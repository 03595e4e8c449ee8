"""Sampled SentencePiece segmentation by forward filtering and backward sampling, and lossless decoding.

A text is cut into chunks: letters or symbols with the spaces before them, single digits, other white space. The few
pieces that reach across such cuts are left out, so the piece lattice of a text is the chain of its chunks' lattices: the
forward sums of a chunk are computed once and kept for later occurrences, and backward sampling runs over all occurrences
of a batch at once. A piece of rank r weighs
1 / (r + 2) ** theta; a segmentation's probability is in proportion to the product of its pieces' weights. The random
numbers are a hash of the row key, the chunk's place in the text and the step, so a row's segmentation is the same in any
batch, order or rerun. A character that is no piece falls back to its bytes, and so does a literal U+2581, which stands
for a space in pieces; joined pieces therefore give back every text byte for byte.

Chunks of more than LONG characters are walked through in blocks: forward sums are carried from block to block and
kept for every character, arcs are worked out again block by block on the way back, so memory stays bounded by the text
and no chunk is cut.

Cases: a null text gives null pieces, an empty one none; rows with equal key and text get equal pieces; a null key counts
as 0, a key that is no integer by its hash; an empty table gives an empty one; input columns that share a name with an
output are replaced, the others stay as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = re.compile(r" *[^\W\d_]+| *[^\w\s]+| +|_+|\d|\s")
#: Characters of a chunk from which on its lattice is not kept, and those of a block of it.
LONG, BLOCK = 4096, 1 << 16
#: Lattice arcs that a Python worker keeps, and characters that it works on at once.
KEPT_ARCS = 8_000_000
SLICE_CHARS = 2_000_000
SPACE, STAND_IN = "▁", "\U0010ffff"


@dataclass(frozen=True)
class PieceParams:
    model: str = MODEL
    theta: float = 1.5
    seed: int = 11


class Vocabulary:
    """What the sampler needs of a SentencePiece model: pieces as a trie, weights and bytes. Small enough to travel."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        self.weight = np.zeros(n)
        self.byte = np.zeros(256, np.int64)
        self.raw: list[bytes] = [b""] * n
        edges: dict[int, int] = {}
        ends = [-1]
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            if sp.is_byte(i):
                b = int(piece[1:-1], 16)
                self.byte[b], self.raw[i] = i, bytes([b])
                self.weight[i] = -theta * math.log(n + 2)
                continue
            text = piece.replace(SPACE, " ")
            self.raw[i], self.weight[i] = text.encode(), -theta * math.log(min(-sp.get_score(i), n) + 2)
            if not CHUNK.fullmatch(text):
                continue
            state = 0
            for c in piece:
                state = edges.setdefault(state << 21 | ord(c), len(ends))
                if state == len(ends):
                    ends.append(-1)
            ends[state] = i
        self.edge = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in sorted(edges)], np.int64)
        self.ends = np.array(ends, np.int64)
        self.longest = max(len(b.decode(errors="ignore")) for b in self.raw)

    def bytes_of(self, code: int) -> np.ndarray:
        return self.byte[list(chr(code).encode())]


class Sampler:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ends = np.empty(0, np.int64)
        self.first, self.share = np.empty(0, np.int64), np.empty(0)
        self.piece, self.before = np.empty(0, np.int32), np.empty(0, np.int64)
        self.nodes = 0

    def _arcs(self, codes: np.ndarray, real: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, piece and weight of every arc. All starts walk down the trie at once, one character a round. A
        character that is no piece gets one arc, numbered by its byte or by its code beyond the vocabulary."""
        v, found = self.v, []
        start, state, depth = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        single = np.zeros(len(codes), bool)
        while len(start):
            inside = start + depth < stop[start]
            start, state = start[inside], state[inside]
            want = state << 21 | codes[start + depth]
            at = np.minimum(np.searchsorted(v.edge, want), len(v.edge) - 1)
            hit = v.edge[at] == want
            start, state, depth = start[hit], v.to[at[hit]], depth + 1
            piece = v.ends[state]
            whole = piece >= 0
            found.append((start[whole], start[whole] + depth, piece[whole], v.weight[piece[whole]]))
            if depth == 1:
                single[start[whole]] = True
        bare = np.flatnonzero(~single)
        n_bytes = 1 + (real[bare] > 0x7F).astype(np.int64) + (real[bare] > 0x7FF) + (real[bare] > 0xFFFF)
        piece = np.where(n_bytes == 1, v.byte[np.minimum(real[bare], 127)], v.size + real[bare])
        found.append((bare, bare + 1, piece, n_bytes * v.weight[v.byte[0]]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _learn(self, chunks: list[str]) -> None:
        """Adds the lattices of new chunks: a node for each character, whose incoming arcs stand together and hold the
        running sum of their probabilities; -1 stands before the first node."""
        codes, real = _codes("".join(chunks))
        size = np.array([len(c) for c in chunks], np.int64)
        stop = np.cumsum(size)
        first = np.repeat(stop - size, size)
        start, end, piece, weight = self._arcs(codes, real, np.repeat(stop, size))
        order = np.lexsort((end, end - first[start]))
        start, end, piece, weight = start[order], end[order], piece[order], weight[order]
        place = end - first[start]
        opens = start == first[start]
        heads = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
        alpha, share = np.zeros(len(codes)), np.empty(len(start))
        rounds = np.searchsorted(place, np.arange(1, int(size.max()) + 2))
        for lo, hi in zip(rounds[:-1], rounds[1:]):  # ends at the same place of their chunks do not depend on each other
            seg = heads[np.searchsorted(heads, lo) : np.searchsorted(heads, hi)] - lo
            if hi == lo:
                continue
            x = weight[lo:hi] + np.where(opens[lo:hi], 0.0, alpha[start[lo:hi] - 1])
            width = np.diff(np.r_[seg, hi - lo])
            top = np.maximum.reduceat(x, seg)
            e = np.exp(x - np.repeat(top, width))
            total = np.add.reduceat(e, seg)
            alpha[end[lo:hi][seg] - 1] = top + np.log(total)
            run = np.cumsum(e)
            run -= np.repeat(run[seg] - e[seg], width)
            run /= np.repeat(total, width)
            run[np.r_[seg[1:], hi - lo] - 1] = 1.0
            share[lo:hi] = run
        order = np.argsort(end, kind="stable")
        for k, c in enumerate(chunks, len(self.ends)):
            self.known[c] = k
        self.ends = np.concatenate([self.ends, self.nodes + stop - 1])
        arcs = np.bincount(end - 1, minlength=len(codes))
        self.first = np.concatenate([self.first, len(self.share) + np.cumsum(arcs) - arcs])
        self.share = np.concatenate([self.share, share[order]])
        self.piece = np.concatenate([self.piece, piece[order].astype(np.int32)])
        self.before = np.concatenate([self.before, np.where(opens[order], -1, self.nodes + start[order] - 1)])
        self.nodes += len(codes)

    def _block_arcs(self, codes: np.ndarray, real: np.ndarray, lo: int, hi: int) -> tuple[list, list, list, np.ndarray]:
        """Start, piece and weight of the arcs that end in (lo, hi], by end, and the first arc of each end."""
        v = self.v
        a, b = max(lo - v.longest, 0), min(hi + v.longest, len(codes))
        start, end, piece, weight = self._arcs(codes[a:b], real[a:b], np.full(b - a, b - a))
        keep = (end + a > lo) & (end + a <= hi)
        start, end, piece, weight = start[keep] + a, end[keep] + a, piece[keep], weight[keep]
        order = np.argsort(end, kind="stable")
        start, end = start[order], end[order]
        return start.tolist(), piece[order].tolist(), weight[order].tolist(), np.searchsorted(end, np.arange(lo + 1, hi + 2)).tolist()

    def _walk(self, chunk: str, base: np.uint64) -> np.ndarray:
        """Pieces of one long chunk: forward sums of every place, then draws from the end on."""
        codes, real = _codes(chunk)
        alpha = np.zeros(len(codes) + 1)
        blocks = range(0, len(codes), BLOCK)
        for lo in blocks:
            hi = min(lo + BLOCK, len(codes))
            start, _, weight, first = self._block_arcs(codes, real, lo, hi)
            from_ = max(lo - self.v.longest, 0)
            sums = alpha[from_ : hi + 1].tolist()
            for e in range(lo + 1, hi + 1):
                x = [weight[i] + sums[start[i] - from_] for i in range(first[e - lo - 1], first[e - lo])]
                top = max(x)
                sums[e - from_] = top + math.log(sum(math.exp(y - top) for y in x))
            alpha[lo : hi + 1] = sums[lo - from_ :]
        out, place, step = [], len(codes), 0
        with np.errstate(over="ignore"):
            for lo in reversed(blocks):
                hi = min(lo + BLOCK, len(codes))
                start, piece, weight, first = self._block_arcs(codes, real, lo, hi)
                u = np.empty(0)
                at = 0
                while place > lo:
                    if at == len(u):
                        steps = np.arange(step, step + 4096, dtype=np.uint64)
                        u, at = (_mix(base + steps * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(11)).astype(np.float64) * 2.0**-53, 0
                    arcs = range(first[place - lo - 1], first[place - lo])
                    x = [weight[i] + alpha[start[i]] for i in arcs]
                    top = max(x)
                    e = [math.exp(y - top) for y in x]
                    left, pick = u[at] * sum(e), arcs[-1]
                    for i, y in zip(arcs, e):
                        if left < y:
                            pick = i
                            break
                        left -= y
                    out.append(piece[pick])
                    place, step, at = start[pick], step + 1, at + 1
        return np.array(out[::-1], np.int32)

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts in a row, and how many each text has."""
        if len(self.share) > KEPT_ARCS:
            self.forget()
        parts = [CHUNK.findall(t) for t in texts]
        new = set().union(*parts) - self.known.keys() if parts else set()
        big = {c for c in new if len(c) > LONG}
        long = [(t, k) for t, p in enumerate(parts) for k, c in enumerate(p) if len(c) > LONG] if big else []
        new -= big
        # An empty chunk holds a long one's place; its pieces are put in afterwards.
        own = {(t, k): self._walk(parts[t][k], _mix(keys)[t] + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) for t, k in long}
        for t, k in long:
            parts[t][k] = " "
            new |= {" "} - self.known.keys()
        if new:
            self._learn(sorted(new))
        known = self.known
        sizes = np.array([len(p) for p in parts], np.int64)
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        text_of = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        base = _mix(keys)[text_of] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        node, live = self.ends[at], np.arange(len(at))
        counts, steps = np.zeros(len(at), np.int64), []
        while len(live):
            u = (_mix(base[live] + np.uint64(len(steps) * 0xD1B54A32D192ED03 % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc = self.first[node]
            past = np.flatnonzero(self.share[arc] <= u)
            while len(past):
                arc[past] += 1
                past = past[self.share[arc[past]] <= u[past]]
            steps.append((live, self.piece[arc]))
            counts[live] += 1
            node = self.before[arc]
            on = node >= 0
            live, node = live[on], node[on]
        if long:
            first = np.cumsum(sizes) - sizes
            for t, k in long:
                counts[first[t] + k] = len(own[t, k])
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for t, (who, pieces) in enumerate(steps):
            out[ends[who] - 1 - t] = pieces
        for t, k in long:
            at_ = first[t] + k
            out[ends[at_] - counts[at_] : ends[at_]] = own[t, k]
        totals = np.bincount(text_of, counts, len(texts)).astype(np.int64)
        beyond = np.flatnonzero(out >= self.v.size)
        if not len(beyond):
            return out, totals
        codes = out[beyond] - self.v.size
        raw = {c: self.v.bytes_of(c) for c in set(codes.tolist())}
        extra = np.zeros(len(out), np.int64)
        extra[beyond] = [len(raw[c]) - 1 for c in codes.tolist()]
        text = np.repeat(np.arange(len(texts)), totals)
        spread = np.repeat(out, extra + 1)
        at = beyond + (np.cumsum(extra) - extra)[beyond]
        for i, c in zip(at.tolist(), codes.tolist()):
            spread[i : i + len(raw[c])] = raw[c]
        return spread, totals + np.bincount(text, extra, len(texts)).astype(np.int64)


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points as the pieces have them (U+2581 for a space, a stand-in for a literal U+2581), and as they are."""
    real = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.where(real == ord(SPACE), ord(STAND_IN), real)
    codes[real == ord(" ")] = ord(SPACE)
    return codes, real


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= SLICE_CHARS:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _row_keys(column: pa.Array, seed: int) -> np.ndarray:
    if pa.types.is_integer(column.type):
        keys = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    else:
        keys = np.array([0 if k is None else xxhash.xxh64_intdigest(str(k).encode()) for k in column.to_pylist()], np.uint64)
    return _mix(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))


def encode(docs: DataFrame, params: PieceParams = PieceParams(), key: str = "doc_id") -> DataFrame:
    """docs with pieces (array of ids), n_pieces, n_bytes and lossless (the decoded pieces equal the text)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(params.model, params.theta))  # its size is the model's
    new = ("pieces", "n_pieces", "n_bytes", "lossless")
    kept = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType([*kept, T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("lossless", T.BooleanType())])
    names, seed = [f.name for f in kept], params.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(vocabulary.value)
        raw = vocabulary.value.raw
        for batch in batches:
            whole = batch.column("text").to_pylist()
            for a, b in _slices(whole):
                part, texts = batch.slice(a, b - a), [t or "" for t in whole[a:b]]
                pieces, counts = sampler.sample(texts, _row_keys(part.column(key), seed))
                ends = np.concatenate([[0], np.cumsum(counts)])
                ids = pieces.tolist()
                utf8 = [t.encode() for t in texts]
                back = [b"".join(map(raw.__getitem__, ids[x:y])) == t for x, y, t in zip(ends[:-1], ends[1:], utf8)]
                null = pa.array([t is None for t in whole[a:b]])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pieces), mask=null)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), lists, pa.array(counts), pa.array([len(t) for t in utf8], pa.int64()), pa.array(back)],
                    names=[*names, *new],
                )

    return docs.select(*names).mapInArrow(tidy(run), schema)


def decode(df: DataFrame, params: PieceParams = PieceParams(), column: str = "pieces", to: str = "decoded") -> DataFrame:
    """df with the text that its pieces stand for; null pieces give null."""
    raw = df.sparkSession.sparkContext.broadcast(Vocabulary(params.model, params.theta).raw)
    kept = [f for f in df.schema.fields if f.name != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if p is None else b"".join(map(raw.value.__getitem__, p)).decode() for p in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), to])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(to, T.StringType())]))
