"""Language-model scoring with an Elias-Fano n-gram trie, memory-mapped.

Level 1 holds the words as sorted 63-bit hashes (Elias-Fano) and their counts in as few bytes as they take; a word's
number is its place. Level k holds the n-grams of k words as successors of contexts, the numbered n-grams of level
k - 1: monotone pointers (Elias-Fano) lead to each context's first successor, and word numbers, each on its context's base
(the context's place times V), make one monotone Elias-Fano sequence of a shard. An n-gram is found by a successor search
between its context's pointer and as many successors further, for its word on that base. With it go discounted
probabilities and a back-off weight for each context, quantised to 16 bits. P(w|c) = max(n(cw) - D, 0) / n(c) + D N1+(c) / n(c) P(w|c without its first word),
down to P(w) = (n(w) + A) / (N + A (V + 1)), where an unknown word has n = 0; a text begins and ends with the end token.

Each level is dealt to shards by ranges of context numbers, from sorted counts that every task has pre-aggregated for
blocks of texts, so a frequent n-gram is one entry a block. A context with more than a share HOT of a shard's tokens (and
of all tokens) is hot: its successors go to the shards of their own words instead, and its totals, a few rows, are summed apart. A
shard is one file a level in the shared folder. Nothing else about the corpus passes through the driver but a row for
each shard. Scoring tasks map the files as they need them, MOST_OPEN at a time and without keeping them open, or read them whole
from a store that isn't mounted, and look up the distinct n-grams of a block of texts in order.

Defined cases: a null text is empty, which is one end token; without training texts every word is unknown; rows with
equal ids are scored alike if their texts are; null ids count as the empty text when ids choose the training rows.
Words are told apart by 63 bits. Numbers of contexts and words that don't fit into 63 bits together are sorted as pairs.
Empty tables give empty results.
"""

from __future__ import annotations

import json
import math
import mmap
import sys
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, new_dir, session, stored, word_hashes, write_file

A, D, ORDER = 0.1, 0.75, 3
SHARD_TOKENS = 1_500_000
BLOCK_TOKENS = 1_000_000
HASH_BITS = 63
#: A context is hot if it has this share of a shard's tokens and at least the other share of all tokens: 10,000 at most.
HOT, HOT_OF_ALL = 0.125, 1e-4
#: The end token's hash; no word has it.
END = np.uint64((1 << HASH_BITS) - 1)
#: log10 of a probability between LEAST and 0, in 65,534 steps; 65,535 is none.
LEAST, NONE = -16.0, 65_535
LN10 = math.log(10)
#: Shards that a worker has mapped at a time; where a map keeps its file open, fewer.
MOST_OPEN = 2_048 if sys.version_info >= (3, 13) else 200
#: Queries that are searched for together; their arrays stay in a processor's cache.
STEP = 1 << 15

BYTE_SELECT = np.zeros((256, 8), np.int64)
for _b in range(256):
    _at = [i for i in range(8) if _b >> i & 1]
    BYTE_SELECT[_b, : len(_at)] = _at


def quantised(log_p: np.ndarray) -> np.ndarray:
    """On a square-root scale: the likelier, the finer."""
    return np.round(np.sqrt(np.clip(log_p, LEAST, 0) / LEAST) * (NONE - 1)).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    return np.square(q.astype(np.float64) / (NONE - 1)) * LEAST


def select_in(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one of each 64-bit word, by halves."""
    at = np.zeros(len(x), np.int64)
    for width in (32, 16, 8):
        low = x & np.uint64((1 << width) - 1)
        n = np.bitwise_count(low).astype(np.int64)
        over = k >= n
        k = k - n * over
        x = np.where(over, x >> np.uint64(width), low)
        at += width * over
    return at + BYTE_SELECT[(x & np.uint64(255)).astype(np.int64), np.clip(k, 0, 7)]


class EliasFano:
    """A sorted sequence of integers: low bits packed, high bits in unary, with counts of ones and zeros for select."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray, n: int, bits: int):
        self.low, self.high, self.ones, self.zeros, self.n, self.bits = low, high, ones, zeros, n, bits
        self.words = np.ndarray((max(1, len(low) - 7),), "<u8", low.tobytes() if not low.flags.c_contiguous else low, strides=(1,))
        self.top = int(self.get(np.array([n - 1]))[0] >> np.uint64(bits)) if n else -1

    @staticmethod
    def arrays(values: np.ndarray, universe: int) -> dict:
        n = len(values)
        bits = min(56, max(0, (universe // n).bit_length() - 1)) if n else 0  # with a byte's shift they lie in 64 bits
        v = values.astype(np.uint64)
        parts = [np.zeros(0, np.uint8)]
        if bits:
            for i in range(0, n, 1 << 14):  # a multiple of 8 values ends on a byte
                part = v[i : i + (1 << 14)] & np.uint64((1 << bits) - 1)
                own = part.view(np.uint8).reshape(-1, 8) if part.dtype.isnative else part
                parts.append(np.packbits(np.unpackbits(own, axis=1, bitorder="little")[:, :bits], bitorder="little"))
        top = (v >> np.uint64(bits)).astype(np.int64)
        length = (int(top[-1]) if n else 0) + n + 2
        unary = np.zeros(-(-length // 64) * 64 + 64, bool)
        unary[top + np.arange(n)] = True
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]])
        return {"low": np.concatenate([*parts, np.zeros(8, np.uint8)]), "high": high, "ones": ones, "zeros": np.arange(len(ones)) * 64 - ones, "n": n, "bits": bits}

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Places of the k-th ones, or zeros, of the unary part."""
        before = self.ones if one else self.zeros
        word = np.searchsorted(before, k, "right") - 1
        own = self.high[word]
        return word * 64 + select_in(own if one else ~own, k - before[word])

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        return (self.words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        top = self.select(i, True) - i
        return (top.astype(np.uint64) << np.uint64(self.bits)) | self.lows(i)

    def find(self, v: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """The place of each value, -1 where it isn't: a successor search inside the bucket of its high bits, and, if given,
        between the places low and high (exclusive). Quickest for sorted values."""
        if not self.n or not len(v):
            return np.full(len(v), -1, np.int64)
        parts = [slice(i, i + STEP) for i in range(0, len(v), STEP)]
        return np.concatenate([self.found(v[x], *((low[x], high[x]) if low is not None else ())) for x in parts])

    def found(self, v: np.ndarray, least: np.ndarray | None = None, most: np.ndarray | None = None) -> np.ndarray:
        out = np.full(len(v), -1, np.int64)
        top = (v >> np.uint64(self.bits)).astype(np.int64)
        within = np.flatnonzero((top <= self.top) & (top >= 0))
        if not len(within):
            return out
        top, low = top[within], v[within] & np.uint64((1 << self.bits) - 1)
        place = np.where(top > 0, self.select(np.maximum(top - 1, 0), False) + 1, 0)
        first = place - top
        # the ones of a bucket follow its place: as many as trail in the next 64 bits, or up to the next zero
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        x = (self.high[word] >> shift) | np.where(shift > 0, self.high[np.minimum(word + 1, len(self.high) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        run = np.bitwise_count(x ^ (x + np.uint64(1))).astype(np.int64) - 1
        long = np.flatnonzero(run >= 63)
        run[long] = self.select(top[long], False) - top[long] - first[long]
        # a bucket of a frequent context can be long: halve it
        last = first + run
        if least is not None:
            first, last = np.maximum(first, least[within]), np.minimum(last, most[within])
        end, live = last.copy(), np.flatnonzero(first < last)
        while len(live):
            mid = (first[live] + end[live]) >> 1
            under = self.lows(mid) < low[live]
            first[live] = np.where(under, mid + 1, first[live])
            end[live] = np.where(under, end[live], mid)
            live = live[first[live] < end[live]]
        can = np.flatnonzero(first < last)
        hit = can[self.lows(first[can]) == low[can]]
        out[within[hit]] = first[hit]
        return out


# --- files -------------------------------------------------------------------------------------------------------


def packed(parts: dict[str, np.ndarray | int]) -> bytes:
    """Named arrays and numbers in one block: header length, header, arrays at multiples of 8."""
    head, body, at = {}, [], 0
    for name, x in parts.items():
        if isinstance(x, np.ndarray):
            data = x.tobytes()
            head[name] = [x.dtype.str, at, len(x)]
            body.append(data + b"\0" * (-len(data) % 8))
            at += len(body[-1])
        else:
            head[name] = int(x)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def mapped(uri: str) -> dict[str, np.ndarray | int]:
    """The same, memory-mapped; from a store that isn't mounted, in memory."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))
    else:
        with fs.open_input_file(path) as f:
            data = f.read()
    n = int.from_bytes(data[:8], "little")
    head = json.loads(data[8 : 8 + n])
    return {k: x if isinstance(x, int) else np.frombuffer(data, x[0], x[2], 8 + n + x[1]) for k, x in head.items()}


def of(parts: dict, name: str) -> EliasFano:
    return EliasFano(*(parts[f"{name}.{k}"] for k in ("low", "high", "ones", "zeros", "n", "bits")))


def named(name: str, arrays: dict) -> dict:
    return {f"{name}.{k}": v for k, v in arrays.items()}


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers (0 or more) in as few bytes as the largest takes."""
    most = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


# --- counts ------------------------------------------------------------------------------------------------------


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each text with the end token before and behind, and the n + 1 places where texts begin."""
    h, first = word_hashes(column)
    n = len(column)
    out = np.full(len(h) + 2 * n, END, np.uint64)
    out[np.arange(len(h)) + 2 * np.repeat(np.arange(n), np.diff(first)) + 1] = np.minimum(h >> np.uint64(1), END - np.uint64(1))
    return out, first + 2 * np.arange(n + 1)


def held(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Batches until they hold BLOCK_TOKENS, their tokens, and where texts begin."""
    own, tokens, first, n = [], [], [np.zeros(1, np.int64)], 0
    for b in batches:
        if b.num_rows:
            t, at = texts(b.column(column))
            own.append(b)
            tokens.append(t)
            first.append(at[1:] + n)
            n += len(t)
        if n > BLOCK_TOKENS:
            yield own, np.concatenate(tokens), np.concatenate(first)
            own, tokens, first, n = [], [], [np.zeros(1, np.int64)], 0
    if own:
        yield own, np.concatenate(tokens), np.concatenate(first)


def summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how often each occurs, or the sum of its n."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n, first) if len(first) else n


def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of each key among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(keys) else np.zeros(0, bool)
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return ranked[new], at


def word_counts(bits: int):
    """mapInArrow: text -> shard, its word hashes of a block, their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, first in held(batches, 0):
            keep = np.ones(len(tokens), bool)
            keep[first[:-1]] = False
            h, n = summed(tokens[keep])
            edge = np.searchsorted((h >> np.uint64(HASH_BITS - bits)).view(np.int64), np.arange((1 << bits) + 1))
            full = np.flatnonzero(np.diff(edge))
            part = lambda x: pa.array([x[edge[i] : edge[i + 1]].tobytes() for i in full], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), part(h), part(n.astype(np.uint32))], ["shard", "h", "n"])

    return run


def merged_words(folder: str, heavy: int):
    """mapInArrow: rows of one shard after another -> a file a shard; its words, tokens and heavy words (place, count)."""

    def done(shard: int, h: list[bytes], n: list[bytes]) -> pa.RecordBatch:
        words, counts = summed(np.frombuffer(b"".join(h), np.uint64), np.frombuffer(b"".join(n), np.uint32).astype(np.int64))
        name = f"{uuid.uuid4().hex}.words"
        big = np.flatnonzero(counts >= NONE)
        write_file(f"{folder}/{name}", packed({**named("hash", EliasFano.arrays(words, 1 << HASH_BITS)), "count": narrow(np.minimum(counts, NONE)), "big": big, "big_count": counts[big]}))
        hot = np.flatnonzero(counts >= heavy)
        kind = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(words)]), pa.array([int(counts.sum())]), pa.array([hot], kind), pa.array([counts[hot]], kind)], ["shard", "file", "n_entries", "n_tokens", "hot", "hot_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, h, n = None, [], []
        for b in batches:
            for s, x, y in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if h and s != shard:
                    yield done(shard, h, n)
                    h, n = [], []
                shard = s
                h.append(x)
                n.append(y)
        if h:
            yield done(shard, h, n)

    return run


SHARDS = "shard int, file string, n_entries long, n_tokens long, hot array<long>, hot_n array<long>"


class Model:
    """What a task needs to open the trie: of each level its shards (shard, file, entries, tokens), its hot n-grams and
    their counts, and for each level of n-grams the hot contexts' back-off weights."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.levels, self.back = folder, bits, [], []

    def add(self, rows: list, heavy: int) -> None:
        listed = tuple(sorted((r["shard"], r["file"], r["n_entries"], r["n_tokens"]) for r in rows))
        base = np.zeros((1 << self.bits) + 1, np.int64)
        for s, _, n, _ in listed:
            base[s + 1] = n
        base = np.cumsum(base)
        hot = sorted((int(base[r["shard"]]) + i, n) for r in rows for i, n in zip(r["hot"], r["hot_n"], strict=True) if n >= heavy)
        self.levels.append((listed, base, np.array([i for i, _ in hot], np.int64), np.array([n for _, n in hot], np.int64)))

    @property
    def v(self) -> int:
        return int(self.levels[0][1][-1])

    @property
    def n(self) -> int:
        return sum(x[3] for x in self.levels[0][0])


class Opened:
    """The files of a model, in one worker: mapped when they are needed, and let go when too many others are."""

    def __init__(self, model: Model, most: int = MOST_OPEN):
        self.model, self.most = model, most
        self.files = [{s: name for s, name, _, _ in level[0]} for level in model.levels]
        self.held: OrderedDict[tuple[int, int], tuple[dict, dict[str, EliasFano]]] = OrderedDict()

    def shard(self, level: int, s: int) -> tuple[dict, dict[str, EliasFano]] | None:
        """A shard's arrays and sequences; None if it has no file."""
        if s not in self.files[level]:
            return None
        key = (level, s)
        if key not in self.held:
            if len(self.held) >= self.most:
                self.held.popitem(last=False)
            parts = mapped(f"{self.model.folder}/{self.files[level][s]}")
            self.held[key] = parts, {x: of(parts, x) for x in (("pointer", "next") if level else ("hash",))}
        self.held.move_to_end(key)
        return self.held[key]

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes -> word numbers (-1: unknown) and counts."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        edge = np.searchsorted((h >> np.uint64(HASH_BITS - self.model.bits)).view(np.int64), np.arange((1 << self.model.bits) + 1))
        for s in np.flatnonzero(np.diff(edge)).tolist():
            i, j = edge[s], edge[s + 1]
            if own := self.shard(0, s):
                parts, at = own[0], own[1]["hash"].find(h[i:j])
                hit = np.flatnonzero(at >= 0)
                n = parts["count"][at[hit]].astype(np.int64)
                if len(parts["big"]):
                    k = np.minimum(np.searchsorted(parts["big"], at[hit]), len(parts["big"]) - 1)
                    n = np.where(parts["big"][k] == at[hit], parts["big_count"][k], n)
                ids[i + hit], counts[i + hit] = self.model.levels[0][1][s] + at[hit], n
        return ids, counts

    def look_up(self, k: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level k + 2 (k from 0): distinct known contexts with words (-1: unknown), sorted -> numbers of the n-grams (-1: none), log10 probability."""
        number, log_p = np.full(len(context), -1, np.int64), np.full(len(context), -np.inf)
        shard, local = shard_and_place(self.model, k, context, word)
        known = np.flatnonzero(word >= 0)
        order = known[np.argsort(shard[known], kind="stable")]
        ranked = shard[order]
        for s in np.unique(ranked).tolist():
            own = order[np.searchsorted(ranked, s) : np.searchsorted(ranked, s, "right")]
            if held := self.shard(k + 1, s):
                parts, pointer, after = held[0], held[1]["pointer"], held[1]["next"]
                place = local[own]
                new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                many = np.diff(np.append(new, len(place)))
                first = pointer.get(place[new]).astype(np.int64)
                end = first + parts["kinds"][place[new]]
                base = place.astype(np.uint64) * np.uint64(max(1, self.model.v))
                at = after.find(base + word[own].astype(np.uint64), np.repeat(first, many), np.repeat(end, many))
                hit = np.flatnonzero(at >= 0)
                number[own[hit]] = self.model.levels[k + 1][1][s] + at[hit]
                log_p[own[hit]] = restored(parts["p"][at[hit]])
        return number, log_p

    def back_off(self, k: int, context: np.ndarray) -> np.ndarray:
        """log10 of the back-off weights of distinct known contexts of level k + 2; 0 where a context has no successor."""
        out = np.zeros(len(context))
        _, base, hot, _ = self.model.levels[k]
        shard = np.searchsorted(base, context, "right") - 1
        edge = np.searchsorted(shard, np.arange(len(base)))
        for s in np.flatnonzero(np.diff(edge)).tolist():
            i, j = edge[s], edge[s + 1]
            if held := self.shard(k + 1, s):
                parts = held[0]
                q = parts["back"][context[i:j] - base[s]]
                out[i:j] = np.where(q == NONE, 0, restored(q))
        if len(hot):
            at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
            mine = hot[at] == context
            out[mine] = self.model.back[k][at[mine]]
        return out


OPENED: dict[str, Opened] = {}


def opened(key: str, model: Model) -> Opened:
    """The files of a model, opened once a worker."""
    if key not in OPENED:
        OPENED.clear()
        OPENED[key] = Opened(model)
    return OPENED[key]


def shard_and_place(model: Model, k: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of n-grams with contexts of level k + 1 (counted from 0): the shard, and the context's place there. A hot
    context's successors lie in the shards of their words, behind the shard's own contexts."""
    _, base, hot, _ = model.levels[k]
    shard = np.searchsorted(base, context, "right") - 1
    place = context - base[shard]
    if len(hot):
        at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
        mine = np.flatnonzero((hot[at] == context) & (word >= 0))
        shard[mine] = np.searchsorted(model.levels[0][1], word[mine], "right") - 1
        place[mine] = np.diff(base)[shard[mine]] + at[mine]
    return shard, place


def pair_places(context: np.ndarray, word: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (words from -1 up), sorted, and the place of each pair among them."""
    width = max(1, int(v + 1).bit_length())
    if not len(context):
        return context, word, np.zeros(0, np.int64)
    if int(context.max()).bit_length() + width <= 63:
        key, at = places((context << width) | (word + 1))
        return key >> width, (key & ((1 << width) - 1)) - 1, at
    order = np.lexsort((word, context))
    c, w = context[order], word[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return c[new], w[new], at


class Walk:
    """Word numbers of a block's tokens, then level after level the number of the n-gram that ends at each token."""

    def __init__(self, trie: Opened, tokens: np.ndarray, first: np.ndarray):
        self.trie = trie
        h, at = places(tokens)
        ids, counts = trie.numbers(h)
        self.word, self.count = ids[at], counts[at]
        self.k, self.number = 0, self.word
        # how many tokens of its text stand before each token
        self.before = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that have a context of k + 1 words whose n-gram is known, and these contexts."""
        at = np.flatnonzero(self.before > self.k)
        context = self.number[at - 1]
        known = context >= 0
        return at[known], context[known]

    def step(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """To the next level: the tokens with a known context, their log10 probabilities, their contexts' back-off weights."""
        at, context = self.pairs()
        c, w, place = pair_places(context, self.word[at], self.trie.model.v)
        number, log_p = self.trie.look_up(self.k, c, w)
        new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        back = np.repeat(self.trie.back_off(self.k, c[new]), np.diff(np.append(new, len(c))))
        self.number = np.full(len(self.word), -1, np.int64)
        self.number[at] = number[place]
        self.k += 1
        return at, log_p[place], back[place]


def gram_counts(model: Model, key: str):
    """mapInArrow: text -> shard, and a block's n-grams there, as grams() packs them."""
    k = len(model.levels) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, first in held(batches, 0):
            walk = Walk(opened(key, model), tokens, first)
            for _ in range(k):
                walk.step()
            at, context = walk.pairs()
            c, w, place = pair_places(context, walk.word[at], model.v)
            n = np.bincount(place, minlength=len(c))
            shard, local = shard_and_place(model, k, c, w)
            hot = np.isin(c, model.levels[k][2])
            by = np.flatnonzero(hot)
            # the others are in the order of shard, place and word already
            for own in (np.flatnonzero(~hot), by[np.lexsort((w[by], local[by], shard[by]))]):
                if len(own):
                    yield grams(shard[own], local[own], w[own], n[own])

    return run


def grams(shard: np.ndarray, place: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row for each shard: the gaps between contexts' places, how many n-grams each has, their words and counts."""
    edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])).tolist()
    out = []
    for i, j in zip(edge[:-1], edge[1:], strict=True):
        own = place[i:j]
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        many = narrow(n[i:j]) if n[i:j].max() > 1 else np.zeros(0, np.uint8)
        out.append(packed({"c": narrow(np.diff(own[new], prepend=0)), "m": narrow(np.diff(np.append(new, j - i))), "w": narrow(word[i:j]), "n": many}))
    return pa.RecordBatch.from_arrays([pa.array(shard[edge[:-1]], pa.int32()), pa.array(out, pa.binary())], ["shard", "grams"])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts' places, words and counts of one row of grams()."""
    size = int.from_bytes(data[:8], "little")
    x = {k: np.frombuffer(data, t, n, 8 + size + at) for k, (t, at, n) in json.loads(data[8 : 8 + size]).items()}
    place = np.repeat(np.cumsum(x["c"].astype(np.int64)), x["m"])
    return place, x["w"].astype(np.int64), x["n"].astype(np.int64) if len(x["n"]) else np.ones(len(place), np.int64)


def merged_grams(model: Model, heavy: int):
    """mapInArrow: rows of one shard after another -> a file a shard; its n-grams, heavy ones (place, count), and the kinds
    of successors of each hot context there."""
    k = len(model.levels) - 1
    folder, v, (_, base, hot, hot_n) = model.folder, model.v, model.levels[k]

    def done(shard: int, rows: list[bytes]) -> pa.RecordBatch:
        place, word, n = (np.concatenate(x) for x in zip(*map(unpacked, rows), strict=True))
        value, n = summed(place.astype(np.uint64) * np.uint64(v) + word.astype(np.uint64), n)
        place = (value // np.uint64(v)).astype(np.int64)
        size = int(base[shard + 1] - base[shard])
        first = np.searchsorted(place, np.arange(size + len(hot) + 1))
        kinds = np.diff(first)
        total = np.bincount(place, n, size + len(hot))
        total[size:] = hot_n
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(kinds[:size] > 0, quantised(np.log10(D * kinds[:size] / total[:size])), NONE).astype(np.uint16)
        parts = {
            **named("pointer", EliasFano.arrays(first.astype(np.uint64), len(value) + 1)), "kinds": narrow(kinds), **named("next", EliasFano.arrays(value, (size + len(hot)) * v)),
            "p": quantised(np.log10((n - D) / total[place])), "back": back,
        }
        name = f"{uuid.uuid4().hex}.grams"
        write_file(f"{folder}/{name}", packed(parts))
        big, kind = np.flatnonzero(n >= heavy), pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(value)]), pa.array([int(n.sum())]), pa.array([big], kind), pa.array([n[big]], kind), pa.array([kinds[size:]], kind)], ["shard", "file", "n_entries", "n_tokens", "hot", "hot_n", "kinds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if rows and s != shard:
                    yield done(shard, rows)
                    rows = []
                shard = s
                rows.append(x)
        if rows:
            yield done(shard, rows)

    return run


def trained(docs: DataFrame, order: int = ORDER) -> Model:
    """The trie of all texts of docs (column text), for n-grams of up to `order` words."""
    spark = session(docs.sparkSession)
    text = docs.select(F.col("text").cast("string"))
    size = text.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    bits = max(0, math.ceil(math.log2(max(1, ((size[0] or 0) / 6 + size[1]) / SHARD_TOKENS))))
    model, n = Model(new_dir(spark, "trie"), bits), 1 << bits
    dealt = lambda df: df.repartitionById(n, "shard")
    heavy = lambda: max(2, int(HOT * SHARD_TOKENS), int(HOT_OF_ALL * model.n) if model.levels else 0)
    words = stored(dealt(text.mapInArrow(word_counts(bits), "shard int, h binary, n binary")).mapInArrow(merged_words(model.folder, heavy()), SHARDS), "word-shards").collect()
    total = sum(r["n_tokens"] for r in words)
    model.add(words, max(heavy(), int(HOT_OF_ALL * total)))
    while model.v and len(model.levels) < order:
        counts = text.mapInArrow(gram_counts(model, uuid.uuid4().hex), "shard int, grams binary")
        grams = stored(dealt(counts).mapInArrow(merged_grams(model, heavy()), SHARDS + ", kinds array<long>"), "gram-shards")
        _, _, hot, hot_n = model.levels[-1]
        kinds = np.zeros(len(hot), np.int64)
        for r in grams.select(F.posexplode("kinds").alias("i", "kinds")).groupBy("i").agg(F.sum("kinds").alias("kinds")).collect():
            kinds[r["i"]] = r["kinds"]
        with np.errstate(divide="ignore"):
            model.back.append(np.where(kinds > 0, np.log10(D * kinds / np.maximum(hot_n, 1)), 0.0))
        model.add(grams.drop("kinds").collect(), heavy())  # a row a shard
    return model


def scored(docs: DataFrame, model: Model, more: tuple[Column, ...] = ()) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_tokens, n_known, base_score and score of every row, then what else is asked for."""
    session(docs.sparkSession)
    extra = [f"_x{i}" for i in range(len(more))]
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(c.alias(x) for c, x in zip(more, extra, strict=True)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[2:])
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = model.n + A * (model.v + 1)
        for own, tokens, first in held(batches, 1):
            walk = Walk(opened(key, model), tokens, first)
            p1 = (walk.count + A) / whole
            prob = p1.copy()
            for _ in range(1, len(model.levels)):
                at, log_p, back = walk.step()
                prob[at] = np.exp(log_p * LN10) + np.exp(back * LN10) * prob[at]
            keep = walk.before > 0  # not the end token before a text
            size = np.diff(first) - 1
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            base, score, n_known = (np.add.reduceat(x[keep], start) for x in (np.log10(p1), np.log10(prob), (walk.word >= 0).astype(np.int64)))
            i = 0
            for b in own:
                j = i + b.num_rows
                cols = [b.column(0), pa.array(size[i:j]), pa.array(n_known[i:j]), pa.array(base[i:j]), pa.array(score[i:j]), *b.columns[2:]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_known", "base_score", "score", *extra])
                i = j

    return docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double" + (", " + kinds if kinds else ""))
