"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A benchmark item is found in a document when the document's set of five-word shingles has at least 0.8 of the item's.
A long document's set dwarfs a short item's, so each document is first restricted to the shingles that occur in any
item of the block: the containment stays the same and the sets become comparable. Items are indexed by MinHash bands
and partitioned by size; a document's restricted size picks, for each size class, the band width whose miss rate at
the implied Jaccard similarity is below MISS. Where even one-row bands cannot reach it (a document with the shingles
of very many items), the class is counted exactly by posting lists instead. Candidates are verified exactly.

No document is shuffled. The benchmark is dealt at random to blocks of about BLOCK_ITEMS items or BLOCK_BYTES of text, and the
task that gets a block stores its index as a file in the shared folder; the driver sees a name a block. Documents stream
past the indexes: a task takes CHUNK_WORDS words of texts at a time, hashes them once and tries every index on them, of
which it holds KEPT. Words are lower-cased runs of letters, digits and '_'.

Defined cases: null and empty texts have no shingle and match nothing, as items and as documents; an item of one to
four words is one shingle of its own length; equal items and equal documents each give their own rows.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, WordHashes, filesystem, mix, new_dir, session, shingle_hashes, stored, write_file

WIDTH, THRESHOLD = 5, 0.8
PERMS, ROWS, MISS = 256, (8, 6, 4, 3, 2, 1), 1e-6
BLOCK_ITEMS, BLOCK_BYTES, FILTER_BITS = 5_000, 8 << 20, 22
#: Words of the texts that a task tries on one index after another, and indexes that it keeps.
CHUNK_WORDS, KEPT = 4 << 20, 4
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def rows_for(jaccard: float) -> int:
    """The widest bands of PERMS hashes that miss a pair of this similarity with probability under MISS; 0: none do."""
    return next((r for r in ROWS if (1 - jaccard**r) ** (PERMS // r) < MISS), 0)


HASHES = WordHashes()


class Index:
    """The items of one block."""

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float = THRESHOLD):
        self.threshold = threshold
        texts = [words(t) for _, t in items]
        sets = [np.unique(shingle_hashes(HASHES.of(w), WIDTH)) for w in texts]
        keep = [i for i, s in enumerate(sets) if len(s)]
        self.ids, self.sets = [items[i][0] for i in keep], [sets[i] for i in keep]
        self.widths = sorted({min(WIDTH, len(texts[i])) for i in keep})
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.need = np.ceil(threshold * self.size - 1e-9).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *self.sets])
        owner = np.repeat(np.arange(len(self.sets)), self.size)
        self.universe, at = np.unique(flat, return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.posting, self.first = owner[order], np.searchsorted(at[order], np.arange(len(self.universe) + 1))
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[(self.universe & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        rng = np.random.default_rng(11)
        self.seeds = rng.integers(1, 1 << 63, PERMS, dtype=np.uint64) | np.uint64(1)
        # size classes: items whose sizes share a power of two; bands of each class and each number of rows
        self.classes = defaultdict(list)
        for i, n in enumerate(self.size.tolist()):
            self.classes[n.bit_length()].append(i)
        self.least = {c: min(self.size[i] for i in own) for c, own in self.classes.items()}
        #: Sorted band keys and the item of each.
        self.bands: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        signatures = [self.signature(s) for s in self.sets]
        for c, own in self.classes.items():
            for r in ROWS:
                keys = np.concatenate([self.keys(signatures[i], r) for i in own])
                order = np.argsort(keys)
                self.bands[c, r] = keys[order], np.repeat(np.array(own, np.int32), PERMS // r)[order]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 4096):
            h = mix((shingles[i : i + 4096, None] ^ self.seeds[None]) * MIX)
            np.minimum(out, h.min(0), out)
        return out

    @staticmethod
    def keys(signature: np.ndarray, r: int) -> np.ndarray:
        h = np.arange(1, PERMS // r + 1, dtype=np.uint64) * MIX
        for k in range(r):
            h = (h ^ signature[k::r][: PERMS // r]) * MIX
            h ^= h >> np.uint64(31)
        return mix(h)

    def restricted(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the item shingles that a text with these word hashes has."""
        found = []
        for width in self.widths:
            if len(h) >= width:
                s = shingle_hashes(h, width)
                s = s[self.bits[(s & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]]
                if len(s):
                    at = np.minimum(np.searchsorted(self.universe, s), len(self.universe) - 1)
                    found.append(at[self.universe[at] == s])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def counted(self, own: np.ndarray) -> np.ndarray:
        """How many of these shingles each item has."""
        if not len(own):
            return np.zeros(len(self.sets), np.int64)
        n = self.first[own + 1] - self.first[own]
        at = np.repeat(self.first[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.posting[at], minlength=len(self.sets))

    def match(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(number of item, shingles shared) of every item that a text with these word hashes contains."""
        own = self.restricted(h)
        if not len(own):
            return []
        signature, found, counts = None, set(), None
        for c, members in self.classes.items():
            q, u = int(self.least[c]), len(own)
            if u < self.threshold * q - 1e-9:
                continue
            # the intersection is at least threshold * q, so the union is at most u + (1 - threshold) * q
            r = rows_for(min(1.0, self.threshold * q / (u + (1 - self.threshold) * q)))
            if r == 0:
                counts = self.counted(own) if counts is None else counts
                found.update(i for i in members if counts[i] >= self.need[i])
                continue
            signature = self.signature(self.universe[own]) if signature is None else signature
            keys, items = self.bands[c, r]
            wanted = self.keys(signature, r)
            first, last = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
            for i in np.flatnonzero(first < last):
                found.update(items[first[i] : last[i]].tolist())
        mine = self.universe[own]
        out = []
        for i in sorted(found):
            shared = len(np.intersect1d(self.sets[i], mine, assume_unique=True))
            if shared >= self.need[i]:
                out.append((i, shared))
        return out


def indexed(folder: str, threshold: float):
    """mapInArrow over the items of one block after another: a stored index each."""

    def done(block: int, items: list[tuple[int | None, str | None]]) -> pa.RecordBatch:
        name = f"{folder}/{block}-{uuid.uuid4().hex}.index"
        write_file(name, pickle.dumps(Index(items, threshold), 5))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([name])], ["block", "file"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, items = None, []
        for b in batches:
            for k, item_id, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if items and k != block:
                    yield done(block, items)
                    items = []
                block = k
                items.append((item_id, text))
        if items:
            yield done(block, items)

    return run


def blocks(items: DataFrame, threshold: float, id_col: str = "item_id") -> list[str]:
    """The files of the items' indexes. Rows are dealt by a hash of what they hold and of their place, so that equal items
    are many blocks' too. An item of more than a block's bytes makes its block larger."""
    spark = items.sparkSession
    items = items.select(F.col(id_col).cast("long").alias("item_id"), F.col("text").cast("string"))
    size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    n = max(size[0] // BLOCK_ITEMS, (size[1] or 0) // BLOCK_BYTES) + 1
    dealt = items.withColumn("row", F.monotonically_increasing_id()).select(F.pmod(F.xxhash64("item_id", "text", "row"), F.lit(n)).cast("int").alias("block"), "item_id", "text")
    made = stored(dealt.repartitionById(n, "block").mapInArrow(indexed(new_dir(spark, "benchmark"), threshold), "block int, file string"), "benchmark-files")
    return [r["file"] for r in made.orderBy("block").collect()]  # a row a block


INDEXES: OrderedDict[str, Index] = OrderedDict()


def index_of(file: str) -> Index:
    """A stored index; a worker keeps the last KEPT."""
    if file not in INDEXES:
        while len(INDEXES) >= KEPT:
            INDEXES.popitem(last=False)
        fs, path = filesystem(file)
        with fs.open_input_file(path) as f:
            INDEXES[file] = pickle.loads(f.read())
    INDEXES.move_to_end(file)
    return INDEXES[file]


def hashed(batches: Iterator[pa.RecordBatch], at: int, many: bool) -> Iterator[tuple[list[pa.RecordBatch], list[list[np.ndarray]]]]:
    """Batches, and the word hashes of their texts (column at): CHUNK_WORDS at a time where there are many indexes."""
    own, words_, n = [], [], 0
    for b in batches:
        own.append(b)
        words_.append([HASHES.of(words(t)) for t in b.column(at).to_pylist()])
        n += sum(map(len, words_[-1]))
        if not many or n >= CHUNK_WORDS:
            yield own, words_
            own, words_, n = [], [], 0
    if own:
        yield own, words_


PAIRS = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def pairs(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for every document (doc_id, text) and every item (item_id, text) that it contains."""
    session(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    files = blocks(items, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, texts in hashed(batches, 1, len(files) > 1):
            for file in files:
                index = index_of(file)
                for b, hashes in zip(own, texts, strict=True):
                    rows = [(d, index.ids[i], n, int(index.size[i]), n / int(index.size[i])) for d, h in zip(b.column(0).to_pylist(), hashes, strict=True) for i, n in index.match(h)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 4 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

    return docs.mapInArrow(run, PAIRS)


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (any columns, among them text) without the documents that contain an item."""
    session(docs.sparkSession)
    at, files = docs.columns.index("text"), blocks(items, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, texts in hashed(batches, at, len(files) > 1):
            keep = [np.ones(b.num_rows, bool) for b in own]
            for file in files:
                index = index_of(file)
                for left, hashes in zip(keep, texts, strict=True):
                    for i in np.flatnonzero(left).tolist():
                        left[i] = not index.match(hashes[i])
            for b, left in zip(own, keep, strict=True):
                yield b.filter(pa.array(left))

    return docs.mapInArrow(run, docs.schema)


def sql(documents: str = "documents", benchmark: str = "benchmark", threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL, by exact counting."""
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
    grams = "[array_to_string(ws[i : i + k - 1], ' ') for i in range(1, len(ws) - k + 2)]"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS n, {words} AS ws FROM {documents}),
i AS (SELECT item_id, row_number() OVER () AS m, {words} AS ws FROM {benchmark}), sized AS (SELECT *, least(len(ws), {WIDTH}) AS k FROM i WHERE len(ws) > 0),
s AS (SELECT DISTINCT m, item_id, k, unnest({grams}) AS g FROM sized), total AS (SELECT m, count(*) AS n_item FROM s GROUP BY m),
dk AS (SELECT d.*, k FROM d, (SELECT DISTINCT k FROM sized) WHERE len(ws) >= k), dg AS (SELECT DISTINCT n, doc_id, k, unnest({grams}) AS g FROM dk)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment FROM dg JOIN s USING (k, g) JOIN total USING (m) GROUP BY n, doc_id, m, item_id, n_item HAVING count(*) >= ceil({threshold} * n_item - 1e-9)"""
