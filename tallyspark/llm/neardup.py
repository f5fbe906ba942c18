"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

A document is the weighted set of its five-word shingles: weight = count x idf, idf = 1 + ln(N / df), with N and df
counted over all documents. Rows are stored once, in blocks of BLOCK_ROWS. Each block deals its distinct shingles, sorted
and gap-coded, to shards by hash range; a shard counts documents and returns to each block those of its shingles that
occur in two documents or more, which become one file a block. So a shingle of a third of all documents is one count a
block, and no list of shingles passes through the driver. Shingles are told apart by KEY_BITS bits.

A document can have a partner at the threshold only if at least that share of its weight lies on shingles that others
have too; all others are classes of their own and go no further, which loses nothing. The rest get HASHES samples, each
the shingle with the least ln(a) of consistent weighted sampling with draws taken from its hash; BANDS bands of ROWS
samples give bucket keys (a pair at 0.8 is in no common bucket with probability 2e-4, at 0.85 with 9e-6). Texts with
equal words collapse to one representative before anything is paired.

Links without all pairs: in each bucket the member with the most bucket neighbours is the leader, and every member
that is not yet of its class is compared with it. LEADERS such rounds, with classes joined in between, leave only
members whose class differs from their bucket's; these are a query set, compared with all members of their bucket in
blocks of BLOCK by BLOCK, each pair in the first bucket that it shares. Every pair of a bucket is verified by weighted
Jaccard similarity over whole texts unless its two documents are of one class already or their total weights alone
exclude the threshold. Classes are the connected components of the links, by label propagation with pointer jumping over
stored tables.

Defined cases: null and empty texts have no shingle and are classes of their own; texts of one to four words are one
shingle; a class belongs to a text, so rows with equal ids are classed by their own texts; the class id is the smallest
doc_id of the class, null where none of its rows has one. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MIX, filesystem, joined, joined_wide, mix, new_dir, removed, session, shingles_of, small, sorted_in, stored, word_hashes, write_file

WIDTH, THRESHOLD = 5, 0.8
KEY_BITS = 56
BANDS, ROWS = 16, 4
HASHES = BANDS * ROWS
LEADERS = 2
#: Rows of a block (a power of two), shingles that a task holds before it deals them, bytes of text for each shard.
BLOCK_ROWS, HELD, SHARD_BYTES = 1 << 12, 4_000_000, 32 << 20
#: Members of a block of a bucket; a task holds the keys, then the shingles, of two blocks at a time.
BLOCK, SPREAD = 64, 16


# --- document frequencies


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def shingle_sets(column: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Of each text, a 128-bit hash of all its words (empty: no word), its distinct shingles and their counts."""
    h, first = word_hashes(column)
    s, at = shingles_of(h, first, WIDTH)
    s >>= np.uint64(64 - KEY_BITS)
    for i in range(len(column)):
        content = xxhash.xxh3_128_digest(h[first[i] : first[i + 1]].tobytes()) if first[i] < first[i + 1] else b""
        yield content, *distinct(s[at[i] : at[i + 1]])


def gaps(keys: np.ndarray) -> bytes:
    """Sorted distinct keys, one at least: the width of a gap in bytes, the first key, then the gaps."""
    gap = np.diff(keys)
    width = max(1, (int(gap.max()).bit_length() + 7) // 8) if len(gap) else 1
    return bytes([width]) + keys[:1].tobytes() + np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def ungapped(data: bytes) -> np.ndarray:
    width, raw = data[0], np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    out = np.zeros((len(raw) + 1, 8), np.uint8)
    out[0] = np.frombuffer(data, np.uint8, 8, 1)
    out[1:, :width] = raw
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key: ranges of equal width, in order."""
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(shards)) >> np.uint64(32)


def dealt(shards: int):
    """mapInArrow: block, text -> block, shard, keys, and their counts in the block where any is over 1."""

    def rows(block: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n = distinct(np.concatenate(held))
        edge = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
        full = np.flatnonzero(np.diff(edge))
        parts = [(keys[edge[i] : edge[i + 1]], n[edge[i] : edge[i + 1]]) for i in full]
        counts = [c.astype(np.uint32).tobytes() if (c > 1).any() else b"" for _, c in parts]
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array([gaps(k) for k, _ in parts], pa.binary()), pa.array(counts, pa.binary())], ["block", "shard", "keys", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = None, [], 0
        for b in batches:
            for own, (_, s, _) in zip(b.column(0).to_pylist(), shingle_sets(b.column(1)), strict=True):
                if held and (own != block or size > HELD):
                    yield from rows(block, held)
                    held, size = [], 0
                block = own
                if len(s):
                    held.append(s)
                    size += len(s)
        if held:
            yield from rows(block, held)

    return run


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one shard after another -> block, the keys of it that two documents or more have, their counts."""

    def replies(own: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate([k for _, k, _ in own])
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        df = np.add.reduceat(np.concatenate([n for _, _, n in own])[order], first)
        of = np.empty(len(flat), np.int64)
        of[order] = np.repeat(df, np.diff(np.append(first, len(flat))))
        at = 0
        for block, keys, _ in own:
            mine = of[at : at + len(keys)]
            at += len(keys)
            if (mine > 1).any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([gaps(keys[mine > 1])], pa.binary()), pa.array([mine[mine > 1].tobytes()], pa.binary())], ["block", "keys", "df"])

    shard, own = None, []
    for b in batches:
        for block, s, keys, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if own and s != shard:
                yield from replies(own)
                own = []
            shard, keys = s, ungapped(keys)
            own.append((block, keys, np.frombuffer(n, np.uint32).astype(np.int64) if n else np.ones(len(keys), np.int64)))
    if own:
        yield from replies(own)


def written(folder: str):
    """mapInArrow: block, keys, df, sorted by block -> a file a block, with its shared shingles in order and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = filesystem(folder)

        def done(block: int, keys: list[np.ndarray], df: list[np.ndarray]) -> None:
            flat, n = np.concatenate(keys), np.concatenate(df)
            order = np.argsort(flat)
            flat, n = flat[order], n[order]
            keep = np.concatenate([[True], flat[1:] != flat[:-1]])  # a block that was dealt in parts may have a key twice
            part = f"{folder}/{uuid.uuid4().hex}.part"
            write_file(part, gaps(flat[keep]) + n[keep].tobytes())
            fs.move(part.replace(folder, place), f"{place}/{block}.df")  # a retried task puts the same in its place

        block, keys, df = None, [], []
        for b in batches:
            for own, k, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if keys and own != block:
                    done(block, keys, df)
                    keys, df = [], []
                block = own
                keys.append(ungapped(k))
                df.append(np.frombuffer(n, np.int64))
        if keys:
            done(block, keys, df)
        yield pa.RecordBatch.from_arrays([pa.array([1])], ["done"])

    return run


class Frequencies:
    """The document frequencies of a block's shingles, from its file."""

    def __init__(self, folder: str):
        (self.fs, self.place), self.block = filesystem(folder), None

    def of(self, block: int, s: np.ndarray) -> np.ndarray:
        if block != self.block:
            self.block, path = block, f"{self.place}/{block}.df"
            self.keys = self.df = np.zeros(0, np.uint64)
            if self.fs.get_file_info(path).type == pafs.FileType.File:
                with self.fs.open_input_file(path) as f:
                    data = f.read()
                n = (len(data) - 9 + data[0]) // (8 + data[0])
                self.keys, self.df = ungapped(data[: 9 + (n - 1) * data[0]]), np.frombuffer(data[-8 * n :], np.int64)
        if not len(self.keys):
            return np.ones(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        return np.where(self.keys[at] == s, self.df[at], 1)


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return 1 + np.log(n / df)


def frequencies(rows: DataFrame) -> str:
    """rows: block, text, stored. Counts documents for every shingle; returns the folder of the blocks' files."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, folder = max(parts, size // SHARD_BYTES + 1), new_dir(spark, "frequencies")
    keys = rows.select("block", "text").mapInArrow(dealt(shards), "block long, shard int, keys binary, n binary")
    found = keys.repartitionById(shards, "shard").mapInArrow(counted, "block long, keys binary, df binary")
    stored(found.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(written(folder), "done long"), "frequencies-done")
    return folder


# --- samples


def uniform(x: np.ndarray) -> np.ndarray:
    """32 bits as a number in (0, 1]."""
    return (x.astype(np.float32) + np.float32(1)) * np.float32(2.0**-32)


SEEDS = np.random.default_rng(20).integers(1, 1 << 63, (2, HASHES), dtype=np.uint64) | np.uint64(1)
LOW = np.uint64(0xFFFFFFFF)


def samples(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """HASHES consistent weighted samples (shingle, level), each as 64 bits. r and c are Gamma(2, 1) and beta uniform, all
    drawn from the hash of shingle and sample."""
    log_w, out = np.log(w).astype(np.float32), np.empty(HASHES, np.uint64)
    low, rows, half = np.full(HASHES, np.inf, np.float32), np.arange(HASHES), np.uint64(32)
    for i in range(0, len(s), 512):
        x, y = (mix(s[None, i : i + 512] * seed[:, None]) for seed in SEEDS)
        r = -np.log(uniform(x >> half) * uniform(x & LOW))
        c = -np.log(uniform(y >> half) * uniform(y & LOW))
        beta = uniform(((x ^ (y << np.uint64(7))) * MIX) >> half)
        level = np.floor(log_w[None, i : i + 512] / r + beta)
        a = np.log(c) - r * (level - beta) - r
        k = a.argmin(1)
        best = a[rows, k]
        better = best < low
        out = np.where(better, mix(x[rows, k] + level[rows, k].astype(np.int64).view(np.uint64) * MIX), out)
        low = np.where(better, best, low)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    x = sample.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for i in range(ROWS):
        key = (key ^ x[:, i]) * MIX
        key ^= key >> np.uint64(29)
    return mix(key)


SKETCH = "row long, content binary, total double, keys array<long>, s binary, w binary"


def sketched(folder: str, n: int, threshold: float):
    """mapInArrow: row, block, text -> SKETCH for each document that may have a partner; s and w (float64) are its shingles
    that other documents have too, and their weights; total is the weight of all its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known = Frequencies(folder), {}
        for b in batches:
            out = []
            for row, block, (content, s, m) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingle_sets(b.column(2)), strict=True):
                df = found.of(block, s)
                w = m * idf(df, n)
                total, common = float(w.sum()), df > 1
                if not len(s) or w[common].sum() < (threshold - 1e-9) * total:
                    continue
                if content not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[content] = band_keys(samples(s, w)).view(np.int64)
                out.append((row, content, total, known[content], s[common].tobytes(), w[common].tobytes()))
            if out:
                kinds = (pa.int64(), pa.binary(), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["row", "content", "total", "keys", "s", "w"])

    return run


# --- links


def similarity(a: tuple[np.ndarray, np.ndarray, float], b: tuple[np.ndarray, np.ndarray, float]) -> float:
    """Weighted Jaccard of (shared shingles, weights, total weight): sum of minima over sum of maxima."""
    if not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    least = np.minimum(a[1][hit], b[1][at[hit]]).sum()
    whole = a[2] + b[2] - least
    return float(least / whole) if whole > 0 else 0.0


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b), stored, with a weighted Jaccard similarity of at least the threshold. sets: row, total, s, w."""
    one = joined_wide(pairs, sets.select(F.col("row").alias("b"), F.struct("s", "w", "total").alias("sb")), "b", ("a", "b"))
    both = joined_wide(one, sets.select(F.col("row").alias("a"), F.struct("s", "w", "total").alias("sa")), "a", ("a", "b"), pairs)

    def read(x: dict) -> tuple[np.ndarray, np.ndarray, float]:
        return np.frombuffer(x["s"], np.uint64), np.frombuffer(x["w"]), x["total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [similarity(read(x), read(y)) >= threshold - 1e-9 for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return stored(both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """links (a, b): doc_id and label, the smallest doc_id that links lead to, for each end of a link; stored."""
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    # the first round needs no join: every node hears its neighbours' ids
    labels = stored(edges.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        heard = joined(edges.withColumnRenamed("b", "doc_id"), labels, "doc_id").groupBy(F.col("a").alias("doc_id")).agg(F.min("label").alias("heard"))
        new = stored(labels.join(sorted_in(heard), "doc_id").select("doc_id", F.col("label").alias("old"), F.least("label", "heard").alias("label")), "labels")
        jump = new.select(F.col("doc_id").alias("label"), F.col("label").alias("further"))
        new = stored(joined(new, jump, "label").select("doc_id", "old", F.least("label", "further").alias("label")), "labels")
        labels = new.select("doc_id", "label")
        if not new.filter("label != old").limit(1).count():
            return labels


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows with row, and the label of its class so far."""
    if labels is None:
        return rows.withColumn("label", F.col("row"))
    return joined(rows, labels, "row", "left").withColumn("label", F.coalesce("label", "row"))


def linked(own: DataFrame, threshold: float) -> DataFrame | None:
    """own: row, total, keys, s, w of each distinct text, stored. Returns row and label of all that have a link."""
    buckets = own.select(F.explode("keys").alias("bucket"), "row", "total")
    sizes = stored(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bucket-sizes")
    full = stored(joined(buckets, sizes, "bucket"), "full-buckets")
    degree = stored(full.groupBy("row").agg(F.sum("n").alias("degree")), "degrees")
    pool = stored(joined(full, degree, "row"), "pool")
    links, labels = None, None
    for k in range(LEADERS + 1):
        now = stored(labelled(pool, labels), "now")
        first = F.max(F.struct("degree", (-F.col("row")).alias("least"), "total", "label")).alias("x")
        leaders = now.groupBy("bucket").agg(first, F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 != l1")
        leaders = stored(leaders.select("bucket", (-F.col("x.least")).alias("leader"), F.col("x.total").alias("t"), F.col("x.label").alias("of")), "leaders")
        now = joined(now, leaders, "bucket")
        if k == LEADERS:
            found = across(stored(now.select("bucket", "row", "n", "label", "of"), "rest"), own, threshold)
        else:
            pairs = now.filter("label != of")
            near = F.least("total", "t") >= F.greatest("total", "t") * (threshold - 1e-9)
            pairs = pairs.filter(near).select(F.col("leader").alias("a"), F.col("row").alias("b"))
            pool = stored(now.filter("row != leader").select("bucket", "row", "total", "n", "degree"), "pool")
            found = verified(stored(pairs.distinct(), "pairs"), own, threshold)
        if found.limit(1).count():
            links = found if links is None else stored(links.unionByName(found), "links")
            labels = components(links).withColumnRenamed("doc_id", "row")
    return labels


def blocked(rows: DataFrame, name: str) -> DataFrame:
    """bucket, block, keep and members: lists of (row, label, total, keys)."""
    return rows.groupBy("bucket", "blocks", "block").agg(F.collect_list(F.struct("row", "label", "total", "keys")).alias(name))


def fields(column: pa.ListArray, i: int) -> tuple[np.ndarray, ...]:
    """row, label, total and band keys of one list of members."""
    x = column[i].values
    keys = x.field("keys").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
    return (*(x.field(c).to_numpy(zero_copy_only=False) for c in ("row", "label", "total")), keys)


def met(threshold: float):
    """mapInArrow: bucket and two blocks of it -> one row with the pairs between them that are to be verified: of two
    classes, in no earlier bucket together, and with totals that allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, bucket in enumerate(b.column(0).to_pylist()):
                (a, la, ta, ka), (c, lc, tc, kc) = fields(b.column(1), i), fields(b.column(2), i)
                ok = (la[:, None] != lc[None]) & (np.minimum(ta[:, None], tc[None]) >= np.maximum(ta[:, None], tc[None]) * (threshold - 1e-9))
                band = int(np.flatnonzero(ka[0] == bucket)[0])
                for k in range(band):
                    ok &= ka[:, None, k] != kc[None, :, k]
                # where both are of the query set the pair turns up twice
                ok &= ~np.isin(c, a)[None] | (a[:, None] < c[None])
                x, y = np.nonzero(ok)
                if len(x):
                    out.append((a[x], c[y]))
            if out:
                key = [uuid.uuid4().int >> 65 for _ in out]
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([x for x, _ in out], kind), pa.array([y for _, y in out], kind)], ["part", "a", "b"])

    return run


def shared_weights(s: list[np.ndarray], w: list[np.ndarray], step: int = 2_048) -> np.ndarray:
    """(n, n) sums of minima of the documents' weights. Only shingles of two or more documents matter; they are taken in
    steps, and each weight as often as it has distinct levels, so that minima become products."""
    n, out = len(s), np.zeros((len(s), len(s)))
    flat, of, weight = np.concatenate(s), np.repeat(np.arange(n), [len(x) for x in s]), np.concatenate(w)
    column, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[at] > 1
    of, at, weight = of[keep], at[keep], weight[keep]
    if not len(at):
        return out
    _, at = np.unique(at, return_inverse=True)
    for first in range(0, at.max() + 1, step):
        here = (at >= first) & (at < first + step)
        x = np.zeros((n, min(step, at.max() + 1 - first)))
        x[of[here], at[here] - first] = weight[here]
        low = np.zeros(x.shape[1])
        while (x > low).any():
            level = np.where(x > low, x, np.inf).min(0)
            rise = np.where(np.isfinite(level), level - low, 0)
            has = (x > low).astype(float)
            out += (has * rise) @ has.T
            low = np.where(np.isfinite(level), level, np.inf)
    return out


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of pairs, as many as join the same documents."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = top(x), top(y)
        if i != j:
            root[max(i, j)] = min(i, j)
            out.append((x, y))
    return out


def similar(threshold: float):
    """mapInArrow: part, a, b (pairs) and docs (row, total, s, w) -> of the pairs that are similar, as many as join the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, c = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (1, 2))
                x = batch.column(3)[i].values
                ids, total = (x.field(k).to_numpy(zero_copy_only=False) for k in ("row", "total"))
                s, w = ([np.frombuffer(v, t) for v in x.field(k).to_pylist()] for k, t in (("s", np.uint64), ("w", np.float64)))
                order = np.argsort(ids)
                j, k = (order[np.searchsorted(ids, v, sorter=order)] for v in (a, c))
                least = shared_weights(s, w)[j, k]
                ok = least >= (threshold - 1e-9) * (total[j] + total[k] - least)
                if found := forest(a[ok], c[ok]):
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], ["a", "b"])

    return run


def across(rest: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """rest: bucket, row, n, label and of (the bucket's main class), stored. Links between members of different classes:
    whoever is not of the main class, against all of its bucket, block by block. A large bucket's blocks of the query set
    are spread over SPREAD keys, to each of which all its blocks go."""
    blocks = F.ceil(F.col("n") / BLOCK)
    rest = rest.join(sorted_in(own.select("row", "total", "keys")), "row").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("row"), blocks))
    rest = stored(rest, "rest-blocks")
    spread = F.least("blocks", F.lit(SPREAD))
    left = blocked(rest.filter("label != of"), "l").withColumn("part", F.pmod("block", spread)).select("bucket", "part", "l")
    right = blocked(rest, "r").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), spread - 1))).select("bucket", "part", "r")
    pairs = stored(left.join(sorted_in(right), ["bucket", "part"]).select("bucket", "l", "r").mapInArrow(met(threshold), "part long, a array<long>, b array<long>"), "met")
    named = stored(pairs.select("part", F.explode(F.array_distinct(F.concat("a", "b"))).alias("row")), "met-rows")
    sets = joined_wide(named, own.select("row", "total", "s", "w"), "row", ("part", "row")).groupBy("part").agg(F.collect_list(F.struct("row", "total", "s", "w")).alias("docs"))
    found = pairs.join(sorted_in(sets), "part").select("part", "a", "b", "docs").mapInArrow(similar(threshold), "a long, b long")
    return stored(found.distinct(), "links")


# --- classes


def classed(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: row, block, text, stored. Returns row and label (a row) of every row whose class may have others, stored."""
    folder, n = frequencies(rows), rows.count()
    found = stored(rows.select("row", "block", "text").mapInArrow(sketched(folder, n, threshold), SKETCH), "sketches")
    removed(rows.sparkSession, folder)
    # documents of equal words are one representative from here on
    reps = stored(found.groupBy("content").agg(F.min("row").alias("rep")), "reps")
    member = stored(joined(found.select("row", "content"), reps, "content").select("row", "rep"), "members")
    first = stored(member.filter("row = rep").select("row"), "first-rows")
    labels = linked(stored(joined(found.drop("content"), first, "row"), "representatives"), threshold)
    if labels is None:
        return member.withColumnRenamed("rep", "label")
    return stored(joined(member, labels.withColumnRenamed("row", "rep"), "rep", "left").select("row", F.coalesce("label", "rep").alias("label")), "classes")


def numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """These columns of docs, a number for each row, and its block; stored."""
    rows = docs.select(*columns, F.monotonically_increasing_id().alias("row"))
    return stored(rows.withColumn("block", F.shiftright("row", BLOCK_ROWS.bit_length() - 1)), "rows", "zstd")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs: doc_id, text. Returns doc_id and class_id for every row."""
    session(docs.sparkSession)
    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    label = classed(rows, threshold)
    ids = rows.select("row", "doc_id")
    both = stored(joined(ids, label, "row"), "labelled")
    least = stored(both.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.lit(True).alias("known")), "class-ids")
    named = stored(joined(both, least, "label").select("row", "class_id", "known"), "class-rows")
    out = joined(ids, named, "row", "left")
    return out.select("doc_id", F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (any columns, among them doc_id and text), of each class the row with the smallest id, null ids last.
    Rows without a word stay: they are like nothing."""
    session(docs.sparkSession)
    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    label = classed(rows.select("row", "block", F.col("doc.text").cast("string").alias("text")), threshold)
    both = stored(joined(rows.select("row", "doc_id"), label, "row"), "labelled")
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x")
    kept = stored(both.groupBy("label").agg(keeper).select("label", F.col("x.row").alias("keeper")), "keepers")
    gone = stored(joined(both, kept, "label").filter("row != keeper").select("row"), "gone")
    gone = F.broadcast(gone) if small(gone) else sorted_in(gone)
    return rows.select("row", "doc").join(gone, "row", "left_anti").select("doc.*")
