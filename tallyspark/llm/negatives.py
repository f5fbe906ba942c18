"""Hard negatives of anchors by rotated one-bit codes: exact results, most of the work on codes.

Vectors are whole numbers, floor(256 * x). Each gets a code: it is rotated (random signs and Hadamard transforms, twice, from
a fixed seed), scaled to length 1 and cut to signs; stored are the signs as bits, the vector's norm and its alignment, the
inner product of the scaled vector with its own signs. An anchor is rotated too and cut to QUERY_BITS bits a component, so
that its inner product with signs is a sum of popcounts, off by no more than the norm e of what the cut left. With
x = |x| (a b + r), b the unit vector of signs, a the alignment and r orthogonal to b, and t = <b, q>:
    <x, q> = |x| (a t + <r, q>),   |<r, q>| <= sqrt(1 - a**2) sqrt(|q|**2 - t**2)   (Cauchy-Schwarz, q less its part along b)
which is an interval that surely holds the score. What it can't exclude is scored in whole numbers: products of float64 that
stay below 2**53 are exact in any order, others are added as Python's integers. Intervals never decide a result.

Two searches, each map-only over the stored codes. A task holds CHUNK_BYTES of vectors at most and meets the anchors, which
lie in the shared folder, ANCHOR_ROWS at a time; it keeps the best few of each anchor in its chunk, whose least score is the
bar that later intervals must reach. What each chunk keeps is ranked by windows over (anchor) and (anchor, positive).
1. Positives: of each anchor the POSITIVES best other rows of its label.
2. Negatives: of each anchor and positive the NEGATIVES best rows of other labels whose score is from 30 to 90 hundredths of
   the positive's. A chunk's row is sent once an anchor, whichever of its positives it serves.
Anchors are a stated query set (every hundredth id), read by each chunk in blocks; no pair of rows is ever a row of Spark's
but the few best. Anchors are neither collected nor broadcast.

Defined cases: rows with a null label or vector or with a null, infinite or undefined component take no part; a null id is
no anchor, and last among equal scores; of rows with one id the order of equal scores is that of rows as stored, and each
is an anchor of its own; vectors of unlike lengths are filled up with zeros; equal scores go by id; anchors without
positives, and positives without negatives, give no rows; an empty table gives none. Scores of 2**56 and more, either
sign, are an error. Other columns, whatever they are called, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, session, stored

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
SCALE, QUERY_BITS, SEED = 256.0, 6, 0xC0DE
CHUNK_BYTES, TILE_ROWS, ANCHOR_ROWS = 96 << 20, 8_192, 256
#: Float64 sums are exact below this; relative slack of intervals for rounding.
EXACT, SLACK, MOST_SCORE = 2.0**53, 1e-9, 1 << 56
NO_ID = np.iinfo(np.int64).max
CODED = "row long, vec_id long, label long, vector binary, code binary, norm double, alignment double"


# --- codes -------------------------------------------------------------------------------------------------------


def width_of(dims: int) -> int:
    """Components after rotation: a power of two, 64 at least."""
    return max(64, 1 << max(0, dims - 1).bit_length())


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows rotated: signs, a Hadamard transform, and both once more. The width is a power of two."""
    width = x.shape[1]
    signs = np.random.default_rng(SEED).integers(0, 2, (2, width)) * 2.0 - 1
    for s in signs:
        x = x * s
        step = 1
        while step < width:
            y = x.reshape(len(x), -1, 2, step)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), width)
            step *= 2
        x = x / np.sqrt(width)
    return x


def bits_of(on: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of uint64 words."""
    return np.packbits(on, axis=1, bitorder="little").view("<u8")


def encoded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, norms and alignments of whole-number vectors (filled up to the rotation's width)."""
    norm = np.sqrt((x * x).sum(1))
    o = rotated(x) / np.where(norm > 0, norm, 1)[:, None]
    return bits_of(o >= 0), norm, np.abs(o).sum(1) / np.sqrt(x.shape[1])


def filled(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def coder(width: int):
    """mapInArrow: row, vec_id, label, embedding -> CODED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            values, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            whole = np.floor(values * SCALE)
            own = [whole[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            keep = np.array([bool(np.isfinite(v).all()) for v in own], bool)
            if not keep.any():
                continue
            rows = b.filter(pa.array(keep))
            own = [v for v, k in zip(own, keep, strict=True) if k]
            codes, norms, alignments = encoded(filled(own, width))
            cols = [*rows.columns[:3], pa.array([v.tobytes() for v in own], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(alignments)]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in CODED.split(", ")])

    return run


def coded(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """embeddings: vec_id, label, embedding -> the stored codes of rows that take part, and the rotation's width."""
    session(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    width = width_of(rows.agg(F.max(F.size("embedding"))).first()[0] or 0)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding")
    return stored(rows.mapInArrow(coder(width), CODED), "codes"), width


# --- search ------------------------------------------------------------------------------------------------------


class Rows:
    """Coded rows in memory."""

    def __init__(self, batches: list[pa.RecordBatch], width: int):
        t = pa.Table.from_batches(batches)
        self.row, self.label = (t.column(c).to_numpy() for c in ("row", "label"))
        self.vec_id = t.column("vec_id").fill_null(NO_ID).to_numpy()
        self.vector = filled([np.frombuffer(v, np.float64) for v in t.column("vector").to_pylist()], width)
        self.code = np.frombuffer(b"".join(t.column("code").to_pylist()), "<u8").reshape(len(t), -1)
        self.norm, self.alignment = t.column("norm").to_numpy(), t.column("alignment").to_numpy()
        self.ones = np.bitwise_count(self.code).sum(1).astype(np.float64)

    def __len__(self) -> int:
        return len(self.row)


class Anchors(Rows):
    """Coded rows as queries: rotated, cut to whole numbers of QUERY_BITS bits, as bit planes."""

    def __init__(self, batches: list[pa.RecordBatch], width: int):
        super().__init__(batches, width)
        q = rotated(self.vector)
        self.low = q.min(1)
        self.unit = np.maximum((q.max(1) - self.low) / ((1 << QUERY_BITS) - 1), 1e-300)
        u = np.rint((q - self.low[:, None]) / self.unit[:, None])
        self.off = np.sqrt(((q - self.low[:, None] - u * self.unit[:, None]) ** 2).sum(1)) * (1 + SLACK) + SLACK
        self.sum = u.sum(1)
        self.planes = [bits_of((u.astype(np.int64) >> k) & 1 == 1) for k in range(QUERY_BITS)]
        self.width = width


def intervals(a: Anchors, r: Rows, at: slice) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible score of each anchor (rows) with each of r's rows at `at` (columns)."""
    code = r.code[at]
    dot = np.zeros((len(a), len(code)))
    for k, plane in enumerate(a.planes):
        count = np.bitwise_count(plane[:, None, 0] & code[None, :, 0]).astype(np.int32)
        for w in range(1, code.shape[1]):
            count += np.bitwise_count(plane[:, None, w] & code[None, :, w])
        dot += count * float(1 << k)
    t = (2 * (a.low[:, None] * r.ones[at] + a.unit[:, None] * dot) - (a.width * a.low + a.unit * a.sum)[:, None]) / np.sqrt(a.width)
    norm, align = r.norm[at], r.alignment[at]
    least = np.maximum(np.abs(t) - a.off[:, None], 0)
    across = np.sqrt(np.maximum((a.norm**2)[:, None] - least * least, 0))
    half = norm * (align * a.off[:, None] + np.sqrt(np.maximum(1 - align * align, 0)) * across) + SLACK * (1 + a.norm[:, None] * norm)
    mid = norm * align * t
    return mid - half, mid + half


def scores(a: Anchors, r: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whole-number inner products of anchors i with rows j."""
    if not len(i):
        return np.zeros(0, np.int64)
    safe = a.norm[i] * r.norm[j] * (1 + SLACK) < EXACT
    out = np.zeros(len(i), np.int64)
    rows, place = np.unique(j, return_inverse=True)
    if len(i) * 16 > len(a) * len(rows):  # many survive: one product of matrices
        whole = a.vector @ r.vector[rows].T
        out[safe] = whole[i[safe], place[safe]].astype(np.int64)
    else:
        for s in range(0, len(i), 1 << 16):
            own = np.flatnonzero(safe[s : s + (1 << 16)]) + s
            out[own] = (a.vector[i[own]] * r.vector[j[own]]).sum(1).astype(np.int64)
    for k in np.flatnonzero(~safe).tolist():
        n = sum(int(x) * int(y) for x, y in zip(a.vector[i[k]], r.vector[j[k]], strict=True))
        if abs(n) >= MOST_SCORE:
            raise OverflowError(f"a score of {n}")
        out[k] = n
    return out


class Best:
    """The best `most` rows of each group seen so far: place in the chunk and score; groups are numbers under n."""

    def __init__(self, n: int, most: int):
        self.n, self.most = n, most
        self.group, self.place, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.bar = np.full(n, np.iinfo(np.int64).min)

    def add(self, r: Rows, group: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.bar[group]
        if not keep.any():
            return
        g, p, s = (np.concatenate([x, y[keep]]) for x, y in ((self.group, group), (self.place, place), (self.score, score)))
        order = np.lexsort((r.row[p], r.vec_id[p], -s, g))
        g, p, s = g[order], p[order], s[order]
        rank = np.arange(len(g)) - np.searchsorted(g, g)
        top = rank < self.most
        self.group, self.place, self.score = g[top], p[top], s[top]
        last = rank == self.most - 1
        self.bar[g[last]] = s[last]


def positives_of(a: Anchors, r: Rows) -> Best:
    best = Best(len(a), POSITIVES)
    for at in range(0, len(r), TILE_ROWS):
        span = slice(at, min(len(r), at + TILE_ROWS))
        same = (a.label[:, None] == r.label[span]) & (a.row[:, None] != r.row[span])
        low, high = intervals(a, r, span)
        # the POSITIVES-th largest sure score of this tile is a bar as well
        if same.shape[1] >= POSITIVES:
            sure = np.partition(np.where(same, low, -np.inf), -POSITIVES, axis=1)[:, -POSITIVES]
            bar = np.maximum(sure, best.bar)
        else:
            bar = best.bar.astype(np.float64)
        i, j = np.nonzero(same & (high >= bar[:, None]))
        best.add(r, i, j + at, scores(a, r, i, j + at))
    return best


def negatives_of(a: Anchors, r: Rows, wanted: np.ndarray, known: np.ndarray) -> Best:
    """wanted: the positives' scores of each anchor; known: which of them there are. Groups are anchor * POSITIVES + k."""
    best = Best(len(a) * POSITIVES, NEGATIVES)
    floor, ceiling = np.where(known, wanted * (LOW / 100), np.inf), np.where(known, wanted * (HIGH / 100), -np.inf)
    for at in range(0, len(r), TILE_ROWS):
        span = slice(at, min(len(r), at + TILE_ROWS))
        low, high = intervals(a, r, span)
        may = np.zeros(low.shape, bool)
        bars = best.bar.reshape(len(a), POSITIVES)
        for k in range(POSITIVES):
            may |= (high >= np.maximum(floor[:, k], bars[:, k])[:, None]) & (low <= ceiling[:, k, None])
        i, j = np.nonzero(may & (a.label[:, None] != r.label[span]))
        s = scores(a, r, i, j + at)
        for k in range(POSITIVES):
            w = wanted[i, k]
            own = np.flatnonzero(known[i, k] & (LOW * w <= 100 * s) & (100 * s <= HIGH * w))
            best.add(r, i[own] * POSITIVES + k, j[own] + at, s[own])
    return best


FOUND = "anchor_row long, anchor_id long, row long, vec_id long, score long"


def searcher(anchors: str, width: int, wanted: bool):
    """mapInArrow over coded rows: of each anchor in the folder the best rows of each chunk (FOUND); with wanted, for the
    scores of its positives."""

    def searched(r: Rows) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(anchors)
        for b in pads.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=ANCHOR_ROWS):
            if not b.num_rows:
                continue
            a = Anchors([b], width)
            if wanted:
                lists = b.column("scores").to_pylist()
                known = np.array([[k < len(x) for k in range(POSITIVES)] for x in lists], bool)
                found = negatives_of(a, r, np.array([[*x, *[0] * (POSITIVES - len(x))] for x in lists], np.int64), known)
                i, p, s = found.group // POSITIVES, found.place, found.score
                _, once = np.unique(i * len(r) + p, return_index=True)  # a row may serve several positives
                i, p, s = i[once], p[once], s[once]
            else:
                found = positives_of(a, r)
                i, p, s = found.group, found.place, found.score
            ids = [pa.array(np.where(x == NO_ID, 0, x), mask=x == NO_ID) for x in (a.vec_id[i], r.vec_id[p])]
            yield pa.RecordBatch.from_arrays([pa.array(a.row[i]), ids[0], pa.array(r.row[p]), ids[1], pa.array(s)], [c.split()[0] for c in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n * width * 8 >= CHUNK_BYTES:
                yield from searched(Rows(held, width))
                held, n = [], 0
        if held:
            yield from searched(Rows(held, width))

    return run


def mined(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """embeddings: vec_id, label, embedding. For each anchor (vec_id divisible by `every`) and positive: anchor_id,
    positive_id, rank (int), negative_id, positive_score and negative_score."""
    codes, width = coded(embeddings)
    path = lambda df: df.inputFiles()[0].rpartition("/")[0]
    anchors = stored(codes.filter(F.col("vec_id") % every == 0), "anchors")
    if anchors.isEmpty():
        return anchors.select(F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.lit(0).alias("rank"), F.col("vec_id").alias("negative_id"), *(F.col("vec_id").alias(c) for c in ("positive_score", "negative_score")))
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"]
    near = codes.mapInArrow(searcher(path(anchors), width, False), FOUND)
    near = near.withColumn("_k", F.row_number().over(Window.partitionBy("anchor_row").orderBy(*order))).filter(F.col("_k") <= POSITIVES)
    near = stored(near.select("anchor_row", F.col("row").alias("positive_row"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = near.groupBy("anchor_row").agg(F.collect_list("positive_score").alias("scores"))  # POSITIVES at most
    asked = stored(anchors.join(wanted, anchors["row"] == wanted["anchor_row"]).drop("anchor_row"), "asked")
    found = stored(codes.mapInArrow(searcher(path(asked), width, True) if not asked.isEmpty() else nothing, FOUND), "candidates")
    score = F.col("score")
    fits = found.join(near, "anchor_row").filter((LOW * F.col("positive_score") <= 100 * score) & (100 * score <= HIGH * F.col("positive_score")))
    ranked = fits.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_row", "positive_row").orderBy(*order))).filter(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", score.alias("negative_score"))


def nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from ()


def relabelled(embeddings: DataFrame) -> DataFrame:
    """The contract's labels: (label + 1) mod 10 where vec_id is divisible by 7."""
    return embeddings.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")


def sql() -> str:
    dot = "CAST(list_inner_product({a}, {b}) AS BIGINT)"
    return f"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v,
  row_number() OVER () AS n FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.n AS an, a.vec_id AS anchor_id, b.n AS bn, b.vec_id AS vec_id, a.label = b.label AS same, {dot.format(a='a.v', b='b.v')} AS score FROM r a JOIN r b ON a.n != b.n WHERE a.vec_id % 100 = 0),
p AS (SELECT an, anchor_id, bn AS pn, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY an ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.an, pn ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.an = p.an AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY p.an, pn ORDER BY score DESC, vec_id) <= {NEGATIVES}"""
