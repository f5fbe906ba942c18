"""Helpers that the training-data operators share: the cluster's shared folder, bounded Arrow batches, hashing."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch at most (a longer text is a batch of its own). Whole texts travel in these batches.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: White space of the data contracts; str.strip and re classes differ outside ASCII.
SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = frozenset(SPACE.encode())


def session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by rows and bytes; every Python operator of this package calls this first."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or that of setCheckpointDir, which executors and the driver share. Where neither
    is set a temporary folder serves in local mode, and anything else is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or os.environ.get("TALLYSPARK_TEST_DIR")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        os.environ["TALLYSPARK_TEST_DIR"] = found = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
    return (found if "://" in found or found.startswith("file:") else "file://" + os.path.abspath(found)).rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared one."""
    return f"{shared_dir(spark)}/tallyspark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet below the shared folder and read it again: lost executors recompute nothing before it."""
    spark = df.sparkSession
    path, key = new_dir(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")  # what this write shuffles is of no use after it
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of new_dir() that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write one whole file; a name is used by one task attempt only, so a torn file is never referred to."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


class WordHashes(dict):
    """word (bytes) -> signed 64-bit hash, kept for the words met so far; emptied when it holds `most` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of what is not white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the runs of `width` words; a shorter non-empty text is one shingle."""
    h = h.view(np.uint64)
    n = len(h)
    if n == 0:
        return h
    k = min(width, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : n - k + 1 + i]) * MIX
        out ^= out >> np.uint64(29)
    return mix(out)


PIECE_BYTES = 1 << 17
#: Capital letters count as small ones.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What is kept of 8 bytes when a word ends after so many of them.
KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def hashed_words(part: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the words at start to stop (inclusive) of UTF-8 bytes: each word's length, then 8 bytes after another, are
    mixed into a running value; long words take xxhash's. No sum of bytes by place, for which unlike words could be equal."""
    low = LOWER.take(part)
    wide = np.ndarray(len(low) + 1, "<u8", np.append(low, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    size = stop - start + 1
    h = size.astype(np.uint64) * MIX
    left = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(left):
        h[left] = mix(h[left] ^ (wide[start[left] + at] & KEPT[np.minimum(size[left] - at, 8)])) + MIX
        at += 8
        left = left[size[left] > at]
    if len(long := np.flatnonzero(size > LONG_WORD)):
        raw = low.tobytes()
        h[long] = [xxhash.xxh3_64_intdigest(raw[i : j + 1]) for i, j in zip(start[long].tolist(), stop[long].tolist(), strict=True)]
    return h


def is_space(data: np.ndarray) -> np.ndarray:
    """Where bytes are white space; uint8 arithmetic wraps, so that 9 to 13 become 0 to 4."""
    return (data - np.uint8(9) <= 4) | (data == 32)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts of a string column, and the n + 1 places where texts begin; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else np.zeros(0, np.uint8)
    return (data[at[0] : at[-1]], at - at[0]) if len(at) else (data, np.zeros(1, np.int64))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (uint64) of the words of all texts, in order, and the n + 1 places where each text's words begin. Words are
    those of words_of(), hashed by hashed_words() a piece of the column at a time."""
    data, bounds = text_bytes(column)
    out, total, counts = [], 0, np.zeros(len(bounds), np.int64)
    i = 0
    while i < len(data):
        end = min(len(data), i + PIECE_BYTES)
        while end < len(data) and data[end] not in SPACE_BYTES:  # to the next space, or the next text
            step = data[end : end + 4096]
            stop = np.flatnonzero(is_space(step))
            end += int(stop[0]) if len(stop) else len(step)
            cut = np.searchsorted(bounds, end, "right") - 1
            if bounds[cut] > i and bounds[cut] >= end - len(step):
                end = int(bounds[cut])
                break
        part = data[i:end]
        inside = ~is_space(part)
        edge = np.searchsorted(bounds, [i, end])
        first = bounds[edge[0] : edge[1]] - i
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[first] = inside[first]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        last = first[first > 0] - 1
        closes[last] = inside[last]
        start, stop = np.flatnonzero(opens), np.flatnonzero(closes)
        out.append(hashed_words(part, start, stop))
        counts[edge[0] : edge[1]] = total + np.searchsorted(start, first)
        total += len(start)
        i = end
    counts[np.searchsorted(bounds, len(data)) :] = total
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def shingles_of(h: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of many texts at once (word hashes and places, as word_hashes() gives them), and where each
    text's begin; a non-empty text of fewer words is one shingle. Equal to shingle_hashes() text by text."""
    n = np.diff(first)
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    # the word at which each shingle begins
    begin = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], many)
    out = np.empty(len(begin), np.uint64)
    for i in range(0, len(begin), 1 << 15):
        own = begin[i : i + (1 << 15)]
        x = np.full(len(own), width, np.uint64)
        for k in range(width):
            x = (x ^ h[np.minimum(own + k, len(h) - 1)]) * MIX
            x ^= x >> np.uint64(29)
        out[i : i + len(own)] = mix(x)
    for k in np.flatnonzero((n > 0) & (n < width)):
        x = np.full(1, n[k], np.uint64)
        for w in h[first[k] : first[k + 1]]:
            x = (x ^ w) * MIX
            x ^= x >> np.uint64(29)
        out[at[k]] = mix(x)[0]
    return out, at


#: A side with at most so many rows and bytes may be broadcast; a larger one is joined by shuffle with salt.
BROADCAST_ROWS, BROADCAST_BYTES, SALTS = 1_000_000, 32 << 20, 16
#: Bytes that a broadcast row takes beside its values: its place in the driver's hash table, which doubles, and its header.
ROW_BYTES = 64


def bytes_of(df: DataFrame) -> int:
    """Bytes of a stored table's files, times 4 for what they take once decoded."""
    plan = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return 4 * int(str(plan))


def small(few: DataFrame) -> bool:
    """If few, a stored table, may be broadcast. The driver collects and hashes it: sorted numbers that are next to nothing in
    their files take ROW_BYTES and more there, so rows count as well as the files' bytes."""
    size = bytes_of(few)
    if size > BROADCAST_BYTES:
        return False
    rows = few.count()
    return rows <= BROADCAST_ROWS and size + ROW_BYTES * rows <= BROADCAST_BYTES


def sorted_in(few: DataFrame) -> DataFrame:
    """A side of a join that small() ruled out, or that grows with the input: both sides are shuffled and sorted. Left to itself
    Spark goes by the bytes of its files (10 MB, unless set), which for numbers hold a million rows, and of a side that is
    repeated for each salt sees those of one copy; the driver would have to hold all of them."""
    return few.hint("merge")


def joined(many: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """many JOIN few (a stored table with unique keys) where any key may hold a third of many: a broadcast if few is
    small by rows and bytes, else few is repeated for each salt and the rows of a key in many are spread over them."""
    if small(few):
        return many.join(F.broadcast(few), key, how)
    salts = F.explode(F.array(*(F.lit(i) for i in range(SALTS))))
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in many.columns)), F.lit(SALTS)).cast("int"))
    return dealt.join(sorted_in(few.withColumn("_salt", salts)), [key, "_salt"], how).drop("_salt")


def joined_wide(many: DataFrame, few: DataFrame, key: str, salted: tuple[str, ...], weights: DataFrame | None = None) -> DataFrame:
    """Like joined(), for a few whose rows are too wide to repeat: only keys with over a thousandth of the rows of
    weights (a stored table with the same keys as many; many itself if none is given) get salt, from the columns salted.
    There are under 1000."""
    if small(few):
        return many.join(F.broadcast(few), key)
    weights = many if weights is None else weights
    n = weights.count()
    heavy = F.broadcast(weights.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max(1000, n // 1000)).select(key, F.lit(True).alias("_heavy")))
    spread = F.when(F.col("_heavy"), F.array(*(F.lit(i) for i in range(SALTS)))).otherwise(F.array(F.lit(0)))
    dealt = many.join(heavy, key, "left").withColumn("_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64(*salted), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_heavy")
    return dealt.join(sorted_in(few.join(heavy, key, "left").withColumn("_salt", F.explode(spread)).drop("_heavy")), [key, "_salt"]).drop("_salt")
