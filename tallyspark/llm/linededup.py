"""Line dedup with two Bloom filters: once-seen and twice-seen hashes name the suspects, exact text confirms them.

1. Every document gives the distinct 64-bit hashes of its long line keys. These 8 bytes, once a task, are dealt by hash
   range to filter shards. A shard streams its hashes through a once-seen and a twice-seen Bloom filter of fixed size
   (twice |= once & new; once |= new), keeps no hash, and stores its twice-seen filter as a file in the shared folder.
2. The hashes pass their shard's filter again: those that it holds are suspects. None that repeats is missing; of the
   others a few pass.
3. Only suspected lines travel with their text: they are shuffled by their whole key, which counts documents and finds
   the largest document id exactly. Keys under the threshold and false suspects end here.
4. Each document drops the lines whose confirmed keys it isn't the keeper of, by their places.

A key of a third of all documents is one hash per input task in step 1 and a partial count in step 3; its join with
the documents that hold it is salted. Few suspects are found among a task's lines by broadcast; many are joined by hash
alone, with the document's row and the line's place, and the texts of the lines that are left follow by row. Defined
cases: null text is one empty line; lines repeated inside a document count once; rows with equal ids count as one
document (their places are told apart by a 64-bit hash of the text); a null id is a document that is never the largest. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, filesystem, joined, mix, new_dir, session, small, stored, write_file

MIN_CHARS, MIN_DOCS = 40, 5
#: Hashes a shard takes on average at most, and bits of each of its two filters (16 a hash, 4 probes: 0.2 % false suspects).
SHARD_HASHES, FILTER_BITS, PROBES = 1_000_000, 1 << 24, 4
UPPER, LOWER, BLANK = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "' \\t\\n\\u000B\\f\\r'"


class Bloom:
    """A Bloom filter over 64-bit hashes with vectorised add and test."""

    def __init__(self, bits: int = FILTER_BITS, probes: int = PROBES):
        self.bits, self.probes, self.data = bits, probes, np.zeros(bits >> 3, np.uint8)

    def places(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = mix(h), mix(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        for i in range(self.probes):
            at = (a + np.uint64(i) * b) & np.uint64(self.bits - 1)
            yield (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))

    def add(self, h: np.ndarray) -> None:
        for byte, bit in self.places(h):
            np.bitwise_or.at(self.data, byte, bit)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for byte, bit in self.places(h):
            found &= (self.data[byte] & bit) > 0
        return found


def twice_seen(batches: Iterator[tuple[np.ndarray, np.ndarray]], bits: int = FILTER_BITS) -> Bloom:
    """The twice-seen filter after all hashes have passed: it holds every one that repeats.
    batches: hashes, and for each whether it is known to repeat already."""
    once, twice = Bloom(bits), Bloom(bits)
    for h, known in batches:
        own, at, n = np.unique(h.view(np.uint64), return_inverse=True, return_counts=True)
        again = (n > 1) | once.has(own) | (np.bincount(at, known, len(own)) > 0)
        twice.add(own[again])
        once.add(own[~again])
    return twice


def local_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each hash of one input task once, with whether the task holds it more than once."""
    met = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
    own, n = np.unique(np.concatenate(met), return_counts=True) if met else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for i in range(0, len(own), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(own[i : i + 100_000]), pa.array(n[i : i + 100_000] > 1)], ["h", "again"])


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Batches whose first column is the shard, in order of it -> each shard with its batches."""

    def parts() -> Iterator[tuple[int, pa.RecordBatch]]:
        for b in batches:
            s = b.column(0).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])).tolist() if len(s) else []
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                yield int(s[i]), b.slice(i, j - i)

    for shard, own in groupby(parts(), lambda x: x[0]):
        yield shard, (b for _, b in own)


def filters(folder: str, bits: int):
    """mapInArrow: shard, h, again -> a filter file a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = filesystem(folder)
        for shard, own in by_shard(batches):
            twice = twice_seen(((b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)) for b in own), bits)
            part = f"{uuid.uuid4().hex}.part"
            write_file(f"{folder}/{part}", twice.data.tobytes())
            fs.move(f"{place}/{part}", f"{place}/{shard}.bloom")  # a retried task puts the same in its place
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], ["shard"])

    return run


def suspects(folder: str, bits: int):
    """mapInArrow: shard, h -> the hashes that their shard's filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = filesystem(folder)
        for shard, own in by_shard(batches):
            twice = Bloom(bits)
            with fs.open_input_file(f"{place}/{shard}.bloom") as f:
                twice.data = np.frombuffer(f.read(), np.uint8)
            for b in own:
                yield b.filter(pa.array(twice.has(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))).select(["h"])

    return run


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_keys(text: Column, least: int) -> Column:
    """The distinct keys of a text's lines with at least `least` code points."""
    return F.array_distinct(F.filter(F.transform(lines_of(text), key_of), lambda k: F.length(k) >= least))


def placed_keys(text: Column, least: int) -> Column:
    """Place and key of every line whose key has at least `least` code points."""
    return F.filter(F.transform(lines_of(text), lambda x, i: F.struct(i.alias("at"), key_of(x).alias("key"))), lambda s: F.length(s["key"]) >= least)


def held_by_row(docs: DataFrame, found: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, t, at and key of suspected lines where suspects are too many to broadcast: only hashes are joined with them, with
    row and place; the texts of rows with suspected lines are read again from a stored copy, by row."""
    rows = stored(docs.select("doc_id", "text", "t", F.monotonically_increasing_id().alias("row")), "line-rows", "zstd")
    lines = rows.select("row", F.inline(placed_keys(F.col("text"), min_chars))).select("row", "at", F.xxhash64("key").alias("h"))
    places = stored(joined(lines, found, "h").groupBy("row").agg(F.collect_list("at").alias("places")), "line-places")
    both = rows.join(places, "row").withColumn("lines", lines_of(F.col("text")))
    return both.select("doc_id", "t", F.inline(F.transform("places", lambda i: F.struct(i.alias("at"), key_of(F.col("lines")[i]).alias("key")))))


def dropped_places(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs: doc_id, text and t, a hash of the text. doc_id, t and drop: of each text that loses lines, their places."""
    spark = session(docs.sparkSession)
    keys = docs.select("doc_id", F.explode(long_keys(F.col("text"), min_chars)).alias("key"))
    hashes = stored(keys.select(F.xxhash64("key").alias("h")).mapInArrow(local_hashes, "h long, again boolean"), "line-hashes")
    shards, folder = hashes.count() // SHARD_HASHES + 1, new_dir(spark, "line-filters")
    shards = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shard = F.floor((F.shiftrightunsigned("h", 33) * shards) / (1 << 31)).cast("int")
    dealt = hashes.select(shard.alias("shard"), "h", "again").repartitionById(shards, "shard")
    stored(dealt.mapInArrow(filters(folder, FILTER_BITS), "shard int"), "line-filters-done")
    found = stored(dealt.select("shard", "h").mapInArrow(suspects(folder, FILTER_BITS), "h long").distinct(), "line-suspects")
    if small(found) and found.count() <= BROADCAST_ROWS:
        lines = docs.select("doc_id", "t", F.inline(placed_keys(F.col("text"), min_chars)))
        held = lines.withColumn("h", F.xxhash64("key")).join(F.broadcast(found), "h")
    else:
        held = held_by_row(docs, found, min_chars)
    held = stored(held.groupBy("key", "doc_id", "t").agg(F.collect_list("at").alias("places")), "line-held")
    once = held.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    sure = once.groupBy("key").agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= min_docs)
    lost = joined(held, stored(sure, "line-sure"), "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "t").agg(F.flatten(F.collect_list("places")).alias("drop"))


def deduped(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs: doc_id and text. Returns doc_id, n_lines, n_dropped and kept, the text without its dropped lines."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    drops = dropped_places(docs, min_chars, min_docs).withColumnsRenamed({"doc_id": "_id", "t": "_t"})
    # null ids are told apart by their texts, so that they don't meet in one task
    both = docs.join(drops, (F.col("t") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    both = both.select("doc_id", lines_of(F.col("text")).alias("lines"), "drop")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.col("lines")[i]))
    return both.select("doc_id", "lines", kept.alias("kept")).select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept"),
    )


def sql(documents: str = "documents", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> str:
    return rf"""WITH lines AS (SELECT doc_id, n, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM (SELECT doc_id, text, row_number() OVER () AS n FROM {documents})),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
sure AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
marked AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS lost FROM keyed k LEFT JOIN sure s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY n, doc_id"""
