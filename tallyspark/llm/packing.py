"""Cost-balanced packing: documents into sequences of at most SEQUENCE tokens whose attention costs are alike.

Documents become token ids once, through the tokenizers library, and are taken block by block (BLOCK_TOKENS ids, or one
longer document) in the task that read them: nothing is shuffled, and no task holds more than a block. A block of n ids
has n // SEQUENCE sequences of SEQUENCE ids, and one sequence for each binary digit of what is left over; these are powers
of two, so that no sequence needs any padding. The cost of a piece of m ids is estimated as LINEAR * m + QUADRATIC * m**2:
the second term is its attention to itself, as documents in one sequence don't attend to each other.

A block's documents are cut to pieces of SEQUENCE ids and a rest. Pieces go by descending length (ties: in order of the
documents) to the sequence of lowest cost (ties: the smallest number) that has room for all of it; where none has, the one
of lowest cost with any room takes what fits, and the remaining ids queue again by their length. As the room of a block is
exactly its number of ids, every sequence ends up full and each id lies in one piece.

A sequence's number is its block's number times BLOCK_SEQUENCES plus its place in the block; a block's number is that of its
partition and its place there, so a task that runs again gives the same numbers. Pieces are stored as Parquet in the
shared folder, from where reports and training batches read them.

Defined cases: a null text is empty and has just the end id; null and repeated ids are rows like any other; a text of any
length is whole, cut at every SEQUENCE ids; an empty table gives no pieces. Other columns, whatever they are called, play no part.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import session, stored
from .tokenfile import encoder

END_ID, SEQUENCE = 0, 1024
#: Cost of an id, and of a pair of ids of one document; they are equal for a document of LINEAR / QUADRATIC ids.
LINEAR, QUADRATIC = 1.0, 1 / 512
#: Ids of a block, about; sequences of a block at most, and blocks of a partition at most (both as powers of two).
BLOCK_TOKENS, BLOCK_SEQUENCES, BLOCKS = 1 << 20, 1 << 26, 1 << 15
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(length: np.ndarray | int | Column) -> np.ndarray | float | Column:
    return length * LINEAR + length * length * QUADRATIC


def capacities(n: int, sequence: int = SEQUENCE) -> np.ndarray:
    """Lengths of the sequences for n ids: full ones, then the binary digits of the rest, largest first."""
    rest = [1 << k for k in range(sequence.bit_length(), -1, -1) if (n % sequence) >> k & 1]
    return np.array([sequence] * (n // sequence) + rest, np.int64)


def placed(lengths: np.ndarray, sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Documents of these lengths -> pieces: document, start in it, length, sequence, offset in that."""
    room = capacities(int(lengths.sum()), sequence)
    used, costs = np.zeros(len(room), np.int64), np.zeros(len(room))
    out, free = [], 0
    whole = lengths // sequence
    for d in np.flatnonzero(whole).tolist():  # the longest pieces there are: each has the next empty sequence to itself
        for k in range(int(whole[d])):
            out.append((d, k * sequence, sequence, free, 0))
            free += 1
    used[:free] = sequence
    rest = lengths - whole * sequence
    queue = [(-int(rest[d]), d, int(whole[d]) * sequence) for d in np.flatnonzero(rest).tolist()]
    heapq.heapify(queue)
    # only these can still take anything; what is full leaves from time to time
    open_ = np.arange(free, len(room))
    while queue:
        m, d, start = heapq.heappop(queue)
        m = -m
        left = room[open_] - used[open_]
        fits = np.flatnonzero(left >= m)
        if not len(fits):
            fits = np.flatnonzero(left > 0)
        s = int(open_[fits[np.argmin(costs[open_[fits]])]])
        take = min(m, int(room[s] - used[s]))
        out.append((d, start, take, s, int(used[s])))
        used[s] += take
        costs[s] += cost(take)
        if take < m:
            heapq.heappush(queue, (take - m, d, start + take))
        if used[s] == room[s] and len(fits) * 2 < len(open_):
            open_ = open_[room[open_] > used[open_]]
    return out


def packer(path: str, end_id: int, sequence: int, block_tokens: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        end = enc.packed([end_id])
        doc_ids, docs, n, number = [], [], 0, 0

        def block() -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(x) // enc.width for x in docs], np.int64)
            base = (part * BLOCKS + number) * BLOCK_SEQUENCES
            pieces = placed(lengths, sequence)
            for i in range(0, len(pieces), 4096):
                d, start, m, s, offset = (np.array(x, np.int64) for x in zip(*pieces[i : i + 4096], strict=True))
                ids = [np.frombuffer(docs[k], enc.kind, count, at * enc.width).astype("<u4") for k, at, count in zip(d.tolist(), start.tolist(), m.tolist(), strict=True)]
                cols = [pa.array([doc_ids[k] for k in d.tolist()], pa.int64()), pa.array(start), pa.array(m), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(lengths[d]), pa.array(base + s), pa.array(offset)]
                more = [pa.array([x.tobytes() for x in ids], pa.binary())] if keep_ids else []
                yield pa.RecordBatch.from_arrays(cols + more, [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * keep_ids)

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                doc_ids.append(doc_id)
                docs.append(ids + end)
                n += len(docs[-1]) // enc.width
                if n >= block_tokens:
                    if number >= BLOCKS:
                        raise ValueError(f"a partition has more than {BLOCKS} blocks: read it in smaller parts")
                    yield from block()
                    doc_ids, docs, n, number = [], [], 0, number + 1
        if docs:
            yield from block()

    return run


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, sequence: int = SEQUENCE, block_tokens: int = BLOCK_TOKENS, keep_ids: bool = False) -> DataFrame:
    """docs: doc_id, text. A stored row for each piece: PIECES, and with keep_ids its ids (little-endian unsigned 32-bit).
    sequence must be a power of two."""
    if sequence < 1 or sequence & (sequence - 1):
        raise ValueError(f"sequence {sequence} is no power of two")
    session(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(docs.mapInArrow(packer(tokenizer_path, end_id, sequence, block_tokens, keep_ids), PIECES + ", ids binary" * keep_ids), "pieces")


def sequences(pieces: DataFrame) -> DataFrame:
    """packed(keep_ids=True) -> a row for each sequence: sequence_id, length, cost, ids (binary, all its pieces' ids in
    order) and lengths, those of its pieces (what block-diagonal attention needs). A sequence has a bounded number of ids."""
    parts = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sum(cost(F.col("length"))).alias("cost"), F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("_p"))
    joined = F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", "length", "cost", joined.alias("ids"), F.transform("_p", lambda p: p["length"]).alias("lengths"))


def balance(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """One row: sequences, ids, what padding to `sequence` would add (none for powers of two), mean and largest cost of full sequences."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum(cost(F.col("length"))).alias("cost"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    full = F.when(F.col("n") == sequence, F.col("cost"))
    return per.agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("n").alias("n_ids"), F.sum(F.when(power, 0).otherwise(sequence - F.col("n"))).alias("padding"), F.avg(full).alias("mean_cost"), F.max(full).alias("most_cost"))
