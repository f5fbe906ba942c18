"""Token ids in binary files: each document a zstandard frame of its own under one shared dictionary.

File (little endian): magic 'TKZ1', dictionary hash (32 bytes, SHA-256), id width in bytes (uint32); the frames; the
index, for each document: doc_id int64, flags uint32 (1: id is null), n_tokens uint32, offset uint64, length uint32;
then n_docs uint64, index offset uint64. The dictionary is a file of its own, named by its hash. Any document is
read by two small reads: its index row and its frame.

Documents are dealt by ranges of doc_id, one file a range, so that files in order hold ascending ids. Only one total
per file meets on the driver, to place each file's first id in the whole.

Encoding: texts are cut where the tokenizer's byte-level pre-tokenizer always cuts (a run of non-space with one
space before it; runs of white space), many at once by numpy, and each distinct piece goes through the tokenizers library
once a worker. Pieces are told apart by their bytes: those of up to 7 are numbers with their length, longer ones are
looked up whole, so no hash decides an id. Texts with rare white space or special tokens, and texts of
tokenizers with another pre-tokenizer, go through it whole, so the ids are the library's own in all cases.

The dictionary is trained on a bounded sample: about DICT_DOCS documents chosen by a hash of their id, cut to pieces
of DICT_PIECE bytes. It affects sizes only.

Defined cases: a null text is empty and has just the end id; null ids sort first; rows with equal ids keep an
arbitrary but fixed order (by a hash of the text). An empty table gives no files and an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, is_space, new_dir, session, stored, write_file

END_ID = 2
DICT_DOCS, DICT_BYTES, DICT_PIECE, LEVEL = 1_000, 32 << 10, 8 << 10, 3
#: Bytes of text for a file, about.
FILE_BYTES = 256 << 20
MAGIC, HEAD, ROW, TAIL = b"TKZ1", "<4s32sI", "<qIIQI", "<QQ"
#: A text with one of these, or with a special token, or of more bytes, is encoded whole: engines differ on what they call space here.
RARE, MOST_BYTES = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"), 8 << 20
#: Bytes of texts that are cut together.
PART_BYTES = 1 << 20

#: Kinds of bytes: 1 letter, 2 digit, 3 other ASCII sign but the apostrophe, which may join what follows; 0 the rest.
KIND = np.zeros(256, np.uint8)
KIND[33:127] = 3
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[48:58] = 2
KIND[39] = 0


def pieces(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin in UTF-8 texts (bounds: the n + 1 places where texts begin): a word takes one space before it, and
    is cut between letters, digits and other signs; of other white space before a word the last sign is a piece, the rest
    another; white space at a text's end is one piece. The byte-level pre-tokenizer cuts at all these places."""
    space, edge = is_space(data), np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    opens, same = edge[:-1].copy(), space[1:] == space[:-1]
    opens[1:] |= ~same
    begin = np.flatnonzero(opens)
    end = np.append(begin[1:], len(data))
    run = space[begin]
    first, last = begin[run], end[run]
    before_word = ~edge[last]
    spaced = before_word & (data[last - 1] == 32)
    opens[last[spaced]] = False
    opens[first[before_word & (last - first == 1)]] = True
    opens[last[before_word] - 1] = True
    kind = KIND.take(data)
    opens[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    return np.flatnonzero(opens)


#: Pieces of up to so many bytes are their own keys, with their length on top.
SHORT = 7


def short_keys(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes and the length of each piece of up to SHORT bytes as one number; of longer pieces this is no key yet."""
    wide = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    kept = np.minimum(size, SHORT).astype(np.uint64)
    return (wide[begin] & ((np.uint64(1) << (kept * np.uint64(8))) - np.uint64(1))) | (kept << np.uint64(8 * SHORT))


class Encoder:
    """Whole texts to ids through the tokenizers library, each distinct piece once."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        made = json.loads(self.tokenizer.to_str())
        cut = made["pre_tokenizer"] or {}
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        #: Only this pre-tokenizer is known to cut where pieces() does; texts of others are encoded whole.
        self.known_cut = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and made["normalizer"] is None and len(line) == 1
        self.line = line[0] if line else -1
        self.clear()

    def clear(self) -> None:
        #: Numbers of pieces by key, and keys of long pieces; where the ids of a numbered piece begin in ids, and how many they are.
        self.number: dict[int, int] = {}
        self.long: dict[bytes, int] = {}
        self.ids, self.at, self.many = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def add(self, keys: list[int], texts: list[str]) -> None:
        """Number these pieces. Words go through the library together, a line each: a line end is a token of its own."""
        space = [t[-1].isspace() for t in texts]
        words = [t for t, x in zip(texts, space, strict=True) if not x]
        spaces = [t for t, x in zip(texts, space, strict=True) if x]
        made, many = [self.ids], [self.many]
        for e in self.tokenizer.encode_batch_fast(["\n".join(words[i : i + 1_000]) for i in range(0, len(words), 1_000)], add_special_tokens=False):
            ids = np.array(e.ids, np.int64)
            ends = np.flatnonzero(ids == self.line)
            many.append(np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1)
            made.append(ids[ids != self.line].astype(self.kind))
        for e in self.tokenizer.encode_batch_fast(spaces, add_special_tokens=False):
            many.append(np.array([len(e.ids)]))
            made.append(np.array(e.ids, self.kind))
        n = len(self.many)
        order = sorted(range(len(texts)), key=space.__getitem__)
        self.number.update(zip((keys[i] for i in order), range(n, n + len(texts)), strict=True))
        self.ids, self.many = np.concatenate(made), np.concatenate(many)
        self.at = np.cumsum(self.many) - self.many

    def flat(self, which: np.ndarray) -> np.ndarray:
        """The ids of these numbered pieces, one after another."""
        many = self.many[which]
        ends = np.cumsum(many)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[which] - ends + many, many)]

    def cut(self, texts: list[bytes]) -> list[bytes]:
        """Non-empty UTF-8 texts without anything rare."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.cumsum([0] + [len(t) for t in texts])
        begin = pieces(data, bounds)
        size = np.diff(np.append(begin, len(data)))
        if len(self.number) > self.most:
            self.clear()
        key, raw, known = short_keys(data, begin, size), data.tobytes(), self.long
        longer = np.flatnonzero(size > SHORT)
        key[longer] = np.fromiter((known.setdefault(raw[i:j], len(known)) for i, j in zip(begin[longer].tolist(), (begin + size)[longer].tolist(), strict=True)), np.uint64, len(longer)) | np.uint64(1 << 63)
        at, keys = pd.factorize(key)  # by hashing, where np.unique sorts
        first = np.empty(len(keys), np.int64)
        first[at[::-1]] = np.arange(len(at))[::-1]
        keys = keys.tolist()
        if new := [i for i, h in enumerate(keys) if h not in self.number]:
            begins, ends = begin[first[new]], (begin + size)[first[new]]
            self.add([keys[i] for i in new], [raw[i:j].decode() for i, j in zip(begins.tolist(), ends.tolist(), strict=True)])
        which = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))[at]
        ids = self.flat(which)
        ends = np.concatenate([[0], np.cumsum(self.many[which])])[np.searchsorted(begin, bounds)] * self.width
        out = ids.tobytes()
        return [out[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed; without an end id."""
        out: list[bytes | None] = [None] * len(texts)
        part, size = [], 0
        for i, t in enumerate(texts):
            if not t:
                out[i] = b""
            elif not self.known_cut or len(t) > MOST_BYTES or RARE.search(t) or self.special.search(t):
                out[i] = self.whole(t)
            else:
                part.append((i, t.encode()))
                size += len(part[-1][1])
            if size > PART_BYTES:
                for (k, _), ids in zip(part, self.cut([x for _, x in part]), strict=True):
                    out[k] = ids
                part, size = [], 0
        if part:
            for (k, _), ids in zip(part, self.cut([x for _, x in part]), strict=True):
                out[k] = ids
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def trained(docs: DataFrame, path: str) -> bytes:
    """A zstandard dictionary from a bounded sample of serialized id arrays."""
    share = min(1.0, DICT_DOCS / max(1, docs.count()))
    sample = docs.filter(F.pmod(F.xxhash64(F.lit("dict"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text").limit(2 * DICT_DOCS)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in encoder(path).encode([t or "" for t in b.column(0).to_pylist()]):
                yield pa.RecordBatch.from_arrays([pa.array([data[:DICT_PIECE]], pa.binary())], ["ids"])

    pieces = [bytes(r[0]) for r in sample.mapInArrow(ids, "ids binary").collect() if len(r[0]) > 8]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b"".join(pieces)[:DICT_BYTES]


def dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data) if data else zstandard.ZstdCompressionDict(b"\0" * 8)


def writer(path: str, folder: str, data: bytes, end_id: int | None):
    digest = hashlib.sha256(data).digest()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = b"" if end_id is None else enc.packed([end_id])
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary(data), write_content_size=True)
        out, rows, at, total, name = None, [], struct.calcsize(HEAD), 0, f"{uuid.uuid4().hex}.tkz"
        for b in batches:
            if out is None:
                fs, place = filesystem(folder)
                out = fs.open_output_stream(f"{place}/{name}", compression=None)
                out.write(struct.pack(HEAD, MAGIC, digest, enc.width))
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                frame = squeeze.compress(ids + end)
                n = len(ids + end) // enc.width
                out.write(frame)
                rows.append(struct.pack(ROW, doc_id or 0, int(doc_id is None), n, at, len(frame)))
                at += len(frame)
                total += n
        if out is not None:
            out.write(b"".join(rows) + struct.pack(TAIL, len(rows), at))
            out.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, name, len(rows), total)], ["part", "file", "n_docs", "n_tokens"])

    return write


def write(docs: DataFrame, tokenizer_path: str, end_id: int | None = END_ID) -> tuple[str, DataFrame]:
    """docs: doc_id, text. Returns the folder and the stored list of files: part, file, n_docs, n_tokens."""
    spark = session(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    folder, data = new_dir(spark, "tokens"), trained(docs, tokenizer_path)
    write_file(f"{folder}/{hashlib.sha256(data).hexdigest()}.dict", data)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // FILE_BYTES + 1)
    dealt = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return folder, stored(dealt.mapInArrow(writer(tokenizer_path, folder, data, end_id), "part long, file string, n_docs long, n_tokens long"), "token-files")


def file_index(fs, path: str) -> tuple[bytes, int, list[tuple]]:
    """Dictionary hash, id width and index rows of one file."""
    with fs.open_input_file(path) as f:
        _, digest, width = struct.unpack(HEAD, f.read_at(struct.calcsize(HEAD), 0))
        n, at = struct.unpack(TAIL, f.read_at(struct.calcsize(TAIL), f.size() - struct.calcsize(TAIL)))
        return digest, width, list(struct.iter_unpack(ROW, f.read_at(n * struct.calcsize(ROW), at)))


def opener(fs, folder: str, digest: bytes) -> zstandard.ZstdDecompressor:
    with fs.open_input_file(f"{folder}/{digest.hex()}.dict") as f:
        return zstandard.ZstdDecompressor(dict_data=dictionary(f.read()))


def document(folder: str, file: str, k: int) -> np.ndarray:
    """The ids of the k-th document of one file, by its index row and its frame alone."""
    fs, place = filesystem(folder)
    digest, width, rows = file_index(fs, f"{place}/{file}")
    with fs.open_input_file(f"{place}/{file}") as f:
        data = opener(fs, place, digest).decompress(f.read_at(rows[k][4], rows[k][3]))
    return np.frombuffer(data, f"<u{width}").astype("<u4")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def reader(folder: str, keep_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = filesystem(folder)
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                digest, width, rows = file_index(fs, f"{place}/{name}")
                open_ = opener(fs, place, digest)
                out = []
                with fs.open_input_file(f"{place}/{name}") as f:
                    for doc_id, null, n, at, length in rows:
                        ids = np.frombuffer(open_.decompress(f.read_at(length, at)), f"<u{width}").astype("<u4")
                        if len(ids) != n:
                            raise ValueError(f"{name}: a frame has {len(ids)} ids, its index row says {n}")
                        out.append((None if null & 1 else doc_id, start, n, zlib.crc32(ids.tobytes()), ids if keep_ids else None))
                        start += n
                        if len(out) >= 256:
                            yield packed(out, keep_ids)
                            out = []
                if out:
                    yield packed(out, keep_ids)

    return read


def packed(rows: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
    more = [pa.array([r[4].astype(np.int64) for r in rows], pa.list_(pa.int64()))] if keep_ids else []
    return pa.RecordBatch.from_arrays(cols + more, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + len(more)])


def read(folder: str, files: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32, and ids if asked."""
    totals = sorted((r["part"], r["file"], r["n_tokens"]) for r in files.collect())  # one row a file
    base, rows = 0, []
    for _, name, n in totals:
        rows.append((name, base))
        base += n
    spark = files.sparkSession
    listed = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)), "file")
    return listed.mapInArrow(reader(folder, keep_ids), READ + (", ids array<long>" if keep_ids else ""))
