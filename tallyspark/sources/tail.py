"""Growing transcripts as a stream: a Python data source that keeps a byte offset for each file.

A batch takes from each file what lies between its last offset and the last line end that it has now; a line that is still
being written waits. A file that is shorter than its offset was cut or replaced and is read from its start again; one that
went and came back too. Offsets are a map of path and bytes, a small entry for each live file, in the query's own offset
log, so a restarted query goes on where the last one stopped. Long ranges are cut to CHUNK_BYTES: a chunk owns the lines
that begin in it, and reads them by PIECE. The listing and the search for the last line end of files that changed run on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import transcripts

CHUNK_BYTES, PIECE, STEP = 32 << 20, 1 << 20, 64 << 10
COLUMNS = "path string, start long, value string"


class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        """(path, first byte of the whole range, first and last byte of this chunk)."""
        super().__init__(ranges)


def opened(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path in it, and what stands before paths in URIs."""
    uri = uri if "://" in uri else "file://" + uri
    fs, path = pafs.FileSystem.from_uri(uri.rstrip("/"))
    return fs, path, uri.rstrip("/").removesuffix(path)


def complete(f: pa.NativeFile, size: int, least: int = 0) -> int:
    """Where the last whole line ends, `least` if no line ends behind it."""
    at = size
    while at > least:
        start = max(least, at - STEP)
        found = f.read_at(at - start, start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return least


def lines_of(f: pa.NativeFile, whole: int, first: int, last: int) -> Iterator[tuple[list[int], list[str]]]:
    """Starts and texts of the lines that begin in [first, last) of a range that starts at `whole`, where a line does: those
    of a piece at a time, so that a task holds a piece and the line that is open at its end."""
    size, at, read, parts = f.size(), first, first, []
    skip = first > whole and f.read_at(1, first - 1) != b"\n"  # the line that is open here began before
    while at < last and read < size:
        piece = f.read_at(min(PIECE, last - read) if read < last else STEP, read)  # the last line may end behind the chunk
        read += len(piece)
        cut = piece.rfind(b"\n") + 1
        parts.append(piece[:cut] if cut else piece)
        if not piece:  # it was cut meanwhile
            break
        if not cut:
            continue
        lines = b"".join(parts).split(b"\n")[:-1]
        parts = [piece[cut:]]
        starts, texts = [], []
        for line in lines:
            if at >= last:
                break
            if not skip:
                starts.append(at)
                texts.append(line.decode("utf-8", "replace"))
            skip = False
            at += len(line) + 1
        yield starts, texts


class TailReader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root, self.seen = root, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, base, _ = opened(self.root)
        now, seen = {}, {}
        for info in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
            if info.type == pafs.FileType.File and info.path.endswith(".jsonl"):
                stamp = (info.size, info.mtime_ns)
                if info.path in self.seen and self.seen[info.path][0] == stamp:
                    end = self.seen[info.path][1]
                else:
                    with fs.open_input_file(info.path) as f:
                        end = complete(f, min(info.size, f.size()))
                seen[info.path], now[info.path] = (stamp, end), end
        self.seen = seen
        return now

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        out, size = [[]], 0
        for path, last in sorted(end.items()):
            whole = start.get(path, 0)
            whole = 0 if last < whole else whole
            for first in range(whole, last, CHUNK_BYTES):
                if size >= CHUNK_BYTES:
                    out.append([])
                    size = 0
                out[-1].append((path, whole, first, min(last, first + CHUNK_BYTES)))
                size += out[-1][-1][3] - first
        return [Ranges(x) for x in out]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _, before = opened(self.root)
        for path, whole, first, last in partition.value:
            try:
                f = fs.open_input_file(path)
            except FileNotFoundError:  # it went after the listing
                continue
            with f:
                for starts, texts in lines_of(f, whole, first, last):
                    for i in range(0, len(starts), 10_000):
                        n = len(starts[i : i + 10_000])
                        yield pa.RecordBatch.from_arrays([pa.array([before + path] * n), pa.array(starts[i : i + n], pa.int64()), pa.array(texts[i : i + n])], ["path", "start", "value"])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return COLUMNS

    def streamReader(self, schema: object) -> TailReader:
        return TailReader(self.options["root"])


def read_stream(spark: SparkSession, root: str) -> DataFrame:
    """New lines of all *.jsonl files below a root, as transcripts.read() gives them: path, line and value."""
    spark.dataSource.register(TailSource)
    rows = spark.readStream.format("transcript_tail").option("root", root).load()
    at = F.struct(F.col("start").alias("block"), F.lit(0).cast("long").alias("place"))
    return transcripts.trimmed(rows.select("path", at.alias("line"), "value"))


