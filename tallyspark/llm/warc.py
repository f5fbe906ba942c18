"""WARC archives: index first, then coalesced sorted byte-range reads.

Write: each task appends one gzip member per record to its own archive file in the shared folder and returns an
index row per record (file, offset, length, url, digest, type). Read: the index rows that are selected are sorted by
file and offset, neighbours are joined to one range while the gap between them is small, and each range is read once.

Payloads of at least `min_bytes` that occur more than once are stored once, as the response with the largest page
id; the others become revisit records that name it. A payload that a third of all pages share is one partial
maximum per task when grouped, and its join back is salted.

Defined cases: a null html is an empty payload; a null url is written as 'urn:page:<id>'; rows with equal ids are
written one by one; among rows with the same payload and the same largest id, the one that sorts first by url is
the response; a null id sorts below all others. Empty tables give empty results.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, joined, new_dir, session, stored

MIN_BYTES = 1000
#: An archive is closed and the next begun at this size; a read spans at most READ_BYTES and gaps up to GAP_BYTES.
ARCHIVE_BYTES, READ_BYTES, GAP_BYTES = 256 << 20, 8 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def info(file: str) -> bytes:
    """The warcinfo record that an archive begins with, as a gzip member of its own."""
    body = b"format: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(file)}", f"WARC-Date: {DATE}", f"WARC-Filename: {file}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 3, mtime=0)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool, place: str, response: bool = False, to_url: str | None = None) -> bytes:
    """One WARC/1.1 record as a gzip member of its own. The response of several equal payloads is named by their digest, so
    that revisits in any archive can refer to it; all others by their place (archive and offset)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    kind = "revisit" if revisit else "response"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id('sha1:' + digest if response else place)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", f"X-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id('sha1:' + digest)}",
            f"WARC-Refers-To-Target-URI: {clean_url(to_url, refers_to)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def parsed(member: bytes) -> dict:
    """What a reader takes from one record: headers, type, payload (None for a revisit) and its full length."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = next(int(x[15:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length:"))
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
        "payload": None if revisit else payload, "payload_bytes": declared, "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_id": fields["WARC-Record-ID"], "refers_to_record": fields.get("WARC-Refers-To"), "refers_to": int(fields["X-Refers-To-Page-ID"]) if revisit and fields["X-Refers-To-Page-ID"] else None,
    }


def clean_url(url: str | None, page_id: int | None) -> str:
    return "".join(c if c > " " else "%20" for c in url) if url else f"urn:page:{page_id}"


def writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = out = None
        name, at = "", 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        fs, path = filesystem(folder)
                        fs.create_dir(path, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0  # a retried task writes another file
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                        first = info(name)
                        out.write(first)
                        at = len(first)
                    url, payload = clean_url(r["url"], r["page_id"]), (r["html"] or "").encode("utf-8", "surrogatepass")
                    revisit = r["record_type"] == "revisit"
                    data = record(r["page_id"], url, payload, r["digest"], r["refers_to"], revisit, f"{name}/{at}", r["to_url"] is not None and not revisit, r["to_url"])
                    out.write(data)
                    rows.append((r["page_id"], name, at, len(data), url, r["digest"], r["record_type"], r["refers_to"]))
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), INDEX_TYPES, strict=True)], INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    return write


INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
INDEX_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in INDEX.split(", ")]


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """Sorted (file, offset, length) -> (file, start, end, row numbers): neighbours joined while gaps and spans are small."""
    name, start, end, own = "", 0, 0, []
    for i, (f, at, n) in enumerate(rows):
        if own and f == name and at - end <= GAP_BYTES and at + n - start <= READ_BYTES:
            end = max(end, at + n)
            own.append(i)
        else:
            if own:
                yield name, start, end, own
            name, start, end, own = f, at, at + n, [i]
    if own:
        yield name, start, end, own


READ = "page_id long, url string, record_type string, digest string, payload_bytes long, refers_to long, payload binary"


def reader(folder: str, keep_payload: bool):
    names = [x.split()[0] for x in READ.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in READ.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        name, file = "", None
        for batch in batches:
            at = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            for f, start, end, own in ranges(at):
                if f != name:
                    if file is not None:
                        file.close()
                    name, file = f, fs.open_input_file(f"{path}/{f}")
                data = file.read_at(end - start, start)
                found = [parsed(data[at[i][1] - start : at[i][1] - start + at[i][2]]) for i in own]
                for r in found:
                    if r["payload"] is not None and hashlib.sha1(r["payload"]).hexdigest() != r["digest"]:
                        raise ValueError(f"digest of page {r['page_id']} in {f} does not match its payload")
                    r["payload"] = r["payload"] if keep_payload else None
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in zip(names, types, strict=True)], names)
        if file is not None:
            file.close()

    return read


def write(pages: DataFrame, min_bytes: int = MIN_BYTES) -> tuple[str, DataFrame]:
    """pages: page_id, url, html. Returns the folder of the archives and the stored index (columns INDEX)."""
    spark = session(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    large = F.octet_length("html") >= min_bytes
    # the largest id, then the first url, then any one of rows that are equal in both
    order = F.struct(F.col("page_id").alias("refers_to"), F.coalesce("url", F.lit("")).alias("u"))
    groups = pages.filter(large).groupBy("digest").agg(F.max(order).alias("to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = stored(groups.select("digest", "to.refers_to", F.col("to.u").alias("to_url")), "warc-groups")
    marked = joined(pages, groups, "digest", "left")
    is_to = F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.coalesce("url", F.lit("")) == F.col("to_url"))
    kind = F.when(F.col("to_url").isNull() | ~large | is_to, "response").otherwise("revisit")
    to_url = F.when(large, F.col("to_url")).alias("to_url")
    marked = marked.select("page_id", "url", "html", "digest", kind.alias("record_type"), F.when(kind == "revisit", F.col("refers_to")).alias("refers_to"), to_url)
    folder = new_dir(spark, "warc")
    return folder, stored(marked.mapInArrow(writer(folder), INDEX), "warc-index")


def read(folder: str, index: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records that index selects, in columns READ; payload is null for revisits, and if it isn't to be kept."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(reader(folder, keep_payload), READ)


def sql(pages: str = "pages", min_bytes: int = MIN_BYTES) -> str:
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM {pages}),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {min_bytes} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {min_bytes} AND page_id < top THEN top END AS refers_to FROM w"""
