"""WARC archives compressed with a Zstandard dictionary.

A file is a leading skippable frame that embeds the dictionary, then one
Zstandard frame for each record, so any record is read alone.  The dictionary is
trained on the first records of the file.  Records with equal payloads are
written once; the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import fresh_folder, opened, publish, sized, whole_text, written

#: Fixed by the format for dictionaries in WARC files: a skippable frame.
SKIPPABLE = 0x184D2A5D
_SAMPLE_BYTES = 8 << 20
_DICT_BYTES = 64 << 10
_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{copy}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_safe(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _header_plain(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, copy: int, url: str | None, payload: bytes, original: tuple[int | None, int] | None) -> bytes:
    """A response record, or one that revisits ``original`` and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if original else 'response'}", f"WARC-Record-ID: {record_id(page_id, copy)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_safe(url)}")
    lines += [f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if original:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(*original)}", f"WARC-Refers-To-Page: {'' if original[0] is None else original[0]}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(out, records: Iterator[bytes], level: int = 3) -> int:
    """Write one archive; holds at most the dictionary's sample in memory."""
    sample: list[bytes] = []
    size = 0
    for r in records:
        sample.append(r)
        size += len(r)
        if size >= _SAMPLE_BYTES:
            break
    pieces = [r[:65536] for r in sample]
    try:
        raw = zstandard.train_dictionary(min(_DICT_BYTES, max(1024, size // 16)), pieces).as_bytes() if len(pieces) >= 16 else b"".join(pieces[:1])[:4096]
    except zstandard.ZstdError:  # too few or too equal records: their own bytes serve as the dictionary
        raw = b"".join(pieces)[:_DICT_BYTES]
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdCompressor(level=level)
    out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    count = 0
    for chunk in (iter(sample), records):
        for r in chunk:
            out.write(packer.compress(r))
            count += 1
    return count


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record."""
    magic, n = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    raw = source.read(n)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        frame, parts = unpacker.decompressobj(), []
        if not rest and not (rest := source.read(1 << 16)):
            return
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            if not (rest := source.read(1 << 16)):
                raise EOFError("a record's frame is cut short")
        whole = b"".join(parts)
        head, _, body = whole.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
        yield headers, body[: int(headers["Content-Length"])]


def planned(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """Rows to archive: _id, _url, _html, _original (null for a response).

    Only digests of payloads that occur more than once are grouped and joined
    back; the page texts stay where they are unless that table is large.
    """
    html = whole_text(html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), html.alias("_html"), F.sha1(html.cast("binary")).alias("_sha"), F.octet_length(html).alias("_n"))
    first = rows.select("_id", "_sha", "_n").where(F.col("_n") >= least_bytes).groupBy("_sha", "_n").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_c"))
    shared = sized(written(first.where("_c > 1").select(F.col("_sha").alias("_s"), F.col("_n").alias("_m"), "_keep", F.lit(True).alias("_twin")), "warc-shared"))
    return rows.join(shared, (F.col("_sha") == F.col("_s")) & (F.col("_n") == F.col("_m")), "left").select("_id", "_url", "_html", "_twin", "_keep", "_sha")


def write_warcs(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, level: int = 3) -> DataFrame:
    """Archive every row of ``pages``; returns the manifest (uri, records).

    Payload: the html in UTF-8, null as empty.  Of payloads that are equal and
    have at least ``least_bytes`` bytes, the row with the largest id is the
    response (null ids rank last) and others revisit it; rows that repeat both id
    and payload count as copies, one of them is the response.  Payloads of any length
    are archived whole; only the dictionary is built from a bounded sample, the first
    8 MB of a file's records and 64 KB of each.  Other columns are not read, an empty
    table gives archives without records.
    """
    plan = planned(pages, id_col, url_col, html_col, least_bytes)
    # Rows repeating id and payload: all but one revisit.  Rare, so found apart.
    twins = plan.where("_twin and _id <=> _keep").groupBy("_id", "_sha").count().where("count > 1").select(F.col("_id").alias("_tid"), F.col("_sha").alias("_tsha"), F.lit(True).alias("_again"))
    twins = written(twins, "warc-twins")
    if twins.isEmpty():
        plan = plan.withColumn("_copy", F.lit(0).cast("long"))
    else:
        plan = plan.join(twins, plan._id.eqNullSafe(twins._tid) & (plan._sha == twins._tsha), "left")
        from pyspark.sql import Window

        again = plan.where("_again").withColumn("_copy", F.row_number().over(Window.partitionBy("_id", "_sha").orderBy("_url")) - 1)
        plan = plan.where("_again is null").withColumn("_copy", F.lit(0)).unionByName(again)
    plan = plan.select("_id", F.col("_copy").cast("long"), "_url", "_html", (F.coalesce("_twin", F.lit(False)) & ~(F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_copy") == 0))).alias("_revisit"), "_keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        uri = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"

        def records() -> Iterator[bytes]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    for i, copy, url, html, revisit, keep in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                        yield record(i, copy, url, html.encode("utf-8"), (keep, 0) if revisit else None)

        count = 0

        def write(out) -> None:
            nonlocal count
            count = write_archive(out, records(), level)

        publish(uri, write)
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([count], pa.int64())], ["uri", "records"])

    return written(plan.mapInArrow(run, "uri string, records long"), "warc-manifest")


def read_warcs(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record.

    The digest of a response is computed anew and must be the recorded one.
    """

    def rows(uri: str):
        with opened(uri) as source:
            for headers, block in read_archive(source):
                kind = headers["WARC-Type"]
                noted = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                http, _, payload = block.partition(b"\r\n\r\n")
                n = int(http.rpartition(b"Content-Length: ")[2])
                if kind == "response" and (digest(payload) != noted or len(payload) != n):
                    raise ValueError(f"damaged record in {uri}")
                number = lambda k: int(x) if (x := headers.get(k, "")) else None
                url = headers.get("WARC-Target-URI")
                yield number("WARC-Page-ID"), None if url is None else _header_plain(url), n, noted, kind, number("WARC-Refers-To-Page")

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                some: list[tuple] = []
                for row in rows(uri):
                    some.append(row)
                    if len(some) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
                        some = []
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    n = max(1, manifest.count())
    return manifest.select("uri").repartition(n, "uri").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, **options) -> DataFrame:
    return read_warcs(write_warcs(pages, fresh_folder(pages.sparkSession, "warc"), **options))
