"""Zstandard WARC archives: a dictionary in the leading skippable frame, one frame per record.

Reading decodes one frame after the other and checks each record's headers and
lengths. Archives are written through the file system of the shared folder's
address, and read back with Spark's binaryFile source.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import read, shared_path, write_state

#: Fixed values of the format.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
NAMED = "urn:page:"

DICTIONARY_BYTES, DICTIONARY_SAMPLE = 65536, 256
ARCHIVE_BYTES = 8 << 20
STEP = 1 << 16

RECORDS = ("archive string, position long, record_type string, record_id string, refers_to_id string, target string, "
           "payload_digest string, payload_bytes long, payload binary")


class WarcError(ValueError):
    """An archive that breaks the format: the message names the position."""


def _named(page_id) -> str:
    return f"<{NAMED}{'null' if page_id is None else page_id}>"


def _sha1(payload: bytes) -> str:
    return "sha1:" + hashlib.sha1(payload).hexdigest()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record; a revisit (``refers_to`` is given) holds the HTTP headers only, with the full payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _named(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _named(refers_to))]
    fields += [("WARC-Payload-Digest", _sha1(payload)), ("Content-Type", "application/http; msgtype=response"),
               ("Content-Length", str(len(block)))]
    head = b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary from a few pages; too few to train on serve as its plain content."""
    samples = [x[:32768] for x in samples if x]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def frames(data: memoryview) -> Iterator[tuple[int, bytes]]:
    """(position, content) of every frame after the dictionary's; raises WarcError on a broken archive."""
    if len(data) < 8:
        raise WarcError("no leading dictionary frame")
    magic, size = struct.unpack("<II", data[:8])
    if magic != DICTIONARY_MAGIC or 8 + size > len(data):
        raise WarcError("no leading dictionary frame, or a cut one")
    raw = bytes(data[8: 8 + size])
    if size >= 4 and struct.unpack("<I", raw[:4])[0] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    at = 8 + size
    while at < len(data):
        begin, parts, frame = at, [], reader.decompressobj()
        try:
            while not frame.eof:
                if at >= len(data):
                    raise WarcError(f"frame at {begin} is cut off")
                piece = data[at: at + STEP]
                parts.append(frame.decompress(piece))
                at += len(piece)
        except zstandard.ZstdError as broken:
            raise WarcError(f"frame at {begin}: {broken}") from None
        at -= len(frame.unused_data)
        yield begin, b"".join(parts)


def parse(raw: bytes, at: int = 0) -> dict:
    """A record's fields; checks version, required headers, lengths, and a response's payload digest."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or lines[0] != VERSION.decode():
        raise WarcError(f"record at {at}: not a {VERSION.decode()} record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"record at {at}: broken header {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"record at {at}: no {name}")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) + 4 != len(rest) \
            or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"record at {at}: its length is not what its header says")
    kind, block = fields["warc-type"], rest[:-4]
    out = {"record_type": kind, "record_id": fields["warc-record-id"], "refers_to_id": fields.get("warc-refers-to"),
           "target": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest"),
           "payload_bytes": None, "payload": None}
    if kind not in ("response", "revisit"):
        return out
    http, gap, body = block.partition(b"\r\n\r\n")
    sizes = [int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not gap or len(sizes) != 1:
        raise WarcError(f"record at {at}: no HTTP head with one length")
    out["payload_bytes"] = sizes[0]
    if kind == "revisit":
        if body or not out["refers_to_id"] or not out["payload_digest"]:
            raise WarcError(f"record at {at}: a revisit needs its response, a digest and no payload")
        return out
    if len(body) != sizes[0] or (out["payload_digest"] or "").startswith("sha1:") and _sha1(body) != out["payload_digest"]:
        raise WarcError(f"record at {at}: the payload is not what its headers say")
    out["payload"] = body
    return out


def _write(folder: str, dictionary: bytes, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        part, number, done = TaskContext.get().partitionId(), 0, []
        writer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)
                                          if dictionary else None)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        held, size = [lead], 0

        def close():
            # a repeated task writes the same bytes under the same name
            name = f"{root}/{part:06d}-{number:06d}.warc.zst"
            own = f"{root}/.{uuid.uuid4().hex}"
            with files.open_output_stream(own) as out:
                out.write(b"".join(held))
            files.move(own, name)
            done.append((name, len(held) - 1, sum(map(len, held))))

        files.create_dir(root, recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                held.append(writer.compress(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["refers_to"])))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    close()
                    number, held, size = number + 1, [lead], 0
        if len(held) > 1:
            close()
        if done:
            names, counts, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
                                             ["archive", "records", "bytes"])

    return run, "archive string, records long, bytes long"


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def write_archives(pages: DataFrame, folder: str, least: int = 1000, level: int = 3) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) under ``folder``; returns (archive, records, bytes).

    The payload is the html in UTF-8, empty for a null. Of the rows whose
    payloads are equal and at least ``least`` bytes long, those with the largest page_id
    are responses, all others revisits of it, those with a null page_id too;
    where every page_id is null, and for shorter payloads, all are responses. Extra columns are ignored;
    an empty table writes nothing.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    keyed = rows.withColumn("_d", F.when(F.octet_length("html") >= least, F.sha2(F.col("html").cast("binary"), 256)))
    leaders = write_state(keyed.where("_d is not null").groupBy("_d").agg(
        F.count("*").alias("_n"), F.max("page_id").alias("_first")).where("_n > 1").drop("_n"), "leaders")
    roles = keyed.join(leaders, "_d", "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))
    sample = [bytes(r["html"], "utf-8") for r in rows.select("html").where("html <> ''").limit(DICTIONARY_SAMPLE).collect()]
    run, schema = _write(_uri(folder), train(sample), level)
    return write_state(roles.sortWithinPartitions("page_id", "url", "html").mapInArrow(run, schema), "archives")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["archive", "position", "record_type", "record_id", "refers_to_id", "target", "payload_digest",
             "payload_bytes", "payload"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"]):
            rows, size = [], 0
            for at, raw in frames(memoryview(content.as_buffer())):
                rows.append({"archive": path, "position": at} | parse(raw, at))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, kinds))))
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, kinds))))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the *.warc.zst archives in ``folder``: RECORDS. A broken archive raises WarcError."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", "content").mapInArrow(_read, RECORDS)


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of ``pages``, written to archives and read back."""
    folder = shared_path(spark, "archives")
    if write_archives(read(spark, sf_dir, "pages"), folder).isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                         "refers_to long")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, ':(-?[0-9]+)>', 1) AS bigint)")
    digest = F.coalesce(F.sha1("payload"), F.substring_index("payload_digest", ":", -1))
    return read_archives(spark, folder).select(
        number("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        digest.alias("payload_digest"), "record_type", number("refers_to_id").alias("refers_to"))
