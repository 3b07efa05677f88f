"""WARC archives compressed record by record with a shared Zstandard dictionary.

A file starts with a skippable frame (magic number 0x184D2A5D) that holds the dictionary, then one Zstandard frame per
record, so that a record can be read alone once the dictionary is known. Equal payloads are stored once: the row with the
largest id is a response, the others are revisit records that name it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shared_table
from tidemark.llm.files import read_mapped, write_stream

#: Fixed values of the archive format.
DICTIONARY_FRAME = 0x184D2A5D
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """`least`: bytes of a payload from which copies become revisits. The dictionary is built from the `samples` records with
    the smallest hash, `sample_bytes` of each at most. `salts`: tasks over which the copies of one payload are spread.
    `read` bytes are taken from a file at a time."""

    least: int = 1000
    samples: int = 400
    sample_bytes: int = 16_384
    dictionary_bytes: int = 65_536
    level: int = 6
    salts: int = 16
    read: int = 1 << 20
    date: str = "2000-01-01T00:00:00Z"


def record_id(page: int | None, digest: str) -> str:
    """A stable name of a record: the same page and payload always have the same one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record. A revisit keeps the response's headers, with the full length, and leaves out the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page, digest),
        "WARC-Date": date,
        "WARC-Target-URI": " ".join((url or "").split()),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Length": str(len(block)),
    }
    if revisit:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "WARC-Refers-To-Page": str(refers_to)}
    if page is not None:
        head["WARC-Page"] = str(page)
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items())
    return WARC_VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a record, checked: a response's payload must have the length and digest that its headers give."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != WARC_VERSION:
        raise ValueError("not a WARC record")
    fields = {k.decode(): v.decode() for k, _, v in (line.partition(b": ") for line in lines)}
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    stated = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload does not match its digest")
    page, refers = fields.get("WARC-Page"), fields.get("WARC-Refers-To-Page")
    return {
        "page_id": None if page is None else int(page), "url": fields["WARC-Target-URI"], "record_type": kind, "payload": payload if kind == "response" else None,
        "payload_bytes": stated, "payload_digest": digest, "refers_to": None if refers is None else int(refers),
    }


def build_dictionary(rows: DataFrame, cfg: Archive = Archive()) -> bytes:
    """A dictionary from a bounded sample of records: `samples` rows by hash, `sample_bytes` of each."""
    picked = rows.select(F.xxhash64("id", "payload").alias("h"), F.substring("payload", 1, cfg.sample_bytes).alias("piece"), "id", "url").orderBy("h", "id").limit(cfg.samples).collect()
    samples = [record(r["id"], r["url"], bytes(r["piece"]), "0" * 40, None, cfg.date) for r in picked]
    try:
        return zstandard.train_dictionary(cfg.dictionary_bytes, samples, level=cfg.level).as_bytes()
    except zstandard.ZstdError:  # too few records for the builder: use them as they are
        return b"".join(samples)[: cfg.dictionary_bytes] or WARC_VERSION


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT)


def mark_revisits(pages: DataFrame, id_column: str = "page_id", payload_column: str = "html", url_column: str = "url", cfg: Archive = Archive()) -> DataFrame:
    """(id, url, payload, digest, refers_to): which rows repeat a payload of at least `least` bytes, and of which row.

    Only payloads that occur more than once take part in the join, and their copies are spread over `salts` keys.
    """
    source = pages.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        (F.col(f"`{url_column}`").cast("string") if url_column in pages.columns else F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col(f"`{payload_column}`").cast("string"), F.lit("")), "utf-8").alias("payload"),
    )
    hashed = source.withColumn("digest", F.sha1("payload"))
    long_ones = hashed.where(F.octet_length("payload") >= cfg.least)
    several = long_ones.groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "last")
    several = shared_table(several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(cfg.salts - 1)))), "warc-repeats")
    salted = hashed.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(cfg.salts)).cast("int"))
    joined = salted.join(several, ["digest", "salt"], "left")
    last = F.when((F.octet_length("payload") >= cfg.least) & ~F.col("id").eqNullSafe(F.col("last")), F.col("last"))
    return joined.select("id", "url", "payload", "digest", last.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", payload_column: str = "html", url_column: str = "url", cfg: Archive = Archive()) -> DataFrame:
    """Write archives, one per task, and return (file, records, bytes) of each.

    Null payloads are empty. Of equal payloads of at least `least` bytes, rows with the largest id are responses and the others
    revisits; rows that repeat that id are all responses, and where all ids are null, all rows are. Smaller payloads are all
    responses. An empty table gives no file. File names carry a mark of the attempt, so a task that is run again does not meet
    its first try, and only the files listed belong to the archive.
    """
    rows = mark_revisits(pages, id_column, payload_column, url_column, cfg)
    content = build_dictionary(rows.select("id", "url", "payload"), cfg)

    def run(batches):
        name = f"{folder}/records-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.zst"
        words, out, count = _dictionary(content), None, 0
        compressor = zstandard.ZstdCompressor(level=cfg.level, dict_data=words, write_checksum=True)
        for batch in batches:
            for i in range(len(batch)):
                page, url, payload, digest, refers = (batch.column(c)[i].as_py() for c in range(5))
                if out is None:
                    out = write_stream(name)
                    out.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
                out.write(compressor.compress(record(page, url, payload, digest, refers, cfg.date)))
                count += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [count], "bytes": [size]})

    return shared_table(rows.mapInArrow(run, "file string, records long, bytes long"), "warc-files")


def read_records(name: str, step: int = 1 << 20):
    """Parsed records of one archive, one at a time."""
    with read_mapped(name) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError("the archive has no dictionary")
        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(source.read(size)))
        rest = b""
        frame, parts = reader.decompressobj(), []
        while True:
            data = rest or source.read(step)
            if not data:
                break
            parts.append(frame.decompress(data))
            rest = b""
            if frame.eof:
                rest = frame.unused_data
                yield parse_record(b"".join(parts))
                frame, parts = reader.decompressobj(), []
        if any(parts):
            raise ValueError("the archive ends inside a record")


def read_archives(spark: SparkSession, files: DataFrame, payloads: bool = False) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to and, if wanted, payload) of every record of the listed archives."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    fields += [("payload", pa.binary())] if payloads else []
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in read_records(name):
                    rows.append({k: row[k] for k, _ in fields})
                    held += row["payload_bytes"] if payloads else 200
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    return files.select("file").repartition(max(files.count(), 1)).mapInArrow(run, schema)
