"""WARC archives whose records are Zstandard frames that share one embedded dictionary.

Layout of a file: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one frame a
record; zero-length skippable frames stand between frames. Record bytes go through Spark's text writer,
whose line separator is such an empty frame, so files are committed by Spark's own protocol to any file
system that Spark can write, and a lost task leaves nothing behind.

Equal payloads of at least ``min_revisit_bytes`` bytes are stored once, in the record of the largest
page_id; the others become revisit records that name it. Only (page_id, digest, length) is grouped;
payloads move at most once.

Defined cases: null html is an empty payload; a null page_id is written without identifier and read
back as null, and is never the one that others refer to; rows that repeat the page_id and payload of a
response are responses too; an empty table gives archives without records; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.shared import new_path

DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame: magic 0x184D2A50, length 0. All its bytes are ASCII.
FILLER = "P*M\x18\0\0\0\0"
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 1 << 16, 1 << 16
LEVEL = 6
FEED = 1 << 14
#: Records in a file: binaryFile reads files of 2 GB at most, and one task reads a file.
FILE_RECORDS = 4096


def record_bytes(page_id, url: str | None, payload: bytes, n: int, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit has an empty block; its headers keep the full payload's size and digest."""
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        head += [f"WARC-Record-ID: <urn:page:{page_id}>"]
    head += [f"WARC-Target-URI: {(url or '').encode('unicode_escape').decode()}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {n}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    of = lambda name: fields[name][len("<urn:page:") : -1] if name in fields else None
    out = {"page_id": of("WARC-Record-ID"), "url": fields["WARC-Target-URI"].encode().decode("unicode_escape"), "record_type": fields["WARC-Type"], "refers_to": of("WARC-Refers-To")}
    if out["record_type"] == "response":
        out |= {"payload": block, "payload_bytes": len(block), "payload_digest": hashlib.sha1(block).hexdigest()}
        if out["payload_digest"] != fields["WARC-Payload-Digest"][5:]:
            raise ValueError(f"payload of {out['page_id']} does not match its digest")
    else:
        out |= {"payload": None, "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"][5:]}
    return out


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary of archived records; empty when there is too little to learn from."""
    import zstandard

    total = sum(map(len, samples))
    if len(samples) < 8 or total < 4096:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of one file, found frame by frame; each frame is fed to its reader by ``FEED`` bytes, so what lies behind it is not copied."""
    import zstandard

    view, at, reader = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic, n = struct.unpack_from("<II", data, at) if at + 8 <= len(data) else (0, 0)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC and n:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[at + 8 : at + 8 + n]))
            at += 8 + n
            continue
        one, parts = reader.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(view[at : at + FEED]))
            at += min(FEED, len(data) - at)
        at -= len(one.unused_data)
        yield b"".join(parts)


def plan_records(pages: DataFrame, min_revisit_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, n, digest, refers_to for every row."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select("*", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("digest"))
    keys = rows.where(F.col("n") >= min_revisit_bytes).select("page_id", "n", "digest")
    groups = keys.groupBy("digest", "n").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1 and first_id is not null")
    revisits = keys.join(groups, ["digest", "n"]).where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    revisits = revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first_id").alias("refers_to")).distinct()
    # page_id is (nearly) unique, so this join has no hot key however large a group of copies is
    return rows.join(revisits, rows.page_id.eqNullSafe(revisits.p) & (rows.digest == revisits.d), "left").select("page_id", "url", "payload", "n", "digest", "refers_to")


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 1000, sample_records: int = SAMPLE_RECORDS) -> None:
    """Write ``pages`` (page_id, url, html) below ``path``: archives of ``FILE_RECORDS`` records at most, each with the dictionary.

    The dictionary is built from records chosen by hash, cut in the plan, so no long text reaches the driver.
    """
    n = pages.select("page_id").count()
    near = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < F.lit(int(min(1.0, 4 * sample_records / max(1, n)) * (1 << 30)))
    head = F.substring(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 1, SAMPLE_BYTES)
    sample = pages.where(near).select("page_id", "url", head.alias("head")).orderBy(F.xxhash64("page_id", "url"), "page_id").limit(sample_records).collect()
    cut = lambda r: record_bytes(r[0], r[1], bytes(r[2]), len(r[2]), hashlib.sha1(r[2]).hexdigest(), None)
    dictionary = train_dictionary([cut(r) for r in sample])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        zip_ = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        written = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                cols = [c.to_pylist() for c in batch.slice(at, 64).columns]
                frames = []
                for row in zip(*cols):
                    if written % FILE_RECORDS == 0:
                        # the first row of every file, since a file holds FILE_RECORDS records and this
                        frames.append(dictionary_frame(dictionary))
                    frames.append(zip_.compress(record_bytes(*row)))
                    written += 1
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    frames = plan_records(pages, min_revisit_bytes).mapInArrow(pack, "frame binary")
    out = frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", FILLER).option("compression", "none")
    out.option("maxRecordsPerFile", FILE_RECORDS + 1).text(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True, id_type: str = "bigint") -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to (and payload, null for revisits)."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payload
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

        for batch in batches:
            for data in batch.column(0):
                rows = []
                for record in read_archive(data.as_py()):
                    rows.append(parse_record(record))
                    if len(rows) == 64:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    schema = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string" + ", payload binary" * payload
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(unpack, schema).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_round_trip(pages: DataFrame, payload: bool = False, path: str | None = None) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path, payload, pages.schema["page_id"].dataType.simpleString())
