"""WARC archives: a monolithic gzip stream is inflated once, every record is rewritten as a member of its own, and a sidecar
index of offsets is written next to it.

Of records with equal payloads of at least MIN_BYTES the smallest page_id is the response, the others are revisits. Null html is
an empty payload. Rows that repeat a page_id are records each; a row equal in id and payload to the response is a response too.
An empty table gives no archive. Archives are bounded: each task closes one after ARCHIVE_BYTES.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import materialise, salted_left_join, shared_dir

MIN_BYTES = 100
ARCHIVE_BYTES = 64 << 20
READ = 1 << 20
ROWS = 2000


def decided(pages: DataFrame) -> DataFrame:
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    firsts = p.where(F.col("size") >= MIN_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = salted_left_join(p, firsts, ["digest"], F.col("page_id"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes):
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return fields, rest[: int(fields["Content-Length"])]


def store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _uri(path: str) -> str:
    return "file:///" + path[5:].lstrip("/") if path.startswith("file:") else path


def write_monolithic(pages: DataFrame, root: str) -> DataFrame:
    """One gzip stream per archive, all records inside; returns the archives' names."""

    def run(batches):
        files, base = store(root)
        files.create_dir(base, recursive=True)
        out, pack, size, name = None, None, 0, None
        for b in batches:
            for r in b.itertuples(index=False):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, pack, size = files.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0
                data = record(r.page_id, r.url, r.payload, r.digest, r.size, r.refers_to)
                out.write(pack.compress(data))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    out.write(pack.flush())
                    out.close()
                    out = None
                    yield pd.DataFrame({"name": [name]})
        if out is not None:
            out.write(pack.flush())
            out.close()
            yield pd.DataFrame({"name": [name]})

    # Ids travel as text: pandas would turn a nullable long into a float.
    ids = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]
    return materialise(pages.select(ids[0], "url", "payload", "digest", "size", ids[1]).mapInPandas(run, "name string"))


def records(stream):
    """The records of an inflated stream, one at a time; `stream` yields blocks of bytes."""
    buf = bytearray()
    for block in stream:
        buf += block
        while (end := buf.find(b"\r\n\r\n")) >= 0:
            head = bytes(buf[:end])
            n = int(head.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
            stop = end + 4 + n + 4
            if len(buf) < stop:
                break
            yield bytes(buf[:stop])
            del buf[:stop]
    if buf:
        raise ValueError("the archive ends within a record")


def inflate(source):
    """Blocks of an inflated stream; gzip members that follow one another are one stream."""
    pack, fresh = zlib.decompressobj(31), True
    while block := source.read(READ):
        while block:
            yield pack.decompress(block)
            fresh, block = False, pack.unused_data
            if pack.eof:
                pack, fresh = zlib.decompressobj(31), True
    if not fresh:
        raise ValueError("the archive ends within a gzip member")


def normalise(names: DataFrame, root: str) -> DataFrame:
    """Rewrite each archive with a member per record, and its sidecar of offsets and lengths; returns the new names and their records."""

    def run(batches):
        files, base = store(root)
        for b in batches:
            for name in b["name"]:
                at, rows, fresh = 0, [], f"{uuid.uuid4().hex}.norm.warc.gz"
                with files.open_input_stream(f"{base}/{name}", compression=None) as src, files.open_output_stream(f"{base}/{fresh}", compression=None) as dst:
                    for data in records(inflate(src)):
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = pack.compress(data) + pack.flush()
                        dst.write(member)
                        rows.append((at, len(member)))
                        at += len(member)
                with files.open_output_stream(f"{base}/{fresh}.idx") as side:
                    side.write("\n".join(json.dumps(r) for r in rows).encode())
                yield pd.DataFrame({"name": [fresh], "records": [len(rows)]})

    return materialise(names.repartition(names.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "name string, records long"))


def sidecar(files, path: str) -> list[tuple[int, int]]:
    """Offset and length of each record of an archive."""
    with files.open_input_stream(f"{path}.idx", compression=None) as side:
        return [tuple(json.loads(line)) for line in side.read().decode().split("\n") if line]


def read_members(names: DataFrame, root: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, found through the archives' sidecars."""

    def number(field):
        return (field or "").removeprefix("<urn:page:").removesuffix(">") or None

    def run(batches):
        files, base = store(root)
        for b in batches:
            for name in b["name"]:
                places = sidecar(files, f"{base}/{name}")
                with files.open_input_file(f"{base}/{name}") as f:
                    for lo in range(0, len(places), ROWS):
                        rows = []
                        for o, n in places[lo : lo + ROWS]:
                            fields, payload = parse(zlib.decompress(f.read_at(n, o), 31))
                            digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                            if fields["WARC-Type"] == "response":
                                digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                            rows.append((number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To"))))
                        yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    back = names.select("name").mapInPandas(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return back.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    root = _uri(shared_dir(pages.sparkSession))
    names = write_monolithic(decided(pages), root)
    return read_members(normalise(names, root), root)
