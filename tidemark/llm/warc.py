"""WARC archives: writing, normalising monolithic gzip, and reading by a sidecar offset index.

A whole archive compressed as one gzip stream can't be read from the middle. The normaliser inflates such a stream
once, front to back, and rewrites each record as a gzip member of its own; the index beside it has each member's
offset and length, with which any record is read alone.

Archives are rows (archive, content): what ``binaryFile`` gives for files in any store Spark reads, and what Spark's
own committer writes, so a lost executor leaves no half archive behind. Normalised archives are rows (archive, part,
start, content, index); a part ends between records at about ``PART`` bytes, so memory is bounded by one record and one
part. ``index`` is a column of its own: reading it alone doesn't touch the contents.

Payloads that repeat are written once: of equal payloads of at least ``MIN_REVISIT`` bytes the record with the smallest
page_id is the response, the others revisit it. Only digests and ids are shuffled to find that out, and the digests
found more than once are staged, so that their files' size decides how they are joined.

Defined results: null html is an empty payload; a null page_id never becomes the response that others refer to, unless
all with that payload are null, in which case all are responses; rows that repeat the smallest page_id are all
responses; a url's line breaks are percent-encoded, a null url leaves its header out; other columns are ignored; an
empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import ship, stage

ship(__name__)

MIN_REVISIT = 100
#: Bytes before compression at which an archive, and after it at which a normalised part ends.
ARCHIVE, PART = 8 << 20, 8 << 20
STEP = 1 << 20
DATE = "1970-01-01T00:00:00Z"
#: The WARC 1.1 revisit profile for equal payloads, and the names that page records go by.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:tidemark:page:"
ARCHIVES = "archive string, content binary"
NORMALISED = "archive string, part int, start long, content binary, index array<struct<record_id: string, type: string, offset: long, length: long>>"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def planned(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, record_type and refers_to of each row of ``pages``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    page = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    long_enough = page.where(F.octet_length("html") >= least).select("digest", "page_id")
    again = long_enough.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    out = page.join(stage(again.drop("n"), "warc-repeats"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{page_id}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}"] if url is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}"]
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"] if kind == "revisit" else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _row(values: list, schema: str) -> pa.RecordBatch:
    kinds = {ARCHIVES: _ARCHIVES_ARROW, NORMALISED: _NORMALISED_ARROW, RECORDS: _RECORDS_ARROW}[schema]
    return pa.RecordBatch.from_pylist(values, schema=kinds)


_INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
_ARCHIVES_ARROW = pa.schema([("archive", pa.string()), ("content", pa.binary())])
_NORMALISED_ARROW = pa.schema([("archive", pa.string()), ("part", pa.int32()), ("start", pa.int64()), ("content", pa.binary()), ("index", _INDEX)])
_RECORDS_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def _write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made, held, out, gzip = 0, 0, [], None
    name = f"part-{TaskContext.get().partitionId():06d}"

    def close() -> pa.RecordBatch:
        return _row([{"archive": f"{name}-{made:05d}.warc.gz", "content": b"".join([*out, gzip.flush()])}], ARCHIVES)

    for batch in batches:
        for i in range(batch.num_rows):
            page_id, url, html, digest, kind, refers_to = (c[i].as_py() for c in batch.columns)
            gzip = gzip or zlib.compressobj(6, wbits=31)
            whole = record(page_id, url, html.encode("utf-8"), digest, kind, refers_to)
            out.append(gzip.compress(whole))
            held += len(whole)
            if held >= ARCHIVE:
                yield close()
                made, held, out, gzip = made + 1, 0, [], None
    if gzip:
        yield close()


def write_archives(plan: DataFrame) -> DataFrame:
    """Archives of one gzip stream each, from what ``planned`` gives."""
    return plan.select("page_id", "url", "html", "digest", "record_type", "refers_to").mapInArrow(_write, ARCHIVES)


def records_in(content: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and all bytes of each record of a gzip stream of one or more members."""
    held, at, gzip, view = bytearray(), 0, zlib.decompressobj(31), memoryview(content)
    need = 0

    def ready() -> tuple[dict[str, str], bytes] | None:
        nonlocal need
        if len(held) < need or (end := held.find(b"\r\n\r\n")) < 0:
            return None
        head = bytes(held[:end]).decode("utf-8").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        need = end + 8 + int(headers["content-length"])
        if len(held) < need:
            return None
        found = headers, bytes(held[:need])
        if not head[0].startswith("WARC/") or found[1][-4:] != b"\r\n\r\n":
            raise ValueError(f"no WARC record: {head[0][:80]!r}")
        del held[:need]
        need = 0
        return found

    while at < len(view):
        data = view[at : at + STEP]
        at += len(data)
        while data:
            held += gzip.decompress(data, STEP)
            rest = gzip.unconsumed_tail
            if gzip.eof:
                rest, gzip = gzip.unused_data, zlib.decompressobj(31)
            while (found := ready()) is not None:
                yield found
            data = rest
    held += gzip.flush()
    while (found := ready()) is not None:
        yield found
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def _normalise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            name, part, start, out, index = batch.column(0)[i].as_py(), 0, 0, bytearray(), []
            for headers, whole in records_in(batch.column(1)[i].as_buffer()):
                gzip = zlib.compressobj(6, wbits=31)
                member = gzip.compress(whole) + gzip.flush()
                index.append({"record_id": headers["warc-record-id"], "type": headers["warc-type"], "offset": start + len(out), "length": len(member)})
                out += member
                if len(out) >= PART:
                    yield _row([{"archive": name, "part": part, "start": start, "content": bytes(out), "index": index}], NORMALISED)
                    part, start, out, index = part + 1, start + len(out), bytearray(), []
            if index or not part:
                yield _row([{"archive": name, "part": part, "start": start, "content": bytes(out), "index": index}], NORMALISED)


def normalise(archives: DataFrame) -> DataFrame:
    """Archives (archive, content) with each record as its own member, and the index of members."""
    return archives.select("archive", "content").mapInArrow(_normalise, NORMALISED)


def _checked(named: str, payload: bytes) -> bool | None:
    """Whether a digest header (algorithm:value, in hex or base 32) is the payload's; None if the algorithm isn't known."""
    algorithm, _, value = named.partition(":")
    if algorithm.lower().replace("-", "") not in ("sha1", "sha256", "md5"):
        return None
    digest = hashlib.new(algorithm.lower().replace("-", ""), payload).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def read_member(member: bytes | memoryview) -> dict:
    """One record from its member alone.

    A payload is what follows the HTTP headers of a response or request, and the whole block of other records. Its digest
    and length are those of the payload as read; a revisit, which has none, has those that its headers name, if they do.
    Records by other writers have no page_id.
    """
    ((headers, whole),) = records_in(member)
    block = whole[whole.index(b"\r\n\r\n") + 4 : -4]
    kind, named = headers["warc-type"], headers.get("warc-payload-digest", "")
    http, _, payload = block.partition(b"\r\n\r\n") if headers.get("content-type", "").startswith("application/http") else (b"", b"", block)
    stated = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length" and v.strip().isdigit()), None)
    own = headers["warc-record-id"].startswith(f"<{URN}")
    if kind == "response" and ((own and len(payload) != stated) or _checked(named, payload) is False):
        raise ValueError(f"payload of {headers['warc-record-id']} is not what its headers say")
    urn = lambda name: (n if (n := headers.get(name, "").strip("<>")).startswith(URN) else "").removeprefix(URN)
    number = lambda name: int(n) if (n := urn(name)).lstrip("-").isdigit() else None
    told = named.removeprefix("sha256:") if named.startswith("sha256:") else None
    length, digest = (stated, told) if kind == "revisit" else (len(payload), hashlib.sha256(payload).hexdigest())
    return {"page_id": number("warc-record-id"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to"), "url": headers.get("warc-target-uri")}


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            start, content = batch.column(0)[i].as_py(), memoryview(batch.column(1)[i].as_buffer())
            at = [(x["offset"] - start, x["length"]) for x in batch.column(2)[i].as_py()]
            for j in range(0, len(at), 1000):
                yield _row([read_member(content[a : a + n]) for a, n in at[j : j + 1000]], RECORDS)


def read_records(normalised: DataFrame) -> DataFrame:
    """Every record, each read from its own member by the index."""
    return normalised.select("start", "content", "index").mapInArrow(_read, RECORDS)


def save(normalised: DataFrame, folder: str) -> DataFrame:
    """Each part as a file of its own in ``folder`` (a URI that driver and executors share), with its index beside it.

    Returns file and records of each. ``x.warc.gz`` is a whole archive of single members; ``x.warc.gz.index.jsonl`` has a
    line a record, with its member's offset in that file and its length. Files are written aside and moved, so a task that
    runs again writes the same ones anew.
    """
    from pyspark.sql.types import StructType

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                system, root = pa_fs.FileSystem.from_uri(folder)
                system.create_dir(root, recursive=True)
                name = f"{row['archive'].rsplit('/', 1)[-1].removesuffix('.gz').removesuffix('.warc')}-{row['part']:05d}.warc.gz"
                lines = "".join(json.dumps({**x, "offset": x["offset"] - row["start"]}) + "\n" for x in row["index"])
                for path, data in ((f"{root}/{name}", row["content"]), (f"{root}/{name}.index.jsonl", lines.encode())):
                    aside = f"{path}.{uuid.uuid4().hex}.tmp"
                    with system.open_output_stream(aside) as out:
                        out.write(data)
                    system.move(aside, path)
                done.append({"file": name, "records": len(row["index"])})
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("records", pa.int64())]))

    return stage(normalised.mapInArrow(write, StructType.fromDDL("file string, records long")), "warc-files")


def opened(spark: SparkSession, folder: str) -> DataFrame:
    """Saved archives with their indexes, as ``normalise`` gives them: whatever lies in ``folder`` as files of both kinds."""
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    entry = "record_id string, type string, offset long, length long"
    lines = spark.read.schema(entry).option("pathGlobFilter", "*.index.jsonl").json(folder).withColumn("archive", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.index\.jsonl$", ""))
    index = lines.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("offset", "record_id", "type", "length"))).alias("x"))
    index = index.select("archive", F.transform("x", lambda e: F.struct(e["record_id"].alias("record_id"), e["type"].alias("type"), e["offset"].alias("offset"), e["length"].alias("length"))).alias("index"))
    return content.join(index, "archive").select("archive", F.lit(0).alias("part"), F.lit(0).cast("long").alias("start"), "content", "index")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as monolithic archives, normalised, and read back."""
    archives = stage(write_archives(planned(pages)), "warc-archives")
    return read_records(stage(normalise(archives), "warc-normalised"))
