"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The reader takes compressed archives (one gzip member per record) and plain ones. Each record is
checked: the member's own checksum, the version line, the headers, the block length, the closing
blank lines and the block digest. After a failed check it searches byte by byte for the next
member or version line that passes all checks, and reports the bytes between as a gap."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import new_folder, open_folder
from cohortloom.session import materialise

DEDUP_BYTES = 100
ARCHIVE_BYTES = 256 << 20
SALVAGED = """kind string, file string, offset long, length long, reason string, record_type string, record_id string,
target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"""
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
VERSION_LINE = rb"WARC/1\.\d+\r?\n"


def mark_revisits(pages: DataFrame, least: int = DEDUP_BYTES) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to (null for responses).

    Among rows with equal payloads of at least `least` bytes those with the smallest page_id are
    responses (repeated rows of that id all are), the others refer to it. A null page_id counts as
    larger than any; a group of null ids only has responses. Null html is an empty payload. Very long
    pages are rows like any other; extra columns are left behind; an empty table gives no row.

    The repeated digests are stored first, so that adaptive execution can split the join where one
    payload makes up a large share of the pages."""
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    groups = materialise(rows.filter(F.octet_length("payload") >= least).groupBy("payload_digest")
                         .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"), "digests")
    return (rows.join(groups, "payload_digest", "left")
            .withColumn("refers_to", F.expr("case when page_id is null or page_id > first_id then first_id end"))
            .drop("first_id"))


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit keeps only the HTTP header of its payload."""
    import hashlib

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
             "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"


def write_archives(marked: DataFrame, folder: str | None = None, compress: bool = True,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of `mark_revisits`, a record each; returns the stored list of archives
    (folder, file, n_records). A task begins a new archive after `archive_bytes`. Only archives in
    the list count, so a repeated task does no harm."""
    folder = folder or new_folder(marked.sparkSession, "warc")

    def write(batches):
        import zlib

        import pyarrow as pa

        fs = sink = None
        written = records = 0
        for batch in batches:
            for r in batch.to_pylist():
                if sink is None:
                    fs, root = open_folder(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc" + ".gz" * compress
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                    written = records = 0
                raw = record_bytes(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["refers_to"])
                if compress:
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = packer.compress(raw) + packer.flush()
                sink.write(raw)
                written, records = written + len(raw), records + 1
                if written >= archive_bytes:
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [records]})
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [records]})

    columns = marked.select("page_id", "url", "payload", "payload_digest", "refers_to")
    written = materialise(columns.mapInArrow(write, "file string, n_records long"), "warc-list")
    return written.withColumn("folder", F.lit(folder))


class Archive:
    """Random access to an archive through one read-ahead block."""

    def __init__(self, source, block: int = 4 << 20):
        self.source, self.size, self.block = source, source.size(), block
        self.at, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.source.read_at(min(max(n, self.block), self.size - at), at)
        return self.held[at - self.at: at - self.at + n]


def parse_headers(head: bytes) -> dict[str, str] | None:
    lines = head.decode("utf-8", "replace").split("\n")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.rstrip("\r").partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    return fields if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def block_fits(fields: dict[str, str], block: bytes) -> bool:
    """Whether the block digest, where it is of a kind known here, is right."""
    import base64
    import hashlib

    kind, _, want = fields.get("warc-block-digest", "").partition(":")
    if kind.lower() not in ("sha1", "sha256"):
        return True
    digest = hashlib.new(kind.lower(), block)
    return want.lower() in (digest.hexdigest(), base64.b32encode(digest.digest()).decode().rstrip("=").lower(),
                            base64.b32encode(digest.digest()).decode().lower())


def member_at(archive: Archive, at: int):
    """(length, headers, block) of a gzip member that holds one sound record, else the reason."""
    import zlib

    unpack = zlib.decompressobj(31)
    parts, pos = [], at
    try:
        while not unpack.eof:
            chunk = archive.read(pos, 1 << 16)
            if not chunk:
                return "member cut short"
            parts.append(unpack.decompress(chunk))
            pos += len(chunk)
            if len(parts) == 1 and not b"WARC/".startswith(parts[0][:5]):
                return "member without a record"
    except zlib.error:
        return "member fails its checksum"
    raw, length = b"".join(parts), pos - len(unpack.unused_data) - at
    start = re.match(VERSION_LINE, raw)
    end = re.search(rb"\r?\n\r?\n", raw)
    if not start or not end:
        return "no version line"
    fields = parse_headers(raw[:end.start()])
    if fields is None:
        return "bad headers"
    block = raw[end.end(): end.end() + int(fields["content-length"])]
    if len(block) < int(fields["content-length"]) or raw[end.end() + len(block):].strip(b"\r\n"):
        return "bad block length"
    return (length, fields, block) if block_fits(fields, block) else "bad block digest"


def plain_at(archive: Archive, at: int, head_bytes: int = 1 << 16):
    """(length, headers, block) of an uncompressed sound record, else the reason."""
    head = archive.read(at, head_bytes)
    end = re.search(rb"\r?\n\r?\n", head)
    # Headers may be longer; they end before the next version line.
    while not end and b"\n" + VERSION not in head and at + len(head) < archive.size:
        head = archive.read(at, 2 * len(head))
        end = re.search(rb"\r?\n\r?\n", head)
    if not re.match(VERSION_LINE, head) or not end:
        return "no version line"
    fields = parse_headers(head[:end.start()])
    if fields is None:
        return "bad headers"
    n = int(fields["content-length"])
    if at + end.end() + n > archive.size:
        return "record cut short"
    block = archive.read(at + end.end(), n)
    tail = archive.read(at + end.end() + n, 4)
    closing = b"\r\n\r\n" if tail == b"\r\n\r\n" else b"\n\n" if tail[:2] == b"\n\n" else None
    if closing is None:
        return "bad block length"
    return (end.end() + n + len(closing), fields, block) if block_fits(fields, block) else "bad block digest"


def record_at(archive: Archive, at: int):
    start = archive.read(at, len(VERSION))
    if start.startswith(MEMBER):
        return member_at(archive, at)
    return plain_at(archive, at) if start == VERSION else "neither member nor version line"


def next_candidate(archive: Archive, at: int, step: int = 1 << 20) -> int:
    """The next byte at which a member or a version line could begin; the end if there is none."""
    while at < archive.size:
        chunk = archive.read(at, step)
        found = [i for i in (chunk.find(MEMBER), chunk.find(VERSION)) if i >= 0]
        if found:
            return at + min(found)
        at += max(1, len(chunk) - len(VERSION) + 1) if at + len(chunk) < archive.size else len(chunk)
    return archive.size


def salvage_archive(source):
    """("record", offset, length, headers, block) and ("gap", offset, length, reason), in order;
    together they cover every byte of the archive."""
    archive, at = Archive(source), 0
    while at < archive.size:
        found = record_at(archive, at)
        if not isinstance(found, str):
            yield "record", at, *found
            at += found[0]
            continue
        begin, reason = at, found
        while isinstance(found, str) and at < archive.size:
            at = next_candidate(archive, at + 1)
            found = record_at(archive, at) if at < archive.size else found
        yield "gap", begin, at - begin, reason


def split_payload(fields: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """The payload and its full length (for a revisit that of the payload it refers to)."""
    if not fields.get("content-type", "").startswith("application/http"):
        return block, len(block)
    head, _, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?i)\ncontent-length:\s*(\d+)", head)
    revisit = fields["warc-type"] == "revisit"
    return payload, int(stated[1]) if revisit and stated else len(payload)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records and gaps of the archives (folder, file): a row each, `kind` record or gap. A
    payload digest is computed from the payload, for a revisit taken from its header. An empty
    list gives no row; an empty archive neither record nor gap."""

    def load(batches):
        import hashlib

        import pyarrow as pa

        schema = pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary()}.get(c.split()[1], pa.string()))
                            for c in SALVAGED.replace("\n", " ").split(", ")])
        for batch in batches:
            for row in batch.to_pylist():
                fs, root = open_folder(row["folder"])
                out, held = [], 0
                with fs.open_input_file(f"{root}/{row['file']}") as source:
                    for kind, offset, length, *rest in salvage_archive(source):
                        r = {"kind": kind, "file": row["file"], "offset": offset, "length": length}
                        if kind == "gap":
                            r["reason"] = rest[0]
                        else:
                            fields, block = rest
                            payload, full = split_payload(fields, block)
                            stated = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
                            revisit = fields["warc-type"] == "revisit"
                            r |= {"record_type": fields["warc-type"], "record_id": fields.get("warc-record-id"),
                                  "target_uri": fields.get("warc-target-uri"),
                                  "refers_to": fields.get("warc-refers-to"), "payload_bytes": full,
                                  "payload_digest": stated if revisit else hashlib.sha256(payload).hexdigest(),
                                  "payload": payload if with_payload else None}
                            held += len(block)
                        out.append(r)
                        if len(out) >= 2000 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return archives.select("folder", "file").repartition(max(1, archives.count())).mapInArrow(load, SALVAGED)


def page_rows(salvaged: DataFrame) -> DataFrame:
    """Records of pages as written by `write_archives`: the page ids are in the record URIs."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return salvaged.filter("kind = 'record'").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"))
