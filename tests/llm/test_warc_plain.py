"""Plain archives: long headers and sha1 digests."""

import base64
import hashlib
import io

from cohortloom.llm import warc


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at:at + n]


def record(block, digest, url="u"):
    return (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {url}\r\nWARC-Block-Digest: {digest}\r\n"
            f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def kinds(data):
    return [x[0] for x in warc.salvage_archive(Source(data))]


def test_headers_longer_than_the_first_read():
    digest = "sha256:" + hashlib.sha256(b"page").hexdigest()
    assert kinds(record(b"page", digest, "x" * 300_000) + record(b"page", digest)) == ["record", "record"]


def test_sha1_digests_are_checked():
    for form in (hashlib.sha1(b"page").hexdigest(), base64.b32encode(hashlib.sha1(b"page").digest()).decode()):
        assert kinds(record(b"page", f"sha1:{form}")) == ["record"]
        assert "record" not in kinds(record(b"pagf", f"sha1:{form}"))
