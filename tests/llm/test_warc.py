"""Archives: a round trip, and salvage of damaged ones."""

import gzip
import hashlib
import random

import numpy as np
import pytest

from cohortloom.llm import warc

PAGES = "page_id long, url string, html string, payload string, refers_to long"


class Source:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at:at + n]


def expected(rows):
    groups = {}
    for i, _, html in rows:
        payload = (html or "").encode()
        groups.setdefault(payload, []).append(i)
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        known = [x for x in groups[payload] if x is not None]
        first = min(known) if known and len(payload) >= 100 else None
        refers = first if first is not None and (i is None or i > first) else None
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, compress):
    big = "<p>é</p>" * 40
    rows = [(5, "http://a/b c\r\nX: y", big), (2, None, big), (9, "u", big), (None, "n", big), (2, "again", big),
            (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "z" * 300_000),
            (10, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)
    archives = warc.write_archives(warc.mark_revisits(pages), compress=compress, archive_bytes=2000)
    read = warc.read_archives(archives)
    assert read.filter("kind = 'gap'").count() == 0
    got = sorted((tuple(r) for r in warc.page_rows(read).collect()), key=str)
    assert got == expected(rows)
    kept = {r.record_id: bytes(r.payload) for r in read.filter("record_type = 'response'").collect()}
    assert kept["<urn:page:8>"] == b"z" * 300_000
    empty = warc.read_archives(warc.write_archives(warc.mark_revisits(pages.limit(0))))
    assert empty.collect() == []


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_finds_all_sound_records(compress):
    rng = random.Random(5)
    for trial in range(150):
        records = [warc.record_bytes(i, f"http://x/{i}", bytes(rng.choice(b"abWARC/1.\r\n\x1f\x8b\x08") for _ in range(rng.randint(0, 300))),
                                     "d", None if i % 3 else 1) for i in range(12)]
        records = [gzip.compress(r) for r in records] if compress else records
        at = np.cumsum([0, *map(len, records)]).tolist()
        bad, data = rng.sample(range(12), 3), bytearray(b"".join(records))
        for k in bad:
            for _ in range(5):
                data[rng.randrange(at[k], at[k + 1] - 6)] ^= rng.randint(1, 255)
        short = rng.randint(1, 30) if trial % 2 else 0
        data = bytes(data[:len(data) - short])
        found = list(warc.salvage_archive(Source(data)))
        assert [f[1] for f in found] == np.cumsum([0, *(f[2] for f in found)])[:-1].tolist()
        assert sum(f[2] for f in found) == len(data)
        sound = {f[1] for f in found if f[0] == "record"}
        assert {at[k] for k in range(12) if k not in bad and not (k == 11 and short)} <= sound
        assert all(any(at[k] <= x < at[k + 1] for k in bad) for x in sound - set(at))


def test_gaps_are_logged_with_a_reason():
    good = warc.record_bytes(1, "u", b"x" * 200, "d", None)
    found = list(warc.salvage_archive(Source(good[:-300] + good + b"tail")))
    assert [(f[0], f[1], f[2]) for f in found] == [("gap", 0, len(good) - 300), ("record", len(good) - 300, len(good)),
                                                   ("gap", 2 * len(good) - 300, 4)]
    assert found[0][3] and list(warc.salvage_archive(Source(b""))) == []


def test_one_payload_on_a_third_of_the_pages_is_split(spark):
    """The rows of a hot digest are dealt to several tasks, and every record is right."""
    import random

    rng = random.Random(12)
    noise = lambda n: "".join(chr(rng.randrange(33, 1000)) for _ in range(n))
    hot = noise(1500)
    pages = [(i, f"http://x/{i}", hot if i % 3 == 0 else noise(600)) for i in range(3000)]
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
                "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        marked = warc.mark_revisits(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4))
        got = {r.page_id: r.refers_to for r in marked.select("page_id", "refers_to", "payload").collect()}
        assert got == {i: 0 if i % 3 == 0 and i else None for i, *_ in pages}
        fresh = marked.select("page_id", "payload", "refers_to")
        fresh.collect()
        assert "skew=true" in fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
