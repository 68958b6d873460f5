"""Token ids in shard files with Elias-Fano document boundaries.

A shard holds the ids of consecutive documents back to back, then two Elias-Fano sequences (the
running end offsets and the document ids) and a fixed footer. An Elias-Fano sequence of n
non-decreasing values up to u takes n * (2 + log2(u / n)) bits: the low bits of every value are
packed, the high bits are a bit vector in which value i sets bit (high + i). `select` finds the
i-th set bit from sampled positions, so no table of 64-bit offsets is stored.

Files get unique names and count only when their row is in the manifest, so a repeated or
speculative task leaves at most an unused file behind."""

from __future__ import annotations

import struct
import uuid

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import TextEncoder, new_folder, open_folder
from cohortloom.session import materialise

MAGIC = b"EFSHARD1"
FOOTER = "<QQQqQQB8s"  # documents, null ids, id count, first doc id, two section sizes, width, magic
SAMPLE = 256  # a sampled position for every so many set bits
MANIFEST = "shard int, file string, n_docs long, n_ids long"


def ef_encode(values: np.ndarray) -> bytes:
    """Non-decreasing unsigned values as an Elias-Fano sequence."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return struct.pack("<QBQ", 0, 0, 0)
    low_bits = max(0, int(values[-1]) // n).bit_length() - 1 if int(values[-1]) // n else 0
    high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1, dtype=np.uint8)
    bits[high] = 1
    low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(low.ravel(), bitorder="little").tobytes()
    return b"".join([struct.pack("<QBQ", n, low_bits, len(bits)), high[::SAMPLE].astype("<u4").tobytes(), packed,
                     np.packbits(bits, bitorder="little").tobytes()])


class EliasFano:
    """Select over an encoded sequence."""

    def __init__(self, data: bytes):
        self.n, self.low_bits, self.n_bits = struct.unpack_from("<QBQ", data)
        at = struct.calcsize("<QBQ")
        samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", samples, at)
        at += 4 * samples
        n_low = -(-self.n * self.low_bits // 8)
        self.low = np.frombuffer(data, np.uint8, n_low, at)
        self.high = np.frombuffer(data, np.uint8, -(-self.n_bits // 8), at + n_low)

    def values(self, start: int, stop: int) -> np.ndarray:
        """Values start..stop-1; reads only the bits between the samples around them."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        first = start // SAMPLE
        last = -(-stop // SAMPLE)
        begin = int(self.samples[first]) // 8
        end = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + 8 * begin
        ones = ones[ones >= self.samples[first]][start - first * SAMPLE: stop - first * SAMPLE]
        high = (ones - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        a, b = start * self.low_bits, stop * self.low_bits
        bits = np.unpackbits(self.low[a // 8: -(-b // 8)], bitorder="little")[a % 8: a % 8 + b - a]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return high | (bits.reshape(-1, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        return int(self.values(i, i + 1)[0])


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encode every text and write shards in ascending doc_id order; returns the stored manifest
    (shard, file, n_docs, n_ids), shard numbers ascending with doc_id.

    Null text counts as empty; a null doc_id sorts first; rows with equal doc_id follow one
    another, ordered by text; repeated rows are all written; extra columns are left behind; an empty
    table gives no shard."""
    folder = folder or new_folder(docs.sparkSession, "token-shards")
    tie = F.xxhash64("text")
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text"))

    def write(batches):
        fs = sink = None
        lengths, keys = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                encoder = TextEncoder.of(tokenizer_path)
                end = np.array([end_id], encoder.dtype).tobytes()
                fs, root = open_folder(folder)
                fs.create_dir(root, recursive=True)
                shard = TaskContext.get().partitionId()
                name = f"{root}/{shard:08d}-{uuid.uuid4().hex}.ids"
                sink = fs.open_output_stream(name)
            for raw in encoder.encode(batch.column(1).to_pylist()):
                sink.write(raw + end)
                lengths.append(len(raw) // len(end) + 1)
            keys.append(batch.column(0))
        if sink is None:
            return
        ends = np.cumsum(np.array(lengths, dtype=np.uint64))
        n_null = sum(k.null_count for k in keys)
        known = np.concatenate([k.drop_null().to_numpy(zero_copy_only=False) for k in keys]).astype(np.int64)
        first = int(known[0]) if len(known) else 0
        sections = [ef_encode(ends), ef_encode(known.view(np.uint64) - np.array(first, np.int64).view(np.uint64))]
        for s in sections:
            sink.write(s)
        sink.write(struct.pack(FOOTER, len(ends), n_null, int(ends[-1]), first, *map(len, sections),
                               len(end), MAGIC))
        sink.close()
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name.rsplit("/", 1)[1]],
                                          "n_docs": [len(ends)], "n_ids": [int(ends[-1])]})

    manifest = materialise(ordered.mapInArrow(write, MANIFEST), "token-manifest")
    return manifest.withColumn("folder", F.lit(folder))


def open_shard(source):
    """(footer fields, boundaries, document ids) of an open shard file."""
    size = source.size()
    foot = struct.unpack(FOOTER, source.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
    if foot[-1] != MAGIC:
        raise ValueError("not a token shard")
    ends_size, keys_size = foot[4:6]
    at = size - struct.calcsize(FOOTER) - ends_size - keys_size
    return foot, EliasFano(source.read_at(ends_size, at)), EliasFano(source.read_at(keys_size, at + ends_size))


def read_shards(manifest: DataFrame, with_ids: bool = False, ids_at_once: int = 4_000_000) -> DataFrame:
    """Documents as the files hold them: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, and with `with_ids` the ids as little-endian bytes of the stored width."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))  # one row per file
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def load(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                fs, root = open_folder(row["folder"])
                with fs.open_input_file(f"{root}/{row['file']}") as source:
                    foot, ends, keys = open_shard(source)
                    n_docs, n_null, _, first, _, _, width, _ = foot
                    i, begin = 0, 0
                    while i < n_docs:
                        block = ends.values(i, min(n_docs, i + 8192)).astype(np.int64)
                        take = max(1, int(np.searchsorted(block, begin + ids_at_once, side="right")))
                        block = block[:take]
                        raw = source.read_at((int(block[-1]) - begin) * width, begin * width)
                        ids = np.frombuffer(raw, f"<u{width}")
                        starts = np.concatenate([[begin], block[:-1]])
                        a, b = max(0, i - n_null), max(0, i + take - n_null)
                        offset = np.array(first, np.int64).view(np.uint64)
                        known = (keys.values(a, b) + offset).view(np.int64).tolist()
                        pieces = [ids[s - begin: e - begin] for s, e in zip(starts.tolist(), block.tolist())]
                        out = {"doc_id": pa.array([None] * (take - len(known)) + known, pa.int64()),
                               "start": pa.array(starts + row["base"], pa.int64()),
                               "n_tokens": pa.array(block - starts, pa.int64()),
                               "ids_crc32": pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in pieces],
                                                     pa.int64())}
                        if with_ids:
                            out["ids"] = pa.array([p.tobytes() for p in pieces], pa.binary())
                        yield pa.RecordBatch.from_pydict(out)
                        i, begin = i + take, int(block[-1])

    return placed.repartition(max(1, manifest.count())).mapInArrow(load, schema)
