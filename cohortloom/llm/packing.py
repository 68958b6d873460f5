"""Harmonic packing of documents into token sequences of a fixed capacity.

Class k holds pieces of which exactly k fit a sequence: lengths above capacity / (k + 1) and up to
capacity / k. A bin of class k is closed when it has k pieces, so a worker fills its bins without
looking at lengths or at other workers. A document longer than the capacity gives whole sequences
first. Its rest is cut so that each piece nearly fills the slot of its class: while a rest would
leave more than `waste` of its slot empty, the longest reciprocal length below it is cut off. Short
rests are not cut; as many of them share a bin as fit.

What a worker has left over (fewer than k pieces a class) is dealt by 64 workers and packed the same
way; what then fills no bin of its class, less than one bin a class, shares bins with other classes,
the longest first. Only these last bins are short."""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import TextEncoder
from cohortloom.session import materialise

PIECE = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary, class int, worker int"
PLACED = PIECE + ", sequence_id long, offset long"
WORKERS = 64  # workers whose leftovers are packed together


def cut_lengths(length: int, capacity: int, waste: float = 1 / 32, smallest: int = 16) -> list[tuple[int, int]]:
    """(piece length, class) of each piece of a document, in order. Rests up to `smallest` are not cut."""
    pieces = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        if rest <= smallest:
            pieces.append((rest, capacity // rest))
            break
        count = capacity // rest
        slot = capacity // count
        if slot - rest <= waste * slot:
            pieces.append((rest, count))
            break
        whole = capacity // (count + 1)
        pieces.append((whole, count + 1))
        rest -= whole
    return pieces


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, waste: float = 1 / 32,
         smallest: int = 16, with_ids: bool = True) -> DataFrame:
    """Pieces with their place: doc_id, start, length, doc_tokens, ids_crc32, ids (little-endian
    bytes, unless told otherwise), sequence_id and offset. Every id of every document, the end id included, is in exactly
    one piece; offsets in a sequence run gapless from 0.

    Null and empty text give the end id alone; repeated rows and null or equal doc_ids are packed
    row by row; an empty table gives no row; other columns are left behind."""

    def pieces_of(batch, encoder, worker):
        import zlib

        end = np.array([end_id], encoder.dtype).tobytes()
        width = len(end)
        rests: dict[int, list] = {}
        for doc_id, raw in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
            raw += end
            tokens = len(raw) // width
            rest = tokens % capacity
            if rest not in rests:
                rests[rest] = cut_lengths(rest, capacity, waste, smallest)
            start, wide = 0, memoryview(np.frombuffer(raw, encoder.dtype).astype("<u4").tobytes())
            for length, count in [(capacity, 1)] * (tokens // capacity) + rests[rest]:
                crc = zlib.crc32(wide[4 * start: 4 * (start + length)])
                ids = raw[start * width: (start + length) * width] if with_ids else None
                yield doc_id, start, length, tokens, crc, ids, count, worker
                start += length

    def fill(batches):
        worker = TaskContext.get().partitionId()
        encoder = TextEncoder.of(tokenizer_path)
        open_bins: dict[int, list] = {}
        sequence = worker << 38
        for batch in batches:
            out = []
            for piece in pieces_of(batch, encoder, worker):
                count = piece[6]
                held = open_bins.setdefault(count, [])
                held.append(piece)
                if len(held) == count:
                    out += placed(held, sequence)
                    sequence += 1
                    open_bins[count] = []
                    if len(out) > 5000:
                        yield as_batch(out)
                        out = []
            if out:
                yield as_batch(out)
        left = [(*piece, None, None) for held in open_bins.values() for piece in held]
        if left:
            yield as_batch(left)

    def fill_left(key, table):
        classes: dict[int, list] = {}
        for row in sorted((tuple(r[c] for c in PIECE_NAMES) for r in table.to_pylist()),
                          key=lambda r: (r[7], r[0] is not None, r[0], r[1], r[4])):
            classes.setdefault(row[6], []).append(row)
        bins, rests = [], []
        for count, rows in classes.items():
            full = len(rows) // count * count
            bins += [rows[i:i + count] for i in range(0, full, count)]
            if rows[full:]:
                rests.append(rows[full:])
        shared: list[list] = []  # tokens left in the bin, its pieces
        for rows in sorted(rests, key=lambda rows: (-sum(r[2] for r in rows), rows[0][6])):
            size = sum(r[2] for r in rows)
            fit = next((b for b in shared if b[0] >= size), None)
            if fit is None:
                shared.append(fit := [capacity, []])
            fit[0] -= size
            fit[1] += rows
        out = []
        for n, rows in enumerate([*bins, *(b[1] for b in shared)]):
            out += placed(rows, 1 << 62 | key[0].as_py() << 24 | n)
        import pyarrow as pa

        return pa.Table.from_batches([as_batch(out)])

    stored = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                     F.col("text").cast("string").alias("text")).mapInArrow(fill, PLACED), "pieces")
    left = (stored.filter("sequence_id is null").withColumn("workers", F.expr(f"worker div {WORKERS}"))
            .groupBy("workers").applyInArrow(fill_left, PLACED))
    packed = stored.filter("sequence_id is not null").unionByName(left).drop("class", "worker")
    return packed if with_ids else packed.drop("ids")


PIECE_NAMES = [c.split()[0] for c in PIECE.split(", ")]


def placed(pieces, sequence: int) -> list[tuple]:
    offset, out = 0, []
    for piece in pieces:
        out.append((*piece, sequence, offset))
        offset += piece[2]
    return out


def as_batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int64()] * 5 + [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                      [*PIECE_NAMES, "sequence_id", "offset"])
