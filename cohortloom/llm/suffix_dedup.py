"""Repeated passages by a sparse suffix array over words.

A suffix is kept where the hash of its first ANCHOR words is the smallest among a run of
consecutive positions (a minimiser): every passage of PASSAGE words holds exactly one such position
that depends on the passage alone, its anchor, so equal passages keep equal suffixes. About one
position in twenty is kept.

1. Sort the kept suffixes by their first words and compare neighbours: a suffix that is alone with
   its first words begins no repeated passage. (A shuffle on the hash; least and largest place per
   value, pre-aggregated, tell whether there are two.)
2. Extend left and right: the block of an anchor runs from the start of the first passage it
   stands for to the end of the last one. Equal blocks are repeated as a whole.
3. Where suffixes with the same first words have different blocks, the first of each kind is
   extended word by word: each of its passages of PASSAGE words is compared on its own. That finds
   the exact ends of the longest matches.

Passages are compared by 64-bit hashes of all their words. Places are told apart, not rows
counted, so a row that is there twice is no repetition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import byte_words, document_columns, worker_state
from cohortloom.session import materialise

PASSAGE = 50  # words
ANCHOR = 10
RUN = PASSAGE - ANCHOR + 1  # positions among which an anchor is the smallest
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
INVERSE = pow(BASE, -1, 1 << 64)


class WordHashes(dict):
    """64-bit hashes of words met before."""

    MAX_KEPT = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.MAX_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    look_up = worker_state("word hashes", WordHashes).__getitem__
    return np.fromiter(map(look_up, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> np.uint64(33)) * np.uint64(factor)
    return x ^ x >> np.uint64(33)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n modulo 2 ** 64."""
    factors = np.full(n + 1, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


class Rolling:
    """Hashes of any stretch of a sequence of word hashes, equal for equal stretches."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power = powers(BASE, n)
        self.back = powers(INVERSE, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        moved = (self.sums[stop] - self.sums[start]) * self.back[start]  # as if the stretch began the text
        return scramble(moved + (stop - start).astype(np.uint64))


def anchors(words: list[bytes]):
    """(position, first, last, prefix hash, block hash) of the kept suffixes of a text: passages that
    start at first..last have their anchor at the position."""
    n = len(words) - PASSAGE + 1
    if n <= 0:
        return None
    rolling = Rolling(word_hashes(words))
    at = np.arange(len(words) - ANCHOR + 1)
    prefix = rolling.of(at, at + ANCHOR)
    own = np.arange(n) + np.lib.stride_tricks.sliding_window_view(prefix, RUN).argmin(axis=1)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    last = np.append(first[1:] - 1, n - 1)
    position = own[first]
    # The block starts at a distance from the anchor, which belongs to its identity.
    block = scramble(rolling.of(first, last + PASSAGE) + (position - first).astype(np.uint64) * np.uint64(0x51ED270B))
    return position, first, last, prefix[position], block


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and `place`, a key of the row: rows with equal doc_id and text share it."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .withColumn("key", F.xxhash64("text")))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, spans, later): for each text with repeated passages its spans [start,
    stop) of words that lie in a passage of PASSAGE words found at two places or more, and `later`,
    the spans of passages that are not the first of their kind (by doc_id, null ids last, then key
    and position). `key` is xxhash64 of the text.

    Null, empty and short texts have none. Rows with equal doc_id and text are one text; rows with
    equal doc_id and different texts are different ones. Passages repeated within a text count, and
    very long texts are searched whole. Extra columns are left behind; an empty table gives no row."""
    texts = keyed(docs)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[] for _ in range(7)]
            for doc_id, text, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                found = anchors(byte_words(text.as_py()))
                if found is not None:
                    n = len(found[0])
                    for column, values in zip(out, ([doc_id] * n, [key] * n, *found)):
                        column.extend(values if isinstance(values, list) else
                                      values.view(np.int64).tolist() if values.dtype == np.uint64 else values.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], SUFFIX)

    suffixes = materialise(texts.mapInArrow(keep, ", ".join(f"{c} long" for c in SUFFIX)), "suffixes")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "position")
    kinds = materialise(
        suffixes.groupBy("prefix").agg(F.min(place).alias("a"), F.max(place).alias("b"),
                                       F.min("block").alias("least"), F.max("block").alias("most"))
        .filter("a <> b").select("prefix", (F.col("least") != F.col("most")).alias("mixed")), "prefixes")
    several = materialise(suffixes.join(kinds, "prefix"), "repeated-suffixes")
    blocks = materialise(several.groupBy("block").agg(F.min(place).alias("lead"), F.max(place).alias("end")), "blocks")
    placed = materialise(
        several.join(blocks, "block").select(
            "doc_id", "key", "first", "last", F.col("lead").eqNullSafe(place).alias("leads"),
            (F.col("lead") != F.col("end")).alias("whole"), "mixed"), "placed-blocks")
    whole = placed.filter("whole").select("doc_id", "key", "first", F.expr(f"last + {PASSAGE}").alias("stop"),
                                          (~F.col("leads")).alias("later"))
    # Passages of the first block of each kind, where kinds differ.
    open_blocks = (placed.filter("mixed and leads").groupBy("doc_id", "key")
                   .agg(F.collect_set(F.struct("first", "last")).alias("ranges")))

    def extend(batches):
        import pyarrow as pa

        for batch in batches:
            for doc_id, text, key, ranges in zip(*(c.to_pylist() for c in batch.columns)):
                rolling = Rolling(word_hashes(byte_words(text)))
                starts = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) for r in ranges]))
                hashes = rolling.of(starts, starts + PASSAGE).view(np.int64)
                n = len(starts)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array([key] * n, pa.int64()),
                                                  pa.array(starts), pa.array(hashes)],
                                                 ["doc_id", "key", "position", "passage"])

    passages = materialise(
        open_blocks.select(F.col("doc_id").alias("i"), F.col("key").alias("k"), "ranges")
        .join(texts, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key")))
        .select("doc_id", "text", "key", "ranges")
        .mapInArrow(extend, "doc_id long, key long, position long, passage long"), "passages")
    twice = materialise(passages.groupBy("passage").agg(F.min(place).alias("lead"), F.max(place).alias("end"))
                        .filter("lead <> end").drop("end"), "repeated-passages")
    single = passages.join(twice, "passage").select("doc_id", "key", F.col("position").alias("first"),
                                                    (F.col("position") + PASSAGE).alias("stop"),
                                                    (~F.col("lead").eqNullSafe(place)).alias("later"))
    spans = whole.unionByName(single)
    pair = F.struct("first", "stop")
    return (spans.groupBy("doc_id", "key")
            .agg(F.collect_set(pair).alias("spans"), F.collect_set(F.when(F.col("later"), pair)).alias("later"))
            .select("doc_id", "key", merged("spans").alias("spans"), merged("later").alias("later")))


SUFFIX = ["doc_id", "key", "position", "first", "last", "prefix", "block"]


def merged(name: str):
    """Overlapping and touching spans of an array joined, in order."""
    step = F.aggregate(
        F.array_sort(name), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= s["first"]),
            F.concat(F.slice(done, 1, F.size(done) - 1),
                     F.array(F.struct(F.element_at(done, -1)["start"].alias("start"),
                                      F.greatest(F.element_at(done, -1)["stop"], s["stop"]).alias("stop")))))
        .otherwise(F.concat(done, F.array(F.struct(s["first"].alias("start"), s["stop"].alias("stop"))))))
    return step


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with the columns of documents, the `later` spans cut out of their texts
    (n_chars is set to the new length); what is left of a text is otherwise unchanged. A text of
    which no word is left goes; texts that had none before stay, null and empty ones included. Extra
    columns are left behind; an empty table gives no row."""
    docs = docs.select(*document_columns(docs))
    spans = materialise(repeated_spans(docs), "spans").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"),
                                                              F.col("later").alias("_cut"))
    spans = spans.filter(F.size("_cut") > 0)
    columns = docs.columns
    joined = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
                       & (F.xxhash64(F.col("text").cast("string")) == F.col("_key")), "left")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            cuts = batch.column(len(columns)).to_pylist()
            at = batch.schema.get_field_index("text")
            texts = [t if not c else without_words(t, c) for t, c in zip(batch.column(at).to_pylist(), cuts)]
            arrays = list(batch.columns[:len(columns)])
            arrays[at] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                n = columns.index("n_chars")
                arrays[n] = pa.array([old if not c else len(t) for old, t, c in
                                      zip(arrays[n].to_pylist(), texts, cuts)], arrays[n].type)
            stays = pa.array([not c or bool(byte_words(t)) for t, c in zip(texts, cuts)], pa.bool_())
            yield pa.RecordBatch.from_arrays(arrays, columns).filter(stays)

    return joined.select(*columns, "_cut").mapInArrow(cut, docs.schema)


def without_words(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans and the white space after each of them."""
    import re

    starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at:starts[s["start"]]])
        at = starts[s["stop"]]
    return "".join([*out, text[at:]])
