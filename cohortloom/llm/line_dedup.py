"""Line dedup that can be taken back: cuckoo filters over exact reference counts.

A reference is a line key that a document holds; keys are 128-bit digests. The store keeps all
references, for each key the exact number of documents and the largest doc_id (`counts`), and a
cuckoo filter per shard of the keys that are common, that is held by MIN_DOCS documents or more.
Filters take insertions and deletions: when documents come or go, only counts of their keys change,
and a key enters or leaves its shard's filter as its count passes the limit. A document's lines
are held against the filters; the few that may be common are looked up in the counts, which decide.

The number of shards follows the number of common keys, so a filter has a bounded size. Small sets
of filters are broadcast, after a check of their size; else references are dealt by shard and
tasks read one filter at a time from the shared folder."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import document_columns, new_folder, open_folder
from cohortloom.session import materialise, remember

MIN_CHARS = 20  # code points of a key
MIN_DOCS = 3
SHARD_KEYS = 1 << 16  # common keys aimed at for a shard
BROADCAST_BYTES = 8 << 20  # of filters that tasks get as a whole
SALTS = 64
REFERENCES = "doc_id long, text_hash long, key binary"
FILTERS = "shard long, n_keys long, file string"


class Cuckoo:
    """A cuckoo filter of 16-byte keys: buckets of four 16-bit marks, two buckets for a key."""

    SLOTS, ROUNDS = 4, 200

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, n_keys: int) -> Cuckoo:
        buckets = 1 << max(2, int(n_keys / cls.SLOTS / 0.8)).bit_length()
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> Cuckoo:
        made = cls.sized(len(keys))
        while not made.insert(keys):
            made = cls(np.zeros((2 * len(made.table), cls.SLOTS), np.uint16))
        return made

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, "<u2").reshape(-1, cls.SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _places(self, keys: np.ndarray):
        """keys: 16 bytes a row. The first bucket and the mark of each; bytes 0 to 2 choose the shard."""
        words = np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)
        mark = (words[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        return (words[:, 0] >> np.uint64(24)).astype(np.int64) & len(self.table) - 1, mark

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mark.astype(np.int64) * 0x5BD1E995 >> 8) & len(self.table) - 1

    def _put(self, bucket: np.ndarray, mark: np.ndarray):
        """Fill free slots; returns what found none."""
        order = np.argsort(bucket, kind="stable")
        bucket, mark = bucket[order], mark[order]
        rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
        free = self.table[bucket] == 0
        fits = rank < free.sum(axis=1)
        slot = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
        self.table[bucket[fits], slot] = mark[fits]
        return bucket[~fits], mark[~fits]

    def insert(self, keys: np.ndarray) -> bool:
        """Whether all found room; where not, the filter is to be made anew from the counts."""
        bucket, mark = self._put(*self._places(keys))
        bucket = self._other(bucket, mark)
        for n in range(self.ROUNDS):
            bucket, mark = self._put(bucket, mark)
            if not len(bucket):
                return True
            at, first = np.unique(bucket, return_index=True)  # one mark a bucket drives out another, to its other bucket
            driven = self.table[at, n % self.SLOTS].copy()
            self.table[at, n % self.SLOTS] = mark[first]
            mark[first] = driven
            bucket[first] = self._other(at, driven)
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        bucket, mark = self._places(keys)
        return ((self.table[bucket] == mark[:, None]) | (self.table[self._other(bucket, mark)] == mark[:, None])).any(axis=1)

    def delete(self, keys: np.ndarray) -> None:
        """Take keys out that were inserted; each clears one slot with its mark."""
        bucket, mark = self._places(keys)
        while len(bucket):
            # Two keys can only want the same slot with the same mark and the same pair of buckets.
            pair = np.minimum(bucket, self._other(bucket, mark)) << 16 | mark.astype(np.int64)
            _, now = np.unique(pair, return_index=True)
            b, m = bucket[now], mark[now]
            for _ in range(2):
                hit = self.table[b] == m[:, None]
                there = hit.any(axis=1)
                self.table[b[there], hit[there].argmax(axis=1)] = 0
                b, m = self._other(b[~there], m[~there]), m[~there]
            rest = np.ones(len(bucket), bool)
            rest[now] = False
            bucket, mark = bucket[rest], mark[rest]


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and their keys (stripped, A-Z lowered, as digests); None where too short."""
    lines = (text or "").encode("utf-8", "replace").split(b"\n")
    keys = []
    for line in lines:
        key = line.strip().lower()  # of bytes: exactly the six ASCII blanks, and A-Z only
        long = len(key) >= MIN_CHARS and (len(key) >= 4 * MIN_CHARS or len(key.decode()) >= MIN_CHARS)
        keys.append(blake2b(key, digest_size=16).digest() if long else None)
    return lines, keys


def _with_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}).withColumn(
        "text_hash", F.xxhash64("text"))


def references(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, key: each key of a document once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, hashes, keys = [], [], []
            for doc_id, text, text_hash in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                own = set(line_keys(text.as_py())[1])
                own.discard(None)
                ids += [doc_id] * len(own)
                hashes += [text_hash] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()),
                                              pa.array(keys, pa.binary())], ["doc_id", "text_hash", "key"])

    return _with_hash(docs).select("doc_id", "text", "text_hash").mapInArrow(run, REFERENCES)


def _key_bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 16)


def _shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys[:, 0].astype(np.int64) << 16 | keys[:, 1].astype(np.int64) << 8 | keys[:, 2]) & shards - 1


def _shard(shards: int):
    """The same, as a column of a table with `key`."""
    return F.expr("cast(conv(hex(substring(key, 1, 3)), 16, 10) as long)").bitwiseAND(shards - 1)


def _save(folder: str, data: bytes) -> str:
    fs, root = open_folder(folder)
    fs.create_dir(root, recursive=True)
    name = f"{root}/{uuid.uuid4().hex}.cuckoo"
    with fs.open_output_stream(name) as sink:
        sink.write(data)
    return f"{folder}/{name.rsplit('/', 1)[1]}"


def _fetch(uri: str) -> bytes:
    folder, name = uri.rsplit("/", 1)
    fs, root = open_folder(folder)
    with fs.open_input_stream(f"{root}/{name}") as source:
        return source.read()


def _filter_row(shard: int, n_keys: int, file: str | None):
    import pyarrow as pa

    return pa.table({"shard": pa.array([shard], pa.int64()), "n_keys": pa.array([n_keys], pa.int64()),
                     "file": pa.array([file], pa.string())})


def _make_filters(common: DataFrame, shards: int) -> DataFrame:
    """A filter for each shard that has common keys."""
    folder = remember(new_folder(common.sparkSession, "line-filters"))

    def make(shard, table):
        return _filter_row(shard[0].as_py(), table.num_rows, _save(folder, Cuckoo.of(_key_bytes(table.column("key"))).dump()))

    return common.select("key", _shard(shards).alias("shard")).groupBy("shard").applyInArrow(make, FILTERS)


@dataclass
class LineStore:
    """The state: `references` (doc_id, text_hash, key), `counts` (key, n, largest; n documents, the
    largest doc_id among them), `filters` (shard, n_keys, file), all stored, and the number of shards.

    Every row is a document of its own. A null doc_id counts as a document below all others."""

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def of(cls, docs: DataFrame) -> LineStore:
        made = materialise(references(docs), "line-references")
        counts = materialise(made.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("largest")), "line-counts")
        return cls._with_filters(made, counts)

    @classmethod
    def _with_filters(cls, made: DataFrame, counts: DataFrame) -> LineStore:
        common = counts.filter(F.col("n") >= MIN_DOCS)
        shards = 1 << max(0, common.count() - 1).bit_length() >> SHARD_KEYS.bit_length() - 1 or 1
        return cls(made, counts, materialise(_make_filters(common, shards), "line-filters"), shards)

    def insert(self, docs: DataFrame) -> LineStore:
        """The store with further documents. Counts of their keys grow; keys that become common enter the filters."""
        new = materialise(references(docs), "line-references")
        grown = new.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("largest"))
        both = self.counts.withColumn("before", F.col("n")).unionByName(grown.withColumn("before", F.lit(0).cast("long")))
        counts = materialise(both.groupBy("key").agg(F.sum("n").alias("n"), F.max("largest").alias("largest"),
                                                     F.sum("before").alias("before")), "line-counts")
        return self._changed(materialise(self.references.unionByName(new), "line-references"), counts)

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """The store without the documents of these ids (column doc_id). Keys that cease to be common leave the filters."""
        gone_ids = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        left = materialise(self.references.join(gone_ids, "doc_id", "left_anti"), "line-references")
        touched = materialise(self.references.join(gone_ids, "doc_id", "left_semi").select("key").distinct(), "touched")
        again = left.join(touched, "key", "left_semi").groupBy("key").agg(
            F.count("*").alias("n"), F.max("doc_id").alias("largest"))
        before = self.counts.join(touched, "key", "left_semi").select("key", F.col("n").alias("before"))
        recounted = before.join(again, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"), "largest", "before")
        counts = self.counts.join(touched, "key", "left_anti").withColumn("before", F.col("n")).unionByName(recounted)
        return self._changed(left, materialise(counts, "line-counts"))

    def _changed(self, made: DataFrame, counts: DataFrame) -> LineStore:
        """counts: with the number `before`; keys that crossed the limit enter or leave their shard's filter."""
        kept = counts.filter("n > 0").select("key", "n", "largest")
        common = kept.filter(F.col("n") >= MIN_DOCS)
        if common.count() > 2 * SHARD_KEYS * self.shards:
            return self._with_filters(made, kept)
        crossed = (counts.filter((F.col("n") >= MIN_DOCS) != (F.col("before") >= MIN_DOCS))
                   .select("key", (F.col("n") >= MIN_DOCS).alias("enters"), _shard(self.shards).alias("shard")))
        folder = remember(new_folder(made.sparkSession, "line-filters"))

        def change(shard, held, changes):
            keys, enters = _key_bytes(changes.column("key")), np.array(changes.column("enters").to_pylist(), bool)
            n, file = (held.column(c)[0].as_py() for c in ("n_keys", "file")) if held.num_rows else (0, None)
            if not len(keys):
                return held.select(["shard", "n_keys", "file"])
            cuckoo = Cuckoo.load(_fetch(file)) if file else Cuckoo.sized(len(keys))
            cuckoo.delete(keys[~enters])
            fits = cuckoo.insert(keys[enters])
            return _filter_row(shard[0].as_py(), n + 2 * int(enters.sum()) - len(keys),
                               _save(folder, cuckoo.dump()) if fits else None)

        filters = materialise(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(change, FILTERS),
                              "line-filters")
        full = filters.filter("file is null").select("shard")
        if not full.isEmpty():  # no room left: made anew from the exact counts
            again = common.withColumn("shard", _shard(self.shards)).join(full, "shard", "left_semi")
            filters = materialise(filters.filter("file is not null").unionByName(_make_filters(again, self.shards)), "line-filters")
        return LineStore(made, kept, filters, self.shards)

    def maybe_common(self, refs: DataFrame) -> DataFrame:
        """The references whose key is in its shard's filter: all of common keys, and a few others."""
        shards = self.shards
        size = self.filters.agg(F.sum("n_keys")).head()[0] or 0
        if 4 * size <= BROADCAST_BYTES:  # two to four bytes a key
            held = {r.shard: _fetch(r.file) for r in self.filters.collect()}
            shared = refs.sparkSession.sparkContext.broadcast(held)

            def test(batches):
                import pyarrow as pa

                loaded = {}
                for batch in batches:
                    keys = _key_bytes(batch.column(2))
                    of, hit = _shards_of(keys, shards), np.zeros(len(keys), bool)
                    for shard in np.unique(of).tolist():
                        if shard in shared.value:
                            cuckoo = loaded.setdefault(shard, None) or Cuckoo.load(shared.value[shard])
                            loaded[shard] = cuckoo
                            at = of == shard
                            hit[at] = cuckoo.contains(keys[at])
                    yield batch.filter(pa.array(hit))

            return refs.select("doc_id", "text_hash", "key").mapInArrow(test, REFERENCES)

        def stream(batches):  # sorted by shard, so each filter of the task is read once
            import pyarrow as pa

            shard, cuckoo = None, None
            for batch in batches:
                files = np.array(batch.column(3).to_pylist(), object)
                keys, hit = _key_bytes(batch.column(2)), np.zeros(batch.num_rows, bool)
                for file in dict.fromkeys(files.tolist()):
                    if file != shard:
                        shard, cuckoo = file, Cuckoo.load(_fetch(file))
                    at = files == file
                    hit[at] = cuckoo.contains(keys[at])
                yield batch.select(["doc_id", "text_hash", "key"]).filter(pa.array(hit))

        salt = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS))  # a shard with a hot key is read by several tasks
        dealt = (refs.withColumn("shard", _shard(shards)).join(self.filters.select("shard", "file"), "shard")
                 .select("doc_id", "text_hash", "key", "file"))
        return dealt.repartition("file", salt).sortWithinPartitions("file").mapInArrow(stream, REFERENCES)

    def apply(self, docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        """The documents without the lines that are common, but for the largest doc_id that holds
        them; the columns of documents, n_lines (before) and n_dropped.

        Null text stays null, counts as one empty line and loses nothing. A document that the store
        does not hold loses its common lines too. Rows with equal or null doc_id keep a row each;
        extra columns are left behind; an empty table gives no row. refs: references of these
        documents, where they are stored already."""
        common = self.counts.filter(F.col("n") >= MIN_DOCS).select("key", "largest")
        hits = self.maybe_common(references(docs) if refs is None else refs)
        drops = materialise(hits.join(common, "key").filter(~F.col("doc_id").eqNullSafe(F.col("largest")))
                            .groupBy("doc_id", "text_hash").agg(F.collect_set("key").alias("drop")), "line-drops")
        docs = _with_hash(docs.select(*document_columns(docs)))
        joined = (docs.alias("d").join(drops.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id"))
                                       & (F.col("d.text_hash") == F.col("x.text_hash")), "left")
                  .select(*(F.col(f"d.{c}") for c in document_columns(docs)), "drop"))
        kept = docs.drop("text_hash").schema
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_lines long, n_dropped long"])

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                at = batch.schema.get_field_index("text")
                texts, lines_of, dropped = [], [], []
                for text, drop in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                    text = text.as_py()
                    if not drop.is_valid:
                        lines, stay = (text or "").count("\n") + 1, None
                    else:
                        drop, (all_lines, keys) = set(drop.as_py()), line_keys(text)
                        stay = [line for line, key in zip(all_lines, keys) if key not in drop]
                        lines = len(all_lines)
                    texts.append(text if stay is None else b"\n".join(stay).decode())
                    lines_of.append(lines)
                    dropped.append(0 if stay is None else lines - len(stay))
                columns = [*batch.columns[:-1], pa.array(lines_of, pa.int64()), pa.array(dropped, pa.int64())]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_lines", "n_dropped"])

        return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`apply` of a store of the table to the table itself."""
    store = LineStore.of(docs)
    return store.apply(docs, store.references)
