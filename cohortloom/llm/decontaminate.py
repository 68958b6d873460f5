"""Benchmark decontamination: BM25 retrieval of test items by training passages, then verification.

The items are indexed (long ones in segments), with BM25 impacts divided by the score an item gives
itself: a passage scores 1 for an item all of whose words it has. Items lie in blocks of similar
ones, and each word keeps its largest impact over all items and over each block. Every passage
(overlapping windows over whole texts) is a query. As everything above a fixed threshold is wanted,
block-max WAND comes down to: drop the passage if the maxima of its words sum to less than the
threshold; else open only the blocks whose own maxima reach it, and score the items in those.

An item found this way is verified by overlap: its first half of words (the question) and its
second half (the answer) must each be covered, to `OVERLAP` of their words, by five-word shingles
that the text has at that place."""

from __future__ import annotations

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import document_columns
from cohortloom.session import materialise

K1, B = 1.2, 0.75
SEGMENT, PASSAGE, STRIDE = 64, 128, 64  # words; any segment lies whole within a passage
THRESHOLD = 0.6
OVERLAP = 0.6
SHINGLE = 5
BLOCK = 8  # items
INDEX_ITEMS = 1024  # segments in one index, which bounds what tasks get; more items take more passes


def terms(text: str | None) -> list[bytes]:
    """Words in lower-case ASCII; ASCII punctuation separates like white space."""
    import string

    upper, marks = string.ascii_uppercase, string.punctuation
    table = bytes.maketrans((upper + marks).encode(), (upper.lower() + " " * len(marks)).encode())
    return (text or "").encode("utf-8", "replace").translate(table).split()


def segments(words: list[bytes]) -> list[list[bytes]]:
    """Pieces of SEGMENT words, the last two sharing words so that all are full."""
    starts = [*range(0, max(1, len(words) - SEGMENT + 1), SEGMENT)]
    if len(words) > SEGMENT and starts[-1] + SEGMENT < len(words):
        starts.append(len(words) - SEGMENT)
    return [words[i:i + SEGMENT] for i in starts]


def weigh_items(items: DataFrame) -> DataFrame:
    """The stored index rows (item_id, segment, words, terms: array of (term, impact)), a row for each
    segment with a word. Document frequencies, their number and mean length cover all segments."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(i, n, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                   for n, w in enumerate(segments(terms(t))) if w]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["item_id", "segment", "words"])

    rows = materialise(items.filter("item_id is not null").dropDuplicates(["item_id", "text"])
                       .selectExpr("cast(item_id as long) item_id", "cast(text as string) text")
                       .mapInArrow(cut, "item_id long, segment long, words array<binary>")
                       .withColumn("key", F.monotonically_increasing_id()), "segments")
    size = rows.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    each = (rows.select("key", F.size("words").alias("length"), F.explode("words").alias("term"))
            .groupBy("key", "length", "term").agg(F.count("*").alias("tf")))
    frequency = materialise(each.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    idf = F.log(1 + (F.lit(size["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(size["mean"] or 1.0)))
    scored = (each.join(frequency, "term").groupBy("key")
              .agg(F.collect_list(F.struct("term", (idf * part).alias("impact"), "df")).alias("terms")))  # SEGMENT at most
    return materialise(rows.join(scored, "key").select("item_id", "segment", "words", "terms"), "index")


class ItemIndex:
    """Impacts of up to INDEX_ITEMS segments, in blocks, with maxima by word and block."""

    def __init__(self, rows):
        # Segments whose most common word agrees (the same language, mostly) share blocks.
        rows = sorted(rows, key=lambda r: (max((t["df"], t["term"]) for t in r["terms"]), len(r["words"]),
                                           r["item_id"], r["segment"]))
        self.items = [r["item_id"] for r in rows]
        self.words = {}
        for r in rows:
            for t in r["terms"]:
                self.words.setdefault(bytes(t["term"]), len(self.words))
        self.texts = [np.array([self.words[bytes(w)] for w in r["words"]], np.int64) for r in rows]
        blocks = -(-len(rows) // BLOCK)
        self.block_max = np.zeros((len(self.words) + 1, blocks), np.float32)  # the last row: words of no item
        self.impacts = []
        for b in range(blocks):
            used = {}
            own = rows[b * BLOCK:(b + 1) * BLOCK]
            for r in own:
                for t in r["terms"]:
                    used.setdefault(self.words[bytes(t["term"])], len(used))
            table = np.zeros((len(used) + 1, len(own)), np.float32)
            for j, r in enumerate(own):
                total = sum(t["impact"] for t in r["terms"])
                for t in r["terms"]:
                    table[used[self.words[bytes(t["term"])]], j] = t["impact"] / total
            ids = np.array(list(used), np.int64)
            self.block_max[ids, b] = table[:-1].max(axis=1)
            order = np.argsort(ids)
            self.impacts.append((ids[order], table[[*order, -1]]))
        self.word_max = self.block_max.max(axis=1, initial=0).astype(np.float64)
        self.shingles = [self._shingles(t) for t in self.texts]

    @staticmethod
    def _shingles(text: np.ndarray) -> list[tuple]:
        n = min(SHINGLE, len(text))
        return [tuple(text[i:i + n].tolist()) for i in range(len(text) - n + 1)]

    def ids(self, words: list[bytes]) -> np.ndarray:
        other = len(self.words)
        get = self.words.get
        return np.fromiter((get(w, other) for w in words), np.int64, len(words))

    def retrieve(self, query: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(segment, score) of all segments at or above the threshold, for distinct word ids."""
        found = []
        for b in np.flatnonzero(self.block_max[query].sum(axis=0, dtype=np.float64) >= threshold - 1e-5):
            ids, table = self.impacts[b]
            at = np.searchsorted(ids, query)
            at[(at == len(ids)) | (ids[np.minimum(at, len(ids) - 1)] != query)] = len(ids)
            scores = table[at].sum(axis=0, dtype=np.float64)
            found += [(b * BLOCK + j, float(scores[j])) for j in np.flatnonzero(scores >= threshold - 1e-5).tolist()]
        return found

    def overlaps(self, segment: int, around: np.ndarray) -> bool:
        """Whether question and answer half are both covered by shingles of the text around."""
        n = min(SHINGLE, len(self.texts[segment]))
        there = set(self._window_shingles(around, n))
        covered = np.zeros(len(self.texts[segment]), bool)
        for i, s in enumerate(self.shingles[segment]):
            if s in there:
                covered[i:i + n] = True
        half = (len(covered) + 1) // 2
        return covered[:half].mean() >= OVERLAP and (half == len(covered) or covered[half:].mean() >= OVERLAP)

    @staticmethod
    def _window_shingles(text: np.ndarray, n: int):
        values = text.tolist()
        return zip(*(values[i:] for i in range(n)))

    def matches(self, text: str | None, threshold: float = THRESHOLD) -> dict[int, float]:
        """item_id -> best score, of the items found and verified in a text."""
        ids = self.ids(terms(text))
        if not len(ids) or not self.items:
            return {}
        bounds = np.concatenate([[0.0], np.cumsum(self.word_max[ids])])
        starts = np.arange(0, max(1, len(ids) - PASSAGE + STRIDE), STRIDE)
        stops = np.minimum(starts + PASSAGE, len(ids))
        found: dict[int, float] = {}
        for a, b in zip(starts[(ok := bounds[stops] - bounds[starts] >= threshold - 1e-5)].tolist(), stops[ok].tolist()):
            query = np.unique(ids[a:b])
            if self.word_max[query].sum() < threshold - 1e-5:
                continue
            for segment, score in self.retrieve(query, threshold):
                item = self.items[segment]
                if score > found.get(item, 0) and (item in found or self.overlaps(segment, ids[a:b])):
                    found[item] = score
        return found


def indexes(items: DataFrame):
    """Broadcast indexes of INDEX_ITEMS segments each, of all items; one is on the driver at a time."""
    rows, context = [], items.sparkSession.sparkContext
    for row in weigh_items(items).orderBy("item_id", "segment").toLocalIterator():
        rows.append(row)
        if len(rows) == INDEX_ITEMS:
            yield context.broadcast(cloudpickle.dumps(ItemIndex(rows)))
            rows = []
    if rows:
        yield context.broadcast(cloudpickle.dumps(ItemIndex(rows)))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score) of every item that a whole text contains by retrieval and verification.

    Null and empty texts and items without a word match nothing; items with equal text all match;
    repeated rows give their pairs once; a null doc_id is kept as null; other columns are left
    behind; an empty table gives no row."""
    plain = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    out = None

    def search(packed):
        def run(batches):
            import pyarrow as pa

            index = cloudpickle.loads(packed.value)
            for batch in batches:
                found = [(i, item, score) for i, t in zip(batch.column(0).to_pylist(), batch.column(1))
                         for item, score in index.matches(t.as_py(), threshold).items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found) if found else [[], [], []],
                                                    [pa.int64(), pa.int64(), pa.float64()])],
                    ["doc_id", "item_id", "score"])
        return run

    for packed in indexes(items):
        part = plain.mapInArrow(search(packed), "doc_id long, item_id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double")
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text contains no item, with the columns of documents; no row is shuffled.

    Null and empty texts and texts without an item stay; repeated rows and rows without id are judged
    by their text; extra columns are left behind; without items all rows stay; an empty table gives no row."""
    docs = docs.select(*document_columns(docs))

    def clean(packed):
        def run(batches):
            import pyarrow as pa

            index = cloudpickle.loads(packed.value)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([not index.matches(t.as_py(), threshold) for t in texts], pa.bool_()))
        return run

    for packed in indexes(items):
        docs = docs.mapInArrow(clean(packed), docs.schema)
    return docs
