"""Ranked lexical search by an Aho-Corasick scan of the documents.

There is no index over the documents. The terms of all items form an automaton whose words are
guarded by a blank on either side; a text whose other characters became blanks is read once, and
every output of the automaton is one occurrence of a whole term. A first scan gives the number of
documents that hold each term and the lengths; a second gives term counts again, from which the
postings of the automaton's outputs (term -> items) make scores. Each task keeps the best
documents of each item, so only those are shuffled.

Items are cut into parts of bounded size. One part is broadcast; the automata of several are files
in the shared folder, of which a task holds one at a time, and still each text is read once a scan."""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from itertools import chain
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import new_folder, open_folder
from cohortloom.session import materialise

TOP = 20
PART_BYTES = 1_000_000  # of terms in an automaton, about; a trie node takes some 40 bytes
CHUNK_BYTES = 8_000_000  # of text whose counts a task holds at once
CELLS = 1_000_000  # of scores that a task lays out at once
# Bytes of terms (digits, letters, all of other characters), with A-Z lowered; the others separate.
CODE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def guarded(text: str) -> bytes:
    return b" %b " % text.encode("utf-8", "replace").translate(CODE)


def terms_of(text: str | None) -> list[bytes]:
    return guarded(text).split() if text else []


class Part:
    """An automaton over terms, with their weights and the items that have them."""

    def __init__(self, terms: list[bytes], postings: list[tuple[int, int, int]] = ()):
        """postings: (term number, item, weight times the term's count in the item)."""
        import ahocorasick

        self.terms = terms
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(terms):
            self.automaton.add_word(f" {term.decode('latin-1')} ", i)  # bytes as characters
        self.automaton.make_automaton()
        postings = sorted(postings)
        self.items = np.unique(np.array([p[1] for p in postings], np.int64))
        self.item = np.searchsorted(self.items, [p[1] for p in postings])
        self.weight = np.array([p[2] for p in postings], np.int64)
        self.first = np.searchsorted([p[0] for p in postings], np.arange(len(terms) + 1))

    def outputs(self, text: bytes):
        """The number of a term for each of its occurrences."""
        return map(itemgetter(1), self.automaton.iter(text.decode("latin-1")))


class Parts:
    """The parts as tasks see them: one that is broadcast, or files of which one is held at a time."""

    def __init__(self, rows: DataFrame, make):
        """rows: a column `part` and what make(arrow table) turns into a Part."""
        folder = new_folder(rows.sparkSession, "automata")

        def build(key, table):
            import pyarrow as pa

            fs, root = open_folder(folder)
            fs.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.automaton"
            with fs.open_output_stream(f"{root}/{name}") as sink:
                sink.write(pickle.dumps(make(table).__dict__))
            return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "file": [name]})

        built = materialise(rows.groupBy("part").applyInArrow(build, "part long, file string"), "automata")
        self.folder, self.files = folder, [r.file for r in built.orderBy("part").collect()]
        self.shared = rows.sparkSession.sparkContext.broadcast(self._read(self.files[0])) if len(self.files) == 1 else None

    def _read(self, name: str) -> bytes:
        fs, root = open_folder(self.folder)
        with fs.open_input_stream(f"{root}/{name}") as source:
            return source.read()

    def __len__(self):
        return len(self.files)

    def load(self):
        for name in self.files:
            part = Part.__new__(Part)
            part.__dict__.update(pickle.loads(self.shared.value if self.shared else self._read(name)))
            yield part


def scan(batches, parts: Parts):
    """(part, ids, coded texts) for pieces of the batches of (doc_id, text); ids of texts with a term."""
    only = next(parts.load()) if len(parts) == 1 else None
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, text in zip(chain(batch.column(0).to_pylist(), [None]), chain(batch.column(1), [None])):
            if text is not None and text.is_valid:
                coded = guarded(text.as_py())
                if not coded.isspace():
                    ids.append(i)
                    texts.append(coded)
                    size += len(coded)
            if texts and (text is None or size >= CHUNK_BYTES):
                for number, part in enumerate([only] if only else parts.load()):
                    yield number, part, ids, texts
                ids, texts, size = [], [], 0


def document_frequencies(docs: DataFrame, terms: DataFrame, n_parts: int) -> DataFrame:
    """term, df of the terms that occur; in the row without term the documents and, as n, all their terms."""
    parts = Parts(terms.select("term", F.pmod(F.xxhash64("term"), F.lit(n_parts)).alias("part")),
                  lambda table: Part(sorted(table.column("term").to_pylist())))
    schema = "term binary, df long, n long"

    def rows(found: list[tuple]):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*found) if found else [[], [], []], [pa.binary(), pa.int64(), pa.int64()])], ["term", "df", "n"])

    def count(batches):
        held, n_docs, n_terms, last = None, 0, 0, None
        for number, part, _, texts in scan(batches, parts):
            present = np.fromiter(chain.from_iterable(set(part.outputs(t)) for t in texts), np.int64)
            df = np.bincount(present, minlength=len(part.terms))
            if number == 0:
                n_docs += len(texts)
                n_terms += sum(len(t.split()) for t in texts)
            if len(parts) == 1:
                held, last = df if held is None else held + df, part
            else:
                yield rows([(part.terms[i], int(df[i]), 0) for i in np.flatnonzero(df)])
        if held is not None:
            yield rows([(last.terms[i], int(held[i]), 0) for i in np.flatnonzero(held)])
        yield rows([(None, n_docs, n_terms)])

    return docs.mapInArrow(count, schema).groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


class Best:
    """The best documents of each item of a part, among those seen so far."""

    def __init__(self, n_items: int, top: int):
        self.top, self.least = top, np.ones(n_items, np.int64)  # a score of 0 never counts
        self.held = [np.zeros(0, np.int64)] * 4  # item, score, whether the id is known, id
        self.waiting, self.n = [], 0

    def add(self, ids: np.ndarray, known: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row per document, a column per item."""
        doc, item = np.nonzero(scores >= self.least)
        self.waiting.append((item, scores[doc, item], known[doc], ids[doc]))
        self.n += len(item)
        if self.n > CELLS:
            self.rows()

    def rows(self) -> list[np.ndarray]:
        item, score, known, ids = (np.concatenate(c) for c in zip(self.held, *self.waiting))
        order = np.lexsort((ids, known, -score, item))
        rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        last = order[rank == self.top - 1]
        self.least[item[last]] = score[last]
        self.held, self.waiting, self.n = [c[order[rank < self.top]] for c in (item, score, known, ids)], [], 0
        return self.held


def score(part: Part, ids: list, texts: list[bytes], totals: tuple[int, int], best: Best) -> None:
    """Give `best` the scores of the texts for the items of a part."""
    n_docs, n_terms = totals
    at, n_items = 0, len(part.items)
    while at < len(texts):
        numbers, counts, lengths, norms, cells = [], [], [], [], 0
        start = at
        while at < len(texts) and (at == start or cells < CELLS and (at - start + 1) * n_items <= CELLS):
            found = Counter(part.outputs(texts[at]))
            numbers += found.keys()
            counts += found.values()
            lengths.append(len(found))
            norms.append(75 + 25 * len(texts[at].split()) * n_docs // n_terms)
            cells += int((part.first[[x + 1 for x in found]] - part.first[list(found)]).sum()) if found else 0
            at += 1
        number, tf = np.array(numbers, np.int64), np.array(counts, np.int64)
        doc = np.repeat(np.arange(at - start), lengths)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.array(norms, np.int64)[doc])
        size = part.first[number + 1] - part.first[number]
        row = np.repeat(np.arange(len(number)), size)
        posting = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + part.first[number][row]
        scores = np.zeros((at - start) * n_items, np.int64)
        np.add.at(scores, doc[row] * n_items + part.item[posting], impact[row] * part.weight[posting])
        known = np.array([i is not None for i in ids[start:at]], np.int64)
        best.add(np.array([i or 0 for i in ids[start:at]], np.int64), known, scores.reshape(-1, n_items))


def top_documents(docs: DataFrame, items: DataFrame, top: int = TOP, part_bytes: int = PART_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `top` documents with a score above 0.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))); a document's share of it is in 64-bit integers
    (see `score`). Ranks go by score, then by ascending doc_id, a null doc_id first. Null and empty
    texts and texts or items without a term match nothing. Every row is a document of its own, also
    where ids are equal; equal items are one, different texts of one item_id (null included) give a
    list each. Other columns are left behind; without items or documents there is no row."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            keys, item_ids, terms, counts = [], [], [], []
            for key, item_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for term, n in Counter(terms_of(text)).items():
                    keys.append(key)
                    item_ids.append(item_id)
                    terms.append(term)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in ((keys, pa.int64()), (item_ids, pa.int64()), (terms, pa.binary()),
                                             (counts, pa.int64()))], ["item", "item_id", "term", "times"])

    named = materialise(items.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").distinct()
                        .select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    item_terms = materialise(named.mapInArrow(split, "item long, item_id long, term binary, times long"), "item-terms")
    distinct = materialise(item_terms.select("term").distinct(), "terms")
    size = lambda df: df.agg(F.sum(F.length("term"))).head()[0] or 0
    found = materialise(document_frequencies(docs, distinct, -(-size(distinct) // part_bytes) or 1), "frequencies")
    n_docs, n_terms = next(((r.df, r.n) for r in found.filter("term is null").collect()), (0, 0))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    n_parts = -(-size(item_terms) // part_bytes) or 1
    weighed = (item_terms.join(found.select("term", "df"), "term")
               .select("item", "term", (weight * F.col("times")).alias("weight"),
                       F.pmod(F.xxhash64("item"), F.lit(n_parts)).alias("part")).filter("weight > 0"))

    def make(table):
        terms = sorted(set(table.column("term").to_pylist()))
        number = {t: i for i, t in enumerate(terms)}
        return Part(terms, [(number[t], i, w) for t, i, w in zip(
            *(table.column(c).to_pylist() for c in ("term", "item", "weight")))])

    parts = Parts(weighed, make)

    def rows(part: Part, best: Best):
        import pyarrow as pa

        item, score_, known, ids = best.rows()
        return pa.RecordBatch.from_arrays(
            [pa.array(part.items[item]), pa.array(ids, mask=known == 0), pa.array(score_)], ["item", "doc_id", "score"])

    def search(batches):
        kept = None
        for _, part, ids, texts in scan(batches, parts):
            best = kept[1] if kept else Best(len(part.items), top)
            score(part, ids, texts, (n_docs, n_terms), best)
            if len(parts) == 1:
                kept = part, best
            else:
                yield rows(part, best)
        if kept:
            yield rows(*kept)

    ranked = (docs.mapInArrow(search, "item long, doc_id long, score long")
              .withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))))
              .filter(F.col("rank") <= top))
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
