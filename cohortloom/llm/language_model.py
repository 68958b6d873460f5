"""A hierarchical Pitman-Yor language model and its scores for whole texts.

A token is seated in the restaurant of the word before it; every word has one, and so has the start
of a text. Every table there is a customer of the restaurant of the word's class (a class of its own
for the most frequent words, else the ending of the word), every table of a class a customer of the
one restaurant of words without context, whose own base is uniform over the vocabulary and one
unknown word. Gibbs sweeps seat all customers of a dish anew, given the tables everywhere else; the
predictive probabilities of the sweeps after the first ones are averaged. Of the seating only the
number of tables of each dish in each restaurant matters, so that is what is drawn.

How the work is laid out: words are 64-bit hashes. Each batch of documents is stored once as places
in its own list of words; the distinct pairs of a word and the word before it are dealt by the word.
Hot words (every word with 1 / (2 * hot) of all tokens or more, so that there are at most 2 * hot of
them; no part of the model) have their pairs dealt by the word before, and their dishes in the
classes are one bounded table. A bucket holds the pairs of its words and, as words before others,
the tables of their restaurants. A sweep sends the tables drawn to the buckets of the words before,
and their sums back; only pairs seen twice or more take part, as one customer has one table. What
comes back to the driver are totals per class and of hot words. At last each batch gets back, for its words
and pairs, the counts and tables that their probabilities consist of. Draws are hashes of the word,
the word before and the sweep, so a lost task is simply repeated, and neither partitions nor the
list of hot words change a draw."""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass, field
from math import copysign, exp
from statistics import NormalDist

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import new_folder, open_folder
from cohortloom.session import materialise, remember

HELD_OUT = 2  # the remainder of crc32(doc_id) by FOLDS that is not learned from
FOLDS = 7
HOT = 256
CONTEXT_WORDS = 384  # frequent words with a class of their own
CONTEXT_SHARE = 1 / 512  # of the training tokens, that such a word has at least
ENDINGS = 512  # classes of word endings
BURN_IN, SAMPLES = 2, 2
STRENGTH = 1.0
SEED = 20240501
TRAIN_BIT = 1 << 15
WORK_TOKENS = 150_000  # dishes of a bucket that a task lays out at once, about
HELD_WORDS = 200_000  # counted at once in a task
SLICE_BYTES = 5_000_000  # of text laid out at once in a task
BATCH = 1 << 16  # documents laid out together, at most
BUCKET_BYTES = 12_000_000  # of text whose pairs share a bucket, about
END = b" "  # the end token; no word can be a space
START = 0  # stands for the hash of the word before the first one


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one dimension, compressed, each with two bytes for its kind and eight for its length."""
    import zstandard

    raw = b"".join(part for a in arrays for part in (a.dtype.str[1:].encode(), struct.pack("<Q", len(a)), a.tobytes()))
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, (n,) = np.dtype(raw[at:at + 2].decode()), struct.unpack_from("<Q", raw, at + 2)
        out.append(np.frombuffer(raw, kind, n, at + 10))
        at += 10 + n * kind.itemsize
    return out


def mixed(*parts) -> np.ndarray:
    """A 64-bit hash of arrays of whole numbers, element by element."""
    x = np.zeros(1, np.uint64)
    for part in parts:
        x = x ^ np.asarray(part).astype(np.uint64)
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(factor)
            x = x ^ x >> np.uint64(31)
    return x


def uniform(*parts) -> np.ndarray:
    """Numbers in (0, 1) that depend on the parts alone."""
    return ((mixed(*parts) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0 ** -52


# Log odds and normal quantiles of probabilities, close enough to draw lines between.
LOG_ODDS = np.linspace(-36, 36, 1801)
QUANTILES = np.array([copysign(NormalDist().inv_cdf(1 / (1 + exp(abs(x)))), x) for x in LOG_ODDS])


def normal_quantile(u: np.ndarray) -> np.ndarray:
    return np.interp(np.log(u / (1 - u)), LOG_ODDS, QUANTILES)


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Successes in n trials, by inversion of u; by the normal quantile where the variance is over 25."""
    flip = p > 0.5
    q = np.where(flip, 1 - p, p)
    spread = np.sqrt(n * q * (1 - q))
    out = np.clip(np.floor(n * q + spread * normal_quantile(u) + 0.5), 0, n).astype(np.int64)
    at = np.flatnonzero(spread <= 5)
    n_, q_, left = n[at], q[at], u[at].copy()
    mass, k = np.exp(n_ * np.log1p(-q_)), np.zeros(len(at), np.int64)
    going = np.flatnonzero((left >= mass) & (k < n_))
    while len(going):
        left[going] -= mass[going]
        mass[going] *= (n_[going] - k[going]) / (k[going] + 1) * (q_[going] / (1 - q_[going]))
        k[going] += 1
        going = going[(left[going] >= mass[going]) & (k[going] < n_[going])]
    out[at] = k
    return np.where(flip, n - out, out)


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def is_train(doc_id: int | None) -> bool:
    """A null id is learned from."""
    import zlib

    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS != HELD_OUT


def hot_words(docs: DataFrame, hot: int) -> tuple[list[bytes], list[bytes]]:
    """Two lists of words by falling frequency, both with the end token first, from exact counts of
    the training tokens: hot words, those with a share of 1 / (2 * hot) or more, and the words with a
    class of their own, at most CONTEXT_WORDS with a share of CONTEXT_SHARE or more. The second
    depends on the texts alone."""

    def report(batches):
        from collections import Counter

        import pyarrow as pa

        def rows(seen):
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                              ["word", "n"])

        seen = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if is_train(doc_id):
                    seen.update(tokens(text.as_py()))
                    if len(seen) > HELD_WORDS:
                        yield rows(seen)
                        seen = Counter()
        yield rows(seen)

    counts = stored(docs.mapInArrow(report, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "hot")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = min(1 / (2 * hot), CONTEXT_SHARE) * total
    rows = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").collect()
    rows = [(bytes(r["word"]), r["n"]) for r in rows if bytes(r["word"]) != END]
    own = [w for w, n in rows if n >= CONTEXT_SHARE * total][:CONTEXT_WORDS - 1]
    return [END, *(w for w, n in rows if 2 * hot * n >= total)], [END, *own]


def context_of(word: bytes, rank: int | None) -> int:
    """The class of a word as the one before another: 0 the start, then frequent words, then endings."""
    import xxhash

    if rank is not None and rank < CONTEXT_WORDS:
        return 1 + rank
    return 1 + CONTEXT_WORDS + xxhash.xxh32_intdigest(word[-3:]) % ENDINGS


CONTEXTS = 1 + CONTEXT_WORDS + ENDINGS
CONTEXTS = 1 + CONTEXT_WORDS + ENDINGS
TOKENS = "batch long, bucket int, payload binary"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """A step written to the shared folder; what was shuffled for it goes once it is written."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return materialise(df, name, partition_by)
    finally:
        spark.conf.set(key, before)


def least(x: np.ndarray) -> np.ndarray:
    """Whole numbers from zero in the smallest kind that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def steps(x: np.ndarray) -> np.ndarray:
    """Rising whole numbers as the first and the steps between them."""
    return np.diff(x, prepend=x.dtype.type(0))


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.uint64)
    return x.astype(np.uint32), least(x >> np.uint64(32))


def signed(x: np.ndarray) -> np.ndarray:
    """Whole numbers of either sign, small ones in few bits."""
    return least(x << 1 ^ x >> 63)


def unsigned(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    return x >> 1 ^ -(x & 1)


def whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) | high.astype(np.int64) << 32


def ids_of(hashes: np.ndarray) -> np.ndarray:
    """48 bits of a word's hash, by which it is known as the one before others and dealt to its bucket."""
    return (hashes >> np.uint64(16)).astype(np.int64)


def put(folder: str, data: bytes) -> bytes:
    """Write a new file in a folder of the shared one; its address."""
    files, path = open_folder(folder)
    files.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    with files.open_output_stream(f"{path}/{name}") as file:
        file.write(data)
    return f"{folder}/{name}".encode()


def fetch(address: bytes) -> bytes:
    files, path = open_folder(address.decode())
    with files.open_input_stream(path) as file:
        return file.read()


def pairs_of(word: np.ndarray, sizes: np.ndarray, edges: np.ndarray, rank: np.ndarray):
    """The distinct pairs of a word and the word before it in a batch, in the order in which buckets get
    them and give their tables back, and the place of each token's pair among them. Words are places in the
    batch's list, which is sorted by bucket (`edges`) and has the start at 0."""
    before = np.concatenate([np.zeros(1, np.int64), word[:-1]])
    before[np.cumsum(sizes) - sizes] = 0
    n = max(int(edges[-1]), int(rank.max(initial=0)) + 1)
    pairs, place = np.unique(word * n + before, return_inverse=True)
    word, before = np.divmod(pairs, n)
    bucket = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    hot = rank[word] >= 0
    owner = np.where(hot, bucket[before], bucket[word])
    order = np.argsort(((owner * 2 + hot) * n + np.where(hot, rank[word], word)) * n + before)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return word[order], before[order], hot[order], owner[order], back[place]


def deal(docs: DataFrame, hot: list[bytes], own: list[bytes], buckets: int) -> DataFrame:
    """By batch of documents: a row with the name of a file of its documents and their tokens (bucket -1), and one for
    each bucket with the batch's words in it and the pairs dealt to it. A task that is repeated names its own files."""
    folder = remember(new_folder(docs.sparkSession, "texts"))
    ranks = {w: i for i, w in enumerate(hot)}
    places = {w: i for i, w in enumerate(own)}

    def run(batches):
        import pyarrow as pa
        import xxhash

        def slices():
            for batch in batches:
                ends = np.cumsum([len(t.as_py() or "") for t in batch.column(1)])
                i = 0
                while i < batch.num_rows:
                    base = ends[i - 1] if i else 0
                    j = min(i + BATCH, max(i + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right"))))
                    yield batch.slice(i, j - i)
                    i = j

        for n, batch in enumerate(slices()):
            name = TaskContext.get().partitionId() << 32 | n
            ids = batch.column(0).to_pylist()
            train = np.array([is_train(i) for i in ids], dtype=bool)
            local: dict[bytes, int] = {}
            new = local.setdefault
            words, sizes = [], []
            for text in batch.column(1):
                found = tokens(text.as_py())
                sizes.append(len(found))
                words.append(np.array([new(w, len(local) + 1) for w in found], dtype=np.int32))
            word, sizes = np.concatenate(words), np.array(sizes)
            del words
            rank = np.array([-1, *(ranks.get(w, -1) for w in local)], dtype=np.int32)
            hashes = np.array([START, *(xxhash.xxh64_intdigest(w) for w in local)], dtype=np.uint64)
            classes = np.array([0, *(context_of(w, places.get(w)) for w in local)], dtype=np.uint16)
            del local
            bucket = ids_of(hashes) % buckets
            order = np.lexsort((hashes, bucket))  # the start stays the first
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            word, rank, hashes, classes = back[word], rank[order], hashes[order], classes[order]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            known = np.array([i is not None for i in ids], np.uint8)
            out = [(-1, put(folder, pack(np.array([i or 0 for i in ids], np.int64), known, train.astype(np.uint8), least(sizes), word.astype(np.uint16),
                                         least(word >> 16), least(edges), least(rank + 1), classes)))]
            word_, before, is_hot, owner, place = pairs_of(word, sizes, edges, rank)
            times = np.bincount(place, np.repeat(train, sizes), minlength=len(word_)).astype(np.int64)
            del place
            stops = np.searchsorted(owner, np.arange(buckets + 1))
            for b in np.flatnonzero((np.diff(edges) > 0) | (np.diff(stops) > 0)).tolist():
                i, j = stops[b], stops[b + 1]
                h = i + int(np.count_nonzero(~is_hot[i:j]))
                seen, at = np.unique(before[i:j], return_inverse=True)
                counts = np.bincount(word_[i:h] - edges[b], minlength=edges[b + 1] - edges[b])
                out.append((b, pack(hashes[edges[b]:edges[b + 1]], least(counts), *halves(ids_of(hashes[seen])), classes[seen],
                                    least(at), least(times[i:j]), least(rank[word_[h:j]]))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(out), pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.binary())))],
                [c.split()[0] for c in TOKENS.split(", ")])

    return docs.mapInArrow(run, TOKENS)


# Rows that buckets keep and send: `source` is the bucket a row comes from, or the sweep.
ROWS = "kind int, bucket int, source int, payload binary, rest binary, at array<long>, x array<double>"
TEXTS, PLACES, DISHES, ASKED, WORDS, SUMS, BEFORE, DRAWN, STATE, ANSWER, TABLES = range(11)


def rows_of(rows: list[tuple]):
    """An Arrow table of rows (kind, bucket, source, payload, rest, at, x), later ones left out where none."""
    import pyarrow as pa

    kinds = [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.list_(pa.int64()), pa.list_(pa.float64())]
    full = [r + (None,) * (7 - len(r)) for r in rows]
    return pa.table({c.split()[0]: pa.array([r[i] for r in full], k) for i, (c, k) in enumerate(zip(ROWS.split(", "), kinds))})


def rows_in(table):
    """(kind, source, payload, rest) of a table's rows by kind and source."""
    return sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "source", "payload", "rest"))), key=lambda r: r[:2])


def nonzero(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(values)
    return at, values[at].astype(np.float64)


# Places in an array of totals: tables and customers by class, the tables of the words without context, then single
# counts, dishes by class of words seen once, customers of hot dishes and the counts of hot words.
ROOT, VOCABULARY, TRAINED, ONES, ONCE, HOT_CELLS = (2 * CONTEXTS + i for i in (0, 1, 2, 3, 9, 9 + CONTEXTS))


def ones_and_twos(*counts: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for c in counts for k in (1, 2)]


def gather(dealt: DataFrame, n_hot: int, buckets: int) -> DataFrame:
    """The names of the files of the batches' texts (TEXTS) and the pairs of each bucket, stored: where the pairs of each batch are (PLACES),
    the dishes and the pairs seen twice or more of words seen twice or more (DISHES), what the restaurants of the
    words before must know (ASKED, DRAWN), the ids of the words (WORDS) and first totals (SUMS). Of a word seen
    once there is one customer and one table everywhere."""

    def merge(key, table):
        bucket = key[0].as_py()
        if bucket < 0:
            return rows_of([(TEXTS, -1, 0, p, None, [b]) for b, p in zip(table.column("batch").to_pylist(), table.column("payload").to_pylist())])
        got = [(name, *unpack(p)) for name, p in zip(table.column("batch").to_pylist(), table.column("payload").to_pylist())]
        del table
        names, hashes, counts, low, high, classes, at, times, rank = map(list, zip(*got))
        del got
        words = np.unique(np.concatenate(hashes))
        seen = [whole(a, b) for a, b in zip(low, high)]
        del low, high
        befores, first = np.unique(np.concatenate(seen), return_index=True)
        classes = np.concatenate(classes)[first].astype(np.int64)
        owner = befores % buckets
        order = np.lexsort((befores, owner))  # as in the batches, so that a batch's pairs rise here
        spot = np.empty(len(order), np.int64)
        spot[order] = np.arange(len(order))
        where = [np.searchsorted(words, h) for h in hashes]
        size = [len(a) for a in at]
        before = np.concatenate([spot[np.searchsorted(befores, s)][a] for s, a in zip(seen, at)])
        befores, classes, owner = befores[order], classes[order], owner[order]
        word = np.concatenate([x for w, c, r in zip(where, counts, rank) for x in (np.repeat(w, c), len(words) + r.astype(np.int64))])
        del hashes, seen, at, counts, rank, spot, order
        wide = max(1, len(befores))
        pairs, place = np.unique(word * wide + before, return_inverse=True)
        count = np.bincount(place, np.concatenate(times), minlength=len(pairs)).astype(np.int64)
        word, before = np.divmod(pairs, wide)
        del pairs, times
        cuts = np.cumsum(size)[:-1]
        place = np.concatenate([steps(p) for p in np.split(place, cuts)])
        cell, trained = word * 1024 + classes[before], count > 0
        cells = np.unique(cell[trained])
        dish = np.searchsorted(cells, cell)
        known = dish < len(cells)
        known[known] = cells[dish[known]] == cell[known]
        del cell
        dish_word, dish_class = np.divmod(cells, 1024)
        cold = int(np.searchsorted(dish_word, len(words)))  # dishes of other than hot words
        customers = np.bincount(dish[trained], minlength=len(cells))
        singles = np.bincount(dish[count == 1], minlength=len(cells))
        word_counts = np.bincount(word, count, minlength=len(words) + n_hot).astype(np.int64)
        dishes = np.bincount(dish_word[:cold], minlength=len(words))
        first = np.cumsum(dishes) - dishes
        cold_pairs = int(np.searchsorted(word, len(words)))
        offset = np.where(known[:cold_pairs], dish[:cold_pairs] - first[word[:cold_pairs]] + 1, 0)
        out = [(PLACES, bucket, 0, pack(np.array(names), least(np.array([len(w) for w in where])), least(np.array(size)),
                                        least(np.concatenate([steps(w) for w in where])), least(place), least(count),
                                        least(np.bincount(word[:cold_pairs], minlength=len(words))), least(offset), least(dishes),
                                        least(word_counts[:len(words)]))),
               (WORDS, bucket, 0, pack(*halves(steps(ids_of(words)))))]

        # Pairs seen twice or more, and the words before that have such.
        rows = np.flatnonzero(count >= 2)
        cold_rows = int(np.searchsorted(rows, cold_pairs))
        single = np.bincount(before[count == 1], minlength=len(befores))
        often = np.bincount(before[rows], minlength=len(befores))
        listed = np.flatnonzero(often)
        spot = np.cumsum(often > 0) - 1
        dealt_to = np.bincount(owner[listed], minlength=buckets)
        moving = np.flatnonzero(word_counts[:len(words)] >= 2)
        kept = np.repeat(word_counts[:len(words)] >= 2, dishes)
        out.append((DISHES, bucket, 0,
                    pack((np.cumsum(dishes[moving]) - dishes[moving]).astype(np.uint32), dish_class[:cold][kept].astype(np.uint16) | np.uint16(TRAIN_BIT),
                         least(singles[:cold][kept]), words[moving].astype(np.uint32)),
                    pack(least(np.bincount(word[rows[:cold_rows]], minlength=len(words))[moving]), least(offset[rows[:cold_rows]]),
                         least(spot[before[rows]]), least(count[rows]), befores[listed].astype(np.uint32), least(dealt_to),
                         least(dish[rows[cold_rows:]] - cold), least((dish_word[cold:] - len(words)) * CONTEXTS + dish_class[cold:]),
                         least(singles[cold:]))))
        stops = np.searchsorted(owner, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(stops)).tolist():
            of_b = np.arange(stops[b], stops[b + 1])
            part, rest = of_b[often[of_b] > 0], of_b[(often[of_b] == 0) & (single[of_b] > 0)]
            if len(part) or len(rest):
                out.append((ASKED, b, bucket, pack(*halves(np.concatenate([steps(befores[part]), steps(befores[rest])])),
                                                   least(single[np.concatenate([part, rest])]), least(dealt_to[b:b + 1]))))
            if len(part):
                out.append((DRAWN, b, bucket, pack(least(often[part]))))
        total = np.zeros(HOT_CELLS + n_hot * (CONTEXTS + 1))
        total[:CONTEXTS] = np.bincount(dish_class[:cold], minlength=CONTEXTS)
        total[CONTEXTS:2 * CONTEXTS] = np.bincount(dish_class[:cold], customers[:cold], minlength=CONTEXTS)
        total[ROOT] = total[VOCABULARY] = np.count_nonzero(dishes)
        total[TRAINED] = word_counts[:len(words)].sum()
        total[ONES:ONES + 6] = ones_and_twos(count, customers[:cold], dishes)
        total[ONCE:ONCE + CONTEXTS] = np.bincount(dish_class[:cold][~kept], minlength=CONTEXTS)
        total[HOT_CELLS + (dish_word[cold:] - len(words)) * CONTEXTS + dish_class[cold:]] = customers[cold:]
        total[HOT_CELLS + n_hot * CONTEXTS:] = word_counts[len(words):]
        return rows_of([*out, (SUMS, bucket, 0, None, None, *nonzero(total))])

    return stored(dealt.groupBy("bucket", F.expr("if(bucket < 0, batch, 0)")).applyInArrow(merge, ROWS), "pairs", partition_by=["kind"])


def kinds(rows: DataFrame, *wanted: int) -> DataFrame:
    return rows.filter(F.col("kind").isin(*wanted))


def restaurants(pairs: DataFrame, buckets: int) -> DataFrame:
    """BEFORE rows: for the words of a bucket as words before others, the tables of single customers, and which words
    each other bucket sends tables of."""

    def run(key, table):
        bucket = key[0].as_py()
        found = rows_in(table)
        ids = np.cumsum(whole(*unpack(next(p for kind, _, p, _ in found if kind == WORDS))))
        single, sources, sizes, spots = np.zeros(len(ids), np.int64), [], [], []
        for kind, source, payload, _ in found:
            if kind == ASKED:
                low, high, n, often = unpack(payload)
                asked, often = whole(low, high), int(often[0])
                at = np.searchsorted(ids, np.concatenate([np.cumsum(asked[:often]), np.cumsum(asked[often:])]))
                np.add.at(single, at, n)
                if often:
                    sources.append(source)
                    sizes.append(often)
                    spots.append(at[:often])
        spots = np.concatenate(spots) if spots else np.zeros(0, np.int64)
        return rows_of([(BEFORE, bucket, 0, pack(least(single), np.array(sources, np.uint32), np.array(sizes, np.uint32), least(spots)))])

    return stored(kinds(pairs, WORDS, ASKED).groupBy("bucket").applyInArrow(run, ROWS), "before")


def answers(before: DataFrame, drawn: DataFrame, number: int, samples: bool = False) -> DataFrame:
    """The tables in the restaurants of the words before: to the buckets that sent some of them (ANSWER), or
    with `samples` those of a bucket's own words (TABLES)."""

    def run(key, table):
        bucket = key[0].as_py()
        found = rows_in(table)
        single, sources, sizes, spots = unpack(next(p for kind, _, p, _ in found if kind == BEFORE))
        tables = single.astype(np.int64)
        cuts = np.cumsum([0, *sizes.tolist()])
        where = {s: spots[a:b] for s, a, b in zip(sources.tolist(), cuts, cuts[1:])}
        for kind, source, payload, _ in found:
            if kind == DRAWN:
                np.add.at(tables, where[source], unpack(payload)[0])
        if samples:
            return rows_of([(TABLES, bucket, number, pack(least(tables)))])
        return rows_of([(ANSWER, s, bucket, pack(least(tables[at]))) for s, at in where.items()])

    return before.unionByName(drawn).groupBy("bucket").applyInArrow(run, ROWS)


def seat(customers: np.ndarray, new: np.ndarray, discount: float, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables after seating customers one by one, a new table having weight `new` against i minus
    discount times the tables. From the 33rd customer on, groups of a sixteenth of those seated are
    seated at once with the tables held. Draws depend on the dish's key, the sweep and the customer only."""
    tables = np.minimum(customers, 1).astype(np.int64)
    rows = np.argsort(-customers, kind="stable")
    left = customers[rows]
    i = 1
    active = int(np.searchsorted(-left, -1, side="left"))  # rows with more than one customer
    while active:
        at = rows[:active]
        size = 1 if i < 32 else i // 16
        share = new[at] / (new[at] + i - discount * tables[at])
        u = uniform(keys[at], sweep << 32 | i)
        tables[at] += u < share if size == 1 else binomial(np.minimum(size, left[:active] - i), share, u)
        i += size
        active = int(np.searchsorted(-left, -i, side="left"))
    return tables


@dataclass
class Totals:
    """What is known of all classes after a sweep: bounded by their number."""

    tables: np.ndarray  # by class
    parent_tables: float
    customers: np.ndarray | None = None  # by class, where they are not those of the model

    @property
    def parent_customers(self) -> float:
        return float(self.tables.sum())


@dataclass
class Model:
    customers: np.ndarray  # by class, before the first sweep
    n: int
    v: int
    discount: float
    parent_discount: float
    sweeps: list[Totals] = field(default_factory=list)
    pair_discount: float = 0.5  # in the restaurants of single words


def parent_probability(model: Model, totals: Totals, customers, tables):
    fresh = STRENGTH + model.parent_discount * totals.parent_tables
    return ((customers - model.parent_discount * tables + fresh / (model.v + 1))
            / (STRENGTH + totals.parent_customers))


class Seating:
    """The dishes of some words in the classes: pairs of word index and class with their customers."""

    def __init__(self, keys: np.ndarray, word: np.ndarray, context: np.ndarray, customers: np.ndarray):
        """keys: a hash of each word."""
        self.words, self.word, self.context, self.customers = len(keys), word, context, customers
        self.keys, self.pair_keys = mixed(SEED, keys), mixed(SEED, keys[word], context + 1)
        self.tables = np.ones(len(word), np.int64)
        self.parent_customers = np.bincount(word, minlength=self.words)
        self.parent_tables = np.minimum(self.parent_customers, 1)

    def totals(self) -> tuple[np.ndarray, int]:
        return np.bincount(self.context, self.tables, minlength=CONTEXTS), int(self.parent_tables.sum())

    def sweep(self, model: Model, totals: Totals, number: int) -> None:
        above = parent_probability(model, totals, self.parent_customers, self.parent_tables)
        new = (STRENGTH + model.discount * totals.tables[self.context]) * above[self.word]
        self.tables = seat(self.customers, new, model.discount, self.pair_keys, number)
        self.parent_customers = np.bincount(self.word, self.tables, minlength=self.words).astype(np.int64)
        fresh = (STRENGTH + model.parent_discount * totals.parent_tables) / (model.v + 1)
        self.parent_tables = seat(self.parent_customers, np.full(self.words, fresh), model.parent_discount, self.keys, number)

    def probability(self, model: Model, totals: Totals, word, context, pair):
        """Of tokens by word and context; `pair` is the index of their dish or -1."""
        above = parent_probability(model, totals, self.parent_customers, self.parent_tables)[word]
        own = np.where(pair >= 0, self.customers[pair] - model.discount * self.tables[pair], 0.0) if len(self.tables) else 0.0
        fresh = (STRENGTH + model.discount * totals.tables[context]) * above
        return (own + fresh) / (STRENGTH + (model.customers if totals.customers is None else totals.customers)[context])


class Chunk:
    """Rows sorted by word and context, with the dishes of the training rows among them."""

    def __init__(self, starts: np.ndarray, before: np.ndarray, doc: np.ndarray, keys: np.ndarray):
        """starts: where each word begins; doc: a number of each row; keys: the hashes of the words."""
        self.doc = doc
        train = before >= TRAIN_BIT
        self.context = (before & np.uint16(TRAIN_BIT - 1)).astype(np.int32)
        flags = np.zeros(len(before), np.int32)
        flags[starts] = 1
        self.word = np.cumsum(flags, dtype=np.int32) - 1
        self.words = len(starts)
        new = np.ones(len(before), bool)
        new[1:] = (self.word[1:] != self.word[:-1]) | (self.context[1:] != self.context[:-1])
        cell = np.cumsum(new, dtype=np.int32) - 1
        counts = np.bincount(cell[train], minlength=int(cell[-1]) + 1 if len(cell) else 0)
        index = np.where(counts > 0, np.cumsum(counts > 0) - 1, -1).astype(np.int32)
        self.pair = index[cell]
        at = np.flatnonzero(new)[counts > 0]
        self.seating = Seating(keys, self.word[at], self.context[at], counts[counts > 0])
        self.counts = np.bincount(self.word[train], minlength=self.words)


def parts_of(payload: bytes):
    """The dishes of a bucket in parts of whole words, laid out one after the other. Words do not depend on each
    other within a sweep, so parts change neither draws nor scores."""
    starts, before, doc, keys = unpack(payload)
    wanted = np.searchsorted(starts, np.arange(WORK_TOKENS, len(before), WORK_TOKENS))
    cuts = sorted({0, *wanted[wanted < len(starts)].tolist(), len(starts)})
    ends = [*starts[cuts[:-1]].tolist(), len(before)]
    for a, b, i, j in zip(cuts, cuts[1:], ends, ends[1:]):
        yield Chunk(starts[a:b] - np.uint32(i), before[i:j], doc[i:j], keys[a:b])


def averaged(seating: Seating, model: Model, word, context, pair) -> np.ndarray:
    """log10 of the mean predictive probability over the samples in the classes alone."""
    total = np.zeros(len(word))
    for n in range(len(model.sweeps) - 1):
        seating.sweep(model, model.sweeps[n], n)
        if n >= BURN_IN:
            total += seating.probability(model, model.sweeps[n + 1], word, context, pair)
    return np.log10(total / SAMPLES)


def sweep(pairs: DataFrame, state: DataFrame | None, answered: DataFrame, model: Model, number: int, hot_keys, hot_probability) -> DataFrame:
    """All buckets seated anew, stored: STATE, the tables sent to the words before (DRAWN) and totals (SUMS)."""
    shared = pairs.sparkSession.sparkContext.broadcast((model, mixed(SEED, hot_keys), hot_probability))

    def run(key, table):
        bucket = key[0].as_py()
        model, hot_keys, hot_probability = shared.value
        totals = model.sweeps[number]
        found = rows_in(table)
        payload, rest = next((p, r) for kind, _, p, r in found if kind == DISHES)
        of_word, offset, spot, count, keys, dealt_to, hot_dish, hot_cells, hot_singles = unpack(rest)
        answer = [unpack(p)[0] for kind, _, p, _ in found if kind == ANSWER]
        above = np.concatenate(answer).astype(np.float64) if answer else np.zeros(0)
        old = next((unpack(p) for kind, _, p, _ in found if kind == STATE), None)
        count, cold = count.astype(np.int64), len(offset)
        cuts = np.concatenate([[0], np.cumsum(of_word, dtype=np.int64)])
        tables = np.ones(len(count), np.int64) if old is None else old[0].astype(np.int64)
        total = np.zeros(HOT_CELLS + len(hot_probability))
        done, heads, i, w = [], [], 0, 0

        def drawn(a, b, probability, row_keys):
            new = (STRENGTH + model.pair_discount * above[spot[a:b]]) * probability
            return seat(count[a:b], new, model.pair_discount, mixed(row_keys, keys[spot[a:b]], 3), number)

        for part in parts_of(payload):
            s, singles = part.seating, part.doc.astype(np.int64)
            j, a, b = i + len(singles), cuts[w], cuts[w + s.words]
            at = np.searchsorted(s.word, np.repeat(np.arange(s.words), of_word[w:w + s.words])) + offset[a:b].astype(np.int64) - 1
            customers = lambda: singles + np.bincount(at, tables[a:b], minlength=j - i).astype(np.int64)  # noqa: B023, E731
            if old is not None:
                s.tables = old[1][i:j].astype(np.int64)
                s.parent_customers = np.bincount(s.word, s.tables, minlength=s.words).astype(np.int64)
                s.parent_tables = old[2][w:w + s.words].astype(np.int64)
            s.customers = customers()
            p = s.probability(model, totals, s.word, s.context, np.arange(j - i))
            tables[a:b] = drawn(a, b, p[at], s.keys[s.word[at]])
            s.customers = customers()
            s.sweep(model, totals, number)
            by_class, parents = s.totals()
            total[:CONTEXTS] += by_class
            total[CONTEXTS:2 * CONTEXTS] += np.bincount(s.context, s.customers, minlength=CONTEXTS)
            total[ROOT] += parents
            done.append(s.tables)
            heads.append(s.parent_tables)
            i, w = j, w + s.words
        at = hot_cells.astype(np.int64)
        cell = at[hot_dish]
        tables[cold:] = drawn(cold, len(count), hot_probability[cell], hot_keys[cell // CONTEXTS])
        total[HOT_CELLS + at] = hot_singles + np.bincount(hot_dish, tables[cold:], minlength=len(at))
        joined = lambda x: least(np.concatenate(x)) if x else np.zeros(0, np.uint8)
        sent = np.bincount(spot, tables, minlength=len(keys)).astype(np.int64)
        stops = np.cumsum([0, *dealt_to.tolist()])
        return rows_of([(STATE, bucket, number, pack(least(tables), joined(done), joined(heads))), (SUMS, bucket, 0, None, None, *nonzero(total)),
                        *[(DRAWN, b, bucket, pack(least(sent[stops[b]:stops[b + 1]]))) for b in np.flatnonzero(dealt_to).tolist()]])

    rows = kinds(pairs, DISHES).unionByName(answered)
    if state is not None:
        rows = rows.unionByName(state)
    return stored(rows.groupBy("bucket").applyInArrow(run, ROWS), "sweep", partition_by=["kind"])


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sums of the totals of all buckets, whose number does not depend on the data."""
    got = (kinds(rows, SUMS).select(F.explode(F.arrays_zip("at", "x")).alias("s")).select("s.at", "s.x")
           .groupBy("at").agg(F.sum("x").alias("x")).toArrow())
    out = np.zeros(size)
    out[got["at"].to_numpy()] = got["x"].to_numpy()
    return out


def score_documents(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Scores are log10 probabilities of the whole text with its end. Documents whose crc32(doc_id)
    leaves HELD_OUT by FOLDS are scored but not learned from. Null and empty texts consist of the
    end alone; a null doc_id is learned from; repeated rows and equal ids count and are scored one
    by one; other columns are left behind; an empty table gives no row."""
    import xxhash

    spark = docs.sparkSession
    plain = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    words, own = hot_words(plain, hot or max(HOT, 2 * buckets))
    pairs = gather(deal(plain, words, own, buckets), len(words), buckets)
    before = restaurants(pairs, buckets)

    width = len(words) * CONTEXTS
    found = summed(pairs, HOT_CELLS + width + len(words))
    once = found[ONCE:ONCE + CONTEXTS]
    cells, hot_counts = found[HOT_CELLS:HOT_CELLS + width].astype(np.int64), found[HOT_CELLS + width:].astype(np.int64)
    at = np.flatnonzero(cells)
    keys = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).astype(np.uint32)
    hot_seating = Seating(keys, at // CONTEXTS, at % CONTEXTS, cells[at])
    every, pair = np.arange(width), np.full(width, -1)
    pair[at] = np.arange(len(at))

    def totals_of(found, once):
        """With the hot words and the dishes, one to a word, of words seen once."""
        tables, seats = hot_seating.totals()
        customers = np.bincount(hot_seating.context, hot_seating.customers, minlength=CONTEXTS)
        return Totals(found[:CONTEXTS] + tables + once, found[ROOT] + seats + once.sum(), found[CONTEXTS:2 * CONTEXTS] + customers + once)

    def hot_probability(totals):
        return hot_seating.probability(model, totals, every // CONTEXTS, every % CONTEXTS, pair)

    n = int(found[TRAINED] + hot_counts.sum())
    v = int(found[VOCABULARY] + (hot_counts > 0).sum())
    stats = found[ONES:ONES + 6] + [0, 0, *ones_and_twos(hot_seating.customers, hot_seating.parent_customers)]
    discount = lambda a, b: float(np.clip(a / (a + 2 * b), 0.1, 0.95)) if a + b else 0.5
    pair_discount, class_discount, parent_discount = (discount(*stats[i:i + 2]) for i in (0, 2, 4))
    first = totals_of(found, np.zeros(CONTEXTS))
    model = Model(first.customers, n, v, class_discount, parent_discount, [first], pair_discount)

    # Entry n of model.sweeps is what sweep n goes by. Samples are the states after the last sweeps,
    # with the totals that belong to them.
    drawn, state, samples = kinds(pairs, DRAWN), None, []
    for k in range(BURN_IN + SAMPLES):
        done = sweep(pairs, state, answers(before, drawn, k), model, k, keys, hot_probability(model.sweeps[k]))
        found = summed(done, HOT_CELLS + width)
        seated = found[HOT_CELLS:].astype(np.int64)
        # As in the buckets: the customers are new, and all are seated by the totals before.
        hot_seating.customers = seated[at]
        hot_seating.sweep(model, model.sweeps[k], k)
        model.sweeps.append(totals_of(found, once))
        drawn, state = kinds(done, DRAWN), kinds(done, STATE)
        if k >= BURN_IN:
            samples.append((state, answers(before, drawn, k, samples=True), hot_probability(model.sweeps[k + 1])))
    return scores(pairs, samples, model, hot_counts)


def returned(pairs: DataFrame, samples: list, model: Model) -> DataFrame:
    """batch, bucket, payload: for the words of a batch in a bucket their counts, and by sample their customers and
    tables without context and the tables of their restaurants; for its pairs their counts, and by sample their
    tables and the customers and tables of their dishes. Later samples as differences to those before."""

    def run(key, table):
        import pyarrow as pa

        bucket = key[0].as_py()
        found = rows_in(table)
        one = lambda wanted, n=0: next(p for kind, source, p, _ in found if (kind, source) == (wanted, n))
        names, n_words, n_pairs, where, place, count, of_word, offset, dishes, word_counts = unpack(one(PLACES))
        first = np.cumsum(dishes, dtype=np.int64) - dishes
        word = np.repeat(np.arange(len(dishes)), of_word)
        dish = np.zeros(len(count), np.int64)  # from 1; those of hot words have none here
        dish[:len(word)] = np.where(offset > 0, first[word] + offset, 0)
        moving = word_counts >= 2
        kept, owner = np.repeat(moving, dishes), np.repeat(np.arange(len(dishes)), dishes)
        rows = np.flatnonzero(count >= 2)
        by_word, by_pair = [], []
        for k in range(BURN_IN, BURN_IN + SAMPLES):
            tables, dish_tables, word_tables = unpack(one(STATE, k))
            above, = unpack(one(TABLES, k))
            of_pair = np.minimum(count, 1).astype(np.int64)
            of_pair[rows] = tables
            customers = np.bincount(dish, of_pair, minlength=1 + len(kept)).astype(np.int64)
            customers[0] = 0
            seats = np.ones(1 + len(kept), np.int64)
            seats[0] = 0
            seats[1:][kept] = dish_tables
            root_tables = (word_counts > 0).astype(np.int64)
            root_tables[moving] = word_tables
            root_customers = np.bincount(owner, seats[1:], minlength=len(dishes)).astype(np.int64)
            by_word.append([root_customers, root_tables, above.astype(np.int64)])
            by_pair.append([of_pair, customers[dish], seats[dish]])
        by_word, by_pair = ([first, *map(least, samples[0]), *[signed(x - y) for a, b in zip(samples, samples[1:]) for x, y in zip(b, a)]]
                            for first, samples in ((word_counts, by_word), (count, by_pair)))
        ends, stops = np.cumsum(n_words, dtype=np.int64), np.cumsum(n_pairs, dtype=np.int64)
        out = []
        for name, j, nw, q, nq in zip(names.tolist(), ends, n_words.tolist(), stops, n_pairs.tolist()):
            at, to = np.cumsum(where[j - nw:j], dtype=np.int64), np.cumsum(place[q - nq:q], dtype=np.int64)
            out.append((name, bucket, pack(*[x[at] for x in by_word], *[x[to] for x in by_pair])))
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("batch", "bucket", "payload"), zip(*out), (pa.int64(), pa.int32(), pa.binary()))})

    rows = kinds(pairs, PLACES)
    for state, tables, _ in samples:
        rows = rows.unionByName(state).unionByName(tables)
    return rows.groupBy("bucket").applyInArrow(run, "batch long, bucket int, payload binary")


def scores(pairs: DataFrame, samples: list, model: Model, hot_counts) -> DataFrame:
    shared = pairs.sparkSession.sparkContext.broadcast((model, hot_counts, [p.astype(np.float32) for _, _, p in samples]))
    rows = (kinds(pairs, TEXTS).select(F.col("at")[0].alias("batch"), "bucket", "payload")
            .unionByName(returned(pairs, samples, model)))
    result = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
              "score double")

    def finish(key, table):
        import pyarrow as pa

        model, hot_counts, hot_probability = shared.value
        order = np.argsort(table.column("bucket").to_numpy())
        payloads = table.column("payload")
        parts = [unpack(payloads[int(i)].as_py()) for i in order[1:]]
        ids, known, train, sizes, low, high, edges, rank, classes = unpack(fetch(payloads[int(order[0])].as_py()))
        del table, payloads
        word, rank, sizes = low.astype(np.int64) | high.astype(np.int64) << 16, rank.astype(np.int64) - 1, sizes.astype(np.int64)
        joined = [np.concatenate(x) for x in zip(*parts)]
        del parts
        pair_word, before, hot, _, place = pairs_of(word, sizes, edges.astype(np.int64), rank)
        counts = joined[0].astype(np.int64)
        counts[rank >= 0] = hot_counts[rank[rank >= 0]]
        customers = counts.astype(np.float64)
        customers[0] = hot_counts[0]  # of the start: texts, which all have an end
        count = joined[1 + 3 * SAMPLES].astype(np.float64)
        of_word, of_pair = ([x.astype(np.int64) for x in joined[i:i + 3]] for i in (1, 2 + 3 * SAMPLES))
        context = classes[before].astype(np.int64)
        cell = np.where(hot, rank[pair_word] * CONTEXTS + context, 0)
        total = np.zeros(len(pair_word))
        for k in range(SAMPLES):
            if k:
                of_word, of_pair = ([x + unsigned(d) for x, d in zip(known, joined[i + 3 * k:])] for known, i in ((of_word, 1), (of_pair, 2 + 3 * SAMPLES)))
            (guests, held, above), (tables, dish, dish_tables) = of_word, of_pair
            by = model.sweeps[BURN_IN + k + 1]
            root = parent_probability(model, by, guests, held)
            p = (dish - model.discount * dish_tables + (STRENGTH + model.discount * by.tables[context]) * root[pair_word]) / (STRENGTH + by.customers[context])
            p = np.where(hot, hot_probability[k][cell], p)
            total += ((count - model.pair_discount * tables + (STRENGTH + model.pair_discount * above[before]) * p)
                      / (STRENGTH + customers[before]))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        summed_up = lambda values: np.bincount(doc, values, minlength=len(sizes))
        score = summed_up(np.log10(total / SAMPLES)[place])
        base = summed_up(np.log10(counts + 1.0)[word]) - sizes * np.log10(model.n + model.v + 1.0)
        return pa.table({"doc_id": pa.array(ids, mask=known == 0), "held_out": pa.array(train == 0),
                         "n_tokens": pa.array(sizes), "n_known": pa.array(summed_up((counts > 0)[word]).astype(np.int64)),
                         "train_tokens": pa.array([model.n] * len(sizes), pa.int64()),
                         "base_score": pa.array(base), "score": pa.array(score)})

    return rows.groupBy("batch").applyInArrow(finish, result)
