"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 3 bits meet at a variant that is within 1 bit of one and 2 bits of the
other. Fingerprints of even weight send out their variants within 1 bit, those of odd weight
within 2 bits (two at distance 3 differ in parity; at distance 2 they share a variant 1 bit from
both). All that meet at a variant to which one of them is within 1 bit are linked; the bits they
differ in are counted once more. So no pair is missed, and a group of n gives about n links.

Variants are not shuffled one by one: a decision tree over fingerprint bits cuts the space of
variants into regions, and a fingerprint goes once to each region that holds one of its variants,
where those are laid out. The tree is built from a bounded sample of the distinct fingerprints, so
that regions hold about as many variants each, also where a third of all fingerprints differ in a
few bits only; it shares out the work and never decides a link."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import byte_words, document_columns
from cohortloom.llm.components import connected_components
from cohortloom.session import materialise

SHINGLE = 3
RADIUS = 3
SEED = 42
LEAF_FINGERPRINTS = 1500  # aimed at for a region
MAX_LEAVES = 65_536  # bounds the tree that every task gets


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 for a text without words."""
    import xxhash

    words = byte_words(text)
    if not words:
        return 0
    joined = b" ".join(words).lower()  # of bytes: A-Z only
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:len(words) - SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 255 * 256):  # byte counters hold 255
        part = hashes[i:i + 255 * 256]
        part = np.concatenate([part, np.zeros(-len(part) % 255, np.uint64)])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = bits.view(np.uint64).reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)
        counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    set_bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


def mix(values: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit values, for node ids without order or locality."""
    x = values.astype(np.uint64)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> np.uint64(33)) * np.uint64(factor)
    return x ^ x >> np.uint64(33)


def popcount(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values).astype(np.int64)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list:
    """Two columns that are equal for rows of equal doc_id and text only; neither is null."""
    known = F.col(doc_id).isNotNull()
    return [F.when(known, F.col(doc_id).cast("long")).otherwise(0).alias("_a"),
            F.xxhash64(known, F.col(text).cast("string")).alias("_b")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, the row's key, fingerprint (its 64 bits as a signed long) and node (the same, mixed) of each row."""

    def compute(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "_a": batch.column(2), "_b": batch.column(3),
                                              "fingerprint": pa.array(fps.view(np.int64)),
                                              "node": pa.array(mix(fps).view(np.int64))})

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *row_key())
            .mapInArrow(compute, "doc_id long, _a long, _b long, fingerprint long, node long"))


class Regions:
    """A binary tree over bits; its leaves cut the space of 64-bit values into regions."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.bit, self.child = [-1], [(-1, -1)]
        self.mask, self.value = [0], [0]  # of the fixed bits on the way to a node
        heap = [(-len(sample), 0, sample)]
        count = 1
        while heap and count < leaves:
            size, node, held = heapq.heappop(heap)
            if -size < 2:
                break
            ones = np.unpackbits(held.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            bit = int(np.argmin(np.abs(2 * ones - len(held))))
            if not 0 < ones[bit] < len(held):
                continue
            side = (held >> np.uint64(bit) & np.uint64(1)).astype(bool)
            self.bit[node] = bit
            self.child[node] = (len(self.bit), len(self.bit) + 1)
            for half, part in ((0, held[~side]), (1, held[side])):
                heapq.heappush(heap, (-len(part), len(self.bit), part))
                self.bit.append(-1)
                self.child.append((-1, -1))
                self.mask.append(self.mask[node] | 1 << bit)
                self.value.append(self.value[node] | half << bit)
            count += 1

    def route(self, fps: np.ndarray, reach: np.ndarray):
        """(leaf, fingerprints) for each leaf that holds a value within `reach` bits of them."""
        stack = [(0, fps, reach)]
        while stack:
            node, held, left = stack.pop()
            if not len(held):
                continue
            if self.bit[node] < 0:
                yield node, held
                continue
            side = (held >> np.uint64(self.bit[node]) & np.uint64(1)).astype(bool)
            for half in (0, 1):
                own = side == bool(half)
                keep = own | (left > 0)
                stack.append((self.child[node][half], held[keep], np.where(own, left, left - 1)[keep]))


def link_in_region(fps: np.ndarray, mask: int, value: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, other) between fingerprints whose variants meet in the region of values v
    with v & mask == value; enough of them to connect all that meet."""
    mask, value = np.uint64(mask), np.uint64(value)
    fps = np.unique(fps)
    away = popcount((fps ^ value) & mask)
    base = (fps & ~mask) | value
    one = np.uint64(1)
    free = np.array([one << np.uint64(j) for j in range(64) if not int(mask) >> j & 1], dtype=np.uint64)
    home, near = away == 0, away == 1
    # Variants within 1 bit, each with the smallest fingerprint that reaches it.
    keys = np.concatenate([base[home], base[near], (base[home][:, None] ^ free).ravel()])
    owner = np.concatenate([fps[home], fps[near], np.repeat(fps[home], len(free))])
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    spread = np.repeat(owner[first], np.diff(np.append(first, len(keys))))
    met = owner != spread
    a, b = [owner[met]], [spread[met]]
    keys, owner = keys[first], owner[first]
    if len(keys):
        odd = popcount(fps) % 2 == 1
        pairs = np.array([x ^ y for i, x in enumerate(free) for y in free[:i]], dtype=np.uint64)
        filter_bits = max(10, int(8 * len(keys)).bit_length())
        shift, factor = np.uint64(64 - filter_bits), np.uint64(0x9E3779B97F4A7C15)
        present = np.zeros(1 << filter_bits, dtype=bool)
        present[(keys * factor) >> shift] = True
        for which, steps in ((odd & (away == 2), np.zeros(1, np.uint64)), (odd & near, free), (odd & home, pairs)):
            of, at = fps[which], base[which]
            rows = max(1, 2_000_000 // max(1, len(steps)))
            for i in range(0, len(of) if len(steps) else 0, rows):
                asked = at[i:i + rows, None] ^ steps
                r, c = np.nonzero(present[(asked * factor) >> shift])
                asked = asked[r, c]
                found = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                hit = keys[found] == asked
                x, y = of[i:i + rows][r[hit]], owner[found[hit]]
                links = np.unique(np.stack([x, y])[:, x != y], axis=1)
                a.append(links[0])
                b.append(links[1])
    a, b = np.concatenate(a), np.concatenate(b)
    close = popcount(a ^ b) <= RADIUS
    return a[close], b[close]


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every value to the smallest one it is connected with."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for ends in (x, y, label[x], label[y]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = label != np.arange(len(values))
    return values[linked], values[label[linked]]


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b), in mixed ids, that connect exactly the fingerprints (a column of distinct
    values) that chains of links of 3 bits or fewer connect."""
    spark = nodes.sparkSession
    n = nodes.count()
    leaves = min(MAX_LEAVES, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // LEAF_FINGERPRINTS))
    share = min(0.5, 8 * leaves / max(1, n))
    sample = [r[0] for r in nodes.filter(F.pmod(F.xxhash64("fingerprint"), F.lit(1 << 20)) < share * (1 << 20))
              .select("fingerprint").limit(16 * leaves).collect()]
    tree = Regions(np.array(sample, dtype=np.int64).view(np.uint64), leaves)

    def route(batches):
        import pyarrow as pa

        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            out = list(tree.route(fps, 1 + popcount(fps) % 2))
            yield pa.RecordBatch.from_pydict({"leaf": pa.array([x for x, _ in out], pa.int32()),
                                              "held": pa.array([f.tobytes() for _, f in out], pa.binary())})

    def meet(key, table):
        import pyarrow as pa

        leaf = key[0].as_py()
        held = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("held")])
        a, b = spanning_links(*link_in_region(held, tree.mask[leaf], tree.value[leaf]))
        return pa.table({"a": pa.array(mix(a).view(np.int64)), "b": pa.array(mix(b).view(np.int64))})

    return (nodes.select("fingerprint").mapInArrow(route, "leaf int, held binary")
            .groupBy("leaf").applyInArrow(meet, "a long, b long").distinct())


def components(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored: the rows with their fingerprints, the root of each node, and of each root the smallest
    doc_id and the least row, by doc_id (null comes last) and key."""
    rows = materialise(fingerprints(docs), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "_a", "_b")).alias("least")
    nodes = materialise(rows.groupBy("fingerprint", "node").agg(F.min("doc_id").alias("first_id"), least), "nodes")
    roots = connected_components(links(nodes))
    rooted = materialise(nodes.join(roots, "node", "left").select(
        "node", "first_id", "least", F.coalesce("root", "node").alias("root")), "rooted")
    smallest = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.min("least").alias("least")),
                           "smallest")
    return rows, rooted, smallest


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id among all rows
    reachable over links of 3 differing bits or fewer.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows and equal
    doc_ids keep a row each. A null doc_id is never the smallest; a component of null ids only has
    a null component_id. Other columns are left behind; an empty table gives no row."""
    rows, rooted, smallest = components(docs)
    placed = materialise(rooted.join(smallest, "root").select("node", "component_id"), "placed")
    return (rows.join(placed, "node")
            .select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest doc_id, with the columns of documents.

    Rows without doc_id take part and come last; of rows with one doc_id and different texts one is
    least by a hash of the text, of rows equal in both any stays. Null and empty texts are one
    component; extra columns are left behind; an empty table gives no row."""
    docs = docs.select(*document_columns(docs))
    _, _, smallest = components(docs)
    keyed = docs.select("*", *row_key())
    return (keyed.join(smallest.select("least._a", "least._b"), ["_a", "_b"], "left_semi")
            .dropDuplicates(["_a", "_b"]).select(*docs.columns))
