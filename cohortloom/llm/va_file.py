"""Centroid clustering over a vector-approximation file.

Vectors of whole numbers are written to files of fixed width. Beside each stands its
approximation: per dimension the cell of four bits it falls into. For a set of centroids a table gives,
for each dimension and cell, the least and the greatest squared distance; their sums bound a vector's
distance to every centroid. A vector whose interval of one centroid lies below all others is
assigned by its approximation alone; the others are fetched and measured. Cell borders are chosen
from the data but never decide a result.

Rounds keep sums of the clusters: only vectors that changed their cluster are fetched to correct
them, so a round reads approximations, contested vectors and moved vectors. All sums are of whole
numbers, so results do not depend on files or order."""

from __future__ import annotations

import hashlib
import uuid
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import new_folder, open_folder
from cohortloom.session import materialise, remember

CELLS = 16
FILE_VECTORS = 65_536
BLOCK = 4096  # vectors bounded at once
GAP = 8  # vectors between two that are fetched which are rather read than skipped
LARGEST = 1 << 27  # of a component; distances then fit 64 bits for up to 64 dimensions
MANIFEST = "file string, n long, was binary"


def whole_vectors(table: DataFrame, dimensions: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """id, v: the rows whose vector has the given number of components, none null or not finite, as
    floor(scale * x). Vectors with a component of LARGEST or more cannot have their distances in 64
    bits and are left out too."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * float(scale) < LARGEST)
    return (table.select(F.col(id_column).cast("long").alias("id"),
                         F.transform(vector_column, lambda x: x.cast("double")).alias("v"))
            .filter(F.size("v") == dimensions).filter(F.forall("v", sound))
            .select("id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("int")).alias("v")))


def _matrix(column, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def cell_borders(vectors: DataFrame, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per dimension the least and greatest value and CELLS - 1 borders, where a normal distribution of
    the same mean and spread has its quantiles."""

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(0), dimensions).astype(np.float64)
                yield pa.RecordBatch.from_pydict({
                    "d": pa.array(range(dimensions), pa.int32()), "n": pa.array([len(v)] * dimensions, pa.int64()),
                    "lo": v.min(axis=0), "hi": v.max(axis=0), "s": v.sum(axis=0), "q": (v * v).sum(axis=0)})

    rows = (vectors.select("v").mapInArrow(measure, "d int, n long, lo double, hi double, s double, q double").groupBy("d")
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum("s") / F.sum("n")).alias("mean"),
                 (F.sum("q") / F.sum("n")).alias("square")).orderBy("d").collect())
    lo, hi = (np.array([r[c] for r in rows], np.int64) for c in ("lo", "hi"))
    mean, square = (np.array([r[c] for r in rows]) for c in ("mean", "square"))
    quantiles = np.array([NormalDist().inv_cdf(j / CELLS) for j in range(1, CELLS)])
    spread = np.sqrt(np.maximum(square - mean * mean, 0))
    return lo, hi, np.floor(mean[:, None] + spread[:, None] * quantiles).astype(np.int64)


def pack_cells(v: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Two dimensions a byte."""
    cells = np.zeros((len(v), v.shape[1] + v.shape[1] % 2), np.uint8)
    for d in range(v.shape[1]):
        cells[:, d] = np.searchsorted(borders[d], v[:, d], side="right")
    return cells[:, ::2] | cells[:, 1::2] << 4


def distance_tables(centroids: np.ndarray, lo: np.ndarray, hi: np.ndarray, borders: np.ndarray):
    """For each byte place and byte: least and greatest squared distance to each centroid in its two dimensions."""
    below = np.concatenate([lo[:, None], borders], axis=1)  # a cell holds below .. above
    above = np.maximum(below, np.concatenate([borders - 1, hi[:, None]], axis=1))
    c = centroids.T[:, :, None]  # dimension, centroid, cell
    left, right = below[:, None, :] - c, c - above[:, None, :]
    least = np.maximum(0, np.maximum(left, right)) ** 2
    most = np.maximum(np.abs(left), np.abs(right)) ** 2
    if len(lo) % 2:
        least, most = (np.concatenate([t, np.zeros_like(t[:1])]) for t in (least, most))
    byte = np.arange(256)
    return tuple(np.ascontiguousarray((t[::2][:, :, byte & 15] + t[1::2][:, :, byte >> 4]).transpose(0, 2, 1))
                 for t in (least, most))


class VaFile:
    """A file of n vectors: the vectors, their approximations, their ids, which ids are known."""

    def __init__(self, source, n: int, dimensions: int):
        self.source, self.n, self.width = source, n, 4 * dimensions
        self.cell_bytes = (dimensions + 1) // 2

    def vectors(self, at: np.ndarray) -> np.ndarray:
        """The vectors at ascending places; runs of near places are read at once."""
        if not len(at):
            return np.zeros((0, self.width // 4), np.int64)
        cut = np.flatnonzero(np.diff(at) > GAP) + 1
        out = []
        for run in np.split(at, cut):
            raw = self.source.read_at(int(run[-1] - run[0] + 1) * self.width, int(run[0]) * self.width)
            out.append(np.frombuffer(raw, "<i4").reshape(-1, self.width // 4)[run - run[0]])
        return np.concatenate(out).astype(np.int64)

    def cells(self, start: int, stop: int) -> np.ndarray:
        raw = self.source.read_at((stop - start) * self.cell_bytes, self.n * self.width + start * self.cell_bytes)
        return np.frombuffer(raw, np.uint8).reshape(-1, self.cell_bytes)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        at = self.n * (self.width + self.cell_bytes)
        raw = self.source.read_at(9 * self.n, at)
        return np.frombuffer(raw, "<i8", self.n), np.frombuffer(raw, bool, self.n, 8 * self.n)

    @staticmethod
    def content(ids: np.ndarray, known: np.ndarray, v: np.ndarray, borders: np.ndarray) -> bytes:
        return b"".join([v.astype("<i4").tobytes(), pack_cells(v, borders).tobytes(), ids.astype("<i8").tobytes(),
                         known.astype(bool).tobytes()])


def nearest(file: VaFile, centroids: np.ndarray, tables) -> tuple[np.ndarray, int]:
    """The nearest centroid of every vector (ties: the smaller number), and how many vectors were fetched."""
    least, most = tables
    out, fetched = np.zeros(file.n, np.int64), 0
    squares = (centroids * centroids).sum(axis=1)
    for start in range(0, file.n, BLOCK):
        stop = min(file.n, start + BLOCK)
        cells = file.cells(start, stop)
        low, high = (sum(t[p][cells[:, p]] for p in range(file.cell_bytes)) for t in (least, most))
        open_ = low <= high.min(axis=1, keepdims=True)
        choice = open_.argmax(axis=1)
        contested = np.flatnonzero(open_.sum(axis=1) > 1)
        if len(contested):
            v = file.vectors(start + contested)
            distance = squares - 2 * (v @ centroids.T)  # without the vector's own square
            choice[contested] = np.where(open_[contested], distance, np.iinfo(np.int64).max).argmin(axis=1)
            fetched += len(contested)
        out[start:stop] = choice
    return out, fetched


def write_va_files(vectors: DataFrame, dimensions: int, borders: np.ndarray, folder: str) -> DataFrame:
    """The stored manifest (file, n, was) of files with all vectors; `was` holds the clusters of the last round, none yet."""

    def write(batches):
        import pyarrow as pa

        held, n = [], 0

        def flush():
            ids, known, v = (np.concatenate(c) for c in zip(*held))
            fs, root = open_folder(folder)
            fs.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.va"
            with fs.open_output_stream(f"{root}/{name}") as sink:
                sink.write(VaFile.content(ids, known, v, borders))
            return pa.RecordBatch.from_pydict({"file": [name], "n": pa.array([len(ids)], pa.int64()),
                                               "was": pa.array([b""], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, FILE_VECTORS):
                part = batch.slice(at, FILE_VECTORS)
                if held and n + part.num_rows > FILE_VECTORS:
                    yield flush()
                    held, n = [], 0
                ids = part.column(0)
                held.append((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False),
                             _matrix(part.column(1), dimensions)))
                n += part.num_rows
        if held:
            yield flush()

    return materialise(vectors.select("id", "v").mapInArrow(write, MANIFEST), "va-manifest")


def cluster(table: DataFrame, k: int = 40, dimensions: int = 64, rounds: int = 5, scale: int = 256, seed: str = "2",
            id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that
    `whole_vectors` keeps.

    Centroids start as the k vectors with the smallest sha256 of "seed:id" (equal ids by components; a
    null id comes last) and in each round become the floors of their clusters' means; empty ones stay.
    Rows with equal or null id keep a row each; fewer than k vectors give fewer centroids; other
    columns are left behind; an empty table gives no row."""
    spark = table.sparkSession
    vectors = whole_vectors(table, dimensions, scale, id_column, vector_column)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.orderBy(key.asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dimensions)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], f"{id_column} long, cluster int, distance long, cluster_inertia long, "
                                         "inertia long, centroid_sha256 string")
    lo, hi, borders = cell_borders(vectors, dimensions)
    folder = remember(new_folder(spark, "va-files"))
    state = write_va_files(vectors, dimensions, borders, folder)
    n_files = state.count()
    sums = np.zeros((k, dimensions + 1), np.int64)  # the last column counts

    def opened(name, n):
        fs, root = open_folder(folder)
        return VaFile(fs.open_input_file(f"{root}/{name}"), n, dimensions)

    def one_round(centroids):
        def run(batches):
            import pyarrow as pa

            tables = distance_tables(centroids, lo, hi, borders)
            for batch in batches:
                for row in batch.to_pylist():
                    file = opened(row["file"], row["n"])
                    now, fetched = nearest(file, centroids, tables)
                    was = np.frombuffer(row["was"], "<i4") if row["was"] else np.full(file.n, -1)
                    moved = np.flatnonzero(now != was)
                    change = np.zeros((k, dimensions + 1), np.int64)
                    for i in range(0, len(moved), BLOCK):
                        at = moved[i:i + BLOCK]
                        v = np.concatenate([file.vectors(at), np.ones((len(at), 1), np.int64)], axis=1)
                        np.add.at(change, now[at], v)
                        left = was[at] >= 0
                        np.subtract.at(change, was[at][left], v[left])
                    file.source.close()
                    yield pa.RecordBatch.from_pydict({
                        "file": [row["file"]], "n": pa.array([file.n], pa.int64()),
                        "was": pa.array([now.astype("<i4").tobytes()], pa.binary()),
                        "fetched": pa.array([fetched + len(moved)], pa.int64()),
                        "change": pa.array([change.ravel().tolist()], pa.list_(pa.int64()))})
        return run

    for n in range(rounds):
        state = materialise(state.select("file", "n", "was").repartition(n_files).mapInArrow(
            one_round(centroids), f"{MANIFEST}, fetched long, change array<long>"), f"va-round-{n}")
        for r in state.select(F.posexplode("change")).groupBy("pos").agg(F.sum("col").alias("s")).collect():
            sums.flat[r.pos] += r.s
        counts = sums[:, -1:]
        moved = np.where(counts > 0, sums[:, :-1] // np.maximum(counts, 1), centroids)
        if (moved == centroids).all():  # all further rounds would repeat this one
            break
        centroids = moved

    def last(batches):
        import pyarrow as pa

        tables = distance_tables(centroids, lo, hi, borders)
        for batch in batches:
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = opened(name, n)
                now, _ = nearest(file, centroids, tables)
                ids, known = file.ids()
                for i in range(0, n, BLOCK):
                    at = np.arange(i, min(n, i + BLOCK))
                    away = file.vectors(at) - centroids[now[at]]
                    yield pa.RecordBatch.from_pydict({
                        "id": pa.array(ids[at], mask=~known[at]), "cluster": pa.array(now[at], pa.int32()),
                        "distance": pa.array((away * away).sum(axis=1))})
                file.source.close()

    placed = materialise(state.select("file", "n").repartition(n_files).mapInArrow(
        last, "id long, cluster int, distance long"), "va-placed")
    inertia = {r.cluster: r.s for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = spark.createDataFrame(
        [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
         for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (placed.join(F.broadcast(named), "cluster")  # a row per cluster: k at most
            .select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
