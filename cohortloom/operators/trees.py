"""Boosted trees of Spark ML grown in one job.

Spark's own fit starts a job for every level of every tree, some 5,000 for 400 trees of depth 12, and the
start of a job takes longer than its work. Here the rows of the fit stay with their tasks, as a byte per
feature, and the tasks grow all trees in one job; where there are several, they add up their sums of a level
through files of the shared folder. The trees are those of Spark: the same thresholds, rows and features drawn, gains and ends."""

from __future__ import annotations

import json
import re
import sys
import time
import uuid
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cohortloom.session import is_there, remember, shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks may run where the package is not installed

EPSILON = 2.0 ** -52  # an impurity below it is none
SAMPLE = 10_000  # rows that thresholds are found from
SCORED = 4_096  # rows walked through a tree at once
HELD = 1 << 25  # bytes of rows that a task scores together
NODES = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, "
         "gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, "
         "numCategories int>>")


def address(path: str) -> str:
    """A path as a URI that pyarrow understands."""
    return re.sub(r"^file:/+", "file:///", path)


# ---------------------------------------------------------------- draws of Spark and Java, many at once
def _hash(words: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Murmur3 of eight bytes, given as two words."""
    turn = lambda x, n: (x << np.uint32(n)) | (x >> np.uint32(32 - n))
    for k in words:
        h = turn(h ^ (turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h = h ^ np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


class XorShift:
    """Spark's XORShiftRandom for many seeds side by side."""

    def __init__(self, seeds: np.ndarray):
        seeds = np.asarray(seeds, np.int64).view(np.uint64)
        words = ((seeds >> np.uint64(32)).astype(np.uint32).byteswap(), seeds.astype(np.uint32).byteswap())
        low = _hash(words, np.full(len(seeds), 0x3C074A61, np.uint32))
        self.state = (_hash(words, low).astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)

    def bits(self, n: int) -> np.ndarray:
        x = self.state
        x = x ^ (x << np.uint64(21))
        x ^= x >> np.uint64(35)
        x ^= x << np.uint64(4)
        self.state = x
        return x & np.uint64((1 << n) - 1)

    def doubles(self) -> np.ndarray:
        return ((self.bits(26) << np.uint64(27)) + self.bits(27)) * 2.0 ** -53


class JavaLongs:
    """The longs of a java.util.Random."""

    A, C, MASK, CHUNK = 0x5DEECE66D, 0xB, (1 << 48) - 1, 1 << 12
    steps: np.ndarray | None = None

    def __init__(self, seed: int):
        self.state = (seed ^ self.A) & self.MASK
        if JavaLongs.steps is None:
            a, c, steps = 1, 0, []
            for _ in range(self.CHUNK):
                a, c = a * self.A & self.MASK, (c * self.A + self.C) & self.MASK
                steps.append((a, c))
            JavaLongs.steps = np.array(steps, np.uint64).T

    def take(self, n: int) -> np.ndarray:
        out, todo = [], 2 * n
        while todo:
            a, c = self.steps[:, :todo]
            out.append((a * np.uint64(self.state) + c) & np.uint64(self.MASK))
            self.state, todo = int(out[-1][-1]), todo - len(a)
        ints = (np.concatenate(out) >> np.uint64(16)).astype(np.uint32).view(np.int32).astype(np.int64) if out else np.zeros(0, np.int64)
        return (ints[::2] << 32) + ints[1::2]


def features_of_nodes(seeds: np.ndarray, features: int, k: int) -> np.ndarray:
    """The k features that each node may split by, by reservoirs over all of them: a row for each seed."""
    out = np.repeat(np.arange(k)[None], len(seeds), axis=0)
    if k < features and len(seeds):
        random = XorShift(seeds)
        for item in range(k, features):
            place = (random.doubles() * (item + 1)).astype(np.int64)
            hit = np.flatnonzero(place < k)
            out[hit, place[hit]] = item
    return out


def rows_of_trees(n: int, seeds: np.ndarray, share: float) -> np.ndarray:
    """Bits, a row of them for each row of the fit: the trees it is drawn for, without replacement."""
    out, random = np.empty((n, -(-len(seeds) // 8)), np.uint8), XorShift(seeds)
    for i in range(n):
        out[i] = np.packbits(random.doubles() < share)
    return out


# ---------------------------------------------------------------- thresholds
def thresholds_of(counts: dict[float, float], n: float, splits: int) -> list[float]:
    """Thresholds of a feature from the counts of its values other than zero, among n rows."""
    zeros = n - sum(counts.values())
    if zeros > EPSILON * sum(counts.values()) * 100:
        counts = counts | {0.0: zeros}
    values = sorted(counts)
    if len(values) - 1 <= splits:
        return [(a + b) / 2.0 for a, b in zip(values, values[1:])]
    stride = n / (splits + 1)
    out, seen, target = [], counts[values[0]], stride
    for a, b in zip(values, values[1:]):
        before, seen = seen, seen + counts[b]
        if abs(before - target) < abs(seen - target):
            out.append((a + b) / 2.0)
            target += stride
    return out


def find_thresholds(rows: DataFrame, n: int, features: int, seed: int, max_bins: int) -> list[np.ndarray]:
    """Thresholds of each feature of `x`, from a sample where there are many rows."""
    share = max(max_bins ** 2, SAMPLE) / n
    if share < 1:
        spark = rows.sparkSession
        drawn = rows._jdf.javaRDD().rdd().sample(False, share, int(XorShift(np.array([seed])).bits(32)[0].astype(np.uint32).view(np.int32)))
        rows = DataFrame(spark._jsparkSession.createDataFrame(drawn.toJavaRDD(), rows._jdf.schema()), spark)
    found = defaultdict(dict)
    for r in rows.select(F.posexplode("x")).filter("col <> 0").groupBy("pos", "col").count().collect():  # of SAMPLE rows at most
        found[r.pos][r.col] = float(r["count"])
    splits = min(max_bins, n) - 1
    return [np.array(thresholds_of(found[f], min(share, 1.0) * n, splits) if f in found else []) for f in range(features)]


# ---------------------------------------------------------------- one tree
def variance(s: np.ndarray) -> np.ndarray:
    """Impurity from count, sum and sum of squares."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(s[0] == 0, 0.0, (s[2] - s[1] * s[1] / s[0]) / s[0])


class Tree:
    """Nodes of a tree in the order in which they come up, each after its parent."""

    def __init__(self, parts: dict[str, list[np.ndarray]]):
        self.stats = np.concatenate(parts["stats"], axis=1)
        n = self.stats.shape[1]
        self.impurity, self.gain = np.concatenate(parts["impurity"]), np.full(n, -1.0)
        self.feature, self.bin, self.left = np.full(n, -1), np.full(n, -1), np.full(n, -1)  # the right child comes next
        if parts["split"]:
            ids = np.concatenate(parts["split"])
            for name in ("gain", "feature", "bin", "left"):
                getattr(self, name)[ids] = np.concatenate(parts[name])


def grow(bins: np.ndarray, n_bins: np.ndarray, stats: np.ndarray, impurity, size_of, draw, depth: int, min_gain: float,
         min_rows: int, add_up) -> tuple[Tree, np.ndarray]:
    """A tree and the node each row ends at.

    `bins` holds a byte for each row and feature, `stats` a row for each sum, `draw` gives the features of the
    next so many nodes, `add_up` the sums of all tasks."""
    parts = defaultdict(list)
    rows, at = np.arange(len(bins)), np.zeros(len(bins), np.int64)  # rows under way and their nodes in the level
    ends, ids, made = np.zeros(len(bins), np.int64), np.zeros(1, np.int64), 1
    features, flat = bins.shape[1], bins.ravel()
    node_stats = node_impurity = None
    for level in range(depth + 1):
        subset = draw(len(ids))
        k = subset.shape[1]
        width = n_bins[subset].ravel()
        ends_at = np.cumsum(width)
        base, size = ends_at - width, int(ends_at[-1])
        of_rows, mine, sums = stats[:, rows], rows * features, np.zeros((len(stats), size))
        for j in range(k):
            place = flat.take(mine + subset[:, j].take(at)) + base[j::k].take(at)
            for total, s in zip(sums, of_rows):
                total += np.bincount(place, s, size)
        sums = add_up(sums)
        for b in range(1, int(width.max())):  # running sums of each feature of each node
            here = base[width > b] + b
            sums[:, here] += sums[:, here - 1]
        whole = np.ones(size, bool)
        whole[ends_at - 1] = False
        cut = np.flatnonzero(whole)
        slot = np.repeat(np.arange(len(width)), width - 1)
        node = slot // k
        left = sums[:, cut]
        right = sums[:, ends_at[slot] - 1] - left
        if level == 0:
            node_stats = left[:, :1] + right[:, :1] if len(cut) else sums[:, ends_at[:1] - 1]
            node_impurity = impurity(node_stats)
            parts["stats"].append(node_stats), parts["impurity"].append(node_impurity)
        n_left, n_right = size_of(left), size_of(right)
        of_left, of_right = impurity(left), impurity(right)
        with np.errstate(divide="ignore", invalid="ignore"):
            n = n_left + n_right
            gain = node_impurity[node] - n_left / n * of_left - n_right / n * of_right
            gain[(n_left < min_rows) | (n_right < min_rows) | ~(gain >= min_gain)] = -np.inf
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        best = np.full(len(ids), -np.inf)
        if len(starts):
            best[node[starts]] = np.maximum.reduceat(gain, starts)
        first = np.flatnonzero((gain == best[node]) & (gain > 0))
        first = first[np.flatnonzero(np.diff(node[first], prepend=-1))]  # a cut for each node that is split
        if level == depth or not len(first):
            break
        split = node[first]
        children = made + 2 * np.arange(len(first))
        made += 2 * len(first)
        feature, at_bin = subset.ravel()[slot[first]], cut[first] - base[slot[first]]
        both = np.stack([left[:, first], right[:, first]], axis=2).reshape(len(stats), -1)
        impurities = np.stack([of_left[first], of_right[first]], axis=1).ravel()
        for name, values in (("stats", both), ("impurity", impurities), ("split", ids[split]), ("gain", gain[first]),
                             ("feature", feature), ("bin", at_bin), ("left", children)):
            parts[name].append(values)
        which = np.full(len(ids), -1)
        which[split] = np.arange(len(first))
        which = which[at]
        go = which >= 0
        rows, which = rows[go], which[go]
        child = 2 * which + (flat.take(rows * features + feature.take(which)) > at_bin.take(which))
        ends[rows] = children[0] + child
        open_ = np.flatnonzero(np.abs(impurities) >= EPSILON)[::-1] if level + 1 < depth else np.zeros(0, np.int64)  # the last comes first
        if not len(open_):
            break
        ids, node_impurity = children[0] + open_, impurities[open_]
        to = np.full(2 * len(first), -1)
        to[open_] = np.arange(len(open_))
        at = to[child]
        rows, at = rows[at >= 0], at[at >= 0]
    return Tree(parts), ends


# ---------------------------------------------------------------- boosting
def _read(batches, thresholds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Labels, and the bins of the rows of a task."""
    labels, bins, kind = [], [], np.min_scalar_type(max(map(len, thresholds)))
    for batch in batches:
        y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
        if not np.isin(y, (0.0, 1.0)).all():
            raise ValueError("labels must be 0 or 1")
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), len(thresholds))
        labels.append(y)
        bins.append(np.stack([np.searchsorted(t, x[:, f]) for f, t in enumerate(thresholds)], axis=1).astype(kind))
    return (np.concatenate(labels), np.concatenate(bins)) if labels else (np.zeros(0), np.zeros((0, len(thresholds)), kind))


def _adder(context, tasks: int, folder: str):
    """Adds up an array over all tasks, in the same order in each, through files of the shared folder; the
    context's own gathering waits for up to a second a time."""
    if tasks == 1:
        return lambda a: a
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(f"{folder}-{context.allGather(uuid.uuid4().hex)[0]}")  # another at each attempt
    files.create_dir(path)
    me, at = context.partitionId(), count()
    name = lambda step, task: f"{path}/{step}-{task}"

    def add_up(a: np.ndarray) -> np.ndarray:
        step = next(at)
        with files.open_output_stream(name(step, f"{me}.new")) as out:
            out.write(a.tobytes())
        files.move(name(step, f"{me}.new"), name(step, me))
        total = np.zeros(a.shape)
        for task in range(tasks):
            wait = 0.0005
            while task != me and files.get_file_info(name(step, task)).type == fs.FileType.NotFound:
                time.sleep(wait := min(wait * 1.5, 0.1))
            if task == me:
                total += a
                continue
            with files.open_input_stream(name(step, task)) as said:
                total += np.frombuffer(said.read()).reshape(a.shape)
        if step:
            files.delete_file(name(step - 1, me))  # whoever has written this step has read the one before
        return total

    return add_up


def boosted(batches, context, tasks: int, folder: str, thresholds: list[np.ndarray], trees: int, depth: int, rate: float, share: float, k: int,
            min_gain: float, min_rows: int, seed: int):
    """The trees of a boosted model, one after the other: each fits what logistic loss the ones before leave."""
    labels, bins = _read(batches, thresholds)
    features, sign, n_bins = len(thresholds), 2 * labels - 1, np.array([len(t) + 1 for t in thresholds])
    add_up = _adder(context, tasks, folder)
    drawn = rows_of_trees(len(labels), seed + np.arange(trees) + context.partitionId() + 1, share) if share < 1 else None
    score = np.zeros(len(labels))
    for m in range(trees):
        weight = ((drawn[:, m >> 3] >> np.uint8(7 - (m & 7))) & 1).astype(float) if drawn is not None else np.ones(len(labels))
        with np.errstate(over="ignore"):
            left = 4.0 * sign / (1.0 + np.exp(2.0 * sign * score)) if m else sign
        longs = JavaLongs(seed + m)
        draw = (lambda n, longs=longs: features_of_nodes(longs.take(n), features, k)) if k < features else lambda n: np.repeat(np.arange(features)[None], n, axis=0)
        tree, ends = grow(bins, n_bins, np.stack([weight, weight * left, weight * left * left]), variance, lambda s: s[0], draw,
                          depth, min_gain, min_rows, add_up)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(tree.stats[0] == 0, 0.0, tree.stats[1] / tree.stats[0])
        score += value[ends] * (rate if m else 1.0)
        if context.partitionId() == 0:
            yield m, tree, value


def node_rows(m: int, tree: Tree, value: np.ndarray, thresholds: list[np.ndarray]):
    """The nodes of a tree as rows of a stored model."""
    import pyarrow as pa

    n, inner = len(value), tree.left >= 0
    ints = lambda a: pa.array(np.asarray(a, np.int32))
    lists = lambda offsets, values: pa.ListArray.from_arrays(ints(offsets), pa.array(values, pa.float64()))
    at = np.array([thresholds[f][b] for f, b in zip(tree.feature[inner], tree.bin[inner])], float)
    split = pa.StructArray.from_arrays([ints(tree.feature), lists(np.r_[0, np.cumsum(inner)], at), ints(np.full(n, -1))],
                                       ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    s = len(tree.stats)
    nodes = pa.StructArray.from_arrays(
        [ints(np.arange(n)), pa.array(value), pa.array(tree.impurity), lists(s * np.arange(n + 1), tree.stats.T.ravel()),
         pa.array(tree.stats[0].astype(np.int64)), pa.array(tree.gain), ints(tree.left), ints(np.where(inner, tree.left + 1, -1)), split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.RecordBatch.from_arrays([ints(np.full(n, m)), nodes], ["treeID", "nodeData"])


class BoostedTrees(GBTClassifier):
    """Spark's classifier with a fit of one job; a share of the features is given as a fraction."""

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        spark, get = dataset.sparkSession, lambda name: self.getOrDefault(name)
        rows = dataset.select(F.col(get("labelCol")).cast("double").alias("y"), vector_to_array(get("featuresCol")).alias("x"))
        n, features = rows.agg(F.count("*"), F.max(F.size("x"))).first()
        if not n or not features:
            return super()._fit(dataset)  # says what is missing
        several = rows.rdd.getNumPartitions() > 1 and spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true"
        if not several:  # tasks that add up must all run at once
            rows = rows.coalesce(1)
        trees, seed, subset = get("maxIter"), get("seed"), get("featureSubsetStrategy")
        thresholds = find_thresholds(rows, n, features, seed, get("maxBins"))
        settings = {"trees": trees, "depth": get("maxDepth"), "rate": get("stepSize"), "share": get("subsamplingRate"),
                    "k": features if subset in ("auto", "all") else -int(-float(subset) * features // 1), "min_gain": get("minInfoGain"),
                    "min_rows": get("minInstancesPerNode"), "seed": seed}

        path = remember(f"{shared_folder(spark).rstrip('/')}/boosted-{uuid.uuid4().hex}")
        folder = address(f"{path}/sums")

        def run(batches):
            from pyspark import BarrierTaskContext, TaskContext

            context = BarrierTaskContext.get() if several else TaskContext.get()
            tasks = len(context.getTaskInfos()) if several else 1
            for m, tree, value in boosted(batches, context, tasks, folder, thresholds, **settings):
                yield node_rows(m, tree, value, thresholds)

        rows.mapInArrow(run, NODES, barrier=several).repartition("treeID").write.parquet(f"{path}/data")
        about = {"timestamp": 0, "sparkVersion": spark.version}
        named = lambda found: {p.name: v for p, v in found.items()}
        whole = {"class": "org.apache.spark.ml.classification.GBTClassificationModel", **about, "uid": self.uid, "paramMap": named(self._paramMap),
                 "defaultParamMap": named(self._defaultParamMap), "numFeatures": features, "numTrees": trees}
        one = lambda m: json.dumps({"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", **about, "uid": f"{self.uid}_{m}",
                                    "paramMap": {"maxDepth": get("maxDepth")}, "defaultParamMap": {}})
        spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame([(m, one(m), get("stepSize") if m else 1.0) for m in range(trees)], "_1 int, _2 string, _3 double") \
            .coalesce(1).write.parquet(f"{path}/treesMetadata")
        model = GBTClassificationModel.load(path)
        model.stored_at = path
        return model


# ---------------------------------------------------------------- scores
class Scorer:
    """The trees of a stored model, each as arrays that fit a core's cache; row by row, all trees would be
    walked through memory again for every row."""

    def __init__(self, files, path: str, weights: list[float], features: int):
        import pyarrow.parquet as pq

        table = pq.read_table(path, filesystem=files).combine_chunks()
        node = table.column("nodeData").chunk(0)
        of = lambda c, a=node: a.field(c).to_numpy(zero_copy_only=False)
        order = np.lexsort((of("id"), table.column("treeID").to_numpy()))
        tree, value, left, right = (a[order] for a in (table.column("treeID").to_numpy(), of("prediction"), of("leftChild"), of("rightChild")))
        split = node.field("split")
        feature, inner = of("featureIndex", split)[order], left >= 0
        at = np.zeros(len(tree))
        threshold = split.field("leftCategoriesOrThreshold")
        at[(threshold.value_lengths().to_numpy(zero_copy_only=False) > 0)] = threshold.flatten().to_numpy()
        at = at[order]
        self.weights = weights
        self.cuts = [np.unique(at[inner & (feature == f)]) for f in range(features)]
        self.kind = np.min_scalar_type(max(map(len, self.cuts), default=0) + 1)
        cut = np.zeros(len(tree), np.int64)
        for f, values in enumerate(self.cuts):
            mine = inner & (feature == f)
            cut[mine] = np.searchsorted(values, at[mine])
        self.trees = []
        for a, b in zip(*(lambda s: (s, np.r_[s[1:], len(tree)]))(np.searchsorted(tree, np.arange(len(weights))))):
            own, i = np.arange(b - a), inner[a:b]
            to = np.stack([np.where(i, left[a:b], own), np.where(i, right[a:b], own)], axis=1).ravel().astype(np.int64)
            self.trees.append((np.where(i, feature[a:b], 0).astype(np.int64), np.where(i, cut[a:b], 0).astype(self.kind), to, value[a:b]))

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Each value's place among its feature's cuts."""
        out = np.empty(x.shape, self.kind)
        for f, cuts in enumerate(self.cuts):
            out[:, f] = np.searchsorted(cuts, x[:, f]) if len(cuts) != 1 else ~(x[:, f] <= cuts[0])
        return out

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """Weighted sums of the trees' values; rows that are equal to the model, as most windows of a person
        are to the one before, walk the trees once."""
        mix, code = np.random.default_rng(1).integers(1 << 62, size=bins.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.zeros(len(bins), np.uint64)
        for f, m in enumerate(mix):
            code += bins[:, f] * m
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        if (bins[first][which] == bins).all():  # else two that differ share a code
            bins = bins[first]
        else:
            which = np.arange(len(bins))
        return np.concatenate([self._walk(bins[i:i + SCORED]) for i in range(0, len(bins), SCORED)] or [np.zeros(0)])[which]

    def _walk(self, bins: np.ndarray) -> np.ndarray:
        n = len(bins)
        flat, mine, out = bins.ravel(), np.arange(n) * bins.shape[1], np.zeros(n)
        for w, (feature, cut, to, value) in zip(self.weights, self.trees):
            at = np.zeros(n, np.int64)
            while True:  # a leaf leads to itself
                place = feature.take(at)
                place += mine
                right = flat.take(place) > cut.take(at)
                before, at = at, to.take(2 * at + right)
                if np.array_equal(before, at):
                    break
            out += w * value.take(at)
        return out


def boosted_scores(rows: DataFrame, model: GBTClassificationModel, keys: tuple[str, ...]) -> DataFrame:
    """Probability of the positive class by a boosted model for rows that have its features."""
    path = getattr(model, "stored_at", None)
    if path is None or not is_there(rows.sparkSession, f"{path}/data"):
        path = model.stored_at = remember(f"{shared_folder(rows.sparkSession).rstrip('/')}/boosted-{uuid.uuid4().hex}")
        model.write().save(path)
    folder, weights, features = address(f"{path}/data"), [float(w) for w in model.treeWeights], model.numFeatures

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        scorer, held, bins = None, [], []

        def scored():
            with np.errstate(over="ignore"):
                score = 1.0 - 1.0 / (1.0 + np.exp(2.0 * scorer.margins(np.concatenate(bins))))
            for batch in held:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score[:len(batch)])], [*keys, "model_score"])
                score = score[len(batch):]
            held.clear(), bins.clear()

        for batch in batches:
            scorer = scorer or Scorer(*fs.FileSystem.from_uri(folder), weights, features)
            held.append(batch.select(list(keys)))
            bins.append(scorer.bins(batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), features)))
            if sum(b.nbytes for b in bins) > HELD:
                yield from scored()
        if held:
            yield from scored()

    rows = rows.select(*keys, vector_to_array(model.getFeaturesCol()).alias("_x"))
    kinds = StructType([*(rows.schema[c] for c in keys), StructField("model_score", DoubleType())])
    return rows.mapInArrow(run, kinds)
