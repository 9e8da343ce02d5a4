"""Gradient-boosted trees over many rows: the library's algorithm on histograms of joint bin codes.

`boost` grows the trees that the library's GBTClassifier grows from the same rows: the same
splits to choose from, the same draws of rows and features, the same gains, the same order of
nodes. What differs is the work. A row is binned once; features of few bins share one code,
so a level adds a row to a table for each code, where the library has one for each feature;
only the smaller child of a split is summed, the other is the parent less it. Sums may differ
from the library's in their last bits, and gains closer than TIE count as equal: of two features
that part a node's rows alike the first drawn is taken, where in the library last bits may decide.
"""

from __future__ import annotations

import pickle
import sys
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel, TaskContext, cloudpickle
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks carry these functions with them

CODE_SIZE = 1100  # values of a code at most, unless one feature has more bins
SAMPLE_ROWS = 20_000  # of which the features are grouped; the values of a code are those of all rows
MOST_VALUES = 8 * CODE_SIZE  # beyond these the sample misled, and the group is taken apart
CHUNK_ROWS = 1 << 15  # rows that are added to all tables before the next ones, so that they stay in the cache
LINEAGE = 50  # rounds after which the state of the rows comes from the bins and all trees again
TIE = 1e-12  # of the node's impurity; features with the same bins have sums that differ in the last bits
POSITIVE = float(1 << 26)  # a row's mark in sums that count rows and positive rows at once
EPSILON = np.finfo(float).eps
MASK = (1 << 64) - 1


# --- random draws as the library makes them ----------------------------------------------

def hash_seed(seed: int) -> int:
    """First state of an XORShiftRandom: Murmur3 of the seed's bytes."""

    def murmur(data: bytes, h: int) -> int:
        for i in (0, 4):
            k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
            k = ((k << 15 | k >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF
            h ^= k
            h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    data = (seed & MASK).to_bytes(8, "big")
    low = murmur(data, 0x3C074A61)
    return murmur(data, low) << 32 | low


def _step(s: int) -> int:
    s ^= s << 21 & MASK
    s ^= s >> 35
    return s ^ (s << 4 & MASK)


@lru_cache(maxsize=64)
def _leap(steps: int) -> list[int]:
    """What `steps` steps make of each bit of a state; steps are linear over bits."""
    if steps == 1:
        return [_step(1 << i) for i in range(64)]
    half = _leap(steps // 2)
    out = [_leaped(half, x) for x in half]
    return [_step(x) for x in out] if steps % 2 else out


def _leaped(table: list[int], s: int) -> int:
    out = 0
    while s:
        low = s & -s
        out ^= table[low.bit_length() - 1]
        s ^= low
    return out


def uniform(seed: int, n: int) -> np.ndarray:
    """The first n doubles of an XORShiftRandom, in lanes that start some steps apart."""
    if not n:
        return np.zeros(0)
    lanes = min(1024, 2 * n)
    steps = -(-2 * n // lanes)
    table, starts, s = _leap(steps), [], hash_seed(seed)
    for _ in range(lanes):
        starts.append(s)
        s = _leaped(table, s)
    now, out = np.array(starts, np.uint64), np.empty((steps, lanes), np.uint64)
    for i in range(steps):
        now = now ^ now << np.uint64(21)
        now ^= now >> np.uint64(35)
        now ^= now << np.uint64(4)
        out[i] = now
    drawn = out.T.ravel()[:2 * n].reshape(n, 2)
    high, low = drawn[:, 0] & np.uint64((1 << 26) - 1), drawn[:, 1] & np.uint64((1 << 27) - 1)
    return ((high << np.uint64(27)) + low).astype(np.float64) * 2.0 ** -53


def longs(seed: int):
    """nextLong of a java.util.Random."""
    s = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def word() -> int:
        nonlocal s
        s = (s * 0x5DEECE66D + 0xB) & (1 << 48) - 1
        return (s >> 16) - (1 << 32 if s >> 47 else 0)

    while True:
        yield (word() << 32) + word()


def feature_subset(features: int, wanted: int, seed: int) -> list[int]:
    """A reservoir of features, in the order in which ties are settled."""
    kept = list(range(wanted))
    for i, x in enumerate(uniform(seed, features - wanted).tolist()):
        at = int(x * (wanted + i + 1))
        if at < wanted:
            kept[at] = wanted + i
    return kept


# --- bins and codes ------------------------------------------------------------------------

@dataclass(frozen=True)
class Codes:
    """Features with more than one bin, several to a code: the rank of their joint value among those that occur.

    The joint value is the sum of bin times stride. Features that go together, such as a date
    and its month, have few joint values.
    """

    bins: tuple[int, ...]  # of every feature
    groups: tuple[tuple[int, ...], ...]
    values: tuple[np.ndarray, ...]  # joint values of each group, rising

    @staticmethod
    def planned(bins: list[int], sample: np.ndarray) -> list[list[int]]:
        """Groups of which a sample of binned rows has few joint values."""
        groups = []
        for f in sorted((f for f, n in enumerate(bins) if n > 1), key=lambda f: (-bins[f], f)):
            found = []
            for g, (members, at, size, product) in enumerate(groups):
                if product * bins[f] < 1 << 62:
                    joint = np.unique(at * bins[f] + sample[f], return_inverse=True)
                    if len(joint[0]) <= CODE_SIZE * 3 // 4:
                        found.append((len(joint[0]) / size, g, joint))
            if found:
                _, g, (values, at) = min(found, key=lambda x: x[:2])
                members, _, _, product = groups[g]
                groups[g] = [*members, f], at, len(values), product * bins[f]
            else:
                groups.append(([f], sample[f].astype(np.int64), bins[f], bins[f]))
        return [members for members, *_ in groups]

    @staticmethod
    def of(bins: list[int], groups: list[list[int]], values: list[np.ndarray]) -> Codes:
        """Groups with all the joint values that occur; those with too many by the product of their bins instead."""
        kept, all_values = [], []
        for members, found in zip(groups, values):
            if len(found) <= MOST_VALUES:
                kept.append(tuple(members))
                all_values.append(found)
                continue
            parts = []
            for f in members:
                if parts and np.prod([bins[x] for x in parts[-1]]) * bins[f] <= CODE_SIZE:
                    parts[-1].append(f)
                else:
                    parts.append([f])
            kept += map(tuple, parts)
            all_values += [np.arange(np.prod([bins[x] for x in part])) for part in parts]
        return Codes(tuple(bins), tuple(kept), tuple(all_values))

    def size(self, group: int) -> int:
        return len(self.values[group])

    def widest(self) -> int:
        return max(map(len, self.values), default=1)

    def encode(self, binned: np.ndarray) -> np.ndarray:
        """One row of codes for each group."""
        out = np.zeros((len(self.groups), binned.shape[1]), np.uint16 if self.widest() <= 1 << 16 else np.uint32)
        for g, members in enumerate(self.groups):
            out[g] = np.searchsorted(self.values[g], joint_values(binned, members, self.bins))
        return out

    def bin_table(self, f: int) -> tuple[int, np.ndarray]:
        """The group of a feature, and its bin for each value of the code."""
        g = next(g for g, members in enumerate(self.groups) if f in members)
        members = self.groups[g]
        stride = int(np.prod([self.bins[x] for x in members[:members.index(f)]], dtype=np.int64))
        return g, self.values[g] // stride % self.bins[f]

    def marginals(self, group: int, table: np.ndarray):
        """(feature, sums by slot and bin) from sums by slot and code."""
        slots = np.arange(len(table))[:, None]
        for f in self.groups[group]:
            n = self.bins[f]
            at = (slots * n + self.bin_table(f)[1]).ravel()
            yield f, np.bincount(at, table.ravel(), len(table) * n).reshape(len(table), n)


def joint_values(binned: np.ndarray, members, bins) -> np.ndarray:
    out, stride = np.zeros(binned.shape[1], np.int64), 1
    for f in members:
        out += binned[f] * np.int64(stride)
        stride *= bins[f]
    return out


# --- trees ------------------------------------------------------------------------------------

@dataclass
class Node:
    """Children of node i are 2i and 2i + 1. Statistics: rows, weight, sum and sum of squares of the target."""

    stats: np.ndarray
    level: int
    gain: float = -1.0
    feature: int = -1
    bin: int = -1
    tried: bool = False

    def prediction(self) -> float:
        return float(self.stats[2] / self.stats[1]) if self.stats[1] else 0.0

    def impurity(self) -> float:
        return float(_variance(self.stats))


@dataclass
class Tree:
    nodes: dict[int, Node] = field(default_factory=dict)

    def inner(self) -> dict[int, tuple[int, int]]:
        return {i: (n.feature, n.bin) for i, n in self.nodes.items() if n.feature >= 0}

    def leaf_values(self, weight: float) -> dict[int, float]:
        return {i: n.prediction() * weight for i, n in self.nodes.items() if n.feature < 0}


def _variance(stats: np.ndarray) -> np.ndarray:
    w, s, ss = stats[..., 1], stats[..., 2], stats[..., 3]
    some = np.where(w == 0, 1.0, w)
    return np.where(w == 0, 0.0, (ss - s * s / some) / some)


def _square(stats: np.ndarray) -> np.ndarray:
    """Square of the sum over the weight."""
    w, s = stats[..., 1], stats[..., 2]
    return s * s / np.where(w == 0, 1.0, w)


def walk(code: np.ndarray, codes: Codes, inner: dict[int, tuple[int, int]]) -> np.ndarray:
    """The node that each row reaches."""
    at = np.ones(code.shape[1], np.int32)
    every, width = np.arange(code.shape[1]), codes.widest()
    for level in range(max((i.bit_length() for i in inner), default=0)):
        low = 1 << level
        here = [i for i in range(low, 2 * low) if i in inner]
        if not here:
            break
        group, right = np.zeros(2 * low, np.int64), np.zeros((2 * low, width), np.int8)
        for i in here:
            f, most = inner[i]
            group[i], table = codes.bin_table(f)
            right[i, :len(table)] = table > most
        splits = np.zeros(2 * low, bool)
        splits[here] = True
        if level == 0:
            at = 2 + right[1][code[group[1]]].astype(np.int32)
            continue
        going = np.flatnonzero((at >= low) & splits[np.where(at < 2 * low, at, 0)]) if not splits[low:].all() or (at < low).any() else every
        node = at[going]
        at[going] = 2 * node + right.ravel()[node.astype(np.int64) * width + code[group[node], going]]
    return at


def best_split(node: Node, sums: np.ndarray, subset: list[int], bins: np.ndarray, least: int) -> tuple | None:
    """(gain, feature, bin, left, right) of the first of the best splits; None if no split is allowed."""
    some = [f for f in subset if bins[f] > 1]
    if not some:
        return None
    left = np.cumsum(sums[some], axis=1)
    total = left[:, -1:]
    right = total - left
    # the impurity less those of both sides; the squares cancel out
    gain = (_square(left) + _square(right) - _square(total)) / node.stats[1]
    inside = np.arange(sums.shape[1]) < bins[some][:, None] - 1
    gain = np.where(inside & (left[..., 0] >= least) & (right[..., 0] >= least), gain, -np.inf)
    top = gain.max()
    if not top > 0:
        return None
    where = np.flatnonzero(gain.ravel() >= max(top - TIE * node.impurity(), 0.0))[0]
    f, b = divmod(int(where), sums.shape[1])
    return float(gain[f, b]), some[f], b, left[f, b], right[f, b]


# --- rows -----------------------------------------------------------------------------------------

def _bins(values: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """One row of bins for each feature."""
    out = np.empty((len(thresholds), len(values)), np.uint8 if max(map(len, thresholds)) < 256 else np.uint32)
    for f, points in enumerate(thresholds):
        out[f] = np.searchsorted(points, values[:, f], "left")
    return out


def _binned(thresholds: list[np.ndarray], features: int):
    """A partition as one block: its number, labels, the weight of either label, and bins."""

    def run(batches):
        labels, weights, found = [], [], []
        for batch in batches:
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, features)
            labels.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int8))
            weights.append(batch.column(1).to_numpy(zero_copy_only=False))
            found.append(_bins(values, thresholds))
        if labels:
            label, weight = np.concatenate(labels), np.concatenate(weights)
            of_label = [np.unique(weight[label == x]) for x in (0, 1)]
            if max(map(len, of_label)) > 1:
                raise ValueError("rows of one label have different weights")
            weight = tuple(float(x[0]) if len(x) else 0.0 for x in of_label)
            block = (TaskContext.get().partitionId(), label, weight, np.concatenate(found, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.large_binary())], names=["block"])

    return run


def _targeted(block, pred: np.ndarray, round_no: int, cfg, squares=None) -> tuple:
    """The state of a block before a round: predictions, targets, the rows that the round draws, and the last tree's squares."""
    part, label, _, _ = block
    y = 2.0 * label - 1.0
    target = y if round_no == 0 else 4.0 * y / (1.0 + np.exp(2.0 * y * pred))
    drawn = np.ones(len(label), bool)
    if cfg.subsampling < 1.0:
        drawn = uniform(cfg.seed + round_no + part + 1, len(label)) < cfg.subsampling
    return block, pred, target, drawn, squares


def _squares(state: tuple, at: np.ndarray) -> np.ndarray:
    """Weighted squares of the targets by node."""
    (_, label, weight, _), _, target, drawn, _ = state
    return np.bincount(at, np.where(drawn, np.where(label, weight[1], weight[0]) * target * target, 0.0))


def _sums(state: tuple, codes: Codes, inner: dict, slots: dict[int, int]) -> tuple:
    """Rows, weight and sum of the target by slot, feature and bin; squares by node of this tree, and of the last."""
    (_, label, weight, code), _, target, drawn, last = state
    slot = np.full(2 * max(slots) + 2, -1, np.int64)
    slot[list(slots)] = list(slots.values())
    at = walk(code, codes, inner)
    of = slot[at]
    rows = np.flatnonzero(drawn & (of >= 0))
    of, label, target = of[rows], label[rows], target[rows]
    counts, first = 1.0 + POSITIVE * label, np.where(label, weight[1], weight[0]) * target
    tables = [np.zeros((2, len(slots) * codes.size(g))) for g in range(len(codes.groups))]
    for lo in range(0, len(rows), CHUNK_ROWS):
        some = slice(lo, lo + CHUNK_ROWS)
        for g, table in enumerate(tables):
            spot = of[some] * codes.size(g) + code[g][rows[some]]
            table[0] += np.bincount(spot, counts[some], table.shape[1])
            table[1] += np.bincount(spot, first[some], table.shape[1])
    out = np.zeros((len(slots), len(codes.bins), max(codes.bins), 3))
    for g, (both, first) in enumerate(tables):
        positive = np.floor(both / POSITIVE)
        for values, weights in ((both - positive * POSITIVE, (1.0, weight[0], 0.0)), (positive, (0.0, weight[1] - weight[0], 0.0)),
                                (first, (0.0, 0.0, 1.0))):
            for f, part in codes.marginals(g, values.reshape(len(slots), -1)):
                out[:, f, :part.shape[1]] += part[..., None] * np.array(weights)
    if not codes.groups:  # no feature has a second bin
        for k, values in enumerate((np.ones(len(rows)), np.where(label, weight[1], weight[0]), first)):
            out[:, 0, 0, k] = np.bincount(of, values, len(slots))
    return out, _squares(state, at), last


def _moved(state: tuple, codes: Codes, tree: tuple, round_no: int, cfg) -> tuple:
    """The state before a round, from that before the last round and its tree."""
    at = walk(state[0][3], codes, tree[0])
    return _targeted(state[0], state[1] + _values(tree)[at], round_no, cfg, _squares(state, at))


def _started(block: tuple, codes: Codes, trees: list, round_no: int, cfg) -> tuple:
    """The same from all trees so far."""
    pred = np.zeros(len(block[1]))
    for tree in trees:
        pred = pred + _values(tree)[walk(block[3], codes, tree[0])]
    return _targeted(block, pred, round_no, cfg)


def _rooted(state: tuple, codes: Codes) -> tuple:
    """The state without its block, and the sums of the root."""
    return *state[1:], _sums(state, codes, {}, {1: 0})


def _values(tree: tuple) -> np.ndarray:
    values = np.zeros(2 * max(tree[1]) + 2)
    values[list(tree[1])] = list(tree[1].values())
    return values


def _added(parts) -> np.ndarray | None:
    """Sum of arrays of different lengths."""
    total = None
    for part in parts:
        if part is None:
            continue
        if total is None or len(part) > len(total):
            part, total = (np.zeros(0) if total is None else total), part.copy()
        total[:len(part)] += part
    return total


def _settle(tree: Tree, squares: np.ndarray | None) -> None:
    """Squares of the leaves, which no later level has summed."""
    for i, n in tree.nodes.items():
        if squares is not None and np.isnan(n.stats[3]):
            n.stats[3] = squares[i] if i < len(squares) else 0.0


def _grown(blocks: RDD, state: RDD, codes: Codes, cfg, per_node: int, seed: int, last: Tree | None) -> Tree:
    """One tree, level by level; the nodes of a level in the order in which the library takes them."""
    bins, features = np.array(codes.bins), len(codes.bins)
    tree, draws, stack, known = Tree(), longs(seed), [1], {}
    while stack:
        # of two children the one with fewer rows is summed
        summed = [i for i in stack if i == 1 or (tree.nodes[i].stats[0], i) < (tree.nodes[i ^ 1].stats[0], i ^ 1)]
        slots, inner = {i: k for k, i in enumerate(summed)}, tree.inner()
        if stack == [1]:
            found = state.map(lambda x: x[4]).collect()
        else:
            found = blocks.zip(state).map(lambda x: _sums((x[0], *x[1][:4]), codes, inner, slots)).collect()
        total, squares = sum(x[0] for x in found), _added(x[1] for x in found)
        if last is not None and stack == [1]:
            _settle(last, _added(x[2] for x in found))
        now = {i: total[k] for i, k in slots.items()}
        now.update({i: known[i // 2] - now[i ^ 1] for i in stack if i not in now})
        if stack == [1]:
            first = codes.groups[0][0] if codes.groups else 0
            tree.nodes[1] = Node(np.append(now[1][first].sum(axis=0), np.nan), 0)
        _settle(tree, squares)
        # without any spread a child is a leaf
        order, stack, known = [i for i in stack if i == 1 or abs(tree.nodes[i].impurity()) >= EPSILON], [], now
        for i in order:
            node = tree.nodes[i]
            node.tried = True
            subset = feature_subset(features, per_node, next(draws)) if per_node < features else list(range(features))
            split = best_split(node, now[i], subset, bins, cfg.min_instances) if node.level < cfg.max_depth else None
            if split is None:
                continue
            node.gain, node.feature, node.bin, left, right = split
            for j, stats in ((2 * i, left), (2 * i + 1, right)):
                tree.nodes[j] = Node(np.append(stats, np.nan), node.level + 1)
                if node.level + 1 < cfg.max_depth:
                    stack.insert(0, j)
    return tree


def _thresholds(rows: DataFrame, library: GBTClassifier, cfg) -> tuple[list[np.ndarray], int]:
    """Split points of every feature, and features for each node, as the library chooses them."""
    jvm = SparkContext._active_spark_context._jvm
    classes = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    module = lambda name: classes.loadClass(f"org.apache.spark.ml.{name}$").getField("MODULE$").get(None)
    library._transfer_params_to_java()
    instances = module("util.DatasetUtils").extractInstances(library._java_obj, rows._jdf, jvm.scala.Some(2))
    algo = jvm.org.apache.spark.mllib.tree.configuration.Algo.Classification()
    nothing = jvm.PythonUtils.toScalaMap(jvm.java.util.HashMap())
    strategy = library._java_obj.getOldBoostingStrategy(nothing, algo).treeStrategy().copy()
    getattr(strategy, "algo_$eq")(jvm.org.apache.spark.mllib.tree.configuration.Algo.Regression())
    getattr(strategy, "impurity_$eq")(jvm.org.apache.spark.mllib.tree.impurity.Variance.instance())
    metadata = module("tree.impl.DecisionTreeMetadata").buildMetadata(instances, strategy, 1, str(cfg.feature_share))
    splits = module("tree.impl.RandomForest").findSplits(instances, metadata, cfg.seed)
    found = [np.array([s.threshold() for s in feature]) for feature in splits]
    return found, metadata.numFeaturesPerNode()


def boost(rows: DataFrame, library: GBTClassifier, cfg, rounds: int) -> GBTClassificationModel:
    """The model that the library fits to (is_churn, _weight, vector); rows of one label have one weight."""
    thresholds, per_node = _thresholds(rows, library, cfg)
    features = len(thresholds)
    bins = [len(t) + 1 for t in thresholds]
    columns = rows.select(F.col("is_churn").cast("double"), F.col("_weight").cast("double"), vector_to_array("vector").alias("v"))
    sample = np.array([r[0] for r in columns.select("v").limit(SAMPLE_ROWS).collect()]).reshape(-1, features)
    groups = Codes.planned(bins, _bins(sample, thresholds))
    binned = _kept(columns.mapInArrow(_binned(thresholds, features), "block binary").rdd.map(lambda r: pickle.loads(r[0])))
    kept, trees, past = [binned], [], []
    try:
        # of a group with more values the first suffice: it is taken apart
        found = binned.map(lambda b: [np.unique(joint_values(b[3], members, bins))[:MOST_VALUES + 1] for members in groups]).collect()
        codes = Codes.of(bins, groups, [np.unique(np.concatenate(x)) for x in zip(*found)])
        blocks = _kept(binned.map(lambda b: (*b[:3], codes.encode(b[3]))))
        kept.append(blocks)
        blocks.count()
        binned.unpersist()
        for m in range(rounds):
            if m % LINEAGE == 0:
                done = list(past)
                state = _kept(blocks.map(lambda block, m=m, done=done: _rooted(_started(block, codes, done, m, cfg), codes)))
            else:
                state = _kept(blocks.zip(kept[-1]).map(
                    lambda x, m=m, tree=past[-1]: _rooted(_moved((x[0], *x[1][:4]), codes, tree, m, cfg), codes)))
            kept.append(state)
            tree = _grown(blocks, state, codes, cfg, per_node, cfg.seed + m, trees[-1] if trees else None)
            if m:
                kept.pop(-2).unpersist()
            trees.append(tree)
            past.append((tree.inner(), tree.leaf_values(cfg.step_size if m else 1.0)))
            if (m + 1) % LINEAGE == 0 or m + 1 == rounds:
                squares = blocks.zip(state).map(lambda x, inner=past[-1][0]: _squares((x[0], *x[1][:4]), walk(x[0][3], codes, inner)))
                _settle(tree, _added(squares.collect()))
    finally:
        for rdd in kept:
            rdd.unpersist()
    return _model(trees, thresholds, library, cfg)


def _kept(rdd: RDD) -> RDD:
    """Kept as plain bytes, which every level reads; a batch has one element, so that two of these can be zipped as they are."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1)).persist(StorageLevel(True, True, False, True))


def _model(trees: list[Tree], thresholds: list[np.ndarray], library: GBTClassifier, cfg) -> GBTClassificationModel:
    context = SparkContext._active_spark_context
    jvm, gateway = context._jvm, context._gateway
    ml = jvm.org.apache.spark.ml

    def node(tree: Tree, i: int):
        n = tree.nodes[i]
        stats = gateway.new_array(jvm.double, 3)
        for k in range(3):
            stats[k] = float(n.stats[k + 1])
        calculator = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(stats, int(n.stats[0]))
        if n.feature < 0:
            return ml.tree.LeafNode(n.prediction(), -1.0 if n.tried else n.impurity(), calculator), n.prediction()
        (left, x), (right, y) = node(tree, 2 * i), node(tree, 2 * i + 1)
        if x is not None and x == y:
            return ml.tree.LeafNode(x, n.impurity(), calculator), x
        split = ml.tree.ContinuousSplit(n.feature, float(thresholds[n.feature][n.bin]))
        return ml.tree.InternalNode(n.prediction(), n.impurity(), n.gain, left, right, split, calculator), None

    of_trees = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(jvm.double, len(trees))
    for i, tree in enumerate(trees):
        of_trees[i] = ml.regression.DecisionTreeRegressionModel(node(tree, 1)[0], len(thresholds))
        weights[i] = cfg.step_size if i else 1.0
    model = ml.classification.GBTClassificationModel(library.uid, of_trees, weights, len(thresholds), 2)
    library._java_obj.copyValues(model, ml.param.ParamMap())
    found = GBTClassificationModel(model)
    found._transfer_params_from_java()
    return found
