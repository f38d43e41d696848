"""Random forests on sparse rows, grown level by level for all trees of all targets together.

A row is kept as the features that are not zero in it, each with the number of its bin, so its size does not depend on
the number of features. One pass over the rows grows all trees by one level: rows step to their nodes, tasks add up
the weights by node, feature, bin and class, a shuffle brings the sums of a node together, and its best split is
chosen there. There are as many passes as the trees are deep, whatever the number of their nodes. Only the splits of a
level come to the driver, which holds the model as Spark's own forests do.

As in Spark's forests, rows enter a tree with a Poisson weight, a node considers the square root of the number of features
(here each feature is drawn by a hash, so that is the expected number), features have up to 32 bins, splits are
chosen by Gini impurity, and a row's probabilities are the mean of its leaves' shares. Values are not negative.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 32  # of a feature, the zeros included
CHUNK_ROWS = 1 << 16  # rows that a task holds at a time; a row takes a byte a tree, more where a level has many nodes
SCORED_ROWS = 1 << 14  # rows that are scored together; a row takes 4 bytes a tree
# Fixed value: binary digits that are dropped before a feature's values are counted; nine stay
COARSE = ~np.int64((1 << 14) - 1)
NO_CELL = (1 << 32) - 1  # of no feature, because their numbers are smaller than 2^27 - 1
_WEIGHTS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])  # Poisson distribution with mean 1
_BOUNDS = np.ceil(_WEIGHTS * 2.0**53).astype(np.uint64)  # the same for whole numbers of 53 bits
_BY_TOP = np.searchsorted(_BOUNDS, np.arange(1 << 16, dtype=np.uint64) << np.uint64(37), side="right").astype(np.uint8)  # by their highest 16 bits
_UNSURE = np.uint8(255)
_BY_TOP[np.diff(_BY_TOP, append=_UNSURE) > 0] = _UNSURE  # a bound lies among the numbers with these
# Relative costs, measured: of an entry looked at by itself while cells are added up and while rows step, of a posting, of a feature that
# may be drawn, and of a label that is passed over
ENTRY_COST, STEP_COST, POSTING_COST, FEATURE_COST, PASS_COST = 7, 3, 12, 4, 4
POSTINGS_AT_ONCE, FEW_ROWS = 1 << 16, 1 << 15  # few enough for a core's cache


@dataclass
class Trees:
    """The trees of one target: nodes of all trees one after the other; ``left`` is -1 in a leaf, the right child is the next node."""

    roots: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    shares: np.ndarray  # classes of a leaf


# ------------------------------------------------------------------------------------------------ sparse rows


def nonzeros(vector: Column) -> Column:
    """``indices, values`` of a vector's entries that are not zero."""
    raw = F.unwrap_udt(vector)
    places = F.coalesce(raw["indices"], F.sequence(F.lit(0), F.size(raw["values"]) - 1))
    pairs = F.filter(F.arrays_zip(places.alias("i"), raw["values"].alias("v")), lambda p: p["v"] != 0)
    return F.struct(pairs["i"].alias("indices"), pairs["v"].alias("values"))


def _keys(indices: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Numbers in the order of feature and value: values that are not negative are ordered as their bits are."""
    return indices.astype(np.int64) << 32 | np.maximum(values, 0).astype(np.float32).view(np.int32)


def _bins(keys: np.ndarray, indices: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each value, 0 where it is below the feature's first edge."""
    first = np.searchsorted(edges, indices.astype(np.int64) << 32)
    return np.minimum(np.searchsorted(edges, keys, side="right") - first, BINS - 1).astype(np.uint8)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and joined entries of a column of lists."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def bin_edges(rows: DataFrame) -> np.ndarray:
    """Lowest keys of the features' bins: one for each value while these are few, else bins of about as many rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.unique(_keys(_flat(batch.column(0))[1], _flat(batch.column(1))[1]) & COARSE, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

    values = rows.select("entries.indices", "entries.values").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    feature = F.shiftright("key", 32)
    of = Window.partitionBy(feature)
    before = F.sum("n").over(of.orderBy("key")) - F.col("n")
    few = F.count("*").over(of) < BINS
    rank = F.when(few, F.row_number().over(of.orderBy("key"))).otherwise(F.floor(before * (BINS - 1) / F.sum("n").over(of)))
    lowest = values.select("key", feature.alias("feature"), rank.alias("bin")).groupBy("feature", "bin").agg(F.min("key").alias("key"))
    return np.sort(np.array([r.key for r in lowest.select("key").collect()], dtype=np.int64))


def _chunks(rows: DataFrame, targets: list[str], edges) -> DataFrame:
    """Rows in chunks of arrays: random numbers, entries, classes and weights; the rows are in no node yet."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        for at in range(0, table.num_rows if table else 0, 2 * CHUNK_ROWS):
            part = table.slice(at, 2 * CHUNK_ROWS).combine_chunks()
            column = {n: part.column(n).combine_chunks() for n in part.column_names}
            lengths, indices = _flat(column["indices"])
            values = _flat(column["values"])[1]
            bins = _bins(_keys(indices, values), indices, edges.value)
            labels = np.stack([column[t].to_numpy(zero_copy_only=False).astype(np.int32) for t in targets])
            arrays = [
                column["_draw"].to_numpy(zero_copy_only=False).astype(np.int64), lengths.astype(np.int32), indices.astype(np.int32), bins, labels,
                column["weight"].to_numpy(zero_copy_only=False).astype(np.float64), np.zeros(0, np.int32),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], CHUNK.names)

    flat = rows.select("_draw", "entries.indices", "entries.values", *targets, "weight")
    tasks, cores = max(1, -(-rows.count() // CHUNK_ROWS)), rows.sparkSession.sparkContext.defaultParallelism
    return flat.repartition(-(-tasks // cores) * cores if tasks > 1 else 1).mapInArrow(pack, CHUNK)  # all cores are done at the same time


CHUNK = T.StructType([T.StructField(n, T.BinaryType()) for n in ("draw", "lengths", "features", "bins", "labels", "weights", "nodes")])


@dataclass
class _Postings:
    """The rows that have a cell (a feature's number and bin), cell after cell, and in order."""

    cells: np.ndarray
    starts: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, cells: np.ndarray) -> _Postings:
        keys = np.sort(cells.astype(np.uint64) << np.uint64(32) | rows.astype(np.uint64))
        sorted_cells = (keys >> np.uint64(32)).astype(np.uint32)
        starts = np.flatnonzero(np.append(True, sorted_cells[1:] != sorted_cells[:-1])[: len(keys)])
        last = int(rows.max(initial=0))
        return cls(sorted_cells[starts], np.append(starts, len(keys)), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint16 if last < 1 << 16 else np.uint32))

    def above(self, feature: np.ndarray, lowest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows begin that lie at or above bins of features, and how many there are (a row has one bin of a feature)."""
        first = feature.astype(np.int64) * BINS
        begin, end = (self.starts[np.searchsorted(self.cells, (first + b).astype(np.uint32))] for b in (lowest, BINS))
        return begin, end - begin


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - lengths), lengths)


@dataclass
class _Chunk:
    """Rows from the longest to the shortest. ``cells`` (a feature's number and bin) has the first entries of all rows, then the
    second ones of those that have two, and so on: ``counts`` of them. So what a row asks of its entries is a few
    steps over arrays that lie side by side, without a copy of it for each entry. ``postings`` has the same entries by cell, for
    what a large node asks of a few features."""

    draw: np.ndarray
    counts: np.ndarray
    cells: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    nodes: np.ndarray
    postings: _Postings

    @classmethod
    def of(cls, row, targets: int) -> _Chunk:
        kinds = (np.uint64, np.int32, np.int32, np.uint8, np.int32, np.float64, np.int32)
        draw, lengths, features, bins, labels, weights, nodes = (np.frombuffer(row[name], kind) for name, kind in zip(CHUNK.names, kinds))
        order, starts = np.argsort(-lengths, kind="stable"), np.cumsum(lengths, dtype=np.int64) - lengths
        counts = np.cumsum(np.bincount(lengths)[::-1])[::-1][1:].astype(np.int64)  # rows with more than 0, 1, … entries
        flat = features.astype(np.uint32) * np.uint32(BINS) + bins
        cells = np.concatenate([flat[:0], *[flat[starts[order[:n]] + i] for i, n in enumerate(counts.tolist())]])
        used = np.flatnonzero(cells % BINS)  # the lowest bin is where the rows without the feature are
        postings = _Postings.of(_ranges(np.zeros(len(counts), np.int64), counts)[used], cells[used])
        return cls(draw[order], counts, cells, labels.reshape(targets, -1)[:, order], weights[order], nodes.reshape(-1, len(draw)), postings)

    def entries(self, rows: np.ndarray) -> list[tuple[int, int]]:
        """For the first, second, … entries: where they begin in ``cells``, and how many of ``rows`` (in order) have one."""
        begins, n = np.cumsum(self.counts) - self.counts, np.searchsorted(rows, self.counts)
        return [(b, m) for b, m in zip(begins.tolist(), n.tolist()) if m]


def _node_type(nodes: int) -> type:
    return np.int8 if nodes <= 1 << 7 else np.int16 if nodes <= 1 << 15 else np.int32


# ---------------------------------------------------------------------------------------------------- growing


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_D16, _D13, _M1, _M2 = (np.array(x, np.uint32) for x in (16, 13, 0x85EBCA6B, 0xC2B2AE35))


def _drawn(seeds: np.ndarray, x: np.ndarray, y: np.ndarray, share: float, out: np.ndarray) -> None:
    """Whether each node (by its seed) considers each feature (by its hash ``x``), into ``out``; ``x`` and ``y`` are overwritten."""
    np.bitwise_xor(seeds, x, x)
    np.right_shift(x, _D16, y)
    np.bitwise_xor(x, y, x)
    np.multiply(x, _M1, x)
    np.right_shift(x, _D13, y)
    np.bitwise_xor(x, y, x)
    np.multiply(x, _M2, x)
    np.right_shift(x, _D16, y)
    np.bitwise_xor(x, y, x)
    np.less_equal(x, np.uint32(min(1.0, share) * 0xFFFFFFFF), out)


def _true_places(flags: np.ndarray) -> np.ndarray:
    """Where few of many flags are true; their number is a multiple of eight, and eight are looked at together."""
    some = np.flatnonzero(flags.view(np.uint64))
    which, rest = np.nonzero(flags.reshape(-1, 8)[some])
    return some[which] * 8 + rest


def _seed(seed: int, tree: int, depth: int, nodes: np.ndarray) -> np.ndarray:
    start = np.uint64(((seed << 40) ^ (tree << 20) ^ (depth + 1)) & 0xFFFFFFFFFFFFFFFF)
    return (_mixed(_mixed(np.full(1, start)) + nodes.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _row_weights(draw: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in a tree's sample: the same in every pass."""
    u = _mixed(draw + _mixed(np.full(1, (seed << 20) + tree + 1, np.uint64)))
    found = _BY_TOP.take((u >> np.uint64(48)).view(np.int64))
    if len(unsure := np.flatnonzero(found == _UNSURE)):
        found[unsure] = np.searchsorted(_BOUNDS, u[unsure] >> np.uint64(11), side="right")
    return found


def _sampled(chunk: _Chunk, seed: int, trees: int) -> _Chunk:
    """The rows at the roots of the trees whose samples they are in."""
    return replace(chunk, nodes=np.stack([np.where(_row_weights(chunk.draw, seed, t) > 0, 0, -1).astype(np.int8) for t in range(trees)]))


def _moved(chunk: _Chunk, splits: list) -> _Chunk:
    """The rows at the nodes of the next level, -1 where a leaf is reached. The rows that go to the right in a node are found among
    those that have the split's feature at or above its bin, or where these are many, by the entries of the node's rows."""
    kind = _node_type(max(2 + int(left.max(initial=-1)) for _, _, left in splits))
    nodes = np.full(chunk.nodes.shape, -1, kind)
    above, hit = np.empty(nodes.shape[1], np.uint32), np.empty(nodes.shape[1], bool)
    for tree, own in enumerate(chunk.nodes):
        feature, lowest, left = splits[tree]
        open_nodes = np.flatnonzero(left >= 0)
        if not len(open_nodes):
            continue
        to = nodes[tree]
        if own.dtype == np.int8:  # 255 for rows that are at no node
            np.take(np.append(left, np.full(256 - len(left), -1)).astype(kind), own.view(np.uint8), out=to, mode="clip")
        else:
            to[:] = np.append(left, -1).astype(kind)[own]
        begins, lengths = chunk.postings.above(feature[open_nodes], lowest[open_nodes])
        by_posting = np.ones(len(open_nodes), bool)
        if lengths.sum() > len(own):
            sizes = np.bincount(own + np.intp(1), minlength=len(left) + 1)[1:][open_nodes]
            by_posting = lengths * POSTING_COST <= sizes * STEP_COST * len(chunk.counts)
        picked = open_nodes[by_posting]
        if len(picked):
            lengths = lengths[by_posting]
            rows = chunk.postings.rows.take(_ranges(begins[by_posting], lengths))
            to[rows[own.take(rows) == np.repeat(picked.astype(own.dtype), lengths)]] += 1
        if len(picked) == len(open_nodes):
            continue
        chosen = np.zeros(len(left) + 1, bool)
        chosen[open_nodes[~by_posting]] = True
        rows = np.flatnonzero(chosen[own])
        at = own[rows]
        # cells that lie at or above the split, of its feature: from ``low``, ``span`` further ones
        low = (feature.astype(np.int64) * BINS + lowest).astype(np.uint32)[at]
        span = (BINS - 1 - lowest).astype(np.uint32)[at]
        right = np.zeros(len(rows), bool)
        for begin, n in chunk.entries(rows):
            x, y, z = above[:n], hit[:n], right[:n]
            np.take(chunk.cells[begin:], rows[:n], out=x, mode="clip")
            np.subtract(x, low[:n], x)
            np.less_equal(x, span[:n], y)
            np.logical_or(z, y, z)
        to[rows] += right
    return replace(chunk, nodes=nodes)


def _summed(keys: np.ndarray, weights: np.ndarray, below: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sums of their weights; numbers ``below`` a bound that is not large are added up without sorting them."""
    if below is not None and below <= 8 * len(keys) + (1 << 16):
        sums = np.bincount(keys, weights, below)
        found = np.flatnonzero(sums)
        return found, sums[found]
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, weights, len(found))


class _Few:
    """Rows of nodes that have few, of several trees with the same classes, which are handled together: their entries are looked at one by one."""

    def __init__(self, chunk: _Chunk, hashed: np.ndarray, k: int, share: float):
        self.chunk, self.hashed, self.k, self.share, self.width = chunk, hashed, k, share, int(chunk.cells.max(initial=0)) + 1
        self.parts: list[tuple] = []
        self.trees: list[int] = []
        self.first = [0]  # number of a tree's first node among those of all trees
        self.rows = 0

    def add(self, tree: int, rows: np.ndarray, own: np.ndarray, seeds: np.ndarray, label: np.ndarray, weights: np.ndarray) -> None:
        self.parts.append((rows, own + self.first[-1], seeds.take(own), label.take(rows), weights.take(rows)))
        self.trees.append(tree)
        self.first.append(self.first[-1] + len(seeds))
        self.rows += len(rows)

    def full(self) -> bool:
        return self.rows > FEW_ROWS or self.first[-1] * self.width * self.k > 1 << 60  # a node, a cell and a class are one number of 64 bits

    def sums(self) -> tuple[np.ndarray, ...]:
        chunk, k, width = self.chunk, self.k, self.width
        rows, own, seeds, label, weights = (np.concatenate(column) for column in zip(*self.parts))
        order = np.argsort(rows.astype(chunk.postings.rows.dtype), kind="stable")  # from rows with many entries to those with few
        rows, own, seeds, label, weights = (x.take(order) for x in (rows, own, seeds, label, weights))
        x, y = np.empty((2, len(rows)), np.uint32)
        entries = chunk.entries(rows)
        ends = np.cumsum([n for _, n in entries])
        chosen = np.zeros(-(-int(ends[-1]) // 8) * 8 if len(ends) else 0, bool)
        for (begin, n), end in zip(entries, ends.tolist()):
            np.take(self.hashed[begin:], rows[:n], out=x[:n], mode="clip")
            _drawn(seeds[:n], x[:n], y[:n], self.share, chosen[end - n : end])
        hit = _true_places(chosen)
        which = np.searchsorted(ends, hit, side="right")
        begins, starts = (np.array(a, np.int64) for a in ([b for b, _ in entries], [end - n for (_, n), end in zip(entries, ends.tolist())]))
        at = hit - starts[which]
        cells = chunk.cells[begins[which] + rows[at]].astype(np.int64)
        at, cells = (a[cells % BINS > 0] for a in (at, cells))
        keys, sums = _summed((own[at] * width + cells) * k + label[at], weights[at])
        nodes, cells = np.divmod(keys // k, width)
        of = np.searchsorted(self.first, nodes, side="right") - 1
        return np.array(self.trees)[of], nodes - np.array(self.first)[of], cells, keys % k, sums


def _added(chunk: _Chunk, depth: int, seed: int, per_target: int, classes: list[int], share: float) -> Iterator[tuple[np.ndarray, ...]]:
    """The weights of a chunk's rows by ``tree, node, cell, class``. What a node asks of its features is looked up in their postings, or where its
    rows are few, in the entries of the rows."""
    post, hashed, few = chunk.postings, chunk.cells // np.uint32(BINS) * np.uint32(0x9E3779B1), None  # of the features
    firsts = np.flatnonzero(np.append(True, post.cells[1:] // BINS != post.cells[:-1] // BINS)[: len(post.cells)])  # of the features that occur
    occurring, firsts = post.cells[firsts] // np.uint32(BINS) * np.uint32(0x9E3779B1), np.append(firsts, len(post.cells))
    drawn = len(post.rows) * share  # postings of the features that a node considers, as an expected value
    large = (len(occurring) * FEATURE_COST + drawn * POSTING_COST) / max(1, ENTRY_COST * len(chunk.cells)) * len(chunk.draw)
    at_once = max(1, int(POSTINGS_AT_ONCE / max(1, len(occurring), drawn)))
    weights = np.zeros(len(chunk.draw))
    for tree, nodes in enumerate(chunk.nodes):
        rows = np.flatnonzero(nodes >= 0)
        if not len(rows):
            continue
        own, k, label = nodes.take(rows).astype(np.int64), classes[tree // per_target], chunk.labels[tree // per_target]
        weighed = _row_weights(chunk.draw.take(rows), seed, tree) * chunk.weights.take(rows)
        weights[rows] = weighed
        whole = np.bincount(own * k + label.take(rows), weighed)
        some = np.flatnonzero(whole)
        yield np.full(len(some), tree), some // k, np.full(len(some), -1), some % k, whole[some]
        if not share:
            continue
        sizes = np.bincount(own)
        seeds, found = _seed(seed, tree, depth, np.arange(len(sizes))), np.flatnonzero(sizes > large)
        for begin in range(0, len(found), at_once):
            some = found[begin : begin + at_once]
            flags, spare = np.empty((len(some), len(occurring)), bool), np.empty((2, len(some), len(occurring)), np.uint32)
            spare[0] = occurring
            _drawn(seeds[some][:, None], spare[0], spare[1], share, flags)
            which, feature = np.nonzero(flags)
            per_feature = firsts[feature + 1] - firsts[feature]
            which, cell = np.repeat(some[which], per_feature), _ranges(firsts[feature], per_feature)
            lengths = post.starts[cell + 1] - post.starts[cell]
            hit = post.rows.take(_ranges(post.starts[cell], lengths))
            kept = np.flatnonzero(nodes.take(hit) == np.repeat(which.astype(nodes.dtype), lengths))
            hit, pair = hit.take(kept), np.repeat(np.arange(len(which)), lengths).take(kept)
            keys, sums = _summed(pair * k + label.take(hit), weights.take(hit), len(which) * k)
            pair = keys // k
            yield np.full(len(keys), tree), which[pair], post.cells[cell[pair]], keys % k, sums
        if len(found):
            rest = np.flatnonzero((sizes <= large).take(own))
            rows, own = rows.take(rest), own.take(rest)
        if few is not None and (few.k != k or few.full()):
            yield few.sums()
            few = None
        if len(rows):
            few = few or _Few(chunk, hashed, k, share)
            few.add(tree, rows, own, seeds, label, weights)
    if few is not None:
        yield few.sums()


def _cells(chunks: RDD, spark: SparkSession, depth: int, seed: int, per_target: int, classes: list[int], share: float) -> DataFrame:
    """Weights by ``tree, node, cell, class``; a cell is a feature's bin, and -1 the whole node. Share 0 gives the latter alone."""
    kinds = (np.int32, np.int32, np.int64, np.int32, np.float64)

    def add(chunk: _Chunk) -> Iterator[tuple[bytes]]:
        out = list(_added(chunk, depth, seed, per_target, classes, share))
        for begin in range(0, len(out), 64):
            yield (pickle.dumps([np.concatenate(column).astype(kind) for column, kind in zip(zip(*out[begin : begin + 64]), kinds)]),)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in pickle.loads(packed.as_py())], ["tree", "node", "cell", "class", "weight"])

    return spark.createDataFrame(chunks.flatMap(add), "packed binary").mapInArrow(rows, "tree int, node int, cell bigint, class int, weight double")


def _best_of(frame: pd.DataFrame, k: int, last: bool) -> pd.DataFrame:
    """The best split of each node of one tree or several that have ``k`` classes; feature -1 where none is better than a leaf."""
    frame = frame.iloc[np.lexsort([frame[c].to_numpy() for c in ("class", "cell", "node", "tree")])]
    tree, node, cell = (frame[c].to_numpy() for c in ("tree", "node", "cell"))
    new = np.append(True, (tree[1:] != tree[:-1]) | (node[1:] != node[:-1]))
    which = np.cumsum(new) - 1
    n, head = int(new.sum()), cell < 0
    totals = np.zeros((n, k))
    totals[which[head], frame["class"].to_numpy()[head]] = frame["weight"].to_numpy()[head]
    feature, lowest = np.full(n, -1, np.int32), np.zeros(n, np.int32)
    mixed = (totals > 0).sum(axis=1) > 1
    use = np.flatnonzero(~head & mixed[which]) if not last else np.zeros(0, np.int64)
    use = use[::-1]  # from the highest bin of a feature to the lowest, for sums of the rows at or above each bin
    w, c = which[use], cell[use]
    begins = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (c[1:] != c[:-1]))) if len(use) else np.zeros(0, np.int64)
    found = []
    per_slice = max(BINS, 4_000_000 // k)  # splits that are compared at a time, ending with a feature
    starts_feature = np.append(True, (w[begins][1:] != w[begins][:-1]) | (c[begins][1:] // BINS != c[begins][:-1] // BINS)) if len(begins) else np.zeros(0, bool)
    edge = 0
    while edge < len(begins):
        stop = min(edge + per_slice, len(begins))
        if stop < len(begins):
            stop = edge + int(np.flatnonzero(starts_feature[edge : stop + 1])[-1])
        a, b = begins[edge], begins[stop] if stop < len(begins) else len(use)
        split = np.searchsorted(begins[edge:stop], np.arange(a, b), side="right") - 1
        right = np.zeros((stop - edge, k))
        right[split, frame["class"].to_numpy()[use[a:b]]] = frame["weight"].to_numpy()[use[a:b]]
        first = np.maximum.accumulate(np.where(starts_feature[edge:stop], np.arange(stop - edge), 0))
        right = np.cumsum(right, axis=0)
        right -= np.where((first > 0)[:, None], right[np.maximum(first - 1, 0)], 0.0)
        at, cells = w[begins[edge:stop]], c[begins[edge:stop]]
        whole = totals[at]
        left = np.maximum(whole - right, 0)
        n_right, n_left, n_whole = right.sum(axis=1), left.sum(axis=1), whole.sum(axis=1)
        ok = (n_left > 1e-9 * n_whole) & (n_right > 0)
        inside = (right**2).sum(axis=1) / np.where(n_right > 0, n_right, 1) + (left**2).sum(axis=1) / np.where(n_left > 0, n_left, 1)
        gain = np.where(ok, (inside - (whole**2).sum(axis=1) / n_whole) / n_whole, 0)
        keep = gain > 1e-10
        # sums of weights differ in their last digits from run to run
        found.append(pd.DataFrame({"at": at[keep], "gain": np.round(gain[keep], 10), "cell": cells[keep]}))
        edge = stop
    if found:
        best = pd.concat(found).sort_values(["at", "gain", "cell"], ascending=[True, False, True]).drop_duplicates("at")
        feature[best["at"]], lowest[best["at"]] = best["cell"] // BINS, best["cell"] % BINS
    shares = totals / totals.sum(axis=1, keepdims=True)
    return pd.DataFrame({"tree": tree[new], "node": node[new], "feature": feature, "bin": lowest, "shares": list(shares)})


def _best(cells: DataFrame, per_target: int, classes: list[int], last: bool) -> DataFrame:
    """The sums of a node come together in one task, which compares its splits."""

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames), ignore_index=True)
        for target, k in enumerate(classes):
            own = frame[frame["tree"] // per_target == target]
            if len(own):
                yield _best_of(own, k, last)

    sums = cells.repartition("tree", "node").groupBy("tree", "node", "cell", "class").agg(F.sum("weight").alias("weight"))
    return sums.mapInPandas(choose, "tree int, node int, feature int, bin int, shares array<double>")


def _grow(chunks: DataFrame, features: int, classes: list[int], per_target: int, depth: int, seed: int) -> list[Trees]:
    spark, trees = chunks.sparkSession, per_target * len(classes)
    targets, before = len(classes), None
    share = math.ceil(math.sqrt(features)) / features
    levels: list[list] = []  # by level and tree: feature, bin, left, shares
    # an RDD, because the plan of a cached table would hold the plans of all levels before it
    held = chunks.rdd.map(lambda row: _sampled(_Chunk.of(row, targets), seed, trees)).persist(StorageLevel.MEMORY_AND_DISK)
    for level in range(depth + 1):
        last = level == depth
        best = _best(_cells(held, spark, level, seed, per_target, classes, 0 if last else share), per_target, classes, last).collect()
        if before is not None:
            before.unpersist()
        by_tree: list[list] = [[] for _ in range(trees)]
        for r in sorted(best, key=lambda r: (r.tree, r.node)):
            by_tree[r.tree].append(r)
        splits = []
        for tree, found in enumerate(by_tree):
            # a child that no sampled row reaches does not occur: both sides of a split have weight
            feature, lowest = (np.array([r[c] for r in found], np.int32) for c in ("feature", "bin"))
            left = np.where(feature >= 0, 2 * (np.cumsum(feature >= 0) - 1), -1).astype(np.int32)
            shares = np.array([r.shares for r in found]).reshape(len(found), classes[tree // per_target])
            splits.append((feature, lowest, left, shares))
        levels.append(splits)
        if not any((s[2] >= 0).any() for s in splits):
            break
        sent = spark.sparkContext.broadcast([s[:3] for s in splits])
        before, held = held, _next(held, sent)
    held.unpersist()
    return [_joined(levels, range(t * per_target, (t + 1) * per_target)) for t in range(len(classes))]


def _next(chunks: RDD, sent) -> RDD:
    return chunks.map(lambda chunk: _moved(chunk, sent.value)).persist(StorageLevel.MEMORY_AND_DISK)


def _joined(levels: list[list], trees: range) -> Trees:
    """The levels of each tree one after the other."""
    roots, parts, at = [], [], 0
    for tree in trees:
        roots.append(at)
        for level in levels:
            feature, lowest, left, shares = level[tree]
            at += len(feature)
            parts.append((feature, lowest, np.where(left >= 0, left + at, -1).astype(np.int32), shares))  # children are the next level
    return Trees(np.array(roots, np.int32), *(np.concatenate([p[i] for p in parts]) for i in range(4)))


def fit(vectors: DataFrame, targets: dict[str, int], weight: str, draw: Column, trees: int, depth: int, seed: int, features: int) -> ForestModel:
    """A forest for each target: a column of class numbers, with their count. ``draw`` is a number by which a row enters the samples."""
    if features >= NO_CELL // BINS:
        raise ValueError(f"too many features: {features}")
    rows = vectors.select(nonzeros(F.col("features")).alias("entries"), *targets, F.col(weight).cast("double").alias("weight"), draw.alias("_draw"))
    spark, edges = vectors.sparkSession, bin_edges(rows)
    chunks = _chunks(rows, list(targets), spark.sparkContext.broadcast(edges))
    grown = _grow(chunks, features, list(targets.values()), trees, depth, seed)
    return ForestModel(edges, dict(zip(targets, grown)))


# ---------------------------------------------------------------------------------------------------- scoring


@dataclass
class _Paths:
    """The trees of a target as rows go through them. A row carries the number of the node at which it last went to the right (or of the
    root), its label: all rows of one label are at the same node of a level, the one reached from there by going to the left. So
    only the rows that go to the right in a node are looked at."""

    trees: Trees
    levels: list[tuple[np.ndarray, np.ndarray]]  # the nodes that are split, and their trees
    label: np.ndarray
    leaf: np.ndarray  # of a label: where going to the left ends

    @classmethod
    def of(cls, trees: Trees) -> _Paths:
        nodes, tree, levels = trees.roots.astype(np.int64), np.arange(len(trees.roots)), []
        label = leaf = np.arange(len(trees.left), dtype=np.int32)
        label, leaf = label.copy(), leaf.copy()
        while True:
            split = trees.left[nodes] >= 0
            nodes, tree = nodes[split], tree[split]
            if not len(nodes):
                break
            levels.append((nodes, tree))
            left = trees.left[nodes].astype(np.int64)
            label[left] = label[nodes]
            nodes, tree = np.concatenate([left, left + 1]), np.concatenate([tree, tree])
        for nodes, _ in reversed(levels):
            leaf[nodes] = leaf[trees.left[nodes]]
        return cls(trees, levels, label, leaf)


def _probabilities(paths: _Paths, postings: _Postings, n: int, bins) -> np.ndarray:
    """Mean shares of the leaves that ``n`` rows reach. ``bins(rows, features)`` tells the bins of rows one by one; it is asked where the rows of a
    label are few and those with the split's feature are many."""
    trees, label = paths.trees, paths.label
    at = np.repeat(label[trees.roots], n)  # labels, tree after tree
    sizes = np.zeros(len(trees.left), np.int64)  # rows at a node
    sizes[trees.roots] = n
    for nodes, tree in paths.levels:
        some = sizes[nodes] > 0
        nodes, tree = nodes[some], tree[some]
        if not len(nodes):
            break
        begins, lengths = postings.above(trees.feature[nodes], trees.bin[nodes])
        costly = lengths > STEP_COST * sizes[nodes]
        if (lengths - STEP_COST * sizes[nodes])[costly].sum() * PASS_COST <= len(at):  # all labels are looked through to find the rows of some
            costly[:] = False
        left, right = trees.left[nodes].astype(np.int64), np.zeros(len(nodes), np.int64)
        cheap, rows, here = ~costly, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if costly.any():
            place = np.full(len(label), -1, np.int32)
            place[label[nodes[costly]]] = np.flatnonzero(costly)
            which = place[at]
            rows = np.flatnonzero(which >= 0)
            here = which[rows]
            high = bins(rows % n, trees.feature[nodes][here]) >= trees.bin[nodes][here]
            rows, here = rows[high], here[high]
        lengths = lengths[cheap]
        found = postings.rows[_ranges(begins[cheap], lengths)] + np.repeat(tree[cheap] * n, lengths)
        kept = np.flatnonzero(at[found] == np.repeat(label[nodes[cheap]], lengths))
        rows, here = np.append(rows, found[kept]), np.append(here, np.repeat(np.flatnonzero(cheap), lengths)[kept])
        at[rows] = (left + 1)[here]
        right = np.bincount(here, minlength=len(nodes))
        sizes[left + 1], sizes[left] = right, sizes[nodes] - right
    total = np.zeros((n, trees.shares.shape[1]))
    for leaves in paths.leaf[at].reshape(-1, n):
        total += trees.shares[leaves]
    return total / total.sum(axis=1, keepdims=True)


def _laid_out(rows: np.ndarray, features: np.ndarray, bins: np.ndarray, n: int):
    """A function that gives the bins of rows in features; 0 where a row has no entry. They are laid out side by side when first asked for."""

    @functools.cache
    def table() -> tuple[np.ndarray, np.ndarray]:
        columns = np.unique(features)
        side = np.zeros((n, len(columns) + 1), np.uint8)
        side[rows, np.searchsorted(columns, features)] = bins
        return columns, side

    def look(of: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        columns, side = table()
        place = np.searchsorted(columns, wanted)
        place[np.append(columns, -1)[place] != wanted] = len(columns)
        return side[of, place]

    return look


def _answers(indices: pa.Array, values: pa.Array, edges: np.ndarray, paths: dict[str, _Paths], used: np.ndarray) -> list[pa.Array]:
    """Probabilities and predictions of each target for some rows' entries; features that are not ``used`` are passed over."""
    lengths, features = _flat(indices)
    n, bins = len(lengths), _bins(_keys(features, _flat(values)[1]), features, edges)
    known = np.flatnonzero((np.append(used, -1)[np.searchsorted(used, features)] == features) & (bins > 0))
    rows, features, bins = np.repeat(np.arange(n), lengths)[known], features[known], bins[known]
    postings = _Postings.of(rows, features.astype(np.uint32) * np.uint32(BINS) + bins)
    look, out = _laid_out(rows, features, bins, n), []
    for path in paths.values():
        shares = _probabilities(path, postings, n, look)
        offsets = np.arange(n + 1, dtype=np.int32) * shares.shape[1]
        out += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(shares.ravel())), pa.array(shares.argmax(axis=1).astype(float))]
    return out


class ForestModel(Model, MLWritable, MLReadable):
    """Adds ``<target>_probability`` (array) and ``<target>_prediction`` for each target, a column ``<name>_index``."""

    def __init__(self, edges: np.ndarray | None = None, trees: dict[str, Trees] | None = None):
        super().__init__()
        self.edges, self.trees = edges, trees or {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sent = dataset.sparkSession.sparkContext.broadcast((self.edges, self.trees))
        names = {t: t.removesuffix("_index") for t in self.trees}
        fields = [f for n in names.values() for f in (T.StructField(f"{n}_probability", T.ArrayType(T.DoubleType())), T.StructField(f"{n}_prediction", T.DoubleType()))]

        @F.arrow_udf(T.StructType(fields))
        def scored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            edges, trees = sent.value
            paths = {t: _Paths.of(trees[t]) for t in names}
            used = np.unique(np.concatenate([t.feature[t.feature >= 0] for t in trees.values()]))
            for indices, values in batches:
                parts = [_answers(indices.slice(at, SCORED_ROWS), values.slice(at, SCORED_ROWS), edges, paths, used) for at in range(0, len(indices), SCORED_ROWS)]
                yield pa.StructArray.from_arrays([pa.concat_arrays(column) for column in zip(*parts)], names=[f.name for f in fields])

        entries = nonzeros(F.col("features"))
        answered = dataset.withColumn("_scored", scored(entries["indices"], entries["values"]))
        return answered.select(*dataset.columns, *[F.col("_scored")[f.name].alias(f.name) for f in fields])

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


_PARTS = "target string, roots binary, feature binary, bin binary, left binary, classes int, shares binary, edges binary"


class _Writer(MLWriter):
    def __init__(self, instance: ForestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802, Spark's name
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        rows = []
        for target, t in self.instance.trees.items():
            arrays = [a.tobytes() for a in (t.roots, t.feature, t.bin, t.left)]
            rows.append((target, *arrays, t.shares.shape[1], t.shares.tobytes(), self.instance.edges.tobytes()))
        self.sparkSession.createDataFrame(rows, _PARTS).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        trees, edges = {}, None
        for r in self.sparkSession.read.schema(_PARTS).parquet(f"{path}/trees").collect():
            arrays = [np.frombuffer(r[c], np.int32) for c in ("roots", "feature", "bin", "left")]
            trees[r.target] = Trees(*arrays, np.frombuffer(r.shares, np.float64).reshape(-1, r.classes))
            edges = np.frombuffer(r.edges, np.int64)
        model = ForestModel(edges, trees)
        model._resetUid(metadata["uid"])
        return model
